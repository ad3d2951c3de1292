"""One class of our own for each detection rule, and for what a rule mustn't take, with the rows that it gives.

A sample is a class on one line, its entry points as (method, type, channel, message type, verb or
kind) and its producers as (id after Class.method:, type, channel, message type, response type).
What is expected is written down from the rules' meaning, by hand.
"""

from __future__ import annotations

from typing import NamedTuple

PACKAGE = "g"


class Sample(NamedTuple):
    java: str
    entries: tuple = ()
    producers: tuple = ()

    @property
    def name(self) -> str:
        words = self.java.replace("{", " ").split()
        return words[next(k for k, w in enumerate(words) if w in ("class", "interface")) + 1]


S = Sample
SAMPLES = (
    # brokers' listeners
    S('class RabbitIn { @RabbitListener(queues = {"q.a", "q.b"}) void take(Order o) { } }', (("take", "rabbitmq-consumer", "q.a", "Order", ""), ("take", "rabbitmq-consumer", "q.b", "Order", ""))),
    S('class KafkaIn { @KafkaListener(topics = "${g.topic}") void take(Order o) { } }', (("take", "kafka-consumer", "g-in", "Order", ""),)),
    S('class KafkaFallback { @KafkaListener(topics = "${no.such:spare}") void take(Order o) { } }', (("take", "kafka-consumer", "spare", "Order", ""),)),
    S("class KafkaPlain { @KafkaListener void take(Parcel p) { } }", (("take", "kafka-consumer", "Parcel", "Parcel", ""),)),
    S('class KafkaCompanion { @KafkaListener @Topic("elsewhere") void take(Parcel p) { } }'),
    S('class JmsIn { @JmsListener(destination = "jms.in") void take(String s) { } }', (("take", "jms-consumer", "jms.in", "String", ""),)),
    S('class SqsIn { @SqsListener("https://sqs.eu.example/123/queue-x") void take(Job j) { } }', (("take", "sqs-consumer", "queue-x", "Job", ""),)),
    S('class SqsArn { @SqsListener(queueNames = "arn:aws:sqs:eu:1:queue-y") void take(Job j) { } }', (("take", "sqs-consumer", "queue-y", "Job", ""),)),
    S('class PulsarIn { @PulsarListener(topics = "puls") void take(Job j) { } }', (("take", "pulsar-consumer", "puls", "Job", ""),)),
    S('class StreamIn { @StreamListener("sink") void take(Job j) { } }', (("take", "kafka-consumer", "sink", "Job", ""),)),
    S('@RocketMQMessageListener(topic = "rocket", consumerGroup = "c") class RocketIn implements RocketMQListener { public void onMessage(Job j) { } }', (("onMessage", "kafka-consumer", "rocket", "", ""),)),
    S('class NoListener { @Listener("q") void take(Order o) { } void queues() { } }'),
    # REST, events, schedules, sockets
    S('@RequestMapping("/v1") class Rest { @PutMapping("/{id}") void put(Order o) { } @DeleteMapping("/{id}") void drop(String id) { } @PatchMapping(path = "patch") void patch() { } @RequestMapping({"/a", "/b"}) void any() { } }',
      (("put", "rest-endpoint", "/v1/{id}", "", "PUT"), ("drop", "rest-endpoint", "/v1/{id}", "", "DELETE"), ("patch", "rest-endpoint", "/v1/patch", "", "PATCH"), ("any", "rest-endpoint", "/v1/a", "", ""), ("any", "rest-endpoint", "/v1/b", "", ""))),
    S("class RestBare { @GetMapping void all() { } }", (("all", "rest-endpoint", "unknown", "", "GET"),)),
    S("class Events { @EventListener void on(Started s) { } @TransactionalEventListener void none() { } }", (("on", "event-listener", "Started", "Started", ""), ("none", "event-listener", "unknown-event", "", ""))),
    S('class Ticks { @Scheduled(fixedDelay = 5000) void tick() { } @Scheduled void bare() { } @Scheduled(fixedRateString = "${g.rate}") void named() { } }',
      (("tick", "scheduled-task", "5000", "", ""), ("bare", "scheduled-task", "@Scheduled:bare", "", ""), ("named", "scheduled-task", "100", "", ""))),
    S('class Chat { @MessageMapping("/chat") @SendTo({"/topic/a", "/topic/b"}) public Note talk(Msg m) { return null; } @SubscribeMapping("/feed") void feed() { } @MessageMapping("/own") @SendToUser("/queue/u") Note own(Msg m) { return null; } }',
      (("talk", "websocket", "/chat", "", ""), ("feed", "websocket", "/feed", "", ""), ("own", "websocket", "/own", "", "")),
      (("talk:sendTo:/topic/a", "unknown", "/topic/a", "Note", ""), ("talk:sendTo:/topic/b", "unknown", "/topic/b", "Note", ""), ("own:sendTo:/queue/u", "unknown", "/queue/u", "Note", ""))),
    # Jakarta
    S('@Path("/res") class Res { @GET @Path("/{id}") public String one(String id) { return id; } @POST public void add(Item i) { } @OPTIONS @Path("opts") public void opts() { } }',
      (("one", "rest-endpoint", "/res/{id}", "", "GET"), ("add", "rest-endpoint", "/res", "", "POST"), ("opts", "rest-endpoint", "/res/opts", "", "OPTIONS"))),
    S("class ResBare { @GET public String x() { return null; } @Path(\"/p\") void locator() { } }", (("x", "rest-endpoint", "unknown", "", "GET"),)),
    S("class Watch { void seen(@Observes Paid p) { } void unseen(Paid p) { } }", (("seen", "event-listener", "Paid", "Paid", ""),)),
    S('class Timers { @Schedule(hour = "*") void nightly() { } @Timeout void fired(Timer t) { } }', (("nightly", "scheduled-task", "@Schedule:nightly", "", ""), ("fired", "scheduled-task", "@Schedule:fired", "", ""))),
    S('@ServerEndpoint("/live") class Live { @OnMessage void got(String m) { } @OnOpen void opened() { } @OnClose void closed() { } @OnError void failed() { } void other() { } }',
      (("got", "websocket", "/live", "", ""), ("opened", "websocket", "/live", "", ""), ("closed", "websocket", "/live", "", ""), ("failed", "websocket", "/live", "", ""))),
    S("class NotLive { @OnMessage void got(String m) { } }"),
    S('@MessageDriven(activationConfig = { @ActivationConfigProperty(propertyName = "destinationType", propertyValue = "queue"), @ActivationConfigProperty(propertyName = "destination", propertyValue = "jms/orders") }) class Mdb implements MessageListener { public void onMessage(Message m) { } }',
      (("onMessage", "jms-consumer", "jms/orders", "javax.jms.Message", ""),)),
    # other contracts
    S("class Starter { public static void main(String[] args) { go(); } static void go() { } }", (("main", "main", "main", "", ""),)),
    S("class Booted { public static void main(String[] args) { SpringApplication.run(Booted.class, args); } }"),
    S("class NotMain { public void main(String[] args) { } static void main() { } public static int main(String[] a, int b) { return b; } }"),
    S("class Cycle { @PostConstruct void init() { } @PreDestroy void end() { } }", (("init", "lifecycle", "@PostConstruct:init", "", ""), ("end", "lifecycle", "@PreDestroy:end", "", ""))),
    S("class CmdRun implements CommandLineRunner { public void run(String a) { } void walk() { } }", (("run", "lifecycle", "@CommandLineRunner:run", "", ""),)),
    S("class AppRun implements ApplicationRunner { public void run(Args a) { } }", (("run", "lifecycle", "@ApplicationRunner:run", "", ""),)),
    S("class BeanInit implements InitializingBean, DisposableBean { public void afterPropertiesSet() { } public void destroy() { } }", (("afterPropertiesSet", "lifecycle", "@InitializingBean:afterPropertiesSet", "", ""), ("destroy", "lifecycle", "@DisposableBean:destroy", "", ""))),
    S("class Smart implements SmartInitializingSingleton { public void afterSingletonsInstantiated() { } }", (("afterSingletonsInstantiated", "lifecycle", "@SmartInitializingSingleton:afterSingletonsInstantiated", "", ""),)),
    S('@WebService class Soap { @WebMethod(operationName = "getQuote") String quote() { return null; } @WebMethod String plain() { return null; } String hidden() { return null; } }',
      (("quote", "soap-service", "getQuote", "", "SOAP"), ("plain", "soap-service", "plain", "", "SOAP"))),
    S("class NoSoap { @WebMethod String quote() { return null; } }"),
    S('class Gql { @QueryMapping Book book(String id) { return null; } @MutationMapping(name = "addBook") Book add(BookInput b) { return null; } @SubscriptionMapping("books") Flux all() { return null; } @SchemaMapping Author author(Book b) { return null; } @BatchMapping Map many(List l) { return null; } }',
      (("book", "graphql", "book", "String", "Query"), ("add", "graphql", "addBook", "BookInput", "Mutation"), ("all", "graphql", "books", "", "Subscription"), ("author", "graphql", "author", "Book", "Schema"), ("many", "graphql", "many", "List", "Batch"))),
    S('@WebServlet({"/s1", "/s2"}) class Serv extends HttpServlet { protected void doGet(Req r) { } protected void service(Req r) { } void helper() { } }',
      (("doGet", "servlet", "/s1", "", "GET"), ("doGet", "servlet", "/s2", "", "GET"), ("service", "servlet", "/s1", "", ""), ("service", "servlet", "/s2", "", ""))),
    S('@WebFilter("/f/*") class Filt implements Filter { public void doFilter(Req r) { } public void init() { } }', (("doFilter", "servlet", "/f/*", "", "FILTER"),)),
    S("class Grpc extends PriceImplBase { @Override public void quote(Ask a, StreamObserver<Bid> out) { } public void open(Ask a, StreamObserver<Bid> out) { } @Override public String toString() { return null; } }",
      (("quote", "grpc-service", "/Price/quote", "Ask", "GRPC"),)),
    S('class Fn { @Bean public Function<In, Out> up() { return null; } @Bean Supplier<Out> gen() { return null; } @Bean("eater") Consumer<In> eat() { return null; } @Bean String no() { return null; } Function<In, Out> plain() { return null; } }',
      (("up", "cloud-function", "up", "In", "FUNCTION"), ("gen", "cloud-function", "gen", "", "SUPPLIER"), ("eat", "cloud-function", "eater", "In", "CONSUMER"))),
    # routes, reactive channels, Micronaut
    S('class CamelIn extends RouteBuilder { public void configure() { from("rabbitmq:ex/rk?a=b").toD("kafka:down").wireTap("jms:topic:tap"); from("timer:x").to("log:y"); from("aws2-sqs://queue-z").enrich("kafka:no"); } }',
      (("configure", "rabbitmq-consumer", "rk", "", ""), ("configure", "sqs-consumer", "queue-z", "", "")),
      (("configure:toD:down", "kafka-producer", "down", "", ""), ("configure:wireTap:tap", "jms-producer", "tap", "", ""))),
    S('class NoRoute { public void configure() { from("kafka:x").to("kafka:y"); } }'),
    S('class ReactIn { @Incoming("g-jobs") void run(Job j) { } @Incoming("g-raw") @Outgoing("g-done") Done pipe(Job j) { return null; } @Channel("g-emit") Emitter<Job> out; void go(Job j) { out.send(j); out.complete(); } }',
      (("run", "reactive-incoming", "jobs-topic", "Job", ""), ("pipe", "reactive-incoming", "g-raw", "Job", "")),
      (("pipe:outgoing:done-queue", "unknown", "done-queue", "Done", ""), ("go:emitter:g-emit", "unknown", "g-emit", "", ""))),
    S('@KafkaListener class MicroK { @Topic("m.t") void got(Rec r) { } void plain(Rec r) { } }', (("got", "kafka-consumer", "m.t", "Rec", ""),)),
    S('@RabbitListener class MicroR { @Queue("m.q") void got(Rec r) { } @QueueBinding(queue = "m.b") void bound(Rec r) { } }', (("got", "rabbitmq-consumer", "m.q", "Rec", ""), ("bound", "rabbitmq-consumer", "m.b", "Rec", ""))),
    S('@MqttListener class MicroM { @Topic("m/x") void got(Rec r) { } }', (("got", "mqtt-consumer", "m/x", "Rec", ""),)),
    S('class NoMicro { @Topic("m.n") void got(Rec r) { } }'),
    # Axon and buses of one's own
    S("class Agg { @CommandHandler Agg(CreateIt c) { AggregateLifecycle.apply(new Created(c)); } @EventSourcingHandler void on(Created e) { } @QueryHandler Out ask(FindIt f) { return null; } void bare() { apply(new Created(null)); } }",
      (("<init>", "message-handler", "g.CreateIt", "g.CreateIt", ""), ("on", "event-listener", "g.Created", "g.Created", ""), ("ask", "message-handler", "g.FindIt", "g.FindIt", "")),
      (("<init>:apply:g.Created", "message-bus-producer", "g.Created", "g.Created", ""),)),
    S("class Proj { @EventHandler void on(Message m, Created e) { } }", (("on", "event-listener", "g.Created", "g.Created", ""),)),
    S("class Gate { CommandGateway gw; QueryBus qb; void fire(CreateIt c) { gw.send(new CreateIt()); gw.sendAndWait(c); qb.query(new FindIt()); gw.hashCode(); } }", (),
      (("fire:send:gw:g.CreateIt", "message-bus-producer", "g.CreateIt", "g.CreateIt", ""), ("fire:query:qb:g.FindIt", "message-bus-producer", "g.FindIt", "g.FindIt", ""))),
    S("@BusHandler class BusIn { @Handles void got(MessageContext<Paid> m) { } void other(Paid p) { } }", (("got", "message-handler", "g.Paid", "g.Paid", ""),)),
    S("class NoBusIn { @Handles void got(Paid p) { } }"),
    S('class BusOut { OrderMessageBus bus; void go(Paid paid, String text) { bus.send(new Paid()); bus.emit(paid); bus.send("x"); bus.send(text); bus.close(); } }', (),
      (("go:send:bus:g.Paid", "message-bus-producer", "g.Paid", "g.Paid", ""), ("go:emit:bus:g.Paid", "message-bus-producer", "g.Paid", "g.Paid", ""))),
    # senders of templates
    S('class RabbitOut { RabbitTemplate rt; void go(Order o) { rt.convertAndSend("ex", "rk", o); rt.setExchange("no"); } }', (), (("go:convertAndSend:rt", "rabbitmq-producer", "ex", "", ""),)),
    S('class KafkaOut { KafkaTemplate<String, Order> kt; void go(Order o) { kt.send("k.out", Order.CREATED); Message m = MessageBuilder.withPayload(o).setHeader(KafkaHeaders.TOPIC, "built").build(); kt.send(m); } }', (),
      (("go:send:kt", "kafka-producer", "k.out", "CREATED", ""), ("go:send:kt", "kafka-producer", "built", "", ""))),
    S('class PulsarOut { PulsarTemplate<Job> pt; void go(Job j) { pt.sendAsync("p.out", new Job(1)); } }', (), (("go:sendAsync:pt", "pulsar-producer", "p.out", "Job", ""),)),
    S('class NatsOut { Connection nats; void go(Job j) { nats.publish("subj", j); } }', (), (("go:publish:nats", "nats-producer", "subj", "", ""),)),
    S('class StreamOut { StreamBridge sb; void go(Job j) { sb.send("out-0", j); } }', (), (("go:send:sb", "unknown", "out-0", "", ""),)),
    S('class RocketOut { RocketMQTemplate rq; void go(Job j) { rq.syncSend("r.out", j); } }', (), (("go:syncSend:rq", "kafka-producer", "r.out", "", ""),)),
    S('class SqsOut { AmazonSQS sqs; void go(Job j) { sqs.sendMessage("https://sqs.eu.example/1/q-out", "body"); } }', (), (("go:sendMessage:sqs", "sqs-producer", "q-out", "", ""),)),
    S('class SnsOut { SnsTemplate sns; SnsClient sc; void go(Job j) { sns.convertAndSend("sns-t", j); sc.publish("sns-u"); } }', (), (("go:convertAndSend:sns", "sns-producer", "sns-t", "", ""), ("go:publish:sc", "sns-producer", "sns-u", "", ""))),
    S('class JmsOut { JmsTemplate jt; JMSProducer jp; void go(Order o) { jt.convertAndSend("jms.out", o); jp.send("jms.two", o); jt.send(session.createTopic("made"), o); } }', (),
      (("go:convertAndSend:jt", "jms-producer", "jms.out", "", ""), ("go:send:jp", "jms-producer", "jms.two", "", ""), ("go:send:jt", "jms-producer", "made", "", ""))),
    S('class MqttOut { MqttClient mq; RedisTemplate<String, Job> rd; void go(Job j) { mq.publish("m.out", j); rd.convertAndSend("r.chan", j); } }', (), (("go:publish:mq", "unknown", "m.out", "", ""), ("go:convertAndSend:rd", "unknown", "r.chan", "", ""))),
    S("class EventOut { ApplicationEventPublisher pub; void go(Order o) { pub.publishEvent(new Started(o)); pub.publishEvent(o); } }", (), (("go:publishEvent:pub", "event-publisher", "Started", "Started", ""), ("go:publishEvent:pub", "event-publisher", "o", "o", ""))),
    S('class LocalOut { void go(Object o) { KafkaTemplate kt = make(); kt.send("local.out", o); other.send("no", o); } }', (), (("go:send:kt", "kafka-producer", "local.out", "", ""),)),
    S("class StubOut { PriceGrpc.PriceFutureStub stub; void go(Ask a) { stub.quote(a); } }", (), (("go:grpc:Price/quote", "grpc-call", "/Price/quote", "PriceFutureStub", ""),)),
    # callers
    S('@FeignClient(name = "stock", url = "http://stock/api") interface StockClient { @GetMapping("/items/{id}") Item item(String id); @PostMapping("/items") Item add(Item i); void plain(); }', (),
      (("item:http:/items/{id}", "http-call", "/api/items/{id}", "GET", "Item"), ("add:http:/items", "http-call", "/api/items", "POST", "Item"))),
    S('@HttpExchange(url = "/base") interface PriceClient { @GetExchange("/x") Price get(); @DeleteExchange("/x") void drop(); }', (), (("get:http:/x", "http-call", "/base/x", "GET", "Price"), ("drop:http:/x", "http-call", "/base/x", "DELETE", "void"))),
    S('@HttpExchange("/unnamed") interface PlainClient { @PutExchange("/y") Price put(); }', (), (("put:http:/y", "http-call", "/y", "PUT", "Price"),)),
    S('class RestOut { RestTemplate rt; void go() { rt.postForObject("http://h/r/1", null, X.class); rt.delete("/r/2"); rt.getForObject("name", X.class); } }', (), (("go:http:/r/1", "http-call", "/r/1", "POST", ""), ("go:http:/r/2", "http-call", "/r/2", "DELETE", ""))),
    S('class JaxOut { Client cl; OkHttpClient ok; void go() { cl.target("http://h/j/1"); ok.newCall(rb.url("http://h/ok/1").build()); } }', (), (("go:http:/j/1", "http-call", "/j/1", "", ""), ("go:http:/ok/1", "http-call", "/ok/1", "", ""))),
    S('class ApacheOut { CloseableHttpClient http; void go() { http.execute(new HttpGet("http://h/ap/1")); HttpPost p = new HttpPost("/ap/2"); http.execute(p); http.execute(q); } }', (),
      (("go:http:/ap/1", "http-call", "/ap/1", "GET", ""), ("go:http:/ap/2", "http-call", "/ap/2", "POST", ""))),
    S('class AsyncOut { AsyncHttpClient ah; void go() { ah.preparePut("/as/1"); } }', (), (("go:http:/as/1", "http-call", "/as/1", "PUT", ""),)),
    S('class FluentOut { RestClient rc; WebClient.Builder wb; void go() { rc.post().uri("/fl/1").retrieve(); wb.build().delete().uri("http://h/fl/2").retrieve(); rc.uri("/no/verb"); } }', (),
      (("go:http:/fl/1", "http-call", "/fl/1", "POST", ""), ("go:http:/fl/2", "http-call", "/fl/2", "DELETE", ""))),
    S('class NoSender { Helper kt; void go(Object o) { kt.send("no", o); kt.getForObject("/no", o); } }'),
)

FILE = ("gallery", "src/Gallery.java")
SOURCE = "\n".join([f"package {PACKAGE};", *(s.java for s in SAMPLES)]) + "\n"
CONFIG = (
    ("gallery", "application.properties"),
    "g.topic=g-in\ng.rate=100\nmp.messaging.incoming.g-jobs.topic=jobs-topic\nmp.messaging.outgoing.g-done.queue=done-queue\n",
)


def entry_rows() -> list[tuple]:
    """(id, type, channel, line, message_type, method_type) of all samples."""
    out = []
    for line, s in enumerate(SAMPLES, 2):
        for method, kind, channel, message, verb in s.entries:
            out.append((f"gallery:{s.name}.{method}" + (f":{channel}" if channel != "unknown" else ""), kind, channel, line, message, verb))
    return out


def producer_rows() -> list[tuple]:
    """(id, type, channel, line, message_type, response_type) of all samples."""
    return [(f"gallery:{s.name}.{tail}", kind, channel, line, message, response) for line, s in enumerate(SAMPLES, 2) for tail, kind, channel, message, response in s.producers]
