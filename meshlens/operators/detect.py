"""Entry points and producers found by rules over annotations, supertypes and calls.

A rule is a filter over one relation (methods, their annotations, or calls) that names a channel
token and how it is to be resolved.  All rules' rows meet in one table; tokens are resolved there by
three joins (constants and configuration, qualified names, reactive configuration).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_urlish, join_rest_path, last_seg, sqs_queue_name, strip_http_origin
from ..plans.fixpoint import cut
from ..sources.extract import JavaIndex
from .resolve import calls_of, field_types, param_type, resolve_channel, resolve_fqn, resolve_reactive_channel

#: The public annotations, types and methods that frameworks give a meaning.
CONSUMERS = {
    "RabbitListener": ("rabbitmq-consumer", "queues"), "KafkaListener": ("kafka-consumer", "topics"), "JmsListener": ("jms-consumer", "destination"), "SqsListener": ("sqs-consumer", "queueNames"),
    "PulsarListener": ("pulsar-consumer", "topics"), "RocketMQMessageListener": ("kafka-consumer", "topic"), "StreamListener": ("kafka-consumer", "value"),
}
CONSUMER_KEYS = ("_raw", "value", "queues", "topics", "destination", "queueNames")
COMPANIONS = ("Topic", "Queue", "QueueBinding")
REST_VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": ""}
EXCHANGE_VERBS = {"GetExchange": "GET", "PostExchange": "POST", "PutExchange": "PUT", "DeleteExchange": "DELETE", "PatchExchange": "PATCH"}
PATH_KEYS = ("value", "path", "_raw")
EVENTS = ("EventListener", "TransactionalEventListener")
SCHEDULE_KEYS = ("cron", "fixedDelay", "fixedRate", "fixedDelayString", "fixedRateString")
WEBSOCKETS = ("MessageMapping", "SubscribeMapping")
JAXRS_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
SOCKET_METHODS = ("OnMessage", "OnOpen", "OnClose", "OnError")
TIMERS = ("Schedule", "Schedules", "Timeout")
LIFECYCLE = ("PostConstruct", "PreDestroy")
LIFECYCLE_METHODS = {"CommandLineRunner": "run", "ApplicationRunner": "run", "InitializingBean": "afterPropertiesSet", "SmartInitializingSingleton": "afterSingletonsInstantiated", "DisposableBean": "destroy"}
SERVLET_METHODS = {"doGet": "GET", "doPost": "POST", "doPut": "PUT", "doDelete": "DELETE", "doPatch": "PATCH", "doHead": "HEAD", "doOptions": "OPTIONS", "service": ""}
GRAPHQL = {"QueryMapping": "Query", "MutationMapping": "Mutation", "SubscriptionMapping": "Subscription", "SchemaMapping": "Schema", "BatchMapping": "Batch"}
FUNCTIONS = ("Function", "Supplier", "Consumer")
CAMEL_BASES = ("RouteBuilder", "RoutesBuilder", "RouteConfigurationBuilder")
CAMEL_SCHEMES = {
    "kafka": ("kafka-consumer", "kafka-producer"), "rabbitmq": ("rabbitmq-consumer", "rabbitmq-producer"), "jms": ("jms-consumer", "jms-producer"),
    "sqs": ("sqs-consumer", "unknown"), "aws2-sqs": ("sqs-consumer", "unknown"), "aws-sqs": ("sqs-consumer", "unknown"),
}
CAMEL_SENDS = ("to", "toD", "toF", "wireTap")
MICRONAUT = {"KafkaListener": "kafka-consumer", "RabbitListener": "rabbitmq-consumer", "JmsListener": "jms-consumer", "MessageListener": "message-handler", "MqttListener": "mqtt-consumer"}
MICRONAUT_CHANNELS = {"Topic": "_raw", "Queue": "_raw", "QueueBinding": "queue", "MessageMapping": "_raw"}
EMITTER_SENDS = ("send", "sendAndAwait", "sendAsync")
AXON = {"CommandHandler": "message-handler", "QueryHandler": "message-handler", "EventHandler": "event-listener", "EventSourcingHandler": "event-listener"}
ENVELOPES = ("MessageContext", "Message", "byte[]", "String")
BUS_CLASSES = ("MessageHandler", "BusHandler", "EventHandler", "Consumer", "Listener")
BUS_METHODS = ("Handle", "Handles", "OnMessage", "MessageHandler", "Consume", "Subscribe")
FEIGN = ("FeignClient", "HttpExchange", "HttpExchangeInterface")
SENDERS = {
    "KafkaTemplate": ("kafka-producer", ("send",)),
    "RabbitTemplate": ("rabbitmq-producer", ("convertAndSend", "convertSendAndReceive", "send")),
    "AmqpTemplate": ("rabbitmq-producer", ("convertAndSend", "convertSendAndReceive", "send")),
    "JmsTemplate": ("jms-producer", ("convertAndSend", "convertSendAndReceive", "send")),
    "ApplicationEventPublisher": ("event-publisher", ("publishEvent",)),
    "StreamBridge": ("unknown", ("send",)),
    "PulsarTemplate": ("pulsar-producer", ("send", "sendAsync")),
    "Connection": ("nats-producer", ("publish",)),
    "RocketMQTemplate": ("kafka-producer", ("syncSend", "asyncSend", "sendOneway", "syncSendOrderly", "convertAndSend")),
    "SqsTemplate": ("sqs-producer", ("send",)),
    "SqsClient": ("sqs-producer", ("sendMessage",)),
    "AmazonSQS": ("sqs-producer", ("sendMessage", "sendMessageBatch")),
    "AmazonSQSAsync": ("sqs-producer", ("sendMessage", "sendMessageBatch")),
    "SnsTemplate": ("sns-producer", ("send", "convertAndSend")),
    "SnsClient": ("sns-producer", ("publish",)),
    "AmazonSNS": ("sns-producer", ("publish", "publishBatch")),
    "AmazonSNSAsync": ("sns-producer", ("publish", "publishBatch")),
    "JMSProducer": ("jms-producer", ("send",)),
    "MqttClient": ("unknown", ("publish",)),
    "MqttAsyncClient": ("unknown", ("publish",)),
    "RedisTemplate": ("unknown", ("convertAndSend",)),
    "StringRedisTemplate": ("unknown", ("convertAndSend",)),
}
ROUTED = {
    "CommandGateway": ("send", "sendAndWait", "sendAndWaitForMessage"),
    "CommandBus": ("dispatch",),
    "EventGateway": ("publish",),
    "EventBus": ("publish",),
    "QueryGateway": ("query", "scatterGather", "subscriptionQuery"),
    "QueryBus": ("query",),
}
BUS_SENDS = ("send", "sendAndAwait", "publish", "dispatch", "emit", "fire")
NO_PAYLOADS = ("byte[]", "String", "MessageContext", "ZonedDateTime", "Instant", "Map")
HTTP_CLIENTS = {
    "RestTemplate": ("getForObject", "getForEntity", "postForObject", "postForEntity", "put", "patchForObject", "delete", "exchange", "execute"),
    "WebClient": ("get", "post", "put", "patch", "delete", "exchange"),
    "RestClient": ("get", "post", "put", "patch", "delete"),
    "HttpClient": ("send", "sendAsync", "execute"),
    "OkHttpClient": ("newCall",),
    "Client": ("target", "invoke"),
    "WebTarget": ("request", "path"),
    "CloseableHttpClient": ("execute",),
    "DefaultCloseableHttpClient": ("execute",),
    "AsyncHttpClient": ("prepareGet", "preparePost", "preparePut", "preparePatch", "prepareDelete", "prepareHead", "prepareOptions", "execute"),
    "DefaultAsyncHttpClient": ("prepareGet", "preparePost", "preparePut", "preparePatch", "prepareDelete", "prepareHead", "prepareOptions", "execute"),
}
TEMPLATE_VERBS = {"getForObject": "GET", "getForEntity": "GET", "postForObject": "POST", "postForEntity": "POST", "put": "PUT", "patchForObject": "PATCH", "delete": "DELETE"}
ASYNC_VERBS = {"prepareGet": "GET", "preparePost": "POST", "preparePut": "PUT", "preparePatch": "PATCH", "prepareDelete": "DELETE", "prepareHead": "HEAD", "prepareOptions": "OPTIONS"}


def lookup(column: Column, table: dict[str, str]) -> Column:
    """A small rule table as an expression: the value for a name, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def sends_by(kind: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Whether the called method (column method) is one that the table has for a type."""
    rows = [(kind == name) & F.col("method").isin(*methods) for name, methods in table.items()]
    return F.coalesce(reduce(Column.__or__, rows), F.lit(False))


def named(annotations, name: str) -> Column:
    return F.get(F.filter(annotations, lambda a: a["name"] == name), F.lit(0))


def has(annotations, *names: str) -> Column:
    return F.exists(annotations, lambda a: a["name"].isin(*names))


def values(annotation: Column, *keys: str) -> Column:
    """The values of the first of these keys that has any; an empty array if none has."""
    some = [F.when(F.size(F.try_element_at(annotation["args"], F.lit(k))) > 0, F.try_element_at(annotation["args"], F.lit(k))) for k in keys]
    return F.coalesce(*some, F.array().cast("array<string>"))


def value(annotation: Column, *keys: str) -> Column:
    return F.get(values(annotation, *keys), F.lit(0))


def default(array: Column, other: Column) -> Column:
    return F.when(F.size(array) > 0, array).otherwise(F.array(other))


_METHOD = ("key", "repo", "file", "simple_name", "class_line", "supertypes", "c_ann", "ord", "m_ord", "m")
_ROW = ("key", "repo", "file", "simple_name", "method", "line", "ord")
ENTRY = (*_ROW, "type", "token", "mode", "post", "prefix", "message_type", "message_mode", "method_type")
PRODUCER = (*_ROW, "type", "token", "mode", "post", "prefix", "message_type", "message_mode", "response_type", "id_form", "called", "receiver", "raw")


def _methods(idx: JavaIndex) -> DataFrame:
    rows = idx.scanned.select("key", "repo", "file", "simple_name", F.col("line").alias("class_line"), "supertypes", F.col("annotations").alias("c_ann"), "ord", F.posexplode("methods").alias("m_ord", "m"))
    return rows.withColumn("ord", F.concat_ws("|", "ord", F.lpad(F.col("m_ord").cast("string"), 6, "0")))


def _entries(df: DataFrame, kind: Column | str, token: Column, mode: str = "channel", post: str = "", prefix: Column | None = None, message: Column | None = None, message_mode: str = "", verb: Column | str = "", line: Column | None = None, name: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        "key", "repo", "file", "simple_name", (name if name is not None else F.col("m.name")).alias("method"), (line if line is not None else F.col("m.line")).alias("line"), "ord",
        lit(kind).alias("type"), token.alias("token"), F.lit(mode).alias("mode"), F.lit(post).alias("post"), (prefix if prefix is not None else F.lit("")).alias("prefix"),
        F.coalesce(message if message is not None else F.lit(""), F.lit("")).alias("message_type"), F.lit(message_mode).alias("message_mode"), F.coalesce(lit(verb), F.lit("")).alias("method_type"),
    )


def _payload_param() -> Column:
    """Simple type of the first parameter that is no envelope, as written."""
    kinds = F.transform("m.params", lambda p: last_seg(p["type_text"]))
    return F.get(F.filter(kinds, lambda t: (t != "") & ~t.isin(*ENVELOPES)), F.lit(0))


def entry_rules(idx: JavaIndex) -> DataFrame:
    """Rows (ENTRY) of all entry-point rules, with channel tokens not yet resolved."""
    m = _methods(idx).filter(~has("c_ann", *FEIGN) | (F.col("m.name") == "<init>"))
    first_type = F.coalesce(F.get("m.params", F.lit(0))["type_text"], F.lit(""))
    marks = m.withColumn("a", F.explode("m.annotations"))
    name = F.col("a.name")
    out = []
    # Spring
    prefix = F.coalesce(value(named("c_ann", "RequestMapping"), *PATH_KEYS), F.lit(""))
    rest = marks.filter(name.isin(*REST_VERBS))
    out.append(_entries(rest.withColumn("t", F.explode(default(values(F.col("a"), *PATH_KEYS), F.lit("unknown")))), "rest-endpoint", F.col("t"), post="rest", prefix=prefix, verb=lookup(name, REST_VERBS)))
    listens = marks.filter(name.isin(*CONSUMERS))
    own = F.coalesce(F.try_element_at("a.args", lookup(name, {k: v[1] for k, v in CONSUMERS.items()})), F.array().cast("array<string>"))
    others = F.flatten(F.array(*[F.when(lookup(name, {n: v[1] for n, v in CONSUMERS.items()}) == k, F.array().cast("array<string>")).otherwise(F.coalesce(F.try_element_at("a.args", F.lit(k)), F.array().cast("array<string>"))) for k in CONSUMER_KEYS]))
    channels = F.when(F.size(own) > 0, own).when(F.size(others) > 0, others).when(has("m.annotations", *COMPANIONS), F.array().cast("array<string>")).otherwise(F.array(F.when(first_type != "", first_type).otherwise(F.lit("unknown"))))
    listens = listens.withColumn("t", F.explode(channels)).withColumn("kind", lookup(name, {k: v[0] for k, v in CONSUMERS.items()}))
    out.append(_entries(listens.filter("kind <> 'sqs-consumer'"), F.col("kind"), F.col("t"), message=first_type))
    out.append(_entries(listens.filter("kind = 'sqs-consumer'"), F.col("kind"), F.col("t"), post="sqs", message=first_type))
    out.append(_entries(marks.filter(name.isin(*EVENTS)), "event-listener", F.when(first_type != "", first_type).otherwise(F.lit("unknown-event")), message=first_type))
    out.append(_entries(marks.filter(name == "Scheduled"), "scheduled-task", F.coalesce(value(F.col("a"), *SCHEDULE_KEYS), F.concat(F.lit("@Scheduled:"), "m.name"))))
    out.append(_entries(marks.filter(name.isin(*WEBSOCKETS)).withColumn("t", F.explode(default(values(F.col("a"), "_raw", "value", "path"), F.lit("unknown")))), "websocket", F.col("t")))
    types = idx.scanned.select("key", "repo", "file", "simple_name", "line", "ord", F.col("annotations").alias("c_ann"), F.get(F.filter("methods", lambda x: x["name"] == "onMessage"), F.lit(0)).alias("handler"))
    rocket = types.filter(has("c_ann", "RocketMQMessageListener")).withColumn("t", F.explode(default(values(named("c_ann", "RocketMQMessageListener"), "topic", "topics", "_raw"), F.lit("unknown"))))
    out.append(_entries(rocket, "kafka-consumer", F.col("t"), line=F.coalesce("handler.line", "line"), name=F.lit("onMessage")))
    # Jakarta: a method's first matching rule counts
    verb = F.get(F.filter(F.transform("m.annotations", lambda a: a["name"]), lambda n: n.isin(*JAXRS_VERBS)), F.lit(0))
    path = F.coalesce(value(named("m.annotations", "Path"), "_raw"), F.lit(""))
    root = F.coalesce(value(named("c_ann", "Path"), *PATH_KEYS), F.lit(""))
    observed = F.get(F.filter("m.params", lambda p: F.array_contains(p["annotations"], "Observes")), F.lit(0))["type"]
    socket = F.coalesce(value(named("c_ann", "ServerEndpoint"), *PATH_KEYS), F.lit(""))
    ee = m.withColumns({"verb": verb, "observed": observed, "socket": socket})
    out.append(_entries(ee.filter("verb is not null"), "rest-endpoint", F.when(path != "", join_rest_path(root, path)).when(root != "", root).otherwise(F.lit("unknown")), verb=F.col("verb")))
    ee = ee.filter("verb is null")
    event = F.when(F.col("observed") != "", F.col("observed")).otherwise(F.lit("unknown-event"))
    out.append(_entries(ee.filter("observed is not null"), "event-listener", event, mode="plain", message=event))
    ee = ee.filter("observed is null")
    out.append(_entries(ee.filter(has("m.annotations", *TIMERS)), "scheduled-task", F.concat(F.lit("@Schedule:"), "m.name"), mode="plain"))
    out.append(_entries(ee.filter(~has("m.annotations", *TIMERS) & (F.col("socket") != "") & has("m.annotations", *SOCKET_METHODS)), "websocket", F.col("socket"), mode="plain"))
    target = F.get(F.transform(F.filter(named("c_ann", "MessageDriven")["nested"], lambda n: (n["name"] == "ActivationConfigProperty") & (F.get(F.try_element_at(n["args"], F.lit("propertyName")), F.lit(0)) == "destination")), lambda n: F.get(F.try_element_at(n["args"], F.lit("propertyValue")), F.lit(0))), F.lit(0))
    out.append(_entries(types.filter(has("c_ann", "MessageDriven")), "jms-consumer", F.coalesce(target, F.lit("unknown")), message=F.lit("javax.jms.Message"), line=F.col("line"), name=F.lit("onMessage")))
    # other contracts, again the first that matches
    is_main = (F.col("m.name") == "main") & F.col("m.static") & (F.size("m.params") == 1) & (F.col("m.returns_text") == "void") & (F.col("m.params_text").contains("String[]") | F.col("m.params_text").contains("String..."))
    boots = F.exists("m.calls", lambda c: (c["method"] == "run") & (c["receiver"].isin("SpringApplication", "SpringApplicationBuilder") | F.col("m.mentions_builder")))
    started = F.get(F.filter(F.transform("m.annotations", lambda a: a["name"]), lambda n: n.isin(*LIFECYCLE)), F.lit(0))
    contract = F.coalesce(*[F.when(F.array_contains("supertypes", k) & (F.col("m.name") == v), F.lit(k)) for k, v in LIFECYCLE_METHODS.items()])
    soap = has("c_ann", "WebService") & has("m.annotations", "WebMethod")
    graphql = F.get(F.filter("m.annotations", lambda a: a["name"].isin(*GRAPHQL)), F.lit(0))
    web = F.element_at(F.filter("c_ann", lambda a: a["name"].isin("WebServlet", "WebFilter")), -1)
    web_paths = F.when(has("c_ann", "WebServlet", "WebFilter"), values(web, "urlPatterns", "value", "_raw"))
    filters = has("c_ann", "WebFilter") & (F.col("m.name") == "doFilter")
    serves = F.coalesce(F.size(web_paths) > 0, F.lit(False)) & (filters | F.col("m.name").isin(*SERVLET_METHODS))
    service = F.get(F.filter("supertypes", lambda s: s.endswith("ImplBase")), F.lit(0))
    grpc = service.isNotNull() & (F.length(service) > 8) & has("m.annotations", "Override") & F.exists("m.params", lambda p: p["type_text"].contains("StreamObserver"))
    head = F.trim(F.substring_index("m.returns_text", "<", 1))
    bean = has("m.annotations", "Bean") & head.isin(*FUNCTIONS)
    rule = F.when(is_main, "main").when(started.isNotNull(), "started").when(contract.isNotNull(), "contract").when(soap, "soap").when(graphql.isNotNull(), "graphql").when(serves, "servlet").when(grpc, "grpc").when(bean, "function")
    x = m.withColumn("rule", rule).filter("rule is not null")
    pick = lambda r: x.filter(F.col("rule") == r)
    out.append(_entries(pick("main").filter(~boots), "main", F.lit("main"), mode="plain"))
    out.append(_entries(pick("started"), "lifecycle", F.concat(F.lit("@"), started, F.lit(":"), "m.name"), mode="plain"))
    out.append(_entries(pick("contract"), "lifecycle", F.concat(F.lit("@"), contract, F.lit(":"), "m.name"), mode="plain"))
    out.append(_entries(pick("soap"), "soap-service", F.coalesce(value(named("m.annotations", "WebMethod"), "operationName"), "m.name"), mode="plain", verb="SOAP"))
    out.append(_entries(pick("graphql"), "graphql", F.coalesce(value(graphql, "name", "value", "_raw"), "m.name"), mode="plain", message=first_type, verb=lookup(graphql["name"], GRAPHQL)))
    out.append(_entries(pick("servlet").withColumn("t", F.explode(web_paths)), "servlet", F.col("t"), verb=F.when(filters, "FILTER").otherwise(lookup(F.col("m.name"), SERVLET_METHODS))))
    plain = F.get(F.filter(F.transform("m.params", lambda p: p["type_text"]), lambda t: ~t.contains("StreamObserver")), F.lit(0))
    out.append(_entries(pick("grpc"), "grpc-service", F.concat(F.lit("/"), F.regexp_replace(service, "ImplBase$", ""), F.lit("/"), "m.name"), mode="plain", message=plain, verb="GRPC"))
    generic = F.trim(F.substring_index(F.substring_index(F.regexp_extract("m.returns_text", "<(.*)>", 1), ",", 1), "<", 1))
    out.append(_entries(pick("function"), "cloud-function", F.coalesce(value(named("m.annotations", "Bean"), "name", "value", "_raw"), "m.name"), mode="plain", message=F.when(head == "Supplier", "").otherwise(generic), verb=F.upper(head)))
    # Camel routes, reactive channels, Micronaut, Axon, in-house buses
    routes = _camel(idx).filter("c.method = 'from'")
    out.append(_entries(routes, lookup(F.col("scheme"), {k: v[0] for k, v in CAMEL_SCHEMES.items()}), F.col("t"), line=F.col("c.line")))
    incoming = marks.filter(name == "Incoming").withColumn("t", value(F.col("a"), "_raw", "value")).filter("t <> ''")
    out.append(_entries(incoming, "reactive-incoming", F.col("t"), mode="reactive", message=first_type))
    broker = F.get(F.filter(F.transform("c_ann", lambda a: lookup(a["name"], MICRONAUT)), lambda v: v.isNotNull()), F.lit(0))
    micro = marks.filter(broker.isNotNull() & name.isin(*MICRONAUT_CHANNELS) & ~F.exists("m.annotations", lambda a: a["name"] == "Incoming"))
    micro = micro.withColumn("t", F.explode(F.coalesce(F.try_element_at("a.args", lookup(name, MICRONAUT_CHANNELS)), F.array().cast("array<string>"))))
    out.append(_entries(micro, broker, F.col("t"), mode="plain", message=first_type))
    payload = F.coalesce(_payload_param(), last_seg(first_type), F.lit(""))
    out.append(_entries(marks.filter(name.isin(*AXON)), lookup(name, AXON), payload, mode="fqn", message=payload, message_mode="fqn"))
    handled = m.filter(has("c_ann", *BUS_CLASSES) & has("m.annotations", *BUS_METHODS))
    bare = lambda t: last_seg(F.when(t.contains("<") & t.contains(">"), F.regexp_extract(t, "<(.*)>", 1)).otherwise(t))
    message = F.coalesce(F.nullif(bare(F.coalesce(_payload_param(), first_type)), F.lit("")), F.lit("unknown"))
    out.append(_entries(handled, "message-handler", message, mode="fqn", message=message, message_mode="fqn"))
    return reduce(DataFrame.unionByName, out)


def _camel(idx: JavaIndex) -> DataFrame:
    """Calls of route builders whose first argument is an endpoint of a known scheme, with its channel."""
    routes = _methods(idx).filter(F.arrays_overlap("supertypes", F.array(*[F.lit(b) for b in CAMEL_BASES]))).withColumn("c", F.explode("m.calls"))
    routes = routes.filter(F.col("c.method").isin("from", *CAMEL_SENDS)).withColumn("uri", F.substring_index(F.get("c.args", F.lit(0)), "?", 1)).filter(F.contains("uri", F.lit(":")))
    scheme, rest = F.substring_index("uri", ":", 1), F.trim(F.regexp_replace("uri", "^[^:]*:", ""))
    jms = F.regexp_replace(rest, "(?i)^(temp-topic|temp-queue|queue|topic):", "")
    name = F.when(scheme == "jms", F.substring_index(jms, "/", -1)).otherwise(F.substring_index(F.regexp_replace(rest, "^.*?//", ""), "/", -1))
    return routes.withColumns({"scheme": scheme, "t": name}).filter(F.col("scheme").isin(*CAMEL_SCHEMES) & (F.col("t") != ""))


def _producers(df: DataFrame, kind: Column | str, token: Column, form: str, mode: str = "channel", post: str = "", prefix: Column | None = None, message: Column | None = None, message_mode: str = "", response: Column | None = None, line: Column | None = None, raw: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    method = F.col("m_name") if "m_name" in df.columns else F.col("m.name")
    called = F.col("method") if "method" in df.columns else F.lit("")
    return df.select(
        "key", "repo", "file", "simple_name", method.alias("method"), (line if line is not None else F.col("line")).alias("line"), "ord", lit(kind).alias("type"), F.coalesce(token, F.lit("")).alias("token"), F.lit(mode).alias("mode"),
        F.lit(post).alias("post"), (prefix if prefix is not None else F.lit("")).alias("prefix"), F.coalesce(message if message is not None else F.lit(""), F.lit("")).alias("message_type"), F.lit(message_mode).alias("message_mode"),
        F.coalesce(response if response is not None else F.lit(""), F.lit("")).alias("response_type"), F.lit(form).alias("id_form"), called.alias("called"), (F.col("receiver") if "receiver" in df.columns else F.lit("")).alias("receiver"),
        (raw if raw is not None else F.lit("")).alias("raw"),
    )


def producer_rules(idx: JavaIndex) -> DataFrame:
    """Rows (PRODUCER) of all producer rules, with channel tokens not yet resolved."""
    scanned = idx.scanned.select("key", F.col("annotations").alias("c_ann"), "supertypes")
    calls = calls_of(idx).hint("merge").join(scanned, "key").filter(~has("c_ann", *FEIGN) | (F.col("m_name") == "<init>"))
    kinds = cut(field_types(idx))
    calls = calls.hint("merge").join(kinds.select("key", F.col("name").alias("receiver"), F.col("type").alias("field")), ["key", "receiver"], "left")
    calls = calls.hint("merge").join(kinds.select("key", F.col("name").alias("root"), F.col("type").alias("root_field")), ["key", "root"], "left")
    calls = calls.hint("merge").join(kinds.select("key", F.col("name").alias("first_name"), F.col("type").alias("first_field")), ["key", "first_name"], "left")
    place = F.concat_ws("|", "type_ord", F.lpad(F.col("m_ord").cast("string"), 6, "0"), F.lpad(F.col("ord").cast("string"), 6, "0"))
    local = F.try_element_at("locals", F.col("receiver"))
    declared = F.when(F.coalesce("field", F.lit("")) != "", F.col("field")).otherwise(F.coalesce(local, F.lit("")))
    calls = calls.withColumns({"ord": place, "declared": declared, "field": F.coalesce("field", F.lit("")), "arg": F.coalesce(F.get("args", F.lit(0)), F.lit(""))})
    calls = cut(calls.drop("c_ann"))  # every rule below reads them
    sends = calls.filter("receiver <> ''")
    out = []
    created = F.nullif(F.col("first_new"), F.lit(""))
    built = F.nullif(F.col("first_root"), F.lit(""))
    # payload-routed: aggregates, gateways, in-house buses
    applied = (F.col("receiver") == "AggregateLifecycle") & (F.col("method") == "apply")
    stub = F.regexp_extract(last_seg(F.col("declared")), "^(.+?)(BlockingStub|FutureStub|Stub)$", 1)
    routed = sends_by(F.col("declared"), ROUTED)
    field_payload = F.coalesce(created, built, _payload_name(F.col("first_field")))
    out.append(_producers(sends.filter(applied).withColumn("p", field_payload).filter("p <> ''"), "message-bus-producer", F.col("p"), "apply", mode="fqn", message=F.col("p"), message_mode="fqn"))
    out.append(_producers(sends.filter(~applied & (stub != "")), "grpc-call", F.concat(F.lit("/"), stub, F.lit("/"), "method"), "grpc", mode="plain", message=last_seg(F.col("declared"))))
    out.append(_producers(sends.filter(~applied & (stub == "") & routed).withColumn("p", field_payload).filter("p <> ''"), "message-bus-producer", F.col("p"), "payload", mode="fqn", message=F.col("p"), message_mode="fqn"))
    low = F.lower(last_seg(F.col("field")))
    bus = (F.col("field") != "") & low.rlike("messagebus|eventbus|commandbus|(bus|broker|gateway|messageproducer|producer)$") & F.col("method").isin(*BUS_SENDS)
    taken = sends_by(F.col("field"), ROUTED)
    typed = F.coalesce(F.nullif(F.try_element_at("locals", F.col("first_name")), F.lit("")), param_type(F.col("first_name")), F.col("first_field"))
    facade = sends.filter(bus & ~taken).withColumn("p", F.coalesce(created, built, _payload_name(typed))).filter("p <> ''")
    out.append(_producers(facade, "message-bus-producer", F.col("p"), "payload", mode="fqn", message=F.col("p"), message_mode="fqn"))
    # templates: the channel is the first argument, unless a builder's header or a factory call names it
    kind = lookup(F.col("declared"), {k: v[0] for k, v in SENDERS.items()})
    template = sends.filter(~applied & (stub == "") & ~routed & sends_by(F.col("declared"), {k: v[1] for k, v in SENDERS.items()})).withColumn("kind", kind)
    upper = F.get(F.filter("args", lambda a: a.rlike("^\\p{Lu}")), F.lit(0))
    new_type = F.get("new_types", F.lit(0))
    publisher = F.col("declared") == "ApplicationEventPublisher"
    channel = F.when(publisher, F.coalesce(new_type, "arg")).when((F.col("kind") == "kafka-producer") & (F.size("args") == 1) & F.col("arg").rlike("^\\p{Ll}") & (F.col("topic") != ""), F.col("topic")).otherwise(F.col("arg"))
    message = F.when(publisher, F.coalesce(new_type, "arg")).otherwise(F.coalesce(new_type, last_seg(upper), F.lit("")))
    template = template.withColumns({"t": channel, "msg": message})
    made = (F.col("factory") != "") & (F.col("t") != "")
    sqs = F.col("kind") == "sqs-producer"
    out.append(_producers(template.filter(~made & ~sqs), F.col("kind"), F.col("t"), "call", message=F.col("msg")))
    out.append(_producers(template.filter(~made & sqs), F.col("kind"), F.col("t"), "call", post="sqs", message=F.col("msg")))
    out.append(_producers(template.filter(made), F.col("kind"), F.col("factory"), "call", mode="plain", message=F.col("msg")))
    # HTTP clients; constructors make no calls
    http = sends.filter("m_name <> '<init>'").filter(sends_by(F.col("field"), HTTP_CLIENTS))
    apache = F.col("field").isin("CloseableHttpClient", "DefaultCloseableHttpClient", "HttpClient") & (F.col("method") == "execute")
    given = F.get(F.filter(F.transform("args", lambda a: F.upper(a)), lambda a: a.isin(*JAXRS_VERBS)), F.lit(0))
    verb = F.when(apache, F.col("request_verb")).when(F.col("field").isin("AsyncHttpClient", "DefaultAsyncHttpClient"), lookup(F.col("method"), ASYNC_VERBS)).when(F.col("method") == "exchange", F.coalesce(given, F.lit(""))).otherwise(lookup(F.col("method"), TEMPLATE_VERBS))
    http = http.withColumns({"t": F.when(apache, F.col("request_url")).otherwise(F.col("url")), "http_verb": F.coalesce(verb, F.lit(""))}).filter("t <> ''")
    out.append(_producers(http, "http-call", F.col("t"), "http", post="origin", message=F.col("http_verb")))
    fluent = calls.filter("m_name <> '<init>'").filter(F.col("method").isin("uri", "url") & is_urlish(F.col("arg")) & (F.col("verb") != "") & (F.col("root_field").isin("WebClient", "RestClient") | (F.col("root_field") == "Builder") & F.col("built")))
    out.append(_producers(fluent, "http-call", F.col("arg"), "http", post="origin", message=F.col("verb")))
    # declared clients, brokered results, routes, reactive channels
    methods = _methods(idx)
    marks = methods.withColumn("a", F.explode("m.annotations"))
    feign = marks.filter(has("c_ann", *FEIGN) & (F.col("m.name") != "<init>") & F.col("a.name").isin(*REST_VERBS, *EXCHANGE_VERBS) & (F.col("a.name") != "RequestMapping"))
    base = F.coalesce(value(F.get(F.filter("c_ann", lambda a: a["name"].isin(*FEIGN)), F.lit(0)), "url", "value"), F.lit(""))
    feign = feign.withColumn("t", F.explode(default(values(F.col("a"), *PATH_KEYS), F.lit("unknown"))))
    out.append(_producers(feign, "http-call", base, "declared", post="feign", prefix=F.col("t"), message=lookup(F.col("a.name"), REST_VERBS | EXCHANGE_VERBS), response=F.col("m.returns_text"), line=F.col("m.line"), raw=F.col("t")))
    servers = marks.filter(~has("c_ann", *FEIGN) & (F.col("m.name") != "<init>"))
    brokered = servers.filter(F.col("a.name").isin("SendTo", "SendToUser")).withColumn("t", F.explode(default(values(F.col("a"), "_raw"), F.lit("unknown"))))
    out.append(_producers(brokered, "unknown", F.col("t"), "sendTo", message=F.col("m.returns_text"), line=F.col("m.line")))
    outgoing = servers.filter(F.col("a.name") == "Outgoing").withColumn("t", value(F.col("a"), "_raw", "value")).filter("t <> ''")
    out.append(_producers(outgoing, "unknown", F.col("t"), "outgoing", mode="reactive", message=F.col("m.returns_text"), line=F.col("m.line")))
    camel = _camel(idx).filter("c.method <> 'from'")
    out.append(_producers(camel.withColumn("method", F.col("c.method")), lookup(F.col("scheme"), {k: v[1] for k, v in CAMEL_SCHEMES.items()}), F.col("t"), "route", line=F.col("c.line")))
    emitters = idx.fields.filter("channel <> ''").groupBy("key", F.col("name").alias("receiver")).agg(F.max_by("channel", "f_ord").alias("t"))
    out.append(_producers(sends.filter(F.col("method").isin(*EMITTER_SENDS)).hint("merge").join(emitters, ["key", "receiver"]), "unknown", F.col("t"), "emitter", mode="reactive"))
    return reduce(DataFrame.unionByName, out)


def _payload_name(declared: Column) -> Column:
    """A declared type that can be a message: no transport, primitive, inferred, generic or one-letter type."""
    simple = last_seg(declared)
    return F.when(declared.isNotNull() & ~declared.isin(*NO_PAYLOADS) & simple.rlike("^\\p{Lu}") & (F.length(simple) > 1) & ~simple.contains("<"), simple)


def resolve_tokens(rows: DataFrame, idx: JavaIndex, config: DataFrame) -> DataFrame:
    """rows with channel, and message_type resolved where it is a type's name."""
    rows = cut(rows)
    channels = resolve_channel(rows.filter("mode = 'channel'").select("token"), idx.constants, config).withColumn("mode", F.lit("channel"))
    reactive = resolve_reactive_channel(rows.filter("mode = 'reactive'").select("token"), config).withColumn("mode", F.lit("reactive"))
    names = resolve_fqn(idx, rows.filter("mode = 'fqn'").select("key", F.col("token").alias("simple"))).select("key", F.col("simple").alias("token"), F.col("fqn").alias("_fqn"))
    out = rows.hint("merge").join(channels.unionByName(reactive).withColumnRenamed("channel", "_channel"), ["mode", "token"], "left").hint("merge").join(names.withColumn("mode", F.lit("fqn")), ["mode", "key", "token"], "left")
    found = F.coalesce("_fqn", "_channel", "token")
    rest = F.when(F.col("prefix") != "", join_rest_path(F.col("prefix"), found)).otherwise(found)
    feign = strip_http_origin(F.when(F.coalesce(F.col("token"), F.lit("")) != "", join_rest_path(found, F.col("prefix"))).otherwise(F.col("prefix")))
    channel = F.when(F.col("post") == "rest", rest).when(F.col("post") == "sqs", sqs_queue_name(found)).when(F.col("post") == "origin", strip_http_origin(found)).when(F.col("post") == "feign", F.when(feign == "", F.lit("/")).otherwise(feign)).otherwise(found)
    return out.withColumns({"channel": channel, "message_type": F.when(F.col("message_mode") == "fqn", found).otherwise(F.col("message_type"))}).drop("_fqn", "_channel")


def detect_entry_points(idx: JavaIndex, config: DataFrame) -> DataFrame:
    """Entry points: id, repo, type, channel, class_name, method, file, line, message_type, method_type, ord, key."""
    rows = resolve_tokens(entry_rules(idx), idx, config)
    channel = F.when(F.coalesce("channel", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("channel"))
    owner = F.concat_ws(".", "simple_name", "method")
    made = F.concat(F.col("repo"), F.lit(":"), owner, F.when(channel == "unknown", F.lit("")).otherwise(F.concat(F.lit(":"), channel)))
    return rows.select("ord", made.alias("id"), "repo", "type", channel.alias("channel"), F.col("simple_name").alias("class_name"), "method", "file", "line", "message_type", "method_type", "key")


def detect_producers(idx: JavaIndex, config: DataFrame) -> DataFrame:
    """Producers: id, repo, type, channel, method, file, line, message_type, response_type, ord."""
    rows = resolve_tokens(producer_rules(idx), idx, config).filter("not (id_form = 'http' and channel in ('', 'unknown'))")
    form, channel = F.col("id_form"), F.col("channel")
    tail = (
        F.when(form == "call", F.concat_ws(":", "called", "receiver")).when(form == "payload", F.concat_ws(":", "called", "receiver", channel)).when(form == "apply", F.concat_ws(":", F.lit("apply"), channel))
        .when(form == "grpc", F.concat(F.lit("grpc:"), F.regexp_replace(channel, "^/", ""))).when(form == "http", F.concat(F.lit("http:"), channel)).when(form == "declared", F.concat(F.lit("http:"), "raw"))
        .when(form == "route", F.concat_ws(":", "called", channel)).otherwise(F.concat_ws(":", "id_form", channel))
    )
    owner = F.concat_ws(".", "simple_name", "method")
    filled = F.when(F.coalesce(channel, F.lit("")) == "", F.lit("unknown")).otherwise(channel)
    return rows.select("ord", F.concat(F.col("repo"), F.lit(":"), owner, F.lit(":"), tail).alias("id"), "repo", "type", filled.alias("channel"), owner.alias("method"), "file", "line", "message_type", "response_type")
