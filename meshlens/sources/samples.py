"""Java sources of our own that the extraction queries and tests read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHOP = {
    ("order", "src/OrderController.java"): """
package com.acme.order;
import com.acme.msg.*;
@RestController @RequestMapping("/api/orders")
public class OrderController {
  private OrderService service;
  private static final String TOPIC = "order-events";
  @GetMapping("/{id}") public Order get(String id) { return service.find(id, 1); }
  @PostMapping public void create(OrderDto d) { service.place(d); }
  @KafkaListener(topics = "${app.topic}") public void on(OrderEvent e) { }
  @Scheduled(cron = "0 0 * * * *") public void sweep() { service.place(null); }
  public String getName() { return "x"; }
}
""",
    ("order", "src/OrderService.java"): """
package com.acme.order;
public interface OrderService { void place(OrderDto d); Order find(String id, int n); }
class OrderServiceImpl extends Base implements OrderService {
  private KafkaTemplate<String,Object> kafka; private RestTemplate rest; private WebClient wc; private JmsTemplate jms; private StockServiceGrpc.StockServiceBlockingStub stock;
  public void place(OrderDto d) {
    validate(d); kafka.send(Topics.OUT, new OrderPlaced(d)); rest.getForObject("http://stock/api/stock/12", X.class);
    jms.send(ctx.createQueue("legacy"), d); stock.reserve(d); audit(d, 2);
  }
  public Order find(String id, int n) { wc.get().uri("/api/stock/{id}", id).retrieve(); return null; }
  void validate(OrderDto d) { d.check("x"); }
  void dead(int x) { validate(null); }
}
class Base { void audit(OrderDto d, int level) { } }
class Topics { static final String OUT = "orders.out"; }
class Boot { public static void main(String[] args) { SpringApplication.run(Boot.class, args); } }
class Tool { public static void main(String[] args) { new Tool().work(args[0]); } void work(String s) { } }
""",
    ("stock", "src/Stock.java"): """
package com.acme.stock;
@RestController public class StockController { @GetMapping("/api/stock/{id}") public int stock(String id) { return repo.load(id); } Repo repo; }
class Repo { int load(String id) { return 1; } }
class Listener { @KafkaListener(topics={"orders.out"}) void on(OrderPlaced p) { bus.publish(new Shipped(p)); } EventBus bus; }
@MessageHandler class Handler { @Handle void handle(Shipped s) { } }
class StockService extends StockServiceImplBase { @Override public void reserve(OrderDto d, StreamObserver<Ok> out) { out.onNext(null); } }
class Routes extends RouteBuilder { public void configure() { from("kafka:shipments?brokers=x").to("jms:queue:ship/done"); } }
class Quarkus { @Incoming("in") @Outgoing("out") public Done run(Job j) { return null; } @Channel("emits") Emitter<Job> emitter; void go(Job j) { emitter.send(j); } }
""",
    ("order", "src/test/OrderControllerTest.java"): "class OrderControllerTest { @KafkaListener(topics=\"no\") void no() { } }",
}
CONFIG = {("order", "application.properties"): "# topics\napp.topic=order-in\n", ("stock", "application.yml"): "mp:\n  messaging:\n    incoming:\n      in:\n        topic: jobs\n    list:\n      - a: b\n"}


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*k, v) for k, v in SHOP.items()], "repo string, path string, content string")


def config_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*k, v) for k, v in CONFIG.items()], "repo string, path string, content string")


# ---------------------------------------------------------------- what the sources above say, written down by hand


#: repo, file, fqn, kind, line (of the first modifier), supertypes, n_methods.
TYPES = (
    ("order", "src/OrderController.java", "com.acme.order.OrderController", "class", 4, "", 5),
    ("order", "src/OrderService.java", "com.acme.order.OrderService", "interface", 3, "", 2),
    ("order", "src/OrderService.java", "com.acme.order.OrderServiceImpl", "class", 4, "Base,OrderService", 4),
    ("order", "src/OrderService.java", "com.acme.order.Base", "class", 14, "", 1),
    ("order", "src/OrderService.java", "com.acme.order.Topics", "class", 15, "", 0),
    ("order", "src/OrderService.java", "com.acme.order.Boot", "class", 16, "", 1),
    ("order", "src/OrderService.java", "com.acme.order.Tool", "class", 17, "", 2),
    ("stock", "src/Stock.java", "com.acme.stock.StockController", "class", 3, "", 1),
    ("stock", "src/Stock.java", "com.acme.stock.Repo", "class", 4, "", 1),
    ("stock", "src/Stock.java", "com.acme.stock.Listener", "class", 5, "", 1),
    ("stock", "src/Stock.java", "com.acme.stock.Handler", "class", 6, "", 1),
    ("stock", "src/Stock.java", "com.acme.stock.StockService", "class", 7, "StockServiceImplBase", 1),
    ("stock", "src/Stock.java", "com.acme.stock.Routes", "class", 8, "RouteBuilder", 1),
    ("stock", "src/Stock.java", "com.acme.stock.Quarkus", "class", 9, "", 2),
)
#: repo, file, Class.method, line, parameters of a named type, whether it has a body.
METHODS = (
    ("order", "src/OrderController.java", "OrderController.get", 8, 1, True), ("order", "src/OrderController.java", "OrderController.create", 9, 1, True), ("order", "src/OrderController.java", "OrderController.on", 10, 1, True),
    ("order", "src/OrderController.java", "OrderController.sweep", 11, 0, True), ("order", "src/OrderController.java", "OrderController.getName", 12, 0, True),
    ("order", "src/OrderService.java", "OrderService.place", 3, 1, False), ("order", "src/OrderService.java", "OrderService.find", 3, 2, False),
    ("order", "src/OrderService.java", "OrderServiceImpl.place", 6, 1, True), ("order", "src/OrderService.java", "OrderServiceImpl.find", 10, 2, True), ("order", "src/OrderService.java", "OrderServiceImpl.validate", 11, 1, True),
    ("order", "src/OrderService.java", "OrderServiceImpl.dead", 12, 1, True), ("order", "src/OrderService.java", "Base.audit", 14, 2, True), ("order", "src/OrderService.java", "Boot.main", 16, 0, True),
    ("order", "src/OrderService.java", "Tool.main", 17, 0, True), ("order", "src/OrderService.java", "Tool.work", 17, 1, True),
    ("stock", "src/Stock.java", "StockController.stock", 3, 1, True), ("stock", "src/Stock.java", "Repo.load", 4, 1, True), ("stock", "src/Stock.java", "Listener.on", 5, 1, True), ("stock", "src/Stock.java", "Handler.handle", 6, 1, True),
    ("stock", "src/Stock.java", "StockService.reserve", 7, 2, True), ("stock", "src/Stock.java", "Routes.configure", 8, 0, True), ("stock", "src/Stock.java", "Quarkus.run", 9, 1, True), ("stock", "src/Stock.java", "Quarkus.go", 9, 1, True),
)
#: Caller, place in its body (outer calls first), call as written, arguments that count, Class.method that it means or None.
CALLS = (
    ("OrderController.get", 0, "service.find", 2, "OrderServiceImpl.find"), ("OrderController.create", 0, "service.place", 1, "OrderServiceImpl.place"), ("OrderController.sweep", 0, "service.place", 0, "OrderServiceImpl.place"),
    ("OrderServiceImpl.place", 0, "validate", 1, "OrderServiceImpl.validate"), ("OrderServiceImpl.place", 1, "kafka.send", 1, None), ("OrderServiceImpl.place", 2, "rest.getForObject", 1, None),
    ("OrderServiceImpl.place", 3, "jms.send", 2, None), ("OrderServiceImpl.place", 4, "ctx.createQueue", 1, None), ("OrderServiceImpl.place", 5, "stock.reserve", 1, None), ("OrderServiceImpl.place", 6, "audit", 2, "Base.audit"),
    ("OrderServiceImpl.find", 0, "retrieve", 0, None), ("OrderServiceImpl.find", 1, "uri", 2, None), ("OrderServiceImpl.find", 2, "wc.get", 0, None),
    ("OrderServiceImpl.validate", 0, "d.check", 1, None), ("OrderServiceImpl.dead", 0, "validate", 0, "OrderServiceImpl.validate"),
    ("Boot.main", 0, "SpringApplication.run", 1, None), ("Tool.main", 0, "work", 0, "Tool.work"),
    ("StockController.stock", 0, "repo.load", 1, "Repo.load"), ("Listener.on", 0, "bus.publish", 0, None), ("StockService.reserve", 0, "out.onNext", 0, None),
    ("Routes.configure", 0, "to", 1, None), ("Routes.configure", 1, "from", 1, None), ("Quarkus.go", 0, "emitter.send", 1, None),
)
#: repo, Class.method that no entry point reaches.
UNREACHABLE = (("order", "OrderServiceImpl.dead"), ("order", "Boot.main"), ("stock", "Quarkus.go"))
#: id, type, channel, line, message_type, method_type.
ENTRIES = (
    ("order:OrderController.get:/api/orders/{id}", "rest-endpoint", "/api/orders/{id}", 8, "", "GET"), ("order:OrderController.create:/api/orders", "rest-endpoint", "/api/orders", 9, "", "POST"),
    ("order:OrderController.on:order-in", "kafka-consumer", "order-in", 10, "OrderEvent", ""), ("order:OrderController.sweep:0 0 * * * *", "scheduled-task", "0 0 * * * *", 11, "", ""), ("order:Tool.main:main", "main", "main", 17, "", ""),
    ("stock:StockController.stock:/api/stock/{id}", "rest-endpoint", "/api/stock/{id}", 3, "", "GET"), ("stock:Listener.on:orders.out", "kafka-consumer", "orders.out", 5, "OrderPlaced", ""),
    ("stock:Handler.handle:com.acme.stock.Shipped", "message-handler", "com.acme.stock.Shipped", 6, "com.acme.stock.Shipped", ""), ("stock:StockService.reserve:/StockService/reserve", "grpc-service", "/StockService/reserve", 7, "OrderDto", "GRPC"),
    ("stock:Routes.configure:shipments", "kafka-consumer", "shipments", 8, "", ""), ("stock:Quarkus.run:jobs", "reactive-incoming", "jobs", 9, "Job", ""),
)
#: id, type, channel, line, message_type, response_type.
PRODUCERS = (
    ("order:OrderServiceImpl.place:send:kafka", "kafka-producer", "orders.out", 7, "OrderPlaced", ""), ("order:OrderServiceImpl.place:http:/api/stock/12", "http-call", "/api/stock/12", 7, "GET", ""),
    ("order:OrderServiceImpl.place:send:jms", "jms-producer", "legacy", 8, "", ""), ("order:OrderServiceImpl.place:grpc:StockService/reserve", "grpc-call", "/StockService/reserve", 8, "StockServiceBlockingStub", ""),
    ("order:OrderServiceImpl.find:http:/api/stock/{id}", "http-call", "/api/stock/{id}", 10, "GET", ""), ("stock:Listener.on:publish:bus:com.acme.stock.Shipped", "message-bus-producer", "com.acme.stock.Shipped", 5, "com.acme.stock.Shipped", ""),
    ("stock:Routes.configure:to:done", "jms-producer", "done", 8, "", ""), ("stock:Quarkus.run:outgoing:out", "unknown", "out", 9, "Done", ""), ("stock:Quarkus.go:emitter:emits", "unknown", "emits", 9, "", ""),
)


def method_rows() -> list[tuple]:
    """repo, method_key, n_params, has_body."""
    return [(repo, f"{name}@{file}:{line}", n, body) for repo, file, name, line, n, body in METHODS]


def call_rows() -> list[tuple]:
    """caller, ord, display, arity, callee, callee_class, callee_file, callee_line, ambiguous."""
    place = {name: (file, line) for _, file, name, line, *_ in METHODS}
    key = lambda name: f"{name}@{place[name][0]}:{place[name][1]}"
    return [(key(caller), k, display, arity, *((key(to), to.split(".")[0], *place[to]) if to else (None,) * 4), False) for caller, k, display, arity, to in CALLS]


def unreachable_rows() -> list[tuple]:
    """id, repo, class_name, method, file, line."""
    place = {(repo, name): (file, line) for repo, file, name, line, *_ in METHODS}
    return [(f"{repo}:{name}", repo, *name.split("."), *place[repo, name]) for repo, name in UNREACHABLE]
