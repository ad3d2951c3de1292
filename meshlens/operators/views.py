"""Analytics of whole graphs for display: flows, edges between repositories, channel cards, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LINKED_CONSUMERS, title_case
from ..plans.fixpoint import cut
from ..plans.relations import GraphRelations
from .cycles import repo_edges
from .tools import find_orphans, sorted_set

#: What an origin's type is called, as tag and noun.
ORIGINS = {
    "scheduled-task": ("SCHEDULED", "scheduled job"), "event-listener": ("EVENT", "event listener"), "websocket": ("WEBSOCKET", "websocket"),
    "kafka-consumer": ("KAFKA", "Kafka topic"), "rabbitmq-consumer": ("RABBITMQ", "RabbitMQ queue"), "jms-consumer": ("JMS", "JMS queue"),
    "sqs-consumer": ("SQS", "SQS queue"), "pulsar-consumer": ("PULSAR", "Pulsar topic"), "mqtt-consumer": ("MQTT", "MQTT topic"),
    "main": ("MAIN", "application bootstrap"), "lifecycle": ("LIFECYCLE", "lifecycle hook"), "servlet": ("SERVLET", "servlet endpoint"),
    "soap-service": ("SOAP", "SOAP operation"), "graphql": ("GRAPHQL", "GraphQL resolver"), "grpc-service": ("GRPC", "gRPC service method"),
    "cloud-function": ("FUNCTION", "cloud function"), "message-handler": ("BUS", "message bus handler"), "reactive-incoming": ("REACTIVE", "reactive messaging channel"),
}
#: Types that the channel cards count as consumers and as message producers.
CARD_PRODUCERS = (
    "rabbitmq-producer", "kafka-producer", "jms-producer", "event-publisher", "pulsar-producer", "nats-producer", "sqs-producer", "sns-producer", "message-bus-producer",
)
SYNC_KINDS = ("http", "grpc")


# ---------------------------------------------------------------- flows


def reached_methods(graph: GraphRelations) -> DataFrame:
    """(ep_id, name): the entry's own Class.method and, for each node of its tree, its method as called and as Class.method."""
    own = graph.entry_points.select(F.col("id").alias("ep_id"), F.concat_ws(".", F.nullif("class_name", F.lit("")), F.nullif("method", F.lit(""))).alias("name"))
    called = graph.nodes.select("ep_id", F.col("method").alias("name"))
    typed = graph.nodes.filter("class_name <> '' and method <> ''").select("ep_id", F.concat("class_name", F.lit("."), F.substring_index("method", ".", -1)).alias("name"))
    return own.union(called).union(typed).filter("name <> ''").distinct()


def publishes(graph: GraphRelations) -> DataFrame:
    """(id, repo, channel, sync, verb, response_type): what entry points send through the linked producers their trees reach.

    A producer is reached if the Class.method in its id is; entry and producer are of one repository.
    """
    sent = graph.members.filter("side = 'producer'").select(
        "channel", F.col("kind").isin(*SYNC_KINDS).alias("sync"), F.when(F.col("kind").isin(*SYNC_KINDS), F.col("verb")).otherwise("").alias("verb"),
        F.substring_index("id", ":", 1).alias("repo"), F.coalesce(F.get(F.split("id", ":"), F.lit(1)), F.lit("")).alias("name"), F.col("id").alias("producer"), "ord",
    )
    answers = graph.producers.groupBy(F.col("id").alias("producer")).agg(F.min_by("response_type", "ord").alias("response_type"))
    first = sent.filter("sync").groupBy("repo", "channel").agg(F.min_by(F.struct("verb", "producer"), "ord").alias("f")).select("repo", "channel", "f.*").join(answers, "producer", "left").drop("producer")
    entries = graph.entry_points.select(F.col("id").alias("ep_id"), "repo").distinct()
    reached = reached_methods(graph).join(entries, "ep_id").join(sent.select("repo", "name", "channel", "sync").distinct(), ["repo", "name"])
    out = reached.select(F.col("ep_id").alias("id"), "repo", "channel", "sync").distinct().join(first, ["repo", "channel"], "left")
    return out.select("id", "repo", "channel", "sync", F.when(F.col("sync"), F.coalesce("verb", F.lit(""))).otherwise("").alias("verb"), F.when(F.col("sync"), F.coalesce("response_type", F.lit(""))).otherwise("").alias("response_type"))


def flow_hops(sent: DataFrame, entry_points: DataFrame) -> DataFrame:
    """(src, dst, src_repo, dst_repo, channel, kind, verb, response_type): from a sending entry to consumers in other repositories.

    Messages go to entries of the same channel, calls to REST and gRPC endpoints of literally the same path.
    """
    served = F.col("type").isin("rest-endpoint", "grpc-service")
    heard = entry_points.filter("channel <> ''").select(F.col("id").alias("dst"), F.col("repo").alias("dst_repo"), "channel", served.alias("sync")).distinct()
    met = sent.select(F.col("id").alias("src"), F.col("repo").alias("src_repo"), "channel", "sync", "verb", "response_type").join(heard, ["channel", "sync"])
    kind = F.when(F.col("sync"), F.lit("http")).otherwise(F.lit("message")).alias("kind")
    return met.filter(F.col("src_repo") != F.col("dst_repo")).select("src", "dst", "src_repo", "dst_repo", "channel", kind, "verb", "response_type").distinct()


def flow_origins(entry_points: DataFrame, members: DataFrame) -> DataFrame:
    """Entry points where flows begin: REST endpoints, and entries whose channel no link has; with tag, noun, name, label and channel."""
    inner = members.select("channel").distinct()
    rest = entry_points.filter("type = 'rest-endpoint'").withColumn("is_rest", F.lit(True))
    outer = entry_points.filter("type <> 'rest-endpoint'").join(inner, "channel", "left_anti").withColumn("is_rest", F.lit(False))
    both = rest.unionByName(outer)

    def meta(part: int, other: str) -> Column:
        out = F.lit(other)
        for kind, names in ORIGINS.items():
            out = F.when(F.col("type") == kind, F.lit(names[part])).otherwise(out)
        return out

    method = F.when(F.col("method") != "", F.col("method")).otherwise(F.substring_index("id", ":", -1))
    channel = F.col("channel")
    cron = channel.rlike("\\s") & (F.size(F.split(channel, "\\s+")) >= 5)
    timer = F.when(cron, F.concat(F.lit("cron "), channel)).when(channel.rlike("^[0-9]+$"), F.concat(F.lit("every "), channel, F.lit(" ms")))
    timer = timer.when(channel.startswith("@Schedule"), F.lit("EJB timer")).when(channel == "", F.lit("scheduled")).otherwise(channel)
    scheduled = ~F.col("is_rest") & (F.col("type") == "scheduled-task")
    verb = F.when(F.coalesce("method_type", F.lit("")) != "", F.col("method_type")).otherwise("POST")
    label = F.when(F.col("is_rest"), F.concat(verb, F.lit(" "), channel)).when(scheduled, timer).otherwise(channel)
    named = F.when(channel != "", channel).when(F.col("method") != "", F.col("method")).otherwise("External Event")
    return both.select(
        F.concat(F.lit("flow:"), "id").alias("flow_id"), "id", "repo", F.when(F.col("is_rest"), "rest").otherwise("external").alias("origin_type"),
        F.when(F.col("is_rest"), "REST").otherwise(meta(0, "EXTERNAL")).alias("tag"), F.when(F.col("is_rest"), "REST endpoint").otherwise(meta(1, "external event")).alias("noun"),
        F.when(F.col("is_rest") | scheduled, title_case(method)).otherwise(named).alias("name"), label.alias("label"), channel,
    ).dropDuplicates(["id"])


def detect_flows(origins: DataFrame, hops: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(flow_id, path, depth, entry_id, repo, via_channel, kind, verb, response_type): every step of every flow.

    A step's path has the entry ids from the origin on; no entry comes twice on a branch, which ends
    the recursion.  The number of steps is the number of such branches; max_hops bounds their length.
    """
    hops = cut(hops)  # every round reads them
    level = cut(origins.select("flow_id", F.array("id").alias("path"), F.lit(0).alias("depth"), F.col("id").alias("entry_id"), "repo", F.lit("").alias("via_channel"), F.lit("").alias("kind"), F.lit("").alias("verb"), F.lit("").alias("response_type")))
    out, k = level, 0
    while (max_hops is None or k < max_hops) and not level.isEmpty():
        k += 1
        below = level.select("flow_id", "path", F.col("entry_id").alias("src")).join(hops, "src").filter(~F.array_contains("path", F.col("dst")))
        level = cut(below.select("flow_id", F.array_append("path", F.col("dst")).alias("path"), F.lit(k).alias("depth"), F.col("dst").alias("entry_id"), F.col("dst_repo").alias("repo"), F.col("channel").alias("via_channel"), "kind", "verb", "response_type"))
        out = out.unionByName(level)
    return out


def flow_metrics(steps: DataFrame) -> DataFrame:
    """flow_id, repos, repo_count, hop_count, has_cross_repo, has_sync."""
    return steps.groupBy("flow_id").agg(
        sorted_set(F.col("repo")).alias("repos"), F.countDistinct("repo").alias("repo_count"), F.max("depth").alias("hop_count"),
        (F.countDistinct("repo") > 1).alias("has_cross_repo"), F.max(F.col("kind").isin(*SYNC_KINDS)).alias("has_sync"),
    )


def flow_search(origins: DataFrame, metrics: DataFrame, text: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Flows without hidden tags, of which the name, the label, the tag, the channel or a repository holds the text, whatever its case; a blank text is held by all."""
    rows = origins.join(metrics, "flow_id").filter(~F.col("tag").isin(*hidden)) if hidden else origins.join(metrics, "flow_id")
    wanted = text.strip().lower()
    if not wanted:
        return rows
    holds = lambda c: F.contains(F.lower(c), F.lit(wanted))
    found = F.exists(F.split("repos", ","), holds)
    for field in ("name", "label", "tag", "channel"):
        found = found | F.coalesce(holds(F.col(field)), F.lit(False))
    return rows.filter(found)


def flow_repo_nodes(steps: DataFrame) -> DataFrame:
    """flow_id, repo, its least depth and how many steps it has."""
    return steps.groupBy("flow_id", "repo").agg(F.min("depth").alias("depth"), F.count("*").alias("n_steps"))


def flow_trace_repo(steps: DataFrame, repo: str) -> DataFrame:
    """How flows enter a repository: flow_id, entry_id, depth, via, from (the step before)."""
    parent = steps.select("flow_id", F.col("path").alias("_up"), F.col("repo").alias("from_repo"))
    mine = steps.filter(F.col("repo") == repo).withColumn("_up", F.when(F.col("depth") > 0, F.slice("path", 1, F.size("path") - 1)))
    via = F.when((F.col("kind") == "http") & (F.col("verb") != ""), F.concat_ws(" ", "verb", "via_channel")).otherwise(F.col("via_channel"))
    return mine.join(parent, ["flow_id", "_up"], "left").select("flow_id", "entry_id", "depth", via.alias("via"), "from_repo")


def flows_for_unit(steps: DataFrame, entry_points: DataFrame, sent: DataFrame, reached: DataFrame, repo: str, channel: str, method: str, side: str) -> DataFrame:
    """flow_id of flows that pass a channel card's method: in through it, or out of an entry that reaches it and sends there."""
    mine = steps.filter(F.col("repo") == repo).select("flow_id", F.col("entry_id").alias("id")).distinct()
    if side == "in":
        unit = entry_points.filter((F.col("channel") == channel) & (F.col("method") == method)).select("id")
    else:
        unit = sent.filter(F.col("channel") == channel).select("id").join(reached.filter(F.col("name") == method).select(F.col("ep_id").alias("id")), "id", "left_semi")
    return mine.join(unit.distinct(), "id", "left_semi").select("flow_id").distinct()


# ---------------------------------------------------------------- repositories and channels


def edge_items(members: DataFrame) -> DataFrame:
    """src, dst, channel, kind, verb: one row for each channel between two repositories, of its first link."""
    members = cut(members)
    order = members.groupBy("channel", "kind", "verb").agg(F.min("ord").alias("ord"))
    rows = repo_edges(members).join(order, ["channel", "kind", "verb"])
    return rows.groupBy("src", "dst", "channel").agg(F.min(F.struct("ord", "kind", "verb")).alias("f")).select("src", "dst", "channel", "f.kind", "f.verb")


def edge_labels(members: DataFrame) -> DataFrame:
    """src, dst, n_items, label: a lone channel by name (with verb or gRPC), several by their counts."""
    n = lambda cond: F.count(F.when(cond, 1))
    kind = F.col("kind")
    sums = edge_items(members).groupBy("src", "dst").agg(
        F.count("*").alias("n_items"), n(~kind.isin(*SYNC_KINDS)).alias("m"), n(kind == "http").alias("h"), n(kind == "grpc").alias("g"), F.min("channel").alias("c"), F.min("kind").alias("k"), F.min("verb").alias("v"),
    )
    lone = F.when(F.col("k") == "grpc", F.concat(F.lit("gRPC "), "c")).when((F.col("k") == "http") & (F.col("v") != ""), F.concat_ws(" ", "v", "c")).otherwise(F.col("c"))
    part = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), text))
    several = F.concat_ws(" · ", part("m", F.when(F.col("m") > 1, " msgs").otherwise(" msg")), part("h", F.lit(" HTTP")), part("g", F.lit(" gRPC")))
    return sums.select("src", "dst", "n_items", F.when(F.col("n_items") == 1, lone).otherwise(several).alias("label"))


def orphans_by_repo(graph: GraphRelations) -> DataFrame:
    """repo, side, number of distinct orphan channels."""
    return find_orphans(graph).groupBy("repo", "side").agg(F.countDistinct("channel").alias("channels"))


def gap_count(graph: GraphRelations) -> DataFrame:
    return find_orphans(graph).agg(F.countDistinct("repo").alias("gap_count"))


def types_by_repo(entry_points: DataFrame) -> DataFrame:
    return entry_points.groupBy("repo").agg(F.count("*").alias("n"), sorted_set(F.col("type")).alias("types"))


def channel_cards(graph: GraphRelations) -> DataFrame:
    """repo, kind (msg or http), channel, direction, n_in, n_out (distinct methods with their types), in_peers, out_peers, rank.

    Peers are the repositories on the other side of the channel's links.  rank orders a repository's
    cards: messages in, both, out, then calls, each by channel.
    """
    heard = graph.entry_points.filter(F.col("type").isin(*LINKED_CONSUMERS) & (F.col("channel") != ""))
    heard = heard.select("repo", F.lit("msg").alias("kind"), "channel", F.lit("in").alias("side"), F.concat_ws("|", "method", "message_type").alias("m"))
    made = graph.producers.filter("channel <> ''").withColumn("_call", F.col("type").isin("http-call", "grpc-call")).filter(F.col("_call") | F.col("type").isin(*CARD_PRODUCERS))
    made = made.select("repo", F.when(F.col("_call"), "http").otherwise("msg").alias("kind"), "channel", F.lit("out").alias("side"), F.concat_ws("|", "method", F.when(F.col("_call"), F.col("response_type")).otherwise(F.col("message_type"))).alias("m"))
    n = lambda side: F.countDistinct(F.when(F.col("side") == side, F.col("m")))
    cards = heard.unionByName(made).groupBy("repo", "kind", "channel").agg(n("in").alias("n_in"), n("out").alias("n_out"))
    sides = graph.members.select("channel", "side", F.substring_index("id", ":", 1).alias("peer")).filter("peer <> ''").distinct()
    peers = cards.select("repo", "channel").distinct().join(sides, "channel").filter(F.col("peer") != F.col("repo"))
    peers = peers.groupBy("repo", "channel").agg(sorted_set(F.when(F.col("side") == "producer", F.col("peer"))).alias("up"), sorted_set(F.when(F.col("side") == "consumer", F.col("peer"))).alias("down"))
    both = cards.join(peers, ["repo", "channel"], "left")
    direction = F.when((F.col("n_in") > 0) & (F.col("n_out") > 0), "both").when(F.col("n_in") == 0, "out").otherwise("in")
    rank = F.concat(F.when(F.col("kind") == "http", "1").otherwise("0"), F.when(direction == "in", "0").when(direction == "both", "1").otherwise("2"), F.lit(" "), "channel")
    return both.select(
        "repo", "kind", "channel", direction.alias("direction"), "n_in", "n_out", F.when(F.col("n_in") > 0, F.coalesce("up", F.lit(""))).otherwise("").alias("in_peers"),
        F.when(F.col("n_out") > 0, F.coalesce("down", F.lit(""))).otherwise("").alias("out_peers"), rank.alias("rank"),
    )


def outbound_channels(graph: GraphRelations) -> DataFrame:
    """id, channel, n_consumer_repos: channels of the same repository's producers in a method of the entry's name.

    A producer's method equals the entry's, is Class.method, or ends with .method: an equi-join on
    every tail of the producer's method that begins at a segment, so that a common last segment joins nothing.
    """
    name = F.when(F.col("method") != "", F.col("method")).otherwise(F.substring_index("id", ":", -1))
    mine = graph.entry_points.select("id", "repo", name.alias("_tail")).distinct()
    parts = F.split("method", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    made = graph.producers.select("repo", "channel", F.explode(tails).alias("_tail")).distinct()
    met = mine.join(made, ["repo", "_tail"])
    first = graph.members.groupBy("channel").agg(F.min(F.struct("ord", "kind", "verb")).alias("f")).select("channel", "f.kind", "f.verb")
    heard = graph.members.filter("side = 'consumer'").join(first, ["channel", "kind", "verb"]).groupBy("channel").agg(F.countDistinct(F.substring_index("id", ":", 1)).alias("n"))
    return met.select("id", "channel").distinct().join(heard, "channel", "left").select("id", "channel", F.coalesce("n", F.lit(0)).alias("n_consumer_repos"))


# ---------------------------------------------------------------- context of nodes and entries


#: Parts of a call's name that count as sending.
SENDING = ("convertAndSend", "send", "publishEvent")


def producing_nodes(graph: GraphRelations) -> DataFrame:
    """ep_id, path, name of tree nodes that send: their name is a producer's method, or they call something that sends."""
    from .tree import display_name

    named = graph.nodes.select("ep_id", "path", "method", display_name().alias("name"))
    known = graph.producers.select(F.col("method").alias("name")).distinct().withColumn("_known", F.lit(True))
    sends = F.lit(False)
    for text in SENDING:
        sends = sends | F.contains("method", F.lit(text))
    return named.join(known, "name", "left").filter(F.col("_known").isNotNull() | sends).select("ep_id", "path", "name")


def connections(graph: GraphRelations) -> DataFrame:
    """owner, direction, channel, kind, repos: where repositories send (owner: the repository) and what consuming entries hear (owner: their id), by the repositories on the other side."""
    sides = graph.members.select("channel", "kind", "verb", "side", F.substring_index("id", ":", 1).alias("peer")).distinct()
    peers = lambda side: sides.filter(F.col("side") == side).groupBy("channel", "kind", "verb").agg(sorted_set(F.col("peer")).alias("repos"))
    sent = graph.producers.select(F.col("repo").alias("owner"), "channel").distinct()
    out = sent.join(peers("consumer"), "channel").select("owner", F.lit("out").alias("direction"), "channel", "kind", "repos")
    hears = graph.entry_points.filter(F.col("type").isin(*(t for t in LINKED_CONSUMERS if t not in ("message-handler", "websocket"))))
    heard = hears.select(F.col("id").alias("owner"), "channel").distinct().join(peers("producer"), "channel").select("owner", F.lit("in").alias("direction"), "channel", "kind", "repos")
    return out.unionByName(heard)


def entry_connections(graph: GraphRelations, entry_id: str) -> DataFrame:
    """direction, channel, kind, repos of one entry point: what it hears, and where its repository sends."""
    mine = graph.entry_points.filter(F.col("id") == entry_id)
    repo = mine.select(F.col("repo").alias("owner")).distinct()
    near = graph.with_(entry_points=mine, producers=graph.producers.join(repo.withColumnRenamed("owner", "repo"), "repo", "left_semi"))
    return connections(near).select("direction", "channel", "kind", "repos")
