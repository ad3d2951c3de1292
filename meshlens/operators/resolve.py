"""Symbol resolution as joins: names to types, receivers to methods, tokens to channels.

Where the rules try one thing after another, each way is a join that adds candidates with a rank,
and the least rank of a question wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import last_seg
from ..plans.fixpoint import cut
from ..sources.extract import JavaIndex


def _best(candidates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    first = Window.partitionBy(*key).orderBy(*order)
    return candidates.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def _under(types: DataFrame, found: str) -> DataFrame:
    """(w, simple, found, n): for each package, or type, that names begin with, the types of one simple name under it: how many, and the least.

    A wildcard is looked up here by both names; joined by the simple name alone, each question would meet all types of that name.
    """
    parts = F.split("fqn", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    rows = types.filter(F.contains("fqn", F.lit("."))).select(F.explode(above).alias("w"), F.col("simple_name").alias("simple"), F.col(found).alias(found))
    return rows.groupBy("w", "simple").agg(F.min(found).alias(found), F.count("*").alias("n"))


def find_class(idx: JavaIndex, asked: DataFrame) -> DataFrame:
    """(key, simple, target, target_kind, target_simple) of asked (key of a type, simple name that it uses).

    An explicit import of an indexed type, else the only one of that name under a wildcard import,
    else one of the same package, else the only one of that name; no row if none of these.
    """
    pairs = asked.select("key", "simple").filter("simple <> ''").distinct()
    seen = idx.types.select("key", "package", "explicit", "wildcard")
    known = idx.scanned.select(F.col("key").alias("target"), "fqn", F.col("simple_name").alias("target_simple"))
    every = idx.types.select(F.col("key").alias("target"), "fqn", F.col("simple_name").alias("target_simple"))
    mine = pairs.hint("merge").join(seen, "key")
    explicit = mine.select("key", "simple", F.posexplode("explicit").alias("p", "fqn")).filter(last_seg(F.col("fqn")) == F.col("simple")).hint("merge").join(known, "fqn").select("key", "simple", "target", F.lit(1).alias("rank"), "p")
    wild = mine.select("key", "simple", F.posexplode("wildcard").alias("p", "w")).hint("merge").join(_under(idx.types.withColumnRenamed("key", "target"), "target").filter("n = 1"), ["w", "simple"]).select("key", "simple", "target", F.lit(2).alias("rank"), "p")
    same = mine.filter("package <> ''").select("key", "simple", F.concat_ws(".", "package", "simple").alias("fqn")).hint("merge").join(known, "fqn").select("key", "simple", "target", F.lit(3).alias("rank"), F.lit(0).alias("p"))
    lone = every.groupBy("target_simple").agg(F.min("target").alias("target"), F.count("*").alias("n")).filter("n = 1")
    only = pairs.hint("merge").join(lone, F.col("simple") == F.col("target_simple")).select("key", "simple", "target", F.lit(4).alias("rank"), F.lit(0).alias("p"))
    best = _best(explicit.union(wild).union(same).union(only), ["key", "simple"], ["rank", "p", "target"])
    return best.select("key", "simple", "target").hint("merge").join(idx.types.select(F.col("key").alias("target"), F.col("kind").alias("target_kind"), F.col("simple_name").alias("target_simple")), "target")


def resolve_fqn(idx: JavaIndex, asked: DataFrame) -> DataFrame:
    """(key, simple, fqn) of asked (key, simple): like find_class(), but an import or the own package counts for types that aren't indexed."""
    pairs = asked.select("key", "simple").filter("simple <> ''").distinct()
    mine = pairs.hint("merge").join(idx.types.select("key", "package", "explicit", "wildcard"), "key")
    every = idx.types.select("fqn", "simple_name")
    explicit = mine.select("key", "simple", F.posexplode("explicit").alias("p", "fqn")).filter(last_seg(F.col("fqn")) == F.col("simple")).select("key", "simple", "fqn", F.lit(1).alias("rank"), "p")
    wild = mine.select("key", "simple", F.posexplode("wildcard").alias("p", "w")).hint("merge").join(_under(idx.types, "fqn").filter("n = 1"), ["w", "simple"]).select("key", "simple", "fqn", F.lit(2).alias("rank"), "p")
    same = mine.filter((F.col("package") != "") & F.col("simple").rlike("^\\p{Lu}")).select("key", "simple", F.concat_ws(".", "package", "simple").alias("fqn"), F.lit(3).alias("rank"), F.lit(0).alias("p"))
    lone = every.groupBy("simple_name").agg(F.min("fqn").alias("fqn"), F.count("*").alias("n")).filter("n = 1")
    only = pairs.hint("merge").join(lone, F.col("simple") == F.col("simple_name")).select("key", "simple", "fqn", F.lit(4).alias("rank"), F.lit(0).alias("p"))
    return _best(explicit.union(wild).union(same).union(only), ["key", "simple"], ["rank", "p", "fqn"]).select("key", "simple", "fqn")


def supertypes(idx: JavaIndex) -> DataFrame:
    """(key, s_ord, simple, target, target_simple): resolved direct supertypes in order."""
    named = idx.types.select("key", F.posexplode("supertypes").alias("s_ord", "simple"))
    return named.hint("merge").join(find_class(idx, named), ["key", "simple"]).select("key", "s_ord", "simple", "target", "target_simple")


def impls_of(idx: JavaIndex) -> DataFrame:
    """(simple, impl, impl_simple, impl_ord): scanned types by the simple names of their direct supertypes."""
    return idx.scanned.select(F.explode("supertypes").alias("simple"), F.col("key").alias("impl"), F.col("simple_name").alias("impl_simple"), F.col("ord").alias("impl_ord")).distinct()


def field_types(idx: JavaIndex) -> DataFrame:
    """(key, name, type): a type's own fields, else those of its direct supertypes in order."""
    own = idx.fields.groupBy("key", "name").agg(F.max_by("type", "f_ord").alias("type"))
    above = supertypes(idx).hint("merge").join(own.withColumnRenamed("key", "target"), "target").select("key", "name", "type", (F.col("s_ord") + 1).alias("rank"))
    return _best(own.select("key", "name", "type", F.lit(0).alias("rank")).unionByName(above), ["key", "name"], ["rank"]).select("key", "name", "type")


def ancestors(idx: JavaIndex, longest: int | None = None) -> DataFrame:
    """(key, target_simple, walk): the type itself and its supertypes at any distance; walk orders them depth-first.

    A walk meets no name twice, which ends the rounds; `longest` bounds them where that is wanted.
    """
    step = cut(supertypes(idx).select(F.col("key").alias("_from"), "s_ord", "target", F.col("target_simple").alias("simple")))
    level = cut(idx.types.select("key", F.col("key").alias("at"), F.array("simple_name").alias("names"), F.array().cast("array<int>").alias("walk")))
    out, k = level, 0
    while longest is None or k < longest:
        k += 1
        level = cut(level.hint("merge").join(step, level["at"] == step["_from"]).filter(~F.array_contains("names", F.col("simple"))).select("key", F.col("target").alias("at"), F.array_append("names", F.col("simple")).alias("names"), F.array_append("walk", F.col("s_ord")).alias("walk")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("key", F.element_at("names", -1).alias("target_simple"), "walk")


def param_type(name: Column) -> Column:
    """The declared type of a parameter (column params) of that name; null if there is none."""
    return F.get(F.filter("params", lambda p: (p["name"] == name) & (p["type_text"] != "")), F.lit(0))["type_text"]


def calls_of(idx: JavaIndex) -> DataFrame:
    """Calls of methods of all types with what their receiver is declared as.

    key (type), method_key, m_ord, ord, line, receiver, method, args, arity, local_type, and the parser's columns.
    """
    m = idx.types.select("key", "repo", "file", "simple_name", "ord", F.posexplode("methods").alias("m_ord", "m")).withColumnRenamed("ord", "type_ord")
    rows = m.select("key", "repo", "file", "simple_name", "type_ord", "m_ord", F.col("m.name").alias("m_name"), F.col("m.line").alias("m_line"), "m.locals", F.col("m.params").alias("params"), F.explode("m.calls").alias("c"))
    method_key = F.concat(F.concat_ws(".", "simple_name", "m_name"), F.lit("@"), "file", F.lit(":"), F.col("m_line").cast("string"))
    local = F.coalesce(F.try_element_at("locals", F.col("receiver")), param_type(F.col("receiver")))
    return rows.select("*", "c.*", method_key.alias("method_key")).drop("c").withColumns({"arity": F.size("args"), "local_type": local})


def resolve_calls(idx: JavaIndex, calls: DataFrame | None = None) -> DataFrame:
    """All candidates of every call: method_key, ord, callee, callee_class, callee_file, callee_line, pos; unresolved calls have none.

    The receiver's type is the own class, a local's, a field's, or the only class of that name.  An
    interface stands for its implementations.  Methods are looked for on these, then up their
    supertypes; those of the call's arity are preferred if there are any.
    """
    calls = calls if calls is not None else calls_of(idx)
    calls = calls.filter("m_name <> '<init>' and method <> ''").select("key", "simple_name", "method_key", "ord", "receiver", "method", "arity", "local_type")
    lone = idx.types.groupBy(F.col("simple_name").alias("receiver")).agg(F.count("*").alias("n")).filter("n = 1").select("receiver", F.lit(True).alias("_static"))
    typed = calls.hint("merge").join(field_types(idx).select("key", F.col("name").alias("receiver"), F.col("type").alias("_field")), ["key", "receiver"], "left").hint("merge").join(lone, "receiver", "left")
    recv = F.when(F.col("receiver").isin("", "this", "super"), F.col("simple_name")).when(F.col("local_type").isNotNull(), F.col("local_type")).when(F.coalesce("_field", F.lit("")) != "", F.col("_field")).when(F.col("_static"), F.col("receiver"))
    typed = cut(typed.withColumn("simple", F.coalesce(recv, F.lit(""))).filter("simple <> ''").drop("_field", "_static"))
    concrete = find_class(idx, typed)
    impls = impls_of(idx)
    found = typed.hint("merge").join(concrete, ["key", "simple"], "left").hint("merge").join(impls, "simple", "left")
    by_impl = (F.col("target").isNull() | (F.col("target_kind") == "interface")) & F.col("impl").isNotNull()
    classes = found.withColumns({"at": F.when(by_impl, F.col("impl")).otherwise(F.col("target")), "at_simple": F.when(by_impl, F.col("impl_simple")).otherwise(F.col("target_simple")), "at_ord": F.when(by_impl, F.col("impl_ord")).otherwise(F.lit(""))})
    classes = cut(classes.filter("at is not null").select("method_key", "ord", "method", "arity", "at", "at_simple", "at_ord").distinct())
    methods = idx.methods.select(F.col("class_simple").alias("at_simple"), F.col("name").alias("method"), F.col("method_key").alias("callee"), F.col("class_simple").alias("callee_class"), F.col("file").alias("callee_file"), F.col("line").alias("callee_line"), F.col("n_params"), F.col("ord").alias("d_ord"))
    direct = classes.hint("merge").join(methods, ["at_simple", "method"])
    question = ["method_key", "ord"]
    rest = classes.hint("merge").join(direct.select(*question).distinct(), question, "left_anti")
    above = rest.hint("merge").join(ancestors(idx).select(F.col("key").alias("at"), F.col("target_simple").alias("up"), "walk"), "at").drop("at_simple").withColumnRenamed("up", "at_simple").hint("merge").join(methods, ["at_simple", "method"])
    nearest = above.groupBy(*question, "at").agg(F.min("walk").alias("walk"))
    above = above.hint("merge").join(nearest, [*question, "at", "walk"])
    both = direct.select(*question, "arity", "at_ord", "callee", "callee_class", "callee_file", "callee_line", "n_params", "d_ord").unionByName(above.select(*question, "arity", "at_ord", "callee", "callee_class", "callee_file", "callee_line", "n_params", "d_ord"))
    fits = F.max((F.col("n_params") == F.col("arity")).cast("int")).over(Window.partitionBy(*question))
    kept = both.withColumn("_fit", fits).filter((F.col("_fit") == 0) | (F.col("n_params") == F.col("arity")))
    pos = F.row_number().over(Window.partitionBy(*question).orderBy("at_ord", "d_ord"))
    return kept.withColumn("pos", pos).select(*question, "callee", "callee_class", "callee_file", "callee_line", "pos")


def call_edges(idx: JavaIndex, cands: DataFrame | None = None) -> DataFrame:
    """One row for each call with its shown target, as call_tree() wants them: the first candidate (of resolve_calls()), ambiguous if there are several classes."""
    calls = calls_of(idx).filter("m_name <> '<init>' and method <> ''")
    cands = cands if cands is not None else cut(resolve_calls(idx, calls))
    first = cands.groupBy("method_key", "ord").agg(F.min_by(F.struct("callee", "callee_class", "callee_file", "callee_line"), "pos").alias("f"), (F.size(F.collect_set("callee_class")) > 1).alias("ambiguous"))
    display = F.when(F.col("receiver") != "", F.concat_ws(".", "receiver", "method")).otherwise(F.col("method"))
    rows = calls.select("method_key", F.col("ord").cast("int").alias("ord"), display.alias("display"), "arity").dropDuplicates(["method_key", "ord"])
    return rows.hint("merge").join(first, ["method_key", "ord"], "left").select(F.col("method_key").alias("caller"), F.col("ord").cast("bigint").alias("ord"), "display", "arity", "f.callee", "f.callee_class", "f.callee_file", "f.callee_line", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def resolve_channel(tokens: DataFrame, constants: DataFrame, config: DataFrame) -> DataFrame:
    """(token, channel) of tokens (token), by constants (class, name, value, ord) and config (key, value, first).

    Blank is unknown; #{...} stays; ${key:default} is the key's value, else that of the first key that
    ends with .key, else the default, else the token; Class.NAME and NAME are constants if known.
    """
    t = F.trim("token")
    asked = tokens.select("token").distinct().withColumn("t", t)
    inner = F.regexp_extract("t", "\\$\\{([^}]*)", 1)
    asked = asked.withColumn("_hole", F.contains("t", F.lit("${"))).withColumn("_name", F.when(F.col("_hole"), F.substring_index(inner, ":", 1)))
    asked = asked.withColumn("_default", F.when(F.col("_hole"), F.when(F.contains(inner, F.lit(":")), F.regexp_replace(inner, "^[^:]*:", "")).otherwise(F.col("t"))))
    exact = config.select(F.col("key").alias("_name"), F.col("value").alias("_exact"))
    parts = F.split("key", "\\.")
    tails = config.select("value", "first", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("_name"))
    tail = tails.groupBy("_name").agg(F.min_by("value", "first").alias("_tail"))
    one = constants.groupBy("class", "name").agg(F.max_by("value", "ord").alias("_typed"))
    flat = constants.groupBy("name").agg(F.min_by("value", "ord").alias("_flat"))
    dotted = F.contains("t", F.lit(".")) & ~F.col("t").startswith("/")
    asked = asked.withColumns({"_class": F.when(dotted, F.regexp_replace("t", "\\.[^.]*$", "")), "_const": F.when(dotted, last_seg(F.col("t"))).when(~F.col("t").startswith("/"), F.col("t"))})
    joined = asked.hint("merge").join(exact, "_name", "left").hint("merge").join(tail, "_name", "left").hint("merge").join(one.select(F.col("class").alias("_class"), F.col("name").alias("_const"), "_typed"), ["_class", "_const"], "left").hint("merge").join(flat.withColumnRenamed("name", "_const"), "_const", "left")
    value = (
        F.when(F.coalesce("token", F.lit("")) == "", F.lit("unknown")).when(F.col("t").startswith("#{"), F.col("t")).when(F.col("_hole"), F.coalesce("_exact", "_tail", "_default")).otherwise(F.coalesce("_typed", "_flat", "t"))
    )
    return joined.select("token", value.alias("channel"))


REACTIVE_KEYS = tuple(f"mp.messaging.{way}.{{}}.{key}" for way in ("incoming", "outgoing") for key in ("topic", "destination", "queue", "address"))


def resolve_reactive_channel(tokens: DataFrame, config: DataFrame) -> DataFrame:
    """(token, channel): the destination that configuration gives a logical channel, else its own name."""
    keys = F.array(*[F.concat(F.lit(k.split("{}")[0]), "token", F.lit(k.split("{}")[1])) for k in REACTIVE_KEYS])
    asked = tokens.select("token").distinct().select("token", F.posexplode(keys).alias("p", "key"))
    hit = asked.hint("merge").join(config.filter("value <> ''").select("key", "value"), "key").groupBy("token").agg(F.min_by("value", "p").alias("value"))
    return tokens.select("token").distinct().hint("merge").join(hit, "token", "left").select("token", F.coalesce("value", "token").alias("channel"))
