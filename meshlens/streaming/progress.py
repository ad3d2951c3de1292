"""Log lines of an analysis as a stream: their phase, and how far it has come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Phases in order with their weights in percent, and prefixes of log lines.
PHASES = (("clone", 15), ("scan", 5), ("index", 25), ("detect", 5), ("graph", 35), ("link", 5), ("analyze", 10))
LOG_PREFIXES = ("clone", "scan", "index", "detect", "link", "analyze", "done", "graph")
COUNTED = ("index", "detect", "graph", "analyze")


def classify_log(message: Column) -> Column:
    """The phase that a line's bracketed prefix names, or info."""
    out = F.lit("info")
    for name in reversed(LOG_PREFIXES):
        out = F.when(F.startswith(F.lower(message), F.lit(f"[{name}]")), F.lit(name)).otherwise(out)
    return out


def _classified(logs: DataFrame) -> DataFrame:
    """logs with phase, fraction (done/total of counted lines), cloned and scanned (whether a line says so of a repository)."""
    done, total = (F.regexp_extract("message", "^\\[(?:index|detect|graph|analyze)\\] ([0-9]+)/([0-9]+)", k).try_cast("bigint") for k in (1, 2))
    rows = logs.withColumn("phase", classify_log(F.col("message"))).withColumn("fraction", F.when(F.col("phase").isin(*COUNTED) & (total > 0), F.least(F.lit(1.0), done / total)))
    ready = (F.col("phase") == "clone") & F.col("message").rlike("^\\[clone\\] (.+ ready at |Using local repo )")
    return rows.withColumn("cloned", ready).withColumn("scanned", (F.col("phase") == "scan") & F.col("message").rlike("^\\[scan\\] .+: scanning "))


def phase_fractions(logs: DataFrame) -> DataFrame:
    """run_id, phase, lines, fraction, last_ord: of logs (run_id, ord, message); for streams and tables alike.

    fraction is the highest done/total of a phase's counted lines, null without any; it never falls
    when lines come twice or late.
    """
    n = lambda flag: F.count(F.when(F.col(flag), 1)).alias(flag)
    return _classified(logs).groupBy("run_id", "phase").agg(F.count("*").alias("lines"), F.max("fraction").alias("fraction"), F.max("ord").alias("last_ord"), n("cloned"), n("scanned"))


def ingest_progress(fractions: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """run_id, phase, determinate, pct of each run: weighted phases; the run's last known phase counts, done beats all.

    repos (run_id, repo_total) makes cloning and scanning determinate.
    """
    weights = [w for _, w in PHASES]
    before = {name: sum(weights[:k]) for k, (name, _) in enumerate(PHASES)}
    known = fractions.join(repos, "run_id", "left") if repos is not None else fractions.withColumn("repo_total", F.lit(None).cast("int"))
    total = F.col("repo_total")
    whole = total.isNotNull() & (total > 0)
    share = F.when((F.col("phase") == "clone") & whole, F.least("cloned", total) / total).when((F.col("phase") == "scan") & whole, F.least("scanned", total) / total)
    share = share.when(F.col("phase").isin(*COUNTED), F.col("fraction"))
    base, weight = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, w in PHASES:
        base = F.when(F.col("phase") == name, before[name]).otherwise(base)
        weight = F.when(F.col("phase") == name, w).otherwise(weight)
    rows = known.withColumns({"_share": share, "_base": base, "_weight": weight, "_done": F.col("phase") == "done"})
    last = rows.groupBy("run_id").agg(F.max("_done").alias("_done"), F.max(F.when(F.col("_base").isNotNull(), F.struct("last_ord", "phase", "_share", "_base", "_weight"))).alias("p"))
    share = F.col("p._share")
    pct = F.when(share.isNotNull(), F.least(F.lit(100), F.floor(F.col("p._base") + F.col("p._weight") * share + 0.5)).cast("int"))
    return last.select(
        "run_id", F.when(F.col("_done"), "done").otherwise(F.coalesce("p.phase", F.lit("info"))).alias("phase"),
        (F.col("_done") | F.col("p._share").isNotNull()).alias("determinate"), F.when(F.col("_done"), 100).otherwise(pct).alias("pct"),
    )


#: Fixed value: lines that a phase writes at most.
MOST_LINES = 20


def progress_lines(reports: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """run_id, ord, line of the reports (run_id, phase, ord, done, total, noun) that are worth a log line: `[phase] done/total noun`.

    A report is if it passes a further one of `most` even thresholds of its total, however many it passes at once; reports that
    come to no further one, or whose total isn't over 0, say nothing.  So a phase has `most` lines at most.
    """
    done = F.least("done", "total")
    passed = F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), lambda k: F.round(F.col("total") * k / (most + 1)) <= done))
    before = Window.partitionBy("run_id", "phase").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = reports.filter("total > 0").withColumn("_passed", passed).withColumn("_before", F.coalesce(F.max("_passed").over(before), F.lit(0))).filter("_passed > _before")
    return rows.select("run_id", "ord", F.format_string("[%s] %d/%d %s", "phase", done, "total", "noun").alias("line"))


# ---------------------------------------------------------------- as a stateful stream


_STREAMED = "run_id string, phase string, determinate boolean, pct int, best int"


def told(state: dict, total: int | None) -> tuple[str, bool, int | None]:
    """(phase, determinate, pct) of a run's state, as ingest_progress() tells them."""
    weights = dict(PHASES)
    if "done" in state["last"]:
        return "done", True, 100
    known = [(ord_, name) for name, ord_ in state["last"].items() if name in weights]
    if not known:
        return "info", False, None
    phase = max(known)[1]
    names = [name for name, _ in PHASES]
    base = sum(weights[name] for name in names[: names.index(phase)])
    share = state["fraction"].get(phase)
    if phase in ("clone", "scan") and total:
        share = min(len(state["cloned" if phase == "clone" else "scanned"]), total) / total
    return phase, share is not None, None if share is None else min(100, int(base + weights[phase] * share + 0.5))


def progress_stream(logs: DataFrame, repo_total: int | None = None) -> DataFrame:
    """run_id, phase, determinate, pct, best of each run whenever lines of it come, from a stream of logs (run_id, ord, message).

    A run's state holds the highest fraction and the last line of each phase, and which lines told of a repository: lines that come
    late or twice change nothing that has been told.  best is the highest percentage told so far, which never falls even where a
    run goes back to an earlier phase.  It ends as ingest_progress() of all lines.  Null run ids are a run of their own; lines
    without a place (ord) count as before all others.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {"last": {}, "fraction": {}, "cloned": [], "scanned": [], "best": 0}
        cloned, scanned = set(state["cloned"]), set(state["scanned"])
        for rows in batches:
            for phase, ord_ in rows.groupby("phase")["ord"].max().items():
                state["last"][phase] = max(int(ord_), state["last"].get(phase, -1))
            for phase, fraction in rows.dropna(subset=["fraction"]).groupby("phase")["fraction"].max().items():
                state["fraction"][phase] = max(float(fraction), state["fraction"].get(phase, 0.0))
            cloned |= set(map(int, rows.loc[rows["cloned"], "ord"]))
            scanned |= set(map(int, rows.loc[rows["scanned"], "ord"]))
        state |= {"cloned": sorted(cloned), "scanned": sorted(scanned)}
        phase, determinate, pct = told(state, repo_total)
        state["best"] = max(state["best"], pct or 0)
        held.update((json.dumps(state),))
        yield pd.DataFrame({"run_id": [key[0]], "phase": [phase], "determinate": [determinate], "pct": pd.array([pct], "Int32"), "best": pd.array([state["best"]], "Int32")})

    rows = _classified(logs).select("run_id", F.coalesce("ord", F.lit(-1)).alias("ord"), "phase", "fraction", "cloned", "scanned")
    return rows.groupBy("run_id").applyInPandasWithState(update, _STREAMED, "state string", "update", GroupStateTimeout.NoTimeout)


def run_progress(spark, folder: str, out: str, checkpoint: str, max_files: int = 1, repo_total: int | None = None) -> DataFrame:
    """Follows Parquet log files in a folder to their present end and returns what is told last of each run; a stopped stream goes on from its checkpoint.

    Each batch is a folder of its own in `out`, which a batch that is run again replaces.
    """
    logs = spark.readStream.schema("run_id string, ord bigint, message string").option("maxFilesPerTrigger", max_files).parquet(folder)
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    progress_stream(logs, repo_total).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    told_so_far = spark.read.schema(f"{_STREAMED}, batch bigint").parquet(out)
    return told_so_far.groupBy("run_id").agg(F.max_by(F.struct("phase", "determinate", "pct", "best"), "batch").alias("r")).select("run_id", "r.*")


def watch_logs(spark, folder: str, max_files: int = 100) -> DataFrame:
    """A stream over JSON log files (run_id, ord, message) in a folder, as phase_fractions(); write it in complete or update mode."""
    logs = spark.readStream.schema("run_id string, ord bigint, message string").option("maxFilesPerTrigger", max_files).json(folder)
    return phase_fractions(logs)
