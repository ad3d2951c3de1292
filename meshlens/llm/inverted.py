"""A positional inverted index of a corpus, and exact phrase and proximity search of benchmark texts in it.

Documents are dealt into shards of a few megabytes.  Each shard lists its terms with their postings, the positions of
all their tokens, and the whole index is a table of (shard, term) rows in the shared folder.  A search counts the
test terms in the index, takes of every window of words the rarest term as its anchor, fetches the test terms' lists by a
join on the term, and intersects them shard by shard: an anchor's list, adjusted by the anchor's offset, with its
neighbours' lists, adjusted by theirs, until a window's words are complete or none are left.

Test texts are searched in blocks of bounded size against all shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, whole_groups, with_checkpoint_dir

#: Bytes of text in a shard; a longer text is a shard by itself.
SHARD_BYTES = 12 << 20
#: Words of test texts that tasks get at once.
BLOCK_WORDS = 400_000
#: Candidate positions that are looked at together.
CANDIDATES = 1 << 20

_INDEX = "shard bigint, term string, n int, postings binary, ids array<bigint>, words array<int>"
_FOUND = "shard bigint, at int, item bigint, start int, end int"

#: What each byte becomes: letters of ASCII in lower case, digits and all bytes of other characters as they are, 0 for what separates words.
_FOLD = np.zeros(256, np.uint8)
for _byte in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_byte] = _byte
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order, and how many each text has; null texts have none.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z in lower case and nothing else changed.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    folded = _FOLD[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data and len(texts) else np.zeros(0, np.uint8)
    inside = folded != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    bounds = offsets - offsets[0]
    firsts = bounds[:-1][bounds[:-1] < len(folded)]  # no word goes on from one text to the next
    starts[firsts] = inside[firsts]
    begins = np.flatnonzero(starts)
    letters = folded[inside]
    ends = np.append(np.flatnonzero(starts[inside]), len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return words.dictionary_encode(), np.diff(np.searchsorted(begins, bounds))


def _gaps(positions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each list's first position, then the steps to the next ones."""
    steps = np.diff(positions, prepend=0)
    firsts = np.cumsum(counts) - counts
    steps[firsts] = positions[firsts]
    return steps.astype("<u4")


def _positions(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of which _gaps() made gaps, for all lists at once."""
    total = np.cumsum(gaps, dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    return total - np.repeat(total[firsts] - gaps[firsts], counts)


def shard_rows(ids: pa.Array, texts: pa.Array, shard: int, schema: pa.Schema) -> pa.RecordBatch:
    """A shard's rows: a term each, with the positions of its tokens, and one with the ids and words of its documents.

    Documents stand behind one another with a free place after each, so that no phrase goes from one into the next.
    """
    words, counts = tokens(texts)
    at = np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(len(counts)), counts)
    codes = words.indices.to_numpy()
    n = np.bincount(codes, minlength=len(words.dictionary)).astype(np.int64)
    gaps = _gaps(at[np.argsort(codes, kind="stable")], n)
    lists = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n)) * 4), pa.py_buffer(gaps)])
    terms = pa.table({"shard": pa.array(np.full(len(n), shard)), "term": words.dictionary.cast(pa.string()), "n": pa.array(n.astype(np.int32)), "postings": lists.cast(pa.binary())})
    known = {"shard": [shard], "n": [len(codes)], "ids": [ids], "words": [counts.astype(np.int32)]}
    own = pa.table({name: pa.array(known[name], schema.field(name).type) if name in known else pa.nulls(1, schema.field(name).type) for name in schema.names})
    full = pa.table({name: terms[name] if name in terms.column_names else pa.nulls(len(n), schema.field(name).type) for name in schema.names}).cast(schema)
    return pa.concat_tables([own.cast(schema), full]).combine_chunks().to_batches()[0]


@dataclass(frozen=True)
class PositionalIndex:
    """An index table in a folder that driver and executors share: of each shard a row a term, and one of its documents."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> PositionalIndex:
        """Stores the postings of all tokens of docs (id_col, text_col); a null text has none, rows that repeat are documents of their own."""
        spark = docs.sparkSession
        path = path or f"{with_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = TaskContext.get()
            shard = (context.partitionId() if context else 0) << 32
            waiting: list[pa.RecordBatch] = []
            size = 0

            def closed() -> pa.RecordBatch:
                nonlocal waiting, size, shard
                rows = pa.Table.from_batches(waiting)
                waiting, size, shard = [], 0, shard + 1
                return shard_rows(rows.column(0).combine_chunks(), rows.column(1).combine_chunks(), shard, target)

            for batch in batches:
                bytes_of = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
                at = 0
                for row in range(batch.num_rows):
                    if size and size + bytes_of[row] > shard_bytes:
                        waiting.append(batch.slice(at, row - at))
                        yield closed()
                        at = row
                    size += int(bytes_of[row])
                waiting.append(batch.slice(at))
            if sum(b.num_rows for b in waiting):
                yield closed()

        bound_batches(spark)
        target = arrow_schema(spark, _INDEX)
        docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, _INDEX).write.parquet(path)
        return PositionalIndex(spark, path)

    @property
    def table(self) -> DataFrame:
        return self.spark.read.schema(_INDEX).parquet(self.path)

    def documents(self) -> DataFrame:
        """(shard, at, doc_id, n_words) of every document: `at` is its place in the shard."""
        return self.table.filter("term IS NULL").select("shard", F.posexplode(F.arrays_zip("ids", "words")).alias("at", "d")).select("shard", "at", F.col("d.ids").alias("doc_id"), F.col("d.words").cast("bigint").alias("n_words"))

    def phrase_matches(self, items: DataFrame, window: int = 10) -> DataFrame:
        """(shard, at, item, start, end) of all runs of `window` or more consecutive words that a document shares with an item.

        items (item: bigint, one row an item; text).  An item of fewer words is one window, one without words has none.
        Runs of an item that touch or overlap in a document are one row; start and end count its words.
        """
        return self._search(items, window, lambda lists, block, docs: phrases(lists, block, docs, window))

    def proximity_matches(self, items: DataFrame, within: int = 20) -> DataFrame:
        """(shard, at, item, start, end) of the least stretches of at most `within` words that hold each different word of an item, in any order.

        A stretch is least if none that it contains holds all words.  Items as for phrase_matches().
        """
        return self._search(items, None, lambda lists, block, docs: near(lists, block, docs, within))

    def _search(self, items: DataFrame, window: int | None, match: Callable) -> DataFrame:
        folder = f"{with_checkpoint_dir(self.spark)}/search-{uuid.uuid4().hex}"
        for k, block in enumerate(_blocks(self, items, window, folder)):
            self._matched(block, match).write.parquet(f"{folder}/found/{k}")
        if not self.spark.read.schema("block int").parquet(f"{folder}/items").limit(1).count():
            return self.spark.createDataFrame([], _FOUND)
        return self.spark.read.schema(_FOUND).parquet(*[f"{folder}/found/{j}" for j in range(k + 1)])

    def _matched(self, block: Block, match: Callable) -> DataFrame:
        terms = self.spark.read.parquet(block.terms).withColumnRenamed("term", "_term")
        lists = self.table.filter("term IS NOT NULL").join(terms, F.col("term") == F.col("_term")).select("shard", "code", "n", "postings", F.lit(None).cast("array<int>").alias("words"))
        docs = self.table.filter("term IS NULL").select("shard", F.lit(-1).alias("code"), "n", F.lit(None).cast("binary").alias("postings"), "words")
        rows = lists.unionByName(docs).repartition("shard").sortWithinPartitions("shard", "code")
        shared = self.spark.sparkContext.broadcast(block.arrays)  # of BLOCK_WORDS words at most, or one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in whole_groups(batches, ("shard",)):
                shards = group["shard"].to_numpy()
                for first in np.flatnonzero(np.diff(shards, prepend=shards[0] - 1)):
                    end = first + np.searchsorted(shards[first:], shards[first], "right")
                    yield from _found(group.slice(first, end - first), shared.value, match, target)

        target = arrow_schema(self.spark, _FOUND)
        return rows.mapInArrow(run, _FOUND)


@dataclass(frozen=True)
class Block:
    """Test texts that are searched at once: the folder of their terms and codes, and their words as arrays."""

    terms: str
    arrays: dict


def _blocks(index: PositionalIndex, items: DataFrame, window: int | None, folder: str) -> Iterator[Block]:
    """Items as blocks of about BLOCK_WORDS words at most, with the anchors of their windows."""
    spark = index.spark

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = tokens(batch.column(1))
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, words.cast(pa.string()))], schema=target)

    schema = "item bigint, words array<string>"
    target = arrow_schema(spark, schema)
    bound_batches(spark)
    worded = items.select(F.col("item").cast("bigint"), F.col("text")).mapInArrow(words_of, schema).filter(F.size("words") > 0)
    worded.write.parquet(f"{folder}/words")
    worded = spark.read.parquet(f"{folder}/words")
    total, longest = worded.agg(F.sum(F.size("words")), F.max(F.size("words"))).first()
    parts = max(1, -(-2 * (total or 0) // BLOCK_WORDS))
    while True:  # hashing deals unevenly: until no block is too large that isn't one item
        dealt = worded.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
        if not total or (dealt.groupBy("block").agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("items")).filter((F.col("n") > BLOCK_WORDS) & (F.col("items") > 1)).isEmpty()):
            break
        parts *= 2
    spread = dealt.select("block", "item", F.posexplode("words").alias("offset", "term"))
    spread.select("term").distinct().write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")  # a table of known size: joins broadcast it if it is small
    counts = index.table.filter("term IS NOT NULL").select("term", "n").join(terms, "term").groupBy("term").agg(F.sum(F.col("n").cast("bigint")).alias("n"))
    counts.write.parquet(f"{folder}/counts")
    counted = spread.join(spark.read.parquet(f"{folder}/counts"), "term", "left").select("block", "item", "offset", "term", F.coalesce("n", F.lit(0)).alias("n"))
    size = F.count("*").over(Window.partitionBy("block", "item"))
    rare = F.struct("n", "offset")
    if window is None:
        anchor = F.min(rare).over(Window.partitionBy("block", "item"))
        starts = F.col("offset") == 0
    else:
        anchor = F.min(rare).over(Window.partitionBy("block", "item").orderBy("offset").rowsBetween(0, window - 1))
        starts = F.col("offset") <= F.greatest(F.col("size") - window, F.lit(0))
    anchored = counted.select("*", size.alias("size"), anchor.alias("anchor")).withColumn("anchor", F.when(starts & (F.col("anchor.n") > 0), F.col("anchor.offset")))  # a term without postings: the window occurs nowhere
    rows = anchored.groupBy("block", "item").agg(F.sort_array(F.collect_list(F.struct("offset", "term"))).alias("words"), F.array_sort(F.collect_set("anchor")).alias("anchors"))
    rows.select("block", "item", F.col("words.term").alias("words"), "anchors").write.partitionBy("block").parquet(f"{folder}/items")
    for block in sorted(r.block for r in spark.read.parquet(f"{folder}/items").select("block").distinct().collect()) if total else []:
        found = spark.read.parquet(f"{folder}/items").filter(F.col("block") == block).orderBy("item").collect()
        code: dict[str, int] = {}
        gap, flat, item_of, anchors = max(window or 1, 1), [], [], []
        flat += [-2] * gap
        for r in found:
            anchors += [len(flat) + a for a in r.anchors]
            item_of += [0] * (len(flat) - len(item_of)) + [r.item] * len(r.words)
            flat += [code.setdefault(w, len(code)) for w in r.words] + [-2] * gap
        item_of += [0] * (len(flat) - len(item_of))
        spark.createDataFrame(pa.table({"term": pa.array(code.keys(), pa.string()), "code": pa.array(code.values(), pa.int32())})).coalesce(1).write.parquet(f"{folder}/codes/{block}")
        arrays = {"flat": np.array(flat, np.int32), "item": np.array(item_of, np.int64), "anchors": np.array(anchors, np.int64), "terms": len(code)}
        yield Block(f"{folder}/codes/{block}", arrays)


def _found(group: pa.Table, block: dict, match: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The matches of a block's items in one shard's rows."""
    codes, n = group["code"].to_numpy(), group["n"].to_numpy().astype(np.int64)
    words = group["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if codes[0] != -1 or len(codes) == 1:  # no test term, or no documents
        return
    begins = np.cumsum(words.astype(np.int64) + 1) - words - 1
    gaps = np.frombuffer(b"".join(group["postings"].combine_chunks().to_pylist()[1:]), "<u4")
    lists = {"codes": codes[1:], "n": n[1:], "at": _positions(gaps, n[1:]), "places": int(words.sum()) + len(words)}
    start, end, item = match(lists, block, begins)
    if len(start):
        at = np.searchsorted(begins, start, "right") - 1
        out = {"shard": np.full(len(at), group["shard"][0].as_py()), "at": at, "item": item, "start": start - begins[at], "end": end - begins[at]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, schema.field(k).type) for k, v in out.items()}, schema=schema)


def _candidates(lists: dict, block: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the shard, places in the block) of all tokens that are an anchor's term, CANDIDATES or one list at a time."""
    first = np.zeros(block["terms"], np.int64)
    count = np.zeros(block["terms"], np.int64)
    first[lists["codes"]] = np.cumsum(lists["n"]) - lists["n"]
    count[lists["codes"]] = lists["n"]
    anchors = block["anchors"]
    code = block["flat"][anchors]
    anchors, code = anchors[count[code] > 0], code[count[code] > 0]
    chunk = np.cumsum(count[code]) // CANDIDATES
    for c in np.unique(chunk):
        mine, its = anchors[chunk == c], code[chunk == c]
        many = count[its]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield lists["at"][np.repeat(first[its], many) + nth], np.repeat(mine, many)


def phrases(lists: dict, block: dict, begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, item) of runs of a shard's places that hold windows of the block's items.

    The shard's lists are laid out by place, so that to intersect candidates with a neighbour's list is to look up what stands there.
    """
    place = np.full(lists["places"] + 2 * window, -1, np.int32)
    place[lists["at"] + window] = np.repeat(lists["codes"], lists["n"])
    flat, item = block["flat"], block["item"]
    sizes = np.zeros(len(flat), np.int32)
    ends = np.flatnonzero(np.diff((flat >= 0).astype(np.int8), prepend=0, append=0))
    for a, b in zip(ends[::2], ends[1::2], strict=True):
        sizes[a:b] = min(b - a, window)
    runs = []
    for at, word in _candidates(lists, block):
        at = at + window
        # nearly all candidates end here: a window of two or more words goes on to one side at least
        goes_on = (place[at + 1] == flat[word + 1]) | (place[at - 1] == flat[word - 1]) | (sizes[word] == 1)
        at, word = at[goes_on], word[goes_on]
        reach = []
        for side in (-1, 1):
            length = np.zeros(len(at), np.int64)
            alive = np.arange(len(at))
            for step in range(1, window):
                alive = alive[place[at[alive] + side * step] == flat[word[alive] + side * step]]
                length[alive] = step
                if not len(alive):
                    break
            reach.append(length)
        whole = reach[0] + reach[1] + 1 >= sizes[word]
        runs.append(np.stack([item[word], at - window - reach[0], at - window + reach[1] + 1], 1)[whole])
    found = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    items, starts, ends = found.T
    if not len(found):
        return starts, ends, items
    rank = np.cumsum(np.diff(items, prepend=items[0]) != 0) * (lists["places"] + 1)  # items apart, so that one running maximum serves all
    reached = np.maximum.accumulate(ends + rank)
    new = np.append(True, starts[1:] + rank[1:] > reached[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)
    return starts[new], (reached - rank)[last], items[new]


def near(lists: dict, block: dict, begins: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, item) of the least stretches of at most `within` places of one document that hold all words of an item."""
    first = np.cumsum(lists["n"]) - lists["n"]
    of = {c: lists["at"][a : a + n] for c, a, n in zip(lists["codes"].tolist(), first.tolist(), lists["n"].tolist(), strict=True)}
    flat, item = block["flat"], block["item"]
    edges = np.flatnonzero(np.diff((flat >= 0).astype(np.int8), prepend=0, append=0))
    anchored = set(block["anchors"].tolist())
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        codes = sorted(set(flat[a:b].tolist()))
        anchor = next((flat[x] for x in range(a, b) if x in anchored), None)
        if anchor is None or any(c not in of for c in codes):
            continue
        rare = of[int(anchor)]
        close = []  # from the rarest term's places: only what stands within reach of one can belong to a stretch
        for c in codes:
            at = of[c]
            left = np.searchsorted(rare, at - within, "right")
            close.append(at[(left < len(rare)) & (rare[np.minimum(left, len(rare) - 1)] < at + within)])
        if any(not len(x) for x in close):
            continue
        ends = np.unique(np.concatenate(close))
        latest = np.full(len(ends), np.iinfo(np.int64).max)
        for at in close:
            seen = np.searchsorted(at, ends, "right") - 1
            latest = np.minimum(latest, np.where(seen >= 0, at[np.maximum(seen, 0)], -(within + 1)))
        same = np.searchsorted(begins, np.maximum(latest, 0), "right") == np.searchsorted(begins, ends, "right")
        good = (latest >= 0) & (ends - latest < within) & same
        starts, stops = latest[good], ends[good] + 1
        least = np.append(True, np.diff(starts) > 0) if len(starts) else np.zeros(0, bool)
        out.append(np.stack([starts[least], stops[least], np.full(int(least.sum()), item[a])], 1))
    found = np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)
    return found[:, 0], found[:, 1], found[:, 2]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of docs (doc_id, text) against benchmark (item_id, text).

    A document's word is hit if it lies in an occurrence of a window of an item, as phrase_matches() says.  Items are told by
    item_id: rows that share one are one item, a null one counts as an empty string.  Null and empty texts have no words; rows of
    docs that repeat have rows of their own; an empty table of docs gives an empty one, one of benchmark no hits.  Other columns are not read.
    """
    spark = docs.sparkSession
    index = PositionalIndex.build(docs)
    path = f"{with_checkpoint_dir(spark)}/items-{uuid.uuid4().hex}"
    benchmark.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").write.parquet(path)  # numbers stay
    items = spark.read.parquet(path)
    runs = index.phrase_matches(items, window).join(items.select("item", "item_id"), "item")
    reach = F.max("end").over(Window.partitionBy("shard", "at").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    hits = (
        runs.withColumn("fresh", fresh)
        .groupBy("shard", "at")
        .agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(F.col("shard").alias("_shard"), F.col("at").alias("_at"), "n_hit", "items")
    )
    joined = index.documents().join(hits, (F.col("shard") == F.col("_shard")) & (F.col("at") == F.col("_at")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: The same rows in DuckDB: every window of every document as a list of words, joined with the items' windows of that length.
CONTAMINATION_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, k, s, array_to_string(ws[s:s + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM w, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)
), m AS (
  SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM m)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
