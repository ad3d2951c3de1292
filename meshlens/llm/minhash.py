"""MinHash near-duplicates by ProbMinHash on sets of shingles: banding, exact verification.

1. Every document gets its shingles' fingerprint and a ProbMinHash signature.  Documents of the same
   shingles are one text from here on, however many copies there are.
2. Texts that agree in a band of the signature are candidates.  Within a bucket each text is compared
   with one pivot (a star), so a bucket of any size costs as many comparisons as it has texts.
3. Links (Jaccard similarity of the shingle sets, computed from the texts, at least the threshold)
   join texts to components.  Buckets that are not within one component are looked through again for
   links between different components, in blocks; so no link between different texts is lost to the
   star.  Signatures are compared there, a block at a time: their number grows with the square of
   the texts of such a bucket, that is of unlike texts that share BANDS-wise equal registers.

A text is known by a number of its own (node), not by the id of its document: ids may repeat.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, bound_batches, cut, held, keep_first, unused, whole_groups
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: BANDS bands of ROWS registers: texts of similarity 0.8 share one with probability 0.99997.
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Candidates whose signatures agree in less than this part aren't verified: texts of similarity 0.8 do so with probability 0.00003 (binomial).
LEAST_AGREEMENT = 0.65
#: Members of a bucket whose signatures are compared as one block, and of a cluster whose texts are.
BLOCK = 1024
TEXT_BLOCK = 256
#: Words whose hashes a task remembers, and bytes of text whose signatures are made at once.
CACHE = 150_000
SIGNATURE_BYTES = 2 << 20
#: Bits of the filter that keeps texts nobody asked for from being shuffled; its size is fixed (512 KB).
FILTER_BITS = 1 << 22

_WORD = re.compile(r"\w+")
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """64-bit hashes of a text's word shingles; words are lower-cased runs of letters, digits and underscores."""

    def __init__(self, words: int = WORDS) -> None:
        import xxhash

        self.words, self.hash, self.known = words, xxhash.xxh64_intdigest, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, ascending, and how often each occurs.  A text of fewer words is one shingle."""
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = self.known
        if len(known) > CACHE:
            keep_first(known, CACHE // 3)
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(codes))
        rolled = codes[: len(codes) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * _U(0x9E3779B97F4A7C15) + codes[k : len(codes) - width + 1 + k]
        return np.unique(_mixed(rolled), return_counts=True)


def probminhash(hashes: list[np.ndarray], weights: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures, one row of `registers` element hashes for each document.

    An element of weight w arrives as a Poisson process of rate w, and each arrival falls on a random
    register, which keeps the element that came first.  Equal elements have equal randomness, so two
    documents agree in a register with the probability Jaccard similarity of their weights.  A
    document ends as soon as no element's next arrival can come before its last register's.
    """
    out = np.zeros((len(hashes), registers), np.uint64)
    if not len(hashes) or not sum(map(len, hashes)):
        return out
    first = np.full(out.size, np.inf)
    winner = out.reshape(-1)
    doc = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    element, rate = np.concatenate(hashes), np.concatenate(weights).astype(np.float64)
    time = np.zeros(len(element))
    latest = np.full(len(hashes), np.inf)
    arrival = 0
    with np.errstate(over="ignore"):
        while len(doc):
            arrival += 1
            random = _mixed(element + _U(arrival * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            uniform = ((random >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(uniform) / rate
            place = doc * registers + (_mixed(random + _U(0x632BE59BD9B4E019)) % _U(registers)).astype(np.int64)
            np.minimum.at(first, place, time)
            won = first[place] == time
            winner[place[won]] = element[won]
            if arrival < 4 or arrival % 8 == 0:
                some = np.unique(doc)
                latest[some] = first.reshape(-1, registers)[some].max(axis=1)
            going = time < latest[doc]
            doc, element, rate, time = doc[going], element[going], rate[going], time[going]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93), parts.shape[:2])
        for k in range(ROWS):
            key = _mixed(key + parts[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text as it is), fingerprint, n (shingles), bands, signature (a byte a register); from fingerprint on null where a text has no word.

    Shingles weigh the same however often they occur, so that registers agree with the probability of the Jaccard
    similarity of the sets, by which links are defined.  With other weights a passage that one copy repeats would hide it.
    """
    schema = "doc_id bigint, h bigint, fingerprint binary, n int, bands array<bigint>, signature binary"

    def make():
        held("minhash")
        shingler = Shingler()

        def f(batch: pa.RecordBatch) -> dict:
            with np.errstate(over="ignore"):
                made = [shingler(t or "") for t in batch.column(1).to_pylist()]
                got = probminhash([h for h, _ in made], [np.ones(len(h)) for h, _ in made])
                keys, small = band_keys(got), (_mixed(got) & _U(255)).astype(np.uint8)
            some = [len(h) > 0 for h, _ in made]
            return {
                "doc_id": batch.column(0),
                "h": batch.column(2),
                "fingerprint": [hashlib.blake2b(h.tobytes(), digest_size=16).digest() if ok else None for (h, _), ok in zip(made, some, strict=True)],
                "n": [len(h) if ok else None for (h, _), ok in zip(made, some, strict=True)],
                "bands": [k if ok else None for k, ok in zip(keys, some, strict=True)],
                "signature": [s.tobytes() if ok else None for s, ok in zip(small, some, strict=True)],
            }

        return f

    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return arrow_map(plain.select("*", text_hash("text").alias("h")), make, schema, text_col=1, slice_bytes=SIGNATURE_BYTES)


def text_hash(column: str) -> F.Column:
    """With an id, this tells a row's text from another's of the same id."""
    return F.xxhash64(F.col(column).cast("string"))


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity by signatures of bytes (rows of a and b), corrected for bytes that agree by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (255 / 256)


def _likely(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose sizes and signatures allow the similarity."""
    left = texts.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("s_a"))
    right = texts.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("s_b"))
    sized = pairs.join(left, "a").join(right, "b").filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).select("a", "b", "s_a", "s_b")

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array(_agreement(a, b) >= LEAST_AGREEMENT)
            return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

        return f

    return arrow_map(sized, make, "a bigint, b bigint")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of wanted (node, id, h), once each.  A filter of fixed size keeps most other documents from being shuffled."""
    position = F.pmod(F.xxhash64("id", "h"), F.lit(FILTER_BITS))
    held = wanted.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for k, part in held.collect():  # FILTER_BITS bits at most
        bits[k - 1, : len(part)] = np.frombuffer(part, np.uint8)
    # bucket numbers are 1 + (p - 1) // 32768 for p >= 1; the same rule is used below
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        flat = shared.value

        def f(batch: pa.RecordBatch) -> dict:
            k, bit = np.asarray(batch.column(3)) - 1, np.asarray(batch.column(4))
            keep = pa.array(((flat[k, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool))
            return {n: batch.column(i).filter(keep) for i, n in enumerate(("id", "text", "h"))}

        return f

    keyed = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string"), text_hash("text").alias("h"))
    keyed = keyed.select("id", "text", "h", F.bitmap_bucket_number(position).alias("k"), F.bitmap_bit_position(position).alias("bit"))
    found = arrow_map(keyed, make, "id bigint, text string, h bigint", text_col=1).join(wanted.select("node", "id", "h"), ["id", "h"])
    return found.select("node", "text").dropDuplicates(["node"])


def _places(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, id, h): the documents that have the texts of nodes (node)."""
    return nodes.join(texts.select("node", "id", "h"), "node")


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b) of nodes those whose shingle sets have at least the Jaccard similarity."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    found = _texts_of(docs, cut(_places(wanted, texts)))
    left = found.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = found.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def make():
        shingler = Shingler()

        def f(batch: pa.RecordBatch) -> dict:
            keep, last, mine = [], None, None
            with np.errstate(over="ignore"):
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if a != last:
                        last, mine = a, shingler(a or "")[0]
                    other = shingler(b or "")[0]
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep.append(both >= similarity * (len(mine) + len(other) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            return {"a": batch.column(0).filter(mask), "b": batch.column(1).filter(mask)}

        return f

    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return arrow_map(both, make, "a bigint, b bigint", text_col=3)


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where groups of equal keys begin, and, last, where the rows end."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), len(new))


def _signature_rows(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, REGISTERS)


def _roots(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches by the links (low, high)."""
    root = np.arange(n)
    while len(low):
        before = root.copy()
        np.minimum.at(root, high, root[low])
        np.minimum.at(root, low, root[high])
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


_EDGE = "a bigint, b bigint"


def _suspected(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join what a block's likely pairs of different components join; at most one a member.

    members are in the order of their block (key, i, j) and have node, component, part, n, signature.
    """
    schema = arrow_schema(members.sparkSession, _EDGE)
    keys = ("key", "i", "j")

    def likely(x: dict, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (x["component"][low] != x["component"][high]) & (np.minimum(x["n"][low], x["n"][high]) >= similarity * np.maximum(x["n"][low], x["n"][high]))
        ok &= (x["i"][low] == x["j"][low]) | (x["part"][low] != x["part"][high])
        low, high = low[ok], high[ok]
        ok = _agreement(x["signature"][low], x["signature"][high]) >= LEAST_AGREEMENT
        return low[ok], high[ok]

    def run(batches):
        for table in whole_groups(batches, keys):
            x = {n: table.column(n).to_numpy() for n in (*keys, "node", "component", "n", "part")} | {"signature": _signature_rows(table)}
            starts = _starts([x[k] for k in keys])
            end_of = np.repeat(starts[1:], np.diff(starts))
            spot, found = np.arange(table.num_rows), []
            for shift in range(1, int(np.diff(starts).max())):
                low = spot[spot + shift < end_of]
                found.append(likely(x, low, low + shift))
            if found:
                root = _roots(table.num_rows, *(np.concatenate(z) for z in zip(*found, strict=True)))
                moved = root != spot
                yield pa.RecordBatch.from_arrays([pa.array(x["node"][root[moved]]), pa.array(x["node"][moved])], schema=schema)

    return members.mapInArrow(run, _EDGE)


def _linked_in_blocks(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components within a block, verified on the texts; at most one a member.

    members are in the order of their block (cluster, i, j) and have node, component, part, n,
    signature, text.  Pairs that earlier links of the block have joined aren't compared.
    """
    schema = arrow_schema(members.sparkSession, _EDGE)
    keys = ("cluster", "i", "j")

    def run(batches):
        shingler = Shingler()
        for table in whole_groups(batches, keys):
            x = {n: table.column(n).to_numpy() for n in (*keys, "component", "n", "part")}
            signature, texts = _signature_rows(table), table.column("text")
            starts = _starts([x[k] for k in keys])
            out: list[tuple[int, int]] = []
            for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                with np.errstate(over="ignore"):
                    sets = [shingler(t.as_py() or "")[0] for t in texts[begin:end]]
                up = {c: c for c in x["component"][begin:end].tolist()}

                def top(c: int, up: dict = up) -> int:
                    while up[c] != c:
                        up[c] = up[up[c]]
                        c = up[c]
                    return c

                within = x["i"][begin] == x["j"][begin]
                n, part, component = x["n"][begin:end], x["part"][begin:end], x["component"][begin:end]
                for k in range(end - begin):
                    ok = np.minimum(n[k], n[:k]) >= similarity * np.maximum(n[k], n[:k])
                    if not within:
                        ok &= part[:k] != part[k]
                    near = np.flatnonzero(ok)
                    agree = _agreement(signature[begin + near], signature[begin + k])
                    for other in near[np.argsort(-agree)][: int((agree >= LEAST_AGREEMENT).sum())].tolist():
                        c, d = top(int(component[k])), top(int(component[other]))
                        if c != d:
                            both = len(np.intersect1d(sets[k], sets[other], assume_unique=True))
                            if both >= similarity * (len(sets[k]) + len(sets[other]) - both) - 1e-9:
                                up[max(c, d)] = min(c, d)
                                out.append((c, d))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*out, strict=True)], schema=schema)

    return members.mapInArrow(run, _EDGE)


def _in_blocks(members: DataFrame, key: str, size: DataFrame, block: int) -> DataFrame:
    """members (key, node, ...) with their part of the key's rows, once for each pair of parts (i, j) that it is in."""
    parts = members.join(size.select(key, F.ceil(F.col("m") / block).cast("int").alias("parts")).hint("merge"), key)
    parts = parts.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    return parts.withColumn("pair", F.explode(pairs)).select(*members.columns, "part", "pair.i", "pair.j")


def _missed(texts: DataFrame, labelled: DataFrame, docs: DataFrame, similarity: float) -> DataFrame | None:
    """Verified links (a, b) between components of labelled (node, component) that share buckets, or None where no bucket may hold any.

    First the signatures of such buckets' texts are compared in blocks.  What they suspect falls
    into clusters, and a cluster's texts are verified in blocks, so that a text is shuffled once a
    block and not once a pair, and no table has a row for each pair.
    """
    bound_batches(docs.sparkSession)
    slim = texts.select("node", F.explode("bands").alias("key")).join(labelled, "node")
    mixed = slim.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("m"))
    mixed = mixed.filter((F.col("least") < F.col("most")) & (F.col("m") > 2))  # of two texts the pivot was one, so they have been compared
    signed = texts.select("node", "n", "signature")
    members = _in_blocks(slim, "key", mixed, BLOCK).join(signed, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    suspected = cut(_suspected(members, similarity).distinct())
    if suspected.isEmpty():
        return None
    clusters = cut(components(suspected).select("node", F.col("component").alias("cluster")).join(labelled, "node"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"))
    blocks = _in_blocks(clusters, "cluster", sizes, TEXT_BLOCK).join(signed, "node").join(_texts_of(docs, cut(_places(clusters.select("node"), texts))).hint("merge"), "node")
    return cut(_linked_in_blocks(blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), similarity))


def _classed(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, h, worded (has a word), class_id, kept of every row; kept is on one text of each class, and on every row that has it."""
    rows = cut(signatures(docs.select("doc_id", "text")))
    known = rows.filter(F.col("fingerprint").isNotNull() & F.col("doc_id").isNotNull())
    texts = known.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    texts = cut(texts.select(F.monotonically_increasing_id().alias("node"), "fingerprint", F.col("r.doc_id").alias("id"), F.col("r.h").alias("h"), "n", "bands", "signature"))
    banded = texts.select("node", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("_most")).filter("a < _most").select("key", "a")
    stars = cut(banded.join(pivots, "key").filter("a < node").select("a", F.col("node").alias("b")).distinct())
    links = cut(verified(cut(_likely(stars, texts, similarity)), texts, docs, similarity))
    labelled = texts.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    labelled = cut(labelled)
    more = _missed(texts, labelled, docs, similarity)
    if more is not None and not more.isEmpty():  # these join whole components, so the first labels stay what they are joined from
        merged = components(more).select(F.col("node").alias("component"), F.col("component").alias("_to"))
        labelled = labelled.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    placed = texts.select("node", "fingerprint", "id", "h").join(labelled, "node")
    least = placed.groupBy("component").agg(F.min(F.struct("id", "h")).alias("r")).select("component", F.col("r.id").alias("class_id"), F.col("r.h").alias("_h"))
    classes = placed.select("fingerprint", "component").join(least.hint("merge"), "component").drop("component")
    joined = rows.select("doc_id", "h", "fingerprint").join(classes, "fingerprint", "left")
    worded = F.col("fingerprint").isNotNull()
    kept = F.when(worded, (F.col("doc_id") == F.col("class_id")) & (F.col("h") == F.col("_h"))).otherwise(F.col("doc_id").isNotNull())
    return joined.select("doc_id", "h", worded.alias("worded"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(kept, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept for every row of docs (doc_id, text).

    A class is a connected component of the links between documents whose shingle sets have a
    Jaccard similarity of at least `similarity` (ties with it included); class_id is its least
    doc_id, and kept says that the row has that id and, of several texts with it, the one that
    represents the class.  A text without a word (null, empty, marks only) links with nothing and is
    a class of its own.  Rows that repeat a doc_id are each classed by their own text, so unlike
    texts of one id are classes that share their class_id; rows that repeat whole are all kept or
    none.  Rows without a doc_id have the class of their text if it has one, and aren't kept.  Other
    columns are dropped; an empty table gives an empty one.
    """
    return _classed(docs, similarity).select("doc_id", "class_id", "kept")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class of near_duplicates(), with its columns as they are.

    It is the one of least doc_id; where unlike texts share that id, one of them, told by its text
    and not by the id alone; of rows that repeat id and text, one.  Texts without a word and rows
    without a doc_id all stay.  An empty table gives an empty one.
    """
    key = unused(docs, "_h")
    kept = _classed(docs, similarity).filter("kept").groupBy("doc_id", "h").agg(F.max("worded").alias("worded"), F.count("*").alias("rows"))
    kept = cut(kept.select(F.col("doc_id").alias("id"), "h", (F.col("worded") & (F.col("rows") > 1)).alias("again")))
    rows = docs.withColumn(key, text_hash("text"))
    chosen = rows.join(kept.select("id", "h"), (rows["doc_id"] == kept["id"]) & (rows[key] == kept["h"]), "left_semi")
    if not kept.filter("again").isEmpty():
        again = kept.filter("again").select("id", "h")
        condition = (rows["doc_id"] == again["id"]) & (rows[key] == again["h"])
        once = rows.join(again, condition, "left_semi").dropDuplicates(["doc_id", key])
        chosen = chosen.join(again, condition, "left_anti").unionByName(once)
    return chosen.drop(key).unionByName(docs.filter(F.col("doc_id").isNull()))
