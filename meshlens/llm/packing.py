"""Best-fit packing with Martello-Toth dominance reduction.

Packing depends on lengths alone, and there are at most ``capacity`` different lengths.  So the
driver plans on the histogram of lengths (``capacity`` numbers, whatever the input's size), and the
plan, a bounded list of bin patterns with multiplicities, is then applied to the rows in parallel:
a row's rank among the rows of its length says which slot it takes.  No group of rows meets in one
task.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, arrow_schema, cut, extended, held, keep_first, quoted, resolve, unused

CAPACITY = 2048
#: Words whose ids a worker remembers at most.
CACHE = 500_000
#: Parts of a text that end where the byte-level pattern always ends a pre-token: a Latin word before a plain mark or white
#: space, plain marks before a Latin letter or white space, a line feed before anything else, or whatever comes before the
#: next white space.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r",.;:!?%$#&*|()\""
UNIT = re.compile(rf" ?[{_LETTERS}]+(?=[ \n\t\r{_MARKS}])| ?[{_MARKS}]+(?=[ \n\t\r{_LETTERS}])|\n(?=\S)|.+?(?:(?<=\S)(?=[ \n\t\r])|\Z)", re.S)
_RANK_BITS = 44
#: Columns that Ranks fills, where no other has their names.
PART, RANK = "__part", "__rank"


# ---------------------------------------------------------------- the plan (driver, on a histogram)


def reduce_dominated(count: np.ndarray, capacity: int) -> list[tuple[int, tuple]]:
    """Fixes bins that provably dominate every other bin holding their largest item; count is reduced in place.

    A feasible set dominates another if the other's items can be put, each whole, into the places of
    the first's items; then some optimal packing holds the first.  Tested are sets of one, two and
    three items, as in Martello and Toth's reduction, for all items of a length at once: removing
    items never makes a fixed set's rivals larger, so a test that holds for one item holds for as
    many as there are partners.  Returns (bins, ((length, items a bin), ...)).
    """
    fixed: list[tuple[int, tuple]] = []

    def fix(bins: int, *parts: int) -> None:
        inside: dict[int, int] = {}
        for p in parts:
            inside[p] = inside.get(p, 0) + 1
        for p, n in inside.items():
            count[p] -= bins * n
        fixed.append((bins, tuple(inside.items())))

    if count[capacity]:
        fix(int(count[capacity]), capacity)
    for s in range(capacity - 1, (capacity - 1) // 2, -1):  # two items that fill a bin
        bins = int(count[s] // 2 if 2 * s == capacity else min(count[s], count[capacity - s])) if capacity - s > 0 else 0
        if bins and s >= capacity - s:
            fix(bins, s, capacity - s)

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while count[s]:
                done = _dominating(count, capacity, s)
                if done is None:
                    break
                fix(*done)
                changed = True
    return fixed


def _dominating(count: np.ndarray, capacity: int, s: int) -> tuple | None:
    """(bins, lengths...) of a dominating set that holds an item of length s, or None."""
    room = capacity - s
    count[s] -= 1  # the item itself is no partner of its own
    try:
        small = np.flatnonzero(count[: room + 1])
        if not len(small):
            return _restored(count, s, int(count[s] + 1) if 2 * s > capacity else 1, (s,))
        least = np.repeat(small[:3], np.minimum(count[small[:3]], 3))[:3]
        a = int(small[-1])
        if len(least) == 1 or int(least[:2].sum()) > room:  # one more item fits at most
            return _restored(count, s, 0, (s, a))
        if len(least) == 3 and int(least.sum()) <= room:
            return None
        best = _best_pair(count, small, room)
        if best <= a:
            return _restored(count, s, 0, (s, a))
        count[a] -= 1
        under = np.flatnonzero(count[: room - a + 1]) if room > a else np.empty(0, int)
        b = int(under[-1]) if len(under) else 0
        between = np.flatnonzero(count[b + 1 : a + 1])[:2] + b + 1
        two = np.repeat(between, np.minimum(count[between], 2))[:2]
        count[a] += 1
        if b and not (len(two) == 2 and a < int(two.sum()) <= room):
            return _restored(count, s, 0, (s, a, b))
        return None
    finally:
        count[s] += 1


def _restored(count: np.ndarray, s: int, bins: int, parts: tuple) -> tuple:
    """As many bins as the items allow (count is short of one item of length s just now)."""
    if not bins:
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        bins = min((int(count[p]) + (p == s)) // n for p, n in need.items())
    return (bins, *parts)


def _best_pair(count: np.ndarray, small: np.ndarray, room: int) -> int:
    """The largest sum of two items that is at most room; 0 if there is none."""
    at = np.searchsorted(small, room - small, side="right") - 1
    ok = at >= 0
    other = small[np.maximum(at, 0)]
    same = ok & (other == small) & (count[small] < 2)
    lower = small[np.maximum(at - 1, 0)]
    sums = np.where(same, np.where(at > 0, small + lower, 0), small + other)
    return int(np.max(np.where(ok, sums, 0), initial=0))


def plan_packing(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for a histogram {length: items}: [(bins, [(length, items a bin), ...]), ...], at most a few for each length.

    First the dominance reduction, then best fit on the remaining items, longest first.  Items of one
    length go through best fit at once: the tightest bin that holds one takes as many as fit before
    the next bin is looked at, just as they would one by one.
    """
    if bad := [k for k, n in histogram.items() if n and not 0 < k <= capacity]:
        raise ValueError(f"lengths must be from 1 to {capacity}: {sorted(bad)[:5]}")
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] += n
    groups = [(bins, list(inside)) for bins, inside in reduce_dominated(count, capacity)]
    open_bins: dict[int, list] = {}  # room left: [(bins, contents)], contents a linked list
    rooms: list[int] = []

    def put(room: int, bins: int, contents: tuple) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(rooms, room)
        open_bins[room].append((bins, contents))

    for s in range(capacity, 0, -1):
        left = int(count[s])
        while left:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                bins, contents = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, contents = capacity, None
                bins = -(-left // (capacity // s))
            each = room // s
            full = min(bins, left // each)
            if full:
                put(room - each * s, full, (contents, s, each))
                left -= full * each
            if full < bins and left:
                put(room - left * s, 1, (contents, s, left))
                left, full = 0, full + 1
            if full < bins:
                put(room, bins - full, contents)
    for room in rooms:
        for bins, contents in open_bins[room]:
            inside = []
            while contents is not None:
                contents, s, each = contents
                inside.append((s, each))
            groups.append((bins, inside[::-1]))
    return groups


def slot_table(groups: list) -> dict[str, np.ndarray]:
    """The plan as sorted intervals of ranks: of the rows of a length, those from ``first`` on take these slots."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for bins, inside in groups:
        place = 0
        for length, each in inside:
            first = taken.get(length, 0)
            taken[length] = first + bins * each
            rows.append(((length << _RANK_BITS) + first, base, each, place))
            place += each * length
        base += bins
    got = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "base", "each", "place"), got.T.copy(), strict=True))


# ---------------------------------------------------------------- applying it (executors)


def pack(df: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (long) to every row; rows keep all their columns.

    Rows of a null length, or one below 1, get null in both; one above capacity is an error.  An
    empty table gives an empty one.  Columns called sequence_id or offset are replaced, columns of
    any other name are safe.  Rows that are equal in all columns are packed one by one like any others.
    """
    df = df.drop("sequence_id", "offset")
    names = unused(df, PART), unused(df, RANK)
    schema = extended(df.schema, f"{names[0]} int, {names[1]} bigint")

    def ranked():
        rank = Ranks()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            part, ranks = rank(batch.column(batch.schema.get_field_index(length_col)).to_pylist())
            extra = [pa.array(part, pa.int32()), pa.array(ranks, pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

        return f

    return _placed(arrow_map(df, ranked, schema), length_col, capacity, *names)


class Ranks:
    """Numbers the rows of each length within a task."""

    def __init__(self) -> None:
        self.seen: dict[int, int] = {}
        self.part = TaskContext.get().partitionId()

    def __call__(self, lengths: list[int]) -> tuple[list[int], list[int]]:
        """(the task's number, the rank) of each row."""
        ranks = []
        for n in lengths:
            ranks.append(self.seen.get(n, 0))
            self.seen[n] = ranks[-1] + 1
        return [self.part] * len(lengths), ranks


def _placed(rows: DataFrame, length_col: str, capacity: int, part: str = PART, rank: str = RANK) -> DataFrame:
    """Rows with the columns part and rank, which Ranks gave, by their slots."""
    fields = [f for f in rows.schema if f.name not in (part, rank)]
    schema = extended(fields, "sequence_id bigint, offset bigint")
    df = rows = cut(rows)
    at_name = unused(rows, "__at")
    counts = cut(rows.filter(F.col(length_col) >= 1).groupBy(F.col(part).alias("part"), F.col(length_col).alias("length")).agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    slots = slot_table(plan_packing(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = rows.join(starts, (rows[part] == starts["part"]) & (rows[length_col] == starts["length"]), "left")
    joined = joined.select(*[rows[quoted(f.name)] for f in fields], (rows[rank] + starts["before"]).alias(at_name))
    target = arrow_schema(df.sparkSession, schema)

    def placed():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            length = batch.column(batch.schema.get_field_index(length_col))
            known = np.asarray(batch.column(at_name).is_valid())
            n = np.asarray(length.fill_null(0)).astype(np.int64)
            at = np.asarray(batch.column(at_name).fill_null(0))
            if not len(slots["key"]):
                known = np.zeros(len(n), bool)
                where = np.zeros(len(n), np.int64)
                sequence = place = where
            else:
                key = (n << _RANK_BITS) + at
                i = np.maximum(np.searchsorted(slots["key"], key, side="right") - 1, 0)
                bin_no, inside = np.divmod(key - slots["key"][i], slots["each"][i])
                sequence, place = slots["base"][i] + bin_no, slots["place"][i] + inside * n
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != at_name]
            return pa.RecordBatch.from_arrays([*columns, pa.array(sequence, mask=~known), pa.array(place, mask=~known)], schema=target)

        return f

    return arrow_map(joined, placed, schema)


class Ids:
    """Ids of texts by a byte-level tokenizer file, as bytes; equal words are encoded once.

    A text is split only where the tokenizer's own pre-tokenizer always splits, and around its added
    tokens, so the ids are those of the whole text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(resolve(path))
        added = sorted(self.tokenizer.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))
        self.added = re.compile("(" + "|".join(re.escape(t.content) for t in added) + ")") if added else None
        #: Whether added tokens are found whatever is next to them and take nothing of it.
        self.apart = not any(t.lstrip or t.rstrip or t.single_word for t in added)
        self.known: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return UNIT.findall(text)
        if not self.apart:
            return [text]
        return [u for k, part in enumerate(self.added.split(text)) for u in ([part] if k % 2 else UNIT.findall(part))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        units = [self.units(t) for t in texts]
        new = list(set().union(*units).difference(self.known))
        if len(self.known) + len(new) > CACHE:
            keep_first(self.known, CACHE // 3)
            new = list(set().union(*units).difference(self.known))
        for u, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[u] = np.array(e.ids, "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in units]


def ids_of_worker(path: str) -> Ids:
    """The worker's own encoder for a tokenizer file; its memory of words lasts over tasks."""
    mine = held("packing")
    if path not in mine:
        mine[path] = Ids(path)
    return mine[path]


def token_pieces(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, ranked: bool = False
) -> DataFrame:
    """Documents as pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32 and, with keep_ids, ids.

    A document is its ids and then end_id.  Null text is an empty text, so each row gives a piece.
    Only documents over capacity are cut; their first piece takes the remainder.  Other columns are
    dropped.  With ranked, PART and RANK are added as pack() does, without another pass through Python.
    """
    schema = f"{id_col} bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids + f", {PART} int, {RANK} bigint" * ranked
    tail = np.array([end_id], "<u4").tobytes()

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = ids_of_worker(tokenizer)
        rank = Ranks() if ranked else None

        def f(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in (id_col, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids)}
            for key, ids in zip(batch.column(0).to_pylist(), ids_of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += tail
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    row = [key, k, a, b - a, zlib.crc32(part)]
                    for name, v in zip(out, [*row, np.frombuffer(part, "<u4").astype(np.int32)] if keep_ids else row, strict=True):
                        out[name].append(v)
            if rank:
                out[PART], out[RANK] = rank(out["length"])
            return out

        return f

    return arrow_map(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), make, schema, text_col=1)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """token_pieces() put into as few sequences of at most capacity tokens as best fit finds: plus sequence_id and offset.

    Null and empty texts are documents of the end token alone; documents that repeat are packed each;
    of pieces of one length it is arbitrary, but settled by their place in the table, which goes where.
    Other columns are dropped; an empty table gives an empty one.
    """
    return _placed(token_pieces(docs, capacity=capacity, ranked=True, **options), "length", capacity)
