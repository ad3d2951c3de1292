"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database for each partition.

A batch's texts are split by the public pattern, and each distinct word is encoded once.  The
recursion holds token-position rows: each round joins neighbours with the merge table, contracts
every unfinished word's leftmost pair of minimum rank, and stops at the fixpoint.  Words are
remembered, so a partition's frequent words are encoded once.  Decoding joins ids with the
vocabulary and aggregates the bytes in order, in runs of bounded size.

A long word goes through the same recursion as overlapping chunks, all in the same rounds, which are
spliced at a token that both have in the same place.  That is exact: greedy merging keeps a boundary
between two tokens in a word if and only if it keeps it in the two alone (the first merge across any
boundary would be chosen among the two tokens' parts just as well), so the one sequence of tokens
whose neighbours all stand side by side in some chunk's encoding is the encoding of the word.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held, resolve

#: Words, and bytes of them and their ids, that a worker remembers; bytes of words in one recursion (bounds its memory).
CACHE = 800_000
CACHE_BYTES = 64 << 20
ROUND_BYTES = 300_000
#: Bytes of a chunk of a long word, and from one chunk's beginning to the next one's.
CHUNK, STEP = 256, 128
#: Chunks that are encoded before they are spliced, tokens that one query decodes, and words of a huge text at a time.
SECTION = 4096
DECODE_TOKENS = 500_000
RUN_CHARS = 4 << 20
RUN_WORDS = 200_000


class Merges:
    """The rank file as a merge table in DuckDB, and encode() and decode() over it."""

    def __init__(self, path: str) -> None:
        import duckdb

        with open(resolve(path), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        left, right, new = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    new.append(rank)
        self._table("merges", pair=pa.array(np.array(left, np.int64) << 32 | np.array(right, np.int64)), new_id=pa.array(new, pa.int64()))
        self._table("vocabulary", id=pa.array(list(ranks.values()), pa.int64()), token=pa.array(list(ranks), pa.binary()))
        self.size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size_of[rank] = len(token)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def _table(self, name: str, **columns: pa.Array) -> None:
        source = pa.table(columns)
        self.db.register("source", source)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM source")
        self.db.unregister("source")

    def encode_raw(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of each byte string by merges alone."""
        if not raw:
            return []
        sizes = np.array([len(x) for x in raw], np.int64)
        shift = str(int(sizes.max()).bit_length())
        starts = np.concatenate([[0], np.cumsum(sizes)])
        word = np.repeat(np.arange(len(raw)), sizes)
        ids = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        self._table("start", spot=pa.array((word << int(shift)) | np.arange(len(ids)) - starts[word]), id=pa.array(ids))
        self.db.execute(_RANKED_START.replace("SHIFT", shift))
        got = self.db.execute(_RECURSION.replace("SHIFT", shift)).fetchnumpy()
        ends = np.cumsum(np.bincount(got["word"], minlength=len(raw)))
        return np.split(np.asarray(got["id"]).astype("<u4"), ends[:-1])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers; a word that is a token isn't looked up."""
        return [x.tobytes() for x in self.encode_raw([w.encode() for w in words])]

    def in_rounds(self, raw: list[bytes]) -> list[np.ndarray]:
        """encode_raw() of many strings, in recursions of bounded size."""
        out, part, held = [], [], 0
        for x in chain(raw, [None]):
            if part and (x is None or held + len(x) > ROUND_BYTES):
                out += self.encode_raw(part)
                part, held = [], 0
            if x is not None:
                part.append(x)
                held += len(x)
        return out

    def encode_long(self, raw: bytes) -> bytes:
        """Ids of a word of any length, from overlapping chunks.

        Where two chunks have no token in common, the second begins anew at one of the first's
        boundaries; where that doesn't help either, the first goes on to the second's end.
        """
        size_of = self.size_of

        def spans(start: int, ids: np.ndarray) -> tuple[list[int], np.ndarray]:
            """Where the tokens begin, and, last, where they end."""
            return [start, *(start + np.cumsum(size_of[ids])).tolist()], ids

        def splice(first: tuple, second: tuple) -> tuple[int, int] | None:
            """The numbers of a token in both that has the same place."""
            (edges, _), (others, _) = first, second
            where = {a: k for k, a in enumerate(others[:-1])}
            for k in range(int(np.searchsorted(edges, others[0])), len(edges) - 1):
                j = where.get(edges[k])
                if j is not None and others[j + 1] == edges[k + 1]:
                    return k, j
            return None

        starts = list(range(0, max(1, len(raw) - CHUNK + STEP), STEP))
        out: list[bytes] = []
        now: tuple | None = None
        for section in range(0, len(starts), SECTION):
            places = starts[section : section + SECTION]
            texts = [raw[a : a + CHUNK] for a in places]
            distinct = list(dict.fromkeys(texts))
            known = dict(zip(distinct, self.in_rounds(distinct), strict=True))
            for start, text in zip(places, texts, strict=True):
                following = spans(start, known[text])
                if now is None:
                    now = following
                    continue
                stop = start + len(text)
                at = splice(now, following)
                if at is None:
                    middle = (start + now[0][-1]) // 2
                    begin = min(now[0][:-1], key=lambda p: abs(p - middle))
                    following = spans(begin, self.encode_raw([raw[begin:stop]])[0])
                    at = splice(now, following)
                if at is None:
                    now = spans(now[0][0], self.encode_raw([raw[now[0][0] : stop]])[0])
                    continue
                k, j = at
                out.append(now[1][:k].tobytes())
                now = following[0][j:], following[1][j:]
        return b"".join([*out, now[1].tobytes()])

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't remembered, in rounds of bounded size."""
        new = sorted(words - self.ids.keys(), key=len)
        if len(self.ids) + len(new) > CACHE or self.held > CACHE_BYTES:
            self.ids.clear()
            self.held = 0
            new = sorted(words, key=len)
        short, raws = [], []
        for w in new:
            raw = w.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.ids[w] = whole.to_bytes(4, "little")
            elif len(raw) > CHUNK:
                self.ids[w] = self.encode_long(raw)
                self.held += len(raw) + len(self.ids[w])
            else:
                short.append(w)
                raws.append(raw)
                self.held += 3 * len(raw)
        self.ids.update(zip(short, (x.tobytes() for x in self.in_rounds(raws)), strict=True))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        out: list[list[bytes]] = [[] for _ in ids]
        run: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            sizes = np.array([len(x) // 4 for _, x in run], np.int64)
            flat = np.frombuffer(b"".join(x for _, x in run), "<u4").astype(np.int64)
            self._table("coded", part=pa.array(np.repeat(np.arange(len(run)), sizes)), pos=pa.array(np.arange(len(flat))), id=pa.array(flat))
            for part, text in self.db.execute(_DECODE).fetchall():
                out[run[part][0]].append(base64.b16decode(text))
            run.clear()

        for k, x in enumerate(ids):
            for at in range(0, len(x), 4 * DECODE_TOKENS):
                part = x[at : at + 4 * DECODE_TOKENS]
                if run and held + len(part) > 4 * DECODE_TOKENS:
                    flush()
                    held = 0
                run.append((k, part))
                held += len(part)
        if run:
            flush()
        return [b"".join(x) for x in out]


#: The recursion.  A row's spot is its word << SHIFT and its place in the word, so one order has every word's tokens together.
#: `step` has the rows of one round, each with its word's best pair: the least (rank, spot), held in one number.  A round
#: contracts it: its row takes the new id, the row after goes, and the row before sees the new id.  New pairs, (left id << 32 |
#: right id), are looked up in the merge table.  A word without a pair leaves the recursion with its last rows.
_RECURSION = """
WITH RECURSIVE step(spot, id, best) AS (
    SELECT r.spot, r.id, b.best
    FROM ranked_start r JOIN (SELECT spot >> SHIFT AS word, min(best) AS best FROM ranked_start GROUP BY 1) b ON b.word = r.spot >> SHIFT
    UNION ALL
    (WITH moved AS (
        SELECT spot, CASE WHEN spot = best & 4294967295 THEN best >> 32 ELSE id END AS id,
            CASE WHEN spot = best & 4294967295 THEN CASE WHEN after_next >> SHIFT = spot >> SHIFT THEN (best >> 32 << 32) | second_id END
                 WHEN after >> SHIFT <> spot >> SHIFT THEN NULL
                 WHEN after = best & 4294967295 THEN (id << 32) | (best >> 32)
                 ELSE (id << 32) | next_id END AS pair
        FROM (
            SELECT spot, id, best, lag(spot) OVER w AS before, lead(spot) OVER w AS after, lead(spot, 2) OVER w AS after_next,
                   lead(id) OVER w AS next_id, lead(id, 2) OVER w AS second_id
            FROM step WHERE best IS NOT NULL
            WINDOW w AS (ORDER BY spot)
        )
        WHERE before IS NULL OR before <> best & 4294967295
    ), ranked AS MATERIALIZED (
        SELECT p.spot, p.id, m.new_id << 32 | p.spot AS best FROM moved p LEFT JOIN merges m ON m.pair = p.pair
    ), least AS (
        SELECT spot >> SHIFT AS word, min(best) AS best FROM ranked GROUP BY 1
    )
    SELECT r.spot, r.id, b.best FROM ranked r JOIN least b ON b.word = r.spot >> SHIFT)
)
SELECT spot >> SHIFT AS word, id FROM step WHERE best IS NULL ORDER BY spot
"""

_RANKED_START = """
CREATE OR REPLACE TABLE ranked_start AS
SELECT p.spot, p.id, m.new_id << 32 | p.spot AS best
FROM (
    SELECT spot, id, CASE WHEN lead(spot) OVER w >> SHIFT = spot >> SHIFT THEN (id << 32) | lead(id) OVER w END AS pair FROM start WINDOW w AS (ORDER BY spot)
) p LEFT JOIN merges m ON m.pair = p.pair
"""

_DECODE = """
SELECT c.part, string_agg(hex(v.token), '' ORDER BY c.pos) FROM coded c JOIN vocabulary v ON v.id = c.id GROUP BY c.part ORDER BY c.part
"""


def merges_of(path: str) -> Merges:
    """The worker's own database for a rank file."""
    mine = held("bpe")
    if path not in mine:
        mine[path] = Merges(path)
    return mine[path]


def _runs(words: Iterator[str]) -> Iterator[list[str]]:
    while run := list(islice(words, RUN_WORDS)):
        yield run


def encode_texts(docs: DataFrame, ranks: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Whole texts to ids and back: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids and decoded.

    Each match of the pattern (the public one by default) is encoded on its own.  Digests are of the
    ids as little-endian unsigned 32-bit integers and of the bytes that decoding the ids gives.  Null
    text is empty text: no tokens.  Equal texts give equal rows and rows that repeat stay; other
    columns are dropped, an empty table gives an empty one.  Huge texts go through in runs of words,
    so that only their digests are held unless keep_ids is set.
    """
    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def make():
        import public_tokenizers
        import regex

        words_of = regex.compile(pattern or public_tokenizers.PATTERN)
        merges = merges_of(ranks)

        def encoded(words: list[list[str]]) -> list[bytes]:
            merges.learn({w for x in words for w in x})
            get = merges.ids.__getitem__
            return [b"".join(map(get, x)) for x in words]

        def huge(text: str) -> tuple:
            n, digests, parts = 0, (hashlib.sha256(), hashlib.sha256()), ([], [])
            for run in _runs(m[0] for m in words_of.finditer(text)):
                ids = encoded([run])
                n += len(ids[0]) // 4
                for digest, part, x in zip(digests, parts, (ids[0], merges.decode(ids)[0]), strict=True):
                    digest.update(x)
                    if keep_ids:
                        part.append(x)
            return n, digests[0].hexdigest(), digests[1].hexdigest(), *map(b"".join, parts)

        def f(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            small = [k for k, t in enumerate(texts) if len(t) <= RUN_CHARS]
            ids = encoded([words_of.findall(texts[k]) for k in small])
            rows = {k: (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(t).hexdigest(), x, t) for k, x, t in zip(small, ids, merges.decode(ids), strict=True)}
            got = [rows[k] if k in rows else huge(t) for k, t in enumerate(texts)]
            out = {id_col: batch.column(0), "n_tokens": [r[0] for r in got], "ids_sha256": [r[1] for r in got], "decoded_sha256": [r[2] for r in got]}
            return out | {"ids": [np.frombuffer(r[3], "<u4").astype(np.int32) for r in got], "decoded": [r[4].decode() for r in got]} if keep_ids else out

        return f

    return arrow_map(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), make, schema, text_col=1)
