"""The positional index, Delta Lloyd and fill-in-the-middle against plain loops."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from meshlens.llm import fim, inverted, lloyd

from .helpers import TEXTS, awkward_docs, empty_docs


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items, window=10):
    rows = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item_id, item in items:
            ws = words_of(item)
            k = min(len(ws), window)
            for s in range(len(ws) - k + 1) if k else ():
                for at in range(len(words) - k + 1):
                    if words[at : at + k] == ws[s : s + k]:
                        hit |= set(range(at, at + k))
                        found.add("" if item_id is None else str(item_id))
        rows.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return rows


def key(row):
    return tuple("" if x is None else str(x) for x in row)


def test_tokens_are_words_of_each_text():
    texts = [*TEXTS, "A-b", None, "é", "Éa1 b", ""]
    for array in (pa.array(texts), pa.array(["before", *texts])[1:]):
        words, counts = inverted.tokens(array)
        assert words.to_pylist() == [w for t in texts for w in words_of(t)]
        assert counts.tolist() == [len(words_of(t)) for t in texts]
    assert inverted.tokens(pa.array([], pa.string()))[1].tolist() == []


def some_texts(seed, n, longest, vocabulary="abcde"):
    rng = random.Random(seed)
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("window", [1, 3, 10])
def test_windows_equal_plain_loops(spark, window, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_WORDS", 40)  # several blocks of items
    docs = list(enumerate(some_texts(1, 40, 60)))
    items = [(k, t) for k, t in enumerate(some_texts(2, 12, 20))] + [(3, "a b c d e a"), (None, "e d c b a")]
    texts = dict(docs)
    items.append((99, texts[7]))
    got = inverted.contamination(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id int, text string"), window)
    assert sorted(map(tuple, got.collect())) == sorted(brute_contamination(docs, items, window))


def test_contamination_of_awkward_tables(spark):
    docs, none = awkward_docs(spark), empty_docs(spark)
    items = spark.createDataFrame([(1, "One TWO three four five six seven eight nine ten"), (2, None), (3, "hello world"), (4, "日本語 😀"), (5, ""), (6, "nowhere to be found")], "item_id bigint, text string")
    items = items.selectExpr("*", "1 AS item", "2 AS shard", "3 AS term")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    got = inverted.contamination(docs, items)
    assert sorted(map(key, got.collect())) == sorted(map(key, brute_contamination(plain, [(r.item_id, r.text) for r in items.collect()])))
    assert inverted.contamination(none, items).count() == 0
    bare = inverted.contamination(docs, items.limit(0))
    assert bare.count() == len(plain) and bare.filter("contaminated OR n_items > 0").count() == 0


def test_proximity_equals_plain_loops(spark):
    docs = list(enumerate(some_texts(3, 30, 50, "abcdefgh")))
    items = list(enumerate(["a b c", "h", "g g a", "x a", "", "e f g h a"]))
    index = inverted.PositionalIndex.build(spark.createDataFrame(docs, "doc_id bigint, text string"), shard_bytes=300)
    for within in (3, 6):
        found = index.proximity_matches(spark.createDataFrame(items, "item bigint, text string"), within)
        got = found.join(index.documents(), ["shard", "at"]).select("doc_id", "item", "start", "end").collect()
        want = []
        for d, text in docs:
            words = words_of(text)
            for i, item in items:
                need = set(words_of(item))
                good = {(s, e) for s in range(len(words)) for e in range(s + 1, min(s + within, len(words)) + 1) if need and need <= set(words[s:e])}
                want += [(d, i, s, e) for s, e in good if not any((a, b) != (s, e) and s <= a and b <= e for a, b in good)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert index.table.filter("term IS NULL").count() > 3  # shards


def plain_lloyd(rows, k, rounds):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, owners, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), centroids


def test_delta_lloyd_equals_plain_lloyd(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] * 0.2 + rng.normal(size=64) * 0.05).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[i][1]) for i in range(9)]  # repeated rows
    rows += [(900 + i, [float(i % 2)] * 64) for i in range(6)] + [(950, [50_000.0] * 64)]  # ties, and beyond what doubles hold exactly
    bad = [(1000, None), (1001, [1.0] * 63), (1002, [None, *[1.0] * 63]), (1003, [float("nan"), *[1.0] * 63]), (1004, [float("inf"), *[1.0] * 63]), (1005, [])]
    vectors = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").selectExpr("*", "7 AS cluster", "8 AS block", "9 AS distance")
    done = lloyd.delta_lloyd(vectors.repartition(3), k=6, rounds=7)
    want, centroids = plain_lloyd(rows, 6, 7)
    assert sorted(map(tuple, done.assignments.collect())) == want
    assert done.centroids.tolist() == centroids
    assert sum(done.inertias) == sum(d for _, _, d in want)
    full = len(rows) * 6
    assert done.rounds[0]["compared"] == full and min(r["compared"] for r in done.rounds) < full / 2  # later rounds compare less


def test_few_repeated_and_no_vectors(spark):
    one = spark.createDataFrame([(None, [0.5] * 64), (4, [0.5] * 64), (4, [0.5] * 64)], "vec_id bigint, embedding array<double>")
    got = lloyd.cluster_report(one)
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.inertia) for r in got.collect()) == [("4", 0, 0, 0), ("4", 0, 0, 0), ("None", 0, 0, 0)]
    assert lloyd.cluster_report(one.limit(0)).collect() == []
    with pytest.raises(ValueError):
        lloyd.delta_lloyd(one, dims=100)


def test_extreme_components_are_bounded(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    done = lloyd.delta_lloyd(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), k=1, rounds=0)
    assert all(r.distance in (0, 64 * lloyd.LARGEST**2, 256 * lloyd.LARGEST**2) for r in done.assignments.collect())
    assert lloyd.squared_distances(np.array([[1 << 27] * 64]), np.array([[-(1 << 27)] * 64]))[0, 0] == 1 << 62


def plain_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return (doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 100)])
def test_fim_equals_plain_loops(spark, rate, spm):
    texts = [*TEXTS, "a\n\nb", "\n", "no end", "x\r\ny\r\n", "a<P\n>b<\nS>", "has <M>\nmark", "😀é\n日本\n" * 40, "a\n" * 20_000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)] + [(None, "a\nb\nc"), (3, "same\nid"), (3, "same\nid"), (3, "same\nid\nother")], "doc_id bigint, text string")
    docs = docs.selectExpr("*", "1 AS row", "2 AS n", "3 AS ordinal", "4 AS form", "5 AS `first`", "6 AS _row", "7 AS `a``b`")
    made = fim.fill_in_middle(docs, rate=rate, spm=spm).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form")))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "text", "back").collect()
    assert all(r.text == r.back for r in got)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain_fim(r.doc_id, r.text, rate, spm) for r in docs.collect()), key=key)


def test_fim_of_awkward_tables(spark):
    docs = awkward_docs(spark)
    got = fim.fim_digests(docs).collect()
    want = [plain_fim(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(key(r[:6]) for r in got) == sorted(key((*w[:5], hashlib.sha256(w[5].encode()).hexdigest())) for w in want)
    assert fim.fim_digests(empty_docs(spark)).collect() == []


def test_sentinels_must_not_overlap():
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<P>", "x<P>", "y")):
        with pytest.raises(ValueError):
            fim.Sentinels(*marks)


def test_fim_with_other_units_and_marks(spark):
    docs = spark.createDataFrame([(k, "one two  three\nfour " * k) for k in range(20)], "doc_id bigint, text string")
    marks = fim.Sentinels("[pre]", "[suf]", "[mid]")
    made = fim.fill_in_middle(docs, unit=r"\S+|\s+", marks=marks)
    assert made.filter(fim.restored(fim.F.col("output"), fim.F.col("form"), marks) != fim.F.col("text")).count() == 0
    assert made.filter("form <> 'plain'").count() == 19
