"""op4, op6, op9, op10 and the pipeline: near-duplicates, language, quality, embeddings."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlens.llm import language, minhash, quality
from meshlens.llm.components import components
from meshlens.llm.embeddings import calibrated_count, linked, near_duplicate_vectors, unit
from meshlens.llm.minhash import Shingler, near_duplicates, probminhash

from .helpers import TEXTS, awkward_docs, empty_docs

SF = "/root/testdata/sf0.001"


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def brute_classes(docs, similarity=0.8):
    shingler = Shingler()
    with np.errstate(over="ignore"):
        sets = {i: frozenset(shingler(t or "")[0].tolist()) for i, t in docs}
    groups, some = Groups(sets), [i for i in sets if sets[i]]
    for k, a in enumerate(some):
        for b in some[:k]:
            if min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    groups.join(a, b)
    return {i: groups.find(i) for i in sets}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (30, 20), (200, 150), (60, 59)):
        links = [(k, k + 1) for k in range(m)] if m == n - 1 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        groups = Groups(range(n))
        for a, b in links:
            groups.join(a, b)
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        assert got == {x: groups.find(x) for a, b in links if a != b for x in (a, b)}


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        n = int(rng.integers(1, 60))
        items = rng.integers(0, 2**63, n, np.int64).astype(np.uint64)
        a, b = (rng.integers(0, 4, n).astype(float) for _ in range(2))
        a[0] = b[0] = 1.0
        exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(n) if a[i] and b[i])
        with np.errstate(over="ignore"):
            got = probminhash([items[a > 0], items[b > 0]], [a[a > 0], b[b > 0]], 1000)
        errors.append((got[0] == got[1]).mean() - exact)
    assert np.abs(errors).max() < 0.07 and abs(np.mean(errors)) < 0.01
    assert probminhash([np.zeros(0, np.uint64)], [np.zeros(0)], 5).tolist() == [[0] * 5]


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    docs, at = [], 0
    for _ in range(12):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(30, 200))]
        for n in range(rng.randint(1, 25)):
            docs.append((at, " ".join(base if n % 4 == 1 else edited(base, rng, rng.randint(0, len(base) // 18)))))
            at += rng.randint(1, 3)
    rng.shuffle(docs)
    want = brute_classes(docs)
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    assert {r.doc_id: r.class_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_near_duplicates_that_repeat_a_passage_equal_brute_force(spark):
    """A passage that one copy repeats changes its shingle set little, however often it stands there."""
    rng = random.Random(6)
    docs = []
    for k in range(16):
        base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        copy = edited(base, rng, k % 5)
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy + copy[100 : 160 + 2 * k] * (20 + 20 * k)))]
    want = brute_classes(docs)
    assert all(want[2 * k + 1] == 2 * k for k in range(16))
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == want


def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == want


def test_buckets_over_a_block(spark, monkeypatch):
    """Blocks find links that no star has: a chain of neighbours in one bucket."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 3)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(100)]
    docs, text = [], list(base)
    for k in range(30):
        docs.append((k, " ".join(text)))
        text[k * 3] = f"x{rng.randrange(10**6)}"
    assert {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()} == brute_classes(docs)


def test_near_duplicates_of_awkward_documents(spark):
    rows = near_duplicates(awkward_docs(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    by_id = {r.doc_id: r.class_id for r in rows}
    assert [by_id[k] for k in range(5)] == list(range(5)), "texts without a word are classes of their own"
    assert by_id[6] == by_id[7] == by_id[8] == 6 and by_id[13] == by_id[14] == 13
    kept = minhash.drop_near_duplicates(awkward_docs(spark))
    assert kept.columns == awkward_docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [k for k in range(len(TEXTS)) if k not in (7, 8, 14)]
    assert near_duplicates(empty_docs(spark)).collect() == [] and minhash.drop_near_duplicates(empty_docs(spark)).collect() == []


def test_rows_that_share_an_id_are_known_by_their_text(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (5, b), (5, c), (5, c), (7, c), (8, d), (8, a), (9, None), (9, None), (9, "..."), (None, a), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("h", "_h", "__kept", "_kept", "node", "id", "again", "worded", "class_id", "component", "fingerprint"):
        df = df.withColumn(name, F.lit(name))
    got = sorted((r.doc_id, r.class_id) for r in near_duplicates(df).collect() if r.doc_id is not None)
    assert got == [(1, 1), (5, 5), (5, 5), (5, 5), (7, 5), (8, 1), (8, 8), (9, 9), (9, 9), (9, 9)]
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    left = sorted(((r.doc_id or -1, r.text or "") for r in kept.collect()))
    assert left == sorted([(1, a), (5, b), (5, c), (8, d), (9, ""), (9, ""), (9, "..."), (-1, a), (-1, "")])


def test_recall_against_an_exact_join_by_similarity(spark):
    """Of the pairs of a real table and of edited ones, some with a passage many times over, at least 0.99 of each tenth share a class."""
    rng = random.Random(8)
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    at = 10**6
    for _ in range(150):
        base = [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(60, 150))]
        copy = edited(base, rng, rng.randint(0, len(base) // 40))
        docs += [(at, " ".join(base)), (at + 1, " ".join(copy + copy[10:30] * rng.choice((0, 0, 3, 300))))]
        at += 2
    shingler = Shingler()
    with np.errstate(over="ignore"):
        sets = {i: frozenset(shingler(t)[0].tolist()) for i, t in docs}
    holders = {}
    for i, x in sets.items():
        for e in x:
            holders.setdefault(e, []).append(i)
    shared = {}
    for ids in holders.values():
        if len(ids) < 60:
            for k, i in enumerate(ids):
                for j in ids[:k]:
                    shared[i, j] = shared.get((i, j), 0) + 1
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    buckets = {}
    for (i, j), both in shared.items():
        s = both / (len(sets[i]) + len(sets[j]) - both)
        if s >= 0.8:
            buckets.setdefault(min(int(s * 20), 19), []).append(got[i] == got[j])
    assert len(buckets) == 4 and all(np.mean(x) >= 0.99 for x in buckets.values()), {k: (len(x), np.mean(x)) for k, x in buckets.items()}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.languages(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97
    model = language.fit(docs)
    assert 0 < np.mean(model.weights != 0) < 0.5, "the penalties leave most weights at zero"
    awkward = {r.doc_id: r for r in language.identify(awkward_docs(spark), model).collect()}
    assert [awkward[k].lang_pred for k in range(5)] == ["und"] * 5 and awkward[5].lang_pred != "und"
    kept = language.drop_undetermined(awkward_docs(spark), model)
    assert kept.columns == awkward_docs(spark).columns and not {r.doc_id for r in kept.collect()} & set(range(5))


def test_language_without_rows_to_learn_from(spark):
    rows = language.languages(awkward_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in rows} == {"und"} and len(rows) == len(TEXTS) + 2
    assert language.languages(empty_docs(spark)).collect() == []


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.quality_scores(docs, labels).collect()]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in rows)
    scored = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a > b for a, q, _ in scored if q for b, p, _ in scored if not p]) > 0.95
    assert np.mean([q == p for _, q, p in scored]) > 0.93
    model = quality.fit(docs, labels)
    awkward = quality.score(awkward_docs(spark), model).collect()
    assert len(awkward) == len(TEXTS) + 2 and len({r.score for r in awkward if r.doc_id in (6, 7)}) == 1
    assert quality.drop_low_quality(awkward_docs(spark), model).columns == awkward_docs(spark).columns
    nothing = quality.quality_scores(awkward_docs(spark), labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}
    assert quality.quality_scores(empty_docs(spark), labels).collect() == []


def brute_vectors(rows, similarity=0.93):
    fine = {i: unit(np.array([v], float))[0] for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    labels = {i: label for i, _, label in rows}
    groups, links = Groups(labels), {i: 0 for i in labels}
    for a in fine:
        for b in fine:
            if a < b and labels[a] == labels[b] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= similarity:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {i: (links[i], groups.find(i)) for i in labels}


@pytest.mark.parametrize(("block", "target"), [(1024, 256), (16, 256), (16, 4)])
def test_vectors_equal_brute_force(spark, monkeypatch, block, target):
    from meshlens.llm import embeddings

    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "TARGET", target)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        near = rows[rng.integers(len(rows))] if rows and rng.random() < 0.5 else None
        v = np.array(near[1]) + rng.normal(0, 0.11 * rng.random(), 16) if near else rng.normal(0, 1, 16)
        rows.append((k, [float(x) for x in v.astype(np.float32)], near[2] if near else int(rng.integers(3))))
    rows += [(900 + k, rows[5][1], rows[5][2]) for k in range(9)]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [nan] + [1.0] * 15, 1), (1004, [inf] + [1.0] * 15, 1), (1005, rows[0][1], None), (1006, [1.0, 2.0], 1), (1007, [1e-30, 2e-30], 1), (1008, [None, 1.0], 1)]
    rows += [(1100, [0.1, 0.7], 4), (1101, [0.1 + 1e-12, 0.7], 4), (1102, [1e300, 7e300], 4), (1103, [0.5, 3.5], 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, rep int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()}
    want = brute_vectors(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(rows)
    assert near_duplicate_vectors(df.limit(0)).collect() == []


def test_recall_on_spread_vectors(spark):
    """A label of 20 000 vectors that lie anywhere, a tenth of them beside another at 0.93 to 1: links against brute force, and few copies."""
    from meshlens.llm.embeddings import cells_of

    rng = np.random.default_rng(5)
    base = unit(rng.normal(0, 1, (18_000, 32)))
    d = rng.normal(0, 1, (2000, 32))
    side = unit(d - (d * base[:2000]).sum(1, keepdims=True) * base[:2000])
    cos = rng.uniform(0.93, 1, (2000, 1))
    x = np.r_[base, cos * base[:2000] + np.sqrt(1 - cos**2) * side]
    want = np.zeros(len(x), int)
    for k in range(0, len(x), 1000):
        want[k : k + 1000] = (unit(x[k : k + 1000]) @ unit(x).T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = np.zeros(len(x), int)
    for r in near_duplicate_vectors(df).collect():
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() > 3900 * 0.99
    assert [cells_of(n)[0] for n in (1, 512, 513, 50_000)] == [0, 0, 1, 7] and cells_of(50_000)[1] < 25 and cells_of(10**8)[1] < 150


def test_counting_misses_few_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    a = unit(rng.normal(0, 1, (2000, 64)))
    d = rng.normal(0, 1, a.shape)
    side = d - (d * a).sum(1, keepdims=True) * a
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * unit(side)
    found = sum(len(linked(a[k : k + 1], b[k : k + 1])[0]) for k in range(len(a)))
    assert found / len(a) > 0.995
    assert 1 <= calibrated_count() <= 32


def test_pipeline_equals_its_stages_by_hand(spark):
    import corpus_pipeline
    from meshlens.llm.packing import pack_documents

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = language.fit(docs)
    rows = [r for r in docs.collect() if (got := model.predict(r.text))[0] != "und" and got[1] >= language.MIN_SCORE]
    first = spark.createDataFrame(rows, docs.schema)
    judge = quality.fit(first, labels)
    sizer = quality.Sizer(judge.good, judge.bad)
    rows = [r for r in rows if 1 / (1 + np.exp(-(((np.array(sizer(r.text)) - judge.mean) / judge.scale) @ judge.weights[:-1] + judge.weights[-1]))) >= quality.THRESHOLD]
    classes = brute_classes([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if classes[r.doc_id] == r.doc_id]
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    got = corpus_pipeline.run(spark, SF).collect()
    want = pack_documents(spark.createDataFrame(rows, docs.schema)).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert len({r.sequence_id for r in got}) == len({r.sequence_id for r in want})
    assert 0 < len(rows) < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "minhash_near_dedup", "best_fit_packing"]


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(12):
        found = np.sort(rng.choice(50, 6, replace=False))
        rows.append((found, rng.random(6), int(rng.integers(3))))
    got = language.ftrl(rows, 3, epochs=2)
    alpha, beta, l1, l2 = language.ALPHA, language.BETA, language.L1, language.L2
    z, n = {}, {}

    def weight(f, c):
        a = z.get((f, c), 0.0)
        return 0.0 if abs(a) <= l1 else -(a - (l1 if a > 0 else -l1)) / ((beta + n.get((f, c), 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            found, x, label = rows[k]
            logits = [sum(v * weight(f, c) for f, v in zip(found, x, strict=True)) for c in range(3)]
            total = sum(np.exp(v) for v in logits)
            for c in range(3):
                error = np.exp(logits[c]) / total - (c == label)
                for f, v in zip(found, x, strict=True):
                    g, before = v * error, weight(f, c)
                    was = n.get((f, c), 0.0)
                    n[f, c] = was + g * g
                    z[f, c] = z.get((f, c), 0.0) + g - (n[f, c] ** 0.5 - was**0.5) / alpha * before
    want = np.zeros_like(got)
    for f in range(50):
        for c in range(3):
            want[f, c] = weight(f, c)
    assert np.allclose(got, want)


def test_ngram_counts_equal_a_plain_loop():
    for text in ("", "a", "Ab ba\n\tab", "日本 é" * 20):
        codes = [32 if ord(c) < 33 else ord(c) for c in f" {text.lower()} "]
        want = {}
        for size in range(1, language.ORDERS + 1):
            for k in range(len(codes) - size + 1):
                rolled = codes[k]
                for c in codes[k + 1 : k + size]:
                    rolled = (rolled * 0x01000193 + c) % 2**32
                bucket = (rolled + size) * 2654435761 % 2**32 >> (32 - language.BITS)
                want[bucket] = want.get(bucket, 0) + 1
        found, n = language.counts_of(text)
        assert dict(zip(found.tolist(), n.tolist(), strict=True)) == want


def test_sizes_and_scores_equal_a_plain_loop(spark):
    import zstandard

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").limit(60).collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for key, text in texts.items():
        raw = text.encode()
        blocks = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)] or [b""]
        sizes = []
        for data in (model.good, model.bad, None):
            options = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
            size = lambda x, o=options: len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_dict_id=False, **o).compress(x))
            sizes.append(sum(size(x) - size(b"") for x in blocks))
        good, bad, plain = sizes
        n = len(raw) + quality.PRIOR_BYTES
        x = [(bad - good) / (max(good, bad) + quality.PRIOR_BYTES), (plain - good) / n, (plain - bad) / n, plain / n]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=False)) + model.weights[-1]
        assert got[key] == pytest.approx(1 / (1 + np.exp(-z)))


def test_samples_are_bounded_and_hold_every_label(spark):
    from meshlens.llm.sampling import excerpt, pick, texts_of

    rows = [(k, "common" if k % 500 else "rare", f"text {k}") for k in range(20_000)] + [(7, "common", f"other {k}") for k in range(3000)] + [(None, "common", "x"), (9, None, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, label string, text string")
    picked, sizes = pick(df.select("doc_id", "label"), 500)
    assert len(picked) <= 500 and len({i for i, _ in picked}) == len(picked) and set(sizes) == {"common", "rare"}
    assert 20 <= sum(label == "rare" for _, label in picked) <= 40 and not any(held_out(i) for i, _ in picked)
    again, _ = pick(df.select("doc_id", "label").repartition(7), 500)
    assert sorted(again) == sorted(picked)
    got = texts_of(df.select("doc_id", "text"), [(7, "common"), (8, "common"), (10**9, "rare")], "string")
    assert sorted(r[0] for r in got) == [7, 8]
    long = "".join(chr(97 + k % 26) for k in range(100_000))
    cut = spark.createDataFrame([(long,), ("short",), (None,)], "t string").select(excerpt(F.col("t")).alias("t")).collect()
    pieces = cut[0].t.split(" ")
    assert len(pieces) == 20 and all(len(p) == 1000 and p in long for p in pieces) and long.startswith(pieces[0]) and long.endswith(pieces[-1])
    assert cut[1].t == "short" and cut[2].t is None
    assert pick(df.limit(0).select("doc_id", "label"), 5) == ([], {})


def test_pipeline_of_no_documents_and_of_clashing_names(spark, tmp_path):
    """An empty table gives an empty one; columns that are named like the stages' own pass through them, whatever their names."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    some = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120").withColumns({n: F.lit(n) for n in ("_lang", "_score", "_h", "h", "node", "id", "kept", "class_id", "component", "label", "quality", "piece", "start", "a`b.c")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, some, SF)
        assert kept.columns == some.columns, name
        rows = kept.collect()
        assert rows and all(r["_score"] == "_score" and r["a`b.c"] == "a`b.c" for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() >= some.count()
