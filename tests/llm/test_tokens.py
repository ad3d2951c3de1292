"""op1, op2, op5: packing, byte-level BPE, token counts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlens.llm.bpe import Merges, encode_texts
from meshlens.llm.packing import UNIT, Ids, pack, pack_documents, plan_packing, reduce_dominated, token_pieces
from meshlens.llm.token_counts import CHUNK, Counter, inner_pairs, spliced_count, token_counts

from .helpers import TEXTS, awkward_docs, empty_docs

ODD = [*"ab \n\t\x1c\x85\xa0é日́\U0001f600!1's,. ٣ⅷ​\x00ßẞ·×|%", "  ", "'s", "'ll", ", "]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fewest_bins(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([7, 12, 20, 31]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=8))))
def test_plan_holds_every_item_and_the_reduction_keeps_an_optimum(case):
    capacity, items = case
    histogram = {x: items.count(x) for x in items}
    packed, used = {}, 0
    for bins, inside in plan_packing(histogram, capacity):
        assert sum(length * each for length, each in inside) <= capacity
        used += bins
        for length, each in inside:
            packed[length] = packed.get(length, 0) + bins * each
    best = fewest_bins(items, capacity)
    assert packed == histogram
    assert best <= used <= best + 1
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] = n
    fixed = sum(bins for bins, _ in reduce_dominated(count, capacity))
    assert fixed + fewest_bins([x for x in range(capacity + 1) for _ in range(count[x])], capacity) == best


def test_plan_rejects_lengths_over_capacity():
    with pytest.raises(ValueError):
        plan_packing({11: 1}, 10)
    assert plan_packing({}, 10) == []


def test_units_give_the_ids_of_whole_texts():
    ids, rng = Ids("byte_bpe_50k.json"), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 24)))
        assert "".join(UNIT.findall(text)) == text
        assert ids([text])[0] == np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_ids_of_texts_with_added_tokens_are_the_library_s():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, rng = Ids("byte_bpe_50k.json"), random.Random(4)
    assert np.frombuffer(ids(["a <|endoftext|>b"])[0], "<u4").tolist().count(50256) == 1
    for _ in range(3000):
        text = "".join(rng.choice([*ODD, "<|endoftext|>", "<|endoftext|>", "<|", "<|endof", "|>"]) for _ in range(rng.randint(0, 24)))
        assert ids([text])[0] == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def check_packing(rows, capacity=2048):
    places = {}
    for r in rows:
        assert 1 <= r.length <= capacity
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pack_documents(spark):
    docs = awkward_docs(spark)
    rows = pack_documents(docs).collect()
    bins = check_packing(rows)
    assert bins <= -(-sum(r.length for r in rows) // 2048) + 2
    tokenizer = Ids("byte_bpe_50k.json").tokenizer
    for k, text in enumerate(TEXTS):
        if k == 6:
            continue  # this id repeats
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 2048 for r in mine[1:])
        for r in mine:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert pack_documents(empty_docs(spark)).collect() == []
    kept = token_pieces(docs, keep_ids=True).filter("doc_id = 5").collect()[0]
    assert kept.ids == [*tokenizer.encode("a", add_special_tokens=False).ids, 0]


def test_pack_general_rows(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", None), ("d", 10), ("d", 10), ("e", 0), ("f", 1)], "name string, length bigint")
    from pyspark.sql import functions as F

    df = df.withColumns({n: F.lit(1) for n in ("__part", "__rank", "__at", "__at_", "part", "before", "n", "rank", "sequence_id")})
    rows = pack(df, "length", 10).collect()
    assert set(pack(df, "length", 10).columns) == {*df.columns, "offset"}
    assert len(rows) == 7 and sorted(r.name for r in rows if r.sequence_id is None) == ["c", "e"]
    check_packing([r for r in rows if r.sequence_id is not None], 10)


def test_bpe_equals_the_library(spark, tiktoken_encoding):
    import regex

    merges, rng = Merges("byte_bpe_50k.tiktoken"), random.Random(4)
    words_of = regex.compile(public_tokenizers.PATTERN).findall
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    texts += ["".join(rng.choice("etaoinshrdlu ") for _ in range(400)) for _ in range(20)] + ["a" * 5000, "ab" * 900, " " * 3000, "!" * 1500]
    merges.learn({w for t in texts for w in words_of(t)})
    for t in texts:
        ids = b"".join(merges.ids[w] for w in words_of(t))
        assert ids == np.array(tiktoken_encoding.encode_ordinary(t), "<u4").tobytes(), repr(t[:60])
        assert merges.decode([ids]) == [t.encode()]
    rows = encode_texts(awkward_docs(spark), keep_ids=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = tiktoken_encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, text)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode_texts(empty_docs(spark)).collect() == []


def test_spliced_words_equal_whole_ones(monkeypatch):
    """Chunks so small that splices fail at first, too: then one begins anew, or goes on."""
    from meshlens.llm import bpe

    merges, rng = Merges("byte_bpe_50k.tiktoken"), random.Random(5)
    for chunk, step in ((12, 6), (5, 3), (2, 1)):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        monkeypatch.setattr(bpe, "STEP", step)
        monkeypatch.setattr(bpe, "SECTION", 7)
        for _ in range(15):
            alphabet = rng.choice(["abcéß!?", "a", "ab", "-= ", "etaoin", "日本"])
            word = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 70)))
            assert merges.encode_long(word.encode()) == merges.encode_words([word])[0], (chunk, word)


def test_a_long_word_and_a_huge_text(tiktoken_encoding, monkeypatch):
    import regex

    from meshlens.llm import bpe

    merges, rng = Merges("byte_bpe_50k.tiktoken"), random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "x" * 200_000]
    merges.learn(set(words))
    for w in words:
        assert merges.ids[w] == np.array(tiktoken_encoding.encode_ordinary(w), "<u4").tobytes()
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 20_000)
    text = " ".join(rng.choice(["alpha", "beta", "1999", "déjà", "\n\n", "x" * 700]) for _ in range(20_000))
    words_of = regex.compile(public_tokenizers.PATTERN).findall
    found = words_of(text)
    merges.learn(set(found))
    ids = b"".join(merges.ids[w] for w in found)
    assert len(ids) // 4 > 3 * bpe.DECODE_TOKENS, "several runs"
    assert merges.decode([ids[:8], ids, b"", ids[:4]]) == [*(merges.decode([ids[:8]])), text.encode(), b"", *merges.decode([ids[:4]])]


def test_texts_in_runs_equal_whole_ones(spark, monkeypatch):
    from meshlens.llm import bpe

    want = sorted(map(str, encode_texts(awkward_docs(spark), keep_ids=True).collect()))
    monkeypatch.setattr(bpe, "RUN_CHARS", 10)
    monkeypatch.setattr(bpe, "RUN_WORDS", 3)
    monkeypatch.setattr(bpe, "DECODE_TOKENS", 4)
    assert sorted(map(str, encode_texts(awkward_docs(spark).filter("length(text) < 100 or text is null"), keep_ids=True).collect())) == [r for r in want if len(r) < 3000]


def test_splicing_equals_whole_encoding():
    count, rng = Counter("piece_bpe_32k.model"), random.Random(6)
    assert count.splices
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", " ", "  ", "the ", "日本", " é", "x y", "\n", "▁", "́", "при", "в", "مر", "한국", "𝕏", "\U0001f600", "字"]) for _ in range(rng.randint(0, 120)))
        assert spliced_count(text, count.offsets, count.pairs, rng.randint(1, 30), rng.randint(1, 10)) == len(count.model.encode(text)), repr(text)
    for text in ("a" * 3000, "word " * 3000, " " * 2000):  # without a stable boundary the overlap widens to the whole
        assert spliced_count(text, count.offsets, count.pairs, 100, 10) == len(count.model.encode(text))
    assert inner_pairs(["▁a", "a▁b", "c"]) == {"▁a", "a▁", "▁b"}


def test_huge_texts_of_every_script_are_encoded_about_once():
    """What is encoded is at most 1.3 times the text, with spaces and without, and the counts are the library's."""
    count, rng = Counter("piece_bpe_32k.model"), random.Random(16)
    words = lambda low, high, space: space.join("".join(chr(rng.randint(low, high)) for _ in range(rng.randint(2, 9))) for _ in range(60_000 // 6))
    scripts = {"latin": (97, 122), "cyrillic": (0x430, 0x44F), "arabic": (0x627, 0x64A), "hindi": (0x905, 0x939), "chinese": (0x4E00, 0x5000), "korean": (0xAC00, 0xAD00)}
    for name, (low, high) in scripts.items():
        for space in (" ", "") if low > 0x3000 else (" ",):
            text, seen = words(low, high, space), []

            def encode(part, seen=seen):
                seen.append(len(part))
                return count.offsets(part)

            assert len(text) > 2 * CHUNK
            assert spliced_count(text, encode, count.pairs) == len(count.model.encode(text)), name
            assert sum(seen) <= 1.3 * len(text), (name, sum(seen) / len(text))


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = token_counts(awkward_docs(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
    assert token_counts(empty_docs(spark)).collect() == []
    words = token_counts(awkward_docs(spark), tokenizer="word_bpe_49k.json").filter("doc_id = 6").collect()
    assert {r.n_tokens for r in words} == {4}
