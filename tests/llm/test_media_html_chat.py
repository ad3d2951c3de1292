"""op3, op7, op8: media columns, HTML extraction, chat formatting."""

import hashlib
import zlib

import numpy as np
import pytest

from meshlens.llm.chat import DIGEST_SQL, conversation_digests, examples, expand, format_turns, unescape
from meshlens.llm.html_blocks import blocks, path
from meshlens.llm.html_samples import FAMILIES, labelled_page
from meshlens.llm.html_text import Crf, extract_text, main_text, trained
from meshlens.llm.media import area_resize, decode, difference_hash, encode_bmp, encode_pgm, encode_ppm, media_tiles, npy_tile, text_media

from .helpers import TEXTS, awkward_docs, empty_docs


def naive_resize(image, height, width):
    fine = np.kron(image.astype(float), np.ones((height, width)))
    return fine.reshape(height, image.shape[0], width, image.shape[1]).mean(axis=(1, 3))


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (9, 8), (40, 64)])
def test_codecs_and_area_resize(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, np.uint8)
    colour = np.random.default_rng(2).integers(0, 256, (*shape, 3), np.uint8)
    for data, want in ((encode_pgm(image), image), (encode_bmp(image), image), (encode_ppm(colour), colour), (encode_bmp(colour), colour)):
        assert np.array_equal(decode(data), want)
    assert np.allclose(area_resize(image, 4, 7), naive_resize(image, 4, 7))
    assert np.load(__import__("io").BytesIO(npy_tile(image, 8))).shape == (8, 8)


def test_other_netpbm_and_broken_files():
    assert decode(b"P1 # note\n3 2\n0 1 0\n111").tolist() == [[1, 0, 1], [0, 0, 0]]
    assert decode(b"P2\n2 1\n9\n3 9").tolist() == [[3, 9]]
    assert decode(b"P4\n9 1\n\x80\x80").tolist() == [[0, 1, 1, 1, 1, 1, 1, 1, 0]]
    assert decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    for broken in (b"", b"GIF89a", b"P5\n4 4\n255\nab", b"P5\n4", b"BM" + bytes(80)):
        with pytest.raises(ValueError):
            decode(broken)
    assert difference_hash(np.arange(9, dtype=np.uint8)[None, :].repeat(8, 0)) == "ff" * 8


def test_decoding_errors_are_values_errors_and_tiles_keep_their_range(spark):
    bmp = bytearray(encode_bmp(np.full((4, 4), 200, np.uint8)))
    bmp[46:50] = (2).to_bytes(4, "little")  # a palette of two colours
    broken = [bytes(bmp), b"P2\n1 1\n255\n" + b"9" * 23, b"P2\n1 1\n255\n" + b"9" * 5000, b"P2\n1 1\n255\n-5", b"P5 99999999999 1 255\n", b"P2 1 1 0\n0", b"P5 1 1 9\n\xc8", b"P2 1 1 9\nx"]
    deep = np.full((3, 3, 3), 40000, np.uint16)
    fine = b"P6 3 3 65535\n" + deep.astype(">u2").tobytes()
    df = spark.createDataFrame([*((k, bytearray(b)) for k, b in enumerate(broken)), (100, bytearray(fine)), (101, bytearray(b"P6 0 0 255\n"))], "doc_id bigint, media binary")
    rows = {r.doc_id: r for r in media_tiles(df, side=2).collect()}
    assert all(rows[k].error and rows[k].tile is None for k in range(len(broken)))
    tile = np.load(__import__("io").BytesIO(bytes(rows[100].tile)))
    assert tile.dtype == np.uint16 and (tile == 40000).all() and rows[100].channels == 3
    assert rows[101].error is None and rows[101].height == 0
    wide = np.random.default_rng(3).integers(0, 256, (3, 70), np.uint8)
    assert np.allclose(area_resize(wide, 2, 5), naive_resize(wide, 2, 5))


def test_strips_of_long_rows(monkeypatch):
    from meshlens.llm import media

    image = np.random.default_rng(4).integers(0, 256, (40, 64), np.uint8)
    monkeypatch.setattr(media, "STRIP_SAMPLES", 200)
    assert np.allclose(area_resize(image, 4, 7), naive_resize(image, 4, 7))


def test_payloads_are_stored_by_turns_in_every_container():
    from meshlens.llm.media import container_of, store_payload

    rng, seen = np.random.default_rng(4), set()
    for k in range(60):
        payload = rng.integers(0, 256, 64 * int(rng.integers(1, 13)), np.uint8).tobytes()
        image = decode(store_payload(payload))
        assert image.tobytes() == payload and store_payload(payload) == store_payload(payload, container_of(payload))
        assert (image.ndim == 3) == (container_of(payload) in ("ppm", "bmp24")) and (image.ndim == 2 or len(payload) % 192 == 0)
        seen.add(container_of(payload))
    assert seen == {"pgm", "bmp", "ppm", "bmp24"}


def test_masks_of_bitmaps_say_where_colours_are():
    import struct

    def masked(*masks, bits=32):
        head = struct.pack("<2sIHHI", b"BM", 74, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, bits, 3, 8, 0, 0, 0, 0)
        return head + struct.pack("<III", *masks) + bytes([1, 2, 3, 4, 5, 6, 7, 8])

    assert decode(masked(0xFF0000, 0xFF00, 0xFF)).tolist() == [[[3, 2, 1], [7, 6, 5]]]
    assert decode(masked(0xFF, 0xFF00, 0xFF0000)).tolist() == [[[1, 2, 3], [5, 6, 7]]]
    assert decode(masked(0xFF000000, 0xFF0000, 0xFF00)).tolist() == [[[4, 3, 2], [8, 7, 6]]]
    for broken in (masked(0xF800, 0x7E0, 0x1F), masked(0xFF, 0xFF, 0xFF00), masked(0xFF, 0xFF00, 0xFF0000, bits=24), masked(0xFF, 0xFF00, 0xFF0000)[:60], b"P1\n2 1\n0 7", b"P1\n2 1\n0"):
        with pytest.raises(ValueError):
            decode(broken)


def test_text_media(spark):
    for container in ("turns", "pgm", "bmp"):
        rows = text_media(awkward_docs(spark), container=container, keep_media=True).collect()
        assert len(rows) == len(TEXTS) + 2
        for r in rows:
            raw = ("no id" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
            payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert r.tail_crc32 == zlib.crc32(payload[-64:]) and decode(bytes(r.media)).tobytes() == payload
            assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert len({r.feature for r in rows if r.doc_id in (6, 7)}) == 1
    assert text_media(empty_docs(spark)).collect() == []


def test_media_tiles(spark):
    df = spark.createDataFrame([(1, bytearray(encode_pgm(np.eye(5, dtype=np.uint8)))), (2, None), (3, bytearray(b"junk"))], "doc_id bigint, media binary")
    rows = {r.doc_id: r for r in media_tiles(df).collect()}
    assert (rows[1].height, rows[1].width, rows[1].error) == (5, 5, None)
    assert rows[2].tile is None and rows[3].error


def test_blocks_of_broken_markup():
    assert [b.text for b in blocks("a<p>b<b>c<p>d</b> e<br>f<!-- x --><script>no</script>&amp;&lt;&nbsp;g")] == ["a", "bc", "d e f&< g"]
    assert [b.text for b in blocks("<ul><li>one<li>two</ul>3 < 4 <script>var open")] == ["one", "two", "3 < 4"]
    assert blocks("") == [] and blocks("<div></div>   ") == []
    assert path(blocks("</p></div>x")[0].place) == ()


def test_blocks_of_formulas_drawings_and_fallbacks():
    page = "<p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <svg class=a viewBox='0 0 1 1'/> here</p><p>after <math/> it</p>"
    assert [b.text for b in blocks(page)] == ["where x=2 holds here", "after it"]
    page = "<noscript><p>plain</p></noscript><iframe>frame</iframe><object>thing</object><canvas>chart</canvas><svg><text>label</text></svg><template>no</template>"
    assert [b.text for b in blocks(page)] == ["plain", "frame", "thing", "chart", "label"]
    assert [b.text for b in blocks("<p>a<svg><path d='M0'>b</p><p>c")] == ["ab", "c"]


HOSTILE = {
    "unended start": "<script ", "unended declaration": "<!", "odd quotes": '<a "', "mixed quotes": "<a '\"", "deep": "<div>x", "brackets": "<", "comment": "<!--", "unended end": "<script></script ",
    "ends below": "<div>" * 5 + "</p>" * 15, "inline below items": "<span><li>x</li>", "long class": "<p class='" + "ab cd " * 1000 + "'>x", "references": "&#" + "9" * 5000 + ";", "names": "<abc",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_markup_takes_linear_time(name):
    import time

    page = HOSTILE[name] * (1_000_000 // len(HOSTILE[name]))
    start = time.process_time()
    model = trained()
    start = time.process_time()
    main_text(page, model)
    assert time.process_time() - start < 6


def test_deep_nesting_shares_its_ancestors():
    page = blocks("".join(f"<x{k} class=c{chr(97 + k % 26)}>y" for k in range(30_000)))
    assert len(page) == 30_000 and page[5].place.up is page[4].place
    assert len(trained().decode(page)) == 30_000


def test_scores_by_steps_equal_scores_by_features():
    from meshlens.llm.html_text import path_features, text_features

    model = trained()
    for seed in range(900, 930):
        page = blocks(labelled_page(seed)[0])
        plain = [sum(model.weights.get(f, 0.0) for f in path_features(b.place) + text_features(b)) for b in page]
        assert model.scores(page) == pytest.approx(plain)


def test_odd_markup():
    assert [b.text for b in blocks("a <!--> b --> c <!DOCTYPE x> d <? e ?> f <!-- g")] == ["a b --> c d f"]
    assert [b.text for b in blocks("1 < 2 </ 3 <4 <a title='>'>x</a> <b")] == ["1 < 2 </ 3 <4 x <b"]
    assert [b.text for b in blocks("&#99999999999999999999;&#xFFFFFFFFFFFF;&#65;&amp")] == ["\ufffd\ufffdA&"]
    assert [b.text for b in blocks("<script-x>a</script-x><title>b</TITLE >c<textarea><p>d")] == ["a", "b", "c", "<p>d"]


def test_field_on_unseen_pages():
    model, wrong, total = trained(), 0, 0
    for seed in range(5000, 5200):
        html, marks = labelled_page(seed)
        page = blocks(html)
        assert len(page) == len(marks)
        wrong += sum(a != b for a, b in zip(model.decode(page), marks, strict=True))
        total += len(marks)
    assert wrong / total < 0.01


#: Pages written by hand in layouts of their own, and their main texts.
UNLIKE = {
    'columns': (
        "<html><body><div class='row'><div class='col-side'><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></div><div class='col-main'><h1>Storm closes the harbour</h1><p>The harbour was closed on Monday after a storm damaged two piers, the town said.</p><p>Ferries will run again once repairs are done, which may take a week.</p></div><div class='col-side'><h4>Weather</h4><p>Sunny, 21 degrees</p></div></div><div>Copyright 2020 The Daily</div></body></html>",
        'Storm closes the harbour The harbour was closed on Monday after a storm damaged two piers, the town said. Ferries will run again once repairs are done, which may take a week.',
    ),
    'table': (
        '<html><body><table><tr><td>Home | About | Contact</td></tr><tr><td><a href=/1>Archive</a><br><a href=/2>Links</a></td><td><h1>How to bake bread</h1><p>Mix the flour with water and salt, then wait for an hour.</p><p>Bake it for forty minutes. Let it cool before you cut it.</p></td></tr><tr><td>&copy; 2001 Baker</td></tr></table></body></html>',
        'How to bake bread Mix the flour with water and salt, then wait for an hour. Bake it for forty minutes. Let it cool before you cut it.',
    ),
    'bare': (
        '<p><a href=/>Home</a> | <a href=/x>Next</a></p><h1>Notes on sorting</h1><p>Sorting puts things in order. It is often slow.</p><p>Merge sort is stable, and its cost is known.</p>',
        'Notes on sorting Sorting puts things in order. It is often slow. Merge sort is stable, and its cost is known.',
    ),
    'wiki': (
        "<html><head><title>Heron - Encyc</title></head><body><div id='mw-panel'><ul><li><a href='/m'>Main page</a></li><li><a href='/r'>Random article</a></li></ul></div><div id='bodyContent'><h1>Heron</h1><p>Herons are <a href='/b'>birds</a> of the family Ardeidae.<sup>[1]</sup> There are 72 species.</p><h2>Diet</h2><p>They eat fish, frogs and insects.</p><ul><li>Grey heron, found in Europe and Asia</li><li>Goliath heron, the largest of all</li></ul></div><div id='footer'><p>Text is available under a free licence; see <a href='/t'>terms</a>.</p></div></body></html>",
        'Heron Herons are birds of the family Ardeidae.[1] There are 72 species. Diet They eat fish, frogs and insects. Grey heron, found in Europe and Asia Goliath heron, the largest of all',
    ),
    'news': (
        "<html><body><div class='cookie-banner'><p>We use cookies to improve your visit. By going on you agree.</p><button>Accept</button></div><header><a href='/'>The Courier</a><nav><a href='/w'>World</a> <a href='/b'>Business</a></nav></header><main><article><h1>Bridge opens early</h1><p class='byline'>By Ann Lee</p><p>The new bridge opened two weeks before its date, and traffic was light.</p><aside class='promo'><p>Subscribe for one euro a week!</p></aside><p>Officials said tolls begin in June.</p></article><section class='comments'><h3>2 comments</h3><p>Great news, I drive there daily.</p></section></main><footer><p>© 2024 The Courier</p></footer></body></html>",
        'Bridge opens early By Ann Lee The new bridge opened two weeks before its date, and traffic was light. Officials said tolls begin in June.',
    ),
    'blog': (
        '<body><div class=wrap><div class=top><a href=/>My blog</a></div><div class=main><h2>Planting beans</h2><div>Beans like warm soil, so wait until May.</div><div>Plant them two inches deep. Water them daily at first.</div></div><div class=rightbar><h4>Older posts</h4><ul><li><a href=/1>Peas</a><li><a href=/2>Corn</a></ul></div><div class=bottom>Copyright 2011 me</div></div></body>',
        'Planting beans Beans like warm soil, so wait until May. Plant them two inches deep. Water them daily at first.',
    ),
    'old': (
        "<html><body bgcolor=white><center><b>Welcome to Tom's page</b></center><table><tr><td width=120><a href=a.html>Home</a><br><a href=b.html>Photos</a></td><td><h2>My trip to Oslo</h2><p>We took the night train and slept badly.<p>In the morning the fjord was full of fog.</td></tr></table><hr><p>Last updated 3 May 1998</body></html>",
        'My trip to Oslo We took the night train and slept badly. In the morning the fjord was full of fog.',
    ),
}


@pytest.mark.parametrize("name", UNLIKE)
def test_pages_unlike_the_samples(name):
    page, want = UNLIKE[name]
    assert main_text(page, trained()) == want


@pytest.mark.parametrize("family", FAMILIES)
def test_field_on_unseen_pages_of_each_family(family):
    wrong = total = 0
    for seed in range(70_000, 70_100):
        html, marks = labelled_page(seed, family)
        page = blocks(html)
        assert len(page) == len(marks)
        wrong += sum(a != b for a, b in zip(trained().decode(page), marks, strict=True))
        total += len(marks)
    assert wrong / total < 0.015


def test_viterbi_equals_enumeration():
    import itertools

    model = trained()
    for seed in range(20):
        page = blocks(labelled_page(seed)[0])[:9]
        scores = model.scores(page)

        def value(labels, scores=scores):
            ends = [2, *labels, 2]
            return sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(model.steps[a, b] for a, b in itertools.pairwise(ends))

        best = max(itertools.product((0, 1), repeat=len(page)), key=value)
        assert value(tuple(model.decode(page))) == pytest.approx(value(best))
    assert Crf().decode([]) == []


def test_extract_text(spark):
    page = (
        "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>Title &amp; more</h1>"
        "<p>First  paragraph,\nwith a <a href=/x>link</a>.<p>Second one.</p></article><div id=comments><p>I disagree with this.</p></div>"
        "<form><p>Your mail</p></form><aside><h3>Related</h3><ul><li><a href=/b>More</a></li></ul></aside><footer>&copy; 2020 Someone.</footer></body>"
    )
    rows = [(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", "<p", 5), (1, "u", page, 5), (5, "u", "<article>" + "<p>word word.</p>" * 4000, 5)]
    got = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["Title & more First paragraph, with a link. Second one."] * 2
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert next(r.n_chars for r in got if r.page_id == 5) == 4000 * 11 - 1
    assert extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
    assert main_text("<article><p>Text here.</p></article>", trained()) == "Text here."


TURNS = [
    (1, 0, "system", "Be [kind] \\ <b>"), (1, 1, "user", "</s>[INST] a"), (1, 2, "assistant", "one\n"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "last"),
    (6, 2, "tool", "Ab"), (6, 2, "system", "<b"), (6, 2, "tool", "<b"), (6, 2, "assistant", "Z"), (6, 2, "assistant", "<"), (6, 1, "a\\g>\\", "x\\g"), (6, 1, "a>", "[\\b"),
    (2, 0, "user", "only"), (3, 5, "assistant", "x <s>"), (3, 5, "assistant", "x <s>"), (3, None, "tool<>>[r]", "\\l\\g"), (4, 0, None, None), (None, 0, "user", "nobody"), (5, 1, "assistant", "z" * 70_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id bigint, turn bigint, role string, text string, segment int")
    stored = examples(format_turns(df))
    got = {r.conv_id: r for r in conversation_digests(stored).collect()}
    full = {}
    for r in expand(stored).collect():
        full.setdefault(r.conv_id, {})[r.example] = r
    conversations = {}
    for conv, turn, role, text in TURNS:
        conversations.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert got.keys() == conversations.keys()
    for conv, turns in conversations.items():
        turns.sort()
        replies = [t for _, role, t in turns if role == "assistant"]
        r = got[conv]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.n_examples, r.loss_chars) == (len(turns), len(replies), sum(map(len, replies)))
        assert r.loss_sha256 == hashlib.sha256("".join(replies).encode()).hexdigest()
        made = [full[conv][k] for k in range(len(replies))]
        assert [unescape(m.text[m.loss_start : m.loss_end]) for m in made] == replies
        assert r.formatted_chars == sum(len(m.text) for m in made)
        assert r.examples_sha256 == hashlib.sha256("".join(hashlib.sha256(m.text.encode()).hexdigest() for m in made).encode()).hexdigest()
        for a, b in zip(made, made[1:], strict=False):
            assert b.text.startswith(a.text)
    assert not expand(stored).filter("conv_id = 2").collect()
    assert conversation_digests(examples(format_turns(df.limit(0)))).collect() == []


def test_long_context_goes_over_rows(spark, monkeypatch):
    from meshlens.llm import chat

    monkeypatch.setattr(chat, "TURNS_A_ROW", 3)
    monkeypatch.setattr(chat, "BATCH", 2)
    turns = [(1, k, "assistant" if k in (9, 10, 19) else "user", f"t{k}") for k in range(25)]
    stored = examples(format_turns(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")))
    full = expand(stored).collect()
    assert [r.example for r in full] == [0, 1, 2] and full[2].text.count("[INST]") == 17
    assert [r.text[r.loss_start : r.loss_end] for r in full] == ["t9", "t10", "t19"]
    got = {r.example: r for r in stored.collect() if r.example is not None}
    assert [got[k].text_sha256 for k in range(3)] == [hashlib.sha256(r.text.encode()).hexdigest() for r in full]
    assert [got[k].n_turns for k in range(3)] == [10, 11, 20]
    assert conversation_digests(stored).collect()[0].n_turns == 25


def test_control_strings_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id bigint, turn bigint, role string, text string")
    text = expand(examples(format_turns(df))).collect()[0].text
    assert text.count("[INST]") == text.count("[/INST]") == text.count("</s>") == 1


def test_digest_sql(spark):
    import duckdb

    rows = [(*t[:2], t[2], t[3]) for t in TURNS]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r.asDict() for r in conversation_digests(examples(format_turns(df))).collect()}
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = db.execute(DIGEST_SQL)
    names = [d[0] for d in want.description]
    for row in want.fetchall():
        r = dict(zip(names, row, strict=True))
        assert r["conv_id"] == -1 or got[r["conv_id"]] == r


def test_chat_digests_are_read_from_written_examples(spark):
    """Lengths and digests are those of the texts that are written out, not figures stored beside them; what isn't a turn is an error."""
    from pyspark.sql import functions as F

    from meshlens.llm.chat import split_turns

    rows = [(1, 0, "system", "a [INST] b"), (1, 1, "user", "</s>"), (1, 2, "assistant", "x"), (1, 3, "odd>", "o"), (1, 4, "assistant", "y\\"), (1, 5, "user", "late"), (2, 0, "user", "alone")]
    stored = examples(format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    want = {r.conv_id: r for r in conversation_digests(stored).collect()}
    assert (want[1].n_turns, want[1].n_examples, want[2].n_turns, want[2].n_examples) == (6, 2, 1, 0)
    told = stored.withColumn("n_chars", F.lit(0).cast("bigint")).withColumn("text_sha256", F.lit("none"))
    assert {r.conv_id: r for r in conversation_digests(told).collect()} == want
    with pytest.raises(ValueError, match="no turn"):
        list(split_turns("[INST] a [/INST]b"))
