import random
import tracemalloc
import zlib

import numpy as np
import pytest

from mosaic_spark.llm import html_extract, toxicity, warc

from . import corpora

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="masthead"><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies <button>OK</button></div>
<article><h1>A  title &amp; more</h1><p>First &eacute;l&#233;ment,<b> bold</b>er text.<br>Next line<p>Second&nbsp;one.
<div class="ad">Buy now</div><ul><li>item one<li>item two</ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">More</a></ul></aside>
<section id="comments"><div class="comment"><b>Bob</b><p>Great read, thanks for it.</p></div></section>
<form><label>Mail</label><input name=m><button>Go</button></form><script>var a = "</p>";</script><footer>&copy; 2024 Site</footer></body></html>"""


def test_extracts_the_article():
    assert html_extract.extract([PAGE, None, "", "<p>"]) == ["A title & more First élément, bolder text. Next line Second one. item one item two", "", "", ""]


def expected(page: str) -> str:
    """The marked text chunks of an invented page, by its own parse."""
    root, label, stack = html_extract.parse(page), {}, []
    stack.append(root)
    while stack:
        x = stack.pop()
        if x.tag == "#text":
            label[id(x)] = html_extract.KEEP if html_extract._MARK in x.text else html_extract.DROP
        stack += x.kids
    parts = []
    html_extract._walk(root, label, parts)
    return " ".join("".join(parts).replace(html_extract._MARK, "").split())


def test_held_out_pages():
    rng = random.Random(77)
    pages = [html_extract.invented_page(rng) for _ in range(120)]
    got = html_extract.extract([p.replace(html_extract._MARK, "") for p in pages])
    assert sum(g == expected(p) for g, p in zip(got, pages)) >= 110


def test_labels_never_contradict():
    rng = random.Random(5)
    root = html_extract.parse(html_extract.invented_page(rng))
    nodes, f, parents = html_extract.features(root)
    import numpy as np

    leaf = np.array([not x.kids for x in nodes])
    label = html_extract.decode(parents, np.random.default_rng(1).standard_normal((len(nodes), 3)), leaf)
    assert all(p < 0 or label[p] == html_extract.MIXED or label[i] == label[p] for i, p in enumerate(parents))


@pytest.mark.parametrize("page", ["<<<>>", "</p></div>", "<a href='x", "<p <b>", "<!-- open", "<script>", "<" * 3000, "<div>" * 3000 + "deep", "\x00퟿<p>é"])
def test_broken_pages(page):
    assert isinstance(html_extract.extract([page])[0], str)


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '\" ", "</p>", "<b>", "<div><b><hr>", "<p><button><b><hr>", "<!x", "<option>", "<h1><b>"])
def test_parsing_time_is_proportional_to_the_page(piece):
    import time

    t = time.process_time()
    html_extract.parse(piece * (300_000 // len(piece)))
    assert time.process_time() - t < 15


#: Pages written by hand, with their main text.
BY_HAND = [
    ("<html><body><div id=top><a href=/>Daily Post</a> | <a href=/s>Sport</a> | <a href=/w>Weather</a></div><div class=story><h1>Rain ends drought</h1><p>After four dry months, rain fell on the hills on Monday. Farmers said that it came just in time for the wheat.</p><p>Reservoirs stand at 41&#37; of their capacity, the water board reported on Tuesday morning.</p></div><div id=footer>Contact | Imprint | &copy; Daily Post</div></body></html>",
     "Rain ends drought After four dry months, rain fell on the hills on Monday. Farmers said that it came just in time for the wheat. Reservoirs stand at 41% of their capacity, the water board reported on Tuesday morning."),
    ("<body><nav class='main-menu'><ul><li><a href='/'>Start</a></li><li><a href='/blog'>Blog</a></li></ul></nav><main><article><h2>How to bake bread</h2><p>Mix the flour with warm water, salt and a little yeast, and leave the dough alone for an hour.</p><p>Then knead it <em>well</em>, shape a loaf and bake it for forty minutes in a hot oven.</p></article></main><section class='comments'><h3>2 comments</h3><div class='comment'>Ann: my loaf was flat!</div><div class='comment'>Ben: try more yeast.</div></section><footer><p>All rights reserved.</p></footer></body>",
     "How to bake bread Mix the flour with warm water, salt and a little yeast, and leave the dough alone for an hour. Then knead it well, shape a loaf and bake it for forty minutes in a hot oven."),
]


@pytest.mark.parametrize("page,text", BY_HAND)
def test_pages_written_by_hand(page, text):
    assert html_extract.extract([page]) == [text]


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string")
    got = html_extract.extract_pages(df).collect()
    assert [r.n_chars for r in got] == [len(r.text) for r in got] and sorted(r.n_chars == 0 for r in got) == [False, False, True]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def labelled(seed, n):
    rng = random.Random(seed)
    bad = {"x": ["grumf", "zotter"], "y": ["vilka"]}
    out = []
    for i in range(n):
        w = corpora.words(rng, rng.randint(30, 120))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad["x"]) if i % 2 else rng.choice(bad["y"]) + rng.choice(["a", "ob", "ent"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark):
    train, held = labelled(1, 800), [(i + 5000, t, x) for i, t, x in labelled(2, 300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train + held] + [(9999, None), (None, ""), (9998, "")], corpora.SCHEMA)
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in train] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, labels).collect()}
    assert sum(got[i] == bool(x) for i, _, x in held) >= 297
    assert not got[9999] and not got[None] and not got[9998]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not v for v in got.values())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], corpora.SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in toxicity.toxicity(docs, none).collect()] == [False]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def test_training_keeps_no_strings_per_document():
    """Sets of strings took the driver over its limit in the pipeline on check_h."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=8)) for _ in range(3000)]
    texts = [" ".join(rng.sample(words, 300)) for _ in range(300)]
    toxic = [int(i % 4 == 0) for i in range(300)]
    tracemalloc.start()
    try:
        toxicity.fit_chain(texts, toxic)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20e6  # 33 MB as sets


def test_warc_round_trip(spark):
    data = [(1, "http://a b\n", "<p>é</p>"), (2, "u", "x"), (3, "u", "<p>é</p>"), (4, None, None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\nbody\r\n\r\nWARC/1.1\r\n"), (3, "u", "<p>é</p>"), (None, "u", "lonely")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_report(df).collect()}
    assert got == {(1, "revisit", 3, 9), (2, "response", None, 1), (3, "response", None, 9), (4, "revisit", 5, 0), (5, "response", None, 0), (6, "response", None, 30), (None, "response", None, 6)}
    assert warc.archive_report(df.limit(0)).count() == 0


def record(name, body, kind="response"):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def names(data):
    return [(s, f.get("warc-record-id")) for _, _, s, f, _ in warc.salvage(data)]


def test_salvage_plain():
    a, b, c = record("a", b"one"), record("b", b"two WARC/1.0 in text"), record("c", b"three")
    assert names(a + b + c) == [("ok", "<a>"), ("ok", "<b>"), ("ok", "<c>")]
    assert names(a + b[:-9] + c) == [("ok", "<a>"), ("gap", None), ("ok", "<c>")]
    assert names(a + b"junk\r\n" + c) == [("ok", "<a>"), ("gap", None), ("ok", "<c>")]
    assert names(a + b.replace(b"Content-Length: 20", b"Content-Length: 99") + c) == [("ok", "<a>"), ("gap", None), ("ok", "<c>")]
    assert names(b"") == [] and names(b"noise") == [("gap", None)] and names(a[:-1]) == [("gap", None)]


def test_salvage_members_and_gap_bytes():
    parts = [zlib.compress(record(n, n.encode() * 50), wbits=31) for n in "abc"]
    broken = bytearray(parts[1])
    broken[25] ^= 0xFF
    data = parts[0] + bytes(broken) + parts[2]
    found = list(warc.salvage(data))
    assert [(s, f.get("warc-record-id")) for _, _, s, f, _ in found] == [("ok", "<a>"), ("gap", None), ("ok", "<c>")]
    assert found[1][:2] == (len(parts[0]), len(parts[0]) + len(parts[1]))
    assert sum(stop - start for start, stop, *_ in found) == len(data)


def test_salvage_checks_digests():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    assert [s for _, _, s, _, _ in warc.salvage(good)] == ["digest"]


def test_salvage_inside_a_member():
    a, b, c = record("a", b"one"), record("b", b"two"), record("c", b"three")
    torn = zlib.compress(a + b[:-9] + c, wbits=31)
    assert names(torn) == [("ok", "<a>"), ("gap", None), ("ok", "<c>")]
    noise = np.random.default_rng(1).integers(0, 256, 200_000, np.uint8).tobytes()
    stream = zlib.compress(a + b + record("n", noise) + c, wbits=31)
    after = zlib.compress(c, wbits=31)
    assert names(stream[: len(stream) // 2]) == [("ok", "<a>"), ("ok", "<b>"), ("gap", None)]
    broken = bytearray(zlib.compress(a + b + record("n", b"xyz" * 99), wbits=31))
    broken[-8] ^= 0xFF  # its checksum
    found = names(bytes(broken) + after)
    assert found[:3] == [("unverified", "<a>"), ("unverified", "<b>"), ("unverified", "<n>")] and found[-1] == ("ok", "<c>")


def test_salvage_looks_inside_a_record_whose_digest_fails():
    a, b, c = record("a", b"one"), record("b", b"two"), record("c", b"three")
    body = b"one\r\n\r\n" + b[:-4]
    long = record("a", body).replace(b"Content-Length", b"WARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length", 1)
    want = [("digest", "<a>"), ("ok", "<b>"), ("ok", "<c>")]
    assert names(long + c) == want and names(zlib.compress(long + c, wbits=31)) == want
