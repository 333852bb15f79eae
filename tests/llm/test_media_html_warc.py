"""Media, HTML extraction and WARC packages: round trips and brute force."""

import gzip
import hashlib
import io
import json
import math
import re
import struct
import time
import wave
import zipfile
import zlib

import pytest
from llm_help import DATA

from sievemark.llm import html_extract, media, warc
from sievemark.llm.queries import ORACLE_SQL, QUERIES


def padded(text):
    raw = (text or "").encode()
    return raw, raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)


def test_media_round_trip(odd, none):
    got = media.read_back(media.store(odd)).collect()
    want = sorted((str(r.doc_id), *(lambda raw, p: (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))(*padded(r.text))) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.payload_bytes % 576 == 0 for r in got)
    assert media.read_back(media.store(none)).count() == 0


def by_hand(kind, p):
    """The media file of a payload, written without the library."""
    if kind == "image/png":
        lines = b"".join(b"\0" + p[k : k + 576] for k in range(0, len(p), 576))
        parts = [(b"IHDR", struct.pack(">IIBBBBB", 576, len(p) // 576, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")]
        return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)
    if kind == "image/bmp":
        size = (1078 + len(p)).to_bytes(4, "little")
        head = b"BM" + size + bytes(4) + (1078).to_bytes(4, "little") + (40).to_bytes(4, "little") + (576).to_bytes(4, "little") + (-(len(p) // 576)).to_bytes(4, "little", signed=True)
        head += b"\1\0\x08\0" + bytes(4) + len(p).to_bytes(4, "little") + (2835).to_bytes(4, "little") * 2 + (256).to_bytes(4, "little") * 2
        return head + b"".join(bytes([k, k, k, 0]) for k in range(256)) + p
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(p)
    return out.getvalue()


def feature(kind, p):
    n = len(p)
    counts = [p.count(bytes([k])) for k in range(256)]
    mean = sum(k * c for k, c in enumerate(counts)) / n
    std = (sum(c * (k - mean) ** 2 for k, c in enumerate(counts)) / n) ** 0.5
    entropy = -sum(c / n * math.log2(c / n) for c in counts if c)
    cells = [sum(p[k * (n // 64) : (k + 1) * (n // 64)]) / (n // 64) for k in range(64)]
    bits = "".join("1" if c > sum(cells) / 64 else "0" for c in cells)
    return kind.split("/")[1], n // 576, mean, std, entropy, f"{int(bits, 2):016x}"


def test_media_columns_by_hand(spark):
    """Every column of the query, from the texts: media as written by other means, features as plain sums."""
    rows = {r.doc_id: r for r in QUERIES["op2_media_columns"](spark, DATA).collect()}
    kinds, how = set(), set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        raw, p = padded(r.text)
        g = rows[r.doc_id]
        m = by_hand(g.media_type, p)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
        kind, height, mean, std, entropy, cells = feature(g.media_type, p)
        said = re.fullmatch(r"(\w+):576x(\d+):mean=(.*):std=(.*):entropy=(.*):ahash=(.*)", g.feature)
        assert (said[1], int(said[2]), said[6]) == (kind, height, cells)
        assert all(abs(float(x) - y) < 1e-3 for x, y in zip(said.groups()[2:5], (mean, std, entropy)))
        assert g.declared != g.media_type and g.corrected == (g.declared != "application/octet-stream")
        kinds.add(g.media_type)
        how.add(g.corrected)
    assert kinds == {"image/png", "image/bmp", "audio/wav"} and how == {True, False}


def test_media_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_media_columns"](spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        raw, p = padded(r.text)
        g = rows[r.doc_id]
        assert (g.n_bytes, g.payload_sha256) == (len(raw), hashlib.sha256(p).hexdigest())


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00;"


def wav():
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4) + b"abcd"
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp():
    return b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\1\2\3\0"


def ogg():
    return b"OggS\0\6" + b"\0" * 20 + b"\1\3abc"


def mp4():
    return struct.pack(">I4s", 16, b"ftyp") + b"isom\0\0\0\0" + struct.pack(">I4s", 12, b"moov") + b"abcd"


SAMPLES = {"image/png": media.write_image(b"x" * 576), "image/gif": gif(), "audio/wav": wav(), "image/bmp": bmp(), "audio/ogg": ogg(), "video/mp4": mp4(), "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF"}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_sniffing(kind):
    b, s = SAMPLES[kind], media.Sniffer()
    assert s.hits(b) == [(kind, 0, len(b))]
    assert s.hits(b"junk BM GIF89a " + b + b" tail") == [(kind, 15, len(b))]
    assert s.hits(b[:-2]) == []


def test_sniffed_columns(spark):
    rows = [(1, bytearray(SAMPLES["image/gif"]), "text/plain"), (2, bytearray(b"BM is a text"), "text/plain"), (3, None, None), (4, bytearray(b"..." + SAMPLES["audio/wav"] + SAMPLES["image/png"]), "image/png")]
    got = {r.id: r for r in media.sniff(spark.createDataFrame(rows, "id long, content binary, declared string"), "content", "declared").collect()}
    assert (got[1].media_type, got[1].corrected) == ("image/gif", True) and (got[2].media_type, got[2].corrected, got[2].hits) == ("text/plain", False, [])
    assert got[3].media_type is None and [h.type for h in got[4].hits] == ["audio/wav", "image/png"] and not got[4].corrected


PAGE = """<html><head><title>T</title><style>x</style></head><body><nav class="menu"><a href="/">Home</a></nav><header><h2>Site name</h2></header>
<div id="cookie-notice">We use cookies</div><main><article class="post-12"><h1>Title &amp; more</h1><p>First   paragraph,
with a line break and enough words to count as the text of the page.</p><script>var a = "<p>no</p>";</script>
<p>Second &lt;one&gt; &eacute;&#233; with more words than any of the menus have in them.</p><ul><li>item one of the list</li><li>item two of the list</li></ul>
<div class="ad banner">Buy now</div><aside>Related</aside><form><p>Your mail</p></form></article><section class="comments"><p>Nice article, I liked it very much indeed, thanks for writing all of it down.</p></section></main>
<footer>© nobody</footer></body></html>"""
WANT = "Title & more\nFirst paragraph, with a line break and enough words to count as the text of the page.\nSecond <one> éé with more words than any of the menus have in them.\nitem one of the list\nitem two of the list"


def test_html(spark):
    rows = [(i, f"https://a.example.org/{i}", PAGE) for i in range(3)] + [(10, "https://b.example.org/", None), (11, None, ""), (12, "not a url", "<p>only this</p>"), (13, "https://c.org/", "plain text & no tags"), (0, "https://a.example.org/0", PAGE)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text", "3 AS path", "4 AS pages")
    got = html_extract.extract(d).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[0].text == by[2].text == WANT and by[0].n_chars == len(WANT) and by[10].text == by[11].text == ""
    assert by[12].text == "only this" and by[13].text == "plain text & no tags"
    assert html_extract.extract(d.limit(0)).count() == 0


def text_of(page):
    return html_extract.main_text(html_extract.parse(page), [])


def test_html_odd_pages(spark):
    """Classes with '>', articles whose names sound like furniture, elements that never end, pages that end within a tag."""
    body = "<p>The text of the article, with a few words in it.</p>"
    want = "The text of the article, with a few words in it."
    assert text_of(f'<div class="[&>p]:mt-4 x>y"><article>{body}</article></div>') == want
    assert text_of(f'<div id="legal"><article class="post-comment-policy">{body}</article></div><footer>f</footer>') == want
    assert text_of(f'<main>{body}</main><section class="comments"><article class="comment"><p>Nice.</p></article></section>') == want
    assert text_of(f'<article>{body}</article><div class="related"><article><p>Another one</p></article></div>') == want
    for tag in ("svg", "noscript", "template", "title", "select", "button"):
        assert text_of(f"<article>{body}<{tag}></article>") == want
    assert text_of(f"<article>{body}</article><script>var x = 1") == want
    assert text_of(f'<article>{body}</article><a href="http://x.org/?a=') == want
    rows = [(i, "https://u.org/", f'<body><div class="[&>p]:mt-4">{body}</div><div class="side">s</div></body>') for i in range(4)]
    got = {r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {want}


@pytest.mark.parametrize("page", ["<a " + 'a="b" ' * 3000, "<a " * 100_000, '<a "' * 100_000 + ">", "<!" * 100_000, "<svg>" * 30_000, "<div>" * 20_000 + "</p>" * 20_000,
                                  "<a " + "x" * 300_000 + "/ b=c>", '<a b="' * 50_000 + ">", "<div>x" * 20_000, "<" * 300_000, "-" * 1_000_000])
def test_html_takes_time_by_length(page):
    start = time.time()
    text_of(page)
    assert time.time() - start < 10


def test_html_consensus(spark):
    """A page whose own best container is its comments' neighbour follows the host's vote."""
    body = lambda main, side: f"<body><div class='box main'><p>{main}</p></div><div class='box side1'><p>{side}</p></div></body>"
    rows = [(i, "https://h.org/x", body("word " * 60, "s")) for i in range(5)] + [(9, "https://h.org/y", body("short main", "long " * 60))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short main"


def test_html_whole_articles(spark):
    """Bodies within articles, sections side by side, a large table, a title outside, two articles, and a page of another template than its host's."""
    few, many = "few words here " * 12, "many words there " * 20
    a, b = few.strip(), many.strip()
    pages = [
        (f"<body><article><h1>Title</h1><p>Lead {few}</p><div class=body><p>{many}</p></div></article></body>", f"Title\nLead {a}\n{b}"),
        (f"<body><div id=x><div class=one><p>{many}</p></div><div class=two><p>{few}</p></div></div></body>", f"{b}\n{a}"),
        (f"<body><main><section class=one><p>{many}</p></section><section class=two><p>{few}</p></section></main></body>", f"{b}\n{a}"),
        (f"<body><article><p>{few}</p><table><tr><td>{many}</td></tr></table></article></body>", f"{a}\n{b}"),
        (f"<body><div class=top><h1>Title</h1></div><article><p>{many}</p></article></body>", f"Title\n{b}"),
        (f"<body><article class=p><p>{many}</p></article><article class=q><p>{few}</p></article></body>", f"{b}\n{a}"),
    ]
    rows = [(i, f"https://h{i}.org/", t) for i, (t, _) in enumerate(pages)]
    rows += [(100 + i, "https://mixed.org/", f"<body><div class=post><p>{many}</p></div></body>") for i in range(9)]
    rows.append((200, "https://mixed.org/odd", f"<body><div class=post><p>short</p></div><div class=story><p>{many}</p></div></body>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(pages))] == [want for _, want in pages]
    assert got[100] == b and got[200] == f"short\n{b}"


LONG = "This is the text that the page is about, and it goes on for a while. "
MENU = '<div class="menu"><a href="/">Home</a> <a href="/b">Blog</a></div>'
FOOT = '<footer>All rights</footer><div class="site-footer">Imprint and more of it</div>'


@pytest.mark.parametrize("name,body", [
    ("has-sidebar", f'<div class="layout has-sidebar"><div class="col"><h1>Head</h1><p>{LONG * 3}</p></div></div>'),
    ("post-with-sidebar", f'<div class="post-with-sidebar"><h1>Head</h1><p>{LONG * 3}</p></div>'),
    ("no-sidebar", f'<div class="content no-sidebar"><h1>Head</h1><p>{LONG * 3}</p></div>'),
    ("header-fixed", f'<div class="page-header-fixed content"><h1>Head</h1><p>{LONG * 3}</p></div>'),
    ("menu-open", f'<div class="is-menu-open"><h1>Head</h1><p>{LONG * 3}</p></div>'),
    ("ad-free", f'<div class="ad-free"><h1>Head</h1><p>{LONG * 3}</p></div>'),
    ("theme", f'<div class="theme-dark has-footer"><h1>Head</h1><p>{LONG * 3}</p></div>'),
    ("share", f'<div class="share"><h1>Head</h1><p>{LONG * 3}</p></div>'),
    ("legal", f'<div id="legal"><div class="notice"><h1>Head</h1><p>{LONG * 3}</p></div></div>'),
    ("deep", "<div>" * 300 + f"<h1>Head</h1><p>{LONG * 3}</p>" + "</div>" * 300),
    ("two sections", f"<div><section><h1>Head</h1><p>{LONG * 2}</p></section><section><p>{LONG}</p></section></div>"),
    ("beside an article", f"<div><article><h1>Head</h1><p>{LONG * 2}</p></article><section><p>{LONG}</p></section></div>"),
    ("math", f"<article><h1>Head</h1><p>{LONG * 3}Energy is <math><mi>E</mi>=m</math> here.</p></article>"),
    ("label", f"<article><h1>Head</h1><p>{LONG * 3}<label>named</label> so</p></article>"),
    ("comments beside", f'<div class="text"><h1>Head</h1><p>{LONG * 3}</p></div><div class="comments"><p>{"I liked it a lot. " * 40}</p></div>'),
])
def test_html_keeps_the_text_of_any_page(name, body):
    page = f"<html><body>{MENU}{body}<nav>MENU LINKS</nav>{FOOT}</body></html>"
    text = html_extract.main_text(html_extract.parse(page), [])
    want = {"math": LONG * 3 + "Energy is E=m here.", "label": LONG * 3 + "named so", "two sections": LONG * 2, "beside an article": LONG * 2}.get(name, LONG * 3)
    lines = ["Head", want.strip()] + ([LONG.strip()] if name in ("two sections", "beside an article") else [])
    assert text == "\n".join(lines)


def test_html_furniture_below_very_many_elements_is_out():
    page = "<div>" * 230 + f"<p>{LONG * 3}</p><nav>MENU LINKS</nav>" + "</div>" * 230
    assert html_extract.main_text(html_extract.parse(page), []) == (LONG * 3).strip()


def test_html_table_text_is_the_article(spark):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_extract.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    for p in pages:
        m = re.search(r"<article[^>]*>(.*?)</article>", p.html, re.S)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<br[^>]*>", " ", re.sub(r"<(?!br)[^>]+>", "", b)))).strip() for b in re.split(r"</?(?:h1|p)[^>]*>", m[1])]
        assert got[p.page_id] == "\n".join(b for b in blocks if b)


def test_warc_query(same):
    same(QUERIES["op8_warc"], ORACLE_SQL["op8_warc"])


def test_warc_odd(spark):
    big = "é" * 60
    rows = [(5, "u", big), (3, "u\r\nv", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (7, "u", None), (8, "u", ""), (None, "u", big + "x"), (4, "u", "z" * 3000000), (6, "u", "a" * 100), (11, "u", "a" * 100), (12, "u", "b" * 99), (13, "u", "b" * 99)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS rows", "3 AS first")
    got = {r.page_id: r for r in warc.round_trip(d).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i].payload_bytes == len(raw) and got[i].payload_digest == hashlib.sha256(raw).hexdigest()
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {5, 9, 11}
    assert got[5].refers_to == got[9].refers_to == 3 and got[11].refers_to == 6 and got[3].refers_to is None
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_equal_partitions(spark, tmp_path):
    """The same folder read twice: tasks with equal rows, none of which is lost."""
    rows = [(1, "u", "a" * 200), (2, "u", "b"), (3, "u", "a" * 200), (None, "u", "c" * 300), (None, "u", None), (None, "u", "c" * 300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"file://{tmp_path}/pages")
    once = spark.read.parquet(f"file://{tmp_path}/pages")
    one = lambda d: sorted(str(tuple(r)) for r in warc.round_trip(d).collect())
    twice = one(once.unionByName(spark.read.parquet(f"file://{tmp_path}/pages")))
    assert len(one(once)) == 6 and twice == sorted(one(once) * 2)


def test_warc_index_lines(spark, tmp_path):
    d = spark.createDataFrame([(1, "https://www.B.org/p?q=1 2", "x" * 120), (2, "https://a.b.org/", "y"), (3, None, "z")], "page_id long, url string, html string").coalesce(1)
    (uri,) = [r.archive for r in warc.write(d, f"file://{tmp_path}/w").collect()]
    with zipfile.ZipFile(uri.removeprefix("file://")) as z:
        lines = z.read(warc.INDEX).decode().splitlines()
        whole = z.read(warc.RECORDS)
    assert [x.split(" ")[0] for x in lines] == ["-", "org,b)/p?q=1%202", "org,b,a)/"] and all(re.fullmatch(r"\d{14}", x.split(" ")[1]) for x in lines)
    for x in lines:
        e = json.loads(x.split(" ", 2)[2])
        head, _ = warc.parse(whole[e["offset"] : e["offset"] + e["length"]])
        assert head["WARC-Payload-Digest"] == e["digest"] and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", head["WARC-Date"])


class Bytes:
    def __init__(self, b):
        self.b = b

    def size(self):
        return len(self.b)

    def read_at(self, n, at):
        return self.b[at : at + n]


def test_zip_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a", b"hello")
        z.writestr(zipfile.ZipInfo("b/c"), b"x" * 1000)
        z.comment = b"a comment"
    b = out.getvalue()
    got = warc.central_directory(Bytes(b))
    assert {k: b[s : s + n] for k, (s, n) in got.items()} == {"a": b"hello", "b/c": b"x" * 1000}


def test_zip64_directory():
    """End record and entry with all ones, the real numbers in their ZIP64 forms."""
    data, name = b"stored bytes", b"m"
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    at = len(local) + len(data)
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, at + len(entry), 1)
    end = b"PK\5\6" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    b = local + data + entry + end64 + locator + end
    assert {k: b[s : s + n] for k, (s, n) in warc.central_directory(Bytes(b)).items()} == {"m": data}
    with pytest.raises(ValueError):
        warc.central_directory(Bytes(b"no archive"))


def test_record():
    m = warc.record(7, "https://x.org/\r\ninjected: yes", b"payload", "d" * 64, None)
    head, body = warc.parse(m)
    assert body == b"payload" and head["WARC-Record-ID"] == "<urn:page:7>" and "injected" not in head
    assert gzip.decompress(m).startswith(b"WARC/1.1\r\n")
    p = warc.package([m], [{"offset": 0, "length": len(m)}])
    with zipfile.ZipFile(io.BytesIO(p)) as z:
        assert z.testzip() is None and json.loads(z.read(warc.INDEX).split(b" ", 2)[2]) == {"offset": 0, "length": len(m), "mime": "text/html"} and z.read(warc.RECORDS) == m


def test_read_tasks_are_bounded():
    assert [warc.read_tasks(n, 8) for n in (0, 1, warc.RANGE + 1, 1 << 40, 1 << 50)] == [1, 1, 2, 128, 128]


def test_read_back_of_values_without_media(spark):
    stored = media.store(spark.createDataFrame([(1, "a text")], "doc_id long, text string"))
    two = stored.selectExpr("2L as doc_id", "declared", "concat(content, content) as content")
    odd = spark.createDataFrame([(3, "image/png", None), (4, None, b"no medium at all"), (5, None, b"")], "doc_id long, declared string, content binary")
    got = {r.doc_id: r for r in media.read_back(stored.unionByName(two).unionByName(odd)).collect()}
    assert len(got) == 5 and got[1].n_bytes == 6 and got[2].payload_sha256 == got[1].payload_sha256
    assert all(got[i].payload_sha256 is None and got[i].n_bytes is None for i in (3, 4, 5))
