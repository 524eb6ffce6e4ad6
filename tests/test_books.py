"""Books, links and the library's bookkeeping on small fixtures; expected rows are written by hand."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import library, links, matching
from quire.sources import books

CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
OPF = """<package unique-identifier=" uid "><metadata xmlns:dc="d"><dc:title>A &amp; B</dc:title><dc:creator>X</dc:creator><dc:creator>Y</dc:creator><dc:title/>
<dc:identifier id="uid"> urn:1 </dc:identifier><meta name="cover" content="c"/></metadata>
<manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="text/a%20b.xhtml" media-type="application/xhtml+xml"/>
<item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="img/c.png" media-type="image/png"/></manifest>
<spine toc="n"><itemref idref="b"/><itemref idref="gone"/><itemref idref="a" linear="no"/></spine></package>"""
NCX = '<ncx><docTitle><text>no</text></docTitle><navMap><navPoint id="1"><navLabel><text>One</text></navLabel><content src="text/a%20b.xhtml#s"/><navPoint id="2"><navLabel><text>T&amp;wo</text></navLabel><content src="text/b.xhtml"/></navPoint></navPoint></navMap></ncx>'
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x02\x00\x00\x00"


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    (root / "sub").mkdir()
    book = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", CONTAINER), ("OEBPS/content.opf", OPF), ("OEBPS/toc.ncx", NCX), ("OEBPS/text/a b.xhtml", "<p>a</p>"), ("OEBPS/text/b.xhtml", "<p>b</p>"), ("OEBPS/img/c.png", PNG), ("d/", "")]
    (root / "a.epub").write_bytes(archive(book))
    (root / "sub/c.cbz").write_bytes(archive([("p10.png", PNG), ("p9.jpg", b"\xff\xd8"), ("x.txt", "t"), ("__MACOSX/p1.png", b"")]))
    (root / "bad.epub").write_bytes(b"no zip")
    (root / "x.pdf").write_bytes(b"")
    return spark, str(root)


def names(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_entries(rows):
    spark, root = rows
    assert sorted(p.rpartition("/")[2] for (p,) in names(books.book_files(spark, root), "path")) == ["a.epub", "bad.epub", "c.cbz"]
    found = books.entries(spark, root, images=False).withColumn("book", F.regexp_extract("book", "([^/]*)$", 1))
    got = {(r["book"], r["name"]): r for r in found.collect()}
    assert len(got) == 12 and got["a.epub", "OEBPS/img/c.png"]["data"] is None and got["a.epub", "OEBPS/img/c.png"]["size"] == len(PNG)
    assert got["bad.epub", ""]["error"].startswith("no archive") and got["a.epub", "OEBPS/text/b.xhtml"]["data"] == b"<p>b</p>"
    small = books.entries(spark, root, most=10).where("name like '%toc.ncx'").first()
    assert small["error"] == "too large" and small["data"] is None


def test_package_spine_and_contents(rows):
    spark, root = rows
    members = books.entries(spark, root).where("book like '%a.epub'").withColumn("book", F.lit("a"))
    packages = books.packages(members)
    assert names(books.manifest(packages).orderBy("ord"), "id", "path") == [("n", "OEBPS/toc.ncx"), ("a", "OEBPS/text/a b.xhtml"), ("b", "OEBPS/text/b.xhtml"), ("c", "OEBPS/img/c.png")]
    assert names(books.spine(packages).orderBy("ord"), "path", "linear") == [("OEBPS/text/b.xhtml", True), ("OEBPS/text/a b.xhtml", False)]
    assert names(books.metadata(packages).orderBy("ord"), "field", "value") == [("title", "A & B"), ("creator", "X"), ("creator", "Y"), ("identifier", "urn:1")]
    p = packages.first()
    assert (p["package"]["identifier"], p["package"]["cover"], p["dir"]) == ("urn:1", "img/c.png", "OEBPS")
    assert names(books.toc(members, packages).orderBy("ord"), "depth", "label", "path", "fragment") == [(1, "One", "OEBPS/text/a b.xhtml", "s"), (2, "T&wo", "OEBPS/text/b.xhtml", None)]


def test_comic_pages_and_pictures(rows):
    spark, root = rows
    members = books.entries(spark, root)
    assert names(books.comic_pages(members.where("book like '%cbz'")).orderBy("page"), "page", "name", "cover") == [(1, "p9.jpg", True), (2, "p10.png", False)]
    head = members.where("name = 'p10.png'").select(books.image_header_of("data").alias("h")).select("h.*", books.pixels(F.col("h")).alias("px")).first()
    assert tuple(head) == ("png", 640, 480, 307200)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x02\x03\x04\x03"
    assert books.image_header(jpg) == {"kind": "jpg", "w": 0x304, "h": 0x102} and books.image_header(b"GIF89a\x02\x00\x03\x00") == {"kind": "gif", "w": 2, "h": 3}
    assert books.image_header(b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0\x09\0\0\x13\0\0")["w"] == 10 and books.image_header(b"zz") is None


def test_archives_round_trip(rows, spark):
    r = spark.createDataFrame([("a", 2, "x.txt", b"x" * 999), ("a", 1, "c.png", PNG), ("a", 9, "mimetype", b"m"), ("b", 1, "y", b"")], "book string, ord int, name string, data binary")
    packed = books.packed(r)
    got = names(books.entries_of(packed).orderBy("book", "ord"), "book", "ord", "name", "data")
    assert [(b, o, n, bytes(d)) for b, o, n, d in got] == [("a", 0, "mimetype", b"m"), ("a", 1, "c.png", PNG), ("a", 2, "x.txt", b"x" * 999), ("b", 0, "y", b"")]
    one = packed.where("book = 'a'").first()["data"]
    assert zipfile.ZipFile(io.BytesIO(one)).getinfo("c.png").compress_type == zipfile.ZIP_STORED


def test_charsets():
    assert books.decode_page("中".encode("gb18030")) == "中" and books.decode_page("é".encode()) == "é" and books.decode_page(b"\xef\xbb\xbfa") == "a"
    assert books.decode_page('<meta charset="big5">中'.encode("big5")).endswith("中") and books.decode_page("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é"
    assert books.charset_of(b"charset=nonsense") == "utf-8"


def test_links(spark):
    pages = [
        ("k", 0, "t/a.x", '<p id="p">x<a id="r1" href="b.x#n1">1</a><a href="http://o/">o</a><img src="../i/c.PNG"/><img src="gone.png" alt="cover"/><img src="gone.png" alt="a map"/></p>'),
        ("k", 1, "t/b.x", '<p id="p">y<a id="n1" href="a.x#r1">back</a><a href="#zz">z</a><a href="none.x">q</a></p><p id="p-x2"/>'),
        ("k", 2, "t/c.x", '<i id="p" id="q">z</i>'),
        ("l", 0, "a.x", '<p id="p"/>'),
    ]
    d = spark.createDataFrame(pages, "book string, ord int, name string, html string")
    files = d.select("book", "name").unionByName(spark.createDataFrame([("k", "i/c.png")], "book string, name string"))
    got = {(r["name"], r["path"], r["fragment"]): (r["file_ok"], r["anchor_ok"]) for r in links.checked_links(d, files).collect()}
    assert got["t/a.x", "t/b.x", "n1"] == (True, True) and got["t/b.x", "t/b.x", "zz"] == (True, False) and got["t/b.x", "t/none.x", None] == (False, None)
    assert {(r["book"], r["links"], r["file_hits"], r["anchors"], r["anchor_hits"], r["duplicate_id_tags"], r["ok"]) for r in links.check(d, files).collect()} == {("k", 7, 3, 3, 2, 1, False), ("l", 0, 0, 0, 0, 0, True)}
    assert {tuple(r) for r in links.dead_images(d, files).collect()} == {("k", "t/a.x", "t/gone.png")}
    cleaned = {r["name"]: r["html"] for r in links.drop_dead_images(d, files).where("book = 'k'").collect()}
    assert 'alt="cover"' not in cleaned["t/a.x"] and 'alt="a map"' in cleaned["t/a.x"] and cleaned["t/b.x"] == pages[1][3]
    assert {tuple(r) for r in links.duplicate_ids(d).collect()} == {("k", "t/b.x", "p", "p-x3"), ("k", "t/c.x", "p", "p-x4")}
    assert [tuple(r) for r in links.note_links(d).collect()] == [("k", "t/a.x", "r1", "t/b.x", "n1")]
    odd = spark.createDataFrame([("k", "a/b?c.x"), ("k", "a/b*c.x"), ("k", "a/b_c.x"), ("k", "plain")], "book string, name string")
    assert {tuple(r)[1:] for r in links.safe_names(odd).collect()} == {("a/b*c.x", "a/b_c-2.x"), ("a/b?c.x", "a/b_c-3.x")}
    sheets = spark.createDataFrame([("k", "s/x.css", "@font-face{src:url(../i/c.png)}@font-face{src:url(no.ttf)}p{}")], "book string, name string, css string")
    assert links.drop_dead_faces(sheets, files).first()["css"] == "@font-face{src:url(../i/c.png)}p{}"


def test_listing_changes(spark):
    known = [("a", "1", 5, 1, "ok", 0, "b"), ("c", "2", 5, 1, "ok", 0, "b"), ("d", "3", 5, 1, "failed", 0, "b"), ("e", "4", 5, 1, "failed", 9000, "b"), ("f", "5", 5, 1, "failed", 9000, "old"), ("x/g", "6", 5, 1, "ok", 0, "b"), ("h", "7", 5, 1, "ok", 0, "b"), ("i", "8", 5, 1, "ok", 0, "b")]
    present = [("a", 5, 1, "1"), ("c", 6, 1, None), ("d", 5, 1, None), ("e", 5, 1, None), ("f", 5, 1, None), ("y/h", 5, 1, "7"), ("new", 1, 1, None)]
    k = spark.createDataFrame(known, "path string, id string, size long, mtime long, status string, tried_at long, build string")
    p = spark.createDataFrame(present, "path string, size long, mtime long, id string")
    got = {r["path"]: (r["change"], r["moved_to"]) for r in library.listing_changes(k, p, spark.createDataFrame([("x",)], "path string"), now=F.lit(10_000), build="b").collect()}
    want = {"a": "unchanged", "c": "updated", "d": "retry", "e": "waiting", "f": "retry", "x/g": "unknown", "h": "moved", "i": "missing", "new": "new", "y/h": "new"}
    assert {p: c for p, (c, _) in got.items()} == want and got["h"][1] == "y/h"


def test_placement_wants_names_builds(spark):
    paths = spark.createDataFrame([("a/b/c.x",), ("a/d.x",), ("z.x",), ("old.x",)], "path string")
    tracked = spark.createDataFrame([("a", False, "k"), ("a/b", False, "k"), ("a/d.x", True, "k"), ("a", False, None)], "root string, is_file boolean, device string")
    got = {(r["path"], r["device"]): (r["root"], r["below"]) for r in library.placement(paths, tracked).collect()}
    assert got == {("a/b/c.x", "k"): ("a/b", "c.x"), ("a/b/c.x", None): ("a", "b/c.x"), ("a/d.x", "k"): ("a/d.x", ""), ("a/d.x", None): ("a", "d.x")}
    devices = spark.createDataFrame([("k",), ("r",)], "device string")
    wanted = {tuple(r) for r in library.wants(paths, tracked, devices, paths.where("path = 'old.x'")).collect()}
    assert wanted == {(p, d) for p in ("a/b/c.x", "a/d.x", "z.x") for d in ("k", "r")}
    moves = spark.createDataFrame([("a", "n"), ("a/b", "m/q"), ("a/d", "no")], "old string, new string")
    assert {tuple(r) for r in library.moved_paths(paths, moves).collect()} == {("a/b/c.x", "m/q/c.x"), ("a/d.x", "n/d.x"), ("z.x", "z.x"), ("old.x", "old.x")}
    named = library.file_names(spark.createDataFrame([("id1aaaaaa", "T", None), ("id2bbbbbb", "t", None), ("id3", "U", "mine.epub"), ("id4", "Taken", None)], "id string, title string, own string"), spark.createDataFrame([("TAKEN.epub",)], "name string"))
    assert {tuple(r) for r in named.collect()} == {("id1aaaaaa", "T.epub"), ("id2bbbbbb", "t [id2bbb].epub"), ("id3", "mine.epub"), ("id4", "Taken [id4].epub")}
    shared = library.series_share(spark.createDataFrame([(1, True, "s", True, "jp", False), (2, True, "s", True, "", True), (3, True, "s", False, "", True), (4, False, "s", False, "", True)], "id long, comic boolean, series_key string, has_info boolean, region string, current boolean"))
    assert [tuple(r) for r in shared.collect()] == [(3, 2)]
    one = spark.range(1).select(library.fingerprint(F.lit("a"), F.lit(None), F.lit("b")).alias("x"), library.fingerprint(F.lit("a"), F.lit("b"), F.lit(None)).alias("y"), library.fingerprint(F.lit("a"), F.lit(""), F.lit("b")).alias("z")).first()
    assert len(set(one)) == 3


def test_similar_classes_lose_no_pair(spark):
    rng = __import__("random").Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(120)] + ["abc", "abcde", "abcd", "金庸作品集", "金庸作品全集"]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words + words[:20])], "id long, key string")
    pairs, members = matching.similar_classes(rows, "key", "id")
    from quire.functions.text import similarity

    keys = sorted(set(words))
    want = {(a, b) for a in keys for b in keys if a < b and (similarity(a, b) >= 0.8 or (b.startswith(a) and len(b) - len(a) <= 2))}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and members.count() == len(words) + 20
    assert spark.range(1).select(matching.match_key(F.lit("A b-c (note)")).alias("k")).first()["k"] == "abc"
