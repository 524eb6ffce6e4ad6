"""Books as tables: archive members, package document, table of contents, pictures' headers.

``entries`` reads archives with Spark's ``binaryFile`` source, so any file system that Spark reads will do; one row a member, images
by name and size only unless asked for. Everything behind it is joins and projections over (book, ord, name, data).
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from zlib import error as zlib_error

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.functions import paths as P
from quire.functions.rowwise import rowwise

#: Largest member that is read; a larger one is an error of its row, not cut. Fixed value.
MEMBER_BYTES = 256 << 20
_ENTRY = "book string, ord int, name string, size long, data binary, error string"


def members(data: bytes, keep=lambda name: True, most: int = MEMBER_BYTES) -> list[tuple[int, str, int, bytes | None, str | None]]:
    """(number, name, size, data, error) of an archive's files: folders left out, of equal names the first."""
    out, seen = [], set()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir() or info.filename in seen:
                continue
            seen.add(info.filename)
            body = error = None
            if keep(info.filename):
                if info.file_size > most:
                    error = "too large"
                else:
                    try:
                        body = z.read(info)
                    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib_error) as e:
                        error = str(e) or type(e).__name__
            out.append((len(out), info.filename, info.file_size, body, error))
    return out


def _is_image(name: str) -> bool:
    return name.rpartition(".")[2].lower() in P.IMAGE_EXT


def _unpack(images: bool, most: int):
    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = members(data, (lambda n: True) if images else (lambda n: not _is_image(n)), most)
                except zipfile.BadZipFile as e:
                    rows = [(0, "", len(data), None, f"no archive: {e}")]
                for row in rows:  # a member a batch, so that memory holds one archive and one member
                    columns = [[path], *[[x] for x in row]]
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["book", "ord", "name", "size", "data", "error"])

    return run


def book_files(spark: SparkSession, root: str, glob: str = "*.{epub,cbz,zip}") -> DataFrame:
    """(path, size, mtime) of all files below ``root``; Spark lists them, nothing is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def entries(spark: SparkSession, root: str, *, images: bool = True, glob: str = "*.{epub,cbz,zip}", most: int = MEMBER_BYTES) -> DataFrame:
    """(book, ord, name, size, data, error) of all archives below ``root``; without ``images`` those have no data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return entries_of(files.select("path", "content"), images=images, most=most)


def entries_of(archives: DataFrame, *, images: bool = True, most: int = MEMBER_BYTES) -> DataFrame:
    """As ``entries``, of a table of archives: its first column names the book, its second holds the bytes."""
    return archives.mapInArrow(_unpack(images, most), _ENTRY)


def packed(rows: DataFrame) -> DataFrame:
    """Books of ``rows(book, ord, name, data)`` as archives, (book, data): mimetype first, pictures stored. A task holds one book."""

    def build(t: pa.Table) -> pa.Table:
        out = io.BytesIO()
        columns = [t.column(c).to_pylist() for c in ("ord", "name", "data")]
        with zipfile.ZipFile(out, "w") as z:
            for _, name, data in sorted(zip(*columns, strict=True), key=lambda r: (r[1] != "mimetype", r[0])):
                stored = name == "mimetype" or _is_image(name)
                z.writestr(zipfile.ZipInfo(name), data or b"", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
        return pa.table({"book": t.column("book").slice(0, 1), "data": pa.array([out.getvalue()], pa.binary())})

    return rows.select("book", "ord", "name", "data").groupBy("book").applyInArrow(build, "book string, data binary")


# The package document.


def _local(name: str) -> str:
    return name.rpartition(":")[2].lower()


def _started(xml: str):
    return [(_local(n), n, xml[a:b], b) for _, k, n, a, b in M.tags(xml) if k in ("open", "void")]


def root_file(container: str) -> str | None:
    """The first package document that a container file names."""
    full = next((M.attr_value(t, "full-path") for n, _, t, _ in _started(container) if n == "rootfile"), None)
    return full and "/".join(s for s in M.xml_unescape(full).split("/") if s not in ("", "."))


def package(opf: str) -> dict:
    """Manifest and spine in order, metadata, unique identifier and cover of a package document; hrefs as written, references read."""
    items, spine, meta, cover_id = [], [], [], None
    for name, _, tag, _ in _started(opf):
        value = lambda a, t=tag: M.xml_unescape(M.attr_value(t, a) or "")
        if name == "item":
            items.append({"id": value("id"), "href": value("href"), "type": value("media-type"), "properties": value("properties")})
        elif name == "itemref":
            spine.append({"idref": value("idref"), "linear": value("linear").lower() != "no"})
        elif name == "meta" and value("name") == "cover":
            cover_id = cover_id or value("content")
    wanted = next((M.attr_value(t, "unique-identifier") for n, _, t, _ in _started(opf) if n == "package"), None)
    unique = None
    for s in M.spans(opf):
        if ":" in s[0] and s[0].startswith("dc:") or _local(s[0]) == "identifier":
            text = M.plain_text(opf[s[3] : s[4]])
            if text:
                meta.append({"field": _local(s[0]), "value": text})
                if _local(s[0]) == "identifier" and wanted and (M.attr_value(opf[s[2] : s[3]], "id") or "").strip() == wanted.strip():
                    unique = unique or text
    by_id = {i["id"]: i for i in items}
    cover = by_id.get(cover_id) if by_id.get(cover_id, {}).get("type", "").startswith("image/") else None
    cover = cover or next((i for i in items if "cover-image" in i["properties"].split()), None)
    return {"items": items, "spine": spine, "meta": meta, "identifier": unique, "cover": cover and cover["href"]}


_PACKAGE = (
    "struct<items:array<struct<id:string,href:string,type:string,properties:string>>,spine:array<struct<idref:string,linear:boolean>>,"
    "meta:array<struct<field:string,value:string>>,identifier:string,cover:string>"
)
def _of_bytes(kernel):
    """A kernel over a member's bytes: what is no UTF-8 becomes U+FFFD."""
    return lambda data: kernel(data.decode("utf-8", "replace").removeprefix("\ufeff"))


root_file_of = rowwise(_of_bytes(root_file), "string")
package_of = rowwise(_of_bytes(package), _PACKAGE)


def packages(rows: DataFrame) -> DataFrame:
    """(book, name, dir, package) of each book: the document its container names, else the first ``.opf``."""
    text = lambda df: df.where("data is not null").select("book", "ord", "name", F.col("data").alias("xml"))
    named = text(rows.where("name = 'META-INF/container.xml'")).select("book", root_file_of("xml").alias("root"))
    documents = text(rows.where("lower(name) like '%.opf'")).join(named, "book", "left")
    first = documents.groupBy("book").agg(F.min(F.struct(F.expr("not (name <=> root)"), "ord", "name", "xml")).alias("x"))
    return first.select("book", "x.name", P.dir_of(F.col("x.name")).alias("dir"), package_of("x.xml").alias("package"))


def manifest(books: DataFrame) -> DataFrame:
    """(book, ord, id, path, type, properties) of ``packages``."""
    items = books.select("book", "dir", F.posexplode("package.items").alias("ord", "i"))
    return items.select("book", "ord", "i.id", P.resolve(F.col("dir"), P.percent_decoded("i.href")).alias("path"), "i.type", "i.properties")


def spine(books: DataFrame) -> DataFrame:
    """(book, ord, id, path, linear) in reading order; references to nothing left out."""
    refs = books.select("book", F.posexplode("package.spine").alias("ord", "s")).select("book", "ord", F.col("s.idref").alias("id"), "s.linear")
    return refs.join(manifest(books).dropDuplicates(["book", "id"]).select("book", "id", "path"), ["book", "id"]).select("book", "ord", "id", "path", "linear")


def metadata(books: DataFrame) -> DataFrame:
    """(book, ord, field, value) of the Dublin Core fields that hold text."""
    return books.select("book", F.posexplode("package.meta").alias("ord", "m")).select("book", "ord", "m.field", "m.value")


def nav_points(ncx: str) -> list[tuple[int, str, str]]:
    """(depth, label, target) of an NCX map in order; references read."""
    body = next((ncx[s[3] : s[4]] for s in M.spans(ncx) if s[0] == "navmap"), ncx)
    out, depth, label, text_from, in_label = [], 0, "", None, False
    for _, kind, name, a, b in M.tags(body):
        if name == "navpoint":
            depth = max(0, depth + {"open": 1, "close": -1}.get(kind, 0))
            label = "" if kind == "open" else label
        elif name == "navlabel":
            in_label = kind == "open"
        elif name == "text" and kind == "open" and in_label:
            text_from = b
        elif name == "text" and kind == "close" and text_from is not None:
            label, text_from = M.plain_text(body[text_from:a]), None
        elif name == "content" and kind in ("open", "void"):
            out.append((depth, label, M.xml_unescape(M.attr_value(body[a:b], "src") or "")))
    return out


def nav_items(html: str) -> list[tuple[int, str, str]]:
    """(depth, label, target) of the table of contents in a navigation page: the lists of its toc, else of the page."""
    chosen = html
    for s in M.spans(html):
        if s[0] == "nav" and (M.attr_value(html[s[2] : s[3]], "epub:type") or "toc") == "toc":
            chosen = html[s[3] : s[4]]
            break
    out, depth, begun, target = [], 0, None, ""
    for _, kind, name, a, b in M.tags(chosen):
        if name in ("ol", "ul"):
            depth += {"open": 1, "close": -1}.get(kind, 0)
        elif name == "a" and kind == "open":
            begun, target = b, M.unescape_entities(M.attr_value(chosen[a:b], "href") or "")
        elif name == "a" and kind == "close" and begun is not None:
            out.append((max(depth, 1), M.plain_text(chosen[begun:a]), target))
            begun = None
    return out


_TOC = "array<struct<depth:int,label:string,target:string>>"
nav_points_of = rowwise(_of_bytes(nav_points), _TOC)
nav_items_of = rowwise(_of_bytes(nav_items), _TOC)


def toc(rows: DataFrame, books: DataFrame) -> DataFrame:
    """(book, ord, depth, label, path, fragment): from the navigation page, else from the NCX."""
    items = manifest(books)
    nav = items.where(F.array_contains(F.split("properties", r"\s+"), "nav")).select("book", "path", F.lit(0).alias("rank"))
    ncx = items.where("type like '%dtbncx%'").select("book", "path", F.lit(1).alias("rank"))
    found = nav.unionByName(ncx).join(rows.select("book", F.col("name").alias("path"), F.col("data").alias("xml")), ["book", "path"])
    found = found.withColumn("toc", F.when(F.col("rank") == 0, nav_items_of("xml")).otherwise(nav_points_of("xml"))).where(F.size("toc") > 0)
    best = found.groupBy("book").agg(F.min_by(F.struct("path", "toc"), F.struct("rank", "path")).alias("x"))
    lines = best.select("book", P.dir_of(F.col("x.path")).alias("dir"), F.posexplode("x.toc").alias("ord", "t"))
    return lines.select("book", "ord", "t.depth", "t.label", P.resolved("dir", "t.target").alias("r")).select("book", "ord", "depth", "label", "r.path", "r.fragment")


# Pictures.


def image_header(data: bytes) -> dict | None:
    """Kind, width and height from a picture's first bytes; no pixel is decoded."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        w, h = struct.unpack(">II", data[16:24])
        return {"kind": "png", "w": w, "h": h}
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        w, h = struct.unpack("<HH", data[6:10])
        return {"kind": "gif", "w": w, "h": h}
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return {"kind": "bmp", "w": w, "h": abs(h)}
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return {"kind": "webp", "w": 1 + int.from_bytes(data[24:27], "little"), "h": 1 + int.from_bytes(data[27:30], "little")}
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return {"kind": "webp", "w": 1 + (bits & 0x3FFF), "h": 1 + (bits >> 14 & 0x3FFF)}
        w, h = struct.unpack("<HH", data[26:30])
        return {"kind": "webp", "w": w & 0x3FFF, "h": h & 0x3FFF}
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                return None
            mark = data[at + 1]
            if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD8:
                at += 1 if mark == 0xFF else 2
                continue
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return {"kind": "jpg", "w": w, "h": h}
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


image_header_of = rowwise(image_header, "struct<kind:string,w:long,h:long>")


def pixels(header: Column) -> Column:
    """Declared pixels; a million where nothing is declared."""
    return F.coalesce(header["w"] * header["h"], F.lit(1_000_000).cast("long"))


def comic_pages(rows: DataFrame) -> DataFrame:
    """(book, page, name, cover) of picture archives in natural order; the first page is the cover. Books without a picture have none."""
    images = rows.where(P.is_image(F.col("name")) & ~F.col("name").rlike(r"(^|/)(\.|__MACOSX/)")).select("book", "name", P.natural_key(F.col("name")).alias("key"))
    numbered = images.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("key", "name"))).alias("pages"))
    pages = numbered.select("book", F.posexplode("pages").alias("at", "p"))
    return pages.select("book", (F.col("at") + 1).alias("page"), "p.name", (F.col("at") == 0).alias("cover"))


# Text encodings.


def charset_of(data: bytes, header: str | None = None) -> str:
    """BOM, then the header's charset, then the page's, then UTF-8 where it is valid, then GB18030."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name
    for text in (header or "", data[:4096].decode("latin-1")):
        m = re.search(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", text, re.I)
        if m:
            try:
                "".encode(m[1])
                return "gb18030" if m[1].lower() in ("gb2312", "gbk") else m[1].lower()
            except LookupError:
                pass
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "gb18030"


def decode_page(data: bytes, header: str | None = None) -> str:
    return data.decode(charset_of(data, header), "replace").replace("﻿", "").replace("�", "")


charset = rowwise(charset_of, "string")
page_text = rowwise(decode_page, "string")
