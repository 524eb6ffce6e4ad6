"""Links of a book against its files and anchors, and identifiers that must be unique: joins and anti-joins, keyed by book.

``pages(book, ord, name, html)`` are the pages in reading order, ``files(book, name)`` all members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import css as C
from quire.functions import markup as M
from quire.functions import paths as P
from quire.functions.rowwise import rowwise


def internal_links(pages: DataFrame) -> DataFrame:
    """(book, name, ord, at, tag, attr, path, fragment) of all links that leave no book; a bare fragment is its own page's."""
    found = pages.select("book", "name", "ord", F.posexplode(M.links_of("html")).alias("at", "l"))
    found = found.where(~P.is_external(F.col("l.value")) & (F.col("l.value") != ""))
    found = found.withColumn("r", P.resolved(P.dir_of(F.col("name")), "l.value"))
    own = F.col("l.value").startswith("#")
    return found.select("book", "name", "ord", "at", "l.tag", "l.attr", F.when(own, F.col("name")).otherwise(F.col("r.path")).alias("path"), F.col("r.fragment").alias("fragment"))


def anchor_set(pages: DataFrame) -> DataFrame:
    """(book, path, fragment) of all anchors, once each."""
    found = pages.select("book", F.col("name").alias("path"), F.explode(M.anchors_of("html")).alias("a"))
    return found.select("book", "path", F.col("a.id").alias("fragment")).distinct()


def checked_links(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Each internal link with ``file_ok`` and ``anchor_ok`` (null without a fragment, or where the file is no page)."""
    links = internal_links(pages)
    known = files.select("book", F.col("name").alias("path"), F.lit(True).alias("is_file")).distinct()
    of_page = pages.select("book", F.col("name").alias("path"), F.lit(True).alias("is_page")).distinct()
    anchors = anchor_set(pages).withColumn("is_anchor", F.lit(True))
    joined = links.join(known, ["book", "path"], "left").join(of_page, ["book", "path"], "left").join(anchors, ["book", "path", "fragment"], "left")
    anchor_ok = F.when(F.coalesce("fragment", F.lit("")) != "", F.when(F.col("is_page"), F.coalesce("is_anchor", F.lit(False))))
    return joined.select("book", "name", "ord", "at", "tag", "attr", "path", "fragment", F.coalesce("is_file", F.lit(False)).alias("file_ok"), anchor_ok.alias("anchor_ok"))


def check(pages: DataFrame, files: DataFrame, least: float = 0.8) -> DataFrame:
    """A row a book: links, hits, and whether the shares of files and anchors that exist reach ``least``; and pages' tags of two ids."""
    links = checked_links(pages, files)
    of_links = links.groupBy("book").agg(F.count("*").alias("links"), F.count_if("file_ok").alias("file_hits"), F.count("anchor_ok").alias("anchors"), F.count_if("anchor_ok").alias("anchor_hits"))
    doubled = pages.groupBy("book").agg(F.sum(M.duplicate_id_tags_of("html")).alias("duplicate_id_tags"))
    out = doubled.join(of_links, "book", "left").na.fill(0)
    fine = (F.col("file_hits") >= least * F.col("links")) & (F.col("anchor_hits") >= least * F.col("anchors")) & (F.col("duplicate_id_tags") == 0)
    return out.withColumn("ok", fine)


def references(pages: DataFrame) -> DataFrame:
    """(book, name, path) of the pictures that pages show, less those of other hosts; a query behind ``?`` is no part of a path."""
    links = internal_links(pages).where("tag in ('img', 'image')")
    return links.select("book", "name", F.regexp_replace("path", r"\?.*$", "").alias("path"))


def dead_images(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Picture references without a file of that name, whatever its case: the anti-join of what pages show against members."""
    known = files.select("book", F.lower("name").alias("low")).distinct()
    refs = references(pages).withColumn("low", F.lower("path"))
    return refs.join(known, ["book", "low"], "left_anti").select("book", "name", "path")


def _drop_images(html: str, dead: list[str], base: str) -> str:
    """Pictures whose file is dead go, but for those with a telling ``alt``."""
    gone, edits = set(dead or ()), []  # a kernel sees all rows, those without dead pictures, too
    for _, kind, name, a, b in M.tags(html):
        if name == "img" and kind in ("open", "void"):
            tag = html[a:b]
            src, alt = M.attr_value(tag, "src") or "", (M.attr_value(tag, "alt") or "").strip().lower()
            if P.resolve_link(base, src.partition("?")[0])[0] in gone and alt in ("", "cover"):
                edits.append((a, b, ""))
    return M.apply_edits(html, edits)


_without_images = rowwise(_drop_images, "string")


def drop_dead_images(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``pages`` without pictures that have no file."""
    dead = dead_images(pages, files).groupBy("book", "name").agg(F.collect_set("path").alias("dead"))
    joined = pages.join(dead, ["book", "name"], "left")
    return joined.withColumn("html", _without_images("html", "dead", P.dir_of(F.col("name")))).drop("dead").select(*pages.columns)


def drop_dead_faces(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """``sheets(book, name, css)`` without @font-face rules of which no file is there and none is local."""
    faces = sheets.select("book", "name", F.explode(C.font_faces_of("css")).alias("f")).select("book", "name", F.explode("f.files").alias("url"))
    faces = faces.withColumn("path", P.resolved(P.dir_of(F.col("name")), "url")["path"])
    alive = faces.join(files.select("book", F.col("name").alias("path")).distinct(), ["book", "path"], "left_semi")
    alive = alive.groupBy("book", "name").agg(F.collect_set("url").alias("alive"))
    joined = sheets.join(alive, ["book", "name"], "left")
    return joined.withColumn("css", C.faces_dropped("css", F.coalesce("alive", F.array().cast("array<string>")))).drop("alive").select(*sheets.columns)


def duplicate_ids(pages: DataFrame) -> DataFrame:
    """(book, name, id, renamed): ids that an earlier page has too get the smallest ``-x2``, ``-x3`` ... that the book has nowhere.

    One row a page and id. The new names of one id come from the window of its copies; a name that some page has already is passed over.
    """
    ids = pages.select("book", "ord", "name", F.explode(F.array_distinct(F.transform(M.anchors_of("html"), lambda a: a["id"]))).alias("id"))
    order = Window.partitionBy("book", "id").orderBy("ord", "name")
    copies = ids.withColumn("copy", F.row_number().over(order))
    # The numbers that the book has taken already for an id: its own ids of the form id-xN.
    taken = ids.where(F.col("id").rlike("-x[0-9]+$")).select("book", F.regexp_extract("id", "^(.*)-x[0-9]+$", 1).alias("id"), F.regexp_extract("id", "([0-9]+)$", 1).cast("int").alias("n"))
    taken = taken.groupBy("book", "id").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    later = copies.where("copy > 1").join(taken, ["book", "id"], "left")
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("copy"), lambda n, t: F.when((t >= 2) & (t <= n), n + 1).otherwise(n))
    return later.select("book", "name", "id", F.concat("id", F.lit("-x"), free.cast("string")).alias("renamed"))


def safe_names(files: DataFrame) -> DataFrame:
    """(book, name, renamed) of members whose file part holds characters that some systems refuse; equal results get -2, -3 ..."""
    base = F.regexp_extract("name", "([^/]*)$", 1)
    safe = F.regexp_replace(base, r'[*:?"<>|\\\x00-\x1f]', "_")
    moved = files.select("book", "name", F.concat(F.regexp_extract("name", "^(.*/)?[^/]*$", 1), safe).alias("to"))
    order = Window.partitionBy("book", F.lower("to")).orderBy(F.col("name") != F.col("to"), "name")
    moved = moved.withColumn("nth", F.row_number().over(order))
    numbered = F.concat(F.regexp_extract("to", r"^(.*?)(\.[^./]*)?$", 1), F.lit("-"), F.col("nth").cast("string"), F.regexp_extract("to", r"(\.[^./]*)?$", 1))
    return moved.withColumn("renamed", F.when(F.col("nth") == 1, F.col("to")).otherwise(numbered)).where("renamed <> name").select("book", "name", "renamed")


def note_links(pages: DataFrame) -> DataFrame:
    """Mutual pairs: a link and the link back, between anchors of their own; (book, path, fragment, note_path, note_fragment), the call first in reading order."""

    def own(html: str) -> list[dict]:
        out = []
        for _, kind, name, a, b in M.tags(html):
            if name == "a" and kind == "open":
                tag = html[a:b]
                at, to = M.attr_value(tag, "id"), M.attr_value(tag, "href")
                if at and to and "#" in to:
                    out.append({"id": M.unescape_entities(at), "href": to, "start": a})
        return out

    own_links = rowwise(own, "array<struct<id:string,href:string,start:int>>")
    found = pages.select("book", "ord", "name", F.explode(own_links("html")).alias("l"))
    r = P.resolved(P.dir_of(F.col("name")), "l.href")
    edges = found.select("book", "ord", F.col("name").alias("path"), F.col("l.id").alias("fragment"), F.col("l.start").alias("start"), r.alias("r"), F.col("l.href").startswith("#").alias("same"))
    edges = edges.select("book", "ord", "path", "fragment", "start", F.when(F.col("same"), F.col("path")).otherwise(F.col("r.path")).alias("to_path"), F.col("r.fragment").alias("to_fragment"))
    back = edges.select("book", F.col("ord").alias("note_ord"), F.col("start").alias("note_start"), F.col("path").alias("to_path"), F.col("fragment").alias("to_fragment"), F.col("to_path").alias("path"), F.col("to_fragment").alias("fragment"))
    both = edges.join(back, ["book", "path", "fragment", "to_path", "to_fragment"]).where("ord < note_ord or (ord = note_ord and start < note_start)")
    return both.select("book", "path", "fragment", F.col("to_path").alias("note_path"), F.col("to_fragment").alias("note_fragment")).distinct()
