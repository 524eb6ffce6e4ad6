"""Tables of contents: nesting, collections, chunks, and writing them. A book's contents are a bounded list, so most rules are folds
over one array; across books everything is keyed by book."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.functions.rowwise import rowwise

#: Numerals, part words and front matter of chapter titles. Fixed values.
NUMERAL = "0-9０-９一二三四五六七八九十百千零〇两"
PARTS = "部卷篇辑"
FRONT = "题献|献词|献辞|题记|前言|序|序言|序章|引言|引子|楔子|译序|译者序|出版说明|书名页|目录|版权页?"
CHUNK = 20


def dense_levels(levels: Column) -> Column:
    """Used heading levels as 1, 2, 3 ... in place."""
    used = F.array_sort(F.array_distinct(levels))
    return F.transform(levels, lambda n: F.array_position(used, n).cast("int"))


def page_chunks(pages: Column, each: int = CHUNK) -> Column:
    """Every ``each``-th page, from the first on: struct(page, title)."""
    chosen = F.filter(pages, lambda p, i: i % each == 0)
    return F.transform(chosen, lambda p: F.struct(p.alias("page"), p.cast("string").alias("title")))


def toc_count(entries: DataFrame) -> DataFrame:
    """(book, entries): rows of a table of contents, less those that point at the table's own page."""
    return entries.where("not (path <=> own)").groupBy("book").agg(F.count("*").alias("entries"))


def collection_depths(titles: list[str]) -> list[int] | None:
    """Depths of a flat table of contents of a collection: volume, work, part, chapter; null where it is none.

    A work is a plain title behind which (front matter left out) a first part or chapter follows. There must be two volumes or two works.
    """
    kinds = []
    for t in titles:
        close = re.sub(r"\s", "", t)
        if re.fullmatch(f"第[{NUMERAL}]+册|[上中下]册", close):
            kinds.append("volume")
        elif re.match(f"第[{NUMERAL}]+[{PARTS}]", t):
            kinds.append("part")
        elif re.match(f"第[{NUMERAL}]+[章回]", t):
            kinds.append("chapter")
        else:
            kinds.append("front" if re.fullmatch(FRONT, close) else "plain")
    works = []
    for i, kind in enumerate(kinds):
        after = next((j for j in range(i + 1, len(kinds)) if kinds[j] != "front"), None)
        works.append(kind == "plain" and after is not None and kinds[after] in ("part", "chapter") and re.match("第[一1１][部卷篇辑章回]", titles[after]) is not None)
    by_volume, by_work = kinds.count("volume") >= 2, sum(works) >= 2
    if not by_volume and not by_work:
        return None
    out, base, in_work, in_part = [], 1, 0, 0
    for kind, work in zip(kinds, works, strict=True):
        if kind == "volume" and by_volume:
            base, in_work, in_part = 2, 0, 0
            out.append(1)
        elif by_work and work:
            in_work, in_part = 1, 0
            out.append(base)
        elif kind == "part":
            in_part = 1
            out.append(base + in_work)
        elif kind == "chapter":
            out.append(base + in_work + in_part)
        elif kind == "front" and in_work:
            out.append(base + 1)
        else:
            in_work = in_part = 0
            out.append(base)
    return out


def nest_parts(rows: list[tuple[int, str]]) -> list[int]:
    """New depths of (depth, title): a part without children takes its following siblings, with all below them, up to the next part."""
    depths = [d for d, _ in rows]
    is_part = [re.match(f"第[{NUMERAL}]+[{PARTS}]", t) is not None for _, t in rows]
    out = list(depths)
    for i, d in enumerate(depths):
        if not is_part[i] or (i + 1 < len(rows) and depths[i + 1] > d):
            continue
        for j in range(i + 1, len(rows)):
            if depths[j] < d or (depths[j] == d and is_part[j]):
                break
            out[j] += 1
    return out


def nested(rows: list[dict]) -> list[dict]:
    """Depths without gaps: no row is more than one deeper than the row before, the first is 1."""
    out, before = [], 0
    for r in rows:
        before = max(1, min(r["depth"], before + 1))
        out.append({**r, "depth": before})
    return out


def write_nav(rows: list[dict]) -> str:
    """Nested lists of (depth, label, target)."""
    out, open_at = [], 0
    for r in nested(rows):
        if r["depth"] > open_at:
            out.append("<ol>")
        else:
            out.append("</li>" + "</ol></li>" * (open_at - r["depth"]))
        open_at = r["depth"]
        out.append(f'<li><a href="{M.xml_escape(r["target"])}">{M.xml_escape(r["label"])}</a>')
    return "".join(out) + ("</li></ol>" * open_at)


def write_ncx(rows: list[dict]) -> str:
    """A nested NCX map of (depth, label, target), numbered in order."""
    out, open_at = ["<navMap>"], 0
    for i, r in enumerate(nested(rows), 1):
        out.append("</navPoint>" * max(0, open_at - r["depth"] + 1))
        open_at = r["depth"]
        out.append(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{M.xml_escape(r["label"])}</text></navLabel><content src="{M.xml_escape(r["target"])}"/>')
    return "".join(out) + "</navPoint>" * open_at + "</navMap>"


collection_depths_of = rowwise(collection_depths, "array<int>")
nest_parts_of = rowwise(lambda depths, titles: nest_parts(list(zip(depths, titles, strict=True))), "array<int>")
nav_of = rowwise(write_nav, "string")
ncx_of = rowwise(write_ncx, "string")


def headings(pages: DataFrame) -> DataFrame:
    """(book, ord, at, level, depth, title) of pages' headings in reading order; depth counts the book's used levels only."""

    def found(html: str) -> list[dict]:
        return [{"level": int(s[0][1]), "title": t} for s in M.spans(html) if M.heading_level(s[0]) and (t := M.plain_text(html[s[3] : s[4]]))]

    rows = pages.select("book", "ord", F.posexplode(rowwise(found, "array<struct<level:int,title:string>>")("html")).alias("at", "h"))
    used = rows.groupBy("book").agg(F.array_sort(F.collect_set("h.level")).alias("used"))
    return rows.join(used, "book").select("book", "ord", "at", "h.level", F.array_position("used", F.col("h.level")).cast("int").alias("depth"), "h.title")
