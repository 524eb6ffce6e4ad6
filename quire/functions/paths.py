"""Paths and links inside a book, as column expressions; percent codes need bytes, so those are kernels."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.markup import unescape_entities
from quire.functions.rowwise import rowwise

#: File extensions. Fixed values.
HTML_EXT = ("html", "xhtml", "htm")
IMAGE_EXT = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg")


def posix_norm(path: Column) -> Column:
    """Empty and ``.`` segments go; ``..`` takes the segment before, never more than all."""
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    none = F.array().cast("array<string>")
    step = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s))
    return F.array_join(F.aggregate(kept, none, step), "/")


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def resolve(base: Column, link: Column) -> Column:
    """A link against a folder; one that begins with ``/`` is from the root."""
    return posix_norm(F.when(link.startswith("/"), link).otherwise(F.concat(base, F.lit("/"), link)))


def relative_to(base: Column, path: Column) -> Column:
    """``path`` as seen from the folder ``base``."""
    a, b = F.filter(F.split(base, "/"), lambda s: s != ""), F.filter(F.split(path, "/"), lambda s: s != "")
    step = lambda n, i: F.when((n == i) & (F.get(a, i) == F.get(b, i)) & (i < F.size(b) - 1), n + 1).otherwise(n)
    shared = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), F.lit(0), step)
    ups = F.array_repeat(F.lit(".."), F.size(a) - shared)
    return F.array_join(F.concat(ups, F.slice(b, shared + 1, F.size(b))), "/")


def split_href(link: Column) -> Column:
    """struct(path, fragment): at the first ``#``; without one the fragment is null."""
    at = F.instr(link, "#")
    path = F.when(at > 0, F.substr(link, F.lit(1), at - 1)).otherwise(link)
    return F.struct(path.alias("path"), F.when(at > 0, F.substr(link, at + 1, F.length(link))).alias("fragment"))


def is_external(link: Column) -> Column:
    return link.rlike(r"^(//|[A-Za-z][A-Za-z0-9+.\-]*:)")


def is_non_file_ref(link: Column) -> Column:
    return (link == "") | link.rlike(r"(?i)^(#|data:|https?:|//)")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_html(path: Column) -> Column:
    return extension(path).isin(*HTML_EXT)


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXT)


def is_toc_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return name.endswith(".ncx") | (name == "nav.xhtml")


def is_html_entry(path: Column, data: Column) -> Column:
    """By extension; a name without one by its beginning."""
    begins = F.ltrim(F.substring(data.cast("string"), 1, 512)).rlike(r"(?i)^(<\?xml|<!doctype\s+html|<html[\s>])")
    return is_html(path) | ((extension(path) == "") & F.coalesce(begins, F.lit(False)))


def natural_key(path: Column) -> Column:
    """Sorts ``p2`` before ``p10``: every run of digits stands as its length in two digits, and itself."""
    parts = F.regexp_extract_all(F.lower(path), F.lit(r"([0-9]+|[^0-9]+)"))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(p)).cast("string"), 2, "0"), number(p))).otherwise(p)), "")


def percent_decode(text: str) -> str:
    """%XX as bytes; a malformed code stays, ``+`` stays, bytes that are no UTF-8 become U+FFFD."""
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "surrogatepass")).decode("utf-8", "replace")


def encode_href(path: str) -> str:
    return quote(path, safe="/-._~")


def resolve_link(base: str, link: str) -> tuple[str, str | None]:
    """An attribute's text against a folder: (path, fragment); references read, then cut at ``#``, then both decoded."""
    path, sharp, fragment = unescape_entities(link).partition("#")
    path, out = percent_decode(path), []
    for s in (path if path.startswith("/") else f"{base}/{path}").split("/"):
        if s == "..":
            del out[-1:]
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out), percent_decode(fragment) if sharp else None


percent_decoded = rowwise(percent_decode, "string")
href_encoded = rowwise(encode_href, "string")
resolved = rowwise(resolve_link, "struct<path:string,fragment:string>")
