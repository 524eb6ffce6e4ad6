"""Markup: one tokenizer for all that looks at tags, attributes, text and links of a page.

Offsets are in characters. A token is a tag, a comment, a CDATA section or a declaration; quoted attribute values may hold ``>``.
What stands between tokens is text. Kernels work on one page; the column functions at the end carry them over columns.
"""

from __future__ import annotations

import re
from html.entities import html5

from quire.functions.rowwise import rowwise

#: Elements without content, block elements, and elements whose presence makes a page visible. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
MEDIA = frozenset("img svg image hr table video audio math object".split())
#: Elements whose body is no text. Fixed values.
HIDDEN = frozenset(("style", "script", "title"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_NAME = re.compile(r"</?([^\s/>]+)")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_ENTITY = re.compile(r"&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,37});")
_XML = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def tags(html: str) -> list[tuple[int, str, str, int, int]]:
    """(number, kind, lower-cased name, start, end) of each token; kinds: open, close, void (self-closing), other."""
    out = []
    for i, m in enumerate(_TOKEN.finditer(html)):
        text = m.group()
        if text[1] in "!?":
            kind, name = "other", ""
        else:
            name = _NAME.match(text).group(1).lower()
            kind = "close" if text[1] == "/" else "void" if text.endswith("/>") else "open"
        out.append((i, kind, name, m.start(), m.end()))
    return out


def _number(ref: str) -> str | None:
    n = int(ref[2:], 16) if ref[1] in "xX" else int(ref[1:])
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else None


def unescape_entities(text: str) -> str:
    """Numeric and named references that end in a semicolon; unknown ones stay."""
    return _ENTITY.sub(lambda m: (_number(m[1]) if m[1][0] == "#" else html5.get(m[1] + ";")) or m[0], text)


def xml_unescape(text: str) -> str:
    """The five references of XML, and numeric ones."""
    return _ENTITY.sub(lambda m: (_number(m[1]) if m[1][0] == "#" else _XML.get(m[1])) or m[0], text)


def xml_escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def is_xml_char(c: str) -> bool:
    n = ord(c)
    return n in (9, 10, 13) or 0x20 <= n < 0xD800 or 0xE000 <= n < 0xFFFE or n >= 0x10000


def text_runs(html: str) -> list[tuple[int, int]]:
    """(start, end) of what stands between tokens, less the bodies of hidden elements."""
    out, at, skipped = [], 0, None
    for _, kind, name, start, end in tags(html):
        if skipped is None and start > at:
            out.append((at, start))
        if skipped is None and kind == "open" and name in HIDDEN:
            skipped = name
        elif kind == "close" and name == skipped:
            skipped = None
        at = end
    if skipped is None and at < len(html):
        out.append((at, len(html)))
    return out


def plain_text(html: str) -> str:
    """Text without tags, comments and hidden bodies (none leaves a blank), references read, white space folded and trimmed."""
    return " ".join(unescape_entities("".join(html[a:b] for a, b in text_runs(html))).split())


def has_visible(html: str) -> bool:
    """Any character that is no white space, or an element that shows without text."""
    return last_visible_end(html) > 0


def last_visible_end(html: str) -> int:
    """Where the last visible text or element ends; 0 if there is none."""
    last = max((e for _, k, n, _, e in tags(html) if k != "close" and n in MEDIA), default=0)
    for a, b in reversed(text_runs(html)):
        if b <= last:
            break
        shown = unescape_entities(html[a:b])
        if shown.strip():
            cut = b
            while cut > a and not unescape_entities(html[cut - 1 : b]).strip() and not html[cut - 1 : b].lstrip().startswith(";"):
                cut -= 1
            return max(last, cut if unescape_entities(html[a:cut]).strip() else b)
    return last


def attrs(tag: str) -> list[tuple[str, str]]:
    """(name, value) of a tag's attributes in order, as written but for the quotes; one without a value has ''."""
    m = _NAME.match(tag)
    inside = tag[m.end() :].removesuffix(">").removesuffix("/") if m else ""
    return [(n, v[1:-1] if v[:1] in ('"', "'") else v) for n, v in _ATTR.findall(inside)]


def attr_value(tag: str, name: str) -> str | None:
    """One attribute by its name, whatever its case; ``id`` is not ``data-id``."""
    return next((v for n, v in attrs(tag) if n.lower() == name.lower()), None)


def _attr_span(tag: str, name: str) -> tuple[int, int] | None:
    m = _NAME.match(tag)
    if not m:
        return None
    for a in _ATTR.finditer(tag, m.end(), len(tag) - (2 if tag.endswith("/>") else 1)):
        if a[1].lower() == name.lower():
            return a.span()
    return None


def set_attr(tag: str, name: str, value: str) -> str:
    """The tag with the attribute set; a new one goes last."""
    written = f'{name}="{value.replace(chr(34), "&quot;")}"'
    span = _attr_span(tag, name)
    if span:
        return tag[: span[0]] + written + tag[span[1] :]
    end = "/>" if tag.endswith("/>") else ">"
    return f"{tag.removesuffix(end).rstrip()} {written}{end}"


def remove_attr(tag: str, name: str) -> str:
    span = _attr_span(tag, name)
    return tag if span is None else tag[: span[0]].rstrip() + tag[span[1] :]


def has_class(tag: str, name: str) -> bool:
    return name in (attr_value(tag, "class") or "").split()


def add_class(tag: str, name: str) -> str:
    held = attr_value(tag, "class")
    return tag if has_class(tag, name) else set_attr(tag, "class", f"{held} {name}" if held and held.strip() else name)


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Replace spans, given in any order; one that overlaps an earlier one is an error."""
    out, at = [], 0
    for start, end, by in sorted(edits):
        if start < at:
            raise ValueError("edits overlap")
        out += [text[at:start], by]
        at = end
    return "".join([*out, text[at:]])


def edit_attrs(html: str, names: set[str], change) -> str:
    """Every listed attribute through ``change(tag name, attribute name, value)``; None leaves it, '' as a result empties it."""
    edits = []
    for _, kind, tag_name, start, end in tags(html):
        if kind in ("open", "void"):
            tag = html[start:end]
            for n, v in attrs(tag):
                if n.lower() in names and (new := change(tag_name, n.lower(), v)) is not None:
                    tag = set_attr(tag, n, new)
            if tag != html[start:end]:
                edits.append((start, end, tag))
    return apply_edits(html, edits)


def edit_style_attrs(html: str, change) -> str:
    """Every style attribute through ``change(tag name, css)``, which sees references read."""

    def one(tag: str, _: str, value: str):
        new = change(tag, unescape_entities(value))
        return None if new is None else new.replace("&", "&amp;").replace('"', "&quot;")

    return edit_attrs(html, {"style"}, one)


def matching_close(html: str, start: int) -> tuple[int, int] | None:
    """The close tag of the open tag that begins at ``start``; elements of its name nest."""
    depth, name = 0, None
    for _, kind, tag, a, b in tags(html):
        if a < start:
            continue
        if name is None:
            if a != start or kind != "open":
                return None
            name, depth = tag, 1
        elif tag == name:
            depth += {"open": 1, "close": -1}.get(kind, 0)
            if not depth:
                return a, b
    return None


def spans(html: str) -> list[tuple[str, int, int, int, int, int]]:
    """Elements in the order of their starts: (name, depth, start, content start, content end, end). An unclosed one ends with its parent."""
    out, open_at = [], []
    for _, kind, name, a, b in tags(html):
        if kind == "void" or (kind == "open" and name in VOID):
            out.append([name, len(open_at), a, b, b, b])
        elif kind == "open":
            out.append([name, len(open_at), a, b, None, None])
            open_at.append(len(out) - 1)
        elif kind == "close" and any(out[i][0] == name for i in open_at):
            while open_at:
                i = open_at.pop()
                out[i][4:] = (a, b) if out[i][0] == name else (a, a)
                if out[i][0] == name:
                    break
    for i in open_at:
        out[i][4:] = len(html), len(html)
    return [tuple(x) for x in out]


def body_range(html: str) -> tuple[int, int] | None:
    """Where the first body's content begins and the last body close tag stands."""
    found = [(k, a, b) for _, k, n, a, b in tags(html) if n == "body"]
    first = next((b for k, a, b in found if k == "open"), None)
    return None if first is None else (first, next((a for k, a, b in reversed(found) if k == "close" and a >= first), len(html)))


def first_body_inner(html: str) -> str:
    r = body_range(html)
    return html if r is None else html[r[0] : r[1]]


def style_blocks(html: str) -> list[tuple[str, str, int, int]]:
    """(open tag, css, content start, content end) of each closed style block; its content is raw text."""
    out, at = [], 0
    pattern = re.compile(r"</style\s*>", re.I)
    while m := _TOKEN.search(html, at):
        at = m.end()
        if re.match(r"<style[\s>]", m.group(), re.I) and not m.group().endswith("/>"):
            close = pattern.search(html, at)
            if close is None:
                break
            out.append((m.group(), html[at : close.start()], at, close.start()))
            at = close.end()
    return out


def anchors(html: str) -> list[tuple[str, int]]:
    """(id, offset of its tag): every id, and the name of an ``a``."""
    out = []
    for _, kind, name, a, b in tags(html):
        if kind in ("open", "void"):
            for n, v in attrs(html[a:b]):
                if (n.lower() == "id" or (name == "a" and n.lower() == "name")) and v:
                    out.append((unescape_entities(v), a))
    return out


def link_values(html: str) -> list[tuple[str, str, str]]:
    """(tag, attribute, value) of every href, src and xlink:href."""
    return [(name, n.lower(), v) for _, kind, name, a, b in tags(html) if kind in ("open", "void") for n, v in attrs(html[a:b]) if n.lower() in ("href", "src", "xlink:href")]


def duplicate_id_tags(html: str) -> int:
    """Tags with more than one id."""
    return sum(sum(n.lower() == "id" for n, _ in attrs(html[a:b])) > 1 for _, k, _, a, b in tags(html) if k in ("open", "void"))


def collapse_duplicate_ids(html: str) -> str:
    """Of a tag's id attributes the first stays."""
    edits = []
    for _, kind, _, a, b in tags(html):
        tag = html[a:b]
        if kind in ("open", "void") and sum(n.lower() == "id" for n, _ in attrs(tag)) > 1:
            m, seen, cuts = _NAME.match(tag), False, []
            for x in _ATTR.finditer(tag, m.end(), len(tag) - 1):
                if x[1].lower() == "id":
                    if seen:
                        cuts.append((x.start() - 1 if tag[x.start() - 1].isspace() else x.start(), x.end(), ""))
                    seen = True
            edits.append((a, b, apply_edits(tag, cuts)))
    return apply_edits(html, edits)


def rename_ids(html: str, names: dict[str, str]) -> str:
    """Ids by the map, and links to them inside the page."""

    def change(tag: str, name: str, value: str):
        if name == "href":
            return "#" + names[value[1:]] if value[:1] == "#" and value[1:] in names else None
        return names.get(value) if name == "id" or tag == "a" else None

    return edit_attrs(html, {"id", "name", "href"}, change)


def is_external(link: str) -> bool:
    """``//...`` or a scheme before the first colon."""
    return link.startswith("//") or re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", link) is not None


def heading_level(name: str) -> int | None:
    return int(name[1]) if re.fullmatch(r"[hH][1-6]", name) else None


def ensure_lang(html: str, lang: str) -> str:
    """The html tag with lang and xml:lang where they are missing."""
    for _, kind, name, a, b in tags(html):
        if name == "html" and kind == "open":
            tag = html[a:b]
            for n in ("lang", "xml:lang"):
                if attr_value(tag, n) is None:
                    tag = set_attr(tag, n, lang)
            return html[:a] + tag + html[b:]
    return html


def trim_tail(html: str) -> str:
    """A body without what follows its last visible content, but for close tags."""
    r = body_range(html)
    if r is None:
        return html
    inner = html[r[0] : r[1]]
    end = last_visible_end(inner)
    if not end:
        return html
    opened = [s for s in spans(inner) if s[2] < end <= s[5] and s[4] != s[3]]
    kept = inner[:end] + "".join(inner[s[4] : s[5]] for s in reversed(opened) if s[5] > end and s[4] >= end)
    return html[: r[0]] + kept + html[r[1] :]


_TAG = "array<struct<ord:int,kind:string,name:string,start:int,end:int>>"
tags_of = rowwise(tags, _TAG)
spans_of = rowwise(spans, "array<struct<name:string,depth:int,start:int,inner_start:int,inner_end:int,end:int>>")
attrs_of = rowwise(attrs, "array<struct<name:string,value:string>>")
plain_text_of = rowwise(plain_text, "string")
visible_of = rowwise(has_visible, "boolean")
last_visible_of = rowwise(last_visible_end, "int")
unescaped = rowwise(unescape_entities, "string")
xml_unescaped = rowwise(xml_unescape, "string")
anchors_of = rowwise(anchors, "array<struct<id:string,start:int>>")
links_of = rowwise(link_values, "array<struct<tag:string,attr:string,value:string>>")
style_blocks_of = rowwise(style_blocks, "array<struct<tag:string,css:string,start:int,end:int>>")
body_of = rowwise(first_body_inner, "string")
duplicate_id_tags_of = rowwise(duplicate_id_tags, "long")
collapsed_ids = rowwise(collapse_duplicate_ids, "string")
with_lang = rowwise(ensure_lang, "string")
tail_trimmed = rowwise(trim_tail, "string")
