"""Style sheets: rule spans, declarations, selectors' specificity and keys, media conditions, shorthands.

One scanner knows strings, comments and brackets; all else is built on it. A lone quote ends at its line's end, an unclosed block at
the sheet's end.
"""

from __future__ import annotations

import re

from quire.functions.rowwise import rowwise

_SCAN = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)|\\.|.", re.S)
#: Media types that hold. Fixed values.
MEDIA_TYPES = ("all", "screen", "amzn-kf8")
#: Pseudo-elements that may be written with one colon. Fixed values.
_OLD_ELEMENTS = (":before", ":after", ":first-line", ":first-letter")


def _parts(text: str):
    """(text, start) of comments, strings, escapes and single characters."""
    return ((m.group(), m.start()) for m in _SCAN.finditer(text))


def strip_comments(css: str) -> str:
    """Each comment as one blank; those inside strings stay."""
    return "".join(" " if p.startswith("/*") else p for p, _ in _parts(css))


def split_top(text: str, at: str) -> list[str]:
    """Split where ``at`` stands outside strings and brackets."""
    out, depth = [""], 0
    for p, _ in _parts(text):
        depth += (p in ("(", "[", "{")) - (p in (")", "]", "}"))
        if p == at and depth <= 0:
            out.append("")
        else:
            out[-1] += p
    return out


def tokens(text: str) -> list[str]:
    """Words of a value; comments divide, strings and brackets hold together."""
    return [t.strip() for t in split_top(re.sub(r"[\t\n\r\f]", " ", strip_comments(text)), " ") if t.strip()]


def rule_spans(css: str) -> list[tuple[str, str, list[str], bool]]:
    """(prelude, body, enclosing preludes, closed) of each rule that holds declarations, in order.

    ``@media`` and ``@supports`` enclose rules; other blocks are rules themselves.
    """
    out, parents, prelude, body, depth = [], [], "", None, 0
    for p, _ in _parts(css):
        if body is not None:
            depth += (p == "{") - (p == "}")
            if depth < 0:
                out.append((prelude.strip(), body, list(parents), True))
                prelude, body, depth = "", None, 0
            else:
                body += p
        elif p == "{":
            named = selector_of(prelude)
            if re.match(r"@(media|supports|layer|document)\b", named, re.I):
                parents.append(named)
                prelude = ""
            else:
                body = ""
        elif p == "}":
            if parents:
                parents.pop()
            prelude = ""
        else:
            prelude += p
    if body is not None:
        out.append((prelude.strip(), body, list(parents), False))
    return out


def selector_of(prelude: str) -> str:
    """A prelude without comments and without statements before it (``@charset ...;``)."""
    return split_top(strip_comments(prelude), ";")[-1].strip()


def declarations(css: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) in order; shorthand boxes are not expanded here."""
    out = []
    for one in split_top(strip_comments(css), ";"):
        name, colon, value = one.partition(":")
        if colon and name.strip() and value.strip():
            m = re.search(r"\s*!\s*important\s*$", value, re.I)
            out.append((name.strip().lower(), (value[: m.start()] if m else value).strip(), m is not None))
    return out


def urls(css: str) -> list[tuple[str, str | None, int, int]]:
    """(value, quote, start, end) of every url(...)."""
    found = re.finditer(r"url\(\s*(?:\"([^\"]*)\"|'([^']*)'|([^)\"'\s]*))\s*\)", css, re.I)
    return [(next(g for g in m.groups() if g is not None), '"' if m[1] is not None else "'" if m[2] is not None else None, m.start(), m.end()) for m in found]


def four_values(value: str) -> list[str] | None:
    """One to four values as top, right, bottom, left."""
    t = tokens(value)
    return {1: lambda: t * 4, 2: lambda: [t[0], t[1]] * 2, 3: lambda: [t[0], t[1], t[2], t[1]], 4: lambda: t}.get(len(t), lambda: None)()


def expanded(css: str) -> list[tuple[str, str, bool]]:
    """Declarations with margin, padding and border widths by side."""
    out = []
    for name, value, important in declarations(css):
        sides = four_values(value) if name in ("margin", "padding") else None
        out += [(f"{name}-{s}", v, important) for s, v in zip(("top", "right", "bottom", "left"), sides, strict=True)] if sides else [(name, value, important)]
    return out


def specificity(selector: str) -> tuple[int, int, int]:
    """(ids, classes, elements). ``:where`` counts nothing, ``:is`` and ``:not`` their weightiest argument."""
    a = b = c = 0
    s, i = selector, 0
    ident = re.compile(r"(?:\\.|[\w\-]|[^\x00-\x7f])+")
    while i < len(s):
        ch = s[i]
        m = ident.match(s, i + 1) if ch in "#." else ident.match(s, i)
        if ch == "#" and m:
            a, i = a + 1, m.end()
        elif ch == "." and m:
            b, i = b + 1, m.end()
        elif ch == "[":
            depth, j = 0, i
            for p, at in _parts(s[i:]):
                depth += (p == "[") - (p == "]")
                j = i + at + len(p)
                if not depth:
                    break
            b, i = b + 1, j
        elif ch == ":":
            m = re.compile(r"::?[\w\-]+").match(s, i)
            if not m:
                i += 1
                continue
            name, i = m.group().lower(), m.end()
            inner = None
            if i < len(s) and s[i] == "(":
                depth, start = 0, i + 1
                for p, at in _parts(s[i:]):
                    depth += (p == "(") - (p == ")")
                    if not depth:
                        inner, i = s[start : i + at], i + at + 1
                        break
                else:
                    i = len(s)
            if name.startswith("::") or name in _OLD_ELEMENTS:
                c += 1
            elif name in (":is", ":not", ":has"):
                x = max((specificity(p) for p in split_top(inner or "", ",")), default=(0, 0, 0))
                a, b, c = a + x[0], b + x[1], c + x[2]
            elif name != ":where":
                b += 1
        elif m:
            c, i = c + 1, m.end()
        else:
            i += 1
    return a, b, c


def bucket(selector: str) -> str:
    """Under which key an element must look to meet the selector: the id, class or tag of its last compound, else ``*``."""
    last = re.split(r"[\s>+~]+", re.sub(r"\[[^\]]*\]|\([^)]*\)", "", selector).strip())[-1]
    last = re.split("::?", last)[0]
    for pattern in (r"#((?:\\.|[\w\-]|[^\x00-\x7f])+)", r"\.((?:\\.|[\w\-]|[^\x00-\x7f])+)"):
        m = re.search(pattern, last)
        if m:
            return m.group().replace("\\", "")
    m = re.match(r"[\w\-]+", last)
    return m.group().lower() if m else "*"


def simple(selector: str) -> dict | None:
    """tag, id and classes of a selector that is one compound of these; null for any other."""
    m = re.fullmatch(r"(\*|[\w\-]+)?((?:[#.](?:[\w\-]|[^\x00-\x7f])+)*)", selector.strip())
    if not m or not selector.strip():
        return None
    parts = re.findall(r"[#.][^#.]+", m[2])
    return {"tag": "" if m[1] in (None, "*") else m[1].lower(), "ids": [p[1:] for p in parts if p[0] == "#"], "classes": [p[1:] for p in parts if p[0] == "."]}


def _px(value: str) -> float | None:
    m = re.fullmatch(r"([0-9]*\.?[0-9]+)(px|in|cm|mm|pt|pc)?", value)
    if not m or (not m[2] and float(m[1])):
        return None
    return float(m[1]) * {"px": 1, "in": 96, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 4 / 3, "pc": 16, None: 1}[m[2]]


def _feature(text: str, env: dict) -> bool | None:
    name, _, value = (x.strip() for x in text.partition(":"))
    if name == "orientation":
        return {"portrait": env["height"] >= env["width"], "landscape": env["height"] < env["width"]}.get(value)
    if name in ("color", "monochrome"):
        held = env["color"] == (name == "color")
        return held if not value else (held is (int(value) > 0)) if value in ("0", "1") else None
    m = re.fullmatch(r"(min-|max-)?(device-)?(width|height|aspect-ratio)", name)
    if not m:
        return None
    key = "device_" if m[2] else ""
    if m[3] == "aspect-ratio":
        r = re.fullmatch(r"([0-9]+)\s*/\s*([0-9]+)", value)
        if not r or not int(r[2]):
            return None
        have, want = env[key + "width"] * int(r[2]), env[key + "height"] * int(r[1])
    else:
        have, want = env[key + m[3]], _px(value)
        if want is None:
            return None
    return have >= want if m[1] == "min-" else have <= want if m[1] == "max-" else have == want


def _one_query(query: str, env: dict | None) -> bool | None:
    words = tokens(query.lower().replace("(", " (") if not query.startswith("(") else query.lower())
    negate = words[:1] == ["not"]
    if words[:1] in (["not"], ["only"]):
        words = words[1:]
    if not words:
        return None
    held, wants_and = True, False
    for i, w in enumerate(words):
        if wants_and != (w == "and"):
            return None
        if w == "and":
            wants_and = False
            continue
        if w.startswith("("):
            found = _feature(w[1:-1], env) if env else None
            if found is None:
                return None
            held &= found
        elif i == 0 and re.fullmatch(r"[\w\-]+", w):
            held = w in MEDIA_TYPES
        else:
            return None
        wants_and = True
    return None if not wants_and else held != negate


def media_ok(query: str, env: dict | None = None) -> bool:
    """A comma list of media conditions, of which one must hold; one that cannot be told does not, ``not`` or no."""
    return not query.strip() or any(_one_query(q.strip(), env) is True for q in split_top(query, ","))


def rules(css: str) -> list[dict]:
    """Selectors with declarations, in the order of the sheet: those under media conditions that hold, none under others."""
    out = []
    for prelude, body, parents, _ in rule_spans(css):
        chosen = selector_of(prelude)
        if chosen.startswith("@") or not all(re.match("@media", p, re.I) and media_ok(p[6:]) for p in parents):
            continue
        decls = [{"prop": n, "value": v, "important": i} for n, v, i in expanded(body)]
        for s in (x.strip() for x in split_top(chosen, ",")):
            if s:
                ids, classes, elements = specificity(s)
                out.append({"pos": len(out), "selector": s, "bucket": bucket(s), "spec": ids * 1_000_000 + classes * 1000 + elements, "simple": simple(s), "decls": decls})
    return out


def font_faces(css: str) -> list[dict]:
    """Family, weight and files of each @font-face."""
    out = []
    for prelude, body, _, _ in rule_spans(css):
        if selector_of(prelude).lower() == "@font-face":
            d = {n: v for n, v, _ in declarations(body)}
            weight = d.get("font-weight", "").lower()
            out.append({"family": d.get("font-family", "").strip("\"'"), "bold": weight in ("bold", "bolder") or (weight.isdigit() and int(weight) >= 600), "files": [u[0] for u in urls(d.get("src", ""))], "local": "local(" in d.get("src", "").lower()})
    return out


def drop_dead_faces(css: str, alive: list[str]) -> str:
    """@font-face rules of which no file lives and none is local go."""
    known, out, at = set(alive), [], 0
    for m in re.finditer(r"@font-face\s*\{[^{}]*\}", css, re.I):
        face = font_faces(m.group())
        if face and not face[0]["local"] and not any(f in known and not f.startswith("res:") for f in face[0]["files"]):
            out.append(css[at : m.start()])
            at = m.end()
    return "".join([*out, css[at:]])


def filter_declarations(css: str, unwanted: list[str]) -> str:
    """Declarations of the unwanted properties go; the others stay as they are."""
    gone = {p.lower() for p in unwanted}
    return ";".join(x for x in split_top(css, ";") if x.partition(":")[0].strip().lower() not in gone)


def is_relative_size(value: str) -> bool:
    return re.fullmatch(r"\s*(?:smaller|larger|[0-9]*\.?[0-9]+(?:em|rem|%))\s*", value, re.I) is not None


rules_of = rowwise(
    rules,
    "array<struct<pos:int,selector:string,bucket:string,spec:long,simple:struct<tag:string,ids:array<string>,classes:array<string>>,decls:array<struct<prop:string,value:string,important:boolean>>>>",
)
declarations_of = rowwise(declarations, "array<struct<prop:string,value:string,important:boolean>>")
expanded_of = rowwise(expanded, "array<struct<prop:string,value:string,important:boolean>>")
urls_of = rowwise(urls, "array<struct<value:string,quote:string,start:int,end:int>>")
specificity_of = rowwise(specificity, "struct<ids:int,classes:int,elements:int>")
media_ok_of = rowwise(media_ok, "boolean")
font_faces_of = rowwise(font_faces, "array<struct<family:string,bold:boolean,files:array<string>,local:boolean>>")
faces_dropped = rowwise(drop_dead_faces, "string")
filtered = rowwise(filter_declarations, "string")
comments_stripped = rowwise(strip_comments, "string")
relative_size_of = rowwise(is_relative_size, "boolean")
