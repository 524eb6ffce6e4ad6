"""Text rules: widths, file names, dates, hashes, sentences, scripts, numerals, names and titles."""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.rowwise import rowwise

WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
_HALF = str.maketrans(WIDE, NARROW)
#: Marks that end a sentence, and closers that belong to it. Fixed values.
TERMINAL = "。！？!?…．｡"
CLOSERS = "」』”’）》】〉〕\"')]"


def to_halfwidth(x: Column) -> Column:
    return F.translate(x, WIDE, NARROW)


def fullwidth(x: Column) -> Column:
    return F.translate(x, NARROW, WIDE)


def sanitize_filename(name: str) -> str:
    """Control and path characters become ``_``; at most 80 characters and 200 bytes; a leading dot becomes ``_``."""
    out = re.sub(r'[\x00-\x1f\x7f/\\:*?"<>|]', "_", name)[:80]
    while len(out.encode()) > 200:
        out = out[:-1]
    return "_" + out[1:] if out.startswith(".") else out


def utc_w3c(seconds: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DDThh:mm:ssZ, whatever the session's time zone."""
    days = F.floor(seconds / 86400)
    rest = seconds - days * 86400
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    return F.concat(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd"), clock)


def latin1_decode(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def latin1_encode(text: str) -> bytes:
    return text.encode("latin-1", "replace")


def fnv64(text: str) -> int:
    """FNV-1a of the UTF-8 bytes, as a signed number."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def sentences(text: str, split: bool = True) -> list[str]:
    """Sentences as written: leading blanks go; marks, closers and blanks behind an end belong to it; the last one's tail blanks go.

    An ASCII dot ends a sentence only before an end, a blank or a closer.
    """
    ends = []
    if split:
        end = rf"(?:[{re.escape(TERMINAL)}]|\.(?=$|\s|[{re.escape(CLOSERS)}]))[{re.escape(TERMINAL)}.]*[{re.escape(CLOSERS)}]*\s*"
        ends = [m.end() for m in re.finditer(end, text)]
    out, at = [], 0
    for b in [*ends, len(text)]:
        part = text[at:b].lstrip()
        if b == len(text):
            part = part.rstrip()
        if part:
            out.append(part)
        at = b
    return out


#: Code-point ranges of the scripts, for Java's regular expressions. Fixed values.
SCRIPTS = {
    "han": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]",
    "kana": r"[\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{31F0}-\x{31FF}]",
    "hangul": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]",
    "latin": r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]",
}


def script_counts(x: Column) -> Column:
    return F.struct(*[F.regexp_count(x, F.lit(r)).alias(n) for n, r in SCRIPTS.items()])


def script_of(n: Column, least: int) -> Column:
    """The language that counts of scripts speak for; null where they are few or mixed."""
    han, kana, hangul, latin = (n[k] for k in ("han", "kana", "hangul", "latin"))
    cjk = han + kana + hangul
    east = F.when(hangul > han + kana, "ko").when(10 * kana >= han + kana, "ja").otherwise("zh")
    return F.when(cjk + latin < least, None).when(cjk >= latin, east).when(latin >= 10 * cjk, "en")


def language_fits(lang: Column, script: Column) -> Column:
    """Whether a declared language can stand beside the script found: East Asian or not, never swapped inside a family."""
    shaped = lang.rlike("^[a-z]{2,3}$") & ~lang.isin("und", "mul", "zxx", "mis")
    return shaped & (lang.isin("zh", "ja", "ko") == script.isin("zh", "ja", "ko"))


_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")}


def section_number(text: str) -> int | None:
    """A label of at most three characters that is a number: digits of either width, or a Chinese numeral of 1 to 99."""
    if not 0 < len(text) <= 3:
        return None
    half = text.translate(_HALF)
    if re.fullmatch("[0-9]+", half):
        return int(half)
    m = re.fullmatch("([一二三四五六七八九]?)(十?)([一二三四五六七八九]?)", text)
    if not m or not any(m.groups()) or (not m[2] and (m[1] and m[3])):
        return None
    if not m[2]:
        return _DIGITS[m[1] or m[3]]
    return (_DIGITS[m[1]] if m[1] else 1) * 10 + (_DIGITS[m[3]] if m[3] else 0)


def partial_date(text: str) -> str | None:
    """Groups of digits as a date: year 1000 to 2999, month, day; what doesn't fit is left off."""
    n = re.findall(r"[0-9]+", text)
    if not n or not 1000 <= int(n[0]) <= 2999:
        return None
    if len(n) < 2 or not 1 <= int(n[1]) <= 12:
        return n[0]
    month = f"{n[0]}-{int(n[1]):02d}"
    return f"{month}-{int(n[2]):02d}" if len(n) > 2 and 1 <= int(n[2]) <= 31 else month


def issue_date(text: str) -> str | None:
    """A partial date filled up with first months and days."""
    d = partial_date(text)
    return d and (d + "-01-01")[:10]


def query_encode(text: str) -> str:
    return quote(text, safe="")


# Names and titles.

#: Role words at the end of a credit, longer ones first. Fixed values.
AUTHOR_ROLES = ("原著", "编著", "編著", "主编", "主編", "著", "撰", "编", "編", "绘", "繪", "作", "文", "图", "圖")
TRANSLATOR_ROLES = ("翻译", "翻譯", "译", "譯")
#: Words for editions and halves of a work, and for its form, as titles end in them. Fixed values.
EDITIONS = ("全彩版", "彩色版", "修订版", "修訂版", "珍藏版", "典藏版", "完全版", "新装版", "新裝版", "精装版", "精裝版", "纪念版", "紀念版", "愛藏版", "爱藏版")
HALVES = ("上册", "中册", "下册", "上冊", "中冊", "下冊")
FORMS = ("漫", "图像小说", "圖像小說", "绘本", "繪本", "连环画", "連環畫")
_OPEN, _CLOSE = "[［(（【〔", "]］)）】〕"


def norm(text: str) -> str:
    """The match key: half width, without a note in brackets at the end, letters and digits only, lower case."""
    t = text.translate(_HALF).strip()
    cut = max(t.rfind("("), t.rfind("（"))
    if cut > 0 and t.endswith((")", "）")):
        t = t[:cut]
    return "".join(c.lower() for c in t if c.isalnum())


def similarity(a: str, b: str) -> float:
    """Characters in common, as a multiset, by the longer one's length."""
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b)) if a and b else 0.0


def _nationality(text: str) -> tuple[str, str]:
    t = text.strip()
    if t[:1] and t[0] in _OPEN:
        at = next((i for i, c in enumerate(t) if c in _CLOSE), -1)
        if at > 0:
            return t[1:at].strip(), t[at + 1 :].strip()
    return "", t


def parse_credits(values: list[str]) -> dict:
    """Bylines: authors with nationality, and translators. A role word ends a segment; without one it names authors."""
    authors, translators = [], []
    for segment in (s.strip() for v in values for s in re.split("[，,；;/／]", v)):
        nation, rest = _nationality(segment)
        role = next((r for r in TRANSLATOR_ROLES if rest.endswith(r)), None)
        if role is None:
            own = next((r for r in AUTHOR_ROLES if rest.endswith(r) and rest.removesuffix(r).strip()), "")
            names, into = rest.removesuffix(own), None
        else:
            names, into = rest.removesuffix(role), translators
        for name in (n.strip() for n in re.split("[、&＆]", names)):
            if name:
                mine, name = _nationality(name)
                if into is None:
                    authors.append({"name": name, "nationality": mine or nation})
                else:
                    into.append(name)
    return {"authors": authors, "translators": translators}


def author_keys(values: list[str]) -> list[str]:
    return [k for k in (norm(a["name"]) for a in parse_credits(values)["authors"]) if k]


def norm_author(text: str) -> str:
    found = parse_credits([text])["authors"]
    return norm(found[0]["name"] if found else _nationality(text)[1])


def author_for_query(values: list[str]) -> str | None:
    return next((a["name"] for a in parse_credits(values)["authors"] if norm(a["name"])), None)


def same_person(a: list[str], b: list[str]) -> bool:
    return any(x and similarity(x, y) >= 0.6 for x in map(norm_author, a) for y in map(norm_author, b))


_VOLUME = re.compile(r"(第?)([0-9０-９一二三四五六七八九十百]+)([卷册冊集部巻話话]?)$")


def strip_volume(title: str) -> str:
    """One step: an edition, a half or a volume's number goes from the end."""
    for word in (*EDITIONS, *HALVES):
        if title.endswith(word) and title.removesuffix(word).strip():
            return title.removesuffix(word)
    m = _VOLUME.search(title)
    if title.endswith(("全集", "合集")) or not m:
        return title
    # Chinese numerals alone are no volume; neither are digits of which nothing is left.
    if not m[1] and not m[3] and not re.fullmatch("[0-9０-９]+", m[2]):
        return title
    rest = title[: m.start()].rstrip().rstrip(". #")
    rest = next((rest.removesuffix(p) for p in ("Vol", "vol", "VOL", "卷", "巻", "册", "冊", "第") if rest.endswith(p)), rest)
    return rest if rest.strip() else title


def base_title(title: str) -> str | None:
    """The title without volumes, editions, notes in brackets and a series in front; null if there was none."""
    t = title.strip()
    head, _, tail = t.replace("：", ":", 1).partition(":") if "：" in t and ("：" not in t[: t.find(":")] or ":" not in t) else t.partition(":")
    if "系列" in head and tail.strip():
        t = tail.strip()
    while True:
        before = t
        if t.endswith((")", "）", "]", "】")):
            cut = max(t.rfind(c) for c in "(（[【")
            t = t[:cut] if cut > 0 else t
        t = strip_volume(t.rstrip()).rstrip().rstrip("-_·：:").rstrip()
        if t == before or not t:
            break
    return t if t and t != title.strip() else None


def form_marker(title: str) -> str | None:
    """The bracketed form at a title's end, as written."""
    t = title.strip()
    cut = max(t.rfind("("), t.rfind("（"))
    return t[cut:] if cut >= 0 and t.endswith((")", "）")) and any(f in t[cut:] for f in FORMS) else None


def hit_matches(title: str, author: str, wanted: str, authors: list[str]) -> bool:
    """Whether a hit's title and byline fit a wanted key and author keys.

    The title is equal, or a prefix within two characters, or (authors known, four characters at least) alike to 0.8; one author is alike to 0.6.
    Without wanted authors only an equal title fits. The hit's title counts without its volume, too.
    """
    base = base_title(title)
    if base is not None and norm(base) == wanted and hit_matches(base, author, wanted, authors):
        return True
    key = norm(title)
    if not authors:
        return key == wanted
    near = (key.startswith(wanted) or wanted.startswith(key)) and abs(len(key) - len(wanted)) <= 2
    if not (key == wanted or near or (len(key) >= 4 and similarity(key, wanted) >= 0.8)):
        return False
    return any(similarity(w, norm_author(a)) >= 0.6 for a in re.split("[/、,，]", author) for w in authors)


def series_key(title: str, authors: list[str]) -> str:
    return f"{norm(base_title(title) or title)}|{'/'.join(sorted(author_keys(authors)))}"


def pick_by_title(wanted: str, titles: list[str]) -> int | None:
    """The first hit with an equal key; else the only one alike to 0.75."""
    keys = [norm(t) for t in titles]
    if wanted in keys:
        return keys.index(wanted)
    near = [i for i, k in enumerate(keys) if similarity(k, wanted) >= 0.75]
    return near[0] if len(near) == 1 else None


def author_score(wanted: list[str], found: list[str]) -> float:
    return max((similarity(a, b) for a in wanted for b in found), default=0.0)


def tags_without_authors(tags: list[str], authors: list[str], most: int = 8) -> list[str]:
    """Tags that are neither a year nor an author, the first eight."""
    names = {norm_author(a) for a in authors}
    return [t for t in tags if not re.fullmatch("[12][0-9]{3}", t.strip()) and norm(t) not in names][:most]


file_name = rowwise(sanitize_filename, "string")
latin1_encoded = rowwise(latin1_encode, "binary")
fnv64_of = rowwise(fnv64, "long")
sentences_of = rowwise(sentences, "array<string>")
section_number_of = rowwise(section_number, "int")
partial_date_of = rowwise(partial_date, "string")
issue_date_of = rowwise(issue_date, "string")
query_encoded = rowwise(query_encode, "string")
norm_of = rowwise(norm, "string")
similarity_of = rowwise(similarity, "double")
credits_of = rowwise(parse_credits, "struct<authors:array<struct<name:string,nationality:string>>,translators:array<string>>")
author_keys_of = rowwise(author_keys, "array<string>")
author_for_query_of = rowwise(author_for_query, "string")
base_title_of = rowwise(base_title, "string")
form_marker_of = rowwise(form_marker, "string")
hit_matches_of = rowwise(hit_matches, "boolean")
series_key_of = rowwise(series_key, "string")
pick_by_title_of = rowwise(pick_by_title, "int")
author_score_of = rowwise(author_score, "double")
tags_of_book = rowwise(tags_without_authors, "array<string>")
