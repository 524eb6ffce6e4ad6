"""Queries of the layout and style side: cascade, contrast, boxes, page breaks, ordered passes, tags and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators.passes import Pass, run_passes
from quire.plans.dialect import Duck, Spark, quoted

#: Style rules of the example: bucket key (tag, .class or *), property, value, important, specificity, order. Fixed values.
STYLE_RULES = (
    "('*', 'margin', '0', false, 0, 1), ('p', 'margin', '1em', false, 1, 2), ('p', 'color', 'black', true, 1, 3), ('a', 'color', 'blue', false, 1, 4), "
    "('div', 'display', 'block', false, 1, 5), ('.ad', 'display', 'none', false, 1000, 6), ('.ad', 'margin', '2em', false, 1000, 7), ('h1', 'margin', '0', true, 1, 8)"
)
#: An inline style counts as specificity (1000, 0, 0); a sheet's ``!important`` still beats it.
INLINE_SPECIFICITY = 1_000_000_000
LEAST_CONTRAST = 4.5
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in ALPHABET)


def _cascade(d) -> str:
    # Elements and rules meet on the bucket key, so no element is tested against a rule of another tag or class.
    tags = d.numbered(d.t("pages"), "page_id", d.extract_all("html", r"<[a-zA-Z][^>]*>"))
    return f"""
with rules as (select * from (values {STYLE_RULES}) as t(bucket, prop, value, important, spec, pos)),
elements as (
  select page_id, ord as element, lower({d.extract('item', '^<([a-zA-Z0-9]+)', 1)}) as tag, {d.extract('item', r'(?i)\sclass\s*=\s*"([^"]*)"', 1)} as classes,
    {d.extract('item', r'(?i)\sstyle\s*=\s*"([^"]*)"', 1)} as style from {tags} x),
classes as {d.numbered('elements', 'page_id, element', d.split('classes', r'\s+'))},
buckets as (
  select page_id, element, tag as bucket from elements union select page_id, element, '*' from elements
  union select page_id, element, concat('.', item) from classes where item <> ''),
inline_style as {d.numbered("(select * from elements where style <> '') s", 'page_id, element', d.split('style', ';'))},
found as (
  select page_id, element, prop, value, important, spec, pos from buckets b join rules r on r.bucket = b.bucket
  union all
  select page_id, element, trim({d.extract('item', '^([^:]*):', 1)}), trim({d.extract('item', ':(.*)$', 1)}), false, {INLINE_SPECIFICITY}, ord from inline_style where item like '%:%')
select page_id, element, prop, {d.arg_max('value', 'important', 'spec', 'pos')} as value from found group by page_id, element, prop"""


def luminance(r: str, g: str, b: str) -> str:
    """Relative luminance of three 0..255 components."""

    def linear(c: str) -> str:
        return f"(case when {c} <= 0.04045e0 * 255 then {c} / 255.0e0 / 12.92e0 else power(({c} / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) end)"

    return f"(0.2126e0 * {linear(r)} + 0.7152e0 * {linear(g)} + 0.0722e0 * {linear(b)})"


def contrast_of(d, colours: str) -> str:
    """For ``colours(id, r, g, b, grey)`` on a grey ground: the ratio, and the nearest colour of enough contrast.

    The colour moves by thousandths to black (first, unless it is lighter than the ground) or white; none found: unchanged.
    """
    # Every colour gets its own 2 x 1001 tries, so no join makes them.
    tries = d.numbered("poor", "id, r, g, b, lum, ground", "sequence(0, 2001)" if type(d) is Spark else "range(0, 2002)")
    shade = lambda c: f"floor(case dir when 'dark' then {c} * (1 - k / 1000.0e0) else {c} + (255 - {c}) * (k / 1000.0e0) end + 0.5e0) as {c}2"
    ratio = lambda x: f"(greatest({x}, ground) + 0.05e0) / (least({x}, ground) + 0.05e0)"
    return f"""
with lit as (select id, r, g, b, {luminance('r', 'g', 'b')} as lum, {luminance('grey', 'grey', 'grey')} as ground from ({colours}) c),
poor as (select * from lit where {ratio('lum')} < {LEAST_CONTRAST}),
tried as (
  select id, ground, turn, {shade('r')}, {shade('g')}, {shade('b')} from (
    select *, ord as turn, ord % 1001 as k, case when (ord < 1001) = (lum <= ground) then 'dark' else 'light' end as dir from {tries} t) w),
enough as (select *, row_number() over (partition by id order by turn) as n from (
  select *, {luminance('r2', 'g2', 'b2')} as lum2 from tried) t where {ratio('lum2')} >= {LEAST_CONTRAST})
select l.id, round({ratio('lum')}, 6) as ratio, cast(coalesce(r2, r) as int) as r, cast(coalesce(g2, g) as int) as g, cast(coalesce(b2, b) as int) as b
from lit l left join (select id, r2, g2, b2 from enough where n = 1) e on e.id = l.id"""


def _contrast(d) -> str:
    colours = f"select distinct p_size as id, (p_size * 53) % 256 as r, (p_size * 101) % 256 as g, (p_size * 29) % 256 as b, (p_size % 3) * 127 as grey from {d.t('part')}"
    return contrast_of(d, colours)


def _fit_box(d, width: int = 1072, height: int = 1448) -> str:
    half_up = lambda a, b: f"floor((2 * ({a}) + ({b})) / (2.0e0 * ({b})))"
    return f"""
select p_partkey, cast(w as bigint) as w, cast(h as bigint) as h,
  cast(case when kept then w when big then 3 * w when wide then {width} else {half_up(f'w * {height}', 'h')} end as bigint) as fit_w,
  cast(case when kept then h when big then 3 * h when wide then {half_up(f'h * {width}', 'w')} else {height} end as bigint) as fit_h
from (select *, w * {height} >= h * {width} as wide, w <= {width} and h <= {height} and not up as kept, 3 * w <= {width} and 3 * h <= {height} as big
  from (select p_partkey, 100 + p_partkey % 1900 as w, 100 + p_size * 37 as h, p_size % 2 = 0 as up from {d.t('part')}) x) y"""


def _autocontrast(d, gamma: float = 1.8) -> str:
    return f"""
select v.brand, v.value, cast(case when hi - lo >= 159 and not (lo = 0 and hi = 255) then floor((v.value - lo) * 255.0e0 / (hi - lo) + 0.5e0) else v.value end as int) as stretched,
  cast(floor(255 * power(v.value / 255.0e0, {gamma}e0) + 0.5e0) as int) as gamma
from (select distinct p_brand as brand, p_size * 5 as value from {d.t('part')}) v
join (select p_brand as brand, min(p_size) * 5 as lo, max(p_size) * 5 as hi from {d.t('part')} group by p_brand) r on r.brand = v.brand"""


def _page_breaks(d, room: int = 400) -> str:
    """Pages of a conversation: a turn that would overflow the page starts the next one. Only lengths are gathered."""
    if type(d) is Spark:
        step = f"(a, x) -> if(a.used > 0 and a.used + x.n > {room}, named_struct('page', a.page + 1L, 'used', x.n), named_struct('page', a.page, 'used', a.used + x.n))"
        return f"""
select conv_id, size(turns) as turns, f.page as last_page, f.used as used_on_last from (
  select conv_id, turns, aggregate(turns, named_struct('page', 1L, 'used', 0L), {step}) as f from (
    select conv_id, array_sort(collect_list(named_struct('turn', turn, 'n', cast(coalesce(length(text), 0) as bigint)))) as turns
    from {d.t('conversations')} group by conv_id) x) y"""
    return f"""
with recursive numbered as (
  select conv_id, row_number() over (partition by conv_id order by turn) as i, coalesce(length(text), 0) as n from conversations),
walk(conv_id, i, page, used) as (
  select conv_id, i, 1, n from numbered where i = 1
  union all
  select w.conv_id, t.i, case when w.used > 0 and w.used + t.n > {room} then w.page + 1 else w.page end, case when w.used > 0 and w.used + t.n > {room} then t.n else w.used + t.n end
  from walk w join numbered t on t.conv_id = w.conv_id and t.i = w.i + 1)
select conv_id, i::int as turns, page::bigint as last_page, used::bigint as used_on_last from walk qualify row_number() over (partition by conv_id order by i desc) = 1"""


def _tags(d) -> str:
    words = d.numbered(d.t("part"), "p_partkey, p_brand", d.split("concat(p_name, ' ', p_type, ' ', p_brand, ' 1999')", " "))
    return f"""
select p_partkey, ord, tag from (
  select p_partkey, ord, item as tag, row_number() over (partition by p_partkey order by ord) as n from {words} x
  where not {d.matches('item', '^[12][0-9]{3}$')} and lower(item) <> lower(p_brand) and item <> '') y where n <= 8"""


PLANS = {
    "cascade_winner": _cascade,
    "contrast_grid": _contrast,
    "fit_box": _fit_box,
    "autocontrast": _autocontrast,
    "page_break_acc": _page_breaks,
    "tag_filter": _tags,
    "json_hits": lambda d: f"""
select k, event_type, count(*) as hits, round(sum(value), 2) as total from (select {d.json('props', 'k')} as k, event_type, cast(value as decimal(18, 2)) as value from {d.t('events')}) x
where k is not null group by k, event_type""",
    "doc_fullwidth": lambda d: f"select doc_id, {d.sha256(f'translate(lower(text), {quoted(ALPHABET)}, {quoted(WIDE)})')} as wide from {d.t('documents')}",
}


def _on_text(change):
    """A pass over the column ``text``; ``change(d, x)`` writes the expression."""
    return lambda df: df.selectExpr("doc_id", f"{change(Spark(''), 'text')} as text")


#: name, passes that must have run before, the text's change.
_TEXT_PASSES = [
    ("controls", (), lambda d, x: d.replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")),
    ("blanks", ("controls",), lambda d, x: d.replace(x, r"[ \t]+", " ")),
    ("blank_lines", ("blanks",), lambda d, x: d.replace(x, r"(?:\n ?){3,}", "\n\n")),
    ("tail", ("blanks", "blank_lines"), lambda d, x: d.replace(x, r"[ \n]+$", "")),
]


def pass_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text passes in their order; Catalyst folds them into one projection."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    passes = [Pass(name, _on_text(change), after) for name, after, change in _TEXT_PASSES]
    return run_passes(docs, passes).selectExpr("doc_id", "cast(length(text) as bigint) as chars", "sha2(text, 256) as digest")


def _pass_oracle() -> str:
    d, x = Duck(), "text"
    for _, _, change in _TEXT_PASSES:
        x = change(d, x)
    return f"select doc_id, length({x}) as chars, sha256({x}) as digest from documents"


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(PLANS[name](Spark(sf_dir)))

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in PLANS} | {"pass_pipeline": pass_pipeline}
ORACLE_SQL = {name: plan(Duck()) for name, plan in PLANS.items()} | {"pass_pipeline": _pass_oracle()}
