"""The engine's own queries: one plan each, written for Spark and, through the dialect, for the oracle.

Plans are declarative SQL without hints: Catalyst prunes columns, pushes filters to the scan and picks joins by measured
sizes. Windows are keyed (by page, document, user, ...), never global, so no query funnels its table into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.containment import bench_contains
from quire.operators.matching import match_key, similar_classes
from quire.plans.dialect import Duck, Spark

#: Elements whose presence alone makes a page visible. Fixed values.
VISIBLE = "img|svg|image|hr|table|video|audio|math|object"
SKIPPED = "script|style|title"
_HREF = r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'
_EXTERNAL = r"^(//|[A-Za-z][A-Za-z0-9+.\-]*:)"
NOT_ALNUM = r"[^A-Za-z0-9\x{C0}-\x{24F}]+"
_BLANKS = r"[\s\x{A0}\x{3000}]+"


def plain(d, html: str) -> str:
    """Text of markup: skipped bodies, comments and tags go without a blank; basic entities decoded; white space folded."""
    x = d.replace(html, rf"(?is)<({SKIPPED})\b[^>]*>.*?</({SKIPPED})\s*>", "")
    x = d.replace(x, r"(?s)<!--.*?-->", "")
    x = d.replace(x, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim({d.replace(x, _BLANKS, ' ')})"


def _links(d) -> str:
    return d.numbered(d.t("pages"), "page_id, url", d.extract_all("html", _HREF, 1))


def _url_path(d, url: str) -> str:
    return d.extract(url, r"^[a-z]+://[^/]+(/[^?#]*)", 1)


def _page_quality(d) -> str:
    return f"""
with links as (select page_id, item from {_links(d)} x where not {d.matches('item', _EXTERNAL)} and item <> ''),
targets as (select distinct {_url_path(d, 'url')} as path from {d.t('pages')}),
hits as (
  select l.page_id, count(*) as n_links, count(t.path) as n_hits
  from links l left join targets t on t.path = {d.extract('l.item', '^[^?#]*', 0)} group by l.page_id
)
select p.page_id, length({plain(d, 'p.html')}) as n_chars, coalesce(n_links, 0) as n_links, coalesce(n_hits, 0) as n_hits,
  coalesce(5 * n_hits >= 4 * n_links, true) as links_ok
from {d.t('pages')} p left join hits h on h.page_id = p.page_id"""


def _script(d) -> str:
    han = d.count_in("text", r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]")
    kana = d.count_in("text", r"[\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{31F0}-\x{31FF}]")
    hangul = d.count_in("text", r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]")
    latin = d.count_in("text", r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]")
    return f"""
select doc_id, han, kana, hangul, latin,
  case when han + kana + hangul + latin < 200 then null
    when han + kana + hangul >= latin then case when hangul > han + kana then 'ko' when 10 * kana >= han + kana then 'ja' else 'zh' end
    when latin >= 10 * (han + kana + hangul) then 'en' end as script_lang
from (select doc_id, {han} as han, {kana} as kana, {hangul} as hangul, {latin} as latin from {d.t('documents')}) x"""


def _snapshots(d) -> str:
    """Two snapshots of the orders: rows leave, appear, grow or are touched between them."""
    return f"""
before as (select o_orderkey as id, floor(o_totalprice) as size, o_orderdate as mtime, o_orderkey % 13 = 0 as failed from {d.t('orders')} where o_orderkey % 11 <> 0),
after as (select o_orderkey as id, floor(o_totalprice) + case when o_orderkey % 7 = 0 then 1 else 0 end as size, o_orderdate as mtime from {d.t('orders')} where o_orderkey % 17 <> 0),
diff as (
  select coalesce(a.id, b.id) as id,
    case when b.id is null then 'new' when a.id is null then 'missing' when b.failed then 'retry'
      when a.size = b.size and a.mtime = b.mtime then 'unchanged' else 'updated' end as change
  from before b full outer join after a on a.id = b.id
)"""


#: Verdicts in file order; the first that matches and has a verdict wins. Fixed values of the example.
RULES = "(1, 'R', 'A', 'warn'), (2, 'R', '', 'error'), (3, '', 'N', null), (4, '', 'N', 'ok'), (5, 'A', '', 'ok')"
#: Tracked roots: path prefix, whether it names a single file, device. Fixed values of the example.
TRACKED = "('', false, 'all'), ('src1', false, 'kindle'), ('src1/en', false, 'reader'), ('src2', false, 'reader'), ('src2/de', false, 'kindle')"


def _roots(d) -> str:
    # Every path's ancestors join the tracked prefixes by equality; deepest wins.
    path = "concat_ws('/', source, lang)"
    return f"""
with docs as (select doc_id, source, {path} as p from {d.t('documents')}),
ups as (select doc_id, '' as root, 0 as depth from docs union all select doc_id, source, 1 from docs union all select doc_id, p, 2 from docs),
tracked as (select * from (values {TRACKED}) as t(root, is_file, device))
select u.doc_id, {d.arg_max('t.device', 't.is_file', 'u.depth')} as device, max(u.depth) as depth
from ups u join tracked t on t.root = u.root group by u.doc_id"""


PLANS = {
    "page_plain_text": lambda d: f"select page_id, {plain(d, 'html')} as plain_text from {d.t('pages')}",
    "page_visible": lambda d: f"""
select page_id, {plain(d, 'html')} <> '' or {d.matches('html', rf'(?i)<({VISIBLE})[\s/>]')} as visible from {d.t('pages')}""",
    "page_image_stats": lambda d: f"""
select page_id, images, chars, images > 0 and chars < 40 * images as comic_like
from (select page_id, {d.count_in('html', r'(?i)<(img|image)[\s/>]')} as images, cast(length({plain(d, 'html')}) as bigint) as chars from {d.t('pages')}) x""",
    "page_links": lambda d: f"""
select page_id, ord, {d.extract('item', '^[^#]*', 0)} as path, {d.extract('item', '#(.*)$', 1)} as frag, {d.matches('item', _EXTERNAL)} as external
from {_links(d)} x""",
    "page_link_hosts": lambda d: f"""
select host, count(*) as pages, count(distinct path) as paths
from (select {d.extract('url', '^[a-z]+://([^/?#]+)', 1)} as host, {_url_path(d, 'url')} as path from {d.t('pages')}) x group by host""",
    "page_path_norm": lambda d: f"""
select page_id, {d.fold_path(d.split("concat(" + _url_path(d, 'url') + ", '/./a//../b/')", '/'))} as path from {d.t('pages')}""",
    "page_dead_links": lambda d: f"""
with targets as (select distinct {_url_path(d, 'url')} as path from {d.t('pages')}),
links as (select page_id, ord, {d.extract('item', '^[^?#]*', 0)} as path from {_links(d)} x where not {d.matches('item', _EXTERNAL)} and item <> '')
select page_id, ord, path from links l where not exists (select 1 from targets t where t.path = l.path)""",
    "page_quality": _page_quality,
    "page_dup_id_tags": lambda d: f"select page_id, {d.count_in('html', r'(?is)<[a-z][^>]*\sid\s*=[^>]*\sid\s*=[^>]*>')} as dup_id_tags from {d.t('pages')}",
    "page_toc_like": lambda d: f"""
select page_id, link_chars, all_chars, all_chars >= 1 and 2 * link_chars > all_chars as toc_like from (
  select p.page_id, coalesce(l.chars, 0) as link_chars, cast(length({plain(d, 'p.html')}) as bigint) as all_chars
  from {d.t('pages')} p left join (
    select page_id, cast(sum(length({plain(d, 'item')})) as bigint) as chars
    from {d.numbered(d.t('pages'), 'page_id', d.extract_all('html', r'(?is)<a\s[^>]*>(.*?)</a>', 1))} y group by page_id
  ) l on l.page_id = p.page_id) x""",
    "page_headings": lambda d: f"""
select page_id, ord, level, title, dense_rank() over (partition by page_id order by level) as depth from (
  select page_id, ord, cast({d.extract('item', '(?i)^<h([1-6])', 1)} as int) as level, {plain(d, 'item')} as title
  from {d.numbered(d.t('pages'), 'page_id', d.extract_all('html', r'(?is)<h[1-6][\s>].*?</h[1-6]>'))} y) x""",
    "page_css_decls": lambda d: f"""
select page_id, ord, lower(trim({d.extract('item', '^([^:]*):', 1)})) as prop, trim({d.extract('item', ':(.*)$', 1)}) as value
from {d.numbered(d.t('pages'), 'page_id', d.extract_all('html', r'[{;]\s*([a-z\-]+\s*:[^;{}<>]+)', 1))} x""",
    "doc_script": _script,
    "doc_lang_fit": lambda d: f"""
select doc_id, lang, {d.matches('lang', '^[a-z]{2,3}$')} and lang not in ('und', 'mul', 'zxx', 'mis') and lang not in ('zh', 'ja', 'ko') as fits
from ({_script(d)}) s join {d.t('documents')} using (doc_id) where script_lang = 'en'""",
    "doc_norm_key": lambda d: f"select doc_id, lower({d.replace('trim(text)', NOT_ALNUM, '')}) as norm_key from {d.t('documents')}",
    "doc_content_id": lambda d: f"""
select content_id, min(doc_id) as first_doc, count(*) as copies from (select substr({d.sha256('text')}, 1, 12) as content_id, doc_id from {d.t('documents')}) x group by content_id""",
    "doc_exact_dups": lambda d: f"""
select {d.sha256('text')} as sha, count(*) as copies, min(doc_id) as kept, max(doc_id) as last from {d.t('documents')} group by 1 having count(*) > 1""",
    "doc_blank_fold": lambda d: f"""
select doc_id, count(*) as islands, max(n) as longest from (
  select doc_id, grp, count(*) as n from (
    select doc_id, ord, item, ord - row_number() over (partition by doc_id, trim(item) = '' order by ord) as grp
    from {d.numbered(d.t('documents'), 'doc_id', d.split('text', chr(92) + 'n'))} x) y
  where trim(item) <> '' group by doc_id, grp) z group by doc_id""",
    "doc_tail_trim": lambda d: f"select doc_id, length(text) - length({d.replace('text', _BLANKS + '$', '')}) as trimmed from {d.t('documents')}",
    "doc_halfwidth": lambda d: f"""
select doc_id, {d.sha256("translate(translate(text, 'aeiou', 'ａｅｉｏｕ'), 'ａｅｉ', 'aei')")} as half_sha from {d.t('documents')}""",
    "doc_filename": lambda d: f"""
select doc_id, {d.replace(d.replace('substr(text, 1, 80)', r'[\x00-\x1F/\\:*?"<>|]', '_'), r'^\.', '_')} as file_name from {d.t('documents')}""",
    "doc_xml_escape": lambda d: f"""
select doc_id, {d.sha256("replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')")} as escaped_sha from {d.t('documents')}""",
    "part_base_title": lambda d: f"""
select base, count(*) as parts, min(p_partkey) as first_part from (select {d.extract('p_name', '^([^ ]+)', 1)} as base, p_partkey from {d.t('part')}) x group by base""",
    "weighted_mode_discount": lambda d: f"""
select l_returnflag, l_linestatus, {d.arg_max('k', 'w', '-k')} as mode_key, max(w) as weight from (
  select l_returnflag, l_linestatus, cast(round(1000 * l_discount) as bigint) as k, cast(sum(l_quantity) as bigint) as w
  from {d.t('lineitem')} group by 1, 2, 3) x group by l_returnflag, l_linestatus""",
    "weighted_mode_guarded": lambda d: f"""
select l_suppkey, case when mode_key between 20 and 80 then mode_key else 50 end as trusted from (
  select l_suppkey, {d.arg_max('k', 'w', '-k')} as mode_key from (
    select l_suppkey, cast(round(1000 * l_discount) as bigint) as k, cast(sum(l_quantity) as bigint) as w from {d.t('lineitem')} group by 1, 2) x
  group by l_suppkey) y""",
    "text_counts_gs": lambda d: f"""
select l_returnflag, l_linestatus, l_linenumber, count(*) as n from {d.t('lineitem')}
group by grouping sets ((l_returnflag), (l_linestatus), (l_linenumber))""",
    "slot_vote": lambda d: f"""
with votes as (select o_orderpriority as page_set, o_custkey % 50 as slot, count(*) as n from {d.t('orders')} group by 1, 2),
pages as (select o_orderpriority as page_set, count(*) as pages from {d.t('orders')} group by 1)
select v.page_set, slot, n from votes v join pages p on p.page_set = v.page_set where n >= greatest(5, ceil(0.02 * pages))""",
    "id_runs": lambda d: f"""
select user_id, min(event_id) as start_id, count(*) as n from (
  select user_id, event_id, event_id - row_number() over (partition by user_id order by event_id) as grp
  from (select distinct user_id, event_id from {d.t('events')}) x) y group by user_id, grp""",
    "pid_delta": lambda d: f"""
select user_id, event_id, event_id - lag(event_id) over (partition by user_id order by event_id) as step from {d.t('events')}""",
    "position_map": lambda d: f"""
select conv_id, turn, cast(coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as start_pos from {d.t('conversations')}""",
    "chunk_toc": lambda d: f"""
select l_suppkey, ord, l_orderkey, l_linenumber from (
  select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) - 1 as ord from {d.t('lineitem')}) x where ord % 20 = 0""",
    "part_nest": lambda d: f"""
select conv_id, turn, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as bigint) as part from {d.t('conversations')}""",
    "column_percent": lambda d: f"""
select l_orderkey, l_linenumber, round(100 * l_quantity / sum(l_quantity) over (partition by l_orderkey), 4) as pct from {d.t('lineitem')}""",
    "margin_collapse": lambda d: f"""
select o_orderkey, case when a >= 0 and b >= 0 then greatest(a, b) when a < 0 and b < 0 then least(a, b) else a + b end as margin
from (select o_orderkey, o_custkey % 41 - 20 as a, o_orderkey % 37 - 18 as b from {d.t('orders')}) x""",
    "rule_first_match": lambda d: f"""
with rules as (select * from (values {RULES}) as r(ord, flag, status, verdict)),
kinds as (select l_returnflag, l_linestatus, count(*) as n from {d.t('lineitem')} group by 1, 2)
select l_returnflag, l_linestatus, n, verdict from (
  select k.*, verdict, row_number() over (partition by l_returnflag, l_linestatus order by ord nulls last) as rn from kinds k
  left join rules r on r.verdict is not null and (r.flag = '' or r.flag = l_returnflag) and (r.status = '' or r.status = case when l_linestatus = 'F' then 'A' else 'N' end)) x
where rn = 1""",
    "mutual_pairs": lambda d: f"""
with edges as (select distinct user_id as a, (event_id * 7 + user_id) % 211 as b from {d.t('events')})
select x.a, x.b from edges x join edges y on y.a = x.b and y.b = x.a where x.a < x.b""",
    "dup_rename": lambda d: f"""
select conv_id, turn, case when n = 1 then role else concat(role, '-x', {d.text('n')}) end as name
from (select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as n from {d.t('conversations')}) x""",
    "name_collision": lambda d: f"""
select p_partkey, case when n = 1 then concat(p_name, '.epub') else concat(p_name, ' [', {d.text('p_partkey')}, '].epub') end as file_name
from (select p_partkey, p_name, row_number() over (partition by lower(p_name) order by p_partkey) as n from {d.t('part')}) x""",
    "placement_pick": _roots,
    "device_scope": lambda d: f"""
with scopes as (select * from (values ('BUILDING', 'kindle'), ('BUILDING', 'reader'), ('MACHINERY', 'reader')) as t(segment, device)),
loose as (select c_custkey, c_mktsegment as segment from {d.t('customer')} where c_mktsegment not in ('BUILDING', 'MACHINERY'))
select c_custkey, device from {d.t('customer')} join scopes on segment = c_mktsegment
union all select c_custkey, 'kindle' from loose union all select c_custkey, 'reader' from loose union all select c_custkey, 'tablet' from loose""",
    "snapshot_diff": lambda d: f"with {_snapshots(d)} select id, change from diff",
    "action_plan": lambda d: f"""
with {_snapshots(d)}
select change, action, count(*) as n from (
  select change, case change when 'new' then 'build' when 'updated' then 'build' when 'retry' then 'build' when 'missing' then 'prune' else 'keep' end as action from diff) x
group by change, action""",
    "fingerprint": lambda d: f"select p_partkey, {d.sha256(' || '.join(f"coalesce({d.text(f'length({d.text(c)})')} || ':' || {d.text(c)}, '-') || '|'" for c in ('p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size')))} as fingerprint from {d.t('part')}",
    "space_check": lambda d: f"""
select l_suppkey, cast(greatest(0, new_size - old_size) + greatest(floor(new_size / 50), 1000) as bigint) as need from (
  select l_suppkey, cast(sum(case when l_linestatus = 'O' then l_quantity else 0 end) as bigint) as new_size, cast(sum(case when l_linestatus = 'F' then l_quantity else 0 end) as bigint) as old_size
  from {d.t('lineitem')} group by l_suppkey) x""",
    "fetch_priority": lambda d: f"""
select c.c_custkey, coalesce(u.status, f.status, 'none') as status from {d.t('customer')} c
left join (select o_custkey, min(o_orderstatus) as status from {d.t('orders')} where o_orderpriority like '1%' group by 1) u on u.o_custkey = c.c_custkey
left join (select o_custkey, min(o_orderstatus) as status from {d.t('orders')} group by 1) f on f.o_custkey = c.c_custkey""",
    "retry_due": lambda d: f"""
select event_id, user_id, coalesce({d.seconds('ts')} - {d.seconds('lag(ts) over (partition by user_id order by ts, event_id)')} >= 3600, true) as due from {d.t('events')}""",
    "label_gate": lambda d: f"""
select d.lang, l.quality, count(*) as docs, cast(sum(d.n_chars) as bigint) as chars from {d.t('documents')} d join {d.t('labels')} l on l.doc_id = d.doc_id group by d.lang, l.quality""",
    "doc_sentences": lambda d: f"""
select doc_id, {d.count_in('text', r'[.!?…]+(\s|$)')} as sentences from {d.t('documents')}""",
}


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(PLANS[name](Spark(sf_dir)))

    run.__name__ = name
    return run


def catalog_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that begin with 12, a source, or a word anywhere in the text, whatever its case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where("cast(doc_id as string) like '12%' or source = 'src3' or contains(lower(text), 'the')").select("doc_id", "source")


def part_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names are alike: every class of equal keys with the classes it is linked with, as counts of links and members."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", match_key(F.col("p_name")).alias("key"))
    pairs, members = similar_classes(parts, "key", "p_partkey")
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("other"), "similarity"))
    links = both.groupBy("key").agg(F.count("*").alias("links"), F.max("similarity").alias("nearest"))
    classes = members.groupBy("key").agg(F.min("member").alias("class_id"), F.count("*").alias("members"))
    of_class = classes.join(links, "key", "left").select("key", "class_id", "members", F.coalesce("links", F.lit(0)).alias("links"), "nearest")
    return members.join(of_class, "key").select(F.col("member").alias("p_partkey"), "class_id", "members", "links", "nearest")


QUERIES = {name: _query(name) for name in PLANS} | {f.__name__: f for f in (bench_contains, catalog_select, part_fuzzy)}
#: SQL of their own for the queries that are no plan.
ORACLE_SQL = {name: plan(Duck()) for name, plan in PLANS.items()} | {
    "bench_contains": """
select doc_id, count(distinct b.item) as passages from documents d
join (select distinct trim(text) as item from benchmark where trim(text) <> '') b on contains(d.text, b.item) group by doc_id""",
    "catalog_select": "select doc_id, source from documents where doc_id::varchar like '12%' or source = 'src3' or contains(lower(text), 'the')",
    "part_fuzzy": """
with t as (select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as k from part),
c as (select k, min(p_partkey) as class_id, count(*) as members from t group by k),
l as (select k, c, count(*) as n from (select k, unnest(string_split(k, '')) as c from c) group by all),
m as (select a.k as a, b.k as b, sum(least(a.n, b.n)) as shared from l a join l b on a.c = b.c and a.k <> b.k group by all),
p as (select a, b, round(shared / greatest(len(a), len(b)), 6) as similarity from m
  where 100 * shared >= 80 * greatest(len(a), len(b)) or ((starts_with(b, a) or starts_with(a, b)) and abs(len(b) - len(a)) <= 2)),
n as (select a as k, count(*) as links, max(similarity) as nearest from p group by a)
select p_partkey, class_id, members, coalesce(links, 0) as links, nearest from t join c using (k) left join n using (k)""",
}
