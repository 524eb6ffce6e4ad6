"""Queries of books, markup, sheets and the library on the driver's tables. A host stands for a book, its pages for members.

The SQL beside each query is written on its own, for DuckDB; it is not the query's plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import css as C
from quire.functions import markup as M
from quire.functions import paths as P
from quire.functions import text as X
from quire.functions import values as V
from quire.functions.rowwise import rowwise
from quire.operators import contents, library, links, matching
from quire.sources import books, ion

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir) -> DataFrame:
    """(book, ord, name, html): hosts as books, paths as members."""
    p = _table(spark, sf_dir, "pages")
    book, name = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    return p.select(book.alias("book"), F.col("page_id").cast("int").alias("ord"), name.alias("name"), "html", "page_id")


@query("""
select lower(regexp_extract(t, '^</?([A-Za-z][^\\s/>]*)', 1)) as name, case when t like '</%' then 'close' when t like '%/>' then 'void' else 'open' end as kind, count(*) as n
from (select unnest(regexp_extract_all(html, '</?[A-Za-z][^>]*>')) as t from pages) group by all""")
def markup_tags(spark, sf_dir):
    """Tags of all pages by name and kind."""
    found = _table(spark, sf_dir, "pages").select(F.explode(M.tags_of("html")).alias("t")).where("t.kind <> 'other'")
    return found.groupBy("t.name", "t.kind").agg(F.count("*").alias("n"))


@query("""
select page_id, lower(regexp_extract(a, '^([^=]*)', 1)) as attr, count(*) as n
from (select page_id, unnest(regexp_extract_all(html, '\\s((?:href|src|HREF|SRC)\\s*=\\s*("[^"]*"|''[^'']*''))', 1)) as a from pages) group by all""")
def markup_links(spark, sf_dir):
    """Links of a page by attribute, in any quotes."""
    found = _table(spark, sf_dir, "pages").select("page_id", F.explode(M.links_of("html")).alias("l"))
    return found.groupBy("page_id", F.col("l.attr").alias("attr")).agg(F.count("*").alias("n"))


@query()
def markup_text(spark, sf_dir):
    """Plain text by the tokenizer, all entities; whether a page shows anything, and its tags of two ids."""
    p = _table(spark, sf_dir, "pages")
    return p.select("page_id", M.plain_text_of("html").alias("plain_text"), M.visible_of("html").alias("visible"), M.duplicate_id_tags_of("html").alias("duplicate_id_tags"))


@query()
def markup_spans(spark, sf_dir):
    """Elements by name: how many, how deep, how much they hold."""
    s = _table(spark, sf_dir, "pages").select(F.explode(M.spans_of("html")).alias("s")).select("s.*")
    return s.groupBy("name").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.sum((F.col("inner_end") - F.col("inner_start")).cast("long")).alias("held"))


@query()
def sheet_rules(spark, sf_dir):
    """Rules of the pages' own sheets: selector, bucket, specificity, declarations."""
    s = _table(spark, sf_dir, "pages").select("page_id", F.posexplode(M.style_blocks_of("html")).alias("sheet", "b"))
    r = s.select("page_id", "sheet", F.explode(C.rules_of("b.css")).alias("r"))
    return r.select("page_id", "sheet", "r.pos", "r.selector", "r.bucket", "r.spec", F.size("r.decls").alias("decls"))


def cascade(pages: DataFrame, key: str) -> DataFrame:
    """(key, element, prop, value): the winner of the rules of a page's own sheets and of inline styles, for selectors of one compound.

    Elements meet rules on the bucket key of the same page, then the rest of the compound decides; the order is (important, specificity, place).
    """
    sheets = pages.select(key, F.posexplode(M.style_blocks_of("html")).alias("sheet", "b"))
    rules = sheets.select(key, "sheet", F.explode(C.rules_of("b.css")).alias("r")).where("r.simple is not null")
    rules = rules.select(key, "r.bucket", "r.spec", "r.simple", F.struct("sheet", "r.pos").alias("place"), F.explode("r.decls").alias("d"))

    def elements(html: str) -> list[dict]:
        out = []
        for n, (_, kind, name, a, b) in enumerate(t for t in M.tags(html) if t[1] in ("open", "void")):
            tag = html[a:b]
            out.append({"element": n, "tag": name, "id": M.attr_value(tag, "id") or "", "classes": (M.attr_value(tag, "class") or "").split(), "style": M.unescape_entities(M.attr_value(tag, "style") or "")})
        return out

    found = rowwise(elements, "array<struct<element:int,tag:string,id:string,classes:array<string>,style:string>>")
    els = pages.select(key, F.explode(found("html")).alias("e")).select(key, "e.*")
    keys = F.array_distinct(F.concat(F.array(F.lit("*"), "tag"), F.when(F.col("id") != "", F.array(F.concat(F.lit("#"), "id"))).otherwise(F.array().cast("array<string>")), F.transform("classes", lambda c: F.concat(F.lit("."), c))))
    met = els.select(key, "element", "tag", "id", "classes", F.explode(keys).alias("bucket")).join(rules, [key, "bucket"])
    met = met.where("(simple.tag = '' or simple.tag = tag) and forall(simple.ids, x -> x = id) and size(array_except(simple.classes, classes)) = 0")
    hits = met.select(key, "element", "d.prop", "d.value", F.struct("d.important", "spec", F.col("place.sheet").alias("a"), F.col("place.pos").alias("b")).alias("by"))
    inline = els.where("style <> ''").select(key, "element", F.posexplode(C.expanded_of("style")).alias("b", "d"))
    inline = inline.select(key, "element", "d.prop", "d.value", F.struct("d.important", F.lit(1_000_000_000).cast("long").alias("spec"), F.lit(1 << 30).alias("a"), "b").alias("by"))
    return hits.unionByName(inline).groupBy(key, "element", "prop").agg(F.max_by("value", "by").alias("value"))


@query()
def sheet_cascade(spark, sf_dir):
    """Winning declarations of every element, from the pages' own sheets."""
    return cascade(_table(spark, sf_dir, "pages"), "page_id")


@query()
def book_check(spark, sf_dir):
    """Each host's internal links against its pages and anchors."""
    p = _pages(spark, sf_dir)
    return links.check(p, p.select("book", "name"))


@query("""
select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as book, page_id, list_distinct(regexp_extract_all(html, '\\s(?:id)="([^"]+)"', 1)).len() as anchors from pages""")
def book_anchors(spark, sf_dir):
    """Different ids of each page."""
    p = _pages(spark, sf_dir)
    return p.select("book", "page_id", F.size(F.array_distinct(F.transform(M.anchors_of("html"), lambda a: a["id"]))).cast("long").alias("anchors"))


@query()
def book_id_renames(spark, sf_dir):
    """Ids that an earlier page of the host has, too, and what they are called then."""
    return links.duplicate_ids(_pages(spark, sf_dir))


@query()
def book_contents(spark, sf_dir):
    """Headings of each host in reading order, with depths that leave out unused levels."""
    return contents.headings(_pages(spark, sf_dir))


@query("""
select regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as book, row_number() over (partition by book order by page_id) - 1 as ord,
  'text/' || page_id || '.xhtml' as name, octet_length(encode(html))::bigint as size, sha256(html) as digest from pages""")
def book_members(spark, sf_dir):
    """Each host's pages packed into one archive, and the archive's members read back."""
    p = _pages(spark, sf_dir).select("book", "ord", F.concat(F.lit("text/"), F.col("page_id").cast("string"), F.lit(".xhtml")).alias("name"), F.encode("html", "utf-8").alias("data"))
    read = books.entries_of(books.packed(p))
    return read.select("book", F.col("ord").cast("long").alias("ord"), "name", "size", F.sha2("data", 256).alias("digest"))


@query("select p_partkey, '[' || p_partkey || ',''' || p_name || ''',' || p_size || ',null,true]' as item from part")
def ion_roundtrip(spark, sf_dir):
    """Parts as binary Ion lists, decoded again."""
    coded = rowwise(lambda k, n, s: ion.encode([[k, n, s, None, True]]), "binary")
    return _table(spark, sf_dir, "part").select("p_partkey", ion.values_of(coded("p_partkey", "p_name", "p_size"))[0].alias("item"))


@query("""
with e as (select distinct user_id, event_id from events),
g as (select user_id, event_id - row_number() over (partition by user_id order by event_id) as g from e),
r as (select user_id, g, count(*) as n from g group by all)
select user_id, count(*) as runs, max(n) as longest from r group by user_id""")
def id_run_lists(spark, sf_dir):
    """A user's event ids as runs."""
    ids = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id").cast("long")).alias("ids"))
    runs = ids.select("user_id", ion.runs_of("ids").alias("runs"))
    longest = F.array_max(F.transform("runs", lambda r: F.coalesce(F.get(r, 1), F.lit(1).cast("long"))))
    return runs.select("user_id", F.size("runs").cast("long").alias("runs"), longest.alias("longest"))


_ENDS = r"(?:[。！？!?…．｡][。！？!?…．｡.]*[」』”’）》】〉〕\"'')\]]*\s*|\.(?:[」』”’）》】〉〕\"'')\]]+\s*|\s+|$))"


@query(f"""
select doc_id, (len(regexp_extract_all(text, '{_ENDS}')) + (trim(regexp_replace(text, '(?s).*?{_ENDS}', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) <> '')::int)::bigint as sentences
from documents where text is not null""")
def sentence_count(spark, sf_dir):
    """Sentences of each text."""
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(X.sentences_of("text")).cast("long").alias("sentences"))


@query("""
with t as (select distinct regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as k from part),
l as (select k, c, count(*) as n from (select k, unnest(string_split(k, '')) as c from t) group by all),
m as (select a.k as a, b.k as b, sum(least(a.n, b.n)) as shared from l a join l b on a.c = b.c and a.k < b.k group by all),
p as (select a, b, shared, starts_with(b, a) and len(b) - len(a) <= 2 as prefix from m)
select a, b, shared::bigint as shared, round(shared / greatest(len(a), len(b)), 6) as similarity, prefix from p
where 100 * shared >= 80 * greatest(len(a), len(b)) or prefix""")
def name_classes(spark, sf_dir):
    """Parts' names that are alike: pairs of different keys; equal names are one key."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", matching.match_key(F.col("p_name")).alias("key"))
    return matching.similar_classes(rows, "key", "p_partkey")[0]


#: Tracked entries and devices of the example. Fixed values.
_TRACKED = [("", False, None), ("src1", False, "kindle"), ("src1/en", False, "reader"), ("src2/de", False, "kindle"), ("src3/fr/12", True, "reader")]


def _paths(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string")).alias("path"))


_SQL_TRACKED = "tracked as (select * from (values ('', false, null), ('src1', false, 'kindle'), ('src1/en', false, 'reader'), ('src2/de', false, 'kindle'), ('src3/fr/12', true, 'reader')) as t(root, is_file, device)), docs as (select concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), doc_id::varchar) as path from documents)"


@query(f"""
with {_SQL_TRACKED}, met as (
  select path, device, root, is_file from docs join tracked on (is_file and path = root) or (not is_file and (root = '' or path = root or starts_with(path, root || '/')))),
best as (select * from met qualify row_number() over (partition by path, device order by is_file desc, len(root) desc) = 1)
select path, device, root, case when root = '' then path when root = path then '' else path[len(root) + 2:] end as below from best""")
def library_placement(spark, sf_dir):
    """For each path and device the entry that decides where it goes."""
    return library.placement(_paths(spark, sf_dir), spark.createDataFrame(_TRACKED, "root string, is_file boolean, device string"))


@query(f"""
with {_SQL_TRACKED}, t as (select * from tracked where root <> ''), devices as (select unnest(['kindle', 'reader', 'tablet']) as device),
met as (select path, device from docs join t on (is_file and path = root) or (not is_file and starts_with(path, root || '/')))
select distinct path, device from met union
select path, device from docs, devices where path not in (select path from met) and path not like '%7'""")
def library_wants(spark, sf_dir):
    """Which device gets which path; paths ending in 7 were tracked once and are in no entry now."""
    tracked = spark.createDataFrame([t for t in _TRACKED if t[0]], "root string, is_file boolean, device string")
    paths = _paths(spark, sf_dir)
    return library.wants(paths, tracked, spark.createDataFrame([("kindle",), ("reader",), ("tablet",)], "device string"), paths.where("path like '%7'"))


@query("""
with known as (select 'a/' || o_orderkey % 7 || '/' || o_orderkey as path, 'i' || o_orderkey as id, floor(o_totalprice)::bigint as size, o_orderkey % 13 = 0 as failed, (o_orderkey % 3) * 1800 as age from orders where o_orderkey % 11 <> 0),
present as (select case when o_orderkey % 19 = 0 then 'b/' else 'a/' end || o_orderkey % 7 || '/' || o_orderkey as path, 'i' || o_orderkey as id, floor(o_totalprice)::bigint + (o_orderkey % 17 = 0)::int as size from orders where o_orderkey % 5 <> 0),
live as (select id, min(path) as moved_to from present group by id)
select coalesce(k.path, p.path) as path, coalesce(k.id, p.id) as id, case when k.path is null then 'new'
  when p.path is not null and k.failed then case when p.size <> k.size then 'updated' when k.age >= 3600 then 'retry' else 'waiting' end
  when p.path is not null then case when p.size = k.size then 'unchanged' else 'updated' end
  when k.path like 'a/3/%' then 'unknown' when l.moved_to is not null then 'moved' else 'missing' end as change,
  case when change = 'moved' then l.moved_to end as moved_to
from known k full outer join present p on p.path = k.path left join live l on l.id = k.id""")
def library_changes(spark, sf_dir):
    """Orders as files of two listings: new, unchanged, updated, retry, waiting, unknown, moved, missing."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("size"))
    path = lambda top: F.concat(top, (F.col("k") % 7).cast("string"), F.lit("/"), F.col("k").cast("string"))
    ident = F.concat(F.lit("i"), F.col("k").cast("string")).alias("id")
    known = o.where("k % 11 <> 0").select(path(F.lit("a/")).alias("path"), ident, "size", F.lit(0).alias("mtime"), F.expr("if(k % 13 = 0, 'failed', 'ok')").alias("status"), (10_000 - (F.col("k") % 3) * 1800).alias("tried_at"), F.lit("b1").alias("build"))
    present = o.where("k % 5 <> 0").select(path(F.expr("if(k % 19 = 0, 'b/', 'a/')")).alias("path"), (F.col("size") + F.expr("if(k % 17 = 0, 1, 0)")).alias("size"), F.lit(0).alias("mtime"), ident)
    return library.listing_changes(known, present, spark.createDataFrame([("a/3",)], "path string"), now=F.lit(10_000), build="b1")


@query("""
select p_partkey, case when min(p_partkey) over (partition by lower(p_name)) = p_partkey then p_name || '.epub' else p_name || ' [' || substr(p_partkey::varchar, 1, 6) || '].epub' end as file_name from part""")
def library_names(spark, sf_dir):
    """File names of parts that do not collide, whatever the case."""
    named = library.file_names(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("own")), spark.createDataFrame([], "name string"))
    return named.select(F.col("id").alias("p_partkey"), "file_name")


@query("""
with w as (select c_custkey as id, unnest(['kindle', 'reader']) as device, 'f' || c_nationkey as want, 'g' || c_nationkey as legacy from customer where c_custkey % 4 <> 0),
o as (select c_custkey as id, case when c_custkey % 2 = 0 then 'kindle' else 'reader' end as device, case c_custkey % 3 when 0 then 'f' when 1 then 'g' else 'h' end || c_nationkey as have, c_custkey % 7 <> 0 as present from customer)
select coalesce(w.id, o.id) as id, coalesce(w.device, o.device) as device, case when w.id is null then 'retract' when present and have in (want, legacy) then 'keep' else 'build' end as action
from w full outer join o on o.id = w.id and o.device = w.device""")
def library_builds(spark, sf_dir):
    """What to build, keep and retract."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("n"))
    wanted = c.where("id % 4 <> 0").select("id", F.explode(F.array(F.lit("kindle"), F.lit("reader"))).alias("device"), F.concat(F.lit("f"), "n").alias("fingerprint"), F.concat(F.lit("g"), "n").alias("legacy"))
    outputs = c.select("id", F.expr("if(id % 2 = 0, 'kindle', 'reader')").alias("device"), F.concat(F.expr("case id % 3 when 0 then 'f' when 1 then 'g' else 'h' end"), "n").alias("fingerprint"), F.expr("id % 7 <> 0").alias("present"))
    return library.build_plan(wanted, outputs)


@query("""
select p_size, p_size * 20 as h, case when 1.0 * (p_size * 31) / (p_size * 20) >= 1.2 then 'spread' else 'page' end as kind, (p_size * 31) // 2 as left_w, p_size * 31 - (p_size * 31) // 2 as right_w,
  greatest((p_size * 31) // 50, 52428800)::bigint as margin from (select distinct p_size from part)""")
def picture_boxes(spark, sf_dir):
    """Sizes as pictures: spreads and their halves, and the margin of room."""
    s = _table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", (F.col("p_size") * 31).alias("w"), (F.col("p_size") * 20).alias("h"))
    halves = V.spread_widths(F.col("w"))
    kind = F.when(V.is_spread(F.col("w"), F.col("h")), "spread").otherwise("page")
    return s.select("p_size", "h", kind.alias("kind"), halves["left"].alias("left_w"), halves["right"].alias("right_w"), V.space_margin(F.col("w")).alias("margin"))


@query("""
select page_id, case when path like '%/%' then regexp_extract(path, '^(.*)/[^/]*$', 1) else '' end as dir, lower(regexp_extract(path, '\\.([^./]*)$', 1)) as ext
from (select page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) as path from pages)""")
def path_parts(spark, sf_dir):
    """Folder and extension of each page's path."""
    p = _pages(spark, sf_dir)
    return p.select("page_id", P.dir_of(F.col("name")).alias("dir"), P.extension(F.col("name")).alias("ext"))


@query("select doc_id, strftime(make_timestamp(doc_id * 86399000000), '%Y-%m-%dT%H:%M:%SZ') as stamp from documents")
def stamps(spark, sf_dir):
    """Ids as seconds, written as UTC times."""
    return _table(spark, sf_dir, "documents").select("doc_id", X.utc_w3c(F.col("doc_id") * 86399).alias("stamp"))


@query()
def name_keys(spark, sf_dir):
    """Parts' names as match keys, base titles, file names and hashes."""
    return _table(spark, sf_dir, "part").select("p_partkey", X.norm_of("p_name").alias("norm"), X.base_title_of("p_name").alias("base"), X.file_name("p_name").alias("file_name"), X.fnv64_of("p_name").alias("fnv64"))
