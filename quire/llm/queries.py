"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from quire.llm.attention_quality import op6_attention_quality
from quire.llm.context_tree import op8_context_tree
from quire.llm.crf_lines import op5_crf_lines
from quire.llm.exact_topk import op9_exact_topk
from quire.llm.harmonic_packing import op3_harmonic_packing
from quire.llm.histogram_shards import op4_histogram_shards
from quire.llm.language_id import op7_language_id
from quire.llm.license_scan import STOP, TOKEN, Templates, op2_license_scan
from quire.llm.near_dedup import op1_minhash_dedup
from quire.llm.piece_viterbi import op10_piece_viterbi

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_license_scan,
        op3_harmonic_packing,
        op4_histogram_shards,
        op5_crf_lines,
        op6_attention_quality,
        op7_language_id,
        op8_context_tree,
        op9_exact_topk,
        op10_piece_viterbi,
    )
}

# Exact Jaccard over all pairs that share a shingle, and components by spreading the smallest id.
_NEAR = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), shingles as (
  select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s
  from words, unnest(range(1, greatest(len(w), 2))) as t(i) where len(w) > 0
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)
), edges as (select x, y from links union all select y, x from links),
reach(doc_id, root) as (
  select doc_id, doc_id from words
  union
  select e.y, r.root from reach r join edges e on e.x = r.doc_id
)
select w.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(r.root) as component_id, w.doc_id = min(r.root) as kept
from words w left join sizes s using (doc_id) join reach r using (doc_id) group by w.doc_id
"""

_TOPK = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def _licences() -> str:
    """The cosine of every line and every text with every template, without anchors."""
    model = Templates(0.75)
    text = lambda x: "'" + x.replace("'", "''") + "'"
    idf = ", ".join(f"({text(t)}, {w!r}::double)" for t, w in model.idf.items())
    weights = ", ".join(f"({text(t)}, {i}, {text(n)}, {w!r}::double)" for t, i, n, w in model.weights)
    return f"""
with idf(term, idf) as (values {idf}), weights(term, template, licence, weight) as (values {weights}),
files as (select doc_id, concat_ws('/', source, coalesce(lang, '-'), doc_id::varchar) as path, text from documents),
units as (
  select doc_id, -1 as i, text as part from files
  union all select doc_id, (i - 1) * 4 + n - 1, array_to_string(l[i:i + n - 1], chr(10))
  from (select doc_id, string_split(text, chr(10)) as l from files), unnest(range(1, len(l) + 1)) as t(i), unnest(range(1, 5)) as u(n) where i + n - 1 <= len(l)
), tf as (
  select doc_id, i, term, count(*) as tf from (select doc_id, i, unnest(regexp_extract_all(lower(part), '{TOKEN}')) as term from units)
  where term not in ({', '.join(text(t) for t in sorted(STOP))}) group by all
), w as (select doc_id, i, term, tf * coalesce(idf, {model.unknown!r}::double) as w from tf left join idf using (term)),
norms as (select doc_id, i, sqrt(sum(w * w)) as norm from w group by all),
dots as (
  select doc_id, i, template, licence, round(sum(w * weight) / any_value(norm), 6) as cosine
  from w join weights using (term) join norms using (doc_id, i) group by all having round(sum(w * weight) / any_value(norm), 6) >= {model.least}
), best as (select doc_id, i, licence, cosine from dots qualify row_number() over (partition by doc_id, i order by cosine desc, licence) = 1),
headers as (select doc_id, licence, cosine from best where i >= 0 qualify row_number() over (partition by doc_id order by cosine desc, licence, i) = 1),
whole as (select doc_id, licence, cosine from best where i < 0),
folders as (
  select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, licence from whole join files using (doc_id)
  qualify row_number() over (partition by folder order by cosine desc, licence) = 1
), ups as (
  select doc_id, n as depth, array_to_string(p[1:n], '/') as folder from (select doc_id, string_split(path, '/') as p from files), unnest(range(0, len(p))) as t(n)
), near as (
  select doc_id, folder, licence from ups join folders using (folder) where doc_id not in (select doc_id from headers)
  qualify row_number() over (partition by doc_id order by depth desc) = 1
)
select f.doc_id, f.path, h.licence as header, h.cosine as header_cosine, w.doc_id is not null as is_licence_file,
  n.folder as inherited_from, coalesce(h.licence, n.licence) as licence
from files f left join headers h using (doc_id) left join whole w using (doc_id) left join near n using (doc_id)
"""


ORACLE_SQL = {"op1_minhash_dedup": _NEAR, "op2_license_scan": _licences(), "op9_exact_topk": _TOPK}
