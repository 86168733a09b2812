"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontamination
from .line_dedup import dedup_lines
from .merkle import merkle_manifest
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .pii import find_personal_data
from .quality_knn import quality_scores
from .quality_rules import quality_rules
from .secrets import find_secrets
from .suffix_dedup import repeated_bytes
from .token_counts import token_counts
from .token_files import token_files
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_hash")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, percent=85).drop("group_id", "text_hash")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out_fold=1)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector on the first 16 components; see ``whiten`` for edge cases."""
    return whiten(_table(spark, sf_dir, "embeddings"), components=16)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and verified proof of every document; see ``merkle_manifest`` for edge cases."""
    return merkle_manifest(_table(spark, sf_dir, "documents"), every=5)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat earlier 100-byte strings; see ``remove_repeats`` for edge cases."""
    return repeated_bytes(_table(spark, sf_dir, "documents"), length=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality_rules, op3_source_mixing, op4_personal_data, op5_secrets,
        op6_token_files, op7_ngram_jaccard_join, op8_line_dedup, op9_decontamination, op10_quality_classifier,
        op11_embedding_whitening, op12_merkle_manifest, op13_suffix_dedup,
    )
}

_OP7 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
often as (select g from s group by g having count(*) > 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a semi join often using (g) join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(doc_id, seen) as (select doc_id, doc_id from n union select e.b, r.seen from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, d.doc_id) as component_id
from documents d left join n using (doc_id) left join (select doc_id, min(seen) as c from r group by doc_id) m using (doc_id)
"""

_OP8 = r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, max(doc_id) as stays from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
f as (select k.doc_id, k.pos, k.line, o.key is not null and k.doc_id <> o.stays as gone from k left join o using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from f group by doc_id
"""

_OP9 = r"""
with lowered as (
  select true as is_item, item_id::varchar as id, null::bigint as doc_id, text from benchmark union all select false, null, doc_id, text from documents),
w as (
  select *, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from lowered),
i as (
  select id, least(10, len(w)) as m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) as g
  from w where is_item and len(w) > 0),
d as (
  select doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as p from w cross join (select distinct m from i) where not is_item and len(w) >= m)),
h as (select d.doc_id, d.p, i.m, i.id from d join i on i.g = d.g and i.m = d.m),
n as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + m)) as x from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, id from h) group by doc_id)
select w.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join n using (doc_id) left join t using (doc_id) where not is_item
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELD = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"

_OP12 = rf"""
with recursive a as (
  select doc_id, source, {_LEAF.format(_FIELD.format("text"))} as leaf, {_LEAF.format(_FIELD.format(_LOWER.format("text")))} as lowered,
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 5 = 0 as hit
  from documents),
l as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, dense_rank() over (order by source nulls first) - 1 as s from a),
t(tree, lv, i, h) as (
  select s, 0, i, leaf from l
  union all
  select tree, lv + 1, i // 16, sha256(string_agg(h, '' order by i)) from (select *, count(*) over (partition by tree) as n from t) where n > 1 group by tree, lv, i // 16),
d as (select tree as s, max(lv) as depth, arg_max(h, lv) as subroot from t group by tree),
u(lv, i, h) as (
  select 0, s, subroot from d
  union all
  select lv + 1, i // 16, sha256(string_agg(h, '' order by i)) from (select *, count(*) over () as n from u) where n > 1 group by lv, i // 16),
root as (select max(lv) as depth, arg_max(h, lv) as root from u),
runs as (
  select tree, lv, i // 16 as run, list(h order by i) as hs from t group by all
  union all
  select -1, lv, i // 16, list(h order by i) from u group by all),
p(s, i, k, tree, lv, pos) as (
  select s, i, k, case when k < depth then s else -1 end, case when k < depth then k else k - depth end, (case when k < depth then i else s end) // (16 ** (case when k < depth then k else k - depth end))::bigint
  from (select l.s, l.i, d.depth, unnest(range(0, d.depth + root.depth)) as k from l join d using (s) cross join root)),
q as (
  select p.s, p.i, p.k, array_to_string(hs[1:(pos % 16)::int], '') as lft, array_to_string(hs[(pos % 16 + 2)::int:len(hs)], '') as rgt
  from p join runs on runs.tree = p.tree and runs.lv = p.lv and runs.run = p.pos // 16),
proofs as (select s, i, string_agg(lft || rgt, '' order by k) as siblings from q group by s, i),
f(s, i, k, h) as (
  select s, i, 0, case when coalesce(hit, false) then lowered else leaf end from l
  union all
  select f.s, f.i, f.k + 1, sha256(q.lft || f.h || q.rgt) from f join q on q.s = f.s and q.i = f.i and q.k = f.k),
folded as (select s, i, arg_max(h, k) as folded_root from f group by s, i)
select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, folded_root, folded_root = root as verified
from l join d using (s) cross join root left join proofs using (s, i) join folded using (s, i)
"""

_OP13 = r"""
with t as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
g as (
  select doc_id, p, row_number() over (partition by substr(x, 2 * p + 1, 200) order by doc_id, p) > 1 as again
  from (select doc_id, x, unnest(range(0, len(x) // 2 - 99)) as p from t)),
b as (
  select t.doc_id, y.p, substr(x, 2 * y.p + 1, 2) as byte from t, lateral (select unnest(range(0, len(x) // 2)) as p) y),
m as (
  select b.doc_id, b.p, byte, coalesce(max(again::int) over (partition by b.doc_id order by b.p rows between 99 preceding and current row), 0) = 1 as gone
  from b left join g on g.doc_id = b.doc_id and g.p = b.p),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as edge from m),
o as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (edge) as n_spans, string_agg(byte, '' order by p) filter (not gone) as kept from e group by doc_id)
select doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(from_hex(coalesce(kept, ''))) as kept_sha256
from t left join o using (doc_id)
"""

ORACLES: dict[str, str] = {"op7_ngram_jaccard_join": _OP7, "op8_line_dedup": _OP8, "op9_decontamination": _OP9, "op12_merkle_manifest": _OP12, "op13_suffix_dedup": _OP13}
