"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revmatch.llm import counts, decontaminate, extract, lm, merkle, packing, passages, pii, quality, simhash, topk, toxicity, whiten
from revmatch.llm.common import table


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(table(spark, sf_dir, "documents"))


def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.recount(table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op10_quality, op6_simhash, op3_toxicity, op4_packing, op7_extract, op5_decontaminate, op2_pii, op1_lm, op8_passages, op9_counts, op11_topk, op12_manifest, op13_whitening)}

# Fixed value: the polynomial of crc32, bits in falling order of significance reversed.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""


def _h(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::varchar)::varchar || ':' || ({f})::varchar, '-')" for f in fields) + ")"


_LEAF = _h("doc_id", "source", "lang", "n_chars", "text")
_TRIED = f"case when {_CRC32} % 7 = 0 then {_h('doc_id', 'source', 'lang', 'n_chars + 1', 'text')} else {_LEAF} end"


def _levels(name: str, low: str) -> str:
    """All nodes over ``low(tree, pos, h, n)``, level by level."""
    return f"""{name} as (select tree, 0 as level, pos, h, n from ({low}) union all
      select tree, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (max(n) + 1) // 2 from {name} where n > 1 group by tree, level, pos // 2)"""


SQL: dict[str, str] = {"op12_manifest": f"""with recursive
    langs as (select lang, count(*) as n, row_number() over (order by lang nulls first) - 1 as tree from documents group by lang),
    low as materialized (select doc_id, l.tree, l.n, leaf, tried, row_number() over (partition by l.tree order by doc_id nulls first, leaf) - 1 as pos
      from (select doc_id, lang, {_LEAF} as leaf, {_TRIED} as tried from documents) d join langs l on d.lang is not distinct from l.lang),
    {_levels('nodes', 'select tree, pos, leaf as h, n from low')},
    subroots as materialized (select tree, h as subroot from nodes where n = 1),
    {_levels('above', 'select -1 as tree, tree as pos, subroot as h, (select count(*) from langs) as n from subroots')},
    climb as (select tree as own, pos as leaf_no, tree, 0 as height, pos, n, tried as now, '' as proof, false as up from low union all
      select own, leaf_no, w.tree, w.height + 1, w.pos // 2, (w.n + 1) // 2,
        sha256(case when s.pos < w.pos then s.h || now when s.pos > w.pos then now || s.h else now end), proof || coalesce(s.h, ''), false
      from climb w left join nodes s on s.tree = w.tree and s.level = w.height and s.pos = xor(w.pos, 1) where w.n > 1),
    climb2 as (select own, leaf_no, 0 as height, own as pos, (select count(*) from langs) as n, now, proof from climb where n = 1 union all
      select own, leaf_no, w.height + 1, w.pos // 2, (w.n + 1) // 2,
        sha256(case when s.pos < w.pos then s.h || now when s.pos > w.pos then now || s.h else now end), proof || coalesce(s.h, '')
      from climb2 w left join above s on s.level = w.height and s.pos = xor(w.pos, 1) where w.n > 1)
    select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, now as folded_root, now = root as verified
    from climb2 c join low l on l.tree = c.own and l.pos = c.leaf_no join subroots s on s.tree = c.own
    cross join (select h as root from above where n = 1) where c.n = 1""",
    "op11_topk": """with v as (select vec_id, row_number() over () as r, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
      from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0)
    select query_id, rank::int as rank, vec_id, score from (
      select q.vec_id as query_id, c.vec_id, list_inner_product(q.x::double[], c.x::double[])::bigint as score,
        row_number() over (partition by q.r order by list_inner_product(q.x::double[], c.x::double[]) desc, c.vec_id) as rank
      from v q join v c on q.r <> c.r where q.vec_id % 50 = 0) where rank <= 5"""}
