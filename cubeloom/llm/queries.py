"""Queries of the text operators over their whole tables, and SQL where there is any."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubeloom.llm import decontaminate, embeddings, html, licenses, lines, minhash, packing, quality, substrings, toxicity
from cubeloom.llm._common import read


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.near_duplicate_lines(read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(read(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_html": op2_html,
    "op3_packing": op3_packing,
    "op4_licenses": op4_licenses,
    "op5_quality": op5_quality,
    "op6_embeddings": op6_embeddings,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_substrings": op10_substrings,
}


def _licenses_sql() -> str:
    """The licence scan in DuckDB: phrases by neighbouring words, templates by line."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hits = []
    for phrase, label in licenses.PHRASES.items():
        places = " and ".join(f"w{i} = '{w}'" for i, w in enumerate(phrase.split()))
        hits.append(f"select doc_id, pos, '{label}' as label from next where {places}")
    templates = []
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            tokens = sorted(set(t.split()))
            need = max(1, math.ceil(0.85 * len(tokens) - 1e-9))
            templates.append(f"('{label}', [{', '.join(repr(w) for w in tokens)}], {need})")
    return f"""
    with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') as t from documents),
    w as (select r, doc_id, t, regexp_extract_all(t, {word}) as ws from d),
    tok as (select r as doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos from w),
    next as (select doc_id, pos, word as w0, lead(word) over o as w1, lead(word, 2) over o as w2 from tok window o as (partition by doc_id order by pos)),
    hit as ({" union all ".join(hits)}),
    base as (select doc_id, count(*) as n, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as labels from hit group by doc_id),
    line as (select r as doc_id, list_distinct(regexp_extract_all(x, {word})) as b from (select r, unnest(string_split(t, chr(10))) as x from d) y),
    tpl as (select * from (values {", ".join(templates)}) v(label, tokens, need)),
    found as (select doc_id, label, len(list_intersect(b, tokens)) / len(tokens) as share from line, tpl where len(list_intersect(b, tokens)) >= need),
    score as (select doc_id, max(share) as share from found group by doc_id),
    named as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from found union select doc_id, label from hit) u group by doc_id)
    select w.doc_id, len(ws) as n_words, coalesce(base.n, 0) as n_base, first_word, last_word, coalesce(base.labels, '') as base_labels, coalesce(named.labels, '') as labels,
        case when base.n > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
    from w left join base on base.doc_id = r left join score on score.doc_id = r left join named on named.doc_id = r"""


#: Vectors of one label by all pairs, and what each reaches over links.
_EMBEDDINGS_SQL = """
    with recursive v as (
        select vec_id, label, embedding::double[] as e from embeddings
        where vec_id is not null and label is not null and len(embedding) > 0 and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
            and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    p as (select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
    reach as (select vec_id as i, vec_id as r from v union select reach.i, p.j from reach join p on p.i = reach.r),
    n as (select i, count(*) as n from p group by i),
    c as (select i, min(r) as r from reach group by i)
    select vec_id, coalesce(n, 0) as n_links, coalesce(c.r, vec_id) as component_id, vec_id = coalesce(c.r, vec_id) as kept
    from embeddings left join n on n.i = vec_id left join c on c.i = vec_id"""

ORACLE_SQL: dict[str, str] = {"op4_licenses": _licenses_sql(), "op6_embeddings": _EMBEDDINGS_SQL}
