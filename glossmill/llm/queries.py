"""Queries of the llm operators, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.context import table
from glossmill.llm import frequencies, lookalikes, mixing, neighbours, residue, sentences, tokenizer, weights

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return weights.distinctive_pairs(table(spark, d, "tokens"))


def p1_weighters(spark: SparkSession, d: str) -> DataFrame:
    return weights.weighters(table(spark, d, "texts"), table(spark, d, "tokens"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "text_vectors"))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, d, "text_vectors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return frequencies.marked_terms(table(spark, d, "tokens")).where("mark is not null").select("field_name", "term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequencies.marked_terms(table(spark, d, "tokens"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "uima_texts")).select("uima_id", "start_char", "end_char")


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "uima_texts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.inconsistent_values(table(spark, d, "tokens"), table(spark, d, "texts")).select("tok_id", "field_name").distinct()


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    found = lookalikes.inconsistent_values(table(spark, d, "tokens"), table(spark, d, "texts"))
    return found.groupBy("field_name", "value", "form").agg(F.count("*").alias("n_tokens"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_texts(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "source", "n_chars")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_weighters, p3_found, p3_neighbours, p5_found, p5_counts, p6_found, p6_sentences,
        p7_found, p7_forms, p8_ids, p9_mixture, p9_shares, p10_found, p10_kept,
    )
}

_TERM_COUNTS = """
with k as (select distinct text_id, tok_id, lemma, wf from tokens where text_id is not null and tok_id is not null),
n as (select count(distinct text_id) as n from tokens),
f as (select 'lemma' as field_name, lemma as term, text_id, tok_id from k union all select 'wf', wf, text_id, tok_id from k),
c as (select field_name, term, count(distinct tok_id) as n_tokens, count(distinct text_id) as n_texts from f where term <> '' group by all),
m as (select field_name, term, n_tokens, n_texts, case when n_texts = 1 then 'rare' when n_texts * 3 > n then 'common' end as mark from c, n)
"""

SQL: dict[str, str] = {
    "p1_found": """
with t as (select text_id, lemma, count(distinct tok_id) as tf from tokens where lemma <> '' group by all),
d as (select lemma, count(*) as df from t group by all)
select text_id, lemma from t join d using (lemma) where tf >= 4 and df <= 5
""",
    "p3_found": """
with v as (select vec_id, any_value(vectors) as v from text_vectors
           where len(vectors) = 64 and list_count(vectors) = 64 and len(list_filter(vectors, lambda x: not isfinite(x))) = 0
             and len(list_filter(vectors, lambda x: x <> 0)) > 0 group by vec_id),
s as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.vec_id <> b.vec_id),
r as (select a, b, c, row_number() over (partition by a order by c desc, b) as r from s)
select distinct least(a, b) as vec_id_a, greatest(a, b) as vec_id_b from r where r <= 5 and c >= 0.8
""",
    "p5_found": _TERM_COUNTS + "select field_name, term, mark from m where mark is not null",
    "p5_counts": _TERM_COUNTS + "select field_name, term, n_tokens, n_texts, mark from m",
}
