"""Spans of tokens: mentions, n-grams and their relations.

Tokens come as (doc_id, sent_id, i, form, lemma, pos), one row each. Null lemmas fall back to the
form, null tags count as function words, empty sentences give no spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import is_punctuation


def sentence_arrays(tokens: DataFrame) -> DataFrame:
    """One row a sentence with its tokens in order; a sentence is bounded, so the array is."""
    item = F.struct("i", F.coalesce("form", F.lit("")).alias("form"), F.coalesce("lemma", "form", F.lit("")).alias("lemma"), F.coalesce("pos", F.lit("X")).alias("pos"))
    return tokens.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(item)).alias("t"))


def mentions(tokens: DataFrame, max_span: int = 3, excluded: tuple[str, ...] = ("X", "R"), noun: str = "N", skip_last: int = 0, no_punctuation: bool = False) -> DataFrame:
    """(doc_id, sent_id, l, r, form, lemma, pos) of all spans of up to ``max_span`` tokens.

    A single token needs a tag that is not excluded, a longer span any noun and gets the noun tag.
    ``skip_last`` leaves that many tokens at the end of a sentence out of all spans.
    One shuffle, on the sentence; spans are made in place from its array.
    """
    rows = sentence_arrays(tokens).withColumn("n", F.size("t") - skip_last).where("n > 0")
    starts = rows.select("doc_id", "sent_id", "t", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("l"))
    ends = starts.select("*", F.explode(F.sequence(F.col("l") + 1, F.least(F.col("l") + max_span, F.col("n")))).alias("r"))
    part = ends.select("doc_id", "sent_id", "l", "r", F.slice("t", F.col("l") + 1, F.col("r") - F.col("l")).alias("s"))
    many = F.col("r") - F.col("l") > 1
    kept = part.where(F.when(many, F.exists("s", lambda x: x["pos"].startswith(noun))).otherwise(~F.col("s")[0]["pos"].isin(list(excluded))))
    if no_punctuation:
        kept = kept.where(~F.exists("s", lambda x: is_punctuation(x["form"])))
    return kept.select(
        "doc_id", "sent_id", "l", "r",
        F.array_join(F.transform("s", lambda x: x["form"]), " ").alias("form"),
        F.array_join(F.transform("s", lambda x: x["lemma"]), " ").alias("lemma"),
        F.when(many, noun).otherwise(F.col("s")[0]["pos"]).alias("pos"),
    )


def ngrams(tokens: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, sent_id, l, r, form) of all spans of up to ``n`` tokens; the right end is exclusive."""
    return mentions(tokens, n, excluded=(), noun="").select("doc_id", "sent_id", "l", "r", "form")


def _parts(spans: DataFrame, *carried: str) -> DataFrame:
    """Each span as (ol, or) with every span (l, r) that would lie within it: at most max_span² rows a span."""
    outer = spans.select("doc_id", "sent_id", F.col("l").alias("ol"), F.col("r").alias("or"), *carried)
    lefts = outer.select("*", F.explode(F.sequence("ol", F.col("or") - 1)).alias("l"))
    return lefts.select("*", F.explode(F.sequence(F.col("l") + 1, F.col("or"))).alias("r")).where("not (l = ol and r = or)")


def contained_spans(spans: DataFrame) -> DataFrame:
    """Pairs (outer, inner) of different spans of one sentence, one within the other.

    Instead of pairing all spans of a sentence, each outer span looks its parts up.
    """
    inner = spans.select("doc_id", "sent_id", "l", "r").distinct()
    return _parts(spans).join(inner, ["doc_id", "sent_id", "l", "r"]).select("doc_id", "sent_id", "ol", "or", "l", "r")


def maximal_spans(weighted: DataFrame) -> DataFrame:
    """Spans that outweigh all spans they contain and that none containing them outweighs.

    ``weighted``: (doc_id, sent_id, l, r, w), one row a span. Each outer span takes its weight along
    to its parts, so one join decides every pair.
    """
    key = ["doc_id", "sent_id", "l", "r"]
    outer = weighted.withColumn("ow", F.col("w"))
    both = _parts(outer, "ow").join(weighted.select(*key, F.col("w").alias("iw")), key)
    wins = F.col("ow") > F.col("iw")
    lost = both.select("doc_id", "sent_id", F.when(wins, F.col("l")).otherwise(F.col("ol")).alias("l"), F.when(wins, F.col("r")).otherwise(F.col("or")).alias("r")).distinct()
    return weighted.join(lost, key, "left_anti")
