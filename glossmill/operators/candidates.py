"""Candidate meanings of mentions: lookup, filters and choices.

Candidates are (doc_id, mention_id, ref, ord): ``ord`` is the place in the dictionary's order of
senses and stands for the list order everything here relies on. Missing senses give no candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Senses by lemma first, then those by form that the lemma has not given; sense order kept.

    ``mentions(doc_id, mention_id, form, lemma)``, ``dictionary(lemma, sense_rank, ref)``. Only the
    distinct (form, lemma) pairs meet the dictionary, so the lookup shuffles the vocabulary; the
    result joins back on the pair.
    """
    pairs = mentions.select("form", "lemma").distinct()
    by = [pairs.select("form", "lemma", F.col(c).alias("key"), F.lit(p).alias("priority")) for p, c in enumerate(("lemma", "form"))]
    found = by[0].unionByName(by[1]).join(dictionary.withColumnRenamed("lemma", "key"), "key")
    first = found.groupBy("form", "lemma", "ref").agg(F.min(F.struct("priority", "sense_rank")).alias("at"))
    place = Window.partitionBy("form", "lemma").orderBy("at", "ref")
    senses = first.select("form", "lemma", "ref", F.row_number().over(place).alias("ord"))
    return mentions.join(senses, ["form", "lemma"]).select("doc_id", "mention_id", "ref", "ord")


def lookup_unordered(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, mention_id, ref) of all senses of form or lemma, as a set."""
    keys = mentions.select("doc_id", "mention_id", F.explode(F.array_distinct(F.array("form", "lemma"))).alias("lemma"))
    return keys.join(dictionary.select("lemma", "ref"), "lemma").select("doc_id", "mention_id", "ref").distinct()


def top_candidates(candidates: DataFrame, top_k: int, threshold: float, weight: str = "w") -> DataFrame:
    """The first ``top_k`` senses of each mention and every one of at least ``threshold`` weight."""
    place = F.row_number().over(Window.partitionBy("doc_id", "mention_id").orderBy("ord"))
    return candidates.withColumn("_k", place).where((F.col("_k") <= top_k) | (F.col(weight) >= threshold)).drop("_k")


def mention_lists(candidates: DataFrame) -> DataFrame:
    """(doc_id, ref, ms): the mentions of each meaning, in order and with repeats."""
    return candidates.groupBy("doc_id", "ref").agg(F.array_sort(F.collect_list("mention_id")).alias("ms"))


def same_mentions(candidates: DataFrame) -> DataFrame:
    """(doc_id, ms, refs): meanings that have exactly the same mentions.

    The pairs a ranking may link are all others; they are told apart by this key instead of a
    set of pairs, which would grow with the square of the meanings.
    """
    lists = mention_lists(candidates)
    return lists.groupBy("doc_id", "ms").agg(F.array_sort(F.collect_list("ref")).alias("refs"))


def overlapping(candidates: DataFrame) -> DataFrame:
    """(doc_id, a, b), a < b: meanings that share a mention; all other pairs are disjoint."""
    by = candidates.select("doc_id", "mention_id", "ref").distinct()
    other = by.withColumnRenamed("ref", "b")
    return by.join(other, ["doc_id", "mention_id"]).where("ref < b").select("doc_id", F.col("ref").alias("a"), "b").distinct()


def reset_weights(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("weight", F.lit(0.0))


# --- one candidate a mention ---------------------------------------------------------------

_KEY = ("doc_id", "mention_id")


def _pick(candidates: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy(*_KEY).orderBy(*order)
    return candidates.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def choose_random(candidates: DataFrame, seed: int = 0) -> DataFrame:
    """A sense by hash of document, mention and meaning; the same in every run."""
    return _pick(candidates, F.md5(F.concat_ws("|", "doc_id", "mention_id", "ref", F.lit(seed))), F.col("ord"))


def choose_first(candidates: DataFrame) -> DataFrame:
    """The first sense, the least meaning where two words are one mention."""
    return _pick(candidates, F.col("ord"), F.col("ref"))


def choose_top(candidates: DataFrame, weight: str) -> DataFrame:
    """The sense of most weight, the first of equals."""
    return _pick(candidates, F.desc(F.round(weight, 9)), F.col("ord"))


def choose_top_or_first(candidates: DataFrame, weight: str, threshold: float) -> DataFrame:
    """The sense of most weight if that is at least ``threshold``, else the first sense."""
    best = F.max(F.round(weight, 9)).over(Window.partitionBy(*_KEY))
    keyed = candidates.withColumn("_w", F.when(best >= threshold, F.round(weight, 9)).otherwise(0.0))
    return _pick(keyed, F.desc("_w"), F.col("ord")).drop("_w")


def choose_ranked(candidates: DataFrame, rank: str) -> DataFrame:
    """The sense of highest rank; a mention whose senses are all unranked has none."""
    return choose_top(candidates.where(F.col(rank) > 0), rank)


def choose_ranked_or_first(candidates: DataFrame, rank: str) -> DataFrame:
    ranked = F.coalesce(F.round(rank, 9), F.lit(0.0))
    return _pick(candidates, F.desc(ranked), F.col("ord"))
