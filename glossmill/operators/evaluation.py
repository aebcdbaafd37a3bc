"""Scores of choices and rankings against gold data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_recall(system: DataFrame, gold: DataFrame) -> DataFrame:
    """(precision, recall, f1): keys in gold only; a key counts by the share of its answers that are right.

    ``system(key, ref)``, ``gold(key, refs)``. Without answers or gold the scores are null.
    """
    return scores(answer_sums(system, gold))


def answer_sums(system: DataFrame, gold: DataFrame) -> DataFrame:
    """(s, n, g): the sum of right shares, the keys answered and those of gold, for ``scores``."""
    answers = system.groupBy("key").agg(F.collect_set("ref").alias("answers"))
    share = F.size(F.array_intersect("answers", "refs")) / F.size("answers")
    judged = gold.join(answers, "key", "left").select(F.when(F.col("answers").isNotNull(), share).alias("ok"))
    return judged.agg(F.sum("ok").alias("s"), F.count("ok").alias("n"), F.count("*").alias("g"))


def scores(sums: DataFrame, *by: str) -> DataFrame:
    """(by, precision, recall, f1) of sums (by, s, n, g)."""
    s = F.when(F.col("n") > 0, F.col("s").cast("double"))
    p, r = F.try_divide(s, F.col("n")), F.try_divide(s, F.col("g"))
    return sums.select(*by, p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def mean_average_precision(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(map, n_docs): mean over documents with hits of the mean precision at the hits.

    ``ranking(doc_id, ref, k)`` with k from 1, ``gold(doc_id, ref)``.
    """
    hit = ranking.join(gold.select("doc_id", "ref").distinct().withColumn("hit", F.lit(1)), ["doc_id", "ref"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    so_far = F.sum("hit").over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    at = hit.withColumn("p", so_far / F.col("k")).where("hit = 1")
    ap = at.groupBy("doc_id").agg(F.avg("p").alias("ap"))
    return ap.agg(F.avg("ap").alias("map"), F.count("*").alias("n_docs"))


def rank_list(weights: DataFrame, weight: str = "rank") -> DataFrame:
    """(doc_id, ref, k): places by falling weight, smaller meaning first on ties."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round(weight, 9)), "ref")
    return weights.select("*", F.row_number().over(w).alias("k"))


def sweep(candidates: DataFrame, gold: DataFrame, weight: str, thresholds: list[float]) -> DataFrame:
    """(threshold, precision, recall) of choosing each key's top sense where it reaches the threshold.

    ``candidates(key, ref, ord, weight)``. The thresholds are a list in the row, not a join.
    """
    best = Window.partitionBy("key").orderBy(F.desc(F.round(weight, 9)), "ord")
    top = candidates.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("key", "ref", F.round(weight, 9).alias("w"))
    judged = gold.join(top, "key", "left").select("w", F.array_contains("refs", F.col("ref")).cast("int").alias("ok"))
    at = judged.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    taken = F.col("w") >= F.col("threshold")
    sums = at.groupBy("threshold").agg(F.sum(F.when(taken, F.col("ok"))).alias("s"), F.count_if(taken).alias("n"), F.count("*").alias("g"))
    return sums.select("threshold", F.try_divide("s", "n").alias("precision"), F.coalesce(F.col("s") / F.col("g"), F.lit(0.0)).alias("recall"))


def report(candidates: DataFrame, gold: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, ref, mark) of each candidate: OK, FAIL, GOLD, RANKED or blank."""
    g = gold.select("key", F.explode("refs").alias("ref")).distinct().withColumn("g", F.lit(True))
    s = chosen.select("key", "ref").distinct().withColumn("s", F.lit(True))
    both = candidates.join(g, ["key", "ref"], "left").join(s, ["key", "ref"], "left")
    mark = F.when(F.col("s") & F.col("g"), "OK").when(F.col("s"), "FAIL").when(F.col("g"), "GOLD").when(F.col("weight") > 0, "RANKED").otherwise("")
    return both.select("key", "ref", mark.alias("mark"))


def top_ranks(weights: DataFrame, n: int = 100, weight: str = "rank") -> DataFrame:
    """The ``n`` highest weights of all documents, smaller document and meaning first on ties; each task keeps its own ``n``."""
    return weights.select("doc_id", "ref", weight).orderBy(F.desc(F.round(weight, 9)), "doc_id", "ref").limit(n)
