"""Context of a document: its frequent content words, their vector, and weights against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.text import gloss_tokens, is_content_word
from glossmill.functions.vectors import doubles, scale, unit, unit_dot


def context_tokens(tokens: DataFrame, min_freq: int = 3, words: frozenset[str] | None = None) -> DataFrame:
    """(doc_id, form, n, first): content words with at least ``min_freq`` tokens, by first place."""
    kept = tokens.where(is_content_word(F.col("form"), words))
    return kept.groupBy("doc_id", "form").agg(F.count("*").alias("n"), F.min(F.struct("sent_id", "i")).alias("first")).where(F.col("n") >= min_freq)


def mean_vectors(items: DataFrame, vectors: DataFrame, key: list[str], dims: int, item: str = "form", weight: str | None = None) -> DataFrame:
    """(key, vec): mean of the vectors of a key's items, repeats counted; keys without any have no row.

    Sums are partial aggregates per dimension inside a task: each dimension is a column, so no
    array is collected and the shuffle carries one row a key and task.
    """
    v = vectors.select(F.col("item").alias(item), doubles(F.col("vec")).alias("_v")).where("_v is not null")
    w = F.col(weight) if weight else F.lit(1.0)
    joined = items.join(v, item)
    sums = joined.groupBy(*key).agg(F.sum(w).alias("_n"), *[F.sum(F.col("_v")[d] * w).alias(f"_{d}") for d in range(dims)])
    return sums.select(*key, F.array(*[F.col(f"_{d}") / F.col("_n") for d in range(dims)]).alias("vec"))


def sif_vectors(items: DataFrame, vectors: DataFrame, key: list[str], dims: int, a: float = 1e-3, item: str = "form") -> DataFrame:
    """Smooth inverse frequency sentence vectors without the common component.

    Weights a / (a + p(word)); the mean of all sentence vectors' leading direction (by power
    iteration on the small dims × dims moment matrix, ``dims``² numbers whatever the data) is taken out.
    """
    import numpy as np

    total = items.count()
    freq = items.groupBy(item).agg(F.count("*").alias("_c"))
    weighted = items.join(freq, item).withColumn("_w", F.lit(a) / (F.lit(a) + F.col("_c") / F.lit(float(max(total, 1)))))
    v = vectors.select(F.col("item").alias(item), doubles(F.col("vec")).alias("_v")).where("_v is not null")
    sums = weighted.join(v, item).groupBy(*key).agg(F.count("*").alias("_n"), *[F.sum(F.col("_v")[d] * F.col("_w")).alias(f"_{d}") for d in range(dims)])
    raw = sums.select(*key, F.array(*[F.col(f"_{d}") / F.col("_n") for d in range(dims)]).alias("vec"))
    moments = raw.select(F.posexplode("vec").alias("i", "x"), "vec").groupBy("i").agg(*[F.sum(F.col("x") * F.col("vec")[d]).alias(str(d)) for d in range(dims)]).collect()
    if not moments:
        return raw
    m = np.zeros((dims, dims))
    for r in moments:
        m[r["i"]] = [r[str(d)] for d in range(dims)]
    u = np.linalg.eigh(m)[1][:, -1]
    axis = F.array(*[F.lit(float(x)) for x in u])
    along = F.aggregate(F.zip_with("vec", axis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return raw.withColumn("_p", along).select(*key, F.zip_with("vec", scale(axis, F.col("_p")), lambda x, y: x - y).alias("vec"))


def gloss_vectors(glosses: DataFrame, vectors: DataFrame, dims: int, words: frozenset[str] | None = None) -> DataFrame:
    """(ref, vec) from ``glosses(ref, gloss)``: mean vector of the content words; none without any."""
    tokens = glosses.select("ref", F.explode(gloss_tokens(F.col("gloss"))).alias("form")).where(is_content_word(F.col("form"), words))
    return mean_vectors(tokens, vectors, ["ref"], dims)


def with_fallback(items: DataFrame, vectors: DataFrame, unknown: tuple[str, ...] = ("UNKNOWN", "UUUNKKK", "UNK", "*UNKNOWN*", "<unk>")) -> DataFrame:
    """(item, vec) of the wanted items; a missing one gets the vector of the first unknown mark there is."""
    order = F.array(*[F.lit(x) for x in unknown])
    row = vectors.where(F.col("item").isin(*unknown) & F.col("vec").isNotNull()).select(F.array_position(order, F.col("item")).alias("k"), "vec").orderBy("k").limit(1).collect()
    found = items.select("item").distinct().join(vectors.select("item", "vec"), "item", "left")
    if not row:
        return found
    return found.withColumn("vec", F.coalesce("vec", F.array(*[F.lit(float(x)) for x in row[0]["vec"]])))


def inverse_weights(items: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, w): looked-up weight, and the least of all weights where there is none."""
    least = weights.agg(F.min("w")).first()[0]
    return items.select("item").distinct().join(weights.select("item", "w"), "item", "left").withColumn("w", F.coalesce("w", F.lit(least).cast("double")))


def context_weights(candidates: DataFrame, contexts: DataFrame, meanings: DataFrame) -> DataFrame:
    """(doc_id, ref, w): similarity of each meaning's vector to its document's.

    Vectors are normalised once each, so that a pair costs one sum of products.

    Undefined similarities are 0; if any weight of a document is negative all of its weights
    become (w + 1) / 2.
    """
    refs = candidates.select("doc_id", "ref").distinct()
    joined = refs.join(contexts.select("doc_id", unit(doubles(F.col("vec"))).alias("_c")), "doc_id", "left").join(meanings.select("ref", unit(doubles(F.col("vec"))).alias("_m")), "ref", "left")
    alike = unit_dot(F.col("_c"), F.col("_m"))
    raw = joined.select("doc_id", "ref", F.coalesce(alike, F.lit(0.0)).alias("w"))
    least = F.min("w").over(Window.partitionBy("doc_id"))
    return raw.withColumn("_l", least).select("doc_id", "ref", F.when(F.col("_l") < 0, (F.col("w") + 1) / 2).otherwise(F.col("w")).alias("w"))
