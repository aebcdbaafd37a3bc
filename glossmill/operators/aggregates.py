"""Counts, weights and statistics over documents; partial aggregates in the JVM, but for the pairs of ``pair_counts``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_of_forms(candidates: DataFrame) -> DataFrame:
    """(ref, w): distinct forms of a meaning over the most of any meaning; from (ref, form)."""
    n = candidates.groupBy("ref").agg(F.count_distinct("form").alias("n"))
    most = n.agg(F.max("n")).first()[0]
    return n.select("ref", (F.col("n") / F.lit(most).cast("double")).alias("w"))


def tf_idf(candidates: DataFrame, as_written: bool = False) -> DataFrame:
    """(doc_id, ref, w) from (doc_id, ref), one row an occurrence.

    tf = 1 + ln(count), idf = ln(N / (df + 1)), by the document's maximum. ``as_written`` counts each
    meaning once and in the end gives every meaning of a document the average weight.
    """
    n_docs = candidates.agg(F.count_distinct("doc_id")).first()[0]
    counts = candidates.groupBy("doc_id", "ref").agg(F.count("*").alias("f"))
    df = counts.groupBy("ref").agg(F.count("*").alias("df"))
    f = F.lit(1.0) if as_written else F.col("f").cast("double")
    raw = counts.join(df, "ref").select("doc_id", "ref", ((1 + F.ln(f)) * F.ln(F.lit(float(n_docs)) / (F.col("df") + 1))).alias("x"))
    per_doc = Window.partitionBy("doc_id")
    top = F.max("x").over(per_doc)
    scaled = raw.withColumn("w", F.when(top != 0, F.col("x") / top).otherwise(0.0))
    if as_written:
        scaled = scaled.withColumn("w", F.avg("w").over(per_doc))
    return scaled.select("doc_id", "ref", "w")


def frequencies(annotations: DataFrame) -> dict[str, DataFrame]:
    """Counts from (doc_id, form, ref): by meaning, by form, by both, and documents of a meaning."""
    both = annotations.groupBy("form", "ref").agg(F.count("*").alias("n"))
    return {
        "meanings": annotations.groupBy("ref").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")),
        "forms": both.groupBy("form").agg(F.sum("n").alias("n")),
        "form_meanings": both,
    }


def prior(annotations: DataFrame) -> DataFrame:
    """(form, ref, p): share of the meaning among the occurrences of the form."""
    both = annotations.groupBy("form", "ref").agg(F.count("*").alias("n"))
    forms = both.groupBy("form").agg(F.sum("n").alias("m"))
    return both.join(forms, "form").select("form", "ref", (F.col("n") / F.col("m")).alias("p"))


def with_prior(candidates: DataFrame, priors: DataFrame) -> DataFrame:
    """Candidates with the prior of their form and meaning, 0 if there is none."""
    return candidates.join(priors, ["form", "ref"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def average_weight(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("doc_id", "ref").agg(F.avg("weight").alias("weight"))


def most_weight(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Largest candidate weight of each mention, 0 without candidates."""
    key = ["doc_id", "mention_id"]
    top = candidates.groupBy(*key).agg(F.max("weight").alias("w"))
    return mentions.select(*key).distinct().join(top, key, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def non_zero_average(subgraph_vertices: DataFrame) -> DataFrame:
    """(doc_id, sg_id, w): mean of the non-zero vertex weights."""
    return subgraph_vertices.groupBy("doc_id", "sg_id").agg(F.coalesce(F.avg(F.nullif("w", F.lit(0.0))), F.lit(0.0)).alias("w"))


def describe(df: DataFrame, value: Column | str, by: list[str] | None = None) -> DataFrame:
    """N, min, max, mean, median and sample deviation of a value."""
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("deviation"),
    )


def coverage(tokens: DataFrame, mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, covered, covered_by_multiword, polysemy).

    ``polysemy`` is the mean over covered tokens of the mean number of candidates of the mentions
    over the token. ``mentions`` has (doc_id, sent_id, mention_id, l, r).
    """
    senses = candidates.groupBy("doc_id", "mention_id").agg(F.count("*").alias("senses"))
    spans = mentions.join(senses, ["doc_id", "mention_id"]).select("doc_id", "sent_id", F.explode(F.sequence("l", F.col("r") - 1)).alias("i"), "senses", (F.col("r") - F.col("l") > 1).alias("multi"))
    cover = spans.groupBy("doc_id", "sent_id", "i").agg(F.avg("senses").alias("p"), F.max("multi").alias("multi"))
    joined = tokens.select("doc_id", "sent_id", "i").join(cover, ["doc_id", "sent_id", "i"], "left")
    return joined.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"),
        F.count("p").alias("covered"),
        F.count_if(F.coalesce("multi", F.lit(False))).alias("covered_by_multiword"),
        F.avg("p").alias("polysemy"),
    )


def entity_stats(mentions: DataFrame) -> DataFrame:
    """Mentions and tokens covered by named-entity type; from (doc_id, ner, l, r)."""
    return mentions.where(F.coalesce("ner", F.lit("")) != "").groupBy("ner").agg(
        F.count("*").alias("n_mentions"), F.sum(F.col("r") - F.col("l")).alias("n_tokens"), F.count_distinct("doc_id").alias("n_docs")
    )


def pos_counts(tokens: DataFrame, pos: str = "pos") -> DataFrame:
    """Tokens by simple tag with the total over content tags, as the tag CONTENT."""
    counts = tokens.groupBy(F.col(pos).alias("pos")).agg(F.count("*").alias("n"))
    content = counts.where("pos <> 'X'").agg(F.lit("CONTENT").alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return counts.unionByName(content)


def similarity_stats(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, n_meanings, n_pairs, n_similar, mean): linked pairs of distinct meanings and their mean similarity.

    ``entries``: thresholded similarity entries, both ways; pairs below the threshold are counted, not listed.
    """
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n_meanings"))
    linked = entries.where("a < b").groupBy("doc_id").agg(F.count("*").alias("n_similar"), F.avg("value").alias("mean"))
    pairs = (F.col("n_meanings") * (F.col("n_meanings") - 1) / 2).cast("long").alias("n_pairs")
    return n.join(linked, "doc_id", "left").select("doc_id", "n_meanings", pairs, F.coalesce("n_similar", F.lit(0)).alias("n_similar"), "mean")


def pair_counts(rows: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, n_pairs, n_valid, n_defined, n_filtered, n_negative) of the pairs of meanings of ``ranking_input``.

    Valid pairs have different mentions, defined ones also two vectors that are not zero; of these,
    those below the threshold are filtered, and those below 0 negative.
    """
    doc = rows.schema["doc_id"].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ref", kind="stable")
        n = len(p)
        sizes = p["ms"].value_counts().to_numpy()
        valid = n * (n - 1) // 2 - int((sizes * (sizes - 1) // 2).sum())
        some = np.array([v is not None and float(np.linalg.norm(v)) > 0 for v in p["vec"]], dtype=bool)
        x = np.array([np.asarray(v, dtype=float) / np.linalg.norm(v) for v, k in zip(p["vec"], some) if k])
        group = p["ms"].to_numpy()[some]
        defined = filtered = negative = 0
        for i in range(len(x) - 1):
            c = (x[i + 1 :] @ x[i])[group[i + 1 :] != group[i]]
            defined, filtered, negative = defined + len(c), filtered + int((c < threshold).sum()), negative + int((c < 0).sum())
        return pd.DataFrame([(p["doc_id"].iloc[0], n * (n - 1) // 2, valid, defined, filtered, negative)], columns=["doc_id", "n_pairs", "n_valid", "n_defined", "n_filtered", "n_negative"])

    kept = rows.select("doc_id", "ref", "ms", "vec")
    return kept.groupBy("doc_id").applyInPandas(run, f"doc_id {doc}, n_pairs long, n_valid long, n_defined long, n_filtered long, n_negative long")


def described_meanings(meanings: DataFrame, most: int | None = None) -> DataFrame:
    """Meanings with a gloss or a lemma; the first ``most`` by reference where given."""
    if most is not None:
        return described_meanings(meanings).orderBy("ref").limit(most)
    some = [F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0 for c in ("glosses", "lemmas")]
    return meanings.where(some[0] | some[1])


def _list_stats(meanings: DataFrame, column: str, words: str, parting: str, known: DataFrame) -> tuple[list[Column], Column]:
    """Aggregates over a column of text lists, and the words of each list."""
    texts = F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda x: x.isNotNull())
    split = lambda x: F.filter(F.split(x, parting), lambda t: t != "")
    full = F.filter(texts, lambda x: x != "")
    total = F.aggregate(full, F.lit(0), lambda s, x: s + F.size(split(x)))
    return [
        F.count_if(F.size(texts) > 0).alias(f"with_{words}"), F.coalesce(F.sum(F.size(texts)), F.lit(0)).alias(f"n_{words}"),
        F.coalesce(F.sum(F.size(texts) - F.size(full)), F.lit(0)).alias(f"empty_{words}"), F.coalesce(F.sum(total), F.lit(0)).alias(f"tokens_{words}"),
        F.coalesce(F.avg(F.when(F.size(full) > 0, total / F.size(full))), F.lit(0.0)).alias(f"mean_tokens_{words}"),
    ], F.flatten(F.transform(full, split))


def _defined(lists: DataFrame, known: DataFrame) -> int:
    """Distinct lists of words of which any has a vector."""
    once = lists.select("words", F.md5(F.array_join("words", "\u241f")).alias("k")).dropDuplicates(["k"])
    return once.select("k", F.explode("words").alias("item")).join(known, "item", "left_semi").agg(F.count_distinct("k")).first()[0]


def meaning_stats(meanings: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of 15 numbers over (ref, glosses, lemmas) and (item) with vectors.

    For lemmas (words parted by ``_``) and for glosses (by white space): meanings that have some, how many,
    empty ones, words, mean words of the full ones (mean over meanings), and distinct word lists of which any word has
    a vector; then meanings, those with either, and distinct lists of both with a vector.
    """
    known = vectors.select("item").distinct()
    lemmas, of_lemmas = _list_stats(meanings, "lemmas", "lemmas", "_", known)
    glosses, of_glosses = _list_stats(meanings, "glosses", "glosses", r"\s+", known)
    some = [F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())) > 0 for c in ("glosses", "lemmas")]
    counts = {f"defined_{n}": _defined(meanings.select(w.alias("words")), known) for n, w in (("lemmas", of_lemmas), ("glosses", of_glosses), ("both", F.concat(of_glosses, of_lemmas)))}
    row = meanings.agg(F.count("*").alias("n_meanings"), *lemmas, *glosses, F.count_if(some[0] | some[1]).alias("with_either"))
    return row.select("*", *[F.lit(n).cast("long").alias(c) for c, n in counts.items()])
