"""Sinks: results in the reference formats, written by the executors in parallel."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.functions.text import first_letter_pos
from glossmill.functions.vectors import as_text


def output_path(path: str, suffix: str, folder: str | None = None) -> str:
    """A path beside the input, or in ``folder``, with another suffix."""
    stem = os.path.splitext(os.path.basename(path))[0]
    return os.path.join(folder or os.path.dirname(path), stem + suffix)


def write_text(df: DataFrame, path: str, column: str = "text", append: bool = False) -> None:
    df.select(F.coalesce(column, F.lit("")).alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """A stage's table written and read again; what the reference serialises."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def vector_text(df: DataFrame, item: str = "item", vec: str = "vec") -> DataFrame:
    """Lines ``item v1 … vn``, six decimals, each id with its own vector."""
    return df.where(F.col(vec).isNotNull()).select(F.concat_ws(" ", F.col(item).cast("string"), as_text(F.col(vec))).alias("text"))


def results_tsv(chosen: DataFrame) -> DataFrame:
    """(first_tok, last_tok, ref) by sentence and span, from (sent_id, l, r, first_tok, last_tok, ref)."""
    return chosen.orderBy("sent_id", "l", "r").select("first_tok", "last_tok", "ref")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def write_frequencies_json(n_docs: int, form_meanings: DataFrame, meanings: DataFrame, path: str) -> None:
    """A frequency file: one object of ``docs``, ``mentions`` (form to pairs of meaning and count) and ``meanings`` (meaning to count).

    The format is one object in one file, so one task writes it, of members that all executors make;
    ``readers.frequencies_json`` reads it.
    """
    spark = meanings.sparkSession
    forms = form_meanings.groupBy(F.col("form").alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("ref").cast("string").alias("ref"), "n"))).alias("l"))
    pairs = forms.select("key", F.to_json(F.transform("l", lambda x: F.array(x["ref"], x["n"].cast("string")))).alias("value"))
    counts = meanings.select(F.col("ref").cast("string").alias("key"), F.col("n").cast("string").alias("value"))

    def members(df: DataFrame, at: int) -> DataFrame:
        first = df.agg(F.min("key")).first()[0]
        quoted = F.to_json(F.struct(F.col("key").alias("k")))
        name = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
        comma = F.when(F.col("key") == F.lit(first), "").otherwise(",")
        return df.select(F.lit(at).alias("at"), "key", F.concat(comma, name, F.lit(":"), "value").alias("line"))

    marks = spark.createDataFrame([(0, "", f'{{"docs":{n_docs},"mentions":{{'), (2, "", '},"meanings":{'), (4, "", "}}")], "at int, key string, line string")
    lines = members(pairs, 1).unionByName(members(counts, 3)).unionByName(marks)
    lines.repartition(1).sortWithinPartitions("at", "key").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def corpus_xml(tokens: DataFrame) -> DataFrame:
    """Rows (_id, sentence) for ``write.format("xml")``, tags simplified by their first letter."""
    wf = F.struct(F.col("tok_id").alias("_id"), F.col("lemma").alias("_lemma"), first_letter_pos(F.col("pos")).alias("_pos"), F.col("form").alias("_VALUE"))
    sentences = tokens.groupBy("text_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("i", wf.alias("wf")))).alias("t"))
    return sentences.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "t"))).alias("s")).select(
        F.col("text_id").alias("_id"), F.transform("s", lambda x: F.struct(x["sent_id"].alias("_id"), x["t"]["wf"].alias("wf"))).alias("sentence")
    )


def write_corpus_xml(tokens: DataFrame, path: str) -> None:
    corpus_xml(tokens).write.mode("overwrite").format("xml").option("rowTag", "text").option("rootTag", "corpus").save(path)


def type_counts(types: DataFrame) -> DataFrame:
    return types.groupBy("type").agg(F.count("*").alias("n"))
