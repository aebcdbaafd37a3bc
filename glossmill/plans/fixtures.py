"""Stand-ins for the dictionary, sense vectors and gold data, built from the tables at hand.

A lemma's senses follow from its hash, a sense's vector is an embedding, a word's vector is the
embedding of its hash. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.context import cut_lineage, table
from glossmill.functions.text import hash28, is_content_word
from glossmill.operators import candidates as C
from glossmill.operators import context as X
from glossmill.operators import spans as S
from glossmill.plans import documents
from glossmill.plans.disambiguation import Inputs
from glossmill.sources.readers import surrogate_dictionary

DIMS = 64
SENSES = 2
#: Roles of the stand-in graph.
ROLES = ("A0", "A1", "mod", "loc")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, sent_id, i, form, lemma, pos): each token once, without nulls.

    A repeated row has the same content, so grouping by all columns counts a token once, by hashing alone.
    """
    return once(token_rows(spark, d))


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    """(tok_id, doc_id, sent_id, i, form, lemma, pos): the rows of tokens as they are, those without id or text left out."""
    rows = table(spark, d, "tokens").where("tok_id is not null and text_id is not null")
    return rows.select("tok_id", F.col("text_id").alias("doc_id"), "sent_id", F.col("tok_idx").alias("i"), F.col("wf").alias("form"), "lemma", "pos")


def once(rows: DataFrame) -> DataFrame:
    """``tokens`` of the rows given."""
    kept = rows.groupBy(*rows.columns).agg(F.lit(1).alias("one"))
    form = F.coalesce("form", F.lit(""))
    return kept.select("doc_id", "sent_id", "i", form.alias("form"), F.coalesce(F.nullif("lemma", F.lit("")), form).alias("lemma"), F.coalesce("pos", F.lit("X")).alias("pos"))


def n_refs(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings").count()


def meanings(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Location", "Organization", "Person", "Other")]), F.col("label") % 4 + 1)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ref"), (F.col("label") < 2).alias("is_ne"), kind.alias("type"), F.col("embedding").cast("array<double>").alias("vec"))


def dictionary(spark: SparkSession, d: str, lemmas: DataFrame, senses: int = SENSES) -> DataFrame:
    return surrogate_dictionary(lemmas, n_refs(spark, d), senses)


def word_vectors(spark: SparkSession, d: str, items: DataFrame) -> DataFrame:
    """(item, vec) of the distinct ``items(item)``."""
    n = n_refs(spark, d)
    keyed = items.select("item").distinct().withColumn("ref", F.pmod(hash28(F.col("item")), F.lit(n)))
    return keyed.join(meanings(spark, d).select("ref", "vec"), "ref").select("item", "vec")


def words(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    """Content words, of all tokens or of ``t``, as mentions of one token: (doc_id, sent_id, i, mention_id, form, lemma, pos)."""
    t = tokens(spark, d) if t is None else t
    kept = t.where(is_content_word(F.col("form")) & (F.col("pos") != "X"))
    return kept.withColumn("mention_id", F.format_string("%s_%03d-%03d", "sent_id", "i", F.col("i") + 1))


def candidates(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    """(doc_id, mention_id, ref, ord) of the content words, of all tokens or of ``t``.

    The words are read four times below, so they are written once to the shared folder, instead of
    reading and counting the tokens once each time; so are the candidates, for the plans above.
    """
    w = cut_lineage(words(spark, d, t).select("doc_id", "mention_id", "form", "lemma"))
    keys = w.select(F.col("lemma")).unionByName(w.select(F.col("form").alias("lemma")))
    return cut_lineage(C.lookup(w, dictionary(spark, d, keys)))


def context(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, vec): mean vector of the document's context words."""
    t = cut_lineage(X.context_tokens(tokens(spark, d), 2).select("doc_id", "form"))
    return X.mean_vectors(t, word_vectors(spark, d, t.select(F.col("form").alias("item"))), ["doc_id"], DIMS)


def weights(spark: SparkSession, d: str, cands: DataFrame) -> DataFrame:
    return X.context_weights(cands, context(spark, d), meanings(spark, d))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, src, dst, role): first senses of consecutive content words of a sentence."""
    n = n_refs(spark, d)
    w = words(spark, d).select("doc_id", "sent_id", "i", F.pmod(hash28(F.col("lemma")), F.lit(n)).alias("src"))
    dst = F.lead("src").over(Window.partitionBy("doc_id", "sent_id").orderBy("i"))
    pairs = w.withColumn("dst", dst).where("dst is not null and src <> dst").select("doc_id", "src", "dst").distinct()
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (hash28(F.concat_ws("_", "src", "dst")) % 4 + 1).cast("int"))
    return pairs.withColumn("role", role)


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, v, w): ends of the edges, weighted by the number of edges they start."""
    return vertices_of(edges(spark, d))


def vertices_of(e: DataFrame) -> DataFrame:
    ends = e.select("doc_id", F.col("src").alias("v"), F.lit(1.0).alias("w")).unionByName(e.select("doc_id", F.col("dst").alias("v"), F.lit(0.0).alias("w")))
    return ends.groupBy("doc_id", "v").agg(F.sum("w").alias("w"))


def spans(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, sent_id, l, r, form, lemma, pos) of up to three tokens."""
    return S.mentions(tokens(spark, d), 3)


def weighted_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).select("doc_id", "sent_id", "l", "r", (hash28(F.col("form")) % 1000).alias("w"))


def gold(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    """(key, refs): a sense of each content word by hash, the key being the mention; of all tokens or of ``t``."""
    n = n_refs(spark, d)
    w = words(spark, d, t)
    k = hash28(F.concat("form", F.lit("g"))) % SENSES
    return w.select(F.col("mention_id").alias("key"), F.array(F.pmod(hash28(F.col("lemma")) + 37 * k, F.lit(n))).alias("refs"))


def gold_of(code, n: int, form: str, lemma: str) -> int:
    """``gold`` of one word; ``code`` is the hash of a word."""
    return (code(lemma) + 37 * (code(form + "g") % SENSES)) % n


def senses(spark: SparkSession, d: str) -> documents.Senses | None:
    """``dictionary``, ``meanings`` and ``word_vectors`` as a task holds them; None where there are too many meanings."""
    return documents.senses_of(n_refs(spark, d), meanings(spark, d), SENSES)


def bank_senses(spark: SparkSession, d: str):
    """Dictionary, meanings and word vectors for the tokens and mentions of banks."""

    def senses(words: DataFrame, mentions: DataFrame) -> Inputs:
        keys = mentions.select("lemma").unionByName(mentions.select(F.col("form").alias("lemma")))
        return Inputs(words, dictionary(spark, d, keys), meanings(spark, d), word_vectors(spark, d, words.select(F.col("form").alias("item"))), DIMS)

    return senses


def coreference(mentions: DataFrame) -> DataFrame:
    """(doc_id, group_id, v): vertices other than frames whose first word is the same, case apart, are one chain."""
    first = F.min_by("lemma", F.struct("l", "r"))
    heads = mentions.where("not multiword and not frame").groupBy("doc_id", "v").agg(first.alias("group_id"))
    return heads.select("doc_id", "group_id", "v")
