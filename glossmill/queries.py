"""Queries of the core operators, by name; each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.context import cut_lineage, table
from glossmill.functions import text as T
from glossmill.functions import vectors as V
from glossmill.operators import aggregates as A
from glossmill.operators import candidates as C
from glossmill.operators import context as X
from glossmill.operators import evaluation as E
from glossmill.operators import graph as G
from glossmill.operators import optimise as O
from glossmill.operators import ranking as R
from glossmill.operators import rejects, shredding
from glossmill.operators import spans as S
from glossmill.options import Options
from glossmill.plans import documents as D
from glossmill.plans import fixtures as X0
from glossmill.plans import summary
from glossmill.sources import amr, readers, sinks
from glossmill.sql import SQL  # noqa: F401  (the other side of these queries)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Threshold of the ranking queries: the stand-in vectors are never as alike as real ones.
THRESHOLD = 0.25
OPTIONS = Options(sim_threshold=THRESHOLD)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rv(c: str) -> Column:
    return F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0))


# --- rejected and nested input ------------------------------------------------------------------


@query
def p2_found(spark, d):
    return rejects.rejected_lines(table(spark, d, "vector_lines"), table(spark, d, "vector_files"))


@query
def p2_loaded(spark, d):
    return rejects.loaded_lines(table(spark, d, "vector_lines"), table(spark, d, "vector_files"))


@query
def p4_found(spark, d):
    return shredding.shred_batches(table(spark, d, "corpus_batches")).select("batch_id", "text_no", "sentence_no", "token_no")


@query
def p4_tokens(spark, d):
    return shredding.record_tables(shredding.shred_batches(table(spark, d, "corpus_batches")))["tokens"]


# --- text and filters -----------------------------------------------------------------------------


@query
def token_counts(spark, d):
    t = T.gloss_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query
def truncated_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.truncate_words(F.col("text"), 10).alias("head"))


@query
def paragraph_counts(spark, d):
    return readers.paragraphs(table(spark, d, "documents").where("text is not null")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query
def function_word_share(spark, d):
    t = X0.tokens(spark, d)
    langs = table(spark, d, "texts").select(F.col("text_id").alias("doc_id"), "lang").distinct()
    share = F.avg(T.is_content_word(F.col("form")).cast("double"))
    return t.join(langs, "doc_id").groupBy("lang").agg(r6(share).alias("content_share"), F.count("*").alias("n"))


@query
def pos_counts(spark, d):
    return A.pos_counts(X0.tokens(spark, d))


@query
def simple_tags(spark, d):
    tag = F.element_at(F.array(*[F.lit(x) for x in ("NN", "NNS", "VB", "VBD", "JJ", "RB", "CD", "DT")]), (T.hash28(F.col("form")) % 8 + 1).cast("int"))
    return X0.tokens(spark, d).select(tag.alias("tag")).groupBy(T.simple_pos(F.col("tag")).alias("simple"), T.first_letter_pos(F.col("tag")).alias("letter")).agg(F.count("*").alias("n"))


@query
def context_tokens(spark, d):
    return X.context_tokens(X0.tokens(spark, d), 2).select("doc_id", "form", "n")


# --- spans -----------------------------------------------------------------------------------------


@query
def ngram_mentions(spark, d):
    return X0.spans(spark, d)


@query
def study_mentions(spark, d):
    return S.mentions(X0.tokens(spark, d), 5, excluded=(), no_punctuation=True)


@query
def mentions_without_last(spark, d):
    return S.mentions(X0.tokens(spark, d), 3, skip_last=1).select("doc_id", "sent_id", "l", "r", "pos")


@query
def contained_spans(spark, d):
    return S.contained_spans(X0.spans(spark, d))


@query
def maximal_spans(spark, d):
    return S.maximal_spans(X0.weighted_spans(spark, d))


# --- candidates -------------------------------------------------------------------------------------


@query
def candidate_lookup(spark, d):
    return X0.candidates(spark, d)


@query
def candidate_lookup_unordered(spark, d):
    w = X0.words(spark, d)
    keys = w.select("lemma").unionByName(w.select(F.col("form").alias("lemma")))
    return C.lookup_unordered(w, X0.dictionary(spark, d, keys))


@query
def same_mention_meanings(spark, d):
    s = C.same_mentions(X0.candidates(spark, d))
    return s.select("doc_id", F.array_join("ms", ",").alias("ms"), F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))


@query
def overlapping_meanings(spark, d):
    return C.overlapping(X0.candidates(spark, d))


@query
def top_candidates(spark, d):
    c = X0.candidates(spark, d)
    return C.top_candidates(c.join(X0.weights(spark, d, c), ["doc_id", "ref"]), 1, 0.55).select("doc_id", "mention_id", "ref", "ord")


def _weighted(spark, d):
    c = X0.candidates(spark, d)
    return c.join(X0.weights(spark, d, c), ["doc_id", "ref"])


@query
def choose_first(spark, d):
    return C.choose_first(X0.candidates(spark, d)).select("doc_id", "mention_id", "ref")


@query
def choose_random(spark, d):
    return C.choose_random(X0.candidates(spark, d)).select("doc_id", "mention_id", "ref")


@query
def choose_context(spark, d):
    return C.choose_top(_weighted(spark, d), "w").select("doc_id", "mention_id", "ref")


@query
def choose_context_or_first(spark, d):
    return C.choose_top_or_first(_weighted(spark, d), "w", 0.55).select("doc_id", "mention_id", "ref")


@query
def choose_ranked_or_first(spark, d):
    return C.choose_ranked_or_first(_weighted(spark, d).withColumn("rank", F.when(F.col("w") >= 0.55, F.col("w"))), "rank").select("doc_id", "mention_id", "ref")


@query
def choose_ranked(spark, d):
    return C.choose_ranked(_weighted(spark, d).withColumn("rank", F.when(F.col("w") >= 0.55, F.col("w")).otherwise(0.0)), "rank").select("doc_id", "mention_id", "ref")


# --- vectors ---------------------------------------------------------------------------------------


def _queries_against_all(spark, d, block: int = 256):
    """Every embedding whose id is divisible by 50 against all: the query set in blocks, each met by an equi-join."""
    v = X0.meanings(spark, d).select("ref", "vec")
    q = v.where("ref % 50 = 0")
    blocks = max(1, -(-q.count() // block))
    grouped = q.groupBy(F.pmod(F.xxhash64("ref"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct(F.col("ref").alias("a"), F.col("vec").alias("va"))).alias("qs"))
    rows = v.select(F.col("ref").alias("b"), F.col("vec").alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    pairs = rows.join(grouped, "block").select("b", "vb", F.inline("qs")).where("a <> b")
    return pairs.select("a", "b", V.item_similarity(F.col("a"), F.col("b"), F.col("va"), F.col("vb")).alias("c"))


@query
def cosine_pairs(spark, d):
    return _queries_against_all(spark, d).select("a", "b", r6("c").alias("c")).where("c >= 0.2")


@query
def top_neighbours(spark, d):
    w = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    return _queries_against_all(spark, d).select("a", "b", r6("c").alias("c")).withColumn("k", F.row_number().over(w)).where("k <= 5")


@query
def bow_vectors(spark, d):
    return X0.context(spark, d).select("doc_id", rv("vec").alias("vec"))


@query
def gloss_vectors(spark, d):
    g = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("ref"), F.col("text").alias("gloss"))
    items = g.select(F.explode(T.gloss_tokens(F.col("gloss"))).alias("item"))
    return X.gloss_vectors(g, X0.word_vectors(spark, d, items), X0.DIMS).select("ref", rv("vec").alias("vec"))


@query
def sif_vectors(spark, d):
    t = X.context_tokens(X0.tokens(spark, d), 2)
    return X.sif_vectors(t, X0.word_vectors(spark, d, t.select(F.col("form").alias("item"))), ["doc_id"], X0.DIMS).select("doc_id", rv("vec").alias("vec"))


@query
def context_weights(spark, d):
    return X0.weights(spark, d, X0.candidates(spark, d)).select("doc_id", "ref", r6("w").alias("w"))


@query
def file_vectors(spark, d):
    v = readers.text_vectors(table(spark, d, "vector_lines"), table(spark, d, "vector_files"))
    return v.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # no negative zeros


@query
def file_vector_lines(spark, d):
    v = file_vectors(spark, d)
    return sinks.vector_text(v.withColumn("key", F.concat_ws("/", F.col("file_id").cast("string"), "item")), "key")


@query
def fallback_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.when(F.col("vec_id") == 7, "UNK").when(F.col("vec_id") == 9, "<unk>").otherwise(F.concat(F.lit("w"), F.col("vec_id"))).alias("item"), F.col("embedding").cast("array<double>").alias("vec"))
    wanted = table(spark, d, "text_vectors").select(F.concat(F.lit("w"), F.col("vec_id")).alias("item"))
    return X.with_fallback(wanted, v).select("item", rv("vec").alias("vec"))


@query
def inverse_weights(spark, d):
    w = table(spark, d, "texts").select(F.explode("weighter").alias("item", "w")).groupBy("item").agg(F.max("w").alias("w"))
    return X.inverse_weights(X0.tokens(spark, d).select(F.col("lemma").alias("item")), w).select("item", r6("w").alias("w"))


# --- matrices and ranks ------------------------------------------------------------------------------


def _ranking_rows(spark, d):
    c = X0.candidates(spark, d)
    return R.ranking_input(c, X0.weights(spark, d, c), X0.meanings(spark, d))


def _ranked(spark, d, options=OPTIONS, **stop):
    """Ranks of the meanings of every document; the count of candidates tells which documents are split."""
    c = X0.candidates(spark, d)
    return R.rank_meanings(R.ranking_input(c, X0.weights(spark, d, c), X0.meanings(spark, d)), options, large=R.large_documents(c), **stop)


def _stage(stage: str) -> Query:
    def f(spark, d):
        return R.similarity_entries(_ranking_rows(spark, d), THRESHOLD, stage).select("doc_id", "a", "b", r6("value").alias("value"))

    f.__name__ = f"sim_matrix_{stage}"
    return query(f)


sim_matrix_thresholded, sim_matrix_filled, sim_matrix_normalised = map(_stage, ("thresholded", "filled", "normalised"))


@query
def bias_vector(spark, d):
    return R.meanings_bias(_ranking_rows(spark, d)).select("doc_id", "ref", r6("l").alias("l"))


@query
def vertex_bias(spark, d):
    return R.vertex_bias(X0.vertices(spark, d)).select("doc_id", "v", r6("t").alias("t"))


@query
def type_vector(spark, d):
    w = X0.words(spark, d).withColumn("mention_type", F.element_at(F.array(*[F.lit(x) for x in ("Location", "Person", "")]), (T.hash28(F.col("form")) % 3 + 1).cast("int")))
    c = X0.candidates(spark, d).join(w.select("mention_id", "mention_type"), "mention_id").join(X0.meanings(spark, d).select("ref", "type"), "ref")
    one = c.groupBy("doc_id", "ref").agg(F.max("mention_type").alias("mention_type"), F.max("type").alias("type"))
    return R.type_vector(one, smooth=True, normalise=True).select("doc_id", "ref", r6("t").alias("t"))


@query
def power_iteration_3(spark, d):
    return _ranked(spark, d, steps=3, epsilon=0.0).select("doc_id", "ref", r6("rank").alias("rank"))


@query
def power_iteration_3_aw(spark, d):
    return _ranked(spark, d, Options(sim_threshold=THRESHOLD, personalised=False), steps=3, epsilon=0.0).select("doc_id", "ref", r6("rank").alias("rank"))


@query
def rank_meanings(spark, d):
    """Flagship: the meanings of every document, ranked."""
    return E.rank_list(_ranked(spark, d)).select("doc_id", "ref", r6("rank").alias("rank"), "k")


def _mention_inputs(spark, d, t=None):
    from glossmill.plans.disambiguation import Inputs

    t = X0.tokens(spark, d) if t is None else t
    found = S.mentions(t, 2, ("X",))
    keys = found.select("lemma").unionByName(found.select(F.col("form").alias("lemma")))
    items = t.select(F.col("form").alias("item"))
    return Inputs(t, X0.dictionary(spark, d, keys), X0.meanings(spark, d), X0.word_vectors(spark, d, items))


MENTION_OPTIONS = Options(sim_threshold=THRESHOLD, max_span=2, excluded_pos=("X",), min_context_freq=2, context_threshold=0.6)


def _by_document(spark, d):
    """Records of the documents that a task holds whole, the senses for them, and the tokens of all other documents or None.

    No records if there are too many meanings for a task.
    """
    senses, rows = X0.senses(spark, d), X0.token_rows(spark, d)
    if senses is None:
        return None, None, X0.once(rows)
    apart = D.documents_apart(rows)
    return D.packed(rows, apart), senses, None if apart is None else cut_lineage(X0.once(rows.join(apart, "doc_id", "left_semi")))


@query
def disambiguated_mentions(spark, d):
    from glossmill.plans.disambiguation import disambiguate

    records, senses, rest = _by_document(spark, d)
    out = [] if records is None else [D.disambiguate(records, senses, MENTION_OPTIONS)]
    if rest is not None:
        out.append(disambiguate(_mention_inputs(spark, d, rest), MENTION_OPTIONS).select("doc_id", "mention_id", "ref"))
    return reduce(DataFrame.unionByName, out)


@query
def adjacency(spark, d):
    return R.adjacency(X0.edges(spark, d)).select("doc_id", "a", "b", r6("value").alias("value"))


@query
def rank_vertices_3(spark, d):
    e = cut_lineage(X0.edges(spark, d))
    return R.rank_vertices(X0.vertices_of(e), e, Options(), steps=3, epsilon=0.0).select("doc_id", "v", r6("rank").alias("rank"))


@query
def rank_vertices(spark, d):
    e = cut_lineage(X0.edges(spark, d))
    v = X0.vertices_of(e)
    return R.rank_vertices(v, e, large=R.large_documents(e)).select("doc_id", "v", r6("rank").alias("rank"))


# --- counts and weights -------------------------------------------------------------------------------


def _annotations(spark, d):
    w = X0.words(spark, d)
    n = X0.n_refs(spark, d)
    return w.select("doc_id", "form", F.pmod(T.hash28(F.col("lemma")), F.lit(n)).alias("ref"))


@query
def number_of_forms(spark, d):
    return A.number_of_forms(_annotations(spark, d)).select("ref", r6("w").alias("w"))


@query
def tf_idf(spark, d):
    return A.tf_idf(_annotations(spark, d)).select("doc_id", "ref", r6("w").alias("w"))


@query
def tf_idf_aw(spark, d):
    return A.tf_idf(_annotations(spark, d), as_written=True).select("doc_id", "ref", r6("w").alias("w"))


@query
def form_meaning_prior(spark, d):
    return A.prior(_annotations(spark, d)).select("form", "ref", r6("p").alias("p"))


@query
def meaning_frequencies(spark, d):
    return A.frequencies(_annotations(spark, d))["meanings"]


@query
def form_frequencies(spark, d):
    return A.frequencies(_annotations(spark, d))["forms"]


@query
def annotation_counts(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return readers.annotations(docs, r"\(([a-z]+[0-9]*) / ([^\s()]+)").groupBy("form").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query
def coverage(spark, d):
    m = X0.spans(spark, d).withColumn("mention_id", F.format_string("%s_%03d-%03d", "sent_id", "l", "r"))
    c = m.select("doc_id", "mention_id", F.explode(F.sequence(F.lit(0), T.hash28(F.col("lemma")) % 3)).alias("k"))
    return A.coverage(X0.tokens(spark, d), m, c).select("doc_id", "n_tokens", "covered", "covered_by_multiword", r6(F.col("polysemy") + 1e-9).alias("polysemy"))  # off the ties of rounding, which sums reach in any order


@query
def similarity_stats(spark, d):
    rows = _ranking_rows(spark, d)
    s = A.similarity_stats(R.similarity_entries(rows, THRESHOLD), rows)
    return s.select("doc_id", "n_meanings", "n_pairs", "n_similar", r6("mean").alias("mean"))


@query
def similarity_pairs(spark, d):
    return A.pair_counts(_ranking_rows(spark, d), THRESHOLD)


@query
def text_statistics(spark, d):
    s = A.describe(table(spark, d, "documents"), F.col("n_chars").cast("double"), ["source"])
    return s.select("source", "n", *[r6(c).alias(c) for c in ("least", "most", "mean", "median", "deviation")])


@query
def entity_counts(spark, d):
    s = X0.spans(spark, d).withColumn("ner", F.element_at(F.array(*[F.lit(x) for x in ("LOC", "PER", "", "")]), (T.hash28(F.col("form")) % 4 + 1).cast("int")))
    return A.entity_stats(s)


@query
def meaning_statistics(spark, d):
    g = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("ref"), F.array("text").alias("glosses"), F.array("source").alias("lemmas"))
    v = X0.tokens(spark, d).select(F.col("form").alias("item")).distinct()
    return A.meaning_stats(g, v).withColumns({c: r6(c) for c in ("mean_tokens_lemmas", "mean_tokens_glosses")})


@query
def limited_meanings(spark, d):
    m = table(spark, d, "documents").select(F.col("doc_id").alias("ref"), F.array_compact(F.array(F.nullif("text", F.lit("")))).alias("glosses"), F.array_compact(F.array("source")).alias("lemmas"))
    return A.described_meanings(m, 50).select("ref")


@query
def mention_weights(spark, d):
    return A.most_weight(X0.words(spark, d), _weighted(spark, d).withColumnRenamed("w", "weight")).select("doc_id", "mention_id", r6("w").alias("w"))


@query
def meaning_average(spark, d):
    c = X0.candidates(spark, d).withColumn("weight", (T.hash28(F.concat_ws("_", "mention_id", F.col("ref").cast("string"))) % 100) / 100)
    return A.average_weight(c).select("doc_id", "ref", r6("weight").alias("weight"))


@query
def windowed_terms(spark, d):
    from glossmill.streaming.ingest import windowed_terms as w

    return w(table(spark, d, "tokens")).select(F.col("window.start").alias("start"), "term", "n")


# --- evaluation and optimisation ------------------------------------------------------------------------


@query
def wsd_scores(spark, d):
    s = _scores_system(spark, d)
    return E.precision_recall(s, X0.gold(spark, d)).select(*[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def system_scores(spark, d):
    """Scores of the first sense and of the ranked choice, over all of their answers."""
    from glossmill.plans.disambiguation import disambiguate

    records, senses, rest = _by_document(spark, d)
    name = F.when(F.col("place") < 0, "first").otherwise("ranked").alias("system")
    out = [] if records is None else [D.scored(records, senses, MENTION_OPTIONS, [THRESHOLD], X0.gold_of, with_first=True).select(name, "s", "n", "g")]
    if rest is not None:
        gold = cut_lineage(X0.gold(spark, d, rest))
        ranked = disambiguate(_mention_inputs(spark, d, rest), MENTION_OPTIONS)
        for system, chosen in (("first", C.choose_first(X0.candidates(spark, d, rest))), ("ranked", ranked)):
            out.append(E.answer_sums(chosen.select(F.col("mention_id").alias("key"), "ref"), gold).select(F.lit(system).alias("system"), "s", "n", "g"))
    return _scores(spark, out, "system", ["first", "ranked"])


def _scores(spark, sums, by, every):
    """Scores of the documents of all ``sums(by, s, n, g)`` together; nulls for one of ``every`` that has no documents."""
    none = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in every])).alias(by), *[F.lit(0).alias(c) for c in ("s", "n", "g")])
    total = reduce(DataFrame.unionByName, sums, none).groupBy(by).agg(*[F.sum(c).alias(c) for c in ("s", "n", "g")])
    return E.scores(total, by).select(by, *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def _scores_system(spark, d):
    return C.choose_first(X0.candidates(spark, d)).select(F.col("mention_id").alias("key"), "ref")


@query
def mean_average_precision(spark, d):
    ranking = E.rank_list(X0.weights(spark, d, X0.candidates(spark, d)).withColumnRenamed("w", "rank"))
    g = X0.words(spark, d).select(F.col("mention_id").alias("key"), "doc_id").join(X0.gold(spark, d), "key").select("doc_id", F.explode("refs").alias("ref"))
    return E.mean_average_precision(ranking, g).select(r6("map").alias("map"), "n_docs")


@query
def similarity_sweep(spark, d):
    """E3: all mentions ranked and scored anew for each of 11 similarity thresholds."""
    from glossmill.plans.disambiguation import sweep_similarity

    levels = [k / 10 for k in range(11)]
    records, senses, rest = _by_document(spark, d)
    out = []
    if records is not None:
        sums = D.scored(records, senses, MENTION_OPTIONS, levels, X0.gold_of).where("place >= 0")
        out.append(sums.select(F.element_at(F.array(*[F.lit(t) for t in levels]), F.col("place") + 1).alias("threshold"), "s", "n", "g"))
    if rest is not None:
        chosen = cut_lineage(sweep_similarity(_mention_inputs(spark, d, rest), MENTION_OPTIONS, levels).select("threshold", F.col("mention_id").alias("key"), "ref"))
        gold = cut_lineage(X0.gold(spark, d, rest))
        for t in levels:
            out.append(E.answer_sums(chosen.where(F.col("threshold") == t), gold).select(F.lit(t).alias("threshold"), "s", "n", "g"))
    return _scores(spark, out, "threshold", levels)


@query
def threshold_sweep(spark, d):
    """Cut-off of the context weight at 11 levels; nothing is ranked anew (that is similarity_sweep)."""
    c = _weighted(spark, d).select(F.col("mention_id").alias("key"), "ref", "ord", F.col("w").alias("weight"))
    return E.sweep(c, X0.gold(spark, d), "weight", [k / 10 for k in range(11)]).select(r6("threshold").alias("threshold"), r6("precision").alias("precision"), r6("recall").alias("recall"))


@query
def candidate_report(spark, d):
    c = _weighted(spark, d).select(F.col("mention_id").alias("key"), "ref", F.when(F.col("w") >= 0.55, F.col("w")).otherwise(0.0).alias("weight"))
    r = E.report(c, X0.gold(spark, d), _scores_system(spark, d))
    return r.groupBy("mark").agg(F.count("*").alias("n"))


@query
def top_ranks(spark, d):
    return E.top_ranks(X0.weights(spark, d, X0.candidates(spark, d)).withColumnRenamed("w", "rank")).select("doc_id", "ref", r6("rank").alias("rank"))


@query
def chosen_lines(spark, d):
    """Results as lines: first and last token and the chosen sense of each mention."""
    w = X0.words(spark, d).select("sent_id", F.col("i").alias("l"), (F.col("i") + 1).alias("r"), "mention_id")
    chosen = C.choose_first(X0.candidates(spark, d)).join(w, "mention_id")
    token = F.format_string("%s.t%03d", "sent_id", F.col("l") + 1)
    return sinks.results_tsv(chosen.withColumns({"first_tok": token, "last_tok": token}))


@query
def candidate_priors(spark, d):
    c = X0.candidates(spark, d).join(X0.words(spark, d).select("mention_id", "form"), "mention_id")
    return A.with_prior(c, A.prior(_annotations(spark, d))).select("doc_id", "mention_id", "ref", r6("p").alias("p"))


@query
def reset_candidates(spark, d):
    return C.reset_weights(_weighted(spark, d).withColumnRenamed("w", "weight")).select("doc_id", "mention_id", "ref", "weight")


@query
def type_counts(spark, d):
    return sinks.type_counts(X0.meanings(spark, d))


@query
def vector_items(spark, d):
    return readers.item_keys(file_vectors(spark, d))


@query
def random_vectors(spark, d):
    items = X0.tokens(spark, d).select(F.col("lemma").alias("item")).distinct()
    return items.select("item", V.random_vector(F.col("item"), 8).alias("vec")).select("item", rv("vec").alias("vec"))


@query
def tagset_counts(spark, d):
    """Tags of several tagsets, as read with the tagset of each text's language."""
    langs = table(spark, d, "texts").select(F.col("text_id").alias("doc_id"), "lang").distinct()
    tag = F.element_at(F.array(*[F.lit(x) for x in ("NNS", "VVFIN", "ADJA", "n0", "vmip", "Noun", "ADV", "RBR")]), (T.hash28(F.col("form")) % 8 + 1).cast("int"))
    t = X0.tokens(spark, d).join(langs, "doc_id").withColumn("tag", tag)
    simple = F.lit("X")
    for lang in readers.TAGSETS:
        simple = F.when(F.col("lang") == lang, readers.dictionary_pos(F.col("tag"), lang)).otherwise(simple)
    return t.groupBy("lang", "tag", simple.alias("simple")).agg(F.count("*").alias("n"))


@query
def plain_tokens(spark, d):
    t = readers.plain_documents(table(spark, d, "documents").where("text is not null"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("sent_id").alias("n_sentences"), F.max("tok_id").alias("last"))


@query
def ngram_spans(spark, d):
    return S.ngrams(X0.tokens(spark, d), 3)


@query
def mention_softmax(spark, d):
    return O.mention_softmax(_weighted(spark, d), "w").select("doc_id", "mention_id", "ref", r6("p").alias("p"))


def _distributed(spark, d):
    return O.mention_softmax(_weighted(spark, d), "w").join(X0.meanings(spark, d), "ref")


@query
def salience_values(spark, d):
    return O.salience_value(_distributed(spark, d).withColumn("relevance", F.col("w"))).select("doc_id", r6("value").alias("value"))


@query
def type_values(spark, d):
    return O.type_value(_distributed(spark, d).withColumn("mention_type", F.lit("Location"))).select("doc_id", r6("value").alias("value"))


@query
def coherence_values(spark, d):
    return O.coherence_values(_distributed(spark, d), THRESHOLD).select("doc_id", r6("value").alias("value"))


@query
def optimised_candidates(spark, d):
    c = _distributed(spark, d).withColumns({"score": F.col("w"), "relevance": F.col("w")})
    return O.optimise_candidates(c, THRESHOLD).select("doc_id", "mention_id", "ref", r6("p").alias("p"))


# --- graphs -----------------------------------------------------------------------------------------------


@query
def contracted_edges(spark, d):
    e = cut_lineage(X0.edges(spark, d))
    v = X0.vertices_of(e)
    into = F.min("v").over(Window.partitionBy("doc_id", F.col("v") % 7))
    return G.contract(e, v.select("doc_id", "v", into.alias("into")).where("v <> into"))


@query
def components(spark, d):
    e = cut_lineage(X0.edges(spark, d))
    return G.components(X0.vertices_of(e), e)


@query
def predicate_edges(spark, d):
    """Edges from each vertex to the lighter ones of its document that share its remainder by 50."""
    v = X0.vertices(spark, d).withColumn("part", F.col("v") % 50)
    return G.edges_where(v, ["doc_id", "part"], F.col("a.w") > F.col("b.w"), F.lit("over"))


@query
def vertex_depths(spark, d):
    """Depth of what each document's least vertex reaches by rising edges."""
    e = cut_lineage(X0.edges(spark, d).where("src < dst"))
    return G.depths(X0.vertices_of(e).groupBy("doc_id").agg(F.min("v").alias("v")), e)


@query
def dependency_edges(spark, d):
    """Graph of the tokens, each the governor of the next one of its sentence, with confidences."""
    t = X0.tokens(spark, d)
    deps = t.select("doc_id", "sent_id", F.col("i").alias("governor"), F.lead("i").over(Window.partitionBy("doc_id", "sent_id").orderBy("i")).alias("dependent"), F.col("pos").alias("role")).where("dependent is not null")
    vs, es = G.dependency_graph(t.withColumn("confidence", F.when(F.col("pos") == "N", 0.5)), deps)
    return es.join(vs.withColumnRenamed("v", "src"), ["doc_id", "src"]).select("doc_id", "src", "dst", "role", "w")


@query
def rank_mentions(spark, d):
    """Mentions ranked along the order of their sentence, by their mean candidate weight."""
    weights = X0.words(spark, d).select("doc_id", "mention_id").join(_weighted(spark, d).withColumnRenamed("w", "weight").select("doc_id", "mention_id", "weight"), ["doc_id", "mention_id"])
    follow = F.lead("mention_id").over(Window.partitionBy("doc_id", "sent_id").orderBy("i"))
    edges = X0.words(spark, d).select("doc_id", F.col("mention_id").alias("src"), follow.alias("dst")).where("dst is not null")
    return R.rank_mentions(weights, edges).select("doc_id", "mention_id", r6("rank").alias("rank"))


@query
def subgraph_weights(spark, d):
    v = X0.vertices(spark, d)
    return A.non_zero_average(v.select("doc_id", (F.col("v") % 7).alias("sg_id"), "w")).select("doc_id", "sg_id", r6("w").alias("w"))


@query
def vertex_candidates(spark, d):
    w = _weighted(spark, d).join(X0.words(spark, d).select("mention_id", "sent_id"), "mention_id")
    c = w.select("doc_id", F.col("sent_id").alias("v"), "mention_id", "ref", r6("w").alias("weight"), (F.col("ref") % 2 == 0).alias("multiword"))
    return G.disambiguate(c).select("doc_id", "v", "mention_id", "ref")


@query
def role_edges(spark, d):
    e = X0.edges(spark, d).withColumn("role", F.when(F.col("role") == "mod", ":mod").when(F.col("role") == "loc", ":location").otherwise(F.concat(F.lit(":ARG"), F.substring("role", 2, 1))))
    return G.with_rules(e).groupBy("role", "core", "needs").agg(F.count("*").alias("n"))


@query
def merged_entities(spark, d):
    e = cut_lineage(X0.edges(spark, d))
    w = X0.vertices_of(e)
    known = w.join(X0.meanings(spark, d).select(F.col("ref").alias("v"), "is_ne", "type"), "v")
    chains = known.select("doc_id", F.concat_ws("_", "type", (F.col("v") % 7).cast("string")).alias("group_id"), "v")
    return G.merge_graphs(e, w, chains, known.where("is_ne").select("doc_id", F.col("type").alias("group_id"), "v"))[0]


@query
def amr_edges(spark, d):
    return amr.graph_tables(amr.read_banks(table(spark, d, "documents")))["edges"]


@query
def amr_alignments(spark, d):
    return amr.graph_tables(amr.read_banks(table(spark, d, "documents")))["alignments"]


@query
def amr_span_tops(spark, d):
    return amr.span_tops(amr.read_banks(table(spark, d, "documents")))


def _plans(spark, d, **kwargs):
    return summary.plan_banks(table(spark, d, "documents"), X0.bank_senses(spark, d), X0.coreference, OPTIONS, **kwargs)


@query
def amr_mentions(spark, d):
    graphs = amr.read_banks(table(spark, d, "documents"))
    concepts = G.without_concepts(G.prefixed(amr.graph_tables(graphs)["edges"]))[1]
    return summary.bank_mentions(graphs, concepts)


@query
def extracted_subgraphs(spark, d):
    return _plans(spark, d, stage="extract").select("doc_id", "place", "root", r6("value").alias("value"), F.array_join("vertices", ",").alias("vertices"))


@query
def distinct_subgraphs(spark, d):
    return _plans(spark, d, keep=3, stage="dedup").select("doc_id", "place", "root", r6("weight").alias("weight"))


@query
def ordered_plans(spark, d):
    return _plans(spark, d, keep=5).select("doc_id", "place", "root", r6("weight").alias("weight"))


@query
def summaries(spark, d):
    return summary.summarise(table(spark, d, "documents"), X0.bank_senses(spark, d), X0.coreference, OPTIONS, keep=5)
