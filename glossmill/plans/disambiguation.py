"""Plans: from annotated tokens to ranked meanings and chosen senses."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.context import cut_lineage
from glossmill.functions.text import is_content_word
from glossmill.operators import candidates as C
from glossmill.operators import context as X
from glossmill.operators import ranking as R
from glossmill.operators import spans as S
from glossmill.options import Options


@dataclass
class Inputs:
    """Tables of a run: tokens(doc_id, sent_id, i, form, lemma, pos), dictionary(lemma, sense_rank,
    ref), meanings(ref, vec), word vectors(item, vec)."""

    tokens: DataFrame
    dictionary: DataFrame
    meanings: DataFrame
    vectors: DataFrame
    dims: int = 64


def mentions(inputs: Inputs, options: Options) -> DataFrame:
    found = S.mentions(inputs.tokens, options.max_span, options.excluded_pos or ("X",))
    kept = found.where(is_content_word(F.col("form")))
    return kept.withColumn("mention_id", F.format_string("%s_%03d-%03d", "sent_id", "l", "r"))


def weighted_candidates(inputs: Inputs, options: Options, found: DataFrame | None = None) -> DataFrame:
    """Candidates of all mentions, or of those ``found``, with their context weight ``w``, filtered to the top ones."""
    cands = cut_lineage(C.lookup(mentions(inputs, options) if found is None else found, inputs.dictionary))
    contexts = X.mean_vectors(X.context_tokens(inputs.tokens, options.min_context_freq), inputs.vectors, ["doc_id"], inputs.dims)
    weights = X.context_weights(cands, contexts, inputs.meanings)
    return C.top_candidates(cands.join(weights, ["doc_id", "ref"]), options.num_first_meanings, options.context_threshold)


def ranked_candidates(inputs: Inputs, options: Options = Options(), found: DataFrame | None = None) -> DataFrame:
    """(doc_id, mention_id, ref, ord, w, weight): the rank of each candidate's meaning as weight."""
    top = cut_lineage(weighted_candidates(inputs, options, found))
    weights = top.select("doc_id", "ref", "w").distinct()
    ranks = R.rank_meanings(R.ranking_input(top, weights, inputs.meanings), options, large=R.large_documents(top))
    return R.write_ranks(top, ranks)


def disambiguate(inputs: Inputs, options: Options = Options()) -> DataFrame:
    """One sense a mention: the highest ranked, the first sense where none is ranked."""
    return C.choose_ranked_or_first(ranked_candidates(inputs, options), "weight")


def sweep_similarity(inputs: Inputs, options: Options, thresholds: list[float], found: DataFrame | None = None) -> DataFrame:
    """Chosen senses for each similarity threshold, ranked anew each time; a few thresholds, one plan each.

    The threshold only enters the ranking, so the candidates and what it reads are written once for all.
    """
    top = cut_lineage(weighted_candidates(inputs, options, found))
    rows = cut_lineage(R.ranking_input(top, top.select("doc_id", "ref", "w").distinct(), inputs.meanings))
    out, large = None, R.large_documents(rows)
    for t in thresholds:
        ranks = R.rank_meanings(rows, replace(options, sim_threshold=t), large=large)
        one = C.choose_ranked_or_first(R.write_ranks(top, ranks), "weight").withColumn("threshold", F.lit(float(t)))
        out = one if out is None else out.unionByName(one)
    return out
