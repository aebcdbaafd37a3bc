"""Plans: from AMR banks to ordered content plans and their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.context import cut_lineage
from glossmill.functions.text import is_content_word, is_punctuation
from glossmill.operators import graph as G
from glossmill.operators import planning as P
from glossmill.operators import ranking as R
from glossmill.options import Options
from glossmill.plans import disambiguation as D
from glossmill.sources import amr as A

#: From tokens(doc_id, sent_id, i, form, lemma, pos) and mentions(doc_id, v, mention_id, form, lemma, ...) to the tables of a run.
Senses = Callable[[DataFrame, DataFrame], D.Inputs]
#: From mentions(doc_id, graph_id, v, mention_id, l, r, form, lemma, multiword, frame) to chains (doc_id, group_id, v).
Chains = Callable[[DataFrame], DataFrame]
#: Longest multiword mention of a bank.
MAX_SPAN = 5


def bank_mentions(graphs: DataFrame, concepts: DataFrame, max_span: int = MAX_SPAN) -> DataFrame:
    """(doc_id, graph_id, v, mention_id, l, r, form, lemma, multiword, frame) of the vertices of banks.

    A vertex has a mention of one token for each content word aligned to it, and one of several
    tokens for each span it is on top of, if it is no frame and no token of the span is punctuation.
    """
    tables = A.graph_tables(graphs)
    key = ["doc_id", "graph_id"]
    named = F.concat_ws("_", "graph_id", "v").alias("v")
    one = tables["alignments"].join(tables["tokens"], [*key, "i"]).where(is_content_word(F.col("form")))
    one = one.select(*key, named, F.col("i").alias("l"), (F.col("i") + 1).alias("r"), "form", F.lit(False).alias("multiword"))
    inside = F.slice("tokens", F.col("l") + 1, F.col("r") - F.col("l"))
    many = A.span_tops(graphs, max_span).join(graphs.select(*key, "tokens"), key).withColumn("words", inside).where(~F.exists("words", is_punctuation))
    many = many.withColumn("v", F.col("top")).select(*key, named, "l", "r", F.array_join("words", " ").alias("form"), F.lit(True).alias("multiword"))
    frame = F.coalesce(F.col("concept").rlike(r"-\d\d$"), F.lit(False))
    found = one.unionByName(many).join(concepts, ["doc_id", "v"], "left").withColumn("frame", frame).where("not (multiword and frame)").drop("concept")
    return found.withColumns({"mention_id": F.format_string("%s_%03d-%03d", "graph_id", "l", "r"), "lemma": F.lower("form")}).distinct()


def bank_graphs(documents: DataFrame, id_column: str = "doc_id", senses: Senses | None = None, coref: Chains | None = None, options: Options = Options()) -> dict[str, DataFrame]:
    """Tables of one global graph a document: vertices (doc_id, v, sources, concept, verb, w, meaning, vec), edges and concepts.

    Names and concepts are removed, each vertex keeps one ranked candidate, multiwords take in the
    vertices they cover, then chains of coreference and vertices of one entity become one vertex.
    Without ``senses`` there are no candidates: vertices weigh 1 and their concept is their meaning;
    without ``coref`` there are no chains.
    """
    graphs = cut_lineage(A.read_banks(documents, id_column=id_column).withColumnRenamed(id_column, "doc_id"))
    tables = A.graph_tables(graphs)
    edges = G.without_names(G.prefixed(tables["edges"]).where("role is not null"))
    edges, concepts = G.without_concepts(edges)
    edges, concepts = cut_lineage(edges), cut_lineage(concepts)
    ends = edges.select("doc_id", "graph_id", F.explode(F.array("src", "dst")).alias("v")).unionByName(tables["roots"].select("doc_id", "graph_id", F.concat_ws("_", "graph_id", "root").alias("v")))
    sources = ends.select("doc_id", "v", F.col("graph_id").alias("value")).distinct()
    live = sources.select("doc_id", "v").distinct()
    edges = G.simple(edges)
    known = live.withColumns({"w": F.lit(1.0), "ref": F.lit(None).cast("string"), "vec": F.lit(None).cast("array<double>")})
    mentions = cut_lineage(bank_mentions(graphs, concepts).join(live, ["doc_id", "v"], "left_semi")) if senses or coref else None
    collapsed = merged = entities = live.select("doc_id", "v", F.col("v").alias("into")).limit(0)
    entities = entities.select("doc_id", F.col("into").alias("group_id"), "v")
    if senses:
        words = tables["tokens"].select("doc_id", F.col("graph_id").alias("sent_id"), "i", "form", F.lower("form").alias("lemma"), F.lit("X").alias("pos"))
        inputs = senses(words, mentions)
        ranked = D.ranked_candidates(inputs, options, mentions.select("doc_id", "mention_id", "form", "lemma").distinct())
        candidates = mentions.select("doc_id", "v", "graph_id", "mention_id", "l", "r", "multiword").join(ranked.select("doc_id", "mention_id", "ref", "weight"), ["doc_id", "mention_id"])
        chosen = cut_lineage(G.disambiguate(candidates))
        known = live.join(chosen.select("doc_id", "v", "ref", "weight"), ["doc_id", "v"], "left").join(inputs.meanings.select("ref", "vec", "is_ne"), "ref", "left")
        known = cut_lineage(known.select("doc_id", "v", F.coalesce("weight", F.lit(0.0)).alias("w"), F.col("ref").cast("string").alias("ref"), F.col("vec").cast("array<double>").alias("vec"), "is_ne"))
        at = tables["alignments"].select("doc_id", "graph_id", "i", F.concat_ws("_", "graph_id", "v").alias("covered")).join(live.withColumnRenamed("v", "covered"), ["doc_id", "covered"], "left_semi")
        covered = chosen.where("multiword").join(at, ["doc_id", "graph_id"]).where("i >= l and i < r and v <> covered").select("doc_id", "v", "covered").distinct()
        collapsed = cut_lineage(G.collapse_multiwords(covered, known.select("doc_id", "v", "w")))
        entities = known.where("is_ne").select("doc_id", F.col("ref").alias("group_id"), "v").join(collapsed, ["doc_id", "v"], "left_anti")
        edges, sources = G.contract(edges, collapsed), G.contract_values(sources, collapsed)
    if senses or coref:
        none = entities.limit(0)
        chains = G.contract_values(coref(mentions).withColumnRenamed("group_id", "value"), collapsed).withColumnRenamed("value", "group_id") if coref else none
        weights = known.select("doc_id", "v", "w").join(collapsed, ["doc_id", "v"], "left_anti")
        edges, _, merged = G.merge_graphs(edges, weights, chains, entities)
        merged = cut_lineage(merged)
        edges, sources = cut_lineage(edges), G.contract_values(sources, merged)
    gathered = sources.groupBy("doc_id", "v").agg(F.array_sort(F.collect_set("value")).alias("sources"))
    vertices = gathered.join(concepts, ["doc_id", "v"], "left").withColumn("verb", F.coalesce(F.col("concept").rlike(r"-\d\d$"), F.lit(False)))
    vertices = vertices.join(known.select("doc_id", "v", "w", "ref", "vec"), ["doc_id", "v"], "left").withColumn("meaning", F.coalesce("ref", "concept")).drop("ref")
    return {"vertices": vertices, "edges": edges, "concepts": concepts}


def plan_graphs(tables: dict[str, DataFrame], options: Options = Options(), keep: int = 10, stage: str = "order") -> DataFrame:
    """Content plans of global graphs: rank the vertices, extract, drop the redundant, order."""
    vs = cut_lineage(tables["vertices"])
    ranked = R.rank_vertices(vs.select("doc_id", "v", "w"), tables["edges"], options, large=R.large_documents(vs))
    full = vs.drop("w").join(ranked.withColumnRenamed("rank", "w"), ["doc_id", "v"]).select("doc_id", "v", "w", "meaning", "vec", "sources", "verb")
    return P.plan_documents(full, tables["edges"], options, keep, stage=stage)


def plan_banks(documents: DataFrame, senses: Senses | None = None, coref: Chains | None = None, options: Options = Options(), keep: int = 10, stage: str = "order", id_column: str = "doc_id") -> DataFrame:
    """Content plans of AMR banks, by their global graphs."""
    return plan_graphs(bank_graphs(documents, id_column, senses, coref, options), options, keep, stage)


def summarise(documents: DataFrame, senses: Senses | None = None, coref: Chains | None = None, options: Options = Options(), keep: int = 10, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, place, amr): the planned subgraphs in bracket notation."""
    tables = bank_graphs(documents, id_column, senses, coref, options)
    return A.write_plans(plan_graphs(tables, options, keep), tables["concepts"])
