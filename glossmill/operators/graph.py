"""Semantic graphs as tables: vertices (doc_id, v, ...), edges (doc_id, src, dst, role).

Graphs are simple: no loops, one edge an ordered pair (the least role is kept). Null ends are
dropped. Multi-valued attributes of a vertex are side tables (doc_id, v, value).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.context import cut_lineage


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def simple(edges: DataFrame) -> DataFrame:
    """Without loops and nulls, one edge an ordered pair."""
    return edges.where("src is not null and dst is not null and src <> dst").groupBy("doc_id", "src", "dst").agg(F.min("role").alias("role"))


def edges_where(items: DataFrame, key: list[str], condition: Column, role: Column) -> DataFrame:
    """Edges between the items of one key (as ``a`` and ``b``) that fulfil a condition; the key keeps it an equi-join."""
    a, b = items.alias("a"), items.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    joined = a.join(b, on).where((F.col("a.v") != F.col("b.v")) & condition)
    return simple(joined.select("a.doc_id", F.col("a.v").alias("src"), F.col("b.v").alias("dst"), role.alias("role")))


def prefixed(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """Vertices named after their graph, so that they differ across the graphs of a document; concepts keep their name."""
    names = {c: F.concat_ws("_", graph, c) for c in ("src", "dst")}
    return edges.withColumns(names | {"dst": F.when(F.col("role") == ":instance", F.col("dst")).otherwise(names["dst"])})


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with vertices replaced by ``mapping(doc_id, v, into)``; inner edges vanish."""
    m = mapping.select("doc_id", F.col("v").alias("_v"), "into")
    out = edges
    for end in ("src", "dst"):
        out = out.join(m.withColumnRenamed("_v", end), ["doc_id", end], "left").withColumn(end, F.coalesce("into", end)).drop("into")
    return simple(out)


def contract_values(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """A side table (doc_id, v, value) moved along a contraction, without repeats."""
    joined = values.join(mapping.select("doc_id", "v", "into"), ["doc_id", "v"], "left")
    return joined.select("doc_id", F.coalesce("into", "v").alias("v"), "value").distinct()


#: Links from which on a document's components are found over the whole cluster instead of in one task.
LARGE = 1_000_000


def components(vertices: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, v, component): the least vertex that each is linked to.

    A document of up to ``most`` links is settled in one task by joining sets; larger ones, found
    by counting, by ``star_components`` over the whole cluster.
    """
    links = cut_lineage(edges.where("src <> dst").select("doc_id", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("w")).distinct())
    sizes = links.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > (LARGE if most is None else most))
    large = cut_lineage(sizes.select("doc_id"))
    types = {c: links.schema[c].dataType.simpleString() for c in ("doc_id", "u")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(pd.concat([pdf["u"], pdf["w"]]).unique()).sort_values()
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(names.get_indexer(pdf["u"]).tolist(), names.get_indexer(pdf["w"]).tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        least = names.to_numpy(dtype=object)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]] * len(names), "v": least, "component": least[[find(x) for x in range(len(names))]]})

    schema = f"doc_id {types['doc_id']}, v {types['u']}, component {types['u']}"
    if large.isEmpty():
        found = links.groupBy("doc_id").applyInPandas(run, schema)
    else:
        few = links.join(large, "doc_id", "left_anti").groupBy("doc_id").applyInPandas(run, schema)
        found = few.unionByName(star_components(links.join(large, "doc_id", "left_semi")))
    return vertices.select("doc_id", "v").distinct().join(found, ["doc_id", "v"], "left").select("doc_id", "v", F.coalesce("component", "v").alias("component"))


def star_components(links: DataFrame) -> DataFrame:
    """(doc_id, v, component) of the ends of links (doc_id, u, w), u > w.

    Alternates large-star and small-star steps until no link changes, which takes a number of rounds
    logarithmic in the longest path. Every round pre-aggregates map-side; a vertex with many links
    never gathers them in one task, since a star step only joins on it and takes minima. Nothing
    but the number of changed links reaches the driver.
    """
    links = cut_lineage(links)
    before = None
    while True:
        both = links.unionByName(links.select("doc_id", F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("doc_id", "u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.join(least, ["doc_id", "u"]).where("w > u").select("doc_id", F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        down = large.groupBy("doc_id", "u").agg(F.min("w").alias("m"))
        joined = large.join(down, ["doc_id", "u"])
        small = joined.select("doc_id", F.col("w").alias("u"), F.col("m").alias("w")).unionByName(down.select("doc_id", "u", F.col("m").alias("w"))).where("u <> w").distinct()
        links = cut_lineage(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "u", "w").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    root = links.groupBy("doc_id", "u").agg(F.min("w").alias("component"))
    tops = root.select("doc_id", F.col("component").alias("v"), "component").distinct()
    return root.withColumnRenamed("u", "v").unionByName(tops)


def without_names(edges: DataFrame) -> DataFrame:
    """Edges without name vertices and their leaves: targets of ``:name`` only, and of their ``:op``s."""
    named = edges.where("role = ':name'").select("doc_id", F.col("dst").alias("n")).distinct()
    other = edges.where("role <> ':name'").select("doc_id", F.col("dst").alias("n")).distinct()
    only = named.join(other, ["doc_id", "n"], "left_anti")
    kept = edges.join(only.withColumnRenamed("n", "dst"), ["doc_id", "dst"], "left_anti")
    return kept.join(only.withColumnRenamed("n", "src"), ["doc_id", "src"], "left_anti").select(*edges.columns)


def without_concepts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without ``:instance``, and (doc_id, v, concept)."""
    concepts = edges.where("role = ':instance'").groupBy("doc_id", F.col("src").alias("v")).agg(F.min("dst").alias("concept"))
    return edges.where("role <> ':instance'"), concepts


def disambiguate(candidates: DataFrame) -> DataFrame:
    """One candidate a vertex from (doc_id, v, mention_id, ref, weight, multiword).

    The best multiword wins if it weighs at least the mean of the vertex's candidates, else the best.
    """
    per = Window.partitionBy("doc_id", "v")
    wins = F.col("multiword") & (F.col("weight") >= F.avg("weight").over(per) - 1e-12)
    best = per.orderBy(F.desc("_m"), F.desc("weight"), "mention_id", "ref")
    return candidates.withColumn("_m", wins.cast("int")).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_m")


def collapse_multiwords(subsumptions: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, v, into) from (doc_id, v, covered) and (doc_id, v, w), a document at a time.

    A vertex takes in the vertices its multiword covers if it weighs at least as much as the
    heaviest of them; what others took in before follows along. Order: most covered first.
    """
    types = {c: subsumptions.schema[c].dataType.simpleString() for c in ("doc_id", "v")}

    def run(sub: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        weight = dict(zip(w["v"], w["w"]))
        into: dict = {}

        def root(v):
            while v in into:
                v = into[v]
            return v

        groups = sub.groupby("v")["covered"].apply(lambda s: sorted(set(s))).to_dict()
        for v in sorted(groups, key=lambda x: (-len(groups[x]), x)):
            me = root(v)
            covered = {root(c) for c in groups[v]} - {me}
            if covered and weight.get(me, 0.0) >= max(weight.get(c, 0.0) for c in covered):
                into.update(dict.fromkeys(covered, me))
        doc = sub["doc_id"].iloc[0] if len(sub) else None
        return pd.DataFrame([(doc, v, root(v)) for v in sorted(into)], columns=["doc_id", "v", "into"])

    return subsumptions.groupBy("doc_id").cogroup(fresh(weights).groupBy("doc_id")).applyInPandas(run, f"doc_id {types['doc_id']}, v {types['v']}, into {types['v']}")


def heaviest_of(groups: DataFrame) -> DataFrame:
    """(doc_id, v, into) from (doc_id, group_id, v, w): each group into its heaviest vertex, the least on ties."""
    best = groups.groupBy("doc_id", "group_id").agg(F.min_by("v", F.struct((-F.col("w")).alias("w"), F.col("v"))).alias("into"), F.count_distinct("v").alias("n"))
    return groups.join(best.where("n > 1"), ["doc_id", "group_id"]).where("v <> into").groupBy("doc_id", "v").agg(F.min("into").alias("into"))


def merge_graphs(edges: DataFrame, weights: DataFrame, coref: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Global graph of a document: edges, (doc_id, v, w) and the contraction (doc_id, v, into).

    ``coref(doc_id, group_id, v)`` chains of more than one go into their heaviest vertex, then the
    vertices of one entity meaning (``entities(doc_id, group_id, v)``) likewise, by the meaning that
    the head of a chain keeps.
    """

    def heads(groups: DataFrame) -> DataFrame:
        return heaviest_of(groups.select("doc_id", "group_id", "v").join(weights, ["doc_id", "v"], "left").withColumn("w", F.coalesce("w", F.lit(0.0))))

    first = heads(coref)
    second = heads(entities.join(first, ["doc_id", "v"], "left_anti"))
    onward = second.select("doc_id", F.col("v").alias("into"), F.col("into").alias("_to"))
    mapping = first.join(onward, ["doc_id", "into"], "left").select("doc_id", "v", F.coalesce("_to", "into").alias("into")).unionByName(second)
    return contract(edges, mapping), weights.join(mapping, ["doc_id", "v"], "left_anti"), mapping


def dependency_graph(tokens: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of deep dependencies: (doc_id, v, w) with the confidence of its sense, and edges."""
    vertices = tokens.select("doc_id", F.concat_ws("_", "sent_id", "i").alias("v"), F.coalesce("confidence", F.lit(0.0)).alias("w"))
    edges = dependencies.select("doc_id", F.concat_ws("_", "sent_id", "governor").alias("src"), F.concat_ws("_", "sent_id", "dependent").alias("dst"), "role")
    return vertices, simple(edges)


def depths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, v, depth) of the vertices reached from ``roots(doc_id, v)``, breadth first, until no new one is.

    Each round joins only the last frontier and cuts its lineage.
    """
    seen = cut_lineage(roots.select("doc_id", "v", F.lit(0).alias("depth")).distinct())
    front, d = seen, 0
    while True:
        d += 1
        step = front.join(edges.select("doc_id", F.col("src").alias("v"), "dst"), ["doc_id", "v"]).select("doc_id", F.col("dst").alias("v"))
        front = cut_lineage(step.distinct().join(seen, ["doc_id", "v"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


# --- roles -----------------------------------------------------------------------------------

#: AMR roles of one argument that need it, seen from their source, and from their target.
FROM_SOURCE = ":instance :domain :polarity :mode :quant :unit :value :ord :poss"
FROM_TARGET = ":mod :polarity-of :quant-of :ord-of :poss-of"
DATES = ":calendar :century :day :dayperiod :decade :era :month :quarter :season :timezone :weekday :year :year2"


def role_rules(scheme: str = "amr") -> dict[str, tuple[bool, str | None]]:
    """role → (core, side that needs the other: "source", "target" or None)."""
    rules: dict[str, tuple[bool, str | None]] = {}
    if scheme == "amr":
        for role in [f":ARG{k}" for k in range(6)] + [f":op{k}" for k in range(1, 11)]:
            rules[role], rules[f"{role}-of"] = (True, "source"), (True, "target")
        rules |= {r: (False, "source") for r in (FROM_SOURCE + " " + DATES).split()} | {r: (False, "target") for r in FROM_TARGET.split()}
    else:
        for k in range(11):
            rules[f"A{k}"], rules[f"A{k}INV"] = (True, "source" if k < 6 else None), (True, "target" if k < 6 else None)
    return rules


def with_rules(edges: DataFrame, scheme: str = "amr") -> DataFrame:
    """Edges with ``core`` and ``needs``; the rules are a literal map of under 60 entries."""
    rules = role_rules(scheme)
    core = F.coalesce(F.col("role").isin([r for r, (c, _) in rules.items() if c]), F.lit(False))
    needs = F.when(F.col("role").isin([r for r, (_, s) in rules.items() if s == "source"]), "source").when(F.col("role").isin([r for r, (_, s) in rules.items() if s == "target"]), "target")
    return edges.withColumns({"core": core, "needs": needs})
