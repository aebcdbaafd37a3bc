"""Biased random-walk ranking of meanings and of graph vertices.

The unit of work is one document. Its matrix is never made whole: similarities are worked out in
blocks of rows and only those at or above the threshold are stored, since all other entries of a row
are one constant; the iteration runs on the stored entries. Documents of more than ``LARGE`` items,
found by counting, are split: their similarities are worked out by pairs of blocks all over the
cluster, and ``iterate`` takes the steps as DataFrame plans, with checkpoints, until each has settled.

Defined results: a document without meanings has no rows; null vectors are similar to nothing;
isolated vertices are reached by the bias only; ranks of a document sum to 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.context import cut_lineage
from glossmill.operators.graph import fresh
from glossmill.options import Options

MAX_STEPS = 10_000
#: Meanings or vertices from which on a document is split over tasks, and those of a block of similarities.
LARGE, SPLIT_BLOCK = 20_000, 2_000
#: Rows of similarities at a time within a task.
ROWS = 512


# --- dense parts, one document at a time -----------------------------------------------------


def bias(weights: np.ndarray) -> np.ndarray:
    """Weights by their sum; uniform if that is not positive."""
    s = weights.sum()
    return weights / s if s > 0 else np.full(len(weights), 1.0 / len(weights))


def variables_bias(weights: np.ndarray) -> np.ndarray:
    """Weights smoothed by a hundredth of their mean, by their sum; uniform if all are 0."""
    smooth = weights + weights.mean() / 100
    s = smooth.sum()
    return smooth / s if s > 0 else np.full(len(weights), 1.0 / len(weights))


def similarity_matrix(vectors: list, groups: list, threshold: float) -> np.ndarray:
    """Cosines off the diagonal, 1 on it; 0 below the threshold and for pairs of one mention group."""
    n = len(vectors)
    dims = next((len(v) for v in vectors if v is not None), 1)
    v = np.array([np.zeros(dims) if x is None else np.asarray(x, dtype=float) for x in vectors])
    norm = np.linalg.norm(v, axis=1)
    v = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)
    s = np.minimum(v @ v.T, 1.0)
    codes = pd.factorize(pd.Series(groups, dtype=object))[0]
    s[codes[:, None] == codes[None, :]] = 0.0
    s[~np.isfinite(s) | (s < max(threshold, 0.0))] = 0.0
    np.fill_diagonal(s, 1.0 if threshold <= 1 else 0.0)
    return s


def fill_zeros(s: np.ndarray) -> np.ndarray:
    """Every 0 becomes the mean of all entries, zeros and diagonal included."""
    return np.where(s == 0, s.mean(), s)


def row_normalise(s: np.ndarray) -> np.ndarray:
    """Rows by their sums; a row of zeros stays so."""
    t = s.sum(axis=1, keepdims=True)
    return np.divide(s, t, out=np.zeros_like(s), where=t > 0)


def transition(x: np.ndarray, b: np.ndarray, damping: float, personalised: bool = True) -> np.ndarray:
    """damping * bias + (1 - damping) * x; the bias is that of the target, or of the source as first written."""
    return damping * (b[None, :] if personalised else b[:, None]) + (1 - damping) * x


def power_iteration(r: np.ndarray, steps: int = MAX_STEPS, epsilon: float | None = None) -> np.ndarray:
    """Stationary distribution: stops when no entry moves by 1/(1000 n)."""
    n = len(r)
    epsilon = 1.0 / (1000 * n) if epsilon is None else epsilon
    v = np.full(n, 1.0 / n)
    for _ in range(steps):
        w = r.T @ v
        total = np.abs(w).sum()
        if not total > 0:
            return v
        w = w / total
        done = np.abs(w - v).max() < epsilon
        v = w
        if done:
            break
    return v


# --- sparse parts ---------------------------------------------------------------------------


def unit_rows(vectors: list) -> np.ndarray:
    """Vectors by their norm; zeros for missing and zero ones."""
    dims = next((len(v) for v in vectors if v is not None), 1)
    return _by_norm(np.array([np.zeros(dims) if x is None else np.asarray(x, dtype=float) for x in vectors]).reshape(len(vectors), dims))


def unit_columns(vectors: pa.ChunkedArray) -> np.ndarray:
    """``unit_rows`` of a column of lists, without an object a row."""
    lists = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    v = np.zeros((len(lists), max(int(size.max(initial=0)), 1)))
    v[size > 0] = pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, v.shape[1])
    return _by_norm(v)


def _by_norm(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1)
    return np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)


def linked(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the cosines of two blocks that are stored: above 0, at or above the threshold, of different groups."""
    out = []
    for start in range(0, len(a), ROWS):
        s = np.minimum(a[start : start + ROWS] @ b.T, 1.0)
        s[of_a[start : start + ROWS, None] == of_b[None, :]] = 0.0
        with np.errstate(invalid="ignore"):
            i, j = np.nonzero((s > 0) & (s >= threshold) & np.isfinite(s))
        out.append((i + start, j, s[i, j]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, dtype=float if k == 2 else int) for k in range(3))


def stored_entries(vectors: list, groups: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of ``similarity_matrix`` that are not 0, in the order of rows and columns."""
    return entries_of(unit_rows(vectors), pd.factorize(pd.Series(groups, dtype=object))[0], threshold)


def entries_of(v: np.ndarray, codes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``stored_entries`` of unit vectors and group numbers."""
    i, j, s = linked(v, v, codes, codes, threshold)
    if threshold <= 1:
        every = np.arange(len(v))
        i, j, s = np.concatenate([i, every]), np.concatenate([j, every]), np.concatenate([s, np.ones(len(v))])
    order = np.lexsort((j, i))
    return i[order], j[order], s[order]


def filled_rows(n: int, i: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
    """The constant that stands for entries not stored, and the sum of each row with it."""
    fill = float(s.sum()) / (n * n)
    return fill, np.bincount(i, weights=s, minlength=n) + (n - np.bincount(i, minlength=n)) * fill


def sparse_iteration(b: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, rest: np.ndarray, damping: float, personalised: bool, steps: int, epsilon: float | None) -> np.ndarray:
    """``power_iteration`` of a transition whose entry (i, j) is ``rest[i]`` plus, where stored, ``x``."""
    n = len(b)
    epsilon = 1.0 / (1000 * n) if epsilon is None else epsilon
    v = np.full(n, 1.0 / n)
    for _ in range(steps):
        w = damping * (b * v.sum() if personalised else float(b @ v)) + (1 - damping) * (np.bincount(j, weights=x * v[i], minlength=n) + float(rest @ v))
        total = np.abs(w).sum()
        if not total > 0:
            return v
        w = w / total
        done = np.abs(w - v).max() < epsilon
        v = w
        if done:
            break
    return v


# --- documents split over tasks ---------------------------------------------------------------


def large_documents(items: DataFrame, most: int | None = None) -> DataFrame | None:
    """(doc_id) of the documents with more than ``most`` rows, None if there are none; one count over ``items(doc_id)``."""
    counts = items.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > (LARGE if most is None else most))
    found = cut_lineage(counts.select("doc_id"))
    return None if found.isEmpty() else found


def split_entries(rows: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, a, b, value): the stored entries of large documents, worked out by pairs of blocks, the diagonal included."""
    doc, ref = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "ref"))
    blocks = F.ceil(F.col("n") / SPLIT_BLOCK).cast("int")
    placed = _with(rows, n=F.count("*")).select("doc_id", "ref", "ms", "vec", blocks.alias("m")).withColumn("mine", F.pmod(F.xxhash64("ref"), F.col("m")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    met = placed.select("doc_id", "ref", "ms", "vec", "mine", F.inline(pair))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["mine", "ref"], kind="stable").reset_index(drop=True)
        v, code, mine = unit_rows(list(p["vec"])), pd.factorize(p["ms"])[0], p["mine"].to_numpy()
        first, second = (np.flatnonzero(mine == p[c].iloc[0]) for c in ("i", "j"))
        i, j, s = linked(v[first], v[second], code[first], code[second], threshold)
        a, b = first[i], second[j]
        if p["i"].iloc[0] != p["j"].iloc[0]:
            a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        refs = p["ref"].to_numpy(dtype=object)
        return pd.DataFrame({"doc_id": [p["doc_id"].iloc[0]] * len(a), "a": refs[a], "b": refs[b], "value": s})

    entries = met.groupBy("doc_id", "i", "j").applyInPandas(run, f"doc_id {doc}, a {ref}, b {ref}, value double")
    if threshold > 1:
        return entries
    return entries.unionByName(rows.select("doc_id", F.col("ref").alias("a"), F.col("ref").alias("b"), F.lit(1.0).alias("value")))


def iterate(items: DataFrame, links: DataFrame, damping: float, personalised: bool = True, steps: int = MAX_STEPS, epsilon: float | None = None) -> DataFrame:
    """(doc_id, v, rank) of ``items(doc_id, v, b, rest)`` along ``links(doc_id, a, b, x)``, all documents at once.

    The same steps and stopping rule as ``sparse_iteration``; a document that has settled keeps
    its ranks. Every step is one join on the source of a link and one aggregation on its target, with
    map-side sums, and is checkpointed; only the number of open documents reaches the driver.
    """
    sized = _with(items, n=F.count("*"))
    state = cut_lineage(sized.select("doc_id", "v", "b", "rest", (1.0 / F.col("n")).alias("p"), "n", F.lit(False).alias("done")))
    links = cut_lineage(links.select("doc_id", F.col("a").alias("v"), F.col("b").alias("to"), "x"))
    for _ in range(steps):
        moved = links.join(state.where("not done").select("doc_id", "v", "p"), ["doc_id", "v"]).groupBy("doc_id", F.col("to").alias("v")).agg(F.sum(F.col("x") * F.col("p")).alias("m"))
        summed = _with(state, _p=F.sum("p"), _bp=F.sum(F.col("b") * F.col("p")), _rest=F.sum(F.col("rest") * F.col("p"))).join(moved, ["doc_id", "v"], "left")
        pushed = F.col("b") * F.col("_p") if personalised else F.col("_bp")
        w = cut_lineage(summed.select(*state.columns, (damping * pushed + (1 - damping) * (F.coalesce("m", F.lit(0.0)) + F.col("_rest"))).alias("w")))
        fresh = _with(w, _t=F.sum(F.abs("w"))).withColumn("q", F.when(F.col("done") | ~(F.col("_t") > 0), F.col("p")).otherwise(F.col("w") / F.col("_t")))
        least = F.lit(epsilon) if epsilon is not None else 1.0 / (1000 * F.col("n"))
        moves = _with(fresh, _d=F.max(F.abs(F.col("q") - F.col("p"))))
        state = cut_lineage(moves.select("doc_id", "v", "b", "rest", F.col("q").alias("p"), "n", (F.col("done") | (F.col("_d") < least)).alias("done")))
        if state.where("not done").isEmpty():
            break
    return state.select("doc_id", "v", F.col("p").alias("rank"))


def _with(rows: DataFrame, **sums: Column) -> DataFrame:
    """Rows with aggregates of their document; summed map-side and joined back, so a large document is not brought together."""
    return rows.join(rows.groupBy("doc_id").agg(*[c.alias(k) for k, c in sums.items()]), "doc_id")


def _both_ways(rows: DataFrame, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the ordinary documents and those of the large ones."""
    if large is None:
        return rows, None
    return rows.join(large, "doc_id", "left_anti"), cut_lineage(rows.join(large, "doc_id", "left_semi"))


# --- meanings -------------------------------------------------------------------------------


def ranking_input(candidates: DataFrame, weights: DataFrame, meanings: DataFrame) -> DataFrame:
    """(doc_id, ref, first, w, ms, vec): one row a distinct meaning of a document, its mentions as a group key."""
    grouped = candidates.groupBy("doc_id", "ref").agg(F.min(F.struct("mention_id", "ord")).alias("first"), F.md5(F.array_join(F.array_sort(F.collect_list(F.col("mention_id").cast("string"))), "|")).alias("ms"))
    vec = meanings.select("ref", F.col("vec").cast("array<double>").alias("vec"))
    return grouped.join(weights, ["doc_id", "ref"], "left").join(vec, "ref", "left").select("doc_id", "ref", "first", F.coalesce("w", F.lit(0.0)).alias("w"), "ms", "vec")


def _ordered(rows: pa.Table, threshold: float) -> tuple[pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a document by meaning, and their stored entries."""
    p = rows.sort_by("ref")
    codes = p.column("ms").combine_chunks().dictionary_encode().indices.to_numpy()
    return p, entries_of(unit_columns(p.column("vec")), codes, threshold)


def rank_meanings(rows: DataFrame, options: Options = Options(), steps: int = MAX_STEPS, epsilon: float | None = None, large: DataFrame | None = None) -> DataFrame:
    """(doc_id, ref, rank) from ``ranking_input``; the documents of ``large``, from ``large_documents``, are split."""
    doc, ref = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "ref"))

    def run(table: pa.Table) -> pa.Table:
        p, (i, j, s) = _ordered(table, options.sim_threshold)
        fill, sums = filled_rows(len(p), i, s)
        over = np.divide(1.0, sums, out=np.zeros_like(sums), where=sums > 0)
        ranks = sparse_iteration(bias(p.column("w").to_numpy()), i, j, (s - fill) * over[i], fill * over, options.damping_meanings, options.personalised, steps, epsilon)
        return pa.table({"doc_id": p.column("doc_id"), "ref": p.column("ref"), "rank": ranks})

    whole, split = _both_ways(rows.select("doc_id", "ref", "w", "ms", "vec"), large)
    out = whole.groupBy("doc_id").applyInArrow(run, f"doc_id {doc}, ref {ref}, rank double")
    if split is None:
        return out
    entries = cut_lineage(split_entries(split, options.sim_threshold))
    sizes = split.groupBy("doc_id").agg(F.count("*").alias("n"))
    fills = entries.groupBy("doc_id").agg(F.sum("value").alias("t")).join(sizes, "doc_id", "right").select("doc_id", "n", (F.coalesce("t", F.lit(0.0)) / (F.col("n") * F.col("n"))).alias("fill"))
    sums = entries.groupBy("doc_id", F.col("a").alias("ref")).agg(F.sum("value").alias("s"), F.count("*").alias("c"))
    biased = _with(split, s=F.sum("w")).select("doc_id", "ref", F.when(F.col("s") > 0, F.col("w") / F.col("s")).alias("l")).join(sums, ["doc_id", "ref"], "left").join(fills, "doc_id")
    row_sum = F.coalesce("s", F.lit(0.0)) + (F.col("n") - F.coalesce("c", F.lit(0))) * F.col("fill")
    known = cut_lineage(biased.select("doc_id", F.col("ref").alias("v"), F.coalesce("l", 1.0 / F.col("n")).alias("b"), "fill", F.when(row_sum > 0, 1.0 / row_sum).otherwise(0.0).alias("over")))
    links = entries.join(known.select("doc_id", F.col("v").alias("a"), "fill", "over"), ["doc_id", "a"]).select("doc_id", "a", "b", ((F.col("value") - F.col("fill")) * F.col("over")).alias("x"))
    items = known.select("doc_id", "v", "b", (F.col("fill") * F.col("over")).alias("rest"))
    ranked = iterate(items, links, options.damping_meanings, options.personalised, steps, epsilon)
    return out.unionByName(ranked.withColumnRenamed("v", "ref"))


def similarity_entries(rows: DataFrame, threshold: float, stage: str = "thresholded") -> DataFrame:
    """(doc_id, a, b, value) of the similarity matrix at a stage: thresholded, filled or normalised.

    Only stored entries (at or above the threshold) come out; the value of all others, the same
    within a row, is in (doc_id, a, null).
    """
    doc, ref = (rows.schema[c].dataType.simpleString() for c in ("doc_id", "ref"))

    def run(table: pa.Table) -> pa.Table:
        p, (i, j, s) = _ordered(table, threshold)
        n, refs = len(p), p.column("ref").combine_chunks()
        fill, sums = filled_rows(n, i, s)
        over = np.divide(1.0, sums, out=np.zeros_like(sums), where=sums > 0) if stage == "normalised" else np.ones(n)
        a, b, value = refs.take(pa.array(i)), refs.take(pa.array(j)), s * over[i]
        if stage != "thresholded":
            open_ = np.flatnonzero(np.bincount(i, minlength=n) < n)
            a = pa.concat_arrays([a, refs.take(pa.array(open_))])
            b = pa.concat_arrays([b, pa.nulls(len(open_), refs.type)])
            value = np.concatenate([value, (fill * over)[open_]])
        one = p.column("doc_id").combine_chunks()
        return pa.table({"doc_id": one.take(pa.array(np.zeros(len(a), dtype=np.int64))), "a": a, "b": b, "value": value})

    kept = rows.select("doc_id", "ref", "ms", "vec")
    return kept.groupBy("doc_id").applyInArrow(run, f"doc_id {doc}, a {ref}, b {ref}, value double")


def meanings_bias(rows: DataFrame) -> DataFrame:
    """(doc_id, ref, l) by windows alone."""
    w = Window.partitionBy("doc_id")
    s, n = F.sum("w").over(w), F.count("*").over(w)
    return rows.select("doc_id", "ref", F.when(s > 0, F.col("w") / s).otherwise(1.0 / n).alias("l"))


def vertex_bias(rows: DataFrame, vertex: str = "v") -> DataFrame:
    """(doc_id, v, t) by windows alone."""
    w = Window.partitionBy("doc_id")
    a, n = F.avg("w").over(w) / 100, F.count("*").over(w)
    smooth = rows.select("doc_id", vertex, (F.col("w") + a).alias("_s"), n.alias("_n"))
    s = F.sum("_s").over(w)
    return smooth.select("doc_id", vertex, F.when(s > 0, F.col("_s") / s).otherwise(1.0 / F.col("_n")).alias("t"))


def type_vector(rows: DataFrame, smooth: bool = False, normalise: bool = False) -> DataFrame:
    """(doc_id, ref, t): 1 where the mention's type is given and that of the meaning, else 0 (.99 and .01 if smooth)."""
    hit = (F.coalesce(F.col("mention_type"), F.lit("")) != "") & (F.col("mention_type") == F.col("type"))
    yes, no = (0.99, 0.01) if smooth else (1.0, 0.0)
    out = rows.select("doc_id", "ref", F.when(hit, yes).otherwise(no).alias("t"))
    if not normalise:
        return out
    w = Window.partitionBy("doc_id")
    s, n = F.sum("t").over(w), F.count("*").over(w)
    return out.withColumn("t", F.when(s > 0, F.col("t") / s).otherwise(1.0 / n))


# --- vertices -------------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """(doc_id, a, b) both ways, once each, without loops."""
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    return edges.where("src <> dst").select("doc_id", F.inline(ends)).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(doc_id, a, b, value): 1 / degree for each neighbour."""
    both = undirected(edges)
    return both.withColumn("value", 1.0 / F.count("*").over(Window.partitionBy("doc_id", "a")))


def rank_vertices(vertices: DataFrame, edges: DataFrame, options: Options = Options(), steps: int = MAX_STEPS, epsilon: float | None = None, large: DataFrame | None = None) -> DataFrame:
    """(doc_id, v, rank) from ``vertices(doc_id, v, w)`` and ``edges(doc_id, src, dst)``; the graphs of ``large`` are split."""
    doc, key = (vertices.schema[c].dataType.simpleString() for c in ("doc_id", "v"))

    def run(vs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        if not len(vs):
            return pd.DataFrame({"doc_id": [], "v": [], "rank": []}, dtype=object)
        p = vs.sort_values("v", kind="stable").reset_index(drop=True)
        place = pd.Index(p["v"])
        i, j = (place.get_indexer(es[c]) for c in ("a", "b"))
        known = (i >= 0) & (j >= 0)
        i, j = i[known], j[known]
        degree = np.bincount(i, minlength=len(p))
        ranks = sparse_iteration(variables_bias(p["w"].to_numpy(dtype=float)), i, j, 1.0 / degree[i], np.zeros(len(p)), options.damping_variables, options.personalised, steps, epsilon)
        return pd.DataFrame({"doc_id": p["doc_id"].to_numpy(dtype=object), "v": p["v"].to_numpy(dtype=object), "rank": ranks})

    whole, split = _both_ways(vertices, large)
    links = undirected(edges)
    out = whole.groupBy("doc_id").cogroup(fresh(links).groupBy("doc_id")).applyInPandas(run, f"doc_id {doc}, v {key}, rank double")
    if split is None:
        return out
    ends = split.select("doc_id", "v")
    inside = links.join(large, "doc_id", "left_semi").join(ends.withColumnRenamed("v", "a"), ["doc_id", "a"], "left_semi").join(ends.withColumnRenamed("v", "b"), ["doc_id", "b"], "left_semi")
    degrees = inside.groupBy("doc_id", "a").agg(F.count("*").alias("d"))
    weighted = inside.join(degrees, ["doc_id", "a"]).withColumn("x", 1.0 / F.col("d"))
    smooth = _with(_with(split, a=F.avg("w") / 100).withColumn("w", F.col("w") + F.col("a")), s=F.sum("w"), n=F.count("*"))
    items = smooth.select("doc_id", "v", F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(1.0 / F.col("n")).alias("b"), F.lit(0.0).alias("rest"))
    return out.unionByName(iterate(items, weighted, options.damping_variables, options.personalised, steps, epsilon))


def rank_mentions(mentions: DataFrame, edges: DataFrame, options: Options = Options()) -> DataFrame:
    """Ranks mentions as vertices: ``mentions(doc_id, mention_id, weight)``, one candidate each, averaged if more."""
    vs = mentions.groupBy("doc_id", F.col("mention_id").alias("v")).agg(F.avg("weight").alias("w"))
    return rank_vertices(vs, edges, options).withColumnRenamed("v", "mention_id")


def write_ranks(candidates: DataFrame, ranks: DataFrame) -> DataFrame:
    """Candidates with the rank of their meaning as weight; excluded ones keep 0."""
    return candidates.join(ranks.select("doc_id", "ref", "rank"), ["doc_id", "ref"], "left").withColumn("weight", F.coalesce("rank", F.lit(0.0))).drop("rank")


