"""Most similar vectors for every vector: balanced posting lists.

* Exact copies (vectors of one direction) are folded onto one representative first; the six
  smallest ids of a group stand for it and the rest are linked back, so a group that holds a third
  of all rows costs no more than its rows.
* Centroids are fitted by balanced spherical k-means on a bounded sample (``SAMPLE`` vectors, the
  documented parameter); every vector is indexed. A crowded centroid is split until none holds
  more than twice its share.
* A vector near a boundary is replicated to up to ``REPLICAS`` lists. Centroids are searched by
  best-first steps on an in-memory neighbour graph; the lists to search are those whose distance
  is within ``RATIO`` of the nearest one's, ``PROBES`` at most.
* Beyond ``MAX_LISTS`` lists there are two levels: the broadcast centroids are those of cells, and each
  cell has centroids and a graph of its own, fitted on at most ``SAMPLE`` of its vectors. They meet the
  vectors of the cell by its key, so the lists grow with the data and the broadcast does not.
* Each list is one group of work. A list beyond ``BLOCK`` vectors is cut into blocks, and members
  and queries meet block by block, so no task holds a hot list. Sizes are estimated on the sample, as they
  only decide how the work is cut.
* Vectors travel as codes of 16 bits a number, by their largest; cosines of codes differ from those of
  the vectors by about 0.000004 and are those that come out.

Defined results
---------------
* only vectors of ``dims`` finite numbers that are not all zero take part, each vec_id once; null,
  short, long, non-finite and zero vectors have no rows and are nobody's neighbour.
* ties are ordered by the smaller neighbour id; copies have cosine 1.
* recall is measured against brute force in the tests; it is at least 0.9.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.context import cut_lineage, written

SAMPLE = 65_536
LIST_SIZE = 1024
MAX_LISTS = 8192
#: Lists that hold a vector, lists it searches, and how much farther than the nearest they may be; cells of a vector on two levels.
REPLICAS, PROBES, RATIO = 4, 4, 1.3
CELLS = 3
BLOCK = 8192
#: Links of a centroid in the graph, best-first beam, centroids expanded a step, and steps.
LINKS, BEAM, EXPAND, HOPS = 24, 32, 4, 8
#: Up to so many centroids the graph is entered at every one, so that no step is left to take.
FLAT = 2048
#: Vectors on which the sizes of lists are estimated.
ESTIMATE = 8192
#: A direction is hot from this share of all vectors on; at most its inverse can be.
HOT_SHARE = 1 / 200
LARGEST = 32767


def usable(vectors: DataFrame, dims: int, id_column: str = "vec_id", vector_column: str = "vectors") -> DataFrame:
    """(vec_id, v): codes of the vectors that take part; narrow, a whole Arrow batch at a time."""
    rows = vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), dims), False))
            x = kept.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls become NaN
            largest = np.abs(x).max(axis=1, initial=0.0)
            good = np.isfinite(largest) & (largest > 0)
            codes = np.round(x[good] / largest[good, None] * LARGEST).astype("<i2").tobytes()
            v = pa.array([codes[i : i + 2 * dims] for i in range(0, len(codes), 2 * dims)], pa.binary())
            yield pa.RecordBatch.from_arrays([kept.column("vec_id").filter(pa.array(good)), v], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id long, v binary")


def decoded(codes: list[bytes] | pd.Series, dims: int) -> np.ndarray:
    """Unit vectors of codes."""
    x = np.frombuffer(b"".join(codes), dtype="<i2").reshape(-1, dims).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None].astype(np.float32)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Balanced spherical k-means: crowded centroids give up half their vectors to idle ones."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for r in range(rounds):
        near = np.concatenate([(sample[s : s + 8192] @ c.T).argmax(1) for s in range(0, len(sample), 8192)])
        size = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        if r == rounds - 1:
            break
        crowded = np.flatnonzero(size > 2 * len(sample) / lists)
        idle = np.argsort(size, kind="stable")[: len(crowded)]
        for a, b in zip(crowded[np.argsort(-size[crowded])], idle):
            if size[b] < len(sample) / lists / 2:
                c[b] = sample[rng.choice(np.flatnonzero(near == a))]
    return c.astype(np.float32)


def link_centroids(c: np.ndarray, links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour graph of the centroids and the entry points of a search."""
    k = min(links, len(c) - 1)
    graph = np.zeros((len(c), k), dtype=np.int32)
    for s in range(0, len(c) if k else 0, 2048):
        sim = c[s : s + 2048] @ c.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -9
        graph[s : s + 2048] = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    step = max(1, int(np.sqrt(len(c)) / 16)) if len(c) > FLAT else 1
    return graph, np.arange(0, len(c), step, dtype=np.int32)


def search_graph(q: np.ndarray, c: np.ndarray, graph: np.ndarray, entries: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` nearest centroids of each query and their cosines, best first."""
    n, beam = len(q), min(max(BEAM, want), len(c))
    sim = q @ c[entries].T
    first = min(beam, len(entries))
    at = np.argpartition(-sim, first - 1, axis=1)[:, :first]
    ids, sims = entries[at], np.take_along_axis(sim, at, 1)
    done = np.zeros(ids.shape, dtype=bool)
    for _ in range(HOPS if len(entries) < len(c) else 0):
        order = np.argsort(np.where(done, 9.0, -sims), axis=1, kind="stable")[:, :EXPAND]
        picked = np.take_along_axis(ids, order, 1)
        fresh = ~np.take_along_axis(done, order, 1)
        if not fresh.any():
            break
        np.put_along_axis(done, order, True, 1)
        around = graph[picked].reshape(n, -1)
        value = np.matmul(c[around], q[:, :, None])[:, :, 0]
        value[~np.repeat(fresh, graph.shape[1], axis=1)] = -9
        ids, sims = np.concatenate([ids, around], 1), np.concatenate([sims, value], 1)
        done = np.concatenate([done, np.zeros(around.shape, dtype=bool)], 1)
        order = np.lexsort((-sims, ~done, ids), axis=1)  # one of each centroid, an expanded one first
        ids, sims, done = (np.take_along_axis(x, order, 1) for x in (ids, sims, done))
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -9
        keep = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims, done = (np.take_along_axis(x, keep, 1) for x in (ids, sims, done))
        done |= sims < -8
    order = np.argsort(-sims, axis=1, kind="stable")[:, :want]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


Index = tuple[np.ndarray, np.ndarray, np.ndarray]


def make_index(sample: np.ndarray, lists: int) -> Index:
    centroids = fit_centroids(sample, lists)
    return (centroids, *link_centroids(centroids))


def nearest_lists(q: np.ndarray, index: Index, most: int) -> list[np.ndarray]:
    """The lists of each vector, nearest first, within the distance ratio."""
    ids, sims = search_graph(q, *index, min(most, len(index[0])))
    distance = np.sqrt(np.maximum(2 - 2 * sims, 0))
    near = (distance <= RATIO * distance[:, :1] + 1e-6) & (sims > -8)
    return [row[keep] for row, keep in zip(ids, near)]


def _assign(broadcast, dims: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 1024):
                batch = big.slice(s, 1024)
                lists = nearest_lists(decoded(batch.column("v").to_pylist(), dims), broadcast.value, most)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("v"), pa.array(lists, pa.list_(pa.int64()))], names=["rep", "v", "lists"])

    return run


def _fit_cell(dims: int, share: float, most: int, size: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The index of one cell from its sample, a ``share`` of its vectors."""
        lists = max(1, min(int(len(pdf) / share) // size, most, len(pdf) // 8))
        sample = decoded(pdf.sort_values("rep")["v"], dims)
        return pd.DataFrame({"cell": [key[0]], "index": [pickle.dumps(make_index(sample, lists))]})

    return run


def _assign_in_cells(dims: int, most: int):
    """Streams a partition ordered by cell, each cell's index before its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for big in batches:
            for s in range(0, big.num_rows, 2048):
                batch = big.slice(s, 2048)
                cells, known = batch.column("cell").to_numpy(), batch.column("index").to_pylist()
                codes, lists = batch.column("v").to_pylist(), [None] * batch.num_rows
                cuts = sorted({0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), *(i + 1 for i, x in enumerate(known) if x is not None), batch.num_rows})
                for a, b in zip(cuts, cuts[1:]):
                    if known[a] is not None:
                        at, index = cells[a], pickle.loads(known[a])
                        continue
                    # a cell that the sample missed is one list
                    near = nearest_lists(decoded(codes[a:b], dims), index, PROBES) if cells[a] == at else [np.zeros(1, np.int64)] * (b - a)
                    lists[a:b] = [int(cells[a]) * most + x.astype(np.int64) for x in near]
                keep = pa.array([x is not None for x in lists])
                out = pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("v"), pa.array(lists, pa.list_(pa.int64()))], names=["rep", "v", "lists"])
                yield out.filter(keep)

    return run


def _in_lists(reps: DataFrame, n: int, dims: int) -> tuple[DataFrame, DataFrame]:
    """(rep, v, lists) of every vector, nearest list first, and (list, parts) of the lists that are cut into several blocks."""
    spark = reps.sparkSession
    share = min(1.0, SAMPLE / n)
    chance = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    arrow = reps.where(chance < int(share * (1 << 30))).select("rep", "v").toArrow()  # bounded by SAMPLE, but for chance
    order = np.argsort(arrow.column("rep").to_numpy(), kind="stable")
    sample = decoded(arrow.column("v").take(pa.array(order)).to_pylist(), dims)
    wanted = max(1, n // LIST_SIZE)
    cells = wanted > MAX_LISTS
    index = make_index(sample, int(max(1, min(wanted, MAX_LISTS, len(sample) // 8))))
    held = np.zeros(len(index[0]))
    few = sample[:: -(-len(sample) // ESTIMATE)]
    for s in range(0, len(few), 1024):
        held += np.bincount(np.concatenate(nearest_lists(few[s : s + 1024], index, CELLS if cells else PROBES)), minlength=len(held)) * (n / len(few))
    placed = reps.select("rep", "v").mapInArrow(_assign(spark.sparkContext.broadcast(index), dims, CELLS if cells else PROBES), "rep long, v binary, lists array<bigint>")
    if not cells:
        many = [(k, int(-(-x // BLOCK))) for k, x in enumerate(held) if x > BLOCK]
        return placed, F.broadcast(spark.createDataFrame(many, "list long, parts int"))
    # cells of many vectors are cut, so that one task assigns a bounded number of them; each piece has the cell's index
    large = [F.lit(x) for k, m in enumerate(held) if m >= 128 * BLOCK for x in (k, int(m // (64 * BLOCK)))]
    pieces = F.coalesce(F.create_map(*large)[F.col("cell")], F.lit(1)) if large else F.lit(1)
    inside = placed.select("rep", "v", F.explode("lists").alias("cell"))
    of_cell = min(1.0, SAMPLE / max(float(held.max()), 1.0))
    fitted = inside.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)) < int(of_cell * (1 << 30))).groupBy("cell").applyInPandas(_fit_cell(dims, of_cell, MAX_LISTS, LIST_SIZE), "cell long, index binary")
    indexes = cut_lineage(fitted)
    none = F.lit(None).cast("binary")
    every = indexes.select(F.lit(None).cast("long").alias("rep"), none.alias("v"), "cell", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "index")
    rows = inside.select("rep", "v", "cell", F.pmod(F.xxhash64("rep"), pieces).cast("int").alias("piece"), none.alias("index")).unionByName(every)
    ordered = rows.repartition("cell", "piece").sortWithinPartitions("cell", F.col("index").isNull())
    placed = written(ordered.mapInArrow(_assign_in_cells(dims, MAX_LISTS), "rep long, v binary, lists array<bigint>"))
    sizes = placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    return placed, sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))


def _search_list(dims: int, k: int, least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        member, query = pdf[pdf["member"]], pdf[pdf["query"]]
        out: list[tuple] = []
        if len(member) and len(query):
            ids, m = member["rep"].to_numpy(), decoded(member["v"], dims)
            qid, q = query["rep"].to_numpy(), decoded(query["v"], dims)
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            top = min(k + 1, len(ids))
            for s in range(0, len(q), 1024):
                sim = q[s : s + 1024] @ m.T
                sim[qid[s : s + 1024, None] == ids[None, :]] = -9
                at = np.argpartition(-sim, top - 1, axis=1)[:, :top]
                value = np.take_along_axis(sim, at, 1)
                row, col = np.nonzero(value >= max(least - 1e-5, -2))
                a, b = s + row, at[row, col]
                cosine = np.einsum("ij,ij->i", q[a].astype(np.float64), m[b].astype(np.float64))
                out.append((qid[a], ids[b], cosine))
        if not out:
            return pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        return pd.DataFrame({"q": np.concatenate([x[0] for x in out]), "c": np.concatenate([x[1] for x in out]), "cosine": np.concatenate([x[2] for x in out])})

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 5, dims: int = 64, min_cosine: float = -1.0, id_column: str = "vec_id", vector_column: str = "vectors") -> DataFrame:
    """(vec_id, neighbour_id, cosine, place): the ``k`` most similar others of each vector, of at least ``min_cosine``."""
    spark = vectors.sparkSession
    unit = usable(vectors, dims, id_column, vector_column)
    # a window with a group limit: of each direction only k + 1 ids leave a task, however many there are
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    firsts = unit.withColumn("place", place).where(F.col("place") <= k + 1)
    groups = firsts.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    reps = written(groups.select(F.col("ids")[0].alias("rep"), "v", "ids"))
    n = reps.count()
    empty = spark.createDataFrame([], "vec_id long, neighbour_id long, cosine double, place int")
    if not n:
        return empty
    placed, blocks = _in_lists(reps, n, dims)
    spread = placed.select("rep", "v", F.posexplode("lists").alias("rank", "list")).withColumn("own", F.col("rank") < REPLICAS)
    parts = F.coalesce("parts", F.lit(1))
    cut = spread.join(blocks, "list", "left").select("rep", "v", "list", "own", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("mine"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.flatten(
        F.array(
            F.transform(every, lambda j: F.struct(F.col("mine").alias("mb"), j.alias("qb"), F.col("own").alias("member"), (j == F.col("mine")).alias("query"))),
            F.transform(F.filter(every, lambda i: i != F.col("mine")), lambda i: F.struct(i.alias("mb"), F.col("mine").alias("qb"), F.lit(False).alias("member"), F.lit(True).alias("query"))),
        )
    )
    work = cut.select("rep", "v", "list", F.inline(cells)).where("member or query")
    found = work.groupBy("list", "mb", "qb").applyInPandas(_search_list(dims, k, min_cosine), "q long, c long, cosine double")
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "c")
    near = found.repartition("q").dropDuplicates(["q", "c"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

    several = cut_lineage(reps.where(F.size("ids") > 1))
    if several.isEmpty():
        links = near.select(F.col("q").alias("a"), F.col("c").alias("b"), "cosine")
    else:
        ids = several.select("rep", "ids")
        wide = (
            near.join(ids.select(F.col("rep").alias("q"), F.col("ids").alias("qs")), "q", "left")
            .join(ids.select(F.col("rep").alias("c"), F.col("ids").alias("cs")), "c", "left")
            .select(F.explode(F.coalesce("qs", F.array("q"))).alias("a"), F.coalesce("cs", F.array("c")).alias("cs"), "cosine")
            .select("a", F.explode("cs").alias("b"), "cosine")
        )
        among = several.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b"))
        full = several.where(F.size("ids") == k + 1)
        row = unit.agg(F.count("*").alias("rows"), F.expr(f"approx_top_k(xxhash64(v), {int(1 / HOT_SHARE)}, {int(10 / HOT_SHARE)})").alias("top")).first()
        hot = F.xxhash64("v").isin([x["item"] for x in row["top"] if x["count"] >= HOT_SHARE * row["rows"]] or [None])
        hot = F.coalesce(hot, F.lit(False))
        groups = full.select("v", "ids")
        met = unit.where(~hot).join(groups.where(~hot), "v").unionByName(unit.where(hot).join(F.broadcast(groups.where(hot)), "v"))
        beyond = met.select(F.col("vec_id").alias("a"), F.explode("ids").alias("b"))
        copies = among.unionByName(beyond).where("a <> b").distinct().withColumn("cosine", F.lit(1.0))
        links = wide.unionByName(copies)
    links = links.where(F.col("cosine") >= min_cosine)
    rank = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = links.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
    return ranked.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour_id"), "cosine", "place")


def similar_pairs(vectors: DataFrame, k: int = 5, min_cosine: float = 0.8, dims: int = 64) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: at least ``min_cosine`` and one among the other's ``k`` most similar."""
    links = nearest_neighbours(vectors, k, dims, min_cosine)
    return links.select(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).distinct()
