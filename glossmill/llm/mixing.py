"""Mixing sources to target shares by entropy balancing.

Among all rates r of the documents that give each source its tokens T(s) and stay within
0 <= r <= max_repeats(s), the ones nearest to "each document once" in relative entropy are

    r = min(max_repeats(s), exp(lambda(s) * tokens / mean_tokens(s)))

with one multiplier per source. The convex dual is solved by guarded Newton steps; each step is
one distributed aggregation over the histogram (source, tokens), which is counted once. Rates
then become whole copies: a hash of the document rounds up or down, and one threshold per source,
found on a histogram of the rounding keys, makes the source's tokens meet its target.

The total is the largest for which every source can reach its share within max_repeats, so the
shares are met as nearly as whole documents allow. With a given ``total_tokens`` beyond that, a
source that runs out is used max_repeats times and the report shows the share it reached.

Defined results
---------------
* documents with null or unlisted source, and null or empty texts, take no part.
* a listed source without any text gets nothing; the others keep their shares among themselves.
* shares are taken relative to their sum; null or non-positive shares or repeats take no part.
* no document or no usable source: no rows in the mixture, zero shares in the report.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.context import cut_lineage
from glossmill.llm.tokenizer import count_tokens

#: Newton steps at most, and the relative error of a source's tokens at which they stop.
STEPS, TOLERANCE = 60, 1e-10
#: Bins of the rounding keys.
BINS = 1 << 16


def _per_source(values: dict[str, float]) -> Column:
    """The value of the row's source as an expression; one literal a source."""
    column = F.lit(None).cast("double")
    for source, value in values.items():
        column = F.when(F.col("source") == source, F.lit(float(value))).otherwise(column)
    return column


def solve_dual(histogram: DataFrame, goals: dict[str, float], caps: dict[str, float], means: dict[str, float], full: dict[str, float]) -> dict[str, float]:
    """Multiplier of each source; infinity where all its documents are used max_repeats times."""
    x = {s: 0.0 for s in goals}
    low = {s: -math.inf for s in goals}
    high = {s: math.inf for s in goals}
    done = {s: math.inf for s in goals if goals[s] >= full[s] * (1 - 1e-9)}
    open_ = [s for s in goals if s not in done]
    size = F.col("n_tokens") / _per_source(means)
    for _ in range(STEPS):
        if not open_:
            break
        tilt = F.exp(F.least(_per_source({s: x[s] for s in open_}) * size, F.lit(700.0)))
        cap = _per_source({s: caps[s] for s in open_})
        tokens = F.col("n") * F.col("n_tokens")
        sums = histogram.where(F.col("source").isin(open_)).groupBy("source").agg(
            F.sum(tokens * F.least(tilt, cap)).alias("value"),
            F.sum(F.when(tilt < cap, tokens * size * tilt).otherwise(0.0)).alias("slope"),
        )
        for source, value, slope in sums.collect():  # one row a source of the target table
            if abs(value - goals[source]) <= TOLERANCE * goals[source]:
                done[source] = x[source]
                continue
            if value < goals[source]:
                low[source] = x[source]
            else:
                high[source] = x[source]
            step = x[source] - (value - goals[source]) / slope if slope > 0 else math.nan
            if not low[source] < step < high[source] or math.isnan(step):
                a, b = low[source], high[source]
                step = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else 2 * a + 1 if math.isfinite(a) else 2 * b - 1
            x[source] = step
        open_ = [s for s in open_ if s not in done]
    return {s: done.get(s, x[s]) for s in goals}


def mix_sources(documents: DataFrame, targets: DataFrame, path: str | None = None, total_tokens: float | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents that are used."""
    spark = documents.sparkSession
    wanted = {
        r["source"]: (r["target_share"], r["max_repeats"])
        for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()  # the table of targets
    }
    listed = documents.where(F.col("source").isin(list(wanted)) & (F.length("text") > 0))
    sized = cut_lineage(count_tokens(listed, ["doc_id", "source"], path).where("n_tokens > 0"))
    histogram = cut_lineage(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    have = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("docs")).collect()}
    if not have:
        return spark.createDataFrame([], "doc_id long, source string, n_tokens long, copies int")
    whole = sum(wanted[s][0] for s in have)
    share = {s: wanted[s][0] / whole for s in have}
    caps = {s: float(wanted[s][1]) for s in have}
    full = {s: caps[s] * have[s]["tokens"] for s in have}
    means = {s: have[s]["tokens"] / have[s]["docs"] for s in have}
    total = total_tokens or min(full[s] / share[s] for s in have)
    goals = {s: min(share[s] * total, full[s]) for s in have}
    multipliers = solve_dual(histogram, goals, caps, means, full)
    cap = _per_source(caps)
    tilt = F.exp(F.least(_per_source({s: min(m, 1e9) for s, m in multipliers.items()}) * F.col("n_tokens") / _per_source(means), F.lit(700.0)))
    rate = F.least(tilt, cap)
    uniform = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rated = sized.withColumn("rate", rate).withColumn("least", F.floor("rate"))
    key = F.floor((F.col("rate") - F.col("least") - uniform + 1) * (BINS // 2)).cast("int")
    keyed = rated.withColumn("bin", F.when(F.col("least") < cap, key))
    bins = keyed.groupBy("source", "bin").agg(F.sum("n_tokens").alias("more"), F.sum(F.col("least") * F.col("n_tokens")).alias("sure"))
    table = cut_lineage(bins)
    sure = {r[0]: r[1] for r in table.groupBy("source").agg(F.sum("sure")).collect()}
    need = {s: goals[s] - sure[s] for s in have}
    # how far each threshold misses; a window of at most BINS rows a source
    above = F.sum("more").over(Window.partitionBy("source").orderBy(F.desc("bin")))
    missed = table.where("bin is not null").withColumn("miss", F.abs(above - _per_source(need)))
    best = {r["source"]: (r["bin"], r["miss"]) for r in missed.groupBy("source").agg(F.min_by("bin", F.struct("miss", "bin")).alias("bin"), F.min("miss").alias("miss")).collect()}
    threshold = {s: float(b) if m < abs(need[s]) else float(BINS + 1) for s, (b, m) in best.items()}
    up = F.coalesce(F.col("bin") >= _per_source(threshold), F.lit(False))
    copies = (F.col("least") + up.cast("int")).cast("int").alias("copies")
    return keyed.select("doc_id", "source", "n_tokens", copies).where("copies > 0")


def reached_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a source of ``targets``: target and actual share, tokens and copies used.

    ``used_up`` marks the source whose documents are all used max_repeats times: it sets the total, and
    only more of its text would make the mixture larger.
    """
    used = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"),
        F.sum("copies").alias("n_copies"),
        F.max("copies").alias("most_copies"),
        F.count("*").alias("n_docs"),
    )
    total = used.agg(F.sum("mixed_tokens")).first()[0] or 0
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("mixed_tokens", "n_copies", "n_docs", "most_copies")]
    share = F.coalesce(F.col("mixed_tokens") / F.lit(float(total or 1)), F.lit(0.0)).alias("actual_share")
    return targets.select("source", "target_share", "max_repeats").join(used, "source", "left").select("source", "target_share", "max_repeats", share, *zero, F.coalesce(F.col("n_copies") == F.col("n_docs") * F.col("max_repeats"), F.lit(False)).alias("used_up"))
