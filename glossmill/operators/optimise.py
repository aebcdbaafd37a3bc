"""Candidate weights by optimisation: softmax distributions, objective values, conjugate gradient."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.operators.ranking import similarity_matrix


def mention_softmax(candidates: DataFrame, score: str = "score") -> DataFrame:
    """Candidates with ``p``: softmax of the score within the mention, shifted by its maximum."""
    w = Window.partitionBy("doc_id", "mention_id")
    e = candidates.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def salience_value(candidates: DataFrame) -> DataFrame:
    """(doc_id, value): sum of p times the relevance of the meaning."""
    return candidates.groupBy("doc_id").agg(F.sum(F.col("p") * F.coalesce("relevance", F.lit(0.0))).alias("value"))


def type_value(candidates: DataFrame) -> DataFrame:
    """(doc_id, value): sum of p over the candidates whose type fits the mention's."""
    fits = F.coalesce((F.col("mention_type") == F.col("type")) & (F.col("mention_type") != ""), F.lit(False))
    return candidates.groupBy("doc_id").agg(F.sum(F.when(fits, F.col("p")).otherwise(0.0)).alias("value"))


class Coherence:
    """Value and gradient of sum p_i p_j s_ij over the candidates of different mentions, as a function of raw scores."""

    def __init__(self, s: np.ndarray, mention: np.ndarray, relevance: np.ndarray | None = None) -> None:
        self.s = np.where(mention[:, None] != mention[None, :], s, 0.0)
        np.fill_diagonal(self.s, 0.0)
        self.mention = mention
        self.relevance = np.zeros(len(mention)) if relevance is None else relevance

    def distribution(self, x: np.ndarray) -> np.ndarray:
        top = np.full(self.mention.max() + 1, -np.inf)
        np.maximum.at(top, self.mention, x)
        e = np.exp(x - top[self.mention])
        return e / np.bincount(self.mention, weights=e)[self.mention]

    def value(self, x: np.ndarray) -> float:
        p = self.distribution(x)
        return float(p @ self.s @ p + p @ self.relevance)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        p = self.distribution(x)
        g = (self.s + self.s.T) @ p + self.relevance
        return p * (g - np.bincount(self.mention, weights=p * g)[self.mention])


def ascend(f: Coherence, x: np.ndarray, steps: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Conjugate gradient ascent with a backtracking line search."""
    g = f.gradient(x)
    d, value = g.copy(), f.value(x)
    for _ in range(steps):
        slope = float(g @ d)
        if slope <= 0:
            d, slope = g.copy(), float(g @ g)
        if slope < tolerance:
            break
        t = 1.0
        while t > 1e-10 and f.value(x + t * d) < value + 1e-4 * t * slope:
            t /= 2
        if t <= 1e-10:
            break
        x = x + t * d
        value, fresh = f.value(x), f.gradient(x)
        beta = max(0.0, float(fresh @ (fresh - g)) / max(float(g @ g), 1e-300))
        d, g = fresh + beta * d, fresh
    return x


def optimise_candidates(candidates: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(doc_id, mention_id, ref, p) that maximise coherence plus salience, a document at a time.

    ``candidates(doc_id, mention_id, ref, score, relevance, vec)``.
    """
    types = {c: candidates.schema[c].dataType.simpleString() for c in ("doc_id", "mention_id", "ref")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["mention_id", "ref"], kind="stable").reset_index(drop=True)
        s = similarity_matrix(list(p["vec"]), list(range(len(p))), threshold)
        f = Coherence(s, pd.factorize(p["mention_id"])[0], p["relevance"].fillna(0.0).to_numpy(dtype=float))
        x = ascend(f, p["score"].fillna(0.0).to_numpy(dtype=float))
        return p[["doc_id", "mention_id", "ref"]].assign(p=f.distribution(x))

    return candidates.groupBy("doc_id").applyInPandas(run, ", ".join(f"{k} {v}" for k, v in types.items()) + ", p double")


def coherence_values(candidates: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(doc_id, value) of the coherence of given distributions ``p``."""
    doc = candidates.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["mention_id", "ref"], kind="stable").reset_index(drop=True)
        s = similarity_matrix(list(p["vec"]), list(range(len(p))), threshold)
        f = Coherence(s, pd.factorize(p["mention_id"])[0])
        q = p["p"].to_numpy(dtype=float)
        return pd.DataFrame({"doc_id": [p["doc_id"].iloc[0]], "value": [float(q @ f.s @ q)]})

    return candidates.groupBy("doc_id").applyInPandas(run, f"doc_id {doc}, value double")
