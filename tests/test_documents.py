"""Documents of one task each against the plan of DataFrames, and what they leave on disk."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glossmill import queries
from glossmill.operators import evaluation as E
from glossmill.operators import ranking as R
from glossmill.plans import disambiguation
from glossmill.plans import documents as D
from glossmill.plans import fixtures as X0

SF = "/root/testdata/sf0.001"
#: Documents of the tests: some ordinary ones, and those that are taken apart.
ODD = {"other", "another", "null", "hot"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A data folder with repeated rows, nulls, a place that two tokens share, shared and missing sentence ids, and a hot document."""
    d = str(tmp_path_factory.mktemp("odd"))
    os.symlink(f"{SF}/embeddings.parquet", f"{d}/embeddings.parquet")
    t = spark.read.parquet(f"{SF}/tokens.parquet").where("text_id <= 'd00000012'")
    one = t.where("text_id = 'd00000003'")
    named = lambda text, sent: one.withColumns({"tok_id": F.concat(F.lit(text), "tok_id"), "text_id": F.lit(text), "sent_id": sent})
    shared = [named(x, F.concat(F.lit("s"), "sent_id")) for x in ("other", "another")]
    missing = [named("null", F.lit(None).cast("string"))]
    hot = [named("hot", F.concat(F.lit("h"), "sent_id")).withColumn("tok_id", F.concat("tok_id", F.lit(str(k)))).withColumn("tok_idx", F.col("tok_idx") + k) for k in range(9)]
    some = one.limit(20)
    odd = [some.withColumn("tok_id", F.concat(F.lit("x"), "tok_id")), some.withColumns({"tok_id": F.concat(F.lit("y"), "tok_id"), "tok_idx": F.lit(None).cast("int")}), some.withColumns({"tok_id": F.concat(F.lit("z"), "tok_id"), "wf": F.lit(None).cast("string"), "pos": F.lit(None).cast("string")}), some.withColumn("text_id", F.lit(None).cast("string"))]
    out = t.unionByName(t.sample(0.5, seed=1))
    for x in [*shared, *missing, *hot, *odd]:
        out = out.unionByName(x)
    out.repartition(5).write.parquet(f"{d}/tokens.parquet")
    return d


@pytest.fixture
def cooler(monkeypatch):
    whole = D.documents_apart
    monkeypatch.setattr(D, "documents_apart", lambda rows: whole(rows, 400))


def test_documents_apart_are_hot_or_have_odd_sentences(spark, data, cooler):
    assert {r.doc_id for r in D.documents_apart(X0.token_rows(spark, data)).collect()} == ODD
    assert D.documents_apart(X0.token_rows(spark, SF)) is None


def test_similarity_sweep_scores_as_the_plan_of_dataframes(spark, data, cooler):
    got = {r.threshold: tuple(r)[1:] for r in queries.QUERIES["similarity_sweep"](spark, data).collect()}
    gold = X0.gold(spark, data).cache()
    for t in (0.0, 0.2, 1.0):
        chosen = disambiguation.disambiguate(queries._mention_inputs(spark, data), replace(queries.MENTION_OPTIONS, sim_threshold=t))
        want = E.precision_recall(chosen.select(F.col("mention_id").alias("key"), "ref"), gold).first()
        assert got[t] == pytest.approx(tuple(want), abs=1e-6)
    assert len(got) == 11


def test_ranks_of_whole_and_of_stored_matrices_are_those_of_a_document(spark, monkeypatch):
    senses = X0.senses(spark, SF)
    for personalised in (True, False):
        reader = D.Reader(senses, replace(queries.MENTION_OPTIONS, personalised=personalised))
        levels = [0.0, 0.1, 0.3, 0.7, 1.0]
        for _, tokens in list(D.unpacked(D.packed(X0.token_rows(spark, SF)).toArrow().to_batches()))[:3]:
            d = reader.read(tokens)
            for dense in (D.DENSE, 0):
                monkeypatch.setattr(D, "DENSE", dense)
                same, ranks = reader.ranks(d, levels)
                assert sorted(k for ks in same for k in ks) == list(range(5)) and len(same) > 2
                for ks, got in zip(same, ranks):
                    for k in ks:
                        m = R.row_normalise(R.fill_zeros(R.similarity_matrix(list(senses.vectors[d.refs]), list(d.group), levels[k])))
                        assert got == pytest.approx(R.power_iteration(R.transition(m, R.bias(d.w), 0.6, personalised)), abs=1e-9)


def test_the_sweep_shuffles_less_than_its_input(spark, tmp_path):
    """Records of tokens are all that moves: no candidate, vector or rank is written or shuffled."""
    records = D.packed(X0.token_rows(spark, SF))
    assert records.agg(F.sum(F.length("tokens"))).first()[0] < os.path.getsize(f"{SF}/tokens.parquet") * 1.2
    plan = queries.QUERIES["similarity_sweep"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1 and "ExistingRDD" not in plan and "Join" not in plan


def test_disambiguated_mentions_are_those_of_the_plan_of_dataframes(spark, data, cooler):
    query = queries.QUERIES["disambiguated_mentions"]
    want = disambiguation.disambiguate(queries._mention_inputs(spark, data), queries.MENTION_OPTIONS).select("doc_id", "mention_id", "ref")
    got = query(spark, data)
    assert rows(got) == rows(want) and ODD < {r.doc_id for r in got.select("doc_id").distinct().collect()}
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1 and "ExistingRDD" not in plan and "Join" not in plan


def test_system_scores_are_those_of_the_choices(spark, data, cooler):
    from glossmill.operators import candidates as C

    got = {r.system: tuple(r)[1:] for r in queries.QUERIES["system_scores"](spark, data).collect()}
    gold = X0.gold(spark, data).cache()
    ranked = disambiguation.disambiguate(queries._mention_inputs(spark, data), queries.MENTION_OPTIONS)
    for system, chosen in (("first", C.choose_first(X0.candidates(spark, data))), ("ranked", ranked)):
        want = E.precision_recall(chosen.select(F.col("mention_id").alias("key"), "ref"), gold).first()
        assert got[system] == pytest.approx(tuple(want), abs=1e-6)
    plan = queries.QUERIES["system_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1 and "ExistingRDD" not in plan and "Join" not in plan


def test_scores_without_documents_are_null(spark, tmp_path):
    os.symlink(f"{SF}/embeddings.parquet", f"{tmp_path}/embeddings.parquet")
    spark.read.parquet(f"{SF}/tokens.parquet").limit(0).write.parquet(f"{tmp_path}/tokens.parquet")
    for name, n in (("system_scores", 2), ("similarity_sweep", 11)):
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == n and all(r.precision is None and r.recall is None and r.f1 is None for r in got)
