"""Every core query against its SQL, over the whole tables of the smallest data folder."""

import re

import pytest

from glossmill import queries
from glossmill.context import table
from glossmill.sources import amr
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    ok, why = same(spark, queries.QUERIES[name], queries.SQL[name], f"{DATA}/sf0.001")
    assert ok, why


SF = f"{DATA}/sf0.001"


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: rows_of(spark, name) for name in ("extracted_subgraphs", "distinct_subgraphs", "ordered_plans", "summaries")}


def by_document(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_every_query_has_sql_or_a_test_here():
    tested = {"amr_edges", "amr_alignments", "amr_span_tops", "amr_mentions", "extracted_subgraphs", "distinct_subgraphs", "ordered_plans", "summaries", "optimised_candidates", "similarity_sweep"}
    assert set(queries.QUERIES) == set(queries.SQL) | tested and not tested & set(queries.SQL)


def test_amr_queries_agree_with_the_text_of_the_banks(spark):
    graphs = amr.read_banks(table(spark, SF, "documents")).where("error is null").collect() if "error" in amr.read_banks(table(spark, SF, "documents")).columns else amr.read_banks(table(spark, SF, "documents")).collect()
    edges = {}
    for r in rows_of(spark, "amr_edges"):
        edges.setdefault((r.doc_id, r.graph_id), []).append(r)
    vertices = {k: {x for r in es for x in (r.src, r.dst)} for k, es in edges.items()}
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").where("text like '%::id%'").collect()}
    assert len(edges) > 3
    for (doc, graph), es in edges.items():
        blocks = [b for b in re.split(r"\n\s*\n", texts[doc].replace("\r\n", "\n")) if re.search(rf"::id {re.escape(graph)}(?:\s|$)", b)]
        variables = set(re.findall(r"\((\S+) / ", "\n".join(x for x in blocks[0].split("\n") if not x.startswith("#"))))
        assert {r.src for r in es if r.role == ":instance"} == variables
    size = {(g.doc_id, g.graph_id): len(g.tokens) for g in graphs if g.tokens is not None}
    aligned = {}
    for r in rows_of(spark, "amr_alignments"):
        assert 0 <= r.i < size[r.doc_id, r.graph_id] and r.v in vertices[r.doc_id, r.graph_id]
        aligned.setdefault((r.doc_id, r.graph_id), set()).add((r.v, r.i))
    tops = rows_of(spark, "amr_span_tops")
    assert tops and all(any(v == r.top and r.l <= i < r.r for v, i in aligned[r.doc_id, r.graph_id]) for r in tops)
    mentions = rows_of(spark, "amr_mentions")
    assert mentions and all(r.r - r.l > 1 if r.multiword else r.r - r.l == 1 for r in mentions) and all(len(r.form.split()) >= 1 for r in mentions)


def test_extracted_subgraphs_are_distinct_and_hold_their_root(plans):
    for rows in by_document(plans["extracted_subgraphs"]).values():
        sets = [frozenset(r.vertices.split(",")) for r in rows]
        assert len(set(sets)) == len(sets) and all(len(x) > 1 and r.root in x for x, r in zip(sets, rows))


def test_kept_and_ordered_plans_are_extracted_ones(plans):
    whole = by_document(plans["extracted_subgraphs"])
    for name, most in (("distinct_subgraphs", 3), ("ordered_plans", 5)):
        chosen = by_document(plans[name])
        assert set(chosen) == set(whole)
        for doc, rows in chosen.items():
            assert len(rows) == min(most, len(whole[doc])) and sorted(r.place for r in rows) == list(range(len(rows)))
            assert {r.root for r in rows} <= {r.root for r in whole[doc]}
            if name == "ordered_plans":
                assert min(rows, key=lambda r: r.place).weight == max(r.weight for r in rows)


def test_summaries_are_graphs_of_the_plans(plans):
    order = by_document(plans["ordered_plans"])
    for doc, rows in by_document(plans["summaries"]).items():
        assert len(rows) == len(order[doc])
        for r in rows:
            assert amr.parse_graph("\n".join(x for x in r.amr.split("\n") if not x.startswith("#"))).edges


def test_optimised_candidates_are_distributions_of_no_less_value(spark):
    start = {(r.mention_id, r.ref): r.p for r in rows_of(spark, "mention_softmax")}
    sums = {}
    for r in rows_of(spark, "optimised_candidates"):
        assert 0 <= r.p <= 1 and (r.mention_id, r.ref) in start
        sums[r.mention_id] = sums.get(r.mention_id, 0) + r.p
    assert all(abs(x - 1) < 1e-4 for x in sums.values())


def test_the_sweep_scores_each_threshold_as_one_run_of_it(spark):
    got = {r.threshold: r for r in rows_of(spark, "similarity_sweep")}
    assert sorted(got) == [k / 10 for k in range(11)]
    for r in got.values():
        assert abs(r.f1 - 2 * r.precision * r.recall / (r.precision + r.recall)) < 1e-5


def test_core_stands_without_llm():
    import pathlib

    for p in pathlib.Path(queries.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"glossmill\.llm|from \.+llm", p.read_text()), p
