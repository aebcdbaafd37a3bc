"""Core operators: edge cases, brute force and invariants on small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.functions import text as T
from glossmill.functions import vectors as V
from glossmill.functions.wordlists import function_words, read_words, stop_words
from glossmill.operators import graph as G
from glossmill.operators import optimise as O
from glossmill.operators import planning as P
from glossmill.operators import ranking as R
from glossmill.operators import rejects, shredding
from glossmill.operators import spans as S
from glossmill.options import Options
from glossmill.sources import amr, readers, sinks

# --- rejected lines ---------------------------------------------------------------------------

LINES = [
    ("a 1 2", None), ("a 1 2  \r", None), ("a -.5 +1e-3", None), ('"a b" 1 2', None), ('"a ""q"" b" 1 2', None),
    ("a 1", "columns"), ("a 1 2 3", "columns"), ("a  1 2", "columns"), ("", "columns"), ("   ", "columns"), (None, "columns"), ("a\t1\t2", "columns"),
    (" 1 2", "value"), ('"" 1 2', "value"), ("a nan 2", "value"), ("a 1e999 2", "value"), ("a 1_0 2", "value"), ("a ٠ 2", "value"), ("a . 2", "value"), ("a 1, 2", "value"),
    ('"a 1 2', "quoting"), ('a"b 1 2', "quoting"), ('"a"b 1 2', "quoting"), ('"a b" 1 "2"', "quoting"),
]


def test_rejects_each_reason_once(spark):
    rows = [(1, i + 2, line, "x") for i, (line, _) in enumerate(LINES)]
    lines = spark.createDataFrame(rows + rows[:5] + [(1, 1, "9 2", "x"), (9, 1, "a 1 2", "x")], "file_id long, line_no long, line string, num_dimensions string")
    files = spark.createDataFrame([(1, 2, "Text_Glove")] * 2, "file_id long, num_dimensions int, vector_type string")
    got = {(r.file_id, r.line_no): r.reason for r in rejects.rejected_lines(lines, files).collect()}
    assert got == {(1, i + 2): why for i, (_, why) in enumerate(LINES) if why} | {(9, 1): "columns"}
    assert rejects.loaded_lines(lines, files).count() == sum(why is None for _, why in LINES)


def test_rejects_of_an_empty_table(spark):
    lines = spark.createDataFrame([], "file_id long, line_no long, line string")
    files = spark.createDataFrame([], "file_id long, num_dimensions int, vector_type string")
    assert rejects.rejected_lines(lines, files).count() == 0


def test_bulk_parse_agrees_with_the_strict_reading():
    import pyarrow as pa

    rng = random.Random(1)
    for _ in range(300):
        block = [rng.choice(LINES)[0] for _ in range(rng.randint(1, 4))]
        good = all(rejects.diagnose(x, 2)[2] is None for x in block)
        parsed = rejects.bulk_parse(pa.array(block, pa.string()), 2)
        assert parsed is None or good
        if parsed is not None:
            assert parsed[1].tolist() == [rejects.diagnose(x, 2)[1] for x in block]


# --- nested records ---------------------------------------------------------------------------


def brute(payload):
    """Places of all records by plain recursion."""
    out, names = [], [("texts", "text"), ("sentences", "sentence"), ("tokens", "wf")]

    def walk(x, depth, at):
        for k, r in enumerate(shredding.as_array(x)):
            place = (*at, k)
            out.append(place + (-1,) * (3 - len(place)))
            if depth < 2 and isinstance(r, dict):
                walk(next((r[n] for n in names[depth + 1] if r.get(n) is not None), None), depth + 1, place)

    v = json.loads(payload) if payload and payload.strip() else {}
    v = v.get("corpus") or v
    walk(next((v[n] for n in names[0] if v.get(n) is not None), None), 0, ())
    return sorted(out)


def random_payload(rng):
    def many(make):
        return rng.choice([None, [], make(), [make() for _ in range(rng.randint(1, 3))], json.dumps([make()]), [None, make()]])

    token = lambda: rng.choice(["word", {"wf": "a"}, {}, {"wf": {"x": 1}, "tokens": [1]}])
    sentence = lambda: rng.choice([{}, {"tokens": many(token)}, {"wf": many(token), "id": "s"}])
    text = lambda: rng.choice([{"id": None}, {"sentences": many(sentence)}, {"sentence": many(sentence), "meta": {"tokens": [1, 2]}}])
    v = {rng.choice(["text", "texts"]): many(text), "meta": {"texts": 3}}
    return json.dumps(rng.choice([v, {"corpus": v}]))


def test_shredding_matches_recursion(spark):
    rng = random.Random(7)
    payloads = [random_payload(rng) for _ in range(150)] + [None, "", " ", "{", "[]", "null"]
    df = spark.createDataFrame([(i, None, p) for i, p in enumerate(payloads)] * 2, "batch_id long, texts array<struct<id:string>>, payload string")
    got = {}
    for r in shredding.shred_batches(df).collect():
        got.setdefault(r.batch_id, []).append((r.text_no, r.sentence_no, r.token_no))
    for i, p in enumerate(payloads[:150]):
        assert sorted(got.get(i, [])) == brute(p), p
    assert not any(i in got for i in range(150, len(payloads)))


def test_nested_columns_and_payloads_give_the_same_streams(spark):
    rng = random.Random(8)
    word = lambda: rng.choice([None, {"id": rng.choice([None, "k"]), "lemma": "l", "pos": None, "wf": rng.choice(["w", ""])}])
    several = lambda make: rng.choice([None, [], [make() for _ in range(rng.randint(1, 4))]])
    sentence = lambda: rng.choice([None, {"id": "s", "tokens": several(word)}])
    text = lambda: rng.choice([None, {"id": rng.choice(["t", None]), "sentences": several(sentence)}])
    rows = [several(text) for _ in range(200)]
    schema = "array<struct<id:string,sentences:array<struct<id:string,tokens:array<struct<id:string,lemma:string,pos:string,wf:string>>>>>>"
    nested = spark.createDataFrame([(i, r, None) for i, r in enumerate(rows)], f"batch_id long, texts {schema}, payload string")
    walked = spark.createDataFrame([(i, None, json.dumps({"texts": r})) for i, r in enumerate(rows)], f"batch_id long, texts {schema}, payload string")
    a, b = (sorted(map(repr, shredding.shred_batches(df).collect())) for df in (nested, walked))
    assert a == b and len(a) > 100
    column = nested.orderBy("batch_id").toArrow().column("texts").combine_chunks()
    walk = shredding.LevelStreams()
    for r in rows:
        walk.add(shredding.as_array(r))
    for x, y in zip(shredding.nested_streams(column), walk.streams()):
        assert all(list(p) == list(q) for p, q in zip(x[:2], y[:2])) and x[2].to_pylist() == y[2].to_pylist()


# --- text, vectors, spans -----------------------------------------------------------------------


def test_word_lists(tmp_path):
    words = function_words()
    assert {"the", "whom", "upon", "n't", "'s", "could"} <= words and not {"well", "world", ""} & words and len(words) < 200
    (tmp_path / "w").write_text("Zum zur\nbeim\n", encoding="utf-8")
    assert read_words(str(tmp_path / "w")) == {"zum", "zur", "beim"} and stop_words(str(tmp_path / "w")) == words | {"zum", "zur", "beim"}


def test_text_expressions_take_nulls(spark):
    row = spark.createDataFrame([(None, ""), ("the", "a  b c")], "a string, b string").select(
        T.is_content_word(F.col("a")).alias("c"), T.gloss_tokens(F.col("a")).alias("g"), T.truncate_words(F.col("b"), 2).alias("t")
    )
    assert [tuple(r) for r in row.collect()] == [(False, [], ""), (False, ["the"], "a ")]


def test_cosine_is_null_where_undefined(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def test_spans_reach_the_last_token(spark):
    t = spark.createDataFrame([("d", "s", i, f"w{i}", None, "N") for i in range(3)], "doc_id string, sent_id string, i int, form string, lemma string, pos string")
    assert S.mentions(t, 2).count() == 5
    assert S.mentions(t, 2, skip_last=1).count() == 3
    assert S.mentions(t.limit(0), 2).count() == 0


# --- ranking ------------------------------------------------------------------------------------


def test_ranks_sum_to_one_and_follow_the_bias():
    s = np.array([[1, 0.8, 0.7], [0.8, 1, 0.2], [0.7, 0.2, 1]])
    x = R.row_normalise(R.fill_zeros(s))
    assert np.allclose(x.sum(1), 1)
    b = R.bias(np.array([0.1, 0.1, 0.8]))
    v = R.power_iteration(R.transition(x, b, 0.6), epsilon=1e-12)
    w = R.power_iteration(R.transition(x, b, 0.6, personalised=False), epsilon=1e-12)
    assert abs(v.sum() - 1) < 1e-9 and v.argmax() == 2 and w.argmax() == 0
    assert R.bias(np.zeros(4)).tolist() == [0.25] * 4


def test_similarity_matrix_groups_thresholds_and_missing_vectors():
    s = R.similarity_matrix([[1, 0], [1, 0], None, [0, 1]], ["a", "a", "b", "c"], 0.5)
    assert s.tolist() == np.eye(4).tolist()
    assert R.similarity_matrix([[1, 0], [1, 0.1]], ["a", "b"], 0.5)[0, 1] > 0.9


def random_meanings(rng, n, dims=6):
    vec = lambda: None if rng.random() < 0.1 else [rng.gauss(0.3, 1) for _ in range(dims)]
    return [(i, rng.random(), rng.choice("abcdef") + str(i % 9), vec()) for i in range(n)]


def test_sparse_entries_and_ranks_agree_with_dense_matrices():
    rng = random.Random(4)
    for n in (1, 2, 7, 60, 700):
        rows = random_meanings(rng, n)
        vecs, groups, w = [r[3] for r in rows], [r[2] for r in rows], np.array([r[1] for r in rows])
        for threshold in (-1.0, 0.0, 0.4, 1.2):
            dense = R.similarity_matrix(vecs, groups, threshold)
            i, j, s = R.stored_entries(vecs, groups, threshold)
            made = np.zeros((n, n))
            made[i, j] = s
            assert np.allclose(made, dense)
            x = R.row_normalise(R.fill_zeros(dense))
            fill, sums = R.filled_rows(n, i, s)
            over = np.divide(1.0, sums, out=np.zeros(n), where=sums > 0)
            for personalised in (True, False):
                want = R.power_iteration(R.transition(x, R.bias(w), 0.6, personalised))
                got = R.sparse_iteration(R.bias(w), i, j, (s - fill) * over[i], fill * over, 0.6, personalised, R.MAX_STEPS, None)
                assert np.allclose(got, want, atol=1e-12)


def test_split_documents_rank_as_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(R, "SPLIT_BLOCK", 20)
    rng = random.Random(5)
    rows = [(d, *r) for d, n in (("big", 90), ("small", 12), ("wide", 70)) for r in random_meanings(rng, n)]
    df = spark.createDataFrame(rows, "doc_id string, ref int, w double, ms string, vec array<double>")
    large = R.large_documents(df, 50)
    assert {r.doc_id for r in large.collect()} == {"big", "wide"} and R.large_documents(df, 100) is None
    for options in (Options(sim_threshold=0.3), Options(sim_threshold=0.3, personalised=False)):
        a = {(r.doc_id, r.ref): r["rank"] for r in R.rank_meanings(df, options).collect()}
        b = {(r.doc_id, r.ref): r["rank"] for r in R.rank_meanings(df, options, large=large).collect()}
        assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-10 for k in a)
    v = df.select("doc_id", F.col("ref").alias("v"), "w").where("v % 11 <> 3")
    e = spark.createDataFrame([(d, rng.randrange(60), rng.randrange(60), "r") for d in ("big", "small", "wide") for _ in range(120)], "doc_id string, src int, dst int, role string")
    a = {(r.doc_id, r.v): r["rank"] for r in R.rank_vertices(v, e).collect()}
    b = {(r.doc_id, r.v): r["rank"] for r in R.rank_vertices(v, e, large=large).collect()}
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-10 for k in a)


def test_a_document_of_20000_meanings_is_ranked_without_its_matrix():
    rng = np.random.default_rng(6)
    n = 20_000
    v = rng.normal(size=(n, 16))
    i, j, s = R.stored_entries(list(v), [str(k) for k in range(n)], 0.75)
    fill, sums = R.filled_rows(n, i, s)
    ranks = R.sparse_iteration(np.full(n, 1 / n), i, j, (s - fill) / sums[i], fill / sums, 0.6, True, R.MAX_STEPS, None)
    assert len(i) < n * n / 100 and abs(ranks.sum() - 1) < 1e-9


# --- graphs ---------------------------------------------------------------------------------------


def test_components_of_paths_stars_and_loners(spark):
    edges = [(1, i, i + 1, "r") for i in range(40)] + [(1, 100, k, "r") for k in range(101, 130)] + [(2, 5, 5, "r")]
    vs = [(1, i) for i in [*range(41), *range(100, 130), 500]] + [(2, 5)]
    got = {(r.doc_id, r.v): r.component for r in G.components(spark.createDataFrame(vs, "doc_id int, v int"), spark.createDataFrame(edges, "doc_id int, src int, dst int, role string")).collect()}
    want = {(d, v): 0 if v <= 40 and d == 1 else 100 if 100 <= v < 130 else v for d, v in vs}
    assert got == want
    v, e = spark.createDataFrame(vs, "doc_id int, v int"), spark.createDataFrame(edges, "doc_id int, src int, dst int, role string")
    assert {(r.doc_id, r.v): r.component for r in G.components(v, e, most=10).collect()} == want


def test_components_and_depths_of_a_path_longer_than_any_count_of_rounds(spark):
    n = 66
    e = spark.createDataFrame([(1, i, i + 1) for i in range(n)], "doc_id int, src int, dst int")
    v = spark.createDataFrame([(1, i) for i in range(n + 1)], "doc_id int, v int")
    assert {r.component for r in G.components(v, e, most=5).collect()} == {0}
    assert {r.v: r.depth for r in G.depths(v.where("v = 0"), e).collect()} == {i: i for i in range(n + 1)}


def test_contraction_drops_inner_edges(spark):
    e = spark.createDataFrame([("d", "a", "b", "x"), ("d", "b", "c", "y"), ("d", "c", "a", "z")], "doc_id string, src string, dst string, role string")
    m = spark.createDataFrame([("d", "b", "a")], "doc_id string, v string, into string")
    assert sorted((r.src, r.dst) for r in G.contract(e, m).collect()) == [("a", "c"), ("c", "a")]


def plan5():
    return P.Graph(
        weights={"v1": 0.5, "v2": 0.1, "n1": 0.3, "n2": 0.2, "m": 0.4},
        edges={("v1", "n1"): ":ARG0", ("v1", "n2"): ":ARG1", ("v2", "n2"): ":ARG0", ("n1", "m"): ":location"},
        sources={k: frozenset(["s1"]) for k in ("v1", "n1", "n2", "m")} | {"v2": frozenset(["s2"])},
        verbs=frozenset(["v1", "v2"]),
    )


def test_extraction_takes_what_verbs_need():
    g = plan5()
    starts = {s.root: s.vertices for s in P.start_states(g, "non_core")}
    assert starts["v1"] == {"v1", "n1", "n2"} and starts["v2"] == {"v2"}
    found = P.extract(g, 5)
    assert {"v1", "n1", "n2", "m"} in [set(s.vertices) for s, _ in found]
    assert P.extract(g, 5, choose=P.soft_max(0.01), seed=4) == P.extract(g, 5, choose=P.soft_max(0.01), seed=4)


def test_trees_similarity_redundancy_and_order():
    edges = {("a", "b"): "x", ("a", "c"): "y", ("b", "d"): "z", ("c", "d"): "z"}
    t = P.unfold(frozenset("abcd"), edges, {v: v for v in "abcd"})
    assert [n.label for n in t.preorder()] == ["a", "b", "d", "c", "d"]
    same = lambda a, b: float(a == b)
    other = P.unfold(frozenset("ab"), edges, {"a": "p", "b": "q"})
    assert P.tree_similarity(t, t, same) == 1.0 and P.tree_similarity(t, other, same) < 0.6
    sim = np.array([[1, 1, 0.2], [1, 1, 0.2], [0.2, 0.2, 1]])
    assert P.remove_redundant(sim, [0.5, 0.4, 0.3], 2) == [0, 2]
    assert P.discourse_order(sim, [0.1, 0.9, 0.5])[0] == 1 and P.discourse_order(np.eye(0), []) == []
    chain = {(f"{k}{a}", f"{k + 1}{b}"): "r" for k in range(6) for a in "ab" for b in "ab"}
    names = frozenset(v for e in chain for v in e)
    assert P.unfold(names, chain, {}).size() > P.unfold(names, chain, {}, 4).size() >= 4 * len(names)


def test_redundancy_and_order_follow_their_plain_rules():
    rng = random.Random(11)
    for _ in range(60):
        n = rng.randint(1, 9)
        sim = np.array([[rng.choice([0.1, 0.5, 0.5, 0.9]) for _ in range(n)] for _ in range(n)])
        sim = np.maximum(sim, sim.T)
        w = [rng.choice([0.2, 0.4, 0.4, 0.8]) for _ in range(n)]
        keep = rng.randint(0, n)
        left = set(range(n))
        for _, i, j in sorted((-sim[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
            if len(left) > keep and {i, j} <= left:
                left.discard(i if w[i] < w[j] else j)
        assert P.remove_redundant(sim, w, keep) == sorted(left)
        order = sorted(range(n), key=lambda i: (-w[i], i))
        taken = order[:1]
        while len(taken) < n:
            taken.append(max((i for i in order if i not in taken), key=lambda j: (max(sim[i, j] for i in taken) + w[j], -order.index(j))))
        assert P.discourse_order(sim, w) == taken


def test_edit_distance_counts_single_edits():
    leaf = lambda x, *c: P.Node(x, "", x, c)
    cost = lambda a, b: float(a.label != b.label)
    assert P.edit_distance(leaf("a", leaf("b"), leaf("c")), leaf("a", leaf("b")), cost) == 1
    assert P.edit_distance(leaf("a", leaf("b", leaf("c"))), leaf("a", leaf("c")), cost) == 1


def test_optimisation_gradient_and_ascent():
    rng = np.random.default_rng(0)
    s = rng.random((6, 6))
    f = O.Coherence(s + s.T, np.array([0, 0, 1, 1, 2, 2]), rng.random(6))
    x = rng.normal(size=6)
    num = [(f.value(x + 1e-6 * e) - f.value(x - 1e-6 * e)) / 2e-6 for e in np.eye(6)]
    assert np.allclose(f.gradient(x), num, atol=1e-6)
    y = O.ascend(f, x)
    assert f.value(y) >= f.value(x) and np.allclose(np.bincount(f.mention, weights=f.distribution(y)), 1)


# --- AMR and files ----------------------------------------------------------------------------------

BANK = """# ::id a.1
# ::tok The boy wants to go
# ::alignments 1-1.1 2-1 4-1.2
(w / want-01
   :ARG0 (b / boy)
   :ARG1 (g / go-01
      :ARG0 b))

# ::id a.2
# ::tok Rome fell
# ::alignments 0-1|0.0+0.0.0+0.0.0.0 1-2|0
(f / fall-01
   :ARG1 (c / city :name (n / name :op1 "Rome")))

# ::id bad
# ::tok x
# ::alignments 0-1
(x / broken
"""


def test_amr_banks(spark):
    graphs = amr.read_banks(spark.createDataFrame([(1, BANK), (2, None), (3, "")], "doc_id int, text string"))
    t = amr.graph_tables(graphs)
    edges = {(r.graph_id, r.src, r.role, r.dst) for r in t["edges"].collect()}
    assert {("a.1", "w", ":ARG0", "b"), ("a.1", "g", ":ARG0", "b"), ("a.2", "n", ":op1", '"Rome"')} <= edges
    aligned = {(r.graph_id, r.v, r.i) for r in t["alignments"].collect()}
    assert {("a.1", "b", 1), ("a.1", "w", 2), ("a.1", "g", 4), ("a.2", "c", 0), ("a.2", '"Rome"', 0), ("a.2", "f", 1)} <= aligned
    assert [r.graph_id for r in t["errors"].collect()] == ["bad"]


def test_amr_round_trip():
    g = amr.parse_graph('(w / want-01 :ARG0 (b / boy~e.1 :mod "x") :ARG1 (g / go-01 :ARG0 b :quant 3))')
    assert g.aligned == [("b", 1)]
    concepts = {s: d for s, r, d in g.edges if r == ":instance"}
    text = amr.write_graph(g.root, [e for e in g.edges if e[1] != ":instance"], concepts)
    again = amr.parse_graph(text)
    forward = lambda x: {(d, r[:-3], s) if r.endswith("-of") else (s, r, d) for s, r, d in x.edges}
    assert forward(again) == forward(g)
    with pytest.raises(ValueError):
        amr.parse_graph("(a / b")


def test_written_graphs_have_short_variables_and_plain_constants():
    edges = [("bank_1.1_s", ":ARG0", "bank_1.2_s"), ("bank_1.1_s", ":quant", 'bank_1.1_"5"_2'), ("bank_1.2_s", ":mod", "odd name")]
    text = amr.write_graph("bank_1.1_s", edges, {"bank_1.1_s": "say-01", "bank_1.2_s": "person"})
    back = amr.parse_graph(text)
    assert len(back.variables) == 3 and '"5"' in text and "bank" not in text and {r for _, r, _ in back.edges} == {":ARG0", ":quant", ":mod", ":instance"}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "w.txt").write_text("a 1.5\nb x\nc 2\n")
    assert {(r.item, r.w) for r in readers.weights_file(spark, str(tmp_path / "w.txt")).collect()} == {("a", 1.5), ("c", 2.0)}
    (tmp_path / "v.txt").write_text("a 1 2\na 3 4\nb 1\n")
    assert [tuple(r) for r in readers.vector_file(spark, str(tmp_path / "v.txt"), 2).collect()] == [("a", [3.0, 4.0])]
    (tmp_path / "g.tsv").write_text("t1\tt1\tbn:1\tbn:2\nt1\tt2\tbn:3\nx\n")
    assert {(r.key, tuple(r.refs)) for r in readers.gold_tsv(spark, str(tmp_path / "g.tsv")).collect()} == {("t1", ("bn:1", "bn:2")), ("t1-t2", ("bn:3",))}
    (tmp_path / "f.json").write_text('{"docs": 2, "mentions": {"x": [["m", "3"]]}, "meanings": {"m": 3}}')
    assert readers.frequencies_json(spark, str(tmp_path / "f.json"))["form_meanings"].collect()[0].n == 3
    forms = spark.createDataFrame([('a"b', "m1", 2), ('a"b', "m2", 1), ("ü", "m1", 4)], "form string, ref string, n long")
    counts = spark.createDataFrame([("m1", 6), ("m2", 1)], "ref string, n long")
    sinks.write_frequencies_json(9, forms, counts, str(tmp_path / "freq"))
    back = readers.frequencies_json(spark, str(tmp_path / "freq"))
    assert back["docs"].first()[0] == 9 and {tuple(r) for r in back["form_meanings"].collect()} == {tuple(r) for r in forms.collect()} and {tuple(r) for r in back["meanings"].collect()} == {tuple(r) for r in counts.collect()}
    (tmp_path / "many.tsv").write_text("t1\tt1\t" + "\t".join(f"bn:{i}" for i in range(1500)) + "\n")
    assert len(readers.gold_tsv(spark, str(tmp_path / "many.tsv")).first().refs) == 1500
    (tmp_path / "texts").mkdir()
    for name, text in (("b.GOLD", '\nbn:00000001n|bn:00000002v-"x y"\n'), ("a.gold", 'bn:00000003r-"z"'), ("c.txt", 'bn:00000004a-"no"')):
        (tmp_path / "texts" / name).write_text(text)
    gold = readers.gold_rankings(readers.text_files(spark, str(tmp_path / "texts"), ".gold")).collect()
    assert [(r.doc_id, r.alternatives, r.covered) for r in gold] == [("a", ["bn:00000003r"], "z"), ("b", ["bn:00000001n", "bn:00000002v"], "x y")]
    tokens = spark.createDataFrame([("d1", "d1.s1", i, f"d1.s1.t{i}", w, w, "NN") for i, w in enumerate(("a", "b"))], "text_id string, sent_id string, i int, tok_id string, form string, lemma string, pos string")
    sinks.write_corpus_xml(tokens, str(tmp_path / "xml"))
    back = readers.annotated_corpus(spark, str(tmp_path / "xml"))
    assert [(r.tok_id, r.form, r.pos) for r in back.orderBy("i").collect()] == [("d1.s1.t0", "a", "N"), ("d1.s1.t1", "b", "N")]


def test_stream_of_tokens(spark, tmp_path):
    from glossmill.streaming.ingest import rank_stream, token_stream

    t = spark.createDataFrame([("d", "a"), ("d", "b")], "doc_id string, form string")
    t.write.parquet(str(tmp_path / "in"))
    q = rank_stream(token_stream(spark, str(tmp_path / "in"), t.schema), lambda b: b.groupBy("doc_id").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_options_are_frozen():
    with pytest.raises(Exception):
        Options().sim_threshold = 1


TWO_SENTENCES = """# ::id a.1
# ::tok The boy saw Rome station
# ::alignments 1-1.1 2-1 3-1.2.1 4-1.2
(s / see-01
   :ARG0 (b / boy)
   :ARG1 (t / station
      :mod (r / rome)))

# ::id a.2
# ::tok A boy left
# ::alignments 1-1.1 2-1
(l / leave-01
   :ARG0 (b / boy))
"""


def test_global_graph_chooses_collapses_and_merges(spark):
    from glossmill.plans import disambiguation, fixtures, summary

    refs = {"boy": 1, "saw": 2, "rome": 3, "station": 4, "rome station": 5, "left": 6}

    def senses(words, mentions):
        vec = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.6, 0.8], 4: [0.8, 0.6], 5: [1.0, 0.1], 6: [0.1, 1.0]}
        dictionary = spark.createDataFrame([(w, 1, r) for w, r in refs.items()], "lemma string, sense_rank int, ref int")
        meanings = spark.createDataFrame([(r, False, v) for r, v in vec.items()], "ref int, is_ne boolean, vec array<double>")
        return disambiguation.Inputs(words, dictionary, meanings, spark.createDataFrame([("boy", [1.0, 0.0])], "item string, vec array<double>"), 2)

    documents = spark.createDataFrame([(1, TWO_SENTENCES)], "doc_id int, text string")
    options = Options(min_context_freq=1)
    tables = summary.bank_graphs(documents, senses=senses, coref=fixtures.coreference, options=options)
    vs = {r.v: r for r in tables["vertices"].collect()}
    boy = {v for v in vs if v.endswith("_b")}
    assert len(boy) == 1 and vs[boy.pop()].sources == ["a.1", "a.2"]
    assert vs["a.1_t"].meaning == "5" and "a.1_r" not in vs and vs["a.1_t"].w > 0 and vs["a.1_t"].vec is not None
    assert {(r.src, r.role) for r in tables["edges"].collect()} == {("a.1_s", ":ARG0"), ("a.1_s", ":ARG1"), ("a.2_l", ":ARG0")}
    plans = summary.plan_banks(documents, senses, fixtures.coreference, options).collect()
    assert any({v[:3] for v in p.vertices} == {"a.1", "a.2"} for p in plans)


def test_similarity_sweep_ranks_and_scores_anew(spark):
    from glossmill import queries

    d = "/root/testdata/sf0.001"
    got = {r.threshold: r for r in queries.QUERIES["similarity_sweep"](spark, d).collect()}
    assert sorted(got) == [k / 10 for k in range(11)] and len({r.precision for r in got.values()}) > 1
    from dataclasses import replace

    from glossmill.operators import evaluation as E
    from glossmill.plans import disambiguation as D
    from glossmill.plans import fixtures as X0

    alone = D.disambiguate(queries._mention_inputs(spark, d), replace(queries.MENTION_OPTIONS, sim_threshold=0.4)).select(F.col("mention_id").alias("key"), "ref")
    want = E.precision_recall(alone, X0.gold(spark, d)).first()
    assert abs(got[0.4].precision - want.precision) < 1e-6 and abs(got[0.4].recall - want.recall) < 1e-6


def test_pair_counts_and_described_meanings(spark):
    from glossmill.operators import aggregates as A

    rows = [("d", 1, "x", [1.0, 0.0]), ("d", 2, "x", [1.0, 0.0]), ("d", 3, "y", [0.9, 0.1]), ("d", 4, "z", [-1.0, 0.0]), ("d", 5, "u", None), ("d", 6, "v", [0.0, 0.0]), ("e", 1, "x", None)]
    got = A.pair_counts(spark.createDataFrame(rows, "doc_id string, ref int, ms string, vec array<double>"), 0.5)
    assert {tuple(r) for r in got.collect()} == {("d", 15, 14, 5, 3, 3), ("e", 0, 0, 0, 0, 0)}
    m = spark.createDataFrame([(1, ["g"], None), (2, [], ["l"]), (3, [], []), (4, None, None)], "ref int, glosses array<string>, lemmas array<string>")
    assert {r.ref for r in A.described_meanings(m).collect()} == {1, 2}


def test_bank_mentions_of_one_and_several_tokens(spark):
    from glossmill.plans import summary

    graphs = amr.read_banks(spark.createDataFrame([(1, TWO_SENTENCES)], "doc_id int, text string"))
    concepts = G.without_concepts(G.prefixed(amr.graph_tables(graphs)["edges"]))[1]
    got = {(r.v, r.l, r.r, r.form) for r in summary.bank_mentions(graphs, concepts).collect()}
    assert {("a.1_b", 1, 2, "boy"), ("a.1_t", 3, 5, "Rome station"), ("a.2_b", 1, 2, "boy")} <= got
    assert not any(v == "a.1_s" and r - l > 1 for v, l, r, _ in got)


def test_registered_queries_cover_all_spans_candidates_and_vertices(spark):
    from glossmill import queries
    from glossmill.plans import fixtures as X0

    d = "/root/testdata/sf0.001"
    spans = X0.spans(spark, d).where("r - l > 1").selectExpr("doc_id", "sent_id", "explode(sequence(l, r - 1)) as i").distinct()
    assert queries.QUERIES["coverage"](spark, d).agg(F.sum("covered_by_multiword")).first()[0] == spans.count()
    gold = X0.gold(spark, d).count()
    scores = {r.system: r for r in queries.QUERIES["system_scores"](spark, d).collect()}
    assert set(scores) == {"first", "ranked"} and abs(scores["first"].precision - scores["first"].recall) < 1e-6 and gold
    c = X0.candidates(spark, d)
    heavy = c.join(X0.weights(spark, d, c).where("w > 0"), ["doc_id", "ref"]).select("mention_id").distinct().count()
    assert queries.QUERIES["mention_weights"](spark, d).where("w > 0").count() == heavy > 0
    kept = queries.QUERIES["merged_entities"](spark, d).selectExpr("doc_id", "inline(array(struct(src as v), struct(dst as v)))").distinct()
    types = kept.join(X0.meanings(spark, d).selectExpr("ref as v", "type"), "v")
    assert types.groupBy("doc_id", "type", (F.col("v") % 7)).count().where("count > 1").count() == 0
