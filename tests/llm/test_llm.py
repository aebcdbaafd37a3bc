"""llm operators: edge cases, brute force, hot keys and recall on small fixtures."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import frequencies, lookalikes, mixing, neighbours, packing, residue, sentences, tokenizer, weights

TOKENS = "text_id string, tok_id string, lemma string, wf string, extra string"


def tokens_of(spark, texts, repeat=True):
    rows = [(t, f"{t}.{i}", w, w.upper() if w else w, "x") for t, ws in texts.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows + (rows[:3] if repeat else []), TOKENS)


# --- p1 -----------------------------------------------------------------------------------------


def test_weights_mark_out_rare_bursts(spark):
    texts = {f"t{i}": ["the"] * 5 + ["a", None, ""] for i in range(30)}
    texts["t0"] += ["rare"] * 5
    texts["t1"] += ["half"] * 1
    w = {(r.text_id, r.term): r for r in weights.term_weights(tokens_of(spark, texts)).collect()}
    assert w["t0", "rare"].tf == 5 and w["t0", "rare"].df == 1 and w["t0", "rare"].weight > 0.9
    assert w["t3", "the"].weight < 0.2 and w["t3", "the"].df == 30
    assert all(0 <= r.weight <= 1 for r in w.values())
    assert [tuple(r) for r in weights.distinctive_pairs(tokens_of(spark, texts)).collect()] == [("t0", "rare")]


def test_a_small_count_beside_a_large_one_is_kept(spark):
    texts = {f"t{i}": ["the"] for i in range(500)} | {"long": ["burst"] * 200, "short": ["burst"] * 4, "few": ["burst"] * 3}
    got = {tuple(r) for r in weights.distinctive_pairs(tokens_of(spark, texts)).collect()}
    assert got == {("long", "burst"), ("short", "burst")}


def test_weighters_cover_every_text_and_empty_tables(spark):
    texts = spark.createDataFrame([("t0", None), ("none", {"old": 1.0}), ("t0", None)], "text_id string, weighter map<string,double>")
    t = tokens_of(spark, {"t0": ["a", "b"]})
    got = {r.text_id: r.weighter for r in weights.weighters(texts, t).collect()}
    assert set(got) == {"t0", "none"} and got["none"] == {} and set(got["t0"]) == {"a", "b"}
    assert weights.distinctive_pairs(t.limit(0)).count() == 0


def test_mixture_of_clear_rates():
    k = np.array([1.0, 2.0, 9.0, 10.0])
    n = np.array([20.0, 10.0, 5.0, 5.0])
    elite, rates, p = weights.fit_mixtures(np.array([0]), k, n, 100.0)
    assert rates[1, 0] > 8 and rates[0, 0] < 2 and p[3] > 0.99 and p[0] < 0.1 and 0.05 < elite[0] < 0.15


def test_mixtures_settle_where_plain_steps_do_and_do_not_depend_on_their_block():
    rng = random.Random(12)
    shapes = [{k: max(1, round(100 * 0.5**k)) for k in range(1, 9)}, {1: 3}, {1: 1}, {7: 1}, {1: 4000, 2: 500, 3: 300}, {4: 1, 200: 1}]
    shapes += [{k: rng.randint(1, 50) for k in rng.sample(range(1, 30), rng.randint(1, 6))} for _ in range(60)]
    flat = [(k, n) for s in shapes for k, n in sorted(s.items())]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in shapes])[:-1]])
    k, n = (np.array([x[c] for x in flat], dtype=float) for c in (0, 1))
    elite, rates, p = weights.fit_mixtures(starts, k, n, 5000.0)
    h = weights.Histograms(starts, k, n, 5000.0)
    got = np.column_stack([elite, *rates])
    assert np.allclose(h.step(got), got, rtol=1e-6)
    plain = h.first()
    for _ in range(4000):
        plain = h.step(plain)
    assert (h.likelihood(got) >= h.likelihood(plain) - 1e-6).all()
    assert abs(elite[0] - plain[0, 0]) < 1e-6 and np.abs(p[:8] - h.posterior(plain)[:8]).max() < 1e-4
    for i in (0, 3, 20):
        one = weights.fit_mixtures(np.array([0]), *(np.array([x[c] for x in sorted(shapes[i].items())], dtype=float) for c in (0, 1)), 5000.0)
        assert abs(one[0][0] - elite[i]) <= 1e-12


def test_term_frequencies_of_hot_texts_and_heavy_points(spark, monkeypatch):
    df = tokens_of(spark, {f"t{i}": ["the"] * (i % 3 + 1) + [f"w{i}"] for i in range(40)} | {"hot": ["the", "x"] * 50}).repartition(4)
    plain = {(r.text_id, r.term): r.tf for r in weights.term_frequencies(df, hot={}).collect()}
    assert plain == {(r.text_id, r.term): r.tf for r in weights.term_frequencies(df, hot={"hot": 5}).collect()} and plain["hot", "the"] == 50
    want = {tuple(r) for r in weights.term_weights(df).collect()}
    monkeypatch.setattr(weights, "HEAVY_SHARE", 1.1)
    assert {tuple(r) for r in weights.term_weights(df).collect()} == want and len(want) == len(plain)


@pytest.mark.parametrize("share", [weights.HEAVY_SHARE, 0, 1.1])
def test_pairs_are_counted_without_a_mixture(spark, monkeypatch, share):
    monkeypatch.setattr(weights, "_scored", None)
    monkeypatch.setattr(weights, "HEAVY_SHARE", share)
    texts = {f"t{i}": ["the"] * (i % 7) + ["five"] * 4 * (i < 5) + ["six"] * 4 * (i < 6) + ["", None] * 4 for i in range(40)}
    texts |= {"long": ["burst"] * 200, "short": ["burst"] * 4 + ["three"] * 3, None: ["lost"] * 9}
    got = sorted(tuple(r) for r in weights.distinctive_pairs(tokens_of(spark, texts).repartition(3)).collect())
    assert got == sorted([("long", "burst"), ("short", "burst")] + [(f"t{i}", "five") for i in range(5)])


# --- p5 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("heavy,hot", [(None, None), ([("lemma", "w1"), ("wf", "W2")], {}), ([], {"t0": 3, "t1": 2}), ([("lemma", "w1")], {"t0": 4})])
def test_frequencies_match_brute_force(spark, monkeypatch, heavy, hot):
    rng = random.Random(2)
    texts = {f"t{i}": [rng.choice(["w1", "w2", f"w{rng.randint(3, 60)}", None, ""]) for _ in range(rng.randint(1, 60))] for i in range(25)}
    df = tokens_of(spark, texts).repartition(5)
    monkeypatch.setattr(frequencies, "LOCAL_VALUES", 20)
    got = {(r.field_name, r.term): (r.n_tokens, r.n_texts) for r in frequencies.term_counts(df, heavy=heavy, hot=hot).collect()}
    want = {}
    for t, ws in texts.items():
        for w in filter(None, ws):
            for key in (("lemma", w), ("wf", w.upper())):
                n, ts = want.setdefault(key, (0, set()))
                want[key] = (n + 1, ts | {t})
    assert got == {k: (n, len(ts)) for k, (n, ts) in want.items()}


def test_marks_and_empty_table(spark):
    df = tokens_of(spark, {"a": ["x", "y"], "b": ["x"], "c": ["x", "z"], "d": ["z"]})
    got = {(r.field_name, r.term): r.mark for r in frequencies.marked_terms(df).collect()}
    assert got["lemma", "x"] == "common" and got["lemma", "y"] == "rare" and got["lemma", "z"] == "common"
    assert {(r.field_name, r.term): r.mark for r in frequencies.marked_terms(df.repartition(3), hot={"a": 2, "c": 3}).collect()} == got
    assert frequencies.marked_terms(df.limit(0)).count() == 0


def test_a_token_that_comes_twice_counts_once_for_each_of_its_values(spark):
    rows = [("a", "1", "x", "X"), ("a", "1", "x", "Y"), ("a", None, "z", "Z"), ("b", None, "x", "X"), (None, "2", "x", "X")]
    got = {(r.field_name, r.term): (r.n_tokens, r.n_texts, r.mark) for r in frequencies.marked_terms(spark.createDataFrame(rows, "text_id string, tok_id string, lemma string, wf string")).collect()}
    assert got == {("lemma", "x"): (1, 1, "rare"), ("wf", "X"): (1, 1, "rare"), ("wf", "Y"): (1, 1, "rare")}


def test_detection_is_of_what_is_heavy_and_hot(spark, monkeypatch):
    monkeypatch.setattr(packing, "HOT_ROWS", 50)
    rows = [("hot", str(i), "the" if i % 2 else f"w{i}", None) for i in range(4000)] + [(f"t{i}", f"u{i}", None, "") for i in range(2000)]
    heavy, hot = frequencies.detect(spark.createDataFrame(rows, "text_id string, tok_id string, lemma string, wf string"))
    assert ("lemma", "the") in heavy and len(heavy) < 900 and set(hot) == {"hot"} and hot["hot"] >= 80


# --- p3 -----------------------------------------------------------------------------------------

VECTORS = "vec_id long, vectors array<double>, _max string"


def test_neighbours_recall_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_SIZE", 64)
    monkeypatch.setattr(neighbours, "FLAT", 4)
    monkeypatch.setattr(neighbours, "BLOCK", 500)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 16))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.3, base[:300] + rng.normal(size=(300, 16)) * 0.4])
    v *= rng.uniform(0.01, 100, size=(len(v), 1))
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)]
    odd = [(9000, None, ""), (9001, [0.0] * 16, ""), (9002, [1.0] * 15, ""), (9003, [float("nan")] * 16, ""), (9004, [None] * 16, ""), (9005, [float("inf")] * 16, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows + odd + rows[:20], VECTORS)
    got = {(r.vec_id, r.neighbour_id): r.cosine for r in neighbours.nearest_neighbours(df, dims=16).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:5]}
    assert len(set(got) & want) / len(want) >= 0.9
    assert all(abs(c - s[i, j]) < 5e-5 for (i, j), c in got.items()) and all(i < 9000 for i, _ in got)
    monkeypatch.setattr(neighbours, "MAX_LISTS", 5)  # cells and lists within them
    monkeypatch.setattr(neighbours, "SAMPLE", 700)
    cells = {(r.vec_id, r.neighbour_id) for r in neighbours.nearest_neighbours(df, dims=16).collect()}
    assert len(cells & want) / len(want) >= 0.9 and {i for i, _ in cells} == {i for i, _ in want}
    pairs = {tuple(r) for r in neighbours.similar_pairs(df, dims=16).collect()}
    sure = {(min(i, j), max(i, j)) for i, j in want if s[i, j] >= 0.8}
    assert len(pairs & sure) / len(sure) >= 0.95 and len(pairs - sure) <= 0.05 * len(pairs)


def test_a_hot_group_of_copies_keeps_every_row(spark):
    rows = [(i, [1.0, 2.0, 3.0 if i < 300 else float(i)], "") for i in range(310)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, VECTORS), dims=3).collect()
    per = {}
    for r in got:
        per.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert set(per) == set(range(310)) and all(len(x) == 5 for x in per.values())
    assert sorted(per[299]) == [0, 1, 2, 3, 4] and sorted(per[0]) == [1, 2, 3, 4, 5]
    assert neighbours.nearest_neighbours(spark.createDataFrame([], VECTORS), dims=3).count() == 0


def test_graph_search_finds_near_centroids(monkeypatch):
    monkeypatch.setattr(neighbours, "FLAT", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32)).astype(np.float32)
    c = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 32))).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q = c[rng.integers(0, 3000, 300)] + 0.05 * rng.normal(size=(300, 32)).astype(np.float32)
    graph, entries = neighbours.link_centroids(c)
    assert len(entries) <= 1000
    ids, _ = neighbours.search_graph(q.astype(np.float32), c, graph, entries, 4)
    best = np.argsort(-(q @ c.T), 1)[:, :4]
    assert np.mean([len(set(a) & set(b)) / 4 for a, b in zip(ids, best)]) > 0.9


# --- p6 -----------------------------------------------------------------------------------------

SPLITS = [
    ("en", "Dr. Tamm paid 3.5 tonnes. It fell.", ["Dr. Tamm paid 3.5 tonnes.", "It fell."]),
    ("en", '"Where is it?" asked Ravi. "Yes." The end.', ['"Where is it?" asked Ravi.', '"Yes."', "The end."]),
    ("en", '"We counted 3.\nNobody knew," said Mara. He asked (the old one!) still.', ['"We counted 3.\nNobody knew," said Mara.', "He asked (the old one!) still."]),
    ("en", "It is sold in the U.S. Ilse left. The U.S. exports fell.", ["It is sold in the U.S.", "Ilse left.", "The U.S. exports fell."]),
    ("en", "It had failed.Prices rose.[14] So. See www.text.example/a now.", ["It had failed.", "Prices rose.[14]", "So.", "See www.text.example/a now."]),
    ("en", "Chapter 7. The canal\n\nThey waited... and it came. eLumo built it.", ["Chapter 7. The canal", "They waited... and it came.", "eLumo built it."]),
    ("en", "The wet\r\nground. S. Prask left. cut o", ["The wet\r\nground.", "S. Prask left. cut o"]),
    ("de", "14. Der Plan\n\nIm 18. Jahrhundert war es, z. B. dort. Am 7. März 1932. Der Rest.", ["14. Der Plan", "Im 18. Jahrhundert war es, z. B. dort.", "Am 7. März 1932.", "Der Rest."]),
    ("es", "¿De verdad? preguntó Tomás. —No lo sé —dijo Inés.", ["¿De verdad? preguntó Tomás.", "—No lo sé —dijo Inés."]),
    ("el", "Πού είναι; Ο κ. Ορσινός ήρθε· ναι.", ["Πού είναι;", "Ο κ. Ορσινός ήρθε· ναι."]),
    ("zh", "真的吗？！“这是吗？”奥森问道。他说：“很好！”见第80页（图7。彩色）。", ["真的吗？！", "“这是吗？”奥森问道。", "他说：“很好！”", "见第80页（图7。彩色）。"]),
    ("ja", "「31人いた。誰も。」と言った。待った……そして来た。本当に？！", ["「31人いた。誰も。」と言った。", "待った……そして来た。", "本当に？！"]),
    ("th", "ราคา 83.1 ในเดือน ท่าเรือ", ["ราคา 83.1 ในเดือน", "ท่าเรือ"]),
    ("ar", "وصل د. التارني. انتظر... ثم وصل. أين؟ «هل هذا؟» سألت.", ["وصل د. التارني.", "انتظر... ثم وصل.", "أين؟", "«هل هذا؟» سألت."]),
    ("hi", "डॉ. वेल्दा आया। क्या?", ["डॉ. वेल्दा आया।", "क्या?"]),
    ("en", 'It fell. "We counted 3. Nobody bel', ["It fell.", '"We counted 3. Nobody bel']), ("zh", "很好。“我们数了8个人。没", ["很好。", "“我们数了8个人。没"]),
    (None, "﻿  ​", []), (None, "", []), ("en", None, []), ("en", "no end", ["no end"]), ("en", "...", ["..."]),
]


@pytest.mark.parametrize("lang,text,want", SPLITS)
def test_sentences(lang, text, want):
    assert [text[a:b] for a, b in sentences.split_text(text, lang)] == want


LONG = "We counted them all. Nobody knew. " * 60


@pytest.mark.parametrize("a,b", ['""', "“”", "„“", "«»", "「」", "''"])
def test_long_quotations_and_brackets_are_one_unit(a, b):
    said = f"{a}{LONG}So it was,{b} said Mara."
    text = f"It fell. {said} He left."
    assert [text[i:j] for i, j in sentences.split_text(text, "en")] == ["It fell.", said, "He left."]
    text = f"He asked ({LONG.strip()}) still. He left."
    assert [text[i:j] for i, j in sentences.split_text(text, "en")] == [text[:-9].rstrip(), "He left."]


def test_long_cut_off_speech_and_headings_are_one_unit():
    text = f'It fell. "{LONG}Nobody bel'
    assert [text[i:j] for i, j in sentences.split_text(text, "en")] == ["It fell.", text[9:]]
    text = "Chapter 7. " + "The long canal and " * 10 + "its towns"
    assert [text[i:j] for i, j in sentences.split_text(text, "en")] == [text]


LISTS = [
    ("1. Buy milk\n2. Buy bread\n   a. rye\n   b. wheat\n3. Go home", ["1. Buy milk", "2. Buy bread", "a. rye", "b. wheat", "3. Go home"]),
    ("Take these:\n- salt. It is dear.\n- oil\n  * of olives\n  * of nuts\n- flour", ["Take these:", "- salt.", "It is dear.", "- oil", "* of olives", "* of nuts", "- flour"]),
    ("He came on the\n1. of May and left\nthen.", ["He came on the\n1. of May and left\nthen."]),
    ("It was so.\n1) One (a\n2) b). Two", ["It was so.", "1) One (a", "2) b).", "Two"]),
    ("1. a\n  1. b\n  2. c\n2. d", ["1. a", "1. b", "2. c", "2. d"]),
    ("a. x\n1. y\n" * 3000, None),
    ("It is 4\n- 2 he said\nand so on.", ["It is 4\n- 2 he said\nand so on."]),
]


@pytest.mark.parametrize("text,want", LISTS)
def test_list_items_are_units(text, want):
    got = [text[a:b] for a, b in sentences.split_text(text, "en")]
    assert got == want or want is None and got


def test_speakers_of_several_languages_and_own_verbs():
    for text in ('"Halt! Jetzt!" Anna rief.', '"Stop! Now!" Ravi said.', "«Стой!» Анна крикнула."):
        assert len(sentences.split_text(text, None)) == 1
    own = sentences.speaker_pattern({"xx": "blurted"})
    assert len(sentences.split_text('"Stop! Now!" Ravi blurted.', None, own)) == 1 and len(sentences.split_text('"Stop! Now!" Ravi blurted.', None)) == 2


def test_marks_that_are_never_closed_are_mere_signs():
    cases = [('He saw (the old one. It fell. "Yes," he said. He left.', 4), ("In the '90s it fell. He said, 'Go.' He left.", 3), ('It was (5" or so) long. It fell. He left.', 3), ("“It fell. He left. “Yes.” The end.", 4), ('The (odd "mark) stood. It fell. He had "two" there.', 3)]
    for text, n in cases:
        assert len(sentences.split_text(text, "en")) == n, (text, sentences.split_text(text, "en"))
    rng = random.Random(3)
    for marks in ("“((", '"(“', "«»(", "'\"(", "„“”"):
        assert sentences.split_text("".join(rng.choice(marks) + rng.choice(["A b. ", "c", ", "]) for _ in range(30000)), "en")


def test_sentences_cover_any_text_in_order():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice('Ab c.!?"“”()«»\n\r\t…。」「\'1​ก ') for _ in range(rng.randint(0, 60)))
        at = 0
        for a, b in sentences.split_text(text, rng.choice(["en", None, "de"])):
            assert at <= a < b and not text[at:a].strip(" \n\r\t​") and text[a:b].strip("​ \n\r\t") == text[a:b]
            at = b
        assert not text[at:].strip(" \n\r\t​")


def test_sentences_take_very_long_texts_and_count_ids_once(spark):
    long = '"Open. ' * 5000 + "Nom. " * 5000
    df = spark.createDataFrame([(1, long, None), (1, long, None), (2, None, "en"), (None, "A. B.", "en")], "uima_id long, text string, lang string")
    got = sentences.split_sentences(df).select("uima_id", "start_char", "end_char").collect()
    assert {r.uima_id for r in got} == {1} and len(got) == len(set(got)) > 4000


# --- p7 -----------------------------------------------------------------------------------------


def test_consistent_forms(spark):
    cases = [
        ("en", "ｅｎｚｙｍｅ", "enzyme"), ("en", "сoffeе", "coffee"), ("en", "café", "café"), ("en", "e​́", "é"), ("en", "coﬀee", "coffee"),
        ("en", "a b ", "a b"), ("en", "сору", "copy"), ("ru", "cлyчай", "случай"), ("el", "ρεvμή", "ρενμή"), ("tr", "ş", "ş"), ("en", "​", ""), ("xx", "сoffee", None),
        ("en", "β-carotene", None), ("en", "Щебень", None), ("ru", "T-0007", None), ("en", "μ", None), ("en", "Δt", None), ("ru", "это", None), ("en", "a  b", None), (None, "ok", None),
        ("en", "well\u2011known", "well-known"), ("en", "\U0001d41a\U0001d41b", "ab"), ("en", "\u2167", "VIII"), ("ar", "\ufeb3\ufedc", "\u0633\u0643"), ("en", "\u13aarm", "Arm"), ("en", "d\u0585g", "dog"), ("ru", "qx-0015862", None), ("en", "\u24d0", None), ("en", "x\u00b2", None), ("el", "\u03bf\u0441\u03bf", None),
    ]
    tokens = spark.createDataFrame([(f"k{i}", f"t{lang}", v, None) for i, (lang, v, _) in enumerate(cases)] * 2 + [("n", "ten", None, "")], "tok_id string, text_id string, lemma string, wf string")
    texts = spark.createDataFrame([(f"t{lang}", lang) for lang in {c[0] for c in cases} if lang], "text_id string, lang string")
    got = {r.tok_id: r.form for r in lookalikes.inconsistent_values(tokens, texts).collect()}
    assert got == {f"k{i}": form for i, (_, _, form) in enumerate(cases) if form is not None}
    assert lookalikes.inconsistent_values(tokens.limit(0), texts).count() == 0


def test_a_heavy_value_and_a_public_look_alike_file(spark, tmp_path):
    rows = [(f"k{i}", "t", "e\u200ba" if i % 3 else "a\u00a0b", f"w{i}") for i in range(90)]
    tokens, texts = spark.createDataFrame(rows, "tok_id string, text_id string, lemma string, wf string"), spark.createDataFrame([("t", "en")], "text_id string, lang string")
    assert {(r.value, r.form) for r in lookalikes.inconsistent_values(tokens, texts).collect()} == {("e\u200ba", "ea"), ("a\u00a0b", "a b")}
    assert lookalikes.inconsistent_values(tokens, texts).count() == 90
    (tmp_path / "c.txt").write_text("\ufeff# public\n0430 ;\t0061 ;\tMA\t# a\n03B1 ; 0061 ; MA\n0031 ; 006C ; MA\n0132 ; 0049 004A ; MA\n", encoding="utf-8")
    got = lookalikes.read_look_alikes(str(tmp_path / "c.txt"))
    assert {("Latin", "\u0430", "a"), ("Greek", "a", "\u03b1"), ("Cyrillic", "\u03b1", "\u0430")} <= set(got) and not any("1" in r for r in got)
    values = spark.createDataFrame([("Latin", "c\u0430t")], "script string, value string")
    assert lookalikes.consistent_values(values, got).first().form == "cat"


def test_values_passed_over_never_change(spark):
    rng = random.Random(6)
    letters = "abcxyzéñıŀĳABCабвдежяАБВαβγοωΑΒΓ 1-'.ｅ́​"
    values = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(600)})
    df = spark.createDataFrame([(v,) for v in values], "value string").where(F.col("value").rlike(lookalikes.SURE))
    every = df.select(F.explode(F.array(*[F.lit(s) for s in ("Latin", "Cyrillic", "Greek", "")])).alias("script"), "value")
    assert lookalikes.consistent_values(every).where("form <> value").count() == 0 and df.count() > 50
    own = spark.createDataFrame([(s, v) for s in lookalikes.LETTERS for v in values], "script string, value string").where(lookalikes.sure_in(F.col("script"), F.col("value")))
    assert lookalikes.consistent_values(own).where("form <> value").count() == 0 and own.count() > 50


def test_decompositions_follow_the_character_database():
    table = {c: "".join(x for x, _ in parts) for c, parts in lookalikes.decomposition_rows()}
    assert table["é"] == unicodedata.normalize("NFD", "é") and table["Ａ"] == "A" and table["­"] == "" and "²" not in table


# --- p8, p9 -------------------------------------------------------------------------------------


def test_ids_match_the_public_library(spark):
    import tiktoken

    ranks = tokenizer.load_ranks(tokenizer.vocabulary_path())
    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["", None, "<|endoftext|> is text", "a" * 5000, "ไทย" * 700, "x\r\n\n  y'll 12345"] + ["".join(rng.choice("ab c'sé中🙂\n1.") for _ in range(rng.randint(1, 200))) for _ in range(100)]
    got = tokenizer.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.ids for r in got.collect()} == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_both_merges_agree():
    ranks = tokenizer.load_ranks(tokenizer.vocabulary_path())
    rng = random.Random(9)
    for _ in range(300):
        word = "".join(rng.choice("abtheing é中") for _ in range(rng.randint(1, 90))).encode()
        assert tokenizer.merge_short(word, ranks) == tokenizer.merge_long(word, ranks)


def test_mixture_reaches_its_shares_within_repeats(spark):
    rng = random.Random(10)
    docs = [(i, rng.choice(["a"] * 8 + ["b"]), "word " * rng.randint(1, 80)) for i in range(1200)] + [(5000, None, "x"), (5001, "a", None), (5002, "a", ""), (5003, "zz", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(df, targets).persist()
    shares = {r.source: r for r in mixing.reached_shares(mix, targets).collect()}
    assert abs(shares["a"].actual_share - 2 / 3) < 0.005 and abs(shares["b"].actual_share - 1 / 3) < 0.005 and shares["gone"].actual_share == 0
    assert shares["a"].most_copies <= 1 and shares["b"].most_copies <= 4 and mix.where("doc_id >= 5000").count() == 0
    assert {s for s, r in shares.items() if r.used_up} <= {"a", "b"} and any(r.used_up for r in shares.values())
    more = {r.source: r for r in mixing.reached_shares(mixing.mix_sources(df, targets, total_tokens=1e9), targets).collect()}
    assert more["b"].n_copies == 4 * more["b"].n_docs
    assert mixing.mix_sources(df.limit(0), targets).count() == 0


# --- p10 ----------------------------------------------------------------------------------------

RESIDUE = [
    "404 Not Found", "Real words here. Written by {{author}} for all.", "Lorem ipsum dolor sit amet.", "Please enable JavaScript to continue.", "Body copy goes here",
    "A sentence.\nAccess denied. Your request was blocked. Reference 4ab8c9", "Where __CITY__ is.", '"Where is the {body} archive?" asked he.', "Zugriff verweigert. Kennung 12ab34", "请启用 JavaScript 后继续浏览。", "text text text text text text...", "undefined undefined, undefined",
    "Diese Seite ist nicht verfügbar.", "Página não encontrada", "Pagina non trovata", "[TITLE GOES HERE]", "Dear %FIRST_NAME%, hello.", "By <<name>> for all.",
]
REAL = [
    None, "", "  ", "Ok", "Access was denied to 9 nurses at the gate.", 'He saw "Please enable JavaScript to continue" there.', "A name in double braces, such as {{title}}, is replaced by its value.",
    "Let {a, b, c} stand for it, and [x] for the class.", "@highlight", "# ::id bank.1\n# ::tok A", "<|endoftext|>", "The error rate fell to 4 percent after the server was replaced.", "[MASK] is a token", '"Your text goes here," said Ilse.', "In the course, nurses learn JavaScript.", 'She typed "{{title}}" twice.',
    "The link you followed as a child through the forest is gone.", "Something went wrong with the engine, and the crew landed.", "Too many requests came in that spring for the museum to answer.", "Nothing here yet suggests that the treaty failed.",
    'He read: "' + "It was long. " * 40 + 'Access denied." Then he left.',
]


def test_residue_and_what_only_speaks_of_it(spark):
    rows = [(i, t, "s", "x") for i, t in enumerate(RESIDUE)] + [(100 + i, t, None, "x") for i, t in enumerate(REAL)]
    df = spark.createDataFrame(rows + rows[:2] + [(None, "404 Not Found", "s", "x")], "doc_id long, text string, source string, unit string")
    assert sorted(r.doc_id for r in residue.residue_documents(df).collect()) == list(range(len(RESIDUE)))
    assert residue.without_residue(df).where("doc_id >= 100").count() == len(REAL)
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_recurrence_decides_what_only_opens_like_a_message(spark):
    said = ["You will be signed out when your browser closes.", "Something went wrong with the page. 7 May 2020", "The link you followed: 41"]
    for text in said:
        rows = [(i, text.replace("7 May 2020", f"{i} {m} 2021"), f"s{i % 2}") for i, m in enumerate(("June", "März", "juillet", "May", "Ekim", "abril", "August", "Mai"))]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        assert {r.kind for r in residue.residue_units(df).collect()} == {"recurring"} and residue.residue_documents(df).count() == 8
        assert residue.residue_documents(df.where("source = 's0'")).count() == 0
    assert len({r.unit_hash for r in residue.unit_occurrences(spark.createDataFrame([(i, f"Closed from {i} {m} 2021 on", "s") for i, m in enumerate(("June", "März", "juillet"))], "doc_id long, text string, source string")).collect()}) == 1


def test_units_are_grouped_before_they_are_classified(spark):
    rows = [(i, f"Error {400 + i}: see below.\nWords {i} of a story.", f"s{i % 3}") for i in range(6)] + [(9, "ERROR 7: see below.", None), (10, "See {body_text} there.", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    units = residue.classified_units(residue.unit_occurrences(df)).collect()
    assert len({r.raw_hash for r in units}) == len(units) == 3 and len({r.unit_hash for r in units}) == 2
    assert {(r.kind, r.n_docs, r.n_sources) for r in units} == {("recurring", 7, 4), ("placeholder", 1, 1)}
    assert sorted((r.n_docs, r.n_sources) for r in residue.group_counts(residue.unit_occurrences(df)).collect()) == [(1, 1), (6, 3), (7, 4)]
    assert {(r.id, r.kind, r.n_docs) for r in residue.residue_units(df).collect()} == {(i, "recurring", 7) for i in (*range(6), 9)} | {(10, "placeholder", 1)}
