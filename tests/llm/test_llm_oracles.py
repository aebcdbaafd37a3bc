"""The llm queries against their SQL or brute force, over the whole tables of the smallest data folder."""

import unicodedata

import numpy as np
import pytest

from glossmill.context import table
from glossmill.llm import lookalikes, queries, sentences, tokenizer, weights
from tests.oracle import DATA, same

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    ok, why = same(spark, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, why


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_every_query_has_sql_or_a_test_here():
    tested = {"p1_weighters", "p3_neighbours", "p6_found", "p6_sentences", "p7_found", "p7_forms", "p8_ids", "p9_mixture", "p9_shares", "p10_found", "p10_kept"}
    assert set(queries.QUERIES) == set(queries.SQL) | tested and not tested & set(queries.SQL)


def test_weighters_follow_a_fit_of_each_term_alone(spark):
    tokens = {(r.tok_id, r.text_id, r.lemma) for r in table(spark, SF, "tokens").collect() if r.tok_id and r.text_id}
    tf = {}
    for _, text, lemma in tokens:
        if lemma:
            tf[text, lemma] = tf.get((text, lemma), 0) + 1
    n = len({r.text_id for r in table(spark, SF, "tokens").select("text_id").collect() if r.text_id})
    got = {r.text_id: r.weighter for r in rows_of(spark, "p1_weighters")}
    assert set(got) == {r.text_id for r in table(spark, SF, "texts").collect() if r.text_id}
    assert {(t, w) for t, m in got.items() for w in m} == {k for k in tf if k[0] in got}
    by_term = {}
    for (text, lemma), k in tf.items():
        by_term.setdefault(lemma, []).append((text, k))
    for lemma, at in sorted(by_term.items())[::17]:
        k, m = np.unique([x for _, x in at], return_counts=True)
        elite, _, p = weights.fit_mixtures(np.array([0]), k.astype(float), m.astype(float), float(n))
        want = np.clip(p * max(-np.log(elite[0]), 0) / np.log1p(n), 0, 1)
        for text, x in at:
            if text in got:
                assert abs(got[text][lemma] - want[list(k).index(x)]) < 1e-8


def test_neighbours_are_those_of_brute_force(spark):
    found = {}
    for r in rows_of(spark, "p3_neighbours"):
        found.setdefault(r.vec_id, {})[r.neighbour_id] = r.cosine
    v = {r.vec_id: r.vectors for r in table(spark, SF, "text_vectors").collect() if r.vec_id is not None and r.vectors and len(r.vectors) == 64 and all(x is not None and np.isfinite(x) for x in r.vectors) and any(r.vectors)}
    assert set(found) == set(v)
    ids = sorted(v)
    x = np.array([np.array(v[i]) / np.abs(v[i]).max() for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    hits = 0
    for i, row in zip(ids, s):
        least = np.sort(row)[-5]
        mine = {j: row[ids.index(j)] for j in found[i]}
        assert len(mine) == 5 and all(abs(found[i][j] - c) < 5e-5 for j, c in mine.items())
        hits += sum(c >= least - 5e-5 for c in mine.values())
    assert hits >= 0.95 * 5 * len(ids)


def test_sentences_are_those_of_each_text(spark):
    texts = {r.uima_id: r for r in table(spark, SF, "uima_texts").collect() if r.uima_id is not None and r.text}
    got = {}
    for r in rows_of(spark, "p6_sentences"):
        assert texts[r.uima_id].text[r.start_char : r.end_char] == r.sentence and r.sentence.strip()
        got.setdefault(r.uima_id, []).append((r.sentence_no, r.start_char, r.end_char))
    for i, r in texts.items():
        units = sentences.split_text(r.text, r.lang)
        assert sorted(got.get(i, [])) == [(k, a, b) for k, (a, b) in enumerate(units)]
        assert all(a[1] <= b[0] for a, b in zip(units, units[1:]))
    assert {(r.uima_id, r.start_char, r.end_char) for r in rows_of(spark, "p6_found")} == {(i, a, b) for i, xs in got.items() for _, a, b in xs}


def plain_form(value, script):
    """The consistent form by plain string functions, but for the choice of look-alikes."""
    table_ = {c: "".join(x for x, _ in parts) for c, parts in lookalikes.decomposition_rows()}
    alike = {c: letter for home, c, letter in lookalikes.look_alike_rows() if home == script}
    text = "".join(table_.get(c, c) for c in value)
    out, word = [], []

    def script_of(c):
        return next((s for s in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC") if unicodedata.name(c, "").startswith(s)), None)

    def close():
        letters = [c for c in word if unicodedata.category(c)[0] == "L"]
        for c in word:
            own = [x for x in letters if script_of(x) == script_of(c)]
            code = len(own) == len(letters) and any(unicodedata.category(x)[0] == "N" for x in value)
            out.append(alike[c] if c in alike and len(letters) > 1 and not code and all(x in alike for x in own) else c)
        word.clear()

    for c in text:
        if unicodedata.category(c)[0] in "LM":
            word.append(c)
        else:
            close()
            out.append(c)
    close()
    return unicodedata.normalize("NFC", "".join(out)).strip(" ")


def test_consistent_forms_are_those_of_plain_functions(spark):
    langs = {}
    for r in table(spark, SF, "texts").collect():
        if r.text_id and r.lang:
            langs[r.text_id] = min(r.lang, langs.get(r.text_id, r.lang))
    scripts = {lang: script for script, all_ in lookalikes.SCRIPTS.items() for lang in all_}
    want, forms = set(), {}
    for r in {(r.tok_id, r.text_id, r.lemma, r.wf) for r in table(spark, SF, "tokens").collect() if r.tok_id}:
        for field, value in (("lemma", r[2]), ("wf", r[3])):
            if value and (form := plain_form(value, scripts.get(langs.get(r[1]), ""))) != value:
                want.add((r[0], field))
                forms.setdefault((field, value, form), set()).add(r[0])
    assert {tuple(r) for r in rows_of(spark, "p7_found")} == want and len(want) > 20
    assert {(r.field_name, r.value, r.form): r.n_tokens for r in rows_of(spark, "p7_forms")} == {k: len(x) for k, x in forms.items()}


def test_ids_are_those_of_the_public_library(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.load_ranks(tokenizer.vocabulary_path()), special_tokens={})
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.ids for r in rows_of(spark, "p8_ids")} == {i: enc.encode_ordinary(t) if t else [] for i, t in texts.items()}


def test_the_mixture_keeps_its_limits_and_reaches_its_shares(spark):
    sizes = {r.doc_id: len(r.ids) for r in rows_of(spark, "p8_ids")}
    source = {r.doc_id: r.source for r in table(spark, SF, "documents").collect()}
    targets = {r.source: r for r in table(spark, SF, "mix_targets").collect()}
    used = {}
    for r in rows_of(spark, "p9_mixture"):
        assert r.source == source[r.doc_id] and r.n_tokens == sizes[r.doc_id] and 1 <= r.copies <= targets[r.source].max_repeats
        used[r.source] = used.get(r.source, 0) + r.copies * r.n_tokens
    largest = max(sizes.values())
    for r in rows_of(spark, "p9_shares"):
        assert r.mixed_tokens == used.get(r.source, 0) and abs(r.actual_share - r.mixed_tokens / sum(used.values())) < 1e-9
        assert not used.get(r.source) or abs(r.actual_share - r.target_share / sum(targets[s].target_share for s in used)) <= 2 * largest / sum(used.values())


def test_residue_and_kept_documents_are_all_documents(spark):
    found = [r.doc_id for r in rows_of(spark, "p10_found")]
    kept = [r.doc_id for r in rows_of(spark, "p10_kept")]
    assert len(set(found)) == len(found) > 0 and sorted(found + kept) == sorted(r.doc_id for r in table(spark, SF, "documents").collect())
