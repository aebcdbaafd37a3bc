"""Commands and file formats, end to end on small files."""

import pytest
from pyspark.sql import functions as F

from glossmill import __main__ as cli
from glossmill.sources import readers, sinks

TOKENS = "doc_id string, sent_id string, i int, tok_id string, form string, lemma string, pos string"


@pytest.fixture()
def folder(spark, tmp_path):
    words = [("d1", "d1.s1", i, f"d1.s1.t{i + 1}", w, w, p) for i, (w, p) in enumerate((("bank", "N"), ("holds", "V"), ("money", "N")))]
    spark.createDataFrame(words, TOKENS).write.parquet(str(tmp_path / "tokens"))
    sinks.write_corpus_xml(spark.createDataFrame(words, TOKENS).withColumnRenamed("doc_id", "text_id"), str(tmp_path / "xml"))
    senses = [("bank", 1, "m1"), ("bank", 2, "m2"), ("money", 1, "m3"), ("holds", 1, "m4"), ("bank holds", 1, "m5")]
    spark.createDataFrame(senses, "lemma string, sense_rank int, ref string").write.parquet(str(tmp_path / "dictionary"))
    meanings = [("m1", [1.0, 0.0], ["river side"], ["bank"]), ("m2", [0.0, 1.0], ["money house"], ["bank"]), ("m3", [0.1, 1.0], ["coins"], []), ("m4", [0.5, 0.5], [], []), ("m5", None, ["x"], None)]
    spark.createDataFrame(meanings, "ref string, vec array<double>, glosses array<string>, lemmas array<string>").write.parquet(str(tmp_path / "meanings"))
    spark.createDataFrame([("money", [0.0, 1.0]), ("house", [0.0, 0.5]), ("coins", [0.2, 1.0])], "item string, vec array<double>").write.parquet(str(tmp_path / "vectors"))
    (tmp_path / "gold.tsv").write_text("d1.s1.t1\td1.s1.t1\tm1\nd1.s1.t3\td1.s1.t3\tm3\nd1.s1.t9\td1.s1.t9\tm3\n")
    return tmp_path


def run(spark, folder, command, *names, **options):
    extra = [x for k, v in options.items() for x in (f"--{k}", str(v))]
    cli.main([command, *[str(folder / n) for n in names], *extra], spark)


def test_semeval_and_system(spark, folder, capsys):
    run(spark, folder, "semeval", "xml", "dictionary", "meanings", "vectors", "gold.tsv", "out", dims=2)
    said = capsys.readouterr().out
    assert said.startswith("precision, recall, F1: 1.0 0.66")
    lines = sorted(r.value for r in spark.read.text(str(folder / "out")).collect())
    assert "d1.s1.t1\td1.s1.t2\tm5" in lines and "d1.s1.t3\td1.s1.t3\tm3" in lines
    run(spark, folder, "system", "tokens", "dictionary", "meanings", "vectors", "senses", dims=2)
    assert {(r.first_tok, r.ref) for r in spark.read.parquet(str(folder / "senses")).collect()} >= {("d1.s1.t3", "m3")}


def test_candidates_stats_and_frequencies(spark, folder):
    run(spark, folder, "candidates", "tokens", "dictionary", "cands")
    assert spark.read.parquet(str(folder / "cands")).count() == 5
    run(spark, folder, "stats", "tokens", "cands", "stats")
    assert spark.read.parquet(str(folder / "stats")).first().n_tokens == 3
    note = "<annotation><babelNetID>m1</babelNetID>\n<mention>bank</mention></annotation><babelNetID>m9</babelNetID><mention>x</mention>"
    spark.createDataFrame([(1, note), (2, note), (3, None)], "doc_id long, text string").write.parquet(str(folder / "docs"))
    run(spark, folder, "freqs", "docs", "freqs")
    run(spark, folder, "subset", "freqs", "cands", "fewer")
    back = readers.frequencies_json(spark, str(folder / "fewer"))
    assert back["docs"].first()[0] == 2 and [tuple(r) for r in back["form_meanings"].collect()] == [("bank", "m1", 2)] and back["meanings"].count() == 1


def test_meanings_context_types_and_rankeval(spark, folder, capsys):
    run(spark, folder, "meanings", "meanings", "some", most=2)
    assert [r.ref for r in spark.read.parquet(str(folder / "some")).orderBy("ref").collect()] == ["m1", "m2"]
    run(spark, folder, "context", "meanings", "vectors", "ctx", dims=2)
    assert sorted(r.value for r in spark.read.text(str(folder / "ctx")).collect()) == ["m2 0.000000 0.750000", "m3 0.200000 1.000000"]
    (folder / "types.json").write_text('{"m1": "Location", "m2": "Planet"}')
    run(spark, folder, "types", "meanings", "types.json", "typed")
    assert {r.ref: r.type for r in spark.read.parquet(str(folder / "typed")).collect()}["m1"] == "Location"
    (folder / "gold").mkdir()
    (folder / "gold" / "d1.gold").write_text('bn:00000001n|bn:00000002n-"x"\n')
    spark.createDataFrame([("d1", "bn:00000009n", 0.9), ("d1", "bn:00000001n", 0.5)], "doc_id string, ref string, rank double").write.parquet(str(folder / "ranks"))
    run(spark, folder, "rankeval", "ranks", "gold")
    assert capsys.readouterr().out.strip().endswith("0.5 1")


def test_arguments_are_checked(folder):
    for argv in (["run", "none", ".", "out"], ["meanings", str(folder / "missing"), "out"], ["plan", str(folder), "out", "--keep", "0"], ["system", *[str(folder)] * 4, "out", "--threshold", "2"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(argv)


def test_scorer_keys_tags_paths_and_stages(spark, folder):
    (folder / "keys").write_text("d001.s1.t1 d001.s1.t1 Bn_One BN:2\nd001.s1.t1 d001.s1.t1 bn_one\nd002.s1.t1 d002.s1.t2 x\nshort\n")
    assert {r.key: r.refs for r in readers.scorer_keys(spark, str(folder / "keys"), "d001.").collect()} == {"d001.s1.t1d001.s1.t1": ["bn one", "bn:2"]}
    tags = spark.createDataFrame([("NNP", "en"), ("VVFIN", "de"), ("aq0", "es"), ("ADV", "fr"), ("Verb", "tr"), ("DTNN", "ar"), (None, "en")], "tag string, lang string")
    got = [tags.where(F.col("lang") == lang).select(readers.dictionary_pos(F.col("tag"), lang)).first()[0] for lang in ("en", "de", "es", "fr", "tr", "ar")]
    assert got == ["N", "V", "J", "R", "V", "N"]
    assert sinks.output_path("/a/b.txt", "_x.tsv") == "/a/b_x.tsv" and sinks.output_path("/a/b.txt", ".y", "/c") == "/c/b.y"
    assert sinks.write_stage(tags, str(folder / "stage")).count() == 7
