"""Sources: files of the reference formats as tables.

Missing folders give Spark's own error; broken lines are left out or rejected, never guessed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.functions.text import hash28
from glossmill.operators.rejects import loaded_lines

#: Vector file kinds; the first has a header line of item count and dimensions.
WITH_HEADER, WITHOUT_HEADER = "Text_Glove", "Text_Word2vec"
TYPES = ("Location", "Organization", "Person", "Other")

CORPUS_SCHEMA = (
    "_id string, sentence array<struct<_id:string, wf:array<struct<_id:string, _lemma:string, _pos:string, _VALUE:string>>>>"
)


def text_files(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(path, text) of the files of a folder whose lower-cased name ends with ``suffix``, each whole; no other file is opened."""
    any_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{any_case}").text(folder)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def annotated_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text_id, sent_id, i, tok_id, form, lemma, pos) of annotated XML; an explicit schema keeps lone children arrays."""
    texts = spark.read.format("xml").option("rowTag", "text").schema(CORPUS_SCHEMA).load(path)
    sentences = texts.select(F.col("_id").alias("text_id"), F.explode("sentence").alias("s"))
    words = sentences.select("text_id", F.col("s._id").alias("sent_id"), F.posexplode("s.wf").alias("i", "w"))
    return words.select("text_id", "sent_id", "i", F.col("w._id").alias("tok_id"), F.trim("w._VALUE").alias("form"), F.coalesce("w._lemma", F.trim("w._VALUE")).alias("lemma"), F.col("w._pos").alias("pos"))


def plain_documents(documents: DataFrame) -> DataFrame:
    """Annotated tokens of plain texts: ids t{n}, t{n}.s{n}, t{n}.s{n}.t{n}, white-space words, no tags.

    ``documents(doc_id, text)``; a sentence is a line here, and any tokeniser's output may stand in.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", r"\n+")).alias("s", "line")).where("trim(line) <> ''")
    words = lines.select("doc_id", "s", F.posexplode(F.filter(F.split("line", r"\s+"), lambda x: x != "")).alias("i", "form"))
    text_id = F.concat(F.lit("t"), F.col("doc_id"))
    sent_id = F.concat(text_id, F.lit(".s"), F.col("s") + 1)
    return words.select("doc_id", text_id.alias("text_id"), sent_id.alias("sent_id"), "i", F.concat(sent_id, F.lit(".t"), F.col("i") + 1).alias("tok_id"), "form", F.lower("form").alias("lemma"), F.lit(None).cast("string").alias("pos"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, k, text) at double line ends."""
    return documents.select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("k", "text"))


def text_vectors(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, item, vec): vectors of text files; of an item given more than once the last line counts."""
    good = loaded_lines(lines, files)
    return good.groupBy("file_id", "item").agg(F.max_by("vectors", "line_no").alias("vec"))


def vector_file(spark: SparkSession, path: str, dims: int, kind: str = WITHOUT_HEADER) -> DataFrame:
    """(item, vec) of one text vector file on disk; order of lines is the file's, as one partition a block.

    The line number is the offset order of the text source and only decides between repeated items.
    """
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id() + 1).select(F.lit(1).cast("long").alias("file_id"), "line_no", F.col("value").alias("line"))
    files = spark.createDataFrame([(1, dims, kind)], "file_id long, num_dimensions int, vector_type string")
    return text_vectors(lines, files).select("item", "vec")


def weights_file(spark: SparkSession, path: str) -> DataFrame:
    """(item, w) from lines of a word and a number."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias("item"), F.expr("try_cast(p[1] as double)").alias("w")).where("w is not null")


def frequencies_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a frequency file: number of documents, (form, ref, n), (ref, n)."""
    raw = spark.read.option("multiLine", True).schema("docs long, mentions map<string,array<array<string>>>, meanings map<string,long>").json(path)
    pairs = raw.select(F.explode("mentions").alias("form", "list")).select("form", F.explode("list").alias("p"))
    return {
        "docs": raw.select("docs"),
        "form_meanings": pairs.select("form", F.col("p")[0].alias("ref"), F.col("p")[1].cast("long").alias("n")),
        "meanings": raw.select(F.explode("meanings").alias("ref", "n")),
    }


#: Fixed value: the form of an annotation in the annotated corpus.
ANNOTATION = r"<babelNetID>([^<]*)</babelNetID>\s*<mention>([^<]*)</mention>"


def annotations(documents: DataFrame, pattern: str = ANNOTATION, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ref, form) of all matches of a two-group pattern in each text."""
    pairs = F.arrays_zip(F.regexp_extract_all(text_column, F.lit(pattern), 1).alias("ref"), F.regexp_extract_all(text_column, F.lit(pattern), 2).alias("form"))
    return documents.select(F.col(id_column).alias("doc_id"), F.explode(pairs).alias("p")).select("doc_id", "p.ref", "p.form")


def gold_rankings(files: DataFrame) -> DataFrame:
    """(doc_id, k, alternatives, covered) of gold files (path, text), documents in the order of their names.

    A line holds alternatives parted by bars and the covered text in quotes.
    """
    lines = files.select("path", F.posexplode(F.split("text", r"\n")).alias("k", "line"))
    # fixed value: the form of a gold line
    pattern = r'((?:bn:\d{8}[ranv]\|?)+)-"([^"]*)"'
    found = lines.where(F.col("line").rlike(pattern))
    name = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return found.select(name.alias("doc_id"), "k", F.filter(F.split(F.regexp_extract("line", pattern, 1), r"\|"), lambda x: x != "").alias("alternatives"), F.regexp_extract("line", pattern, 2).alias("covered")).orderBy("doc_id", "k")


def gold_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(key, refs): the first token, or first-last of a span, and its answers; lines of fewer than three columns are left out."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    key = F.when(F.col("p")[0] == F.col("p")[1], F.col("p")[0]).otherwise(F.concat_ws("-", F.col("p")[0], F.col("p")[1]))
    return p.select(key.alias("key"), F.filter(F.slice("p", F.lit(3), F.size("p")), lambda x: x != "").alias("refs"))


def scorer_keys(spark: SparkSession, path: str, doc: str | None = None) -> DataFrame:
    """(key, refs) for scoring: both token ids joined, answers in lower case with spaces for underscores."""
    p = spark.read.text(path).select(F.split("value", r"\s+").alias("p")).where(F.size("p") >= 3)
    if doc:
        p = p.where(F.col("p")[0].startswith(doc))
    answers = F.transform(F.filter(F.slice("p", F.lit(3), F.size("p")), lambda x: x != ""), lambda x: F.replace(F.lower(x), F.lit("_"), F.lit(" ")))
    return p.select(F.concat(F.col("p")[0], F.col("p")[1]).alias("key"), answers.alias("refs")).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))


def types_json(spark: SparkSession, path: str, meanings: DataFrame) -> DataFrame:
    """(ref, type) of all meanings; those the file lacks, or gives no known type, are Other."""
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("ref", "type"))
    return meanings.select("ref").distinct().join(raw, "ref", "left").select("ref", F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("Other").alias("type"))


#: Simple tags of the dictionary by the first letters of a tagset's tags.
TAGSETS = {
    "en": {"NN": "N", "VB": "V", "JJ": "J", "RB": "R"},
    "de": {"NN": "N", "NE": "N", "VV": "V", "VA": "V", "VM": "V", "ADJ": "J", "ADV": "R"},
    "es": {"n": "N", "v": "V", "a": "J", "r": "R"},
    "fr": {"N": "N", "V": "V", "ADJ": "J", "A": "J", "ADV": "R"},
    "tr": {"Noun": "N", "Verb": "V", "Adj": "J", "Adv": "R"},
    "ar": {"NN": "N", "DTNN": "N", "VB": "V", "JJ": "J", "DTJJ": "J", "RB": "R"},
}


def dictionary_pos(tag, lang: str):
    """Simple tag of a tagset's tag, X for all others; the longest matching beginning counts."""
    out = F.lit("X")
    for begin, to in sorted(TAGSETS[lang].items(), key=lambda kv: len(kv[0])):
        out = F.when(tag.startswith(begin), to).otherwise(out)
    return out


def item_keys(vectors: DataFrame) -> DataFrame:
    return vectors.select("item").distinct()


def surrogate_dictionary(lemmas: DataFrame, n_refs: int, senses: int = 3, step: int = 37) -> DataFrame:
    """(lemma, sense_rank, ref): senses of a lemma by its hash, where no dictionary is at hand."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(senses - 1))).alias("k")
    return lemmas.select("lemma").distinct().select("lemma", ks).select("lemma", (F.col("k") + 1).cast("int").alias("sense_rank"), F.pmod(hash28(F.col("lemma")) + step * F.col("k"), F.lit(n_refs)).alias("ref"))
