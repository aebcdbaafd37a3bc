"""Command line: the queries, the plans and their stages. Tables are Parquet folders.

    python -m glossmill list
    python -m glossmill run QUERY DATA_FOLDER OUT
    python -m glossmill semeval CORPUS_XML DICTIONARY MEANINGS VECTORS GOLD_TSV OUT   # senses as lines; scores are printed
    python -m glossmill system TOKENS DICTIONARY MEANINGS VECTORS OUT                 # ranked senses of annotated tokens
    python -m glossmill candidates TOKENS DICTIONARY OUT                              # candidates of all mentions
    python -m glossmill rankeval RANKS GOLD_FOLDER [--suffix .gold]                   # mean average precision
    python -m glossmill meanings MEANINGS OUT [--most N]
    python -m glossmill context MEANINGS VECTORS OUT [--dims N]                       # gloss vectors as lines
    python -m glossmill freqs DOCUMENTS OUT | subset FREQUENCIES CANDIDATES OUT       # frequency files
    python -m glossmill stats TOKENS CANDIDATES OUT                                   # coverage and polysemy of documents
    python -m glossmill types MEANINGS TYPES_JSON OUT                                 # types of meanings
    python -m glossmill plan DOCUMENTS OUT [--stage extract|dedup|order] [--keep N]
    python -m glossmill summarise DOCUMENTS OUT [--keep N]
    python -m glossmill vectors LINES FILES OUT

TOKENS: doc_id, sent_id, i, form, lemma, pos. DICTIONARY: lemma, sense_rank, ref. MEANINGS: ref, vec, and
for some commands glosses and lemmas. VECTORS: item, vec. CANDIDATES: doc_id, sent_id, l, r, mention_id, ref.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill import queries
from glossmill.operators import aggregates as A
from glossmill.operators import candidates as C
from glossmill.operators import context as X
from glossmill.operators import evaluation as E
from glossmill.options import Options
from glossmill.plans import disambiguation as D
from glossmill.plans import summary
from glossmill.sources import readers, sinks

#: Positional arguments of each command; the names of inputs that must be there end the help above.
COMMANDS = {
    "list": "", "run": "query data out", "semeval": "corpus dictionary meanings vectors gold out", "system": "tokens dictionary meanings vectors out",
    "candidates": "tokens dictionary out", "rankeval": "ranks gold", "meanings": "meanings out", "context": "meanings vectors out", "freqs": "documents out",
    "subset": "frequencies candidates out", "stats": "tokens candidates out", "types": "meanings types out", "plan": "documents out", "summarise": "documents out",
    "vectors": "lines files out",
}


def positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return n


def share(text: str) -> float:
    x = float(text)
    if not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("must be from 0 to 1")
    return x


def existing(text: str) -> str:
    """A local path has to be there; paths of other file systems are left to Spark."""
    if "://" not in text and not os.path.exists(text):
        raise argparse.ArgumentTypeError(f"no such file or folder: {text}")
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        c = sub.add_parser(name)
        for a in arguments.split():
            kind = {"query": str, "out": str}.get(a, existing)
            c.add_argument(a, type=kind, choices=sorted(queries.QUERIES) if a == "query" else None)
        if name in ("plan", "summarise"):
            c.add_argument("--keep", type=positive, default=10)
        if name == "plan":
            c.add_argument("--stage", choices=("extract", "dedup", "order"), default="order")
        if name in ("semeval", "system"):
            c.add_argument("--threshold", type=share, default=Options().sim_threshold)
            c.add_argument("--context", type=share, default=Options().context_threshold)
        if name in ("semeval", "system", "context"):
            c.add_argument("--dims", type=positive, default=64)
        if name == "meanings":
            c.add_argument("--most", type=positive)
        if name == "rankeval":
            c.add_argument("--suffix", default=".gold")
    return p


def _chosen(a: argparse.Namespace, tokens: DataFrame, read) -> DataFrame:
    """The ranked sense of each mention with its first and last token."""
    options = Options(sim_threshold=a.threshold, context_threshold=a.context, excluded_pos=("X", "R"))
    inputs = D.Inputs(tokens, read(a.dictionary), read(a.meanings), read(a.vectors), a.dims)
    spans = D.mentions(inputs, options).select("mention_id", "doc_id", "sent_id", "l", "r")
    chosen = D.disambiguate(inputs, options).join(spans, ["doc_id", "mention_id"])
    known = tokens.select("doc_id", "sent_id", "i", F.coalesce(F.col("tok_id"), F.lit("")).alias("tok_id")) if "tok_id" in tokens.columns else tokens.select("doc_id", "sent_id", "i", F.concat_ws(".t", "sent_id", F.col("i") + 1).alias("tok_id"))
    for name, at in (("first_tok", F.col("l")), ("last_tok", F.col("r") - 1)):
        chosen = chosen.withColumn("i", at).join(known.withColumnRenamed("tok_id", name), ["doc_id", "sent_id", "i"]).drop("i")
    return chosen


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(queries.QUERIES)))
        return
    spark = spark or SparkSession.builder.appName("glossmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    read = spark.read.parquet

    def save(df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(a.out)

    match a.command:
        case "run":
            save(queries.QUERIES[a.query](spark, a.data))
        case "semeval":
            tokens = readers.annotated_corpus(spark, a.corpus).withColumnRenamed("text_id", "doc_id")
            chosen = _chosen(a, tokens, read).persist()
            sinks.write_tsv(sinks.results_tsv(chosen), a.out)
            key = F.when(F.col("first_tok") == F.col("last_tok"), F.col("first_tok")).otherwise(F.concat_ws("-", "first_tok", "last_tok"))
            scores = E.precision_recall(chosen.select(key.alias("key"), F.col("ref").cast("string").alias("ref")), readers.gold_tsv(spark, a.gold)).first()
            print("precision, recall, F1:", *scores)
        case "system":
            save(_chosen(a, read(a.tokens), read).select("doc_id", "first_tok", "last_tok", "ref"))
        case "candidates":
            found = D.mentions(D.Inputs(read(a.tokens), None, None, None), Options(excluded_pos=("X", "R")))
            save(C.lookup(found, read(a.dictionary)).join(found.select("doc_id", "sent_id", "mention_id", "l", "r"), ["doc_id", "mention_id"]))
        case "rankeval":
            gold = readers.gold_rankings(readers.text_files(spark, a.gold, a.suffix)).select("doc_id", F.explode("alternatives").alias("ref"))
            print("mean average precision, documents:", *E.mean_average_precision(E.rank_list(read(a.ranks)), gold).first())
        case "meanings":
            save(A.described_meanings(read(a.meanings), a.most))
        case "context":
            glosses = read(a.meanings).select("ref", F.explode("glosses").alias("gloss"))
            sinks.write_text(sinks.vector_text(X.gloss_vectors(glosses, read(a.vectors), a.dims), "ref"), a.out)
        case "freqs":
            notes = readers.annotations(read(a.documents)).persist()
            counts = A.frequencies(notes)
            sinks.write_frequencies_json(notes.agg(F.count_distinct("doc_id")).first()[0], counts["form_meanings"], counts["meanings"], a.out)
        case "subset":
            all_, wanted = readers.frequencies_json(spark, a.frequencies), read(a.candidates).select(F.col("ref").cast("string").alias("ref")).distinct()
            n = all_["docs"].first()[0]
            sinks.write_frequencies_json(n, *(all_[k].join(wanted, "ref", "left_semi").select(*all_[k].columns) for k in ("form_meanings", "meanings")), a.out)
        case "stats":
            c = read(a.candidates)
            save(A.coverage(read(a.tokens), c.select("doc_id", "sent_id", "mention_id", "l", "r").distinct(), c))
        case "types":
            save(readers.types_json(spark, a.types, read(a.meanings)))
        case "plan":
            save(summary.plan_banks(read(a.documents), keep=a.keep, stage=a.stage))
        case "summarise":
            sinks.write_text(summary.summarise(read(a.documents), keep=a.keep), a.out, "amr")
        case _:
            sinks.write_text(sinks.vector_text(readers.text_vectors(read(a.lines), read(a.files))), a.out)


if __name__ == "__main__":
    main()
