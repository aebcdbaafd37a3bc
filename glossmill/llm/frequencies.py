"""Frequency of every distinct value: heavy-light aggregation.

1. One pass over all rows makes mergeable frequent-items sketches of the values and of the texts. A
   value is heavy if it may hold at least 1/1000 of a field's tokens, so there are about 1000 of
   them by proof; they are broadcast, each with its place in the counter arrays. A text is hot if
   it may hold at least 1/2000 of all rows.
2. A second pass packs the tokens of each text, as far as they stand in one block of the scan, into
   one compressed record, with the places of heavy values instead of the values. Records are brought
   together by text, since a token may be repeated anywhere and only its id can tell; a hot
   text is spread by its tokens.
3. Where a text is together its tokens are counted in place: heavy values in one pair of exact
   local counter arrays a task, the others in a local table that is handed on when full. Only these
   are shuffled by value, already counted.
4. Both count tables are united. All counts are exact; sketches only decide the way.

Defined results
---------------
* each tok_id counts once per value; null and empty values are left out; values are compared code
  point by code point, as stored.
* marks: ``rare`` if the value is in exactly one text, else ``common`` if in more than a third of
  all texts of tokens, else null.
* rows without text_id are left out; those without tok_id only make their text count as one; an
  empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.context import cut_lineage
from glossmill.llm.packing import hot_texts, packed_texts, text_sketch, unpacked

#: A value is heavy from this share of a field's rows on; at most its inverse can be.
HEAVY_SHARE = 1 / 1000
#: Values of a task's local table; when full, it is handed on.
LOCAL_VALUES = 400_000
FIELDS = ("lemma", "wf")
COUNTED = "field_name string, term string, text_id string, n_tokens long, n_texts long"


def detect(tokens: DataFrame, fields: tuple[str, ...] = FIELDS) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """Heavy (field, value) pairs and hot texts with the number of tasks that share one; one pass, bounded results."""
    sketches = [F.expr(f"approx_top_k(nullif({f}, ''), {int(1 / HEAVY_SHARE)}, {int(10 / HEAVY_SHARE)})").alias(f"_{k}") for k, f in enumerate(fields)]
    row = tokens.agg(F.count("*").alias("rows"), *sketches, text_sketch().alias("_texts")).first()
    heavy = [(f, x["item"]) for k, f in enumerate(fields) for x in row[f"_{k}"] or [] if x["item"] is not None and x["count"] >= HEAVY_SHARE * row["rows"]]
    return heavy, hot_texts(row["_texts"], row["rows"])


def _counter(heavy: list[tuple[str, str]], hot: dict[str, int], fields: tuple[str, ...]):
    """Counts the records of a task, which come ordered by text and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens, n_texts = np.zeros(len(heavy), dtype=np.int64), np.zeros(len(heavy), dtype=np.int64)
        local: list[dict[str, list[int]]] = [{} for _ in fields]
        texts = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["field_name", "term", "text_id", "n_tokens", "n_texts"])

        def counted(text: str, ids: list, values: list[list]) -> list[tuple]:
            """Counts one text, or one part of a hot one, whose counts come out by text."""
            out = [(None, None, text, 0, 0)] if text in hot else []
            for k, column in enumerate(values):
                pairs = set(zip(ids, column))
                for value, n in Counter(v for i, v in pairs if i is not None and v is not None).items():
                    if text in hot:
                        out.append((fields[k], heavy[value][1] if isinstance(value, int) else value, text, n, 0))
                    elif isinstance(value, int):
                        n_tokens[value] += n
                        n_texts[value] += 1
                    elif value in local[k]:
                        have = local[k][value]
                        have[0] += n
                        have[1] += 1
                    else:
                        local[k][value] = [n, 1]
            return out

        def handed_on() -> list[tuple]:
            rows = [(f, v, None, n, m) for f, table in zip(fields, local) for v, (n, m) in table.items()]
            for table in local:
                table.clear()
            return rows

        before = None
        for text, ids, values in unpacked(batches, len(fields)):
            texts += text not in hot and text != before
            before = text
            if rows := counted(text, ids, values):
                yield batch_of(rows)
            if sum(map(len, local)) > LOCAL_VALUES:
                yield batch_of(handed_on())
        if before is not None:
            used = np.flatnonzero(n_texts).tolist()
            yield batch_of(handed_on() + [(*heavy[p], None, int(n_tokens[p]), int(n_texts[p])) for p in used] + [(None, None, None, 0, texts)])

    return run


def local_counts(tokens: DataFrame, fields: tuple[str, ...] = FIELDS, heavy: list[tuple[str, str]] | None = None, hot: dict[str, int] | None = None) -> DataFrame:
    """The counts of each task, written once: by value, by value and text for hot texts; rows without field count the texts, or name a hot one."""
    rows = tokens.where("text_id is not null").select("text_id", "tok_id", *fields)
    if heavy is None or hot is None:
        found = detect(rows, fields)
        heavy, hot = found[0] if heavy is None else heavy, found[1] if hot is None else hot
    places: dict[str, dict[str, int]] = {f: {} for f in fields}
    for p, (f, v) in enumerate(heavy):
        places[f][v] = p
    together = packed_texts(rows, fields, hot, places)
    return cut_lineage(together.mapInArrow(_counter(heavy, hot, fields), COUNTED))


def _united(counts: DataFrame) -> DataFrame:
    """(field_name, term, n_tokens, n_texts) from the counts of the tasks."""
    by_text = counts.where("field_name is not null and text_id is not null").groupBy("field_name", "term", "text_id").agg(F.sum("n_tokens").alias("n_tokens"), F.lit(1).cast("long").alias("n_texts"))
    whole = counts.where("field_name is not null and text_id is null").unionByName(by_text)
    return whole.groupBy("field_name", "term").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_texts").alias("n_texts"))


def term_counts(tokens: DataFrame, fields: tuple[str, ...] = FIELDS, heavy: list[tuple[str, str]] | None = None, hot: dict[str, int] | None = None) -> DataFrame:
    """(field_name, term, n_tokens, n_texts) for every distinct value of ``fields``."""
    return _united(local_counts(tokens, fields, heavy, hot))


def marked_terms(tokens: DataFrame, fields: tuple[str, ...] = FIELDS, common_share: float = 1 / 3, hot: dict[str, int] | None = None) -> DataFrame:
    """``term_counts`` with the mark of the too rare and the too common."""
    counts = local_counts(tokens, fields, hot=hot)
    row = counts.where("field_name is null").agg(F.sum("n_texts"), F.count_distinct("text_id")).first()  # hot texts by name, as several tasks have parts of one
    n_texts = (row[0] or 0) + row[1]
    common = F.col("n_texts") > F.lit(common_share * n_texts) if common_share != 1 / 3 else F.col("n_texts") * 3 > F.lit(n_texts)
    mark = F.when(F.col("n_texts") == 1, "rare").when(common, "common")
    return _united(counts).withColumn("mark", mark)
