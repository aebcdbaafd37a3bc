"""Tokens packed by text, so that what belongs to one text is counted in one place.

Tokens may be repeated anywhere and only their ids can tell, so those of a text have to meet. They
meet as one compressed record for each text and block of the scan, which carries the ids and, for
each field, the values or the places of known heavy values. A hot text is spread by its tokens over
a task for each ``HOT_ROWS`` of its rows; what is counted of its parts is to be united by text.
"""

from __future__ import annotations

import marshal
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text is hot from this share of all rows on, and spread over a task for each so many rows.
HOT_SHARE, HOT_ROWS = 1 / 2000, 200_000


def text_sketch() -> Column:
    """A mergeable sketch of the texts with most rows; ``hot_texts`` reads it."""
    return F.expr(f"approx_top_k(text_id, {int(1 / HOT_SHARE)}, {int(10 / HOT_SHARE)})")


def hot_texts(sketch: list | None, rows: int) -> dict[str, int]:
    """Hot texts with the number of parts of each; at most 1 / HOT_SHARE."""
    least = max(HOT_SHARE * rows, HOT_ROWS)
    return {x["item"]: -(-x["count"] // HOT_ROWS) for x in sketch or [] if x["item"] is not None and x["count"] >= least}


def _packer(places: dict[str, dict[str, int]], hot: dict[str, int], fields: tuple[str, ...]):
    """Records (text_id, part, tokens) of the texts of each block: ids, and for each field values or places of heavy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).dictionary_encode()
            names, code = texts.dictionary.to_pylist(), texts.indices.to_numpy()
            ids = batch.column(1).to_pylist()
            part = np.zeros(len(code), dtype=np.int64)
            for k, name in enumerate(names):
                if (parts := hot.get(name, 1)) > 1:
                    for i in np.flatnonzero(code == k):
                        part[i] = zlib.crc32((ids[i] or "").encode()) % parts
            order = np.lexsort((part, code))
            cuts = np.flatnonzero(np.diff(code[order]) | np.diff(part[order])) + 1
            values = []
            for k, f in enumerate(fields):
                at = places[f].get
                values.append([None if not v else at(v, v) for v in batch.column(2 + k).take(pa.array(order)).to_pylist()])
            ids = [ids[i] for i in order]
            out: tuple[list, list, list] = ([], [], [])
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                out[0].append(names[code[order[a]]])
                out[1].append(int(part[order[a]]))
                out[2].append(zlib.compress(marshal.dumps((ids[a:b], [v[a:b] for v in values])), 1))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["text_id", "part", "tokens"])

    return run


def packed_texts(tokens: DataFrame, fields: tuple[str, ...], hot: dict[str, int], places: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Records (text_id, part, tokens) of ``tokens(text_id, tok_id, fields)``, those of a text or part together and in order.

    One shuffle, of the compressed records.
    """
    run = _packer(places or {f: {} for f in fields}, hot, fields)
    packed = tokens.select("text_id", "tok_id", *fields).mapInArrow(run, "text_id string, part int, tokens binary")
    return packed.repartition("text_id", "part").sortWithinPartitions("text_id", "part")


def unpacked(batches: Iterator[pa.RecordBatch], n_fields: int) -> Iterator[tuple[str, list, list[list]]]:
    """(text, ids, values by field) of each text or part of a hot text, from ``packed_texts``; an id may be repeated."""
    at, ids, values = None, [], [[] for _ in range(n_fields)]
    for batch in batches:
        for text, part, record in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (text, part) != at:
                if at:
                    yield at[0], ids, values
                at, ids, values = (text, part), [], [[] for _ in range(n_fields)]
            more, columns = marshal.loads(zlib.decompress(record))
            ids += more
            for have, column in zip(values, columns):
                have += column
    if at:
        yield at[0], ids, values
