"""Vector lines that cannot be read, set apart with the reason, while the rest load.

Lines of one number of dimensions are read in columns, block by block. A block that holds any line
that is not surely right is bisected until the bad lines stand alone; only those are diagnosed
line by line. The columnar checks of a batch are made once and shared by all of its blocks, so that
bisection costs no second parse. They never accept what the strict check would refuse.

Defined results
---------------
* null or blank line: reason ``columns``; a file that is not in ``files``, or has no number of
  dimensions: every line ``columns``.
* (file_id, line_no) that comes more than once counts once.
* the header (line 1 of a Text_Glove file) is neither loaded nor rejected.
* items given more than once are all loaded; ``last_wins`` of the vector source keeps one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: a finite decimal number in ASCII digits.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NUMBER = re.compile(NUMBER.replace("$", r"\Z"))
_QUOTED = re.compile(r'"((?:[^"]|"")*)"(?= |\Z)')
LINE_SCHEMA = "file_id long, line_no long, item string, vectors array<double>, reason string"


def diagnose(line: str | None, dims: int | None) -> tuple[str | None, list[float] | None, str | None]:
    """Strict reading of one line: (item, numbers, None) or (None, None, reason)."""
    if line is None or not line.strip():
        return None, None, "columns"
    line = line.rstrip()
    item, rest = None, line
    if '"' in line:
        m = _QUOTED.match(line)
        if not m or '"' in line[m.end() :]:
            return None, None, "quoting"
        item, rest = m[1].replace('""', '"'), line[m.end() :]
        columns = ["", *rest.split(" ")[1:]]
    else:
        columns = line.split(" ")
        item = columns[0]
    if dims is None or len(columns) != dims + 1:
        return None, None, "columns"
    if not item or not all(map(_NUMBER.match, columns[1:])):
        return None, None, "value"
    numbers = [float(x) for x in columns[1:]]
    if not np.isfinite(numbers).all():
        return None, None, "value"
    return item, numbers, None


#: Lines of a first block.
BLOCK = 256
_NUMBERS = r"(?: [+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)*$"
_PLAIN_LINE = r'^[^ "]+' + _NUMBERS
_QUOTED_ITEM = r'^"(?:[^"]|"")+"'
_QUOTED_LINE = _QUOTED_ITEM + _NUMBERS
#: A number that may be too large to be finite: one with an exponent, or of very many digits.
_LARGE = r" [^ ]*(?:[eE]|[0-9]{300})"


class Columns:
    """The lines of a batch as columns: which are surely right, and their items and numbers."""

    def __init__(self, lines: pa.Array, dims: int) -> None:
        self.dims = dims
        trimmed = pc.utf8_rtrim_whitespace(pc.fill_null(lines, ""))
        quoted = pc.match_substring(trimmed, '"')
        shape = pc.if_else(quoted, pc.match_substring_regex(trimmed, _QUOTED_LINE), pc.match_substring_regex(trimmed, _PLAIN_LINE))
        # the numbers alone: a quoted item may hold spaces
        self.quoted = quoted.to_numpy(zero_copy_only=False)
        bare = pc.replace_substring_regex(trimmed, _QUOTED_ITEM, "q") if self.quoted.any() else trimmed
        counted = pc.equal(pc.count_substring(bare, " "), dims)
        ended = pc.invert(pc.match_substring(trimmed, "\n"))  # the end of a pattern would let a last line feed pass
        self.right = pc.and_(pc.and_(shape, counted), ended).to_numpy(zero_copy_only=False).copy()
        self.trimmed, self.bare = trimmed, bare
        large = np.flatnonzero(self.right & pc.match_substring_regex(bare, _LARGE).to_numpy(zero_copy_only=False))
        if len(large):
            self.right[large] = np.isfinite(self.numbers(large)).all(axis=1)

    def cells(self, rows: np.ndarray) -> pa.Array:
        return pc.split_pattern(self.bare.take(pa.array(rows)), " ").flatten()

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        """The (n, dims) matrix of right lines."""
        cells = self.cells(rows)
        keep = np.ones(len(cells), dtype=bool)
        keep[:: self.dims + 1] = False
        return cells.filter(pa.array(keep)).to_numpy(zero_copy_only=False).astype("U").astype(np.float64).reshape(-1, self.dims)

    def items(self, rows: np.ndarray) -> list[str]:
        names = self.cells(rows)[:: self.dims + 1].to_pylist()
        for k in np.flatnonzero(self.quoted[rows]):
            names[k] = _QUOTED.match(self.trimmed[int(rows[k])].as_py())[1].replace('""', '"')
        return names


def bulk_parse(lines: pa.Array, dims: int) -> tuple[pa.Array, np.ndarray] | None:
    """Items and an (n, dims) matrix of a block without any line in doubt, else None."""
    columns = Columns(lines, dims)
    rows = np.arange(len(lines))
    return (pa.array(columns.items(rows)), columns.numbers(rows)) if columns.right.all() else None


def _bisect(right: np.ndarray, start: int, stop: int, good: list[tuple[int, int]], bad: list[int]) -> None:
    """The ranges of a block that are right throughout, and its bad lines."""
    if right[start:stop].all():
        good.append((start, stop))
    elif stop - start == 1:
        bad.append(start)
    else:
        half = (start + stop) // 2
        _bisect(right, start, half, good, bad)
        _bisect(right, half, stop, good, bad)


def _reader(with_values: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.string()]
        names = ["file_id", "line_no", "item", "vectors", "reason"]
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = batch.column("line").cast(pa.string())
            dims = batch.column("num_dimensions").to_pandas().to_numpy(dtype=float, na_value=np.nan)
            item: list = [None] * batch.num_rows
            vectors: list = [None] * batch.num_rows
            reason: list = [None] * batch.num_rows
            bad = list(np.flatnonzero(np.isnan(dims)))
            for d in np.unique(dims[~np.isnan(dims)]):
                places = np.flatnonzero(dims == d)
                columns = Columns(lines.take(pa.array(places)), int(d))
                good: list[tuple[int, int]] = []
                wrong: list[int] = []
                for start in range(0, len(places), BLOCK):
                    _bisect(columns.right, start, min(start + BLOCK, len(places)), good, wrong)
                bad += places[wrong].tolist()
                if with_values and good:
                    rows = np.concatenate([np.arange(a, b) for a, b in good])
                    for i, name, values in zip(places[rows], columns.items(rows), columns.numbers(rows)):
                        item[i], vectors[i] = name, values
            for i in bad:
                d = dims[i]
                one = diagnose(lines[int(i)].as_py(), None if np.isnan(d) else int(d))
                reason[i] = one[2]
                if with_values:
                    item[i], vectors[i] = one[0], one[1]
            arrays = [batch.column("file_id"), batch.column("line_no"), item, vectors, reason]
            made = [a.cast(t) if isinstance(a, pa.Array) else pa.array(a, type=t) for a, t in zip(arrays, types)]
            out = pa.RecordBatch.from_arrays(made, names=names)
            yield out if with_values else out.filter(pc.is_valid(out.column("reason")))

    return read


def read_vector_lines(lines: DataFrame, files: DataFrame, with_values: bool = True) -> DataFrame:
    """Every line as (item, vectors) or with its reason; ``with_values=False`` yields rejects only.

    The file table is a few hundredths of the lines; the optimizer broadcasts it only while its
    measured size is under the session's threshold and else shuffles both sides on file_id.
    """
    kinds = files.select("file_id", "num_dimensions", "vector_type").dropDuplicates(["file_id"])
    joined = lines.select("file_id", "line_no", "line").join(kinds, "file_id", "left")
    header = (F.col("line_no") == 1) & F.coalesce(F.col("vector_type") == "Text_Glove", F.lit(False))
    return joined.where(~header).select("file_id", "line_no", "line", "num_dimensions").mapInArrow(_reader(with_values), LINE_SCHEMA)


def rejected_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line_no, reason) of the lines that cannot be read, once each."""
    found = read_vector_lines(lines, files, with_values=False)
    return found.select("file_id", "line_no", "reason").dropDuplicates(["file_id", "line_no"])


def loaded_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, line_no, item, vectors) of the lines that can be read, once each."""
    found = read_vector_lines(lines, files).where("reason is null")
    return found.drop("reason").dropDuplicates(["file_id", "line_no"])
