"""Deeply nested corpus batches to flat tables (columnar shredding).

Every leaf path (the id of a text, of a sentence and of a token, and a token's lemma, pos and wf)
becomes one stream of values with, for every entry, the repetition level (which repeated ancestor
starts anew) and the definition level (how deep the path is defined), as in columnar file formats.
Nested columns are shredded by array arithmetic on their offsets, JSON payloads by one walk over each
record. The flat table of each repeated ancestor is then rebuilt from the streams of its leaves, with
array arithmetic on the level sequences alone.

Defined results
---------------
* null payload and null ``texts``, blank or broken JSON: no rows.
* null elements are no records; an empty object, a record without id and a bare word are records.
* a single object or word in place of an array is an array of one; a string that holds a JSON
  array is that array.
* a batch_id that comes more than once counts once; rows without batch_id have no key and are left out.
* both ``texts`` and ``payload`` given: ``texts`` unless it is empty.
* other members are ignored, wherever they stand and whatever they are called.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Member names of the three repeated levels, as the source tools write them.
LEVEL_NAMES = (("texts", "text"), ("sentences", "sentence"), ("tokens", "wf"))
#: Member names of the leaves of a record.
LEAF_NAMES = {
    "id": ("id", "@id", "_id"),
    "lemma": ("lemma", "@lemma", "_lemma"),
    "pos": ("pos", "@pos", "_pos"),
    "wf": ("wf", "#text", "_VALUE", "form"),
}
RECORD_SCHEMA = "batch_id long, text_no int, sentence_no int, token_no int, id string, lemma string, pos string, wf string"


def as_array(value: object) -> list:
    """The records a member stands for: arrays as they are, a lone value as an array of one."""
    if value is None:
        return []
    if isinstance(value, str):
        stripped = value.strip()
        if stripped[:1] == "[":
            try:
                return as_array(json.loads(stripped))
            except ValueError:
                return [value]
        return [value] if stripped else []
    if isinstance(value, list):
        flat: list = []
        for x in value:
            flat.extend(as_array(x) if isinstance(x, list) else [] if x is None else [x])
        return flat
    return [value]


def _member(record: object, names: tuple[str, ...]) -> object:
    if isinstance(record, dict):
        for name in names:
            if record.get(name) is not None:
                return record[name]
    return None


def _roots(payload: str | None) -> list:
    """The text records of one payload."""
    if payload is None or not payload.strip():
        return []
    try:
        value = json.loads(payload)
        if isinstance(value, str):
            value = json.loads(value)
    except ValueError:
        return []
    if isinstance(value, list):
        return as_array(value)
    found = _member(value, LEVEL_NAMES[0])
    if found is not None:
        return as_array(found)
    return [x for corpus in as_array(_member(value, ("corpus",))) for x in as_array(_member(corpus, LEVEL_NAMES[0]))]


#: Leaf paths: the level of the repeated ancestor (0 text, 1 sentence, 2 token) and the member.
LEAVES = ((0, "id"), (1, "id"), (2, "id"), (2, "lemma"), (2, "pos"), (2, "wf"))
#: Batches shredded at a time.
CHUNK = 256


class LevelStreams:
    """One stream of repetition levels, definition levels and values per leaf path.

    The definition level counts the defined members of the path: one for each ancestor, and one
    more where the leaf itself has a value.
    """

    def __init__(self) -> None:
        self.rep: list[list[int]] = [[] for _ in LEAVES]
        self.dfn: list[list[int]] = [[] for _ in LEAVES]
        self.value: list[list[str | None]] = [[] for _ in LEAVES]

    def add(self, roots: list) -> None:
        """Append one batch; repetition level 0 opens it in every stream."""
        self._walk(roots, 0, 0)

    def _walk(self, records: list, depth: int, rep: int) -> None:
        if not records:
            for k, (level, _) in enumerate(LEAVES):
                if level >= depth:
                    self._put(k, rep, depth, None)
            return
        for record in records:
            for k, (level, name) in enumerate(LEAVES):
                if level == depth:
                    value = _leaf(record, name, depth)
                    self._put(k, rep, depth + 1 + (value is not None), value)
            if depth < 2:
                self._walk(as_array(_member(record, LEVEL_NAMES[depth + 1])), depth + 1, rep)
            rep = depth + 1

    def _put(self, k: int, rep: int, dfn: int, value: str | None) -> None:
        self.rep[k].append(rep)
        self.dfn[k].append(dfn)
        self.value[k].append(value)

    def streams(self) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
        return [(np.array(r, dtype=np.int64), np.array(d, dtype=np.int64), pa.array(v, pa.string())) for r, d, v in zip(self.rep, self.dfn, self.value)]


def nested_streams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """The streams of a nested column, from its offsets; members that its type lacks have no values."""

    def member(records: pa.Array, name: str) -> pa.Array | None:
        known = isinstance(records, pa.StructArray) and records.type.get_field_index(name) >= 0
        return pc.struct_field(records, name) if known else None

    streams: list = [None] * len(LEAVES)
    rep, dfn = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    record = np.arange(len(texts))  # the record of the level above that an entry is of, -1 where the path has ended
    lists: pa.Array | None = texts
    for depth in range(3):
        if lists is None:
            records, count = None, np.zeros(int(record.max(initial=-1)) + 1, dtype=np.int64)
        else:
            owner, records = pc.list_parent_indices(lists), pc.list_flatten(lists)
            there = pc.is_valid(records)
            records = records.filter(there)
            count = np.bincount(owner.filter(there).to_numpy(), minlength=len(lists))
        first = np.cumsum(count) - count
        live = record >= 0
        children = np.zeros(len(record), dtype=np.int64)
        children[live] = count[record[live]]
        times = np.maximum(children, 1)
        entry = np.repeat(np.arange(len(record)), times)
        within = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
        real = children[entry] > 0
        rep, dfn = np.where(within == 0, rep[entry], depth + 1), np.where(real, depth + 1, dfn[entry])
        record = np.where(real, np.where(live[entry], first[np.maximum(record[entry], 0)] if len(first) else 0, 0) + within, -1)
        for k, (level, name) in enumerate(LEAVES):
            if level == depth:
                values = member(records, name) if records is not None else None
                if values is None:
                    streams[k] = (rep, dfn, pa.nulls(len(rep), pa.string()))
                else:
                    at = pa.array(np.where(real, record, 0), mask=~real)
                    taken = values.cast(pa.string()).take(at)
                    streams[k] = (rep, dfn + taken.is_valid().to_numpy(zero_copy_only=False), taken)
        lists = member(records, LEVEL_NAMES[depth + 1][0]) if records is not None and depth < 2 else None
    return streams


def ordinals(rep: np.ndarray, dfn: np.ndarray, depth: int) -> list[np.ndarray]:
    """Batch index and the 0-based place at each level down to ``depth``, from levels alone.

    A place counts the defined entries at its level since the last entry that repeats at a
    higher level.
    """
    index = np.arange(len(rep))
    places = [np.cumsum(rep == 0) - 1]
    for level in range(depth + 1):
        starts = (rep <= level + 1) & (dfn > level)
        count = np.cumsum(starts)
        opened = np.maximum.accumulate(np.where(rep <= level, index, 0))
        before = count[opened] - starts[opened]
        places.append(count - before - 1)
    return places


def _leaf(record: object, name: str, depth: int) -> str | None:
    if not isinstance(record, dict):
        return str(record) if record is not None and name == "wf" and depth == 2 else None
    value = _member(record, LEAF_NAMES[name])
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


_NAMES = ["batch_id", "text_no", "sentence_no", "token_no", "id", "lemma", "pos", "wf"]


def rebuilt(ids: pa.Array, streams: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> Iterator[pa.RecordBatch]:
    """The records of each level: places from the levels of its first leaf, members from all of its leaves."""
    for depth in range(3):
        own = [k for k, (level, _) in enumerate(LEAVES) if level == depth]
        rep, dfn, _ = streams[own[0]]
        if not len(rep):
            continue
        places, real = ordinals(rep, dfn, depth), dfn > depth
        n = int(real.sum())
        columns: list[pa.Array] = [ids.take(pa.array(places[0][real]))]
        columns += [pa.array(places[level + 1][real].astype(np.int32) if level <= depth else np.full(n, -1, np.int32)) for level in range(3)]
        members = {LEAVES[k][1]: streams[k][2].filter(pa.array(streams[k][1] > depth)) for k in own}
        columns += [members.get(name, pa.nulls(n, pa.string())) for name in ("id", "lemma", "pos", "wf")]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for start in range(0, big.num_rows, CHUNK):
            batch = big.slice(start, CHUNK)
            ids, texts, payload = batch.column("batch_id"), batch.column("texts"), batch.column("payload")
            typed = pc.fill_null(pc.greater(pc.list_value_length(texts), 0), False)
            yield from rebuilt(ids.filter(typed), nested_streams(texts.filter(typed)))
            walked = LevelStreams()
            for text in payload.filter(pc.invert(typed)).to_pylist():
                walked.add(_roots(text))
            yield from rebuilt(ids.filter(pc.invert(typed)), walked.streams())


def shred_batches(batches: DataFrame) -> DataFrame:
    """All records of ``batches(batch_id, texts, payload)`` with places and leaves.

    One shuffle, of one row per batch, to count each batch_id once; parsing, shredding and
    rebuilding run inside the partition.
    """
    one = batches.where(F.col("batch_id").isNotNull()).select(F.col("batch_id").cast("long").alias("batch_id"), "texts", "payload").dropDuplicates(["batch_id"])
    return one.mapInArrow(_shred, RECORD_SCHEMA)


def record_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables; each row carries the key of its parent."""
    return {
        "texts": records.where("sentence_no = -1").select("batch_id", "text_no", F.col("id").alias("text_id")),
        "sentences": records.where("sentence_no >= 0 and token_no = -1").select(
            "batch_id", "text_no", "sentence_no", F.col("id").alias("sent_id")
        ),
        "tokens": records.where("token_no >= 0").select(
            "batch_id", "text_no", "sentence_no", "token_no", F.col("id").alias("tok_id"), "lemma", "pos", "wf"
        ),
    }
