"""Encoding with a public byte-level BPE vocabulary.

Each word of the splitting pattern is merged on a contiguous rank array: the boundaries of its
parts and, beside them, the rank of each pair of neighbouring parts. The least rank is found by
scanning, its boundary deleted and the two neighbouring ranks refreshed, until no pair has a rank.
Scanning wins for short words; a word of more than ``LONG_WORD`` bytes (a run of a script without
spaces, or of one repeated sign) keeps the same ranks in a heap instead, so very long texts stay
near linear. Words repeat, so each Python worker keeps a bounded cache of encoded words.

The vocabulary file (under a megabyte, whatever the corpus) is read once on the driver and
broadcast; its path is a parameter.

Defined results
---------------
* null and empty texts have an empty list; one row out for each row in.
* strings of special tokens are ordinary text.
* lone surrogates cannot occur in Spark strings; a null id stays null.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes beyond which a heap finds the least rank.
LONG_WORD = 64
#: Words a worker remembers; the cache is emptied when full.
CACHE_WORDS = 1 << 18
_NO_RANK = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge on the rank array by repeated scanning."""
    bounds = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == _NO_RANK:
            break
        i = adjacent.index(least)
        del bounds[i + 1], adjacent[i]
        if i < len(adjacent):
            adjacent[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NO_RANK)
        if i:
            adjacent[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list of parts."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end, alive = list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def make_encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """A function from text to ids, with its own bounded cache of words."""
    split = regex.compile(PATTERN).findall
    cache: dict[str, list[int]] = {}

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for word in split(text):
            ids = cache.get(word)
            if ids is None:
                raw = word.encode("utf-8")
                whole = ranks.get(raw)
                ids = [whole] if whole is not None else (merge_short if len(raw) <= LONG_WORD else merge_long)(raw, ranks)
                if len(raw) <= 4 * LONG_WORD:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    return encode


_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def _encoder(key: str, ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    if key not in _ENCODERS:
        _ENCODERS[key] = make_encoder(ranks)
    return _ENCODERS[key]


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def encode_texts(documents: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids) for each row; narrow, no shuffle."""
    spark: SparkSession = documents.sparkSession
    path = path or vocabulary_path()
    ranks = spark.sparkContext.broadcast(load_ranks(path))
    id_type = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, ranks.value)
        for batch in batches:
            offsets, values = [0], []
            for text in batch.column(1).to_pylist():
                if text:
                    values += encode(text)
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    return documents.select(id_column, text_column).mapInArrow(run, f"{id_column} {id_type}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], path: str | None = None, text_column: str = "text") -> DataFrame:
    """``keep`` columns and n_tokens of each row; the ids themselves never leave the worker."""
    spark = documents.sparkSession
    path = path or vocabulary_path()
    ranks = spark.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, ranks.value)
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, text_column).mapInArrow(run, f"{schema}, n_tokens long")
