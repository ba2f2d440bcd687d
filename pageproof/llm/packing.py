"""Packing of tokenised documents into sequences by bounded-space best fit.

Documents longer than a sequence are cut into full pieces, of which the first
holds what is over. Pieces then arrive one at a time. A fixed number of bins is
open; they are filed under their free space, and a bitset has one bit for each
free space that an open bin has. A piece of n tokens goes to the open bin with
the least free space that is n or more: the lowest bit from bit n on. If there
is none, a new bin is opened, and if too many are open then, the fullest closes:
the one under the lowest bit. A full bin closes by itself.

Pieces arrive in rounds of about as many as bins may be open, chosen by a hash of
the piece; within a round the longest come first, as small ones fill gaps best.

A piece is placed when it arrives and never moved, so a task holds numbers only,
for its open bins. Texts are tokenised where they are scanned; only lengths are
dealt out to the packing tasks, evenly and without a key, so no document or
source can make one task larger than others. Each task's last open bins are not
full, so a task is given many pieces (PIECES_A_TASK): what is lost is a few bins
a task.

Ids are those of the tokenizers library. They are computed by tiktoken, with the
same vocabulary, which is faster and gives the same ids (tests compare them over
all code points); texts with the spelling of a special token, or with a run of
white space that is too long for its matcher, go to tokenizers itself.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageproof.llm.bpe import byte_symbols
from pageproof.llm.common import stored

#: Tokens of a sequence; the id that ends each document.
SEQUENCE, END = 2048, 0
#: Bins that a task has open at a time.
OPEN_BINS = 2048
#: Pieces of a round, which arrive by falling length.
ROUND_PIECES = 2000
#: Pieces that one packing task is given.
PIECES_A_TASK = 100_000

#: Fixed value: the pattern that cuts texts for byte-level BPE of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_SPACE = re.compile(r"\s{1000}")


class ByteTokenizer:
    """A byte-level BPE file: ids of a text, special tokens' spellings included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = tokenizers.Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        special = [t["content"] for t in spec["added_tokens"]]
        self._odd = re.compile("|".join([*map(re.escape, special), _LONG_SPACE.pattern]))
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._odd.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer of a file, loaded once per worker, on the task's machine."""
    return ByteTokenizer(path)


def piece_lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of a document's pieces: full ones, what is over in the first."""
    full, over = divmod(n, sequence)
    return [over] * (over > 0) + [sequence] * full


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document,
    and with ``keep_ids`` its ids, as little-endian unsigned 32-bit integers. A
    null or empty text is the end id alone."""
    rows = docs.select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType())])
    for name in ("start", "length", "ids_crc32"):
        schema.add(name, T.LongType())
    if keep_ids:
        schema.add("ids", T.BinaryType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_tokenizer(path)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(own.ids(text or ""), np.uint32(end)).astype("<u4")
                start = 0
                for k, n in enumerate(piece_lengths(len(ids), sequence)):
                    part = ids[start : start + n].tobytes()
                    at.append(i)
                    found.append((k, start, n, zlib.crc32(part), part))
                    start += n
            columns = list(zip(*found, strict=True))[: 4 + keep_ids] if found else [[] for _ in range(4 + keep_ids)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [batch.column("doc_id").take(pa.array(at, pa.int64()))]
            arrays += [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(cut, schema)


class OpenBins:
    """At most ``limit`` open bins of a size, filed under their free space."""

    def __init__(self, size: int = SEQUENCE, limit: int = OPEN_BINS):
        self.size, self.limit = size, limit
        self.free = 0  # bit f: some open bin has f tokens free
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        filed = self.bins[space]
        number = filed.pop()
        if not filed:
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def _file(self, number: int, space: int) -> None:
        self.bins[space].append(number)
        self.free |= 1 << space
        self.open += 1

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) for a piece of n tokens."""
        fitting = self.free >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            number, space = self.made, self.size
            self.made += 1
        if space > n:
            if self.open >= self.limit:
                # The new or changed bin counts among those of which the fullest closes.
                fullest = (self.free & -self.free).bit_length() - 1 if self.free else self.size
                if space - n <= fullest:
                    return number, self.size - space
                self._take(fullest)
            self._file(number, space - n)
        return number, self.size - space


def pack(parts: DataFrame, size: int = SEQUENCE, limit: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """``parts`` (with ``length``, from 1 to ``size``) with sequence_id and offset.
    The order of arrival follows from the rows alone, so a task that is run again
    packs alike. Numbers of sequences are unique, with gaps."""
    if {"sequence_id", "offset"} & set(parts.columns):
        raise ValueError("the pieces already have a sequence")
    n = parts.count()
    tasks = max(1, -(-n // pieces_a_task))
    rounds = max(1, -(-n // (tasks * ROUND_PIECES)))
    hashed = F.pmod(F.xxhash64(*parts.columns), F.lit(rounds)).alias("_round")
    dealt = parts.select("*", hashed).repartition(tasks)
    dealt = dealt.sortWithinPartitions("_round", F.desc("length"), *parts.columns)
    dealt = dealt.withColumn("_first", F.spark_partition_id().cast("long") * F.lit(1 << 40))
    names = parts.columns
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OpenBins(size, limit)
        for batch in batches:
            found = np.array([own.place(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            first = batch.column("_first").to_numpy()
            arrays = [batch.column(c) for c in names] + [pa.array(first + found[:, 0]), pa.array(found[:, 1])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return dealt.mapInArrow(placed, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the sequences themselves, from pieces that
    were packed with their ``ids``. A sequence has a token from each of its pieces
    at least, so a group is bounded by its length."""
    part = F.struct("offset", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda all_, ids: F.concat(all_, ids))
    return rows.select("sequence_id", F.size("parts").alias("n_pieces"), joined.alias("ids"))


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of ``docs``: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset. Rows with a null id are packed like others."""
    return pack(stored(pieces(docs, path)))
