"""Harmonic packing of token sequences.

A document's ids, closed by id 0, are cut into pieces whose lengths are
reciprocal parts of the capacity: full sequences first, then the largest
``capacity // k`` that fits the rest, again and again.  Class k holds the pieces
of that length and a bin of class k takes exactly k of them, so a bin is full up
to less than k ids.  A rest gives about three pieces, each less than the square
of the one before over the capacity.

Each worker fills bins by itself.  What is left of its open bins (less than one
bin per class) goes on to fewer workers, some tens to one, until one is left;
that last one has under two bins' worth per class and fills sequences first-fit.
A worker's memory is one open bin per class plus the batch that it reads.

Null and empty texts are one document with id 0 alone.  Repeated rows are packed
one by one.  An empty table gives an empty result.  Extra columns are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, freeze
from .tokens import Encoder

CAPACITY = 1024
#: Workers whose open bins go to one worker of the next round.
FAN_IN = 32
SCHEMA = "row bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, bin string, offset bigint"
_NAMES = ["row", "doc_id", "start", "length", "doc_tokens", "ids", "bin", "offset"]
_TYPES = [pa.int64()] * 5 + [pa.binary(), pa.string(), pa.int64()]


def cut(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document: each is ``capacity // k`` for some k."""
    pieces = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = -(-capacity // rest)
        while capacity // k > rest:
            k += 1
        pieces.append(capacity // k)
        rest -= capacity // k
    return pieces


class Bins:
    """Open bins of one worker, one per class."""

    def __init__(self, name: str, capacity: int):
        self.name, self.capacity, self.done = name, capacity, 0
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def add(self, piece: tuple) -> list[tuple]:
        """The pieces of the bin that ``piece`` fills, with bin and offset, or none."""
        length = piece[3]
        here = self.open[length]
        here.append(piece)
        if len(here) < self.capacity // length:
            return []
        del self.open[length]
        return self._close(here)

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        self.done += 1
        out, at = [], 0
        for p in pieces:
            out.append((*p, f"{self.name}-{self.done}", at))
            at += p[3]
        return out

    def rest(self) -> list[tuple]:
        return [(*p, None, None) for here in self.open.values() for p in here]

    def fill(self) -> list[tuple]:
        """All open pieces, the longest first, each into the first sequence with room."""
        room: list[list] = []
        for p in sorted((p for here in self.open.values() for p in here), key=lambda p: (-p[3], p[0], p[2])):
            for s in room:
                if s[0] >= p[3]:
                    break
            else:
                room.append(s := [self.capacity, []])
            s[0] -= p[3]
            s[1].append(p)
        return [x for s in room for x in self._close(s[1])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _first(tokenizer: str, capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, bins = Encoder(tokenizer), Bins(f"0-{TaskContext.get().partitionId()}", capacity)
        end = np.zeros(1, dtype="<u4")
        for batch in batches:
            rows, doc_ids, column = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            low = 0
            while low < len(rows):
                # Some megabytes of text at a time bound the memory, whatever the batch holds.
                high, held, out = low, 0, []
                while high < len(rows) and held < 2_000_000:
                    held += sizes[high]
                    high += 1
                for i, ids in enumerate(encoder.ids([t or "" for t in column.slice(low, high - low).to_pylist()]), low):
                    packed, start, tokens = np.concatenate([ids, end]).tobytes(), 0, len(ids) + 1
                    for length in cut(tokens, capacity):
                        out += bins.add((rows[i], doc_ids[i], start, length, tokens, packed[4 * start : 4 * (start + length)]))
                        start += length
                yield _batch(out)
                low = high
        yield _batch(bins.rest())

    return pack


def _again(turn: int, capacity: int, last: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = Bins(f"{turn}-{TaskContext.get().partitionId()}", capacity)
        for batch in batches:
            out = []
            for piece in zip(*(batch.column(c).to_pylist() for c in _NAMES[:6]), strict=True):
                out += bins.add(piece)
            yield _batch(out)
        yield _batch(bins.fill() if last else bins.rest())

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (row, doc_id, start, length, doc_tokens, ids, bin, offset); ``ids`` are little-endian 32-bit.

    ``docs`` needs doc_id and text; ``row`` numbers them for this run.  The
    tables of every round are written, so no bin is filled twice differently.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    made = freeze(rows.mapInArrow(_first(tokenizer, capacity), SCHEMA), "packed")
    rounds, turn = [made.where("bin IS NOT NULL")], 0
    rest = made.where("bin IS NULL")
    workers = rest.select(F.shiftright("row", 33).alias("worker")).distinct().count()
    while True:
        turn += 1
        workers = -(-workers // FAN_IN)
        dealt = rest.repartition(max(1, workers), F.shiftright("row", 33) if workers > 1 else F.lit(0)).sortWithinPartitions("length", "row", "start")
        made = freeze(dealt.mapInArrow(_again(turn, capacity, workers <= 1), SCHEMA), f"packed-{turn}")
        rounds.append(made.where("bin IS NOT NULL"))
        if workers <= 1:
            break
        rest = made.where("bin IS NULL")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.union(more)
    return out


def with_sequence_ids(pieces: DataFrame) -> DataFrame:
    """``sequence_id`` from the bin's name: round, worker and count in one number."""
    part = lambda i: F.element_at(F.split("bin", "-"), i).cast("bigint")
    return pieces.withColumn("sequence_id", F.shiftleft(part(1), 58) + F.shiftleft(part(2), 34) + part(3))


def op6_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    pieces = with_sequence_ids(pack(documents(spark, sf_dir), path("byte_bpe_50k.json")))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
