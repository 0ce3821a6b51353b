"""Text probability by online logistic context mixing over bits.

A text is a run of bytes and an end mark.  Each symbol is a path through a static
code tree (frequent bytes have short paths), so a symbol is a few binary
decisions.  Three hashed-context predictors know each decision's odds: the last
two bytes, the last four, and all bytes, each since the last white space.  The predictors' odds are combined by logistic weights, one set
for each grade of how often the longest context was seen (the gate); a text starts with the common weights and
adapts its own by gradient steps after every ``STRETCH`` words.  A last adaptive
map, per text as well, refines the mixed probability by how often such
predictions came true so far.  Nothing looks ahead: contexts are made of earlier
bytes, weights and map of earlier stretches.

Learning counts over all training texts.  Spark counts the parts of all texts (those
held out only asked for, with a count of 0) and packs them in chunks.  A chunk's
contexts with the byte that follows are summed by key, 56 bits of the context's hash
and the byte, and cut by key range into shards, whose number grows with the parts.  A
shard holds all that follows its contexts, so it knows the odds on every byte's path
and answers each chunk; a chunk then puts its parts' predictions together.  Nothing
has a fixed size and no two contexts share a count (but for equal 56-bit hashes).

Texts lie in sealed pieces (compressed Arrow batches), and pieces are dealt to blocks of
about ``BLOCK_BYTES``.  Counting notes the blocks of each part, so a part's prediction goes once
to each block that has it, sealed with others, and a block's texts are scored beside them, some blocks a round.

The base score is a unigram's: tokens are lower-cased words and one end.  Counts
of frequent words are looked up in place, those of all others come by a join.

Null and empty texts are the end mark alone.  Without training texts all odds are
even.  Null ids are trained on or held out as the empty string.  Repeated texts
are learnt as often as they occur; extra columns are dropped.
"""

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import delete, keep, recorded, scratch
from .common import documents, freeze, lower_words, mix64, training_rows

#: Slots of a model whose tables are held in memory (``Model``).
SLOT_BITS = 22
#: Bytes of the parts of a chunk, and about how many of them a shard answers for.
CHUNK_BYTES, SHARD_BYTES = 400_000, 1_000_000
#: Bytes of the texts of a piece, and about how many of them a block holds.
PIECE_BYTES, BLOCK_BYTES = 1_000_000, 16_000_000
#: Bytes of predictions that wait for others of their blocks before they are sealed.
WAITING_BYTES = 64_000_000
#: Blocks are scored in so many rounds, so that a part of the predictions and texts is on its way at a time; a round has so many blocks at least.
ROUNDS, ROUND_BLOCKS = 4, 16
CONTEXTS = 3
#: How often the longest context was seen opens one of so many sets of weights (a power of two), from these starts.
GATES = 4
SEEN = (1, 4, 32)
START = np.array([[0.45, 0.3, 0.2, 0.2], [0.6, 0.5, 0.45, 0.3], [0.1, 0.3, 0.45, 0.6]], dtype=np.float32)
STRETCH = 64
RATE = 1.0
FREQUENT = 50_000
#: Byte values; 0xFF, which UTF-8 has no use for, is the end mark.
SYMBOLS = 256
_UNIT = re.compile(rb"[^ \t\n\r\x0b\x0c\xff]*[ \t\n\r\x0b\x0c\xff]")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def units(text: str | None) -> list[bytes]:
    """The text in parts, each closed by one white space or, the last, by the end mark.

    The end mark is a byte that UTF-8 has no use for.
    """
    return _UNIT.findall((text.encode("utf-8", "surrogatepass") if text else b"") + b"\xff")


class Tree:
    """A code tree over the bytes."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        children: dict[int, tuple[int, int]] = {}
        node = SYMBOLS
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        stack = [(node - 1, [])]
        while stack:
            at, path = stack.pop()
            if at < SYMBOLS:
                paths[at] = path
            else:
                for bit in (0, 1):
                    stack.append((children[at][bit], [*path, (at - SYMBOLS + 1, bit)]))
        deepest = max(map(len, paths.values()))
        self.length = np.array([len(paths[s]) for s in range(SYMBOLS)])
        self.nodes = np.zeros((SYMBOLS, deepest), dtype=np.uint64)
        self.bits = np.zeros((SYMBOLS, deepest), dtype=np.int8)
        for s, path in paths.items():
            self.nodes[s, : len(path)] = [p[0] for p in path]
            self.bits[s, : len(path)] = [p[1] for p in path]


_POWERS = None


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if _POWERS is None or len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.full(max(n, 4096), np.uint64(0xD1342543DE82EF95)))
    return _POWERS


def contexts(parts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of each predictor's context, bytes, and bytes per part, for all parts in a row."""
    symbols = np.array([len(p) for p in parts])
    # Four pads in front of each part.
    stride = symbols + 4
    first = np.cumsum(stride) - stride
    flat = np.full(int(stride.sum()), 300, dtype=np.uint64)
    place = np.arange(len(flat)) - np.repeat(first, stride) - 4
    real = place >= 0
    flat[real] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    with np.errstate(over="ignore"):
        own = np.where(real, (flat + np.uint64(1)) * _powers(int(place.max(initial=0)) + 1)[np.maximum(place, 0)], np.uint64(0))
        total = np.cumsum(own, dtype=np.uint64)
        at = np.flatnonzero(real)
        before = total[at - 1] - np.repeat((total - own)[first], symbols)
        two = flat[at - 1] | flat[at - 2] << np.uint64(9)
        four = two | flat[at - 3] << np.uint64(18) | flat[at - 4] << np.uint64(27)
        bases = [mix64(two + np.uint64(1 << 60)), mix64(four + np.uint64(2 << 60)), mix64(before * _MULT + np.uint64(3 << 60))]
    return bases, flat[at].astype(np.int64), symbols


def decisions(parts: list[bytes], tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots (CONTEXTS, n), bits and decisions per part, for all parts in a row."""
    bases, symbol, symbols = contexts(parts)
    with np.errstate(over="ignore"):
        length = tree.length[symbol]
        start = np.cumsum(length) - length
        depth = np.arange(int(length.sum())) - np.repeat(start, length)
        which = np.repeat(symbol, length)
        node = tree.nodes[which, depth] * np.uint64(0xD6E8FEB86659FD93)
        slots = np.empty((CONTEXTS, len(node)), dtype=np.int32)
        for i, base in enumerate(bases):
            x = np.repeat(base, length) ^ node
            x = (x ^ (x >> np.uint64(32))) * _MULT
            slots[i] = (x >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    per_part = np.add.reduceat(length, np.cumsum(symbols) - symbols)
    return slots, tree.bits[which, depth], per_part


class Scorer:
    """Scores texts by the predictions of their parts: a decision's odds by predictor, and its gate and bit, a byte each."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.known.clear()
        self.store = np.zeros(0, dtype=np.int32)  # a decision's odds by predictor, and its gate and bit: a byte each
        self.first, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def remember(self, told: list[pa.RecordBatch]) -> None:
        """Keep the predictions (part, prediction) of parts not known yet."""
        data, per = [], []
        for batch in told:
            self.known.update(zip(batch.column("part").to_pylist(), range(len(self.known), len(self.known) + len(batch)), strict=True))
            column = batch.column("prediction")
            edge = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
            if len(batch):
                data.append(np.frombuffer(column.buffers()[2], dtype=np.int8)[edge[0] : edge[-1]].view(np.int32))
                per.append(np.diff(edge) // (CONTEXTS + 1))
        self.store = np.concatenate([self.store, *data])
        self.count = np.concatenate([self.count, *per])
        self.first = np.cumsum(self.count) - self.count

    def learn(self, parts: list[bytes]) -> None:
        raise KeyError(f"no prediction for {len(parts)} parts, such as {parts[0][:40]!r}")

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each whole text."""
        split = [units(t) for t in texts]
        new = list({p for parts in split for p in parts if p not in self.known})
        if new:
            self.learn(new)
        ids = [np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts)) for parts in split]
        first, count = self.first, self.count
        n = len(texts)
        weights = np.tile(START, (1, n))
        hits = np.zeros((n * GATES, 16, 2), dtype=np.float32)
        centre = 1 / (1 + np.exp(-(np.arange(16, dtype=np.float32) - 7.5)))
        hits[..., 1], hits[..., 0] = 40 * centre, 40 * (1 - centre)
        total = np.zeros(n)
        turn, alive = 0, np.arange(n)
        while len(alive):
            alive = alive[[len(ids[i]) > turn * STRETCH for i in alive]]
            for low in range(0, len(alive), 64):
                self._stretch(alive[low : low + 64], ids, turn, first, count, weights, hits, total)
            turn += 1
        return total / np.log(10)

    def _stretch(self, docs, ids, turn, first, count, weights, hits, total) -> None:
        parts = [ids[i][turn * STRETCH : (turn + 1) * STRETCH] for i in docs]
        part = np.concatenate(parts)
        size = count[part]
        start = np.cumsum(size) - size
        rows = np.repeat(first[part] - start, size)
        rows += np.arange(len(rows))
        seen = self.store.take(rows).view(np.int8).reshape(-1, CONTEXTS + 1)
        edge = np.cumsum([0, *map(len, parts[:-1])])
        lengths = np.add.reduceat(size, edge)
        edge = start[edge]
        gate = seen[:, CONTEXTS]
        bit = gate >= GATES
        own = np.repeat(np.arange(len(docs), dtype=np.int32) * GATES, lengths)
        own += gate & (GATES - 1)
        cells = (docs[:, None] * GATES + np.arange(GATES)).ravel()
        stretched = [seen[:, i].astype(np.float32) for i in range(CONTEXTS)]
        mixed = np.zeros(len(rows), dtype=np.float32)
        for i, st in enumerate(stretched):
            mixed += st * (weights[i, cells] * np.float32(1 / 16)).take(own)
        np.clip(mixed, -12, 12, out=mixed)
        p = np.float32(1) / (np.float32(1) + np.exp(-mixed))
        cell = own * 16
        cell += np.clip(mixed + np.float32(8), 0, 15).astype(np.int32)
        table = hits[cells].reshape(-1, 2)
        final = np.float32(0.6) * p + (np.float32(0.4) * table[:, 1] / table.sum(axis=1)).take(cell)
        final = np.abs(final - ~bit)
        total[docs] += np.add.reduceat(np.log(final), edge, dtype=np.float64)
        # What this stretch teaches is used from the next on.
        wrong = bit - p
        n = np.maximum(np.bincount(own, minlength=len(cells)), 1)
        for i, st in enumerate(stretched):
            weights[i, cells] += RATE / 16 * np.bincount(own, weights=wrong * st, minlength=len(cells)) / n
        cell *= 2
        cell += bit
        hits[cells] = (table + np.bincount(cell, minlength=2 * len(table)).reshape(-1, 2)).reshape(-1, 16, 2)


class Model(Scorer):
    """Tables in memory: quantised log odds of each slot, one table per predictor, then how well the last one knows a slot."""

    def __init__(self, odds: np.ndarray, tree: Tree):
        self.odds, self.tree = odds, tree
        super().__init__()

    def learn(self, parts: list[bytes]) -> None:
        for low in range(0, len(parts), 20_000):
            some = parts[low : low + 20_000]
            slots, bits, per = decisions(some, self.tree)
            view = np.empty((len(bits), CONTEXTS + 1), dtype=np.int8)
            for i in range(CONTEXTS):
                view[:, i] = self.odds[i][slots[i]]
            view[:, CONTEXTS] = self.odds[CONTEXTS][slots[-1]] + GATES * bits
            self.remember([pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), _pieces(view, per)], names=["part", "prediction"])])


def _pieces(view: np.ndarray, per: np.ndarray) -> pa.Array:
    """The predictions of each part, from those of all in a row."""
    edge = (np.concatenate([[0], np.cumsum(per)]) * (CONTEXTS + 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(view))])


def _seal(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unseal(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _sealed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts with their bytes."""
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column("text")).fill_null(0), dtype=np.int64)
        low = 0
        while low < len(batch):
            n = max(1, int(np.searchsorted(np.cumsum(size[low:]), PIECE_BYTES, side="right")))
            data = _seal(batch.slice(low, n))
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([int(size[low : low + n].sum())], pa.int64())], names=["sealed", "size"])
            low += n


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with their count in the texts not held out, by block; a block's pieces come in a row."""
    counts: Counter = Counter()
    at = None

    def out() -> pa.RecordBatch:
        block = pa.array(np.full(len(counts), at, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64()), block], names=["part", "n", "block"])

    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("sealed").to_pylist(), strict=True):
            if counts and (block != at or len(counts) > 400_000):
                yield out()
                counts.clear()
            at, piece = block, _unseal(data)
            for text, held_out in zip(piece.column("text").to_pylist(), piece.column("held_out").to_pylist(), strict=True):
                if held_out:
                    for part in units(text):
                        counts.setdefault(part, 0)
                else:
                    counts.update(units(text))
    if counts:
        yield out()


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS)
    for batch in batches:
        parts, n = batch.column("part").to_pylist(), batch.column("n").to_numpy()
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        total += np.bincount(data, weights=np.repeat(n, [len(p) for p in parts]), minlength=SYMBOLS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SYMBOLS)), pa.array(total.astype(np.int64))], names=["symbol", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of parts in a row."""
    parts, counts, blocks, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([parts], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.list_(pa.int32())))],
            names=["parts", "counts", "blocks"],
        )

    for batch in batches:
        for part, n, where in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "blocks")), strict=True):
            parts.append(part)
            counts.append(n)
            blocks.append(where)
            size += len(part)
            if size >= CHUNK_BYTES:
                yield out()
                parts, counts, blocks, size = [], [], [], 0
    if parts:
        yield out()


def _keys(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each predictor's key at each byte, bytes, and bytes per part."""
    bases, symbol, per = contexts(parts)
    keys = np.concatenate([b & ~np.uint64(255) | symbol.astype(np.uint64) for b in bases])
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place.reshape(CONTEXTS, -1), symbol, per


def _asked(shard_bits: int):
    """Each chunk's keys and their counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, parts, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "parts", "counts")), strict=True):
                keys, place, _, per = _keys(parts)
                n = np.bincount(place.ravel(), weights=np.tile(np.repeat(np.array(counts, dtype=np.float64), per), CONTEXTS), minlength=len(keys)).astype(np.int64)
                shard = (keys >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), dtype=np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]]).tolist()
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), pa.array([int(shard[x])]), pa.array([keys[x:y].tobytes()], pa.binary()), pa.array([n[x:y].tobytes()], pa.binary())],
                        names=["chunk", "shard", "keys", "counts"],
                    )

    return run


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each ``length``, in a row."""
    own = np.cumsum(length) - length
    return np.repeat(start - own, length) + np.arange(int(length.sum()))


def _answer(tree: Tree):
    """For every asked key of a shard the quantised log odds and the grade of each decision on its byte's path."""

    def run(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, dtype=np.uint64) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, dtype=np.int64) for c in table.column("counts").to_pylist()])
        keys, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(keys))
        symbol = (keys & np.uint64(255)).astype(np.int64)
        length = tree.length[symbol]
        start = np.cumsum(length) - length
        which = np.repeat(np.arange(len(keys)), length)
        depth = _spread(np.zeros(len(keys), dtype=np.int64), length)
        context = np.concatenate([[0], np.cumsum(np.diff(keys >> np.uint64(8)) != 0)])
        node = context[which] * (2 * SYMBOLS) + tree.nodes[symbol[which], depth].astype(np.int64)
        _, at = np.unique(node, return_inverse=True)
        bit = tree.bits[symbol[which], depth]
        one = np.bincount(at, weights=total[which] * bit)
        both = np.bincount(at, weights=total[which])
        odds = np.clip(np.round(np.log((one + 0.4) / (both - one + 0.4)) * 16), -127, 127).astype(np.int8)[at]
        seen = np.digitize(both, SEEN).astype(np.int8)[at]
        out, low = [], 0
        for k in asked:
            own = place[low : low + len(k)]
            low += len(k)
            rows = _spread(start[own], length[own])
            out.append((odds[rows].tobytes(), seen[rows].tobytes()))
        return pa.table({
            "chunk": table.column("chunk"), "shard": table.column("shard"),
            "odds": pa.array([o for o, _ in out], pa.binary()), "seen": pa.array([g for _, g in out], pa.binary()),
        })

    return run


def _together(tree: Tree):
    """(part, n, blocks, prediction) of each part of the chunks, from the shards' answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, counts, blocks, answers in zip(*(batch.column(c).to_pylist() for c in ("parts", "counts", "blocks", "answers")), strict=True):
                answers.sort(key=lambda a: a["shard"])
                odds, seen = (np.frombuffer(b"".join(a[c] for a in answers), dtype=np.int8) for c in ("odds", "seen"))
                keys, place, symbol, per = _keys(parts)
                size = tree.length[(keys & np.uint64(255)).astype(np.int64)]
                start = np.cumsum(size) - size
                length = tree.length[symbol]
                view = np.empty((int(length.sum()), CONTEXTS + 1), dtype=np.int8)
                for i in range(CONTEXTS):
                    rows = _spread(start[place[i]], length)
                    view[:, i] = odds[rows]
                depth = _spread(np.zeros(len(symbol), dtype=np.int64), length)
                view[:, CONTEXTS] = seen[rows] + GATES * tree.bits[np.repeat(symbol, length), depth]
                decided = np.add.reduceat(length, np.cumsum(per) - per)
                pieces = _pieces(view, decided)
                for low in range(0, len(parts), 5_000):
                    here = slice(low, low + 5_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts[here], pa.binary()), pa.array(counts[here], pa.int64()), pa.array(blocks[here], pa.list_(pa.int32())), pieces[here]],
                        names=["part", "n", "blocks", "prediction"],
                    )

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sealed predictions (part, prediction) of the parts that each block has."""
    waiting, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        told = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        blocks = told.column("blocks")
        block = blocks.flatten().to_numpy()
        part = np.repeat(np.arange(len(told)), blocks.value_lengths().to_numpy())
        order = np.argsort(block, kind="stable")
        block, part = block[order], part[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]).tolist()
        told = told.select(["part", "prediction"])
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x < y:
                data = _seal(told.take(pa.array(part[x:y])))
                yield pa.RecordBatch.from_arrays([pa.array([block[x]], pa.int32()), pa.array([data], pa.binary())], names=["block", "sealed"])

    for batch in batches:
        if len(batch):
            waiting.append(batch)
            size += batch.nbytes
        if size >= WAITING_BYTES:
            yield from out()
            waiting, size = [], 0
    if waiting:
        yield from out()


def train(parts: DataFrame) -> DataFrame:
    """(part, n, blocks, prediction) for counted parts (part, n, perhaps blocks), a frozen table; those with n = 0 teach nothing."""
    if "blocks" not in parts.columns:
        parts = parts.withColumn("blocks", F.expr("CAST(array() AS array<int>)"))
    counts = np.zeros(SYMBOLS, dtype=np.int64)
    for r in parts.select("part", "n").mapInArrow(_bytes_of, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[r["symbol"]] = r["n"]
    tree = Tree(counts)
    size = parts.agg(F.sum(F.length("part"))).first()[0] or 0
    shard_bits = max(0, int(size // SHARD_BYTES)).bit_length()
    with scratch(parts.sparkSession):
        # Parts in order share their beginnings, so a chunk asks for few keys.
        ordered = parts.repartitionByRange("part").sortWithinPartitions("part")
        packed = ordered.mapInArrow(_packed, "parts array<binary>, counts array<bigint>, blocks array<array<int>>")
        chunks = freeze(packed.withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")
        asked = chunks.select("chunk", "parts", "counts").mapInArrow(_asked(shard_bits), "chunk bigint, shard bigint, keys binary, counts binary")
        answers = asked.groupBy("shard").applyInArrow(_answer(tree), "chunk bigint, shard bigint, odds binary, seen binary")
        answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "odds", "seen")).alias("answers"))
        told = chunks.join(answers, "chunk").select("parts", "counts", "blocks", "answers")
        return keep(told.mapInArrow(_together(tree), "part binary, n bigint, blocks array<int>, prediction binary"), "lm-predictions")


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_frequent bigint, frequent_log double, score double, rare array<struct<token:binary,n:int>>"


def _score(frequent):
    """The rows of a block's texts, beside the predictions of their parts.  frequent: log10 of the count plus one of each frequent token."""

    def run(table: pa.Table) -> pa.Table:
        logs = frequent.value
        model = Scorer()
        told = table.column("told").to_pylist()
        model.remember([_unseal(data) for data, t in zip(table.column("sealed").to_pylist(), told, strict=True) if t])
        out = []
        for data, t in zip(table.column("sealed"), told, strict=True):
            if t:
                continue
            piece = _unseal(data.as_py())
            texts = piece.column("text").to_pylist()
            tokens, known, log, rare, scores = [], [], [], [], []
            low = 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and size < 400_000:
                    size += len(texts[high] or "")
                    high += 1
                scores.append(model.scores(texts[low:high]))
                low = high
            for text in texts:
                words = Counter(lower_words(text))
                here, found, unknown = 0.0, 0, []
                for w, n in words.items():
                    value = logs.get(w)
                    if value is None:
                        unknown.append({"token": w, "n": n})
                    else:
                        here += n * value
                        found += n
                tokens.append(words.total() + 1)
                known.append(found)
                log.append(here)
                rare.append(unknown)
            kind = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32())]))
            out.append(pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(log, pa.float64()),
                 pa.array(np.concatenate(scores)), pa.array(rare, kind)],
                names=["doc_id", "held_out", "n_tokens", "n_frequent", "frequent_log", "score", "rare"],
            ))
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, held_out), scored by what the rows not held out teach."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), "held_out")
    with scratch(spark):
        pieces = docs.mapInArrow(_sealed_texts, "sealed binary, size bigint").withColumn("piece", F.monotonically_increasing_id())
        pieces = freeze(pieces, "lm-texts")
        blocks = max(1, -(-(pieces.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES))
        block = F.pmod(F.xxhash64("piece"), F.lit(blocks)).cast("int").alias("block")
        texts = pieces.select(block, "sealed")
        units_of = texts.repartition("block").sortWithinPartitions("block").mapInArrow(_count_units, "part binary, n bigint, block int")
        with recorded() as counted:
            parts = freeze(units_of.groupBy("part").agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks")), "lm-parts")
        learnt = parts.where("n > 0")
        # Tokens: parts in lower case, without the byte that closes them.
        ends = F.sum(F.when(F.expr("hex(substring(part, -1, 1)) = 'FF'"), F.col("n")).otherwise(0))
        bare = F.expr("substring(part, 1, length(part) - 1)").cast("string")
        lower = F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary")
        tokens = learnt.select(lower.alias("token"), "n").where(F.length("token") > 0).groupBy("token").agg(F.sum("n").alias("c"))
        tokens = keep(tokens, "lm-tokens")
        end = learnt.agg(ends.alias("n")).first()["n"] or 0
        sums = tokens.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
        n_all, distinct = (sums["n"] or 0) + end, sums["v"] + (1 if end else 0)
        top = tokens.orderBy(F.desc("c"), "token").limit(FREQUENT).collect()
        frequent = spark.sparkContext.broadcast({bytes(r["token"]): float(np.log10(r["c"] + 1)) for r in top})  # FREQUENT words at most
        told = train(parts)
        for path in counted:
            delete(spark, path)
        rounds = max(1, min(ROUNDS, blocks // ROUND_BLOCKS))
        done = []
        for i in range(rounds):
            here = F.expr(f"filter(blocks, b -> b % {rounds} = {i})")
            asking = told.select("part", "prediction", here.alias("blocks")).where(F.size("blocks") > 0)
            dealt = asking.mapInArrow(_dealt, "block int, sealed binary").withColumn("told", F.lit(True))
            beside = texts.where(F.col("block") % rounds == i).withColumn("told", F.lit(False)).unionByName(dealt)
            # By number: tasks of few bytes are long ones here, and would be put together.
            rows = beside.repartition(-(-2 * blocks // rounds), "block").groupBy("block").applyInArrow(_score(frequent), _SCORED)
            done.append(keep(rows.withColumn("row", F.monotonically_increasing_id() * rounds + i), "lm-scored"))
    scored = reduce(DataFrame.unionByName, done)
    asked = scored.select("row", F.explode("rare").alias("x")).select("row", F.col("x.token").alias("token"), F.col("x.n").alias("n"))
    found = asked.join(tokens, "token").groupBy("row").agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_log"))
    whole = n_all + distinct + 1
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("_n", F.lit(0)) + (1 if end else 0)).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("frequent_log") + F.coalesce("_log", F.lit(0.0)) + float(np.log10(end + 1)) - F.col("n_tokens") * float(np.log10(whole))).alias("base_score"),
        "score",
    )


def op5_context_mixing(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text", (~training_rows(7, 2)).alias("held_out")))
