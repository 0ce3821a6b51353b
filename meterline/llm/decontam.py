"""Benchmark passages in training text, found with a generalised suffix automaton.

The automaton holds all runs of words of the benchmark's items.  A text's words
are streamed through it; at each word the state and the length of the longest
run that ends there and occurs in some item are known.  A run of ``window``
words or more makes its words hit; an item shorter than that is a window itself.
States know the items whose windows they stand for.

Items come in blocks of a bounded number of words (long items are cut with an
overlap of a window less one, which loses no window), one automaton a block; a
block's words are broadcast and the texts are streamed once per block, which is
once for any benchmark under ``BLOCK_WORDS`` words.  A word that is in no item
puts the automaton back to its root, so only stretches of benchmark words at
least a window long are streamed.

Null and empty texts have no words and are clean; an item without words has no
window.  Equal item ids count as one item; a null item id has no name and hits
without being listed.  Repeated texts are judged one by one.  An empty benchmark
leaves everything clean.  Extra columns pass through ``clean`` and are otherwise
dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, documents, freeze, hide

WINDOW = 10
#: Words of items that one automaton and one broadcast may hold, and words of one piece of an item.
BLOCK_WORDS, PIECE_WORDS = 200_000, 20_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Limits:
    #: Hit stretches of so many words go, and any in which a whole item shorter than the window occurs.
    span_words: int = WINDOW
    #: A text goes as a whole if more than this share of its words is hit.
    coverage: float = 0.5


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: dict[int, set] = {}
        self.short: dict[int, tuple[int, set]] = {}
        self.least = window
        for item, words in coded:
            self._mark(item, words)
        # The nearest state up the links, itself included, at which a short item ends.
        self.nearest = [-1] * len(self.link)
        if self.short:
            for v in sorted(range(len(self.link)), key=self.length.__getitem__):
                self.nearest[v] = v if v in self.short else self.nearest[self.link[v]] if v else -1

    def _add(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the runs of q that come through p, parted from the longer ones."""
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another item has this run already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, item, words: list[int]) -> None:
        v = 0
        for at, w in enumerate(words, 1):
            v = self.next[v][w]
            if at >= self.window:
                self.items.setdefault(self._of_window(v), set()).add(item)
        if len(words) < self.window:
            self.short.setdefault(v, (len(words), set()))[1].add(item)
            self.least = min(self.least, len(words))

    def _of_window(self, v: int) -> int:
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which of ``words`` are hit, and the items whose windows occur."""
        hit, _, found = self.matched(words)
        return hit, found

    def matched(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set]:
        """Which of ``words`` are hit, which by whole short items, and the items whose windows occur."""
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        edge, short, found = np.zeros(len(words) + 1, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64), set()
        known = np.diff(np.concatenate([[0], (codes >= 0).astype(np.int8), [0]]))
        for low, high in zip(np.flatnonzero(known == 1), np.flatnonzero(known == -1), strict=True):
            if high - low >= self.least:
                self._stream(codes[low:high].tolist(), int(low), edge, short, found)
        by_short = np.cumsum(short[:-1]) > 0
        return (np.cumsum(edge[:-1]) > 0) | by_short, by_short, found

    def _stream(self, codes: list[int], at: int, edge: np.ndarray, short: np.ndarray, found: set) -> None:
        onward, link, length, window = self.next, self.link, self.length, self.window
        v = size = 0
        for end, w in enumerate(codes, at + 1):
            q = onward[v].get(w)
            while q is None and v:
                v = link[v]
                size = length[v]
                q = onward[v].get(w)
            if q is not None:
                v, size = q, size + 1
            if size >= window:
                edge[end - window] += 1
                edge[end] -= 1
                found |= self.items[self._of_window(v)]
            if self.short:
                u = self.nearest[v]
                while u > 0:
                    n, items = self.short[u]
                    if n <= size:
                        short[end - n] += 1
                        short[end] -= 1
                        found |= items
                    u = self.nearest[link[u]]


@lru_cache(maxsize=2)
def _automaton(items: tuple, window: int) -> Automaton:
    return Automaton(list(items), window)


def blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[tuple]:
    """Items, in blocks of bounded size, as (id, words)."""
    schema = "item string, words array<binary>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = alnum_words(text)
                step = PIECE_WORDS - window + 1
                for low in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    out.append((item, words[low : low + PIECE_WORDS]))
            columns = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.binary()))],
                names=["item", "words"],
            )

    pieces = freeze(benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, schema), "benchmark")
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    count = -(-2 * total // BLOCK_WORDS) if total > BLOCK_WORDS else 1
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count)))
    for k in range(count):
        yield tuple((r["item"], tuple(map(bytes, r["words"]))) for r in dealt.where(F.col("block") == k).orderBy("item", "words").collect())


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("short", pa.bool_())]))
_FOUND = "row bigint, doc_id bigint, n_words bigint, hit array<struct<s:int,e:int,short:boolean>>, items array<string>"


def _match(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value, window)
        for batch in batches:
            sizes, hits, named = [], [], []
            for text in batch.column("text").to_pylist():
                words = alnum_words(text)
                hit, short, found = automaton.matched(words)
                sizes.append(len(words))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist() if found or hit.any() else []
                hits.append([{"s": x, "e": y, "short": bool(short[x:y].any())} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                named.append(sorted(x for x in found if x is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(hits, _SPANS), pa.array(named, pa.list_(pa.string()))],
                names=["row", "doc_id", "n_words", "hit", "items"],
            )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, hit, items) for each row of ``docs`` (row, doc_id, text).

    hit: the hit stretches as first word, end and whether a whole short item is in them.  With several blocks the texts
    are frozen, streamed once a block, and the stretches merged per row.
    """
    spark, parts = docs.sparkSession, []
    docs = docs.select("row", F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = list(blocks(benchmark, window))
    if len(found) > 1:
        docs = freeze(docs, "decontam-texts")
    for block in found:
        shared = spark.sparkContext.broadcast(block)  # at most about BLOCK_WORDS words
        parts.append(docs.mapInArrow(_match(shared, window), _FOUND))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    merged = every.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.withColumn("hit", F.expr("""aggregate(hit, CAST(array() AS array<struct<s:int,e:int,short:boolean>>), (a, x) ->
        IF(size(a) > 0 AND x.s <= element_at(a, -1).e,
           concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e),
               'short', element_at(a, -1).short OR x.short))),
           concat(a, array(x))))"""))


def hit_words(hit: str = "hit"):
    return F.expr(f"aggregate({hit}, 0L, (a, x) -> a + x.e - x.s)")


def _without(text: str, hit: str):
    """The text less its hit words and what stands between them."""

    def one(t, spans):
        data = t.encode("utf-8", "surrogatepass")
        low = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in data)
        places = [m.span() for m in _WORD.finditer(low)]
        out, at = [], 0
        for span in spans:
            out.append(data[at : places[span["s"]][0]])
            at = places[span["e"] - 1][1]
        return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")

    @F.pandas_udf("string")
    def cut(text: pd.Series, hit: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or h is None or len(h) == 0 else one(t, h) for t, h in zip(text, hit, strict=True)], dtype=object)

    return cut(text, hit)


def clean(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), window: int = WINDOW) -> DataFrame:
    """``docs`` without the hit stretches of ``span_words`` or more or with a whole short item, and without texts hit beyond ``coverage``.

    All columns stay but ``text`` as they are.  A table of the texts that are hit
    is joined back by row; its size decides how.
    """
    hidden, shown = hide(docs, ("doc_id", "text"))
    rows = freeze(hidden.withColumn("_row", F.monotonically_increasing_id()), "decontam-texts")
    found = matches(rows.withColumn("row", F.col("_row")), benchmark, window).where(F.size("hit") > 0)
    hits = freeze(found.select(
        F.col("row").alias("_hit_row"), F.expr(f"filter(hit, x -> x.short OR x.e - x.s >= {limits.span_words})").alias("_hit"),
        (hit_words() > limits.coverage * F.col("n_words")).alias("_drop"),
    ), "decontam-hits")
    joined = rows.join(hits, rows["_row"] == hits["_hit_row"], "left").where(~F.coalesce("_drop", F.lit(False)))
    fixed = F.when(F.size("_hit") > 0, _without("text", "_hit")).otherwise(F.col("text"))
    return joined.withColumn("text", fixed).select(*shown)


def op8_suffix_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("row", F.monotonically_increasing_id())
    found = matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit_words() > 0).alias("contaminated"),
    )
