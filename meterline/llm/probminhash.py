"""Near duplicates by ProbMinHash over weighted five-word shingles.

A text is the set of its five-word shingles (words between ASCII white space,
A-Z lower-cased; fewer than five words make one shingle), each weighted by
1 + ln(count).  Every shingle sends arrivals of a Poisson process of its weight's
rate, seeded by the shingle alone; each arrival falls on one of ``registers``
registers, which keep the earliest arrival and its shingle.  A shingle stops as
soon as its next arrival comes later than the latest register, so most shingles
of a long text send one arrival.  Two texts agree in a register with the
probability Jaccard of their weighted sets.  Links are defined by plain Jaccard, so a
second signature gives every shingle the weight 1: repeated passages in which two
texts differ pull the weighted value far under the plain one.

Steps: texts with equal shingle sets are one class from the start; one
representative each is signed.  Bands of both signatures' registers give buckets
(one where they coincide, as they do for shingles that occur once).  In a bucket
every member is compared with the bucket's centre; buckets whose members then
still lie in different components get another centre, and are then compared in
full across components, in blocks of bounded size: pairs whose plain registers agree
about as often as the threshold asks are verified inside the block, and only
links leave it.  A candidate pair is verified on the whole texts by the exact
Jaccard of their shingle sets (``threshold``), so no false link is reported.
Classes are connected components of the links.

Recall: a pair of plain similarity s shares a bucket with a probability of at least
1 - (1 - s**rows)**bands, 0.9998 at 0.8 for 16 bands of four, whatever its counts.

Nulls and texts without words are never duplicates: each is a class by itself.
Repeated rows fall in one class.  The input needs a unique ``row`` column; extra
columns are not used.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, freeze, hash_words, lower_words, mix64, shingle_hashes


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    bands: int = 16
    rows: int = 4
    #: Rows on either side of a block in which an open bucket is compared.
    block: int = 512

    @property
    def least_agreeing(self) -> int:
        """Registers that agree, four standard deviations under what the threshold gives."""
        m = self.bands * self.rows
        return int(m * self.threshold - 4 * (m * self.threshold * (1 - self.threshold)) ** 0.5)

    @property
    def registers(self) -> int:
        return self.bands * self.rows


_UNIT = 2.0**-53


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def signatures(sets: list[np.ndarray], weights: list[np.ndarray], m: int) -> np.ndarray:
    """Register winners, one row of ``m`` shingle hashes per set; sets must not be empty.

    All sets of the batch advance together, one arrival per living shingle and round.
    """
    n = len(sets)
    earliest = np.full(n * m, np.inf)
    winner = np.zeros(n * m, dtype=np.uint64)
    item = np.concatenate(sets)
    rate = np.concatenate(weights)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    time = np.zeros(len(item))
    turn = 0
    while len(item):
        turn += 1
        with np.errstate(over="ignore"):
            draw = mix64(item + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(_uniform(draw)) / rate
        # The draw's low bits are independent of the high ones used for the time.
        slot = owner * m + (mix64(draw) % np.uint64(m)).astype(np.int64)
        hit = time < earliest[slot]
        if hit.any():
            s, t, w = slot[hit], time[hit], item[hit]
            order = np.lexsort((w, t, s))
            s, t, w = s[order], t[order], w[order]
            first = np.ones(len(s), dtype=bool)
            first[1:] = s[1:] != s[:-1]
            earliest[s[first]], winner[s[first]] = t[first], w[first]
        latest = earliest.reshape(n, m).max(axis=1)
        alive = time < latest[owner]
        item, rate, owner, time = item[alive], rate[alive], owner[alive], time[alive]
    return winner.reshape(n, m)


def shingle_set(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts."""
    return np.unique(shingle_hashes(hash_words(lower_words(text)), k), return_counts=True)


def banded(won: np.ndarray, rows: int, bands: int) -> list[np.ndarray]:
    """Buckets of each row of register winners, one a band."""
    with np.errstate(over="ignore"):
        bucket = np.zeros((len(won), bands), dtype=np.uint64)
        for i in range(rows):
            bucket = bucket * np.uint64(0x9E3779B97F4A7C15) + won[:, i::rows][:, :bands]
        return list(mix64(bucket + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)))


def _sign_batches(settings: Settings):
    m, rows, bands = settings.registers, settings.rows, settings.bands

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = batch.column("row").to_numpy()
            at = 0
            while at < len(texts):
                # About 200,000 shingles at a time bound the working memory, whatever the batch holds.
                chosen, sets, weights, total = [], [], [], 0
                while at < len(texts) and total < 200_000:
                    s, c = shingle_set(texts[at], settings.shingle)
                    if len(s):
                        chosen.append(at)
                        sets.append(s)
                        weights.append(1.0 + np.log(c))
                        total += len(s)
                    at += 1
                if not chosen:
                    continue
                won = signatures(sets, [np.ones(len(s)) for s in sets], m)
                buckets = banded(won, rows, bands)
                # Without repeated shingles the weighted signature is the plain one.
                repeated = [i for i, w in enumerate(weights) if w.max() > 1]
                if repeated:
                    weighted = banded(signatures([sets[i] for i in repeated], [weights[i] for i in repeated], m), rows, bands)
                    for i, more in zip(repeated, weighted, strict=True):
                        buckets[i] = np.unique(np.concatenate([buckets[i], more]))
                digest = [np.bitwise_xor.reduce(mix64(s)) ^ np.uint64(len(s)) for s in sets]
                second = [np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[chosen]),
                    pa.array(np.array(digest, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(second, dtype=np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, buckets)]), pa.int32()), pa.array(np.concatenate(buckets).view(np.int64))),
                    pa.array([x.tobytes() for x in (mix64(won) & np.uint64(255)).astype(np.uint8)], pa.binary()),
                ], names=["row", "set_a", "set_b", "size", "buckets", "registers"])

    return sign


def sign(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, set_a, set_b, size, buckets, registers) of every row with words.

    Two hashes name the shingle set; the plain signature's registers are kept as one byte each.
    """
    return docs.select("row", "text").mapInArrow(
        _sign_batches(settings), "row bigint, set_a bigint, set_b bigint, size int, buckets array<bigint>, registers binary"
    )


def jaccard(p: np.ndarray, q: np.ndarray) -> float:
    """Of two sorted, not empty sets."""
    small, large = (p, q) if len(p) < len(q) else (q, p)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both / (len(p) + len(q) - both)


def _verify(settings: Settings):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}

        def of(row: int, text: str) -> np.ndarray:
            if row not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[row] = shingle_set(text, settings.shingle)[0]
            return kept[row]

        for pairs in batches:
            rows = []
            for a, b, x, y in zip(pairs["a"], pairs["b"], pairs["text_a"], pairs["text_b"], strict=True):
                p, q = of(a, x), shingle_set(y, settings.shingle)[0]
                similarity = jaccard(p, q)
                if similarity >= settings.threshold:
                    rows.append((a, b, similarity))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return check


def verify(pairs: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b, similarity): the pairs whose whole texts are similar enough.

    The joins are inner sort-merge joins at every size, so that adaptive execution can split a
    centre that is in very many pairs and cost grows in proportion.
    """
    text = docs.select("row", "text").hint("merge")
    both = pairs.join(text.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").join(
        text.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_verify(settings), "a bigint, b bigint, similarity double")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(row, class_id): the least row of each connected component of (a, b).

    Every round each row takes the least label around it, then the label of its
    label; the tables are written between rounds.
    """
    edges = freeze(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "near-edges")
    labels = freeze(edges.groupBy(F.col("a").alias("row")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "near-labels")
    for _ in range(max_rounds):
        around = edges.join(labels.select(F.col("row").alias("b"), "label"), "b").select(F.col("a").alias("row"), "label")
        least = around.union(labels.select("row", "label")).groupBy("row").agg(F.min("label").alias("label"))
        onward = labels.select(F.col("row").alias("label"), F.col("label").alias("further"))
        step = least.join(onward, "label", "left").select("row", F.least("label", "further").alias("label"))
        new = freeze(step.join(labels.select("row", F.col("label").alias("old")), "row"), "near-labels")
        moved = new.where("label < old").limit(1).count()
        labels = new.select("row", "label")
        if not moved:
            return labels.select("row", F.col("label").alias("class_id"))
    raise ValueError(f"components need more than {max_rounds} rounds")


def _bucketed(signed: DataFrame) -> DataFrame:
    return signed.select("row", "size", F.explode("buckets").alias("bucket"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pd.DataFrame]:
    """The rows of each run of equal leading ``keys`` columns, from sorted batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas()
        if not len(frame):
            continue
        names = list(frame.columns[:keys])
        own = frame[names].to_numpy()
        cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = frame.iloc[low:high]
            if held and (held[-1][names].iloc[-1].to_numpy() != part[names].iloc[0].to_numpy()).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _agreement(block: pd.DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, agreeing registers) of the candidate pairs between a block's sides, as places in the block."""
    side, size, label = (block[c].to_numpy() for c in ("side", "size", "label"))
    sig = np.frombuffer(b"".join(block["registers"]), dtype=np.uint8).reshape(len(block), settings.registers)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    pairs = [(np.zeros(0, np.int64),) * 3]
    for x in left:
        fit = (label[right] != label[x]) & (np.minimum(size[right], size[x]) >= settings.threshold * np.maximum(size[right], size[x]))
        at = right[fit]
        agree = (sig[at] == sig[x]).sum(axis=1)
        enough = agree >= settings.least_agreeing
        pairs.append((np.full(int(enough.sum()), x), at[enough], agree[enough]))
    return tuple(np.concatenate(c) for c in zip(*pairs, strict=True))


def _involved(settings: Settings):
    """Rows of each block that have a candidate on the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _grouped(batches, 3):
            x, y, _ = _agreement(block, settings)
            rows = block.iloc[np.unique(np.concatenate([x, y]))]
            if len(rows):
                yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return run


def _joined(settings: Settings):
    """Links between the sides of each block, enough to join what is similar.

    Candidates are tried in the order of their agreement and verified on the
    texts; a pair that earlier links of the block have joined needs no test.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _grouped(batches, 3):
            x, y, agree = _agreement(block, settings)
            row, label, texts = block["row"].to_numpy(), block["label"].to_numpy(), block["text"].to_numpy()
            parent = {c: c for c in set(label.tolist())}
            sets: dict[int, np.ndarray] = {}

            def root(c):
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            out = []
            for k in np.argsort(-agree, kind="stable"):
                p, q = root(label[x[k]]), root(label[y[k]])
                if p == q:
                    continue
                for i in (x[k], y[k]):
                    if i not in sets:
                        sets[i] = shingle_set(texts[i], settings.shingle)[0]
                if jaccard(sets[x[k]], sets[y[k]]) >= settings.threshold:
                    parent[max(p, q)] = min(p, q)
                    out.append((row[x[k]], row[y[k]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


_BLOCK = "bucket bigint, i bigint, j bigint, side int, row bigint, size int, label bigint, registers binary"


def _across(known: DataFrame, signed: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) across components in open buckets, compared block by block.

    A bucket's rows outside its largest component meet all its rows; blocks hold
    about ``block`` rows a side, so a task's memory is bounded however large a
    bucket is.  Registers show which rows have a candidate; only those fetch their
    texts.  No pair leaves a block unless it is a link.
    """
    spark = known.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = known.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    major = counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("top"))
    # The two rows of a smaller bucket have been compared.
    major = major.where("n > 2")
    size = settings.block
    spread = F.abs(F.xxhash64("row"))
    rows = known.join(major, "bucket").join(signed.select("row", "registers"), "row").withColumn("i", spread % F.ceil(F.col("n") / size)).withColumn(
        "j", spread % F.ceil((F.col("n") - F.col("top") + 1) / size)
    )
    keep = ["row", "size", "label", "registers"]
    right = rows.select("bucket", "i", F.explode(F.expr(f"sequence(0L, CAST(ceil((n - top + 1) / {size}) AS BIGINT) - 1)")).alias("j"), F.lit(1).alias("side"), *keep)
    left = rows.where("label != major").select("bucket", F.explode(F.expr(f"sequence(0L, CAST(ceil(n / {size}) AS BIGINT) - 1)")).alias("i"), "j", F.lit(0).alias("side"), *keep)
    order = ["bucket", "i", "j", "side", "row"]
    both = left.union(right).repartition(parts, "bucket", "i", "j").sortWithinPartitions(*order)
    some = freeze(both.mapInArrow(_involved(settings), _BLOCK), "near-involved")
    text = docs.select(F.col("row").alias("_r"), "text").hint("merge")
    asked = some.join(text, some["row"] == text["_r"]).drop("_r")
    return asked.repartition(parts, "bucket", "i", "j").sortWithinPartitions(*order).mapInArrow(_joined(settings), "a bigint, b bigint")


def links(docs: DataFrame, signed: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, class_id) of the rows of ``signed`` that have a verified link; both inputs frozen."""
    fits = f"least(size_a, size_b) >= {settings.threshold} * greatest(size_a, size_b)"
    member = signed.select("row", "size", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    crowd = freeze(member.join(shared, "bucket"), "near-crowd")
    # Texts cross the network once; what follows joins those that share a bucket with another text only.
    docs = freeze(docs.select("row", "text").join(crowd.select("row").distinct().hint("merge"), "row", "left_semi"), "near-crowd-texts")
    found = label = None
    for turn in range(3):
        known = crowd.withColumn("label", F.col("row"))
        if label is not None:
            known = crowd.join(label, "row", "left").select("bucket", "row", "size", F.coalesce("class_id", "row").alias("label"))
            split = known.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("n"))
            known = freeze(known.join(split.where("l < h AND n > 2").select("bucket"), "bucket"), "near-open")
        if turn < 2:
            # One centre for each bucket: the least row at first, then any.
            by = F.col("row") if turn == 0 else F.xxhash64("row")
            centre = known.groupBy("bucket").agg(F.min(F.struct(by.alias("o"), "row", "size", "label")).alias("c"))
            pairs = known.join(centre, "bucket").where("label != c.label").select(
                F.least("row", "c.row").alias("a"), F.greatest("row", "c.row").alias("b"), F.col("size").alias("size_a"), F.col("c.size").alias("size_b")
            ).where(fits).select("a", "b").distinct()
            new = verify(freeze(pairs, "near-pairs"), docs, settings).select("a", "b")
        else:
            new = _across(known, signed, docs, settings)
        new = freeze(new, "near-links")
        found = new if found is None else found.union(new)
        label = components(found)
    return label


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, class_id) for every row of ``docs`` (frozen; unique ``row``, ``text``); a class is named by its least row."""
    signed = freeze(sign(docs, settings), "near-signed")
    first = freeze(signed.groupBy("set_a", "set_b").agg(F.min("row").alias("head")), "near-heads")
    heads = freeze(signed.join(first.select(F.col("head").alias("row")), "row"), "near-distinct")
    label = links(docs, heads, settings)
    # Rows of equal sets follow their head, and the head its component.
    named = first.join(label.withColumnRenamed("row", "head"), "head", "left").select("set_a", "set_b", F.coalesce("class_id", "head").alias("class_id"))
    member = signed.select("row", "set_a", "set_b").join(named, ["set_a", "set_b"]).select("row", "class_id")
    return docs.select("row").join(member, "row", "left").select("row", F.coalesce("class_id", "row").alias("class_id"))


def op3_probminhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = freeze(documents(spark, sf_dir).select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "near-texts")
    classes = freeze(near_duplicates(docs), "near-classes")
    # A class is named by its least row, which is unique where ids repeat or are null.
    large = classes.groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1")
    sized = classes.join(large, "class_id", "left").select("row", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"))
    return sized.join(docs.select("row", "doc_id"), "row").select("doc_id", "class_id", "class_size")
