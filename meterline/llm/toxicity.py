"""Toxicity by a support vector machine over a gapped subsequence kernel.

The kernel compares words: for all three characters in order within ``SPAN``
places, both words' occurrences count, each damped by ``DECAY`` per place that it
covers; a word's mark of beginning is a character too.  Inserted characters and
gaps only stretch occurrences, so a disguised insult stays near its plain form.
Runs of single characters ("i d i o t") are also read as one word.

Training.  Spark counts for every word in how many labelled training texts of
either class it occurs (``LABELLED_TEXTS`` bounds them).  Words that mark toxic texts, and words of clean texts, are
a bounded sample, the first also in disguise (``POSITIVES``, ``NEGATIVES``: the documented bound of what leaves
Spark).  Landmarks are chosen by pivoted Cholesky, which takes the word that the
landmarks so far explain least; the Nyström map sends a word to its kernel values
with the landmarks, whitened.  A linear machine with squared hinge loss is fitted
there.  As a word's value is linear in its subsequences, map and machine fold into
one weight per subsequence.

A text's value comes from its largest word values.  A logistic curve, fitted on
the training texts, turns it into a score.

Nulls and empty texts have the score of a text without any word value.  Without
labelled texts of both classes every score is 0.5.  Labels are taken once per id;
several labels of an id count as toxic if one is.  Texts of null id are scored,
not learnt from.  Repeated texts are scored one by one; extra columns are dropped.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, freeze, training_rows

SPAN, DECAY = 6, 0.6
#: Most words of either kind that the machine is trained on.
POSITIVES, NEGATIVES = 4_000, 16_000
LANDMARKS = 192
#: Words with most votes that are also learnt in disguise.
DISGUISED = 200
#: Texts a word must mark, how surely, and how many words a text votes for.
LEAST_TEXTS, LEAST_SURE, VOTES = 3, 12.0, 4
#: Characters of a word that are looked at; longer words are read in overlapping stretches.
LONGEST = 64
_GAPS = [(i, j) for i in range(1, SPAN) for j in range(1, SPAN) if i + j < SPAN]
_CLASSES = 64
_TRIM = b".,;:!?\"'()[]{}*#$%&|<>-_"


def words_in(text: str | None) -> list[bytes]:
    """Lower-case words without marks at their ends, and spelled-out runs as one word."""
    if not text:
        return []
    words = text.lower().encode("utf-8", "replace").split()
    out = [w for x in words if (w := x.strip(_TRIM))]
    run: list[bytes] = []
    for w in [*out, b""]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) > 2:
                out.append(b"".join(run))
            run = []
    return out


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all words in one row, and the word that each belongs to.

    Each word is led by its mark of beginning (class 1) and followed by gaps of
    class 0, which take part in no subsequence.
    """
    pad = bytes(SPAN)
    data = np.frombuffer(b"".join(b"\x01" + w + pad for w in words), dtype=np.uint8)
    lengths = np.array([len(w) + 1 + SPAN for w in words])
    table = np.zeros(256, dtype=np.int64)
    for b in range(1, 256):
        table[b] = 1 if b == 1 else b - 95 if 97 <= b <= 122 else 28 + b % 9 if b < 128 else 37 + b % 27
    return table[data], np.repeat(np.arange(len(words)), lengths)


def subsequences(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(key, word, weight) of every occurrence of three characters in order, by gap."""
    code, owner = _codes(words)
    for i, j in _GAPS:
        n = len(code) - i - j
        if n <= 0:
            continue
        a, b, c = code[:n], code[i : n + i], code[i + j :]
        at = np.flatnonzero((a > 0) & (b > 0) & (c > 0) & (owner[:n] == owner[i + j :]))
        yield (a[at] * _CLASSES + b[at]) * _CLASSES + c[at], owner[at], DECAY ** (i + j + 1)


def _norms(words: list[bytes]) -> np.ndarray:
    """What a word's kernel with itself would be without repeated subsequences, at least that of two characters."""
    lengths = np.array([len(w) + 1 for w in words])
    total = np.full(len(words), DECAY**4)
    for i, j in _GAPS:
        total = total + np.maximum(0, lengths - i - j) * DECAY ** (2 * (i + j + 1))
    return np.sqrt(total)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (word, key, value), one entry per key of a word."""
    rows, keys, values = [], [], []
    for key, word, weight in subsequences(words):
        rows.append(word)
        keys.append(key)
        values.append(np.full(len(key), weight))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pair, where = np.unique(np.concatenate(rows) * _CLASSES**3 + np.concatenate(keys), return_inverse=True)
    value = np.bincount(where, weights=np.concatenate(values))
    row = pair // _CLASSES**3
    return row, pair % _CLASSES**3, value / _norms(words)[row]


class Machine:
    """One weight per subsequence, and the curve from word values to a score."""

    def __init__(self, weights: np.ndarray, bias: float, curve: tuple[float, ...] = (1.0, 0.0, 0.0)):
        self.weights, self.bias, self.curve = weights, bias, curve
        self.known: dict[bytes, float] = {}

    def word_values(self, words: list[bytes]) -> np.ndarray:
        total = np.zeros(len(words))
        for key, word, weight in subsequences(words):
            total += weight * np.bincount(word, weights=self.weights[key], minlength=len(words))
        return total / _norms(words) + self.bias

    def text_values(self, texts: list[str | None]) -> np.ndarray:
        """(n, 2): the largest value of a word in the text, and the second largest of another word."""
        split = []
        for text in texts:
            words = words_in(text)
            short = set(words)
            for w in [w for w in short if len(w) > LONGEST]:
                short.discard(w)
                short.update(w[i : i + LONGEST] for i in range(0, len(w) - SPAN, LONGEST - SPAN))
            split.append(short)
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        if len(known) + len(new) > 1_000_000:  # values kept for speed only
            known.clear()
            new = list({w for words in split for w in words})
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            known.update(zip(part, self.word_values(part).tolist(), strict=True))
        out = np.full((len(texts), 2), -1.0)
        for i, words in enumerate(split):
            if words:
                values = sorted(map(known.__getitem__, words))[-2:]
                out[i, 0] = values[-1]
                if len(values) > 1:
                    out[i, 1] = values[0]
        # Trained marks have values of about 1: what comes near that counts most.
        out = np.clip(out, -1.0, 1.0)
        return out + 4 * np.maximum(out - 0.5, 0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.text_values(texts)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30)))


def landmarks(words: list[bytes], most: int) -> list[bytes]:
    """Words chosen by pivoted Cholesky: each is the one that those before explain least."""
    row, key, value = features(words)
    n = len(words)
    first = np.searchsorted(row, np.arange(n + 1))
    left = np.bincount(row, weights=value**2, minlength=n)
    chosen, factor, own = [], np.zeros((n, most), dtype=np.float32), np.zeros(_CLASSES**3)
    for k in range(min(most, n)):
        pick = int(np.argmax(left))
        if left[pick] < 1e-3:
            break
        mine = slice(first[pick], first[pick + 1])
        own[key[mine]] = value[mine]
        column = np.bincount(row, weights=value * own[key], minlength=n)
        own[key[mine]] = 0
        column = (column - factor[:, :k] @ factor[pick, :k]) / np.sqrt(left[pick])
        factor[:, k] = column
        left = np.maximum(left - column**2, 0)
        chosen.append(words[pick])
    return chosen


def fit_words(positive: list[bytes], negative: list[bytes], weight: np.ndarray, most: int = LANDMARKS) -> Machine:
    """The machine on words; ``weight`` is each word's part in the loss."""
    words = [w[:LONGEST] for w in [*positive, *negative]]
    marks_at = landmarks(words[: len(positive)], most * 2 // 3)
    marks_at += landmarks(words[len(positive) :][:: max(1, len(negative) // 4_000)], most - len(marks_at))
    # Only subsequences of landmarks matter: they get places of their own.
    row, key, value = features(marks_at)
    used, place = np.unique(key, return_inverse=True)
    marks = np.zeros((len(used), len(marks_at)), dtype=np.float32)
    marks[place, row] = value
    where = np.full(_CLASSES**3, -1, dtype=np.int32)
    where[used] = np.arange(len(used))

    def kernel_with(some: list[bytes]) -> np.ndarray:
        """Kernel values of some words with the landmarks."""
        row, key, value = features(some)
        at = where[key]
        row, at, value = row[at >= 0], at[at >= 0], value[at >= 0]
        dense = np.bincount(row * len(used) + at, weights=value, minlength=len(some) * len(used))
        return dense.reshape(len(some), len(used)).astype(np.float32) @ marks

    kernel = np.concatenate([kernel_with(words[low : low + 200]) for low in range(0, len(words), 200)])
    # The Nyström map whitens the values.
    size, basis = np.linalg.eigh(kernel_with(marks_at).astype(np.float64))
    keep = size > 1e-6 * size.max()
    white = basis[:, keep] / np.sqrt(size[keep])
    x = np.column_stack([kernel @ white, np.ones(len(words))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    beta = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps on the squared hinge loss
        active = y * (x @ beta) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * wa[:, None]) + 1e-2 * np.eye(x.shape[1]), xa.T @ (wa * y[active]))
        if np.allclose(new, beta, atol=1e-6):
            break
        beta = new
    weights = np.zeros(_CLASSES**3)
    weights[used] = marks @ (white @ beta[:-1])
    return Machine(weights, float(beta[-1]))


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of a logistic curve, and its log likelihood; each row counts ``weight`` times."""
    z = np.column_stack([z, np.ones(len(z))])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p) + 1e-9)[:, None]) + 1e-2 * np.eye(len(beta)), z.T @ (weight * (y - p)) - 1e-2 * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ beta, -30, 30))), 1e-12, 1 - 1e-12)
    return beta, float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """The likeliest curve in which a larger word value never lowers the score."""
    both, _ = _logistic(x, y, weight)
    if both[0] >= 0.25 * both[1] >= 0:
        return tuple(map(float, both))
    one, _ = _logistic(x @ np.array([[1.0], [0.25]]), y, weight)
    return float(one[0]), float(0.25 * one[0]), float(one[1])


def disguised(word: bytes) -> list[bytes]:
    """Ways to write ``word`` that still read like it: parted, lengthened, with a character put in."""
    middle = len(word) // 2
    parted = [mark.join(word[i : i + 1] for i in range(len(word))) for mark in (b".", b"-", b"*")]
    letter = b"aeiounrst"[sum(word) % 9 :][:1]
    return [*parted, word[:middle] + word[middle - 1 : middle] * 2 + word[middle:], word + letter + b"x", word[:middle] + letter + word[middle:]]


_COUNTED = "word binary, toxic int, n bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per word and class, summed as far as a bounded table holds."""
    counts: dict[tuple[bytes, int], int] = {}

    def out() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "toxic", "n"],
        )

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for w in set(words_in(text)):
                counts[w, toxic] = counts.get((w, toxic), 0) + 1
            if len(counts) > 300_000:
                yield out()
                counts.clear()
    yield out()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = list(set(words_in(text)))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array(words, pa.binary())], names=["row", "word"])


def train(labelled: DataFrame, of: dict[int, int] | None = None) -> Machine | None:
    """The machine for (text, toxic) rows; None without both classes.

    ``of``: how many texts of each class the rows are a sample of; their own numbers if it is not given.
    """
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    words = labelled.select("text", "toxic").mapInArrow(_count, _COUNTED).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")
    ).where(F.length("word") > 1)
    words = freeze(words, "toxic-words")
    share, ratio = sizes[1] / (sizes[0] + sizes[1]), sizes[1] / sizes[0]
    # How surely a word marks toxic texts: twice the log likelihood ratio against chance.
    seen = F.col("bad") + F.col("good")
    sure = 2 * (F.col("bad") * F.log(F.col("bad") / (seen * share)) + F.col("good") * F.log(F.greatest(F.col("good"), F.lit(1e-9)) / (seen * (1 - share))))
    marks = words.where(F.col("bad") >= LEAST_TEXTS).where(F.col("bad") > share * seen).select("word", sure.alias("sure"))
    marks = freeze(marks.where(F.col("sure") >= LEAST_SURE), "toxic-marks")
    # Each toxic text votes for its few surest words; the others are there by chance, or as copies of the text.
    held = labelled.where("toxic = 1").select(F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_words, "row bigint, word binary")
    ranked = held.join(marks, "word").withColumn("at", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("sure"), "word")))
    ranked = ranked.withColumn("top", F.max("sure").over(Window.partitionBy("row")))
    votes = ranked.where((F.col("at") <= VOTES) & (F.col("sure") >= 0.1 * F.col("top"))).groupBy("word").agg(F.count("*").alias("bad"))
    positive = votes.orderBy(F.desc("bad"), "word").limit(POSITIVES).collect()
    clean = words.where(F.col("good") > 0).where(F.col("bad") <= 2 * ratio * F.col("good") + 1)
    common = clean.orderBy(F.desc("good"), "word").limit(NEGATIVES // 4).collect()
    any_ = clean.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES - NEGATIVES // 4).collect()
    negative = {bytes(r["word"]): r["good"] for r in [*any_, *common]}
    if not positive or not negative:
        return None
    votes = {bytes(r["word"]): float(np.log1p(r["bad"])) for r in positive}
    for r in positive[:DISGUISED]:
        word = bytes(r["word"])
        if word.isalpha() and len(word) > 3:
            votes.update({w: 0.5 * votes[word] for w in disguised(word) if w not in votes and w not in negative})
    weight = np.concatenate([list(votes.values()), np.log1p(list(negative.values()))])
    machine = fit_words(list(votes), list(negative), weight)
    # The curve: on a bounded sample of the training texts, each of which stands for its share of its class.
    # A text is in it by its own hash, so no task sees the texts of others.
    place = F.pmod(F.xxhash64(F.lit("curve"), "text"), F.lit(1 << 40))
    x, y, stands = [], [], []
    for toxic in (1, 0):
        sample = labelled.where((F.col("toxic") == toxic) & (place < _share(sizes[toxic], CURVE_TEXTS)))
        values = sample.select("text").mapInArrow(_text_values(machine), "top double, next double").toPandas().to_numpy()
        x.append(values)
        y.append(np.full(len(values), float(toxic)))
        stands.append(np.full(len(values), (of or sizes)[toxic] / len(values)))
    machine.curve = _fit_curve(np.concatenate(x), np.concatenate(y), np.concatenate(stands))
    machine.known.clear()
    return machine


#: Texts of either class that the curve is fitted on: all of a smaller class, else about so many.
CURVE_TEXTS = 3_000


def _text_values(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = machine.text_values(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["top", "next"])

    return run


def _scores(machine: Machine | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = np.full(len(texts), 0.5)
            for low in range(0, len(texts) if machine else 0, 200):
                out[low : low + 200] = machine.scores(texts[low : low + 200])
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(out)], names=[*(batch.schema.names[i] for i in keep), "score"]
            )

    return run


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, held_out, score) of every row of ``docs`` (doc_id, held_out, text)."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_scores(machine), "doc_id bigint, held_out boolean, score double")


#: Distinct labelled texts of either class that are learnt from: all of a smaller class, else about so many.
LABELLED_TEXTS = 100_000


def _share(size: int, most: int) -> int:
    """Bound of a 40-bit hash under which about ``most`` of ``size`` rows lie, all if they are fewer."""
    return (1 << 40) * most // max(size, most)


def training_texts(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) to learn from, of the rows of ``docs`` (doc_id, text, file, at) that ``labels`` (doc_id, toxic)
    names, each text once a class; and the number of distinct texts of each class.

    Repeats are found by 128 bits of hash.  A bounded sample is chosen by the texts' own hashes and
    fetched by place in the files: the places (24 bytes for about 2 * LABELLED_TEXTS rows) are broadcast, texts stay.
    """
    hashed = docs.select("doc_id", "file", "at", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("again"), "text").alias("h2"))
    first = hashed.join(labels, "doc_id").groupBy("h1", "h2", "toxic").agg(F.min(F.struct("file", "at")).alias("first"))
    places = freeze(first.select("first.file", "first.at", "toxic", F.pmod("h2", F.lit(1 << 40)).alias("place")), "toxic-places")
    sizes = {r["toxic"]: r["count"] for r in places.groupBy("toxic").count().collect()}
    bound = F.when(F.col("toxic") == 1, F.lit(_share(sizes.get(1, 0), LABELLED_TEXTS))).otherwise(F.lit(_share(sizes.get(0, 0), LABELLED_TEXTS)))
    chosen = places.where(F.col("place") < bound).drop("place")
    return freeze(docs.join(F.broadcast(chosen), ["file", "at"]).select("text", "toxic"), "toxic-training"), sizes


def op7_string_kernel_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"), (~training_rows(3, 1)).alias("held_out"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
    )
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(training_rows(3, 1))
    machine = train(*training_texts(docs.where("NOT held_out"), labels))
    return score(docs, machine).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
