"""The subsequence kernel against brute force, and the odd rows of the toxicity query."""

import itertools
import random
import zlib

import numpy as np
import pytest

from meterline.llm import toxicity

WORDS = "river stone lamp green quick idle moon forest paper seven".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def char_class(b):
    return 1 if b == 1 else b - 95 if 97 <= b <= 122 else 28 + b % 9 if b < 128 else 37 + b % 27


def brute_features(word):
    """Weights of all triples of characters in order that span at most SPAN places, the beginning's mark included."""
    codes = [char_class(b) for b in b"\x01" + word]
    out = {}
    for i, j, k in itertools.combinations(range(len(codes)), 3):
        if k - i < toxicity.SPAN:
            key = (codes[i] * 64 + codes[j]) * 64 + codes[k]
            out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i + 1)
    return out


def test_kernel_as_brute_force():
    draw = random.Random(2)
    words = [b"a", b"ab", b"aaaa", b"idiot", b"i.d.i.o.t", "fö\u00df".encode(), b"0x9!"]
    words += [bytes(draw.choice(b"abci.1") for _ in range(draw.randrange(1, 15))) for _ in range(40)]
    row, key, value = toxicity.features(words)
    norms = toxicity._norms(words)
    got = [{int(k): v for k, v in zip(key[row == r], value[row == r])} for r in range(len(words))]
    for r, word in enumerate(words):
        expected = {k: v / norms[r] for k, v in brute_features(word).items()}
        assert got[r].keys() == expected.keys() and all(abs(got[r][k] - v) < 1e-12 for k, v in expected.items())
    weights = np.random.default_rng(1).normal(size=64**3)
    values = toxicity.Machine(weights, 0.25).word_values(words)
    for r, word in enumerate(words):
        assert values[r] == pytest.approx(sum(weights[k] * v for k, v in got[r].items()) + 0.25)


def test_odd_rows(spark, tmp_path):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = prose(i, 30).split()
        if i % 4 == 0:
            words[draw.randrange(30)] = draw.choice(["numskull", "wretch"])
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, 1, int(i % 4 == 0)))
    long = prose(900, 60_000)
    rows += [(1000, None, "x", 0.5), (1001, "", "x", 0.5), (1002, long + " wretch", "x", 0.5), (1003, long, "x", 0.5), (None, "a wretch", "x", 0.5)]
    # One text, and one whole row, many times over: they count once.
    rows += [(2000, "the wretch of the river", "x", 0.5)] * 300 + [(3000 + k, "the wretch of the river", "x", 0.5) for k in range(300)]
    labels += [(2000, None, 1), (2000, 1, 0), (1000, 1, 0), (1001, 1, 0), (1002, 1, None), (None, 1, 1)] + [(3000 + k, 1, 0) for k in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string, held_out string, score double").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op7_string_kernel_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    by_id = {}
    for r in out:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.7)
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_id[2000]) == 1 and by_id[1000] == by_id[1001]
    assert max(by_id[1002]) > 0.5 > max(by_id[1003]) and max(by_id[None]) > 0.5
    plain = [r for r in out if r.doc_id is not None and r.doc_id < 400]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in plain) >= 0.97 * len(plain)


def test_training_texts_are_distinct_rows(spark, tmp_path):
    rows = [(k % 7, f"text {k % 5}" if k % 5 else None) for k in range(70)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d").selectExpr("doc_id", "text", "xxhash64(_metadata.file_path) AS file", "_metadata.row_index AS at")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id bigint, toxic int")
    texts, sizes = toxicity.training_texts(docs, labels)
    expected = sorted({(f"text {k % 5}" if k % 5 else "", k % 7 % 2) for k in range(70) if k % 7 < 6})
    assert sorted((r.text or "", r.toxic) for r in texts.collect()) == expected
    assert sizes == {0: sum(t == 0 for _, t in expected), 1: sum(t == 1 for _, t in expected)}


def test_a_bounded_sample_keeps_the_prior(spark, tmp_path, monkeypatch):
    rows = [(i, prose(i, 12) + (" wretch" if i % 3 == 0 and i % 2 else "")) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = [r.score for r in toxicity.op7_string_kernel_toxicity(spark, str(tmp_path)).collect()]
    monkeypatch.setattr(toxicity, "LABELLED_TEXTS", 200)  # about all toxic texts and a third of the clean ones
    some = [r.score for r in toxicity.op7_string_kernel_toxicity(spark, str(tmp_path)).collect()]
    assert abs(np.mean(whole) - 1 / 3) < 0.04 and abs(np.mean(some) - 1 / 3) < 0.06


def test_curve_sample_follows_the_classes(spark, monkeypatch):
    """Beyond the bound about so many texts are taken, chosen by their own hash and not by their place."""
    monkeypatch.setattr(toxicity, "CURVE_TEXTS", 200)
    seen = []
    fit = toxicity._fit_curve
    monkeypatch.setattr(toxicity, "_fit_curve", lambda x, y, stands: seen.append((y, stands)) or fit(x, y, stands))
    rows = [(prose(i, 12) + (" wretch" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "text string, toxic int")
    for n in (1, 5):
        toxicity.train(frame.repartition(n))
    (y, stands), (again, _) = seen
    assert 150 < (y == 1).sum() < 260 and 150 < (y == 0).sum() < 260 and (np.sort(y) == np.sort(again)).all()
    assert stands[y == 1].sum() == pytest.approx(500) and stands[y == 0].sum() == pytest.approx(1000)
