"""Piece tables, the radix sort and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterline.llm import infill, radix, resampling
from meterline.llm.oracles import ORACLES

WORDS = "river stone lamp green quick idle moon forest paper seven".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(9)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", " ", "one", "  two words\n", "has <P> inside", "<M>", "a<P", "<S", "> x >", "été \U0001f600 한국어\x0b x  y\n", "x y　z", prose(1, 20_000)]
    out = [(k, t) for k, t in enumerate(texts * 4)]
    return [*out, (None, prose(2, 30)), (None, prose(2, 30)), (3, prose(3, 40)), (3, prose(3, 40)), (-5, prose(4, 25)), (1 << 62, prose(5, 25))]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("infill")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, prose(9, 30)), (1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_infill_matches_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = infill.op11_infill_piece_table(spark, folder)
    order = sorted(df.columns)
    assert Counter(tuple(r[c] for c in order) for r in df.collect()) == Counter(
        con.sql(f"SELECT {', '.join(order)} FROM ({ORACLES['op11_infill_piece_table']})").fetchall()
    )


def test_infill_texts_restore(spark, rows):
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows], "doc_id bigint, text string, `fim` string, `n` int")
    out = infill.transform(docs.drop("fim")).collect()
    assert sorted(Counter(r.fim.form for r in out)) == ["plain", "psm", "spm"]
    for r in out:
        text = r.text or ""
        back = infill.restore(infill.reopen(r.fim.output.encode(), r.fim.form), r.fim.form).render().decode()
        assert back == text and r.n == 1
        assert r.fim.output_sha256 == hashlib.sha256(r.fim.output.encode()).hexdigest()
        assert sum(p.length for p in r.fim.pieces) == len(r.fim.output.encode())
        if r.fim.form != "plain":
            order = {"psm": "<P>{0}<S>{2}<M>{1}", "spm": "<S>{2}<P>{0}<M>{1}"}[r.fim.form]
            a, b = r.fim.prefix_chars, r.fim.prefix_chars + r.fim.middle_chars
            assert r.fim.output == order.format(text[:a], text[a:b], text[b:])
    clash = infill.transform(docs)
    assert clash.columns == ["doc_id", "text", "n", "fim"] and clash.where("fim.form is null").count() == 0


@hyp(max_examples=60, deadline=None)
@given(st.text(alphabet="ab <>PSM\n\té", max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm"]))
def test_piece_tables_invert(text, a, b, form):
    data = text.encode()
    if any(m in data for m in infill.MARKS.values()):
        return
    low, high = sorted((a % (len(data) + 1), b % (len(data) + 1)))
    table = infill.PieceTable.of(data).cut(low).cut(high)
    assert table.render() == data and len(table.pieces) == 3
    out = infill.arrange(table, form)
    assert infill.restore(out, form).render() == data
    assert infill.restore(infill.reopen(out.render(), form), form).render() == data
    assert out.sha256() == hashlib.sha256(out.render()).hexdigest()


@pytest.mark.parametrize("digit_bits,block_bits", [(2, 2), (5, 3), (11, 16)])
def test_radix_ranks_are_a_stable_sort(spark, digit_bits, block_bits):
    draw = random.Random(3)
    rows = [(k * 3, k, draw.choice([0, 5, 900]), draw.choice([0, 0, 0, 1, 63])) for k in range(400)]
    df = spark.createDataFrame(rows, "position bigint, row bigint, low bigint, high bigint").repartition(5)
    got = {r.row: r.position for r in radix.radix_ranks(df, ["low", "high"], [10, 6], digit_bits, block_bits).collect()}
    expected = sorted(rows, key=lambda r: (r[3], r[2], r[0]))
    assert got == {r[1]: k for k, r in enumerate(expected)}


def test_radix_without_bits_makes_positions_dense(spark):
    df = spark.createDataFrame([(9, 0), (70_000, 0), (1 << 40, 0)], "position bigint, low bigint")
    assert sorted(r.position for r in radix.radix_ranks(df, ["low"], [0]).collect()) == [0, 1, 2]


def features(text):
    low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(f) % 10_000 for f in words + [a + b" " + b for a, b in zip(words, words[1:])]]


def expected_draw(rows, target):
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(k for _, _, f in found for k in f), Counter(k for x in target for k in features(x)[1])
    size_s, size_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[k] + 1) * size_s / ((s[k] + 1) * size_t))) for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    long_enough = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4] >= 20)
    drawn = Counter()
    for k, key in enumerate(long_enough[: 25 * len(long_enough) // 100]):
        drawn[(key[0], None if key[1] else key[2], k + 1)] += 1
    return out, drawn


def test_resampling_as_brute_force(spark, rows, folder):
    got = resampling.op12_importance_resampling(spark, folder).collect()
    every, drawn = expected_draw(rows, [prose(9, 30), None, ""])
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(tuple(r[:4]) for r in every)
    assert Counter((-r.score, r.doc_id, r["rank"]) for r in got if r["rank"] is not None) == drawn


def test_wide_ids_and_ties_rank_by_id(spark, tmp_path):
    ids = [-(1 << 63), (1 << 63) - 1, None, 0, 5, 5, -1, 12]
    scores = spark.createDataFrame([(k, i, 20, 3, 0, 70) for k, i in enumerate(ids)] + [(99, 1, 19, 3, 0, 900)],
                                   "row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    ranks = {r.row: r["rank"] for r in resampling.ranks(scores, resampling.Settings(percent=100)).collect()}
    assert ranks == {0: 1, 6: 2, 3: 3, 4: 4, 5: 5, 7: 6, 1: 7, 2: 8}


def test_empty_target_and_source(spark):
    none = spark.createDataFrame([], "row bigint, doc_id bigint, text string")
    some = spark.createDataFrame([(0, 1, prose(1, 30))], none.schema)
    assert resampling.resample(none, some).count() == 0
    assert resampling.resample(some, none).select("rank").first()["rank"] is None  # 25 % of one row is none
    assert set(resampling.gains(none, none).tolist()) == {0}


def test_extra_columns_are_left_alone(spark):
    docs = spark.createDataFrame([(0, 1, prose(1, 30), "x", "y")], "row bigint, doc_id bigint, text string, position string, score string")
    assert resampling.resample(docs, docs.limit(0)).count() == 1
    assert infill.transform(docs.withColumn("a`b", F.lit(1))).columns[-2:] == ["a`b", "fim"]
