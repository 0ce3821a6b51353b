"""What the operators share: scratch tables, ASCII words and hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.storage import freeze, scratch_path

__all__ = ["freeze", "scratch_path", "documents", "training_rows", "hide", "lower_words", "alnum_words", "hash_words", "mix64", "shingle_hashes"]

#: Every byte that the contract's word pattern leaves out becomes a space, A-Z become a-z.
_ALNUM = bytes(
    32 if b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def training_rows(modulus: int, held_out: int, doc_id: str = "doc_id") -> Column:
    """Whether a row may be learnt from: crc32 of the id as text, modulo.  A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus != held_out


def hide(df: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``keep`` under names that clash with none, and the columns that bring them back."""
    names = {c: c if c in keep else f"__extra_{i}" for i, c in enumerate(df.columns)}
    hidden = df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()])
    return hidden, [F.col(n).alias(c) for c, n in names.items()]


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space (0x20, 0x09-0x0D), with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, a-z and everything outside ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal input gives equal output on every worker."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash_bytes(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class _Hashes(dict):
    """Word hashes, kept while they are few; clearing it changes no result."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = hash_bytes(word)
        return value


_HASHES = _Hashes(400_000)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter, not empty text is one shingle of all its words."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    with np.errstate(over="ignore"):
        out = words[: n - size + 1].copy()
        for i in range(1, size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i]
    return mix64(out)


def quoted(name: str) -> str:
    """A column name that is safe to quote."""
    return "`" + name.replace("`", "``") + "`"
