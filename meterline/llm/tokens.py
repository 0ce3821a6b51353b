"""Whole texts as token ids and spans, and tokens counted per section.

Byte-level BPE splits a text before a space that a non-space follows, so such
stretches are encoded once and remembered; the ids are those of the whole text.
Texts of characters whose classes never changed are cut into words by the
tokenizer's own pattern instead, and words not seen yet go straight to its merges.

Attribution: a text is encoded once as a whole.  Its tokens' character spans and
its sections' spans are both sorted and tile the text, so the interval join is
one merge: the section in which a token begins is found by bisection.  A token
that crosses a boundary counts for the section in which it begins; ``shared``
counts the tokens that begin earlier and reach into the section.  A token that is
a part of a character spans that character.

Sections are a text's lines: the span up to and with each line feed.  An empty or
null text has one empty section without tokens.  Repeated rows are counted one by
one.  An empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents

#: Remembered stretches; clearing them changes no result.
MOST = 1_000_000
#: The same for ids, which are many more bytes: under 100 MB of a worker.
MOST_IDS = 250_000

#: Letters, and marks that are neither letters, digits nor white space, in every version of Unicode in use.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0410-\u044f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARKS = "!-/:-@\\[-`{-~\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201d\u2026\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
_OTHER = re.compile(f"[^ \t\n\r0-9{_LETTERS}{_MARKS}]")
#: What byte-level BPE cuts texts of these characters into.
_WORDS = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[{_MARKS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")

#: A space that does not lead a word.
_WIDE = re.compile(r" (?:\s|\Z)")

#: No merge.
_NONE = np.int32(2**31 - 1)


class Merges:
    """The merges of a byte-level BPE file, done in many words at once."""

    SLOTS = 18

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        characters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.bytes = np.array([vocab[characters[b]] for b in range(256)], dtype=np.int64)
        left, right, self.made = (np.array([vocab[x] for x in part], dtype=np.int64) for part in ((m[0] for m in merges), (m[1] for m in merges), (m[0] + m[1] for m in merges)))
        last = np.full(max(vocab.values()) + 1, -1)
        rank = np.arange(len(merges))
        np.maximum.at(last, self.made, rank)
        keys = left << np.int64(32) | right
        if (np.maximum(last[left], last[right]) >= rank).any() or len(np.unique(keys)) < len(keys):
            raise ValueError("a merge stands before one that makes its parts")
        # Pairs that share a slot with an earlier one go to the next table.
        self.tables = []
        while len(keys):
            slot = self._slots(keys, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            held, ranks = np.full(1 << self.SLOTS, -1), np.full(1 << self.SLOTS, _NONE, dtype=np.int32)
            held[slot[first]], ranks[slot[first]] = keys[first], rank[first]
            self.tables.append((held, ranks))
            rest = np.delete(np.arange(len(keys)), first)
            keys, rank = keys[rest], rank[rest]

    def _slots(self, keys: np.ndarray, table: int) -> np.ndarray:
        mixed = (keys ^ (keys >> np.int64(29))).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 0x3C6EF372FE94F82A * table & 0xFFFFFFFFFFFFFFFF | 1)
        return (mixed >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys, 0)
        held, ranks = self.tables[0]
        found = held[slot]
        out = np.where(found == keys, ranks[slot], _NONE)
        left = np.flatnonzero((found != keys) & (found >= 0))
        for i, (held, ranks) in enumerate(self.tables[1:], 1):
            slot = self._slots(keys[left], i)
            found = held[slot]
            out[left] = np.where(found == keys[left], ranks[slot], _NONE)
            left = left[(found != keys[left]) & (found >= 0)]
        return out

    def ids(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and their number by word; ``data`` has the bytes of all, ``sizes`` how many each has."""
        symbols, word = self.bytes[data], np.repeat(np.arange(len(sizes)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = [(symbols[:0], word[:0])]
        while len(symbols):
            same = word[1:] == word[:-1]
            rank = np.append(np.where(same, self._ranks(symbols[:-1] << np.int64(32) | symbols[1:]), _NONE), _NONE)
            first = np.flatnonzero(np.append(True, ~same))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            keep = best != _NONE
            done.append((symbols[~keep], word[~keep]))
            at = np.flatnonzero(keep & (rank == best))
            if len(at):  # in a run of one symbol every other pair, from the left
                start = np.append(True, np.diff(at) != 1)
                at = at[(at - at[start][np.cumsum(start) - 1]) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=len(sizes))


@cache
def merges_of(path: str) -> Merges | None:
    """The merges of the file, kept by each worker; none if it cuts or merges otherwise than ``_WORDS`` and ``Merges`` do."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    cut, model = said.get("pre_tokenizer") or {}, said["model"]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True) or model.get("type") != "BPE":
        return None
    if any(said.get(x) for x in ("normalizer", "truncation", "padding")) or not all(t["special"] for t in said["added_tokens"]):
        return None
    if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    try:
        return Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
    except (KeyError, ValueError):
        return None


class Encoder:
    """Ids and character lengths of whole texts by a byte-level BPE file of ``tokenizers``."""

    def __init__(self, path: str):
        self.path, self.merges = path, merges_of(path)
        self.known: dict[str, bytes] = {}
        self.spans: dict[str, np.ndarray] = {}

    @cached_property
    def tokenizer(self):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives out the cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    @staticmethod
    def stretches(text: str) -> list[str]:
        """``text`` cut before each space that a character other than white space follows."""
        if not _WIDE.search(text) and "\x00" not in text:
            return text.replace(" ", "\x00 ").split("\x00")
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    @staticmethod
    def atoms(part: str) -> list[str]:
        """``part`` cut where BPE cuts it for certain: about a line feed between other characters, and before a mark after a letter."""
        out = []
        for i, line in enumerate(part.split("\n")) if "\n" in part else [(0, part)]:
            if i:
                if not line or line[0].isspace() or not out or out[-1][-1].isspace():
                    return [part]
                out.append("\n")
            if not line:
                return [part]
            if len(line) > 2 and line[-1] in ".,;:!?" and line[-2].isalpha():
                out += [line[:-1], line[-1]]
            else:
                out.append(line)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, as little-endian 32-bit numbers."""
        if len(self.known) > MOST_IDS:
            self.known.clear()
        plain = [self.merges is not None and not _OTHER.search(t) for t in texts]
        split = [_WORDS.findall(t) if p else self.stretches(t) if t else [] for t, p in zip(texts, plain, strict=True)]
        parts = {x for some, p in zip(split, plain, strict=True) if not p for x in some}
        self._learn_parts(parts.difference(self.known))
        # Each word of the texts once, and which of them stands where.
        flat = list(chain.from_iterable(split))
        which = pa.array(flat, pa.string()).dictionary_encode().indices.to_numpy()
        words = [flat[i] for i in np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1)).tolist()]
        self._learn_words([w for w in words if w not in self.known])
        found = [self.known[w] for w in words]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        data, first = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(size) - size
        size = size[which]
        end = np.cumsum(size)
        ids = data[np.repeat(first[which] - end + size, size) + np.arange(int(size.sum()))]
        last = np.cumsum(list(map(len, split)), dtype=np.int64)
        edge = np.append(0, end)[last] if len(texts) else last
        return [ids[x:y] for x, y in zip([0, *edge], edge)]

    def _learn_parts(self, new: set[str]) -> None:
        atoms = {p: self.atoms(p) for p in new}
        unknown = list({x for some in atoms.values() for x in some if x not in self.known})
        for low in range(0, len(unknown), 10_000):
            some = unknown[low : low + 10_000]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.known.update(zip(some, [np.array(e.ids, dtype="<u4").tobytes() for e in encoded], strict=True))
        self.known.update([(p, b"".join([self.known[x] for x in some])) for p, some in atoms.items() if len(some) > 1])

    def _learn_words(self, new: list[str]) -> None:
        for low in range(0, len(new), 20_000):
            some = pa.array(new[low : low + 20_000], pa.binary())
            edge = np.frombuffer(some.buffers()[1], dtype=np.int32, count=len(some) + 1)
            ids, per = self.merges.ids(np.frombuffer(some.buffers()[2], dtype=np.uint8, count=edge[-1]), np.diff(edge))
            data, edge = ids.tobytes(), (4 * np.cumsum(per)).tolist()
            self.known.update(zip(new[low : low + 20_000], [data[x:y] for x, y in zip([0, *edge], edge)], strict=False))

    def starts(self, text: str) -> np.ndarray:
        """(begin, end) of every token of the whole text, in characters."""
        if not text:
            return np.zeros((0, 2), dtype=np.int64)
        parts, spans = self.stretches(text), self.spans
        new = list({p for p in parts if p not in spans})
        if len(spans) + len(new) > MOST:
            spans.clear()
            new = list(set(parts))
        if new:
            encoded = self.tokenizer.encode_batch(new, add_special_tokens=False)
            spans.update(zip(new, [np.array(e.offsets, dtype=np.int32).reshape(-1, 2) for e in encoded], strict=True))
        pieces = [spans[p] for p in parts]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        counts = np.fromiter(map(len, pieces), dtype=np.int64, count=len(parts))
        return np.concatenate(pieces) + np.repeat(np.cumsum(sizes) - sizes, counts)[:, None]


def sections_of(text: str) -> np.ndarray:
    """First character of each section."""
    at, out = text.find("\n"), [0]
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, dtype=np.int64)


def attribute(text: str, spans: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that begin in each section, and tokens that reach into it from an earlier one."""
    counts, shared = np.zeros(len(begins), dtype=np.int64), np.zeros(len(begins) + 1, dtype=np.int64)
    first = np.searchsorted(begins, spans[:, 0], side="right") - 1
    last = np.maximum(np.searchsorted(begins, np.maximum(spans[:, 1] - 1, spans[:, 0]), side="right") - 1, first)
    np.add.at(counts, first, 1)
    crossing = last > first
    np.add.at(shared, first[crossing] + 1, 1)
    np.add.at(shared, last[crossing] + 1, -1)
    return counts, np.cumsum(shared)[:-1]


_SCHEMA = "doc_id bigint, section int, begin int, chars int, n_tokens bigint, shared bigint, doc_tokens bigint"


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for low in range(0, len(texts), 256):  # a bounded number of sections at a time
                out: list[list] = [[], [], [], [], [], [], []]
                for doc_id, text in zip(ids[low : low + 256], texts[low : low + 256], strict=True):
                    text = text or ""
                    spans, begins = encoder.starts(text), sections_of(text)
                    counts, shared = attribute(text, spans, begins)
                    n = len(begins)
                    out[0] += [doc_id] * n
                    out[1] += range(n)
                    out[2] += begins.tolist()
                    out[3] += np.diff([*begins, len(text)]).tolist()
                    out[4] += counts.tolist()
                    out[5] += shared.tolist()
                    out[6] += [len(spans)] * n
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(out, kinds, strict=True)],
                    names=["doc_id", "section", "begin", "chars", "n_tokens", "shared", "doc_tokens"],
                )

    return run


def count_sections(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per section: doc_id, section, begin, chars, n_tokens, shared, doc_tokens."""
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(_count(tokenizer), _SCHEMA)


def op10_section_tokens(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return count_sections(documents(spark, sf_dir), path("byte_bpe_50k.json"))
