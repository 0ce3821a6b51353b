"""Fill-in-the-middle by a piece table: descriptors over immutable buffers, permuted and never copied.

A document is one piece over its own UTF-8 buffer.  Cutting splits a piece in
two; an arrangement permutes the three pieces and puts sentinel pieces, which
point into a buffer that all documents share, in front of each.  Only rendering
joins bytes; digests and lengths stream over the descriptors.  The inverse
permutation, with the sentinels left out, restores the document.

Cases: a null text is an empty one; an empty text, or one that holds a sentinel,
stays plain; a null doc_id counts as '' where the draw is made; texts of any
length are cut whole; equal rows give equal results; extra columns pass through
``transform``, and one named ``fim`` gives way to the result.  Every row is handled alone, so no
group of rows can be hot and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, hide, quoted

#: Sentinels of prefix, suffix and middle, one after another in the shared buffer.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Which of prefix (0), middle (1) and suffix (2) stands where.
ORDERS = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}
_NAMES = ("prefix", "middle", "suffix")
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Settings:
    """Share of documents that are rearranged, and of these the share put suffix first, in percent."""

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80


@dataclass(frozen=True)
class Piece:
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over immutable buffers; buffer 0 holds the sentinels."""

    def __init__(self, buffers: tuple[bytes, ...], pieces: tuple[Piece, ...]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls((b"".join(MARKS.values()), text), (Piece(1, 0, len(text)),))

    def cut(self, offset: int) -> PieceTable:
        """Split the piece that spans ``offset``; a cut at an end gives an empty piece."""
        out, at, done = [], 0, False
        for p in self.pieces:
            if not done and at <= offset <= at + p.length:
                left = offset - at
                out += [replace(p, length=left), Piece(p.buffer, p.start + left, p.length - left)]
                done = True
            else:
                out.append(p)
            at += p.length
        return PieceTable(self.buffers, tuple(out))

    def permuted(self, order: Iterable[int]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def marked(self, names: Iterable[str]) -> PieceTable:
        """A sentinel piece in front of each piece."""
        starts, at = {}, 0
        for name, mark in MARKS.items():
            starts[name] = Piece(0, at, len(mark))
            at += len(mark)
        pairs = [(starts[name], p) for name, p in zip(names, self.pieces, strict=True)]
        return PieceTable(self.buffers, tuple(x for pair in pairs for x in pair))

    def views(self) -> Iterator[memoryview]:
        for p in self.pieces:
            yield memoryview(self.buffers[p.buffer])[p.start : p.start + p.length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def render(self) -> bytes:
        return b"".join(self.views())


def arrange(table: PieceTable, form: str) -> PieceTable:
    """Prefix, middle and suffix in the order of ``form``, each behind its sentinel."""
    order = ORDERS[form]
    return table if form == "plain" else table.permuted(order).marked(_NAMES[i] for i in order)


def restore(table: PieceTable, form: str) -> PieceTable:
    """The document: sentinel pieces left out, the others under the inverse permutation."""
    kept = PieceTable(table.buffers, tuple(p for p in table.pieces if p.buffer != 0))
    order = ORDERS[form]
    return kept.permuted(sorted(range(len(order)), key=order.__getitem__))


def reopen(output: bytes, form: str) -> PieceTable:
    """A rendered output as a piece table again: pieces between the sentinels, which no text holds."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    order = [_NAMES[i] for i in ORDERS[form]]
    starts, at = [], 0
    for name in order:
        at = output.index(MARKS[name], at)
        starts.append(at)
        at += len(MARKS[name])
    ends = [*starts[1:], len(output)]
    sizes = [len(MARKS[n]) for n in order]
    pieces = [(Piece(0, 0, n), Piece(1, s + n, e - s - n)) for s, e, n in zip(starts, ends, sizes, strict=True)]
    return PieceTable(table.buffers, tuple(x for pair in pieces for x in pair))


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def infill(text: bytes, doc_id: int | None, settings: Settings) -> tuple[int, str, PieceTable]:
    """Unit count, form and the cut table (not yet arranged) of one document."""
    h1, h2, h3, h4 = draws(doc_id, settings.seed)
    units = _UNIT.findall(text)
    n = len(units)
    table = PieceTable.of(text)
    if not text or any(m in text for m in MARKS.values()) or h3 % 100 >= settings.rate:
        return n, "plain", table
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = sum(map(len, units[:first]))
    b = a + sum(map(len, units[first:second]))
    return n, "spm" if h4 % 100 < settings.suffix_first else "psm", table.cut(a).cut(b)


def _code_points(view: memoryview) -> int:
    return len(bytes(view).decode("utf-8", "surrogatepass"))


_FIM = (
    "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output_sha256:string,restored_sha256:string,"
    "pieces:array<struct<buffer:int,start:bigint,length:bigint>>,output:string>"
)
_ARROW = pa.struct([
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
    ("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))), ("output", pa.string()),
])


def transformed(doc_id: int | None, text: str | None, settings: Settings = Settings(), texts: bool = True) -> dict:
    """One document's output.  The restored digest starts from the rendered bytes and the form alone."""
    n, form, cut = infill(text.encode("utf-8", "surrogatepass") if text else b"", doc_id, settings)
    out = arrange(cut, form)
    rendered = out.render()
    prefix, middle = (None, None) if form == "plain" else [_code_points(v) for v in list(cut.views())[:2]]
    return {
        "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output_sha256": out.sha256(),
        "restored_sha256": restore(reopen(rendered, form), form).sha256(),
        "pieces": [{"buffer": p.buffer, "start": p.start, "length": p.length} for p in out.pieces],
        "output": rendered.decode("utf-8", "surrogatepass") if texts else None,
    }


def transform(docs: DataFrame, settings: Settings = Settings(), texts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with a struct ``fim`` of what ``transformed`` gives.

    ``pieces`` are the descriptors of the output over the sentinels (buffer 0) and the text (1);
    ``output`` is its text, or null without ``texts``.
    """
    typed = docs.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")})
    hidden, shown = hide(typed, ("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, given = batch.column("doc_id").to_pylist(), batch.column("text")
            done = [transformed(i, t.as_py(), settings, texts) for i, t in zip(ids, given, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, _ARROW)], names=[*batch.schema.names, "__fim"])

    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in hidden.schema.fields)
    rows = hidden.mapInArrow(run, f"{schema}, __fim {_FIM}")
    return rows.select(*[c for c, name in zip(shown, docs.columns, strict=True) if name != "fim"], F.col("__fim").alias("fim"))


def op11_infill_piece_table(spark, sf_dir: str) -> DataFrame:
    fields = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    rows = transform(documents(spark, sf_dir).select("doc_id", "text"), texts=False)
    return rows.select("doc_id", *[F.col(f"fim.{f}").alias(f) for f in fields])
