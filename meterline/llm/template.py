"""Main text of web pages by the templates that pages of one host share.

1. Every page becomes a sequence of tokens (``markup``): tags told apart by the
   elements around them, and texts of whole blocks.
2. A token's occurrence vector says how often it is on each page of its host.
   Vectors are never held: each is an exclusive-or of hashes of (page, count),
   128 bits wide, which sums per task before the shuffle, so a host with a third of all
   pages costs no more in any one task.  Tokens with equal vectors are an
   equivalence class.
3. A class is valid if its tokens come in one order, over and over, on every
   page, no other class crosses its spans, and it always stands in one slot of the
   class around it.  Valid classes nest into the host's template.
4. What the template leaves, its slots, is the pages' own.  Of the slots the
   article is taken: the article element, else the main element, else all that
   stands outside menus, headers, footers, sidebars, notices, adverts, forms and
   comments (by element, role and class name) and is not a slot made of links.
   A block whose text belongs to a valid class is part of the template.

A block's text is one token, so a frequent word is never taken for template, and
a host's texts count as template only where at least ``least_text_pages`` pages share
them and the pages keep twice as much text of their own: hosts of one page, or of copies
of one article, lose nothing.  Hosts are compared in lower case, without user and port.

Cases: null and empty pages give an empty text; pages without a host form one group;
repeated rows are pages like others; a null page_id or url is passed on; pages of any
length are read whole; unfinished markup is read to its end; extra columns are left
out.  White space is what Unicode counts as such.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeze
from .markup import BESIDE, OTHER, read_page


@dataclass(frozen=True)
class Settings:
    #: Pages and share of a host's pages (one in so many) that a class must be on.  The share bounds a
    #: host's template by the length of its pages, whatever their number.
    least_pages: int = 4
    share: int = 5
    least_tokens: int = 2
    #: Pages on which a text must be to be template.
    least_text_pages: int = 8


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_READ = "row long, host string, tokens array<long>, chars array<int>, linked array<int>, regions array<byte>"


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), _HOST, 1), F.lit(""))))


def read(pages: DataFrame) -> DataFrame:
    """Token sequences of ``pages`` (row, host, html), and per block text its length, linked characters and region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [read_page(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("host"),
                pa.array([p.tokens for p in done], pa.list_(pa.int64())),
                pa.array([[len(b.text) for b in p.blocks] for p in done], pa.list_(pa.int32())),
                pa.array([[b.linked for b in p.blocks] for p in done], pa.list_(pa.int32())),
                pa.array([[b.region for b in p.blocks] for p in done], pa.list_(pa.int8())),
            ], names=["row", "host", "tokens", "chars", "linked", "regions"])

    return pages.select("row", "host", F.col("html").cast("string")).mapInArrow(run, _READ)


def occurrence_classes(read_pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, class, pages, tokens): tokens of a host with one occurrence vector, on enough of its pages."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hosts, tokens, times = [], [], [], []
            for row, host, found in zip(batch.column("row").to_pylist(), batch.column("host").to_pylist(), batch.column("tokens"), strict=True):
                distinct, n = np.unique(found.values.to_numpy(zero_copy_only=False), return_counts=True)
                tokens.append(distinct)
                times.append(n)
                rows += [row] * len(n)
                hosts += [host] * len(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), pa.array(hosts, pa.string()),
                pa.array(np.concatenate(tokens) if tokens else [], pa.int64()), pa.array(np.concatenate(times) if times else [], pa.int64()),
            ], names=["row", "host", "token", "n"])

    found = read_pages.select("row", "host", "tokens").mapInArrow(counts, "row long, host string, token long, n long")
    vectors = found.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("row", "n")).alias("v1"), F.bit_xor(F.xxhash64(F.lit("other"), "n", "row")).alias("v2"), F.count(F.lit(1)).alias("pages")
    ).where(F.col("pages") >= settings.least_pages)
    sizes = read_pages.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    frequent = vectors.join(sizes, "host").where(F.col("pages") * settings.share >= F.col("all_pages"))
    return frequent.groupBy("host", "v1", "v2", "pages").agg(F.array_sort(F.collect_list("token")).alias("tokens")).where(
        F.size("tokens") >= settings.least_tokens
    ).select("host", F.col("tokens")[0].alias("class"), "pages", "tokens")


def _walk(tokens: list[int], of: dict[int, int], sizes: dict[int, int]) -> tuple[dict, dict, set]:
    """Order of each class on a page (None: not one cycle), its parents (class, slot), and classes that cross another."""
    seen: dict[int, list[int]] = {}
    for t in tokens:
        if t in of:
            seen.setdefault(of[t], []).append(t)
    orders, place = {}, {}
    for c, found in seen.items():
        cycle = found[: sizes[c]]
        whole = len(set(cycle)) == sizes[c] and len(found) % sizes[c] == 0 and cycle * (len(found) // sizes[c]) == found
        orders[c] = cycle if whole else None
        if whole:
            place.update((t, k) for k, t in enumerate(cycle))
    parents: dict[int, set] = {}
    crossing: set[int] = set()
    stack: list[list[int]] = []
    for t in tokens:
        if t not in place:
            continue
        c, k = of[t], place[t]
        if k == 0:
            parents.setdefault(c, set()).add(tuple(stack[-1]) if stack else (0, -1))
            stack.append([c, 0])
        else:
            while stack and stack[-1][0] != c:
                # Spans that overlap without nesting: the smaller class gives way.
                crossing.add(min(stack.pop()[0], c, key=lambda x: (sizes[x], x)))
            if not stack:
                continue
            stack[-1][1] = k
        if k == sizes[c] - 1 and stack:
            stack.pop()
    return orders, parents, crossing


_SEEN = "host string, class long, ordering long, order array<long>, parent long, slot int, bad boolean"


def _seen_on_pages(read_pages: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (host, class, order, parent, slot) that the pages show; each task sends every one once or a few times."""
    per_host = classes.groupBy("host").agg(F.collect_list("tokens").alias("classes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "class", "ordering", "order", "parent", "slot", "bad"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.bool_()]

        def out(facts):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*facts.values(), strict=True), types, strict=True)], names=names)

        facts: dict = {}
        for batch in batches:
            for host, tokens, groups in zip(*(batch.column(n).to_pylist() for n in ("host", "tokens", "classes")), strict=True):
                of = {t: g[0] for g in groups for t in g}
                orders, parents, crossing = _walk(tokens, of, {g[0]: len(g) for g in groups})
                for c, order in orders.items():
                    if order is None or c in crossing:
                        facts[host, c, None] = (host, c, None, None, None, None, True)
                        continue
                    name = _order_name(order)
                    for parent, slot in parents[c]:
                        facts[host, c, name, parent, slot] = (host, c, name, order, parent, slot, False)
            if len(facts) > 50_000:
                yield out(facts)
                facts = {}
        if facts:
            yield out(facts)

    return read_pages.join(per_host, "host").select("host", "tokens", "classes").mapInArrow(run, _SEEN)


def _order_name(order: list[int]) -> int:
    value = xxhash.xxh3_64_intdigest(np.asarray(order, np.int64).tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value


def templates(read_pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, class, pages, tokens in order, parent, slot) of the valid classes: the hosts' templates.

    ``parent`` is the class around it (0: none) and ``slot`` the place of the
    parent's token before it.  ``read_pages`` is frozen; it is read three times.
    """
    classes = freeze(occurrence_classes(read_pages, settings), "template-classes")
    shown = _seen_on_pages(read_pages, classes).groupBy("host", "class").agg(
        F.bool_or("bad").alias("bad"), F.min("ordering").alias("o1"), F.max("ordering").alias("o2"),
        F.min(F.struct("parent", "slot")).alias("p1"), F.max(F.struct("parent", "slot")).alias("p2"),
        F.max_by("order", "ordering").alias("order"),
    )
    valid = shown.where(~F.col("bad") & (F.col("o1") == F.col("o2")) & (F.col("p1") == F.col("p2")))
    return valid.join(classes.select("host", "class", "pages"), ["host", "class"]).select(
        "host", "class", "pages", F.col("order").alias("tokens"), F.col("p1.parent").alias("parent"), F.col("p1.slot").alias("slot")
    )


def _slots(tokens, tags, texts):
    """For each block of a page: whether the template has its text, and the template's tag before it (0: none)."""
    last, out = 0, []
    for t in tokens:
        if t & 1:
            out.append((t in texts, last))
        elif t in tags:
            last = t
    return out


def host_rules(read_pages: DataFrame, found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(host, tags, texts, menus): the template's tags, its texts, and the slots made of links, one row a host."""
    tokens = found.select("host", "pages", F.explode("tokens").alias("t"), F.exists("tokens", lambda t: t.bitwiseAND(1) == 0).alias("tagged"))
    text = F.col("t").bitwiseAND(1) == 1
    enough = F.col("tagged") & (F.col("pages") >= settings.least_text_pages)
    base = freeze(tokens.groupBy("host").agg(
        F.collect_set(F.when(~text, F.col("t"))).alias("tags"), F.collect_set(F.when(text & enough, F.col("t"))).alias("texts")
    ), "template-base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            names = ("host", "tokens", "chars", "linked", "regions", "tags", "texts")
            for host, tokens, chars, linked, regions, tags, texts in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                best = min(regions, default=OTHER)
                places = _slots(tokens, set(tags), set(texts))
                for (shared, slot), n, links, region in zip(places, chars, linked, regions, strict=True):
                    if region == best and region != BESIDE:
                        cell = sums.setdefault((host, slot), [0, 0, 0])
                        cell[0] += n * shared
                        cell[1] += n * (not shared)
                        cell[2] += links
            if len(sums) > 50_000:
                yield out(sums)
                sums = {}
        yield out(sums)

    def out(sums):
        keys, values = list(sums), np.array(list(sums.values()), np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array(values[:, k]) for k in range(3)]],
            names=["host", "slot", "shared", "own", "linked"],
        )

    cells = read_pages.join(base, "host").mapInArrow(run, "host string, slot long, shared long, own long, linked long")
    slots = cells.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("shared", "own", "linked")])
    links = F.col("linked") * 2 > F.col("shared") + F.col("own")
    sums = slots.groupBy("host").agg(F.sum("shared").alias("shared"), F.sum("own").alias("own"), F.collect_set(F.when(links, F.col("slot"))).alias("menus"))
    none = F.array().cast("array<bigint>")
    return base.join(sums, "host", "left").select(
        "host", "tags", F.when(F.col("shared") * 2 <= F.col("own"), F.col("texts")).otherwise(none).alias("texts"),
        F.coalesce("menus", none).alias("menus"),
    )


def page_text(html: str | None, tags: set, texts: set, menus: set) -> str:
    """The blocks that the template leaves in the article's slots."""
    page = read_page(html)
    best = page.article()
    kept = []
    for block, (shared, slot) in zip(page.blocks, _slots(page.tokens, tags, texts), strict=True):
        if block.region != best or best == BESIDE or shared:
            continue
        if best == OTHER and slot in menus:
            continue
        kept.append(block.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(page_id, url, host, text) of every row of ``pages`` (page_id, url, html)."""
    named = with_host(pages.select("page_id", "url", "html"))
    rows = freeze(read(named.withColumn("row", F.monotonically_increasing_id())), "template-pages")
    rules = freeze(host_rules(rows, freeze(templates(rows, settings), "templates"), settings), "template-rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = (batch.column(n).to_pylist() for n in ("tags", "texts", "menus"))
            texts = [page_text(h.as_py(), *map(set, (a or (), b or (), c or ()))) for h, a, b, c in zip(batch.column("html"), *given, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.string())], names=["page_id", "url", "host", "text"]
            )

    typed = named.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "host", F.col("html").cast("string"))
    return typed.join(rules, "host", "left").mapInArrow(run, "page_id long, url string, host string, text string")


def op13_template_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
