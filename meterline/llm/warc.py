"""WARC archives written and read by Spark's text source.

Writing: of rows with equal payloads of at least ``least`` bytes, those with the
largest id become response records, the others revisit records without payload.
Files hold whole records, one after the other; ``gzip`` packs each file.

Reading: a file is cut at every occurrence of the record magic, wherever it
stands.  Cuts cover the file without gaps, so their running lengths give each
candidate's offset: lengths are summed per input split first, then over splits.
A candidate names its successor: the end of its header, plus the declared length,
plus four.  Which candidates are records is then a matter of reachability from
offset 0: magic inside a payload starts a candidate to which no chain leads.

Candidates that lead to the very next candidate of their split are contracted
into runs first; pointer jumping doubles the reach over runs, in as many rounds
as the logarithm of the longest chain of runs.  A split is one run unless
payloads contain the magic.  Payloads that were cut are put together again.

A record beyond the file's end (truncated) is not returned, nor is what follows a
broken chain.  Empty files have no records.  A null id or address leaves its
header out; a null payload is empty.  A line break in an address becomes %0A or
%0D.  Rows that share the largest id are all responses.  Input columns other than
id, address and payload are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freeze, scratch_path

MAGIC = "WARC/1.0\r\n"
_END = "\r\n\r\n"


def revisits(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """(_id, _refers): for each id whose payload repeats that of a larger id."""
    rows = pages.select(
        F.col(key).alias("_id"), F.sha2(_bytes(payload), 256).alias("_d"), F.octet_length(_bytes(payload)).alias("_n")
    ).where(F.col("_n") >= least)
    many = rows.groupBy("_d").agg(F.max("_id").alias("_refers"), F.count("*").alias("_copies")).where("_copies > 1")
    many = freeze(many.drop("_copies"), "warc-groups")
    return freeze(rows.join(many, "_d").where("_id < _refers").select("_id", "_refers").distinct(), "warc-revisits")


def _bytes(name: str) -> Column:
    return F.coalesce(F.col(name).cast("binary"), F.lit("").cast("binary"))


def records(pages: DataFrame, key: str, address: str, payload: str, least: int = 1000) -> DataFrame:
    """(record): the bytes of a WARC record without its closing line breaks, one per row of ``pages``."""
    known = revisits(pages, key, payload, least)
    rows = pages.select(F.col(key).alias("_id"), F.col(address).alias("_url"), _bytes(payload).alias("_p")).join(known, "_id", "left")
    again = F.col("_refers").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("_p").cast("string"), F.lit(_END),
    )
    safe_url = F.replace(F.replace(F.col("_url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    uuid = lambda c: F.regexp_replace(F.md5(F.concat(F.lit("page "), c.cast("string")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid(F.coalesce(F.col("_id").cast("string"), F.lit("null"))), F.lit(">"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", safe_url),
        line("X-Page-Id", F.col("_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("_p"))),
        line("X-Payload-Length", F.octet_length("_p").cast("string")),
        F.when(again, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), uuid(F.col("_refers")), F.lit(">"))),
            line("X-Refers-To-Page", F.col("_refers").cast("string")),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        )).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.when(again, F.lit(0)).otherwise(F.octet_length(http) + F.octet_length("_p")).cast("string"), F.lit(_END),
    )
    block = F.when(again, F.lit("").cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("_p")))
    return rows.select(F.concat(head.cast("binary"), block).alias("record"))


def write(record_rows: DataFrame, path: str, codec: str | None = "gzip") -> None:
    """Text files whose line end is the end of a record: the bytes are a plain WARC archive."""
    out = record_rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END)
    (out.option("compression", codec) if codec else out).text(path)


def _header(name: str, text: str = "_head") -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?is)(?:^|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frozen pieces between magics, and the narrow table of candidates.

    pieces: file, split, seq, value (what follows a magic; before the first: seq 0).
    candidates: file, split, seq, offset, next_offset, file_bytes, first (no magic before it).
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), "value",
    )
    pieces = freeze(raw, "warc-pieces")
    head = pieces.select(
        "file", "split", "seq", F.octet_length("value").alias("bytes"), F.substring_index("value", _END, 1).alias("_head"),
    ).select(
        "file", "split", "seq", "bytes",
        F.when(F.octet_length("_head") + 4 <= F.col("bytes"), F.octet_length("_head") + 4).alias("body"),
        F.regexp_extract("_head", r"(?is)(?:^|\r\n)content-length:[ \t]*([0-9]{1,15})[ \t]*(?:\r\n|$)", 1).alias("declared"),
    )
    head = freeze(head, "warc-heads")
    step = len(MAGIC)
    order = Window.partitionBy("file", "split").orderBy("seq")
    splits = head.groupBy("file", "split").agg(F.sum(F.col("bytes") + step).alias("size"))
    before = Window.partitionBy("file").orderBy("split")  # one row per input split
    splits = splits.select(
        "file", "split",
        (F.sum("size").over(before) - F.col("size")).alias("base"),
        F.sum("size").over(Window.partitionBy("file")).alias("all_bytes"),
    )
    placed = head.withColumn("within", F.sum(F.col("bytes") + step).over(order) - F.col("bytes") - step).join(splits, ["file", "split"])
    start = F.col("base") + F.col("within")  # of the piece's content; its magic stands before it
    return pieces, placed.select(
        "file", "split", "seq", (start - step).alias("offset"),
        (start + F.col("body") + F.col("declared").try_cast("bigint") + 4).alias("next_offset"),
        (F.col("all_bytes") - step).alias("file_bytes"),
    )


def reachable(cands: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Candidates on the chain from offset 0: file, split, seq, offset, next_offset, direct.

    ``direct`` marks a record whose successor is the next piece of its split.
    ``cands`` must be frozen; the piece before a file's first magic is no candidate.
    """
    cands = cands.where("offset >= 0")
    order = Window.partitionBy("file", "split").orderBy("offset")
    linked = cands.withColumn("direct", F.coalesce(F.lead("offset").over(order) == F.col("next_offset"), F.lit(False)))
    linked = linked.withColumn("starts", ~F.coalesce(F.lag("direct").over(order), F.lit(False)))
    runs = freeze(
        linked.withColumn("run", F.last(F.when(F.col("starts"), F.col("offset")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))),
        "warc-runs",
    )
    # An edge leads from a run's last candidate to the run that its successor is in.
    exits = runs.where("NOT direct").select("file", "run", F.col("next_offset").alias("entry"))
    edges = exits.join(
        runs.select("file", F.col("offset").alias("entry"), F.col("run").alias("to")), ["file", "entry"], "left"
    ).select("file", "run", "to", "entry")
    edges = freeze(edges, "warc-edges")
    jumps = edges.select("file", "run", "to")
    reached = freeze(runs.where("offset = 0").select("file", "run"), "warc-reached")
    size = reached.count()
    for _ in range(max_rounds):
        step = reached.join(jumps.where("to IS NOT NULL"), ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = freeze(reached.union(step).distinct(), "warc-reached")
        more = reached.count()
        if more == size:
            break
        size = more
        onward = jumps.select("file", F.col("run").alias("to"), F.col("to").alias("further"))
        jumps = freeze(jumps.join(onward, ["file", "to"]).select("file", "run", F.col("further").alias("to")), "warc-jumps")
    else:
        raise ValueError(f"chains are longer than 2**{max_rounds} runs")
    entries = edges.join(reached, ["file", "run"]).where("to IS NOT NULL").select("file", F.col("to").alias("run"), "entry")
    entries = entries.union(reached.where("run = 0").select("file", "run", F.lit(0).cast("bigint").alias("entry")))
    entries = entries.groupBy("file", "run").agg(F.min("entry").alias("entry"))
    return runs.join(entries, ["file", "run"], "left").select(
        "file", "split", "seq", "offset", "next_offset", "file_bytes", "direct",
        F.coalesce(F.col("offset") >= F.col("entry"), F.lit(False)).alias("real"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``.

    file, offset, record_type, page_id, target_uri, payload_digest,
    payload_length, refers_to, payload (null for revisits).
    """
    pieces, cands = candidates(spark, path)
    marked = freeze(reachable(freeze(cands, "warc-candidates")), "warc-marked")
    # A direct record is one piece.  The others, and pieces no chain leads to, belong to records of several pieces.
    rare = marked.where("NOT direct OR NOT real")
    by_file = Window.partitionBy("file").orderBy("offset")
    owned = rare.withColumn("owner", F.last(F.when(F.col("real"), F.col("offset")), True).over(by_file)).withColumn(
        "owner_end", F.last(F.when(F.col("real"), F.col("next_offset")), True).over(by_file)
    )
    owned = owned.where("offset < owner_end").select("file", "split", "seq", "offset", "owner")
    skipped = freeze(
        rare.select("file", "split", "seq", "offset").join(owned.select("file", "offset", "owner"), ["file", "offset"], "left"), "warc-rare"
    )
    keys = ["file", "split", "seq"]
    whole = pieces.join(skipped.select(*keys), keys, "left_anti")
    # Pieces before a file's first magic are no record.
    whole = whole.where(F.col("value").contains(_END)).select("file", "split", "seq", F.lit(None).cast("bigint").alias("offset"), "value")
    parts = pieces.join(skipped.where("owner IS NOT NULL"), keys)
    built = parts.groupBy("file", F.col("owner").alias("offset")).agg(
        F.expr(f"array_join(transform(array_sort(collect_list(struct(offset, value))), x -> x.value), '{MAGIC}')").alias("value")
    )
    text = whole.select("file", "value").union(built.select("file", "value"))
    cut = text.withColumn("_head", F.substring_index("value", _END, 1)).withColumn(
        "_block", F.expr("substring(CAST(value AS BINARY), octet_length(_head) + 5, try_cast(regexp_extract(_head, "
                         "'(?is)(?:^|\\\\r\\\\n)content-length:[ \\\\t]*([0-9]{1,15})[ \\\\t]*(?:\\\\r\\\\n|$)', 1) AS INT))")
    ).withColumn("_http", F.substring_index(F.col("_block").cast("string"), _END, 1))
    complete = F.octet_length("_block") == F.regexp_extract("_head", r"(?is)(?:^|\r\n)content-length:[ \t]*([0-9]{1,15})", 1).try_cast("bigint")
    kind = _header("WARC-Type")
    return cut.where(complete).select(
        "file", kind.alias("record_type"), _header("X-Page-Id").try_cast("bigint").alias("page_id"), _header("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _header("X-Payload-Length").try_cast("bigint").alias("payload_length"),
        _header("X-Refers-To-Page").try_cast("bigint").alias("refers_to"),
        F.when(kind != "revisit", F.expr("substring(_block, octet_length(_http) + 5)")).alias("payload"),
    )


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = scratch_path(spark, "warc")
    write(records(pages, "page_id", "url", "html"), path)
    found = read(spark, path)
    return found.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("bigint"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )
