"""Secrets in text, with weak candidates kept only where their complement is near.

Plain findings are assignments, access ids and long hex runs.  Weak candidates
are identifiers, keys and endpoints that alone would be noise.  Every finding is
a part with a span; a scope is a part's span widened by ``SCOPE`` code points on
either side.  An interval join within the text tells which classes of part meet a
candidate's scope:

* a weak identifier is reported if a secret part (plain or weak) is in scope;
* a weak key is reported if an identifier or an endpoint is in scope;
* an endpoint is reported if both an identifier and a secret part are in scope.

The join works on blocks of ``SCOPE`` code points and keeps one row per block and
class (least start, greatest end), so a block with thousands of parts gives three
rows and never all pairs.  Everything runs as SQL expressions in the JVM.

Nulls and empty texts have no spans; repeated rows are scanned one by one; extra
columns of the input are not used.  A weak span that overlaps a plain one is
dropped, plain ones always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, freeze

#: Fixed patterns of the plain findings.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak candidates.
WEAK_ID = (
    r"""A[A-Z]IA[A-Z0-9]{12,}|(?:client_id|account_id|access_key|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
)
WEAK_KEY = r"""(?:pwd|pass|auth|credential|signature|client_secret)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|[A-Za-z0-9+/]{36,}={0,2}"""
ENDPOINT = r"""(?:https?|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:-]{3,}"""
KINDS = ["assign", "access", "hex", "weak_id", "weak_key", "endpoint"]
_PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_KEY, ENDPOINT], strict=True))
SCOPE = 256
_PART = "array<struct<s:int,e:int,k:int,n:int>>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_spans(text: str, kind: str) -> Column:
    """Spans of ``kind``, leftmost and not overlapping, in code points.

    The text between matches comes from ``split`` and the matches from
    ``regexp_extract_all``; running lengths give the places.  Only texts with a
    match are taken apart.
    """
    pattern, code = _sql(_PATTERNS[kind]), KINDS.index(kind)
    value = f"regexp_extract_all({text}, {pattern}, 2)" if kind == "assign" else f"regexp_extract_all({text}, {pattern}, 0)"
    return F.expr(f"""CASE WHEN {text} RLIKE {pattern} THEN
        aggregate(
          arrays_zip(split({text}, {pattern}), regexp_extract_all({text}, {pattern}, 0), {value}),
          named_struct('at', 0, 'out', CAST(array() AS {_PART})),
          (a, x) -> IF(x['1'] IS NULL, a, named_struct(
            'at', a.at + char_length(x['0']) + char_length(x['1']),
            'out', concat(a.out, array(named_struct('s', a.at + char_length(x['0']),
                'e', a.at + char_length(x['0']) + char_length(x['1']), 'k', {code}, 'n', char_length(x['2'])))))),
          a -> a.out)
      ELSE CAST(array() AS {_PART}) END""")


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with ``plain`` and ``weak``: arrays of spans (s, e, k, n), each sorted."""
    found = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = found.select(*docs.columns, *[find_spans("_t", k).alias(f"_{k}") for k in KINDS])
    return found.select(
        *[c for c in docs.columns if c != "text"],
        F.expr("array_sort(concat(filter(_assign, x -> x.n >= 12), _access, _hex), "
               "(l, r) -> CASE WHEN l.s != r.s THEN l.s - r.s ELSE l.k - r.k END)").alias("plain"),
        F.expr("concat(_weak_id, _weak_key, _endpoint)").alias("weak"),
    )


def _class_of(kind: str) -> Column:
    """i: identifier, s: secret part, e: endpoint."""
    return F.expr(f"CASE {kind} WHEN 1 THEN 'i' WHEN 3 THEN 'i' WHEN 5 THEN 'e' ELSE 's' END")


def link(scanned: DataFrame, row: str = "_row", scope: int = SCOPE) -> DataFrame:
    """(row, linked): the weak spans of each row of ``scanned`` that have their complement in scope.

    ``scanned`` must be frozen and ``row`` unique.  Rows without weak spans take no part.
    """
    some = scanned.where(F.size("weak") > 0)
    plain = some.select(row, F.explode("plain").alias("p"))
    # Candidates that a plain finding covers are that finding, not a second part.  A plain span has 16
    # characters or more, so few lie in a block, whatever the text holds.
    reach = F.expr(f"sequence(p.s DIV {scope}, (p.e - 1) DIV {scope})")
    covers = plain.select(row, "p", F.explode(reach).alias("block")).groupBy(row, "block").agg(F.collect_list("p").alias("plain_here"))
    candidates = some.select(row, F.explode("weak").alias("p"))
    touched = candidates.select(row, "p", F.explode(reach).alias("block")).join(covers, [row, "block"], "left")
    covered = F.coalesce(F.exists("plain_here", lambda x: (x["s"] < F.col("p.e")) & (F.col("p.s") < x["e"])), F.lit(False))
    weak = touched.groupBy(row, "p").agg(F.bool_or(covered).alias("covered")).where("NOT covered").select(
        row, "p", _class_of("p.k").alias("c"), F.expr(f"p.s DIV {scope}").alias("first"), F.expr(f"(p.e - 1) DIV {scope}").alias("last")
    )
    weak = freeze(weak, "secret-weak")
    sound = plain.unionByName(weak.select(row, "p"))
    blocks = (
        sound.select(row, _class_of("p.k").alias("c"), "p", F.explode(F.expr(f"sequence(p.s DIV {scope}, (p.e - 1) DIV {scope})")).alias("block"))
        .groupBy(row, "block")
        .agg(*[f(F.when(F.col("c") == c, F.col(f"p.{x}"))).alias(f"{c}_{x}") for c in "ise" for x, f in (("s", F.min), ("e", F.max))])
    )
    asked = weak.select("*", F.explode(F.expr("sequence(first - 1, last + 1)")).alias("block"))
    near = asked.join(blocks, [row, "block"])
    meets = [
        F.max(F.expr(f"coalesce({c}_e + {scope} >= p.s AND {c}_s <= p.e + {scope}, false)")).alias(f"has_{c}") for c in "ise"
    ]
    kept = near.groupBy(row, "p", "c").agg(*meets).where(
        "(c = 'i' AND has_s) OR (c = 's' AND (has_i OR has_e)) OR (c = 'e' AND has_i AND has_s)"
    )
    return kept.groupBy(row).agg(F.collect_list("p").alias("linked"))


def all_spans(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``docs`` without text, with plain spans and all spans in order; ``row`` names a unique column if there is one."""
    scanned = scan(docs)
    if row is None:
        row, scanned = "_row", scanned.withColumn("_row", F.monotonically_increasing_id())
    scanned = freeze(scanned, "secret-spans")
    linked = link(scanned, row)
    return scanned.join(linked, row, "left").select(
        *[scanned[c] for c in scanned.columns],
        F.expr(f"""array_sort(concat(plain, coalesce(linked, CAST(array() AS {_PART}))),
            (l, r) -> CASE WHEN l.s != r.s THEN l.s - r.s ELSE l.k - r.k END)""").alias("spans"),
    )


def joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({names}, x.k + 1), ':', x.s, ':', x.e)), ',')")


def redact(text: str, spans: str, mark: str = "[secret]") -> Column:
    """``text`` with every stretch that spans cover replaced by ``mark``; overlapping spans give one mark."""
    merged = f"""aggregate({spans}, CAST(array() AS array<struct<s:int,e:int>>), (a, x) ->
        IF(size(a) > 0 AND x.s <= element_at(a, -1).e,
           concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e)))),
           concat(a, array(named_struct('s', x.s, 'e', x.e)))))"""
    return F.expr(f"""CASE WHEN size({spans}) = 0 OR {text} IS NULL THEN {text} ELSE
        aggregate({merged}, named_struct('at', 0, 'out', CAST(array() AS array<string>)),
          (a, x) -> named_struct('at', x.e, 'out', concat(a.out, array(substring({text}, a.at + 1, x.s - a.at), {_sql(mark)}))),
          a -> concat(array_join(a.out, ''), substring({text}, a.at + 1))) END""")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    spans = all_spans(documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda k: F.expr(f"CAST(size(filter(plain, x -> x.k = {k})) AS BIGINT)")
    return spans.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(joined("plain").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
    )
