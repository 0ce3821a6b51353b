"""Metering views over the given tables, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed_values import DAY_MS, HOUR_MS, LOCAL_OFFSET_MS
from .functions.timeline import local_date

# Shift from the tables' dates onto the weeks around the price change.
SHIFT_MS = 80_006_400_000
# A +08:00 midnight: 2026-07-14T16:00Z.
BASE_MS = 1_784_044_800_000
WEEK_MS = 604_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _floor(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an epoch in milliseconds, read as UTC whatever the session zone is."""
    ts = F.col("ts")
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + (
        F.hour(ts) * 3_600 + F.minute(ts) * 60
    ).cast("bigint")
    millis = F.floor(F.date_part(F.lit("second"), ts) * 1000).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        k.alias("k"),
        (seconds * 1000 + millis + SHIFT_MS).alias("observed_at_ms"),
    )


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage facts: one per event, plus a replayed copy of every eleventh one."""
    e = events(spark, sf_dir)
    user, event = F.col("user_id"), F.col("event_id")
    session = F.concat(F.lit("s"), user)
    model = (
        F.when(F.col("event_type") == "click", F.lit("gpt-5.6-sol"))
        .when(F.col("event_type") == "view", F.lit("gpt-5.6-terra"))
        .when(F.col("event_type") == "purchase", F.lit("gpt-5.4-mini-2026"))
        .when(F.col("event_type") == "signup", F.lit("codex-auto-review"))
        .otherwise(F.lit("not-a-model"))
    )
    plan = (
        F.when(user % 5 == 0, F.lit("plus"))
        .when(user % 5 == 1, F.lit("team"))
        .when(user % 5 == 2, F.lit("pro"))
        .when(user % 5 == 3, F.lit("api"))
    )
    hour = _floor(F.col("observed_at_ms") + LOCAL_OFFSET_MS, HOUR_MS)
    inp = F.round(F.col("value") * 1000).cast("bigint")
    base = e.select(
        F.concat(F.lit("usage:"), event).alias("source_key"),
        "event_id",
        "observed_at_ms",
        session.alias("session_id"),
        F.when(user >= 50, F.concat(F.lit("s"), user - 50)).alias("parent_session_id"),
        F.when(user % 13 != 0, F.concat(F.lit("s"), user % 50)).alias("root_session_id"),
        F.when(event % 5 == 0, F.concat(session, F.lit(":"), hour))
        .when(event % 5 == 1, F.concat(F.lit("x"), event))
        .alias("turn_id"),
        F.when(user < 50, F.lit("main"))
        .when(user % 2 == 0, F.lit("child"))
        .otherwise(F.lit("fork"))
        .alias("relation"),
        model.alias("model"),
        F.when(event % 3 == 0, F.lit("fast"))
        .when(event % 3 == 1, F.lit("standard"))
        .alias("service_tier"),
        F.when(event % 2 == 0, F.lit("high")).alias("reasoning_effort"),
        F.when(user % 10 == 4, F.lit("pro")).alias("provider"),
        plan.alias("plan_type"),
        inp.alias("input_tokens"),
        _floor(inp * F.col("k"), 100).alias("cache_read_tokens"),
        F.when(event % 7 == 0, F.col("k")).otherwise(F.lit(0)).cast("bigint").alias(
            "cache_write_tokens"
        ),
        (F.col("k") * 10).alias("output_tokens"),
        (F.col("k") * 4).alias("reasoning_tokens"),
        (inp + F.col("k") * 10).alias("total_tokens"),
    )
    copies = base.filter(event % 11 == 0).withColumns(
        {
            "source_key": F.concat(F.lit("dup:"), event),
            "relation": F.lit("child"),
            "service_tier": F.lit("standard"),
            "reasoning_effort": F.lit("low"),
            "provider": F.lit(None).cast("string"),
        }
    )
    return base.unionByName(copies).drop("event_id")


def quota_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quota observation per event: a weekly sawtooth, a second limit or a secondary window."""
    e = events(spark, sf_dir)
    event = F.col("event_id")
    o = F.col("observed_at_ms") - BASE_MS
    week = _floor(o, WEEK_MS)
    place = event % 20
    rolling, secondary = (place >= 14) & (place < 17), place >= 17
    feed = ~secondary & (event % 2 == 0)
    limit = F.when(rolling, F.lit("rolling")).otherwise(F.lit("codex"))
    kind = F.when(secondary, F.lit("secondary")).otherwise(F.lit("primary"))
    percent = (
        F.when(rolling, F.lit(0))
        .when(secondary, F.when(_floor(o, DAY_MS) % 5 < 3, F.lit(97)).otherwise(F.lit(5)))
        .otherwise(_floor(F.pmod(o, F.lit(WEEK_MS)) * 100, WEEK_MS))
    )
    reset = F.when(rolling, F.col("observed_at_ms") + WEEK_MS).when(
        ~secondary, F.lit(BASE_MS) + (week + 1) * WEEK_MS
    )
    return e.select(
        F.concat_ws(":", limit, kind, event.cast("string")).alias("source_key"),
        F.col("observed_at_ms").alias("first_seen_at_ms"),
        F.col("observed_at_ms").alias("last_seen_at_ms"),
        F.lit("acct").alias("account_key"),
        limit.alias("limit_id"),
        kind.alias("window_kind"),
        percent.cast("double").alias("used_percent"),
        F.lit(10_080).cast("bigint").alias("window_minutes"),
        reset.cast("bigint").alias("resets_at_ms"),
        F.when(week % 2 == 0, F.lit("plus")).alias("plan_type"),
        F.when(feed, F.lit("app_server")).otherwise(F.lit("jsonl")).alias("source"),
        F.when(feed, F.lit(2)).otherwise(F.lit(1)).alias("priority"),
    )


def turn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn per session and hour; some have no end, some end before their last event."""
    hour = _floor(F.col("observed_at_ms") + LOCAL_OFFSET_MS, HOUR_MS)
    session = F.concat(F.lit("s"), F.col("user_id"))
    per_hour = (
        events(spark, sf_dir)
        .groupBy(session.alias("session_id"), hour.alias("hour"))
        .agg(
            F.min("observed_at_ms").alias("started_at_ms"),
            (F.min("observed_at_ms") + F.max("event_id") % 5 * 2_400_000).alias("ended_at_ms"),
        )
    )
    return per_hour.select(
        "session_id",
        F.concat("session_id", F.lit(":"), "hour").alias("turn_id"),
        "started_at_ms",
        F.when(F.col("hour") % 4 != 0, F.col("ended_at_ms")).alias("ended_at_ms"),
    )


def cumulative_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter snapshots per user that restart every thousand events and sometimes repeat."""
    from pyspark.sql import Window

    block = _floor(F.col("event_id"), 1000)
    inp = F.round(F.col("value") * 1000).cast("bigint")
    out = F.col("k") * 10
    w = Window.partitionBy("user_id", "block").orderBy("event_id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    snapshots = (
        events(spark, sf_dir)
        .select("event_id", "user_id", "observed_at_ms", block.alias("block"),
                inp.alias("inp"), out.alias("out"))
        .select(
            "user_id",
            "event_id",
            F.lit(0).alias("repeat"),
            "observed_at_ms",
            F.sum("inp").over(w).alias("cum_input"),
            F.sum("out").over(w).alias("cum_output"),
            F.when(F.col("event_id") % 2 == 0, F.col("inp")).alias("last_input"),
            F.when(F.col("event_id") % 2 == 0, F.col("out")).alias("last_output"),
        )
    )
    again = snapshots.filter(F.col("event_id") % 97 == 0).withColumns(
        {"repeat": F.lit(1), "observed_at_ms": F.col("observed_at_ms") + 1}
    )
    return snapshots.unionByName(again)


def session_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session facts: a title from the first message of the conversation of the same number."""
    titles = (
        table(spark, sf_dir, "conversations")
        .filter("turn = 0")
        .select("conv_id", F.col("text").alias("title"))
    )
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    user = F.col("user_id")
    return users.join(titles, users["user_id"] == titles["conv_id"], "left").select(
        F.concat(F.lit("s"), user).alias("session_id"),
        F.when(user >= 50, F.concat(F.lit("s"), user - 50)).alias("parent_session_id"),
        "title",
        F.when(user % 3 != 0, F.when(user < 50, F.lit("main")).otherwise(F.lit("child"))).alias(
            "relation"
        ),
    )


def account_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account-side daily tokens: a tenth more than seen locally, some days missing."""
    return (
        usage_raw(spark, sf_dir)
        .filter(F.col("source_key").startswith("usage:"))
        .groupBy(local_date(F.col("observed_at_ms")).alias("date"))
        .agg(F.sum("total_tokens").alias("total"))
        .filter(F.substring("date", 9, 2).cast("int") % 6 != 0)
        .select("date", F.round(F.col("total") * 1.1).cast("bigint").alias("tokens"))
    )


def external_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of an independent recomputation per scheme and speed."""
    per_day = (
        usage_raw(spark, sf_dir)
        .filter(F.col("source_key").startswith("usage:"))
        .groupBy(local_date(F.col("observed_at_ms")).alias("scope_key"))
        .agg(
            F.sum(F.col("input_tokens") - F.col("cache_read_tokens")).alias("input_tokens"),
            F.sum("cache_read_tokens").alias("cache_read_tokens"),
            F.sum("cache_write_tokens").alias("cache_write_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("reasoning_tokens").alias("reasoning_tokens"),
            F.sum("total_tokens").alias("total_tokens"),
        )
    )
    odd = F.substring("scope_key", 9, 2).cast("int") % 2
    runs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(scheme).alias("pricing_scheme"),
                    F.lit(speed).alias("speed"),
                    F.lit(at).cast("bigint").alias("run_at_ms"),
                )
                for scheme in ("subscription", "api")
                for speed in ("auto", "standard")
                for at in (1_786_000_000_000, 1_786_100_000_000)
            ]
        )
    )
    late = (F.col("run_at_ms") == 1_786_100_000_000).cast("bigint")
    amount = F.col("total_tokens") / F.lit(1000.0) + F.when(
        F.col("speed") == "auto", F.lit(1.5) * odd
    ).otherwise(F.lit(0.0))
    return (
        per_day.withColumn("run", runs)
        .select("*", "run.*")
        .select(
            F.lit("daily").alias("scope"),
            "scope_key",
            "pricing_scheme",
            "speed",
            "run_at_ms",
            "input_tokens",
            "cache_read_tokens",
            "cache_write_tokens",
            "output_tokens",
            "reasoning_tokens",
            (F.col("total_tokens") + odd * late + (1 - late) * 7).alias("total_tokens"),
            amount.alias("amount"),
            F.lit("ok").alias("status"),
        )
    )


def rollup_inputs(spark: SparkSession, sf_dir: str):
    """Everything a rebuild reads, over the given tables."""
    from .plans.rollup import Account, Inputs
    from .sources.catalogs import credit_catalog, default_capacities, usd_catalog

    return Inputs(
        usage=usage_raw(spark, sf_dir),
        turns=turn_raw(spark, sf_dir),
        sessions=session_raw(spark, sf_dir),
        quota=quota_raw(spark, sf_dir),
        account=Account(account_key="acct", auth_kind="chatgpt", plan_type="plus"),
        account_days=account_days(spark, sf_dir),
        capacities=default_capacities(spark),
        credit=credit_catalog(spark),
        usd=usd_catalog(spark),
    )


def _shaped(df: DataFrame, schema: str, known: dict[str, Column]) -> DataFrame:
    """``df`` as a fact table: given columns, else its own, else null."""
    cells = []
    for part in schema.split(", "):
        name, type_name = part.split()
        cells.append(known.get(name, F.col(name) if name in df.columns else F.lit(None)).cast(type_name).alias(name))
    return df.select(*cells)


def log_fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage, turns, sessions and the logs' quota rows as the log fact table."""
    from .schemas import SOURCE_JSONL

    at_start = {"kind": F.lit("turn"), "source_key": F.concat(F.lit("turn:"), "turn_id"), "observed_at_ms": F.col("started_at_ms")}
    named = {"kind": F.lit("session"), "source_key": F.concat(F.lit("session:"), "session_id"), "observed_at_ms": F.lit(0)}
    logged = quota_raw(spark, sf_dir).filter("source = 'jsonl'")
    return (
        _shaped(usage_raw(spark, sf_dir), SOURCE_JSONL, {"kind": F.lit("usage")})
        .unionByName(_shaped(turn_raw(spark, sf_dir), SOURCE_JSONL, at_start))
        .unionByName(_shaped(session_raw(spark, sf_dir), SOURCE_JSONL, named))
        .unionByName(_shaped(logged, SOURCE_JSONL, {"kind": F.lit("quota"), "observed_at_ms": F.col("first_seen_at_ms")}))
    )


def feed_fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's quota rows, the account and its daily tokens as the feed fact table."""
    from .schemas import SOURCE_APP_SERVER

    good = {"freshness": F.lit("settled"), "status": F.lit("ok"), "first_seen_at_ms": F.lit(5), "last_seen_at_ms": F.lit(5)}
    polled = quota_raw(spark, sf_dir).filter("source = 'app_server'")
    account = spark.range(1).select(
        F.lit("account").alias("source_key"), F.lit("acct").alias("account_key"), F.lit("chatgpt").alias("auth_kind"), F.lit("plus").alias("plan_type")
    )
    items = F.array_sort(F.collect_list(F.struct(F.col("date").alias("startDate"), "tokens")))
    days = account_days(spark, sf_dir).agg(F.to_json(items).alias("daily_tokens_json")).withColumn("source_key", F.lit("usage"))
    return (
        _shaped(polled, SOURCE_APP_SERVER, {"kind": F.lit("quota"), "freshness": F.lit("settled"), "status": F.lit("ok")})
        .unionByName(_shaped(account, SOURCE_APP_SERVER, {"kind": F.lit("account"), **good}))
        .unionByName(_shaped(days, SOURCE_APP_SERVER, {"kind": F.lit("usage"), **good}))
    )


def log_file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log file per user, some under a dated folder, some without a time."""
    user, last = F.col("user_id"), F.max("observed_at_ms")
    per_user = events(spark, sf_dir).groupBy("user_id").agg(
        last.alias("last_ms"), F.min("observed_at_ms").alias("first_ms"), F.count(F.lit(1)).alias("lines")
    )
    folder = F.when(user % 3 == 0, F.concat(F.lit("logs/"), local_date(F.col("first_ms")), F.lit("/"))).otherwise(F.lit("logs/"))
    return per_user.select(
        F.concat(folder, F.lit("s"), user, F.lit(".jsonl")).alias("path"), "user_id", "first_ms", "lines",
        F.when(user % 5 != 0, F.col("first_ms") + user * 3_600_000).alias("modified_ms"), (F.col("lines") * 100).alias("size"),
    )


# --- raw inputs derived from the tables ------------------------------------


def _rfc3339(ms: Column) -> Column:
    """UTC text of an instant, by integer arithmetic."""
    day = F.date_format(F.date_from_unix_date(_floor(ms, DAY_MS).cast("int")), "yyyy-MM-dd")
    rest = ms % DAY_MS

    def part(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    return F.concat(
        day,
        F.lit("T"),
        part(_floor(rest, HOUR_MS), 2),
        F.lit(":"),
        part(_floor(rest, 60_000) % 60, 2),
        F.lit(":"),
        part(_floor(rest, 1000) % 60, 2),
        F.lit("."),
        part(rest % 1000, 3),
        F.lit("Z"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON log lines, one file per user: session, turn, task and counter lines per event."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).select(
        "event_id",
        "user_id",
        "event_type",
        "k",
        "observed_at_ms",
        F.round(F.col("value") * 1000).cast("bigint").alias("inp"),
    )
    event, k = F.col("event_id"), F.col("k")
    block = _floor(event, 1000)
    running = Window.partitionBy("user_id", block).orderBy("event_id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    starts = e.groupBy("user_id").agg(F.min("event_id").alias("start_id"))
    e = e.withColumns(
        {
            "cum_in": F.sum("inp").over(running),
            "cum_out": F.sum(k * 10).over(running),
            "ts": _rfc3339(F.col("observed_at_ms")),
        }
    ).join(starts, "user_id")

    def envelope(kind: str, payload: Column) -> Column:
        return F.concat(
            F.lit('{"timestamp":"'), "ts", F.lit(f'","type":"{kind}","payload":{{'), payload, F.lit("}}")
        )

    own = F.concat(F.lit("s"), "user_id")
    other = F.when(event % 997 == 0, F.lit("b")).otherwise(F.lit(""))
    parent = F.when(
        F.col("user_id") >= 50,
        F.concat(F.lit(',"forked_from_id":"s'), F.col("user_id") - 50, F.lit('"')),
    ).otherwise(F.lit(""))
    session = F.when(
        (event == F.col("start_id")) | (event % 401 == 0) | (event % 997 == 0),
        envelope(
            "session_meta",
            F.concat(F.lit('"id":"'), own, other, F.lit('","model_provider":"openai"'), parent),
        ),
    )
    model = (
        F.when(F.col("event_type") == "click", F.lit("gpt-5.6-sol"))
        .when(F.col("event_type") == "view", F.lit("gpt-5.6-terra"))
        .otherwise(F.lit("codex-auto-review"))
    )
    tier = (
        F.when(event % 15 == 0, F.lit(""))
        .when(k % 3 == 0, F.lit(',"service_tier":"priority"'))
        .when(k % 3 == 1, F.lit(',"serviceTier":"Default"'))
        .otherwise(F.lit(',"service_tier":"other"'))
    )
    turn = F.when(
        event % 5 == 0,
        envelope(
            "turn_context",
            F.concat(
                F.lit('"turn_id":'),
                F.when(event % 10 == 0, F.concat(F.lit('"t'), event, F.lit('"'))).otherwise(
                    F.lit("null")
                ),
                F.lit(',"model":" '),
                model,
                F.lit('"'),
                F.when(k % 4 == 0, F.lit(',"effort":"high"')).otherwise(F.lit("")),
                tier,
            ),
        ),
    )
    task = (
        F.when(
            event % 7 == 0,
            envelope(
                "event_msg",
                F.concat(
                    F.lit('"type":"task_started","turnId":"k'),
                    event,
                    F.lit('"'),
                    F.when(
                        event % 2 == 0,
                        F.concat(
                            F.lit(',"started_at":'), _floor(F.col("observed_at_ms"), 1000) - 60
                        ),
                    ).otherwise(F.lit("")),
                ),
            ),
        )
        .when(event % 7 == 3, envelope("event_msg", F.lit('"type":"task_complete"')))
        .when(
            event % 7 == 5,
            envelope(
                "event_msg", F.concat(F.lit('"type":"turn_aborted","turn_id":"z'), event, F.lit('"'))
            ),
        )
    )

    def usage(name: str, inp: str, cached: Column, out: Column) -> Column:
        return F.concat(
            F.lit(f'"{name}":{{"input_tokens":'),
            inp,
            F.lit(',"cached_input_tokens":'),
            cached,
            F.lit(',"output_tokens":'),
            out,
            F.lit("}"),
        )

    last = F.when(
        event % 2 == 0, usage("last_token_usage", "inp", _floor(F.col("inp") * k, 100), k * 10)
    )
    total = F.when(event % 3 != 2, usage("total_token_usage", "cum_in", F.lit(0), F.col("cum_out")))
    limits = F.when(
        event % 20 == 0,
        F.concat(
            F.lit(',"rate_limits":{"plan_type":'),
            F.when(k % 2 == 0, F.lit('"plus"')).otherwise(F.lit('"pro"')),
            F.lit(',"limit_id":"codex","primary":{"used_percent":'),
            k,
            F.lit(',"window_minutes":10080,"resets_at":'),
            _floor(F.col("observed_at_ms"), WEEK_MS) * 604_800 + 604_800,
            F.lit('},"secondary":null}'),
        ),
    ).otherwise(F.lit(""))
    counter = envelope(
        "event_msg",
        F.concat(
            F.lit('"type":"token_count","info":{'), F.concat_ws(",", last, total), F.lit("}"), limits
        ),
    )
    noise = envelope("response_item", F.lit('"type":"message","content":"not a fact"'))
    return e.select(
        F.concat(own, F.lit(".jsonl")).alias("path"),
        F.lit("active").alias("state"),
        block.alias("block"),
        F.posexplode(F.array(session, turn, task, counter, noise)).alias("place", "value"),
        (event * 8).alias("base"),
    ).filter("value is not null").select(
        "path", "state", "block", (F.col("base") + F.col("place")).alias("line_no"), "value"
    )


def replay_raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Usage events per file with copied heads, and the file headers.

    A user from 50 on starts with three events of user - 50; a user divisible
    by seven starts with three events half a second apart that match nothing.
    """
    from pyspark.sql import Window

    user = F.col("user_id")
    rows = events(spark, sf_dir).select(
        "user_id",
        "event_id",
        "observed_at_ms",
        F.round(F.col("value") * 1000).cast("bigint").alias("input_tokens"),
        (F.col("k") * 10).alias("output_tokens"),
    )
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    heads = rows.withColumn("nth", nth).filter("nth <= 3")
    firsts = heads.groupBy("user_id").agg(F.min("observed_at_ms").alias("start_ms"))
    copies = heads.select(
        (user + 50).alias("user_id"), "nth", "input_tokens", "output_tokens"
    ).join(firsts, "user_id").filter(user % 7 != 0).select(
        "user_id",
        (F.col("nth") - 10).cast("bigint").alias("event_id"),
        (F.col("start_ms") - 100_000 + F.col("nth") * 5_000).alias("observed_at_ms"),
        "input_tokens",
        "output_tokens",
    )
    bursts = firsts.filter((user % 7 == 0) & (user >= 50)).select(
        "user_id", "start_ms", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("nth")
    ).select(
        "user_id",
        (F.col("nth") - 10).cast("bigint").alias("event_id"),
        (F.col("start_ms") - 100_000 + F.col("nth") * 500).alias("observed_at_ms"),
        (F.col("nth") + 900_000).cast("bigint").alias("input_tokens"),
        F.lit(1).cast("bigint").alias("output_tokens"),
    )
    path = F.concat(F.lit("s"), user, F.lit(".jsonl"))
    zero = F.lit(0).cast("bigint")
    usage = rows.unionByName(copies).unionByName(bursts).select(
        path.alias("path"),
        _floor(F.col("event_id") + 10, 1000).alias("block"),
        F.col("event_id").alias("line_no"),
        "observed_at_ms",
        "input_tokens",
        zero.alias("cache_read_tokens"),
        zero.alias("cache_write_tokens"),
        "output_tokens",
        zero.alias("reasoning_tokens"),
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
    )
    headers = rows.groupBy("user_id").agg(F.max("observed_at_ms").alias("last_ms")).select(
        path.alias("path"),
        F.concat(F.lit("s"), user).alias("session_id"),
        F.when(user >= 50, F.concat(F.lit("s"), user - 50)).alias("parent_session_id"),
        F.when(user % 2 == 0, F.col("last_ms")).alias("forked_at_ms"),
    )
    return usage, headers


def feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of an account feed: account, quota in four shapes, usage, and some errors."""
    e = events(spark, sf_dir)
    event, k = F.col("event_id"), F.col("k")
    account = F.concat(
        F.lit('{"result":{"account":{"type":"chatgpt","email":" User'),
        F.col("user_id") % 3,
        F.lit('@Example.com","planType":"'),
        F.when(F.col("user_id") % 2 == 0, F.lit("plus")).otherwise(F.lit("pro")),
        F.lit('"}}}'),
    )
    body = F.concat(
        F.lit('"primary":{"usedPercent":'),
        k,
        F.lit(',"windowMinutes":10080,"resetsAt":'),
        _floor(F.col("observed_at_ms"), 1000) + 3_600,
        F.lit('},"secondary":{"used_percent":null}'),
    )
    named = F.concat(F.lit('{"limitId":"codex","planType":"team",'), body, F.lit("}"))
    bare = F.concat(F.lit("{"), body, F.lit("}"))
    limits = (
        F.when(
            k % 4 == 0,
            F.concat(
                F.lit('"rateLimits":'), named, F.lit(',"rateLimitsByLimitId":{"codex":'), bare,
                F.lit(',"spark":'), bare, F.lit("}")
            ),
        )
        .when(k % 4 == 1, F.concat(F.lit('"rateLimits":['), named, F.lit(","), bare, F.lit("]")))
        .when(k % 4 == 2, F.concat(F.lit('"rateLimits":'), named))
        .otherwise(F.concat(F.lit('"rate_limits":{"weekly":'), bare, F.lit("}")))
    )
    day = local_date(F.col("observed_at_ms"))
    usage = F.concat(
        F.lit('{"result":{"lifetimeTokens":'),
        event,
        F.lit(',"dailyUsageBuckets":[{"startDate":"'),
        day,
        F.lit('","tokens":'),
        event * 100 + k,
        F.lit(',"email":"x@example.com"},{"date":"2026-07-01","totalTokens":'),
        event,
        F.lit("}]}}"),
    )
    error = F.when(event % 350 == 0, F.lit('{"error":{"code":1,"message":"no"}}'))
    quota = F.concat(F.lit('{"result":{'), limits, F.lit("}}"))
    return e.select(
        event.alias("poll_id"),
        F.posexplode(F.array(account, quota, usage, error)).alias("msg_no", "value"),
        F.col("observed_at_ms").alias("polled_at_ms"),
    ).filter("value is not null")


def external_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run results as JSON documents: days of each run, and one run without any."""
    row = F.struct(
        F.col("scope_key").alias("date"),
        F.col("input_tokens").alias("inputTokens"),
        F.col("cache_read_tokens").alias("cacheReadTokens"),
        F.col("total_tokens").alias("totalTokens"),
        F.col("amount").alias("costUSD"),
    )
    runs = (
        external_raw(spark, sf_dir)
        .groupBy("pricing_scheme", "speed", "run_at_ms")
        .agg(F.array_sort(F.collect_list(row)).alias("daily"))
        .select(
            F.lit("daily").alias("scope"),
            "pricing_scheme",
            "speed",
            (F.col("run_at_ms") - 1000).alias("started_at_ms"),
            F.col("run_at_ms").alias("finished_at_ms"),
            F.lit("1.0").alias("version"),
            F.lit("ok").alias("status"),
            F.to_json(F.struct("daily")).alias("data"),
        )
    )
    failed = runs.filter("speed = 'auto'").withColumns(
        {"scope": F.lit("session"), "status": F.lit("failed"), "data": F.lit("{}")}
    )
    return runs.unionByName(failed)


def log_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log facts with many rows per key and gaps in their columns, in ``seq`` order."""
    from .schemas import SOURCE_JSONL

    e = events(spark, sf_dir)
    event, k = F.col("event_id"), F.col("k")
    quota = event % 4 == 0
    known = {
        "source_key": F.concat(F.lit("k"), event % 997),
        "kind": F.when(event % 997 % 4 == 0, F.lit("quota")).otherwise(F.lit("usage")),
        "observed_at_ms": F.col("observed_at_ms"),
        "last_seen_at_ms": F.when(event % 3 == 0, F.col("observed_at_ms") + k * 1000),
        "session_id": F.when(event % 5 != 0, F.concat(F.lit("s"), F.col("user_id"))),
        "model": F.when(event % 7 == 0, F.col("event_type")),
        "plan_type": F.when(k % 3 == 0, F.lit("plus")).when(k % 3 == 1, F.lit("pro")),
        "total_tokens": F.when(event % 2 == 0, k),
        "used_percent": F.when(quota, k.cast("double")),
        "title": F.when(event % 11 == 0, F.concat(F.lit("t"), event)),
    }
    cells = []
    for part in SOURCE_JSONL.split(", "):
        name, type_name = part.split()
        cells.append(known.get(name, F.lit(None)).cast(type_name).alias(name))
    return e.select(event.alias("seq"), *cells)
