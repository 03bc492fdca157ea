"""Streaming jobs run over a bounded file source until it is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import schedule
from strata.session import workspace
from strata.streaming import events as streaming
from strata.streaming import feed as feeds
from strata.streaming import keyed
from strata.streaming.sinks import append_stream, drain, incremental_stream, merge_stream
from suite.operations import LOG, NOW_MS, SUBSCRIPTIONS, change_log
from suite.registry import load, registered
from suite.sources import fresh


def event_stream(spark, sf_dir):
    schema = load(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return files.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark, writer):
    drain(writer, workspace(spark, "stream"))


@registered(
    "stream_telemetry",
    """SELECT event_type AS stream, count(*) FILTER (value >= 5) AS accepted, count(*) FILTER (value < 5) AS rejected
    FROM events GROUP BY event_type""",
)
def stream_telemetry(spark, sf_dir):
    """Cumulative totals, restated by each micro-batch; small readings come unnamed."""
    points = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("stream"), F.when(F.col("value") >= 5, "reading").otherwise("").alias("name")
    )
    table = fresh(spark, "intake")
    drained(spark, merge_stream(streaming.intake_totals(points), "intake", table, ["stream"]))
    return table.read()


@registered("stream_dedup", "SELECT event_id, user_id, event_type, value FROM events")
def stream_dedup(spark, sf_dir):
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    first, again = (event_stream(spark, sf_dir).select(*columns) for _ in range(2))
    deliveries = first.unionByName(again.where("event_type IN ('click', 'purchase')"))
    table = fresh(spark, "deduplicated")
    drained(spark, append_stream(streaming.deduplicate(deliveries, "ts", "1 hour"), "deduplicated", table))
    return table.read().drop("ts")


@registered(
    "stream_routing",
    f"""SELECT event_id, tenant, s.event_type, action FROM events e
    JOIN (VALUES {", ".join(map(str, SUBSCRIPTIONS))}) AS s(tenant, event_type, action) ON s.event_type = e.event_type
    JOIN customer ON c_custkey = user_id AND c_mktsegment = tenant""",
)
def stream_routing(spark, sf_dir):
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tenant"))
    arriving = event_stream(spark, sf_dir).join(people, "user_id").select("event_id", "tenant", "event_type")
    subscriptions = spark.createDataFrame(SUBSCRIPTIONS, "tenant string, event_type string, action string")
    routed = streaming.route_events(arriving, subscriptions).select("event_id", "tenant", "event_type", "action")
    table = fresh(spark, "routed")
    drained(spark, append_stream(routed, "routed", table))
    return table.read()


@registered("stream_change_feed", f"WITH {LOG} SELECT * FROM log WHERE revision >= 100 AND starts_with(key, 'signup/')")
def stream_change_feed(spark, sf_dir):
    log = event_stream(spark, sf_dir).select(
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        (F.col("event_id") + 1).alias("revision"),
    )
    table = fresh(spark, "feed")
    drained(spark, append_stream(streaming.change_feed(log, "signup/", 100), "feed", table))
    return table.read()


@registered("stream_incremental_load", "SELECT event_id, user_id, event_type, value FROM events")
def stream_incremental_load(spark, sf_dir):
    feed = event_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    table = fresh(spark, "loaded")
    drained(spark, incremental_stream(feed, "loaded", table, ["event_id"], "ts"))
    return table.read().drop("ts")


FILE_ROWS = 1_000_000


def in_batches(spark, rows, batches: int, file_rows: int = FILE_ROWS):
    """A stream of which every micro-batch is the rows with the next ``batch``: as many
    files for each, of about ``file_rows`` rows in the largest one, some of them empty."""
    folder, staged, schema = workspace(spark, "feed"), workspace(spark, "dealt"), rows.drop("batch").schema
    rows.write.parquet(staged)
    dealt = spark.read.schema(rows.schema).parquet(staged)
    largest = max((n for _, n in dealt.groupBy("batch").count().collect()), default=0)
    files = max(1, -(-largest // file_rows))
    for batch in range(batches):
        one = dealt.where(F.col("batch") == batch).drop("batch")
        (one.repartition(files) if files > 1 else one.coalesce(1)).write.mode("append").parquet(folder)
        for _ in range(len(spark.read.schema(schema).parquet(folder).inputFiles()), files * (batch + 1)):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


@registered(
    "stream_event_order",
    """SELECT event_id, event_type AS partition_key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position
    FROM events""",
)
def stream_event_order(spark, sf_dir):
    """The events of a key come in three batches, dealt by hash, and go out in order."""
    events = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("partition_key"))
    sent = schedule.in_order(events, "event_id").select(
        "event_id", "partition_key", F.col("position").alias("number"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("batch")
    )
    ordered = keyed.in_order(in_batches(spark, sent, 3), "partition_key", "number")
    table = fresh(spark, "ordered")
    with keyed.keyed_state(spark):
        drained(spark, append_stream(ordered, "ordered", table))
    event_id = F.get_json_object("event", "$.event_id").cast("bigint")
    return table.read().select(event_id.alias("event_id"), "partition_key", "position")


@registered(
    "stream_due_triggers",
    f"""SELECT 't-' || event_id AS trigger_id, CAST({NOW_MS} AS BIGINT) AS fired_at_unix_ms, epoch_us(ts) // 1000 AS at_unix_ms,
    't-' || event_id || '#1' AS delivery_id FROM events t
    WHERE event_type IN ('click', 'view', 'signup') AND epoch_ms(ts) > 0 AND epoch_ms(ts) <= {NOW_MS}
      AND event_id NOT IN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type IN ('error', 'purchase'))""",
)
def stream_due_triggers(spark, sf_dir):
    """Triggers are set, some are cancelled, and then the clock moves on to now."""
    events = load(spark, sf_dir, "events")
    named = F.concat(F.lit("t-"), F.get_json_object("props", "$.k"))
    start, now = F.timestamp_millis(F.lit(1704067200000)), F.timestamp_millis(F.lit(NOW_MS))
    setting = events.where("event_type IN ('click', 'view', 'signup')").select(
        F.concat(F.lit("t-"), F.col("event_id").cast("string")).alias("trigger_id"), F.lit(keyed.SCHEDULE).alias("command"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_unix_ms"), F.col("event_id").alias("seq"), start.alias("time"), F.lit(0).alias("batch"),
    )
    stopping = events.where("event_type IN ('error', 'purchase')").select(
        named.alias("trigger_id"), F.lit(keyed.CANCEL).alias("command"), F.lit(None).cast("bigint").alias("at_unix_ms"),
        (F.col("event_id") + 10**12).alias("seq"), start.alias("time"), F.lit(1).alias("batch"),
    )
    clock = spark.range(1).select(
        F.lit("clock").alias("trigger_id"), F.lit(keyed.CLOCK).alias("command"), F.lit(None).cast("bigint").alias("at_unix_ms"),
        F.lit(0).cast("bigint").alias("seq"), now.alias("time"), F.lit(2).alias("batch"),
    )
    fired = keyed.fire(in_batches(spark, setting.union(stopping).union(clock), 3))
    table = fresh(spark, "fired")
    with keyed.keyed_state(spark):
        drained(spark, append_stream(fired, "fired", table))
    return table.read()


@registered("stream_change_source", f"WITH {LOG} SELECT * FROM log WHERE revision >= 100 AND starts_with(key, 'signup/')")
def stream_change_source(spark, sf_dir):
    """The feed of a log that grows: half of it, a stop, and the rest from there on."""
    feeds.install(spark)
    log, path, checkpoint = change_log(spark, sf_dir), workspace(spark, "log"), workspace(spark, "stream")
    table = fresh(spark, "feed")
    middle = log.agg(F.floor(F.max("revision") / 2)).first()[0]
    options = {"path": path, "prefix": "signup/", "fromRevision": "100"}
    for part in (log.where(F.col("revision") <= middle), log.where(F.col("revision") > middle)):
        feeds.write_changes(part, path, 20_000)
        stream = spark.readStream.format("change_feed").options(**options).load()
        drain(append_stream(stream, "feed", table), checkpoint)
    return table.read()


@registered("changelog_range", f"WITH {LOG} SELECT * FROM log WHERE revision > 50 AND revision <= 8000 AND starts_with(key, 'view/1')")
def changelog_range(spark, sf_dir):
    """The same log read as a batch; bounds and prefix go down into its files."""
    feeds.install(spark)
    path = workspace(spark, "log")
    feeds.write_changes(change_log(spark, sf_dir), path, 3_000)
    log = spark.read.format("change_feed").option("path", path).load()
    return log.where("revision > 50 AND revision <= 8000 AND startswith(key, 'view/1')")
