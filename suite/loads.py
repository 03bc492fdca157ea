"""Load strategies, models and quality reports over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import history, search
from strata.plans import strategies
from strata.plans.models import MEDALLION, run_models
from strata.plans.quality import WARN, assertion, not_null, report, unique
from strata.session import workspace
from strata.sources.versioned import VersionedTable
from suite.registry import load, registered
from suite.sources import fresh

KEY, TRACKED = ["c_custkey"], ["c_name", "c_mktsegment"]


def customers(spark, sf_dir):
    """The first day's customers."""
    return load(spark, sf_dir, "customer").select(*KEY, *TRACKED)


def customers_later(spark, sf_dir):
    """The next day: customers in debt have left, big buyers moved to a segment of
    their own, and rich ones in BUILDING have opened a second account."""
    everyone = load(spark, sf_dir, "customer")
    spent = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent")
    )
    stayed = everyone.where("c_acctbal >= 0").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    segment = F.when(F.col("spent") > 3_000_000, "PREMIUM").otherwise(F.col("c_mktsegment"))
    moved = stayed.select("c_custkey", "c_name", segment.alias("c_mktsegment"))
    second = everyone.where("c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
    opened = second.select((-F.col("c_custkey") - 1).alias("c_custkey"), "c_name", "c_mktsegment")
    return moved.unionByName(opened)


DAYS = """day1 AS (SELECT c_custkey, c_name, c_mktsegment FROM customer),
spent AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY o_custkey),
day2 AS (SELECT c_custkey, c_name, CASE WHEN spent > 3000000 THEN 'PREMIUM' ELSE c_mktsegment END AS c_mktsegment
         FROM customer LEFT JOIN spent ON c_custkey = o_custkey WHERE c_acctbal >= 0
         UNION ALL SELECT -c_custkey - 1, c_name, c_mktsegment FROM customer
         WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)"""

HISTORY = f"""{DAYS},
paired AS (SELECT a.c_custkey AS old_key, a.c_name AS old_name, a.c_mktsegment AS old_segment,
                  b.c_custkey AS new_key, b.c_name AS new_name, b.c_mktsegment AS new_segment,
                  a.c_name IS NOT DISTINCT FROM b.c_name AND a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment AS same
           FROM day1 a FULL OUTER JOIN day2 b ON a.c_custkey = b.c_custkey),
history AS (SELECT old_key AS c_custkey, old_name AS c_name, old_segment AS c_mktsegment, '2026-01-01' AS effective_from,
                   CASE WHEN new_key IS NOT NULL AND same THEN '' ELSE '2026-02-01' END AS effective_to,
                   new_key IS NOT NULL AND same AS is_current
            FROM paired WHERE old_key IS NOT NULL
            UNION ALL SELECT new_key, new_name, new_segment, '2026-02-01', '', true
            FROM paired WHERE new_key IS NOT NULL AND (old_key IS NULL OR NOT same))"""


def customer_history(spark, sf_dir) -> VersionedTable:
    table = strategies.scd2_table(spark, workspace(spark, "history"), "customers_history")
    strategies.scd2(table, customers(spark, sf_dir), KEY, TRACKED, "2026-01-01")
    strategies.scd2(table, customers_later(spark, sf_dir), KEY, TRACKED, "2026-02-01")
    return table


@registered("scd2_two_runs", f"WITH {HISTORY} SELECT * FROM history")
def scd2_two_runs(spark, sf_dir):
    return customer_history(spark, sf_dir).read()


@registered(
    "scd2_as_of",
    f"""WITH {HISTORY} SELECT c_custkey, c_name, c_mktsegment FROM history
    WHERE effective_from <= '2026-01-15' AND (effective_to = '' OR effective_to > '2026-01-15')""",
)
def scd2_as_of(spark, sf_dir):
    return strategies.scd2_as_of(customer_history(spark, sf_dir), "2026-01-15").select(*KEY, *TRACKED)


@registered(
    "snapshot_diff",
    f"""WITH {HISTORY} SELECT coalesce(new_key, old_key) AS c_custkey,
    CASE WHEN old_key IS NULL THEN 'new' WHEN new_key IS NULL THEN 'deleted'
         WHEN same THEN 'unchanged' ELSE 'changed' END AS change,
    old_name AS old_c_name, old_segment AS old_c_mktsegment,
    new_name AS new_c_name, new_segment AS new_c_mktsegment FROM paired""",
)
def snapshot_diff(spark, sf_dir):
    return history.snapshot_diff(customers(spark, sf_dir), customers_later(spark, sf_dir), KEY, TRACKED)


@registered(
    "soft_delete",
    f"""WITH {DAYS} SELECT *, false AS is_deleted FROM day2 UNION ALL
    SELECT *, true FROM day1 a WHERE NOT EXISTS (SELECT 1 FROM day2 b WHERE a.c_custkey = b.c_custkey)""",
)
def soft_delete(spark, sf_dir):
    table = fresh(spark, "soft_delete")
    strategies.soft_delete(table, customers(spark, sf_dir), KEY, run_id="day1")
    strategies.soft_delete(table, customers_later(spark, sf_dir), KEY, run_id="day2")
    return table.read()


@registered(
    "snapshot_load",
    f"""WITH {DAYS} SELECT *, '2026-01-01' AS snapshot_ts FROM day1 UNION ALL SELECT *, '2026-02-01' FROM day2""",
)
def snapshot_load(spark, sf_dir):
    table = fresh(spark, "snapshot")
    strategies.snapshot(table, customers(spark, sf_dir), "2026-01-01", key="day1")
    strategies.snapshot(table, customers_later(spark, sf_dir), "2026-02-01", key="day2")
    return table.read()


@registered(
    "full_refresh_summary",
    """SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders GROUP BY o_orderstatus""",
)
def full_refresh_summary(spark, sf_dir):
    sql = """SELECT o_orderstatus, count(*) AS orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderstatus"""
    table = fresh(spark, "summary")
    for _ in range(2):  # the second run is a replay
        strategies.full_refresh(table, sql, {"orders": load(spark, sf_dir, "orders")}, run_id="run-1")
    return table.read()


@registered("incremental_load", "SELECT event_id, user_id, event_type, value FROM events")
def incremental_load(spark, sf_dir):
    """The feed as it stood in mid-month, then the whole feed."""
    feed = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    table = fresh(spark, "incremental")
    strategies.incremental(table, feed.where("ts < timestamp_ntz'2024-01-15'"), ["event_id"], "ts", key="run-1")
    strategies.incremental(table, feed, ["event_id"], "ts", key="run-2")
    return table.read().drop("ts")


@registered(
    "incremental_load_disorder",
    """SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts, user_id, event_type,
    CASE WHEN event_id % 7 = 0 AND event_id % 50 <> 0 THEN value + 1 ELSE value END AS value FROM events""",
)
def incremental_load_disorder(spark, sf_dir):
    """The later half of the feed first; some rows without a mark; rows that come again
    under the same mark, changed or not, and stale ones that must not replace them."""
    feed = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    feed = feed.withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    changed = feed.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    stale = feed.where("event_id % 50 <> 0").withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 DAY")).withColumn("value", F.lit(-1.0))
    middle = "ts >= timestamp_ntz'2024-01-15'"
    table = fresh(spark, "disorder")
    parts = (feed.where(middle), feed.where(f"NOT coalesce({middle}, false)"), changed.where("event_id % 50 <> 0"), stale, feed.where("ts IS NULL"))
    for run, part in enumerate(parts):
        strategies.incremental(table, part, ["event_id"], "ts", key=f"run-{run}")
    return table.read()


@registered(
    "as_of_join",
    """WITH v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS since, max(o_orderpriority) AS priority FROM orders
               WHERE o_orderstatus = 'F' GROUP BY ALL),
    f AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT f.o_orderkey, f.o_custkey, f.day, v.priority FROM f ASOF LEFT JOIN v ON f.o_custkey = v.o_custkey AND f.day >= v.since""",
)
def as_of_join(spark, sf_dir):
    """Every order with the priority its customer's last filled order had by then."""
    orders = load(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    versions = orders.where("o_orderstatus = 'F'").groupBy("o_custkey", F.col("day").alias("since")).agg(
        F.max("o_orderpriority").alias("priority")
    )
    return history.as_of_join(orders.select("o_orderkey", "o_custkey", "day"), versions, ["o_custkey"], "day", "since", ["priority"])


@registered(
    "as_of_join_times",
    """WITH v AS (SELECT event_type, CAST(ts AS DATE) AS since, max(value) AS high FROM events WHERE event_type <> 'view' GROUP BY ALL)
    SELECT e.event_id, e.event_type, v.since AS since, v.high FROM events e ASOF LEFT JOIN v ON e.event_type = v.event_type AND e.ts >= v.since""",
)
def as_of_join_times(spark, sf_dir):
    """Facts at times, versions by date, five keys in blocks of 700 rows."""
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    versions = events.where("event_type <> 'view'").groupBy("event_type", F.col("ts").cast("date").alias("since")).agg(F.max("value").alias("high"))
    known = versions.withColumn("day", F.col("since"))
    joined = history.as_of_join(events.select("event_id", "event_type", "ts"), known, ["event_type"], "ts", "day", ["since", "high"], block_rows=700)
    return joined.drop("ts")


@registered(
    "as_of_join_history",
    f"""WITH {HISTORY}, f AS (SELECT o_orderkey, o_custkey AS c_custkey,
      TIMESTAMP '2025-12-20' + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS placed FROM orders)
    SELECT f.o_orderkey, f.c_custkey, h.c_mktsegment FROM f ASOF LEFT JOIN
      (SELECT c_custkey, CAST(effective_from AS TIMESTAMP) AS since, c_mktsegment,
              CAST(nullif(effective_to, '') AS TIMESTAMP) AS till FROM history
       UNION ALL SELECT c_custkey, CAST(effective_to AS TIMESTAMP), NULL, NULL FROM history h1 WHERE effective_to <> ''
         AND NOT EXISTS (SELECT 1 FROM history h2 WHERE h2.c_custkey = h1.c_custkey AND h2.effective_from = h1.effective_to)) AS h
    ON f.c_custkey = h.c_custkey AND f.placed >= h.since""",
)
def as_of_join_history(spark, sf_dir):
    """Orders with the segment their customer had then, from a history table as the
    load keeps it: text dates, "" for open versions."""
    orders = load(spark, sf_dir, "orders")
    placed = F.expr("timestamp'2025-12-20' + make_dt_interval(cast(o_orderkey % 60 AS int))")
    facts = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), placed.alias("placed"))
    versions = customer_history(spark, sf_dir).read()
    joined = history.as_of_join(facts, versions, KEY, "placed", "effective_from", ["c_mktsegment"], until="effective_to")
    return joined.drop("placed")


# -- medallion -----------------------------------------------------------------

LANDING_SQL = """landing AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_totalprice >= 20000 THEN 'c' || o_custkey END AS customer,
         o_orderpriority AS product, CASE WHEN o_totalprice <= 480000 THEN o_totalprice END AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'Completed' ELSE 'PENDING' END AS status,
         o_orderdate AS order_date FROM orders),
bronze AS (SELECT * FROM landing UNION ALL SELECT * FROM landing WHERE product = '1-URGENT')"""
SILVER_SQL = """silver AS (SELECT DISTINCT order_id, customer, product, amount, lower(status) AS status,
  CAST(CAST(order_date AS DATE) AS VARCHAR) AS order_date FROM bronze
  WHERE order_id IS NOT NULL AND customer IS NOT NULL AND amount IS NOT NULL AND lower(status) = 'completed')"""


def landing_orders(spark, sf_dir):
    """Raw orders with mixed-case states, gaps, and urgent orders sent twice."""
    orders = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "CASE WHEN o_totalprice >= 20000 THEN 'c' || o_custkey END AS customer",
        "o_orderpriority AS product",
        "CASE WHEN o_totalprice <= 480000 THEN o_totalprice END AS amount",
        "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'Completed' ELSE 'PENDING' END AS status",
        "o_orderdate AS order_date",
    )
    return orders.unionByName(orders.where("product = '1-URGENT'"))


def medallion(spark, sf_dir):
    return run_models(spark, workspace(spark, "medallion"), MEDALLION, {"landing_orders": landing_orders(spark, sf_dir)})


def day_text(frame):
    return frame.withColumn("order_date", F.col("order_date").cast("string"))


@registered("silver_clean", f"WITH {LANDING_SQL}, {SILVER_SQL} SELECT * FROM silver")
def silver_clean(spark, sf_dir):
    return day_text(medallion(spark, sf_dir)["silver_orders"].read())


@registered(
    "gold_daily_revenue",
    f"""WITH {LANDING_SQL}, {SILVER_SQL} SELECT order_date, count(*) AS orders,
    CAST(round(sum(CAST(amount AS DECIMAL(18,2))), 2) AS DOUBLE) AS revenue FROM silver GROUP BY order_date""",
)
def gold_daily_revenue(spark, sf_dir):
    return day_text(medallion(spark, sf_dir)["gold_daily_revenue"].read())


@registered(
    "quality_report",
    f"""WITH {LANDING_SQL}, report AS (
    SELECT 'not_null_customer' AS test, 'error' AS severity, count(*) AS violations FROM bronze WHERE customer IS NULL
    UNION ALL SELECT 'not_null_amount', 'warn', count(*) FROM bronze WHERE amount IS NULL
    UNION ALL SELECT 'not_null_order_id', 'error', count(*) FROM bronze WHERE order_id IS NULL
    UNION ALL SELECT 'unique_order_id', 'error', count(*) FROM
      (SELECT order_id FROM bronze WHERE order_id IS NOT NULL GROUP BY order_id HAVING count(*) > 1)
    UNION ALL SELECT 'known_status', 'error', count(*) FROM bronze WHERE lower(status) NOT IN ('completed', 'pending'))
    SELECT test, severity, violations, violations = 0 AS passed FROM report""",
)
def quality_report(spark, sf_dir):
    return report(
        landing_orders(spark, sf_dir),
        [
            not_null("customer"),
            not_null("amount", WARN),
            not_null("order_id"),
            unique("order_id"),
            assertion("known_status", lambda rows: rows.where("lower(status) NOT IN ('completed', 'pending')")),
        ],
    )


# -- text vectors ----------------------------------------------------------------


def weights_sql(table: str, key: str) -> str:
    """(key, bucket, weight) of a table's texts."""
    return f"""SELECT {key}, bucket, CAST(sum(sign) AS INTEGER) AS weight FROM (
      SELECT {key}, CAST('0x' || substr(digest, 7, 2) AS INTEGER) AS bucket,
             CASE WHEN CAST('0x' || substr(digest, 10, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign
      FROM (SELECT {key}, sha256(token) AS digest FROM (
        SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {table})))
    GROUP BY {key}, bucket HAVING sum(sign) <> 0"""


@registered("embed_hash256", weights_sql("documents", "doc_id"))
def embed_hash256(spark, sf_dir):
    return search.bucket_weights(load(spark, sf_dir, "documents"), "doc_id", "text")


@registered(
    "semantic_search",
    f"""WITH d AS ({weights_sql("documents", "doc_id")}), q AS ({weights_sql("benchmark", "item_id")}),
    dn AS (SELECT doc_id, sum(weight * weight) AS sq FROM d GROUP BY doc_id),
    qn AS (SELECT item_id, sum(weight * weight) AS sq FROM q GROUP BY item_id),
    dots AS (SELECT item_id, doc_id, sum(q.weight * d.weight) AS dot FROM q JOIN d USING (bucket) GROUP BY item_id, doc_id),
    scored AS (SELECT b.item_id, t.doc_id, coalesce(CAST(dot AS DOUBLE) /
                 sqrt(CAST(qn.sq AS DOUBLE) * CAST(dn.sq AS DOUBLE)), 0.0) AS score
               FROM benchmark b CROSS JOIN documents t
               LEFT JOIN qn ON qn.item_id = b.item_id LEFT JOIN dn ON dn.doc_id = t.doc_id
               LEFT JOIN dots ON dots.item_id = b.item_id AND dots.doc_id = t.doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
    SELECT item_id, doc_id, round(score, 9) AS score, rank FROM ranked WHERE rank <= 5""",
)
def semantic_search(spark, sf_dir):
    found = search.nearest_texts(
        load(spark, sf_dir, "benchmark"), "item_id", "text", load(spark, sf_dir, "documents"), "doc_id", "text", k=5
    )
    return found.select("item_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@registered(
    "incremental_embed",
    f"""WITH d AS ({weights_sql("documents", "doc_id")}),
    dn AS (SELECT doc_id, sum(weight * weight) AS sq FROM d GROUP BY doc_id)
    SELECT t.doc_id, t.lang, bucket, round(CAST(CAST(weight / sqrt(CAST(sq AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) AS value
    FROM documents t LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN dn ON dn.doc_id = t.doc_id""",
)
def incremental_embed(spark, sf_dir):
    """Documents up to the middle of the feed, then all; only new ones are embedded."""
    feed = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    middle = feed.agg(F.max("doc_id")).first()[0] // 2
    table = fresh(spark, "embedded")
    for run, part in (("run-1", feed.where(F.col("doc_id") <= middle)), ("run-2", feed)):
        strategies.incremental_embed(table, part, ["doc_id"], "text", "doc_id", key=run)
    nonzero = F.filter(
        F.transform("embedding", lambda v, b: F.struct(b.alias("bucket"), v.alias("value"))), lambda e: e["value"] != 0
    )
    entries = table.read().select("doc_id", "lang", F.explode_outer(nonzero).alias("entry"))
    return entries.select(
        "doc_id", "lang", F.col("entry.bucket").alias("bucket"), F.round(F.col("entry.value").cast("double"), 6).alias("value")
    )
