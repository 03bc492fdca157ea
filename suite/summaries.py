"""Sketches, digests, posting lists and user functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from strata.operators import userfunctions
from strata.operators.digests import diff_by_digests, ranges_for
from strata.operators.postings import search_many
from strata.operators.sketches import ROWS, SketchTable, estimate_distinct, estimate_quantile
from strata.session import query, workspace
from suite.registry import load, registered


@registered(
    "sketch_rollup",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS middle_near, true AS high_near
    FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' GROUP BY event_type""",
)
def sketch_rollup(spark, sf_dir):
    """Events are sketched by day in three batches, one of which comes again; days are
    rolled up by type. Users must be within 5 % of the exact count, and the median and
    the 99th percentile within 2 % of the rows."""
    events = load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", "value")
    kept = SketchTable(spark, workspace(spark, "sketches"), ["event_type"], ["user_id"], ["value"])
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for batch in (0, 1, 0, 2):
        kept.add(events.where(third == batch), "ts", f"batch-{batch}")
    rolled = kept.between("2024-01-03", "2024-01-25", ["event_type"]).select(
        "event_type", F.col(ROWS).alias("n"), estimate_distinct("user_id").alias("users_about"),
        estimate_quantile("value", 0.5).alias("middle"), estimate_quantile("value", 0.99).alias("high"),
    )
    days = events.where(F.col("ts").cast("date").between(F.lit("2024-01-03").cast("date"), F.lit("2024-01-25").cast("date")))
    # a row for each type, so it is small
    ranks = days.join(F.broadcast(rolled), "event_type").groupBy("event_type", "n", "users_about").agg(
        F.count_distinct("user_id").alias("users"),
        *[F.count_if(F.col("value") < F.col(c)).alias(f"{c}_under") for c in ("middle", "high")],
        *[F.count_if(F.col("value") <= F.col(c)).alias(f"{c}_upto") for c in ("middle", "high")],
    )
    near = lambda c, share: (F.col(f"{c}_under") <= (share + 0.02) * F.col("n")) & (F.col(f"{c}_upto") >= (share - 0.02) * F.col("n"))
    users_near = F.abs(F.col("users_about") - F.col("users")) <= 0.05 * F.col("users")
    return ranks.select(
        "event_type", "n", "users", users_near.alias("users_near"), near("middle", 0.5).alias("middle_near"), near("high", 0.99).alias("high_near")
    )


LATER_SQL = """later AS (SELECT CASE WHEN o_orderkey % 211 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_orderkey % 307 <> 0)"""


@registered(
    "digest_diff",
    f"""WITH {LATER_SQL} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
    CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'changed' END AS change,
    o.o_custkey AS old_o_custkey, o.o_orderstatus AS old_o_orderstatus, o.o_totalprice AS old_o_totalprice,
    n.o_custkey AS new_o_custkey, n.o_orderstatus AS new_o_orderstatus, n.o_totalprice AS new_o_totalprice
    FROM orders o FULL JOIN later n ON n.o_orderkey = o.o_orderkey
    WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR (o.o_custkey, o.o_orderstatus, o.o_totalprice) <> (n.o_custkey, n.o_orderstatus, n.o_totalprice)""",
)
def digest_diff(spark, sf_dir):
    """A snapshot of the orders and a later one, of which about 3 % differ."""
    tracked = ["o_custkey", "o_orderstatus", "o_totalprice"]
    old = load(spark, sf_dir, "orders").select("o_orderkey", *tracked)
    new = old.where("o_orderkey % 307 <> 0").withColumns(
        {
            "o_orderkey": F.expr("CASE WHEN o_orderkey % 211 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END"),
            "o_orderstatus": F.expr("CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END"),
            "o_totalprice": F.expr("CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"),
        }
    )
    return diff_by_digests(old, new, ["o_orderkey"], tracked, ranges_for(old.count()))


NEEDLES_SQL = """needles AS (SELECT c_custkey AS request_id, substr(p_name, 1 + c_custkey % 4, 1 + c_custkey % 7) AS query, p_type AS wanted
    FROM customer JOIN part ON p_partkey = c_custkey)"""


@registered(
    "search_many",
    f"""WITH {NEEDLES_SQL} SELECT request_id, query, count(*) AS found, min(p_partkey) AS first, max(p_partkey) AS last FROM needles
    JOIN part ON p_type = wanted AND (contains(lower(p_name), lower(query)) OR contains(lower(p_brand), lower(query)))
    GROUP BY request_id, query""",
)
def search_many_parts(spark, sf_dir):
    """Every customer looks for a piece of a part's name, of one to seven letters,
    among the parts of that part's type."""
    part = load(spark, sf_dir, "part")
    whose = load(spark, sf_dir, "customer").select("c_custkey")
    needles = whose.join(part, F.col("c_custkey") == F.col("p_partkey")).select(
        F.col("c_custkey").alias("request_id"), F.expr("upper(substr(p_name, 1 + c_custkey % 4, 1 + c_custkey % 7))").alias("query"), F.col("p_type").alias("wanted")
    )
    totals = {"found": ("count", F.lit(1)), "first": ("min", F.col("p_partkey")), "last": ("max", F.col("p_partkey"))}
    found = search_many(needles, part, "p_partkey", ["p_name", "p_brand"], slice_rows=2_000, totals=totals, same={"wanted": "p_type"})
    counted = found.groupBy("request_id", "query").agg(F.sum("found").alias("found"), F.min("first").alias("first"), F.max("last").alias("last"))
    asked = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.expr("substr(p_name, 1 + p_partkey % 4, 1 + p_partkey % 7)").alias("query"))
    return counted.drop("query").join(asked, "request_id")


@registered(
    "user_sessions",
    """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS starts FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, event_type, value, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM marked""",
)
def user_sessions(spark, sf_dir):
    """A table function of any columns, over each user's events in order."""
    userfunctions.install(spark)
    events = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    hours = int(datetime.timedelta(hours=6).total_seconds())
    numbered = query(
        spark, f"SELECT * FROM sessions(TABLE(events) PARTITION BY (user_id) ORDER BY (ts, event_id), 'ts', {hours})", {"events": events}
    )
    return numbered.drop("ts")


@registered(
    "user_gini",
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, round(sum((2 * i - n - 1) * value) / (max(n) * sum(value)), 6) AS gini FROM r GROUP BY user_id""",
)
def user_gini(spark, sf_dir):
    """A grouped aggregate over Arrow columns, one group for each user."""
    userfunctions.install(spark)
    spread = query(spark, "SELECT user_id, gini(value) AS gini FROM events GROUP BY user_id", {"events": load(spark, sf_dir, "events")})
    return spread.select("user_id", F.round("gini", 6).alias("gini"))
