"""Scans, write modes, time travel, branches and upkeep over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.errors import FailedPrecondition
from strata.plans import strategies
from strata.plans.publish import write_audit_publish
from strata.plans.quality import not_null, unique
from strata.session import preview, query, workspace
from strata.sources.landing import read_csv, read_parquet
from strata.sources.versioned import VersionedTable
from suite.registry import load, registered

SLIM = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]


def orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(*SLIM)


def reissued(spark, sf_dir):
    """Pending orders come again under a new (negative) key."""
    pending = orders(spark, sf_dir).where("o_orderstatus = 'P'")
    return pending.withColumn("o_orderkey", -F.col("o_orderkey") - 1)


REISSUED = "SELECT -o_orderkey - 1 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'"
SLIM_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def repriced(spark, sf_dir):
    """Orders at the price their lines add up to; orders without lines are absent."""
    lines = load(spark, sf_dir, "lineitem")
    total = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    known = orders(spark, sf_dir).join(total, F.col("o_orderkey") == F.col("l_orderkey"))
    return known.withColumn("o_totalprice", F.col("total").cast("double")).select(*SLIM)


REPRICED = """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(total AS DOUBLE) AS o_totalprice
FROM orders JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total
                  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""


def fresh(spark, purpose, **options):
    return VersionedTable(spark, workspace(spark, purpose), purpose, **options)


@registered("scan_table", "SELECT * FROM orders")
def scan_table(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/orders.parquet")


@registered("scan_projected", "SELECT l_orderkey, l_quantity FROM lineitem")
def scan_projected(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@registered(
    "scan_filtered",
    "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'",
)
def scan_filtered(spark, sf_dir):
    return read_parquet(
        spark,
        f"{sf_dir}/lineitem.parquet",
        ["l_orderkey", "l_partkey", "l_extendedprice"],
        "l_quantity >= 45 AND l_returnflag = 'R'",
    )


@registered("query_all", "SELECT * FROM supplier")
def query_all(spark, sf_dir):
    return query(spark, "SELECT * FROM shop_supplier", {"shop.supplier": load(spark, sf_dir, "supplier")})


@registered("query_where_projection", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def query_where_projection(spark, sf_dir):
    return query(
        spark,
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'",
        {"customer": load(spark, sf_dir, "customer")},
    )


@registered(
    "preview_bounded",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def preview_bounded(spark, sf_dir):
    sql = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
    return preview(spark, sql, {"orders": orders(spark, sf_dir)}, limit=25)


@registered(
    "csv_landing",
    "SELECT o_orderkey, o_custkey, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders",
)
def csv_landing(spark, sf_dir):
    path = workspace(spark, "landing")
    rows = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("o_orderdate")
    )
    rows.write.option("header", True).csv(path)
    landed = read_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderdate date")
    return landed.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@registered("append_rows", f"{SLIM_SQL} UNION ALL {REISSUED}")
def append_rows(spark, sf_dir):
    table = fresh(spark, "append")
    strategies.append_load(table, orders(spark, sf_dir), key="first")
    strategies.append_load(table, reissued(spark, sf_dir), key="second")
    strategies.append_load(table, reissued(spark, sf_dir), key="second")
    return table.read()


@registered("overwrite_rows", REPRICED)
def overwrite_rows(spark, sf_dir):
    table = fresh(spark, "overwrite")
    table.append(orders(spark, sf_dir))
    table.overwrite(repriced(spark, sf_dir))
    return table.read()


@registered("time_travel", SLIM_SQL)
def time_travel(spark, sf_dir):
    table = fresh(spark, "travel")
    table.append(orders(spark, sf_dir))
    table.overwrite(repriced(spark, sf_dir))
    return table.read(version=0)


@registered(
    "merge_upsert",
    f"""WITH price AS ({REPRICED}), back AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
    source AS (SELECT o_orderkey, o_custkey, CASE WHEN l_orderkey IS NULL THEN o_orderstatus ELSE 'R' END AS o_orderstatus,
                      o_totalprice FROM price LEFT JOIN back ON o_orderkey = l_orderkey
               UNION ALL {REISSUED})
    SELECT * FROM source
    UNION ALL SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice FROM orders o
              WHERE NOT EXISTS (SELECT 1 FROM source s WHERE s.o_orderkey = o.o_orderkey)""",
)
def merge_upsert(spark, sf_dir):
    """Every order is repriced; where goods came back a later row sets status R."""
    price = repriced(spark, sf_dir)
    back = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    returned = price.join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    source = (
        price.withColumn("seq", F.lit(1))
        .unionByName(returned.withColumn("o_orderstatus", F.lit("R")).withColumn("seq", F.lit(2)))
        .unionByName(reissued(spark, sf_dir).withColumn("seq", F.lit(1)))
    )
    table = fresh(spark, "merge")
    table.append(orders(spark, sf_dir))
    table.merge(source, ["o_orderkey"], order_by="seq")
    return table.read()


@registered(
    "merge_partitioned",
    f"""WITH price AS (SELECT * FROM ({REPRICED}) WHERE o_orderstatus = 'F')
    SELECT * FROM price UNION ALL
    SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM price p WHERE p.o_orderkey = o.o_orderkey)""",
)
def merge_partitioned(spark, sf_dir):
    """A merge that concerns one partition leaves the folders of the others alone."""
    table = fresh(spark, "merge_partitioned", partition_by=("o_orderstatus",))
    table.append(orders(spark, sf_dir))
    table.merge(repriced(spark, sf_dir).where("o_orderstatus = 'F'"), ["o_orderkey"])
    return table.read()


LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


@registered(
    "delete_insert",
    """SELECT l_orderkey, l_linenumber, l_partkey, -l_quantity AS l_quantity FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def delete_insert(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    returned = lines.where("l_returnflag = 'R'").withColumn("l_quantity", -F.col("l_quantity"))
    table = fresh(spark, "delete_insert")
    table.append(lines.select(*LINES))
    strategies.delete_insert(table, returned.select(*LINES), ["l_orderkey"], key="returns")
    return table.read()


# -- whole rows: every column of the feed, time stamps included ---------------------


def moved(spark, sf_dir):
    """Purchases a day later."""
    bought = load(spark, sf_dir, "events").where("event_type = 'purchase'")
    return bought.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))


MOVED = "SELECT * REPLACE (ts + INTERVAL 1 DAY AS ts) FROM events WHERE event_type = 'purchase'"


@registered("append_events", f"SELECT * FROM events UNION ALL {MOVED}")
def append_events(spark, sf_dir):
    table = fresh(spark, "events")
    for key, rows in (("first", load(spark, sf_dir, "events")), ("second", moved(spark, sf_dir)), ("second", moved(spark, sf_dir))):
        table.append(rows, key=key)
    return table.read()


@registered("merge_events", f"SELECT * FROM events WHERE event_type <> 'purchase' UNION ALL {MOVED}")
def merge_events(spark, sf_dir):
    table = fresh(spark, "events")
    table.append(load(spark, sf_dir, "events"))
    table.merge(moved(spark, sf_dir).unionByName(load(spark, sf_dir, "events").where("event_type = 'purchase'")), ["event_id"], order_by="ts")
    return table.read()


@registered("overwrite_events", MOVED)
def overwrite_events(spark, sf_dir):
    table = fresh(spark, "events", partition_by=("event_type",))
    table.append(load(spark, sf_dir, "events"))
    table.overwrite(moved(spark, sf_dir))
    return table.read()


@registered(
    "delete_insert_lines",
    """SELECT * REPLACE (-l_quantity AS l_quantity) FROM lineitem WHERE l_returnflag = 'R' UNION ALL
    SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def delete_insert_lines(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    returned = lines.where("l_returnflag = 'R'").withColumn("l_quantity", -F.col("l_quantity"))
    table = fresh(spark, "lines")
    table.append(lines)
    strategies.delete_insert(table, returned, ["l_orderkey"], key="returns")
    return table.read()


@registered(
    "ctas_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    count(*) AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def ctas_summary(spark, sf_dir):
    table = fresh(spark, "ctas")
    sql = """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
    count(*) AS lines FROM lineitem GROUP BY l_returnflag, l_linestatus"""
    table.overwrite(query(spark, sql, {"lineitem": load(spark, sf_dir, "lineitem")}))
    return table.read()


@registered("maintain_table", f"{SLIM_SQL} UNION ALL {REISSUED}")
def maintain_table(spark, sf_dir):
    """Compaction changes files, not rows; expiry drops what it replaced."""
    table = fresh(spark, "maintain")
    table.append(orders(spark, sf_dir))
    table.append(reissued(spark, sf_dir))
    table.maintain()
    table.expire(keep_last=1)
    return table.read()


@registered("branch_publish", f"{SLIM_SQL} UNION ALL {REISSUED}")
def branch_publish(spark, sf_dir):
    """Work on a run branch, then merge it where main still is as expected."""
    table = fresh(spark, "branch")
    start = table.append(orders(spark, sf_dir)).snapshot_id
    table.create_branch("run-1").append(reissued(spark, sf_dir))
    table.merge_branch("run-1", expected_snapshot=start, key="run-1")
    table.merge_branch("run-1", expected_snapshot=start, key="run-1")
    return table.read()


@registered("publish_gate", SLIM_SQL)
def publish_gate(spark, sf_dir):
    """Clean rows are published; a batch that repeats keys is refused."""
    table = fresh(spark, "publish")
    checks = [not_null("o_orderkey"), unique("o_orderkey"), not_null("o_totalprice")]
    write_audit_publish(table, orders(spark, sf_dir), checks, key="clean")
    dirty = orders(spark, sf_dir).unionByName(repriced(spark, sf_dir))
    try:
        write_audit_publish(table, dirty, checks, key="dirty")
    except FailedPrecondition:
        return table.read()
    raise AssertionError("repeated keys were published")
