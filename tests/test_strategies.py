"""Load strategies, models and quality tests on the golden scenarios."""

import pytest
from pyspark.sql import functions as F

from strata import FailedPrecondition, InvalidArgument, NotFound, VersionedTable, preview, query, workspace
from strata.plans import strategies
from strata.plans.models import MEDALLION, Model, run_models
from strata.plans.quality import assertion, not_null, report, unique
from strata.session import create_table, insert_into
from strata.sources.landing import read_csv, read_parquet
from tests.conftest import as_set

# Golden inputs and results.
ORDERS = [(1, "west", 100), (2, "east", 200), (3, "west", 300), (4, "east", 50)]
SUMMARY_SQL = "SELECT region, CAST(SUM(amount) AS BIGINT) AS total FROM orders GROUP BY region"
SUMMARY = [("east", 250), ("west", 400)]
RUN_1 = [(1, "Ann", "west"), (2, "Bob", "east")]
RUN_2 = [(1, "Ann", "north"), (2, "Bob", "east"), (3, "Cy", "south")]
HISTORY = [
    (1, "Ann", "north", "2026-02-01", "", True),
    (1, "Ann", "west", "2026-01-01", "2026-02-01", False),
    (2, "Bob", "east", "2026-01-01", "", True),
    (3, "Cy", "south", "2026-02-01", "", True),
]
LANDING = """order_id,customer,product,amount,status,order_date
1001,Alice,Widget,29.99,COMPLETED,2026-05-01
1002,bob,Gadget,,completed,2026-05-01
1003,Alice,Widget,29.99,Completed,2026-05-01
1004,Carol,Gizmo,149.50,PENDING,2026-05-02
1005,,Widget,29.99,completed,2026-05-02
1006,Dave,Gadget,49.00,CANCELLED,2026-05-02
1003,Alice,Widget,29.99,Completed,2026-05-01
1007,Erin,Gizmo,149.50,completed,2026-05-03
1008,Frank,Widget,29.99,COMPLETED,2026-05-03
"""


def customers(spark, data):
    return spark.createDataFrame(data, "id int, name string, region string")


def test_full_refresh(spark, folder):
    orders = VersionedTable(spark, f"{folder}/orders")
    orders.append(spark.createDataFrame(ORDERS, "id int, region string, amount int"))
    target = VersionedTable(spark, f"{folder}/summary")
    first = strategies.full_refresh(target, SUMMARY_SQL, {"orders": orders}, "run-1")
    assert as_set(target.read()) == SUMMARY and dict(target.read().dtypes)["total"] == "bigint"
    again = strategies.full_refresh(target, SUMMARY_SQL, {"orders": orders}, "run-1")
    assert again.already_applied and again.snapshot_id == first.snapshot_id
    with pytest.raises(InvalidArgument):
        strategies.full_refresh(target, "", {"orders": orders})


def test_typed_sql(spark, folder):
    orders = spark.createDataFrame(ORDERS[:3], "id int, region string, amount int")
    assert query(spark, "SELECT * FROM orders", {"orders": orders}).count() == 3
    west = query(spark, "SELECT id, amount FROM orders WHERE region = 'west'", {"orders": orders})
    assert as_set(west) == [(1, 100), (3, 300)]
    assert preview(spark, "SELECT * FROM orders", {"orders": orders}, 2).count() == 2
    assert preview(spark, "SELECT * FROM orders LIMIT 1", {"orders": orders}, 2).count() == 1
    assert preview(spark, "SELECT * FROM orders", {"orders": orders}, 0).count() == 3
    for bad in ("", "SELECT * FROM ghost", "SELECT ghost FROM orders", "SELEC 1"):
        with pytest.raises(InvalidArgument):
            query(spark, bad, {"orders": orders})
    assert not spark.catalog.tableExists("orders")


def test_create_and_insert(spark):
    assert create_table(spark, "typed_orders", "id INT, region STRING, amount INT") == 0
    for row in ORDERS[:3]:
        assert insert_into(spark, "typed_orders", spark.createDataFrame([row], "id int, region string, amount int")) == 1
    assert query(spark, "SELECT * FROM typed_orders").count() == 3
    with pytest.raises(InvalidArgument):
        insert_into(spark, "ghost", spark.range(1))


def test_scd2_golden_history(spark, folder):
    target = strategies.scd2_table(spark, folder, "customers_history")
    spec = dict(natural_key=["id"], tracked=["name", "region"])
    assert strategies.scd2(target, customers(spark, RUN_1), effective_from="2026-01-01", **spec).rows_affected == 2
    second = strategies.scd2(target, customers(spark, RUN_2), effective_from="2026-02-01", **spec)
    assert second.rows_affected == 3
    assert as_set(target.read()) == HISTORY
    replay = strategies.scd2(target, customers(spark, RUN_2), effective_from="2026-02-01", **spec)
    assert replay.already_applied and replay.snapshot_id == second.snapshot_id
    nothing = strategies.scd2(target, customers(spark, RUN_2), effective_from="2026-03-01", **spec)
    assert nothing.rows_affected == 0 and nothing.version == second.version
    assert as_set(strategies.scd2_as_of(target, "2026-01-15"), "id", "region") == [(1, "west"), (2, "east")]
    assert strategies.scd2_as_of(target, "2026-02-01").count() == 3
    gone = strategies.scd2(target, customers(spark, RUN_1[:1]), effective_from="2026-04-01", **spec)
    assert gone.rows_affected == 4  # Ann closed and reopened, Bob and Cy closed
    back = strategies.scd2(target, customers(spark, RUN_2), effective_from="2026-05-01", **spec)
    assert back.rows_affected == 4 and target.read(predicate="is_current").count() == 3


def test_scd2_edges(spark, folder):
    target = strategies.scd2_table(spark, folder)
    spec = dict(natural_key=["id"], tracked=["name", "region"])
    for missing in ("natural_key", "tracked"):
        with pytest.raises(InvalidArgument):
            strategies.scd2(target, customers(spark, RUN_1), effective_from="t1", **{**spec, missing: []})
    with pytest.raises(FailedPrecondition):
        strategies.scd2(target, customers(spark, RUN_1), effective_from="t1", expected_rows=9, **spec)
    with pytest.raises(InvalidArgument):
        strategies.scd2(target, customers(spark, [*RUN_1, (1, "Ann", "x")]), effective_from="t1", **spec)
    # nulls equal nulls, in keys and in tracked columns
    odd = [(None, "N", None), (1, "Ann", None)]
    assert strategies.scd2(target, customers(spark, odd), effective_from="t1", **spec).rows_affected == 2
    assert strategies.scd2(target, customers(spark, odd), effective_from="t2", **spec).rows_affected == 0
    # the same effective_from with other data replaces in place
    other = VersionedTable(spark, f"{folder}-b", partition_by=("is_current",))
    strategies.scd2(other, customers(spark, RUN_1), effective_from="t1", **spec)
    other.identifier = "renamed"  # another key, so that the run is not a replay
    again = strategies.scd2(other, customers(spark, [(1, "Ann", "south"), RUN_1[1]]), effective_from="t1", **spec)
    assert again.rows_affected == 2
    assert as_set(other.read(), "id", "region", "effective_to") == [(1, "south", ""), (2, "east", "")]


def test_other_loads(spark, folder):
    rows = lambda data: spark.createDataFrame(data, "id int, v string, at int")
    table = VersionedTable(spark, f"{folder}/inc")
    assert strategies.incremental(table, rows([(1, "a", 1), (2, "b", 2)]), ["id"], "at").rows_affected == 2
    late = rows([(1, "old", 0), (2, "b2", 3), (2, "b3", 4), (3, "c", 3)])
    assert strategies.incremental(table, late, ["id"], "at").rows_affected == 3
    assert as_set(table.read()) == [(1, "a", 1), (2, "b3", 4), (3, "c", 3)]

    shots = VersionedTable(spark, f"{folder}/snap")
    strategies.snapshot(shots, rows([(1, "a", 1)]), "d1", key="d1")
    strategies.snapshot(shots, rows([(1, "a", 1)]), "d1", key="d1")
    strategies.snapshot(shots, rows([(1, "a", 1)]), "d2", key="d2")
    assert as_set(shots.read(), "id", "snapshot_ts") == [(1, "d1"), (1, "d2")]

    soft = VersionedTable(spark, f"{folder}/soft")
    strategies.soft_delete(soft, rows([(1, "a", 1), (2, "b", 1)]), ["id"])
    strategies.soft_delete(soft, rows([(2, "b", 2), (3, "c", 1)]), ["id"])
    assert as_set(soft.read(), "id", "is_deleted") == [(1, True), (2, False), (3, False)]
    strategies.soft_delete(soft, rows([(1, "a", 3)]), ["id"])
    assert as_set(soft.read(), "id", "is_deleted") == [(1, False), (2, True), (3, True)]


def test_medallion(spark, folder, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(LANDING)
    landing = read_csv(spark, str(path))
    assert dict(landing.dtypes)["order_id"] == "int" and dict(landing.dtypes)["amount"] == "double"
    built = run_models(spark, folder, MEDALLION, {"landing_orders": landing}, run_id="run-1")
    assert [built[m.name].read().count() for m in MEDALLION] == [9, 4, 2]
    gold = [(str(d), n, r) for d, n, r in as_set(built["gold_daily_revenue"].read())]
    assert gold == [("2026-05-01", 2, 59.98), ("2026-05-03", 2, 179.49)]


def test_failing_model_stops_the_run(spark, folder):
    broken = Model("bad", lambda ref: ref("src"), checks=(not_null("id"),))
    after = Model("later", lambda ref: ref("bad"), after=("bad",))
    src = spark.createDataFrame([(None,), (1,)], "id int")
    with pytest.raises(FailedPrecondition):
        run_models(spark, folder, (after, broken), {"src": src})
    assert not VersionedTable(spark, f"{folder}/later").exists()
    with pytest.raises(NotFound):
        run_models(spark, workspace(spark, "x"), (Model("m", lambda ref: ref("nowhere")),), {})


def test_quality_report(spark):
    data = spark.createDataFrame([(1, "a"), (1, None), (2, None), (None, "b"), (None, "b")], "id int, v string")
    checks = [not_null("id"), not_null("v", "warn"), unique("id"), assertion("big", lambda f: f.where("id > 1"))]
    found = {r.test: (r.violations, r.passed) for r in report(data, checks).collect()}
    assert found == {
        "not_null_id": (2, False),
        "not_null_v": (2, False),
        "unique_id": (1, False),
        "big": (1, False),
    }


def test_incremental_embed(spark, folder):
    docs = [(n, f"text number {n}", n) for n in range(15)]
    frame = lambda some: spark.createDataFrame(some, "doc_id int, text string, at int")
    table = VersionedTable(spark, folder)
    load = lambda some, key: strategies.incremental_embed(table, frame(some), ["doc_id"], "text", "at", key)
    assert load(docs[:12], "r1").rows_affected == 12
    assert load(docs, "r2").rows_affected == 3
    assert load(docs, "r2").already_applied
    assert load(docs, "r3").rows_affected == 0
    assert table.read().where("size(embedding) = 256").count() == 15


def test_parquet_source(spark, folder):
    spark.range(5).selectExpr("id", "id * 2 as v").write.parquet(folder)
    assert as_set(read_parquet(spark, folder, ["v"], "id > 2")) == [(6,), (8,)]
    with pytest.raises(InvalidArgument):
        read_parquet(spark, "")


def test_a_refresh_needs_a_run(spark, folder):
    with pytest.raises(InvalidArgument):
        strategies.full_refresh(VersionedTable(spark, folder), "SELECT 1 AS one", {})


def test_marks_that_tie_come_late_or_are_missing(spark, folder):
    rows = lambda data: spark.createDataFrame(data, "id int, v string, at int")
    table = VersionedTable(spark, f"{folder}/any")
    strategies.incremental(table, rows([(1, "a", 10), (2, "b", 5), (9, "n", None)]), ["id"], "at")
    later = rows([(3, "tie", 10), (4, "late", 5), (5, "none", None), (1, "old", 9), (2, "same", 5), (9, "m", None), (1, "gone", None)])
    assert strategies.incremental(table, later, ["id"], "at").rows_affected == 5
    wanted = [(1, "a", 10), (2, "same", 5), (3, "tie", 10), (4, "late", 5), (5, "none", None), (9, "m", None)]
    assert as_set(table.read()) == sorted(wanted, key=repr)
    assert strategies.incremental(table, later, ["id"], "at").rows_affected == 0
    far = rows([(6, "too late", 3), (7, "in time", 8), (8, "none", None)])
    assert strategies.incremental(table, far, ["id"], "at", lateness=4).rows_affected == 2


def test_loads_survive_another_writer(spark, folder, monkeypatch):
    """Another load commits after a load has read the table and before it writes."""
    rows = lambda data: spark.createDataFrame(data, "id int, v string, at int")

    def interleave(table, other):
        plain, waiting = VersionedTable.read, [other]

        def read(self, *args, **named):
            frame = plain(self, *args, **named)
            if self is table and waiting:
                waiting.pop()()
            return frame

        monkeypatch.setattr(VersionedTable, "read", read)

    soft = VersionedTable(spark, f"{folder}/soft")
    strategies.soft_delete(soft, rows([(1, "a", 1)]), ["id"])
    added = rows([(7, "other", 1)]).withColumn("is_deleted", F.lit(False))
    interleave(soft, lambda: VersionedTable(spark, soft.path).append(added))
    strategies.soft_delete(soft, rows([(1, "a", 2)]), ["id"])
    assert as_set(soft.read(), "id", "is_deleted") == [(1, False), (7, True)]

    spec = {"natural_key": ["id"], "tracked": ["name", "region"]}
    kept = strategies.scd2_table(spark, f"{folder}/kept")
    strategies.scd2(kept, customers(spark, [(1, "Ann", "north")]), effective_from="t1", **spec)
    interleave(
        kept, lambda: strategies.scd2(VersionedTable(spark, kept.path), customers(spark, [(1, "Ann", "east")]), effective_from="t2", **spec)
    )
    strategies.scd2(kept, customers(spark, [(1, "Ann", "west")]), effective_from="t3", **spec)
    assert as_set(kept.read().where("is_current"), "id", "region") == [(1, "west")]
    assert as_set(kept.read(), "region", "effective_to") == [("east", "t3"), ("north", "t2"), ("west", "")]

    table = VersionedTable(spark, f"{folder}/embedded")
    docs = lambda data: spark.createDataFrame(data, "id int, text string, at int")
    embed = lambda at, data: strategies.incremental_embed(at, docs(data), ["id"], "text", "at")
    embed(table, [(1, "one", 1)])
    interleave(table, lambda: embed(VersionedTable(spark, table.path), [(1, "newest", 3)]))
    embed(table, [(1, "newer", 2), (2, "two", 1)])
    assert as_set(table.read(), "id", "text") == [(1, "newest"), (2, "two")]


def test_a_truncated_source_is_refused_by_every_load(spark, folder):
    rows = spark.createDataFrame([(1, "a", 1)], "id int, v string, at int")
    table = lambda name: VersionedTable(spark, f"{folder}/{name}")
    loads = [
        lambda n: strategies.full_refresh(table("a"), "SELECT * FROM t", {"t": rows}, "r", expected_rows=n),
        lambda n: strategies.append_load(table("b"), rows, expected_rows=n),
        lambda n: strategies.incremental(table("c"), rows, ["id"], "at", expected_rows=n),
        lambda n: strategies.delete_insert(table("d"), rows, ["id"], expected_rows=n),
        lambda n: strategies.snapshot(table("e"), rows, "d1", expected_rows=n),
        lambda n: strategies.soft_delete(table("f"), rows, ["id"], expected_rows=n),
        lambda n: strategies.scd2(table("g"), rows, ["id"], ["v"], "t1", expected_rows=n),
        lambda n: strategies.incremental_embed(table("h"), rows, ["id"], "v", "at", expected_rows=n),
    ]
    for load in loads:
        with pytest.raises(FailedPrecondition):
            load(2)
        assert load(1).rows_affected == 1
