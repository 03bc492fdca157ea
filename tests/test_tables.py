"""Write modes, versions, guards and upkeep of versioned tables."""

import threading

import pytest
from pyspark.sql import functions as F

from strata import FailedPrecondition, InvalidArgument, NotFound, VersionedTable
from strata.plans.publish import write_audit_publish
from strata.sources.commits import _HadoopFiles
from strata.plans.quality import Check, assertion, not_null, unique
from tests.conftest import as_set

# The golden write lifecycle.
TABLE = "warehouse.sales.orders"
FIRST = [("1", "alice"), ("2", "bob")]
UPSERT = [("2", "robert"), ("3", "carol")]
REPLACED = [("9", "zoe")]


def rows(spark, data, schema="id string, name string"):
    return spark.createDataFrame(data, schema)


def test_write_lifecycle(spark, folder):
    table = VersionedTable(spark, folder, TABLE)
    assert table.read().count() == 0
    assert table.append(rows(spark, FIRST)).rows_affected == 2
    assert table.read().count() == 2
    assert table.merge(rows(spark, UPSERT), ["id"]).rows_affected == 2
    assert as_set(table.read()) == [("1", "alice"), ("2", "robert"), ("3", "carol")]
    assert table.overwrite(rows(spark, REPLACED)).rows_affected == 1
    assert as_set(table.read()) == REPLACED
    kept = table.maintain()
    assert kept.rows_affected is None and kept.snapshot_id == f"{TABLE}@v3"
    assert as_set(table.read()) == REPLACED


def test_argument_errors(spark, folder):
    with pytest.raises(InvalidArgument):
        VersionedTable(spark, folder, "")
    table = VersionedTable(spark, folder, TABLE)
    with pytest.raises(InvalidArgument):
        table.merge(rows(spark, [("1", "x")]), [])
    table.append(rows(spark, FIRST))
    with pytest.raises(InvalidArgument):
        table.append(rows(spark, [(1,)], "id int"))
    with pytest.raises(NotFound):
        table.read(version=7)


def test_time_travel(spark, folder):
    table = VersionedTable(spark, folder)
    table.append(rows(spark, [("1", "a")]))
    table.append(rows(spark, [("2", "b")]))
    assert table.read(version=1).count() == 2
    assert table.read(version=0).count() == 1
    assert table.history().count() == 2


def test_merge_needs_order_for_copies_and_last_wins(spark, folder):
    table = VersionedTable(spark, folder)
    table.append(rows(spark, [("1", "a"), (None, "n")]))
    copies = rows(spark, [("1", "x", 2), ("1", "y", 1), (None, "m", 1)], "id string, name string, seq int")
    with pytest.raises(InvalidArgument):
        table.merge(copies.drop("seq"), ["id"])
    result = table.merge(copies, ["id"], order_by="seq")
    assert result.rows_affected == 3
    assert as_set(table.read()) == sorted([("1", "x"), (None, "m")], key=repr)


def test_idempotency_key_replays(spark, folder):
    table = VersionedTable(spark, folder)
    first = table.append(rows(spark, FIRST), key="k1")
    again = table.append(rows(spark, UPSERT), key="k1")
    assert again.already_applied and again.snapshot_id == first.snapshot_id and again.rows_affected == 2
    assert table.read().count() == 2
    table.append(rows(spark, FIRST))
    table.append(rows(spark, FIRST))
    assert table.read().count() == 6
    # the key is looked at before the expected version
    assert table.append(rows(spark, FIRST), key="k1", expected_version=99).already_applied


def test_truncated_input_is_refused(spark, folder):
    table = VersionedTable(spark, folder)
    data = spark.range(4).selectExpr("cast(id as int) id")
    for write in (table.append, table.overwrite):
        with pytest.raises(FailedPrecondition, match="truncated"):
            write(data, expected_rows=9)
    with pytest.raises(FailedPrecondition, match="truncated"):
        table.merge(data, ["id"], expected_rows=9)
    assert not table.exists()
    assert table.append(data, expected_rows=4).rows_affected == 4


def test_empty_overwrite_truncates(spark, folder):
    table = VersionedTable(spark, folder)
    table.append(rows(spark, FIRST))
    assert table.append(rows(spark, [])).rows_affected == 0
    assert table.read().count() == 2
    assert table.overwrite(rows(spark, [])).rows_affected == 0
    assert table.read().count() == 0 and table.read().columns == ["id", "name"]


def test_partitioned_merge_rewrites_only_touched_folders(spark, folder):
    table = VersionedTable(spark, folder, partition_by=("region",))
    schema = "id int, region string, amount int"
    table.append(rows(spark, [(1, "a b/c", 1), (2, "east+1", 2), (3, "w%st", 3), (4, None, 4)], schema))
    before = set(table.head()["folders"])
    assert len(before) == 4
    table.merge(rows(spark, [(1, "east+1", 10), (5, "n", 5)], schema), ["id"])
    after = set(table.head()["folders"])
    assert len(before & after) == 3
    assert as_set(table.read(), "id", "region", "amount") == sorted(
        [(1, "east+1", 10), (2, "east+1", 2), (3, "w%st", 3), (4, None, 4), (5, "n", 5)], key=repr
    )
    assert table.read(predicate="region = 'east+1'", columns=["id"]).count() == 2
    table.maintain()
    assert table.read().count() == 5


def test_delete_insert_keeps_copies(spark, folder):
    table = VersionedTable(spark, folder)
    table.append(rows(spark, FIRST))
    table.delete_insert(rows(spark, [("2", "x"), ("2", "y")]), ["id"])
    assert as_set(table.read()) == [("1", "alice"), ("2", "x"), ("2", "y")]


def test_one_of_many_concurrent_publishers_wins(spark, folder):
    table = VersionedTable(spark, folder)
    table.append(rows(spark, FIRST))
    outcomes = []

    def publish(n):
        try:
            VersionedTable(spark, folder).overwrite(rows(spark, [(str(n), "p")]), expected_version=0)
            outcomes.append("won")
        except FailedPrecondition:
            outcomes.append("lost")

    threads = [threading.Thread(target=publish, args=(n,)) for n in range(16)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert outcomes.count("won") == 1 and len(outcomes) == 16
    assert table.read().count() == 1


def test_concurrent_appends_all_land(spark, folder):
    table = VersionedTable(spark, folder)
    table.append(rows(spark, FIRST))
    threads = [
        threading.Thread(target=lambda: VersionedTable(spark, folder).append(rows(spark, FIRST))) for _ in range(6)
    ]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert table.read().count() == 14


def test_branches(spark, folder):
    table = VersionedTable(spark, folder, TABLE)
    with pytest.raises(NotFound):
        table.create_branch("run-42")
    start = table.append(rows(spark, FIRST)).snapshot_id
    run = table.create_branch("run-42")
    run.append(rows(spark, UPSERT))
    assert table.read().count() == 2 and run.read().count() == 4
    merged = table.merge_branch("run-42", expected_snapshot=start, key="run-42-merge")
    assert not merged.already_applied and table.read().count() == 4
    again = table.merge_branch("run-42", key="run-42-merge")
    assert again.already_applied and again.snapshot_id == merged.snapshot_id
    with pytest.raises(FailedPrecondition):
        table.merge_branch("run-42", expected_snapshot=start, key="different-key")
    with pytest.raises(NotFound):
        table.merge_branch("ghost")
    table.overwrite(rows(spark, REPLACED))
    assert table.create_branch("run-42").read().count() == 1


def test_publish_only_clean_rows(spark, folder):
    table = VersionedTable(spark, folder)
    checks = [not_null("id"), unique("id")]
    write_audit_publish(table, rows(spark, FIRST), checks, key="r1")
    with pytest.raises(FailedPrecondition, match="unique_id"):
        write_audit_publish(table, rows(spark, [("1", "a"), ("1", "b")]), checks)
    assert as_set(table.read()) == FIRST
    warned = [*checks, assertion("no_zoe", lambda f: f.where("name = 'zoe'"), severity="warn")]
    write_audit_publish(table, rows(spark, REPLACED), warned, expected_version=0)
    assert as_set(table.read()) == REPLACED
    assert write_audit_publish(table, rows(spark, FIRST), checks, key="r1").already_applied
    with pytest.raises(FailedPrecondition):
        write_audit_publish(table, rows(spark, FIRST), checks, expected_version=0)
    assert isinstance(checks[0], Check)


def test_register_is_idempotent(spark, folder):
    table = VersionedTable(spark, folder)
    schema = rows(spark, FIRST).schema
    assert not table.register(schema).already_applied
    assert table.register(schema).already_applied
    assert table.read().columns == ["id", "name"]


def test_expire_removes_only_unlisted_data(spark, folder):
    table = VersionedTable(spark, folder)
    table.append(rows(spark, FIRST))
    table.overwrite(rows(spark, UPSERT))
    table.append(rows(spark, REPLACED))
    assert len(table.unused_folders(3)) == 0
    assert len(table.expire(1)) == 1
    assert table.read().count() == 3 and table.read(version=1).count() == 2


def test_abandoned_writes_are_found(spark, folder):
    table = VersionedTable(spark, folder)
    table.append(rows(spark, FIRST))
    left = table.stage(rows(spark, UPSERT)).folders
    assert table.abandoned_folders(older_than_s=3600) == []
    assert table.abandoned_folders(older_than_s=-5) == list(left)
    table.remove(left)
    assert table.abandoned_folders(older_than_s=-5) == [] and table.read().count() == 2


def test_commit_files_through_the_hadoop_client(spark, folder):
    files = _HadoopFiles(spark, f"{folder}/commits")
    assert files.names() == []
    assert files.create("1.json", '{"a": "é"}') and not files.create("1.json", "{}")
    assert files.read("1.json") == '{"a": "é"}'
    assert [n for n in files.names() if not n.startswith(".")] == ["1.json"]


def test_maintain_keeps_files_of_a_partitioned_table_small(spark, folder):
    table = VersionedTable(spark, folder, partition_by=("p",))
    rows = spark.range(20_000).select((F.col("id") % 2).cast("int").alias("p"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    table.append(rows)
    before = as_set(table.read().groupBy("p").count())
    table.maintain(file_bytes=100_000)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{table.data}/{f}" for f in table.head()["folders"]])
    found = [row.length for row in sizes.select("length").collect()]
    assert len(found) >= 10 and max(found) < 200_000
    assert as_set(table.read().groupBy("p").count()) == before
