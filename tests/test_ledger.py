"""The ledger against a recount, batch by batch."""

import datetime
import random
from decimal import Decimal

import pytest

from strata.errors import FailedPrecondition, InvalidArgument
from strata.operators.ledger import Ledger
from tests.conftest import as_set

BATCH = "event_id long, ts timestamp, tenant string, meter string, quantity decimal(18,2), seq int"


def day(n):
    return datetime.datetime(2024, 1, 1 + n, 12)


def batch(spark, rows):
    return spark.createDataFrame([(i, day(d), t, m, None if q is None else Decimal(q), s) for i, d, t, m, q, s in rows], BATCH)


def totals(frame):
    return [(t, m, float(q), n) for t, m, q, n in as_set(frame, "tenant", "meter", "quantity", "recorded")]


def test_kept_totals_are_those_of_a_recount(spark, folder):
    draw, ledger, latest = random.Random(9), Ledger(spark, folder, 4), {}
    for number in range(3):
        rows = []
        for i in draw.sample(range(30), 14):
            tenant, meter = draw.choice(["a", "b", None]), draw.choice(["m", "n", None])
            quantity = draw.choice([None, "0.00", "1.10", "-2.00", "5.00"])
            rows.append((i, i % 3, tenant, meter, quantity, 0))
            latest[i] = (tenant, meter, quantity)
        result = ledger.record(batch(spark, rows), f"b{number}")
        assert ledger.record(batch(spark, rows), f"b{number}").already_applied and not result.already_applied
        wanted = {}
        for tenant, meter, quantity in latest.values():
            if quantity is not None:
                total, n = wanted.get((tenant, meter), (0, 0))
                wanted[tenant, meter] = (total + Decimal(quantity), n + 1)
        plain = sorted(((t, m, float(q), n) for (t, m), (q, n) in wanted.items()), key=repr)
        assert sorted(totals(ledger.totals()), key=repr) == sorted(totals(ledger.recounted()), key=repr) == plain


def test_copies_in_a_batch_and_wrong_rows(spark, folder):
    ledger = Ledger(spark, folder)
    assert totals(ledger.totals()) == totals(ledger.recounted()) == []
    twice = batch(spark, [(1, 0, "a", "m", "1.00", 1), (1, 0, "a", "m", "9.00", 2)])
    with pytest.raises(InvalidArgument, match="share the key"):
        ledger.record(twice, "x")
    with pytest.raises(InvalidArgument, match="needs a key"):
        ledger.record(twice, "")
    with pytest.raises(InvalidArgument, match="an id and a time"):
        ledger.record(batch(spark, [(None, 0, "a", "m", "1.00", 1)]), "x")
    ledger.record(twice, "x", order_by="seq")
    assert totals(ledger.totals()) == [("a", "m", 9.0, 1)]


def test_a_batch_that_was_cut_off_is_finished_first(spark, folder, monkeypatch):
    ledger = Ledger(spark, folder)
    ledger.record(batch(spark, [(1, 0, "a", "m", "1.00", 0)]), "one")
    second = batch(spark, [(1, 0, "a", "m", "3.00", 0), (2, 0, "a", "m", "4.00", 0)])
    with monkeypatch.context() as patch:
        patch.setattr(ledger.entries, "merge", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            ledger.record(second, "two")
    with pytest.raises(FailedPrecondition, match="two was cut off"):
        ledger.record(second, "three")
    ledger.record(second, "two")
    assert totals(ledger.totals()) == totals(ledger.recounted()) == [("a", "m", 7.0, 2)]


def test_a_batch_reads_only_the_days_and_buckets_it_touches(spark, folder, capsys):
    ledger = Ledger(spark, folder, 8)
    ledger.record(batch(spark, [(i, i, f"t{i}", "m", "1.00", 0) for i in range(6)]), "one")
    some = batch(spark, [(1, 1, "t1", "m", "2.00", 0)]).selectExpr("to_date(ts) AS day", "event_id", "tenant", "meter", "quantity")
    ledger._known(ledger.entries, "", "day", some).explain()
    assert "PartitionFilters: [" in (plan := capsys.readouterr().out) and "2024-01-02" in plan
    looked = []
    real = ledger.sums._folders_holding
    ledger.sums._folders_holding = lambda folders, *rest: looked.append(len(folders)) or real(folders, *rest)
    ledger.record(batch(spark, [(1, 1, "t1", "m", "2.00", 0)]), "two")
    assert looked == [1] and len(ledger.sums.head()["folders"]) > 1
