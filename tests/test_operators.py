"""Operators against golden vectors and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strata.functions.checks import valid_key, well_formed_trace
from strata.functions.labels import label_text, selector_pairs
from strata.operators import audit, changelog, discovery, history, metering, ordered, policy, schedule, search, selection
from strata.operators.workunit import run_work
from strata import InvalidArgument, VersionedTable
from tests.conftest import as_set

# Golden embedding vectors (bucket -> value) of the hash-256 model.
GOLDEN_TEXTS = {
    "great battery life and screen": {
        27: 0.4472135955, 30: 0.4472135955, 101: 0.4472135955, 145: -0.4472135955, 166: -0.4472135955,
    },
    "battery dies too fast": {25: -0.5, 28: 0.5, 30: 0.5, 96: 0.5},
    "the screen is gorgeous and bright": {
        27: 0.408248290464, 52: -0.408248290464, 71: -0.408248290464,
        73: 0.408248290464, 125: 0.408248290464, 145: -0.408248290464,
    },
    "": {},
    "Battery BATTERY battery": {30: 1.0},
}


def test_embedding_golden(spark):
    texts = list(GOLDEN_TEXTS)
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in search.embed(frame, "text").collect():
        wanted = GOLDEN_TEXTS[texts[row.id]]
        assert len(row.embedding) == 256
        for bucket, value in enumerate(row.embedding):
            assert value == pytest.approx(wanted.get(bucket, 0.0), abs=1e-6)


def test_search_is_brute_force_in_pieces(spark, monkeypatch):
    words = "battery screen bright fast slow life good bad big small".split()
    pick = random.Random(5)
    corpus = [(n, " ".join(pick.choices(words, k=pick.randint(0, 6)))) for n in range(80)]
    asked = [(n, " ".join(pick.choices(words, k=3))) for n in range(9)]
    c = spark.createDataFrame(corpus, "doc int, text string").repartition(5)
    q = spark.createDataFrame(asked, "query int, words string")
    vec, qec = {}, {}
    for held, frame, name, text in ((vec, c, "doc", "text"), (qec, q, "query", "words")):
        held.update({r[name]: {} for r in frame.collect()})
        for r in search.bucket_weights(frame, name, text).collect():
            held[r[name]][r.bucket] = r.weight

    def score(a, b):
        dot = sum(x * b.get(k, 0) for k, x in a.items())
        size = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
        return dot / size**0.5 if size else 0.0

    wanted = []
    for n, a in qec.items():
        best = sorted(((-score(a, b), d) for d, b in vec.items()))[:4]
        wanted += [(n, d, round(-s, 9), rank) for rank, (s, d) in enumerate(best, 1)]
    for chunk, step in ((2048, 1024), (4, 7)):
        monkeypatch.setattr(search, "QUERY_CHUNK", chunk)
        monkeypatch.setattr(search, "CORPUS_STEP", step)
        found = search.nearest_texts(q, "query", "words", c, "doc", "text", 4)
        assert sorted((r.query, r.doc, round(r.score, 9), r["rank"]) for r in found.collect()) == sorted(wanted)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ordered_log_in_blocks(spark, block):
    pick = random.Random(block)
    data = [(seq, pick.choice(["hot", "hot", "a", None]), pick.randint(0, 9)) for seq in pick.sample(range(200), 60)]
    frame = spark.createDataFrame(data, "seq bigint, k string, v int")
    before = ordered.previous(frame, ["k"], "seq", {"pv": F.col("v"), "ps": F.col("seq")}, block)
    totals = ordered.running(frame, ["k"], "seq", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, block)
    strict = ordered.running(frame, ["k"], "seq", {"m": ("max", F.col("v"))}, block, before_only=True)
    numbered = ordered.positions(frame, ["k"], "seq", block)
    wanted = {}
    for seq, k, v in data:
        mine = sorted((s, x) for s, kk, x in data if kk == k and s <= seq)
        last = mine[-2] if len(mine) > 1 else (None, None)
        earlier = [x for _, x in mine[:-1]]
        wanted[seq] = (
            last[1], last[0], sum(x for _, x in mine), max(x for _, x in mine), max(earlier, default=None), len(mine),
        )
    found = (
        before.select("seq", "pv", "ps")
        .join(totals.select("seq", "s", "m"), "seq")
        .join(strict.select("seq", F.col("m").alias("sm")), "seq")
        .join(numbered.select("seq", "position"), "seq")
    )
    assert {r.seq: tuple(r)[1:] for r in found.collect()} == wanted


def test_exact_positions(spark, monkeypatch):
    pick = random.Random(1)
    data = [("a", pick.expovariate(1) ** 4) for _ in range(5000)] + [("b", float(n % 3)) for n in range(100)] + [("c", 5.0)]
    frame = spark.createDataFrame(data, "k string, v double").repartition(7)
    for ranked_rows, cuts in ((1_000_000, 10_000), (20, 5)):
        monkeypatch.setattr(selection, "CUTS", cuts)
        found = {r.k: r for r in metering.latency_summary(frame, ["k"], "v", ranked_rows=ranked_rows).collect()}
        for k in "abc":
            values = sorted(v for kk, v in data if kk == k)
            n = len(values)
            assert (found[k].n, found[k].p50, found[k].p99) == (n, values[n // 2], values[n * 99 // 100])


@pytest.mark.parametrize("group_limit", [1000, 1])
def test_top_per_group(spark, monkeypatch, group_limit):
    monkeypatch.setattr(selection, "GROUP_LIMIT", group_limit)
    frame = spark.createDataFrame([("a", n) for n in range(20)] + [("b", 1)], "k string, v int")
    assert as_set(selection.top_per_group(frame, ["k"], [F.desc("v")], 2)) == [("a", 18, 2), ("a", 19, 1), ("b", 1, 1)]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d"), (None, "n")], "id int, v string")
    found = history.snapshot_diff(old, new, ["id"], ["v"])
    assert as_set(found, "id", "change") == sorted(
        [(1, "deleted"), (2, "changed"), (3, "unchanged"), (4, "new"), (None, "unchanged")], key=repr
    )


def test_usage_golden(spark):
    events = spark.createDataFrame(
        [("acme", "pipeline.run", 1.0), ("acme", "storage.bytes", 1024.0), ("acme", "pipeline.run", 1.0)],
        "tenant string, meter string, quantity double",
    )
    totals = metering.usage_by_meter(events)
    assert as_set(totals) == [("acme", "pipeline.run", 2.0, 2), ("acme", "storage.bytes", 1024.0, 1)]
    assert metering.usage_of(totals, "acme", "pipeline.run") == 2.0
    assert metering.usage_of(totals, "other", "pipeline.run") == 0.0


def test_counters_ignore_label_order(spark):
    points = spark.sql(
        "select * from values ('m', map('a','1','b','2'), 1.5), ('m', map('b','2','a','1'), 2.0), "
        "('m', map('a','1'), 1.0), ('m', map(), 4.0) as t(name, labels, delta)"
    )
    found = metering.labelled_counters(points).select("name", F.size("labels").alias("n"), F.col("value").cast("double"))
    assert as_set(found) == [("m", 0, 4.0), ("m", 1, 1.0), ("m", 2, 3.5)]
    assert points.select(label_text(F.col("labels"))).first()[0] == "a=1,b=2"


def test_intake_golden(spark):
    points = spark.createDataFrame(
        [("s", 1, "cpu.usage"), ("s", 1, "mem.usage"), ("s", 2, "disk.usage"), ("s", 2, ""), ("z", 1, None)],
        "stream string, batch bigint, name string",
    )
    assert as_set(metering.cumulative_intake(points)) == [("s", 1, 2, 0), ("s", 2, 3, 1), ("z", 1, 0, 1)]


def test_policy_golden(spark):
    requests = spark.createDataFrame(
        [
            (1, "acme", 1, "PERMISSION", None), (2, "acme", 2, "SHARING", "partner"), (3, "acme", 3, "SHARING", "rival"),
            (4, "acme", 4, "QUOTA", None), (5, "acme", 5, "QUOTA", None), (6, "acme", 6, "QUOTA", None),
            (7, "other", 7, "QUOTA", None), (8, "acme", 8, "ELSE", None),
        ],
        "request_id int, tenant string, at int, kind string, counterparty string",
    )
    allow = spark.createDataFrame([("acme", "partner")], "tenant string, counterparty string")
    found = {r.request_id: (r.allowed, r.deny_code) for r in policy.decide(requests, allow, 2).collect()}
    assert found == {
        1: (True, ""), 2: (True, ""), 3: (False, "CROSS_TENANT_DENIED"), 4: (True, ""), 5: (True, ""),
        6: (False, "QUOTA_EXCEEDED"), 7: (True, ""), 8: (False, "POLICY_FORBIDDEN"),
    }


def test_access_golden(spark):
    requests = spark.createDataFrame(
        [("alice", "pipeline.run"), ("bob", "pipeline.run"), ("", "pipeline.run"), ("eve", "x"), ("bob", "x"), (None, "x")],
        "subject string, action string",
    )
    people = spark.createDataFrame(
        [("alice", ["admin", "runner"]), ("bob", ["viewer"])], "subject string, roles array<string>"
    )
    needed = spark.createDataFrame([("pipeline.run", "runner"), ("plane.create", "admin")], "action string, role string")
    found = [(r.subject, r.action, r.deny_code) for r in policy.authorize(requests, people, needed).collect()]
    assert sorted(found, key=repr) == sorted(
        [
            ("alice", "pipeline.run", ""), ("bob", "pipeline.run", "INSUFFICIENT_ROLE"),
            ("", "pipeline.run", "NOT_AUTHENTICATED"), ("eve", "x", "NOT_AUTHENTICATED"),
            ("bob", "x", "ACTION_FORBIDDEN"), (None, "x", "NOT_AUTHENTICATED"),
        ],
        key=repr,
    )


@pytest.mark.parametrize("block", [2, 1000])
def test_audit_chain(spark, block):
    pick = random.Random(block)
    data, heads, stored = [], {"c0": "h-start"}, {("c0", "old")}
    wanted = {}
    for chain in ("c0", "c1", "c2", "c3"):
        head, known, broken = heads.get(chain, ""), {i for c, i in stored if c == chain}, False
        for n, seq in enumerate(sorted(pick.sample(range(100), 14))):
            rid = "old" if chain == "c0" and n == 3 else f"{chain}-{n - (pick.random() < 0.3)}"
            good = pick.random() < 0.93 or chain == "c1"
            prev, own = (head if good else "bad"), f"h-{chain}-{seq}"
            data.append((chain, seq, rid, prev, own))
            if broken:
                wanted[chain, seq] = audit.CHAIN_BREAK
            elif rid in known:
                wanted[chain, seq] = audit.DUPLICATE
            elif prev != head:
                wanted[chain, seq], broken = audit.CHAIN_BREAK, True
            else:
                wanted[chain, seq], head = audit.COMMITTED, own
                known.add(rid)
        heads[chain] = head
    batch = spark.createDataFrame(data, "chain_id string, seq bigint, id string, prev_hash string, record_hash string")
    start = spark.createDataFrame([("c0", "h-start")], "chain_id string, head_hash string")
    committed = spark.createDataFrame(list(stored), "chain_id string, id string")
    verdicts = audit.verify_chain(batch, start, committed, block)
    assert {(r.chain_id, r.seq): r.status for r in verdicts.collect()} == wanted
    ends = {r.chain_id: r.head_hash for r in audit.chain_heads(batch, verdicts).collect()}
    assert all(heads[c] == h for c, h in ends.items())


def test_changelog_golden(spark):
    log = spark.createDataFrame(
        [("app/config", "v1", 1), ("app/config", "v2", 2), ("app/state", "s1", 3), ("sys/leader", "node-1", 4)],
        "key string, value string, revision bigint",
    )
    assert as_set(changelog.current(log)) == [("app/config", "v2", 2), ("app/state", "s1", 3), ("sys/leader", "node-1", 4)]
    assert [r.key for r in changelog.list_keys(log, "app/").collect()] == ["app/config", "app/state"]
    assert [r.revision for r in changelog.since(log, 1).collect()] == [1, 2, 3, 4]
    assert [r.revision for r in changelog.since(log, 2, "app/").collect()] == [2, 3]
    assert changelog.since(log, 0).count() == 0


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_number_changes(spark, block):
    changes = spark.createDataFrame([(n * n,) for n in range(20)], "seq bigint").repartition(5)
    found = changelog.number_changes(changes, "seq", after=7, block_rows=block)
    assert as_set(found) == [(n * n, 8 + n) for n in sorted(range(20), key=lambda n: repr((n * n, 8 + n)))]


def test_unknown_model_and_repeated_queries(spark):
    texts = spark.createDataFrame([(1, "a"), (1, "b")], "id int, text string")
    with pytest.raises(InvalidArgument):
        search.embed(texts, "text", "no-such-model")
    with pytest.raises(InvalidArgument):
        search.nearest_texts(texts, "id", "text", texts.withColumnRenamed("id", "doc"), "doc", "text", 1)


def test_create_if_absent(spark):
    requests = spark.createDataFrame([(5, "a"), (6, "a"), (7, "b"), (9, "c")], "seq bigint, key string")
    state = spark.createDataFrame([("b", 2)], "key string, revision bigint")
    assert as_set(changelog.create_if_absent(requests, state)) == [
        (5, "a", True, 5), (6, "a", False, 5), (7, "b", False, 2), (9, "c", True, 9),
    ]


@pytest.mark.parametrize("seed,block", [(1, 2), (2, 7), (3, 1000), (4, 1000), (5, 50)])
def test_compare_and_set(spark, seed, block):
    pick = random.Random(seed)
    state = {"k0": 3, "k1": 5}
    writes, wanted, now, rejected = [], {}, dict(state), []
    for seq in range(10, 260):
        key = pick.choice(["k0", "k0", "k0", "k1", "k2"])
        current = now.get(key, 0)
        guess = pick.random()
        recent = [s for s, k, _ in writes[-12:] if k == key] or [1]
        if_revision = 0 if guess < 0.08 else current if guess < 0.75 else pick.choice([*recent, *rejected[-3:]])
        writes.append((seq, key, if_revision))
        if if_revision == 0 or if_revision == current:
            now[key] = seq
            wanted[seq] = (True, seq)
        else:
            rejected.append(seq)
            wanted[seq] = (False, current)
    frame = spark.createDataFrame(writes, "seq bigint, key string, if_revision bigint")
    held = spark.createDataFrame(list(state.items()), "key string, revision bigint")
    found = changelog.compare_and_set(frame, held, block)
    assert {r.seq: (r.committed, r.revision) for r in found.collect()} == wanted


def test_keys_and_traces(spark):
    keys = ["a/b", "", "a" * 512, "a" * 513, "é" * 257, "a\x00b", "a\x1fb", "../x", "a/./b", "a/..", "..\\x", "a..b", "...", None]
    good = spark.createDataFrame([(k,) for k in keys], "k string").select(
        valid_key(F.col("k")), valid_key(F.col("k"), allow_empty=True)
    )
    found = [tuple(r) for r in good.collect()]
    assert [g for g, _ in found] == [True, False, True, False, False, False, False, False, False, False, False, True, True, False]
    assert found[1][1] is True
    traces = ["00-" + "c" * 32 + "-" + "d" * 16 + "-01", "00-c-d-01", "", None, "00-" + "c" * 32 + "-" + "d" * 16 + "-01-"]
    found = spark.createDataFrame([(t,) for t in traces], "t string").select(well_formed_trace(F.col("t"))).collect()
    assert [r[0] for r in found] == [True, False, False, False, False]


def test_selectors(spark):
    texts = [" a = 1 ,b=2", "b=2,a=0,a=1", "x,=3,,a=1=2", "", None, "  "]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select(selector_pairs(F.col("s"))).collect()
    assert [[tuple(p) for p in r[0]] for r in found] == [
        [("a", "1"), ("b", "2")], [("a", "1"), ("b", "2")], [("a", "1=2")], [], [], [],
    ]


def test_select_provider(spark):
    providers = spark.sql(
        "select * from values (1,'q',map('env','prod','zone','a')),(2,'q',map('env','prod')),(3,'q',map()),"
        "(4,'r',map('env','dev')) as t(provider, capability, labels)"
    )
    requests = spark.createDataFrame(
        [(1, "q", "env=prod,zone=a"), (2, "q", "env=prod"), (3, "q", ""), (4, "q", "env=x"), (5, "r", None), (6, "none", ""),
         (7, "q", "env="), (8, "r", "env=dev,zone=")],
        "request_id int, capability string, selector string",
    )
    assert as_set(discovery.select_provider(requests, providers)) == [
        (1, 1, "SELECTED", 1), (2, 2, "AMBIGUOUS", None), (3, 3, "AMBIGUOUS", None), (4, 0, "NO_MATCH", None),
        (5, 1, "SELECTED", 4), (6, 0, "NO_MATCH", None), (7, 1, "SELECTED", 3), (8, 1, "SELECTED", 4),
    ]


def test_search_listings(spark):
    listings = spark.createDataFrame(
        [("eng", "engine", "SQL engine", ["scan"]), ("fmt", "format", "Parquet", ["vend"]), ("none", "format", "x", [])],
        "plugin_id string, kind string, description string, required_capabilities array<string>",
    )
    ids = lambda frame: sorted(r.plugin_id for r in frame.collect())
    assert ids(discovery.search(listings)) == ["eng", "fmt", "none"]
    assert ids(discovery.search(listings, kind="format")) == ["fmt", "none"]
    assert ids(discovery.search(listings, text="sql")) == ["eng"]
    assert ids(discovery.search(listings, available=["vend", "y"])) == ["fmt", "none"]


def test_schedule(spark):
    triggers = spark.createDataFrame([("A", 90), ("B", 90), ("C", 700), ("D", 0), ("E", 90)], "trigger_id string, at_unix_ms bigint")
    one = lambda t: spark.createDataFrame([(t,)], "trigger_id string")
    assert as_set(schedule.due_triggers(triggers, one("B"), one("E"), 100)) == [("A", 100)]
    log = spark.createDataFrame(
        [("runs/000001", '{"tick":1,"status":"success","snapshot":"s@v1","error":""}', 1)], "key string, value string, revision bigint"
    )
    assert as_set(schedule.run_records(log)) == [("runs/000001", 1, 1, "success", "s@v1", "")]
    twice = spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (2, 7, "z")], "event_id int, at int, v string")
    assert as_set(schedule.deduplicate(twice, "at")) == [(1, 5, "x"), (2, 7, "z")]


def test_work_unit(spark, folder):
    def double(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pc.multiply(batch.column(0), 2)], ["v"])

    def fail(batches):
        raise ValueError("worker says no")
        yield

    table = VersionedTable(spark, folder)
    done = run_work(spark.range(10).repartition(3), double, "v bigint", table)
    assert done.ok and done.rows == 10 and table.read().agg(F.sum("v")).first()[0] == 90
    failed = run_work(spark.range(10), fail, "v bigint", table)
    assert not failed.ok and failed.rows is None and "worker says no" in failed.error
    assert table.read().count() == 10


def test_order_statistics_of_odd_numbers(spark):
    """NaN, infinities, the ends of bigint, no group and no rows."""
    inf, nan = float("inf"), float("nan")
    odd = [1.0, nan, inf, -inf, 2.0, nan, inf, -inf, 3.0, 1e308, -1e308, 5e-324] * 10
    place = lambda data, a, b: sorted(data, key=lambda x: (x != x, x))[len(data) * a // b]
    for data, kind in ((odd, "double"), ([-(2**63), 2**63 - 1, 0, 1, 2**62] * 12, "bigint"), ([7] * 50, "int"), ([nan] * 40, "double")):
        frame = spark.createDataFrame([(v,) for v in data], f"v {kind}")
        (row,) = selection.exact_positions(frame, [], "v", {"p50": (1, 2), "p90": (9, 10)}, ranked_rows=5).collect()
        assert row["n"] == len(data) and repr((row["p50"], row["p90"])) == repr((place(data, 1, 2), place(data, 9, 10)))
    assert selection.exact_positions(spark.createDataFrame([], "v double"), [], "v", {"p50": (1, 2)}).count() == 0


def test_as_of_join(spark):
    facts = [("a", 5, 1), ("a", 10, 2), ("a", 30, 3), ("b", 1, 4), (None, 7, 5), ("a", None, 6), ("a", 10, 7)]
    versions = [("a", 10, 20, "x"), ("a", 25, None, "y"), (None, 7, None, "n"), ("a", None, None, "never"), ("a", 10, 20, "w")]
    joined = history.as_of_join(
        spark.createDataFrame(facts, "k string, at long, id int"),
        spark.createDataFrame(versions, "k string, since long, till long, v string"),
        ["k"], "at", "since", ["v"], until="till", block_rows=3,
    )
    assert dict(as_set(joined, "id", "v")) == {1: None, 2: "x", 3: "y", 4: None, 5: "n", 6: None, 7: "x"}
    ended = history.as_of_join(
        spark.createDataFrame([("a", 22, 1)], "k string, at long, id int"),
        spark.createDataFrame(versions, "k string, since long, till long, v string"),
        ["k"], "at", "since", ["v"], until="till", block_rows=3,
    )
    assert as_set(ended, "v") == [(None,)]


def test_as_of_join_compares_by_value_whatever_the_types(spark):
    def joined(facts, versions, fact_type, version_type, until=None):
        one = spark.createDataFrame([("k", f, i) for i, f in enumerate(facts)], "k string, f string, id int")
        other = spark.createDataFrame([("k", v, t, f"v{i}") for i, (v, t) in enumerate(versions)], "k string, v string, t string, name string")
        found = history.as_of_join(
            one.withColumn("f", F.col("f").cast(fact_type)),
            other.withColumns({"v": F.col("v").cast(version_type), "t": F.col("t").cast(version_type)}),
            ["k"], "f", "v", ["name"], until=until, block_rows=2,
        )
        return [name for _, name in as_set(found, "id", "name")]

    days = [("2023-06-01", None), ("2024-01-01", None), ("2030-01-01", None)]
    assert joined(["2024-05-01 10:00:00", "2023-12-31 23:59:59", "2022-01-01 00:00:00"], days, "timestamp", "date") == ["v1", "v0", None]
    assert joined(["2024-01-01", "2029-12-31"], days, "date", "timestamp") == ["v1", "v1"]
    assert joined(["1.2", "1.7", "1.9", "-0.5"], [("1.7", None), ("1.0", None)], "double", "double") == ["v1", "v0", "v0", None]
    assert joined(["1", "2"], [("1.5", None), ("0.5", None)], "int", "decimal(5,2)") == ["v1", "v0"]
    text = [("2026-01-01", "2026-02-01"), ("2026-02-01", ""), ("", "")]
    assert joined(["2026-01-15", "2026-02-01", "2025-01-01", "2027-01-01"], text, "string", "string", "t") == ["v0", "v1", None, "v1"]
    assert joined(["2026-01-15", "2026-02-01", "2025-01-01", "2027-01-01"], text, "date", "string", "t") == ["v0", "v1", None, "v1"]
    for wrong in (("double", "date"), ("int", "string")):
        with pytest.raises(InvalidArgument, match="do not compare"):
            joined([], [], *wrong)


def test_no_block_of_an_as_of_join_holds_a_hot_key(spark, monkeypatch):
    """All facts at one moment, all versions of one key."""
    facts = spark.range(2000).select(F.lit("k").alias("k"), F.lit(5).alias("at"), F.col("id"))
    versions = spark.range(500).select(F.lit("k").alias("k"), (F.col("id") % 5).alias("since"), F.col("id").alias("v"))
    seen, real = [], history.running

    def spy(log, keys, order, measures, block_rows):
        seen.append(log.groupBy(F.floor(F.col(order) / block_rows)).count().agg(F.max("count")).first()[0])
        return real(log, keys, order, measures, block_rows)

    monkeypatch.setattr(history, "running", spy)
    joined = history.as_of_join(facts, versions, ["k"], "at", "since", ["v"], block_rows=100)
    assert joined.groupBy("v").count().collect() == [(499, 2000)] and seen == [100]


def test_one_verdict_for_each_request(spark):
    subjects = [("ann", ["viewer"]), ("ann", ["runner"]), ("ann", None), ("bob", None), ("cat", []), ("cat", ["viewer"] * 3)]
    roles = [("run", "runner"), ("run", "admin"), ("see", "viewer"), ("none", None)]
    requests = [("ann", "run"), ("ann", "see"), ("cat", "run"), ("cat", "see"), ("bob", "see"), ("ann", "none"), ("ann", "gone"), ("ann", "run")]
    found = policy.authorize(
        spark.createDataFrame(requests, "subject string, action string"),
        spark.createDataFrame(subjects, "subject string, roles array<string>"),
        spark.createDataFrame(roles, "action string, role string"),
    )
    assert as_set(found, "subject", "action", "deny_code") == sorted(
        [
            ("ann", "run", ""), ("ann", "run", ""), ("ann", "see", ""), ("cat", "run", "INSUFFICIENT_ROLE"), ("cat", "see", ""),
            ("bob", "see", "NOT_AUTHENTICATED"), ("ann", "none", "ACTION_FORBIDDEN"), ("ann", "gone", "ACTION_FORBIDDEN"),
        ],
        key=repr,
    )
