"""Operational datasets: metering, policy, audit, change logs, triggers, discovery."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from strata.functions.checks import valid_key, well_formed_trace
from strata.functions.hashing import record_hash
from strata.functions.labels import label_text
from strata.operators import audit, changelog, discovery, ledger, metering, ordered, policy, schedule
from strata.operators.workunit import run_work
from strata.session import workspace
from strata.streaming.events import tumbling_counts
from suite.registry import load, registered
from suite.sources import fresh


def events_by_tenant(spark, sf_dir):
    """Events with their user's market segment as tenant."""
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey")
    joined = load(spark, sf_dir, "events").join(people, "user_id", "left")
    return joined.withColumn("tenant", F.coalesce("c_mktsegment", F.lit("UNKNOWN")))


TENANTS = """tenants AS (SELECT e.*, c_nationkey, coalesce(c_mktsegment, 'UNKNOWN') AS tenant
FROM events e LEFT JOIN customer ON user_id = c_custkey)"""


def usage_events(spark, sf_dir):
    return events_by_tenant(spark, sf_dir).select(
        "tenant",
        F.col("event_type").alias("meter"),
        F.col("value").cast("decimal(18,2)").alias("quantity"),
        F.from_json("props", "map<string,string>").alias("dimensions"),
    )


def as_double(frame, *columns):
    return frame.withColumns({c: F.col(c).cast("double") for c in columns})


@registered(
    "usage_by_meter",
    f"""WITH {TENANTS} SELECT tenant, event_type AS meter, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
    count(*) AS recorded FROM tenants GROUP BY tenant, event_type""",
)
def usage_by_meter(spark, sf_dir):
    return as_double(metering.usage_by_meter(usage_events(spark, sf_dir)), "quantity")


@registered(
    "usage_by_dimension",
    f"""WITH {TENANTS} SELECT tenant, event_type AS meter, 'k' AS dimension, json_extract_string(props, '$.k') AS dimension_value,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS recorded
    FROM tenants WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL""",
)
def usage_by_dimension(spark, sf_dir):
    return as_double(metering.usage_by_dimension(usage_events(spark, sf_dir)), "quantity")


@registered(
    "ledger_totals",
    f"""WITH {TENANTS}, corrected AS (SELECT
      CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN 'MOVED' ELSE tenant END AS tenant,
      CASE WHEN event_type = 'click' AND user_id % 4 = 0 THEN NULL WHEN event_type = 'purchase' THEN 2 * CAST(value AS DECIMAL(18,2))
        ELSE CAST(value AS DECIMAL(18,2)) END AS quantity, event_type AS meter FROM tenants)
    SELECT tenant, meter, CAST(sum(quantity) AS DOUBLE) AS quantity, count(*) AS recorded FROM corrected
    WHERE quantity IS NOT NULL GROUP BY tenant, meter""",
)
def ledger_totals(spark, sf_dir):
    """Three batches of events and one of corrections: purchases count double, some
    clicks are taken back, some views were another tenant's. One batch comes twice."""
    events = events_by_tenant(spark, sf_dir).select(
        "event_id", "ts", "tenant", F.col("event_type").alias("meter"), F.col("value").cast("decimal(18,2)").alias("quantity"), "user_id"
    )
    kept = ledger.Ledger(spark, workspace(spark, "ledger"), 8)
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for batch in (0, 1, 0, 2):
        kept.record(events.where(third == batch), f"batch-{batch}")
    taken_back = (F.col("meter") == "click") & (F.col("user_id") % 4 == 0)
    moved = (F.col("meter") == "view") & (F.col("user_id") % 3 == 0)
    corrections = events.where((F.col("meter") == "purchase") | taken_back | moved).select(
        "event_id", "ts", F.when(moved, "MOVED").otherwise(F.col("tenant")).alias("tenant"), "meter",
        F.when(~taken_back, F.col("quantity") * F.when(F.col("meter") == "purchase", 2).otherwise(1)).alias("quantity"),
    )
    kept.record(corrections, "corrections")
    return as_double(kept.totals(), "quantity")


@registered(
    "labelled_counters",
    f"""WITH {TENANTS} SELECT event_type AS name,
    'big=' || CASE WHEN value > 20 THEN 'yes' ELSE 'no' END || ',tenant=' || tenant AS labels,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM tenants GROUP BY 1, 2""",
)
def labelled_counters(spark, sf_dir):
    """Label maps arrive in either order and must count as one set."""
    tenant = (F.lit("tenant"), F.col("tenant"))
    big = F.col("value") > 20
    points = events_by_tenant(spark, sf_dir).select(
        F.col("event_type").alias("name"),
        F.when(big, F.create_map(*tenant, F.lit("big"), F.lit("yes")))
        .otherwise(F.create_map(F.lit("big"), F.lit("no"), *tenant))
        .alias("labels"),
        F.col("value").cast("decimal(18,2)").alias("delta"),
    )
    counted = metering.labelled_counters(points)
    return as_double(counted.select("name", label_text(F.map_from_entries("labels")).alias("labels"), "value"), "value")


@registered(
    "latency_summary_all",
    """WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS spot, count(*) OVER () AS n FROM events)
    SELECT max(n) AS n, round(avg(value), 6) AS mean, max(CASE WHEN spot = n // 2 THEN value END) AS p50,
           max(CASE WHEN spot = (n * 99) // 100 THEN value END) AS p99 FROM r""",
)
def latency_summary_all(spark, sf_dir):
    """All samples as one group, in ranges of 500 rows at most."""
    summary = metering.latency_summary(load(spark, sf_dir, "events"), [], "value", ranked_rows=500)
    return summary.withColumn("mean", F.round("mean", 6))


@registered(
    "latency_summary",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS spot,
                         count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, max(CASE WHEN spot = n // 2 THEN value END) AS p50,
           max(CASE WHEN spot = (n * 99) // 100 THEN value END) AS p99 FROM r GROUP BY event_type""",
)
def latency_summary(spark, sf_dir):
    summary = metering.latency_summary(load(spark, sf_dir, "events"), ["event_type"], "value")
    return summary.withColumn("mean", F.round("mean", 6))


@registered(
    "telemetry_validate",
    """WITH p AS (SELECT user_id AS stream, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS batch,
                 CASE WHEN event_type = 'error' AND value < 5 THEN '' ELSE event_type END AS name FROM events),
    b AS (SELECT stream, batch, count(*) FILTER (name <> '') AS ok, count(*) FILTER (name = '') AS bad FROM p GROUP BY 1, 2)
    SELECT stream, batch, CAST(sum(ok) OVER w AS BIGINT) AS accepted, CAST(sum(bad) OVER w AS BIGINT) AS rejected
    FROM b WINDOW w AS (PARTITION BY stream ORDER BY batch)""",
)
def telemetry_validate(spark, sf_dir):
    points = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("batch"),
        F.when((F.col("event_type") == "error") & (F.col("value") < 5), "").otherwise(F.col("event_type")).alias("name"),
    )
    return metering.cumulative_intake(points)


# -- policy --------------------------------------------------------------------

# Which role an action needs, and the roles of a market segment.
ACTION_ROLES = [("click", "viewer"), ("purchase", "runner"), ("signup", "admin"), ("view", "viewer")]
SEGMENT_ROLES = {
    "BUILDING": ["admin", "runner", "viewer"],
    "MACHINERY": ["runner", "viewer"],
    "FURNITURE": ["viewer"],
    "HOUSEHOLD": ["viewer"],
}
JUDGED = f"""subjects AS (SELECT CAST(c_custkey AS VARCHAR) AS subject, CASE c_mktsegment
    {" ".join(f"WHEN '{s}' THEN {roles}" for s, roles in SEGMENT_ROLES.items())} ELSE [] END AS roles
  FROM customer WHERE c_acctbal >= 0),
needed AS (SELECT * FROM (VALUES {", ".join(str(pair) for pair in ACTION_ROLES)}) AS t(action, role)),
judged AS (SELECT e.*, CAST(user_id AS VARCHAR) AS subject, event_type AS action,
    CASE WHEN roles IS NULL THEN 'NOT_AUTHENTICATED' WHEN role IS NULL THEN 'ACTION_FORBIDDEN'
         WHEN NOT list_contains(roles, role) THEN 'INSUFFICIENT_ROLE' ELSE '' END AS deny_code
  FROM events e LEFT JOIN subjects s ON s.subject = CAST(user_id AS VARCHAR) LEFT JOIN needed ON action = event_type)"""


def access_requests(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("subject"),
        F.col("event_type").alias("action"),
        "value",
        "user_id",
    )


def judged_access(spark, sf_dir):
    roles = F.array().cast("array<string>")
    for segment, held in SEGMENT_ROLES.items():
        roles = F.when(F.col("c_mktsegment") == segment, F.array(*[F.lit(r) for r in held])).otherwise(roles)
    subjects = load(spark, sf_dir, "customer").where("c_acctbal >= 0")
    subjects = subjects.select(F.col("c_custkey").cast("string").alias("subject"), roles.alias("roles"))
    needed = spark.createDataFrame(ACTION_ROLES, "action string, role string")
    return policy.authorize(access_requests(spark, sf_dir), subjects, needed)


@registered(
    "access_review",
    f"WITH {JUDGED} SELECT event_id, subject, action, deny_code = '' AS allowed, deny_code FROM judged",
)
def access_review(spark, sf_dir):
    return judged_access(spark, sf_dir).select("event_id", "subject", "action", "allowed", "deny_code")


TRACE_SQL = """CASE WHEN event_type = 'error' AND value < 10 THEN '00-' || md5(CAST(event_id AS VARCHAR))
  ELSE '00-' || md5(CAST(event_id AS VARCHAR)) || '-' || substr(md5(CAST(user_id AS VARCHAR)), 1, 16) || '-01' END"""


def trace_id():
    full = F.concat_ws(
        "-",
        F.lit("00"),
        F.md5(F.col("event_id").cast("string")),
        F.substring(F.md5(F.col("user_id").cast("string")), 1, 16),
        F.lit("01"),
    )
    cut = F.concat_ws("-", F.lit("00"), F.md5(F.col("event_id").cast("string")))
    return F.when((F.col("action") == "error") & (F.col("value") < 10), cut).otherwise(full)


@registered(
    "trace_check",
    f"SELECT event_id, NOT (event_type = 'error' AND value < 10) AS well_formed, length({TRACE_SQL}) AS length FROM events",
)
def trace_check(spark, sf_dir):
    traced = access_requests(spark, sf_dir).withColumn("trace", trace_id())
    return traced.select(
        "event_id", well_formed_trace(F.col("trace")).alias("well_formed"), F.length("trace").cast("bigint").alias("length")
    )


@registered(
    "outcome_counts",
    f"""WITH {JUDGED} SELECT action AS capability, CASE WHEN event_type = 'error' AND value < 10 THEN 'invalid_trace'
      WHEN deny_code <> '' THEN 'permission_denied' WHEN value > 100 THEN 'selection_failed' ELSE 'allow' END AS outcome,
      count(*) AS calls FROM judged GROUP BY 1, 2""",
)
def outcome_counts(spark, sf_dir):
    calls = judged_access(spark, sf_dir).withColumn("trace", trace_id())
    outcome = (
        F.when(~well_formed_trace(F.col("trace")), "invalid_trace")
        .when(~F.col("allowed"), "permission_denied")
        .when(F.col("value") > 100, "selection_failed")
        .otherwise("allow")
    )
    return metering.outcome_counts(calls.select(F.col("action").alias("capability"), outcome.alias("outcome")))


QUOTA_LIMIT = 500
KINDS = {"purchase": "QUOTA", "signup": "QUOTA", "view": "PERMISSION", "click": "SHARING"}


@registered(
    "quota_decisions_nulls",
    f"""WITH r AS (SELECT event_id AS request_id, CASE WHEN user_id % 3 > 0 THEN 'T' || user_id % 3 END AS tenant, ts,
             CASE WHEN event_id % 5 > 0 THEN 'C' || event_id % 5 END AS counterparty,
             CASE WHEN event_type = 'purchase' THEN 'QUOTA' ELSE 'SHARING' END AS kind FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY tenant, kind ORDER BY ts, request_id) AS nth FROM r)
    SELECT request_id, tenant, kind, CASE WHEN kind = 'SHARING' THEN
      CASE WHEN tenant IS NULL AND (counterparty IS NULL OR counterparty = 'C1') THEN '' ELSE 'CROSS_TENANT_DENIED' END
      WHEN nth > 20 THEN 'QUOTA_EXCEEDED' ELSE '' END AS deny_code FROM n""",
)
def quota_decisions_nulls(spark, sf_dir):
    """A third of the requests name no tenant: they share a quota and an allow list."""
    tenant = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("T"), (F.col("user_id") % 3).cast("string")))
    other = F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("C"), (F.col("event_id") % 5).cast("string")))
    kind = F.when(F.col("event_type") == "purchase", "QUOTA").otherwise("SHARING")
    requests = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), tenant.alias("tenant"), F.col("ts").alias("at"), kind.alias("kind"), other.alias("counterparty")
    )
    allow = spark.createDataFrame([(None, None), (None, "C1")], "tenant string, counterparty string")
    return policy.decide(requests, allow, 20).select("request_id", "tenant", "kind", "deny_code")


@registered(
    "quota_decisions",
    f"""WITH {TENANTS},
    r AS (SELECT event_id AS request_id, tenant, ts, 'NATION_' || c_nationkey AS counterparty, CASE event_type
            {" ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items())} ELSE 'OTHER' END AS kind FROM tenants),
    pairs AS (SELECT DISTINCT c_mktsegment AS tenant, 'NATION_' || c_nationkey AS counterparty FROM customer WHERE c_acctbal > 9000),
    n AS (SELECT r.*, row_number() OVER (PARTITION BY tenant, kind ORDER BY ts, request_id) AS nth FROM r),
    d AS (SELECT request_id, n.tenant, kind, CASE kind WHEN 'PERMISSION' THEN ''
          WHEN 'SHARING' THEN CASE WHEN p.tenant IS NULL THEN 'CROSS_TENANT_DENIED' ELSE '' END
          WHEN 'QUOTA' THEN CASE WHEN nth > {QUOTA_LIMIT} THEN 'QUOTA_EXCEEDED' ELSE '' END
          ELSE 'POLICY_FORBIDDEN' END AS deny_code
          FROM n LEFT JOIN pairs p ON p.tenant = n.tenant AND p.counterparty = n.counterparty)
    SELECT *, deny_code = '' AS allowed FROM d""",
)
def quota_decisions(spark, sf_dir):
    kind = F.lit("OTHER")
    for event_type, name in KINDS.items():
        kind = F.when(F.col("event_type") == event_type, name).otherwise(kind)
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("counterparty")
    requests = events_by_tenant(spark, sf_dir).select(
        F.col("event_id").alias("request_id"), "tenant", F.col("ts").alias("at"), nation, kind.alias("kind")
    )
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 9000")
    allow = rich.select(F.col("c_mktsegment").alias("tenant"), nation)
    return policy.decide(requests, allow, QUOTA_LIMIT).select("request_id", "tenant", "kind", "deny_code", "allowed")


@registered(
    "share_review",
    """WITH s AS (SELECT sn.n_name AS tenant, cn.n_name AS counterparty, l_quantity, l_discount, l_returnflag
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey),
    listed AS (SELECT DISTINCT tenant, counterparty FROM s WHERE l_quantity = 50 AND l_discount = 0.1 AND l_returnflag = 'R')
    SELECT s.tenant, s.counterparty, l.tenant IS NOT NULL AS allowed,
      CASE WHEN l.tenant IS NULL THEN 'CROSS_TENANT_DENIED' ELSE '' END AS deny_code, count(*) AS requests
    FROM s LEFT JOIN listed l ON s.tenant = l.tenant AND s.counterparty = l.counterparty GROUP BY ALL""",
)
def share_review(spark, sf_dir):
    """Shipments between nations as sharing requests; the allow list comes from
    large, discounted, returned ones."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sellers = load(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    buyers = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    shipped = (
        load(spark, sf_dir, "lineitem")
        .join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sellers.select("s_suppkey", F.col("n_name").alias("tenant")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(buyers.select("c_custkey", F.col("n_name").alias("counterparty")), F.col("o_custkey") == F.col("c_custkey"))
    )
    allow = shipped.where("l_quantity = 50 AND l_discount = 0.1 AND l_returnflag = 'R'").select("tenant", "counterparty")
    # a decision depends on the pair alone, so pairs are counted before they are judged
    pairs = shipped.groupBy("tenant", "counterparty").agg(F.count(F.lit(1)).alias("requests"))
    requests = pairs.withColumns(
        {"kind": F.lit(policy.SHARING), "at": F.lit(0), "request_id": F.concat_ws("/", "tenant", "counterparty")}
    )
    judged = policy.decide(requests, allow, quota_limit=1)
    return judged.select("tenant", "counterparty", "allowed", "deny_code", "requests")


# -- audit chains ------------------------------------------------------------------


@registered(
    "audit_chain_nulls",
    """WITH b AS (SELECT CASE WHEN user_id % 4 > 0 THEN user_id % 4 END AS chain_id, event_id AS seq,
             CASE WHEN event_id % 3 > 0 THEN event_id // 2 END AS id FROM events),
    m AS (SELECT *, row_number() OVER (PARTITION BY chain_id, id ORDER BY seq) > 1 AS repeated FROM b)
    SELECT chain_id, seq, id, CASE WHEN repeated THEN 'DUPLICATE' ELSE 'COMMITTED' END AS status FROM m""",
)
def audit_chain_nulls(spark, sf_dir):
    """Records without an id or a chain get a verdict too; the links all hold."""
    chain = F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4)
    name = F.when(F.col("event_id") % 3 > 0, F.floor(F.col("event_id") / 2))
    batch = load(spark, sf_dir, "events").select(
        chain.alias("chain_id"), F.col("event_id").alias("seq"), name.alias("id"), F.lit("").alias("prev_hash"), F.lit("").alias("record_hash")
    )
    return audit.verify_chain(batch)


@registered(
    "audit_chain_verify",
    """WITH h AS (SELECT *, sha256('["' || event_id || '","' || user_id || '","' || event_type || '"]') AS record_hash FROM events),
    l AS (SELECT *, CASE WHEN event_type = 'error' AND value > 120 THEN 'forged'
                    ELSE coalesce(lag(record_hash) OVER (PARTITION BY user_id ORDER BY event_id), '') END AS prev_hash FROM h),
    batch AS (SELECT user_id AS chain_id, event_id * 2 AS seq, event_id AS id, prev_hash, record_hash FROM l
              UNION ALL SELECT user_id, event_id * 2 + 1, event_id, prev_hash, record_hash FROM l WHERE event_type = 'click'),
    m AS (SELECT *, row_number() OVER (PARTITION BY chain_id, id ORDER BY seq) > 1 AS repeated FROM batch),
    e AS (SELECT chain_id, seq, coalesce(lag(record_hash) OVER (PARTITION BY chain_id ORDER BY seq), '') <> prev_hash AS broken
          FROM m WHERE NOT repeated),
    b AS (SELECT chain_id, min(seq) AS broken_at FROM e WHERE broken GROUP BY chain_id)
    SELECT m.chain_id, seq, id, CASE WHEN seq >= broken_at THEN 'REJECTED:CHAIN_BREAK' WHEN repeated THEN 'DUPLICATE'
      ELSE 'COMMITTED' END AS status FROM m LEFT JOIN b ON m.chain_id = b.chain_id""",
)
def audit_chain_verify(spark, sf_dir):
    """One chain per user; clicks are delivered twice and large errors are forged."""
    fields = [F.col("event_id"), F.col("user_id"), F.col("event_type")]
    hashed = load(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", record_hash(fields).alias("record_hash")
    )
    linked = ordered.previous(hashed, ["user_id"], "event_id", {"before_hash": F.col("record_hash")})
    forged = (F.col("event_type") == "error") & (F.col("value") > 120)
    linked = linked.withColumn(
        "prev_hash", F.when(forged, "forged").otherwise(F.coalesce("before_hash", F.lit("")))
    )
    delivered = linked.select("*", F.explode(F.when(F.col("event_type") == "click", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    batch = delivered.select(
        F.col("user_id").alias("chain_id"),
        (F.col("event_id") * 2 + F.col("copy")).alias("seq"),
        F.col("event_id").alias("id"),
        "prev_hash",
        "record_hash",
    )
    return audit.verify_chain(batch)


# -- change log ---------------------------------------------------------------------


def change_log(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        (F.col("event_id") + 1).alias("revision"),
    )


LOG = "log AS (SELECT event_type || '/' || user_id AS key, props AS value, event_id + 1 AS revision FROM events)"


@registered(
    "changelog_current",
    f"WITH {LOG} SELECT key, arg_max(value, revision) AS value, max(revision) AS revision FROM log GROUP BY key",
)
def changelog_current(spark, sf_dir):
    return changelog.current(change_log(spark, sf_dir))


@registered("changelog_list_prefix", f"WITH {LOG} SELECT DISTINCT key FROM log WHERE starts_with(key, 'purchase/1')")
def changelog_list_prefix(spark, sf_dir):
    return changelog.list_keys(change_log(spark, sf_dir), "purchase/1")


@registered("changelog_since", f"WITH {LOG} SELECT * FROM log WHERE revision >= 100 AND starts_with(key, 'signup/')")
def changelog_since(spark, sf_dir):
    return changelog.since(change_log(spark, sf_dir), 100, "signup/")


@registered(
    "changelog_number",
    """SELECT event_id, event_type || '/' || user_id AS key, row_number() OVER (ORDER BY event_id) AS revision
    FROM events WHERE event_type <> 'error'""",
)
def changelog_number(spark, sf_dir):
    """A backfill: every accepted change gets the next revision of the whole log."""
    accepted = load(spark, sf_dir, "events").where("event_type <> 'error'")
    changes = accepted.select("event_id", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"))
    return changelog.number_changes(changes, "event_id")


@registered(
    "create_if_absent_nulls",
    """WITH k AS (SELECT event_id AS seq, event_type, CASE WHEN user_id % 5 > 0 THEN 'k' || user_id END AS key FROM events),
    state AS (SELECT key, max(seq) AS revision FROM k WHERE event_type = 'signup' AND key IS NOT NULL GROUP BY key),
    r AS (SELECT seq, key, min(seq) OVER (PARTITION BY key) AS first_seq FROM k WHERE event_type <> 'signup')
    SELECT seq, r.key, revision IS NULL AND seq = first_seq AS created, coalesce(revision, first_seq) AS revision
    FROM r LEFT JOIN state ON r.key = state.key""",
)
def create_if_absent_nulls(spark, sf_dir):
    """A fifth of the requests are for the null key, which the first of them creates."""
    key = F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("k"), F.col("user_id").cast("string")))
    keyed = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type", key.alias("key"))
    held = keyed.where("event_type = 'signup' AND key IS NOT NULL").groupBy("key").agg(F.max("seq").alias("revision"))
    return changelog.create_if_absent(keyed.where("event_type <> 'signup'").drop("event_type"), held)


@registered(
    "create_if_absent",
    """WITH k AS (SELECT event_id + 1 AS seq, event_type, 'user/' || user_id || '/' || json_extract_string(props, '$.k') AS key FROM events),
    state AS (SELECT key, max(seq) AS revision FROM k WHERE event_type = 'signup' GROUP BY key),
    r AS (SELECT seq, key, min(seq) OVER (PARTITION BY key) AS first_seq FROM k WHERE event_type <> 'signup')
    SELECT seq, r.key, revision IS NULL AND seq = first_seq AS created, coalesce(revision, first_seq) AS revision
    FROM r LEFT JOIN state USING (key)""",
)
def create_if_absent(spark, sf_dir):
    """Keys that signups have set exist; all other events try to create theirs."""
    keyed = load(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        "event_type",
        F.concat_ws("/", F.lit("user"), F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("key"),
    )
    held = keyed.where("event_type = 'signup'").select("key", F.lit("").alias("value"), F.col("seq").alias("revision"))
    return changelog.create_if_absent(keyed.where("event_type <> 'signup'"), changelog.current(held))


@registered(
    "cas_batch",
    """WITH RECURSIVE
    state AS (SELECT 'user/' || c_custkey AS key, 1 AS revision FROM customer WHERE c_acctbal >= 0),
    w AS (SELECT 'user/' || user_id AS key, event_id + 2 AS seq,
            CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN greatest(coalesce(lag(event_id + 2) OVER u, 1) - 1, 1)
              ELSE coalesce(lag(event_id + 2) OVER u, 1) END AS if_revision, row_number() OVER u AS n
          FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
    walk AS (
      SELECT w.key, n, seq, if_revision = 0 OR if_revision = coalesce(revision, 0) AS committed,
             CASE WHEN if_revision = 0 OR if_revision = coalesce(revision, 0) THEN seq ELSE coalesce(revision, 0) END AS revision
      FROM w LEFT JOIN state ON w.key = state.key WHERE n = 1
      UNION ALL
      SELECT w.key, w.n, w.seq, w.if_revision = 0 OR w.if_revision = walk.revision,
             CASE WHEN w.if_revision = 0 OR w.if_revision = walk.revision THEN w.seq ELSE walk.revision END
      FROM walk JOIN w ON w.key = walk.key AND w.n = walk.n + 1)
    SELECT seq, key, committed, CAST(revision AS BIGINT) AS revision FROM walk""",
)
def cas_batch(spark, sf_dir):
    """Signups write unconditionally, errors expect a revision too low by one,
    everything else the one just before."""
    stored = load(spark, sf_dir, "customer").where("c_acctbal >= 0")
    state = stored.select(
        F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("key"), F.lit(1).cast("bigint").alias("revision")
    )
    keyed = load(spark, sf_dir, "events").select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), (F.col("event_id") + 2).alias("seq"), "event_type"
    )
    paired = ordered.previous(keyed, ["key"], "seq", {"one_back": F.col("seq")})
    one_back = F.coalesce("one_back", F.lit(1))
    expected = (
        F.when(F.col("event_type") == "signup", F.lit(0))
        .when(F.col("event_type") == "error", F.greatest(one_back - 1, F.lit(1)))
        .otherwise(one_back)
    )
    writes = paired.select("seq", "key", expected.cast("bigint").alias("if_revision"))
    return changelog.compare_and_set(writes, state)


@registered(
    "key_validate",
    """WITH k AS (SELECT 'url' AS kind, page_id AS id, url AS key FROM pages
      UNION ALL SELECT 'up', page_id, replace(url, '/fr/', '/../') FROM pages
      UNION ALL SELECT 'html', page_id, html FROM pages
      UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)
    SELECT kind, id, strlen(key) BETWEEN 1 AND 512 AND NOT regexp_matches(key, '[\\x00-\\x1F]')
      AND NOT contains(key, '../') AND NOT contains(key, '..\\')
      AND NOT list_has_any(string_split(key, '/'), ['.', '..']) AS valid FROM k""",
)
def key_validate(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    turns = load(spark, sf_dir, "conversations")
    keys = (
        pages.select(F.lit("url").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("key"))
        .unionByName(pages.selectExpr("'up' AS kind", "page_id AS id", "replace(url, '/fr/', '/../') AS key"))
        .unionByName(pages.selectExpr("'html' AS kind", "page_id AS id", "html AS key"))
        .unionByName(turns.selectExpr("'turn' AS kind", "conv_id * 1000 + turn AS id", "text AS key"))
    )
    return keys.select("kind", "id", valid_key(F.col("key")).alias("valid"))


# -- triggers, runs, events -----------------------------------------------------------

NOW_MS = 1705276800000  # 2024-01-15


@registered(
    "due_triggers",
    f"""SELECT 't-' || event_id AS trigger_id, CAST({NOW_MS} AS BIGINT) AS fired_at_unix_ms FROM events t
    WHERE event_type IN ('click', 'view', 'signup') AND epoch_ms(ts) > 0 AND epoch_ms(ts) <= {NOW_MS}
      AND event_id NOT IN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type IN ('error', 'purchase'))""",
)
def due_triggers(spark, sf_dir):
    """Clicks, views and signups schedule a trigger each; errors cancel the one
    they name and purchases have fired theirs."""
    events = load(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    triggers = events.where("event_type IN ('click', 'view', 'signup')").select(
        F.concat(F.lit("t-"), F.col("event_id").cast("string")).alias("trigger_id"), at.alias("at_unix_ms")
    )
    named = F.concat(F.lit("t-"), F.get_json_object("props", "$.k")).alias("trigger_id")
    cancelled = events.where("event_type = 'error'").select(named)
    fired = events.where("event_type = 'purchase'").select(named)
    return schedule.due_triggers(triggers, cancelled, fired, NOW_MS)


@registered(
    "run_history",
    """WITH r AS (SELECT event_id AS tick, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN event_type = 'error' THEN '' ELSE event_type || '@v' || event_id END AS snapshot,
       CASE WHEN event_type = 'error' THEN props ELSE '' END AS error,
       strftime(ts, '%Y-%m-%d') AS day FROM events)
    SELECT day, status, count(*) AS runs, max(tick) AS last_tick, arg_max(snapshot, tick) AS last_snapshot,
       arg_max(error, tick) AS last_error FROM r GROUP BY day, status""",
)
def run_history(spark, sf_dir):
    """Run records as JSON values in a change log, read back and summed up per day."""
    failed = F.col("event_type") == "error"
    record = F.struct(
        F.col("event_id").alias("tick"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.when(failed, "").otherwise(F.concat_ws("@v", "event_type", F.col("event_id").cast("string"))).alias("snapshot"),
        F.when(failed, F.col("props")).otherwise("").alias("error"),
    )
    log = load(spark, sf_dir, "events").select(
        F.concat(F.lit("runs/"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("key"),
        F.to_json(record).alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("revision"),
    )
    runs = schedule.run_records(log)
    day = F.date_format(F.timestamp_millis("revision"), "yyyy-MM-dd")
    return runs.groupBy(day.alias("day"), "status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max("tick").alias("last_tick"),
        F.max_by("snapshot", "tick").alias("last_snapshot"),
        F.max_by("error", "tick").alias("last_error"),
    )


@registered("events_dedup", "SELECT event_id, user_id, event_type, value, event_id * 2 AS delivery FROM events")
def events_dedup(spark, sf_dir):
    """Clicks and purchases are delivered twice; the first delivery stays."""
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    again = events.where("event_type IN ('click', 'purchase')")
    deliveries = events.withColumn("delivery", F.col("event_id") * 2).unionByName(
        again.withColumn("delivery", F.col("event_id") * 2 + 1)
    )
    return schedule.deduplicate(deliveries, "delivery")


# Who is told about which event.
SUBSCRIPTIONS = [
    ("BUILDING", "error", "page"),
    ("BUILDING", "purchase", "invoice"),
    ("BUILDING", "purchase", "thank"),
    ("MACHINERY", "error", "ticket"),
    ("HOUSEHOLD", "signup", "welcome"),
    ("FURNITURE", "view", "count"),
]


@registered(
    "event_routing",
    f"""WITH {TENANTS}, s AS (SELECT * FROM (VALUES {", ".join(map(str, SUBSCRIPTIONS))}) AS t(tenant, event_type, action))
    SELECT event_id, t.tenant, t.event_type, action FROM tenants t JOIN s ON s.tenant = t.tenant AND s.event_type = t.event_type""",
)
def event_routing(spark, sf_dir):
    subscriptions = spark.createDataFrame(SUBSCRIPTIONS, "tenant string, event_type string, action string")
    events = events_by_tenant(spark, sf_dir).select("event_id", "tenant", "event_type")
    return schedule.route(events, subscriptions).select("event_id", "tenant", "event_type", "action")


@registered(
    "event_order",
    """SELECT event_id, event_type AS partition_key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position
    FROM events""",
)
def event_order(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("partition_key"))
    return schedule.in_order(events, "event_id")


@registered(
    "events_tumbling",
    """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS started, event_type,
    count(*) AS n FROM events GROUP BY 1, 2""",
)
def events_tumbling(spark, sf_dir):
    counts = tumbling_counts(load(spark, sf_dir, "events"), "ts", "6 hours", "1 hour")
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n")


# -- discovery -----------------------------------------------------------------------


@registered(
    "compat_search",
    """SELECT p_name || '-' || p_partkey AS plugin_id, p_type AS kind, p_brand AS description FROM part
    WHERE p_type = 'PROMO' AND (contains(lower(p_name || '-' || p_partkey), 'ring') OR contains(lower(p_brand), 'ring'))
      AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8')
      AND p_size <= 40""",
)
def compat_search(spark, sf_dir):
    """Parts as listings that require their brand and, if large, a lift."""
    listings = load(spark, sf_dir, "part").select(
        F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("plugin_id"),
        F.col("p_type").alias("kind"),
        F.col("p_brand").alias("description"),
        F.when(F.col("p_size") > 40, F.array("p_brand", F.lit("lift"))).otherwise(F.array("p_brand")).alias("required_capabilities"),
    )
    available = ["floor", *[f"Brand#{n}" for n in range(1, 9)]]
    return discovery.search(listings, "RING", "PROMO", available).drop("required_capabilities")


@registered(
    "label_select",
    """WITH r AS (SELECT p_partkey AS request_id, p_type, p_size, p_brand, p_name, p_size > 25 AS by_all, p_size > 10 AS by_brand FROM part),
    a AS (SELECT p_type, p_brand, p_size, p_name, count(*) AS n, min(p_partkey) AS provider FROM part GROUP BY ALL),
    b AS (SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS provider FROM part GROUP BY ALL),
    c AS (SELECT p_type, count(*) AS n, min(p_partkey) AS provider FROM part GROUP BY ALL),
    m AS (SELECT request_id, coalesce(CASE WHEN by_all THEN a.n WHEN by_brand THEN b.n ELSE c.n END, 0) AS matches,
                 CASE WHEN by_all THEN a.provider WHEN by_brand THEN b.provider ELSE c.provider END AS found
          FROM r LEFT JOIN a ON a.p_type = r.p_type AND a.p_brand = r.p_brand AND a.p_size = r.p_size AND a.p_name = r.p_name
                 LEFT JOIN b ON b.p_type = r.p_type AND b.p_brand = r.p_brand LEFT JOIN c ON c.p_type = r.p_type)
    SELECT request_id, matches, CASE matches WHEN 1 THEN 'SELECTED' WHEN 0 THEN 'NO_MATCH' ELSE 'AMBIGUOUS' END AS outcome,
      CASE WHEN matches = 1 THEN found END AS provider FROM m""",
)
def label_select(spark, sf_dir):
    """Every part offers its type under labels and asks for its like: by all
    labels, by brand only (with junk around), or by none."""
    part = load(spark, sf_dir, "part")
    brand, size, name = F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_name")
    providers = part.select(
        F.col("p_partkey").alias("provider"),
        F.col("p_type").alias("capability"),
        F.create_map(F.lit("brand"), brand, F.lit("size"), size, F.lit("name"), name).alias("labels"),
    )
    selector = (
        F.when(F.col("p_size") > 25, F.concat(F.lit("size="), size, F.lit(", brand = "), brand, F.lit(",name="), name))
        .when(F.col("p_size") > 10, F.concat(F.lit("junk,brand=x, brand="), brand, F.lit(" ,=y")))
        .otherwise("  ")
    )
    requests = part.select(
        F.col("p_partkey").alias("request_id"), F.col("p_type").alias("capability"), selector.alias("selector")
    )
    return discovery.select_provider(requests, providers)


# -- work units ------------------------------------------------------------------------


def cents_per_flag(batches):
    """Per batch: cents and rows by return flag."""
    for batch in batches:
        table = pa.table(
            {"flag": batch.column(0), "cents": pc.cast(pc.round(pc.multiply(batch.column(1), 100.0)), pa.int64())}
        )
        sums = table.group_by("flag").aggregate([("cents", "sum"), ("cents", "count")])
        sums = sums.select(["flag", "cents_sum", "cents_count"]).rename_columns(["flag", "cents", "lines"])
        yield from sums.to_batches()


@registered(
    "map_partitions_rows",
    """SELECT l_returnflag AS flag, CAST(sum(CAST(round(l_extendedprice * 100.0) AS BIGINT)) AS BIGINT) AS cents,
    count(*) AS lines FROM lineitem GROUP BY l_returnflag""",
)
def map_partitions_rows(spark, sf_dir):
    table = fresh(spark, "work")
    lines = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    done = run_work(lines, cents_per_flag, "flag string, cents bigint, lines bigint", table)
    if not done.ok:
        raise RuntimeError(done.error)
    return table.read().groupBy("flag").agg(F.sum("cents").alias("cents"), F.sum("lines").alias("lines"))
