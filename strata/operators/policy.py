"""Decisions over request tables: quotas, sharing and access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.matching import join_on
from strata.operators.selection import top_per_group

# Decision kinds and deny codes; "" means allowed.
PERMISSION, SHARING, QUOTA = "PERMISSION", "SHARING", "QUOTA"
CROSS_TENANT_DENIED = "CROSS_TENANT_DENIED"
QUOTA_EXCEEDED = "QUOTA_EXCEEDED"
POLICY_FORBIDDEN = "POLICY_FORBIDDEN"
NOT_AUTHENTICATED = "NOT_AUTHENTICATED"
ACTION_FORBIDDEN = "ACTION_FORBIDDEN"
INSUFFICIENT_ROLE = "INSUFFICIENT_ROLE"


def _judged(frame: DataFrame, columns, deny_code) -> DataFrame:
    return frame.select(*columns, (deny_code == "").alias("allowed"), deny_code.alias("deny_code"))


def quota_marks(requests: DataFrame, limit: int) -> DataFrame:
    """Per tenant with at least ``limit`` quota requests, the last one allowed.
    Only ``limit`` rows of a tenant leave each task."""
    asked = requests.where(F.col("kind") == QUOTA).select("tenant", "at", "request_id")
    first = top_per_group(asked, ["tenant"], [F.col("at"), F.col("request_id")], limit)
    last = first.where(F.col("rank") == limit)
    return last.select("tenant", F.struct("at", "request_id").alias("last_allowed"))


def decide(requests: DataFrame, allow_list: DataFrame, quota_limit: int) -> DataFrame:
    """Judge each request of (request_id, tenant, at, kind, counterparty).

    In-tenant permissions pass; sharing needs the pair (tenant, counterparty) on
    the allow list; the n-th quota request of a tenant passes up to the limit;
    any other kind is forbidden. Requests without a tenant share one quota.
    """
    marks = quota_marks(requests, quota_limit)
    pairs = allow_list.select("tenant", "counterparty").distinct().withColumn("listed", F.lit(True))
    known = join_on(join_on(requests, marks, ["tenant"], "left"), pairs, ["tenant", "counterparty"], "left")
    over = F.struct("at", "request_id") > F.col("last_allowed")
    deny = (
        F.when(F.col("kind") == PERMISSION, "")
        .when(F.col("kind") == SHARING, F.when(F.col("listed"), "").otherwise(CROSS_TENANT_DENIED))
        .when(F.col("kind") == QUOTA, F.when(over, QUOTA_EXCEEDED).otherwise(""))
        .otherwise(POLICY_FORBIDDEN)
    )
    return _judged(known, requests.columns, deny)


def authorize(requests: DataFrame, subjects: DataFrame, action_roles: DataFrame) -> DataFrame:
    """Judge (subject, action) requests against (subject, roles) and (action, role), one
    verdict for each. A subject that is listed several times has all the roles listed;
    of the roles listed for an action any one will do."""
    listed = subjects.select("subject", "roles", F.explode_outer("roles").alias("role"))
    # roles are few once they are distinct
    people = listed.groupBy("subject").agg(F.collect_set("role").alias("held"), F.bool_or(F.col("roles").isNotNull()).alias("known"))
    needed = action_roles.groupBy("action").agg(F.collect_set("role").alias("needed"))
    known = requests.join(people, "subject", "left").join(needed, "action", "left")
    deny = (
        F.when((F.coalesce("subject", F.lit("")) == "") | ~F.coalesce("known", F.lit(False)), NOT_AUTHENTICATED)
        .when(F.coalesce(F.size("needed"), F.lit(0)) < 1, ACTION_FORBIDDEN)
        .when(~F.arrays_overlap("held", "needed"), INSUFFICIENT_ROLE)
        .otherwise("")
    )
    return _judged(known, requests.columns, deny)
