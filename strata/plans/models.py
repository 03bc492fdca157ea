"""Models: named DataFrame steps, each materialised as a table and tested."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import NotFound
from strata.plans.publish import write_audit_publish
from strata.plans.quality import Check, not_null, unique
from strata.sources.versioned import VersionedTable


@dataclass(frozen=True)
class Model:
    """``build`` gets ``ref``, a function from an upstream name to its rows."""

    name: str
    build: Callable[[Callable[[str], DataFrame]], DataFrame]
    after: Sequence[str] = ()
    checks: Sequence[Check] = field(default=())


def run_models(
    spark: SparkSession, root: str, models: Sequence[Model], sources: dict[str, DataFrame], run_id: str = ""
) -> dict[str, VersionedTable]:
    """Build every model after the ones it names, publishing each only if its
    checks pass. The first failure stops the run."""
    by_name = {m.name: m for m in models}
    order = TopologicalSorter({m.name: [a for a in m.after if a in by_name] for m in models})
    built: dict[str, VersionedTable] = {}
    for name in order.static_order():
        model = by_name[name]

        def ref(upstream: str, model=model) -> DataFrame:
            if upstream in built and upstream in model.after:
                return built[upstream].read()
            if upstream in sources:
                return sources[upstream]
            raise NotFound(f"{model.name} refers to {upstream}, which it does not come after")

        table = VersionedTable(spark, f"{root}/{name}", name)
        write_audit_publish(table, model.build(ref), model.checks, key=run_id and f"{run_id}:{name}")
        built[name] = table
    return built


# -- the sample project: raw orders, cleaned orders, daily revenue -------------


def bronze_orders(ref):
    return ref("landing_orders")


def silver_orders(ref):
    """Typed, deduplicated, completed orders."""
    status = F.lower("status")
    complete = F.col("order_id").isNotNull() & F.col("customer").isNotNull() & F.col("amount").isNotNull()
    return (
        ref("bronze_orders")
        .where(complete & (status == "completed"))
        .select(
            "order_id",
            "customer",
            "product",
            "amount",
            status.alias("status"),
            F.col("order_date").cast("date").alias("order_date"),
        )
        .distinct()
    )


def gold_daily_revenue(ref):
    """Orders and revenue per day; cents are summed exactly."""
    cents = F.col("amount").cast("decimal(18,2)")
    return (
        ref("silver_orders")
        .groupBy("order_date")
        .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(cents), 2).cast("double").alias("revenue"))
    )


MEDALLION = (
    Model("bronze_orders", bronze_orders),
    Model(
        "silver_orders",
        silver_orders,
        after=("bronze_orders",),
        checks=(not_null("order_id"), unique("order_id"), not_null("amount")),
    ),
    Model(
        "gold_daily_revenue", gold_daily_revenue, after=("silver_orders",), checks=(not_null("revenue"),)
    ),
)
