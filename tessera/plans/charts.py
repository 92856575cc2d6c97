"""Chart report plans: which metrics a set of chart configurations needs, fetched in one scan.

A chart configuration is either a metric name or a derived series
``(name, source_metrics, fn)``. ``collect_needed_metrics`` is plan-time
Python over the configuration list; the data work is one scan of a tier for
all needed metrics (instead of one request per metric).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history as H


def collect_needed_metrics(configs) -> list[str]:
    """Distinct metrics needed by the configurations (direct and derived sources), first-seen order."""
    seen: list[str] = []
    for c in configs:
        for m in ([c] if isinstance(c, str) else list(c[1])):
            if m not in seen:
                seen.append(m)
    return seen


def fetch_metrics(tier: DataFrame, metrics: list[str]) -> DataFrame:
    """One scan of a rollup tier for every needed metric, tagged with its first-seen order."""
    order = F.create_map(*[x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i))])
    pts = H.unpivot_tier(tier, [m for m in metrics if H.resolve_metric(m)])
    return pts.withColumn("metric_order", F.element_at(order, F.col("metric")))
