"""Cumulative-histogram math as Spark SQL higher-order expressions.

A histogram is ``array<struct<le: double, cum: double>>`` sorted by ``le``
with ``+Infinity`` last. Arrays hold one histogram (a fixed, small number of
bounds), so these run per row inside whole-stage codegen, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = "CAST('Infinity' AS DOUBLE)"


def _sql_lit(x) -> str:
    return x if isinstance(x, str) else repr(float(x))


def percentile_sql(b: str, q: str) -> str:
    """SQL for: first bucket with cum >= total*q, linear inside it; +Inf -> nearest lower finite le.

    One ``aggregate`` fold over the buckets carries the previous bucket and
    the last finite bound until the target bucket is found.
    """
    total = f"element_at({b}, -1).cum"
    target = f"({total} * {q})"
    init = ("named_struct('done', false, 'ple', 0.0D, 'pcum', 0.0D, 'lfin', CAST(NULL AS DOUBLE), "
            "'res', CAST(NULL AS DOUBLE))")
    hit = (f"named_struct('done', true, 'ple', acc.ple, 'pcum', acc.pcum, 'lfin', acc.lfin, 'res', "
           f"CASE WHEN x.le = {INF} THEN acc.lfin "
           f"WHEN x.cum - acc.pcum <= 0 OR x.le - acc.ple <= 0 THEN x.le "
           f"ELSE acc.ple + ({target} - acc.pcum) / (x.cum - acc.pcum) * (x.le - acc.ple) END)")
    step = (f"named_struct('done', false, 'ple', x.le, 'pcum', x.cum, "
            f"'lfin', CASE WHEN x.le <> {INF} THEN x.le ELSE acc.lfin END, 'res', CAST(NULL AS DOUBLE))")
    fold = (f"aggregate({b}, {init}, (acc, x) -> CASE WHEN acc.done THEN acc "
            f"WHEN x.cum >= {target} THEN {hit} ELSE {step} END, acc -> acc.res)")
    return f"""(CASE
      WHEN {b} IS NULL OR size({b}) = 0 OR NOT ({q} BETWEEN 0.0D AND 1.0D) THEN NULL
      WHEN {total} <= 0 THEN NULL
      ELSE {fold}
    END)"""


def fraction_le_sql(b: str, thr: str) -> str:
    """SQL for the interpolated share of observations <= thr (clamped to [0, 1]); one fold over the buckets."""
    total = f"element_at({b}, -1).cum"
    first = f"element_at({b}, 1)"

    def clamp(x: str) -> str:
        return f"least(greatest({x}, 0.0D), 1.0D)"

    init = "named_struct('done', false, 'ple', 0.0D, 'pcum', 0.0D, 'res', CAST(NULL AS DOUBLE))"
    hit = (f"named_struct('done', true, 'ple', acc.ple, 'pcum', acc.pcum, 'res', "
           f"CASE WHEN x.le = {INF} THEN {clamp(f'acc.pcum / {total}')} "
           f"WHEN x.le - acc.ple <= 0 OR x.cum - acc.pcum <= 0 THEN {clamp(f'acc.pcum / {total}')} "
           f"ELSE {clamp(f'(acc.pcum + ({thr} - acc.ple) / (x.le - acc.ple) * (x.cum - acc.pcum)) / {total}')} END)")
    step = "named_struct('done', false, 'ple', x.le, 'pcum', x.cum, 'res', CAST(NULL AS DOUBLE))"
    fold = (f"aggregate({b}, {init}, (acc, x) -> CASE WHEN acc.done THEN acc "
            f"WHEN x.le = {INF} OR x.le >= {thr} THEN {hit} ELSE {step} END, acc -> coalesce(acc.res, 1.0D))")
    return f"""(CASE
      WHEN {b} IS NULL OR size({b}) = 0 OR isnan({thr}) THEN NULL
      WHEN {total} <= 0 THEN NULL
      WHEN {thr} <= {first}.le AND {first}.le <> {INF} THEN
        (CASE WHEN {first}.le <= 0 THEN 0.0D
              ELSE {clamp(f"{first}.cum * {clamp(f'{thr} / {first}.le')} / {total}")} END)
      ELSE {fold}
    END)"""


def hist_percentile(buckets: Column | str, q) -> Column:
    b = buckets if isinstance(buckets, str) else None
    if b is None:
        raise TypeError("pass the buckets column name")
    return F.expr(percentile_sql(f"`{b}`", _sql_lit(q)))


def hist_fraction_le(buckets: str, threshold) -> Column:
    return F.expr(fraction_le_sql(f"`{buckets}`", _sql_lit(threshold)))


def goodput_pct(buckets: str, slo_ms) -> Column:
    """Percent of requests within the SLO (histograms are in seconds)."""
    thr = _sql_lit(slo_ms)
    return F.expr(f"100.0D * {fraction_le_sql(f'`{buckets}`', f'(({thr}) / 1000.0D)')}")


def goodput_combined(*pcts: Column) -> Column:
    """Minimum of the present, finite goodputs (``least`` skips nulls)."""
    fin = [F.when(~F.isnan(p) & (F.abs(p) != F.lit(float("inf"))), p) for p in pcts]
    return F.least(*fin)


def hist_average(total: Column, count: Column, scale: Column | float = 1000.0) -> Column:
    """sum / count * scale when count > 0 (1000: seconds to milliseconds; 1: a histogram that isn't of time)."""
    return F.when(count > 0, total / count * scale)


def collect_buckets(long: DataFrame, keys: list[str], le: str = "le", cum: str = "cum", out: str = "buckets") -> DataFrame:
    """Long (keys, le, cum) -> one sorted bucket array per histogram (bounded by the bound count)."""
    return long.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(cum).alias("cum")))).alias(out)
    )
