"""Counter derivations: deltas, rates, running averages, live ratios, casts.

All ordered logic uses the skew-safe helpers in ``windows`` (partitioned by
(engine, day) with a carried boundary) instead of a window over the whole
engine history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import prev_non_null, prev_row, running_total

U64_MAX_AS_LONG = 9_223_372_036_854_775_807  # Spark has no unsigned 64-bit type


def counter_cast(v: Column) -> Column:
    """Float -> unsigned count: truncate toward zero, negatives and NaN -> 0, saturate at the top."""
    return (
        F.when(F.isnan(v) | (v <= 0), F.lit(0).cast("bigint"))
        .when(v >= F.lit(9.223372036854775e18), F.lit(U64_MAX_AS_LONG).cast("bigint"))
        .otherwise(v.cast("bigint"))
    )


def counter_delta(df: DataFrame, key: str, ts: str, tie: str, cols: list[str]) -> DataFrame:
    """Per key: current - last *seen* value when current >= it, else null (reset or first).

    Null current values produce null and do not move the cursor.
    """
    d = prev_non_null(df, key, ts, tie, cols, suffix="_seen")
    for c in cols:
        p = F.col(f"{c}_seen")
        d = d.withColumn(f"{c}_delta", F.when(F.col(c) >= p, F.col(c) - p)).drop(f"{c}_seen")
    return d


def counter_rate(df: DataFrame, key: str, ts: str, tie: str, cols: list[str]) -> DataFrame:
    """(current - previous seen) / elapsed seconds; null when elapsed = 0 or no previous.

    No reset guard (parity): a restart gives a negative rate.
    """
    d = prev_non_null(df, key, ts, tie, cols, suffix="_seen", with_ts=True)
    for c in cols:
        el = (F.col(ts) - F.col(f"{c}_seen_ts")) / 1000.0
        d = d.withColumn(
            f"{c}_rate",
            F.when(F.col(c).isNotNull() & F.col(f"{c}_seen").isNotNull() & (el > 0), (F.col(c) - F.col(f"{c}_seen")) / el),
        ).drop(f"{c}_seen", f"{c}_seen_ts")
    return d


def running_avg_rate(df: DataFrame, epoch_key: Column, ts: str, tie: str, rate_col: str, out: str) -> DataFrame:
    """Mean of strictly positive rates so far within an epoch (since the last reset).

    Idle (non-positive or null) readings leave the average unchanged; null
    before the first positive reading.
    """
    d = df.withColumn("_ek", epoch_key)
    d = d.withColumn("_pos_v", F.when(F.col(rate_col) > 0, F.col(rate_col))).withColumn(
        "_pos_n", F.when(F.col(rate_col) > 0, F.lit(1)).otherwise(F.lit(0))
    )
    d = running_total(d, "_ek", ts, tie, ["_pos_v", "_pos_n"])
    return d.withColumn(out, F.when(F.col("_pos_n_run") > 0, F.col("_pos_v_run") / F.col("_pos_n_run"))).drop(
        "_ek", "_pos_v", "_pos_n", "_pos_v_run", "_pos_n_run"
    )


def spec_acceptance_rate(accepted: Column, draft: Column) -> Column:
    """accepted / draft * 100 when draft > 0 and accepted >= 0."""
    return F.when((draft > 0) & (accepted >= 0), accepted / draft * 100.0)


def spec_mean_acceptance_length(accepted: Column, drafts: Column) -> Column:
    """accepted / drafts when drafts > 0."""
    return F.when(accepted.isNotNull() & (drafts > 0), accepted / drafts)


def live_acceptance(df: DataFrame, key: str, ts: str, tie: str, acc: str, draft: str, out: str) -> DataFrame:
    """Delta-accepted / delta-draft * 100 against the immediately previous poll.

    Null when the previous poll lacked either counter (the cursor is cleared)
    or either counter went backwards.
    """
    d = prev_row(df, key, ts, tie, [acc, draft])
    pa, pd_ = F.col(f"{acc}_lag"), F.col(f"{draft}_lag")
    ok = F.col(acc).isNotNull() & F.col(draft).isNotNull() & pa.isNotNull() & pd_.isNotNull()
    ok = ok & (F.col(acc) >= pa) & (F.col(draft) >= pd_)
    d = d.withColumn(out, F.when(ok, spec_acceptance_rate(F.col(acc) - pa, F.col(draft) - pd_)))
    return d.drop(f"{acc}_lag", f"{draft}_lag", f"{ts}_lag")
