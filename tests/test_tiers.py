"""Rollup, summary and bucketing on literal rows."""

from pyspark.sql import functions as F

from tessera.operators import history as H
from tessera.operators import tiers as T

COLS = T.RAW_COLUMNS


def _raw(spark, rows):
    full = []
    for r in rows:
        d = dict.fromkeys(COLS)
        d.update(r)
        full.append(tuple(d[c] for c in COLS))
    schema = ", ".join(f"{c} {'string' if c == 'engine_key' else 'bigint' if c in ('ts', 'total_prompt_tokens', 'total_gen_tokens', 'total_requests', 'active_requests', 'queued_requests', 'preemptions_total') else 'double'}" for c in COLS)
    return spark.createDataFrame(full, schema)


def test_rollup_two_hours(spark):
    h = 3_600_000
    raw = _raw(spark, [
        {"engine_key": "e1", "ts": 10 * h + 1000, "total_requests": 2, "preemptions_total": 0, "ttft_ms": 100.0},
        {"engine_key": "e1", "ts": 10 * h + 2000, "total_requests": 3, "preemptions_total": 2, "ttft_ms": 200.0},
        {"engine_key": "e1", "ts": 11 * h + 1000, "total_requests": 4, "preemptions_total": 5},
    ])
    hourly = T.rollup_1h(raw, 13 * h)
    rows = {r.bucket_ts: r for r in hourly.collect()}
    assert len(rows) == 2
    assert sum(r.total_requests for r in rows.values()) == 9
    assert max(r.preemptions_total for r in rows.values()) == 5
    assert rows[10 * h].ttft_ms_p95 == 150.0 and rows[10 * h].sample_count == 2
    # incomplete hour is not rolled
    assert T.rollup_1h(raw, 11 * h + 5).count() == 1
    w = H.windows_df(spark, [(1, 0, 13 * h)])
    s = H.summary_weighted(hourly, w).collect()[0]
    assert s.total_requests == 9 and s.total_preemptions == 5 and s.total_seconds == 3.0


def test_bucketing_policy(spark):
    base = 1_700_000_000_000
    raw = _raw(spark, [{"engine_key": "e", "ts": base + i * 1000, "active_requests": a, "prompt_tps": p}
                       for i, (a, p) in enumerate([(3, 10.0), (4, 20.0), (5, 30.0)])])
    b = H.bucket_size_ms(3_600_000)
    assert b == 10_000 and H.bucket_size_ms(1000) == 1000
    pts = {(r.metric): r.value for r in H.bucket_raw(raw, b, ["active_requests", "prompt_tps"]).collect()}
    assert pts["active_requests"] == 5.0 and pts["prompt_tps"] == 20.0


def test_power_average_and_missing_rollup_column(spark):
    tier = spark.createDataFrame([("e1", 3_600_000, 6000.0, 60)], "engine_key string, bucket_ts long, power_watts_sum double, sample_count long")
    for c in T.TIER_COLUMNS:
        if c not in tier.columns:
            tier = tier.withColumn(c, F.lit(None).cast("double"))
    pts = H.unpivot_tier(tier, ["power_watts", "mem_used_pct"]).collect()
    assert [(p.metric, p.value) for p in pts] == [("power_watts", 100.0)]


def test_calendar_presets(spark):
    from datetime import datetime, timezone

    def ms(*a):
        return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)

    now = ms(2024, 3, 15, 10, 0)  # a Friday; local (UTC-4) 06:00
    df = spark.createDataFrame([(now, -4)], "now_ms long, off int")
    got = {r.preset: (r.since_ms, r.until_ms) for r in H.calendar_windows(df, F.col("off")).collect()}
    assert got["today"] == (ms(2024, 3, 15, 4), now)
    assert got["this_week"] == (ms(2024, 3, 10, 4), now)          # Sunday start
    assert got["this_month"] == (ms(2024, 3, 1, 4), now)
    assert got["last_month"] == (ms(2024, 2, 1, 4), ms(2024, 3, 1, 4))
    assert got["this_year"] == (ms(2024, 1, 1, 4), now)
    assert got["all_time"] == (0, now)
