"""Physical-plan properties the design relies on (checked on the executed plan text)."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import series as S
from tessera.operators import tiers as T
from tessera.operators.windows import prev_non_null
from tessera.plans import world as W
from tessera.sources import text as TX

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scrape_parse_is_map_only(spark):
    df = spark.createDataFrame([("e", "# TYPE a counter\na 1\nb_total 2")], "k string, body string")
    p = plan(TX.scrape_ingest(df, ["k"]))
    assert "Exchange" not in p and "Generate" in p


def test_last_n_limits_before_the_shuffle(spark):
    raw = W.raw(spark, SF)
    p = plan(S.last_n(raw, ["engine_key"], [F.col("ts")], 10))
    assert "WindowGroupLimit" in p


def test_ordered_windows_are_split_and_read_their_input_twice(spark):
    from tessera.streaming import jobs as SJ
    raw = W.stored(spark, SF, "raw").select("engine_key", "ts", "total_prompt_tokens").withColumn("seq", F.lit(0))
    for df in (prev_non_null(raw, "engine_key", "ts", "seq", ["total_prompt_tokens"]), SJ.tick_dedupe(raw, "engine_key", "ts", "seq")):
        df.collect()  # the adaptive plan shows what is read again and what is reused
        p = plan(df).split("== Initial Plan ==")[0]
        assert "_chunk" in p and "Window" in p
        assert p.count("FileScan") <= 2


def test_rollup_aggregates_map_side(spark):
    p = plan(T.rollup_1h(W.raw(spark, SF), W.NOW_MS))
    assert p.count("HashAggregate") >= 2 and "partial_" in p


def test_tier_scan_pushes_time_filter_to_parquet(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tier-"), "raw")
    W.raw(spark, SF).withColumn("day", F.col("ts") - F.col("ts") % 86_400_000).write.partitionBy("day").parquet(path)
    lo, hi = W.NOW_MS - 2 * 86_400_000, W.NOW_MS
    df = spark.read.parquet(path).where(F.col("ts").between(lo, hi) & (F.col("day") >= lo - lo % 86_400_000)).select("engine_key", "ts", "power_watts")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p
    assert "PartitionFilters: [isnotnull(day" in p
    assert "ReadSchema: struct<engine_key:string,ts:bigint,power_watts:double>" in p


def test_report_windows_need_no_join(spark):
    from tessera.operators import history as H
    p = plan(H.summary_raw(W.stored(spark, SF, "raw"), [(1, W.NOW_MS - 86_400_000, W.NOW_MS)]))
    assert "Join" not in p and "PartitionFilters: [isnotnull(day" in p and "GreaterThanOrEqual(ts," in p


def test_no_cartesian_products_or_row_udfs(spark):
    """No registered query plans a Cartesian product or a row-at-a-time Python UDF."""
    from tessera.plans import registry
    registry.load_all()
    skip = {"stream_rollup", "raw_append", "warmup_baseline", "rate_state_reset", "pid_tree", "purge_cumulative", "power_backfill",
            "power_backfill_rerun", "retention_prune", "schema_evolve"}  # run jobs eagerly
    bad = {}
    for n in sorted(registry.QUERIES):
        if n in skip:
            continue
        p = plan(registry.run(n, spark, SF))
        hits = [k for k in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython") if k in p]
        if hits:
            bad[n] = hits
    assert bad == {}
