"""Literal cases for rules that the fixture world doesn't reach."""

import types

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import engines, inventory, lookups, series, slo
from tessera.sources import logs, text
from tessera.streaming import jobs


def test_scrape_value_before_timestamp_and_one_label_set(spark):
    body = "\n".join([
        "# TYPE h histogram", "a 1 1700000000000", 'b{x="y z"} -2.5e3 17', "c +Inf",
        'h_bucket{le="1",m="p"} 5', 'h_bucket{le="+Inf",m="p"} 6', 'h_bucket{m="q",le="1"} 7', 'h_bucket{m="q",le="+Inf"} 9'])
    df = spark.createDataFrame([(1, body)], "k int, body string")
    got = {(r.name, r.le): r.value for r in text.scrape_ingest(df, ["k"]).collect()}
    assert got == {("a", None): 1.0, ("b", None): -2500.0, ("c", None): float("inf"), ("h", 1.0): 7.0, ("h", float("inf")): 9.0}


def test_log_order_with_many_pieces_and_large_sequence_numbers(spark):
    many = "x\n" * 70_000
    df = spark.createDataFrame([("c", "out", 2**43, many), ("c", "out", 2**43 + 1, "y\nz")], "container string, stream string, seq long, chunk string")
    got = logs.log_lines(df)
    assert got.count() == 70_002
    assert [r.line for r in got.orderBy(F.desc("line_no")).limit(3).collect()] == ["z", "y", "x"]


@pytest.mark.parametrize("args, want", [
    (["vllm", "--host", "--port", "--port", "9"], "http://--port:9"), (["--port", "--host", "x"], "http://localhost:--host"), (["--port=1", "--port", "2"], "http://localhost:2"),
    (["--host", "0.0.0.0"], "http://localhost:8000"), (["--port"], "http://localhost:8000"), ([], "http://localhost:8000"), (["--host=h", "--port=5"], "http://h:5")])
def test_flags_are_paired_left_to_right(spark, args, want):
    df = spark.createDataFrame([(args,)], "args array<string>")
    assert df.select(inventory.endpoint_from_args("args")).first()[0] == want


def test_null_tpot_is_present_and_invalid(spark):
    blobs = [('{"ttftMs":1,"itlMs":2,"e2eMs":3}', 50.0), ('{"ttftMs":1,"itlMs":2,"e2eMs":3,"tpotMs":4}', 4.0), ('{"ttftMs":1,"itlMs":2,"e2eMs":3,"tpotMs":null}', None)]
    got = [spark.createDataFrame([(b,)], "raw string").select(slo.parse_thresholds(F.col("raw"))["tpot_ms"]).first()[0] for b, _ in blobs]
    assert got == [w for _, w in blobs]


def test_slo_join_without_thresholds_uses_the_defaults(spark):
    snaps = spark.createDataFrame([("e", 1, "m", 10.0, 20.0, 30.0)], "engine_key string, tick_ts long, model_name string, ttft_goodput_pct double, itl_goodput_pct double, e2e_goodput_pct double")
    th = spark.createDataFrame([], "engine_key string, model_name string, ttft_ms double, itl_ms double, e2e_ms double, tpot_ms double, is_customized boolean")
    buckets = spark.createDataFrame([("e", 1, "ttft", [(0.5, 3.0), (float("inf"), 4.0)])], "engine_key string, tick_ts long, metric string, buckets array<struct<le:double,cum:double>>")
    r = slo.slo_join(snaps, th, buckets).first()
    assert (r.is_customized, r.ttft_goodput_pct, r.itl_goodput_pct) == (False, 75.0, 20.0)


def test_repeated_samples(spark):
    rows = [(1, "vllm_kv_cache_usage_perc", 0.1, 1), (1, "vllm_kv_cache_usage_perc", 0.05, 2), (1, "other", 9.0, 3), (2, "vllm_gpu_cache_usage_perc", 0.4, 1)]
    df = spark.createDataFrame(rows, "k int, name string, value double, seq int")
    assert {r.k: r.kv_cache_usage for r in engines.version_fallback(df, ["k"], "seq").collect()} == {1: 0.05, 2: 0.4}
    a = spark.createDataFrame([("s", 1, 5.0, 1), ("s", 1, 3.0, 2)], "k string, timestamp_ms long, value double, seq int")
    b = spark.createDataFrame([("s", 1, 2.0), ("s", 1, 3.0), ("s", 2, 4.0)], "k string, timestamp_ms long, value double")
    assert sorted(map(tuple, series.series_sum(a, b, ["k"], order="seq").collect())) == [("s", 1, 8.0), ("s", 2, 4.0)]


def test_conflation_ties(spark):
    rows = [("e", 100, 1), ("e", 100, 2), ("e", 1500, 3), ("e", 1500, 4), ("f", 5000, 1)]
    got = jobs.conflate_latest(spark.createDataFrame(rows, "k string, ts long, n int"), "k", "ts", ties=("n",))
    assert sorted(map(tuple, got.collect())) == [("e", 100, 1), ("e", 1500, 4), ("f", 5000, 1)]


def test_pid_tree_ends_only_when_nothing_is_found(spark):
    procs = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(3, 12)], "pid int, parent int")
    got = inventory.pid_tree(spark.createDataFrame([(0, 0)], "root int, pid int"), procs)
    assert sorted(r.pid for r in got.collect()) == list(range(13))


def test_pricing_plans_no_nested_loop_and_matches_empty_ids(spark):
    models = spark.createDataFrame([("Org/Model-XL",), ("zzz",), ("abcdefghij",)], "model_id string")
    cat = spark.createDataFrame([(5, "model-xl", "1", "2"), (3, "router/org/model-xl:free", "x", "4"), (2, "no-price", None, "1"), (9, "", "7", "8"), (4, "abcdefghi", "3", "3")],
                                "seq long, id string, prompt string, completion string")
    out = lookups.pricing_lookup(models, cat)
    got = {r.model_id: (r.prompt_rate, r.gen_rate, r.source) for r in out.collect()}
    assert got == {"org/model-xl": (0.0, 4e6, "match"), "zzz": (7e6, 8e6, "match"), "abcdefghij": (3e6, 3e6, "match")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookups.pricing_lookup(models, cat)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", session.DEFAULT_CONF["spark.sql.autoBroadcastJoinThreshold"])
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_cluster_without_shared_folder_is_an_error():
    fake = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake)


def test_warmup_masks_buckets_and_tpot(spark):
    df = spark.createDataFrame([(1, 2.0, [1.0], 3.0)], "active_requests int, tpot_p95_ms double, tpot_buckets array<double>, ttft_ms double")
    assert tuple(engines.warmup_mask(df, F.lit(True)).first()) == (1, None, None, None)
    assert tuple(engines.warmup_mask(df, F.lit(False)).first()) == (1, 2.0, [1.0], 3.0)


def test_containment_with_one_common_prefix(spark):
    """Ids that all begin alike: looked up by what sets them apart, so candidates stay few; short and empty texts are found too."""
    outer = spark.createDataFrame([(f"router/vendor/model-{k:05d}-chat",) for k in range(600)] + [("abc",), ("",), ("zz",)], "a string")
    inner = [f"router/vendor/model-{k:05d}" for k in range(0, 600, 3)] + ["router/vendor/other", "abc", "ab", "z", "", "nothing here", "-chat"]
    df = spark.createDataFrame([(x,) for x in inner], "b string")
    texts = [r.a for r in outer.collect()]
    got = {tuple(r) for r in lookups._containing(outer, df, "a", "b").collect()}
    assert got == {(x, y) for x in texts for y in inner if y in x}
    per_id = lookups._candidates(outer, df.where(F.col("b").startswith("router/vendor/model")), "a", "b").groupBy("b").count()
    assert per_id.agg(F.max("count")).first()[0] <= 100
