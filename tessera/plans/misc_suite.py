"""Registered queries: series keys, engine metric plumbing, snapshots as JSON, nodes, catalogues, tier writes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import histograms as HG
from ..functions.timeutil import DAY_MS, HOUR_MS
from ..operators import engines as EN
from ..operators import hardware as HW
from ..operators import nodes as ND
from ..operators import series as S
from ..operators import tiers as T
from ..sources import fixtures as fx
from ..sources import tables
from . import host_suite as HS
from . import world as W
from .history_suite import _unpivot_tier_sql
from .registry import query

D = fx.DUCK


def _s(sql: str, d) -> str:
    return sql.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


# ---------------------------------------------------------------- series keys

# Engine series name -> snapshot field.
ENGINE_SERIES = (
    ("tps", "tokens_per_sec"), ("avgTps", "avg_tokens_per_sec"), ("perReqTps", "per_request_tps"), ("ttft", "ttft_ms"),
    ("kvCache", "kv_cache_percent"), ("prefixCacheHit", "prefix_cache_hit_rate"), ("e2eLatency", "e2e_latency_ms"),
    ("promptTps", "prompt_tokens_per_sec"), ("avgPromptTps", "avg_prompt_tokens_per_sec"),
    ("perReqPromptTps", "per_request_prompt_tps"), ("queueTime", "queue_time_ms"), ("interTokenLatency", "inter_token_latency_ms"),
    ("batchSize", "avg_batch_size"), ("ttftP50", "ttft_p50_ms"), ("ttftP95", "ttft_p95_ms"), ("ttftP99", "ttft_p99_ms"),
    ("itlP50", "itl_p50_ms"), ("itlP95", "itl_p95_ms"), ("itlP99", "itl_p99_ms"), ("e2eP50", "e2e_p50_ms"),
    ("e2eP95", "e2e_p95_ms"), ("e2eP99", "e2e_p99_ms"), ("activeRequests", "active_requests"),
    ("queuedRequests", "queued_requests"), ("totalRequests", "total_requests"),
    ("tpot", "tpot_ms"), ("tpotP50", "tpot_p50_ms"), ("tpotP95", "tpot_p95_ms"), ("tpotP99", "tpot_p99_ms"),
)
# GPU series names.
GPU_SERIES = (("gpuUtil", "utilization_percent"), ("gpuTemp", "temperature_celsius"), ("gpuPower", "power_watts"), ("gpuClockGraphics", "clock_graphics_mhz"))
# Host-level series names.
SYSTEM_SERIES = ("gpuUtil", "gpuTemp", "gpuPower", "gpuClockGraphics", "cpuAggregate", "memoryUsedPercent",
                 "diskRead", "diskWrite", "networkRx", "networkTx")


def unpivot_series(spark, sf):
    s = fx.engine_snapshots(spark, sf)
    key = F.concat(F.col("engine_type"), F.lit("-"), F.col("endpoint"), F.lit(":"))
    eng = s.select(F.col("tick_ts").alias("ts"), F.explode(F.array(*[
        F.struct(F.concat(key, F.lit(n)).alias("series_key"), F.col(c).cast("double").alias("value")) for n, c in ENGINE_SERIES
    ])).alias("_p")).select("ts", "_p.series_key", "_p.value")
    g = HS.gpus(spark, sf)
    gpu = g.select("ts", F.explode(F.array(*[
        F.struct(F.concat(F.col("host"), F.lit("/gpu:"), F.col("gpu_index").cast("string"), F.lit(":" + n)).alias("series_key"),
                 F.col(c).cast("double").alias("value")) for n, c in GPU_SERIES
    ])).alias("_p")).select("ts", "_p.series_key", "_p.value")
    host = host_snapshots(spark, sf)
    own = [(n, F.col(c)) for n, c in GPU_SERIES] + [(n, F.col(n)) for n in SYSTEM_SERIES[4:] if n != "memoryUsedPercent"]
    system = host.select("ts", F.inline(F.array(*[F.struct(F.lit(n).alias("series_key"), c.cast("double").alias("value")) for n, c in own])))
    m = spark.sql(HS.memory_sql(fx.SPARK), orders=tables.read(spark, sf, "orders", "o_orderkey", "o_custkey"))
    mem = m.select(F.lit(1704067200000).cast("bigint") + F.col("snap_id") * 1000, F.lit("memoryUsedPercent"),
                   F.when(F.col("total_bytes") > 0, F.greatest(F.col("total_bytes") - F.col("available_bytes"), F.lit(0)) / F.col("total_bytes") * 100.0)
                   ).toDF("ts", "series_key", "value")
    return eng.unionByName(gpu).unionByName(system).unionByName(mem).where(F.col("value").isNotNull())


def host_snapshots(spark, sf):
    """One row per host snapshot: its first GPU's readings, mean core usage, disk and network rates."""
    li = HS._li(spark, sf)
    first = HS.gpus(spark, sf).where("gpu_index = 0").select("snap_id", "ts", *[c for _, c in GPU_SERIES])
    cpu = HW.cpu_cores(spark.sql(HS.cores_sql(fx.SPARK), lineitem=li), ["snap_id"]).select("snap_id", F.col("aggregate_percent").alias("cpuAggregate"))
    disk = HW.disk_totals(spark.sql(HS.disks_sql(fx.SPARK), lineitem=li), ["snap_id"]).select(
        "snap_id", F.col("read_bytes_per_sec").alias("diskRead"), F.col("write_bytes_per_sec").alias("diskWrite"))
    net = HW.network_totals(HS.nics(spark, sf), ["snap_id"]).select(
        "snap_id", F.col("rx_bytes_per_sec").alias("networkRx"), F.col("tx_bytes_per_sec").alias("networkTx"))
    return first.join(cpu, "snap_id", "left").join(disk, "snap_id", "left").join(net, "snap_id", "left")


def _unpivot_sql() -> str:
    eng = " UNION ALL ".join(
        f"SELECT tick_ts AS ts, engine_type || '-' || endpoint || ':{n}' AS series_key, CAST({c} AS DOUBLE) AS value FROM s"
        for n, c in ENGINE_SERIES)
    gpu = " UNION ALL ".join(
        f"SELECT ts, host || '/gpu:' || CAST(gpu_index AS VARCHAR) || ':{n}' AS series_key, CAST({c} AS DOUBLE) AS value FROM g"
        for n, c in GPU_SERIES)
    first = " UNION ALL ".join(f"SELECT ts, '{n}', CAST({c} AS DOUBLE) FROM g WHERE gpu_index = 0" for n, c in GPU_SERIES)
    rates = " UNION ALL ".join(f"SELECT 1704067200000 + snap_id * 1000, '{n}', CAST({e} AS DOUBLE) FROM {t} GROUP BY snap_id" for n, e, t in (
        ("cpuAggregate", "avg(usage_percent)", "cores"), ("diskRead", "sum(read_bytes)", "disks"), ("diskWrite", "sum(write_bytes)", "disks"),
        ("networkRx", "CASE WHEN count_if(NOT v) > 0 THEN sum(rx) FILTER (WHERE NOT v) ELSE sum(rx) END", "nics"),
        ("networkTx", "CASE WHEN count_if(NOT v) > 0 THEN sum(tx) FILTER (WHERE NOT v) ELSE sum(tx) END", "nics")))
    return (fx.duck_cte("engine_snapshots").rstrip("\n") + f""", s AS (SELECT * FROM engine_snapshots),
g AS ({HS.gpus_sql(D)}), m AS ({HS.memory_sql(D)}), cores AS ({HS.cores_sql(D)}), disks AS ({HS.disks_sql(D)}),
nics AS (SELECT *, {HS._VIRT} AS v FROM ({HS.nics_sql(D)}) x),
u AS ({eng} UNION ALL {gpu} UNION ALL {first} UNION ALL {rates} UNION ALL
  SELECT 1704067200000 + snap_id * 1000, 'memoryUsedPercent',
    CASE WHEN total_bytes > 0 THEN greatest(total_bytes - available_bytes, 0) / total_bytes * 100.0 END FROM m)
""")


@query("unpivot_series", _unpivot_sql() + "SELECT * FROM u WHERE value IS NOT NULL")
def q_unpivot_series(spark, sf):
    return unpivot_series(spark, sf)


def series_lookup(keys):
    """Resolve a series key: system name, ``gpu:<i>:<metric>`` (after an optional host prefix), else split at the last colon."""
    k = F.col("series_key")
    local = F.regexp_replace(k, r"^[^/]*/(gpu:)", "$1")
    gpu_re = r"^gpu:(\d+):(gpuUtil|gpuTemp|gpuPower|gpuClockGraphics)$"
    is_gpu = local.rlike(gpu_re)
    eng_metric = F.substring_index(k, ":", -1)
    known_engine = eng_metric.isin(*[n for n, _ in ENGINE_SERIES])
    scope = (F.when(k.isin(*SYSTEM_SERIES), "system").when(is_gpu, "gpu")
             .when((F.locate(":", k) > 0) & known_engine, "engine").otherwise("unknown"))
    return keys.select(
        "series_key", scope.alias("scope"),
        F.when(is_gpu & ~k.isin(*SYSTEM_SERIES), F.regexp_extract(local, gpu_re, 1).cast("int")).alias("gpu_index"),
        F.when(scope == "engine", F.expr("substring(series_key, 1, length(series_key) - locate(':', reverse(series_key)))")).alias("engine_key"),
        F.when(scope == "system", k).when(scope == "gpu", F.regexp_extract(local, gpu_re, 2)).when(scope == "engine", eng_metric).alias("metric"),
    )


@query("series_lookup", _unpivot_sql() + """
, k AS (SELECT DISTINCT series_key, regexp_replace(series_key, '^[^/]*/(gpu:)', '\\1') AS local FROM u WHERE value IS NOT NULL)
SELECT series_key,
  CASE WHEN series_key IN (""" + ", ".join(f"'{x}'" for x in SYSTEM_SERIES) + """) THEN 'system'
       WHEN regexp_matches(local, '^gpu:(\\d+):(gpuUtil|gpuTemp|gpuPower|gpuClockGraphics)$') THEN 'gpu'
       WHEN contains(series_key, ':') AND split_part(series_key, ':', -1) IN (""" + ", ".join(f"'{n}'" for n, _ in ENGINE_SERIES) + """) THEN 'engine'
       ELSE 'unknown' END AS scope,
  CASE WHEN regexp_matches(local, '^gpu:(\\d+):(gpuUtil|gpuTemp|gpuPower|gpuClockGraphics)$') AND series_key NOT IN (""" + ", ".join(f"'{x}'" for x in SYSTEM_SERIES) + """)
       THEN CAST(regexp_extract(local, '^gpu:(\\d+):', 1) AS INT) END AS gpu_index,
  CASE WHEN NOT regexp_matches(local, '^gpu:(\\d+):(gpuUtil|gpuTemp|gpuPower|gpuClockGraphics)$') AND series_key NOT IN (""" + ", ".join(f"'{x}'" for x in SYSTEM_SERIES) + """)
        AND contains(series_key, ':') AND split_part(series_key, ':', -1) IN (""" + ", ".join(f"'{n}'" for n, _ in ENGINE_SERIES) + """)
       THEN substring(series_key, 1, length(series_key) - length(split_part(series_key, ':', -1)) - 1) END AS engine_key,
  CASE WHEN series_key IN (""" + ", ".join(f"'{x}'" for x in SYSTEM_SERIES) + """) THEN series_key
       WHEN regexp_matches(local, '^gpu:(\\d+):(gpuUtil|gpuTemp|gpuPower|gpuClockGraphics)$') THEN regexp_extract(local, ':([A-Za-z]+)$', 1)
       WHEN contains(series_key, ':') AND split_part(series_key, ':', -1) IN (""" + ", ".join(f"'{n}'" for n, _ in ENGINE_SERIES) + """) THEN split_part(series_key, ':', -1) END AS metric
FROM k
""")
def q_series_lookup(spark, sf):
    keys = unpivot_series(spark, sf).select("series_key").distinct()
    return series_lookup(keys)


# ---------------------------------------------------------------- latency modes

MODES = ("avg", "p50", "p95", "p99", "median")


@query("latency_statistic", fx.duck_cte("engine_snapshots") + """
SELECT tick_ts, engine_key, mode,
  CASE WHEN mode = 'p50' THEN CASE WHEN ttft_p50_ms IS NOT NULL OR ttft_p95_ms IS NOT NULL OR ttft_p99_ms IS NOT NULL THEN ttft_p50_ms END
       WHEN mode = 'p95' THEN CASE WHEN ttft_p50_ms IS NOT NULL OR ttft_p95_ms IS NOT NULL OR ttft_p99_ms IS NOT NULL THEN ttft_p95_ms END
       WHEN mode = 'p99' THEN CASE WHEN ttft_p50_ms IS NOT NULL OR ttft_p95_ms IS NOT NULL OR ttft_p99_ms IS NOT NULL THEN ttft_p99_ms END
       ELSE ttft_ms END AS ttft_shown
FROM engine_snapshots, (SELECT unnest(['avg', 'p50', 'p95', 'p99', 'median']) AS mode) m
""")
def q_latency_statistic(spark, sf):
    s = fx.engine_snapshots(spark, sf)
    s = s.select("tick_ts", "engine_key", "ttft_ms", "ttft_p50_ms", "ttft_p95_ms", "ttft_p99_ms",
                 F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"))
    return s.select("tick_ts", "engine_key", "mode", EN.latency_statistic(
        F.col("mode"), F.col("ttft_ms"), F.col("ttft_p50_ms"), F.col("ttft_p95_ms"), F.col("ttft_p99_ms")).alias("ttft_shown"))


# ---------------------------------------------------------------- version fallback / mapping

def _samples_sql(d) -> str:
    def arm(canon: str, col: str, cond: str = "TRUE") -> str:
        a, b = EN.VERSION_NAMES[canon]
        return (f"SELECT tick_ts, engine_key, engine_type, CASE WHEN n_events % 2 = 0 THEN '{a}' ELSE '{b}' END AS name, "
                f"CAST({col} AS DOUBLE) AS value FROM {d.t('engine_snapshots')} WHERE {col} IS NOT NULL AND {cond}")
    arms = [arm("kv_cache_usage", "kv_cache_percent / 100.0"), arm("tpot_sum", "inter_token_latency_ms"),
            arm("tpot_count", "n_events"), arm("spec_accepted", "spec_decode_accepted_tokens_total"),
            arm("spec_draft", "spec_decode_draft_tokens_total"), arm("spec_drafts", "spec_decode_drafts_total")]
    return " UNION ALL ".join(arms)


def samples(spark, sf):
    return spark.sql(_samples_sql(fx.SPARK), engine_snapshots=fx.engine_snapshots(spark, sf))


_SAMPLES_DUCK = fx.duck_cte("engine_snapshots").rstrip("\n") + f", smp AS ({_samples_sql(D)})\n"


@query("version_fallback", _SAMPLES_DUCK + "SELECT tick_ts, engine_key, " + ", ".join(
    f"COALESCE(max(value) FILTER (WHERE name = '{a}'), max(value) FILTER (WHERE name = '{b}')) AS {c}"
    for c, (a, b) in EN.VERSION_NAMES.items()) + " FROM smp GROUP BY tick_ts, engine_key")
def q_version_fallback(spark, sf):
    return EN.version_fallback(samples(spark, sf), ["tick_ts", "engine_key"])


@query("metric_mapping", _SAMPLES_DUCK + ", mp AS (SELECT * FROM (VALUES " + ", ".join(
    f"('vllm', '{c}', '{n}', {i})" for c, names in EN.VERSION_NAMES.items() for i, n in enumerate(names)) + """) t(engine_type, canonical, source, priority))
SELECT smp.tick_ts, smp.engine_key, mp.canonical, arg_min(smp.value, mp.priority) AS value
FROM smp JOIN mp ON smp.engine_type = mp.engine_type AND smp.name = mp.source GROUP BY 1, 2, 3
""")
def q_metric_mapping(spark, sf):
    return EN.metric_mapping(spark, samples(spark, sf), ["tick_ts", "engine_key"])


# ---------------------------------------------------------------- model descriptors

def _meta_sql(d) -> str:
    arr = (lambda *xs: "[" + ", ".join(xs) + "]") if d.name == "duckdb" else (lambda *xs: "array(" + ", ".join(xs) + ")")
    return _s(f"""SELECT lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS STRING) AS model_id,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_partkey AS BIGINT) * 7777777 + 13 END AS param_total,
  CASE p_size % 7 WHEN 0 THEN 'gptq' WHEN 1 THEN 'awq' WHEN 2 THEN 'auto-round' WHEN 3 THEN 'fp8' WHEN 4 THEN 'bitsandbytes'
       WHEN 5 THEN 'custom-q' ELSE NULL END AS quant_method,
  CASE WHEN p_size % 7 IN (0, 1) THEN 4 WHEN p_size % 7 = 3 THEN 8 ELSE NULL END AS bits,
  CASE p_partkey % 5 WHEN 0 THEN {arr("'I32'", "'BF16'")} WHEN 1 THEN {arr("'U8'", "'I8'")} WHEN 2 THEN {arr("'F32'", "'F16'")}
       WHEN 3 THEN {arr("'FP8'", "'F64'")} ELSE NULL END AS dtypes,
  CASE WHEN p_size % 2 = 0 THEN 'llama' ELSE 'qwen2' END AS model_type,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'text-generation' END AS pipeline_tag
FROM {d.t('part')}""", d)


@query("model_descriptors", f"""
SELECT model_id,
  CASE WHEN param_total IS NULL THEN NULL WHEN param_total >= 1000000000 THEN printf('%.1fB params', param_total / 1e9)
       WHEN param_total >= 1000000 THEN printf('%.1fM params', param_total / 1e6) ELSE CAST(param_total AS VARCHAR) || ' params' END AS parameter_size,
  CASE quant_method WHEN 'auto-round' THEN 'AutoRound' WHEN 'gptq' THEN 'GPTQ' WHEN 'awq' THEN 'AWQ' WHEN 'bitsandbytes' THEN 'BitsAndBytes'
       WHEN 'fp8' THEN 'FP8' ELSE quant_method END AS quantization,
  CASE WHEN bits IS NOT NULL THEN CAST(bits AS VARCHAR) || '-bit precision' END AS precision,
  CASE WHEN dtypes IS NULL THEN NULL ELSE COALESCE(
    CASE WHEN list_contains(dtypes, 'BF16') THEN 'BF16' WHEN list_contains(dtypes, 'F16') THEN 'F16' WHEN list_contains(dtypes, 'F32') THEN 'F32'
         WHEN list_contains(dtypes, 'F64') THEN 'F64' WHEN list_contains(dtypes, 'FP8') THEN 'FP8' END, list_min(dtypes)) END AS tensor_type,
  model_type, pipeline_tag
FROM ({_meta_sql(D)}) m
""")
def q_model_descriptors(spark, sf):
    meta = spark.sql(_meta_sql(fx.SPARK), part=tables.read(spark, sf, "part", "p_partkey", "p_brand", "p_name", "p_size"))
    return EN.model_descriptors(meta)


# ---------------------------------------------------------------- warm-up mask, derived series, rate reset

PASSED = ("active_requests", "queued_requests", "kv_cache_percent", "total_requests", "swapped_requests", "prefix_cache_hit_rate", "preemptions_total",
          "total_prompt_tokens", "total_generation_tokens", "spec_decode_draft_tokens_total")
MASKED = tuple(c for c in EN.WARMUP_MASKED if not c.endswith("_buckets"))


@query("warmup_mask", fx.duck_cte("engine_snapshots", "hist_buckets").rstrip("\n") + """,
h AS (SELECT engine_key, tick_ts, """ + ", ".join(f"CAST(count_if(metric = '{m}') AS BIGINT) AS {m}_n, sum(cum) FILTER (WHERE metric = '{m}') AS {m}_sum" for m, _ in fx.HIST_SCALE) + """
      FROM hist_buckets GROUP BY 1, 2)
SELECT """ + ", ".join(f"CASE WHEN NOT (n_events % 4 = 0) THEN {c} END AS {c}" for c in MASKED) + ", " + ", ".join(
    f"CASE WHEN NOT (n_events % 4 = 0) AND {m}_n > 0 THEN {m}_n END AS {m}_bounds, CASE WHEN NOT (n_events % 4 = 0) THEN {m}_sum END AS {m}_total" for m, _ in fx.HIST_SCALE)
    + ", tick_ts, engine_key, " + ", ".join(PASSED) + " FROM engine_snapshots LEFT JOIN h USING (engine_key, tick_ts)")
def q_warmup_mask(spark, sf):
    """Derived fields and the four bucket arrays (shown by their number of bounds and their sum) are blank while warming."""
    s = fx.engine_snapshots(spark, sf).select("tick_ts", "engine_key", *MASKED, *PASSED, "n_events")
    hb = HG.collect_buckets(fx.view(spark, sf, "hist_buckets"), ["engine_key", "tick_ts", "metric"])
    hb = hb.groupBy("engine_key", "tick_ts").pivot("metric", [m for m, _ in fx.HIST_SCALE]).agg(F.first("buckets"))
    hb = hb.select("engine_key", "tick_ts", *[F.col(f"`{m}`").alias(f"{m}_buckets") for m, _ in fx.HIST_SCALE])
    out = EN.warmup_mask(s.join(hb, ["engine_key", "tick_ts"], "left"), F.col("n_events") % 4 == 0)
    shown = [x for h in HIST_FIELDS for x in (
        F.when(F.col(h).isNotNull(), F.size(h)).cast("bigint").alias(h.replace("buckets", "bounds")), F.aggregate(h, F.lit(0.0), lambda a, x: a + x["cum"]).alias(h.replace("buckets", "total")))]
    return out.select(*MASKED, *shown, "tick_ts", "engine_key", *PASSED)


def _avg_line(src):
    return S.series_mean_line(src["prompt_tps"], ["engine_key"])


def _per_req(src):
    return S.per_request_rate(src["prompt_tps"], src["active_requests"], "engine_key")


# Registry of derived series: name -> (source metrics, function of {metric: DataFrame} -> points).
DERIVED = {"prompt_tps_avg": (["prompt_tps"], _avg_line), "prompt_tps_per_req": (["prompt_tps", "active_requests"], _per_req)}


@query("derived_series", W.tier_cte() + f""", hp AS ({_unpivot_tier_sql('snapshots_1h')})
SELECT 'prompt_tps_avg' AS series, engine_key, timestamp_ms, avg(value) OVER (PARTITION BY engine_key) AS value FROM hp WHERE metric = 'prompt_tps'
UNION ALL
SELECT 'prompt_tps_per_req', a.engine_key, a.timestamp_ms, CASE WHEN r.value > 0 THEN a.value / r.value ELSE 0.0 END
FROM hp a JOIN hp r ON a.engine_key = r.engine_key AND a.timestamp_ms = r.timestamp_ms AND a.metric = 'prompt_tps' AND r.metric = 'active_requests'
""")
def q_derived_series(spark, sf):
    from ..operators import history as H
    pts = H.unpivot_tier(W.hourly(spark, sf), ["prompt_tps", "active_requests"])
    out = None
    for name, (srcs, fn) in DERIVED.items():
        src = {m: pts.where(F.col("metric") == m).drop("metric") for m in srcs}
        d = fn(src).select(F.lit(name).alias("series"), "engine_key", "timestamp_ms", "value")
        out = d if out is None else out.unionByName(d)
    return out


# ---------------------------------------------------------------- snapshots as JSON

# Fields of a snapshot's metrics: everything that the engine snapshot has beside its identity.
SNAP_IDENTITY = ("tick_ts", "engine_key", "engine_type", "endpoint", "status_type", "model_name", "n_events")
# Fixed value: what stands for an infinite bound on the wire, where JSON has no infinity.
INF_SENTINEL = 1.7976931348623157e308
HIST_FIELDS = tuple(f"{m}_buckets" for m, _ in fx.HIST_SCALE)


def snap_schema(spark, sf) -> ST.StructType:
    fields = [f for f in fx.engine_snapshots(spark, sf).schema if f.name not in SNAP_IDENTITY]
    wire = ST.ArrayType(ST.StructType([ST.StructField("le_seconds", ST.DoubleType()), ST.StructField("cumulative_count", ST.DoubleType())]))
    metrics = ST.StructType([*[ST.StructField(f.name, f.dataType) for f in fields], *[ST.StructField(h, wire) for h in HIST_FIELDS]])
    text = ST.StringType()
    return ST.StructType([ST.StructField("tick_ts", ST.LongType()), ST.StructField("engine_key", text), ST.StructField("engine_type", text), ST.StructField("endpoint", text),
                         ST.StructField("status", ST.StructType([ST.StructField("type", text)])), ST.StructField("model_name", text), ST.StructField("metrics", metrics)])


def encoded_snapshots(spark, sf):
    """(tick_ts, engine_key, message): every engine snapshot as JSON, with all fields (null ones too) and four histograms."""
    s = fx.engine_snapshots(spark, sf)
    wire = lambda b: F.transform(b, lambda x: F.struct(
        F.when(x["le"] == F.lit(float("inf")), F.lit(INF_SENTINEL)).otherwise(x["le"]).alias("le_seconds"), x["cum"].alias("cumulative_count")))
    hb = HG.collect_buckets(fx.view(spark, sf, "hist_buckets"), ["engine_key", "tick_ts", "metric"])
    hb = hb.groupBy("engine_key", "tick_ts").pivot("metric", [m for m, _ in fx.HIST_SCALE]).agg(F.first("buckets"))
    j = s.join(hb, ["engine_key", "tick_ts"], "left")
    metrics = [F.col(c) for c in s.columns if c not in SNAP_IDENTITY] + [wire(F.col(f"`{m}`")).alias(f"{m}_buckets") for m, _ in fx.HIST_SCALE]
    row = F.struct("tick_ts", "engine_key", "engine_type", "endpoint", F.struct(F.col("status_type").alias("type")).alias("status"), "model_name", F.struct(*metrics).alias("metrics"))
    return j.select("tick_ts", "engine_key", F.to_json(row, {"ignoreNullFields": "false"}).alias("message"))


def snapshot_decode(messages, schema):
    """JSON messages -> typed rows of all fields, histograms with their infinite bound; malformed messages are skipped."""
    bad = ST.StructType([*schema.fields, ST.StructField("_bad", ST.StringType())])
    p = messages.select(F.from_json("message", bad, {"columnNameOfCorruptRecord": "_bad"}).alias("s")).where(F.col("s._bad").isNull() & F.col("s.engine_key").isNotNull())
    finite = lambda b: F.transform(b, lambda x: F.struct(
        F.when(x["le_seconds"] >= F.lit(INF_SENTINEL), F.lit(float("inf"))).otherwise(x["le_seconds"]).alias("le"), x["cumulative_count"].alias("cum")))
    d = p.select("s.*").select("tick_ts", "engine_key", "engine_type", "endpoint", F.col("status.type").alias("status_type"), "model_name", "metrics.*")
    return d.select(*[finite(F.col(c)).alias(c) if c in HIST_FIELDS else F.col(c) for c in d.columns])


def _wire_sql() -> str:
    """Every value of every message as (tick_ts, engine_key, field, pos, number, text)."""
    fields = SNAP_FIELDS
    arms = [f"SELECT tick_ts, engine_key, '{c}' AS field, NULL AS pos, CAST({c} AS DOUBLE) AS number, NULL AS text FROM s" for c in fields]
    arms += [f"SELECT tick_ts, engine_key, '{c}', NULL, NULL, {e} FROM s" for c, e in (("engine_type", "engine_type"), ("endpoint", "endpoint"), ("status", "status_type"), ("model_name", "model_name"))]
    n = "CAST(row_number() OVER (PARTITION BY engine_key, tick_ts, metric ORDER BY le) - 1 AS BIGINT)"
    le = f"CASE WHEN le = 'Infinity'::DOUBLE THEN {INF_SENTINEL!r} ELSE le END"
    arms += [f"SELECT tick_ts, engine_key, metric || '_buckets.le_seconds', {n}, {le}, NULL FROM h", f"SELECT tick_ts, engine_key, metric || '_buckets.cumulative_count', {n}, cum, NULL FROM h"]
    return fx.duck_cte("engine_snapshots", "hist_buckets").rstrip("\n") + f""",
s AS (SELECT * FROM engine_snapshots), h AS (SELECT b.* FROM hist_buckets b JOIN engine_snapshots USING (engine_key, tick_ts))
""" + " UNION ALL ".join(arms)


SNAP_FIELDS = tuple(c for c in re.findall(r"\w+", fx.sql_engine_snapshots(fx.DUCK).split("FROM")[0].split("SELECT")[1]) if c not in SNAP_IDENTITY)


def _wire_value(field: str, part: str):
    return lambda x, i: F.struct(F.lit(f"{field}.{part}").alias("field"), i.cast("bigint").alias("pos"), x[part].alias("number"), F.lit(None).cast("string").alias("text"))


@query("snapshot_encode", _wire_sql())
def q_snapshot_encode(spark, sf):
    """What each message holds, read from its text as JSON of any shape."""
    v = encoded_snapshots(spark, sf).select("tick_ts", "engine_key", F.parse_json("message").alias("v"))
    none = F.lit(None)
    one = lambda c, path, kind: F.struct(F.lit(c).alias("field"), none.cast("bigint").alias("pos"),
                                         (F.variant_get("v", path, "double") if kind == "number" else none.cast("double")).alias("number"),
                                         (F.variant_get("v", path, "string") if kind == "text" else none.cast("string")).alias("text"))
    single = [one(c, f"$.metrics.{c}", "number") for c in SNAP_FIELDS]
    single += [one(c, p, "text") for c, p in (("engine_type", "$.engine_type"), ("endpoint", "$.endpoint"), ("status", "$.status.type"), ("model_name", "$.model_name"))]
    lists = []
    for h in HIST_FIELDS:
        found = F.coalesce(F.variant_get("v", f"$.metrics.{h}", "array<struct<le_seconds: double, cumulative_count: double>>"), F.array())
        for part in ("le_seconds", "cumulative_count"):
            lists.append(F.transform(found, _wire_value(h, part)))
    return v.select("tick_ts", "engine_key", F.inline(F.concat(F.array(*single), *lists)))


_LISTED = ", ".join(f"CAST(max(CASE WHEN metric = '{m}' THEN n END) AS BIGINT) AS {m}_bounds, max(CASE WHEN metric = '{m}' THEN total END) AS {m}_total, max(CASE WHEN metric = '{m}' THEN top END) AS {m}_top"
                    for m, _ in fx.HIST_SCALE)


@query("snapshot_decode", fx.duck_cte("engine_snapshots", "hist_buckets").rstrip("\n") + f""",
b AS (SELECT engine_key, tick_ts, metric, count(*) AS n, sum(cum) AS total, max(le) AS top FROM hist_buckets GROUP BY 1, 2, 3),
l AS (SELECT engine_key, tick_ts, {_LISTED} FROM b GROUP BY 1, 2)
SELECT tick_ts, engine_key, engine_type, endpoint, status_type, model_name, {', '.join(SNAP_FIELDS)}, l.* EXCLUDE (engine_key, tick_ts)
FROM engine_snapshots LEFT JOIN l USING (engine_key, tick_ts)
""")
def q_snapshot_decode(spark, sf):
    """All fields of every message. Among the messages are cut ones, texts that are no JSON and JSON without an engine, which are skipped."""
    good = encoded_snapshots(spark, sf)
    cut = good.where((F.col("tick_ts") / HOUR_MS) % 13 == 0).withColumn("message", F.expr("substring(message, 1, length(message) div 2)"))
    other = good.where((F.col("tick_ts") / HOUR_MS) % 13 == 1).withColumn("message", F.when(F.col("engine_key") == "engine-1", "no json").when(F.col("engine_key") == "engine-2", '{"a": 1}').otherwise(""))
    d = snapshot_decode(good.unionByName(cut).unionByName(other), snap_schema(spark, sf))
    lists = [x for m, _ in fx.HIST_SCALE for x in (
        F.when(F.col(f"{m}_buckets").isNotNull(), F.size(f"{m}_buckets")).cast("bigint").alias(f"{m}_bounds"),
        F.aggregate(f"{m}_buckets", F.lit(0.0), lambda a, x: a + x["cum"]).alias(f"{m}_total"), F.element_at(f"{m}_buckets", -1)["le"].alias(f"{m}_top"))]
    return d.select("tick_ts", "engine_key", "engine_type", "endpoint", "status_type", "model_name", *SNAP_FIELDS, *lists)


# ---------------------------------------------------------------- nodes

def _node_polls_sql(d) -> str:
    q = '\'"\''
    return _s(f"""SELECT 'http://node-' || CAST(user_id % 6 AS STRING) || ':9090' AS url, {d.ms('ts')} AS ts, event_id AS seq,
  CASE WHEN event_type IN ('error', 'view', 'click') THEN 'HTTP 503'
       WHEN user_id % 5 = 0 AND event_type = 'signup' THEN chr(123) || '"hostname": "gpu-'
       ELSE chr(123) || '"hostname": ' || {q} || 'gpu-' || CAST(user_id % 6 AS STRING) || {q} || ', "snapshot": ' || chr(123)
            || '"gpu_power": ' || CAST(value AS STRING) || ', "gpu_util": ' || CAST(event_id % 100 AS STRING) || chr(125) || chr(125) END AS payload
FROM {d.t('events')}""", d)


def node_polls(spark, sf):
    return ND.node_ingest(spark.sql(_node_polls_sql(fx.SPARK), events=tables.read(spark, sf, "events", "user_id", "ts", "event_id", "event_type", "value")))


_NODE_DUCK = f"""
WITH p0 AS ({_node_polls_sql(D)}),
pv AS (SELECT url, ts, seq, CASE WHEN json_valid(payload) THEN payload END AS payload FROM p0),
p AS (SELECT url, ts, seq,
  COALESCE(json_extract_string(payload, '$.hostname') IS NOT NULL AND json_extract(payload, '$.snapshot') IS NOT NULL, FALSE) AS success,
  payload FROM pv),
n AS (SELECT url, ts, seq, success,
  CASE WHEN success THEN json_extract_string(payload, '$.hostname') END AS hostname,
  CASE WHEN success THEN CAST(json_extract(payload, '$.snapshot.gpu_power') AS DOUBLE) END AS gpu_power,
  CASE WHEN success THEN CAST(json_extract(payload, '$.snapshot.gpu_util') AS DOUBLE) END AS gpu_util FROM p)
"""


@query("node_ingest", _NODE_DUCK + "SELECT * FROM n")
def q_node_ingest(spark, sf):
    return node_polls(spark, sf)


def _roster_sql(d) -> str:
    return _s(f"SELECT DISTINCT 'http://node-' || CAST(c_custkey % 8 AS STRING) || ':9090' AS url FROM {d.t('customer')}", d)


@query("node_roster", _NODE_DUCK + f""",
a AS (SELECT *, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS f_run FROM n),
b AS (SELECT *, f_run - COALESCE(last_value(CASE WHEN success THEN f_run END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS streak FROM a),
l AS (SELECT url, arg_max({{'s': success, 'k': streak}}, (ts, seq)) AS last,
        arg_max({{'t': ts, 'h': hostname, 'p': gpu_power}}, (ts, seq)) FILTER (WHERE success) AS ok FROM b GROUP BY url),
r AS ({_roster_sql(D)})
SELECT r.url, COALESCE(l.ok.h, r.url) AS hostname, COALESCE(l.last.s, FALSE) AS online, COALESCE(l.ok.t, 0) AS last_seen_ms,
  CASE WHEN l.ok IS NOT NULL AND COALESCE(l.last.k, 0) < 10 THEN l.ok.p END AS snapshot_gpu_power,
  COALESCE(l.last.k, 0) AS failures
FROM r LEFT JOIN l USING (url)
""")
def q_node_roster(spark, sf):
    roster = spark.sql(_roster_sql(fx.SPARK), customer=tables.read(spark, sf, "customer", "c_custkey"))
    return ND.node_roster(roster, node_polls(spark, sf).select("url", "ts", "seq", "success", "hostname", "gpu_power", "gpu_util"))


def _models_resp_sql(d) -> str:
    q = '\'"\''
    return _s(f"""SELECT conv_id, turn, 'upstream-' || CAST(conv_id % 5 AS STRING) AS upstream,
  CASE WHEN turn % 7 = 3 THEN 502 ELSE 200 END AS status,
  CASE WHEN turn % 11 = 5 THEN 'upstream timeout'
       ELSE chr(123) || '"object": "list", "data": [' || chr(123) || '"id": ' || {q} || 'model-' || CAST(conv_id % 9 AS STRING) || {q}
         || ', "owned_by": "vllm"' || chr(125) || ', ' || chr(123) || '"id": ' || {q} || 'model-' || CAST(turn % 4 AS STRING) || '-' || role || {q}
         || ', "owned_by": "vllm"' || chr(125) || ']' || chr(125) END AS body
FROM {d.t('conversations')}""", d)


@query("catalog_merge", f"""
WITH r AS ({_models_resp_sql(D)}), ok AS (SELECT * FROM r WHERE status = 200 AND json_valid(body))
SELECT conv_id, turn, upstream, status, CAST(u.pos - 1 AS INT) AS pos, json_extract_string(u.m, '$.id') AS model_id,
  json_extract_string(u.m, '$.owned_by') AS owned_by
FROM ok, LATERAL (SELECT unnest(CAST(json_extract(body, '$.data') AS JSON[])) AS m, generate_subscripts(CAST(json_extract(body, '$.data') AS JSON[]), 1) AS pos) u
""")
def q_catalog_merge(spark, sf):
    r = spark.sql(_models_resp_sql(fx.SPARK), conversations=tables.read(spark, sf, "conversations", "conv_id", "turn", "role"))
    return ND.catalog_merge(r)


# ---------------------------------------------------------------- tier writes

EARLIER = W.NOW_MS - 6 * HOUR_MS


@query("upsert_replace", W.tier_cte() + f""",
old AS (SELECT engine_key, (ts // 3600000) * 3600000 AS bucket_ts, count(*) AS sample_count FROM snapshots_1s
        WHERE ts < {(EARLIER // HOUR_MS) * HOUR_MS} AND ts % 2 = 0 GROUP BY 1, 2),
new AS (SELECT engine_key, bucket_ts, sample_count FROM hourly_all WHERE bucket_ts >= {(EARLIER // HOUR_MS) * HOUR_MS - DAY_MS})
SELECT * FROM old WHERE (engine_key, bucket_ts) NOT IN (SELECT (engine_key, bucket_ts) FROM new)
UNION ALL SELECT * FROM new
""")
def q_upsert_replace(spark, sf):
    raw = W.raw(spark, sf)
    # an earlier rollup run saw only half of the rows; the re-run replaces the buckets it recomputes
    old = T.rollup_1h(raw.where(F.col("ts") % 2 == 0), EARLIER).select("engine_key", "bucket_ts", "sample_count")
    new = T.rollup_1h(raw, W.NOW_MS).where(F.col("bucket_ts") >= (EARLIER // HOUR_MS) * HOUR_MS - DAY_MS).select(
        "engine_key", "bucket_ts", "sample_count")
    return T.upsert_replace(old, new)


# ---------------------------------------------------------------- chart metric sets

def _avg_cfg(m):
    return (f"{m}_avg", [m], None)


def _perreq_cfg(m):
    return (f"{m}_per_req", [m, "active_requests"], None)


# chart configurations of the throughput charts: direct series plus derived ones
CHART_CONFIGS = ["prompt_tps", _avg_cfg("prompt_tps"), _perreq_cfg("prompt_tps"),
                 "decode_tps", _avg_cfg("decode_tps"), _perreq_cfg("decode_tps"), "ttft_ms", "itl_ms"]


@query("metric_set", W.tier_cte() + f""", hp AS ({_unpivot_tier_sql('snapshots_1h')})
SELECT engine_key, metric, timestamp_ms, value,
  CASE metric WHEN 'prompt_tps' THEN 0 WHEN 'active_requests' THEN 1 WHEN 'decode_tps' THEN 2 WHEN 'ttft_ms' THEN 3 WHEN 'itl_ms' THEN 4 END AS metric_order
FROM hp WHERE metric IN ('prompt_tps', 'active_requests', 'decode_tps', 'ttft_ms', 'itl_ms')
""")
def q_metric_set(spark, sf):
    from .charts import collect_needed_metrics, fetch_metrics
    needed = collect_needed_metrics(CHART_CONFIGS)
    assert needed == ["prompt_tps", "active_requests", "decode_tps", "ttft_ms", "itl_ms"]
    return fetch_metrics(W.hourly(spark, sf), needed)
