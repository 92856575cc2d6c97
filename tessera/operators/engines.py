"""Engine metric plumbing: version fallbacks, source mapping, warm-up mask, model descriptors, latency modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical metric -> exposition names, preferred first.
VERSION_NAMES = {
    "kv_cache_usage": ("vllm_kv_cache_usage_perc", "vllm_gpu_cache_usage_perc"),
    "tpot_sum": ("vllm_request_time_per_output_token_seconds_sum", "vllm_time_per_output_token_seconds_sum"),
    "tpot_count": ("vllm_request_time_per_output_token_seconds_count", "vllm_time_per_output_token_seconds_count"),
    "spec_accepted": ("vllm_spec_decode_num_accepted_tokens_total", "vllm_spec_decode_num_accepted_tokens"),
    "spec_draft": ("vllm_spec_decode_num_draft_tokens_total", "vllm_spec_decode_num_draft_tokens"),
    "spec_drafts": ("vllm_spec_decode_num_drafts_total", "vllm_spec_decode_num_drafts"),
}


def version_fallback(samples: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Per key: each canonical metric from its first present exposition name.

    One conditional aggregate per wanted name. Of a repeated name the last
    sample counts (by ``order``; the largest value where no order is given).
    """
    def pick(name: str) -> Column:
        own = F.when(F.col("name") == name, F.col("value"))
        return F.max_by(own, F.when(F.col("name") == name, F.col(order))) if order else F.max(own)

    return samples.groupBy(*keys).agg(*[F.coalesce(*map(pick, names)).alias(c) for c, names in VERSION_NAMES.items()])


def mapping_table(spark: SparkSession) -> DataFrame:
    """(engine_type, canonical, source name, priority): a new engine type is new rows, not new code."""
    rows = [("vllm", c, n, i) for c, names in VERSION_NAMES.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "engine_type string, canonical string, source string, priority int")


def metric_mapping(spark: SparkSession, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of ``version_fallback`` through the mapping table (broadcast; fixed size)."""
    mp = F.broadcast(mapping_table(spark))
    j = samples.join(mp, (samples["engine_type"] == mp["engine_type"]) & (samples["name"] == mp["source"]), "inner")
    return j.groupBy(*keys, "canonical").agg(F.min_by("value", "priority").alias("value"))


# Engine fields blanked while an engine warms up.
WARMUP_MASKED = (
    "tokens_per_sec", "avg_tokens_per_sec", "per_request_tps", "ttft_ms", "e2e_latency_ms", "prompt_tokens_per_sec",
    "avg_prompt_tokens_per_sec", "per_request_prompt_tps", "queue_time_ms", "inter_token_latency_ms", "avg_batch_size",
    "ttft_p50_ms", "ttft_p95_ms", "ttft_p99_ms", "itl_p50_ms", "itl_p95_ms", "itl_p99_ms", "e2e_p50_ms", "e2e_p95_ms",
    "e2e_p99_ms", "ttft_goodput_pct", "itl_goodput_pct", "e2e_goodput_pct", "spec_decode_acceptance_rate_live",
    "tpot_ms", "tpot_p50_ms", "tpot_p95_ms", "tpot_p99_ms", "tpot_goodput_pct",
    "ttft_buckets", "itl_buckets", "e2e_buckets", "tpot_buckets",
)


def warmup_mask(df: DataFrame, warming: Column) -> DataFrame:
    """Null the derived fields while warming; gauges, lifetime counters and lifetime ratios pass."""
    return df.select(*[F.when(~warming, F.col(c)).alias(c) if c in WARMUP_MASKED else F.col(c) for c in df.columns])


# Quantisation method labels.
QUANT_LABELS = {"auto-round": "AutoRound", "gptq": "GPTQ", "awq": "AWQ", "bitsandbytes": "BitsAndBytes", "fp8": "FP8"}
# Preferred float tensor dtypes, in order.
FLOAT_DTYPES = ("BF16", "F16", "F32", "F64", "FP8")


def param_size_label(count: Column) -> Column:
    """'12.3B params' / '45.6M params' / 'N params' (one decimal, half-to-even like the reference's formatter)."""
    b = F.format_string("%.1fB params", F.bround(count / 1e9, 1))
    m = F.format_string("%.1fM params", F.bround(count / 1e6, 1))
    return F.when(count >= 1_000_000_000, b).when(count >= 1_000_000, m).otherwise(F.concat(count.cast("string"), F.lit(" params")))


def quant_label(method: Column) -> Column:
    e = F.create_map(*[x for k, v in QUANT_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(e, method), method)


def tensor_type(dtypes: Column) -> Column:
    """First preferred float dtype present, else the smallest key (deterministic stand-in for 'any key')."""
    pref = F.coalesce(*[F.when(F.array_contains(dtypes, d), F.lit(d)) for d in FLOAT_DTYPES])
    return F.coalesce(pref, F.array_min(dtypes))


def model_descriptors(meta: DataFrame) -> DataFrame:
    """Labels from model metadata: size, quantisation, precision, tensor type, model type, pipeline tag."""
    return meta.select(
        "model_id",
        F.when(F.col("param_total").isNotNull(), param_size_label(F.col("param_total"))).alias("parameter_size"),
        quant_label(F.col("quant_method")).alias("quantization"),
        F.when(F.col("bits").isNotNull(), F.concat(F.col("bits").cast("string"), F.lit("-bit precision"))).alias("precision"),
        F.when(F.col("dtypes").isNotNull(), tensor_type(F.col("dtypes"))).alias("tensor_type"),
        "model_type", "pipeline_tag",
    )


def latency_statistic(mode: Column, avg: Column, p50: Column, p95: Column, p99: Column) -> Column:
    """avg / p50 / p95 / p99 by mode; a percentile mode without a percentile struct gives null; unknown -> avg."""
    has = p50.isNotNull() | p95.isNotNull() | p99.isNotNull()
    return (F.when(mode == "p50", F.when(has, p50)).when(mode == "p95", F.when(has, p95))
            .when(mode == "p99", F.when(has, p99)).otherwise(avg))
