"""Fleet roll-ups over engine snapshots: one output row per tick.

All are single ``groupBy(tick)`` aggregations with conditional aggregate
expressions (partial aggregation map side; no per-engine collect). Small
reference tables (provider aliases, keywords) are broadcast: their size is
fixed by this module, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def running() -> Column:
    return F.col("status_type") == F.lit("Running")

SUM_FIELDS = [
    "tokens_per_sec", "avg_tokens_per_sec", "prompt_tokens_per_sec", "avg_prompt_tokens_per_sec",
    "active_requests", "queued_requests", "total_requests", "swapped_requests", "preemptions_total",
    "total_prompt_tokens", "total_generation_tokens", "prefix_cache_queries_total",
]
WEIGHTED_FIELDS = ["ttft_ms", "e2e_latency_ms", "queue_time_ms", "inter_token_latency_ms", "per_request_tps", "per_request_prompt_tps"]
MEAN_FIELDS = ["avg_batch_size", "kv_cache_percent", "prefix_cache_hit_rate"]
PCT_FIELDS = [f"{m}_{q}_ms" for m in ("ttft", "itl", "e2e") for q in ("p50", "p95", "p99")]
GOODPUT_FIELDS = ["ttft_goodput_pct", "itl_goodput_pct", "e2e_goodput_pct"]
SPEC_FIELDS = ["spec_decode_draft_tokens_total", "spec_decode_accepted_tokens_total", "spec_decode_drafts_total"]


def weighted_mean(v: Column, w: Column, cond: Column | None = None) -> Column:
    """Sum(v*w)/sum(w) over rows with a value and w > 0; else the plain mean of present values; null if none."""
    c = v.isNotNull() & (w > 0)
    if cond is not None:
        c = c & cond
        v_all = F.when(cond, v)
    else:
        v_all = v
    num = F.sum(F.when(c, v * w))
    den = F.sum(F.when(c, w))
    return F.when(den > 0, num / den).otherwise(F.avg(v_all))


def _ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    return F.when(num.isNotNull() & (den > 0), num / den * scale)


def fleet_aggregate(snaps: DataFrame, tick: str = "tick_ts") -> DataFrame:
    """Fleet card per tick over running engines (all null but ``total_count`` when none runs)."""
    r = running()
    w = F.col("total_requests")
    aggs = [
        F.count_if(r).alias("running_count"),
        F.count(F.lit(1)).alias("total_count"),
        *[F.sum(F.when(r, F.col(c))).alias(c) for c in SUM_FIELDS],
        *[F.sum(F.when(r, F.col(c))).alias(c) for c in SPEC_FIELDS],
        weighted_mean(F.col("spec_decode_acceptance_rate_live"), F.col("spec_decode_draft_tokens_total"), r).alias(
            "spec_decode_acceptance_rate_live"),
        *[weighted_mean(F.col(c), w, r).alias(c) for c in WEIGHTED_FIELDS],
        *[F.avg(F.when(r, F.col(c))).alias(c) for c in MEAN_FIELDS],
        *[weighted_mean(F.col(c), w, r).alias(c) for c in PCT_FIELDS],
        *[weighted_mean(F.col(c), w, r).alias(c) for c in GOODPUT_FIELDS],
    ]
    g = snaps.groupBy(tick).agg(*aggs)
    g = g.withColumn("spec_decode_acceptance_rate",
                     _ratio(F.col("spec_decode_accepted_tokens_total"), F.col("spec_decode_draft_tokens_total"), 100.0))
    g = g.withColumn("spec_decode_mean_acceptance_length",
                     _ratio(F.col("spec_decode_accepted_tokens_total"), F.col("spec_decode_drafts_total")))
    # no running engine: everything but total_count is null
    keep = {tick, "total_count", "running_count"}
    return g.select(*[F.col(c) if c in keep else F.when(F.col("running_count") > 0, F.col(c)).alias(c) for c in g.columns])


# ---------------------------------------------------------------- providers

# Lower-cased org prefix -> provider slug.
ORG_ALIAS = {
    "mistralai": "mistral-ai", "deepseek-ai": "deepseek", "meta-llama": "meta", "moonshotai": "moonshot-ai",
    "unsloth-ai": "unsloth", "zai": "z-ai", "zai-org": "z-ai", "minimaxai": "minimax", "minimax-ai": "minimax",
    "liquidai": "liquid-ai",
}
# Org prefixes that are slugs themselves.
ORG_IDENTITY = (
    "qwen", "google", "openai", "microsoft", "meta", "nvidia", "deepseek", "mistral-ai", "moonshot-ai",
    "unsloth", "z-ai", "minimax", "huggingfacetb", "intel", "liquid-ai",
)
# Keyword scan in order (keyword, slug, label); first hit wins.
KEYWORDS = (
    ("qwen", "qwen", "Qwen"), ("deepseek", "deepseek", "DeepSeek"), ("mixtral", "mistral-ai", "Mistral AI"),
    ("mistral", "mistral-ai", "Mistral AI"), ("llama", "meta", "Meta"), ("gemma", "google", "Google"),
    ("gemini", "google", "Google"), ("phi-", "microsoft", "Microsoft"), ("kimi", "moonshot-ai", "Moonshot AI"),
    ("glm-", "z-ai", "Z.ai"), ("minimax", "minimax", "MiniMax"), ("gpt-", "openai", "OpenAI"),
    ("lfm", "liquid-ai", "LiquidAI"),
)


def _org_table(spark: SparkSession) -> DataFrame:
    rows = [(k, v) for k, v in ORG_ALIAS.items()] + [(k, k) for k in ORG_IDENTITY if k not in ORG_ALIAS]
    return spark.createDataFrame(rows, "org string, slug string")


def provider_resolve(spark: SparkSession, df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Adds ``provider_slug``, ``provider_alt`` and ``raw_prefix`` for a model-name column.

    With an ``Org/`` prefix the org alone decides (alias, else identity,
    else null, label = raw prefix); without one, the first keyword contained
    in the lower-cased name wins: one conditional per fixed keyword, in order.
    """
    name = F.trim(F.col(name_col))
    slash = F.instr(name, "/")
    d = df.withColumn("_nm", name).withColumn(
        "raw_prefix", F.when(slash > 1, F.trim(F.substring_index(name, "/", 1)))
    ).withColumn("_has_slash", F.coalesce(slash > 1, F.lit(False)))
    orgs = F.broadcast(_org_table(spark))
    d = d.join(orgs, F.lower(d["raw_prefix"]) == orgs["org"], "left").drop("org")
    kw = F.coalesce(*[F.when(F.lower(F.col("_nm")).contains(k), F.struct(F.lit(sl).alias("kw_slug"), F.lit(al).cast("string").alias("kw_alt"))) for k, sl, al in KEYWORDS])
    d = d.withColumn("_kw", F.when(~F.col("_has_slash") & (F.length("_nm") > 0), kw))
    slug = F.when(F.col("_has_slash"), F.when(F.col("raw_prefix") != "", F.col("slug"))).otherwise(F.col("_kw.kw_slug"))
    alt = F.when(F.col("_has_slash"), F.when((F.col("raw_prefix") != "") & F.col("slug").isNotNull(), F.col("raw_prefix"))).otherwise(
        F.col("_kw.kw_alt"))
    return d.withColumn("provider_slug", slug).withColumn("provider_alt", alt).drop("_nm", "_has_slash", "slug", "_kw")


def provider_groups(spark: SparkSession, snaps: DataFrame, tick: str = "tick_ts", order_col: str = "engine_key") -> DataFrame:
    """Running engines counted per provider per tick, ordered by count desc then label.

    Key/label: provider slug/label; else ``raw:<lower prefix>``/prefix; else
    ``unknown``/``Unknown``. A group's label is that of its first engine.
    """
    run = snaps.where(running()).withColumn("_rid", F.concat_ws("|", F.col(tick).cast("string"), F.col(order_col)))
    r = provider_resolve(spark, run, "_rid", "model_name")
    key = (
        F.when(F.col("provider_slug").isNotNull(), F.col("provider_slug"))
        .when(F.col("model_name").isNotNull() & (F.coalesce(F.col("raw_prefix"), F.lit("")) != ""),
              F.concat(F.lit("raw:"), F.lower("raw_prefix")))
        .otherwise(F.lit("unknown"))
    )
    label = (
        F.when(F.col("provider_slug").isNotNull(), F.col("provider_alt"))
        .when(F.col("model_name").isNotNull() & (F.coalesce(F.col("raw_prefix"), F.lit("")) != ""), F.col("raw_prefix"))
        .otherwise(F.lit("Unknown"))
    )
    g = r.withColumn("group_key", key).withColumn("label", label).groupBy(tick, "group_key").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("label", order_col).alias("label"))
    w = Window.partitionBy(tick).orderBy(F.col("count").desc(), F.col("label"))
    return g.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))


def active_engine(snaps: DataFrame, tick: str = "tick_ts", order_col: str = "engine_key") -> DataFrame:
    """First running engine per tick (in engine order) with its model and throughput."""
    return snaps.where(running()).groupBy(tick).agg(
        F.min_by(F.struct(order_col, "model_name", "tokens_per_sec"), order_col).alias("_a")
    ).select(tick, F.col(f"_a.{order_col}").alias(order_col), "_a.model_name", "_a.tokens_per_sec")


def pressure_flags(snaps: DataFrame) -> list[Column]:
    return [
        F.coalesce((F.col("swapped_requests") > 0) | (F.col("preemptions_total") > 0), F.lit(False)).alias("memory_pressure"),
        F.coalesce(F.col("spec_decode_draft_tokens_total") > 0, F.lit(False)).alias("spec_decode_shown"),
        (F.col("status_type").isin("Running", "Loading") & F.col("model_name").isNotNull()
         & F.col("tokens_per_sec").isNull()).alias("waiting"),
    ]


def instance_label(model: Column, endpoint: Column, engine_name: Column) -> Column:
    """Short model name (after the last '/'), else ':port' from the endpoint, else the engine name."""
    short = F.when(model.isNotNull() & (model != ""), F.substring_index(model, "/", -1))
    port = F.regexp_extract(endpoint, r":(\d+)(?:/|$)", 1)
    return F.coalesce(short, F.when(port != "", F.concat(F.lit(":"), port)), engine_name)


def model_identity(api_id: Column, hint: Column) -> Column:
    """API id containing '/', else the launch hint, else the API id."""
    return F.coalesce(F.when(api_id.contains("/"), api_id), hint, api_id)
