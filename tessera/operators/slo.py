"""SLO thresholds, goodput recomputation and per-poll ratio metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import histograms as HG

# Default SLO thresholds in milliseconds.
DEFAULT_SLO = {"ttft": 500.0, "itl": 50.0, "e2e": 5000.0, "tpot": 50.0}

_BLOB_SCHEMA = "ttftMs double, itlMs double, e2eMs double, tpotMs double"


def parse_thresholds(raw: Column) -> Column:
    """Validated thresholds struct from a stored JSON blob, or null.

    TTFT/ITL/E2E must be finite numbers > 0; a missing TPOT defaults to 50, a
    present-but-invalid TPOT rejects the blob. Non-numeric values make the
    JSON parse fail for the record, which rejects it too.
    """
    p = F.from_json(raw, _BLOB_SCHEMA)
    # Presence of the key, not of a value: an explicit null is present and invalid.
    has_tpot = F.coalesce(F.map_contains_key(F.from_json(raw, "map<string,string>"), "tpotMs"), F.lit(False))

    def ok(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))) & (c > 0)

    valid = ok(p["ttftMs"]) & ok(p["itlMs"]) & ok(p["e2eMs"]) & (~has_tpot | ok(p["tpotMs"]))
    return F.when(
        valid,
        F.struct(
            p["ttftMs"].alias("ttft_ms"), p["itlMs"].alias("itl_ms"), p["e2eMs"].alias("e2e_ms"),
            F.when(has_tpot, p["tpotMs"]).otherwise(F.lit(DEFAULT_SLO["tpot"])).alias("tpot_ms"),
        ),
    )


def slo_thresholds(engines: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per (engine, model): the latest stored blob if valid, else the defaults; ``is_customized`` flag.

    ``blobs``: (seq, engine_key, model_name, raw); the latest write has the
    highest ``seq``. Engines without a model always use the defaults.
    """
    latest = (
        blobs.where(F.col("model_name").isNotNull())
        .groupBy("engine_key", "model_name")
        .agg(F.max_by("raw", "seq").alias("raw"))
        .select("engine_key", "model_name", parse_thresholds(F.col("raw")).alias("t"))
        .where(F.col("t").isNotNull())
    )
    j = engines.join(latest, ["engine_key", "model_name"], "left")
    return j.select(
        "engine_key", "model_name",
        F.coalesce(F.col("t.ttft_ms"), F.lit(DEFAULT_SLO["ttft"])).alias("ttft_ms"),
        F.coalesce(F.col("t.itl_ms"), F.lit(DEFAULT_SLO["itl"])).alias("itl_ms"),
        F.coalesce(F.col("t.e2e_ms"), F.lit(DEFAULT_SLO["e2e"])).alias("e2e_ms"),
        F.coalesce(F.col("t.tpot_ms"), F.lit(DEFAULT_SLO["tpot"])).alias("tpot_ms"),
        F.col("t").isNotNull().alias("is_customized"),
    )


def slo_join(snapshots: DataFrame, thresholds: DataFrame, buckets: DataFrame) -> DataFrame:
    """Engine rows joined to their thresholds (the defaults where there is no row); goodput recomputed from histogram buckets,
    falling back to the stored percentage when buckets are missing.

    ``thresholds`` has one row per (engine, model) -- a catalogue-sized table;
    ``buckets`` is (engine_key, tick_ts, metric, buckets).
    """
    per = buckets.groupBy("engine_key", "tick_ts").pivot("metric", ["ttft", "itl", "e2e", "tpot"]).agg(F.first("buckets"))
    th = thresholds.select(
        F.col("engine_key").alias("_ek"), F.col("model_name").alias("_mn"), "is_customized",
        *[F.col(f"{m}_ms").alias(f"slo_{m}_ms") for m in DEFAULT_SLO],
    )
    s = snapshots.join(th, snapshots["engine_key"].eqNullSafe(th["_ek"]) & snapshots["model_name"].eqNullSafe(th["_mn"]), "left")
    s = s.withColumns({f"slo_{m}_ms": F.coalesce(f"slo_{m}_ms", F.lit(v)) for m, v in DEFAULT_SLO.items()})
    s = s.withColumn("is_customized", F.coalesce("is_customized", F.lit(False)))
    s = s.join(per, ["engine_key", "tick_ts"], "left")

    def gp(m: str) -> Column:
        thr = f"(`slo_{m}_ms` / 1000.0D)"
        return F.expr(f"100.0D * {HG.fraction_le_sql(f'`{m}`', thr)}")

    return s.select(
        "engine_key", "tick_ts", "is_customized",
        F.coalesce(gp("ttft"), F.col("ttft_goodput_pct")).alias("ttft_goodput_pct"),
        F.coalesce(gp("itl"), F.col("itl_goodput_pct")).alias("itl_goodput_pct"),
        F.coalesce(gp("e2e"), F.col("e2e_goodput_pct")).alias("e2e_goodput_pct"),
    )


def ratio_metrics(prompt_total: Column, ttft_sum: Column, tpot_count: Column, tpot_sum: Column,
                  hits: Column, queries: Column, kv_usage: Column) -> list[Column]:
    """Per-poll ratios: prompt tps per request, tps per request, prefix hit %, KV %."""
    return [
        F.when((ttft_sum > 0) & prompt_total.isNotNull(), prompt_total / ttft_sum).alias("per_request_prompt_tps"),
        F.when((tpot_count > 0) & (tpot_sum > 0), tpot_count / tpot_sum).alias("per_request_tps"),
        F.when((queries > 0) & hits.isNotNull(), hits / queries * 100.0).alias("prefix_cache_hit_rate"),
        (kv_usage * 100.0).alias("kv_cache_percent"),
    ]
