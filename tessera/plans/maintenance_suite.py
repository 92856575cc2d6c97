"""Registered queries: purge, backfill, retention, schema evolution, settings, storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeutil import DAY_MS
from ..operators import settings as SE
from ..operators import tiers as T
from ..session import scratch_dir
from ..sources import fixtures as fx
from ..sources import tables
from ..sources import tier_store as TS
from . import world as W
from .registry import query

PRUNE_AT = W.NOW_MS - 20 * DAY_MS


def _tiers_sql(value: str, hour_value: str) -> str:
    """The three tiers as one table (tier, engine_key, time_ms, v)."""
    return f"""
SELECT 'raw' AS tier, engine_key, ts AS time_ms, {value} AS v FROM snapshots_1s
UNION ALL SELECT 'hour', engine_key, bucket_ts, {hour_value} FROM snapshots_1h
UNION ALL SELECT 'day', engine_key, bucket_ts, {hour_value} FROM snapshots_1d
"""


def _all_tiers(spark, folder: str, columns: dict[str, str], name: str):
    """The three tiers of a folder as one table; ``columns``: tier -> the column shown as ``name``."""
    out = None
    for tier, (at, _) in TS.TIERS.items():
        rows = TS.read(spark, folder, tier).select(F.lit(tier).alias("tier"), "engine_key", F.col(at).alias("time_ms"), F.col(columns[tier]).alias(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def _copy(spark, sf, name: str, change) -> str:
    """A folder with the stored tiers of ``sf``, each changed by ``change(df, tier)``."""
    folder = scratch_dir(spark, name)
    for tier in TS.TIERS:
        TS.write(change(W.stored(spark, sf, tier), tier), folder, tier)
    return folder


# Cumulative totals that old versions left behind: above the limit, at it, or on top of it by one.
LIMIT = T.PURGE_LIMIT


def _planted_sql(at: str) -> str:
    h = f"({at} + length(engine_key)) % 11"
    return f"CASE {h} WHEN 0 THEN total_prompt_tokens + {LIMIT} + 1 WHEN 1 THEN {LIMIT} WHEN 2 THEN {LIMIT + 1} ELSE total_prompt_tokens END"


def _planted_tier_sql() -> str:
    # a whole day of cumulative totals in each rollup tier
    return f"CASE WHEN bucket_ts // 86400000 = {W.DAY_CUT // DAY_MS - 3} THEN {LIMIT} * 2 ELSE {_planted_sql('bucket_ts // 3600000')} END"


@query("purge_cumulative", W.tier_cte() + f"""
SELECT tier, engine_key, time_ms, v AS total_prompt_tokens FROM ({_tiers_sql(_planted_sql('ts'), _planted_tier_sql())}) t
WHERE NOT coalesce(v > {LIMIT}, false)
""")
def q_purge_cumulative(spark, sf):
    def planted(df, tier):
        text = _planted_sql("ts") if tier == "raw" else _planted_tier_sql().replace("//", "div")
        return df.withColumn("total_prompt_tokens", F.expr(text))

    folder = _copy(spark, sf, "purge", planted)
    TS.purge(spark, folder)
    return _all_tiers(spark, folder, dict.fromkeys(TS.TIERS, "total_prompt_tokens"), "total_prompt_tokens")


_BACKFILLED = W.tier_cte() + f"""
SELECT tier, engine_key, time_ms, v * 4.0 AS power, CAST({{runs}} AS BIGINT) AS runs, CAST(1 AS BIGINT) AS markers
FROM ({_tiers_sql('power_watts', 'power_watts_sum')}) t
"""


def _backfilled(spark, sf, runs: int):
    """The tiers after so many runs of the one-time change; each run reads the marker that the first one wrote."""
    base = scratch_dir(spark, "backfill")
    folder = W.store(spark, sf)
    for k in range(runs):
        folder = TS.backfill_power(spark, folder, f"{base}/{k}")
    return _all_tiers(spark, folder, TS.POWER, "power").crossJoin(
        TS.markers(spark, folder).agg(F.lit(runs).cast("bigint").alias("runs"), F.count("*").alias("markers")))  # one row


@query("power_backfill", _BACKFILLED.format(runs=1))
def q_power_backfill(spark, sf):
    return _backfilled(spark, sf, 1)


@query("power_backfill_rerun", _BACKFILLED.format(runs=3))
def q_power_backfill_rerun(spark, sf):
    return _backfilled(spark, sf, 3)


@query("retention_prune", W.tier_cte() + f"""
, t AS ({_tiers_sql('NULL', 'NULL')}),
n AS (SELECT tier, count(*) FILTER (time_ms < {PRUNE_AT}) AS dropped FROM t GROUP BY tier)
SELECT tier, engine_key, time_ms, dropped FROM t JOIN n USING (tier) WHERE time_ms >= {PRUNE_AT}
""")
def q_retention_prune(spark, sf):
    folder = _copy(spark, sf, "prune", lambda df, tier: df)
    counts = TS.prune(spark, folder, PRUNE_AT)
    rows = _all_tiers(spark, folder, {t: at for t, (at, _) in TS.TIERS.items()}, "_at").drop("_at")
    return rows.withColumn("dropped", F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("tier")).cast("bigint"))


# Rows before this time were written by a version without the later columns.
EVOLVED_AT = W.NOW_MS - 10 * DAY_MS
_EVOLVED = ["preemptions_total", "queue_time_ms", "tpot_ms", "kv_cache_pct_max", "queue_time_ms_avg", "tpot_ms_avg"]


def _evolved_sql() -> str:
    parts = []
    for tier, table in (("raw", "snapshots_1s"), ("hour", "snapshots_1h"), ("day", "snapshots_1d")):
        at = TS.TIERS[tier][0]
        cols = ", ".join(f"CASE WHEN {at} >= {EVOLVED_AT} THEN {c} END AS {c}" if c in TS.ADDED[tier] else f"NULL AS {c}" for c in _EVOLVED)
        parts.append(f"SELECT '{tier}' AS tier, engine_key, {at} AS time_ms, total_requests, {cols} FROM {table}")
    return W.tier_cte() + " UNION ALL ".join(parts)


@query("schema_evolve", _evolved_sql())
def q_schema_evolve(spark, sf):
    """Old files without the later columns and new files with them, in one folder, read under the present schema."""
    folder = scratch_dir(spark, "evolve")
    out = None
    for tier, (at, _) in TS.TIERS.items():
        rows = W.stored(spark, sf, tier)
        TS.write(rows.where(F.col(at) < EVOLVED_AT).drop(*TS.ADDED[tier]), folder, tier)
        TS.write(rows.where(F.col(at) >= EVOLVED_AT), folder, tier)
        own = TS.read(spark, folder, tier).select(F.lit(tier).alias("tier"), "engine_key", F.col(at).alias("time_ms"), "total_requests", *TS.ADDED[tier])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.select("tier", "engine_key", "time_ms", "total_requests", *_EVOLVED)


def _settings_log_sql(d):
    keys = list(SE.DEFAULTS)
    arms = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(keys[:5]))
    s = (f"SELECT CASE event_id % 5 {arms} END AS key, "
         f"CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END "
         f"ELSE CAST(CAST(floor(value) AS BIGINT) % 7 AS STRING) END AS value, {d.ms('ts')} AS updated_at FROM {d.t('events')}")
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def settings_log(spark, sf):
    return spark.sql(_settings_log_sql(fx.SPARK), events=tables.read(spark, sf, "events", "event_id", "value", "ts"))


_CUR = f"SELECT key, arg_max(value, (updated_at, value)) AS value FROM ({_settings_log_sql(fx.DUCK)}) l GROUP BY key"


@query("settings_upsert", _CUR)
def q_settings_upsert(spark, sf):
    return SE.settings_upsert(settings_log(spark, sf))


def _bodies_sql(d) -> str:
    """Update bodies: one key, two keys, a null, an unknown key, no JSON."""
    kind = "CAST(event_id % 8 AS INT)"
    v = "CAST(event_id % 97 AS STRING)"
    one = lambda k: f"""chr(123) || '"{k}": "' || {v} || '"' || chr(125)"""
    s = f"""SELECT {d.ms('ts')} AS updated_at, CASE {kind} WHEN 0 THEN {one('cloud_prompt_rate')} WHEN 1 THEN {one('cloud_gen_rate')}
    WHEN 2 THEN chr(123) || '"electricity_rate": "' || {v} || '", "cloud_prompt_rate": "' || {v} || '.5"' || chr(125) WHEN 3 THEN chr(123) || '"electricity_rate": null' || chr(125)
    WHEN 4 THEN {one('enabled')} WHEN 5 THEN {one('colour')} WHEN 6 THEN 'tp_gpu_count=2' ELSE {one('tp_gpu_count')} END AS body, event_id % 8 AS kind, event_id FROM {d.t('events')}"""
    return s.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


_UPDATES = f"""
b AS ({_bodies_sql(fx.DUCK)}),
u AS (SELECT key, json_extract_string(body, '$.' || key) AS value, updated_at FROM b, (SELECT unnest([{', '.join(f"'{k}'" for k in SE.UPDATABLE)}]) AS key) k WHERE json_valid(body))
"""


@query("settings_view", f"WITH {_UPDATES}, t AS ({_settings_log_sql(fx.DUCK)}), "
       "c AS (SELECT key, arg_max(value, (updated_at, value)) AS value FROM (SELECT key, value, updated_at FROM u WHERE value IS NOT NULL UNION ALL SELECT key, value, updated_at FROM t WHERE key = 'enabled') l GROUP BY key) SELECT "
       + ", ".join(f"COALESCE((SELECT value FROM c WHERE key = '{k}'), '{v}') AS {k}" for k, v in SE.DEFAULTS.items()))
def q_settings_view(spark, sf):
    """The settings after partial updates, which write the keys they carry, and recording toggles."""
    bodies = spark.sql(_bodies_sql(fx.SPARK), events=tables.read(spark, sf, "events", "event_id", "ts"))
    log = SE.settings_updates(bodies).unionByName(settings_log(spark, sf).where("key = 'enabled'").select("key", "value", "updated_at"))
    return SE.settings_view(SE.settings_upsert(log))


@query("storage_report")  # file sizes: rows-only check
def q_storage_report(spark, sf):
    files = spark.read.format("binaryFile").load(f"{sf.rstrip('/')}/*.parquet").select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("table")).agg(
        F.sum("length").alias("bytes"))
