"""Registered queries: fleet aggregates, providers, engine labels and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fleet as FL
from ..sources import fixtures as fx
from ..sources import tables
from .registry import query

SNAPS = fx.duck_cte("engine_snapshots")


def snaps(spark, sf):
    return fx.engine_snapshots(spark, sf)


def _wm(v: str, w: str = "total_requests", run: str = "status_type = 'Running'") -> str:
    c = f"{run} AND {v} IS NOT NULL AND {w} > 0"
    return (f"CASE WHEN sum(CASE WHEN {c} THEN {w} END) > 0 THEN sum(CASE WHEN {c} THEN {v} * {w} END) / sum(CASE WHEN {c} THEN {w} END) "
            f"ELSE avg(CASE WHEN {run} THEN {v} END) END")


def _fleet_sql() -> str:
    run = "status_type = 'Running'"
    ints = {"active_requests", "queued_requests", "total_requests", "swapped_requests", "preemptions_total",
            "total_prompt_tokens", "total_generation_tokens", "prefix_cache_queries_total", *FL.SPEC_FIELDS}
    cols = [f"CAST(count_if({run}) AS BIGINT) AS running_count", "count(*) AS total_count"]
    cols += [f"CAST(sum(CASE WHEN {run} THEN {c} END) AS BIGINT) AS {c}" if c in ints
             else f"sum(CASE WHEN {run} THEN {c} END) AS {c}" for c in FL.SUM_FIELDS + FL.SPEC_FIELDS]
    cols += [f"{_wm('spec_decode_acceptance_rate_live', 'spec_decode_draft_tokens_total')} AS spec_decode_acceptance_rate_live"]
    cols += [f"{_wm(c)} AS {c}" for c in FL.WEIGHTED_FIELDS]
    cols += [f"avg(CASE WHEN {run} THEN {c} END) AS {c}" for c in FL.MEAN_FIELDS]
    cols += [f"{_wm(c)} AS {c}" for c in FL.PCT_FIELDS + FL.GOODPUT_FIELDS]
    inner = "SELECT tick_ts, " + ",\n ".join(cols) + " FROM engine_snapshots GROUP BY tick_ts"
    outs = ["tick_ts", "running_count", "total_count"]
    nul = [c for c in FL.SUM_FIELDS + FL.SPEC_FIELDS + ["spec_decode_acceptance_rate_live"] + FL.WEIGHTED_FIELDS
           + FL.MEAN_FIELDS + FL.PCT_FIELDS + FL.GOODPUT_FIELDS]
    outs += [f"CASE WHEN running_count > 0 THEN {c} END AS {c}" for c in nul]
    outs += ["CASE WHEN running_count > 0 AND spec_decode_accepted_tokens_total IS NOT NULL AND spec_decode_draft_tokens_total > 0 "
             "THEN spec_decode_accepted_tokens_total / spec_decode_draft_tokens_total * 100.0 END AS spec_decode_acceptance_rate",
             "CASE WHEN running_count > 0 AND spec_decode_accepted_tokens_total IS NOT NULL AND spec_decode_drafts_total > 0 "
             "THEN spec_decode_accepted_tokens_total / spec_decode_drafts_total END AS spec_decode_mean_acceptance_length"]
    return SNAPS + f"SELECT {', '.join(outs)} FROM ({inner}) g"


@query("fleet_aggregate", _fleet_sql())
def q_fleet_aggregate(spark, sf):
    return FL.fleet_aggregate(snaps(spark, sf))


@query("running_filter", SNAPS + "SELECT tick_ts, engine_key, status_type, model_name FROM engine_snapshots WHERE status_type = 'Running'")
def q_running_filter(spark, sf):
    return snaps(spark, sf).where(FL.running()).select("tick_ts", "engine_key", "status_type", "model_name")


@query("weighted_mean", SNAPS + f"""
SELECT engine_key, {_wm('ttft_ms', run='TRUE')} AS ttft_ms_weighted, {_wm('per_request_tps', run='TRUE')} AS per_request_tps_weighted
FROM engine_snapshots GROUP BY engine_key
""")
def q_weighted_mean(spark, sf):
    s = snaps(spark, sf)
    w = F.col("total_requests")
    return s.groupBy("engine_key").agg(FL.weighted_mean(F.col("ttft_ms"), w).alias("ttft_ms_weighted"),
                                       FL.weighted_mean(F.col("per_request_tps"), w).alias("per_request_tps_weighted"))


@query("fleet_percentiles", SNAPS + "SELECT tick_ts, " + ", ".join(f"CASE WHEN count_if(status_type = 'Running') > 0 THEN {_wm(c)} END AS {c}" for c in FL.PCT_FIELDS)
       + " FROM engine_snapshots GROUP BY tick_ts")
def q_fleet_percentiles(spark, sf):
    return FL.fleet_aggregate(snaps(spark, sf)).select("tick_ts", *FL.PCT_FIELDS)


_SPEC = ["spec_decode_draft_tokens_total", "spec_decode_accepted_tokens_total", "spec_decode_drafts_total",
         "spec_decode_acceptance_rate", "spec_decode_acceptance_rate_live", "spec_decode_mean_acceptance_length"]


@query("fleet_spec_decode", f"SELECT tick_ts, {', '.join(_SPEC)} FROM ({_fleet_sql()}) f")
def q_fleet_spec_decode(spark, sf):
    return FL.fleet_aggregate(snaps(spark, sf)).select("tick_ts", *_SPEC)


# ---------------------------------------------------------------- providers

def _model_names_sql(d) -> str:
    orgs = ["meta-llama", "Qwen", "MistralAI", "acme-labs", " ", "deepseek-ai", "google", "unknown-org"]
    arms = " ".join(f"WHEN {i} THEN '{o}' || '/' || p_name" for i, o in enumerate(orgs))
    return (f"SELECT p_partkey AS model_id, CASE p_partkey % 12 {arms} "
            f"WHEN 8 THEN 'mixtral ' || p_name WHEN 9 THEN 'GPT-' || CAST(p_size AS STRING) "
            f"WHEN 10 THEN '/llama ' || p_name ELSE p_name END AS model_name FROM {d.t('part')}").replace(
        "STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


def _provider_sql() -> str:
    alias = ", ".join(f"('{k}', '{v}')" for k, v in FL.ORG_ALIAS.items())
    ident = ", ".join(f"('{k}', '{k}')" for k in FL.ORG_IDENTITY if k not in FL.ORG_ALIAS)
    kws = ", ".join(f"({i}, '{k}', '{s}', '{a}')" for i, (k, s, a) in enumerate(FL.KEYWORDS))
    return f"""
WITH m AS ({_model_names_sql(fx.DUCK)}),
orgs AS (SELECT * FROM (VALUES {alias}, {ident}) t(org, slug)),
kw AS (SELECT * FROM (VALUES {kws}) t(kw_order, keyword, kw_slug, kw_alt)),
n AS (SELECT model_id, model_name, trim(model_name) AS nm,
        CASE WHEN instr(trim(model_name), '/') > 1 THEN trim(split_part(trim(model_name), '/', 1)) END AS raw_prefix,
        COALESCE(instr(trim(model_name), '/') > 1, FALSE) AS has_slash FROM m),
k AS (SELECT n.model_id, arg_min(kw_slug, kw_order) AS ks, arg_min(kw_alt, kw_order) AS ka
      FROM n JOIN kw ON contains(lower(n.nm), kw.keyword) WHERE NOT has_slash AND length(nm) > 0 GROUP BY n.model_id)
SELECT n.model_id, n.model_name, n.raw_prefix,
  CASE WHEN has_slash THEN CASE WHEN raw_prefix <> '' THEN o.slug END ELSE k.ks END AS provider_slug,
  CASE WHEN has_slash THEN CASE WHEN raw_prefix <> '' AND o.slug IS NOT NULL THEN raw_prefix END ELSE k.ka END AS provider_alt
FROM n LEFT JOIN orgs o ON lower(n.raw_prefix) = o.org LEFT JOIN k ON k.model_id = n.model_id
"""


@query("provider_resolve", _provider_sql())
def q_provider_resolve(spark, sf):
    m = spark.sql(_model_names_sql(fx.SPARK), part=tables.read(spark, sf, "part", "p_partkey", "p_name", "p_size"))
    return FL.provider_resolve(spark, m, "model_id", "model_name").select(
        "model_id", "model_name", "raw_prefix", "provider_slug", "provider_alt")


def _groups_sql() -> str:
    alias = ", ".join(f"('{k}', '{v}')" for k, v in FL.ORG_ALIAS.items())
    ident = ", ".join(f"('{k}', '{k}')" for k in FL.ORG_IDENTITY if k not in FL.ORG_ALIAS)
    kws = ", ".join(f"({i}, '{k}', '{s}', '{a}')" for i, (k, s, a) in enumerate(FL.KEYWORDS))
    return SNAPS.rstrip("\n") + f""",
orgs AS (SELECT * FROM (VALUES {alias}, {ident}) t(org, slug)),
kw AS (SELECT * FROM (VALUES {kws}) t(kw_order, keyword, kw_slug, kw_alt)),
n AS (SELECT tick_ts, engine_key, model_name, trim(model_name) AS nm,
        CASE WHEN instr(trim(model_name), '/') > 1 THEN trim(split_part(trim(model_name), '/', 1)) END AS raw_prefix,
        COALESCE(instr(trim(model_name), '/') > 1, FALSE) AS has_slash FROM engine_snapshots WHERE status_type = 'Running'),
k AS (SELECT n.tick_ts, n.engine_key, arg_min(kw_slug, kw_order) AS ks, arg_min(kw_alt, kw_order) AS ka
      FROM n JOIN kw ON contains(lower(n.nm), kw.keyword) WHERE NOT has_slash AND length(nm) > 0 GROUP BY 1, 2),
r AS (SELECT n.*, CASE WHEN has_slash THEN CASE WHEN raw_prefix <> '' THEN o.slug END ELSE k.ks END AS slug,
        CASE WHEN has_slash THEN CASE WHEN raw_prefix <> '' AND o.slug IS NOT NULL THEN raw_prefix END ELSE k.ka END AS alt
      FROM n LEFT JOIN orgs o ON lower(n.raw_prefix) = o.org LEFT JOIN k ON k.tick_ts = n.tick_ts AND k.engine_key = n.engine_key),
g AS (SELECT tick_ts,
        CASE WHEN slug IS NOT NULL THEN slug WHEN model_name IS NOT NULL AND COALESCE(raw_prefix, '') <> '' THEN 'raw:' || lower(raw_prefix) ELSE 'unknown' END AS group_key,
        CASE WHEN slug IS NOT NULL THEN alt WHEN model_name IS NOT NULL AND COALESCE(raw_prefix, '') <> '' THEN raw_prefix ELSE 'Unknown' END AS label,
        engine_key FROM r),
c AS (SELECT tick_ts, group_key, count(*) AS count, arg_min(label, engine_key) AS label FROM g GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY tick_ts ORDER BY count DESC, label) - 1 AS pos FROM c
"""


@query("provider_groups", _groups_sql())
def q_provider_groups(spark, sf):
    return FL.provider_groups(spark, snaps(spark, sf))


@query("active_engine", SNAPS + """
SELECT tick_ts, arg_min(engine_key, engine_key) AS engine_key, arg_min(model_name, engine_key) AS model_name,
  arg_min(tokens_per_sec, engine_key) AS tokens_per_sec
FROM engine_snapshots WHERE status_type = 'Running' GROUP BY tick_ts
""")
def q_active_engine(spark, sf):
    return FL.active_engine(snaps(spark, sf))


@query("pressure_flags", SNAPS + """
SELECT tick_ts, engine_key,
  COALESCE(swapped_requests > 0 OR preemptions_total > 0, FALSE) AS memory_pressure,
  COALESCE(spec_decode_draft_tokens_total > 0, FALSE) AS spec_decode_shown,
  status_type IN ('Running', 'Loading') AND model_name IS NOT NULL AND tokens_per_sec IS NULL AS waiting
FROM engine_snapshots
""")
def q_pressure_flags(spark, sf):
    s = snaps(spark, sf)
    return s.select("tick_ts", "engine_key", *FL.pressure_flags(s))


@query("instance_label", SNAPS + r"""
SELECT tick_ts, engine_key, COALESCE(
  CASE WHEN model_name IS NOT NULL AND model_name <> '' THEN split_part(model_name, '/', -1) END,
  CASE WHEN regexp_extract(endpoint, ':(\d+)(?:/|$)', 1) <> '' THEN ':' || regexp_extract(endpoint, ':(\d+)(?:/|$)', 1) END,
  engine_type) AS label
FROM engine_snapshots
""")
def q_instance_label(spark, sf):
    s = snaps(spark, sf)
    return s.select("tick_ts", "engine_key", FL.instance_label(F.col("model_name"), F.col("endpoint"), F.col("engine_type")).alias("label"))


@query("model_identity", SNAPS + """
SELECT tick_ts, engine_key, COALESCE(CASE WHEN contains(model_name, '/') THEN model_name END,
  CASE WHEN n_events % 2 = 0 THEN 'hint-' || engine_key END, model_name) AS model_identity
FROM engine_snapshots
""")
def q_model_identity(spark, sf):
    s = snaps(spark, sf)
    hint = F.when(F.col("n_events") % 2 == 0, F.concat(F.lit("hint-"), F.col("engine_key")))
    return s.select("tick_ts", "engine_key", FL.model_identity(F.col("model_name"), hint).alias("model_identity"))
