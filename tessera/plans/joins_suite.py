"""Registered queries: process trees, GPU placement, inventories, as-of joins, catalogue lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeutil import epoch_ms
from ..operators import inventory as INV
from ..operators import lookups as LK
from ..operators.windows import prev_non_null
from ..sources import fixtures as fx
from ..sources import tables
from . import world as W
from .registry import query


def _s(sql: str, d) -> str:
    return sql.replace("STRING", "VARCHAR" if d.name == "duckdb" else "STRING")


# ---------------------------------------------------------------- pid tree

def _roots_sql(d) -> str:
    return f"SELECT p_partkey AS root, p_partkey AS pid FROM {d.t('part')}"


@query("pid_tree", f"""
WITH RECURSIVE tree AS ({fx.sql_process_tree(fx.DUCK)}),
t(root, pid) AS (
  {_roots_sql(fx.DUCK)}
  UNION
  SELECT t.root, c.pid FROM t JOIN tree c ON c.parent = t.pid
)
SELECT root, pid FROM t
""")
def q_pid_tree(spark, sf):
    part = tables.read(spark, sf, "part", "p_partkey", "p_size")
    roots = spark.sql(_roots_sql(fx.SPARK), part=part)
    return INV.pid_tree(roots, fx.view(spark, sf, "process_tree"))


# ---------------------------------------------------------------- GPU placement

def _gpu_procs_sql(d) -> str:
    return f"SELECT CAST(p_size % 8 AS INT) AS gpu_index, p_partkey AS pid FROM {d.t('part')}"


@query("gpu_placement", fx.duck_cte("engine_pids").rstrip("\n") + f""",
gp AS ({_gpu_procs_sql(fx.DUCK)}),
hit AS (SELECT e.engine_key, list_sort(list_distinct(list(g.gpu_index))) AS idx FROM engine_pids e JOIN gp g USING (pid) GROUP BY 1)
SELECT e.engine_key, COALESCE(array_to_string(h.idx, ','), '') AS gpu_indexes
FROM (SELECT DISTINCT engine_key FROM engine_pids) e LEFT JOIN hit h USING (engine_key)
""")
def q_gpu_placement(spark, sf):
    gp = spark.sql(_gpu_procs_sql(fx.SPARK), part=tables.read(spark, sf, "part", "p_partkey", "p_size"))
    out = INV.gpu_placement(fx.view(spark, sf, "engine_pids"), gp)
    return out.select("engine_key", F.array_join("gpu_indexes", ",").alias("gpu_indexes"))


# ---------------------------------------------------------------- inventories

def _proc_inv_sql(d) -> str:
    return _s(f"""SELECT 'vllm' AS engine_type, 'http://localhost:' || CAST(8000 + l_suppkey % 50 AS STRING) AS endpoint,
  'native' AS deployment_mode,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'model-' || CAST(l_suppkey % 5 AS STRING) END AS served_model,
  l_partkey AS pid, CAST(NULL AS STRING) AS container_id
FROM {d.t('lineitem')} WHERE l_returnflag <> 'A'""", d)


def _docker_inv_sql(d) -> str:
    return _s(f"""SELECT 'vllm' AS engine_type, 'http://localhost:' || CAST(8000 + l_suppkey % 70 AS STRING) AS endpoint,
  'docker' AS deployment_mode, 'cmodel-' || CAST(l_suppkey % 4 AS STRING) AS served_model,
  l_partkey AS pid, 'ctr-' || CAST(l_suppkey % 70 AS STRING) AS container_id
FROM {d.t('lineitem')} WHERE l_returnflag <> 'R'""", d)


def _inv_attrs(df):
    """One attribute row per (type, endpoint) from per-process rows (plain aggregates, no PID list)."""
    return df.groupBy("engine_type", "endpoint").agg(
        F.first("deployment_mode").alias("deployment_mode"),
        F.min("served_model").alias("served_model"),
        F.min("container_id").alias("container_id"),
    )


_INV_DUCK = f"""
WITH pr AS ({_proc_inv_sql(fx.DUCK)}), dr AS ({_docker_inv_sql(fx.DUCK)}),
p AS (SELECT engine_type, endpoint, first(deployment_mode) AS deployment_mode, min(served_model) AS served_model,
             min(container_id) AS container_id FROM pr GROUP BY 1, 2),
d AS (SELECT engine_type, endpoint, first(deployment_mode) AS deployment_mode, min(served_model) AS served_model,
             min(container_id) AS container_id FROM dr GROUP BY 1, 2),
attrs AS (
  SELECT COALESCE(p.engine_type, d.engine_type) AS engine_type, COALESCE(p.endpoint, d.endpoint) AS endpoint,
    COALESCE(d.deployment_mode, p.deployment_mode) AS deployment_mode,
    COALESCE(p.served_model, d.served_model) AS served_model,
    COALESCE(p.container_id, d.container_id) AS container_id
  FROM p FULL OUTER JOIN d ON p.engine_type = d.engine_type AND p.endpoint = d.endpoint),
pids AS (SELECT DISTINCT engine_type, endpoint, pid FROM (SELECT engine_type, endpoint, pid FROM pr UNION ALL
                                                          SELECT engine_type, endpoint, pid FROM dr) u)
"""


@query("inventory_merge", _INV_DUCK + """
SELECT a.*, x.pid FROM attrs a LEFT JOIN pids x USING (engine_type, endpoint)
""")
def q_inventory_merge(spark, sf):
    li = tables.read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_returnflag")
    pr = spark.sql(_proc_inv_sql(fx.SPARK), lineitem=li)
    dr = spark.sql(_docker_inv_sql(fx.SPARK), lineitem=li)
    attrs, pids = INV.inventory_merge_long(_inv_attrs(pr), pr, _inv_attrs(dr), dr)
    # one row per (engine, pid) with the engine's merged attributes
    return attrs.join(pids, ["engine_type", "endpoint"], "left")


@query("stale_pids", _INV_DUCK + """
SELECT p.engine_type, p.endpoint, x.pid FROM p
LEFT JOIN (SELECT DISTINCT engine_type, endpoint, pid FROM pr
           WHERE (engine_type, endpoint) IN (SELECT (engine_type, endpoint) FROM d)) x USING (engine_type, endpoint)
""")
def q_stale_pids(spark, sf):
    li = tables.read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_returnflag")
    pr = spark.sql(_proc_inv_sql(fx.SPARK), lineitem=li)
    latest = spark.sql(_docker_inv_sql(fx.SPARK), lineitem=li)  # the latest pass saw only these keys
    keep = INV.stale_pids_long(pr.select("engine_type", "endpoint", "pid").distinct(), latest)
    # engines keep their row; those not seen lose their PIDs (pid null)
    engines = pr.select("engine_type", "endpoint").distinct()
    return engines.join(keep, ["engine_type", "endpoint"], "left")


# ---------------------------------------------------------------- launch commands

def _launch_sql(d) -> str:
    arr = (lambda *xs: "[" + ", ".join(xs) + "]") if d.name == "duckdb" else (lambda *xs: "array(" + ", ".join(xs) + ")")
    nm = "replace(p_name, ' ', '-')"
    br = "lower(replace(p_brand, '#', '-'))"
    cases = [
        arr("'python'", "'-m'", "'vllm.entrypoints.openai.api_server'", "'--model'", br, "'--port'", "CAST(8000 + p_size % 50 AS STRING)"),
        arr("'vllm'", "'serve'", nm, "'--host'", "'0.0.0.0'"),
        arr("'/usr/bin/vllm'", "'serve'", "'--model=' || " + br, "'--port=' || CAST(9000 + p_size AS STRING)"),
        arr("'python'", "'server.py'", "'--port'", "CAST(7000 + p_size AS STRING)"),
        arr("'vllm'", "'serve'", "'-x'"),
        arr("'/opt/venv/bin/vllm'", "'serve'", nm, "'--host'", "'10.0.0.' || CAST(p_size % 10 AS STRING)", "'--port'", "'8001'"),
        arr("'vllm'", "'--model'", "'--port'", "'8080'"),
        arr("'bash'", "'-c'", "'sleep'"),
    ]
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases))
    return _s(f"SELECT p_partkey AS pid, CASE p_partkey % 8 {arms} END AS args FROM {d.t('part')}", d)


def _duck_pick(flag: str) -> str:
    a = "args"
    return (f"list_filter(list_transform(range(1, len({a}) + 1), lambda i: CASE "
            f"WHEN i > 1 AND {a}[i - 1] IN ('--port', '--host') THEN NULL "
            f"WHEN {a}[i] = '--{flag}' AND i < len({a}) THEN {a}[i + 1] "
            f"WHEN starts_with({a}[i], '--{flag}=') THEN substring({a}[i], {len(flag) + 4}) END), lambda x: x IS NOT NULL)[-1]")


def _duck_model() -> str:
    a = "args"
    ok = lambda x: f"({x} IS NOT NULL AND {x} <> '' AND NOT starts_with({x}, '-'))"
    flag = (f"list_filter(list_transform(range(1, len({a}) + 1), lambda i: CASE "
            f"WHEN {a}[i] = '--model' THEN CASE WHEN {ok(f'{a}[i + 1]')} THEN {a}[i + 1] END "
            f"WHEN starts_with({a}[i], '--model=') AND length({a}[i]) > 8 THEN substring({a}[i], 9) END), lambda x: x IS NOT NULL)[1]")
    entry = f"({a}[i] = 'vllm' OR ends_with({a}[i], '/vllm') OR contains({a}[i], 'vllm.entrypoints'))"
    sp = f"(i + COALESCE(list_position({a}[i + 1:], 'serve'), 0))"
    pos = (f"list_filter(list_transform(range(1, len({a}) + 1), lambda i: CASE "
           f"WHEN NOT {entry} OR i >= len({a}) THEN NULL "
           f"WHEN COALESCE(list_position({a}[i + 1:], 'serve'), 0) = 0 THEN NULL "
           f"ELSE CASE WHEN {ok(f'{a}[{sp} + 1]')} THEN {a}[{sp} + 1] END END), lambda x: x IS NOT NULL)[1]")
    return f"COALESCE({flag}, {pos})"


@query("launch_extract", f"""
WITH c AS ({_launch_sql(fx.DUCK)}),
e AS (SELECT pid, args, {_duck_pick('port')} AS port, {_duck_pick('host')} AS host, {_duck_model()} AS model FROM c)
SELECT pid,
  CASE WHEN port IS NOT NULL OR host IS NOT NULL THEN 'http://' ||
    (CASE WHEN COALESCE(host, 'localhost') = '0.0.0.0' THEN 'localhost' ELSE COALESCE(host, 'localhost') END) || ':' || COALESCE(port, '8000')
    ELSE 'http://localhost:8000' END AS endpoint,
  model
FROM e
""")
def q_launch_extract(spark, sf):
    c = spark.sql(_launch_sql(fx.SPARK), part=tables.read(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size"))
    return c.select("pid", INV.endpoint_from_args("args").alias("endpoint"), INV.model_from_args("args").alias("model"))


@query("engine_candidates", f"""
WITH c AS (SELECT pid, pid % 16 AS host, args FROM ({_launch_sql(fx.DUCK)}) x WHERE len(args) > 0),
b AS (SELECT *, COALESCE(split_part(args[1], '/', -1) = 'vllm', FALSE) AS bin FROM c),
h AS (SELECT host, max(CAST(bin AS INT)) AS has_bin FROM b GROUP BY host),
e AS (SELECT b.pid, b.host, b.args, {_duck_pick('port')} AS port, {_duck_pick('host')} AS hst, {_duck_model()} AS model
      FROM b JOIN h USING (host)
      WHERE CASE WHEN h.has_bin = 1 THEN b.bin
                 ELSE len(list_filter(b.args, lambda a: a = 'vllm' OR ends_with(a, '/vllm') OR contains(a, 'vllm.entrypoints'))) > 0 END),
f AS (SELECT host, pid, model, CASE WHEN port IS NOT NULL OR hst IS NOT NULL THEN 'http://' ||
    (CASE WHEN COALESCE(hst, 'localhost') = '0.0.0.0' THEN 'localhost' ELSE COALESCE(hst, 'localhost') END) || ':' || COALESCE(port, '8000')
    ELSE 'http://localhost:8000' END AS endpoint FROM e)
SELECT host, endpoint, count(DISTINCT pid) AS n_pids, min(pid) AS first_pid, max(pid) AS last_pid,
  arg_min({{'m': model}}, pid).m AS served_model
FROM f GROUP BY host, endpoint
""")
def q_engine_candidates(spark, sf):
    c = spark.sql(_launch_sql(fx.SPARK), part=tables.read(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size"))
    # a host per part key modulo 16: every host runs one launch pattern
    return INV.engine_candidates(c.withColumn("host", F.col("pid") % 16))


# ---------------------------------------------------------------- as-of joins

@query("latest_state_join", W.tier_cte("engine_snapshots") + """
SELECT r.engine_key, r.ts, r.power_watts, s.tick_ts AS state_ts, s.status_type, s.tokens_per_sec
FROM snapshots_1s r ASOF LEFT JOIN engine_snapshots s ON r.engine_key = s.engine_key AND r.ts >= s.tick_ts
""")
def q_latest_state_join(spark, sf):
    raw = W.raw(spark, sf).select("engine_key", "ts", "power_watts")
    st = fx.engine_snapshots(spark, sf).select("engine_key", F.col("tick_ts").alias("ts"), "status_type", "tokens_per_sec")
    u = raw.select("engine_key", "ts", "power_watts", F.lit(None).cast("struct<t:bigint,s:string,v:double>").alias("_st"),
                   F.lit(1).alias("_k")).unionByName(
        st.select("engine_key", "ts", F.lit(None).cast("double").alias("power_watts"),
                  F.struct(F.col("ts").alias("t"), F.col("status_type").alias("s"), F.col("tokens_per_sec").alias("v")).alias("_st"),
                  F.lit(0).alias("_k")))
    j = prev_non_null(u, "engine_key", "ts", "_k", ["_st"], suffix="_asof").where(F.col("_k") == 1)
    return j.select("engine_key", "ts", "power_watts", F.col("_st_asof.t").alias("state_ts"),
                    F.col("_st_asof.s").alias("status_type"), F.col("_st_asof.v").alias("tokens_per_sec"))


@query("request_union", """
WITH s AS (SELECT 'engine-' || CAST(user_id % 8 AS VARCHAR) AS engine_key, epoch_us(ts) // 1000 AS start_ms,
             epoch_us(ts) // 1000 + CAST(floor(value * 1000) AS BIGINT) AS end_ms, value AS tokens_per_sec FROM events)
SELECT engine_key, start_ms, end_ms, tokens_per_sec FROM s WHERE end_ms >= (SELECT max(end_ms) FROM s) - 300000
""")
def q_request_union(spark, sf):
    return LK.request_union(request_spans(spark, sf))


def request_spans(spark, sf):
    ev = tables.read(spark, sf, "events", "ts", "user_id", "value")
    return ev.select(F.concat(F.lit("engine-"), (F.col("user_id") % 8).cast("string")).alias("engine_key"),
                     epoch_ms(F.col("ts")).alias("start_ms"),
                     (epoch_ms(F.col("ts")) + F.floor(F.col("value") * 1000).cast("bigint")).alias("end_ms"),
                     F.col("value").alias("tokens_per_sec"))


# ---------------------------------------------------------------- pricing and routing

@query("pricing_lookup", LK.pricing_oracle_sql())
def q_pricing_lookup(spark, sf):
    return LK.pricing_query(spark, sf)


@query("route_resolve", LK.route_oracle_sql())
def q_route_resolve(spark, sf):
    return LK.route_query(spark, sf)
