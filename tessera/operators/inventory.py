"""Process and engine inventories: PID trees, GPU placement, merges, launch args.

``pid_tree`` is an iterative frontier expansion (join + anti-join per
level) with the visited set checkpointed into the shared checkpoint folder
each round, so lineage stays flat and cycles terminate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pid_tree(roots: DataFrame, procs: DataFrame, root_col: str = "root") -> DataFrame:
    """(root, pid) for every root and all of its descendants (the root included).

    ``roots``: (root, pid) seeds; ``procs``: (pid, parent). Distinct pairs;
    parent cycles are harmless because already-visited pairs are removed with
    a ``left_anti`` join before the next level. The number of driver-side
    iterations is the tree depth; each round's visited set is checkpointed.
    """
    edges = procs.where(F.col("parent").isNotNull()).select(F.col("parent").alias("_par"), F.col("pid").alias("_child"))
    visited = roots.select(root_col, "pid").distinct().checkpoint()
    frontier = visited
    while True:  # ends: every round but the last adds at least one pair
        nxt = (
            frontier.join(edges, frontier["pid"] == edges["_par"], "inner")
            .select(root_col, F.col("_child").alias("pid"))
            .distinct()
            .join(visited, [root_col, "pid"], "left_anti")
            .checkpoint()
        )
        if nxt.isEmpty():
            break
        visited = visited.unionByName(nxt).checkpoint()
        frontier = nxt
    return visited


def gpu_placement(engine_pids: DataFrame, gpu_procs: DataFrame, key: str = "engine_key") -> DataFrame:
    """Per engine: distinct sorted GPU indexes whose process list shares a PID; none -> empty array."""
    hit = engine_pids.join(gpu_procs, "pid", "inner").groupBy(key).agg(F.array_sort(F.collect_set("gpu_index")).alias("gpu_indexes"))
    eng = engine_pids.select(key).distinct()
    return eng.join(hit, key, "left").select(key, F.coalesce("gpu_indexes", F.array().cast("array<int>")).alias("gpu_indexes"))


def inventory_merge(proc: DataFrame, docker: DataFrame) -> DataFrame:
    """Full outer merge on (engine_type, endpoint).

    The container side wins the deployment mode; model and container id
    only fill nulls on the process side; PID lists are unioned and sorted.
    """
    p = proc.alias("p")
    d = docker.alias("d")
    j = p.join(d, (F.col("p.engine_type") == F.col("d.engine_type")) & (F.col("p.endpoint") == F.col("d.endpoint")), "full_outer")
    return j.select(
        F.coalesce("p.engine_type", "d.engine_type").alias("engine_type"),
        F.coalesce("p.endpoint", "d.endpoint").alias("endpoint"),
        F.coalesce("d.deployment_mode", "p.deployment_mode").alias("deployment_mode"),
        F.coalesce("p.served_model", "d.served_model").alias("served_model"),
        F.array_sort(F.array_union(F.coalesce("p.pids", F.array().cast("array<bigint>")),
                                   F.coalesce("d.pids", F.array().cast("array<bigint>")))).alias("pids"),
        F.coalesce("p.container_id", "d.container_id").alias("container_id"),
    )


def inventory_merge_long(proc: DataFrame, proc_pids: DataFrame, docker: DataFrame, docker_pids: DataFrame,
                         keys=("engine_type", "endpoint")) -> tuple[DataFrame, DataFrame]:
    """Long-form merge: attributes one row per (type, endpoint), PIDs one row per (type, endpoint, pid).

    Same rules as ``inventory_merge`` (container side wins the deployment
    mode; model and container id only fill nulls; PID sets unioned) without
    ever collecting an engine's PID list into one value.
    """
    k = list(keys)
    p, d = proc.alias("p"), docker.alias("d")
    cond = F.lit(True)
    for c in k:
        cond = cond & (F.col(f"p.{c}") == F.col(f"d.{c}"))
    attrs = p.join(d, cond, "full_outer").select(
        *[F.coalesce(f"p.{c}", f"d.{c}").alias(c) for c in k],
        F.coalesce("d.deployment_mode", "p.deployment_mode").alias("deployment_mode"),
        F.coalesce("p.served_model", "d.served_model").alias("served_model"),
        F.coalesce("p.container_id", "d.container_id").alias("container_id"),
    )
    pids = proc_pids.select(*k, "pid").unionByName(docker_pids.select(*k, "pid")).distinct()
    return attrs, pids


def stale_pids_long(pids: DataFrame, latest_keys: DataFrame, keys=("engine_type", "endpoint")) -> DataFrame:
    """Long form of ``stale_pids``: PID rows survive only for keys seen in the latest pass (left semi join)."""
    return pids.join(latest_keys.select(*keys).distinct(), list(keys), "left_semi")


def stale_pids(engines: DataFrame, latest_keys: DataFrame, keys=("engine_type", "endpoint")) -> DataFrame:
    """Engines missing from the latest detection pass keep their row but lose their PIDs."""
    k = latest_keys.select(*keys).distinct().withColumn("_seen", F.lit(True))
    j = engines.join(k, list(keys), "left")
    return j.withColumn("pids", F.when(F.col("_seen"), F.col("pids")).otherwise(F.array().cast("array<bigint>"))).drop("_seen")


# ---------------------------------------------------------------- launch arguments

def _arg(args: str, i: str) -> str:
    return f"try_element_at({args}, {i})"


def endpoint_from_args(args: str, default: str = "'http://localhost:8000'") -> Column:
    """Endpoint from ``--port``/``--port=``/``--host``/``--host=`` (last wins); 0.0.0.0 -> localhost; default port 8000."""
    def pick(flag: str) -> str:
        # Flags are paired left to right: a token taken as a flag's value is no flag itself.
        def step(got: str) -> str:
            return f"named_struct('pending', '', 'port', {got if flag == 'port' else 's.port'}, 'host', {got if flag == 'host' else 's.host'})"

        own, eq = f"--{flag}", f"--{flag}="
        return (
            f"aggregate({args}, named_struct('pending', '', 'port', CAST(NULL AS STRING), 'host', CAST(NULL AS STRING)), (s, a) -> "
            f"CASE WHEN s.pending = '{own}' THEN {step('a')} "
            f"WHEN s.pending <> '' THEN named_struct('pending', '', 'port', s.port, 'host', s.host) "
            f"WHEN a IN ('--port', '--host') THEN named_struct('pending', a, 'port', s.port, 'host', s.host) "
            f"WHEN startswith(a, '{eq}') THEN {step(f'substring(a, {len(eq) + 1})')} "
            f"ELSE s END, s -> s.{flag})"
        )

    port, host = pick("port"), pick("host")
    return F.expr(
        f"CASE WHEN {port} IS NOT NULL OR {host} IS NOT NULL THEN "
        f"'http://' || (CASE WHEN coalesce({host}, 'localhost') = '0.0.0.0' THEN 'localhost' ELSE coalesce({host}, 'localhost') END)"
        f" || ':' || coalesce({port}, '8000') ELSE {default} END"
    )


def model_from_args(args: str) -> Column:
    """``--model X`` / ``--model=X`` (first valid), else the token after ``serve`` following a vllm entry."""
    n = f"size({args})"
    ok = "(x IS NOT NULL AND x <> '' AND NOT startswith(x, '-'))"
    flag = (
        f"try_element_at(filter(transform(sequence(1, greatest({n}, 1)), i -> "
        f"CASE WHEN i > {n} THEN NULL "
        f"WHEN {_arg(args, 'i')} = '--model' THEN (CASE WHEN {ok.replace('x', _arg(args, 'i + 1'))} THEN {_arg(args, 'i + 1')} END) "
        f"WHEN startswith({_arg(args, 'i')}, '--model=') AND length({_arg(args, 'i')}) > 8 THEN substring({_arg(args, 'i')}, 9) END), "
        f"x -> x IS NOT NULL), 1)"
    )
    entry = f"({_arg(args, 'i')} = 'vllm' OR endswith({_arg(args, 'i')}, '/vllm') OR contains({_arg(args, 'i')}, 'vllm.entrypoints'))"
    serve_after = f"CAST(i + array_position(slice({args}, i + 1, greatest({n} - i, 1)), 'serve') AS INT)"
    positional = (
        f"try_element_at(filter(transform(sequence(1, greatest({n}, 1)), i -> "
        f"CASE WHEN i > {n} OR NOT {entry} OR i >= {n} THEN NULL "
        f"WHEN array_position(slice({args}, i + 1, {n} - i), 'serve') = 0 THEN NULL "
        f"ELSE (CASE WHEN {ok.replace('x', _arg(args, serve_after + ' + 1'))} THEN {_arg(args, serve_after + ' + 1')} END) END), "
        f"x -> x IS NOT NULL), 1)"
    )
    return F.expr(f"coalesce({flag}, {positional})")


def is_inference_command(args: str) -> Column:
    """A process is an inference server when an argument equals ``vllm``, ends with ``/vllm`` or names the entrypoints module."""
    return F.expr(f"exists({args}, a -> a = 'vllm' OR endswith(a, '/vllm') OR contains(a, 'vllm.entrypoints'))")


def engine_candidates(procs: DataFrame, host: str = "host", args: str = "args") -> DataFrame:
    """Inference-server candidates per host: one row per (host, endpoint).

    Processes whose binary name is ``vllm`` are used; only on hosts with none
    of those are command lines scanned for an inference entry point. PIDs are
    summarised as count and range (no per-endpoint list); the served model
    comes from the endpoint's first (lowest) PID.
    """
    name = F.substring_index(F.try_element_at(F.col(args), F.lit(1)), "/", -1)
    p = procs.where(F.size(args) > 0).withColumn("_bin", F.coalesce(name == "vllm", F.lit(False)))
    hosts = p.groupBy(host).agg(F.max(F.col("_bin").cast("int")).alias("_has_bin"))
    p = p.join(hosts, host).where(F.when(F.col("_has_bin") == 1, F.col("_bin")).otherwise(is_inference_command(args)))
    p = p.select(host, "pid", endpoint_from_args(args).alias("endpoint"), model_from_args(args).alias("model"))
    return p.groupBy(host, "endpoint").agg(
        F.count_distinct("pid").alias("n_pids"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"),
        F.min_by("model", "pid").alias("served_model"))


def port_from_command(cmd: Column) -> Column:
    """``--port N`` / ``--port=N`` from a command string; must fit an unsigned 16-bit port."""
    v = F.regexp_extract(cmd, r"--port[= ](\d+)", 1)
    n = v.try_cast("long") if hasattr(v, "try_cast") else F.expr("try_cast(null as long)")
    return F.when((v != "") & (n <= 65535), n.cast("int"))


def pid_from_top_row(first_col: Column) -> Column:
    """PID from the first column of a process listing row; a header or junk -> null."""
    return F.when(first_col.rlike(r"^\d+$"), first_col.try_cast("long"))
