"""Operators on small literal inputs, with hand-computed expectations."""

from pyspark.sql import functions as F

from tessera.operators import fleet as FL
from tessera.operators import hardware as HW
from tessera.operators import inventory as INV
from tessera.sources import logs as LG
from tessera.sources import text as TX

GIB = 1 << 30


# ---------------------------------------------------------------- process tree / GPU placement / merge

def _tree(spark, roots, procs):
    r = spark.createDataFrame([(x, x) for x in roots], "root long, pid long")
    p = spark.createDataFrame(procs, "pid long, parent long")
    return sorted(x.pid for x in INV.pid_tree(r, p).collect())


def test_pid_tree(spark):
    procs = [(100, 1), (101, 100), (102, 101), (200, 1), (201, 200)]
    assert _tree(spark, [100], procs) == [100, 101, 102]
    assert _tree(spark, [100], [(100, 1), (200, 1)]) == [100]
    assert _tree(spark, [100], [(100, 101), (101, 100)]) == [100, 101]  # cycle terminates


def _placement(spark, engine_pids, device_pids):
    e = spark.createDataFrame([("e", p) for p in engine_pids] or [("e", -1)], "engine_key string, pid long")
    rows = [(g, p) for g, ps in device_pids for p in ps]
    d = spark.createDataFrame(rows, "gpu_index int, pid long") if rows else spark.createDataFrame([], "gpu_index int, pid long")
    out = INV.gpu_placement(e, d).collect()
    return list(out[0].gpu_indexes)


def test_gpu_placement(spark):
    assert _placement(spark, [4242], [(0, [999]), (1, [4242, 4243])]) == [1]
    assert _placement(spark, [4242], [(0, [4242]), (1, [4242]), (2, [999])]) == [0, 1]
    assert _placement(spark, [4242], [(0, [999]), (1, [998])]) == []
    assert _placement(spark, [4242], [(0, []), (1, [])]) == []
    assert _placement(spark, [], [(0, [999])]) == []
    assert _placement(spark, [10, 11], [(0, [10, 11])]) == [0]


def test_inventory_merge(spark):
    schema = "engine_type string, endpoint string, deployment_mode string, served_model string, pids array<bigint>, container_id string"
    proc = spark.createDataFrame([("vllm", "http://localhost:8000", "native", None, [100, 101], None)], schema)
    dock = spark.createDataFrame([("vllm", "http://localhost:8000", "docker", "m", [101, 102], "c1"),
                                  ("vllm", "http://localhost:8001", "docker", None, [7], "c2")], schema)
    rows = {r.endpoint: r for r in INV.inventory_merge(proc, dock).collect()}
    a = rows["http://localhost:8000"]
    assert a.deployment_mode == "docker" and list(a.pids) == [100, 101, 102]
    assert a.served_model == "m" and a.container_id == "c1"
    assert len(rows) == 2


def test_launch_args(spark):
    cases = [
        (["python", "-m", "vllm.entrypoints.openai.api_server", "--model", "m1", "--port", "8001"], "http://localhost:8001", "m1"),
        (["vllm", "serve", "org/m2", "--host", "0.0.0.0"], "http://localhost:8000", "org/m2"),
        (["vllm", "serve", "--model=m3", "--port=9000", "--host=10.1.1.1"], "http://10.1.1.1:9000", "m3"),
        (["vllm", "serve", "-x"], "http://localhost:8000", None),
        (["python", "server.py"], "http://localhost:8000", None),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(cases)], "i int, args array<string>")
    got = {r.i: (r.e, r.m) for r in df.select("i", INV.endpoint_from_args("args").alias("e"),
                                              INV.model_from_args("args").alias("m")).collect()}
    for i, (_, e, m) in enumerate(cases):
        assert got[i] == (e, m)


# ---------------------------------------------------------------- network / memory

def _net(spark, ifaces):
    rows = [(1, i, n, rx, tx, g) for i, (n, rx, tx, g) in enumerate(ifaces)]
    df = spark.createDataFrame(rows, "snap int, ord int, name string, rx long, tx long, has_global_ip boolean")
    out = HW.network_totals(df, ["snap"]).collect()
    return (out[0].name, out[0].rx_bytes_per_sec, out[0].tx_bytes_per_sec) if out else None


def test_network_choice(spark):
    assert _net(spark, [("lo", 100, 200, False)]) == ("lo", 100, 200)
    assert _net(spark, [("lo", 9000, 9000, False), ("eth0", 100, 200, True), ("docker0", 5000, 5000, False)]) == ("eth0", 100, 200)
    assert _net(spark, [("lo", 0, 0, False), ("wlan0", 10, 10, True), ("eth0", 1000, 1000, True)]) == ("eth0", 1010, 1010)
    assert _net(spark, [("eth0", 5, 5, False), ("lo", 9999, 9999, False)]) == ("eth0", 5, 5)


def test_virtual_and_global(spark):
    names = ["lo", "lo0", "docker0", "veth1234", "br-abc123", "virbr0", "tailscale0", "tun0", "wg0", "utun3", "eth0", "enp3s0", "wlan0"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    v = {r.name: r.v for r in df.select("name", HW.is_virtual_interface(F.col("name")).alias("v")).collect()}
    assert all(v[n] for n in names[:10]) and not any(v[n] for n in names[10:])
    addrs = {"10.0.0.5": True, "127.0.0.1": False, "0.0.0.0": False, "169.254.1.1": False,
             "::1": False, "::": False, "fe80::1": False, "febf::1": False, "2001:db8::1": True}
    d = spark.createDataFrame([(a,) for a in addrs], "a string")
    got = {r.a: r.g for r in d.select("a", HW.is_global_ip(F.col("a")).alias("g")).collect()}
    assert got == addrs


def test_memory_topology_and_headline(spark):
    rows = [("NVIDIA GB10", None, 122 * GIB), ("NVIDIA H100", 80 * GIB, 512 * GIB), (None, 100 * GIB, 105 * GIB),
            ("jetson agx orin", None, 1), (None, None, 0), (None, 600 * GIB, 512 * GIB)]
    df = spark.createDataFrame(rows, "name string, gpu long, sys long")
    out = df.select(HW.memory_topology(F.col("name"), F.col("gpu"), F.col("sys")).alias("u"), "gpu", "sys")
    out = out.select("u", HW.memory_headline(F.col("u"), F.col("gpu"), F.col("sys")).alias("h")).collect()
    assert [r.u for r in out] == [True, False, True, True, False, False]
    assert out[0].h == 128 * GIB          # 122 GiB unified -> marketed 128 GiB
    assert out[1].h == 512 * GIB          # discrete: kernel total
    assert out[3].h == GIB                # 1 byte -> 1 GiB
    assert out[5].h == 600 * GIB          # NVML total when >= kernel total


# ---------------------------------------------------------------- text

def test_scrape_routing(spark):
    body = "\n".join([
        "# HELP vllm:prompt_tokens_total prompt tokens",
        "# TYPE vllm:prompt_tokens_total counter",
        'vllm:prompt_tokens_total{model_name="a"} 10',
        'vllm:prompt_tokens_total{model_name="b"} 12',
        "# TYPE vllm:num_requests_running gauge",
        "vllm:num_requests_running 3",
        "# TYPE vllm:e2e_request_latency_seconds histogram",
        'vllm:e2e_request_latency_seconds_bucket{le="+Inf"} 9',
        'vllm:e2e_request_latency_seconds_bucket{le="0.5"} 4',
        "vllm:e2e_request_latency_seconds_sum 2.5",
        "vllm:e2e_request_latency_seconds_count 9",
        "# TYPE rpc summary",
        'rpc{quantile="0.5"} 1',
        "process_open_fds 7",
        "foo_total 5",
    ])
    df = spark.createDataFrame([("e", body)], "k string, body string")
    rows = {(r.name, r.le): (r.kind, r.value) for r in TX.scrape_ingest(df, ["k"]).collect()}
    assert rows[("vllm_prompt_tokens_total", None)] == ("counter", 12.0)          # last sample wins
    assert rows[("vllm_num_requests_running", None)] == ("gauge", 3.0)
    assert rows[("vllm_e2e_request_latency_seconds", 0.5)] == ("histogram", 4.0)
    assert rows[("vllm_e2e_request_latency_seconds", float("inf"))] == ("histogram", 9.0)
    assert rows[("vllm_e2e_request_latency_seconds_sum", None)] == ("counter", 2.5)
    assert rows[("vllm_e2e_request_latency_seconds_count", None)] == ("counter", 9.0)
    assert rows[("process_open_fds", None)] == ("gauge", 7.0)
    assert rows[("foo_total", None)] == ("counter", 5.0)
    assert not any(n == "rpc" for n, _ in rows)                                   # summary dropped


def test_log_reassembly(spark):
    chunks = [("c", "stdout", 1, "hello world\npart"), ("c", "stdout", 2, "ial line\n"), ("c", "stdout", 3, "a\n\nb"),
              ("c", "stderr", 1, "boom\n"), ("c", "stderr", 2, "tail")]
    df = spark.createDataFrame(chunks, "container string, stream string, seq long, chunk string")
    got = {}
    for r in LG.log_lines(df).collect():
        got.setdefault(r.stream, []).append((r.line_no, r.line))
    assert [line for _, line in sorted(got["stdout"])] == ["hello world", "partial line", "a", "", "b"]
    assert [line for _, line in sorted(got["stderr"])] == ["[stderr] boom", "[stderr] tail"]


# ---------------------------------------------------------------- fleet

def test_fleet_weighted_and_fallbacks(spark):
    cols = ["tick_ts", "status_type", "total_requests", "ttft_ms", "kv_cache_percent", "tokens_per_sec"]
    extra = [c for c in FL.SUM_FIELDS + FL.SPEC_FIELDS + FL.WEIGHTED_FIELDS + FL.MEAN_FIELDS + FL.PCT_FIELDS
             + FL.GOODPUT_FIELDS + ["spec_decode_acceptance_rate_live"] if c not in cols]
    rows = [
        (1, "Running", 10, 100.0, 50.0, 5.0), (1, "Running", 30, 200.0, None, 7.0), (1, "Stopped", 99, 999.0, 99.0, 99.0),
        (2, "Running", 0, 100.0, 10.0, None), (2, "Running", None, 300.0, 30.0, None),
        (3, "Stopped", 5, 1.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "tick_ts long, status_type string, total_requests long, ttft_ms double, "
                                     "kv_cache_percent double, tokens_per_sec double")
    for c in extra:
        df = df.withColumn(c, F.lit(None).cast("double"))
    out = {r.tick_ts: r for r in FL.fleet_aggregate(df).collect()}
    assert out[1].running_count == 2 and out[1].total_count == 3
    assert out[1].ttft_ms == (100 * 10 + 200 * 30) / 40                           # weighted by requests
    assert out[1].kv_cache_percent == 50.0 and out[1].tokens_per_sec == 12.0
    assert out[2].ttft_ms == 200.0                                                # no positive weight: plain mean
    assert out[2].tokens_per_sec is None                                          # all null -> null
    assert out[3].running_count == 0 and out[3].total_count == 1 and out[3].ttft_ms is None


def test_provider_resolve(spark):
    names = {1: "meta-llama/Llama-3-8B", 2: "custom-org/llama-3b", 3: "mixtral-8x7b", 4: "", 5: "Qwen/Qwen2.5",
             6: "gpt-4o-mini", 7: "/llama-x"}
    df = spark.createDataFrame(list(names.items()), "id int, name string")
    got = {r.id: (r.provider_slug, r.provider_alt) for r in FL.provider_resolve(spark, df, "id", "name").collect()}
    assert got[1] == ("meta", "meta-llama")
    assert got[2] == (None, None)          # unknown org prefix is authoritative
    assert got[3] == ("mistral-ai", "Mistral AI")
    assert got[4] == (None, None)
    assert got[5] == ("qwen", "Qwen")
    assert got[6] == ("openai", "OpenAI")
    assert got[7] == ("meta", "Meta")      # a leading '/' is no org prefix
