"""Log viewer events: brute force over frames in order; the keyed stream against the batch; long lines in parts."""

import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import logs as LG

SCHEMA = "container string, kind string, seq long, chunk string"


def brute(frames, part=LG.PART):
    """What a viewer gets, frame after frame."""
    out = []
    for container in {f[0] for f in frames}:
        buffers = {"stdout": "", "stderr": ""}
        last = {}

        def put(kind, seq, pos, line, container=container):
            mark = LG.STDERR if kind == "stderr" else ""
            for k in range(max(1, -(-len(line) // part))):
                out.append((container, kind, seq, pos, k, (mark if k == 0 else "") + line[k * part : (k + 1) * part]))

        for _, kind, seq, chunk in sorted((f for f in frames if f[0] == container), key=lambda f: f[2]):
            if kind in buffers:
                *done, rest = (buffers[kind] + (chunk or "")).split("\n")
                for pos, line in enumerate(done):
                    put(kind, seq, pos, line)
                buffers[kind], last[kind] = rest, seq
            elif kind == "console":
                out.append((container, kind, seq, 0, 0, chunk or ""))
            elif kind == "end":
                for pos, own in enumerate(("stdout", "stderr")):
                    if buffers[own]:
                        put(own, seq, pos, buffers[own])
                out.append((container, "end", seq, 2, 0, LG.ENDED))
                break
            elif kind == "error":
                out.append((container, "error", seq, 2, 0, LG.FAILED + (chunk or "")))
                break
        if kind != "end":  # full parts have left, the rest stays
            for own, rest in buffers.items():
                for k in range(-(-len(rest) // part) - 1):
                    out.append((container, own, last[own], 0, k, (LG.STDERR if own == "stderr" and k == 0 else "") + rest[k * part : (k + 1) * part]))
    return sorted(out, key=str)


def frames(seed, n=400):
    rng = random.Random(seed)
    kinds = ["stdout"] * 5 + ["stderr"] * 3 + ["console", "stdin"]
    rows = []
    for seq in range(n):
        text = None if rng.random() < 0.03 else "".join(rng.choice("ab\n\n€ ") if rng.random() < 0.4 else "x" for _ in range(rng.choice([0, 1, 3, 12, 40])))
        rows.append((f"c{rng.randint(0, 5)}", rng.choice(kinds), seq, text))
    rows += [("c0", "end", n, None), ("c1", "error", n // 2, "gone"), ("c1", "end", n + 1, None), ("c2", "end", n - 40, "code 1"), ("c2", "error", n, "late")]
    return [r for r in rows if not (r[0] == "c1" and r[2] == n // 2 and r[1] != "error") and not (r[0] == "c2" and r[2] == n - 40 and r[1] != "end")]


@pytest.mark.parametrize("seed, part, chunk", [(1, LG.PART, 1 << 20), (2, 7, 16), (3, 1, 3)])
def test_events_equal_brute_force(spark, seed, part, chunk):
    rows = frames(seed)
    got = LG.log_events(spark.createDataFrame(rows, SCHEMA).repartition(5), seq_chunk=chunk, part=part).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, part)


def test_a_stream_without_newlines_is_cut(spark):
    """The pieces of one endless line never meet in one group: each group has at most a part's characters."""
    rows = [("c", "stdout", k, "y" * 100) for k in range(300)] + [("c", "end", 300, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = LG.log_events(df, part=1000).where("kind = 'stdout'").orderBy("part").collect()
    assert [len(r.line) for r in got] == [1000] * 30 and [r.part for r in got] == list(range(30))
    assert LG.log_events(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed, chunk", [(6, 1 << 20), (7, 16), (8, 3)])
def test_lines_equal_the_streams_split(spark, seed, chunk):
    rows = [(None if c == "c5" else c, k, seq, text) for c, k, seq, text in frames(seed) if k in ("stdout", "stderr")]
    want = []
    for key in {r[:2] for r in rows}:
        *done, rest = "".join(r[3] or "" for r in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])).split("\n")
        want += [(*key, i, (LG.STDERR if key[1] == "stderr" else "") + line) for i, line in enumerate(done + [rest] * (rest != ""))]
    df = spark.createDataFrame(rows, "container string, stream string, seq long, chunk string").repartition(5)
    got = LG.log_lines(df, seq_chunk=chunk).select("container", "stream", "line_no", "line").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_long_line_is_judged_whole(spark, tmp_path):
    """One row for a line, whatever its length: a word may lie anywhere in it, and a line of stderr is one to its end."""
    from tessera.plans import registry

    docs = [(1, "x" * (LG.PART - 1) + "le" + "y" * 300 + "\nshort le\nnone\n"), (2, "a" * (2 * LG.PART) + "Le"),  # over a multiple of 2^20, past two
            (3, "z" * LG.PART + "le\n"), (4, "w" * (LG.PART - 9) + "error le " + "v" * LG.PART + "warn\nwarn"), (6, "e" * (LG.PART - 2) + "Traceback\n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry.load_all()
    lines = [(f"ctr-{d % 5}", "stdout" if d % 3 else "stderr", i, line) for d, text in docs[:-1] for i, line in enumerate(x for x in text.split("\n") if x)]
    lines.append(("ctr-1", "stderr", 0, docs[-1][1][:-1]))
    got = registry.run("log_filter", spark, str(tmp_path)).select("container", "stream", "line_no", "line").collect()
    assert sorted(map(tuple, got)) == sorted(x for x in lines if x[1] == "stdout" and "le" in x[3].lower())
    word = lambda x: "error" if "error" in x or "traceback" in x else "warning" if "warn" in x else "info"
    got = registry.run("log_severity", spark, str(tmp_path)).select("container", "stream", "line_no", "severity").collect()
    assert sorted(map(tuple, got)) == sorted((*x[:3], word(x[3].lower())) for x in lines)


def test_frames_are_placed_once(spark):
    """The running counts over the frames are worked out once and stored; lines, events and the lines' extents read them there."""
    df = spark.createDataFrame(frames(5), SCHEMA)
    plan = LG.log_events(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    streams = df.where("kind in ('stdout', 'stderr')").withColumnRenamed("kind", "stream")
    assert "Window" not in LG.log_lines(streams)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_in_one_pass(spark):
    """Chunks of 200 code points; no call counts a chunk's place from the beginning of its text."""
    from tessera.plans import text_suite as T
    from tessera.sources import fixtures as fx

    texts = ["x", "a" * 200, "b" * 201, "😀é\n" * 150, "\r\n\u2028 \x00" * 333, "", None, " " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "n" * 250), (3, "again")], "doc_id long, text string")
    got = spark.sql(T._chunks_sql(fx.SPARK), documents=docs)
    want = [(i, k // 200, t[k : k + 200]) for i, t in [*enumerate(texts), (3, "again")] if t for k in range(0, len(t), 200)]
    rows = sorted((r.seq // 10**9, r.seq % 10**9, r.chunk) for r in got.where("seq is not null").collect())
    assert rows == sorted(want) and sorted(r.chunk for r in got.where("seq is null").collect()) == ["n" * 50, "n" * 200]
    assert dict(got.dtypes)["seq"] == "bigint" and "substring" not in T._chunks_sql(fx.SPARK)


def run_stream(spark, rows, part, idle_ms, beat=None):
    base = tempfile.mkdtemp(prefix="log-stream-")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    df.limit(0).coalesce(1).write.parquet(f"{base}/feed")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    for a in range(0, 500, 100):
        df.where((F.col("seq") >= a) & (F.col("seq") < a + 100)).coalesce(1).sortWithinPartitions("seq").write.mode("append").parquet(f"{base}/feed")
        time.sleep(0.02)
    if beat:
        late = spark.createDataFrame([("beat", "console", beat, "tick")], SCHEMA).withColumn("event_time", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
        for k in range(2):
            late.withColumn("seq", F.col("seq") + k).coalesce(1).write.mode("append").parquet(f"{base}/feed")
            time.sleep(0.02)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (LG.log_event_stream(stream, idle_ms=idle_ms, part=part).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(key)
    return [tuple(r) for r in spark.read.schema(LG.EVENTS).parquet(f"{base}/out").collect() if r.container != "beat"]


@pytest.mark.parametrize("part", [LG.PART, 9])
def test_the_stream_equals_the_batch(spark, part):
    rows = frames(4)
    got = run_stream(spark, rows, part, idle_ms=10**9)
    want = brute(rows, part)
    if part == LG.PART:
        assert sorted(got, key=str) == want
    # a part of an unfinished line leaves before the frame that ends the line
    text = lambda events: sorted((e[0], e[1], e[4], e[5]) for e in events)
    assert text(got) == text(want)


def test_a_silent_log_is_closed_by_the_timer(spark):
    rows = [("a", "stdout", 0, "one\ntwo"), ("a", "stderr", 1, "bad"), ("b", "stdout", 2, "open"), ("b", "end", 3, None)]
    got = run_stream(spark, rows, LG.PART, idle_ms=60_000, beat=900)
    assert sorted(e[5] for e in got if e[0] == "a") == sorted(["one", "two", "[stderr] bad", LG.ENDED])
    assert sorted(e[5] for e in got if e[0] == "b") == sorted(["open", LG.ENDED])
