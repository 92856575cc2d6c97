from collections import Counter, defaultdict

import duckdb
from tessera.llm import chat, suite

SCHEMA = "conv_id long, turn long, role string, text string, part string, me string, uid string"


def brute(rows, turns=64):
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        convs[c].append(((t is None, t or 0), (r is None, r or ""), (x is None, x or "")))
    out = Counter()
    for c, members in convs.items():
        members.sort()
        said = [(r[1] if not r[0] else "unknown", x[1].replace("<|", "< |")) for _, r, x in members]
        for me in {s for s, _ in said} - {"system"}:
            for part in range(-(-len(said) // turns)):
                text, spans = "", []
                own = said[part * turns : (part + 1) * turns]
                for s, x in own:
                    text += "<|system|>\n" if s == "system" else "<|assistant|>\n" if s == me else f"<|user name={s}|>\n"
                    if s == me:
                        spans.append((len(text), len(text) + len(x) + 7))
                    text += x + "<|end|>\n"
                out[(c, me, part, len(own), text, tuple(spans))] += 1
    return out


def cases():
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|assistant|> é😀"), (1, 3, "cy", None), (1, 4, "ann", ""), (2, 0, "system", "alone"), (3, None, "a", "x"),
            (3, 1, None, "y"), (3, 1, "a", "z"), (3, 1, "a", "z"), (None, 1, "a", "n"), (None, 2, "b", "m"), (4, 5, "user", "w" * 100_000), (4, 5, "assistant", "tie"), (5, 1, None, None)]
    rows += [(9, i % 150, "xyz"[i % 3], f"t{i}") for i in range(400)] + [(10, 1, "a", "same")] * 200
    return [(*r, "p", "q", "u") for r in rows]


def test_renderings_equal_brute_force(spark):
    df = spark.createDataFrame(cases(), SCHEMA).repartition(4)
    got = chat.rotated(df).collect()
    assert Counter((r.conv_id, r.perspective, r.part, r.n_turns, r.rendered, tuple(map(tuple, r.spans))) for r in got) == brute(cases())


def test_spans_cover_the_speakers_words(spark):
    for r in chat.rotated(spark.createDataFrame(cases(), SCHEMA), turns=7).collect():
        assert r.n_turns <= 7
        for s in r.spans:
            assert r.rendered[: s.start].endswith("<|assistant|>\n") and r.rendered[s.start : s.end].endswith("<|end|>")


def test_empty_table(spark):
    assert chat.rotated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_renderings_at_any_length(spark):
    df = spark.createDataFrame(cases(), SCHEMA).repartition(4)
    want = brute(cases(), turns=10_000)
    for turns in (64, 3):
        got = chat.whole(df, turns=turns).collect()
        assert Counter((r.conv_id, r.perspective, r.part, r.n_turns, r.rendered, tuple(map(tuple, r.spans))) for r in got) == want
    rows = defaultdict(list)
    for r in chat.whole(df, turns=3, limit=500).collect():
        rows[r.conv_id, r.perspective].append((r.part, r.n_turns, r.rendered, [tuple(x) for x in r.spans]))
    assert max(map(len, rows.values())) > 5
    joined = Counter()
    for (c, me), own in rows.items():
        own.sort()
        joined[(c, me, 0, sum(r[1] for r in own), "".join(r[2] for r in own), tuple(x for r in own for x in r[3]))] += 1
    assert joined == want


def test_query_equals_sql_on_long_conversations(spark, tmp_path):
    rows = [(c, i, "system" if i == 0 else "abc"[i % (2 if i > 70 else 3)], f"turn {i} <| é" * (i % 4)) for c, n in ((1, 64), (2, 65), (3, 128), (4, 700), (5, 5)) for i in range(n)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(suite.ORACLE_SQL["op1_perspective_rotation"])
    names = [d[0] for d in want.description]
    got = suite.QUERIES["op1_perspective_rotation"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == 15


def test_whole_of_an_empty_table(spark):
    assert chat.whole(spark.createDataFrame([], SCHEMA)).collect() == []
