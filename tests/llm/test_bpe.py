import os
import random

import public_tokenizers
import pytest
from tessera.llm import bpe

from .support import awkward, documents, prose

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "aa", "Ab", "'s", "'S", "1", "22", "<|endoftext|>", "é", "́", "\xa0", " ", "\x1c", "!", "日本", "😀", " the",
         "\r\n", "​", "\x00", "<|", "|>", "ation", "ing", ".", ",", "\n\n", "it's", "    x"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    own = bpe.Bpe(PATH)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    texts += ["".join(rng.choice("abeinorst ") for _ in range(80)) for _ in range(500)] + ["a" * 997, "ab" * 500, " " * 300, "\n" * 77, "=" * 1000, prose(1, 500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(own.encode(t)) == ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_columns_equal_the_library(library):
    import pyarrow as pa

    own = bpe.Bpe(PATH)
    rng = random.Random(5)
    marks = PARTS + ["\x85", "\u2003", "\u180e", "\x1f", "\x0b", "\x7f", "'ll", "x.", "1a", "\n ", "\u0660", "\u2167", "x" * 64, "y" * 65]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 16))) for _ in range(3000)] + [None, "", " ", prose(2, 500), None]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0xE000, 0x1FFFF)])) + rng.choice(["", " ", "\n"]) for _ in range(99)) for _ in range(50)]
    rng.shuffle(texts)
    for some in (texts, texts[:1], [], [None], [""], ["<|endoftext|>"], ["é"]):
        ids, ends = own.encode_all(pa.array(["before", *some], pa.string()).slice(1))
        lists = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype("int32")))
        wanted = [library.encode(t or "", add_special_tokens=False).ids for t in some]
        assert lists.to_pylist() == wanted
        assert own.decode_all(lists).to_pylist() == [t or "" for t in some]


def test_any_ids_are_decoded_as_by_the_library(library):
    import pyarrow as pa

    own, rng = bpe.Bpe(PATH), random.Random(6)
    rows = [None if i % 7 == 3 else [rng.randrange(50257) for _ in range(i % 5)] for i in range(300)]
    rows += [library.encode(t, add_special_tokens=False).ids[:1] for t in ("日", "\U0001f600", "é")]
    for lists in (pa.array(rows, pa.list_(pa.int32())), pa.array(rows, pa.list_(pa.int32())).slice(2, 100), pa.array([], pa.list_(pa.int32()))):
        assert own.decode_all(lists).to_pylist() == [None if r is None else library.decode(r, skip_special_tokens=False) for r in lists.to_pylist()]


def test_distinct_pieces_of_a_column_take_their_steps_together(monkeypatch):
    """No piece of a column goes alone but long ones, and one that recurs, also with a mark after it, goes once."""
    import pyarrow as pa

    own = bpe.Bpe(PATH)
    alone, together, one, many = [], [], own.encode_piece, own.encode_pieces
    monkeypatch.setattr(own, "encode_piece", lambda p: alone.append(p) or one(p))
    monkeypatch.setattr(own, "encode_pieces", lambda text, starts, sizes: together.append(len(sizes)) or many(text, starts, sizes))
    own.encode_all(pa.array(["an orange, an onion. An onion", "an orange\nonion, " + "z" * 65] * 100))
    assert alone == ["Ġ" + "z" * 65]
    # "an", " orange", ",", " an", " onion", ".", " An", "\n", "onion" and the long one
    assert together == [10]


def test_every_token_is_its_own_encoding():
    own = bpe.Bpe(PATH)
    assert len(own.ends) == 50256


def test_a_small_cache_changes_nothing(library):
    own = bpe.Bpe(PATH)
    for c in (own.bare, own.spaced, own.piece):
        c.most = 3
    for seed in range(20):
        assert list(own.encode(prose(seed, 50))) == library.encode(prose(seed, 50), add_special_tokens=False).ids


def test_frames(spark, library):
    rows = awkward()
    df = documents(spark, rows)
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [r.doc_id for r in out] == [r[0] for r in rows]
    for got, row in zip(out, rows):
        assert got.ids == library.encode(row[1] or "", add_special_tokens=False).ids
        assert got.decoded == (row[1] or "") and got.text == row[1] and got.words.startswith("words-")
    assert bpe.encode(documents(spark, []), PATH).collect() == []


def test_workers_keep_no_vocabulary_after_a_task(spark):
    df = documents(spark, [(i, prose(i, 300), "en", "a") for i in range(80)]).repartition(8)
    ids = bpe.encode(df, PATH, drop=("text",))
    assert ids.columns == [c for c in df.columns if c != "text"] + ["ids"]
    assert bpe.decode(ids, PATH).select("decoded").toPandas()["decoded"].map(len).min() > 0

    def held(batches):
        import pyarrow as pa

        n = bpe.vocabulary.cache_info().currsize
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * b.num_rows, pa.int64())})

    got = spark.range(80).repartition(8).mapInArrow(held, "n long").collect()
    assert len(got) == 80 and not any(r.n for r in got)


def test_workers_keep_no_caches_after_a_task(spark):
    """Workers live on beside the executor's heap, and other stages' tasks run in them."""
    df = documents(spark, [(i, prose(i, 300), "en", "a") for i in range(80)]).repartition(8)
    assert bpe.encode(df, PATH).select("ids").toPandas()["ids"].map(len).min() > 0

    def held(batches):
        import pyarrow as pa

        own = bpe.vocabulary(PATH)
        n = sum(len(c) + len(c.old) for c in (own.bare, own.spaced, own.piece)) + len(own.apart)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * b.num_rows, pa.int64())})

    got = spark.range(80).repartition(8).mapInArrow(held, "n long").collect()
    assert len(got) == 80 and not any(r.n for r in got)


def test_a_column_goes_to_a_worker_once(spark):
    """Alone, renamed over itself, or beside others: what passes through comes back with its own values."""
    df = documents(spark, [(1, "an orange", "en", "a"), (2, None, "en", "b"), (3, "", None, None)]).coalesce(1)
    rows = df.collect()
    ids = bpe.encode(df, PATH)
    assert [tuple(r)[:-1] for r in ids.collect()] == [tuple(r) for r in rows]
    assert ids.columns == [*df.columns, "ids"] and bpe.decode(ids, PATH).columns == [*df.columns, "ids", "decoded"]
    alone = bpe.decode(bpe.encode(df.select("text"), PATH), PATH)
    assert [(r.text, r.decoded) for r in alone.collect()] == [(r.text, r.text or "") for r in rows]
    over = bpe.decode(bpe.encode(df.select("text"), PATH, out="text"), PATH, "text", "text")
    assert over.columns == ["text"] and [r.text for r in over.collect()] == [r.text or "" for r in rows]
    sent, _, types, _ = bpe._passed(df, "text", ["ids"])
    assert sent.schema.simpleString().count("text") == 0 and sent.schema["row"].dataType.names == [c for c in df.columns if c != "text"] and [*sent.columns] == ["row", "t"] and types.endswith("t string, ")


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))
