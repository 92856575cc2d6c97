import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tessera.llm import rans
from tessera.llm.common import scratch

from .support import awkward, documents, prose

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")


def table(ids):
    return rans.Table(rans.frequencies(np.bincount(ids)))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000])
def test_blocks_round_trip_from_any_checkpoint(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n) - 1, 40_000).astype(np.uint32)
    t = table(ids)
    block = rans.encode_block(ids, t, lanes=16, every=8)
    assert (rans.decode_block(block, t) == ids).all()
    rng = random.Random(n)
    for _ in range(40):
        lo = rng.randint(0, n)
        hi = rng.randint(lo, n + 5)
        assert (rans.decode_block(block, t, lo, hi) == ids[lo:hi]).all()


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 500, 4000).astype(np.uint32)
    t = table(ids)
    block = bytearray(rans.encode_block(ids, t, lanes=16, every=1000))
    block[-9] ^= 4
    with pytest.raises((ValueError, IndexError)):
        rans.decode_block(bytes(block), t)


def test_size_is_near_the_entropy():
    ids = np.random.default_rng(2).choice(50, 200_000, p=np.arange(1, 51) / 1275).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    bits = -(p * np.log2(p)).sum() * len(ids)
    assert 8 * len(rans.encode_block(ids, table(ids), lanes=64, every=10**6)) < 1.02 * bits


@pytest.mark.parametrize("counts", [[5], [1, 10**12], [0, 3, 0, 1], [1] * 60_000, [10**9] + [1] * 50_000])
def test_frequencies(counts):
    f = rans.frequencies(np.array(counts))
    assert f.sum() == 1 << rans.SCALE and ((f > 0) == (np.array(counts) > 0)).all()


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    from .test_bpe import PARTS

    library, own, rng = Tokenizer.from_file(PATH), rans.WordTokenizer(PATH), random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice(PARTS + ["<|startoftext|>", "İ", "Σ", "ς", "ǅ", "ﬁ", "Å", "Ñandú", "straße", "ŉ", "ª", "µ", "ĳ", "ſ"]) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(own.encode(t.encode()), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_runs_of_marks_and_digits_equal_the_library():
    from tokenizers import Tokenizer

    parts = ["$$", "Re%%", "(716)", "555-8176", "<|", "|>", "<|x", "<|startoftext|>", "<|STARTOFTEXT|>", "\x1c", "\x7f", "'s", "'S", "aB", "1", ".", ",", "`~", "!", " "]
    library, own, rng = Tokenizer.from_file(PATH), rans.WordTokenizer(PATH), random.Random(8)
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert np.frombuffer(own.encode(t.encode()), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("at, n", [(0, None), (2, 5), (0, 0)])
def test_distinct_runs_are_tokenized_once(at, n):
    """A batch asks the cache once for each lower-case word, not once for each word of the texts; all ids are in their places."""
    import pyarrow as pa

    texts = [None, b"", b" \t\n\x0b\x0c\r", b" a  b, B. .a, a.. ,a . , A,. Ab, aB. a", b"a\x00b\x1cc \xff\xfe x \xc3. \xff,",
             "é, Éa. H\u0331a, A\u030a. 日本 😀  x <|STARTOFTEXT|> <|startoftext|>, it's IT'S.".encode(), None, b"x" * 70_000 + b" y"]
    texts += [" ".join(random.Random(i).choices(["Ab", "ab", "aB,", "AB.", "x"], k=200)).encode() for i in range(30)]
    one, own, asked = rans.WordTokenizer(PATH), rans.WordTokenizer(PATH), []
    make, own.runs = own.runs, type("Counted", (dict,), {"__getitem__": lambda self, r: asked.append(r) or make[r]})()
    column = pa.array(texts, pa.binary()).slice(at, n)
    ids, lengths = own.encode_all(column, 1)
    first = 0
    for x, size in zip(column.to_pylist(), lengths, strict=True):
        assert ids[first : first + size].tolist() == np.frombuffer(one.encode(x or b""), np.uint32).tolist() + [1], x
        first += size
    assert first == len(ids) and len(asked) < 60


def test_pieces_are_asked_for_once_in_any_case_and_beside_any_marks():
    """The cache is asked for letters, digits and marks apart: as often as there are distinct lower-case pieces, not distinct runs."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    stems, marks = ["ab", "xyz", "éa", "ñandú", "ß"], ["", ",", ".", "$$", ".***", "7", "(716)"]
    runs = [m + c(s) + k for s in stems for c in (str.lower, str.capitalize) for m in marks for k in marks]
    library, own, asked = Tokenizer.from_file(PATH), rans.WordTokenizer(PATH), []
    make, own.runs = own.runs, type("Counted", (dict,), {"__getitem__": lambda self, r: asked.append(r) or make[r]})()
    ids, lengths = own.encode_all(pa.array([" ".join(runs).encode()], pa.binary()), 1)
    assert ids.tolist() == library.encode(" ".join(runs), add_special_tokens=False).ids + [1] and lengths.tolist() == [len(ids)]
    assert len(set(runs)) > 400 and len(asked) == len(set(asked)) < 30


def test_every_latin_character_beside_letters_digits_and_marks_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), rans.WordTokenizer(PATH)
    for c in map(chr, range(0x21, 0x250)):
        for t in (c, f"a{c}B", f"{c}1{c}", f"é{c}.", f"$${c}{c}%7", f"x'{c}", f"Z{c}\u0301 {c}s"):
            assert np.frombuffer(own.encode(t.encode()), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_wide_ids_are_kept():
    ids, n = np.array([1, 70_000, 2, 65_535, 65_536], np.uint32), np.array([1, 1, 2, 1])
    narrow, wide = rans._packed(ids, n)
    got = [np.frombuffer(b, "<u4") if a is None else np.frombuffer(a, "<u2") for a, b in zip(narrow.to_pylist(), wide.to_pylist())]
    assert [x.tolist() for x in got] == [[1], [70_000], [2, 65_535], [65_536]]
    assert [x.as_py() for x in rans._packed(ids[:1], n[:1])[0]] == [b"\x01\x00"]


def test_files_hold_all_documents_in_order(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = awkward() + [(200 + 7 * i % 500, prose(i, i % 40), "en", "a") for i in range(300)]
    folder = scratch(spark, "test-rans")
    shards = rans.write(documents(spark, rows).repartition(5), folder, PATH, shards=4)
    got = sorted(rans.read(shards, folder, part=2000).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and shards.count() > 1
    ids = [r.id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = sorted((r[0] is not None, r[0] or 0, library.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows)
    have = sorted((r.id is not None, r.id or 0, np.frombuffer(r.tokens, "<u4").tolist()) for r in got)
    assert have == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.tokens)
        at += r.n_tokens


def test_empty_table(spark):
    folder = scratch(spark, "test-rans")
    shards = rans.write(documents(spark, []), folder, PATH)
    assert shards.collect() == [] and rans.read(shards, folder).collect() == []


def test_query_equals_the_library(spark):
    from tessera.llm import suite
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in suite.QUERIES["op3_rans_token_files"](spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
