import hashlib
import re

import pytest
import zstandard
from tessera.llm import fim

from .support import awkward, documents, prose

LONG = "".join(f"{prose(k, 7)}\n{'Ä😀<' * (k % 3)}" for k in range(900))
TEXTS = ["", "a", "abc", "a b", "<P", "<S<S", "a<P>b", "ends <M>", "x" * 500, "ab<" * 40 + "M", "😀é\x00\t ß" * 30, LONG]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text), text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text), out)


@pytest.mark.parametrize("size", [1, 7, 1 << 14])
def test_equal_to_brute_force(spark, size):
    rows = awkward() + [(100 + 20 * i + j, t, "en", "a") for i, t in enumerate(TEXTS) for j in range(6)]
    stored = fim.store(documents(spark, rows), size=size)
    got = fim.transformed(stored, texts=True).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((None if r[0] is None else int(r[0]), *r[1:]) for r in got), key=key) == sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_frames_are_cut_at_units_and_counted():
    for size in (1, 5, 100):
        frames, units, chars = fim.cut_frames(LONG, size)
        assert "".join(frames) == LONG
        assert units[-1] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", LONG)) and chars[-1] == len(LONG)
        assert all(u == sum(len(re.findall(r"[A-Za-z]+|[^A-Za-z]", f)) for f in frames[:k]) for k, u in list(enumerate(units))[:50])


def test_a_cut_opens_one_frame():
    frames, units, chars = fim.cut_frames(LONG, 1000)
    pack, unpack = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
    starts = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", LONG)]
    for unit in (0, 1, len(starts) // 2, len(starts) - 1, units[3]):
        doc = fim.Framed([pack.compress(f.encode()) for f in frames], units, chars, unpack)
        assert doc.offset(unit) == starts[unit]
        assert doc.opened <= 1
    assert doc.opened == 0  # a cut at a frame's beginning is in the counts


def test_marks_across_pieces():
    out = "<S>ab<<P><P<M>M>c"
    for k in range(1, 6):
        pieces = [out[i : i + k] for i in range(0, len(out), k)]
        found = {"suffix": "", "prefix": "", "middle": ""}
        for part, piece in fim.parts(pieces, "spm"):
            found[part] += piece
        assert found == {"suffix": "ab<", "prefix": "<P", "middle": "M>c"}


def test_empty_table(spark):
    assert fim.transformed(fim.store(documents(spark, []))).collect() == []
