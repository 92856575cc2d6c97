"""Small tables with the awkward cases, and helpers."""

import random

CLASHING = ["row", "id", "uid", "digest", "kept", "n", "keep_id", "chunk", "rank", "pool", "x0", "words", "found", "salt", "size", "p0", "t"]


def documents(spark, rows, extra=True):
    """rows: (doc_id, text, lang, source). extra: columns whose names clash with inner ones."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = ["long", "string", "string", "string", "long"]
    data = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    if extra:
        names, kinds = names + CLASHING, kinds + ["string"] * len(CLASHING)
        data = [(*r, *(f"{c}-{i}" for c in CLASHING)) for i, r in enumerate(data)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward():
    long = prose(99, 30_000)
    return [
        (1, "one two  three", "en", "a"), (2, "one two three", "en", "a"), (3, "onetwothree", None, "b"), (4, "", "en", None), (5, None, "de", "a"),
        (6, " \t\n\x0b\f\r", "en", "a"), (7, "ONE two three", "en", "b"), (8, "one\xa0two three", "en", "b"), (9, "one two three", "en", "a"),
        (9, "one two three", "en", "a"), (None, "one two three", "en", "a"), (10, long, "en", "a"), (11, long + " tail", "en", "a"), (12, long, "fr", "b"),
        (None, None, None, None), (13, "😀 é ß 日本 \x00 x", "ja", "c"), (14, "a", "en", "c"), (14, "b", "en", "c"),
    ]
