"""Near-duplicate groups with SetSketch registers (Ertl, 2021).

A document's set holds its distinct ``width``-word shingles. Every shingle throws points on the line by a
Poisson process, each labelled with one of ``m`` registers; a register keeps the smallest of its points over
the set, on a scale of powers of ``base``. Registers of a union are the elementwise maximum of the parts'
registers, and equal registers are about as likely as the Jaccard similarity. Bands of registers give
candidates; candidates whose registers, by joint likelihood with the known set sizes, can't have the wanted similarity
go; the rest are confirmed on the full sets.

Work is done on classes of equal sets, so copies never meet each other. Each band's bucket has a hub, its best
known member, which is compared with all others; that connects most of a family of near copies, at one comparison a
member and hub. Members of buckets that aren't one component then meet by their rarest shingles, across components only.
No candidate pair is lost: a link must share one of both sets' first shingles in the order of rarity. And a
bucket of near copies isn't compared pair by pair.

Defined results: fewer words than ``width`` make one shingle of the whole sequence; null texts and texts
without words have an empty set and are linked with nothing. Null ids come after all others when the
smallest id is taken. Repeated rows have equal sets and so one component. An empty table gives an empty
result. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked, written


@dataclass(frozen=True)
class Sketch:
    """width: words in a shingle. bands x rows registers on the scale of powers of base, rate: see the paper.
    similar: links have at least so many hundredths of shared shingles. sure: twice the
    log-likelihood by which the registers must speak against a link to drop a candidate. sizes: ratio of neighbouring
    classes of set sizes, in which sets meet by their rarest shingles."""

    width: int = 5
    bands: int = 32
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    similar: int = 75
    sure: float = 16.0
    sizes: float = 1.06

    @property
    def m(self) -> int:
        return self.bands * self.rows


_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    z = (z ^ (z >> np.uint64(30))) * _ODD[1]
    z = (z ^ (z >> np.uint64(27))) * _ODD[2]
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    wide = min(width, len(words))
    n = len(words) - wide + 1
    out = np.full(n, wide, np.uint64)
    for i in range(wide):
        out = mixed(out * _ODD[0] + h[i : n + i])
    return np.unique(out)


def registers(sets: list[np.ndarray], s: Sketch) -> np.ndarray:
    """Register values (sets x m, uint16) of non-empty sets."""
    m = s.m
    size = np.array([len(x) for x in sets])
    low = np.full(len(sets) * m, np.inf)
    todo, factor = np.arange(len(sets)), np.log(m) + 3  # registers that stay empty below the limit: one set in 20
    while len(todo):
        limit = factor / (size * s.rate)
        low.reshape(-1, m)[todo] = np.inf
        of = np.repeat(todo, size[todo])
        h = np.concatenate([sets[i] for i in todo])
        x, step = np.zeros(len(h)), 0
        while len(h):
            step += 1
            z = mixed(h + np.uint64(step * int(_ODD[0]) % 2**64))
            x = x - np.log(((z & np.uint64(0xFFFFFFFFFF)).astype(np.float64) + 0.5) / 2.0**40) / (m * s.rate)
            near = x < limit[of]
            h, of, x, z = h[near], of[near], x[near], z[near]
            np.minimum.at(low, of * m + (((z >> np.uint64(40)) * np.uint64(m)) >> np.uint64(24)).astype(np.int64), x)
        todo = todo[np.isinf(low.reshape(-1, m)[todo]).any(axis=1)]
        factor *= 2
    return np.clip(np.floor(1 - np.log(low) / np.log(s.base)), 0, 65535).astype(np.uint16).reshape(-1, m)


def _likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, base: float) -> np.ndarray:
    """Log-likelihood of similarity j; u: the first set's share of both sizes; more, less, same: registers by order."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    a, b = p(u - (1 - u) * j), p((1 - u) - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-300))
    return more * log(a) + less * log(b) + same * log(1 - a - b)


def against(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, s: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, evidence): the most likely similarity, and twice the log-likelihood by which it beats the wanted one."""
    more, less = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = ra.shape[1] - more - less
    u = na / (na + nb)
    lo, hi = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    want = np.minimum(s.similar / 100, hi)
    f = lambda j: _likelihood(j, u, more, less, same, s.base)
    for _ in range(40):  # the likelihood is concave in j
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = f(a) < f(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    best = (lo + hi) / 2
    return best, np.where(best < want, 2 * (f(best) - f(want)), 0.0)


def _by_batch(f: Callable[[pa.RecordBatch], dict], schema: pa.Schema, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(f(batch.slice(at, rows)), schema)

    return run


def sketched(df: DataFrame, s: Sketch) -> DataFrame:
    """(uid, id, n, class_key, regs) of (uid, id, text binary); without shingles class_key and regs are null."""

    def f(b: pa.RecordBatch) -> dict:
        sets = [shingles(t, s.width) for t in b.column("text").to_pylist()]
        full = [i for i, x in enumerate(sets) if len(x)]
        key: list[bytes | None] = [None] * len(sets)
        regs: list[bytes | None] = [None] * len(sets)
        for i, r in zip(full, registers([sets[i] for i in full], s) if full else ()):
            key[i], regs[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), r.tobytes()
        return {"uid": b.column("uid"), "id": b.column("id"), "n": [len(x) for x in sets], "class_key": key, "regs": regs}

    kind = df.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("uid", pa.int64()), ("id", to_arrow_type(df.schema["id"].dataType)), ("n", pa.int64()), ("class_key", pa.binary()), ("regs", pa.binary())])
    return df.select("uid", "id", "text").mapInArrow(_by_batch(f, schema, 400), f"uid long, id {kind}, n long, class_key binary, regs binary")


def _sided(pairs: DataFrame, facts: DataFrame, names: dict[str, str]) -> DataFrame:
    """The pairs (a, b) with the facts of both classes, under the new names followed by a or b.

    Each side is joined with the pairs, which are small, and then the sides: so Spark may broadcast
    the pairs, and of the facts only those move that pairs need.
    """

    def side(x: str) -> DataFrame:
        own = facts.select(F.col("class").alias(x), *[F.col(c).alias(f"{n}{x}") for c, n in names.items()])
        return pairs.select("a", "b").join(own, x)

    return side("a").join(side("b"), ["a", "b"])


def _possible(pairs: DataFrame, classes: DataFrame, s: Sketch) -> DataFrame:
    """Of the pairs (a, b) those whose registers allow a link, with the estimate."""

    def f(batch: pa.RecordBatch) -> dict:
        if not batch.num_rows:
            return {"a": [], "b": [], "estimate": []}
        r = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, s.m) for c in ("ra", "rb")]
        n = [batch.column(c).to_numpy().astype(float) for c in ("na", "nb")]
        best, evidence = against(*r, *n, s)
        fits = np.minimum(*n) * 100 >= s.similar * np.maximum(*n)  # a link's sizes differ no more than that
        keep = pa.array(fits & (evidence <= s.sure))
        return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep), "estimate": pa.array(best).filter(keep)}

    both = _sided(pairs, classes.select("class", "n", "regs"), {"n": "n", "regs": "r"})
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("estimate", pa.float64())])
    return both.mapInArrow(_by_batch(f, schema, 2000), "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Sketch) -> DataFrame:
    """(a, b) of the pairs whose full sets are linked."""

    def f(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sa", "sb"))):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= s.similar * (len(p) + len(q) - both):
                out["a"].append(a)
                out["b"].append(b)
        return out

    both = _sided(pairs, sets, {"shingles": "s"})
    return both.mapInArrow(_by_batch(f, pa.schema([("a", pa.int64()), ("b", pa.int64())]), 200), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) with the smallest node of the component, for every node of the links (a, b).

    Large-star and small-star steps (Kiveris et al., 2014) by minima and joins, until all links are stars.
    """

    def step(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        out = near.join(least, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
        return out.where("a != b").distinct()

    e = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    while True:
        parents = e.groupBy("a").agg(F.count("*").alias("n"))
        inner = e.select("b").distinct().join(parents.select(F.col("a").alias("b")), "b", "left_semi")
        if parents.where("n > 1").select(F.col("a").alias("b")).unionByName(inner).isEmpty():
            break  # every node has one link to a node that has none: all stars
        e = written(step(step(e, True), False), "links")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _of(comps: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Adds ``c<column>``, the component of the class in ``column``."""
    own = comps.select(F.col("class").alias(column), F.col("comp").alias("_comp"))
    return df.join(own, column, "left").withColumn(f"c{column}", F.coalesce("_comp", column)).drop("_comp")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (class, comp) after further links (a, b): components of components."""
    ends = _of(comps, _of(comps, links, "a"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("into"))
    moved = comps.join(merged, "comp", "left").select("class", F.coalesce("into", "comp").alias("comp"))
    new = merged.join(comps.select("comp").distinct(), "comp", "left_anti").select(F.col("comp").alias("class"), F.col("into").alias("comp"))
    return written(moved.unionByName(new), "comps")


def _linked(classes: DataFrame, texts: DataFrame, s: Sketch) -> DataFrame:
    """(class, comp) for the classes that have a link."""
    wide = 2 * s.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(s.bands - 1)), lambda i: F.xxhash64(i, F.substr(F.col("regs"), i * wide + 1, F.lit(wide))))
    bands = classes.select("class", F.explode(keys).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(bands.join(shared, "bucket"), "members")

    def full(batch: pa.RecordBatch) -> dict:
        return {"class": batch.column("class"), "shingles": [shingles(t, s.width).tobytes() for t in batch.column("text").to_pylist()]}

    touched = texts.join(members.select(F.col("class").alias("uid")).distinct(), "uid").select(F.col("uid").alias("class"), "text")
    sets = written(touched.mapInArrow(_by_batch(full, pa.schema([("class", pa.int64()), ("shingles", pa.binary())]), 400), "class long, shingles binary"), "sets")

    # A class that meets many others in its bands' buckets is likely to be what they were made from: its buckets' hub.
    known = members.groupBy("class").agg(F.sum("n").alias("known"))
    best = members.join(known, "class").groupBy("bucket").agg(F.max(F.struct("known", (-F.col("class")).alias("neg"))).alias("best"))
    hubs = best.select("bucket", (-F.col("best.neg")).alias("hub"))
    others = written(members.join(hubs, "bucket").where("class != hub").select("bucket", "class", "hub"), "others")
    near = _possible(others.select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct(), classes, s)
    comps = _tried(written(near, "possible"), classes.sparkSession.createDataFrame([], "class long, comp long"), sets, s)

    left = _of(comps, others, "class").select("bucket", "class", F.col("cclass").alias("comp"))
    open_ = left.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("bucket")
    near = _possible(_meeting(written(left.join(open_, "bucket").select("class", "comp").distinct(), "open"), sets, s), classes, s)
    return _tried(written(near, "possible"), comps, sets, s)


def _tried(left: DataFrame, comps: DataFrame, sets: DataFrame, s: Sketch) -> DataFrame:
    """The components after the links among the possible pairs (a, b, estimate)."""
    tries = 1
    while not left.isEmpty():
        # Most likely links first: what they connect need not be compared any more. Each time more for a member.
        best = Window.partitionBy("a").orderBy(F.desc("estimate"), "b")
        turn = left.withColumn("at", F.row_number().over(best))
        links = written(_confirmed(turn.where(F.col("at") <= tries), sets, s), "confirmed")
        if not links.isEmpty():
            comps = _joined(comps, links)
        rest = _of(comps, _of(comps, turn.where(F.col("at") > tries), "a"), "b")
        left = written(rest.where("ca != cb").select("a", "b", "estimate"), "possible")
        tries *= 16
    return comps


def _meeting(members: DataFrame, sets: DataFrame, s: Sketch) -> DataFrame:
    """Of the members (class, comp), the pairs (a, b) of different components that may be linked by their rarest shingles.

    Shingles are ordered by the number of members that have them, rarest first. Linked sets of x and y shingles
    have c(x, y) = similar (x + y) / (100 + similar) in common, so the first shingle that they share has c - 1 others after it
    in both: pairs meet only at the first x - c + 1 and y - c + 1 shingles. Sizes fall into classes, so that c is known well
    before the meeting; a pair meets in the class of its smaller set. In a family of near copies the strays' first
    shingles are their own. What the largest component of a meeting point has isn't compared with itself.
    """

    def flat(batch: pa.RecordBatch) -> dict:
        found = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        n = np.array([len(x) for x in found], np.int64)
        tokens = np.concatenate(found) if found else np.empty(0, np.int64)
        return {"class": np.repeat(batch.column("class").to_numpy(), n), "n": np.repeat(n, n), "token": tokens}

    schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("token", pa.int64())])
    tokens = sets.join(members.select("class"), "class").mapInArrow(_by_batch(flat, schema, 100), "class long, n long, token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    last = Window.partitionBy("class").orderBy(F.desc("often"), F.desc("token"))
    # Shingles of one member only come first: counted from the end, they need no place.
    placed = tokens.join(often, "token").withColumn("at", F.col("n") - F.row_number().over(last) + 1)

    def common(x: str, y: str) -> str:
        return f"(({s.similar} * ({x} + {y}) + {99 + s.similar}) div {100 + s.similar})"

    def kind(n: str) -> str:
        return f"int(floor(ln({n}) / ln({s.sizes})))"

    least = f"(({s.similar} * n + 99) div 100)"
    smaller = placed.where(f"at <= n - {common('n', 'n')} + 1").select("token", F.expr(kind("n")).alias("size"), F.lit(False).alias("larger"), "class", "n", "at")
    larger = placed.where(f"at <= n - {least} + 1").select("token", "class", "n", "at", F.expr(f"explode(sequence({kind(least)}, {kind('n')}))").alias("size"))
    lowest = f"greatest(bigint(floor(pow({s.sizes}, size))) - 1, {least})"
    larger = larger.where(f"at <= n - {common('n', lowest)} + 1").select("token", "size", F.lit(True).alias("larger"), "class", "n", "at")
    firsts = written(smaller.unionByName(larger).join(members, "class"), "firsts")

    point = ["token", "size"]
    counts = firsts.groupBy(*point, "comp").agg(F.count("*").alias("many"))
    mixed_ = counts.groupBy(*point).agg(F.max(F.struct("many", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    met = firsts.join(mixed_.select(*point, F.col("top.comp").alias("top")), point).withColumn("own", F.col("comp") == F.col("top"))
    x = met.where("not larger").select(*point, F.col("own").alias("side"), *[F.col(c).alias(f"{c}x") for c in ("class", "n", "at", "comp")])
    sides = F.explode(F.when(F.col("own"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    y = met.where("larger").select(*point, sides.alias("side"), *[F.col(c).alias(f"{c}y") for c in ("class", "n", "at", "comp")])
    both = x.join(y, [*point, "side"]).where(f"compx != compy and nx <= ny and least(nx - atx, ny - aty) + 1 >= {common('nx', 'ny')}")
    return both.select(F.greatest("classx", "classy").alias("a"), F.least("classx", "classy").alias("b")).distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str, s: Sketch, whole: bool) -> tuple[DataFrame, DataFrame]:
    """The input with uid, written once; (uid, id, n, comp_id, comp_uid)."""
    named = {"id": df[id_col], "text": df[text_col].cast("binary")}
    rows = packed(df, **named) if whole else df.select(*[c.alias(n) for n, c in named.items()])
    if whole:
        rows = rows.drop("text")
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "near-docs")
    texts = rows.select("uid", F.col("id"), (F.col("row").getField(text_col).cast("binary") if whole else F.col("text")).alias("text"))
    docs = written(sketched(texts, s), "sketched")
    classes = docs.where("n > 0").groupBy("class_key").agg(F.min("uid").alias("class"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.min(_first()).alias("low"))
    classes = written(classes, "classes")
    comps = _linked(classes.select("class", "n", "regs"), texts, s)
    named_ = classes.select("class_key", "class", "low").join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    low = named_.groupBy("comp").agg(F.min("low").alias("least"))
    classed = written(named_.join(low, "comp").select(F.col("class_key").alias("_key"), "least"), "classed")
    empty = docs.where("n = 0").select("uid", "id", "n", F.col("id").alias("comp_id"), F.col("uid").alias("comp_uid"))
    full = docs.where("n > 0").join(classed, F.col("class_key") == F.col("_key")).select("uid", "id", "n", F.col("least.id").alias("comp_id"), F.col("least.uid").alias("comp_uid"))
    return rows, full.unionByName(empty)


def _first() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("uid").alias("uid"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id of its group), kept (it has that id)."""
    _, out = _grouped(df, id_col, text_col, sketch or Sketch(), whole=False)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp_id").alias("component_id"), F.col("id").eqNullSafe(F.col("comp_id")).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch | None = None) -> DataFrame:
    """One row of each group, all columns as they were: the one with the smallest id."""
    rows, out = _grouped(df, id_col, text_col, sketch or Sketch(), whole=True)
    return unpacked(rows.join(out.where("uid = comp_uid").select("uid"), "uid", "left_semi"), df.columns)
