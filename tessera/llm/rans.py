"""Token-ID files coded by a static range asymmetric numeral system (rANS, Duda 2013).

All shards share one frequency table, counted over every token and stored as ``table.bin``. A shard
``shard-00000.rans`` holds independent blocks of at most ``block`` ids. A block's ids are dealt to ``lanes`` interleaved coders, row
by row; the coders' states are the vector that numpy works on. Every ``every`` rows a checkpoint keeps the
states and the place in the stream, so a reader can begin there. Block layout (little-endian):

    magic "rNS1" | n ids u32 | lanes u32 | every u32 | words u32 | checkpoints u32 | crc32 of the ids u32
    checkpoint states, lanes x u64 each | checkpoint places, u32 each | words, u32 each

After the blocks come the documents' lengths (u64 each), their ids (i64 each) and a byte each that is 1 for a null id, one (offset u64, first id u64, ids u64) for each block,
and a footer: documents u64 | blocks u64 | ids u64 | crc32 of the index u32 | magic "rNSx".

The documents of all shards, in the order of the shards, are in ascending id order.

Ids of documents are integers. Defined results: a null text counts as empty and has the end id only; repeated ids are ordered by text hash, and
alike rows stand side by side; null ids come first; an empty table has no shards and gives an empty result; extra columns are
not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .bpe import Cache, _alphabet
from .common import running, written

#: The frequencies add up to 2 ** SCALE. States are kept in [2 ** 31, 2 ** 63).
SCALE = 20
LANES, BLOCK, EVERY = 1024, 1 << 18, 128
#: Ids that a reader's task decodes at least, if the file has them.
READ = 1 << 21
#: Bytes of text that are tokenized at once, and words whose ids are put in place at once.
TEXT, PLACED = 1 << 22, 1 << 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD, _FOOT = struct.Struct("<4s6I"), struct.Struct("<3QI4s")


#: Printable ASCII without apostrophes, and the letters of the Latin blocks, which are composed and have lower-case forms without
#: context: runs of these are cut between letters, digits and marks (``_KIND``), and each digit stands alone.
_PLAIN = "^[!-&(-~\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]*$"
#: A piece of such a run, lower-case.
_PIECE = re.compile(r"[!-&(-/:-~]+|[0-9]|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u012f]+")
_DIGIT = 1
_KIND = np.array([_DIGIT if chr(b) in "0123456789" else 2 * (b > 127 or chr(b).isalpha()) for b in range(256)], np.uint8)


class WordTokenizer:
    """The ids that the tokenizers library gives, with a cache of the pieces of runs between ASCII white space.

    That needs a tokenizer in which white space only separates: pieces of the pre-tokenizer have none, and
    neither the normalizer nor the added tokens look across it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a b\tc\nd")]
        if pieces != ["a", "b", "c", "d"]:
            raise ValueError(f"{path}: a tokenizer that drops white space is expected")
        self.model = self.tokenizer.model
        self.alphabet = "".join(_alphabet())
        self.runs = Cache(self._run, 500_000)

    def _run(self, run: bytes) -> bytes:
        """Ids of a lower-case piece, by the library's model, or of any other run, by the whole library."""
        text = run.decode("utf-8", "replace")
        if run.isalpha() or (b"<|" not in run and _PIECE.fullmatch(text)):
            return array("I", [t.id for t in self.model.tokenize(charmap_decode(run, "strict", self.alphabet)[0])]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids (u32, little-endian) of a UTF-8 text."""
        return self.encode_all(pa.array([text], pa.binary()), 0)[0][:-1].tobytes()

    def encode_all(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids (u32) of all UTF-8 texts (binary; null: empty) one after the other, each text's followed by ``end``.

        Arrow cuts and numbers the runs. So the cache is asked once for each distinct piece of the texts, and the ids are
        put in place by number.
        """
        cut = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset))
        many = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        named = pc.list_flatten(cut).dictionary_encode()
        pieces, upto = _pieces(named.dictionary)  # space at a text's ends leaves an empty run, without pieces
        runs = self.runs
        own = [runs[p] for p in _values(pieces.dictionary)]
        pool, size = _placed(np.frombuffer(b"".join(own), np.uint32), np.fromiter(map(len, own), np.int64, len(own)) // 4, pieces.indices.to_numpy(zero_copy_only=False))
        # The end id is one more run, after each text's own.
        pool, size = np.append(pool, np.uint32(end)), np.append(np.diff(np.append(0, np.cumsum(size))[upto]), 1)
        ends = np.cumsum(many + 1) - 1
        numbers = np.full(int(many.sum()) + len(many), len(named.dictionary), np.int64)
        inner = np.ones(len(numbers), bool)
        inner[ends] = False
        numbers[inner] = named.indices.to_numpy(zero_copy_only=False)
        ids, sizes = _placed(pool, size, numbers)
        return ids, np.diff(np.cumsum(sizes)[ends], prepend=0)


def _pieces(run: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(pieces, upto): the lower-case pieces of plain runs, and other runs whole (binary); how many come before each run, and all."""
    plain = pc.and_not(pc.match_substring_regex(run, _PLAIN), pc.match_substring(run, "<|"))
    low = pc.if_else(plain, pc.utf8_lower(pc.if_else(plain, run, "")), run).cast(pa.binary())
    data, edges = _bytes(low)
    kind = _KIND[np.frombuffer(data, np.uint8)]
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    first &= np.repeat(plain.to_numpy(zero_copy_only=False), np.diff(edges))
    first[edges[:-1][np.diff(edges) > 0]] = True
    at = np.append(np.flatnonzero(first), len(kind)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return pieces.dictionary_encode(), np.searchsorted(at, edges)


def _bytes(values: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of a binary column without nulls, and where its values begin in them, and the end."""
    edges = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset)
    data = values.buffers()[2] or pa.py_buffer(b"")
    return data.slice(int(edges[0]), int(edges[-1] - edges[0])), edges - edges[0]


def _values(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column without nulls."""
    data, edges = _bytes(column)
    edges = edges.tolist()
    return map(data.to_pybytes().__getitem__, map(slice, edges, edges[1:]))


def _placed(pool: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes): the ids of the numbered runs one after the other. The pool holds the runs' ids, of ``size`` each."""
    start, sizes, out = np.cumsum(size) - size, size[numbers], [np.empty(0, np.uint32)]
    for a in range(0, len(numbers), PLACED):
        n = sizes[a : a + PLACED]
        at = np.cumsum(n) - n
        out.append(pool[np.repeat(start[numbers[a : a + PLACED]] - at, n) + np.arange(int(n.sum()))])
    return np.concatenate(out), sizes


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies (u32) that add up to 2 ** SCALE, at least 1 where the count isn't 0."""
    total = 1 << SCALE
    used = counts > 0
    if not used.any():
        return np.zeros(len(counts), np.uint32)
    if used.sum() > total:
        raise ValueError("more ids than the table has places")
    out = np.where(used, np.maximum(1, np.floor(counts * (total / counts.sum()))), 0).astype(np.int64)
    # What rounding leaves over goes to, or comes from, the most frequent ids.
    order = np.argsort(-out, kind="stable")
    gap = total - int(out.sum())
    while gap:
        at = order[: min(abs(gap), int(used.sum()))] if gap > 0 else order[: max(1, int((out[order] > 1).sum()))][: -gap]
        out[at] += 1 if gap > 0 else -1
        gap = total - int(out.sum())
        order = np.argsort(-out, kind="stable")
    return out.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)  # of each place


def encode_block(ids: np.ndarray, t: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    rows = -(-len(ids) // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []  # last row first
    saved: list[tuple[int, np.ndarray]] = []
    n_words = 0
    limit, scale = np.uint64(63 - SCALE), np.uint64(SCALE)
    low, freq, cum = np.uint64(0xFFFFFFFF), t.freq.take(ids), t.cum.take(ids)
    for r in range(rows - 1, -1, -1):
        f = freq[r * lanes : (r + 1) * lanes]
        s = state[: len(f)]
        full = np.flatnonzero(s >= (f << limit))
        over = s.take(full)
        words.append((over & low).astype(np.uint32))
        n_words += len(full)
        s[full] = over >> _WORD
        q = s // f
        s[:] = (q << scale) + (s - q * f) + cum[r * lanes : (r + 1) * lanes]
        if r % every == 0:
            saved.append((n_words, state.copy()))
    saved.reverse()
    states = b"".join(s.tobytes() for _, s in saved)
    places = np.array([n_words - n for n, _ in saved], np.uint32).tobytes()
    stream = np.concatenate(words[::-1]).tobytes() if words else b""
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return _HEAD.pack(b"rNS1", len(ids), lanes, every, n_words, len(saved), crc) + states + places + stream


def decode_block(block: bytes, t: Table, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids [lo, hi) of a block, decoded from the checkpoint before lo. Whole blocks are checked by their checksum."""
    magic, n, lanes, every, n_words, n_saved, crc = _HEAD.unpack_from(block)
    if magic != b"rNS1":
        raise ValueError("not a block")
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return np.empty(0, np.uint32)
    at = _HEAD.size
    states = np.frombuffer(block, "<u8", n_saved * lanes, at).reshape(n_saved, lanes)
    places = np.frombuffer(block, "<u4", n_saved, at + 8 * n_saved * lanes)
    words = np.frombuffer(block, "<u4", n_words, at + 8 * n_saved * lanes + 4 * n_saved)
    first = lo // lanes // every
    state, place = states[first].copy(), int(places[first])
    out = np.empty((min(-(-hi // lanes), -(-n // lanes)) - first * every) * lanes, np.uint32)
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    base = first * every * lanes
    for a in range(base, min(n, -(-hi // lanes) * lanes), lanes):
        s = state[: min(lanes, n - a)]
        slot = s & mask
        got = t.symbol.take(slot.view(np.int64))
        s[:] = t.freq.take(got) * (s >> shift) + slot - t.cum.take(got)
        low = np.flatnonzero(s < _LOW)
        s[low] = (s.take(low) << _WORD) | words[place : place + len(low)]
        place += len(low)
        out[a - base : a - base + len(got)] = got
    if lo == 0 and hi == n and zlib.crc32(out[:n].astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum is wrong")
    return out[lo - base : hi - base]


def write_shard(uri: str, docs: Iterator[tuple[int | None, np.ndarray]], t: Table, block: int = BLOCK) -> tuple[int, int]:
    """Writes a shard of (document id, token ids); returns numbers of documents and token ids."""
    lengths, doc_ids, no_id, index = array("Q"), array("q"), bytearray(), []
    have: list[np.ndarray] = []
    n = offset = total = 0
    with files.written_file(uri) as out:

        def put(ids: np.ndarray) -> None:
            nonlocal offset, total
            data = encode_block(ids, t)
            out.write(data)
            index.extend((offset, total, len(ids)))
            offset += len(data)
            total += len(ids)

        for doc_id, ids in docs:
            lengths.append(len(ids))
            doc_ids.append(doc_id or 0)
            no_id.append(doc_id is None)
            have.append(ids)
            n += len(ids)
            if n >= block:
                both = np.concatenate(have)
                for a in range(0, n - n % block, block):
                    put(both[a : a + block])
                have, n = [both[n - n % block :]], n % block
        if n:
            put(np.concatenate(have))
        tail = lengths.tobytes() + doc_ids.tobytes() + bytes(no_id) + np.array(index, "<u8").tobytes()
        out.write(tail + _FOOT.pack(len(lengths), len(index) // 3, total, zlib.crc32(tail), b"rNSx"))
    return len(lengths), total


class Shard:
    """A reader of one file, by its index."""

    def __init__(self, uri: str, t: Table):
        at, path = files.opened(uri)
        self.file, self.table = at.open_input_file(path), t
        size = self.file.size()
        self.file.seek(size - _FOOT.size)
        n_docs, n_blocks, self.n_ids, crc, magic = _FOOT.unpack(self.file.read(_FOOT.size))
        if magic != b"rNSx":
            raise ValueError(f"{uri}: not a shard")
        self.end = size - _FOOT.size - 17 * n_docs - 24 * n_blocks
        self.file.seek(self.end)
        tail = self.file.read(17 * n_docs + 24 * n_blocks)
        if zlib.crc32(tail) != crc:
            raise ValueError(f"{uri}: the index's checksum is wrong")
        self.lengths = np.frombuffer(tail, "<u8", n_docs).astype(np.int64)
        self.doc_ids = np.frombuffer(tail, "<i8", n_docs, 8 * n_docs)
        self.no_id = np.frombuffer(tail, np.uint8, n_docs, 16 * n_docs)
        self.blocks = np.frombuffer(tail, "<u8", 3 * n_blocks, 17 * n_docs).astype(np.int64).reshape(-1, 3)

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids [lo, hi) of the shard."""
        first = np.searchsorted(self.blocks[:, 1], lo, "right") - 1
        out = []
        for b in range(max(0, int(first)), len(self.blocks)):
            offset, start, n = self.blocks[b]
            if start >= hi:
                break
            self.file.seek(int(offset))
            stop = self.blocks[b + 1, 0] if b + 1 < len(self.blocks) else self.end
            out.append(decode_block(self.file.read(int(stop - offset)), self.table, max(0, lo - int(start)), min(int(n), hi - int(start))))
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def load_table(folder: str) -> Table:
    at, path = files.opened(f"{folder}/table.bin")
    with at.open_input_file(path) as f:
        return Table(np.frombuffer(f.read(), "<u4"))


def write(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, shards: int | None = None) -> DataFrame:
    """Encodes every text and writes the shards to ``folder``; (shard, n_docs, n_ids).

    Texts are tokenized once, into an intermediate table. It gives the counts for the shared table, and is dealt by ranges of
    (id, text hash) to shards of about ``READ`` ids, so that neither the number of tasks nor a task's size is fixed.
    """
    spark = df.sparkSession

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in _gathered(batches, TEXT):
            for part in _by_bytes(batch, "text", TEXT):
                ids, n = own.encode_all(part.column("text"), end)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(n, pa.int64()), *_packed(ids, n)], ["id", "tie", "n", "ids", "wide"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    ids = written(rows.mapInArrow(tokenized, "id long, tie long, n long, ids binary, wide binary"), "ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for column, kind in (("ids", "<u2"), ("wide", "<u4")):
                n = np.bincount(np.frombuffer(b"".join(batch.column(column).drop_null().to_pylist()), kind))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    # One row for each id of the vocabulary, a bound that doesn't grow with the texts.
    found = ids.select("ids", "wide").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r[0] for r in found), default=-1) + 1, np.int64)
    for token, n in found:
        counts[token] = n
    # A one-row job writes the table, so it goes where the tasks' files go.
    data = frequencies(counts).astype("<u4").tobytes()

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                with files.written_file(f"{folder}/table.bin") as out:
                    out.write(data)
            yield batch

    spark.range(1).mapInArrow(table, "id long").collect()
    n_shards = shards or max(1, round(int(counts.sum()) / READ))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        docs = (d for b in chain([first], batches) for d in zip(b.column("id").to_pylist(), _ids(b)))
        n_docs, n_ids = write_shard(shard_uri(folder, shard), docs, load_table(folder))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, n_docs, n_ids)], ["shard", "n_docs", "n_ids"])

    dealt = ids.repartitionByRange(n_shards, F.asc_nulls_first("id"), "tie").sortWithinPartitions(F.asc_nulls_first("id"), "tie")
    return written(dealt.select("id", "ids", "wide").mapInArrow(coded, "shard long, n_docs long, n_ids long"), "shards")


def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.rans"


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The batches put together to at least ``least`` bytes each, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose binary ``column`` has at most ``most`` bytes, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def _packed(ids: np.ndarray, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The rows' ids as binary: of two bytes each in the first array if all of a row's fit, else of four in the second."""
    ends = np.cumsum(n)
    if not len(ids) or ids.max() < 65536:
        offsets = (2 * np.concatenate([[0], ends])).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))]), pa.nulls(len(n), pa.binary())
    rows = [ids[b - k : b] for k, b in zip(n.tolist(), ends.tolist())]
    narrow = [x.astype("<u2").tobytes() if x.max() < 65536 else None for x in rows]
    return pa.array(narrow, pa.binary()), pa.array([None if p is not None else x.astype("<u4").tobytes() for p, x in zip(narrow, rows)], pa.binary())


def _ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for x, wide in zip(batch.column("ids").to_pylist(), batch.column("wide").to_pylist()):
        yield np.frombuffer(x, "<u2").astype(np.uint32) if wide is None else np.frombuffer(wide, np.uint32)


def read(shards: DataFrame, folder: str, part: int = READ) -> DataFrame:
    """(id, start, n_tokens, tokens) of every document: ids of all documents before it, and its own, as binary u32.

    The parts of a shard are decoded apart, each from the checkpoint before the first document that starts in it.
    """
    first = running(shards.withColumn("chunk", F.expr("shard div 1000")), [], "chunk", [F.col("shard")], "n_ids", "first")
    parts = first.select("shard", "first", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_ids") - 1, F.lit(0)), F.lit(part))).alias("lo"))
    parts = written(parts, "parts")
    parts = parts.repartition(max(1, parts.count()), "shard", "lo")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for batch in batches:
            for shard, first_id, lo in zip(*(batch.column(c).to_pylist() for c in ("shard", "first", "lo"))):
                t = t or load_table(folder)
                s = Shard(shard_uri(folder, shard), t)
                starts = np.concatenate([[0], np.cumsum(s.lengths)])
                a, b = np.searchsorted(starts[:-1], [lo, lo + part])
                for x in range(int(a), int(b), 1000):  # a thousand documents at a time
                    y = min(x + 1000, int(b))
                    ids = s.read(int(starts[x]), int(starts[y])).astype("<u4").tobytes()
                    own = [ids[4 * int(starts[i] - starts[x]) : 4 * int(starts[i + 1] - starts[x])] for i in range(x, y)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if s.no_id[i] else int(s.doc_ids[i]) for i in range(x, y)], pa.int64()), pa.array(starts[x:y] + first_id, pa.int64()),
                        pa.array(s.lengths[x:y], pa.int64()), pa.array(own, pa.binary())], ["id", "start", "n_tokens", "tokens"])

    return parts.select("shard", "first", "lo").mapInArrow(decoded, "id long, start long, n_tokens long, tokens binary")
