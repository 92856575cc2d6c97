"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can come last in its encoding. An automaton with suffix links
reports the tokens that end at each position; a token is the last one of the prefix if the merges would
leave the boundary to the last token of the rest alone (pair compatibility). Following the stored tokens
back from the end gives the ids that merging in rank order would give, in one pass over the piece.

Texts are cut as the tokenizers library cuts them: pieces come from the library's own pre-tokenizer, applied
to runs between single white-space characters, each run once per task while it stays in the cache.
For a column of texts Arrow numbers the runs and pieces of many texts, and all distinct pieces take their steps
together, as numpy arrays; runs of printable ASCII are cut by their characters' classes.

Python workers stand beside the executor's heap and live on after a task. So a column goes to a worker once, encoding
leaves nothing of its vocabulary there, and decoding has the tokens alone.

Vocabularies are byte-level BPE files of the tokenizers library without normalizer; the path must be readable on
every executor. Defined results: a null text counts as empty and has no ids; texts of any length are
encoded whole, in time proportional to their length; repeated rows are encoded alike; an empty table gives
an empty result; extra columns pass through, but for columns named like the output.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cached runs in each of a worker's two generations, and cached pair tests.
CACHE = 300_000

#: Bytes of text that are encoded at once, pieces that take their steps together, and bytes of a piece that goes alone.
TEXT, TOGETHER, LONG = 1 << 20, 1 << 14, 64
#: Results of pair tests on arrays have 2 ** PAIRS places.
PAIRS = 20

_TWO = re.compile(r"\s\s")
#: What ``\s`` is to Python, for RE2; runs that the pre-tokenizer cuts by class alone.
_SPACE, _PLAIN = r"[\t-\r\x1c-\x20\x{85}\p{Z}]", r"\A[\n ]?[!-&(-~]+\z"
#: Classes of ASCII: space, letter, digit, line end, other.
_CLASS = np.array([0 if c == 0x20 else 3 if c == 0x0A else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 for c in range(128)], np.uint8)


def _alphabet() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others are numbered from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    of = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [of[b] for b in range(256)]


def _spec(path: str) -> dict:
    """The tokenizer's file, if it is of the kind that is expected."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("end_of_word_suffix"):
        raise ValueError(f"{path}: byte-level BPE without normalizer, prefix space and word ends is expected")
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: plain added tokens are expected")
    if any(c not in model["vocab"] for c in _alphabet()):
        raise ValueError(f"{path}: a token for every byte is expected")
    return spec


def _tokens(spec: dict) -> list[bytes]:
    """The bytes of the tokens by id."""
    byte, vocab = {c: b for b, c in enumerate(_alphabet())}, spec["model"]["vocab"]
    token = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for t, i in vocab.items():
        token[i] = bytes(byte[c] for c in t)
    for t in spec["added_tokens"]:
        token[t["id"]] = t["content"].encode()
    return token


class Cache(dict):
    """key -> make(key), in two generations: what wasn't asked for since the last turn is forgotten."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Bpe:
    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        spec = _spec(path)
        model, vocab = spec["model"], spec["model"]["vocab"]
        # The pre-tokenizer alone: the library's tokenizer would take a vocabulary of its own.
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=spec["pre_tokenizer"].get("use_regex", True)).pre_tokenize_str
        self.token = _tokens(spec)
        top = len(self.token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        added = "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
        self.split_added = re.compile(f"({added})") if added else None
        # Texts whose white space doesn't stand alone between runs, or that have added tokens.
        self.odd = "|".join([rf"\A{_SPACE}", rf"{_SPACE}\z", _SPACE * 2, *([added] if added else [])])
        self.rank = [-1] * top  # of the merge that makes a token; -1: a byte
        self.parts: list[tuple[int, int] | None] = [None] * top
        self.pair: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            i, p = vocab[a + b], (vocab[a], vocab[b])
            self.pair[p] = r
            if self.parts[i] is None:
                self.rank[i], self.parts[i] = r, p
        self.vocab, self.apart = vocab, {}
        self.size = np.array([len(t) for t in self.token], np.int32)
        mark = _alphabet()[0x20]
        self.bare, self.spaced = Cache(lambda w: self._word(w, "", "")), Cache(lambda w: self._word(w, " ", mark))
        self.piece = Cache(lambda s: array("I", self.encode_piece(s)).tobytes(), CACHE // 3)

    @cached_property
    def own(self) -> list[int]:
        """The tokens that are their own encoding: only they can stand in one."""
        own = [False] * len(self.token)
        for t, i in sorted(self.vocab.items(), key=lambda x: self.rank[x[1]]):
            p = self.parts[i]
            own[i] = len(t) == 1 if p is None else own[p[0]] and own[p[1]] and self._stays(*p, True)
        return [i for i in self.vocab.values() if own[i]]

    @cached_property
    def ends(self) -> ahocorasick.Automaton:
        """Reports the tokens that end at each position; made by the first encoding, decoding doesn't need it."""
        ends, alphabet = ahocorasick.Automaton(), _alphabet()
        for i in self.own:
            t = self.token[i]
            ends.add_word("".join([alphabet[b] for b in t]), (i, len(t)))
        ends.make_automaton()
        return ends

    @cached_property
    def trie(self) -> dict[str, np.ndarray]:
        """The trie of the tokens as arrays: of every state but the root its parent, byte, depth and token (or -1), in order of depth."""
        child: dict[int, int] = {}
        parent, byte, depth, token = [0], [0], [0], [-1]
        for i in self.own:
            at = 0
            for b in self.token[i]:
                to = child.setdefault(at << 8 | b, len(token))
                if to == len(token):
                    parent.append(at)
                    byte.append(b)
                    depth.append(depth[at] + 1)
                    token.append(-1)
                at = to
            token[at] = i
        order = np.argsort(depth, kind="stable")  # the root stays first
        place = np.argsort(order)
        children = np.bincount(place[parent[1:]], minlength=len(token))
        return {"parent": place[np.array(parent)[order]], "byte": np.array(byte)[order], "token": np.array(token)[order], "children": children,
                "level": np.searchsorted(np.array(depth)[order], np.arange(max(depth) + 2))}

    @cached_property
    def steps(self) -> tuple[np.ndarray, ...]:
        """The automaton as arrays: states' rows (-1: none), the next state by row and byte, the one byte of states with one child,
        that child, suffix links, the longest token that ends in a state, and of a token the next longest that ends it.
        A state without a row goes on as its suffix link does, but for its one byte.
        """
        parent, byte, token, children, level = (self.trie[k] for k in ("parent", "byte", "token", "children", "level"))
        n = len(parent)
        rows = children > 1
        rows[0] = True
        row = np.where(rows, np.cumsum(rows) - 1, -1)
        link, longest, only, child = np.zeros(n, np.int64), token.copy(), np.full(n, -1, np.int16), np.zeros(n, np.int64)
        shorter = np.full(len(self.token), -1, np.int32)
        step = np.zeros((int(rows.sum()), 256), np.int32)
        one = np.flatnonzero(~rows[parent] & (np.arange(n) > 0))
        only[parent[one]], child[parent[one]] = byte[one], one
        tables = row, step, only, child, link
        every = np.arange(256)
        for a, b in zip(level[1:-1], level[2:]):  # the states of one depth
            up, x = parent[a:b], byte[a:b]
            if a > 1:
                of = np.unique(up[rows[up]])
                step[row[of]] = _next(tables, np.repeat(link[of], 256), np.tile(every, len(of))).reshape(-1, 256)
                link[a:b] = to = _next(tables, link[up], x)
                named = token[a:b] >= 0
                shorter[token[a:b][named]] = longest[to][named]
                longest[a:b] = np.where(named, token[a:b], longest[to])
            down = rows[up]
            step[row[up[down]], x[down]] = np.arange(a, b)[down]
        return *(t.astype(np.int32) for t in (row, step)), only, *(t.astype(np.int32) for t in (child, link, longest)), shorter

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merged pairs as sorted numbers, their ranks, and of each token its rank and parts."""
        keys = np.array([a * len(self.token) + b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        parts = np.array([p or (0, 0) for p in self.parts], np.int32)
        ranks = np.fromiter(self.pair.values(), np.int32, len(keys))
        return keys[order], ranks[order], np.array(self.rank, np.int32), parts[:, 0].copy(), parts[:, 1].copy()

    @cached_property
    def met(self) -> np.ndarray:
        """Results of pair tests, each at the place that its number's hash gives: 2 * (number + 1) + result. The later one stays."""
        return np.zeros(1 << PAIRS, np.int64)

    def _stays(self, left: int, right: int, made: bool = False) -> bool:
        """True if merging the bytes of left + right leaves a boundary between them.

        The merges are undone from the last one back. While two tokens meet at the boundary, the pair may
        have no merge that comes before the one that next changes either of them. made: not counting the
        merge of left and right themselves.
        """
        rank, parts, pair = self.rank, self.parts, self.pair
        ends = len(pair) + 1  # rank at which the meeting ends: any pair merges before that
        skip = made
        while True:
            r = pair.get((left, right))
            if r is not None and r < ends and not skip:
                return False
            skip = False
            if rank[left] > rank[right]:  # the left token was made last, from parts of which the right one met
                ends, left = rank[left], parts[left][1]
            elif rank[right] >= 0:  # of equal merges the left one comes first, so the same rank across the boundary would win
                ends, right = rank[right] + 1, parts[right][0]
            else:
                return True

    def _stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`_stays` for arrays of tokens."""
        keys, ranks, rank, first, second = self.merges
        out, at = np.ones(len(left), bool), np.arange(len(left))
        ends = np.full(len(left), len(keys) + 1, np.int32)
        while len(at):
            key = left.astype(np.int64) * len(self.token) + right
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            no = (keys[i] == key) & (ranks[i] < ends)
            out[at[no]] = False
            a, b = rank[left], rank[right]
            go = ~no & ((a > b) | (b >= 0))
            at, left, right, a, b = at[go], left[go], right[go], a[go], b[go]
            undo = a > b
            ends = np.where(undo, a, b + 1)
            left, right = np.where(undo, second[left], left), np.where(undo, right, first[right])
        return out

    def _meet(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """True where the tokens can follow one another, or left is the beginning (numbered like one more token)."""
        key = left.astype(np.int64) * (len(self.token) + 1) + right
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS)
        found = self.met[place]
        ok = (found & 1).astype(bool)
        new = np.flatnonzero((found >> 1) != key + 1)
        if len(new):
            _, i, back = np.unique(key[new], return_index=True, return_inverse=True)
            i = new[i]
            yes, inner = np.ones(len(i), bool), left[i] < len(self.token)
            yes[inner] = self._stay(left[i[inner]], right[i[inner]])
            self.met[place[i]] = 2 * (key[i] + 1) + yes
            ok[new] = yes[back]
        return ok

    def encode_pieces(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of pieces of the bytes ``text``, one piece after the other.

        All pieces take a step of one byte at a time. Long pieces go alone.
        """
        many = np.zeros(len(sizes), np.int64)
        order = np.argsort(-sizes, kind="stable")
        alone = int(np.searchsorted(-sizes[order], -LONG))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray | int]] = []  # pieces, ids, and how many ids of the piece follow
        alphabet = _alphabet()
        for p in order[:alone]:
            ids = np.array(self.encode_piece("".join([alphabet[b] for b in text[starts[p] : starts[p] + sizes[p]].tobytes()])), np.int32)
            many[p] = len(ids)
            found.append((np.full(len(ids), p), ids, np.arange(len(ids))[::-1]))
        for a in range(alone, len(order), TOGETHER):
            of = order[a : a + TOGETHER]
            last = self._last(text, starts[of], sizes[of]).ravel()
            at, here, n = sizes[of], np.arange(len(of)), 0
            while len(here):
                t = last[at * len(of) + here]
                many[of[here]] += 1
                found.append((of[here], t, n))
                at = at - self.size[t]
                more = at > 0
                here, at, n = here[more], at[more], n + 1
        ends, out = np.cumsum(many), np.empty(int(many.sum()), np.uint32)
        for p, t, n in found:
            out[ends[p] - 1 - n] = t
        return out, many

    def _last(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token of every prefix of the pieces (by length of the prefix, then by piece). Pieces come longest first."""
        *tables, longest, shorter = self.steps
        n, most = len(starts), int(sizes[0])
        last = np.empty((most + 1, n), np.int32)
        last[0] = len(self.token)
        flat, state = last.ravel(), np.zeros(n, np.int32)
        active = np.searchsorted(-sizes, -np.arange(1, most + 1), "right")  # pieces that have such a byte
        every = np.arange(n)
        for e, k in enumerate(active, 1):
            state = _next(tables, state[:k], text[starts[:k] + (e - 1)])
            todo, t = every[:k], longest[state]
            while True:
                last[e, todo] = t
                no = ~self._meet(flat[(e - self.size[t]) * n + todo], t)
                if not no.any():
                    break
                todo, t = todo[no], shorter[t[no]]
        return last

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece that is written in the byte-level alphabet."""
        last: list[int] = [-1] * len(piece)
        apart, token = self.apart, self.token
        for end, (t, size) in self.ends.iter(piece):
            if last[end] >= 0:
                continue
            start = end - size
            if start >= 0:
                key = (last[start], t)
                ok = apart.get(key)
                if ok is None:
                    if len(apart) > CACHE:
                        apart.clear()
                    ok = apart[key] = self._stays(*key)
                if not ok:
                    continue
            last[end] = t
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(token[last[at]])
        out.reverse()
        return out

    def _word(self, word: str, space: str, mark: str) -> bytes:
        """Ids of a run; plain ASCII words, also before a comma or full stop, are pieces as they stand."""
        if word.isascii():
            if word.isalpha():
                return array("I", self.encode_piece(mark + word)).tobytes()
            if word[-1:] in (",", ".") and word[:-1].isalpha():
                return (self.spaced if space else self.bare)[word[:-1]] + self.piece[word[-1]]
        return self._run(space + word)

    def _run(self, text: str) -> bytes:
        return b"".join([self.piece[p] for p, _ in self.cut(text)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text (uint32)."""
        parts = self.split_added.split(text) if self.split_added else [text]
        out: list[bytes] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.added[part]], np.uint32).tobytes())
            elif not part:
                continue
            elif part[0].isspace() or part[-1].isspace() or _TWO.search(part):
                out.append(self._run(part))
            else:  # Where white space stands alone, a space opens the next piece and a line end is one.
                bare, spaced = self.bare, self.spaced
                for k, line in enumerate(part.split("\n")):
                    if k:
                        out.append(bare["\n"])
                    words = line.split(" ")
                    out.append(bare[words[0]])
                    out.extend([spaced[w] for w in words[1:]])
        return np.frombuffer(b"".join(out), np.uint32)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids (uint32) of all texts (null: none) one after the other, and how many there are up to each text's end.

        Where white space stands alone, a space opens the next piece and a line end is one. Arrow cuts the texts there and numbers
        the runs, to which the white space before them belongs. Other texts are cut as wholes.
        """
        texts = texts.cast(pa.large_string())
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        odd = pc.and_(some, pc.fill_null(pc.match_substring_regex(texts, self.odd), False))
        plain = pc.and_not(some, odd)
        words = pc.split_pattern(pc.replace_substring(texts.filter(plain), "\n", " \n"), " ")
        many = np.zeros(len(texts), np.int64)
        many[plain.to_numpy(zero_copy_only=False)] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        named = pc.list_flatten(words).dictionary_encode()
        numbers, names = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), named.dictionary
        # Texts' first runs have no white space before them, and numbers of their own.
        at = (np.cumsum(many) - many)[many > 0]
        first, back = np.unique(numbers[at], return_inverse=True)
        numbers[at] = len(names) + back
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        spaced = pc.binary_join_element_wise(pc.if_else(pc.starts_with(names, "\n"), none, space), names, none)
        runs = pa.concat_arrays([spaced, names.take(pa.array(first))])
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        numbers = np.insert(numbers, (np.cumsum(many) - many)[whole], len(runs) + np.arange(len(whole)))
        many[whole] = 1
        ids = self._entries(runs, len(first), texts.take(pa.array(whole)).to_pylist()).take(pa.array(numbers))
        begins = _offsets(ids)
        return np.frombuffer(ids.buffers()[2] or b"", np.uint32, int(begins[-1]) // 4), begins[np.cumsum(many)] // 4

    def _entries(self, runs: pa.Array, bare: int, texts: list[str]) -> pa.Array:
        """The ids (binary) of the runs and of the texts. The last ``bare`` runs begin a text, the others begin with white space."""
        easy = pc.match_substring_regex(runs, _PLAIN).to_numpy(zero_copy_only=False)
        plain = runs.filter(pa.array(easy))
        begins = _offsets(plain)
        data = np.frombuffer(plain.buffers()[2] or b"", np.uint8, int(begins[-1]))
        kind = _CLASS[data]
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        new[begins[:-1]] = True
        sizes, firsts = np.diff(np.append(np.flatnonzero(new), len(data))), (np.cumsum(new) - 1)[begins[:-1]]
        # The rest is cut by the library: runs in one go, since white space stands at their beginnings only, and each text.
        hard = np.flatnonzero(~easy)
        bare = int(np.searchsorted(hard, len(runs) - bare))
        cut, more, known = [], [], []
        rest = runs.take(pa.array(hard)).to_pylist()
        rest[bare:] = ["\n" + r for r in rest[bare:]]
        pieces = [p for p, _ in self.cut("".join(rest))]
        mark, line = _alphabet()[0x20], _alphabet()[0x0A]
        more = [k for k, p in enumerate(pieces) if p[0] in (mark, line)]
        if len(more) != len(rest):
            each = [[p for p, _ in self.cut(r)] for r in rest]
            pieces, more = [p for x in each for p in x], np.cumsum([0, *map(len, each)])[:-1].tolist()
        cut = list(map(len, pieces))
        lines = more[bare:]  # pieces that aren't the runs' own
        for text in texts:
            more.append(len(cut))
            for i, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
                if i % 2:
                    known.append((len(cut), self.added[part]))
                    cut.append(len(part.encode()))
                elif part:
                    cut += [len(p) for p, _ in self.cut(part)]
        data = np.concatenate([data, np.frombuffer("".join(rest + texts).encode(), np.uint8)])
        firsts = np.concatenate([firsts, len(sizes) + np.array(more, np.int64)])
        n, sizes = len(sizes), np.concatenate([sizes, np.array(cut, np.int64)])
        ends = np.cumsum(sizes)
        if len(sizes) and ends[-1] != len(data):
            raise ValueError("pieces that cover the text are expected")
        named = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data)]).dictionary_encode()
        own = _offsets(named.dictionary)
        ids, many = self.encode_pieces(np.frombuffer(named.dictionary.buffers()[2] or b"", np.uint8, int(own[-1])), own[:-1], np.diff(own))
        # Added tokens and nothing (for the line ends put before bare runs) are numbered after the pieces.
        numbers = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        numbers[n + np.array(lines, np.int64)] = len(many) + len(known)
        numbers[n + np.array([k for k, _ in known], np.int64)] = len(many) + np.arange(len(known))
        ids = np.concatenate([ids, np.array([i for _, i in known], np.uint32)])
        ends = 4 * np.cumsum(np.concatenate([many, np.ones(len(known), np.int64), [0]]))
        placed = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(ids)]).take(pa.array(numbers))
        begins = _offsets(placed)
        out = pa.Array.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(np.append(begins[firsts], begins[-1])), placed.buffers()[2]])
        order = np.concatenate([np.flatnonzero(easy), hard, len(runs) + np.arange(len(texts))])
        return out.take(pa.array(np.argsort(order)))

    def forget(self) -> None:
        """Empties the caches."""
        for cache in (self.bare, self.spaced, self.piece):
            cache.forget()
        self.apart.clear()
        for large in ("steps", "met"):
            self.__dict__.pop(large, None)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.token[i] for i in ids]).decode("utf-8", "replace")

    @cached_property
    def tokens(self) -> pa.Array:
        return pa.array(self.token, pa.large_binary())

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids (null: null)."""
        return texts_of(self.tokens, ids)


def _next(tables, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The states that follow on bytes: a state's row tells, or its one child, or else the suffix link's step."""
    row, step, only, child, link = tables
    out = np.empty(len(state), np.int32)
    todo = np.arange(len(state))
    while True:
        at = row[state]
        known, same = at >= 0, only[state] == byte
        out[todo[known]] = step[at[known], byte[known]]
        out[todo[same]] = child[state[same]]
        go = ~(known | same)
        if not go.any():
            return out
        todo, state, byte = todo[go], link[state[go]], byte[go]


def _offsets(values: pa.Array) -> np.ndarray:
    """The offsets of a large string or binary array."""
    return np.frombuffer(values.buffers()[1], np.int64, values.offset + len(values) + 1)[values.offset :] if len(values) else np.zeros(1, np.int64)


def texts_of(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of ids (null: null)."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    found = tokens.take(pc.list_flatten(ids))
    if found.null_count:
        raise ValueError("ids without nulls are expected")
    at = np.concatenate([[0], _offsets(found)[ends]])
    valid = pc.is_valid(ids)
    bits = None if not ids.null_count else pa.array(valid.to_numpy(zero_copy_only=False)).buffers()[1]
    texts = pa.Array.from_buffers(pa.large_string(), len(ids), [bits, pa.py_buffer(at.astype(np.int64)), found.buffers()[2] or pa.py_buffer(b"")])
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # not UTF-8: ids that end within a character
        texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_string())
    return texts


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Bpe:
    """One per worker process while it encodes."""
    return Bpe(path)


@lru_cache(maxsize=4)
def tokens_of(path: str) -> pa.Array:
    """The tokens' bytes by id, all that decoding needs."""
    return pa.array(_tokens(_spec(path)), pa.large_binary())


def _freed() -> None:
    """Gives what is free back to the system. Spark keeps a worker for later tasks, also of other stages, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with at most TEXT bytes of text ``t`` at once, at least one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT, "right")))
        yield batch.slice(at, to - at)
        at = to


def _passed(df: DataFrame, col: str, left_out: list[str]) -> tuple[DataFrame, list[str], str, list[Column]]:
    """The column ``col`` as ``t`` beside the struct ``row`` of the others, each once; which of the two come back, with
    what types; and the columns of ``df`` as they are had from them."""
    columns = [c for c in df.columns if c not in left_out]
    others = [c for c in columns if c != col]
    row = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []
    sent = df.select(*row, F.col(f"`{col}`").alias("t"))
    back = ["row"] * bool(others) + ["t"] * (col in columns)
    types = "".join(f"{c} {sent.schema[c].dataType.simpleString()}, " for c in back)
    return sent, back, types, [(F.col("t") if c == col else F.col("row").getField(c)).alias(c) for c in columns]


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns ``drop``, with the ids of ``text_col`` as ``out`` (array of int)."""
    rows, back, types, columns = _passed(df, text_col, [out, *drop])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        try:
            for batch in batches:
                for part in parts(batch):
                    ids, ends = bpe.encode_all(part.column("t"))
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*map(part.column, back), pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))], [*back, "ids"])
        finally:
            bpe.forget()
            del bpe
            vocabulary.cache_clear()
            _freed()

    return rows.mapInArrow(run, f"{types}ids array<int>").select(*columns, F.col("ids").alias(out))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` as ``out`` (null ids: null)."""
    rows, back, types, columns = _passed(df, ids_col, [out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    yield pa.RecordBatch.from_arrays([*map(part.column, back), texts_of(tokens, part.column("t")).cast(pa.string())], [*back, "text"])
        finally:
            _freed()

    return rows.mapInArrow(run, f"{types}text string").select(*columns, F.col("text").alias(out))
