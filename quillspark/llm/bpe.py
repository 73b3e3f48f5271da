"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut by the pattern of the vocabulary (letters, digits, other signs, white space, each with one leading space, and the
English contractions); the cuts come from an array of character classes, for all texts of a batch at once, not from a regular expression engine.
Distinct pieces of a batch are bucketed by byte length into padded matrices. In each round every row merges its leftmost pair of minimum rank;
pairs are looked up in a hash table of numpy arrays; the row is compacted, and rows without a pair leave the matrix. A piece over LONG bytes has a
matrix of its own, laid over lines of LONG ids: the lines' least ranks give the leftmost pair of minimum rank, and only the lines that it touches are compacted.

Null and empty texts have no ids. Characters that are not UTF-8 become U+FFFD. Decoding concatenates the bytes of the ids and
raises ValueError for an id outside the vocabulary; null decodes to null. Each row is encoded on its own, repeated rows as often as they occur; an empty table
gives an empty table; a text of any length is read whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_array, pieces, prepare, q, texts_of, without

LONG = 256
EDGES = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, LONG)
NONE = np.int32(2**31 - 1)
#: Pieces, and ids and bytes of them, that a worker keeps from one batch to the next at most.
CACHE, CACHE_SIZE = 300_000, 6_000_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = "".join(regex.findall(pattern + "+", every))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def contractions(codes: np.ndarray, ends: np.ndarray, start: np.ndarray) -> None:
    """Cut 's 't 're 've 'm 'll 'd where their tick starts a piece; start[i] says whether a piece starts at i."""
    n = len(codes)
    ticks = np.flatnonzero(codes == 39)
    ticks = ticks[start[ticks]]
    if len(ticks):
        past = ends[np.searchsorted(ends, ticks, "right")]
        one = np.where(ticks + 1 < past, codes[np.minimum(ticks + 1, n - 1)], 0)
        two = np.where(ticks + 2 < past, codes[np.minimum(ticks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, width in ((ticks[short], 2), (ticks[long & ~short], 3)):
            start[found + 1] = False
            start[found + width] = True


def piece_starts(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that stand one after another and end at `ends` (each text has a character): their places, less the last end.

    The pieces are those of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(codes)
    kind = char_classes()[codes]
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[ends] = True
    space = kind == SPACE
    # The last character of white space before something else: a blank goes with what follows, anything else stands alone.
    last = np.flatnonzero(space[:-1] & ~space[1:])
    last = last[np.isin(last + 1, ends, invert=True)] if len(ends) > 1 else last
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    contractions(codes, ends, start)
    return np.flatnonzero(start[:n])


class Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class Known:
    """Pieces seen so far by number, and the ids of each."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.numbers, self.used, self.size = Numbers(), 0, 0
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def crowded(self) -> bool:
        return len(self.numbers) > CACHE or self.used + self.size > CACHE_SIZE

    def number(self, spelled: list[bytes]) -> np.ndarray:
        """The numbers of pieces; those that are new get the next ones."""
        return np.fromiter(map(self.numbers.__getitem__, spelled), np.int64, len(spelled))

    def fresh(self, first: int) -> list[bytes]:
        """The pieces numbered from first, with room made for their ids."""
        new = list(islice(self.numbers, first, None))
        self.size += sum(map(len, new))
        more = len(self.numbers) - len(self.starts)
        if more > 0:
            self.starts, self.sizes = (np.concatenate([x, np.zeros(max(more, 1 << 14), np.int64)]) for x in (self.starts, self.sizes))
        return new

    def add(self, numbers: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        """Keep the ids of pieces by their numbers."""
        room = self.used + len(flat)
        if room > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(room, 1 << 16), np.int32)])
        self.flat[self.used : room] = flat
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used = room

    def ids(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of pieces, one after another, and where each piece's begin (and the end)."""
        size = self.sizes[index]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[index] - ends + size, size) + np.arange(total)], np.concatenate([[0], ends])


def distinct_pieces(raw: bytes, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces of raw, which start at `starts` (from 0 on, without gaps), and for each piece which of them it is."""
    offsets = np.append(starts, len(raw)).astype(np.int32)
    cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    at, spelled = np.frombuffer(cut.dictionary.buffers()[1], np.int32)[: len(cut.dictionary) + 1].tolist(), cut.dictionary.buffers()[2].to_pybytes()
    return list(map(spelled.__getitem__, map(slice, at, at[1:]))), cut.indices.to_numpy()


class Vocabulary:
    """Ranks of a vocabulary file, with a hash table of the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.known = np.array([bool(x) for x in self.bytes_of])
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.slots = self.merged = None
        spelled = np.fromiter(map(len, self.bytes_of), np.int64, self.size)
        self.spelled, self.lengths, self.begins = np.frombuffer(b"".join(self.bytes_of), np.uint8), spelled, np.cumsum(spelled) - spelled
        self.known_pieces = Known()

    def build_pairs(self) -> None:
        """The hash table of pairs; only encoding needs it."""
        ranks = self.ranks
        left, right, into = [], [], []
        for k, v in ranks.items():
            for i in range(1, len(k)):
                a, b = ranks.get(k[:i]), ranks.get(k[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    into.append(v)
        keys = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.slots, self.merged = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        at, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):  # linear probing, a step for all keys at once
            free = self.slots[at[todo]] == 2**64 - 1
            _, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.slots[at[put]], self.merged[at[put]] = keys[put], np.array(into, np.int32)[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, NONE if it doesn't; a negative id is padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        at = self.slot(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.merged[at], NONE)
        missed = np.flatnonzero((seen != keys) & (seen != 2**64 - 1))
        while len(missed):
            at[missed] = (at[missed] + 1) & ((1 << self.bits) - 1)
            seen = self.slots[at[missed]]
            hit = seen == keys[missed]
            out[missed[hit]] = self.merged[at[missed[hit]]]
            missed = missed[~hit & (seen != 2**64 - 1)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def merge_matrix(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces of similar length: row numbers in the order in which rows ended, their numbers of ids, all ids."""
        n, width = len(rows), max(map(len, rows))
        lengths = np.fromiter(map(len, rows), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        live, ended = np.arange(n), []
        columns = np.arange(width)
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            done = best == NONE
            if done.any():
                own = lengths[live[done]]
                ended.append((live[done], own, ids[done][columns[: ids.shape[1]] < own[:, None]]))
                ids, ranks, live, at, best = ids[~done], ranks[~done], live[~done], at[~done], best[~done]
                if not len(live):
                    break
            width = int(lengths[live].max())
            ids, ranks = ids[:, :width], ranks[:, :width]
            rows_ = np.arange(len(live))
            past = columns[:width] > at[:, None]
            ids[:, :-1] = np.where(past[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[rows_, at] = best
            ranks[:, :-1] = np.where(past[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            after = np.where(at + 1 < width, ids[rows_, np.minimum(at + 1, width - 1)], -1)
            ranks[rows_, at] = self.pair_ranks(best, after)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.pair_ranks(ids[some, at[some] - 1], best[some])
            lengths[live] -= 1
        order, sizes, flat = map(np.concatenate, zip(*ended, strict=True))
        return order, sizes, flat

    def merge_long(self, piece: bytes, width: int = LONG) -> np.ndarray:
        """The same merges for one long piece, over lines of `width` ids; what a line lacks at its end is padding."""
        spell, rank_of = self.bytes_of, self.ranks
        own = self.single[np.frombuffer(piece, np.uint8)]
        lines = -(-len(own) // width)
        ids, ranks = np.full((lines, width), -1, np.int32), np.full((lines, width), NONE, np.int32)
        ids.reshape(-1)[: len(own)] = own
        ranks.reshape(-1)[: len(own) - 1] = self.pair_ranks(own[:-1], own[1:])
        length = np.full(lines, width)
        length[-1] = len(own) - width * (lines - 1)
        least = ranks.min(1)
        after, before = list(range(1, lines + 1)), list(range(-1, lines - 1))  # lines that still hold an id

        def drop(line: int, at: int) -> None:
            for m, pad in ((ids, -1), (ranks, NONE)):
                m[line, at:-1] = m[line, at + 1 :]
                m[line, -1] = pad
            length[line] -= 1

        while True:
            line = int(least.argmin())
            best = least[line]
            if best == NONE:
                return ids[ids >= 0]
            at, touched = int(ranks[line].argmin()), {line}
            if at + 1 < length[line]:
                drop(line, at + 1)
            else:
                other = after[line]
                drop(other, 0)
                touched.add(other)
                if not length[other]:
                    after[line] = after[other]
                    if after[other] < lines:
                        before[after[other]] = line
            ids[line, at] = best
            right = ids[line, at + 1] if at + 1 < length[line] else ids[after[line], 0] if after[line] < lines else -1
            ranks[line, at] = NONE if right < 0 else rank_of.get(spell[best] + spell[right], NONE)
            left = (line, at - 1) if at else (before[line], length[before[line]] - 1) if before[line] >= 0 else None
            if left:
                ranks[left] = rank_of.get(spell[ids[left]] + spell[best], NONE)
                touched.add(left[0])
            for x in touched:
                least[x] = ranks[x].min()

    def encode_pieces(self, first: int) -> None:
        """Find the ids of the pieces numbered from first; a piece that is a token is that token."""
        known = self.known_pieces
        spelled = known.fresh(first)
        whole = np.fromiter(map(self.ranks.get, spelled, repeat(-1)), np.int32, len(spelled))
        found = np.flatnonzero(whole >= 0)
        known.add(first + found, np.ones(len(found), np.int64), whole[found])
        rest = np.flatnonzero(whole < 0)
        bucket = np.searchsorted(EDGES, np.fromiter((len(spelled[i]) for i in rest), np.int64, len(rest)))
        for i in rest[bucket == len(EDGES)]:
            ids = self.merge_long(spelled[i])
            known.add(np.array([first + i]), np.array([len(ids)]), ids)
        for k, edge in enumerate(EDGES):
            members = rest[bucket == k]
            step = max(1, (1 << 20) // edge)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                order, sizes, flat = self.merge_matrix([spelled[i] for i in some])
                known.add(first + some[order], sizes, flat)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (and the end)."""
        if self.slots is None:
            self.build_pairs()
        if self.known_pieces.crowded():
            self.known_pieces.forget()
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        raw = whole.encode("utf-8", "replace")
        codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
        chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        starts = piece_starts(codes, np.unique(chars[1:][chars[1:] > 0]))
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        distinct, which = distinct_pieces(raw, np.add.reduceat(width, starts, dtype=np.int64).cumsum() - np.add.reduceat(width, starts, dtype=np.int64))
        first = len(self.known_pieces.numbers)
        numbers = self.known_pieces.number(distinct)
        if len(self.known_pieces.numbers) > first:
            self.encode_pieces(first)
        ids, at = self.known_pieces.ids(numbers[which])
        return ids, at[np.searchsorted(starts, chars)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, at = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode_flat(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids that begin at `at` (and the end), and where each row's begin (and the end)."""
        if len(ids) and (int(ids.max()) >= self.size or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.spelled[np.repeat(self.begins[ids] - ends[:-1], size) + np.arange(ends[-1])], ends[at]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_flat(ids, np.array([0, len(ids)]))[0].tobytes()


@lru_cache(4)
def load(ranks: bytes) -> Vocabulary:
    """The vocabulary of a rank file's content: base64 of the bytes, a blank, the rank, on each line."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})


def ranks_of(df: DataFrame, ranks_path: str) -> bytes:
    """A rank file, read by the driver; it goes along with the function (under 1 MB, whatever the input)."""
    prepare(df.sparkSession)
    with open(ranks_path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a binary column of each whole text's ids, unsigned 32-bit little-endian; a column of that name is replaced.

    Null and empty texts give no bytes. No shuffle; memory is bounded by pieces of 1 MB of text, or one text.
    """
    ranks = ranks_of(df, ranks_path)

    @F.arrow_udf(T.BinaryType())
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load(ranks)
        for batch in batches:
            found = [vocabulary.encode_flat(texts_of(piece)) for piece in pieces(batch)]
            yield pa.concat_arrays([pa.array([], pa.binary()), *(binary_array(ids.astype("<u4").view(np.uint8), 4 * at) for ids, at in found)])

    base = without(df, out) if text.lower() != out.lower() else df
    return base.withColumn(out, ids_of(q(text)))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids in a binary column (as encode makes it) stand for; null stays null."""
    ranks = ranks_of(df, ranks_path)

    @F.arrow_udf(T.BinaryType())
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load(ranks)
        for batch in batches:
            found = [pa.array([], pa.binary())]
            for piece in pieces(batch):
                own = [x or b"" for x in piece.to_pylist()]
                at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) // 4)])
                spelled = binary_array(*vocabulary.decode_flat(np.frombuffer(b"".join(own), "<u4"), at))
                found.append(pc.if_else(piece.is_valid(), spelled, None) if piece.null_count else spelled)
            yield pa.concat_arrays(found)

    base = without(df, out) if ids.lower() != out.lower() else df
    return base.withColumn(out, bytes_of(q(ids)))


def round_trip(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with both columns of encode() and decode(), made in one pass, so that a task has one worker and one vocabulary."""
    ranks = ranks_of(df, ranks_path)
    kind = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    @F.arrow_udf(kind)
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = load(ranks)
        for batch in batches:
            found = [pa.array([], pa.struct([("ids", pa.binary()), ("decoded", pa.binary())]))]
            for piece in pieces(batch):
                own, at = vocabulary.encode_flat(texts_of(piece))
                columns = [binary_array(own.astype("<u4").view(np.uint8), 4 * at), binary_array(*vocabulary.decode_flat(own, at))]
                found.append(pa.StructArray.from_arrays(columns, ["ids", "decoded"]))
            yield pa.concat_arrays(found)

    tmp = "_quill_both"
    rows = df.withColumn(tmp, both.asNondeterministic()(q(text)))
    gone = {ids.lower(), decoded.lower(), tmp}
    return rows.select(*(q(c) for c in df.columns if c.lower() not in gone), F.col(f"{tmp}.ids").alias(ids), F.col(f"{tmp}.decoded").alias(decoded))
