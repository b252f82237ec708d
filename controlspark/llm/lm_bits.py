"""Logistic context mixing over the bits of words.

A word is its bytes and a space. Each bit is predicted in several contexts: the
last 1, 2, 3 and 4 bytes of the running text, and the whole word so far, each
with the bits of the byte that are known. The bytes reach back over the space
into the word before, up to its start. Only a word's first CROSS bytes have
contexts that do; such a byte's contexts are told by what stands in the four
bytes before it, so each distinct one is predicted once for all its places, and
the rest of a word once for all that stands before it. The short contexts are
hashed into tables of counts, summed over all training tokens; their sizes
follow the vocabulary up to a limit. The whole word so far has no table: in the sorted vocabulary the
words that begin alike stand together, so a context's counts are sums over a
run of it, exact at any size. A gate, made from how often the longest hashed
context and the whole word were seen, chooses the weights by which the
predictions are mixed in the logistic domain; an adaptive probability map
refines the result. In all learning a word's own token is taken out of the
counts first.

The sorted vocabulary is kept in shards, a row each. What the words of other
shards add at a shard's ends is known from the paths of the shards' first and
last words.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batch_of, batch_rows, tidy
from .textscan import BYTE_CODE, GOLDEN, U64, golden, mix64, powers

ORDERS = (1, 2, 3, 4)
#: Bytes at a word's start whose contexts can reach into the word before: its last ones, padded by spaces; BEFORE_ALL at a text's start.
CROSS, BEFORE_ALL = max(ORDERS) - 1, 0x202020
#: Parts into which crossings are dealt by their word's first bytes.
CROSS_PARTS = 64
#: Powers of two: the largest tables, and the least.
MOST, LEAST = (16, 19, 21, 22), 10
#: Rows of words of a shard, and words whose tables one task adds up, about.
SHARD, TABLE_WORDS = 1 << 17, 1 << 20
#: Rows of words in an Arrow batch.
WORD_ROWS = 1 << 12
#: Bytes of a word up to which the whole word so far is a context.
LONGEST = 256
PIECES = 128
STEPS, N_GATES, PRIOR = 33, 25 * 3, 0.2
INPUTS = len(ORDERS) + 1
#: Bytes of the runs of words after which weights move, and the largest weight of a word type, in means.
RUN, HEAVIEST = 8000, 50
#: Shares of the bits' probability in the mixture with a word's share of the tokens, of which one is chosen.
TRIES = np.array([0.02, 0.04, 0.06, 0.08, 0.1, 0.14, 0.18, 0.24, 0.3, 0.4, 0.5, 0.7, 0.9])
LN10 = np.log(10)
_SHARD = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("bytes", pa.int64()), ("seen", pa.int64()), ("sums", pa.list_(pa.int64())), ("words", pa.binary()), ("parts", pa.binary()), ("asks", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("data", pa.binary())])
_PREFIX = pa.schema([("codes", pa.binary()), ("counts", pa.binary())])
_MEAN = pa.schema([("data", pa.binary()), ("nodes", pa.binary()), ("means", pa.binary())])
_EDGE = pa.schema([("shard", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("ahead", pa.list_(pa.float64())), ("behind", pa.list_(pa.float64())), ("through", pa.int32())])
_PIECE = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])
_SUMS = pa.schema([("data", pa.binary())])


class Words(NamedTuple):
    """Words with a space after each, as bytes."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, names: list[bytes]) -> "Words":
        sizes = np.array([len(x) + 1 for x in names], dtype=np.int64)
        return cls(np.frombuffer(b" ".join(names) + b" ", dtype=np.uint8), np.cumsum(sizes) - sizes, sizes)

    def rest(self, crossing: bool) -> np.ndarray:
        """The places of all bytes, or of those that have no context before their word."""
        if not crossing:
            return np.arange(len(self.data))
        return np.flatnonzero(np.arange(len(self.data)) - np.repeat(self.starts, self.sizes) >= CROSS)


def runs_of(sizes: np.ndarray, limit: int):
    """Runs of words of about ``limit`` bytes."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


def shared_bits(w: Words) -> np.ndarray:
    """Of each word the bits that it shares with the word before, counted up to LONGEST bytes; -1 for the first."""
    out = np.full(len(w.starts), 8 * LONGEST, dtype=np.int64)
    out[0] = -1
    same = np.arange(1, len(w.starts))
    for j in range(LONGEST):
        same = same[(w.sizes[same] > j) & (w.sizes[same - 1] > j)]
        if not len(same):
            break
        differ = w.data[w.starts[same] + j] ^ w.data[w.starts[same - 1] + j]
        end = differ > 0
        out[same[end]] = 8 * j + 7 - np.floor(np.log2(differ[end])).astype(np.int64)
        same = same[~end]
    return out


class Edge(NamedTuple):
    """What other shards add: by depth in bits, the tokens of words before (after) the shard that begin as its first (last) word does."""

    before: np.ndarray
    after: np.ndarray


def _bits_of(word: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(word[:LONGEST] + b" ", dtype=np.uint8))


def prefix_counts(w: Words, c: np.ndarray, edge: Edge | None) -> np.ndarray:
    """How many tokens have a zero (a one) next to the whole word so far: (2, 8, bytes) for each bit of each byte."""
    out = np.zeros((2, 8, len(w.data)), dtype=np.float32)
    shared, n, live = shared_bits(w), len(w.starts), np.arange(len(w.starts))
    before, after = (edge.before, edge.after) if edge else (np.zeros(0), np.zeros(0))
    at = lambda x, d: x[d] if d < len(x) else 0.0
    for j in range(LONGEST):
        live = live[w.sizes[live] > j]
        if not len(live):
            break
        where = w.starts[live] + j
        byte, tokens, same = w.data[where], c[live], shared[live]
        for k in range(8):
            d = 8 * j + k
            fresh = same < d
            fresh[0] = True
            run = np.cumsum(fresh) - 1
            bit = (byte >> np.uint8(7 - k)) & np.uint8(1)
            total = np.bincount(run, weights=tokens)
            one = np.bincount(run, weights=tokens * bit)
            # Words before the first one that share d bits have a zero next, unless they share d + 1; words after the last a one.
            if live[0] == 0 and (more := at(before, d)):
                total[0] += more
                one[0] += at(before, d + 1) if bit[0] else 0.0
            if live[-1] == n - 1 and (more := at(after, d)):
                total[-1] += more
                one[-1] += more if bit[-1] else more - at(after, d + 1)
            out[0, k, where] = (total - one)[run]
            out[1, k, where] = one[run]
    return out


def edges(rows: list[dict]) -> dict[int, Edge]:
    """The edges of all shards from their rows in order: first, last, ahead and behind (tokens that share d bits with the first and the last word), through (bits that all its words share)."""

    def common(a: bytes, b: bytes) -> int:
        x, y = _bits_of(a), _bits_of(b)
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n

    def added(own: np.ndarray, through: int, more: np.ndarray) -> np.ndarray:
        out = np.zeros(max(len(own), min(through + 1, len(more))))
        out[: len(own)] = own
        m = min(through + 1, len(more))
        out[:m] += more[:m]
        return out

    before, after = {}, {}
    for order, into, near, far, own in ((rows, before, "first", "last", "behind"), (rows[::-1], after, "last", "first", "ahead")):
        carry, last = np.zeros(0), None
        for r in order:
            into[r["shard"]] = carry[: common(last, r[near]) + 1] if last is not None else np.zeros(0)
            carry = added(np.array(r[own]), r["through"], into[r["shard"]])
            last = r[far]
    return {r["shard"]: Edge(before[r["shard"]], after[r["shard"]]) for r in rows}


def _paths(w: Words, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    shared = shared_bits(w)
    with_first = np.minimum.accumulate(np.concatenate(([8 * LONGEST], shared[1:])))
    with_last = np.minimum.accumulate(np.concatenate(([8 * LONGEST], shared[1:][::-1])))[::-1]
    count = lambda x, size: np.bincount(np.minimum(x, size), weights=c, minlength=size + 1)[::-1].cumsum()[::-1][:size]
    size = lambda i: 8 * min(int(w.sizes[i]), LONGEST)
    return count(with_first, size(0)), count(with_last, size(-1)), int(with_first[-1])


def planes(x: np.ndarray) -> bytes:
    """Integers with their low bytes first: the high ones compress to little."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T).view(kind).reshape(-1)


def shards(counts: DataFrame, columns: list[str], scratch: Scratch, n_words: int) -> DataFrame:
    """The sorted vocabulary in rows of about SHARD rows of counts: word binary and the named counts, which are summed; with block and idx, where these are known, the places that ask for the word."""
    asked = [x for x in ("block", "idx") if x in counts.columns]

    @tidy
    def gather(batches):
        from pyspark import TaskContext

        names, fresh, parts, asks = [], [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word")
            new = np.ones(len(word), dtype=bool)
            new[0] = not names or word[0].as_py()[:-1] != names[-1]
            new[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            names += [x[:-1] for x in word.filter(pa.array(new)).to_pylist()]
            fresh.append(new)
            parts.append(np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in columns]))
            asks.append([batch.column(x).fill_null(-1).to_numpy(zero_copy_only=False) for x in asked])
        if names:
            fresh = np.concatenate(fresh)
            own = np.add.reduceat(np.concatenate(parts, axis=1).astype(np.int64), np.flatnonzero(fresh), axis=1)
            place = b""
            if asked:
                block, idx = (np.concatenate(x) for x in zip(*asks, strict=True))
                word = np.cumsum(fresh) - 1
                order = np.argsort(block, kind="stable")
                order = order[block[order] >= 0]
                place = zstandard.compress(b"".join(planes(np.ascontiguousarray(x[order].astype(np.int64))) for x in (block, idx, word)), 1)
            row = ([TaskContext.get().partitionId()], [len(names)], [sum(map(len, names)) + len(names)], [int((own.sum(axis=0) > 0).sum())], [own.sum(axis=1).tolist()])
            yield batch_of(_SHARD, (*row, [zstandard.compress(b" ".join(names), 3)], [zstandard.compress(own.tobytes(), 1)], [place]))

    # With its space, in whose order words stand: a sort by an expression evaluates it in each comparison.
    spaced = counts.select(F.concat("word", F.lit(b" ")).alias("word"), *columns, *asked)
    ranged = spaced.repartitionByRange(max(1, -(-n_words // SHARD)), "word").sortWithinPartitions("word")
    with batch_rows(scratch.spark, WORD_ROWS):
        return scratch.save("shards", ranged.mapInArrow(gather, "shard int, n int, bytes bigint, seen bigint, sums array<bigint>, words binary, parts binary, asks binary"))


def unpacked(row: dict, n_columns: int) -> tuple[list[bytes], np.ndarray]:
    return zstandard.decompress(row["words"]).split(b" "), np.frombuffer(zstandard.decompress(row["parts"]), dtype=np.int64).reshape(n_columns, -1)


class Tables(NamedTuple):
    """Counts of zeros and of ones in hashed contexts, one order after another."""

    bits: tuple[int, ...]
    counts: np.ndarray  #: (2, slots)

    @property
    def firsts(self) -> list[int]:
        return [sum(1 << b for b in self.bits[:i]) for i in range(len(self.bits))]

    @classmethod
    def empty(cls, n_bytes: int, kind: type = np.float64) -> "Tables":
        """Two slots for each byte of the vocabulary in each order, between the least and the largest."""
        bits = tuple(min(most, max(LEAST, (2 * n_bytes).bit_length())) for most in MOST)
        return cls(bits, np.zeros((2, sum(1 << b for b in bits)), dtype=kind))


class Packed:
    """Tables to be sent: compressed, as each machine writes what it is sent to its disk."""

    def __init__(self, tables: Tables):
        self.bits = tables.bits
        self.data = [zstandard.compress(planes(np.ascontiguousarray(x, dtype=np.float32)), 1) for x in tables.counts]

    def tables(self) -> Tables:
        """A slot's two counts stand side by side, as they are read together."""
        n = sum(1 << b for b in self.bits)
        counts = np.empty((n, 2), dtype=np.float32)
        for i, x in enumerate(self.data):
            data = zstandard.decompress(x)
            for j in range(4):
                counts.view(np.uint8).reshape(n, 2, 4)[:, i, j] = np.frombuffer(data, dtype=np.uint8, count=n, offset=j * n)
        return Tables(self.bits, counts.T)


def contexts(w: Words) -> list[np.ndarray]:
    """Of every byte its hashed contexts."""
    n = len(w.data)
    start = np.repeat(w.starts, w.sizes)
    place = np.arange(n) - start
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(BYTE_CODE[w.data] * up[:n], out=total[1:])
    out = []
    for order in ORDERS:
        low = np.maximum(start, np.arange(n) - order)
        out.append(mix64((total[:-1] - total[low]) * down[low] + np.minimum(place, order).astype(U64) * GOLDEN + golden(order + 7)))
    return out


def crossings(before: np.ndarray, heads: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of words, given by the last bytes before them and their first ones (CROSS of each, padded by spaces, as numbers): for each of the first places which words have it, and there the four bytes that tell its contexts and its byte, less the space."""
    return [crossings_at(before, heads, p) for p in range(CROSS)]


def crossings_at(before: np.ndarray, heads: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    has = np.flatnonzero((heads >> 8 * (CROSS - p)) & 255 != 32) if p else np.arange(len(heads))
    return has, ((before[has] & ((1 << 8 * (CROSS - p)) - 1)) << 8 * (p + 1)) | heads[has] >> 8 * (CROSS - 1 - p)


def crossing_contexts(code: np.ndarray, p: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of crossings at a place: the bytes, and their hashed contexts. Those within the word are as ``contexts`` has them."""
    up, _ = powers(CROSS + 2)
    at = [((code >> 8 * i) & 255).astype(np.uint8) for i in range(p, -1, -1)]  # the word's bytes
    out = []
    for order in ORDERS:
        own = at[max(0, p - order) : p]
        h = sum((BYTE_CODE[x] * up[i] for i, x in enumerate(own)), np.zeros(len(code), dtype=U64))
        h = mix64(h + (np.full(len(code), min(p, order), dtype=U64) * GOLDEN + golden(order + 7)))
        if (reach := order - p - 1) > 0:
            h = mix64(h + ((code >> 8 * (p + 1)) & ((1 << 8 * reach) - 1)).astype(U64) * GOLDEN + golden(reach))
        out.append(h)
    return at[p], out


class Prefixes(NamedTuple):
    """Training tokens by the first CROSS bytes of words, padded by spaces."""

    codes: np.ndarray
    below: np.ndarray  #: tokens of smaller codes

    @classmethod
    def of(cls, found: DataFrame, n_columns: int) -> "Prefixes":
        @tidy
        def count(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    names, parts = unpacked(row, n_columns)
                    codes, which = np.unique(first_bytes(names), return_inverse=True)
                    yield batch_of(_PREFIX, ([codes.tobytes()], [np.bincount(which, weights=parts.sum(axis=0)).tobytes()]))

        rows = found.select("words", "parts").mapInArrow(count, "codes binary, counts binary").toArrow().to_pylist()  # 2**24 codes at most, a few more where shards meet
        codes = np.concatenate([np.frombuffer(r["codes"], dtype=np.int64) for r in rows])
        own, which = np.unique(codes, return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate([np.frombuffer(r["counts"]) for r in rows]))
        return cls(own, np.concatenate(([0.0], np.cumsum(counts))))

    def whole(self, code: np.ndarray, p: int) -> np.ndarray:
        """``prefix_counts`` of crossings at a place."""
        out = np.empty((2, 8, len(code)), dtype=np.float32)
        word = code & ((1 << 8 * (p + 1)) - 1)
        at = lambda x: self.below[np.searchsorted(self.codes, x)]
        rest = 8 * (CROSS - p)
        low, high = at(word >> 8 << rest), at(((word >> 8) + 1) << rest)
        for k in range(8):
            mid = at(((word >> (8 - k)) * 2 + 1) << (rest - k - 1))
            out[0, k], out[1, k] = mid - low, high - mid
            one = (word >> (7 - k)) & 1 > 0
            low, high = np.where(one, mid, low), np.where(one, high, mid)
        return out


def first_bytes(names: list[bytes]) -> np.ndarray:
    w = Words.of(names)
    return first_of(w.data, w.starts, w.starts + w.sizes - 1)


def last_bytes(names: list[bytes]) -> np.ndarray:
    w = Words.of(names)
    return last_of(w.data, w.starts, w.starts + w.sizes - 1)


def first_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of words, given by their places, the first CROSS bytes as a number."""
    out = np.zeros(len(starts), dtype=np.int64)
    for i in range(CROSS):
        out = out << 8 | np.where(starts + i < ends, data[np.minimum(starts + i, len(data) - 1)], 32)
    return out


def last_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last CROSS bytes as a number."""
    out = np.zeros(len(starts), dtype=np.int64)
    for i in range(CROSS, 0, -1):
        out = out << 8 | np.where(ends - i >= starts, data[np.maximum(ends - i, 0)], 32)
    return out


def crossing_rows(before: np.ndarray, heads: np.ndarray) -> list[tuple[int, bytes]]:
    """Distinct crossings with their counts in parts: a word's first bytes are all in one part, whatever stands before them."""
    key, n = np.unique(np.concatenate([code | p << 32 for p, (_, code) in enumerate(crossings(before, heads))]), return_counts=True)
    p = key >> 32
    node = key & ((1 << 8 * (p + 1)) - 1)
    part = (mix64((node + (p << 32)).astype(U64) + GOLDEN) % U64(CROSS_PARTS)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(CROSS_PARTS + 1))
    out = []
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[i] : cuts[i + 1]]
        out.append((i, zstandard.compress(planes(key[own]) + planes(n[own].astype(np.int64)), 1)))
    return out


def merged_crossings(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a part from ``crossing_rows`` (part, payload): its distinct crossings and their counts."""

    def merge(table: pa.Table) -> pa.Table:
        key, n = np.zeros(0, dtype=np.int64), np.zeros(0)
        data = table["payload"].to_pylist()
        for i in range(0, len(data), 50):
            found = [unpacked_crossings(x) for x in data[i : i + 50]]
            key, which = np.unique(np.concatenate([key, *(x for x, _ in found)]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([n, *(y for _, y in found)]))
        return pa.table([pa.array([table["part"][0].as_py()], pa.int32()), pa.array([zstandard.compress(planes(key) + planes(n.astype(np.int64)), 1)], pa.binary())], names=["part", "payload"])

    return scratch.save("crossings", rows.select("part", "payload").groupBy("part").applyInArrow(merge, "part int, payload binary"))


def unpacked_crossings(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.decompress(data)
    n = len(data) // 16
    return from_planes(data, np.int64, n), from_planes(data, np.int64, n, 8 * n)


def slots(data: np.ndarray, hashed: list[np.ndarray], k: int, tables: Tables) -> tuple[np.ndarray, list[np.ndarray]]:
    """The k-th bit of every byte and its slot in each order's table."""
    node = (data.astype(np.int64) | 256) >> (8 - k)
    step = node.astype(U64) * U64(0x9E3779B97F4A7C15)
    return (data >> np.uint8(7 - k)) & np.uint8(1), [(((c + step) * U64(0xD6E8FEB86659FD93)) >> U64(64 - b)).astype(np.int64) + first for c, b, first in zip(hashed, tables.bits, tables.firsts, strict=True)]


def gather_tables(found: DataFrame, n_columns: int, n_words: int, n_bytes: int, scratch: Scratch, crossing: DataFrame | None = None) -> Tables:
    """The tables of all shards' words, summed in pieces; with crossings these stand for the words' first bytes."""

    crosses = crossing is not None

    def add(tables: Tables, data: np.ndarray, hashed: list[np.ndarray], weight: np.ndarray) -> None:
        for k in range(8):
            bit, at = slots(data, hashed, k, tables)
            for s in at:
                np.add.at(tables.counts.reshape(-1), s + tables.counts.shape[1] * bit.astype(np.int64), weight)

    @tidy
    def count(batches):
        tables = Tables.empty(n_bytes)
        for batch in batches:
            for row in batch.to_pylist():
                if row["words"] is None:
                    key, n = unpacked_crossings(row["parts"])
                    for p in range(CROSS):
                        own = np.flatnonzero(key >> 32 == p)
                        for i in range(0, len(own), 150_000):
                            x = own[i : i + 150_000]
                            add(tables, *crossing_contexts(key[x] & 0xFFFFFFFF, p), n[x].astype(np.float64))
                    continue
                names, parts = unpacked(row, n_columns)
                tokens, sizes = parts.sum(axis=0).astype(np.float64), np.array([len(x) + 1 for x in names])
                for i, j in runs_of(sizes, 150_000):
                    w = Words.of(names[i:j])
                    keep = w.rest(crosses)
                    add(tables, w.data[keep], [x[keep] for x in contexts(w)], np.repeat(tokens[i:j], w.sizes)[keep])
        flat = tables.counts.reshape(-1)
        if flat.any():
            for i, part in enumerate(np.array_split(flat, PIECES)):
                yield batch_of(_PIECE, ([i], [zstandard.compress(part.tobytes(), 1)]))

    found = found.select("words", "parts")
    if crosses:
        found = found.unionByName(crossing.select(F.lit(None).cast("binary").alias("words"), F.col("payload").alias("parts")))
    schema = "piece int, counts binary"
    pieces = found.coalesce(max(6, n_words // TABLE_WORDS)).mapInArrow(count, schema).repartition("piece").sortWithinPartitions("piece").mapInArrow(_add_pieces, schema)
    out = Tables.empty(n_bytes, np.float32)
    flat = out.counts.reshape(-1)
    starts = np.cumsum([0] + [len(x) for x in np.array_split(flat, PIECES)])
    for row in scratch.save("tables", pieces).toLocalIterator():  # the tables' size, whatever the input's
        flat[starts[row.piece] : starts[row.piece + 1]] = np.frombuffer(zstandard.decompress(row.counts), dtype=np.float64)
    return out


@tidy
def _add_pieces(batches):
    now = total = None
    done = lambda: batch_of(_PIECE, ([now], [zstandard.compress(total.tobytes(), 1)]))
    for batch in batches:
        for piece, data in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if piece != now:
                if now is not None:
                    yield done()
                now, total = piece, 0.0
            total = total + np.frombuffer(zstandard.decompress(data), dtype=np.float64)
    if now is not None:
        yield done()


def stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + PRIOR) / (zeros + PRIOR))


def level(n: np.ndarray) -> np.ndarray:
    return sum((n >= x).view(np.uint8) for x in (0.5, 1.5, 4.5, 30.5))


def by_both(lp: np.ndarray, c: np.ndarray, n: float, share: float) -> np.ndarray:
    """log10 of the mixture of the probability by bits, whose log10 is lp, and the share c / n."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(share) + lp * LN10, np.log((1 - share) * c / max(1.0, n))) / LN10


class Mixer:
    """Gated weights and the adaptive map over the predictions of all contexts."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.weights = np.full((N_GATES, INPUTS), 1.0 / 3)
        self.map = np.tile(1 / (1 + np.exp(-self.steps())), (N_GATES, 1))
        self.logits = self.levels = self.sent = None
        self.by_bits = 1.0

    @staticmethod
    def steps() -> np.ndarray:
        return np.linspace(-12, 12, STEPS)

    @staticmethod
    def gate(word: np.ndarray, hashed: np.ndarray, k: int) -> np.ndarray:
        """By the whole word so far and the last three bytes, and the first, next or last bits of a byte."""
        return (word.astype(np.int64) * 5 + hashed) * 3 + (0 if k < 3 else 1 if k < 5 else 2)

    def inputs(self, data: np.ndarray, hashed: list[np.ndarray], whole: np.ndarray, less: int):
        """For each place of a bit in its byte: the bits, the predictions, gates and mixtures of bytes in their contexts; ``less`` tokens of the word itself are taken out of the counts."""
        for k in range(8):
            bit, at = slots(data, hashed, k, self.tables)
            zeros, ones = whole[0, k], whole[1, k]
            x = np.empty((INPUTS, len(bit)), dtype=np.float32)
            if less:
                yes = less * bit.astype(np.float32)
                no = less - yes
                zeros, ones = np.maximum(zeros - no, 0), np.maximum(ones - yes, 0)
                for o, s in enumerate(at):
                    a, b = np.maximum(self.tables.counts[0][s] - no, 0), np.maximum(self.tables.counts[1][s] - yes, 0)
                    x[o] = stretch(a, b)
                    if o == 2:
                        seen = level(a + b)
            else:
                for o, s in enumerate(at):
                    x[o] = self.logits[s]
                seen = self.levels[at[2]]
            x[-1] = stretch(zeros, ones)
            gate = self.gate(level(zeros + ones), seen, k)
            yield bit, x, gate, np.clip(np.einsum("ij,ji->i", self.weights[gate], x), -12, 12)

    def refined(self, gate: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The probability of a one: the mean of the mixture's and the map's."""
        at = (z + 12) / 24 * (STEPS - 1)
        low = np.minimum(at.astype(np.int64), STEPS - 2)
        part = at - low
        flat, low = self.map.reshape(-1), low + gate * STEPS
        mapped = flat[low] * (1 - part) + flat[low + 1] * part
        return np.clip((1 / (1 + np.exp(-z)) + mapped) / 2, 1e-6, 1 - 1e-6)

    def freeze(self) -> "Mixer":
        n = self.tables.counts.shape[1]
        self.logits, self.levels = np.empty(n, dtype=np.float32), np.empty(n, dtype=np.uint8)
        for i in range(0, n, 1 << 18):  # in parts: whole tables of between results are most of a worker's memory
            zeros, ones = self.tables.counts[:, i : i + (1 << 18)]
            self.logits[i : i + (1 << 18)], self.levels[i : i + (1 << 18)] = stretch(zeros, ones), level(zeros + ones)
        return self

    def log10(self, w: Words, whole: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte by its bits."""
        return self.log10_of(w.data, contexts(w), whole)

    def log10_of(self, data: np.ndarray, hashed: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
        chance = np.ones(len(data))  # of eight bits, none below 1e-6
        for bit, _, gate, z in self.inputs(data, hashed, whole, 0):
            p = self.refined(gate, z)
            chance *= np.where(bit, p, 1 - p)
        return np.log10(chance)

    def learn_from(self, into: "Learned", data: np.ndarray, hashed: list[np.ndarray], whole: np.ndarray, each: np.ndarray) -> np.ndarray:
        """Predicts bytes of the given weights, then moves the weights by them; log10 of their probabilities."""
        chance = np.ones(len(data))
        for bit, x, gate, z in self.inputs(data, hashed, whole, 1):
            p = 1 / (1 + np.exp(-z))
            chance *= np.where(bit, p, 1 - p)
            error = each * (bit - p)
            step = np.bincount(gate, weights=each * np.einsum("ij,ij->j", x, x), minlength=N_GATES) / 4
            for o in range(INPUTS):
                self.weights[:, o] += 0.2 * np.bincount(gate, weights=error * x[o], minlength=N_GATES) / (step + 20)
            into.seen[:] += np.bincount(gate, weights=each, minlength=N_GATES)
            place = np.clip(((z + 12) / 24 * (STEPS - 1)).round().astype(np.int64), 0, STEPS - 1)
            flat = (bit.astype(np.int64) * N_GATES + gate) * STEPS + place
            into.mapped[:] += np.bincount(flat, weights=each, minlength=into.mapped.size).reshape(into.mapped.shape)
        return np.log10(chance)


def sent_model(spark: SparkSession, mixer: Mixer, *more: object) -> Callable[[], tuple]:
    """A function that returns the mixer, ready to score, and more on any machine. The tables are sent once, in learning."""
    big = mixer.sent or spark.sparkContext.broadcast(Packed(mixer.tables))
    light = copy.copy(mixer)
    light.tables = light.logits = light.levels = light.sent = None
    small = spark.sparkContext.broadcast((light, *more))

    def get() -> tuple:
        own = small.value[0]
        if own.tables is None:
            own.tables = big.value.tables()
            own.freeze().tables = Tables(own.tables.bits, np.zeros((2, 0), dtype=np.float32))
        return small.value

    return get


class Learned(NamedTuple):
    """Sums of what tasks learned."""

    weights: np.ndarray
    seen: np.ndarray  #: weight of bits by gate
    mapped: np.ndarray
    gains: np.ndarray

    @classmethod
    def none(cls) -> "Learned":
        return cls(np.zeros((N_GATES, INPUTS)), np.zeros(N_GATES), np.zeros((2, N_GATES, STEPS)), np.zeros(len(TRIES)))

    def tobytes(self) -> bytes:
        return b"".join(np.ascontiguousarray(x, dtype=np.float64).tobytes() for x in self)

    @classmethod
    def frombytes(cls, data: bytes) -> "Learned":
        out, at = [], 0
        for x in cls.none():
            out.append(np.frombuffer(data, count=x.size, offset=at).reshape(x.shape))
            at += 8 * x.size
        return cls(*out)

    def __add__(self, other: "Learned") -> "Learned":
        return Learned(*(a + b for a, b in zip(self, other, strict=True)))


def learn_crossings(mixer: Mixer, into: Learned, key: np.ndarray, n: np.ndarray, prefixes: Prefixes, mean: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Learns online from the crossings of a part; the words' first bytes, and the mean log10 of the last one's probability over what stands before."""
    order = np.argsort(mix64(key.astype(U64) + golden(seed)))
    lp = np.zeros(len(key))
    for i in range(0, len(order), RUN):
        for p in range(CROSS):
            own = order[i : i + RUN]
            own = own[key[own] >> 32 == p]
            code = key[own] & 0xFFFFFFFF
            lp[own] = mixer.learn_from(into, *crossing_contexts(code, p), prefixes.whole(code, p), np.minimum(n[own] / mean, HEAVIEST))
    p = key >> 32
    nodes, which = np.unique((key & ((1 << 8 * (p + 1)) - 1)) | p << 32, return_inverse=True)
    return nodes, np.bincount(which, weights=n * lp) / np.bincount(which, weights=n)


def mean_heads(names: list[bytes], nodes: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Of training words, log10 of the probability of their first bytes: means over what stands before them."""
    heads, out = first_bytes(names), np.zeros(len(names))
    if not len(nodes):  # no training words
        return out
    for p, (has, code) in enumerate(crossings(np.zeros(len(heads), dtype=np.int64), heads)):
        at = np.minimum(np.searchsorted(nodes, code | p << 32), len(nodes) - 1)
        out[has] += np.where(nodes[at] == code | p << 32, means[at], 0.0)
    return out


def learn_shard(mixer: Mixer, into: Learned, names: list[bytes], parts: np.ndarray, totals: list[int], edge: Edge, mean: float, seed: int, heads: tuple[np.ndarray, np.ndarray] | None = None) -> None:
    """Learns online from a shard's training words: each run is predicted first, then the weights move; the map's counts and the gains of TRIES come from the predictions. With ``heads``, the means of first bytes from crossings, only from the bytes after those."""
    w, c = Words.of(names), parts.sum(axis=0)
    whole = prefix_counts(w, c.astype(np.float64), edge)
    mine = np.flatnonzero(c > 0)
    mine = mine[np.argsort(mix64(mine.astype(U64) + golden(seed)))]
    lp = np.zeros(len(names)) if heads is None else mean_heads(names, *heads)
    for i, j in runs_of(w.sizes[mine], RUN) if len(mine) else ():
        own = mine[i:j]
        at = np.repeat(w.starts[own] - np.cumsum(w.sizes[own]) + w.sizes[own], w.sizes[own]) + np.arange(int(w.sizes[own].sum()))
        part = Words(w.data[at], np.cumsum(w.sizes[own]) - w.sizes[own], w.sizes[own])
        keep = part.rest(heads is not None)
        of = np.repeat(own, part.sizes)[keep]
        each = np.minimum(c[of] / mean, HEAVIEST)
        score = mixer.learn_from(into, part.data[keep], [x[keep] for x in contexts(part)], whole[:, :, at[keep]], each)
        np.add.at(lp, of, score)
    for n, total in zip(parts, totals, strict=True):
        has = np.flatnonzero(n > 0)
        # A word's own token is no share of it.
        into.gains[:] += [float((n[has] * by_both(lp[has], n[has] - 1.0, total - 1, a)).sum()) for a in TRIES]


def learn(found: DataFrame, scratch: Scratch, totals: list[int], n_words: int, n_bytes: int, n_seen: int, crossing: DataFrame | None = None, prefixes: Prefixes | None = None) -> tuple[Mixer, dict[int, Edge], int]:
    """The model from all training words, the shards' edges and the shard of the empty word: the tables; then weights, learned online by each task over its shards and averaged by what each has seen; the map and the bits' share. Without crossings each word is taken as if nothing stood before it."""
    n, spark = len(totals), found.sparkSession

    @tidy
    def edge_rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, parts = unpacked(row, n)
                ahead, behind, through = _paths(Words.of(names), parts.sum(axis=0).astype(np.float64))
                yield batch_of(_EDGE, ([row["shard"]], [names[0]], [names[-1]], [ahead], [behind], [through]))

    found = found.select("shard", "words", "parts")
    rows = found.mapInArrow(edge_rows, "shard int, first binary, last binary, ahead array<double>, behind array<double>, through int").toArrow()
    rows = sorted(rows.to_pylist(), key=lambda r: r["shard"])  # one for each SHARD words, of a word's length
    ends, home = edges(rows), next((r["shard"] for r in rows if r["last"] + b" " >= b" "), 0)
    mixer = Mixer(gather_tables(found, n, n_words, n_bytes, scratch, crossing))
    mean = max(1e-9, sum(totals) / max(1, n_seen))
    mixer.sent = tables = spark.sparkContext.broadcast(Packed(mixer.tables))
    total, heads = Learned.none(), None
    if crossing is not None:
        with_prefixes = spark.sparkContext.broadcast(prefixes)

        @tidy
        def cross(batches):
            prefixes, own, into, found = with_prefixes.value, Mixer(tables.value.tables()), Learned.none(), []
            for batch in batches:
                for row in batch.to_pylist():
                    key, tokens = unpacked_crossings(row["payload"])
                    found.append(learn_crossings(own, into, key, tokens, prefixes, mean, row["part"]))
            nodes, means = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0))
            yield batch_of(_MEAN, ([into._replace(weights=own.weights * into.seen[:, None]).tobytes()], [nodes.tobytes()], [means.tobytes()]))

        rows = crossing.mapInArrow(cross, "data binary, nodes binary, means binary").collect()  # a node for each start of words of CROSS bytes
        nodes, means = np.concatenate([np.frombuffer(r.nodes, dtype=np.int64) for r in rows] or [np.zeros(0, dtype=np.int64)]), np.concatenate([np.frombuffer(r.means) for r in rows] or [np.zeros(0)])
        order = np.argsort(nodes)
        heads = (nodes[order], means[order])
        for row in rows:
            total += Learned.frombytes(row.data)
        with_prefixes.destroy()
    sent = spark.sparkContext.broadcast((ends, heads))

    @tidy
    def run(batches):
        ends, heads = sent.value
        own, into = Mixer(tables.value.tables()), Learned.none()
        for batch in batches:
            for row in batch.to_pylist():
                names, parts = unpacked(row, n)
                learn_shard(own, into, names, parts, totals, ends[row["shard"]], mean, row["shard"], heads)
        yield batch_of(_SUMS, ([into._replace(weights=own.weights * into.seen[:, None]).tobytes()],))

    for row in found.mapInArrow(run, "data binary").collect():  # one small row a task
        total += Learned.frombytes(row.data)
    sent.destroy()
    some = total.seen > 0
    mixer.weights[some] = total.weights[some] / total.seen[some, None]
    mixer.map = (total.mapped[1] + 30 * mixer.map) / (total.mapped.sum(axis=0) + 30)
    mixer.by_bits = float(TRIES[np.argmax(total.gains)])
    return mixer, ends, home


def word_scores(found: DataFrame, mixer: Mixer, ends: dict[int, Edge], columns: list[str]) -> DataFrame:
    """word, the named counts and lp, log10 of the word's probability by its bits."""
    model = sent_model(found.sparkSession, mixer, ends)
    schema = pa.schema([("word", pa.binary()), *[(x, pa.int64()) for x in columns], ("lp", pa.float32())])

    @tidy
    def score(batches):
        mixer, ends = model()
        for batch in batches:
            for row in batch.to_pylist():
                names, parts = unpacked(row, len(columns))
                yield batch_of(schema, (names, *parts, _shard_scores(mixer, names, parts, ends[row["shard"]], False)))

    return found.mapInArrow(score, ", ".join(["word binary", *[f"{x} bigint" for x in columns], "lp float"]))


def _shard_scores(mixer: Mixer, names: list[bytes], parts: np.ndarray, edge: Edge, crossing: bool) -> np.ndarray:
    """log10 of the probability of each word by its bits, or of its bytes without those that crossings tell."""
    w, out = Words.of(names), np.zeros(len(names), dtype=np.float32)
    whole = prefix_counts(w, parts.sum(axis=0).astype(np.float64), edge)
    for i, j in runs_of(w.sizes, 150_000):
        part = Words.of(names[i:j])
        keep = part.rest(crossing)
        of = np.repeat(np.arange(j - i), part.sizes)[keep]
        lp = mixer.log10_of(part.data[keep], [x[keep] for x in contexts(part)], whole[:, :, w.starts[i] + keep])
        out[i:j] = np.bincount(of, weights=lp, minlength=j - i)
    return out


def answers(found: DataFrame, model: Callable[[], tuple], n_columns: int) -> DataFrame:
    """For each shard and block that asks for some of its words one row: their idx, log10 of the probability of the bytes after the first, and the counts (``unpacked_answers``)."""

    @tidy
    def score(batches):
        mixer, ends, _ = model()
        for batch in batches:
            for row in batch.to_pylist():
                names, parts = unpacked(row, n_columns)
                lp = _shard_scores(mixer, names, parts, ends[row["shard"]], True)
                data = zstandard.decompress(row["asks"])
                n = len(data) // 24
                block, idx, word = (from_planes(data, np.int64, n, 8 * n * i) for i in range(3))
                first = np.flatnonzero(np.diff(block, prepend=-1))
                for i, j in zip(first.tolist(), [*first[1:].tolist(), n][: len(first)], strict=True):
                    own = word[i:j]
                    packed = planes(idx[i:j].astype(np.uint32)) + planes(lp[own]) + b"".join(planes(np.ascontiguousarray(x[own])) for x in parts)
                    yield batch_of(_ANSWER, ([int(block[i])], [zstandard.compress(packed, 1)]))

    return found.mapInArrow(score, "block bigint, data binary")


def unpacked_answers(data: bytes, n_columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idx, log10 and counts (columns, words)."""
    data = zstandard.decompress(data)
    n = len(data) // (8 + 8 * n_columns)
    counts = np.stack([from_planes(data, np.int64, n, 8 * n * (i + 1)) for i in range(n_columns)])
    return from_planes(data, np.uint32, n).astype(np.int64), from_planes(data, np.float32, n, 4 * n), counts
