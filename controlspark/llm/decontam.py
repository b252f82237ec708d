"""Benchmark decontamination by a Wu-Manber search over words.

The alphabet is a text's sequence of words. A window is ``WINDOW`` consecutive
words of an item (an item of fewer words is one window). All windows of one
length m are searched together: a shift table says for a block of two words how
far the search may jump, blocks that end a window lead to a bucket of test
strings by a hash of the window's last words, and the words themselves are
compared before an occurrence counts. The documents of a pass take their jumps
together, one numpy step for all. Items are searched in slices of bounded size,
whose tables are broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, integers, passes, prepare, tidy, with_row_keys
from .textscan import ALNUM, U64, mix64, words

WINDOW = 13
#: Items are searched in slices of about so many bytes, a pass over the documents each. A slice's tables take some 40 times its size.
SLICE_BYTES = 4 << 20
_HITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
HITS = "row bigint, doc_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


class Matcher:
    """The distinct windows of m words: a row of word numbers each, in the order of their suffixes' hashes."""

    def __init__(self, windows: np.ndarray, of: np.ndarray, hashes: np.ndarray):
        """windows: the windows' word numbers; of: the number of each one's item; hashes: of the words."""
        self.m = windows.shape[1]
        self.block = min(2, self.m)
        rows, inverse = np.unique(windows, axis=0, return_inverse=True)
        key = self.suffix(hashes[rows].reshape(-1), np.arange(len(rows)) * self.m)
        order = np.argsort(key, kind="stable")
        self.keys, self.rows = key[order], rows[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack((place[inverse.reshape(-1)], of)), axis=1)  # (window, item)
        self.items, self.bounds = pairs[1], np.searchsorted(pairs[0], np.arange(len(rows) + 1))
        # A collision in the shift table only shortens a jump.
        self.size = 1 << int(np.clip(int(4 * rows.size).bit_length(), 12, 22))
        self.shift = np.full(self.size, self.m - self.block + 1, dtype=np.int8 if self.m < 100 else np.int64)
        for j in range(self.m - self.block + 1):
            np.minimum.at(self.shift, self.codes(hashes[rows[:, j]], hashes[rows[:, j + self.block - 1]]), self.m - self.block - j)

    def codes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (mix64(first * U64(3) + last) & U64(self.size - 1)).astype(np.int64)

    def suffix(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A hash of a window's last four words, or all of fewer."""
        total = np.zeros(len(at), dtype=U64)
        for i in range(max(0, self.m - 4), self.m):
            total = mix64(total + h[at + i])
        return total

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in all texts' words whose window's block and suffix fit test strings, and the range of those strings."""
        none = np.empty(0, dtype=np.int64)
        if len(h) < self.m or not len(self.keys):
            return none, none, none
        jump = self.shift[self.codes(h[: len(h) - self.block + 1], h[self.block - 1 :])]
        at, end = bounds[:-1].astype(np.int64), bounds[1:] - self.m
        found = []
        while True:
            on = at <= end
            if not on.all():
                at, end = at[on], end[on]
            if not len(at):
                break
            step = jump[at + self.m - self.block]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
        at = np.concatenate(found) if found else none
        key = self.suffix(h, at)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        fit = low < high
        return at[fit], low[fit], high[fit]


class Slice:
    """The matchers of some items, one for each length of window, the items' ids and their distinct words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [i for i, _ in items]
        w = words([t for _, t in items], ALNUM)
        own = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
        number = {x: i for i, x in enumerate(dict.fromkeys(own))}
        self.words = list(number)
        numbers = np.array([number[x] for x in own], dtype=np.int32)
        hashes = np.empty(len(number), dtype=U64)
        hashes[numbers] = w.hashes
        lengths = np.diff(w.bounds)
        self.matchers = []
        for m in sorted(set(np.minimum(lengths[lengths > 0], window).tolist())):
            which = np.flatnonzero((lengths == m) if m < window else (lengths >= m))
            starts = np.concatenate([np.arange(w.bounds[i], w.bounds[i + 1] - m + 1) for i in which])
            of = np.repeat(which, lengths[which] - m + 1)
            self.matchers.append(Matcher(numbers[starts[:, None] + np.arange(m)], of, hashes))

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: the number of its words, the disjoint spans inside occurrences, and the items' ids."""
        w = words(texts, ALNUM)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[int]] = defaultdict(set)
        for matcher in self.matchers:
            for p, low, high in zip(*(x.tolist() for x in matcher.candidates(w.hashes, w.bounds)), strict=True):
                own = [w.data[w.starts[p + i] : w.ends[p + i]].tobytes() for i in range(matcher.m)]
                for k in range(low, high):
                    if all(self.words[x] == y for x, y in zip(matcher.rows[k].tolist(), own, strict=True)):
                        i = int(np.searchsorted(w.bounds, p, side="right")) - 1
                        first = p - int(w.bounds[i])
                        spans[i].append((first, first + matcher.m))
                        items[i].update(matcher.items[matcher.bounds[k] : matcher.bounds[k + 1]].tolist())
        counts = np.diff(w.bounds).tolist()
        return [(n, merged(spans.get(i, [])), sorted({self.ids[x] for x in items.get(i, ())})) for i, n in enumerate(counts)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the same words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def slices(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in runs of at most about ``limit`` bytes (an item is not cut); the driver holds a run or two at a time."""
    run, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null").toLocalIterator():
        if run and size + len(row.text) > limit:
            yield run
            run, size = [], 0
        run.append((row.item_id, bytes(row.text)))
        size += len(row.text)
    if run:
        yield run


def _search(rows: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    """HITS of rows (row, doc_id, text) for one slice of items."""
    tables = rows.sparkSession.sparkContext.broadcast(Slice(items, window))

    @tidy
    def search(batches):
        own = tables.value
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), integers(batch, "row")
            for first, texts in passes(batch):
                out = [(keys[first + i], ids[first + i], n, [a for a, _ in s], [b for _, b in s], found) for i, (n, s, found) in enumerate(own.find(texts))]
                yield batch_of(_HITS, zip(*out, strict=True))

    return rows.select("row", "doc_id", "text").mapInArrow(search, HITS)


@tidy
def _merge(batches):
    """Joins the slices' findings of a row: (row, doc_id, n_words, lists of starts, ends and items)."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            spans = merged([x for a, b in zip(r["starts"], r["ends"], strict=True) for x in zip(a, b, strict=True)])
            out.append((r["row"], r["doc_id"], r["n_words"], [a for a, _ in spans], [b for _, b in spans], sorted({x for own in r["items"] for x in own})))
        if out:
            yield batch_of(_HITS, zip(*out, strict=True))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, the disjoint word spans [starts, ends) inside occurring windows, and items.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased.
    Null texts have no words. Items that are null or have no word are ignored;
    rows that repeat an item_id are one item with all their windows. Repeated
    or null doc_ids keep a row each. With a benchmark of more than
    ``slice_bytes`` the documents are read once a slice, and the slices'
    findings, written one after another, are merged by row; the result is the
    same.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    runs = slices(benchmark, slice_bytes)
    first, second = next(runs, []), next(runs, None)
    if second is None:
        return _search(docs.withColumn("row", F.lit(0).cast("bigint")), first, window).drop("row")
    scratch = Scratch(spark, "benchmark")
    rows = with_row_keys(docs, scratch).withColumnRenamed("__row", "row")
    found = scratch.save("slice_0", _search(rows, first, window))
    k = 1
    while second is not None:
        found = found.unionByName(scratch.save(f"slice_{k}", _search(rows, second, window).where("size(items) > 0")))
        second, k = next(runs, None), k + 1
    lists = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *[F.collect_list(x).alias(x) for x in ("starts", "ends", "items")])
    return lists.mapInArrow(_merge, HITS).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a twentieth of the words or more are hit) of each row.

    Nulls, empty texts, repeated ids and large benchmarks are as ``benchmark_hits`` says; an empty table gives an empty one.
    """
    hits = benchmark_hits(docs, benchmark, window, slice_bytes)
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
