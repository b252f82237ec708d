"""Packing of documents into windows of tokens by non-negative least squares.

A document's ids are cut every ``window`` ids; full pieces are sequences of
their own. The lengths of the rests make a histogram of at most window - 1
entries, whatever the corpus. On the driver, combinations of two to four
lengths that fill a window are enumerated, non-negative least squares solves
how often to use each to meet the histogram, the solution is rounded down, and
the residual counts are packed greedily, the longest rest first with the
longest that still fits. The plan is a table of (length, from rank, sequence)
runs; each rest finds its place by its rank among the rests of its length.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_of, passes, tidy

WINDOW = 2048
END_ID = 1
#: Bytes, about, of the words whose ids a worker keeps; the store starts anew beyond it.
KEEP_BYTES = 40 << 20
#: Strings of the tokenizer's special tokens begin so; a text with one goes to the tokenizer as a whole.
SPECIAL = b"<|"
LETTERS_THEN_ASCII = re.compile(r"([^\W\d_]+)[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]")
_PIECES = pa.schema([("task", pa.int64()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECES = "task bigint, rank bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class WordIds(dict):
    """The ids of a word as little-endian 32-bit integers, made when first asked for.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its parts between spaces, one after another; a run of letters
    before an ASCII sign is a part of its own. A part of Latin letters is
    merged by tiktoken's faster loop over the same ranks: a byte that ends a word
    gets a byte value that no lower-case UTF-8 letter uses. All other parts go
    to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        inside = [*range(97, 123), *range(0x80, 0xC0), *range(0xC2, 0xF5)]
        final = [*range(97, 123), *range(0x80, 0xC0)]
        free = [x for x in range(256) if x not in set(inside)]
        self.final = dict(zip(final, free, strict=False))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of_char = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(printable))}
        ranks: dict[bytes, int] = {}
        for token, n in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends = token.endswith("</w>")
            raw = [of_char.get(c, -1) for c in (token[:-4] if ends else token)]
            if raw and all(x in inside for x in raw) and (not ends or raw[-1] in self.final):
                ranks[bytes(raw[:-1] + [self.final[raw[-1]] if ends else raw[-1]])] = n
        top = max(ranks.values(), default=0)
        for x in range(256):
            if bytes([x]) not in ranks:
                ranks[bytes([x])] = top = top + 1
        self.merge = tiktoken.Encoding("parts", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            low = word.lower()
            if low.isalpha() and max(low) < "\u0250":
                raw = low.encode()
                ids = array("I", self.merge(raw[:-1] + bytes((self.final[raw[-1]],)))).tobytes()
            else:
                ids = self.whole(word)
        elif (m := LETTERS_THEN_ASCII.match(word)) and m[1].lower().isalpha():
            ids = self[m[1]] + self[word[m.end(1) :]]
        else:
            ids = self.whole(word)
        self[word] = ids
        self.held += 2 * len(word) + len(ids) + 190
        return ids

    def whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def text(self, text: bytes) -> bytes:
        if SPECIAL in text:
            return self.whole(text.decode("utf-8", "replace"))
        if self.held > KEEP_BYTES:
            self.clear()
            self.held = 0
        return b"".join(map(self.__getitem__, text.lower().decode("utf-8", "replace").replace("\n", " ").split(" ")))


@functools.cache
def word_ids(path: str) -> WordIds:
    """One store for a worker's tasks."""
    return WordIds(path)


def cutter(path: str, window: int, end: int):
    """The pieces of each document; rests get a rank among those of their length in this task."""
    last = np.array([end], dtype="<u4").tobytes()

    @tidy
    def cut(batches):
        from pyspark import TaskContext

        task, ids, seen = TaskContext.get().partitionId(), word_ids(path), Counter()
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for first, texts in passes(batch):
                out = []
                for i, text in enumerate(texts):
                    data = ids.text(text) + last
                    n = len(data) // 4
                    for start in range(0, n, window):
                        part = data[4 * start : 4 * (start + window)]
                        length = len(part) // 4
                        out.append((task, seen[length], docs[first + i], start, length, zlib.crc32(part), n))
                        seen[length] += 1
                yield batch_of(_PIECES, zip(*out, strict=True))

    return cut


def patterns(lengths: np.ndarray, window: int, most: int = 4000) -> list[tuple[int, ...]]:
    """Shallow combinations of up to four present lengths that fill a window, or nearly."""
    have = set(lengths.tolist())
    out: dict[tuple[int, ...], None] = {}
    down = sorted(have, reverse=True)

    def best(limit: int) -> int:
        i = int(np.searchsorted(lengths, limit, side="right"))
        return int(lengths[i - 1]) if i else 0

    for a in down:
        if b := best(window - a):
            out[tuple(sorted((a, b), reverse=True))] = None
            if c := best(window - a - b):
                out[tuple(sorted((a, b, c), reverse=True))] = None
        half = best((window - a) // 2)
        if half and (c := best(window - a - half)):
            out[tuple(sorted((a, half, c), reverse=True))] = None
            if d := best(window - a - half - c):
                out[tuple(sorted((a, half, c, d), reverse=True))] = None
        third = best((window - a) // 3)
        if third and (d := best(window - a - 2 * third)):
            out[tuple(sorted((a, third, third, d), reverse=True))] = None
    return sorted(out, key=lambda p: (window - sum(p), len(p), p))[:most]


def solve(columns: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that minimises |A x - counts|, A's columns counting a pattern's lengths: projected gradient with momentum."""
    if not columns:
        return np.zeros(0)
    row = {int(n): i for i, n in enumerate(lengths)}
    at = [(row[n], j) for j, p in enumerate(columns) for n in p]
    i, j = np.array([a for a, _ in at]), np.array([b for _, b in at])
    a_x = lambda x: np.bincount(i, weights=x[j], minlength=len(lengths))
    a_t = lambda r: np.bincount(j, weights=r[i], minlength=len(columns))
    v = np.ones(len(columns))
    for _ in range(20):
        v = a_t(a_x(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(a_t(a_x(v))))
    x = z = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * a_t(a_x(z) - counts))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, repeats, first sequence, offset): rest number first rank + k goes to sequence first + k."""
    left = Counter({int(n): int(c) for n, c in histogram.items() if c > 0 and n < window})
    used: Counter[int] = Counter()
    runs, sequence = [], 0

    def emit(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        offset = 0
        for n in pattern:
            runs.append((n, used[n], times, sequence, offset))
            used[n] += times
            left[n] -= times
            offset += n
        sequence += times

    lengths = np.array(sorted(left), dtype=np.int64)
    if len(lengths):
        columns = [p for p in patterns(lengths, window) if window - sum(p) <= window // 64]
        x = solve(columns, lengths, np.array([left[int(n)] for n in lengths], dtype=float))
        for p, times in sorted(zip(columns, np.floor(x + 1e-9).astype(int).tolist(), strict=True), key=lambda c: (window - sum(c[0]), c[0])):
            times = min([times, *(left[n] // k for n, k in Counter(p).items())])
            if times > 0:
                emit(p, times)
    while down := sorted((n for n, c in left.items() if c > 0), reverse=True):
        ascending = down[::-1]
        own: Counter[int] = Counter()
        pattern: list[int] = []
        room = window
        for _ in range(window):
            i = int(np.searchsorted(ascending, room, side="right")) - 1
            while i >= 0 and left[ascending[i]] - own[ascending[i]] <= 0:
                i -= 1
            if i < 0:
                break
            pattern.append(ascending[i])
            own[ascending[i]] += 1
            room -= ascending[i]
        emit(tuple(pattern), min(left[n] // k for n, k in own.items()))
    return runs


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with the id ``end``; a null or empty text is that id
    alone. The strings of special tokens are those tokens, as the tokenizer's
    file has it. Bytes that are no UTF-8 count as replacement characters.
    Repeated and null doc_ids are documents of their own. Sequences hold
    at most ``window`` ids without gaps from offset 0. An empty table gives an
    empty one. ``path`` names the tokenizer's file on every executor.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = scratch.save("pieces", docs.mapInArrow(cutter(path, window, end), PIECES))
    counts = scratch.save("counts", pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # window rows at most
    runs = plan(totals, window)
    planned = max((s + k for _, _, k, s, _ in runs), default=0)
    whole = (window, 0, totals.get(window, 0), planned, 0)
    schema = "length bigint, first bigint, times bigint, first_sequence bigint, offset bigint"
    table = spark.createDataFrame([*runs, whole], schema)
    # Ranks of one task's rests follow those of the tasks before it.
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("before", F.lit(0)).alias("before"), "n")
    # A run that spans tasks is met by each; few runs and tasks share a length.
    placed = before.join(table, "length").where((F.col("first") < F.col("before") + F.col("n")) & (F.col("before") < F.col("first") + F.col("times")))
    placed = placed.groupBy("length", "task", "before").agg(F.sort_array(F.collect_list(F.struct("first", "times", "first_sequence", "offset"))).alias("runs"))
    ranked = pieces.join(placed, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    run = F.try_element_at(F.filter("runs", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["times"])), F.lit(1))
    return ranked.withColumn("run", run).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("run.first_sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"), F.col("run.offset").alias("offset"))
