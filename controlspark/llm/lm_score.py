"""Language-model scores: logistic context mixing over bits, languages and repeated passages.

A text is a sequence of words and an end (an empty word). A word's probability
mixes that by its bits (``lm_bits``) with its share of the training tokens. There
is such a share for each frequent language of the training rows, and each gives
a model of whole texts. A language's weight starts as its share of the tokens
and follows the text, as the language has predicted it so far.

What crosses words: a text is cut into chunks after words that a hash chooses,
one in 16. A chunk is predicted by its words or as a copy of a chunk of another
training text, by its share of all training chunks. The chance of a copy follows
the text: it is small at first and after a chunk that is none, and large after
one that is. Chunks are told apart by 64-bit hashes.

A chunk ends where its last word says so, so each mixture sums to one over all
texts. The contexts of bits are those of the running text: a word's first bytes
and a text's end are predicted from the bytes of the word before, too. What no
longer depends on it, the bytes after, is computed once for each distinct word.

Documents are cut into blocks. The rows by which blocks ask for their distinct
words are sorted into the vocabulary once, are counted there, and get counts and
log probabilities back; the first bytes are scored in the block, by tables of a
bounded size. Chunks are counted by a join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, part_passes, release, tidy
from .lang_id import fold
from .lm_bits import BEFORE_ALL, CROSS, LN10, Mixer, Prefixes, answers, by_both, crossing_contexts, crossing_rows, crossings_at, first_of, from_planes, last_of, learn, merged_crossings, planes, sent_model, shards, unpacked_answers
from .textscan import GOLDEN, U64, mix64, words

#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
#: A word in so many ends a chunk.
CHUNK = 16
#: The chance of a copy after a chunk that is none, and after one that is.
ENTER, STAY = 0.01, 0.95
#: Languages with shares of their own, at most: those of the most training rows.
CLASSES = 6
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def counters(k: int) -> list[str]:
    """Names of the token counts: of rows in no named language, then of each named one."""
    return [f"n{i}" for i in range(k + 1)]


def chunks(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents given by their words' hashes: the number of chunks of each, the words of each chunk, and the chunks' keys.

    A document's last chunk holds its end, and perhaps no word.
    """
    ends_chunk = ((hashes >> U64(40)) % U64(CHUNK)) == 0
    before = np.concatenate(([0], np.cumsum(ends_chunk)))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    per_doc = before[bounds[1:]] - before[bounds[:-1]] + 1
    last = np.cumsum(per_doc) - 1
    stop = np.empty(int(per_doc.sum()), dtype=np.int64)  # each chunk's end among the words
    inner = np.ones(len(stop), dtype=bool)
    inner[last] = False
    stop[last] = bounds[1:]
    stop[inner] = np.flatnonzero(ends_chunk) + 1
    start = np.concatenate(([0], stop[:-1]))
    sizes = stop - start
    place = np.arange(len(hashes)) - np.repeat(start, sizes)
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(mix64(hashes + place.astype(U64) * GOLDEN), out=total[1:])
    key = total[stop] - total[start] + sizes.astype(U64) * GOLDEN
    key[last] ^= U64(0x5851F42D4C957F2D)
    return per_doc, sizes, mix64(key)


def _block(block: int, docs: list[tuple], runs: list, k: int) -> pa.RecordBatch:
    """The distinct words and chunks of a block with their training counts, and its documents as indices of them."""
    hashes = np.concatenate([w.hashes for _, w in runs])
    own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    data = np.concatenate([w.data for _, w in runs])
    offsets = np.cumsum([0] + [len(w.data) for _, w in runs]).tolist()
    start, end = (np.concatenate([x + at for x, at in zip(places, offsets, strict=False)])[first] for places in zip(*((w.starts, w.ends) for _, w in runs), strict=True))
    names = spans(data, start, end)
    lengths = np.zeros(len(docs), dtype=np.int64)
    for of, w in runs:
        np.add.at(lengths, of, np.diff(w.bounds))
    classes = np.array([-1 if held else c for _, held, _, c in docs])
    per_word = np.repeat(classes, lengths)
    counts = [np.bincount(inverse[per_word == c], minlength=len(own)) for c in range(k + 1)]
    rank = np.empty(len(own), dtype=np.uint32)
    rank[np.argsort(-np.bincount(inverse, minlength=len(own)), kind="stable")] = np.arange(len(own), dtype=np.uint32)
    per_doc, sizes, key = chunks(hashes, lengths)
    keys, which = np.unique(key, return_inverse=True)
    trains = np.repeat(classes >= 0, per_doc)
    in_train = np.bincount(which[trains], minlength=len(keys))
    in_held = np.bincount(which[~trains], minlength=len(keys)) > 0
    ids = rank[inverse]
    heads, tails = np.empty((2, len(own)), dtype=np.int64)
    heads[rank], tails[rank] = first_of(data, start, end), last_of(data, start, end)
    before, starts = running(ids, lengths, heads, tails)
    learned = crossing_rows(*(np.concatenate(x) for x in zip((before[0][per_word >= 0], starts[0][per_word >= 0]), (before[1][classes >= 0], starts[1][classes >= 0]), strict=True)))
    head = np.array([(d if d is not None else 0, d is None, held, size, n, m) for (d, held, size, _), n, m in zip(docs, lengths.tolist(), per_doc.tolist(), strict=True)], dtype=np.int64)
    payload = b"".join(np.ascontiguousarray(x).tobytes() for x in (np.array([len(docs), len(inverse), len(sizes), len(own)], dtype=np.int64), head))
    payload += planes(ids) + b"".join(planes(x.astype(np.uint32)) for x in (heads, tails, sizes, which))
    n, m, q = len(own), len(keys), len(learned)
    schema = pa.schema([("block", pa.int64()), ("idx", pa.int32()), ("word", pa.binary()), ("key", pa.int64()), ("held", pa.bool_()), *[(x, pa.int64()) for x in counters(k)], ("part", pa.int32()), ("payload", pa.binary())])
    # Of each column what words, chunks, crossings and the payload have; a number stands for so many nulls.
    columns = [[np.full(n + m + q + 1, block)], [rank.astype(np.int32), np.arange(m, dtype=np.int32), q + 1], [names, m + q + 1], [n, keys.view(np.int64), q + 1], [n, in_held, q + 1]]
    columns += [[c, in_train if i == 0 else m, q + 1] for i, c in enumerate(counts)]
    columns += [[n + m, [x for x, _ in learned], 1], [n + m, [x for _, x in learned], [zstandard.compress(payload, 1)]]]
    part = lambda x, kind: x if isinstance(x, pa.Array) else pa.nulls(x, kind) if isinstance(x, int) else pa.array(x, kind)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([part(x, f.type) for x in c]) for c, f in zip(columns, schema, strict=True)], schema=schema)


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from each start to its end."""
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    own = data[np.repeat(starts - bounds[:-1], ends - starts) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(own)])


def running(ids: np.ndarray, lengths: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of documents in a row, for their words and for their ends: the last bytes before each, and its first ones."""
    stops = np.cumsum(lengths)
    before = np.full(len(ids) + 1, BEFORE_ALL)
    before[1:] = tails[ids]
    ends = np.where(lengths > 0, before[stops], BEFORE_ALL)
    before = before[:-1]
    before[(stops - lengths)[lengths > 0]] = BEFORE_ALL
    return (before, ends), (heads[ids], np.full(len(ends), BEFORE_ALL))


def crossing_scores(mixer: Mixer, prefixes: Prefixes, before: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """log10 of the probability of the first bytes of words after what stands before them."""
    out = np.zeros(len(heads))
    for p in range(CROSS):
        has, code = crossings_at(before, heads, p)
        coded = pa.array(code).dictionary_encode()
        own = coded.dictionary.to_numpy()
        lp = np.concatenate([mixer.log10_of(*crossing_contexts(x, p), prefixes.whole(x, p)) for x in np.array_split(own, max(1, len(own) // 100_000))])
        out[has] += lp[coded.indices.to_numpy()]
    return out


@tidy
def _blocks(batches, k: int):
    from pyspark import TaskContext

    block, docs, runs, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        ids, held, own = (batch.column(x).to_pylist() for x in ("doc_id", "held_out", "class"))
        texts, base = as_bytes(batch.column("text")), len(docs)
        docs += [(ids[i], held[i], len(t), own[i]) for i, t in enumerate(texts)]
        for of, parts in part_passes(texts):
            runs.append((of + base, words(parts)))
            size += sum(map(len, parts))
        if size >= BLOCK_BYTES:
            yield _block(block, docs, runs, k)
            block, docs, runs, size = block + 1, [], [], 0
    if docs:
        yield _block(block, docs, runs, k)


def chained(by_words: np.ndarray, as_copy: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """log10 of each document's probability under each language: by_words (chunks, languages), as_copy (chunks), chunks of each document in a row."""
    first = np.cumsum(per_doc) - per_doc
    total = np.add.reduceat(by_words + np.log10(1 - ENTER), first, axis=0)
    some = np.flatnonzero(np.add.reduceat(np.isfinite(as_copy), first))  # elsewhere the chance of a copy stays as it is
    some = some[np.argsort(-per_doc[some], kind="stable")]
    sums, chance = np.zeros((len(some), by_words.shape[1])), np.full((len(some), by_words.shape[1]), ENTER)
    for t in range(int(per_doc[some].max()) if len(some) else 0):
        live = int(np.searchsorted(-per_doc[some], -t, side="left"))  # documents of more than t chunks
        at = first[some[:live]] + t
        new, old = np.log(1 - chance[:live]) + by_words[at] * LN10, np.log(chance[:live]) + as_copy[at][:, None] * LN10
        both = np.logaddexp(new, old)
        sums[:live] += both / LN10
        was = np.exp(old - both)
        chance[:live] = was * STAY + (1 - was) * ENTER
    total[some] = sums
    return total


def _block_scores(totals: list[int], ends: list[int], n_types: int, n_chunks: int, model: Callable[[], tuple]):
    n_train, k = sum(totals), len(totals)
    prior = np.log10((np.array(totals) + 1) / (n_train + k))
    rate = lambda c: np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1)))

    def score(table: pa.Table) -> pa.Table:
        mixer, _, prefixes = model()
        data = zstandard.decompress(next(x for x in table["payload"].to_pylist() if x is not None))
        n, n_words, m, n_own = (int(x) for x in np.frombuffer(data, dtype=np.int64, count=4))
        at = 32
        head = np.frombuffer(data, dtype=np.int64, count=6 * n, offset=at).reshape(n, 6)
        at += 48 * n
        ids = from_planes(data, np.uint32, n_words, at)
        at += 4 * n_words
        heads, tails = (from_planes(data, np.uint32, n_own, at + 4 * n_own * i).astype(np.int64) for i in range(2))
        at += 8 * n_own
        sizes, which = (from_planes(data, np.uint32, m, at + 4 * m * i).astype(np.int64) for i in range(2))
        rest, parts = np.empty(n_own), np.empty((k, n_own), dtype=np.int64)
        for x in table["data"].to_pylist():
            if x is not None:
                of, lp, counts = unpacked_answers(x, k)
                rest[of], parts[:, of] = lp, counts
        idx = table["idx"].to_numpy()
        lengths, per_doc, held = head[:, 4], head[:, 5], head[:, 2] > 0
        stops, doc_stops, last = np.cumsum(sizes), np.cumsum(lengths), np.cumsum(per_doc) - 1
        lp = crossing_scores(mixer, prefixes, *(np.concatenate(x) for x in running(ids, lengths, heads, tails)))
        lp, lp_end = lp[:n_words] + rest[ids], lp[n_words:]

        def sums(x: np.ndarray, stops: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0.0], np.cumsum(x)))[np.concatenate(([0], stops))]
            return np.diff(total)

        def within(x: np.ndarray, stops: np.ndarray) -> np.ndarray:
            return sums(x[ids], stops)

        by_words = np.empty((m, k))
        bits, chance = lp + np.log10(mixer.by_bits), mixer.by_bits * np.power(10.0, lp)  # the power may be 0: a share is not
        for i, (c, total, end) in enumerate(zip(parts, totals, ends, strict=True)):
            has = np.flatnonzero(c[ids] > 0)
            each = bits.copy()
            each[has] = np.log10(chance[has] + (1 - mixer.by_bits) / max(1, total) * c[ids[has]])
            by_words[:, i] = sums(each, stops)
            by_words[last, i] += by_both(lp_end, np.full(n, float(end)), total, mixer.by_bits)
        # Training chunks of other documents.
        counts = np.zeros(int(which.max()) + 1)
        shared = np.flatnonzero(~np.isnan(table["shared"].to_numpy().astype(np.float64)))
        counts[idx[shared].astype(np.int64)] = table["shared"].to_numpy()[shared]
        pair = np.repeat(np.arange(n), per_doc) * len(counts) + which
        _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
        others = np.maximum(counts[which] - np.where(np.repeat(held, per_doc), 0, times[inverse]), 0)
        with np.errstate(divide="ignore"):
            as_copy = np.log10(others / max(1, n_chunks))
        by = chained(by_words, as_copy, per_doc) + prior
        best = by.max(axis=1)
        value = best + np.log10(np.power(10.0, by - best[:, None]).sum(axis=1))
        c = parts.sum(axis=0)
        return pa.table(
            [
                pa.array([None if none else d for d, none in head[:, :2].tolist()], pa.int64()),
                pa.array(held),
                pa.array(lengths + 1),
                pa.array(np.rint(within((c > 0).astype(np.float64), doc_stops)).astype(np.int64) + int(sum(ends) > 0)),
                pa.array(np.full(n, n_train)),
                pa.array(within(rate(c), doc_stops) + rate(sum(ends))),
                pa.array(value),
                pa.array(-value / np.log10(2) / (head[:, 3] + 1)),
            ],
            schema=_OUT,
        )

    def scored(table: pa.Table) -> pa.Table:
        try:
            return score(table)
        finally:
            release()

    return scored


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row.

    Tokens are runs of anything but ASCII white space, A-Z lower-cased, and an
    end. Learns from rows outside the held-out fold (remainder 1); their lang,
    where there is one, names the shares, and no row's own lang is an input of
    its score. A training row's own chunks do not count for it. A null or
    empty text is an end alone. Repeated doc_ids keep a row each; a null doc_id
    is not held out. Without training rows N and V are 0 and every context is
    new. An empty table gives an empty one. A text is never cut: one longer
    than BLOCK_BYTES is a block of its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held = F.coalesce(fold() == 1, F.lit(False))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), lang.cast("string").alias("lang"), "text")
    train = docs.where("not held_out")
    langs = sorted(r.lang for r in train.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES).collect())
    k = len(langs)
    own = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i + 1)) for i, x in enumerate(langs)], F.lit(0))
    ends = [0] * (k + 1)
    for r in train.groupBy(own.alias("class")).count().collect():
        ends[r["class"]] = r["count"]
    columns = counters(k)
    parts = ", ".join(f"{x} bigint" for x in columns)
    rows = scratch.save("blocks", docs.select("doc_id", "held_out", own.alias("class"), "text").mapInArrow(lambda b: _blocks(b, k), f"block bigint, idx int, word binary, key bigint, held boolean, {parts}, part int, payload binary"))
    asked, cut = rows.where("word is not null"), rows.where("key is not null").select("block", "idx", "key", "held", "n0")
    end = spark.createDataFrame([(b"", *ends)], f"word binary, {parts}").withColumns({"block": F.lit(None).cast("bigint"), "idx": F.lit(None).cast("int")})
    found = shards(asked.select("word", *columns, "block", "idx").unionByName(end), columns, scratch, asked.count() + 1)
    got = found.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("seen").alias("v"), *[F.sum(F.col("sums")[i]).alias(x) for i, x in enumerate(columns)]).first()
    totals = [got[x] for x in columns]
    crossing = merged_crossings(rows.where("part is not null"), scratch)
    prefixes = Prefixes.of(found, len(columns))
    mixer, at_ends, _ = learn(found, scratch, totals, got.n, got.bytes, got.v, crossing, prefixes)
    scratch.drop("tables", "crossings")
    # Chunks that no other row has can be no copies.
    known = cut.groupBy("key").agg(F.sum("n0").alias("shared"), F.count("*").alias("rows")).where("shared >= 1 and (rows >= 2 or shared >= 2)").select("key", "shared")
    known = scratch.save("known", known)
    n_chunks = cut.agg(F.sum("n0")).first()[0] or 0
    model = sent_model(spark, mixer, at_ends, prefixes)
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    known = cut.join(known, "key").select("block", "idx", "shared", nothing("binary", "data"), nothing("binary", "payload"))
    payloads = rows.where("payload is not null and part is null").select("block", nothing("int", "idx"), nothing("bigint", "shared"), nothing("binary", "data"), "payload")
    got_back = answers(found, model, len(columns)).select("block", nothing("int", "idx"), nothing("bigint", "shared"), "data", nothing("binary", "payload"))
    return got_back.unionByName(known).unionByName(payloads).groupBy("block").applyInArrow(_block_scores(totals, ends, got.v, n_chunks, model), OUT)
