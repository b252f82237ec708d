"""A quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Random indexing: a word has a fixed sparse ternary index vector, made from its
hash, and a context vector, the sum of its neighbours' index vectors in all texts
outside the held-out fold (words share context vectors by a hash). As a corpus
keeps having new words, a word also has the sum of the index vectors of its byte
trigrams. A document is the mean of its words' trigram vectors, of their context
vectors and of the products of neighbours' trigram vectors, and nothing else. A
hidden layer of rectified units and a logistic output are trained with numpy on
the driver, and a temperature fitted on rows set aside calibrates the
probability.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, batch_of, part_passes, prepare, tidy
from .lang_id import fold
from .textscan import NOT_SPACE, U64, golden, mix64, words

#: Labelled rows that the network is fitted on, at most.
FIT_ROWS = 8000
#: Context vectors; words with equal hashes share one.
BUCKETS = 1 << 15
#: Index vectors, and their length and places that are not zero.
INDEX, DIM, NONZERO = 1 << 13, 32, 4
#: Neighbours on each side, and rows of the table of context vectors that are summed together.
REACH, PIECE = 2, 1 << 11
HIDDEN, EPOCHS, BATCH, SEED = 32, 60, 128, 7
THRESHOLD = 0.3
_TABLE = pa.schema([("piece", pa.int32()), ("data", pa.binary())])
_ROWS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("features", pa.list_(pa.float32()))])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
OUT = "doc_id bigint, held_out boolean, score double, predicted int"
KEEP_CASE = np.arange(256, dtype=np.uint8)


def places() -> np.ndarray:
    """Of INDEX sparse vectors the NONZERO places; the odd ones are 1, the others -1."""
    h, out = mix64(np.arange(INDEX, dtype=U64) + golden(1)), np.empty((INDEX, NONZERO), dtype=np.int64)
    for i in range(NONZERO):
        h = mix64(h + golden(i + 2))
        out[:, i] = (h % U64(DIM)).astype(np.int64)
    return out


def summed(rows: np.ndarray, index: np.ndarray, n: int, where: np.ndarray) -> np.ndarray:
    """n vectors: the sums of the index vectors, each added to a row."""
    at = (rows[:, None] * DIM + where[index]).reshape(-1)
    signs = np.tile(np.where(np.arange(NONZERO) % 2, 1.0, -1.0), len(rows))
    return np.bincount(at, weights=signs, minlength=n * DIM).reshape(n, DIM).astype(np.float32)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U64(BUCKETS - 1)).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    return x / np.maximum(1e-6, np.sqrt(np.einsum("ij,ij->i", x, x)))[:, None]


class Lexicon(NamedTuple):
    """The distinct words of a pass."""

    bounds: np.ndarray  #: text i has the words bounds[i]:bounds[i + 1]
    ids: np.ndarray  #: of each word, the number of its distinct word
    hashes: np.ndarray  #: of the distinct words
    trigrams: np.ndarray  #: their trigram vectors


def lexicon(texts: list[bytes], where: np.ndarray) -> Lexicon:
    w = words(texts, NOT_SPACE, KEEP_CASE)
    own, first, ids = np.unique(w.hashes, return_index=True, return_inverse=True)
    lengths = w.ends[first] - w.starts[first]
    # The words stand between white space, which marks their ends; as many trigrams as bytes.
    of = np.repeat(np.arange(len(own)), lengths)
    at = np.repeat(w.starts[first] - np.cumsum(lengths) + lengths, lengths) + np.arange(len(of))
    data = np.concatenate(([10], w.data, [10])).astype(np.uint32)
    data[1:-1][~NOT_SPACE[w.data]] = 10
    code = (data[at] << np.uint32(16)) | (data[at + 1] << np.uint32(8)) | data[at + 2]
    slot = (mix64(code.astype(U64) + golden(5)) & U64(INDEX - 1)).astype(np.int64)
    return Lexicon(w.bounds, ids, own, unit(summed(of, slot, len(own), where)))


@tidy
def _contexts(batches):
    """A task's sums of neighbours' index vectors, for each bucket of words, in pieces."""
    index, total = unit(summed(np.arange(INDEX), np.arange(INDEX), INDEX, places())), np.zeros((BUCKETS, DIM), dtype=np.float64)
    for batch in batches:
        for _, parts in part_passes(as_bytes(batch.column("text"))):
            w = words(parts, NOT_SPACE, KEEP_CASE)
            if not len(w.hashes):
                continue
            of, near = np.repeat(np.arange(len(parts)), np.diff(w.bounds)), index[(mix64(w.hashes) & U64(INDEX - 1)).astype(np.int64)]
            sums = np.zeros_like(near)
            for d in range(1, REACH + 1):
                same = (of[d:] == of[:-d])[:, None]
                sums[:-d] += near[d:] * same
                sums[d:] += near[:-d] * same
            own = bucket(w.hashes)
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) > 0)))
            total[own[order][cuts]] += np.add.reduceat(sums[order], cuts, axis=0)
    if total.any():
        for i in range(0, BUCKETS, PIECE):
            yield batch_of(_TABLE, ([i // PIECE], [zstandard.compress(total[i : i + PIECE].astype(np.float32).tobytes(), 1)]))


@tidy
def _add_pieces(batches):
    now = total = None
    done = lambda: batch_of(_TABLE, ([now], [total.astype(np.float32).tobytes()]))
    for batch in batches:
        for piece, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if piece != now:
                if now is not None:
                    yield done()
                now, total = piece, 0.0
            total = total + np.frombuffer(zstandard.decompress(data), dtype=np.float32).astype(np.float64)
    if now is not None:
        yield done()


def context_vectors(texts: DataFrame) -> np.ndarray:
    """BUCKETS vectors of length one, from every text; the table's size does not grow with the input."""
    schema = "piece int, data binary"
    pieces = texts.select("text").mapInArrow(_contexts, schema).repartition("piece").sortWithinPartitions("piece").mapInArrow(_add_pieces, schema)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for row in pieces.collect():  # the table's size in all
        out[row.piece * PIECE : (row.piece + 1) * PIECE] = np.frombuffer(row.data, dtype=np.float32).reshape(-1, DIM)
    return unit(out).astype(np.float32)


def features(texts: list[bytes], vectors: np.ndarray, where: np.ndarray) -> np.ndarray:
    """One row a text: the means of its words' trigram and context vectors and of the products of neighbours' trigram vectors. A text without words has zeros."""
    out, n = np.zeros((len(texts), 3 * DIM)), np.zeros(len(texts))
    for whose, parts in part_passes(texts):
        x = lexicon(parts, where)
        lengths = np.diff(x.bounds)
        full = np.flatnonzero(lengths)
        if not len(full):
            continue
        each = np.concatenate((x.trigrams, vectors[bucket(x.hashes)], x.trigrams), axis=1)[x.ids]
        each[:-1, 2 * DIM :] *= each[1:, :DIM]
        each[x.bounds[1:][full] - 1, 2 * DIM :] = 0  # a text's last word has no next one
        np.add.at(out, whose[full], np.add.reduceat(each, x.bounds[:-1][full], axis=0))
        np.add.at(n, whose[full], lengths[full])
    out /= np.maximum(1, n)[:, None]
    out[:, 2 * DIM :] *= DIM**0.5
    return out.astype(np.float32)


class Model(NamedTuple):
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(0, x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray) -> Model:
    """Adam on the logistic loss; the last fifth of a fixed permutation sets the temperature."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    cut = max(1, len(x) * 4 // 5)
    mean, scale = x[:cut].mean(axis=0), x[:cut].std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        for i in np.array_split(rng.permutation(cut), max(1, cut // BATCH)):
            hidden = np.maximum(0, z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -60, 60))) - y[i]) / len(i)
            back = np.outer(d, p[2]) * (hidden > 0)
            grads = [z[i].T @ back + 1e-3 * p[0], back.sum(axis=0), hidden.T @ d + 1e-3 * p[2], d.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 3e-3 * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(x) > cut:
        raw = model.logits(x[cut:])
        loss = lambda s: np.logaddexp(0, np.where(y[cut:] > 0, -raw, raw) / s).mean()
        model = model._replace(temperature=float(min(np.geomspace(0.5, 8, 60), key=loss)))
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """The model: context vectors from all texts outside the held-out fold, the network from at most ``rows`` labelled ones, the first by a hash of doc_id; None without any.

    Rows with a null doc_id, quality or text teach no label. Conflicting labels
    of a document count by their minimum.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    named = labels.where("doc_id is not null and quality is not null").where(fold() != 0).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # small enough to broadcast, whatever the tables' sizes
    sample = scratch.save("sample", docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").repartition(12))
    if sample.isEmpty():
        return None
    vectors = context_vectors(docs.where(F.coalesce(fold() != 0, F.lit(True)) & F.col("text").isNotNull()))
    table = spark.sparkContext.broadcast(vectors)

    @tidy
    def describe(batches):
        where = places()
        for batch in batches:
            yield batch_of(_ROWS, (batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), list(features(as_bytes(batch.column("text")), table.value, where))))

    got = sample.mapInArrow(describe, "doc_id bigint, quality int, features array<float>").orderBy("doc_id").toArrow()
    scratch.drop("sample")
    x = got["features"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    return train(x, got["quality"].to_numpy() > 0, vectors)


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row; only the text is an input.

    A null or empty text is scored as a text without words. Without a model
    every score is 0.5. Repeated and null doc_ids keep a row each; a null
    doc_id is not held out. An empty table gives an empty one; a text longer
    than a pass is read in parts, cut between words.
    """
    spark = prepare(docs.sparkSession)
    own = spark.sparkContext.broadcast(model)

    @tidy
    def score(batches):
        model, where = own.value, places()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            s = model.score(features(texts, model.vectors, where).astype(np.float64)) if model else np.full(len(texts), 0.5)
            yield batch_of(_OUT, (batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), s, (s >= THRESHOLD).astype(np.int32)))

    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text").mapInArrow(score, OUT)
