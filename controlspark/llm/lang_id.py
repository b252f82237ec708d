"""Language identification by language-bitmask n-gram filters.

Each slot of one Bloom filter array holds a mask with a bit for each language:
the filters of all languages, bit-sliced into bytes. An n-gram's mask is the
conjunction of the slots its hashes name: all languages that contain it. A
text's count for a language is the number of its n-grams whose mask has the
language's bit, less what the language's fill rate makes one expect by chance.
The largest decides. The array is sized by the number of n-grams.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Scratch, as_bytes, batch_of, part_passes, prepare, tidy
from .textscan import U64, golden, mix64

#: Labelled rows of each language that the filters are learned from, at most.
FIT_ROWS = 1500
#: A language holds an n-gram whose rate in its texts is at least so large a share of the largest rate.
SHARE = 0.1
HASHES, SIZES = 3, (2, 3, 4)
#: Slots for each n-gram of the language that has most of them, and the least and largest powers of two.
ROOM, LEAST_BITS, MOST_BITS = 16, 12, 26
#: Names of languages, in bytes, up to which their sample's thresholds are broadcast.
BROADCAST_BYTES = 8 << 20
_GRAMS = pa.schema([("gram", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])
_FILTER = pa.schema([("part", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("coverage", pa.float64())])
OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, coverage double"
UNKNOWN = "und"


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the letter n-grams within words (a mark stands at each word's ends), their text's index, and which texts have letters."""
    codes = [np.frombuffer(t.decode("utf-8", "replace").lower().encode("utf-32-le"), dtype=np.uint32) for t in texts]
    joined = np.concatenate([x for c in codes for x in (c, np.zeros(1, dtype=np.uint32))])
    of = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in codes])
    letter = letters()[joined]
    joined = np.where(letter, joined, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one mark after each word
    first = np.flatnonzero(keep)
    joined, of, letter = joined[first].astype(U64), of[first], letter[first]
    has = np.zeros(len(texts), dtype=bool)
    has[of[letter]] = True
    padded = np.concatenate((np.zeros(1, dtype=U64), joined))  # the mark before the first word
    inner = np.concatenate(([False], letter))
    out, owner = [], []
    for n in SIZES:
        size = len(padded) - n + 1
        if size < 1:
            continue
        ok = np.ones(size, dtype=bool)
        for i in range(1, n - 1):
            ok &= inner[i : i + size]
        if n == 2:
            ok &= inner[:size] | inner[1 : 1 + size]
        at = np.flatnonzero(ok)
        h = np.full(len(at), golden(n), dtype=U64)
        for i in range(n):
            h = h * U64(0x2545F4914F6CDD1D) + padded[at + i] * U64(0x9E3779B97F4A7C15)
        out.append(mix64(h))
        owner.append(of[np.minimum(at + n - 2, len(of) - 1)])
    if not out:
        return np.empty(0, dtype=U64), np.empty(0, dtype=np.int64), has
    return np.concatenate(out), np.concatenate(owner), has


class Filters(NamedTuple):
    langs: list[str]
    masks: np.ndarray  #: (slots, bytes of a mask); the number of slots is a power of two
    chance: np.ndarray  #: of a bit of each language in the mask of an n-gram in no filter

    def having(self, gram: np.ndarray) -> np.ndarray:
        """The masks of n-grams."""
        mask = self.masks[slots(gram, 0, len(self.masks))]
        for i in range(1, HASHES):
            mask &= self.masks[slots(gram, i, len(self.masks))]
        return mask


def slots(gram: np.ndarray, i: int, size: int) -> np.ndarray:
    return (mix64(gram + golden(i + 1)) & U64(size - 1)).astype(np.int64)


def bit(masks: np.ndarray, i: int) -> np.ndarray:
    return (masks[:, i >> 3] >> np.uint8(i & 7)) & np.uint8(1)


def empty_masks(size: int, n_langs: int) -> np.ndarray:
    return np.zeros((size, max(1, -(-n_langs // 8))), dtype=np.uint8)


def add(masks: np.ndarray, gram: np.ndarray, lang: np.ndarray) -> None:
    """Puts n-grams, each with the number of a language, into the filters."""
    for i in range(HASHES):
        np.bitwise_or.at(masks, (slots(gram, i, len(masks)), lang >> 3), np.uint8(1) << (lang & 7).astype(np.uint8))


def finish(masks: np.ndarray, langs: list[str]) -> Filters:
    return Filters(langs, masks, np.array([bit(masks, i).mean() for i in range(len(langs))]) ** HASHES)


@tidy
def _count(batches):
    """Of each task, in how many texts of a language an n-gram occurs."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = as_bytes(batch.column("text"))
        split: dict[int, list[np.ndarray]] = {}
        for of, parts in part_passes(texts):
            gram, part, _ = grams(parts)
            whose = of[part]
            cuts = np.flatnonzero(np.diff(np.sort(whose))) + 1
            for own in np.split(np.argsort(whose, kind="stable"), cuts):
                if len(own):
                    split.setdefault(int(whose[own[0]]), []).append(np.unique(gram[own]))
        for name in sorted(set(langs)):
            own = [np.unique(np.concatenate(x)) if len(x) > 1 else x[0] for i, x in split.items() if langs[i] == name]
            if own:
                g, n = np.unique(np.concatenate(own), return_counts=True)
                yield batch_of(_GRAMS, (g.view(np.int64), [name] * len(g), n))


def sampled(docs: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """lang, text: of each language at most ``rows`` labelled texts outside the held-out fold, the first by a hash of doc_id; two scans."""
    known = docs.where("lang is not null and doc_id is not null").where(fold() != 0)
    per = scratch.save("langs", known.groupBy("lang").count())
    # A language's texts by a hash, somewhat more than needed; the rest go in the ranking.
    share = F.least(F.lit(1 << 30), F.ceil(F.lit(1.3 * (1 << 30) * rows) / F.col("count")) + (1 << 20))
    limits = per.select("lang", share.alias("share"))
    if (per.agg(F.sum(F.octet_length("lang") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        limits = F.broadcast(limits)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = known.where("text is not null").select("doc_id", "lang", "text").join(limits, "lang").where(place < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return scratch.save("sample", near.withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "text"))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Filters:
    """Filters from at most ``rows`` labelled texts of each language outside the held-out fold.

    Rows without a text, a language or a doc_id teach nothing. With no labelled
    row there is no language, and every text is ``und``. Every language that has
    a text is learned, and every n-gram of the sample counts.
    """
    scratch = Scratch(prepare(docs.sparkSession), "lang")
    sample = sampled(docs, rows, scratch)
    seen = sample.groupBy("lang").agg(F.count("*").alias("texts"))
    langs = sorted(r.lang for r in seen.select("lang").collect())  # names only
    if not langs:
        return finish(empty_masks(1 << LEAST_BITS, 0), [])
    # Dealt out again, as the ranking leaves a language in one task.
    counted = sample.repartition(12).mapInArrow(_count, "gram bigint, lang string, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    rates = counted.join(F.broadcast(seen), "lang").select("gram", F.struct("lang", (F.col("n") / F.col("texts")).alias("rate")).alias("x"))
    # A list has an entry a language at most.
    holders = rates.groupBy("gram").agg(F.collect_list("x").alias("all"), F.max("x.rate").alias("most"))
    held = scratch.save("held", holders.select("gram", F.explode(F.expr(f"filter(all, x -> x.rate >= {SHARE} * most)")).alias("x")).select("gram", "x.lang"))
    most = held.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    size = 1 << int(np.clip(int(max(1, ROOM * most) - 1).bit_length(), LEAST_BITS, MOST_BITS))
    number = {x: i for i, x in enumerate(langs)}

    @tidy
    def fill(batches: Iterator[pa.RecordBatch]):
        masks = empty_masks(size, len(number))
        for batch in batches:
            add(masks, batch.column("gram").to_numpy().view(U64), np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64))
        yield batch_of(_FILTER, ([zstandard.compress(masks.tobytes(), 1)],))

    masks = empty_masks(size, len(langs))
    for row in held.coalesce(6).mapInArrow(fill, "part binary").collect():  # six parts of the filters' size
        masks |= np.frombuffer(zstandard.decompress(row.part), dtype=np.uint8).reshape(masks.shape)
    scratch.drop("sample", "held")
    return finish(masks, langs)


def decide(texts: list[bytes], filters: Filters) -> list[tuple[str, float, float]]:
    """Of each text: its language, the score and the coverage."""
    langs, chance = filters.langs, filters.chance
    hits, n, has = np.zeros((len(texts), len(langs))), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    for of, parts in part_passes(texts):
        gram, part, some = grams(parts)
        whose = of[part]
        np.logical_or.at(has, of, some)
        n += np.bincount(whose, minlength=len(texts))
        mask = filters.having(gram)
        # Popcounts of the slices.
        for i in range(len(langs)):
            hits[:, i] += np.bincount(whose, weights=bit(mask, i), minlength=len(texts))
    true = np.maximum(0, hits - chance * n[:, None]) / np.maximum(1e-9, 1 - chance)  # less chance hits
    out = []
    for i in range(len(texts)):
        if not has[i] or not langs:
            out.append((UNKNOWN, 0.0, 0.0))
            continue
        best = int(np.argmax(true[i]))
        share = (true[i] / true[i, best]) ** 8 if true[i, best] else np.ones(len(langs))
        out.append((langs[best], float(1 / share.sum()), min(1.0, float(true[i, best] / max(1, n[i])))))
    return out


def predictor(filters: Filters):
    @tidy
    def predict(batches):
        for batch in batches:
            found = decide(as_bytes(batch.column("text")), filters)
            if found:
                yield batch_of(_OUT, (batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), *zip(*found, strict=True)))

    return predict


def tagged(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows of docs, all columns kept, with the language and coverage that ``identify`` gives, in __pred and __coverage: by row, whatever the doc_id."""
    prepare(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField("__pred", StringType()), StructField("__coverage", DoubleType())])

    @tidy
    def tag(batches):
        for batch in batches:
            found = decide(as_bytes(batch.column("text")), filters)
            pred, cover = pa.array([x[0] for x in found], pa.string()), pa.array([x[2] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pred, cover], names=[*batch.schema.names, "__pred", "__coverage"])

    return docs.mapInArrow(tag, schema)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred, score (of the language against the others) and coverage (the share of n-grams it holds) of each row.

    Only the text is an input. A null text or one without a letter is ``und``
    with score 0. Between equal counts the first language by name wins. Repeated
    and null doc_ids keep a row each; a null doc_id is not held out. A text
    longer than a pass is read in parts, cut between words.
    """
    prepare(docs.sparkSession)
    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text").mapInArrow(predictor(filters), OUT)
