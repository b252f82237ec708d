"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

1. One pass over the texts makes each document's set of word shingles, a
   128-bit fingerprint of the set and a SuperMinHash signature cut into bands.
2. Documents with equal sets form a class (a partial aggregation); only its
   smallest document goes on, so a group of copies costs one row per copy.
3. Each band's bucket links its members to the smallest one (a star). The
   pairs are verified on the full sets and grouped.
4. A star can miss a link between two members that its hub is linked with
   neither of. So the members of buckets that still hold different groups are
   searched in full by a prefix filter: with the shingles of a set ordered from
   rare to common, two sets that are similar enough share one of their first
   ``size - ceil(similarity * size) + 1``. Pairs of different groups that share
   one are verified, and the groups are made again. Rarity comes from a counter
   table of fixed size; any order is right, a good one keeps the pairs few.

Buckets, stars and classes are aggregated and joined, never gathered. The
verifier streams over blocks of at most about ``BLOCK`` partners of a document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_of, integers, own_ids, passes, tidy, with_row_keys
from .components import components
from .textscan import GOLDEN, U64, golden, mix64, shingles, words

BLOCK = 48
SLOTS, PIECES = 1 << 19, 128
ROWS = 4
FULL = U64(0xFFFFFFFFFFFFFFFF)
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_PIECE = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])
SIGNED = "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>"


def bands_for(similarity: float, miss: float = 1e-6) -> int:
    """Bands of ROWS rows, so that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**ROWS))


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes.

    Element e gets a random permutation of the m places by Fisher-Yates steps
    and puts rank j plus a random fraction into its j-th place; a place keeps
    the least value. All elements take step j together. Once every place is
    filled, no later step can lower any, and the search stops early.
    """
    out = np.full(m, FULL, dtype=U64)
    n = len(elements)
    perm = rows = None
    for j in range(m):
        x = mix64(elements + golden(j + 1))
        k = ((x & U64(0xFFFFFFFF)) % U64(m - j)).astype(np.int64) + j
        if j == 0:
            place = first = k
        else:
            if perm is None:
                perm, rows = np.tile(np.arange(m, dtype=np.int16), (n, 1)), np.arange(n)
                perm[rows, first], perm[:, 0] = 0, first
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(out, place, (U64(j) << U64(48)) | (x >> U64(16)))
        if out.max() != FULL:
            break
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=U64) * GOLDEN
    for r in range(ROWS):
        key = mix64(key + rows[:, r])
    return key


def signer(k: int, n_bands: int):
    @tidy
    def sign(batches):
        for batch in batches:
            ids = integers(batch, "doc_id")
            for first, texts in passes(batch):
                w = words(texts)
                out = []
                for i in range(len(texts)):
                    s = shingles(w.hashes[w.bounds[i] : w.bounds[i + 1]], k)
                    if len(s):
                        fp = (mix64(s).sum(dtype=U64), np.bitwise_xor.reduce(mix64(s + GOLDEN)))
                        keys = band_keys(superminhash(s, n_bands * ROWS)).view(np.int64)
                        out.append((ids[first + i], len(s), fp[0].view(np.int64), fp[1].view(np.int64), keys))
                    else:
                        out.append((ids[first + i], 0, 0, 0, None))
                yield batch_of(_SIGNED, zip(*out, strict=True))

    return sign


def verifier(k: int, numerator: int):
    """Streams over (hub, block) runs, the hub first: pairs with 100 * common >= numerator * union."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    @tidy
    def verify(batches):
        hub, hub_set = None, None
        for batch in batches:
            hubs, ids = integers(batch, "hub"), integers(batch, "id")
            u, v = [], []
            for first, texts in passes(batch):
                w = words(texts)
                for i in range(len(texts)):
                    s = shingles(w.hashes[w.bounds[i] : w.bounds[i + 1]], k)
                    h, x = hubs[first + i], ids[first + i]
                    if h == x:
                        hub, hub_set = h, s
                    elif h == hub and len(s) and len(hub_set):
                        common = len(np.intersect1d(s, hub_set, assume_unique=True))
                        if 100 * common >= numerator * (len(s) + len(hub_set) - common):
                            u.append(h)
                            v.append(x)
            yield batch_of(schema, (u, v))

    return verify


def _counter(k: int):
    """A table of SLOTS shingle counts for each partition, in PIECES rows."""

    @tidy
    def count(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, texts in passes(batch):
                w = words(texts)
                for i in range(len(texts)):
                    s = shingles(w.hashes[w.bounds[i] : w.bounds[i + 1]], k)
                    total += np.bincount((s % U64(SLOTS)).astype(np.int64), minlength=SLOTS) if len(s) > SLOTS // 8 else 0
                    if len(s) <= SLOTS // 8:
                        np.add.at(total, (s % U64(SLOTS)).astype(np.int64), 1)
        if total.any():
            parts = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(PIECES, -1)
            yield batch_of(_PIECE, (range(PIECES), [p.tobytes() for p in parts]))

    return count


@tidy
def _add_pieces(batches):
    now, total = None, None
    for batch in batches:
        for piece, data in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if piece != now:
                if now is not None:
                    yield batch_of(_PIECE, ([now], [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]))
                now, total = piece, np.zeros(SLOTS // PIECES, dtype=np.int64)
            total += np.frombuffer(data, dtype=np.uint32)
    if now is not None:
        yield batch_of(_PIECE, ([now], [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]))


def _prefixer(k: int, numerator: int, counts: np.ndarray):
    """Of each set, the rarest shingles, of which a similar set must share one."""
    schema = pa.schema([("doc_id", pa.int64()), ("component", pa.int64()), ("size", pa.int64()), ("left", pa.int64()), ("shingle", pa.int64())])

    @tidy
    def prefix(batches):
        for batch in batches:
            ids, groups = integers(batch, "doc_id"), integers(batch, "component")
            for first, texts in passes(batch):
                w = words(texts)
                for i in range(len(texts)):
                    s = shingles(w.hashes[w.bounds[i] : w.bounds[i + 1]], k)
                    n = len(s)
                    keep = n - -(-numerator * n // 100) + 1
                    rare = s[np.lexsort((s, counts[(s % U64(SLOTS)).astype(np.int64)]))[:keep]].view(np.int64)
                    yield batch_of(schema, (np.full(len(rare), ids[first + i]), np.full(len(rare), groups[first + i]), np.full(len(rare), n), n - np.arange(len(rare)), rare))

    return prefix


def _verified(pairs: DataFrame, texts: DataFrame, k: int, numerator: int) -> DataFrame:
    """Of the distinct pairs (hub, id), those similar enough. Each block of partners meets its hub's text once."""
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    dealt = pairs.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("n")).alias("block"), "id")
    rows = dealt.unionByName(dealt.select("hub", "block", F.col("hub").alias("id")).distinct())
    return (
        rows.join(texts.withColumnRenamed("doc_id", "id"), "id")
        .repartition("hub", "block")
        .sortWithinPartitions("hub", "block", F.col("id") != F.col("hub"))
        .select("hub", "id", "text")
        .mapInArrow(verifier(k, numerator), "u bigint, v bigint")
    )


def _across(rest: DataFrame, k: int, numerator: int) -> DataFrame:
    """Distinct pairs of different groups in rest (doc_id, component, text) that share a prefix shingle."""
    pieces = rest.select("text").mapInArrow(_counter(k), "piece int, counts binary").repartition("piece").sortWithinPartitions("piece").mapInArrow(_add_pieces, "piece int, counts binary")
    counts = np.zeros(SLOTS, dtype=np.uint32).reshape(PIECES, -1)
    for row in pieces.collect():  # PIECES rows, 4 * SLOTS bytes in all
        counts[row.piece] = np.frombuffer(row.counts, dtype=np.uint32)
    rare = rest.mapInArrow(_prefixer(k, numerator, counts.reshape(-1)), "doc_id bigint, component bigint, size bigint, left bigint, shingle bigint")
    mixed = rare.groupBy("shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("shingle")
    rare = rare.join(mixed, "shingle")
    # The shorter set needs a shorter prefix. The first shingle that two sets share bounds what they share by what each has left from there.
    enough = (100 + numerator) * F.least("a.left", "b.left") >= numerator * (F.col("a.size") + F.col("b.size"))
    a, b = rare.where((100 + numerator) * F.col("left") >= 2 * numerator * F.col("size")).alias("a"), rare.alias("b")
    fit = (F.struct("a.size", "a.doc_id") < F.struct("b.size", "b.doc_id")) & (F.col("a.component") != F.col("b.component")) & enough
    found = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & fit)
    return found.select(F.least("a.doc_id", "b.doc_id").alias("hub"), F.greatest("a.doc_id", "b.doc_id").alias("id")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text, anything else).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text
    of fewer than k words is one shingle. Two documents are linked if the
    Jaccard similarity of their shingle sets is ``similarity`` (a hundredth's
    multiple) or more; component_id is the smallest doc_id reachable. Null and
    blank texts have no shingles and are linked with nothing. Ties cannot
    arise: the smallest id decides. Rows that repeat a doc_id, or lack one, are
    documents of their own, linked like all others; nulls are larger than every
    id, and of a group that has none the first row as read is kept. An empty
    table gives an empty one. Whole texts are read at any length, one at a time.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if own_ids(docs):
        return _groups(docs, scratch, k, similarity).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    rows = with_row_keys(docs, scratch)
    found = scratch.save("found", _groups(rows.select(F.col("__row").alias("doc_id"), "text"), scratch, k, similarity).withColumnRenamed("doc_id", "__row"))
    names = rows.select("__row", "doc_id")
    own = found.join(names, "__row").withColumnRenamed("component_id", "__first")
    firsts = names.select(F.col("__row").alias("__first"), F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("__row") == F.col("__first")))
    return own.join(firsts, "__first").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _groups(docs: DataFrame, scratch: Scratch, k: int, similarity: float) -> DataFrame:
    """doc_id, n_shingles, component_id of rows with a doc_id each of its own."""
    numerator, n_bands = round(100 * similarity), bands_for(similarity)
    signed = scratch.save("signed", docs.mapInArrow(signer(k, n_bands), SIGNED))
    shingled = signed.where("n_shingles > 0")
    classes = scratch.save("classes", shingled.groupBy("n_shingles", "fp1", "fp2").agg(F.min(F.struct("doc_id", "bands")).alias("first")).select("n_shingles", "fp1", "fp2", "first.*"))

    entries = classes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = scratch.save("buckets", entries.join(shared, ["band", "key"]))
    texts = scratch.save("texts", docs.join(buckets.select("doc_id").distinct(), "doc_id"))
    stars = scratch.save("stars", buckets.where("doc_id <> hub").select("hub", F.col("doc_id").alias("id")).distinct())
    links = scratch.save("links", _verified(stars, texts, k, numerator))
    first = scratch.save("first", components(links, scratch, "star"))

    grouped = scratch.save("grouped", buckets.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    # Written, so that the join shuffles both sides and a hot bucket is split.
    mixed = scratch.save("mixed", grouped.groupBy("band", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("band", "key"))
    members = scratch.save("members", grouped.join(mixed, ["band", "key"]).select("doc_id", "component")).distinct()
    rest = scratch.save("rest", texts.join(members, "doc_id").select("doc_id", "component", "text"))
    pairs = scratch.save("pairs", _across(rest, k, numerator).join(stars, ["hub", "id"], "left_anti"))
    more = scratch.save("more", _verified(pairs, texts, k, numerator))
    merged = first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)
    groups = components(merged, scratch, "all").withColumnRenamed("id", "first_id")

    named = classes.select("n_shingles", "fp1", "fp2", F.col("doc_id").alias("first_id")).join(groups, "first_id", "left")
    named = named.select("n_shingles", "fp1", "fp2", F.coalesce("component", "first_id").alias("component_id"))
    return signed.drop("bands").join(named, ["n_shingles", "fp1", "fp2"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
