"""The contexts of running text: what stands before a word, against brute force."""

import random
import zlib

import numpy as np
import pytest

from controlspark.llm import lm_bits, lm_score
from controlspark.llm.textscan import words


def crossings_of(texts):
    """before, heads and all words of texts in a row, the ends too, from the block's own helpers."""
    w = words(texts)
    names = [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    own = sorted(set(names))
    ids, lengths = np.array([own.index(x) for x in names], dtype=np.int64), np.diff(w.bounds)
    return lm_score.running(ids, lengths, lm_bits.first_bytes(own), lm_bits.last_bytes(own)), names, lengths


def test_running_text_tells_the_bytes_before():
    (before, heads), names, lengths = crossings_of([b"One a three", b"", b"x"])
    text = lambda x: [int(i).to_bytes(3, "big") for i in x]
    assert names == [b"one", b"a", b"three", b"x"] and lengths.tolist() == [3, 0, 1]
    assert text(before[0]) == [b"   ", b"one", b"  a", b"   "] and text(before[1]) == [b"ree", b"   ", b"  x"]
    assert text(heads[0]) == [b"one", b"a  ", b"thr", b"x  "] and text(heads[1]) == [b"   "] * 3


def test_contexts_reach_over_the_space():
    got = {}
    for tail in (b"abc", b"xbc", b"xyc", b"xyz"):
        before, heads = np.array([int.from_bytes(tail, "big")]), lm_bits.first_bytes([b"word"])
        for p, (_, code) in enumerate(lm_bits.crossings(before, heads)):
            data, hashed = lm_bits.crossing_contexts(code, p)
            assert data[0] == b"word"[p]
            got[tail, p] = [int(x[0]) for x in hashed]
    inside = lm_bits.contexts(lm_bits.Words.of([b"word"]))
    for p in range(lm_bits.CROSS):
        for o, order in enumerate(lm_bits.ORDERS):
            reach = max(0, order - p - 1)  # bytes of the word before
            for tail in (b"xbc", b"xyc", b"xyz"):
                assert (got[tail, p][o] == got[b"abc", p][o]) == (reach == 0 or tail[-reach:] == b"abc"[-reach:])
            if not reach:
                assert got[b"abc", p][o] == int(inside[o][p])


def test_prefixes_equal_the_sorted_vocabulary(spark):
    rng = random.Random(2)
    vocabulary = {"".join(rng.choice("abé\x01") for _ in range(rng.randint(0, 6))).encode(): rng.randint(0, 9) for _ in range(200)}
    names = sorted(vocabulary, key=lambda x: x + b" ")
    table = spark.createDataFrame([(bytearray(x), vocabulary[x], i, 3 * i) for i, x in enumerate(names)], "word binary, n0 bigint, block bigint, idx int")
    found = lm_bits.shards(table.unionByName(table.selectExpr("word", "n0", "block + 1000 as block", "idx")), ["n0"], lm_bits.Scratch(spark, "test"), 400)
    row = found.first()
    assert (row.n, row.sums) == (len(names), [2 * sum(vocabulary.values())])
    prefixes, counts = lm_bits.Prefixes.of(found, 1), 2.0 * np.array([vocabulary[x] for x in names])
    w = lm_bits.Words.of(names)
    want = lm_bits.prefix_counts(w, counts, None)
    for p, (has, code) in enumerate(lm_bits.crossings(np.zeros(len(names), dtype=np.int64), lm_bits.first_bytes(names))):
        assert np.array_equal(prefixes.whole(code, p), want[:, :, w.starts[has] + p])


@pytest.fixture(scope="module")
def learned(spark):
    """A model of texts in which b words follow a words and the other way round."""
    rng = random.Random(4)
    texts = [" ".join(("ab"[i % 2] + rng.choice("cdefgh") * rng.randint(0, 4) + "ab"[i % 2]) for i in range(60)).encode() for _ in range(60)]
    (before, heads), names, _ = crossings_of(texts)
    names = [*names, *[b""] * len(texts)]
    own = sorted(set(names), key=lambda x: x + b" ")
    scratch = lm_bits.Scratch(spark, "test")
    found = lm_bits.shards(spark.createDataFrame([(bytearray(x), names.count(x)) for x in own], "word binary, n0 bigint"), ["n0"], scratch, len(own))
    rows = lm_bits.crossing_rows(np.concatenate(before), np.concatenate(heads))
    crossing = lm_bits.merged_crossings(spark.createDataFrame([(i, bytearray(x)) for i, x in [*rows, *rows]], "part int, payload binary"), scratch)
    seen = [lm_bits.unpacked_crossings(r.payload) for r in crossing.collect()]
    assert sum(int(n[key >> 32 == 0].sum()) for key, n in seen) == 2 * len(names)
    prefixes = lm_bits.Prefixes.of(found, 1)
    mixer, _, _ = lm_bits.learn(found, scratch, [len(names)], len(own), sum(len(x) + 1 for x in own), len(own), crossing, prefixes)
    return mixer.freeze(), prefixes


@pytest.mark.parametrize("tail", [b"   ", b" aa", b"cca", b"hhb", b"zzz"])
def test_first_bytes_sum_to_one(learned, tail):
    names = [bytes([x]) for x in range(256) if x != 32]
    before = np.full(256, int.from_bytes(tail, "big"))
    code = lm_bits.crossings(before, np.concatenate((lm_bits.first_bytes(names), [lm_bits.BEFORE_ALL])))[0][1]
    lp = learned[0].log10_of(*lm_bits.crossing_contexts(code, 0), learned[1].whole(code, 0))
    assert (10.0**lp).sum() == pytest.approx(1, abs=1e-4)
    if tail in (b"cca", b"hhb"):  # the model knows what follows
        assert 10.0 ** lp[[x for x, y in enumerate(names) if y == (b"b" if tail == b"cca" else b"a")][0]] > 0.8


def test_the_order_of_words_counts(spark):
    rng = random.Random(9)
    word = lambda x: x + "".join(rng.choice("cdefgh") for _ in range(rng.randint(1, 3))) + x
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(400) if i not in train][:2]
    rows = [(i, " ".join(word("ab"[j % 2]) for j in range(80))) for i in train[:150]]
    own = [word("ab"[j % 2]) for j in range(40)]
    rows += [(held[0], " ".join(own)), (held[1], " ".join(sorted(own)))]
    got = {r.doc_id: r for r in lm_score.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 5


@pytest.mark.parametrize("rows", [[], [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "no training rows")]])
def test_without_training_rows(spark, rows):
    got = lm_score.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) and r.score < 0 for r in got)
