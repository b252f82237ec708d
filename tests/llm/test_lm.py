"""The language model: exact contexts, normalisation, chunks and the chance of copies against brute force."""

import cProfile
import pstats
import random
import zlib

import numpy as np
import pytest

from controlspark.llm import lm_bits, lm_score
from controlspark.llm.textscan import words


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(6)
    out = {"".join(rng.choice("abcdeé\x01") for _ in range(rng.randint(1, 6))).encode(): rng.randint(0, 30) for _ in range(700)}
    out |= {b"": 40, b"a" * 300 + b"x": 2, b"a" * 300 + b"y": 3}
    return dict(sorted(out.items(), key=lambda x: x[0] + b" "))


def bits(name):
    return np.unpackbits(np.frombuffer(name + b" ", dtype=np.uint8))


def test_prefix_counts_equal_brute_force(vocabulary):
    names, c = list(vocabulary), np.array(list(vocabulary.values()), dtype=float)
    cuts = [0, 1, 100, 101, 350, len(names)]
    parts = [(names[a:b], c[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rows = []
    for i, (own, n) in enumerate(parts):
        ahead, behind, through = lm_bits._paths(lm_bits.Words.of(own), n)
        rows.append({"shard": i, "first": own[0], "last": own[-1], "ahead": ahead, "behind": behind, "through": through})
    ends = lm_bits.edges(rows)
    all_bits = [bits(x) for x in names]
    rng = random.Random(1)
    for i, (own, n) in enumerate(parts):
        w = lm_bits.Words.of(own)
        got = lm_bits.prefix_counts(w, n, ends[i])
        for j in {0, len(own) - 1, *(rng.randrange(len(own)) for _ in range(12))}:
            mine = bits(own[j])
            for place in range(min(len(own[j]) + 1, 9)):
                for k in range(8):
                    d = 8 * place + k
                    same = [(x, t) for x, t in zip(all_bits, c, strict=True) if len(x) > d and np.array_equal(x[:d], mine[:d])]
                    for bit in (0, 1):
                        assert got[bit, k, w.starts[j] + place] == sum(t for x, t in same if x[d] == bit)


@pytest.fixture(scope="module")
def model(spark, vocabulary):
    scratch = lm_bits.Scratch(spark, "test")
    table = spark.createDataFrame([(bytearray(w), n, 2 * n) for w, n in vocabulary.items()], "word binary, n0 bigint, n1 bigint")
    found = lm_bits.shards(table, ["n0", "n1"], scratch, len(vocabulary))
    total = sum(vocabulary.values())
    mixer, ends, home = lm_bits.learn(found, scratch, [total, 2 * total], len(vocabulary), sum(len(w) + 1 for w in vocabulary), sum(n > 0 for n in vocabulary.values()))
    scored = {bytes(r.word): r.lp for r in lm_bits.word_scores(found, mixer, ends, ["n0", "n1"]).collect()}
    assert b"" in {bytes(r.word) for r in lm_bits.word_scores(found.where(f"shard = {home}"), mixer, ends, ["n0", "n1"]).collect()}
    return mixer, scored


def test_tables_hold_all_tokens(model, vocabulary):
    mixer, _ = model
    want = lm_bits.Tables.empty(sum(len(w) + 1 for w in vocabulary))
    for w, n in vocabulary.items():
        one = lm_bits.Words.of([w])
        for k in range(8):
            bit, at = lm_bits.slots(one.data, lm_bits.contexts(one), k, want)
            for s in at:
                np.add.at(want.counts, (bit.astype(int), s), 3 * n)
    assert np.array_equal(mixer.tables.counts, want.counts)


def test_next_bytes_sum_to_one(model, vocabulary):
    mixer = lm_bits.Mixer(model[0].tables)
    mixer.weights, mixer.map = model[0].weights, model[0].map
    mixer.freeze()
    for start in (b"", b"a", b"ab", b"zz", b"bca"):
        more = {start + bytes([b]): 0 for b in range(256) if b != 32} | {start: 0}
        both = dict(sorted((more | vocabulary).items(), key=lambda x: x[0] + b" "))
        w = lm_bits.Words.of(list(both))
        lp = mixer.log10(w, lm_bits.prefix_counts(w, 3.0 * np.array(list(both.values())), None))
        total = sum(10 ** lp[a + len(start)] for name, a in zip(both, w.starts, strict=True) if name in more)
        assert total == pytest.approx(1, abs=1e-4)


def test_learning_helps(model, vocabulary):
    _, scored = model
    flat = lm_bits.Mixer(model[0].tables).freeze()
    w = lm_bits.Words.of(list(vocabulary))
    plain = np.add.reduceat(flat.log10(w, lm_bits.prefix_counts(w, 3.0 * np.array(list(vocabulary.values())), None)), w.starts)
    n = np.array(list(vocabulary.values()))
    assert (n * np.array([scored[x] for x in vocabulary])).sum() > (n * plain).sum()


def test_long_words_are_not_floored():
    lp = np.array([-5000.0, -310.0, -2.0])
    assert lm_score.by_both(lp, np.zeros(3), 10, 0.5) == pytest.approx(lp + np.log10(0.5))
    assert lm_score.by_both(lp, np.array([0, 0, 5.0]), 10, 0.5)[2] == pytest.approx(np.log10(0.5 * 0.01 + 0.5 * 0.5))


def test_chunks_equal_a_plain_cut():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 50)) for _ in range(n)).encode() for n in (0, 1, 200, 0, 77, 200)]
    texts.append(texts[2])
    w = words(texts)
    per_doc, sizes, keys = lm_score.chunks(w.hashes, np.diff(w.bounds))
    seen, at = {}, 0
    for i, n in enumerate(per_doc):
        own, chunk = [], []
        for h in w.hashes[w.bounds[i] : w.bounds[i + 1]].tolist():
            chunk.append(h)
            if (h >> 40) % lm_score.CHUNK == 0:
                own.append(tuple(chunk))
                chunk = []
        own.append((*chunk, None))
        assert [len(x) for x in own[:-1]] + [len(own[-1]) - 1] == sizes[at : at + n].tolist()
        for x, key in zip(own, keys[at : at + n].tolist(), strict=True):
            assert seen.setdefault(x, key) == key
        at += n
    assert len(set(seen.values())) == len(seen) and at == len(keys)


def test_chain_equals_all_paths():
    rng = np.random.default_rng(0)
    per_doc = np.array([1, 4, 3])
    by_words, share = -rng.random((8, 2)) * 5, rng.random(8) * 0.2
    share[[1, 5, 6, 7]] = 0
    with np.errstate(divide="ignore"):
        got = lm_score.chained(by_words, np.log10(share), per_doc)
    at = 0
    for d, n in enumerate(per_doc):
        for c in range(2):
            alpha = np.array([1 - lm_score.ENTER, lm_score.ENTER])
            for t in range(at, at + n):
                alpha = alpha * [10 ** by_words[t, c], share[t]]
                if t + 1 < at + n:
                    alpha = np.array([alpha[0] * (1 - lm_score.ENTER) + alpha[1] * (1 - lm_score.STAY), alpha[0] * lm_score.ENTER + alpha[1] * lm_score.STAY])
            assert got[d, c] == pytest.approx(np.log10(alpha.sum()))
        at += n


def test_texts_that_occur_twice_stand_out(spark):
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300))
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(200) if i not in train)
    rows = [(i, text(), None) for i in train[:30]]
    rows += [(train[40], rows[0][1], None), (None, text(), "en"), (train[41], text(), "en"), (train[41], None, "de"), (train[42], "", None)]
    long = " ".join(["x" * 5000, "".join(rng.choices("abcdefghij", k=30_000)), *text().split()])
    got = lm_score.score_texts(spark.createDataFrame([*rows, (held, long, None)], "doc_id bigint, text string, lang string").repartition(2)).collect()
    assert len(got) == len(rows) + 1 and all(np.isfinite(r.score) and r.score < 0 for r in got)
    twice = [r.bits_per_byte for r in got if r.doc_id in (train[0], train[40])]
    once = [r.bits_per_byte for r in got if r.doc_id in train[1:30]]
    assert len(twice) == 2 and max(twice) < 0.5 * min(once)
    assert next(r for r in got if r.doc_id == held).score < -10_000  # no floor below a long word


def test_a_block_is_built_without_a_call_for_each_word():
    """Odd words and many: what the block asks for equals a plain count, and Python calls do not grow with the words."""
    rng = random.Random(8)
    odd = ["", "Ab  aB\tx", "é 你好 \x01 \x00", "a" * 3000, "y", "ab"]
    texts = [x.encode() for x in odd] + [" ".join(f"W{rng.randint(0, 10**6)}" for _ in range(500)).encode() for _ in range(20)]
    docs = [(i, i % 3 == 1, len(x), i % 2) for i, x in enumerate(texts)]
    runs = [(np.arange(i, min(i + 7, len(texts))), words(texts[i : i + 7])) for i in range(0, len(texts), 7)]
    profile = cProfile.Profile()
    rows = profile.runcall(lm_score._block, 5, docs, runs, 1).to_pylist()
    want = {}
    for (_, held, _, own), text in zip(docs, texts, strict=True):
        for x in text.lower().split():
            n = want.setdefault(x, [0, 0])
            n[own] += not held
    asked = [r for r in rows if r["word"] is not None]
    assert {r["word"]: [r["n0"], r["n1"]] for r in asked} == want and len(want) > 9000
    assert pstats.Stats(profile).total_calls < len(want)
    assert sorted(r["idx"] for r in asked) == list(range(len(want)))
    assert all(r["block"] == 5 for r in rows) and all(r["key"] is None and r["part"] is None and r["payload"] is None for r in asked)
