"""The training-data operators against brute force, on small awkward tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from controlspark.llm import decontam, html_extract, lang_id, line_dedup, lm_bits, lm_score, media, near_dedup, packing, quality, token_counts
from controlspark.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, hub string"


def make_docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", "s", 0, 1, "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = " ".join(rng.choice(vocabulary) for _ in range(150))
    out = [None, "", " \n\t", "one", "One two", base, base, base.upper(), base + " tail"]
    for edits in range(1, 30):
        w = base.split()
        for _ in range(edits % 9):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        out.append(" ".join(w))
    out += [". ".join(" ".join(rng.choice(vocabulary) for _ in range(9)) for _ in range(k)) for k in (1, 5, 900)]
    return list(enumerate(out))


def shingle_sets(texts, k):
    sets = {}
    for i, t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split(r"[ \t-\r]+", w) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return sets


def test_near_duplicates_equal_brute_force(spark, texts):
    sets = shingle_sets(texts, 3)
    parent = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(make_docs(spark, texts), 3, 0.85).collect()}
    assert got == {i: (len(sets[i]), parent[i], parent[i] == i) for i in sets}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, (2, 300), dtype=np.uint64)
    b[:200] = a[:200]
    got = np.mean(near_dedup.superminhash(a, 400) == near_dedup.superminhash(b, 400))
    assert abs(got - 0.5) < 0.08


def test_packing_is_a_partition(spark, texts):
    path = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = packing.pack(make_docs(spark, texts), path).collect()
    ends = {}
    for i, text in texts:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_empty_tables(spark, texts):
    empty = make_docs(spark, texts).where("false")
    assert token_counts.token_counts(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert packing.pack(empty, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert line_dedup.line_report(empty).count() == 0
    assert lm_score.score_texts(empty).count() == 0
    assert decontam.contamination(empty, bench).count() == 0
    assert lang_id.identify(empty, lang_id.fit(empty)).count() == 0
    assert quality.score_quality(empty, quality.fit(empty, labels)).count() == 0
    assert media.text_media(empty).count() == 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    pick = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(n)]
    items = [(i, " ".join(pick(n))) for i, n in enumerate((20, 13, 5, 2, 1, 40))] + [(7, None), (8, "..")]
    docs = [(i, " ".join(pick(30) + rng.choice(items[:6])[1].upper().split() + pick(i))) for i in range(30)] + [(90, None), (91, "")]
    windows = {}
    for i, t in items:
        w = [x for x in (t or "").split() if x.isalnum()]
        m = min(13, len(w))
        for j in range(len(w) - m + 1) if w else ():
            windows.setdefault(tuple(w[j : j + m]), set()).add(str(i))
    got = {r.doc_id: r for r in decontam.contamination(make_docs(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for i, t in docs:
        w, hit, of = (t or "").lower().split(), set(), set()
        for text, names in windows.items():
            for j in range(len(w) - len(text) + 1):
                if tuple(w[j : j + len(text)]) == text:
                    hit |= set(range(j, j + len(text)))
                    of |= names
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(of))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(of)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_lm_base_score(spark, texts):
    rows = {r.doc_id: r for r in lm_score.score_texts(make_docs(spark, texts)).collect()}
    split = lambda t: [x for x in __import__("re").split(r"[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x] + [None]
    train = [x for i, t in texts if zlib.crc32(str(i).encode()) % 5 != 1 for x in split(t)]
    counts = {x: train.count(x) for x in set(train)}
    for i, t in texts:
        own = split(t)
        base = sum(math.log10((counts.get(x, 0) + 0.5) / (len(train) + 0.5 * (len(counts) + 1))) for x in own)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(x in counts for x in own), len(train))
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_media_round_trip(spark, texts):
    for r in media.text_media(make_docs(spark, texts)).collect():
        data = (dict(texts)[r.doc_id] or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_area_resize_equals_means():
    a = np.random.default_rng(0).integers(0, 256, (17, 13))
    assert np.allclose(media.area_resize(a, 8, 9, strip=20), np.kron(a, np.ones((8, 9))).reshape(8, 17, 9, 13).mean(axis=(1, 3)))


def test_trie_scores_equal_a_plain_search():
    v = token_counts.Vocabulary({"▁": -3.0, "▁a": -1.0, "a": -2.0, "b": -2.5, "ab": -2.2, "ba": -2.1, "aba": -4.0})
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))).encode() for _ in range(200)}
    got = v.counts(words)
    for w in words:
        text = "▁" + w.decode()
        best = [(0.0, 0)]
        for i in range(1, len(text) + 1):
            options = [(best[j][0] + v.scores[text[j:i]], best[j][1] + 1) for j in range(i) if text[j:i] in v.scores]
            if text[i - 1] not in v.scores:
                n = len(text[i - 1].encode())
                options.append((best[i - 1][0] + n * v.unknown, best[i - 1][1] + n))
            best.append(max(options, key=lambda x: x[0]))  # the first of equals has the longest last piece
        assert got[w][0] == best[-1][1]


def test_main_text():
    page = """<html><body><nav><a href=x>Menu</a></nav><div class="ad">Buy, now, this.</div><article><header><h1>Title &amp; more</h1></header><p><b>First,
      line<br>and on<p>Second paragraph, of some length, with commas.</p></article><div id=comments><p>Nice, text, indeed, my friend.</p></div><footer>c</footer>"""
    assert html_extract.extract(page) == "Title & more\n\nFirst, line and on\n\nSecond paragraph, of some length, with commas."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>x") == ""
