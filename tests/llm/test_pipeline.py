"""Each stage of the corpus pipeline against a brute-force version on the rows it was given."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pytest
from controlspark.llm import queries
from controlspark.llm.line_dedup import ORACLE_LINES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [(docs.columns, docs.toPandas())]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Scratch(spark, "test").save(name, stage(spark, docs, SF))
        out.append((docs.columns, docs.toPandas()))
    return out


def texts(step):
    return {int(d): t or "" for d, t in zip(step[1].doc_id, step[1].text, strict=True)}


def grams(text):
    words = ("\0" + w + "\0" for w in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text.lower())))
    return [w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def test_columns_stay(steps):
    for columns, _ in steps[1:5]:
        assert columns == steps[0][0]


def test_language(steps):
    seen, count = Counter(), defaultdict(Counter)
    for d, t, lang in zip(steps[0][1].doc_id, steps[0][1].text, steps[0][1].lang, strict=True):
        if t is not None and isinstance(lang, str) and zlib.crc32(str(d).encode()) % 5:
            seen[lang] += 1
            count[lang].update(set(grams(t)))
    most = {g: max(count[x][g] / seen[x] for x in seen) for g in set().union(*count.values())}
    kept = texts(steps[1])
    for d, t in texts(steps[0]).items():
        g = grams(t)
        if not any(c.isalpha() for c in t):
            assert d not in kept
            continue
        share = max(sum(x in most and 0 < count[y][x] / seen[y] >= 0.1 * most[x] - 1e-12 for x in g) / len(g) for y in seen)
        if abs(share - corpus_pipeline.LEAST_COVERAGE) > 0.01:
            assert (d in kept) == (share >= corpus_pipeline.LEAST_COVERAGE), (d, share)
            if d in kept:
                assert kept[d] == t


def test_line_dedup(steps):
    documents = steps[1][1]  # noqa: F841 - read by the SQL
    sql = "with " + ORACLE_LINES.format(documents="documents") + "select l.doc_id, l.lines, r.gone from lines l left join removed r using (doc_id)"
    want = {}
    for d, lines, gone in duckdb.sql(sql).fetchall():
        text = "".join(x for i, x in enumerate(lines) if i not in set(gone or ()))
        if re.search(r"[^ \t\n\x0b\f\r]", text):
            want[d] = text
    assert texts(steps[2]) == want
    assert all(len(t) == n for t, n in zip(steps[2][1].text, steps[2][1].n_chars, strict=True))


def test_near_duplicates(steps):
    sets = {}
    for d, t in texts(steps[2]).items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert set(texts(steps[3])) == {d for d, g in group.items() if d == g}


def test_decontamination(steps):
    con = duckdb.connect()
    con.register("documents", steps[3][1])
    con.execute(f"create view benchmark as from '{SF}/benchmark.parquet'")
    found = {d for d, bad in con.sql(f"select doc_id, contaminated from ({queries.CONTAMINATION_SQL})").fetchall() if not bad}
    assert set(texts(steps[4])) == found


def test_packing(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts(steps[4]).items()}
    pieces = steps[5][1]
    for d, own in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for r in own.itertuples():
            part = ids[d][r.start : r.start + r.length]
            assert (r.start, r.doc_tokens, len(part)) == (at, len(ids[d]), r.length)
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32
            at += r.length
        assert at == len(ids[d])
    assert set(pieces.doc_id) == set(ids)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048


def awkward(spark, rows):
    schema = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").schema
    return spark.createDataFrame(rows, schema).selectExpr("*", "'s' as source", "cast(length(text) as bigint) as n_chars")


def left(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in df.collect())


def numbered_words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_language_decides_on_rows(spark):
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and n_chars > 400").orderBy("doc_id").limit(60).collect()]
    clean, junk = real[0][1], "ЖЖЩ ЪЪЫ ЩЖЪ"
    rows = [*real, (None, clean, None), (None, junk, None), (900, junk, None), (900, clean, None)]
    got = left(corpus_pipeline.keep_languages(spark, awkward(spark, rows), SF))
    assert [x for x in got if x[0] in (-1, 900)] == [(-1, clean), (900, clean)]


def test_line_dedup_cuts_rows_not_ids(spark):
    passage = " ".join(numbered_words(f"p{i}", 6) + "." for i in range(14))
    other = " ".join(numbered_words(f"q{i}", 6) + "." for i in range(20))
    rows = [(1, passage, None), (2, f"{numbered_words('a', 9)}. {passage}", None), (2, other, None), (None, f"{numbered_words('b', 9)}. {passage}", None), (None, numbered_words("c", 9), None)]
    got = left(corpus_pipeline.drop_repeated_lines(spark, awkward(spark, rows), SF))
    assert (1, passage) in got and (2, other) in got and (-1, numbered_words("c", 9)) in got and len(got) == 5
    assert all(len(t) < len(passage) for d, t in got if t.startswith(("a0", "b0")))


def test_near_duplicates_decides_on_rows(spark):
    a, b, c, d, e = (numbered_words(x, 40) for x in "abcde")
    rows = [(1, a, None), (5, b, None), (5, b, None), (5, c, None), (6, d, None), (6, a, None), (None, e, None), (None, e + " tail", None), (None, a, None)]
    got = left(corpus_pipeline.drop_near_duplicates(spark, awkward(spark, rows), SF))
    assert [x for x in got if x[0] > 0] == sorted([(1, a), (5, b), (5, c), (6, d)])
    assert len(got) == 5 and got[0][1] in (e, e + " tail")


def test_decontamination_decides_on_rows(spark):
    bad = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    clean = numbered_words("a", 40)
    rows = [(1, bad, None), (1, clean, None), (None, bad, None), (None, clean, None)]
    assert left(corpus_pipeline.drop_contaminated(spark, awkward(spark, rows), SF)) == [(-1, clean), (1, clean)]


def test_language_names_the_prediction(spark):
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and n_chars > 400").orderBy("doc_id").limit(60).collect()]
    rows = awkward(spark, [*real, (None, real[0][1], None)])
    got = corpus_pipeline.keep_languages(spark, rows, SF)
    assert got.columns == rows.columns and [r.lang for r in got.where("doc_id is null").collect()] == [real[0][2]]


def test_awkward_tables(spark):
    """No rows, no texts, rows that repeat, equal ids and extra columns with names that the operators use."""
    full = awkward(spark, [(1, None, None), (1, "", "en"), (None, " \n", None), (2, numbered_words("a", 30), "en"), (2, numbered_words("a", 30), "en"), (3, numbered_words("a", 30), None)])
    clash = full.selectExpr("*", "1 as block", "'h' as hub", "'k' as key", "2 as `row`", "3 as rank", "array(1) as spans")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (full, clash):
            assert stage(spark, docs.where("false"), SF).count() == 0
        got = stage(spark, clash, SF)
        assert got.columns == clash.columns and got.count() <= clash.count()
    rows = {(d, t) for d, t in ((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, full, SF).collect())}
    assert rows == {(1, None), (1, ""), (None, " \n"), (2, numbered_words("a", 30))}
    assert corpus_pipeline.drop_contaminated(spark, full, SF).count() == 6
    assert corpus_pipeline.pack_windows(spark, full, SF).where("start = 0").count() == 6
