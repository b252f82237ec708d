"""The normal form of texts: the same as Python's, and made without Python workers."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from controlspark import relational
from controlspark.functions import textnorm
from controlspark.operators import rules, scoring

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tfidf_topk", "duplicate_statement", "normalize_text", "plan_diff", "tokens_df", "canonical_key"])
def test_no_python_on_the_executors(spark, name):
    plan = relational.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", plan)


def test_no_catalog_query_needs_python_workers(spark):
    """No query of the catalog, so none that comes to share the normal form either."""
    plans = {name: query(spark, SF)._jdf.queryExecution().executedPlan().toString() for name, query in relational.queries().items()}
    assert [name for name, plan in plans.items() if re.search("Python|Pandas|Arrow", plan)] == []


def test_nfc_equals_pythons(spark):
    known = [c for i in range(0xA0, 0x30000) if unicodedata.category(c := chr(i)) not in ("Cn", "Cs")]
    marks = [c for c in known if unicodedata.combining(c)]
    random.seed(3)
    texts = [None, "", "plain", "e\u0301", "\u00e9", "\u212b", "\u0344", "q\u0323\u0307", "q\u0307\u0323", "\u1112\u1161\u11ab", "\uac00\u11a8", "\ufb01", "\u0958", "\U0001d15e", "\u0301a", "x" * 70000 + "e\u0301"]
    texts += ["".join(random.choices(known, k=3)) for _ in range(2000)] + [unicodedata.normalize("NFD", c) + random.choice(marks) for c in known if unicodedata.decomposition(c)]
    texts += ["".join(random.choices("aeo\u00fc\u0391", k=2) + random.choices(marks, k=3)) for _ in range(2000)]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", textnorm.nfc(F.col("t")).alias("t")).collect()
    assert {r.n: r.t for r in got} == {n: t and unicodedata.normalize("NFC", t) for n, t in enumerate(texts)}


def test_candidates_of_decomposed_texts(spark):
    """A decomposed text has the tokens of the composed one: its marks are part of letters that no token holds."""
    masters = spark.createDataFrame([(1, "re\u0301sum\u00e9 ledger audits"), (2, "badge\u0301 door logs")], "id long, text string")
    composed = spark.createDataFrame([(7, "r\u00e9sume\u0301 ledger"), (8, "badg\u00e9 logs"), (9, None)], "id long, text string")
    plain = lambda df: df.withColumn("text", F.translate("text", "\u00e9", " ")).withColumn("text", F.regexp_replace("text", "e\u0301", " "))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = rows(scoring.top_k(masters, composed))
    assert {x[0] for x in got} == {7, 8} and got == rows(scoring.top_k(plain(masters), plain(composed)))


def test_twins_of_decomposed_texts(spark):
    texts = ["re\u0301sume\u0301", " r\u00e9sum\u00e9\u00a0", "\u212bngstrom", "A\u030angstrom", "resume", None, "\u200b", ""]
    got = rules.duplicate_statements(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, 1), (1, 0, 1), (2, 2, 1), (3, 2, 1)]
