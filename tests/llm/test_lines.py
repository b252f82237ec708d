"""How texts are cut into lines."""

import random
import re
import time

from pyspark.sql import functions as F

from controlspark.llm import line_dedup


def test_lines_equal_the_pattern(spark):
    rng = random.Random(3)
    texts = ["", " ", "\n", "\n\n", "t ", "t t  t ", "。。 。", "a\x01b. c\x01 ", "\x01", "end. ", "end.", "no end at all", ". . \n. ", "é% 你好，好！\r\n", "😀? 😀", "$1\\0 t \\", "tt  ,, , "]
    texts += ["".join(rng.choice("at.,;:!?% \n\r。、，！？é你😀\x01$\\") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id bigint, text string")
    got = {r.doc_id: r.lines for r in line_dedup._lines(docs).collect()}
    assert got == {i: re.findall(line_dedup.LINE, x) for i, x in enumerate(texts)} | {len(texts): None}
    assert "".join(got[20]) == texts[20]


def test_cutting_costs_less_than_the_pattern(spark):
    words = "A line of plain words, as many texts have them; it stands here about 50 times. 你好，再见。\nThe next one follows: is it cut? "
    docs = spark.range(6000, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(words), 20)).alias("text"))
    by_pattern = docs.select("doc_id", F.regexp_extract_all("text", F.lit(line_dedup.LINE), F.lit(0)).alias("lines"))
    seconds = {}
    for _ in range(3):
        for name, lines in (("cut", line_dedup._lines(docs)), ("pattern", by_pattern)):
            start = time.perf_counter()
            lines.write.format("noop").mode("overwrite").save()
            seconds[name] = min(seconds.get(name, 1e9), time.perf_counter() - start)
    assert seconds["cut"] < 0.85 * seconds["pattern"]
