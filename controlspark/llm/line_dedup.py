"""Removal of repeated passages by content-defined chunks of lines; built-in functions only.

A text is cut into lines of a few words: after line ends, after signs that end a
clause and after words that end in certain letters, as most texts have few line
ends. A rolling hash over the hashes of two neighbouring lines decides whether a
chunk ends, so the same passage is cut alike wherever it stands. A chunk of LONG
characters or more whose key occurs again is a candidate. From the chunk of that
length before a candidate to the one after it, every two lines in a row are
compared byte by byte with all others of that kind, which carries a match line by
line to the passage's ends. Of equal ones all but the first (by doc_id, then place) are
removed, where runs of such lines have MIN_CHARS characters or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, own_ids, with_row_keys

#: Characters that a chunk and a run of repeated lines have at least.
LONG, MIN_CHARS = 40, 64
LINE = r"(?s).*?(?:\n|[.!?;:,t%] |[。、，！？])|.+"
#: What ends a line, as in LINE, and a sign that is put after it.
ENDS, CUT = ["\n", *(x + " " for x in ".!?;:,t%"), *"。、，！？"], "\x01"


def _bound(df: DataFrame, *columns: str) -> DataFrame:
    """Adds columns that later lambdas refer to as values; a plain column's expression would be evaluated anew for each element."""
    return df.select("*", F.expr(f"inline(array(struct({', '.join(columns)})))"))


def _hash(c: Column) -> Column:
    return F.xxhash64(c)


def _cut(text: Column) -> Column:
    """The matches of LINE. No end overlaps another, so a sign after each and a plain split give them at little more than half of the pattern's cost; a text that has the sign is cut by the pattern."""
    signed = F.aggregate(F.array(*map(F.lit, ENDS)), text, lambda t, e: F.when(F.contains(t, e), F.replace(t, e, F.concat(e, F.lit(CUT)))).otherwise(t))
    return F.when(F.contains(text, F.lit(CUT)), F.regexp_extract_all(text, F.lit(LINE), F.lit(0))).otherwise(F.array_remove(F.split(signed, CUT), ""))


def _lines(docs: DataFrame) -> DataFrame:
    """The lines, with their ends, in place of the text; other columns stay."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, F.explode(F.array(_cut(F.col("text")))).alias("lines"))


def _chunks(docs: DataFrame) -> DataFrame:
    """doc_id, key, last, low, high: the chunks of LONG characters or more, and the lines from the one before to the one after.

    A row without a key tells the number of a text's last line.
    """
    lines = _bound(_lines(docs), "transform(lines, x -> ascii(md5(x))) as digits", "size(lines) - 1 as end")
    # The rolling hash: the digits of two neighbouring lines; one chunk in two lines.
    lines = _bound(lines, "array_compact(transform(digits, (v, i) -> if(i = end or (coalesce(get(digits, i - 1), 0) + v) % 2 = 0, i, null))) as ends").drop("digits")
    first = "coalesce(get(ends, j - 1), -1) + 1"
    texts = f"transform(ends, (e, j) -> array_join(slice(lines, {first} + 1, e - ({first}) + 1), ''))"
    keys = _bound(lines, f"transform({texts}, t -> if(length(t) >= {LONG}, xxhash64(t), null)) as keys").drop("lines")
    keys = _bound(keys, "array_compact(transform(keys, (x, j) -> if(x is null, null, j))) as longs")
    chunk = "named_struct('key', keys[j], 'last', ends[j], 'low', coalesce(get(ends, coalesce(get(longs, k - 1), 0) - 1), -1) + 1, 'high', coalesce(get(ends, get(longs, k + 1)), end))"
    count = "named_struct('key', cast(null as bigint), 'last', end, 'low', 0, 'high', 0)"
    return keys.select("doc_id", F.expr(f"inline(concat(array({count}), transform(longs, (j, k) -> {chunk})))"))


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_lines and spans: the disjoint runs (first, last) of lines, from 0, that repeat earlier ones; for every row of docs.

    doc_id must tell the rows apart.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = scratch.save("keys", _chunks(docs))
    keys, ends = every.where("key is not null"), scratch.save("ends", every.where("key is null").select("doc_id", "last"))
    # Written, as an aggregate's own partitions can't be dealt anew: both sides of the joins are shuffled, and a hot group is split.
    again = scratch.save("again", keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    near = scratch.save("near", keys.join(again, "key").groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("near")))
    scratch.drop("keys", "again")
    # Only texts with candidates are cut into lines again.
    places = "filter(array_distinct(flatten(transform(near, x -> sequence(x.low, x.high)))), i -> i < size(lines) - 1)"
    pair = "named_struct('line', i, 'text', concat(lines[i], lines[i + 1]), 'a', length(lines[i]), 'b', length(lines[i + 1]))"
    pairs = _bound(_lines(docs.join(near, "doc_id")), f"{places} as places").select("doc_id", F.expr(f"inline(transform(places, i -> {pair}))"))
    pairs = scratch.save("pairs", pairs.withColumn("h", _hash(F.col("text"))))
    scratch.drop("near")
    # Whole texts are grouped; where a hash has one text only, it stands for these bytes from here on.
    groups = pairs.groupBy("h", "text").agg(F.min(F.struct("doc_id", "line")).alias("origin"), F.count("*").alias("n")).select("h", "n", "origin.*")
    firsts = groups.groupBy("h").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.min("doc_id").alias("first_doc"), F.min("line").alias("first_line"))
    firsts = scratch.save("firsts", firsts.where("n > 1").drop("n"))
    scratch.drop()
    elsewhere = "struct(doc_id, line) <> struct(first_doc, first_line)"
    copies = pairs.drop("text").join(firsts.where("texts = 1").drop("texts"), "h").where(elsewhere).select("doc_id", "line", "a", "b")
    shared = firsts.where("texts > 1").select("h")
    if not shared.isEmpty():
        rest = scratch.save("rest", pairs.join(shared, "h", "left_semi").drop("h"))
        origins = rest.groupBy("text").agg(F.min(F.struct("doc_id", "line")).alias("o")).select("text", F.col("o.doc_id").alias("first_doc"), F.col("o.line").alias("first_line"))
        copies = copies.unionByName(rest.join(origins, "text").where(elsewhere).select("doc_id", "line", "a", "b"))
    marked = copies.select("doc_id", F.expr("inline(array(struct(line as line, a as chars), struct(line + 1 as line, b as chars)))")).groupBy("doc_id", "line").agg(F.max("chars").alias("chars"))
    marked = scratch.save("marked", marked)
    scratch.drop("pairs", "firsts", "rest")
    run = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    runs = marked.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum("chars").alias("chars"))
    spans = runs.where(f"chars >= {MIN_CHARS}").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    sizes = docs.select("doc_id").join(ends, "doc_id", "left").select("doc_id", F.coalesce(F.col("last") + 1, F.lit(0)).cast("bigint").alias("n_lines"))
    return sizes.join(spans, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("spans", F.expr("cast(array() as array<struct<first:int,last:int>>)")).alias("spans"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs with their text less the repeated passages; all columns are kept.

    Null texts stay null, empty ones empty. Rows that repeat a doc_id or lack
    one are texts of their own. The first occurrence of a passage stays, in the
    row with the smallest doc_id (rows without one come last) and there at the
    first place; copies in the same row go too. Bytes are compared, white space
    and line ends too. A row that only repeats others becomes empty, not absent. An empty
    table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = with_row_keys(docs, scratch)
    found = repeated_lines(rows.select(F.col("__row").alias("doc_id"), "text"), scratch)
    spans = scratch.save("spans", found.where("size(spans) > 0").select(F.col("doc_id").alias("__row"), F.col("spans").alias("__spans")))
    lines = F.when(F.col("__spans").isNotNull(), _cut(F.col("text")))
    joined = rows.join(spans, "__row", "left").select("*", F.explode_outer(F.array(lines)).alias("__lines"))
    # What stands between the spans: each line is looked at once.
    gaps = "transform(concat(__spans, array(named_struct('first', size(__lines), 'last', 0))), (s, i) -> named_struct('at', coalesce(get(__spans, i - 1).last, -1) + 1, 'end', s.first))"
    kept = F.expr(f"array_join(flatten(transform({gaps}, g -> slice(__lines, g.at + 1, g.end - g.at))), '')")
    columns = [F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines and n_removed (lines that repeat earlier ones) of every row; rows are told apart as in ``dedup_lines``."""
    scratch = Scratch(docs.sparkSession, "lines")
    removed = F.expr("aggregate(spans, 0L, (n, x) -> n + x.last - x.first + 1)").cast("bigint").alias("n_removed")
    if own_ids(docs):
        return repeated_lines(docs.select("doc_id", "text"), scratch).select("doc_id", "n_lines", removed)
    rows = with_row_keys(docs.select("doc_id", "text"), scratch)
    counted = repeated_lines(rows.select(F.col("__row").alias("doc_id"), "text"), scratch).select(F.col("doc_id").alias("__row"), "n_lines", removed)
    return rows.select("__row", F.col("doc_id").cast("bigint").alias("doc_id")).join(counted, "__row").drop("__row")


ORACLE_LINES = rf"""
lines as (select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{LINE}'), lambda x: x <> '') as lines from {{documents}} where doc_id is not null),
hashed as (select doc_id, lines, list_transform(lines, lambda x: ascii(md5(x))) as digits from lines),
cuts as (select doc_id, lines, list_filter(range(0, len(digits)), lambda i: i = len(digits) - 1 or (case when i > 0 then digits[i] else 0 end + digits[i + 1]) % 2 = 0) as ends from hashed),
spans as (
  select doc_id, lines, unnest(list_transform(range(1, len(ends) + 1), lambda j: {{{{
    'first': case when j = 1 then 0 else ends[j - 1] + 1 end, 'last': ends[j],
    'end': len(lines) - 1}}}})) as s from cuts),
bodies as (select doc_id, s, array_to_string(lines[s.first + 1 : s.last + 1], '') as body from spans),
chunks as (select doc_id, body, coalesce(lag(s.first) over (partition by doc_id order by s.first), 0) as low, coalesce(lead(s.last) over (partition by doc_id order by s.first), s.end) as high from bodies where length(body) >= {LONG}),
again as (select body from chunks group by body having count(*) > 1),
places as (select distinct doc_id, unnest(range(low, high + 1)) as i from chunks where body in (select body from again)),
pairs as (select doc_id, i, own[i + 1] || own[i + 2] as t, length(own[i + 1]) as a, length(own[i + 2]) as b from places join (select doc_id, lines as own from lines) using (doc_id) where i < len(own) - 1),
ranked as (select *, row_number() over (partition by t order by doc_id, i) as k from pairs),
marked as (select doc_id, i, max(n) as n from (select doc_id, i, a as n from ranked where k > 1 union all select doc_id, i + 1, b from ranked where k > 1) group by doc_id, i),
runs as (select doc_id, run, list(i) as own, sum(n) as chars from (select *, i - row_number() over (partition by doc_id order by i) as run from marked) group by doc_id, run),
removed as (select doc_id, flatten(list(own)) as gone from runs where chars >= {MIN_CHARS} group by doc_id)
"""

ORACLE_SQL = "with " + ORACLE_LINES.format(documents="documents") + "select l.doc_id, cast(len(l.lines) as bigint) as n_lines, cast(coalesce(len(r.gone), 0) as bigint) as n_removed from lines l left join removed r using (doc_id)"
