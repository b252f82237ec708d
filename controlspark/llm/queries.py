"""The driver queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_extract, lang_id, line_dedup, lm_score, media, near_dedup, packing, quality, token_counts
from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, similarity=0.85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.identify(docs, lang_id.fit(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html, op2_media, op3_token_counts, op4_near_dedup, op5_packing, op6_line_dedup, op7_language, op8_decontamination, op9_lm_score, op10_quality, pipeline)
    return {f.__name__: f for f in own}


#: Words as in op4; shingles of three, links by the shingles that two sets share, components by a recursion.
NEAR_SQL = r"""
with recursive
words as (select doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+', ' ', 'g'), '[^ ]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
sizes as (select doc_id, len(s) as n, case when len(s) > 0 then md5(array_to_string(list_sort(s), chr(10))) end as same from sets),
first as (select same, min(doc_id) as doc_id from sizes where same is not null group by same),
items as (select doc_id, unnest(s) as x from sets where doc_id in (select doc_id from first)),
rare as (select x from items group by x having count(*) > 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from (select * from items where x in (select x from rare)) a join items b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * common >= 85 * (p.n + q.n - common)),
edges as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
least as (select a as doc_id, least(a, min(b)) as component_id from reach group by a)
select s.doc_id, cast(s.n as bigint) as n_shingles, coalesce(l.component_id, f.doc_id, s.doc_id) as component_id, coalesce(l.component_id, f.doc_id, s.doc_id) = s.doc_id as kept
from sizes s left join first f on s.same = f.same left join least l on l.doc_id = f.doc_id
"""

CONTAMINATION_SQL = r"""
with
dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, least(13, len(w)) as m, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) as t from bw where len(w) > 0),
sizes as (select distinct m from windows),
places as (select doc_id, m, unnest(range(1, len(w) - m + 2)) as i, w from dw, sizes where len(w) >= m),
found as (select p.doc_id, p.i, p.m, x.item_id from places p join windows x on x.m = p.m and x.t = array_to_string(p.w[p.i : p.i + p.m - 1], ' ')),
hits as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from found) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') as items from found group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit, cast(coalesce(i.n_items, 0) as bigint) as n_items,
       sha256(coalesce(i.items, '')) as items_sha256, coalesce(h.n_hit > 0 and 20 * h.n_hit >= len(d.w), false) as contaminated
from dw d left join hits h using (doc_id) left join items i using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": NEAR_SQL, "op6_line_dedup": line_dedup.ORACLE_SQL, "op8_decontamination": CONTAMINATION_SQL}
