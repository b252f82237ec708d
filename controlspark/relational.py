"""The driver queries of the catalog operators and their SQL.

The driver's tables stand in for the catalog's: documents for requirements,
benchmark for masters, labels for decisions, events for the audit trail and
region to orders for the parent hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import textnorm as tn
from .operators import corrections, mappings, rules, scoring
from .shipping import ship

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations pages".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def named(spark, d, table, key):
    return read(spark, d, table).select(F.col(key).alias("id"), "text")


def normalize_text(spark, d):
    t = read(spark, d, "documents")
    return t.select("doc_id", tn.field_hash(F.col("text")).alias("field_hash"))


def duplicate_statement(spark, d):
    return rules.duplicate_statements(named(spark, d, "documents", "doc_id"))


def id_set_hash(spark, d):
    return rules.set_hash(read(spark, d, "documents"), "source", "doc_id")


def plan_diff(spark, d):
    t = named(spark, d, "documents", "doc_id")
    parsed = t.select("id", tn.field_hash(F.col("text")).alias("hash"))
    stored = t.where("id % 3 <> 0").select("id", tn.field_hash(F.when(F.col("id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return rules.plan_diff(parsed, stored)


def quarantine_propagation(spark, d):
    r, n, c, o = (read(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    key = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    levels = [
        n.select(key("n", F.col("n_nationkey")).alias("id"), key("r", F.col("n_regionkey")).alias("parent")),
        c.select(key("c", F.col("c_custkey")).alias("id"), key("n", F.col("c_nationkey")).alias("parent")),
        o.select(key("o", F.col("o_orderkey")).alias("id"), key("c", F.col("o_custkey")).alias("parent")),
    ]
    return rules.propagate_quarantine(r.where("r_name = 'ASIA'").select(key("r", F.col("r_regionkey")).alias("id")), levels)


def correction_current(spark, d):
    # A user's events are the revisions of one field; an error withdraws what was set before it.
    e = read(spark, d, "events").select("user_id", "event_type", "event_id")
    return corrections.in_force(e, ["user_id"], "event_id", "error", "event_type").select("user_id", "event_type", "event_id")


def requirement_effective(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("statement"), F.col("p_brand").alias("guidance"))
    line = read(spark, d, "lineitem")
    fixes = line.groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_linestatus").alias("value"), F.min("l_linenumber").alias("n")).where("n > 1").select("id", F.element_at(F.array(F.lit("title"), F.lit("statement"), F.lit("guidance")), (F.col("n") % 3 + 1).cast("int")).alias("field"), "value")
    return corrections.effective(p, fixes, ["title", "statement", "guidance"])


def revision_chain(spark, d):
    t = read(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("revision"), F.when(F.col("role") == "user", "set").otherwise("retire").alias("action"))
    return rules.chain_faults(t, ["id"]).select("id", "revision", F.col("place").cast("bigint").alias("place"))


def tokens_df(spark, d):
    t = named(spark, d, "benchmark", "item_id").select("id", F.explode(F.array_distinct(tn.tokens(F.col("text")))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df"))


def tfidf_topk(spark, d):
    return scoring.top_k(named(spark, d, "benchmark", "item_id"), named(spark, d, "documents", "doc_id"))


def canonical_key(spark, d):
    key = tn.canonical_key(F.col("text"))
    return named(spark, d, "benchmark", "item_id").select("id", key.alias("canonical_key"), F.concat(F.lit("MC-"), F.upper(F.substring(F.sha2(key, 256), 1, 12))).alias("master_id"))


def control_id_canonical(spark, d):
    label = F.concat(F.lit(" ac-0"), (F.col("p_partkey") % 90).cast("string"), F.when(F.col("p_size") > 25, F.concat(F.lit("(0"), F.col("p_size").cast("string"), F.lit(")"))).otherwise(""), F.lit(" "))
    c = tn.canonical_id(label)
    return read(spark, d, "part").select("p_partkey", c.alias("control_id"), F.concat(F.lit("X-REQ-"), F.translate(c, "()", "-")).alias("code"))


def manifest_reconcile(spark, d):
    c = read(spark, d, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.count_distinct("source").alias("sources"))
    return rules.counts_against(c, {"total": 1000, "english": 620, "sources": 20})


def orphan_check(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return rules.orphans(o, read(spark, d, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


def waiver_match(spark, d):
    found = rules.waive(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").where("quality = 1 and toxic = 0"), ["doc_id"])
    return found.select("doc_id", F.when(F.col("waived"), "waived").otherwise("blocking").alias("state"))


def decided(spark, d, when="true"):
    return read(spark, d, "labels").where(when).select(F.col("doc_id").alias("requirement_id"), F.lit("approved").alias("status"))


def unmapped(spark, d):
    return mappings.unmapped(named(spark, d, "documents", "doc_id").select("id"), decided(spark, d)).withColumnRenamed("id", "doc_id")


def coverage(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return mappings.coverage(t, decided(spark, d, "quality = 1"), ("lang",))


def review_queue_page(spark, d):
    t = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id", "left")
    return mappings.page(t, "score", "doc_id", 25, 50)


def search(spark, d):
    return read(spark, d, "documents").where(mappings.matches(["source", "lang", "text"], "Then")).select("doc_id")


def review_report(spark, d):
    t = read(spark, d, "documents").select("lang", "source", F.when(F.col("n_chars") > 1500, "open").otherwise("waived").alias("status"))
    return mappings.report(t, ["lang", "source", "status"])


def broad_masters(spark, d):
    pairs = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return mappings.broad(pairs, "l_suppkey", "p_brand", 5)


def bundle_referential_check(spark, d):
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = read(spark, d, "part").where("p_size > 1").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return mappings.dangling(line, {"l_partkey": parts, "l_suppkey": suppliers}).select("l_orderkey", "l_linenumber")


def upsert_counts(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_size")
    stored = p.where("p_partkey % 4 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return mappings.report(rules.upsert_states(p, stored, ["p_partkey"], ["p_size"]), ["state"])


def vocab_aliases(spark, d):
    name = mappings.in_vocabulary(tn.strip(F.col("c_mktsegment")), {"AUTOMOBILE": "Vehicles", "BUILDING": "Construction", "HOUSEHOLD": "Home"})
    return read(spark, d, "customer").select("c_custkey", name.alias("domain"))


def order_mappings(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("requirement_id"), F.col("o_custkey").alias("master_id"), F.when(F.col("o_orderstatus") == "O", "suggested").otherwise("approved").alias("status"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("master_id"), "c_nationkey", F.when(F.col("c_acctbal") > 0, "approved").otherwise("draft").alias("master_status"))
    return o, c


def open_suggestions(spark, d):
    o, c = order_mappings(spark, d)
    found = mappings.open_suggestions(o, o.select(F.col("o_orderkey").alias("id")), c).join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return found.select("o_orderkey", F.col("master_id").alias("c_custkey"), "n_name")


def blocked_suggestions(spark, d):
    return mappings.blocked_suggestions(*order_mappings(spark, d))


def verify_mismatches(spark, d):
    # A seventh of the stored numbers has been forged.
    t = read(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("actual"), F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("stored"))
    return rules.mismatches(t, {"stored": F.col("actual")}).drop("differs")


def identical_peers(spark, d):
    return rules.identical_peers(named(spark, d, "documents", "doc_id")).withColumnRenamed("id", "doc_id")


def render_parts(spark, d):
    return rules.rendered(read(spark, d, "conversations"), "conv_id", "turn", F.concat("role", F.lit(":")), F.col("text")).select("conv_id", F.sha2("text", 256).alias("sha256"))


def fingerprint(spark, d):
    t = read(spark, d, "documents").select("lang", "doc_id", F.md5("text").alias("hash"))
    return rules.fingerprint(t, "lang", "doc_id", "hash")


def quality_flags(spark, d):
    t = read(spark, d, "part")
    flags = mappings.quality_flags(F.when(F.col("p_size") > 40, "Retain governed evidence demonstrating it").otherwise(F.col("p_name")), F.when(F.col("p_size") % 7 == 0, " EvidenceReview "), F.when(F.col("p_size") % 2 == 0, "AsRequired").otherwise("Annual"), F.col("p_brand"), F.when(F.col("p_size") > 3, F.col("p_type")), F.col("p_size") % 3 == 0)
    return t.select("p_partkey", F.array_join(flags, ",").alias("flags"))


def link_resolution(spark, d):
    target = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("_smt.a"))).otherwise(F.concat(F.lit("r"), (F.col("l_partkey") % 9).cast("string")))
    links = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", target.alias("target"))
    controls = read(spark, d, "part").where("p_size > 20").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).unionByName(read(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("id")))
    references = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return rules.resolved_links(links, controls, references).select("l_orderkey", "l_linenumber", "kind")


def json_payload_read(spark, d):
    x = F.from_json("props", "k bigint")
    return read(spark, d, "events").select("event_id", x["k"].alias("k"))


FRAMES = (
    normalize_text, duplicate_statement, id_set_hash, plan_diff, quarantine_propagation, correction_current, requirement_effective, revision_chain, tokens_df, tfidf_topk, canonical_key,
    control_id_canonical, manifest_reconcile, orphan_check, waiver_match, unmapped, coverage, review_queue_page, search, review_report, broad_masters, bundle_referential_check, upsert_counts,
    vocab_aliases, open_suggestions, blocked_suggestions, verify_mismatches, identical_peers, render_parts, fingerprint, quality_flags, link_resolution, json_payload_read,
)

#: The list that the tokens leave out, written again: the SQL does not take it from the code that it checks.
MEANINGLESS = (
    "a an and are as at be by for from has have in is it its of on or that the their this to with "
    "within which who will shall such than these those into any all each other using use used"
).split()
NORMAL = r"trim(regexp_replace(replace(replace(nfc_normalize(text), chr(160), ' '), chr(8203), ''), '[\s\v\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))"
TOKENS = (
    f"list_transform(list_filter(regexp_extract_all(lower({NORMAL}), '[a-z0-9]+'), lambda x: length(x) >= 3 and x not in (" + ", ".join(f"'{x}'" for x in MEANINGLESS) + ")), "
    "lambda x: case when length(x) > 4 and x like '%ies' then left(x, length(x) - 3) || 'y' when length(x) > 3 and x like '%s' and x not like '%ss' then left(x, length(x) - 1) else x end)"
)
SQL = {
    "normalize_text": f"select doc_id, sha256({NORMAL}) as field_hash from documents",
    "duplicate_statement": f"with n as (select doc_id as id, {NORMAL} as t from documents), g as (select t, list_sort(list(id)) as ids from n where t <> '' group by t having count(*) > 1) select id, ids[1] as first, cast(len(ids) - 1 as bigint) as peers from (select unnest(ids) as id, ids from g)",
    "id_set_hash": "select source, sha256(string_agg(cast(doc_id as varchar), chr(10) order by doc_id)) as ids_sha256 from documents group by source",
    "plan_diff": f"with h as (select doc_id as id, {NORMAL} as t from documents), s as (select doc_id as id, {NORMAL} as t from (select doc_id, case when doc_id % 7 = 0 then text || '!' else text end as text from documents where doc_id % 3 <> 0)) select h.id, case when s.id is null then 'new' when s.t = h.t then 'unchanged' else 'conflict' end as state from h left join s on h.id = s.id",
    "quarantine_propagation": "with recursive p as (select 'n' || n_nationkey as id, 'r' || n_regionkey as parent from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'o' || o_orderkey, 'c' || o_custkey from orders), q as (select p.id from p join region on p.parent = 'r' || r_regionkey where r_name = 'ASIA' union all select p.id from p join q on p.parent = q.id) select id from q",
    "correction_current": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as place from events) where place = 1 and event_type <> 'error'",
    "requirement_effective": "with f as (select l_partkey as id, max(l_linestatus) as v, min(l_linenumber) as n from lineitem group by 1 having min(l_linenumber) > 1) select p_partkey as id, case when n % 3 = 0 then v else p_name end as title, case when n % 3 = 1 then v else p_type end as statement, case when n % 3 = 2 then v else p_brand end as guidance, case when f.id is null then 0 else 1 end as corrected from part left join f on p_partkey = f.id",
    "revision_chain": "with t as (select conv_id as id, turn as revision, case when role = 'user' then 'set' else 'retire' end as action from conversations), w as (select *, row_number() over (partition by id order by revision) as place, lag(action) over (partition by id order by revision) as before from t) select id, revision, place from w where revision <> place or (action = 'retire' and coalesce(before, '') <> 'set')",
    "tokens_df": f"select token, count(*) as df from (select item_id, unnest(list_distinct({TOKENS})) as token from benchmark) group by token",
    "tfidf_topk": f"with m as (select item_id as id, token, count(*) as tf from (select item_id, unnest({TOKENS}) as token from benchmark) group by 1, 2), r as (select doc_id as id, token, count(*) as tf from (select doc_id, unnest({TOKENS}) as token from documents) group by 1, 2), idf as (select token, ln((1 + (select greatest(count(*), 1) from benchmark)) / (1 + count(*))) + 1 as idf from m group by token), "
    "mw as (select m.id, m.token, (1 + ln(tf)) * idf as w from m join idf using (token)), rw as (select r.id, r.token, (1 + ln(tf)) * coalesce(idf, 1.0) as w from r left join idf using (token)), mn as (select id, sqrt(sum(w * w)) as norm from mw group by id), rn as (select id, sqrt(sum(w * w)) as norm from rw group by id), "
    "s as (select rw.id as requirement, mw.id as master, sum(rw.w / rn.norm * (mw.w / mn.norm)) as raw from rw join mw using (token) join rn on rn.id = rw.id join mn on mn.id = mw.id group by 1, 2), k as (select requirement, master, round(raw, 4) as score, row_number() over (partition by requirement order by round(raw, 4) desc, master) as rank from s where raw >= 0.25) select requirement, rank, master, score from k where rank <= 3",
    "canonical_key": f"with k as (select item_id as id, array_to_string(regexp_extract_all(replace(lower({NORMAL}), '&', ' and '), '[a-z0-9]+'), ' ') as canonical_key from benchmark) select id, canonical_key, 'MC-' || upper(left(sha256(canonical_key), 12)) as master_id from k",
    "control_id_canonical": "with l as (select p_partkey, 'AC-' || cast(p_partkey % 90 as varchar) || case when p_size > 25 then '(' || cast(p_size as varchar) || ')' else '' end as control_id from part) select p_partkey, control_id, 'X-REQ-' || replace(replace(control_id, '(', '-'), ')', '') as code from l",
    "manifest_reconcile": "select 'total' as name, count(*) as actual, cast(1000 as bigint) as expected, count(*) <> 1000 as mismatch from documents union all select 'english', count(case when lang = 'en' then 1 end), cast(620 as bigint), count(case when lang = 'en' then 1 end) <> 620 from documents union all select 'sources', count(distinct source), cast(20 as bigint), count(distinct source) <> 20 from documents",
    "orphan_check": "select o_orderkey from orders o where not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_acctbal > 0)",
    "waiver_match": "select d.doc_id, case when l.doc_id is null then 'blocking' else 'waived' end as state from documents d left join (select doc_id from labels where quality = 1 and toxic = 0 group by doc_id) l on d.doc_id = l.doc_id",
    "unmapped": "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "coverage": "select lang, count(*) as total, count(case when l.doc_id is not null then 1 end) as mapped from documents d left join (select doc_id from labels where quality = 1 group by doc_id) l on d.doc_id = l.doc_id group by lang",
    "review_queue_page": "select d.doc_id, l.quality as score from documents d left join labels l on d.doc_id = l.doc_id order by l.quality desc nulls last, d.doc_id limit 25 offset 50",
    "search": "select doc_id from documents where lower(concat_ws(' ', source, lang, text)) like '%then%'",
    "review_report": "select lang, source, case when n_chars > 1500 then 'open' else 'waived' end as status, count(*) as n from documents group by 1, 2, 3",
    "broad_masters": "select l_suppkey, count(distinct p_brand) as families from lineitem join part on l_partkey = p_partkey group by l_suppkey having count(distinct p_brand) > 5",
    "bundle_referential_check": "select l.l_orderkey, l.l_linenumber from lineitem l where not exists (select 1 from part p where p.p_partkey = l.l_partkey and p.p_size > 1) or not exists (select 1 from supplier s where s.s_suppkey = l.l_suppkey and s.s_acctbal > 0)",
    "upsert_counts": "select case when b.p_partkey is null then 'added' when b.size <> a.p_size then 'changed' else 'unchanged' end as state, count(*) as n from part a left join (select p_partkey, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as size from part where p_partkey % 4 <> 0) b on a.p_partkey = b.p_partkey group by 1",
    "vocab_aliases": "select c_custkey, case upper(trim(c_mktsegment)) when 'AUTOMOBILE' then 'Vehicles' when 'BUILDING' then 'Construction' when 'HOUSEHOLD' then 'Home' else c_mktsegment end as domain from customer",
    "open_suggestions": "select o.o_orderkey, c.c_custkey, n.n_name from orders o join customer c on o.o_custkey = c.c_custkey join nation n on n.n_nationkey = c.c_nationkey where o.o_orderstatus = 'O' and c.c_acctbal > 0",
    "blocked_suggestions": "select count(*) as blocked from orders o join customer c on o.o_custkey = c.c_custkey where o.o_orderstatus = 'O' and c.c_acctbal <= 0",
    "verify_mismatches": "select * from (select doc_id, cast(length(text) as bigint) as actual, case when doc_id % 7 = 0 then n_chars + 1 else n_chars end as stored from documents) where actual <> stored",
    "identical_peers": "select a.doc_id, count(*) as peers from documents a join documents b on a.text = b.text and a.doc_id <> b.doc_id group by a.doc_id",
    "render_parts": "select conv_id, sha256(string_agg(line, chr(10) order by turn)) as sha256 from (select conv_id, turn, trim(role || ': ' || coalesce(text, '')) as line from conversations) where line <> '' group by conv_id",
    "fingerprint": "select lang, sha256(string_agg(doc_id || ':' || md5(text), chr(10) order by doc_id)) as sha256 from documents group by lang",
    "quality_flags": "select p_partkey, array_to_string(list_sort(list_filter([case when p_size > 40 or trim(p_name) = '' then 'PLACEHOLDER_EVIDENCE' end, 'PLACEHOLDER_TEST_PROCEDURE', case when p_size % 2 = 0 and p_size % 3 <> 0 then 'UNCONFIRMED_FREQUENCY' end, case when trim(p_brand) = '' then 'EMPTY_OBJECTIVE' end, case when p_size <= 3 then 'EMPTY_DESCRIPTION' end], lambda x: x is not null)), ',') as flags from part",
    "link_resolution": "select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then (case when exists (select 1 from supplier where s_suppkey = l_suppkey and s_acctbal > 0) then 'control' else 'unresolved' end) when l_linenumber % 3 = 1 then (case when exists (select 1 from part where p_partkey = l_partkey and p_size > 20) then 'part' else 'unresolved' end) when l_partkey % 9 in (select r_regionkey from region) then 'reference' else 'unresolved' end as kind from lineitem",
    "json_payload_read": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in FRAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
