"""Corrections: what each entry of a curation file means, the corrections in force, and controls with them laid over.

A correction replaces the text of one field of a control and is written against
the hash of the published text. Decisions are one ``when`` ladder over a join of
entries, published fields and the latest stored revisions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.textnorm import field_hash, normalize_text, strip
from ..sources.catalog import hashes
from .rules import chain_faults  # noqa: F401

# The fields that can be corrected, and the keys that curation entries must have.
FIELDS = ("title", "statement", "guidance")
WAIVER_KEYS = ("framework_version", "control_id", "code", "reason", "reviewer", "reviewed_at")
CORRECTION_KEYS = ("framework_version", "control_id", "field", "value", "source_value_sha256", "problem", "citation", "reviewer", "reviewed_at")
RETIRED_KEYS = ("reviewer", "reviewed_at", "reason")
WAIVER = ", ".join(f"{k} string" for k in WAIVER_KEYS)
ENTRY = ", ".join(f"{k} string" for k in CORRECTION_KEYS) + ", retired struct<reviewer:string,reviewed_at:string,reason:string>"
ISSUES = "severity string, code string, control_id string, message string"
CORRECTION = (
    "framework_code string, framework_version string, control_id string, field string, revision int, action string, value string, source_value_sha256 string, "
    "problem string, citation string, reviewer string, reviewed_at string"
)


@dataclass
class Curation:
    waivers: DataFrame
    entries: DataFrame


def curation_of(spark: SparkSession, doc: dict) -> Curation:
    """The waivers and corrections of a parsed curation file, checked; ``overrides`` is an old name of ``corrections``."""
    if doc.get("overrides") and "corrections" in doc:
        raise ValueError("a curation file has 'corrections' (current) or 'overrides' (the old name), not both")
    lacks = lambda entry, keys: [k for k in keys if not str(entry.get(k, "")).strip()]
    waivers, entries, seen = [], [], set()
    for w in doc.get("waivers", []):
        if gone := lacks(w, WAIVER_KEYS):
            raise ValueError(f"waiver {w.get('control_id')!r} is missing {gone}")
        waivers.append(tuple(str(w[k]) for k in WAIVER_KEYS))
    for e in doc.get("corrections", doc.get("overrides", [])):
        where = f"correction of {e.get('control_id')!r} {e.get('field')!r}"
        if gone := lacks(e, CORRECTION_KEYS):
            raise ValueError(f"{where} is missing {gone}")
        if e["field"] not in FIELDS:
            raise ValueError(f"{where}: field {e['field']!r} cannot be corrected (allowed: {FIELDS})")
        if not re.fullmatch("[0-9a-f]{64}", str(e["source_value_sha256"])):
            raise ValueError(f"{where}: source_value_sha256 must be a 64-character lowercase hex sha256")
        retired = e.get("retired")
        if "retired" in e and (not isinstance(retired, dict) or lacks(retired, RETIRED_KEYS)):
            raise ValueError(f"{where}: 'retired' needs {list(RETIRED_KEYS)}")
        if (key := (e["framework_version"], e["control_id"], e["field"])) in seen:
            raise ValueError(f"{where} appears twice for version {e['framework_version']}")
        seen.add(key)
        entries.append((*(str(e[k]) for k in CORRECTION_KEYS), tuple(str(retired[k]) for k in RETIRED_KEYS) if retired else None))
    return Curation(spark.createDataFrame(waivers, WAIVER).dropDuplicates(["framework_version", "control_id", "code"]), spark.createDataFrame(entries, ENTRY))


def load_curation(spark: SparkSession, path: str | None) -> Curation:
    if not path:
        return curation_of(spark, {})
    with open(path, encoding="utf-8") as f:
        return curation_of(spark, json.load(f))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the highest ``order`` for each key, in one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def in_force(history: DataFrame, keys: list[str], order: str = "revision", retired: str = "retire", action: str = "action") -> DataFrame:
    """The latest row of each key, unless it withdraws what was there."""
    return latest(history, keys, order).where(F.col(action) != retired)


def effective(records: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Records with the corrections in force laid over them: one pivot and one join, whatever the number of fields."""
    wide = current.groupBy("id").pivot("field", fields).agg(F.first("value"))
    joined = records.alias("r").join(wide.alias("c"), "id", "left")
    any_: Column = F.lit(False)
    for f in fields:
        any_ = any_ | F.col(f"c.{f}").isNotNull()
    return joined.select("id", *[F.coalesce(f"c.{f}", f"r.{f}").alias(f) for f in fields], any_.cast("int").alias("corrected"))


def clause_problem(clauses: Column) -> Column:
    """Why a statement cannot be replaced; null if it can."""
    n = F.size(clauses)
    many = F.concat(F.lit("the statement has "), n.cast("string"), F.lit(" addressable clauses; one replacement text would leave the clauses and the statement saying different things"))
    return F.when(n > 1, many).when((n == 1) & (F.get(clauses, F.lit(0))["label"] != ""), F.lit("the statement is a single labelled clause; the label cannot be carried through a replacement"))


@dataclass
class Resolution:
    notes: DataFrame  #: control_id, field, state, revision: what each entry means
    record: DataFrame  #: rows to append (CORRECTION)
    force: DataFrame  #: rows in force after this run (CORRECTION)
    issues: DataFrame  #: severity, code, control_id, message
    controls: DataFrame  #: the controls with what is in force laid over them, and corrected


def published_fields(controls: DataFrame) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("published")) for f in FIELDS]))
    labels = F.transform(F.filter("parameters", lambda p: F.coalesce(p["label"], F.lit("")) != ""), lambda p: p["label"])
    return controls.select("framework_code", "control_id", "clauses", F.size("parameters").alias("n_parameters"), F.array_join(labels, "\n").alias("labels"), each.alias("f")).select(
        "framework_code", "control_id", "n_parameters", "labels", clause_problem(F.col("clauses")).alias("clause_problem"), "f.*"
    )


def resolve(controls: DataFrame, history: DataFrame, curation: Curation, version: str) -> Resolution:
    """Decides each entry of this version against the published controls and the stored history (CORRECTION) of one framework version."""
    spark, keys = controls.sparkSession, ["control_id", "field"]
    if history.isEmpty() and curation.entries.where(F.col("framework_version") == version).isEmpty():
        none = lambda schema: spark.createDataFrame([], schema)
        return Resolution(none("control_id string, field string, state string, revision int"), none(CORRECTION), none(CORRECTION), none(ISSUES), controls.withColumn("corrected", F.lit(False)))
    last = latest(history.select(CORRECTION_COLUMNS), keys, "revision").coalesce(1).cache()
    published = published_fields(controls).withColumn("published_hash", field_hash(F.col("published"))).coalesce(2).cache()
    was = last.select(*keys, *[F.col(c).alias(f"was_{c}") for c in ("revision", "action", "value", "source_value_sha256", "problem", "citation", "reviewer", "reviewed_at")])
    e = curation.entries.where(F.col("framework_version") == version).join(published, keys, "left").join(was, keys, "left")
    e = e.withColumn("stored_value", F.when(F.col("field") == "title", normalize_text(F.col("value"))).otherwise(strip(F.col("value"))))
    e = e.withColumn("new_hash", field_hash(F.col("stored_value")))
    set_, stale, adopted = F.col("was_action") == "set", F.col("source_value_sha256") != F.col("published_hash"), F.col("new_hash") == F.col("published_hash")
    same = set_ & (F.col("was_value") == F.col("stored_value")) & (F.col("was_source_value_sha256") == F.col("source_value_sha256"))
    for c in ("problem", "citation", "reviewer", "reviewed_at"):
        same = same & (F.col(f"was_{c}") == strip(F.col(c)))
    state = (
        F.when(F.col("published_hash").isNull(), "target_missing")
        .when(F.col("retired").isNotNull() & F.coalesce(set_, F.lit(False)), "retire")
        .when(F.col("retired").isNotNull(), "retired_already")
        .when(stale & adopted, "adopted_upstream")
        .when(stale, "stale")
        .when(adopted, "no_change")
        .when((F.col("field") == "statement") & F.col("clause_problem").isNotNull(), "clauses")
        .when(F.coalesce(same, F.lit(False)), "unchanged")
        .when(F.col("was_revision").isNull(), "new")
        .otherwise("new_revision")
    )
    e = e.withColumn("state", state).withColumn("revision", F.when(F.col("state").isin("retire", "new", "new_revision"), F.coalesce("was_revision", F.lit(0)) + 1).otherwise(F.col("was_revision")))
    e = e.withColumn("low", F.lower(normalize_text(F.col("value")))).coalesce(1).cache()  # a lambda below refers to low, and none may hold the NFC function
    notes = e.select("control_id", "field", "state", "revision")
    retire = e.where("state = 'retire'").select("framework_code", "framework_version", *keys, "revision", F.lit("retire").alias("action"), F.lit("").alias("value"), F.col("was_source_value_sha256").alias("source_value_sha256"), strip(F.col("retired.reason")).alias("problem"), F.lit("").alias("citation"), strip(F.col("retired.reviewer")).alias("reviewer"), strip(F.col("retired.reviewed_at")).alias("reviewed_at"))
    fresh = e.where("state in ('new', 'new_revision')").select("framework_code", "framework_version", *keys, "revision", F.lit("set").alias("action"), F.col("stored_value").alias("value"), "source_value_sha256", *[strip(F.col(c)).alias(c) for c in ("problem", "citation", "reviewer", "reviewed_at")])
    over = e.where("state in ('retire', 'retired_already', 'adopted_upstream', 'new', 'new_revision')").select(*keys)
    kept = last.where("action = 'set'").join(over, keys, "left_anti").select(*CORRECTION_COLUMNS).join(published.select(*keys, "published_hash"), keys, "left")
    orphaned, outdated = kept.where("published_hash is null"), kept.where("published_hash <> source_value_sha256")
    force = kept.where("published_hash = source_value_sha256").select(*CORRECTION_COLUMNS).unionByName(fresh.select(*CORRECTION_COLUMNS))

    def issue(rows: DataFrame, severity: str, code: str, *message: Column | str, about: bool = True) -> DataFrame:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.col("control_id") if about else F.lit(None).cast("string")).alias("control_id"), text.alias("message"))

    at, f = lambda s: e.where(F.col("state") == s), F.col("field")
    stale_rows = issue(at("stale"), "error", "CORRECTION_STALE", "the published ", f, " is not the text this correction was written against; re-review it")
    first = F.row_number().over(Window.partitionBy("control_id").orderBy("field"))
    late = outdated.join(at("stale").select("control_id"), "control_id", "left_anti").withColumn("__n", first).where("__n = 1")
    unnamed = e.where("field = 'statement' and labels <> '' and state in ('unchanged', 'new', 'new_revision')").where(~F.exists(F.split(F.lower("labels"), "\n"), lambda x: F.contains(F.col("low"), F.trim(F.regexp_replace(x, r"\s+", " ")))))
    blocked = force.where("field = 'statement'").join(published.where("field = 'statement' and clause_problem is not null").select("control_id", "clause_problem"), "control_id")
    issues = issue(at("target_missing"), "error", "CORRECTION_TARGET_MISSING", "correction targets ", F.col("control_id"), f", which is not in this catalog ({version}); fix or remove the entry", about=False)
    for more in (
        issue(at("adopted_upstream"), "warning", "CORRECTION_ADOPTED_UPSTREAM", "the published ", f, " now already reads as the corrected text; the correction is not applied (retire it so the record says so)"),
        stale_rows,
        issue(at("no_change"), "error", "CORRECTION_NO_CHANGE", "the corrected ", f, " reads exactly like the published ", f),
        issue(at("clauses"), "error", "CORRECTION_CLAUSES", "cannot correct the statement: ", F.col("clause_problem")),
        issue(unnamed, "warning", "CORRECTION_PARAMETERS_UNREFERENCED", "the control defines ", F.col("n_parameters").cast("string"), " parameter(s) and the corrected statement mentions none of them"),
        issue(orphaned, "warning", "CORRECTION_ORPHANED", "a recorded correction of ", F.col("control_id"), " ", f, " has no control in this catalog", about=False),
        issue(late, "error", "CORRECTION_STALE", "the published ", f, " is not the text the recorded correction (revision ", F.col("revision").cast("string"), ") was written against"),
        issue(blocked, "error", "CORRECTION_CLAUSES", F.col("control_id"), ": ", F.col("clause_problem")),
    ):
        issues = issues.unionByName(more)
    force = force.join(blocked.select("control_id").distinct(), "control_id", "left_anti").select(*CORRECTION_COLUMNS).coalesce(1).cache()
    # Kept, as later plans build on each of them several times.
    return Resolution(notes, retire.select(*CORRECTION_COLUMNS).unionByName(fresh.select(*CORRECTION_COLUMNS)).coalesce(1).cache(), force, issues.coalesce(1).cache(), laid_over(controls, force).coalesce(2).cache())


CORRECTION_COLUMNS = [x.split()[0] for x in CORRECTION.split(", ")]


def laid_over(controls: DataFrame, force: DataFrame) -> DataFrame:
    """The controls with the corrections in force; a corrected statement is its single clause's text too. Adds corrected."""
    wide = force.groupBy("control_id").pivot("field", list(FIELDS)).agg(F.first("value"))
    named = wide.select("control_id", *[F.col(f).alias(f"__{f}") for f in FIELDS])
    out = controls.join(named, "control_id", "left")
    clauses = F.when(F.col("__statement").isNotNull(), F.transform("clauses", lambda c: c.withField("text", F.col("__statement")))).otherwise(F.col("clauses"))
    out = out.withColumn("corrected", F.coalesce(*[F.col(f"__{f}") for f in FIELDS]).isNotNull()).withColumn("clauses", clauses)
    for f in FIELDS:
        out = out.withColumn(f, F.coalesce(f"__{f}", f))
    return out.drop(*[f"__{f}" for f in FIELDS])


def rehashed(controls: DataFrame) -> DataFrame:
    """The controls with the hashes of what they say now."""
    columns = [c for c in controls.columns if c not in ("content_sha256", "obligation_sha256")]
    kinds = {f.name: f.dataType for f in controls.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in ["control_id", "content_sha256", "obligation_sha256"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [hashes(json.loads(x)) for x in batch["record"]]
            yield pd.DataFrame({"control_id": batch["control_id"], "content_sha256": [a for a, _ in found], "obligation_sha256": [b for _, b in found]})

    records = controls.select("control_id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("record"))
    return controls.drop("content_sha256", "obligation_sha256").join(records.mapInPandas(run, schema), "control_id")
