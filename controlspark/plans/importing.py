"""Plan an import, apply it once, and check what is stored against the source."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textnorm import field_hash
from ..operators.corrections import CORRECTION, CORRECTION_COLUMNS, FIELDS, Curation, Resolution, curation_of, laid_over, latest, resolve
from ..operators.rules import chain_faults, waive
from ..operators.validation import quarantined, validate
from ..sources.catalog import CONTROL, Catalog, hashes
from .store import Store

REQUIREMENT = f"id bigint, {CONTROL}, run bigint"
RECORDED = f"{CORRECTION}, recorded_at string, run bigint"
REVIEW = "framework_code string, framework_version string, severity string, code string, control_id string, message string, status string, run bigint, seq bigint"
RUN = "run bigint, at string, actor string, framework_code string, framework_version string, source_sha256 string, summary_json string"
FRAMEWORKS = "code string, version string, title string, oscal_version string, last_modified string, source_sha256 string, imported_at string"
AUDIT = "at string, actor string, action string, entity string, entity_id string, detail_json string"
KEY = ["framework_code", "framework_version", "control_id"]
ITEM = [*KEY, "code"]


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")


class PlanBlocked(Exception):
    """The catalog as a whole, or what is stored already, forbids the import."""


@dataclass
class Plan:
    catalog: Catalog
    issues: DataFrame  #: all, with waived
    held: DataFrame
    #: The published controls that may be stored, with state: new, unchanged or conflict.
    diff: DataFrame
    corrections: Resolution
    record: DataFrame  #: corrections to append: of controls that are, or will be, stored
    head: int
    code: str
    version: str

    def summary(self) -> dict[str, int]:
        count = lambda df, kind: df.select(F.lit(kind).alias("kind"))
        states = self.diff.select(F.col("state").alias("kind"))
        for df, kind in ((self.held, "quarantined"), (self.issues.where("waived"), "waived"), (self.issues.where("severity <> 'error'"), "warnings"), (self.blockers(), "blockers"), (self.corrections.controls.where("corrected"), "corrected"), (self.record, "corrections_to_record")):
            states = states.unionByName(count(df, kind))
        got = {r["kind"]: r["count"] for r in states.groupBy("kind").count().collect()}
        always = {k: got.get(k, 0) for k in ("new", "unchanged", "conflict", "quarantined", "waived", "warnings", "blockers")}
        return always | ({k: got.get(k, 0) for k in ("corrected", "corrections_to_record")} if got.get("corrected") or got.get("corrections_to_record") else {})

    def blockers(self) -> DataFrame:
        """Errors that are of no single control."""
        return self.issues.where("severity = 'error' and control_id is null and not waived")


def plan_import(parsed: Catalog, store: Store, manifest: dict | None = None, curation: Curation | None = None) -> Plan:
    """What an import would do; nothing is written.

    What is stored is the published text; what is checked is that text with the
    corrections in force laid over it. Controls stored but absent from the source
    are left to the manifest. The catalog must be of one framework version.
    """
    spark, head = store.spark, store.head()
    about = parsed.framework.first()
    curation = curation or curation_of(spark, {})
    mine = (F.col("framework_code") == about.code) & (F.col("framework_version") == about.version)
    found = resolve(parsed.controls, store.read("source_correction", RECORDED, head).where(mine), curation, about.version)
    checked = Catalog(parsed.framework, found.controls, parsed.issues, parsed.references)
    issues = validate(checked, manifest).unionByName(found.issues.withColumn("catalog", F.lit(about.catalog)))
    issues = waive(issues, curation.waivers.where(F.col("framework_version") == about.version), ["control_id", "code"]).persist()
    held = quarantined(parsed.controls, issues.where("not waived")).persist()
    stored = store.read("requirement", REQUIREMENT, head).select(*KEY, F.col("content_sha256").alias("stored_sha256"))
    state = F.when(F.col("stored_sha256").isNull(), "new").when(F.col("stored_sha256") == F.col("content_sha256"), "unchanged").otherwise("conflict")
    diff = parsed.controls.join(held, ["catalog", "control_id"], "left_anti").join(stored, KEY, "left").withColumn("state", state)
    record = found.record.join(diff.where("state <> 'conflict'").select("control_id"), "control_id", "left_semi").select(*CORRECTION_COLUMNS)
    return Plan(parsed, issues, held, diff, found, record, head, about.code, about.version)


def review_items(plan: Plan) -> DataFrame:
    """severity, code, control_id, message, status: errors of controls held back are open, waived issues are waived; one row a control and code."""
    parents = plan.held.where(F.array_contains("codes", "PARENT_QUARANTINED")).join(plan.catalog.controls.select("control_id", "parent_id").distinct(), "control_id")
    parents = parents.select(F.lit("error").alias("severity"), F.lit("PARENT_QUARANTINED").alias("code"), "control_id", F.concat(F.lit("parent "), "parent_id", F.lit(" is quarantined")).alias("message"), F.lit("open").alias("status"))
    errors = plan.issues.where("severity = 'error' and not waived").join(plan.held.select("control_id"), "control_id", "left_semi").select("severity", "code", "control_id", "message", F.lit("open").alias("status"))
    waived = plan.issues.where("waived").select("severity", "code", "control_id", "message", F.lit("waived").alias("status"))
    every = errors.unionByName(parents).unionByName(waived)
    return every.groupBy("control_id", "code").agg(F.max(F.struct("status", "severity", "message")).alias("x")).select("x.severity", "code", "control_id", "x.message", "x.status")


def apply_import(parsed: Catalog, store: Store, actor: str, manifest: dict | None = None, curation: Curation | None = None) -> dict[str, int]:
    """Stores new controls, corrections, review items, the framework, the run and its audit rows, in one commit; the plan's summary.

    If another writer commits meanwhile the plan is made anew on what is stored
    then, so importers of one version end with one set of rows. A repeated
    import adds no control. Items that are found no more become resolved.
    """
    spark, done = store.spark, {}

    def make(head: int) -> dict[str, DataFrame]:
        plan = plan_import(parsed, store, manifest, curation)
        summary = plan.summary()
        if summary["blockers"]:
            raise PlanBlocked("; ".join(r.message for r in plan.blockers().select("message").distinct().orderBy("message").limit(20).collect()))
        if summary["conflict"]:
            raise PlanBlocked(f"SOURCE_CHANGED_UNDER_SAME_VERSION: {summary['conflict']} control(s) differ from what was imported for {plan.code}@{plan.version}; publish as a new version or investigate")
        done.update(summary, added=summary["new"])
        run, here = F.lit(head + 1).cast("bigint"), [F.lit(plan.code).alias("framework_code"), F.lit(plan.version).alias("framework_version")]
        top = store.read("requirement", REQUIREMENT, head).agg(F.max("id")).first()[0] or 0
        new = plan.diff.where("state = 'new'").withColumn("run", run)
        new = new.withColumn("id", F.col("ordinal") + 1 + top)  # in document order; numbers of controls held back stay free
        items = review_items(plan).select(*here, "severity", "code", "control_id", "message", "status")
        old = store.current("review_item", REVIEW, ITEM, head).where((F.col("framework_code") == plan.code) & (F.col("framework_version") == plan.version) & (F.col("status") != "resolved"))
        gone = old.join(items, ITEM, "left_anti").withColumn("status", F.lit("resolved")).select(*items.columns)
        text = json.dumps(done, sort_keys=True, separators=(",", ":"))
        audit = spark.range(1).select(now().alias("at"), F.lit(actor).alias("actor"), F.lit("import.apply").alias("action"), F.lit("import_run").alias("entity"), run.cast("string").alias("entity_id"), F.lit(text).alias("detail_json"))
        name = F.concat_ws("/", F.concat("framework_code", F.lit("@"), "framework_version"), "control_id", "field", F.concat(F.lit("r"), F.col("revision").cast("string")))
        decided = plan.record.select(now().alias("at"), F.lit(actor).alias("actor"), F.concat(F.lit("correction."), "action").alias("action"), F.lit("source_correction").alias("entity"), name.alias("entity_id"), F.to_json(F.struct("citation", "problem", "reviewed_at", "reviewer", "source_value_sha256", F.when(F.col("value") != "", field_hash(F.col("value"))).alias("value_sha256")), {"ignoreNullFields": "false"}).alias("detail_json"))
        f = parsed.framework
        known = store.read("framework", FRAMEWORKS, head).select("code", "version")
        tables = {
            "framework": f.select("code", "version", "title", "oscal_version", "last_modified", "source_sha256", now().alias("imported_at")).join(known, ["code", "version"], "left_anti"),
            "requirement": new.select(*store.read("requirement", REQUIREMENT, 0).columns),
            "source_correction": plan.record.select("*", now().alias("recorded_at"), run.alias("run")),
            "review_item": items.unionByName(gone).withColumns({"run": run, "seq": run}),
            "import_run": f.select(run.alias("run"), now().alias("at"), F.lit(actor).alias("actor"), *here, "source_sha256", F.lit(text).alias("summary_json")),
            "audit_log": audit.unionByName(decided),
        }
        return {k: v.coalesce(1) if k != "requirement" else v for k, v in tables.items()}

    store.change(make)
    return done


def open_items(store: Store) -> DataFrame:
    """The review items that nobody waived and that the last run of their framework version still found."""
    return store.current("review_item", REVIEW, ITEM).where("status = 'open'")


def effective_requirements(store: Store, head: int | None = None) -> DataFrame:
    """The stored requirements as all readers see them: published text with the corrections in force laid over it, and corrected (0 or 1)."""
    history = store.read("source_correction", RECORDED, head)
    force = latest(history, [*KEY, "field"], "revision").where("action = 'set'")
    wide = force.groupBy(*KEY).pivot("field", list(FIELDS)).agg(F.first("value")).select(*KEY, *[F.col(f).alias(f"__{f}") for f in FIELDS])
    rows = store.read("requirement", REQUIREMENT, head).join(wide, KEY, "left")
    rows = rows.withColumn("corrected", F.coalesce(*[F.col(f"__{f}") for f in FIELDS]).isNotNull().cast("int"))
    for f in FIELDS:
        rows = rows.withColumn(f, F.coalesce(f"__{f}", f))
    return rows.drop(*[f"__{f}" for f in FIELDS])


def verify(parsed: Catalog, store: Store, curation: Curation | None = None) -> DataFrame:
    """control_id, problem: stored rows that differ from the source or from their hash, broken histories of corrections, and stored controls that would now be held back."""
    plan = plan_import(parsed, store, None, curation)
    mine = (F.col("framework_code") == plan.code) & (F.col("framework_version") == plan.version)
    stored = store.read("requirement", REQUIREMENT, plan.head).where(mine)
    fields = [c for c in stored.columns if c not in ("id", "run")]

    def rehash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = [hashes(json.loads(x))[0] != h for x, h in zip(batch["record"], batch["content_sha256"], strict=True)]
            yield batch.loc[bad, ["control_id"]]

    say = lambda df, text: df.select("control_id", (F.lit(text) if isinstance(text, str) else text).alias("problem"))
    records = stored.select("control_id", "content_sha256", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
    out = say(records.mapInPandas(rehash, "control_id string"), "stored fields no longer match the content hash")
    history = store.read("source_correction", RECORDED, plan.head).where(mine).select(*CORRECTION_COLUMNS)
    last = latest(history, ["control_id", "field"], "revision").where("action = 'set'")
    texts = stored.select("control_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("x")).select("control_id", "x.*")
    other = last.join(texts, ["control_id", "field"]).where(F.col("source_value_sha256") != field_hash(F.col("text")))
    twice = stored.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")
    shown = effective_requirements(store, plan.head).where(mine).select("control_id", *[F.col(f).alias(f"shown_{f}") for f in FIELDS])
    want = laid_over(stored, last).join(shown, "control_id").where(" or ".join(f"not ({f} <=> shown_{f})" for f in FIELDS))
    codes = F.concat(F.lit("stored, but with its corrections its text is now held back: "), F.array_join("codes", ", "))
    for more in (
        say(plan.diff.where("state = 'conflict'"), "stored content differs from the source file"),
        say(twice, "stored more than once"),
        say(chain_faults(history, ["control_id", "field"]), F.concat("field", F.lit(": the correction revisions are not an unbroken sequence of decisions"))),
        say(other, F.concat("field", F.lit(": the correction in force was written against text that is not the stored published text"))),
        say(want, "the effective text served differs from published text plus corrections"),
        say(plan.held.join(stored.select("control_id").distinct(), "control_id", "left_semi"), codes),
    ):
        out = out.unionByName(more)
    return out
