"""Issues of parsed controls, reconciliation with a manifest, and the controls that are held back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.textnorm import normalize_text
from ..sources.catalog import Catalog

COLUMNS = ("catalog", "severity", "code", "control_id", "message")
#: Links that name what took a withdrawn control's place (fixed values).
SUCCESSORS = ("incorporated-into", "moved-to")


def _ladder(controls: DataFrame) -> DataFrame:
    """Rules that look at one control: all of them in one pass."""
    active = F.col("status") == "active"
    moved = F.exists("links", lambda x: x["rel"].isin(*SUCCESSORS))
    rules: list[tuple[str, str, Column, str]] = [
        ("error", "EMPTY_TITLE", F.col("title") == "", "control has no title"),
        ("error", "EMPTY_STATEMENT", active & (normalize_text(F.col("statement")) == ""), "active control has no statement text"),
        ("error", "UNRENDERED_PLACEHOLDER", active & (F.contains("statement", F.lit("{{")) | F.contains("guidance", F.lit("{{"))), "unrendered {{ }} placeholder left in text"),
        ("warning", "WITHDRAWN_WITHOUT_SUCCESSOR", ~active & ~moved, "withdrawn control names no successor"),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(m).alias("message"))) for s, c, when, m in rules]))
    return controls.select("catalog", "control_id", F.explode(found).alias("i")).select("catalog", "i.severity", "i.code", "control_id", "i.message")


def _orphans(controls: DataFrame) -> DataFrame:
    known = controls.select("catalog", F.col("control_id").alias("parent_id")).distinct()
    lost = controls.where("kind = 'enhancement'").join(known, ["catalog", "parent_id"], "left_anti")
    message = F.concat(F.lit("parent '"), F.coalesce("parent_id", F.lit("None")), F.lit("' not in catalog"))
    return lost.select("catalog", F.lit("error").alias("severity"), F.lit("ORPHAN_ENHANCEMENT").alias("code"), "control_id", message.alias("message"))


def _twins(controls: DataFrame) -> DataFrame:
    """Each active control whose statement another one has too."""
    text = normalize_text(F.col("statement"))
    groups = controls.where("status = 'active'").select("catalog", "control_id", text.alias("text")).where("text <> ''").groupBy("catalog", F.sha2("text", 256).alias("key")).agg(F.collect_list("control_id").alias("ids")).where(F.size("ids") > 1)
    others = F.array_sort(F.array_remove(F.array_distinct("ids"), F.col("control_id")))
    quoted = F.array_join(F.transform(others, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    message = F.concat(F.lit("statement text is identical to ["), quoted, F.lit("]; verify against the official publication"))
    return groups.select("catalog", "ids", F.explode("ids").alias("control_id")).select("catalog", F.lit("error").alias("severity"), F.lit("DUPLICATE_STATEMENT").alias("code"), "control_id", message.alias("message"))


def reconcile(parsed: Catalog, manifest: dict) -> DataFrame:
    """Global issues (control_id is null) of each catalog against one manifest."""
    c = parsed.controls.groupBy("catalog").agg(
        F.count("*").alias("controls_total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "withdrawn").alias("withdrawn"),
        F.count_if(F.col("kind") == "enhancement").alias("enhancements"), F.sha2(F.array_join(F.array_sort(F.collect_list("control_id")), "\n"), 256).alias("ids_sha256"),
    )
    f = parsed.framework.select("catalog", "version", "source_sha256", "groups").join(c, "catalog", "left").fillna(0, ["controls_total", "active", "withdrawn", "enhancements"])
    f = f.withColumn("ids_sha256", F.coalesce("ids_sha256", F.sha2(F.lit(""), 256)))
    issue = lambda severity, code, when, *message: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat(*message).alias("message")))
    rules = []
    version = manifest.get("framework_version")
    if version is not None:
        rules.append(issue("error", "MANIFEST_VERSION", F.col("version") != version, F.lit(f"manifest is for {version}, catalog is "), F.col("version")))
    for key, want in manifest.get("expected", {}).items():
        have = F.col(key).cast("string") if key in ("controls_total", "active", "withdrawn", "enhancements", "groups") else F.lit("None")
        rules.append(issue("error", "COUNT_MISMATCH", have != str(want), F.lit(f"{key}: catalog has "), have, F.lit(f", manifest expects {want}")))
    if manifest.get("source_sha256"):
        rules.append(issue("warning", "SOURCE_HASH_DIFFERS", F.col("source_sha256") != manifest["source_sha256"], F.lit("catalog file differs from the one the manifest was built from (counts still checked)")))
    if manifest.get("control_ids_sha256"):
        rules.append(issue("error", "ID_SET_MISMATCH", F.col("ids_sha256") != manifest["control_ids_sha256"], F.lit("the set of control ids differs from the manifest")))
    if not rules:
        return parsed.issues.where("false").select(*COLUMNS)
    found = f.select("catalog", F.explode(F.array_compact(F.array(*rules))).alias("i"))
    return found.select("catalog", "i.severity", "i.code", F.lit(None).cast("string").alias("control_id"), "i.message")


def validate(parsed: Catalog, manifest: dict | None = None) -> DataFrame:
    """All issues: those of parsing, of single controls, of controls together, and of the manifest if there is one."""
    out = parsed.issues
    for part in (_ladder(parsed.controls), _orphans(parsed.controls), _twins(parsed.controls), *([reconcile(parsed, manifest)] if manifest else [])):
        out = out.unionByName(part)
    return out.select(*COLUMNS)


def quarantined(controls: DataFrame, issues: DataFrame, waivers: DataFrame | None = None) -> DataFrame:
    """catalog, control_id, codes: controls with errors that no waiver covers, and all enhancements below them.

    An id that cannot be read names no control, and is held back under itself.

    waivers: (framework_version, control_id, code). A control held back for its
    parent has the code PARENT_QUARANTINED. Enhancements of enhancements are
    followed level by level until a level holds back none.
    """
    errors = issues.where("severity = 'error' and control_id is not null").select("catalog", "control_id", "code").distinct()
    if waivers is not None:
        version = controls.select("catalog", "framework_version").distinct()
        errors = errors.join(version, "catalog", "left").join(waivers.select("framework_version", "control_id", "code").distinct(), ["framework_version", "control_id", "code"], "left_anti")
    held = errors.groupBy("catalog", "control_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    below = controls.where("parent_id is not null").select("catalog", "control_id", F.col("parent_id").alias("above")).distinct()
    fresh = held
    while True:
        parents = fresh.select("catalog", F.col("control_id").alias("above"))
        fresh = below.join(parents, ["catalog", "above"], "left_semi").select("catalog", "control_id").distinct().join(held, ["catalog", "control_id"], "left_anti").withColumn("codes", F.array(F.lit("PARENT_QUARANTINED")))
        if fresh.isEmpty():
            return held
        held = held.unionByName(fresh)
