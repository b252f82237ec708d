"""Masters and mappings as stored records: drafts, approvals, suggestions and decisions.

Each change is one commit that appends new versions of the rows it concerns and
audit rows. What it depends on is read from the commit before it, and the change
is made anew if another writer commits first, so two writers can't both create a
name or decide a mapping.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.textnorm import canonical_key
from ..operators import mappings as queries
from ..operators.scoring import evidence_terms, top_k
from ..operators.vocabulary import FIELDS, Vocabulary
from .importing import REQUIREMENT, effective_requirements, now
from .store import Store

TEXTS = ("objective", "description", "evidence", "test_procedure")
MASTER = "id string, canonical_key string, name string, objective string, description string, domain string, frequency string, control_type string, evidence string, test_procedure string, status string, created_by string, created_at string, approved_by string, approved_at string, source string, quality_flags array<string>, seq bigint"
MAPPING = "id bigint, requirement_id bigint, master_id string, status string, score double, evidence string, relationship string, rationale string, is_primary int, reviewer string, reviewed_at string, seq bigint"
#: Fixed values.
RELATIONSHIPS = ("equivalent", "subset", "superset", "intersects")
#: Masters that score this or more against a new one are held for a reason why it differs.
NEAR = 0.80


class DuplicateSuspect(Exception):
    """Stored masters are nearly the same; ``candidates`` has (id, score)."""

    def __init__(self, candidates: list[tuple[str, float]]):
        self.candidates = candidates
        super().__init__("; ".join(f"{i} ({s:.2f})" for i, s in candidates))


def masters(store: Store, status: str | None = None, head: int | None = None) -> DataFrame:
    rows = store.current("master_control", MASTER, ["id"], head)
    return rows.where(F.col("status") == status) if status else rows


def mapped(store: Store, status: str | None = None, head: int | None = None) -> DataFrame:
    rows = store.current("mapping", MAPPING, ["requirement_id", "master_id"], head)
    return rows.where(F.col("status") == status) if status else rows


def _audit(store: Store, actor: str, action: str, entity: str, id: str, detail: Mapping) -> DataFrame:
    text = json.dumps(detail, sort_keys=True, ensure_ascii=False)
    return store.spark.range(1).select(now().alias("at"), *[F.lit(x).alias(n) for n, x in (("actor", actor), ("action", action), ("entity", entity), ("entity_id", id), ("detail_json", text))])


def _rows(store: Store, schema: str, values: Mapping) -> DataFrame:
    names = store.read("", schema, 0).columns
    return store.spark.createDataFrame([tuple(values.get(n) for n in names)], schema)


def _flags(store: Store, values: Mapping, confirmed: bool) -> list[str]:
    c = {k: F.lit(values.get(k)).cast("string") for k in (*TEXTS, "frequency")}
    found = queries.quality_flags(c["evidence"], c["test_procedure"], c["frequency"], c["objective"], c["description"], F.lit(confirmed))
    return list(store.spark.range(1).select(found.alias("x")).first().x)


def _key(store: Store, name: str, prefix: str) -> tuple[str, str]:
    """The canonical key of a name and the id that it gives on every machine."""
    key = canonical_key(F.lit(name))
    r = store.spark.range(1).select(key.alias("key"), F.upper(F.substring(F.sha2(key, 256), 1, 12)).alias("id")).first()
    return r.key, prefix + r.id


def _same(store: Store, text: str, head: int) -> list[tuple[str, float]]:
    others = masters(store, head=head).select("id", F.concat_ws(" ", "name", "objective").alias("text"))
    new = store.spark.createDataFrame([("new", text)], "id string, text string")
    return [(r.master, r.score) for r in top_k(others, new, 3, NEAR).orderBy("rank").collect()]


def _add(store: Store, actor: str, values: dict, flags: list[str], source: str, reason: str, guard: bool, prefix: str = "") -> str:
    key, own = _key(store, values["name"], prefix)
    values = values | {"id": values.get("id") or own}

    def make(head: int) -> dict[str, DataFrame]:
        taken = masters(store, head=head).where((F.col("id") == values["id"]) | (F.col("canonical_key") == key)).first()
        if taken:
            raise ValueError(f"master control {taken.id!r} has this id or name already")
        if guard and not reason.strip() and (near := _same(store, f"{values['name']} {values['objective']}", head)):
            raise DuplicateSuspect(near)
        at = store.spark.range(1).select(now().alias("x")).first().x
        row = _rows(store, MASTER, values | {"canonical_key": key, "status": "draft", "created_by": actor, "created_at": at, "source": source, "quality_flags": flags, "seq": head + 1})
        audit = _audit(store, actor, "master.create", "master_control", values["id"], values | {"source": source, "flags": flags})
        if reason.strip():
            audit = audit.unionByName(_audit(store, actor, "master.distinct_reason", "master_control", values["id"], {"reason": reason}))
        return {"master_control": row.coalesce(1), "audit_log": audit.coalesce(1)}

    store.change(make)
    return values["id"]


def create_master(store: Store, actor: str, vocabulary: Vocabulary, *, name: str, objective: str, description: str, domain: str, frequency: str, control_type: str, evidence: str = "", test_procedure: str = "", master_id: str = "", distinct_from_reason: str = "", id_prefix: str = "MC-") -> str:
    """Stores a draft and returns its id.

    All texts are required, placeholders are refused, and so is a master that a
    stored one nearly equals, unless a reason says how it differs. Without an id
    of its own it gets id_prefix and twelve digits of its name's hash.
    """
    values = {k: (v or "").strip() for k, v in {"name": name, "objective": objective, "description": description, "evidence": evidence, "test_procedure": test_procedure}.items()}
    for k in ("name", "objective", "description"):
        if not values[k]:
            raise ValueError(f"{k} is required")
    if not values["evidence"] or not values["test_procedure"]:
        raise ValueError("evidence and test_procedure are required (no boilerplate defaults)")
    values |= {k: vocabulary.value(k, v) for k, v in zip(FIELDS, (domain, frequency, control_type), strict=True)}
    if flags := _flags(store, values, True):
        raise ValueError(f"placeholder values are not allowed for new master controls: {flags}")
    return _add(store, actor, values | {"id": master_id}, [], "manual", distinct_from_reason, True, id_prefix)


def import_legacy_master(store: Store, actor: str, vocabulary: Vocabulary, legacy: Mapping) -> list[str]:
    """Stores an older master as a draft under its own id; returns what keeps it from approval."""
    values = {k: (legacy.get(k) or "").strip() for k in ("name", *TEXTS)} | {k: vocabulary.value(k, legacy.get(k)) for k in FIELDS}
    flags = _flags(store, values, False)
    _add(store, actor, values | {"id": legacy["id"]}, flags, "legacy-workbook", "", False)
    return flags


def _change_master(store: Store, actor: str, id: str, action: str, change) -> None:
    """change gives the new values and the audit's detail from the stored row."""

    def make(head: int) -> dict[str, DataFrame]:
        row = masters(store, head=head).where(F.col("id") == id).first()
        if row is None:
            raise ValueError(f"unknown master control {id!r}")
        values, detail = change(row.asDict())
        if row.status != "draft":
            raise ValueError(f"{id!r} is not a draft master control")
        new = _rows(store, MASTER, row.asDict() | values | {"seq": head + 1})
        return {"master_control": new.coalesce(1), "audit_log": _audit(store, actor, action, "master_control", id, detail).coalesce(1)}

    store.change(make)


def update_master(store: Store, actor: str, vocabulary: Vocabulary, master_id: str, **fields: str | None) -> list[str]:
    """Changes a draft's fields; returns the flags that are left. Empty values change nothing; a frequency that is given counts as confirmed."""
    given = {k: v.strip() for k, v in fields.items() if v is not None and v.strip()}
    if not given or set(given) - {*TEXTS, *FIELDS}:
        raise ValueError(f"changes must be a non-empty subset of {sorted({*TEXTS, *FIELDS})}")
    given |= {k: vocabulary.value(k, given[k]) for k in FIELDS if k in given}
    flags: list[str] = []

    def change(row: dict) -> tuple[dict, dict]:
        flags[:] = _flags(store, row | given, "frequency" in given)
        return given | {"quality_flags": list(flags)}, {"changes": given, "flags": list(flags)}

    _change_master(store, actor, master_id, "master.update", change)
    return flags


def approve_master(store: Store, actor: str, master_id: str, four_eyes: bool = True) -> None:
    """Approves a draft without flags; four_eyes: by someone who did not create it."""
    if not (actor or "").strip():
        raise ValueError("an approver is required")

    def change(row: dict) -> tuple[dict, dict]:
        if row["quality_flags"]:
            raise ValueError(f"cannot approve while quality flags are open: {row['quality_flags']}")
        if four_eyes and row["created_by"] == actor:
            raise ValueError("four-eyes rule: a different person must approve this master control")
        at = store.spark.range(1).select(now().alias("x")).first().x
        return {"status": "approved", "approved_by": actor, "approved_at": at}, {}

    _change_master(store, actor, master_id, "master.approve", change)


def suggest(store: Store, code: str, version: str, least: float = 0.25, k: int = 3) -> int:
    """Stores the best approved masters of each active requirement that has no approved mapping; how many pairs are new. Stored pairs are never changed."""
    run = [0]

    def make(head: int) -> dict[str, DataFrame]:
        known = mapped(store, head=head)
        rows = effective_requirements(store, head).where((F.col("framework_code") == code) & (F.col("framework_version") == version) & (F.col("status") == "active"))
        rows = queries.unmapped(rows, known).select("id", F.concat_ws(" ", "title", "statement").alias("text"))
        texts = masters(store, "approved", head).select("id", F.concat_ws(" ", "name", "objective", "description").alias("text"))
        found = top_k(texts, rows, k, least)
        found = found.join(evidence_terms(texts, rows, found), ["requirement", "master"]).select(F.col("requirement").alias("requirement_id"), F.col("master").alias("master_id"), "score", "evidence")
        found = found.join(known.select("requirement_id", "master_id"), ["requirement_id", "master_id"], "left_anti")
        last = known.agg(F.max("id")).first()[0] or 0
        missing = {n: F.lit(None) for n in ("relationship", "rationale", "reviewer", "reviewed_at")}
        found = found.withColumns(missing | {"id": F.monotonically_increasing_id() + last + 1, "status": F.lit("suggested"), "is_primary": F.lit(0), "seq": F.lit(head + 1)})
        empty = store.read("mapping", MAPPING, 0)
        run[0] = head + 1
        return {"mapping": found.select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])}

    number = store.change(make)
    return store.read("mapping", MAPPING, number).where((F.col("seq") == run[0]) & (F.col("status") == "suggested")).count()


def _decided(decision: str, reviewer: str, relationship: str | None, rationale: str, primary: bool) -> dict:
    if decision not in ("approved", "rejected"):
        raise ValueError("decision must be approved or rejected")
    if not (reviewer or "").strip():
        raise ValueError("a reviewer is required")
    approved = decision == "approved"
    if approved and relationship not in RELATIONSHIPS:
        raise ValueError(f"relationship must be one of {RELATIONSHIPS}")
    if not rationale.strip():
        raise ValueError("a rationale is required")
    return {"status": decision, "relationship": relationship if approved else None, "rationale": rationale, "is_primary": int(primary and approved), "reviewer": reviewer}


def _decide(store: Store, head: int, row: dict, values: dict, given: Mapping) -> dict[str, DataFrame]:
    at = store.spark.range(1).select(now().alias("x")).first().x
    new = _rows(store, MAPPING, row | values | {"reviewed_at": at, "seq": head + 1})
    audit = _audit(store, values["reviewer"], f"mapping.{values['status']}", "mapping", str(row["id"]), given)
    return {"mapping": new.coalesce(1), "audit_log": audit.coalesce(1)}


def decide_mapping(store: Store, mapping_id: int, decision: str, reviewer: str, relationship: str | None = None, rationale: str = "", primary: bool = False) -> None:
    """Approves or rejects a suggestion; one that is decided already stays as it is (ValueError)."""
    values = _decided(decision, reviewer, relationship, rationale, primary)

    def make(head: int) -> dict[str, DataFrame]:
        row = mapped(store, head=head).where(F.col("id") == mapping_id).first()
        if row is None or row.status != "suggested":
            raise ValueError(f"mapping {mapping_id} is not awaiting review")
        return _decide(store, head, row.asDict(), values, {"relationship": relationship, "rationale": rationale, "primary": primary})

    store.change(make)


def map_requirement(store: Store, code: str, version: str, control_id: str, master_id: str, reviewer: str, relationship: str, rationale: str, primary: bool = False) -> None:
    """A mapping that a reviewer makes: suggested, if it was not, and approved in one commit."""
    values = _decided("approved", reviewer, relationship, rationale, primary)

    def make(head: int) -> dict[str, DataFrame]:
        own = store.read("requirement", REQUIREMENT, head).where((F.col("framework_code") == code) & (F.col("framework_version") == version) & (F.col("control_id") == control_id)).select("id").first()
        if own is None:
            raise ValueError(f"unknown requirement {control_id}")
        if masters(store, head=head).where(F.col("id") == master_id).isEmpty():
            raise ValueError(f"unknown master control {master_id!r}")
        known = mapped(store, head=head)
        row = known.where((F.col("requirement_id") == own.id) & (F.col("master_id") == master_id)).first()
        if row and row.status != "suggested":
            raise ValueError(f"this requirement/master pair is already {row.status}")
        last = known.agg(F.max("id")).first()[0] or 0
        fresh = {"id": last + 1, "requirement_id": own.id, "master_id": master_id, "evidence": "manual"}
        return _decide(store, head, row.asDict() if row else fresh, values, {"relationship": relationship, "rationale": rationale, "primary": primary})

    store.change(make)


def review_queue(store: Store, query: str = "", limit: int = 25, offset: int = 0, head: int | None = None) -> DataFrame:
    """A page of the suggestions whose master is approved, by falling score, then id; the query is sought in control id, title and master."""
    names = masters(store, "approved", head).select(F.col("id").alias("master_id"), F.col("name").alias("master"), "objective", F.lit("approved").alias("master_status"))
    rows = effective_requirements(store, head).select("id", "control_id", "title", "statement", "corrected")
    pairs = mapped(store, head=head).select("id", "requirement_id", "master_id", "status", "score", "evidence")
    found = queries.open_suggestions(pairs, rows, names).drop("status", "master_status")
    return queries.page(found.where(queries.matches(["control_id", "title", "master"], query)), "score", "id", limit, offset)
