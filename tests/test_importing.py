import threading

import pytest
from catalogs import MANIFEST, write
from controlspark.functions.textnorm import field_hash
from controlspark.operators.corrections import curation_of
from controlspark.plans.importing import REQUIREMENT, PlanBlocked, apply_import, open_items, plan_import, verify
from controlspark.plans.store import Store
from controlspark.sources.catalog import read_catalog
from pyspark.sql import functions as F


def other_title(c):
    c["groups"][0]["controls"][0]["title"] = "Other"


def bad_id(c):
    c["groups"][1]["controls"][0]["controls"][0]["id"] = "sa_15.12"


def sha(spark, text):
    return spark.range(1).select(field_hash(F.lit(text))).first()[0]


def entry(spark, control, field, value, published, **more):
    return {"framework_version": "5.2.0", "control_id": control, "field": field, "value": value, "source_value_sha256": sha(spark, published), "problem": "wrong", "citation": "p. 1", "reviewer": "r", "reviewed_at": "2024-01-01"} | more


TWIN = "Test the system with care."


def test_import(spark, tmp_path):
    parsed, store = read_catalog(spark, write(tmp_path)), Store(spark, f"file://{tmp_path}/store")
    want = {"new": 5, "unchanged": 0, "conflict": 0, "quarantined": 2, "waived": 0, "warnings": 1, "blockers": 0}
    assert plan_import(parsed, store, MANIFEST).summary() == want and store.head() == 0
    assert apply_import(parsed, store, "me", MANIFEST) == want | {"added": 5}
    assert (store.read("requirement", REQUIREMENT).count(), open_items(store).count(), verify(parsed, store).count()) == (5, 2, 0)
    assert apply_import(parsed, store, "me", MANIFEST)["unchanged"] == 5
    assert (store.read("requirement", REQUIREMENT).count(), open_items(store).count()) == (5, 2)
    with pytest.raises(PlanBlocked, match="active: catalog has 6"):
        apply_import(parsed, store, "me", {"expected": {"active": 9}})
    changed = read_catalog(spark, write(tmp_path, other_title))
    with pytest.raises(PlanBlocked, match="SOURCE_CHANGED"):
        apply_import(changed, store, "me", MANIFEST)
    assert ("AC-1", "stored content differs from the source file") in [tuple(r) for r in verify(changed, store).collect()]


def test_corrections_are_decided(spark, tmp_path):
    parsed, store = read_catalog(spark, write(tmp_path)), Store(spark, f"file://{tmp_path}/store")
    first = curation_of(spark, {"corrections": [entry(spark, "SA-15(13)", "statement", " Test the parts. ", TWIN), entry(spark, "AC-2", "title", "Accounts", "Accounts"), entry(spark, "AC-1", "statement", "x", "a. Write [named people] rules; and 1. Choose [team [named people] | office | site]."), entry(spark, "SA-15", "title", "x", "nothing of that kind")]})
    plan = plan_import(parsed, store, MANIFEST, first)
    states = {(r.control_id, r.state) for r in plan.corrections.notes.collect()}
    assert states == {("SA-15(13)", "new"), ("AC-2", "no_change"), ("AC-1", "clauses"), ("SA-15", "stale")}
    assert {r.control_id for r in plan.held.collect()} >= {"AC-1", "AC-2", "SA-15"}
    for wrong in ({"corrections": [entry(spark, "AC-1", "kind", "x", "y")]}, {"corrections": [entry(spark, "AC-1", "title", "", "y")]}, {"waivers": [{}]}, {"corrections": [], "overrides": [1]}):
        with pytest.raises(ValueError):
            curation_of(spark, wrong)


def test_bad_ids_are_held_back(spark, tmp_path):
    parsed, store = read_catalog(spark, write(tmp_path, bad_id)), Store(spark, f"file://{tmp_path}/store")
    apply_import(parsed, store, "me")
    assert [(r.control_id, r.code, r.message) for r in open_items(store).collect()] == [("sa_15.12", "BAD_ID", "cannot canonicalise OSCAL id 'sa_15.12'")]


def test_a_late_writer_adds_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(3)
    assert store.commit(0, {"t": rows}) and not store.commit(0, {"t": rows})
    assert (store.head(), store.read("t", "id bigint").count()) == (1, 3)
    (tmp_path / "store/commits/.left-by-a-crash").write_text("")
    assert store.read("t", "id bigint").count() == 3


def test_four_writers(spark, tmp_path):
    store, done = Store(spark, f"file://{tmp_path}/store"), []
    write_one = lambda i: done.append(store.change(lambda head: {"t": spark.createDataFrame([(i, head)], "id bigint, head bigint")}))
    threads = [threading.Thread(target=write_one, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [1, 2, 3, 4] and sorted(tuple(r)[0] for r in store.read("t", "id bigint, head bigint").collect()) == [0, 1, 2, 3]


def test_changed_fields_are_found(spark, tmp_path):
    parsed, store = read_catalog(spark, write(tmp_path)), Store(spark, f"file://{tmp_path}/store")
    rows = parsed.controls.drop("catalog").withColumn("statement", F.when(F.col("control_id") == "AC-2", "forged").otherwise(F.col("statement"))).withColumns({"id": F.col("ordinal"), "run": F.lit(1).cast("bigint")})
    store.commit(0, {"requirement": rows.where("control_id not like 'SA-15(%'")})
    assert [tuple(r) for r in verify(parsed, store).collect()] == [("AC-2", "stored fields no longer match the content hash")]
