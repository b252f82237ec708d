import pytest
from catalogs import MANIFEST, write
from controlspark.operators.vocabulary import Vocabulary
from controlspark.plans.importing import AUDIT, apply_import
from controlspark.plans.mastering import DuplicateSuspect, approve_master, create_master, decide_mapping, import_legacy_master, map_requirement, mapped, masters, review_queue, suggest, update_master
from controlspark.plans.store import Store
from controlspark.sources.catalog import read_catalog

WORDS = Vocabulary({"domain": ["Identity"], "frequency": ["Annual", "AsRequired"], "control_type": ["Preventive"]}, {"domain": {"Identity and more": "Identity"}, "frequency": {}, "control_type": {}})
KINDS = {"domain": "Identity and more", "frequency": "Annual", "control_type": "Preventive"}
MORE = {"evidence": "a list", "test_procedure": "read it"}


def test_masters_and_mappings(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    apply_import(read_catalog(spark, write(tmp_path)), store, "me", MANIFEST)
    about = store.read("framework", "code string, version string").first()
    with pytest.raises(ValueError, match="evidence and test_procedure"):
        create_master(store, "me", WORDS, name="x", objective="y", description="z", **KINDS)
    with pytest.raises(ValueError, match="controlled vocabulary"):
        create_master(store, "me", WORDS, name="x", objective="y", description="z", **KINDS | {"domain": "other"}, **MORE)
    new = {"name": "Account tools", "objective": "Use tools for accounts", "description": "Tools manage accounts."} | KINDS | MORE
    first = create_master(store, "me", WORDS, **new)
    assert first.startswith("MC-") and masters(store).first().domain == "Identity"
    with pytest.raises(ValueError, match="already"):
        create_master(store, "you", WORDS, **new | {"name": "account  TOOLS"})
    with pytest.raises(DuplicateSuspect):
        create_master(store, "you", WORDS, **new | {"name": "Accounts tool"})
    with pytest.raises(ValueError, match="four-eyes"):
        approve_master(store, "me", first)
    assert suggest(store, about.code, about.version) == 0
    approve_master(store, "you", first)
    with pytest.raises(ValueError, match="not a draft"):
        update_master(store, "me", WORDS, first, evidence="x")
    found = suggest(store, about.code, about.version)
    assert found > 0 and suggest(store, about.code, about.version) == 0
    page = review_queue(store).collect()
    assert len(page) == found and page[0].control_id == "AC-2(1)" and set(page[0].evidence.split(", ")) == {"account", "tool"}
    with pytest.raises(ValueError, match="rationale"):
        decide_mapping(store, page[0].id, "rejected", "me")
    decide_mapping(store, page[0].id, "rejected", "me", rationale="no")
    with pytest.raises(ValueError, match="not awaiting"):
        decide_mapping(store, page[0].id, "rejected", "me", rationale="no")
    with pytest.raises(ValueError, match="already rejected"):
        map_requirement(store, about.code, about.version, "AC-2(1)", first, "me", "subset", "yes")
    map_requirement(store, about.code, about.version, "SA-15", first, "me", "subset", "yes", primary=True)
    approved = mapped(store, "approved").first()
    assert (approved.is_primary, approved.relationship, mapped(store, "suggested").count()) == (1, "subset", found - 1 - (0 if "SA-15" not in {r.control_id for r in page} else 1))
    actions = {r.action for r in store.read("audit_log", AUDIT).collect()}
    assert actions >= {"master.create", "master.approve", "mapping.rejected", "mapping.approved"}


def test_flags_keep_a_legacy_master_from_approval(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    old = {"id": "M-1", "name": "Old", "objective": "o", "description": "d", "evidence": "", "test_procedure": "EvidenceReview"} | KINDS | {"frequency": "AsRequired"}
    assert import_legacy_master(store, "me", WORDS, old) == ["PLACEHOLDER_EVIDENCE", "PLACEHOLDER_TEST_PROCEDURE", "UNCONFIRMED_FREQUENCY"]
    with pytest.raises(ValueError, match="quality flags"):
        approve_master(store, "you", "M-1")
    assert update_master(store, "me", WORDS, "M-1", evidence="e", test_procedure="t", frequency="AsRequired") == []
    approve_master(store, "you", "M-1")
    assert masters(store, "approved").count() == 1
