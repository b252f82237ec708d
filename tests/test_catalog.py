import pytest
from catalogs import MANIFEST, write
from controlspark.operators.validation import quarantined, validate
from controlspark.sources.catalog import read_catalog


def found(spark, path, manifest=MANIFEST):
    parsed = read_catalog(spark, path)
    issues = validate(parsed, manifest)
    held = {r.control_id: r.codes for r in quarantined(parsed.controls, issues).collect()}
    return parsed, {(r.code, r.control_id) for r in issues.collect()}, held


def test_controls(spark, tmp_path):
    parsed = read_catalog(spark, write(tmp_path))
    rows = parsed.controls.orderBy("ordinal").collect()
    assert [r.control_id for r in rows] == ["AC-1", "AC-2", "AC-2(1)", "AC-2(10)", "SA-15", "SA-15(12)", "SA-15(13)"]
    first = rows[0]
    assert first.statement == "a. Write [named  people] rules; and\n1. Choose [team [named  people] | office | site]."
    assert [(c.ref, c.parent_ref, c.label, c.is_leaf) for c in first.clauses] == [("ac-1_smt", None, "", False), ("ac-1_smt.1", "ac-1_smt", "a.", False), ("ac-1_smt.a.1", "ac-1_smt.1", "1.", True)]
    assert [(x.target, x.kind) for x in first.links] == [("r-1", "reference"), ("AC-2", "control"), ("AC-2", "part"), ("#zz-9", "unresolved")]
    assert first.parameters[1].how_many == "one-or-more" and first.parameters[2].aggregates == ["ac-1_odp.01"]
    assert (rows[3].status, rows[3].parent_id, rows[3].kind, rows[3].family) == ("withdrawn", "AC-2", "enhancement", "AC")
    assert first.source_ref == "NIST-SP-800-53@5.2.0#ac-1" and len({r.content_sha256 for r in rows}) == 7
    assert [(r.uuid, r.citation, r.href) for r in parsed.references.collect()] == [("r-1", "Law 1", "http://example.org/1")]
    assert parsed.framework.first().version == "5.2.0"


def test_only_the_twins_are_held_back(spark, tmp_path):
    _, issues, held = found(spark, write(tmp_path))
    assert issues == {("DANGLING_LINK", "AC-1"), ("DUPLICATE_STATEMENT", "SA-15(12)"), ("DUPLICATE_STATEMENT", "SA-15(13)")}
    assert held == {"SA-15(12)": ["DUPLICATE_STATEMENT"], "SA-15(13)": ["DUPLICATE_STATEMENT"]}


def lost_statement(c):
    c["groups"][0]["controls"][1]["parts"] = []


def renamed_parameter(c):
    c["groups"][0]["controls"][0]["params"][0]["id"] = "other"


def bad_id(c):
    c["groups"][0]["controls"][0]["id"] = "ac_1"


def cycle(c):
    c["groups"][0]["controls"][0]["params"][0]["label"] = "{{ insert: param, ac-1_odp.01 }}"


def wrong_label(c):
    c["groups"][1]["controls"][0]["props"][1]["value"] = "SA-16"


def lost_control(c):
    c["groups"][0]["controls"].pop()


def other_version(c):
    c["metadata"]["version"] = "6"


@pytest.mark.parametrize(
    ("change", "codes", "ids"),
    [
        (lost_statement, {"EMPTY_STATEMENT"}, {"AC-2", "AC-2(1)", "AC-2(10)"}),
        (renamed_parameter, {"UNRESOLVED_PARAM", "UNRENDERED_PLACEHOLDER"}, {"AC-1"}),
        (bad_id, {"BAD_ID"}, {"ac_1"}),
        (cycle, {"PARAM_CYCLE"}, {"AC-1"}),
        (wrong_label, {"ID_LABEL_MISMATCH"}, {"SA-15"}),
        (lost_control, {"COUNT_MISMATCH"}, set()),
        (other_version, {"MANIFEST_VERSION"}, set()),
    ],
)
def test_faults(spark, tmp_path, change, codes, ids):
    _, issues, held = found(spark, write(tmp_path, change))
    assert codes <= {code for code, _ in issues}
    assert set(held) == ids | {"SA-15(12)", "SA-15(13)"}


def test_no_catalog(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(Exception, match="not an OSCAL catalog"):
        read_catalog(spark, str(tmp_path / "x.json")).controls.collect()
