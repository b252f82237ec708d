"""A small synthetic catalog: seven controls in two groups, two of which share a statement."""

import copy
import json


def _control(source, label, title, statement, nested=(), above=None, status=None, links=(), params=()):
    props = [{"name": "label", "value": label, "class": "zero-padded"}, {"name": "label", "value": label}]
    if status:
        props.append({"name": "status", "value": status})
    parts = [{"id": f"{source}_smt", "name": "statement", **statement}] if statement else []
    return {"id": source, "class": "SP800-53-enhancement" if above else "SP800-53", "title": title, "params": list(params), "props": props, "links": list(links), "parts": parts, "controls": list(nested)}


def catalog():
    label = lambda x: [{"name": "label", "value": x}]
    ac1 = _control(
        "ac-1", "AC-1", "Access rules", {"parts": [{"name": "item", "props": label("a."), "prose": "Write {{ insert: param, ac-1_odp.01 }} rules; and", "parts": [{"id": "ac-1_smt.a.1", "name": "item", "props": label("1."), "prose": "Choose {{ insert: param, ac-1_odp.02 }}."}]}]},
        params=[{"id": "ac-1_odp.01", "label": "named  people"}, {"id": "ac-1_odp.02", "select": {"how-many": "one-or-more", "choice": ["team {{ insert: param, ac-1_odp.01 }}", "office", "site"]}}, {"id": "ac-1_prm_1", "props": [{"name": "aggregates", "value": "ac-1_odp.01"}]}],
        links=[{"href": "#r-1", "rel": "reference"}, {"href": "#ac-2", "rel": "related"}, {"href": "#ac-2_smt.a", "rel": "related"}, {"href": "#zz-9", "rel": "related"}],
    )
    gone = _control("ac-2.10", "AC-2(10)", "Shared accounts", None, above=1, status="withdrawn", links=[{"href": "#ac-2", "rel": "incorporated-into"}])
    auto = _control("ac-2.1", "AC-2(1)", "Tools", {"prose": "Use tools for accounts."}, above=1)
    ac2 = _control("ac-2", "AC-2", "Accounts", {"prose": "Keep accounts:", "parts": [{"name": "item", "props": label("a."), "prose": "known;"}, {"name": "item", "props": label("b."), "prose": "few."}]}, nested=[auto, gone])
    twin = {"prose": "Test the   system with care."}
    sa15 = _control("sa-15", "SA-15", "Building", {"prose": "Build with a plan."}, nested=[_control("sa-15.12", "SA-15(12)", "One", twin, above=1), _control("sa-15.13", "SA-15(13)", "Two", twin, above=1)])
    resources = [{"uuid": "r-1", "title": "A law", "citation": {"text": "Law 1"}, "rlinks": [{"href": "http://example.org/1"}]}]
    return {"catalog": {"metadata": {"version": " 5.2.0 ", "title": "Mini", "oscal-version": "1.1", "last-modified": "2024"}, "groups": [{"id": "ac", "controls": [ac1, ac2]}, {"id": "sa", "controls": [sa15]}], "back-matter": {"resources": resources}}}


MANIFEST = {"framework_version": "5.2.0", "expected": {"controls_total": 7, "active": 6, "withdrawn": 1, "enhancements": 4, "groups": 2}}


def write(folder, change=None):
    tree = copy.deepcopy(catalog())
    if change:
        change(tree["catalog"])
    path = folder / "catalog.json"
    path.write_text(json.dumps(tree), encoding="utf-8")
    return str(path)
