"""Control catalogs (JSON) as DataFrames: controls, references, framework and the issues found on the way.

A file is the unit of work: parameters, ids and resources are looked up within
it, and each file is parsed by one task of its own, so many catalogs are read in
parallel. Rows carry the file they came from in ``catalog``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# The shapes of ids, labels, insertions and part names.
INSERTION = re.compile(r"\{\{\s*insert:\s*param,\s*([^\s}]+)\s*\}\}")
SOURCE_ID = re.compile(r"([a-z]{2})-([0-9]{1,3})(?:\.([0-9]{1,3}))?")
LABEL = re.compile(r"([A-Za-z]{2})-0*([0-9]{1,3})(?:\(0*([0-9]{1,3})\))?")
PART_ID = re.compile(r"(.+?)_(?:smt|gdn|obj)(?:\..*)?")
ENHANCEMENT_CLASS = "SP800-53-enhancement"

PARAMETER = "struct<id:string,label:string,choices:array<string>,how_many:string,aggregates:array<string>>"
CLAUSE = "struct<ref:string,parent_ref:string,label:string,text:string,is_leaf:boolean>"
CONTROL = (
    "framework_code string, framework_version string, control_id string, oscal_id string, parent_id string, kind string, family string, title string, status string, "
    f"statement string, guidance string, parameters array<{PARAMETER}>, assessment_objectives string, assessment_methods array<struct<method:string,objects:string>>, "
    f"links array<struct<rel:string,target:string,kind:string>>, clauses array<{CLAUSE}>, implementation_level string, source_ref string, "
    "content_sha256 string, obligation_sha256 string, ordinal bigint"
)
ISSUE = "severity string, code string, control_id string, message string"
REFERENCE = "uuid string, title string, citation string, href string"
FRAMEWORK = "code string, version string, title string, oscal_version string, last_modified string, source_sha256 string, groups bigint"


@dataclass
class Catalog:
    framework: DataFrame
    controls: DataFrame
    issues: DataFrame
    references: DataFrame


def plain(text: str | None) -> str:
    """The form that texts are compared in; the same as ``textnorm.normalize_text``."""
    return " ".join(unicodedata.normalize("NFC", text or "").replace(" ", " ").replace("​", "").split())


def _name(found: re.Match | None) -> str | None:
    if found is None:
        return None
    family, number, extra = found.groups()
    return f"{family.upper()}-{int(number)}" + (f"({int(extra)})" if extra else "")


def _prop(node: dict, name: str) -> str | None:
    """The first property of that name that has no class."""
    return next((p.get("value") for p in node.get("props") or [] if p.get("name") == name and p.get("class") is None), None)


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class _File:
    """One parsed file; ``rows`` has (kind, record) of everything in it."""

    def __init__(self, raw: bytes, code: str):
        root = json.loads(raw.decode("utf-8"))
        if "catalog" not in root:
            raise ValueError("not an OSCAL catalog: missing top-level 'catalog'")
        self.tree = root["catalog"]
        self.rows: list[tuple[str, dict]] = []
        self.said: set[tuple] = set()
        self.about: str | None = None
        meta = self.tree.get("metadata", {})
        self.code, self.version = code, str(meta.get("version", "")).strip()
        groups = self.tree.get("groups", [])
        self.rows.append(("framework", {"code": code, "version": self.version, "title": meta.get("title", ""), "oscal_version": str(meta.get("oscal-version", "")), "last_modified": str(meta.get("last-modified", "")), "source_sha256": hashlib.sha256(raw).hexdigest(), "groups": len(groups)}))
        if not self.version:
            self.say("error", "MISSING_VERSION", "catalog metadata has no version")
        self.resources = {r["uuid"]: r for r in self.tree.get("back-matter", {}).get("resources", [])}
        for uuid, r in self.resources.items():
            first = next(iter(r.get("rlinks") or []), {})
            self.rows.append(("reference", {"uuid": uuid, "title": r.get("title", ""), "citation": (r.get("citation") or {}).get("text", ""), "href": first.get("href", "")}))
        self.nodes = self.flatten(groups)
        self.params = {p["id"]: self.parameter(p) for _, node, _ in self.nodes for p in node.get("params", [])}
        self.names = {node["id"]: _name(SOURCE_ID.fullmatch(node["id"])) for _, node, _ in self.nodes}
        self.check_ids()
        for place, (group, node, above) in enumerate(self.nodes):
            if self.names[node["id"]]:
                self.about = self.names[node["id"]]
                self.rows.append(("control", self.control(group, node, above) | {"ordinal": place}))

    def say(self, severity: str, code: str, message: str, about: str | None = None) -> None:
        """An issue, once however often its text is rendered."""
        issue = (severity, code, about or self.about, message)
        if issue not in self.said:
            self.said.add(issue)
            self.rows.append(("issue", dict(zip(("severity", "code", "control_id", "message"), issue, strict=True))))

    @staticmethod
    def flatten(groups: list[dict]) -> list[tuple[str, dict, dict | None]]:
        """(group id, control, the control above) in document order."""
        out, todo = [], [(g["id"], c, None) for g in groups for c in g.get("controls", [])][::-1]
        while todo:
            group, node, above = todo.pop()
            out.append((group, node, above))
            todo.extend((group, c, node) for c in reversed(node.get("controls", [])))
        return out

    @staticmethod
    def parameter(p: dict) -> dict:
        select = p.get("select") or {}
        return {"id": p["id"], "label": p.get("label"), "choices": list(select.get("choice", ())), "how_many": select.get("how-many"), "aggregates": [q["value"] for q in p.get("props", []) if q.get("name") == "aggregates"]}

    def check_ids(self) -> None:
        for source, n in Counter(node["id"] for _, node, _ in self.nodes).items():
            if self.names[source] is None:
                for _ in range(n):
                    self.rows.append(("issue", {"severity": "error", "code": "BAD_ID", "control_id": source, "message": f"cannot canonicalise OSCAL id '{source}'"}))
            elif n > 1:
                self.say("error", "DUPLICATE_ID", f"source id '{source}' appears {n} times", self.names[source])

    def fill(self, text: str | None, trail: tuple[str, ...] = ()) -> str:
        """The text with its insertions rendered."""
        pieces = INSERTION.split(text or "")  # texts and parameter ids by turns
        return "".join(self.insertion(x, trail) if i % 2 else x for i, x in enumerate(pieces))

    def insertion(self, key: str, trail: tuple[str, ...]) -> str:
        """A label in brackets, else choices in brackets, else the aggregated parameters."""
        if key not in self.params:
            self.say("error", "UNRESOLVED_PARAM", f"parameter '{key}' is not defined in the catalog")
            return "{{ insert: param, " + key + " }}"
        if key in trail:
            self.say("error", "PARAM_CYCLE", f"parameter '{key}' references itself")
            return "[?]"
        p, trail = self.params[key], (*trail, key)
        options = [p["label"]] if p["label"] else p["choices"]
        if options:
            return "[" + " | ".join(self.fill(x, trail) for x in options) + "]"
        if p["aggregates"]:
            return " ".join(self.insertion(x, trail) for x in p["aggregates"])
        self.say("error", "EMPTY_PARAM", f"parameter '{key}' has no label, choices or aggregates")
        return "[?]"

    def outline(self, parts: list[dict] | None) -> list[dict]:
        """Parts and the parts below them, in document order; a part without an id is named by its place."""
        out, todo = [], [(p, None) for p in reversed(parts or [])]
        while todo:
            part, above = todo.pop()
            below = part.get("parts") or []
            ref = part.get("id") or f"{above}.{len(out)}"
            out.append({"ref": ref, "parent_ref": above, "label": _prop(part, "label") or "", "text": self.fill(part.get("prose")).strip(), "is_leaf": not below})
            todo.extend((p, ref) for p in reversed(below))
        return out

    @staticmethod
    def lines(outline: list[dict]) -> str:
        return "\n".join(x for x in (f"{c['label']} {c['text']}".strip() for c in outline) if x)

    def link(self, link: dict) -> dict:
        href = link["href"]
        target = href.removeprefix("#")
        part = PART_ID.fullmatch(target)
        if self.names.get(target):
            found = self.names[target], "control"
        elif target in self.resources:
            found = target, "reference"
        elif part and self.names.get(part[1]):
            found = self.names[part[1]], "part"
        else:
            found = href, "unresolved"
            self.say("warning", "DANGLING_LINK", f"link '{href}' ({link['rel']}) does not resolve")
        return {"rel": link["rel"], "target": found[0], "kind": found[1]}

    def control(self, group: str, node: dict, above: dict | None) -> dict:
        name, label = self.about, _prop(node, "label")
        if _name(LABEL.fullmatch((label or "").strip())) != name:
            self.say("error", "ID_LABEL_MISMATCH", f"label '{label}' does not match id '{node['id']}'")
        if not name.startswith(group.upper() + "-"):
            self.say("error", "FAMILY_MISMATCH", f"id '{name}' is filed under group '{group}'")
        kind = "base" if above is None else "enhancement"
        if (node.get("class") == ENHANCEMENT_CLASS) is (above is None):
            self.say("error", "KIND_MISMATCH", f"class '{node.get('class')}' disagrees with nesting ({kind})")
        of = lambda part: [p for p in node.get("parts", []) if p.get("name") == part]
        clauses = self.outline(of("statement"))
        c = {
            "framework_code": self.code, "framework_version": self.version, "control_id": name, "oscal_id": node["id"],
            "parent_id": self.names[above["id"]] if above else None, "kind": kind, "family": group.upper(), "title": plain(node.get("title", "")),
            "status": "withdrawn" if _prop(node, "status") == "withdrawn" else "active", "statement": self.lines(clauses), "guidance": self.lines(self.outline(of("guidance"))),
            "parameters": [self.parameter(p) for p in node.get("params", [])], "assessment_objectives": self.lines(self.outline(of("assessment-objective"))),
            "assessment_methods": [{"method": _prop(m, "method") or "", "objects": self.lines(self.outline(m.get("parts")))} for m in of("assessment-method")],
            "links": [self.link(x) for x in node.get("links", [])], "clauses": clauses, "implementation_level": _prop(node, "implementation-level"),
            "source_ref": f"{self.code}@{self.version}#{node['id']}",
        }
        return c | dict(zip(("content_sha256", "obligation_sha256"), hashes(c), strict=True))


def hashes(c: dict) -> tuple[str, str]:
    """Of everything that a control says, and of what decisions about it rest on: no guidance, links or procedures."""
    duty = {k: c[k] for k in ("kind", "status")} | {"parent": c["parent_id"], "title": plain(c["title"]), "statement": plain(c["statement"])}
    duty["parameters"] = [[p["id"], plain(p["label"]), [plain(x) for x in p["choices"]], p["how_many"], p["aggregates"]] for p in c["parameters"]]
    whole = duty | {
        "framework": [c["framework_code"], c["framework_version"]], "id": c["control_id"], "oscal_id": c["oscal_id"], "family": c["family"], "guidance": plain(c["guidance"]),
        "objectives": plain(c["assessment_objectives"]), "methods": [[m["method"], plain(m["objects"])] for m in c["assessment_methods"]],
        "links": sorted([x["rel"], x["target"], x["kind"]] for x in c["links"]), "level": c["implementation_level"],
        "clauses": [[x["ref"], x["parent_ref"], x["label"], plain(x["text"]), x["is_leaf"]] for x in c["clauses"]],
    }
    return _digest(whole), _digest(duty)


def read_catalog(spark: SparkSession, path: str, framework_code: str = "NIST-SP-800-53") -> Catalog:
    """The catalog files at path (a file, folder or pattern). A file that is no catalog fails the read."""

    read = uuid.uuid4().hex  # makes this read's plan its own: rows kept by an earlier read of the path are not taken for it

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        assert read
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                rows = _File(bytes(raw), framework_code).rows
                yield pd.DataFrame({"catalog": name, "kind": [k for k, _ in rows], "record": [json.dumps(r) for _, r in rows]})

    files = ship(spark).read.format("binaryFile").load(path).select("path", "content")
    # Kept, as several frames read it; what a lost executor held is parsed again.
    rows = files.mapInPandas(parse, "catalog string, kind string, record string").persist()

    def of(kind: str, schema: str) -> DataFrame:
        return rows.where(F.col("kind") == kind).select("catalog", F.from_json("record", schema).alias("r")).select("catalog", "r.*").persist()

    return Catalog(of("framework", FRAMEWORK), of("control", CONTROL), of("issue", ISSUE), of("reference", REFERENCE))
