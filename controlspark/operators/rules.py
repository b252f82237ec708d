"""Rules on records: duplicates, plan difference, quarantine, references, counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textnorm import normalize_text


def duplicate_groups(records: DataFrame) -> DataFrame:
    """key, members, first: groups of more than one record (id, text) with one normal text that is not empty."""
    norm = records.select("id", normalize_text(F.col("text")).alias("text")).where("text <> ''").select("id", F.sha2("text", 256).alias("key"))
    return norm.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("first")).where("members > 1")


def duplicate_statements(records: DataFrame) -> DataFrame:
    """id, first, peers: each member of such a group, the group's smallest id and the number of the others."""
    norm = records.select("id", normalize_text(F.col("text")).alias("text")).where("text <> ''").select("id", F.sha2("text", 256).alias("key"))
    return norm.join(duplicate_groups(records), "key").select("id", "first", (F.col("members") - 1).alias("peers"))


def plan_diff(parsed: DataFrame, stored: DataFrame) -> DataFrame:
    """id, state of (id, hash) rows against the stored ones: new, unchanged or conflict."""
    both = parsed.join(stored.select("id", F.col("hash").alias("old")), "id", "left")
    return both.select("id", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "unchanged").otherwise("conflict").alias("state"))


def propagate_quarantine(blocked: DataFrame, children: list[DataFrame]) -> DataFrame:
    """(id) of blocked parents down levels of (id, parent): a child of a blocked parent is blocked."""
    out, now = None, blocked
    for level in children:
        now = level.join(now.select(F.col("id").alias("parent")), "parent", "left_semi").select("id")
        out = now if out is None else out.unionByName(now)
    return out


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is null or unknown."""
    return children.join(parents.select(key).distinct(), key, "left_anti")


def counts_against(counts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """name, actual, expected, mismatch: each expected count against the column of its name in a table of one row."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("bigint").alias("actual"), F.lit(v).cast("bigint").alias("expected")) for k, v in expected.items()])
    return counts.select(F.explode(rows).alias("x")).select("x.*").withColumn("mismatch", ~F.col("actual").eqNullSafe(F.col("expected")))


def set_hash(members: DataFrame, group: str, member: str) -> DataFrame:
    """group, ids_sha256 of each group's members as text, sorted, a line each. A group is one list: for sets of ids of one framework."""
    lines = F.transform(F.array_sort(F.collect_list(member)), lambda x: x.cast("string"))
    return members.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("ids_sha256"))


def fingerprint(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """group, sha256 of the lines key:value in the order of the keys: the same for tables of the same rows."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: F.concat(x[key].cast("string"), F.lit(":"), x[value]))
    return rows.groupBy(group).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def waive(issues: DataFrame, waivers: DataFrame, keys: list[str]) -> DataFrame:
    """The issues with waived, whether a waiver has their keys; issues without a control (null keys) cannot be waived."""
    marks = waivers.select(*keys).distinct().withColumn("waived", F.lit(True))
    return issues.join(marks, keys, "left").withColumn("waived", F.coalesce("waived", F.lit(False)))


def identical_peers(records: DataFrame) -> DataFrame:
    """id, peers: how many other records have the same text, of those with any; one aggregation by the text's hash, no self-join."""
    hashed = records.where("text is not null").select("id", F.sha2("text", 256).alias("key"))
    sizes = hashed.groupBy("key").agg((F.count("*") - 1).alias("peers")).where("peers > 0")
    return hashed.join(sizes, "key").select("id", "peers")


def upsert_states(new: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The new rows with state: added, changed (any value differs) or unchanged. Rows that only the store has are never deleted."""
    old = stored.select(*keys, F.struct(*values).alias("__old"))
    state = F.when(F.col("__old").isNull(), "added").when(F.struct(*values).eqNullSafe(F.col("__old")), "unchanged").otherwise("changed")
    return new.join(old, keys, "left").withColumn("state", state).drop("__old")


def mismatches(rows: DataFrame, pairs: Mapping[str, Column]) -> DataFrame:
    """Rows one of whose stored columns differs from what it should be, with the names of those columns in differs."""
    found = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(v), F.lit(k)) for k, v in pairs.items()]))
    return rows.withColumn("differs", found).where(F.size("differs") > 0)


def rendered(parts: DataFrame, group: str, place: str, label: Column, text: Column) -> DataFrame:
    """group, text: lines 'label text' in order, stripped, empty ones dropped, joined by line ends."""
    lines = parts.select(group, place, F.trim(F.concat_ws(" ", label, text)).alias("line")).where("line <> ''")
    ordered = F.array_sort(F.collect_list(F.struct(place, "line")))
    return lines.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def resolved_links(links: DataFrame, controls: DataFrame, references: DataFrame) -> DataFrame:
    """links (from, target) with kind: control, reference, part (of a control, by the id before the part's suffix) or unresolved, in this order."""
    part = F.regexp_extract("target", r"^(.+?)_(?:smt|gdn|obj)(?:\..*)?$", 1)
    name = lambda df, c, to: df.select(F.col("id").alias(c), F.lit(True).alias(to)).distinct()
    both = links.withColumn("__part", part).join(name(controls, "target", "__c"), "target", "left").join(name(references, "target", "__r"), "target", "left").join(name(controls, "__part", "__p"), "__part", "left")
    kind = F.when(F.col("__c"), "control").when(F.col("__r"), "reference").when(F.col("__p"), "part").otherwise("unresolved")
    return both.withColumn("kind", kind).drop("__part", "__c", "__r", "__p")


def chain_faults(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key, place and why: revisions that do not run 1..n, a first action other than set, or an action that does not follow from the one before it."""
    w = Window.partitionBy(*keys).orderBy("revision")
    marked = rows.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("action").over(w))
    return marked.where((F.col("revision") != F.col("place")) | ((F.col("action") == "retire") & (F.coalesce("before", F.lit("")) != "set")))
