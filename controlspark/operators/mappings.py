"""Queries on requirements, masters and the mappings between them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(columns: list[Column | str], query: str) -> Column:
    """Whether the columns, joined by spaces, contain the query in any case; % and _ in it stand for any text and any character. An empty query matches all."""
    if not query:
        return F.lit(True)
    escape = next(c for c in "!~^|\x01" if c not in query)  # LIKE needs one that the query does not use
    return F.like(F.lower(F.concat_ws(" ", *columns)), F.lit(f"%{query.lower()}%"), F.lit(escape))


def page(rows: DataFrame, score: str, id: str, limit: int = 25, offset: int = 0) -> DataFrame:
    """Rows by falling score, those without one last, then by id."""
    return rows.orderBy(F.col(score).desc_nulls_last(), id).offset(offset).limit(limit)


def unmapped(requirements: DataFrame, mappings: DataFrame, query: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Requirements (id) without an approved mapping (requirement_id, status) whose columns match the query."""
    approved = mappings.where("status = 'approved'").select(F.col("requirement_id").alias("id"))
    return requirements.where(matches(list(columns), query)).join(approved, "id", "left_anti")


def coverage(requirements: DataFrame, mappings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total and mapped (with an approved mapping) requirements, of each group."""
    approved = mappings.where("status = 'approved'").select(F.col("requirement_id").alias("id")).distinct().withColumn("__is", F.lit(1))
    return requirements.join(approved, "id", "left").groupBy(*by).agg(F.count("*").alias("total"), F.count("__is").alias("mapped"))


def open_suggestions(mappings: DataFrame, requirements: DataFrame, masters: DataFrame, ready_only: bool = True) -> DataFrame:
    """Suggested mappings with their requirement (id) and master (master_id, master_status); ready_only: those whose master is approved."""
    both = mappings.where("status = 'suggested'").join(requirements.withColumnRenamed("id", "requirement_id"), "requirement_id").join(masters, "master_id")
    return both.where("master_status = 'approved'") if ready_only else both


def blocked_suggestions(mappings: DataFrame, masters: DataFrame) -> DataFrame:
    """blocked: how many suggested mappings wait for their master's approval."""
    return mappings.where("status = 'suggested'").join(masters.where("master_status <> 'approved'"), "master_id", "left_semi").agg(F.count("*").alias("blocked"))


def broad(pairs: DataFrame, master: str, family: str, most: int = 5) -> DataFrame:
    """Masters mapped to more than ``most`` families, with their number."""
    return pairs.groupBy(master).agg(F.count_distinct(family).alias("families")).where(F.col("families") > most)


def dangling(mappings: DataFrame, parents: Mapping[str, DataFrame]) -> DataFrame:
    """Mappings one of whose key columns is in no row of the frame that it refers to; each frame has a column of that name."""
    out = mappings
    for key, rows in parents.items():
        mark = f"__{key}"
        out = out.join(rows.select(key).distinct().withColumn(mark, F.lit(True)), key, "left")
    lost = F.lit(False)
    for key in parents:
        lost = lost | F.col(f"__{key}").isNull()
    return out.where(lost).select(*mappings.columns)


def report(items: DataFrame, keys: list[str]) -> DataFrame:
    """n of each combination of the keys."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"))


def in_vocabulary(value: Column, aliases: Mapping[str, str], allowed: list[str] | None = None) -> Column:
    """The value's name in a controlled vocabulary: aliases are replaced; null where it is not allowed."""
    name = F.coalesce(*[F.when(value == a, F.lit(b)) for a, b in aliases.items()], value) if aliases else value
    return name if allowed is None else F.when(name.isin(allowed), name)


def quality_flags(evidence: Column, test_procedure: Column, frequency: Column, objective: Column, description: Column, confirmed: Column) -> Column:
    """Sorted names of what keeps a master from approval: placeholders, an unconfirmed frequency, empty texts."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    ev = low(evidence)
    flags = [
        F.when((ev == "") | ev.startswith("retain governed evidence demonstrating"), "PLACEHOLDER_EVIDENCE"),
        F.when(low(test_procedure).isin("", "evidencereview"), "PLACEHOLDER_TEST_PROCEDURE"),
        F.when((frequency == "AsRequired") & ~confirmed, "UNCONFIRMED_FREQUENCY"),
        F.when(low(objective) == "", "EMPTY_OBJECTIVE"),
        F.when(low(description) == "", "EMPTY_DESCRIPTION"),
    ]
    return F.array_sort(F.array_compact(F.array(*flags)))
