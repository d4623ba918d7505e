"""Filters on candidates: metadata, versions, the latest of a group. They come after fusion and never before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import version_key

EQUAL = ("language", "repository", "version", "snippet_type")


def matches(value: Column, wanted) -> Column:
    """Equality, or membership for a list; everything for None."""
    if wanted is None:
        return F.lit(True)
    return value == wanted if isinstance(wanted, str) else value.isin(*wanted)


def merge_version(filters: dict | None, explicit: str = "all", intent: str = "none", requested: str | None = None) -> dict:
    """The filters with a version: their own if the key is there at all, else the explicit one, else what the query asks for."""
    out = dict(filters or {})
    if "version" not in out:
        asked = {"specific": requested, "latest": "latest"}.get(intent)
        out["version"] = explicit if explicit != "all" else asked or "all"
    return out


def group_key() -> list[Column]:
    return [F.col("repository"), F.col("file_path"), F.coalesce(F.nullif("function_name", F.lit("")), F.col("class_name")).alias("symbol")]


def latest(candidates: DataFrame, order: str = "pool_rank", by: str = "query_id") -> DataFrame:
    """One candidate of each (repository, path, symbol): a fold in the order of the ranking that keeps the later of two versions,
    of equals the later candidate. Numbers compare as numbers; where a label has none, labels compare as text.

    A group's fold sees versions and places, not the candidates.
    """
    keyed = candidates.withColumn("__symbol", group_key()[2])
    keys = [by, "repository", "file_path", "__symbol"]
    member = F.struct(F.col(order).alias("o"), F.col("version").alias("v"), version_key(F.col("version")).alias("n"))

    def later(a: Column, b: Column) -> Column:
        numbers = a["n"].isNotNull() & b["n"].isNotNull()
        return F.when(F.when(numbers, b["n"] >= a["n"]).otherwise(b["v"] >= a["v"]), b).otherwise(a)

    rows = keyed.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("m"))
    kept = rows.select(*keys, F.aggregate(F.slice("m", F.lit(2), F.size("m")), F.col("m")[0], later)["o"].alias(order))
    return keyed.join(kept, [*keys, order], "left_semi").drop("__symbol")


def filter_candidates(candidates: DataFrame, filters: dict | None) -> DataFrame:
    """All of the filters: equality or membership, a part of the path in any case, a version (``all``: any, ``latest``)."""
    filters = dict(filters or {})
    version = filters.get("version")
    out = candidates
    for name in EQUAL:
        wanted = filters.get(name)
        if wanted is not None and not (name == "version" and wanted in ("latest", "all")):
            out = out.filter(matches(F.col(name), wanted))
    if filters.get("file_path"):
        out = out.filter(F.contains(F.lower("file_path"), F.lower(F.lit(filters["file_path"]))))
    return latest(out) if version == "latest" else out
