"""Semantic categories of concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import text as T


def resolve_target(target: str | None) -> tuple[str, ...] | None:
    """Letters of a preset or of a single tree letter; None for no constraint and for anything else."""
    key = (target or "").strip().lower()
    if key in K.TARGET_PRESETS:
        return K.TARGET_PRESETS[key]
    return (key.upper(),) if len(key) == 1 and key.upper() in K.TREE_CATEGORIES else None


def letters(tree: DataFrame) -> DataFrame:
    """(heading, tree_number) -> heading, letters: first letters of its tree numbers, sorted."""
    return tree.groupBy("heading").agg(F.array_sort(F.collect_set(F.upper(F.substring("tree_number", 1, 1)))).alias("letters"))


def type_names(names: DataFrame, headings: DataFrame, tree: DataFrame) -> DataFrame:
    """names (name) -> name, letters; empty where a name has no heading or a heading no number."""
    found = names.select("name").distinct().join(headings.dropDuplicates(["name"]), "name", "left").join(letters(tree), "heading", "left")
    return found.select("name", F.coalesce("letters", T.strings(())).alias("letters"))


def canonical_heading(translation: F.Column) -> F.Column:
    """The first quoted heading of a query translation."""
    return F.nullif(F.regexp_extract(translation, r'(?i)"([^"]+)"\[MeSH Terms\]', 1), F.lit(""))
