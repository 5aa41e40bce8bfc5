"""Rules as data: each a name and a boolean column; rows that break one are collected, and stop a run if asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.storage import cleaned


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; null breaks it."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return rows.select(key, F.explode(broken).alias("rule"))


def assert_none(found: DataFrame) -> None:
    """Raise if there is a violation, with the first few of them."""
    with cleaned(found.sparkSession):
        some = found.limit(10).collect()
    if some:
        raise ValueError(f"rules broken: {[r.asDict() for r in some]}")


def exact_keys(raw: Column, keys: list[str]) -> Column:
    """Whether a JSON object has just these keys, each once."""
    return F.coalesce(F.array_sort(F.json_object_keys(raw)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def in_order(columns: Column) -> Column:
    """Whether an array strictly increases."""
    return columns == F.array_sort(F.array_distinct(columns))
