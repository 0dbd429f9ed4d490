"""Upserts and deletes as joins: the new state of a table from its old state and a batch. See sources.tables for storage.

When a batch holds a key twice, the row with the highest ``version`` wins, so a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.relational import newest


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], version: Column) -> DataFrame:
    """[UPS-1, DDP-1, SNK-3] ``old`` with the rows of ``new`` in place of those with the same key."""
    winners = newest(new, key, 1, version)
    return old.join(winners.select(*key), list(key), "left_anti").unionByName(winners)


def replace_files(old: DataFrame, new: DataFrame, key: Sequence[str] = ("repo_id", "file")) -> DataFrame:
    """[UPS-1] Points of the files of ``new`` replaced as a whole, so points of code that is gone go too."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def merge_columns(old: DataFrame, new: DataFrame, key: Sequence[str], version: Column, defaults: dict[str, Column] | None = None) -> DataFrame:
    """[UPS-2, UPS-3] ``old`` with the columns that ``new`` has set from it, and all other columns as they were.

    A key that only ``new`` has gets ``defaults`` (else null) for the columns that ``new`` lacks.
    """
    keys = list(key)
    winners = newest(new, keys, 1, version).select(*new.columns, F.lit(True).alias("__new"))
    both = old.alias("o").join(winners.alias("n"), keys, "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in new.columns:
            out.append(F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"o.{c}"), (defaults or {}).get(c, F.lit(None))).alias(c))
    return both.select(*out)


def set_where(df: DataFrame, matches: Column, values: dict[str, Column]) -> DataFrame:
    """[UPD-1] Sets columns of the rows that match."""
    return df.withColumns({c: F.when(matches, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """[DEL-2, DEL-3, FLT-9] The rows whose key is not in ``keys``."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def cascade_delete(tables: dict[str, DataFrame], repos: DataFrame, repo_key: dict[str, str]) -> dict[str, DataFrame]:
    """[DEL-1] Every table without the rows of the repositories ``repos`` (id). ``repo_key`` names each table's column."""
    gone = repos.select("id").distinct()
    return {name: df.join(gone.withColumnRenamed("id", repo_key[name]), repo_key[name], "left_anti") for name, df in tables.items()}


def cascade_closure(tables: dict[str, DataFrame], links: Sequence[tuple[str, str, str, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """[DEL-1] Every table without the rows that ``gone`` names or that stand on a row that goes.

    ``links`` are (child, column, parent, column): a child's row goes with the parent's row that its column names; parents come before
    their own children's links. ``gone`` has rows of some tables, by the parent's column. All is joins by key: no list of keys is
    collected, and a row goes if any of its parents does.
    """
    left, leaving = dict(tables), dict(gone)
    for child, column, parent, key in links:
        if parent not in leaving:
            continue
        keys = leaving[parent].select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
        met = left[child].join(keys, column, "left_semi")
        leaving[child] = leaving[child].unionByName(met, allowMissingColumns=True) if child in leaving else met
        left[child] = left[child].join(keys, column, "left_anti")
    for name, rows in gone.items():
        keys = sorted({key for _, _, parent, key in links if parent == name})
        left[name] = left[name].join(rows.select(*keys).distinct(), keys, "left_anti")
    return left
