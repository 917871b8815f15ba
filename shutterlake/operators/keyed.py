"""Batch writes on keyed tables: upsert, find-or-create, numbering, cascading deletes.

Everything returns the new state of the table; ``sources.tables`` writes it as a new version.
First/last-per-key choices are aggregates (``min_by``/``max_by``), which combine before the
shuffle, so a key that holds a third of the rows costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.schema import DELETE_RULES
from shutterlake.session import cut_lineage

ID_BUCKETS_HEX = 3  # 16**3 = 4096 numbering buckets


def one_per_key(df: DataFrame, keys: list[str], order: list[str | Column] | None = None,
                last: bool = False) -> DataFrame:
    """Keeps the first (or last) row of each key by ``order`` (all columns by default)."""
    by = [F.col(o) if isinstance(o, str) else o for o in (order or df.columns)]
    rank = F.struct(*by)
    pick = F.max_by if last else F.min_by
    rows = df.groupBy(*keys).agg(pick(F.struct(*df.columns), rank).alias("_row"))
    return rows.select("_row.*").select(*df.columns)


def same_keys(keys: list[str], left: str, right: str) -> Column:
    """Null-safe equality on every key of two aliased tables."""
    return reduce(
        lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    )


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str],
                  order: list[str | Column] | None = None) -> DataFrame:
    """target plus the rows whose key it does not have yet (first of each key)."""
    fresh = one_per_key(rows, keys, order)
    return target.unionByName(new_rows(target, fresh, keys), allowMissingColumns=True)


def new_rows(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the target does not have."""
    known = target.select(*keys).alias("known")
    return rows.alias("new").join(known, same_keys(keys, "new", "known"), "left_anti")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], mode: str = "update",
           order: list[str | Column] | None = None, overwrite: bool = False) -> DataFrame:
    """insert-or-ignore (``mode='ignore'``) or insert-or-update on a unique key.

    Several updates for one key: the first wins for ``ignore``, the last for ``update``. In update
    mode a null in ``updates`` keeps the stored value unless ``overwrite`` is set; columns that
    ``updates`` lacks always keep it.
    """
    if mode == "ignore":
        return insert_ignore(target, updates, keys, order)
    latest = one_per_key(updates, keys, order, last=True)
    old = target.withColumn("_old", F.lit(True)).alias("o")
    new = latest.withColumn("_new", F.lit(True)).alias("n")
    columns = []
    for name in target.columns:
        if name not in latest.columns:
            columns.append(F.col(f"o.{name}").alias(name))
        elif overwrite and name not in keys:
            value = F.when(F.col("n._new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
            columns.append(value.alias(name))
        else:
            columns.append(F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}")).alias(name))
    return old.join(new, same_keys(keys, "o", "n"), "full_outer").select(*columns)


def dense_number(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Numbers distinct rows 1..n without a single-task sort.

    Rows are ranked by (first three hex digits of md5(key), key): each of the 4096 buckets is
    numbered on its own and shifted by the sizes of the buckets before it. The offsets table has at
    most 4096 rows, so the one unpartitioned window below is bounded.
    """
    key_text = F.concat_ws("\u001f", *[F.col(k).cast("string") for k in keys])
    marked = df.withColumn("_b", F.substring(F.md5(key_text), 1, ID_BUCKETS_HEX))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("_b")
        .count()
        .select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*keys))
    return (
        marked.withColumn("_local", local)
        .join(F.broadcast(offsets), "_b")
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_b", "_local", "_offset")
    )


def number_within(df: DataFrame, group: list[str], id_col: str, order: list[str], name: str,
                  span: int = 1_000_000) -> DataFrame:
    """row_number within a group by (id, order), exact and safe for one huge group.

    The group is cut into id ranges of ``span``; every range is numbered by its own task and
    shifted by the counts of the ranges before it.
    """
    marked = df.withColumn("_range", F.floor(F.col(id_col) / span).cast("bigint"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        marked.groupBy(*group, "_range")
        .count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    local = Window.partitionBy(*group, "_range").orderBy(id_col, *order)
    return (
        marked.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*group, "_range"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_range", "_local", "_offset")
    )


def next_id(target: DataFrame, id_col: str = "id") -> Column:
    """Highest id in use as a scalar subquery, 0 for an empty table."""
    return target.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).scalar()


def assign_ids(target: DataFrame, rows: DataFrame, keys: list[str],
               id_col: str = "id") -> DataFrame:
    """Gives new rows the ids after the highest one in ``target``."""
    numbered = dense_number(rows, keys, "_seq")
    return numbered.withColumn(id_col, F.col("_seq") + next_id(target, id_col)).drop("_seq")


def find_or_create(dim: DataFrame, wanted: DataFrame, keys: list[str],
                   id_col: str = "id") -> DataFrame:
    """The dimension extended by every key in ``wanted`` it did not have.

    Look ids up by joining back on the keys.
    """
    fresh = new_rows(dim, wanted.select(*keys).distinct(), keys)
    return dim.unionByName(assign_ids(dim, fresh, keys, id_col), allowMissingColumns=True)


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Removes ids (column ``id``) from ``table`` and applies the delete rules below it.

    Tables not present in ``tables`` are skipped. Every level is one anti-join per child column; the
    ids of a child are only gathered, and written once, where it has children of its own.
    """
    out = dict(tables)
    doomed = ids.select("id").distinct()
    if table in out:
        out[table] = out[table].join(doomed, "id", "left_anti")
    for child, column, parent, rule in DELETE_RULES:
        if parent != table or child not in out:
            continue
        keys = doomed.withColumnRenamed("id", column)
        rows = out[child]
        if rule == "set_null":
            marks = keys.withColumn("_gone", F.lit(True))
            out[child] = (
                rows.join(marks, column, "left")
                .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
                .drop("_gone")
                .select(*rows.columns)
            )
        elif any(above == child and below in out for below, _, above, _ in DELETE_RULES):
            gone = cut_lineage(rows.join(keys, column, "left_semi").select("id"))
            out = cascade_delete(out, child, gone)
        else:
            out[child] = rows.join(keys, column, "left_anti")
    return out


def apply_changes(target: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    """Whole-record saves: no id inserts, a known id updates the non-null columns given.

    Unknown ids change nothing; ``unknown_ids`` lists them. Changes without an id are numbered in
    the order of all their columns.
    """
    updates = changes.filter(F.col(id_col).isNotNull())
    known = updates.join(target.select(id_col), id_col, "left_semi")
    inserts = changes.filter(F.col(id_col).isNull()).drop(id_col)
    fresh = assign_ids(target, inserts, inserts.columns, id_col)
    return upsert(target, known, [id_col]).unionByName(
        fresh.select(*[c for c in target.columns if c in fresh.columns]), allowMissingColumns=True
    )


def unknown_ids(target: DataFrame, changes: DataFrame, id_col: str = "id") -> DataFrame:
    return (
        changes.filter(F.col(id_col).isNotNull())
        .join(target.select(id_col), id_col, "left_anti")
        .select(id_col)
        .distinct()
    )


def page(df: DataFrame, order: list[str | Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a listing; becomes a top-k per partition, never a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)
