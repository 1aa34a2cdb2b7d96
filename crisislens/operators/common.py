"""Shared building blocks of the table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

By = Sequence[str]


def neg_flag() -> Column:
    return F.col("sentiment").isin(*C.NEGATIVE_SENTIMENTS)


def top_k(df: DataFrame, order: list[Column], n: int | None, by: By = (), rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n by ``order`` (a total order), per ``by`` group.

    Without groups: ``orderBy().limit()`` plans a TakeOrderedAndProject
    (per-partition top-n, then a merge of n-row lists); the rank is then
    numbered over those n rows only.  With groups: ``row_number() <= n`` over
    ``partitionBy(by)``, which Spark turns into a per-partition group limit
    before the shuffle, so a hot group never travels whole.  Without groups
    and without ``n`` the rows are sorted but not ranked (a rank over all rows
    would be the work of one task).
    """
    if n is None and not by:
        return df.orderBy(*order)
    if n is None:
        w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
        return df.withColumn(rank_col, F.row_number().over(w).cast("bigint"))
    if not by:
        head = df.orderBy(*order).limit(n)
        return head.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).where(F.col(rank_col) <= n)


def explode_list(df: DataFrame, col: str, alias: str, keep: By = ()) -> DataFrame:
    """One row per list element, keeping ``keep`` columns.

    ``explode_outer`` on purpose: an inner explode makes the optimizer infer
    ``size(list) > 0`` and push that predicate below the projection, which
    inlines (and re-evaluates) the whole text pipeline that built the list.
    Empty lists yield one null element; callers drop it where it matters.
    """
    return df.select(*keep, F.explode_outer(col).alias(alias))


def group_totals(E: DataFrame, by: By, name: str = "n_posts") -> DataFrame:
    """Post count per ``by`` group (one row when ``by`` is empty)."""
    return E.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def attach(df: DataFrame, small: DataFrame, by: By) -> DataFrame:
    """Join per-group scalars onto ``df``.  With no groups it is a one-row
    broadcast; with groups it is an equi-join on the group keys, and the
    planner (AQE) broadcasts it only when its measured size allows."""
    if not by:
        return df.crossJoin(F.broadcast(small))
    return df.join(small, list(by), "inner")


def over_group(by: By) -> Window:
    """Window over a whole group of *aggregated* rows (never raw posts)."""
    return Window.partitionBy(*by) if by else Window.partitionBy()
