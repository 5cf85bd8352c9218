"""Reading and changing projects, maps and features, as their owner or as anyone else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_to(user_id: Column, owner: Column, is_private: Column) -> Column:
    """Owners see their projects, others those that are not private; an unknown flag counts as private."""
    return F.coalesce(owner == user_id, F.lit(False)) | ~F.coalesce(is_private, F.lit(True))


def project_listing(projects: DataFrame, users: DataFrame, user_id: int | None = None) -> DataFrame:
    """Public projects, or all of one user, newest first, with their owner's name where there is one."""
    chosen = projects.where(~F.col("is_private")) if user_id is None else projects.where(F.col("user_id") == user_id)
    return chosen.join(users, "user_id", "left").orderBy(F.desc_nulls_first("updated_at"))


def project_maps(maps: DataFrame) -> DataFrame:
    """maps with their place on the timeline of their project."""
    from pyspark.sql import Window

    order = Window.partitionBy("project_id").orderBy(F.asc_nulls_last("start_date"), F.asc_nulls_last("map_id"))
    return maps.withColumn("position", F.row_number().over(order))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, content: list[str]) -> DataFrame:
    """The rows after an upsert, each with its action: kept, unchanged, updated or inserted.

    Rows of incoming replace those of existing with the same key only where content differs, null equal to null.
    """
    old = existing.select(F.col(key).alias("_key"), F.struct("*").alias("_old"))
    new = incoming.select(F.col(key).alias("_key"), F.struct("*").alias("_new"))
    both = old.join(new, "_key", "full_outer")
    same = F.lit(True)
    for c in content:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    rows = both.withColumn("action", action)
    take = lambda c: F.when(F.col("action").isin("inserted", "updated"), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return rows.select(*(take(c).alias(c) for c in existing.columns), "action")


def bulk_delete(rows: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, ids that existed)."""
    ids = doomed.select(key).distinct()
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi").select(key)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key, if any, no parent has."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def latest_state(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by order."""
    last = F.max_by(F.struct(*log.columns), F.struct(*order))
    return log.groupBy(key).agg(last.alias("_last")).select("_last.*")


def progress(state: Column, current: Column, total: Column) -> Column:
    """Percent done, for a task's state."""
    part = F.when(total > 0, F.round(current / total * 100, 2)).otherwise(F.lit(0.0))
    return F.when(state == "SUCCESS", 100.0).when(state == "PROGRESS", part).otherwise(F.lit(0.0))
