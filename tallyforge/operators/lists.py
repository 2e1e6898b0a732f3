"""What list screens show: selections, orders, first pages, and the lookups of a row's neighbours.

A page is a top-k (`orderBy` and `limit`, which Spark takes per task before it merges), so no list is sorted whole for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of capture sessions that wait for a review, and of contact requests against the remote side.
PENDING_REVIEW = ("ready", "ready_for_review")
SYNC = ("pending", "synced", "conflict")


def chosen(column: str, value: str | int) -> Column:
    """A selector: every row for `all`, else those with the value."""
    return F.lit(True) if value == "all" else F.col(column) == value


def page(df: DataFrame, *order: Column, size: int = 50) -> DataFrame:
    """The first rows of a screen with their place from 1."""
    first = df.orderBy(*order).limit(size)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def by_name(column: str) -> Column:
    """Italian order of names, case and accents aside."""
    return F.collate(F.col(column), "it_CI_AI")


def in_menu_order(categories: DataFrame) -> DataFrame:
    """categories (id, parent_id, sort_order) with their place among those of one parent; no order counts as 0."""
    return categories.withColumn("place", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.coalesce("sort_order", F.lit(0)), "id")))


def page_counts(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """sessions (session_id) with page_count, the number of their segments (0 without any)."""
    counted = segments.groupBy("session_id").agg(F.count("*").alias("page_count"))
    return sessions.join(counted, "session_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def thumbnails(sessions: DataFrame, segments: DataFrame, attachments: DataFrame) -> DataFrame:
    """session_id and storage_key of the attachment of each session's first segment (session_id, sequence_index, attachment_id); sessions without a stored one are left out."""
    first = segments.groupBy("session_id").agg(F.min_by("attachment_id", F.struct("sequence_index", "attachment_id")).alias("attachment_id")).where("attachment_id is not null")
    return sessions.select("session_id").join(first, "session_id").join(attachments.select("attachment_id", "storage_key"), "attachment_id").where("storage_key is not null").select("session_id", "storage_key")


def attachment_owners(attachments: DataFrame, expenses: DataFrame, suppliers: DataFrame) -> DataFrame:
    """attachments (attachment_id, expense_id) with description and supplier name of their expense, empty where there is none."""
    s = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    # expenses find their supplier before attachments meet them, and attachments without an expense don't join: equal nulls would all go to one task
    e = expenses.select("expense_id", "description", "supplier_id").join(s, "supplier_id", "left").select("expense_id", "description", "supplier_name")
    rows = attachments.select("attachment_id", "expense_id")
    out = rows.where("expense_id is not null").join(e, "expense_id", "left").unionByName(rows.where("expense_id is null"), allowMissingColumns=True)
    return out.select("attachment_id", "expense_id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("supplier_name", F.lit("")).alias("supplier_name"))


def current_status(events: DataFrame) -> DataFrame:
    """Sessions from their append-only log (session_id, at, step, status): the last status by time and step, how many events, and whether it waits for a review."""
    last = events.groupBy("session_id").agg(F.max_by("status", F.struct("at", "step")).alias("status"), F.count("*").alias("events"), F.max("at").alias("updated_at"))
    return last.withColumn("pending_review", F.col("status").isin(*PENDING_REVIEW))


def reused_slots(slots: DataFrame, contributors: DataFrame) -> DataFrame:
    """order and id of the stored contributor that a new slot takes over: of those with its order, with the id `contrib-<order>` or that are unused placeholders (`unused`) the first by id.

    slots: order; contributors: id, order, unused. Three equalities in place of one disjunction; the placeholders are reduced to their first one before they meet all slots.
    """
    same_order = slots.join(contributors.select("order", "id"), "order")
    same_id = slots.withColumn("id", F.concat(F.lit("contrib-"), F.col("order").cast("string"))).join(contributors.select("id"), "id").select("order", "id")
    spare = slots.crossJoin(contributors.where("unused").agg(F.min("id").alias("id"))).where("id is not null")  # one row
    return same_order.unionByName(same_id).unionByName(spare).groupBy("order").agg(F.min("id").alias("id"))


def seed(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Seed rows that the table lacks, so that seeding twice adds nothing."""
    return rows.join(existing.select(key), key, "left_anti").select(*rows.columns)


def stamped(df: DataFrame, natural: list[str], now: str) -> DataFrame:
    """Rows as they are inserted: an id derived from their natural key (so a retried task gives the same), creation and change time, version 1."""
    new_id = F.sha2(F.to_json(F.struct(*natural)), 256)
    at = F.lit(now).cast("timestamp")
    return df.select(new_id.alias("id"), *df.columns, at.alias("created_at"), at.alias("updated_at"), F.lit(1).alias("version"))
