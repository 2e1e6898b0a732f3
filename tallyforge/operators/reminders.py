"""Deadline reminders: due expenses to messages with a unique key, and the clean-up of those that are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.status import is_closed, is_unpaid

#: Hours before the due date and the same in days.
OFFSETS = {48: 2, 24: 1}


def generate(expenses: DataFrame, suppliers: DataFrame, contributors: DataFrame, sent: DataFrame, today: str) -> DataFrame:
    """A reminder for each unpaid expense due in one or two days whose key is not among sent.unique_key.

    The day of the expense decides the offset, so the date filter reaches the scan and at most one offset applies. Recipients are a few contributors: they are collected
    into one row before the join.
    """
    day = F.lit(today).cast("date")
    due = expenses.where((F.col("expense_date") >= F.date_add(day, 1)) & (F.col("expense_date") <= F.date_add(day, 2))).where(is_unpaid(F.col("status")))
    hours = F.datediff("expense_date", day) * 24
    name = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    rows = due.withColumn("hours", hours).join(name, "supplier_id", "left").withColumn("supplier_name", F.coalesce("supplier_name", F.lit("")))
    label = F.coalesce(F.nullif("description", F.lit("")), F.nullif("supplier_name", F.lit("")), F.lit("Spesa"))
    kind = F.when(F.col("entry_mode") == "fixedExpense", "fixedExpense").otherwise("expense")
    date = F.date_format("expense_date", "yyyy-MM-dd")
    amount = F.concat(F.lit("€"), F.col("amount").cast("decimal(18,2)").cast("string"))
    rows = rows.withColumn("unique_key", F.concat_ws("_", kind, F.col("id").cast("string"), date, F.concat(F.col("hours").cast("string"), F.lit("h"))))
    rows = rows.join(sent.select("unique_key").distinct(), "unique_key", "left_anti")
    title = F.when(F.col("hours") == 48, F.concat(F.lit("Scadenza "), label, F.lit(" tra 48 ore"))).otherwise(F.concat(F.lit("Scadenza "), label, F.lit(" domani")))
    message = F.when(F.col("hours") == 48, F.concat(F.lit("La spesa "), label, F.lit(" di "), amount, F.lit(" scade il "), date, F.lit("."))).otherwise(F.concat(F.lit("La spesa "), label, F.lit(" di "), amount, F.lit(" scade domani ("), date, F.lit(").")))
    eligible = contributors.where(F.col("active") & F.col("receive_emails") & (F.trim(F.coalesce("email", F.lit(""))) != ""))

    def addresses(flag: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("id", F.trim("email").alias("email"))))), lambda s: s["email"]), ",")

    to = eligible.agg(addresses("receive_48h").alias("to48"), addresses("receive_24h").alias("to24"))  # one row
    return rows.crossJoin(F.broadcast(to)).select("unique_key", F.col("id").alias("expense_id"), F.concat(F.lit("deadline_"), F.col("hours").cast("string"), F.lit("h")).alias("type"), title.alias("title"), message.alias("message"), F.when(F.col("hours") == 48, F.col("to48")).otherwise(F.col("to24")).alias("recipients"))


def mark_read(notifications: DataFrame, expenses: DataFrame) -> DataFrame:
    """notifications with `read` set where the expense they are about is paid or cancelled."""
    closed = expenses.where(is_closed(F.col("status"))).select(F.col("id").alias("related_entity_id"), F.lit(True).alias("closed")).distinct()
    return notifications.join(closed, "related_entity_id", "left").withColumn("read", F.col("read") | F.coalesce("closed", F.lit(False))).drop("closed")


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count_if(~F.col("read")).alias("unread"))
