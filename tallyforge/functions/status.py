"""Status vocabularies and the predicates on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for a cancelled record.
CANCELLED = ("cancelled", "canceled", "annullata", "annullato", "deleted", "inactive")
#: An expense with one of these needs no reminder.
SETTLED = ("paid", "cancelled", "canceled", "deleted", "inactive")
#: An expense with one of these has its reminders marked read.
CLOSED = ("paid", "cancelled", "canceled")


def is_cancelled(status: Column) -> Column:
    return F.coalesce(F.lower(status).isin(*CANCELLED), F.lit(False))


def is_unpaid(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).isin(*SETTLED)


def is_closed(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*CLOSED)


def expense_label(status: Column, date: Column, today: Column) -> Column:
    """Struct of label, badge, due_alert and days of an expense as seen on a day. An overdue one has days -1."""

    def info(label: str, badge: str, alert: str, days: Column | None = None) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(badge).alias("badge"), F.lit(alert).alias("due_alert"), (F.lit(None) if days is None else days).cast("int").alias("days"))

    days = F.datediff(date, today)
    return (
        F.when(status == "paid", info("Pagata", "success", "normal"))
        .when(is_cancelled(status), info("Annullata", "neutral", "normal"))
        .when(days < 0, info("Scaduta", "danger", "overdue", F.lit(-1)))
        .when(days <= 1, info("In scadenza", "warning", "within24h", days))
        .when(days == 2, info("In scadenza", "warning", "within48h", days))
        .when(days <= 30, info("In scadenza", "warning", "normal", days))
        .when(status == "planned", info("Pianificata", "info", "normal"))
        .otherwise(info("Da pagare", "warning", "normal"))
    )


def income_label(status: Column) -> Column:
    """Struct of label and badge of an income."""

    def info(label: str, badge: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(badge).alias("badge"))

    return F.when(status == "received", info("Incassata", "success")).when(is_cancelled(status), info("Annullata", "neutral")).when(status == "skipped", info("Saltata", "warning")).otherwise(info("Pianificata", "info"))
