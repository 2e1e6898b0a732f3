"""Review of a parsed receipt before it is booked: groups of lines, sums, edits, and the messages that hold it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.labels import is_placeholder
from tallyforge.functions.money import js_round

UNCLASSIFIED = "cat-unclassified"
DISCOUNT, RETURN, EITHER = "(?i)SCONTO|PROMO|ABBUONO|COUPON|BUONO", "(?i)RESO|STORNO|RESTITUITO", "(?i)SCONTO|PROMO|ABBUONO|COUPON|BUONO|RESO|STORNO"


def _no_category() -> Column:
    return F.coalesce(F.col("category_id"), F.lit("")).isin("", UNCLASSIFIED)


def line_groups(lines: DataFrame) -> DataFrame:
    """lines (quantity, unit_price, line_total, category_id, description, status, conflict, warnings) with a flag for each group a reviewer can show."""
    flat = (F.col("unit_price") <= 0) & (F.col("line_total") == 0)
    return lines.withColumns({
        "is_error": _no_category() | (F.col("quantity") <= 0) | flat | F.col("conflict") | (F.size("warnings") > 0), "is_unclassified": _no_category(), "is_modified": F.col("status") == "modified",
        "is_discount": (F.col("line_total") < 0) | F.col("description").rlike(DISCOUNT) | F.array_contains("warnings", "DISCOUNT_LINE"), "is_return": (F.col("line_total") < 0) | F.col("description").rlike(RETURN),
    })


def line_sum(lines: DataFrame, key: str) -> DataFrame:
    """Sum of each document's lines; a line without a positive total counts quantity times price."""
    value = F.when(F.col("line_total") > 0, F.col("line_total")).otherwise(F.col("quantity") * F.col("unit_price"))
    return lines.groupBy(key).agg(F.sum(value.cast("decimal(24,4)")).alias("s")).select(key, js_round(F.col("s"), 2).alias("line_sum"))


def edit(lines: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Apply edits of quantity or unit price: the total follows and the line counts as modified."""
    e = edits.select(key, F.col("quantity").alias("_q"), F.col("unit_price").alias("_p"))
    j = lines.join(e, key, "left")
    touched = F.col("_q").isNotNull() | F.col("_p").isNotNull()
    q, p = F.coalesce("_q", "quantity"), F.coalesce("_p", "unit_price")
    new = {"quantity": q, "unit_price": p, "line_total": F.when(touched, js_round(q * p, 2)).otherwise(F.col("line_total")), "status": F.when(touched, "modified").otherwise(F.col("status"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in lines.columns])


def line_errors() -> Column:
    """Messages of one line, in order; a line without any has an empty array."""
    name = F.concat(F.lit('"'), F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.concat(F.lit("Riga #"), (F.col("line_index") + 1).cast("string"))), F.lit('"'))
    exempt = (F.col("line_total") < 0) | F.coalesce("description", F.lit("")).rlike(EITHER)
    messages = F.array(
        F.when(F.trim(F.coalesce("description", F.lit(""))) == "", F.concat(F.lit("Riga #"), (F.col("line_index") + 1).cast("string"), F.lit(": descrizione articolo mancante."))),
        F.when(_no_category(), F.concat(name, F.lit(": categoria mancante. Seleziona una categoria valida prima di confermare."))),
        F.when(F.col("quantity") <= 0, F.concat(name, F.lit(": quantità non valida."))),
        F.when(~exempt & (F.col("unit_price") <= 0) & (F.col("line_total") <= 0), F.concat(name, F.lit(": importo riga non valido (prezzo unitario e totale <= 0)."))),
    )
    return F.array_compact(messages)


def first_error(*tests: tuple[Column, str]) -> Column:
    """The message of the first test that holds, else null: ordered validation of a form."""
    out: Column | None = None
    for test, message in tests:
        out = F.when(test, message) if out is None else out.when(test, message)
    return out


def income_error() -> Column:
    return first_error(
        (F.trim(F.coalesce("contributor_id", F.lit(""))) == "", "Seleziona un contributore."), (F.coalesce("amount", F.lit(0)) <= 0, "Inserisci un importo valido e maggiore di zero."), (F.col("date").isNull(), "Inserisci una data di incasso valida.")
    )


def expense_error() -> Column:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return first_error(
        (blank("description"), "Inserisci una descrizione per la spesa."), (F.coalesce("amount", F.lit(0)) <= 0, "Inserisci un importo valido e maggiore di zero."), (F.col("date").isNull(), "Inserisci una data spesa valida."), (blank("category_id"), "Seleziona una categoria principale."),
        (blank("subcategory_id"), "Seleziona una sottocategoria."),
    )


def project_slots(projects: DataFrame, slots: int = 3) -> DataFrame:
    """Slots 1..n with the project of that slot, else the one at that place in order of id."""
    spark = projects.sparkSession
    ordered = projects.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id"))).where(F.col("place") <= slots)
    by_slot = projects.where(F.col("slot").between(1, slots)).groupBy("slot").agg(F.min("id").alias("a"))
    by_place = ordered.select(F.col("place").alias("slot"), F.col("id").alias("b"))
    return spark.range(1, slots + 1).select(F.col("id").cast("int").alias("slot")).join(by_slot, "slot", "left").join(by_place, "slot", "left").select("slot", F.coalesce("a", "b").alias("project_id"))


def visible_contributors(contributors: DataFrame, referenced: DataFrame) -> DataFrame:
    """Contributors that are no unused placeholders, renumbered from 1. referenced: contributor ids that records use."""
    used = referenced.select(F.col("contributor_id").alias("id"), F.lit(True).alias("_used")).distinct()
    rows = contributors.join(used, "id", "left")
    kept = rows.where(~is_placeholder(F.col("order"), F.col("active"), F.coalesce("_used", F.lit(False)), F.col("name"), F.col("email"), F.col("notified"))).drop("_used")
    return kept.withColumn("order", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order", "id")))
