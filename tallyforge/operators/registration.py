"""From a reviewed receipt to an expense with items: idempotent, gated by the receipt's total, published as one change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.money import MONEY

#: Fixed value: the difference of sums that still passes, in money.
TOLERANCE = 0.01
#: Codes of the categories that stand in when nothing else is known.
STAND_IN_CODES = ["CAT_FOOD", "CAT_MISC"]


def already_booked(requests: DataFrame, expenses: DataFrame) -> DataFrame:
    """request_id and expense_id where one of four keys finds an expense; the first key in order wins: expense, process, session, attachment."""
    hits = None
    for rank, key in enumerate(("expense_id", "process_id", "session_id", "attachment_id")):
        e = expenses.where(F.col(key if key != "expense_id" else "id").isNotNull()).select(F.col("id").alias("found"), F.col(key if key != "expense_id" else "id").alias("k"))
        one = requests.select("request_id", F.col(key).alias("k")).join(e, "k").select("request_id", "found", F.lit(rank).alias("rank"))
        hits = one if hits is None else hits.unionByName(one)
    return hits.groupBy("request_id").agg(F.min_by("found", F.struct("rank", "found")).alias("expense_id"))


def gate(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Each document's line sum against its total: passes if one of them isn't positive, they differ by no more than TOLERANCE, or the difference was approved."""
    sums = lines.groupBy("document_id").agg(F.sum("line_total").cast(MONEY).alias("line_sum"), F.count("*").alias("n"))
    j = documents.join(sums, "document_id", "left").withColumn("line_sum", F.coalesce("line_sum", F.lit(0).cast(MONEY)))
    gap = F.abs(F.col("line_sum") - F.col("total"))
    blocked = (F.col("total") > 0) & (F.col("line_sum") > 0) & (F.coalesce("n", F.lit(0)) > 0) & (gap > TOLERANCE) & ~F.col("approved")
    return j.select("document_id", "total", "line_sum", gap.cast(MONEY).alias("gap"), F.coalesce(~blocked, F.lit(True)).alias("passes"))


def resolve_with_codes(documents: DataFrame, lines: DataFrame, categories: DataFrame) -> DataFrame:
    """document_id, category_id, subcategory_id: the pair asked for, the supplier's, that of the first line with a category, else the stand-in category, found by its code.

    A missing subcategory is the category's first child, or the category itself. documents: document_id, category_id, subcategory_id, supplier_category, supplier_subcategory; lines: document_id,
    line_index, category_id, subcategory_id; categories: id, parent_id, code, sort_order (null counts as 0).
    """
    place = F.struct(F.coalesce("sort_order", F.lit(0)), "id")
    stand_in = categories.agg(F.min_by("id", F.struct(~F.coalesce(F.col("code").isin(STAND_IN_CODES), F.lit(False)), place)).alias("stand_in"))
    children = categories.where("parent_id is not null").groupBy(F.col("parent_id").alias("category_id")).agg(F.min_by("id", place).alias("child"))
    pair = F.struct(F.col("category_id").alias("c"), F.col("subcategory_id").alias("s"))
    first = lines.where("category_id is not null").groupBy("document_id").agg(F.min_by(pair, F.struct("line_index", pair)).alias("line"))
    asked = F.when(F.col("category_id").isNotNull(), pair)
    supplier = F.when(F.col("supplier_category").isNotNull(), F.struct(F.col("supplier_category").alias("c"), F.col("supplier_subcategory").alias("s")))
    last = F.struct(F.col("stand_in").alias("c"), F.col("subcategory_id").alias("s"))
    picked = documents.join(first, "document_id", "left").crossJoin(F.broadcast(stand_in)).select("document_id", F.coalesce(asked, supplier, "line", last).alias("p"))  # one row
    picked = picked.select("document_id", F.col("p.c").alias("category_id"), F.col("p.s").alias("s")).join(children, "category_id", "left")
    return picked.select("document_id", "category_id", F.coalesce("s", "child", "category_id").alias("subcategory_id"))


def register(documents: DataFrame, lines: DataFrame, expenses: DataFrame, categories: DataFrame) -> dict[str, DataFrame]:
    """New rows of every table the registration touches: expenses, items, links, audit. Documents that are booked already or don't pass the gate have none.

    The category and subcategory come from resolve_with_codes (which says what documents, lines and categories hold). An item has its line's pair if the line has a category, else the expense's;
    a link ties each line to its item and expense.
    """
    requests = documents.select(F.col("document_id").alias("request_id"), "expense_id", "process_id", "session_id", "attachment_id")
    booked = already_booked(requests, expenses).select(F.col("request_id").alias("document_id"))
    passed = gate(documents, lines).where("passes")
    todo = documents.join(booked, "document_id", "left_anti").join(passed.select("document_id", "line_sum"), "document_id")
    resolved = resolve_with_codes(documents, lines, categories).select("document_id", F.col("category_id").alias("resolved"), F.col("subcategory_id").alias("resolved_sub"))
    todo = todo.join(resolved, "document_id")
    amount = F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("line_sum"))
    expense = todo.select(
        F.concat(F.lit("exp-"), F.col("document_id").cast("string")).alias("id"), "document_id", amount.alias("amount"), "date", F.year("date").alias("year"), F.month("date").alias("month"),
        F.col("resolved").alias("category_id"), F.col("resolved_sub").alias("subcategory_id"), "process_id", "session_id", "attachment_id",
    )
    own = F.col("category_id").isNotNull()
    booked_as = expense.select("document_id", F.col("id").alias("expense_id"), F.col("category_id").alias("_category"), F.col("subcategory_id").alias("_subcategory"))
    items = lines.join(booked_as, "document_id").select(
        F.concat_ws("-", "expense_id", F.col("line_index").cast("string")).alias("id"), "expense_id", "document_id", "line_index", "line_total", F.coalesce("category_id", "_category").alias("category_id"),
        F.when(own, F.col("subcategory_id")).otherwise(F.col("_subcategory")).alias("subcategory_id"),
    )
    links = items.select("document_id", "line_index", F.col("id").alias("item_id"), "expense_id")
    audit = expense.select(F.col("id").alias("entity_id"), F.lit("create").alias("action"), F.create_map(F.lit("amount"), F.col("amount").cast("string")).alias("new_values"))
    return {"expenses": expense, "items": items.drop("document_id"), "links": links, "audit": audit}
