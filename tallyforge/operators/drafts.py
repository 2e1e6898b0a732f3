"""Review drafts: what a reviewer sees, what is stored while they edit, and what is decided for each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What can become of a line, the product id that asks for a new product, how unsaved lines are named, and the keys of a line's saved choices.
LINK, CREATE, UNLINKED, ASKED, UNSAVED = "link_existing", "create_new", "unlinked", "CREATE_NEW", "temp-line-"
CHOICES = {"categoryId": "category_id", "subcategoryId": "subcategory_id", "actionMode": "action_mode", "newProductDisplayName": "new_product_name"}


def _given(column: str) -> Column:
    """A text, or null where it is empty."""
    return F.nullif(F.col(column), F.lit(""))


def _or(column: str, default: Column | float | int | str) -> Column:
    """A number or text, or the default where it is missing, 0 or empty."""
    c = F.col(column)
    return F.coalesce(F.when(c.cast("string").isin("", "0", "0.0"), None).otherwise(c), default if isinstance(default, Column) else F.lit(default))


def review_lines(lines: DataFrame, proposals: DataFrame) -> DataFrame:
    """Lines as a review shows them. lines: line_id, original_text, description, quantity, unit_price, line_total, product_id, metadata (map of strings); proposals: line_id, proposed_category, proposed_product, proposed_new_name, level.

    A saved choice counts before a proposal, also a saved empty category; without a saved action a product means a link and a proposed new product means creation.
    """
    p = proposals.select("line_id", "proposed_category", "proposed_product", "proposed_new_name", "level")
    saved = lambda k: F.try_element_at(F.col("metadata"), F.lit(k))
    has_category = F.coalesce(F.array_contains(F.map_keys("metadata"), "categoryId"), F.lit(False))
    product = F.coalesce(_given("product_id"), F.col("proposed_product"))
    derived = F.when(product.isNotNull(), LINK).when(F.col("proposed_new_name").isNotNull(), CREATE).otherwise(UNLINKED)
    return lines.join(p, "line_id", "left").select(
        "line_id", F.coalesce(_given("original_text"), "description").alias("original_text"), F.coalesce(_given("description"), "original_text").alias("description"), _or("quantity", 1.0).alias("quantity"), _or("unit_price", 0.0).alias("unit_price"),
        _or("line_total", 0.0).alias("line_total"), product.alias("product_id"), F.when(has_category, saved("categoryId")).otherwise(F.col("proposed_category")).alias("category_id"),
        F.coalesce("level", F.when(product.isNotNull(), "exact").otherwise("new_product")).alias("level"), F.coalesce(F.nullif(saved("actionMode"), F.lit("")), derived).alias("action_mode"),
        F.coalesce(F.nullif(saved("newProductDisplayName"), F.lit("")), _given("proposed_new_name"), _given("description"), "original_text").alias("new_product_name"),
    )


def save_draft(stored: DataFrame, edited: DataFrame, processes: DataFrame) -> DataFrame:
    """The stored lines after a draft is saved. stored: process_id, line_id, description, line_total, status, metadata, confirmed; edited: the same without metadata and confirmed, with the columns of CHOICES; processes: process_id of
    the edited ones, also of those with no line left.

    One full join does the batch: lines gone from the form of an edited process go, unsaved lines are created as modified, others take the form's values. Choices are merged over what
    the metadata held, and nothing is confirmed by a draft. Processes that nobody edited stay as they are.
    """
    touched = processes.select("process_id", F.lit(True).alias("_touched")).distinct()
    e = edited.select("process_id", "line_id", *[F.col(c).alias(f"_{c}") for c in ("description", "line_total", "status", *CHOICES.values())], F.lit(True).alias("_edited"))
    j = stored.withColumn("_stored", F.lit(True)).join(e, ["process_id", "line_id"], "full").join(touched, "process_id", "left")
    j = j.where("_edited or _touched is null")
    new = F.col("_stored").isNull() | F.col("line_id").startswith(UNSAVED)
    choices = F.create_map(*[x for k, c in CHOICES.items() for x in (F.lit(k), F.col(f"_{c}"))])
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*CHOICES))
    pick = lambda c: F.when(F.col("_edited"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(
        "process_id", "line_id", pick("description"), pick("line_total"), F.when(F.col("_edited"), F.when(new, "modified").otherwise(F.col("_status"))).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_edited"), F.map_concat(kept, choices)).otherwise(F.col("metadata")).alias("metadata"), F.when(F.col("_edited"), F.lit(False)).otherwise(F.col("confirmed")).alias("confirmed"),
    )


def decisions(lines: DataFrame) -> DataFrame:
    """What is decided for each line (line_id, product_id, action_mode, new_product_name, description): a real product id links, a request for a new product creates, else the line's own action."""
    product = _given("product_id")
    action = F.when(product.isNotNull() & (product != ASKED), LINK).when((product == ASKED) | (F.col("action_mode") == CREATE), CREATE).otherwise(F.coalesce(_given("action_mode"), F.lit(UNLINKED)))
    done = lines.withColumn("action", action)
    return done.select("line_id", "action", F.when(F.col("action") == LINK, product).alias("product_id"), F.when(F.col("action") == CREATE, F.coalesce(_given("new_product_name"), "description")).alias("new_name"))


def decided_categories(lines: DataFrame, made: DataFrame, main: Column) -> DataFrame:
    """lines (line_id, original_text, category_id) with the category they are booked under: of the decision with their id, else of the one with their text, else their own, else the main one.

    made: key (a line id or a text), category_id; of several decisions with one key the last by `at` counts.
    """
    d = made.groupBy("key").agg(F.max_by("category_id", "at").alias("c"), F.lit(True).alias("found"))
    by_id = d.select(F.col("key").alias("line_id"), F.col("c").alias("_c1"), F.col("found").alias("_f1"))
    by_text = d.select(F.col("key").alias("original_text"), F.col("c").alias("_c2"))
    j = lines.join(by_id, "line_id", "left").join(by_text, "original_text", "left")
    decided = F.when(F.col("_f1"), F.col("_c1")).otherwise(F.col("_c2"))
    return j.select("line_id", F.coalesce(F.nullif(decided, F.lit("")), _given("category_id"), main).alias("category_id"))


def product_profiles(products: DataFrame, aliases: DataFrame, prices: DataFrame) -> DataFrame:
    """What a product is compared by. products: product_id, display_name, normalized_name; aliases: product_id, original_text, normalized_text; prices: product_id, price.

    Aliases and prices are reduced to a row a product before they meet the products. `texts` are the names and then the original and normal forms of the aliases; `full_text` joins them.
    """
    a = aliases.groupBy("product_id").agg(F.sort_array(F.collect_set(F.struct("original_text", "normalized_text"))).alias("al"))
    p = prices.groupBy("product_id").agg((F.sum(F.col("price").cast("decimal(18,2)")).cast("double") / F.count("price")).alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    texts = F.concat(F.array("display_name", "normalized_name"), F.coalesce(F.col("al.original_text"), F.array()), F.coalesce(F.col("al.normalized_text"), F.array()))
    j = products.join(a, "product_id", "left").join(p, "product_id", "left")
    j = j.withColumn("texts", F.filter(texts, lambda t: t.isNotNull() & (t != "")))
    return j.select("product_id", "texts", F.array_join("texts", " ").alias("full_text"), F.coalesce(F.size("al"), F.lit(0)).alias("n_aliases"), "avg_price", "min_price", "max_price")
