"""Confirming the classification of receipts: products, aliases, suppliers and lines of many receipts in one change, and nothing twice.

New rows get ids from what they are (a product its catalogue name, a supplier its name, a line its process and position), so a product that many lines of many receipts propose is one row without
any counter, and a change that is made again makes the same rows. The first proposal, by process and position, gives a new product its details.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import matching, versions
from tallyforge.sources.adapters import saved

LINK, CREATE = "link_existing", "create_new"
TABLES = ("products", "aliases", "suppliers", "lines", "processes", "audit")
#: Lines that aren't stored yet have such ids, or none.
TEMPORARY = "temp-line-"


def new_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.substr(F.sha2(key, 256), F.lit(1), F.lit(16)))


def _open(requests: DataFrame, processes: DataFrame) -> DataFrame:
    """One request of each process that is known and not confirmed."""
    open_ = processes.where("not coalesce(confirmed, false)").select(F.col("id").alias("process_id"))
    return requests.dropDuplicates(["process_id"]).join(open_.hint("merge"), "process_id", "left_semi")


def _suppliers(requests: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(process_id, supplier_id, new_name) of requests; new_name is the name of a supplier that is new. A name counts where no id is given, or the id is `new`."""
    named = requests.where("trim(supplier_name) <> '' and coalesce(supplier_id, 'new') in ('', 'new')")
    found = matching.by_name_or_alias(named.select(F.col("process_id").alias("id"), F.col("supplier_name").alias("name")), suppliers)
    found = found.select(F.col("id").alias("process_id"), F.trim("name").alias("name"), "supplier_id")
    resolved = found.select("process_id", F.coalesce("supplier_id", new_id("sup", F.lower("name"))).alias("_found"), F.when(F.col("supplier_id").isNull(), F.col("name")).alias("new_name"))
    given = F.when(F.col("supplier_id") != "new", F.nullif("supplier_id", F.lit("")))
    return requests.join(resolved.hint("merge"), "process_id", "left").select("process_id", F.coalesce("_found", given).alias("supplier_id"), "new_name")


def _new_aliases(proposed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases (product_id, original_text, normalized_text, supplier_id) that proposals (product_id, norm, raw, original, supplier_id, at) add, one after the other in the order of `at`.

    A proposal is known if an alias of the product, stored or new, has its normal form or an original text equal to its raw text, blanks and case aside. Proposals are reduced to distinct
    texts first, so the fold over a product's is as long as it has new texts, however many lines have them.
    """
    texts = proposed.where(F.length("norm") > 1).groupBy("product_id", "norm", "raw", "original").agg(F.min(F.struct("at", "supplier_id")).alias("x"))
    texts = texts.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("x.at", "norm", "raw", "original", "x.supplier_id"))).alias("texts"))
    flat = lambda c: F.trim(F.upper(c))
    known = aliases.groupBy("product_id").agg(F.collect_set("normalized_text").alias("norms"), F.collect_set(flat(F.col("original_text"))).alias("originals"))
    rows = texts.join(known, "product_id", "left")
    none = F.array().cast("array<string>")
    kind = "struct<norms:array<string>,originals:array<string>,out:array<struct<original_text:string,normalized_text:string,supplier_id:string>>>"
    start = F.struct(F.coalesce("norms", none).alias("norms"), F.coalesce("originals", none).alias("originals"), F.array().alias("out")).cast(kind)

    def step(acc: Column, t: Column) -> Column:
        more = F.struct(
            F.array_append(acc["norms"], t["norm"]).alias("norms"), F.array_append(acc["originals"], flat(t["original"])).alias("originals"),
            F.array_append(acc["out"], F.struct(t["original"].alias("original_text"), t["norm"].alias("normalized_text"), t["supplier_id"].alias("supplier_id"))).alias("out"),
        ).cast(kind)
        return F.when(F.array_contains(acc["norms"], t["norm"]) | F.array_contains(acc["originals"], flat(t["raw"])), acc).otherwise(more)

    return rows.select("product_id", F.explode(F.aggregate("texts", start, step)["out"]).alias("a")).select("product_id", "a.*")


def _resolved(decisions: DataFrame, supplier: DataFrame, products: DataFrame) -> DataFrame:
    """Decisions of these processes with their supplier_id, texts (_raw, norm, name), known_id (the stored product of that name) and final (the product that the line gets)."""
    known = products.groupBy(F.col("normalized_name").alias("name")).agg(F.min("id").alias("known_id"))
    raw = F.coalesce(F.nullif("description", F.lit("")), "original_text", F.lit(""))
    rows = decisions.join(supplier.select("process_id", "supplier_id").hint("merge"), "process_id").withColumn("_raw", raw)
    rows = rows.withColumns({"norm": T.normalise(F.col("_raw")), "name": T.catalogue_name(F.col("_raw"))})
    final = F.when(F.col("action") == LINK, F.col("product_id")).when(F.col("action") == CREATE, F.coalesce("known_id", new_id("prod", F.col("name"))))
    return rows.join(known, "name", "left").withColumn("final", final)


def confirm(
    tables: dict[str, DataFrame], requests: DataFrame, decisions: DataFrame, deleted: DataFrame, once: Callable[[DataFrame, str], DataFrame] = lambda df, _: df
) -> dict[str, DataFrame]:
    """The new state of TABLES. Requests for unknown or confirmed processes change nothing.

    requests: process_id, supplier_id, supplier_name; decisions: process_id, position, line_id, action, product_id, description, original_text, category_id, line_total; deleted: process_id, line_id.
    tables: products (id, display_name, normalized_name, brand, barcode, unit, category_id), aliases (product_id, original_text, normalized_text, supplier_id), suppliers (id, name, aliases),
    lines (id, process_id, description, original_text, line_total, product_id, review_status), processes (id, supplier_id, confirmed), audit (entity_id, action, lines, products).
    once: keeps what several of these tables are made from (adapters.saved), for callers that compute most of them.
    """
    supplier = once(_suppliers(_open(requests, tables["processes"]), tables["suppliers"]), "suppliers-of-processes")
    new_suppliers = supplier.where("new_name is not null").groupBy(new_id("sup", F.lower("new_name")).alias("id")).agg(F.min("new_name").alias("name")).withColumn("aliases", F.array().cast("array<string>"))
    done = once(_resolved(decisions, supplier, tables["products"]), "decisions").withColumn("at", F.struct("process_id", "position"))
    first = done.where((F.col("action") == CREATE) & F.col("known_id").isNull()).groupBy("name").agg(F.min(F.struct("at", "_raw", "description", "category_id")).alias("x"))
    new = first.select(
        new_id("prod", F.col("name")).alias("id"), F.coalesce("x.description", "x._raw").alias("display_name"), F.col("name").alias("normalized_name"), T.brand(F.col("x._raw")).alias("brand"),
        T.barcode(F.col("x._raw")).alias("barcode"), T.unit(F.col("x._raw")).alias("unit"), F.col("x.category_id").alias("category_id"),
    )
    linked = done.where("final is not null")
    original = F.coalesce(F.nullif("original_text", F.lit("")), "description")
    new_aliases = _new_aliases(linked.select(F.col("final").alias("product_id"), "norm", F.col("_raw").alias("raw"), original.alias("original"), "supplier_id", "at"), tables["aliases"])
    # lines: deleted ones go, decided ones are confirmed, those without a stored id are new
    stored = tables["lines"].join(deleted.join(supplier.select("process_id"), "process_id", "left_semi").select(F.col("line_id").alias("id")).distinct(), "id", "left_anti")
    temporary = F.col("line_id").isNull() | F.col("line_id").startswith(TEMPORARY)
    change = F.struct("description", "line_total", F.col("final").alias("product_id"))
    last = done.where(~temporary).groupBy(F.col("line_id").alias("id")).agg(F.max_by(change, "at").alias("_c"))
    fields = {c: F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(c)) for c in ("description", "line_total", "product_id")}
    fields["review_status"] = F.when(F.col("_c").isNotNull(), "confirmed").otherwise(F.col("review_status"))
    lines = stored.join(last, "id", "left").select(*[fields.get(c, F.col(c)).alias(c) for c in tables["lines"].columns])
    added = done.where(temporary).select(
        F.concat_ws("-", F.lit("line"), "process_id", F.col("position").cast("string")).alias("id"), "process_id", "description", original.alias("original_text"), "line_total",
        F.col("final").alias("product_id"), F.lit("confirmed").alias("review_status"),
    )
    counts = done.groupBy("process_id").agg(F.count("*").alias("lines"))
    made = first.groupBy(F.col("x.at.process_id").alias("process_id")).agg(F.count("*").alias("products"))
    audit = supplier.select("process_id").join(counts.hint("merge"), "process_id", "left").join(made, "process_id", "left")
    audit = audit.select(F.col("process_id").alias("entity_id"), F.lit("update").alias("action"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("lines", "products")])
    processes = tables["processes"].join(supplier.select(F.col("process_id").alias("id"), F.col("supplier_id").alias("_s"), F.lit(True).alias("_now")), "id", "left")
    processes = processes.select("id", F.coalesce("_s", "supplier_id").alias("supplier_id"), (F.coalesce("confirmed", F.lit(False)) | F.coalesce("_now", F.lit(False))).alias("confirmed"))
    return {
        "products": tables["products"].unionByName(new), "aliases": tables["aliases"].unionByName(new_aliases), "suppliers": tables["suppliers"].unionByName(new_suppliers),
        "lines": lines.unionByName(added), "processes": processes, "audit": tables["audit"].unionByName(audit),
    }


def confirmed(spark: SparkSession, root: str, requests: DataFrame, decisions: DataFrame, deleted: DataFrame) -> int:
    """Confirm in a store (versions.py) as one version of all its tables; made again if somebody else changed them meanwhile. Without a request for an open process the version has the tables of the one before."""

    def change(snap: versions.Snapshot) -> dict[str, DataFrame]:
        tables = {t: snap.read(t) for t in TABLES}
        if _open(requests, tables["processes"]).isEmpty():
            return {}
        return confirm(tables, requests, decisions, deleted, saved)

    return versions.transact(spark, root, change)
