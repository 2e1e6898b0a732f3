"""Registered queries: record store, closing, reconciliation, registration, documents, logs and exchange files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.money import MONEY, js_round
from tallyforge.operators import audit, closing, confirmation, reconcile, registration, store, versions
from tallyforge.plans.receipt_plans import _NORM
from tallyforge.sources import adapters as A
from tallyforge.sources import backup

NOW = "1998-07-01 00:00:00"


def _base(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("version"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Later states: each order changes its customer's balance."""
    return A.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_totalprice").alias("balance"), (F.col("o_orderkey") + 2).cast("int").alias("version"))


def last_write_wins_upsert(spark: SparkSession, d: str) -> DataFrame:
    return store.last_write(_base(spark, d), _changes(spark, d), ["id"], ["version"])


def patch_versions(spark: SparkSession, d: str) -> DataFrame:
    patches = _base(spark, d).where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new "), F.col("name"))).alias("name"))
    return store.patch(_base(spark, d), patches, "id")


def set_reconcile(spark: SparkSession, d: str) -> DataFrame:
    wanted = _base(spark, d).where("id % 4 <> 0").withColumn("id", F.when(F.col("id") % 7 == 0, F.col("id") + 100000).otherwise(F.col("id"))).withColumn("balance", F.when(F.col("id") % 5 == 0, F.lit(0.0)).otherwise(F.col("balance")))
    return store.set_reconcile(_base(spark, d), wanted, "id", ["name", "balance"])


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = A.read(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return store.without(A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), gone, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def set_null_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = A.read(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return store.set_null(A.read(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


def delete_unconfirmed(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem").withColumn("review", F.when(F.col("l_returnflag") == "R", "confirmed").when(F.col("l_returnflag") == "A", "rejected").otherwise("pending"))
    return li.where(~F.col("review").isin("pending", "rejected")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    return store.duplicates(A.read(spark, d, "part").select(T.normalise(F.col("p_name")).alias("name")), ["name"])


def max3_enforced(spark: SparkSession, d: str) -> DataFrame:
    return store.beyond(A.read(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], 3)


def first_match(spark: SparkSession, d: str) -> DataFrame:
    return store.first_by(A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])


def default_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each customer: some have stored both fields, some one, most none."""
    c = A.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    currency = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("C"), F.col("c_nationkey").cast("string")))
    stored = c.where("c_mktsegment = 'BUILDING'").select("id", currency.alias("currency"), (F.col("c_nationkey") % 7).cast("int").alias("first_day"))
    return store.defaulted_each(c.select("id"), stored, "id", {"currency": F.lit("EUR"), "first_day": F.lit(1)})


def segment_reindex(spark: SparkSession, d: str) -> DataFrame:
    s = A.read(spark, d, "documents").select("doc_id", F.col("source").alias("session"))
    return store.reindex(s, "session", ["doc_id"], "sequence_index")


def _region(number: Column) -> Column:
    return F.concat(F.lit("r"), (number % 5).cast("string"))


def _coded_categories(spark: SparkSession, d: str) -> DataFrame:
    return A.categories(spark, d).select("id", "parent_id", F.when(F.col("name") == "EUROPE", F.lit("CAT_MISC")).alias("code"), F.length("name").alias("sort_order"))


def expense_categories(spark: SparkSession, d: str) -> DataFrame:
    region = lambda number: _region(F.col(number))
    n, part = F.col("o_orderkey"), F.col("l_partkey")
    docs = A.read(spark, d, "orders").select(n.alias("document_id"), F.when(n % 3 == 0, region("o_custkey")).alias("category_id"), F.when(n % 4 == 0, F.lit("asked")).alias("subcategory_id"), F.when(n % 7 == 0, region("o_orderkey")).alias("supplier_category"), F.lit(None).cast("string").alias("supplier_subcategory"))
    lines = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("line_index"), F.when(part % 2 == 0, region("l_suppkey")).alias("category_id"), F.when(part % 4 == 0, F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))).alias("subcategory_id"))
    return registration.resolve_with_codes(docs, lines, _coded_categories(spark, d))


def segment_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Even documents are listed twice, the later place counts; every fifth is listed under another session, where it does nothing."""
    s = A.read(spark, d, "documents").select("doc_id", F.col("source").alias("session"), F.col("n_chars").cast("long").alias("sequence_index"))
    place = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id"), F.col("doc_id") + 7))
    listed = s.select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("not "), "session")).otherwise(F.col("session")).alias("session"), "doc_id", F.explode(place).alias("position"))
    return store.reorder(s, listed, "session", "doc_id", "sequence_index")


def file_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    s = A.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return s.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def active_session_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """For each file that occurs again: the newest session with it that is neither cancelled nor done."""
    s = A.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.element_at(F.array(*map(F.lit, ["draft", "ready", "completed", "cancelled"])), (F.col("doc_id") % 4).cast("int") + 1).alias("status"))
    return s.where(~F.col("status").isin("completed", "cancelled")).groupBy("file_hash").agg(F.max("doc_id").alias("session_id"), F.max_by("status", "doc_id").alias("status"))


def document_assembly(spark: SparkSession, d: str) -> DataFrame:
    pages = A.read(spark, d, "conversations").select("conv_id", "turn", F.trim("text").alias("t"))
    kept = pages.where("t <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("p"), F.avg(F.length("t") % 101).alias("c"))
    return kept.select("conv_id", F.size("p").alias("pages"), F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")).alias("text_md5"), js_round(F.col("c")).alias("confidence"))


def _reports(spark: SparkSession) -> DataFrame:
    r = spark.range(1997 * 12 + 6, 1998 * 12 + 12).select(F.floor((F.col("id") - 1) / 12).cast("int").alias("year"), (F.pmod(F.col("id") - 1, F.lit(12)) + 1).cast("int").alias("month"), "id")
    return r.select("year", "month", F.when(F.col("id") % 3 == 0, "final").otherwise("provisional").alias("status"), F.when(F.col("id") % 3 == 0, F.lit("1998-05-05 00:00:00").cast("timestamp")).alias("closed_at"), F.lit(0).cast(MONEY).alias("total_expenses"), F.lit(0).cast(MONEY).alias("paid_expenses"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    e = A.expenses(spark, d).where("status <> 'cancelled'")
    g = e.groupBy(F.year("expense_date").alias("year"), F.month("expense_date").alias("month"))
    return g.agg(F.sum("amount").cast(MONEY).alias("total_expenses"), F.sum(F.when(F.col("status") == "paid", F.col("amount")).otherwise(0)).cast(MONEY).alias("paid_expenses"))


def _shown(reports: DataFrame) -> DataFrame:
    return reports.select("year", "month", "status", F.col("closed_at").isNotNull().alias("closed"), F.col("total_expenses").cast("double"), F.col("paid_expenses").cast("double"))


def close_expired_months(spark: SparkSession, d: str) -> DataFrame:
    return _shown(closing.run_check(_reports(spark), _totals(spark, d), NOW))


def reopen_premature(spark: SparkSession, d: str) -> DataFrame:
    return _shown(closing.reopen(_reports(spark), NOW))


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem").where("l_linenumber = 1 and l_shipdate >= timestamp'1997-06-01' and l_shipdate < timestamp'1998-12-01'")
    return li.groupBy(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("process_id")).agg(F.min("l_extendedprice").cast(MONEY).alias("amount"), F.min(F.to_date("l_shipdate")).alias("expense_date"))


def late_registration_recompute(spark: SparkSession, d: str) -> DataFrame:
    known = A.read(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("process_id"))
    accepted, _ = closing.register_late(known, _incoming(spark, d), _reports(spark), NOW)
    return _shown(closing.recompute(_reports(spark), accepted))


def contact_reconcile(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "customer").where("c_custkey % 2 = 0")
    local = c.select(F.col("c_custkey").alias("id"), F.lit("new").alias("status"), F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("linked"), F.when(F.col("c_custkey") % 4 == 0, "pending").otherwise("synced").alias("sync_status"), (F.col("c_custkey") % 9).alias("updated_at"))
    r = A.read(spark, d, "customer").where("c_custkey % 3 = 0")
    remote = r.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "closed").when(F.col("c_custkey") % 7 == 0, "in_review").otherwise("new").alias("status"), F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("linked"), (F.col("c_custkey") % 11).alias("updated_at"))
    return reconcile.apply_remote(local, remote, ["status", "linked"], ["status", "linked"])


def _documents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = A.read(spark, d, "orders")
    n = F.col("o_orderkey")
    docs = o.select(
        n.alias("document_id"), F.when(n % 4 == 0, F.lit(0)).otherwise(F.col("o_totalprice")).cast(MONEY).alias("total"), (n % 5 == 0).alias("approved"), F.to_date("o_orderdate").alias("date"),
        F.when(n % 3 == 0, _region(F.col("o_custkey"))).alias("category_id"), F.when(n % 4 == 0, F.lit("asked")).alias("subcategory_id"),
        F.when(n % 7 == 0, _region(n)).alias("supplier_category"), F.lit(None).cast("string").alias("supplier_subcategory"),
        F.when(n % 50 == 1, F.concat(F.lit("e"), n.cast("string"))).alias("expense_id"), F.concat(F.lit("p"), n.cast("string")).alias("process_id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("attachment_id"),
    )
    lines = A.read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_extendedprice").cast(MONEY).alias("line_total"))
    i = F.col("l_linenumber")
    lines = lines.select(
        F.col("l_orderkey").alias("document_id"), i.alias("line_index"), "line_total", F.when(i % 2 == 0, _region(i)).alias("category_id"),
        F.when(i % 4 == 0, F.concat(F.lit("line"), i.cast("string"))).alias("subcategory_id"),
    )
    booked = o.where("o_orderkey % 9 = 0").select(F.concat(F.lit("x"), n.cast("string")).alias("id"), F.concat(F.lit("p"), n.cast("string")).alias("process_id"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("attachment_id"))
    booked = booked.unionByName(o.where("o_orderkey % 100 = 1").select(F.concat(F.lit("e"), n.cast("string")).alias("id"), *[F.lit(None).cast("string").alias(c) for c in ("process_id", "session_id", "attachment_id")]))
    return docs, lines, booked


def discrepancy_gate(spark: SparkSession, d: str) -> DataFrame:
    docs, lines, _ = _documents(spark, d)
    return registration.gate(docs, lines).select("document_id", F.col("line_sum").cast("double"), F.col("gap").cast("double"), "passes")


def _registered(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    docs, lines, booked = _documents(spark, d)
    return registration.register(docs, lines, booked, _coded_categories(spark, d))


def accounting_registration(spark: SparkSession, d: str) -> DataFrame:
    return _registered(spark, d)["expenses"].select("id", "document_id", F.col("amount").cast("double"), "year", "month", "category_id", "subcategory_id")


def registered_items(spark: SparkSession, d: str) -> DataFrame:
    return _registered(spark, d)["items"].groupBy("category_id", "subcategory_id").agg(F.count("*").alias("n"), F.sum("line_total").cast("double").alias("total"))


def registered_links(spark: SparkSession, d: str) -> DataFrame:
    return _registered(spark, d)["links"]


def closing_state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Orders arrive up to 119 days late; months become final when the next one begins, and some are opened again for ten days. What each arrival finds, by month and state."""
    o = A.read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    ym = F.year("day") * 12 + F.month("day") - 1
    facts = o.select(ym.alias("ym"), F.date_add("day", (F.col("o_orderkey") % 120).cast("int")).alias("at"))
    months = facts.select("ym").distinct().withColumn("end", F.make_date((F.floor(F.col("ym") / 12)).cast("int"), (F.col("ym") % 12 + 1).cast("int"), F.lit(1)))
    months = months.withColumn("end", F.add_months("end", 1))
    state = lambda days, status: F.struct(F.date_add("end", days).alias("at"), F.lit(status).alias("status"))
    states = F.when(F.col("ym") % 5 == 0, F.array(state(0, "final"), state(20, "provisional"), state(30, "final"))).otherwise(F.array(state(0, "final")))
    history = months.select("ym", F.explode(states).alias("s")).select("ym", "s.*")
    return closing.as_of(facts, history).groupBy("ym", "month_status", "month_since", "late").agg(F.count("*").alias("n"))


def audit_by_entity(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").where("user_id = 7 and event_type = 'error'")
    return e.select("event_id", "ts", F.get_json_object("props", "$.k").cast("int").alias("k")).orderBy(F.desc("ts"))


def json_metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum(F.col("value").cast(MONEY)).cast("double").alias("total"))


def backup_checksum(spark: SparkSession, d: str) -> DataFrame:
    return backup.row_checksums(A.read(spark, d, "nation").unionByName(A.read(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"))))


#: The driver's tables by the column that numbers their rows.
TABLES = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}


def restore_all_tables(spark: SparkSession, d: str) -> DataFrame:
    """Back up every table, clear a store that holds something else and restore it; what the store then has."""
    path, root = A.new_folder(spark, "backup"), A.new_folder(spark, "store")
    backup.write({t: A.read(spark, d, t) for t in TABLES}, path, "hash")
    store.publish({"region": A.read(spark, d, "nation"), "scraps": A.read(spark, d, "region")}, root)
    version = backup.restore(spark, path, root)
    now = versions.snapshot(spark, root)
    parts = [now.read(t).agg(F.lit(t).alias("table"), F.lit(version).alias("version"), F.count("*").alias("rows"), F.sum(F.col(TABLES[t]).cast("long")).alias("keys")) for t in now.names()]
    return reduce(DataFrame.unionByName, parts)


def _audit_entries(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity"), F.col("event_type").alias("action"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("props").alias("payload"))


def audit_chain_breaks(spark: SparkSession, d: str) -> DataFrame:
    """A chained log of all events in two batches (the second one written twice), some entries of which are then removed or rewritten: the first broken link of each user."""
    entries, root = _audit_entries(spark, d), A.new_folder(spark, "audit")
    middle = entries.agg(F.expr("percentile_disc(0.5) within group (order by at)").alias("m")).first().m
    late = entries.where(F.col("at") > middle) if middle is not None else entries.limit(0)
    audit.append(entries.where(F.col("at") <= middle) if middle is not None else entries, 0, root)
    for _ in range(2):
        audit.append(late, 1, root)
    log = audit.log(spark, root)
    kept = log.where("id % 331 <> 7").withColumn("payload", F.when(F.col("id") % 173 == 5, F.lit("{}")).otherwise(F.col("payload")))
    return audit.breaks(kept, audit.heads(log))


def _receipts_to_confirm(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """A store with the parts whose key is a multiple of 8 as products, and a decision for each line of an order; every seventh order is confirmed already."""
    part = A.read(spark, d, "part").select("p_partkey", F.upper("p_name").alias("p_name"))
    products = part.where("p_partkey % 8 = 0").groupBy(T.catalogue_name(F.col("p_name")).alias("normalized_name")).agg(F.min("p_partkey").alias("k"), F.min_by("p_name", "p_partkey").alias("display_name"))
    text = lambda c: F.lit(None).cast("string").alias(c)
    products = products.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("id"), "display_name", "normalized_name", text("brand"), text("barcode"), text("unit"), text("category_id"))
    aliases = products.where("id like '%4'").select(F.col("id").alias("product_id"), F.col("display_name").alias("original_text"), T.normalise(F.col("display_name")).alias("normalized_text"), text("supplier_id"))
    s = A.suppliers(spark, d).select(F.col("id").cast("string").alias("id"), "name", "aliases")
    o = A.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = F.col("o_orderkey")
    processes = o.select(n.cast("string").alias("id"), text("supplier_id"), (n % 7 == 0).alias("confirmed"))
    supplier = F.when(n % 3 == 0, F.concat(F.lit(" supplier#"), F.lpad((F.col("o_custkey") % 20).cast("string"), 9, "0"))).when(n % 3 == 1, F.concat(F.lit("Bottega "), (F.col("o_custkey") % 9).cast("string"), F.lit(" ")))
    requests = o.select(n.cast("string").alias("process_id"), text("supplier_id"), supplier.alias("supplier_name"))
    li = A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    k = F.col("l_linenumber")
    name = F.concat("p_name", F.when(k % 2 == 0, " ART.").otherwise(""))
    action = F.when(k % 3 == 0, confirmation.LINK).when(k % 3 == 1, confirmation.CREATE).otherwise("skip")
    decisions = li.select(
        F.col("l_orderkey").cast("string").alias("process_id"), k.cast("int").alias("position"), text("line_id"), action.alias("action"),
        F.when(k % 3 == 0, F.concat(F.lit("p"), (F.col("l_partkey") - F.col("l_partkey") % 8).cast("string"))).alias("product_id"), name.alias("description"), text("original_text"), text("category_id"),
        F.col("l_extendedprice").cast(MONEY).alias("line_total"),
    )
    lines = spark.createDataFrame([], f"id string, process_id string, description string, original_text string, line_total {MONEY}, product_id string, review_status string")
    audit_ = spark.createDataFrame([], "entity_id string, action string, lines bigint, products bigint")
    return {"products": products, "aliases": aliases, "suppliers": s, "lines": lines, "processes": processes, "audit": audit_}, requests, decisions


def confirmed_products(spark: SparkSession, d: str) -> DataFrame:
    """All receipts confirmed in a store, twice: each product with its aliases and lines."""
    tables, requests, decisions = _receipts_to_confirm(spark, d)
    root, deleted = A.new_folder(spark, "store"), spark.createDataFrame([], "process_id string, line_id string")
    store.publish(tables, root)
    for _ in range(2):
        confirmation.confirmed(spark, root, requests, decisions, deleted)
    now = versions.snapshot(spark, root)
    # lines that were linked to a product the store lacks count under its id
    a = now.read("aliases").groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n_aliases"))
    n = now.read("lines").where("product_id is not null").groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("n_lines"))
    p = now.read("products").select("id", "display_name", "normalized_name")
    return p.join(a, "id", "full").join(n, "id", "full").select("id", "display_name", "normalized_name", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def confirmed_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of each supplier after confirmation, and whether the supplier is new."""
    tables, requests, decisions = _receipts_to_confirm(spark, d)
    after = confirmation.confirm(tables, requests, decisions, spark.createDataFrame([], "process_id string, line_id string"))
    n = after["processes"].where("supplier_id is not null").groupBy(F.col("supplier_id").alias("id")).agg(F.count("*").alias("n"))
    return after["suppliers"].join(n, "id").select("id", "name", F.col("id").startswith("sup-").alias("is_new"), "n")


def backup_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Write a backup to the shared folder, verify it and read a table back."""
    path = A.new_folder(spark, "backup")
    tables = {n: A.read(spark, d, n) for n in ("region", "nation", "supplier")}
    backup.write(tables, path)
    ok = backup.verify(spark, path).select("table", "rows", "ok")
    back = backup.read(spark, path, "nation", "n_nationkey int, n_name string, n_regionkey int")
    same = back.exceptAll(tables["nation"]).agg(F.lit("nation read back").alias("table"), F.count("*").alias("rows"), (F.count("*") == 0).alias("ok"))
    return ok.unionByName(same)


def exchange_envelopes(spark: SparkSession, d: str) -> DataFrame:
    good = backup.envelope(A.read(spark, d, "region"), "contact-reply", 1)
    odd = spark.range(4).select(F.element_at(F.array(F.lit("no json"), F.lit('{"format":"x","version":1,"payload":{}}'), F.lit('{"format":"contact-reply","version":9,"payload":{}}'), F.lit('{"format":"contact-reply","version":1}')), F.col("id").cast("int") + 1).alias("value"))
    ok, bad = backup.open_envelopes(good.unionByName(odd), "contact-reply", 1, "r_regionkey:int,r_name:string")
    return ok.select(F.col("r_name").alias("what"), F.lit("ok").alias("reason")).unionByName(bad.select(F.lit("").alias("what"), "reason"))


_REPORTS = """r AS (SELECT CAST((id - 1) // 12 AS INT) AS year, CAST((id - 1) % 12 + 1 AS INT) AS month, id % 3 = 0 AS fin FROM (SELECT unnest(range(23970, 23988)) AS id)),
s AS (SELECT *, make_date(year, month, 1) + INTERVAL 1 MONTH <= TIMESTAMP '1998-07-01 00:00:00' AS due FROM r)"""
_DOCS = """d AS (SELECT o_orderkey AS n, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total, o_orderkey % 5 = 0 AS approved, o_orderdate FROM orders),
l AS (SELECT l_orderkey AS n, l_linenumber AS i, CAST(sum(l_extendedprice) AS DECIMAL(18,2)) AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'r' || (l_linenumber % 5) END AS c,
  CASE WHEN l_linenumber % 4 = 0 THEN 'line' || l_linenumber END AS s FROM lineitem GROUP BY 1, 2),
g AS (SELECT d.*, coalesce(s.t, 0) AS line_sum, abs(coalesce(s.t, 0) - total) AS gap, NOT (total > 0 AND coalesce(s.t, 0) > 0 AND abs(coalesce(s.t, 0) - total) > 0.01 AND NOT approved) AS passes
  FROM d LEFT JOIN (SELECT n, sum(t) AS t FROM l GROUP BY n) s USING (n)),
cat AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
stand AS (SELECT id AS stand_in FROM cat ORDER BY name <> 'EUROPE', length(name), id LIMIT 1),
sub AS (SELECT parent, first(id ORDER BY length(name), id) AS child FROM cat WHERE parent IS NOT NULL GROUP BY 1),
fl AS (SELECT n, arg_min(c, i) AS fc, arg_min({'s': s}, i).s AS fs FROM l WHERE c IS NOT NULL GROUP BY n),
y AS (SELECT g.*, CASE WHEN total > 0 THEN total ELSE line_sum END AS amount, CASE WHEN n % 3 = 0 THEN 'r' || (o_custkey % 5) WHEN n % 7 = 0 THEN 'r' || (n % 5) ELSE coalesce(fc, stand_in) END AS category_id,
  CASE WHEN n % 3 <> 0 AND n % 7 = 0 THEN NULL WHEN n % 3 <> 0 AND fc IS NOT NULL THEN fs WHEN n % 4 = 0 THEN 'asked' END AS s
  FROM g LEFT JOIN fl USING (n) CROSS JOIN stand WHERE passes AND n % 9 <> 0 AND n % 100 <> 1),
x AS (SELECT y.*, coalesce(s, child, category_id) AS subcategory_id FROM y LEFT JOIN sub ON parent = category_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        last_write_wins_upsert, patch_versions, set_reconcile, cascade_delete, set_null_delete, delete_unconfirmed, constraint_violations, max3_enforced, first_match, default_settings, segment_reindex, segment_reorder, expense_categories, file_hash_dedup, active_session_by_hash,
        restore_all_tables, audit_chain_breaks, confirmed_products, confirmed_suppliers, document_assembly, close_expired_months, reopen_premature, late_registration_recompute, contact_reconcile, discrepancy_gate, accounting_registration, registered_items, registered_links, closing_state_as_of, audit_by_entity, json_metadata_lookup, backup_checksum, backup_roundtrip, exchange_envelopes,
    )
}

ORACLE_SQL = {
    "last_write_wins_upsert": """WITH a AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 1 AS version FROM customer UNION ALL SELECT o_custkey, 'order ' || o_orderkey, o_totalprice, CAST(o_orderkey + 2 AS INT) FROM orders)
SELECT id, name, balance, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS k FROM a) WHERE k = 1""",
    "patch_versions": "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'new ' || c_name ELSE c_name END AS name, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer",
    "set_reconcile": """WITH w AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 100000 ELSE c_custkey END AS id, c_name AS n, c_acctbal AS b FROM customer WHERE c_custkey % 4 <> 0), v AS (SELECT id, n, CASE WHEN id % 5 = 0 THEN 0.0 ELSE b END AS b FROM w)
SELECT id, CASE WHEN c_name IS NULL THEN 'insert' WHEN n IS NULL THEN 'delete' WHEN c_name = n AND c_acctbal = b THEN 'keep' ELSE 'update' END AS action FROM (SELECT c_custkey AS id, c_name, c_acctbal FROM customer) c FULL JOIN v USING (id)""",
    "cascade_delete": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1",
    "set_null_delete": "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "delete_unconfirmed": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "constraint_violations": "SELECT upper(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "max3_enforced": "SELECT c_custkey, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) WHERE k > 3",
    "first_match": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1",
    "default_settings": """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 THEN 'C' || c_nationkey ELSE 'EUR' END AS currency,
  CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey % 7 ELSE 1 END AS INT) AS first_day FROM customer""",
    "segment_reindex": "SELECT doc_id, source AS session, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS sequence_index FROM documents",
    "expense_categories": """WITH c AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation),
k AS (SELECT id AS stand_in FROM c ORDER BY name <> 'EUROPE', length(name), id LIMIT 1), s AS (SELECT parent, first(id ORDER BY length(name), id) AS child FROM c WHERE parent IS NOT NULL GROUP BY 1),
l AS (SELECT l_orderkey AS n, l_linenumber AS i, 'r' || (l_suppkey % 5) AS c, CASE WHEN l_partkey % 4 = 0 THEN 'line' || l_linenumber END AS s FROM lineitem WHERE l_partkey % 2 = 0),
f AS (SELECT n, c, s FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY i, c, s NULLS FIRST) AS k FROM l) WHERE k = 1),
p AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'r' || (o_custkey % 5) WHEN o_orderkey % 7 = 0 THEN 'r' || (o_orderkey % 5) ELSE coalesce(f.c, stand_in) END AS c,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 <> 0 AND f.c IS NOT NULL THEN f.s WHEN o_orderkey % 4 = 0 THEN 'asked' END AS s FROM orders LEFT JOIN f ON f.n = o_orderkey CROSS JOIN k)
SELECT n AS document_id, c AS category_id, coalesce(p.s, child, c) AS subcategory_id FROM p LEFT JOIN s ON s.parent = p.c""",
    "segment_reorder": "SELECT doc_id, source AS session, CASE WHEN source IS NOT NULL AND doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN doc_id + 7 ELSE CAST(n_chars AS BIGINT) END AS sequence_index FROM documents",
    "file_hash_dedup": "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "active_session_by_hash": "SELECT sha256(text) AS file_hash, max(doc_id) AS session_id, ['draft', 'ready'][CAST(max(doc_id) % 4 AS INT) + 1] AS status FROM documents WHERE doc_id % 4 < 2 GROUP BY 1",
    "document_assembly": "SELECT conv_id, CAST(count(*) AS INT) AS pages, md5(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn, trim(text))) AS text_md5, floor(avg(length(trim(text)) % 101) + 0.5) AS confidence FROM conversations WHERE trim(text) <> '' GROUP BY 1",
    "close_expired_months": f"""WITH {_REPORTS}, t AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS b FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED') GROUP BY 1, 2)
SELECT year, month, CASE WHEN due THEN 'final' ELSE 'provisional' END AS status, due AS closed, CAST(CASE WHEN due AND NOT fin THEN coalesce(a, 0) ELSE 0 END AS DOUBLE) AS total_expenses, CAST(CASE WHEN due AND NOT fin THEN coalesce(b, 0) ELSE 0 END AS DOUBLE) AS paid_expenses FROM s LEFT JOIN t USING (year, month)""",
    "reopen_premature": f"WITH {_REPORTS} SELECT year, month, CASE WHEN due AND fin THEN 'final' ELSE 'provisional' END AS status, due AND fin AS closed, 0.0::DOUBLE AS total_expenses, 0.0::DOUBLE AS paid_expenses FROM s",
    "late_registration_recompute": f"""WITH {_REPORTS}, i AS (SELECT l_orderkey, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS a, min(CAST(l_shipdate AS DATE)) AS day FROM lineitem WHERE l_linenumber = 1 AND l_shipdate >= '1997-06-01' AND l_shipdate < '1998-12-01' AND l_orderkey % 10 <> 0 GROUP BY 1),
m AS (SELECT year(day) AS year, month(day) AS month, sum(a) AS a FROM i GROUP BY 1, 2)
SELECT year, month, CASE WHEN fin THEN 'final' ELSE 'provisional' END AS status, fin AS closed, CAST(CASE WHEN fin AND due THEN coalesce(a, 0) ELSE 0 END AS DOUBLE) AS total_expenses, CAST(CASE WHEN fin AND due THEN coalesce(a, 0) ELSE 0 END AS DOUBLE) AS paid_expenses FROM s LEFT JOIN m USING (year, month)""",
    "contact_reconcile": """WITH r AS (SELECT c_custkey AS id, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'closed' WHEN c_custkey % 7 = 0 THEN 'in_review' ELSE 'new' END AS rs, c_custkey % 11 AS ru, c_custkey % 9 AS lu, c_custkey % 2 = 0 AS has FROM customer WHERE c_custkey % 3 = 0),
o AS (SELECT *, CASE WHEN NOT has THEN 'missing_local_record' WHEN rs = 'new' THEN 'equivalent' WHEN rs = 'closed' THEN 'applied' WHEN id % 4 = 0 AND lu > ru THEN 'conflict' ELSE 'applied' END AS outcome FROM r)
SELECT id, outcome, CASE WHEN outcome = 'applied' THEN rs WHEN has THEN 'new' END AS status, CASE WHEN has AND id % 6 <> 0 THEN c_name END AS linked,
  CASE WHEN outcome IN ('applied', 'equivalent') THEN 'synced' WHEN outcome = 'conflict' THEN 'conflict' END AS sync_status, CASE WHEN outcome = 'applied' THEN ru WHEN has THEN lu END AS updated_at FROM o""",
    "discrepancy_gate": f"WITH {_DOCS} SELECT n AS document_id, CAST(line_sum AS DOUBLE) AS line_sum, CAST(gap AS DOUBLE) AS gap, passes FROM g",
    "accounting_registration": f"""WITH {_DOCS} SELECT 'exp-' || n AS id, n AS document_id, CAST(amount AS DOUBLE) AS amount, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  category_id, subcategory_id FROM x""",
    "registered_items": f"""WITH {_DOCS} SELECT coalesce(c, category_id) AS category_id, CASE WHEN c IS NULL THEN subcategory_id ELSE l.s END AS subcategory_id, count(*) AS n,
  CAST(sum(t) AS DOUBLE) AS total FROM l JOIN x USING (n) GROUP BY 1, 2""",
    "registered_links": f"WITH {_DOCS} SELECT n AS document_id, i AS line_index, 'exp-' || n || '-' || i AS item_id, 'exp-' || n AS expense_id FROM l JOIN x USING (n)",
    "closing_state_as_of": """WITH f AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS ym, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INT) AS t FROM orders),
m AS (SELECT DISTINCT ym, make_date(ym // 12, ym % 12 + 1, 1) + INTERVAL 1 MONTH AS e FROM f),
h AS (SELECT ym, e AS t, 'final' AS status FROM m UNION ALL SELECT ym, e + INTERVAL 20 DAY, 'provisional' FROM m WHERE ym % 5 = 0 UNION ALL SELECT ym, e + INTERVAL 30 DAY, 'final' FROM m WHERE ym % 5 = 0),
j AS (SELECT f.ym, h.status, h.t AS since FROM f LEFT JOIN LATERAL (SELECT status, t FROM h WHERE h.ym = f.ym AND h.t <= f.t ORDER BY t DESC LIMIT 1) h ON TRUE)
SELECT CAST(ym AS INT) AS ym, coalesce(status, 'provisional') AS month_status, CAST(since AS DATE) AS month_since, coalesce(status, 'provisional') = 'final' AS late, count(*) AS n FROM j GROUP BY ALL""",
    "audit_by_entity": "SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE user_id = 7 AND event_type = 'error'",
    "json_metadata_lookup": "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "backup_checksum": """WITH t AS (SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation UNION ALL SELECT '{"n_nationkey":' || r_regionkey || ',"n_name":"' || r_name || '","n_regionkey":null}' FROM region),
h AS (SELECT value, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(value, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda s, c: ((s * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS n FROM t)
SELECT value, lower(to_hex(abs(n))) AS checksum FROM h""",
    "exchange_envelopes": "SELECT r_name AS what, 'ok' AS reason FROM region UNION ALL SELECT '', unnest(['not an envelope', 'other format', 'newer version', 'no payload'])",
    "confirmed_products": f"""WITH np AS (SELECT p_partkey AS k, upper(p_name) AS t, {_NORM.format('p_name')} AS norm FROM part),
e AS (SELECT 'p' || min(k) AS id, arg_min(t, k) AS display_name, norm AS name FROM np WHERE k % 8 = 0 GROUP BY norm),
d AS (SELECT CAST(l_orderkey AS VARCHAR) AS p, l_linenumber AS pos, t || CASE WHEN l_linenumber % 2 = 0 THEN ' ART.' ELSE '' END AS raw, norm AS name, norm || CASE WHEN l_linenumber % 2 = 0 THEN ' ART' ELSE '' END AS norm,
  l_linenumber % 3 AS a, l_partkey - l_partkey % 8 AS link FROM lineitem JOIN np ON k = l_partkey WHERE l_orderkey % 7 <> 0),
f AS (SELECT d.*, CASE a WHEN 0 THEN 'p' || link WHEN 1 THEN coalesce(e.id, 'prod-' || substr(sha256(d.name), 1, 16)) END AS final FROM d LEFT JOIN e ON e.name = d.name),
c AS (SELECT final AS id, arg_min(raw, {{'p': p, 'pos': pos}}) AS display_name, name FROM f WHERE a = 1 AND final LIKE 'prod-%' GROUP BY final, name),
ps AS (SELECT * FROM e UNION ALL SELECT * FROM c),
al AS (SELECT id, name AS norm FROM e WHERE id LIKE '%4' UNION SELECT final, norm FROM f WHERE final IS NOT NULL),
an AS (SELECT id, count(*) AS n_aliases FROM al GROUP BY 1), ln AS (SELECT final AS id, count(*) AS n_lines FROM f WHERE final IS NOT NULL GROUP BY 1)
SELECT id, display_name, name AS normalized_name, coalesce(n_aliases, 0) AS n_aliases, coalesce(n_lines, 0) AS n_lines FROM ps FULL JOIN an USING (id) FULL JOIN ln USING (id)""",
    "confirmed_suppliers": """WITH r AS (SELECT o_orderkey AS o, CASE o_orderkey % 3 WHEN 0 THEN 'Supplier#' || lpad(CAST(o_custkey % 20 AS VARCHAR), 9, '0') WHEN 1 THEN 'Bottega ' || o_custkey % 9 END AS name
  FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 2),
m AS (SELECT CASE WHEN s_suppkey IS NULL THEN 'sup-' || substr(sha256(lower(name)), 1, 16) ELSE CAST(s_suppkey AS VARCHAR) END AS id, coalesce(s_name, CASE WHEN name LIKE 'Supp%' THEN lower(name) ELSE name END) AS name,
  s_suppkey IS NULL AS is_new FROM r LEFT JOIN supplier ON lower(s_name) = lower(name))
SELECT id, name, is_new, count(*) AS n FROM m GROUP BY ALL""",
    "restore_all_tables": "\nUNION ALL ".join(f"SELECT '{t}' AS \"table\", 2 AS version, count(*) AS rows, CAST(sum({k}) AS BIGINT) AS keys FROM {t}" for t, k in TABLES.items()),
    "audit_chain_breaks": """WITH n AS (SELECT event_id AS id, 'user-' || user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS seq,
  count(*) OVER (PARTITION BY user_id) AS last, event_id % 331 = 7 AS gone, event_id % 173 = 5 AND props <> '{}' AS wrong FROM events),
k AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY entity ORDER BY seq), 0) AS before FROM n WHERE NOT gone),
b AS (SELECT entity, seq, CASE WHEN seq > before + 1 THEN 'missing' WHEN wrong THEN 'rewritten' END AS reason FROM k
  UNION ALL SELECT entity, last, CASE WHEN coalesce(max(CASE WHEN NOT gone THEN seq END), 0) < last THEN 'cut' END FROM n GROUP BY entity, last)
SELECT entity, min(seq) AS seq, arg_min(reason, seq) AS reason FROM b WHERE reason IS NOT NULL GROUP BY entity""",
    "backup_roundtrip": "SELECT 'region' AS table, count(*) AS rows, TRUE AS ok FROM region UNION ALL SELECT 'nation', count(*), TRUE FROM nation UNION ALL SELECT 'supplier', count(*), TRUE FROM supplier UNION ALL SELECT 'nation read back', 0, TRUE",
}
