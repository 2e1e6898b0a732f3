"""Registered queries: list screens, capture sessions, review drafts, report snapshots, provisions, licences and form checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import calendar as C
from tallyforge.functions import forms
from tallyforge.functions import text as T
from tallyforge.functions.money import money, share, total
from tallyforge.operators import drafts, licence, lists, receipts, reports
from tallyforge.plans.receipt_plans import _ITEMS, _NORM, rendered
from tallyforge.sources import adapters as A

NOW = "1998-07-01"
SESSION = ["draft", "ready", "processing", "completed", "ready_for_review", "reviewed", "failed", "cancelled"]


def _of(index: Column, words: list) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(index, F.lit(len(words))).cast("int") + 1)


def _orders(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    return A.read(spark, d, "orders"), F.col("o_orderkey")


def expenses_page(spark: SparkSession, d: str) -> DataFrame:
    rows = A.expenses(spark, d).where(lists.chosen("classification", "necessary")).select("id", "expense_date", "amount")
    return lists.page(rows, F.desc("expense_date"), F.asc("id"))


def incomes_page(spark: SparkSession, d: str) -> DataFrame:
    rows = A.incomes(spark, d).where(lists.chosen("contributor_id", 1)).groupBy("order_id", "income_date").agg(total("amount").alias("amount"))
    return lists.page(rows, F.desc("income_date"), F.asc("order_id"))


def category_menu(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = A.read(spark, d, "nation").select(n.alias("id"), F.col("n_regionkey").alias("parent_id"), F.when(n % 4 != 0, n * 7 % 11).cast("int").alias("sort_order"))
    return lists.in_menu_order(rows).select("id", "parent_id", "place")


def notifications_page(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return lists.page(o.select(n.alias("id"), F.to_date("o_orderdate").alias("created_at"), (n % 3 == 0).alias("is_read")), F.desc("created_at"), F.asc("id"))


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return o.select(n.alias("id"), _of(n, SESSION).alias("status"), F.to_date("o_orderdate").alias("updated_at"))


def draft_sessions_page(spark: SparkSession, d: str) -> DataFrame:
    return lists.page(_sessions(spark, d).where("status = 'draft'").drop("status"), F.desc("updated_at"), F.asc("id"))


def pending_review_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).where(F.col("status").isin(*lists.PENDING_REVIEW)).groupBy(C.index_of(F.col("updated_at")).alias("ym"), "status").agg(F.count("*").alias("n"))


def suppliers_by_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.lower("s_name")).when(k % 3 == 1, F.replace("s_name", F.lit("u"), F.lit("ù"))).otherwise(F.col("s_name"))
    return lists.page(A.read(spark, d, "supplier").select(k.alias("id"), name.alias("name")), lists.by_name("name"), F.asc("id"))


def nonzero_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories with paid expenses in one month; all others have a total of 0 and are not shown."""
    spent = A.with_category(spark, d, A.expenses(spark, d).where("ym = 1995 * 12 + 3 and status = 'paid'")).groupBy(F.col("category_id").alias("id")).agg(total("amount").alias("amount"))
    return A.categories(spark, d).where("level = 2").join(spent, "id", "left").select("id", "name", money("amount").alias("amount")).where("amount > 0")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    t = A.read(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence_index"), F.when(F.length("text") % 5 != 0, F.col("conv_id") * 100 + F.col("turn")).cast("long").alias("attachment_id"))


def session_page_counts(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return lists.page_counts(o.select(n.alias("session_id")), _segments(spark, d))


def session_thumbnails(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d)
    stored = s.where("attachment_id is not null").select("attachment_id", F.when(F.col("attachment_id") % 3 != 0, F.concat(F.lit("key-"), F.col("attachment_id").cast("string"))).alias("storage_key")).distinct()
    return lists.thumbnails(s.select("session_id").distinct(), s, stored)


def attachment_owners(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem")
    attached = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("attachment_id"), F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("expense_id"))
    o, n = _orders(spark, d)
    booked = o.select(n.alias("expense_id"), F.concat(F.lit("Spesa "), n.cast("string")).alias("description"), (F.col("o_custkey") % 150).alias("supplier_id"))
    return lists.attachment_owners(attached, booked, A.suppliers(spark, d))


def capture_session_states(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem")
    log = li.select(F.col("l_orderkey").alias("session_id"), F.to_date("l_shipdate").alias("at"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("step"), _of(F.col("l_partkey"), SESSION).alias("status"))
    return lists.current_status(log)


def contact_conflicts(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return o.select(n.alias("id"), _of(n, list(lists.SYNC)).alias("sync_status")).where(lists.chosen("sync_status", "conflict"))


def contributor_slot_reuse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey")
    people = A.read(spark, d, "supplier").select(F.when(n % 2 == 0, F.concat(F.lit("contrib-"), n.cast("string"))).otherwise(F.concat(F.lit("s"), n.cast("string"))).alias("id"), (n + 1).cast("int").alias("order"), (n % 5 == 0).alias("unused"))
    return lists.reused_slots(spark.range(1, 4).select(F.col("id").cast("int").alias("order")), people)


def seed_twice(spark: SparkSession, d: str) -> DataFrame:
    rows = A.categories(spark, d)
    once = rows.where("id <> 'r2'")
    once = once.unionByName(lists.seed(once, rows, "id"))
    return once.unionByName(lists.seed(once, rows, "id"))


def inserted_expenses(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return lists.stamped(o.select(n.alias("expense_id")), ["expense_id"], NOW).select("id", "expense_id", F.to_date("created_at").alias("created_on"), "version")


def review_line_projection(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    key = n.cast("string")
    meta = F.when(n % 10 == 0, F.create_map(F.lit("categoryId"), F.lit(None).cast("string"), F.lit("actionMode"), F.lit("create_new"))).when(n % 10 == 1, F.create_map(F.lit("categoryId"), F.lit("c9"), F.lit("newProductDisplayName"), F.lit("NUOVO")))
    lines = o.select(
        key.alias("line_id"), F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("RIGA "), key)).alias("original_text"), F.when(n % 5 != 0, F.concat(F.lit("D"), key)).alias("description"), (n % 4).cast("double").alias("quantity"), (n % 6 / 2).alias("unit_price"),
        F.col("o_totalprice").alias("line_total"), F.when(n % 6 == 0, "p1").alias("product_id"), meta.alias("metadata"),
    )
    found = o.where("o_orderkey % 3 = 0").select(key.alias("line_id"), F.lit("cx").alias("proposed_category"), F.when(n % 9 == 0, F.concat(F.lit("q"), key)).alias("proposed_product"), F.when(n % 9 == 3, F.concat(F.lit("N"), key)).alias("proposed_new_name"), F.lit("possible").alias("level"))
    return drafts.review_lines(lines, found)


def review_draft_saved(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    key, process = n.cast("string"), F.col("o_custkey")
    meta = F.create_map(F.lit("origin"), F.lit("scan"), F.lit("categoryId"), F.lit("old"))
    stored = o.select(process.alias("process_id"), key.alias("line_id"), F.lit("S").alias("description"), F.col("o_totalprice").alias("line_total"), F.lit("pending").alias("status"), meta.alias("metadata"), (n % 2 == 0).alias("confirmed"))
    form = lambda line_id: [process.alias("process_id"), line_id.alias("line_id"), F.concat(F.lit("E"), key).alias("description"), (F.col("o_totalprice") + 1).alias("line_total"), F.lit("reviewed").alias("status"), F.concat(F.lit("c"), (n % 4).cast("string")).alias("category_id"), F.lit(None).cast("string").alias("subcategory_id"), F.lit("unlinked").alias("action_mode"), F.lit(None).cast("string").alias("new_product_name")]
    open_now = o.where("o_custkey % 2 = 0")
    edited = open_now.where("o_orderkey % 5 <> 0").select(*form(key)).unionByName(open_now.where("o_orderkey % 7 = 0").select(*form(F.concat(F.lit(drafts.UNSAVED), key))))
    out = drafts.save_draft(stored, edited, open_now.select(process.alias("process_id")))
    return out.select("process_id", "line_id", "description", "line_total", "status", "confirmed", F.try_element_at("metadata", F.lit("origin")).alias("origin"), F.try_element_at("metadata", F.lit("categoryId")).alias("category_id"))


def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return drafts.decisions(o.select(n.alias("line_id"), _of(n, ["", "CREATE_NEW", "p7"]).alias("product_id"), F.when(n % 4 != 0, _of(n, ["create_new", "unlinked", "", "link_existing"])).alias("action_mode"), F.when(n % 5 != 0, "NUOVO").alias("new_product_name"), F.lit("RIGA").alias("description")))


def decided_categories(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    lines = o.select(n.cast("string").alias("line_id"), F.concat(F.lit("T"), (n % 50).cast("string")).alias("original_text"), F.when(n % 2 == 0, "own").alias("category_id"))
    by_id = o.where("o_orderkey % 6 = 0").select(n.cast("string").alias("key"), F.when(n % 4 == 0, "").otherwise("by-id").alias("category_id"), n.alias("at"))
    by_text = o.where("o_orderkey % 50 < 9").select(F.concat(F.lit("T"), (n % 50).cast("string")).alias("key"), F.concat(F.lit("t"), n.cast("string")).alias("category_id"), n.alias("at"))
    return drafts.decided_categories(lines, by_id.unionByName(by_text), F.lit("main"))


def product_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part")
    k = F.col("p_partkey")
    products = p.select(k.alias("product_id"), F.col("p_name").alias("display_name"), T.normalise(F.col("p_name")).alias("normalized_name"))
    text = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    aliases = p.where("p_partkey % 3 <> 0").select((k - k % 4).alias("product_id"), text.alias("original_text"), T.normalise(text).alias("normalized_text"))
    prices = A.read(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("price"))
    return drafts.product_profiles(products, aliases, prices).drop("texts")


def report_snapshots(spark: SparkSession, d: str) -> DataFrame:
    three = A.projects(spark, d).where("status = 'active'").orderBy("id").limit(3)  # a household has three slots
    plans = three.select("id", "target_amount", "saved_amount", share(F.col("saved_amount"), F.col("target_amount"), 0).alias("progress"))
    out = reports.snapshots(A.incomes(spark, d), A.expenses(spark, d), spark.range(1, 4), plans)
    text = lambda column, *fields: F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), "|")
    return out.select("ym", text("contributors", "contributor_id", "amount", "percentage").alias("contributors"), "classes.necessary", "classes.voluntary", "classes.to_evaluate", text("projects", "id", "target_amount", "saved_amount", "progress").alias("projects"))


def _months(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "orders").select(C.index_of(F.col("o_orderdate")).alias("ym")).distinct()


def closing_notes(spark: SparkSession, d: str) -> DataFrame:
    ym = F.col("ym")
    main, second = reports.closing_note(ym, ym % 5 != 0, F.when(ym % 7 == 0, "provisional").when(ym % 3 == 0, "final"), "1997-03-15")
    return _months(spark, d).select("ym", main.alias("main"), second.alias("second"))


def report_titles(spark: SparkSession, d: str) -> DataFrame:
    ym = F.col("ym")
    kind = _of(ym, ["current_month", "last_three_months", "current_year", "choose_period", "last_six_months"])
    january = C.year_of(ym) * 12 + 1
    df = _months(spark, d).withColumn("kind", kind)
    df = df.withColumn("e", F.when(F.col("kind") == "current_year", january + 11).when((F.col("kind") == "choose_period") & (ym % 2 == 0), None).otherwise(ym))
    df = df.withColumn("s", F.when(F.col("kind") == "current_year", january).when(F.col("kind") == "last_three_months", ym - 2).when(F.col("kind") == "last_six_months", ym - 5).otherwise(F.col("e")))
    k, s, e = F.col("kind"), F.col("s"), F.col("e")
    return df.select("ym", reports.title(k, s, e).alias("title"), reports.subtitle(k, s, e).alias("subtitle"), reports.print_period(s, e).alias("printed"))


def provision_bookings(spark: SparkSession, d: str) -> DataFrame:
    f = A.fixed_expenses(spark, d)
    rows = f.select("id", F.when(F.col("id") % 2 == 0, "project").otherwise("fixed").alias("kind"), F.col("name").alias("description"), F.col("expected_amount").alias("amount"), C.due_date(F.col("start_ym"), F.col("due_day")).alias("expense_date"), F.when(F.col("id") % 3 == 0, "paid").otherwise("planned").alias("status"))
    return reports.provision_expenses(rows).select("id", "entry_mode", "amount", "payment_date", "competence_month", "competence_year")


def project_purchases(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    top = A.read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.when(F.col("r_regionkey") == 3, "CAT_PROJECTS").alias("code"), F.col("r_regionkey").cast("int").alias("sort_order"))
    k = F.col("n_nationkey")
    sub = A.read(spark, d, "nation").select(F.concat(F.lit("n"), k).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.lit(None).cast("string").alias("code"), (k * 7 % 11).cast("int").alias("sort_order"))
    bought = o.select(n.alias("project_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderpriority").alias("description"), F.to_date("o_orderdate").alias("expense_date"))
    return reports.project_purchases(bought, top.unionByName(sub)).select("project_id", "description", "entry_mode", "amount", "payment_date", "category_id", "subcategory_id")


def monthly_equivalents(spark: SparkSession, d: str) -> DataFrame:
    return A.fixed_expenses(spark, d).select("id", reports.monthly_equivalent(F.col("expected_amount"), F.col("frequency")).alias("equivalent"))


def reserve_guard(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return o.groupBy(_of(n, ["project", "voluntary", "deficit"]).alias("kind")).agg(F.count_if(reports.reserve_may_fund(_of(n, ["project", "voluntary", "deficit"]))).alias("funded"))


def upcoming_totals(spark: SparkSession, d: str) -> DataFrame:
    due = A.expenses(spark, d).where("status not in ('paid', 'cancelled')").agg(total("amount").alias("upcoming"))
    plans = A.saving_plans(spark, d).where("status = 'active'").agg(total("monthly_quota").alias("plans"))
    return due.crossJoin(plans).crossJoin(A.projects(spark, d).where("status = 'active'").agg(total("monthly_quota").alias("projects")))


def _moment(days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) + (days * 86_400_000_000).cast("long"))


def licence_validity(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    rows = o.select(
        n.alias("id"), F.when(n % 11 != 0, "L").alias("licence_id"), _of(n, ["beta_60_days", "annual", "lifetime_perpetual"]).alias("licence_type"), _of(n, ["active", "suspended", "active", "invalid", "beta_expired", "active", "not_activated"]).alias("status"),
        F.when(n % 5 != 0, _moment(n % 21 / 2 - 4)).alias("expires_at"), (n % 30).cast("int").alias("remaining_days"),
    )
    return licence.validity(rows, NOW)


def licence_windows(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    soon, over = licence.window_flags(F.when(n % 9 != 0, _moment(n % 33 / 2 - 4)), n % 4 != 0, NOW)
    return o.select(n.alias("id"), soon.alias("soon"), over.alias("over"))


def licence_offline_states(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    rows = o.select(
        n.alias("id"), _of(n, ["active", "Suspended", "", "invalid_product", "active", "license_expired", "active"]).alias("server_status"), (n % 6 != 0).alias("signature_ok"), F.when(n % 5 != 0, _moment(n % 40 - 6)).alias("window_until"), F.when(n % 3 != 0, _moment(n % 40 - 3)).alias("expires_at"),
        F.when(n % 8 != 0, _moment(n % 17 - 15)).alias("last_online"), _moment(n % 13 - 12).alias("validated_at"),
    )
    return licence.offline_state(rows, NOW).select("id", "state", F.to_date("effective_until").alias("until"))


def clock_rollbacks(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return licence.rollbacks(o.select(F.col("o_custkey").alias("device"), n.alias("seq"), F.to_date("o_orderdate").alias("at")))


def contributor_form_errors(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    fault = forms.contributor_error(_of(n, ["  Anna   Maria ", "R2", " ", "Élodie", None]), _of(n, ["", "a@b.it", "a b@c.it", "x@y"]))
    return o.groupBy(fault.alias("fault"), forms.postal_code_error(_of(n, ["20100", "2010", "", "2010A", " 00100 "])).alias("postal_fault")).agg(F.count("*").alias("n"))


def goal_entries(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    entry = F.concat(_of(n, ["", "1", "0", "abc", "-5", "1.2"]), F.when(n % 6 == 1, F.concat(_of(n, [",", "."]), (n % 500).cast("string"))).otherwise(""))
    return o.select(n.alias("id"), forms.goal_error(entry).alias("fault"), forms.goal_value(entry).alias("value"))


def fixed_expense_form_errors(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    rows = o.select(F.when(n % 7 == 0, " ").otherwise("Affitto").alias("name"), F.when(n % 11 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("amount"), F.when(n % 13 != 0, (n % 6).cast("double") - 1).alias("duration"), F.when(n % 5 != 0, (n % 31).cast("double")).alias("day"), F.when(n % 3 != 0, "cat").alias("category"))
    ok, bad = forms.rejected(rows, forms.fixed_expense_error(*[F.col(c) for c in ("name", "amount", "duration", "day")], F.lit(1999 * 12 + 2), F.col("category")))
    return bad.groupBy("fault").agg(F.count("*").alias("n")).unionByName(ok.agg(F.lit("none").alias("fault"), F.count("*").alias("n")))


def contact_request_checks(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    rows = o.select(F.when(n % 9 == 0, " ").otherwise(n.cast("string")).alias("id"), _of(n, ["pending", "", "synced", None]).alias("sync_status"), F.when(n % 2 == 0, F.lit("1998-01-01").cast("timestamp")).alias("updated_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (n % 8 == 0).alias("known"), _of(n, ["{}", "[]", None, ' {"a": 1}', "null"]).alias("metadata"))
    good, _ = forms.rejected(rows, forms.request_error(F.col("id"), F.col("known"), F.col("metadata")))
    return good.withColumns(forms.request_update("1996-06-01")).select("id", "sync_status", F.to_date("updated_at").alias("updated_on"), "schema_version")


def competence_months(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(n % 5 == 0, F.concat(day, F.lit("T10:00:00"))).when(n % 5 == 1, "").when(n % 5 == 2, F.concat(F.year("o_orderdate").cast("string"), F.lit("-13-01"))).when(n % 5 == 3, F.lit(None)).otherwise(F.substring(day, 1, 7))
    return o.select(n.alias("id"), forms.competence(text, NOW).alias("ym"))


def file_sizes(spark: SparkSession, d: str) -> DataFrame:
    o, n = _orders(spark, d)
    return o.select(n.alias("id"), forms.file_size(F.when(n % 4 != 0, n * n % 5 * 512 + n % 3 * 4194304)).alias("size"))


def supplier_alternatives(spark: SparkSession, d: str) -> DataFrame:
    df = receipts.fields(rendered(spark, d), ["supplier"], key=["order_id"]).select("order_id", F.col("supplier.alternatives").alias("a"))
    return df.select("order_id", F.size("a").alias("n"), F.get("a", 0).alias("second"), F.get("a", 1).alias("third"))


def recognised_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages read by an injected recognizer, here one that takes the bytes as text."""
    pages = A.read(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("content"))
    read = receipts.recognised(pages, lambda c: F.struct(c.cast("string").alias("text"), (F.length(c) % 101).alias("confidence")))
    return read.select("conv_id", "turn", F.md5("text").alias("text_md5"), "read_confidence")


def receipt_duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    return receipts.fields(rendered(spark, d), ["items"], key=["order_id"]).where(receipts.repeated(F.col("items"))).select("order_id")


_MONTH = "list_extract(['Gennaio', 'Febbraio', 'Marzo', 'Aprile', 'Maggio', 'Giugno', 'Luglio', 'Agosto', 'Settembre', 'Ottobre', 'Novembre', 'Dicembre'], CAST(({0} - 1) % 12 AS INT) + 1)"
_YEAR = "CAST(({0} - 1) // 12 AS VARCHAR)"
_FIRST = "make_date(CAST(({0} - 1) // 12 AS INT), CAST(({0} - 1) % 12 AS INT) + 1, 1)"
_LAST = "CAST(day(last_day(" + _FIRST + ")) AS VARCHAR)"


def _pick(words: str, index: str = "o_orderkey") -> str:
    return f"list_extract([{words}], CAST({index} % {words.count(',') + 1} AS INT) + 1)"


def _after(days: str) -> str:
    return f"(TIMESTAMP '{NOW} 00:00:00' + to_microseconds(CAST(({days}) * 86400000000 AS BIGINT)))"


_M = "m AS (SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS ym FROM orders)"
_STATUS = _pick("'draft', 'ready', 'processing', 'completed', 'ready_for_review', 'reviewed', 'failed', 'cancelled'")
_SEG = "sg AS (SELECT conv_id, turn, CASE WHEN length(text) % 5 <> 0 THEN conv_id * 100 + turn END AS a FROM conversations)"
_T = f"TIMESTAMP '{NOW} 00:00:00'"
_LEFT = "(n % 21 / 2.0 - 4)"

QUERIES = {
    f.__name__: f
    for f in (
        expenses_page, incomes_page, category_menu, notifications_page, draft_sessions_page, pending_review_sessions, suppliers_by_name, nonzero_categories, session_page_counts, session_thumbnails, attachment_owners, capture_session_states, contact_conflicts,
        contributor_slot_reuse, seed_twice, inserted_expenses, review_line_projection, review_draft_saved, review_decisions, decided_categories, product_profiles, report_snapshots, closing_notes, report_titles, provision_bookings, project_purchases, monthly_equivalents,
        reserve_guard, upcoming_totals, licence_validity, licence_windows, licence_offline_states, clock_rollbacks, contributor_form_errors, goal_entries, fixed_expense_form_errors, contact_request_checks, competence_months, file_sizes, supplier_alternatives,
        receipt_duplicate_lines, recognised_pages,
    )
}

ORACLE_SQL = {
    "expenses_page": A.sql("expenses", "SELECT id, expense_date, amount, CAST(row_number() OVER (ORDER BY expense_date DESC, id) AS INT) AS place FROM expenses WHERE classification = 'necessary' ORDER BY place LIMIT 50"),
    "incomes_page": A.sql("incomes", "SELECT order_id, income_date, sum(amount) AS amount, CAST(row_number() OVER (ORDER BY income_date DESC, order_id) AS INT) AS place FROM incomes WHERE contributor_id = 1 GROUP BY 1, 2 ORDER BY place LIMIT 50"),
    "category_menu": "SELECT n_nationkey AS id, n_regionkey AS parent_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 7 % 11 ELSE 0 END, n_nationkey) AS INT) AS place FROM nation",
    "notifications_page": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS created_at, o_orderkey % 3 = 0 AS is_read, CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS INT) AS place FROM orders ORDER BY place LIMIT 50",
    "draft_sessions_page": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS updated_at, CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS INT) AS place FROM orders WHERE o_orderkey % 8 = 0 ORDER BY place LIMIT 50",
    "pending_review_sessions": f"SELECT year(o_orderdate) * 12 + month(o_orderdate) AS ym, {_STATUS} AS status, count(*) AS n FROM orders WHERE o_orderkey % 8 IN (1, 4) GROUP BY 1, 2",
    "suppliers_by_name": """WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN lower(s_name) WHEN 1 THEN replace(s_name, 'u', 'ù') ELSE s_name END AS name FROM supplier)
SELECT *, CAST(row_number() OVER (ORDER BY strip_accents(lower(name)), id) AS INT) AS place FROM s ORDER BY place LIMIT 50""",
    "nonzero_categories": A.sql("expenses categories category_of", "SELECT c.id, c.name, sum(e.amount) AS amount FROM expenses e JOIN category_of o ON o.customer_id = e.customer_id JOIN categories c ON c.id = o.category_id WHERE e.ym = 1995 * 12 + 3 AND e.status = 'paid' GROUP BY 1, 2 HAVING sum(e.amount) > 0"),
    "session_page_counts": "SELECT o_orderkey AS session_id, coalesce(n, 0) AS page_count FROM orders LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) ON conv_id = o_orderkey",
    "session_thumbnails": f"WITH {_SEG}, f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, a NULLS FIRST) AS k FROM sg) SELECT conv_id AS session_id, 'key-' || a AS storage_key FROM f WHERE k = 1 AND a % 3 <> 0",
    "attachment_owners": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS attachment_id, CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS expense_id, CASE WHEN o_orderkey IS NULL THEN '' ELSE 'Spesa ' || o_orderkey END AS description, coalesce(s_name, '') AS supplier_name
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber <> 7 LEFT JOIN supplier ON s_suppkey = o_custkey % 150""",
    "capture_session_states": f"""WITH e AS (SELECT l_orderkey AS session_id, CAST(l_shipdate AS DATE) AS t, l_partkey * 10 + l_linenumber AS step, {_STATUS.replace('o_orderkey', 'l_partkey')} AS status FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t DESC, step DESC) AS k, count(*) OVER (PARTITION BY session_id) AS events FROM e) SELECT session_id, status, events, t AS updated_at, status IN ('ready', 'ready_for_review') AS pending_review FROM r WHERE k = 1""",
    "contact_conflicts": "SELECT o_orderkey AS id, 'conflict' AS sync_status FROM orders WHERE o_orderkey % 3 = 2",
    "contributor_slot_reuse": """WITH p AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'contrib-' || s_suppkey ELSE 's' || s_suppkey END AS id, s_suppkey + 1 AS o, s_suppkey % 5 = 0 AS unused FROM supplier), s(o) AS (VALUES (1), (2), (3))
SELECT CAST(s.o AS INT) AS order, min(p.id) AS id FROM s JOIN p ON p.o = s.o OR p.id = 'contrib-' || s.o OR p.unused GROUP BY 1""",
    "seed_twice": A.sql("categories", "SELECT * FROM categories"),
    "inserted_expenses": f"""SELECT sha256('{{"expense_id":' || o_orderkey || '}}') AS id, o_orderkey AS expense_id, DATE '{NOW}' AS created_on, 1 AS version FROM orders""",
    "review_line_projection": """WITH l AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'RIGA ' || o_orderkey END AS ot, CASE WHEN o_orderkey % 5 <> 0 THEN 'D' || o_orderkey END AS ds, o_totalprice FROM orders), p AS (SELECT *, CASE WHEN n % 6 = 0 THEN 'p1' WHEN n % 9 = 0 THEN 'q' || n END AS pr FROM l)
SELECT CAST(n AS VARCHAR) AS line_id, coalesce(nullif(ot, ''), ds) AS original_text, coalesce(ds, ot) AS description, CASE WHEN n % 4 = 0 THEN 1.0::DOUBLE ELSE n % 4 END AS quantity, n % 6 / 2.0::DOUBLE AS unit_price, o_totalprice AS line_total, pr AS product_id, CASE WHEN n % 10 = 0 THEN NULL WHEN n % 10 = 1 THEN 'c9' WHEN n % 3 = 0 THEN 'cx' END AS category_id,
  CASE WHEN n % 3 = 0 THEN 'possible' WHEN pr IS NOT NULL THEN 'exact' ELSE 'new_product' END AS level, CASE WHEN n % 10 = 0 THEN 'create_new' WHEN pr IS NOT NULL THEN 'link_existing' WHEN n % 9 = 3 THEN 'create_new' ELSE 'unlinked' END AS action_mode,
  CASE WHEN n % 10 = 1 THEN 'NUOVO' WHEN n % 9 = 3 THEN 'N' || n ELSE coalesce(ds, ot) END AS new_product_name FROM p""",
    "review_draft_saved": """SELECT o_custkey AS process_id, CAST(o_orderkey AS VARCHAR) AS line_id, CASE WHEN o_custkey % 2 = 0 THEN 'E' || o_orderkey ELSE 'S' END AS description, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS line_total, CASE WHEN o_custkey % 2 = 0 THEN 'reviewed' ELSE 'pending' END AS status,
  o_custkey % 2 <> 0 AND o_orderkey % 2 = 0 AS confirmed, 'scan' AS origin, CASE WHEN o_custkey % 2 = 0 THEN 'c' || (o_orderkey % 4) ELSE 'old' END AS category_id FROM orders WHERE o_custkey % 2 <> 0 OR o_orderkey % 5 <> 0
UNION ALL SELECT o_custkey, 'temp-line-' || o_orderkey, 'E' || o_orderkey, o_totalprice + 1, 'modified', FALSE, NULL, 'c' || (o_orderkey % 4) FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 7 = 0""",
    "review_decisions": """WITH l AS (SELECT o_orderkey AS n, CASE o_orderkey % 4 WHEN 1 THEN 'unlinked' WHEN 3 THEN 'link_existing' WHEN 2 THEN '' END AS a FROM orders),
d AS (SELECT n, CASE n % 3 WHEN 2 THEN 'link_existing' WHEN 1 THEN 'create_new' ELSE coalesce(nullif(a, ''), 'unlinked') END AS action FROM l)
SELECT n AS line_id, action, CASE WHEN action = 'link_existing' AND n % 3 = 2 THEN 'p7' END AS product_id, CASE WHEN action = 'create_new' THEN CASE WHEN n % 5 <> 0 THEN 'NUOVO' ELSE 'RIGA' END END AS new_name FROM d""",
    "decided_categories": """WITH t AS (SELECT o_orderkey % 50 AS k, 't' || max(o_orderkey) AS c FROM orders WHERE o_orderkey % 50 < 9 GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS line_id, coalesce(CASE WHEN o_orderkey % 6 = 0 THEN CASE WHEN o_orderkey % 4 <> 0 THEN 'by-id' END ELSE c END, CASE WHEN o_orderkey % 2 = 0 THEN 'own' END, 'main') AS category_id FROM orders LEFT JOIN t ON k = o_orderkey % 50""",
    "product_profiles": f"""WITH a AS (SELECT product_id, list_sort(list(DISTINCT {{'o': t, 'n': {_NORM.format('t')}}})) AS al FROM (SELECT p_partkey - p_partkey % 4 AS product_id, p_name || ' ' || p_size AS t FROM part WHERE p_partkey % 3 <> 0) GROUP BY 1),
p AS (SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1)
SELECT p_partkey AS product_id, array_to_string(list_concat([p_name, {_NORM.format('p_name')}], list_transform(coalesce(al, []), lambda x: x.o), list_transform(coalesce(al, []), lambda x: x.n)), ' ') AS full_text, CAST(coalesce(len(al), 0) AS INT) AS n_aliases, avg_price, min_price, max_price
FROM part LEFT JOIN a ON a.product_id = p_partkey LEFT JOIN p ON l_partkey = p_partkey""",
    "report_snapshots": A.sql("incomes expenses projects", """, g AS (SELECT ym, contributor_id, sum(amount) AS a FROM incomes WHERE status = 'received' GROUP BY 1, 2), w AS (SELECT ym, sum(a) AS w FROM g GROUP BY 1),
x AS (SELECT ym, coalesce(sum(amount) FILTER (WHERE classification = 'necessary'), 0) AS necessary, coalesce(sum(amount) FILTER (WHERE classification = 'voluntary'), 0) AS voluntary, coalesce(sum(amount) FILTER (WHERE classification = 'toEvaluate'), 0) AS to_evaluate FROM expenses WHERE status <> 'cancelled' GROUP BY 1),
m AS (SELECT coalesce(x.ym, w.ym) AS ym, w, necessary, voluntary, to_evaluate FROM x FULL JOIN w ON w.ym = x.ym), c(id) AS (VALUES (1), (2), (3)),
t AS (SELECT m.ym, string_agg(c.id || ':' || CAST(coalesce(a, 0) AS DECIMAL(18,2)) || ':' || CASE WHEN w > 0 THEN floor(CAST(coalesce(a, 0) AS DOUBLE) / CAST(w AS DOUBLE) * 100.0 * 100.0 + 0.5) / 100.0 ELSE 0.0::DOUBLE END, '|' ORDER BY c.id) AS contributors FROM m CROSS JOIN c LEFT JOIN g ON g.ym = m.ym AND g.contributor_id = c.id GROUP BY 1),
p AS (SELECT string_agg(concat_ws(':', id, target_amount, saved_amount, floor(CAST(saved_amount AS DOUBLE) / CAST(target_amount AS DOUBLE) * 100.0 * 1.0 + 0.5) / 1.0), '|' ORDER BY id) AS projects FROM (SELECT * FROM projects WHERE status = 'active' ORDER BY id LIMIT 3))
SELECT m.ym, contributors, CAST(coalesce(necessary, 0) AS DECIMAL(18,2)) AS necessary, CAST(coalesce(voluntary, 0) AS DECIMAL(18,2)) AS voluntary, CAST(coalesce(to_evaluate, 0) AS DECIMAL(18,2)) AS to_evaluate, projects FROM m JOIN t ON t.ym = m.ym, p"""),
    "closing_notes": f"""WITH {_M}, o AS (SELECT ym, ym % 5 <> 0 AS single, DATE '1997-03-15' < {_FIRST.format('(ym + 1)')} OR ym % 7 = 0 AS open, 'il 1° ' || lower({_MONTH.format('(ym + 1)')}) || ' ' || {_YEAR.format('(ym + 1)')} || ' alle 00:00.' AS due FROM m)
SELECT ym, CASE WHEN single AND NOT open THEN 'Mese chiuso automaticamente.' ELSE 'Il mese viene chiuso automaticamente alla sua scadenza.' END AS main, CASE WHEN NOT single THEN 'I singoli mesi vengono chiusi automaticamente alla rispettiva scadenza.' WHEN open THEN 'Chiusura automatica prevista ' || due ELSE 'Chiuso ' || due END AS second FROM o""",
    "report_titles": f"""WITH {_M}, k AS (SELECT ym, {_pick("'current_month', 'last_three_months', 'current_year', 'choose_period', 'last_six_months'", 'ym')} AS kind, (ym - 1) // 12 * 12 + 1 AS j FROM m),
r AS (SELECT ym, kind, CASE WHEN kind = 'current_year' THEN j + 11 WHEN kind = 'choose_period' AND ym % 2 = 0 THEN NULL ELSE ym END AS e, CASE kind WHEN 'current_year' THEN j WHEN 'last_three_months' THEN ym - 2 WHEN 'last_six_months' THEN ym - 5 ELSE ym END AS s FROM k),
n AS (SELECT ym, kind, s, e, {_MONTH.format('s')} AS sm, {_MONTH.format('e')} AS em, {_YEAR.format('s')} AS sy, {_YEAR.format('e')} AS ey, CASE WHEN e IS NOT NULL THEN {_LAST.format('e')} END AS ld FROM r)
SELECT ym, CASE WHEN e IS NULL THEN 'Report Economico' WHEN kind = 'current_year' THEN 'Report Economico Annuale – ' || ey WHEN s = e THEN 'Report Economico – ' || em || ' ' || ey WHEN sy = ey THEN 'Report Economico – ' || sm || '–' || em || ' ' || ey ELSE 'Report Economico – ' || sm || ' ' || sy || '–' || em || ' ' || ey END AS title,
  CASE WHEN e IS NULL THEN 'Seleziona il mese per generare il report.' WHEN kind IN ('current_month', 'choose_period') THEN 'Analisi economica relativa a ' || lower(em) || ' ' || ey || '.' WHEN kind = 'current_year' THEN 'Analisi economica dell’anno ' || ey || '.'
    WHEN sy = ey THEN 'Analisi economica dal 1° ' || lower(sm) || ' al ' || ld || ' ' || lower(em) || ' ' || ey || '.' ELSE 'Analisi economica dal 1° ' || lower(sm) || ' ' || sy || ' al ' || ld || ' ' || lower(em) || ' ' || ey || '.' END AS subtitle,
  CASE WHEN e IS NULL THEN '' ELSE 'Periodo analizzato: 01/' || strftime({_FIRST.format('s')}, '%m/%Y') || ' – ' || ld || strftime({_FIRST.format('e')}, '/%m/%Y') END AS printed FROM n""",
    "provision_bookings": A.sql("fixed", f""", d AS (SELECT *, make_date(CAST((start_ym - 1) // 12 AS INT), CAST((start_ym - 1) % 12 AS INT) + 1, CAST(least(CASE WHEN due_day = 0 THEN 1 ELSE due_day END, day(last_day({_FIRST.format('start_ym')}))) AS INT)) AS dt FROM fixed)
SELECT id, CASE WHEN id % 2 = 0 THEN 'projectPurchase' ELSE 'fixedExpense' END AS entry_mode, expected_amount AS amount, CASE WHEN id % 3 = 0 THEN dt END AS payment_date, CAST(month(dt) AS INT) AS competence_month, CAST(year(dt) AS INT) AS competence_year FROM d"""),
    "project_purchases": """SELECT o_orderkey AS project_id, 'Acquisto Progetto: ' || o_orderpriority AS description, 'projectPurchase' AS entry_mode, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS payment_date, 'r3' AS category_id,
  (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 3 ORDER BY n_nationkey * 7 % 11, 'n' || n_nationkey LIMIT 1) AS subcategory_id FROM orders""",
    "monthly_equivalents": A.sql("fixed", "SELECT id, floor(CAST(expected_amount AS DOUBLE) / CASE frequency WHEN 'bimonthly' THEN 2 WHEN 'quarterly' THEN 3 WHEN 'fourMonthly' THEN 4 WHEN 'semiannual' THEN 6 WHEN 'annual' THEN 12 ELSE 1 END * 100.0 + 0.5) / 100.0 AS equivalent FROM fixed"),
    "reserve_guard": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'voluntary' ELSE 'deficit' END AS kind, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS funded FROM orders GROUP BY 1",
    "upcoming_totals": A.sql("expenses plans projects", "SELECT (SELECT sum(amount) FROM expenses WHERE status NOT IN ('paid', 'cancelled')) AS upcoming, (SELECT sum(monthly_quota) FROM plans WHERE status = 'active') AS plans, (SELECT sum(monthly_quota) FROM projects WHERE status = 'active') AS projects"),
    "licence_validity": f"""WITH l AS (SELECT o_orderkey AS n, {_pick("'beta_60_days', 'annual', 'lifetime_perpetual'")} AS t, {_pick("'active', 'suspended', 'active', 'invalid', 'beta_expired', 'active', 'not_activated'")} AS st FROM orders),
k AS (SELECT *, CASE WHEN n % 11 = 0 OR st = 'not_activated' THEN 'not_activated' WHEN st <> 'active' THEN st END AS known FROM l), v AS (SELECT *, known IS NULL AND n % 5 <> 0 AND {_LEFT} <= 0 AS ov FROM k)
SELECT n AS id, known IS NULL AND NOT ov AS is_valid, CASE WHEN known IS NOT NULL THEN known WHEN ov THEN CASE WHEN t = 'beta_60_days' THEN 'beta_expired' ELSE 'invalid' END ELSE st END AS state,
  CAST(CASE WHEN known = 'beta_expired' OR ov THEN 0 WHEN known = 'suspended' THEN n % 30 WHEN known IS NOT NULL THEN NULL WHEN n % 5 <> 0 THEN ceil({_LEFT}) WHEN t <> 'lifetime_perpetual' THEN n % 30 END AS INT) AS days_left,
  CASE WHEN ov THEN 'Licenza scaduta' WHEN known = 'not_activated' THEN 'Licenza non attivata' WHEN known = 'beta_expired' THEN 'Licenza beta scaduta' WHEN known = 'suspended' THEN 'Licenza sospesa' WHEN known = 'invalid' THEN 'Licenza non valida' END AS reason FROM v""",
    "licence_windows": "WITH w AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 33 / 2.0 - 4 END AS d FROM orders) SELECT n AS id, n % 4 <> 0 AND coalesce(d BETWEEN 0 AND 5, FALSE) AS soon, coalesce(d < 0, FALSE) AS over FROM w",
    "licence_offline_states": f"""WITH l AS (SELECT o_orderkey AS n, {_after('o_orderkey % 40 - 6')} AS w, {_after('o_orderkey % 40 - 3')} AS x FROM orders), u AS (SELECT n, CASE WHEN n % 5 = 0 AND n % 3 = 0 THEN NULL WHEN n % 5 = 0 THEN x ELSE w END AS until FROM l)
SELECT n AS id, CASE WHEN n % 7 = 1 THEN 'LICENSE_SUSPENDED' WHEN n % 7 = 3 THEN 'INVALID_STATE' WHEN n % 7 = 5 THEN 'LICENSE_EXPIRED' WHEN n % 6 = 0 THEN 'INVALID_LICENSE_SIGNATURE' WHEN n % 8 <> 0 AND n % 17 > 15 OR n % 13 > 12 THEN 'CLOCK_TAMPERING_DETECTED' WHEN {_T} > until THEN 'LICENSE_EXPIRED' ELSE 'VALID' END AS state, CAST(until AS DATE) AS until FROM u""",
    "clock_rollbacks": "SELECT device, seq FROM (SELECT o_custkey AS device, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS t, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE t < before",
    "contributor_form_errors": """SELECT CASE WHEN n % 5 IN (2, 4) THEN 'Indica il nome del contributore.' WHEN n % 5 = 1 THEN 'Il nome può contenere soltanto lettere e spazi.' WHEN n % 4 IN (2, 3) THEN 'Indirizzo e-mail non valido per ' || CASE WHEN n % 5 = 0 THEN 'Anna Maria' ELSE 'Élodie' END END AS fault,
  CASE WHEN n % 5 IN (1, 3) THEN 'Il CAP deve contenere esattamente 5 cifre.' END AS postal_fault, count(*) AS n FROM (SELECT o_orderkey AS n FROM orders) GROUP BY 1, 2""",
    "goal_entries": """WITH e AS (SELECT o_orderkey AS n, o_orderkey % 500 AS k FROM orders), f AS (SELECT n, k, CASE n % 6 WHEN 0 THEN 'L''importo dell''obiettivo è obbligatorio.' WHEN 1 THEN CASE WHEN k > 99 THEN 'L''importo non può avere più di due cifre decimali.' END WHEN 5 THEN NULL ELSE 'Inserisci un importo valido maggiore di zero.' END AS fault FROM e)
SELECT n AS id, fault, CASE WHEN fault IS NULL THEN CASE WHEN n % 6 = 5 THEN 1.2::DOUBLE WHEN k > 9 THEN (100 + k) / 100.0::DOUBLE ELSE (10 + k) / 10.0::DOUBLE END END AS value FROM f""",
    "fixed_expense_form_errors": """SELECT CASE WHEN n % 7 = 0 THEN 'Il nome della spesa fissa è obbligatorio' WHEN n % 11 = 0 THEN 'L''importo previsto deve essere maggiore di zero' WHEN n % 13 = 0 THEN 'Indica la durata della spesa ricorrente.' WHEN n % 6 < 2 THEN 'La durata deve essere maggiore di 0 mesi.' WHEN n % 5 = 0 THEN 'Indica il giorno di scadenza.'
  WHEN n % 31 = 0 THEN 'Il giorno di scadenza deve essere maggiore di 0.' WHEN n % 31 > 28 THEN 'Febbraio 1999 contiene 28 giorni. Inserisci un valore compreso tra 1 e 28.' WHEN n % 3 = 0 THEN 'Seleziona una categoria valida' ELSE 'none' END AS fault, count(*) AS n FROM (SELECT o_orderkey AS n FROM orders) GROUP BY 1""",
    "contact_request_checks": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 2 THEN 'synced' ELSE 'pending' END AS sync_status, CASE WHEN o_orderkey % 2 = 0 THEN DATE '1998-01-01' ELSE greatest(DATE '1996-06-01', CAST(o_orderdate AS DATE)) END AS updated_on, 1 AS schema_version
FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey % 8 <> 0 AND o_orderkey % 5 IN (0, 3)""",
    "competence_months": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (0, 4) THEN year(o_orderdate) * 12 + month(o_orderdate) ELSE 1998 * 12 + 7 END AS ym FROM orders",
    "file_sizes": """WITH s AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey * o_orderkey % 5 * 512 + o_orderkey % 3 * 4194304 ELSE 0 END AS b FROM orders)
SELECT n AS id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024.0) ELSE format('{:.1f} MB', b / 1048576.0) END AS size FROM s""",
    "supplier_alternatives": "SELECT o_orderkey AS order_id, 3 AS n, 'VIA ROMA 1' AS second, '20100 MILANO' AS third FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)",
    "recognised_pages": "SELECT conv_id, turn, md5(text) AS text_md5, CAST(strlen(text) % 101 AS INT) AS read_confidence FROM conversations",
    "receipt_duplicate_lines": f"WITH {_ITEMS} SELECT DISTINCT l_orderkey AS order_id FROM it JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, lower(name), c - off HAVING count(*) > 1",
}
