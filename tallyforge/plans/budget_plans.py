"""Registered queries: budget, ledger, recurrence, labels and reminders over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import calendar, money, status
from tallyforge.operators import budget, ledger, recurrence, reminders
from tallyforge.sources import adapters as A

START, END = 1997 * 12 + 11, 1998 * 12 + 6
NOW = A.NOW


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return A.incomes(spark, d), A.expenses(spark, d)


def monthly_budget_summary(spark: SparkSession, d: str) -> DataFrame:
    return budget.monthly_summary(*_facts(spark, d), A.saving_plans(spark, d), A.projects(spark, d))


def period_summary_range(spark: SparkSession, d: str) -> DataFrame:
    opening = spark.range(1).select(F.lit("12345.67").cast("decimal(18,2)").alias("opening"))
    return budget.period_summary(*_facts(spark, d), A.saving_plans(spark, d), A.projects(spark, d), opening, START, END)


def ytd_summary(spark: SparkSession, d: str) -> DataFrame:
    opening = spark.range(1).select(F.lit("0").cast("decimal(18,2)").alias("opening"))
    return budget.period_summary(*_facts(spark, d), A.saving_plans(spark, d), A.projects(spark, d), opening, 1998 * 12 + 1, END)


def expenses_by_category(spark: SparkSession, d: str) -> DataFrame:
    return budget.by_category(A.with_category(spark, d, A.expenses(spark, d)), A.categories(spark, d))


def expenses_by_leaf_category(spark: SparkSession, d: str) -> DataFrame:
    return budget.by_category(A.with_category(spark, d, A.expenses(spark, d)), A.categories(spark, d), top_level=False)


def month_trend_5(spark: SparkSession, d: str) -> DataFrame:
    return budget.month_trend(*_facts(spark, d), END - 4, END)


def month_trend_range(spark: SparkSession, d: str) -> DataFrame:
    return budget.month_trend(*_facts(spark, d), START, END)


def trend_bars(spark: SparkSession, d: str) -> DataFrame:
    return budget.trend_bars(month_trend_range(spark, d))


def contributor_share(spark: SparkSession, d: str) -> DataFrame:
    return budget.contributor_share(A.incomes(spark, d), spark.range(1, 5))


def classification_pivot(spark: SparkSession, d: str) -> DataFrame:
    return budget.classification_pivot(A.expenses(spark, d))


def report_ratios(spark: SparkSession, d: str) -> DataFrame:
    return budget.report_ratios(*_facts(spark, d))


def goal_variance(spark: SparkSession, d: str) -> DataFrame:
    goals = spark.range(START, END + 3).select(F.col("id").cast("int").alias("ym"), (F.col("id") % 7 * 500000).cast("decimal(18,2)").alias("goal"))
    return budget.goal_variance(*_facts(spark, d), goals)


def page_totals(spark: SparkSession, d: str) -> DataFrame:
    return budget.page_totals(*_facts(spark, d))


def project_progress(spark: SparkSession, d: str) -> DataFrame:
    return budget.project_progress(A.projects(spark, d))


def reserve_ledger_chained(spark: SparkSession, d: str) -> DataFrame:
    o = A.expenses(spark, d).where(~status.is_cancelled(F.col("status")))
    # paid against unpaid expenses of a month stand for its result: both signs occur
    s = o.groupBy("ym").agg(money.total("amount", F.col("status") == "planned").alias("a"), money.total("amount", F.col("status") == "paid").alias("b"))
    s = s.select(calendar.year_of(F.col("ym")).alias("year"), calendar.month_of(F.col("ym")).alias("month"), (F.col("a") - F.col("b")).alias("prudential"))
    return ledger.chained(s)


def _movements(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 97 == 0, ledger.ADJUSTMENT).when(F.col("o_orderkey") % 2 == 0, ledger.DEPOSIT).otherwise(ledger.COVERAGE)
    o = A.read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("ledger"), F.to_date("o_orderdate").alias("movement_date"), kind.alias("type"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


def reserve_ledger_stored(spark: SparkSession, d: str) -> DataFrame:
    return ledger.balances(_movements(spark, d), ["movement_date", "id"], ["ledger"]).select("id", "ledger", F.col("balance_after").cast("double"))


def reserve_latest_balance(spark: SparkSession, d: str) -> DataFrame:
    return ledger.latest_balance(A.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("movement_date"), F.col("o_totalprice").alias("balance_after")))


def recurring_movements_duration(spark: SparkSession, d: str) -> DataFrame:
    return recurrence.by_duration(A.fixed_expenses(spark, d)).withColumn("amount", F.col("amount").cast("double"))


def recurring_movements_month(spark: SparkSession, d: str) -> DataFrame:
    f = A.fixed_expenses(spark, d).withColumn("end_ym", F.col("start_ym") + F.col("duration_months") + 11)
    return recurrence.for_months(f, END - 4, END).withColumn("amount", F.col("amount").cast("double"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Movements as they might be stored: every third month is missing, some differ, some are paid, some lie after the end."""
    m = recurrence.by_duration(A.fixed_expenses(spark, d).withColumn("duration_months", F.col("duration_months") + 2))
    n = (F.col("fixed_expense_id") / 10).cast("long") + F.col("month")
    return m.where(n % 3 != 0).withColumn("amount", F.when(n % 4 == 0, F.col("amount") + 1).otherwise(F.col("amount"))).withColumn("status", F.when(n % 5 == 0, "paid").otherwise("planned"))


def recurring_reconcile_actions(spark: SparkSession, d: str) -> DataFrame:
    return recurrence.reconcile(recurrence.by_duration(A.fixed_expenses(spark, d)), _stored(spark, d))


def recurring_prune(spark: SparkSession, d: str) -> DataFrame:
    return recurring_reconcile_actions(spark, d).where("action = 'delete'").select("fixed_expense_id", "year", "month")


def project_provisions_union(spark: SparkSession, d: str) -> DataFrame:
    e = A.expenses(spark, d).withColumn("project_id", F.when(F.col("id") % 100 == 0, (F.col("id") / 100 % 40 * 50).cast("long")))
    return recurrence.provisions(A.projects(spark, d), e, END, END + 1)


def expense_status_labels(spark: SparkSession, d: str) -> DataFrame:
    e = A.expenses(spark, d).withColumn("l", status.expense_label(F.col("status"), F.col("expense_date"), F.lit(NOW).cast("date")))
    return e.select("id", "l.label", "l.badge", "l.due_alert", "l.days")


def income_status_labels(spark: SparkSession, d: str) -> DataFrame:
    i = A.incomes(spark, d).withColumn("l", status.income_label(F.col("status")))
    return i.groupBy("l.label", "l.badge").agg(F.count("*").alias("n"))


def upcoming_payments(spark: SparkSession, d: str) -> DataFrame:
    e = A.expenses(spark, d).where(~status.is_cancelled(F.col("status")) & (F.col("status") != "paid"))
    return e.select("id", "expense_date", F.col("amount").cast("double")).orderBy(F.asc_nulls_first("expense_date"), "id")


def _reminder_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n = A.read(spark, d, "supplier").count()
    e = A.expenses(spark, d).withColumn("supplier_id", F.col("id") % (n + 1)).withColumn("description", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Ordine "), F.col("id"))).otherwise(""))
    e = e.withColumn("entry_mode", F.when(F.col("id") % 4 == 0, "fixedExpense").otherwise("manual"))
    people = spark.range(1, 5).select("id", (F.col("id") != 4).alias("active"), (F.col("id") > 0).alias("receive_emails"), F.concat(F.lit(" c"), F.col("id"), F.lit("@casa.example ")).alias("email"), (F.col("id") <= 2).alias("receive_48h"), (F.col("id") >= 2).alias("receive_24h"))
    sent = e.where("id % 5 = 0").select(F.concat_ws("_", F.when(F.col("entry_mode") == "fixedExpense", "fixedExpense").otherwise("expense"), F.col("id").cast("string"), F.date_format("expense_date", "yyyy-MM-dd"), F.lit("48h")).alias("unique_key"))
    return e, A.suppliers(spark, d), people, sent


def deadline_reminders(spark: SparkSession, d: str) -> DataFrame:
    return reminders.generate(*_reminder_inputs(spark, d), NOW)


def reminders_mark_read(spark: SparkSession, d: str) -> DataFrame:
    n = A.read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_orderkey").alias("related_entity_id"), (F.col("l_quantity") > 40).alias("read"))
    return reminders.mark_read(n, A.expenses(spark, d)).groupBy("read").agg(F.count("*").alias("n"))


def unread_count(spark: SparkSession, d: str) -> DataFrame:
    return reminders.unread(A.read(spark, d, "lineitem").select((F.col("l_quantity") > 40).alias("read")))


def validation_messages(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part")
    day, ym, duration = F.col("p_size") - 5, F.lit(1998 * 12 + 2), F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise((F.col("p_size") - 3) / 2.0)
    return p.groupBy(calendar.due_day_error(day, ym).alias("day_error"), calendar.duration_error(duration).alias("duration_error"), calendar.recurrence_text(ym, F.col("p_size") % 3 + 1).alias("summary")).agg(F.count("*").alias("n"))


_PARTS = """months AS (SELECT ym, CAST(sum(income) AS DECIMAL(18,2)) AS income, CAST(sum(received) AS DECIMAL(18,2)) AS received, CAST(sum(expense) AS DECIMAL(18,2)) AS expense,
  CAST(sum(paid) AS DECIMAL(18,2)) AS paid, CAST(sum(notified) AS DECIMAL(18,2)) AS notified_planned FROM (
  SELECT ym, amount AS income, CASE WHEN status = 'received' THEN amount ELSE 0 END AS received, 0 AS expense, 0 AS paid, 0 AS notified, income_date AS day FROM incomes WHERE status <> 'cancelled'
  UNION ALL SELECT ym, 0, 0, amount, CASE WHEN status = 'paid' THEN amount ELSE 0 END, CASE WHEN status = 'planned' AND notified THEN amount ELSE 0 END, expense_date FROM expenses WHERE status <> 'cancelled') GROUP BY ym),
q AS (SELECT (SELECT coalesce(sum(monthly_quota), 0) FROM plans WHERE status = 'active') AS plan_quota, (SELECT coalesce(sum(monthly_quota), 0) FROM projects WHERE status = 'active') AS project_quota)
"""


def _period_sql(start: int, end: int, opening: str) -> str:
    n = end - start + 1
    return f""", m AS (SELECT coalesce(sum(income), 0) AS income, coalesce(sum(received), 0) AS received, coalesce(sum(expense), 0) AS expense, coalesce(sum(paid), 0) AS paid, coalesce(sum(notified_planned), 0) AS notified_planned FROM months WHERE ym BETWEEN {start} AND {end}),
p AS (SELECT *, received - paid - notified_planned - (plan_quota + project_quota) * {n} AS pb FROM m, q)
SELECT {start} AS start_ym, {end} AS end_ym, {n} AS months, CAST(income AS DOUBLE) AS income, CAST(received AS DOUBLE) AS received, CAST(expense AS DOUBLE) AS expense, CAST(paid AS DOUBLE) AS paid, CAST(notified_planned AS DOUBLE) AS notified_planned,
  CAST(income - expense AS DOUBLE) AS savings, CAST(plan_quota * {n} AS DOUBLE) AS plan_total, CAST(project_quota * {n} AS DOUBLE) AS project_total, CAST(pb AS DOUBLE) AS prudential, CAST(greatest(pb, 0) AS DOUBLE) AS surplus, CAST(greatest(-pb, 0) AS DOUBLE) AS deficit,
  CAST({opening} AS DOUBLE) AS opening, CAST(least({opening}, greatest(-pb, 0)) AS DOUBLE) AS reserve_used, CAST(greatest(-pb, 0) - least({opening}, greatest(-pb, 0)) AS DOUBLE) AS uncovered,
  CAST({opening} + greatest(pb, 0) - least({opening}, greatest(-pb, 0)) AS DOUBLE) AS closing FROM p"""


_VIEWS = "incomes expenses plans projects"


def _with_parts(query: str) -> str:
    return A.sql(_VIEWS, ", " + _PARTS + query)


def _trend_sql(start: int, end: int) -> str:
    label = "list_extract(['Gen','Feb','Mar','Apr','Mag','Giu','Lug','Ago','Set','Ott','Nov','Dic'], (ym - 1) % 12 + 1)"
    if (start - 1) // 12 != (end - 1) // 12:
        label += " || ' ''' || lpad(CAST((ym - 1) // 12 % 100 AS VARCHAR), 2, '0')"
    return f""", spine AS (SELECT CAST(unnest(range({start}, {end + 1})) AS INT) AS ym),
trend AS (SELECT CAST((ym - 1) // 12 AS INT) AS year, CAST((ym - 1) % 12 + 1 AS INT) AS month, {label} AS month_label, CAST(coalesce(expense, 0) AS DOUBLE) AS amount, CAST(coalesce(income, 0) AS DOUBLE) AS income_amount, CAST(coalesce(income, 0) - coalesce(expense, 0) AS DOUBLE) AS savings_amount
FROM spine LEFT JOIN months USING (ym))
"""


def _round(x: str, digits: int) -> str:
    return f"floor(({x}) * {10.0**digits} + 0.5) / {10.0**digits}"


_CATEGORY = """, s AS (SELECT c.category_id, sum(e.amount) AS amount, count(*) AS n FROM expenses e LEFT JOIN category_of c USING (customer_id) WHERE e.status <> 'cancelled' GROUP BY 1),
g AS (SELECT {key} AS category_id, {name} AS category_name, sum(s.amount) AS amount, sum(s.n) AS n FROM s LEFT JOIN categories c ON c.id = s.category_id LEFT JOIN categories p ON p.id = c.parent_id GROUP BY 1, 2)
SELECT category_id, category_name, CAST(amount AS DOUBLE) AS amount, CAST(n AS BIGINT) AS movements, floor(CAST(amount AS DOUBLE) / CAST((SELECT sum(amount) FROM g) AS DOUBLE) * 100.0 * 10.0 + 0.5) / 10.0 AS percentage FROM g"""

_FIXED_MONTHS = """, RECURSIVE_MONTHS AS (SELECT id, name, expected_amount, due_day, start_ym, start_ym AS ym, start_ym + duration_months - 1 AS last FROM fixed WHERE status = 'active'
  UNION ALL SELECT id, name, expected_amount, due_day, start_ym, ym + 1, last FROM RECURSIVE_MONTHS WHERE ym < last),
due AS (SELECT *, CAST((ym - 1) // 12 AS INT) AS year, CAST((ym - 1) % 12 + 1 AS INT) AS month, make_date((ym - 1) // 12, (ym - 1) % 12 + 1, 1) AS first FROM RECURSIVE_MONTHS),
wanted AS (SELECT id AS fixed_expense_id, year, month, CAST(first + to_days(CAST(least(coalesce(nullif(due_day, 0), 1), day(last_day(first))) - 1 AS INT)) AS DATE) AS expense_date, name AS description, expected_amount AS amount FROM due)
"""


def _recursive(query: str) -> str:
    return "WITH RECURSIVE " + A.SQL["fixed"] + _FIXED_MONTHS + query


_RECONCILE = """, longer AS (SELECT f.id AS fixed_expense_id, CAST((m - 1) // 12 AS INT) AS year, CAST((m - 1) % 12 + 1 AS INT) AS month, f.expected_amount AS amount
  FROM (SELECT *, unnest(range(start_ym, start_ym + duration_months + 2)) AS m FROM fixed WHERE status = 'active') f),
stored AS (SELECT fixed_expense_id, year, month, CASE WHEN (fixed_expense_id // 10 + month) % 4 = 0 THEN amount + 1 ELSE amount END AS amount, CASE WHEN (fixed_expense_id // 10 + month) % 5 = 0 THEN 'paid' ELSE 'planned' END AS status
  FROM longer WHERE (fixed_expense_id // 10 + month) % 3 <> 0),
r AS (SELECT fixed_expense_id, year, month, CASE WHEN s.status IS NULL THEN 'insert' WHEN w.amount IS NULL AND s.status = 'planned' THEN 'delete' WHEN s.status = 'planned' AND w.amount <> s.amount THEN 'update' ELSE 'keep' END AS action,
  CAST(coalesce(w.amount, s.amount) AS DOUBLE) AS amount FROM wanted w FULL JOIN stored s USING (fixed_expense_id, year, month))
"""

_LABEL = f"""SELECT id, CASE WHEN status = 'paid' THEN 'Pagata' WHEN status = 'cancelled' THEN 'Annullata' WHEN d < 0 THEN 'Scaduta' WHEN d <= 30 THEN 'In scadenza' WHEN status = 'planned' THEN 'Pianificata' ELSE 'Da pagare' END AS label,
  CASE WHEN status = 'paid' THEN 'success' WHEN status = 'cancelled' THEN 'neutral' WHEN d < 0 THEN 'danger' WHEN d <= 30 THEN 'warning' WHEN status = 'planned' THEN 'info' ELSE 'warning' END AS badge,
  CASE WHEN status IN ('paid', 'cancelled') THEN 'normal' WHEN d < 0 THEN 'overdue' WHEN d <= 1 THEN 'within24h' WHEN d = 2 THEN 'within48h' ELSE 'normal' END AS due_alert,
  CAST(CASE WHEN status IN ('paid', 'cancelled') THEN NULL WHEN d < 0 THEN -1 WHEN d <= 30 THEN d END AS INT) AS days FROM (SELECT *, date_diff('day', DATE '{NOW}', expense_date) AS d FROM expenses)"""

_REMINDERS = f""", e AS (SELECT x.*, id % ((SELECT count(*) FROM supplier) + 1) AS supplier_id, CASE WHEN id % 3 = 0 THEN 'Ordine ' || id ELSE '' END AS description, CASE WHEN id % 4 = 0 THEN 'fixedExpense' ELSE 'expense' END AS kind,
  date_diff('day', DATE '{NOW}', expense_date) * 24 AS h FROM expenses x),
l AS (SELECT e.*, coalesce(nullif(e.description, ''), s.s_name, 'Spesa') AS label, '€' || CAST(amount AS VARCHAR) AS money, strftime(expense_date, '%Y-%m-%d') AS day FROM e LEFT JOIN supplier s ON s.s_suppkey = e.supplier_id WHERE h IN (24, 48) AND status NOT IN ('paid', 'cancelled')),
k AS (SELECT *, kind || '_' || id || '_' || day || '_' || h || 'h' AS unique_key FROM l WHERE NOT (h = 48 AND id % 5 = 0))
SELECT unique_key, id AS expense_id, 'deadline_' || h || 'h' AS type, CASE WHEN h = 48 THEN 'Scadenza ' || label || ' tra 48 ore' ELSE 'Scadenza ' || label || ' domani' END AS title,
  CASE WHEN h = 48 THEN 'La spesa ' || label || ' di ' || money || ' scade il ' || day || '.' ELSE 'La spesa ' || label || ' di ' || money || ' scade domani (' || day || ').' END AS message,
  CASE WHEN h = 48 THEN 'c1@casa.example,c2@casa.example' ELSE 'c2@casa.example,c3@casa.example' END AS recipients FROM k"""

QUERIES = {
    f.__name__: f
    for f in (
        monthly_budget_summary, period_summary_range, ytd_summary, expenses_by_category, expenses_by_leaf_category, month_trend_5, month_trend_range, trend_bars, contributor_share, classification_pivot, report_ratios, goal_variance,
        page_totals, project_progress, reserve_ledger_chained, reserve_ledger_stored, reserve_latest_balance, recurring_movements_duration, recurring_movements_month, recurring_reconcile_actions, recurring_prune, project_provisions_union,
        expense_status_labels, income_status_labels, upcoming_payments, deadline_reminders, reminders_mark_read, unread_count, validation_messages,
    )
}

ORACLE_SQL = {
    "monthly_budget_summary": _with_parts("""SELECT CAST((ym - 1) // 12 AS INT) AS year, CAST((ym - 1) % 12 + 1 AS INT) AS month, CAST(income AS DOUBLE) AS total_income, CAST(received AS DOUBLE) AS total_received, CAST(expense AS DOUBLE) AS total_expenses,
  CAST(paid AS DOUBLE) AS paid_expenses, CAST(income - expense AS DOUBLE) AS savings, CAST(notified_planned AS DOUBLE) AS notified_planned, CAST(plan_quota AS DOUBLE) AS plan_quota, CAST(project_quota AS DOUBLE) AS project_quota,
  CAST(pb AS DOUBLE) AS prudential, CAST(greatest(pb, 0) AS DOUBLE) AS surplus, CAST(greatest(-pb, 0) AS DOUBLE) AS deficit FROM (SELECT *, received - paid - notified_planned - plan_quota - project_quota AS pb FROM months, q)"""),
    "period_summary_range": _with_parts(_period_sql(START, END, "12345.67")),
    "ytd_summary": _with_parts(_period_sql(1998 * 12 + 1, END, "0.00")),
    "expenses_by_category": A.sql("expenses category_of categories", _CATEGORY.format(key="coalesce(CASE WHEN p.name IS NOT NULL THEN p.id ELSE s.category_id END, 'other')", name="coalesce(p.name, c.name, 'Altro')")),
    "expenses_by_leaf_category": A.sql("expenses category_of categories", _CATEGORY.format(key="coalesce(s.category_id, 'other')", name="coalesce(c.name, 'Altro')")),
    "month_trend_5": _with_parts(_trend_sql(END - 4, END) + "SELECT * FROM trend"),
    "month_trend_range": _with_parts(_trend_sql(START, END) + "SELECT * FROM trend"),
    "trend_bars": _with_parts(_trend_sql(START, END) + f", x AS (SELECT max(greatest(amount, income_amount)) AS m FROM trend) SELECT year, month, CASE WHEN m > 0 THEN {_round('amount / m * 100.0', 1)} ELSE 0.0 END AS amount_bar, CASE WHEN m > 0 THEN {_round('income_amount / m * 100.0', 1)} ELSE 0.0 END AS income_amount_bar FROM trend, x"),
    "contributor_share": A.sql("incomes", f""", r AS (SELECT contributor_id, sum(amount) AS amount FROM incomes WHERE status = 'received' GROUP BY 1), c AS (SELECT unnest(range(1, 5)) AS contributor_id)
SELECT contributor_id, CAST(coalesce(amount, 0) AS DOUBLE) AS amount, {_round('CAST(coalesce(amount, 0) AS DOUBLE) / CAST((SELECT sum(amount) FROM r) AS DOUBLE) * 100.0', 2)} AS percentage FROM c LEFT JOIN r USING (contributor_id)"""),
    "classification_pivot": A.sql("expenses", """SELECT ym, CAST(sum(CASE WHEN classification = 'necessary' THEN amount ELSE 0 END) AS DOUBLE) AS necessary, CAST(sum(CASE WHEN classification = 'voluntary' THEN amount ELSE 0 END) AS DOUBLE) AS voluntary,
  CAST(sum(CASE WHEN classification = 'toEvaluate' THEN amount ELSE 0 END) AS DOUBLE) AS toevaluate, CAST(sum(amount) AS DOUBLE) AS total FROM expenses WHERE status <> 'cancelled' GROUP BY ym"""),
    "report_ratios": _with_parts(""", k AS (SELECT ym, CAST(sum(CASE WHEN classification = 'necessary' THEN amount ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN classification = 'voluntary' THEN amount ELSE 0 END) AS DOUBLE) AS b, CAST(sum(CASE WHEN classification = 'toEvaluate' THEN amount ELSE 0 END) AS DOUBLE) AS c FROM expenses WHERE status <> 'cancelled' GROUP BY ym),
n AS (SELECT ym, CAST(income AS DOUBLE) AS i, CAST(expense AS DOUBLE) AS e, CAST(income - expense AS DOUBLE) AS s, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM months LEFT JOIN k USING (ym))
SELECT ym, CASE WHEN i > 0 THEN least(floor(e / i * 100.0 + 0.5), 100.0) ELSE 0.0 END AS expense_ratio, CASE WHEN i > 0 THEN floor(s / i * 100.0 + 0.5) ELSE 0.0 END AS savings_ratio, CASE WHEN e > 0 THEN floor(a / e * 100.0 + 0.5) ELSE 0.0 END AS necessary_ratio,
  CASE WHEN e > 0 THEN floor(b / e * 100.0 + 0.5) ELSE 0.0 END AS voluntary_ratio, CASE WHEN e > 0 THEN floor(c / e * 100.0 + 0.5) ELSE 0.0 END AS toevaluate_ratio FROM n"""),
    "goal_variance": _with_parts(f""", goals AS (SELECT CAST(g AS INT) AS ym, CAST(g % 7 * 500000 AS DECIMAL(18,2)) AS goal FROM (SELECT unnest(range({START}, {END + 3})) AS g)),
v AS (SELECT ym, goal, coalesce(income - expense, 0) AS s FROM goals LEFT JOIN months USING (ym)), w AS (SELECT *, CASE WHEN goal > 0 THEN greatest(floor(CAST(s AS DOUBLE) / CAST(goal AS DOUBLE) * 100.0 + 0.5), 0.0) ELSE 0.0 END AS p FROM v)
SELECT ym, CAST(goal AS DOUBLE) AS goal, CAST(s AS DOUBLE) AS savings, CAST(s - goal AS DOUBLE) AS variance, p AS percentage, least(p, 100.0) AS bar FROM w"""),
    "page_totals": A.sql("incomes expenses", """, i AS (SELECT ym, sum(amount) AS received FROM incomes WHERE status = 'received' GROUP BY ym), e AS (SELECT ym, sum(amount) AS expenses, sum(CASE WHEN status = 'paid' THEN amount ELSE 0 END) AS paid FROM expenses WHERE status <> 'cancelled' GROUP BY ym)
SELECT ym, CAST(coalesce(received, 0) AS DOUBLE) AS received, CAST(coalesce(expenses, 0) AS DOUBLE) AS expenses, CAST(coalesce(paid, 0) AS DOUBLE) AS paid FROM i FULL JOIN e USING (ym)"""),
    "project_progress": A.sql("projects", f"""SELECT id, CAST(greatest(target_amount - saved_amount, 0) AS DOUBLE) AS remaining, {_round('CAST(greatest(target_amount - saved_amount, 0) AS DOUBLE) / greatest(remaining_months, 1)', 2)} AS monthly_quota_needed,
  least(CASE WHEN target_amount > 0 THEN {_round('CAST(saved_amount AS DOUBLE) / CAST(target_amount AS DOUBLE) * 100.0', 2)} ELSE 0.0 END, 100.0) AS progress FROM projects"""),
    "reserve_ledger_chained": "WITH RECURSIVE " + A.SQL["expenses"] + """, s AS (SELECT ym, sum(CASE WHEN status = 'planned' THEN amount ELSE 0 END) - sum(CASE WHEN status = 'paid' THEN amount ELSE 0 END) AS p FROM expenses WHERE status <> 'cancelled' GROUP BY ym),
x AS (SELECT ym, p, row_number() OVER (ORDER BY ym) AS n FROM s WHERE p <> 0),
run AS (SELECT n, ym, p, CAST(0 AS DECIMAL(38,2)) AS opening, CAST(greatest(p, 0) AS DECIMAL(38,2)) AS closing FROM x WHERE n = 1
  UNION ALL SELECT x.n, x.ym, x.p, run.closing, CAST(greatest(run.closing + x.p, 0) AS DECIMAL(38,2)) FROM run JOIN x ON x.n = run.n + 1)
SELECT ym, CASE WHEN p > 0 THEN 'monthlySurplusDeposit' ELSE 'deficitCoverage' END AS type, CAST(abs(p) AS DOUBLE) AS amount, CAST(opening AS DOUBLE) AS opening, CAST(CASE WHEN p < 0 THEN least(opening, -p) ELSE 0 END AS DOUBLE) AS used,
  CAST(CASE WHEN p < 0 THEN -p - least(opening, -p) ELSE 0 END AS DOUBLE) AS uncovered, CAST(closing AS DOUBLE) AS closing FROM run""",
    "reserve_ledger_stored": """WITH RECURSIVE x AS (SELECT o_orderkey AS id, o_custkey % 10 AS ledger, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS n FROM orders),
run AS (SELECT ledger, n, id, CAST(CASE WHEN id % 97 = 0 OR id % 2 = 0 THEN amount ELSE 0 END AS DECIMAL(38,2)) AS b FROM x WHERE n = 1
  UNION ALL SELECT x.ledger, x.n, x.id, CAST(CASE WHEN x.id % 97 = 0 THEN x.amount WHEN x.id % 2 = 0 THEN run.b + x.amount ELSE greatest(run.b - x.amount, 0) END AS DECIMAL(38,2)) FROM run JOIN x ON x.ledger = run.ledger AND x.n = run.n + 1)
SELECT id, ledger, CAST(b AS DOUBLE) AS balance_after FROM run""",
    "reserve_latest_balance": "SELECT o_totalprice AS balance FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey LIMIT 1",
    "recurring_movements_duration": _recursive("SELECT fixed_expense_id, year, month, expense_date, description, CAST(amount AS DOUBLE) AS amount, 'planned' AS status FROM wanted"),
    "recurring_movements_month": A.sql("fixed", f""", m AS (SELECT *, unnest(range({END - 4}, {END + 1})) AS ym FROM fixed WHERE status = 'active'),
k AS (SELECT *, CASE frequency WHEN 'bimonthly' THEN 2 WHEN 'quarterly' THEN 3 WHEN 'fourMonthly' THEN 4 WHEN 'semiannual' THEN 6 WHEN 'annual' THEN 12 ELSE 1 END AS step, make_date((ym - 1) // 12, (ym - 1) % 12 + 1, 1) AS first FROM m WHERE ym BETWEEN start_ym AND start_ym + duration_months + 11)
SELECT id AS fixed_expense_id, CAST((ym - 1) // 12 AS INT) AS year, CAST((ym - 1) % 12 + 1 AS INT) AS month, CAST(first + to_days(CAST(least(coalesce(nullif(due_day, 0), 1), day(last_day(first))) - 1 AS INT)) AS DATE) AS expense_date, name AS description, CAST(expected_amount AS DOUBLE) AS amount, 'planned' AS status FROM k WHERE (ym - 1) % 12 % step = 0"""),
    "recurring_reconcile_actions": _recursive(_RECONCILE + "SELECT * FROM r"),
    "recurring_prune": _recursive(_RECONCILE + "SELECT fixed_expense_id, year, month FROM r WHERE action = 'delete'"),
    "project_provisions_union": A.sql("expenses projects", f""", e AS (SELECT *, CASE WHEN id % 100 = 0 THEN id // 100 % 40 * 50 END AS project_id FROM expenses WHERE ym = {END + 1}),
p AS (SELECT *, year(start_date) * 12 + month(start_date) AS s, coalesce(year(target_date) * 12 + month(target_date), year(start_date) * 12 + month(start_date) + remaining_months - 1) AS t FROM projects WHERE status = 'active' AND monthly_quota > 0)
SELECT CAST(id AS VARCHAR) AS id, '' AS description, CAST(amount AS DOUBLE) AS amount, status, FALSE AS is_provision FROM e
UNION ALL SELECT 'acc-proj-' || id || '-{END // 12}-{END % 12 + 1}', 'Accantonamento Progetto: ' || name, CAST(monthly_quota AS DOUBLE), 'planned', TRUE FROM p WHERE {END + 1} >= greatest({END}, s) AND {END + 1} <= t AND NOT EXISTS (SELECT 1 FROM e WHERE e.project_id = p.id)"""),
    "expense_status_labels": A.sql("expenses", _LABEL),
    "income_status_labels": A.sql("incomes", """SELECT CASE status WHEN 'received' THEN 'Incassata' WHEN 'cancelled' THEN 'Annullata' WHEN 'skipped' THEN 'Saltata' ELSE 'Pianificata' END AS label, CASE status WHEN 'received' THEN 'success' WHEN 'cancelled' THEN 'neutral' WHEN 'skipped' THEN 'warning' ELSE 'info' END AS badge, count(*) AS n FROM incomes GROUP BY 1, 2"""),
    "upcoming_payments": A.sql("expenses", "SELECT id, expense_date, CAST(amount AS DOUBLE) AS amount FROM expenses WHERE status NOT IN ('cancelled', 'paid')"),
    "deadline_reminders": A.sql("expenses", _REMINDERS),
    "reminders_mark_read": A.sql("expenses", "SELECT l_quantity > 40 OR coalesce(e.status IN ('paid', 'cancelled'), FALSE) AS read, count(*) AS n FROM lineitem LEFT JOIN expenses e ON e.id = l_orderkey GROUP BY 1"),
    "unread_count": "SELECT count(*) FILTER (WHERE NOT l_quantity > 40) AS unread FROM lineitem",
    "validation_messages": """WITH p AS (SELECT p_size - 5 AS d, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_size - 3) / 2.0 END AS n, p_size % 3 + 1 AS k FROM part)
SELECT CASE WHEN d <= 0 THEN 'Il giorno di scadenza deve essere maggiore di 0.' WHEN d > 28 THEN 'Febbraio 1998 contiene 28 giorni. Inserisci un valore compreso tra 1 e 28.' END AS day_error,
  CASE WHEN n IS NULL THEN 'Indica la durata della spesa ricorrente.' WHEN n <> floor(n) THEN 'La durata deve essere espressa con un numero intero di mesi.' WHEN n <= 0 THEN 'La durata deve essere maggiore di 0 mesi.' END AS duration_error,
  'Questa spesa verrà conteggiata per ' || k || CASE WHEN k = 1 THEN ' mese' ELSE ' mesi' END || ', da Febbraio 1998 a ' || ['Febbraio', 'Marzo', 'Aprile'][k] || ' 1998.' AS summary, count(*) AS n FROM p GROUP BY ALL""",
}
