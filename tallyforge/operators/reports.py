"""Month report snapshots, their titles and closing notes, and the bookings that come from provisions and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import calendar as C
from tallyforge.functions.money import js_round, share, total
from tallyforge.functions.status import is_cancelled

#: Texts of reports and closing notes, entry modes of expenses.
AUTOMATIC, CLOSED, EACH_MONTH = "Il mese viene chiuso automaticamente alla sua scadenza.", "Mese chiuso automaticamente.", "I singoli mesi vengono chiusi automaticamente alla rispettiva scadenza."
CLASSES = {"necessary": "necessary", "voluntary": "voluntary", "to_evaluate": "toEvaluate"}
PROJECT, FIXED = "projectPurchase", "fixedExpense"


def _name(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, C.MONTHS_LONG)), C.month_of(index))


def _year(index: Column) -> Column:
    return C.year_of(index).cast("string")


def _last_day(index: Column) -> Column:
    return F.day(F.last_day(C.first_day(index))).cast("string")


def snapshots(incomes: DataFrame, expenses: DataFrame, contributors: DataFrame, projects: DataFrame) -> DataFrame:
    """A row a month (`ym`) with what its report stores of contributors, classes and projects.

    incomes: ym, contributor_id, amount, status; expenses: ym, amount, status, classification; contributors and projects: the few active ones (three of each in this domain), `id` first.
    Facts are summed before anything is joined, so only months times contributors meet.
    """
    got = incomes.where(F.col("status") == "received").groupBy("ym", "contributor_id").agg(total("amount").alias("amount"))
    whole = got.groupBy("ym").agg(total("amount").alias("whole"))
    spent = expenses.where(~is_cancelled(F.col("status"))).groupBy("ym").agg(*[total("amount", F.col("classification") == kind).alias(name) for name, kind in CLASSES.items()])
    months = spent.join(whole, "ym", "full")
    ids = contributors.agg(F.collect_set("id").alias("ids"))  # one row
    each = months.select("ym", "whole").crossJoin(ids).select("ym", "whole", F.explode("ids").alias("contributor_id")).join(got, ["ym", "contributor_id"], "left")
    zero = F.lit(0).cast("decimal(18,2)")
    row = F.struct("contributor_id", F.coalesce("amount", zero).alias("amount"), share(F.coalesce("amount", zero), F.coalesce("whole", zero), 2).alias("percentage"))
    people = each.groupBy("ym").agg(F.sort_array(F.collect_list(row)).alias("contributors"))
    plans = projects.agg(F.sort_array(F.collect_list(F.struct(*projects.columns))).alias("projects"))
    return months.join(people, "ym").crossJoin(plans).select("ym", "contributors", F.struct(*[F.coalesce(n, zero).alias(n) for n in CLASSES]).alias("classes"), "projects")


#: The lines of a printed report, with the amount that each shows; `-` lines are the classes of expenses.
PRINTED = [
    ("Totale Entrate: € ", "total_income"), ("Spese Pagate: € ", "paid_expenses"), ("Spese Pianificate Notificate: € ", "notified_planned"), ("Quote Risparmi: € ", "plan_quota"), ("Quote Progetti: € ", "project_quota"),
    ("Bilancio Prudenziale: € ", "prudential"), ("Extra Budget Iniziale: € ", "opening"), ("Extra Budget Utilizzato: € ", "used"), ("Extra Budget Finale: € ", "closing"), ("Deficit Non Coperto: € ", "deficit"),
]
PRINTED_CLASSES = [("- Necessarie: € ", "necessary"), ("- Volontarie: € ", "voluntary"), ("- Da Valutare: € ", "to_evaluate")]


def printed(reports: DataFrame) -> DataFrame:
    """The lines of each month's report: ym, line (from 1) and text. reports: ym, status, and amounts as PRINTED and PRINTED_CLASSES name them.

    A missing amount of a class or of the month is 0; an extra budget that isn't given (null) has no lines, and a deficit has one only where it is above 0.
    """
    value = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("decimal(18,2)").cast("string")
    shown = {"opening": F.col("opening").isNotNull(), "used": F.col("used").isNotNull(), "closing": F.col("closing").isNotNull(), "deficit": F.col("deficit") > 0}
    line = lambda text, name: F.when(shown.get(name, F.lit(True)), F.concat(F.lit(text), value(name)))
    head = [
        F.lit("GESTIONE CASA"), F.concat(F.lit("Report Mensile Economico - "), _name(F.col("ym")), F.lit(" "), _year(F.col("ym"))),
        F.concat(F.lit("Stato: "), F.when(F.col("status") == "final", "Definitivo").otherwise("Provvisorio")),
    ]
    lines = F.array(*head, *[line(*p) for p in PRINTED], F.lit("Classificazione Spese:"), *[line(*p) for p in PRINTED_CLASSES])
    return reports.select("ym", F.posexplode(F.filter(lines, lambda text: text.isNotNull())).alias("_n", "text")).select("ym", (F.col("_n") + 1).alias("line"), "text")


def closing_note(index: Column, single: Column, status: Column, now: str) -> tuple[Column, Column]:
    """Main and second line of the note on a month's closing."""
    due = index + 1
    on = F.concat(F.lit("il 1° "), F.lower(_name(due)), F.lit(" "), _year(due), F.lit(" alle 00:00."))
    is_open = (F.lit(now).cast("timestamp") < C.first_day(due).cast("timestamp")) | F.coalesce(status == "provisional", F.lit(False))
    main = F.when(single & ~is_open, CLOSED).otherwise(AUTOMATIC)
    second = F.when(~single, EACH_MONTH).when(is_open, F.concat(F.lit("Chiusura automatica prevista "), on)).otherwise(F.concat(F.lit("Chiuso "), on))
    return main, second


def subtitle(kind: Column, start: Column, end: Column) -> Column:
    """What a report covers, in words; start and end are month indexes, null where no month is chosen yet."""
    first, last = F.lower(_name(start)), F.lower(_name(end))
    span = F.concat(F.lit("Analisi economica dal 1° "), F.when(_year(start) == _year(end), first).otherwise(F.concat(first, F.lit(" "), _year(start))), F.lit(" al "), _last_day(end), F.lit(" "), last, F.lit(" "), _year(end), F.lit("."))
    return (
        F.when(end.isNull(), F.when(kind == "choose_period", "Seleziona il mese per generare il report.").otherwise(""))
        .when(kind.isin("current_month", "choose_period"), F.concat(F.lit("Analisi economica relativa a "), last, F.lit(" "), _year(end), F.lit(".")))
        .when(kind == "current_year", F.concat(F.lit("Analisi economica dell’anno "), _year(end), F.lit(".")))
        .otherwise(span)
    )


def title(kind: Column, start: Column, end: Column) -> Column:
    same_year = _year(start) == _year(end)
    names = F.concat(_name(start), F.when(same_year, "").otherwise(F.concat(F.lit(" "), _year(start))), F.lit("–"), _name(end), F.lit(" "), _year(end))
    single = F.concat(_name(end), F.lit(" "), _year(end))
    rest = F.when(kind == "current_year", F.concat(F.lit("Report Economico Annuale – "), _year(end))).otherwise(F.concat(F.lit("Report Economico – "), F.when(start == end, single).otherwise(names)))
    return F.when(end.isNull(), "Report Economico").otherwise(rest)


def print_period(start: Column, end: Column) -> Column:
    day = lambda d: F.date_format(d, "dd/MM/yyyy")
    return F.when(end.isNull(), "").otherwise(F.concat(F.lit("Periodo analizzato: "), day(C.first_day(start)), F.lit(" – "), day(F.last_day(C.first_day(end)))))


def provision_expenses(provisions: DataFrame) -> DataFrame:
    """Provisions (kind, description, amount, expense_date, status, ...) as explicit expenses: paid ones are paid on their date, all count as necessary and notified."""
    return provisions.select(
        "*", F.when(F.col("kind") == "project", PROJECT).otherwise(FIXED).alias("entry_mode"), F.when(F.col("status") == "paid", F.col("expense_date")).alias("payment_date"), F.month("expense_date").alias("competence_month"),
        F.year("expense_date").alias("competence_year"), F.lit("debitCard").alias("payment_method"), F.lit("necessary").alias("classification"), F.lit(True).alias("notified"), F.lit(False).alias("recurring"),
    )


def project_purchases(purchases: DataFrame, categories: DataFrame) -> DataFrame:
    """Purchases (project_id, amount, description, expense_date) as paid expenses under the category of code CAT_PROJECTS, else the first one, and its first subcategory, else itself.

    categories: id, parent_id, code, sort_order; few rows, reduced to one before they meet the purchases.
    """
    place = F.struct((F.coalesce("code", F.lit("")) != "CAT_PROJECTS").alias("other"), F.coalesce("sort_order", F.lit(0)).alias("o"), F.col("id").alias("id"))
    main = categories.where("parent_id is null").agg(F.min(place)["id"].alias("category_id"))
    sub = categories.where("parent_id is not null").groupBy(F.col("parent_id").alias("category_id")).agg(F.min(F.struct(F.coalesce("sort_order", F.lit(0)).alias("o"), "id"))["id"].alias("s"))
    under = main.join(sub, "category_id", "left").select("category_id", F.coalesce("s", "category_id").alias("subcategory_id"))
    made = provision_expenses(purchases.withColumns({"kind": F.lit("project"), "status": F.lit("paid"), "description": F.concat(F.lit("Acquisto Progetto: "), F.col("description"))}))
    return made.crossJoin(under)


def monthly_equivalent(expected: Column, frequency: Column) -> Column:
    return js_round(expected.cast("double") / C.frequency_months(frequency), 2)


def reserve_may_fund(kind: Column) -> Column:
    """The reserve covers deficits only: neither projects nor voluntary expenses draw on it."""
    return F.coalesce(~kind.isin("project", "voluntary"), F.lit(False))
