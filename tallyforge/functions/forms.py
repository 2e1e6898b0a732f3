"""Checks of form fields: each gives the first fault as a message, null for a valid entry. A table's validators are such columns; `rejected` splits rows by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.calendar import due_day_error, duration_error
from tallyforge.functions.money import js_round


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def contributor_error(name: Column, email: Column) -> Column:
    n, e = F.regexp_replace(_text(name), r"\s+", " "), _text(email)
    return (
        F.when(n == "", "Indica il nome del contributore.").when(~n.rlike(r"^\p{L}+( \p{L}+)*$"), "Il nome può contenere soltanto lettere e spazi.")
        .when((e != "") & ~e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), F.concat(F.lit("Indirizzo e-mail non valido per "), n))
    )


def postal_code_error(code: Column) -> Column:
    c = _text(code)
    return F.when((c != "") & ~c.rlike(r"^[0-9]{5}$"), "Il CAP deve contenere esattamente 5 cifre.")


def goal_error(entry: Column) -> Column:
    """An amount with a comma or a point: positive, two decimals at most."""
    t = F.regexp_replace(_text(entry), "^([^,]*),", "$1.")
    value = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))
    decimals = F.length(F.regexp_extract(t, r"\.(.*)$", 1))
    return (
        F.when(t == "", "L'importo dell'obiettivo è obbligatorio.").when(value.isNull() | (value <= 0) | (value == float("inf")), "Inserisci un importo valido maggiore di zero.")
        .when(decimals > 2, "L'importo non può avere più di due cifre decimali.")
    )


def goal_value(entry: Column) -> Column:
    """The amount of a valid entry, else null."""
    return F.when(goal_error(entry).isNull(), js_round(F.regexp_replace(_text(entry), ",", ".").try_cast("double"), 2))


def fixed_expense_error(name: Column, amount: Column, duration: Column, due_day: Column, index: Column, category: Column) -> Column:
    return F.coalesce(
        F.when(_text(name) == "", "Il nome della spesa fissa è obbligatorio").when(F.coalesce(amount, F.lit(0)) <= 0, "L'importo previsto deve essere maggiore di zero"),
        duration_error(duration), due_day_error(due_day, index), F.when(_text(category) == "", "Seleziona una categoria valida"),
    )


def request_error(request_id: Column, exists: Column, metadata: Column) -> Column:
    """Faults of a new contact request; exists: whether the id is stored; metadata: JSON text."""
    return (
        F.when(_text(request_id) == "", "L'ID della richiesta di contatto è obbligatorio e non può essere vuoto")
        .when(exists, F.concat(F.lit('Richiesta di contatto con ID "'), request_id, F.lit('" già esistente')))
        .when(~F.coalesce(F.trim(metadata).startswith("{"), F.lit(False)), "I metadata della richiesta sono obbligatori e devono essere un oggetto")
    )


def request_update(now: str) -> dict[str, Column]:
    """Columns of an updated contact request: pending unless another state is given, and never changed before it was created."""
    at = F.lit(now).cast("timestamp")
    return {"sync_status": F.coalesce(F.nullif(F.col("sync_status"), F.lit("")), F.lit("pending")), "updated_at": F.coalesce("updated_at", F.greatest(at, F.col("created_at"))), "schema_version": F.lit(1)}


def rejected(df: DataFrame, *faults: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows with `fault`) by the first fault of any number of validators."""
    marked = df.withColumn("fault", F.coalesce(*faults, F.lit(None).cast("string")))
    return marked.where("fault is null").drop("fault"), marked.where("fault is not null")


def competence(date: Column, now: str) -> Column:
    """Month index that a date text counts for: its own first two parts, else what it is as a date, else the current month."""
    parts = F.split(F.get(F.split(date, "T"), 0), "-")
    number = lambda i: F.regexp_extract(F.get(parts, i), r"^\s*([+-]?[0-9]+)", 1).try_cast("int")
    index = lambda d: F.year(d) * 12 + F.month(d)
    return F.coalesce(F.when((F.size(parts) >= 2) & number(1).between(1, 12), number(0) * 12 + number(1)), index(date.try_cast("timestamp")), index(F.lit(now).cast("date")))


def file_size(n: Column) -> Column:
    in_unit = lambda unit, name: F.concat(F.translate(F.format_number(n / unit, 1), ",", ""), F.lit(name))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, in_unit(1024, " KB")).otherwise(in_unit(1024 * 1024, " MB"))


def shown_date(text: Column) -> Column:
    """`2024-03-05` as `05/03/2024`; text without three parts as it is, none as empty text."""
    part = lambda i: F.coalesce(F.get(F.split(text, "-"), i), F.lit(""))
    whole = (part(0) != "") & (part(1) != "") & (part(2) != "")
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(whole, F.concat_ws("/", part(2), part(1), part(0))).otherwise(text)
