"""Months as one number (year * 12 + month), due dates, recurrence and reporting periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months between two occurrences of a frequency; any other frequency counts as monthly.
FREQUENCY_MONTHS = {"monthly": 1, "bimonthly": 2, "quarterly": 3, "fourMonthly": 4, "semiannual": 6, "annual": 12}
#: Short month names.
MONTHS_SHORT = ["Gen", "Feb", "Mar", "Apr", "Mag", "Giu", "Lug", "Ago", "Set", "Ott", "Nov", "Dic"]
#: Month names.
MONTHS_LONG = ["Gennaio", "Febbraio", "Marzo", "Aprile", "Maggio", "Giugno", "Luglio", "Agosto", "Settembre", "Ottobre", "Novembre", "Dicembre"]


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def index_of(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def year_of(index: Column) -> Column:
    return F.floor((index - 1) / 12).cast("int")


def month_of(index: Column) -> Column:
    return (F.pmod(index - 1, F.lit(12)) + 1).cast("int")


def first_day(index: Column) -> Column:
    return F.make_date(year_of(index), month_of(index), F.lit(1))


def due_date(index: Column, day: Column) -> Column:
    """The day of that month, the last one where the month is shorter; no day or 0 counts as 1."""
    first = first_day(index)
    return F.date_add(first, (F.least(F.coalesce(F.nullif(day, F.lit(0)), F.lit(1)), F.day(F.last_day(first))) - 1).cast("int"))


def frequency_months(frequency: Column) -> Column:
    out = F.lit(1)
    for name, months in FREQUENCY_MONTHS.items():
        out = F.when(frequency == name, months).otherwise(out)
    return out


def closing_date(year: Column, month: Column) -> Column:
    """A month closes at the first instant of the next."""
    return F.add_months(F.make_date(year, month, F.lit(1)), 1)


def last_month_index(start: Column, duration: Column) -> Column:
    """Index of the last month of a recurrence that starts in a month and lasts so many months."""
    return start + duration - 1


def month_label(index: Column, with_year: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, MONTHS_SHORT)), month_of(index))
    return F.when(with_year, F.concat(name, F.lit(" '"), F.lpad(F.pmod(year_of(index), F.lit(100)).cast("string"), 2, "0"))).otherwise(name)


def duration_error(duration: Column) -> Column:
    """First fault of a recurrence's duration in months as a message, else null."""
    return (
        F.when(duration.isNull(), "Indica la durata della spesa ricorrente.")
        .when(duration != F.floor(duration), "La durata deve essere espressa con un numero intero di mesi.")
        .when(duration <= 0, "La durata deve essere maggiore di 0 mesi.")
    )


def due_day_error(day: Column, index: Column) -> Column:
    """First fault of a due day in that month as a message, else null."""
    days, month = F.day(F.last_day(first_day(index))), month_of(index)
    name = F.element_at(F.array(*map(F.lit, MONTHS_LONG)), month)
    named = F.when(month == 2, F.concat_ws(" ", name, year_of(index).cast("string"))).otherwise(name)
    return (
        F.when(day.isNull(), "Indica il giorno di scadenza.")
        .when(day != F.floor(day), "Il giorno di scadenza deve essere un numero intero.")
        .when(day <= 0, "Il giorno di scadenza deve essere maggiore di 0.")
        .when(day > days, F.concat(named, F.lit(" contiene "), days.cast("string"), F.lit(" giorni. Inserisci un valore compreso tra 1 e "), days.cast("string"), F.lit(".")))
    )


def recurrence_text(start: Column, duration: Column) -> Column:
    """What a recurrence will count for, in words."""

    def named(index: Column) -> Column:
        return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS_LONG)), month_of(index)), year_of(index).cast("string"))

    unit = F.when(duration == 1, "mese").otherwise("mesi")
    return F.concat(F.lit("Questa spesa verrà conteggiata per "), duration.cast("string"), F.lit(" "), unit, F.lit(", da "), named(start), F.lit(" a "), named(last_month_index(start, duration)), F.lit("."))


#: How many months before the current one a reporting period begins.
PERIOD_BACK = {"current_month": 0, "last_two_months": 1, "last_three_months": 2, "last_four_months": 3, "last_six_months": 5}


def period_range(kind: str, year: int, month: int, chosen: int | None = None) -> tuple[int, int, int, int] | None:
    """(start year, start month, end year, end month) of a reporting period seen from a month; None for a chosen month that is none. Unknown kinds mean the current month."""
    if kind == "current_year":
        return year, 1, year, 12
    if kind == "choose_period":
        return (year, chosen, year, chosen) if chosen and 1 <= chosen <= 12 else None
    start_year, start = divmod(year * 12 + month - 1 - PERIOD_BACK.get(kind, 0), 12)
    return start_year, start + 1, year, month
