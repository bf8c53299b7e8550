"""German dates in running text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of months in German letters, and their numbers.
MONTHS = {
    "januar": "01", "jänner": "01", "jener": "01",
    "februar": "02", "horn": "02", "hornung": "02", "hornungs": "02",
    "märz": "03", "mrz": "03", "april": "04", "mai": "05", "may": "05",
    "juni": "06", "juny": "06", "jun": "06", "juli": "07", "july": "07", "jul": "07",
    "august": "08", "aug": "08", "september": "09", "sept": "09",
    "weinmond": "10", "oktober": "10", "october": "10", "oct": "10",
    "november": "11", "nov": "11",
    "dezember": "12", "december": "12", "dec": "12", "christmond": "12", "xber": "12", "xbers": "12",
}

_NAMES = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
FULL_DATE = rf"(?iu)(?<![0-9])([0-9]{{1,2}})\.?\s+({_NAMES})\.?(?![\p{{L}}])\s*([0-9]{{4}})"
MONTH_YEAR = rf"(?iu)(?<![\p{{L}}])({_NAMES})\.?(?![\p{{L}}])\s*([0-9]{{4}})"


def month_number(name: Column) -> Column:
    """The month's number by its whole name; null if it is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv]), F.lower(name))


def german_date(text: Column) -> Column:
    """The first full date as yyyy-MM-dd, else the first month and year as yyyy-MM-; null if there is neither."""
    day, month, year = (F.regexp_extract(text, FULL_DATE, i) for i in (1, 2, 3))
    full = F.concat(year, F.lit("-"), month_number(month), F.lit("-"), F.lpad(day, 2, "0"))
    m, y = (F.regexp_extract(text, MONTH_YEAR, i) for i in (1, 2))
    return F.when(day != "", full).when(m != "", F.concat(y, F.lit("-"), month_number(m), F.lit("-")))


def dateline(text: Column) -> Column:
    """A date line as ``12. 5. 23`` or ``12.5.1823``: cleaned of marks; two digits are a year of the 1800s."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[\[\]()?]", ""), r"\s+", "")
    day, month, year = (F.regexp_extract(clean, r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})(?![0-9])", i) for i in (1, 2, 3))
    whole = F.when(F.length(year) == 2, F.concat(F.lit("18"), year)).otherwise(year)
    return F.date_format(F.try_to_date(F.concat(whole, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")
