"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Empty strings count as absent, as null does."""
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cs])


def norm_ws(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def bare_id(c: Column) -> Column:
    """What follows the last ``#`` of a reference; blank is absent."""
    return blank_to_null(F.substring_index(F.trim(c), "#", -1))


def date_precision(c: Column) -> Column:
    """Day, month or year by length."""
    n = F.length(F.trim(c))
    return F.when(n == 10, "day").when(n == 7, "month").when(n == 4, "year")


def classify_ref(c: Column) -> Column:
    """P5: an authority URL as struct (gnd, wikidata, other); what is no URL is dropped."""
    url, none = F.trim(c), F.lit(None).cast("string")
    is_gnd, is_wd = F.contains(url, F.lit("d-nb.info/gnd")), F.contains(url, F.lit("wikidata.org"))
    is_url = url.startswith("http://") | url.startswith("https://")
    return F.struct(F.when(is_gnd, url).alias("gnd"), F.when(~is_gnd & is_wd, url).alias("wikidata"), F.when(~is_gnd & ~is_wd & is_url, url).otherwise(none).alias("other"))


def valid_url(c: Column) -> Column:
    """The value if it begins like a web address."""
    return F.when(c.startswith("http://") | c.startswith("https://"), c)


def last_status(statuses: Column) -> Column:
    """The last change's status; draft if there is none."""
    return F.coalesce(blank_to_null(F.try_element_at(statuses, F.lit(-1))), F.lit("draft"))


def flatten_idno(idno: Column) -> Column:
    """``type:value`` of identifiers that have both."""
    good = F.filter(idno, lambda x: (F.coalesce(x["type"], F.lit("")) != "") & (F.coalesce(x["value"], F.lit("")) != ""))
    return F.transform(good, lambda x: F.concat(x["type"], F.lit(":"), x["value"]))


def effective(sent: Column, received: Column) -> Column:
    """The sender's value, else the recipient's."""
    return first_filled(sent, received)


def label_for_id(c: Column, corpus: str) -> Column:
    """Node label by id prefix; an unknown prefix is an error."""
    # What follows the corpus name in ids of each kind.
    kinds = {"letter": "Letter", "correspondent": "Person", "place": "Place", "literature": "Work", "witness": "Witness"}
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, name in kinds.items():
        label = label.when(c.startswith(f"{corpus}-{prefix}-"), name)
    return label.otherwise(F.raise_error(F.concat(F.lit("unknown id: "), F.coalesce(c, F.lit("null")))).cast("string"))


def year_of(date: Column) -> Column:
    """The year of a date that begins with four digits."""
    return F.when(date.rlike(r"\A[0-9]{4}"), F.substring(date, 1, 4).try_cast("int"))


def display_label(incipit: Column, letter_id: Column, date: Column) -> Column:
    """The first forty characters, else id and date."""
    return F.when(blank_to_null(incipit).isNotNull(), F.concat(F.substring(incipit, 1, 40), F.lit("..."))).otherwise(F.concat(letter_id, F.lit(" ("), F.coalesce(blank_to_null(date), F.lit("?")), F.lit(")")))


def normalize_letter_id(c: Column, corpus: str) -> Column:
    """The first run of digits, at least four places, behind the corpus's letter prefix."""
    digits = F.regexp_extract(c, r"([0-9]+)", 1)
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.when(digits != "", F.concat(F.lit(f"{corpus}-letter-"), padded))


def day_diff(a: Column, b: Column) -> Column:
    """P25: days between dates of day precision; null if either isn't one."""
    day = lambda c: F.when(F.substring(c, 1, 10).rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    return F.abs(F.date_diff(day(a), day(b)))


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a); null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.array_sort(F.array(a, b)))


# Characters that linking ignores.
IGNORED = "“”„‚’‘'`´\"()[]{}<>"


def linker_text(c: Column) -> Column:
    """Lower case, single spaces, without quotes and brackets."""
    return F.translate(norm_ws(F.lower(c)), IGNORED, "")


def context_window(text: Column, start: Column, end: Column, width: int = 60) -> Column:
    """A span in square brackets between the characters around it (offsets from 0)."""
    low = F.greatest(start - width, F.lit(0))
    return F.concat(F.substring(text, low + 1, start - low), F.lit("["), F.substring(text, start + 1, end - start), F.lit("]"), F.substring(text, end + 1, F.lit(width)))


def strip_tags(c: Column) -> Column:
    """Text between tags."""
    return F.regexp_replace(c, "<[^>]+>", "")


def dehyphenate(c: Column) -> Column:
    """Words that a line break divides are joined; other line breaks become spaces; paragraphs stay."""
    joined = F.regexp_replace(c, r"([a-zA-ZäöüÄÖÜß])[ \t]*[-=][ \t]*\n(?!\n)[ \t]*", "$1")
    paragraphs = F.transform(F.split(joined, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(F.trim(p), r"\s*\n\s*", " ")))
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def rdf_date_type(date: Column) -> Column:
    """XSD type of a partial date."""
    p = date_precision(date)
    return F.when(p == "day", "xsd:date").when(p == "month", "xsd:gYearMonth").when(p == "year", "xsd:gYear")


def entity_uri(base: str, kind: Column, entity_id: Column) -> Column:
    """P36."""
    return F.concat(F.lit(base), kind, F.lit("/"), entity_id)


def expected_change(status: Column, source: Column) -> Column:
    """The register status that a letter calls for: its tier by the last status, its text by the kind of source.

    ``source`` is ``original``, ``print`` or null where the letter has no text.
    """
    tier = F.when(status == "published", "online").otherwise("preview")
    text = F.when(source == "original", "transcription").otherwise("print")
    return F.when(source.isNull(), "in_register").otherwise(F.concat(tier, F.lit("_"), text))


def join_filled(sep: str, *cs: Column) -> Column:
    """The parts that are neither null nor empty."""
    return F.concat_ws(sep, *[blank_to_null(c) for c in cs])


def snippet(text: Column, width: int = 400) -> Column:
    """Cut at a word's end, with an ellipsis, if longer than ``width``."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, width), r"\s+\S*\z", ""), F.lit("…")))


def flip_author(c: Column) -> Column:
    """``Last, First`` becomes ``First Last``."""
    return F.when(F.contains(c, F.lit(",")), F.trim(F.concat(F.trim(F.substring_index(c, ",", -1)), F.lit(" "), F.trim(F.substring_index(c, ",", 1))))).otherwise(c)


def is_coordinates(c: Column) -> Column:
    """Two decimal numbers with a comma between them."""
    return c.rlike(r"\A\s*-?[0-9]+(\.[0-9]+)?\s*,\s*-?[0-9]+(\.[0-9]+)?\s*\z")


def marker_radius(n: Column) -> Column:
    """A map marker's size, which stops growing at thirty."""
    return F.lit(5.0) + F.least(n, F.lit(30)) * 0.5


def area_radius(n: Column, largest: Column) -> Column:
    """A marker whose area follows the count."""
    return F.lit(4.0) + F.lit(16.0) * F.sqrt(n / largest)


def citations(c: Column, corpus: str) -> Column:
    """Ids of letters that a text names."""
    return F.regexp_extract_all(c, F.lit(rf"({corpus}-letter-[0-9]+)"), F.lit(1))


def zero_padded(prefix: str, n: Column, width: int = 4) -> Column:
    """An id from a position."""
    digits = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def last_name(c: Column, least: int = 3) -> Column:
    """The last word of a name without its abbreviations, if long enough."""
    words = F.filter(F.split(norm_ws(F.regexp_replace(c, r"\b\w{1,4}\.", "")), " "), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    return F.when(F.length(last) >= least, last)


def url_quoted(c: Column) -> Column:
    """Percent-encoded, slashes kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def split_camel(c: Column) -> Column:
    """A space between a lower-case and an upper-case letter; a hyphen at the end goes."""
    return F.regexp_replace(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"-\s*\z", "")


def named_ids(c: Column) -> Column:
    """Ids in brackets from ``name (id) | name (id, id)``; ``(none)`` is absent, the first id counts."""
    parts = F.transform(F.split(c, r"\|"), lambda p: F.trim(F.regexp_extract(p, r"\(([^(),]+)[^()]*\)\s*\z", 1)))
    return F.filter(parts, lambda p: (p != "") & (p != "none"))


def citation(authors: Column, title: Column) -> Column:
    """``authors: title.`` with one final dot."""
    line = F.concat_ws(": ", blank_to_null(F.array_join(authors, "; ")), blank_to_null(title))
    return F.when(line.endswith("."), line).otherwise(F.concat(line, F.lit(".")))


def person_kind(kind: Column, corporate: Column) -> Column:
    """What to call an entry of the persons' register."""
    return F.when(F.coalesce(corporate, F.lit(False)), "corporate body").when(kind == "personGrp", "group").otherwise("person")


def context_block(*fields: Column, text: Column, limit: int = 2500) -> Column:
    """Header fields and the beginning of a text."""
    return F.concat_ws("\n", *[blank_to_null(f) for f in fields], F.substring(text, 1, limit))


def cypher_literal(c: Column, kind: str = "string") -> Column:
    """K4: a value as it stands in a graph query: quoted text, or a bare number or truth value."""
    if kind != "string":
        return c.cast("string")
    escaped = reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), [("\\", "\\\\"), ("'", "\\'")], c)
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def cypher_list(c: Column) -> Column:
    """K4: an array of text."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: cypher_literal(x)), ", "), F.lit("]"))


def occurrences(text: Column, needle: Column) -> Column:
    """Offsets of the places, none overlapping, where a text has another; one pass over the pieces between them."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    none = F.expr("cast(array() as array<int>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + F.length(needle)).alias("at"), F.array_append(a["found"], a["at"] + F.length(p)).alias("found"))
    return F.coalesce(F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda a: a["found"]), none)
