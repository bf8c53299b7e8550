import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillgraph.functions import dates as D
from quillgraph.functions import scalars as S
from quillgraph.functions import similarity as M
from quillgraph.functions import vectors as V


@pytest.fixture
def of(spark):
    """The value of an expression over one row of text columns a, b."""

    def value(expr, a=None, b=None):
        return spark.createDataFrame([(a, b)], "a string, b string").select(expr.alias("v")).first().v

    return value


@pytest.fixture(autouse=True, scope="module")
def _columns(spark):
    globals().update(A=F.col("a"), B=F.col("b"))


@pytest.mark.parametrize("given, want", [("band7/namen.xml#q9", "q9"), ("q9", "q9"), ("", None), (None, None), (" # ", None), ("a#b#c ", "c")])
def test_bare_id(of, given, want):
    assert of(S.bare_id(A), given) == want


@pytest.mark.parametrize("given, want", [("1777-11-30", "day"), (" 1777-11 ", "month"), ("1777", "year"), (None, None), ("17", None)])
def test_precision(of, given, want):
    assert of(S.date_precision(A), given) == want


def test_dates(of):
    assert of(S.effective(A, B), "", "r") == "r" and of(S.effective(A, B), "s", "r") == "s" and of(S.effective(A, B)) is None
    assert [of(S.rdf_date_type(A), d) for d in ("1825-01-01", "1825-01", "1825", "x")] == ["xsd:date", "xsd:gYearMonth", "xsd:gYear", None]
    assert of(S.day_diff(A, B), "1777-02-20", "1777-03-02T08") == 10 and of(S.day_diff(A, B), "1777-02", "1777-02-11") is None
    assert of(S.day_diff(A, B), "1777-02-30", "1777-02-11") is None
    assert [of(S.year_of(A), d) for d in ("1825-01", "ca. 1825", "182", None)] == [1825, None, None, None]
    assert of(D.german_date(A), "Ort, den 16. Hornungs 1821") == "1821-02-16"
    assert of(D.german_date(A), "im Februar 1821 oder 1822") == "1821-02-" and of(D.german_date(A), "1. Foobar 1821") is None
    assert of(D.dateline(A), "[12. 5. 23]") == "1823-05-12" and of(D.dateline(A), "12.13.1823") is None


def test_literals(of):
    assert of(S.cypher_literal(A), "d'Arc") == "'d\\'Arc'" and of(S.cypher_literal(A), "x\\y") == "'x\\\\y'"
    assert of(S.cypher_literal(F.lit(True), "bool")) == "true" and of(S.cypher_literal(F.lit(42), "number")) == "42"
    assert of(S.cypher_list(F.array(F.lit("a"), F.lit("b'")))) == "['a', 'b\\'']"


def test_labels(of):
    assert [of(S.label_for_id(A, "ed"), f"ed-{k}-0001") for k in ("letter", "correspondent", "place", "literature", "witness")] == ["Letter", "Person", "Place", "Work", "Witness"]
    with pytest.raises(PySparkException):
        of(S.label_for_id(A, "ed"), "other-1")
    assert of(S.normalize_letter_id(A, "ed"), "Letter 12") == "ed-letter-0012" and of(S.normalize_letter_id(A, "ed"), "12345") == "ed-letter-12345"
    assert of(S.display_label(A, B, F.lit(None).cast("string")), None, "x") == "x (?)" and of(S.display_label(A, B, B), "t" * 50, "x") == "t" * 40 + "..."


def test_urls(of):
    assert of(S.classify_ref(A), "https://d-nb.info/gnd/1").gnd and of(S.classify_ref(A), "https://www.wikidata.org/Q1").wikidata
    assert of(S.classify_ref(A), "http://x").other == "http://x" and of(S.classify_ref(A), "-").asDict() == {"gnd": None, "wikidata": None, "other": None}
    assert of(S.valid_url(A), "done") is None and of(S.url_quoted(A), "a b/ü+") == "a%20b/%C3%BC%2B"


def test_texts(of):
    assert of(S.norm_ws(A), " a \n\t b ") == "a b" and of(S.norm_ws(A)) == ""
    assert of(S.linker_text(A), " „Anna”  (von) X") == "anna von x"
    assert of(S.context_window(A, F.lit(2), F.lit(4), 1), "abcdef") == "b[cd]e"
    assert of(S.dehyphenate(A), "Hand-\nschrift ist\nda\n\nNeuer Absatz") == "Handschrift ist da\n\nNeuer Absatz"
    assert of(S.occurrences(A, B), "abcabcab", "ab") == [0, 3, 6] and of(S.occurrences(A, B), "aaa", "aa") == [0] and of(S.occurrences(A, B), "x", "y") == []
    assert of(S.snippet(A, 10), "one two three four") == "one two…" and of(S.snippet(A, 10), "short") == "short"
    assert of(S.flip_author(A), "Goethe, Johann") == "Johann Goethe" and of(S.flip_author(A), "Anonymus") == "Anonymus"
    assert of(S.named_ids(A), "Anna (p1) | Bea (p2, p3) | ? (none)") == ["p1", "p2"]
    assert of(S.citation(F.array(A), B), "A", "T") == "A: T." and of(S.citation(F.array(A), B), "A", "T.") == "A: T."
    assert of(S.split_camel(A), "HansMüller-") == "Hans Müller" and of(S.last_name(A), "Frhr. v. Berg") == "Berg"
    assert of(S.flatten_idno(F.expr("array(named_struct('type', 'a', 'value', '1'), named_struct('type', '', 'value', '2'))"))) == ["a:1"]
    assert of(S.strip_tags(A), "<a>x</a>y") == "xy" and of(S.is_coordinates(A), " 47.5, -9.2") and not of(S.is_coordinates(A), "47.5")
    assert of(S.citations(A, "ed"), "see ed-letter-0001 and ed-letter-22") == ["ed-letter-0001", "ed-letter-22"]


def test_status(of):
    assert of(S.last_status(F.array(F.lit("done"), A)), "reviewed") == "reviewed" and of(S.last_status(F.expr("cast(array() as array<string>)"))) == "draft"
    assert of(S.expected_change(A, B), "published", "original") == "online_transcription" and of(S.expected_change(A, B), "done", "print") == "preview_print"
    assert of(S.expected_change(A, B), "published") == "in_register"


def test_similarity(spark):
    assert M.common_length("abcbdab", "bdcaba") == 4
    assert M.token_set_ratio("anna von berg", "berg anna") == 100.0 and M.token_set_ratio("", "x") == 0.0
    assert abs(M.indel_ratio("abcd", "abxd") - 75.0) < 1e-9
    got = spark.createDataFrame([("a b", "b a"), (None, "x")], "a string, b string").select(M.token_set_similarity("a", "b").alias("v")).collect()
    assert [r.v for r in got] == [100.0, 0.0]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0, 7.0]), (2, [0.0, 0.0, 7.0]), (3, [1.5, 2.0, 7.0])], "id int, v array<double>")
    assert rows.select(V.unit(F.col("v")).alias("u")).first().u[0] == 3.0 / 74**0.5
    q = {r.id: list(r.q) for r in V.quantize(rows, "v").collect()}
    assert q == {1: [127, 127, -128], 2: [-128, -128, -128], 3: [0, 0, -128]}  # -0.5 rounds half to even; a constant component has range one
