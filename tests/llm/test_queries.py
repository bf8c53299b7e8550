import duckdb
import pytest

from quillgraph.llm import entry
from tests.oracle import compare, connect

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    compare(entry.queries()[name](spark, D), connect(D), entry.oracle_sql()[name])


def test_pages_of_check_columns(spark):
    assert entry.queries()["op1_language_id"](spark, D).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert entry.queries()["op5_ann"](spark, D).columns == ["query_id", "rank", "vec_id", "score"]
    assert dict(entry.queries()["op5_ann"](spark, D).dtypes)["rank"] == "int"
    assert entry.queries()["op7_simhash"](spark, D).columns == ["doc_id", "fingerprint", "component_id"]
    assert all(len(r.fingerprint) == 16 for r in entry.queries()["op7_simhash"](spark, D).collect())


def test_names():
    assert duckdb and [n for i in range(1, 11) for n in entry.queries() if n.startswith(f"op{i}_")] == list(entry.queries())


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{D}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, D).cache()
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    packed = P.STAGES[-1][1](spark, docs, D)
    words = sum(len((r.text or "").split()) for r in docs.collect())
    assert packed.groupBy().sum("n_tokens").first()[0] == words
    assert P.run(spark, D).count() == packed.count()
    empty = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, D).count() == 0
