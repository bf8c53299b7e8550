"""The whole pipeline over a small corpus, against what plain code says of each document."""

import random

import pytest

import corpus_pipeline as P
from quillgraph.llm import packing

SYLLABLES = {"aa": ["ka", "lo", "mi", "ru", "te"], "bb": ["sch", "ein", "ung", "ber", "ach"], "cc": ["eau", "oir", "ill", "que", "ent"]}


def speak(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(77)
    rows, want = [], {}

    def add(i, words, lang, kept):
        rows.append((i, " ".join(words), lang, "s", len(" ".join(words))))
        if kept is not None:
            want[i] = kept

    items = [speak(rng, "aa", 30) for _ in range(3)]
    passage = speak(rng, "bb", 70)
    bases = {}
    for i in range(120):  # clean documents stay as they are
        lang = ["aa", "bb", "cc"][i % 3]
        bases[i] = speak(rng, lang, rng.randint(60, 250))
        add(i, bases[i], lang, bases[i])
    for i in range(200, 210):  # copies go, whatever the case of their letters
        add(i, [w.upper() for w in bases[i - 200]], None, None)
    for i in range(220, 230):  # near copies go
        words = list(bases[i - 200])
        words[len(words) // 2] = "verschieden"
        add(i, words, None, None)
    add(300, [*speak(rng, "bb", 80), *passage, *speak(rng, "bb", 80)], "bb", "same")
    for i in (301, 302):  # a passage of another document is cut out
        before, after = speak(rng, "bb", 90), speak(rng, "bb", 60)
        add(i, [*before, *passage, *after], "bb", [*before, *after])
    for i in (310, 311):  # benchmark text: much of one document, little of the other
        body = speak(rng, "aa", 40 if i == 310 else 900)
        add(i, [*body[:20], *items[i - 310], *body[20:]], "aa", None if i == 310 else [*body[:20], *items[1], *body[20:]])
    for i, text in ((400, None), (401, ""), (402, "12 34 !!"), (403, "   ")):  # no language
        rows.append((i, text, "aa", "s", None))
    want[300] = rows[[r[0] for r in rows].index(300)][1].split()
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), want


def test_documents_that_are_kept(spark, corpus):
    folder, want = corpus
    docs, plan = P.run_all(spark, folder)
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: r.text.split() for i, r in got.items()} == want
    assert all(r.lang == ("bb" if i >= 300 and i < 310 else "aa" if i >= 310 else ["aa", "bb", "cc"][i % 3]) for i, r in got.items())
    # the plan has every token of these once, and they can be fetched by it
    rows = plan.collect()
    assert sum(r.n_tokens for r in rows) == sum(map(len, want.values())) and {r.doc_id for r in rows} == set(want)
    found = packing.sequences(docs, plan).collect()
    assert sorted(w for r in found for w in r.text.split()) == sorted(w for x in want.values() for w in x)
    assert all(len(r.text.split()) == r.used <= r.capacity for r in found)


def test_run_gives_the_plan(spark, corpus):
    folder, want = corpus
    rows = P.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(want) and rows[0].capacity in packing.LENGTHS


def test_workers_give_memory_back_after_a_stage(monkeypatch):
    import ctypes

    import pyarrow as pa

    from quillgraph.llm import common

    trims = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(trims.append)}))
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    rows = common.freeing(lambda given: (b for b in given))(iter(batches))
    assert ctypes is common.ctypes and next(rows).equals(batches[0]) and not trims
    assert [b.column(0)[0].as_py() for b in rows] == [1, 2] and trims == [0]
