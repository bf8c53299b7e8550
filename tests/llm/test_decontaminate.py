import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate as D


@given(st.lists(st.lists(st.integers(1, 4), max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_index_finds_all_places(pieces, patterns):
    text = np.array([x for p in pieces for x in [*p, 0]], np.int64)
    index = D.FMIndex(text, 4)
    lengths = np.array([len(p) for p in patterns])
    low, high = index.search(np.array([x for p in patterns for x in p]), np.cumsum(lengths) - lengths, lengths)
    for p, lo, hi in zip(patterns, low.tolist(), high.tolist()):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def plain(text, items, window=13):
    words = D.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        w = D.words_of(item)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            win = w[i : i + window]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    names.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(names)


def test_words():
    assert D.words_of("Don't STOP, Ünder 3x!") == [b"don", b"t", b"stop", "Ünder".encode(), b"3x"]
    assert D.words_of(None) == D.words_of("") == D.words_of("..!") == []


def test_against_plain_search(docs, spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "dd", "é"]
    speak = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(10, speak(20)), (9, speak(13)), (100, speak(3)), (None, "zz yy"), (5, None), (6, ""), (7, "a b"), (8, "a b")]
    texts = [speak(rng.randint(0, 60)) for _ in range(60)] + [items[0][1] + " " + speak(30), None, "", "zz. YY", speak(40_000), items[1][1], items[1][1]]
    rows = docs(list(enumerate(texts))).withColumn("spans", F.lit(1)).withColumn("items", F.lit("x")).withColumn("id", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(3))
    for block in (D.BLOCK_BYTES, 60):  # one pass, and one for each item
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.matches(rows, bench, block_bytes=block).withColumn("n_hit", D.hit_words("spans")).collect()}
        assert got == {i: plain(t, items) for i, t in enumerate(texts)}


def test_rules(docs, spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(57))
    rows = [(1, "one two three " + filler), (2, "one two three more " + filler), (3, filler), (4, None), (5, ""), (3, filler)]
    kept = D.keep_clean(docs(rows).withColumn("n_words", F.lit("x")), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 3, 4, 5] and "n_words" in kept.columns
    empty = bench.limit(0)
    assert D.keep_clean(docs(rows), empty).count() == len(rows) and D.matches(docs([]), bench).count() == 0
    found = D.matches(docs(rows[:1]), bench).select(D.items_digest("items")).first()[0]
    assert found == hashlib.sha256(b"1").hexdigest()
    assert D.matches(docs(rows[2:3]), bench).select(D.items_digest("items")).first()[0] == hashlib.sha256(b"").hexdigest()


def test_blocks_of_patterns_go_one_after_the_other(docs, spark, capsys):
    bench = spark.createDataFrame([(i, f"q{i} " * 14) for i in range(6)], "item_id long, text string")
    rows = docs([(i, f"x q{i} " + f"q{i} " * 13 + "y") for i in range(6)])
    found = D.matches(rows, bench, block_bytes=150)
    found.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1  # earlier passes are written tables
    assert [(r.doc_id, r["items"]) for r in found.orderBy("doc_id").collect()] == [(i, [str(i)]) for i in range(6)]


def test_patterns_stay_small():
    import pickle

    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(20_000)}" for _ in range(200_000))
    held = len(pickle.dumps(D.Patterns([(i, text[i * 10_000 : (i + 1) * 10_000]) for i in range(100)])))
    assert held < 8 * len(text[:1_000_000])
