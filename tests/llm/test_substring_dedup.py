import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.llm import substring_dedup as D


def prose(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def covered(rows, doc):
    return {i for r in rows if r.doc == doc for i in range(r.first, r.end)}


def test_word_hashes_split_like_words():
    texts = pa.array(["a  B\tc", None, "", "  x\n", "b"])
    h, owner = D.word_hashes(texts)
    assert owner.tolist() == [0, 0, 0, 3, 4] and h[1] == h[4] and len(set(h.tolist())) == 4
    sliced, owner = D.word_hashes(texts.slice(3))
    assert sliced.tolist() == h[3:].tolist() and owner.tolist() == [0, 1]


def test_every_shared_run_has_a_seed():
    rng = random.Random(5)
    for _ in range(50):
        run = prose(rng, 12)
        a, b = [" ".join([*prose(rng, rng.randint(0, 30)), *run, *prose(rng, rng.randint(0, 30))]) for _ in range(2)]
        h, owner = D.word_hashes(pa.array([a, b]))
        at, seed = D.seeds(h, owner)
        assert set(seed[owner[at] == 0].tolist()) & set(seed[owner[at] == 1].tolist())


def test_chain_is_best():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(1, 7)
        runs = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(n)})
        p, q = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
        a, b, m = D.diagonal_runs(p, q)
        items = list(zip(a.tolist(), b.tolist(), m.tolist()))

        def worth(chain):
            gaps = sum(y[0] - x[0] - x[2] + y[1] - x[1] - x[2] for x, y in zip(chain, chain[1:]))
            return sum(D.SEED_WORTH + x[2] for x in chain) - D.GAP_COST * gaps

        def ordered(chain):
            return all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(chain, chain[1:]))

        best = max(worth(c) for k in range(1 << len(items)) if k and ordered(c := sorted(x for i, x in enumerate(items) if k >> i & 1)))
        least, D.MIN_SPAN = D.MIN_SPAN, 0
        try:
            got = D.chains(p, q)
        finally:
            D.MIN_SPAN = least
        assert abs(max(worth(c) for c in got) - best) < 1e-9 and all(ordered(c) for c in got)
        assert sum(map(len, got)) == len(items)


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(40):
        a, b = [np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 12))]) for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = D.common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)


def test_exact_and_fuzzy_passages(docs):
    rng = random.Random(11)
    passage = prose(rng, 60)
    fuzzy = [w if i % 12 else "changed" + str(i) for i, w in enumerate(passage)]
    rows = [(i, " ".join([*prose(rng, 40), *body, *prose(rng, 40)])) for i, body in ((1, passage), (2, prose(rng, 60)), (3, passage), (4, fuzzy), (5, passage[:30]))]
    got = D.repeats(docs(rows).repartition(3)).collect()
    assert {r.doc for r in got} == {3, 4} and {r.of for r in got} == {1}
    exact = next(r for r in got if r.doc == 3)
    assert (exact.first, exact.end, exact.of_first, exact.similarity) == (40, 100, 40, 1.0)
    near = next(r for r in got if r.doc == 4)
    assert 40 <= near.first <= 42 and 98 <= near.end <= 100 and 0.8 <= near.similarity < 1
    kept = {r.doc_id: r for r in D.remove_repeats(docs(rows)).collect()}
    assert len(kept[3].text.split()) == 80 and kept[3].n_chars == len(kept[3].text)
    assert kept[1].text == rows[0][1] and kept[2].text == rows[1][1] and kept[5].text == rows[4][1]


def test_many_copies_across_partitions(docs):
    rng = random.Random(2)
    text = " ".join(prose(rng, 120))
    rows = [(i, text) for i in range(60)] + [(100 + i, " ".join(prose(rng, 120))) for i in range(20)]
    got = D.repeats(docs(rows).repartition(7)).collect()
    assert {r.doc for r in got} == set(range(1, 60)) and all(covered(got, i) == set(range(120)) for i in range(1, 60))
    kept = D.remove_repeats(docs(rows).repartition(5)).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(100, 120)]


def test_against_all_fifty_word_runs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = D.repeats(df).collect()
    seen, missing, wanted = {}, 0, 0
    for r in df.orderBy("doc_id").collect():
        words = r.text.encode().lower().split()
        runs = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        need = {j for i, run in enumerate(runs) if run in seen for j in range(i, i + 50)}
        for run in runs:
            seen.setdefault(run, r.doc_id)
        wanted += len(need)
        missing += len(need - covered(got, r.doc_id))
    assert missing <= 0.02 * wanted


def test_edge_cases(docs):
    rng = random.Random(3)
    text = " ".join(prose(rng, 80))
    long = " ".join(prose(rng, 30_000))
    rows = [(1, None), (2, ""), (3, text), (None, text), (3, text), (4, text.upper()), (5, "be " * 300), (6, "be " * 300), (7, long), (8, long)]
    wide = docs(rows).withColumn("first", F.lit("x")).withColumn("seed", F.lit(1)).withColumn("__spans", F.lit(2))
    got = D.repeats(wide).collect()
    assert {(r.doc, r.of) for r in got} == {(4, 3), (6, 5), (8, 7)}
    kept = D.remove_repeats(docs(rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in (1, 2, 3, 3, 5, 7)] + [(True, 0)]
    assert D.repeats(docs([])).count() == 0 and D.remove_repeats(docs([])).count() == 0


def longest_alike(to, min_words, similarity):
    """Length of the longest stretch that is alike in both documents, by trying all."""
    at = [i for i, x in enumerate(to) if x >= 0]
    spans = [(at[j] - at[i] + 1, j - i + 1, to[at[j]] - to[at[i]] + 1) for i in range(len(at)) for j in range(i, len(at))]
    return max((own for own, hits, other in spans if own >= min_words and hits / max(own, other) >= similarity), default=0)


def test_words_left_out_of_the_later_document(docs):
    rng = random.Random(41)
    p, q, r = (prose(rng, 100) for _ in range(3))
    rows = D.repeats(docs([(1, " ".join(p + q + r)), (2, " ".join(p + r))])).collect()
    assert covered(rows, 2) == set(range(200)) and all(x.similarity >= 0.8 for x in rows)
    assert {(x.of_first, x.of_end) for x in rows} == {(0, 100), (200, 300)}


def test_parts_of_a_stretch_against_all_stretches():
    rng = random.Random(43)
    for _ in range(200):
        steps = [rng.choice([0] * 40 + [rng.randint(1, 12), 60]) for _ in range(rng.randint(20, 120))]
        to = np.cumsum(np.array(steps) + 1)
        to[[i for i in range(len(to)) if rng.random() < 0.03]] = -1
        got = D.alike_parts(to, 0, len(to), 20, 0.8)
        assert max((e - s for s, e, *_ in got), default=0) == longest_alike(to.tolist(), 20, 0.8)
        assert all(to[s] == of and to[e - 1] == end - 1 and alike >= 0.8 for s, e, of, end, alike in got)
        assert len({i for s, e, *_ in got for i in range(s, e)}) == sum(e - s for s, e, *_ in got)


def test_passages_whose_pieces_occur_elsewhere_before(docs):
    rng = random.Random(47)
    rows, want = [], {}
    for case, sizes in enumerate([(30, 30), (49, 49), (25, 35), (37, 13), (30, 30, 30), (49, 49, 49, 49)]):
        pieces = [prose(rng, n) for n in sizes]
        whole = [w for x in pieces for w in x]
        around = lambda body: " ".join([*prose(rng, 40), *body, *prose(rng, 40)])
        rows += [(100 * case + i, around(x)) for i, x in enumerate(pieces)] + [(100 * case + 50, around(whole)), (100 * case + 60, around(whole))]
        want[100 * case + 60] = set(range(40, 40 + len(whole)))
    got = D.repeats(docs(rows).repartition(5)).collect()
    assert {r.doc for r in got} == set(want) and all(want[i] <= covered(got, i) for i in want)
    assert {r.of for r in got} == {i - 10 for i in want}


def test_two_documents_share_what_two_others_have_in_parts(docs):
    rng = random.Random(53)
    a, b = prose(rng, 45), prose(rng, 45)
    got = D.repeats(docs([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b)), (4, " ".join(a + b))])).collect()
    assert [(r.doc, r.of, r.first, r.end, r.similarity) for r in got] == [(4, 3, 0, 90, 1.0)]


def corpus(rng, n):
    """Documents that share lines, whole and changed passages, and passages put together from others' pieces."""
    lines, passages = [prose(rng, 12) for _ in range(4)], [prose(rng, rng.randint(55, 120)) for _ in range(8)]
    rows, planted = [], {}
    for i in range(n):
        words, at = prose(rng, rng.randint(0, 60)), []
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(lines)
            which = rng.randrange(len(passages))
            body = [w if rng.random() > rng.choice([0, 0, 0.03]) else "x" + w for w in passages[which]]
            if rng.random() < 0.2:
                which, cut = -1, rng.randint(20, 40)
                body = passages[0][:cut] + passages[1][cut : cut + 40]
            at.append((which, len(words), len(words) + len(body)))
            words += [*body, *prose(rng, rng.randint(0, 40))]
        rows.append((i, " ".join(words)))
        planted[i] = at
    return rows, planted


def test_planted_passages_against_all_runs_of_fifty_words(docs):
    rng = random.Random(59)
    rows, planted = corpus(rng, 120)
    got = D.repeats(docs(rows).repartition(4)).collect()
    words = {i: t.split() for i, t in rows}
    seen: dict = {}
    wanted = missing = 0
    for i, text in rows:
        runs = [tuple(words[i][j : j + 50]) for j in range(len(words[i]) - 49)]
        need = {k for j, run in enumerate(runs) if run in seen for k in range(j, j + 50)}
        wanted, missing = wanted + len(need), missing + len(need - covered(got, i))
        for run in runs:
            seen.setdefault(run, i)
    assert wanted > 2000 and missing <= 0.01 * wanted
    # nothing but what was planted is found, beside the lines before and after and chance words at the ends
    allowed = {i: {k for _, s, e in at for k in range(s - 14, e + 14)} for i, at in planted.items()}
    assert all(k in allowed[r.doc] for r in got for k in range(r.first, r.end))
    for r in got:  # and each is alike in order, by the longest common subsequence
        a, b = words[r.doc][r.first : r.end], words[r.of][r.of_first : r.of_end]
        best = [0] * (len(b) + 1)
        for x in a:
            best, last = [0], best
            for j, y in enumerate(b):
                best.append(last[j] + 1 if x == y else max(last[j + 1], best[j]))
        assert r.of < r.doc and best[-1] >= 0.8 * max(len(a), len(b)) - 1e-9


def test_result_does_not_depend_on_how_rows_are_dealt(docs, monkeypatch):
    rows, _ = corpus(random.Random(61), 90)
    want = sorted(map(tuple, D.repeats(docs(rows).coalesce(1)).collect()))
    assert want
    for n in (2, 7):
        monkeypatch.setattr(D, "BLOCK_BYTES", 1 << 20 if n == 2 else 2000)
        monkeypatch.setattr(D, "ROWS", 50)
        assert sorted(map(tuple, D.repeats(docs(rows[::-1]).repartition(n)).collect())) == want


def test_columns_with_the_operators_own_names(docs):
    rng = random.Random(67)
    text = " ".join(prose(rng, 60))
    wide = docs([(1, text), (2, text)]).withColumn("spans", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("__spans", F.lit(3)).withColumn("__doc", F.lit(4)).withColumn("0", F.lit(5))
    kept = D.remove_repeats(wide).collect()
    assert [(r.doc_id, r.spans, r.doc, r["__spans"], r["0"]) for r in kept] == [(1, 1, 2, 3, 5)]


def test_every_run_of_fifty_words_whatever_its_seeds_were_in_before(docs):
    """Earlier documents have all but one word of the run, so that they have its long seeds first."""
    rng = random.Random(71)
    rows, want = [], {}
    for case in range(30):
        run, at = prose(rng, 50), 100 * case
        around = lambda body: " ".join([*prose(rng, 30), *body, *prose(rng, 30)])
        rows += [(at, around(run[:49])), (at + 1, around(run[1:])), (at + 2, around(run)), (at + 3, around(run))]
        want[at + 3] = set(range(30, 80))
    got = D.repeats(docs(rows).repartition(5)).collect()
    assert all(want[i] <= covered(got, i) for i in want) and {r.doc for r in got} == set(want)
    assert {(r.of, r.of_first, r.of_end) for r in got} == {(i - 1, 30, 80) for i in want}
    assert sorted(map(tuple, D.repeats(docs(rows[::-1]).coalesce(1)).collect())) == sorted(map(tuple, got))
