import random

from pyspark.sql import functions as F

from quillgraph.llm import language_id as L

TRAIN = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat and the dog ran", "en"), ("der hund und die katze sind in dem haus", "de"), ("le chat est sur la table avec le chien", "fr")] * 3)]


def test_known_words_and_fallback(docs):
    model = L.fit(docs(TRAIN))
    assert model.langs == ["de", "en", "fr"]
    assert model.predict("The dog and the cat", {})[0] == "en"
    assert model.predict("hunde katzen häuser", {})[0] == "de"  # no known word: n-grams decide
    assert model.unseen("katzen") and model.unseen("0") == []


def test_undetermined_and_scores(docs):
    model = L.fit(docs(TRAIN))
    rows = [(1, None), (2, ""), (3, "123 !! ²"), (None, "the cat"), (4, "the cat"), (4, "the cat"), (5, "le chat " * 50_000)]
    found = L.predict(docs(rows), model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(by[i].score == 0.0 for i in (1, 2, 3))
    assert by[None].lang_pred == "en" and by[5].lang_pred == "fr"
    assert all(0.0 <= r.score <= 1.0 for r in found)


def test_nothing_to_learn_from(docs):
    for train in ([], [(1, None, "en")], [(1, "text", None)], [(1, "123", "en")]):
        assert L.predict(docs([(1, "some words")]), L.fit(docs(train))).first().lang_pred == "und"


def test_clashing_columns_and_empty_table(docs):
    model = L.fit(docs(TRAIN))
    wide = docs([(1, "the dog")]).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(7)).withColumn("t", F.lit(1))
    assert L.predict(wide, model).columns == ["doc_id", "lang_pred", "score"]
    assert L.predict(wide, model).first().lang_pred == "en"
    assert L.predict(docs([]), model).count() == 0


def test_stage_keeps_rows(docs):
    model = L.fit(docs(TRAIN))
    kept = L.keep_identified(docs([(1, "the dog", None), (2, "77"), (3, None)]).withColumn("extra", F.lit(1)), model).collect()
    assert [(r.doc_id, r.lang, r.extra) for r in kept] == [(1, "en", 1)]


def test_held_out_accuracy(spark):
    from quillgraph.llm.entry import op1_language_id

    d = "/root/testdata/sf0.001"
    truth = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    held = op1_language_id(spark, d).join(truth, "doc_id").where("held_out and lang is not null")
    right, n = held.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * n


def test_bounded_vocabulary(docs):
    model = L.fit(docs(TRAIN), max_words=5, max_grams=3)
    assert len(model.words) <= 5 and all(len(g) <= 3 for g in model.grams.values())


def test_rare_languages_keep_their_words_and_grams(docs):
    many = [(i, "der hund und die katze sind in dem haus", "de") for i in range(20)] + [(99, "zzyzx qwopq", "xx")]
    model = L.fit(docs(many), max_words=6)
    assert model.langs == ["de", "xx"] and {"zzyzx", "qwopq"} <= set(model.words) and len(model.words) == 6
    assert model.predict("zzyzx", {})[0] == "xx"
    dropped = set("der hund und die katze sind in dem haus".split()) - set(model.words)
    assert dropped and all(g in model.grams[3] for w in dropped for g in L.grams(w, 3))  # n-grams are of all words


def plain_model(train, text, langs):
    """Language and posterior by the rule itself, from counts in plain dictionaries."""
    from collections import Counter
    from math import exp, log

    words = {lang: Counter(w for _, t, x in train if x == lang for w in L.words_of(t)) for lang in langs}
    known = set().union(*words.values())
    pieces = {n: {lang: Counter(g for w, c in words[lang].items() for g in L.grams(w, n) for _ in range(c)) for lang in langs} for n in range(1, 6)}
    share = lambda counts, of, x: log((counts[x] + 0.5) / (sum(counts.values()) + 0.5 * max(1, of)))
    total = dict.fromkeys(langs, 0.0)
    for word in L.words_of(text):
        if word in known:
            for lang in langs:
                total[lang] += share(words[lang], len(known), word)
            continue
        for n in range(5, 0, -1):
            every = set().union(*pieces[n].values())
            if found := [g for g in L.grams(word, n) if g in every]:
                for lang in langs:
                    total[lang] += sum(share(pieces[n][lang], len(every), g) for g in found) / len(found)
                break
    top = max(total.values())
    p = {lang: exp(v - top) for lang, v in total.items()}
    best = max(langs, key=lambda lang: p[lang])
    return best, p[best] / sum(p.values())


def test_predictions_against_plain_scoring(docs):
    rng = random.Random(8)
    letters = {"aa": "abcdeou", "bb": "abxyzui", "cc": "mnoprsa"}
    speak = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    train = [(i, speak(lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 6)]
    model = L.fit(docs(train))
    rows = [(i, " ".join([speak(rng.choice(["aa", "bb", "cc"]), rng.randint(0, 3)) + " " + " ".join(rng.choice(train)[1].split()[: rng.randint(0, 3)]) for _ in range(2)])) for i in range(80)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs(rows), model).collect()}
    for i, text in rows:
        if L.words_of(text):
            lang, score = plain_model(train, text, ["aa", "bb", "cc"])
            assert got[i][0] == lang and abs(got[i][1] - score) < 1e-3
        else:
            assert got[i] == ("und", 0.0)


def test_a_hundred_languages_of_very_different_size(docs):
    rng = random.Random(9)
    train = []
    for k in range(100):
        own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(4000 if k == 0 else 30)]
        train += [(1000 * k + j, " ".join(own[j * 30 : j * 30 + 30]), f"l{k:03d}") for j in range(len(own) // 30)]
    model = L.fit(docs(train), max_words=3000)
    assert len(model.langs) == 100
    right = sum(model.predict(t, {})[0] == lang for _, t, lang in train if lang != "l000")
    assert right == 99
