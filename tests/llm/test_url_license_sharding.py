import random

from pyspark.sql import functions as F

from quillgraph.llm import license_scan as C
from quillgraph.llm import sharding as H
from quillgraph.llm import url_filter as U

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("a.b.net", "", "block"), ("b.net", "/x", "allow"), ("b.net", "/x", "block")]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


def test_urls_against_plain_rules(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "x.example.com", "notexample.com", "EXAMPLE.Com", "example.com.", "net", "b.net", "a.b.net", "q.a.b.net", "ab.net", "org", "", "a-b.net", "b0.net"]
    urls = [None, "", "no scheme", "http://", "x://y://z/en/", "http://example.com?q=/en/", "http://ex.com\n/en/"] + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/71?x', '/de/8', '/x#y', '?z', '#/en/'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("k", F.lit(2))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages.select("page_id", "url", "html", "k"), rules).collect()}
    assert got == {i: plain(u, RULES) for i, u in enumerate(urls)}
    assert U.judge(pages.where("page_id = 9"), rules).count() == 1
    assert U.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in U.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_ten_thousand_rules_of_one_host(spark):
    rng = random.Random(12)
    path = lambda n: "/" + "".join(rng.choice("ab/é😀") for _ in range(n))
    rules = list({("example.com", path(rng.randint(1, 9))): None for _ in range(12_000)})[:10_000] + [("com", "/a"), ("b.example.com", "")]
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    assert len(rules) > 5000
    urls = [f"http://{rng.choice(['example.com', 'x.example.com', 'a.b.example.com', 'com'])}{path(rng.randint(0, 12))}" for _ in range(600)] + ["http://example.com/" + "a" * 200_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rk", F.lit(1)).withColumn("open", F.lit(2)).withColumn("id", F.lit(3))
    found = U.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    by: dict = {}
    for h, p, v in rules:
        by.setdefault(h, {})[p] = v

    def wanted(url):  # the longest fitting rule, by the prefixes of the path
        host, path, *_ = plain(url, [])
        fits = [(len(h + path[:n]), len(h), of[path[:n]], h + path[:n]) for h, of in by.items() if host == h or host.endswith("." + h) for n in range(min(len(path), 12) + 1) if path[:n] in of]
        best = max(fits, default=None)
        return host, path, best[3] if best else None, best[2] if best else "allow"

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}
    assert got == {i: wanted(u) for i, u in enumerate(urls)}


def test_url_filter_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = U.judge(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licence_rules(docs):
    mit = C.SENTENCES["mit-grant"] + ":\n\n" + C.SENTENCES["mit-condition"]
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore"), (2, "Nothing. At all."), (3, None), (4, ""), (5, mit),
        (6, C.SENTENCES["mit-condition"] + " " + C.SENTENCES["mit-grant"] + ": x"), (7, "licensed UNDER the apache license -- version 2.0! Licensed under CC BY-NC 4.0."),
        (8, "word " * 200_000 + ". All rights reserved."), (None, "All rights reserved."), (1, "Released under the MIT License"),
    ]
    got = C.scan(docs(rows).withColumn("licenses", F.lit(1)).withColumn("id", F.lit(2))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.sentence_ids, r.licenses))
    assert by[1] == [(["mit-notice"], ["MIT"])] * 2
    assert by[2] == by[3] == by[4] == [([], [])]
    assert by[5] == [(["mit-grant", "mit-condition"], ["MIT"])]
    assert by[6] == [(["mit-condition", "mit-grant"], [])]  # the rule's order counts
    assert by[7] == [(["apache2-notice", "ccbync4-notice"], ["Apache-2.0", "CC-BY-NC-4.0"])]
    assert by[8] == by[None] == [(["rights-reserved"], ["all-rights-reserved"])]
    assert C.scan(docs([])).count() == 0


def test_wrapped_and_commented_licences(docs):
    import textwrap

    t = C.SENTENCES
    texts = {
        "MIT": ["The MIT License (MIT)", "Copyright (c) 2021 A. Person", t["mit-grant"] + ":", t["mit-condition"], t["mit-warranty"] + " " + t["mit-liability"]],
        "Apache-2.0": ["Copyright 2020 A. Person", f"{t['apache2-header']}; {t['apache2-use']} {t['apache2-copy']}", "    http://www.apache.org/licenses/LICENSE-2.0", t["apache2-as-is"] + " " + t["apache2-see"]],
        "BSD-3-Clause": ["Copyright (c) 2021, A. Person", t["bsd-grant"] + ":", t["bsd-source"], t["bsd-binary"], t["bsd-name"]],
        "GPL-3.0-or-later": [f"{t['free-program']}: {t['gpl-terms']}", f"{t['gpl-warranty']}; {t['gpl-implied']} {t['gpl-details']}", t["gpl-copy"]],
        "GPL-2.0-or-later": [f"{t['free-program']}; {t['gpl2-terms']}; {t['gpl2-later']}", f"{t['gpl-warranty']}; {t['gpl-implied']}"],
        "Zlib": [t["zlib-as-is"], t["zlib-grant"] + ":"],
        "ISC": ["ISC License", t["isc-grant"]],
    }
    styles = [("", "{}", ""), ("", "# {}", ""), ("/*\n", " * {}", "\n */"), ("", "// {}", ""), ("<!--\n", "{}", "\n-->"), ("", ";; {}", ""), ("", "-- {}", "")]
    rows, want = [], {}
    for name, paragraphs in texts.items():
        for head, line, tail in styles:
            wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 72)) for p in paragraphs)
            body = head + "\n".join(line.format(x).rstrip() for x in wrapped.split("\n")) + tail
            want[len(rows)] = name
            rows.append((len(rows), f"{body}\n\nint main() {{ return 0; }}\nWords after. And more\n"))
    got = {r.doc_id: r.licenses for r in C.scan(docs(rows)).collect()}
    assert {i: x[0] if x else None for i, x in got.items()} == want


def test_tables():
    assert len(C.known_sentences(C.SENTENCES)) == len(C.SENTENCES) and {s for _, run in C.RULES for s in run} <= set(C.SENTENCES)


def plain_fill(shards, slots):
    order = {s: [(H.preference(s, slots)[0] + i * H.preference(s, slots)[1]) % slots for i in range(slots)] for s in shards}
    owner = {}
    while len(owner) < slots:
        for s in sorted(shards):
            slot = next((x for x in order[s] if x not in owner), None)
            if slot is not None:
                owner[slot] = s
    return [owner[i] for i in range(slots)]


def test_lookup_table():
    shards = ["c", "a", "b"]
    assert [shards[i] for i in H.fill(shards, 101)] == plain_fill(shards, 101)
    many = [f"s{i}" for i in range(50)]
    full = H.fill(many, 10_007)
    counts = [full.count(i) for i in range(50)]
    assert max(counts) - min(counts) <= 1
    without = H.fill(many[:-1], 10_007)
    moved = sum(a != b for a, b in zip(full, without) if a != 49)
    assert moved < 0.05 * 10_007
    for bad in (([], 11), (["a", "a"], 11), (["a"], 12)):
        try:
            H.fill(*bad)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_placement(docs, spark):
    rows = docs([(i, "x") for i in range(500)] + [(None, None), (3, "y")]).withColumn("slot", F.lit("clash")).withColumn("shard", F.lit(0))
    got = H.place(rows.select("doc_id", "text"), ["x", "y", "z"], slots=101).collect()
    assert len(got) == 502 and {r.shard for r in got} == {"x", "y", "z"}
    owner = H.fill(["x", "y", "z"], 101)
    assert all(["x", "y", "z"][owner[r.slot]] == r.shard for r in got)
    assert len({r.shard for r in got if r.doc_id == 3}) == 1
    assert H.place(rows, ["x"], slots=101).count() == 502 and H.place(docs([]), ["x"], slots=101).count() == 0


def test_places_by_a_second_hash(docs, spark):
    """Slots by another implementation of the hash, owners by the plain way of filling."""
    import xxhash

    shards = [f"shard-{i}" for i in range(5)]
    owner = plain_fill(shards, 211)
    keys = [*range(300), None, -7, 2**62]
    got = H.place(docs([(k, "x") for k in keys]), shards, slots=211).collect()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for r in got:
        slot = signed(xxhash.xxh64_intdigest(b"" if r.doc_id is None else str(r.doc_id).encode(), 42)) % 211
        assert (r.slot, r.shard) == (slot, owner[slot])
