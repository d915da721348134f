"""Decontamination against a brute-force version that slides every window over every text."""

import hashlib
import random
import re

from fathom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for o in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[o : o + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def tables():
    rng = random.Random(2)
    vocabulary = ["the", "of", "Été", "x1", "a", "b", "naïve", "q", "zz", "7"]
    items = [(i, ", ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(25)]
    items += [(100, "single"), (101, "two words"), (102, None), (103, ""), (9, items[4][1]), (104, "the the the the the the the the the the the the")]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))
        if i % 3 == 0 and (t := rng.choice(items)[1]):
            w = t.split(" ")
            a = rng.randrange(len(w))
            text += "\n" + " ".join(w[a : a + rng.randint(5, 25)]).upper() + "! " + text[:50]
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "..."), (503, "a single one"), (504, "the " * 40), (505, "two, words two words"), (505, "two"), (506, " ".join(rng.choices(vocabulary, k=30000)) + " single")]
    return docs, items


def test_digests_against_brute_force(spark):
    docs, items = tables()
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, hits string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60):
        got = [tuple(r) for r in D.digests(D.matches(frame, bench, block_bytes=block)).collect()]
        assert sorted(got) == sorted(brute(docs, items))


def test_matches_are_the_longest_verbatim_runs(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "start " + " ".join(f"I{k}" for k in range(3, 21)) + " end"), (2, " ".join(f"i{k}" for k in range(9)))], "doc_id long, text string")
    found = {r.id: r.hits for r in D.matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert found[2] == [] and [tuple(h) for h in found[1]] == [("7", 1, 3, 18)]


def test_stage_keeps_clean_documents_and_all_columns(spark):
    docs, items = tables()
    frame = spark.createDataFrame([(t, "c", i) for i, t in docs], "text string, id string, doc_id long")
    kept = D.decontaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(docs, items) if not r[5])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.digests(D.matches(docs, items)).count() == 0
    got = D.digests(D.matches(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items)).first()
    assert (got.n_words, got.n_hit, got.n_items, got.contaminated) == (2, 0, 0, False)
