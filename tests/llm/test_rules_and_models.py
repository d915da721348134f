"""Quality rules, language, toxicity and line quality: brute force, held-out accuracy, and rows of every odd kind."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fathom.llm import language, line_quality, quality_rules, toxicity
from fathom.llm.common import documents, picked

FOLDER = "/root/testdata/sf0.01"
ODD = [(None, "no id at all", "a", 1), (1, None, "b", 2), (2, "", "c", 3), (3, "  \n\t ", "d", 4), (4, "same text here", "e", 5), (4, "same text here", "e", 5), (5, "word " * 30_000, "f", 6)]
NAMES = "doc_id long, text string, id string, words long"


def long_hash(value: int, seed: int) -> int:
    return xxh64_intdigest((value & (2**64 - 1)).to_bytes(8, "little"), seed)


def grams(text: str, buckets: int) -> list[int]:
    hashes = [xxh64_intdigest(w, 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    pairs = [long_hash(b, long_hash(a, 42)) for a, b in itertools.pairwise(hashes)]
    return [(h - (h >> 63 << 64)) % buckets for h in [*hashes, *pairs]]


def base(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_quality_rules_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "#x", "delta|", "né"]) + rng.choice(["", "\n", "", ""]) for _ in range(rng.randint(0, 160))) for _ in range(60)] + ["", None, "a b c " * 40]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "id long, text string")
    trusted = set(range(0, 60, 3))
    weights = quality_rules.bucket_weights(docs, spark.createDataFrame([(i,) for i in trusted], "id long"), 64)
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t or "", 64))
        target.update(grams(t or "", 64) if i in trusted else [])
    share = lambda c, b: math.log((c[b] + 0.5) / (sum(c.values()) + 32))
    want = [share(target, b) - share(raw, b) for b in range(64)]
    assert weights == pytest.approx(want)
    found = {r.id: r for r in quality_rules.quality(docs, weights, -0.01, "id").collect()}
    for i, t in rows:
        r, g = found[i], grams(t or "", 64)
        score = sum(want[b] for b in g) / max(len(g), 1)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t)
        assert r.llr == pytest.approx(score, abs=1e-12)
        assert r.kept == (not r.base_failed and r.llr >= -0.01)


def test_quality_rules_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, NAMES)
    found = quality_rules.quality(docs, [0.0] * 16).collect()
    assert len(found) == len(ODD) and not any(r.kept for r in found)
    assert quality_rules.quality(docs.limit(0), [0.0] * 16).count() == 0
    ids = docs.select(F.col("doc_id").alias("id"), "text")
    assert quality_rules.bucket_weights(ids, ids.limit(0), 8) == [0.0] * 8


def test_all_good_labels_are_trusted(spark):
    labels = spark.range(100_500).selectExpr("id AS doc_id", "IF(id < 100200, 1, 0) AS quality")
    assert quality_rules.trusted_ids(labels).count() == 100_200


def test_language_on_held_out_documents(spark):
    found = language.op5_language(spark, FOLDER).join(documents(spark, FOLDER).select("doc_id", "lang", "text"), "doc_id")
    told = found.filter("held_out and lang is not null and text is not null and length(text) > 20")
    assert told.filter("lang = lang_pred").count() >= 0.9 * told.count() > 0
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([*ODD, (6, "12 34 !?", "g", 7)], NAMES)
    rows = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("x", None)] * 3)], "id long, text string, lang string")
    model = language.fit(rows)
    found = {(r.id, r.lang_pred) for r in language.identified(picked(docs), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und")} <= found and {v for i, v in found if i in (4, 5)} <= {"en", "de"}
    assert {r.lang_pred for r in language.identified(picked(docs), language.fit(rows.limit(0))).collect()} == {"und"}
    assert language.identified(picked(docs.limit(0)), model).count() == 0


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(5)
    words, stems = ["abcde", "abcdx", "bbbbbb", "cab", "edcbae"], ["dddd"]
    automaton = toxicity.Automaton.of(words, stems)
    tried = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(2000)] + words + ["ddddab", "abde", "abcdef", "xbcde", "zabcde"]
    codes, _, starts, stops, _ = toxicity.words_of(tried)
    for word, kind in zip(tried, automaton.run(codes, starts, stops).tolist(), strict=True):
        if word.startswith("dddd"):
            want = toxicity.STEMMED
        elif word in words:
            want = toxicity.WORD
        else:
            want = toxicity.NEAR if any(len(w) >= toxicity.FUZZY_FROM and edits(w, word) == 1 for w in words) else toxicity.NONE
        assert kind == want, word


def test_quoted_hits_count_apart():
    automaton = toxicity.Automaton.of(["vile"], [])
    x = toxicity.features(automaton, set(), ['they said "you vile thing" and left', "you vile thing", "", "“vile” vile"])
    assert (x[:, 1] > 0).tolist() == [False, True, False, True] and (x[:, 4] > 0).tolist() == [True, False, False, True]


def ranked(pairs: list[tuple[float, int]]) -> float:
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_toxicity_on_held_out_documents(spark):
    large = "/root/testdata/sf0.1"  # some 100 toxic documents are held out there, 6 in the smaller table
    found = toxicity.op7_toxicity(spark, large).join(documents(spark, large, "labels"), "doc_id").filter("held_out").collect()
    assert ranked([(r.score, r.toxic) for r in found]) >= 0.9
    assert sum(r.predicted == r.toxic for r in found) >= 0.9 * len(found)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, NAMES)
    none = toxicity.fit(picked(docs), spark.createDataFrame([], "id long, toxic int"))
    assert [r.score < 0.5 for r in toxicity.scored(picked(docs), none).collect()] == [True] * len(ODD)
    assert toxicity.clean(docs, none).collect() == docs.collect() and toxicity.clean(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (None, 1), (5, None)], "id long, toxic int")
    assert toxicity.scored(picked(docs), toxicity.fit(picked(docs), labels)).count() == len(ODD)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    row = np.repeat(np.arange(4), [1, 5, 3, 4])
    unary, move = rng.normal(size=(len(row), 2)), rng.normal(size=(2, 2))
    got = line_quality.Chains(row).marginals(unary, move)
    for r in range(4):
        at = np.flatnonzero(row == r)
        total, good = 0.0, np.zeros(len(at))
        for labels in itertools.product((0, 1), repeat=len(at)):
            p = math.exp(sum(unary[i, y] for i, y in zip(at, labels, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(labels)))
            total += p
            good += p * np.array(labels)
        assert got[at] == pytest.approx(good / total)


def test_line_quality_on_held_out_documents(spark):
    found = line_quality.op9_line_quality(spark, FOLDER).join(documents(spark, FOLDER, "labels"), "doc_id").filter("held_out").collect()
    assert ranked([(r.score, r.quality) for r in found]) >= 0.85


def test_line_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, NAMES)
    none = line_quality.fit(picked(docs), spark.createDataFrame([], "id long, quality int"))
    assert {r.score for r in line_quality.scored(picked(docs), none).collect()} == {0.5}
    model = line_quality.fit(picked(docs), spark.createDataFrame([(4, 1), (5, 0), (None, 1), (2, None)], "id long, quality int"))
    assert line_quality.scored(picked(docs), model).count() == len(ODD)
    assert line_quality.scored(picked(docs.limit(0)), model).count() == 0
