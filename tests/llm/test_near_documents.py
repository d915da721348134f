"""Near-duplicate documents against all pairs, and the pipeline's stage with planted near copies."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fathom.llm import near_documents, simhash


def brute(rows, shingle, similarity):
    """The smallest id of each document's component, with all pairs compared."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9 and sets[i] and sets[j]:
                root[find(i)] = find(j)
    return {rows[i][0]: min(r[0] for k, r in enumerate(rows) if find(k) == find(i)) for i in range(len(rows))}


def edited(rng, words, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), min(n, len(w))):
        w[at] = rng.choice(words)
    return " ".join(w)


@pytest.mark.parametrize(("crowd", "rounds"), [(64, 3), (2, 3), (2, 0)])
def test_components_against_all_pairs(spark, monkeypatch, crowd, rounds):
    if rounds == 0:  # components by Spark and not on the driver
        monkeypatch.setattr(near_documents._roots, "__defaults__", (0,))
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(12)]
    for _ in range(140):
        texts.append(edited(rng, words, rng.choice(texts), rng.choice((0, 1, 1, 2, 3))))
    texts += [None, "", " \t", "a b", "A  b", "a b c", texts[0] + " end", "x y z " * 3000, "x y z " * 2999]
    rows = [(500 - i, t) for i, t in enumerate(texts)]
    got = near_documents.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, crowd=crowd, rounds=rounds)
    want = brute(rows, 3, 0.8)
    assert {r.id: r.component for r in got.collect()} == want and 10 < len(set(want.values())) < 140


def test_stage_drops_planted_near_copies(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=300))) for i in range(20)]
    rows += [(100 + i, edited(rng, words, rows[i][1], 1 + i % 5)) for i in range(20)]  # five words changed: 0.85
    rows += [(200 + i, edited(rng, words, rows[i][1], 12)) for i in range(20)]  # less than 0.8 of any
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {*range(20), *range(200, 220)} and kept == set(brute(rows, 5, 0.8).values())


def test_simhash_links_near_copies_by_itself(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=1500))) for i in range(40)]
    rows += [(100 + i, edited(rng, words, rows[i][1], 1 + i % 3)) for i in range(40)]
    rows += [(200 + i, f"{rows[i][1]} {' '.join(rng.choices(words, k=200))}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 5, 0.8)
    monkeypatch.setattr(near_documents, "_suspects", lambda sets: sets.sparkSession.createDataFrame([], "key long, n int, at int, token long"))
    alone = {r.id: r.component for r in near_documents.near_duplicates(docs).collect()}
    assert sum(alone[100 + i] == i for i in range(40)) >= 20  # the others' fingerprints lie farther apart
    assert all(alone[i] in (i, want[i]) for i in alone)
    # Fingerprints that are near by chance link nothing: no set of 0.99 is among these.
    assert all(r.id == r.component for r in near_documents.near_duplicates(docs.filter("doc_id < 140"), similarity=0.9999).collect())


def test_prefixes_are_of_rare_words_though_all_shingles_are_rare(spark):
    rng = random.Random(3)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join([*rng.choices(common, k=30), f"rare{i}", *rng.choices(common, k=30)])) for i in range(50)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "xxhash64(text) as h")
    sets = near_documents._sets(docs, 5, 0.8, near_documents.word_levels(docs)).collect()
    for r in sets:
        w = dict(rows)[r.id].split()
        around = pa.array([" ".join(w[i : i + 5]) for i in range(26, 31)])
        assert {int(t) for _, _, _, tokens, _ in near_documents.token_sets(around, 5) for t in tokens} <= set(r.prefix[:5])


def test_fingerprints_of_sets():
    rng = np.random.default_rng(1)
    hashes, ends = rng.integers(-(2**63), 2**63 - 1, 90), np.array([0, 0, 1, 3, 60, 90, 90])
    want = [sum((int((h >> b & 1).sum()) * 2 > len(h)) << b for b in range(64)) for h in (hashes[a:b] for a, b in zip(ends, ends[1:], strict=False))]
    for block in (7, 1 << 16):
        assert simhash.of_sets(ends, hashes, block).view(np.uint64).tolist() == want


def test_odd_rows(spark):
    rows = [(None, "a b c", "x"), (1, "a b c", "x"), (2, "d e", "y"), (2, "d e", "z"), (None, "q r s", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = near_documents.one_of_each(docs)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "2", "None"] and kept.columns == docs.columns
    assert near_documents.one_of_each(docs.limit(0)).count() == 0


def test_quoted_passages_and_edited_copies_make_no_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(f"passage{i}" for i in range(8))
    quoting = [(i, f"{' '.join(rng.choices(words, k=60))} {passage} {' '.join(rng.choices(words, k=60))}") for i in range(60)]
    text = " ".join(f"own{i}" for i in range(120))
    copies = [(100 + i, edited(rng, words, text, 7)) for i in range(60)]  # some 0.6 of each other
    near = [(200, quoting[0][1] + " end"), (201, copies[0][1] + " end")]
    rows, made, sharing = quoting + copies + near, [], near_documents._sharing

    def counted(found, similarity):
        made.append(found.count())
        return sharing(found, similarity)

    monkeypatch.setattr(near_documents, "_sharing", counted)
    monkeypatch.setattr(near_documents, "links_by_fingerprint", lambda docs, *_: docs.sparkSession.createDataFrame([], "a long, b long"))
    got = {r.id: r.component for r in near_documents.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=2).collect()}
    assert got == brute(rows, 5, 0.8) and got[200] == 0 and got[201] == 100
    assert sum(made) < 2 * len(rows)
