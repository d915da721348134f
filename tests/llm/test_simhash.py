"""SimHash against a brute-force version: fingerprints by definition, components by union-find over all pairs."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from fathom.llm import near_documents
from fathom.llm import simhash as S
from fathom.llm.common import connected_components

SCHEMA = "doc_id long, text string, fp string, component int"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=2):
    root = dict(enumerate(ids))
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))] if root else []


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    for t in list(texts[:30]):
        for _ in range(4):
            w = t.split()
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    return [*texts, None, "", " \t ", "Été ÉTÉ", "ONE two", "one two THREE", *texts[:5], "x y z " * 3000]


def test_whole_against_brute_force(spark):
    texts = corpus()
    rows = [(1000 - i, t, "clash", 7) for i, t in enumerate(texts)]
    got = {r.id: (r.fp % 2**64, r.component) for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components([r[0] for r in rows], fps)
    assert got == {r[0]: (f, c) for r, f, c in zip(rows, fps, want, strict=True)}


@pytest.mark.parametrize("bits,work", [(0, 32), (1, 32), (2, 32), (2, 0), (1, 0)])
def test_links_connect_what_brute_force_connects(spark, bits, work):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, work=work)
    assert all((r.a ^ r.b) % 2**64 and ((r.a ^ r.b) % 2**64).bit_count() <= bits for r in found.collect())
    roots = {r.node: r.root for r in connected_components(found).collect()}
    order = sorted(signed)
    want = brute_components(order, [x % 2**64 for x in order], bits)
    assert [roots.get(x, x) for x in order] == want


def test_allocation_always_sums_to_bits_less_parts_plus_one():
    rng = np.random.default_rng(0)
    bits = S.unpacked(rng.integers(0, 2**63, 200, dtype=np.int64))
    groups = S.bit_groups(bits.T.astype(float) @ bits, 200, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    limits = S.Allocation(groups, {(k, v): 5 for k in range(8) for v in range(3)}, 200, 2).thresholds(bits)
    assert (limits.sum(axis=1) == 2 - 4 + 1).all() and limits.min() >= -1


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 63] = bits[:, 0]
    groups = S.bit_groups(bits.T.astype(float) @ bits, 500, 4)
    assert any(0 in g and 63 in g for g in groups)


def test_one_of_each_and_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.one_of_each(empty).count() == 0
    rows = [(1, "a b c d", "k"), (2, "a b c d", "k"), (3, None, "k"), (4, "", "k"), (5, "a b c d", "k"), (5, "a b c d", "k"), (None, "q r s t u", "k")]
    kept = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, component string"))
    assert kept.columns == ["doc_id", "text", "component"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_one_of_each_keeps_unlike_texts_of_one_id(spark):
    rows = [(None, "a b c d"), (None, "e f g h"), (5, "i j k l"), (5, "m n o p"), (5, "m n o p"), (6, "m n o p"), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component long")
    for stage in (S.one_of_each, near_documents.one_of_each):
        kept = stage(docs)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "a b c d"), (0, "e f g h"), (5, "i j k l"), (5, "m n o p"), (7, "")]
        assert stage(docs.limit(0)).count() == 0
