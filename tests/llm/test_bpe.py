"""The codec against the tiktoken library, whole and in tiny overlapping chunks, and an exact round trip."""

import base64
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from fathom.llm import bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "a", "Hello world's they're  we'll\n\n\n  x", "12345 67!!??  \t tab", "naïve Été ß 日本語 עברית 👩‍👩‍👧", "x" * 5000, "!?" * 700,
    " " * 3000 + "end", "a b c", "don't we've I'd you'm 'x' ''s", "\n" * 50 + "z", "<|endoftext|> is text", "tail   ", "\r\n \r\n", "é" * 900,
]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def long_texts():
    rng = random.Random(1)
    pool = ["word", "they're", "'s", "  ", "\n", " 12", "é", "!!", "日本", " a", "\t", "'", "r", "ll"]
    return ["".join(rng.choices(pool, k=rng.randint(1, 900))) for _ in range(40)]


def test_against_the_library_whole_and_in_chunks(spark):
    tokens, texts = reference(), [*TEXTS, *long_texts(), None]
    frame = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    want = {i: np.array(tokens.encode_ordinary(t or ""), "<u4").tobytes() for i, t in enumerate(texts)}
    for chunk, overlap in ((B.CHUNK, B.OVERLAP), (40, 16), (7, 9), (64, 3)):
        got = {r.id: bytes(r.ids) for r in B.encoded(frame, PATH, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
        assert got == want, (chunk, overlap)


def test_round_trip_and_digest(spark):
    texts = [*TEXTS, *long_texts()[:5]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    back = {r.id: bytes(r.bytes) for r in B.decoded(B.encoded(frame, PATH, P.PATTERN, chunk=100, overlap=30), PATH, P.PATTERN).collect()}
    assert back == {i: t.encode() for i, t in enumerate(texts)}
    assert {r.id: r.n_tokens for r in B.digests(frame, PATH, P.PATTERN).collect()} == {i: len(reference().encode_ordinary(t)) for i, t in enumerate(texts)}


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "ab " * 50), (1, "ab " * 50), (1, "cd " * 60), (None, "x " * 99), (2, None)]
    got = B.encoded(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, chunk=20, overlap=8).collect()
    tokens = reference()
    assert sorted((str(r.id), bytes(r.ids)) for r in got) == sorted((str(i), np.array(tokens.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in rows)
    assert B.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_digests_take_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c " * 70_000)], "doc_id long, text string")
    plan = B.digests(docs, PATH, P.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # short texts, and the chunks of long ones
