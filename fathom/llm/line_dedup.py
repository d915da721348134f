"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct shingles of `shingle` lower-cased words; a line of fewer words has one token, all its
words. Two lines match if the Jaccard similarity of their tokens is at least `similarity`; a line goes if an earlier
line, by (document id, line number), matches it. Lines without a word are left alone.

Lines that match share m tokens of their prefixes, the first ``n - ceil(similarity * n) + m`` of n tokens in any one order
of all tokens, or all that they have in common if that is fewer.

1. Every line lists a superset of its prefix (m is `COMMON`) in the order of the tokens' first words' hashes, without hashing its other
   tokens. Tokens that only equal lines list are done with, and so are the lines, most of all, that list fewer than m others: a
   passage of a few words that many lines quote doesn't bring them together. What is left are the suspects; equal lines are folded into the earliest of them.
2. The suspects get all their tokens and a number in the order of the lines; the tokens are put in the order of their rarity: by how often the tokens of their hash bucket occur on
   suspects (a table of fixed size), then by hash. Each is verified against the earliest line under each token of
   its prefix (m is 1); that finds copies of an original whatever
   their number. Only suspects without such a match are held against all earlier lines under their tokens: as pairs
   that pass the length and positional filters, or, under tokens that more than `crowd` lines list, by a semi-join that stops at the
   first match.

Only suspects' texts and rows of shared tokens are shuffled, as far as bitmaps of fixed size over their hashes tell them from others;
what a bitmap lets through is joined exactly after it. Lines are told apart by 128 bits of hash.

The optimiser copies the definition of what an inner `explode` unfolds into filters below, where token lists would be made
anew for each word. So `explode_outer` is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, documents, dropped, kept, maybe_in

SHINGLE, SIMILARITY = 5, 0.8
#: Lines under one token that are still paired; above it the semi-join takes over.
CROWD = 64
#: Tokens that matching lines share in the lists of the first step, if they have as many in common.
COMMON = 4
#: Buckets of the table of token counts; a power of two.
BUCKETS = 1 << 17
#: White space besides the blank and the line's end.
OTHER_SPACE = "\t\v\f\r"


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): `row` tells the texts of one id apart; it is the text's hash if any id repeats, else 0."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    once = docs.groupBy("id").count().filter("count > 1").isEmpty()
    return docs.select("id", (F.lit(0).cast("long") if once else F.xxhash64("text")).alias("row"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """(id, row, line, body): the lines that hold a word, lower-cased, with the blank as their only white space."""
    text = F.lower("text")
    for c in OTHER_SPACE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return docs.select("id", "row", F.posexplode_outer(F.split(text, "\n")).alias("line", "body")).filter(F.ltrim("body") != "")


def _tokens(shingle: int) -> Column:
    """The distinct tokens of `words`, in one pass."""
    openings = F.expr(f"slice(words, 1, greatest(size(words) - {shingle - 1}, 1))")
    return F.array_distinct(F.transform(openings, lambda w, i: F.xxhash64(w, *(F.get("words", i + j) for j in range(1, shingle)))))


def token_levels(lines: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How frequent the tokens of each hash bucket are on all `lines` (tokens): the number of binary digits of their count."""
    every = lines.select(F.explode_outer("tokens").alias("token"))
    counts = every.groupBy(F.col("token").bitwiseAND(buckets - 1).alias("b")).agg(F.count("*").alias("n")).toArrow()
    levels = [0] * buckets
    for b, n in zip(counts.column("b").to_pylist(), counts.column("n").to_pylist(), strict=True):
        levels[b] = n.bit_length()
    return levels


def _by_rarity(tokens: Column, levels: list[int]) -> Column:
    """Tokens as numbers in the order of their rarity: the level, then 56 bits of the hash."""
    table = F.lit(bytearray(levels))  # one byte a bucket; a list of numbers takes Spark long to plan with

    def ranked(t: Column) -> Column:
        level = F.ascii(F.substring(table, t.bitwiseAND(len(levels) - 1).cast("int") + 1, 1).cast("string"))
        return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(t, 8))

    return F.sort_array(F.transform(tokens, ranked))


def _prefix(n: Column, similarity: float) -> Column:
    return (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")


def _index(lines: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(k, need, token, id, row, line, k2): the listed tokens of every line, one a row, and a hash of the line.

    The first p distinct tokens begin with no more than the p smallest first words, so the tokens of those are listed.
    A line of n tokens that matches has `COMMON` of its listed ones in common with the other, or ceil(similarity * n) if that is
    fewer: the first of the tokens in common are listed by both. It has as many tokens as words that begin them, at least,
    and `need` is reckoned from these. Only a line's first row tells where the line is, with its second hash; its token may be null.
    """
    hashed = lines.select("id", "row", "line", F.xxhash64("body").alias("k"), F.xxhash64("body", F.lit(1)).alias("k2"), F.transform(F.array_remove(F.split("body", " "), ""), lambda w: F.xxhash64(w)).alias("hashes"))
    hashed = hashed.withColumn("opening", F.expr(f"slice(hashes, 1, greatest(size(hashes) - {shingle - 1}, 1))"))
    hashed = hashed.withColumn("starts", F.sort_array(F.array_distinct("opening")))
    upto = F.get("starts", _prefix(F.size("opening"), similarity) + COMMON - 2)
    need = F.least(F.lit(COMMON), F.ceil(F.size("starts") * similarity - 1e-9)).cast("byte")
    bounded = hashed.select("id", "row", "line", "k", "k2", need.alias("need"), upto.alias("upto"), "hashes", "opening")
    # Lines of few different words list all tokens, each once. Those of the others are hashed when unfolded, as code is compiled for rows and not for `transform`.
    every = F.array_distinct(F.transform("opening", lambda h, i: F.xxhash64(h, *(F.get("hashes", i + j) for j in range(1, shingle)))))
    bounded = bounded.withColumn("opening", F.when(F.col("upto").isNull(), every).otherwise(F.col("opening")))
    each = bounded.select("id", "row", "line", "k", "k2", "need", "upto", "hashes", F.posexplode_outer("opening").alias("at", "h")).filter("upto is null or h <= upto or at = 0")
    token = F.when(F.col("upto").isNull(), F.col("h")).when(F.col("h") <= F.col("upto"), F.xxhash64("h", *(F.get("hashes", F.col("at") + j) for j in range(1, shingle))))
    return each.select("k", "need", token.alias("token"), *(F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("id", "row", "line", "k2")))


def _suspects(lines: DataFrame, index: DataFrame, shingle: int) -> DataFrame:
    """(k, k2, first, tokens) of the different lines that share enough listed tokens with lines of another hash to match one."""
    listed = index.filter("token is not null").select("k", "need", "token")
    shared = kept(listed.groupBy("token").agg(F.min("k").alias("a"), F.max("k").alias("b")).filter("a <> b").select("token"))
    # Inner joins, as Spark would move a semi-join below the bitmap's.
    found = maybe_in(listed, "token", shared).join(shared, "token").select("k", "need", "token").repartition("k").distinct()
    suspect = kept(found.groupBy("k").agg(F.count("*").alias("n"), F.min("need").alias("need")).filter("n >= need").select("k"))
    bits = bitmap("k", suspect)
    pair = kept(maybe_in(index.filter("line is not null").select("k", "k2"), "k", bits).distinct().join(suspect, "k"))  # a line's copies meet before the join
    keyed = lines.select(F.xxhash64("body").alias("k"), F.xxhash64("body", F.lit(1)).alias("k2"), "id", "row", "line", "body")
    folded = maybe_in(keyed, "k", bits).groupBy("k", "k2").agg(F.min(F.struct("id", "row", "line")).alias("first"), F.any_value("body").alias("body"))
    split = folded.join(pair, ["k", "k2"]).withColumn("words", F.array_remove(F.split("body", " "), ""))
    found = kept(split.select("k", "k2", "first", _tokens(shingle).alias("tokens")))
    dropped(shared, suspect, bits, pair)
    return found


def _similar(a: str, b: str, similarity: float) -> Column:
    # shared >= similarity * (total - shared), with `shared` named once: so it is worked out once a pair.
    shared, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return (F.least(F.size(a), F.size(b)) >= F.greatest(F.size(a), F.size(b)) * similarity - 1e-9) & (shared * (1 + similarity) >= total * similarity - 1e-9)


def _may_match(similarity: float) -> Column:
    """The length and positional filters: whether lines of n and x_n tokens that share their at-th and x_at-th may match."""
    most = F.least("x_at", "at") + F.least(F.col("x_n") - F.col("x_at"), F.col("n") - F.col("at"))
    return (F.least("x_n", "n") >= F.greatest("x_n", "n") * similarity - 1e-9) & (most >= (F.col("x_n") + F.col("n")) * (similarity / (1 + similarity)) - 1e-9)


def _verified(pairs: DataFrame, ranked: DataFrame, similarity: float) -> DataFrame:
    """(no): those of the distinct (no, x) pairs that are similar. Tokens are moved, as making them anew costs far more."""
    both = pairs.join(ranked, "no").join(ranked.withColumnsRenamed({"no": "x", "tokens": "x_tokens"}), "x")
    return both.filter(_similar("tokens", "x_tokens", similarity)).select("no").distinct()


def _near(lines: DataFrame, similarity: float, crowd: int) -> DataFrame:
    """(k, k2): those of `lines` (k, k2, first, tokens) that some earlier one matches. Lines are numbered in their order: one long is moved for each."""
    numbered = kept(lines.orderBy("first").select(F.monotonically_increasing_id().alias("no"), "k", "k2", _by_rarity(F.col("tokens"), token_levels(lines)).alias("tokens")))
    ranked, n = numbered.select("no", "tokens"), F.size("tokens")
    listed = kept(ranked.select("no", n.alias("n"), F.posexplode_outer(F.slice("tokens", F.lit(1), _prefix(n, similarity))).alias("at", "token")))
    leads = kept(listed.groupBy("token").agg(F.count("*").alias("df"), F.min("no").alias("x")).filter("df > 1"))
    followers = kept(maybe_in(listed, "token", leads).join(leads, "token").filter("no <> x"))
    copies = kept(_verified(followers.select("no", "x").distinct(), ranked, similarity))
    # The others, under tokens that hold more than them and the line just tried.
    rest = kept(followers.filter("df > 2").join(copies, "no", "left_anti"))
    held = kept(rest.select("token").distinct())
    earlier = kept(maybe_in(listed, "token", held).join(held, "token").select("token", *(F.col(c).alias(f"x_{c}") for c in ("no", "n", "at"))))
    dropped(listed, leads, followers, held)
    fits = (F.col("x_no") < F.col("no")) & (F.col("x_no") != F.col("x")) & _may_match(similarity)
    pairs = rest.filter(F.col("df") <= crowd).join(earlier, "token").filter(fits)
    pairs = kept(pairs.select("no", F.col("x_no").alias("x")).distinct())
    few = kept(_verified(pairs, ranked, similarity))
    found = [copies, few]
    crowded = rest.filter(F.col("df") > crowd)
    if not crowded.isEmpty():
        crowded = kept(crowded.join(few, "no", "left_anti").join(ranked, "no"))
        others = earlier.join(crowded.select("token").distinct(), "token", "left_semi")
        others = kept(others.join(ranked.withColumnsRenamed({"no": "x_no", "tokens": "x_tokens"}), "x_no").withColumnRenamed("token", "x_token"))
        many = crowded.join(others, (F.col("token") == F.col("x_token")) & fits & _similar("tokens", "x_tokens", similarity), "left_semi")
        found.append(kept(many.select("no").distinct()))
        dropped(crowded, others)
    near = kept(numbered.select("no", "k", "k2").join(reduce(DataFrame.unionByName, found), "no").select("k", "k2"))
    dropped(numbered, rest, earlier, pairs, *found)
    return near


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(id, row, removed): for every document that loses lines, their numbers from 0, ascending.

    Null and empty texts and lines without a word lose nothing. Rows that repeat an id keep their own lines, and come in
    the order of their texts' hashes, `row`, which is 0 where no id repeats; rows that repeat both are one document. A
    null id comes first. An empty table gives no rows.
    """
    lines = _lines(_chosen(docs, id_col, text_col))
    index = kept(_index(lines, shingle, similarity))
    at = F.struct("id", "row", "line")
    heads = index.filter("line is not null")
    again = heads.groupBy("k", "k2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    suspects = _suspects(lines, index, shingle)
    matched = _near(suspects, similarity, crowd)
    near = matched.join(suspects, ["k", "k2"])
    doomed = again.select("k", "k2", "first", F.lit(False).alias("gone")).unionByName(near.select("k", "k2", "first", F.lit(True).alias("gone")))
    doomed = kept(doomed.groupBy("k", "k2").agg(F.any_value("first").alias("first"), F.max("gone").alias("gone")))
    dropped(suspects)
    gone = maybe_in(heads.select("k", "k2", "id", "row", "line"), "k", doomed).join(doomed, ["k", "k2"]).filter(F.col("gone") | ~at.eqNullSafe(F.col("first")))
    found = kept(gone.groupBy("id", "row").agg(F.sort_array(F.collect_set("line")).alias("removed")))
    dropped(index, doomed)
    return found


def _marked(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """`docs` (with `__hash` of the text) with the numbers of the lines that go, `__removed`, null where none goes."""
    gone = gone.select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("removed").alias("__removed"))
    own = F.col(id_col).eqNullSafe(F.col("__id")) & ((F.col("__row") == 0) | (F.col("__row") == F.col("__hash")))
    return docs.join(gone, own, "left").drop("__id", "__row", "__hash")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with the lines of `removed_lines` taken out of the text; a text that loses its last word goes with its row.

    All columns stay; `n_chars`, where there is one, is counted anew. Documents that lose no line are as they were.
    """
    gone = removed_lines(docs, id_col, text_col, **how)
    # Documents that surely lose no line aren't moved.
    hashed, marks = docs.withColumns({"__of": F.xxhash64(id_col), "__hash": F.xxhash64(text_col)}), gone.select(F.xxhash64("id").alias("__of"))
    joined = _marked(maybe_in(hashed, "__of", marks), gone, id_col)
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    out = joined.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(left))
    out = out.filter(F.col("__removed").isNull() | F.col(text_col).rlike(r"[^ \t-\r]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return maybe_in(hashed, "__of", marks, others=True).select(docs.columns).unionByName(out.select(docs.columns))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines, comma-joined."""
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    docs = documents(spark, sf_dir)
    gone = removed_lines(docs)
    return _marked(docs.select("doc_id", n_lines.alias("n_lines"), F.xxhash64("text").alias("__hash")), gone, "doc_id").select(
        "doc_id", "n_lines", F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("__removed", ","), F.lit("")).alias("removed"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, n - 1 AS line, list_filter(string_split_regex(lower(raw), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
uniq AS (SELECT array_to_string(w, ' ') AS body, min((doc_id, line)) AS first, any_value(w) AS w FROM lines WHERE len(w) >= 1 GROUP BY 1),
tokens AS (
  SELECT DISTINCT body, array_to_string(w[o : o + 4], ' ') AS token FROM (SELECT body, w, unnest(range(1, greatest(len(w) - 3, 2))) AS o FROM uniq)),
sizes AS (SELECT body, count(*) AS n FROM tokens GROUP BY 1),
shared AS (SELECT a.body AS x, b.body AS y, count(*) AS c FROM tokens a JOIN tokens b ON a.token = b.token AND a.body <> b.body GROUP BY 1, 2),
near AS (
  SELECT DISTINCT s.y AS body FROM shared s JOIN sizes p ON p.body = s.x JOIN sizes q ON q.body = s.y
  JOIN uniq u ON u.body = s.x JOIN uniq v ON v.body = s.y WHERE 5 * s.c >= 4 * (p.n + q.n - s.c) AND u.first < v.first),
gone AS (
  SELECT l.doc_id, l.line FROM lines l JOIN uniq u ON u.body = array_to_string(l.w, ' ')
  WHERE (l.doc_id, l.line) <> u.first OR u.body IN (SELECT body FROM near)),
by_doc AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(b.n, 0) AS n_removed, coalesce(b.removed, '') AS removed
FROM documents d LEFT JOIN by_doc b USING (doc_id)
"""
