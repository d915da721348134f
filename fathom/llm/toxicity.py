"""Toxicity: a learned lexicon in a trie, intersected with Levenshtein automata, and context windows around its hits.

Terms are learned from labelled documents: whole words, and stems that open many toxic words. The trie's whole words of
at least five letters are matched within one edit: the automaton's states are sets of (trie node, edits), made
deterministic once into a table, and all words of a slice of texts are stepped through it together.
Each hit is looked at in its window of words: hits inside quotation marks count apart from the others, and
crowded windows weigh more. A logistic model over these counts gives the score.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, documents, picked
from .vec import runs

#: Labelled documents that the model is fitted on, at most, of each class: those of the smallest id hash.
TOXIC_MOST, CLEAN_MOST = 4000, 6000
#: Terms of the lexicon.
TERMS_MOST = 300
#: Letters of a stem; letters from which a word is matched with one edit; words on each side of a hit.
STEM, FUZZY_FROM, WINDOW = (4, 8), 5, 20
#: Toxic documents that must hold a term, and how many of its documents may be clean by rates.
HELD_BY, IMPURE = 6, 0.04
DEAD = 0
NONE, WORD, NEAR, STEMMED = range(4)
FEATURES = 7


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x3000)], bool)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts and their rows' offsets; start, end and row of each word."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    table = _letters()
    member = table[np.minimum(codes, len(table) - 1)] | (codes >= len(table))
    return codes, ends, *runs(member, ends)


def text_slices(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Whole texts (null: empty) in runs of about `most` characters, with the row of the first."""
    start, held, size = 0, [], 0
    for t in column:
        t = t.as_py() or ""
        if held and size + len(t) > most:
            yield start, held
            start, held, size = start + len(held), [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


@dataclass
class Automaton:
    """A deterministic table of the lexicon's trie and its Levenshtein automata. State 0 is dead, 1 the start."""

    step: np.ndarray  # state x letter class -> state
    accept: np.ndarray  # at a word's end: NONE, WORD or NEAR; a stem's state is STEMMED and final
    letters: np.ndarray  # sorted code points; a code point's class is its place + 1, or 0

    @classmethod
    def of(cls, words: list[str], stems: list[str], fuzzy_from: int = FUZZY_FROM) -> Automaton:
        child: list[dict[str, int]] = [{}]
        word, stem, near = [False], [False], [False]
        for term, kind in [*((w, 0) for w in words), *((s, 1) for s in stems)]:
            path = [0]
            for c in term:
                node = child[path[-1]].get(c)
                if node is None:
                    node = child[path[-1]][c] = len(child)
                    child.append({})
                    word.append(False)
                    stem.append(False)
                    near.append(False)
                path.append(node)
            (stem if kind else word)[path[-1]] = True
            if not kind and len(term) >= fuzzy_from:
                for node in path:
                    near[node] = True  # some word below may be matched with an edit
        long = {node for w in words if len(w) >= fuzzy_from for node in [cls._walk(child, w)]}
        alphabet = sorted({c for t in [*words, *stems] for c in t})

        def closed(states: set[tuple[int, int]]) -> frozenset:
            """With the words that miss a letter; (node, 1) says nothing where (node, 0) is."""
            states = states | {(x, 1) for n, e in states if not e for x in child[n].values() if near[x]}
            return frozenset((n, e) for n, e in states if not e or (n, 0) not in states)

        def after(states: frozenset, c: str | None) -> frozenset:
            out = set()
            for n, e in states:
                if c in child[n] and (not e or near[child[n][c]]):
                    out.add((child[n][c], e))
                if not e:
                    if near[n]:
                        out.add((n, 1))
                    out |= {(x, 1) for x in child[n].values() if near[x]}
            return closed(out)

        start = closed({(0, 0)})
        number, queue, step, accept = {frozenset(): DEAD, start: 1}, [start], {}, {DEAD: NONE}
        for states in queue:
            at = number[states]
            if any(stem[n] and not e for n, e in states):
                accept[at], step[at] = STEMMED, [at] * (len(alphabet) + 1)
                continue
            accept[at] = WORD if any(word[n] and not e for n, e in states) else NEAR if any(n in long and e for n, e in states) else NONE
            row = []
            for c in [None, *alphabet]:
                to = after(states, c)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                row.append(number[to])
            step[at] = row
        table = np.array([[DEAD] * (len(alphabet) + 1)] + [step[k] for k in range(1, len(number))], np.int32)
        return cls(table, np.array([accept[k] for k in range(len(number))], np.int8), np.array([ord(c) for c in alphabet], np.uint32))

    @staticmethod
    def _walk(child: list[dict[str, int]], word: str) -> int:
        node = 0
        for c in word:
            node = child[node][c]
        return node

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each word is; all words are stepped together, and those that died are left behind."""
        out = np.zeros(len(starts), np.int8)
        if not len(self.letters) or not len(starts):
            return out
        at = np.searchsorted(self.letters, codes)
        kind = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == codes, at + 1, 0)
        who, place, state = np.arange(len(starts)), starts.copy(), np.ones(len(starts), np.int32)
        while len(who):
            state = self.step[state, kind[place]]
            place = place + 1
            over = (place == ends[who]) | (self.accept[state] == STEMMED)
            out[who[over]] = self.accept[state[over]]
            go = ~over & (state != DEAD)
            who, place, state = who[go], place[go], state[go]
        return out


def _quoted(codes: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place is inside quotation marks of its own line."""
    straight = np.cumsum(codes == 0x22)
    curly = np.cumsum(np.isin(codes, (0x201C, 0x201E, 0xAB)).astype(np.int64) - np.isin(codes, (0x201D, 0xBB)))
    lines = np.union1d(ends[:-1], np.flatnonzero(codes == 10) + 1)
    line = lines[np.searchsorted(lines, places, side="right") - 1]
    before = np.maximum(line - 1, 0)
    base = lambda total: np.where(line > 0, total[before], 0)
    return ((straight[places] - base(straight)) % 2 == 1) | (curly[places] - base(curly) > 0)


def features(automaton: Automaton, known: set[str], texts: list[str]) -> np.ndarray:
    """For each text: a 1, logs of its unquoted words, near words and stems, of quoted hits, of the most hits in a window,
    and of hits per thousand words. `known` words are no misspellings."""
    codes, ends, starts, stops, row = words_of(texts)
    kind = automaton.run(codes, starts, stops)
    for i in np.flatnonzero(kind == NEAR).tolist():
        if "".join(map(chr, codes[starts[i] : stops[i]].tolist())) in known:
            kind[i] = NONE
    hit = np.flatnonzero(kind)
    quoted = _quoted(codes, ends, starts[hit]) if len(hit) else np.zeros(0, bool)
    n = len(texts)
    count = lambda at: np.bincount(row[hit[at]], minlength=n)
    most = np.zeros(n)
    if len(hit):
        open_ = hit[~quoted]
        # Hits in the window that begins at each hit, in its own document.
        upto = np.minimum(np.searchsorted(open_, open_ + 2 * WINDOW + 1), np.searchsorted(row[open_], row[open_], side="right"))
        np.maximum.at(most, row[open_], upto - np.arange(len(open_)))
    words = np.bincount(row, minlength=n)
    counts = [count(~quoted & (kind[hit] == k)) for k in (WORD, NEAR, STEMMED)]
    rate = 1000 * sum(counts) / np.maximum(words, 1)
    return np.stack([np.ones(n), *(np.log1p(c) for c in counts), np.log1p(count(quoted)), np.log1p(most), np.log1p(rate)], axis=1)


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean): documents of the sample (text, toxic) of each class that hold a word or stem."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            for first, texts in text_slices(batch.column("text"), 1 << 20):
                held: dict[tuple[str, bool], list[int]] = {}
                for label, text in zip(labels[first:], texts, strict=False):
                    codes, _, starts, stops, _ = words_of([text])
                    low = text.lower()
                    own = {low[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)}
                    terms = {(w, False) for w in own if len(w) >= 3} | {(w[:k], True) for w in own for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}
                    for t in terms:
                        held.setdefault(t, [0, 0])[0 if label else 1] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in held], pa.string()), pa.array([s for _, s in held], pa.bool_()), pa.array([c[0] for c in held.values()], pa.int64()), pa.array([c[1] for c in held.values()], pa.int64())],
                    ["term", "stem", "toxic", "clean"],
                )

    return sample.select("text", "toxic").mapInArrow(work, "term string, stem boolean, toxic long, clean long").groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(rows: list[tuple[str, bool, int]], most: int = TERMS_MOST) -> tuple[list[str], list[str]]:
    """Words and stems from pure (term, stem, toxic documents): a stem must open more documents' words than its best
    word alone, the shortest such stem covers what it opens, and the most frequent terms are taken."""
    best = Counter()
    for t, stem, n in rows:
        if not stem:
            for k in range(STEM[0], len(t)):
                best[t[:k]] = max(best[t[:k]], n)
    stems: set[str] = set()
    for t, n in sorted(((t, n) for t, stem, n in rows if stem), key=lambda x: (len(x[0]), x[0])):
        if n >= 1.5 * best[t] and not any(t[:k] in stems for k in range(STEM[0], len(t))):
            stems.add(t)
    kept = [(n, t, stem) for t, stem, n in rows if (t in stems if stem else not any(t[:k] in stems for k in range(STEM[0], len(t) + 1)))]
    kept = heapq.nlargest(most, kept)
    return sorted(t for _, t, stem in kept if not stem), sorted(t for _, t, stem in kept if stem)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps; the first column is the constant and isn't shrunk."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    shrink = np.full(x.shape[1], l2)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (weight * (y - p)) - shrink * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    automaton: Automaton
    words: list[str]
    stems: list[str]
    known: set[str]
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, toxic_most: int = TOXIC_MOST, clean_most: int = CLEAN_MOST) -> Model:
    """Learns from the labelled rows of (id, text) and (id, toxic), at most so many of each class by the id's hash.

    Without toxic rows the lexicon is empty and every score is the class share, near 0.
    """
    labels = checkpointed(labels.filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("id")))
    totals = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    chosen = [labels.filter(f"toxic = {k}").orderBy("h", "id").limit(most) for k, most in ((1, toxic_most), (0, clean_most))]
    sample = checkpointed(docs.join(F.broadcast(chosen[0].unionByName(chosen[1]).select("id", "toxic")), "id").select("text", "toxic"))
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
    counts = checkpointed(_term_counts(sample))
    pure = counts.filter((F.col("toxic") >= HELD_BY) & (F.col("clean") / good <= IMPURE * F.col("toxic") / bad))
    rows = [(r.term, r.stem, r.toxic) for r in pure.orderBy(F.desc("toxic"), "term", "stem").limit(20 * TERMS_MOST).collect()]
    words, stems = lexicon(rows)
    automaton = Automaton.of(words, stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [t.as_py() for t in batch.column("term")]
            codes, ends, *_ = words_of(terms)
            yield batch.filter(pa.array(automaton.run(codes, ends[:-1], ends[1:]) == NEAR))

    # Words of the sample's clean documents within an edit of a term are words of their own; the terms bound their number.
    known = {r.term for r in counts.filter("not stem and clean >= 1").select("term").mapInArrow(near, "term string").collect()}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_ = batch.column("toxic").to_pylist()
            for first, texts in text_slices(batch.column("text")):
                x = features(automaton, known, texts)
                yield pa.RecordBatch.from_arrays([pa.array(labels_[first : first + len(texts)], pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    table = sample.mapInArrow(numbers, "y int, x array<double>").toArrow()
    if not table.num_rows:
        return Model(automaton, words, stems, known, np.array([-10.0] + [0.0] * (FEATURES - 1)))
    y, x = table.column("y").to_numpy().astype(float), np.array(table.column("x").to_pylist())
    share = {k: totals.get(k, 0) / max(sum(totals.values()), 1) for k in (0, 1)}
    have = {k: max((y == k).mean(), 1e-9) for k in (0, 1)}
    return Model(automaton, words, stems, known, logistic(x, y, np.where(y == 1, share[1] / have[1], share[0] / have[0])))


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    z = [features(model.automaton, model.known, texts) @ model.weights for _, texts in text_slices(column)]
    return 1 / (1 + np.exp(-np.clip(np.concatenate([*z, np.zeros(0)]), -30, 30)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score) for every row of (id, text): the chance of being toxic.

    Null and empty texts have no hits, and the score of such texts; every row has its own, whatever its id; an empty
    table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_scores(model, batch.column("text")))], ["id", "score"])

    return docs.mapInArrow(work, f"id {docs.schema['id'].dataType.simpleString()}, score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score is below `reject`; all columns stay, whatever their names, in one pass without a shuffle.

    Only the texts go to Python. Null and empty texts have no hits; rows that repeat an id are judged by their own texts.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(model, texts))

    return docs.filter(score(text_col) < reject)


def held_out(id_col: str = "doc_id", fold: int = 5, at: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == at


def fitted(spark, sf_dir: str) -> Model:
    """The model of the registered query and of the pipeline: folds 1 to 4 of 5 by the id's checksum."""
    labels = documents(spark, sf_dir, "labels").filter(~held_out())
    return fit(picked(documents(spark, sf_dir)), labels.select(F.col("doc_id").alias("id"), "toxic"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    found = scored(picked(documents(spark, sf_dir)), fitted(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
