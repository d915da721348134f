"""Language and toxicity by plain loops over characters and words, and the bounds of what a fit or a task holds."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import language, line_quality, toxicity
from fathom.llm.vec import slices

TEXTS = ["Hello World, the cat sat.", "", "123 !!", "Où est l'été ? Ça va très bien", "der Hund \"und\" die Katze\nzwei", "ñandú  ñ", "a", "x y z " * 50, "Ünïcödé テスト 文字"]


def brute_counts(text: str) -> dict[int, int]:
    kept = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    out: dict[int, int] = {}
    for n in (2, 3):
        for i in range(len(kept) - n + 1):
            gram = kept[i : i + n]
            if any(b != 32 for b in gram):
                code = 0
                for b in gram:
                    code = code * 257 + b
                signed = (code * 0x9E3779B1 + (1 << 63)) % (1 << 64) - (1 << 63)
                place = (signed >> 15) % language.DIMENSIONS
                out[place] = out.get(place, 0) + 1
    return out


def test_language_against_plain_loops(spark):
    train = [(i, t, v) for i, (t, v) in enumerate([("the cat and the dog sat on the mat", "en"), ("le chat et le chien sur le tapis", "fr"), ("der hund und die katze auf der matte", "de")] * 30)]
    rows = spark.createDataFrame(train + [(900, None, "en"), (901, "the cat", None)], "id long, text string, lang string")
    model = language.fit(rows)
    seen: dict[int, int] = {}
    for _, t, _ in train:
        for k in brute_counts(t):
            seen[k] = seen.get(k, 0) + 1
    for k in range(0, language.DIMENSIONS, 97):
        assert model.idf[k] == pytest.approx(math.log((1 + len(train)) / (1 + seen.get(k, 0))) + 1)
    docs = spark.createDataFrame([*enumerate(TEXTS), (100, None), (100, "der hund")], "id long, text string")
    got = {(r.id, r.lang_pred): r for r in language.identified(docs, model).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, text in [*enumerate(TEXTS), (100, None), (100, "der hund")]:
        if not any(c.isalpha() for c in text or ""):
            want, score = "und", 0.0
        else:
            x = np.zeros(language.DIMENSIONS)
            for k, n in brute_counts(text).items():
                x[k] = math.sqrt(n) * model.idf[k]
            cosine = [float(c @ x) / max(math.sqrt(float(x @ x)), 1e-12) for c in model.centroids]
            want, score = model.langs[int(np.argmax(cosine))], min(max(*cosine, 0.0), 1.0)
        assert got[i, want].score == pytest.approx(score, abs=1e-9) and got[i, want].rejected == (score < language.REJECT)


def test_short_texts_are_taken_in_small_slices():
    column = pa.array(["ein kurzer text"] * 10_000)
    assert max(b - a for a, b, *_ in slices(column, most_rows=language.ROWS)) == language.ROWS


def test_toxicity_features_against_plain_loops():
    rng = random.Random(5)
    terms, stems = ["vile", "rotten", "hateful"], ["scum"]
    automaton = toxicity.Automaton.of(terms, stems)
    pool = ["vile", "rotten", "roten", "hateful", "hatefull", "scummy", "plain", "word", "other", "good", "rottens"]
    texts = ["", '"vile" rotten', "he said “rotten vile” and vile"]
    for _ in range(60):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(['"', "\n", "“", "”", "»", "«"]))
        texts.append(" ".join(words))
    known = {"rottens"}
    got = toxicity.features(automaton, known, texts)
    for text, row in zip(texts, got, strict=True):
        words, quoted, straight, curly, current = [], [], 0, 0, ""
        for c in text.lower() + " ":
            if c.isalnum():
                if not current:
                    quoted.append(straight % 2 == 1 or curly > 0)
                current += c
                continue
            if current:
                words.append(current)
                current = ""
            straight, curly = (0, 0) if c == "\n" else (straight + (c == '"'), curly + (c in "“„«") - (c in "”»"))
        kinds = [0 if w in known else toxicity.WORD if w in terms else toxicity.STEMMED if w.startswith("scum") else toxicity.NEAR if w in ("roten", "hatefull", "rottens") else 0 for w in words]
        open_ = [i for i, k in enumerate(kinds) if k and not quoted[i]]
        counts = [sum(kinds[i] == k for i in open_) for k in (toxicity.WORD, toxicity.NEAR, toxicity.STEMMED)]
        most = max([sum(i <= j <= i + 2 * toxicity.WINDOW for j in open_) for i in open_], default=0)
        in_quotes = sum(1 for k, q in zip(kinds, quoted, strict=True) if k and q)
        want = [1, *map(math.log1p, counts), math.log1p(in_quotes), math.log1p(most), math.log1p(1000 * sum(counts) / max(len(words), 1))]
        assert row.tolist() == pytest.approx(want), text


def test_toxicity_stage_judges_each_row_by_its_text(spark):
    model = toxicity.Model(toxicity.Automaton.of(["vile"], []), ["vile"], [], set(), np.array([-2.0, 4, 0, 0, 0, 0, 0]))
    docs = spark.createDataFrame([(1, "vile vile", 0.5), (1, "fine", 0.5), (None, "vile vile", 0.1), (2, None, 0.2), (3, "", 0.3), (3, "", 0.3)], "doc_id long, text string, score double")
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "fine"), (2, ""), (3, ""), (3, "")]
    assert toxicity.clean(docs.limit(0), model).count() == 0


def test_quality_fit_takes_whole_documents_up_to_its_lines(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {k} of words that are plain" for k in range(5)) if i % 2 else "buy now !!!\n" * 5) for i in range(40)]
    docs, labels = spark.createDataFrame([*rows, (999, None)], "id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(999, 1), (None, 1)], "id long, quality int")
    taken = []
    train = line_quality.train
    monkeypatch.setattr(line_quality, "train", lambda x, row, size, label: (taken.append((len(x), len(label))), train(x, row, size, label))[1])
    line_quality.fit(docs, labels)
    monkeypatch.setattr(line_quality, "LINES_MOST", 60)
    line_quality.fit(docs, labels)
    monkeypatch.setattr(line_quality, "LINES_MOST", 3)
    assert line_quality.fit(docs, labels).scores(np.zeros((0, line_quality.OWN)), np.zeros(0, int), np.zeros(0), 1).tolist() == [0.5]
    assert taken[0][1] == 40 and 8 <= taken[1][1] <= 12
