"""Line dedup, packing, page text and the pipeline: brute force, round trips, and rows of every odd kind."""

import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import common, html_text, line_dedup, packing, toxicity
from fathom.llm.bpe import Codec

ODD = [(None, "a b c d e f g", "x", 1), (1, None, "b", 2), (2, "", "c", 3), (3, "  \n\t ", "d", 4), (4, "one two three four five", "e", 5), (4, "one two three four five", "e", 5), (5, "word " * 30_000, "f", 6)]
NAMES = "doc_id long, text string, id string, key long"


def removed(rows: list[tuple], shingle: int, similarity: float) -> dict:
    """The lines that go, with all pairs of lines compared; fewer words than `shingle` make one token."""
    lines = {}
    for i, text in sorted(set(rows), key=lambda r: (r[0], r[1] or "")):
        for k, line in enumerate((text or "").split("\n")):
            if w := line.lower().split():
                lines[i, k] = tuple(w)
    first = {}
    for at, w in sorted(lines.items()):
        first.setdefault(w, at)
    tokens = {w: {w[o : o + shingle] for o in range(max(1, len(w) - shingle + 1))} for w in first}
    near = {b for b in first for a in first if first[a] < first[b] and len(tokens[a] & tokens[b]) >= similarity * len(tokens[a] | tokens[b]) - 1e-9}
    out = defaultdict(list)
    for at, w in sorted(lines.items()):
        if at != first[w] or w in near:
            out[at[0]].append(at[1])
    return dict(out)


@pytest.mark.parametrize(("seed", "crowd"), [(1, 64), (2, 1)])
def test_lines_against_all_pairs(spark, seed, crowd):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    known = [[rng.choice(words) for _ in range(rng.randint(1, 24))] for _ in range(12)]

    def line() -> str:
        w = list(rng.choice(known))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            w[rng.choice((0, -1, rng.randrange(len(w))))] = rng.choice(words)
        return rng.choice((" ", "\t", "  ")).join(w).replace("w1", rng.choice(("w1", "W1")))

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 8)))) for i in range(60)]
    got = {r.id: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, crowd=crowd).collect()}
    assert got == removed(rows, 3, 0.8)


def test_lines_that_quote_one_passage_are_no_suspects(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, seen, near = text(7), [], line_dedup._near
    rows = [(i, f"{text(12)} {passage} {text(12)}") for i in range(80)]
    rows += [(100 + i, " ".join(f"x{i}.{j}" for j in range(n))) for i, n in enumerate((4, 5, 6, 7, 8, 9, 12))]
    rows += [(200, rows[0][1] + " end"), *((300 + r[0], r[1] + " end") for r in rows[80:])]  # of n + 1 words; 0.8 or more from nine words on

    def counted(lines, *how):
        seen.append(lines.count())
        return near(lines, *how)

    monkeypatch.setattr(line_dedup, "_near", counted)
    got = {r.id: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed(rows, 5, 0.8) and set(got) == {200, 404, 405, 406}
    assert seen[0] <= 12


def test_tokens_of_suspects_are_made_once(spark, monkeypatch):
    made, tokens = [], line_dedup._tokens
    monkeypatch.setattr(line_dedup, "_tokens", lambda *how: made.append(how) or tokens(*how))
    rows = [(1, " ".join(f"w{k}" for k in range(20)) + "\n" + "go " * 40), (2, " ".join(f"w{k}" for k in range(21)) + "\n" + "go " * 41), (3, "go go go go\nalone")]
    got = {r.id: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed(rows, 5, 0.8) and set(got) == {2} and len(made) == 1


def test_bitmap_probe_keeps_all_values_and_splits_the_rows(spark):
    values = spark.range(-500, 500).select(F.xxhash64("id").alias("h"))
    rows = spark.range(-3000, 3000).select(F.xxhash64("id").alias("h"))
    inside, outside = ([r.h for r in common.maybe_in(rows, "h", values, others).collect()] for others in (False, True))
    assert {r.h for r in values.collect()} <= set(inside) and len(inside) < 1010 and len(inside) + len(outside) == 6000


def test_lines_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, NAMES)
    kept = line_dedup.deduplicated(docs)
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect())) and kept.columns == docs.columns
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    more = docs.unionByName(spark.createDataFrame([(9, "short\nONE two three  four five", "z", 0), (10, "one two three four five", "z", 0)], NAMES))
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(more).filter("doc_id >= 9").collect()} == {9: "short"}


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(1, "a b c d e f g h"), (7, "a b c d e f g h"), (7, "q r s t u v w x"), (None, "null one two three four five"), (None, "null six seven eight nine ten"), (8, "null one two three four five"), (8, "kept\nq r s t u v w x\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in line_dedup.deduplicated(docs).collect()))
    assert got == sorted([(1, "a b c d e f g h"), (7, "q r s t u v w x"), (0, "null one two three four five"), (0, "null six seven eight nine ten"), (8, "kept\n")])


def test_short_lines_and_the_query_on_odd_rows(spark, tmp_path):
    rows = [(3, "click  here now\nbody one\nClick here now"), (5, "click here now"), (None, "click here\tnow\nx"), (None, ""), (6, None), (6, "body two\n\n")]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, row string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_removed, r.removed) for r in line_dedup.op6_line_dedup(spark, str(tmp_path)).collect())
    assert got == [(0, 1, 0, ""), (0, 2, 0, ""), (3, 3, 2, "0,2"), (5, 1, 1, "0"), (6, 0, 0, ""), (6, 3, 0, "")]


def test_removed_lines_leave_no_large_table_behind(spark, monkeypatch):
    held = {}

    def watched(df):
        out = common.kept(df)
        held[out.kept_at.removeprefix("file:")] = df.columns
        return out

    monkeypatch.setattr(line_dedup, "kept", watched)
    docs = spark.createDataFrame([(1, "a b c d e f g h\nx"), (2, "a b c d e f g h i\ny")], "doc_id long, text string")
    assert line_dedup.removed_lines(docs).count() == 1
    left = [columns for path, columns in held.items() if os.path.isdir(path)]
    assert ["id", "row", "removed"] in left and not any({"body", "prefix", "gone"} & set(columns) for columns in left)


def test_pipeline_sends_small_batches_to_python(spark):
    name, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame(ODD, NAMES)
    for given, want in (("10000", 1000), ("0", 1000), ("50", 50)):
        spark.conf.set(name, given)
        assert corpus_pipeline.tokenise(spark, docs, "").count() == len(ODD) and int(spark.conf.get(name)) == want
    spark.conf.unset(name)


def test_kept_leaves_no_shuffle_files_and_dropped_no_table(spark):
    before = spark.conf.get(common.SHUFFLE_CLEANUP)
    table = common.kept(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    path = table.kept_at.removeprefix("file:")
    assert table.count() == 7 and os.path.isdir(path) and spark.conf.get(common.SHUFFLE_CLEANUP) == before
    common.dropped(table)
    assert not os.path.exists(path)


def test_packing_is_whole_and_best_fit(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 32) for _ in range(300)]
    rooms: list[int] = []
    for s in sorted(sizes, reverse=True):
        if fit := [r for r in rooms if r >= s]:
            rooms[rooms.index(min(fit))] -= s
        else:
            rooms.append(32 - s)
    made = packing.best_fit_decreasing(sizes, 32)
    assert sorted(i for row in made for i in row) == list(range(300))
    assert sorted(32 - sum(sizes[i] for i in row) for row in made) == sorted(rooms)

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(i, f"text {i} " * rng.randint(0, 60)) for i in range(80)] + [(80, None)], "doc_id long, text string")
    tokens = packing.token_ids(docs, path, public_tokenizers.PATTERN)
    rows = packing.packed(tokens, 64, 1000)
    found = defaultdict(bytes)
    for r in packing.unpacked(rows).orderBy("doc_id", "start").collect():
        assert r.start == len(found[r.doc_id]) // 2
        found[r.doc_id] += bytes(r.ids)
    assert dict(found) == {r.id: np.frombuffer(r.ids, "<u4").astype("<u2").tobytes() for r in tokens.collect() if r.ids}
    for r in rows.collect():
        assert len(r.ids) == len(r.positions) == 128 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert np.frombuffer(r.positions, "<u2")[a:b].tolist() == list(range(b - a))
    assert rows.select("pack_id").distinct().count() == rows.count()


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, NAMES)
    tokens = packing.token_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = packing.unpacked(packing.packed(tokens)).groupBy("doc_id").agg(F.sum(F.length("ids") / 2).alias("n")).collect()
    want = tokens.groupBy("id").agg(F.sum(F.length("ids") / 4).alias("n")).filter("n > 0").collect()
    assert {(r.doc_id, r.n) for r in got} == {(r.id, r.n) for r in want}
    assert packing.packed(tokens.limit(0)).count() == 0


def page(body: str, host: str = "a.org", k: int = 0) -> tuple:
    return f"http://{host}/{k}", f"<html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_recurring_subtrees_go_and_the_rest_stays(spark):
    rows = [page(f"<div><p>Read our site</p><ul><li>Home<li>About</ul></div><div><p>Story {k} &amp;\n more</p><p>{k} end<b>ing</b></p></div><div>Copyright</div>", k=k) for k in range(8)]
    rows += [page("<div>Copyright</div><p>one page</p>", "b.org"), page("<nav>Menu</nav><article><h1>T</h1><p>x &lt; y</p><script>no()</script></article><aside>ad</aside>", "b.org", 1), ("u", None), (None, ""), ("u", "<p>open <i>text")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    for most in (1000, 0):  # broadcast or joined
        got = [r.text for r in html_text.extracted(pages, broadcast_rows=most).orderBy("page_id").collect()]
        assert got == [f"Story {k} & more {k} ending" for k in range(8)] + ["Copyright one page", "T x < y", "", "", "open text"]
    assert html_text.extracted(pages.limit(0)).count() == 0


def extract(html: str) -> str:
    return html_text.Page(html).text()


def test_marks_are_read_from_attributes_and_wrappers_stay():
    body = "<p>One story of some length.</p><p>It goes on.</p>"
    story = "One story of some length. It goes on."
    for own in ('style="overflow:hidden"', 'title="hidden gems"', 'data-id="nav"', 'class="layout has-sidebar"', 'class="no-sidebar content"', 'id="comments-on-kant"', 'class="menu"', "role=form"):
        assert extract(f"<body><div {own}><article>{body}</article></div></body>") == story
        assert extract(f"<body><nav>Menu</nav><div {own}>{body}</div></body>") == story
    for box in ('<div class="ad">buy</div>', '<div id="cookie-notice">ok?</div>', "<aside>more</aside>", '<article class="comment">so true</article>', '<section class="comments"><article>so true</article></section>', "<form>mail <textarea>x</textarea></form>", "<div hidden>h</div>", "<script>a<b</script>", "<style>p{}</style>"):
        assert extract(f"<body>{box}<article>{body}</article>{box}</body>") == story
        assert extract(f"<body><article>{body}{box}</article></body>") == story
    assert extract("<article><header><h1>Title</h1></header><p>a <math><mi>x</mi></math> b</p><noscript>c</noscript><object>d</object></article>") == "Title a x b c d"
    teasers = "".join(f"<article>teaser {k}</article>" for k in range(3))
    assert extract(f"<body><div><p>{'word ' * 40}</p></div>{teasers}</body>").startswith("word word")
    assert extract("") == extract("<p>") == extract("<div></div>") == ""


def test_templates_go_inside_of_articles_and_copies_stay(spark):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, want = [], []
    for k in range(40):  # one box in a neutral div within the article, a menu whose words change
        story, links = text(30), "".join(f"<li><a href='/{j}'>{text(2)}</a></li>" for j in range(5))
        rows.append((k, f"http://big.org/{k}", f"<body><div><ul>{links}</ul></div><article><p>{story}</p><div>Read it in our app</div></article></body>"))
        want.append(story)
    copy = text(50)
    for k in range(40, 60):  # an article that the host repeats
        rows.append((k, f"http://big.org/{k}", f"<body><article><p>{copy}</p><p>{copy} end</p></article></body>"))
        want.append(f"{copy} {copy} end")
    rows += [(60, "http://small.org/", rows[0][2]), (60, "http://small.org/", rows[0][2]), (61, "http://small.org/x", "<p>" + "long word " * 100_000)]
    want += [want[0] + " Read it in our app"] * 2 + [("long word " * 100_000).strip()]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, n long")
    for most in (1000, 0):
        assert sorted((r.page_id, r.text) for r in html_text.extracted(pages, broadcast_rows=most).collect()) == [(r[0], w) for r, w in zip(rows, want, strict=True)]


def test_counts_of_subtrees_against_brute_force(spark):
    pages = html_text.with_host(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    counts, n = defaultdict(int), defaultdict(int)
    for r in pages.collect():
        n[r.host] += 1
        for h in html_text.Page(r.html or "").hashes():
            counts[r.host, h] += 1
    want = {(host, h): k for (host, h), k in counts.items() if k >= 5} | {(host, 0): k for host, k in n.items()}
    assert {(r.host, r.hash): r.n for r in html_text.templates(pages).collect()} == want
    assert any(h for _, h in want)


def test_pipeline_keeps_clean_documents_and_drops_the_planted(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    words = [f"word{k}" for k in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak, line = text(15), text(60)
    rows = {i: text(80) for i in range(20)} | {20: "vile " * 40 + text(20), 21: text(30) + "\n" + line, 22: text(40) + "\n" + line, 23: text(50) + " " + leak, 25: "", 26: None}
    rows[24] = rows[3]  # an exact copy loses its line and so its row
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = toxicity.Model(toxicity.Automaton.of(["vile"], []), ["vile"], [], set(), np.array([-4.0, 4, 0, 0, 0, 0, 0]))
    monkeypatch.setattr(toxicity, "fitted", lambda *_: model)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    codec = Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows[22] = rows[22].split("\n")[0]
    want = {}
    for i in [*range(20), 21, 22, 25]:
        ids = codec.encode(rows[i])
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(rows[i].encode()).hexdigest())
    assert got == want
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "bpe"]
    assert pq.read_schema(next(tmp_path.glob("documents.parquet/*.parquet"))).names == ["doc_id", "text", "lang", "source", "n_chars"]
