"""HTML extraction, nearest neighbours, and the pipeline."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskstream.llm import bpe, html, near_dedup, neighbours, secrets, toxicity
from riskstream.llm.common import documents
from riskstream.llm.queries import queries

DIR = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def page(body, head="<title>t</title><script>x('</p>')</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = '<nav><ul><li><a href="/">Home</a></li></ul></nav>'


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        (page(f"{NAV}<article><h1>A &amp; B</h1><p><b>one\n two<br><p>three &#233; &lt;x&gt;</article><footer>f</footer>"), "A & B\n\none two\n\nthree é <x>"),
        (page(f'<header>Site</header>{NAV}<main><p>text</p><form><p>name</p></form><aside>s</aside><div class="share-bar">share</div></main>'), "text"),
        (page('<div id="cookie-notice">We use cookies</div><article><header><h1>T</h1></header><p>x <span class="ad">buy</span>y</p><section class="comments"><article class="comment"><p>first!</p></article></section></article>'), "T\n\nx y"),
        (page('<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><pre>p  q</pre><blockquote>c</blockquote></article>'), "a\n\nb\n\n1\n\n2\n\np q\n\nc"),
        (page("<article><p>cut off <b>here"), "cut off here"),
        (page("<article><p>one<!-- <p>no</p> --> two</p><style>p{}</style><noscript>n</noscript></article>"), "one two"),
        (page('<div class="top"><a href="x">a link a link a link</a></div><div class="story"><p>long text of the story</p><p>more</p></div>'), "long text of the story\n\nmore"),
        (page('<article hidden><p>no</p></article><article><p>yes</p><div role="navigation">n</div><p style="display: none">h</p></article>'), "yes"),
    ],
)
def test_main_text(source, text):
    assert html.main_text(source) == text


def test_template_text_goes(spark):
    rows = [(i, f"http://h.example/{i}", page(f'<div class="a"><p>Always the same words on every page here</p></div><div class="b"><p>Story {i} of {i}</p></div>')) for i in range(6)]
    rows += [(10, None, None), (11, "bad url", "<p>x</p>"), (0, "http://h.example/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for sent in (1 << 20, 0):
        got = [(r.page_id, r.text, r.n_chars) for r in html.extract(df, sent_bytes=sent).collect()]
        assert sorted(g for g in got if g[0] < 10) == sorted([(i, f"Story {i} of {i}", len(f"Story {i} of {i}")) for i in range(6)] + [(0, "Story 0 of 0", 12)])
        assert sorted(g[1] for g in got if g[0] >= 10) == ["", "x"]
    assert html.extract(df.limit(0)).count() == 0
    pages = df.select("html", html.host(F.col("url")).alias("host"))
    assert [r.host for r in html.candidates(pages).collect()] == [r.host for r in html.templates(pages).collect()] == ["h.example"]


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", page('<div class="b"><p>The copied story</p></div>')) for i in range(3)]
    rows += [(i, f"http://h.example/{i}", page(f'<div class="b"><p>Story {i}</p></div>')) for i in range(3, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {i: "The copied story" if i < 3 else f"Story {i}" for i in range(9)}


def test_text_in_several_containers():
    assert html.main_text(page('<h1>Head</h1><div class="a"><p>first part</p></div><div class="b"><p>the second part</p></div>')) == "Head\n\nfirst part\n\nthe second part"


def plain_template(pages):
    """Valid classes by their definition, over the pages of one host, each a list of tokens (kind, path, text) and the key of its own text."""
    by_key = {key: tokens for tokens, key in pages}
    keys = sorted(by_key)
    vectors = {}
    for k, key in enumerate(keys):
        for t in by_key[key]:
            vectors.setdefault(t, [0] * len(keys))[k] += 1
    classes = {}
    for t, v in vectors.items():
        if sum(x > 0 for x in v) >= max(html.LEAST, html.SUPPORT * len(keys)):
            classes.setdefault(tuple(v), set()).add(t)
    classes = {v: c for v, c in classes.items() if any(t[1] is None for t in c)}
    root = classes.get((1,) * len(keys), set())
    good = set()
    for v, c in classes.items():
        orders, slots, fine = set(), set(), True
        for tokens, _ in pages:
            row = [t for t in tokens if t in c]
            if row:
                m = len(set(row))
                fine &= all(row[i] == row[i % m] for i in range(len(row)))
                orders.add(tuple(row[:m]))
                at = None
                for t in tokens:
                    at = t if t in root else at
                    if c is not root and t in c:
                        slots.add(at)
        if fine and len(orders) == 1 and len(slots) <= 1:
            good |= c
        elif c is root:
            return set()
    return good


def story(r, i):
    return f"Story {i} says " + " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(5, 30)))


def generated(r, host, marked, n=12):
    """Pages with the text that their making says is the article."""
    out = []
    for i in range(n):
        blocks = [story(r, (i, j)) for j in range(r.randrange(1, 4))]
        work, note = story(r, (i, "work")), story(r, (i, "note"))
        inner = f'<p>Share this with your friends</p><h1>T{i} {host}</h1>' + "".join(f"<p>{b}</p>" for b in blocks) + f'<section class="related-work"><h2>Work {i}</h2><p>{work}</p></section><p class="notice">{note}</p>'
        main = f"<article>{inner}</article>" if marked else f'<div class="story">{inner}</div>'
        cards = "".join(f'<div class="card"><b>More</b><p>{r.random()}</p></div>' for _ in range(r.randrange(0, 3)))
        extra = f'<div class="tip"><p>Tip {i}</p></div>' if i % 2 else ""
        side = f'<div class="rail"><p>Popular {r.random()}</p></div>{extra}'
        body = f'<div class="top"><p>The Daily {host}</p></div>{main}{side}<div class="has-sidebar"><p>All rights {host}</p>{cards}</div>'
        text = [f"T{i} {host}", *blocks, f"Work {i}", work, *([note] if marked else [])]
        out.append((f"http://{host}/{i}", page(body), "\n\n".join(text)))
    return out


def test_templates_decide_with_and_without_article(spark):
    r = random.Random(12)
    made = [p for k in range(4) for p in generated(r, f"h{k}.example", k % 2 == 0)] + generated(r, "few.example", True, 2)
    rows = [(i, url, source) for i, (url, source, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for sent in (1 << 20, 0):
        got = {x.page_id: x.text for x in html.extract(df, sent_bytes=sent).collect()}
        for i, (url, _, text) in enumerate(made):
            if "few" in url:
                assert got[i] == f"Share this with your friends\n\n{text}"  # two pages make no template
            else:
                assert got[i] == text
    # with no template for any host the result is another one
    bare = {x.page_id: x.text for x in html.extract(df, least=1000).collect()}
    assert all(bare[i] != text for i, (_, _, text) in enumerate(made))


def test_templates_equal_plain_deduction(spark):
    r = random.Random(13)
    rows, expected = [], {}
    for k in range(12):
        name, pages = f"g{k}.example", []
        kinds = [f'<div class="c{j}"><p>fixed {j}</p>' for j in range(6)]
        for i in range(r.randrange(3, 14)):
            parts = kinds[: r.randrange(3, 7)] if k % 3 else r.sample(kinds, 4)
            parts = [p + f"<p>{r.choice(['shared', r.random()])}</p>" * r.randrange(0, 3) + "</div>" for p in parts for _ in range(r.choice([1, 1, 2]) if p is kinds[2] else 1)]
            pages.append(f"<html><body><div class='top'></div>{''.join(parts)}<ul class='end'><li>x</ul></body></html>")
        pages.append(pages[0])
        rows += [(name, p) for p in pages]
        expected[name] = plain_template([([t[:2] for t in html.parse(p)], tuple(t[1] for t in html.parse(p) if t[1] and not t[2])) for p in pages]) if len(set(pages)) else set()
    got = {x.host: set(x.tokens) - {html._PAGE} for x in html.templates(spark.createDataFrame(rows, "host string, html string")).collect()}
    expected = {h: {html.token(*t) for t in c} for h, c in expected.items()}
    assert sum(map(len, expected.values())) > 50
    assert {h: got.get(h, set()) for h in expected} == expected


def test_templates_find_articles_without_their_tags(spark):
    """All of sf0.1 with every telling tag a div and every name a number: templates give nearly all texts, and without them nearly none is found."""
    made = [(x.page_id, x.url, x.html) for x in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    hide = lambda source: re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="n{zlib.crc32(m[2].encode())}"', re.sub(r"<(/?)(article|main|nav|aside|footer|header|form)\b", r"<\1div", source))
    df = spark.createDataFrame([(i, url, hide(source)) for i, url, source in made], "page_id long, url string, html string").repartition(8)
    want = {i: html.main_text(source) for i, _, source in made}
    got = {x.page_id: x.text for x in html.extract(df).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert sum(html.main_text(hide(source)) == want[i] for i, _, source in made) <= 0.05 * len(want)


def test_long_page_and_empty_table(spark):
    text = "\n\n".join(f"paragraph {i} of a long page" for i in range(40_000))
    df = spark.createDataFrame([(1, "http://a/", page("<article>" + text.replace("\n\n", "<p>") + "</article>"))] * 2, "page_id long, url string, html string")
    assert [x.text == text for x in html.extract(df).collect()] == [True, True]
    assert html.extract(df.limit(0)).count() == 0


def brute(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = np.array([*v, *[0.0] * (16 - len(v))], float)
    out = {}
    for q in sorted(i for i in good if i % every == 0):
        a = good[q]
        score = {i: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) for i, b in good.items() if i != q}
        out[q] = sorted(score.items(), key=lambda s: (-round(s[1], 12), s[0]))[:k]
    return out


def found(spark, rows, every=10, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    out = {}
    for r in neighbours.nearest(df, every, k, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_neighbours(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(20, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.3 * r.normal(size=16)]) for i in range(800)]
    same = rows[3][1]
    rows += [(1000 + i, same) for i in range(60)]
    rows += [(2000, None), (2010, [0.0] * 16), (2020, [float("nan")] * 16), (2030, [None, *same[1:]]), (2040, [1.0, 2.0]), (None, same), rows[10], (2050, [])]
    want = brute(rows, 10, 5)
    got = found(spark, rows, block=64)
    assert set(got) == set(want)
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, answer in got.items():
        assert [a[0] for a in answer] == [1, 2, 3, 4, 5]
        assert [a[2] for a in answer] == sorted((a[2] for a in answer), reverse=True)
    # the copies: the five smallest other ids, by id
    assert [v for _, v, _ in got[1000]] == [3, 1001, 1002, 1003, 1004]


def test_each_candidate_is_scored_once_inside_its_window(spark, monkeypatch):
    """Clustered vectors: windows are a small share of the table, and every pair is on one curve only."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(150, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 150] + 0.05 * r.normal(size=16)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    widths = []
    fit = neighbours._window
    monkeypatch.setattr(neighbours, "_window", lambda *a: widths.append(fit(*a)) or widths[-1])
    got = {}
    for x in neighbours.nearest(df, 50, 5, curves=8, block=256).collect():
        got.setdefault(x.query_id, []).append(x.vec_id)
    want = brute(rows, 50, 5)
    assert sum(len(set(got[q]) & {v for v, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert 2 * widths[0] * 8 < 0.6 * len(rows) and all(len(set(v)) == 5 for v in got.values())


def test_vectors_of_any_size_and_length(spark):
    big = [[1e200, 1e200], [1e200, 0.0], [1e-200, 1e-200], [3.0], [5e-324, 0.0, 1.0]]
    rows = list(enumerate(big))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.query_id, x.rank, x.vec_id, round(x.score, 12)) for x in neighbours.nearest(df, 50, 4).orderBy("rank").collect()]
    half = round(0.5**0.5, 12)
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, half), (0, 3, 3, half), (0, 4, 4, 0.0)]


def test_few_or_no_vectors(spark):
    assert found(spark, [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])]) == {0: [(1, 2, pytest.approx(0.5**0.5)), (2, 1, 0.0)]}
    assert found(spark, [(0, [1.0, 0.0])]) == {}
    assert found(spark, [(0, None)]) == {}
    assert found(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0])]) == {}


def test_hilbert_curve_is_one():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(neighbours.hilbert(grid, 3))
    assert len(set(neighbours.hilbert(grid, 3).tolist())) == 512
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


@has_tables
def test_queries_over_small_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").count()
    for name in ("op1_toxicity", "op2_substring_dedup", "op3_near_dedup", "op4_secrets", "op5_bpe", "op8_language_model"):
        assert queries()[name](spark, DIR).count() == docs


@has_tables
def test_pipeline_equals_plain_version(spark):
    """The stages' decisions, taken one after another without Spark's help where there is a plain way."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "bpe"]
    docs = documents(spark, DIR)
    model = toxicity.fit(docs, documents(spark, DIR, "labels"))
    rows = {r.doc_id: r.text for r in toxicity.score(docs, model).collect() if not r.rejected}
    sets = {}
    for i, t in rows.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in rows}
    for i in rows:
        for j in rows:
            n = len(sets[i] & sets[j])
            if j < i and sets[i] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    rows = {i: t for i, t in rows.items() if group[i] == i}
    bench = []
    for r in documents(spark, DIR, "benchmark").collect():
        w = r.text.encode().lower().split()
        bench.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    rows = {i: t for i, t in rows.items() if not any(len(b & sets[i]) >= 0.8 * len(b) for b in bench)}
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.pattern(), mergeable_ranks=bpe.load(bpe.vocabulary_path()), special_tokens={})
    expected = {}
    for i, t in rows.items():
        spans = sorted((s[1:] for part in secrets.linked(t) for s in part))
        out, done = "", 0
        for a, b in spans:
            if a >= done:
                out += t[done:a] + "[secret]"
            done = max(done, b)
        expected[i] = out + t[done:]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert set(got) == set(expected)
    for i, t in expected.items():
        assert list(got[i].ids) == enc.encode_ordinary(t) and got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_on_awkward_documents(spark, tmp_path):
    r = random.Random(1)
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (3, " ".join(f"w{r.random()}" for _ in range(20_000)), "en", None, 1), (4, "same text of six words here", "en", "s", 1), (5, "same text of six words here", "xx", "s", 1), (4, "same text of six words here", "en", "s", 1), (None, "no id", "en", "s", 5)]
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = sorted(((x.doc_id, x.n_tokens) for x in corpus_pipeline.run(spark, at).collect()), key=str)
    assert [g[0] for g in got] == [1, 2, 3, 4, None]
    docs = documents(spark, at)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns, name
        assert stage(spark, docs.limit(0), at).count() == 0, name
    assert near_dedup.duplicates(docs).count() == len(rows)
