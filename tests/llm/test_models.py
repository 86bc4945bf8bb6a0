"""The fitted operators, line dedup, page text and the pipeline: brute force, or accuracy on held-out rows."""

import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import tests.llm.brute as brute
from tests.llm.test_documents import awkward
from tideline.llm import queries

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("label", F.lit("clash")).withColumn("score", F.lit(0)).withColumn("n", F.lit(1)).withColumn("row", F.lit(1))


def base_scores(rows, folds=10):
    toks = {i: brute.words(t) + ["\0end"] for i, t in rows}
    c = Counter(w for i, ws in toks.items() if zlib.crc32(str(i).encode()) % folds for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in toks.items()}


@pytest.mark.parametrize("head", [1 << 19, 10])
def test_class_lm_counts(spark, monkeypatch, head):
    """Counts and base scores are exact, whether words are in the head or in the table."""
    from tideline.llm import class_lm

    monkeypatch.setattr(class_lm, "HEAD", head)
    rows = [(i, t) for i, t in awkward() if i not in (12, 13)] + [(100, "alpha1 beta2 gamma3 never-seen")]
    want = base_scores(rows)
    for r in class_lm.score(frame(spark, rows)).collect():
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6 * abs(base))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isfinite(r.score) and r.score < 0


def test_class_lm_helps_on_held_out(spark):
    rows = [r for r in queries.QUERIES["op3_class_lm"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_class_lm_is_a_distribution(spark, monkeypatch):
    """Emissions of a class add up to one with one unknown word for each form; so do its transitions."""
    from tideline.llm import class_lm as lm

    kept = []
    real = lm._train
    monkeypatch.setattr(lm, "_train", lambda texts: kept.append(real(texts)) or kept[-1])
    lm.score(frame(spark, awkward())).collect()
    m = kept[0][0]
    assert np.allclose((10**m.step).sum(1), 1)
    label = m.head.label
    for c in set(label[label >= 0].tolist()):
        assert m.head.n[label == c].sum() == pytest.approx(10 ** m.class_mass[c])


def test_class_lm_scores_by_brute_force(spark, monkeypatch):
    """With a core of eight words: the classes of all others from their neighbours, and every text's score, in plain Python."""
    from tideline.llm import class_lm as lm

    for name, value in (("CORE", 8), ("_SIDE", 8 + lm.FORMS + 1), ("LEAST", 3)):
        monkeypatch.setattr(lm, name, value)
    kept = []
    real = lm._train
    monkeypatch.setattr(lm, "_train", lambda texts: kept.append(real(texts)) or kept[-1])
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(("a", "the")) + " " + r.choice(("red", "blue", "old")) + r.choice((" cat", " dog,", " é.", f" w{r.randrange(40)}")) for _ in range(n))
    rows = [(i, say(r.randrange(1, 30))) for i in range(150)] + [(999, None), (998, ""), (997, "never seen, words é.")]
    got = {x.doc_id: x.score for x in lm.score(frame(spark, rows)).collect()}
    m = kept[0][0]
    k = lm.CLASSES + lm.FORMS + 1
    texts = {i: brute.words(t) for i, t in rows}
    train = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 10]
    count = Counter(x for w in train for x in w)
    hash_of = {x: int(h) for x in {x for w in texts.values() for x in w} for h in lm.Words(pa.record_batch({"text": pa.array([x])})).hash}
    class_of = {x: int(m.head.label[m.head.find(np.array([h], np.uint64))[0]]) for x, h in hash_of.items()}
    rank = sorted(count, key=lambda x: (-count[x], hash_of[x]))
    form = lambda x: (0 if x[-1] == "." else 1 if x[-1] == "," else 2) + 3 * (not x.isascii())
    assert {x for x, c in class_of.items() if c >= 0} == set(rank[:8]) | {x for x, n in count.items() if n >= 3}
    unit = lambda x, known: class_of[x] if x in known else lm.CLASSES + form(x)

    def joint(known):
        out = np.zeros((k, k))
        for w in train:
            seq = [k - 1, *[unit(x, known) for x in w], k - 1]
            for p, q in zip(seq, seq[1:]):
                out[p, q] += 1
        return out

    core = set(rank[:8])
    first = joint(core)
    into, out = first[:, : lm.CLASSES].T + 0.1, first[: lm.CLASSES] + 0.1
    for x in set(count) - core:
        if count[x] >= 3:
            gain = np.zeros(lm.CLASSES)
            for w in train:
                seq = [k - 1, *[unit(y, core) for y in w], k - 1]
                for i, y in enumerate(w):
                    if y == x:
                        gain += np.log(into[:, seq[i]] / into.sum(1)) + np.log(out[:, seq[i + 2]] / out.sum(1))
            assert gain[class_of[x]] == pytest.approx(gain.max()), x
    known = {x for x, c in class_of.items() if c >= 0}
    j = joint(known)
    step = lambda p, q: math.log10((j[p, q] + lm.PULL * (j[:, q].sum() + 1) / (j.sum() + k)) / (j[p].sum() + lm.PULL))
    mass, left, kinds = Counter(), Counter(), Counter()
    for x, n in count.items():
        if x in known:
            mass[class_of[x]] += n
        else:
            left[form(x)] += n
            kinds[form(x)] += 1
    for i, w in texts.items():
        seq = [k - 1, *[unit(x, known) for x in w], k - 1]
        want = sum(step(p, q) for p, q in zip(seq, seq[1:]))
        want += sum(math.log10(count[x]) - math.log10(mass[class_of[x]]) if x in known else math.log10(count[x] + 0.1) - math.log10(left[form(x)] + 0.1 * (kinds[form(x)] + 1)) for x in w)
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_exchange_raises_likelihood():
    from tideline.llm import class_lm as lm

    r = np.random.default_rng(0)
    side = lm.CORE + lm.FORMS + 1
    b = np.zeros((side, side))
    kinds = r.integers(0, 3, 60)
    for i in range(60):
        for j in range(60):
            b[i, j] = 50 if kinds[j] == (kinds[i] + 1) % 3 else 0
    label = lm.exchange(b, 60, 3)[:60]
    assert len({(k, c) for k, c in zip(kinds, label)}) == 3


def test_line_dedup(spark):
    from tideline.llm.line_dedup import dedup_lines

    long = " ".join(f"word{i}x" for i in range(80))
    close = long.replace("word40x", "word4x")
    rows = [(3, f"{long}\nunique line of more than six words a"), (1, f"intro line that stands alone in here\n{long.upper()}!\n\nAs.\nAs."), (2, None), (4, ""), (5, f"  {close}\nAs."), (6, "a b c d e f g\nA b c, d e f g.\nother words go here too and so"), (7, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dropped", F.lit(1)).withColumn("id", F.lit(2)).withColumn("line", F.lit(2)).withColumn("sim", F.lit(2)).withColumn("size", F.lit(2))
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert {i: list(r.dropped) for i, r in got.items()} == {1: [], 2: [], 3: [0], 4: [], 5: [0], 6: [1], 7: [0]}
    assert got[1].text == rows[1][1] and got[3].text == "unique line of more than six words a" and got[2].text is None and got[4].text == "" and got[5].text == "As." and got[7].text == ""
    assert got[1].id == 2
    assert dedup_lines(df.limit(0)).collect() == []


def test_line_dedup_repeated_and_missing_ids(spark):
    """Numbers of one row are never applied to another of the same id; rows without an id stay as they are."""
    from tideline.llm.line_dedup import dedup_lines

    twice = "this line is in several of the rows"
    rows = [(1, twice), (5, f"{twice}\nits own line comes after the other one"), (5, f"a wholly unique line of eight words here\n{twice}\n{twice}"), (None, f"{twice}\n{twice}"), (None, None)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str((r.doc_id, r.text, list(r.dropped))) for r in got) == sorted(str(x) for x in [(1, twice, []), (5, "its own line comes after the other one", [0]), (5, "a wholly unique line of eight words here", [1, 2]), (None, f"{twice}\n{twice}", []), (None, None, [])])


def test_edit_distance_by_brute_force():
    from tideline.llm.line_dedup import edit_distance

    r = random.Random(0)
    for _ in range(1500):
        a, b = ("".join(r.choice("abé") for _ in range(r.randrange(0, 14))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, was = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(was[j] + 1, row[j - 1] + 1, was[j - 1] + (x != y)))
        assert edit_distance(a, b) == row[-1]
    base = "word " * 20_000
    assert edit_distance(base + "end", base[:50_000] + "x" + base[50_000:]) == 4


def test_line_dedup_whole_table(spark):
    """Every exact repeat goes and every group keeps its first line."""
    plain = lambda s: " ".join(brute.words(re.sub(r"[0-9]", "0", s), brute.ALNUM_WORD))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: set(r.dropped) for r in queries.QUERIES["op5_line_dedup"](spark, SF).collect()}
    assert set(got) == set(docs)
    seen = {}
    for i in sorted(docs):
        for n, s in enumerate(docs[i].split("\n")):
            p = plain(s)
            if p.count(" ") >= 5:
                assert n in got[i] if p in seen else True
                seen.setdefault(p, (i, n))
            else:
                assert n not in got[i]


def cut_cost(margins, links, side):
    cost = sum(max(0, -m) if s else max(0, m) for m, s in zip(margins, side))
    return cost + sum(c for a, b, c in links if side[a] != side[b])


def test_minimum_cut_by_brute_force():
    from tideline.llm.html_text import minimum_cut

    r = random.Random(8)
    for _ in range(200):
        n = r.randrange(1, 9)
        m = [r.randrange(-100, 101) for _ in range(n)]
        links = [(i, j, r.randrange(0, 90)) for i in range(n) for j in range(i) if r.random() < 0.5]
        best = min(cut_cost(m, links, [bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cut_cost(m, links, minimum_cut(m, links)) == best


def test_pages(spark):
    from tideline.llm.html_text import extract, main_text

    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=x>Home</a><li><a href=y>More</a></ul></nav>
    <div class="cookie-notice">We use cookies, please accept them all now.</div><article><h1>A &amp; B</h1><p>First <b>bold</b>ly\n said &#233;&nbsp;x.<p>Second<br>line<script>if (a < b) "</p>"</script></article>
    <aside>Other stories to read</aside><section id="comments"><p>Great article, thanks a lot for it!</p></section><form>Name <input></form><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "A & B First boldly said é x. Second line"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <"), (5, "u", "<article><p>" + "long text " * 60_000)]
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0 and got[5].n_chars == 60_000 * 10 - 1


def test_cut_joins_what_margins_part():
    """Without an article mark, headings and short lines go with the text around them, and menus do not."""
    from tideline.llm import html_text as h

    body = "<div><h1>A title</h1><p>" + "words of a long text " * 12 + "</p><p>So it was.</p><p>" + "more of the long text " * 12 + "</p></div>"
    menu = "<ul><li><a href=x>Home</a><li><a href=y>About us</a></ul>"
    want = " ".join(re.sub("<[^>]+>", " ", body).split())
    for page in (f"<body class='single no-sidebar has-comments'>{menu}{body}<footer>By me</footer></body>", f"<main class='with-sidebar'>{body}</main>{menu}", f"<html><body><div id=content>{body}</div><div class='comments'><p>{'great text thanks a lot ' * 9}</p></div></body></html>"):
        found = h.blocks(page)
        m = h.margins(found)
        cut = h.minimum_cut(m, h.edges(found))
        assert h.main_text(page) == want
        assert "<main" in page or "content" in page or any(c != (x > 0) for c, x in zip(cut, m))


def test_broken_tags_take_linear_time():
    import time

    from tideline.llm.html_text import main_text

    for part in ('<a href="x', "<!--", "<div ", "<", "</", "<p><b>", "<script>", "<a b='"):
        began = time.time()
        main_text(part * 8000)
        assert time.time() - began < 2, part
    for page in ("<b>" * 16000 + "</i>" * 16000, "<b>" * 9000 + "x<hr>" * 9000, "<ul><div>" * 5000 + "<li></li>" * 9000, "<div>x" * 9000, "<p><button>" + "<b>" * 9000 + "<hr>" * 9000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 1, page[:20]
    assert main_text('<p title="' + "a" * 50 + "<article><p>" + "text that stays here " * 20 + "</article>").endswith("stays here")


def test_names_of_frames_do_not_outvote_the_text():
    from tideline.llm.html_text import main_text

    story = "".join(f"<p>{'the story goes on and on ' * 8}{k}.</p>" for k in range(6))
    want = " ".join(re.sub("<[^>]+>", " ", story).split())
    menu, foot = "<nav><ul><li><a href=x>Home</a><li><a href=y>News of today</a></ul></nav>", "<footer>All rights reserved by us and nobody else</footer>"
    readers = "<div class='comments'>" + f"<p>{'I say this is a great text thanks ' * 9}</p>" * 9 + "</div>"
    aside = "<aside class='sidebar'><article class=teaser><p>Read more of this and that here today and tomorrow</p></article></aside>"
    frames = [
        ('<article class="post comments-open">', "</article>"),
        ('<article><div class="post hentry comments-open">', "</div></article>"),
        ('<article><div class="ad-free-content">', "</div></article>"),
        ('<article><div class="content social-layout">', "</div></article>"),
        ('<form id="aspnetForm"><article>', "</article></form>"),
        ('<form id="aspnetForm"><div id=story>', "</div></form>"),
        ('<div class="layout sidebar-right"><main>', "</main></div>"),
        ('<div class="layout sidebar-right"><div>', "</div></div>"),
        ('<div class="header-wrapper"><article class="widget">', "</article></div>"),
    ]
    for head, tail in frames:
        for rest in ("", readers, aside, readers + aside):
            if not (rest and "<article" not in head and "<main" not in head):
                assert main_text(f"<body>{menu}{head}{story}{tail}{rest}{foot}</body>") == want, (head, rest[:20])
            assert main_text(f"<body>{menu}{head}{story}{rest}{tail}{foot}</body>") == want or "<article" not in head and rest, (head, rest[:20])


def test_flow_by_brute_force():
    import itertools
    import random
    import time

    from tideline.llm.html_text import minimum_cut

    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 9)
        margins = [r.randint(-200, 200) for _ in range(n)]
        links = [(a, b, r.randint(0, 120)) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda side: sum(max(0, -m) if s else max(0, m) for m, s in zip(margins, side)) + sum(c for a, b, c in links if side[a] != side[b])  # noqa: B023, E731
        assert cost(minimum_cut(margins, links)) == min(map(cost, itertools.product((False, True), repeat=n)))
    n = 4000
    margins = [r.choice((-90, 40, 130, 170, -60)) for _ in range(n)]
    began = time.time()
    minimum_cut(margins, [(i, i + 1, 110) for i in range(n - 1)] + [(i, i + 2, 90) for i in range(0, n - 2, 2)])
    assert time.time() - began < 1


def test_pages_of_nothing(spark):
    from tideline.llm.html_text import extract

    assert extract(spark.createDataFrame([], "page_id string, url string, html string")).collect() == []
    rows = [(None, None, "<article><p>" + "a word " * 30), (None, "u", None)] * 2
    assert sorted(r.n_chars for r in extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()) == [0, 0, 209, 209]


def test_pages_whole_table(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"</?(?:p|h1)>|<br>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
    assert {r.page_id: r.text for r in queries.QUERIES["op4_html_text"](spark, SF).collect()} == want


@pytest.mark.parametrize("name,label,least", [("op9_toxicity", "toxic", 0.95), ("op10_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r[label] for r in kept]) >= least
    good, bad = ([r.score for r in kept if r[label] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) >= 0.9


@pytest.mark.parametrize("module,label", [("toxicity", "toxic"), ("quality_rank", "quality")])
def test_classifiers_on_awkward_tables(spark, module, label):
    import importlib

    m = importlib.import_module(f"tideline.llm.{module}")
    docs = frame(spark, awkward())
    for labels in ([], [(7, 1), (8, None), (None, 1)], [(i, i % 2) for i in range(20)] * 2, [(999, 1)]):
        got = m.score(docs, spark.createDataFrame(labels, f"doc_id long, {label} int")).collect()
        assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert m.score(docs.limit(0), spark.createDataFrame([(1, 1)], f"doc_id long, {label} int")).collect() == []


def test_held_out_labels_do_not_matter(spark):
    from tideline.llm import quality_rank, toxicity

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    for m, c in ((quality_rank, "quality"), (toxicity, "toxic")):
        turned = labels.withColumn(c, F.when(out, 1 - F.col(c)).otherwise(F.col(c)))
        a, b = ({r.doc_id: r.score for r in m.score(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_network_gradient():
    from tideline.llm import toxicity as t

    r = np.random.default_rng(0)
    net = t.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = r.normal(size=(5, t.N_INPUTS, 4)), (np.arange(5)[:, None] < np.array([5, 3, 1, 4])).astype(float)
    label, cost = np.array([0, 1, 1, 0.0]), np.ones(4)

    def loss():
        z = net.run(x, mask)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    g = net.gradient(x, mask, label, cost)
    for k, v in net.p.items():
        at = tuple(r.integers(0, n) for n in v.shape)
        v[at] += 1e-4
        up = loss()
        v[at] -= 2e-4
        down = loss()
        v[at] += 1e-4
        assert g[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-4), k


def test_pipeline(spark):
    """The stages one at a time against brute force where they have one."""
    import corpus_pipeline as c
    from tideline.llm.quality_rules import judge

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == names, name
        before, rows = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in after.collect()}
        if name == "quality rules":
            assert set(rows) == {r.doc_id for r in judge(docs).where("kept").collect()}
        elif name == "line dedup":
            assert set(rows) == set(before) and all(r.n_chars == len(r.text) for r in rows.values())
        elif name == "near dedup":
            assert set(rows) == {i for i, x in brute.near(before.items()).items() if x[2]}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(rows) == {i for i, x in brute.contamination(before.items(), items).items() if not x[4]}
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    last = {r.doc_id: r for r in c.run(spark, sf).collect()}
    assert set(last) == set(rows) and all(r.decoded_sha256 == brute.sha(rows[i].text) and r.n_tokens == len(r.ids) for i, r in last.items())


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Missing and repeated ids, nulls in any column, clashing columns, repeated rows, an empty table: every row of the
    input is decided on its own text."""
    import corpus_pipeline as c

    r = random.Random(11)
    say = lambda n: " ".join(r.choice(("river", "stone", "bird", "house", "walks", "sees", "under", "green", "and", "the")) + r.choice(("", "s", "ly")) for _ in range(n))
    passage, shared, copied = say(40), say(12), say(60)
    texts = [passage + " " + say(5), copied, copied, copied, say(50) + "\n" + shared, say(50) + "\n" + shared, None, "", "x", say(70)]
    ids = [5, None, None, 4, 3, None, 7, None, 5, 5]
    rows = [(i, t, None if n % 2 else "en", None, None if t is None else len(t), "x", n, None) for n, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, key long, _row long").repartition(3)
    spark.createDataFrame([(1, passage), (None, copied), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    keys = lambda df: sorted(x.key for x in df.collect())
    found = c.quality_rules(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and not {6, 7, 8} & set(keys(found))
    found = c.line_dedup(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and keys(found) == list(range(10))
    after = {x.key: x.text for x in found.collect()}
    assert {k for k in range(10) if after[k] != texts[k]} == set(), "only rows with an id lose lines, and none repeats an earlier one"
    found = c.near_dedup(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and keys(found) == [0, 3, 4, 5, 6, 7, 8, 9]
    found = c.decontamination(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and keys(found) == list(range(1, 10))
    assert c.byte_bpe(spark, docs, str(tmp_path)).count() == 10
    for name, stage in c.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    docs.drop("_row").write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).count() <= 7
