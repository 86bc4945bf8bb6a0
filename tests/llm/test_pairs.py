"""Variants, neighbours and alignment against plain restatements."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tideline.llm import alignment, vantage, variants
from tests.llm.brute import LOWER

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    out = {}
    for w in n:
        near = [v for v in n if one_apart(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = (n[w], form, len(near), form and n[form])
    root = lambda w: root(out[w][1]) if out[w][1] else w
    return {w: (x[0], x[1], root(w), x[2], x[3]) for w, x in out.items()}


def told(df):
    return {x.word: (x.n, x.form, x.root, x.n_near, x.form_n) for x in df.collect()}


def test_variants_by_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(6, 8))) for _ in range(40)]
    text = lambda: " ".join(w if r.random() < 0.7 else w[: (k := r.randrange(len(w)))] + r.choice(["", "a", "é", w[k] * 2]) + w[k + 1 :] for w in r.choices(base, [1 / (k + 1) ** 2 for k in range(40)], k=120))
    rows = [(k, text()) for k in range(60)] + [(None, text()), (7, None), (7, ""), (7, "x" * 5000), (8, "ÀÉbcd Ébcdef " * 6), (8, "...")] * 2
    want = plain_variants(plain_words(rows))
    assert sum(x[1] is not None for x in want.values()) > 30 and any(x[1] and x[2] != x[1] for x in want.values())
    assert told(variants.variants(docs_of(spark, rows).withColumn("word", F.lit(1)).withColumn("n", F.lit("x")))) == want


def test_variants_follow_forms_and_break_ties(spark):
    n = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "zzzzzz": 1, "zzzzzy": 9, "zzzzzx": 9, "mmmmmm": 2, "mmmmmmm": 9, "qqqqqqq": 7}
    got = told(variants.group_variants(spark.createDataFrame([*n.items(), (None, 3)], "word string, n long")))
    assert got == plain_variants(n)
    assert got["aaaaaa"][2] == "aaabbb" and got["zzzzzz"][1] == "zzzzzx" and got["mmmmmm"][1] is None
    assert variants.variants(docs_of(spark, [])).collect() == []


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def plain_nearest(rows, k):
    good = {(i, tuple(np.float32(v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, x in good:
        if q % 100 == 0:
            near = {}
            for i, y in good:
                if i != q and len(x) == len(y):
                    d = float(np.sqrt(((np.array(x, float) - np.array(y, float)) ** 2).sum()))
                    near[i] = min(d, near.get(i, d))
            out[q] = [(i, round(d, 9)) for d, i in sorted((d, i) for i, d in near.items())[:k]]
    return out


def ranked(df):
    out = {}
    for x in sorted(df.collect(), key=lambda x: (x.query_id, x["rank"])):
        out.setdefault(x.query_id, []).append((x.vec_id, round(x.score, 9)))
        assert len(out[x.query_id]) == x["rank"]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("shard", [50, 5000])
def test_factor_one_is_exact(spark, shard):
    """Groups of copies, ties, odd vectors, other lengths, repeated rows."""
    r = np.random.default_rng(1)
    points = r.normal(size=(900, 5)).round(2).tolist()
    rows = [(i, p) for i, p in enumerate(points)]
    rows += [(1000 + i, points[100]) for i in range(301)] + [(2000 + i, [1.0, 2.0]) for i in range(3)] + rows[:10]
    rows += [(3000, None), (3100, []), (3200, [0.0] * 5), (3300, [float("nan")] * 5), (3400, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (3500, [None, 1.0, 1.0, 1.0, 1.0]), (None, points[0]), (3600, [1.0, 2.0, 3.0])]
    want = {q: v for q, v in plain_nearest(rows, 10).items() if v}
    got = ranked(vantage.nearest(vectors_of(spark, rows).withColumn("q", F.lit(1)).withColumn("h", F.lit(2)), F.col("vec_id") % 100 == 0, factor=1.0, shard=shard))
    assert got == want


def test_recall_of_the_query(spark):
    from tideline.llm.queries import op12_neighbours

    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = plain_nearest(rows, 10), ranked(op12_neighbours(spark, "/root/testdata/sf0.1"))
    assert np.mean([len(dict(want[q]).keys() & dict(got[q]).keys()) / 10 for q in want]) >= 0.95


def test_no_vectors(spark):
    assert vantage.nearest(vectors_of(spark, []), F.col("vec_id") % 100 == 0).collect() == []
    assert vantage.nearest(vectors_of(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 100 == 0).collect() == []


def plain_alignment(rows):
    import sentencepiece
    import tokenizers

    a_of, b_of = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_of.encode_special_tokens = True
    pair = alignment.Pair(A, B)
    count, per = Counter(), []
    for doc, text in rows:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        parts = [[of[i] for i in ids] for of, ids in ((pair.a_bytes, a), (pair.b_bytes, b))]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            per.append((doc, None))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        links, groups, i, j, own = [], [], 0, 0, ([], [])
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            if x <= y:
                own[0].append(a[i])
                i += 1
            if y <= x:
                own[1].append(b[j])
                j += 1
            if x == y:
                groups.append("|".join(",".join(map(str, o)) for o in own))
                own = ([], [])
        count.update(links)
        per.append((doc, (len(a), len(b), groups, links)))
    best = Counter()
    for (_, b), c in count.items():
        best[b] = max(best[b], c)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [(d, *(zero if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(count[p] == best[p[1]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()))) for d, x in per]


AWKWARD = [
    (-1, None), (-2, ""), (-3, " "), (-4, "   "), (-5, "a ▁ b"), (-6, "it's 'tis  don't\n\n x \t y\xa0z　 q "), (-7, "ﬁ é \x00 <|endoftext|> <s> <0x41> 日本語テキスト☃️👩‍👩‍👧"),
    (-8, "x" * 3000 + "ab" * 2000), (None, "null id"), (-6, "same id\r\n;\r x"), (-9, " lead"), (-10, "trail  "), (-11, "\n\n"), (-12, "e.g.(a)b!?'s'S \x1c x\x85 y"), (-12, "e.g.(a)b!?'s'S \x1c x\x85 y"),
]


def rows_of(df):
    return sorted(tuple(map(str, x)) for x in df.collect())


def test_alignment_by_brute_force(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()] + AWKWARD
    docs = docs_of(spark, rows).withColumn("w", F.lit(1)).withColumn("units", F.lit("x")).withColumn("chunk", F.lit(0))
    assert rows_of(alignment.align(docs, A, B)) == sorted(tuple(map(str, x)) for x in plain_alignment(rows))
    assert alignment.align(docs_of(spark, []), A, B).collect() == []


def test_alignment_over_many_chunks(spark, monkeypatch):
    """Units that come in several chunks, and pairs that are joined by a shuffle."""
    monkeypatch.setattr(alignment, "PAIRS", 0)
    rows = [(k, f"the {k % 7}, of don't the. {k % 3}") for k in range(200)] + AWKWARD[-4:]
    assert rows_of(alignment.align(docs_of(spark, rows).repartition(9), A, B)) == sorted(tuple(map(str, x)) for x in plain_alignment(rows))


def test_units_are_whole_texts_where_tokens_may_cross(monkeypatch):
    pair = alignment.Pair(A, B)
    assert pair.cut and pair.whole
    pair.cut = pair.whole = False
    units = alignment._Units(pair)
    assert units.of("a b, c") == [0] and units.of("x ▁") is None and not units.lost
    assert pair.encode([" a b, c"])[1] == [pair.b.encode("a b, c")]
