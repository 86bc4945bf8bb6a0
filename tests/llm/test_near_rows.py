"""Near-duplicates row by row: repeated, null and textual ids."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.brute import components, shingles
from tideline.llm.near_dedup import near_duplicates


def words(seed, n=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


A, B = words(1), words(2)
MORE = A + " more"


@pytest.mark.parametrize("rows,kept", [([(1, A), (5, MORE)], [(1, A)]), ([(1, A), (5, MORE), (5, B)], [(1, A), (5, B)]), ([(1, A), (5, B), (5, MORE)], [(1, A), (5, B)])])
def test_stage_keeps_other_texts_of_an_id(spark, rows, kept):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(x) for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(kept)


def by_rows(rows, percent=75):
    """Rows of a component by number, and the smallest id of each."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    part = components(range(len(rows)), links)
    least = {p: min((rows[i][0] for i in part if part[i] == p and rows[i][0] is not None), default=None) for p in set(part.values())}
    return sorted((str(d), len(sets[i]), str(least[part[i]] if sets[i] else d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_any_ids(spark, kind):
    r = random.Random(7)
    rows = []
    for k in range(40):
        base = words(100 + k % 9)
        text = r.choice([base, base + " x", base.replace(" ", "  ", 3), " ".join(base.split()[1:]), None, "", "two words"])
        rows.append((r.choice([None, k, k % 5, 3]), text))
    rows += rows[:6]
    typed = [(d if d is None or kind == "long" else f"d{d}", t) for d, t in rows]
    docs = spark.createDataFrame(typed, f"doc_id {kind}, text string").withColumn("id", F.lit(1)).withColumn("class_id", F.lit("x"))
    got = near_duplicates(docs).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == by_rows(typed)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
