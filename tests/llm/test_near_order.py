from tideline.llm.near_dedup import near_duplicates
from tests.llm import brute


def test_isolated_contained_pairs(spark):
    """Of each pair one text holds the other, and nothing else is like either."""
    docs = []
    for n in range(600):
        few, many = ((48, 64), (60, 80), (72, 96), (96, 128), (99, 130), (48, 61))[n % 6]
        words = [f"w{n}x{i}" for i in range(many + 4)]
        docs += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[: few + 4]))]
    for a, b in zip(docs[::2], docs[1::2]):
        x, y = brute.shingles(a[1]), brute.shingles(b[1])
        assert y < x and 75 <= 100 * len(y) / len(x) < 80
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    missed = [i for i, _ in docs if got[i] != i // 2 * 2]
    assert missed == []
