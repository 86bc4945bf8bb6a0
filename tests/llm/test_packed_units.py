import numpy as np
import pyarrow as pa

from tideline.llm import alignment


def test_units_are_packed_by_chunk(monkeypatch):
    """Thousands of rows of units become one row a chunk each time that enough have come, and lose nothing."""
    monkeypatch.setattr(alignment, "PACKED", 4000)
    r = np.random.default_rng(2)
    n = 10_000
    columns = {"chunk": r.integers(0, 5, n) << 32, "idx": np.arange(n, dtype=np.int32), "groups": [f"{i},7|{i % 9};3|4" for i in range(n)]}
    columns |= {f: r.integers(0, 1 << 40, n) for f in alignment._FIGURES}
    rows = pa.RecordBatch.from_pydict(columns)
    found = [x for out in alignment._packed()(iter(rows.slice(k, 1000) for k in range(0, n, 1000))) for x in out.to_pylist()]
    assert len(found) == 15
    got = set()
    for x in found:
        idx, figures = np.frombuffer(x["idx"], np.int32), np.frombuffer(x["figures"], np.int64).reshape(len(alignment._FIGURES), -1)
        got |= {(x["chunk"], i, text, *f) for i, text, f in zip(idx.tolist(), x["groups"].split("\n"), figures.T.tolist(), strict=True)}
    assert got == {tuple(x.values()) for x in rows.to_pylist()}
