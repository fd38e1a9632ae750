import tracemalloc

import pyarrow as pa
import pytest

from stratavox.llm import jaccard


class Captured:
    """A frame that gives the function of its ``mapInArrow`` instead of running it."""

    def select(self, *columns):
        return self

    def mapInArrow(self, rows, schema):
        return rows


def texts(n=400, words=1_000):
    return [" ".join(f"w{i}x{j}" for j in range(words)) for i in range(n)]


def test_describe_holds_little(spark):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": texts()})
    rows = jaccard.describe(Captured(), 80, 5)
    tracemalloc.start()
    try:
        found = sum(made.num_rows for made in rows(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == batch.num_rows
    # What numpy and Python hold; it was 24 MB with two million bytes of text at a time.
    assert peak < 15e6


@pytest.fixture
def released(monkeypatch):
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    return calls


def test_describe_gives_memory_back(spark, released):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c d e f", None]})
    rows = jaccard.describe(Captured(), 80, 5)
    assert [made.column("n_shingles").to_pylist() for made in rows(iter([batch, batch]))] == [[2, 0], [2, 0]]
    # After each batch and at the end.
    assert len(released) == 3


def test_nothing_made_gives_memory_back(spark, released):
    assert list(jaccard.describe(Captured(), 80, 5)(iter([]))) == [] and len(released) == 1
