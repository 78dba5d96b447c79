import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from partatlas.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("partatlas-tests", cpus="4")
    yield session
    session.stop()


@pytest.fixture
def tiny_limits(monkeypatch):
    """Limits so low that small frames take the paths made for hot keys and many chunks."""
    from partatlas.operators import best_text, blocks, sku_pairs, skew, tfidf

    monkeypatch.setattr(skew, "TASK_ROWS", 2)
    monkeypatch.setattr(skew, "PAIR_ROWS", 2)
    monkeypatch.setattr(blocks, "TILE", 4)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 15)
    monkeypatch.setattr(sku_pairs, "SMALL_CELL", 4)
    monkeypatch.setattr(tfidf, "CELL_PAIRS", 3)
    monkeypatch.setattr(tfidf, "SLICE", 5)
    monkeypatch.setattr(best_text, "DENSE_TERMS", 2)


@pytest.fixture
def make_items(spark):
    def build(rows):
        names = "row_id long, catalog_no string, description string, main_category string, sub_category string"
        filled = [tuple(r) + ("Main", "Sub")[len(r) - 3 :] if len(r) < 5 else tuple(r) for r in rows]
        return spark.createDataFrame(filled, names)

    return build
