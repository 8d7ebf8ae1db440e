"""The vector index against all pairs: exact mode, recall, odd rows, further rows, pruned scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.operators import vector_index as vi

SCHEMA = "id long, embedding array<float>, score int, cell string"


def _rows(n, seed=1, length=8):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 3, (6, length))
    return [(i, (centres[r.integers(0, 6)] + r.normal(0, 1, length)).astype(np.float32).tolist(), 1, "x") for i in range(n)]


def _brute(kind, rows, asked, limit):
    out = {}
    for q, v, *_ in asked:
        found = []
        for i, w, *_ in rows:
            a, b = np.array(v, float), np.array(w, float)
            if kind == "cosine":
                size = np.linalg.norm(a) * np.linalg.norm(b)
                score = a @ b / size if size else 0.0
            else:
                score = a @ b if kind == "inner_product" else -np.linalg.norm(a - b)
            found.append((-round(float(score), 9), i))
        out[q] = sorted(found)[:limit]
    return out


@pytest.mark.parametrize("kind", vi.KINDS)
def test_all_cells_give_the_exact_neighbours(spark, kind):
    rows = _rows(300) + [(1000, [0.0] * 8, 1, "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    index = vi.build(table, kind=kind, cells=7)
    asked = rows[::20]
    got = {}
    for r in vi.nearest(index, spark.createDataFrame(asked, SCHEMA), limit=6).collect():
        got.setdefault(r["question"], []).append((r["place"], -r["score"], r["id"]))
    want = _brute(kind, rows, asked, 6)
    assert {q: [i for *_, i in sorted(own)] for q, own in got.items()} == {q: [i for _, i in own] for q, own in want.items()}
    assert all(abs(s - t) < 1e-8 for q, own in got.items() for (_, s, _), (t, _) in zip(sorted(own), want[q]))


def test_few_cells_find_most_and_one_question_prunes_the_scan(spark):
    rows = _rows(2000, seed=5)
    table = spark.createDataFrame(rows, SCHEMA)
    index = vi.build(table)
    found = {r["probes"]: r["found"] / r["wanted"] for r in vi.recall(index, table.where("id % 20 = 0"), [1, 4, 12, len(index.centres)]).collect()}
    assert found[12] >= 0.9 and found[len(index.centres)] == 1.0 and found[1] < found[12]
    again = vi.open_index(spark, index.path)
    assert again.kind == "cosine" and np.array_equal(again.centres, index.centres)
    one = vi.nearest_one(spark, again, rows[40][1], limit=3, probes=2)
    assert one.first()["id"] == 40
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "[cell") or "cell" in plan.split("PartitionFilters")[1][:200]


def test_odd_repeated_and_further_rows(spark):
    odd = [(900, None, 1, "x"), (901, [1.0], 1, "x"), (902, [float("nan")] * 8, 1, "x"), (903, [None] * 8, 1, "x"), (None, _rows(1)[0][1], 1, "x")]
    rows = _rows(200) + odd + [_rows(200)[5]] * 500  # a cell that holds most rows
    index = vi.build(spark.createDataFrame(rows, SCHEMA), cells=5)
    assert index.rows(spark).count() == len(rows) and index.rows(spark).where("cell = -1").count() == 4
    questions = spark.createDataFrame([(1, _rows(200)[5][1], 1, "x"), *odd[:4]], SCHEMA)
    got = vi.nearest(index, questions, limit=20).collect()
    assert len(got) == 20 and {r["id"] for r in got} == {5} and {r["question"] for r in got} == {1}
    vi.add(index, spark.createDataFrame([(7000 + i, v, 1, "x") for i, v, *_ in _rows(50, seed=9)], SCHEMA))
    assert index.rows(spark).count() == len(rows) + 50
    assert vi.nearest(index, questions.where("id = 1"), limit=800).where(F.col("id") >= 7000).count() == 50
    empty = vi.build(spark.createDataFrame([], SCHEMA))
    assert vi.nearest(empty, questions).count() == 0 and empty.rows(spark).count() == 0
    with pytest.raises(ValueError):
        vi.build(questions, kind="hnsw")
