"""Blocks of cells against numpy, and that a pass moves vectors and not cells."""

import numpy as np
from pyspark.sql import functions as F

from patternloom.operators import text
from patternloom.operators.cells import Blocks, gram


def test_blocks_multiply_as_numpy_and_do_not_move_cells(spark, capsys):
    rng = np.random.default_rng(3)
    m = rng.random((200, 150)) * (rng.random((200, 150)) < 0.1)
    at = np.argwhere(m > 0)
    cells = spark.createDataFrame([(int(i), f"t{j:03}", float(m[i, j])) for i, j in at] + [(None, "t000", 1.0)], "r long, c string, v double")
    blocks = Blocks(cells)
    assert len(blocks.sizes["r"]) > 1 and len(blocks.sizes["c"]) > 1
    start = blocks.vectors("c", [F.length("key") * 0.5, F.substring("key", 2, 3).cast("double")])
    y = np.array([[2.0, j] for j in range(150)])
    turn = np.array([[1.0, 2.0], [0.0, 0.5]])
    found = blocks.multiply(start, 2, "r", turn=turn)
    got = {r.key: r.x for r in blocks.unpacked(found, 2, "r").collect()}
    want = m @ (y @ turn)
    assert len(got) == len({*at[:, 0]}) and all(np.allclose(got[i], want[i]) for i in got)
    back = {r.key: r.x for r in blocks.unpacked(blocks.multiply(found, 2, "c"), 2, "c").collect()}
    assert all(np.allclose(back[f"t{j:03}"], (m.T @ want)[j]) for j in {*at[:, 1]})
    assert np.allclose(gram(found, 2), want.T @ want)
    # the cells lie in memory, dealt as the join with vectors asks: only the vectors are exchanged
    blocks.cells.join(start.select(F.col("b").alias("q"), F.lit(0).alias("p"), "x").hint("shuffle_hash"), ["p", "q"]).explain()
    plan = capsys.readouterr().out
    assert "InMemoryTableScan" in plan and plan.split("InMemoryRelation")[0].count("Exchange") == 1
    blocks.release()


def test_new_rows_are_weighed_in_one_pass(spark):
    rng = np.random.default_rng(4)
    h, m = rng.random((6, 2)) + 0.1, rng.random((5, 6))
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(5) for j in range(6)] + [(9, 77, 1.0)], "doc long, term long, weight double")
    known = spark.createDataFrame([(j, h[j].tolist()) for j in range(6)], "term long, h array<double>")
    out = text.nmf_transform(cells, known, 200)
    got = {r.doc: np.array(r.w) for r in out.collect()}
    assert sorted(got) == list(range(5))
    for i, w in got.items():  # the conditions of a least-squares fit without negative weights
        slope = (w @ h.T - m[i]) @ h
        assert (slope > -1e-2).all() and abs(slope @ w) < 1e-2
    # rounds are the row's own: one query without a table written for each
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 2
