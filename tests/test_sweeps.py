"""Sweeps over numbers of clusters go to their end: every k, and every fit until its centres rest."""

import numpy as np

import __spark_entry__ as entry
from patternloom.operators import cluster

SF = "/root/testdata/sf0.001"


def test_lloyd_goes_on_until_no_centre_moves(spark):
    r = np.random.default_rng(4)
    xs = np.concatenate([r.normal(c, 1.0, (60, 2)) for c in ((0, 0), (5, 1), (2, 6))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "id long, x array<double>")
    of = lambda table: np.array([r.label for r in table.orderBy("id").collect()])
    found = of(cluster.lloyd(rows, 3, None))
    means = np.stack([xs[found == c].mean(axis=0) for c in range(3)])
    assert (((xs[:, None] - means[None]) ** 2).sum(-1).argmin(axis=1) == found).all()
    # the first rows are of one group, so few rounds are not enough
    assert (of(cluster.lloyd(rows, 3, 1)) != found).any()


def test_range_of_k_is_whole(spark):
    assert [r.k for r in entry.queries()["E5_k_range"](spark, SF).orderBy("k").collect()] == [2, 3, 4, 5]
