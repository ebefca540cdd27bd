"""Learned spaces, mixtures, kernel components and robust covariance against numpy, finite differences and planted structure."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternloom.operators import anomaly, deep, evaluation, mixture, reduce
from patternloom.sources import generators


def points(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "id long, x array<double>")


def agreement(labels, truth):
    return evaluation.adjusted_rand(labels.select("id", "label").join(truth.select("id", "truth"), "id"), "label", "truth").first()[0]


def tangled(spark, n=200, d=12, seed=1):
    """Four blobs behind a random tanh layer."""
    r = np.random.default_rng(seed)
    truth = np.arange(n) % 4
    hidden = r.normal(0, 0.3, (n, 3)) + np.array([[2, 0, 0], [0, 2, 0], [0, 0, 2], [-2, -2, 0]])[truth]
    x = np.tanh(hidden @ r.normal(size=(3, d))) + r.normal(0, 0.05, (n, d))
    x = (x - x.mean(0)) / x.std(0)
    return points(spark, x), spark.createDataFrame([(i, int(t)) for i, t in enumerate(truth)], "id long, truth int"), x


def close_to_differences(gradient, theta, seed=0):
    """Whether the gradient (loss last) is that of finite differences in random directions."""
    r = np.random.default_rng(seed)
    found = gradient(theta)[:-1]
    for _ in range(5):
        v = r.normal(size=len(theta))
        change = (gradient(theta + 1e-6 * v)[-1] - gradient(theta - 1e-6 * v)[-1]) / 2e-6
        assert abs(change - found @ v) < 1e-4 * (1 + abs(change))


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(0)
    x = r.normal(size=(15, 5))
    one, two = deep.Network([5, 7, 2], seed=1), deep.Network([2, 7, 5], seed=2)
    like = one.weights + two.weights
    net = lambda sizes, w: deep.Network(sizes, w)
    close_to_differences(lambda t: deep.reconstruction_gradient(net([5, 7, 2], deep.parted(t, like)[:4]), net([2, 7, 5], deep.parted(t, like)[4:]), x, 15), deep.flat(like))
    like2 = one.weights + deep.Network([2, 4, 4], seed=3).weights
    noisy = x + r.normal(0, 0.1, x.shape)
    close_to_differences(lambda t: deep.contrast_gradient(net([5, 7, 2], deep.parted(t, like2)[:4]), net([2, 4, 4], deep.parted(t, like2)[4:]), x, noisy, 0.5), deep.flat(like2))
    centres = r.normal(size=(3, 2))
    like3 = [*one.weights, centres]
    q, _ = deep.soft_assignment(one.forward(x)[-1], centres, 1.0)
    p = q**2 / q.sum(axis=0)
    p = p / p.sum(axis=1, keepdims=True)

    def fixed_target(t):
        *w, c = deep.parted(t, like3)
        gradient = deep.divergence_gradient(net([5, 7, 2], w), c, x, q.sum(axis=0), 1.0)
        now, _ = deep.soft_assignment(net([5, 7, 2], w).forward(x)[-1], c, 1.0)
        gradient[-1] = (p * np.log((p + 1e-9) / (now + 1e-9))).sum()
        return gradient

    close_to_differences(fixed_target, deep.flat(like3))


def test_autoencoder_finds_blobs_whatever_the_partitions(spark):
    df, truth, x = tangled(spark)
    labels, losses = deep.deep_cluster(df.repartition(3), 4, latent_dim=3, epochs=60)
    assert losses[-1] < 0.4 * losses[0] and agreement(labels, truth) > 0.9
    _, _, again = deep.train_autoencoder(df.coalesce(1), 3, epochs=6)
    assert np.allclose(losses[:6], again)
    net, other = deep.Network([12, 32, 3], seed=0), deep.Network([3, 32, 12], seed=1)
    assert abs(losses[0] - ((other.forward(net.forward(x)[-1])[-1] - x) ** 2).mean()) < 1e-9
    for bad in (lambda: deep.train_autoencoder(df, 12), lambda: deep.train_autoencoder(df, 2, epochs=0), lambda: deep.deep_cluster(df, 1), lambda: deep.train_autoencoder(df.limit(1))):
        with pytest.raises(ValueError):
            bad()


def test_embedded_clustering_lowers_the_divergence(spark):
    df, truth, _ = tangled(spark)
    labels, losses = deep.deep_embedded_clustering(df, 4, latent_dim=3, hidden_dim=16, pretrain_epochs=40, cluster_epochs=15, learning_rate=5e-3)
    assert losses[-1] < losses[0] and agreement(labels, truth) > 0.9 and labels.columns == ["id", "label", "x"]


def test_contrastive_training_in_batches(spark):
    df, truth, x = tangled(spark)
    labels, losses = deep.contrastive_cluster(df, 4, latent_dim=6, hidden_dim=32, epochs=30, learning_rate=1e-2, batch=64)
    assert np.mean(losses[-5:]) < losses[0] - 0.3 and agreement(labels, truth) > 0.6
    _, again = deep.train_contrastive(df.repartition(5), 6, 32, epochs=3, learning_rate=1e-2, batch=64)
    assert np.allclose(losses[:3], again)
    u = deep.draws(np.arange(20_000, dtype=np.uint64), 3, 5)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002 and abs(np.corrcoef(u.T)[0, 1]) < 0.02 and not np.allclose(u, deep.draws(np.arange(20_000, dtype=np.uint64), 3, 6))
    with pytest.raises(ValueError):
        deep.train_contrastive(df, temperature=0.0)


def test_kernel_components_equal_dense_ones(spark):
    xs = np.random.default_rng(2).normal(size=(80, 3))
    got, values = reduce.kernel_components(points(spark, xs), 3, 0.2)
    found = {r.id: r.x for r in got.collect()}
    k = np.exp(-0.2 * ((xs[:, None] - xs[None]) ** 2).sum(-1))
    centre = np.eye(80) - 1 / 80
    w, v = np.linalg.eigh(centre @ k @ centre)
    want = v[:, ::-1][:, :3] * np.sqrt(w[::-1][:3])
    have = np.array([found[i] for i in range(80)])
    assert np.allclose(values, w[::-1][:3], atol=1e-6) and np.allclose(np.abs(have), np.abs(want), atol=1e-6)
    assert all(abs(abs(have[:, c] @ want[:, c]) / np.linalg.norm(want[:, c]) ** 2 - 1) < 1e-9 for c in range(3))
    few = {r.id: r.x[0] for r in reduce.kernel_components(points(spark, xs), 1, 0.2, landmarks=40)[0].collect()}
    assert abs(np.corrcoef([few[i] for i in range(80)], want[:, 0])[0, 1]) > 0.99
    with pytest.raises(ValueError):
        reduce.kernel_components(points(spark, xs), 3, 0.0)


def test_locally_linear_unrolls_an_arc_and_equals_numpy(spark):
    t = np.sort(np.random.default_rng(4).uniform(0, 1.5 * np.pi, 150))
    xs = np.stack([np.cos(t), np.sin(t), 0.1 * t], 1)
    got = {r.id: r.x for r in reduce.locally_linear(points(spark, xs), 1, 8).collect()}
    d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1))
    gap = np.eye(150)
    for i in range(150):
        near = np.argsort(np.where(np.arange(150) == i, np.inf, d[i]), kind="stable")[:8]
        z = xs[near] - xs[i]
        g = z @ z.T
        w = np.linalg.solve(g + 1e-3 * np.trace(g) * np.eye(8), np.ones(8))
        gap[i, near] -= w / w.sum()
    want = np.linalg.eigh(gap.T @ gap)[1][:, 1]
    have = np.array([got[i][0] for i in range(150)])
    assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6 and abs(np.corrcoef(have, t)[0, 1]) > 0.98
    few = {r.id: r.x[0] for r in reduce.locally_linear(points(spark, xs), 1, 8, landmarks=70).collect()}
    assert len(few) == 150 and abs(np.corrcoef([few[i] for i in range(150)], t)[0, 1]) > 0.95
    with pytest.raises(ValueError):
        reduce.locally_linear(points(spark, xs), 8, 8)
    with pytest.raises(ValueError):
        reduce.locally_linear(points(spark, xs[:5]), 1, 8)


def test_robust_distances_in_six_columns(spark):
    r = np.random.default_rng(3)
    n, d = 300, 6
    clean = r.normal(size=(n, d)) @ r.normal(size=(d, d)) + 1e4
    odd = clean[:30] + 40 * r.normal(size=d)
    xs = np.concatenate([clean, odd])
    table = points(spark, xs).select(F.col("id").alias("row_id"), *(F.col("x")[i].alias(f"c{i}") for i in range(d)))
    table = table.union(table.limit(1).select(F.lit(999).cast("long"), F.lit(None).cast("double"), *[F.lit(0.0)] * (d - 1)))
    found = {x.id: x.distance for x in anomaly.robust_distances(table, [f"c{i}" for i in range(d)]).collect()}
    assert 999 not in found and len(found) == len(xs)
    far = np.array([found[i] for i in range(len(xs))])
    assert set(np.argsort(-far)[:30]) == set(range(n, n + 30))
    # the moments of the rows it ends with, by numpy: the closest half by its own distances, then one refit
    h = (len(xs) + d + 1) // 2
    best = None
    for s in range(60):
        at = r.choice(len(xs), d + 1, replace=False)
        for _ in range(40):
            m, c = xs[at].mean(0), np.cov(xs[at].T, bias=True)
            dist = np.einsum("ij,jk,ik->i", xs - m, np.linalg.pinv(c), xs - m)
            new = np.sort(np.argsort(dist)[:h])
            if np.array_equal(new, at):
                break
            at = new
        det = np.linalg.slogdet(np.cov(xs[at].T, bias=True))[1]
        if best is None or det < best[0]:
            best = det, at
    m, c = xs[best[1]].mean(0), np.cov(xs[best[1]].T, bias=True)
    dist = np.einsum("ij,jk,ik->i", xs - m, np.linalg.inv(c), xs - m)
    c = c * np.sort(dist)[math.ceil(0.5 * len(xs)) - 1] / anomaly.chi_square_quantile(0.5, d)
    inside = np.einsum("ij,jk,ik->i", xs - m, np.linalg.inv(c), xs - m) <= anomaly.chi_square_quantile(0.975, d)
    m, c = xs[inside].mean(0), np.cov(xs[inside].T, bias=True)
    assert np.allclose(far, np.sqrt(np.einsum("ij,jk,ik->i", xs - m, np.linalg.inv(c), xs - m)), rtol=1e-6)
    assert abs(anomaly.chi_square_quantile(0.975, 6) - 14.449375) < 1e-5 and abs(anomaly.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9 and abs(anomaly.chi_square_quantile(0.95, 100) - 124.34211) < 1e-4
    with pytest.raises(ValueError):
        anomaly.robust_distances(table, [f"c{i}" for i in range(d)], support=0.2)


@pytest.mark.parametrize("kind", mixture.KINDS)
def test_dirichlet_mixtures_of_every_covariance(spark, kind):
    df = generators.blobs(spark, 240, [[0, 0], [9, 9], [0, 9]], 0.8)
    if kind == "full":
        df = df.withColumn("x", F.array(F.col("x")[0] + 1000, F.col("x")[1] + 0.9 * F.col("x")[0]))
    model = mixture.fit_dirichlet_mixture(df, 6, covariance=kind, max_iter=60)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:])), model.bounds
    out = model.transform(df)
    assert agreement(out, df) > 0.97 and (model.weights() > 0.01).sum() == 3 and abs(model.weights().sum() - 1) < 1e-12
    assert out.where("abs(aggregate(p, 0D, (a, b) -> a + b) - 1) > 1e-9").count() == 0
    if kind == "full":
        every = df.select("x", "truth").collect()
        xs, whole = np.array([r.x for r in every if r.truth == 0]), np.array([r.x for r in every])
        at, n, gap = np.argmin(np.linalg.norm(model.means - xs.mean(0), axis=1)), len(xs), xs.mean(0) - whole.mean(0)
        want = (np.cov(whole.T) + n * np.cov(xs.T, bias=True) + n / (n + 1) * np.outer(gap, gap)) / (2 + n)
        assert np.allclose(model.means[at], (whole.mean(0) + n * xs.mean(0)) / (n + 1), atol=0.05) and np.allclose(model.covariances()[at], want, atol=0.05)


def test_mixture_arguments(spark):
    df = generators.blobs(spark, 20, [[0, 0]], 1.0)
    for bad in (lambda: mixture.fit_dirichlet_mixture(df, covariance="other"), lambda: mixture.fit_dirichlet_mixture(df, 0), lambda: mixture.fit_dirichlet_mixture(df, prior=-1.0), lambda: mixture.fit_dirichlet_mixture(df.limit(0))):
        with pytest.raises(ValueError):
            bad()


def test_priors_share_passes_and_equal_rows_count_once(spark, monkeypatch):
    xs = np.round(np.random.default_rng(2).normal(0, 2, (40, 2)) + np.repeat([[0, 0], [9, 9]], 20, axis=0), 1)
    df = points(spark, np.repeat(xs, 3, axis=0))
    want = [mixture.fit_dirichlet_mixture(df, 4, p, max_iter=25) for p in (0.01, 1.0)]
    seen, old = [], mixture.summed
    monkeypatch.setattr(mixture, "summed", lambda rows, add, size: seen.append(rows.count()) or old(rows, add, size))
    found = mixture.prior_sensitivity(df, [0.01, 1.0], 4, rounds=25).first()
    assert [found["0.01"], found["1.0"]] == [int((m.weights() > 0.01).sum()) for m in want]
    assert set(seen) == {len(np.unique(xs, axis=0))} and len(seen) == 1 + max(len(m.bounds) for m in want)
