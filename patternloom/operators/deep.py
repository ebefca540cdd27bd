"""Clusters in learned spaces: autoencoder, deep embedded clustering, contrastive training.

The networks are small and the tables are not, so the weights travel and the
rows stay: each step broadcasts the weights, every task adds up the gradient of
its own rows in numpy, and the driver, which alone holds the weights and Adam's
moments, takes the sum.  Gradients are over all rows, or for the contrastive loss
over all batches, so a step does not depend on how rows lie in partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.operators.cluster import kmeans
from patternloom.operators.iterate import settle
from patternloom.operators.passes import lists, matrix, summed

#: Rows of a batch of the contrastive loss, in the mean.
BATCH = 512


class Network:
    """Layers with a rectifier between them and none after the last; `weights` holds a matrix and a bias for each."""

    def __init__(self, sizes: Sequence[int], weights: list[np.ndarray] | None = None, seed: int = 0) -> None:
        self.sizes = list(sizes)
        if weights is None:
            r, weights = np.random.default_rng(seed), []
            for n, m in zip(sizes, sizes[1:]):
                weights += [r.uniform(-1, 1, (n, m)) / math.sqrt(n), r.uniform(-1, 1, m) / math.sqrt(n)]
        self.weights = weights

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The inputs of every layer, and the output last."""
        seen = [x]
        for i in range(0, len(self.weights), 2):
            x = seen[-1] @ self.weights[i] + self.weights[i + 1]
            seen.append(np.maximum(x, 0.0) if i + 2 < len(self.weights) else x)
        return seen

    def backward(self, seen: list[np.ndarray], up: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The gradients of the weights, and of the input, from that of the output."""
        found: list[np.ndarray] = []
        for i in range(len(self.weights) - 2, -1, -2):
            below = seen[i // 2]
            found = [below.T @ up, up.sum(axis=0), *found]
            up = up @ self.weights[i].T
            if i:
                up = up * (below > 0)
        return found, up


def flat(parts: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(p) for p in parts])


def parted(vector: np.ndarray, like: Sequence[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([p.size for p in like])
    return [v.reshape(p.shape) for v, p in zip(np.split(vector, ends[:-1]), like, strict=True)]


class Adam:
    """Adam's steps on one vector."""

    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, np.zeros(size), np.zeros(size)

    def step(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return at - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def _rows(df: DataFrame, id_col: str, x: str) -> tuple[DataFrame, int, int]:
    """(id, x) kept for many passes, how many there are and how wide they are."""
    rows = settle(df.select(F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x")))
    facts = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    if facts[0] < 2:
        raise ValueError("at least two rows are needed")
    if facts[1] != facts[2]:
        raise ValueError("rows differ in length")
    return rows, facts[0], facts[1]


def _check(latent_dim: int, hidden_dim: int, epochs: int, d: int) -> None:
    if not 1 <= latent_dim < d:
        raise ValueError("latent_dim must lie between 1 and one less than the number of columns")
    if hidden_dim < 1 or epochs < 1:
        raise ValueError("hidden_dim and epochs must be positive")


@dataclass
class Encoder:
    """A trained way from rows to their places in the learned space."""

    network: Network

    def transform(self, df: DataFrame, id_col: str = "id", x: str = "x") -> DataFrame:
        """(id, x) with `x` the learned place; no shuffle, on streams too."""
        shared = df.sparkSession.sparkContext.broadcast(self.network)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    z = shared.value.forward(matrix(b.column(1)))[-1]
                    yield pa.RecordBatch.from_arrays([b.column(0), lists(z)], names=["id", "x"])

        rows = df.select(F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x"))
        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


def reconstruction_gradient(encoder: Network, decoder: Network, x: np.ndarray, n: int) -> np.ndarray:
    """The flat gradient of the mean squared error over `n` rows in all, from the rows `x`, and their share of the error last."""
    inner = encoder.forward(x)
    outer = decoder.forward(inner[-1])
    gap = outer[-1] - x
    scale = 1.0 / (n * x.shape[1])
    back, up = decoder.backward(outer, 2 * scale * gap)
    return np.append(flat(encoder.backward(inner, up)[0] + back), scale * (gap**2).sum())


def _descend(theta: np.ndarray, epochs: int, rate: float, gradient: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[float]]:
    """Steps down a gradient whose last entry is the loss."""
    adam, losses = Adam(len(theta), rate), []
    for _ in range(epochs):
        found = gradient(theta)
        losses.append(float(found[-1]))
        theta = adam.step(theta, found[:-1])
    return theta, losses


def _over(rows: DataFrame, size: int, part: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """`part(theta, batch)` summed over all rows, as a function of theta."""
    context = rows.sparkSession.sparkContext

    def gradient(theta: np.ndarray) -> np.ndarray:
        shared = context.broadcast(theta)
        found = summed(rows, lambda b: part(shared.value, b), size)
        shared.unpersist()
        return found

    return gradient


def train_autoencoder(
    df: DataFrame, latent_dim: int = 2, hidden_dim: int = 32, epochs: int = 150, learning_rate: float = 1e-2, random_state: int = 0, id_col: str = "id", x: str = "x"
) -> tuple[Encoder, Network, list[float]]:
    """The encoder, the decoder and the loss before each step of an autoencoder of one hidden layer either way.

    One pass a step, over all rows; scale them beforehand.  Runs at once.
    """
    rows, n, d = _rows(df, id_col, x)
    _check(latent_dim, hidden_dim, epochs, d)
    return _autoencoder(rows, n, d, latent_dim, hidden_dim, epochs, learning_rate, random_state)


def _autoencoder(rows: DataFrame, n: int, d: int, latent_dim: int, hidden_dim: int, epochs: int, rate: float, seed: int) -> tuple[Encoder, Network, list[float]]:
    down, up = [d, hidden_dim, latent_dim], [latent_dim, hidden_dim, d]
    first = Network(down, seed=seed), Network(up, seed=seed + 1)
    like, split = first[0].weights + first[1].weights, len(first[0].weights)

    def part(theta: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        w = parted(theta, like)
        return reconstruction_gradient(Network(down, w[:split]), Network(up, w[split:]), matrix(b.column(1)), n)

    theta = flat(like)
    theta, losses = _descend(theta, epochs, rate, _over(rows, len(theta) + 1, part))
    w = parted(theta, like)
    return Encoder(Network(down, w[:split])), Network(up, w[split:]), losses


def deep_cluster(
    df: DataFrame, k: int, latent_dim: int = 2, hidden_dim: int = 32, epochs: int = 150, learning_rate: float = 1e-2, random_state: int = 0, id_col: str = "id", x: str = "x"
) -> tuple[DataFrame, list[float]]:
    """(id, label, x) by k-means in the space of an autoencoder, and its losses.  Runs at once."""
    rows, n, d = _rows(df, id_col, x)
    _check(latent_dim, hidden_dim, epochs, d)
    _clusters(k, n)
    encoder, _, losses = _autoencoder(rows, n, d, latent_dim, hidden_dim, epochs, learning_rate, random_state)
    places = settle(encoder.transform(rows))
    return kmeans(places, k, random_state=random_state).join(places, "id"), losses


def _clusters(k: int, n: int) -> None:
    if not 2 <= k <= n:
        raise ValueError("k must lie between 2 and the number of rows")


def soft_assignment(z: np.ndarray, centres: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Student's kernel (1 + d^2 / alpha)^(-(alpha + 1) / 2) to each centre as shares, and 1 + d^2 / alpha."""
    spread = 1 + ((z[:, None, :] - centres[None]) ** 2).sum(axis=2) / alpha
    kernel = spread ** (-(alpha + 1) / 2)
    return kernel / kernel.sum(axis=1, keepdims=True), spread


def divergence_gradient(encoder: Network, centres: np.ndarray, x: np.ndarray, mass: np.ndarray, alpha: float) -> np.ndarray:
    """The flat gradient for encoder and centres of KL(p || q) over the rows `x`, and that divergence last.

    `p` sharpens q by the centres' `mass`, its column sums over the whole
    table, and is held fixed.
    """
    seen = encoder.forward(x)
    z = seen[-1]
    q, spread = soft_assignment(z, centres, alpha)
    p = q**2 / mass
    p = p / p.sum(axis=1, keepdims=True)
    up = -p / (q + 1e-9)
    # through the shares, then through the logarithm of the kernel
    up = q * (up - (up * q).sum(axis=1, keepdims=True)) * (-(alpha + 1) / (2 * alpha)) / spread
    gap = z[:, None, :] - centres[None]
    pull = 2 * up[:, :, None] * gap
    weights, _ = encoder.backward(seen, pull.sum(axis=1))
    return np.append(flat([*weights, -pull.sum(axis=0)]), (p * np.log((p + 1e-9) / (q + 1e-9))).sum())


def deep_embedded_clustering(
    df: DataFrame, k: int, latent_dim: int = 10, hidden_dim: int = 64, pretrain_epochs: int = 150, cluster_epochs: int = 60, learning_rate: float = 1e-3, alpha: float = 1.0, random_state: int = 0, id_col: str = "id", x: str = "x"
) -> tuple[DataFrame, list[float]]:
    """(id, label, x) after encoder and centres have moved together towards a sharpened assignment, and the divergences.

    An autoencoder gives the first encoder and k-means in its space the first
    centres.  Then every step takes two passes: one sums the assignment of
    each centre over the table, one the gradient.  Runs at once.
    """
    rows, n, d = _rows(df, id_col, x)
    _check(latent_dim, hidden_dim, pretrain_epochs, d)
    _clusters(k, n)
    if cluster_epochs < 1 or alpha <= 0:
        raise ValueError("cluster_epochs and alpha must be positive")
    encoder, _, _ = _autoencoder(rows, n, d, latent_dim, hidden_dim, pretrain_epochs, 1e-2, random_state)
    places = settle(encoder.transform(rows))
    means = kmeans(places, k, random_state=random_state).join(places, "id").groupBy("label").agg(F.array(*(F.avg(F.col("x")[c]) for c in range(latent_dim))).alias("c"))
    centres = np.array([r["c"] for r in means.orderBy("label").collect()])
    sizes = encoder.network.sizes
    like = [*encoder.network.weights, centres]

    def mass_part(theta: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        *w, c = parted(theta, like)
        return soft_assignment(Network(sizes, w).forward(matrix(b.column(1)))[-1], c, alpha)[0].sum(axis=0)

    masses = _over(rows, len(centres), mass_part)
    size = flat(like).size + 1

    def gradient(theta: np.ndarray) -> np.ndarray:
        mass = masses(theta)

        def part(theta: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            *w, c = parted(theta, like)
            return divergence_gradient(Network(sizes, w), c, matrix(b.column(1)), mass, alpha)

        return _over(rows, size, part)(theta)

    theta, losses = _descend(flat(like), cluster_epochs, learning_rate, gradient)
    *w, centres = parted(theta, like)
    places = settle(Encoder(Network(sizes, w)).transform(rows))
    kernel = F.array(*(F.lit(1.0) + sum(((F.col("x")[i] - float(v)) * (F.col("x")[i] - float(v)) for i, v in enumerate(c)), F.lit(0.0)) for c in centres))
    label = (F.array_position(kernel, F.array_min(kernel)) - 1).cast("int")  # the nearest centre has the greatest share
    return places.select("id", label.alias("label"), "x"), losses


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def draws(keys: np.ndarray, width: int, stream: int) -> np.ndarray:
    """Uniform draws from (0, 1), a row of `width` for each key: a mix of key, place and stream (splitmix64), the same wherever the row lies."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] * _MIX[0] + np.arange(1, width + 1, dtype=np.uint64)[None] * _MIX[1] + np.uint64(stream) * _MIX[2]
        for _ in range(2):
            h = (h ^ (h >> np.uint64(30))) * _MIX[1]
            h = (h ^ (h >> np.uint64(27))) * _MIX[2]
            h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def view(x: np.ndarray, keys: np.ndarray, noise: float, mask: float, stream: int) -> np.ndarray:
    """Rows with normal noise, and each entry zeroed with probability `mask`, by draws of three streams."""
    d = x.shape[1]
    normal = np.sqrt(-2 * np.log(draws(keys, d, stream))) * np.cos(2 * np.pi * draws(keys, d, stream + 1))
    return (x + noise * normal) * (draws(keys, d, stream + 2) >= mask)


def contrast_gradient(encoder: Network, head: Network, one: np.ndarray, two: np.ndarray, temperature: float) -> np.ndarray:
    """The flat gradient for encoder and head of the summed contrastive loss of the rows' two views, and that loss last.

    Each view is to pick its row's other view among all other views of the
    batch by cosine over `temperature`.
    """
    n = len(one)
    low = encoder.forward(np.concatenate([one, two]))
    high = head.forward(low[-1])
    z = high[-1]
    length = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    u = z / length
    s = u @ u.T / temperature
    np.fill_diagonal(s, -np.inf)
    s -= s.max(axis=1, keepdims=True)
    p = np.exp(s)
    total = p.sum(axis=1, keepdims=True)
    at, other = np.arange(2 * n), (np.arange(2 * n) + n) % (2 * n)
    loss = float((np.log(total[:, 0]) - s[at, other]).sum())
    p /= total
    p[at, other] -= 1
    up = (p + p.T) @ u / temperature
    up = (up - u * (up * u).sum(axis=1, keepdims=True)) / length
    back, up = head.backward(high, up)
    return np.append(flat(encoder.backward(low, up)[0] + back), loss)


def train_contrastive(
    df: DataFrame,
    latent_dim: int = 10,
    hidden_dim: int = 64,
    projection_dim: int = 16,
    epochs: int = 200,
    learning_rate: float = 1e-3,
    noise_std: float = 0.1,
    mask_prob: float = 0.2,
    temperature: float = 0.5,
    random_state: int = 0,
    batch: int = BATCH,
    id_col: str = "id",
    x: str = "x",
) -> tuple[Encoder, list[float]]:
    """The encoder whose rows' two noisy, masked views find each other, and the loss before each step.

    Rows are dealt out once, by hash, to batches of about `batch` rows, and
    views are told apart within a batch, so the work grows with the rows and
    not with their square; a table of no more than `batch` rows is one batch.
    The noise is a hash of seed, step, row and place.  Runs at once.
    """
    rows, n, d = _rows(df, id_col, x)
    _check(latent_dim, hidden_dim, epochs, d)
    if not 0 <= mask_prob < 1 or temperature <= 0 or noise_std < 0 or projection_dim < 1 or batch < 2:
        raise ValueError("mask_prob must lie in [0, 1), temperature, projection_dim and batch be positive, noise_std not negative")
    down, over = [d, hidden_dim, latent_dim], [latent_dim, projection_dim, projection_dim]
    first = Network(down, seed=random_state), Network(over, seed=random_state + 1)
    like, split = first[0].weights + first[1].weights, len(first[0].weights)
    n_batches = max(1, -(-n // batch))
    key = F.xxhash64(F.lit(random_state), "id")
    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_batches)).alias("b"), F.struct(key.alias("key"), "x").alias("r"))
    batches = settle(dealt.groupBy("b").agg(F.sort_array(F.collect_list("r")).alias("r")).select(F.transform("r", lambda r: r["key"]).alias("key"), F.transform("r", lambda r: r["x"]).alias("x")))
    step = [0]

    def gradient(theta: np.ndarray) -> np.ndarray:
        stream = 6 * step[0]
        step[0] += 1

        def part(theta: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            w, found = parted(theta, like), 0.0
            for keys, xs in zip(b.column(0), b.column(1), strict=True):
                keys, xs = keys.values.to_numpy().view(np.uint64), matrix(xs.values)
                views = view(xs, keys, noise_std, mask_prob, stream), view(xs, keys, noise_std, mask_prob, stream + 3)
                found = found + contrast_gradient(Network(down, w[:split]), Network(over, w[split:]), *views, temperature)
            return found / (2 * n)

        return _over(batches, len(theta) + 1, part)(theta)

    theta, losses = _descend(flat(like), epochs, learning_rate, gradient)
    return Encoder(Network(down, parted(theta, like)[:split])), losses


def contrastive_cluster(df: DataFrame, k: int, random_state: int = 0, id_col: str = "id", x: str = "x", **settings) -> tuple[DataFrame, list[float]]:
    """(id, label, x) by k-means in the space of `train_contrastive`, and its losses.  Runs at once."""
    _clusters(k, df.count())
    encoder, losses = train_contrastive(df, random_state=random_state, id_col=id_col, x=x, **settings)
    places = settle(encoder.transform(df, id_col, x))
    return kmeans(places, k, random_state=random_state).join(places, "id"), losses
