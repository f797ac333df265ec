"""Landmark shapes by boosted oblivious trees.

A sample is a grey image with a rectangle; a shape is its landmarks in the
rectangle's unit square. A tree asks the same question at all nodes of a
level: the normalised difference of two pixels on the line of two landmarks.
Samples stay distributed: a level's random questions are scored by one pass
that returns sums by question, node and answer, and the driver holds the
forest only, whose size doesn't depend on the samples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    questions: np.ndarray  # (depth, 6): landmarks a and b, base on their line in thirds, both pixels' distances, threshold
    leaves: np.ndarray  # (2**depth, landmarks, 2)


@dataclass
class Forest:
    mean: np.ndarray
    trees: list[Tree] = field(default_factory=list)


def answers(image: np.ndarray, rect: np.ndarray, shape: np.ndarray, questions: np.ndarray) -> np.ndarray:
    """1 for each question whose difference is below its threshold."""
    p = rect[:2] + shape * rect[2:]
    a, b = p[questions[:, 0].astype(int)], p[questions[:, 1].astype(int)]
    v = b - a
    base = a + v * (questions[:, 2:3] / 3)

    def at(k: int) -> np.ndarray:
        q = np.floor(base + questions[:, k : k + 1] * v + 0.5).astype(int)
        return image[np.clip(q[:, 1], 0, image.shape[0] - 1), np.clip(q[:, 0], 0, image.shape[1] - 1)].astype(float)

    one, two = at(3), at(4)
    return ((one - two) / np.maximum(one + two, 1) < questions[:, 5]).astype(int)


def leaf_of(bits: np.ndarray) -> int:
    return int((bits << np.arange(len(bits) - 1, -1, -1)).sum())


def fit_shape(forest: Forest, image: np.ndarray, rect: np.ndarray) -> np.ndarray:
    """The shape in the rectangle's unit square."""
    s = forest.mean.copy()
    for t in forest.trees:
        s = s + t.leaves[leaf_of(answers(image, rect, s, t.questions))]
    return s


def _rows(batch: pa.RecordBatch):
    cols = (batch.column(c).to_pylist() for c in ("h", "w", "data", "rect", "shape"))
    for h, w, data, rect, shape in zip(*cols):
        yield np.frombuffer(data, np.uint8).reshape(h, w), np.array(rect, float), np.array(shape, float).reshape(-1, 2)


def predict(samples: DataFrame, forest: Forest) -> DataFrame:
    """(id, fitted, error): landmarks in the image, flat, and their mean distance from the true ones over the rectangle's mean side."""
    sent = samples.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            out, err = [], []
            for image, rect, shape in _rows(b):
                s = fit_shape(sent.value, image, rect)
                out.append((rect[:2] + s * rect[2:]).ravel().tolist())
                err.append(float(np.sqrt((((s - shape) * rect[2:]) ** 2).sum(1)).mean() * 2 / max(rect[2:].sum(), 1e-9)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float64())), pa.array(err, pa.float64())], names=["id", "fitted", "error"])

    return samples.mapInArrow(run, "id long, fitted array<double>, error double")


def _sums(samples: DataFrame, forest: Forest, done: np.ndarray, tried: np.ndarray) -> dict:
    """(question, node, answer) to (count, summed residual): one pass over the samples, with partial sums by task."""
    sent = samples.sparkSession.sparkContext.broadcast((forest, done, tried))

    def run(batches):
        f, asked, new = sent.value
        total: dict = {}
        for b in batches:
            for image, rect, shape in _rows(b):
                s = fit_shape(f, image, rect)
                node = leaf_of(answers(image, rect, s, asked)) if len(asked) else 0
                rest = (shape - s).ravel()
                for q, bit in enumerate(answers(image, rect, s, new) if len(new) else [0]):
                    n, r = total.get((q, node, int(bit)), (0, 0.0))
                    total[q, node, int(bit)] = (n + 1, r + rest)
        keys = list(total)
        cols = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1].tolist() for k in keys], pa.list_(pa.float64()))], names=["q", "node", "bit", "n", "r"])

    size = 2 * len(forest.mean)
    made = samples.mapInArrow(run, "q int, node int, bit int, n long, r array<double>").groupBy("q", "node", "bit")
    rows = made.agg(F.sum("n").alias("n"), *(F.sum(F.element_at("r", i + 1)).alias(f"r{i}") for i in range(size))).collect()
    return {(r.q, r.node, r.bit): (r.n, np.array([r[f"r{i}"] for i in range(size)])) for r in rows}


def train(samples: DataFrame, trees: int, depth: int, tries: int, rate: float = 0.5, seed: int = 0) -> Forest:
    """Gradient boosting: in each level the best of some random questions by the sum of |summed residual|^2 / count."""
    size = samples.select(F.size("shape")).first()[0]
    mean = samples.agg(*(F.avg(F.element_at("shape", i + 1)) for i in range(size))).first()
    forest = Forest(np.array(mean, float).reshape(-1, 2))
    rng = np.random.default_rng(seed)
    for _ in range(trees):
        done = np.zeros((0, 6))
        for _ in range(depth):
            marks = np.array([rng.choice(size // 2, 2, replace=False) for _ in range(tries)])
            new = np.column_stack([marks, rng.integers(0, 4, tries), rng.uniform(-0.75, 0.75, (tries, 2)), rng.normal(0, 0.15, tries)])
            score = np.zeros(tries)
            for (q, _, _), (n, r) in _sums(samples, forest, done, new).items():
                score[q] += (r**2).sum() / n
            done = np.vstack([done, new[int(np.argmax(score))]])
        leaves = np.zeros((1 << depth, size // 2, 2))
        for (_, node, _), (n, r) in _sums(samples, forest, done, np.zeros((0, 6))).items():
            leaves[node] = rate * (r / n).reshape(-1, 2)
        forest.trees.append(Tree(done, leaves))
    return forest
