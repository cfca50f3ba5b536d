"""Linear models over hashed byte trigrams, fitted by ridge regression in dual form.

A row's features are the frequencies of its hashed byte trigrams (a space stands
before and after the text) and any dense columns.  Scores of a block are one
gather of weight rows and one segmented sum.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import _byte_table, utf8_buffers

BITS = 13
_CHUNK, _COLUMNS = 1 << 18, 1 << 10


def _tables(bits: int) -> list[np.ndarray]:
    return [(_byte_table(100 + i) >> np.uint64(64 - bits)).astype(np.int32) for i in range(3)]


def trigrams(column: pa.Array, bits: int = BITS, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram around each byte, and row offsets; an empty row has none."""
    data, offsets = utf8_buffers(column)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    before, after = np.empty_like(data), np.empty_like(data)
    before[1:], after[:-1] = data[:-1], data[1:]
    some = np.flatnonzero(np.diff(offsets))
    before[offsets[some]] = after[offsets[some + 1] - 1] = 0x20
    a, b, c = _tables(bits)
    return a[before] ^ b[data] ^ c[after], offsets


def row_sums(weights: np.ndarray, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the weight rows of each row's index, in chunks of bounded size."""
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    for at in range(0, len(index), _CHUNK):
        end = min(at + _CHUNK, len(index))
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end)
        cut = np.maximum(offsets[first:last], at) - at
        some = np.flatnonzero(np.diff(np.append(cut, end - at)))
        out[first + some] += np.add.reduceat(weights[index[at:end]], cut[some], axis=0)
    return out


def frequencies(index: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct trigrams of each row and their frequencies."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        key, n = np.unique(index[a:b], return_counts=True)
        out.append((key.astype(np.int32), (n / max(1, b - a)).astype(np.float32)))
    return out


@dataclass
class Ridge:
    """``weights`` (trigrams x outputs), ``dense`` (columns x outputs), ``bias`` and leave-one-out outputs of the fit."""

    weights: np.ndarray
    dense: np.ndarray
    bias: np.ndarray
    left_out: np.ndarray

    def scores(self, index: np.ndarray, offsets: np.ndarray, dense: np.ndarray | None = None) -> np.ndarray:
        n = np.maximum(np.diff(offsets), 1)[:, None]
        out = row_sums(self.weights, index, offsets) / n + self.bias
        return out if dense is None else out + dense @ self.dense


def fit_ridge(sparse: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray, targets: np.ndarray, weights: np.ndarray, penalty: float, bits: int = BITS) -> Ridge:
    """Weighted ridge regression on frequencies (scaled by their spread) and standardised dense columns.

    The rows stay sparse; the kernel and the weights are taken from blocks of
    ``_COLUMNS`` features, so the fit needs a few squares of the number of rows.
    """
    n = len(sparse)
    row = np.repeat(np.arange(n), [len(k) for k, _ in sparse])
    key, value = (np.concatenate([x[i] for x in sparse]) for i in (0, 1))
    order = np.argsort(key, kind="stable")
    row, key, value = row[order], key[order], value[order]
    w = weights / weights.mean()
    root = np.sqrt(w)[:, None]
    scale = 1 / np.sqrt(np.bincount(key, value, 1 << bits) / n + 1e-5)  # rare trigrams count as much as common ones
    mx = np.bincount(key, w[row] * value, 1 << bits) * scale / n
    centre, spread = dense.mean(axis=0), dense.std(axis=0) + 1e-9
    z = (dense - centre) / spread
    mz, my = w @ z / n, w @ targets / n
    z, y = (z - mz) * root, (targets - my) * root

    def feature_blocks():
        for first in range(0, 1 << bits, _COLUMNS):
            a, b = np.searchsorted(key, (first, first + _COLUMNS))
            block = np.zeros((n, min(_COLUMNS, 1 << bits)), np.float32)
            block[row[a:b], key[a:b] - first] = value[a:b]
            columns = slice(first, first + block.shape[1])
            block *= scale[columns].astype(np.float32)
            block -= mx[columns].astype(np.float32)
            block *= root.astype(np.float32)
            yield columns, block

    kernel = z @ z.T
    for _, block in feature_blocks():
        kernel += block @ block.T
    kernel[np.diag_indices(n)] += penalty
    inverse = np.linalg.inv(kernel)
    del kernel
    alpha = inverse @ y
    left_out = (y - alpha / np.diag(inverse)[:, None]) / root + my
    del inverse
    wx = np.empty((1 << bits, targets.shape[1]))
    for columns, block in feature_blocks():
        wx[columns] = block.T @ alpha
    wz = z.T @ alpha
    bias = my - mx @ wx - mz @ wz - (centre / spread) @ wz
    return Ridge(np.ascontiguousarray(scale[:, None] * wx, np.float32), wz / spread[:, None], bias, left_out)


def platt(score: np.ndarray, positive: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with smoothed targets."""
    p, n = positive.sum(), (~positive).sum()
    target = np.where(positive, (p + 1) / (p + 2), 1 / (n + 2))
    design = np.stack([score, np.ones_like(score)], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (mu * (1 - mu) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - mu) - 1e-6 * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def pack(sparse: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    return pa.array([k.tobytes() for k, _ in sparse], pa.binary()), pa.array([v.tobytes() for _, v in sparse], pa.binary())


def unpack(keys, values) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(k, np.int32), np.frombuffer(v, np.float32)) for k, v in zip(keys, values, strict=True)]


def fit_in_one_task(rows: DataFrame, fit):
    """What ``fit`` makes of all ``rows`` as one Arrow table, on an executor; the driver gets only that.

    For samples with a documented bound.  None where there are no rows.
    """

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield pa.record_batch([pa.array([pickle.dumps(fit(pa.Table.from_batches(batches)))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None
