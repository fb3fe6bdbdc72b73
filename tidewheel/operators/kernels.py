"""Per-episode array kernels: spectra, nearest states, change points, content hashes.

Each gets one episode's arrays; an episode is the unit that a task holds in memory.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _matrix(rows: pd.Series) -> np.ndarray:
    """One row per frame; no rows where a frame lacks the array or arrays differ in length."""
    sizes = {None if x is None else len(x) for x in rows}
    if len(sizes) != 1 or not max(sizes, key=lambda n: n or 0):
        return np.zeros((0, 0))
    return np.array([np.asarray(x, "f8") for x in rows])


def sparc(x: np.ndarray, dt: float, cut_hz: float = 10.0, floor: float = 0.05) -> float | None:
    """Spectral arc length of the speed profile; null without motion."""
    if len(x) < 4 or dt <= 0:
        return None
    speed = np.linalg.norm(np.gradient(x, dt, axis=0), axis=1)
    if speed.max() < 1e-12:
        return None
    n = 2 ** (math.ceil(math.log2(len(speed))) + 4)
    amplitude = np.abs(np.fft.rfft(speed, n))
    amplitude /= amplitude.max()
    freq = np.fft.rfftfreq(n, dt)
    loud = np.flatnonzero(amplitude >= floor)
    top = min(float(freq[loud[-1]]), cut_hz) if len(loud) else 0.0
    inside = freq <= top
    if top <= 0 or inside.sum() < 2:
        return None
    return float(-np.hypot(np.diff(freq[inside]) / top, np.diff(amplitude[inside])).sum())


def psd_bands(x: np.ndarray, fps: float, low: float = 2.0, high: float = 8.0) -> tuple[float, float, float] | None:
    """Shares of power up to ``low``, between, and above ``high`` Hz, mean over dimensions."""
    if len(x) < 4 or fps / 2 <= high:
        return None
    power = np.abs(np.fft.rfft(x - x.mean(axis=0), axis=0)) ** 2
    freq = np.fft.rfftfreq(len(x), 1 / fps)
    total = power.sum(axis=0)
    total = np.where(total > 0, total, 1.0)
    lo, hi = power[freq <= low].sum(axis=0) / total, power[freq > high].sum(axis=0) / total
    mid = power[(freq > low) & (freq <= high)].sum(axis=0) / total
    return float(lo.mean()), float(mid.mean()), float(hi.mean())


def neighbour_variance(states: np.ndarray, actions: np.ndarray, k: int = 5, block: int = 256) -> float | None:
    """Variance of the actions taken in each frame's ``k`` nearest states, averaged; the earlier frame on a tie."""
    n = len(states)
    if n < k + 2 or len(actions) != n:
        return None
    total = 0.0
    for at in range(0, n, block):
        some = states[at : at + block]
        d = np.zeros((len(some), n))
        for j in range(states.shape[1]):
            d += (some[:, j : j + 1] - states[None, :, j]) ** 2
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        near, tie = d < last, d == last
        near |= tie & (tie.cumsum(axis=1) <= k - near.sum(axis=1, keepdims=True))
        total += actions[np.nonzero(near)[1].reshape(-1, k)].var(axis=1).mean(axis=1).sum()
    return float(total / n)


def _distances(x: np.ndarray, block: int = 256):
    """Squared distances of all pairs i < j, a block of rows at a time."""
    square = (x**2).sum(1)
    for at in range(0, len(x), block):
        d = np.maximum(square[at : at + block, None] + square[None, at:] - 2 * x[at : at + block] @ x[at:].T, 0)
        yield d[np.triu_indices(len(d), 1, d.shape[1])]


def middle_distance(x: np.ndarray, held: int = 2_000_000) -> float:
    """The exact median of all pairs' squared distances; a bracket of its value is narrowed until few pairs lie in it."""
    n = len(x) * (len(x) - 1) // 2
    low, high, below = 0.0, max((float(d.max()) for d in _distances(x) if len(d)), default=0.0), 0
    ranks = [(n - 1) // 2, n // 2]
    while n and low < high:
        counts, edges = np.zeros(1024, "i8"), np.linspace(low, high, 1025)
        for d in _distances(x):
            counts += np.histogram(d, edges)[0]
        up_to = below + counts.cumsum()
        k, j = (int(np.searchsorted(up_to, r, "right")) for r in ranks)
        inside, below = int(up_to[j] - (up_to[k] - counts[k])), int(up_to[k] - counts[k])
        shrunk = edges[k] > low or edges[j + 1] < high
        low, high = float(edges[k]), float(edges[j + 1])
        if inside <= held or not shrunk:
            break
    found = np.sort(np.concatenate([d[(d >= low) & (d <= high)] for d in _distances(x)])) if n else np.zeros(0)
    if not n:
        return 0.0
    first = sum(int((d < low).sum()) for d in _distances(x))
    return float((found[ranks[0] - first] + found[ranks[1] - first]) / 2)


class _Means:
    """``l2``: squared distances to the mean, from running sums."""

    def __init__(self, x: np.ndarray):
        self.s, self.q = np.vstack([np.zeros(x.shape[1]), x.cumsum(0)]), np.concatenate([[0], (x**2).sum(1).cumsum()])

    def __call__(self, a: np.ndarray, b: int) -> np.ndarray:
        return self.q[b] - self.q[a] - ((self.s[b] - self.s[a]) ** 2).sum(1) / (b - a)


class _Medians:
    """``l1``: distances to the median."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def __call__(self, a: np.ndarray, b: int) -> np.ndarray:
        return np.array([np.abs(self.x[i:b] - np.median(self.x[i:b], axis=0)).sum() for i in a])


class _Kernel:
    """``rbf``: a Gaussian kernel whose width is the median squared distance.

    Ends come in order, so the kernel's sum over each open stretch is carried along: a
    step adds one column of the kernel. Memory is linear in the frames.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.square, middle = x, (x**2).sum(1), middle_distance(x)
        self.width, self.sums, self.end = middle if middle > 0 else 1.0, np.zeros(len(x)), 0

    def __call__(self, a: np.ndarray, b: int) -> np.ndarray:
        while self.end < b:
            k = self.end
            d = np.maximum(self.square[:k] + self.square[k] - 2 * self.x[:k] @ self.x[k], 0)
            column = np.exp(-np.clip(d / self.width, 1e-2, 1e2))
            self.sums[:k] += 2 * column[::-1].cumsum()[::-1] + 1.0
            self.sums[k] = 1.0
            self.end += 1
        return (b - a) - self.sums[a] / (b - a)


class _Gaussian:
    """``normal``: the log determinant of the covariance, times the length."""

    def __init__(self, x: np.ndarray):
        d = x.shape[1]
        self.s = np.vstack([np.zeros(d), x.cumsum(0)])
        self.q = np.concatenate([np.zeros((1, d, d)), (x[:, :, None] * x[:, None, :]).cumsum(0)])

    def __call__(self, a: np.ndarray, b: int) -> np.ndarray:
        n = (b - a)[:, None, None]
        s = self.s[b] - self.s[a]
        cov = (self.q[b] - self.q[a] - s[:, :, None] * s[:, None, :] / n) / np.maximum(n - 1, 1)
        return np.linalg.slogdet(cov + 1e-6 * np.eye(cov.shape[1]))[1] * (b - a)


class _Regression:
    """``ar``: what a linear prediction from the last four frames leaves."""

    ORDER = 4

    def __init__(self, x: np.ndarray):
        k = min(self.ORDER, len(x) - 1)
        lags = np.hstack([np.vstack([x[:k], x[k - j : len(x) - j]]) for j in range(k, 0, -1)]) if k else np.zeros((len(x), 0))
        lags[:k] = lags[k] if len(x) > k else 0
        z = np.hstack([lags, np.ones((len(x), 1)), x])
        self.p = lags.shape[1] + 1
        self.q = np.concatenate([np.zeros((1, z.shape[1], z.shape[1])), (z[:, :, None] * z[:, None, :]).cumsum(0)])

    def __call__(self, a: np.ndarray, b: int) -> np.ndarray:
        m, p = self.q[b] - self.q[a], self.p
        g, c = m[:, :p, :p], m[:, :p, p:]
        left = np.trace(m[:, p:, p:] - c.transpose(0, 2, 1) @ np.linalg.pinv(g, rcond=1e-10, hermitian=True) @ c, axis1=1, axis2=2)
        return np.maximum(left, 0.0)


COSTS = {"l2": _Means, "rbf": _Kernel, "l1": _Medians, "normal": _Gaussian, "ar": _Regression}


def pelt(x: np.ndarray, penalty: float, min_size: int = 10, model: str = "l2") -> list[int]:
    """Ends of the segments of least cost plus ``penalty`` each, by pruned dynamic programming.

    ``model`` names one of ``COSTS``.
    """
    n = len(x)
    if model not in COSTS:
        raise ValueError(f"no such model: {model}")
    if n < 2 * min_size:
        return [n]
    cost = COSTS[model](x)
    best, back, alive = np.full(n + 1, np.inf), np.zeros(n + 1, "i8"), np.array([0])
    best[0] = -penalty
    for b in range(min_size, n + 1):
        fits = alive[b - alive >= min_size]
        value = best[fits] + cost(fits, b) + penalty
        k = int(np.argmin(value))
        best[b], back[b] = value[k], fits[k]
        keep = np.concatenate([fits[value <= best[b] + penalty], alive[b - alive < min_size]])
        alive = np.append(keep, b - min_size + 1) if b - min_size + 1 >= min_size else keep
    ends, b = [], n
    while b > 0:
        ends.append(int(b))
        b = int(back[b])
    return ends[::-1]


def content_hash(states: list, actions: list, times: list) -> str:
    """A hex digest of an episode's numbers: sizes, then each frame's state, action and time."""
    import xxhash

    first = lambda rows: len(rows[0]) if rows and rows[0] is not None else 0
    h = xxhash.xxh3_64()
    h.update(struct.pack("<iii", len(times), first(states), first(actions)))
    for s, a, t in zip(states, actions, times, strict=True):
        for x in (s, a):
            if x is not None:
                h.update(np.asarray(x, "<f4").tobytes())
        if t is not None:
            h.update(struct.pack("<d", t))
        h.update(b"\0")
    return h.hexdigest()


def episode_kernels(frames: DataFrame, fps: float, k: int = 5) -> DataFrame:
    """``episode_id, n_frames, sparc, psd_low, psd_mid, psd_high, neighbour_variance, content_hash``.

    Spectra use the mean step of the stored times if those are finite and increase, else ``fps``.
    """
    kind = frames.schema["episode_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_index", kind="stable")
        x, a = _matrix(rows["state"]), _matrix(rows["action"])
        steps = np.diff(rows["timestamp"].to_numpy("f8"))
        dt = float(steps.mean()) if len(steps) and (steps > 0).all() and np.isfinite(steps).all() else 1 / fps
        bands = psd_bands(a, 1 / dt) or (None, None, None)
        out = [rows["episode_id"].iloc[0], len(rows), sparc(x, dt), *bands, neighbour_variance(x, a, k), content_hash(list(rows["state"]), list(rows["action"]), list(rows["timestamp"]))]
        return pd.DataFrame([out], columns=["episode_id", "n_frames", "sparc", "psd_low", "psd_mid", "psd_high", "neighbour_variance", "content_hash"])

    columns = frames.select("episode_id", "frame_index", "timestamp", "state", "action")
    return columns.groupBy("episode_id").applyInPandas(
        run, f"episode_id {kind}, n_frames long, sparc double, psd_low double, psd_mid double, psd_high double, neighbour_variance double, content_hash string"
    )
