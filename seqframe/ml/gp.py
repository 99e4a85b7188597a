"""Evidence of inducing-point Gaussian processes and its optimisation from restarts (M3).

With inducing rows Z, K = k(Z, Z) and k(Z, X) for the training rows X, the
evidence needs only sums over the rows: A = k(Z,X) k(X,Z), b = k(Z,X) y and
y'y; its derivative by the log length scale needs dk(Z,X) k(X,Z) and dk(Z,X) y.
One pass sums them for all restarts of all training sets. The noise does
not enter the sums, so it is optimised exactly for each length scale on those
m x m sums, and the length scales of all restarts then move by one step
of a sign-based line search. With every row inducing the process is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from seqframe.ml.optim import summed

JITTER = 1e-8
#: Tried in turn for a set none of whose length scales has a positive-definite system: inducing rows may be copies or nearly so.
JITTERS = (JITTER, 1e-6, 1e-4, 1e-2)
#: Noise variances that are tried (with unit variance of y), before the interval around the best is narrowed.
NOISES = np.exp(np.linspace(math.log(1e-4), math.log(10.0), 24))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def rbf(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    return np.exp(-0.5 * squares(a, b) / (length * length))


@dataclass
class Fit:
    evidence: float
    length: float
    noise: float
    slope: float
    alpha: np.ndarray
    minv: np.ndarray


class Sums:
    """A, C, b, db of one restart, from a flat vector."""

    def __init__(self, v: np.ndarray, m: int):
        self.a, self.c = v[:m * m].reshape(m, m), v[m * m:2 * m * m].reshape(m, m)
        self.b, self.db = v[2 * m * m:2 * m * m + m], v[2 * m * m + m:]

    @staticmethod
    def size(m: int) -> int:
        return 2 * m * m + 2 * m


def evidence(s: Sums, z: np.ndarray, length: float, noise: float, n: float, yy: float, jitter: float = JITTER) -> Fit | None:
    """The log evidence and its slope by the log length scale; None where a matrix is not positive definite."""
    m, d2 = len(z), squares(z, z)
    k = np.exp(-0.5 * d2 / length ** 2)
    dk = k * d2 / length ** 2
    k = k + jitter * np.eye(m)
    try:
        chol_m, chol_k = np.linalg.cholesky(noise * k + s.a), np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        return None
    minv, kinv = np.linalg.inv(noise * k + s.a), np.linalg.inv(k)
    alpha = minv @ s.b
    logs = (n - m) * math.log(noise) + 2 * np.log(np.diag(chol_m)).sum() - 2 * np.log(np.diag(chol_k)).sum()
    value = -0.5 * (logs + (yy - s.b @ alpha) / noise + n * math.log(2 * math.pi))
    dm = noise * dk + s.c + s.c.T
    dq = 2 * alpha @ s.db - alpha @ dm @ alpha
    slope = -0.5 * ((minv * dm).sum() - (kinv * dk).sum() - dq / noise)
    return Fit(float(value), length, noise, float(slope), alpha, minv)


def with_best_noise(s: Sums, z: np.ndarray, length: float, n: float, yy: float, noise: float | None = None,
                    jitter: float = JITTER) -> Fit | None:
    """The evidence at the given noise, or at the best one: a grid, then golden sections of its neighbourhood."""
    if noise is not None:
        return evidence(s, z, length, noise, n, yy, jitter)
    tried = [(f.evidence, i) for i, x in enumerate(NOISES) if (f := evidence(s, z, length, float(x), n, yy, jitter)) is not None]
    if not tried:
        return None
    i = max(tried)[1]
    lo, hi = math.log(NOISES[max(i - 1, 0)]), math.log(NOISES[min(i + 1, len(NOISES) - 1)])
    ratio = (math.sqrt(5) - 1) / 2
    def value(x):
        f = evidence(s, z, length, math.exp(x), n, yy, jitter)
        return -math.inf if f is None else f.evidence
    for _ in range(14):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        if value(a) >= value(b):
            hi = b
        else:
            lo = a
    got = [f for x in (math.exp((lo + hi) / 2), float(NOISES[i])) if (f := evidence(s, z, length, x, n, yy, jitter)) is not None]
    return max(got, key=lambda f: f.evidence)


def starts(dim: int, count: int, seed: int) -> list[float]:
    """Length scales to start from: the usual one, then log-uniform draws; a shorter list is the beginning of a longer one."""
    rng, base = np.random.default_rng(seed), math.sqrt(max(dim, 1))
    return [base] + [base * math.exp(rng.uniform(math.log(0.05), math.log(20.0))) for _ in range(count - 1)]


Parts = Callable[[object], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def evidence_sums(rows: DataFrame, parts: Parts, inducing: list[np.ndarray], lengths: list[list[float]], max_sums: int) -> tuple[list[list[Sums]], np.ndarray]:
    """``Sums`` of every set and length scale, and y'y of the sets; sets that do not fit one pass take another."""
    sc = rows.sparkSession.sparkContext
    out: list[list[Sums]] = [[] for _ in inducing]
    yy = np.zeros(len(inducing))
    size = [len(own) * Sums.size(len(z)) + 1 for own, z in zip(lengths, inducing)]
    todo = list(range(len(inducing)))
    while todo:
        now, held = [], 0
        while todo and (not now or held + size[todo[0]] <= max_sums):
            held += size[todo[0]]
            now.append(todo.pop(0))
        sent = sc.broadcast(([inducing[s] for s in now], [lengths[s] for s in now]))
        at = dict(zip(now, np.cumsum([0] + [size[s] for s in now]).tolist()))
        slot = {s: i for i, s in enumerate(now)}

        def run(batches):
            zs, ls = sent.value
            acc = np.zeros(held)
            for pdf in batches:
                if not len(pdf):
                    continue
                for s, x, y in parts(pdf):
                    if s not in slot or not len(x):
                        continue
                    z, off = zs[slot[s]], at[s]
                    m, d2 = len(z), squares(z, x)
                    for length in ls[slot[s]]:
                        k = np.exp(-0.5 * d2 / length ** 2)
                        dk = k * d2 / length ** 2
                        acc[off:off + Sums.size(m)] += np.concatenate([(k @ k.T).ravel(), (dk @ k.T).ravel(), k @ y, dk @ y])
                        off += Sums.size(m)
                    acc[off] += y @ y
            return acc

        v = summed(rows, run, held)
        sent.unpersist()
        for s in now:
            m, off = len(inducing[s]), at[s]
            for _ in lengths[s]:
                out[s].append(Sums(v[off:off + Sums.size(m)], m))
                off += Sums.size(m)
            yy[s] = v[off]
    return out, yy


def restarts(rows: DataFrame, parts: Parts, inducing: list[np.ndarray], n: np.ndarray, count: int, steps: int, seed: int, max_sums: int,
             given: list[float] | None = None, noise: float | None = None, least: int | None = None, jitters: tuple[float, ...] = JITTERS) -> list[list[Fit | None]]:
    """The best fit on each restart's way, for every set; all of them move in one pass a step.

    ``given`` length scales are only evaluated. Sets without a fit among their first ``least`` starts (all of them if not given)
    run again with more jitter, as all do where a matrix has no inverse.
    """
    first = [list(given) if given else starts(z.shape[1], count, seed) for z in inducing]
    found: list[list[Fit | None]] = [[None] * len(own) for own in first]
    for jitter in jitters:
        again = [own if all(f is None for f in got[:least]) else [] for own, got in zip(first, found)]
        if not any(again):
            break
        try:
            moved = _moved(rows, parts, inducing, n, again, 1 if given else steps + 1, max_sums, noise, jitter)
        except np.linalg.LinAlgError:
            continue
        found = [new if own else old for own, new, old in zip(again, moved, found)]
    return found


def _moved(rows: DataFrame, parts: Parts, inducing: list[np.ndarray], n: np.ndarray, first: list[list[float]], passes: int, max_sums: int,
           noise: float | None, jitter: float) -> list[list[Fit | None]]:
    """The best fits on the ways from the length scales ``first``; a set without any takes no part.

    A length scale follows the sign of its slope by a step that grows while the
    sign stays and halves when it turns.
    """
    where = [[math.log(x) for x in own] for own in first]
    move = [[0.7] * len(own) for own in first]
    last = [[0.0] * len(own) for own in first]
    found: list[list[Fit | None]] = [[None] * len(own) for own in first]
    for _ in range(passes):
        sums, yy = evidence_sums(rows, parts, inducing, [[math.exp(x) for x in own] for own in where], max_sums)
        for s, z in enumerate(inducing):
            for r, own in enumerate(sums[s]):
                f = with_best_noise(own, z, math.exp(where[s][r]), float(n[s]), float(yy[s]), noise, jitter)
                if f is not None and (found[s][r] is None or f.evidence > found[s][r].evidence):
                    found[s][r] = f
                sign = 0.0 if f is None else float(np.sign(f.slope))
                if last[s][r]:
                    move[s][r] *= 1.2 if sign == last[s][r] else 0.5
                last[s][r] = sign
                where[s][r] = min(max(where[s][r] + sign * move[s][r], math.log(1e-2)), math.log(1e4))
    return found


def best(fits: list[Fit | None]) -> Fit:
    """The fit with the most evidence, the first of equals."""
    real = [f for f in fits if f is not None]
    if not real:
        raise ValueError("no length scale gave a positive-definite system")
    return max(real, key=lambda f: f.evidence)
