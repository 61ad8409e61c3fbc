"""Solvers. Loops, step sizes and vectors of one number for each isoform are on the driver; all sums over k-mers are Spark jobs."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


@dataclass
class Result:
    """An estimate and what was recorded on the way."""

    x: np.ndarray
    losses: list[float] = field(default_factory=list)
    norms: list[float] = field(default_factory=list)
    iterations: list[int] = field(default_factory=list)
    snapshots: list[np.ndarray] = field(default_factory=list)
    average: np.ndarray | None = None
    gradient: np.ndarray | None = None

    def record(self, iteration: int, loss: float, norm: float, x: np.ndarray) -> None:
        """Adds a snapshot."""
        self.iterations.append(iteration)
        self.losses.append(loss)
        self.norms.append(norm)
        self.snapshots.append(x.copy())


def snapshot_step(iterations: int) -> int:
    """Iterations from one snapshot to the next."""
    return max(iterations // 15, 1)


def multiplicative(objective: Objective, start: np.ndarray, iterations: int = 100, callback: Callable | None = None) -> Result:
    """theta <- theta * gradient, without renormalising.

    Each ``snapshot_step`` iterations, numbered from 0, the iterate after the step is recorded with its loss and the norm
    of its gradient relative to that of the start. A NaN warns and is carried on.
    """
    out, every, theta = Result(start), snapshot_step(iterations), start.astype(float)
    _, out.gradient = objective(theta)
    first = float(np.linalg.norm(out.gradient))
    for t in range(iterations):
        theta = theta * out.gradient
        loss, out.gradient = objective(theta)
        if callback:
            callback(theta)
        if np.isnan(theta).any():
            warnings.warn(f"the iterate of iteration {t} has a NaN", stacklevel=2)
        if (t + 1) % every == 0:
            out.record(t, loss, float(np.linalg.norm(out.gradient)) / first, theta)
    out.x = theta
    return out


def _raised(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    e = x * np.exp(y - y.max())
    return e / e.sum()


def _divergence(p: np.ndarray, q: np.ndarray) -> float:
    on = (q > 0) & (p > 0)
    return float((p[on] * np.log(p[on] / q[on])).sum())


def line_search(x: np.ndarray, f: float, g: np.ndarray, value: Callable[[np.ndarray], float], step: float, armijo: bool, shrink: float = 0.9, tries: int = 20) -> tuple[np.ndarray, float]:
    """The first iterate whose objective exceeds its bound, and its step; the last one tried if none does.

    Every try shrinks the step first, once more (squared) after an objective that is NaN, which counts as ``f``.
    """
    new = x
    for _ in range(tries):
        step *= shrink
        new = _raised(x, step * g)
        ascent = float(g @ (new - x))
        bound = f + shrink * ascent if armijo else f + ascent - _divergence(new, x) / step
        found = value(new)
        if math.isnan(found):
            found, step = f, step * shrink**2
        if found > bound:
            break
    return new, step


def exponentiated(objective: Objective, start: np.ndarray, iterations: int = 100, lrs: float | list[float] | str | None = None, value: Callable[[np.ndarray], float] | None = None, tol: float = 1e-20, gtol: float = 1e-20, callback: Callable | None = None) -> Result:
    """Exponentiated gradient ascent on the simplex.

    ``lrs``: a number, one for each iteration, None for 2^-1/2 / (max|g| sqrt(t + 1)), or a line search: "armijo", or any
    other text for the one with divergence. A search begins at 1.2 times the last step, at first that of None. Stops
    before it takes a step whose 1-norm is within ``tol``, or after which the gradient moves by ``gtol`` or less, and
    before an iterate with a NaN. Records as ``multiplicative`` does, and once more at the end, with the last loss that
    was computed. ``average`` is 0.9 of itself and 0.1 of each iterate that was tried.
    """
    x, every, value = start.astype(float), snapshot_step(iterations), value or (lambda v: objective(v)[0])
    loss, g = objective(x)
    first, average, out, t = float(np.linalg.norm(g)), x.copy(), Result(x), -1
    step = 2**-0.5 / np.abs(g).max()

    def record() -> None:
        out.record(t, loss, float(np.linalg.norm(g)) / first, x)

    for t in range(iterations):
        if isinstance(lrs, str):
            new, step = line_search(x, loss, g, value, 1.2 * step, lrs == "armijo")
        else:
            if lrs is None:
                step = 2**-0.5 / (np.abs(g).max() * math.sqrt(t + 1))
            else:
                rates = np.atleast_1d(lrs)
                step = float(rates[0] if len(rates) == 1 else rates[t])
            new = _raised(x, step * g)
        if np.isnan(new).any():
            break
        average = 0.9 * average + 0.1 * new
        loss, new_g = objective(new)
        if np.abs(new - x).sum() <= tol or np.abs(new_g - g).sum() <= gtol:
            break
        x, g = new, new_g
        if callback:
            callback(x)
        if (t + 1) % every == 0:
            record()
    if t >= 0:
        record()
    out.x, out.average, out.gradient = x, average, g
    return out


def lbfgs(objective: Objective, start: np.ndarray, iterations: int = 50_000, memory: int = 10, tol: float = 1e-12, factr: float = 1.0) -> Result:
    """Limited-memory quasi-Newton ascent with a backtracking search that keeps curvature positive.

    Stops when no component of the gradient exceeds ``tol``, or a step gains less than ``factr`` times the resolution of
    the objective.
    """
    x = start.astype(float)
    f, g = objective(x)
    out, pairs = Result(x), []
    out.record(0, f, 1.0, x)
    for i in range(iterations):
        if np.abs(g).max() <= tol:
            break
        q, alphas = -g.copy(), []
        for s, d, r in reversed(pairs):
            alphas.append(r * float(s @ q))
            q -= alphas[-1] * d
        if pairs:
            s, d, _ = pairs[-1]
            q *= float(s @ d) / float(d @ d)
        else:
            q /= max(1.0, float(np.abs(g).sum()))
        for (s, d, r), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - r * float(d @ q))
        direction = -q
        slope = float(g @ direction)
        if slope <= 0:
            direction, slope, pairs = g.copy(), float(g @ g), []
        step, moved = 1.0, False
        for _ in range(40):
            new = x + step * direction
            new_f, new_g = objective(new)
            if math.isfinite(new_f) and new_f >= f + 1e-4 * step * slope:
                moved = True
                break
            step *= 0.5
        if not moved:
            break
        s, d = new - x, g - new_g
        if float(s @ d) > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, d, 1.0 / float(s @ d))]
        gained = new_f - f
        x, f, g = new, new_f, new_g
        out.record(i + 1, f, float(np.linalg.norm(g)), x)
        if gained <= factr * np.finfo(float).eps * max(abs(f), 1.0):
            break
    out.x, out.gradient = x, g
    return out


def lsqr(data, iterations: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Least squares of X theta = y: at once where X or X' is narrow, else by conjugate gradients on the normal equations.

    Each of the iterations, so many at most, takes some jobs, as X theta and X'r are joins; columns that are nearly
    dependent need more iterations than that.
    """
    if data.narrow:
        return data.least_squares()
    theta = np.zeros(data.n)
    residual = data.counts_pull()
    direction, norm = residual.copy(), float(residual @ residual)
    first = norm
    for _ in range(min(iterations, 4 * data.n)):
        if norm <= tol**2 * first or norm == 0:
            break
        normal = data.normal(direction)
        curvature = float(direction @ normal)
        if curvature <= 0:
            break
        a = norm / curvature
        theta += a * direction
        residual -= a * normal
        new = float(residual @ residual)
        direction, norm = residual + (new / norm) * direction, new
    return theta


def fit(model, solver_name: str = "mg", iterations: int | None = None, start: str | np.ndarray = "uniform", lrs=None, seed: int = 0, tol: float = 1e-20, gtol: float = 1e-20, callback: Callable | None = None) -> Result:
    """Fits a model: "mg" or "exp_grad" for the simplex model (100 iterations), quasi-Newton for the softmax model (50,000 at most; x is then on the simplex)."""
    from helixmill.plans.model import SoftmaxModel

    if isinstance(model, SoftmaxModel):
        first = start if isinstance(start, np.ndarray) else np.random.default_rng(seed).normal(size=model.size)
        out = lbfgs(model.objective_and_gradient, first, 50_000 if iterations is None else iterations)
        out.x = model.softmax(out.x)
        return out
    first = start if isinstance(start, np.ndarray) else model.start(start)
    iterations = 100 if iterations is None else iterations
    if solver_name == "exp_grad":
        return exponentiated(model.objective_and_gradient, first, iterations, lrs, model.objective, tol, gtol, callback)
    return multiplicative(model.objective_and_gradient, first, iterations, callback)


def history(spark, result: Result):
    """Table of a result's records: iteration, loss, rel_grad_norm."""
    return spark.createDataFrame([(int(i), float(f), float(n)) for i, f, n in zip(result.iterations, result.losses, result.norms, strict=True)], "iteration bigint, loss double, rel_grad_norm double")


def snapshots(spark, result: Result):
    """Table of a result's snapshots: iteration, isoform_id, value."""
    parts = [pd.DataFrame({"iteration": i, "isoform_id": np.arange(len(x)), "value": x}) for i, x in zip(result.iterations, result.snapshots, strict=True)]
    return spark.createDataFrame(pd.concat(parts), "iteration bigint, isoform_id bigint, value double")
