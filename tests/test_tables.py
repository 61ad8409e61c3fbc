"""Fits, derivatives and draws on tables against dense numpy."""

import math

import numpy as np
import pytest

from helixmill.plans import resampling, sampler, solvers, tables
from helixmill.plans.tables import Problems, SimplexProblems, SoftmaxProblems
from helixmill.session import Scratch

N, M = 6, 20


def dense(seed=0, n=N, m=M):
    rng = np.random.default_rng(seed)
    x = rng.random((m, n)) * (rng.random((m, n)) < 0.5)
    x[np.arange(n), np.arange(n)] += 0.2
    return x / x.sum(axis=0), rng.integers(1, 60, m).astype(float)


def frames(spark, x, ys):
    """X, y of runs, isoforms of lengths 10, 11, ..."""
    entries = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    counts = [(r, int(i), float(v)) for r, y in enumerate(ys) for i, v in enumerate(y) if v]
    return (
        spark.createDataFrame(entries, "kmer_id bigint, isoform_id bigint, p double"),
        spark.createDataFrame(counts, "run bigint, kmer_id bigint, y double"),
        spark.createDataFrame([(j, 10.0 + j) for j in range(x.shape[1])], "isoform_id bigint, length double"),
    )


def gathered(table, column="value", run=0):
    """A run's vector."""
    return np.array([r[column] for r in table.where(f"run = {run}").orderBy("isoform_id").collect()])


def objective(x, y, beta, lengths):
    """Dense objective and gradient of the simplex model."""
    on = x.sum(axis=1) > 0

    def evaluate(theta):
        s = x[on] @ theta
        f, g = y[on] @ np.log(s) / y[on].sum(), x[on].T @ (y[on] / s) / y[on].sum()
        if beta != 1:
            whole = (theta / lengths).sum()
            f += (beta - 1) * (np.log(theta / lengths).sum() - math.log(whole))
            g = g + (beta - 1) / theta - (beta - 1) / (lengths * whole)
        return f, g

    return evaluate


def test_fits_of_many_runs(spark):
    """Two runs with counts and priors of their own, against the solvers on driver vectors."""
    x, y = dense()
    other = np.random.default_rng(5).integers(0, 30, M).astype(float)
    scratch, betas = Scratch(spark), {0: 1.0, 1: 1.7}
    problems = SimplexProblems(*frames(spark, x, [y, other]), scratch, betas)
    got = tables.exponentiated(problems, problems.uniform(), 4)
    plain = tables.multiplicative(SimplexProblems(*frames(spark, x, [y, other]), scratch), problems.uniform(), 3)
    for run, own in enumerate((y, other)):
        dense_fit = objective(x * (own > 0)[:, None], own, betas[run], 10.0 + np.arange(N))
        want = solvers.exponentiated(dense_fit, np.full(N, 1 / N), 4)
        np.testing.assert_allclose(gathered(got.state, run=run), want.x, rtol=1e-11)
        np.testing.assert_allclose(gathered(got.state, "average", run), want.average, rtol=1e-11)
        rows = [r[1:] for r in got.records if r[0] == run]
        np.testing.assert_allclose(rows, list(zip(want.iterations, want.losses, want.norms)), rtol=1e-11)
        want = solvers.multiplicative(objective(x * (own > 0)[:, None], own, 1.0, 0), np.full(N, 1 / N), 3)
        np.testing.assert_allclose(gathered(plain.state, run=run), want.x, rtol=1e-11)
    assert plain.history().count() == 6 and plain.values().count() == 6 * N
    scratch.drop()


def test_stops(spark):
    """A fit that doesn't move ends at once, with what it has."""
    x, y = np.eye(3), np.array([1.0, 1.0, 1.0])
    problems = SimplexProblems(*frames(spark, x, [y]), Scratch(spark))
    fit = tables.exponentiated(problems, problems.uniform(), 50)
    assert len(fit.records) == 1 and fit.records[0][1] == 0
    np.testing.assert_allclose(gathered(fit.state), 1 / 3)
    problems.scratch.drop()


def softmax_parts(x, y, alpha):
    """Dense gradient and Hessian of the log likelihood at softmax(alpha)."""
    e = np.exp(alpha - alpha.max())
    sigma = e / e.sum()
    s = x @ sigma
    v = x * sigma / s[:, None]
    spread = np.outer(sigma, sigma) - np.diag(sigma)
    return v.T @ y - y.sum() * sigma, np.diag(v.T @ y) - (v.T * y) @ v + y.sum() * spread


def test_hessians_and_eigenvalues(spark):
    x, y = dense(2)
    scratch, rng = Scratch(spark), np.random.default_rng(3)
    parts = frames(spark, x, [y])
    w, alpha = rng.normal(size=N), rng.normal(size=N)
    vector = lambda values: spark.createDataFrame([(0, j, float(v)) for j, v in enumerate(values)], "run bigint, isoform_id bigint, value double")
    simplex = SimplexProblems(*parts, scratch)
    theta = rng.dirichlet(np.ones(N))
    want = -(x.T * (y / (x @ theta) ** 2)) @ x / y.sum()
    np.testing.assert_allclose(gathered(simplex.hessian_product(vector(theta), vector(w))), want @ w, rtol=1e-10)
    softmax = SoftmaxProblems(*parts, scratch)
    state, _ = softmax.evaluate(vector(alpha))
    gradient, hessian = softmax_parts(x, y, alpha)
    np.testing.assert_allclose(gathered(state, "g"), gradient, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(gathered(softmax.hessian_product(state, vector(w), 0.3)), hessian @ w - 0.6 * w, rtol=1e-9)
    values = tables.lanczos(lambda v: softmax.hessian_product(state, v), vector(w), N, scratch)
    exact = np.linalg.eigvalsh(hessian)
    np.testing.assert_allclose([values[0], values[-1]], [exact[0], exact[-1]], rtol=1e-7, atol=1e-7)
    assert np.abs(exact).max() <= y.sum() / 2
    values = tables.lanczos(lambda v: softmax.hessian_product(state, v, y.sum() / 4), vector(w), N, scratch)
    assert values[-1] <= 1e-9  # concave with a prior of that strength
    scratch.drop()


def test_laplace_prior(spark):
    """Exact zeros, and at the end the conditions of an optimum: |g| within the strength where 0, at it elsewhere."""
    x, y = dense(4, 4, 10)
    problems = SoftmaxProblems(*frames(spark, x, [y]), Scratch(spark))
    strength = 12.0
    alpha = np.zeros(4)
    for _ in range(5000):  # the same steps, dense
        ahead = alpha + 2 / y.sum() * softmax_parts(x, y, alpha)[0]
        alpha = np.sign(ahead) * np.maximum(np.abs(ahead) - 2 / y.sum() * strength, 0)
    g, zero = softmax_parts(x, y, alpha)[0], alpha == 0
    assert zero.any() and not zero.all()
    assert (np.abs(g[zero]) <= strength + 1e-6).all() and np.allclose(g[~zero], strength * np.sign(alpha[~zero]), atol=1e-5)
    near = problems.every(__import__("pyspark").sql.functions.lit(0.0)).select("run", "isoform_id", "value")
    fit = tables.proximal(problems, near, strength, 12)
    want = np.zeros(4)
    for _ in range(12):
        ahead = want + 2 / y.sum() * softmax_parts(x, y, want)[0]
        want = np.sign(ahead) * np.maximum(np.abs(ahead) - 2 / y.sum() * strength, 0)
    np.testing.assert_allclose(gathered(fit.state), want, atol=1e-12)
    assert ((gathered(fit.state) == 0) == (want == 0)).all()
    assert all(b[2] >= a[2] - 1e-9 for a, b in zip(fit.records, fit.records[1:]))
    problems.scratch.drop()


def test_least_squares_of_an_ill_conditioned_case(spark):
    """Condition number 10^5: normal equations would square it."""
    rng = np.random.default_rng(6)
    left, _ = np.linalg.qr(rng.normal(size=(9, 3)))
    right, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    x, y = left @ np.diag([1, 0.3, 1e-5]) @ right.T, np.abs(rng.normal(size=9)) + 1
    problems = Problems(*frames(spark, x, [y]), Scratch(spark))
    got, steps = tables.least_squares(problems, 12)
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    residual = lambda v: np.linalg.norm(y - x @ v)
    assert residual(gathered(got)) <= residual(want) * (1 + 1e-8) and steps < 12
    np.testing.assert_allclose(gathered(got), want, rtol=1e-6)
    problems.scratch.drop()


def test_posterior_means(spark):
    """Two isoforms: means and variances against the integral over the share of the first; reruns agree."""
    x, y = np.array([[0.7, 0.2], [0.3, 0.3], [0.0, 0.5]]), np.array([8.0, 5.0, 3.0])
    parts = frames(spark, x, [y])
    run = lambda: sampler.posterior(parts[0], parts[1].drop("run"), parts[2], 1.5, 150, 6, 6, 1).orderBy("isoform_id").collect()
    got = run()
    t = (np.arange(20_000) + 0.5) / 20_000
    weight = np.exp(np.log(np.outer(x[:, 0], t) + np.outer(x[:, 1], 1 - t)).T @ y) * (t * (1 - t)) ** 0.5
    mean = (weight * t).sum() / weight.sum()
    variance = (weight * (t - mean) ** 2).sum() / weight.sum()
    assert abs(got[0]["mean"] - mean) < 4 * math.sqrt(variance / 300) and abs(got[0]["mean"] + got[1]["mean"] - 1) < 1e-9
    assert abs(got[0]["variance"] / variance - 1) < 0.35
    assert got == run()


def test_dealt_counts(spark):
    """Each k-mer's count is dealt whole, and only to isoforms that have it."""
    x, y = dense(7)
    problems = Problems(*frames(spark, x, [y, y]), Scratch(spark))
    n = sampler.dealt(problems, problems.uniform(), 3, 0)
    assert [r["s"] for r in n.groupBy("run").sum("n").withColumnRenamed("sum(n)", "s").collect()] == [y.sum(), y.sum()]
    many = spark.createDataFrame([(0, 7, 2_000_000.0)], "run bigint, kmer_id bigint, y double")
    entries = spark.createDataFrame([(7, 0, 0.1), (7, 1, 0.3), (7, 2, 0.6)], "kmer_id bigint, isoform_id bigint, p double")
    problems = Problems(entries, many, frames(spark, x, [y])[2], Scratch(spark))
    n = {r["isoform_id"]: r["n"] for r in sampler.dealt(problems, problems.uniform(), 3, 0).collect()}
    assert sum(n.values()) == 2_000_000 and all(abs(n[j] / 2e6 - p) < 0.002 for j, p in enumerate((0.1, 0.3, 0.6)))


def test_refits_without_reads(spark):
    x, y = dense(8)
    entries, _, isoforms = frames(spark, x, [y])
    none = spark.createDataFrame([], "read bigint, sequence string")
    assert resampling.bootstrap_errors(entries, none, isoforms, 3, 2, 1, ("read",), 1).count() == 0
    assert resampling.cross_validation(entries, none, isoforms, 3, [1.0], 2, 1, ("read",), 1).count() == 0


def test_too_many_runs(spark, monkeypatch):
    monkeypatch.setattr(tables, "RUNS", 2)
    with pytest.raises(ValueError):
        SimplexProblems(*frames(spark, *(lambda a: (a[0], [a[1]] * 3))(dense())), Scratch(spark))
