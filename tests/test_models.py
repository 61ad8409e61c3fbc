import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.operators import counts, lengths, linalg, matrix, metrics, prep, sampling
from helixmill.plans import solvers
from helixmill.plans.model import Evaluator, SimplexModel, SoftmaxModel, make_model
from helixmill.plans.simulate import simulate

ISOFORMS = ["AAACAGATCACCCGCT", "TGAGCGGGTTATCTGTT", "AACCGGTTAAACCCGGG"]


@pytest.fixture(scope="module")
def xy(spark):
    x = matrix.build_matrix(spark.createDataFrame(list(enumerate(ISOFORMS)), "isoform_id bigint, sequence string"), 2)
    y = spark.createDataFrame([(i, i + 1) for i in range(16)], "kmer_id bigint, y bigint")
    return x.persist(), y.persist()


def numeric(f, at, h=1e-6):
    return np.array([(f(at + h * e) - f(at - h * e)) / (2 * h) for e in np.eye(len(at))])


def test_simplex_values(xy):
    uniform = np.full(3, 1 / 3)
    for beta, value, gradient in ((1.0, -2.910798751, (0.784226649, 1.533392307, 0.682381044)), (0.1, 0.055454429, (-1.015773351, -0.266607693, -1.117618956))):
        model = SimplexModel(*xy, np.ones(3), beta)
        f, g = model.objective_and_gradient(uniform)
        assert f == pytest.approx(value, abs=1e-8) and f == pytest.approx(model.objective(uniform))
        assert g == pytest.approx(gradient, abs=1e-8)


def test_simplex_gradient(xy):
    model = SimplexModel(*xy, np.array([2.0, 3.0, 5.0]), 0.4)
    at = np.array([0.2, 0.5, 0.3])
    assert model.objective_and_gradient(at)[1] == pytest.approx(numeric(model.objective, at), abs=1e-5)


def test_multiplicative_steps(xy):
    model = SimplexModel(*xy, np.ones(3))
    for n, theta in ((1, (0.261408883, 0.511130769, 0.227460348)), (2, (0.204117910, 0.642854854, 0.153027236)), (10, (0.152757785, 0.813101965, 0.034140249))):
        out = solvers.fit(model, "mg", n)
        assert out.x == pytest.approx(theta, abs=1e-8) and out.x.sum() == pytest.approx(1)
        assert out.losses == sorted(out.losses)


def test_softmax(xy):
    model = SoftmaxModel(*xy, 3)
    f, g = model.objective_and_gradient(np.zeros(3))
    assert f == pytest.approx(-395.868630083, abs=1e-6)
    assert g == pytest.approx((-9.781725238, 24.180451260, -14.398726023), abs=1e-6)
    at = np.array([0.3, -0.2, 0.1])
    assert model.objective_and_gradient(at)[1] == pytest.approx(numeric(lambda a: model.objective_and_gradient(a)[0], at), abs=1e-3)
    fitted = solvers.fit(model, iterations=60)
    assert np.abs(fitted.gradient).max() < 1e-3 and fitted.x.sum() == pytest.approx(1)


@pytest.fixture(scope="module")
def dense(xy):
    x, y = np.zeros((16, 3)), np.arange(1, 17) / 136
    for r in xy[0].collect():
        x[r["kmer_id"], r["isoform_id"]] = r["p"]

    def objective(theta):
        s = x @ theta
        return float(y @ np.log(s)), x.T @ (y / s)

    return objective


def plain_multiplicative(objective, theta, n):
    """Every iterate with what belongs to it, then those that are recorded."""
    norm = [np.sqrt(np.sum(objective(theta)[1] ** 2))]
    rows = []
    for _ in range(n):
        theta = theta * objective(theta)[1]
        f, g = objective(theta)
        rows.append((f, np.sqrt(np.sum(g**2)) / norm[0], theta))
    every = max(int(n / 15), 1)
    return theta, [(t, *rows[t]) for t in range(n) if (t + 1) % every == 0]


def plain_exponentiated(objective, theta, n, rule, tol, gtol):
    """The same for exponentiated gradients; ``rule`` is None, a list of rates, "armijo" or "divergence"."""
    state = [(theta, *objective(theta))]
    rate = 1 / (np.sqrt(2) * np.max(np.abs(state[0][2])))
    average, last_loss, stopped = theta, state[0][1], n - 1
    move = lambda x, g, a: (lambda e: e / np.sum(e))(x * np.exp(a * (g - np.max(g))))
    for t in range(n):
        x, f, g = state[-1]
        if rule in ("armijo", "divergence"):
            rate *= 1.2
            for _ in range(20):
                rate *= 0.9
                new = move(x, g, rate)
                slope = np.dot(g, new - x)
                limit = f + 0.9 * slope if rule == "armijo" else f + slope - np.sum(new * np.log(new / x)) / rate
                if objective(new)[0] > limit:
                    break
        else:
            rate = 1 / (np.sqrt(2 * (t + 1)) * np.max(np.abs(g))) if rule is None else rule[t]
            new = move(x, g, rate)
        average = 0.9 * average + 0.1 * new
        last_loss, pulled = objective(new)
        if np.sum(np.abs(new - x)) <= tol or np.sum(np.abs(pulled - g)) <= gtol:
            stopped = t
            break
        state.append((new, last_loss, pulled))
    norm = lambda g: np.linalg.norm(g) / np.linalg.norm(state[0][2])
    every = max(int(n / 15), 1)
    rows = [(t, state[t + 1][1], norm(state[t + 1][2]), state[t + 1][0]) for t in range(len(state) - 1) if (t + 1) % every == 0]
    return state[-1][0], [*rows, (stopped, last_loss, norm(state[-1][2]), state[-1][0])], average


def same_records(out, rows):
    assert out.iterations == [r[0] for r in rows]
    assert out.losses == pytest.approx([r[1] for r in rows], abs=1e-9) and out.norms == pytest.approx([r[2] for r in rows], abs=1e-9)
    assert np.array(out.snapshots) == pytest.approx(np.array([r[3] for r in rows]), abs=1e-9)


@pytest.mark.parametrize("n", [1, 7, 40])
def test_multiplicative_against_plain(dense, n):
    x, rows = plain_multiplicative(dense, np.full(3, 1 / 3), n)
    out = solvers.multiplicative(dense, np.full(3, 1 / 3), n)
    assert out.x == pytest.approx(x, abs=1e-9)
    same_records(out, rows)


@pytest.mark.parametrize("rule", [None, [0.5], "rates", "armijo", "divergence"])
@pytest.mark.parametrize("n,tol,gtol", [(1, 0, 0), (12, 0, 0), (31, 0, 0), (40, 0.02, 0), (40, 0, 0.02)])
def test_exponentiated_against_plain(dense, rule, n, tol, gtol):
    rates = list(np.linspace(1.0, 0.2, n)) if rule == "rates" else rule
    x, rows, average = plain_exponentiated(dense, np.full(3, 1 / 3), n, rates * n if rule == [0.5] else rates, tol, gtol)
    for lrs in ([0.5, np.array([0.5])] if rule == [0.5] else [rates]):
        out = solvers.exponentiated(dense, np.full(3, 1 / 3), n, lrs, tol=tol, gtol=gtol)
        assert out.x == pytest.approx(x, abs=1e-9) and out.average == pytest.approx(average, abs=1e-9)
        same_records(out, rows)


@pytest.mark.parametrize("lrs", [None, "armijo", "divergence"])
def test_fits_by_joins_equal_dense_ones(xy, dense, lrs):
    model = make_model(*xy, np.ones(3))
    out, plain = (solvers.exponentiated(f, np.full(3, 1 / 3), 4, lrs, value) for f, value in ((model.objective_and_gradient, model.objective), (dense, None)))
    assert out.x == pytest.approx(plain.x, abs=1e-9) and out.average == pytest.approx(plain.average, abs=1e-9) and out.losses == pytest.approx(plain.losses, abs=1e-9)
    model.close()


def test_nan_warns_or_stops():
    broken = lambda x: (0.0, np.array([np.nan, 1.0, 1.0]))
    with pytest.warns(UserWarning):
        assert np.isnan(solvers.multiplicative(broken, np.ones(3) / 3, 2).x[0])
    out = solvers.exponentiated(broken, np.ones(3) / 3, 5)
    assert (out.x == 1 / 3).all() and out.iterations == [0]


def test_callbacks_see_each_iterate(dense):
    seen = []
    solvers.multiplicative(dense, np.full(3, 1 / 3), 3, seen.append)
    solvers.exponentiated(dense, np.full(3, 1 / 3), 3, callback=seen.append)
    assert len(seen) == 6 and all(abs(x.sum() - 1) < 1e-9 for x in seen)


def test_softmax_reaches_its_optimum(xy):
    model = SoftmaxModel(*xy, 3)
    out = solvers.fit(model, seed=4)
    assert np.abs(out.gradient).max() < 1e-3
    again = solvers.fit(model, start=np.array([2.0, -1.0, 0.5]))
    assert again.x == pytest.approx(out.x, abs=1e-5)
    model.close()


def test_starts(xy):
    model = SimplexModel(*xy, np.ones(3))
    for kind in ("uniform", "Xy", "lsq"):
        start = model.start(kind)
        assert start.sum() == pytest.approx(1) and (start > 0).all()
    with pytest.raises(ValueError):
        model.start("none")


def test_lsqr_solves(spark):
    x = matrix.build_matrix(spark.createDataFrame(list(enumerate(ISOFORMS)), "isoform_id bigint, sequence string"), 2)
    dense = np.zeros((16, 3))
    for r in x.collect():
        dense[r["kmer_id"], r["isoform_id"]] = r["p"]
    y = spark.createDataFrame([(i, i + 1) for i in range(16)], "kmer_id bigint, y bigint")
    got = solvers.lsqr(SimplexModel(x, y, np.ones(3)).data)
    assert got == pytest.approx(np.linalg.lstsq(dense, np.arange(1, 17), rcond=None)[0], rel=1e-6)


def test_uncovered_counts_are_left_out(spark, xy):
    x, y = xy
    some = x.where("kmer_id < 8")
    model = SimplexModel(some, y, np.ones(3))
    assert model.data.total == 36 and model.data.dropped == pytest.approx(1 - 36 / 136)


def test_lengths_round_trip(spark):
    psi = spark.createDataFrame([(0, 0.2), (1, 0.5), (2, 0.3)], "isoform_id bigint, value double")
    known = spark.createDataFrame([(0, 10), (1, 20), (2, 70)], "isoform_id bigint, length bigint")
    back = lengths.adjust_inverse(lengths.adjust(psi, known), known).orderBy("isoform_id").collect()
    assert [r["value"] for r in back] == pytest.approx([0.2, 0.5, 0.3])
    with pytest.raises(ValueError):
        matrix.check_lengths(psi.withColumn("isoform_id", F.col("isoform_id") + 5), known)


def test_sampling_follows_the_distribution(spark):
    p = spark.createDataFrame([(i, w / 10) for i, w in enumerate((1, 2, 0, 3, 4))], "isoform_id bigint, value double")
    got = [r["n"] for r in sampling.bincount(sampling.draw(p, sampling.draws(spark, 20000, 1)), p).orderBy("isoform_id").collect()]
    assert sum(got) == 20000 and got[2] == 0
    assert sum((n - 2000 * w) ** 2 / (2000 * w) for n, w in zip(got, (1, 2, 0, 3, 4)) if w) < 20


def test_simulate_and_estimate(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"iso{i}", "".join(rng.choice(list("ACGT"), 120))) for i in range(6)] + [(6, "x PREDICTED", "A" * 200), (7, "short", "ACGT")]
    records = spark.createDataFrame(rows, "isoform_id bigint, header string, sequence string")
    reads, truth = simulate(records, 3000, 30, 1.0)
    assert reads.count() == 3000 and reads.where("length(sequence) <> 30").isEmpty()
    assert {r["isoform_id"] for r in truth.collect()} == set(range(6))
    kept = records.where("isoform_id < 6")
    model = SimplexModel(matrix.build_matrix(kept, 8), counts.kmer_counts(reads, 8), np.full(6, 91.0))
    theta = solvers.fit(model, "mg", 40)
    true = [r["theta_true"] for r in truth.orderBy("isoform_id").collect()]
    assert np.abs(theta.x - true).sum() < 0.15
    errors = metrics.l1_errors(solvers.snapshots(spark, theta), truth.select("isoform_id", F.col("theta_true").alias("value"))).orderBy("iteration").collect()
    assert errors[-1]["l1"] < errors[0]["l1"]
    assert solvers.history(spark, theta).count() == len(theta.losses)


def test_vectors(spark):
    v = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 4.0), (3, 0.5)], "i bigint, value double")
    assert [r["value"] for r in linalg.clipped(v).orderBy("i").collect()] == pytest.approx([0.05, 0.05, 4.0, 0.5])
    e = np.exp([-1, 0, 4, 0.5])
    assert [r["value"] for r in linalg.softmax(v).orderBy("i").collect()] == pytest.approx(list(e / e.sum()))
    assert linalg.norms(v).first().asDict() == pytest.approx({"l1": 5.5, "l2": np.sqrt(17.25), "linf": 4.0, "least_positive": 0.5})


def test_prep(spark):
    records = spark.createDataFrame([("a", 10), ("b", 20)], "id string, width int")
    quant = spark.createDataFrame([("a", 3.0)], "id string, reads double")
    assert {r["id"]: r["reads"] for r in prep.with_counts(records, quant, "id", "reads").collect()} == {"a": 3.0, "b": 0.0}
    prep.check_known(quant, records, "id")
    with pytest.raises(ValueError):
        prep.check_known(records, quant, "id")
    runs = spark.createDataFrame([("r", i, 10.0 - i) for i in range(6)] + [("s", i, 8.0 - i) for i in range(4)], "run string, iteration int, value double")
    got = metrics.curves(runs, 7.0).orderBy("iteration").collect()
    assert [(r["iteration"], r["mean"]) for r in got] == [(0, 9.0), (1, 8.0), (2, 7.0)]


@pytest.mark.parametrize("limit", [1_000_000, 100])
def test_entries_by_isoform(spark, monkeypatch, limit):
    """More isoforms than k-mers: kept by isoform, no k-mer's entries in one task, theta broadcast or not; the same values."""
    from helixmill.plans import model as module

    rng = np.random.default_rng(2)
    dense = np.where(rng.random((16, 300)) < 0.6, rng.random((16, 300)), 0)
    dense[:, 7] = 0
    x = spark.createDataFrame([(int(k), int(i), float(dense[k, i])) for k, i in zip(*np.nonzero(dense))], "kmer_id bigint, isoform_id bigint, p double")
    y = spark.createDataFrame([(k, 3 * k) for k in range(20)], "kmer_id bigint, y bigint")
    seen, theta = np.arange(1, 16) * 3.0, rng.random(300) + 0.1
    monkeypatch.setattr(module, "BROADCAST", limit)
    data = module.Evaluator(x, y, 300, 4)
    assert data.by_isoform and data.total == seen.sum() and data.dropped == pytest.approx(1 - seen.sum() / sum(3 * k for k in range(20)))
    sizes = data.entries.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * np.count_nonzero(dense[1:]) / 4
    s = dense[1:] @ theta
    f, pull = data.likelihood_and_pull(theta)
    assert f == pytest.approx(seen @ np.log(s)) == pytest.approx(data.likelihood(theta))
    np.testing.assert_allclose(pull, dense[1:].T @ (seen / s), rtol=1e-9)
    np.testing.assert_allclose(data.normal(theta), dense[1:].T @ s, rtol=1e-9)
    np.testing.assert_allclose(data.counts_pull(), dense[1:].T @ seen, rtol=1e-9)
    none = data.likelihood_and_pull(np.where(np.arange(300) == 7, 1.0, 0.0))
    assert none[0] == -np.inf and np.isinf(none[1][np.flatnonzero(dense[1:].any(0))]).all() and none[1][7] == 0
    data.close()


def test_few_entries_have_few_partitions(spark, xy):
    """Many evaluations of a small problem don't start a task for each of the session's partitions."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        model = SimplexModel(*xy, np.ones(3))
        assert model.data.entries.rdd.getNumPartitions() == 1
        model.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def stretched(rows, columns, rank):
    """A matrix of this rank whose singular values go from 1 down to a hundred-thousandth."""
    rng = np.random.default_rng(4)
    left, right = (np.linalg.qr(rng.normal(size=(size, rank)))[0] for size in (rows, columns))
    return left @ np.diag(np.geomspace(1, 1e-5, rank)) @ right.T


def evaluator(spark, dense, y, partitions):
    entries = [(int(k), int(i), float(dense[k, i])) for k, i in np.ndindex(*dense.shape)]
    x = spark.createDataFrame(entries, "kmer_id bigint, isoform_id bigint, p double")
    return Evaluator(x, spark.createDataFrame(list(enumerate(map(int, y))), "kmer_id bigint, y bigint"), dense.shape[1], partitions)


@pytest.mark.parametrize("shape, rank, partitions", [((150, 40), 40, 1), ((150, 40), 35, 20), ((30, 90), 30, 20), ((30, 90), 25, 1)])
def test_least_squares_of_nearly_dependent_columns(spark, shape, rank, partitions):
    """Iterations stop short of it. In few jobs, by both forms of the entries, over one partition and over rounds."""
    dense, y = stretched(*shape, rank), np.random.default_rng(5).integers(1, 1000, shape[0])
    data = evaluator(spark, dense, y, partitions)
    assert data.by_isoform == (shape[0] < shape[1]) and data.narrow
    spark.sparkContext.setJobGroup(f"least squares {shape} {rank}", "")
    got = solvers.lsqr(data)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"least squares {shape} {rank}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    data.close()
    want = np.linalg.lstsq(dense, y, rcond=1e-9)[0]
    assert np.linalg.norm(got - want) < 1e-5 * np.linalg.norm(want)
    pull = dense.T @ y
    assert np.abs(pull - dense.T @ (dense @ got)).max() < 1e-9 * np.abs(pull).max()
    assert 0 < len(jobs) < 30


def test_least_squares_by_iterations(spark, monkeypatch):
    """Beyond the bound on columns."""
    from helixmill.plans import model as module

    dense, y = np.random.default_rng(6).random((9, 3)), np.arange(1, 10)
    monkeypatch.setattr(module, "COLUMNS", 2)
    data = evaluator(spark, dense, y, 2)
    assert not data.narrow
    assert solvers.lsqr(data) == pytest.approx(np.linalg.lstsq(dense, y, rcond=None)[0], rel=1e-6)
    data.close()


def test_least_squares_without_counts(spark):
    data = evaluator(spark, np.ones((2, 3)), [0, 0], None)
    assert solvers.lsqr(data).tolist() == [0, 0, 0]
    data.close()


def test_triangle(spark):
    """Blocks that fill several times, a row over two batches, and places that occur twice."""
    rng = np.random.default_rng(7)
    dense = rng.normal(size=(500, 7)) * (rng.random((500, 7)) < 0.7)
    entries = [(int(i), int(j), float(v) / 2) for i, j in zip(*np.nonzero(dense)) for v in [dense[i, j]] * 2]
    rows = spark.createDataFrame(entries, "row bigint, at bigint, value double")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for parts in (1, 20):
            r = linalg.triangle(rows.repartition(parts, "row"), 7)
            np.testing.assert_allclose(r.T @ r, dense.T @ dense, rtol=1e-9, atol=1e-9)
            assert np.allclose(r, np.triu(r))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
