"""Queries of fits whose vectors are tables, of refits, second derivatives, the Laplace prior and least squares, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.bases import from_text
from helixmill.model_queries import EG, MG, SMALL, K, snapshots_sql
from helixmill.operators import counts, matrix
from helixmill.operators.counts import POISSON
from helixmill.operators.matrix import dense_ids
from helixmill.plans import resampling, sampler, tables
from helixmill.plans.tables import Problems, SimplexProblems, SoftmaxProblems
from helixmill.registry import SEQ, code, query, read, reads, valid_words
from helixmill.session import Scratch, written


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X of the benchmark texts, y of the conversations (one run), and isoforms with their lengths."""
    items = read(spark, sf_dir, "benchmark").select("item_id", from_text(F.coalesce("text", F.lit(""))).alias("sequence"))
    numbered = dense_ids(items, "item_id")
    y = counts.kmer_counts(reads(spark, sf_dir), K).withColumn("run", F.lit(0).cast("bigint"))
    return matrix.build_matrix(numbered, K), y, numbered.select("isoform_id", F.length("sequence").alias("length"))


def rounded(table: DataFrame, digits: int = 9, **columns: str) -> DataFrame:
    """isoform_id and columns, rounded."""
    return table.select("isoform_id", *(F.round(c, digits).alias(name) for name, c in columns.items()))


@query(f"WITH {MG} {snapshots_sql(4)}")
def mg_fit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems = SimplexProblems(*parts(spark, sf_dir), Scratch(spark))
    fit = tables.multiplicative(problems, problems.uniform(), 4)
    out = written(fit.values().select("iteration", "isoform_id", F.round("value", 9).alias("value")))
    problems.scratch.drop()
    return out


@query(f"WITH {EG}, h AS MATERIALIZED ({snapshots_sql(3)}), a AS (SELECT isoform_id, round(0.729 * t0.v + 0.081 * t1.v + 0.09 * t2.v + 0.1 * t3.v, 9) AS average FROM t0 JOIN t1 USING (isoform_id) JOIN t2 USING (isoform_id) JOIN t3 USING (isoform_id)) SELECT isoform_id, value AS theta, average FROM h JOIN a USING (isoform_id) WHERE iteration = 2")
def eg_fit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems = SimplexProblems(*parts(spark, sf_dir), Scratch(spark))
    fit = tables.exponentiated(problems, problems.uniform(), 3)
    out = written(rounded(fit.state, theta="value", average="average"))
    problems.scratch.drop()
    return out


def runs_evaluation(i: int, prior: str = "") -> str:
    """CTEs of X theta and the gradient for each run at the table t(i): r, isoform_id, v; counts are yr (r, kmer_id, y)."""
    return f"""m{i} AS MATERIALIZED (SELECT r, kmer_id, any_value(yr.y) AS y, sum(p * v) AS s FROM yr JOIN x USING (kmer_id) JOIN t{i} USING (r, isoform_id) GROUP BY r, kmer_id),
q{i} AS (SELECT r, isoform_id, sum(p * y / s) AS q FROM m{i} JOIN x USING (kmer_id) GROUP BY r, isoform_id),
w{i} AS (SELECT r, sum(y)::DOUBLE AS total FROM m{i} GROUP BY r),
g{i} AS MATERIALIZED (SELECT r, isoform_id, v, coalesce(q, 0) / total {prior} AS g FROM t{i} JOIN b USING (isoform_id) JOIN w{i} USING (r) LEFT JOIN q{i} USING (r, isoform_id))"""


BOOTSTRAP = f"""{SMALL}, d AS (SELECT {SEQ} AS s, r, ('0x' || substr(md5('17-' || r || '-' || conv_id || '-' || turn), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM conversations, range(5) t(r)),
times AS (SELECT r, s, {" + ".join(f"(u >= {limit!r}::DOUBLE)::BIGINT" for limit in POISSON)} AS times FROM d), drawn AS (SELECT * FROM times WHERE times > 0),
{valid_words('rk', K, 'drawn', 'r, times')}, yr AS MATERIALIZED (SELECT r, {code(K)} AS kmer_id, sum(times)::DOUBLE AS y FROM rk GROUP BY r, kmer)"""
BOOTSTRAP = BOOTSTRAP.replace("t0 AS MATERIALIZED (SELECT isoform_id, 1.0::DOUBLE / n AS v FROM b, n)", "t0 AS MATERIALIZED (SELECT r, isoform_id, 1.0::DOUBLE / n AS v FROM b, n, range(5) k(r))")


@query(f"""WITH {BOOTSTRAP}, {runs_evaluation(0)}, t1 AS (SELECT r, isoform_id, v * g AS v FROM g0), {runs_evaluation(1)}, t2 AS (SELECT r, isoform_id, v * g AS v FROM g1)
SELECT isoform_id, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS error FROM t2 GROUP BY isoform_id""")
def bootstrap_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, isoforms = parts(spark, sf_dir)
    return rounded(resampling.bootstrap_errors(x, reads(spark, sf_dir), isoforms, K, 5, 17, ("conv_id", "turn"), 2), mean="mean", error="error")


BETAS = [1.0, 1.25, 2.0]
PRIOR = "+ (beta - 1) / v - (beta - 1) / (length * sum(v / length) OVER (PARTITION BY r))"
FOLDED = f"""{SMALL}, d AS (SELECT {SEQ} AS s, floor(3 * ('0x' || substr(md5('19-' || conv_id || '-' || turn), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)::BIGINT AS fold FROM conversations),
{valid_words('fk', K, 'd', 'fold')}, yf AS MATERIALIZED (SELECT fold, {code(K)} AS kmer_id, count(*)::DOUBLE AS y FROM fk GROUP BY fold, kmer),
rr AS (SELECT f * 3 + j AS r, f AS test, ([{", ".join(f"{b}::DOUBLE" for b in BETAS)}])[j + 1] AS beta FROM range(3) a(f), range(3) c(j)),
yr AS MATERIALIZED (SELECT r, kmer_id, sum(y) AS y FROM yf JOIN rr ON fold <> test GROUP BY r, kmer_id)"""
FOLDED = FOLDED.replace("t0 AS MATERIALIZED (SELECT isoform_id, 1.0::DOUBLE / n AS v FROM b, n)", "t0 AS MATERIALIZED (SELECT r, isoform_id, 1.0::DOUBLE / n AS v FROM b, n, range(9) k(r))")


def folded_step(i: int) -> str:
    """CTEs of an exponentiated step of each run."""
    gradient = runs_evaluation(i, PRIOR).replace(f"FROM t{i} JOIN b", f"FROM t{i} JOIN rr USING (r) JOIN b")
    return f"""{gradient}, e{i} AS (SELECT r, isoform_id, v * exp(0.5::DOUBLE ** 0.5 / (max(abs(g)) OVER (PARTITION BY r) * sqrt({i + 1})) * (g - max(g) OVER (PARTITION BY r))) AS e FROM g{i}),
t{i + 1} AS MATERIALIZED (SELECT r, isoform_id, e / sum(e) OVER (PARTITION BY r) AS v FROM e{i})"""


@query(f"""WITH {FOLDED}, {folded_step(0)}, {folded_step(1)},
z AS (SELECT r, kmer_id, any_value(yf.y) AS y, sum(p * v) AS s FROM yf JOIN rr ON fold = test JOIN t2 USING (r) JOIN x USING (kmer_id, isoform_id) GROUP BY r, kmer_id)
SELECT beta, test AS fold, round(sum(y * ln(s)) / sum(y), 7) AS loglik FROM z JOIN rr USING (r) GROUP BY beta, test""")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, _, isoforms = parts(spark, sf_dir)
    found = resampling.cross_validation(x, reads(spark, sf_dir), isoforms, K, BETAS, 3, 19, ("conv_id", "turn"), 2)
    return found.select("beta", "fold", F.round("loglik", 7).alias("loglik"))


#: A direction, and what comes of it.
DIRECTION = "((isoform_id * 5) % 7 - 3)"
WAY = f"{SMALL}, v AS (SELECT isoform_id, {DIRECTION}::DOUBLE AS v FROM b)"


def direction(problems: Problems) -> DataFrame:
    """The direction of the queries."""
    return problems.every(F.expr(f"cast({DIRECTION} as double)")).select("run", "isoform_id", "value")


@query(f"""WITH {WAY}, s AS (SELECT kmer_id, any_value(y) AS y, sum(p * t0.v) AS s, sum(p * v.v) AS m FROM o JOIN t0 USING (isoform_id) JOIN v USING (isoform_id) GROUP BY kmer_id),
h AS (SELECT isoform_id, -sum(p * s.y * m / (s.s * s.s)) / any_value(total) AS h FROM o JOIN s USING (kmer_id), w GROUP BY isoform_id)
SELECT isoform_id, round(coalesce(h, 0), 6) AS h FROM b LEFT JOIN h USING (isoform_id)""")
def simplex_hessian_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    problems = SimplexProblems(*parts(spark, sf_dir), Scratch(spark))
    out = written(rounded(problems.hessian_product(problems.uniform(), direction(problems)), 6, h="value"))
    problems.scratch.drop()
    return out


ALPHA = "((isoform_id * 7) % 11) / 10"
TILT = f"{WAY}, al AS (SELECT isoform_id, {ALPHA}::DOUBLE AS a FROM b), sg AS MATERIALIZED (SELECT isoform_id, a, exp(a) / sum(exp(a)) OVER () AS g FROM al)"


def tilted(problems: SoftmaxProblems) -> DataFrame:
    """alpha of the queries."""
    return problems.every(F.expr(f"cast({ALPHA} as double)")).select("run", "isoform_id", "value")


@query(f"""WITH {TILT}, s AS (SELECT kmer_id, any_value(y) AS y, sum(p * g) AS s, sum(p * g * v.v) AS m FROM o JOIN sg USING (isoform_id) JOIN v USING (isoform_id) GROUP BY kmer_id),
back AS (SELECT isoform_id, sum(p * s.y / s) AS pull, sum(p * s.y * m / (s.s * s.s)) AS back FROM o JOIN s USING (kmer_id) GROUP BY isoform_id)
SELECT isoform_id, round((g * (coalesce(pull, 0) * v - coalesce(back, 0) + total * (sum(g * v) OVER () - v)) - v / 9) / total, 9) AS h FROM sg JOIN v USING (isoform_id) LEFT JOIN back USING (isoform_id), w""")
def softmax_hessian_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a normal prior of beta 1/18, over the sum of counts."""
    problems = SoftmaxProblems(*parts(spark, sf_dir), Scratch(spark))
    state, _ = problems.evaluate(tilted(problems))
    product = problems.hessian_product(state, direction(problems), 1 / 18)
    out = written(rounded(product.withColumn("value", F.col("value") / problems.totals[0]), h="value"))
    problems.scratch.drop()
    return out


@query(f"""WITH {TILT}, s AS (SELECT kmer_id, any_value(y) AS y, sum(p * g) AS s FROM o JOIN sg USING (isoform_id) GROUP BY kmer_id),
pulled AS (SELECT isoform_id, sum(p * s.y / s) AS pull FROM o JOIN s USING (kmer_id) GROUP BY isoform_id),
ahead AS (SELECT isoform_id, a + 2 / total * (coalesce(pull, 0) - total) * g AS z, 2 * (total / 8) / total AS cut FROM sg LEFT JOIN pulled USING (isoform_id), w)
SELECT isoform_id, round(sign(z) * greatest(abs(z) - cut, 0), 9) AS alpha FROM ahead""")
def laplace_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proximal step with a Laplace prior; small coordinates become exact zeros."""
    problems = SoftmaxProblems(*parts(spark, sf_dir), Scratch(spark))
    fit = tables.proximal(problems, tilted(problems), problems.totals[0] / 8, 1)
    out = written(rounded(fit.state, alpha="value"))
    problems.scratch.drop()
    return out


@query(f"""WITH {SMALL}, g AS MATERIALIZED (SELECT isoform_id, coalesce(sum(p * y), 0) AS g FROM b LEFT JOIN o USING (isoform_id) GROUP BY isoform_id),
xg AS MATERIALIZED (SELECT kmer_id, sum(p * g) AS xg FROM o JOIN g USING (isoform_id) GROUP BY kmer_id),
h AS MATERIALIZED (SELECT isoform_id, coalesce(sum(p * xg), 0) AS h FROM b LEFT JOIN o USING (isoform_id) LEFT JOIN xg USING (kmer_id) GROUP BY isoform_id),
xh AS (SELECT kmer_id, sum(p * h) AS xh FROM o JOIN h USING (isoform_id) GROUP BY kmer_id),
d AS (SELECT sum(xg * xg) AS a, sum(xg * xh) AS c, sum(xh * xh) AS e FROM xg JOIN xh USING (kmer_id)), f AS (SELECT sum(g * g) AS f, sum(g * h) AS k FROM g JOIN h USING (isoform_id)),
z AS (SELECT (f * e - k * c) / (a * e - c * c) AS one, (a * k - c * f) / (a * e - c * c) AS two FROM d, f)
SELECT isoform_id, round((one * g + two * h) / 1000, 6) AS theta FROM g JOIN h USING (isoform_id), z""")
def least_squares_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps of the bidiagonalisation: the least squares over X'y and X'X X'y, which two equations give. In thousands."""
    problems = Problems(*parts(spark, sf_dir), Scratch(spark))
    theta, _ = tables.least_squares(problems, 2)
    out = written(rounded(theta.withColumn("value", F.col("value") / 1000), 6, theta="value"))
    problems.scratch.drop()
    return out


@query()
def posterior_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from keyed generators can't be said in SQL; the tests hold the sampler against exact integrals."""
    x, y, isoforms = parts(spark, sf_dir)
    return rounded(sampler.posterior(x, y.drop("run"), isoforms, 1.0, 8, 4, 4, 23), mean="mean", variance="variance")
