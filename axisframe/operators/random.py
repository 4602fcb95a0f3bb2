"""Seeded random arrays.

Distributions are expressions of Spark's seeded generators; their values
depend on the seed and on the plan's partitions.  Where a value may be rejected,
a row draws so many attempts that all fail once in 10**12 rows at most, and
takes the first that is accepted.  Discrete distributions on a bounded range
use an alias table, which takes two draws whatever its size; wider ones are
sums.  ``draw`` has any distribution of numpy's, in Arrow batches, each block
of rows from its own child of the seed, so that they are the same however the
range is divided among tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NDFrame, unravel
from ..storage import numbered

#: Rows that share one child generator.
BLOCK = 1 << 14
#: Entries of an alias table.
TABLE = 4096
#: Attempts by distribution: what is left after them is below 10**-12.
ATTEMPTS = {"gamma": 12, "vonmises": 32, "zipf": 48}


def alias_table(weights: Sequence[float]) -> tuple[list[float], list[int]]:
    """For each entry the share that it keeps, and the entry that gets the rest."""
    n, total = len(weights), sum(weights)
    left = [w * n / total for w in weights]
    small, large = [k for k in range(n) if left[k] < 1], [k for k in range(n) if left[k] >= 1]
    keep, other = [1.0] * n, list(range(n))
    while small and large:
        low, high = small.pop(), large[-1]
        keep[low], other[low] = left[low], high
        left[high] -= 1 - left[low]
        if left[high] < 1:
            small.append(large.pop())
    return keep, other


def weights_of(log_mass, mean: float, deviation: float, least: int, most: float) -> tuple[int, list[float]] | None:
    """The first value and the probabilities of a discrete distribution where they aren't nought, if they fit in a table."""
    lo = max(least, int(mean - 14 * deviation - 40))
    hi = int(min(most, mean + 14 * deviation + 40))
    if hi - lo >= TABLE:
        return None
    return lo, [math.exp(log_mass(k)) for k in range(lo, hi + 1)]


class Generator:
    def __init__(self, spark: SparkSession, seed: int = 0):
        self.spark, self.seed, self._drawn = spark, seed, 0

    def _next(self) -> int:
        """Another seed for every call, the same in every run."""
        self._drawn += 1
        return int(np.random.SeedSequence([self.seed, self._drawn]).generate_state(1)[0] >> 1)

    def spawn(self, n: int) -> list[Generator]:
        return [Generator(self.spark, self._next()) for _ in range(n)]

    def _grid(self, shape, value: Column, kind: str = "float64") -> NDFrame:
        shape = [shape] if isinstance(shape, int) else list(shape)
        df = self.spark.range(math.prod(shape)).select("id", value.alias("v"))
        return NDFrame(df.select(*(c.alias(f"i{k}") for k, c in enumerate(unravel(F.col("id"), shape))), "v"), shape, kind)

    def _u(self) -> Column:
        return F.rand(self._next())

    def _z(self) -> Column:
        return F.randn(self._next())

    def _e(self) -> Column:
        return -F.log1p(-self._u())

    def random(self, shape) -> NDFrame:
        return self._grid(shape, self._u())

    def uniform(self, low: float, high: float, shape) -> NDFrame:
        return self._grid(shape, low + (high - low) * self._u())

    def integers(self, low: int, high: int, shape, endpoint: bool = False) -> NDFrame:
        return self._grid(shape, (F.floor(self._u() * (high - low + endpoint)) + low).cast("bigint"), "int64")

    def normal(self, loc: float, scale: float, shape) -> NDFrame:
        return self._grid(shape, loc + scale * self._z())

    def standard_normal(self, shape) -> NDFrame:
        return self.normal(0.0, 1.0, shape)

    def exponential(self, scale: float, shape) -> NDFrame:
        return self._grid(shape, scale * self._e())

    def standard_exponential(self, shape) -> NDFrame:
        return self.exponential(1.0, shape)

    def standard_cauchy(self, shape) -> NDFrame:
        return self._grid(shape, F.tan(math.pi * (self._u() - 0.5)))

    def gumbel(self, loc: float, scale: float, shape) -> NDFrame:
        return self._grid(shape, loc - scale * F.ln(self._e()))

    def laplace(self, loc: float, scale: float, shape) -> NDFrame:
        return self._grid(shape, loc + scale * (self._e() - self._e()))

    def logistic(self, loc: float, scale: float, shape) -> NDFrame:
        return self._grid(shape, loc + scale * F.ln(self._e() / self._e()))

    def lognormal(self, mean: float, sigma: float, shape) -> NDFrame:
        return self._grid(shape, F.exp(mean + sigma * self._z()))

    def pareto(self, a: float, shape) -> NDFrame:
        return self._grid(shape, F.expm1(self._e() / a))

    def power(self, a: float, shape) -> NDFrame:
        return self._grid(shape, F.pow(-F.expm1(-self._e()), F.lit(1.0 / a)))

    def rayleigh(self, scale: float, shape) -> NDFrame:
        return self._grid(shape, scale * F.sqrt(2 * self._e()))

    def weibull(self, a: float, shape) -> NDFrame:
        return self._grid(shape, F.pow(self._e(), F.lit(1.0 / a)))

    def triangular(self, left: float, mode: float, right: float, shape) -> NDFrame:
        size = math.prod([shape] if isinstance(shape, int) else shape)
        own = [shape] if isinstance(shape, int) else list(shape)
        df = self.spark.range(size).select("id", self._u().alias("u"))
        share = (mode - left) / (right - left)
        v = F.when(F.col("u") <= share, left + F.sqrt(F.col("u") * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - F.col("u")) * (right - left) * (right - mode)))
        return NDFrame(df.select(*(c.alias(f"i{k}") for k, c in enumerate(unravel(F.col("id"), own))), v.alias("v")), own)

    def geometric(self, p: float, shape) -> NDFrame:
        return self._grid(shape, F.greatest(F.ceil(self._e() / -math.log1p(-p)), F.lit(1)).cast("bigint"), "int64") if p < 1 else self._grid(shape, F.lit(1).cast("bigint"), "int64")

    def _of(self, shape, columns: dict[str, Column], value: Column, kind: str = "float64") -> NDFrame:
        """Values of columns that are drawn first, once for each place."""
        shape = [shape] if isinstance(shape, int) else list(shape)
        df = self.spark.range(math.prod(shape)).select("id", *(c.alias(k) for k, c in columns.items())).select("id", value.alias("v"))
        return NDFrame(df.select(*(c.alias(f"i{k}") for k, c in enumerate(unravel(F.col("id"), shape))), "v"), shape, kind)

    def _gamma(self, name: str, a: float) -> tuple[dict[str, Column], Column]:
        """Columns and value of a gamma variable: a cubed normal one, accepted or not; below 1 it is one more, times a power."""
        d = (a + 1 if a < 1 else a) - 1 / 3
        c = 1 / math.sqrt(9 * d)
        tries = F.array(*(F.struct(self._z().alias("z"), self._u().alias("u")) for _ in range(ATTEMPTS["gamma"])))
        cube = F.transform(name, lambda t: F.struct(F.pow(1 + c * t["z"], F.lit(3.0)).alias("v"), t["z"].alias("z"), t["u"].alias("u")))
        good = F.filter(cube, lambda t: (t["v"] > 0) & (F.log(t["u"]) < 0.5 * t["z"] * t["z"] + d - d * t["v"] + d * F.log(t["v"])))
        out = d * F.coalesce(F.get(good, F.lit(0))["v"], F.lit(1.0))
        columns = {name: tries}
        if a < 1:
            columns[f"{name}_u"] = self._u()
            out = out * F.pow(F.col(f"{name}_u"), F.lit(1 / a))
        return columns, out

    def standard_gamma(self, a: float, shape) -> NDFrame:
        return self.gamma(a, 1.0, shape)

    def gamma(self, a: float, scale: float, shape) -> NDFrame:
        columns, value = self._gamma("g", a)
        return self._of(shape, columns, scale * value)

    def chisquare(self, df: float, shape) -> NDFrame:
        return self.gamma(df / 2, 2.0, shape)

    def beta(self, a: float, b: float, shape) -> NDFrame:
        (x, p), (y, q) = self._gamma("g", a), self._gamma("h", b)
        return self._of(shape, x | y, p / (p + q))

    def f(self, top: float, bottom: float, shape) -> NDFrame:
        (x, p), (y, q) = self._gamma("g", top / 2), self._gamma("h", bottom / 2)
        return self._of(shape, x | y, (p / top) / (q / bottom))

    def standard_t(self, df: float, shape) -> NDFrame:
        x, p = self._gamma("g", df / 2)
        return self._of(shape, x | {"z": self._z()}, F.col("z") / F.sqrt(2 * p / df))

    def _noncentral(self, name: str, df: float, nonc: float) -> tuple[dict[str, Column], Column]:
        if df <= 1:
            raise ValueError("more than one degree of freedom is needed")
        x, p = self._gamma(name, (df - 1) / 2)
        z = F.col(f"{name}_z") + math.sqrt(nonc)
        return x | {f"{name}_z": self._z()}, 2 * p + z * z

    def noncentral_chisquare(self, df: float, nonc: float, shape) -> NDFrame:
        return self._of(shape, *self._noncentral("g", df, nonc))

    def noncentral_f(self, top: float, bottom: float, nonc: float, shape) -> NDFrame:
        (x, p), (y, q) = self._noncentral("g", top, nonc), self._gamma("h", bottom / 2)
        return self._of(shape, x | y, (p / top) / (2 * q / bottom))

    def _vectors(self, n: int, columns: dict[str, Column], values: Column, width: int) -> NDFrame:
        df = self.spark.range(n).select("id", *(c.alias(k) for k, c in columns.items())).select(F.col("id").alias("i0"), F.posexplode(values).alias("j", "v"))
        return NDFrame(df.select("i0", F.col("j").cast("long").alias("i1"), "v"), [n, width])

    def dirichlet(self, alpha: Sequence[float], n: int) -> NDFrame:
        columns, parts = {}, []
        for k, a in enumerate(alpha):
            own, value = self._gamma(f"g{k}", a)
            columns |= own
            parts.append(value)
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
        shares = F.get(F.transform(F.array(F.array(*parts)), lambda p: F.transform(p, lambda v: v / total(p))), F.lit(0))
        return self._vectors(n, columns, shares, len(parts))

    def multivariate_normal(self, mean: Sequence[float], cov, n: int) -> NDFrame:
        """Vectors of a small covariance, factored on the driver."""
        w, e = np.linalg.eigh(np.asarray(cov, float))
        root = e * np.sqrt(np.maximum(w, 0))
        columns = {f"z{k}": self._z() for k in range(len(mean))}
        rows = [sum((float(r) * F.col(z) for r, z in zip(row, columns)), F.lit(float(m))) for row, m in zip(root, mean)]
        return self._vectors(n, columns, F.array(*rows), len(rows))

    def wald(self, mean: float, scale: float, shape) -> NDFrame:
        """The lesser root of a normal's square, or the greater one."""
        y = F.col("z") * F.col("z") * mean
        x = mean + mean / (2 * scale) * (y - F.sqrt(4 * scale * y + y * y))
        return self._of(shape, {"z": self._z(), "u": self._u()}, F.when(F.col("u") <= mean / (mean + x), x).otherwise(mean * mean / x))

    def vonmises(self, mu: float, kappa: float, shape) -> NDFrame:
        """Angles under a wrapped Cauchy envelope."""
        if kappa < 1e-8:
            return self.uniform(-math.pi, math.pi, shape)
        t = 1 + math.sqrt(1 + 4 * kappa * kappa)
        rho = (t - math.sqrt(2 * t)) / (2 * kappa)
        r = (1 + rho * rho) / (2 * rho)
        tries = F.array(*(F.struct(F.cos(math.pi * self._u()).alias("z"), self._u().alias("u")) for _ in range(ATTEMPTS["vonmises"])))
        made = F.transform("a", lambda a: F.struct(((1 + r * a["z"]) / (r + a["z"])).alias("w"), a["u"].alias("u")))
        c = lambda a: kappa * (r - a["w"])
        good = F.filter(made, lambda a: (c(a) * (2 - c(a)) - a["u"] > 0) | (F.log(c(a) / a["u"]) + 1 - c(a) >= 0))
        angle = F.acos(F.greatest(F.least(F.coalesce(F.get(good, F.lit(0))["w"], F.lit(1.0)), F.lit(1.0)), F.lit(-1.0)))
        turned = mu + F.when(F.col("u") < 0.5, -angle).otherwise(angle)
        return self._of(shape, {"a": tries, "u": self._u()}, F.pmod(turned + math.pi, F.lit(2 * math.pi)) - math.pi)

    def zipf(self, a: float, shape) -> NDFrame:
        if a <= 1:
            raise ValueError("the exponent must be above 1")
        b = 2.0 ** (a - 1)
        tries = F.array(*(F.struct(F.floor(F.pow(1 - self._u(), F.lit(-1 / (a - 1)))).cast("double").alias("x"), self._u().alias("u")) for _ in range(ATTEMPTS["zipf"])))
        power = lambda t: F.pow(1 + 1 / t["x"], F.lit(a - 1))
        good = F.filter("a", lambda t: (t["x"] < 9e18) & (t["u"] * t["x"] * (power(t) - 1) / (b - 1) <= power(t) / b))
        return self._of(shape, {"a": tries}, F.coalesce(F.get(good, F.lit(0))["x"], F.lit(1.0)).cast("bigint"), "int64")

    def _discrete(self, shape, table: tuple[int, list[float]], times: int = 1) -> NDFrame:
        """Sums of ``times`` values of a table, each by its alias table."""
        first, weights = table
        keep, other = alias_table(weights)
        keeps, others = F.array(*map(F.lit, keep)), F.array(*map(F.lit, other))
        columns = {f"{k}{j}": c for j in range(times) for k, c in (("k", F.floor(self._u() * len(weights)).cast("int")), ("u", self._u()))}
        value = F.lit(first * times).cast("long")
        for j in range(times):
            k = F.col(f"k{j}")
            value = value + F.when(F.col(f"u{j}") < F.get(keeps, k), k).otherwise(F.get(others, k))
        return self._of(shape, columns, value.cast("bigint"), "int64")

    def poisson(self, lam: float, shape) -> NDFrame:
        times = max(1, math.ceil(lam / 16_000))
        own = lam / times
        log = lambda k: k * math.log(own) - own - math.lgamma(k + 1) if own else (0.0 if k == 0 else -math.inf)
        return self._discrete(shape, weights_of(log, own, math.sqrt(own), 0, math.inf), times)

    def binomial(self, n: int, p: float, shape) -> NDFrame:
        if not 0 < p < 1 or not n:
            return self._grid(shape, F.lit(n if p >= 1 else 0).cast("bigint"), "int64")
        times = max(1, math.ceil(n * p * (1 - p) / 16_000))
        if n % times:  # n can't be shared evenly
            return self.draw("binomial", shape, n, p, kind="int64")
        m = n // times
        log = lambda k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log1p(-p)
        return self._discrete(shape, weights_of(log, m * p, math.sqrt(m * p * (1 - p)), 0, m), times)

    def _or_drawn(self, name: str, shape, table, *parameters) -> NDFrame:
        return self.draw(name, shape, *parameters, kind="int64") if table is None else self._discrete(shape, table)

    def negative_binomial(self, n: float, p: float, shape) -> NDFrame:
        log = lambda k: math.lgamma(n + k) - math.lgamma(n) - math.lgamma(k + 1) + n * math.log(p) + (k * math.log1p(-p) if k else 0.0)
        q = 1 - p
        table = weights_of(log, n * q / p, 2 * math.sqrt(n * q) / p + 3 / p, 0, math.inf) if 0 < p < 1 else None
        return self._or_drawn("negative_binomial", shape, table, n, p)

    def logseries(self, p: float, shape) -> NDFrame:
        table = weights_of(lambda k: k * math.log(p) - math.log(k), 0.0, 3 / -math.log(p), 1, math.inf) if 0 < p < 1 else None
        return self._or_drawn("logseries", shape, table, p)

    def hypergeometric(self, good: int, bad: int, sample: int, shape) -> NDFrame:
        pick = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        share, least, most = good / max(good + bad, 1), max(0, sample - bad), min(good, sample)
        table = weights_of(lambda k: pick(good, k) + pick(bad, sample - k) - pick(good + bad, sample), sample * share, math.sqrt(sample * share * (1 - share)), least, most)
        return self._or_drawn("hypergeometric", shape, table, good, bad, sample)

    def multinomial(self, n: int, shares: Sequence[float], size: int) -> NDFrame:
        return self.draw("multinomial", size, n, list(shares), kind="int64", width=len(shares))

    def multivariate_hypergeometric(self, colours: Sequence[int], sample: int, size: int) -> NDFrame:
        return self.draw("multivariate_hypergeometric", size, list(colours), sample, kind="int64", width=len(colours))

    def draw(self, name: str, shape, *parameters, kind: str = "float64", width: int = 0) -> NDFrame:
        """Any distribution of numpy's Generator; ``width`` is the length of its vectors."""
        shape, seed = ([shape] if isinstance(shape, int) else list(shape)), self._next()
        size = math.prod(shape)
        blocks = self.spark.range(-(-size // BLOCK))

        def made(batches):
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    n = min(BLOCK, size - block * BLOCK)
                    own = np.random.Generator(np.random.PCG64(np.random.SeedSequence(seed, spawn_key=(block,))))
                    x = np.asarray(getattr(own, name)(*parameters, size=n)).reshape(-1)
                    at = np.arange(len(x))
                    yield pa.RecordBatch.from_pydict({"id": pa.array(at // max(width, 1) + block * BLOCK, pa.int64()), "j": pa.array(at % max(width, 1), pa.int64()), "v": pa.array(x.astype(kind))})

        df = blocks.mapInArrow(made, f"id long, j long, v {'bigint' if kind == 'int64' else 'double'}")
        columns = [*unravel(F.col("id"), shape), *([F.col("j")] if width else [])]
        return NDFrame(df.select(*(c.alias(f"i{k}") for k, c in enumerate(columns)), "v"), [*shape, *([width] if width else [])], kind)

    def permutation(self, df: DataFrame, name: str = "pos") -> DataFrame:
        """``df`` with every row's place in a random order."""
        return numbered(df.withColumn("_r", F.rand(self._next())), ["_r"], name).drop("_r")

    def permuted(self, x: NDFrame, axis: int) -> NDFrame:
        """Every lane of an axis shuffled on its own."""
        from pyspark.sql import Window

        others = [f"i{k}" for k in range(x.ndim) if k != axis % x.ndim]
        w = Window.partitionBy(*others).orderBy("_r")
        df = x.df.withColumn("_r", F.rand(self._next())).withColumn(f"i{axis % x.ndim}", (F.row_number().over(w) - 1).cast("long"))
        return NDFrame(df, x.shape, x.dtype)

    def choice(self, df: DataFrame, k: int, weight: str | None = None) -> DataFrame:
        """``k`` rows without replacement, by weight if there is one: the largest keys win, so each task keeps k at most."""
        key = self._u() if weight is None else F.ln(self._u()) / F.col(weight)
        return df.withColumn("_r", key).filter(F.col("_r").isNotNull()).orderBy(F.col("_r").desc()).limit(k).drop("_r")


def default_rng(spark: SparkSession, seed: int = 0) -> Generator:
    return Generator(spark, seed)
