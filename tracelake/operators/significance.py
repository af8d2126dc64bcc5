"""Paired differences, rank tests, corrections, effect sizes and bootstrap intervals."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..scratch import average_ranks, ranges_for, written

#: Resamples of a bootstrap and its seed.
RESAMPLES, SEED = 1000, 20260511


def pairs_long(wide: DataFrame, keys: list[str], names) -> DataFrame:
    """keys, pipeline_i, pipeline_j, x, y for each unordered pair of score columns, one row a question."""
    structs = [F.struct(F.lit(a).alias("pipeline_i"), F.lit(b).alias("pipeline_j"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in combinations(names, 2)]
    return wide.select(*keys, F.explode(F.array(*structs)).alias("p")).select(*keys, "p.*")


def pairwise_delta(long: DataFrame, keys: list[str]) -> DataFrame:
    """n and mean of x - y over questions that have both."""
    x = long.filter("x is not null and y is not null")
    return x.groupBy(*keys, "pipeline_i", "pipeline_j").agg(F.count("*").alias("n_paired"), F.avg(F.col("x") - F.col("y")).alias("mean_delta"))


def wilcoxon(long: DataFrame, keys: list[str]) -> DataFrame:
    """Signed-rank test, zeros dropped, average ranks on 9 places, tie-corrected normal statistic: w_plus, n, z (null if under 2
    pairs or no difference); and the exact p, two-sided and one-sided (greater), of cells of up to EXACT differences."""
    by = [*keys, "pipeline_i", "pipeline_j"]
    x = long.filter("x is not null and y is not null").withColumn("d", F.round(F.col("x") - F.col("y"), 9))
    pairs = x.groupBy(*by).agg(F.count("*").alias("n_paired"))
    d = x.filter("d <> 0").withColumn("size", F.abs("d"))
    r = average_ranks(d, by, "size")
    t = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.col("ties").cast("double") * F.col("ties") - 1).alias("t"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48
    z = F.when((F.col("n_paired") >= 2) & (var > 0), (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var))
    small = t.filter(F.col("n") <= stats.EXACT).select(*by)
    ranks = r.join(small, by, "left_semi").groupBy(*by).agg(F.collect_list("rank").alias("ranks"))  # EXACT at most
    x = pairs.join(t, by, "left").join(ranks, by, "left")
    p = x.withColumn("p", stats.signed_rank_p("ranks", "w_plus")).withColumn("z", z)
    return p.select(*by, "n_paired", F.coalesce("n", F.lit(0)).alias("n_nonzero"), "w_plus", "z", F.nanvl("p.two", F.lit(None)).alias("exact_p"), F.nanvl("p.upper", F.lit(None)).alias("exact_upper_p"))


def signed_rank_p(tests: DataFrame) -> DataFrame:
    """tests (of wilcoxon) with wilcoxon_p and upper_p: exact where that is known, else of the normal statistic."""
    return tests.withColumn("wilcoxon_p", F.coalesce("exact_p", stats.two_sided_p("z"))).withColumn("upper_p", F.coalesce("exact_upper_p", stats.upper_p("z")))


def cliffs_delta(long: DataFrame, keys: list[str]) -> DataFrame:
    """Cliff's delta of all x against all y (unpaired) by the rank-sum identity, with its magnitude."""
    by = [*keys, "pipeline_i", "pipeline_j"]
    both = long.select(*by, F.explode(F.array(F.struct(F.lit(1).alias("is_x"), F.col("x").alias("v")), F.struct(F.lit(0).alias("is_x"), F.col("y").alias("v")))).alias("s")).select(*by, "s.*").filter("v is not null")
    r = average_ranks(both, by, "v")
    t = r.groupBy(*by).agg(F.sum("is_x").cast("double").alias("nx"), F.sum(1 - F.col("is_x")).cast("double").alias("ny"), F.sum(F.col("rank") * F.col("is_x")).alias("rx"))
    d = F.when((F.col("nx") > 0) & (F.col("ny") > 0), 2 * (F.col("rx") - F.col("nx") * (F.col("nx") + 1) / 2) / (F.col("nx") * F.col("ny")) - 1)
    return t.select(*by, F.col("nx").cast("long").alias("nx"), F.col("ny").cast("long").alias("ny"), d.alias("delta")).withColumn("magnitude", stats.cliffs_magnitude(F.col("delta")))


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """tests with holm_p and family_size over the rows with a p (summary rows: a family is one window)."""
    names = tests.columns
    ok = tests.withColumn("_ok", F.col(p).isNotNull())
    w = Window.partitionBy("_ok").orderBy(p, *[c for c in names if c != p])
    m = F.count("*").over(Window.partitionBy("_ok"))
    step = ok.withColumn("_m", m).withColumn("_a", (F.col("_m") - F.row_number().over(w) + 1) * F.col(p))
    up = F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))
    size = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(F.lit(0)))
    out = step.withColumn("holm_p", F.when(F.col("_ok"), F.least(F.lit(1.0), up))).withColumn("family_size", size)
    return out.select(*names, "holm_p", "family_size")


def joint_significance(tests: DataFrame) -> DataFrame:
    """significant: the interval excludes 0, holm_p < .05, and |cliffs_delta| is not negligible; what is missing is no."""
    c = F.coalesce(F.col("ci_excludes_zero"), F.lit(False)) & (F.coalesce("holm_p", F.lit(1.0)) < 0.05) & (F.coalesce(F.abs("cliffs_delta"), F.lit(0.0)) >= 0.147)
    return tests.withColumn("significant", c)


#: Rows whose draws one step deals out at once.
LEAF = 256


def _generator(key: int, seed: int, lo: int, hi: int) -> np.random.Generator:
    """The generator of a node of a key's tree: the same on any machine."""
    return np.random.Generator(np.random.Philox(key=(key & (1 << 64) - 1) ^ seed, counter=[0, 0, lo, hi]))


def leaf_draws(key: int, n: int, leaf: int, resamples: int, seed: int) -> np.ndarray:
    """How many of a resample's n draws fall on a leaf's rows (LEAF of a key's n rows, by place), for every resample. Down a tree of
    ranges, each node splits its draws by a binomial in proportion to its halves' rows; so all leaves together get exactly n."""
    lo, hi, draws = 0, -(-n // LEAF), np.full(resamples, n, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _generator(key, seed, lo, hi).binomial(draws, (mid - lo) * LEAF / (min(hi * LEAF, n) - lo * LEAF))
        lo, hi, draws = (lo, mid, left) if leaf < mid else (mid, hi, draws - left)
    return draws


def _resampled(values: np.ndarray, key: int, n: int, leaf: int, resamples: int, seed: int) -> np.ndarray:
    """(2, resamples): the sum of a leaf's values over its draws, and the number of draws."""
    draws = leaf_draws(key, n, leaf, resamples, seed)
    picked = _generator(key, seed + 1, leaf, leaf + 1).integers(0, len(values), int(draws.sum()))
    return np.stack((np.bincount(np.repeat(np.arange(resamples), draws), values[picked], resamples), draws))


def resampled_sums(values: DataFrame, keys: list[str], value: str, row_id: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """keys, b, s, w: for each key and resample b the sum of the values drawn and the number of draws, which is the key's number of
    rows: a multinomial bootstrap in which no key is gathered. Rows are placed by a hash of their id, in ranges of it that are counted
    first; a task deals out the draws of the leaves it holds, and sums them."""
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    x = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), F.xxhash64(*row_id, F.lit(seed)).alias("h"), F.to_json(F.struct(F.lit(0).alias("_"), *keys)).alias("kk"))
    x = written(x, "values")
    total = x.count()
    parts = ranges_for(total)
    x = x.withColumn("_r", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * parts))
    counts = x.groupBy("kk", "_r").agg(F.count("*").alias("_m"))
    before = Window.partitionBy("kk").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # ranges of a key
    counts = counts.select("kk", "_r", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"), F.sum("_m").over(Window.partitionBy("kk")).alias("n"))
    place = F.col("_base") + F.row_number().over(Window.partitionBy("kk", "_r").orderBy("h", "v")) - 1
    y = x.join(counts, ["kk", "_r"]).withColumn("at", place).withColumn("leaf", F.floor(F.col("at") / LEAF)).withColumn("kh", F.xxhash64("kk"))
    dealt = y.select(*keys, "kk", "kh", "leaf", "at", "n", "v").repartition(max(8, min(1 << 14, total // 20_000)), "kk", "leaf").sortWithinPartitions("kk", "leaf", "at")

    def run(batches):
        sums: dict[str, list] = {}
        open_: list = []  # the leaf that is being read: its key's name, keys, (hash, n, leaf), values

        def close():
            name, mine, (kh, n, leaf), parts = open_
            found = _resampled(np.concatenate(parts), kh, n, leaf, resamples, seed)
            held = sums.setdefault(name, [mine, np.zeros_like(found, np.float64)])
            held[1] += found

        for batch in batches:
            kh, leaf, n, v = (np.array(batch.column(c)) for c in ("kh", "leaf", "n", "v"))
            cuts = np.flatnonzero((kh[1:] != kh[:-1]) | (leaf[1:] != leaf[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(v)]):
                if lo == hi:
                    continue
                which = (int(kh[lo]), int(n[lo]), int(leaf[lo]))
                if open_ and open_[2] == which:
                    open_[3].append(v[lo:hi])
                    continue
                if open_:
                    close()
                open_ = [batch.column("kk")[lo].as_py(), [batch.column(k)[lo] for k in keys], which, [v[lo:hi]]]
            if len(sums) > 2000:
                yield out(sums)
                sums = {}
        if open_:
            close()
        yield out(sums)

    def out(sums):
        held = list(sums.values())
        arrays = [pa.array([mine[i].as_py() for mine, _ in held for _ in range(resamples)], types[k]) for i, k in enumerate(keys)]
        flat = lambda i: pa.array(np.concatenate([f[i] for _, f in held]) if held else [], pa.float64())
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.tile(np.arange(resamples, dtype=np.int32), len(held))), flat(0), flat(1)], [*keys, "b", "s", "w"])

    types = {f.name: f.type for f in dealt.limit(0).toArrow().schema}
    reps = dealt.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "b int, s double, w double"]))
    return reps.groupBy(*keys, "b").agg(F.sum("s").alias("s"), F.sum("w").cast("long").alias("w"))


def bca_mean(values: DataFrame, keys: list[str], value: str, row_id: list[str], resamples: int = RESAMPLES, seed: int = SEED, level: float = 0.95, least: int = 2, constant_is_point: bool = False) -> DataFrame:
    """mean, ci_lo, ci_hi, method per key: a BCa interval of the mean.

    Resamples are those of resampled_sums: multinomial, and sums, so a key of any size is never gathered. For a mean, the jackknife's
    acceleration is a ratio of central moments. Null under `least` rows, and without variance (or the constant itself, if it is to
    count as a point; shares of few judgments take 5 rows and that).
    """
    reps = resampled_sums(values, keys, value, row_id, resamples, seed)
    x = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    reps = reps.select(*keys, F.try_divide("s", "w").alias("m")).groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("means"))  # resamples values a key
    m1 = x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.skewness("v").alias("skew"))
    y = m1.join(reps, keys) if keys else m1.crossJoin(reps)
    tail = (1 - level) / 2
    z = stats.NORMAL.inv_cdf

    def interval(pdfs):
        for pdf in pdfs:
            lo, hi, how = [], [], []
            for n, mean, sd, skew, means in zip(*(pdf[c] for c in ("n", "mean", "sd", "skew", "means"))):
                if n < least or not sd > 1e-12 * max(1.0, abs(mean)):
                    point = float(mean) if constant_is_point and n >= least else None
                    lo.append(point), hi.append(point), how.append(f"n<{least}" if n < least else "constant")
                    continue
                m = np.asarray(means)
                below = (np.sum(m < mean) + np.sum(m == mean) / 2) / len(m)
                a = skew / (6 * n**0.5)
                if 0 < below < 1:
                    z0 = z(below)
                    q = [stats.NORMAL.cdf(z0 + (z0 + t) / (1 - a * (z0 + t))) for t in (z(tail), z(1 - tail))]
                    how.append("BCa")
                else:
                    q = [tail, 1 - tail]
                    how.append("percentile")
                lo.append(float(np.quantile(m, q[0]))), hi.append(float(np.quantile(m, q[1])))
            yield pdf[[*keys, "n", "mean"]].assign(ci_lo=np.array(lo, float), ci_hi=np.array(hi, float), method=how)

    out = y.select(*keys, "n", "mean", "sd", "skew", "means").mapInPandas(interval, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, mean double, ci_lo double, ci_hi double, method string"]))
    return out.withColumn("ci_lo", F.nanvl("ci_lo", F.lit(None).cast("double"))).withColumn("ci_hi", F.nanvl("ci_hi", F.lit(None).cast("double")))
