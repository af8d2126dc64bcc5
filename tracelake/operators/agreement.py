"""Agreement of raters, shares and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..scratch import average_ranks


def confusion(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", sets: list[list[str]] | None = None) -> DataFrame:
    """tt, tf, ft, ff of two boolean verdicts per key, pairs with a missing verdict left out; with sets, by grouping sets."""
    x = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = lambda c: F.count_if(c).alias
    p, q = F.col(a), F.col(b)
    aggs = [n(p & q)("tt"), n(p & ~q)("tf"), n(~p & q)("ft"), n(~p & ~q)("ff")]
    if sets is None:
        return x.groupBy(*keys).agg(*aggs)
    return x.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*aggs, F.grouping_id().alias("level"))


def agreement(table: DataFrame) -> DataFrame:
    """A 2x2 table's raw agreement, kappa, AC1 and band."""
    tt, tf, ft, ff = (F.col(c) for c in ("tt", "tf", "ft", "ff"))
    n = tt + tf + ft + ff
    x = table.withColumn("n", n).withColumn("raw_agreement", F.when(n > 0, (tt + ff) / n))
    return x.withColumn("kappa", stats.kappa(tt, tf, ft, ff)).withColumn("ac1", stats.ac1(tt, tf, ft, ff)).withColumn("band", stats.kappa_band(F.col("kappa")))


def fleiss(ratings: DataFrame, item: str = "item", rating: str = "rating", keys: tuple[str, ...] = ()) -> DataFrame:
    """Fleiss' kappa of binary ratings in long form, per key: null with fewer than two raters or total chance agreement, and
    where items have different numbers of raters (column ragged)."""
    each = ratings.filter(F.col(rating).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("_k"), F.sum(F.col(rating).cast("int")).alias("_yes"))
    k, yes = F.col("_k"), F.col("_yes")
    pi = (yes * (yes - 1) + (k - yes) * (k - yes - 1)) / (k * (k - 1))
    x = each.groupBy(*keys).agg(F.count("*").alias("n_items"), F.min("_k").alias("k1"), F.max("_k").alias("k2"), F.avg(F.when(k > 1, pi)).alias("p_bar"), (F.sum("_yes") / F.sum("_k")).alias("p"))
    pe = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    ok = (F.col("k1") == F.col("k2")) & (F.col("k1") >= 2) & (pe < 1)
    return x.select(*keys, "n_items", F.col("k2").alias("n_raters"), (F.col("k1") != F.col("k2")).alias("ragged"), F.when(ok, (F.col("p_bar") - pe) / (1 - pe)).alias("fleiss_kappa"))


def unanimity(ratings: DataFrame, keys: list[str], item: str = "item", rating: str = "rating") -> DataFrame:
    each = ratings.filter(F.col(rating).isNotNull()).groupBy(*keys, item).agg((F.min(rating) == F.max(rating)).alias("same"))
    return each.groupBy(*keys).agg(F.count("*").alias("n_items"), F.avg(F.col("same").cast("int")).alias("unanimous"))


def share_cells(verdicts: DataFrame, keys: list[str], verdict: str = "faithful") -> DataFrame:
    """n, faithful, share and its Wilson interval per key, over valid verdicts."""
    x = verdicts.filter(F.col(verdict).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(verdict)).alias("faithful"))
    lo, hi = stats.wilson(F.col("faithful").cast("double"), F.col("n").cast("double"))
    return x.withColumn("share", F.col("faithful") / F.col("n")).withColumn("wilson_lo", lo).withColumn("wilson_hi", hi)


def trend(verdicts: DataFrame, keys: list[str], stratum: str, order: list[str], verdict: str = "faithful") -> DataFrame:
    """Cochran-Armitage z over ordered strata and Fisher's exact p of the first against the last, per key."""
    x = verdicts.filter(F.col(verdict).isNotNull())
    aggs = []
    for i, s in enumerate(order):
        aggs += [F.count_if(F.col(stratum) == s).alias(f"n{i}"), F.count_if((F.col(stratum) == s) & F.col(verdict)).alias(f"x{i}")]
    y = x.groupBy(*keys).agg(*aggs)
    last = len(order) - 1
    z = stats.trend_z([(F.col(f"x{i}"), F.col(f"n{i}"), float(i)) for i in range(len(order))])
    p = stats.fisher_p(F.col("x0"), F.col("n0") - F.col("x0"), F.col(f"x{last}"), F.col(f"n{last}") - F.col(f"x{last}"))
    return y.withColumn("trend_z", z).withColumn("fisher_p", p)


def monotone(cells: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Does a value never rise, or never fall, along the ordered strata of a key? Cells are summary rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    d = F.col(value) - F.lag(value).over(w)
    return cells.withColumn("d", d).groupBy(*keys).agg(F.count("*").alias("n_cells"), F.coalesce(F.every(F.col("d") <= 0), F.lit(True)).alias("never_rises"), F.coalesce(F.every(F.col("d") >= 0), F.lit(True)).alias("never_falls"))


def spearman(rows: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Spearman's rho of two columns per key (average ranks): null under 3 rows or 2 distinct values of a column."""
    keys = keys or []
    x = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    if not keys:
        x, keys = x.withColumn("_all", F.lit(0)), ["_all"]
    x = average_ranks(x, keys, a).withColumnRenamed("rank", "ra").drop("ties")
    x = average_ranks(x, keys, b).withColumnRenamed("rank", "rb")
    out = x.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("rho"), F.min("ra").alias("a1"), F.max("ra").alias("a2"), F.min("rb").alias("b1"), F.max("rb").alias("b2"))
    ok = (F.col("n") >= 3) & (F.col("a1") < F.col("a2")) & (F.col("b1") < F.col("b2"))
    return out.select(*[k for k in keys if k != "_all"], "n", F.when(ok, F.col("rho")).alias("spearman_rho"))


def interaction(rows: DataFrame, keys: list[str], a: str, b: str, y: str) -> DataFrame:
    """The interaction of two yes/no factors in a logistic model of y: log_odds, its error and z. With both factors and their product
    the model is saturated, so its maximum is the difference of two log odds ratios of counts; null if a cell is empty."""
    n = {(p, q, r): F.count_if((F.col(a) == p) & (F.col(b) == q) & (F.col(y) == r)).alias(f"n{p:d}{q:d}{r:d}") for p in (False, True) for q in (False, True) for r in (False, True)}
    x = rows.groupBy(*keys).agg(*n.values())
    c = lambda p, q, r: F.col(f"n{p:d}{q:d}{r:d}").cast("double")
    odds = lambda p, q: F.log(c(p, q, 1) / c(p, q, 0))
    cells = [c(p, q, r) for p in (0, 1) for q in (0, 1) for r in (0, 1)]
    full = F.least(*cells) > 0
    effect = (odds(1, 1) - odds(1, 0)) - (odds(0, 1) - odds(0, 0))
    error = F.sqrt(sum((1 / v for v in cells[1:]), 1 / cells[0]))
    return x.select(*keys, F.when(full, effect).alias("log_odds"), F.when(full, error).alias("error"), F.when(full, effect / error).alias("z"))
