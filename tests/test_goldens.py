"""Published summary values, recomputed from the published counts."""

import math

from pyspark.sql import functions as F

from tracelake.functions import stats
from tracelake.operators import agreement, significance

#: 2x2 tables (tt, tf, ft, ff) of two judges with their raw agreement, kappa and AC1.
JUDGES = [
    (46, 5, 28, 16, 0.6526315789473685, 0.2754795470302751, 0.3682619647355165),
    (33, 16, 28, 34, 0.6036036036036037, 0.21630295250320933, 0.20727154682681398),
    (4, 15, 13, 62, 0.7021276595744681, 0.038714390065741414, 0.5685245901639344),
    (83, 36, 69, 112, 0.65, 0.3019235883343676, 0.30648055393489737),
    (16, 3, 11, 30, 0.7666666666666667, 0.5155709342560555, 0.5574288724973657),
    (16, 7, 14, 23, 0.65, 0.30000000000000004, 0.3093998355713895),
    (10, 9, 20, 21, 0.5166666666666667, 0.03333333333333344, 0.06476753560870747),
    (27, 10, 14, 9, 0.6, 0.12515188335358435, 0.26605504587155965),
    (14, 7, 10, 29, 0.7166666666666667, 0.39716312056737585, 0.4666666666666667),
]
#: N, faithful, share and Wilson bounds to 4 places.
CELLS = [(18, 8, 0.4444, 0.2456, 0.6628), (23, 10, 0.4348, 0.2563, 0.6319), (19, 3, 0.1579, 0.0552, 0.3757), (19, 9, 0.4737, 0.2733, 0.6829)]
#: Faithful of n in three strata, trend z to 3 places, its p and the end points' Fisher p to 5.
TRENDS = [
    ((8, 18), (10, 23), (3, 19), -1.844, 0.06512, 0.07889),
    ((14, 18), (7, 23), (3, 19), -3.826, 0.00013, 0.00023),
    ((6, 18), (11, 23), (10, 19), 1.173, 0.24064, 0.32454),
    ((22, 23), (19, 22), (3, 15), -4.887, 0.0, 0.0),
]
#: P, its Holm correction in a family of 30, Cliff's delta, magnitude, whether the interval excludes 0, verdict.
TESTS = [
    (3.02721004690792e-08, 7.568025117269801e-07, 0.339, "medium", True, True), (2.750641943074675e-07, 6.3264764690717526e-06, 0.2974, "small", True, True),
    (0.1243661754359705, 0.994929403487764, 0.053, "negligible", False, False), (1.5774294576457107e-06, 3.3126018610559926e-05, 0.2333, "small", True, True),
    (0.17060593704847204, 1.0, -0.0431, "negligible", False, False), (4.03008419035985e-06, 8.0601683807197e-05, -0.3089, "small", True, True),
    (0.036646888255682575, 0.4031157708125083, -0.1278, "negligible", True, False), (2.1214689567312465e-05, 0.00038186441221162436, -0.2663, "small", True, True),
    (0.18522502925004725, 1.0, -0.0829, "negligible", True, False), (4.5357477694395914e-05, 0.0007710771208047306, 0.1926, "small", True, True),
    (3.485735647978668e-12, 9.76005981434027e-11, 0.5241301907968574, "large", True, True), (1.2579023255900373e-12, 3.7737069767701116e-11, 0.5454545454545454, "large", True, True),
    (0.6465446078820333, 1.0, -0.024997449239873484, "negligible", False, False), (8.75409603424417e-09, 2.2760649689034842e-07, 0.37914498520559126, "medium", True, True),
    (0.8992515086102616, 1.0, -0.003264972961942659, "negligible", False, False), (2.710690032696339e-11, 7.318863088280116e-10, -0.556065707580859, "large", True, True),
    (0.0036870797368762187, 0.04424495684251462, -0.15100499948984797, "small", True, True), (2.4152545269503768e-12, 7.004238128156093e-11, -0.5706560555045403, "large", True, True),
    (0.0015056587846261898, 0.021079222984766655, -0.155188246097337, "small", True, True), (3.168030738952077e-08, 7.603273773484985e-07, 0.4088358330782573, "medium", True, True),
    (9.426564054489182e-05, 0.0015082502487182691, -0.362844085450101, "medium", True, True), (3.715495210835525e-07, 8.174089463838156e-06, -0.4180040386863641, "medium", True, True),
    (0.00015812960709638674, 0.002371944106445801, -0.22616643639068976, "small", True, True), (4.728414396061474e-06, 8.9839873525168e-05, -0.27122967371665424, "small", True, True),
    (0.0031720353710394705, 0.041236459823513115, -0.09225209905409715, "negligible", True, False), (0.7599764614492699, 1.0, 0.09799128493995111, "negligible", False, False),
    (0.9011840247455585, 1.0, 0.06196195132320119, "negligible", False, False), (0.0495580819126489, 0.495580819126489, 0.17738335636093103, "small", True, False),
    (0.0996082831623159, 0.8964745484608432, 0.14379849080667445, "negligible", False, False), (0.12544647422396138, 0.994929403487764, -0.03709214581783399, "negligible", False, False),
]


def test_agreement(spark):
    t = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(JUDGES)], "i int, tt long, tf long, ft long, ff long")
    for r in agreement.agreement(t).collect():
        want = JUDGES[r["i"]][4:]
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip((r["raw_agreement"], r["kappa"], r["ac1"]), want))


def test_wilson(spark):
    t = spark.createDataFrame([(float(n), float(x), p, a, b) for n, x, p, a, b in CELLS], "n double, x double, p double, a double, b double")
    lo, hi = stats.wilson(F.col("x"), F.col("n"))
    for r in t.select(F.round(F.col("x") / F.col("n"), 4).alias("s"), F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"), "p", "a", "b").collect():
        assert (r["s"], r["lo"], r["hi"]) == (r["p"], r["a"], r["b"])


def test_trends(spark):
    rows = [(i, s, k < x) for i, t in enumerate(TRENDS) for s, (x, n) in zip("abc", t[:3]) for k in range(n)]
    t = agreement.trend(spark.createDataFrame(rows, "i int, s string, faithful boolean"), ["i"], "s", ["a", "b", "c"]).withColumn("p", stats.two_sided_p("trend_z"))
    for r in t.collect():
        z, p, f = TRENDS[r["i"]][3:]
        assert round(r["trend_z"], 3) == z and math.isclose(r["p"], p, abs_tol=6e-6) and math.isclose(r["fisher_p"], f, abs_tol=6e-6)


def test_significance(spark):
    t = spark.createDataFrame([(i, r[0], r[2], r[4]) for i, r in enumerate(TESTS)], "i int, p double, cliffs_delta double, ci_excludes_zero boolean")
    x = significance.joint_significance(significance.holm(t, "p")).withColumn("magnitude", stats.cliffs_magnitude(F.col("cliffs_delta")))
    for r in x.collect():
        want = TESTS[r["i"]]
        assert math.isclose(r["holm_p"], want[1], rel_tol=1e-9) and (r["magnitude"], r["significant"], r["family_size"]) == (want[3], want[5], 30)
