"""Row rules, zero-fill, ranks, quantiles and tests on small literal tables."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalspark.functions import expr as X
from shoalspark.operators import enrich as E
from shoalspark.operators import kinematics as K
from shoalspark.operators import occupancy as O
from shoalspark.operators import paired as P
from shoalspark.operators import quality as Q
from shoalspark.operators import ranks as R
from shoalspark.operators import reshape as RS
from shoalspark.operators import summary as SM

RAW = ("time string, frame bigint, olf_x double, olf_y double, speed_mm_per_sec double, distance_mm double, "
       "cue_side string, treatment string, fish_replicate string")


@pytest.fixture(scope="module")
def frames_nulls(spark):
    rows = [
        ("00:00.00", 0, 0.2, 0.5, 1.0, 0.1, "Right", "C8AHL", "1"),
        ("09:59.99", 1, 0.5, 0.5, 2.0, 0.2, "Right", "C8AHL", "1"),
        ("10:00.00", 2, 0.4, 0.5, 3.0, 0.3, "Left", "C8AHL", "1"),
        ("10:00.50", 3, None, 0.5, None, None, "Right", "C8AHL", "1"),
        ("19:59.00", 4, 0.9, 0.5, 5.0, 0.5, None, "C8AHL", "1"),
        ("xx:00.00", 5, 0.9, 0.5, 5.0, 0.5, "Right", "C8AHL", "1"),
        ("01:00.00", 0, 0.9, 0.5, 5.0, 0.5, "Right", "C8DMS0", "1"),
    ]
    return spark.createDataFrame(rows, RAW)


def test_enrich_null_rules(frames_nulls):
    got = {r["frame"]: r for r in E.enrich(frames_nulls).where("treatment = 'C8AHL'").collect()}
    assert (got[0]["cue_x"], got[0]["zone_side"], got[0]["zone_cue"], got[0]["part"]) == (0.2, "Left", "control", "Before")
    assert got[1]["zone_side"] == "Right" and got[1]["part"] == "Before" and got[1]["minute"] == 10
    assert abs(got[1]["secs"] - 599.99) < 1e-9
    assert got[2]["part"] == "After" and got[2]["part_ord"] == 1 and abs(got[2]["cue_x"] - 0.6) < 1e-12
    assert got[3]["zone_side"] is None and got[3]["zone_cue"] is None and got[3]["part"] == "After"
    assert got[4]["cue_x"] is None and got[4]["zone_side"] == "Right" and got[4]["zone_cue"] is None
    assert got[5]["secs"] is None and got[5]["part"] is None and got[5]["minute"] is None


def test_time_lag(frames_nulls):
    rows = E.with_time_lag(E.enrich(frames_nulls)).collect()
    lag = {(r["treatment"], r["frame"]): (r["max_frame"], r["timelag"]) for r in rows}
    assert lag["C8AHL", 0] == (5, None) and lag["C8AHL", 3] == (5, 240.0)
    assert lag["C8DMS0", 0] == (0, None)
    both = E.with_time_lag(E.enrich(frames_nulls), entity=["fish"]).where("treatment = 'C8DMS0'").first()
    assert both["max_frame"] == 5


def test_time_in_zone_equals_row_sums(frames_nulls):
    df = E.enrich(frames_nulls)
    keys = ["fish", "treatment", "part"]
    fast = {tuple(r)[:4]: r["sum"] for r in O.time_in_zone(df, keys, "zone_side").collect()}
    slow = E.with_time_lag(df).where("zone_side is not null").groupBy(*keys, "zone_side") \
        .agg(F.coalesce(F.sum("timelag"), F.lit(0.0)).alias("sum"))
    assert fast == pytest.approx({tuple(r)[:4]: r["sum"] for r in slow.collect()})
    counted = O.time_in_zone(df, keys, "zone_side", untracked="count").where("zone_side is null").collect()
    assert [r["sum"] for r in counted] == [240.0]
    with pytest.raises(ValueError):
        O.time_in_zone(df, ["part"], "zone_side")


@pytest.fixture(scope="module")
def sparse(spark):
    rows = [("1", "a", 1, "cue", 5.0), ("1", "a", 2, "control", 3.0), ("2", "b", 1, "cue", 4.0), ("2", "b", 2, None, 2.0)]
    return spark.createDataFrame(rows, "fish string, treatment string, minute int, zone string, sum double")


def test_zero_fill(sparse):
    tracked = sparse.where("zone is not null")
    nested = O.zero_fill(tracked, ["fish", "treatment"], {"minute": [1, 2, 3], "zone": ["cue", "control"]}).collect()
    assert len(nested) == 2 * 3 * 2
    cell = {(r["fish"], r["minute"], r["zone"]): r["sum"] for r in nested}
    assert cell["1", 1, "cue"] == 5.0 and cell["1", 3, "cue"] == 0.0 and cell["2", 2, "control"] == 0.0
    crossed = O.zero_fill(sparse, ["fish"], {"minute": None, "zone": None, "treatment": None}).collect()
    # observed levels: 2 minutes, 3 zones with the null one, 2 treatments
    assert len(crossed) == 2 * 2 * 3 * 2
    null_cell = [r["sum"] for r in crossed if r["zone"] is None and r["fish"] == "2" and r["minute"] == 2 and r["treatment"] == "b"]
    assert null_cell == [2.0]
    carried = O.zero_fill(tracked.withColumn("tag", F.lit("t")), ["fish"], {"minute": [1, 2]}, carry=["tag"])
    assert {(r["fish"], r["minute"]): r["tag"] for r in carried.collect()} == \
        {("1", 1): "t", ("1", 2): "t", ("2", 1): "t", ("2", 2): None}


def test_zero_fill_over_large_observed_axes(spark):
    """Two axes in several blocks each, one declared: every combination once, all measures in place, no axis in one row."""
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "a").alias("fish"),  # a null entity is one of its own
                                  F.when(F.col("id") != 7, F.col("id") % 500).alias("minute"),
                                  F.concat(F.lit("z"), F.floor(F.col("id") / 300).cast("string")).alias("zone"),
                                  F.when(F.col("id") % 3 == 0, "on").otherwise("off").alias("light"), (F.col("id") + 1.0).alias("sum"))
    filled = O.zero_fill(df, ["fish"], {"minute": None, "light": ["on", "off"], "zone": None}, block=4)
    assert "collect_set" not in filled._jdf.queryExecution().toString()
    rows = filled.collect()
    combos = {(r["fish"], r["minute"], r["light"], r["zone"]): r["sum"] for r in rows}
    assert len(rows) == len(combos) == 2 * 501 * 2 * 10
    want = {(r["fish"], r["minute"], r["light"], r["zone"]): r["sum"] for r in df.collect()}
    assert {k: v for k, v in combos.items() if v} == want
    assert O.zero_fill(df.limit(0), ["fish"], {"minute": None, "zone": None}).count() == 0


def test_zero_fill_refuses_undeclared_levels(sparse):
    with pytest.raises(Exception, match="undeclared level of minute"):
        O.zero_fill(sparse, ["fish"], {"minute": [1], "zone": None}).collect()


def test_share_sums_to_hundred(sparse):
    filled = O.zero_fill(sparse, ["fish"], {"minute": [1, 2, 3], "zone": ["cue", "control", None]})
    got = O.zone_share(filled, ["fish", "minute"], "zone").groupBy("fish", "minute") \
        .agg(F.sum("ratioside").alias("r"), F.max("total_sum").alias("t")).collect()
    assert all(abs(r["r"] - (100.0 if r["t"] > 0 else 0.0)) < 1e-9 for r in got)


def test_duplicates_and_filters(spark, frames_nulls):
    dup = E.enrich(frames_nulls.unionByName(frames_nulls.where("frame = 2")))
    assert [(r["frame"], r["rows"]) for r in Q.duplicates(dup).collect()] == [(2, 2)]
    assert Q.duplicate_rows(dup).count() == 2
    kept, removed = Q.split_untracked(dup)
    assert removed.count() == 1 and kept.count() == dup.count() - 1
    cohort = spark.createDataFrame([("13", "C8AHL"), ("20", "C8DMS0"), ("21", "C8DMS0"), ("x", "C8DMS0"), (None, "menthe")],
                                   "fish string, treatment string")
    assert {r["fish"] for r in Q.valid_cohort(cohort).collect()} == {"13", "20"}
    assert {r["fish"] for r in Q.exclude(cohort, "fish", ["13"]).collect()} == {"20", "21", "x"}
    assert [r["treatment"] for r in Q.unknown_levels(cohort, "treatment", ["C8AHL", "C8DMS0"]).collect()] == ["menthe"]


def test_summary_of_short_groups(spark):
    df = spark.createDataFrame([("one", 2.0), ("none", None), ("two", 1.0), ("two", 3.0)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in SM.summarise(df, ["k"], "v").collect()}
    assert got["one"] == (2.0, None, 1, None) and got["none"] == (None, None, 0, None)
    assert got["two"] == pytest.approx((2.0, math.sqrt(2), 2, 1.0))
    dist = K.distance_per_minute(df, ["k"], "v")
    assert {r["k"]: r["sumdist"] for r in dist.collect()} == {"one": 2.0, "none": 0.0, "two": 4.0}


def test_clean_and_text_helpers(spark):
    df = spark.createDataFrame([(float("nan"), "a b"), (1.0, "c")], "v double, t string")
    assert df.agg(F.avg(X.clean("v"))).first()[0] == 1.0
    assert [r[0] for r in df.select(X.recode("t", {"c": "z"})).collect()] == ["a b", "z"]
    names = spark.createDataFrame([("n_cuex.shape1.state2.(Intercept)", 1.0)], "name string, estimate double")
    row = RS.tidy_param_names(names).first()
    assert (row["variable"], row["state"]) == ("shape1", "state2")
    a, b = X.prec_to_shape(F.lit(0.25), F.lit(50.0))
    mu, phi = X.shape_to_prec(a, b)
    assert spark.range(1).select(mu, phi).first() == (0.25, 50.0)


def test_value_ranks_match_pandas(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.exponential(5, 4000), 1)
    k = rng.integers(0, 3, 4000)
    df = spark.createDataFrame([(f"k{a}", float(b)) for a, b in zip(k, v)], "k string, v double").repartition(7)
    got = {(r["k"], r["v"]): r["r"] for r in R.value_ranks(df, ["k"], "v", buckets=16)
           .select("k", "v", R.average_rank().alias("r")).collect()}
    import pandas as pd
    pdf = pd.DataFrame({"k": [f"k{a}" for a in k], "v": v})
    pdf["r"] = pdf.groupby("k")["v"].rank(method="average")
    want = pdf.drop_duplicates(["k", "v"])
    assert got == {(a, b): c for a, b, c in zip(want["k"], want["v"], want["r"])}


@pytest.mark.parametrize("shape", ["smooth", "ties", "skew"])
def test_quantiles_of_hot_groups_equal_builtin(spark, shape):
    rng = np.random.default_rng(5)
    n = 45_000  # the hot key is beyond the size whose bracket is the whole group
    v = {"smooth": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float),
         "skew": np.exp(rng.normal(0, 6, n))}[shape]
    # one key holds most rows, one is small, one has no value at all
    keys = ["hot" if i % 9 else ("small" if i % 2 else None) for i in range(n)]
    rows = [(k, float(x)) for k, x in zip(keys, v)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.025, 0.5, 0.975, 1.0]
    plain = {r["k"]: r["quantiles"] for r in R.narrow_quantiles(df, ["k"], "v", probs).collect()}
    hot = {r["k"]: r["quantiles"] for r in R.group_quantiles(df, ["k"], "v", probs).collect()}
    assert set(hot) == set(plain) == {"hot", "small", None, "empty"}
    for k in ("hot", "small", None):
        assert hot[k] == pytest.approx(plain[k], rel=1e-12), k
    want = np.quantile([x for k, x in zip(keys, v) if k == "hot"], probs)
    assert hot["hot"] == pytest.approx(list(want), rel=1e-12)


def test_group_quantiles_divide_parts_again(spark):
    """Few parts and small ones, so that every bracket is divided more than once; heavy tails, ties and infinite ends."""
    rng = np.random.default_rng(8)
    v = {"tail": np.exp(rng.normal(0, 3, 3000)), "ties": rng.integers(0, 9, 3000) / 7, "near": 1e9 + rng.random(3000) * 1e-3,
         "ends": np.r_[-np.inf, rng.normal(0, 1, 500), np.inf, np.inf], "one": np.array([4.5])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs], "k string, v double").repartition(6)
    probs = [0.025, 0.31, 0.5, 0.975]
    got = {r["k"]: r["quantiles"] for r in R.group_quantiles(df, ["k"], "v", probs, slots=64, slot_values=20).where("k <> 'ends'").collect()}
    assert set(got) == {"tail", "ties", "near", "one"}
    for k, q in got.items():
        assert q == pytest.approx(list(np.quantile(v[k], probs)), rel=1e-12), k
    ends = R.group_quantiles(df.where("k = 'ends'"), [], "v", probs).first()["quantiles"]
    assert ends == pytest.approx(list(np.quantile(v["ends"], probs)), rel=1e-12)
    assert R.group_quantiles(df.where("false"), ["k"], "v", probs).count() == 0


def test_qq_points(spark):
    df = spark.createDataFrame([(float(x),) for x in [3, 1, 1, 2, 5]], "v double")
    got = sorted((r["rank"], r["sample"], r["theoretical"]) for r in R.qq_points(df, "v").collect())
    assert [g[:2] for g in got] == [(1, 1.0), (2, 1.0), (3, 2.0), (4, 3.0), (5, 5.0)]
    assert got[2][2] == pytest.approx(0.0, abs=1e-12)
    assert got[4][2] == pytest.approx(1.1797611, abs=1e-6)  # normal quantile of (5 - 3/8) / 5.25


def signed_rank_brute(d):
    d = [x for x in d if x]
    order = sorted(abs(x) for x in d)
    rank = {a: np.mean([i + 1 for i, b in enumerate(order) if b == a]) for a in order}
    v = sum(rank[abs(x)] for x in d if x > 0)
    sums = [sum(r for r, s in zip(range(1, len(d) + 1), signs) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    upper = np.mean([s >= v for s in sums])
    lower = np.mean([s <= v for s in sums])
    return v, min(1.0, 2 * min(upper, lower))


def test_signed_rank_exact(spark):
    d = [1.3, -0.4, 2.2, 0.9, -3.1, 0.2, 1.7, 4.0]
    df = spark.createDataFrame([("a", x) for x in d] + [("z", 0.0), ("z", 1.0), ("z", 1.0), ("z", -2.0)], "k string, diff double")
    got = {r["k"]: r for r in P.signed_rank(df, ["k"], buckets=3).collect()}
    v, p = signed_rank_brute(d)
    assert got["a"]["exact"] and got["a"]["v"] == v and got["a"]["p"] == pytest.approx(p, abs=1e-12)
    # a zero and a tie switch to the normal form: V = 1.5 + 1.5, one zero dropped
    z = got["z"]
    assert not z["exact"] and z["n"] == 3 and z["v"] == 3.0
    total = P.signed_rank(df.where("k = 'a'")).first()
    assert total["v"] == v


def test_paired_t_and_missing_pairs(spark):
    long = spark.createDataFrame([("1", "Before", 1.0), ("1", "After", 2.0), ("2", "Before", 2.0), ("2", "After", 2.5),
                                  ("3", "Before", 4.0), ("4", "Before", 1.0), ("4", "After", 4.0)],
                                 "fish string, part string, v double")
    pairs = RS.pair(long, ["fish"], "v")
    got = {r["fish"]: r["diff"] for r in pairs.collect()}
    assert got == {"1": -1.0, "2": -0.5, "3": None, "4": -3.0}
    t = P.paired_t(pairs).first()
    d = np.array([-1.0, -0.5, -3.0])
    assert t["n"] == 3 and t["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(3)))
    assert {r["fish"]: r["diff"] for r in RS.pair(long, ["fish"], "v", minus="Before").collect()}["1"] == 1.0


def test_shapiro(spark):
    # fixed values: worked example of the 1965 paper (weights of eleven men)
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("m", float(x)) for x in men] + [("two", 1.0), ("two", 2.0)] + [("flat", 1.0)] * 5,
                               "k string, diff double")
    got = {r["k"]: r for r in P.shapiro(df, ["k"]).collect()}
    assert got["m"]["w"] == pytest.approx(0.79, abs=5e-3) and got["m"]["p"] == pytest.approx(0.0067, abs=4e-4)
    assert got["two"]["w"] is None and got["flat"]["w"] is None
    three = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "diff double")
    row = P.shapiro(three).first()
    # n = 3 in closed form: W = (x3 - x1)^2 / 2 / SS
    w = 4.5 / np.sum((np.array([1, 2, 4]) - 7 / 3) ** 2)
    assert row["w"] == pytest.approx(w) and row["p"] == pytest.approx(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))


def test_shapiro_has_no_size_rule(spark):
    from shoalspark.functions.special import norm_ppf
    normal = norm_ppf((np.arange(1, 6001) - 0.5) / 6000)
    ties = np.round(normal * 3) / 3
    rows = [("n", float(x)) for x in normal] + [("t", float(x)) for x in ties] + [("s", float(x)) for x in normal[::2]]
    got = {r["k"]: r for r in P.shapiro(spark.createDataFrame(rows, "k string, diff double"), ["k"]).collect()}
    assert got["n"]["w"] > 0.9999 and got["n"]["extrapolated"] and not got["s"]["extrapolated"]
    m = norm_ppf((np.arange(1, 6001) - 0.375) / 6000.25)
    x = np.sort(ties) - ties.mean()
    assert got["t"]["w"] == pytest.approx((m @ x) ** 2 / (m @ m) / (x @ x), abs=2e-3) and got["t"]["p"] > 0


def test_normal_quantile_column_has_no_python_and_is_exact(spark):
    from shoalspark.functions.pvalues import normal_quantile
    from shoalspark.functions.special import norm_cdf, norm_ppf
    p = [0.0, 1e-300, 1e-12, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.9, 0.9999, 1 - 1e-12, 1.0]
    df = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
    got = {r["p"]: r["z"] for r in df.collect()}
    assert got[0.0] is None and got[1.0] is None
    for x in p[1:-1]:
        assert got[x] == pytest.approx(float(norm_ppf(x)), rel=1e-13, abs=1e-15)
    inner = np.array(p[2:-1])
    assert norm_cdf(norm_ppf(inner)) == pytest.approx(inner, rel=1e-12)


def test_duplicates_with_null_keys(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 1), ("f", "a", 1), ("f", "a", 2)], "fish string, treatment string, frame int")
    assert Q.duplicates(df).count() == 1 and Q.duplicate_rows(df).count() == 2


def test_pair_refuses_two_values_of_one_part(spark):
    df = spark.createDataFrame([("1", "Before", 1.0), ("1", "Before", 9.0), ("1", "After", 2.0)], "fish string, part string, v double")
    with pytest.raises(Exception, match="several values"):
        RS.pair(df, ["fish"], "v").collect()


def test_gated_picks_by_normality(spark):
    from shoalspark.functions.special import norm_ppf
    normal = [("n", float(x) + 0.3) for x in norm_ppf((np.arange(1, 31) - 0.5) / 30)]
    heavy = [("h", float(x)) for x in np.exp(np.linspace(-4, 6, 30))]
    df = spark.createDataFrame(normal + heavy, "k string, diff double")
    got = {r["k"]: r for r in P.gated_test(df, ["k"]).collect()}
    assert got["n"]["test"] == "paired t" and got["h"]["test"] == "signed rank"
    assert got["h"]["test_p"] == pytest.approx(2 * 0.5 ** 30)


def test_bootstrap_is_repeatable_and_centred(spark):
    df = spark.range(400).select("id", (F.col("id") % 17).cast("double").alias("v"), (F.col("id") % 20).alias("g"))
    a = SM.bootstrap(df, "v", reps=200, ids=["id"]).orderBy("rep").toPandas()
    b = SM.bootstrap(df.repartition(9), "v", reps=200, ids=["id"]).orderBy("rep").toPandas()
    assert np.allclose(a, b)
    assert len(a) == 200 and abs(a["mean"].mean() - 8.0) < 0.2 and abs(a["n"].mean() - 400) < 6
    c = SM.bootstrap(df, "v", reps=50, cluster=["g"]).toPandas()
    assert len(c) == 50 and c["n"].std() > a["n"].std()
    # with weights all one the moments equal the plain ones
    w = SM.poisson_weights(np.arange(1000), 300, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_moments(spark):
    v = np.array([1.0, 2.0, 4.0, 7.0, 7.5])
    row = SM.moments(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()
    n, d = len(v), v - v.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    g2 = (d**4).mean() / (d**2).mean() ** 2
    assert row["median"] == 4.0 and row["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (g2 - 3) + 6) + 3)


def test_histogram_edges(spark):
    beyond = spark.createDataFrame([(1.0,), (11.0,)], "v double")
    with pytest.raises(Exception, match="outside the bins"):
        SM.histogram(beyond, "v", 10, 0.0, 10.0).collect()
    df = spark.createDataFrame([(x,) for x in [0.0, 1.0, 1.0000000001, 2.0, 5.0, 10.0]], "v double")
    got = {r["bin"]: r["count"] for r in SM.histogram(df, "v", 10, 0.0, 10.0).collect()}
    assert got == {1: 3, 2: 1, 5: 1, 10: 1}
    flat = SM.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 5).collect()
    assert [(r["bin"], r["count"]) for r in flat] == [(1, 2)]


def test_reshape_helpers(spark):
    m = spark.createDataFrame([("a", [[0.1, 0.9], [0.4, 0.6]])], "k string, p array<array<double>>")
    long = {(r["from"], r["to"]): r["freq"] for r in RS.matrix_long(m, "p", ["k"]).collect()}
    assert long == {("state1", "state1"): 0.1, ("state1", "state2"): 0.9, ("state2", "state1"): 0.4, ("state2", "state2"): 0.6}
    lists = RS.explode_list(spark.createDataFrame([("s", [5.0, 6.0])], "s string, v array<double>"), "v").collect()
    assert [(r["draw"], r["v"]) for r in lists] == [(1, 5.0), (2, 6.0)]
    ent = spark.createDataFrame([("1",), ("2",), ("1",)], "fish string")
    grid = RS.cov_grid(ent, {"part": ["Before", "After"], "treatment": ["a", "b"]}, ["fish"])
    assert grid.count() == 8 and {r["cov_id"] for r in grid.collect()} == {1, 2, 3, 4}
    d = grid.withColumn("draw", F.lit(1)).withColumn("prob", F.col("cov_id") / 10).select("draw", "prob", "cov_id", "fish")
    joined = RS.attach_grid(d, grid, ["cov_id", "fish"])
    mean = {r["part"]: r["prob"] for r in RS.marginal_mean(joined, ["part"]).collect()}
    assert mean == pytest.approx({"Before": 0.15, "After": 0.35})


def test_center_lookup_real_minute(spark):
    df = spark.createDataFrame([("Before", 1), ("Before", 4), ("After", 11)], "part string, minute int")
    c = RS.center(df, "minute", ["part"])
    assert sorted(r["minute_centered"] for r in c.collect()) == [-1.5, 0.0, 1.5]
    own = RS.real_minute(RS.center(df, "minute", ["part"], mean="mean_minute").drop("minute"), ceil=True)
    assert sorted(r["minute"] for r in own.collect()) == [1, 4, 11]
    back = RS.real_minute(RS.add_lookup(c.drop("minute"), {"Before": 2.5}, "part", "mean_minute"), ceil=True)
    assert sorted((r["minute"] for r in back.collect()), key=str) == [1, 4, None]


def test_order_independence(frames_nulls):
    def run(df):
        cells = O.time_in_zone(E.enrich(df), ["fish", "treatment", "part"], "zone_side")
        return sorted(map(tuple, O.zone_share(cells, ["fish", "treatment", "part"], "zone_side").collect()), key=repr)

    assert run(frames_nulls.repartition(1)) == run(frames_nulls.repartition(17))
