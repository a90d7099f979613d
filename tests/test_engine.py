"""Definitions against pandas twins, invariants and edge cases."""

import itertools
import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import numeric
from factorloom.operators import backtest, expressions, factors, ic, linalg, models, rolling, sampling, scorecard, sessions, views
from factorloom.plans import workflows
from factorloom.sources import bars, reports, store

DAY0 = datetime(2020, 1, 1)


def made(spark, n=400, symbols=("A1", "b2", "C"), seed=1, gaps=True):
    """Bars of a few symbols, with gaps that end sessions."""
    rng, out = np.random.default_rng(seed), []
    for s in symbols:
        t = pd.Timestamp("2020-01-01")
        price = 100.0
        for k in range(n):
            t += pd.Timedelta(minutes=int(rng.choice([1, 2, 90], p=[0.9, 0.07, 0.03])) if gaps else 1)
            price *= float(np.exp(rng.normal(0, 0.01)))
            o, c = price * (1 + rng.normal(0, 0.002)), price
            out.append((s, t.to_pydatetime(), o, max(o, c) * 1.001, min(o, c) * 0.999, c, float(rng.integers(0, 50)), float(rng.integers(0, 5000)), float(rng.integers(0, 900))))
    return spark.createDataFrame(out, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, amount double, oi double")


@pytest.fixture(scope="module")
def frame(spark):
    return factors.base_series(sessions.labels(sessions.sessions(made(spark)), 5, 10)).persist()


def test_ic_signs(spark):
    df = spark.createDataFrame([(float(i), -float(i), 1.0, (-1.0) ** i) for i in range(1, 5)], "y double, m double, one double, alt double")
    a, b, c = df.agg(ic.cosine_ic("y", "y"), ic.cosine_ic("m", "y"), ic.cosine_ic("alt", "one")).first()
    assert a > 0.999 and b < -0.999 and abs(c) < 1e-12
    assert df.limit(1).agg(ic.cosine_ic("y", "y").alias("x")).first().x is None
    assert df.agg(ic.pearson("one", "y").alias("x")).first().x is None


def test_factor_spec():
    s = store.FactorSpec.of(["mom_2", "tsz_bop", "csz_macd_3_13", "csr_cpos", ""])
    assert (len(s.names), s.raw, s.tsz, s.csz, s.csr) == (4, ("mom_2",), ("bop",), ("macd_3_13",), ("cpos",))
    assert s.subset(None) is s and s.subset([]).names == () and s.subset(["csr_cpos", "x"]).names == ("csr_cpos",)
    assert s.bases() == ["mom_2", "tsz_bop", "macd_3_13", "cpos"]


def test_library_size():
    names = factors.names()
    assert len(names) == len(set(names)) == 1034
    oi = [n for n in names if "oi" in n and ("oi_" in n or "oimom" in n or "oiz" in n or "oipx" in n)]
    assert len(names) - len(oi) == 946


def test_sessions_by_loop(spark):
    df = sessions.labels(sessions.sessions(made(spark, 150)), 4, 6).toPandas().sort_values(["symbol", "datetime"])
    for _, g in df.groupby("symbol"):
        g = g.reset_index(drop=True)
        gap = g.datetime.diff().dt.total_seconds().fillna(0) / 60
        brk = gap >= 60
        sid, count, want = 0, 0, []
        for i in range(len(g)):
            sid += bool(brk[i])
            count = 0 if brk[i] else count + 1
            want.append((sid, count))
        assert list(zip(g.session_id, g.bss)) == want
        for i in range(len(g)):
            j = i + 4
            ok = j < len(g) and g.session_id[j] == g.session_id[i] and not brk[i + 1 : i + 7].any()
            assert (g.label[i] is not None and not math.isnan(g.label[i])) == ok
            if ok:
                assert abs(g.label[i] - (g.close[j] / g.close[i] - 1)) < 1e-12


def test_factors_by_pandas(spark, frame):
    names = ["mom_5", "sharpe_8", "rv_13", "skew_6", "kurt_8", "bollz_10", "pvcorr_13", "ret_ac2_8", "stoch_dev_8", "ema_diff_3_13", "macd_5_21", "mom_13_lag3", "drawdn_8", "volz_21_lag1"]
    got = factors.add_factors(frame, names).toPandas().sort_values(["symbol", "datetime"])
    for _, g in got.groupby("symbol"):
        g = g.reset_index(drop=True)
        lr, c, lv = g.s_lr, g.close, g.s_logv
        st = (c - g.low.rolling(8).min()) / (g.high.rolling(8).max() - g.low.rolling(8).min() + 1e-9)
        ema = lambda s: c.ewm(span=s, adjust=False).mean()
        d = ema(5) - ema(21)
        z = lambda s, w: (s - s.rolling(w).mean()) / (s.rolling(w).std() + 1e-9)
        m = lambda s, w: s.where(g.bss >= w)
        want = {
            "mom_5": m(lr.rolling(5).sum(), 5), "sharpe_8": m(lr.rolling(8).mean() / (lr.rolling(8).std() + 1e-9), 8), "rv_13": m((lr**2).rolling(13).sum() ** 0.5, 13), "skew_6": m(lr.rolling(6).skew(), 6),
            "kurt_8": m(lr.rolling(8).kurt(), 8), "bollz_10": m(z(c, 10), 10), "pvcorr_13": m(lr.rolling(13).corr(lv), 13), "ret_ac2_8": m(lr.rolling(8).corr(lr.shift(2)), 8), "stoch_dev_8": m(st - st.rolling(5, min_periods=3).mean(), 8),
            "ema_diff_3_13": m((ema(3) - ema(13)) / (c.abs() + 1e-9), 13), "macd_5_21": m((d - d.shift(1)) / (c.abs() + 1e-9), 21), "mom_13_lag3": m(lr.rolling(13).sum(), 13).shift(3).where(g.bss >= 3),
            "drawdn_8": m(c / (c.rolling(8).max() + 1e-9) - 1, 8), "volz_21_lag1": m(z(lv, 21), 21).shift(1).where(g.bss >= 1),
        }
        for n in names:
            np.testing.assert_allclose(g[n].astype(float), want[n], rtol=1e-6, atol=1e-8, err_msg=n)


def test_every_factor_plans(frame):
    """All names resolve, and none is known before its window is full."""
    names = [n for n in factors.names() if not any(w in n for w in ("_144", "_180", "_233", "_288", "_120", "_89", "_72"))]
    some = names[:: len(names) // 60]
    out = factors.add_factors(frame, some)
    checks = []
    for n in some:
        f, ws = factors.split_name(n)
        if ws and "lag" not in n and n not in factors.UNMASKED:
            checks.append(F.count_if((F.col("bss") < max(ws)) & F.col(n).isNotNull()).alias(n))
    assert not any(out.agg(*checks).first())


def test_one_exchange(spark):
    """From bars to factors one exchange by symbol: sessions, labels, base series and all windows share it."""
    df = factors.base_series(sessions.labels(sessions.sessions(made(spark, 50))))
    plan = factors.add_factors(df, ["mom_5", "sharpe_8", "bollz_10", "pvcorr_13"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_constant_window(spark):
    rows = [("A", DAY0 + timedelta(minutes=i), *(5.0,) * 4, 1.0, 5.0, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, bars_schema())
    out = factors.add_factors(factors.base_series(sessions.sessions(df)), ["skew_6", "kurt_6", "pvcorr_6", "bollz_6", "rsi_6"]).toPandas().iloc[-1]
    assert out.skew_6 == 0 and out.kurt_6 == -3 and math.isnan(out.pvcorr_6) and abs(out.bollz_6) < 1e-3 and out.rsi_6 == 0


def bars_schema():
    return "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, amount double, oi double"


def test_nulls_and_zero_close(spark):
    t = DAY0
    rows = [("A", t + timedelta(minutes=i), None if i == 3 else 1.0, 2.0, 0.5, 0.0 if i == 5 else float("nan") if i == 7 else 1.5, None, None, None) for i in range(20)]
    df = factors.base_series(sessions.labels(sessions.sessions(spark.createDataFrame(rows, bars_schema())), 3, 3))
    names = ["mom_4", "roc_4", "bollz_4", "volz_4", "oiz_4", "mfi_4", "vwap_dev", "oi_chg", "px_sma_4"]
    out = factors.add_factors(df, names).select(*names, "label").toPandas()
    assert not np.isinf(out.to_numpy(dtype=float)).any() and len(out) == 20
    assert factors.add_factors(df.limit(0), names).count() == 0


def test_long_windows(spark, frame):
    for w in (2, 7, 21, 64, 89):
        m = ["mean:s_lr", "mean:s_logv", "co:s_lr,s_lr", "co:s_lr,s_logv", "max:s_c", "min:s_c"]
        got = rolling.long_windows(frame, [w], m).toPandas().sort_values(["symbol", "datetime"])
        for _, g in got.groupby("symbol"):
            r = g.s_lr.rolling(w)
            np.testing.assert_allclose(g[f"mean_s_lr_{w}"].astype(float), r.mean(), atol=1e-12)
            np.testing.assert_allclose(g[f"co_s_lr_s_logv_{w}"].astype(float), r.cov(g.s_logv) * (w - 1), atol=1e-9)
            np.testing.assert_allclose(g[f"max_s_c_{w}"].astype(float), g.s_c.rolling(w).max())


def test_chunks_change_nothing(spark):
    b = made(spark, 300)
    names = ["mom_21", "volz_13", "rsi_21"]
    whole = factors.add_factors(factors.base_series(sessions.sessions(b)), names)
    keys = ("symbol", "chunk")
    cut = factors.add_factors(factors.base_series(sessions.sessions(bars.in_chunks(b, 50, 40), keys=keys), keys), names, keys).where(~F.col("is_halo"))
    a, c = (x.select("symbol", "datetime", *names).toPandas().sort_values(["symbol", "datetime"]) for x in (whole, cut))
    np.testing.assert_allclose(a[names].astype(float), c[names].astype(float), atol=1e-9)
    e = factors.ema_in_chunks(bars.in_chunks(b, 37, 1), "close", 21, "e").toPandas().sort_values(["symbol", "datetime"])
    for _, g in e.groupby("symbol"):
        np.testing.assert_allclose(g.e, g.close.ewm(span=21, adjust=False).mean(), rtol=1e-9)


def test_views_edges(spark):
    t = DAY0
    rows = [(t, "a", 1.0), (t, "b", 1.0), (t, "c", 3.0), (t, "d", None), (t + timedelta(days=1), "a", 7.0), (t + timedelta(days=2), "a", 2.0), (t + timedelta(days=2), "b", 2.0)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, symbol string, x double")
    got = {(r.datetime.day, r.symbol): (r.z, r.r) for r in df.select("*", views.xzscore("x").alias("z"), views.xrank("x").alias("r")).collect()}
    assert got[(1, "a")][1] == got[(1, "b")][1] == pytest.approx(0) and got[(1, "c")][1] == 0.5 and got[(1, "d")] == (None, None)
    assert got[(2, "a")] == (None, 0.5) and got[(3, "a")][0] == 0
    assert [r.p for r in spark.createDataFrame([("rb2010",), ("7x",), ("",)], "s string").select(views.product_code("s").alias("p")).collect()] == ["RB", "7X", ""]


def test_regimes_like_qcut(spark):
    rng = random.Random(3)
    t = DAY0
    for n in (5, 32, 200):
        rows = [("A", t + timedelta(minutes=i), 1.0, 2.0, 1.0, 1.5, float(rng.randrange(20)) if i % 9 else None, 1.0, 1.0) for i in range(n)]
        got = views.regimes(spark.createDataFrame(rows, bars_schema())).orderBy("datetime").toPandas()
        want = pd.qcut(pd.Series([r[6] for r in rows]).rank(method="first"), 3, labels=["low_liq", "mid_liq", "high_liq"]).astype(str)
        assert list(got.liquidity) == list(want)


def test_gate_is_shut_for_missing(spark):
    t = DAY0
    df = spark.createDataFrame([(t, "a", 1.0, None), (t, "b", 2.0, 5.0), (t, "c", 3.0, 1.0)], "datetime timestamp_ntz, symbol string, x double, y double")
    e = expressions.make_expression("rank_gate_pos", "x", "y")
    got = {r.symbol: r[e["name"]] for r in expressions.evaluate(df, [e]).collect()}
    assert got["a"] == 0 and got["b"] == pytest.approx(2 / 3 - 0.5) and got["c"] == 0.0
    with pytest.raises(ValueError):
        expressions.make_expression("nope", "x", "y")


def relaxing(scores, most):
    """The cap that relaxes, literally."""
    picked, counts = [], {}
    for cap in range(1, max(2, most) + 1):
        for i, (f, g) in enumerate(scores):
            if i in picked or counts.get(g, 0) >= cap:
                continue
            picked.append(i)
            counts[g] = counts.get(g, 0) + 1
            if len(picked) >= most:
                return [scores[i][0] for i in picked]
    return [scores[i][0] for i in picked]


def test_seeds_and_pairs(spark):
    rng = random.Random(5)
    rows = [(f"f{i}", rng.uniform(-1, 1), rng.uniform(-1, 1), rng.choice("abcd"), rng.choice(["raw", "csz"])) for i in range(60)]
    df = spark.createDataFrame(rows, "factor string, is_ic double, oos_ic double, family string, view string")
    ordered = sorted(rows, key=lambda r: (np.sign(r[1]) != np.sign(r[2]), -abs(r[1]), r[0]))
    want = relaxing([(r[0], f"{r[3]}:{r[4]}") for r in ordered], 25)
    got = [r.factor for r in expressions.seeds(df, 25).orderBy("place").collect()]
    assert got == want
    info = {r[0]: (r[3], r[4]) for r in rows}
    chosen = [(f, *info[f]) for f in got]
    out = expressions.pairs(chosen, 40)
    assert len(out) == len(set(out)) <= 40 and all(a != b for a, b in out)
    literal, n = [], 0
    for i, (a, *ga) in enumerate(chosen):
        for j in range(i + 1, min(len(chosen), i + 18)):
            if n < 40:
                literal.append((a, chosen[j][0]))
                n += 1
        if n >= 40:
            break
        for j in range(len(chosen) - 1, max(i, len(chosen) - 20), -1):
            if ga != list(chosen[j][1:]):
                literal.append((a, chosen[j][0]))
                n += 1
                break
        if n >= 40:
            break
    assert out == list(dict.fromkeys(literal))[:40]
    six = [(f, *info[f]) for f in (r.factor for r in expressions.seeds(df, 6).orderBy("place").collect())]
    assert expressions.candidates(df, 6, 9).count() == len(expressions.pairs(six, 9)) * len(expressions.OPS)


def test_stats_merge(spark, frame):
    df = factors.add_factors(frame, ["mom_5", "cpos"]).withColumn("month", F.concat(F.lit("2020-0"), (F.dayofmonth("datetime") % 3 + 1).cast("string")))
    parts = ic.merge_stats(ic.sufficient_stats(df, ["mom_5", "cpos"])).orderBy("factor").collect()
    whole = ic.merge_stats(ic.sufficient_stats(df.withColumn("month", F.lit("x")), ["mom_5", "cpos"])).orderBy("factor").collect()
    for a, b in zip(parts, whole):
        assert a.factor == b.factor and a.n == b.n and a.ic == pytest.approx(b.ic)
    assert max(r.coverage_proxy for r in parts) == 1


def test_correlations_count_all_rows(spark):
    df = spark.createDataFrame([(float(i), float(2 * i) if i % 2 else None, 1.0) for i in range(20)], "x double, y double, k double")
    m = linalg.correlations(df, ["x"], ["x", "y", "k"])
    assert m[0, 0] == pytest.approx(1) and 0.3 < m[0, 1] < 0.6 and m[0, 2] == 0


def test_gram_wide_equals_narrow(spark):
    cols = [f"c{i}" for i in range(70)]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 70))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols)).repartition(3)
    g, s, n = linalg.gram(df, cols)
    np.testing.assert_allclose(g, x.T @ x, atol=1e-9)
    np.testing.assert_allclose(s, x.sum(0), atol=1e-9)
    assert n == 50


def test_ridge_and_leave_one_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = x @ [1.0, -0.5, 0.0, 0.2] + rng.normal(0, 0.5, 600)
    t0 = DAY0
    df = spark.createDataFrame([(t0 + timedelta(days=i // 6), f"s{i % 6}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "datetime timestamp_ntz, symbol string, a double, b double, c double, d double, label double")
    names = list("abcd")
    m = models.fit_ridge(df, names, 0.3)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z / 600 + 0.3 * np.eye(4), z.T @ (y - y.mean()) / 600)
    np.testing.assert_allclose(m.weights, w, atol=1e-9)
    loo = {r.factor: r.drop_ic for r in models.leave_one_out(df, m).collect()}
    for f in names:
        rest = models.fit_ridge(df, [n for n in names if n != f], 0.3)
        refit = backtest.pred_xsz_ic(df.withColumn("p", rest.predict()), ["p"]).first().ic
        assert loo[f] == pytest.approx(refit, abs=1e-9)
    assert set(models.fit_ridge(df, names, 0.3, top_k=2).features) == {"a", "b"}
    assert models.fit_ridge(df.limit(0), names).weights.tolist() == [0] * 4


def test_losses_have_their_gradients():
    rng = np.random.default_rng(4)
    p, y, w = rng.normal(size=12), rng.normal(size=12), rng.uniform(0.5, 2, 12)
    for kind in ("mse", "huber", "corr_mse"):
        g = models.loss_gradient(p, y, w, kind)
        for i in range(12):
            d = np.zeros(12)
            d[i] = 1e-6
            assert g[i] == pytest.approx((models.loss(p + d, y, w, kind) - models.loss(p - d, y, w, kind)) / 2e-6, abs=1e-6)


def test_network_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = x[:, 0] - 0.5 * x[:, 1]
    net = models.Net(["a", "b", "c"], models.NetConfig(hidden=16, epochs=30, rate=5e-3, dropout=0.0, batch=128)).train(x, y)
    pred = net.forward((x - net.mean) / net.std)[0]
    assert np.corrcoef(pred, y)[0, 1] > 0.95
    q = models.Net(["a", "b", "c"], models.NetConfig(hidden=4, dropout=0.0))
    p, kept = q.forward(x[:5])
    g = q.backward(kept, models.loss_gradient(p, y[:5], np.ones(5)))
    for k in q.p:
        at = tuple(0 for _ in q.p[k].shape)
        base = q.p[k][at]
        q.p[k][at] = base + 1e-6
        up = models.loss(q.forward(x[:5])[0], y[:5], np.ones(5))
        q.p[k][at] = base - 1e-6
        down = models.loss(q.forward(x[:5])[0], y[:5], np.ones(5))
        q.p[k][at] = base
        assert g[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_greedy_pick(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 3))
    x = np.column_stack([base[:, 0], base[:, 0] + 0.01 * base[:, 1], base[:, 1], base[:, 2], -base[:, 2]])
    names = list("vwxyz")
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    card = {k: 0.5 for k in ("coverage", "rank_ic", "monthly_ic_hit_rate", "product_ic_hit_rate", "liquidity_regime_ic_hit_rate", "volatility_regime_ic_hit_rate", "bucket_monotonicity", "max_abs_corr_to_library", "turnover_proxy")}
    rows = [{"name": n, **card, "coverage": 1.0, "std": 1.0, "outlier_ratio": 0.0, "monthly_ic_count": 9.0, "selection_ic": 0.1 - 0.01 * i, "bucket_top_bottom_spread": 1.0, "residual_ic": 0.0, "same_sign": True} for i, n in enumerate(names)]
    cards = scorecard.judged(spark.createDataFrame(pd.DataFrame(rows)))
    assert cards.where("decision_reason = 'pass_all'").count() == 5
    out = {r.name: r for r in scorecard.select_unlike(cards, df, {n: "op" for n in names}, 3, max_per_op=9).collect()}
    assert [n for n in names if out[n].selected] == ["v", "x", "y"] and out["w"].candidate_peer_max_abs_corr > 0.99
    assert "fail_incremental" in out["w"].decision_reason
    two = scorecard.select_unlike(cards, df, {n: "op" for n in names}, 3, max_per_op=1).where("selected").count()
    assert two == 1


def test_strict_compat_zero(spark):
    row = {"name": "a", "coverage": 1.0, "std": 1.0, "outlier_ratio": 0.0, "selection_ic": 0.1, "rank_ic": 0.1, "monthly_ic_hit_rate": 0.6, "monthly_ic_count": 9.0, "bucket_top_bottom_spread": 1.0, "bucket_monotonicity": 0.9, "product_ic_hit_rate": 0.9, "liquidity_regime_ic_hit_rate": 0.9, "volatility_regime_ic_hit_rate": 0.9, "turnover_proxy": 0.1, "max_abs_corr_to_library": 0.0, "residual_ic": 0.0, "same_sign": True}
    df = spark.createDataFrame(pd.DataFrame([row]))
    assert scorecard.judged(df).first().final_grade == "A"
    compat = scorecard.judged(df, strict_compat=True).first()
    assert compat.final_grade == "E" and not compat.pass_data_quality and not compat.pass_incremental


def test_samples(spark, frame):
    df = views.event_scores(frame.withColumn("month", F.lit("2020-01")))
    pool = df.where("label is not null and label_xrank is not null").count()
    for mode in ("random", "stratified", "soft_event", "event50"):
        a, b = (sampling.sample_training(x, 60, mode, 3).select("symbol", "datetime").orderBy("symbol", "datetime").collect() for x in (df, df.repartition(5)))
        assert a == b and len(set(a)) == 60 <= pool
    assert sampling.sample_training(df, 10**6, "random", 3).count() == pool
    with pytest.raises(ValueError):
        sampling.sample_training(df, 5, "odd")
    times = sampling.sample_times(df, 9, 1)
    full = df.groupBy("datetime").count().join(times.groupBy("datetime").agg(F.count("*").alias("n")), "datetime")
    assert full.where("count <> n").count() == 0


def test_backtest_empty_and_small(spark):
    t = DAY0
    df = spark.createDataFrame([(t, float(i), float(i)) for i in range(5)], "datetime timestamp_ntz, pred double, label double")
    assert backtest.long_short(df, "pred").count() == 0
    one = backtest.long_short(views.prediction_views(df)).first()
    assert one.ls_return == pytest.approx(4 - 0.5 * 0) or one.ls_return > 0
    s = backtest.summarize(backtest.long_short(df, "pred")).first()
    assert s["rows"] == 0 and s["mean"] is None and s["tstat"] is None


def test_store_and_files(spark, tmp_path):
    conf = store.Config.load(json.dumps({"panel": str(tmp_path / "p"), "excluded": ["C"], "horizon": 5}))
    assert conf.excluded == ("C",) and store.Config.from_mapping({}).horizon == 30
    with pytest.raises(ValueError):
        store.Config.from_mapping({"x": 1})
    spec = store.FactorSpec.of(["mom_5", "csr_cpos", "tsz_mom_5"])
    workflows.build_partitions(spark, made(spark, 120), conf, spec)
    st = store.FactorStore(spark, conf.panel, spec)
    assert st.months() == ["2020-01"] and st.read(columns=["mom_5"], symbols=["A1"]).select("symbol").distinct().count() == 1
    assert "C" not in {r.symbol for r in st.scan().select("symbol").distinct().collect()}
    a = workflows.audit_data(st, conf).first()
    assert a.symbols == 2 and a["rows"] == 240 and a.n_tsz == 1
    early = store.FactorStore(spark, conf.panel, spec, filter_first=True).read(columns=["csr_cpos"], symbols=["A1"])
    assert {r.csr_cpos for r in early.where("csr_cpos is not null").select("csr_cpos").distinct().collect()} == {0.5}
    store.write_list(spark, str(tmp_path / "l"), ["b", "a"])
    assert store.read_list(spark, str(tmp_path / "l")) == ["b", "a"]
    table = expressions.expression_table(spark, [expressions.make_expression("z_add", "mom_5", "cpos")])
    reports.write_csv(table, str(tmp_path / "e"))
    assert expressions.load_expressions(spark, str(tmp_path / "e")).collect() == table.collect()
    assert "| mom_5 |" in reports.report("t", {"x": table.select("left")})
    assert store.dependencies(["nf", "k"], [{"name": "nf", "op": "z_add", "left": "a", "right": "b"}]) == ["a", "b", "k"]


def test_score_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("factor,is_ic,oos_ic\na,0.1,-0.2\nb,0.3,\n")
    got = {r.name: r for r in store.load_ic_scores(spark, str(tmp_path / "s.csv")).collect()}
    assert got["a"].same_sign is False and got["a"].abs_oos_ic == 0.2 and got["b"].oos_ic is None and got["b"].abs_is_ic == 0.3
    (tmp_path / "m.csv").write_text("set,path\nall,x.txt\n")
    assert store.load_manifest(spark, str(tmp_path / "m.csv")) == [{"set": "all", "path": "x.txt"}]
    with pytest.raises(ValueError):
        store.load_manifest(spark, str(tmp_path / "s.csv"))
    (tmp_path / "b.json").write_text('{"rows": 3, "mean": 0.5}')
    assert [tuple(r) for r in store.load_backtests(spark, {"r": str(tmp_path / "b.json"), "none": str(tmp_path / "x")}).select("name", "rows").collect()] == [("r", 3)]


def test_commands(spark, tmp_path):
    from factorloom import __main__ as cli

    raw = tmp_path / "raw"
    raw.mkdir()
    for s, g in made(spark, 200, ("aa1", "bb2", "cc3", "dd4")).toPandas().groupby("symbol"):
        g.assign(datetime=g.datetime.dt.strftime("%Y-%m-%d %H:%M")).drop(columns="symbol").to_csv(raw / f"{s}.csv", index=False)
    (tmp_path / "c.json").write_text(json.dumps({"panel": str(tmp_path / "panel"), "output": str(tmp_path / "out"), "horizon": 5, "is_start": "2020-01", "is_end": "2020-01", "oos_start": "2020-01", "oos_end": "2020-01"}))
    (tmp_path / "f.txt").write_text("mom_5\ncsr_cpos\ncsz_rv_5\n")
    base = ["--config", str(tmp_path / "c.json"), "--factors", str(tmp_path / "f.txt")]
    do = lambda *a: cli.run(spark, cli.parser().parse_args([*base, *a]))
    assert do("build-partitions", "--raw", str(raw)) == {}
    assert do("build-partitions", "--raw", str(raw)) == {}  # what is there stays
    assert do("audit-data")["audit"].first().symbols == 4
    assert do("mine-factors")["factor_scores"].count() == 3
    got = do("run-all", "--skip-trees")
    assert {"audit", "factor_scores", "baseline_summary", "baseline_backtest", "incremental"} <= set(got)
    cli.main([*base, "audit-data"])
    reports.write_predictions(got["baseline_predictions"], str(tmp_path / "p"))
    assert do("backtest", "--predictions", str(tmp_path / "p"), "--pred-col", "pred")["backtest"].count() == 1
    do("materialize-final", "--path", str(tmp_path / "final"))
    assert spark.read.parquet(str(tmp_path / "final")).count() == 800
    do("materialize-final", "--path", str(tmp_path / "none"), "--start", "2020-02", "--end", "2020-03")
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
    (tmp_path / "one.txt").write_text("mom_5\n")
    cli.main([*base, "baseline", "--feature-file", str(tmp_path / "one.txt")])
    told = do("report")
    assert {"audit", "baseline_summary", "baseline_backtest", "figure_monthly_ic", "figure_cumulated_return", "figure_ic_by_model"} <= set(told)
    assert all(told[k].count() > 0 for k in ("audit", "baseline_summary", "figure_monthly_ic", "figure_ic_by_model"))
    assert set(do("baseline", "--feature-file", str(tmp_path / "one.txt"), "--name", "few")) == {"few_predictions", "few_summary", "few_backtest"}


def test_csv_bars(spark, tmp_path):
    (tmp_path / "RB1.csv").write_text("Date Time,OPEN,high,low,close,volume,Position\n2020-01-01 09:01:30,1,2,x,1.5,10,7\n2020-01-01 09:01:59,9,9,9,9,9,9\nbad,1,1,1,1,1,1\n2020-01-01 09:02:00,,2,1,1.5,2,\n")
    (tmp_path / "ZZ.csv").write_text("Date Time,OPEN,high,low,close,volume,Position\n2020-01-01 09:01:00,1,2,1,1.5,10,7\n")
    got = bars.read_csv(spark, str(tmp_path), ["Date Time", "OPEN", "high", "low", "close", "volume", "Position"], ["ZZ"]).orderBy("datetime").collect()
    assert [(r.symbol, r.open, r.low, r.amount, r.oi) for r in got] == [("RB1", 1.0, None, 15.0, 7.0), ("RB1", None, 1.0, 3.0, None)]


def test_numeric_rules(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    got = df.select(numeric.finite("x"), numeric.zero("x"), numeric.at_least(numeric.finite("x"), 2), numeric.clamp01("x"), numeric.sdiv(F.col("x"), F.lit(0.0))).collect()
    assert [tuple(r) for r in got[:1]] == [(1.0, 1.0, 2.0, 1.0, None)]
    assert all(tuple(r)[:4] == (None, 0.0, None, 0.0) for r in got[1:])


def test_final_panel_prunes_by_time(spark, tmp_path, frame):
    path = str(tmp_path / "final")
    store.write_final(frame.select("symbol", "datetime", "label"), path)
    df = store.FactorStore(spark, path, store.FactorSpec.of([])).scan("2017-01", "2019-12")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(datetime,2017-01-01" in pushed and "LessThan(datetime,2020-01-01" in pushed


def test_panel_in_chunks(spark):
    """All kinds of factors over a symbol that has half of the rows: chunks and Arrow batches give what whole series give."""
    df = made(spark, 1500, ("aa1",)).unionByName(made(spark, 500, ("bb2", "cc3", "dd4")))
    names = ["mom_5", "rv_21", "px_sma_233", "ema_diff_3_13", "macd_21_180", "vwap_macd_5_55", "stoch_dev_55", "mom_13_lag5", "cpos", "oi_chg", "vol_regime", "rsi_21", "pvcorr_34", "mom_288"]
    labelled = sessions.labels(sessions.sessions(df))
    want = factors.add_factors(factors.base_series(labelled), names).select("symbol", "datetime", *names).toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)
    for wide in (1, 10**6):
        got = workflows.with_factors(labelled, names, chunk_rows=450, wide_from=wide).select("symbol", "datetime", *names).toPandas().sort_values(["symbol", "datetime"]).reset_index(drop=True)
        assert len(got) == len(want) == 3000
        for n in names:
            np.testing.assert_allclose(got[n].astype(float), want[n].astype(float), rtol=1e-6, atol=1e-9, err_msg=n)


def test_wide_sums(spark, frame, monkeypatch):
    from factorloom.operators import ic

    df = factors.add_factors(frame, ["mom_5", "rv_21", "cpos"]).withColumn("month", F.date_format("datetime", "yyyy-MM")).withColumn("none", F.lit(None).cast("double"))
    rows = lambda: {(r.month, r.factor): tuple(r[k] for k in ("xy", "xx", "yy", "count")) for r in ic.sufficient_stats(df, ["mom_5", "rv_21", "cpos", "none"]).collect()}
    want = rows()
    monkeypatch.setattr(ic, "WIDE", 2)
    got = rows()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9) if want[k][3] else got[k] == want[k]


def test_wide_models(spark):
    """Many features: leave-one-out and scoring by matrix products equal refits and sums."""
    rng = np.random.default_rng(3)
    k, n = 80, 800
    x = rng.normal(size=(n, k))
    y = x[:, 0] - x[:, 1] * 0.5 + rng.normal(size=n)
    cols = [f"f{i}" for i in range(k)]
    import pandas as pd

    pdf = pd.DataFrame(x, columns=cols).assign(label=y, symbol=[f"s{i % 8}" for i in range(n)], datetime=[DAY0 + timedelta(days=i // 8) for i in range(n)])
    df = spark.createDataFrame(pdf).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    m = models.fit_ridge(df, cols)
    got = {r.factor: r for r in models.leave_one_out(df, m).collect()}
    assert len(got) == k and got["f0"].delta > 0.05
    rest = models.fit_ridge(df, cols[1:])
    assert got["f0"].drop_ic == pytest.approx(backtest.pred_xsz_ic(df.withColumn("p", rest.predict()), ["p"]).first().ic, abs=1e-9)
    scored = df.select("f0", m.predict().alias("p")).orderBy("f0").toPandas()["p"].to_numpy()
    z = (x - m.mean) / m.std
    np.testing.assert_allclose(scored, (m.intercept + z @ m.weights)[np.argsort(x[:, 0])], atol=1e-9)


def test_entry_without_a_package(monkeypatch):
    """Where a package of the training-data queries is missing, the others are still there."""
    import sys

    import __spark_entry__ as entry

    for name in [x for x in sys.modules if x.startswith("factorloom.llm") or x == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    names = entry.queries()
    assert "ic_monthly_momentum" in names and not any(x.startswith("op1") for x in names)


def test_mining_loop_raises(spark, frame):
    df = factors.add_factors(frame, ["mom_5", "cpos", "volz_6"]).withColumn("month", F.lit("2017-01"))
    scores = spark.createDataFrame([("mom_5", 0.1, 0.1), ("cpos", 0.2, 0.1), ("volz_6", 0.05, -0.1)], "factor string, is_ic double, oos_ic double")
    with pytest.raises(RuntimeError):
        workflows.mine_expressions(df, scores, ["cpos"], store.Config(), target=500, rounds=1, max_pairs=1)


def test_intersection_of_tests(spark):
    a, b = (spark.createDataFrame(r, "factor string, delta double") for r in ([("x", 1.0), ("y", -1.0)], [("x", 1.0), ("y", 1.0)]))
    assert [r.factor for r in workflows.retained_by_all([a, b]).collect()] == ["x"]
    assert workflows.prefilter_size(10) == 30_000 and workflows.scorecard_size(1000, 40_000) == 25_000


def test_names_agree(spark):
    rows = [("z_add", a, b) for a, b in itertools.permutations(["p", "q", "r"], 2)]
    df = spark.createDataFrame(rows, "op string, left string, right string").withColumn("n", expressions.name_column())
    assert all(r.n == expressions.safe_name(r.op, r.left, r.right) for r in df.collect())
