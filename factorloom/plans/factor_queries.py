"""One query for each family of the factor library over daily bars, with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors
from . import frames
from .sqlbase import DAY_FRAME, WS, corr, ema, lag, low, masked, mean, r6, shape, std, top, total, xrank, z  # noqa: F401

LN2X4 = repr(4 * math.log(2))
SIZE = "(abs(close) + 1e-9)"


def rel(a: str, b: str) -> str:
    return f"(({a} - {b}) / ({a} + {b} + 1e-9))"


def root(e: str) -> str:
    return f"sqrt({e})"


def span(w: int) -> str:
    return f"({top('high', w)} - {low('low', w)} + 1e-9)"


def stoch(w: int) -> str:
    return f"((close - {low('low', w)}) / {span(w)})"


def thrust(w: int) -> str:
    return f"greatest({top('high', w)} - {low('close', w)}, {top('close', w)} - {low('low', w)})"


#: inventory row: (family, windows, SQL of one window). The windows are few; the library has them all.
BY_WINDOW = {
    "t01": ("mom", (5, 21), lambda w: total("lr", w)),
    "t02": ("sharpe", (5, 21), lambda w: f"({mean('lr', w)} / ({std('lr', w)} + 1e-9))"),
    "t03": ("upratio", (5, 21), lambda w: mean("isup", w)),
    "t04": ("maxret", (5, 21), lambda w: top("lr", w)),
    "t05": ("minret", (5, 21), lambda w: low("lr", w)),
    "t06": ("px_sma", (6, 21), lambda w: f"(close / nullif({mean('close', w)} + 1e-9, 0) - 1)"),
    "t07": ("roc", (6, 21), lambda w: f"(close / nullif({lag('close', w)}, 0) - 1)"),
    "t11": ("rv", (5, 21), lambda w: root(total("lrsq", w))),
    "t12": ("park", (5, 21), lambda w: root(f"{total('loghl2', w)} / ({LN2X4} * {w})")),
    "t13": ("dvol", (6, 21), lambda w: root(total("neg2", w))),
    "t14": ("volskew", (6, 21), lambda w: rel(root(total("pos2", w)), root(total("neg2", w)))),
    "t15": ("skew", (6, 21), lambda w: shape("skewness", "lr", w, "0.0")),
    "t16": ("kurt", (6, 21), lambda w: shape("kurtosis", "lr", w, "-3.0")),
    "t17": ("atr", (6, 21), lambda w: f"({mean('tr', w)} / {SIZE})"),
    "t18": ("range", (6, 21), lambda w: mean("rngc", w)),
    "t20": ("stoch", (6, 21), stoch),
    "t21": ("willr", (6, 21), lambda w: f"(({top('high', w)} - close) / {span(w)})"),
    "t23": ("rsi", (6, 21), lambda w: f"(100 - 100 / (1 + {mean('up', w)} / ({mean('dn', w)} + 1e-9)))"),
    "t24": ("cci", (6, 21), lambda w: f"((typ - {mean('typ', w)}) / (0.015 * 0.8 * {std('typ', w)} + 1e-9))"),
    "t25": ("bollz", (6, 21), lambda w: z("close", w)),
    "t26": ("cmo", (6, 21), lambda w: rel(total("up", w), total("dn", w))),
    "t27": ("ret_ac1", (6, 21), lambda w: corr("lr", "lr1", w)),
    "t28": ("ret_ac2", (6, 21), lambda w: corr("lr", "lr2", w)),
    "t29": ("volz", (6, 21), lambda w: z("logv", w)),
    "t30": ("volmom", (6, 21), lambda w: f"(logv - {lag('logv', w)})"),
    "t31": ("amtz", (6, 21), lambda w: z("loga", w)),
    "t32": ("amtmom", (6, 21), lambda w: f"(loga - {lag('loga', w)})"),
    "t33": ("turnover_z", (6, 21), lambda w: z("turn", w)),
    "t34": ("pvcorr", (6, 21), lambda w: corr("lr", "logv", w)),
    "t35": ("pacorr", (6, 21), lambda w: corr("lr", "loga", w)),
    "t36": ("illiq", (6, 21), lambda w: mean("ill", w)),
    "t37": ("vol_flow", (6, 21), lambda w: total("sv", w)),
    "t38": ("amt_flow", (6, 21), lambda w: total("sa", w)),
    "t39": ("updn_vol_ratio", (6, 21), lambda w: rel(total("pv", w), total("nv", w))),
    "t40": ("amt_prop_signed", (6, 21), lambda w: f"(sign(lr) * coalesce(amount / ({total('amount', w)} + 1e-9), 0))"),
    "t41": ("mfi", (6, 21), lambda w: f"(100 - 100 / (1 + {total('pmf', w)} / ({total('nmf', w)} + 1e-9)))"),
    "t43": ("vwap_dev", (6, 21), lambda w: f"((close - {total('amount', w)} / ({total('volume', w)} + 1e-9)) / {SIZE})"),
    "t47": ("oimom", (6, 21), lambda w: total("dloi", w)),
    "t48": ("oiz", (6, 21), lambda w: z("logoi", w)),
    "t49": ("oipx_div", (6, 21), lambda w: f"({total('dloi', w)} * sign({total('lr', w)}))"),
    "t54": ("shadow_imb", (6, 21), lambda w: f"({mean('losh', w)} - {mean('upsh', w)})"),
    "t55": ("shadow_vol_diff", (6, 21), lambda w: f"({std('losh', w)} - {std('upsh', w)})"),
    "t56": ("body_pos_inter", (6, 21), lambda w: mean("bp", w)),
    "t57": ("dual_thrust_pos", (6, 21), lambda w: f"((close - ({low('low', w)} + 0.5 * {thrust(w)})) / ({thrust(w)} + 1e-9))"),
    "t58": ("tr_dir", (6, 21), lambda w: f"(sign({total('lr', w)}) * {mean('tr', w)} / {SIZE})"),
    "t59": ("mom_x_volz", (6, 21), lambda w: f"(coalesce({total('lr', w)}, 0) * coalesce({z('logv', w)}, 0))"),
    "t60": ("mom_x_oimom", (6, 21), lambda w: f"(coalesce({total('lr', w)}, 0) * coalesce({total('dloi', w)}, 0))"),
    "t61": ("rv_x_volz", (6, 21), lambda w: f"(coalesce({root(total('lrsq', w))}, 0) * coalesce({z('logv', w)}, 0))"),
    "t62": ("effratio", (6, 21), lambda w: f"(abs({total('lr', w)}) / ({total('abslr', w)} + 1e-9))"),
    "t63": ("drawdn", (6, 21), lambda w: f"(close / nullif({top('close', w)} + 1e-9, 0) - 1)"),
    "t64": ("drawup", (6, 21), lambda w: f"(close / nullif({low('close', w)} + 1e-9, 0) - 1)"),
    "t65": ("ret_oi_corr", (6, 21), lambda w: corr("lr", "dloi", w)),
}
CLOSE5, CLOSE21 = ema("close", 5), ema("close", 21)
#: inventory row: (name, {factor: SQL over f}).
FIXED = {
    "t08": ("mom_accel", {"mom_accel": masked(f"({total('lr', 8)} - {total('lr', 34)})", 34)}),
    "t19": ("vol_regime", {"vol_regime": masked(f"({root(total('lrsq', 8))} / ({root(total('lrsq', 55))} + 1e-9))", 55)}),
    "t42": ("vwap_dev_plain", {"vwap_dev": f"((close - vwap) / {SIZE})"}),
    "t45": ("amt_share_signed", {"amt_share_signed": f"(sign(lr) * coalesce(amount / ({total('amount', 12)} + 1e-9), 0))"}),
    "t46": ("oi_chg", {"oi_chg": "dloi"}),
    "t50": ("oi_vol_ratio", {"oi_vol_ratio": "(logoi - logv)"}),
    "t51": ("oi_accel", {"oi_accel": masked(f"({total('dloi', 8)} - {total('dloi', 34)})", 34)}),
    "t52": ("bar_shapes", {x: x for x in factors.SHAPES}),
    "t53": ("bar_shape_means", {f"{x}_{w}": masked(mean(x, w), w) for x in factors.SHAPES for w in (8, 21)}),
}
#: inventory row: (name, factors, CTEs, {factor: SQL over g}).
LAYERED = {
    "t09": ("ema_diff", ["ema_diff_5_21"], f"g AS (SELECT *, {CLOSE5} AS e5, {CLOSE21} AS e21 FROM f)", {"ema_diff_5_21": masked(f"((e5 - e21) / {SIZE})", 21)}),
    "t10": ("macd", ["macd_5_21"], f"g0 AS (SELECT *, {CLOSE5} - {CLOSE21} AS d FROM f), g AS (SELECT *, {lag('d', 1)} AS d1 FROM g0)", {"macd_5_21": masked(f"((d - d1) / {SIZE})", 21)}),
    "t22": ("stoch_dev", ["stoch_dev_6", "stoch_dev_21"], f"g AS (SELECT *, {stoch(6)} AS st6, {stoch(21)} AS st21 FROM f)", {f"stoch_dev_{w}": masked(f"(st{w} - CASE WHEN count(st{w}) OVER ({WS} ROWS 4 PRECEDING) >= 3 THEN avg(st{w}) OVER ({WS} ROWS 4 PRECEDING) END)", w) for w in (6, 21)}),
    "t44": ("vwap_macd", ["vwap_macd_5_21"], f"g AS (SELECT *, {ema('vwap', 5)} AS e5, {ema('vwap', 21)} AS e21 FROM f)", {"vwap_macd_5_21": masked(f"((e5 - e21) / {SIZE})", 21)}),
    "t66": ("lags", ["mom_13_lag1", "mom_13_lag5", "cpos_lag2", "bollz_21_lag3"], f"g AS (SELECT *, {masked(total('lr', 13), 13)} AS m13, {masked(z('close', 21), 21)} AS b21 FROM f)", {n: f"CASE WHEN bss >= {k} THEN {lag(x, k)} END" for n, x, k in (("mom_13_lag1", "m13", 1), ("mom_13_lag5", "m13", 5), ("cpos_lag2", "cpos", 2), ("bollz_21_lag3", "b21", 3))}),
}


def _query(names: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = factors.add_factors(frames.day_frame(spark, sf_dir), names)
        return df.select("symbol", frames.day().alias("d"), *(frames.r6(F.col(n), n) for n in names))

    return run


def _sql(cols: dict[str, str], source: str = "f", ctes: str = "") -> str:
    return f"{DAY_FRAME}{', ' + ctes if ctes else ''} SELECT symbol, strftime(datetime, '%Y-%m-%d') AS d, {', '.join(r6(e, n) for n, e in cols.items())} FROM {source}"


QUERIES, ORACLES = {}, {}
for _k, (_f, _ws, _e) in BY_WINDOW.items():
    QUERIES[f"{_k}_{_f}"] = _query([f"{_f}_{w}" for w in _ws])
    ORACLES[f"{_k}_{_f}"] = _sql({f"{_f}_{w}": masked(_e(w), w) for w in _ws})
for _k, (_f, _cols) in FIXED.items():
    QUERIES[f"{_k}_{_f}"], ORACLES[f"{_k}_{_f}"] = _query(list(_cols)), _sql(_cols)
for _k, (_f, _names, _ctes, _cols) in LAYERED.items():
    QUERIES[f"{_k}_{_f}"], ORACLES[f"{_k}_{_f}"] = _query(_names), _sql(_cols, "g", _ctes)
