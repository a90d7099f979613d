"""The factor library: window columns over bars with sessions.

Every factor is masked where its window would reach back over a session's start (bss < w), except those listed as
unmasked, whose look-back is one bar or which cross sessions by definition.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..functions.numeric import EPS, at_least, at_most, finite, sdiv, zero
from .rolling import Rolling

#: Windows, pairs of EMA spans, and lagged factors of the library.
WINS = [2, 3, 4, 5, 6, 8, 10, 13, 16, 21, 26, 34, 42, 55, 72, 89, 120, 144, 180, 233, 288]
WINS_MID = [4, 6, 8, 10, 13, 16, 21, 26, 34, 42, 55, 72, 89, 120, 144, 180, 233]
EMA_PAIRS = [(3, 13), (5, 21), (8, 34), (10, 42), (13, 55), (16, 72), (21, 89), (5, 55), (13, 144), (21, 180)]
LAG_BASES = ["mom_13", "mom_34", "rv_21", "volz_21", "stoch_21", "rsi_21", "bollz_21", "cci_21", "mfi_21", "pvcorr_34", "bop_21", "cpos"]
LAGS = [1, 2, 3, 5]
SHAPES = ["bop", "body", "upsh", "losh", "cpos"]
SHAPE_WINS = [8, 21, 55]
UNMASKED = ["vwap_dev", "amt_share_signed", "oi_chg", "oi_vol_ratio", *SHAPES]


def base_series(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """Adds the series that factors are made of, as columns named s_*. df: bars with sessions."""
    roll = Rolling(keys)
    o, h, l, cl = (finite(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    v, amt, oi = zero("volume"), zero("amount"), zero("oi")
    df = df.withColumns({"s_o": o, "s_h": h, "s_l": l, "s_c": cl, "s_v": v, "s_amt": amt, "s_oi": oi})
    df = df.withColumns({"s_c1": roll.lag("s_c"), "s_oi1": roll.lag("s_oi")})
    first, brk = F.lag("datetime").over(roll.series).isNull(), F.col("is_long_break_before")
    cl, c1, h, l = (F.col(x) for x in ("s_c", "s_c1", "s_h", "s_l"))  # noqa: E741
    lr = F.when(first | brk, 0.0).otherwise(zero(F.ln(sdiv(cl, at_least(c1, EPS)))))
    hl = at_least(h - l, EPS)
    up = F.greatest(h, F.col("s_o"))
    dloi = F.when(first | brk, 0.0).otherwise(zero(F.ln(F.greatest("s_oi", F.lit(1.0)) / F.greatest("s_oi1", F.lit(1.0)))))
    change = cl - c1
    df = df.withColumns({
        "s_lr": lr, "s_logv": F.log1p(F.greatest("s_v", F.lit(0.0))), "s_loga": F.log1p(F.greatest("s_amt", F.lit(0.0))),
        "s_typ": (h + l + cl) / 3, "s_hl": hl, "s_tr": F.when(first, 0.0).when(h.isNotNull() & l.isNotNull() & c1.isNotNull(), F.greatest(h - l, F.abs(h - c1), F.abs(l - c1))),
        "s_up": F.when(first, 0.0).otherwise(at_least(change, 0)), "s_dn": F.when(first, 0.0).otherwise(at_least(-change, 0)),
        "s_vwap": F.when(F.col("s_v") > 0, F.col("s_amt") / at_least("s_v", EPS)).otherwise(cl), "s_dloi": dloi, "s_logoi": F.log1p(F.greatest("s_oi", F.lit(1.0))),
        "s_bop": (cl - F.col("s_o")) / hl, "s_body": F.abs(cl - F.col("s_o")) / hl, "s_upsh": (h - F.greatest("s_o", "s_c")) / hl, "s_losh": (F.least("s_o", "s_c") - l) / hl, "s_cpos": (cl - l) / hl,
        "s_loghl2": F.pow(F.ln(sdiv(at_least(h, EPS), at_least(l, EPS))), 2),
    })
    x = F.col("s_lr")
    df = df.withColumns({
        "s_lr1": roll.lag("s_lr", 1), "s_lr2": roll.lag("s_lr", 2), "s_dtyp": F.col("s_typ") - roll.lag("s_typ"), "s_lrsq": x * x, "s_neg2": F.pow(F.least(x, F.lit(0.0)), 2), "s_pos2": F.pow(F.greatest(x, F.lit(0.0)), 2),
        "s_isup": (x > 0).cast("double"), "s_abslr": F.abs(x), "s_rngc": sdiv(h - l, F.abs(cl) + EPS), "s_ill": F.abs(x) / (F.col("s_loga") + 1e-6), "s_turn": F.col("s_loga") - F.col("s_logv"),
        "s_sv": F.signum(x) * F.col("s_logv"), "s_sa": F.signum(x) * F.col("s_loga"), "s_pv": F.when(x > 0, F.col("s_logv")).otherwise(0.0), "s_nv": F.when(x < 0, F.col("s_logv")).otherwise(0.0),
        "s_mf": F.col("s_typ") * F.col("s_v"), "s_bp": F.col("s_body") * (F.col("s_cpos") - 0.5),
    })
    return df.withColumns({"s_pmf": F.when(F.col("s_dtyp") > 0, F.col("s_mf")).otherwise(0.0), "s_nmf": F.when(F.col("s_dtyp") < 0, F.col("s_mf")).otherwise(0.0)})


def _families(r: Rolling) -> dict:
    """family -> function of the window; unmasked."""
    cl = F.col("s_c")
    size = F.abs(cl) + EPS
    rel = lambda a, b: (a - b) / (a + b + EPS)
    mom = lambda w: r.sum("s_lr", w)
    rv = lambda w: F.sqrt(r.sum("s_lrsq", w))
    dn = lambda w: F.sqrt(r.sum("s_neg2", w))
    span = lambda w: r.max("s_h", w) - r.min("s_l", w) + EPS
    thrust = lambda w: F.greatest(r.max("s_h", w) - r.min("s_c", w), r.max("s_c", w) - r.min("s_l", w))
    volz, oimom = (lambda w: r.z("s_logv", w)), (lambda w: r.sum("s_dloi", w))
    return {
        "mom": mom,
        "sharpe": lambda w: r.mean("s_lr", w) / (r.std("s_lr", w) + EPS),
        "upratio": lambda w: r.mean("s_isup", w),
        "maxret": lambda w: r.max("s_lr", w),
        "minret": lambda w: r.min("s_lr", w),
        "px_sma": lambda w: sdiv(cl, r.mean("s_c", w) + EPS) - 1,
        "roc": lambda w: sdiv(cl, r.lag("s_c", w)) - 1,
        "rv": rv,
        "park": lambda w: F.sqrt(r.sum("s_loghl2", w) / (4 * math.log(2) * w)),
        "dvol": dn,
        "volskew": lambda w: rel(F.sqrt(r.sum("s_pos2", w)), dn(w)),
        "skew": lambda w: r.skew("s_lr", w),
        "kurt": lambda w: r.kurt("s_lr", w),
        "atr": lambda w: r.mean("s_tr", w) / size,
        "range": lambda w: r.mean("s_rngc", w),
        "stoch": lambda w: (cl - r.min("s_l", w)) / span(w),
        "willr": lambda w: (r.max("s_h", w) - cl) / span(w),
        "rsi": lambda w: 100 - 100 / (1 + r.mean("s_up", w) / (r.mean("s_dn", w) + EPS)),
        "cci": lambda w: (F.col("s_typ") - r.mean("s_typ", w)) / (0.015 * 0.8 * r.std("s_typ", w) + EPS),
        "bollz": lambda w: r.z("s_c", w),
        "cmo": lambda w: rel(r.sum("s_up", w), r.sum("s_dn", w)),
        "ret_ac1": lambda w: r.corr("s_lr", "s_lr1", w),
        "ret_ac2": lambda w: r.corr("s_lr", "s_lr2", w),
        "volz": volz,
        "volmom": lambda w: F.col("s_logv") - r.lag("s_logv", w),
        "amtz": lambda w: r.z("s_loga", w),
        "amtmom": lambda w: F.col("s_loga") - r.lag("s_loga", w),
        "turnover_z": lambda w: r.z("s_turn", w),
        "pvcorr": lambda w: r.corr("s_lr", "s_logv", w),
        "pacorr": lambda w: r.corr("s_lr", "s_loga", w),
        "illiq": lambda w: r.mean("s_ill", w),
        "vol_flow": lambda w: r.sum("s_sv", w),
        "amt_flow": lambda w: r.sum("s_sa", w),
        "updn_vol_ratio": lambda w: rel(r.sum("s_pv", w), r.sum("s_nv", w)),
        "amt_prop_signed": lambda w: F.signum("s_lr") * zero(F.col("s_amt") / (r.sum("s_amt", w) + EPS)),
        "mfi": lambda w: 100 - 100 / (1 + r.sum("s_pmf", w) / (r.sum("s_nmf", w) + EPS)),
        "vwap_dev": lambda w: (cl - r.sum("s_amt", w) / (r.sum("s_v", w) + EPS)) / size,
        "oimom": oimom,
        "oiz": lambda w: r.z("s_logoi", w),
        "oipx_div": lambda w: oimom(w) * F.signum(mom(w)),
        **{k: (lambda k: lambda w: r.mean(f"s_{k}", w))(k) for k in SHAPES},
        "shadow_imb": lambda w: r.mean("s_losh", w) - r.mean("s_upsh", w),
        "shadow_vol_diff": lambda w: r.std("s_losh", w) - r.std("s_upsh", w),
        "body_pos_inter": lambda w: r.mean("s_bp", w),
        "dual_thrust_pos": lambda w: (cl - (r.min("s_l", w) + 0.5 * thrust(w))) / (thrust(w) + EPS),
        "tr_dir": lambda w: F.signum(mom(w)) * r.mean("s_tr", w) / size,
        "mom_x_volz": lambda w: zero(mom(w)) * zero(volz(w)),
        "mom_x_oimom": lambda w: zero(mom(w)) * zero(oimom(w)),
        "rv_x_volz": lambda w: zero(rv(w)) * zero(volz(w)),
        "effratio": lambda w: F.abs(mom(w)) / (r.sum("s_abslr", w) + EPS),
        "drawdn": lambda w: sdiv(cl, r.max("s_c", w) + EPS) - 1,
        "drawup": lambda w: sdiv(cl, r.min("s_c", w) + EPS) - 1,
        "ret_oi_corr": lambda w: r.corr("s_lr", "s_dloi", w),
    }


#: Families over all windows; the shapes have SHAPE_WINS and the rest WINS_MID.
WIDE = ["mom", "sharpe", "upratio", "maxret", "minret", "rv", "park"]
PLAIN = ["vwap_dev", "amt_share_signed", "oi_chg", "oi_vol_ratio", "mom_accel", "oi_accel", "vol_regime", *SHAPES]
EMA = {"ema_diff": "s_c", "macd": "s_c", "vwap_macd": "s_vwap"}


def names() -> list[str]:
    """All factors of the library."""
    fams = list(_families(Rolling()))
    out = [f"{k}_{w}" for k in fams for w in (WINS if k in WIDE else SHAPE_WINS if k in SHAPES else WINS_MID)]
    out += [f"stoch_dev_{w}" for w in WINS_MID] + PLAIN
    out += [f"{k}_{a}_{b}" for k in EMA for a, b in EMA_PAIRS]
    return out + [f"{b}_lag{k}" for b in LAG_BASES for k in LAGS]


def masked(x: Column, w: int) -> Column:
    return F.when(F.col("bss") >= w, x)


def plain(r: Rolling) -> dict[str, Column]:
    lr, cl = F.col("s_lr"), F.col("s_c")
    return {
        "vwap_dev": (cl - F.col("s_vwap")) / (F.abs(cl) + EPS),
        "amt_share_signed": F.signum(lr) * zero(F.col("s_amt") / (r.sum("s_amt", 12) + EPS)),
        "oi_chg": F.col("s_dloi"),
        "oi_vol_ratio": F.col("s_logoi") - F.col("s_logv"),
        "mom_accel": masked(r.sum("s_lr", 8) - r.sum("s_lr", 34), 34),
        "oi_accel": masked(r.sum("s_dloi", 8) - r.sum("s_dloi", 34), 34),
        "vol_regime": masked(F.sqrt(r.sum("s_lrsq", 8)) / (F.sqrt(r.sum("s_lrsq", 55)) + EPS), 55),
        **{k: F.col(f"s_{k}") for k in SHAPES},
    }


def split_name(name: str) -> tuple[str, list[int]]:
    """mom_13 -> (mom, [13]); ema_diff_3_13 -> (ema_diff, [3, 13]); ret_ac1_4 -> (ret_ac1, [4])."""
    m = re.fullmatch(r"(.*?)((?:_\d+)+)", name)
    return (m[1], [int(x) for x in m[2][1:].split("_")]) if m else (name, [])


def add_factors(df: DataFrame, wanted: list[str], keys=("symbol",)) -> DataFrame:
    """Adds the factors to bars that have base_series(). All windows share one exchange by keys and one sort."""
    r = Rolling(keys)
    fams = _families(r)
    lags = {n: (m[1], int(m[2])) for n in wanted if (m := re.fullmatch(r"(.+)_lag(\d+)", n))}
    first = list(dict.fromkeys([*(n for n in wanted if n not in lags), *(b for b, _ in lags.values())]))
    spans = sorted({(EMA[f], s) for n in first for f, ws in [split_name(n)] if f in EMA for s in ws})
    spans = [x for x in spans if f"_ema_{x[0]}_{x[1]}" not in df.columns]
    df = with_emas(df, spans, keys) if spans else df
    smooth = [split_name(n)[1][0] for n in first if n.startswith("stoch_dev_")]
    df = df.withColumns({f"_stoch_{w}": fams["stoch"](w) for w in smooth}) if smooth else df
    cols, simple = {}, plain(r)
    for n in first:
        f, ws = split_name(n)
        if n in simple:
            cols[n] = simple[n]
        elif f in EMA:
            a, b = (F.col(f"_ema_{EMA[f]}_{s}") for s in ws)
            x = a - b if f != "macd" else (a - b) - r.lag(a - b)
            cols[n] = masked(x / (F.abs(F.col("s_c")) + EPS), ws[1])
        elif f == "stoch_dev":
            cols[n] = masked(F.col(f"_stoch_{ws[0]}") - r.smooth(f"_stoch_{ws[0]}", 5, 3), ws[0])
        else:
            cols[n] = masked(fams[f](ws[0]), ws[0])
    df = df.withColumns({n: finite(x) for n, x in cols.items()})
    if lags:
        df = df.withColumns({n: F.when(F.col("bss") >= k, F.lag(b, k).over(r.series)) for n, (b, k) in lags.items()})
    drop = [b for b, _ in lags.values() if b not in wanted]
    return df.drop(*drop, *(f"_stoch_{w}" for w in smooth), *(c for c in df.columns if c.startswith("_ema_")))


def ema_spans(wanted: list[str]) -> list[tuple[str, int]]:
    """(series, span) of the exponential means that the factors need."""
    bases = [m[1] if (m := re.fullmatch(r"(.+)_lag(\d+)", n)) else n for n in wanted]
    return sorted({(EMA[f], s) for f, ws in map(split_name, bases) if f in EMA for s in ws})


def with_emas(df: DataFrame, spans: list[tuple[str, int]], keys=("symbol",)) -> DataFrame:
    """Adds _ema_<series>_<span>: exponential means over the whole series, breaks included.

    The one true recurrence of the library, and so its only Python step: series by series, in Arrow batches.
    """
    schema = StructType(list(df.schema.fields))  # add() changes a schema in place
    for x, s in spans:
        schema = schema.add(f"_ema_{x}_{s}", "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("datetime", kind="stable")
        return pdf.assign(**{f"_ema_{x}_{s}": pdf[x].ewm(span=s, adjust=False).mean() for x, s in spans})

    return df.groupBy(*keys).applyInPandas(run, schema)


def ema_in_chunks(df: DataFrame, x: str, span: int, name: str) -> DataFrame:
    """One exponential mean by emas_in_chunks()."""
    return emas_in_chunks(df, [(x, span)]).withColumnRenamed(f"_ema_{x}_{span}", name)


def emas_in_chunks(df: DataFrame, spans: list[tuple[str, int]]) -> DataFrame:
    """The columns of with_emas() over bars cut by in_chunks(), exact and without the whole series in one task; rows of halos go.

    Within a chunk a mean is a partial one plus a decayed share of what came in; what goes out of each chunk
    is a row of a small table, chained chunk by chunk. The series have no missing values.
    """
    alpha = [2 / (s + 1) for _, s in spans]
    schema = StructType(list(df.schema.fields)).add("_part", ArrayType(DoubleType())).add("_place", IntegerType())

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("datetime", kind="stable")
        seeded = np.column_stack([pd.concat([pd.Series([0.0]), pdf[x]]).ewm(alpha=a, adjust=False).mean().to_numpy()[1:] for (x, _), a in zip(spans, alpha)])
        return pdf.assign(_part=list(seeded), _place=np.arange(1, len(pdf) + 1, dtype=np.int32))

    own = df.where(~F.col("is_halo")).groupBy("symbol", "chunk").applyInPandas(part, schema)
    first = F.array(*(F.col(x) for x, _ in spans))
    ends = own.groupBy("symbol", "chunk").agg(F.max_by(F.struct("_part", "_place"), "datetime").alias("e"), F.min_by(first, "datetime").alias("x0"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        keep, out, carry = 1 - np.array(alpha), [], np.array(pdf["x0"].iloc[0], float)  # the first values start the means
        for p, n in zip(pdf["_part"], pdf["_place"]):
            out.append(carry)
            carry = np.asarray(p) + keep**n * carry
        return pdf.assign(carry=out)[["symbol", "chunk", "carry"]]

    carry = ends.select("symbol", "chunk", "x0", "e.*").groupBy("symbol").applyInPandas(chain, "symbol string, chunk int, carry array<double>")
    made = {f"_ema_{x}_{s}": F.col("_part")[i] + F.pow(F.lit(1 - alpha[i]), F.col("_place")) * F.col("carry")[i] for i, (x, s) in enumerate(spans)}
    return own.join(carry, ["symbol", "chunk"]).withColumns(made).drop("_part", "_place", "carry")


def _pandas_moments(f: pd.DataFrame) -> Iterator[tuple[str, pd.Series]]:
    """The wide panel's most numerous families, one series at a time, by pandas' running windows."""
    lr, cl, logv, loga = f["s_lr"], f["s_c"], f["s_logv"], f["s_loga"]
    for w in WINS:
        r = lr.rolling(w)
        yield f"mom_{w}", r.sum()
        yield f"sharpe_{w}", r.mean() / (r.std() + EPS)
        yield f"upratio_{w}", f["s_isup"].rolling(w).mean()
        yield f"maxret_{w}", r.max()
        yield f"minret_{w}", r.min()
        yield f"rv_{w}", f["s_lrsq"].rolling(w).sum().clip(lower=0) ** 0.5
        yield f"park_{w}", (f["s_loghl2"].rolling(w).sum().clip(lower=0) / (4 * math.log(2) * w)) ** 0.5
    for w in WINS_MID:
        z = lambda s, w=w: (s - s.rolling(w).mean()) / (s.rolling(w).std() + EPS)
        yield f"px_sma_{w}", cl / (cl.rolling(w).mean() + EPS) - 1
        yield f"bollz_{w}", z(cl)
        yield f"volz_{w}", z(logv)
        yield f"amtz_{w}", z(loga)
        yield f"turnover_z_{w}", z(f["s_turn"])
        yield f"atr_{w}", f["s_tr"].rolling(w).mean() / (cl.abs() + EPS)
        yield f"range_{w}", f["s_rngc"].rolling(w).mean()
        yield f"illiq_{w}", f["s_ill"].rolling(w).mean()
        yield f"vol_flow_{w}", f["s_sv"].rolling(w).sum()
        yield f"amt_flow_{w}", f["s_sa"].rolling(w).sum()
        yield f"drawdn_{w}", cl / (cl.rolling(w).max() + EPS) - 1
        yield f"drawup_{w}", cl / (cl.rolling(w).min() + EPS) - 1
        yield f"pvcorr_{w}", lr.rolling(w).corr(logv)


def wide_names() -> list[str]:
    """The factors that wide_panel() makes."""
    have = [f"{k}_{w}" for k in ("mom", "sharpe", "upratio", "maxret", "minret", "rv", "park") for w in WINS]
    return have + [f"{k}_{w}" for k in ("px_sma", "bollz", "volz", "amtz", "turnover_z", "atr", "range", "illiq", "vol_flow", "amt_flow", "drawdn", "drawup", "pvcorr") for w in WINS_MID]


def wide_panel(chunks: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """symbol, datetime and hundreds of factors at once: chunks with sessions and base_series() over (symbol, chunk).

    At this width sliding frames update every aggregate w times a row; one pass of running windows in Arrow batches of
    a chunk does each in constant time. Chunks bound a task's memory, whatever a symbol's share of the rows.
    """
    have = wide_names()
    wanted = have if wanted is None else [x for x in wanted if x in have]
    need = ["symbol", "chunk", "datetime", "is_halo", "bss", *sorted({"s_lr", "s_c", "s_logv", "s_loga", "s_isup", "s_lrsq", "s_loghl2", "s_turn", "s_tr", "s_rngc", "s_ill", "s_sv", "s_sa"})]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("datetime", kind="stable").reset_index(drop=True)
        out = {n: x.where(pdf["bss"] >= int(n.rpartition("_")[2])) for n, x in _pandas_moments(pdf) if n in wanted}
        return pd.DataFrame({"symbol": pdf["symbol"], "datetime": pdf["datetime"], **out})[~pdf["is_halo"]]

    return chunks.select(*need).groupBy("symbol", "chunk").applyInPandas(run, "symbol string, datetime timestamp_ntz, " + ", ".join(f"{n} double" for n in wanted))
