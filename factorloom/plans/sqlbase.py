"""SQL building blocks of the oracles: bars, sessions and base series, each written out from its definition."""

from __future__ import annotations

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
WS = "PARTITION BY symbol ORDER BY datetime"

DAY = f"""
px AS (SELECT 'S' || (l_suppkey % 20) AS symbol, date_trunc('day', l_shipdate)::TIMESTAMP AS datetime, l_extendedprice / l_quantity AS price, * FROM lineitem),
bar0 AS (SELECT symbol, datetime, arg_min(price, row({LINE})) AS open, max(price) AS high, min(price) AS low, arg_max(price, row({LINE})) AS close,
                sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM px GROUP BY 1, 2),
bars AS (SELECT *, sum(volume) OVER ({WS}) AS oi FROM bar0)"""

MINUTE = f"""
ev AS (SELECT event_type AS symbol, date_trunc('minute', ts)::TIMESTAMP AS datetime, value, ts, event_id FROM events),
bar0 AS (SELECT symbol, datetime, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close,
                count(*)::DOUBLE AS volume, sum(value) AS amount FROM ev GROUP BY 1, 2),
bars AS (SELECT *, sum(volume) OVER ({WS}) AS oi FROM bar0)"""


def sessions(gap_minutes: float) -> str:
    return f"""
s1 AS (SELECT *, coalesce(epoch(datetime) - epoch(lag(datetime) OVER ({WS})), 0) / 60.0 AS gap_min, lag(datetime) OVER ({WS}) IS NULL AS is_first FROM bars),
s2 AS (SELECT *, gap_min >= {gap_minutes} AS brk, (sum((gap_min >= {gap_minutes})::INT) OVER ({WS}))::INT AS session_id FROM s1),
s3 AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_id ORDER BY datetime) AS rn, count(*) OVER (PARTITION BY symbol, session_id) AS slen FROM s2),
sess AS (SELECT *, rn - (session_id > 0)::INT AS bss, slen - rn AS bars_to_next FROM s3)"""


def labels(horizon: int, blank: int) -> str:
    return f"""
lab AS (SELECT *, CASE WHEN NOT coalesce(max(brk::INT) OVER ({WS} ROWS BETWEEN 1 FOLLOWING AND {blank} FOLLOWING), 0)::BOOLEAN
                       THEN lead(close, {horizon}) OVER (PARTITION BY symbol, session_id ORDER BY datetime) / nullif(close, 0) - 1 END AS label FROM sess)"""


SERIES = f"""
f0 AS (SELECT *, lag(close) OVER ({WS}) AS c1, lag(oi) OVER ({WS}) AS oi1, greatest(high - low, 1e-9) AS hl, (high + low + close) / 3 AS typ, ln(1 + volume) AS logv, ln(1 + amount) AS loga,
              ln(1 + greatest(oi, 1)) AS logoi, CASE WHEN volume > 0 THEN amount / volume ELSE close END AS vwap, pow(ln(high / low), 2) AS loghl2, (high - low) / (abs(close) + 1e-9) AS rngc FROM lab),
f1 AS (SELECT *, CASE WHEN is_first OR brk THEN 0 ELSE ln(close / greatest(c1, 1e-9)) END AS lr, CASE WHEN is_first OR brk THEN 0 ELSE ln(greatest(oi, 1) / greatest(oi1, 1)) END AS dloi,
              CASE WHEN is_first THEN 0 ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr, CASE WHEN is_first THEN 0 ELSE greatest(close - c1, 0) END AS up, CASE WHEN is_first THEN 0 ELSE greatest(c1 - close, 0) END AS dn,
              (close - open) / hl AS bop, abs(close - open) / hl AS body, (high - greatest(open, close)) / hl AS upsh, (least(open, close) - low) / hl AS losh, (close - low) / hl AS cpos,
              typ - lag(typ) OVER ({WS}) AS dtyp, typ * volume AS mf FROM f0),
f AS (SELECT *, lag(lr, 1) OVER ({WS}) AS lr1, lag(lr, 2) OVER ({WS}) AS lr2, lr * lr AS lrsq, pow(least(lr, 0), 2) AS neg2, pow(greatest(lr, 0), 2) AS pos2, abs(lr) AS abslr, (lr > 0)::INT::DOUBLE AS isup,
             abs(lr) / (loga + 1e-6) AS ill, loga - logv AS turn, sign(lr) * logv AS sv, sign(lr) * loga AS sa, CASE WHEN lr > 0 THEN logv ELSE 0 END AS pv, CASE WHEN lr < 0 THEN logv ELSE 0 END AS nv,
             CASE WHEN dtyp > 0 THEN mf ELSE 0 END AS pmf, CASE WHEN dtyp < 0 THEN mf ELSE 0 END AS nmf, body * (cpos - 0.5) AS bp FROM f1)"""

#: Sessions of daily bars break at gaps of 5 days; their labels look 5 bars ahead.
DAY_GAP, DAY_HORIZON, DAY_BLANK = 5 * 24 * 60, 5, 5
DAY_SESSIONS = f"WITH {DAY}, {sessions(DAY_GAP)}"
DAY_LABELS = f"{DAY_SESSIONS}, {labels(DAY_HORIZON, DAY_BLANK)}"
DAY_FRAME = f"{DAY_LABELS}, {SERIES}"
MINUTE_SESSIONS = f"WITH {MINUTE}, {sessions(60)}"


def frame(w: int) -> str:
    return f"({WS} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, w: int) -> str:
    return f"(CASE WHEN count({x}) OVER {frame(w)} = {w} THEN {agg}({x}) OVER {frame(w)} END)"


def mean(x: str, w: int) -> str:
    return full("avg", x, w)


def total(x: str, w: int) -> str:
    return full("sum", x, w)


def std(x: str, w: int) -> str:
    return full("stddev_samp", x, w)


def top(x: str, w: int) -> str:
    return full("max", x, w)


def low(x: str, w: int) -> str:
    return full("min", x, w)


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER ({WS})"


def z(x: str, w: int) -> str:
    return f"(({x} - {mean(x, w)}) / ({std(x, w)} + 1e-9))"


def corr(a: str, b: str, w: int) -> str:
    a, b = f"(CASE WHEN {b} IS NOT NULL THEN {a} END)", f"(CASE WHEN {a} IS NOT NULL THEN {b} END)"
    f = frame(w)
    return f"(CASE WHEN count({a}) OVER {f} = {w} THEN covar_samp({a}, {b}) OVER {f} / nullif((stddev_samp({a}) OVER {f}) * (stddev_samp({b}) OVER {f}), 0) END)"


def shape(agg: str, x: str, w: int, constant: str) -> str:
    f = frame(w)
    return f"(CASE WHEN count({x}) OVER {f} = {w} THEN CASE WHEN max({x}) OVER {f} = min({x}) OVER {f} THEN {constant} ELSE {agg}({x}) OVER {f} END END)"


def masked(e: str, w: int) -> str:
    return f"CASE WHEN bss >= {w} THEN {e} END"


def ema(x: str, span: int) -> str:
    """The recursion written out over the list of all values so far."""
    a = f"{2 / (span + 1)!r}::DOUBLE"
    return f"list_reduce(list({x}) OVER ({WS}), lambda s, v: {a} * v + (1 - {a}) * s)"


def xz(x: str, eps: str = "1e-8", by: str = "datetime") -> str:
    return f"(({x} - avg({x}) OVER (PARTITION BY {by})) / (stddev_samp({x}) OVER (PARTITION BY {by}) + {eps}))"


def xrank(x: str, by: str = "datetime") -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) - 0.5 END)"


def cosine(p: str, y: str) -> str:
    ok = f"FILTER (WHERE {p} IS NOT NULL AND {y} IS NOT NULL)"
    return f"(CASE WHEN count(*) {ok} >= 2 AND sqrt(avg({p} * {p}) {ok} * (avg({y} * {y}) {ok})) > 1e-18 THEN sum({p} * {y}) {ok} / sqrt((sum({p} * {p}) {ok}) * (sum({y} * {y}) {ok})) END)"


def pearson(x: str, y: str) -> str:
    ok = f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    return f"(CASE WHEN count(*) {ok} >= 3 AND sqrt((var_pop({x}) {ok}) * (var_pop({y}) {ok})) > 1e-15 THEN (covar_pop({x}, {y}) {ok}) / sqrt((var_pop({x}) {ok}) * (var_pop({y}) {ok})) END)"


def r6(e: str, name: str, digits: int = 6) -> str:
    return f'round({e}, {digits}) + 0.0 AS "{name}"'


#: The panel that the statistics are taken from: some factors of the daily bars with their label.
PANEL_FACTORS = {
    "mom_5": masked(total("lr", 5), 5), "rv_5": masked(f"sqrt({total('lrsq', 5)})", 5), "px_sma_6": masked(f"(close / nullif({mean('close', 6)} + 1e-9, 0) - 1)", 6),
    "volz_6": masked(z("logv", 6), 6), "rsi_8": masked(f"(100 - 100 / (1 + {mean('up', 8)} / ({mean('dn', 8)} + 1e-9)))", 8), "cpos": "cpos", "oi_vol_ratio": "(logoi - logv)",
}
PANEL = DAY_FRAME + ", panel AS (SELECT symbol, datetime, strftime(datetime, '%Y-%m') AS month, open, high, low, close, volume, amount, oi, label, brk, session_id, bss, " + ", ".join(f"{e} AS {n}" for n, e in PANEL_FACTORS.items()) + " FROM f)"
