"""Generated factors of two inputs: the table of operations, names, evaluation and candidate generation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .views import xrank, xzscore

#: operation: (input view, column of two inputs). A gate with a missing condition is shut: it gives 0.
OPS: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "rank_add": ("xrank", lambda a, b: a + b),
    "rank_spread": ("xrank", lambda a, b: a - b),
    "rank_product": ("xrank", lambda a, b: a * b),
    "rank_gate_pos": ("xrank", lambda a, b: F.when(b > 0, a).otherwise(0.0)),
    "rank_gate_neg": ("xrank", lambda a, b: F.when(b < 0, a).otherwise(0.0)),
    "z_add": ("xz", lambda a, b: a + b),
    "z_spread": ("xz", lambda a, b: a - b),
    "z_product": ("xz", lambda a, b: a * b),
}
#: The formula texts of an expression table.
FORMULAS = {
    "rank_add": "xrank({0}) + xrank({1})", "rank_spread": "xrank({0}) - xrank({1})", "rank_product": "xrank({0}) * xrank({1})",
    "rank_gate_pos": "xrank({0}) * I[xrank({1}) > 0]", "rank_gate_neg": "xrank({0}) * I[xrank({1}) < 0]",
    "z_add": "xzscore({0}) + xzscore({1})", "z_spread": "xzscore({0}) - xzscore({1})", "z_product": "xzscore({0}) * xzscore({1})",
}
SCHEMA = "name string, op string, left string, right string, formula string"
NEIGHBOURS, DEEP = 17, 20


def safe_name(op: str, left: str, right: str) -> str:
    return f"nf_{op}_{hashlib.sha1(f'{op}:{left}:{right}'.encode()).hexdigest()[:10]}"


def name_column() -> Column:
    """safe_name() of columns op, left, right."""
    return F.concat(F.lit("nf_"), "op", F.lit("_"), F.substring(F.sha1(F.concat_ws(":", "op", "left", "right").cast("binary")), 1, 10))


def make_expression(op: str, left: str, right: str) -> dict:
    if op not in OPS:
        raise ValueError(f"no such operation: {op}")
    return {"name": safe_name(op, left, right), "op": op, "left": left, "right": right, "formula": FORMULAS[op].format(left, right)}


def expression_table(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """A table of expressions, one row a name; unknown operations and missing columns are errors."""
    out = {}
    for r in rows:
        if lost := {"name", "op", "left", "right"} - set(r):
            raise ValueError(f"an expression lacks {sorted(lost)}")
        if r["op"] not in OPS:
            raise ValueError(f"no such operation: {r['op']}")
        out.setdefault(r["name"], tuple(r.get(k) or "" for k in ("name", "op", "left", "right", "formula")))
    return spark.createDataFrame(list(out.values()), SCHEMA)


def load_expressions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=SCHEMA)
    return expression_table(spark, [r.asDict() for r in rows.collect()])  # a list of formulas, thousands at most


def inputs(exprs: Iterable[dict]) -> dict[str, list[str]]:
    """The columns each view is needed for."""
    need: dict[str, dict] = {"xrank": {}, "xz": {}}
    for e in exprs:
        need[OPS[e["op"]][0]].update({e["left"]: 1, e["right"]: 1})
    return {k: list(v) for k, v in need.items()}


def precompute(df: DataFrame, exprs: list[dict]) -> DataFrame:
    """Adds _xrank_* and _xz_* once for all inputs, in one layer over one exchange by time."""
    need = inputs(exprs)
    return df.withColumns({**{f"_xrank_{x}": xrank(x) for x in need["xrank"]}, **{f"_xz_{x}": xzscore(x) for x in need["xz"]}})


def evaluate(df: DataFrame, exprs: list[dict]) -> DataFrame:
    """Adds each expression by its name."""
    ready = precompute(df, exprs)
    cols = {e["name"]: OPS[e["op"]][1](F.col(f"_{OPS[e['op']][0]}_{e['left']}"), F.col(f"_{OPS[e['op']][0]}_{e['right']}")) for e in exprs}
    return ready.select(*df.columns, *(v.alias(k) for k, v in cols.items()))


def with_group(scores: DataFrame) -> DataFrame:
    """Adds group: family:view where a catalogue gives one, else the view that the name's prefix tells."""
    family, view = (F.coalesce(F.col(x), F.lit("")) if x in scores.columns else F.lit("") for x in ("family", "view"))
    prefix = F.regexp_extract("factor", "^(tsz|csz|csr)_", 1)
    return scores.withColumn("group", F.when((family != "") | (view != ""), F.concat_ws(":", family, view)).when(prefix != "", prefix).otherwise("raw"))


def seeds(scores: DataFrame, most: int, use_oos_sign: bool = True) -> DataFrame:
    """The strongest factors, spread over groups: with a cap of 1, 2, ... a group that relaxes until enough are in.

    That order is by place within the group, then by strength. Adds place (from 1) in order of choice. With
    use_oos_sign, factors whose sign held out of sample come first, which lets test data into the choice.
    """
    sign = F.coalesce((F.signum("is_ic") == F.signum("oos_ic")), F.lit(False)).cast("int") if use_oos_sign else F.lit(0)
    df = with_group(scores).withColumn("_same", sign).withColumn("_abs", F.abs("is_ic"))
    strength = [F.desc("_same"), F.desc_nulls_last("_abs"), F.asc("factor")]
    df = df.withColumn("_in", F.row_number().over(Window.partitionBy("group").orderBy(*strength)))
    top = df.orderBy("_in", *strength).limit(most)
    order = Window.orderBy(F.lit(0), "_in", *strength)  # of the limited seeds alone
    return top.withColumn("place", F.row_number().over(order)).drop("_in", "_same", "_abs")


def pairs(chosen: list[tuple[str, str | None, str | None]], most: int) -> list[tuple[str, str]]:
    """Directed pairs of seeds (factor, family, view) in order of choice: each with the next NEIGHBOURS, and with the deepest
    seed of another family or view among the last DEEP. No pair twice."""
    out: dict[tuple[str, str], None] = {}
    n = 0
    for i, (a, fa, va) in enumerate(chosen):
        near = [(a, b) for b, *_ in chosen[i + 1 : i + 1 + NEIGHBOURS]][: most - n]
        n += len(near)
        out.update(dict.fromkeys(near))
        if n >= most:
            break
        deep = next((b for b, fb, vb in chosen[: max(i, len(chosen) - DEEP) : -1] if (fa, va) != (fb, vb)), None)
        if deep is not None:
            out[(a, deep)] = None
            n += 1
        if n >= most:
            break
    return [p for p in out if p[0] != p[1]][:most]


def candidates(scores: DataFrame, max_seeds: int = 80, max_pairs: int = 500, use_oos_sign: bool = True) -> DataFrame:
    """The expression table of all operations on all pairs of seeds. Seeds are a few hundred at most, so pairing is the driver's."""
    spark = scores.sparkSession
    chosen = [r.asDict() for r in seeds(scores, max_seeds, use_oos_sign).orderBy("place").collect()]
    found = pairs([(r["factor"], r.get("family"), r.get("view")) for r in chosen], max_pairs)
    return expression_table(spark, [make_expression(op, a, b) for a, b in found for op in OPS])
