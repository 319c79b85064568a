"""Models as predicates: invocation in Arrow batches, calibration, validation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cypher import ast as A
from ..cypher.compiler import Expressions, property_needs
from ..cypher.plan import Planner
from ..cypher.scope import State
from ..errors import RuleError


def register_model(session, provider: str, function) -> None:
    """A callable from a list of feature dicts to a list of numbers."""
    if not hasattr(session, "providers"):
        session.providers = {}
    session.providers[provider] = function


def run_model_step(engine, step):
    session = engine.session
    if not hasattr(session, "models"):
        session.models = {}
    engine.models = session.models
    a = step.args
    if step.kind == "model":
        function = getattr(session, "providers", {}).get(a["provider"])
        if function is None:
            raise RuleError(f"no provider {a['provider']}")
        session.models[a["name"]] = {"args": a, "calibrate": ("none", {}), "builder": None}
        session.models[a["name"]]["builder"] = builder(session.models[a["name"]], function)
        return None
    model = session.models.get(a["model"])
    if model is None:
        raise RuleError(f"no model {a['model']}")
    rows = scored(engine, model, a)
    if step.kind == "calibrate":
        model["calibrate"] = fit(rows, a["method"])
        return session.graph.spark.createDataFrame([(a["model"], a["method"], rows.count())], "model string, method string, rows long")
    return metrics(rows, a["metrics"])


def builder(model: dict, function):
    def build(cols, types):
        names = [f"f{i}" for i in range(len(cols))]

        def run(batch):
            return [float(x) for x in function(batch)]


        @F.pandas_udf("double")
        def call(features: pd.DataFrame) -> pd.Series:
            return pd.Series(run(features.to_dict("records")))

        raw = call(F.struct(*[c.alias(n) for c, n in zip(cols, names, strict=True)]))
        return adjusted(raw, model["calibrate"])

    return build


def adjusted(p, calibration):
    """A calibrated probability as an expression of the raw one."""
    kind, c = calibration
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    logit = F.ln(clipped / (1 - clipped))
    if kind == "platt_scaling":
        return 1 / (1 + F.exp(-(c["a"] * logit + c["b"])))
    if kind == "temperature_scaling":
        return 1 / (1 + F.exp(-(logit / c["t"])))
    if kind == "beta_calibration":
        return 1 / (1 + F.exp(-(c["a"] * F.ln(clipped) - c["b"] * F.ln(1 - clipped) + c["c"])))
    if kind == "isotonic_regression":
        out = F.lit(c["values"][0] if c["values"] else 0.5)
        for edge, value in zip(c["edges"], c["values"], strict=True):
            out = F.when(p >= edge, F.lit(value)).otherwise(out)
        return out
    return p


def scored(engine, model: dict, a: dict) -> DataFrame:
    """(p, y) of the matched rows."""
    ctx = engine.context()
    planner = Planner(ctx)
    features = model["args"]["features"]
    ctx.needs = property_needs([features, a["target"], a["where"]])
    state = planner.match(A.Match(a["patterns"], a["where"]), State(None, {}))
    ex = Expressions(ctx, state)
    cols = [ex.column(f) for f in features]
    return state.df.select(model["builder"](cols, []).alias("p"), ex.column(a["target"]).cast("double").alias("y"))


def fit(rows: DataFrame, method: str):
    """Calibration from at most a million rows, binned to a thousandth."""
    bins = rows.where("p is not null and y is not null").groupBy(F.round("p", 3).alias("p")).agg(F.sum("y").alias("pos"), F.count("*").alias("n")).orderBy("p").collect()  # at most 1001 rows
    data = [(min(max(r.p, 1e-6), 1 - 1e-6), r.pos, r.n) for r in bins]
    if not data or method == "none":
        return "none", {}
    if method in ("platt_scaling", "dirichlet"):
        a, b = _newton(data, lambda p: (math.log(p / (1 - p)), 1.0), 2)
        return "platt_scaling", {"a": a, "b": b}
    if method == "temperature_scaling":
        best = min((sum(-pos * math.log(q) - (n - pos) * math.log(1 - q) for p, pos, n in data for q in [min(max(1 / (1 + math.exp(-math.log(p / (1 - p)) / t)), 1e-9), 1 - 1e-9)]), t) for t in [0.05 * i for i in range(1, 201)])
        return "temperature_scaling", {"t": best[1]}
    if method == "beta_calibration":
        a, b, c = _newton(data, lambda p: (math.log(p), -math.log(1 - p), 1.0), 3)
        return "beta_calibration", {"a": a, "b": b, "c": c}
    if method in ("isotonic_regression", "conformal"):
        blocks: list[list[float]] = []
        for p, pos, n in data:
            blocks.append([p, pos, n])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                _, pos2, n2 = blocks.pop()
                blocks[-1][1] += pos2
                blocks[-1][2] += n2
        return "isotonic_regression", {"edges": [b[0] for b in blocks], "values": [b[1] / b[2] for b in blocks]}
    raise RuleError(f"unknown calibration {method}")


def _newton(data, features, k: int):
    import numpy as np

    x = np.array([features(p) for p, _, _ in data])
    pos, n = np.array([d[1] for d in data], float), np.array([d[2] for d in data], float)
    w = np.zeros(k)
    w[0] = 1.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * q - pos) + 1e-3 * w
        h = (x * (n * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(k)
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def metrics(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row of the asked metrics, by aggregations."""
    r = rows.where("p is not null and y is not null").withColumns({"q": F.greatest(F.least("p", F.lit(1 - 1e-12)), F.lit(1e-12)), "bin": F.least(F.floor(F.col("p") * 10), F.lit(9))})
    simple = {"brier_score": F.avg((F.col("p") - F.col("y")) ** 2), "accuracy": F.avg(((F.col("p") >= 0.5) == (F.col("y") >= 0.5)).cast("double")), "log_loss": F.avg(-(F.col("y") * F.ln("q") + (1 - F.col("y")) * F.ln(1 - F.col("q"))))}
    out = r.agg(F.count("*").alias("n"), *[simple[m].alias(m) for m in names if m in simple])
    if {"ece", "debiased_ece"} & set(names):
        b = r.groupBy("bin").agg(F.avg("p").alias("c"), F.avg("y").alias("a"), F.count("*").alias("k"))
        gap = F.abs(F.col("c") - F.col("a"))
        noise = F.sqrt(F.col("a") * (1 - F.col("a")) / F.col("k"))
        e = b.agg((F.sum(F.col("k") * gap) / F.sum("k")).alias("ece"), (F.sum(F.col("k") * F.greatest(gap - noise, F.lit(0.0))) / F.sum("k")).alias("debiased_ece"))
        out = out.crossJoin(e.select(*[m for m in ("ece", "debiased_ece") if m in names]))
    if "auc" in names:
        # mean rank of the positives, over distinct scores
        from pyspark.sql import Window

        g = r.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
        w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        u = g.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0.0))).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("a"), F.sum("neg").alias("b"))
        out = out.crossJoin(u.select((F.col("u") / F.nullif(F.col("a") * F.col("b"), F.lit(0.0))).alias("auc")))
    return out
