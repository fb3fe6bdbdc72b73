"""Action tokenizers: uniform, percentile and quantile bins, and mu-law."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A strategy's name to the function that fits it: rows ``dim, x`` and the number of bins to a tokenizer.
STRATEGIES: dict[str, Callable[[DataFrame, int], Tokenizer]] = {}


def strategy(name: str):
    """Add a strategy under a name of its own."""

    def keep(made):
        if name in STRATEGIES:
            raise ValueError(f"there is a strategy named {name}")
        STRATEGIES[name] = made
        return made

    return keep


@dataclass
class Tokenizer:
    """A fitted strategy: edges of each dimension's bins, or its scale for mu-law."""

    name: str
    bins: int
    edges: list[list[float]]
    scale: list[float]
    mu: float = 255.0

    def save(self) -> str:
        return json.dumps({"name": self.name, "params": {k: v for k, v in asdict(self).items() if k != "name"}})

    @staticmethod
    def load(text: str) -> Tokenizer:
        raw = json.loads(text)
        return Tokenizer(raw["name"], **raw["params"])

    def encode(self, action: Column) -> Column:
        """``array<int>`` of bin numbers; NaN is the last bin."""
        if self.name == "mulaw":
            scale = F.array(*map(F.lit, self.scale))

            def token(x, s):
                y = F.signum(x) * F.log1p(self.mu * F.least(F.abs(x) / s, F.lit(1.0))) / math.log1p(self.mu)
                return F.greatest(F.lit(0), F.least(F.lit(self.bins - 1), F.floor((y + 1) / 2 * self.bins).cast("int")))

            return F.zip_with(action, scale, token)
        edges = F.array(*(F.array(*map(F.lit, e[1:-1])) for e in self.edges))
        return F.zip_with(action, edges, lambda x, e: F.when(F.isnan(x), self.bins - 1).otherwise(F.size(F.filter(e, lambda v: v <= x))))

    def decode(self, tokens: Column) -> Column:
        """Centres of the bins."""
        if self.name == "mulaw":
            scale = F.array(*map(F.lit, self.scale))

            def value(k, s):
                y = (k + 0.5) / self.bins * 2 - 1
                return F.signum(y) * (F.exp(F.abs(y) * math.log1p(self.mu)) - 1) / self.mu * s

            return F.zip_with(tokens, scale, value)
        centres = F.array(*(F.array(*(F.lit((a + b) / 2) for a, b in zip(e, e[1:], strict=False))) for e in self.edges))
        return F.zip_with(tokens, centres, lambda k, c: F.get(c, k))


def _even(spans: list[tuple[float, float]], name: str, bins: int) -> Tokenizer:
    return Tokenizer(name, bins, [np.linspace(a, b if b > a else a + 1, bins + 1).tolist() for a, b in spans], [])


@strategy("uniform-bins")
def _uniform(x: DataFrame, bins: int) -> Tokenizer:
    made = x.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("dim").collect()
    return _even([(r["lo"], r["hi"]) for r in made], "uniform-bins", bins)


@strategy("openvla-bins")
def _percentiles(x: DataFrame, bins: int) -> Tokenizer:
    made = x.groupBy("dim").agg(F.percentile("x", F.array(F.lit(0.01), F.lit(0.99))).alias("p")).orderBy("dim").collect()
    return _even([tuple(r["p"]) for r in made], "openvla-bins", bins)


@strategy("quantile-bins")
def _quantiles(x: DataFrame, bins: int) -> Tokenizer:
    share = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    edges = []
    for r in x.groupBy("dim").agg(F.percentile("x", share).alias("p")).orderBy("dim").collect():
        e = list(r["p"])
        for k in range(1, len(e)):  # strictly increasing
            e[k] = max(e[k], math.nextafter(e[k - 1], math.inf))
        edges.append(e)
    return Tokenizer("quantile-bins", bins, edges, [])


@strategy("mulaw")
def _mulaw(x: DataFrame, bins: int) -> Tokenizer:
    made = x.groupBy("dim").agg(F.max(F.abs("x")).alias("s")).orderBy("dim").collect()
    return Tokenizer("mulaw", bins, [], [r["s"] or 1.0 for r in made])


def fit(frames: DataFrame, name: str, action: str = "action", bins: int = 256) -> Tokenizer:
    """Fit one strategy on all actions that are not null; one aggregation over dimensions."""
    if name not in STRATEGIES:
        raise ValueError(f"no such strategy: {name}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name](frames.select(F.posexplode(action).alias("dim", "x")).where("x is not null"), bins)


def compare(frames: DataFrame, strategies: tuple[str, ...] | None = None, action: str = "action", bins: int = 256) -> DataFrame:
    """One row per strategy: errors of a round trip over all actions, and use of the vocabulary.

    ``dim_rmse`` has an error for each dimension, ``vocab_used`` is the share of token
    values that come in any dimension, ``compression`` the numbers a token stands for,
    and ``best`` marks the least mean error, the first by name on a tie.
    """
    found = None
    for name in strategies or tuple(STRATEGIES):
        t = fit(frames, name, action, bins)
        x = frames.where(F.col(action).isNotNull()).select(F.col(action).alias("a"), t.encode(F.col(action)).alias("k")).withColumn("b", t.decode(F.col("k")))
        x = x.select(F.posexplode(F.arrays_zip("a", "b", "k")).alias("dim", "z")).select("dim", (F.col("z.a") - F.col("z.b")).alias("e"), F.col("z.k").alias("k"))
        per = x.groupBy("dim").agg(F.sum(F.col("e") * F.col("e")).alias("sq"), F.sum(F.abs("e")).alias("ab"), F.max(F.abs("e")).alias("mx"), F.count("e").alias("n"), F.collect_set("k").alias("ks"))
        n = F.sum("n")
        one = per.agg(
            F.lit(name).alias("strategy"), F.lit(bins).alias("vocab_size"), (F.sum("sq") / n).alias("mse"), (F.sum("ab") / n).alias("mae"), F.max("mx").alias("max_abs"),
            F.transform(F.array_sort(F.collect_list(F.struct("dim", F.sqrt(F.col("sq") / F.col("n")).alias("r")))), lambda s: s["r"]).alias("dim_rmse"),
            F.count("*").cast("double").alias("tokens_per_step"), F.lit(1.0).alias("compression"), F.least(F.lit(1.0), F.size(F.array_distinct(F.flatten(F.collect_list("ks")))) / F.lit(bins)).alias("vocab_used"),
        )
        found = one if found is None else found.unionByName(one)
    first = Window.orderBy("mae", "strategy")  # a row for each strategy
    return found.withColumn("best", F.row_number().over(first) == 1)


def with_tokens(frames: DataFrame, t: Tokenizer, action: str = "action", keep_actions: bool = False) -> DataFrame:
    """Adds ``action_tokens``, 64-bit, and drops the actions unless they are kept."""
    out = frames.withColumn("action_tokens", t.encode(F.col(action)).cast("array<bigint>"))
    return out if keep_actions else out.drop(action)
