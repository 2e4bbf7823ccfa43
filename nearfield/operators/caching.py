"""Access profiles, cache policies, hot-first labels, and the models and tables of a study."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut, numbered

#: Shares of the nodes that a cache may hold.
BUDGETS = (0.0001, 0.001, 0.01, 0.05, 0.1, 0.2)


def ranked(scores: DataFrame) -> DataFrame:
    """(id, score, rank from 1): highest score first, ties to the smaller id, numbered without a single task."""
    return numbered(scores, F.desc("score"), "id", name="rank", start=1).select("id", "score", "rank")


def profile_skew(profile: DataFrame, n: int, budgets: tuple = BUDGETS, column: str = "expand", top: int = 100_000) -> DataFrame:
    """One row: total, touched, greatest, entropy (bits), perplexity, Zipf slope, share of the top max(1, floor(b n)) for each budget."""
    r = ranked(profile.select("id", F.col(column).alias("score")))
    total = r.agg(F.sum("score").alias("t")).first().t or 0
    p = F.col("score") / F.lit(float(max(1, total)))
    on = F.col("score") > 0
    slope = F.regr_slope(F.when(on & (F.col("rank") <= top), F.log(F.col("score"))), F.when(on & (F.col("rank") <= top), F.log(F.col("rank").cast("double"))))
    shares = [F.sum(F.when(F.col("rank") <= max(1, int(b * n)), p)).alias(f"top_{b:g}".replace(".", "_").replace("-", "_")) for b in budgets]
    out = r.agg(F.sum("score").alias("total"), F.sum(on.cast("long")).alias("touched"), F.max("score").alias("greatest"), (-F.sum(F.when(on, p * F.log2(p)))).alias("entropy"), slope.alias("zipf_slope"), *shares)
    return out.withColumn("perplexity", F.pow(F.lit(2.0), "entropy"))


def policy_hit_rates(policies: dict[str, DataFrame], evaluation: DataFrame, n: int, budgets: tuple = BUDGETS) -> DataFrame:
    """(policy, budget, hot_nodes, hit): share of evaluation accesses (id, expand) to each policy's (id, score) first nodes.

    All policies are numbered together, each by the column of its kind of score, and a policy's numbers start after those before it.
    """
    total, spark = evaluation.agg(F.sum("expand").alias("t")).first().t or 0, evaluation.sparkSession
    kinds = sorted({scores.schema["score"].dataType.simpleString() for scores in policies.values()})
    value = lambda scores, kind: (F.col("score") if scores.schema["score"].dataType.simpleString() == kind else F.lit(None).cast(kind)).alias(f"score_{kinds.index(kind)}")
    rows = cut(functools.reduce(DataFrame.unionByName, (scores.select(F.lit(i).alias("place"), "id", *(value(scores, kind) for kind in kinds)) for i, scores in enumerate(policies.values()))))
    sizes = {r.place: r["count"] for r in rows.groupBy("place").count().collect()}
    before = list(itertools.accumulate((sizes.get(i, 0) for i in range(len(policies) - 1)), initial=0))
    rank = F.col("rank") - F.get(F.array(*map(F.lit, before)), F.col("place"))
    hit = numbered(rows, "place", *(F.desc(f"score_{i}") for i in range(len(kinds))), "id", name="rank", start=1).select("place", "id", rank.alias("rank")).join(evaluation.select("id", "expand"), "id")
    own = hit.groupBy("place").agg(*(F.sum(F.when(F.col("rank") <= max(1, int(b * n)), F.col("expand"))).alias(str(i)) for i, b in enumerate(budgets)))
    names = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("policy")) for i, name in enumerate(policies)))).alias("x")).select("x.*")
    share = lambda i: F.coalesce(F.col(str(i)), F.lit(0)) / F.lit(float(max(1, total)))
    row = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("budget"), F.lit(max(1, int(b * n))).alias("hot_nodes"), share(i).alias("hit")) for i, b in enumerate(budgets))))
    return names.join(own, "place", "left").select("policy", row.alias("x")).select("policy", "x.*")


def level_share(levels: DataFrame, profile: DataFrame, most: int = 12) -> DataFrame:
    """(level, nodes, share) of accesses by hop level, up to `most`."""
    total = profile.agg(F.sum("expand").alias("t")).first().t or 1
    return levels.join(profile.select("id", "expand"), "id").where(F.col("level") <= most).groupBy("level").agg(F.count("*").alias("nodes"), (F.sum("expand") / F.lit(float(total))).alias("share"))


def rank_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """corr of ranks by (score, id): a total order, so ties are defined."""
    x, y = ranked(a).select("id", F.col("rank").alias("x")), ranked(b).select("id", F.col("rank").alias("y"))
    return x.join(y, "id").agg(F.corr("x", "y").alias("rank_corr"))


def hot_labeling(scores: DataFrame, h: int) -> DataFrame:
    """(new_id, old_id): the h highest scores first, the others after them in their own order."""
    hot = ranked(scores).withColumn("cold", (F.col("rank") > h).cast("int"))
    key = F.when(F.col("cold") == 0, F.col("rank")).otherwise(F.col("id"))
    return numbered(hot.select("id", "cold", key.alias("k")), "cold", "k").select("new_id", F.col("id").alias("old_id"))


def train_share(profile: DataFrame, hot: DataFrame) -> DataFrame:
    """Share of the profile's accesses that go to hot ids."""
    own = profile.join(hot.select("id", F.lit(1).alias("h")), "id", "left")
    return own.agg((F.coalesce(F.sum(F.col("expand") * F.col("h")), F.lit(0)) / F.greatest(F.lit(1), F.sum("expand"))).alias("train_share"))


def cost_model(hit_rates: DataFrame, measured: DataFrame, t_raw: float, t_packed: float) -> DataFrame:
    """measured (budget, mean_us) against t_raw + (1 - hit) (t_packed - t_raw); budgets match within 1e-9, else null.

    Budgets are compared as whole multiples of 1e-9 and their two neighbours, an equi-join.
    """
    key = lambda c: F.round(F.col(c) * 1e9).cast("long")
    rates = hit_rates.select("policy", F.col("budget").alias("b"), "hit", F.explode(F.array(key("budget") - 1, key("budget"), key("budget") + 1)).alias("k"))
    rows = measured.withColumn("k", key("budget")).join(rates, "k", "left").where(F.col("b").isNull() | (F.abs(F.col("b") - F.col("budget")) < 1e-9))
    model = F.lit(t_raw) + (1 - F.col("hit")) * (t_packed - t_raw)
    return rows.select("policy", "budget", "hit", "mean_us", model.alias("model_us"), ((F.lit(t_packed) - F.col("mean_us")) / (t_packed - t_raw)).alias("recovered"))


def latency_at_recall(runs: DataFrame, targets: tuple = (0.95, 0.97, 0.99), order: str = "L") -> DataFrame:
    """(run, target, mean_us) interpolated in the first segment, by L or by recall, that brackets the target; null if none does."""
    own = Window.partitionBy("run").orderBy(order)
    seg = runs.select("run", F.col(order).alias("o"), F.col("recall").alias("r0"), F.col("mean_us").alias("t0"), F.lead("recall").over(own).alias("r1"), F.lead("mean_us").over(own).alias("t1"))
    goals = F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target")
    at = F.col("t0") + (F.col("target") - F.col("r0")) / (F.col("r1") - F.col("r0")) * (F.col("t1") - F.col("t0"))
    hit = seg.select("*", goals).where("r0 <= target and target <= r1 and r1 > r0").groupBy("run", "target").agg(F.min_by(at, "o").alias("mean_us"))
    return runs.select("run").distinct().select("run", goals).join(hit, ["run", "target"], "left")


def error_bars(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and sample deviation (0 for one run) by configuration."""
    return runs.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))


def latency_percentiles(times: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, p50 and p99 picked from the sorted values at n / 2 and min(n - 1, floor(0.99 n))."""
    own = Window.partitionBy(*by)
    rows = times.withColumn("_r", F.row_number().over(own.orderBy(value)) - 1).withColumn("_n", F.count("*").over(own))
    pick = lambda at, name: F.max(F.when(F.col("_r") == at, F.col(value))).alias(name)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), pick(F.floor(F.col("_n") / 2), "p50"), pick(F.least(F.col("_n") - 1, F.floor(F.col("_n") * 99 / 100)), "p99"))


def labeling_sweep(edges: DataFrame, labelings: dict[str, DataFrame], codecs: tuple, n: int, graph: str = "graph") -> DataFrame:
    """(graph, labeling, codec, edges, payload_bits, bits_per_edge) of each labeling (new_id, old_id) and codec."""
    from .codecs import store_size
    from .graph import relabel

    out = None
    for name, perm in labelings.items():
        own = edges if perm is None else cut(relabel(edges, perm))
        for codec in codecs:
            row = store_size(own, n, codec).select(F.lit(graph).alias("graph"), F.lit(name).alias("labeling"), "codec", "edges", "payload_bits", "bits_per_edge")
            out = row if out is None else out.union(row)
    return out
