"""Statistics over trials, pairs, annotators and predictions; gates over metrics."""

from __future__ import annotations

import random
import statistics
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.operators.ranges import greatest_before
from braidline.scratch import table


def pass_hat_k(trials: DataFrame, task: list[str], success: str, most: int | None = None) -> DataFrame:
    """(k, pass_hat_k, tasks): the mean over tasks of C(successes, k) / C(trials, k), for k up to the fewest trials of a task, or to most.

    Tasks with equal counts are one row. The quotient is a running product over k, so each count costs its k, not k squared.
    """
    tasks = trials.groupBy(*task).agg(F.count("*").alias("n"), F.sum(F.col(success).cast("bigint")).alias("c"))
    kinds = table(tasks.groupBy("n", "c").agg(F.count("*").alias("tasks")), "trial-counts")
    least = kinds.agg(F.min("n").alias("least")).first().least
    if least is None:
        return kinds.select(F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("pass_hat_k"), "tasks").limit(0)
    rows = kinds.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(min(least, most or least)).cast("bigint"))))
    left = F.col("c") - F.col("k") + 1
    # Where no success is left the chance is zero; before that, a sum of logarithms.
    upto = Window.partitionBy("n", "c").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.when(left > 0, F.log(left / (F.col("n") - F.col("k") + 1))).otherwise(0.0)).over(upto)
    rows = rows.withColumn("chance", F.when(left > 0, F.exp(logs)).otherwise(0.0))
    return rows.groupBy("k").agg((F.sum(F.col("chance") * F.col("tasks")) / F.sum("tasks")).alias("pass_hat_k"), F.sum("tasks").alias("tasks"))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of the discordant counts; null without any. The binomial tail is summed by its recurrence."""
    n, low = only_a + only_b, F.least(only_a, only_b)
    first = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("term"), F.pow(F.lit(0.5), n.cast("double")).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    tail = F.when(low == 0, first["total"]).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(low, F.lit(1))), first, step)["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * tail))


def holm(p_values: DataFrame, name: str = "name", p: str = "p") -> DataFrame:
    """p_values with holm_p: step-down adjustment in the order of p, then name. One row for each comparison: a driver-sized table."""
    ranked = Window.orderBy(F.col(p).asc_nulls_last(), name)
    m = p_values.where(F.col(p).isNotNull()).agg(F.count("*").alias("m"))
    raw = p_values.join(F.broadcast(m)).withColumn("raw", F.least(F.lit(1.0), (F.col("m") - F.row_number().over(ranked) + 1) * F.col(p)))
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("holm_p", F.when(F.col(p).isNotNull(), F.max("raw").over(upto))).drop("m", "raw")


#: Kappa where chance agreement is certain: of full agreement, and of any other, which some reports leave undefined.
DEGENERATE = {"zero": (1.0, 0.0), "undefined": (1.0, None)}


def agreement(pairs: DataFrame, a: str, b: str, degenerate: str = "zero", categories: tuple | None = None) -> DataFrame:
    """One row: n, observed agreement, Cohen's kappa and Gwet's AC1 of two raters.

    degenerate: a rule of DEGENERATE. categories: those that count, where that is not what the raters used; others add nothing to chance.
    """
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb")), F.struct(F.col("b").alias("c"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb")))).alias("s")).select("s.*")
    marginal = sides.groupBy("c").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    if categories is not None:
        marginal = marginal.where(F.col("c").isin(*categories))
    total = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("same"))
    both = marginal.join(F.broadcast(total))
    share = (F.col("na") + F.col("nb")) / (2 * F.col("n"))
    sums = both.agg(F.max("n").alias("n"), F.max("same").alias("same"), F.sum(F.col("na") / F.col("n") * (F.col("nb") / F.col("n"))).alias("chance"), F.sum(share * (1 - share)).alias("spread"), (F.count("*") if categories is None else F.lit(len(categories))).alias("q"))
    observed = F.col("same") / F.col("n")
    ac = F.col("spread") / (F.col("q") - 1)
    full, other = (F.lit(x).cast("double") for x in DEGENERATE[degenerate])
    flat = F.when(observed == 1.0, 1.0).otherwise(0.0)
    return sums.select(
        F.col("n").cast("bigint").alias("n"),
        observed.alias("observed"),
        F.when(F.col("chance") == 1.0, F.when(observed == 1.0, full).otherwise(other)).otherwise((observed - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"),
        F.when(F.col("q") < 2, 1.0).when(ac == 1.0, flat).otherwise((observed - ac) / (1 - ac)).alias("ac1"),
    )


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall); null where a rate has no denominator."""
    cells = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.col("a") == F.col("p")
    parts = cells.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn")))).alias("x")).select("x.*")
    sums = parts.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def calibration(rows: DataFrame, p: str, harm: str, bins: int = 10, threshold: float = 0.5) -> DataFrame:
    """One row: n, Brier score, that of a constant prediction, the expected calibration error over equal bins, and the recall of harm at a threshold."""
    y = F.col(harm).cast("double")
    by_bin = rows.select(F.col(p).alias("p"), y.alias("y"), F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"), F.sum(F.when(F.col("p") >= threshold, F.col("y")).otherwise(0.0)).alias("hit"))
    sums = by_bin.agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("sy").alias("sy"), F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"))
    rate = F.col("sy") / F.col("n")
    return sums.select("n", (F.col("sq") / F.col("n")).alias("brier"), (rate * (1 - rate)).alias("constant_brier"), (F.col("gap") / F.col("n")).alias("ece"), F.try_divide(F.col("hit"), F.col("sy")).alias("recall"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """The ceil(q n)-th smallest value of each group."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({q}) within group (order by {value})").alias(f"p{round(q * 100)}") for q in quantiles])


def pareto(rows: DataFrame, cost: str, gain: str) -> DataFrame:
    """rows with dominated: another one costs no more and gains no less, one of both strictly.

    The best gain of each cost, and the best of all lower costs over ranges of costs: no self join, and no task that sees all rows.
    """
    best = rows.groupBy(F.col(cost).alias("cost_")).agg(F.max(gain).alias("best_"))
    front = greatest_before(best, "cost_", "best_", "cheaper_")
    joined = rows.join(front, F.col(cost).eqNullSafe(F.col("cost_")), "left")
    return joined.withColumn("dominated", (F.col(gain) < F.col("best_")) | F.coalesce(F.col("cheaper_") >= F.col(gain), F.lit(False))).drop("cost_", "best_", "cheaper_")


def paired_bootstrap(deltas: DataFrame, group: str, delta: str, samples: int = 10_000, seed: int = 300) -> DataFrame:
    """(group, n, mean_delta, ci95_low, ci95_high) by resampling with the Mersenne Twister, as stored reports do; a group is one comparison's pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values([delta])[delta].tolist()
        rng, n = random.Random(seed), len(values)
        means = sorted(statistics.fmean(values[rng.randrange(n)] for _ in range(n)) for _ in range(samples))
        low, high = max(0, int(np.floor(0.025 * (samples - 1)))), min(samples - 1, int(np.ceil(0.975 * (samples - 1))))
        return pd.DataFrame([{group: pdf[group].iloc[0], "n": n, "mean_delta": statistics.fmean(values), "ci95_low": means[low], "ci95_high": means[high]}])

    kind = deltas.schema[group].dataType.simpleString()
    return deltas.select(group, F.col(delta).cast("double").alias(delta)).groupBy(group).applyInPandas(run, f"{group} {kind}, n bigint, mean_delta double, ci95_low double, ci95_high double")


def variant_bootstrap(deltas: DataFrame, group: str, delta: str, samples: int = 10_000, seed: int = 20260721) -> DataFrame:
    """(group, n, mean_delta, ci95_low, ci95_high) as matrix reports have it: bounds cut off on both sides, one value is its own interval, and the seed is that
    of the group's place by name."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values([delta])[delta].tolist()
        rng = random.Random(seed + int(pdf["place_"].iloc[0]))
        if len(values) == 1:
            low = high = values[0]
        else:
            means = sorted(statistics.fmean(rng.choice(values) for _ in values) for _ in range(samples))
            low, high = means[int(0.025 * (samples - 1))], means[int(0.975 * (samples - 1))]
        return pd.DataFrame([{group: pdf[group].iloc[0], "n": len(values), "mean_delta": statistics.fmean(values), "ci95_low": low, "ci95_high": high}])

    kind = deltas.schema[group].dataType.simpleString()
    names = deltas.select(group).distinct().withColumn("place_", F.row_number().over(Window.orderBy(group)) - 1)  # one row a measure
    rows = deltas.where(F.col(delta).isNotNull()).select(group, F.col(delta).cast("double").alias(delta)).join(F.broadcast(names), group)
    return rows.groupBy(group).applyInPandas(run, f"{group} {kind}, n bigint, mean_delta double, ci95_low double, ci95_high double")


def hash_bootstrap(deltas: DataFrame, group: str, key: str, delta: str, samples: int = 10_000, seed: str = "300") -> DataFrame:
    """(group, n, mean_delta, ci95_low, ci95_high) of a bootstrap without a generator: each value weighs a Poisson(1) count from the hash of seed, sample and key.

    Every engine draws the same. Values meet the samples in partial sums, so groups of any size resample without being gathered.
    """
    draws = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: poisson(F.sha2(F.concat_ws(":", F.lit(seed), i.cast("string"), F.col(key).cast("string")), 256)))
    rows = deltas.where(F.col(delta).isNotNull()).select(group, F.col(delta).cast("double").alias("d"), F.posexplode(draws).alias("sample", "w"))
    means = rows.groupBy(group, "sample").agg(F.try_divide(F.sum(F.col("d") * F.col("w")), F.sum("w")).alias("m"))
    low, high = 0.025, 0.975
    bounds = means.where("m is not null").groupBy(group).agg(F.expr(f"percentile_disc({low}) within group (order by m)").alias("ci95_low"), F.expr(f"percentile_disc({high}) within group (order by m)").alias("ci95_high"))
    plain = deltas.where(F.col(delta).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(delta).cast("double")).alias("mean_delta"))
    return plain.join(bounds, group)


#: Sixteen-bit thresholds of the counts of a Poisson distribution of mean one.
POISSON = (24109, 48218, 60273, 64291, 65295, 65496, 65530)


def poisson(digest: Column) -> Column:
    """A Poisson(1) count from the first four hex digits of a hash."""
    x = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    return reduce(lambda a, b: a + b, [(x >= t).cast("int") for t in POISSON])


def logistic(rows: DataFrame, features: list[str], label: str, l2: float = 0.01, tolerance: float = 1e-9, most: int = 50) -> dict[str, float]:
    """Bias and weights of a logistic regression over standardized features: the least mean log loss plus l2 / 2 of the squared weights.

    Newton steps, each one aggregate over all rows, until no weight moves by more than tolerance: some six passes, where
    descent along the gradient takes thousands. A null feature is zero. An empty table or a label of one kind gives the bounded log odds alone.
    """
    plain = rows.select(F.col(label).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    stats = plain.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    share = min(1 - 1e-6, max(1e-6, stats.y or 0.0))
    w = np.array([np.log(share / (1 - share)), *[0.0] * len(features)])
    if not stats.n or share in (1e-6, 1 - 1e-6):
        return {"bias": float(w[0]), **dict.fromkeys(features, 0.0)}
    x = [F.lit(1.0), *[(F.col(c) - stats[f"mean_{c}"]) / max(stats[f"std_{c}"], 1e-9) for c in features]]
    at = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    penalty = np.diag([0.0, *[l2] * len(features)])
    for _ in range(most):
        z = reduce(lambda a, b: a + b, [c * float(v) for c, v in zip(x, w, strict=True)])
        p = 1 / (1 + F.exp(-z))
        sums = plain.agg(*[F.avg((p - F.col("y")) * c).alias(f"g{i}") for i, c in enumerate(x)], *[F.avg(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in at]).first()
        hessian = np.zeros((len(x), len(x)))
        for i, j in at:
            hessian[i, j] = hessian[j, i] = sums[f"h{i}_{j}"]
        step = np.linalg.solve(hessian + penalty + 1e-12 * np.eye(len(x)), np.array([sums[f"g{i}"] for i in range(len(x))]) + penalty @ w)
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    return {"bias": float(w[0]), **{c: float(v) for c, v in zip(features, w[1:], strict=True)}}


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """thresholds (gate, metric, comparator, threshold) with the observed value and passed; a missing metric fails."""
    joined = thresholds.join(metrics.select("metric", "value"), "metric", "left")
    v, t, c = F.col("value"), F.col("threshold"), F.col("comparator")
    verdict = F.when(c == "at_least", v >= t).when(c == "at_most", v <= t).when(c == "below", v < t).when(c == "above", v > t).when(c == "equal", v == t)
    return joined.withColumn("passed", F.coalesce(verdict, F.lit(False)))


def representation_harm(rows: DataFrame) -> DataFrame:
    """One row: whether all branches are there, and in how many prefixes the compiled one alone does harm, breaks policy, or differs from dropping.

    rows: (prefix_id, replicate, treatment in raw_message, compiled, drop, harm, policy, tokens), one for each branch.
    """
    twice = rows.groupBy("prefix_id", "replicate", "treatment").count().where("count > 1 or treatment not in ('raw_message', 'compiled', 'drop')").limit(1).count()
    if twice:
        raise ValueError("each branch has one result, of a treatment that is known")
    of = lambda c, x: F.max(F.when(F.col("treatment") == x, F.col(c)))
    wide = rows.groupBy("prefix_id", "replicate").agg(of("harm", "raw_message").alias("rh"), of("harm", "compiled").alias("ch"), of("harm", "drop").alias("dh"), of("policy", "raw_message").alias("rp"), of("policy", "compiled").alias("cp"), of("tokens", "raw_message").alias("rt"), of("tokens", "compiled").alias("ct"))
    whole = F.col("rh").isNotNull() & F.col("ch").isNotNull() & F.col("dh").isNotNull()
    yes = lambda c: F.max(F.coalesce(whole & c, F.lit(False)))
    per = wide.groupBy("prefix_id").agg(F.min(whole).alias("whole"), yes(F.col("ch") & ~F.col("rh")).alias("harm"), yes(F.col("cp") & ~F.col("rp")).alias("policy"), yes(F.col("ch") != F.col("dh")).alias("apart"), yes(~F.col("ch") & F.col("dh")).alias("better"))
    n = lambda c: F.sum(F.col(c).cast("bigint"))
    sums = per.agg(F.min("whole").alias("complete_branches"), n("harm").alias("unique_harm_prefixes"), n("policy").alias("unique_policy_prefixes"), n("apart").alias("discordant_prefixes"), F.try_divide(n("better").cast("double"), n("apart")).alias("compiled_better_share"))
    cut = wide.where(whole & (F.col("rt") != 0)).agg(F.median((F.col("rt") - F.col("ct")) / F.col("rt")).alias("median_input_reduction"))
    return sums.join(F.broadcast(cut))  # one row each


def stratified(rows: DataFrame, stratum: list[str], key: str, limit: int, seed: str = "0") -> DataFrame:
    """A round-robin sample over strata: the first of each in hash order, then the second of each, until limit."""
    order = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*stratum).orderBy(order, key)))
    return ranked.where(F.col("turn") <= limit).orderBy("turn", *stratum).limit(limit)

