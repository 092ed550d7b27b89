"""Queries of statistics, sets, identities and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidline.functions.identity import hash_share, opaque_names, split_name
from braidline.operators import stats
from braidline.plans.exchanges import EX
from braidline.plans.registry import Registry
from braidline.sources.adapters import event_exchanges

R = Registry()

#: Trials: a task is (domain, k), its trials are the exchanges of one condition (the parity of the session).
TRIALS = f"""{EX}, tr AS (SELECT k % 4 AS domain, k AS task, session_id % 2 AS condition, NOT err AS success, value FROM ex)"""


def _trials(t):
    return event_exchanges(t("events")).select((F.col("k") % 4).alias("domain"), F.col("k").alias("task"), (F.col("session_id") % 2).alias("condition"), (~F.col("err")).alias("success"), "value", "session_id", "ordinal")


@R.add(
    "pass_hat_k",
    f"""WITH RECURSIVE {TRIALS}, ta AS (SELECT domain, task, count(*) AS n, count(*) FILTER (success) AS c FROM tr GROUP BY domain, task), l AS (SELECT min(n) AS least FROM ta),
p AS (SELECT domain, task, n, c, 0 AS k, 1.0::DOUBLE AS chance FROM ta UNION ALL SELECT domain, task, n, c, k + 1, chance * greatest(c - k, 0) / (n - k)::DOUBLE FROM p, l WHERE k < least)
SELECT k, round(avg(chance), 9) AS pass_hat_k, count(*) AS tasks FROM p WHERE k > 0 GROUP BY k""",
)
def pass_hat_k(t):
    return stats.pass_hat_k(_trials(t), ["domain", "task"], "success").withColumn("pass_hat_k", F.round("pass_hat_k", 9))


CONDITION = "count(*) AS sessions, count(*) FILTER (success) AS successes, round(count(*) FILTER (success) / count(*)::DOUBLE, 9) AS success_rate, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value"


def _conditions(grouped):
    ok = F.sum(F.col("success").cast("bigint"))
    return grouped.agg(F.count("*").alias("sessions"), ok.alias("successes"), F.round(ok / F.count("*"), 9).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.median("value"), 6).alias("median_value"))


@R.add("condition_metrics", f"WITH {TRIALS} SELECT condition, {CONDITION} FROM tr GROUP BY condition")
def condition_metrics(t):
    return _conditions(_trials(t).groupBy("condition"))


@R.add("domain_condition_metrics", f"WITH {TRIALS} SELECT domain, condition, {CONDITION} FROM tr GROUP BY domain, condition")
def domain_condition_metrics(t):
    return _conditions(_trials(t).groupBy("domain", "condition"))


@R.add("group_metrics", f"WITH {TRIALS} SELECT domain, task, count(*) AS n, count(*) FILTER (success) AS successes FROM tr GROUP BY GROUPING SETS ((), (domain), (domain, task))")
def group_metrics(t):
    """Overall, by domain and by task in one pass."""
    return _trials(t).rollup("domain", "task").agg(F.count("*").alias("n"), F.sum(F.col("success").cast("bigint")).alias("successes"))


PAIRS = f"""{TRIALS}, pr AS (SELECT domain, task, count(*) FILTER (condition = 0 AND success) / nullif(count(*) FILTER (condition = 0), 0)::DOUBLE AS a, count(*) FILTER (condition = 1 AND success) / nullif(count(*) FILTER (condition = 1), 0)::DOUBLE AS b FROM tr GROUP BY domain, task)"""


def _pairs(t):
    rate = lambda c: F.avg(F.when(F.col("condition") == c, F.col("success").cast("double")))
    return _trials(t).groupBy("domain", "task").agg(rate(0).alias("a"), rate(1).alias("b"))


@R.add("paired_deltas", f"WITH {PAIRS} SELECT domain, task, round(b - a, 9) AS delta, CASE WHEN b > a THEN 'better' WHEN b < a THEN 'worse' WHEN b = a THEN 'same' ELSE 'unpaired' END AS direction FROM pr")
def paired_deltas(t):
    a, b = F.col("a"), F.col("b")
    return _pairs(t).select("domain", "task", F.round(b - a, 9).alias("delta"), F.when(b > a, "better").when(b < a, "worse").when(b == a, "same").otherwise("unpaired").alias("direction"))


_DRAW = "CAST(concat('0x', substr(sha256(concat_ws(':', 'seed', s, task)), 1, 4)) AS BIGINT)"


@R.add(
    "hash_bootstrap",
    f"""WITH {PAIRS}, dl AS (SELECT domain, task, b - a AS d FROM pr WHERE b - a IS NOT NULL), dw AS (SELECT domain, s, d, {" + ".join(f"CASE WHEN {_DRAW} >= {x} THEN 1 ELSE 0 END" for x in stats.POISSON)} AS w FROM dl, unnest(range(0, 400)) AS t(s)),
mm AS (SELECT domain, s, sum(d * w) / nullif(sum(w), 0) AS m FROM dw GROUP BY domain, s), bo AS (SELECT domain, quantile_disc(m, 0.025) AS lo, quantile_disc(m, 0.975) AS hi FROM mm GROUP BY domain)
SELECT domain, count(*) AS n, round(avg(d), 9) AS mean_delta, round(any_value(lo), 9) AS ci95_low, round(any_value(hi), 9) AS ci95_high FROM dl JOIN bo USING (domain) GROUP BY domain""",
)
def hash_bootstrap(t):
    """Four hundred samples that any engine draws alike."""
    pairs = _pairs(t).select("domain", "task", (F.col("b") - F.col("a")).alias("delta"))
    return stats.hash_bootstrap(pairs, "domain", "task", "delta", 400, "seed").withColumns({c: F.round(c, 9) for c in ("mean_delta", "ci95_low", "ci95_high")})


@R.add("variant_bootstrap")
def variant_bootstrap(t):
    """By domain, as matrix reports resample; SQL has no such generator."""
    return stats.variant_bootstrap(_pairs(t).where("a is not null and b is not null").select("domain", (F.col("b") - F.col("a")).alias("delta")), "domain", "delta")


@R.add("paired_bootstrap")
def paired_bootstrap(t):
    """By domain, with the Mersenne Twister that stored reports use; SQL has none."""
    return stats.paired_bootstrap(_pairs(t).where("a is not null and b is not null").select("domain", (F.col("b") - F.col("a")).alias("delta")), "domain", "delta")


DISCORDANT = f"""{PAIRS}, di AS (SELECT domain, count(*) FILTER (a > b) AS only_a, count(*) FILTER (b > a) AS only_b FROM pr GROUP BY domain),
bi AS (SELECT domain, only_a, only_b, only_a + only_b AS n, least(only_a, only_b) AS low FROM di),
tl AS (SELECT domain, sum(term) AS tail FROM (SELECT domain, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS term FROM bi, unnest(range(0, low + 1)) AS t(i)) GROUP BY domain),
mc AS (SELECT bi.*, CASE WHEN n > 0 THEN least(1, 2 * tail) END AS p FROM bi LEFT JOIN tl USING (domain))"""


def _mcnemar(t):
    counts = _pairs(t).groupBy("domain").agg(F.sum(F.when(F.col("a") > F.col("b"), 1).otherwise(0)).alias("only_a"), F.sum(F.when(F.col("b") > F.col("a"), 1).otherwise(0)).alias("only_b"))
    return counts.withColumn("p", stats.mcnemar(F.col("only_a"), F.col("only_b")))


@R.add("mcnemar_exact", f"WITH {DISCORDANT} SELECT domain, only_a, only_b, round(p, 8) AS p FROM mc")
def mcnemar_exact(t):
    return _mcnemar(t).withColumn("p", F.round("p", 8))


@R.add("holm_adjust", f"WITH {DISCORDANT}, rk AS (SELECT domain, p, least(1, (count(p) OVER () - row_number() OVER (ORDER BY p NULLS LAST, domain) + 1) * p) AS raw, row_number() OVER (ORDER BY p NULLS LAST, domain) AS place FROM mc) SELECT domain, round(p, 8) AS p, round(CASE WHEN p IS NOT NULL THEN max(raw) OVER (ORDER BY place) END, 8) AS holm_p FROM rk")
def holm_adjust(t):
    return stats.holm(_mcnemar(t).select("domain", "p"), "domain").select("domain", F.round("p", 8).alias("p"), F.round("holm_p", 8).alias("holm_p"))


@R.add(
    "kappa_ac1",
    """WITH l AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS same FROM l),
m AS (SELECT c, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM (SELECT a AS c, 'a' AS side FROM l UNION ALL SELECT b, 'b' FROM l) GROUP BY c),
s AS (SELECT max(n) AS n, max(same) / max(n) AS o, sum(na / n * (nb / n)) AS e, sum((na + nb) / (2 * n) * (1 - (na + nb) / (2 * n))) AS sp, count(*) AS q FROM m, t)
SELECT CAST(n AS BIGINT) AS n, round(o, 9) AS observed, round(CASE WHEN e = 1 THEN CASE WHEN o = 1 THEN 1 ELSE 0 END ELSE (o - e) / (1 - e) END, 9) AS kappa, round(CASE WHEN q < 2 THEN 1 WHEN sp / (q - 1) = 1 THEN CASE WHEN o = 1 THEN 1 ELSE 0 END ELSE (o - sp / (q - 1)) / (1 - sp / (q - 1)) END, 9) AS ac1 FROM s""",
)
def kappa_ac1(t):
    return stats.agreement(t("labels"), "quality", "toxic").withColumns({c: F.round(c, 9) for c in ("observed", "kappa", "ac1")})


@R.add(
    "kappa_rules",
    """WITH l AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b) AS same, count(*) FILTER (a = 1) AS a1, count(*) FILTER (b = 1) AS b1 FROM l),
s AS (SELECT n, same / n AS o, a1 / n * (b1 / n) AS e, ((a1 + b1) / (2 * n)) * (1 - (a1 + b1) / (2 * n)) / 2 AS ac FROM t)
SELECT r.rule, CAST(n AS BIGINT) AS n, round(o, 9) AS observed, round((o - e) / (1 - e), 9) AS kappa, round((o - ac) / (1 - ac), 9) AS ac1 FROM s, (SELECT unnest(['only_one', 'undefined']) AS rule) r
UNION ALL SELECT 'one_kind', count(*), 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM labels""",
)
def kappa_rules(t):
    """Agreement over a fixed list of categories, of which the raters use some, and of raters who say one thing only."""
    k = t("labels")
    fixed = stats.agreement(k, "quality", "toxic", categories=(1, 2, 3)).withColumn("rule", F.lit("only_one"))
    loose = stats.agreement(k, "quality", "toxic", "undefined", categories=(1, 2, 3)).withColumn("rule", F.lit("undefined"))
    same = stats.agreement(k.select(F.lit(1).alias("a"), F.lit(1).alias("b")), "a", "b", "undefined").withColumn("rule", F.lit("one_kind"))
    return fixed.union(loose).union(same).withColumns({c: F.round(c, 9) for c in ("observed", "kappa", "ac1")})


@R.add("confusion", "WITH k AS (SELECT quality AS a, toxic AS p FROM labels), l AS (SELECT unnest([0, 1]) AS label) SELECT label, count(*) FILTER (a = label AND p = label) AS tp, count(*) FILTER (a <> label AND p = label) AS fp, count(*) FILTER (a = label AND p <> label) AS fn, round(count(*) FILTER (a = label AND p = label) / nullif(count(*) FILTER (p = label), 0)::DOUBLE, 9) AS precision, round(count(*) FILTER (a = label AND p = label) / nullif(count(*) FILTER (a = label), 0)::DOUBLE, 9) AS recall FROM k, l GROUP BY label")
def confusion(t):
    return stats.confusion(t("labels"), "quality", "toxic").withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


#: Predictions of failure: the share of failures of the same operation before, in the session.
RISK = f"{EX}, rk AS (SELECT err, coalesce(avg(CASE WHEN err THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.2::DOUBLE) AS p FROM ex)"


def _risk(t):
    before = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    ex = event_exchanges(t("events"))
    return ex.select("err", "ordinal", "k", F.coalesce(F.avg(F.col("err").cast("double")).over(before), F.lit(0.2)).alias("p"))


@R.add("ece_brier", f"WITH {RISK}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(CASE WHEN err THEN 1.0::DOUBLE ELSE 0 END) AS sy, sum(pow(p - CASE WHEN err THEN 1.0::DOUBLE ELSE 0 END, 2)) AS sq, sum(CASE WHEN err AND p >= 0.25 THEN 1.0::DOUBLE ELSE 0 END) AS hit FROM rk GROUP BY 1), s AS (SELECT sum(n)::DOUBLE AS n, sum(hit) AS hit, sum(sq) AS sq, sum(sy) AS sy, sum(abs(sp - sy)) AS gap FROM b) SELECT CAST(n AS BIGINT) AS n, round(sq / n, 6) AS brier, round(sy / n * (1 - sy / n), 6) AS constant_brier, round(gap / n, 6) AS ece, round(hit / nullif(sy, 0), 6) AS recall FROM s")
def ece_brier(t):
    return stats.calibration(_risk(t), "p", "err", threshold=0.25).withColumns({c: F.round(c, 6) for c in ("brier", "constant_brier", "ece", "recall")})


@R.add("omission_risk")
def omission_risk(t):
    """Weights of a logistic model of failure, from the tasks of the training split; the optimizer has no SQL."""
    rows = _risk(t).withColumn("split", split_name(hash_share(F.col("k") % 4, F.col("k")))).where("split = 'train'")
    w = stats.logistic(rows.withColumns({"step": F.col("ordinal").cast("double"), "key": F.col("k").cast("double")}), ["p", "step", "key"], "err")
    return rows.sparkSession.createDataFrame([(k, float(v)) for k, v in w.items()], "feature string, weight double")


@R.add("pareto_frontier", "WITH p AS (SELECT l_suppkey AS id, count(*) AS cost, CAST(sum(l_quantity) AS BIGINT) AS gain FROM lineitem GROUP BY l_suppkey) SELECT id, cost, gain, EXISTS (SELECT 1 FROM p q WHERE q.cost <= p.cost AND q.gain >= p.gain AND (q.cost < p.cost OR q.gain > p.gain)) AS dominated FROM p")
def pareto_frontier(t):
    points = t("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("cost"), F.sum("l_quantity").cast("bigint").alias("gain"))
    return stats.pareto(points, "cost", "gain")


@R.add("hash_split", """WITH h AS (SELECT o_orderstatus, o_orderkey, cast(concat('0x', substr(sha256(concat('["', o_orderstatus, '","', o_orderkey, '"]')), 1, 12)) AS BIGINT) / power(16, 12) AS share FROM orders) SELECT o_orderkey, CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'validation' ELSE 'test' END AS split FROM h""")
def hash_split(t):
    return t("orders").select("o_orderkey", split_name(hash_share(F.col("o_orderstatus"), F.col("o_orderkey"))).alias("split"))


@R.add("archive_dedup", "SELECT concat('sha256:', sha256(text)) AS digest, count(*) AS copies, min(doc_id) AS first_doc, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY sha256(text)")
def archive_dedup(t):
    """Content addresses of documents: what a content-addressed store keeps once."""
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("h"), F.floor((F.octet_length("text") + 3) / 4).alias("tokens"))
    return d.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.sum("tokens").alias("tokens")).select(F.concat(F.lit("sha256:"), F.col("h")).alias("digest"), "copies", "first_doc", "tokens")


@R.add("opaque_ids", "WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id FROM events) SELECT user_id, concat('item_', lpad(CAST(row_number() OVER (ORDER BY sha256(concat('seed', chr(0), user_id)), user_id) AS VARCHAR), 6, '0')) AS opaque FROM u")
def opaque_ids(t):
    return opaque_names(t("events"), "user_id", "seed")


@R.add("stratified_sample", "WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256(concat('0', chr(0), o_orderkey)), o_orderkey) AS turn FROM orders) SELECT o_orderstatus, o_orderkey, turn FROM r ORDER BY turn, o_orderstatus LIMIT 60")
def stratified_sample(t):
    return stats.stratified(t("orders").select("o_orderstatus", "o_orderkey"), ["o_orderstatus"], "o_orderkey", 60).withColumn("turn", F.col("turn").cast("bigint"))


@R.add("termination_histogram", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def termination_histogram(t):
    per = t("events").groupBy("event_type", "user_id").agg(F.count("*").alias("c"))
    return per.groupBy("event_type").agg(F.sum("c").alias("n"), F.count("*").alias("users"))


@R.add("provider_usage", "SELECT role, count(*) AS messages, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS tokens, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY role")
def provider_usage(t):
    per = t("conversations").groupBy("role", "conv_id").agg(F.count("*").alias("m"), F.sum(F.floor((F.octet_length("text") + 3) / 4)).alias("k"))
    return per.groupBy("role").agg(F.sum("m").alias("messages"), F.sum("k").alias("tokens"), F.count("*").alias("sessions"))


@R.add("matrix_expand", "SELECT r_name AS domain, n_name AS task, c.condition, concat('m_', substr(sha256(concat_ws(chr(31), r_name, n_name, c.condition)), 1, 24)) AS run_id FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT unnest(['full', 'last_k', 'ours']) AS condition) c")
def matrix_expand(t):
    """Every condition for every task of every domain: a plan of runs, whose size is that of its inputs' product by intent."""
    from braidline.functions.identity import stable_id

    runs = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).withColumn("condition", F.explode(F.array(*[F.lit(c) for c in ("full", "last_k", "ours")])))
    return runs.select(F.col("r_name").alias("domain"), F.col("n_name").alias("task"), "condition", stable_id("m", F.col("r_name"), F.col("n_name"), F.col("condition")).alias("run_id"))


@R.add("set_operations", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'orphans', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_operations(t):
    d, k = t("documents").select("doc_id").distinct(), t("labels").select("doc_id").distinct()
    marks = d.withColumn("d", F.lit(1)).join(k.withColumn("k", F.lit(1)), "doc_id", "full")
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), c.cast("bigint").alias("n")) for n, c in (("both", F.col("d").isNotNull() & F.col("k").isNotNull()), ("unlabelled", F.col("k").isNull()), ("orphans", F.col("d").isNull()))]))
    return marks.select(parts.alias("p")).select("p.*").groupBy("part").agg(F.sum("n").alias("n"))


GATES = (("success", "success_rate", "at_least", 0.5), ("failures", "failure_rate", "at_most", 0.25), ("retries", "retry_rate", "below", 0.01), ("sessions", "empty_sessions", "equal", 0.0), ("unknown", "never_measured", "at_least", 0.0))


@R.add(
    "gate_report",
    f"""WITH {EX}, mt AS (SELECT 'success_rate' AS metric, avg(CASE WHEN err THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS value FROM ex UNION ALL SELECT 'failure_rate', avg(CASE WHEN err THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM ex UNION ALL SELECT 'retry_rate', avg(CASE WHEN prev_err THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM ex UNION ALL SELECT 'empty_sessions', 0.0),
th(gate, metric, comparator, threshold) AS (VALUES {', '.join(f"('{g}', '{m}', '{c}', {x}::DOUBLE)" for g, m, c, x in GATES)})
SELECT gate, metric, round(value, 9) AS value, threshold, coalesce(CASE comparator WHEN 'at_least' THEN value >= threshold WHEN 'at_most' THEN value <= threshold WHEN 'below' THEN value < threshold WHEN 'equal' THEN value = threshold END, false) AS passed FROM th LEFT JOIN mt USING (metric)""",
)
def gate_report(t):
    """Missing evidence fails."""
    ex = event_exchanges(t("events"))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    one = ex.agg(share(~F.col("err")).alias("success_rate"), share(F.col("err")).alias("failure_rate"), share(F.col("prev_err")).alias("retry_rate"))
    metrics = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns], F.struct(F.lit("empty_sessions").alias("metric"), F.lit(0.0).alias("value")))).alias("m")).select("m.*")
    thresholds = ex.sparkSession.createDataFrame(GATES, "gate string, metric string, comparator string, threshold double")
    return stats.gates(metrics, thresholds).select("gate", "metric", F.round("value", 9).alias("value"), "threshold", "passed")
