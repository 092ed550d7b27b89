"""Decision-state operators on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from braidline.operators import decisions

OPTIONS = "session_id bigint, place bigint, candidates array<struct<name:string,cost:bigint,risk:double>>"


def test_wide_beam_is_exhaustive(spark):
    rng = random.Random(2)
    atoms = [[(n, rng.randrange(1, 40), r) for n, r in (("raw", 0.0), ("cut", 0.01), ("omit", 0.2))] for _ in range(6)]
    df = spark.createDataFrame([(1, i, o) for i, o in enumerate(atoms)], OPTIONS)
    for budget in (200, 3):
        got = decisions.compile_beam(df, budget, width=10_000).orderBy("place").collect()
        every = [(sum(c for _, c, _ in p), sum(r for _, _, r in p), tuple(n for n, _, _ in p)) for p in itertools.product(*atoms)]
        rank = lambda s: (s[0] + decisions.RISK_WEIGHT * s[1], s[0], s[1], s[2])
        fits = [s for s in every if s[0] <= budget]
        best = min(fits, key=rank) if fits else min(every, key=lambda s: (s[1], s[0], s[2]))
        assert tuple(r.choice for r in got) == best[2] and all(r.feasible == bool(fits) for r in got)


def test_card_ladder(spark):
    df = spark.createDataFrame([(1, 1, 30, 10), (1, 2, 30, 10), (1, 3, 30, 10), (1, 4, 30, 10), (1, 5, 30, 10)], "session_id bigint, k bigint, full bigint, compact bigint")
    forms = [r.form for r in decisions.form_ladder(df, [F.col("k")], 55).orderBy("place").collect()]
    assert forms == ["full", "compact", "compact", "minimal", "none"]


def test_align_views(spark):
    views = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 9), (1, 3, 0)], "session_id bigint, view bigint, last_selected bigint")
    responses = spark.createDataFrame([(1, 2), (1, 4), (1, 6)], "session_id bigint, ordinal bigint")
    assert {r.view: r.ordinal for r in decisions.align_views(views, responses).collect()} == {0: 2, 1: 4, 2: 6, 3: None}


def test_consensus_needs_the_same_items(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, d string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "id bigint, d string")
    assert {r.id: (r.agreed, r.d) for r in decisions.consensus(a, b, "id", ["d"]).collect()} == {1: (True, "x"), 2: (False, "uncertain")}
    with pytest.raises(ValueError, match="same items"):
        decisions.consensus(a, b.where("id = 1"), "id", ["d"])


def test_compress_refuses_what_is_not_safe(spark):
    rows = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, True), (1, "c", 3, False)], "session_id bigint, node_id string, step_id bigint, removable boolean")
    summary, archived = decisions.compress(rows, rows.where("removable"))
    assert summary.first().sources == ["a", "b"] and archived.count() == 2
    with pytest.raises(ValueError, match="not safe"):
        decisions.compress(rows, rows)
