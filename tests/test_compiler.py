"""Compilation of states against all combinations, and what verification rejects."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from braidline.operators import compiler

OPTIONS = "session_id bigint, place bigint, candidates array<struct<name:string,cost:bigint,risk:double>>"


def test_exact_is_the_best_of_all_combinations(spark):
    """Budgets that nothing, something and everything fits into; ties in cost and risk; free and repeated forms."""
    rng = random.Random(9)
    options = {(s, p): [(f"{n}{i}", rng.randrange(0, 12) * (s + 1), rng.choice((0.0, 0.01, 0.02, 0.05))) for i, n in enumerate("abc"[: rng.randrange(1, 4)])] for s in range(5) for p in range(7)}
    atoms = spark.createDataFrame([(s, p, o) for (s, p), o in options.items()], OPTIONS)
    for budget in (0, 25, 60, 10_000):
        got = {}
        for r in compiler.compile_exact(atoms, budget).collect():
            got.setdefault(r.session_id, []).append(r)
        for s in range(5):
            rows = sorted(got[s], key=lambda r: r.place)
            cost, micro = sum(r.cost for r in rows), sum(round(r.risk * 1e6) for r in rows)
            assert all((r.choice, r.cost, r.risk) in options[s, r.place] for r in rows)
            every = [(sum(c[1] for c in pick), sum(round(c[2] * 1e6) for c in pick)) for pick in itertools.product(*[options[s, p] for p in range(7)])]
            fits = [c for c in every if c[0] <= budget]
            want = min(fits, key=lambda c: (c[0] * 1_000_000 + 512 * c[1], c[0])) if fits else min(every, key=lambda c: (c[1], c[0]))
            assert (cost, micro) == want and {r.feasible for r in rows} == {bool(fits)}
    with pytest.raises(Exception, match="no candidate"):
        compiler.compile_exact(atoms.withColumn("candidates", F.slice("candidates", 1, 0)), 9).count()
    assert compiler.compile_exact(atoms.where("false"), 9).count() == 0


def test_one_search_serves_all_budgets(spark):
    rng = random.Random(3)
    atoms = spark.createDataFrame([(s, p, [(n, rng.randrange(1, 30), rng.random() / 10) for n in "abc"]) for s in range(3) for p in range(9)], OPTIONS)
    many = {(r.session_id, r.budget, r.place): (r.choice, r.feasible) for r in compiler.compile_budgets(atoms, (40, 90, 200)).collect()}
    for budget in (40, 90, 200):
        one = {(r.session_id, budget, r.place): (r.choice, r.feasible) for r in compiler.compile_beam(atoms, budget).collect()}
        assert one == {k: v for k, v in many.items() if k[1] == budget}


def test_sessions_are_searched_side_by_side(spark):
    """Sessions of unlike lengths at once, with ties in cost and risk, end as each does alone; columns that are kept stay with their atoms."""
    rng = random.Random(5)
    options = {(s, p): [(n, rng.choice((0, 1, 2, 18)), rng.choice((0.0, 0.01, 0.02))) for n in rng.sample("abcdef", rng.randrange(1, 6))] for s in range(9) for p in range(1 + 3 * s)}
    atoms = spark.createDataFrame([(s, p, o, f"{s}-{p}") for (s, p), o in options.items()], f"{OPTIONS}, atom_id string").repartition(1)
    for width in (2, 16):
        got = {}
        for r in compiler.compile_budgets(atoms, (4, 30), width, keep=("atom_id",)).collect():
            assert r.atom_id == f"{r.session_id}-{r.place}" and (r.choice, r.cost, r.risk) in options[r.session_id, r.place]
            got.setdefault((r.session_id, r.budget), {})[r.place] = (r.choice, r.feasible)
        for s in range(9):
            beam = compiler._searched([[dict(name=n, cost=c, risk=x) for n, c, x in options[s, p]] for p in range(1 + 3 * s)], s, width)
            for budget in (4, 30):
                fits = [e for e in beam if e[0] <= budget]
                link = (min(fits, key=lambda e: (e[0] + compiler.RISK_WEIGHT * e[1], *e[:3])) if fits else min(beam, key=lambda e: (e[1], e[0], e[2])))[3]
                names = []
                while link:
                    names.append(link[1]["name"])
                    link = link[0]
                assert got[s, budget] == {p: (n, bool(fits)) for p, n in enumerate(reversed(names))}


def test_only_what_holds_is_compiled(spark):
    """A claim of an unverified atom, a handle without content, and atoms without sources or with sources that are no events."""
    columns = "session_id bigint, atom_id string, step_id bigint, atom_type string, key string, value string, hard boolean, verified boolean, archived boolean, omit_allowed boolean, probability double, sources array<string>, raw_ref string"
    rows = [
        (1, "a", 1, "slot_value", "k", "v", False, True, True, True, 0.05, ["e1"], "d1"),
        (1, "b", 2, "slot_value", "k", None, True, False, True, False, 1.0, ["e1", "e2"], "lost"),
        (2, "c", 1, "known_fact", "k", "v", False, True, False, True, 0.1, ["e1"], None),
    ]
    events = spark.createDataFrame([(1, "e1"), (1, "e2"), (2, "e1"), (2, "e1")], "session_id bigint, node_id string")
    archive = spark.createDataFrame([("d1",), ("d1",)], "digest string")
    masked = spark.createDataFrame(rows, columns)
    options = compiler.verified(compiler.candidates_of(masked), masked, events, archive)
    got = {r.atom_id: ({c.name for c in r.candidates}, r.rejected) for r in options.collect()}
    assert got == {"a": ({"raw_message", "structured_state_delta", "verified_summary", "archive_handle", "omit"}, 0), "b": ({"raw_message"}, 2), "c": ({"raw_message", "structured_state_delta", "verified_summary", "omit"}, 0)}
    out = {r.session_id: r for r in compiler.compile_state(masked, events, archive, 5, 6).collect()}
    assert out[1].fallback and out[1].hard_exceeded and out[1].budget_errors == 1 and out[1].rejected == 2
    assert out[2].feasible and not out[2].budget_errors and not any(r.provenance_errors or r.hard_coverage_errors for r in out.values())
    for sources in (["nowhere"], []):
        bad = masked.where("atom_id = 'c'").withColumn("sources", F.array(*[F.lit(x) for x in sources]).cast("array<string>"))
        with pytest.raises(Exception, match="no candidate"):
            compiler.compile_state(bad, events, archive, 5, 6).count()


def test_forms_are_read_once_for_all_prefixes():
    """What a form costs is read once, not for each prefix that it may follow; ties go to the names chosen before."""

    class Form(dict):
        reads = 0

        def __getitem__(self, name):
            Form.reads += name == "cost"
            return super().__getitem__(name)

    beam = compiler._searched([[Form(name=n, cost=1, risk=0.0) for n in "ba"] for _ in range(4)], 0, 16)
    assert Form.reads == 8 and len(beam) == 16
    named = []
    for *_, link in sorted(beam, key=lambda s: s[2]):
        names = []
        while link:
            names.append(link[1]["name"])
            link = link[0]
        named.append("".join(reversed(names)))
    assert named == ["".join(x) for x in itertools.product("ab", repeat=4)]
