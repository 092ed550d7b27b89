"""Compilation of decision states: each atom of a session is shown in one of its verified forms, within a budget.

candidates_of() makes the forms, verified() keeps those that events and archive bear out, compile_beam() and compile_exact() choose, and
compile_state() does all of it and checks what came out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidline.functions.text import estimate_tokens, truncated
from braidline.operators.checks import compilation_checks
from braidline.scratch import table

BEAM, RISK_WEIGHT = 16, 512.0
#: Forms that claim what an atom says.
CLAIMS = ("structured_state_delta", "verified_summary", "negative_guard")


def candidates_of(masked: DataFrame) -> DataFrame:
    """(session_id, place, atom_id, candidates array<struct<name, cost, risk>>): the verified ways to show each atom, and what leaving it out risks.

    masked: atoms after checks.risk_mask. A hard or protected atom has no omission; a handle needs an archive. Atoms are placed by step and id.
    """
    # What forms cost is read more than once, so it is a column of its own before the array of forms.
    masked = masked.withColumn("text", F.concat_ws(" ", "key", F.coalesce("value", F.lit(""))))
    masked = masked.withColumns({"whole": estimate_tokens(F.col("text")), "short": estimate_tokens(truncated(F.col("text"), 8)), "shorter": estimate_tokens(truncated(F.col("text"), 6))})
    guard = (F.col("atom_type") == "conflicting_fact") & F.col("verified")
    option = lambda name, cost, risk: F.struct(F.lit(name).alias("name"), cost.cast("bigint").alias("cost"), risk.cast("double").alias("risk"))
    none = F.lit(0.0)
    ways = F.array(
        option("raw_message", F.col("whole") + 8, none),
        F.when(F.col("atom_type").isin("slot_value", "superseded_fact", "state_delta", "known_fact", "completed_operation"), option("structured_state_delta", F.col("whole"), none)),
        F.when(F.col("verified"), option("verified_summary", F.col("short"), F.when(F.col("hard"), 0.02).otherwise(0.01))),
        F.when(guard, option("negative_guard", F.col("shorter"), F.lit(0.015))),
        F.when(F.col("archived"), option("archive_handle", F.lit(18), F.when(F.col("hard"), 0.2).otherwise(0.03))),
        F.when(F.col("omit_allowed"), option("omit", F.lit(0), F.col("probability"))),
    )
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("step_id", "atom_id"))
    return masked.select("session_id", place.cast("bigint").alias("place"), "atom_id", F.filter(ways, lambda x: x.isNotNull()).alias("candidates"))


def verified(candidates: DataFrame, atoms: DataFrame, events: DataFrame, archive: DataFrame) -> DataFrame:
    """candidates with only the forms that hold, and rejected, their number: sources must be events, claims verified atoms, handles in the archive.

    atoms: (session_id, atom_id, sources, verified, raw_ref); events: (session_id, node_id); archive: (digest). An atom of which no form
    holds keeps an empty list, which compile_beam and compile_exact refuse.
    """
    known = events.select("session_id", F.col("node_id").alias("source")).distinct().withColumn("known", F.lit(True))
    traced = atoms.select("session_id", "atom_id", F.explode_outer("sources").alias("source")).join(known, ["session_id", "source"], "left")
    traced = traced.groupBy("session_id", "atom_id").agg(F.min(F.coalesce("known", F.lit(False))).alias("traced"))
    # Only atoms with a handle are looked up; the others never leave their session's part.
    handled = candidates.where(F.exists("candidates", lambda c: c["name"] == "archive_handle")).select("session_id", "atom_id")
    asked = atoms.where("raw_ref is not null").select("session_id", "atom_id", "raw_ref").join(handled, ["session_id", "atom_id"], "left_semi")
    stored = table(asked.join(archive.select(F.col("digest").alias("raw_ref")), "raw_ref", "left_semi").select("session_id", "atom_id"), "stored").withColumn("stored", F.lit(True))
    facts = atoms.select("session_id", "atom_id", "verified").join(traced, ["session_id", "atom_id"]).join(stored, ["session_id", "atom_id"], "left")
    facts = facts.select("session_id", "atom_id", "traced", F.coalesce("verified", F.lit(False)).alias("sure"), F.coalesce("stored", F.lit(False)).alias("stored"))
    rows = candidates.join(facts, ["session_id", "atom_id"])
    holds = F.filter("candidates", lambda c: F.col("traced") & (~c["name"].isin(*CLAIMS) | F.col("sure")) & ((c["name"] != "archive_handle") | F.col("stored")))
    return rows.withColumn("held", holds).select(*candidates.columns[:-1], F.col("held").alias("candidates"), (F.size("candidates") - F.size("held")).alias("rejected"))


def _searched(options: list, session: object, width: int) -> list[tuple]:
    """The width best ends of one session: (cost, risk, order of names, (prefix, option)). What _searched_together() finds is held to it."""
    beam: list[tuple] = [(0, 0.0, 0, None)]
    for some in options:
        if not len(some):
            raise ValueError(f"an atom of {session} has no candidate")
        named = [(int(c["cost"]), float(c["risk"]), c) for c in sorted(some, key=lambda c: c["name"])]
        # An order is the prefix's, then the name's: no two are equal, so that tuples never compare what follows it.
        grown = []
        for cost, risk, order, link in beam:
            for j, (more, worse, c) in enumerate(named, order * len(named)):
                a, b = cost + more, risk + worse
                grown.append((a + RISK_WEIGHT * b, a, b, j, link, c))
        best = sorted(grown)[:width]
        turn = {o: i for i, o in enumerate(sorted(s[3] for s in best))}  # names so far, as places among those kept
        beam = [(s[1], s[2], turn[s[3]], (s[4], s[5])) for s in best]
    return beam


#: Sessions searched at a time, and bytes of their ways back.
SESSIONS, WAYS = 512, 1 << 26


def _searched_together(first: np.ndarray, size: np.ndarray, start: np.ndarray, forms: np.ndarray, cost: np.ndarray, risk: np.ndarray, budgets: tuple[int, ...], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(form of each atom, whether something fits), a row for each budget: what _searched() finds, place by place for many sessions at once.

    first, size: of a session's atoms; start, forms: of an atom's forms, which are in order of their names. Prefixes lie in order of their names, so that
    sorts that keep equal ones in their order break ties by names.
    """
    order = np.argsort(-size, kind="stable")  # sessions that still have atoms are always the first ones
    first, size = first[order], size[order]
    a, b, live = np.zeros((len(order), 1), np.int64), np.zeros((len(order), 1)), np.ones(len(order), np.int64)
    ends_a, ends_b, ends = np.zeros((len(order), width), np.int64), np.zeros((len(order), width)), np.zeros(len(order), np.int64)
    ways = []
    for place in range(int(size[0])):
        m = int(np.searchsorted(-size, -place, side="left"))
        a, b, live = a[:m], b[:m], live[:m]
        at = first[:m] + place
        most = int(forms[at].max())
        some = np.arange(most) < forms[at][:, None]
        form = np.where(some, start[at][:, None] + np.arange(most), 0)
        grown_a = (a[:, :, None] + cost[form][:, None, :]).reshape(m, -1)
        grown_b = (b[:, :, None] + risk[form][:, None, :]).reshape(m, -1)
        there = ((np.arange(a.shape[1]) < live[:, None])[:, :, None] & some[:, None, :]).reshape(m, -1)
        total = np.where(there, grown_a + RISK_WEIGHT * grown_b, np.inf)
        best = np.argsort(total, axis=1, kind="stable")
        by = lambda x: np.take_along_axis(x, best, 1)
        t, c, d = by(total), by(grown_a), by(grown_b)
        turned = (t[:, 1:] == t[:, :-1]) & np.isfinite(t[:, 1:]) & ((c[:, 1:] < c[:, :-1]) | (c[:, 1:] == c[:, :-1]) & (d[:, 1:] < d[:, :-1]))
        again = np.flatnonzero(turned.any(axis=1))
        if len(again):
            best[again] = np.lexsort((grown_b[again], grown_a[again], total[again]), axis=1)
        kept, live = best[:, :width], np.minimum(live * forms[at], width)
        kept = np.sort(np.where(np.arange(kept.shape[1]) < live[:, None], kept, total.shape[1]), axis=1)
        kept[kept == total.shape[1]] = 0
        ways.append(((kept // most).astype(np.int32), (kept % most).astype(np.int32)))
        a, b = np.take_along_axis(grown_a, kept, 1), np.take_along_axis(grown_b, kept, 1)
        done = size[:m] == place + 1
        ends_a[:m][done, : a.shape[1]], ends_b[:m][done, : a.shape[1]], ends[:m][done] = a[done], b[done], live[done]
    there = np.arange(width) < ends[:, None]
    picked, fitting = np.zeros((len(budgets), len(start)), np.int64), np.zeros((len(budgets), len(order)), bool)
    for i, budget in enumerate(budgets):
        fits = there & (ends_a <= budget)
        best = np.lexsort((ends_b, ends_a, np.where(fits, ends_a + RISK_WEIGHT * ends_b, np.inf)), axis=1)[:, 0]
        least = np.lexsort((ends_a, np.where(there, ends_b, np.inf)), axis=1)[:, 0]
        fitting[i, order] = fits.any(axis=1)
        end = np.where(fits.any(axis=1), best, least)
        for place in range(len(ways) - 1, -1, -1):
            before, which = ways[place]
            m = len(before)
            at = first[:m] + place
            picked[i, at] = start[at] + which[np.arange(m), end[:m]]
            end[:m] = before[np.arange(m), end[:m]]
    return picked, fitting


def compile_budgets(atoms: DataFrame, budgets: tuple[int, ...], width: int = BEAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, budget, place, choice, cost, risk, feasible): for each atom a representation, under every budget, by one beam search.

    atoms: (session_id, place, candidates array<struct<name, cost, risk>>), one row for each atom in order; keep: further columns to give out. A beam keeps the
    width best prefixes by cost + RISK_WEIGHT x risk, cost, risk and names; it does not depend on the budget. Of its ends the best that fits wins, or
    the least risky if none does. Sessions are searched side by side, SESSIONS at a time at most; prefixes share what they
    have in common, so that a search holds width x atoms links. An atom without a candidate is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            rows, lengths = held.flatten(), np.diff(held.offsets.to_numpy())
            place = rows.field("place").to_numpy()
            session = np.repeat(np.arange(len(held)), lengths)
            turn = np.lexsort((place, session))
            rows, place = rows.take(pa.array(turn)), place[turn]
            some = rows.field("candidates")
            forms = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not forms.all():
                raise ValueError(f"an atom of {batch.column('session_id')[int(session[np.flatnonzero(forms == 0)[0]])]} has no candidate")
            options = some.flatten()
            names = options.field("name").dictionary_encode()
            rank = np.argsort(np.argsort(np.array(names.dictionary.to_pylist(), object)))
            by_name = np.lexsort((rank[names.indices.to_numpy()], np.repeat(np.arange(len(forms)), forms)))
            options = options.take(pa.array(by_name))
            if options.field("cost").null_count or options.field("risk").null_count:
                raise ValueError("a candidate has no cost or no risk")
            cost, risk = options.field("cost").to_numpy().astype(np.int64), options.field("risk").to_numpy().astype(np.float64)
            first, start = np.cumsum(lengths) - lengths, np.cumsum(forms) - forms
            at = 0
            while at < len(lengths):
                longest = np.maximum.accumulate(lengths[at : at + SESSIONS])
                n = max(1, int(np.count_nonzero(np.arange(1, len(longest) + 1) * longest * width * 8 <= WAYS)))
                lo, hi = int(first[at]), int(first[at + n - 1] + lengths[at + n - 1])
                picked, fits = _searched_together(first[at : at + n] - lo, lengths[at : at + n], start[lo:hi], forms[lo:hi], cost, risk, budgets, width)
                which = pa.array(np.repeat(np.arange(at, at + n), lengths[at : at + n]))
                for i, budget in enumerate(budgets):
                    choice = options.take(pa.array(picked[i]))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "session_id": batch.column("session_id").take(which),
                            "budget": pa.array(np.full(hi - lo, budget, np.int64)),
                            "place": pa.array(place[lo:hi]),
                            "choice": choice.field("name"),
                            "cost": pa.array(cost[picked[i]]),
                            "risk": pa.array(risk[picked[i]]),
                            "feasible": pa.array(np.repeat(fits[i], lengths[at : at + n])),
                            **{c: rows.field(c).slice(lo, hi - lo) for c in keep},
                        }
                    )
                at += n

    kinds = {f.name: f.dataType.simpleString() for f in atoms.schema}
    held = F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), "candidates", *keep)).alias("held")
    out = f"session_id {kinds['session_id']}, budget bigint, place bigint, choice string, cost bigint, risk double, feasible boolean"
    return atoms.groupBy("session_id").agg(held).mapInArrow(run, ", ".join([out, *[f"{c} {kinds[c]}" for c in keep]]))


def compile_beam(atoms: DataFrame, budget: int, width: int = BEAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, place, choice, cost, risk, feasible): compile_budgets() under one budget."""
    return compile_budgets(atoms, (budget,), width, keep).drop("budget")


def compile_exact(atoms: DataFrame, budget: int, weight: int = int(RISK_WEIGHT)) -> DataFrame:
    """(session_id, place, choice, cost, risk, feasible): the choice of the least cost + weight x risk of all that fit, by dynamic programming.

    Risks count in millionths, so that sums are exact; ties go to the smaller cost. If nothing fits, every atom takes its
    least risk (then least cost, then name). The table has a column for each cost up to the budget or to all dearest forms, whichever is less; of its rows, one in
    every root of their number is kept and the others are made again on the way back: 2 x budget x root(atoms) cells.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        atoms_ = [sorted(((int(c["cost"]), round(float(c["risk"]) * 1e6), str(c["name"]), float(c["risk"])) for c in some), key=lambda c: c[2]) for some in part["candidates"]]
        if not all(atoms_):
            raise ValueError(f"an atom of {key[0]} has no candidate")
        feasible = sum(min(c[0] for c in some) for some in atoms_) <= budget
        if feasible:
            top, far = min(budget, sum(max(c[0] for c in some) for some in atoms_)), np.iinfo(np.int64).max // 4

            def step(row: np.ndarray, some: list) -> tuple[np.ndarray, np.ndarray]:
                """The least risk of each cost with one more atom, and which of its forms has it."""
                best, which = np.full(top + 1, far, np.int64), np.zeros(top + 1, np.int16)
                for j, (cost, risk, *_) in enumerate(some):
                    if cost <= top:
                        grown = np.full(top + 1, far, np.int64)
                        grown[cost:] = row[: top + 1 - cost] + risk
                        better = grown < best
                        best[better], which[better] = grown[better], j
                return np.minimum(best, far), which

            row = np.full(top + 1, far, np.int64)
            row[0] = 0
            stride = math.isqrt(len(atoms_)) + 1
            kept = []
            for i, some in enumerate(atoms_):
                if i % stride == 0:
                    kept.append(row)
                row = step(row, some)[0]
            cost = int(np.argmin(np.where(row < far, np.arange(top + 1) * 1_000_000 + row * weight, np.iinfo(np.int64).max)))
            picked: list = []
            for i in range(len(kept) - 1, -1, -1):
                row, ways = kept[i], []
                for some in atoms_[i * stride : (i + 1) * stride]:
                    row, which = step(row, some)
                    ways.append((some, which))
                for some, which in reversed(ways):
                    picked.append(some[which[cost]])
                    cost -= picked[-1][0]
            picked.reverse()
        else:
            picked = [min(some, key=lambda c: (c[1], c[0], c[2])) for some in atoms_]
        return pd.DataFrame({"session_id": key[0], "place": part["place"].to_numpy(), "choice": [c[2] for c in picked], "cost": [c[0] for c in picked], "risk": [c[3] for c in picked], "feasible": feasible})

    kind = atoms.schema["session_id"].dataType.simpleString()
    return atoms.select("session_id", "place", "candidates").groupBy("session_id").applyInPandas(run, f"session_id {kind}, place bigint, choice string, cost bigint, risk double, feasible boolean")


def compile_state(masked: DataFrame, events: DataFrame, archive: DataFrame, budget: int, hard: int) -> DataFrame:
    """One row a session: cost, risk, feasible, fallback, hard_exceeded, numbers of rejected, omitted and archived forms, and errors by check.

    masked: atoms after checks.risk_mask with raw_ref. What exceeds the soft budget falls back to the least risk and says so; what exceeds the hard
    limit is an error of the budget.
    """
    # The search, its places and all checks read the same forms and choices: without tables each of them would make them again.
    options = table(verified(table(candidates_of(masked), "candidates"), masked, events, archive), "forms")
    chosen = table(compile_beam(options, budget, keep=("atom_id", "rejected")), "choices", lies=True)
    form = F.col("choice")
    per = chosen.groupBy("session_id").agg(
        F.sum("cost").alias("cost"),
        F.round(F.sum("risk"), 6).alias("risk"),
        F.min("feasible").alias("feasible"),
        F.sum("rejected").alias("rejected"),
        F.sum((form == "omit").cast("bigint")).alias("omitted"),
        F.sum((form == "archive_handle").cast("bigint")).alias("handles"),
    )
    shown = chosen.select("session_id", form.alias("form"), "atom_id").join(masked.select("session_id", "atom_id", "sources"), ["session_id", "atom_id"])
    costs = per.select("session_id", "cost", F.lit(budget).alias("soft"), F.lit(hard).alias("hard"), (~F.col("feasible")).alias("infeasible"))
    found = compilation_checks(masked, shown, events, events.select("session_id").where("false"), costs)
    errors = found.groupBy("session_id").agg(*[F.max(F.when(F.col("check") == c, F.col("errors"))).alias(f"{c}_errors") for c in ("hard_coverage", "provenance", "budget")])
    return per.join(errors, "session_id").select("session_id", "cost", "risk", "feasible", (~F.col("feasible")).alias("fallback"), (F.col("cost") > hard).alias("hard_exceeded"), "rejected", "omitted", "handles", "hard_coverage_errors", "provenance_errors", "budget_errors")


def sweep(atoms: DataFrame, budgets: tuple[int, ...], raw: DataFrame) -> DataFrame:
    """(budget, points, hard coverage and fallback rates, median cost and reduction) of compilations under each budget, and which is the least that covers all and falls back in one of twenty at most.

    atoms: candidates_of() with hard; raw: (session_id, raw_tokens). One search serves all budgets.
    """
    done = compile_budgets(atoms, budgets, keep=("hard",))
    per = done.groupBy("session_id", "budget").agg(F.sum("cost").alias("cost"), F.min(~F.col("hard") | (F.col("choice") != "omit")).alias("covered"), F.min("feasible").alias("feasible")).join(raw, "session_id")
    rows = per.groupBy("budget").agg(F.count("*").alias("points"), F.avg(F.col("covered").cast("double")).alias("hard_coverage_rate"), F.avg((~F.col("feasible")).cast("double")).alias("fallback_rate"), F.median("cost").alias("median_cost"), F.median(F.try_divide((F.col("raw_tokens") - F.col("cost")).cast("double"), F.col("raw_tokens"))).alias("median_reduction"))
    good = (F.col("hard_coverage_rate") == 1.0) & (F.col("fallback_rate") <= 0.05)
    return rows.withColumn("primary", F.coalesce(good & (F.col("budget") == F.min(F.when(good, F.col("budget"))).over(Window.partitionBy(F.lit(1)))), F.lit(False)))  # one row a budget
