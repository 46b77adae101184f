"""Work lists of phases with gates between them.

What is known of each atom of work (done, failed, validated, and whatever else
decides a phase) is folded once to a bit mask; every phase is a condition on that
mask, and all phases of a unit are counted in one pass.  A phase is open when
the phases it needs have nothing left to do in the unit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.folders import written


@dataclass(frozen=True)
class Phase:
    """Atoms of ``kind`` for which ``only`` holds; done when ``done`` holds.  The
    conditions are SQL over ``has_<fact>`` (a boolean) and ``n_<fact>`` (how often)."""

    name: str
    kind: str
    done: str
    only: str = "true"
    failed: str = "false"
    needs: tuple[str, ...] = ()


def folded(facts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, mask, n_<fact>…) from facts (keys, fact): bit k of the mask tells
    whether the atom has the fact ``names[k]``; facts of other names are passed over.  Facts may
    also come counted, as rows (keys, n_<fact>…), several of one key added up."""
    if "fact" not in facts.columns:  # counted within their rows
        counts = [F.sum(f"n_{n}").alias(f"n_{n}") for n in names if f"n_{n}" in facts.columns]
        out = facts.groupBy(*keys).agg(*counts)
        out = out.select(*keys, *[F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") if f"n_{n}" in out.columns else F.lit(0).cast("long").alias(f"n_{n}") for n in names])
        return out.withColumn("mask", sum((F.when(F.col(f"n_{n}") > 0, F.lit(1 << k)).otherwise(0).cast("long") for k, n in enumerate(names)), F.lit(0).cast("long")))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("fact")) - 1
    counts = [F.count_if(F.col("fact") == n).alias(f"n_{n}") for n in names]
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))).alias("mask")
    return facts.where(F.col("fact").isin(*names)).groupBy(*keys).agg(bits, *counts)


def _known(atoms: DataFrame, facts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Atoms (unit, kind, atom, at) with has_<fact> and n_<fact>."""
    j = atoms.join(folded(facts, ["kind", "atom"], names).drop("mask"), ["kind", "atom"], "left").select(*atoms.columns, *[F.coalesce(f"n_{n}", F.lit(0).cast("long")).alias(f"n_{n}") for n in names])
    return j.select("*", *[(F.col(f"n_{n}") > 0).alias(f"has_{n}") for n in names])


def _state(p: Phase) -> tuple[Column, Column, Column]:
    mine = (F.col("kind") == p.kind) & F.coalesce(F.expr(p.only), F.lit(False))
    done = mine & F.coalesce(F.expr(p.done), F.lit(False))
    return mine, done, mine & ~done & F.coalesce(F.expr(p.failed), F.lit(False))


def work_lists(atoms: DataFrame, facts: DataFrame, names: Sequence[str], phases: Sequence[Phase]) -> DataFrame:
    """(unit, phase, total, done, failed, pending, open, next_atom): for every unit and
    phase how many atoms there are, are done, have failed (they are left out of
    the run) and wait; whether the phases it needs are through; and the first
    atom that waits, in the order of ``at`` and ``atom``."""
    return _lists(_known(atoms, facts, names), phases)


def _lists(j: DataFrame, phases: Sequence[Phase]) -> DataFrame:
    aggs = []
    for k, p in enumerate(phases):
        mine, done, failed = _state(p)
        waits = mine & ~done & ~failed
        aggs += [F.count_if(mine).alias(f"t{k}"), F.count_if(done).alias(f"d{k}"), F.count_if(failed).alias(f"f{k}"), F.min(F.when(waits, F.struct("at", "atom"))).alias(f"x{k}")]
    one = j.groupBy("unit").agg(*aggs)
    left = {p.name: F.col(f"t{k}") - F.col(f"d{k}") - F.col(f"f{k}") for k, p in enumerate(phases)}
    rows = []
    for k, p in enumerate(phases):
        free = F.lit(True)
        for n in p.needs:
            free = free & (left[n] == 0)
        rows.append(F.struct(F.lit(p.name).alias("phase"), F.col(f"t{k}").alias("total"), F.col(f"d{k}").alias("done"), F.col(f"f{k}").alias("failed"), left[p.name].alias("pending"), free.alias("open"), F.col(f"x{k}.atom").alias("next_atom")))
    return one.select("unit", F.explode(F.array(*rows)).alias("p")).select("unit", "p.*")


def pending(atoms: DataFrame, facts: DataFrame, names: Sequence[str], phases: Sequence[Phase]) -> DataFrame:
    """(unit, phase, atom, at): the atoms that wait in phases that are open."""
    j = written(_known(atoms, facts, names), "atoms")  # for the atoms and for the phases
    states = [_state(p) for p in phases]
    waiting = F.array_compact(F.array(*[F.when(m & ~d & ~f, F.lit(p.name)) for p, (m, d, f) in zip(phases, states, strict=True)]))
    each = j.select("unit", "atom", "at", F.explode(waiting).alias("phase"))
    free = _lists(j, phases).where("open and pending > 0").select("unit", "phase")
    return each.join(free, ["unit", "phase"], "left_semi")


def totals(lists: DataFrame) -> DataFrame:
    """(phase, units, total, done, failed, pending, open_units) over all units."""
    return lists.groupBy("phase").agg(F.count("*").alias("units"), *[F.sum(c).alias(c) for c in ("total", "done", "failed", "pending")], F.count_if("open").alias("open_units"))
