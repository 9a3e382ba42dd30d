"""A diverse pool built batch by batch: what it has done is a committed table, so a build goes on after a stop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.committed import append_committed, manifests, read_committed
from ..sources.tables import written
from .diversity import diverse, global_check
from .rows import new_names
from .selection import category_counts

COLUMNS = ["id", "name", "categories", "embedding"]


@dataclass(frozen=True)
class Rules:
    """sim: most similarity to what is kept; warn: the same where a category is full; cap: scenarios that fill one.

    After stall_after batches in a row that added nothing, similarity may rise by step up to most_sim, and caps by a fifth.
    """

    sim: float = 0.85
    warn: float = 0.75
    cap: int = 80
    stall_after: int = 10
    step: float = 0.05
    most_sim: float = 0.95
    most_batches: int = 1000

    def relaxed(self) -> Rules:
        return replace(self, sim=min(self.most_sim, round(self.sim + self.step, 10)), cap=int(self.cap * 1.2))


@dataclass(frozen=True)
class Progress:
    """How far a build is: batches done, rows added by them, stalled batches in a row, and the rules that hold next."""

    batches: int
    added: int
    stalled: int
    rules: Rules

    @classmethod
    def of(cls, added: list[int], rules: Rules) -> Progress:
        """From the rows that each batch added: nothing else has to be kept."""
        stalled = 0
        for n in added:
            if stalled >= rules.stall_after:
                rules, stalled = rules.relaxed(), 0
            stalled = 0 if n else stalled + 1
        if stalled >= rules.stall_after:
            rules, stalled = rules.relaxed(), 0
        return cls(len(added), sum(added), stalled, rules)


def progress(path: str, rules: Rules = Rules()) -> Progress:
    return Progress.of([m["summary"]["total"] for m in manifests(path)], rules)


def built(existing: DataFrame, path: str) -> DataFrame:
    """The rows that a build has added so far; none if no batch has added any, as then the pool has no file to read."""
    got = read_committed(existing.sparkSession, path)
    return existing.select(*COLUMNS).where("false") if got is None else got.select(*COLUMNS)


def build_diverse(existing: DataFrame, batch: Callable[[int], DataFrame | None], path: str, target: int, rules: Rules = Rules()) -> Progress:
    """Adds to the committed pool at path until it has `target` rows together with `existing`.

    batch(k) gives the candidates of batch k from 0 (id, name, categories, embedding), and None when there are no more. Of
    each batch, names that are new stay (rows.new_names), and of those what is diverse (diversity.diverse), in order of id,
    with category counts as they are when the batch begins. A batch is committed as a whole, under its number; a build
    that was stopped at any point goes on with the first batch that was not, under the same rules. Where it stops is
    a function of existing, the batches and the rules alone.
    """
    base = existing.select(*COLUMNS)
    n_base = base.count()
    while True:
        now = progress(path, rules)
        if n_base + now.added >= target or now.batches >= rules.most_batches or (candidates := batch(now.batches)) is None:
            return now
        pool = base.unionByName(built(existing, path))
        fresh = written(new_names(candidates.select(*COLUMNS), pool, "id"))
        counts = category_counts(pool, now.rules.cap).select("category", "n")
        chosen = diverse(fresh, pool.select("id", "embedding"), counts, now.rules.sim, min(now.rules.warn, now.rules.sim), now.rules.cap, written).where("kept")
        append_committed(fresh.join(chosen.select("id"), "id", "left_semi"), path, ["id"], f"batch-{now.batches}")


def build_report(spark: SparkSession, existing: DataFrame, path: str, above: float = 0.75, cap: int = 80) -> tuple[DataFrame, DataFrame]:
    """(the global similarity check of the pool, its categories with their numbers and whether they are over the cap)."""
    pool = existing.select(*COLUMNS).unionByName(built(existing, path))
    return global_check(pool.select("id", "embedding"), above), category_counts(pool, cap)
