"""Prompt search: driver loops over a small population, scored as DataFrames."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field
from math import ceil, log

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.operators.synth import mutate_spec


@dataclass
class Candidate:
    """A prompt specification with its fitness and where it came from."""

    spec: dict[str, str]
    fitness: float = float("-inf")
    found_in: int = 0
    origin: str = "seed"
    changed: list[str] = field(default_factory=list)


class Bandit:
    """Epsilon-greedy choice among operations by mean reward."""

    def __init__(self, operations: list[str], epsilon: float = 0.1, seed: int = 0) -> None:
        self.rewards: dict[str, list[float]] = {o: [] for o in operations}
        self.epsilon, self.rng = epsilon, random.Random(seed)

    def choose(self) -> str:
        tried = {o: sum(r) / len(r) for o, r in self.rewards.items() if r}
        if len(tried) < len(self.rewards) or self.rng.random() < self.epsilon:
            untried = [o for o in self.rewards if o not in tried]
            return self.rng.choice(untried or sorted(self.rewards))
        return max(sorted(tried), key=tried.__getitem__)

    def update(self, operation: str, reward: float) -> None:
        self.rewards[operation].append(reward)


def select(population: list[Candidate], k: int) -> list[Candidate]:
    """The k fittest, earlier ones first among equals."""
    return sorted(population, key=lambda c: -c.fitness)[:k]


def refill(survivors: list[Candidate], size: int, seeds: list[dict[str, str]], seed: int) -> list[Candidate]:
    """A population of ``size``: a fifth elite, then mutants of one slot (40%), of two (30%), and fresh seeds (10%)."""
    rng = random.Random(seed)
    out = survivors[: max(1, size // 5)]
    for share, strength in ((0.4, 1), (0.3, 2)):
        for _ in range(int(size * share)):
            parent = rng.choice(survivors)
            spec, changed = mutate_spec(parent.spec, str(rng.random()), strength)
            out.append(Candidate(spec, origin=f"mutation-{strength}", changed=changed))
    while len(out) < size:
        out.append(Candidate(dict(rng.choice(seeds)), origin="seed"))
    return out[:size]


def prompt_search(spark: SparkSession, seeds: list[dict[str, str]], score: Callable[[DataFrame], DataFrame], rounds: int, size: int, seed: int = 0, patience: int = 3) -> list[Candidate]:
    """The best candidates of an evolutionary search, fittest first, each specification once.

    ``score`` takes a DataFrame (id, spec map) and adds ``fitness``: one
    distributed evaluation per round, of specifications not seen before.
    """
    population = refill([Candidate(dict(s)) for s in seeds], size, seeds, seed)
    known: dict[tuple, Candidate] = {}
    best, since = float("-inf"), 0
    for k in range(rounds):
        new = {tuple(sorted(c.spec.items())): c for c in population if tuple(sorted(c.spec.items())) not in known}
        if new:
            rows = [(i, dict(spec)) for i, spec in enumerate(new)]
            scored = {r["id"]: r["fitness"] for r in score(spark.createDataFrame(rows, "id long, spec map<string,string>")).select("id", "fitness").collect()}
            for i, (spec, c) in enumerate(new.items()):
                c.fitness, c.found_in = scored[i], k
                known[spec] = c
        population = [known[tuple(sorted(c.spec.items()))] for c in population]
        top = max(c.fitness for c in known.values())
        best, since = (top, 0) if top > best else (best, since + 1)
        if since >= patience:
            break
        population = refill(select(population, max(2, size // 2)), size, seeds, seed + k + 1)
    return sorted(known.values(), key=lambda c: (-c.fitness, c.found_in))


def moving_baseline(df: DataFrame, group: str, order: str, value: str, momentum: float = 0.9) -> DataFrame:
    """(group, baseline): b <- m*b + (1-m)*value in order, from 0, after the last value.

    b is the sum of (1-m) * m^k * value over the k-th last values; those with
    m^k below double precision add nothing, so each group needs only its last
    few hundred rows, a limit that is applied before the shuffle.
    """
    last = ceil(log(1e-18) / log(momentum)) if 0 < momentum < 1 else 1
    w = Window.partitionBy(group).orderBy(F.col(order).desc_nulls_last())
    d = df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= last)
    return d.groupBy(group).agg(F.sum((1 - momentum) * F.pow(F.lit(momentum), F.col("__k") - 1) * F.col(value)).alias("baseline"))
