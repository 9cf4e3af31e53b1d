"""Searching index configurations: cost model, genetic search, expression trees."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost_proxy(dim, nlist, m, k, nprobe, rerank, n) -> Column:
    """Floating-point operations of one query: coarse scan, tables, codes, re-ranking."""
    d = lambda x: (F.lit(x) if not isinstance(x, (str, Column)) else F.col(x) if isinstance(x, str) else x).cast("double")
    dim, nlist, m, k, nprobe, rerank, n = map(d, (dim, nlist, m, k, nprobe, rerank, n))
    return 2 * dim * nlist + 2 * dim * k * nprobe + 2 * m * n * nprobe / nlist + 2 * dim * rerank


def feasible_fitness(recall, cost_ratio, limit: float) -> Column:
    """Recall of a configuration within the cost limit; the others get a negative excess."""
    return F.when(F.col(cost_ratio) <= limit, F.col(recall)).otherwise(-(F.col(cost_ratio) / limit - 1))


@dataclass(frozen=True)
class GaConfig:
    population: int = 24
    generations: int = 20
    elite: int = 2
    immigrants: int = 2
    tournament: int = 3
    mutation: float = 0.15
    patience: int = 6
    seed: int = 1

    def __post_init__(self):
        if self.population < 2 or self.elite + self.immigrants > self.population or self.tournament < 1:
            raise ValueError("population, elite and immigrants do not fit together")


def genetic_search(grid: list[int], config: GaConfig, fitness: Callable[[list[tuple[int, ...]]], list[float]]) -> list[tuple[tuple[int, ...], float]]:
    """All genomes tried, best first (ties: smaller genome). ``grid`` has the number of choices per gene.

    ``fitness`` gets all new genomes of a generation at once, so that a generation is one job.
    """
    rng, known, best, idle = random.Random(config.seed), {}, None, 0
    fresh = lambda: tuple(rng.randrange(g) for g in grid)
    people = [fresh() for _ in range(config.population)]
    for _ in range(config.generations):
        new = sorted({p for p in people if p not in known})
        known.update(zip(new, fitness(new) if new else [], strict=True))
        ranked = sorted(set(people), key=lambda p: (-known[p], p))
        top = known[ranked[0]]
        idle = idle + 1 if best is not None and top <= best else 0
        best = top if best is None else max(best, top)
        if idle >= config.patience:
            break
        pick = lambda: min((rng.choice(people) for _ in range(config.tournament)), key=lambda p: (-known[p], p))
        after = ranked[: config.elite] + [fresh() for _ in range(config.immigrants)]
        while len(after) < config.population:
            child = [a if rng.random() < 0.5 else b for a, b in zip(pick(), pick(), strict=True)]
            for i, g in enumerate(grid):
                if rng.random() < config.mutation:
                    child[i] = min(max(child[i] + rng.choice((-1, 1)), 0), g - 1) if rng.random() < 0.5 else rng.randrange(g)
            after.append(tuple(child))
        people = after
    return sorted(known.items(), key=lambda x: (-x[1], x[0]))


#: An expression is ('var', i), ('const', v) or (op, left, right).
OPERATORS = ("+", "-", "*", "/", "min", "max")


def random_tree(rng: random.Random, variables: int, depth: int) -> tuple:
    if depth <= 0 or rng.random() < 0.3:
        return ("var", rng.randrange(variables)) if rng.random() < 0.7 else ("const", round(rng.uniform(-2, 2), 3))
    return (rng.choice(OPERATORS), random_tree(rng, variables, depth - 1), random_tree(rng, variables, depth - 1))


def depth_of(tree: tuple) -> int:
    return 1 if tree[0] in ("var", "const") else 1 + max(depth_of(tree[1]), depth_of(tree[2]))


def evaluate(tree: tuple, values: list[float]) -> float:
    """Division by nearly 0 gives 1, a variable out of range 0."""
    if tree[0] == "var":
        return values[tree[1]] if 0 <= tree[1] < len(values) else 0.0
    if tree[0] == "const":
        return tree[1]
    a, b = evaluate(tree[1], values), evaluate(tree[2], values)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b if abs(b) >= 1e-9 else 1.0, "min": lambda: min(a, b), "max": lambda: max(a, b)}[tree[0]]()


def compile_tree(tree: tuple, columns: list[str]) -> Column:
    """The same expression over columns, evaluated in the JVM."""
    if tree[0] == "var":
        return F.col(columns[tree[1]]).cast("double") if 0 <= tree[1] < len(columns) else F.lit(0.0)
    if tree[0] == "const":
        return F.lit(float(tree[1]))
    a, b = compile_tree(tree[1], columns), compile_tree(tree[2], columns)
    if tree[0] == "/":
        # Bound once as an element, so that a nested division does not repeat its operand.
        pair = F.array(F.struct(a.alias("a"), b.alias("b")))
        return F.transform(pair, lambda x: F.when(F.abs(x["b"]) < 1e-9, 1.0).otherwise(x["a"] / x["b"]))[0]
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b)}[tree[0]]()


def show_tree(tree: tuple) -> str:
    if tree[0] == "var":
        return f"x{tree[1]}"
    if tree[0] == "const":
        return f"{tree[1]:g}"
    return f"({tree[0]} {show_tree(tree[1])} {show_tree(tree[2])})"


def snap(value: Column, grid: list[float]) -> Column:
    """The grid value nearest to a column's, ties to the lower one."""
    choices = F.array(*(F.struct(F.abs(value - g).alias("d"), F.lit(float(g)).alias("g")) for g in grid))
    return F.array_min(choices)["g"]


def genetic_programming(variables: int, fitness: Callable[[list[tuple]], list[float]], population: int = 30, generations: int = 10, depth: int = 5, seed: int = 1) -> list[tuple[tuple, float]]:
    """Expression trees by fitness, best first; a generation's new trees are judged together."""
    rng, known = random.Random(seed), {}
    trees = [random_tree(rng, variables, depth - 1) for _ in range(population)]

    def part(tree):
        while tree[0] not in ("var", "const") and rng.random() < 0.6:
            tree = tree[rng.choice((1, 2))]
        return tree

    def graft(tree, piece):
        if tree[0] in ("var", "const") or rng.random() < 0.3:
            return piece
        side = rng.choice((1, 2))
        return tuple(graft(t, piece) if i == side else t for i, t in enumerate(tree))

    for _ in range(generations):
        new = sorted({t for t in trees if t not in known}, key=str)
        scores = fitness(new) if new else []
        known.update((t, s if math.isfinite(s) else -math.inf) for t, s in zip(new, scores, strict=True))
        ranked = sorted(set(trees), key=lambda t: (-known[t], str(t)))
        pick = lambda: min((rng.choice(trees) for _ in range(3)), key=lambda t: (-known[t], str(t)))
        after = ranked[:2]
        while len(after) < population:
            child = graft(pick(), part(pick()) if rng.random() < 0.8 else random_tree(rng, variables, 2))
            after.append(child if depth_of(child) <= depth else pick())
        trees = after
    return sorted(known.items(), key=lambda x: (-x[1], str(x[0])))
