"""NSGA-II over derivation trees: non-dominated sorting, crowding, tournaments, subtree crossover and mutation."""

from __future__ import annotations

import copy
import math
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from veilstream.plans.grammar import Grammar, Tree, derive, least_depths


@dataclass
class Individual:
    tree: Tree
    quality: tuple[float, ...]


def dominates(a: tuple[float, ...], b: tuple[float, ...]) -> bool:
    return all(x >= y for x, y in zip(a, b, strict=True)) and a != b


def fronts(qualities: list[tuple[float, ...]]) -> list[list[int]]:
    """Numbers by front, the non-dominated first."""
    beaten = [sum(dominates(q, p) for q in qualities) for p in qualities]
    out, left = [], set(range(len(qualities)))
    while left:
        front = sorted(i for i in left if beaten[i] == 0)
        out.append(front)
        left -= set(front)
        for i in front:
            for j in left:
                beaten[j] -= dominates(qualities[i], qualities[j])
    return out


def crowding(qualities: list[tuple[float, ...]], front: list[int]) -> dict[int, float]:
    out = dict.fromkeys(front, 0.0)
    for m in range(len(qualities[front[0]])):
        order = sorted(front, key=lambda i: qualities[i][m])
        span = qualities[order[-1]][m] - qualities[order[0]][m]
        out[order[0]] = out[order[-1]] = math.inf
        for a, b, c in zip(order, order[1:], order[2:], strict=False):
            out[b] += (qualities[c][m] - qualities[a][m]) / span if span else 0.0
    return out


def _nodes(tree: Tree, depth: int = 0) -> Iterator[tuple[Tree, int]]:
    yield tree, depth
    for c in tree.children:
        yield from _nodes(c, depth + 1)


def _depth(tree: Tree) -> int:
    return 1 + max(map(_depth, tree.children), default=0)


def crossover(a: Tree, b: Tree, rng: random.Random, max_depth: int) -> Tree:
    """A copy of a in which a subtree has given way to one of b from the same symbol."""
    child = copy.deepcopy(a)
    places = [(t, d) for t, d in _nodes(child) if t.children]
    place, depth = rng.choice(places)
    fitting = [t for t, _ in _nodes(b) if t.symbol == place.symbol and t.children and _depth(t) + depth <= max_depth]
    if fitting:
        place.children = copy.deepcopy(rng.choice(fitting)).children
    return child


def mutate(a: Tree, grammar: Grammar, rng: random.Random, max_depth: int, depths: dict[str, int]) -> Tree:
    child = copy.deepcopy(a)
    place, depth = rng.choice([(t, d) for t, d in _nodes(child) if t.children])
    place.children = derive(grammar, rng, place.symbol, max(1, max_depth - depth), depths).children
    return child


def nsga2(grammar: Grammar, evaluate: Callable[[Tree], tuple[float, ...]], evaluations: int, seed: int = 0, population: int = 100, max_depth: int = 16, crossover_rate: float = 0.8, threads: int = 1) -> Iterator[list[Individual]]:
    """Populations by generation; evaluate is called that many times at most. threads: evaluations at a time."""
    rng, depths = random.Random(seed), least_depths(grammar)
    population = min(population, evaluations)
    pool = ThreadPoolExecutor(threads)

    def scored(trees: list[Tree]) -> list[Individual]:
        return [Individual(t, q) for t, q in zip(trees, pool.map(evaluate, trees), strict=True)]

    people = scored([derive(grammar, rng, None, max_depth, depths) for _ in range(population)])
    done = len(people)
    yield people
    while done < evaluations:
        qualities = [p.quality for p in people]
        rank = {i: (r, -c) for r, front in enumerate(fronts(qualities)) for i, c in crowding(qualities, front).items()}

        def parent(rank=rank, people=people) -> Tree:
            return people[min(rng.randrange(len(people)), rng.randrange(len(people)), key=rank.__getitem__)].tree

        young = []
        for _ in range(min(population, evaluations - done)):
            child = crossover(parent(), parent(), rng, max_depth) if rng.random() < crossover_rate else mutate(parent(), grammar, rng, max_depth, depths)
            young.append(child)
        everyone = people + scored(young)
        done += len(young)
        qualities = [p.quality for p in everyone]
        people = []
        for front in fronts(qualities):
            far = crowding(qualities, front)
            people += [everyone[i] for i in sorted(front, key=lambda i: -far[i])][: population - len(people)]
            if len(people) == population:
                break
        yield people
    pool.shutdown()


def percentile(people: list[Individual], objective: int, p: float) -> Individual:
    """The individual at floor(p / 100 * (n - 1)) in the order of one objective."""
    order = sorted(people, key=lambda x: x.quality[objective])
    return order[int(p / 100 * (len(order) - 1))]
