"""Grammars of pipelines: generation, reading, random derivation, and derivation trees as pipelines."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

from veilstream.plans.ir import Aggregate, Condition, Duplicate, Filter, MovingAggregate, Node, Noise, Pipeline, RandomInRange

#: The choices a grammar offers.
PROBABILITIES = ["0.1", "0.2", "0.3", "0.4", "0.5", "0.6", "0.7", "0.8", "0.9", "1.0"]
PERCENTAGES = ["0.01", "0.05", "0.10", "0.25"]
WINDOWS = ["3", "4", "5", "6", "7", "8", "9", "10"]

OPERATORS = {"filter": "<attribute> <condition> <value>", "map_duplicate": "<probability>", "map_noise": "<attribute> <percentage>", "map_rir": "<attribute>", "map_aggregate": "<attribute> <agg_fun> <window_size>"}
FILTERS, MAPS, AGGREGATES, RIR = ("filter",), ("filter", "map_duplicate", "map_noise"), ("filter", "map_duplicate", "map_noise", "map_aggregate"), ("filter", "map_rir")


@dataclass
class Tree:
    symbol: str
    children: list[Tree] = field(default_factory=list)

    def leaves(self) -> list[str]:
        return [self.symbol] if not self.children else [x for c in self.children for x in c.leaves()]

    def child(self, symbol: str) -> Tree | None:
        return next((c for c in self.children if c.symbol == symbol), None)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


Grammar = dict[str, list[list[str]]]


def quoted(attribute: str) -> str:
    return f"'{attribute}'"


def unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] == "'" else text


def generate_grammar(attributes: list[str], operators: tuple[str, ...] = AGGREGATES) -> str:
    rules = {"pipeline": "<operator> | <operator> <pipeline>", "operator": " | ".join(f"<{o}>" for o in operators)}
    rules |= {o: OPERATORS[o] for o in operators}
    rules |= {"attribute": " | ".join(map(quoted, attributes)), "condition": "lt | gt", "value": "<dig> . <dig> <dig> E <sign> <dig>", "dig": " | ".join("0123456789"), "sign": "+ | -"}
    if "map_aggregate" in operators:
        rules |= {"agg_fun": "min | avg | max", "window_size": " | ".join(WINDOWS)}
    if "map_duplicate" in operators:
        rules["probability"] = " | ".join(PROBABILITIES)
    if "map_noise" in operators:
        rules["percentage"] = " | ".join(PERCENTAGES)
    return "".join(f"<{name}> ::= {body}\n" for name, body in rules.items())


def integer_rule(name: str, least_digits: int, most_digits: int) -> str:
    """A rule for whole numbers with so many digits, without leading zeros."""
    options = ["<digit>" if n == 1 else "<non_zero_digit>" + " <digit>" * (n - 1) for n in range(least_digits, most_digits + 1)]
    return f"{name} ::= {' | '.join(options)}\n"


def fraction_rule(name: str, digits: int = 1) -> str:
    """A rule for so many digits behind the point."""
    return f"{name} ::= {' '.join(['<digit>'] * digits)}\n"


def clean_name(attribute: str) -> str:
    """Letters and digits, anything between them as one underscore."""
    return "_".join(re.findall(r"[a-zA-Z0-9]+", attribute))


_SYMBOL = re.compile(r"'[^']*'|<[^<>\s]+>|\||[^\s|]+")


def parse_grammar(text: str) -> Grammar:
    """Rules by nonterminal, the start symbol first; a line without ::= continues the rule before it."""
    grammar: Grammar = {}
    name = None
    for line in text.splitlines():
        head, sep, body = line.partition("::=")
        if sep:
            name = head.strip()
            grammar[name] = [[]]
        else:
            body = line
        if name is None or not body.strip():
            continue
        for token in _SYMBOL.findall(body):
            if token == "|":
                grammar[name].append([])
            else:
                grammar[name][-1].append(token)
    return grammar


def is_filter_only(grammar: Grammar) -> bool:
    return not any(token.startswith("<map_") for options in grammar.values() for option in options for token in option)


def least_depths(grammar: Grammar) -> dict[str, int]:
    """The smallest depth of a finished derivation from each symbol."""
    depth = {s: 10**6 for s in grammar}
    changed = True
    while changed:
        changed = False
        for s, options in grammar.items():
            best = 1 + min(max((depth.get(t, 0) for t in option), default=0) for option in options)
            if best < depth[s]:
                depth[s], changed = best, True
    return depth


def derive(grammar: Grammar, rng: random.Random, symbol: str | None = None, max_depth: int = 16, depths: dict[str, int] | None = None) -> Tree:
    """A random derivation no deeper than max_depth, if the grammar has one."""
    symbol = symbol or next(iter(grammar))
    depths = depths or least_depths(grammar)
    if symbol not in grammar:
        return Tree(symbol)
    need = lambda option: max((depths.get(t, 0) for t in option), default=0)
    fitting = [o for o in grammar[symbol] if need(o) < max_depth] or [min(grammar[symbol], key=need)]
    return Tree(symbol, [derive(grammar, rng, t, max_depth - 1, depths) for t in rng.choice(fitting)])


def _text(tree: Tree, name: str) -> str:
    found = tree.child(name)
    if found is None:
        raise ValueError(f"{tree.symbol} lacks {name}")
    return unquoted("".join(found.leaves()))


def to_node(operator: Tree) -> Node:
    """The node of an <operator> tree; ValueError if it is not a whole one."""
    if not operator.children:
        raise ValueError("an operator without content")
    body = operator.children[0]
    kind = body.symbol.strip("<>")
    if kind == "filter":
        return Filter(_text(body, "<attribute>"), Condition(_text(body, "<condition>")), float(_text(body, "<value>")))
    if kind == "map_duplicate":
        return Duplicate(float(_text(body, "<probability>")))
    if kind == "map_noise":
        return Noise(_text(body, "<attribute>"), float(_text(body, "<percentage>")))
    if kind == "map_rir":
        return RandomInRange(_text(body, "<attribute>"))
    if kind == "map_aggregate":
        return MovingAggregate(_text(body, "<attribute>"), Aggregate(_text(body, "<agg_fun>")), int(_text(body, "<window_size>")))
    raise ValueError(f"unknown operator {kind}")


def to_pipeline(tree: Tree | None) -> Pipeline:
    """The nodes along the chain of <pipeline> symbols; an operator that is not whole is left out."""
    nodes = []
    while tree is not None and (operator := tree.child("<operator>")) is not None:
        try:
            nodes.append(to_node(operator))
        except ValueError:
            pass
        tree = tree.child("<pipeline>")
    return Pipeline(tuple(nodes))
