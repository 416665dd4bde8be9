"""Ordered repair rules as data: lists of them are arguments, or rows of a table.

A rule says what to replace and, as ``triggers``, literals of which a text must hold one for the rule to change it. Rules
are tried in order, each on what the one before left. Looking for a literal costs a fraction of a pattern, so texts pass
most rules by; a text without any trigger of the whole list passes all of them at one look.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import values as V

REGEX, LITERAL, STEP = "regex", "literal", "step"
#: Rules that a table may hold.
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` (a Java pattern, a literal, or the name of one of ``STEPS``) becomes ``new``; ``$1`` names a group.

    Without ``triggers`` the rule is tried on every text. ``only_if`` is a pattern that a text must match as well.
    """

    pattern: str
    new: str = ""
    kind: str = REGEX
    triggers: tuple[str, ...] = ()
    only_if: str | None = None

    def __post_init__(self):
        if self.kind not in (REGEX, LITERAL, STEP) or (self.kind == STEP and self.pattern not in STEPS):
            raise ValueError(f"unknown rule: {self.kind} {self.pattern!r}")


#: Repairs that no single pattern can express.
STEPS: dict[str, Callable[[Column], Column]] = {"split_radio_prefix": T.split_radio_prefix, "drop_noise_lines": T.drop_noise_lines}


def one_rule(text: Column, rule: Rule) -> Column:
    if rule.kind == LITERAL:
        return F.replace(text, F.lit(rule.pattern), F.lit(rule.new))
    return STEPS[rule.pattern](text) if rule.kind == STEP else T.apply_rules(text, [(rule.pattern, rule.new)])


def tested(rule: Rule) -> bool:
    return bool(rule.triggers or rule.only_if)


def any_trigger(rules: list[Rule]) -> str:
    """A pattern that matches where any rule of a list may have something to do: single signs as one class."""
    literals = dict.fromkeys(t for r in rules for t in r.triggers)
    signs, longer = [t for t in literals if len(t) == 1], [t for t in literals if len(t) > 1 and not any(s in t for s in literals if len(s) == 1)]
    group = ["[" + "".join(re.sub(r"([\\\[\]^&\-])", r"\\\1", s) for s in signs) + "]"] * bool(signs)
    return "|".join([*group, *[re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", t) for t in longer], *dict.fromkeys(f"(?:{r.only_if})" for r in rules if r.only_if)])


def apply(text: Column, rules: list[Rule]) -> Column:
    """``text`` after all ``rules``, in order; null stays null."""
    if not rules:
        return text

    def group(value: Column, some: list[Rule]) -> Column:
        if not tested(some[0]):
            return reduce(one_rule, some, value)
        found = [lambda x, t=t: F.contains(x, F.lit(t)) for t in some[0].triggers] + [lambda x: x.rlike(some[0].only_if)] * bool(some[0].only_if)
        return T.once(value, lambda x: F.when(reduce(lambda a, b: a | b, [f(x) for f in found]), reduce(one_rule, some, x)).otherwise(x))

    chain = lambda value: reduce(group, [list(g) for _, g in groupby(rules, key=lambda r: (r.triggers, r.only_if))], value)
    if not all(map(tested, rules)):
        return chain(text)
    return T.once(text, lambda x: F.when(x.rlike(any_trigger(rules)), chain(x)).otherwise(x))


def rule_rows(rules: list[Rule]) -> list[tuple]:
    """Rows (ord, kind, pattern, replacement, triggers, only_if) of a rule table."""
    return [(i, r.kind, r.pattern, r.new, list(r.triggers), r.only_if) for i, r in enumerate(rules)]


RULE_TABLE = "ord int, kind string, pattern string, replacement string, triggers array<string>, only_if string"


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table like ``rule_rows``, in order of ``ord``. A table of rules is configuration: more than
    ``MOST_RULES`` are an error."""
    rows = table.select("ord", "kind", "pattern", "replacement", "triggers", "only_if").orderBy("ord").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [Rule(r.pattern, r.replacement or "", r.kind or REGEX, tuple(r.triggers or ()), r.only_if) for r in rows]


def words_in(pattern: str) -> tuple[str, ...]:
    r"""The words that a pattern like ``\bword\b`` or ``\b(one|other)\b`` looks for."""
    found = re.fullmatch(r"\\b\(?([^\W\d_]+(?:\|[^\W\d_]+)*)\)?\\b", pattern)
    if not found:
        raise ValueError(pattern)
    return tuple(found[1].split("|"))


#: Repairs of one recognised line.
LINE_RULES = [
    *[Rule(old, new, LITERAL, (old,)) for old, new in [*V.LIGATURES.items(), *V.CURLY.items()]],
    *[Rule(old, new, triggers=("¡",)) for old, new in T.INVERTED_BANG],
    *[Rule(old, new, triggers=("_",)) for old, new in T.UNDERSCORES],
    Rule("split_radio_prefix", kind=STEP, only_if=r"(?U)^\s*[Oo0©®™¢Øø]"),
    *[Rule(old, new, triggers=(sign,)) for (old, new), sign in zip(T.EMPTY_BRACKETS, ("()", "[]"), strict=True)],
    *[Rule(old, new, triggers=("[",)) for old, new in T.CHECKED_BRACKETS],
    *[Rule(old, new, triggers=("¢", "©", "®", "™")) for old, new in T.SYMBOL_NOISE],
    *[Rule(old, new, triggers=("   ",)) for old, new in T.WIDE_SPACES],
]
#: Repairs of a whole text.
TEXT_RULES = [
    *[Rule(old, new, triggers=words_in(old)) for old, new in V.CODE_TOKENS],
    *[Rule(old, new, triggers=("(M/P)",)) for old, new in V.GENDER],
    *[Rule(old, new, triggers=words_in(old)) for old, new in [*V.GLUED, *V.ACCENTS]],
    *[Rule(old, new, only_if=rf"(?U)\d{sign}\d") for (old, new), sign in zip(V.DIGITS, "lO", strict=True)],
    *[Rule(old, new, triggers=(sign * 10,)) for (old, new), sign in zip(V.RUNS, ".-_", strict=True)],
    Rule("drop_noise_lines", kind=STEP),
]


def fix_ocr_text(line: Column, rules: list[Rule] | None = None) -> Column:
    """All repairs of one line, in order: ``LINE_RULES``, or those given."""
    return apply(line, LINE_RULES if rules is None else rules)


def apply_global_fixes(text: Column, rules: list[Rule] | None = None) -> Column:
    """All repairs of a whole text, in order: ``TEXT_RULES``, or those given."""
    return apply(text, TEXT_RULES if rules is None else rules)
