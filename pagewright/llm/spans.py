"""Positions of regular-expression matches with built-in functions only.

Splitting at the pattern gives the text between matches, extraction gives the matches; running sums of their
lengths are the positions, in code points. Patterns are Java's and must not match the empty string. Work is linear in
the text: no array grows step by step, and no position is sought from the start of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.llm.common import let

#: Characters kept from the text on each side of a match, for context words; matches have at least ``LEAST_MATCH``.
CONTEXT_CHARS, LEAST_MATCH = 48, 4
NEIGHBOURS = CONTEXT_CHARS // LEAST_MATCH
#: Values in a block of a running total.
BLOCK = 128

SPAN = "struct<kind:string,s:int,e:int,m:string,before:string,after:string>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """At each place, ``combine`` over all values up to it: totals of blocks first, then inside each block."""

    def over(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1))
        totals = F.transform(numbers, lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), zero, combine))
        earlier = let(totals, lambda t: F.transform(numbers, lambda b: F.aggregate(F.slice(t, F.lit(1), b), zero, combine)))
        block = lambda i: F.floor(i / BLOCK).cast("int")
        return let(earlier, lambda h: F.transform(v, lambda x, i: F.aggregate(F.slice(v, block(i) * BLOCK + 1, i % BLOCK + 1), h[block(i)], combine)))

    return let(values, over)


def last_chars(text: Column) -> Column:
    return F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)


def first_chars(text: Column) -> Column:
    return F.substring(text, 1, CONTEXT_CHARS)


def find_spans(text: Column, kind: str, pattern: str, needs: Column | None = None, ahead: bool = False, context: bool = False) -> Column:
    """Leftmost non-overlapping matches in order. ``needs`` is a cheap condition without which nothing matches. With
    ``ahead``, what group 1 of the pattern sees ahead of the match is added to the span, so spans may overlap. With
    ``context``, ``before`` and ``after`` hold the characters on both sides of the match, else nothing."""

    def spans(heads: Column, gaps: Column) -> Column:
        steps = F.transform(heads, lambda m, i: F.length(gaps[i]) + F.when(i > 0, F.length(heads[i - 1])).otherwise(0))
        starts = running(steps, F.lit(0), lambda a, x: a + x)
        tails = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if ahead else None

        def with_context(body: Callable[[Column, Column], Column]) -> Column:
            if not context:
                return body(None, None)
            # What stands before and after each match, cut short: a gap and the match beside it.
            left = F.transform(gaps, lambda g, i: last_chars(F.concat(F.when(i > 0, last_chars(heads[i - 1])).otherwise(""), last_chars(g))))
            right = F.transform(gaps, lambda g, i: first_chars(F.concat(first_chars(g), F.when(i < F.size(heads), first_chars(heads[F.least(i, F.size(heads) - 1)])).otherwise(""))))
            return let(left, lambda lt: let(right, lambda rt: body(lt, rt)))

        def all_spans(at: Column, tail: Column | None, left: Column | None, right: Column | None) -> Column:
            def one(m: Column, i: Column) -> Column:
                whole = m if tail is None else F.concat(m, tail[i])
                first = F.greatest(F.lit(0), i - (NEIGHBOURS - 1))
                before = last_chars(F.array_join(F.slice(left, first + 1, i - first + 1), "")) if context else F.lit("")
                after = first_chars(F.array_join(F.slice(right, i + 2, NEIGHBOURS), "")) if context else F.lit("")
                return F.struct(F.lit(kind).alias("kind"), at[i].cast("int").alias("s"), (at[i] + F.length(whole)).cast("int").alias("e"), whole.alias("m"), before.alias("before"), after.alias("after"))

            return F.transform(heads, one)

        def placed(tail: Column | None) -> Column:
            return let(starts, lambda at: with_context(lambda left, right: all_spans(at, tail, left, right)))

        return placed(None) if tails is None else let(tails, placed)

    whole = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda heads: let(F.split(text, pattern, -1), lambda gaps: spans(heads, gaps)))
    found = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(found, whole.cast(SPANS)).otherwise(no_spans())


def joined(spans: Column) -> Column:
    """``kind:start:end`` in the order given, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def by_start(spans: Column, kinds: list[str]) -> Column:
    """Ordered by start, then by the kind's place in ``kinds``."""
    rank = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda x: F.struct(x["s"], F.array_position(rank, x["kind"]).alias("r"), x["e"], x["kind"], x["m"], x["before"], x["after"]))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"], x["s"], x["e"], x["m"], x["before"], x["after"])).cast(SPANS)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` (sorted, apart from each other) that overlap none of ``others``."""
    most = F.lit(2**31 - 1)
    both = F.array_sort(F.concat(F.transform(others, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("own"), x["e"].alias("e"), F.lit(-1).alias("at"))), F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x["e"].alias("e"), i.alias("at")))))

    def judged(a: Column) -> Column:
        reach = running(F.transform(a, lambda x: F.when(x["own"] == 0, x["e"]).otherwise(-1)), F.lit(-1), lambda p, q: F.greatest(p, q))
        coming = F.reverse(running(F.reverse(F.transform(a, lambda x: F.when(x["own"] == 0, x["s"]).otherwise(most))), most, lambda p, q: F.least(p, q)))
        free = let(reach, lambda r: let(coming, lambda c: F.filter(a, lambda x, i: (x["own"] == 1) & (r[i] <= x["s"]) & (c[i] >= x["e"]))))
        return F.transform(free, lambda x: spans[x["at"]])

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(both, judged)).otherwise(spans)


def count_kind(column: str, kind: str) -> Column:
    """Number of spans of ``kind``, named ``n_<kind>``."""
    return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
