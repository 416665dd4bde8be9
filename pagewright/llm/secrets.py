"""Secret scan: fixed patterns, plus sliding-window Shannon entropy per character class with an allow-list.

Built-in functions only, one narrow projection over the documents, no shuffle.

Null text counts as empty and gives no spans; rows are independent, so ties, repeated rows, empty tables and
further columns change nothing. Offsets are code points, ends exclusive. Work is linear in the text: windows slide over
chunks of ``CHUNK`` places, with counts of characters of which each step changes two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import in_steps, let, text_or_empty
from pagewright.llm.spans import SPANS, apart, by_start, count_kind, find_spans, joined, running

KINDS = ["assign", "access", "hex", "entropy"]

# Patterns. The assign pattern keeps short values, which use up their text before they are dropped.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^[A-Za-z_]+["']? *[:=] *["']?"""
ASSIGN_MIN = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

#: Characters in a window, and the entropy in bits from which a window of each character class counts.
WINDOW = 20
CLASSES = {"hex": ("^[0-9a-fA-F]+$", 3.0), "lower": ("^[a-z0-9_=-]+$", 3.5), "mixed": ("", 3.7)}
#: A window also needs so many digits and letters: words of prose have none of the former.
MIN_DIGITS, MIN_LETTERS = 2, 4
# Whole candidates that are never secrets (identifiers in the usual 8-4-4-4-12 form, words with a number).
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[a-z]++(?:[-_/=+][a-z]++)*+[-_/=+]?[0-9]{0,4}$"
# What must not stand in a hot stretch or within a window of it (placeholders, plain sequences).
ALLOWED_NEAR = r"(?i)example|placeholder|dummy|changeme|xxxx|abcdef|0123456|1234567"

INTERVALS = "array<struct<s:int,e:int>>"
CHUNK = 256
#: Candidates hold characters of these codes only.
FIRST_CODE, LAST_CODE = ord("+"), ord("z")
#: Counts of a window's characters: so many bits each, so many in a long.
COUNT_BITS, PACKED = 5, 12


def hot_flags(codes: Column, limit: Column) -> Column:
    """For each window of ``WINDOW`` codes in a row, whether its entropy and its mix of characters count.

    With S the sum of c*log2(c) over the window's counts, entropy is log2(W) - S/W. Sliding by one takes one
    character from the counts and puts one in, so S moves by their two terms, and so do digits and letters.
    """
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    term = lambda c: F.element_at(table, (c + 1).cast("int"))
    none = F.array_repeat(F.lit(0).cast("long"), (LAST_CODE - FIRST_CODE) // PACKED + 1)
    is_digit = lambda c: F.when(c.between(48, 57), 1).otherwise(0)
    is_letter = lambda c: F.when(c.between(65, 90) | c.between(97, 122), 1).otherwise(0)

    def moved(acc: Column, code: Column, by: int) -> Column:
        at = F.floor((code - FIRST_CODE) / PACKED).cast("int")
        bits = (code - FIRST_CODE) % PACKED * COUNT_BITS
        old = F.call_function("shiftright", acc["counts"][at], bits).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
        return F.struct(
            F.transform(acc["counts"], lambda n, i: F.when(i == at, n + by * one).otherwise(n)).alias("counts"),
            (acc["sum"] - term(old) + term(old + by)).alias("sum"),
            (acc["digits"] + by * is_digit(code)).alias("digits"),
            (acc["letters"] + by * is_letter(code)).alias("letters"),
        )

    def hot(acc: Column) -> Column:
        return (F.lit(math.log2(WINDOW)) - acc["sum"] / WINDOW >= limit) & (acc["digits"] >= MIN_DIGITS) & (acc["letters"] >= MIN_LETTERS)

    def flags(some: Column) -> Column:
        start = F.aggregate(F.slice(some, 1, WINDOW), F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("digits"), F.lit(0).alias("letters")), lambda acc, c: moved(acc, c, 1))
        first = let(start, lambda acc: F.struct(acc.alias("now"), F.array(hot(acc)).alias("out")))
        step = lambda acc, i: let(moved(moved(acc["now"], some[i - 1], -1), some[i + (WINDOW - 1)], 1), lambda now: F.struct(now.alias("now"), F.concat(acc["out"], F.array(hot(now))).alias("out")))
        return F.when(F.size(some) > WINDOW, F.aggregate(F.sequence(F.lit(1), F.size(some) - WINDOW), first, step, lambda acc: acc["out"])).otherwise(F.array(hot(start)))

    windows = F.size(codes) - (WINDOW - 1)
    chunks = F.sequence(F.lit(0), F.ceil(windows / CHUNK).cast("int") - 1)
    return F.flatten(F.transform(chunks, lambda k: let(F.slice(codes, k * CHUNK + 1, CHUNK + WINDOW - 1), flags)))


def hot_stretches(hot: Column) -> Column:
    """Merged intervals of characters that hot windows cover: a window joins the last if they meet."""
    at = F.filter(F.transform(hot, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())

    def merged(w: Column) -> Column:
        starts = F.filter(w, lambda x, i: (i == 0) | (x > w[F.greatest(i - 1, F.lit(0))] + WINDOW))
        lasts = F.filter(w, lambda x, i: (i == F.size(w) - 1) | (w[F.least(i + 1, F.size(w) - 1)] > x + WINDOW))
        return F.zip_with(starts, lasts, lambda s, e: F.struct(s.cast("int").alias("s"), (e + WINDOW).cast("int").alias("e")))

    return let(at, merged).cast(INTERVALS)


def entropy_spans(x: Column) -> Column:
    """Hot stretches of the candidate ``x``, as spans of the text, without those on the allow-list."""
    m = x["m"]
    limit = F.when(m.rlike(CLASSES["hex"][0]), CLASSES["hex"][1]).when(m.rlike(CLASSES["lower"][0]), CLASSES["lower"][1]).otherwise(CLASSES["mixed"][1])

    def spans(chars: Column) -> Column:
        piece = lambda s, e: F.array_join(F.slice(chars, s + 1, e - s), "")
        flags = let(limit, lambda bits: let(F.transform(chars, F.ascii), lambda codes: hot_flags(codes, bits)))
        found = hot_stretches(flags)
        real = F.filter(found, lambda w: ~piece(F.greatest(F.lit(0), w["s"] - WINDOW), w["e"] + WINDOW).rlike(ALLOWED_NEAR))
        return F.transform(real, lambda w: F.struct(F.lit("entropy").alias("kind"), (x["s"] + w["s"]).alias("s"), (x["s"] + w["e"]).alias("e"), piece(w["s"], w["e"]).alias("m"), F.lit("").alias("before"), F.lit("").alias("after")))

    return let(F.filter(F.split(m, ""), lambda c: c != ""), spans).cast(SPANS)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``: spans (kind, s, e, m, before, after) by start, then kind. All columns of ``docs`` stay, but for one of that name.

    Entropy spans that overlap a pattern's span are left out, as are candidates on the allow-list and stretches with a
    placeholder in or near them; a placeholder elsewhere in a long candidate hides nothing.
    """
    t = text_or_empty(text)
    steps = {
        "assign": lambda c: F.filter(find_spans(t, "assign", ASSIGN, t.rlike("[:=]")), lambda x: F.length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= ASSIGN_MIN),
        "access": lambda c: find_spans(t, "access", ACCESS, t.contains("AKIA")),
        "hex": lambda c: find_spans(t, "hex", HEX),
        "base": lambda c: F.concat(c("assign"), c("access"), c("hex")).cast(SPANS),
        # Candidates without digits can't hold a hot window; they are dropped before any window is scored.
        "strings": lambda c: F.filter(find_spans(t, "entropy", CANDIDATE), lambda x: x["m"].rlike("[0-9].*[0-9]") & ~x["m"].rlike(ALLOWED)),
        "hot": lambda c: F.flatten(F.transform(c("strings"), entropy_spans)).cast(SPANS),
        "apart": lambda c: apart(c("hot"), c("base")),
        "found": lambda c: by_start(F.concat(c("base"), c("apart")), KINDS),
    }
    return in_steps(docs, steps, "secrets")


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced; overlapping spans share one mask; rows without any are unchanged."""
    found = find_secrets(docs, text)

    def pieces(spans: Column, reach: Column) -> Column:
        """Code points to keep and a mask in turn; ``reach`` is the furthest end of the spans so far."""
        numbers = F.sequence(F.lit(0), F.size(spans) - 1)
        heads = F.filter(numbers, lambda i: (i == 0) | (spans[i]["s"] >= reach[F.greatest(i - 1, F.lit(0))]))
        kept = lambda chars, lo, hi: F.array_join(F.slice(chars, lo + 1, hi - lo), "")
        before = lambda h, k: F.when(k > 0, reach[h[k] - 1]).otherwise(0)
        out = lambda h, chars: F.concat(F.array_join(F.transform(h, lambda i, k: F.concat(kept(chars, before(h, k), spans[i]["s"]), F.lit(mask))), ""), kept(chars, F.element_at(reach, -1), F.size(chars)))
        return let(heads, lambda h: let(F.split(F.col(text), ""), lambda chars: out(h, chars)))

    steps = {
        "reach": lambda c: running(F.transform("secrets", lambda x: x["e"]), F.lit(0), lambda p, q: F.greatest(p, q)),
        "cut": lambda c: F.when(F.size("secrets") > 0, pieces(F.col("secrets"), c("reach"))).otherwise(F.col(text)),
    }
    return in_steps(found, steps, text)


def secrets_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of base spans, all spans."""
    found = find_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    count = [count_kind("secrets", k) for k in KINDS]
    return found.select(
        "doc_id",
        *count[:3],
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count[3],
    )
