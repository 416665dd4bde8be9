"""Text repair and line tests: Column in, Column out, built-in functions only.

Functions of ``line`` expect one line; those of ``text`` any number. Null in gives null out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import values as V

Rules = list[tuple[str, str]]


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated one time."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """``c`` without white space at its ends."""
    return F.btrim(c, F.lit(V.BLANKS))


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def n_words(c: Column) -> Column:
    """Number of pieces between white space of a stripped text."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, r"(?U)\s+")))


def apply_rules(text: Column, rules: Rules) -> Column:
    """Ordered pattern replacements; ``$1`` names a group."""
    for pattern, new in rules:
        text = F.regexp_replace(text, f"(?U)(?d){pattern}", new)
    return text


INVERTED_BANG = [(r"(?<=[(\[=+\-*/, ])¡(?=[+\-*/)0-9\]])", "j"), (r"\bstr\(¡", "str(j"), (r"=¡\+", "=j+")]
UNDERSCORES = [(r"(_+)([a-záéíóúA-ZÁÉÍÓÚ])", "$1 $2")]
EMPTY_BRACKETS = [(r"(?m)^\(\)\s*", f"{V.RADIO} "), (r"(?m)^\[\]\s*", f"{V.UNCHECKED} ")]
CHECKED_BRACKETS = [(r"\[[xXvV✓✔]\]\s*", f"{V.CHECKED} ")]
SYMBOL_NOISE = [(r"\s[¢©®™]\s", " ")]
WIDE_SPACES = [(r"(?<=[^ \n]) {3,}", " ")]


def fix_chars(text: Column) -> Column:
    for old, new in V.LIGATURES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.translate(text, "".join(V.CURLY), "".join(V.CURLY.values()))


def fix_inverted_bang(text: Column) -> Column:
    return apply_rules(text, INVERTED_BANG)


def split_underscores(text: Column) -> Column:
    return apply_rules(text, UNDERSCORES)


def split_radio_prefix(line: Column) -> Column:
    """A leading circle that was read as a letter, digit or symbol becomes the circle sign, set off by a space."""
    stems = "|".join(V.SAFE_STEMS)

    def decide(x: Column) -> Column:
        s, head, rest = x["s"], F.substring(x["s"], 1, 1), F.substring(x["s"], 2, 1 << 30)
        marked = F.concat(F.regexp_extract(x["line"], r"(?U)^\s*", 0), F.lit(f"{V.RADIO} "))
        keep = (
            (F.length(s) <= 1)
            | ~s.rlike("^[Oo0©®™¢Øø]")
            # A separated O before the remainder of a word of the list, as far as white space.
            | s.rlike(rf"(?U)^O +\s*({stems})(\s|$)")
            | s.rlike(f"^O[{V.AFTER_BIG_O}]|^o[{V.AFTER_SMALL_O}]")
            # Joined to it, as far as letters go.
            | s.rlike(f"^[Oo]({stems})(?![a-záéíóúñA-ZÁÉÍÓÚÑ])")
        )
        drop_space = s.rlike("^[©®™¢Øø]") | (F.substring(rest, 1, 1) == " ")
        split = rest.rlike(r"^[.,:;\p{L}]")
        return F.when(keep & ~s.rlike("^[©®™¢Øø]"), x["line"]).when(F.length(s) <= 1, x["line"]).when(drop_space, F.concat(marked, lstrip(rest))).when(split & head.isin("O", "o", "0"), F.concat(marked, rest)).otherwise(x["line"])

    return once(F.struct(line.alias("line"), strip(line).alias("s")), decide)


def fix_empty_brackets(text: Column) -> Column:
    return apply_rules(text, EMPTY_BRACKETS)


def fix_checked(text: Column) -> Column:
    return apply_rules(text, CHECKED_BRACKETS)


def drop_symbol_noise(text: Column) -> Column:
    return apply_rules(text, SYMBOL_NOISE)


def collapse_spaces(text: Column) -> Column:
    return apply_rules(text, WIDE_SPACES)


def fix_code_tokens(text: Column) -> Column:
    return apply_rules(text, V.CODE_TOKENS)


def fix_gender(text: Column) -> Column:
    return apply_rules(text, V.GENDER)


def split_glued_words(text: Column) -> Column:
    return apply_rules(text, V.GLUED)


def fix_accents(text: Column) -> Column:
    return apply_rules(text, V.ACCENTS)


def fix_digit_letters(text: Column) -> Column:
    return apply_rules(text, V.DIGITS)


def shorten_runs(text: Column) -> Column:
    return apply_rules(text, V.RUNS)


def drop_noise_lines(text: Column) -> Column:
    """Lines of one or two characters stay only if those are letters or digits; blank lines stay."""

    def stays(line: Column) -> Column:
        return once(strip(line), lambda s: ~F.length(s).between(1, 2) | s.rlike("^[a-zA-Z0-9áéíóúñÁÉÍÓÚÑ]+$"))

    return F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")


def is_question_head(line: Column) -> Column:
    return strip(line).rlike(V.QUESTION_HEAD)


def is_option_line(line: Column) -> Column:
    return strip(line).rlike(V.OPTION_LINE)


def is_code_line(s: Column) -> Column:
    """Whether a stripped line reads as program code."""
    out = s.rlike("(?U)(?d)" + "|".join(f"(?:{p})" for p in V.CODE_PATTERNS))
    for op in V.CODE_OPERATORS:
        out = out | s.contains(op)
    return out


def normalize_option_line(line: Column) -> Column:
    """A lettered option gets the circle sign; other lines are treated as ``split_radio_prefix`` does."""
    s = strip(line)
    lettered = r"(?U)(?d)^[a-dA-D][).]\s+(.+)"
    return F.when(s.rlike(rf"(?U)^[{V.RADIO}{V.UNCHECKED}{V.CHECKED}]\s"), line).when(s.rlike(lettered), F.concat(F.lit(f"{V.RADIO} "), F.regexp_extract(s, lettered, 1))).otherwise(split_radio_prefix(line))


def normalize_option_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), normalize_option_line), "\n")


def clean_option_text(text: Column) -> Column:
    """Option text without marks, letters and symbols in front."""
    stems = "|".join(V.SAFE_STEMS)
    text = apply_rules(text, [(rf"^[{V.RADIO}{V.UNCHECKED}{V.CHECKED}]\s*", "")])
    joined = text.rlike(r"(?d)^[Oo0][a-záéíóúñ\\.].*$") & ~text.rlike(f"^O[{V.AFTER_BIG_O}]|^o[{V.AFTER_SMALL_O}]") & ~text.rlike(f"^[Oo]({stems})(?![a-záéíóúñA-ZÁÉÍÓÚÑ])")
    text = once(F.struct(text.alias("t"), joined.alias("j")), lambda x: F.when(x["j"], F.substring(x["t"], 2, 1 << 30)).otherwise(x["t"]))
    text = apply_rules(text, [(r"^[Oo0]\s+", ""), (r"^[a-dA-D][).]\s*", ""), (r"^[Oo0][).]\s*", ""), (r"^[©®™¢Øø]\s*", ""), (r"^\(\)\s*", ""), (r"^\[\]\s*", ""), (r"^[\-–—]\s+", "")])
    return strip(text)


def parse_languages(c: Column) -> Column:
    """``a, b`` and ``a+b`` become ``a+b``; nothing becomes ``spa``."""
    parts = F.filter(F.transform(F.split(c, "[,+]", -1), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "+")).otherwise(F.lit("spa"))


def preview(text: Column, n: int = V.PREVIEW_LINES) -> Column:
    """The first lines, and how many more there are."""
    return once(
        F.split(text, "\n", -1),
        lambda x: F.when(F.size(x) > n, F.concat(F.array_join(F.slice(x, 1, n), "\n"), F.lit("\n... ("), (F.size(x) - n).cast("string"), F.lit(" líneas más)"))).otherwise(F.array_join(x, "\n")),
    )


def output_name(path: Column, run_ts: Column, ext: str) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("_"), F.date_format(run_ts, "yyyy-MM-dd_HH-mm-ss"), F.lit(f".{ext}"))


def one_decimal(x: Column) -> Column:
    """``x`` with one decimal, rounded from its exact binary value, halves to even.

    Only values whose shortest form ends in 5 at the second decimal need care: the sign of 20 * x minus the nearest
    integer, taken from an exact product of halves of x, tells on which side of the tie they lie.
    """
    near = F.round(x * 20)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    off = (high * 20 - near) + (x - high) * 20
    below = F.floor((near - 1) / 2)
    tenths = F.when(off > 0, below + 1).when(off < 0, below).otherwise(below + F.pmod(below, F.lit(2)))
    return F.when((x * 20 == near) & (F.pmod(near, F.lit(2)) == 1), F.format_string("%.1f", tenths / 10)).otherwise(F.format_string("%.1f", x))
