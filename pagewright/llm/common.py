"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.tables import drop_saved, is_small, new_folder, rows_of, saved, scratch_dir, small_side, workspace

__all__ = ["drop_saved", "free_name", "in_steps", "is_small", "let", "new_folder", "rows_of", "saved", "scratch_dir", "small_side", "text_hash", "text_or_empty", "workspace"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_hash(text: str = "text") -> Column:
    """128 bits of a cryptographic hash that stand for a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(text_or_empty(text), 256), 1, 32))


def free_name(df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    name = "_own"
    while name in df.columns:
        name += "_"
    return name


def in_steps(df: DataFrame, steps: dict[str, Callable[[Callable[[str], Column]], Column]], out: str) -> DataFrame:
    """``df`` with column ``out``: the last of ``steps``, each of which may look at the columns of earlier ones by name.

    Deep expressions take the analyzer many rounds; one step at a time takes few, and the optimizer joins them again.
    """
    own = free_name(df)
    now = df
    for name, step in steps.items():
        now = now.withColumn(f"{own}{name}", step(lambda other: F.col(f"{own}{other}")))
    return now.withColumn(out, F.col(f"{own}{name}")).drop(*[f"{own}{name}" for name in steps])
