"""Columns of the caller kept out of the way of an operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shielded(df: DataFrame, own: Callable[[str], bool], outputs: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns renamed whose lower-case names ``own`` claims, and the columns that bring all back.

    A column of the caller named like one of ``outputs`` gives way to it.
    """
    taken = {x.lower() for x in outputs}
    kept = [c for c in df.columns if c.lower() not in taken]
    names = {c: f"caller{i}" if own(c.lower()) else c for i, c in enumerate(kept)}
    while len({n.lower() for n in names.values()}) < len(kept):  # a caller's column may have such a name itself
        names = {c: n + "_" if n != c else n for c, n in names.items()}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items()]
