"""Names of columns on their way through an operator: none of the input's can clash with those of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def private(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], str]:
    """(doc_id long, text, and the columns carried under names of their own), these names, and their part of a schema. The text travels once."""
    names = ["text" if c == text_col else f"carried_{i}" for i, c in enumerate(carry)]
    out = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names) if n != "text"))
    return out, names, "".join(f", {n} {out.schema[n].dataType.simpleString()}" for n in names)


def public(df: DataFrame, carry: tuple[str, ...], names: list[str]) -> DataFrame:
    """The result's columns, and those carried under their own names; one named like a column of the result has `_in` behind."""
    own = [c for c in df.columns if c not in names]
    taken = {c.lower() for c in own}
    shown = []
    for c in carry:
        while c.lower() in taken:
            c += "_in"
        taken.add(c.lower())
        shown.append(c)
    return df.select(*own, *(F.col(n).alias(c) for n, c in zip(names, shown)))
