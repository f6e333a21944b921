"""Names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def refuse(df: DataFrame, names: list[str], what: str) -> None:
    """Raise an error if df has columns of these names."""
    clash = sorted({n.lower() for n in names} & {c.lower() for c in df.columns})
    if clash:
        raise ValueError(f"{what} has columns named {clash}")
