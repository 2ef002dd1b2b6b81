"""Column names that operators make, beside columns of the same name in their input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def set_aside(docs: DataFrame, made: Iterable[str]) -> DataFrame:
    """``docs`` with underscores behind each column that is named like one of ``made``.

    Names that differ in case alone are the same name. No column is lost.
    """
    made = {name.lower() for name in made}
    taken = made | {c.lower() for c in docs.columns}
    new = {}
    for column in docs.columns:
        if column.lower() in made:
            name = column
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            new[column] = name
    return docs.withColumnsRenamed(new) if new else docs
