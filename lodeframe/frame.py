"""A named table of the declarative pipeline: a DataFrame, its units and the notes on how it came about."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.errors import require

#: Hidden column: the row's place in its source.
ORDER = "__order"


@dataclass(frozen=True)
class Frame:
    """Immutable; every operator makes a new one. ``df`` holds the columns and ORDER."""

    df: DataFrame
    columns: tuple[str, ...]
    units: dict[str, str] = field(default_factory=dict)
    notes: tuple[dict, ...] = ()

    @classmethod
    def of(cls, df: DataFrame, units: dict[str, str] | None = None, order: Column | None = None) -> Frame:
        """A frame over df; ``order`` says which row comes first (by default as Spark reads them)."""
        names = df.columns
        require(len({n.casefold() for n in names}) == len(names), "input_headers_invalid")
        return cls(df.withColumn(ORDER, F.monotonically_increasing_id() if order is None else order), tuple(names), dict(units or {}))

    def need(self, *names: str) -> None:
        require(all(n in self.columns for n in names), "unknown_column")

    def became(self, df: DataFrame, columns=None, units=None, **note) -> Frame:
        return replace(self, df=df, columns=tuple(columns or self.columns), units=self.units if units is None else units, notes=(*self.notes, note))

    def result(self) -> DataFrame:
        return self.df.select(*(f"`{c}`" for c in self.columns))


def missing(name: str) -> Column:
    """Null, or empty text."""
    c = F.col(f"`{name}`")
    return c.isNull() | (c.cast("string") == "")
