"""Mapping of raw columns onto the standard schema."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronmap.functions.coerce import as_number
from patronmap.schema import AMOUNT, CUSTOMER, DATE

# Names of the two amount modes.
DIRECT = "Amount column"
QUANTITY_TIMES_PRICE = "Compute as Quantity × Price"


@dataclass(frozen=True)
class ColumnMapping:
    """Raw column names; either `amount_col`, or `qty_col` and `price_col`."""

    customer_col: str
    date_col: str
    amount_col: str | None = None
    qty_col: str | None = None
    price_col: str | None = None

    def __post_init__(self) -> None:
        pair = self.qty_col is not None and self.price_col is not None
        if (self.amount_col is None) != pair:
            raise ValueError("map either an amount column, or a quantity and a price column")

    @property
    def amount_mode(self) -> str:
        return DIRECT if self.amount_col is not None else QUANTITY_TIMES_PRICE

    def to_dict(self) -> dict[str, str | None]:
        return {**asdict(self), "amount_mode": self.amount_mode}


def _quoted(name: str) -> Column:
    """Column by its whole name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def amount_of(df: DataFrame, mapping: ColumnMapping) -> Column:
    if mapping.amount_col is not None:
        return _quoted(mapping.amount_col)
    quantity, price = (_factor(df, name) for name in (mapping.qty_col, mapping.price_col))
    return F.try_multiply(quantity, price)


def _factor(df: DataFrame, name: str) -> Column:
    """Number of a column; integers are widened, and a product beyond that is null."""
    dtype = df.schema[name].dataType
    number = as_number(_quoted(name), dtype)
    return number.cast("bigint") if isinstance(dtype, T.IntegralType) else number


def map_columns(df: DataFrame, mapping: ColumnMapping) -> DataFrame:
    """The three standard columns, not yet cleaned; the scan reads only what is mapped."""
    return df.select(
        _quoted(mapping.customer_col).alias(CUSTOMER),
        _quoted(mapping.date_col).alias(DATE),
        amount_of(df, mapping).alias(AMOUNT),
    )
