"""Row filters of the preprocessing; null names stay where a comparison would drop them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions and variable types that carry no information.
TRIVIAL_FUNCTIONS = ("str", "unicode", "repr", "len", "doc", "sizeof")
TRIVIAL_VARIABLES = ("Any", "None", "object", "type", "Type[Any]", "Type[cls]", "Type[type]", "Type", "TypeVar", "Optional[Any]")
NO_RETURN = ("nan", "None", "Any")
NO_ARGUMENT = ("Any", "None", "object")


def _outside(c: Column, values) -> Column:
    return c.isNull() | ~c.isin(*values)


def filter_functions(df: DataFrame, names=TRIVIAL_FUNCTIONS, column: str = "name") -> DataFrame:
    return df.where(_outside(F.col(column), names))


def filter_variables(df: DataFrame, types=TRIVIAL_VARIABLES, column: str = "var_type") -> DataFrame:
    return df.where(_outside(F.col(column), types))


def with_type(df: DataFrame, column: str = "var_type") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def filter_returns(df: DataFrame, column: str = "return_type", expressions: str = "return_expr") -> DataFrame:
    """Known return types with at least one return expression."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*NO_RETURN) & (F.size(expressions) > 0))


def filter_arguments(df: DataFrame, name: str = "arg_name", column: str = "arg_type") -> DataFrame:
    return df.where((F.col(name) != "self") & (F.col(column) != "") & ~F.col(column).isin(*NO_ARGUMENT))
