"""Expressions over vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARGUMENT_ROWS, TOKEN_ROWS, RETURN_TOKEN_ROWS = 10, 21, 7


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean, in double precision."""
    return F.sqrt(squared_distance(a, b))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def identifier_layout(task: Column, name: Column, function: Column, arguments: Column, parity: bool = False) -> Column:
    """31 token places of a datapoint: arrays of tokens, cut and padded, '<sep>' as the separator.

    Parameters are name, separator, function, arguments; returns function, separator,
    arguments; variables their name.  ``parity`` lays parameters out like returns, and
    returns as separator and arguments only, as earlier trained models expect.
    """
    from slotloom.functions.text import fixed_length

    ten = lambda c: fixed_length(c, ARGUMENT_ROWS)
    sep, pad = F.array(F.lit("<sep>")), lambda n: F.array_repeat(F.lit(""), n)
    documented = F.when(task == "Parameter", F.concat(ten(name), sep, ten(function), ten(arguments))).when(task == "Return", F.concat(ten(function), sep, ten(arguments), pad(10))).otherwise(F.concat(ten(name), pad(21)))
    if not parity:
        return documented
    return F.when(task == "Parameter", F.concat(ten(function), sep, ten(arguments), pad(10))).when(task == "Return", F.concat(sep, ten(arguments), pad(20))).otherwise(F.concat(ten(name), pad(21)))


def token_layout(task: Column, usage: Column) -> Column:
    """21 token places; returns fill the first 7 only."""
    from slotloom.functions.text import fixed_length

    return F.when(task == "Return", F.concat(fixed_length(usage, RETURN_TOKEN_ROWS), F.array_repeat(F.lit(""), TOKEN_ROWS - RETURN_TOKEN_ROWS))).otherwise(fixed_length(usage, TOKEN_ROWS))
