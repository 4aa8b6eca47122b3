"""Cost of metered requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tiered_cost(inputs: Column, outputs: Column, long_from: float, input_rate: float, output_rate: float, factor: float) -> Column:
    """Inputs of a long request (over ``long_from``) cost ``factor`` times their rate."""
    scale = F.when(inputs > long_from, F.lit(factor)).otherwise(F.lit(1.0))
    return inputs * scale * input_rate + outputs * output_rate


def usage(value: Column) -> Column:
    """Money rounded to eight places."""
    return F.round(value, 8)
