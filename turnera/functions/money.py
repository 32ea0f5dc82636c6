"""Prices of token counts in exact decimals: half a micro-dollar always rounds up."""

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnera.fixed_values import RATE_USD_PER_MILLION


def cost(tokens: Column, rate: Decimal = RATE_USD_PER_MILLION) -> Column:
    """USD for a token count, 6 decimals; null for null."""
    return F.round(tokens.cast("decimal(20,0)") * F.lit(Decimal(rate).scaleb(-6)), 6)


def projected_tokens(total: Column, rows: Column, messages: Column) -> Column:
    """``total / rows * messages`` to the nearest whole number, ties to even."""
    product, divisor = _whole(total) * _whole(messages), _divisor(rows)
    quotient = F.call_function("div", product, divisor)
    twice = (product - _whole(quotient) * divisor) * 2
    up = (twice > divisor) | ((twice == divisor) & (quotient % 2 == 1))
    return quotient + F.when(up, 1).otherwise(0)


def projected_cost(total: Column, rows: Column, messages: Column, rate: Decimal = RATE_USD_PER_MILLION) -> Column:
    """Cost of the unrounded average times ``messages``, in the integers throughout."""
    price = Fraction(Decimal(rate))
    product = _whole(total) * _whole(messages) * F.lit(2 * price.numerator).cast("decimal(10,0)")
    divisor = _divisor(rows) * F.lit(price.denominator).cast("decimal(10,0)")
    micros = F.call_function("div", product + divisor, divisor * 2)
    return micros.cast("decimal(20,0)") * F.lit(Decimal("0.000001"))


def _whole(number: Column) -> Column:
    return number.cast("decimal(20,0)")


def _divisor(rows: Column) -> Column:
    return F.greatest(_whole(rows), F.lit(1).cast("decimal(20,0)"))
