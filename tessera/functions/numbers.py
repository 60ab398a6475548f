"""Numbers as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products with powers of ten are exact.
SPLIT = 134217729.0


def fixed(x: Column, digits: int) -> Column:
    """A double with ``digits`` places as Python and C print it: the exact binary value rounded, ties to even. The JVM's %.3f rounds the
    shortest decimal instead, ties up. Values from 1e12 on, and those that aren't finite, are left to it."""
    t = float(10**digits)
    c = x * SPLIT
    high = c - (c - x)
    low = (x - high) * t
    near = F.rint(x * t)
    left = high * t - near
    n = F.abs(near + F.when((left - 0.5) + low > 0, 1.0).when((left + 0.5) + low < 0, -1.0).otherwise(0.0)).cast("long")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, F.floor(n / int(t)).cast("string"), F.lit("."), F.lpad((n % int(t)).cast("string"), digits, "0"))
    return F.when(F.abs(x) < 1e12, text).otherwise(F.format_string(f"%.{digits}f", x))
