"""Real elementwise functions as column expressions. ANSI errors are avoided: division by zero gives IEEE values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def divide(a: Column | float, b: Column | float) -> Column:
    """a / b as IEEE arithmetic has it: x / 0 is an infinity, 0 / 0 is not a number."""
    a, b = num(a), num(b)
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))
    return F.when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def add(a, b):
    return num(a) + num(b)


def subtract(a, b):
    return num(a) - num(b)


def multiply(a, b):
    return num(a) * num(b)


add_scalar, subtract_scalar, scale, divide_scalar = add, subtract, multiply, divide


def scalar_subtract(x, s):
    return num(s) - num(x)


def scalar_divide(x, s):
    return divide(s, x)


def add_subtract(a, b, c):
    """a + b - c."""
    return num(a) + num(b) - num(c)


def multiply_accumulate(acc, a, b):
    return num(acc) + num(a) * num(b)


def scale_add(x, alpha, y):
    return num(x) * num(alpha) + num(y)


def linear_combination(*terms):
    """Sum of x * s over pairs (x, s)."""
    out = num(terms[0][0]) * num(terms[0][1])
    for x, s in terms[1:]:
        out = out + num(x) * num(s)
    return out


def lerp(a, b, t):
    return num(a) + (num(b) - num(a)) * num(t)


def negate(x):
    return -num(x)


def absolute(x):
    return F.abs(num(x))


abs_value = absolute


def square(x):
    return num(x) * num(x)


def sqrt(x):
    return F.sqrt(num(x))


def inverse(x):
    return divide(1.0, x)


def rsqrt(x):
    return divide(1.0, F.sqrt(num(x)))


inverse_sqrt = rsqrt


def exp(x):
    return F.exp(num(x))


def log(x):
    """Natural logarithm: minus infinity at 0, not a number below."""
    x = num(x)
    return F.when(F.isnan(x) | (x < 0), F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.ln(F.when(x > 0, x)))


def minimum(a, b):
    """The smaller; if either is not a number, the first unless the second is smaller."""
    a, b = num(a), num(b)
    return F.when(~F.isnan(b) & ~F.isnan(a) & (b < a), b).otherwise(a)


def maximum(a, b):
    a, b = num(a), num(b)
    return F.when(~F.isnan(b) & ~F.isnan(a) & (a < b), b).otherwise(a)


cwise_min, cwise_max = minimum, maximum


def hypot(a, b):
    return F.hypot(num(a), num(b))


def clamp(x, lower, upper):
    """x limited to [lower, upper]; not-a-number stays, infinities are limited."""
    x = num(x)
    return F.when(F.isnan(x), x).when(x < num(lower), num(lower)).when(x > num(upper), num(upper)).otherwise(x)


clip = clamp


def isfinite(x):
    x = num(x)
    return ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def replace_nan(x, value):
    return F.nanvl(num(x), num(value))


def bitwise_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bitwise_not(a: Column) -> Column:
    return F.bitwise_not(a)


def where(mask: Column, a, b) -> Column:
    return F.when(mask, num(a)).otherwise(num(b))


copy_where_equal = lambda mask, value, source, target: where(mask == value, source, target)


def soft_threshold(x, lam, eps=1e-9):
    """x drawn towards 0 by lam; 0 where |x| < eps."""
    x = num(x)
    m = F.abs(x)
    return F.when(m < eps, F.lit(0.0)).otherwise(x / F.when(m < eps, F.lit(1.0)).otherwise(m) * F.greatest(m - num(lam), F.lit(0.0)))


def floor_mod(v, m):
    """v - floor(v / m) m; v itself for m = 0."""
    v, m = num(v), num(m)
    safe = F.when(m == 0, F.lit(1.0)).otherwise(m)
    return F.when(m == 0, v).otherwise(v - F.floor(v / safe) * safe)


def floor_mod_fix(v, m, eps=2.220446049250313e-16):
    """floor_mod(), where a result over |m| - 10 eps has |m| taken off (or, under its negative, put on)."""
    r, size = floor_mod(v, m), F.abs(num(m))
    cutoff = size - F.lit(10.0 * eps)
    return F.when(num(m) == 0, num(v)).when(r > cutoff, r - size).when(r < -cutoff, r + size).otherwise(r)


def order(x):
    """The power of ten that |x| does not exceed: ceil(log10 |x|); null for 0."""
    x = F.abs(num(x))
    return F.when(x > 0, F.ceil(F.log10(F.when(x > 0, x)))).cast("double")


def round_value(x):
    """Halves go away from zero."""
    x = num(x)
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def threshold(x, t, high=1.0, low=0.0):
    x = num(x)
    return F.when(~F.isnan(x) & (x >= num(t)), num(high)).otherwise(num(low))


def wrap_phase(x, limit=math.pi):
    """x less a multiple of 2 limit, in (-limit, limit]."""
    x = num(x)
    return x - F.lit(2.0 * limit) * F.ceil((x - F.lit(limit)) / F.lit(2.0 * limit))
