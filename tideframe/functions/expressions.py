"""Expression language over ``value``; every function returns a Spark Column.

Arguments are Columns or plain literals; ``id()`` is the value itself. Comparisons with null never
match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def id() -> Column:
    return F.col("value")


def with_attr(name: str, of: Column | None = None) -> Column:
    """Field ``name`` of a record value."""
    return (id() if of is None else of)[name]


def add(left_exp, right_exp) -> Column:
    return _c(left_exp) + _c(right_exp)


def sub(left_exp, right_exp) -> Column:
    return _c(left_exp) - _c(right_exp)


def mul(left_exp, right_exp) -> Column:
    return _c(left_exp) * _c(right_exp)


def div(left_exp, right_exp) -> Column:
    """Null when the divisor is 0."""
    return F.try_divide(_c(left_exp), _c(right_exp))


def abs(exp) -> Column:
    return F.abs(_c(exp))


def divisible_by(exp, n) -> Column:
    return F.pmod(_c(exp), _c(n)) == 0


def sqrt(exp) -> Column:
    return F.sqrt(_c(exp))


def exp(exp_) -> Column:
    return F.exp(_c(exp_))


def log(exp) -> Column:
    return F.ln(_c(exp))


def log10(exp) -> Column:
    return F.log10(_c(exp))


def sin(exp) -> Column:
    return F.sin(_c(exp))


def cos(exp) -> Column:
    return F.cos(_c(exp))


def tan(exp) -> Column:
    return F.tan(_c(exp))


def asin(exp) -> Column:
    return F.asin(_c(exp))


def acos(exp) -> Column:
    return F.acos(_c(exp))


def atan(exp) -> Column:
    return F.atan(_c(exp))


def sinh(exp) -> Column:
    return F.sinh(_c(exp))


def cosh(exp) -> Column:
    return F.cosh(_c(exp))


def tanh(exp) -> Column:
    return F.tanh(_c(exp))


def concat(*exps) -> Column:
    return F.concat(*[_c(e).cast("string") for e in exps])


def eq(left_exp, right_exp) -> Column:
    return _c(left_exp) == _c(right_exp)


def gt(left_exp, right_exp) -> Column:
    return _c(left_exp) > _c(right_exp)


def gte(left_exp, right_exp) -> Column:
    return _c(left_exp) >= _c(right_exp)


def lt(left_exp, right_exp) -> Column:
    return _c(left_exp) < _c(right_exp)


def lte(left_exp, right_exp) -> Column:
    return _c(left_exp) <= _c(right_exp)


def contains(exp, item, array: bool = False) -> Column:
    """Text contains ``item``; with ``array`` the array contains it."""
    return F.array_contains(_c(exp), item) if array else _c(exp).contains(item)


def starts_with(exp, prefix) -> Column:
    return _c(exp).startswith(prefix)


def ends_with(exp, suffix) -> Column:
    return _c(exp).endswith(suffix)


def matches(exp, pattern: str) -> Column:
    """The whole text matches the regular expression."""
    return _c(exp).rlike(f"^(?:{pattern})$")


def logical_not(exp) -> Column:
    return ~_c(exp)


def logical_and(left_exp, right_exp) -> Column:
    return _c(left_exp) & _c(right_exp)


def logical_or(left_exp, right_exp) -> Column:
    return _c(left_exp) | _c(right_exp)


def if_then(if_exp, then_exp) -> Column:
    """Null when the condition does not hold."""
    return F.when(_c(if_exp), _c(then_exp))


def if_then_else(if_exp, then_exp, else_exp) -> Column:
    return F.when(_c(if_exp), _c(then_exp)).otherwise(_c(else_exp))


def match_case(exp, cases, default=None) -> Column:
    """``cases``: (value, result) pairs tried in order."""
    out = None
    for value, result in cases:
        cond = _c(exp) == _c(value)
        out = F.when(cond, _c(result)) if out is None else out.when(cond, _c(result))
    return out.otherwise(_c(default))


# Aggregates, for segments and series.


def avg(exp=None) -> Column:
    return F.avg(id() if exp is None else _c(exp))


def count(exp=None) -> Column:
    return F.count(F.lit(1) if exp is None else _c(exp))


def sum(exp=None) -> Column:
    return F.sum(id() if exp is None else _c(exp))


def min(exp=None) -> Column:
    return F.min(id() if exp is None else _c(exp))


def max(exp=None) -> Column:
    return F.max(id() if exp is None else _c(exp))


def stdev(exp=None) -> Column:
    return F.stddev_samp(id() if exp is None else _c(exp))


def var(exp=None) -> Column:
    return F.var_samp(id() if exp is None else _c(exp))
