"""Expressions: a tiny immutable tree that binds to Spark columns.

The tree exists for three things Spark's ``Column`` can't do by itself: the
``FUNC(arg)`` naming rule, integer division that depends on operand types, and
a plan-time error for comparing text with numbers.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.errors import InvalidOperation

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
COMPUTE = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}
COMPARISONS, ARITHMETIC = tuple(COMPARE), tuple(COMPUTE)
LOGICAL = ("AND", "OR")
#: Integer widths a literal can ask for, by name.
WIDTHS = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "f32": "float", "f64": "double"}
AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


#: Whole numbers, narrowest first.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def kind_of(t: T.DataType) -> str:
    """What the rules need to know of a type: text is never compared with a
    number, and two whole numbers are divided as such."""
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.IntegralType | T.DoubleType):
        return t.simpleString()
    return "number" if isinstance(t, T.NumericType) else "other"


def numeric(kind: str) -> bool:
    return kind in WHOLE or kind in ("double", "number")


def alike(a: Column, ka: str, b: Column, kb: str) -> tuple[Column, Column, str]:
    """Both with the casts that Spark would add, and their kind. Spark finds one
    level of casts a pass, and ends a long chain of them with an error."""
    if ka in WHOLE and kb in WHOLE:
        wide = max(ka, kb, key=WHOLE.index)
    elif "double" in (ka, kb) and numeric(ka) and numeric(kb):
        wide = "double"
    else:
        return a, b, "number" if numeric(ka) and numeric(kb) else "other"
    return (a if ka == wide else a.cast(wide)), (b if kb == wide else b.cast(wide)), wide


class Expression:
    """Common fluent surface of all expressions."""

    def name(self) -> str:
        raise NotImplementedError

    def typed(self, df: DataFrame) -> tuple[Column, str]:
        """This expression as an unnamed Spark column over ``df``, and its kind
        of type (see kind_of): one pass over the tree, without asking Spark."""
        raise NotImplementedError

    def bind(self, df: DataFrame) -> Column:
        return self.typed(df)[0]

    def bound(self, df: DataFrame) -> Column:
        return self.bind(df).alias(self.name())

    def dtype(self, df: DataFrame) -> T.DataType:
        return df.select(self.bind(df)).schema[0].dataType

    def has_aggregate(self) -> bool:
        return False

    def alias(self, name: str) -> Expression:
        return Alias(self, name)

    def cast(self, kind: str) -> Expression:
        """This value as a Spark type; the name stays."""
        return Cast(self, kind)

    def eq(self, other) -> Expression:
        return binary(self, "=", other)

    def neq(self, other) -> Expression:
        return binary(self, "!=", other)

    def lt(self, other) -> Expression:
        return binary(self, "<", other)

    def lt_eq(self, other) -> Expression:
        return binary(self, "<=", other)

    def gt(self, other) -> Expression:
        return binary(self, ">", other)

    def gt_eq(self, other) -> Expression:
        return binary(self, ">=", other)

    def and_(self, other) -> Expression:
        return binary(self, "AND", other)

    def or_(self, other) -> Expression:
        return binary(self, "OR", other)

    def __add__(self, other) -> Expression:
        return binary(self, "+", other)

    def __sub__(self, other) -> Expression:
        return binary(self, "-", other)

    def __mul__(self, other) -> Expression:
        return binary(self, "*", other)

    def __truediv__(self, other) -> Expression:
        return binary(self, "/", other)


@dataclass(frozen=True)
class ColumnRef(Expression):
    column: str

    def name(self) -> str:
        return self.column

    def typed(self, df: DataFrame) -> tuple[Column, str]:
        same = [f for f in df.schema if f.name.lower() == self.column.lower()]
        made = F.col(f"`{self.column}`" if same else self.column)
        # a name with a frame's alias is the one thing that only Spark resolves
        return made, kind_of(same[0].dataType if same else df.select(made).schema[0].dataType)

    def bound(self, df: DataFrame) -> Column:
        return self.bind(df)


@dataclass(frozen=True)
class Literal(Expression):
    value: Any
    width: str | None = None

    def name(self) -> str:
        return str(self.value)

    def typed(self, df: DataFrame) -> tuple[Column, str]:
        made = F.lit(self.value)
        if self.width:
            return made.cast(WIDTHS[self.width]), kind_of(T.DataType.fromDDL(WIDTHS[self.width]))
        v = self.value
        if isinstance(v, int) and not isinstance(v, bool):
            return made, "int" if -(2**31) <= v < 2**31 else "bigint"
        return made, "text" if isinstance(v, str) else "double" if isinstance(v, float) else "number" if isinstance(v, Decimal) else "other"


@dataclass(frozen=True)
class Alias(Expression):
    inner: Expression
    label: str

    def name(self) -> str:
        return self.label

    def typed(self, df: DataFrame) -> tuple[Column, str]:
        return self.inner.typed(df)

    def has_aggregate(self) -> bool:
        return self.inner.has_aggregate()


@dataclass(frozen=True)
class Cast(Expression):
    inner: Expression
    kind: str

    def name(self) -> str:
        return self.inner.name()

    def typed(self, df: DataFrame) -> tuple[Column, str]:
        return self.inner.bind(df).cast(self.kind), kind_of(T.DataType.fromDDL(self.kind))

    def has_aggregate(self) -> bool:
        return self.inner.has_aggregate()


@dataclass(frozen=True)
class Binary(Expression):
    left: Expression
    op: str
    right: Expression

    def name(self) -> str:
        return f"{self.left.name()} {self.op} {self.right.name()}"

    def has_aggregate(self) -> bool:
        return self.left.has_aggregate() or self.right.has_aggregate()

    def typed(self, df: DataFrame) -> tuple[Column, str]:
        (a, ka), (b, kb) = self.left.typed(df), self.right.typed(df)
        if self.op in LOGICAL:
            return (a & b if self.op == "AND" else a | b), "other"
        if self.op in COMPARISONS:
            if "text" in (ka, kb) and (numeric(ka) or numeric(kb)):
                raise InvalidOperation(f"can't compare text with a number: {self.name()}")
            return COMPARE[self.op](a, b), "other"
        a, b, kind = alike(a, ka, b, kb)
        if self.op == "/" and kind in WHOLE:
            return F.call_function("div", a, b), "bigint"
        made = COMPUTE[self.op](a, b)
        # dates, texts and NULL in arithmetic: Spark's own rules say what comes out
        return made, kind if kind != "other" else kind_of(df.select(made).schema[0].dataType)


@dataclass(frozen=True)
class Aggregate(Expression):
    func: str
    arg: Expression

    def name(self) -> str:
        return f"{self.func}({self.arg.name()})"

    def typed(self, df: DataFrame) -> tuple[Column, str]:
        made, kind = self.arg.typed(df)
        if self.func not in ("MIN", "MAX"):
            kind = "bigint" if self.func == "COUNT" or (self.func == "SUM" and kind in WHOLE) else "double" if self.func == "AVG" and (kind in WHOLE or kind == "double") else "number"
        return AGGREGATES[self.func](made), kind

    def has_aggregate(self) -> bool:
        return True


@dataclass(frozen=True)
class SortKey(Expression):
    inner: Expression
    ascending: bool = True

    def name(self) -> str:
        return self.inner.name()

    def typed(self, df: DataFrame) -> tuple[Column, str]:
        made, kind = self.inner.typed(df)
        return (made.asc_nulls_first() if self.ascending else made.desc_nulls_first()), kind


def wrap(value) -> Expression:
    return value if isinstance(value, Expression) else lit(value)


def col(name: str) -> Expression:
    """A column by name; ``alias.name`` where a frame has an alias."""
    return ColumnRef(name)


def lit(value, width: str | None = None) -> Expression:
    """A constant; ``width`` names an integer or float width (i8 … u64, f32, f64)."""
    if width is not None and width not in WIDTHS:
        raise InvalidOperation(f"unknown literal width {width}")
    return Literal(value, width)


def binary(left, op: str, right) -> Expression:
    op = op.upper()
    if op not in (*COMPARISONS, *ARITHMETIC, *LOGICAL):
        raise InvalidOperation(f"unknown operator {op}")
    return Binary(wrap(left), op, wrap(right))


def aggregate(func: str, arg) -> Expression:
    if func.upper() not in AGGREGATES:
        raise InvalidOperation(f"unknown aggregate {func}")
    return Aggregate(func.upper(), wrap(arg))


def count(arg) -> Expression:
    return aggregate("COUNT", arg)


def sum_(arg) -> Expression:
    return aggregate("SUM", arg)


def avg(arg) -> Expression:
    return aggregate("AVG", arg)


def min_(arg) -> Expression:
    return aggregate("MIN", arg)


def max_(arg) -> Expression:
    return aggregate("MAX", arg)


def sort(arg, ascending: bool = True) -> Expression:
    """A sort key; NULLs come first in either direction."""
    return SortKey(wrap(arg), ascending)
