"""The fluent frame: every method is one Spark logical operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

from brindle.errors import InvalidOperation, translated
from brindle.functions import Expression, SortKey

JOINS = {"inner": "inner", "left": "left_outer"}


class Frame:
    """An immutable, lazy table; ``df`` is the Spark DataFrame behind it."""

    def __init__(self, df: DataFrame, label: str | None = None):
        self.df = df
        self.label = label

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def alias(self, label: str) -> Frame:
        """Name this frame so that ``label.column`` is unambiguous after a join."""
        return Frame(self.df.alias(label), label)

    @translated
    def select(self, *exprs: Expression) -> Frame:
        return Frame(self.df.select(*[e.bound(self.df) for e in exprs]))

    @translated
    def filter(self, predicate: Expression) -> Frame:
        bound = predicate.bind(self.df)
        kind = self.df.select(bound).schema[0].dataType
        if not isinstance(kind, T.BooleanType | T.NullType):
            raise InvalidOperation(f"a filter needs a boolean, not {kind.simpleString()}: {predicate.name()}")
        return Frame(self.df.filter(bound.cast("boolean")), self.label)

    @translated
    def aggregate(self, group_by: list[Expression], aggs: list[Expression]) -> Frame:
        """Keys first, then aggregates; NULL keys form a group; no keys: one row."""
        if bad := [e.name() for e in aggs if not e.has_aggregate()]:
            raise InvalidOperation(f"not aggregates: {', '.join(bad)}")
        keys = [e.bound(self.df) for e in group_by]
        if not aggs:
            return Frame(self.df.select(*keys).distinct())
        return Frame(self.df.groupBy(*keys).agg(*[e.bound(self.df) for e in aggs]))

    @translated
    def order_by(self, *exprs: Expression) -> Frame:
        return Frame(self.df.orderBy(*[(e if isinstance(e, SortKey) else SortKey(e)).bind(self.df) for e in exprs]), self.label)

    @translated
    def limit(self, skip: int = 0, fetch: int | None = None) -> Frame:
        """Skip rows, then keep at most ``fetch`` (None: all that remain)."""
        if skip < 0 or (fetch is not None and fetch < 0):
            raise InvalidOperation("limit needs counts of zero or more")
        out = self.df.offset(skip) if skip else self.df
        return Frame(out if fetch is None else out.limit(fetch), self.label)

    @translated
    def join(self, other: Frame, how: str = "inner", on_left: list[str] = (), on_right: list[str] = (), filter: Expression | None = None) -> Frame:  # noqa: A002
        """Equi keys pair up in order; ``filter`` belongs to the join condition,
        so a left join keeps rows that fail it with NULLs on the right. Without
        keys and filter it is the cross product. Output: left columns, right columns."""
        if how not in JOINS:
            raise InvalidOperation(f"unknown join {how}")
        if len(on_left) != len(on_right):
            raise InvalidOperation("a join needs as many left as right keys")
        for frame, names in ((self, on_left), (other, on_right)):
            if missing := [n for n in names if n.lower() not in (c.lower() for c in frame.columns)]:
                raise InvalidOperation(f"no join key {', '.join(missing)} among {', '.join(frame.columns)}")
        left, right = self.label or "lhs", other.label or "rhs"
        if left == right:
            right = f"{right}_right"
        a, b = self.df.alias(left), other.df.alias(right)
        from pyspark.sql import functions as F

        condition = None
        for x, y in zip(on_left, on_right, strict=True):
            pair = F.col(f"{left}.`{x}`") == F.col(f"{right}.`{y}`")
            condition = pair if condition is None else condition & pair
        if filter is not None:
            residual = filter.bind(a.join(b))
            condition = residual if condition is None else condition & residual
        if condition is None and how == "inner":
            return Frame(a.crossJoin(b))
        return Frame(a.join(b, F.lit(True) if condition is None else condition, JOINS[how]))

    @translated
    def distinct(self) -> Frame:
        return Frame(self.df.distinct())

    @translated
    def collect(self) -> list[Row]:
        return self.df.collect()

    def to_arrow(self):
        return self.df.toArrow()

    @translated
    def show(self, rows: int | None = None) -> None:
        """Prints all rows, or the first ``rows``."""
        self.df.show(2**31 - 1 if rows is None else rows, truncate=False)

    def explain(self, mode: str = "formatted") -> str:
        from brindle.plans import explain

        return explain(self.df, mode)
