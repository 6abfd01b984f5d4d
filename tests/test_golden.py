"""The engine's end-to-end cases on tiny CSV files."""

import pytest

from brindle import CsvReadOptions, SessionContext, avg, col, count, lit, max_, min_, sort, sum_
from brindle.errors import InvalidOperation, SourceError, SqlSyntaxError

FILES = {
    "simple": ("c", "a,1,2 b,2,3 c,3,4 d,4,5 e,5,6 f,6,7"),
    "simple_aggregate": ("c", "a,1,2 c,3,4 a,2,3 d,4,5 c,5,6 f,6,7 b,7,8"),
    "distinct": ("c", "a,1,2 c,3,4 a,1,2 d,4,5 c,3,4 f,6,7 b,7,8"),
    "join_left": ("l", "a,1,10 b,2,20 c,3,30 d,4,40 e,5,50 f,6,60"),
    "join_left_2": ("l", "a,1,10 a,1,10 b,2,20 c,3,30 d,4,40 e,5,50 f,6,60"),
    "join_right": ("r", "a,100,1000 b,200,2000 c,300,3000"),
}


@pytest.fixture(scope="module")
def ctx(spark, tmp_path_factory):
    made, top = SessionContext(spark), tmp_path_factory.mktemp("csv")
    for name, (letter, rows) in FILES.items():
        (top / f"{name}.csv").write_text("\n".join([",".join(f"{letter}{i}" for i in (1, 2, 3)), *rows.split()]))
        made.register_csv(name, str(top / f"{name}.csv"))
    made.top = top
    return made


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def unordered(frame):
    return sorted(rows(frame), key=str)


def data(name):
    return [(a, int(b), int(c)) for a, b, c in (r.split(",") for r in FILES[name][1].split())]


def test_flagship(ctx):
    out = ctx.sql('SELECT l1, SUM(r2), AVG(r3) FROM join_left LEFT JOIN join_right ON l1 = r1 WHERE l3 < 40 GROUP BY l1 ORDER BY "SUM(r2)" DESC')
    assert out.columns == ["l1", "SUM(r2)", "AVG(r3)"]
    assert rows(out) == [("c", 300, 3000.0), ("b", 200, 2000.0), ("a", 100, 1000.0)]


def test_sql_sort_and_limit(ctx):
    assert rows(ctx.sql("SELECT c1, c2 FROM simple ORDER BY c2 DESC LIMIT 2")) == [("f", 6), ("e", 5)]
    assert [r[0] for r in rows(ctx.sql("SELECT c1, c2 FROM simple ORDER BY c2 DESC"))] == list("fedcba")


def test_sql_distinct(ctx):
    assert [r[0] for r in unordered(ctx.sql("SELECT DISTINCT c1 FROM distinct"))] == list("abcdf")


def test_sql_group(ctx):
    assert unordered(ctx.sql("SELECT c1, SUM(c3), MIN(c2) FROM simple GROUP BY c1")) == [(a, c, b) for a, b, c in data("simple")]


def test_sql_project_filter_star(ctx):
    assert unordered(ctx.sql("SELECT c1, c3 FROM simple")) == [(a, c) for a, _, c in data("simple")]
    assert unordered(ctx.sql("SELECT * FROM simple WHERE c2 <= 3")) == data("simple")[:3]
    assert unordered(ctx.sql("SELECT * FROM simple")) == data("simple")


def test_sql_self_join_has_duplicate_names(ctx):
    out = ctx.sql("SELECT * FROM simple l LEFT JOIN simple r ON l.c1 = r.c1")
    assert out.columns == ["c1", "c2", "c3"] * 2 and len(rows(out)) == 6


def test_select_distinct(ctx):
    assert [r[0] for r in unordered(ctx.table("distinct").select(col("c1")).distinct())] == list("abcdf")


@pytest.mark.parametrize(("left", "how", "keyed", "keep", "expected"), [
    ("join_left", "inner", False, col("l2").gt(1), 15),
    ("join_left", "inner", False, None, 18),
    ("join_left", "inner", True, col("l2").gt(1), 2),
    ("join_left_2", "inner", True, None, 4),
    ("join_left", "inner", True, None, 3),
    ("join_left", "left", True, col("l1").neq("a"), 6),
    ("join_left_2", "left", True, None, 7),
    ("join_left", "left", True, None, 6),
    ("join_left", "inner", True, col("r2").neq(100), 2),
    ("join_left", "left", False, col("l2").neq(1), 16),
    ("join_left", "left", False, None, 18),
    ("join_left", "inner", False, col("r2").neq(100), 12),
])
def test_joins(ctx, left, how, keyed, keep, expected):
    on = (["l1"], ["r1"]) if keyed else ([], [])
    out = ctx.table(left).join(ctx.table("join_right"), how, *on, keep)
    assert out.columns == ["l1", "l2", "l3", "r1", "r2", "r3"]
    assert len(rows(out)) == expected


def test_left_join_filter_is_part_of_on(ctx):
    out = unordered(ctx.table("join_left").join(ctx.table("join_right"), "left", ["l1"], ["r1"], col("l1").neq("a")))
    assert [r[0] for r in out if r[3] is not None] == ["b", "c"]
    assert [r[0] for r in out if r[3] is None] == ["a", "d", "e", "f"]


def test_limit_skip_fetch(ctx):
    assert rows(ctx.table("simple").limit(1, 2)) == [("b", 2, 3), ("c", 3, 4)]
    assert len(rows(ctx.table("simple").limit(4))) == 2


def test_aggregate_order(ctx):
    out = ctx.table("simple_aggregate").aggregate([col("c1")], [count(col("c1")), sum_(col("c2"))]).order_by(sort(col("SUM(c2)"), False), col("c1"))
    assert out.columns == ["c1", "COUNT(c1)", "SUM(c2)"]
    assert rows(out) == [("c", 2, 8), ("b", 1, 7), ("f", 1, 6), ("d", 1, 4), ("a", 2, 3)]


def test_five_aggregates(ctx):
    c = col("c2")
    five = [count(c), sum_(c), avg(c), max_(c), min_(c)]
    assert unordered(ctx.table("simple_aggregate").aggregate([col("c1")], five)) == [("a", 2, 3, 1.5, 2, 1), ("b", 1, 7, 7.0, 7, 7), ("c", 2, 8, 4.0, 5, 3), ("d", 1, 4, 4.0, 4, 4), ("f", 1, 6, 6.0, 6, 6)]
    assert rows(ctx.table("simple").filter(col("c1").neq("a")).aggregate([], five)) == [(5, 20, 4.0, 6, 2)]


def test_filters_and_collect(ctx):
    t = ctx.table("simple")
    assert len(rows(t.select(col("c1"), col("c2")).filter(col("c2").neq(lit(2, "i32"))))) == 5
    assert len(rows(t.select(col("c1"), col("c3")).filter(col("c1").neq("a")))) == 5
    assert unordered(t) == data("simple")


def test_csv_options_and_types(ctx):
    path = ctx.top / "odd.csv"
    path.write_text("'x;y';1\n;2\n'z';\n")
    out = ctx.read_csv(str(path), CsvReadOptions().with_delimiter(";").with_quote("'").with_has_header(False))
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "bigint"]
    assert sorted(rows(out), key=str) == sorted([("x;y", 1), (None, 2), ("z", None)], key=str)
    given = ctx.read_csv(str(ctx.top / "simple.csv"), CsvReadOptions().with_schema("c1 string, c2 int, c3 double"))
    assert rows(given.limit(0, 1)) == [("a", 1, 2.0)]


def test_catalog_and_errors(ctx):
    assert set(FILES) <= set(ctx.tables())
    for text, kind in (("SELECT c1 FROM simple WHERE (", SqlSyntaxError), ("SELECT * FROM nowhere", InvalidOperation), ("DROP TABLE simple", InvalidOperation), ("SELECT c1, SUM(c2) FROM simple", InvalidOperation)):
        with pytest.raises(kind):
            ctx.sql(text).collect()
    with pytest.raises(SourceError):
        ctx.read_csv("/nowhere/at/all.csv")
    with pytest.raises(InvalidOperation):
        ctx.table("simple").filter(col("c1").gt(1))
    with pytest.raises(InvalidOperation):
        ctx.table("simple").filter(col("c2") + 1)
    with pytest.raises(InvalidOperation):
        ctx.table("simple").join(ctx.table("join_right"), "inner", ["zz"], ["r1"])
