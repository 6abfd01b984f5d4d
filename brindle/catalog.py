"""The query catalogue: each entry has a fluent (or SQL) form and the SQL an
independent engine runs on the same tables. Money is summed as DECIMAL, so
results don't depend on the order of addition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import Expression, avg, binary, col, count, lit, max_, min_, sort, sum_
from brindle.operators.frame import Frame
from brindle.session import SessionContext
from brindle.sources import CsvReadOptions, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def fluent(name: str, sql: str | None):
    """Register a function of table-opener -> Frame."""

    def put(build):
        QUERIES[name] = lambda spark, folder: build(lambda t: Frame(table(spark, folder, t))).df
        if sql is not None:
            ORACLE[name] = sql
        return build

    return put


def front_door(name: str, text: str, sql: str | None = None, tables: tuple[str, ...] = ()):
    """Register a query that goes through ``SessionContext.sql``."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ctx = SessionContext(spark)
        for t in tables:
            ctx.register_parquet(t, f"{folder}/{t}.parquet")
        return ctx.sql(text).df

    QUERIES[name] = run
    ORACLE[name] = sql or text


def money(e: Expression) -> Expression:
    """An exact decimal of a two-digit double."""
    return e.cast("decimal(18,2)")


def double(e: Expression) -> Expression:
    return e.cast("double")


D = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
L = "l_orderkey, l_partkey, l_linenumber"
LINE = [col("l_orderkey"), col("l_partkey"), col("l_linenumber")]


@fluent("scan_all", "SELECT * FROM nation")
def _(t):
    return t("nation")


@fluent("scan_pruned", f"SELECT {L} FROM lineitem")
def _(t):
    return t("lineitem").select(*LINE)


@fluent("project_reorder", "SELECT o_totalprice, o_orderkey, o_custkey FROM orders")
def _(t):
    return t("orders").select(col("o_totalprice"), col("o_orderkey"), col("o_custkey"))


@fluent("project_computed", "SELECT l_orderkey, l_linenumber * 2 + 1 AS twice, l_orderkey - l_partkey AS gap FROM lineitem")
def _(t):
    return t("lineitem").select(col("l_orderkey"), (col("l_linenumber") * 2 + 1).alias("twice"), (col("l_orderkey") - col("l_partkey")).alias("gap"))


@fluent("project_literals", "SELECT n_nationkey, 7 AS seven, 'x' AS letter FROM nation")
def _(t):
    return t("nation").select(col("n_nationkey"), lit(7).alias("seven"), lit("x").alias("letter"))


@fluent("int_division", "SELECT l_orderkey, CAST(l_orderkey // 7 AS BIGINT) AS part FROM lineitem")
def _(t):
    return t("lineitem").select(col("l_orderkey"), binary(col("l_orderkey"), "/", 7).alias("part"))


@fluent("double_division", "SELECT l_orderkey, l_linenumber, l_quantity / 2.0 AS half FROM lineitem")
def _(t):
    return t("lineitem").select(col("l_orderkey"), col("l_linenumber"), (col("l_quantity") / lit(2.0)).alias("half"))


def _compare(name: str, sign: str, make):
    fluent(f"filter_{name}", f"SELECT {L} FROM lineitem WHERE l_linenumber {sign} 3")(lambda t: t("lineitem").filter(make(col("l_linenumber"), lit(3))).select(*LINE))


for _name, _sign, _make in (
    ("eq", "=", lambda a, b: a.eq(b)),
    ("neq", "<>", lambda a, b: a.neq(b)),
    ("lt", "<", lambda a, b: a.lt(b)),
    ("lteq", "<=", lambda a, b: a.lt_eq(b)),
    ("gt", ">", lambda a, b: a.gt(b)),
    ("gteq", ">=", lambda a, b: a.gt_eq(b)),
):
    _compare(_name, _sign, _make)


@fluent("filter_and_or", f"SELECT {L} FROM lineitem WHERE (l_linenumber > 2 AND l_orderkey < 5000) OR l_returnflag = 'R'")
def _(t):
    return t("lineitem").filter(col("l_linenumber").gt(2).and_(col("l_orderkey").lt(5000)).or_(col("l_returnflag").eq("R"))).select(*LINE)


@fluent("filter_string", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    return t("customer").filter(col("c_mktsegment").eq("BUILDING")).select(col("c_custkey"), col("c_name"))


@fluent("filter_arith", f"SELECT {L} FROM lineitem WHERE l_linenumber + 1 > 5")
def _(t):
    return t("lineitem").filter((col("l_linenumber") + 1).gt(5)).select(*LINE)


@fluent("filter_col_col", f"SELECT {L} FROM lineitem WHERE l_orderkey > l_partkey")
def _(t):
    return t("lineitem").filter(col("l_orderkey").gt(col("l_partkey"))).select(*LINE)


@fluent("filter_mixed_width", f"SELECT {L} FROM lineitem WHERE l_linenumber < l_suppkey")
def _(t):
    return t("lineitem").filter(col("l_linenumber").lt(col("l_suppkey"))).select(*LINE)


@fluent("filter_null_3vl", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber > 5 OR o_orderkey < 500")
def _(t):
    return t("orders").join(t("lineitem"), "left", ["o_orderkey"], ["l_orderkey"]).filter(col("l_linenumber").gt(5).or_(col("o_orderkey").lt(500))).select(col("o_orderkey"), col("l_linenumber"))


@fluent("filter_nested_merge", f"SELECT {L} FROM lineitem WHERE l_linenumber > 2 AND l_quantity < 20")
def _(t):
    return t("lineitem").filter(col("l_linenumber").gt(2)).filter(col("l_quantity").lt(lit(20.0))).select(*LINE)


@fluent("filter_keep_columns", "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t):
    return t("orders").filter(col("o_orderpriority").eq("1-URGENT"))


@fluent("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return t("orders").order_by(sort(col("o_totalprice"), False), sort(col("o_orderkey"))).limit(0, 10).select(col("o_orderkey"), col("o_totalprice"))


@fluent("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def _(t):
    return t("orders").order_by(sort(col("o_orderkey"))).limit(5, 10).select(col("o_orderkey"), col("o_totalprice"))


@fluent("offset_only", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def _(t):
    return t("customer").select(col("c_custkey")).order_by(col("c_custkey")).limit(100)


@fluent("limit_then_filter", "SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_custkey > 500")
def _(t):
    return t("orders").select(col("o_orderkey"), col("o_custkey")).order_by(col("o_orderkey")).limit(0, 100).filter(col("o_custkey").gt(500))


@fluent("sort_multi", "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey DESC")
def _(t):
    return t("supplier").order_by(sort(col("s_nationkey")), sort(col("s_suppkey"), False)).select(col("s_suppkey"), col("s_nationkey"))


@fluent("sort_nulls_first_topk", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey ORDER BY l_linenumber DESC NULLS FIRST, o_orderkey LIMIT 50")
def _(t):
    return t("orders").join(t("lineitem"), "left", ["o_orderkey"], ["l_orderkey"]).order_by(sort(col("l_linenumber"), False), col("o_orderkey")).limit(0, 50).select(col("o_orderkey"), col("l_linenumber"))


@fluent("distinct_one", "SELECT DISTINCT l_returnflag FROM lineitem")
def _(t):
    return t("lineitem").select(col("l_returnflag")).distinct()


@fluent("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t):
    return t("lineitem").select(col("l_returnflag"), col("l_linestatus"), col("l_linenumber")).distinct()


@fluent("distinct_twice", "SELECT DISTINCT o_orderstatus FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def _(t):
    return t("orders").select(col("o_orderstatus"), col("o_orderpriority")).distinct().select(col("o_orderstatus")).distinct()


@fluent("group_no_aggs", "SELECT l_linenumber, l_returnflag FROM lineitem GROUP BY l_linenumber, l_returnflag")
def _(t):
    return t("lineitem").aggregate([col("l_linenumber"), col("l_returnflag")], [])


def five(column: str) -> list[Expression]:
    c = col(column)
    return [count(c).alias("n"), sum_(c).alias("total"), avg(c).alias("mean"), min_(c).alias("least"), max_(c).alias("most")]


FIVE = "COUNT({0}) AS n, CAST(SUM({0}) AS BIGINT) AS total, AVG({0}) AS mean, MIN({0}) AS least, MAX({0}) AS most"


@fluent("agg_global", f"SELECT {FIVE.format('l_linenumber')} FROM lineitem")
def _(t):
    return t("lineitem").aggregate([], five("l_linenumber"))


@fluent("agg_global_empty", f"SELECT {FIVE.format('l_linenumber')} FROM lineitem WHERE l_linenumber < 0")
def _(t):
    return t("lineitem").filter(col("l_linenumber").lt(0)).aggregate([], five("l_linenumber"))


@fluent("agg_grouped", f"SELECT l_returnflag, {FIVE.format('l_linenumber')}, {D.format('l_quantity')} AS quantity FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t("lineitem").aggregate([col("l_returnflag")], [*five("l_linenumber"), double(sum_(money(col("l_quantity")))).alias("quantity")])


@fluent("agg_composite_key", f"SELECT l_returnflag, l_linestatus, {FIVE.format('l_linenumber')} FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(t):
    return t("lineitem").aggregate([col("l_returnflag"), col("l_linestatus")], five("l_linenumber"))


@fluent("agg_key_not_first", f"SELECT o_orderpriority, {FIVE.format('o_custkey')} FROM orders GROUP BY o_orderpriority")
def _(t):
    return t("orders").aggregate([col("o_orderpriority")], five("o_custkey"))


@fluent("agg_empty_grouped", f"SELECT o_orderpriority, {FIVE.format('o_custkey')} FROM orders WHERE o_orderkey < 0 GROUP BY o_orderpriority")
def _(t):
    return t("orders").filter(col("o_orderkey").lt(0)).aggregate([col("o_orderpriority")], five("o_custkey"))


def orders_lines(t) -> Frame:
    return t("orders").join(t("lineitem"), "left", ["o_orderkey"], ["l_orderkey"])


ORDERS_LINES = "orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"


@fluent("agg_null_key", f"SELECT l_returnflag, {FIVE.format('o_custkey')} FROM {ORDERS_LINES} GROUP BY l_returnflag")
def _(t):
    return orders_lines(t).aggregate([col("l_returnflag")], five("o_custkey"))


@fluent("agg_all_null_group", f"SELECT o_orderkey, {FIVE.format('l_linenumber')} FROM {ORDERS_LINES} GROUP BY o_orderkey")
def _(t):
    return orders_lines(t).aggregate([col("o_orderkey")], five("l_linenumber"))


@fluent("agg_negative", f"SELECT MIN(c_acctbal) AS least, MAX(c_acctbal) AS most, {D.format('c_acctbal')} AS total, COUNT(c_acctbal) AS n FROM customer WHERE c_acctbal < 0")
def _(t):
    c = col("c_acctbal")
    return t("customer").filter(c.lt(lit(0.0))).aggregate([], [min_(c).alias("least"), max_(c).alias("most"), double(sum_(money(c))).alias("total"), count(c).alias("n")])


@fluent("agg_expr_arg", "SELECT l_returnflag, CAST(SUM(l_orderkey + l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t("lineitem").aggregate([col("l_returnflag")], [sum_(col("l_orderkey") + col("l_partkey")).alias("total")])


@fluent("count_nonnull", f"SELECT COUNT(l_orderkey) AS lines, COUNT(o_orderkey) AS orders FROM {ORDERS_LINES}")
def _(t):
    return orders_lines(t).aggregate([], [count(col("l_orderkey")).alias("lines"), count(col("o_orderkey")).alias("orders")])


@fluent("having_agg", "SELECT o_custkey, COUNT(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING COUNT(o_orderkey) > 12")
def _(t):
    return t("orders").aggregate([col("o_custkey")], [count(col("o_orderkey")).alias("n")]).filter(col("n").gt(12))


@fluent("having_key", "SELECT o_custkey, COUNT(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING o_custkey < 100")
def _(t):
    return t("orders").aggregate([col("o_custkey")], [count(col("o_orderkey")).alias("n")]).filter(col("o_custkey").lt(100))


@fluent("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t("orders").join(t("customer"), "inner", ["o_custkey"], ["c_custkey"]).select(col("o_orderkey"), col("c_name"))


@fluent("join_inner_multi_key", "SELECT COUNT(a.l_partkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def _(t):
    keys = ["l_orderkey", "l_linenumber"]
    return t("lineitem").alias("a").join(t("lineitem").alias("b"), "inner", keys, keys).aggregate([], [count(col("a.l_partkey")).alias("n")])


@fluent("join_left", f"SELECT o_orderkey, l_linenumber, l_partkey FROM {ORDERS_LINES}")
def _(t):
    return orders_lines(t).select(col("o_orderkey"), col("l_linenumber"), col("l_partkey"))


@fluent("join_inner_residual", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_partkey > o_custkey")
def _(t):
    return t("orders").join(t("lineitem"), "inner", ["o_orderkey"], ["l_orderkey"], col("l_partkey").gt(col("o_custkey"))).select(col("o_orderkey"), col("l_linenumber"), col("l_partkey"))


@fluent("join_left_residual", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_partkey > o_custkey")
def _(t):
    return t("orders").join(t("lineitem"), "left", ["o_orderkey"], ["l_orderkey"], col("l_partkey").gt(col("o_custkey"))).select(col("o_orderkey"), col("l_linenumber"), col("l_partkey"))


@fluent("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t):
    return t("region").join(t("nation")).select(col("r_name"), col("n_name"))


@fluent("join_theta_inner", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
def _(t):
    return t("nation").join(t("region"), "inner", filter=col("n_regionkey").lt(col("r_regionkey"))).select(col("n_nationkey"), col("r_regionkey"))


@fluent("join_theta_left", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey < r_regionkey")
def _(t):
    return t("nation").join(t("region"), "left", filter=col("n_regionkey").lt(col("r_regionkey"))).select(col("n_nationkey"), col("r_regionkey"))


@fluent("join_left_no_condition", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON TRUE")
def _(t):
    return t("nation").join(t("region"), "left").select(col("n_nationkey"), col("r_regionkey"))


@fluent("join_dup_names", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a LEFT JOIN nation b ON a.n_nationkey = b.n_regionkey")
def _(t):
    return t("nation").alias("a").join(t("nation").alias("b"), "left", ["n_nationkey"], ["n_regionkey"]).select(col("a.n_name").alias("left_name"), col("b.n_name").alias("right_name"))


@fluent("join_chain", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t("customer").join(t("nation"), "inner", ["c_nationkey"], ["n_nationkey"]).join(t("region"), "inner", ["n_regionkey"], ["r_regionkey"]).select(col("c_custkey"), col("n_name"), col("r_name"))


@fluent("join_key_widening", "SELECT c_custkey, n_name FROM customer JOIN (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation) ON c_nationkey = k")
def _(t):
    wide = t("nation").select(col("n_nationkey").cast("bigint").alias("k"), col("n_name"))
    return t("customer").join(wide, "inner", ["c_nationkey"], ["k"]).select(col("c_custkey"), col("n_name"))


@fluent("join_where_pushdown", f"SELECT o_orderkey, l_linenumber FROM {ORDERS_LINES} WHERE o_custkey < 200")
def _(t):
    return orders_lines(t).filter(col("o_custkey").lt(200)).select(col("o_orderkey"), col("l_linenumber"))


@fluent("join_or_extract", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE (o_custkey < 100 AND l_linenumber = 1) OR (o_custkey > 1400 AND l_linenumber = 2)")
def _(t):
    pick = col("o_custkey").lt(100).and_(col("l_linenumber").eq(1)).or_(col("o_custkey").gt(1400).and_(col("l_linenumber").eq(2)))
    return t("orders").join(t("lineitem"), "inner", ["o_orderkey"], ["l_orderkey"]).filter(pick).select(col("o_orderkey"), col("l_linenumber"))


@fluent("discounted_revenue", "SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS saved FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t("lineitem").aggregate([col("l_returnflag")], [double(sum_(money(col("l_extendedprice")) * money(col("l_discount")))).alias("saved")])


FLAGSHIP = f"""SELECT c_mktsegment, COUNT(o_orderkey) AS n_orders, {D.format("o_totalprice")} AS revenue
FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY c_mktsegment ORDER BY revenue DESC"""
front_door("join_agg_sort", FLAGSHIP, tables=("customer", "orders"))
front_door("sql_select_star", "SELECT * FROM region", tables=("region",))
front_door("sql_where", "SELECT o_orderkey FROM orders WHERE o_custkey <= 300 AND o_orderstatus = 'F' OR o_custkey = 700", tables=("orders",))
front_door("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", tables=("lineitem",))
front_door("sql_group_order", 'SELECT o_orderpriority, COUNT(o_orderkey) AS n, MIN(o_totalprice) AS least FROM orders GROUP BY o_orderpriority ORDER BY "n" DESC', tables=("orders",))
front_door("sql_quoted", 'SELECT "c_custkey", "c_name" FROM customer WHERE "c_nationkey" = 3', tables=("customer",))
front_door("sql_join_left", f"SELECT o_orderkey, l_linenumber FROM {ORDERS_LINES}", tables=("orders", "lineitem"))
front_door("sql_join_chain", "SELECT s_name, n_name, r_name FROM supplier INNER JOIN nation ON s_nationkey = n_nationkey LEFT OUTER JOIN region ON n_regionkey = r_regionkey", tables=("supplier", "nation", "region"))
front_door("sql_aliases", "SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey AND b.r_regionkey > 1", tables=("nation", "region"))
front_door("sql_literals", "SELECT n_nationkey, NULL IS NULL AS nil, TRUE AS yes, 'it' AS word, CAST(2.5 AS DOUBLE) AS half, CAST(9000000000 AS BIGINT) AS big FROM nation", tables=("nation",))
front_door("sql_having_offset", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5 ORDER BY o_custkey LIMIT 20 OFFSET 10", tables=("orders",))
front_door("sql_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag", tables=("lineitem",))
front_door("sql_order_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", tables=("orders",))
front_door("sql_aggregate_name", 'SELECT c_nationkey, SUM(c_custkey) FROM customer GROUP BY c_nationkey ORDER BY "SUM(c_custkey)" DESC', 'SELECT c_nationkey, CAST(SUM(c_custkey) AS BIGINT) AS "SUM(c_custkey)" FROM customer GROUP BY c_nationkey', tables=("customer",))

front_door("sql_null_order", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49 ORDER BY l_linenumber DESC, o_orderkey LIMIT 40", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49 ORDER BY l_linenumber DESC NULLS FIRST, o_orderkey LIMIT 40", tables=("orders", "lineitem"))
front_door("sql_null_order_said", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49 ORDER BY l_linenumber DESC NULLS LAST, o_orderkey, l_partkey LIMIT 40", tables=("orders", "lineitem"))
front_door("sql_division", "SELECT n_nationkey, n_nationkey / 2 AS half, n_nationkey / 2.0D AS half_too FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / 2 AS half, CAST(n_nationkey AS DOUBLE) / 2 AS half_too FROM nation", tables=("nation",))
front_door("sql_whole_division", "SELECT o_orderkey, o_custkey DIV 7 AS seventh FROM orders", "SELECT o_orderkey, o_custkey // 7 AS seventh FROM orders", tables=("orders",))
front_door("sql_wide_literals", "SELECT n_nationkey, CAST(18446744073709551615 AS DECIMAL(20,0)) AS u64, CAST(127 AS TINYINT) AS i8, -9223372036854775808 AS i64 FROM nation", "SELECT n_nationkey, CAST(18446744073709551615 AS DECIMAL(20,0)) AS u64, CAST(127 AS TINYINT) AS i8, CAST(-9223372036854775808 AS BIGINT) AS i64 FROM nation", tables=("nation",))
front_door("sql_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", tables=("nation", "region"))
front_door("sql_except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem", tables=("orders", "lineitem"))
front_door("sql_comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", tables=("nation", "region"))
front_door("sql_with", "WITH busy AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c_name, n FROM customer JOIN busy ON c_custkey = o_custkey WHERE n > 12", tables=("customer", "orders"))


@fluent("literal_widths", "SELECT n_nationkey, CAST(7 AS TINYINT) AS a, CAST(7 AS INTEGER) AS b, CAST(7 AS DECIMAL(20,0)) AS c, CAST(1.5 AS DOUBLE) AS d FROM nation")
def _(t):
    return t("nation").select(col("n_nationkey"), lit(7, "i8").alias("a"), lit(7, "u16").alias("b"), lit(7, "u64").alias("c"), lit(1.5, "f64").alias("d"))


def csv_of(texts: str, options: CsvReadOptions):
    """A query that writes lines made by SQL into the shared folder and reads them as CSV."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        import uuid

        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        path = f"{base}/csv-{uuid.uuid4().hex}"
        table(spark, folder, "customer").selectExpr(f"{texts} AS value").write.text(path)
        return SessionContext(spark).read_csv(path, options).df

    return run


# names in quotes, with doubled quotes, the delimiter and a line break in them
QUERIES["csv_quoted"] = csv_of("""concat(c_custkey, ',"', c_name, ', "", says ""', c_custkey, '""', chr(10), 'twice"')""", CsvReadOptions().with_has_header(False))
ORACLE["csv_quoted"] = """SELECT c_custkey AS "_c0", c_name || ', ", says "' || c_custkey || '"' || chr(10) || 'twice' AS "_c1" FROM customer"""
# an empty field every seventh row, and fractions
QUERIES["csv_no_header"] = csv_of("concat(c_custkey, '|', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END, '|', c_nationkey / 2.0D)", CsvReadOptions().with_has_header(False).with_delimiter("|"))
ORACLE["csv_no_header"] = """SELECT c_custkey AS "_c0", CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS "_c1", CAST(c_nationkey AS DOUBLE) / 2 AS "_c2" FROM customer"""


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Nations written as CSV with odd options into the shared folder, read back."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base}/csv-{uuid.uuid4().hex}"
    table(spark, folder, "nation").write.option("header", True).option("sep", ";").option("quote", "'").csv(path)
    ctx = SessionContext(spark)
    ctx.register_csv("nation_csv", path, CsvReadOptions().with_delimiter(";").with_quote("'"))
    return ctx.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation_csv").df


QUERIES["csv_roundtrip"] = csv_roundtrip
ORACLE["csv_roundtrip"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    ctx = SessionContext(spark)
    ctx.register_parquet("region", f"{folder}/region.parquet")
    return spark.createDataFrame([(t,) for t in ctx.tables() if t == "region"], "name string").select(F.col("name"))


QUERIES["catalog_tables"] = catalog_tables
ORACLE["catalog_tables"] = "SELECT 'region' AS name"
