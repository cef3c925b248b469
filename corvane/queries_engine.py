"""Queries of the relational engine, with their SQL.

Every query goes through the dialect: the text is parsed, checked and compiled
by the engine; only the choice of output columns is made on the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import Session, row_count
from corvane.sources.files import Files
from corvane.storage import home_dir
from corvane.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    return f"{home_dir(spark)}/warehouse-{uuid.uuid4().hex}"


def session_over(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    session = Session(spark, _folder(spark))
    for t in tables:
        session.register(t, table(spark, sf_dir, t))
    return session


def _add(name: str, tables: str, text: str, columns: str, sql: str) -> None:
    """A query that reads registered tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session_over(spark, sf_dir, *tables.split()).sql(text, qualified=False).select(*columns.split())

    QUERIES[name], SQL[name] = run, sql


def _one(name: str, t: str, where: str, columns: str, sql_where: str | None = None) -> None:
    cols = columns.replace(" ", ", ")
    tail = f" where {sql_where or where.replace('==', '=').replace(chr(34), chr(39))}" if where else ""
    _add(name, t, f"select * from {t}" + (f" where {where};" if where else ";"), columns, f"select {cols} from {t}{tail}")


_one("scan_full", "nation", "", "n_nationkey n_name n_regionkey")
_one("scan_lineitem", "lineitem", "", "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_returnflag")
_one("filter_int_eq", "customer", "c_nationkey == 3", "c_custkey c_name")
_one("filter_int_lt", "customer", "c_nationkey < 5", "c_custkey c_nationkey")
_one("filter_int_lte", "customer", "c_nationkey <= 5", "c_custkey c_nationkey")
_one("filter_int_gt", "part", "p_size > 45", "p_partkey p_size")
_one("filter_int_gte", "part", "p_size >= 45", "p_partkey p_size")
_one("filter_int_ne", "customer", "c_nationkey != 3", "c_custkey c_nationkey")
_one("filter_char_eq", "customer", 'c_mktsegment == "BUILDING"', "c_custkey c_mktsegment")
_one("filter_char_lt", "orders", 'o_orderpriority < "2-HIGH"', "o_orderkey o_orderpriority")
_one("filter_char_lte", "orders", 'o_orderpriority <= "2-HIGH"', "o_orderkey o_orderpriority")
_one("filter_char_gt", "orders", 'o_orderpriority > "4-NOT SPECIFIED"', "o_orderkey o_orderpriority")
_one("filter_char_gte", "orders", 'o_orderpriority >= "4-NOT SPECIFIED"', "o_orderkey o_orderpriority")
_one(
    "filter_literal_first", "customer", "5 > c_nationkey and 2 <= c_nationkey", "c_custkey c_nationkey",
    "c_nationkey < 5 and c_nationkey >= 2",
)
_one(
    "filter_and_two_char", "lineitem", 'l_returnflag == "R" and l_linestatus == "O" and l_quantity > 40',
    "l_orderkey l_linenumber",
)
_one("filter_or", "customer", 'c_nationkey == 3 or c_mktsegment == "BUILDING"', "c_custkey c_nationkey c_mktsegment")
_one("filter_precedence", "customer", 'c_nationkey == 3 or c_mktsegment == "BUILDING" and c_nationkey > 10', "c_custkey")
_one("filter_parens", "customer", '(c_nationkey == 3 or c_mktsegment == "BUILDING") and c_nationkey > 10', "c_custkey")
_one("filter_col_col", "lineitem", "l_partkey == l_suppkey", "l_orderkey l_linenumber l_partkey l_suppkey")
_one("index_point", "orders", "o_orderkey == 42", "o_orderkey o_custkey")
_one("index_range", "orders", "o_orderkey > 100 and o_orderkey <= 200", "o_orderkey o_custkey")


def _join(name: str, tables: str, where: str, columns: str, *, short: bool = False) -> None:
    listed = ", ".join(tables.split())
    text = f"select {listed} where {where}" if short else f"select * from {listed} where {where};"
    sql_where = where.replace("==", "=").replace('"', "'")
    _add(name, tables, text, columns, f"select {', '.join(columns.split())} from {listed} where {sql_where}")


_CO = "customer.c_custkey == orders.o_custkey"
_join("join_two", "customer orders", _CO, "c_custkey c_name o_orderkey o_custkey")
_join("join_short_form", "customer orders", _CO, "c_custkey o_orderkey", short=True)
_join(
    "join_filtered", "customer orders", f'{_CO} and customer.c_mktsegment == "BUILDING" and orders.o_totalprice > 250000',
    "c_custkey c_mktsegment o_orderkey o_totalprice",
)
_join(
    "join_reversed", "customer orders", "orders.o_custkey == customer.c_custkey and c_custkey < 50",
    "c_custkey c_name o_orderkey o_custkey",
)
_join(
    "join_three", "customer orders lineitem",
    f'{_CO} and orders.o_orderkey == lineitem.l_orderkey and c_mktsegment == "BUILDING"',
    "c_custkey o_orderkey l_linenumber l_partkey",
)
_join(
    "join_four_chain", "region nation customer orders",
    f"region.r_regionkey == nation.n_regionkey and nation.n_nationkey == customer.c_nationkey and {_CO} and r_regionkey < 2",
    "r_name n_name c_custkey o_orderkey",
)
_join(
    "join_composite", "supplier customer nation",
    "supplier.s_nationkey == nation.n_nationkey and customer.c_nationkey == nation.n_nationkey and supplier.s_nationkey == customer.c_nationkey",
    "s_suppkey c_custkey n_nationkey",
)
_join(
    "join_cross_table_or", "customer orders", f'{_CO} and (customer.c_nationkey == 1 or orders.o_orderstatus == "P")',
    "c_custkey o_orderkey",
)
_join(
    "join_composite_key", "customer supplier",
    "customer.c_nationkey == supplier.s_nationkey and customer.c_custkey == supplier.s_suppkey",
    "c_custkey s_suppkey c_nationkey s_nationkey",
)
_join(
    "join_composite_mixed", "lineitem part",
    "lineitem.l_partkey == part.p_partkey and lineitem.l_suppkey != part.p_size and part.p_size >= 49",
    "l_orderkey l_linenumber p_partkey p_size",
)
_join("join_theta", "nation region", "nation.n_regionkey < region.r_regionkey", "n_nationkey r_regionkey")


def _query(sql: str):
    """Registers a query written as a function."""

    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@_query("select a.n_nationkey as k1, b.n_nationkey as k2, a.n_name as nm from nation a, nation b where a.n_name = b.n_name")
def join_char_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = session_over(spark, sf_dir, "nation")
    session.register("again", table(spark, sf_dir, "nation"))
    found = session.sql("select * from nation, again where nation.n_name == again.n_name;")
    col = lambda c: F.col(f"`{c}`")
    return found.select(
        col("nation.n_nationkey").alias("k1"), col("again.n_nationkey").alias("k2"), col("nation.n_name").alias("nm")
    )


@_query("select c_custkey, c_acctbal > 5000 as rich from customer where c_acctbal > 5000")
def filter_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark, _folder(spark))
    session.register("flags", table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") > 5000).alias("rich")))
    return session.sql("select * from flags where rich == true;", qualified=False)


@_query("""select c_custkey, cast(floor(c_acctbal) as int) as bal from customer where cast(floor(c_acctbal) as int) < -500""")
def filter_negative_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark, _folder(spark))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.floor("c_acctbal").cast("int").alias("bal"))
    session.register("balances", rows)
    return session.sql("select * from balances where bal < -500;", qualified=False)


@_query("select count(*) as returned from customer where c_nationkey < 5")
def select_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(session_over(spark, sf_dir, "customer").sql("select * from customer where c_nationkey < 5;"))


# Statements that change tables work on stored copies.


def _regions(spark: SparkSession, sf_dir: str) -> Session:
    session = Session(spark, _folder(spark))
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int"), "r_name")
    session.create_from("regions", [("r_regionkey", "int"), ("r_name", "char32")], rows)
    return session


def _customers(spark: SparkSession, sf_dir: str) -> Session:
    session = Session(spark, _folder(spark))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int"), F.col("c_nationkey").cast("int"), "c_mktsegment")
    session.create_from("customers", [("c_custkey", "int"), ("c_nationkey", "int"), ("c_mktsegment", "char16")], rows)
    return session


_CUSTOMERS = "cast(c_custkey as int) as c_custkey"


@_query("select cast(r_regionkey as int) as r_regionkey, r_name from region union all select 100, 'ATLANTIS'")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _regions(spark, sf_dir)
    session.sql('insert into regions (100, "ATLANTIS");')
    return session.table("regions")


@_query("select cast(r_regionkey as int) as r_regionkey, r_name from region")
def insert_pk_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.errors import ConstraintError

    session = _regions(spark, sf_dir)
    try:
        session.sql('insert into regions (1, "ATLANTIS");')
    except ConstraintError:
        return session.table("regions")
    raise AssertionError("a second row got the same key")


@_query("select cast(n_nationkey as int) as n_nationkey, n_name, cast(n_regionkey as int) as n_regionkey from nation")
def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark, _folder(spark))
    path = f"{_folder(spark)}/nation.csv"
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    session.sql("create table nations (n_nationkey=int, n_name=char32, n_regionkey=int);")
    session.sql(f'load "{path}" into nations;')
    return session.table("nations")


# Lookups in stored tables, which are sorted by key.


def _orders(spark: SparkSession, sf_dir: str) -> Session:
    session = Session(spark, _folder(spark))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int"), "o_orderpriority")
    session.create_from("orders", [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderpriority", "char16")], rows)
    return session


_STORED_ORDERS = "cast(o_orderkey as int) as o_orderkey, cast(o_custkey as int) as o_custkey, o_orderpriority"


def _stored(name: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _orders(spark, sf_dir).sql(f"select * from orders where {where};", qualified=False)

    QUERIES[name], SQL[name] = run, f"select {_STORED_ORDERS} from orders where {where.replace('==', '=')}"


_stored("stored_point", "o_orderkey == 42")
_stored("stored_range", "o_orderkey > 100 and 200 >= o_orderkey")


@_query(f"select {_STORED_ORDERS} from orders where o_custkey = 7")
def stored_secondary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _orders(spark, sf_dir)
    session.sql("create index on orders (o_custkey);")
    return session.sql("select * from orders where o_custkey == 7;", qualified=False)


@_query(
    f"""select cast(c_custkey as int) as id, c_acctbal > 5000 as rich, c_name || repeat('x', {255 - 18}) as note from customer
    where c_acctbal > 5000"""
)
def stored_bool_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of up to 255 bytes; one more is refused."""
    from corvane.errors import AnalysisError

    session = Session(spark, _folder(spark))
    note = F.concat("c_name", F.lit("x" * (255 - 18)))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int"), F.col("c_acctbal") > 5000, note)
    session.create_from("flags", [("id", "int"), ("rich", "bool"), ("note", "text")], rows)
    try:
        session.sql(f'insert into flags (-1, true, "{"x" * 256}");')
    except AnalysisError:
        return session.sql("select * from flags where rich == true;", qualified=False)
    raise AssertionError("a text of 256 bytes was taken")


@_query(
    """select * from (values (0, 'users.uid'), (1, 'users.name'), (2, 'orders.oid'), (3, 'orders.uid'), (4, 'orders.total'))
    v(place, name)"""
)
def star_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `*` stand in the order of the tables, whichever side of the comparison they are on."""
    session = Session(spark, _folder(spark))
    session.sql("create table users (uid=int, name=char8);")
    session.sql("create table orders (oid=int, uid=int, total=int);")
    found = session.sql("select * from users, orders where orders.uid == users.uid;")
    return spark.createDataFrame(list(enumerate(found.columns)), "place int, name string")


_REFUSED = {
    "select * from customer, orders;": "PlanError",
    "select * from customer, orders where customer.c_custkey == 1 and orders.o_custkey == 1;": "PlanError",
    "select * from customer, orders, nation where customer.c_custkey == orders.o_custkey;": "PlanError",
    "select * from nosuch;": "AnalysisError",
    "select * from customer, orders where customer.nosuch == orders.o_custkey;": "AnalysisError",
    "select * from customer, orders where customer.c_name == orders.o_custkey;": "AnalysisError",
    "select * from customer where orders.o_custkey == 1;": "AnalysisError",
    'select * from customer where c_nationkey == "abc";': "AnalysisError",
    "select * from customer where c_nationkey;": "ParseError",
    "select from customer;": "ParseError",
}


@_query(
    "select * from (values "
    + ", ".join(f"({i}, '{error}')" for i, error in enumerate(_REFUSED.values()))
    + ') v(statement, "error")'
)
def refused_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross products, unknown names and types that do not fit are refused before anything runs."""
    from corvane.errors import CorvaneError

    session = session_over(spark, sf_dir, "customer", "orders", "nation")
    found = []
    for i, text in enumerate(_REFUSED):
        try:
            session.sql(text)
        except CorvaneError as e:
            found.append((i, type(e).__name__))
    return spark.createDataFrame(found, "statement int, error string")


def _changed(name: str, statement: str, columns: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _customers(spark, sf_dir)
        session.sql(statement)
        return session.table("customers").select(*columns.split())

    QUERIES[name], SQL[name] = run, sql


_changed(
    "update_int", 'update customers set c_nationkey = 0 where c_mktsegment == "BUILDING";',
    "c_custkey c_nationkey c_mktsegment",
    f"select {_CUSTOMERS}, case when c_mktsegment = 'BUILDING' then 0 else c_nationkey end as c_nationkey, c_mktsegment from customer",
)
_changed(
    "update_char", 'update customers set c_mktsegment = "XX" where c_nationkey < 5;', "c_custkey c_mktsegment",
    f"select {_CUSTOMERS}, case when c_nationkey < 5 then 'XX' else c_mktsegment end as c_mktsegment from customer",
)
_changed(
    "update_arithmetic", "update customers set c_nationkey = c_nationkey + 100 where c_nationkey >= 20;",
    "c_custkey c_nationkey",
    f"select {_CUSTOMERS}, case when c_nationkey >= 20 then c_nationkey + 100 else c_nationkey end as c_nationkey from customer",
)
_changed(
    "delete_and", 'delete from customers where c_nationkey > 4 and c_mktsegment == "BUILDING";', "c_custkey c_nationkey",
    f"select {_CUSTOMERS}, c_nationkey from customer where not (c_nationkey > 4 and c_mktsegment = 'BUILDING')",
)
_changed(
    "delete_or", 'delete from customers where c_nationkey > 20 or c_mktsegment == "BUILDING";', "c_custkey c_nationkey",
    f"select {_CUSTOMERS}, c_nationkey from customer where not (c_nationkey > 20 or c_mktsegment = 'BUILDING')",
)


@_query(f"select {_CUSTOMERS}, c_nationkey from customer where c_nationkey = 3")
def create_index_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _customers(spark, sf_dir)
    session.sql("create index on customers (c_nationkey);")
    return session.sql("select * from customers where c_nationkey == 3;", qualified=False).select("c_custkey", "c_nationkey")


@_query(
    """select * from (values ('customers', 'c_custkey', 'int', true), ('customers', 'c_nationkey', 'int', false),
    ('customers', 'c_mktsegment', 'char16', false)) v("table", "column", type, indexed)"""
)
def show_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).sql("show;")


@_query(
    """select * from (values (1, 'Ann Lee', 'CA', 21), (2, 'Bob; Ray', 'TX', 35), (4, 'Di Fox', 'YY', 95))
    v(uid, name, state, age)"""
)
def run_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = f"{_folder(spark)}/store.sql"
    Files(spark).replace(
        script,
        """create table users (uid=int, name=char32, state=char8, age=int);
        create index on users (state);
        insert into users (1, "Ann Lee", "CA", 20); insert into users (2, "Bob; Ray", "TX", 35);
        insert into users (3, "Cy Young", "CA", 81); insert into users (1, "Twice", "CA", 1);
        insert into users (4, "Di Fox", "XX", 95);
        update users set age = 21 where uid == 1;
        update users set state = "YY" where age > 90;
        delete from users where age > 80 and state == "CA"
        """,
    )
    session = Session(spark, _folder(spark))
    session.sql(f'run "{script}";')
    return session.table("users")
