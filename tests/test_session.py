from collections import namedtuple

import pytest
from corvane import storage
from corvane.errors import AnalysisError, ConflictError, ConstraintError, ParseError, PlanError
from corvane.operators import dml
from corvane.render import render
from corvane.session import Session
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

USERS = [(1, "Ann Lee", "CA", 20), (2, "Bob Ray", "TX", 35), (3, "Cy Young", "CA", 81), (4, "Di Fox", "NY", 17), (5, "Ed Poe", "XX", 95)]
FILES = {
    "users": '"uid","name","state","age"\n' + "".join(f'{u},"{n}","{s}",{a}\n' for u, n, s, a in USERS),
    "products": '"pid","name","price","stock"\n1,"Desk",500,3\n2,"Lamp",50,0\n',
    "orders": '"oid","uid","pid","total"\n10,1,1,500\n11,1,2,50\n12,3,1,1500\n13,9,1,700\n',
}
TABLES = {
    "users": "uid=int, name=char32, state=char8, age=int",
    "products": "pid=int, name=char32, price=int, stock=int",
    "orders": "oid=int, uid=int, pid=int, total=int",
}


def filled(spark, folder) -> Session:
    session = Session(spark, f"file://{folder}/wh")
    for name, columns in TABLES.items():
        (folder / f"{name}.csv").write_text(FILES[name])
        session.sql(f"create table {name} ({columns});")
        session.sql(f'load "file://{folder}/{name}.csv" into {name};')
    return session


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Tables that no test changes."""
    return filled(spark, tmp_path_factory.mktemp("shop"))


@pytest.fixture
def own(spark, tmp_path):
    return filled(spark, tmp_path)


def keys(df, *columns):
    return sorted(tuple(r) if len(columns) > 1 else r[0] for r in df.select(*(f"`{c}`" for c in columns)).collect())


@pytest.mark.parametrize(
    ("where", "uids"),
    [
        ("age > 25", [2, 3, 5]), ("25 > age", [1, 4]), ('state == "CA" or age > 90', [1, 3, 5]),
        ('state == "TX" or state == "CA" and age > 50', [2, 3]), ('(state == "TX" or state == "CA") and age > 50', [3]),
        ('state == "CA" and name == "Ann Lee"', [1]), ("uid != 5", [1, 2, 3, 4]), ('uid >= "4"', [4, 5]), ("uid > -1 and uid < 2", [1]),
        ("users.uid == 3", [3]), ("uid == age", []), ('name < "Bob Ray"', [1]),
    ],
)
def test_filters(shop, where, uids):
    assert keys(shop.sql(f"select * from users where {where};"), "users.uid") == uids


PAIRS = [(1, 10), (1, 11), (3, 12)]


@pytest.mark.parametrize(
    "where",
    [
        "users.uid == orders.uid", 'orders.uid == users.uid and state != "zz"', "users.uid < orders.total and users.uid == orders.uid",
        "users.uid == orders.uid and (age > 100 or total > 0)".replace("total", "orders.total"),
    ],
)
def test_joins(shop, where):
    found = shop.sql(f"select * from users, orders where {where};")
    assert keys(found, "users.uid", "orders.oid") == PAIRS
    assert found.columns[:4] == ["users.uid", "users.name", "users.state", "users.age"]


def test_three_tables_in_any_order(shop):
    text = "select * from users, products, orders where users.uid == orders.uid and orders.pid == products.pid;"
    assert keys(shop.sql(text), "users.uid", "orders.oid", "products.pid") == [(1, 10, 1), (1, 11, 2), (3, 12, 1)]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("select * from users, orders;", PlanError), ("select * from users, orders where users.uid == 1;", PlanError),
        ("select * from nosuch;", AnalysisError), ("select * from users where nosuch == 1;", AnalysisError),
        ("select * from users where age;", ParseError), ('select * from users where age == "abc";', AnalysisError),
        ("select * from users where orders.uid == 1;", AnalysisError), ("select * from users where UID == 1;", AnalysisError),
        ("select * from users, users where users.uid == users.uid;", AnalysisError), ("select * from users where 1 == 1;", AnalysisError),
        ("select * from users where uid > 3000000000;", AnalysisError), ("select * from users where uid == name;", AnalysisError),
        ('select * from users, orders where total > 1 and users.uid == orders.uid;', AnalysisError),
        ('insert into users (6, "Fay", "CALIFORNIA", 30);', AnalysisError), ('insert into users (6, "", "CA", 30);', AnalysisError),
        ('insert into users (6, "Fay", "CA");', AnalysisError), ('insert into users (6, "Fay", "CA", 3000000000);', AnalysisError),
        ('insert into users (1, "Dup", "CA", 30);', ConstraintError), ("update users set uid = 1 where uid == 2;", ConstraintError),
        ('update users set age = "x" where uid == 2;', AnalysisError), ("update users set age = 1, age = 2 where uid == 2;", AnalysisError),
        ("create table users (uid=int);", AnalysisError), ("create table x (uid=int);", AnalysisError),
        ("create table tt (uid=text);", AnalysisError), ("create table tt (uid=int, uid=int);", AnalysisError),
        ("create table tt (a_very_long_column_name=int);", AnalysisError), ("create index on users (nosuch);", AnalysisError),
        ('load "/no/such.csv" into users;', AnalysisError), ('run "/no/such.sql";', AnalysisError),
    ],
)
def test_errors_change_nothing(shop, text, error):
    with pytest.raises(error):
        shop.sql(text)
    assert keys(shop.sql("select * from users;"), "users.uid") == [1, 2, 3, 4, 5]


def test_updates(own):
    assert own.sql("update users set age = 18 where age < 18;").message == "Updated 1 records."
    assert own.sql('update users set state = "YY" where age > 90;').count == 1
    assert own.sql("update users set age = age * 2, name = \"Z\" where uid == 1 or uid == 2;").count == 2
    assert own.sql("update users set age = 1 where uid == 77;").count == 0
    assert own.sql("update users set uid = uid + 10 where uid > 0;").count == 5
    assert keys(own.table("users"), "uid", "name", "state", "age") == [
        (11, "Z", "CA", 40), (12, "Z", "TX", 70), (13, "Cy Young", "CA", 81), (14, "Di Fox", "NY", 18), (15, "Ed Poe", "YY", 95),
    ]


def test_deletes(own):
    assert own.sql('delete from users where uid > 1 and state == "CA";').message == "Deleted 1 records."
    assert own.sql('delete from users where uid == 1 or state == "NY";').count == 2
    assert keys(own.table("users"), "uid") == [2, 5]
    assert own.sql("delete from users where uid > 0;").count == 2
    assert keys(own.table("users"), "uid") == []
    assert own.sql("delete from users where uid > 0;").count == 0
    own.sql('insert into users (-6, "Fay", "CA", 30);')
    assert keys(own.sql("select * from users where uid < 0;"), "users.uid") == [-6]


def test_tables_outlive_the_session(spark, own, tmp_path):
    own.sql("create index on users (state);")
    again = Session(spark, f"file://{tmp_path}/wh")
    assert keys(again.table("users"), "uid") == [1, 2, 3, 4, 5]
    assert again.catalog.table("users").indexed == {"uid", "state"}
    assert "There is an index" in again.sql("create index on users (state);").message


def test_only_files_with_matches_are_rewritten(own):
    own.sql('insert into users (6, "Fay", "CA", 30);')
    before = set(own.catalog.table("users").files)
    own.sql("delete from users where uid == 6;")
    after = set(own.catalog.table("users").files)
    assert len(before & after) == len(before) - 1


def test_load_edges(own, tmp_path):
    long8, long9 = "ÄÄÄÄ", "ÄÄÄÄx"
    (tmp_path / "edge.csv").write_text(
        'uid,name,state,age\n 20 ,  "Quoted" , CA, 1\n\n20,"Second","CA",2\n12abc,"Bad","CA",3\n21,"Few","CA"\n'
        f'22,"Many","CA",4,5\n23,"Smith, J","CA",-6\n24,"Eight","{long8}",7\n25,"Nine","{long9}",8\n1,"Taken","CA",9\n'
    )
    done = own.sql(f'load "file://{tmp_path}/edge.csv" into users;')
    assert done.message == "Successfully loaded 3 rows into table users"
    rows = own.sql("select * from users where uid >= 20;")
    assert keys(rows, "users.uid", "users.name", "users.age") == [(20, "Quoted", 1), (23, "Smith, J", -6), (24, "Eight", 7)]
    assert len(done.rejects.collect()) == 4


def test_booleans_and_texts(own):
    own.sql("create table flags (id=int, ok=bool, note=text);")
    own.sql('insert into flags (1, true, "a");')
    own.sql(f'insert into flags (2, false, "{"x" * 255}");')
    with pytest.raises(AnalysisError):
        own.sql(f'insert into flags (3, false, "{"x" * 256}");')
    assert keys(own.sql("select * from flags where ok == true;"), "flags.id") == [1]
    with pytest.raises(AnalysisError):
        own.sql("select * from flags where ok > false;")
    with pytest.raises(AnalysisError):
        own.sql("create index on flags (note);")


def test_scripts_go_on_after_an_error(own, tmp_path):
    (tmp_path / "s.sql").write_text(
        'insert into users (7, "A;B", "CA", 1); insert into users (7, "C", "CA", 2); nonsense; delete from users where uid < 6'
    )
    results = own.sql(f'run "file://{tmp_path}/s.sql";')
    assert [bool(r.error) for r in results] == [False, True, True, False]
    assert results[1].message == "Insertion Error key: 7 is already in the index tree"
    assert keys(own.table("users"), "uid", "name") == [(7, "A;B")]


def test_console_output(shop):
    text = render(shop.sql("select * from users where uid < 3;"))
    assert "| users.uid | users.name" in text and text.endswith("Returned 2 records.")
    assert "users.uid int [indexed]\nusers.name char32 [no-index]" in render(shop.sql("show;"))
    assert "No tables." == render(shop.sql("show;").limit(0))


def test_rows_that_are_not_shown_are_counted(spark):
    assert render(spark.range(5), shown=3).endswith("\n2 more records are not shown.\nReturned 5 records.")
    assert "not shown" not in render(spark.range(5), shown=5) and "not shown" not in render(spark.range(5))


def test_plans_push_filters_and_columns(shop, spark):
    spark.range(1000).selectExpr("id as k", "id % 7 as m", "id as wide").write.mode("overwrite").parquet(shop.catalog.warehouse + "/outside")
    shop.register("outside", spark.read.parquet(shop.catalog.warehouse + "/outside"))
    plan = shop.sql("select * from outside where k == 5;").select("`outside.k`")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,5)]" in plan and "ReadSchema: struct<k:bigint>" in plan


def bloom_columns(spark, files):
    """Columns with a Bloom filter in every one of the files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for f in files:
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        chunks = [c for b in reader.getFooter().getBlocks() for c in b.getColumns()]
        found.append({c.getPath().toDotString() for c in chunks if c.getBloomFilterOffset() > 0})
        reader.close()
    return set.intersection(*found)


def numbers(spark, tmp_path, parts=6):
    """A stored table of 6,000 keys in several files."""
    session = Session(spark, f"file://{tmp_path}/numbers")
    rows = spark.range(6000).selectExpr("cast(id as int) k", "concat('name', id) n", "cast(id % 10 as int) m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        session.create_from("numbers", [("k", "int"), ("n", "char16"), ("m", "int")], rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return session


def test_key_lookups_open_only_files_that_can_hold_the_key(spark, tmp_path):
    session = numbers(spark, tmp_path)
    assert len(session.catalog.table("numbers").files) >= 4
    opened = lambda where: len(session.sql(f"select * from numbers where {where};").inputFiles())
    assert opened("k == 17") == 1 and opened("5999 == k") == 1 and opened("k == 6000") == 0
    assert opened("k > 10 and k < 20") == 1 and opened("k >= 0") == len(session.catalog.table("numbers").files)
    assert opened("k == 17 or m == 1") == len(session.catalog.table("numbers").files)
    assert keys(session.sql("select * from numbers where k >= 1995 and 2005 > k and m == 0;"), "numbers.k") == [2000]
    plan = session.sql("select * from numbers where k == 17;")._jdf.queryExecution().toString()
    assert "EqualTo(k,17)" in plan.split("PushedFilters")[1]
    assert session.sql("update numbers set m = 77 where k == 17;").count == 1
    assert keys(session.sql("select * from numbers where m == 77;"), "numbers.k") == [17]
    assert session.sql("delete from numbers where k > 100 and k <= 5000;").count == 4900
    assert session.table("numbers").count() == 1100


def test_an_index_takes_in_the_rows_there_are(spark, tmp_path):
    session = numbers(spark, tmp_path)
    before = set(session.catalog.table("numbers").files)
    assert bloom_columns(spark, before) == set()
    session.sql("create index on numbers (n);")
    after = set(session.catalog.table("numbers").files)
    assert bloom_columns(spark, after) == {"n"} and not before & after
    session.sql('insert into numbers (-1, "x", 3);')
    assert keys(session.sql('select * from numbers where n == "name42";'), "numbers.k") == [42] and session.table("numbers").count() == 6001


def test_small_files_are_put_together(own):
    for i in range(40):
        own.sql(f'insert into users ({100 + i}, "N{i}", "CA", {i});')
    assert len(own.catalog.table("users").files) <= 17
    assert own.table("users").count() == 45 and own.sql("select * from users where uid == 117;").count() == 1


def test_a_change_by_another_session_is_not_lost(spark, own, tmp_path):
    other = Session(spark, f"file://{tmp_path}/wh")
    stale = other.catalog.table("users")
    own.sql('insert into users (6, "Fay", "CA", 30);')
    with pytest.raises(ConflictError):
        dml.insert(other.catalog, stale, [(7, "Gus", "CA", 1)])
    assert keys(other.table("users"), "uid") == [1, 2, 3, 4, 5, 6]
    other.sql('insert into users (7, "Gus", "CA", 1);')
    assert keys(own.table("users"), "uid") == [1, 2, 3, 4, 5, 6, 7]


def test_written_tables_are_freed(spark):
    def there(table):
        path = spark._jvm.org.apache.hadoop.fs.Path(storage._written[table])
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    a = storage.materialise(spark.range(5), "a")
    assert there(a) and a.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(storage._written[a])
    storage.free(a)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    with storage.scratch():
        b = storage.materialise(spark.range(3), "b")
        assert there(b)
    assert not there(b)


Row = namedtuple("Row", "uid state age")
ROWS = [Row(i, "CA" if i % 3 else "NY", (i * 37) % 50) for i in range(1, 40)]


def _expression(draw, depth):
    if depth == 0 or draw(st.booleans()):
        if draw(st.booleans()):
            op, n = draw(st.sampled_from(["==", "!=", "<", ">", "<=", ">="])), draw(st.integers(-5, 55))
            left, right = draw(st.sampled_from([("age", n), (n, "age"), ("uid", "age"), ("uid", n)]))
            return f"{left} {op} {right}"
        return f'state {draw(st.sampled_from(["==", "!=", "<"]))} "{draw(st.sampled_from(["CA", "NY", "M"]))}"'
    joined = f" {draw(st.sampled_from(['and', 'or']))} ".join(_expression(draw, depth - 1) for _ in range(2))
    return f"({joined})" if draw(st.booleans()) else joined


@st.composite
def expressions(draw):
    return _expression(draw, 3)


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    session = Session(spark, f"file://{tmp_path_factory.mktemp('people')}/wh")
    session.register("people", spark.createDataFrame([tuple(r) for r in ROWS], "uid int, state string, age int"))
    return session


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(expressions())
def test_random_expressions(people, where):
    wanted = [r.uid for r in ROWS if eval(where, {}, r._asdict())]
    assert keys(people.sql(f"select * from people where {where};"), "people.uid") == wanted


