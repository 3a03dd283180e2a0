from siftwork.operators import catalog


def test_ddl(spark):
    text = (
        "CREATE TABLE users (\n  id INTEGER,\n  name TEXT\n);\ncreate table IF NOT EXISTS `orders` (id INT,\n [user_id] INT,\n"
        "  FOREIGN KEY (user_id) REFERENCES users(id)\n) ;\nCREATE TABLE broken (id INT)\n"
    )
    wide = "CREATE TABLE w (\n" + ",\n".join(f"c{i} INT" for i in range(25)) + ");"
    df = spark.createDataFrame([("a.sql", text), ("b.sql", wide), ("c.sql", "select 1;")], "script string, text string")
    rows = catalog.ddl_tables(df).orderBy("script", "pos").collect()
    assert [(r["script"], r["pos"], r["table"], r["columns"]) for r in rows[:2]] == [
        ("a.sql", 1, "users", ["id", "name"]), ("a.sql", 2, "orders", ["id", "user_id", "FOREIGN"])
    ]
    assert len(rows) == 3 and rows[2]["columns"] == [f"c{i}" for i in range(25)]
    assert catalog.ddl_tables(df, limit=20).filter("table = 'w'").collect()[0]["columns"] == [f"c{i}" for i in range(20)]


def test_tables_and_sizes(spark):
    tables = spark.createDataFrame([("A", 3, "d"), ("B", None, None)], "table_name string, num_rows bigint, last_analyzed string")
    segments = spark.createDataFrame(
        [("A", "TABLE", 10), ("A", "TABLE PARTITION", 5), ("A", "INDEX", 99), ("X", "TABLE", 7)], "segment_name string, segment_type string, bytes bigint"
    )
    rows = catalog.list_tables(tables, segments).orderBy("table_name").collect()
    assert [tuple(r) for r in rows] == [("A", 15, 3, "d"), ("B", 0, None, None)]
    assert [r["table_name"] for r in catalog.list_tables(tables, segments, "B,C").collect()] == ["B"]
    assert [r["table_name"] for r in catalog.table_names(tables).collect()] == ["A", "B"]


def test_describe(spark):
    df = spark.createDataFrame(
        [("U", 2, "name", "TEXT", "Y"), ("U", 1, "id", "INT", "N"), ("A", 1, "x", "INT", "Y")],
        "table_name string, column_id bigint, column_name string, data_type string, nullable string",
    )
    assert [tuple(r) for r in catalog.describe_table(df, "U").collect()] == [("id", "INT", "N"), ("name", "TEXT", "Y")]
    assert [r["column_desc"] for r in catalog.describe_tables(df).orderBy("table_name", "column_id").collect()] == ["x INT", "id INT", "name TEXT"]


def test_sessions_fan_out_and_cut(spark):
    rows = [(i, 1, "u", "o", "p", "ACTIVE" if i % 2 else "INACTIVE", "w", "e", i, "q" if i < 100 else None, i) for i in range(140)]
    cols = "sid int, serial int, username string, osuser string, program string, status string, wait_class string, event string, audsid int, sql_id string, last_call_et int"
    sql = spark.createDataFrame([("q", "select 1"), ("q", "select 2"), ("z", "no")], "sql_id string, sql_text string")
    everyone = catalog.active_sessions(spark.createDataFrame(rows, cols), sql, own_audsid=139)
    assert everyone.count() == 119
    found = catalog.active_sessions(spark.createDataFrame(rows, cols), sql, own_audsid=139, limit=50).collect()
    assert len(found) == 50
    assert [r["sid"] for r in found[:20]] == list(range(137, 98, -2)) and found[0]["sql_text"] is None
    assert [r["sid"] for r in found[20:22]] == [97, 95] or [r["sid"] for r in found[19:21]] == [99, 99]


def test_top_sql(spark):
    df = spark.createDataFrame([("a", 1, 5, 9, 3000000, 1), ("b", 1, 6, 8, 1, 2000000)], "sql_id string, executions int, buffer_gets int, disk_reads int, cpu_time bigint, elapsed_time bigint")
    first = lambda metric: catalog.top_sql_by(df, metric, 1).collect()[0]
    assert [first(m)["sql_id"] for m in ("cpu_time", "Disk_Reads", "BUFFER_GETS", "elapsed_time", "other")] == ["a", "a", "b", "b", "b"]
    assert (first("cpu_time")["cpu_seconds"], first("other")["elapsed_seconds"]) == (3.0, 2.0)


def test_tablespaces_sort_by_number(spark):
    mb = 1024 * 1024
    data = spark.createDataFrame([("BIG", 60 * mb), ("BIG", 40 * mb), ("FULL", 10 * mb), ("NONE", mb)], "tablespace_name string, bytes bigint")
    free = spark.createDataFrame([("BIG", 91 * mb), ("FULL", mb // 2), ("FULL", mb // 2)], "tablespace_name string, bytes bigint")
    rows = catalog.tablespace_usage(data, free).collect()
    assert [tuple(r) for r in rows] == [("NONE", 1.0, None, None), ("FULL", 10.0, 1.0, 90.0), ("BIG", 100.0, 91.0, 9.0)]


def test_invalid_objects(spark):
    df = spark.createDataFrame(
        [("SYS", "VIEW", "a", "INVALID"), ("HR", "VIEW", "b", "INVALID"), ("APP", "VIEW", "c", "INVALID"), ("APP", "VIEW", "d", "VALID")],
        "owner string, object_type string, object_name string, status string",
    )
    assert [r["object_name"] for r in catalog.invalid_objects(df).collect()] == ["c", "b"]
