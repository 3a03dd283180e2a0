from siftwork.functions.paths import SOURCE_TREE_EXCLUDES
from siftwork.operators import lines
from siftwork.sources import checkpoints
from siftwork.sources.files import read_files, read_log_lines, register_tables, run_sql, walk_files


def write(root, **files):
    for path, content in files.items():
        target = root / path.replace("__", "/").replace("_dot_", ".")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)


def test_read_files_prunes_by_listing(spark, tmp_path):
    write(tmp_path, app__src__a_dot_py=b"x", app__node_modules__b_dot_py=b"y", app__c_dot_PY=b"z", app__d_dot_txt=b"t", lib___dot_git__e_dot_py=b"g", lib__f_dot_py=b"\xff")
    df = read_files(spark, str(tmp_path), SOURCE_TREE_EXCLUDES, [".py"], skip_hidden=True, repo_depth=1)
    rows = sorted((r["repo"], r["path"], bytes(r["content"])) for r in df.collect())
    assert rows == [("app", "c.PY", b"z"), ("app", "src/a.py", b"x"), ("lib", "f.py", b"\xff")]
    everything = read_files(spark, str(tmp_path))
    assert sorted(r["path"] for r in everything.select("path").collect())[0] == "app/c.PY"
    assert everything.filter("repo = ''").count() == 5  # a scan never sees .git


def test_walk_files_sees_every_name(spark, tmp_path):
    write(tmp_path, app__src__a_dot_py=b"x", app__dist__b_dot_py=b"y", app__src__deep__c_dot_PY=b"z", app__d_dot_txt=b"t", lib___dot_git__e_dot_py=b"g")
    (tmp_path / "app" / "src" / "__init__.py").write_bytes(b"i")
    (tmp_path / "app" / ".env.py").write_bytes(b"\xff")
    (tmp_path / "app" / "loop").symlink_to(tmp_path / "app")
    df = walk_files(spark, str(tmp_path), SOURCE_TREE_EXCLUDES, [".py"], skip_hidden=True, repo_depth=1)
    rows = sorted((r["repo"], r["path"], bytes(r["content"])) for r in df.collect())
    assert rows == [("app", ".env.py", b"\xff"), ("app", "src/__init__.py", b"i"), ("app", "src/a.py", b"x"), ("app", "src/deep/c.PY", b"z")]
    assert walk_files(spark, f"file://{tmp_path}").count() == 7


def test_walk_of_an_empty_folder(spark, tmp_path):
    assert walk_files(spark, str(tmp_path)).collect() == []


def test_log_lines_keep_file_order_over_splits(spark, tmp_path):
    log = tmp_path / "big.log"
    log.write_text("".join(f"2026-01-01 00:{i // 60 % 60:02}:{i % 60:02} step {'abc'[i % 3]} {i}\n" for i in range(3000)))
    (tmp_path / "small.log").write_text("only 1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_log_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        ordered = [r["line"] for r in df.filter("source like '%big.log'").orderBy("line_no").collect()]
        top = lines.log_top_patterns(df).filter("source like '%big.log'").orderBy("rank").collect()
        summary = lines.log_summary(df).filter("source like '%big.log'").collect()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ordered == log.read_text().splitlines()
    assert [(r["n"], r["line"]) for r in top] == [(1000, ordered[i]) for i in range(3)]
    assert (summary["first_ts"], summary["last_ts"]) == ("2026-01-01 00:00:00", "2026-01-01 00:49:59")


def test_sql_over_registered_tables(spark):
    register_tables(spark, "/root/testdata/sf0.001", ["nation", "region"])
    rows = run_sql(spark, "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name").collect()
    assert sum(r["n"] for r in rows) == 25


def test_intermediate_tables_live_in_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoints.shared_dir(spark) == folder.rstrip("/")
    table, odd = checkpoints.materialize_counting(spark.range(10), "ten", "id % 2 = 1")
    assert odd == 5 and table.count() == 10
    assert all(f.replace("file://", "").startswith(folder) for f in table.inputFiles())


def test_lines_are_numbered_without_gaps_over_splits(spark, tmp_path):
    from siftwork.sources.files import read_numbered_lines

    expected = {}
    for name, n in (("a.log", 4000), ("b c.log", 1), ("empty.log", 0), ("d.log", 900)):
        lines = [f"{name} line {k} " + "x" * (k * 37 % 200) for k in range(n)]
        (tmp_path / name).write_text("\r\n".join(lines))
        expected.update({(name[0], k + 1): x for k, x in enumerate(lines)})
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        frame = read_numbered_lines(spark, str(tmp_path))
        assert frame.rdd.getNumPartitions() > 1
        found = [(r["source"].rsplit("/", 1)[1][0], r["line_no"], r["line"]) for r in frame.collect()]
    finally:
        spark.conf.set(key, before)
    assert len(found) == len(expected) and {(s, n): x for s, n, x in found} == expected


def test_excluded_folders_are_never_opened(tmp_path):
    from pyspark.sql.datasource import EqualTo, In

    from siftwork.sources.tree import TreeReader

    for folder in ("a/b/c", "a/node_modules/x", "a/.hid", "d", "e/f"):
        (tmp_path / folder).mkdir(parents=True)
        for name in ("m.py", "n.PY", "o.ts", ".py", "p"):
            (tmp_path / folder / name).write_text(folder)
    for tasks in (1, 2, 3, 50):
        reader, opened = TreeReader(str(tmp_path), {"node_modules"}, True, tasks), []
        plain = reader.entries
        reader.entries = lambda store, folder: opened.append(folder) or plain(store, folder)
        kept = [EqualTo(("size",), 3)]
        assert list(reader.pushFilters([In(("extension",), (".py", ".ts")), *kept, EqualTo(("extension",), ".py")])) == kept
        parts = reader.partitions()
        assert len(parts) <= tasks and len(opened) <= 7
        found = sorted(path[len(str(tmp_path)) + 1:] for part in parts for path, _, _ in reader.read(part))
        assert found == sorted(f"{folder}/{name}" for folder in ("a/b/c", "d", "e/f") for name in (".py", "m.py", "n.PY"))
        assert set(opened) == {str(tmp_path / f) if f else str(tmp_path) for f in ("", "a", "a/b", "a/b/c", "d", "e", "e/f")}


def test_walk_pushes_extensions_and_keeps_longer_endings(spark, tmp_path):
    from siftwork.sources.files import walk_names

    write(tmp_path, a__x_dot_d_dot_ts=b"12", a__y_dot_ts=b"1", b__z_dot_TS=b"", b__copy=b"1234")
    names = lambda **o: sorted(r["path"].rsplit("/", 1)[1] for r in walk_names(spark, str(tmp_path), **o).collect())
    assert names(exts=[".ts"]) == ["x.d.ts", "y.ts", "z.TS"]
    assert names(exts=[".d.ts"]) == ["x.d.ts"]
    assert names(exts=["py", ".d.ts"]) == ["copy", "x.d.ts"]
    assert {r["size"] for r in walk_names(spark, str(tmp_path)).collect()} == {0, 1, 2, 4}
