import json

from siftwork.operators import diagnostics as dg

BOM = b"\xef\xbb\xbf"
RUNS = "run_id string, exit_code int"
LOGS = "run_id string, file_name string, body string"


def result(uri, start=None, end=None, rule="IDE0005", suppressed=False):
    region = {k: v for k, v in (("startLine", start), ("endLine", end)) if v is not None}
    found = {"ruleId": rule, "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": region}}]}
    return {**found, "suppressions": [{"kind": "inSource"}]} if suppressed else found


def sarif(spark, **logs):
    rows = [("b", name.replace("__", ".") + ".sarif", json.dumps({"runs": [{"results": results}]})) for name, results in logs.items()]
    return spark.createDataFrame(rows, LOGS)


def test_spans_unfold_and_paths_fold(spark):
    log = sarif(spark, Lib_net8__0_77=[result("file:///r/a%20b/../x.cs", 5, 7), result("y.CS", 2)])
    rows = sorted((r["path"], r["line_no"], r["project"], r["tfm"]) for r in dg.sarif_diagnostics(log).collect())
    assert rows == [("/r/x.cs", n, "Lib_77", "net8.0") for n in (5, 6, 7)] + [("y.CS", 2, "Lib_77", "net8.0")]


def test_what_is_ignored(spark):
    log = sarif(
        spark,
        A_net8__0_1=[
            result("x.cs", 1, suppressed=True), result("r/obj/g.cs", 1), result("r\\BIN\\g.cs", 1), result("x.vb", 1),
            result("x.cs"), result("x.cs", 9, 8), result("x.cs", 1, rule="CS1"),
        ],
    )
    assert dg.sarif_diagnostics(log).collect() == []


def test_every_log_counts_as_a_compilation(spark):
    log = sarif(spark, My_Lib_net8__0_1=[], My_Lib_net9__0_1=[]).union(
        spark.createDataFrame([("b", "notes.txt", "{}"), ("b", "B_net8.0_2.sarif", "﻿{}")], LOGS)
    )
    assert sorted(map(tuple, dg.sarif_contexts(log).drop("run_id").collect())) == [("B_2", "net8.0"), ("My_Lib_1", "net8.0"), ("My_Lib_1", "net9.0")]


def test_partial_frameworks_are_kept(spark):
    log = sarif(
        spark,
        A_net8__0_1=[result("x.cs", 1, 2)], A_net9__0_1=[result("x.cs", 1)], B_net8__0_2=[result("x.cs", 1, 2)], C_net8__0_3=[],
    )
    rows = dg.select_removable(dg.sarif_diagnostics(log), dg.sarif_contexts(log)).collect()
    assert sorted((r["line_no"], r["status"]) for r in rows) == [(1, "removable"), (2, "partial")]


def sources(spark, run="b", **contents):
    rows = [(run, f"{k}.cs", bytearray(v)) for k, v in contents.items()]
    return spark.createDataFrame(rows, "run_id string, path string, content binary")


def flagged(spark, *rows, run="b"):
    return spark.createDataFrame([(run, *row) for row in rows], "run_id string, path string, line_no bigint")


def test_directives(spark):
    content = BOM + b"using Tea;\r\n  global using Pot; // why\r\n\r\nusing (var lid = cup) {}\r\nusing var z = q;\rusing C.D = E.F;"
    wanted = flagged(spark, *[("x.cs", i) for i in range(0, 10)])
    kept = dg.keep_directive_lines(wanted, sources(spark, x=content)).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in kept] == [
        (1, "using Tea;"), (2, "  global using Pot; // why"), (5, "using var z = q;"), (6, "using C.D = E.F;"),
    ]


def test_removal_is_byte_exact(spark):
    files = sources(spark, x=BOM + b"using Tea;\r\nusing Pot;\r\n// t\xe9\r\nusing Cup;\n\rclass X {}\n", y=b"using Tea;", z=b"kept")
    wanted = flagged(spark, ("x.cs", 1), ("x.cs", 3), ("x.cs", 4), ("x.cs", 99), ("x.cs", 0), ("y.cs", 1), ("gone.cs", 1))
    rows = dg.remove_lines(files, wanted).orderBy("path").collect()
    assert [(r["path"], bytes(r["content"]), r["removed"], r["skipped"], r["outside"]) for r in rows] == [
        ("x.cs", BOM + b"using Pot;\r\n// t\xe9\r\n\rclass X {}\n", [1, 4], [3], 2), ("y.cs", b"", [1], [], 0),
    ]


def test_runs_with_the_same_path_stay_apart(spark):
    files = sources(spark, "one", x=b"using Tea;\nA\n").union(sources(spark, "two", x=b"using Pot;\nB\n"))
    rows = dg.remove_lines(files, flagged(spark, ("x.cs", 1), run="two")).collect()
    assert [(r["run_id"], r["path"], bytes(r["content"]), r["removed"]) for r in rows] == [("two", "x.cs", b"B\n", [1])]
    logs = sarif(spark, A_net8__0_1=[result("x.cs", 1)])
    other = spark.createDataFrame([("two", "A_net9.0_1.sarif", "{}")], LOGS)
    found = dg.select_removable(dg.sarif_diagnostics(logs.union(other)), dg.sarif_contexts(logs.union(other))).collect()
    assert [tuple(r) for r in found] == [("b", "x.cs", 1, "removable")]


def test_a_span_without_end_meets_the_file(spark):
    log = sarif(spark, A_net8__0_1=[result("x.cs", 1, 2_000_000_000)])
    clean = spark.createDataFrame([("b", 0)], RUNS)
    lines = spark.createDataFrame([("b", 1, "fine")], "run_id string, line_no bigint, line string")
    report = dg.prune_report(log, sources(spark, x=b"using Tea;\n\nusing Pot;\n"), lines, clean)
    assert [tuple(r) for r in report.collect()] == [("b", "x.cs", "removable", 2)]


def test_report_and_status_per_run(spark):
    body = json.dumps({"runs": [{"results": [result("x.cs", 1, 3)]}]})
    log = lambda run, text=body: (run, "A_net8.0_1.sarif", text)
    logs = spark.createDataFrame(
        [log("good"), log("noise"), log("bad"), log("cut", body[:-1]), log("more", body + " x"), log("calm", "{}"), log("null", None)], LOGS
    )
    runs = [("good", 0), ("noise", 1), ("bad", 1), ("cut", 0), ("more", 0), ("calm", 0), ("silent", 0), ("null", 0)]
    text = b"using Tea;\n\nusing Pot;\n"
    files = spark.createDataFrame([(r, "x.cs", bytearray(text)) for r, _ in runs], "run_id string, path string, content binary")
    said = {"noise": "x.cs(1,1): error IDE0005: unneeded", "bad": "x.cs(1,1): error CS0103: missing"}
    lines = spark.createDataFrame([(r, 1, said.get(r, "fine")) for r, _ in runs], "run_id string, line_no bigint, line string")
    builds = spark.createDataFrame(runs, RUNS)
    report = dg.prune_report(logs, files, lines, builds)
    assert sorted(map(tuple, report.collect())) == [("good", "x.cs", "removable", 2), ("noise", "x.cs", "removable", 2)]
    status = {r["run_id"]: (r["status"], r["error_lines"], r["lines"]) for r in dg.prune_status(report, logs, lines, builds).collect()}
    assert status == {
        "good": ("lines found", 0, 2), "noise": ("lines found", 0, 2), "bad": ("build failed", 1, 0),
        "cut": ("unreadable log", 0, 0), "more": ("unreadable log", 0, 0), "null": ("unreadable log", 0, 0),
        "calm": ("nothing unnecessary", 0, 0), "silent": ("no compilation seen", 0, 0),
    }


def test_a_log_is_sound_by_the_one_parse_as_by_the_plain_test(spark):
    bodies = [
        "{}", "\ufeff{}", '{"runs": []}', '{"runs": "x"}', '{"runs": [{"results": 5}]}', '{"runs": [{"results": [{"ruleId": 7}]}]}', "[]", "[{}]", "5", "null", '"x"', "", " ",
        None, "{} oops", "{},{}", "{}{}", "{oops", '{"a": 1, "runs": null}', '{"runs": [null]}', "{}\n", '{"x": "]"}', '{"x": [1,}', '{"version": "2", "runs": [{"tool": {}}]} ',
    ]
    logs = spark.createDataFrame([("b", f"P_net8.0_{k}.sarif", b) for k, b in enumerate(bodies)], LOGS)
    unsound = {r["file_name"] for r in dg.read_logs(logs).filter("not sound").collect()}
    assert unsound == {r["file_name"] for r in dg.unreadable_logs(logs).collect()}


def test_sources_are_joined_without_a_broadcast(spark):
    """Contents grow with the input, while their size is estimated by the small scan that they are rendered from."""
    files = sources(spark, x=b"using A;\nusing B;\n")
    lines = flagged(spark, ("x.cs", 2))
    log = sarif(spark, A_net8__0_1=[result("x.cs", 1)])
    none = spark.createDataFrame([], "run_id string, line_no bigint, line string")
    report = dg.prune_report(log, files, none, spark.createDataFrame([("b", 0)], RUNS))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (dg.keep_directive_lines(lines, files), dg.remove_lines(files, lines), report)]
    assert "Broadcast" not in plans[0] + plans[1]
    assert [plan.count("SortMergeJoin") >= n for plan, n in zip(plans, (2, 2, 3))] == [True] * 3
    assert [(r["path"], r["status"], r["lines"]) for r in report.collect()] == [("x.cs", "removable", 1)]


def test_files_that_repeat_a_path_lose_their_own_lines(spark):
    files = sources(spark, x=b"using A;\nusing B;\ncode\n").union(sources(spark, x=b"using A;\n"))
    rows = dg.remove_lines(files, flagged(spark, ("x.cs", 1), ("x.cs", 2), ("x.cs", 3), ("x.cs", 9))).collect()
    found = sorted((bytes(r["content"]), r["removed"], r["skipped"], r["outside"]) for r in rows)
    assert found == [(b"", [1], [], 3), (b"code\n", [1, 2], [3], 1)]
