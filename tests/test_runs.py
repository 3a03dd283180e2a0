import time

import pytest
from pyspark.sql import functions as F

from siftwork.operators import runs

VSTEST = (
    "Passed!  - Failed:     0, Passed:    31, Skipped:     4, Total:    35, Duration: 4 s - Oven.dll (net8.0)\n"
    "Failed!  - Failed:     2, Passed:     6, Skipped:     0, Total:     8, Duration: 9 s - Shelf.dll (net8.0)\n"
)
AGGREGATE = "Test summary: total: 19, failed: 0, succeeded: 18, skipped: 1, duration: 3.4s\n"
BLOCK = "Test run summary: Failed! - out/oven\n  total: 23\n\n  failed: 3\n  succeeded: 18\n  skipped: 2\n  duration: 7s\n"

TOTALS = [
    (VSTEST, (37, 2, 4, 43, "vstest x2 assemblies")),
    (VSTEST + AGGREGATE, (18, 0, 1, 19, "dotnet")),
    (BLOCK, (18, 3, 2, 23, "dotnet-mtp")),
    ("s..\n\nRan 58 tests in 2.25s\n\nOK (skipped=5)\n", (53, 0, 5, 58, "unittest")),
    ("Ran 17 tests in 6.0s\n\nFAILED (failures=2, errors=1, skipped=4)\n", (10, 3, 4, 17, "unittest")),
    ("Ran 6 tests in 1.5s\n\nOK\n", (6, 0, 0, 6, "unittest")),
    ("Ran 21 tests in 4.2s\n", None),
    ("== 2 failed, 14 passed, 3 skipped, 2 errors, 6 warnings in 3.07s ==\n", (14, 4, 3, 21, "pytest")),
    ("8 passed, 2 xfailed, 1 xpassed in 2s\n", (9, 0, 2, 11, "pytest")),
    ("8 py3 in 5s\n", (0, 0, 0, 0, "pytest")),
    ("6 passed in 2.10s\n9 passed in 0.75s\n", (9, 0, 0, 9, "pytest")),
    ("Test Suites: 2 failed, 9 passed, 11 total\nTests:       2 failed, 5 skipped, 61 passed, 68 total\n", (61, 2, 5, 68, "jest")),
    ("Tests:  4 todo, 9 passed, 13 total\n", (9, 0, 4, 13, "jest")),
    ("all ovens are cold\n", None),
    ("", None),
]


def make_runs(spark, outputs, codes=None):
    rows = [(i, (codes or {}).get(i, 0), o) for i, o in enumerate(outputs)]
    return spark.createDataFrame(rows, "run_id bigint, exit_code int, output string")


def test_totals_of_every_format(spark):
    rows = runs.test_totals(make_runs(spark, [t for t, _ in TOTALS])).orderBy("run_id").collect()
    for row, (text, expected) in zip(rows, TOTALS):
        found = tuple(row[c] for c in ("passed", "failed", "skipped", "total", "format"))
        assert found == (expected or (None,) * 5), text


@pytest.mark.parametrize(
    "hostile",
    ["1 " + "1111 " * 20000 + "x in nothing\n", "\n" * 50000 + "total: 1\n" + "\n" * 50000, "=" * 100000 + "\n", "1 a, " * 30000 + "\n"],
)
def test_totals_do_not_explode_on_long_outputs(spark, hostile):
    start = time.time()
    text = hostile + " in succeeded: Test summary: Failed: Tests: Ran \n"
    assert runs.test_totals(make_runs(spark, [text])).collect()[0]["total"] is None
    assert time.time() - start < 30


def test_zero_failed_summary_is_no_failure(spark):
    row = runs.test_digest(make_runs(spark, [AGGREGATE])).collect()[0]
    assert (row["failure_lines"], row["status"], row["total"]) == (0, "no failures detected", 19)


def test_failing_run(spark):
    output = "oven.py::test_heat PASSED\noven.py::test_cool FAILED\nE   AssertionError: still at 7 degrees\n1 failed, 1 passed in 0.31s\n"
    row = runs.test_digest(make_runs(spark, [output], {0: 1})).collect()[0]
    assert (row["passed"], row["failed"], row["failure_lines"], row["status"]) == (1, 1, 2, "failures")
    assert row["summary_lines"] == ["1 failed, 1 passed in 0.31s"]
    assert row["last_lines"] is None
    top = runs.test_failure_lines(runs.run_lines(make_runs(spark, [output]))).orderBy("rank").collect()
    assert [r["line"] for r in top] == ["oven.py::test_cool FAILED", "E   AssertionError: still at 7 degrees"]


def test_unexplained_failure_shows_last_lines(spark):
    output = "\n".join(f"step {i}" for i in range(30))
    row = runs.test_digest(make_runs(spark, [output], {0: 2})).collect()[0]
    assert row["status"] == "non-zero exit, no recognizable failure lines"
    assert row["last_lines"] == [f"step {i}" for i in range(10, 30)]
    assert row["total"] is None


def test_counts_of_other_scripts_and_sizes(spark):
    outputs = ["\u0663 passed in 1s\n", "99999999999999999999 passed in 1s\n"]
    rows = runs.test_totals(make_runs(spark, outputs)).orderBy("run_id").collect()
    assert [r["passed"] for r in rows] == [3, None]


def test_failure_patterns_are_cut_on_request(spark):
    output = "\n".join("FAILED " + "x" * i for i in range(1, 41))
    lines = runs.run_lines(make_runs(spark, [output]))
    assert runs.test_failure_lines(lines, limit=30).count() == 30 and runs.test_failure_lines(lines).count() == 40


def test_build_digest(spark):
    outputs = [
        "  src/a.ts(10,5): error TS2322: bad\nsrc/b.ts(42,1): error TS2322: bad\nWARNING: old\nbuild finished\n",
        "done\n",
        "nothing here\nreally\n",
        "0 errors\n",
    ]
    all_runs = make_runs(spark, outputs, {0: 1, 2: 3})
    lines = runs.run_lines(all_runs)
    rows = runs.build_digest(lines, all_runs).orderBy("run_id").collect()
    assert [r["status"] for r in rows] == [
        "issues found", "build clean", "non-zero exit, no recognizable error lines", "issues found"
    ]
    assert (rows[0]["error_lines"], rows[0]["error_patterns"], rows[0]["warning_lines"]) == (2, 2, 1)
    assert rows[2]["last_lines"] == ["nothing here", "really"]
    top = runs.build_top_patterns(lines).filter("run_id = 0 and class = 'error'").orderBy("rank").collect()
    assert [r["line"] for r in top] == ["src/a.ts(10,5): error TS2322: bad", "src/b.ts(42,1): error TS2322: bad"]


def test_same_error_on_other_lines_is_one_pattern(spark):
    lines = runs.run_lines(make_runs(spark, ["a.ts(1,2): error TS1: x\na.ts(7,9): error TS1: x\n"]))
    rows = runs.build_top_patterns(lines).collect()
    assert [(r["n"], r["line"]) for r in rows] == [(2, "a.ts(1,2): error TS1: x")]


def test_build_failed_ignores_the_rule_under_study(spark):
    outputs = ["a.cs(1,1): error IDE0005: unneeded", "a.cs(1,1): error CS0246: missing", "x : error : plain", "error without colon", "a : error IDE00055: other"]
    all_runs = make_runs(spark, outputs, {0: 1, 1: 1, 2: 0, 3: 1, 4: 1})
    rows = runs.build_failed(runs.run_lines(all_runs), all_runs).orderBy("run_id").collect()
    assert [r["failed"] for r in rows] == [False, True, False, False, True]
    assert [r["error_lines"] for r in rows] == [0, 1, 1, 0, 1]


def test_classes(spark):
    df = spark.createDataFrame([("Warning: ERROR",), ("a warn",), ("ok",)], "line string")
    assert [r["c"] for r in df.select(runs.line_class(F.col("line")).alias("c")).collect()] == ["error", "warning", "other"]
