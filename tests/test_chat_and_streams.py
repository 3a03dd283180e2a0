import json

import pytest
from pyspark.sql import functions as F

from siftwork.operators import chat
from siftwork.streaming.config_stream import judge_versions, keep_last_good, last_good_config, newest_config
from siftwork.streaming.log_stream import late_lines, top_window_patterns, window_patterns, write_window_patterns


@pytest.mark.parametrize(
    "task, details, system",
    [
        ("summarize", {}, "Summarize the following text concisely, in the same language it is written in."),
        ("translate", {"target": "French"}, "Translate the following text to French. Output only the translation."),
        ("classify", {"categories": "a, b"}, "Classify the following text into exactly one of these categories: a, b. Output only the category name."),
        ("draft", {}, None),
    ],
)
def test_requests(spark, task, details, system):
    text = 'say "hi"\n\\ é'
    body = chat.chat_requests(spark.createDataFrame([(1, text)], "id int, text string"), task, "m", **details).collect()[0]["body"]
    messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": text}]
    assert json.loads(body) == {"model": "m", "messages": messages}


def test_results(spark):
    good = json.dumps({"choices": [{"message": {"content": "hello"}}, {"message": {"content": "second"}}]})
    rows = [
        (0, 200, good), (1, 200, '{"data": 1}'), (2, 200, "x" * 600), (3, 401, ""), (4, 403, None), (5, 500, good), (6, None, None),
        (7, 200, '{"choices": []}'), (8, 201, good),
    ]
    df = spark.createDataFrame(rows, "id int, http_status int, body string")
    assert chat.chat_results(df).filter("id = 2").collect()[0]["text"] == "x" * 600
    found = chat.chat_results(df, reply_limit=3000, unexpected_limit=500).orderBy("id").collect()
    assert [r["status"] for r in found] == [
        "draft", "unexpected", "unexpected", "unauthorized", "unauthorized", "error", "unavailable", "unexpected", "draft"
    ]
    assert found[0]["text"] == "[local-model draft, verify before use]\nhello"
    assert found[2]["text"] == "x" * 500 + "\n...[troncato, 100 caratteri omessi]"
    counts = {r["status"]: r["n"] for r in chat.status_counts(chat.chat_results(df)).collect()}
    assert counts == {"draft": 2, "unexpected": 3, "unauthorized": 2, "error": 1, "unavailable": 1}
    assert chat.chat_results(df, F.lit(False)).select("status").distinct().collect()[0]["status"] == "not configured"


GOOD = "ORACLE_HOST=h{}\nORACLE_USERNAME=u\nORACLE_PASSWORD=p"
VERSIONS = [
    ("r", 1, GOOD.format(1)), ("r", 2, "ORACLE_HOST=h2"), ("r", 3, GOOD.format(3)), ("r", 4, "ORACLE_HOST=h4\nORACLE_USERNAME=u"),
    ("s", 1, "# empty"), ("t", 1, "junk"), ("t", 2, GOOD.format(2)),
]
SCHEMA = "repo string, version bigint, text string"
EXPECTED = [
    ("r", 3, GOOD.format(3), 4, "incomplete ORACLE_PASSWORD"),
    ("s", None, None, 1, "no connection configured"),
    ("t", 2, GOOD.format(2), 2, None),
]


def test_versions_as_a_table(spark):
    df = spark.createDataFrame(VERSIONS, SCHEMA)
    assert [tuple(r) for r in last_good_config(df.repartition(4)).orderBy("repo").collect()] == EXPECTED
    assert judge_versions(df).filter("error is null").count() == 3


def delivery(folder, name, columns, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(columns, r))) for r in rows))


def test_versions_as_a_stream_in_several_batches(spark, tmp_path):
    source, ledger, state = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "state")
    source.mkdir()
    columns = ("repo", "version", "text")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        query = keep_last_good(stream, ledger, state)
        query.awaitTermination()
        return [tuple(r) for r in newest_config(spark, ledger).orderBy("repo").collect()]

    assert run() == []
    delivery(source, "a", columns, VERSIONS[2:3])
    delivery(source, "b", columns, VERSIONS[4:])
    first = run()
    assert first[0] == ("r", 3, GOOD.format(3), 3, None)
    batches = len({r["batch_id"] for r in spark.read.parquet(ledger).collect()})
    assert batches == 2
    delivery(source, "c", columns, VERSIONS[:2] + VERSIONS[3:4])
    assert run() == EXPECTED  # from the restored state: the good version 3 came in an earlier run
    rows = spark.read.parquet(ledger).filter("batch_id >= 2").collect()
    assert {r["repo"] for r in rows} == {"r"}  # the others had no version in that batch
    assert run() == EXPECTED


LINES = "source string, ts timestamp, line_no bigint, line string"


def log_rows(*rows):
    return [("app", f"2024-05-{day:02} {time}", no, line) for day, time, no, line in rows]


EARLY = log_rows((1, "01:00:00", 1, "job 1 done"), (1, "02:00:00", 2, "job 22 done"), (1, "03:00:00", 3, "stop"), (1, "04:00:00", 4, " "), (2, "05:00:00", 5, "job 5 done"))
NEXT = log_rows((2, "01:00:00", 6, "stop"), (1, "23:00:00", 7, "late 1"), (1, "23:30:00", 8, "stop"), (3, "07:00:00", 9, "stop 9"))
LAST = log_rows((2, "09:00:00", 10, "job 1 done"), (3, "08:00:00", 11, "stop 10"), (5, "00:00:01", 12, "end"))


def test_windows_of_a_stream_close_by_event_time(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "sink"), str(tmp_path / "state")
    source.mkdir()

    def run():
        stream = spark.readStream.schema(LINES).json(str(source))
        write_window_patterns(stream, sink, state, delay="4 hours").awaitTermination()
        closed = spark.read.parquet(sink)
        late = late_lines(spark.read.schema(LINES).json(str(source)), closed)
        top = [(r["window_start"].day, r["rank"], r["n"], r["pattern"], r["first_no"], r["line"]) for r in top_window_patterns(closed, 2).orderBy("window_start", "rank").collect()]
        return top, {r["window_start"].day: (r["lines"], r["late"]) for r in late.collect()}

    columns = ("source", "ts", "line_no", "line")
    delivery(source, "a", columns, EARLY)
    day1 = [(1, 1, 2, "job # done", 1, "job 1 done"), (1, 2, 1, "stop", 3, "stop")]
    assert run() == (day1, {1: (3, 0)})  # the newest line is of 05:00 on day 2, an hour past the delay
    delivery(source, "b", columns, NEXT)
    day2 = [(2, 1, 1, "job # done", 5, "job 5 done"), (2, 2, 1, "stop", 6, "stop")]
    assert run() == (day1 + day2, {1: (5, 2), 2: (2, 0)})  # two lines of day 1 came when it was closed
    delivery(source, "c", columns, LAST)
    top, late = run()
    assert top == day1 + day2 + [(3, 1, 2, "stop #", 9, "stop 9")] and late == {1: (5, 2), 2: (3, 1), 3: (2, 0)}
    assert run() == (top, late)


def test_windows_of_a_table(spark):
    rows = spark.createDataFrame([(s, t, n, x) for s, t, n, x in EARLY + NEXT], "source string, ts string, line_no bigint, line string")
    found = window_patterns(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    days = {}
    for r in found.collect():
        days.setdefault(r["window_start"].day, {})[r["pattern"]] = (r["n"], r["first_no"], r["line"])
    assert days == {
        1: {"job # done": (2, 1, "job 1 done"), "stop": (2, 3, "stop"), "late #": (1, 7, "late 1")},
        2: {"job # done": (1, 5, "job 5 done"), "stop": (1, 6, "stop")},
        3: {"stop #": (1, 9, "stop 9")},
    }
