from pyspark.sql import functions as F

from siftwork.functions import text as tx
from siftwork.operators import lines

LOG = [
    "2031-02-03 04:17:08 FINE oven 11 closed",
    "2031-02-03 04:17:52 FINE oven 12 closed",
    "",
    "2031-02-03T04:31:00.507 GRAVE oven 12 burns",
    "smoke 04:32:10",
]


def log(spark, rows, source="a"):
    return spark.createDataFrame([(source, i + 1, r) for i, r in enumerate(rows)], "source string, line_no bigint, line string")


def test_top_patterns_count_and_keep_first_line(spark):
    rows = lines.log_top_patterns(log(spark, LOG)).orderBy("rank").collect()
    assert [(r["n"], r["line"]) for r in rows] == [(2, LOG[0]), (1, LOG[3]), (1, LOG[4])]
    assert rows[0]["pattern"] == "# FINE oven # closed"
    assert rows[2]["pattern"] == "smoke #"


def test_top_n_limits_per_source(spark):
    both = log(spark, LOG).union(log(spark, ["x", "y", "x"], "b"))
    rows = lines.log_top_patterns(both, top_n=1).orderBy("source").collect()
    assert [(r["source"], r["n"], r["line"]) for r in rows] == [("a", 2, LOG[0]), ("b", 2, "x")]


def test_summary_takes_times_by_position(spark):
    shuffled = ["10:00:09 late first", "no time", " \t ", "09:00:00 early last"]
    row = lines.log_summary(log(spark, shuffled)).collect()[0]
    assert (row["total_lines"], row["first_ts"], row["last_ts"], row["distinct_patterns"]) == (3, "10:00:09", "09:00:00", 3)


def test_summary_without_timestamps(spark):
    row = lines.log_summary(log(spark, ["a 1", "a 2"])).collect()[0]
    assert (row["total_lines"], row["first_ts"], row["last_ts"], row["distinct_patterns"]) == (2, None, None, 1)


def test_dedupe_plain_and_masked(spark):
    plain = lines.dedupe_lines(log(spark, list("abaab")), ["source"], None).orderBy(F.desc("n"), "first_no").collect()
    assert [(r["line"], r["n"]) for r in plain] == [("a", 3), ("b", 2)]
    masked = lines.dedupe_lines(log(spark, ["error at line 10", "error at line 42", "error at line 99"]), ["source"]).collect()
    assert [(r["line"], r["n"]) for r in masked] == [("error at line 10", 3)]


def test_ties_keep_first_seen_order_whatever_the_partitioning(spark):
    rows = [f"{w} {i}" for i in range(40) for w in ("zeta", "alpha", "mid")]
    for parts in (1, 8):
        top = lines.log_top_patterns(log(spark, rows).repartition(parts)).orderBy("rank").collect()
        assert [r["line"] for r in top] == ["zeta 0", "alpha 0", "mid 0"]


def test_buckets_never_change_the_top(spark):
    mostly_once = [f"once {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    often = [f"{w} {i}" for k, w in enumerate(("ten", "nine", "nine too", "two")) for i in range((10, 9, 9, 2)[k])]
    rows = log(spark, mostly_once[:150] + often + ["", " "] + mostly_once[150:]).union(log(spark, ["x", "y", "x"], "b"))
    rows = rows.union(spark.createDataFrame([(None, 1, "none")], rows.schema)).repartition(5)
    for top_n in (1, 3, 4, 400):
        wanted = sorted(map(tuple, lines.log_top_patterns(rows, top_n).collect()))
        for buckets in (1, 7, 1 << 16):
            assert sorted(map(tuple, lines.log_top_patterns_by_buckets(rows, top_n, buckets).collect())) == wanted


def test_buckets_of_an_empty_log(spark):
    assert lines.log_top_patterns_by_buckets(log(spark, [""])).collect() == []


def test_one_frequent_pattern_among_rare_ones(spark):
    many = spark.range(200000).selectExpr("'a' source", "id line_no", "if(id % 4 = 0, 'often', concat('x', translate(string(id), '0123456789', 'abcdefghij'))) line")
    row = lines.log_top_patterns_by_buckets(many, 1).collect()
    assert [(r["n"], r["line"], r["first_no"]) for r in row] == [(50000, "often", 0)]


def test_digits_of_any_script_are_masked(column):
    assert column("a٣٤b1", tx.mask_numbers(F.col("x"))) == "a#b#"


def test_line_modes(column):
    text = "a\r\nb\rc\x0bd e\n"
    assert column(text, tx.text_lines(F.col("x"), "captured")) == text.splitlines()
    assert column(text, tx.text_lines(F.col("x"), "universal")) == ["a", "b", "c\x0bd e"]
    assert column("", tx.text_lines(F.col("x"), "captured")) == []
    assert column("\n\n", tx.text_lines(F.col("x"), "captured")) == ["", ""]


def test_strip_takes_every_blank(column):
    text = "　\t x y \x1c "
    assert column(text, tx.strip(F.col("x"))) == text.strip()


def test_cap_counts_characters(column):
    assert column("x" * 3000, tx.cap_text(F.col("x"), 100)) == "x" * 100 + "\n...[troncato, 2900 caratteri omessi]"
    assert column("\U0001f600" * 3, tx.cap_text(F.col("x"), 3)) == "\U0001f600" * 3


def test_html_to_text(column):
    html = (
        "<HTML><Style>\np{color:red}\n</STYLE><body><!-- note --><h1>Title</h1>\n\n\n  <p>Some <b>bold</b> &amp; text</p>"
        "<script>if (a < b) { x() }</script></body>"
    )
    text = column(html, tx.html_to_text(F.col("x")))
    assert text.split("\n")[0] == "Title"
    assert "bold" in text and "&amp;" in text and "color" not in text and "x()" not in text and "note" not in text
    assert column("<b>x</b>", tx.html_to_text(F.col("x"), F.lit("text/plain"))) == "<b>x</b>"
    assert column("<b>x</b>", tx.html_to_text(F.col("x"), F.lit("text/html; charset=utf-8"))) == "x"


def test_html_with_loose_angle_brackets(column):
    assert column("a < b <i>c</i> d < e", tx.html_to_text(F.col("x"))) == "a  c  d < e"
    assert column("no markup", tx.html_to_text(F.col("x"))) == "no markup"
    assert len(column("<" * 200000, tx.html_to_text(F.col("x")))) == 200000


def test_bytes_as_text(column):
    assert column(b"a\xffb", tx.utf8_text(F.col("x")), "binary") == "a�b"
    assert column(b"a\xffb", tx.utf8_text_lenient(F.col("x")), "binary") == "ab"


def test_entropy_of_characters(column):
    rated = lambda text: column(text, tx.entropy(F.col("x")))
    assert [rated(t) for t in ("", "aaaa", "abab", "abcdabcd", "日本")] == [0.0, 0.0, 1.0, 2.0, 1.0] and rated(None) is None
