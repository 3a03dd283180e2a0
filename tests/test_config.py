import pytest

from siftwork.operators import config as cfg

TNS = "(DESCRIPTION=(ADDRESS=(PROTOCOL=TCP)(HOST=dbhost)(PORT=1521))(ADDRESS=(HOST=other))(CONNECT_DATA=(SERVER=DEDICATED)(SERVICE_NAME=svc)))"


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "repo string, layer string, text string")


def test_entries(spark):
    text = "# note\n\n A = 1 \nB=\"x=y\"\nC='q'\nno pair\n=nokey\nD=\nA=2\nE=\"'both'\"\n#F=1\n"
    rows = cfg.env_entries(texts(spark, ("r", "file", text))).collect()
    assert {r["key"]: (r["value"], r["line_no"]) for r in rows} == {
        "A": ("2", 9), "B": ("x=y", 4), "C": ("q", 5), "D": ("", 8), "E": ("both", 10)
    }


def test_real_environment_wins_even_when_empty(spark):
    entries = cfg.env_entries(texts(spark, ("r", "file", "A=1\nB=2\nC=3"), ("r", "real", "A=9\nC="), ("s", "file", "A=5"), ("s", "odd", "A=6")))
    rows = {(r["repo"], r["key"]): (r["value"], r["layer"]) for r in cfg.effective_config(entries).collect()}
    assert rows == {("r", "A"): ("9", "real"), ("r", "B"): ("2", "file"), ("r", "C"): ("", "real"), ("s", "A"): ("5", "file")}


def test_placeholders(spark):
    templates = spark.createDataFrame(
        [("r", "t", "a: ${A}\nb: ${B:dflt}\nc: ${C:}\nd: ${E:x:y} $F {G}"), ("r", "u", "${A}-${NOPE}"), ("s", "plain", "none")],
        "repo string, template string, text string",
    )
    config = spark.createDataFrame([("r", "A", "1"), ("r", "B", ""), ("s", "NOPE", "no")], "repo string, key string, value string")
    rows = cfg.resolve_placeholders(templates, config).orderBy("template", "pos").collect()
    assert [(r["name"], r["value"], r["status"]) for r in rows] == [
        ("A", "1", "set"), ("B", "dflt", "default"), ("C", "", "default"), ("E", "x:y", "default"), ("A", "1", "set"), ("NOPE", None, "unresolved"),
    ]
    filled = {r["template"]: (r["text"], r["unresolved"]) for r in cfg.fill_templates(templates, config).collect()}
    assert filled == {"t": ("a: 1\nb: dflt\nc: \nd: x:y $F {G}", 0), "u": (None, 1), "plain": ("none", 0)}


@pytest.mark.parametrize(
    "text, expected",
    [
        (f"Data Source={TNS};User Id=me;Password=p=q", ("dbhost:1521/svc", "me", True, [], "ok")),
        ("data source = h:1/s ; user   id=me;PASSWORD=x;Pooling=true", ("h:1/s", "me", True, [], "ok")),
        ("User Id=a;User Id=b;Data Source=alias;Password=x", ("alias", "b", True, [], "ok")),
        ("Data Source=(DESCRIPTION=(ADDRESS=(HOST=h))(CONNECT_DATA=(SERVICE_NAME = s )));User Id=u;Password=p", ("h/s", "u", True, [], "ok")),
        ("Data Source=(HOST=h);User Id=u;Password=p", (None, "u", True, [], "descriptor needs HOST and SERVICE_NAME")),
        ("Data Source=x;Password=", (None, None, False, ["USER ID", "PASSWORD"], "incomplete")),
        ("junk", (None, None, False, ["DATA SOURCE", "USER ID", "PASSWORD"], "incomplete")),
    ],
)
def test_connection_strings(spark, text, expected):
    df = spark.createDataFrame([("r", text)], "repo string, connection_string string")
    row = cfg.connection_inventory(df).select("endpoint", "user", "has_password", "missing", "status").collect()[0]
    assert tuple(row) == expected


FULL = "Data Source=h:1/s;User Id=u;Password=p"
SECRETS = [("store", "db", FULL), ("store", "bad", "Data Source=h")]


@pytest.mark.parametrize(
    "settings, source, status, missing",
    [
        ({"ORACLE_CONNECTION_STRING": FULL, "ORACLE_HOST": "x"}, "string", "ok", []),
        ({"ORACLE_CONNECTION_STRING": "Data Source=h", "ORACLE_HOST": "x", "ORACLE_USERNAME": "u", "ORACLE_PASSWORD": "p"}, "string", "incomplete", ["USER ID", "PASSWORD"]),
        ({"ORACLE_CONNECTION_STRING": "", "ORACLE_HOST": "h:1/s", "ORACLE_USERNAME": "u", "ORACLE_PASSWORD": "p"}, "host", "ok", []),
        ({"ORACLE_HOST": "h", "ORACLE_USERNAME": "u", "ORACLE_USER_SECRETS_ID": "store", "ORACLE_SECRET_NAME": "db"}, "host", "incomplete", ["ORACLE_PASSWORD"]),
        ({"ORACLE_USER_SECRETS_ID": "store", "ORACLE_SECRET_NAME": "db"}, "secret", "ok", []),
        ({"ORACLE_USER_SECRETS_ID": "store", "ORACLE_SECRET_NAME": "bad"}, "secret", "incomplete", ["USER ID", "PASSWORD"]),
        ({"ORACLE_USER_SECRETS_ID": "store", "ORACLE_SECRET_NAME": "no"}, "secret", "no such secret", []),
        ({"ORACLE_USER_SECRETS_ID": "gone", "ORACLE_SECRET_NAME": "db"}, "secret", "no such secret store", []),
        ({"ORACLE_SECRET_NAME": "db"}, "secret", "incomplete", ["ORACLE_USER_SECRETS_ID"]),
        ({"ORACLE_USERNAME": "u", "OTHER": "x"}, None, None, None),
    ],
)
def test_first_begun_source_decides(spark, settings, source, status, missing):
    config = spark.createDataFrame([("r", k, v) for k, v in settings.items()], "repo string, key string, value string")
    secrets = spark.createDataFrame(SECRETS, "store_id string, name string, value string")
    row = cfg.resolve_connection(config, secrets).collect()[0]
    assert (row["source"], row["status"], row["missing"]) == (source, status, missing)
    if status == "ok":
        assert (row["endpoint"], row["user"], row["has_password"]) == ("h:1/s", "u", True)
