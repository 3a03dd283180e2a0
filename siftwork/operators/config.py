"""Settings: KEY=VALUE texts, layers, placeholders, database connections.

Passwords never leave these operators; a flag says whether one is present.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as tx

# Setting names, the parts of a connection string, the placeholder form.
CONNECTION, HOST, USER, PASSWORD = (
    "ORACLE_CONNECTION_STRING", "ORACLE_HOST", "ORACLE_USERNAME", "ORACLE_PASSWORD",
)
STORE_ID, SECRET_NAME = "ORACLE_USER_SECRETS_ID", "ORACLE_SECRET_NAME"
CONNECTION_KEYS = (CONNECTION, HOST, USER, PASSWORD, STORE_ID, SECRET_NAME)
REQUIRED_PARTS = ("DATA SOURCE", "USER ID", "PASSWORD")
PLACEHOLDER = r"\$\{([A-Z_][A-Z0-9_]*)(:[^}]*)?\}"

# Layers, strongest first.
LAYERS = ("real", "file")


# --- entries and layers ---------------------------------------------------------------------


def setting_lines(text: Column) -> Column:
    """Array of (line_no, key, value) of a KEY=VALUE text, in line order, repeats included."""
    lines = F.transform(tx.text_lines(text), tx.strip)

    def entry(line: Column, i: Column) -> Column:
        at = F.instr(line, "=")
        value = tx.strip(F.substring(line, at + 1, F.length(line)))
        unquoted = F.btrim(F.btrim(value, F.lit('"')), F.lit("'"))
        return F.struct(
            (i + 1).cast("bigint").alias("line_no"), tx.strip(F.substring(line, F.lit(1), at - 1)).alias("key"),
            unquoted.alias("value"), (F.contains(line, F.lit("=")) & ~line.startswith("#")).alias("used"),
        )

    return F.filter(F.transform(lines, entry), lambda e: e["used"] & (e["key"] != ""))


def env_entries(files: DataFrame) -> DataFrame:
    """(repo, layer, line_no, key, value) from (repo, layer, text); a key's last line wins."""
    rows = files.select("repo", "layer", F.explode(setting_lines(F.col("text"))).alias("_e"))
    return rows.groupBy("repo", "layer", F.col("_e.key").alias("key")).agg(
        F.max("_e.line_no").alias("line_no"), F.max_by("_e.value", "_e.line_no").alias("value")
    )


def effective_config(entries: DataFrame, layers: Sequence[str] = LAYERS) -> DataFrame:
    """(repo, key, value, layer) with the strongest layer that sets the key."""
    rank = F.array_position(F.array(*[F.lit(name) for name in layers]), F.col("layer"))
    ranked = entries.withColumn("_rank", rank).filter(F.col("_rank") > 0)
    best = ranked.groupBy("repo", "key").agg(F.min_by(F.struct("value", "layer"), "_rank").alias("_best"))
    return best.select("repo", "key", "_best.value", "_best.layer")


# --- placeholders ---------------------------------------------------------------------------


def resolve_placeholders(templates: DataFrame, config: DataFrame) -> DataFrame:
    """Every `${NAME}` or `${NAME:default}` of (repo, template, text) with its value:
    (repo, template, pos, name, value, status), status set, default or unresolved.

    An empty setting counts as not set; a default may be empty.
    """
    hits = F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))
    found = templates.select("repo", "template", F.posexplode(hits).alias("_pos", "_hit"))
    fallback = F.regexp_extract("_hit", PLACEHOLDER, 2)
    named = found.select(
        "repo",
        "template",
        (F.col("_pos") + 1).cast("bigint").alias("pos"),
        F.regexp_extract("_hit", PLACEHOLDER, 1).alias("name"),
        F.when(fallback != "", F.substring(fallback, F.lit(2), F.length(fallback))).alias("_default"),
    )
    settings = config.filter(F.col("value") != "").select("repo", F.col("key").alias("name"), F.col("value").alias("_set"))
    status = (
        F.when(F.col("_set").isNotNull(), "set").when(F.col("_default").isNotNull(), "default").otherwise("unresolved")
    )
    return named.join(settings, ["repo", "name"], "left").select(
        "repo", "template", "pos", "name", F.coalesce("_set", "_default").alias("value"), status.alias("status")
    )


def fill_templates(templates: DataFrame, config: DataFrame) -> DataFrame:
    """(repo, template, text, unresolved): text with all placeholders filled, NULL if one cannot be."""
    values = resolve_placeholders(templates, config)
    # As many values as the template, one text, has placeholders.
    filled = values.groupBy("repo", "template").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_values"),
        F.count(F.when(F.col("status") == "unresolved", 1)).alias("unresolved"),
    )
    joined = templates.join(filled, ["repo", "template"], "left").fillna(0, ["unresolved"])
    plain = F.split("text", PLACEHOLDER)
    text = F.array_join(
        F.transform(
            plain, lambda piece, i: F.concat(piece, F.coalesce(F.try_element_at("_values", i + 1)["value"], F.lit("")))
        ),
        "",
    )
    return joined.select("repo", "template", F.when(F.col("unresolved") == 0, text).alias("text"), "unresolved")


# --- connections ----------------------------------------------------------------------------


def _descriptor_field(source: Column, field: str) -> Column:
    s = tx.SPACE
    pattern = f"(?iu)\\({s}*{field}{s}*={s}*([^){tx.SPACE_SET}]+){s}*\\)"
    return F.nullif(F.regexp_extract(source, pattern, 1), F.lit(""))


def endpoint(data_source: Column) -> Column:
    """`host:port/service` of a TNS descriptor, NULL if it lacks host or service; other sources as they are."""
    source = tx.strip(data_source)
    host, port = _descriptor_field(source, "HOST"), _descriptor_field(source, "PORT")
    service = _descriptor_field(source, "SERVICE_NAME")
    place = F.concat(host, F.coalesce(F.concat(F.lit(":"), port), F.lit("")), F.lit("/"), service)
    return F.when(source.startswith("("), place).otherwise(source)


def parse_connection(text: Column) -> Column:
    """STRUCT(endpoint, user, has_password, missing ARRAY<STRING>, status) of a `k=v;` string."""
    parts = F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit("=")))

    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        key = tx.strip(F.regexp_replace(F.substring(part, F.lit(1), at - 1), f"{tx.SPACE}+", " "))
        return F.struct(F.upper(key).alias("key"), tx.strip(F.substring(part, at + 1, F.length(part))).alias("value"))

    def read(pairs: Column) -> Column:
        def last(key: str) -> Column:
            return F.nullif(F.try_element_at(F.filter(pairs, lambda p: p["key"] == key), F.lit(-1))["value"], F.lit(""))

        return F.struct(*[last(key).alias(key) for key in REQUIRED_PARTS])

    def judge(found: Column) -> Column:
        gaps = F.array_compact(F.array(*[F.when(found[key].isNull(), key) for key in REQUIRED_PARTS]))
        place = endpoint(found["DATA SOURCE"])
        return _connection(place, found["USER ID"], found["PASSWORD"], gaps)

    return tx.bind(tx.bind(F.transform(parts, pair), read), judge)


def _connection(place: Column, user: Column, password: Column, gaps: Column) -> Column:
    complete = F.size(gaps) == 0
    status = (
        F.when(~complete, "incomplete").when(place.isNull(), "descriptor needs HOST and SERVICE_NAME").otherwise("ok")
    )
    return F.struct(
        F.when(complete, place).alias("endpoint"), user.alias("user"), password.isNotNull().alias("has_password"),
        gaps.alias("missing"), status.alias("status"),
    )


def connection_inventory(configs: DataFrame) -> DataFrame:
    """(repo, endpoint, user, has_password, missing, status) from (repo, connection_string)."""
    return configs.select("repo", parse_connection(F.col("connection_string")).alias("_c")).select("repo", "_c.*")


def connection_choice(settings: dict[str, Column], secret: Column, store_known: Column) -> Column:
    """STRUCT(source, endpoint, user, has_password, missing, status) by priority.

    A full string comes before a host, a host before a stored secret. The first source that is
    begun must be complete; a half-filled one is an error and hides the later ones.
    """
    value = {key: F.nullif(col, F.lit("")) for key, col in settings.items()}

    def absent(*keys: str) -> Column:
        return F.array_compact(F.array(*[F.when(value[key].isNull(), key) for key in keys]))

    def choice(source: str, connection: Column) -> Column:
        return tx.bind(
            connection,
            lambda c: F.struct(
                F.lit(source).alias("source"), *[c[f].alias(f) for f in ("endpoint", "user", "has_password", "missing", "status")]
            ),
        )

    def failure(text: Column, gaps: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            none.alias("endpoint"), none.alias("user"), F.lit(False).alias("has_password"),
            gaps.alias("missing"), text.alias("status"),
        )

    no_gaps = F.array().cast("array<string>")
    by_host = _connection(endpoint(value[HOST]), value[USER], value[PASSWORD], absent(USER, PASSWORD))
    half_secret = failure(F.lit("incomplete"), absent(STORE_ID, SECRET_NAME))
    no_store = failure(F.lit("no such secret store"), no_gaps)
    no_secret = failure(F.lit("no such secret"), no_gaps)
    secret_begun = value[STORE_ID].isNotNull() | value[SECRET_NAME].isNotNull()
    secret_whole = value[STORE_ID].isNotNull() & value[SECRET_NAME].isNotNull()
    return (
        F.when(value[CONNECTION].isNotNull(), choice("string", parse_connection(value[CONNECTION])))
        .when(value[HOST].isNotNull(), choice("host", by_host))
        .when(secret_begun & ~secret_whole, choice("secret", half_secret))
        .when(secret_begun & ~F.coalesce(store_known, F.lit(False)), choice("secret", no_store))
        .when(secret_begun & secret.isNull(), choice("secret", no_secret))
        .when(secret_begun, choice("secret", parse_connection(secret)))
    )


def resolve_connection(config: DataFrame, secrets: DataFrame) -> DataFrame:
    """(repo, source, endpoint, user, has_password, missing, status) per repository.

    config is (repo, key, value); secrets (store_id, name, value). Repositories that configure
    no connection have NULLs throughout.
    """
    known = [F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in CONNECTION_KEYS]
    # Most repositories name no store; a key of their own keeps them from meeting in one task.
    spread = F.coalesce(F.col(STORE_ID), F.concat(F.lit("\x00"), F.col("repo").cast("string")))
    wide = config.groupBy("repo").agg(*known).withColumn("_store", spread)
    entries = secrets.select(
        F.col("store_id").alias("_store"), F.col("name").alias(SECRET_NAME), F.col("value").alias("_secret")
    )
    stores = secrets.select(F.col("store_id").alias("_store")).distinct().withColumn("_known", F.lit(True))
    joined = wide.join(entries, ["_store", SECRET_NAME], "left").join(stores, "_store", "left")
    choice = connection_choice({key: F.col(key) for key in CONNECTION_KEYS}, F.col("_secret"), F.col("_known"))
    return joined.select("repo", choice.alias("_c")).select("repo", "_c.*")


def settings_connection(text: Column) -> Column:
    """`connection_choice` for a settings text alone, with no secret store at hand."""
    def read(entries: Column) -> Column:
        def last(key: str) -> Column:
            return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]

        return F.struct(*[last(key).alias(key) for key in CONNECTION_KEYS])

    none = F.lit(None).cast("string")
    return tx.bind(
        tx.bind(setting_lines(text), read),
        lambda s: connection_choice({key: s[key] for key in CONNECTION_KEYS}, none, F.lit(False)),
    )
