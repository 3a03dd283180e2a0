"""The expected answer of each registered query as SQL over the same tables.

Where a query's text is rendered from columns, the SQL works on those columns and never
parses the rendered text. Queries over real text repeat the pattern.
"""

from __future__ import annotations

from siftwork.functions.text import SPACE_CHARS, TIMESTAMP
from siftwork.plans.views import NAMESPACES

# --- shared pieces --------------------------------------------------------------------------

WORDS = "['mismatch','missing','unused','overflow','cycle'][l_partkey % 5 + 1]"
LETTER = "['a','b','c','d','e','f','g','h'][(l_partkey // 5) % 8 + 1]"
CODE = "CASE WHEN l_partkey % 4 = 0 THEN 'IDE0005' ELSE 'TS' || (l_suppkey % 7) END"
BUILD_LINE = (
    f"CASE WHEN l_returnflag = 'R' THEN 'src/f' || l_partkey || '.ts(' || l_linenumber || ',5): error ' || {CODE} || ': ' || {WORDS} || ' ' || {LETTER} "
    f"WHEN l_returnflag = 'A' THEN 'warning: ' || {WORDS} || ' in f' || l_partkey ELSE 'compiled f' || l_partkey END"
)
BUILD_PATTERN = (
    "CASE WHEN l_returnflag = 'R' THEN "
    f"CASE WHEN l_partkey % 4 = 0 THEN 'IDE ' ELSE 'TS ' END || {WORDS} || ' ' || {LETTER} ELSE {WORDS} END"
)
BUILD_CLASS = "CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'other' END"
LINE_NO = "((l_orderkey * 8 + l_linenumber) * 268435456 + l_partkey)"


def build_exit(run: str) -> str:
    return f"SELECT {run} AS run_id, greatest(max((l_returnflag = 'R')::INT), ({run} % 10 = 0)::INT) AS exit_code FROM lineitem GROUP BY {run}"


def build_counts(run: str) -> str:
    return f"""
        SELECT {run} AS run_id,
               count(*) FILTER (l_returnflag = 'R') AS error_lines,
               count(DISTINCT {BUILD_PATTERN}) FILTER (l_returnflag = 'R') AS error_patterns,
               count(*) FILTER (l_returnflag = 'A') AS warning_lines,
               count(DISTINCT {BUILD_PATTERN}) FILTER (l_returnflag = 'A') AS warning_patterns
        FROM lineitem GROUP BY {run}"""


BUILD_STATUS = """CASE WHEN error_lines + warning_lines > 0 THEN 'issues found' WHEN exit_code = 0 THEN 'build clean'
    ELSE 'non-zero exit, no recognizable error lines' END"""

TEST_COUNTS = """
    SELECT o_custkey AS run_id, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS bad,
           count(*) FILTER (o_orderstatus = 'P') AS skip
    FROM orders GROUP BY o_custkey"""
TEST_TOTALS = f"""
    SELECT run_id, (bad > 0)::INT AS exit_code,
           CASE WHEN run_id % 7 < 6 THEN ok END AS passed, CASE WHEN run_id % 7 < 6 THEN bad END AS failed,
           CASE WHEN run_id % 7 < 6 THEN skip END AS skipped, CASE WHEN run_id % 7 < 6 THEN ok + bad + skip END AS total,
           ['dotnet','dotnet-mtp','vstest x2 assemblies','jest','unittest','pytest',NULL][run_id % 7 + 1] AS format
    FROM ({TEST_COUNTS})"""
# A failing case per open order; a unittest result line that says FAILED is one more.
TEST_FAILURES = f"""
    SELECT o_custkey AS run_id, o_orderkey AS line_no, o_orderpriority AS pattern,
           't' || o_orderkey || '.py::' || o_orderpriority || ' FAILED' AS line
    FROM orders WHERE o_orderstatus = 'O'
    UNION ALL
    SELECT run_id, 1125899906842624, 'result', 'FAILED (failures=' || bad || ', skipped=' || skip || ')' FROM ({TEST_COUNTS}) WHERE run_id % 7 = 4 AND bad > 0"""

TRACKED = "p_partkey % 10 NOT IN (3, 9)"
SOURCE_PATH = (
    "['src','lib','src','node_modules','src','lib','src','lib','src','.cache'][p_partkey % 10 + 1]"
    " || '/m' || p_partkey || ['.py','.ts','.md'][p_partkey % 3 + 1]"
)
MARKER = "['TODO','FIXME','HACK','XXX'][(doc_id + line_no) % 7 + 1]"
BLANKS = "(" + " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS) + ")"
DOC_LINES = "SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"
MARKERS = f"""
    SELECT source AS repo, 'docs/' || doc_id || '.txt' AS path, line_no, {MARKER} AS marker, trim(line, {BLANKS}) AS text
    FROM ({DOC_LINES}) WHERE (doc_id + line_no) % 7 < 4"""

PART_NAME = "replace(p_name, ' ', '-')"
DEPENDENCIES = {
    "package.json": f"""
        SELECT 'repo-' || p_partkey AS repo, 'package.json' AS manifest, pos, section, name, version FROM (
            SELECT p_partkey, 1::BIGINT AS pos, 'dependencies' AS section, {PART_NAME} AS name, '^' || p_size || '.0.0' AS version FROM part
            UNION ALL SELECT p_partkey, 2, 'devDependencies', 'jest-' || p_partkey, '29.0' FROM part)
        WHERE p_partkey % 11 <> 0""",
    "requirements.txt": f"""
        SELECT 'repo-' || p_partkey AS repo, 'requirements.txt' AS manifest, pos, 'requirements' AS section, name, version FROM (
            SELECT p_partkey, 1::BIGINT AS pos, {PART_NAME} AS name, '==' || p_size || '.1' AS version FROM part
            UNION ALL SELECT p_partkey, 2, 'plain-' || p_partkey, '' FROM part)""",
    "csproj": """
        SELECT 'repo-' || p_partkey AS repo, 'App' || p_partkey || '.csproj' AS manifest, 1::BIGINT AS pos, 'PackageReference' AS section,
               'Lib.' || p_partkey AS name, p_size || '.0.1' AS version FROM part""",
}

DIFF_LINES = """
    SELECT l_orderkey AS repo, 'src/' || l_partkey || '.py' AS path,
           CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity::BIGINT END AS added,
           CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber::BIGINT END AS deleted
    FROM lineitem WHERE l_linenumber <> 7"""
NEWEST = """
    SELECT o_custkey AS repo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank,
           o_orderkey AS commit_id, o_orderpriority AS subject
    FROM orders QUALIFY rank <= 5"""


def project(k: str) -> str:
    return f"'P' || lpad(({k})::VARCHAR, 10, '0') || '.' || ['Utility','DB','Orders','WebApi'][({k}) % 4 + 1]"


def repo(k: str) -> str:
    return f"'repo-' || ({k} // 50)"


LINKS = """
    SELECT s_suppkey AS k, s_suppkey + 1 AS t, 0::BIGINT AS place FROM supplier WHERE s_suppkey % 5 < 4
    UNION ALL SELECT s_suppkey, s_suppkey - 4, 1 FROM supplier WHERE s_suppkey % 10 = 4
    UNION ALL SELECT s_suppkey, s_suppkey + 7, 2 FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT s_suppkey, s_suppkey + 1, 3 FROM supplier WHERE s_suppkey % 5 < 4"""
NUMBERED_LINKS = f"SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY place) - 1 AS pos FROM ({LINKS})"
KNOWN_EDGES = f"SELECT k, t, min(pos) AS pos FROM ({NUMBERED_LINKS}) SEMI JOIN supplier ON t = s_suppkey AND t // 50 = k // 50 GROUP BY k, t"
BLOCKS = "SELECT s_suppkey AS k, s_suppkey // 10 * 10 AS first FROM supplier WHERE s_suppkey % 10 < 5"

BROKEN_LOGS = "SELECT l_orderkey % 6 AS run_id, 'P_' || l_suppkey || CASE l_linestatus WHEN 'F' THEN '_net8.0_' ELSE '_net9.0_' END || l_suppkey || '.sarif' AS file_name FROM lineitem WHERE l_orderkey % 6 = 3 AND l_quantity = 50"
DIAGNOSTICS = """
    SELECT DISTINCT l_orderkey % 6 AS run_id, 'src/f' || l_partkey || '.cs' AS path,
           unnest(generate_series(l_linenumber::BIGINT, l_linenumber + l_partkey % 3)) AS line_no,
           'P_' || l_suppkey AS project, CASE l_linestatus WHEN 'F' THEN 'net8.0' ELSE 'net9.0' END AS tfm, l_partkey AS part
    FROM lineitem
    WHERE l_partkey % 13 <> 0 AND l_quantity <> 1 AND NOT (l_returnflag = 'A' AND l_linenumber = 1)
      AND l_orderkey % 6 < 4 AND NOT (l_orderkey % 6 = 3 AND l_quantity = 50)"""
CONTEXTS = "SELECT DISTINCT l_orderkey % 6 AS run_id, 'P_' || l_suppkey || '_' || l_suppkey AS project, CASE l_linestatus WHEN 'F' THEN 'net8.0' ELSE 'net9.0' END AS tfm FROM lineitem WHERE l_orderkey % 6 <> 4"
REMOVABLE = f"""
    SELECT run_id, path, line_no, part, CASE WHEN bool_and(flagged = compiled) THEN 'removable' ELSE 'partial' END AS status
    FROM (SELECT run_id, path, line_no, part, project || substr(project, 2) AS project, count(*) AS flagged FROM ({DIAGNOSTICS}) GROUP BY ALL)
    JOIN (SELECT run_id, project, count(*) AS compiled FROM ({CONTEXTS}) GROUP BY run_id, project) USING (run_id, project)
    GROUP BY run_id, path, line_no, part"""
DIRECTIVES = f"""
    SELECT run_id, path, line_no, status, part, 'using N' || line_no || '.P' || part || ';' AS line
    FROM ({REMOVABLE}) WHERE line_no <= 12 AND (part + line_no + run_id) % 3 <> 0"""
PRUNED = f"""
    SELECT run_id, path, status, count(*) AS lines FROM ({DIRECTIVES}) JOIN part ON p_partkey = part
    WHERE run_id <> 2 AND run_id NOT IN (SELECT run_id FROM ({BROKEN_LOGS})) GROUP BY run_id, path, status"""

RENAME_PATH = "'src/Old/f' || p_partkey || ['.cs','.cs','.csproj','.json','.cs'][p_partkey % 5 + 1]"
MOVED = "(p_partkey % 10 < 2 OR p_partkey % 50 = 3)"
MOVED_PATH = "'src/New/Sub/f' || p_partkey || ['.cs','.cs','.csproj','.json','.cs'][p_partkey % 5 + 1]"


def rename_text(old: str, deep: str, new: str, header_folder: str) -> str:
    """The rendered contents as bytes (hex), with the given names in the places that change."""
    crlf = "chr(13) || chr(10)"
    code = f"'using {old}.P' || p_partkey || ';' || {crlf} || 'namespace {deep}.X;' || {crlf} || '// caf' || chr(233) || {crlf}"
    header = f"'// ' || {header_folder} || '/f' || p_partkey || '.cs' || {crlf}"
    text = f"""CASE p_partkey % 5
        WHEN 0 THEN {header} || {code}
        WHEN 1 THEN chr(65279) || {header} || {code}
        WHEN 2 THEN '<RootNamespace>{old}</RootNamespace>' || chr(10) || '<AssemblyName>Kiln.Clay</AssemblyName>' || chr(10) || p_partkey
        WHEN 3 THEN 'Include="..\\Kiln.Clay\\Kiln.Clay.csproj" Kiln.Claypit Shop.Kiln.Clay.X ' || p_partkey
        ELSE 'using {new}; using {old}; using {deep};' || p_partkey END"""
    return f"CASE WHEN p_partkey % 25 = 3 THEN 'FFFE' ELSE '' END || hex(encode({text}))"


AFTER = ("Kiln.Glaze", "Kiln.Shards", "Kiln.Enamel")
BEFORE = ("Kiln.Clay", "Kiln.Clay.Deep", "Kiln.Glaze")
HEADER_MOVED = f"CASE WHEN {MOVED} THEN 'src/New/Sub' ELSE 'src/Old' END"
HITS = "CASE WHEN p_partkey % 25 = 3 THEN 0 ELSE [2, 2, 1, 0, 3][p_partkey % 5 + 1] END::BIGINT"
PLAN = f"""
    SELECT 'main' AS repo, {RENAME_PATH} AS src, CASE WHEN {MOVED} THEN {MOVED_PATH} ELSE {RENAME_PATH} END AS dst,
           {rename_text(*AFTER, HEADER_MOVED)} AS content, {HITS} AS replacements,
           {MOVED} AND p_partkey % 5 < 2 AS header_updated, p_partkey % 25 = 3 AS unreadable
    FROM part WHERE {MOVED} OR p_partkey % 25 = 3 OR {HITS} > 0"""

# Per region: whether the part's repository renames, whether this very file is moved.
REGION = "(p_partkey % 6)"
RENAMES = f"{REGION} IN (0, 1, 4)"
REGION_MOVED = f"(p_partkey = {REGION} AND {REGION} IN (0, 1, 2, 4) AND p_partkey % 5 IN (0, 1, 4))"
REGION_HITS = f"CASE WHEN {RENAMES} THEN {HITS} ELSE 0 END"
REGION_HEADER = f"CASE WHEN {REGION_MOVED} THEN 'src/New' ELSE 'src/Old' END"


def region_name(new: str, old: str) -> str:
    """A name inside a text literal: the region's new one, or the old one where nothing is renamed."""
    return f"' || CASE WHEN {RENAMES} THEN {new} ELSE '{old}' END || '"


REGION_TEXT = rename_text(
    region_name(f"'Region' || {REGION} || '.Old'", "Kiln.Clay"),
    region_name(f"'Deep' || {REGION}", "Kiln.Clay.Deep"),
    region_name("'Kiln.Clay'", "Kiln.Glaze"),
    REGION_HEADER,
)
REGION_PLAN = f"""
    SELECT 'region-' || {REGION} AS repo, {RENAME_PATH} AS src,
           CASE WHEN {REGION_MOVED} THEN 'src/New/f' || p_partkey || '.cs' ELSE {RENAME_PATH} END AS dst,
           {REGION_TEXT} AS content, {REGION_HITS} AS replacements, {REGION_MOVED} AND p_partkey % 5 < 2 AS header_updated,
           p_partkey % 25 = 3 AS unreadable
    FROM part WHERE {REGION_MOVED} OR p_partkey % 25 = 3 OR {REGION_HITS} > 0"""

# Per part: the same with a map of its own, which moves the part's own file.
PART_RENAMES, PART_MOVED = "p_partkey % 4 < 2", "p_partkey % 4 < 3"
PART_MOVED_PATH = "'src/New/f' || p_partkey || ['.cs','.cs','.csproj','.json','.cs'][p_partkey % 5 + 1]"
PART_HITS = f"CASE WHEN {PART_RENAMES} THEN {HITS} ELSE 0 END"


def part_name(new: str, old: str) -> str:
    return f"' || CASE WHEN {PART_RENAMES} THEN {new} ELSE '{old}' END || '"


PART_TEXT = rename_text(
    part_name("'Part' || p_partkey || '.Old'", "Kiln.Clay"),
    part_name("'Deep' || p_partkey", "Kiln.Clay.Deep"),
    part_name("'Kiln.Clay'", "Kiln.Glaze"),
    f"CASE WHEN {PART_MOVED} THEN 'src/New' ELSE 'src/Old' END",
)
PART_PLAN = f"""
    SELECT 'part-' || p_partkey AS repo, {RENAME_PATH} AS src, CASE WHEN {PART_MOVED} THEN {PART_MOVED_PATH} ELSE {RENAME_PATH} END AS dst,
           {PART_TEXT} AS content, {PART_HITS} AS replacements, {PART_MOVED} AND p_partkey % 5 < 2 AS header_updated,
           p_partkey % 25 = 3 AS unreadable
    FROM part WHERE {PART_MOVED} OR p_partkey % 25 = 3 OR {PART_HITS} > 0"""
FAULTY = """
    SELECT p_partkey, CASE WHEN p_partkey % 7 = 1 THEN 'src/gone' || p_partkey || '.cs' ELSE 'src/f' || p_partkey || '.cs' END AS src,
           CASE p_partkey % 7 WHEN 2 THEN 'src/f' || (p_partkey - p_partkey % 14) || '.cs' WHEN 3 THEN 'new/shared' || (p_partkey // 14) || '.cs'
                ELSE 'new/f' || p_partkey || '.cs' END AS dst
    FROM part"""

SIZES = """
    SELECT 'T' || p_partkey AS table_name, coalesce(sum(bytes), 0)::BIGINT AS segment_size_bytes, p_size::BIGINT AS num_rows, p_type AS last_analyzed
    FROM part LEFT JOIN (SELECT l_partkey, l_quantity::BIGINT AS bytes FROM lineitem WHERE l_returnflag IN ('R', 'N') AND l_partkey % 5 <> 0)
         ON l_partkey = p_partkey
    GROUP BY p_partkey, p_size, p_type"""
COLUMNS = """
    SELECT 'T' || l_orderkey AS table_name, l_linenumber::BIGINT * 1000000000 + l_partkey AS column_id, 'C' || l_partkey AS column_name,
           CASE l_returnflag WHEN 'R' THEN 'NUMBER' ELSE 'VARCHAR2' END AS data_type, CASE l_linestatus WHEN 'O' THEN 'Y' ELSE 'N' END AS nullable
    FROM lineitem"""
BALANCE = "floor(c_acctbal)::BIGINT"
SQL_AREA = f"""
    SELECT c_custkey AS sql_id, c_custkey % 13 AS executions, {BALANCE} * 3 + c_custkey AS buffer_gets, (c_custkey * 7919) % 100003 AS disk_reads,
           ({BALANCE} * 1000 + c_custkey) / 1000000.0::DOUBLE AS cpu_seconds, ({BALANCE} * 500000 + c_custkey) / 1000000.0::DOUBLE AS elapsed_seconds
    FROM customer"""

# What a customer's settings file and environment say, by key.
FILE_ENTRIES = """
    SELECT c_custkey AS repo, 'file' AS layer, key, base + shift AS line_no, value FROM (
        SELECT c_custkey, 'MODE' AS key, 6 AS base, 0 AS shift, c_mktsegment AS value FROM customer
        UNION ALL SELECT c_custkey, 'EMPTY', 7, 0, '' FROM customer
        UNION ALL SELECT c_custkey, 'ORACLE_CONNECTION_STRING', 7, 1,
            'Data Source=(DESCRIPTION=(ADDRESS=(PROTOCOL=TCP)(HOST = h' || c_custkey || ')(PORT=1521))(CONNECT_DATA=(SERVICE_NAME=s' || c_custkey
            || ')));User  Id=u' || c_custkey || ';Password=p=' || c_custkey || ';' FROM customer WHERE c_custkey % 8 = 0
        UNION ALL SELECT c_custkey, 'ORACLE_HOST', 7, 2, 'later' FROM customer WHERE c_custkey % 8 = 0
        UNION ALL SELECT c_custkey, 'ORACLE_CONNECTION_STRING', 7, 1, 'data source=h:1/s;Password=x' FROM customer WHERE c_custkey % 8 = 1
        UNION ALL SELECT c_custkey, 'ORACLE_HOST', 7, 1, 'h' || c_custkey || ':1521/svc' FROM customer WHERE c_custkey % 8 = 2
        UNION ALL SELECT c_custkey, 'ORACLE_USERNAME', 7, 2, 'u' || c_custkey FROM customer WHERE c_custkey % 8 = 2
        UNION ALL SELECT c_custkey, 'ORACLE_PASSWORD', 7, 3, 'secret' FROM customer WHERE c_custkey % 8 = 2
        UNION ALL SELECT c_custkey, 'ORACLE_HOST', 7, 1, 'h' || c_custkey FROM customer WHERE c_custkey % 8 = 3
        UNION ALL SELECT c_custkey, 'ORACLE_USERNAME', 7, 2, 'u' FROM customer WHERE c_custkey % 8 = 3
        UNION ALL SELECT c_custkey, 'ORACLE_USER_SECRETS_ID', 7, 1, 'store' || (c_custkey % 3) FROM customer WHERE c_custkey % 8 = 4
        UNION ALL SELECT c_custkey, 'ORACLE_SECRET_NAME', 7, 2, 'db' FROM customer WHERE c_custkey % 8 = 4
        UNION ALL SELECT c_custkey, 'ORACLE_USER_SECRETS_ID', 7, 1, 'store' || c_custkey FROM customer WHERE c_custkey % 8 = 5
        UNION ALL SELECT c_custkey, 'ORACLE_USER_SECRETS_ID', 7, 1, 'store0' FROM customer WHERE c_custkey % 8 = 6
        UNION ALL SELECT c_custkey, 'ORACLE_SECRET_NAME', 7, 2, 'other' FROM customer WHERE c_custkey % 8 = 6)"""
ENTRIES = f"""
    SELECT repo, layer, key, line_no::BIGINT AS line_no, value FROM ({FILE_ENTRIES})
    UNION ALL SELECT c_custkey, 'real', 'REGION', 1, 'n' || c_nationkey FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'real', 'MODE', 2, 'real' FROM customer WHERE c_custkey % 6 = 0"""
EFFECTIVE = f"""
    SELECT repo, key, arg_min(value, layer <> 'real') AS value, arg_min(layer, layer <> 'real') AS layer FROM ({ENTRIES}) GROUP BY repo, key"""
MODE = "CASE WHEN c_custkey % 6 = 0 THEN 'real' ELSE c_mktsegment END"
PLACEHOLDERS = f"""
    SELECT c_custkey AS repo, 't' AS template, pos::BIGINT AS pos, name, value, status FROM (
        SELECT c_custkey, 1 AS pos, 'MODE' AS name, {MODE} AS value, 'set' AS status FROM customer
        UNION ALL SELECT c_custkey, 2, 'REGION', 'n' || c_nationkey, 'set' FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 3, 'EMPTY', '', 'default' FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT c_custkey, 2, 'REGION', NULL, 'unresolved' FROM customer WHERE c_custkey % 2 = 1
        UNION ALL SELECT c_custkey, 3, 'MODE', {MODE}, 'set' FROM customer WHERE c_custkey % 2 = 1)"""

GOOD_VERSIONS = """
    SELECT o_custkey AS repo, max(o_orderkey) FILTER (o_orderstatus = 'F') AS good_version,
           CASE WHEN good_version IS NOT NULL THEN 'ORACLE_HOST=h' || good_version || E'\\nORACLE_USERNAME=u\\nORACLE_PASSWORD=p\\n' END AS text,
           max(o_orderkey) AS latest_version,
           ['incomplete ORACLE_PASSWORD', 'no connection configured', NULL]
               [CASE arg_max(o_orderstatus, o_orderkey) WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END] AS latest_error
    FROM orders GROUP BY o_custkey"""

REPLY_STATUS = """
    SELECT conv_id || '-' || turn AS id, text,
           ['draft','draft','unexpected','unauthorized','unauthorized','error','unavailable','unexpected'][(conv_id + turn) % 8 + 1] AS status,
           (conv_id + turn) % 8 AS kind
    FROM conversations WHERE role = 'assistant'"""


def capped(text: str, limit: int) -> str:
    return (
        f"CASE WHEN length({text}) > {limit} THEN left({text}, {limit}) || E'\\n...[troncato, ' || (length({text}) - {limit})"
        f" || ' caratteri omessi]' ELSE {text} END"
    )


def request_body(system: str) -> str:
    """A request as JSON text, built by string escaping alone."""
    escaped = "substr(to_json(text)::VARCHAR, 1)"
    lead = f'{{"role":"system","content":"{system}"}},' if system else ""
    return (
        "SELECT conv_id || '-' || turn AS id, "
        f"'{{\"model\":\"small-model\",\"messages\":[{lead}{{\"role\":\"user\",\"content\":' || {escaped} || '}}]}}' AS body "
        "FROM conversations WHERE role = 'user'"
    )


def secret_scan() -> str:
    """Each kind's shape over every line of every text, written anew from the planted kinds and the public formats."""
    kinds = {
        "aws_access_key": (4, r"\b(A[KS]IA[A-Z0-9]{16})\b"),
        "github_token": (4, r"\b(gh[opsu]_[0-9a-zA-Z]{36}|github_pat_\w{40,})\b"),
        "google_api_key": (4, r"\b(AIza[\w-]{35})"),
        "slack_token": (4, r"\b(xox[a-bprs]-[\w-]{10,})"),
        "stripe_key": (8, r"\b([rs]k_live_[0-9a-zA-Z]{16,})"),
        "private_key": (10, r"(-----BEGIN (?:[0-9A-Z]+ )*PRIVATE KEY-----)"),
        "jwt": (3, r"\b(eyJ[\w-]{8,}[.]eyJ[\w-]{8,}[.][\w-]{8,})"),
        "url_password": (0, r"://[^\s:/@]+:([^\s@/]{3,})@"),
        "connection_password": (0, r"(?i);\s*(?:pwd|password)\s*=\s*([^\s;()'\"]{3,})(?:$|[\"';])"),
        "assigned_secret": (0, r"(?i)(?:(?:access|api)[-_]?key|auth[-_]?token|secret|token|pwd|passw(?:or)?d)['\"]?\s*[=:]\s*['\"]([^'\"\s]{8,})['\"]"),
    }
    parts = []
    for kind, (shown, pattern) in kinds.items():
        literal = pattern.replace("'", "''")
        found = f"regexp_extract_all(line, '{literal}', 1)"
        parts.append(f"SELECT doc_id, line_no, '{kind}' AS rule, {shown} AS shown, unnest({found}) AS value, generate_subscripts({found}, 1) AS nth FROM ({DOC_LINES})")
    union = " UNION ALL ".join(parts)
    return f"""
        SELECT doc_id, line_no, rule, nth, CASE WHEN length(value) >= 12 THEN left(value, shown) ELSE '' END || '***' || length(value) AS masked FROM ({union})
        WHERE value <> '' AND NOT regexp_matches(lower(value), '^(<.*>|[$][{{].*|xxx*|change.?me.*|example.*|dummy.*|password)$')"""


# --- one statement per query ----------------------------------------------------------------

ORACLES: dict[str, str] = {
    "log_top_patterns": """
        SELECT 'app' AS source, row_number() OVER (ORDER BY n DESC, first_no) AS rank, n, line, pattern, first_no FROM (
            SELECT count(*) AS n, min(event_id) AS first_no, '# ' || upper(event_type) || ' user=# props={"k": #}' AS pattern,
                   arg_min(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || upper(event_type) || ' user=' || user_id || ' props=' || props, event_id) AS line
            FROM events GROUP BY event_type)
        QUALIFY rank <= 25""",
    "doc_top_patterns": rf"""
        SELECT lang AS source, row_number() OVER (PARTITION BY lang ORDER BY n DESC, first_no) AS rank, n, line, pattern, first_no FROM (
            SELECT lang, regexp_replace(line, '{TIMESTAMP}|\p{{Nd}}+', '#', 'g') AS pattern, count(*) AS n,
                   min(doc_id * 16777216 + line_no) AS first_no, arg_min(line, doc_id * 16777216 + line_no) AS line
            FROM ({DOC_LINES}) WHERE trim(line, {BLANKS}) <> '' GROUP BY ALL)
        QUALIFY rank <= 50""",
    "numbered_log_lines": """
        SELECT event_id // 5000 AS file, row_number() OVER (PARTITION BY event_id // 5000 ORDER BY event_id) AS line_no,
               strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || upper(event_type) || ' user=' || user_id || ' props=' || props AS line FROM events""",
    "log_window_patterns": f"""
        WITH arriving AS (
            SELECT *, least(2, floor(event_id * 3 / (SELECT max(event_id) + 1 FROM events)) + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END) AS delivery,
                   date_trunc('day', ts) AS opens FROM events),
        marks AS (
            SELECT k, date_trunc('millisecond', (SELECT max(ts) FROM arriving WHERE delivery <= k)) - INTERVAL 6 HOUR AS mark
            FROM range(3) AS t(k)),
        judged AS (SELECT a.*, coalesce(a.opens + INTERVAL 1 DAY <= m.mark, false) AS late FROM arriving a LEFT JOIN marks m ON m.k = a.delivery - 1),
        counted AS (
            SELECT opens, '# ' || upper(event_type) || ' user=# props={{"k": #}}' AS pattern, count(*) AS n, min(event_id) AS first_no,
                   arg_min(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || upper(event_type) || ' user=' || user_id || ' props=' || props, event_id) AS line
            FROM judged WHERE NOT late AND opens + INTERVAL 1 DAY <= (SELECT max(mark) FROM marks) GROUP BY opens, event_type),
        totals AS (SELECT opens, count(*) AS lines, count(*) FILTER (late) AS late FROM judged GROUP BY opens)
        SELECT 'app' AS source, strftime(opens, '%Y-%m-%d %H:%M:%S') AS window_start,
               row_number() OVER (PARTITION BY opens ORDER BY n DESC, first_no) AS rank, n, pattern, first_no, line, lines, late
        FROM counted JOIN totals USING (opens) QUALIFY rank <= 3""",
    "log_summary": """
        SELECT 'app' AS source, count(*) AS total_lines, strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS first_ts,
               strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, count(DISTINCT event_type) AS distinct_patterns
        FROM events""",
    "doc_line_dedupe": rf"""
        SELECT lang, regexp_replace(line, '\p{{Nd}}+', '#', 'g') AS pattern, count(*) AS n,
               min(doc_id * 16777216 + line_no) AS first_no, arg_min(line, doc_id * 16777216 + line_no) AS line
        FROM ({DOC_LINES}) WHERE trim(line, {BLANKS}) <> '' GROUP BY lang, pattern""",
    "cap_text": f"SELECT doc_id, {capped('text', 2000)} AS capped FROM documents",
    "html_to_text": rf"""
        SELECT page_id, array_to_string(list_filter(list_transform(
            regexp_split_to_array(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<[^>]+>', ' ', 'g'),
                                  '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
            lambda x: trim(x, {BLANKS})), lambda x: x <> ''), chr(10)) AS text
        FROM pages""",
    "classify_build_lines": f"SELECT l_suppkey AS run_id, {BUILD_CLASS} AS class, count(*) AS n FROM lineitem GROUP BY ALL",
    "build_top_patterns": f"""
        SELECT run_id, class, row_number() OVER (PARTITION BY run_id, class ORDER BY n DESC, first_no) AS rank, n, line FROM (
            SELECT l_suppkey AS run_id, {BUILD_CLASS} AS class, {BUILD_PATTERN} AS pattern, count(*) AS n,
                   min({LINE_NO}) AS first_no, arg_min({BUILD_LINE}, {LINE_NO}) AS line
            FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)""",
    "build_digest": f"""
        SELECT run_id, exit_code, error_lines, error_patterns, warning_lines, warning_patterns, {BUILD_STATUS} AS status,
               CASE WHEN error_lines + warning_lines = 0 AND exit_code <> 0 THEN last_lines END AS last_lines
        FROM ({build_exit('l_orderkey')}) JOIN ({build_counts('l_orderkey')}) USING (run_id)
        JOIN (SELECT run_id, string_agg(line, chr(10) ORDER BY line_no) AS last_lines FROM (
                  SELECT l_orderkey AS run_id, {LINE_NO} AS line_no, {BUILD_LINE} AS line,
                         row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_NO} DESC) AS back
                  FROM lineitem QUALIFY back <= 20) GROUP BY run_id) USING (run_id)""",
    "build_failed": f"""
        SELECT run_id, exit_code, error_lines, exit_code <> 0 AND error_lines > 0 AS failed
        FROM ({build_exit('l_orderkey')})
        JOIN (SELECT l_orderkey AS run_id, count(*) FILTER (l_returnflag = 'R' AND l_partkey % 4 <> 0) AS error_lines FROM lineitem GROUP BY 1) USING (run_id)""",
    "test_totals": TEST_TOTALS,
    "test_failure_lines": f"""
        SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, first_no) AS rank, n, line FROM (
            SELECT run_id, pattern, count(*) AS n, min(line_no) AS first_no, arg_min(line, line_no) AS line FROM ({TEST_FAILURES}) GROUP BY run_id, pattern)""",
    "test_summary_lines": f"""
        WITH c AS ({TEST_COUNTS}), h AS (SELECT *, ok // 2 AS o2, bad // 2 AS b2, skip // 2 AS s2, ok + bad + skip AS total FROM c)
        SELECT run_id, unnest(CASE run_id % 7
            WHEN 0 THEN ['Test summary: total: ' || total || ', failed: ' || bad || ', succeeded: ' || ok || ', skipped: ' || skip || ', duration: 1.1s']
            WHEN 1 THEN ['Test run summary: done', '  total: ' || total, '  failed: ' || bad, '  succeeded: ' || ok, '  skipped: ' || skip]
            WHEN 2 THEN [
                CASE WHEN b2 > 0 THEN 'Failed' ELSE 'Passed' END || '!  - Failed:     ' || b2 || ', Passed:    ' || o2 || ', Skipped:     ' || s2
                    || ', Total:    ' || (o2 + b2 + s2) || ', Duration: 1 s - A.dll (net8.0)',
                CASE WHEN bad > b2 THEN 'Failed' ELSE 'Passed' END || '!  - Failed:     ' || (bad - b2) || ', Passed:    ' || (ok - o2) || ', Skipped:     '
                    || (skip - s2) || ', Total:    ' || (total - o2 - b2 - s2) || ', Duration: 1 s - B.dll (net8.0)']
            WHEN 3 THEN ['Tests:       ' || bad || ' failed, ' || skip || ' skipped, ' || ok || ' passed, ' || total || ' total']
            WHEN 4 THEN ['Ran ' || total || ' tests in 0.5s']
            WHEN 5 THEN ['=== ' || bad || ' failed, ' || ok || ' passed, ' || skip || ' skipped, 3 warnings in 0.42s ===']
            ELSE []::VARCHAR[] END) AS line
        FROM h""",
    "test_digest": f"""
        SELECT run_id, exit_code, passed, failed, skipped, total, coalesce(failure_lines, 0) AS failure_lines,
               coalesce(failure_patterns, 0) AS failure_patterns,
               CASE WHEN failure_lines > 0 THEN 'failures' ELSE 'no failures detected' END AS status
        FROM ({TEST_TOTALS}) LEFT JOIN (
            SELECT run_id, count(*) AS failure_lines, count(DISTINCT pattern) AS failure_patterns FROM ({TEST_FAILURES}) GROUP BY run_id) USING (run_id)""",
    "file_inventory": f"SELECT p_brand AS repo, count(*) AS file_count FROM part WHERE {TRACKED} GROUP BY p_brand",
    "file_paths": f"SELECT p_brand AS repo, {SOURCE_PATH} AS path FROM part WHERE {TRACKED}",
    "walked_files": f"""
        SELECT p_brand AS repo, regexp_replace({SOURCE_PATH}, '/m([0-9]*5)\\.', '/p\\1/__init__.') AS path,
               octet_length(encode(content))::BIGINT AS n_bytes, sha256(content) AS sha256
        FROM (SELECT *, CASE
                WHEN p_partkey % 9 = 0 THEN 'def broken' || p_partkey || '(:' || chr(10)
                WHEN p_partkey % 3 = 0 THEN replace('import os|||async def load_' || p_partkey || '():|    def inner():|        pass|||class C' || p_partkey
                    || ':|    def run(self):|        pass|', '|', chr(10))
                ELSE replace('export async function run' || p_partkey || '() {{}}|  class W' || p_partkey
                    || ' {{}}|const f = () => 1;|export default function|  last' || p_partkey || '() {{}}|', '|', chr(10)) END AS content
              FROM part WHERE {TRACKED} AND p_partkey % 3 <> 2)""",
    "python_symbols": f"""
        SELECT p_brand AS repo, {SOURCE_PATH} AS path, unnest([1, 2])::BIGINT AS pos, unnest(['load_' || p_partkey, 'C' || p_partkey]) AS symbol
        FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 9 <> 0""",
    "js_symbols": f"""
        SELECT p_brand AS repo, {SOURCE_PATH} AS path, unnest([1, 2, 3])::BIGINT AS pos,
               unnest(['run' || p_partkey, 'W' || p_partkey, 'last' || p_partkey]) AS symbol
        FROM part WHERE p_partkey % 3 = 1""",
    "repo_map": f"""
        SELECT p_brand AS repo, {SOURCE_PATH} AS path,
               CASE WHEN p_partkey % 3 = 1 THEN 'run' || p_partkey || ', W' || p_partkey || ', last' || p_partkey
                    WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN 'load_' || p_partkey || ', C' || p_partkey ELSE '' END AS symbols
        FROM part WHERE {TRACKED}""",
    "todo_markers": MARKERS,
    "todo_summary": f"""
        WITH m AS ({MARKERS})
        SELECT repo, CASE marker WHEN 'FIXME' THEN 1 WHEN 'HACK' THEN 2 WHEN 'XXX' THEN 3 ELSE 4 END::BIGINT AS rank, marker,
               marker_count, repo_count, path, line_no, text
        FROM m JOIN (SELECT repo, marker, count(*) AS marker_count FROM m GROUP BY ALL) USING (repo, marker)
        JOIN (SELECT repo, count(*) AS repo_count FROM m GROUP BY repo) USING (repo)""",
    "scan_secrets": secret_scan(),
    "scan_secret_blocks": """
        WITH forms(form, line_no, last_line_no, label, closed, n_chars) AS (VALUES
            (0, 2, 7, 'RSA PRIVATE KEY', true, 128), (1, 1, NULL, 'PRIVATE KEY', false, 64), (3, 1, 1, 'EC PRIVATE KEY', true, 64),
            (4, 1, NULL, 'PRIVATE KEY', false, 64), (4, 3, 5, 'DSA PRIVATE KEY', true, 64))
        SELECT 'repo-' || p_partkey AS repo, 'keys/' || p_partkey || '.pem' AS path, CAST(line_no AS BIGINT) AS line_no,
               CAST(last_line_no AS BIGINT) AS last_line_no, label, closed, CAST(n_chars AS BIGINT) AS n_chars
        FROM part JOIN forms ON form = p_partkey % 6""",
    "scan_random_values": rf"""
        WITH quoted AS (
            SELECT doc_id, line_no, unnest(found) AS v, generate_subscripts(found, 1) AS nth
            FROM (SELECT *, regexp_extract_all(line, '[:=]\s{{0,8}}["'']([A-Za-z0-9+/=_-]{{20,}})["'']', 1) AS found FROM ({DOC_LINES}))),
        rated AS (
            SELECT *, round(list_sum(list_transform(list_distinct(string_split(v, '')), lambda c:
                -((length(v) - length(replace(v, c, ''))) / length(v)) * log2((length(v) - length(replace(v, c, ''))) / length(v)))), 6) AS bits FROM quoted)
        SELECT doc_id, line_no, nth, round(bits, 3) AS entropy, '***' || length(v) AS masked FROM rated
        WHERE (regexp_matches(v, '^([0-9a-f]{{32,}}|[0-9A-F]{{32,}})$') AND bits >= 3)
           OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AND bits >= 4)""",
    "deps_package_json": DEPENDENCIES["package.json"],
    "deps_requirements": DEPENDENCIES["requirements.txt"],
    "deps_csproj": DEPENDENCIES["csproj"],
    "list_dependencies": " UNION ALL ".join(DEPENDENCIES.values()),
    "dependency_counts": """
        SELECT 'repo-' || p_partkey AS repo, m.manifest, m.packages::BIGINT AS packages,
               CASE WHEN m.packages IS NULL THEN 'could not parse' ELSE 'ok' END AS status
        FROM (SELECT p_partkey, unnest([
                  {'manifest': 'package.json', 'packages': CASE WHEN p_partkey % 11 <> 0 THEN 2 END},
                  {'manifest': 'requirements.txt', 'packages': 2},
                  {'manifest': 'App' || p_partkey || '.csproj', 'packages': 1}]) AS m FROM part)""",
    "diff_files": DIFF_LINES,
    "diff_totals": f"""
        SELECT repo, count(path) AS files, coalesce(sum(added), 0)::BIGINT AS added, coalesce(sum(deleted), 0)::BIGINT AS deleted,
               CASE WHEN count(path) > 0 THEN 'changed' ELSE 'no changes' END AS status
        FROM (SELECT DISTINCT l_orderkey AS repo FROM lineitem) LEFT JOIN ({DIFF_LINES}) USING (repo) GROUP BY repo""",
    "diff_symbols": """
        SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY symbol) AS rank, symbol FROM (
            SELECT DISTINCT l_orderkey AS repo, unnest(['def f' || l_suppkey || '():', 'tail']) AS symbol FROM lineitem)""",
    "recent_commits": NEWEST,
    "status_report": f"""
        WITH d AS (SELECT o_custkey AS repo, count(*) AS file_count, count(*) FILTER (o_orderstatus <> 'P') AS changed_files,
                          coalesce(sum(o_orderkey % 100) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS lines_added,
                          3 * count(*) FILTER (o_orderstatus <> 'P') AS lines_deleted
                   FROM orders GROUP BY o_custkey)
        SELECT repo, file_count, commits, changed_files, lines_added, lines_deleted,
               CASE WHEN changed_files > 0 THEN 'changed' ELSE 'no changes' END AS diff_status,
               passed, failed, skipped, test_status, error_lines, warning_lines, build_status
        FROM d
        JOIN (SELECT repo, string_agg(commit_id || ' ' || subject, chr(10) ORDER BY rank) AS commits FROM ({NEWEST}) GROUP BY repo) USING (repo)
        JOIN (SELECT run_id AS repo, passed, failed, skipped,
                     CASE WHEN run_id % 7 IN (0, 1, 2, 3, 5, 6) OR bad = 0 THEN
                          CASE WHEN bad = 0 THEN 'no failures detected' ELSE 'non-zero exit, no recognizable failure lines' END
                          ELSE 'failures' END AS test_status
              FROM ({TEST_TOTALS}) JOIN ({TEST_COUNTS}) USING (run_id)) USING (repo)
        LEFT JOIN (SELECT run_id AS repo, error_lines, warning_lines, {BUILD_STATUS} AS build_status
                   FROM ({build_exit('l_suppkey')}) JOIN ({build_counts('l_suppkey')}) USING (run_id)) USING (repo)""",
    "project_names": f"SELECT repo, 'src/' || name || '/' || name || '.csproj' AS path, name FROM (SELECT {repo('s_suppkey')} AS repo, {project('s_suppkey')} AS name FROM supplier)",
    "project_edges": f"SELECT {repo('k')} AS repo, {project('k')} AS src, {project('t')} AS dst, pos FROM ({KNOWN_EDGES})",
    "dangling_references": f"""
        SELECT {repo('k')} AS repo, {project('k')} AS src, 'src/' || ({project('t')}) || '/' || ({project('t')}) || '.csproj' AS target, pos
        FROM ({NUMBERED_LINKS}) ANTI JOIN supplier ON t = s_suppkey AND t // 50 = k // 50""",
    "adjacency": f"""
        SELECT {repo('s_suppkey')} AS repo, {project('s_suppkey')} AS src, {project('t')} AS dst, count(t) OVER (PARTITION BY s_suppkey) AS targets
        FROM supplier LEFT JOIN ({KNOWN_EDGES}) ON k = s_suppkey""",
    "strong_components": f"SELECT {repo('k')} AS repo, {project('k')} AS name, {project('first')} AS component, 5::BIGINT AS size FROM ({BLOCKS})",
    "find_cycles": f"""
        SELECT repo, component, 5::BIGINT AS length, string_agg(name, ' -> ' ORDER BY k) || ' -> ' || component AS cycle
        FROM (SELECT k, {repo('k')} AS repo, {project('k')} AS name, {project('first')} AS component FROM ({BLOCKS})) GROUP BY repo, component""",
    "one_repository_components": """
        WITH k AS (SELECT s_suppkey AS k, min(s_suppkey) OVER () AS low, count(*) OVER () AS n, count(*) FILTER (s_suppkey % 2 = 0) OVER () AS even FROM supplier)
        SELECT 'one' AS repo, 'Ring' || lpad(k::VARCHAR, 9, '0') AS name, 'Ring' || lpad(low::VARCHAR, 9, '0') AS component, n AS size FROM k
        UNION ALL SELECT 'one', 'Spoke' || lpad(k::VARCHAR, 9, '0'), 'Hub', even + 1 FROM k WHERE k % 2 = 0
        UNION ALL SELECT DISTINCT 'one', 'Hub', 'Hub', even + 1 FROM k""",
    "one_repository_cycles": """
        WITH k AS (SELECT s_suppkey AS k, min(s_suppkey) OVER () AS low, max(s_suppkey) OVER () AS high, min(s_suppkey) FILTER (s_suppkey % 2 = 0) OVER () AS even FROM supplier),
        ring AS (SELECT k - low AS "at", k, low FROM k UNION ALL SELECT high - low + 1, low, low FROM k WHERE k = low)
        SELECT 'one' AS repo, 'Ring' || lpad(low::VARCHAR, 9, '0') AS component, "at", 'Ring' || lpad(k::VARCHAR, 9, '0') AS name FROM ring
        UNION ALL SELECT 'one', 'Hub', i, CASE i WHEN 1 THEN 'Spoke' || lpad(even::VARCHAR, 9, '0') ELSE 'Hub' END FROM k, range(3) AS t(i) WHERE k = low""",
    "layer_of": f"""
        SELECT {repo('s_suppkey')} AS repo, {project('s_suppkey')} AS name, CASE s_suppkey % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 END::BIGINT AS layer FROM supplier""",
    "layer_violations": f"""
        WITH e AS (SELECT {repo('k')} AS repo, {project('k')} AS src, {project('t')} AS dst, [0, 1, 2, 3][k % 4 + 1]::BIGINT AS src_level, [0, 1, 2, 3][t % 4 + 1]::BIGINT AS dst_level
                   FROM ({KNOWN_EDGES}))
        SELECT repo, src, src_level, dst, dst_level FROM e WHERE dst_level > src_level""",
    "unassigned_projects": f"SELECT {repo('s_suppkey')} AS repo, {project('s_suppkey')} AS name FROM supplier WHERE s_suppkey % 4 = 2",
    "sarif_diagnostics": f"SELECT run_id, path, line_no, project || substr(project, 2) AS project, tfm FROM ({DIAGNOSTICS})",
    "sarif_contexts": CONTEXTS,
    "unreadable_logs": BROKEN_LOGS,
    "select_removable": f"SELECT run_id, path, line_no, status FROM ({REMOVABLE})",
    "keep_directive_lines": f"SELECT run_id, path, line_no, status, line FROM ({DIRECTIVES}) SEMI JOIN part ON p_partkey = part",
    "remove_lines": f"""
        WITH f AS (SELECT run_id, path, part, line_no, (part + line_no + run_id) % 3 <> 0 AS ok FROM ({REMOVABLE}) WHERE status = 'removable'),
             g AS (SELECT run_id, path, part, coalesce(list(line_no ORDER BY line_no) FILTER (ok AND line_no <= 12), []) AS gone,
                          coalesce(list(line_no ORDER BY line_no) FILTER (NOT ok AND line_no <= 12), []) AS kept,
                          count(*) FILTER (line_no > 12) AS outside FROM f GROUP BY run_id, path, part)
        SELECT run_id, path, CASE WHEN part % 2 = 1 THEN chr(65279) ELSE '' END || array_to_string(list_transform(
                   list_filter(generate_series(1, 12), lambda i: NOT list_contains(gone, i)),
                   lambda i: CASE WHEN (part + i + run_id) % 3 <> 0 THEN 'using N' || i || '.P' || part || ';' ELSE '// note ' || i END || E'\\r\\n'), '') AS content,
               array_to_string(gone, ',') AS removed, array_to_string(kept, ',') AS skipped, outside
        FROM g JOIN part ON p_partkey = part""",
    "prune_report": PRUNED,
    "prune_status": f"""
        WITH r AS (SELECT l_orderkey % 6 AS run_id, count(*) FILTER (l_orderkey % 6 = 2 AND l_returnflag = 'R' AND l_partkey % 4 <> 0) AS error_lines FROM lineitem GROUP BY ALL),
             p AS (SELECT run_id, sum(lines)::BIGINT AS lines FROM ({PRUNED}) WHERE status = 'removable' GROUP BY run_id)
        SELECT run_id, CASE WHEN error_lines > 0 THEN 'build failed' WHEN run_id = 4 THEN 'no compilation seen'
                            WHEN run_id IN (SELECT run_id FROM ({BROKEN_LOGS})) THEN 'unreadable log'
                            WHEN lines IS NULL THEN 'nothing unnecessary' ELSE 'lines found' END AS status,
               error_lines, coalesce(lines, 0) AS lines
        FROM r LEFT JOIN p USING (run_id)""",
    "validate_moves": f"""
        WITH m AS ({FAULTY})
        SELECT 'main' AS repo, 'source missing' AS error, src AS subject, 1::BIGINT AS n FROM m WHERE p_partkey % 7 = 1
        UNION ALL SELECT 'main', 'target already exists', dst, 1 FROM m WHERE p_partkey % 7 = 2
        UNION ALL SELECT 'main', 'two moves share the target', dst, count(*) - 1 FROM m GROUP BY dst HAVING count(*) > 1
        UNION ALL SELECT 'main', 'target is also a source (chained move)', dst, 1 FROM m SEMI JOIN (SELECT src AS s FROM m) ON dst = s""",
    "rename_namespaces": f"""
        SELECT {RENAME_PATH} AS path, {rename_text(*AFTER, "'src/Old'")} AS content_hex,
               [2, 2, 1, 0, 3][p_partkey % 5 + 1]::BIGINT AS replacements FROM part""",
    "rename_by_table": f"""
        SELECT {RENAME_PATH} AS path, replace({rename_text("Kiln.Mud", "Kiln.Mud.Deep", "Kiln.Glaze", "'src/Old'")},
                   hex(encode('using Kiln.Mud.P' || p_partkey || ';')), hex(encode('using Kiln.Glaze.Q' || p_partkey || ';'))) AS content_hex,
               [2, 2, 1, 0, 2][p_partkey % 5 + 1]::BIGINT AS replacements FROM part""",
    "update_header": f"""
        SELECT {RENAME_PATH} AS path, {rename_text(*BEFORE, HEADER_MOVED)} AS content_hex, p_partkey % 5 < 2 AS changed FROM part WHERE {MOVED}""",
    "update_header_all_files": f"""
        SELECT {RENAME_PATH} AS path, {rename_text(*BEFORE, HEADER_MOVED)} AS content_hex, {MOVED} AND p_partkey % 5 < 2 AS changed FROM part""",
    "rewrite_plan": PLAN,
    "gated_rewrite_plan": f"""
        WITH p AS (SELECT *, regexp_extract(src, 'f([0-9]+)', 1)::BIGINT % 20 AS n FROM ({PLAN}))
        SELECT * EXCLUDE (n) REPLACE ('repo-' || n AS repo) FROM p
        WHERE NOT (n % 4 IN (1, 2) AND n IN (SELECT p_partkey % 20 FROM part WHERE {MOVED}))""",
    "rewrite_summary": f"""
        SELECT repo, count(*) FILTER (replacements > 0) AS files_with_replacements, sum(replacements)::BIGINT AS replacements,
               count(*) FILTER (src <> dst) AS moves, count(*) FILTER (header_updated) AS headers, count(*) FILTER (unreadable) AS unreadable
        FROM ({PLAN}) GROUP BY repo""",
    "replaced_files": f"SELECT repo, dst AS path, replacements FROM ({PLAN}) WHERE replacements > 0",
    "read_move_maps": """
        SELECT 'region-' || r_regionkey AS repo, CASE WHEN r_regionkey % 4 < 3 THEN 1::BIGINT END AS moves,
               CASE WHEN r_regionkey % 4 < 2 THEN 3::BIGINT WHEN r_regionkey % 4 = 2 THEN 0::BIGINT END AS namespaces,
               CASE WHEN r_regionkey % 4 < 3 THEN 'ok' ELSE 'cannot read map' END AS status
        FROM region""",
    "map_moves": """
        SELECT 'region-' || r_regionkey AS repo, 'src/Old/f' || r_regionkey || '.cs' AS src, 'src/New/f' || r_regionkey || '.cs' AS dst
        FROM region WHERE r_regionkey % 4 < 3""",
    "rewrite_plan_by_map": REGION_PLAN,
    "read_part_move_maps": """
        SELECT 'part-' || p_partkey AS repo, CASE WHEN p_partkey % 4 < 3 THEN 1::BIGINT END AS moves,
               CASE WHEN p_partkey % 4 < 2 THEN 3::BIGINT WHEN p_partkey % 4 = 2 THEN 0::BIGINT END AS namespaces,
               CASE WHEN p_partkey % 4 < 3 THEN 'ok' ELSE 'cannot read map' END AS status
        FROM part""",
    "map_part_moves": f"SELECT 'part-' || p_partkey AS repo, {RENAME_PATH} AS src, {PART_MOVED_PATH} AS dst FROM part WHERE {PART_MOVED}",
    "rewrite_plan_by_part_map": PART_PLAN,
    "ddl_tables": """
        SELECT 's' || s_suppkey || '.sql' AS script, 1::BIGINT AS pos, 't_' || s_suppkey AS "table", 'id, name, n_' || s_nationkey || ', PRIMARY' AS columns FROM supplier
        UNION ALL SELECT 's' || s_suppkey || '.sql', 2, 'u_' || s_suppkey, 'id' FROM supplier""",
    "list_tables": SIZES,
    "list_named_tables": f"SELECT * FROM ({SIZES}) WHERE table_name IN ('T1', 'T5', 'T17', 'NOPE')",
    "table_names": "SELECT 'T' || p_partkey AS table_name FROM part",
    "describe_table": f"SELECT column_name, data_type, nullable FROM ({COLUMNS}) WHERE table_name = 'T7'",
    "describe_tables": f"SELECT table_name, column_id, column_name || ' ' || data_type AS column_desc FROM ({COLUMNS})",
    "active_sessions": """
        SELECT o_orderkey AS sid, o_orderkey % 97 AS serial, 'U' || o_custkey AS username, 'os' || (o_orderkey % 11) AS osuser, o_orderpriority AS program,
               'ACTIVE' AS status, 'User I/O' AS wait_class, 'e' || (o_orderkey % 5) AS event, 'select ' || c_name AS sql_text
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 3 <> 0
        WHERE o_orderstatus = 'O' AND o_orderkey <> 7""",
    "top_sql_by_cpu": f"SELECT * FROM ({SQL_AREA}) ORDER BY cpu_seconds DESC, sql_id LIMIT 10",
    "top_sql_by_default": f"SELECT * FROM ({SQL_AREA}) ORDER BY elapsed_seconds DESC, sql_id LIMIT 5",
    "tablespace_usage": """
        SELECT 'TS' || n AS tablespace_name, round(total / 1048576.0::DOUBLE, 2) AS total_mb, round(free / 1048576.0::DOUBLE, 2) AS free_mb,
               round((total - free)::DOUBLE / total * 100, 2) AS used_pct
        FROM (SELECT c_nationkey AS n, sum((c_custkey % 100 + 1) * 1048576) AS total FROM customer GROUP BY 1)
        LEFT JOIN (SELECT s_nationkey AS n, sum((s_suppkey % 10) * 524288) AS free FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) USING (n)""",
    "invalid_objects": """
        SELECT ['SYS','SYSTEM','APP','HR'][o_orderkey % 4 + 1] AS owner, ['VIEW','PROCEDURE','FUNCTION'][o_orderkey % 3 + 1] AS object_type,
               'O' || o_orderkey AS object_name, 'INVALID' AS status
        FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 >= 2""",
    "snapshot_sql": """
        SELECT c_mktsegment AS segment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "env_entries": ENTRIES,
    "effective_config": EFFECTIVE,
    "resolve_placeholders": PLACEHOLDERS,
    "fill_templates": f"""
        SELECT c_custkey AS repo, 't' AS template,
               CASE WHEN c_custkey % 2 = 0 THEN 'mode: ' || {MODE} || E'\\nregion: n' || c_nationkey || E'\\nwallet: \\n' END AS text,
               c_custkey % 2 AS unresolved
        FROM customer""",
    "connection_inventory": """
        SELECT c_custkey AS repo,
               CASE WHEN c_custkey % 5 <> 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'h' || c_custkey || ':15' || (c_custkey % 10) || '/svc'
                    WHEN 1 THEN 'h' || c_custkey || '/svc' WHEN 3 THEN 'plain' || c_custkey || ':1/s' END END AS endpoint,
               CASE WHEN c_custkey % 5 <> 0 THEN 'u' || c_custkey END AS "user", true AS has_password,
               CASE WHEN c_custkey % 5 = 0 THEN 'USER ID' ELSE '' END AS missing,
               CASE WHEN c_custkey % 5 = 0 THEN 'incomplete' WHEN c_custkey % 4 = 2 THEN 'descriptor needs HOST and SERVICE_NAME' ELSE 'ok' END AS status
        FROM customer""",
    "resolve_connection": """
        SELECT c_custkey AS repo, CASE WHEN b <= 1 THEN 'string' WHEN b <= 3 THEN 'host' WHEN b <= 6 THEN 'secret' END AS source,
               CASE b WHEN 0 THEN 'h' || c_custkey || ':1521/s' || c_custkey WHEN 2 THEN 'h' || c_custkey || ':1521/svc'
                      WHEN 4 THEN CASE WHEN c_custkey % 3 = 0 THEN 'alias0' END END AS endpoint,
               CASE WHEN b IN (0, 2) THEN 'u' || c_custkey WHEN b = 3 THEN 'u' WHEN b = 4 AND c_custkey % 3 < 2 THEN 'su' END AS "user",
               CASE WHEN b < 7 THEN b IN (0, 1, 2) OR (b = 4 AND c_custkey % 3 < 2) END AS has_password,
               CASE b WHEN 1 THEN 'USER ID' WHEN 3 THEN 'ORACLE_PASSWORD' WHEN 5 THEN 'ORACLE_SECRET_NAME' WHEN 7 THEN NULL ELSE '' END AS missing,
               CASE WHEN b IN (0, 2) THEN 'ok' WHEN b IN (1, 3, 5) THEN 'incomplete' WHEN b = 6 THEN 'no such secret'
                    WHEN b = 4 THEN ['ok', 'descriptor needs HOST and SERVICE_NAME', 'no such secret'][c_custkey % 3 + 1] END AS status
        FROM (SELECT *, c_custkey % 8 AS b FROM customer)""",
    "last_good_config_stream": GOOD_VERSIONS,
    "last_good_config_table": GOOD_VERSIONS,
    "chat_results": f"""
        SELECT id, status, CASE WHEN kind < 2 THEN E'[local-model draft, verify before use]\\n' || text
                                WHEN kind = 2 THEN 'no json: ' || text WHEN kind = 7 THEN '{{"choices": []}}' END AS text
        FROM ({REPLY_STATUS})""",
    "chat_status_counts": f"SELECT status, count(*) AS n FROM ({REPLY_STATUS}) GROUP BY status",
    "chat_summarize": request_body("Summarize the following text concisely, in the same language it is written in."),
    "chat_translate": request_body("Translate the following text to German. Output only the translation."),
    "chat_classify": request_body(
        "Classify the following text into exactly one of these categories: bug, feature, question. Output only the category name."
    ),
    "chat_draft": request_body(""),
}

# The plain names answer for whole tables, as the longer ones do.
for _whole, _name in (
    ("update_header_all_files", "update_header"), ("read_part_move_maps", "read_move_maps"),
    ("map_part_moves", "map_moves"), ("rewrite_plan_by_part_map", "rewrite_plan_by_map"),
):
    ORACLES[_name] = ORACLES[_whole]
