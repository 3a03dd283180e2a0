"""The same answers as SQL, where SQL can express them over whole tables.

Not here: sharding (op1: approximate cell borders), packing (op2: tokenizer), extraction (op4: a parser),
near-duplicates (op5, op10: components), repeats (op7: suffixes), the trained classifier (op9), tokens of two
tokenizers (op11) and eigenvectors (op13).
Tests compare these with brute force.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

# Documents in the order of their hash; one is taken once more while the middle of its words lies in the budget.
_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM sources),
prefix AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total
  FROM ranked),
capped AS (SELECT *, weight * (3 * total - 4 * below) > 4 * free * source_size AS is_full FROM prefix),
level AS (
  SELECT (3 * any_value(total) - 4 * coalesce(sum(source_size) FILTER (is_full), 0)) AS top, 2 * sum(weight) FILTER (NOT is_full) AS low FROM capped),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN 2 * CAST(source_size AS DOUBLE) ELSE CAST(weight * top AS DOUBLE) / CAST(low AS DOUBLE) END AS target
  FROM capped, level),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 2) ELSE 0 END AS times,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw RANGE UNBOUNDED PRECEDING) AS through,
         sum(d.size) OVER (PARTITION BY d.source, d.draw) AS here
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (times + CASE WHEN target - times * source_size > 0 AND 2 * (target - times * source_size) >= 2 * through - here THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

_RULES = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS words FROM docs),
windows AS (
  SELECT r, i, array_to_string(words[i : i + 4], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM worded WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 5) AS t(j) GROUP BY r),
lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY r, line),
dups AS (SELECT r, sum(n - 1) AS n FROM lines GROUP BY r),
counted AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
         length(text) AS n_chars, length(regexp_replace(text, '[^\n]', '', 'g')) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_same
  FROM worded w LEFT JOIN dups d USING (r) LEFT JOIN repeats p USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 5 * n_symbols > n_words
            OR 2 * n_dup_lines > n_lines + 1 OR 2 * n_upper > n_chars OR 3 * n_same > n_words) AS kept
FROM judged
"""


def _url_sql(rounds: int = 10) -> str:
    host = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "CASE WHEN contains({0}, '://') THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    steps = ["m0 AS MATERIALIZED (SELECT kind, host, 0.15 * mass AS mass FROM seeds WHERE mass > 0)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"m{k} AS MATERIALIZED (SELECT kind, host, sum(mass) AS mass FROM (SELECT * FROM m0 UNION ALL "
            f"SELECT v.kind, v.next, 0.85 * v.share * m.mass FROM moves v JOIN m{k - 1} m USING (kind, host)) GROUP BY ALL)"
        )
    return rf"""
WITH base AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html, {rest.format("coalesce(url, '')")} AS rest FROM pages),
placed AS MATERIALIZED (SELECT r, page_id, html, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM base),
rules(verdict, rule_host, rule_path) AS (VALUES {values}),
fitting AS (
  SELECT r, verdict, rule_host || rule_path AS rule,
         row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path DESC) AS k
  FROM placed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
ruled AS MATERIALIZED (SELECT p.*, f.rule, f.verdict AS by_rule FROM placed p LEFT JOIN fitting f ON p.r = f.r AND f.k = 1),
linked AS (
  SELECT host AS src, {rest.format("url")} AS rest
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*([a-z][a-z0-9+.-]*://[^"''\s>]*)', 1)) AS url FROM placed)),
edges AS (SELECT src, dst, count(*) AS links FROM (SELECT src, {host} AS dst FROM linked) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
directed AS (SELECT 'trust' AS kind, src AS host, dst AS next, links FROM edges UNION ALL SELECT 'distrust', dst, src, links FROM edges),
moves AS MATERIALIZED (SELECT kind, host, next, links / sum(links) OVER (PARTITION BY kind, host) AS share FROM directed),
seeds AS MATERIALIZED (
  SELECT 'trust' AS kind, host, CAST(count(*) FILTER (by_rule = 'allow') AS DOUBLE) AS mass FROM ruled WHERE rule IS NOT NULL GROUP BY host
  UNION ALL SELECT 'distrust', host, CAST(count(*) FILTER (by_rule = 'block') AS DOUBLE) FROM ruled WHERE rule IS NOT NULL GROUP BY host),
{", ".join(steps)},
bad AS (
  SELECT host FROM m{rounds} GROUP BY host
  HAVING coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > 2 * coalesce(sum(mass) FILTER (kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' END, 'allow') AS verdict FROM ruled
"""


_COPIES = r"""
WITH shaped AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
placed AS (
  SELECT doc_id, body, min(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS n, row_number() OVER w AS k
  FROM shaped WINDOW w AS (PARTITION BY body ORDER BY doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, k = 1 AS kept, sha256(body) AS text_sha256 FROM placed
"""


ORACLES: dict[str, str] = {"op3_source_mixing": _MIXING, "op6_url_filters": _url_sql(), "op8_quality_rules": _RULES, "op12_exact_dedup": _COPIES}
