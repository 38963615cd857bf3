"""The SQL that each query is checked against, for any engine with the test tables as views."""

from __future__ import annotations

import re

from cartulary.functions import vocabulary as V
from checks.row_catalog import ROW_CATALOG_SQL
from checks.tables import (
    AS_OF,
    FOREIGN_KEYS,
    GAPPY,
    GAPPY_COLUMNS,
    GAPPY_KEYS,
    PRIMARY_KEYS,
    TABLES,
)

# The rules that apply to the test tables and their variants.
RULES = {
    "orders": (("o_totalprice", "negative"),),
    "lineitem": (("l_extendedprice", "negative"), ("l_discount", "negative")),
    "part": (("p_retailprice", "negative"),),
    "gappy_orders": (("o_totalprice", "negative"),),
    "signed_customer": (("balance_total", "negative"), ("c_name", "blank")),
    "signed_supplier": (("s_amount", "negative"),),
    "blank_turns": (("role", "blank"), ("text", "blank")),
    "rated_parts": (("size_rating", "rating"), ("price_gap", "negative")),
    "rated_lines": (("line_rating", "rating"),),
}
BROKEN = {
    "negative": "{c} < 0",
    "blank": "trim({c}) = ''",
    "rating": "{c} NOT BETWEEN 1 AND 5",
}
ISSUE = {
    "negative": "negative values found",
    "blank": "empty string values found",
    "rating": "ratings outside 1-5 range",
}


def _source(name: str) -> str:
    if name in GAPPY:
        origin, select = GAPPY[name]
        return f"(SELECT {', '.join(select)} FROM {origin})"
    return name


def _columns(name: str):
    return GAPPY_COLUMNS[name] if name in GAPPY else TABLES[name]


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _half_up(part: str, whole: str) -> str:
    """part / whole rounded to a whole number, halves up."""
    return f"((2 * ({part}) + ({whole})) // (2 * ({whole})))"


def _nulls_h(column: str) -> str:
    """Null share of a column in hundredths of a percent."""
    return _half_up(f"(count(*) - count({column})) * 10000", "count(*)")


def _facts(names) -> str:
    parts = []
    for name in names:
        keys = {**PRIMARY_KEYS, **GAPPY_KEYS}.get(name, ())
        if name in GAPPY and name not in GAPPY_KEYS:
            keys = ()
        columns, rules, src = _columns(name), RULES.get(name, ()), _source(name)
        filled = " + ".join(f"(10000 - {_nulls_h(c)})" for c, _ in columns)
        dups = "0"
        if keys:
            dups = (
                f"(SELECT count(*) FROM (SELECT 1 FROM {src} GROUP BY {', '.join(keys)} "
                "HAVING count(*) > 1))"
            )
        stamp = next((c for c, label in columns if label == "timestamp"), None)
        latest = f"max({stamp})" if stamp else "NULL"
        counts = [f"count(*) FILTER (WHERE {BROKEN[r].format(c=c)})" for c, r in rules]
        texts = [
            f"CASE WHEN {n} > 0 THEN '{c}: ' || {n} || ' {ISSUE[r]}' END"
            for n, (c, r) in zip(counts, rules)
        ]
        parts.append(
            f"SELECT '{name}' AS table_name, count(*) AS n, {len(columns)} AS column_count, "
            f"{_half_up(filled, str(len(columns)))} AS c, {dups} AS dups, "
            f"{repr(stamp) if stamp else 'NULL'} AS freshness_column, "
            f"CAST({latest} AS TIMESTAMP) AS latest, {len(rules)} AS checks, "
            f"{' + '.join(counts) or '0'} AS issue_count, "
            f"{'concat_ws(chr(59) || chr(32), ' + ', '.join(texts) + ')' if texts else repr('')}"
            f" AS issues, '{', '.join(keys)}' AS primary_keys FROM {src}"
        )
    return _union(parts)


def _quality(names) -> str:
    """WITH clause that ends in ``scored``, one row per table."""
    return f"""
facts AS ({_facts(names)}),
aged AS (
  SELECT *, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(latest)) / 86400000000.0)
         AS BIGINT) AS days
  FROM facts
),
parts AS (
  SELECT *, {_half_up('(n - dups) * 10000', 'n')} AS u,
    CASE WHEN freshness_column IS NULL THEN 7000 WHEN days IS NULL THEN 5000
         WHEN days <= 1 THEN 10000 WHEN days <= 7 THEN 8000 WHEN days <= 30 THEN 6000
         WHEN days <= 90 THEN 4000 ELSE 2000 END AS f,
    CASE WHEN checks = 0 THEN 9500 WHEN issue_count > n * checks THEN 0
         ELSE {_half_up('(n * checks - issue_count) * 10000', 'greatest(n * checks, 1)')}
    END AS v
  FROM aged
),
summed AS (
  SELECT *, ((c * 35 + u * 25 + v * 25 + f * 15 + 50) // 100) AS total FROM parts
),
scored AS (
  SELECT table_name, n AS row_count, column_count, c / 100.0 AS completeness,
    dups AS duplicate_count, u / 100.0 AS uniqueness, freshness_column, latest,
    days AS days_since_update, f / 100.0 AS freshness, CAST(checks AS BIGINT) AS checks_run,
    CAST(issue_count AS BIGINT) AS issue_count, issues, v / 100.0 AS validity,
    total / 100.0 AS overall_score, primary_keys,
    CASE WHEN total >= 9000 THEN 'A' WHEN total >= 8000 THEN 'B' WHEN total >= 7000 THEN 'C'
         WHEN total >= 6000 THEN 'D' ELSE 'F' END AS grade
  FROM summed
)
"""


ALL = tuple(TABLES)
# Where the files whose sizes are checked lie: no view over their rows knows them.
FOLDER = "/root/testdata/sf0.01"
VARIANTS = tuple(GAPPY)
NUMERIC = ("integer", "float")
SCORES = (
    "SELECT table_name, row_count, completeness, duplicate_count, uniqueness, "
    "days_since_update, freshness, checks_run, issue_count, issues, validity, overall_score, "
    "grade FROM scored"
)


def _column_facts(names) -> str:
    """One row per column with its counts."""
    parts = []
    for name in names:
        for column, label in _columns(name):
            low = high = mean = "CAST(NULL AS DOUBLE)"
            low_text = high_text = mean_text = "CAST(NULL AS VARCHAR)"
            if label in NUMERIC:
                low, high = f"min({column})", f"max({column})"
                mean = f"round(avg({column}), 2)"
                low_text, high_text, mean_text = (
                    f"CAST({x} AS VARCHAR)" for x in (low, high, mean)
                )
            parts.append(
                f"SELECT '{name}' AS table_name, '{column}' AS column_name, "
                f"'{label}' AS clean_type, count(*) AS row_count, "
                f"count(*) - count({column}) AS null_count, "
                f"{_nulls_h(column)} / 100.0 AS null_pct, "
                f"(10000 - {_nulls_h(column)}) / 100.0 AS filled_pct, "
                f"count(DISTINCT {column}) AS distinct_count, {low_text} AS min_value, "
                f"{high_text} AS max_value, {mean_text} AS avg_value, "
                f"CAST({low} AS DOUBLE) AS min_number, CAST({high} AS DOUBLE) AS max_number, "
                f"{mean} AS avg_number FROM {_source(name)}"
            )
    return _union(parts)


def _tops(names, labels, skip=()) -> str:
    """The three most frequent values of each column with one of the labels."""
    parts = []
    for name in names:
        for column, label in _columns(name):
            if label not in labels or any(word in column for word in skip):
                continue
            parts.append(
                f"SELECT '{name}' AS table_name, '{column}' AS column_name, rank, "
                f"CAST(v AS VARCHAR) AS value, freq FROM (SELECT v, freq, "
                f"row_number() OVER (ORDER BY freq DESC, v) AS rank FROM "
                f"(SELECT {column} AS v, count(*) AS freq FROM {_source(name)} "
                f"WHERE {column} IS NOT NULL GROUP BY 1)) WHERE rank <= 3"
            )
    return _union(parts)


def _lists(names, labels, skip=()) -> str:
    return (
        "SELECT table_name, column_name, string_agg(value, ' | ' ORDER BY rank) AS listed, "
        "string_agg(value, ', ' ORDER BY rank) AS shown "
        f"FROM ({_tops(names, labels, skip)}) GROUP BY 1, 2"
    )


SKIPPED = ("_id", "_at", "_date", "password", "token", "hash")
SAMPLED = ("string", "boolean", "integer")


def _fill(template: str, **values: str) -> str:
    """A prompt template as SQL text, its places filled by expressions."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece[1:-1] in values:
            parts.append(values[piece[1:-1]])
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(f"coalesce(CAST({p} AS VARCHAR), 'None')" for p in parts)


def _prompt_parts(names) -> str:
    """WITH clause with the samples, the columns in order, and all three kinds of prompts."""
    return f"""
samples AS ({_lists(names, SAMPLED, SKIPPED)}),
col AS ({_column_facts(names)}),
placed AS (
  SELECT col.*, shown,
         row_number() OVER (PARTITION BY table_name ORDER BY column_name) AS place
  FROM col LEFT JOIN samples USING (table_name, column_name)
),
lined AS (
  SELECT table_name, chr(10) || '- ' || column_name || ': ' || shown AS line,
         row_number() OVER (PARTITION BY table_name ORDER BY place) AS k
  FROM placed WHERE place <= 5 AND shown IS NOT NULL
),
lines AS (
  SELECT table_name, string_agg(line, '' ORDER BY k) AS text FROM lined WHERE k <= 3 GROUP BY 1
),
heads AS (
  SELECT table_name, max(row_count) AS row_count,
         string_agg(column_name, ', ' ORDER BY place) FILTER (WHERE place <= 10) AS first10,
         string_agg(column_name, ', ' ORDER BY place) FILTER (WHERE place <= 8) AS first8
  FROM placed GROUP BY 1
),
table_prompts AS (
  SELECT table_name, first8, {_fill(
      V.TABLE_PROMPT, table="table_name", columns="first10", rows="row_count",
      samples="coalesce(text, 'Not available')")} AS prompt
  FROM heads LEFT JOIN lines USING (table_name)
),
column_prompts AS (
  SELECT table_name, column_name, {_fill(
      V.COLUMN_PROMPT, table="table_name", column="column_name", type="clean_type",
      nullable="CASE WHEN null_pct > 0 THEN 'Yes' ELSE 'No' END",
      samples="coalesce(shown, 'Not available')")} AS prompt
  FROM placed
)
"""


RAW_TYPE_SQL = """
SELECT *, lower(trim(raw)) AS raw_type FROM (
  SELECT p_brand AS table_name, 'part_' || p_partkey AS name, p_size, p_name,
    CASE p_type
      WHEN 'STANDARD' THEN 'character varying(' || p_size || ')'
      WHEN 'SMALL' THEN ' NUMERIC(' || p_size || ', ' || (p_size % 7) || ') '
      WHEN 'MEDIUM' THEN 'timestamp(' || (p_size % 10) || ') with time zone'
      WHEN 'LARGE' THEN CASE WHEN p_size > 25 THEN 'bigint' ELSE 'double precision' END
      WHEN 'ECONOMY' THEN CASE WHEN p_size > 25 THEN 'integer[]' ELSE 'jsonb' END
      ELSE CASE WHEN p_size > 40 THEN 'numeric(x)' WHEN p_size > 20 THEN 'text'
           WHEN p_size > 10 THEN 'numeric(' || p_size || ')' ELSE 'interval' END
    END AS raw
  FROM part
)"""
CLEAN_TYPE_SQL = """
CASE split_part(raw_type, '(', 1)
  WHEN 'character varying' THEN 'string' WHEN 'numeric' THEN 'decimal'
  WHEN 'timestamp' THEN 'timestamp' WHEN 'bigint' THEN 'integer'
  WHEN 'double precision' THEN 'float' WHEN 'jsonb' THEN 'json' WHEN 'text' THEN 'text'
  ELSE 'unknown' END"""

MARKED_SQL = """
fk AS (
  SELECT l_orderkey, l_linenumber, max(l_partkey) AS target FROM lineitem GROUP BY 1, 2
),
cols AS (
  SELECT 'order_' || o_orderkey AS table_name, 0 AS ordinal, 'o_orderkey' AS column_name,
         false AS is_nullable, true AS is_primary_key, NULL AS target FROM orders
  UNION ALL
  SELECT 'order_' || l_orderkey, l_linenumber, 'line_' || l_linenumber, l_linenumber > 2,
         false, target FROM fk
)"""

FIRST_CRAWL = "o_orderdate < '1998-06-01'"
SECOND_CRAWL = "o_orderdate >= '1997-01-01'"
FIRST_LINES = "l_shipdate < '1998-06-01'"
SECOND_LINES = "l_shipdate >= '1997-01-01'"

DAILY_SQL = """
daily AS (
  SELECT strftime(ts, '%Y-%m-%d') AS run_id, min(ts) AS started_at, max(ts) AS finished_at,
         count(*) FILTER (WHERE event_type <> 'error') AS tables_crawled,
         count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS columns_crawled,
         CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'success'
              ELSE 'partial' END AS status
  FROM events GROUP BY 1
)"""

CACHE_SQL = """
cached AS (
  SELECT md5(text) AS key, min(CASE WHEN source = 'src0' THEN '' ELSE source END) AS response,
         substr(text, 1, 100) || '...' AS prompt_preview
  FROM documents WHERE lang = 'en' GROUP BY text
)"""
ANSWER = "'Text of ' || length({}) || ' characters'"


def _levels(depth: int) -> str:
    """Nodes by their distance from the start, each with its smallest path."""
    ctes = [
        "level0 AS (SELECT full_name AS node, [name] AS path FROM node "
        "WHERE label = 'Table' AND name = 'customer_3')"
    ]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM level{j}" for j in range(i))
        ctes.append(
            f"level{i} AS (SELECT dst AS node, min(list_append(path, name)) AS path "
            f"FROM level{i - 1} JOIN step ON src = level{i - 1}.node "
            "JOIN node ON full_name = dst "
            f"WHERE dst NOT IN ({seen}) GROUP BY 1)"
        )
    found = _union(
        f"SELECT path, {i} AS hops FROM level{i} WHERE node = 'rows.customer_9'"
        for i in range(1, depth + 1)
    )
    return (
        ",\n".join(ctes)
        + f"\nSELECT array_to_string(path, ' > ') AS path, CAST(hops AS BIGINT) AS hops "
        f"FROM ({found}) ORDER BY hops LIMIT 1"
    )


NODE_SQL = """
node AS (
  SELECT 'Database' AS label, 'rows' AS full_name, 'rows' AS name, NULL AS table_name,
    CAST(NULL AS BIGINT) AS row_count, CAST(NULL AS BIGINT) AS column_count,
    CAST(NULL AS DOUBLE) AS quality_score, NULL AS quality_grade, NULL AS description,
    NULL AS tags, NULL AS data_type, CAST(NULL AS BOOLEAN) AS is_nullable,
    CAST(NULL AS BOOLEAN) AS is_primary_key, CAST(NULL AS BOOLEAN) AS is_foreign_key,
    CAST(NULL AS DOUBLE) AS null_pct
  UNION ALL
  SELECT 'Table', 'rows.' || table_name, table_name, NULL, row_count, column_count,
    quality_score, quality_grade, coalesce(ai_description, ''), coalesce(ai_tags, ''),
    NULL, NULL, NULL, NULL, NULL
  FROM cat_tables
  UNION ALL
  SELECT 'Column', 'rows.' || table_name || '.' || column_name, column_name, table_name, NULL,
    NULL, NULL, NULL, '', NULL, 'integer', NOT is_primary_key, is_primary_key, is_foreign_key,
    0.0
  FROM cat_columns
)"""
EDGE_SQL = """
edge AS (
  SELECT 'CONTAINS' AS type, 'rows' AS src, 'rows.' || table_name AS dst,
         CAST(NULL AS VARCHAR) AS rel_type, CAST(NULL AS VARCHAR) AS via,
         CAST(NULL AS VARCHAR) AS join_column
  FROM cat_tables
  UNION ALL
  SELECT 'HAS_COLUMN', 'rows.' || table_name, 'rows.' || table_name || '.' || column_name,
         NULL, NULL, NULL
  FROM cat_columns
  UNION ALL
  SELECT 'REFERENCES', 'rows.' || source_table || '.' || source_column,
         'rows.' || target_table || '.' || target_column, 'foreign_key', NULL, NULL
  FROM refs
  UNION ALL
  SELECT 'RELATED_TO', 'rows.' || source_table, 'rows.' || target_table, NULL,
         source_column || ' → ' || target_column, source_column
  FROM related
)"""
STEP_SQL = """
step AS (
  SELECT src, dst FROM edge WHERE {kinds}
  UNION
  SELECT dst, src FROM edge WHERE {kinds}
)"""


def _graph(*more: str) -> str:
    return "WITH " + ",".join((ROW_CATALOG_SQL, *more))


def oracle_sql() -> dict[str, str]:
    scored = "WITH " + _quality(ALL)
    variants = "WITH " + _quality(VARIANTS)
    columns = f"WITH col AS ({_column_facts(ALL)})"
    gappy_columns = f"WITH col AS ({_column_facts(VARIANTS)})"
    rows = "WITH " + ROW_CATALOG_SQL
    raw = f"WITH raw AS ({RAW_TYPE_SQL})"

    def checks(rule):
        return _union(
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
            f"count(*) FILTER (WHERE {BROKEN[r].format(c=c)}) AS issues FROM {_source(name)}"
            for name in VARIANTS
            for c, r in RULES.get(name, ())
            if r == rule
        )

    def profile(with_clause, names):
        return (
            f"{with_clause}, tops AS ({_lists(names, ('string',))}) "
            "SELECT table_name, column_name, clean_type, row_count, null_count, null_pct, "
            "distinct_count, min_value, max_value, listed AS top_values "
            "FROM col LEFT JOIN tops USING (table_name, column_name)"
        )

    foreign_counts = _union(
        f"SELECT '{name}' AS table_name, {sum(fk[0] == name for fk in FOREIGN_KEYS)} AS k"
        for name in ALL
    )
    answered = ANSWER.format("prompt")
    descriptions = f"""WITH {_prompt_parts(ALL)}, described AS (
  SELECT table_name, first8, {answered} AS description FROM table_prompts),
asked AS (
  SELECT table_name, description, {_fill(
      V.TAGS_PROMPT, table="table_name", columns="first8", description="description")} AS prompt
  FROM described)
SELECT table_name, description, {answered} AS tags FROM asked"""
    column_descriptions = (
        f"WITH {_prompt_parts(ALL)} "
        f"SELECT table_name, column_name, {answered} AS description FROM column_prompts"
    )
    sizes = _union(f"SELECT '{n}' AS t, count(*) AS n FROM {n}" for n in ALL)
    named_columns = ", ".join(f"('{n}', '{c}')" for n in ALL for c, _ in TABLES[n])
    foreign = ", ".join(str(fk) for fk in FOREIGN_KEYS)
    return {
        "flagship_quality": f"{scored} {SCORES}",
        "gappy_quality": f"{variants} {SCORES}",
        "footer_quality": f"{scored} {SCORES}",
        "table_list": _union(
            f"SELECT '{name}' AS table_name, count(*) AS row_count, "
            f"CAST({len(TABLES[name])} AS BIGINT) AS column_count FROM {name}"
            for name in ALL
        ),
        "table_metadata": f"{scored}, fks AS ({foreign_counts}) "
        "SELECT table_name, row_count, CAST(column_count AS BIGINT) AS column_count, "
        "primary_keys, CAST(k AS BIGINT) AS foreign_key_count, overall_score, grade "
        "FROM scored JOIN fks USING (table_name)",
        "crawl_totals": "SELECT count(*) AS tables_crawled, "
        "CAST(sum(c) AS BIGINT) AS columns_crawled, CAST(0 AS BIGINT) AS error_count FROM ("
        + _union(f"SELECT {len(TABLES[n])} AS c, count(*) AS n FROM {n}" for n in ALL)
        + ")",
        "crawl_log": f"{scored} SELECT 'run-1' AS run_id, "
        "count(*) FILTER (WHERE grade <= 'A') AS tables_crawled, "
        "CAST(sum(column_count) FILTER (WHERE grade <= 'A') AS BIGINT) AS columns_crawled, "
        "CASE WHEN count(*) FILTER (WHERE grade > 'A') = 0 THEN 'success' ELSE 'partial' END "
        "AS status, string_agg(table_name || ': grade ' || grade, chr(10) ORDER BY table_name) "
        "FILTER (WHERE grade > 'A') AS error_message FROM scored",
        "latest_crawl": f"WITH {DAILY_SQL} SELECT status, tables_crawled, columns_crawled "
        "FROM daily ORDER BY started_at DESC LIMIT 1",
        "crawl_runs": f"WITH {DAILY_SQL}, closed AS (SELECT *, columns_crawled % 2 = 0 AS c FROM daily) "
        "SELECT run_id, CAST(started_at AS VARCHAR) AS started_at, "
        "CASE WHEN c THEN CAST(finished_at AS VARCHAR) END AS finished_at, "
        "CASE WHEN c THEN tables_crawled ELSE 0 END AS tables_crawled, "
        "CASE WHEN c THEN columns_crawled ELSE 0 END AS columns_crawled, "
        "CASE WHEN c THEN status ELSE 'running' END AS status FROM closed",
        "crawl_durations": f"WITH {DAILY_SQL} SELECT run_id, "
        "((epoch_us(finished_at) - epoch_us(started_at)) * 2 + 6000000) // 12000000 / 10.0 "
        "AS duration_minutes FROM daily",
        "quality_rank": f"{scored} SELECT table_name, row_count, overall_score, grade FROM scored",
        "uniqueness": f"{scored} SELECT table_name, row_count, duplicate_count, uniqueness "
        "FROM scored",
        "freshness": f"{scored} SELECT table_name, freshness_column, "
        "CAST(latest AS VARCHAR) AS latest, days_since_update, freshness FROM scored",
        "freshness_steps": "SELECT freshness, count(*) AS orders FROM (SELECT CASE "
        "WHEN d <= 1 THEN 100.0 WHEN d <= 7 THEN 80.0 WHEN d <= 30 THEN 60.0 "
        "WHEN d <= 90 THEN 40.0 ELSE 20.0 END::DOUBLE AS freshness FROM (SELECT floor("
        "(epoch_us(TIMESTAMP '2001-07-20 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0) "
        "AS d FROM orders)) GROUP BY 1",
        "completeness": f"{variants} SELECT table_name, row_count, completeness FROM scored",
        "validity_negative": checks("negative"),
        "validity_blank": checks("blank"),
        "validity_rating": checks("rating"),
        "validity_score": f"{variants} SELECT table_name, checks_run, issue_count, issues, "
        "validity FROM scored",
        "grade": "WITH s AS (SELECT CAST(round(l_quantity * 200) AS BIGINT) AS c, "
        "CAST(round(10000 - l_discount * 10000) AS BIGINT) AS u, l_linenumber * 1425 AS v, "
        "CAST(round(10000 - l_tax * 100000) AS BIGINT) AS f FROM lineitem), "
        "t AS (SELECT (c * 35 + u * 25 + v * 25 + f * 15 + 50) // 100 AS total FROM s) "
        "SELECT CASE WHEN total >= 9000 THEN 'A' WHEN total >= 8000 THEN 'B' "
        "WHEN total >= 7000 THEN 'C' WHEN total >= 6000 THEN 'D' ELSE 'F' END AS grade, "
        "count(*) AS lines, min(total) / 100.0 AS lowest, max(total) / 100.0 AS highest "
        "FROM t GROUP BY 1",
        "column_nulls": f"{gappy_columns} SELECT table_name, column_name, null_count, null_pct, "
        "filled_pct FROM col",
        "column_minmax": f"{columns} SELECT table_name, column_name, min_value, max_value, "
        "avg_value, min_number, max_number, avg_number FROM col WHERE min_number IS NOT NULL",
        "column_distinct": f"{columns} SELECT table_name, column_name, distinct_count FROM col",
        "column_topk": _tops(ALL, ("string",)),
        "column_profile": profile(columns, ALL),
        "gappy_profile": profile(gappy_columns, VARIANTS),
        "approx_distinct": f"{columns} SELECT table_name, column_name, distinct_count, true AS close "
        "FROM col",
        "incremental_profile": f"{scored}, col AS ({_column_facts(ALL)}) SELECT table_name, "
        "column_name, c.row_count, null_count, null_pct, min_number, max_number, avg_number, "
        "duplicate_count, overall_score, grade FROM col c JOIN scored USING (table_name)",
        "table_size": f"""SELECT regexp_extract(filename, '(\\w+)[.]parquet$', 1) AS table_name,
  size AS table_size_bytes FROM read_blob('{FOLDER}/*.parquet')""",
        "sample_values": "SELECT table_name, column_name, listed AS sample "
        f"FROM ({_lists(ALL, SAMPLED, SKIPPED)})",
        "type_normalize": f"{raw} SELECT name, raw_type, {CLEAN_TYPE_SQL} AS clean_type FROM raw",
        "type_params": f"""{raw}, inside AS (
  SELECT name, regexp_extract(raw_type, '\\(([^)]*)\\)', 1) AS p FROM raw)
SELECT name,
  CASE WHEN regexp_full_match(p, '[0-9]+') THEN TRY_CAST(p AS INTEGER) END AS max_length,
  CASE WHEN contains(p, ',') THEN TRY_CAST(trim(split_part(p, ',', 1)) AS INTEGER) END
    AS precision,
  CASE WHEN contains(p, ',') THEN TRY_CAST(trim(split_part(p, ',', 2)) AS INTEGER) END AS scale
FROM inside""",
        "parse_column": f"""{raw}, d AS (
  SELECT *, CASE WHEN p_size > 45 THEN '' WHEN p_size > 30 THEN p_name END AS def FROM raw)
SELECT table_name, name AS column_name, {CLEAN_TYPE_SQL} AS clean_type,
  p_size % 3 <> 2 AS is_nullable, def IS NOT NULL AS has_default,
  nullif(def, '') AS default_value FROM d""",
        "parse_fk": """
SELECT 'order_' || l_orderkey AS table_name, l_linenumber AS fk_ordinal,
  CASE WHEN l_returnflag <> 'R' THEN 'line_' || l_linenumber END AS "column",
  CASE WHEN l_linestatus = 'O' THEN 'part_' || l_partkey ELSE '' END AS references_table,
  CASE WHEN l_returnflag <> 'A' THEN 'p_partkey' END AS references_column
FROM lineitem""",
        "mark_keys": f"""WITH {MARKED_SQL}
SELECT table_name, column_name, is_primary_key, target IS NOT NULL AS is_foreign_key,
  'part_' || target AS references_table,
  CASE WHEN target IS NOT NULL THEN 'p_partkey' END AS references_column FROM cols""",
        "table_summary": f"""WITH {MARKED_SQL}
SELECT table_name, count(*) AS column_count,
  coalesce(string_agg(column_name, ', ' ORDER BY ordinal) FILTER (WHERE is_primary_key), '')
    AS primary_key_cols,
  coalesce(string_agg(column_name, ', ' ORDER BY ordinal) FILTER (WHERE is_nullable), '')
    AS nullable_cols,
  coalesce(string_agg(column_name, ', ' ORDER BY ordinal) FILTER (WHERE NOT is_nullable), '')
    AS required_cols
FROM cols GROUP BY 1""",
        "catalog_upsert": f"""WITH o AS (
  SELECT 'customer_' || o_custkey AS t, count(*) AS n, max(o_totalprice) / 5000 AS q
  FROM orders WHERE {FIRST_CRAWL} GROUP BY 1),
n AS (
  SELECT 'customer_' || o_custkey AS t, count(*) AS n, max(o_totalprice) / 5000 AS q
  FROM orders WHERE {SECOND_CRAWL} GROUP BY 1),
m AS (
  SELECT coalesce(n.t, o.t) AS table_name, coalesce(n.n, o.n) AS row_count,
    coalesce(n.q, o.q) AS quality_score, o.t AS known, n.t AS seen
  FROM o FULL JOIN n ON o.t = n.t)
SELECT table_name, row_count, quality_score,
  CASE WHEN quality_score >= 90 THEN 'A' WHEN quality_score >= 80 THEN 'B'
       WHEN quality_score >= 70 THEN 'C' WHEN quality_score >= 60 THEN 'D' ELSE 'F' END
    AS quality_grade,
  'about ' || known AS ai_description,
  CASE WHEN seen IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-02-01 00:00:00' END
    AS last_crawled_at,
  CASE WHEN known IS NULL THEN '2024-02-01 00:00:00' ELSE '2024-01-01 00:00:00' END
    AS created_at
FROM m""",
        "catalog_replace": f"""WITH o AS (
  SELECT 'order_' || l_orderkey AS t, 'line_' || l_linenumber AS c, max(l_quantity) AS q
  FROM lineitem WHERE {FIRST_LINES} GROUP BY 1, 2),
n AS (
  SELECT 'order_' || l_orderkey AS t, 'line_' || l_linenumber AS c, max(l_quantity) AS q
  FROM lineitem WHERE {SECOND_LINES} GROUP BY 1, 2)
SELECT t AS table_name, c AS column_name, q AS null_pct, t || '.' || c AS ai_description
FROM o WHERE t NOT IN (SELECT t FROM n)
UNION ALL
SELECT n.t, n.c, n.q, o.t || '.' || o.c FROM n LEFT JOIN o ON o.t = n.t AND o.c = n.c""",
        "relationship_replace": f"""WITH l AS (
  SELECT 'order_' || l_orderkey AS s,
    CASE WHEN l_returnflag <> 'R' THEN 'line_' || l_linenumber END AS c,
    CASE WHEN l_linestatus = 'O' THEN 'part_' || l_partkey ELSE '' END AS t, l_shipdate
  FROM lineitem),
o AS (SELECT DISTINCT s, c, t FROM l WHERE {FIRST_LINES}),
n AS (SELECT DISTINCT s, c, t FROM l WHERE {SECOND_LINES}),
merged AS (
  SELECT * FROM o WHERE s NOT IN (SELECT s FROM n)
  UNION ALL SELECT * FROM n WHERE c <> '' AND t <> '')
SELECT s AS source_table, c AS source_column, t AS target_table, 'p_partkey' AS target_column
FROM merged""",
        "describe_tables": f"""{rows}, u AS (
  SELECT 'order_' || o_orderkey AS t, 'open since ' || strftime(o_orderdate, '%Y-%m-%d') AS d,
    o_orderpriority AS g FROM orders WHERE o_orderstatus = 'O')
SELECT table_name, CASE WHEN t IS NULL THEN ai_description ELSE d END AS ai_description,
  CASE WHEN t IS NULL THEN ai_tags ELSE g END AS ai_tags
FROM cat_tables LEFT JOIN u ON t = table_name""",
        "describe_columns": f"""{rows}
SELECT table_name, column_name, CASE WHEN column_name = 'o_custkey'
  THEN 'customer ' || o_custkey END AS ai_description
FROM cat_columns LEFT JOIN orders ON table_name = 'order_' || o_orderkey""",
        "tables_by_size": f"{rows} SELECT table_name, row_count, column_count FROM cat_tables",
        "table_columns": f"{rows} SELECT column_name, 'integer' AS clean_type, "
        "CASE WHEN is_primary_key THEN 0.0::DOUBLE END AS null_pct FROM cat_columns "
        "WHERE table_name = 'order_7'",
        "lineage_tables": f"{rows} SELECT table_name, row_count, column_count, quality_score, "
        "quality_grade, ai_description, ai_tags, '2024-02-01 00:00:00' AS last_crawled_at "
        "FROM cat_tables",
        "lineage_columns": f"{rows} SELECT table_name, column_name, 'integer' AS clean_type, "
        "NOT is_primary_key AS is_nullable, is_primary_key, is_foreign_key, "
        "CAST(NULL AS VARCHAR) AS references_table, CAST(NULL AS VARCHAR) AS references_column, "
        "CASE WHEN is_primary_key THEN 0.0::DOUBLE END AS null_pct, "
        "CAST(NULL AS VARCHAR) AS ai_description FROM cat_columns",
        "lineage_relationships": f"{rows} SELECT source_table, source_column, target_table, "
        "target_column, 'many_to_one' AS relationship_type FROM cat_rels",
        "coverage": f"{rows} SELECT count(ai_description) AS described, count(*) AS total "
        "FROM cat_tables",
        "described_sample": f"{rows} SELECT table_name, ai_description, ai_tags FROM cat_tables "
        "WHERE ai_description IS NOT NULL ORDER BY table_name LIMIT 5",
        "catalog_summary": f"""WITH {ROW_CATALOG_SQL}, {DAILY_SQL}
SELECT (SELECT count(*) FROM cat_tables) AS table_count,
  (SELECT round(avg(quality_score), 2) FROM cat_tables) AS avg_quality,
  (SELECT count(ai_description) FROM cat_tables) AS described_count,
  (SELECT count(*) FROM cat_columns) AS column_count, status, tables_crawled, columns_crawled,
  9.5::DOUBLE AS duration_minutes
FROM daily ORDER BY started_at DESC LIMIT 1""",
        "prompt_table": f"WITH {_prompt_parts(ALL)} SELECT table_name, prompt FROM table_prompts",
        "prompt_column": f"WITH {_prompt_parts(VARIANTS)} "
        "SELECT table_name, column_name, prompt FROM column_prompts",
        "prompt_tags": f"""{rows}, placed AS (
  SELECT table_name, column_name,
    row_number() OVER (PARTITION BY table_name ORDER BY column_name) AS place FROM cat_columns),
heads AS (SELECT table_name, string_agg(column_name, ', ' ORDER BY place) AS names
  FROM placed WHERE place <= 8 GROUP BY 1)
SELECT table_name, {_fill(
            V.TAGS_PROMPT, table="table_name", columns="names", description="ai_description")}
  AS prompt
FROM cat_tables JOIN heads USING (table_name)""",
        "prompt_relationship": f"""{rows}
SELECT DISTINCT source_table, source_column, target_table, target_column, {_fill(
            V.RELATIONSHIP_PROMPT, source_table="source_table", source_column="source_column",
            target_table="target_table", target_column="target_column")} AS prompt
FROM cat_rels""",
        "cache_key": "SELECT doc_id, md5(text) AS key FROM documents",
        "cache_lookup": f"WITH {CACHE_SQL} SELECT doc_id, md5(text) AS key, response "
        "FROM documents LEFT JOIN cached ON key = md5(text)",
        "cache_misses": f"WITH {CACHE_SQL} SELECT md5(text) AS key, length(text) AS characters "
        "FROM (SELECT DISTINCT text FROM documents) WHERE md5(text) NOT IN "
        "(SELECT key FROM cached WHERE response <> '')",
        "cache_save": """WITH old AS (
  SELECT text AS prompt, min(CASE WHEN source = 'src0' THEN '' ELSE source END) AS response
  FROM documents GROUP BY 1),
fresh AS (
  SELECT DISTINCT CASE WHEN source = 'src1' THEN text ELSE 'Again: ' || text END AS prompt
  FROM documents),
kept AS (
  SELECT prompt, response FROM old WHERE prompt NOT IN (SELECT prompt FROM fresh)
  UNION ALL SELECT prompt, 'new' FROM fresh)
SELECT md5(prompt) AS key, response, substr(prompt, 1, 100) || '...' AS prompt_preview FROM kept""",
        "cache_stats": """SELECT 'new' AS state, count(*) FILTER (WHERE false) AS total_cached,
  true AS located, false AS exists FROM documents
UNION ALL SELECT 'saved', count(DISTINCT text), true, true FROM documents
UNION ALL SELECT 'cleared', 0, true, true""",
        "generate_batch": f"WITH {CACHE_SQL} SELECT doc_id, md5(text) AS key, "
        f"coalesce(nullif(response, ''), {ANSWER.format('text')}) AS response "
        "FROM documents LEFT JOIN cached ON key = md5(text)",
        "generate_descriptions": descriptions,
        "generate_column_descriptions": column_descriptions,
        "graph_nodes": f"{_graph(NODE_SQL)} SELECT * FROM node",
        "graph_edges": f"{_graph(EDGE_SQL)} SELECT * FROM edge",
        "graph_keys": "SELECT 'Table' AS label, 'rows.customer_' || o_custkey AS full_name, "
        f"CAST(2 AS BIGINT) AS count FROM orders GROUP BY o_custkey HAVING bool_or({FIRST_CRAWL}) "
        f"AND bool_or({SECOND_CRAWL})",
        "cleared_graph": f"{_graph(NODE_SQL, EDGE_SQL)} SELECT 'stored' AS state, "
        "'lineage_nodes' AS table_name, count(*) AS n FROM node UNION ALL "
        "SELECT 'stored', 'lineage_edges', count(*) FROM edge",
        "graph_node_counts": f"{_graph(NODE_SQL)} SELECT label AS type, count(*) AS count "
        "FROM node GROUP BY 1",
        "graph_edge_counts": f"{_graph(EDGE_SQL)} SELECT type, count(*) AS count "
        "FROM edge GROUP BY 1",
        "relationship_map": f"{rows} SELECT source_table, "
        "target_table || ' (via ' || source_column || ')' AS target FROM cat_rels",
        "related_tables": f"""{rows}, linked AS (
  SELECT source_table AS a, target_table AS b, source_column || ' → ' || target_column AS via
  FROM related
  UNION ALL
  SELECT target_table, source_table, source_column || ' → ' || target_column
  FROM related WHERE source_table <> target_table)
SELECT b AS "table", via, row_count AS rows, quality_score AS quality
FROM linked JOIN cat_tables ON table_name = b WHERE a = 'supplier_7'""",
        "upstream": f"""{rows}
SELECT DISTINCT target_table AS upstream_table, source_column AS from_column,
  target_column AS to_column, coalesce(ai_description, '') AS description
FROM refs JOIN cat_tables ON table_name = target_table WHERE source_table = 'order_7'""",
        "downstream": f"""{rows}
SELECT DISTINCT source_table AS downstream_table, source_column AS from_column,
  target_column AS to_column, coalesce(ai_description, '') AS description
FROM refs JOIN cat_tables ON table_name = source_table WHERE target_table = 'supplier_7'""",
        "foreign_keys": f"{rows} SELECT source_table AS from_table, source_column AS from_column, "
        "target_table AS to_table, target_column AS to_column FROM refs",
        "hubs": f"""{rows}, ends AS (
  SELECT source_table AS t FROM related
  UNION ALL SELECT target_table FROM related WHERE source_table <> target_table)
SELECT t AS "table", count(*) AS connections, max(row_count) AS rows,
  max(quality_score) AS quality
FROM ends JOIN cat_tables ON table_name = t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "lineage_path_all": _graph(
            NODE_SQL, EDGE_SQL, STEP_SQL.format(kinds="true"), _levels(2)
        ),
        "lineage_path_fk": _graph(
            NODE_SQL, EDGE_SQL, STEP_SQL.format(kinds="type = 'RELATED_TO'"), _levels(4)
        ),
        "search": f"""{rows}
SELECT table_name AS "table", coalesce(ai_description, '') AS description,
  quality_score AS quality, row_count AS rows
FROM cat_tables WHERE contains(lower(table_name), 'ring')
  OR contains(lower(ai_description), 'ring') OR contains(lower(ai_tags), 'ring')""",
        "search_documents": "SELECT doc_id, lang, n_chars FROM documents "
        "WHERE contains(lower(text), 'the ') OR contains(lower(source), 'the ')",
        "database_lineage": f"""WITH sizes AS ({sizes}),
named(t, c) AS (VALUES {named_columns}),
fk(s, a, t, b) AS (VALUES {foreign}),
none AS (SELECT CAST(NULL AS VARCHAR) AS x, CAST(NULL AS BIGINT) AS k)
SELECT 'CONTAINS' AS type, 'tests' AS src, k AS source_rows, 'tests.' || t AS dst,
  n AS target_rows, x AS rel_type, x AS via, x AS join_column FROM sizes, none
UNION ALL SELECT 'HAS_COLUMN', 'tests.' || t, n, 'tests.' || t || '.' || c, k, x, x, x
FROM named JOIN sizes USING (t), none
UNION ALL SELECT 'REFERENCES', 'tests.' || s || '.' || a, k, 'tests.' || t || '.' || b, k,
  'foreign_key', x, x FROM fk, none
UNION ALL SELECT 'RELATED_TO', 'tests.' || s, o.n, 'tests.' || fk.t, p.n, x, a || ' → ' || b, a
FROM fk JOIN sizes o ON o.t = s JOIN sizes p ON p.t = fk.t, none""",
        "crawl_catalog": f"{scored}, fks AS ({foreign_counts}), nulls AS ("
        + _union(
            f"SELECT '{n}' AS table_name, CAST(sum(null_count) AS BIGINT) AS nulls "
            f"FROM ({_column_facts(ALL)}) WHERE table_name = '{n}'"
            for n in ALL
        )
        + ") SELECT table_name, row_count, CAST(column_count AS BIGINT) AS column_count, "
        "CAST(column_count AS BIGINT) AS columns, nulls, primary_keys, "
        "CAST(k AS BIGINT) AS foreign_key_count, CAST(k AS BIGINT) AS relationships, "
        "overall_score AS quality_score, grade AS quality_grade, 'partial' AS status, "
        "count(*) OVER () AS tables_crawled, "
        "CAST(sum(column_count) OVER () AS BIGINT) AS columns_crawled, 'missing' AS failed "
        "FROM scored JOIN fks USING (table_name) JOIN nulls USING (table_name)",
        "describe_run": f"SELECT table_name, '' AS column_name, description, tags FROM ({descriptions}) "
        f"UNION ALL SELECT table_name, column_name, description, NULL FROM ({column_descriptions})",
        "full_refresh": f"{scored} SELECT count(*) AS table_count, "
        "round(avg(overall_score), 2) AS avg_quality, count(*) AS described_count, "
        "CAST(sum(column_count) AS BIGINT) AS column_count, 'partial' AS status, "
        "count(*) AS tables_crawled, CAST(sum(column_count) AS BIGINT) AS columns_crawled, "
        "CAST(1 + count(*) + sum(column_count) AS BIGINT) AS nodes, "
        f"CAST(count(*) + sum(column_count) + {2 * len(FOREIGN_KEYS)} AS BIGINT) AS edges FROM scored",
    }
