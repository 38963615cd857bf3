"""Fixed values the results depend on: labels, word lists, weights, thresholds, texts."""

# The label of each raw type name.
TYPE_LABELS = {
    "integer": "integer",
    "bigint": "integer",
    "smallint": "integer",
    "serial": "integer",
    "bigserial": "integer",
    "numeric": "decimal",
    "decimal": "decimal",
    "real": "float",
    "double precision": "float",
    "float": "float",
    "character varying": "string",
    "varchar": "string",
    "character": "string",
    "char": "string",
    "text": "text",
    "boolean": "boolean",
    "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamp",
    "timestamp": "timestamp",
    "date": "date",
    "time without time zone": "time",
    "time with time zone": "time",
    "json": "json",
    "jsonb": "json",
    "uuid": "uuid",
    "bytea": "binary",
    "array": "array",
}

# Spark's own type names, where they are none of those above.
SPARK_TYPE_LABELS = {
    "tinyint": "integer",
    "int": "integer",
    "double": "float",
    "string": "string",
    "timestamp_ntz": "timestamp",
    "timestamp_ltz": "timestamp",
    "time": "time",
    "variant": "json",
    "binary": "binary",
}

UNKNOWN_LABEL = "unknown"

# Groups of labels that the statistics and rules look at.
NUMERIC_LABELS = ("integer", "decimal", "float")
TEXT_LABELS = ("string", "text")
FRESHNESS_LABELS = ("timestamp", "date")
SAMPLED_LABELS = ("string", "boolean", "integer")

# Name parts that select columns for a rule or exclude them from samples.
NON_NEGATIVE_WORDS = ("price", "amount", "qty", "count", "total")
RATING_WORD = "rating"
RATING_RANGE = (1, 5)
UNSAMPLED_WORDS = ("_id", "_at", "_date", "password", "token", "hash")

# Scores that do not come from counting.
EMPTY_TABLE_SCORE = 100
NO_FRESHNESS_COLUMN_SCORE = 70
NO_FRESHNESS_VALUE_SCORE = 50
NO_CHECKS_SCORE = 95
FRESHNESS_STEPS = ((1, 100), (7, 80), (30, 60), (90, 40))
STALE_SCORE = 20
GRADE_STEPS = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
LOWEST_GRADE = "F"
WEIGHTS = {"completeness": "0.35", "uniqueness": "0.25", "validity": "0.25", "freshness": "0.15"}

# Wording of the issues a rule reports after the column's name and count.
ISSUE_TEXTS = {
    "negative": "negative values found",
    "blank": "empty string values found",
    "rating": "ratings outside 1-5 range",
}

# Names of the catalog's own tables, which a crawl leaves out.
CATALOG_TABLES = ("catalog_tables", "catalog_columns", "catalog_relationships", "crawl_logs")

# Sizes of the lists and texts the outputs hold.
TOP_VALUES = 3
PROMPT_COLUMNS = 10
PROMPT_SAMPLE_COLUMNS = 3
PROMPT_SAMPLED_FIRST = 5
PROMPT_COLUMN_SAMPLES = 5
TAG_COLUMNS = 8
PREVIEW_CHARS = 100
HUB_LIMIT = 10
DESCRIBED_SAMPLE = 5
MAX_LENGTHS = {"table": 100, "tags": 50, "column": 80, "default": 150}

# The prompts, with the places to fill in braces.
NOT_AVAILABLE = "Not available"
TABLE_PROMPT = """You are a senior data engineer writing documentation for a database catalog.

Write a clear 2-sentence business description for this database table.
Focus on what business data it stores and what it is used for.
Do not mention technical details like data types or row counts.

Table name: {table}
Columns: {columns}
Row count: {rows}
Sample values: {samples}

Description:"""
COLUMN_PROMPT = """You are a senior data engineer writing documentation for a database catalog.

Write a clear 1-sentence description for this database column.
Focus on what business information this column stores.
Do not mention data types or technical implementation details.

Table: {table}
Column: {column}
Data type: {type}
Nullable: {nullable}
Sample values: {samples}

Description:"""
TAGS_PROMPT = """You are a data engineer creating searchable tags for a data catalog.

Generate 5 relevant business tags for this database table.
Return ONLY the tags as comma-separated words. Nothing else.

Table: {table}
Columns: {columns}
Description: {description}

Tags:"""
RELATIONSHIP_PROMPT = """You are a data engineer explaining database relationships.

Write 1 sentence explaining this database relationship in plain English.
Focus on the business meaning, not the technical implementation.

Relationship:
{source_table}.{source_column} references {target_table}.{target_column}

Explanation:"""
