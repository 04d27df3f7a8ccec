"""The engine's own queries, each with the SQL that another engine answers it with.

Dirty inputs come from clean tables by expressions that both engines share: DIRTY holds
them as SQL text, in which {customer} and the like stand for the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import convert
from .functions import equality as eq
from .functions import text as tx
from .operators import compare, findings, infer, match, profile, relate, rules, runs, sketches, validate
from .operators import transform as tr
from .operators.rules import Rule
from .operators.transform import Step
from .plans import cron, issues, migrate, sheets, write
from .plans import metadata as md
from .session import ship_package, work_folder, work_table
from .sources import files, paging
from .sources import tables as src
from .streaming import incremental, state

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

#: Shared by both engines.
DIRTY = {
    "dirty_customer": """
SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal,
  CASE WHEN c_custkey % 11 = 0 THEN concat(c_name, '  ') WHEN c_custkey % 17 = 0 THEN concat(' ', lower(c_name)) ELSE c_name END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN '   ' ELSE concat(lower(replace(c_name, '#', '.')), CASE WHEN c_custkey % 29 = 0 THEN ' at ' ELSE '@' END, 'example.com') END AS email,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'n/a' WHEN c_custkey % 10 = 3 THEN concat('$', CAST(c_custkey AS STRING), '.50') ELSE concat(CAST(c_custkey * 37 % 1000 AS STRING), '.', lpad(CAST(c_custkey % 100 AS STRING), 2, '0')) END AS amount,
  lpad(CAST(c_custkey AS STRING), 6, '0') AS code,
  CASE c_custkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'yes' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'no' ELSE 'maybe' END AS flag,
  CASE WHEN c_custkey % 8 = 0 THEN '2024-02-30' WHEN c_custkey % 9 = 0 THEN concat(lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'), '/0', CAST(c_custkey % 9 + 1 AS STRING), '/2023') ELSE concat('2023-0', CAST(c_custkey % 9 + 1 AS STRING), '-', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')) END AS born,
  CASE WHEN c_custkey % 4 = 0 THEN concat('+44 20 ', CAST(1000000 + c_custkey AS STRING)) WHEN c_custkey % 4 = 1 THEN concat('(555) ', CAST(100000 + c_custkey AS STRING)) ELSE concat('x', CAST(c_custkey AS STRING)) END AS phone
FROM {customer}""",
    "changed_orders": """
SELECT o_orderkey, CASE WHEN o_orderkey % 70 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority, o_custkey FROM {orders} WHERE o_orderkey % 50 <> 0
UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM {orders} WHERE o_orderkey % 90 = 0
UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, o_orderpriority, o_custkey FROM {orders} WHERE o_orderkey % 400 = 1""",
    "old_customer": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS title, CASE WHEN c_custkey % 10 = 0 THEN 'OTHER' ELSE c_mktsegment END AS segment FROM {customer} WHERE c_custkey % 4 <> 0",
    "some_customer": "SELECT * FROM {customer} WHERE c_custkey % 100 <> 0",
    "coded_orders": "SELECT o_orderkey AS order_id, o_custkey AS customer_no, o_orderstatus AS status, CASE WHEN o_orderkey % 500 = 0 THEN 'REF-0' ELSE concat('REF-', CAST(o_orderkey AS STRING)) END AS order_ref, CAST(NULL AS STRING) AS spare FROM {orders}",
    "odd_customer": "SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN c_custkey - 1 ELSE c_custkey END AS id, c_name, c_mktsegment FROM {customer}",
    "no_region": "SELECT * FROM {region} WHERE r_regionkey < 0",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Inputs:
    """The tables of one folder, and the dirty views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DIRTY:
            own = [t for t in TABLES if "{" + t + "}" in DIRTY[name]]
            return self.spark.sql(DIRTY[name], **{t: getattr(self, t) for t in own})
        return src.scan_table(self.spark, f"{self.dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Registers a function of Inputs; {dirty_customer} and the like in the oracle become subqueries."""

    def register(f: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[name] = sql_of(oracle)
        return f

    return register


def sql_of(text: str) -> str:
    for view, body in DIRTY.items():
        plain = body
        for t in TABLES:
            plain = plain.replace("{" + t + "}", t)
        text = text.replace("{" + view + "}", f"({plain.strip()})")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


#: White space of any script, as a class that RE2 knows.
_W = r"[\s\x{000b}\x{00a0}\x{feff}\p{Z}]"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^{_W}+|{_W}+\z', '', 'g')"


def _blank(c: str) -> str:
    return f"({c} IS NULL OR {_trim(c)} = '')"


_NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z'"


def _number(c: str) -> str:
    return f"CASE WHEN regexp_matches({_trim(c)}, {_NUM}) THEN TRY_CAST({_trim(c)} AS DOUBLE) END"


# -- profile

_PROFILED = ("name", "email", "amount", "born", "flag")


def _per_field(body: str, fields=_PROFILED, table: str = "{dirty_customer}") -> str:
    return " UNION ALL ".join(body.replace("$f", f) + f" FROM {table} t" for f in fields)


@query("profile_null_count", _per_field("SELECT '$f' AS field, count(*) AS examined, count(*) - count($f) AS null_count"))
def _(t):
    return profile.column_stats(t.dirty_customer, _PROFILED).select("field", "examined", "null_count")


@query("profile_null_percent", _per_field("SELECT '$f' AS field, floor((count(*) - count($f)) * 1000.0 / count(*) + 0.5) / 10.0 AS null_percent"))
def _(t):
    return profile.column_stats(t.dirty_customer, _PROFILED).select("field", "null_percent")


@query("profile_blank_count", _per_field(f"SELECT '$f' AS field, count(*) FILTER ($f IS NOT NULL AND {_trim('$f')} = '') AS blank_count"))
def _(t):
    return profile.column_stats(t.dirty_customer, _PROFILED).select("field", "blank_count")


@query("profile_whitespace_count", _per_field(f"SELECT '$f' AS field, count(*) FILTER ({_trim('$f')} <> '' AND {_trim('$f')} <> $f) AS whitespace_count"))
def _(t):
    return profile.column_stats(t.dirty_customer, _PROFILED).select("field", "whitespace_count")


@query("profile_distinct_count", "SELECT 'o_orderpriority' AS field, count(DISTINCT o_orderpriority) AS distinct_count FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders")
def _(t):
    return profile.duplication(profile.value_counts(t.orders, ["o_orderpriority", "o_orderstatus", "o_custkey"])).select("field", "distinct_count")


@query("profile_duplicate_count", _per_field("SELECT '$f' AS field, count($f) - count(DISTINCT $f) AS duplicate_count"))
def _(t):
    return profile.duplication(profile.value_counts(t.dirty_customer, _PROFILED)).select("field", "duplicate_count")


@query("profile_length_stats", _per_field("SELECT '$f' AS field, min(length($f)) AS min_length, max(length($f)) AS max_length, floor(avg(length($f)) * 10 + 0.5) / 10 AS avg_length", ("p_name", "p_brand", "p_type"), "part"))
def _(t):
    return profile.column_stats(t.part, ["p_name", "p_brand", "p_type"]).select("field", "min_length", "max_length", "avg_length")


@query("profile_numeric_stats", f"SELECT 'amount' AS field, min(n) AS min_number, max(n) AS max_number, floor(avg(n) * 1000000 + 0.5) / 1000000 AS avg_number FROM (SELECT {_number('amount')} AS n FROM {{dirty_customer}} t)")
def _(t):
    return profile.column_stats(t.dirty_customer, ["amount"], {"amount": "number"}).select("field", "min_number", "max_number", "avg_number")


@query("profile_date_range", "SELECT 'o_orderdate' AS field, CAST(min(o_orderdate) AS TIMESTAMP) AS min_date, CAST(max(o_orderdate) AS TIMESTAMP) AS max_date FROM orders")
def _(t):
    return profile.column_stats(t.orders, ["o_orderdate"]).select("field", "min_date", "max_date")


@query("profile_invalid_value", f"""SELECT 'amount' AS field, count(*) FILTER (NOT {_blank('amount')} AND NOT regexp_matches({_trim('amount')}, {_NUM})) AS invalid_count FROM {{dirty_customer}} t
UNION ALL SELECT 'born', count(*) FILTER (NOT {_blank('born')} AND (NOT regexp_matches(born, '^\\d{{4}}-\\d{{2}}-\\d{{2}}\\z') OR TRY_CAST(born AS DATE) IS NULL)) FROM {{dirty_customer}} t
UNION ALL SELECT 'flag', count(*) FILTER (lower(flag) NOT IN ('true', 'false', '0', '1', 'yes', 'no')) FROM {{dirty_customer}} t""")
def _(t):
    return profile.column_stats(t.dirty_customer, ["amount", "born", "flag"], {"amount": "number", "born": "datetime", "flag": "boolean"}).select("field", "invalid_count")


@query("profile_invalid_email", f"SELECT 'email' AS field, count(*) FILTER (NOT {_blank('email')} AND NOT regexp_matches({_trim('email')}, '^[^\\s@]+@[^\\s@.]+\\.[^\\s@]{{2,}}\\z')) AS invalid_count FROM {{dirty_customer}} t")
def _(t):
    return profile.column_stats(t.dirty_customer, ["email"], {"email": "email"}).select("field", "invalid_count")


@query("profile_duplication", """WITH v AS (SELECT concat(CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR)) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'line' AS field, count(*) AS distinct_values, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS rows_in_collision, max(n) AS largest_group FROM v""")
def _(t):
    line = t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line"))
    return profile.duplication(profile.value_counts(line)).select("field", "distinct_values", "duplicate_groups", "rows_in_collision", "largest_group")


@query("profile_value_shapes", f"""SELECT 'amount' AS field, count(*) FILTER (regexp_matches(a, '^-?\\d+(\\.\\d+)?\\z')) AS number_shapes, count(*) FILTER (regexp_matches(a, '^\\$\\d+(\\.\\d+)?\\z')) AS currency_shapes, count(*) FILTER (a = 'n/a') AS text_shapes FROM (SELECT {_trim('amount')} AS a FROM {{dirty_customer}} t)""")
def _(t):
    return profile.column_stats(t.dirty_customer, ["amount"]).select("field", "number_shapes", "currency_shapes", "text_shapes")


@query("profile_top_values", "SELECT 'event_type' AS field, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, v AS value, n AS count FROM (SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1)")
def _(t):
    return profile.top_values(profile.value_counts(t.events, ["event_type"]))


@query("profile_value_sample", f"SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE NOT {_blank('o_orderpriority')} GROUP BY 1")
def _(t):
    return profile.value_counts(t.orders, ["o_orderpriority"]).where(~tx.is_blank(F.col("value"))).select("value", "count")


@query("profile_pk_integrity", "SELECT CAST(sum(n) AS BIGINT) AS rows, 0 AS missing, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def _(t):
    return profile.pk_integrity(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("profile_basis", "SELECT 'o_orderkey' AS field, 100 AS examined, 'SAMPLED' AS basis, min(o_orderkey)::DOUBLE AS min_number, max(o_orderkey)::DOUBLE AS max_number FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 100)")
def _(t):
    return profile.profile(t.orders, "orders", ["o_orderkey"], sample=100, order_by="o_orderkey").select("field", "examined", "basis", "min_number", "max_number")


@query("analysis_totals", "SELECT 4 AS tables, 14 AS columns, (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM {coded_orders} t) AS examined, 1 AS empty_tables, 1 AS unused_columns")
def _(t):
    parts = [profile.profile(getattr(t, n), n) for n in ("nation", "supplier", "no_region", "coded_orders")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return profile.analysis_totals(out).select("tables", "columns", "examined", "empty_tables", "unused_columns")


# -- rules: one query each

_RULES = {
    "dq_required": (Rule("REQUIRED", "email"), _blank("email")),
    "dq_not_blank": (Rule("NOT_BLANK", "email"), f"email IS NOT NULL AND {_blank('email')}"),
    "dq_max_length": (Rule("MAX_LENGTH", "name", maximum=18), "length(name) > 18"),
    "dq_min_length": (Rule("MIN_LENGTH", "amount", minimum=6), f"NOT {_blank('amount')} AND length(amount) < 6"),
    "dq_valid_email": (Rule("VALID_EMAIL", "email"), f"NOT {_blank('email')} AND NOT regexp_matches({_trim('email')}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{{2,}}\\z')"),
    "dq_valid_phone": (Rule("VALID_PHONE", "phone"), "NOT regexp_matches(phone, '^[+0-9][0-9\\s().\\-/]{4,}\\z')"),
    "dq_numeric_range": (Rule("NUMERIC_RANGE", "amount", minimum=10, maximum=900), f"({_number('amount')}) < 10 OR ({_number('amount')}) > 900"),
    "dq_date_range": (Rule("DATE_RANGE", "born", minimum="2023-02-01", maximum="2023-08-31"), "regexp_matches(born, '^\\d{4}-\\d{2}-\\d{2}\\z') AND (TRY_CAST(born AS DATE) < DATE '2023-02-01' OR TRY_CAST(born AS DATE) > DATE '2023-08-31')"),
    "dq_allowed_values": (Rule("ALLOWED_VALUES", "flag", values=("Y", "yes", "no")), "flag NOT IN ('Y', 'yes', 'no')"),
    "dq_regex": (Rule("REGEX_PATTERN", "code", pattern="^0+[1-9]"), "NOT regexp_matches(code, '^0+[1-9]')"),
}
for _name, (_rule, _cond) in _RULES.items():
    query(_name, f"SELECT '{_rule.column}' AS column_name, '{rules.CODES[_rule.kind]}' AS code, count(*) FILTER ({_cond}) AS affected FROM {{dirty_customer}} t")(
        lambda t, r=_rule: rules.evaluate(t.dirty_customer, [r]).select("column_name", "code", "affected")
    )


@query("dq_unique", "SELECT 'name' AS column_name, 'DUPLICATE_KEY' AS code, count(name) - count(DISTINCT name) AS affected FROM {dirty_customer} t")
def _(t):
    return rules.evaluate(t.dirty_customer, [Rule("UNIQUE", "name")]).select("column_name", "code", "affected")


@query("dq_rule_counts", " UNION ALL ".join(f"SELECT '{r.column}' AS column_name, '{rules.CODES[r.kind]}' AS code, count(*) FILTER ({c}) AS affected FROM {{dirty_customer}} t" for r, c in _RULES.values()))
def _(t):
    return rules.evaluate(t.dirty_customer, [r for r, _ in _RULES.values()]).select("column_name", "code", "affected")


@query("dq_summary", f"SELECT 'STRING_TOO_LONG' AS code, count(*) FILTER (length(name) > 18) + count(*) FILTER (length(phone) > 10) AS affected, 'BLOCKER' AS severity FROM {{dirty_customer}} t UNION ALL SELECT 'BLANK_VALUE', count(*) FILTER (email IS NOT NULL AND {_blank('email')}), 'WARNING' FROM {{dirty_customer}} t")
def _(t):
    own = [Rule("MAX_LENGTH", "name", maximum=18), Rule("MAX_LENGTH", "phone", "BLOCKER", maximum=10), Rule("NOT_BLANK", "email")]
    return rules.summary(rules.evaluate(t.dirty_customer, own))


@query("dq_derive_rules", "SELECT 'name' AS column_name, 'STRING_TOO_LONG' AS code, count(*) FILTER (length(name) > 15) AS affected FROM {dirty_customer} t UNION ALL SELECT 'name', 'REQUIRED_VALUE_MISSING', count(*) FILTER (name IS NULL) FROM {dirty_customer} t")
def _(t):
    return rules.evaluate(t.dirty_customer, rules.derive([{"name": "name", "required": True, "max_length": 15}])).select("column_name", "code", "affected")


# -- inference

@query("infer_type", "SELECT * FROM (VALUES ('code', 'String'), ('amount', 'String'), ('key_text', 'Integer'), ('money_text', 'Decimal'), ('day', 'Date'), ('yes_no', 'Boolean'), ('nothing', 'String'), ('big', 'BigInt')) v(field, type)")
def _(t):
    c = t.dirty_customer.select("code", "amount", F.col("c_custkey").cast("string").alias("key_text"), F.concat(F.col("c_custkey").cast("string"), F.lit(".25")).alias("money_text"), F.lit("2024-01-31").alias("day"), F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("no").alias("yes_no"), F.lit("N/A").alias("nothing"), F.concat(F.lit("31"), F.lpad(F.col("c_custkey").cast("string"), 9, "1")).alias("big"))
    return infer.infer_types(c).select("field", "type")


@query("semantic_type", "SELECT * FROM (VALUES ('mail', 'EMAIL', 'HIGH'), ('site', 'URL', 'HIGH'), ('price', 'CURRENCY', 'HIGH'), ('rate', 'PERCENTAGE', 'HIGH'), ('call', 'PHONE', 'MEDIUM'), ('code', 'IDENTIFIER', 'HIGH'), ('c_mktsegment', 'CATEGORICAL', 'HIGH'), ('start_date', 'EXCEL_SERIAL_DATE', 'HIGH'), ('empty', 'EMPTY', 'HIGH'), ('name', NULL, NULL)) v(field, semantic, confidence)")
def _(t):
    k = F.col("c_custkey").cast("string")
    c = t.dirty_customer.select(F.concat(k, F.lit("@a.example")).alias("mail"), F.concat(F.lit("https://a.example/"), k).alias("site"), F.concat(F.lit("$"), k, F.lit(".10")).alias("price"), F.concat((F.col("c_custkey") % 90).cast("string"), F.lit("%")).alias("rate"), F.concat(F.lit("+1 555 "), F.lpad(k, 7, "0")).alias("call"), "code", "c_mktsegment", (F.col("c_custkey") % 1000 + 40000).cast("string").alias("start_date"), F.lit("").alias("empty"), "name")
    return infer.semantic_types(c, c.columns).select("field", "semantic", "confidence")


# Fixed value: the pattern of names like keys, for the other engine.
_KEY_NAME = "'(?i)(^|[^a-z])(id|key|code|no|num|number|ref|reference|sku|guid|uuid|account|barcode|isbn|ean)([^a-z]|\\z)'"
_KEYED = {"dirty_customer": ("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", "name", "email", "amount", "code", "flag", "born", "phone"), "coded_orders": ("order_id", "customer_no", "status", "order_ref", "spare")}


@query("candidate_keys", " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS field FROM {{{n}}} t HAVING regexp_matches('{c}', {_KEY_NAME}) AND count(*) > 0 AND count(DISTINCT {c}) = count(*) AND count(*) FILTER (CAST({c} AS VARCHAR) = '') = 0" for n, columns in _KEYED.items() for c in columns))
def _(t):
    out = None
    for name in _KEYED:
        found = findings.candidate_keys(profile.profile(getattr(t, name), name))
        out = found if out is None else out.unionAll(found)
    return out


@query("shape_of", f"SELECT s AS shape, count(*) AS n FROM (SELECT CASE WHEN {_blank('amount')} THEN 'BLANK' WHEN regexp_matches(amount, '^-?\\d+(\\.\\d+)?\\z') THEN 'NUMBER' WHEN amount LIKE '$%' THEN 'CURRENCY' ELSE 'TEXT' END AS s FROM {{dirty_customer}} t) GROUP BY 1")
def _(t):
    return t.dirty_customer.groupBy(tx.shape_of(F.col("amount")).alias("shape")).agg(F.count("*").alias("n"))


@query("boolean_word", "SELECT flag, lower(flag) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f', 'on', 'off') AS word, count(*) AS n FROM {dirty_customer} t GROUP BY 1, 2")
def _(t):
    return t.dirty_customer.groupBy("flag", tx.is_boolean_word(F.col("flag")).alias("word")).agg(F.count("*").alias("n"))


@query("looks_like_currency", "SELECT count(*) FILTER (amount LIKE '$%') AS money FROM {dirty_customer} t")
def _(t):
    return t.dirty_customer.agg(F.count_if(tx.looks_like_currency(F.col("amount"))).alias("money"))


@query("currency_marker", "SELECT '$' AS marker, '.' AS separator, 2 AS places, count(*) AS n FROM {dirty_customer} t WHERE amount LIKE '$%'")
def _(t):
    c = F.col("amount")
    own = t.dirty_customer.where(c.startswith("$"))
    return own.groupBy(tx.currency_marker(c).alias("marker"), tx.decimal_separator(c).alias("separator"), tx.decimal_places(c).alias("places")).agg(F.count("*").alias("n"))


@query("excel_serial_to_instant", "SELECT o_orderkey, TIMESTAMP '1899-12-30 00:00:00' + INTERVAL 1 DAY * CAST(40000 + o_orderkey % 5000 AS INTEGER) + INTERVAL 6 HOUR * CAST(o_orderkey % 4 AS INTEGER) AS at FROM orders")
def _(t):
    return t.orders.select("o_orderkey", tx.excel_serial_to_instant((F.lit(40000) + F.col("o_orderkey") % 5000 + (F.col("o_orderkey") % 4) * F.lit(0.25)).cast("string")).alias("at"))


@query("excel_serial_to_date", "SELECT o_orderkey, CAST(DATE '1899-12-30' + CAST(40000 + o_orderkey % 5000 AS INTEGER) AS DATE) AS day FROM orders")
def _(t):
    return t.orders.select("o_orderkey", tx.excel_serial_to_date((F.lit(40000) + F.col("o_orderkey") % 5000).cast("string")).alias("day"))


# -- relationships

@query("relationship_overlap", """WITH p AS (SELECT DISTINCT c_custkey AS v FROM {some_customer} t), c AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT count(*) AS child_values, count(p.v) AS covered_values, CAST(sum(n) AS BIGINT) AS child_records, CAST(coalesce(sum(n) FILTER (p.v IS NULL), 0) AS BIGINT) AS orphan_records, round(count(p.v) * 1.0 / count(*), 6) AS coverage FROM c LEFT JOIN p ON c.v = p.v""")
def _(t):
    return relate.overlap(t.orders, "o_custkey", t.some_customer, "c_custkey").drop("parent_unique")


@query("relationships", """SELECT 'nation' AS child_table, 'n_regionkey' AS child_column, 'region' AS parent_table, 'r_regionkey' AS parent_column, 'INFERRED' AS verdict, 0 AS orphan_records, 25 AS child_records
UNION ALL SELECT 'customer', 'c_nationkey', 'nation', 'n_nationkey', 'INFERRED', 0, (SELECT count(*) FROM customer)
UNION ALL SELECT 'orders', 'o_custkey', 'customer', 'c_custkey', 'INFERRED', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {some_customer} t)), (SELECT count(*) FROM orders)""")
def _(t):
    tables = {"region": t.region, "nation": t.nation, "customer": t.customer, "orders": t.orders}
    found = relate.discover(tables, parents={"customer": t.some_customer})
    return found.select("child_table", "child_column", "parent_table", "parent_column", "verdict", "orphan_records", "child_records")


@query("broken_reference", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {some_customer} t)")
def _(t):
    return relate.broken_references(t.orders, "o_custkey", t.some_customer, "c_custkey").select("o_orderkey", "o_custkey")


@query("find_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 1000")
def _(t):
    return relate.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


# -- transforms: (column, steps, value, error, lossy) with the oracle's expressions

_NULL, _NO = "NULL", "false"
_TRANSFORMS: dict[str, tuple[str, list[Step], str, str, str]] = {
    "t_trim": ("name", [Step("TRIM")], _trim("name"), _NULL, _NO),
    "t_left_trim": ("name", [Step("LEFT_TRIM")], rf"regexp_replace(name, '^{_W}+', '')", _NULL, _NO),
    "t_right_trim": ("name", [Step("RIGHT_TRIM")], rf"regexp_replace(name, '{_W}+\z', '')", _NULL, _NO),
    "t_uppercase": ("name", [Step("UPPERCASE")], "upper(name)", _NULL, _NO),
    "t_lowercase": ("name", [Step("LOWERCASE")], "lower(name)", _NULL, _NO),
    "t_replace": ("name", [Step("REPLACE", {"find": "0", "replace": "o"})], "replace(name, '0', 'o')", _NULL, _NO),
    "t_prefix": ("email", [Step("PREFIX", {"text": "to:"})], "CASE WHEN email IS NOT NULL THEN 'to:' || email END", _NULL, _NO),
    "t_suffix": ("email", [Step("SUFFIX", {"text": ";"})], "CASE WHEN email IS NOT NULL THEN email || ';' END", _NULL, _NO),
    "t_substring": ("name", [Step("SUBSTRING", {"start": 2, "length": 5})], "substring(name, 3, 5)", _NULL, "length(substring(name, 3, 5)) < length(name)"),
    "t_truncate": ("name", [Step("TRUNCATE", {"length": 18})], "left(name, 18)", _NULL, "length(name) > 18"),
    "t_empty_to_null": ("email", [Step("EMPTY_TO_NULL")], f"CASE WHEN NOT {_blank('email')} THEN email END", _NULL, _NO),
    "t_null_to_empty": ("email", [Step("NULL_TO_EMPTY")], "coalesce(email, '')", _NULL, _NO),
    "t_default_if_null": ("email", [Step("DEFAULT_IF_NULL", {"value": "none"})], "coalesce(email, 'none')", _NULL, _NO),
    "t_default_if_blank": ("email", [Step("DEFAULT_IF_BLANK", {"value": "none"})], f"CASE WHEN {_blank('email')} THEN 'none' ELSE email END", _NULL, _NO),
    "t_block_if_null": ("email", [Step("BLOCK_IF_NULL")], "email", "CASE WHEN email IS NULL THEN 'REQUIRED_VALUE_MISSING' END", _NO),
    "t_constant": ("email", [Step("CONSTANT", {"value": "fixed"})], "'fixed'", _NULL, _NO),
    "t_to_string": ("code", [Step("TO_STRING")], "code", _NULL, _NO),
    "t_to_integer": ("amount", [Step("TO_INTEGER")], f"CAST(CAST(trunc({_number('amount')}) AS BIGINT) AS VARCHAR)", f"CASE WHEN amount IS NOT NULL AND ({_number('amount')}) IS NULL THEN 'INVALID_NUMBER' END", f"coalesce(trunc({_number('amount')}) <> ({_number('amount')}), false)"),
    "t_to_decimal": ("amount", [Step("TO_DECIMAL", {"scale": 1})], f"regexp_replace(CAST(CAST(floor(({_number('amount')}) * 10 + 0.5) / 10 AS DECIMAL(18,1)) AS VARCHAR), '\\.0\\z', '')", f"CASE WHEN amount IS NOT NULL AND ({_number('amount')}) IS NULL THEN 'INVALID_NUMBER' END", f"coalesce(floor(({_number('amount')}) * 10 + 0.5) / 10 <> ({_number('amount')}), false)"),
    "t_to_boolean": ("flag", [Step("TO_BOOLEAN")], "CASE WHEN lower(flag) IN ('true', '1', 'y', 'yes') THEN 'true' WHEN lower(flag) IN ('false', '0', 'n', 'no') THEN 'false' END", "CASE WHEN flag = 'maybe' THEN 'VALUE_MAP_MISSING' END", _NO),
    "t_to_date": ("born", [Step("TO_DATE")], "CASE WHEN regexp_matches(born, '^\\d{4}-\\d{2}-\\d{2}\\z') THEN CAST(TRY_CAST(born AS DATE) AS VARCHAR) END", "CASE WHEN born LIKE '%/%' THEN 'AMBIGUOUS_DATE' WHEN TRY_CAST(born AS DATE) IS NULL THEN 'INVALID_DATE' END", _NO),
    "t_to_datetime": ("born", [Step("TO_DATETIME", {"format": "DD/MM/YYYY"})], "CASE WHEN born LIKE '%/%' THEN strftime(TRY_STRPTIME(born, '%d/%m/%Y'), '%Y-%m-%d') || 'T00:00:00Z' END", "CASE WHEN born NOT LIKE '%/%' THEN 'INVALID_DATE' END", _NO),
    "t_to_guid": ("code", [Step("PREFIX", {"text": "00112233445566778899AABBCC"}), Step("TO_GUID")], "'00112233-4455-6677-8899-aabbcc' || code", _NULL, _NO),
    "t_value_map": ("flag", [Step("VALUE_MAP", {"entries": {"Y": "1", "yes": "1", "NO": "0"}, "unmapped": "BLOCK"})], "CASE WHEN lower(flag) IN ('y', 'yes') THEN '1' WHEN flag = 'no' THEN '0' END", "CASE WHEN flag IN ('TRUE', 'maybe') THEN 'VALUE_MAP_MISSING' END", _NO),
    "t_choice_map": ("c_mktsegment", [Step("CHOICE_MAP", {"entries": {"BUILDING": "10", "machinery": "20"}, "unmapped": "DEFAULT", "default": "0"})], "CASE c_mktsegment WHEN 'BUILDING' THEN '10' WHEN 'MACHINERY' THEN '20' ELSE '0' END", _NULL, _NO),
    "t_concat": ("email", [Step("CONCAT", {"parts": [{"column": "code"}, {"column": "email"}, {"literal": "end"}], "separator": "-"})], "CASE WHEN email IS NULL OR email = '' THEN code || '-end' ELSE code || '-' || email || '-end' END", _NULL, _NO),
    "t_if_then": ("flag", [Step("IF_THEN", {"column": "c_mktsegment", "op": "EQUALS", "expected": " building ", "then": "APPLY", "steps": [Step("UPPERCASE")]})], "CASE WHEN c_mktsegment = 'BUILDING' THEN upper(flag) ELSE flag END", _NULL, _NO),
    "t_pipeline": ("name", [Step("TRIM"), Step("LOWERCASE"), Step("TRUNCATE", {"length": 12})], f"left(lower({_trim('name')}), 12)", _NULL, f"length({_trim('name')}) > 12"),
    "t_templates": ("phone", tr.TEMPLATES["phone"], "replace(replace(replace(replace(phone, ' ', ''), '-', ''), '(', ''), ')', '')", _NULL, _NO),
    "t_legacy": ("email", [Step("TRIM"), Step("DEFAULT_IF_NULL", {"value": "-"})], f"coalesce({_trim('email')}, '-')", _NULL, _NO),
}


def _transformed(t: Inputs, column: str, steps: list[Step]) -> DataFrame:
    out = tr.apply(t.dirty_customer, column, steps)
    return out.select("c_custkey", F.col("result.value").alias("value"), F.col("result.error_code").alias("error_code"), F.col("result.lossy").alias("lossy"))


for _name, (_column, _steps, _value, _error, _lossy) in _TRANSFORMS.items():
    query(_name, f"SELECT c_custkey, {_value} AS value, CAST({_error} AS VARCHAR) AS error_code, coalesce({_lossy}, false) AS lossy FROM {{dirty_customer}} t")(
        lambda t, c=_column, s=_steps: _transformed(t, c, s)
    )


@query("condition", f"""SELECT count(*) FILTER (lower({_trim("coalesce(flag, '')")}) = 'yes') AS equal, count(*) FILTER (coalesce(email, '') = '' OR {_trim("coalesce(email, '')")} = '') AS same_as_null, count(*) FILTER (lower(name) LIKE '%customer%') AS contains, count(*) FILTER (lower(name) LIKE 'customer%') AS starts, count(*) FILTER (CASE WHEN {_blank('amount')} THEN 0 ELSE {_number('amount')} END < 100) AS less, count(*) FILTER (email IS NULL) AS nulls, count(*) FILTER ({_blank('email')}) AS blanks FROM {{dirty_customer}} t""")
def _(t):
    n = lambda c, *a: F.count_if(tr.condition(F.col(c), *a))
    return t.dirty_customer.agg(n("flag", "EQUALS", " YES ").alias("equal"), n("email", "EQUALS", None).alias("same_as_null"), n("name", "CONTAINS", "Customer").alias("contains"), n("name", "STARTS_WITH", "CUSTOMER").alias("starts"), n("amount", "LESS_THAN", "100").alias("less"), n("email", "IS_NULL").alias("nulls"), n("email", "IS_BLANK").alias("blanks"))


@query("t_target_constraints", f"SELECT CASE WHEN length(name) > 18 THEN 'STRING_TOO_LONG' END AS error_code, count(*) AS n FROM {{dirty_customer}} t GROUP BY 1")
def _(t):
    return t.dirty_customer.groupBy(tr.target_constraints(F.col("name"), 18, True).alias("error_code")).agg(F.count("*").alias("n"))


@query("t_target_convert", f"""SELECT c_custkey, CASE WHEN amount IS NULL OR ({_number('amount')}) IS NULL OR floor({_number('amount')}) <> ({_number('amount')}) THEN NULL ELSE CAST(CAST({_number('amount')} AS BIGINT) AS VARCHAR) END AS value,
CASE WHEN amount IS NULL THEN NULL WHEN amount = 'n/a' THEN 'VALUE_MAP_MISSING' WHEN ({_number('amount')}) IS NULL THEN 'INVALID_NUMBER' WHEN floor({_number('amount')}) <> ({_number('amount')}) THEN 'TRANSFORMATION_FAILED' END AS error_code FROM {{dirty_customer}} t""")
def _(t):
    refuse = Step("IF_THEN", {"op": "EQUALS", "expected": "n/a", "then": "APPLY", "steps": [Step("VALUE_MAP", {"entries": {}, "unmapped": "BLOCK"})]})
    out = tr.convert_to_target(tr.apply(t.dirty_customer, "amount", [Step("TRIM"), refuse]), "Integer")
    return out.select("c_custkey", F.col("result.value").alias("value"), F.col("result.error_code").alias("error_code"))


@query("t_sheet_roundtrip", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'yes' WHEN lower(flag) IN ('y', 'yes') THEN '1' WHEN flag = 'no' THEN '0' ELSE '?' END || '-end' AS value FROM {dirty_customer} t")
def _(t):
    steps = [
        Step("VALUE_MAP", {"entries": {"Y": "1", "yes": "1", "no": "0"}, "unmapped": "DEFAULT", "default": "?"}), Step("SUBSTRING", {"start": 0, "length": 4}),
        Step("IF_THEN", {"column": "c_mktsegment", "op": "EQUALS", "expected": "building", "then": "APPLY", "steps": [Step("CONSTANT", {"value": "YES"}), Step("LOWERCASE")]}), Step("SUFFIX", {"text": "-end"}),
    ]
    read = tr.from_sheets(*tr.to_sheets({("customer", "flag"): steps, ("customer", "name"): []}))
    assert read == {("customer", "flag"): steps, ("customer", "name"): []}
    return tr.apply(t.dirty_customer, "flag", read["customer", "flag"]).select("c_custkey", F.col("result.value").alias("value"))


@query("transform_metrics", "SELECT count(*) AS rows, count(*) FILTER (lower(left(name, 12)) <> name) AS changed, count(*) FILTER (length(name) > 12) AS lossy, 0 AS nulls, 0 AS failures FROM {dirty_customer} t")
def _(t):
    return tr.metrics(tr.apply(t.dirty_customer, "name", [Step("LOWERCASE"), Step("TRUNCATE", {"length": 12})]))


@query("loss_impact", "SELECT 'SHORTENED' AS loss, count(*) AS records, max(length(name)) AS longest FROM {dirty_customer} t WHERE length(name) > 18")
def _(t):
    return tr.loss_impact(tr.apply(t.dirty_customer, "name", [Step("TRUNCATE", {"length": 18})]), "name")


# -- equality

@query("normalize_for_compare", rf"SELECT c_custkey, nullif(regexp_replace(name, '{_W}+\z', ''), '') AS text_value, CASE WHEN lower(flag) IN ('y', 'yes', 'true') THEN 'true' WHEN flag = 'no' THEN 'false' ELSE lower(flag) END AS boolean_value, left(born, 10) AS date_value FROM {{dirty_customer}} t")
def _(t):
    return t.dirty_customer.select("c_custkey", eq.normalize(F.col("name"), "text").alias("text_value"), eq.normalize(F.col("flag"), "boolean").alias("boolean_value"), eq.normalize(F.col("born"), "date").alias("date_value"))


@query("decimals_equal", "SELECT count(*) FILTER (round(CAST(c_acctbal AS DECIMAL(18,2)), 0) = round(CAST(c_acctbal AS DECIMAL(18,2)), 1)) AS equal FROM customer")
def _(t):
    d = F.col("c_acctbal").cast("decimal(18,2)")
    return t.customer.agg(F.count_if(eq.decimals_equal(F.round(d, 0), F.round(d, 1), 1)).alias("equal"))


@query("values_equal", rf"SELECT count(*) FILTER (regexp_replace(t.name, '{_W}+\z', '') = c.c_name) AS equal FROM {{dirty_customer}} t JOIN customer c ON t.c_custkey = c.c_custkey")
def _(t):
    both = t.dirty_customer.select("c_custkey", "name").join(t.customer.select("c_custkey", "c_name"), "c_custkey")
    return both.agg(F.count_if(eq.values_equal(F.col("name"), F.col("c_name"), "text")).alias("equal"))


@query("compare_json", "SELECT 'EQUAL' AS verdict, count(*) AS n FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT 'DIFFERENT', count(*) FROM events WHERE event_id % 3 = 0")
def _(t):
    ship_package(t.spark)
    other = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.replace(F.col("props"), F.lit(":"), F.lit(" : ")))
    return t.events.groupBy(eq.compare_json(F.col("props"), other).alias("verdict")).agg(F.count("*").alias("n"))


@query("classify_difference", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'VALUE_LOST' WHEN o_orderkey % 3 = 1 THEN 'VALUE_TRUNCATED' ELSE 'VALUE_MISMATCH' END AS type, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    m, p = F.col("o_orderkey") % 3, F.col("o_orderpriority")
    return t.orders.groupBy(eq.classify_difference(p, F.when(m == 1, F.left(p, F.lit(4))).when(m == 2, F.lit("zzz")), 4).alias("type")).agg(F.count("*").alias("n"))


@query("compare_binary", "SELECT count(*) AS equal FROM customer")
def _(t):
    n = F.col("c_name")
    return t.customer.agg(F.count_if(eq.binary_equal(F.concat(F.lit("\\x"), F.hex(n.cast("binary"))), F.base64(n.cast("binary")))).alias("equal"))


# -- comparison

_SIDES = """WITH l AS (SELECT o_orderkey AS k, min(o_orderstatus) AS s, min(o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT o_orderkey AS k, min(o_orderstatus) AS s, min(o_orderpriority) AS p, count(*) AS n FROM {changed_orders} t GROUP BY 1),
b AS (SELECT coalesce(l.k, r.k) AS k, coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn, l.s AS ls, r.s AS rs, l.p AS lp, r.p AS rp FROM l FULL JOIN r ON l.k = r.k),
v AS (SELECT *, CASE WHEN ln = 1 AND rn = 1 THEN CASE WHEN ls <> rs OR lp <> rp THEN 'VALUE_DIFFERS' ELSE 'MATCHED' END WHEN ln = 1 THEN 'ONLY_IN_LEFT' WHEN ln = 0 AND rn = 1 THEN 'ONLY_IN_RIGHT' ELSE 'DUPLICATE_KEY' END AS verdict FROM b) """


def _pairs(t: Inputs) -> DataFrame:
    return compare.pair(t.orders, t.changed_orders, ["o_orderkey"], ["o_orderkey"], [compare.Field("o_orderstatus", "o_orderstatus"), compare.Field("o_orderpriority", "o_orderpriority")])


@query("compare_totals", _SIDES + "SELECT CAST(sum(ln) AS BIGINT) AS left_records, CAST(sum(rn) AS BIGINT) AS right_records, count(*) FILTER (verdict = 'MATCHED') AS matched, count(*) FILTER (verdict = 'VALUE_DIFFERS') AS different, count(*) FILTER (verdict = 'ONLY_IN_LEFT') AS only_in_left, count(*) FILTER (verdict = 'ONLY_IN_RIGHT') AS only_in_right, true AS reconciles FROM v")
def _(t):
    return compare.totals(_pairs(t)).select("left_records", "right_records", "matched", "different", "only_in_left", "only_in_right", "reconciles")


@query("J1_compare_key_join", _SIDES + "SELECT CAST(k AS VARCHAR) AS key, ln AS left_rows, rn AS right_rows, verdict FROM v")
def _(t):
    return _pairs(t).select("key", "left_rows", "right_rows", "verdict")


@query("compare_differences", _SIDES + "SELECT CAST(k AS VARCHAR) AS key, verdict AS type, 'o_orderstatus' AS field, ls AS left_value, rs AS right_value FROM v WHERE verdict = 'VALUE_DIFFERS' AND ls <> rs UNION ALL SELECT CAST(k AS VARCHAR), verdict, NULL, NULL, NULL FROM v WHERE verdict NOT IN ('VALUE_DIFFERS', 'MATCHED')")
def _(t):
    return compare.differences(_pairs(t))


@query("compare_duplicates", "SELECT CAST(l_orderkey AS VARCHAR) || chr(31) || CAST(l_linenumber AS VARCHAR) AS key, count(*) AS left_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(t):
    pairs = compare.pair(t.lineitem, t.lineitem.limit(0), ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"], [])
    return pairs.where("verdict = 'DUPLICATE_KEY'").select("key", "left_rows")


@query("compare_blank_keys", f"SELECT count(*) FILTER ({_blank('email')}) AS left_blank FROM {{dirty_customer}} t")
def _(t):
    c = t.dirty_customer
    return compare.totals(compare.pair(c, c.limit(0), ["email"], ["email"], [])).select("left_blank")


@query("differences_by_type", _SIDES + "SELECT verdict AS type, count(*) AS n FROM v WHERE verdict <> 'MATCHED' GROUP BY 1")
def _(t):
    return compare.differences_by_type(_pairs(t)).withColumnRenamed("records", "n")


@query("compare_datasets", "SELECT * FROM (VALUES ('SCHEMA', 'WARNING'), ('ROW_COUNT', 'WARNING'), ('RECORD_EXISTENCE', 'FAIL'), ('FIELD_VALUES', 'FAIL')) v(check_name, outcome)")
def _(t):
    same = lambda c: compare.Field(c, c)
    return compare.compare_datasets(t.orders, t.changed_orders, [("o_orderkey", "o_orderkey")], [same("o_orderstatus"), same("o_orderpriority"), same("o_totalprice")])


@query("set_reconcile", "SELECT side, count(*) AS n FROM (SELECT 'ONLY_IN_LEFT' AS side, * FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM {changed_orders} t) UNION ALL SELECT 'ONLY_IN_RIGHT', * FROM (SELECT o_orderkey, o_orderstatus FROM {changed_orders} t EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)) GROUP BY 1")
def _(t):
    out = compare.set_reconcile(t.orders.select("o_orderkey", "o_orderstatus"), t.changed_orders.select("o_orderkey", "o_orderstatus"))
    return out.groupBy("side").agg(F.sum("rows").alias("n"))


# -- matching and deciding

@query("match_primary_id", "SELECT c_custkey AS source_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS target_id, CAST(NULL AS VARCHAR) AS conflict FROM customer")
def _(t):
    return match.by_primary_id(t.customer, t.old_customer, "c_custkey", "id")


@query("match_alternate_key", "SELECT c.c_custkey AS source_id, o.id AS target_id, CAST(NULL AS VARCHAR) AS conflict FROM customer c LEFT JOIN {old_customer} o ON lower(c.c_name) = lower(o.title)")
def _(t):
    return match.by_key(t.customer, t.old_customer, "c_custkey", "id", ["c_name"], ["title"], business=False)


_BUSINESS = f"""WITH s AS (SELECT c_custkey AS source_id, CASE WHEN NOT {_blank('email')} THEN c_mktsegment END AS k FROM {{dirty_customer}} t), n AS (SELECT k, count(*) AS c FROM (SELECT segment AS k FROM {{old_customer}} t) GROUP BY 1),
m AS (SELECT source_id, s.k, row_number() OVER (PARTITION BY s.k ORDER BY source_id) AS seen, c FROM s LEFT JOIN n ON s.k = n.k) """


#: The same over all rows of both tables, a verdict each.
_BUSINESS_WHOLE = f"""WITH s AS (SELECT c_custkey AS source_id, CASE WHEN NOT {_blank('email')} THEN c_mktsegment END AS k FROM {{dirty_customer}} t), n AS (SELECT lower(segment) AS k, count(*) AS c, min(id) AS id FROM {{old_customer}} t GROUP BY 1),
m AS (SELECT source_id, s.k, row_number() OVER (PARTITION BY lower(s.k) ORDER BY source_id) AS seen, c, n.id FROM s LEFT JOIN n ON lower(s.k) = n.k),
v AS (SELECT *, CASE WHEN k IS NULL THEN 'BUSINESS_KEY_INCOMPLETE' WHEN seen > 1 THEN 'DUPLICATE_SOURCE_KEY' WHEN c > 1 THEN 'AMBIGUOUS_TARGET_MATCH' END AS conflict FROM m)
SELECT source_id, CASE WHEN conflict IS NULL THEN id END AS target_id, conflict FROM v"""


@query("match_business_key", _BUSINESS + "SELECT CASE WHEN k IS NULL THEN 'BUSINESS_KEY_INCOMPLETE' WHEN seen > 1 THEN 'DUPLICATE_SOURCE_KEY' WHEN c > 1 THEN 'AMBIGUOUS_TARGET_MATCH' END AS conflict, count(*) AS n FROM m GROUP BY 1")
def _(t):
    s = t.dirty_customer.withColumn("segment", F.when(~tx.is_blank(F.col("email")), F.col("c_mktsegment")))
    return match.by_key(s, t.old_customer, "c_custkey", "id", ["segment"], ["segment"]).groupBy("conflict").agg(F.count("*").alias("n"))


@query("J5_business_key", _BUSINESS_WHOLE)
def _(t):
    s = t.dirty_customer.withColumn("segment", F.when(~tx.is_blank(F.col("email")), F.col("c_mktsegment")))
    return match.by_key(s, t.old_customer, "c_custkey", "id", ["segment"], ["segment"]).select("source_id", "target_id", "conflict")


@query("first_claim", "SELECT id, source_id FROM (SELECT c_nationkey AS id, c_custkey AS source_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r = 1")
def _(t):
    m = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("target_id"), F.lit(None).cast("string").alias("conflict"))
    return match.with_claims(m).where("target_id is not null").select(F.col("target_id").alias("id"), "source_id")


@query("seen_key", "SELECT count(*) - count(DISTINCT lower(c_mktsegment)) AS late FROM customer")
def _(t):
    out = match.by_key(t.customer, t.customer.limit(0), "c_custkey", "c_custkey", ["c_mktsegment"], ["c_mktsegment"])
    return out.agg(F.count_if(F.col("conflict") == "DUPLICATE_SOURCE_KEY").alias("late"))


@query("latest_mapping", "SELECT l_orderkey AS source_id, max(l_linenumber) AS target_id FROM lineitem GROUP BY 1")
def _(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("target_id"), F.lit("CREATED").alias("outcome"), F.lit("r").alias("run_id"), F.col("l_linenumber").alias("updated_at"))
    return match.latest_mapping(m, "r")


@query("resolve_lookup", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 1000000 WHEN o_custkey % 100 <> 0 THEN o_custkey END AS target FROM orders")
def _(t):
    m = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") + 1000000).alias("target_id"))
    return match.resolve_lookup(t.orders, "o_custkey", m, t.some_customer.select("c_custkey"), "target").select("o_orderkey", "target")


_ACTION = "CASE WHEN o.id IS NULL THEN 'CREATE' ELSE {existing} END"
_EXISTING = {"SKIP_EXISTING": "'UNCHANGED'", "CREATE_ONLY": "'CONFLICT'", "UPSERT": "CASE WHEN c.c_name <> o.title OR c.c_mktsegment <> o.segment THEN 'UPDATE' ELSE 'UNCHANGED' END", "SYNC": "CASE WHEN c.c_name <> o.title OR c.c_mktsegment <> o.segment THEN 'UPDATE' ELSE 'UNCHANGED' END"}


def _acts(t: Inputs, strategy: str) -> DataFrame:
    m = match.by_primary_id(t.customer, t.old_customer, "c_custkey", "id")
    return match.preflight(t.customer, t.old_customer, m, "c_custkey", "id", [("c_name", "title"), ("c_mktsegment", "segment")], strategy)


for _strategy, _existing in _EXISTING.items():
    query(f"decide_action_{_strategy.lower()}", f"SELECT c.c_custkey AS source_id, {_ACTION.format(existing=_existing)} AS action FROM customer c LEFT JOIN {{old_customer}} o ON c.c_custkey = o.id")(
        lambda t, s=_strategy: _acts(t, s).select("source_id", "action")
    )


@query("preflight_totals", f"SELECT {_ACTION.format(existing=_EXISTING['UPSERT'])} AS action, count(*) AS records FROM customer c LEFT JOIN {{old_customer}} o ON c.c_custkey = o.id GROUP BY 1")
def _(t):
    return match.action_totals(_acts(t, "UPSERT"))


@query("compute_changes", "SELECT c.c_custkey AS source_id, concat_ws(',', CASE WHEN c.c_mktsegment <> o.segment THEN 'segment' END, CASE WHEN c.c_name <> o.title THEN 'title' END) AS changes FROM customer c JOIN {old_customer} o ON c.c_custkey = o.id")
def _(t):
    return _acts(t, "SYNC").where("changes is not null").select("source_id", "changes")


@query("principal_match", "SELECT c_custkey AS source_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS target_id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'email' ELSE 'title' END AS tier, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 90 ELSE 70 END AS confidence FROM customer")
def _(t):
    mail = lambda c: F.concat(F.lower(c), F.lit("@example.com"))
    s = t.customer.select(F.col("c_custkey").alias("sid"), mail("c_name").alias("email"), F.col("c_name").alias("title"))
    u = t.old_customer.select(F.col("id").alias("tid"), F.when(F.col("id") % 3 == 0, F.upper(mail("title"))).alias("email"), "title")
    return match.principals(s, u, [("email", 90), ("title", 70)], "sid", "tid").select("source_id", "target_id", "tier", "confidence")


@query("filter_differences", _SIDES + "SELECT key, type FROM (SELECT CAST(k AS VARCHAR) AS key, verdict AS type FROM v WHERE verdict = 'ONLY_IN_LEFT') WHERE key > '2' ORDER BY key LIMIT 30")
def _(t):
    return compare.filter_differences(compare.differences(_pairs(t)), "ONLY_IN_LEFT", after=("2", "ONLY_IN_LEFT", ""), most=30).select("key", "type")


@query("resume_anti_join", "SELECT count(*) AS left_over FROM customer WHERE c_custkey % 4 = 0")
def _(t):
    done = t.old_customer.select(F.col("id").alias("c_custkey"))
    return t.customer.join(done, "c_custkey", "left_anti").agg(F.count("*").alias("left_over"))


# -- validation

@query("validate", """SELECT 'ROW_COUNT' AS check_name, 'FAIL' AS outcome, (SELECT count(*) FROM customer) - (SELECT count(*) FROM {old_customer} t) AS affected UNION ALL SELECT 'RECORD_EXISTENCE', 'FAIL', (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0) UNION ALL SELECT 'FIELD_VALUES', 'FAIL', (SELECT count(*) FROM customer c JOIN {old_customer} o ON c.c_custkey = o.id WHERE c.c_name <> o.title)
UNION ALL SELECT 'REFERENCES', 'FAIL', (SELECT count(*) FROM {old_customer} t WHERE id % 10 = 0) UNION ALL SELECT 'UNIQUENESS', 'PASS', 0 UNION ALL SELECT 'AGGREGATES', 'FAIL', 2 + CAST((SELECT min(c_custkey) FROM customer) <> (SELECT min(id) FROM {old_customer} t) AS INTEGER) + CAST((SELECT max(c_custkey) FROM customer) <> (SELECT max(id) FROM {old_customer} t) AS INTEGER) UNION ALL SELECT 'SCHEMA', 'WARNING', 8""")
def _(t):
    mapping = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_custkey").alias("target_id"))
    schemas = md.table_of("customer", t.customer.schema), md.table_of("old_customer", t.old_customer.schema)
    return validate.validate(t.customer, t.old_customer, mapping, "c_custkey", "id", [("c_name", "title", None)], [("id", t.customer.where("c_custkey % 10 <> 0"), "c_custkey")], ["id"], [("c_custkey", "id")], schemas)


@query("compare_records", """WITH b AS (SELECT c_custkey, c_custkey % 4 = 0 AS gone, c_custkey % 5 = 0 AS old, c_name AS n, o.title AS t, c_mktsegment AS s, o.segment AS g FROM customer c LEFT JOIN {old_customer} o ON c.c_custkey = o.id)
SELECT c_custkey AS source_id, NULL AS field, 'MISSING_IN_TARGET' AS type, 'FAIL' AS outcome FROM b WHERE gone UNION ALL SELECT c_custkey, 'title', CASE WHEN old THEN 'PRE_EXISTING_DIFFERENCE' ELSE 'VALUE_MISMATCH' END, CASE WHEN old THEN 'WARNING' ELSE 'FAIL' END FROM b WHERE NOT gone AND upper(n) <> t
UNION ALL SELECT c_custkey, 'segment', 'NOT_COMPARABLE', 'INCOMPLETE' FROM b WHERE NOT gone AND s = 'BUILDING' UNION ALL SELECT c_custkey, 'segment', CASE WHEN old THEN 'PRE_EXISTING_DIFFERENCE' ELSE 'VALUE_MISMATCH' END, CASE WHEN old THEN 'WARNING' ELSE 'FAIL' END FROM b WHERE NOT gone AND s <> 'BUILDING' AND s <> g""")
def _(t):
    k = F.col("c_custkey")
    mapping = t.customer.select(k.alias("source_id"), k.alias("target_id"), F.when(k % 5 == 0, "SKIPPED").otherwise("UPDATED").alias("outcome"))
    known = {"entries": {s: s for s in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")}, "unmapped": "BLOCK"}
    return validate.compare_records(t.customer, t.old_customer, mapping, "c_custkey", "id", [("c_name", "title", None), ("c_mktsegment", "segment", None)], {"c_name": [Step("UPPERCASE")], "c_mktsegment": [Step("VALUE_MAP", known)]})


@query("agg_reconcile", "WITH a AS (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders), b AS (SELECT CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders WHERE o_orderkey % 50 <> 0) SELECT m AS measure, CASE WHEN x = y THEN 'PASS' ELSE 'FAIL' END AS outcome FROM (SELECT 'COUNT' AS m, CAST((SELECT count(*) FROM a) AS VARCHAR) AS x, CAST((SELECT count(*) FROM b) AS VARCHAR) AS y UNION ALL SELECT 'TOTAL', CAST((SELECT sum(v) FROM a) AS VARCHAR), CAST((SELECT sum(v) FROM b) AS VARCHAR) UNION ALL SELECT 'LOWEST', CAST((SELECT min(v) FROM a) AS VARCHAR), CAST((SELECT min(v) FROM b) AS VARCHAR) UNION ALL SELECT 'HIGHEST', CAST((SELECT max(v) FROM a) AS VARCHAR), CAST((SELECT max(v) FROM b) AS VARCHAR))")
def _(t):
    return validate.aggregates_agree(t.orders, t.orders.where("o_orderkey % 50 <> 0"), [("o_totalprice", "o_totalprice")]).select("measure", "outcome")


@query("aggregate_pushdown", "SELECT 'o_totalprice' AS column_name, count(*) AS count, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total, CAST(min(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS lowest, CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS highest FROM orders")
def _(t):
    return validate.aggregate_pushdown(t.orders, ["o_totalprice"])


@query("J7_validation_pairing", "SELECT c_custkey AS source_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS target_id, c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 AS in_target FROM customer")
def _(t):
    mapping = t.customer.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("source_id"), F.col("c_custkey").alias("target_id"))
    return validate.pairing(t.customer, t.old_customer, mapping, "c_custkey", "id")


@query("J18_duplicate_attribution", "SELECT c_nationkey, CASE WHEN count(*) FILTER (r <= 5 AND c_custkey % 3 = 0) > 0 THEN true WHEN count(*) > 5 THEN NULL ELSE false END AS attributable FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_custkey AS VARCHAR)) AS r FROM customer) GROUP BY 1 HAVING count(*) > 1")
def _(t):
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("id"))
    least = t.customer.select("c_nationkey", F.col("c_custkey").cast("string").alias("id")).withColumn("rank", rank).where("rank <= 5")  # Spark limits each partition before it shuffles
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("count")).where("count > 1")
    groups = counts.join(least.groupBy("c_nationkey").agg(F.collect_list("id").alias("ids")), "c_nationkey")
    written = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("target_id"))
    return validate.duplicate_attribution(groups, ["c_nationkey"], "ids", written)


@query("J13_schema_full_join", "SELECT coalesce(a.n, b.n) AS column_name, a.n IS NOT NULL AS in_source, b.n IS NOT NULL AS in_target FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS n) a FULL JOIN (SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_orderpriority', 'o_custkey']) AS n) b ON a.n = b.n")
def _(t):
    return sheets.join_schemas(t.spark, [md.table_of("orders", t.orders.schema)], [md.table_of("orders", t.changed_orders.schema)]).select("column_name", "in_source", "in_target")


@query("outcome_counts", "SELECT o_orderpriority AS table_name, count(*) FILTER (o_orderstatus = 'O') AS created, count(*) FILTER (o_orderstatus = 'F') AS updated, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus IN ('O', 'F')) AS written, count(*) AS accounted FROM orders GROUP BY 1")
def _(t):
    s = F.col("o_orderstatus")
    r = t.orders.select(F.col("o_orderpriority").alias("table_name"), F.when(s == "O", "CREATED").when(s == "F", "UPDATED").otherwise("FAILED").alias("outcome"))
    return validate.outcome_counts(r).select("table_name", "created", "updated", "failed", "written", "accounted")


@query("attempt_metrics", """WITH r AS (SELECT user_id % 3 AS attempt, CASE event_id % 4 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'UPDATED' WHEN 2 THEN 'FAILED' ELSE 'UNCHANGED' END AS outcome, ts, user_id FROM events)
SELECT attempt, count(*) FILTER (outcome = 'CREATED') AS created, count(*) FILTER (outcome = 'UPDATED') AS updated, count(*) FILTER (outcome = 'UNCHANGED') AS unchanged, 0 AS skipped, count(*) FILTER (outcome = 'FAILED') AS failed, 0 AS unresolved, min(ts) AS first_at, max(ts) AS last_at, CASE WHEN attempt > 0 THEN count(DISTINCT user_id) FILTER (outcome = 'FAILED') END AS problem_records FROM r GROUP BY 1""")
def _(t):
    m = F.col("event_id") % 4
    r = t.events.select((F.col("user_id") % 3).alias("attempt"), F.when(m == 0, "CREATED").when(m == 1, "UPDATED").when(m == 2, "FAILED").otherwise("UNCHANGED").alias("outcome"), F.col("ts").alias("updated_at"), F.col("user_id").alias("source_id"))
    return runs.attempt_metrics(r, r.where("outcome = 'FAILED' and attempt > 0"))


@query("value_frequency", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def _(t):
    return src.value_frequency(t.part, "p_brand")


@query("coverage", "SELECT o_orderpriority AS priority, CASE WHEN p = 0 AND x > 0 THEN 0.1 WHEN p >= 100 AND x < n THEN 99.9 ELSE p END AS percent FROM (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS x, floor(count(*) FILTER (o_orderkey % 3 = 0) * 1000.0 / count(*) + 0.5) / 10.0 AS p FROM orders GROUP BY 1)")
def _(t):
    g = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("x"))
    return g.select("priority", validate.coverage_percent(F.col("x"), F.col("n")).alias("percent"))


@query("coverage_mode", "SELECT 'NOT_VERIFIED' AS mode, count(*) AS eligible, count(*) FILTER (o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_orderkey % 3 = 0)) AS examined, CASE WHEN p = 0 THEN 0.1 ELSE p END AS percent FROM (SELECT *, floor(count(*) FILTER (o_orderpriority = '1-URGENT' OR (o_orderpriority = '2-HIGH' AND o_orderkey % 3 = 0)) OVER () * 1000.0 / count(*) OVER () + 0.5) / 10.0 AS p FROM orders) GROUP BY p")
def _(t):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    g = t.orders.groupBy(p).agg(F.count("*").alias("eligible"), F.count_if((p == "1-URGENT") | ((p == "2-HIGH") & (k % 3 == 0))).alias("examined"))
    return validate.combined_coverage(g.withColumn("mode", validate.coverage_mode(F.col("examined"), F.col("eligible"))))


# -- findings

_READ = {"name": "text", "email": "text", "amount": "number", "code": "text", "born": "datetime", "flag": "text", "phone": "text"}


def _fact_sql(f: str, reads: str) -> str:
    """A row of what the rules of findings() ask about one text column of dirty_customer."""
    v = _trim(f)
    shape = f"CASE WHEN {v} IS NULL OR {v} = '' THEN 'BLANK' WHEN regexp_matches({v}, '^-?\\d+(\\.\\d+)?\\z') THEN 'NUMBER' WHEN regexp_matches({v}, '^\\$\\d+(\\.\\d+)?\\z') THEN 'CURRENCY' WHEN lower({v}) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f', 'on', 'off') THEN 'BOOLEAN' WHEN regexp_matches({v}, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\z') OR (regexp_matches({v}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}\\z') AND TRY_CAST({v} AS DATE) IS NOT NULL) THEN 'DATE' ELSE 'TEXT' END"
    bad = {"number": f"NOT regexp_matches({v}, {_NUM})", "datetime": f"(NOT regexp_matches({v}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}\\z') OR TRY_CAST({v} AS DATE) IS NULL)"}.get(reads, "false")
    return f"""SELECT '{f}' AS field, count(*) AS examined, count(*) FILTER (v IS NULL OR v = '') AS empty, count(*) FILTER (v <> '' AND v <> raw) AS spaced, count(DISTINCT raw) AS distinct_count, count(raw) - count(DISTINCT raw) AS duplicate_count, count(*) FILTER (bad) AS invalid,
max(length(raw)) AS longest, floor(avg(length(raw)) * 10 + 0.5) / 10 AS usual, count(*) FILTER (shape = 'NUMBER') AS numbers, count(*) FILTER (shape = 'CURRENCY') AS money, count(*) FILTER (shape = 'BOOLEAN') AS booleans, count(*) FILTER (shape = 'DATE') AS dates, count(*) FILTER (shape = 'TEXT') AS texts, count(DISTINCT lower(v)) FILTER (shape = 'BOOLEAN') AS spellings,
'{reads}' = 'datetime' AS dated, count(DISTINCT v) FILTER (regexp_matches(v, '^[^\\s@]+@[^\\s@.]+\\.[^\\s@]{{2,}}\\z')) AS mails, count(DISTINCT v) FILTER (v <> '' AND NOT regexp_matches(v, '^[^\\s@]+@[^\\s@.]+\\.[^\\s@]{{2,}}\\z')) AS others, count(*) FILTER (v <> '' AND NOT regexp_matches(v, '^[^\\s@]+@[^\\s@.]+\\.[^\\s@]{{2,}}\\z')) AS other_rows, count(DISTINCT v) FILTER (v <> '') AS held, count(DISTINCT v) FILTER (regexp_matches(v, '^-?0\\d')) AS zeros
FROM (SELECT {f} AS raw, {v} AS v, {shape} AS shape, NOT {_blank(f)} AND {bad} AS bad FROM {{dirty_customer}} t)"""


_FINDINGS = f"""WITH f AS ({" UNION ALL ".join(_fact_sql(f, r) for f, r in _READ.items())}),
s AS (SELECT *, CASE WHEN mails >= 0.8 * held THEN 'EMAIL' WHEN zeros >= 0.8 * held THEN 'IDENTIFIER' WHEN field = 'flag' AND examined >= 125 THEN 'CATEGORICAL' END AS semantic, numbers + money + booleans + dates + texts AS populated, greatest(numbers, money, dates, texts) AS most FROM f),
k AS (SELECT *, distinct_count = examined AND empty = 0 AND (field = 'code' OR semantic = 'IDENTIFIER') AS candidate FROM s),
found AS (SELECT field, 'CANDIDATE_KEY' AS rule, 'INFO' AS severity, 0 AS affected FROM k WHERE candidate
UNION ALL SELECT field, 'KEY_MISSING_VALUES', 'CRITICAL', empty FROM k WHERE field = 'name' AND empty > 0 UNION ALL SELECT field, 'DUPLICATE_KEYS', 'CRITICAL', duplicate_count FROM k WHERE field = 'name' AND duplicate_count > 0
UNION ALL SELECT field, 'MONEY_AS_TEXT', 'WARNING', money FROM k WHERE money > 0
UNION ALL SELECT field, 'MIXED_VALUE_TYPES', 'WARNING', populated - most FROM k WHERE NOT (money > 0 AND dates = 0 AND texts = 0) AND (CAST(numbers > 0 AS INTEGER) + CAST(money > 0 AS INTEGER) + CAST(dates > 0 AS INTEGER) + CAST(texts > 0 AS INTEGER)) > 1 AND populated > most AND floor((populated - most) * 1000.0 / populated + 0.5) >= 50
UNION ALL SELECT field, 'INCONSISTENT_BOOLEAN', 'WARNING', booleans FROM k WHERE spellings > 2
UNION ALL SELECT field, 'NEARLY_UNIQUE_DUPLICATES', 'WARNING', duplicate_count FROM k WHERE field <> 'name' AND duplicate_count > 0 AND distinct_count >= 0.98 * examined AND distinct_count <> examined
UNION ALL SELECT field, 'HIGH_NULL_RATE', CASE WHEN field = 'email' THEN 'CRITICAL' ELSE 'WARNING' END, empty FROM k WHERE empty < examined AND empty >= 0.25 * examined
UNION ALL SELECT field, 'INVALID_DATES', 'CRITICAL', invalid FROM k WHERE dated AND invalid > 0 UNION ALL SELECT field, 'INVALID_VALUES', 'WARNING', invalid FROM k WHERE invalid > 0
UNION ALL SELECT field, 'WHITESPACE', 'WARNING', spaced FROM k WHERE spaced > 0 UNION ALL SELECT field, 'LENGTH_SPREAD', 'INFO', 0 FROM k WHERE longest >= 40 AND usual > 0 AND longest >= 8 * usual
UNION ALL SELECT field, 'INVALID_EMAIL', 'WARNING', other_rows FROM k WHERE semantic = 'EMAIL' AND others > 0 UNION ALL SELECT field, 'IDENTIFIER_AS_TEXT', 'INFO', 0 FROM k WHERE semantic = 'IDENTIFIER' UNION ALL SELECT field, 'CATEGORICAL_VALUES', 'INFO', 0 FROM k WHERE semantic = 'CATEGORICAL'
UNION ALL SELECT NULL, 'NO_RELIABLE_KEY', 'CRITICAL', max(examined) FROM k HAVING NOT bool_or(candidate) AND max(examined) > 0 UNION ALL SELECT NULL, 'POSSIBLE_PII', 'INFO', 0)"""
_DIMENSION = f"CASE {' '.join(f"WHEN rule = '{r}' THEN '{'IDENTITY' if c == 'DUPLICATES' else c}'" for r, c in findings.CATEGORIES.items() if c != 'PRIVACY')} END"
_SCORED = _FINDINGS + f""", d AS (SELECT {_DIMENSION} AS dimension, severity FROM found WHERE rule NOT IN ('CANDIDATE_KEY', 'CATEGORICAL_VALUES', 'IDENTIFIER_AS_TEXT', 'POSSIBLE_PII')),
n AS (SELECT v.dimension, count(*) FILTER (severity = 'CRITICAL') AS criticals, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos FROM (VALUES ('IDENTITY'), ('COMPLETENESS'), ('CONSISTENCY'), ('VALIDITY'), ('TYPE_COMPATIBILITY'), ('RELATIONSHIPS')) v(dimension) LEFT JOIN d ON d.dimension = v.dimension GROUP BY 1),
score AS (SELECT dimension, CASE WHEN dimension <> 'RELATIONSHIPS' THEN greatest(0, 100 - 35 * criticals - 10 * warnings - 2 * infos) END AS score, criticals, warnings, infos FROM n) """


def _found(t: Inputs) -> DataFrame:
    p = profile.profile(t.dirty_customer, "people", list(_READ), {f: r for f, r in _READ.items() if r != "text"})
    return findings.findings(p, infer.semantic_types(t.dirty_customer, list(_READ)), ("name",), ("email",))


@query("findings_table", _FINDINGS + "SELECT field, rule, severity, affected FROM found")
def _(t):
    return _found(t).select("field", "rule", "severity", "affected")


@query("findings_semantic", "SELECT * FROM (VALUES ('mail', 'INVALID_EMAIL', 'WARNING'), ('price', 'CURRENCY_AS_TEXT', 'WARNING'), ('rate', 'PERCENTAGE_AS_TEXT', 'WARNING'), ('call', 'PHONE_FORMAT', 'INFO'), ('code', 'IDENTIFIER_AS_TEXT', 'INFO'), ('segment', 'CATEGORICAL_VALUES', 'INFO'), ('start_date', 'DATE_AS_NUMBER', 'WARNING')) v(field, rule, severity)")
def _(t):
    k = F.col("c_custkey").cast("string")
    c = t.dirty_customer.select(
        F.when(F.col("c_custkey") % 10 == 0, "nobody").otherwise(F.concat(k, F.lit("@a.example"))).alias("mail"), F.concat(F.lit("$1,2,"), k).alias("price"), F.concat((F.col("c_custkey") % 90).cast("string"), F.lit("%")).alias("rate"),
        F.concat(F.lit("+1 555 "), F.lpad(k, 7, "0")).alias("call"), "code", F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 1000 + 40000).cast("string").alias("start_date"),
    )
    found = findings.findings(profile.profile(c, "people"), infer.semantic_types(c, c.columns))
    return findings.filter_findings(found.where(F.col("rule").isin("DATE_AS_NUMBER", "INVALID_EMAIL", "PHONE_FORMAT", "CATEGORICAL_VALUES", "IDENTIFIER_AS_TEXT", "CURRENCY_AS_TEXT", "PERCENTAGE_AS_TEXT"))).select("field", "rule", "severity")


@query("duplicate_business_key", "SELECT 'order_ref' AS field, 'WARNING' AS severity, count(*) FILTER (o_orderkey % 500 = 0) AS affected, false AS alone FROM orders HAVING count(*) FILTER (o_orderkey % 500 = 0) > 1 UNION ALL SELECT 'order_ref', 'CRITICAL', count(*) FILTER (o_orderkey % 500 = 0), true FROM orders HAVING count(*) FILTER (o_orderkey % 500 = 0) > 1")
def _(t):
    of = lambda columns, alone: findings.findings(profile.profile(t.coded_orders, "orders", columns)).where("rule = 'DUPLICATE_BUSINESS_KEY'").select("field", "severity", "affected", F.lit(alone).alias("alone"))
    return of(["order_id", "order_ref", "customer_no"], False).unionAll(of(["order_ref", "customer_no"], True))


@query("filter_findings", _FINDINGS + "SELECT rule, field, severity FROM found WHERE severity = 'WARNING' ORDER BY rule, coalesce(field, '') LIMIT 4")
def _(t):
    return findings.filter_findings(_found(t), table="people", severity="WARNING", most=4).select("rule", "field", "severity")


@query("readiness_score", _SCORED + "SELECT * FROM score")
def _(t):
    return findings.readiness(_found(t))


@query("readiness_band", _SCORED + "SELECT s AS score, CASE WHEN c >= 3 OR s < 50 THEN 'HIGH_RISK' WHEN c > 0 OR s < 80 THEN 'NEEDS_ATTENTION' ELSE 'READY' END AS band FROM (SELECT CAST(floor(avg(score) + 0.5) AS BIGINT) AS s, (SELECT count(*) FROM d WHERE severity = 'CRITICAL') AS c FROM score)")
def _(t):
    return findings.band(_found(t))


@query("readiness_verdict", "SELECT 'BLOCKED_PENDING_OVERRIDE' AS verdict, count(*) FILTER (n_regionkey = 0) AS blockers, count(*) FILTER (n_regionkey = 1) AS warnings, count(*) FILTER (n_regionkey > 1) AS information, count(*) FILTER (n_regionkey = 0) - 1 AS overridden FROM nation")
def _(t):
    r = F.col("n_regionkey")
    found = t.nation.select(F.lit("RISK").alias("code"), F.col("n_name").alias("object"), F.when(r == 0, "BLOCKER").when(r == 1, "WARNING").otherwise("INFORMATION").alias("severity"), F.lit(True).alias("overridable"))
    accepted = t.nation.where(r == 0).orderBy("n_nationkey").offset(1).select(F.lit("RISK").alias("code"), F.col("n_name").alias("object"))
    return findings.verdict(found, accepted)


@query("near_misses", "SELECT 'order_id' AS field, 1 AS rank UNION ALL SELECT 'order_ref', 2 UNION ALL SELECT 'customer_no', 3")
def _(t):
    return findings.near_misses(profile.profile(t.coded_orders, "orders")).select("field", "rank")


# -- sources, sinks, streams

@query("scan_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    return src.scan_table(t.spark, f"{t.dir}/orders.parquet", ["o_orderstatus", "missing"], "o_orderkey")


@query("scan_incremental", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def _(t):
    return src.scan_incremental(t.events, "ts", "2024-01-20 00:00:00").select("event_id", "ts")


@query("count_records", "SELECT count(*) AS records FROM lineitem")
def _(t):
    return src.count_records(t.lineitem)


@query("retrieve_by_ids", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0)")
def _(t):
    return src.retrieve_by_ids(t.customer, "c_custkey", t.orders.where("o_orderkey % 40 = 0").select("o_custkey")).select("c_custkey", "c_name")


@query("J14_case_insensitive_fallback", "SELECT c_name FROM customer WHERE c_custkey % 7 = 0")
def _(t):
    want = t.customer.where("c_custkey % 7 = 0").select(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("n"))
    return src.retrieve_by_ids(t.customer, "c_name", want, ignore_case=True).select("c_name")


@query("find_by_fields", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(t):
    return src.find_by_fields(t.nation, {"n_regionkey": 1}).select("n_nationkey", "n_name")


@query("find_by_alternate_key", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3")
def _(t):
    return src.find_by_alternate_key(t.nation, {"n_nationkey": 3}).select("n_nationkey", "n_name")


@query("observe_watermark", "SELECT max(ts) AS watermark FROM events")
def _(t):
    return src.observe_watermark(t.events, "ts")


@query("csv_cell", r"""SELECT c_custkey, CASE WHEN regexp_matches(g, '[",\r\n]') THEN '"' || replace(g, '"', '""') || '"' ELSE g END AS cell FROM (SELECT c_custkey, CASE WHEN regexp_matches(v, '^[=+\-@\t\r]') THEN '''' || v ELSE v END AS g FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '=' || name WHEN 1 THEN name || ', "x"' ELSE phone END AS v FROM {dirty_customer} t))""")
def _(t):
    m = F.col("c_custkey") % 4
    v = F.when(m == 0, F.concat(F.lit("="), F.col("name"))).when(m == 1, F.concat(F.col("name"), F.lit(', "x"'))).otherwise(F.col("phone"))
    return t.dirty_customer.select("c_custkey", tx.csv_cell(v).alias("cell"))


@query("sink_lineage", "SELECT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS source_id, 'CREATED' AS outcome FROM customer")
def _(t):
    rows = t.customer.select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("source_id"), F.lit("CREATED").alias("outcome"))
    return src.lineage(rows).select("table_name", "source_id", "outcome")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type AS key, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events GROUP BY 1, 2")
def _(t):
    return incremental.windowed(t.events, "ts", "1 day", "1 hour", "event_type", "value")


_PEOPLE = "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, name, nullif(email, '') AS email, amount, CASE WHEN phone LIKE '+%' THEN '''' || phone ELSE phone END AS phone FROM {dirty_customer} t"
_COLUMNS = ("c_custkey", "name", "email", "amount", "phone")


@query("read_delimited", _PEOPLE)
def _(t):
    path = work_folder(t.spark, "csv")
    src.sink_csv(t.dirty_customer.select(*_COLUMNS), path)
    return files.read_delimited(t.spark, path)


@query("sink_csv", "SELECT count(*) AS lines, count(*) FILTER (guarded) AS guarded FROM (SELECT c_custkey % 4 = 0 AND NOT (name LIKE '%,%') AS guarded FROM {dirty_customer} t)")
def _(t):
    path = work_folder(t.spark, "csv")
    src.sink_csv(t.dirty_customer.select(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("="), "name")).otherwise(F.col("name")).alias("cell")), path)
    return t.spark.read.text(path).where(~F.col("value").contains("cell")).agg(F.count("*").alias("lines"), F.count_if(F.col("value").startswith("'=")).alias("guarded"))


@query("read_xml", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_orderstatus AS \"detail.status\" FROM orders")
def _(t):
    path = work_folder(t.spark, "xml")
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.struct(F.col("o_orderstatus").alias("status")).alias("detail"))
    rows.write.format("xml").option("rootTag", "orders").option("rowTag", "order").save(path)
    return files.read_xml(t.spark, path, "order").select("o_orderkey", "o_orderpriority", "`detail.status`")


@query("prepare_sheet", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS \"name 2\" FROM nation")
def _(t):
    cells = lambda *c: F.array(*[F.col(x).cast("string") if isinstance(x, str) else x for x in c])
    none = F.lit(None).cast("string")
    head = t.spark.createDataFrame([(-3, ["Nations", None, None, None]), (-2, None), (-1, ["id", "name", "name", " "])], "place long, cells array<string>")
    rows = t.nation.select((F.col("n_nationkey") * 2).cast("long").alias("place"), cells("n_nationkey", "n_name", "n_regionkey", none).alias("cells"))
    blank = t.nation.select((F.col("n_nationkey") * 2 + 1).cast("long").alias("place"), cells(F.lit(" "), none, F.lit(""), none).alias("cells"))
    return files.prepare_sheet(head.unionAll(rows).unionAll(blank), "place")[0]


@query("unique_headers", "SELECT * FROM (VALUES (1, 'id'), (2, 'Name'), (3, 'column_3'), (4, 'name 2'), (5, 'a b'), (6, 'Name 3')) v(place, header)")
def _(t):
    return t.spark.createDataFrame(list(enumerate(infer.unique_headers(["id", "Name ", None, "name", "a\tb", "Name"]), 1)), "place int, header string")


@query("infer_key", "SELECT 'order_id' AS key, 'status' AS name")
def _(t):
    types = [r.asDict() for r in infer.infer_types(t.coded_orders.select("customer_no", "status", "order_id")).collect()]  # a row for each column
    return t.spark.createDataFrame([(infer.infer_key(types), infer.infer_name_column(types))], "key string, name string")


@query("infer_name_column", "SELECT 'c_name' AS name")
def _(t):
    types = [r.asDict() for r in infer.infer_types(t.customer.select("c_custkey", "c_mktsegment", "c_name")).collect()]
    return t.spark.createDataFrame([(infer.infer_name_column(types),)], "name string")


@query("staged_store", "SELECT count(*) AS rows, 0 AS first, count(*) - 1 AS last, count(*) AS ordinals, count(*) FILTER (order_ref = 'REF-0') AS repeated FROM {coded_orders} t")
def _(t):
    out = files.staged(t.coded_orders, "order_ref")
    return out.agg(F.count("*").alias("rows"), F.min("_ordinal").alias("first"), F.max("_ordinal").alias("last"), F.count_distinct("_ordinal").alias("ordinals"), F.count_if(F.col("_id") == "REF-0").alias("repeated"))


@query("staged_value_read", f"SELECT c_custkey, CASE WHEN nullif(amount, '') IS NULL THEN NULL WHEN ({_number('amount')}) IS NULL THEN amount ELSE CAST(CAST(trunc({_number('amount')}) AS BIGINT) AS VARCHAR) END AS whole, CASE WHEN lower(flag) IN ('y', 'yes', 'true') THEN 'true' WHEN flag = 'no' THEN 'false' ELSE flag END AS truth, nullif(email, '') AS email FROM {{dirty_customer}} t")
def _(t):
    read = lambda c, kind: convert.staged_value(F.col(c), kind).alias
    return t.dirty_customer.select("c_custkey", read("amount", "Integer")("whole"), read("flag", "Boolean")("truth"), read("email", "String")("email"))


@query("driver_value", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day, base64(encode(o_orderstatus)) AS raw, CAST(o_custkey AS VARCHAR) AS id, 'customer' AS table_name FROM orders")
def _(t):
    v = convert.driver_value
    at = F.col("o_orderdate")
    out = t.orders.select("o_orderkey", v(at, "DateTime").alias("at"), v(at, "DateOnly").alias("day"), v(F.col("o_orderstatus").cast("binary"), "File").alias("raw"), v(F.col("o_custkey"), "BigInt", "customer").alias("ref"))
    return out.select("o_orderkey", "at", "day", "raw", "ref.*")


@query("evidence_verify", "SELECT * FROM (VALUES ('VALID', true), ('INCOMPLETE', false)) v(verdict, there)")
def _(t):
    path = work_folder(t.spark, "evidence")
    src.sink_lineage(t.customer.select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("source_id")), path)
    recorded = src.manifest(t.spark, path)
    gone = recorded.limit(1).select(F.lit("gone.csv").alias("name"), "bytes", "sha256")
    return src.verify_evidence(t.spark, path, recorded.unionAll(gone)).select("verdict", (F.col("name") != "gone.csv").alias("there")).distinct()


@query("display_value", "SELECT doc_id, CASE WHEN length(text) > 256 THEN left(text, 256) || '…' ELSE text END AS shown FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.display_value(F.col("text")).alias("shown"))


@query("mask_secured", "SELECT 'c_mktsegment' AS field, '***' AS value, count(*) AS count FROM customer GROUP BY c_mktsegment")
def _(t):
    return profile.top_values(profile.value_counts(t.customer, ["c_mktsegment"]), secured=["c_mktsegment"]).select("field", "value", "count")


# -- conversion

@query("convert_cross_provider", f"""SELECT c_custkey, CASE WHEN ({_number('amount')}) IS NOT NULL AND floor({_number('amount')}) = ({_number('amount')}) THEN CAST(CAST({_number('amount')} AS BIGINT) AS VARCHAR) END AS whole, CASE WHEN amount IS NULL THEN NULL WHEN ({_number('amount')}) IS NULL THEN 'INVALID_NUMBER' WHEN floor({_number('amount')}) <> ({_number('amount')}) THEN 'FRACTIONAL_VALUE' END AS whole_error,
CASE WHEN length(name) <= 18 THEN name END AS short, CASE WHEN length(name) > 18 THEN 'STRING_TOO_LONG' END AS short_error, CASE WHEN lower(flag) IN ('y', 'yes', 'true') THEN 'true' WHEN flag = 'no' THEN 'false' END AS truth FROM {{dirty_customer}} t""")
def _(t):
    whole, short = convert.cross_provider(F.col("amount"), "Integer"), convert.cross_provider(F.col("name"), "String", 18)
    return t.dirty_customer.select("c_custkey", whole["value"].alias("whole"), whole["error_code"].alias("whole_error"), short["value"].alias("short"), short["error_code"].alias("short_error"), convert.cross_provider(F.col("flag"), "Boolean")["value"].alias("truth"))


@query("convert_same_provider", f"SELECT c_custkey, CAST(CAST(floor(({_number('amount')}) + 0.5) AS BIGINT) AS VARCHAR) AS rounded, left(born, 10) AS day FROM {{dirty_customer}} t")
def _(t):
    return t.dirty_customer.select("c_custkey", convert.same_provider(F.col("amount"), "Integer")["value"].alias("rounded"), convert.same_provider(F.col("born"), "DateOnly")["value"].alias("day"))


# -- runs

@query("failure_categories", "SELECT CASE o_orderstatus WHEN 'P' THEN 'DATA' WHEN 'F' THEN 'TARGET' ELSE 'UNKNOWN' END AS category, CASE o_orderstatus WHEN 'P' THEN 'CORRECTION_REQUIRED' WHEN 'F' THEN 'SAFE_TO_RETRY' ELSE 'RECONCILE_FIRST' END AS retry, count(*) AS records FROM orders GROUP BY 1, 2")
def _(t):
    s = F.col("o_orderstatus")
    return runs.failure_categories(t.orders.select(F.when(s == "P", "INVALID_DATE").when(s == "F", "THROTTLED").otherwise("NEW_CODE").alias("error_code")))


@query("deferred_counts", "SELECT coalesce(CASE WHEN o_orderkey % 5 = 0 THEN 'PENDING' WHEN o_orderkey % 5 = 1 THEN 'DONE' END, 'NONE') AS deferred_status, count(*) AS records FROM orders GROUP BY 1")
def _(t):
    m = F.col("o_orderkey") % 5
    return runs.deferred_counts(t.orders.select(F.when(m == 0, "PENDING").when(m == 1, "DONE").alias("s")), "s")


@query("identity_impact", "SELECT user_id AS principal, count(DISTINCT event_id) AS records, count(DISTINCT event_type) AS fields FROM events GROUP BY 1")
def _(t):
    return runs.identity_impact(t.events, "user_id", "event_id", "event_type")


@query("cap_per_group", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5")
def _(t):
    return runs.cap_per_group(t.orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], 5)


@query("write_state_recovery", "SELECT finding, CASE finding WHEN 'PRESENT' THEN 'CONFIRM' WHEN 'ABSENT' THEN 'RETRY' ELSE 'PERSON' END AS next, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'UNCLEAR' WHEN c_custkey % 4 = 0 THEN 'ABSENT' ELSE 'PRESENT' END AS finding FROM customer) GROUP BY 1, 2")
def _(t):
    k = F.col("c_custkey")
    intents = t.customer.select(k.alias("source_id"), F.lit("CREATE").alias("operation"), F.when(k % 9 != 0, k).alias("evidence"))
    return runs.recover_writes(intents, t.old_customer, "evidence", "id").groupBy("finding", "next").agg(F.count("*").alias("n"))


@query("remediation_package", f"SELECT 'rules' AS origin, 'BLANK_VALUE' AS code, count(*) AS n FROM {{dirty_customer}} t WHERE email IS NOT NULL AND {_blank('email')} UNION ALL SELECT 'references', 'BROKEN_REFERENCE', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {{some_customer}} t)")
def _(t):
    blank = t.dirty_customer.where(F.col("email").isNotNull() & tx.is_blank(F.col("email"))).select(F.col("c_custkey").alias("record_id"), F.lit("BLANK_VALUE").alias("code"))
    broken = relate.broken_references(t.orders, "o_custkey", t.some_customer, "c_custkey").select(F.col("o_orderkey").alias("record_id"), F.lit("BROKEN_REFERENCE").alias("code"))
    return runs.remediation(rules=blank, references=broken).groupBy("origin", "code").agg(F.count("*").alias("n"))


@query("run_accounting", "SELECT count(*) AS accounted, count(*) FILTER (o_orderstatus <> 'P') AS expected_in_target FROM orders")
def _(t):
    s = F.col("o_orderstatus")
    out = validate.outcome_counts(t.orders.select(F.lit("orders").alias("table_name"), F.when(s == "P", "FAILED").otherwise("CREATED").alias("outcome")))
    return out.select("accounted", "expected_in_target")


@query("t_preview", "SELECT source, lower(source) AS value, 'OK' AS status FROM (SELECT DISTINCT c_mktsegment AS source FROM customer ORDER BY 1 LIMIT 25)")
def _(t):
    return tr.preview(t.customer.orderBy("c_custkey"), "c_mktsegment", [Step("LOWERCASE")])


@query("insights_profile", "SELECT 'c_mktsegment' AS field, least(200, count(*)) AS examined, 0 AS null_count FROM customer")
def _(t):
    return profile.profile(t.customer, "customer", ["c_mktsegment"], sample=200, order_by="c_custkey").select("field", "examined", "null_count")


@query("deterministic_prefix", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 500")
def _(t):
    return src.prefix(t.orders.select("o_orderkey"), "o_orderkey", "QUICK")


@query("migrate", """SELECT 'customer' AS table_name, 'CREATED' AS outcome, count(*) AS records FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'customer', 'UPDATED', count(*) FROM customer c JOIN {old_customer} o ON c.c_custkey = o.id WHERE c.c_name <> o.title OR c.c_mktsegment <> o.segment
UNION ALL SELECT 'customer', 'UNCHANGED', count(*) FROM customer c JOIN {old_customer} o ON c.c_custkey = o.id WHERE c.c_name = o.title AND c.c_mktsegment = o.segment UNION ALL SELECT 'orders', 'CREATED', count(*) FROM orders""")
def _(t):
    plan = [
        migrate.Entity("orders", "o_orderkey", "key", [("o_orderkey", "key"), ("o_custkey", "customer")], references={"o_custkey": "customer"}),
        migrate.Entity("customer", "c_custkey", "id", [("c_custkey", "id"), ("c_name", "title"), ("c_mktsegment", "segment")], {"c_name": [Step("TRIM")]}),
    ]
    empty = t.spark.createDataFrame([], "key bigint, customer bigint")
    _, known = migrate.migrate(t.spark, plan, {"orders": t.orders, "customer": t.customer}, {"orders": empty, "customer": t.old_customer}, "run-1", work_table(t.spark, "migrate"))
    return known.groupBy("table_name", "outcome").agg(F.count("*").alias("records"))


# -- planning: rows of metadata

def _tables(t: Inputs) -> dict[str, md.Table]:
    return {n: md.table_of(n, getattr(t, n).schema, getattr(t, n).columns[0]) for n in ("region", "nation", "customer", "orders")}


@query("schema_diff", "SELECT * FROM (VALUES ('customer', 'c_acctbal', 'SOURCE_ONLY'), ('customer', 'c_custkey', 'SOURCE_ONLY'), ('customer', 'c_mktsegment', 'SOURCE_ONLY'), ('customer', 'c_name', 'SOURCE_ONLY'), ('customer', 'c_nationkey', 'SOURCE_ONLY'), ('customer', 'id', 'TARGET_ONLY'), ('customer', 'segment', 'TARGET_ONLY'), ('customer', 'title', 'TARGET_ONLY')) v(table_name, column_name, status)")
def _(t):
    rows = md.schema_diff([md.table_of("customer", t.customer.schema)], [md.table_of("customer", t.old_customer.schema)])
    return t.spark.createDataFrame([(r["table"], r["column"], r["status"]) for r in rows], "table_name string, column_name string, status string")


@query("J10_table_pairing", "SELECT * FROM (VALUES ('customer', 'Customers'), ('nation', 'dbo.Nation'), ('orders', 'order')) v(left_table, right_table)")
def _(t):
    return t.spark.createDataFrame([(a, b) for a, b, _ in md.pair_tables(["customer", "nation", "orders"], ["order", "Customers", "dbo.Nation", "zz"])], "left_table string, right_table string")


@query("J11_field_pairing", "SELECT * FROM (VALUES ('c_name', 'name'), ('c_acctbal', 'acctbal')) v(left_field, right_field)")
def _(t):
    right = md.Table("x", (md.Column("name", "String"), md.Column("acctbal", "Double"), md.Column("other", "String")))
    return t.spark.createDataFrame([(a, b) for a, b, _ in md.pair_fields(md.table_of("customer", t.customer.schema), right)], "left_field string, right_field string")


@query("J12_field_gaps", "SELECT * FROM (VALUES ('LEFT', 'c_acctbal'), ('LEFT', 'c_custkey'), ('LEFT', 'c_mktsegment'), ('LEFT', 'c_nationkey'), ('RIGHT', 'title')) v(side, field)")
def _(t):
    a, b = md.field_gaps(md.table_of("customer", t.customer.schema), md.Table("x", (md.Column("name", "String"), md.Column("title", "String"))))
    return t.spark.createDataFrame([("LEFT", x) for x in a] + [("RIGHT", x) for x in b], "side string, field string")


@query("auto_map", "SELECT * FROM (VALUES ('o_orderkey', 'AUTO_MAPPED'), ('o_custkey', 'AUTO_MAPPED'), ('o_orderstatus', 'AUTO_MAPPED'), ('o_totalprice', 'UNMAPPED'), ('o_orderdate', 'UNMAPPED'), ('o_orderpriority', 'AUTO_MAPPED')) v(source, status)")
def _(t):
    rows = md.auto_map(md.table_of("orders", t.orders.schema), md.table_of("orders", t.changed_orders.schema))
    return t.spark.createDataFrame([(r["source"], r["status"]) for r in rows], "source string, status string")


@query("plan_issues", "SELECT * FROM (VALUES ('UNMAPPED_COLUMNS', 'INFO'), ('UPSERT_OVERWRITES', 'WARNING'), ('DEPENDENCY_NOT_SELECTED', 'INFO')) v(code, severity)")
def _(t):
    a, b = md.table_of("orders", t.orders.schema, "o_orderkey"), md.table_of("orders", t.changed_orders.schema, "o_orderkey")
    refer = lambda x: md.Table(x.name, tuple(md.replace(c, targets=("customer",)) if c.name == "o_custkey" else c for c in x.columns), x.key)
    kept = issues.PlanTable("customer", None, md.table_of("customer", t.customer.schema, "c_custkey"))
    found = issues.plan_issues([issues.PlanTable("orders", refer(a), refer(b), md.auto_map(a, b)), kept])
    return t.spark.createDataFrame([(code, severity) for severity, code, table, _ in found if table != "customer"], "code string, severity string")


@query("dependency_order", "SELECT * FROM (VALUES (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'orders')) v(place, table_name)")
def _(t):
    names = ["orders", "customer", "nation", "region"]
    found = relate.discover({n: getattr(t, n) for n in names}).where("verdict = 'INFERRED'").select("child_table", "parent_table").distinct().collect()  # a row for each reference
    order = md.load_order(names, [(r.child_table, r.parent_table, True) for r in found])
    return t.spark.createDataFrame(list(enumerate(order.tables, 1)), "place int, table_name string")


@query("classify_compatibility", "SELECT * FROM (VALUES ('c_custkey', 'Integer', 'LOSSY'), ('c_name', 'Integer', 'CONVERSION_REQUIRED'), ('c_acctbal', 'Integer', 'LOSSY'), ('c_nationkey', 'Integer', 'COMPATIBLE'), ('c_mktsegment', 'Integer', 'CONVERSION_REQUIRED')) v(column_name, target_type, verdict)")
def _(t):
    target = md.Column("x", "Integer")
    return t.spark.createDataFrame([(c.name, "Integer", md.compatibility(c, target)) for c in md.table_of("customer", t.customer.schema).columns], "column_name string, target_type string, verdict string")


_KEYS = [{"table": n, "kind": "PRIMARY", "columns": [k]} for n, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("orders", "o_orderkey"))] + [
    {"table": c, "kind": "FOREIGN", "columns": [k], "to": p} for c, k, p in (("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer"))
] + [{"table": "nation", "kind": "UNIQUE", "columns": ["n_name"]}]


def _catalog(t: Inputs) -> list[md.Table]:
    return md.discover_catalog({n: getattr(t, n).schema for n in ("region", "nation", "customer", "orders")}, _KEYS)


@query("catalog_discovery", "SELECT * FROM (VALUES ('nation', 'n_nationkey', true, false, ''), ('nation', 'n_name', false, true, ''), ('nation', 'n_regionkey', false, false, 'region'), ('region', 'r_regionkey', true, false, ''), ('region', 'r_name', false, false, '')) v(table_name, column_name, is_key, is_unique, reference)")
def _(t):
    rows = [(n, c, key, unique, to) for n, _, c, _, _, key, unique, to in md.catalog_rows(_catalog(t)) if n in ("nation", "region")]
    return t.spark.createDataFrame(rows, "table_name string, column_name string, is_key boolean, is_unique boolean, reference string")


@query("erd", "SELECT * FROM (VALUES ('region', 0, NULL, NULL), ('nation', 1, 'region', 'n_regionkey'), ('customer', 2, 'nation', 'c_nationkey'), ('orders', 3, 'customer', 'o_custkey')) v(table_name, depth, parent, via)")
def _(t):
    nodes, edges, _ = md.erd(_catalog(t))
    up = {e["child"]: (e["parent"], e["column"]) for e in edges}
    return t.spark.createDataFrame([(n["table"], n["depth"], *up.get(n["table"], (None, None))) for n in nodes], "table_name string, depth int, parent string, via string")


@query("migratable_columns", "SELECT * FROM (VALUES ('TABULAR', 'id'), ('TABULAR', 'title'), ('SQL', 'title')) v(family, column_name)")
def _(t):
    c = md.Column
    of = lambda family: md.Table("t", (c("id", "Integer", writable=False), c("title", "String", writable=False), c("title_name", "String", child_of="title"), c("blob", "File", writable=False), c("hidden", "String", writable=False, readable=False)), "id", family=family)
    return t.spark.createDataFrame([(f, x) for f in ("TABULAR", "SQL") for x in md.migratable_columns(of(f))], "family string, column_name string")


@query("comparable_columns", "SELECT 'title' AS column_name")
def _(t):
    own = md.Table("t", (md.Column("title", "String"), md.Column("ModifiedOn", "DateTime"), md.Column("titlename", "String", child_of="title")))
    return t.spark.createDataFrame([(x,) for x in md.comparable_columns(own)], "column_name string")


@query("schema_filter", "SELECT * FROM (VALUES ('a'), ('c')) v(table_name)")
def _(t):
    tables = [md.Table(n, (), schema=s) for n, s in (("a", "dbo"), ("b", "config"), ("c", "DBO"))]
    return t.spark.createDataFrame([(x.name,) for x in md.schema_filter(tables, ["Dbo"])], "table_name string")


@query("type_compatibility", "SELECT * FROM (VALUES ('Integer', 'BigInt', 'COMPATIBLE', 'COMPATIBLE'), ('Double', 'Integer', 'LOSSY', 'LOSSY'), ('Memo', 'String', 'LOSSY', 'COMPATIBLE'), ('String', 'Integer', 'INCOMPATIBLE', 'CONVERSION_REQUIRED'), ('BigInt', 'Money', 'LOSSY', 'COMPATIBLE'), ('Boolean', 'String', 'INCOMPATIBLE', 'CONVERSION_REQUIRED')) v(source, target, within, across)")
def _(t):
    pairs = [("Integer", "BigInt"), ("Double", "Integer"), ("Memo", "String"), ("String", "Integer"), ("BigInt", "Money"), ("Boolean", "String")]
    rows = [(a, b, md.field_verdict(md.Column("x", a), md.Column("x", b)), md.field_verdict(md.Column("x", a), md.Column("x", b), True)) for a, b in pairs]
    return t.spark.createDataFrame(rows, "source string, target string, within string, across string")


@query("object_map", "SELECT * FROM (VALUES ('dbo.Customer', 'AUTO_SUGGESTED', 'account', 80), ('orders', 'EXACT', 'orders', 100), ('zzz', 'UNMAPPED', NULL, NULL)) v(source, status, target, confidence)")
def _(t):
    rows = []
    for name in ("dbo.Customer", "orders", "zzz"):
        status, found = md.object_map(name, ["account", "orders", "salesorder", "xy_region"])
        rows.append((name, status, *(found[0] if found else (None, None))))
    return t.spark.createDataFrame(rows, "source string, status string, target string, confidence int")


@query("compare_suggest", "SELECT 'c_custkey' AS left_key, 'custkey' AS right_key, 2 AS fields")
def _(t):
    right = md.Table("client", (md.Column("custkey", "BigInt"), md.Column("name", "String"), md.Column("acctbal", "Double"), md.Column("createdon", "DateTime")), "custkey")
    found = md.suggest_comparison(next(x for x in _catalog(t) if x.name == "customer"), right)
    return t.spark.createDataFrame([(*found["key"][0], len(found["fields"]))], "left_key string, right_key string, fields int")


@query("workbook_import", "SELECT table_name, column_name, CASE WHEN column_name = 'c_name' THEN 'REMAP' WHEN column_name = 'c_acctbal' THEN 'IGNORE' WHEN column_name = 'c_mktsegment' THEN 'MAP' WHEN column_name = 'c_extra' THEN 'UNKNOWN_COLUMN' WHEN table_name = 'other' THEN 'UNKNOWN_TABLE' ELSE 'UNCHANGED' END AS action FROM (VALUES ('Customer', 'c_custkey'), ('Customer', 'c_name'), ('Customer', 'c_acctbal'), ('Customer', 'c_mktsegment'), ('Customer', 'c_extra'), ('other', 'x')) v(table_name, column_name)")
def _(t):
    plan = t.spark.createDataFrame([("customer", c, None if c == "c_mktsegment" else c, "UNMAPPED" if c == "c_mktsegment" else "AUTO_MAPPED") for c in t.customer.columns], "table_name string, field string, target string, status string")
    sheet = t.spark.createDataFrame([("Customer", "C_CUSTKEY", "c_custkey"), ("Customer", "c_name", "title"), ("Customer", "c_acctbal", " ignore "), ("Customer", "c_mktsegment", "segment"), ("Customer", "c_extra", "y"), ("other", "x", "y")], "table_name string, field string, target string")
    return sheets.import_mappings(sheet, plan).select("table_name", F.lower("field").alias("column_name"), "action")


@query("sql_type_map", "SELECT * FROM (VALUES ('nvarchar(40)', 'String'), ('varchar(max)', 'Memo'), ('numeric(18,4)', 'Decimal'), ('timestamptz', 'DateTime'), ('uuid', 'Uniqueidentifier'), ('geometry', 'Other')) v(sql_type, type)")
def _(t):
    return t.spark.createDataFrame([(x, md.sql_type(x)) for x in ("nvarchar(40)", "varchar(max)", "numeric(18,4)", "timestamptz", "uuid", "geometry")], "sql_type string, type string")


@query("run_status", "SELECT event_type AS run, CASE WHEN count(*) FILTER (user_id % 50 = 1) > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM events GROUP BY 1")
def _(t):
    counts = t.events.groupBy("event_type").agg(F.count_if(F.col("user_id") % 50 == 1).alias("failed")).collect()  # a row for each run
    return t.spark.createDataFrame([(r.event_type, migrate.run_status({"FAILED": r.failed})) for r in counts], "run string, status string")


@query("uniqueness_basis", "SELECT * FROM (VALUES ('BUSINESS_KEY', 0, 'NOT_VERIFIED'), ('BUSINESS_KEY', 1, 'BUSINESS_KEY'), ('BUSINESS_KEY', 2, 'COMPOSITE_BUSINESS_KEY'), ('ALTERNATE_KEY', 1, 'ALTERNATE_KEY'), ('NAME', 1, 'NOT_VERIFIED')) v(match, parts, basis)")
def _(t):
    return t.spark.createDataFrame([(m, n, md.uniqueness_basis(m, ["a", "b"][:n])) for m, n in (("BUSINESS_KEY", 0), ("BUSINESS_KEY", 1), ("BUSINESS_KEY", 2), ("ALTERNATE_KEY", 1), ("NAME", 1))], "match string, parts int, basis string")


@query("cron_next", "SELECT TIMESTAMP '2024-01-08 09:00:00' AS due")
def _(t):
    due = cron.next_run("0 9 * * mon", datetime(2024, 1, 1, 9, tzinfo=timezone.utc))
    return t.spark.createDataFrame([(due.replace(tzinfo=None).isoformat(" "),)], "due string").select(F.col("due").cast("timestamp_ntz").alias("due"))


# The columns of the profiled tables by how they are read, for the other engine.
_FLAGSHIP = {
    "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"},
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "datetime", "o_orderpriority": "text"},
    "lineitem": {"l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "datetime"},
}


def _profile_sql(table: str, f: str, kind: str) -> str:
    """A row of profile() for a column whose texts are neither amounts nor dates."""
    of = lambda k, sql, other: sql if kind == k else other
    word = f"lower({f}) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f', 'on', 'off')"
    number, text = (lambda sql: of("number", sql, "CAST(NULL AS DOUBLE)")), (lambda sql, none="CAST(NULL AS INTEGER)": of("text", sql, none))
    return f"""SELECT '{table}' AS table_name, '{f}' AS field, count(*) AS examined, count(*) - count({f}) AS null_count, {text(f"count(*) FILTER ({_trim(f)} = '')", "0")} AS blank_count, {text(f"count(*) FILTER ({_trim(f)} <> '' AND {_trim(f)} <> {f})", "0")} AS whitespace_count,
{text(f"min(length({f}))")} AS min_length, {text(f"max(length({f}))")} AS max_length, {text(f"floor(avg(length({f})) * 10 + 0.5) / 10", "CAST(NULL AS DOUBLE)")} AS avg_length, {number(f"CAST(min({f}) AS DOUBLE)")} AS min_number, {number(f"CAST(max({f}) AS DOUBLE)")} AS max_number, {number(f"floor(CAST(sum(CAST({f} AS DECIMAL(38,9))) AS DOUBLE) / count({f}) * 1000000 + 0.5) / 1000000")} AS avg_number, CAST(NULL AS INTEGER) AS max_scale,
{of("datetime", f"CAST(min({f}) AS TIMESTAMP)", "CAST(NULL AS TIMESTAMP)")} AS min_date, {of("datetime", f"CAST(max({f}) AS TIMESTAMP)", "CAST(NULL AS TIMESTAMP)")} AS max_date, 0 AS invalid_count, 0 AS invalid_date_count, CAST(NULL AS INTEGER) AS max_decimals, 0 AS over_two_decimals, 0 AS decimal_marks, {text(f"count(DISTINCT lower({f})) FILTER ({word})", "0")} AS boolean_spellings,
0 AS number_shapes, 0 AS currency_shapes, {text(f"count(*) FILTER ({word})", "0")} AS boolean_shapes, 0 AS date_shapes, {text(f"count(*) FILTER ({_trim(f)} <> '' AND NOT {word})", "0")} AS text_shapes, floor((count(*) - count({f})) * 1000.0 / greatest(count(*), 1) + 0.5) / 10.0 AS null_percent,
count(DISTINCT {f}) AS distinct_count, count({f}) - count(DISTINCT {f}) AS duplicate_count, any_value(g.v) AS distinct_values, any_value(g.d) AS duplicate_groups, any_value(g.c) AS rows_in_collision, any_value(g.l) AS largest_group, 'EXACT' AS basis
FROM {table}, (SELECT count(*) AS v, count(*) FILTER (n > 1) AS d, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS c, coalesce(max(n), 0) AS l FROM (SELECT count(*) AS n FROM {table} WHERE {f} IS NOT NULL GROUP BY {f})) g"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full profile of three tables, a row for each column."""
    t = Inputs(spark, sf_dir)
    parts = [profile.profile(getattr(t, n), n) for n in ("customer", "orders", "lineitem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["profile_tables"] = flagship
ORACLE_SQL["profile_tables"] = " UNION ALL ".join(_profile_sql(n, f, k) for n, columns in _FLAGSHIP.items() for f, k in columns.items())


# -- odd ids and keys

_ODD = "WITH s AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM {odd_customer} t), v AS (SELECT s.id AS source_id, CASE WHEN s.id IS NULL THEN 'SOURCE_ID_MISSING' WHEN n > 1 THEN 'DUPLICATE_SOURCE_ID' END AS conflict, o.id AS old, CASE WHEN s.c_name <> o.title OR s.c_mktsegment <> o.segment THEN 'UPDATE' ELSE 'UNCHANGED' END AS existing FROM s LEFT JOIN {old_customer} o ON s.id = o.id) "


@query("preflight_odd_ids", _ODD + "SELECT source_id, CASE WHEN conflict IS NULL THEN old END AS target_id, CASE WHEN conflict IS NOT NULL THEN 'CONFLICT' WHEN old IS NULL THEN 'CREATE' ELSE existing END AS action, conflict FROM v")
def _(t):
    m = match.by_primary_id(t.odd_customer, t.old_customer, "id", "id")
    return match.preflight(t.odd_customer, t.old_customer, m, "id", "id", [("c_name", "title"), ("c_mktsegment", "segment")], "UPSERT").select("source_id", "target_id", "action", "conflict")


#: Two key parts, split at the mark in one table and before it in the other, for every third customer.
_PARTS = {
    "source": "CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '|') ELSE c_name END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS b",
    "target": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS a, CASE WHEN c_custkey % 3 = 0 THEN concat('|', c_mktsegment) ELSE lower(c_mktsegment) END AS b",
}


@query("match_key_parts", f"WITH s AS (SELECT c_custkey AS source_id, {_PARTS['source']} FROM customer), o AS (SELECT c_custkey AS id, {_PARTS['target']} FROM customer) SELECT source_id, id AS target_id, CASE WHEN s.b IS NULL THEN 'BUSINESS_KEY_INCOMPLETE' END AS conflict FROM s LEFT JOIN o ON lower(s.a) = lower(o.a) AND lower(s.b) = lower(o.b)")
def _(t):
    own = lambda side, key: t.customer.selectExpr(f"c_custkey AS {key}", _PARTS[side].split(", CASE")[0], "CASE" + _PARTS[side].split(", CASE")[1])
    return match.by_key(own("source", "sid"), own("target", "tid"), "sid", "tid", ["a", "b"], ["a", "b"])


# -- writes

@query("write_create", "SELECT c_custkey AS source_id, CAST((SELECT max(id) FROM {old_customer} t) + row_number() OVER (ORDER BY c_custkey) AS VARCHAR) AS target_id, 'CREATED' AS outcome FROM customer WHERE c_custkey % 4 = 0")
def _(t):
    new = t.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    _, outcomes = write.create(t.old_customer, new, "source_id", "id", ["title", "segment"], True, "create", work_table(t.spark, "create"))
    return outcomes.select("source_id", F.col("_key").alias("target_id"), "outcome")


@query("write_create_supplied", "SELECT id, title, segment FROM {old_customer} t UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_custkey % 4 = 0")
def _(t):
    every = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("title"))
    after, _ = write.create(t.old_customer, every, "source_id", "id", ["title"], False, "create", work_table(t.spark, "create"))
    return after


@query("write_update", "SELECT id, seg AS segment, CASE WHEN id % 4 = 0 THEN 'NOT_FOUND' WHEN id % 10 = 1 THEN 'CONFLICT' ELSE 'UPDATED' END AS outcome FROM (SELECT c_custkey AS id, 'NEW' AS seg FROM customer UNION ALL SELECT c_custkey, 'AGAIN' FROM customer WHERE c_custkey % 10 = 1)")
def _(t):
    _, outcomes = write.update(t.old_customer, _updates(t), "id", ["segment"], work_table(t.spark, "update"))
    return outcomes.select("id", "segment", "outcome")


@query("write_update_target", "SELECT id, title, CASE WHEN id % 10 = 1 THEN segment ELSE 'NEW' END AS segment FROM {old_customer} t")
def _(t):
    return write.update(t.old_customer, _updates(t), "id", ["segment"], work_table(t.spark, "update"))[0]


def _updates(t: Inputs) -> DataFrame:
    every = t.customer.select(F.col("c_custkey").alias("id"), F.lit("NEW").alias("segment"))
    return every.unionByName(every.where("id % 10 = 1").withColumn("segment", F.lit("AGAIN")))


@query("migrate_generated_keys", """WITH n AS (SELECT c_custkey, o.id FROM customer LEFT JOIN {old_customer} o ON o.id = c_custkey)
SELECT CAST(c_custkey AS VARCHAR) AS source_id, CAST(coalesce(id, (SELECT max(id) FROM n) + row_number() OVER (PARTITION BY id IS NULL ORDER BY CAST(c_custkey AS VARCHAR))) AS VARCHAR) AS target_id, CASE WHEN id IS NULL THEN 'CREATED' ELSE 'UNCHANGED' END AS outcome FROM n""")
def _(t):
    e = migrate.Entity("customer", "c_custkey", "id", [("c_name", "title"), ("c_mktsegment", "segment")], match="BUSINESS_KEY", key=[("c_name", "title")], strategy="SKIP_EXISTING", generated=True)
    _, known = migrate.migrate(t.spark, [e], {"customer": t.customer}, {"customer": t.old_customer}, "run-1", work_table(t.spark, "migrate"))
    return known.select("source_id", "target_id", "outcome")


@query("migrate_audit_stamps", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 = 0 OR c_custkey % 10 = 0 OR c_custkey % 4 = 0 THEN 'clerk ' || c_nationkey ELSE 'old' END AS changed_by, concat('t', CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 10 = 0 OR c_custkey % 3 = 0 THEN c_mktsegment ELSE 'old' END) AS changed_on FROM customer")
def _(t):
    e = migrate.Entity("customer", "c_custkey", "id", [("c_custkey", "id"), ("c_name", "title"), ("c_mktsegment", "segment")], stamps=[("who", "changed_by"), ("at", "changed_on")])
    source = t.customer.select("*", F.concat(F.lit("clerk "), "c_nationkey").alias("who"), F.concat(F.lit("t"), "c_mktsegment").alias("at"))
    target = t.old_customer.select("*", F.lit("old").alias("changed_by"), F.lit("told").alias("changed_on"))
    out, _ = migrate.migrate(t.spark, [e], {"customer": source}, {"customer": target}, "run-1", work_table(t.spark, "migrate"))
    return out["customer"].select("id", "changed_by", "changed_on")


@query("map_snapshot", "SELECT CAST(l_orderkey AS VARCHAR) AS source_id, CAST(coalesce(max(l_linenumber) FILTER (l_linenumber % 2 = 1), max(l_linenumber)) AS VARCHAR) AS target_id, CASE WHEN count(*) FILTER (l_linenumber % 2 = 1) > 0 THEN 'CREATED' ELSE 'FAILED' END AS outcome FROM lineitem GROUP BY l_orderkey")
def _(t):
    line = F.col("l_linenumber")
    grown = t.lineitem.select(F.lit("r").alias("run_id"), F.lit("orders").alias("table_name"), F.col("l_orderkey").cast("string").alias("source_id"), line.cast("string").alias("target_id"), F.when(line % 2 == 1, "CREATED").otherwise("FAILED").alias("outcome"), F.timestamp_seconds(line).alias("updated_at"), F.lit(None).cast("string").alias("error_code"))
    return migrate.snapshot(grown).select("source_id", "target_id", "outcome")


_PREPARED = f"""SELECT CAST(c_custkey AS VARCHAR) AS source_id, concat_ws(',',
  CASE WHEN amount = 'n/a' OR amount LIKE '$%' THEN 'ERROR:INVALID_NUMBER:amount' END, 'WARNING:SHORTENED:code',
  CASE WHEN c_nationkey % 3 = 0 THEN 'WARNING:LOOKUP_UNRESOLVED:c_nationkey' END, CASE WHEN {_blank('email')} THEN 'ERROR:REQUIRED_VALUE_MISSING:email' END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'ERROR:PRINCIPAL_UNRESOLVED:c_mktsegment' END) AS issues,
  CASE WHEN c_nationkey % 3 <> 0 THEN concat('n', c_nationkey) END AS nation, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END AS owner FROM {{dirty_customer}} t"""


@query("prepare_record", _PREPARED)
def _(t):
    fields = [("amount", "amount"), ("email", "email"), ("code", "code"), ("c_nationkey", "nation")]
    e = migrate.Entity("customer", "c_custkey", "id", fields, {"amount": [Step("TO_DECIMAL")], "code": [Step("TRUNCATE", {"length": 3})]}, {"c_nationkey": "nation"}, required=["email"], lenient=["c_nationkey"], people={"c_mktsegment": "owner"})
    nations = t.nation.where("n_nationkey % 3 <> 0").select(F.lit("r").alias("run_id"), F.lit("nation").alias("table_name"), F.col("n_nationkey").cast("string").alias("source_id"), F.concat(F.lit("n"), "n_nationkey").alias("target_id"), F.lit("CREATED").alias("outcome"), F.lit(None).cast("timestamp").alias("updated_at"))
    people = t.customer.select(F.col("c_mktsegment").alias("source_id")).distinct().where("source_id <> 'BUILDING'").withColumn("target_id", F.lower("source_id"))
    out = migrate.prepare(e, t.dirty_customer, nations, people=people)
    told = F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["severity"], x["code"], x["field"])), ",")
    return out.select(F.col("_sid").alias("source_id"), told.alias("issues"), F.col("v_c_nationkey").alias("nation"), F.col("p_c_mktsegment").alias("owner"))


# -- pages

@query("paged_read", "SELECT o_custkey, o_orderkey, r AS place, r // 500 + 1 AS page FROM (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS r FROM orders)")
def _(t):
    pages = paging.Pages(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], 500, work_table(t.spark, "pages"))
    return pages.numbered()


@query("read_page", "SELECT * FROM (SELECT event_id, user_id, event_type FROM events ORDER BY user_id, event_id LIMIT 300 OFFSET 600)")
def _(t):
    return paging.Pages(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_id"], 300, work_table(t.spark, "pages")).page(3)


@query("keyset_page", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 40 OR o_custkey = 40 AND o_orderkey > 100 ORDER BY 1, 2 LIMIT 500")
def _(t):
    return paging.after(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], [40, 100], 500)


# -- recovery, sessions and streams

_EVIDENCE = """WITH i AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_custkey % 5 AS m, c_custkey % 13 = 0 AS up FROM customer), v AS (SELECT i.*, o.id, o.segment = i.c_mktsegment AS same FROM i LEFT JOIN {old_customer} o ON o.id = i.k)
SELECT k AS source_id, CASE WHEN NOT up AND m < 4 THEN ['PRESERVED_ID', 'ALTERNATE_KEY', 'BUSINESS_KEY', 'RECORDED_TARGET_ID'][m + 1] END AS evidence,
CASE WHEN up THEN 'NOT_LOOKED_FOR' WHEN m = 4 THEN 'NO_EVIDENCE' WHEN id IS NULL OR m = 2 AND NOT same THEN 'ABSENT' ELSE 'PRESENT' END AS finding,
CASE WHEN NOT up AND m < 4 AND (m <> 2 OR same) THEN CAST(id AS VARCHAR) END AS target_id, CASE WHEN up THEN 'RETRY' WHEN m = 4 THEN 'PERSON' WHEN id IS NULL OR m = 2 AND NOT same THEN 'RETRY' ELSE 'CONFIRM' END AS next FROM v"""


@query("recovery_by_evidence", _EVIDENCE)
def _(t):
    k, m = F.col("c_custkey"), F.col("c_custkey") % 5
    parts = lambda n, *columns: F.when(m == n, F.array(*[F.col(c).cast("string") for c in columns]))
    intents = t.customer.select(k.alias("source_id"), F.when(k % 13 == 0, "UPDATE").otherwise("CREATE").alias("operation"), parts(0, "c_custkey").alias("kept"), parts(1, "c_name").alias("alternate"), parts(2, "c_name", "c_mktsegment").alias("business"), parts(3, "c_custkey").alias("recorded"))
    by = {"PRESERVED_ID": ("kept", ["id"]), "ALTERNATE_KEY": ("alternate", ["title"]), "BUSINESS_KEY": ("business", ["title", "segment"]), "RECORDED_TARGET_ID": ("recorded", ["id"])}
    return runs.recover_by_evidence(intents, t.old_customer, "id", by)


@query("event_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id AS key, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, session""")
def _(t):
    return state.sessions(t.events, "ts", "30 minutes", "1 hour", "user_id")


@query("stream_newest_mapping", "SELECT CAST(user_id AS VARCHAR) AS source_id, max({'at': ts, 'target': CAST(event_id AS VARCHAR)}).target AS target_id FROM events GROUP BY 1")
def _(t):
    pick = {"source_id": "user_id", "target_id": "event_id", "updated_at": "CAST(ts AS TIMESTAMP)"}
    place = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{t.dir}/events.parquet")
    one = place.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()  # a stream reads folders
    folder, names = (t.dir, "events.parquet") if one else (f"{t.dir}/events.parquet", "*.parquet")
    out = state.follow_map(t.spark, folder, t.events.schema, pick, work_folder(t.spark, "newest"), work_folder(t.spark, "newest-checkpoint"), names=names)
    return out.select("source_id", "target_id")


# -- records found, previews

@query("read_xml_found", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment AS \"in.segment\" FROM customer")
def _(t):
    path = work_folder(t.spark, "xml")
    rows = t.customer.select("c_custkey", "c_name", F.struct(F.col("c_mktsegment").alias("segment")).alias("in"))
    rows.write.format("xml").option("rootTag", "customers").option("rowTag", "client").save(path)
    return files.read_xml(t.spark, path).select("c_custkey", "c_name", "`in.segment`")


@query("sketch_preview", "SELECT 'l_partkey' AS field, count(*) AS rows, true AS distinct_holds, true AS median_holds, 'APPROXIMATE' AS basis FROM lineitem UNION ALL SELECT 'l_quantity', count(*), true, true, 'APPROXIMATE' FROM lineitem UNION ALL SELECT 'l_extendedprice', count(*), true, true, 'APPROXIMATE' FROM lineitem")
def _(t):
    columns = ["l_partkey", "l_quantity", "l_extendedprice"]
    parts = None
    for k in range(4):  # as if each were a table of its own
        own = sketches.partials(t.lineitem.where(F.pmod("l_orderkey", F.lit(4)) == k), columns)
        parts = own if parts is None else parts.unionByName(own)
    told = sketches.preview(sketches.merged(parts))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_f"), F.col(c).cast("double").alias("v")) for c in columns])).alias("c")
    counts = t.lineitem.select(cells).groupBy("c._f", "c.v").agg(F.count("*").alias("n"))
    exact = counts.join(F.broadcast(told.select("field", "p50")), F.col("_f") == F.col("field")).groupBy("_f").agg(F.count("*").alias("_d"), F.sum(F.when(F.col("v") < F.col("p50"), F.col("n")).otherwise(0)).alias("_below"), F.sum(F.when(F.col("v") <= F.col("p50"), F.col("n")).otherwise(0)).alias("_upto"))
    out = told.join(exact, F.col("field") == F.col("_f"))
    c = F.col
    near = (c("_below") / c("rows") <= 0.5 + c("rank_error")) & (c("_upto") / c("rows") >= 0.5 - c("rank_error"))
    return out.select("field", "rows", (F.abs(c("distinct_about") - c("_d")) <= c("distinct_error")).alias("distinct_holds"), near.alias("median_holds"), "basis")
