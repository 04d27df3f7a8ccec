"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import chat_format, decontaminate, importance, manifest, multiset_hash, near_dedup, piece_codec, quality_classifier, quality_rules, secret_scan, token_files, toxicity, url_filter
from .common import save, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return token_files.round_trip(table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=2)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", chat_format.ODD_TEXT), (-1, 1, "assistant", chat_format.ODD_TEXT)], turns.schema)
    return chat_format.digests(chat_format.from_turn_rows(turns.unionByName(odd)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.measure(table(spark, sf_dir, "documents")).select("doc_id", "lang", "rules")
    judged = quality_rules.judge(save(measured, "measured"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[f"rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return piece_codec.digests(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return multiset_hash.neighbours(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return manifest.verified(table(spark, sf_dir, "documents"), *manifest.without_line_breaks())


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_secrets, op3_chat, op4_token_files, op5_toxicity, op6_decontaminate, op7_quality_rules, op8_url_filter, op9_quality, op10_pieces, op11_fingerprints, op12_resample, op13_manifest)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_RULE_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_RATES = {"symbols": "n_symbols / greatest(1, word_chars)", "marks": "n_marks / greatest(1, word_chars)", "capitals": "n_capitals / greatest(1, word_chars)", "dup_lines": "n_dup_lines / greatest(1, n_lines)", "repeats": "n_repeat_words / greatest(1, n_words)", "word_length": "word_chars / greatest(1, n_words)"}
_RISK = f"greatest({', '.join(f'{v} / {quality_rules.LIMITS[k]}::DOUBLE' for k, v in _RATES.items())})"

_NIBBLES = "list_transform(range(0, len(x)), lambda i: strpos('0123456789ABCDEF', x[i + 2 - 2 * (i % 2)]) - 1)"  # of each byte the low half first
_CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(16) t(i)))"
#: of a text's bytes, given as hexadecimal digits x
_CRC32 = f"xor(list_reduce({_NIBBLES}, lambda c, b: xor(crc_table[xor(c, b) % 16 + 1], c >> 4), 4294967295), 4294967295)"

#: For the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS k FROM placed),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_id LEFT JOIN size USING (doc_id)""",
    "op6_decontaminate": rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_at AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM item_at),
doc AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
doc_at AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win)),
hit AS (SELECT doc_id, item_id, d.n, i FROM doc_at d JOIN win ON win.n = d.n AND win.k = array_to_string(w[i:i + d.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op7_quality_rules": rf"""
WITH text_of AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '*') AS lang, coalesce(text, '') AS t FROM documents),
word_of AS (SELECT *, {_RULE_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM text_of),
three AS (SELECT r, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS k FROM word_of WHERE len(w) > 2),
placed AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (SELECT r, unnest(k) AS k, unnest(range(1, len(k) + 1)) AS i FROM three)),
repeated AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS j FROM placed WHERE c > 1) GROUP BY 1),
counted AS (SELECT word_of.r, doc_id, lang, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals
  FROM word_of LEFT JOIN repeated USING (r)),
measured AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(least({quality_rules.CUTOFFS}, ceil(ln(greatest({_RISK} / {quality_rules.FIRST}, 1::DOUBLE)) / ln({quality_rules.RATIO}::DOUBLE))) AS INTEGER) AS bucket FROM counted),
held AS (SELECT lang, bucket, quality FROM measured JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
total AS (SELECT lang, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 0) AS m FROM held GROUP BY 1),
tried AS (SELECT total.lang, n, m, cutoff, count(*) FILTER (quality = 1 AND bucket > cutoff) AS k, count(*) FILTER (quality = 0 AND bucket > cutoff) AS hit FROM total, (SELECT unnest(range({quality_rules.CUTOFFS})) AS cutoff), held WHERE held.lang = total.lang GROUP BY ALL),
tail AS (SELECT lang, cutoff, any_value(n) AS n, any_value(m) AS m, any_value(k) AS k, any_value(hit) AS hit, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality_rules.ALPHA}) + (n - i) * ln(1 - {quality_rules.ALPHA}))) AS p FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM tried WHERE k < {quality_rules.ALPHA} * n AND hit > 0) GROUP BY 1, 2),
best AS (SELECT lang, max({{'gain': hit / m - k / n, 'cutoff': cutoff}}).cutoff AS cutoff FROM tail WHERE p <= {quality_rules.DELTA} / (SELECT count(*) FROM tried) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bucket <= coalesce(cutoff, {quality_rules.CUTOFFS}) AS kept FROM measured LEFT JOIN best USING (lang)""",
    "op12_resample": rf"""
WITH word AS (SELECT row_number() OVER () AS r, doc_id, 'd' AS kind, {_ITEM_WORDS} AS w FROM documents UNION ALL SELECT -1, NULL, 'b', {_ITEM_WORDS} FROM benchmark),
feature AS (SELECT r, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM word),
crc AS (SELECT {_CRC_TABLE} AS crc_table),
hashed AS (SELECT f, {_CRC32} % 10000 AS bucket FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM feature), crc),
counted AS (SELECT b.bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN (SELECT kind, bucket FROM feature JOIN hashed USING (f)) USING (bucket) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counted),
summed AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM feature JOIN hashed USING (f) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY 1),
scored AS (SELECT word.r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM word LEFT JOIN summed USING (r) WHERE kind = 'd'),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place, count(*) OVER () AS able FROM final WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 25 // 100 THEN place END AS rank FROM final LEFT JOIN placed USING (r)""",
    "op13_manifest": rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
hexed AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR))) AS x, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
leaf AS (SELECT coalesce('=' || source, '') AS tree, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, {_CRC32} % 2 = 0 AS bad, sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS other FROM hexed, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
node(tree, level, pos, digest, n) AS (SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3) FROM node WHERE n > 1 GROUP BY tree, level, pos // 3),
subroot AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, level AS height FROM node WHERE n = 1),
top(level, pos, digest, n) AS (SELECT 0, pos, digest, n FROM subroot UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, pos // 3),
every AS (SELECT tree, level, pos, digest FROM node UNION ALL SELECT '*', level, pos, digest FROM top),
way AS (SELECT p.tree, doc_id, p.pos AS leaf_pos, unnest(range(height + (SELECT max(level) FROM top))) AS step, height, s.pos AS s_pos FROM placed p JOIN subroot s USING (tree)),
walk AS (SELECT tree, leaf_pos, step, CASE WHEN step < height THEN tree ELSE '*' END AS in_tree, CASE WHEN step < height THEN step ELSE step - height END AS level, CAST(CASE WHEN step < height THEN leaf_pos // CAST(pow(3, step) AS BIGINT) ELSE s_pos // CAST(pow(3, step - height) AS BIGINT) END AS BIGINT) AS here FROM way),
near AS (SELECT w.tree, leaf_pos, step, coalesce(string_agg(digest, '' ORDER BY e.pos) FILTER (e.pos < here), '') AS l, coalesce(string_agg(digest, '' ORDER BY e.pos) FILTER (e.pos > here), '') AS r FROM walk w JOIN every e ON e.tree = in_tree AND e.level = w.level AND e.pos // 3 = here // 3 GROUP BY 1, 2, 3),
proof AS (SELECT tree, leaf_pos, string_agg(l || r, '' ORDER BY step) AS proof, count(*) AS steps FROM near GROUP BY 1, 2),
fold(tree, pos, step, own) AS (SELECT tree, pos, 0, CASE WHEN bad THEN other ELSE leaf END FROM placed UNION ALL SELECT f.tree, pos, f.step + 1, sha256(l || own || r) FROM fold f JOIN near ON near.tree = f.tree AND leaf_pos = pos AND near.step = f.step),
root AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, own AS folded_root, own = root AS verified
FROM placed p JOIN subroot s USING (tree) LEFT JOIN proof ON proof.tree = p.tree AND leaf_pos = p.pos JOIN fold f ON f.tree = p.tree AND f.pos = p.pos AND f.step = coalesce(steps, 0), root""",
}
