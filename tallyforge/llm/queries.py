"""The operators on their whole tables with production parameters, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bagminhash, chat, decisionlist, fm, langid, linededup, mixing, radix, superkmers, tokens, variants, whitening, wumanber
from tallyforge.llm.common import fresh_path, table
from tallyforge.llm.samples import held_out


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(table(spark, sf_dir, "documents"))


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.digest(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix.digest(table(spark, sf_dir, "documents"))


def op7_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = fm.score(docs, fm.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wumanber.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decisionlist.judge(docs, decisionlist.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.remove_boilerplate(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_residue_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    path = fresh_path(spark, "chat")
    chat.write(conversations.unionByName(more), path)
    return chat.digest(chat.read(spark, path))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), altered=199)


QUERIES = {f.__name__: f for f in (op1_rans_tokens, op2_bagminhash, op3_fair_mix, op4_superkmer_dedup, op5_language, op6_radix_dedup, op7_factor_quality, op8_wu_manber, op9_decision_list, op10_site_lines, op11_residue_whitening, op12_chat_format, op13_spelling_variants)}

ORACLE_SQL = {
    "op3_fair_mix": r"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS shuffle, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM sized GROUP BY source
), capped AS (
  SELECT *, source_size * 3 AS cap, row_number() OVER (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST) AS k FROM sources
), filled AS (
  SELECT k, weight, cap, (SELECT sum(source_size) FROM sources)::BIGINT AS budget_left, (SELECT sum(weight) FROM sources)::BIGINT AS weight_left,
         CAST(NULL AS DOUBLE) AS level FROM capped WHERE k = 1
  UNION ALL
  SELECT c.k, c.weight, c.cap,
         f.budget_left - f.cap, f.weight_left - f.weight, CAST(NULL AS DOUBLE)
  FROM filled f JOIN capped c ON c.k = f.k + 1 WHERE f.weight * f.budget_left >= f.cap * f.weight_left
), water AS (
  SELECT budget_left::DOUBLE / weight_left AS level FROM filled WHERE weight * budget_left < cap * weight_left
), aims AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT level FROM water), cap::DOUBLE)) AS target FROM capped
), queued AS (
  SELECT s.r, s.source, s.doc_id, s.size, a.source_size, a.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.shuffle, s.doc_id, s.size, s.r ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), entries AS (
  SELECT r, source, size, p * source_size + start AS place, (p * source_size + start + size)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1), (2)) passes(p) WHERE size > 0 AND target > 0
), used AS (
  SELECT r, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, place ROWS UNBOUNDED PRECEDING) - size AS used, (SELECT sum(source_size) FROM sources) AS budget FROM entries
), taken AS (
  SELECT r, sum(least(size, budget - used)) AS taken FROM used WHERE used < budget GROUP BY r
)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued LEFT JOIN taken USING (r)""",
    "op10_site_lines": r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '') AS host,
         coalesce(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 0), []) AS lines
  FROM pages
), totals AS (
  SELECT host, count(*) AS pages FROM cut GROUP BY host
), common AS (
  SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) x JOIN totals USING (host)
  GROUP BY host, line, pages HAVING count(*) >= 3 AND count(*) > pages * CAST(0.2 AS DOUBLE)
), listed AS (
  SELECT r, host, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM cut
), kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS text FROM listed WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.host = listed.host AND c.line = listed.line) GROUP BY r
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (r)""",
}

#: Rows in the order of ids (null first), windows of ``length`` units of ``units`` and which of them come again; the
#: runs that those cover, and what lies between.
_REPEATS = """
WITH i AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS key, {units} AS u FROM documents),
w AS (SELECT r, key, unnest(range(1, {count} - {length} + 2)) AS k, u FROM i WHERE {count} >= {length}),
v AS (SELECT r, key, k, {window} AS s FROM w),
late AS (SELECT r, k FROM (SELECT r, key, k, {again} AS again FROM v) WHERE again),
edge AS (SELECT r, k, coalesce(k - lag(k) OVER (PARTITION BY r ORDER BY k) > {length}, true) AS new FROM late),
island AS (SELECT r, k, sum(new::INT) OVER (PARTITION BY r ORDER BY k) AS n FROM edge),
run AS (SELECT r, n, min(k) AS a, max(k) + {length} AS b FROM island GROUP BY ALL),
gap AS (SELECT r, n, coalesce(lag(b) OVER (PARTITION BY r ORDER BY n), 1) AS a, a AS b FROM run UNION ALL SELECT r, max(n) + 1, max(b), NULL FROM run GROUP BY r),
piece AS (SELECT gap.r, gap.n, {piece} AS part FROM gap JOIN i USING (r)),
kept AS (SELECT r, string_agg(part, {glue} ORDER BY n) FILTER (part <> '') AS part FROM piece GROUP BY r),
total AS (SELECT r, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM run GROUP BY r)
"""
_WORDS = _REPEATS.format(units=r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])", count="len(u)", length=50, window="array_to_string(u[k:k + 49], ' ')", again="key > min(key) OVER (PARTITION BY s)", piece="array_to_string(u[gap.a:coalesce(gap.b - 1, len(u))], ' ')", glue="' '")
ORACLE_SQL["op4_superkmer_dedup"] = f"{_WORDS} SELECT doc_id, len(u)::BIGINT AS n_words, coalesce(removed, 0) AS n_removed, sha256(CASE WHEN removed IS NULL THEN array_to_string(u, ' ') ELSE coalesce(part, '') END) AS kept_sha256 FROM i LEFT JOIN total USING (r) LEFT JOIN kept USING (r)"
_BYTES = _REPEATS.format(units="hex(encode(coalesce(text, '')))", count="length(u) // 2", length=100, window="substr(u, 2 * k - 1, 200)", again="row_number() OVER (PARTITION BY s ORDER BY key, r, k) > 1", piece="CASE WHEN gap.b IS NULL THEN substr(u, 2 * gap.a - 1) ELSE substr(u, 2 * gap.a - 1, 2 * (gap.b - gap.a)) END", glue="''")
ORACLE_SQL["op6_radix_dedup"] = f"{_BYTES} SELECT doc_id, length(u) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN u ELSE coalesce(part, '') END)) AS kept_sha256 FROM i LEFT JOIN total USING (r) LEFT JOIN kept USING (r)"
_LOWER = r"coalesce(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE_SQL["op8_wu_manber"] = f"""
WITH i AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER.format("text")} AS u FROM documents),
b AS (SELECT item_id, {_LOWER.format("text")} AS u FROM benchmark), c AS (SELECT item_id, u, least(13, len(u)) AS size FROM b WHERE len(u) > 0),
pattern AS (SELECT DISTINCT item_id, size, array_to_string(u[k:k + size - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(u) - size + 2)) AS k FROM c)),
sizes AS (SELECT DISTINCT size FROM pattern),
w AS (SELECT r, size, k, array_to_string(u[k:k + size - 1], ' ') AS s FROM (SELECT r, u, size, unnest(range(1, len(u) - size + 2)) AS k FROM i JOIN sizes ON len(u) >= size)),
hit AS (SELECT r, k, size, item_id FROM w JOIN pattern USING (size, s)),
spot AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT r, k, size FROM hit)) GROUP BY r),
listed AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(u)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(u) AS contaminated
FROM i LEFT JOIN spot USING (r) LEFT JOIN listed USING (r)"""
#: Classes by exact overlap of all pairs that share a gram: signatures miss a pair at the threshold with chance 3e-6.
ORACLE_SQL["op2_bagminhash"] = r"""
WITH RECURSIVE i AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS u FROM documents),
g AS (SELECT r, array_to_string(u[k:k + least(5, len(u)) - 1], ' ') AS s, count(*) AS c FROM (SELECT *, unnest(range(1, len(u) - least(5, len(u)) + 2)) AS k FROM i WHERE len(u) > 0) GROUP BY ALL),
n AS (SELECT r, sum(c) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, sum(least(a.c, b.c)) AS s FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 5 * s >= 4 * (a.n + b.n - s)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r AS x, r AS y FROM i UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT i.doc_id, c.class_id FROM i JOIN (SELECT x, min(doc_id) AS class_id FROM reach JOIN i ON r = y GROUP BY x) c ON c.x = i.r"""

ORACLE_SQL["op12_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, r)
), marked AS (
  SELECT *, length(regexp_replace(text, '([\[<]/?)(\\*)((?:INST|SYS|TURN)\]|s>)', '\1\\\2\3', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 13
    ELSE 16 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([\[<]/?)(\\*)((?:INST|SYS|TURN)\]|s>)', '\1\\\2\3', 'g')) END AS chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""
