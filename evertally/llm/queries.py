"""One registered query per operator of this package, over whole tables; SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evertally.llm import ann, chat_preferences, context_tree, conversation_repair, decontamination, language_id, merkle, mixing, near_dedup, sharding, substring_dedup, toxicity, warc
from evertally.llm.tables import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language_id.identified(docs, language_id.learned(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


@query
def op2_weighted_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


ORACLES["op2_weighted_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_element([5.0, 2.0, 1.0]::DOUBLE[],
                      CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1) AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, (2 * source_size)::DOUBLE AS most,
         sum((2 * source_size)::DOUBLE) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM sources
), stopped AS (
  SELECT *, most * rest <= weight * (budget - coalesce(spent, 0)) AS stops FROM levels
), targets AS (
  SELECT source, source_size, budget,
         CASE WHEN stops THEN most ELSE weight
              * (budget - sum(CASE WHEN stops THEN most ELSE 0 END) OVER ())
              / sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () END AS target
  FROM stopped
), queued AS (
  SELECT s.*, t.source_size, t.target, t.budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY place, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, CAST(words + n * source_size AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1)) AS repeats(n) WHERE size > 0
), running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place) AS total FROM copies
), takes AS (
  SELECT doc_id, source, place, size, words, sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS taken
  FROM running GROUP BY ALL
)
SELECT q.doc_id, q.source, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
       CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN takes k
  ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source
 AND q.place = k.place AND q.size = k.size AND q.words = k.words
"""


@query
def op3_preference_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat_preferences.preferences(*chat_preferences.with_foreign_replies(table(spark, sf, "conversations")))


ORACLES["op3_preference_formatting"] = r"""
WITH turns AS (
  SELECT conv_id AS pair_id, turn, role, coalesce(text, '') AS text FROM conversations
), last AS (
  SELECT pair_id, turn AS place, text AS reply FROM turns WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) = 1
), rejected AS (
  SELECT t.pair_id, t.turn, t.role, CASE WHEN t.turn = l.place AND t.role = 'assistant' THEN n.reply ELSE t.text END AS text
  FROM turns t LEFT JOIN last l ON t.pair_id = l.pair_id LEFT JOIN last n ON n.pair_id = t.pair_id + 1
  WHERE NOT coalesce(t.turn = l.place AND t.role = 'assistant', false) OR n.reply IS NOT NULL
), sides AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn,
         a.role AS role_a, a.text AS text_a, b.role AS role_b, b.text AS text_b
  FROM turns a FULL JOIN rejected b ON a.pair_id = b.pair_id AND a.turn = b.turn
), parting AS (
  SELECT pair_id, min(turn) FILTER (role_a IS DISTINCT FROM role_b OR text_a IS DISTINCT FROM text_b) AS first
  FROM sides GROUP BY pair_id
), rendered AS (
  SELECT s.pair_id, turn, coalesce(turn < first, true) AS common, role_a, role_b,
         '<|im_start|>' || role_a || chr(10) || replace(text_a, '<|', '<') || '<|im_end|>' || chr(10) AS a,
         '<|im_start|>' || role_b || chr(10) || replace(text_b, '<|', '<') || '<|im_end|>' || chr(10) AS b,
         length('<|im_start|>' || role_a) + 1 AS head_a, length('<|im_start|>' || role_b) + 1 AS head_b
  FROM sides s JOIN parting p ON s.pair_id = p.pair_id
), placed AS (
  SELECT *, sum(CASE WHEN common THEN 0 ELSE length(a) END) OVER w AS end_a,
            sum(CASE WHEN common THEN 0 ELSE length(b) END) OVER w AS end_b
  FROM rendered WINDOW w AS (PARTITION BY pair_id ORDER BY turn)
)
SELECT pair_id, count(*) FILTER (common) AS n_prompt_turns,
       coalesce(string_agg(a, '' ORDER BY turn) FILTER (common), '') AS prompt,
       coalesce(string_agg(a, '' ORDER BY turn) FILTER (NOT common AND a IS NOT NULL), '') AS chosen,
       coalesce(string_agg((end_a - length(a) + head_a)::VARCHAR || ':' || (end_a - 1)::VARCHAR, ',' ORDER BY turn)
         FILTER (NOT common AND role_a = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(b, '' ORDER BY turn) FILTER (NOT common AND b IS NOT NULL), '') AS rejected,
       coalesce(string_agg((end_b - length(b) + head_b)::VARCHAR || ':' || (end_b - 1)::VARCHAR, ',' ORDER BY turn)
         FILTER (NOT common AND role_b = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    network = toxicity.trained(docs, table(spark, sf, "labels"))
    rows, score = toxicity.scored(docs, network, ["doc_id"])
    predicted = (F.col(score) >= toxicity.THRESHOLD).cast("int")
    return rows.select("doc_id", held_out().alias("held_out"), F.col(score).alias("score"), predicted.alias("predicted"))


@query
def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"), shingle_words=3, percent=85)


#: Texts with A-Z lowered, in DuckDB.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op5_near_duplicates"] = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM texts WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM texts
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), components AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id JOIN components c ON c.doc_id = t.doc_id
"""


@query
def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.repeat_report(table(spark, sf, "documents"))


ORACLES["op6_substring_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS sequence
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts WHERE len(words) >= 13)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY sequence) < doc_id
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM repeated
), places AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), kept AS (
  SELECT p.doc_id, count(c.place) AS n_removed,
         string_agg(p.word, ' ' ORDER BY p.place) FILTER (c.place IS NULL) AS text
  FROM places p LEFT JOIN covered c ON c.doc_id = p.doc_id AND c.place = p.place GROUP BY p.doc_id
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


@query
def op7_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"))


@query
def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.sharded(table(spark, sf, "documents")).select("doc_id", "slot", "shard")


@query
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_report(table(spark, sf, "pages"))


_SHA1_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(sha1(html), (i // 8 * 10 + 1)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1)), '')"""

ORACLES["op9_warc"] = f"""
WITH payloads AS (
  SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_SHA1_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads
"""


@query
def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op10_benchmark_decontamination"] = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS sequence
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), windows AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS sequence
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM texts, (SELECT DISTINCT n FROM item_windows) WHERE len(words) >= n)
), found AS (
  SELECT w.doc_id, w.i, w.n, x.item FROM windows w JOIN item_windows x ON x.n = w.n AND x.sequence = w.sequence
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit h ON h.doc_id = t.doc_id LEFT JOIN named m ON m.doc_id = t.doc_id
"""


def crc32_sql(text: str) -> str:
    """crc32 of ASCII text as DuckDB SQL."""
    shifted = "list_reduce(list_prepend(xor(c, b), [0,0,0,0,0,0,0,0]::BIGINT[]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))"
    letters = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: {shifted}), 4294967295)"


@query
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf, "documents"))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return f"sha256({' || '.join(map(_field_sql, values))})"


ORACLES["op11_merkle_manifest"] = rf"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         row_number() OVER () AS id
  FROM (
    SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
           CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0
                THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
    FROM documents)
), nodes AS (
  SELECT lang, 0 AS level, place, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM nodes) WHERE n > 1
  GROUP BY lang, level, place // 8
), heights AS (
  SELECT lang, max(level) AS height FROM nodes GROUP BY lang
), subroots AS (
  SELECT n.lang, height, digest AS subroot, row_number() OVER (ORDER BY n.lang NULLS FIRST) - 1 AS place
  FROM nodes n JOIN heights h ON n.lang IS NOT DISTINCT FROM h.lang AND n.level = h.height
), tops AS (
  SELECT 0 AS level, place, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, place // 8
), root AS (
  SELECT digest AS root FROM tops QUALIFY level = max(level) OVER ()
), steps AS (  -- every document's nodes on the way up, and the members of their runs
  SELECT l.id, n.level, n.digest, CASE WHEN n.place <> l.place // (8 ** n.level)::BIGINT THEN n.digest END AS sibling, n.place
  FROM leaves l JOIN heights h ON l.lang IS NOT DISTINCT FROM h.lang
  JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level < h.height
   AND n.place // 8 = l.place // (8 ** (n.level + 1))::BIGINT
  UNION ALL
  SELECT l.id, 100 + t.level, t.digest, CASE WHEN t.place <> s.place // (8 ** t.level)::BIGINT THEN t.digest END, t.place
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  JOIN tops t ON t.place // 8 = s.place // (8 ** (t.level + 1))::BIGINT AND t.level < (SELECT max(level) FROM tops)
), runs AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS step,
         string_agg(coalesce(sibling, '*'), '' ORDER BY place) AS run, coalesce(string_agg(sibling, '' ORDER BY place), '') AS siblings
  FROM steps GROUP BY id, level
), folds AS (
  SELECT id, 0 AS step, coalesce(other, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.id, r.step, sha256(replace(r.run, '*', f.digest)) FROM folds f JOIN runs r ON r.id = f.id AND r.step = f.step + 1
), folded AS (
  SELECT id, digest AS folded_root FROM folds QUALIFY step = max(step) OVER (PARTITION BY id)
), proved AS (
  SELECT id, string_agg(siblings, '' ORDER BY step) AS proof FROM runs GROUP BY id
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root
JOIN folded f ON f.id = l.id LEFT JOIN proved p ON p.id = l.id
"""


@query
def op12_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scores = context_tree.lm_scores(docs, ~held_out(parts=7))
    return scores.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf, "conversations")))


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES["op13_conversation_repair"] = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS way
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(CASE WHEN way = 0 THEN 0 WHEN way = 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS place
  FROM (SELECT *, md5(length(role) || ':' || role || ':' || text) AS content, rtrim(text, {_SPACES}) AS trimmed FROM damaged)
), rows_ AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, content ORDER BY place) > 1 THEN 'duplicate'
            WHEN trimmed NOT SIMILAR TO '(.|\n)*[.!?]' THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair
  FROM placed
), chains(state, inserts, text, reached) AS (VALUES
  (0, '', '', 0), (0, 'I', 'user:', 2), (0, 'II', 'user:' || chr(10) || 'assistant:', 3),
  (1, '', '', 1), (1, 'I', 'user:', 2), (1, 'II', 'user:' || chr(10) || 'assistant:', 3),
  (2, '', '', 2), (2, 'I', 'assistant:', 3), (2, 'II', 'assistant:' || chr(10) || 'user:', 2),
  (3, '', '', 3), (3, 'I', 'user:', 2), (3, 'II', 'user:' || chr(10) || 'assistant:', 3)
), edits(state, edit, initial, role, reached, cost) AS (VALUES
  (0, 'K', 's', NULL, 1, 0), (0, 'K', 'u', NULL, 2, 0), (1, 'K', 'u', NULL, 2, 0), (2, 'K', 'a', NULL, 3, 0), (3, 'K', 'u', NULL, 2, 0),
  (0, 'R', NULL, 'user', 2, 2), (1, 'R', NULL, 'user', 2, 2), (2, 'R', NULL, 'assistant', 3, 2), (3, 'R', NULL, 'user', 2, 2),
  (0, 'D', NULL, NULL, 0, 3), (1, 'D', NULL, NULL, 1, 3), (2, 'D', NULL, NULL, 2, 3), (3, 'D', NULL, NULL, 3, 3)
), best(conv_id, place, state, way) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'out': ''}} FROM conversations
  UNION ALL
  SELECT b.conv_id, r.place, e.reached, min({{
           'cost': b.way.cost + 2 * length(c.inserts) + e.cost + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END,
           'audit': b.way.audit || c.inserts || e.edit,
           'out': b.way.out || CASE WHEN c.inserts = '' THEN '' ELSE c.text || chr(10) END
                  || CASE e.edit WHEN 'D' THEN '' ELSE coalesce(e.role, r.role) || ':' || r.text || chr(10) END}})
  FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.place = b.place + 1
  JOIN chains c ON c.state = b.state
  JOIN edits e ON e.state = c.reached AND coalesce(e.initial = left(r.role, 1), true)
              AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
  GROUP BY b.conv_id, r.place, e.reached
), ended AS (
  SELECT b.conv_id, min({{
           'cost': way.cost + CASE state WHEN 2 THEN 2 WHEN 1 THEN 4 ELSE 0 END,
           'audit': way.audit || CASE state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END,
           'out': way.out || CASE state WHEN 2 THEN 'assistant:' || chr(10)
                  WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE '' END}}) AS way
  FROM best b
  WHERE b.place = (SELECT coalesce(max(r.place), 0) FROM rows_ r WHERE r.conv_id IS NOT DISTINCT FROM b.conv_id)
  GROUP BY b.conv_id
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, way.cost::BIGINT AS cost,
       way.audit AS audit, sha256(rtrim(way.out, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
