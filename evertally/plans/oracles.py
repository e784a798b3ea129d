"""SQL oracles: each states the expected result from the rules, independently of the operators."""

from __future__ import annotations

from evertally.plans.mapping import LARGE_VERSION, MIDPOINT, SECRET

_KEY = SECRET.encode().ljust(64, b"\0")
_INNER = bytes(b ^ 0x36 for b in _KEY).hex()
_OUTER = bytes(b ^ 0x5C for b in _KEY).hex()


def _hmac(message: str) -> str:
    inner = f"sha256(from_hex('{_INNER}') || encode({message}))"
    return f"sha256(from_hex('{_OUTER}') || from_hex({inner}))"


def _id_message(email: str) -> str:
    return f"'event:' || length({email}) || ':' || {email} || ':' || video_id || ':' || idempotency_key"


def _number(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 15))::BIGINT"


def _shard(event_id: str, shards: int = 128) -> str:
    return f"(('0x' || substr({event_id}, 1, 16))::UBIGINT % {shards})::INTEGER"


REQUESTS = """
requests AS MATERIALIZED (
  SELECT event_id AS source_id, user_id,
         regexp_extract(props, ': (\\d+)', 1)::BIGINT % 10 + 1 AS video_id,
         'user' || user_id || '@example.com' AS email,
         event_type AS idempotency_key,
         CASE WHEN event_id % 3 <> 0 THEN ts - to_days((event_id % 4000)::INTEGER) END AS occurred_at,
         ts AS accepted_at
  FROM events)"""

RAW = f"""{REQUESTS},
damaged AS (
  SELECT * REPLACE (CASE WHEN source_id % 41 = 0 THEN 0 ELSE video_id END AS video_id), email AS plain_email
  FROM requests),
raw AS MATERIALIZED (
  SELECT source_id, user_id, video_id, plain_email, accepted_at,
         CASE WHEN source_id % 7 = 0 THEN 'GET' ELSE 'POST' END AS method,
         CASE WHEN source_id % 37 = 0 THEN '/api/videos//views'
              WHEN source_id % 31 = 1 THEN '/api/videos/' || video_id || '/views' || chr(10)
              WHEN source_id % 5 = 0 THEN '/api/videos/' || video_id || '/views/'
              ELSE '/api/videos/' || video_id || '/views' END AS path,
         CASE WHEN source_id % 11 = 0 THEN ' ' || chr(9) || 'User' || user_id || '@Example.COM' || chr(10) || ' '
              WHEN source_id % 13 = 1 THEN 'not-an-email'
              WHEN source_id % 17 = 2 THEN NULL
              WHEN source_id % 19 = 3 THEN repeat('x', 243) || '@example.com'
              WHEN source_id % 19 = 4 THEN repeat('x', 242) || '@example.com'
              ELSE plain_email END AS email,
         CASE WHEN source_id % 23 = 0 THEN 'bad key' WHEN source_id % 29 = 1 THEN ''
              WHEN source_id % 31 = 2 THEN NULL ELSE idempotency_key END AS idempotency_key,
         CASE WHEN source_id % 2 = 0 THEN 'req-' || source_id WHEN source_id % 9 = 0 THEN 'bad id!' END AS request_id,
         CASE WHEN source_id % 43 = 1 THEN accepted_at + INTERVAL 5 MINUTE
              WHEN source_id % 43 = 2 THEN accepted_at + INTERVAL 5 MINUTE + INTERVAL 1 MICROSECOND
              WHEN source_id % 43 = 3 THEN accepted_at - INTERVAL 3650 DAY
              WHEN source_id % 43 = 4 THEN accepted_at - INTERVAL 3650 DAY - INTERVAL 1 MICROSECOND
              ELSE occurred_at END AS occurred_at
  FROM damaged),
judged AS MATERIALIZED (
  SELECT *,
         method = 'POST' AND regexp_full_match(path, '/api/videos/[^/]+/views/?') AS mutation,
         lower(trim(coalesce(email, ''), ' ' || chr(9) || chr(10))) AS normal,
         coalesce(regexp_full_match(idempotency_key, '[A-Za-z0-9_-]{{1,128}}'), false) AS token_ok,
         occurred_at IS NULL OR occurred_at BETWEEN accepted_at - INTERVAL 3650 DAY
                                             AND accepted_at + INTERVAL 5 MINUTE AS time_ok
  FROM raw),
checked AS MATERIALIZED (
  SELECT *,
         email IS NOT NULL AND length(email) <= 254
           AND regexp_full_match(normal, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS email_ok
  FROM judged)"""

IDENTIFIED = f"""{REQUESTS},
hashed AS (
  SELECT *, {_hmac(_id_message('email'))} AS event_id, {_hmac("'user:' || email")} AS user_hash FROM requests),
identified AS MATERIALIZED (
  SELECT * REPLACE (coalesce(occurred_at, accepted_at) AS occurred_at),
         {_shard('event_id')} AS counter_shard_id, epoch_us(accepted_at) AS t
  FROM hashed)"""


def _chain(source: str, horizon_us: int, name: str = "chain") -> str:
    keys = "event_id, video_id, counter_shard_id"
    return f"""
{name} AS (
  SELECT {keys}, min(t) AS t FROM {source} GROUP BY ALL
  UNION ALL
  SELECT c.event_id, c.video_id, c.counter_shard_id, min(e.t)
  FROM {name} c JOIN {source} e ON e.event_id = c.event_id AND e.t > c.t + {horizon_us}
  GROUP BY c.event_id, c.video_id, c.counter_shard_id, c.t)"""


DAY_US = 86_400_000_000
WEEK_US = 7 * DAY_US
COUNTED = f"RECURSIVE {IDENTIFIED}, {_chain('identified', WEEK_US)}"

FIRST = f"""{IDENTIFIED},
firsts AS MATERIALIZED (
  SELECT event_id, video_id, counter_shard_id, min(t) AS t FROM identified GROUP BY ALL)"""


def _log(name: str, keys: str, value: str, step_us: int) -> str:
    return f"""
{name}_changes AS (
  SELECT {keys}, (t // {step_us} + 1) * {step_us} AS emitted_us, count(*) AS n FROM firsts GROUP BY ALL),
{name} AS MATERIALIZED (
  SELECT {keys}, (sum(n) OVER (PARTITION BY {keys} ORDER BY emitted_us))::BIGINT AS {value}, emitted_us
  FROM {name}_changes)"""


def _feed(name: str, log: str, keys: str, value: str) -> str:
    identity = [*keys.split(", "), value]
    return f"""
{name} AS MATERIALIZED (
  SELECT *, emitted_us + ("offset" % 432000) * 1000000 AS arrival_us
  FROM (SELECT l.*, {_number(*identity, 'c.copy')} AS "offset", l.{value} AS version
        FROM {log} l, (VALUES (0), (1)) c(copy)
        WHERE c.copy = 0 OR {_number(*identity)} % 3 = 0))"""


SHARD_LOG = f"{FIRST}, {_log('shard_log', 'video_id, counter_shard_id', 'count', DAY_US)}"
SHARD_FEED = f"{SHARD_LOG}, {_feed('shard_feed', 'shard_log', 'video_id, counter_shard_id', 'count')}"
TOTAL_LOG = f"{FIRST}, {_log('total_log', 'video_id', 'view_count', DAY_US // 24)}"
TOTAL_FEED = f"{TOTAL_LOG}, {_feed('total_feed', 'total_log', 'video_id', 'view_count')}"

CHANGES = f"""{TOTAL_FEED},
changes AS (
  SELECT *, CASE WHEN "offset" % 79 = 0 THEN 'version' WHEN "offset" % 73 = 0 THEN 'video'
                 WHEN "offset" % 89 = 0 THEN 'null' WHEN "offset" % 97 = 0 THEN 'cut' ELSE '' END AS damage
  FROM total_feed),
outcomes AS (
  SELECT *, CASE WHEN damage = 'cut' THEN 'json' WHEN "offset" % 83 = 0 THEN 'operation'
                 WHEN damage = 'version' THEN 'field' WHEN damage = 'video' THEN 'contract' END AS error
  FROM changes WHERE damage <> 'null')"""

RECORDS = f"""{IDENTIFIED},
records AS (
  SELECT *, CASE WHEN source_id % 83 = 0 THEN 'tombstone' WHEN source_id % 97 = 0 THEN 'undecodable'
                 WHEN source_id % 89 = 0 THEN 'key' END AS reason,
         video_id || ':' || counter_shard_id || CASE WHEN source_id % 89 = 0 THEN '0' ELSE '' END AS key
  FROM identified)"""

USERS = f"""{REQUESTS},
users AS MATERIALIZED (SELECT user_id AS video_id, count(*) AS view_count FROM requests GROUP BY ALL),
projected AS MATERIALIZED (
  SELECT video_id, view_count + CASE WHEN video_id % 4 = 0 THEN 1 ELSE 0 END AS version,
         CASE WHEN video_id % 5 <> 0 THEN view_count + CASE WHEN video_id % 4 = 0 THEN 1 ELSE 0 END END AS count
  FROM users WHERE video_id % 3 > 0)"""

_MIDPOINT_US = f"epoch_us(TIMESTAMP '{MIDPOINT}')"

STORED = f"""{TOTAL_FEED},
all_videos AS (SELECT video_id, max(view_count) AS n FROM total_log GROUP BY video_id),
pending AS (SELECT * FROM all_videos WHERE video_id % 4 > 0),
stored AS (
  SELECT video_id, max(view_count) + CASE WHEN video_id % 3 = 0 THEN 1000000 ELSE 0 END AS n FROM total_log
  WHERE emitted_us < {_MIDPOINT_US} AND video_id % 5 > 0 GROUP BY video_id)"""

_STALE = """coalesce(version <= max(version) OVER (PARTITION BY {keys} ORDER BY arrival_us, "offset"
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)"""


_PART = """CASE WHEN arrival_us < epoch_us(TIMESTAMP '2024-01-09') THEN 0
                WHEN arrival_us < epoch_us(TIMESTAMP '2024-01-17') THEN 1
                WHEN arrival_us < epoch_us(TIMESTAMP '2024-01-25') THEN 2 ELSE 3 END"""


_SNAPSHOT_REASON = """CASE WHEN "offset" % 83 = 0 THEN 'tombstone' WHEN "offset" % 97 = 0 THEN 'contract'
                            WHEN "offset" % 89 = 0 THEN 'key' END"""


def _unless_null(name: str, value: str | None = None) -> str:
    """A decoded column: null for records without a value."""
    return f'CASE WHEN "offset" % 83 <> 0 THEN {value or name} END AS {name}'


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


ACCEPTED = f"""RECURSIVE {RAW},
accepted AS MATERIALIZED (
  SELECT video_id, epoch_us(accepted_at) AS t, {_hmac(_id_message('normal'))} AS event_id
  FROM checked
  WHERE mutation AND email_ok AND token_ok AND length(normal) <= 254 AND video_id > 0 AND time_ok),
sharded AS MATERIALIZED (SELECT *, {_shard('event_id')} AS counter_shard_id FROM accepted),
{_chain('sharded', WEEK_US).strip()}"""

ORACLES: dict[str, str] = {
    "request_scan": _with(
        REQUESTS,
        """SELECT source_id, video_id, email, idempotency_key, epoch_us(occurred_at) AS occurred_us,
                  epoch_us(accepted_at) AS accepted_us FROM requests""",
    ),
    "counter_point_lookup": _with(
        FIRST, "SELECT video_id, count(*) AS view_count, count(*) AS version FROM firsts WHERE video_id = 7 GROUP BY ALL"
    ),
    "projection_point_lookup": _with(
        USERS, "SELECT count, count AS version FROM projected WHERE video_id = 8 AND count IS NOT NULL"
    ),
    "snapshot_reread": _with(
        FIRST, "SELECT 'r' AS op, video_id, count(*) AS count, count(*) AS version FROM firsts GROUP BY video_id"
    ),
    "compact_latest": _with(
        TOTAL_FEED,
        """SELECT video_id::VARCHAR AS key, "offset", view_count FROM total_feed
           QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY "offset" DESC) = 1""",
    ),
    "retention_filter": _with(
        RECORDS,
        """SELECT source_id AS "offset", key, t AS arrival_us FROM records
           WHERE accepted_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY""",
    ),
    "topic_retention": _with(
        RECORDS,
        """SELECT source_id AS "offset", key, t AS arrival_us, accepted_at::DATE::VARCHAR AS day FROM records
           WHERE accepted_at::DATE >= DATE '2024-01-31' - INTERVAL 14 DAY""",
    ),
    "version_gated_upsert": _with(
        STORED,
        """SELECT coalesce(s.video_id, l.video_id) AS video_id, greatest(s.n, l.n) AS view_count,
                  greatest(s.n, l.n) AS version
           FROM stored s FULL JOIN pending l ON s.video_id = l.video_id""",
    ),
    "projection_apply": _with(
        STORED,
        f"""SELECT 'video:' || coalesce(s.video_id, l.video_id) || ':views' AS key,
                   coalesce(s.video_id, l.video_id) AS video_id,
                   CASE WHEN s.video_id % 7 = 0 THEN -1 ELSE greatest(s.n, l.n) END AS count,
                   CASE WHEN s.video_id % 7 = 0 THEN a.n ELSE greatest(s.n, l.n) END + {LARGE_VERSION} AS version
            FROM stored s FULL JOIN pending l ON s.video_id = l.video_id
                 LEFT JOIN all_videos a ON a.video_id = s.video_id""",
    ),
    "projection_apply_outcome": _with(
        STORED,
        f"""SELECT f."offset", f.video_id, f.version + {LARGE_VERSION} AS version,
                   NOT (f.stale OR coalesce(f.version <= CASE WHEN s.video_id % 7 = 0 THEN a.n ELSE s.n END, false)) AS applied
            FROM (SELECT *, {_STALE.format(keys='video_id')} AS stale FROM total_feed) f
                 LEFT JOIN stored s ON s.video_id = f.video_id LEFT JOIN all_videos a ON a.video_id = s.video_id""",
    ),
    "ledger_insert_if_absent": """
        SELECT 'gen-' || user_id AS id, 'execute-snapshot' AS type,
               CASE WHEN user_id % 2 = 0 THEN 'earlier' ELSE arg_min(props, event_id) END AS data
        FROM events GROUP BY user_id""",
    "email_normalize": _with(RAW, "SELECT source_id, normal AS normalized_email FROM judged"),
    "user_hash": _with(IDENTIFIED, "SELECT source_id, user_hash FROM identified"),
    "event_identity": _with(IDENTIFIED, "SELECT source_id, event_id FROM identified"),
    "shard_assign": _with(IDENTIFIED, "SELECT source_id, counter_shard_id FROM identified"),
    "shard_key_parse": _with(
        IDENTIFIED,
        "SELECT source_id, video_id || ':' || counter_shard_id AS key, video_id, counter_shard_id FROM identified",
    ),
    "occurred_default": _with(IDENTIFIED, "SELECT source_id, epoch_us(occurred_at) AS occurred_us FROM identified"),
    "identity_sanitize": _with(
        RAW,
        """SELECT source_id, CASE WHEN mutation THEN normal END AS authenticated_email,
                  CASE WHEN regexp_full_match(request_id, '[A-Za-z0-9_-]{1,128}') THEN request_id
                       ELSE 'generated' END AS request_id FROM judged""",
    ),
    "decode_contract": _with(
        RECORDS,
        """SELECT source_id AS "offset", ok AS decoded,
                  CASE WHEN ok THEN event_id END AS event_id, CASE WHEN ok THEN video_id END AS video_id,
                  CASE WHEN ok THEN user_hash END AS user_hash,
                  CASE WHEN ok THEN counter_shard_id END AS counter_shard_id,
                  CASE WHEN ok THEN epoch_us(occurred_at) END AS occurred_us, CASE WHEN ok THEN t END AS accepted_us
           FROM (SELECT *, coalesce(reason NOT IN ('tombstone', 'undecodable'), true) AS ok FROM records)""",
    ),
    "decode_shard_snapshot": _with(
        SHARD_FEED,
        f"""SELECT "offset", {_SNAPSHOT_REASON} AS reason, {_unless_null('video_id')}, {_unless_null('counter_shard_id')},
                   {_unless_null('count')},
                   {_unless_null('version', 'version - CASE WHEN "offset" % 97 = 0 THEN 1 ELSE 0 END')},
                   {_unless_null('emitted_us')} FROM shard_feed""",
    ),
    "decode_total_snapshot": _with(
        TOTAL_FEED,
        f"""SELECT "offset", {_SNAPSHOT_REASON} AS reason, {_unless_null('video_id')}, {_unless_null('view_count')},
                   {_unless_null('version', 'version - CASE WHEN "offset" % 97 = 0 THEN 1 ELSE 0 END')},
                   {_unless_null('emitted_us')} FROM total_feed""",
    ),
    "accepted_response": _with(ACCEPTED, "SELECT event_id, 'ACCEPTED' AS status FROM accepted"),
    "cdc_unwrap": _with(
        CHANGES,
        f"""SELECT "offset", CASE WHEN error IS NULL THEN substr('cur', ("offset" % 3 + 1)::INTEGER, 1) END AS op,
                   CASE WHEN error IS NULL THEN video_id END AS video_id,
                   CASE WHEN error IS NULL THEN view_count END AS count,
                   CASE WHEN error IS NULL THEN version + {LARGE_VERSION} END AS version, error FROM outcomes""",
    ),
    "route_filter": _with(RAW, "SELECT source_id, method, path FROM judged WHERE mutation"),
    "admission_filter": _with(RAW, "SELECT source_id, NOT mutation OR (email_ok AND token_ok) AS admitted FROM checked"),
    "request_validate": _with(
        RAW,
        """SELECT source_id, CASE WHEN video_id <= 0 THEN 'video'
                  WHEN NOT (email_ok AND token_ok AND email = normal) THEN 'identity'
                  WHEN NOT time_ok THEN 'occurrence' END AS reason FROM checked""",
    ),
    "occurrence_bounds": _with(RAW, "SELECT source_id, time_ok AS plausible FROM judged"),
    "contract_view_event": _with(
        REQUESTS,
        """SELECT source_id, NOT (source_id % 61 IN (0, 1) OR source_id % 41 = 0 OR source_id % 67 = 0
                  OR source_id % 71 = 0 OR source_id % 73 = 0) AS is_valid FROM requests""",
    ),
    "contract_shard_snapshot": _with(
        SHARD_FEED,
        """SELECT "offset", NOT ("offset" % 5 = 0 OR "offset" % 7 = 0 OR "offset" % 11 = 0) AS is_valid
           FROM shard_feed""",
    ),
    "contract_total_snapshot": _with(
        TOTAL_FEED, """SELECT "offset", NOT ("offset" % 5 = 0 OR "offset" % 7 = 0) AS is_valid FROM total_feed"""
    ),
    "contract_projection": _with(
        TOTAL_FEED, """SELECT "offset", NOT ("offset" % 5 = 0 OR "offset" % 7 = 0) AS is_valid FROM total_feed"""
    ),
    "key_agreement": _with(
        IDENTIFIED,
        """SELECT source_id, counter_shard_id < 120 AND source_id % 89 <> 0 AS event_stage,
                  counter_shard_id < 120 AND source_id % 79 <> 0 AS shard_stage,
                  source_id % 79 <> 0 AS total_sink FROM identified""",
    ),
    "valid_invalid_split": _with(
        RECORDS,
        """SELECT 'video-view-events' || CASE WHEN reason IS NULL THEN '' ELSE '.DLT' END AS topic,
                  (source_id % 24)::INTEGER AS "partition", source_id AS "offset", key, reason FROM records""",
    ),
    "cdc_op_filter": _with(
        CHANGES, "SELECT coalesce(error, 'usable') AS outcome, count(*) AS changes FROM outcomes GROUP BY ALL"
    ),
    "table_audit": _with(
        USERS,
        """SELECT video_id, 'duplicate_id' AS rule FROM users WHERE video_id % 11 = 0
           UNION ALL SELECT video_id, 'null_value' FROM users WHERE video_id % 7 = 0
           UNION ALL SELECT video_id, 'negative_count' FROM users WHERE video_id % 13 = 0
           UNION ALL SELECT video_id, 'version_not_count' FROM users WHERE video_id % 13 = 0 AND video_id % 7 <> 0""",
    ),
    "stale_snapshots": _with(
        SHARD_FEED,
        f"""SELECT "offset", video_id, counter_shard_id, version,
                   {_STALE.format(keys='video_id, counter_shard_id')} AS stale FROM shard_feed""",
    ),
    "horizon_dedup": _with(COUNTED, "SELECT event_id, video_id, counter_shard_id, t AS counted_us FROM chain"),
    "horizon_dedup_hot_ids": _with(
        f"""RECURSIVE hot AS MATERIALIZED (
              SELECT event_type AS event_id, 0 AS video_id, 0 AS counter_shard_id, epoch_us(ts) AS t FROM events),
            {_chain('hot', 3 * DAY_US).strip()}""",
        "SELECT event_id, t AS counted_us FROM chain",
    ),
    "shard_counts": _with(
        COUNTED, "SELECT video_id, counter_shard_id, count(*) AS count FROM chain GROUP BY video_id, counter_shard_id"
    ),
    "latest_shard": _with(
        FIRST, "SELECT video_id, counter_shard_id, count(*) AS count FROM firsts GROUP BY video_id, counter_shard_id"
    ),
    "video_totals": _with(COUNTED, "SELECT video_id, count(*) AS view_count FROM chain GROUP BY video_id"),
    "unique_events_full_horizon": _with(
        IDENTIFIED, "SELECT video_id, count(DISTINCT event_id) AS unique_events FROM identified GROUP BY video_id"
    ),
    "late_events_counted": _with(
        f"""RECURSIVE {IDENTIFIED},
            late AS MATERIALIZED (SELECT * FROM identified WHERE occurred_at < accepted_at - INTERVAL 7 DAY),
            {_chain('late', WEEK_US).strip()}""",
        "SELECT video_id, count(*) AS view_count FROM chain GROUP BY video_id",
    ),
    "snapshot_per_tick": _with(
        f"""{COUNTED},
            ticks AS (SELECT video_id, counter_shard_id, (t // 1000000 + 1) * 1000000 AS emitted_us, count(*) AS n
                      FROM chain GROUP BY ALL),
            snapshots AS (SELECT *, (sum(n) OVER (PARTITION BY video_id, counter_shard_id ORDER BY emitted_us))::BIGINT
                          AS count FROM ticks)""",
        "SELECT video_id, counter_shard_id, count, count AS version, emitted_us FROM snapshots",
    ),
    "total_snapshot_per_tick": _with(
        f"""{COUNTED},
            ticks AS (SELECT video_id, (t // 1000000 + 1) * 1000000 AS emitted_us, count(*) AS n FROM chain GROUP BY ALL),
            snapshots AS (SELECT *, (sum(n) OVER (PARTITION BY video_id ORDER BY emitted_us))::BIGINT AS view_count
                          FROM ticks)""",
        "SELECT video_id, view_count, view_count AS version, emitted_us FROM snapshots",
    ),
    "replay_invariance": _with(FIRST, "SELECT video_id, count(*) AS view_count FROM firsts GROUP BY video_id"),
    "accepted_view_totals": _with(ACCEPTED, "SELECT video_id, count(*) AS view_count FROM chain GROUP BY video_id"),
    "counter_metrics": _with(
        f"""{ACCEPTED.replace(REQUESTS.strip(), IDENTIFIED.strip())},
            {_chain('identified', WEEK_US, 'unique_events').strip()},
            firsts AS MATERIALIZED (
              SELECT event_id, video_id, counter_shard_id, min(t) AS t FROM identified GROUP BY ALL),
            {_log('shard_log', 'video_id, counter_shard_id', 'count', DAY_US).strip()},
            {_feed('shard_feed', 'shard_log', 'video_id, counter_shard_id', 'count').strip()},
            {_log('total_log', 'video_id', 'view_count', DAY_US // 24).strip()},
            {_feed('total_feed', 'total_log', 'video_id', 'view_count').strip()},
            stale_shards AS (SELECT {_STALE.format(keys='video_id, counter_shard_id')} AS stale FROM shard_feed),
            stale_changes AS (SELECT {_STALE.format(keys='video_id')} AS stale FROM total_feed)""",
        """SELECT 'view_requests_total' AS metric, count(*) AS value FROM accepted
           UNION ALL SELECT 'view_events_published_total', count(*) FROM accepted
           UNION ALL SELECT 'unique_view_events_total', count(*) FROM unique_events
           UNION ALL SELECT 'duplicate_view_events_total',
                            (SELECT count(*) FROM identified) - (SELECT count(*) FROM unique_events)
           UNION ALL SELECT 'counter_shard_snapshots_total', count(*) FROM shard_feed
           UNION ALL SELECT 'stale_shard_snapshots_total', count(*) FROM stale_shards WHERE stale
           UNION ALL SELECT 'video_total_snapshots_total', count(*) FROM total_log
           UNION ALL SELECT 'counter_sink_success_total', count(*) FROM total_feed
           UNION ALL SELECT 'counter_cdc_rebuilds', count(DISTINCT user_id) FROM events WHERE user_id % 2 = 1
           UNION ALL SELECT 'counter_cdc_processed', count(*) FROM stale_changes WHERE NOT stale
           UNION ALL SELECT 'counter_cdc_stale', count(*) FROM stale_changes WHERE stale""",
    ),
    "stream_counter_metrics": _with(
        f"""{ACCEPTED.replace(REQUESTS.strip(), IDENTIFIED.strip())},
            {_chain('identified', WEEK_US, 'unique_events').strip()},
            firsts AS MATERIALIZED (
              SELECT event_id, video_id, counter_shard_id, min(t) AS t FROM identified GROUP BY ALL),
            {_log('shard_log', 'video_id, counter_shard_id', 'count', DAY_US).strip()},
            {_feed('shard_feed', 'shard_log', 'video_id, counter_shard_id', 'count').strip()},
            {STORED.replace(FIRST, '').strip().removeprefix(',').strip()},
            stale_shards AS (SELECT {_STALE.format(keys='video_id, counter_shard_id')} AS stale FROM shard_feed),
            shard_parts AS (SELECT *, {_PART} AS part FROM shard_feed),
            latest AS (
              SELECT p.part, video_id, counter_shard_id, max(count) AS n
              FROM (VALUES (0), (1), (2), (3)) p(part) JOIN shard_parts f ON f.part <= p.part GROUP BY ALL),
            sums AS (SELECT part, video_id, sum(n) AS n FROM latest GROUP BY ALL),
            emitted AS (SELECT n > coalesce(lag(n) OVER (PARTITION BY video_id ORDER BY part), 0) AS newer FROM sums),
            change_parts AS (
              SELECT *, {_STALE.format(keys='video_id')} AS late, {_PART} AS part FROM total_feed WHERE video_id % 4 > 0),
            stale_changes AS (  -- from the second part on, the rebuilt rows are there
              SELECT late OR (part > 0 AND coalesce(version <= s.n, false)) AS stale
              FROM change_parts c LEFT JOIN stored s ON s.video_id = c.video_id)""",
        f"""SELECT 'view_requests_total' AS metric, count(*) AS value FROM accepted
            UNION ALL SELECT 'view_events_published_total', count(*) FROM accepted
            UNION ALL SELECT 'unique_view_events_total', count(*) FROM unique_events
            UNION ALL SELECT 'duplicate_view_events_total',
                             (SELECT count(*) FROM identified) - (SELECT count(*) FROM unique_events)
            UNION ALL SELECT 'counter_shard_snapshots_total', count(*) FROM shard_feed
            UNION ALL SELECT 'stale_shard_snapshots_total', count(*) FROM stale_shards WHERE stale
            UNION ALL SELECT 'video_total_snapshots_total', count(*) FROM emitted WHERE newer
            UNION ALL SELECT 'counter_sink_success_total', (SELECT count(*) FROM emitted WHERE newer)
                             + (SELECT count(*) FROM total_feed WHERE ({_SNAPSHOT_REASON}) IS NULL)
            UNION ALL SELECT 'counter_cdc_rebuilds', 1
            UNION ALL SELECT 'counter_cdc_processed', count(*) FROM stale_changes WHERE NOT stale
            UNION ALL SELECT 'counter_cdc_stale', count(*) FROM stale_changes WHERE stale""",
    ),
    "stream_snapshot_per_tick": _with(
        f"{FIRST}, {_log('shard_log', 'video_id, counter_shard_id', 'count', DAY_US // 24).strip()}",
        """SELECT video_id, counter_shard_id, count, count AS version, emitted_us FROM shard_log
           WHERE emitted_us < (SELECT max(t) FROM firsts) - 10000000""",
    ),
    "resolve_counts": _with(
        f"""{USERS},
            ids AS (SELECT user_id AS video_id FROM requests UNION SELECT user_id * 2 - 1 FROM requests)""",
        """SELECT i.video_id, coalesce(p.count, u.view_count, 0) AS views
           FROM ids i LEFT JOIN projected p ON p.video_id = i.video_id
                LEFT JOIN users u ON u.video_id = i.video_id AND u.video_id % 2 = 1
           WHERE i.video_id > 0""",
    ),
    "resolve_counts_lost_projection": _with(
        f"""{USERS},
            ids AS (SELECT user_id AS video_id FROM requests UNION SELECT user_id * 2 - 1 FROM requests)""",
        """SELECT i.video_id, coalesce(u.view_count, 0) AS views
           FROM ids i LEFT JOIN users u ON u.video_id = i.video_id AND u.video_id % 2 = 1 WHERE i.video_id > 0""",
    ),
    "projection_rebuild": _with(
        STORED,
        """SELECT 'video:' || coalesce(s.video_id, l.video_id) || ':views' AS key,
                  coalesce(s.video_id, l.video_id) AS video_id, greatest(s.n, l.n) AS count, greatest(s.n, l.n) AS version
           FROM stored s FULL JOIN pending l ON s.video_id = l.video_id""",
    ),
    "projection_lag_audit": _with(
        USERS,
        """SELECT u.video_id, u.view_count AS table_version, p.version AS projection_version
           FROM users u LEFT JOIN projected p ON p.video_id = u.video_id
           WHERE p.version IS DISTINCT FROM u.view_count""",
    ),
}

# a stream gives what the batch gives
ORACLES["stream_horizon_dedup"] = ORACLES["horizon_dedup"]
ORACLES["stream_horizon_dedup_stateful"] = ORACLES["horizon_dedup"]
ORACLES["stream_video_totals"] = _with(
    COUNTED, "SELECT video_id, count(*) AS view_count, count(*) AS version FROM chain GROUP BY video_id"
)
ORACLES["stream_quarantine"] = ORACLES["valid_invalid_split"]
ORACLES["stream_shard_quarantine"] = _with(
    SHARD_FEED,
    f"""SELECT 'counter-shard-snapshots' || CASE WHEN {_SNAPSHOT_REASON} IS NULL THEN '' ELSE '.DLT' END AS topic,
               "offset", {_SNAPSHOT_REASON} AS reason, {_unless_null('video_id')}, {_unless_null('counter_shard_id')},
               {_unless_null('count')},
               {_unless_null('version', 'version - CASE WHEN "offset" % 97 = 0 THEN 1 ELSE 0 END')} FROM shard_feed""",
)
ORACLES["stream_redelivery"] = _with(
    f"{TOTAL_FEED}, judged AS (SELECT *, {_SNAPSHOT_REASON} AS reason FROM total_feed)",
    """SELECT video_id, max(view_count) AS view_count, max(view_count) AS version, NULL::BIGINT AS "offset",
              NULL::VARCHAR AS reason FROM judged WHERE reason IS NULL GROUP BY video_id
       UNION ALL
       SELECT DISTINCT NULL, NULL, NULL, "offset", reason FROM judged WHERE reason IS NOT NULL""",
)
ORACLES["stream_projection"] = ORACLES["projection_rebuild"]
