"""Names, patterns and defaults that results depend on."""

from datetime import timedelta

# Topics (fixed values)
VIEWS_TOPIC = "video-view-events"
SHARDS_TOPIC = "counter-shard-snapshots"
TOTALS_TOPIC = "video-total-snapshots"
CDC_TOPIC = "counter-cdc.public.video_counter"
DEAD_LETTER_SUFFIX = ".DLT"

# Patterns (fixed values); `\A…\z` makes Spark's `rlike` a full match
EMAIL = r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z"
TOKEN = r"\A[A-Za-z0-9_-]{1,128}\z"
HEX_DIGEST = r"\A[0-9a-f]{64}\z"
MUTATION_PATH = r"\A/api/videos/[^/]+/views/?\z"

# Limits and defaults (fixed values)
MAX_EMAIL_LENGTH = 254
MIN_SECRET_LENGTH = 32
SHARD_COUNT = 128
DEDUP_HORIZON = timedelta(days=7)
SNAPSHOT_INTERVAL = timedelta(seconds=1)
MAX_OCCURRENCE_AGE = timedelta(days=3650)
MAX_FUTURE_SKEW = timedelta(minutes=5)
TOPIC_RETENTION = timedelta(days=14)
RECORDS_PER_POLL = 50

# Stored names (fixed values)
PROJECTION_PREFIX = "video:"
PROJECTION_SUFFIX = ":views"
SOURCE_TABLE = "public.video_counter"
REBUILD_SIGNAL = "execute-snapshot"
REBUILD_REQUEST = {"type": "incremental", "data-collections": [SOURCE_TABLE]}
REQUESTED_PREFIX = "requested:"
ACCEPTED_STATUS = "ACCEPTED"
CDC_OPERATIONS = ("c", "u", "r")
