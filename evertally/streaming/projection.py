"""Change feed to projection, with rebuild of a lost projection.

A rebuild reads the counter table again in chunks of ids, one with each micro-batch of changes, so that a table of any
size is rebuilt beside the live feed and a micro-batch stays small. After each chunk the next id is noted in the
projection's folder: a restart goes on from there. Chunks and changes meet the same version gate, hence a change that
arrives before or after the chunk of its row wins if it is newer.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evertally import fixed_values as fixed
from evertally.functions.contracts import REBUILD_LEDGER
from evertally.functions.identity import projection_key
from evertally.operators import cdc, gate
from evertally.operators.metrics import projection_counters
from evertally.settings import positive_count
from evertally.sources.folders import Table, run_of
from evertally.streaming.counters import Counters

MARKER = "_generation"
PROGRESS = "_rebuilt"
#: Ids of a chunk; at most as many rows.
CHUNK_IDS = 1_000_000


class Projection:
    """The projection table, its generation marker and the ledger of rebuild requests.

    The marker lives in the projection's folder: losing the projection loses the marker, and that is
    how a loss is noticed. One writer maintains a projection.
    """

    def __init__(
        self,
        table: Table,
        source: Table,
        ledger: Table,
        prefix: str = fixed.PROJECTION_PREFIX,
        chunk_ids: int = CHUNK_IDS,
    ):
        self.table = table
        self.source = source
        self.ledger = ledger
        self.prefix = prefix
        self.chunk_ids = positive_count("ids of a chunk", chunk_ids)

    def pending_generation(self) -> str | None:
        """The generation that still needs a rebuild; electing one when there is no marker."""
        marker = self.table.folder.read_text(MARKER)
        if marker is None:
            marker = str(uuid.uuid4())
            self.table.folder.write_text(MARKER, marker, overwrite=False)
        return None if marker.startswith(fixed.REQUESTED_PREFIX) else marker

    def mark_requested(self, generation: str) -> None:
        """Only the elected generation may be marked; a newer loss must stay visible."""
        if self.table.folder.read_text(MARKER) == generation:
            self.table.folder.write_text(MARKER, fixed.REQUESTED_PREFIX + generation)

    def outcomes(self, changes: DataFrame) -> dict[str, int]:
        """How many of the changes (with `arrival`) the projection takes as they arrive, and how many it does not."""
        return projection_counters(gate.flag_applied(changes, projection=self._stored(changes))).first().asDict()

    def _stored(self, changes: DataFrame) -> DataFrame:
        """What the gate needs of the projection for these changes."""
        keys = changes.select(projection_key(F.col("video_id"), self.prefix).alias("key"))
        return self.table.read(keys, ["video_id", "count"])

    def request(self, generation: str) -> bool:
        """Enter the rebuild in the ledger; false when it is already there."""
        entry = (generation, fixed.REBUILD_SIGNAL, json.dumps(fixed.REBUILD_REQUEST))
        row = self.ledger.spark.createDataFrame([entry], REBUILD_LEDGER)
        known = self.ledger.read()
        if gate.absent_rows(known, row).isEmpty():
            return False
        self.ledger.replace(gate.insert_if_absent(known, row))
        return True

    def _next_id(self, generation: str) -> int | None:
        """The first id of the table that this rebuild has not read yet."""
        noted = json.loads(self.table.folder.read_text(PROGRESS) or "{}")
        rows = self.source.read()
        if noted.get("generation") == generation:
            rows = rows.filter(F.col("video_id") >= noted["next"])
        return rows.agg(F.min("video_id")).first()[0]

    def _chunk(self, first: int) -> DataFrame:
        """The rows of a chunk; its bounds reach the scan."""
        rows = self.source.read().filter(F.col("video_id").between(first, first + self.chunk_ids - 1))
        return cdc.reread(rows).withColumn("offset", F.lit(-1).cast("bigint"))

    def apply(self, changes: DataFrame) -> bool:
        """Apply changes (video_id, count, version, offset), and one more chunk while the projection is rebuilt.

        Progress is noted after the chunk is stored, and the marker is set last: a crash before either repeats what is
        harmless. Returns whether a rebuild was requested.
        """
        generation = self.pending_generation()
        first, requested = None, False
        if generation is not None:
            requested = self.request(generation)
            first = self._next_id(generation)
            if first is not None:
                changes = changes.unionByName(self._chunk(first).select(*changes.columns))
        self.table.upsert(gate.newer_changes(changes, self._stored(changes), prefix=self.prefix))
        if first is not None:
            self.table.folder.write_text(PROGRESS, json.dumps({"generation": generation, "next": first + self.chunk_ids}))
        if generation is not None and self._next_id(generation) is None:
            self.mark_requested(generation)
        return requested

    def recover(self) -> None:
        """The periodic check: rebuild, chunk by chunk, when the projection was lost, else do nothing."""
        while self.pending_generation() is not None:
            nothing = "video_id BIGINT, count BIGINT, version BIGINT, offset BIGINT"
            self.apply(self.table.spark.createDataFrame([], nothing))


def project_changes(
    feed: DataFrame, projection: Projection, checkpoint: str, counters: Counters | None = None
) -> DataStreamWriter:
    """Apply a change feed. An unusable change stops the query with its offset kept: nothing is skipped.

    Counted are the changes of the feed, not the rows of a rebuild.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        changes = cdc.strict(cdc.unwrap(batch))
        if counters is not None:  # before they are applied: a repetition would find them stale
            run = run_of(batch.sparkSession, checkpoint)
            counters.add("project-changes", run, batch_id, projection.outcomes(changes))
        requested = projection.apply(changes.select("video_id", "count", "version", "offset"))
        if counters is not None:
            counters.add("project-changes", run, batch_id, {"counter_cdc_rebuilds": int(requested)})

    return feed.writeStream.queryName("project-changes").option("checkpointLocation", checkpoint).foreachBatch(write)
