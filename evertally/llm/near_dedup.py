"""Near duplicates by bottom-k sketches of one hash function.

1. Every document becomes its set of hashed word shingles. Equal sets are one class from here on, and the k
   smallest hashes of a class are its sketch.
2. Inverted lists of the sketched values generate candidates. Of two sets at the threshold, the sketches share at
   least a certain number of values (beyond five standard deviations), so it suffices to list a class under its
   rarest values, as many as the sketch has beyond that number. Values of one class only are not listed.
3. In every list the first class is a hub and is paired with all later ones; classes that are linked by then need no more
   comparison. Lists that still hold several components get eight hubs more. So a group of copies costs a few pairs per
   member. What is left then, lists of classes alike but mostly not linked, is cut into blocks of bounded size; any
   two blocks of a list meet in one task, which compares the full sets and returns links between components only.
4. Pairs with hubs are filtered by the estimate from the sketch of their union, then verified on the full sets.
5. Links become components in Spark joins.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle is one shingle; null ids come after all others; repeated rows share a class, and `deduplicated`
keeps one of them; empty tables give empty results; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evertally.llm import words as w
from evertally.llm.components import components
from evertally.llm.tables import fresh_name, small_side, written

SKETCH = 64
#: Standard deviations by which shared sketch values may fall short of their mean.
MARGIN = 5.0
#: Hubs per list in each round, and what a block of the lists that are left holds at most, about.
HUBS = (1, 8)
BLOCK_SHINGLES, BLOCK_MEMBERS = 300_000, 1500
SHINGLE_WORDS = 5
PERCENT = 80


def shingle_sets(texts: pa.Array, length: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) a slice at a time: distinct shingle hashes in ascending order (non-negative 63-bit integers)."""
    for base, part in w.words_by_slice(texts, w.NOT_SPACE, w.ASCII_LOWER):
        at = part.windows(length)
        hashes = (part.window_hashes(at, length) >> w.U64(1)).astype(np.int64)
        bounds = np.searchsorted(at, part.first)
        sets = []
        for row, count in enumerate(part.counts().tolist()):
            if count >= length:
                sets.append(np.unique(hashes[bounds[row] : bounds[row + 1]]))
            elif count:
                whole = part.window_hashes(part.first[row : row + 1], count)
                sets.append((whole >> w.U64(1)).astype(np.int64))
            else:
                sets.append(np.empty(0, dtype=np.int64))
        yield base, sets


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    values = shingles.astype(w.U64)
    sums = [w.mixed(values ^ w.U64(salt)).sum(dtype=w.U64) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return np.array(sums, dtype=w.U64).tobytes()


def least_shared(size: int, percent: int, k: int) -> int:
    """Sketch values that a set of this size shares at least with one at the threshold.

    The union holds at most size / threshold shingles. If it fits into a sketch, the number is exact; otherwise the
    shared ones among its k smallest are a draw without replacement, and the mean less MARGIN deviations counts.
    """
    t = percent / 100
    exact = -(-size * percent // 100)
    union = size * 100 // percent
    if union <= k:
        return exact
    deviation = (k * t * (1 - t) * (union - k) / max(union - 1, 1)) ** 0.5
    return max(1, min(exact, int(t * k - MARGIN * deviation)))


@w.lean
def _signatures(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], length: int, percent: int, k: int):
    for batch in batches:
        for base, sets in shingle_sets(batch.column(text), length):
            listed = [min(len(s), k) - least_shared(len(s), percent, k) + 1 if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(base, len(sets)) for c in keep]
                + [
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], type=pa.binary()),
                    pa.array([s[:k] for s in sets], type=pa.list_(pa.int64())),
                    pa.array(listed, type=pa.int32()),
                ],
                names=[*keep, "n_shingles", "cls", "sketch", "listed"],
            )


@w.lean
def _keyed(batches: Iterator[pa.RecordBatch], text: str, key: str, length: int) -> Iterator[pa.RecordBatch]:
    """The rows with the key of their set, null for an empty one."""
    for batch in batches:
        for base, sets in shingle_sets(batch.column(text), length):
            keys = pa.array([set_key(s) if len(s) else None for s in sets], type=pa.binary())
            columns = batch.slice(base, len(sets)).columns
            yield pa.RecordBatch.from_arrays([*columns, keys], names=[*batch.schema.names, key])


def likely(percent: int, k: int) -> Column:
    """Whether the sketch of the union of a pair leaves the threshold possible; exact if both sets are sketched whole."""
    t = percent / 100
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    whole = F.greatest("n_a", "n_b") <= k
    used = F.when(whole, F.size(F.array_union("sketch_a", "sketch_b"))).otherwise(F.size(union))
    both = F.array_intersect("sketch_a", "sketch_b")
    shared = F.when(whole, F.size(both)).otherwise(F.size(F.array_intersect(both, union)))
    return F.when(whole, 100 * shared >= percent * used).otherwise(
        shared >= t * used - MARGIN * F.sqrt(used * (t * (1 - t)))
    )


def linked(percent: int) -> Column:
    """Whether a pair of sets reaches the threshold."""
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return 100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)


@w.lean
def _sets(batches: Iterator[pa.RecordBatch], text: str, length: int) -> Iterator[pa.RecordBatch]:
    """Sets of the rows that still are what their class says."""
    for batch in batches:
        wanted = batch.column("wanted")
        for base, sets in shingle_sets(batch.column(text), length):
            keys = [set_key(s) if len(s) else None for s in sets]
            same = [a == b.as_py() for a, b in zip(keys, wanted.slice(base, len(sets)), strict=True)]
            rows = [pa.array(keys, type=pa.binary()), pa.array(sets, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(rows, names=["cls", "shingles"]).filter(pa.array(same, type=pa.bool_()))


def _links_across(block: pa.Table, percent: int) -> pa.Table:
    """Links between components among the sets of one or two blocks, no more than join what they join."""
    sets = [np.asarray(s) for s in block.column("shingles").combine_chunks().to_numpy(zero_copy_only=False)]
    keys, labels = block.column("cls").to_pylist(), block.column("label").to_pylist()
    home = block.column("block").to_numpy()
    two = block.column("i")[0] != block.column("j")[0]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    owner, value = owner[several[value]], (np.cumsum(several) - 1)[value[several[value]]]
    by_value = np.argsort(value, kind="stable")
    owner, value = owner[by_value], value[by_value]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(several.sum()), 2048):
        a, b = np.searchsorted(value, (first, first + 2048))
        holds = np.zeros((len(sets), 2048), dtype=np.float32)
        holds[owner[a:b], value[a:b] - first] = 1
        shared += holds @ holds.T
    links: list[tuple[bytes, bytes]] = []
    root: dict[bytes, bytes] = {}

    def find(label: bytes) -> bytes:
        while (above := root.get(label, label)) != label:
            label = above
        return label

    for row in range(len(sets)):
        close = 100 * shared[row] >= percent * (size + size[row] - shared[row])
        for other in np.flatnonzero(close[:row]).tolist():
            if two and home[row] == home[other]:
                continue
            a, b = find(labels[row]), find(labels[other])
            if a != b:
                root[a] = b
                links.append((keys[row], keys[other]))
    return pa.table(
        [pa.array([a for a, _ in links], type=pa.binary()), pa.array([b for _, b in links], type=pa.binary())], names=["a", "b"]
    )


def _links_and_memory(block: pa.Table, percent: int) -> pa.Table:
    try:
        return _links_across(block, percent)
    finally:
        w.give_back()


class NearDuplicates:
    """Classes of equal sets, and the links between them; making one runs the jobs."""

    def __init__(
        self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
        percent: int = PERCENT, k: int = SKETCH,
    ):
        self.docs, self.doc_id, self.text = docs, doc_id, text
        self.length, self.percent, self.k = shingle_words, percent, k
        # tells apart texts of equal or missing ids
        text_key = F.struct(F.xxhash64(text), F.hash(text)).alias("text_key")
        self.narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key)
        self.rows = written(self.signed(self.narrow, ["doc_id", "text_key"], "text"), "signatures")
        classes = self.rows.filter("n_shingles > 0").groupBy("cls", "n_shingles", "sketch", "listed")
        first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("rep"), F.col("text_key").alias("rep_key")))
        classes = classes.agg(first.alias("first"), F.count("*").alias("n_rows"))
        self.classes = written(classes.select("cls", "n_shingles", "sketch", "listed", "first.rep", "first.rep_key", "n_rows"), "classes")
        self.links = self._links()

    def signed(self, rows: DataFrame, keep: list[str], text: str) -> DataFrame:
        schema = T.StructType([rows.schema[c] for c in keep])
        schema = schema.add("n_shingles", T.LongType()).add("cls", T.BinaryType())
        schema = schema.add("sketch", T.ArrayType(T.LongType())).add("listed", T.IntegerType())
        sign = partial(_signatures, text=text, keep=keep, length=self.length, percent=self.percent, k=self.k)
        return rows.mapInArrow(sign, schema)

    def _lists(self) -> DataFrame:
        """(value, turn, n_shingles): each class under its rarest shared values; turn ends in the class."""
        postings = self.classes.select(
            "cls", "n_shingles", (F.col("listed") - F.size("sketch")).alias("slack"), F.size("sketch").alias("n_sketch"),
            F.explode("sketch").alias("value"),
        )
        shared = postings.groupBy("value").agg(F.count("*").alias("n_classes")).filter("n_classes > 1")
        shared = postings.join(shared, "value")
        of_class = Window.partitionBy("cls")
        # values of one class only are the rarest and need no list
        shared = shared.withColumn("rank", F.row_number().over(of_class.orderBy("n_classes", "value")))
        shared = shared.withColumn("n_shared", F.count("*").over(of_class))
        # what many others resemble comes first: it is the better hub
        turn = F.struct((-F.sum("n_classes").over(of_class) / F.col("n_sketch")).alias("fame"), F.col("cls"))
        return shared.withColumn("turn", turn).filter("rank <= slack + n_shared").select("value", "turn", "n_shingles")

    def _links(self) -> DataFrame:
        lists, links = written(self._lists(), "lists"), self._no_links()
        for hubs in HUBS:
            lists, found = self._round(self._unsettled(lists, links), hubs)
            links = written(links.union(found).distinct(), "links")
        return written(links.union(self._in_blocks(self._unsettled(lists, links))), "links")

    def _no_links(self) -> DataFrame:
        return self.docs.sparkSession.createDataFrame([], "a BINARY, b BINARY")

    def _unsettled(self, lists: DataFrame, links: DataFrame) -> DataFrame:
        """The lists that hold several components, with the label of each class."""
        lists = lists.join(components(links), F.col("turn.cls") == F.col("node"), "left")
        lists = lists.select("value", "turn", "n_shingles", F.coalesce("label", "turn.cls").alias("label"))
        several = lists.groupBy("value").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        several = several.filter("least != most").select("value")
        return written(lists.join(several, "value", "left_semi"), "lists")

    def _round(self, lists: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
        """(what is left of the lists, links) after pairing each list's first classes with all later ones."""
        first = Window.partitionBy("value").orderBy("turn")
        chosen = lists.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= hubs)
        chosen = written(chosen, "hubs")
        hub = chosen.select("value", F.col("turn").alias("hub"), F.col("n_shingles").alias("n"), F.col("label").alias("of"))
        pairs = lists.join(hub, "value").filter(
            (F.col("turn") > F.col("hub"))
            & (F.col("label") != F.col("of"))
            & (100 * F.least("n", "n_shingles") >= self.percent * F.greatest("n", "n_shingles"))
        )
        pairs = pairs.select(F.col("hub.cls").alias("a"), F.col("turn.cls").alias("b")).distinct()
        links = self._verified(pairs)
        last = chosen.groupBy("value").agg(F.max("turn").alias("last"))
        rest = lists.join(last, "value").filter(F.col("turn") > F.col("last")).select("value", "turn", "n_shingles")
        return rest, links

    def _verified(self, pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            figures = self.classes.select(
                F.col("cls").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("n_shingles").alias(f"n_{side}")
            )
            pairs = pairs.join(figures, side)
        pairs = written(pairs.filter(likely(self.percent, self.k)).select("a", "b"), "pairs")
        sets = self._sets(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))))
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("cls").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        return written(pairs.filter(linked(self.percent)).select("a", "b"), "links")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(cls, shingles) of the wanted classes, from the text of one of their documents."""
        sets = self._texts(wanted).mapInArrow(
            partial(_sets, text="text", length=self.length), "cls binary, shingles array<bigint>"
        )
        return written(sets, "sets")

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(wanted, text): one text for each of the wanted classes, whatever the ids of its documents."""
        wanted = self.classes.join(wanted.distinct(), "cls", "left_semi").select("rep", "rep_key", F.col("cls").alias("wanted"))
        wanted = written(wanted, "wanted")
        same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_key"))
        texts = self.narrow.join(small_side(wanted, wanted.count()), same)
        return texts.groupBy("wanted").agg(F.any_value("text").alias("text"))

    def _in_blocks(self, lists: DataFrame) -> DataFrame:
        """Links across components within the lists, each cut into blocks of which any two meet in one task."""
        sizes = lists.groupBy("value").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("members"))
        n_blocks = F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("members") / BLOCK_MEMBERS)).cast("int")
        rows = lists.join(sizes.select("value", n_blocks.alias("n_blocks")), "value")
        rows = rows.withColumn("block", F.pmod(F.hash("turn.cls"), "n_blocks"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        rows = rows.select(
            "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block",
            F.col("turn.cls").alias("cls"), "label",
        )
        rows = rows.join(self._sets(lists.select("turn.cls")), "cls")
        percent = self.percent
        return rows.groupBy("value", "i", "j").applyInArrow(
            lambda block: _links_and_memory(block, percent), "a binary, b binary"
        ).distinct()

    def groups(self) -> DataFrame:
        """(cls, component_id, keeper) of every class that is linked or has several rows."""
        linked = components(self.links)
        placed = self.classes.join(linked, F.col("cls") == F.col("node"), "left")
        placed = placed.filter("label is not null or n_rows > 1")
        placed = placed.select("cls", "rep", F.coalesce("label", "cls").alias("label"))
        best = F.min(F.struct(F.col("rep").isNull().alias("no_id"), F.col("rep"), F.col("cls"))).alias("best")
        best = placed.groupBy("label").agg(best)
        placed = placed.join(best, "label")
        return written(placed.select("cls", F.col("best.rep").alias("component_id"), F.col("best.cls").alias("keeper")), "groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable by links), kept."""
    found = NearDuplicates(docs, doc_id, **options)
    groups = found.groups().select(F.col("cls").alias("group_cls"), "component_id")
    rows = found.rows.join(groups, F.col("cls") == F.col("group_cls"), "left")
    component = F.when(F.col("group_cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without those that have a near duplicate of smaller id in their component: one of each stays."""
    found = NearDuplicates(docs, doc_id, text, **options)
    groups = found.groups()
    names = {c: fresh_name(docs.columns, c) for c in ("cls", "group_cls", "keeper", "component_id")}
    group = groups.select(
        F.col("cls").alias(names["group_cls"]), F.col("component_id").alias(names["component_id"]),
        F.col("keeper").alias(names["keeper"]),
    )
    keyed = partial(_keyed, text=text, key=names["cls"], length=found.length)
    rows = docs.mapInArrow(keyed, T.StructType([*docs.schema.fields, T.StructField(names["cls"], T.BinaryType())]))
    rows = rows.join(small_side(group, group.count()), F.col(names["cls"]) == F.col(names["group_cls"]), "left")
    alone = rows.filter(F.col(names["group_cls"]).isNull()).select(docs.columns)
    keepers = rows.filter(
        (F.col(names["cls"]) == F.col(names["keeper"])) & F.col(doc_id).eqNullSafe(F.col(names["component_id"]))
    )
    # the same id may come with the same set more than once
    return alone.union(keepers.dropDuplicates([names["cls"]]).select(docs.columns))
