"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word enters as two learned vectors: one of the word itself and one of its characters, the element-wise maximum over
the vectors of its character groups. Two gated recurrent layers read a window of words, one forwards and one
backwards; attention pools their states, and a logistic unit scores the window. Every text is covered by windows of
WINDOW words, each half over the next one, and its score is that of its worst window.

Training takes a bounded sample of labelled rows (`max_toxic`, `max_clean`, by a hash of the id), in one task. The
vectors start from the log-odds of their words and character groups; toxic texts are trained on the window that scores
worst so far, clean ones on their worst and on any. The threshold that separates a part held out of the sample best is
moved to `THRESHOLD`.

Defined results: a null or empty text, or one without letters and digits, scores 0; rows with equal texts score
equally; without toxic and clean training rows everything scores 0; empty tables give empty results; extra columns
are kept by `clean_documents`. Labels, ids, languages and sources are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evertally.llm import words as w
from evertally.llm.tables import fresh_name, in_training_part

WINDOW, STRIDE = 32, 16
BUCKET_BITS = 17
GROUP_BYTES = (5, 8)
VECTOR, STATE, ATTENTION = 4, 8, 8
THRESHOLD = 0.3
MAX_TOXIC, MAX_CLEAN = 2000, 4000
LANES = 8192
#: Toxic texts that the part held out for the threshold must have.
ENOUGH_TOXIC = 20
#: Texts that every word and character group is thought to have been seen in already, in the usual proportion.
PRIOR_TEXTS = 4.0
#: Learning rate of the word and character vectors.
VECTOR_RATE = 0.02

Gradients = dict[str, np.ndarray]


@dataclass
class Vocabulary:
    """Distinct words of a slice: the bucket of each word and of each of its character groups."""

    inverse: np.ndarray
    word: np.ndarray
    group: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, part: w.Words) -> Vocabulary:
        hashes, at, inverse = np.unique(part.hashes, return_index=True, return_inverse=True)
        starts, ends = part.starts[at], part.ends[at]
        data = np.concatenate((w.ASCII_LOWER[part.data], np.zeros(max(GROUP_BYTES), dtype=np.uint8)))
        shift = w.U64(64 - BUCKET_BITS)
        owners, codes = [], []
        for length in GROUP_BYTES:
            counts = np.maximum(1, ends - starts + 2 - length)  # with a mark in front of the word
            owner = np.repeat(np.arange(len(at)), counts)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) - 1
            first, last = starts[owner], ends[owner]
            code = np.full(len(owner), length, dtype=w.U64)
            for k in range(length):
                position = first + offset + k
                byte = np.where(position < last, data[np.maximum(position, 0)], 0)
                byte = np.where(position < first, 0x5E, byte).astype(w.U64)
                code = (code << w.U64(8)) + byte
            owners.append(owner)
            codes.append(w.mixed(code) >> shift)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        group = np.concatenate(codes)[order]
        begin = np.searchsorted(owner[order], np.arange(len(at)))
        return cls(*(x.astype(np.int32) for x in (inverse, hashes >> shift, group, begin)))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start within the row, length) of all windows; rows without words have none."""
    n_windows = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n_windows)
    start = (np.arange(n_windows.sum()) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)) * STRIDE
    return row, start, np.minimum(counts[row] - start, WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters by name; sequences are time-major, and positions past a window's length change nothing."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        p = {"words": normal(1 << BUCKET_BITS, VECTOR, scale=0.01), "groups": normal(1 << BUCKET_BITS, VECTOR, scale=0.01)}
        for side in ("f", "b"):
            p[f"x{side}"] = normal(2 * VECTOR, 3 * STATE, scale=0.4)
            p[f"u{side}"] = normal(STATE, 3 * STATE, scale=0.3)
            p[f"c{side}"] = np.zeros(3 * STATE, dtype=np.float32)
        p |= {"a": normal(2 * STATE, ATTENTION, scale=0.4), "v": normal(ATTENTION, scale=0.4)}
        p |= {"o": normal(2 * STATE, scale=0.4), "d": np.zeros(1, dtype=np.float32)}
        return cls(p)

    def word_vectors(self, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        groups = self.p["groups"][words.group]
        of_characters = np.maximum.reduceat(groups, words.begin, axis=0)
        return np.concatenate((self.p["words"][words.word], of_characters), axis=1), groups

    def _read(self, side: str, projected: np.ndarray, index: np.ndarray, mask: np.ndarray, trace: list | None):
        """States after each position, in the order of the window; index points at rows of projected words."""
        steps, lanes = index.shape
        u = self.p[f"u{side}"]
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * STATE]), np.ascontiguousarray(u[:, 2 * STATE :])
        states = np.empty((steps, lanes, STATE), dtype=np.float32)
        h = np.zeros((lanes, STATE), dtype=np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x = projected[index[t]]
            gates = sigmoid(x[:, : 2 * STATE] + h @ u_gates)
            keep, reset = gates[:, :STATE], gates[:, STATE:]
            new = np.tanh(x[:, 2 * STATE :] + (reset * h) @ u_new)
            before = h
            h = new + keep * (h - new)
            if not mask[t].all():
                h = np.where(mask[t][:, None], h, before)
            states[t] = h
            if trace is not None:
                trace.append((t, before, keep, reset, new))
        return states

    def logits(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        p, both = self.p, []
        for side in ("f", "b"):
            steps = None if trace is None else trace.setdefault(side, [])
            both.append(self._read(side, vectors @ p[f"x{side}"] + p[f"c{side}"], index, mask, steps))
        states = np.concatenate(both, axis=2)
        hidden = np.tanh(states @ p["a"])
        weight = np.where(mask, hidden @ p["v"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        if trace is not None:
            trace |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ p["o"] + p["d"]

    def gradients(self, vectors: np.ndarray, index: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[Gradients, np.ndarray]:
        """Gradients of the mean logistic loss: of the parameters, and of the word vectors."""
        p, trace = self.p, {}
        error = ((sigmoid(self.logits(vectors, index, mask, trace)) - target) / len(target)).astype(np.float32)
        states, hidden, weight, pooled = (trace[k] for k in ("states", "hidden", "weight", "pooled"))
        g: Gradients = {"o": pooled.T @ error, "d": error.sum(keepdims=True)}
        d_pooled = error[:, None] * p["o"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["v"] = np.einsum("tba,tb->a", hidden, d_score)
        d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden**2)
        g["a"] = np.einsum("tbh,tba->ha", states, d_hidden)
        d_states += d_hidden @ p["a"].T
        d_vectors = np.zeros_like(vectors)
        for number, side in enumerate(("f", "b")):
            own = d_states[:, :, number * STATE : (number + 1) * STATE]
            d_vectors += self._back(side, trace[side], own, vectors, index, mask, g)
        return g, d_vectors

    def _back(self, side: str, steps: list, d_states, vectors, index, mask, g: Gradients) -> np.ndarray:
        """Gradients of one layer; every row of `vectors` is in `index`."""
        u = self.p[f"u{side}"]
        d_u, d_h = np.zeros_like(u), np.zeros_like(d_states[0])
        d_inputs = np.empty((*index.shape, 3 * STATE), dtype=u.dtype)
        for t, before, keep, reset, new in reversed(steps):
            d_out = d_h + d_states[t]
            live = mask[t][:, None]
            d_new = np.where(live, d_out * (1 - keep) * (1 - new**2), 0)
            d_keep = np.where(live, d_out * (before - new) * keep * (1 - keep), 0)
            through = d_new @ u[:, 2 * STATE :].T
            d_reset = through * before * reset * (1 - reset)
            d_gates = np.concatenate((d_keep, d_reset), axis=1)
            d_u[:, : 2 * STATE] += before.T @ d_gates
            d_u[:, 2 * STATE :] += (reset * before).T @ d_new
            d_h = np.where(live, d_out * keep, d_out) + through * reset + d_gates @ u[:, : 2 * STATE].T
            d_inputs[t, :, : 2 * STATE], d_inputs[t, :, 2 * STATE :] = d_gates, d_new
        order = np.argsort(index, axis=None, kind="stable")
        begin = np.searchsorted(index.ravel()[order], np.arange(len(vectors)))
        d_projected = np.add.reduceat(d_inputs.reshape(-1, 3 * STATE)[order], begin, axis=0)
        g[f"u{side}"], g[f"c{side}"] = d_u, d_projected.sum(axis=0)
        g[f"x{side}"] = vectors.T @ d_projected
        return d_projected @ self.p[f"x{side}"].T


@dataclass
class Slice:
    """Words and windows of some texts."""

    part: w.Words
    words: Vocabulary
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, part: w.Words) -> Slice:
        row, start, length = windows_of(part.counts())
        return cls(part, Vocabulary.of(part), row, start + part.first[row], length)

    def lanes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, mask) of the chosen windows, time-major."""
        steps = np.arange(self.length[chosen].max())[:, None]
        mask = steps < self.length[chosen]
        return self.words.inverse[np.where(mask, self.start[chosen] + steps, self.start[chosen])], mask


def slices(texts: pa.Array) -> Iterator[tuple[int, Slice]]:
    for base, part in w.words_by_slice(texts, w.ALPHANUMERIC, w.ASCII_LOWER):
        yield base, Slice.of(part)


def window_logits(network: Network, part: Slice) -> np.ndarray:
    vectors, _ = network.word_vectors(part.words)
    found = np.empty(len(part.row), dtype=np.float32)
    by_length = np.argsort(part.length, kind="stable")
    for at in range(0, len(by_length), LANES):
        chosen = by_length[at : at + LANES]
        found[chosen] = network.logits(vectors, *part.lanes(chosen))
    return found


def starting_scores(network: Network, part: Slice) -> np.ndarray:
    """The sum over the two worst words of each window, by what their vectors start from."""
    vectors, _ = network.word_vectors(part.words)
    odds = vectors[:, 0] + vectors[:, VECTOR]
    index, mask = part.lanes(np.arange(len(part.row)))
    return np.sort(np.where(mask, odds[index], -9), axis=0)[-2:].sum(axis=0)


def worst_windows(network: Network, part: Slice) -> np.ndarray:
    """The largest logit per row; minus infinity without words."""
    worst = np.full(part.part.rows, -np.inf)
    if len(part.row):
        np.maximum.at(worst, part.row, window_logits(network, part))
    return worst


def texts_with(rows: np.ndarray, buckets: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each bucket, how many clean and how many toxic rows hold it."""
    pairs = np.unique(rows * (1 << BUCKET_BITS) + buckets)
    kind = toxic[pairs >> BUCKET_BITS] * (1 << BUCKET_BITS)
    found = np.bincount(kind + (pairs & ((1 << BUCKET_BITS) - 1)), minlength=2 << BUCKET_BITS)
    return found.reshape(2, -1)


def log_odds(held: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Per bucket, the log-odds that a text with it is toxic, over those of any text; 0 for unseen ones."""
    prior = PRIOR_TEXTS * n_toxic / (n_toxic + n_clean)
    return np.log((held[1] + prior) / n_toxic) - np.log((held[0] + PRIOR_TEXTS - prior) / n_clean)


@dataclass
class Trainer:
    texts: pa.Array
    toxic: np.ndarray
    seed: int = 7
    rounds: int = 3
    steps: int = 120
    batch: int = 256
    rate: float = 0.02

    def train(self) -> Network:
        rng = np.random.default_rng(self.seed)
        network = Network.fresh(self.seed)
        validation = rng.random(len(self.texts)) < 0.2
        train = []
        for base, part in slices(self.texts):
            none = np.empty(0, dtype=w.U64)  # the texts are not needed any more
            train.append((base, replace(part, part=w.Words(none, part.part.first, none, none, none))))
        self._start(network, train, validation)
        moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        clock = 0
        for turn in range(self.rounds):
            chosen = self._choose(window_logits if turn else starting_scores, network, train, validation, rng)
            for _ in range(self.steps):
                clock += 1
                self._step(network, *chosen[rng.integers(len(chosen))], rng, moments, clock)
        self._calibrate(network, train, validation)
        return network

    def _start(self, network: Network, train: list, validation: np.ndarray) -> None:
        """First components: the log-odds of words and character groups."""
        held = {name: np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64) for name in ("words", "groups")}
        for base, part in train:
            words = part.words
            row_of = np.repeat(np.arange(part.part.rows), part.part.counts())
            own = np.flatnonzero(~validation[base + row_of])
            toxic = self.toxic[base : base + part.part.rows].astype(np.int64)
            held["words"] += texts_with(row_of[own], words.word[words.inverse[own]], toxic)
            # the groups of each distinct word of a row
            sizes = np.diff(np.append(words.begin, len(words.group)))
            row, word = np.divmod(np.unique(row_of[own] * max(len(sizes), 1) + words.inverse[own]), max(len(sizes), 1))
            count = sizes[word]
            at = np.repeat(words.begin[word] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            held["groups"] += texts_with(np.repeat(row, count), words.group[at], toxic)
        for name, found in held.items():
            odds = log_odds(found, int((~self.toxic).sum()), int(self.toxic.sum()))
            network.p[name][:, 0] = np.clip(odds / 3, -1, 2)

    def _choose(self, scores, network: Network, train: list, validation: np.ndarray, rng) -> list:
        """(slice, windows, targets): the worst window of every text, and any other of each clean one."""
        chosen = []
        for base, part in train:
            if not len(part.row):
                continue
            score = scores(network, part)
            order = np.lexsort((score, part.row))
            last = np.flatnonzero(np.append(part.row[order][1:] != part.row[order][:-1], True))
            worst = order[last]
            any_one = rng.permutation(len(part.row))[: len(worst)]
            any_one = any_one[~self.toxic[base + part.row[any_one]]]
            windows = np.concatenate((worst, any_one))
            windows = windows[~validation[base + part.row[windows]]]
            if len(windows):
                chosen.append((part, windows, self.toxic[base + part.row[windows]]))
        return chosen

    def _step(self, network: Network, part: Slice, windows, targets, rng, moments, clock: int) -> None:
        # as many toxic as clean windows where there are any
        pools = [x for x in (np.flatnonzero(targets), np.flatnonzero(~targets)) if len(x)]
        picked = np.concatenate([rng.choice(x, min(len(x), self.batch // 2), replace=False) for x in pools])
        index, mask = part.lanes(windows[picked])
        used, index = np.unique(index, return_inverse=True)
        index = index.reshape(mask.shape)
        words = _subset(part.words, used)
        vectors, groups = network.word_vectors(words)
        g, d_vectors = network.gradients(vectors, index, mask, targets[picked].astype(np.float32))
        for name, gradient in g.items():
            mean, square = moments.setdefault(name, (np.zeros_like(gradient), np.zeros_like(gradient)))
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            network.p[name] -= self.rate * (mean / (1 - 0.9**clock)) / (np.sqrt(square / (1 - 0.99**clock)) + 1e-8)
        np.subtract.at(network.p["words"], words.word, VECTOR_RATE * d_vectors[:, :VECTOR])
        sizes = np.diff(np.append(words.begin, len(words.group)))
        largest = groups == np.repeat(vectors[:, VECTOR:], sizes, axis=0)
        np.subtract.at(network.p["groups"], words.group, VECTOR_RATE * largest * np.repeat(d_vectors[:, VECTOR:], sizes, axis=0))

    def _calibrate(self, network: Network, train: list, validation: np.ndarray) -> None:
        scores = np.concatenate([worst_windows(network, part) for _, part in train])
        # too few toxic texts apart from the training ones tell little: then all of them count
        part = validation if self.toxic[validation].sum() >= ENOUGH_TOXIC else np.ones_like(validation)
        order = np.argsort(-scores[part], kind="stable")
        ranked, hit = scores[part][order], np.cumsum(self.toxic[part][order])
        taken = np.arange(1, len(order) + 1)
        f1 = 2 * hit / (taken + self.toxic[part].sum())
        f1[np.append(ranked[1:] == ranked[:-1], False)] = -1  # no cut between equal scores
        cut = int(np.argmax(f1))
        below = ranked[cut + 1] if cut + 1 < len(ranked) else ranked[cut] - 2
        middle = (ranked[cut] + max(below, ranked[cut] - 4)) / 2
        network.p["d"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - middle)


def _subset(words: Vocabulary, used: np.ndarray) -> Vocabulary:
    sizes = np.diff(np.append(words.begin, len(words.group)))[used]
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(words.begin[used] - begin, sizes) + np.arange(sizes.sum())
    return Vocabulary(np.empty(0, dtype=np.int64), words.word[used], words.group[at], begin)


def trained(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN,
) -> Network | None:
    """A network from at most so many toxic and clean training rows; None if either is missing."""
    marked = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    marked = marked.filter("toxic in (0, 1) and doc_id is not null").filter(in_training_part()).distinct()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = [marked.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    ids = F.broadcast(picked[0].union(picked[1]))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null").join(ids, "doc_id")
    rows = rows.select("doc_id", "toxic", "text").distinct()
    # repeated ids may bring more texts than ids; the bounded sample is one task's input
    rows = rows.orderBy(F.xxhash64("text"), "doc_id", "toxic").limit(max_toxic + max_clean)
    found = rows.select("text", "toxic").mapInArrow(_train, "name string, shape array<int>, data binary").collect()
    if not found:
        return None
    return Network({r["name"]: np.frombuffer(r["data"], dtype=np.float32).reshape(r["shape"]) for r in found})


@w.lean
def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parameters of a network, a row each; none if a class is missing."""
    sample = pa.Table.from_batches(batches, schema=pa.schema([("text", pa.string()), ("toxic", pa.int32())]))
    toxic = sample.column("toxic").to_numpy() == 1
    if not toxic.any() or toxic.all():
        return
    found = Trainer(sample.column("text").combine_chunks(), toxic).train().p
    yield pa.RecordBatch.from_pydict(
        {
            "name": list(found),
            "shape": pa.array([v.shape for v in found.values()], type=pa.list_(pa.int32())),
            "data": pa.array([v.astype(np.float32).tobytes() for v in found.values()], type=pa.binary()),
        }
    )


def _scorer(network, keep: list[str], text: str, score: str):
    @w.lean
    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [worst_windows(network.value, part) for _, part in slices(batch.column(text))] if network.value else []
            logits = np.concatenate(found).astype(np.float64) if found else np.full(batch.num_rows, -np.inf)
            scores = np.where(np.isfinite(logits), sigmoid(logits), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], names=[*keep, score])

    return score_batches


def scored(docs: DataFrame, network: Network | None, keep: list[str], text: str = "text") -> tuple[DataFrame, str]:
    """The kept columns with the score under a fresh name, and that name."""
    score = fresh_name(docs.columns, "score")
    rows = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score, T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(network)
    return rows.mapInArrow(_scorer(model, keep, text, score), schema), score


def clean_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold."""
    rows, score = scored(docs, trained(docs, labels, doc_id, text), docs.columns, text)
    return rows.filter(F.col(score) < threshold).select(docs.columns)
