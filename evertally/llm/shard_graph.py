"""NN-descent and greedy search over the vectors of one shard, in numpy; nodes are places in the shard.

A sorted list entry is one number: the node, its distance to the other node in an order that unsigned integers keep, and
the other node, of 16, 32 and 16 bits. A shard has at most 65,536 nodes for that.
"""

from __future__ import annotations

import numpy as np

MOST_NODES = 1 << 16
#: One in so many nodes at least is an entry, with which each query is compared first.
ENTRY_SHARE = 16
#: Nodes of a beam that are expanded at a time, and queries that are searched at a time.
WIDTH, QUERIES = 8, 256
#: Products that are held at a time.
PIECE = 1 << 21


def scaled(vectors: np.ndarray, each: bool = False) -> np.ndarray:
    """As floats of a size whose products are finite; a common factor, or one of each query, changes no order."""
    most = np.max(np.abs(vectors), axis=1 if each else None, keepdims=True, initial=0.0)
    return np.ldexp(vectors, -np.frexp(most)[1]).astype(np.float32)


def exact_distances(vectors: np.ndarray, queries: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each query and its places, infinite where these are -1."""
    out = np.empty(places.shape)
    for row, own in enumerate(places):
        out[row] = -np.einsum("nd,d->n", vectors[own].astype(np.float64), queries[row].astype(np.float64))
    out[places < 0] = np.inf
    return out


def coarse(distance: np.ndarray) -> np.ndarray:
    """Without the last bits, in which the same pair can differ between products."""
    return (distance.astype(np.float32, copy=False).view(np.int32) & np.int32(-128)).view(np.float32)


def _ordered(distance: np.ndarray) -> np.ndarray:
    bits = (distance + np.float32(0)).view(np.uint32)
    return (bits ^ ((bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31))).astype(np.uint64)


def _distance(ordered: np.ndarray) -> np.ndarray:
    bits = ordered.astype(np.uint32)
    return np.where(bits >> 31, bits ^ np.uint32(1 << 31), ~bits).view(np.float32)


def _keys(node: np.ndarray, distance: np.ndarray, other: np.ndarray) -> np.ndarray:
    return node.astype(np.uint64) << np.uint64(48) | _ordered(distance) << np.uint64(16) | other.astype(np.uint64)


def _parts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (keys >> np.uint64(48)).astype(np.int64), _distance(keys >> np.uint64(16)), (keys & np.uint64(0xFFFF)).astype(np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each member within its group; groups are in order."""
    first = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(first, np.diff(first, append=len(groups)))


def _draw(node: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A number of 31 bits that stands for a pair in a fixed random order."""
    mixed = (node.astype(np.uint64) << np.uint64(16) | other.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(33)).astype(np.int64)


def _best(keys: np.ndarray, degree: int) -> np.ndarray:
    """Of each node, the keys of its best distinct others, in order."""
    keys = _distinct(keys)
    node = (keys >> np.uint64(48)).astype(np.int64)
    keys = keys[_places(node) < degree + 4]
    # a pair that two products put apart, however near, is held once
    pair = keys & np.uint64(0xFFFF << 48 | 0xFFFF)
    order = np.argsort(pair, kind="stable")
    twice = order[1:][pair[order][1:] == pair[order][:-1]]
    keys = np.delete(keys, twice)
    return keys[_places((keys >> np.uint64(48)).astype(np.int64)) < degree]


def worst(keys: np.ndarray, size: int, degree: int) -> np.ndarray:
    """The largest distance in the list of each node, infinite where the list is not full."""
    node, distance, _ = _parts(keys)
    count = np.bincount(node, minlength=size)
    out, full = np.full(size, np.inf, dtype=np.float32), count >= degree
    out[full] = distance[np.cumsum(count) - 1][full] if len(keys) else 0
    return out


def first_lists(vectors: np.ndarray, degree: int, tables: int, block: int) -> np.ndarray:
    """Keys of the best neighbours that nodes meet in blocks of equal codes of random hyperplanes, at several lengths."""
    size = len(vectors)
    bits = max(0, int(np.ceil(np.log2(max(size, 1) / (block / 2)))))
    keys = np.empty(0, np.uint64)
    for number in range(tables):
        planes = np.random.default_rng(number).standard_normal((vectors.shape[1], 32)).astype(np.float32)
        own = max(0, bits - number % 3)
        codes = (vectors @ planes[:, :own] > 0) @ (1 << np.arange(own, dtype=np.int64))
        order = np.lexsort((_draw(np.arange(size), np.full(size, number)), codes))
        begin = np.flatnonzero(np.diff(codes[order], prepend=-1))
        found, limit = [keys], worst(keys, size, degree)
        for group in np.split(order, begin[1:]):
            for nodes in np.array_split(group, -(-len(group) // block)):
                distance = coarse(-(vectors[nodes] @ vectors[nodes].T))
                np.fill_diagonal(distance, np.inf)
                count = min(degree, len(nodes) - 1)
                node, other = np.nonzero(distance < limit[nodes][:, None])
                if len(node) > count * len(nodes):
                    near = np.argpartition(distance, count - 1, axis=1)[:, :count]
                    node, other = np.repeat(np.arange(len(nodes)), count), near.ravel()
                found.append(_keys(nodes[node], distance[node, other], nodes[other]))
        keys = _best(np.concatenate(found), degree)
    return keys


def descended(vectors: np.ndarray, keys: np.ndarray, met: np.ndarray, degree: int, meeting: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The lists after one more round, which of their entries have met, and how many are new.

    Every node brings together a sample of its neighbours and of the nodes that have it as neighbour, those that have not
    met yet first; each pair that improves one's list is proposed.
    """
    size, length = vectors.shape
    node, distance, other = _parts(keys)
    draw = _draw(node, other)
    order = np.lexsort((draw, met, node))
    near = order[_places(node[order]) < meeting]
    back = near[np.lexsort((draw[near], met[near], other[near]))]
    back = back[_places(other[back]) < meeting]

    host = np.concatenate([node[near], other[back]])
    guest = np.concatenate([other[near], node[back]])
    fresh = ~np.concatenate([met[near], met[back]])
    order = np.argsort(host, kind="stable")
    host, guest, fresh = host[order], guest[order], fresh[order]
    guests, unmet = np.full((size, 2 * meeting), -1), np.zeros((size, 2 * meeting), dtype=bool)
    guests[host, _places(host)], unmet[host, _places(host)] = guest, fresh
    active = np.flatnonzero(unmet.any(axis=1))

    found, most = [keys], worst(keys, size, degree)
    for part in np.array_split(active, max(1, len(active) * 2 * meeting * max(length, 2 * meeting) // PIECE)):
        there, new = guests[part], unmet[part]
        own = vectors[there]
        apart = coarse(-(own @ own.transpose(0, 2, 1)))
        limit = np.where(there >= 0, most[there], np.float32(-np.inf))
        better = (apart < limit[:, :, None]) & (new[:, :, None] | new[:, None, :])
        better &= (there >= 0)[:, None, :] & (there[:, :, None] != there[:, None, :])
        group, a, b = np.nonzero(better)
        found.append(_distinct(_keys(there[group, a], apart[group, a, b], there[group, b])))
    after = _best(np.concatenate(found), degree)

    met = met.copy()
    met[near] = True
    at = np.minimum(np.searchsorted(keys, after), max(len(keys) - 1, 0))
    kept = keys[at] == after if len(keys) else np.zeros(len(after), dtype=bool)
    return after, kept & met[at] if len(keys) else kept, int(np.count_nonzero(~kept))


def neighbour_lists(vectors: np.ndarray, degree: int, meeting: int, changed: float, tables: int, block: int) -> np.ndarray:
    """Of each node, its neighbours nearest first, filled up with -1; rounds end when at most that share of the entries is new."""
    if len(vectors) > MOST_NODES:
        raise ValueError(f"a shard of {len(vectors)} nodes, more than {MOST_NODES}")
    size, vectors = len(vectors), scaled(vectors)
    keys = first_lists(vectors, degree, tables, block)
    met, new = np.zeros(len(keys), dtype=bool), size * degree
    while new > changed * size * min(degree, size - 1):
        keys, met, new = descended(vectors, keys, met, degree, meeting)
    node, _, other = _parts(keys)
    lists = np.full((size, degree), -1, dtype=np.int32)
    lists[node, _places(node)] = other
    return lists


def linked(lists: np.ndarray, most: int) -> np.ndarray:
    """Lists with up to that many of the nodes that have a node in theirs but not the other way, of which it is the nearest first.

    Without them, what is near to few others could not be reached from these.
    """
    size, degree = lists.shape
    node, rank = np.nonzero(lists >= 0)
    other = lists[node, rank].astype(np.int64)
    to, back = node * size + other, other * size + node
    single = ~np.isin(back, to)
    node, rank, other = node[single], rank[single], other[single]
    order = np.lexsort((node, rank, other))
    place = _places(other[order])
    order, place = order[place < most], place[place < most]
    more = np.full((size, most), -1, dtype=lists.dtype)
    more[other[order], place] = node[order]
    return np.hstack([lists, more])


def entries(lists: np.ndarray) -> np.ndarray:
    """A share of the nodes, and so many more that each node is one or has one among its neighbours."""
    size = len(lists)
    draw = _draw(np.arange(size), np.zeros(size, dtype=np.int64))
    chosen = draw % ENTRY_SHARE == 0
    neighbours = np.where(lists >= 0, lists, np.arange(size)[:, None])
    while True:
        without = ~(chosen | chosen[neighbours].any(axis=1))
        if not without.any():
            return np.flatnonzero(chosen)
        waiting = np.where(without, draw * size + np.arange(size), np.iinfo(np.int64).max)
        chosen |= without & (waiting <= waiting[neighbours].min(axis=1))


def greedy(vectors: np.ndarray, lists: np.ndarray, entries: np.ndarray, queries: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, met): the best nodes for each of some queries, filled up with -1, and which were scored; vectors are `scaled`.

    A query is compared with the entries, and starts from the best of them and, where it is a node itself (`own`, or -1),
    from its neighbours. It expands the best nodes not yet expanded and keeps the best, until all of these are expanded.
    """
    size, asking, beam = len(vectors), len(queries), min(beam, len(vectors))
    bits = max(size - 1, 1).bit_length()
    rows = np.arange(asking)
    met = np.full((asking, 1 << bits), -1, dtype=np.int32)
    met[rows[own >= 0], own[own >= 0]] = 0
    flat = met.reshape(-1)
    empty = ~np.uint64(0)
    kept = np.full((asking, beam), empty)  # distance, place, and whether it is expanded
    last = np.full(asking, np.inf, dtype=np.float32)

    def enter(row: np.ndarray, place: np.ndarray, distance: np.ndarray) -> None:
        below = distance < last[row]
        row, place, distance = row[below], place[below], distance[below]
        if not len(row):
            return
        rank = _places(row)
        touched, to = row[rank == 0], np.cumsum(rank == 0) - 1
        more = np.full((len(touched), int(rank.max()) + 1), empty)
        more[to, rank] = _ordered(distance) << np.uint64(17) | place.astype(np.uint64) << np.uint64(1)
        merged = np.sort(np.hstack([kept[touched], more]), axis=1)[:, :beam]
        kept[touched] = merged
        full = merged[:, -1] != empty
        last[touched[full]] = _distance(merged[full, -1] >> np.uint64(17))

    def ask(row: np.ndarray, place: np.ndarray) -> None:
        """Scores the nodes in the lists of some that their queries have not met."""
        others = lists[place]
        cell = ((row << bits)[:, None] + others)[others >= 0]
        cell = cell[flat.take(cell) < 0]
        number = np.arange(len(cell), dtype=np.int32)
        flat[cell] = number
        cell = cell[flat.take(cell) == number]  # once each
        row, place = cell >> bits, cell & ((1 << bits) - 1)
        distance = np.empty(len(cell), dtype=np.float32)
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        for asker, first, end in zip(row[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(row)]):
            np.dot(vectors.take(place[first:end], axis=0), queries[asker], out=distance[first:end])
        np.negative(distance, out=distance)
        enter(row, place, distance)

    distance = -(queries @ vectors[entries].T)
    distance[met[:, entries] >= 0] = np.inf
    met[:, entries] = 0
    best = np.argpartition(distance, min(beam, len(entries)) - 1, axis=1)[:, :beam]
    enter(np.repeat(rows, best.shape[1]), entries[best].ravel(), np.take_along_axis(distance, best, axis=1).ravel())
    ask(rows[own >= 0], own[own >= 0])
    while True:
        ahead = kept & np.uint64(1) == 0  # the empty ones count as expanded
        ahead &= np.cumsum(ahead, axis=1) <= WIDTH
        row, slot = np.nonzero(ahead)
        if not len(row):
            break
        place = (kept[row, slot] >> np.uint64(1) & np.uint64(0xFFFF)).astype(np.int64)
        kept[row, slot] |= np.uint64(1)
        ask(row, place)
    places = np.where(kept == empty, -1, (kept >> np.uint64(1) & np.uint64(0xFFFF)).astype(np.int64))
    return places, met[:, :size] >= 0
