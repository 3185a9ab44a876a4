"""N-gram Jaccard join with signature trees.

1. Every text becomes its set of word shingles (64-bit hashes). Documents with equal sets are one class from here on.
2. No link may be lost, and no pairs are listed. Where a link of similarity t needs sizes a >= b, the sets differ in at most
   (a + b)(1 - t)/(1 + t) shingles. A set is cut by hash into more parts than that, so two linked sets have an equal part.
   Sizes fall into intervals of ratio t (a link spans at most two); a set is keyed for its own interval and for the next.
   Of the sets with an equal part, those whose sketches are near are tied: a sketch has a code for the smallest hash in each
   of 128 bins, and of two linked sets more than half of the codes would have to differ by chance (9 standard deviations; for
   small sets it can't be). Sketches differ by a metric, so a set may stand for others near it (its followers) if it says how far
   they are (its reach): whatever may be linked to a follower is within that reach more of the leader. Each task thus drops a part's
   followers before the shuffle (a frequent part leaves a few leaders a task), and groups by part again keep leaders alone.
   So whatever links there are lie within a tied component; only components with several classes go on: all others have no link.
3. Within a candidate component, classes are cut by size into chunks of bounded size. One task builds the tree of a chunk: nodes hold
   the OR of their sets' bitmaps and their size range, both sides are descended at once, and pairs of nodes whose largest possible overlap
   is too small are dropped, down to pairs of classes that are compared exactly. Pairs already connected are passed over.
   Where a component has several chunks, one class of each connected group of each chunk is compared in the same way, so that what
   belongs together mostly is; then chunks whose groups differ are compared with each other, if their chunk nodes (a wider bitmap
   and the size range) leave an overlap possible.
4. The links found are contracted to components; every document gets the smallest doc_id that it reaches.

Null and empty texts, and texts without words, have empty sets: linked with nothing, each its own component. Repeated rows
give a row each; several texts of one doc_id are compared each for itself. A null doc_id is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed, mix64, rows_in_chunks, slice_hashes, spaced_words, table
from evidra.llm.components import components

#: Shingles in a chunk of a candidate component; classes in a leaf, children of a node, bits of a bitmap, and of a chunk's.
CHUNK_SHINGLES, LEAF, FAN, BITS, CHUNK_BITS = 1_500_000, 16, 8, 1024, 1 << 16
#: Bins of a sketch; sizes of groups that are compared in one step; shares of a sketch's codes that differ: in linked sets at most, and
#: in a leader's followers at most; part keys that a task looks through at once for followers, and how often.
BINS, ALL_PAIRS = 128, 64
FAR, FOLLOWS, DEVIATIONS = 0.5, 0.12, 8.0
COMBINED, TURNS = 1_500_000, 3
_WORD = np.arange(1, 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], n_words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text's words are one shingle."""
    data, starts, ends, first, last = spaced_words(texts)
    words = slice_hashes(data, starts, ends)
    if not len(words):
        return [words] * len(texts)
    with np.errstate(over="ignore"):
        salted = [mix64(words + _WORD[k]) for k in range(n_words)]
        grams = np.zeros(max(0, len(words) - n_words + 1), np.uint64)
        for k in range(n_words):
            grams += salted[k][k : k + len(grams)] * np.uint64(2 * k + 3)
        grams = mix64(grams)
        out = []
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= n_words:
                out.append(np.unique(grams[a : b - n_words + 1]))
            elif b > a:
                short = sum((salted[k][a + k : a + k + 1] * np.uint64(2 * k + 3) for k in range(b - a)), np.uint64(b - a))
                out.append(mix64(np.atleast_1d(short)))
            else:
                out.append(words[:0])
    return out


@lru_cache(100_000)
def size_interval(n: int, percent: int) -> int:
    """Number of the interval of sizes that n is in; each interval's last size is its first one's / t, rounded down."""
    k, low = 0, 1
    while (high := low * 100 // percent) < n:
        k, low = k + 1, high + 1
    return k


@lru_cache(10_000)
def interval_end(k: int, percent: int) -> int:
    low = 1
    for _ in range(k):
        low = low * 100 // percent + 1
    return low * 100 // percent


def part_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the parts of one set, for its own size interval and the next one."""
    k = size_interval(len(grams), percent)
    keys = []
    for at in (k, k + 1):
        differing = 2 * interval_end(at, percent) * (100 - percent) // (100 + percent)
        parts = differing + differing // 8 + 2
        with np.errstate(over="ignore"):
            own = (mix64(grams ^ np.uint64(0xA5A5A5A5)) % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, own, mix64(grams + np.uint64(at + 1)))
            named = mix64(sums + mix64(np.arange(parts, dtype=np.uint64) + np.uint64(at << 32)))
        # Empty parts need no key where the others outnumber the differing ones: then an equal part isn't empty.
        full = np.bincount(own, minlength=parts) > 0
        keys.append(named[full] if full.sum() > differing else named)
    return np.concatenate(keys).view(np.int64)


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """Equal for equal sets: two independent sums of 64 bits, the size mixed in. The first one names the set in ties."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(grams)) * _WORD[0]
        both = np.array([mix64(grams).sum(dtype=np.uint64) + n, mix64(grams ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) ^ n], np.uint64)
        return tuple(mix64(both).view(np.int64).tolist())


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS codes for each set: 0 for an empty bin, else 1 to 15 from the smallest hash in it."""
    low = np.full(len(sets) * BINS, np.iinfo(np.uint64).max, np.uint64)
    if len(sets):
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        mixed = mix64(np.concatenate(sets) ^ np.uint64(0xC2B2AE3D27D4EB4F))
        np.minimum.at(low, own * BINS + (mixed & np.uint64(BINS - 1)).astype(np.int64), mixed >> np.uint64(8))
    codes = (mix64(low) % np.uint64(15)).astype(np.uint8) + 1
    codes[low == np.iinfo(np.uint64).max] = 0
    return codes.reshape(-1, BINS)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing codes: a metric."""
    return (a != b).sum(-1)


def filled(codes: np.ndarray) -> np.ndarray:
    return (codes > 0).sum(-1)


class Leaders:
    """Sets of one part (rows: node, size, codes, reach), each of which may stand for followers within its reach, and their ties.

    A set follows a leader if it and its own followers are within FOLLOWS of it and linkable by size. Two sets are tied if a set within
    the reach of the one may be linked to one within the reach of the other."""

    def __init__(self, percent: int):
        self.t = percent / 100
        self.n = 0
        self.codes, self.numbers = np.zeros((64, BINS), np.uint8), np.zeros((64, 4))  # numbers: filled, reach, least and largest size
        self.joined: list[int] = []
        self.label: list[int] = []  # smallest node of a connected group, at its root

    def _root(self, i: int) -> int:
        up = self.joined
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, nodes: np.ndarray, sizes: np.ndarray, codes: np.ndarray, reach: np.ndarray) -> list[tuple[int, int]]:
        """Take more rows, by rising size: ties of their nodes and of groups that they connect."""
        ties, t = [], self.t
        for node, size, code, r, full in zip(nodes.tolist(), sizes.tolist(), codes, reach.tolist(), filled(codes).tolist()):
            if self.n == len(self.codes):
                self._make_room(size)
            far = differing(self.codes[: self.n], code)
            own = np.array([full, r, size * t if r else size, size / t if r else size])
            k = near(far, self.numbers[: self.n], own, t).nonzero()[0]
            roots = sorted({self._root(i) for i in k.tolist()}, key=lambda i: self.label[i])
            for other in roots[1:]:
                ties.append((self.label[other], self.label[roots[0]]))
                self.joined[other] = roots[0]
            if roots and node != self.label[roots[0]]:
                ties.append((node, self.label[roots[0]]))
                self.label[roots[0]] = min(self.label[roots[0]], node)
            low, high = np.minimum(self.numbers[k, 2], own[2]), np.maximum(self.numbers[k, 3], own[3])
            follows = np.flatnonzero((far[k] + r <= FOLLOWS * self.numbers[k, 0]) & (high * t * t <= low * (1 + 1e-9)))
            if len(follows):
                f = follows[far[k[follows]].argmin()]
                self.numbers[k[f], 1:] = max(self.numbers[k[f], 1], far[k[f]] + r), low[f], high[f]
                continue
            self.codes[self.n], self.numbers[self.n] = code, own
            self.joined.append(roots[0] if roots else self.n)
            self.label.append(node)
            self.n += 1
        return ties

    def _make_room(self, size: int) -> None:
        """Rows come by rising size: leaders of smaller sets that can't be tied any more go. If many stay, room is doubled."""
        stay = np.flatnonzero(self.numbers[: self.n, 3] >= size * self.t * self.t * (1 - 1e-9))
        label = [self.label[self._root(i)] for i in stay.tolist()]
        first: dict[int, int] = {}
        self.joined, self.label, self.n = [first.setdefault(x, i) for i, x in enumerate(label)], label, len(stay)
        room = len(self.codes) * (2 if 2 * self.n > len(self.codes) else 1) - self.n
        self.codes = np.concatenate((self.codes[stay], np.zeros((room, BINS), np.uint8)))
        self.numbers = np.concatenate((self.numbers[stay], np.zeros((room, 4))))


def far_share(t: float) -> float:
    """Share of a sketch's codes that may differ in sets of similarity ``t`` or more: the expected one and ``DEVIATIONS`` standard deviations of a
    sketch's ``BINS`` draws, so that a link is missed with a chance below 1e-15 whatever the similarity; ``FAR`` at least."""
    return max(FAR, 1 - t + DEVIATIONS * (t * (1 - t) / BINS) ** 0.5)


def near(far: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Which of the sets a (columns: filled codes, reach, least and largest size) may be tied to those of b, ``far`` codes away."""
    reach = a[..., 1] + b[..., 1]
    most = np.maximum(a[..., 0] + a[..., 1], b[..., 0] + b[..., 1])
    return (far <= reach + far_share(t) * most) & (a[..., 2] * t <= b[..., 3] * (1 + 1e-9)) & (b[..., 2] * t <= a[..., 3] * (1 + 1e-9))


def tie_group(nodes: np.ndarray, sizes: np.ndarray, codes: np.ndarray, reach: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Ties of one part's group, which is sorted by size: each set's to the smallest node that it is connected with here, so that groups
    of much the same sets give the same ties."""
    n = len(nodes)
    if n > ALL_PAIRS:
        return Leaders(percent).add(nodes, sizes, codes, reach)
    t = percent / 100
    numbers = np.stack((filled(codes), reach, np.where(reach > 0, sizes * t, sizes), np.where(reach > 0, sizes / t, sizes)), 1)
    tied = near(differing(codes[:, None], codes[None]), numbers[:, None], numbers[None], t)
    label, low = np.arange(n), np.where(tied, np.arange(n), n).min(1)
    while (low != label).any():
        label = low
        low = np.where(tied, label, n).min(1)
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, label, nodes)
    return [(a, b) for a, b in zip(nodes.tolist(), first[label].tolist()) if a != b]


def combine(keys: np.ndarray, own: np.ndarray, sizes: np.ndarray, codes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of part keys (each that of set ``own``), which stay, their reach, and the pairs (follower, leader) that stand for the others.

    In each turn, the first set left of each key is a leader."""
    stays, reach, pairs = np.ones(len(keys), bool), np.zeros(len(keys), np.int16), [np.zeros((0, 2), np.int64)]
    rows = np.argsort(keys, kind="stable")
    full = filled(codes)
    for _ in range(TURNS):
        key = keys[rows]
        head = np.concatenate(([True], key[1:] != key[:-1])) if len(rows) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        several = np.bincount(group)[group] > 1 if len(rows) else head
        rows, head = rows[several], head[several]
        if not len(rows):
            break
        lead = rows[head][np.cumsum(head) - 1]
        pair, which = np.unique(own[rows] * len(sizes) + own[lead], return_inverse=True)
        a, b = pair // len(sizes), pair % len(sizes)
        far = np.concatenate([differing(codes[a[k : k + 65536]], codes[b[k : k + 65536]]) for k in range(0, len(a), 65536)])
        follows = (a != b) & (far <= FOLLOWS * full[b]) & (100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]))
        gone = follows[which] & ~head
        stays[rows[gone]] = False
        np.maximum.at(reach, lead[gone], np.maximum(far[which[gone]], 1).astype(np.int16))  # 0: no followers
        pairs.append(np.stack((a[follows], b[follows]), 1))
        rows = rows[~gone & ~head]
    return stays, reach, np.unique(np.concatenate(pairs), axis=0)


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def least_shared(a: int | np.ndarray, b: int | np.ndarray, percent: int) -> int | np.ndarray:
    """A link of sets of these sizes has so many shared shingles at least."""
    return -(-percent * (a + b) // (100 + percent))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS), bool)
    for i, s in enumerate(sets):
        out[i, (s >> np.uint64(17)).astype(np.int64) % BITS] = True
    return np.packbits(out, axis=1).view(np.uint64)


class Tree:
    """Levels from the leaves up: of each node, the OR of its sets' bitmaps, their fewest bits, smallest and largest size."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        self.levels = []
        bits, low, high = np.bitwise_count(maps).sum(1).astype(np.int64), sizes, sizes
        step = LEAF
        while True:
            at = np.arange(0, len(maps), step)
            maps, bits = np.bitwise_or.reduceat(maps, at, 0), np.minimum.reduceat(bits, at)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((maps, bits, low, high))
            if len(maps) == 1:
                return
            step = FAN


def possible(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], percent: int) -> np.ndarray:
    """Which node pairs may hold a link. Bits that a set has beyond those both nodes have are shingles it can't share."""
    (a_maps, a_bits, a_low, a_high), (b_maps, b_bits, b_low, b_high) = a, b
    both = np.bitwise_count(a_maps & b_maps).sum(1).astype(np.int64)
    most = np.minimum(a_high - np.maximum(0, a_bits - both), b_high - np.maximum(0, b_bits - both))
    near = (100 * a_high >= percent * b_low) & (100 * b_high >= percent * a_low)
    return near & (most >= least_shared(a_low, b_low, percent))


class Joined:
    """Which classes of a task are connected so far."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that can be connected by links between the two sides (within the one, if ``right`` is None);
    positions count through left, then right. Sets with equal ``labels`` are connected already. Descends both trees at once."""
    sides = [left, left if right is None else right]
    sizes = [np.array([len(s) for s in x], np.int64) for x in sides]
    maps = [bitmaps(left), None]
    maps[1] = maps[0] if right is None else bitmaps(right)
    trees = [Tree(m, n) for m, n in zip(maps, sizes)]
    base = 0 if right is None else len(left)
    joined, out = Joined(base + len(sides[1])), []
    if labels is not None:
        joined.up = np.unique(labels, return_index=True, return_inverse=True)
        joined.up = joined.up[1][joined.up[2]]
    top = max(len(t.levels) for t in trees) - 1

    def nodes(t: Tree, level: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(x[at] for x in t.levels[min(level, len(t.levels) - 1)])

    def children(t: Tree, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of this level below those of the one above, and which of them exist."""
        if level + 1 >= len(t.levels):  # this tree is lower: its root waits
            return at[:, None], np.ones((len(at), 1), bool)
        below = at[:, None] * FAN + np.arange(FAN)
        return below, below < len(t.levels[level][1])

    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        if level < top:
            (ki, has_i), (kj, has_j) = children(trees[0], level, i), children(trees[1], level, j)
            keep = has_i[:, :, None] & has_j[:, None, :]
            i, j = np.broadcast_to(ki[:, :, None], keep.shape)[keep], np.broadcast_to(kj[:, None, :], keep.shape)[keep]
            if right is None:
                i, j = i[i <= j], j[i <= j]
        live = np.concatenate([possible(nodes(trees[0], level, i[k : k + 65536]), nodes(trees[1], level, j[k : k + 65536]), percent) for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[live], j[live]
    for a, b in zip(i.tolist(), j.tolist()):
        rows_a = np.arange(a * LEAF, min((a + 1) * LEAF, len(left)))
        rows_b = np.arange(b * LEAF, min((b + 1) * LEAF, len(sides[1])))
        if len({joined.root(x) for x in rows_a} | {joined.root(base + x) for x in rows_b}) == 1:
            continue
        need = least_shared(sizes[0][rows_a][:, None], sizes[1][rows_b][None, :], percent)
        x, y = maps[0][rows_a], maps[1][rows_b]
        extra_a = np.bitwise_count(x[:, None, :] & ~y[None, :, :]).sum(2).astype(np.int64)
        extra_b = np.bitwise_count(~x[:, None, :] & y[None, :, :]).sum(2).astype(np.int64)
        most = np.minimum(sizes[0][rows_a][:, None] - extra_a, sizes[1][rows_b][None, :] - extra_b)
        p, q = np.nonzero(most >= need)
        for u, v in zip(rows_a[p].tolist(), rows_b[q].tolist()):
            if right is None and u >= v:
                continue
            ru, rv = joined.root(u), joined.root(base + v)
            if ru == rv:
                continue
            shared = len(np.intersect1d(left[u], sides[1][v], assume_unique=True))
            if linked(shared, len(left[u]), len(sides[1][v]), percent):
                joined.up[max(ru, rv)] = min(ru, rv)
                out.append((u, base + v))
    return out


def _digested(n_words: int, kept: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row: its other columns, and size, digest and sketch of its set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in rows_in_chunks(batches, "_text"):
            sets = shingle_sets(texts, n_words)
            digests = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
            codes = pa.array([c.tobytes() for c in sketches(sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), codes], [*kept, "n_shingles", "node", "mark", "sketch"])

    return run


def _keyed(n_words: int, percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (part, node, size, reach) of each set; of equal sets in one task only the first is keyed. Followers are left out; each
    pair of follower and leader has a part of its own instead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sets: list[np.ndarray] = []
        nodes: list[int] = []
        keys: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, own = np.concatenate([np.zeros(0, np.int64), *keys]), np.repeat(np.arange(len(sets)), [len(k) for k in keys])
            node, size = np.array(nodes, np.int64), np.array([len(s) for s in sets], np.int64)
            stays, reach, pairs = combine(key, own, size, sketches(sets), percent)
            with np.errstate(over="ignore"):
                named = mix64(mix64(node[pairs[:, 0]].view(np.uint64)) + node[pairs[:, 1]].view(np.uint64)).view(np.int64)
            whose = np.concatenate((own[stays], pairs[:, 0], pairs[:, 1]))
            columns = np.concatenate((key[stays], named, named)), node[whose], size[whose].astype(np.int32), np.concatenate((reach[stays], np.zeros(2 * len(pairs), np.int16)))
            for x in (sets, nodes, keys):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "node", "size", "reach"])

        waiting = 0
        for rows, texts in rows_in_chunks(batches, "_text", 300_000):
            for s, known in zip(shingle_sets(texts, n_words), rows.column(0).is_valid().to_pylist()):
                if len(s) and known and (digest := set_digest(s)) not in seen:
                    seen.add(digest)
                    sets.append(s)
                    nodes.append(digest[0])
                    keys.append(part_keys(s, percent))
                    waiting += len(keys[-1]) + len(s)
            if waiting > COMBINED:
                waiting = 0
                yield flush()
        yield flush()

    return run


def _tied(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ties of rows (part, node, size, reach, sketch) that come sorted by part and size. The last group of a batch waits for the next;
    one that is too large to wait goes on from the leaders that it has so far."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nodes, sizes, reach = (np.zeros(0, np.int64) for _ in range(4))
        codes = np.zeros((0, BINS), np.uint8)
        going: tuple[int, Leaders] | None = None  # the part that is under way

        def ties(heads: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            nonlocal going
            out: list[tuple[int, int]] = []
            if going and len(heads) and int(part[heads[0]]) == going[0]:
                a, b = heads[0], ends[0]
                out += going[1].add(nodes[a:b], sizes[a:b], codes[a:b], reach[a:b])
                heads, ends = heads[1:], ends[1:]
            two = heads[ends - heads == 2]  # most groups
            numbers = [np.stack((filled(codes[k]), reach[k], np.where(reach[k] > 0, sizes[k] * percent / 100, sizes[k]), np.where(reach[k] > 0, sizes[k] * 100 / percent, sizes[k])), 1) for k in (two, two + 1)]
            tied = two[near(differing(codes[two], codes[two + 1]), *numbers, percent / 100) & (nodes[two] != nodes[two + 1])]
            for a, b in zip(heads.tolist(), ends.tolist()):
                if b - a > 2:
                    out += tie_group(nodes[a:b], sizes[a:b], codes[a:b], reach[a:b], percent)
            a, b = nodes[tied].tolist() + [x for x, _ in out], nodes[tied + 1].tolist() + [y for _, y in out]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            part, nodes, sizes, reach = (np.concatenate((x, batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64))) for k, x in enumerate((part, nodes, sizes, reach)))
            codes = np.concatenate((codes, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BINS)))
            if not len(part):
                continue
            heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = np.append(heads[1:], len(part))
            last = int(heads[-1])
            same = going is not None and int(part[last]) == going[0]
            if same or len(part) - last > ALL_PAIRS:  # too large to wait
                if not same:
                    yield ties(heads[:-1], ends[:-1])
                    going, heads, ends = (int(part[last]), Leaders(percent)), heads[-1:], ends[-1:]
                yield ties(heads, ends)
                last = len(part)
            else:
                yield ties(heads[:-1], ends[:-1])
            part, nodes, sizes, reach, codes = part[last:], nodes[last:], sizes[last:], reach[last:], codes[last:]
        heads = np.zeros(min(1, len(part)), np.int64)
        yield ties(heads, heads + len(part))

    return run


def candidate_ties(texts: DataFrame, sketched: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Ties (a, b) of sets, by their nodes, such that every link of ``texts`` (columns _id, _text) lies within a tied component.

    One shuffle of a few numbers for every part; what isn't alone with its part goes on with its sketch."""
    parts = texts.mapInArrow(_keyed(n_words, percent), "part long, node long, size int, reach short")
    by_part = Window.partitionBy("part")
    shared = parts.withColumn("low", F.min("node").over(by_part)).withColumn("high", F.max("node").over(by_part)).where("low < high").groupBy("part", "node").agg(F.max("size").alias("size"), F.max("reach").alias("reach"))
    with_sketch = shared.join(sketched, "node").select("part", "node", "size", "reach", "sketch")
    return with_sketch.repartition("part").sortWithinPartitions("part", "size", "node").mapInArrow(_tied(percent), "a long, b long").distinct()


def placed_in_chunks(members: DataFrame) -> DataFrame:
    """``members`` (columns root, cid, size) with their ``chunk``: runs of sizes of a bounded number of shingles; a size that has more is
    split by hash. Windows run over a component's distinct sizes, not its members."""
    sizes = members.groupBy("root", "size").agg(F.sum(F.col("size") + 64).alias("weight"))
    before = F.coalesce(F.sum("weight").over(Window.partitionBy("root").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("root", "size", F.floor(before / CHUNK_SHINGLES).alias("start"), F.ceil(F.col("weight") / CHUNK_SHINGLES).alias("pieces"))
    return members.join(starts, ["root", "size"]).withColumn("chunk", (F.col("start") + F.pmod(F.xxhash64("cid"), F.col("pieces"))).cast("int")).drop("start", "pieces")


def _carried(n_words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each set, once for every group (root, p, q) that it takes part in; texts of the same id but with another set are passed over."""
    fields = (("root", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("right", pa.bool_()), ("cid", pa.int64()), ("label", pa.int64()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in rows_in_chunks(batches, "_text", 300_000):
            sets = shingle_sets(texts, n_words)
            where = rows.column(1).to_pylist()
            for k in range(0, len(sets), 64):
                take = [(i, w) for i in range(k, min(k + 64, len(sets))) for digest in (set_digest(sets[i]),) for w in where[i] if (w["node"], w["mark"]) == digest]
                yield pa.RecordBatch.from_arrays([*(pa.array([w[c] for _, w in take], t) for c, t in fields), pa.array([sets[i].tobytes() for i, _ in take], pa.binary())], [*(c for c, _ in fields), "grams"])

    return run


def _chunk_links(percent: int) -> Callable[..., pd.DataFrame]:
    """Links (a, b) of one group's sets; and of a group that is a chunk (p = q) its node: bitmap and fewest bits."""

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["right", "cid"])  # an id may have several texts with one set
        rows = rows.assign(size=rows["grams"].map(len)).sort_values(["right", "size", "cid"])
        sets = [np.frombuffer(g, np.uint64) for g in rows["grams"]]
        n, ids = int((~rows["right"]).sum()), rows["cid"].to_numpy()
        found = tree_links(sets[:n], sets[n:] if n < len(sets) else None, percent, rows["label"].to_numpy()) if n else []
        out = pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}, dtype=np.int64)
        if key[1] != key[2]:
            return out.assign(root=key[0], chunk=key[1], bitmap=None, bits=0)
        bitmap, fewest = np.zeros(CHUNK_BITS // 64, np.uint64), CHUNK_BITS
        for s in sets:
            bit = np.unique(s >> np.uint64(48)) % np.uint64(CHUNK_BITS)
            np.bitwise_or.at(bitmap, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            fewest = min(fewest, len(bit))
        node = pd.DataFrame({"a": [-1], "b": [-1], "root": [key[0]], "chunk": [key[1]], "bitmap": [bitmap.view(np.int64)], "bits": [fewest]})
        return pd.concat((out.assign(root=key[0], chunk=key[1], bitmap=None, bits=0), node))

    return links


def compared(texts: DataFrame, places: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Links and chunk nodes of the groups in ``places`` (columns _id, root, p, q, right, cid, label, node, mark). The texts of classes
    travel once, then their sets."""
    where = places.groupBy("_id").agg(F.collect_list(F.struct("root", "p", "q", "right", "cid", "label", "node", "mark")).alias("places"))
    once = texts.join(where, "_id").withColumn("_hash", F.xxhash64("_text")).dropDuplicates(["_id", "_hash"]).select("_text", "places")
    carried = once.mapInArrow(_carried(n_words), "root long, p int, q int, right boolean, cid long, label long, grams binary")
    return checkpointed(carried.groupBy("root", "p", "q").applyInPandas(_chunk_links(percent), "a long, b long, root long, chunk int, bitmap array<long>, bits int"))


def _group(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the group that ``links`` put them in as ``label``."""
    merged = components(links).select(F.col("id").alias("cid"), F.col("root").alias("_to"))
    return members.drop("label").join(merged, "cid", "left").withColumn("label", F.coalesce("_to", "cid")).drop("_to")


def class_links(texts: DataFrame, members: DataFrame, n_words: int, percent: int) -> DataFrame:
    """Links (a, b) of classes, by cid, that connect all that links connect within each candidate component (``members``: columns
    root, cid, size, _id, node, mark)."""
    own = lambda df: df.withColumn("p", F.col("chunk")).withColumn("q", F.col("chunk")).withColumn("right", F.lit(False))
    placed = checkpointed(placed_in_chunks(members).withColumn("label", F.col("cid")))
    found = compared(texts, own(placed), n_words, percent)
    links = found.where("a >= 0").select("a", "b")
    large = placed.groupBy("root").agg(F.max("chunk").alias("last")).where("last > 0").select("root")
    if not large.head(1):
        return links
    # One class of each connected group of each chunk; they connect most groups of a component.
    many = checkpointed(_group(placed.join(large, "root"), links))
    first = many.groupBy("root", "chunk", "label").agg(F.min("cid").alias("cid")).select("cid")
    some = placed_in_chunks(many.join(first, "cid").drop("chunk")).withColumn("label", F.col("cid"))
    links = links.unionByName(compared(texts, own(some), n_words, percent).where("a >= 0").select("a", "b"))
    # Chunks are compared with each other where their groups differ and their nodes leave an overlap possible.
    many = checkpointed(_group(many, links))
    nodes = many.groupBy("root", "chunk").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("label").alias("l"), F.max("label").alias("h")).join(found.where("a < 0").select("root", "chunk", "bitmap", "bits"), ["root", "chunk"])
    both = F.aggregate(F.zip_with("x.bitmap", "y.bitmap", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, k: n + k)
    most = lambda side: F.col(f"{side}.high") - F.greatest(F.lit(0), F.col(f"{side}.bits") - both)
    pairs = (
        nodes.alias("x").join(nodes.alias("y"), F.expr("x.root = y.root and x.chunk < y.chunk"))
        .where(f"100 * x.high >= {percent} * y.low and 100 * y.high >= {percent} * x.low and not (x.l = x.h and y.l = y.h and x.l = y.l)")
        .where(F.least(most("x"), most("y")) * (100 + percent) >= percent * (F.col("x.low") + F.col("y.low")))
        .select("x.root", F.col("x.chunk").alias("p"), F.col("y.chunk").alias("q"))
    )
    sides = pairs.select("root", F.col("p").alias("chunk"), "p", "q", F.lit(False).alias("right")).unionByName(pairs.select("root", F.col("q").alias("chunk"), "p", "q", F.lit(True).alias("right")))
    return links.unionByName(compared(texts, many.join(sides, ["root", "chunk"]), n_words, percent).where("a >= 0").select("a", "b"))


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col`` (a long), n_shingles, class_id (smallest id with the same set), component_id, and the columns of ``docs`` named in
    ``keep``: one row per row of ``docs``."""
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    read = docs.select(docs[text_col].alias("_text"), docs[id_col].cast("long").alias("_id"), *(docs[c].alias(f"_keep_{c}") for c in keep))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in read.schema[1:])
    rows = checkpointed(read.mapInArrow(_digested(n_words, read.columns[1:]), f"{fields}n_shingles long, node long, mark long, sketch binary"))
    known = rows.where("_id is not null and n_shingles > 0")
    # One class for equal sets; minima are taken before the shuffle, so copies cost little. Its number stays, since it is written.
    classes = checkpointed(known.groupBy("node", "mark").agg(F.min("_id").alias("class_id"), F.max("n_shingles").alias("size"))).withColumn("cid", F.monotonically_increasing_id())
    group = components(candidate_ties(texts, known.groupBy("node").agg(F.min("sketch").alias("sketch")), n_words, percent))
    members = classes.join(group, classes["node"] == group["id"]).select("root", "cid", F.col("class_id").alias("_id"), "size", "node", "mark")
    several = members.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    merged = checkpointed(components(class_links(texts, members.join(several, "root"), n_words, percent)).select(F.col("id").alias("cid"), "root"))
    smallest = classes.join(merged, "cid").groupBy("root").agg(F.min("class_id").alias("component_id"))
    final = classes.join(merged.join(smallest, "root").drop("root"), "cid", "left").select("node", "mark", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = [F.col("_id").alias(id_col), "n_shingles", "class_id", "component_id", *(F.col(f"_keep_{c}").alias(c) for c in keep)]
    linked_rows = known.join(final, ["node", "mark"]).select(*out)
    alone = rows.where("_id is null or n_shingles = 0").withColumn("class_id", F.col("_id")).withColumn("component_id", F.col("_id")).select(*out)
    return linked_rows.unionByName(alone)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: 3-word shingles, 100 * shared >= 90 * union, over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")
