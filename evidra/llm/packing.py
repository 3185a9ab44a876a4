"""Best-fit packing of token sequences, with a swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences of their own. The rest are dealt into
shards of bounded size. In each shard, items go into the bin where they leave least room, larger ones first. Where that leaves more bins
than the lower bound, the local search empties the emptiest ones: it moves items into other underfull bins, or exchanges one for
one, two for one or one for two, always the exchange that takes most tokens out and so raises the sum of squared fills, until the
bound is met or none of the bins that are too many can be improved. All underfull bins of the shard may receive. If that ends above
the bound, it is tried from another first state too (size classes in order of arrival), and the state with fewer bins stays. The emptiest
bins of all shards are dealt again, into far fewer shards, until one shard is left.

Null text is an empty text; an empty text is one piece (its closing id). Repeated rows are packed once each, told apart by
their ids' checksum only: give ``id_col`` unique values where pieces must be traced back. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.bpe import encode_texts, encoder, ranks_path
from evidra.llm.common import checkpointed, rows_in_chunks, table

CAPACITY = 2048
#: Items that one shard holds at most, about; and the emptiest bins of a shard that are dealt again.
SHARD_ITEMS, OPEN_BINS = 50_000, 24
#: Fixed value: the id of the end-of-text string in the public vocabulary, and the id that closes a document.
SPECIAL = {"<|endoftext|>": 50256}
CLOSING = (0).to_bytes(4, "little")


class Bins:
    """The bin of each item, fills of bins, and how many exchanges were made."""

    def __init__(self, sizes: list[int], capacity: int):
        self.size, self.capacity, self.steps = np.asarray(sizes, np.int64), capacity, 0
        self.own = np.full(len(sizes), -1, np.int64)
        self.fill = np.zeros(0, np.int64)
        self._place(np.argsort(-self.size, kind="stable"))

    def _place(self, items: np.ndarray) -> None:
        """Best fit in this order: the bin with the smallest room that is enough, or else a new one."""
        fill, own = [], []
        rooms: list[int] = []  # distinct rooms, ascending
        with_room: dict[int, list[int]] = defaultdict(list)
        for n in self.size[items].tolist():
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                b, room = len(fill), self.capacity
                fill.append(0)
            else:
                room = rooms[at]
                b = with_room[room].pop()
                if not with_room[room]:
                    del rooms[at]
            own.append(b)
            fill[b] += n
            if left := room - n:
                if not with_room[left]:
                    bisect.insort(rooms, left)
                with_room[left].append(b)
        self.own[items], self.fill = own, np.array(fill, np.int64)

    def least(self) -> int:
        """No packing has fewer bins."""
        return max(-(-int(self.size.sum()) // self.capacity), int((2 * self.size > self.capacity).sum()))

    def used(self) -> int:
        return int((self.fill > 0).sum())

    def improve(self) -> None:
        """Search from the first state, and from another one where that ends above the bound; the state with fewer bins stays."""
        self._search()
        if self.used() > self.least():
            kept = self.own, self.fill, self.steps
            self.own, self.steps = np.full(len(self.own), -1, np.int64), 0
            self._place(np.argsort(-np.frexp(self.size)[1], kind="stable"))  # by size class, then by arrival
            self._search()
            if self.used() >= int((kept[1] > 0).sum()):
                self.own, self.fill, self.steps = kept

    def _search(self) -> None:
        """Empty the emptiest bins into others. Every step raises the sum of squared fills, so it ends."""
        stuck: set[int] = set()
        while (over := self.used() - self.least()) > 0:
            order = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            order = order[np.argsort(self.fill[order], kind="stable")][:over]
            donor = next((b for b in order.tolist() if b not in stuck), None)
            if donor is None:
                return
            before = self.steps
            while self.fill[donor] and self._step(donor):
                pass
            if self.steps > before:
                stuck.clear()
            if self.fill[donor]:
                stuck.add(donor)

    def _step(self, donor: int) -> bool:
        """Make the exchange that takes most tokens out of the donor; of equal ones, that which leaves the receiver least room."""
        room = np.where((self.fill >= self.fill[donor]) & (self.fill < self.capacity), self.capacity - self.fill, 0)
        room[donor] = 0
        mine = np.flatnonzero(self.own == donor)
        theirs = np.flatnonzero(room[self.own] > 0)
        one = self.size[mine]
        singles = [(np.array([i]), int(self.size[i])) for i in mine[np.unique(one, return_index=True)[1]]]
        return self._exchange(donor, room, singles, theirs) or self._exchange(donor, room, self._pairs(mine), theirs, False) or self._return_two(donor, room, singles, theirs)

    def _pairs(self, items: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Two of the items, once for each sum."""
        i, j = np.triu_indices(len(items), 1)
        sums, first = np.unique(self.size[items[i]] + self.size[items[j]], return_index=True)
        return [(np.array([items[i[k]], items[j[k]]]), n) for n, k in zip(sums.tolist(), first.tolist())]

    def _exchange(self, donor: int, room: np.ndarray, out: list[tuple[np.ndarray, int]], theirs: np.ndarray, moves: bool = True) -> bool:
        """``out`` for nothing (``moves``) or for one of ``theirs``."""
        back, space = self.size[theirs], room[self.own[theirs]]
        best: tuple[int, int, np.ndarray, np.ndarray, int] | None = None
        for items, n in out[::-1]:
            if best and n <= best[0]:
                break
            if moves and len(fits := np.flatnonzero(room >= n)):
                to = int(fits[room[fits].argmin()])
                best = max(best, (n, -int(room[to]), items, theirs[:0], to), key=lambda x: x[:2]) if best else (n, -int(room[to]), items, theirs[:0], to)
            gain = np.where(n - back <= space, n - back, 0)
            if len(gain) and (top := int(gain.max())) > (best[0] if best else 0):
                k = np.flatnonzero(gain == top)
                k = int(k[space[k].argmin()])
                best = (top, -int(space[k]), items, theirs[k : k + 1], int(self.own[theirs[k]]))
        return self._apply(donor, best)

    def _return_two(self, donor: int, room: np.ndarray, out: list[tuple[np.ndarray, int]], theirs: np.ndarray) -> bool:
        """One item for two of a receiver: pairs of neighbours, then of items two apart and so on, within each receiver."""
        theirs = theirs[np.argsort(self.own[theirs], kind="stable")]
        own, size = self.own[theirs], self.size[theirs]
        best: tuple[int, int, np.ndarray, np.ndarray, int] | None = None
        for lag in range(1, len(theirs)):
            k = np.flatnonzero(own[lag:] == own[:-lag])
            if not len(k):
                break
            back, space = size[k] + size[k + lag], room[own[k]]
            for items, n in out:
                gain = np.where(n - back <= space, n - back, 0)
                if (top := int(gain.max())) > (best[0] if best else 0):
                    j = int(k[gain.argmax()])
                    best = (top, 0, items, theirs[[j, j + lag]], int(own[j]))
        return self._apply(donor, best)

    def _apply(self, donor: int, best: tuple[int, int, np.ndarray, np.ndarray, int] | None) -> bool:
        if best is None:
            return False
        gain, _, out, back, to = best
        self.own[out], self.own[back] = to, donor
        self.fill[donor] -= gain
        self.fill[to] += gain
        self.steps += 1
        return True


def pack_shard(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items (by position) of each bin, none empty."""
    bins = Bins(sizes, capacity)
    bins.improve()
    order = np.argsort(bins.own, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(bins.own[order])) + 1)] if len(order) else []


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: all full but, if need be, the first."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: ``id_col``, piece, start, length, ids_crc32. No shuffle; ids stay in the worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for rows, texts in rows_in_chunks(batches, "_text"):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode_texts(coder, texts, SPECIAL)):
                ids, done = np.ascontiguousarray(ids, "<u4"), 0
                for k, n in enumerate(cut(len(ids) + 1, capacity)):
                    at.append(i)
                    piece.append(k)
                    start.append(done)
                    length.append(n)
                    done += n
                    crc.append(zlib.crc32(ids[done - n : done]))
                crc[-1] = zlib.crc32(CLOSING, crc[-1])  # the last piece's last id isn't in ids
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col].alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, piece long, start long, length long, ids_crc32 long").withColumn("piece", F.col("piece").cast("int"))


def _packer(names: list[str], capacity: int, level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Packs one shard; but in the last round, its emptiest bins stay open."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(names, kind="stable").reset_index(drop=True)
        n = rows["length"].to_numpy()
        bins = pack_shard(n.tolist(), capacity)
        fill = [int(n[b].sum()) for b in bins]
        loose = set() if last else set(sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: fill[k])[:OPEN_BINS])
        order = np.array([i for b in bins for i in b], np.int64)
        sizes = np.array([len(b) for b in bins], np.int64)
        own = np.repeat(np.arange(len(bins)), sizes)
        before = np.cumsum(n[order]) - n[order]
        begin = before[np.cumsum(sizes) - sizes]
        sequence = (level << 56) + (int(key[0]) << 24) + own.astype(np.int64)
        return rows[names].iloc[order].assign(sequence_id=sequence, offset=(before - begin[own]).astype(np.int64), open=[int(k) in loose for k in own])

    return one


def pack(pieces: DataFrame, n_items: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (written already) with ``sequence_id`` and ``offset``. ``n_items`` (about the number of pieces below capacity)
    sets only the number of shards. Each round writes its rows to the checkpoint folder."""
    columns, names = pieces.columns, [*pieces.columns, "_row"]
    # Numbered rows are dealt evenly even if they are all equal; the pieces are written, so numbers stay.
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    done, level = None, 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, open boolean"
    while True:
        shards = max(1, -(-n_items // SHARD_ITEMS))

        packed = checkpointed(rest.withColumn("_shard", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(shards)).cast("int")).groupBy("_shard").applyInPandas(_packer(names, capacity, level, shards == 1), schema))
        closed = packed.where("not open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        if shards == 1:
            return full.unionByName(done).select(*columns, "sequence_id", "offset")
        rest = packed.where("open").select(*names)
        n_items, level = min(rest.count(), n_items - 1), level + 1


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise once (written to the checkpoint folder, a few numbers a document), then pack."""
    pieces = checkpointed(token_pieces(docs, vocabulary or ranks_path(), capacity, id_col, text_col))
    return pack(pieces, pieces.where(F.col("length") < capacity).count(), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
