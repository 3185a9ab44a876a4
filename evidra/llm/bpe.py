"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points are turned into class symbols, and a small automaton over those symbols finds where each piece starts: its
transition functions are composed (composition is associative) over whole arrays, and no regular expression runs. The
distinct pieces of a chunk are found by hash; those not in the bounded cache are merged side by side, one merge a round.
The ids of a chunk are decoded and held against its bytes, so that a hash collision can't pass.

Fixed values: the contractions and white space below are those of the pattern of the public vocabulary
(``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``).

Null and empty texts have no ids. Repeated rows are encoded alike, each in its own output row. A string such as
``<|endoftext|>`` in a text is ordinary text unless ``special`` maps it to an id.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidra.llm.common import rows_in_chunks, slice_hashes, table

WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")

# Symbols: letter, number, other, apostrophe of a one- or two-letter contraction, then white space that is followed by
# more white space or the end, a space that is followed by something else, other white space followed by something else.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE_BEFORE, BLANK_BEFORE = range(8)
# States: inside letters, numbers, others, white space; after a leading space; one or two letters of a contraction left; fresh.
IN_L, IN_N, IN_O, IN_S, LED, ONE_LEFT, TWO_LEFT, FRESH = range(8)
#: Pieces that a worker remembers at most; a fuller cache starts anew.
CACHE_PIECES = 600_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """For symbol (plus 8 at the start of a text) and state: the next state, and whether a piece starts here."""
    go, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for symbol in range(8):
        for state in range(8):
            own = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, SHORT: IN_O, LONG: IN_O}.get(symbol)
            if symbol == LETTER and state in (ONE_LEFT, TWO_LEFT):
                to, new = (FRESH if state == ONE_LEFT else ONE_LEFT), False
            elif own is not None and state in (own, LED):
                to, new = own, False
            elif symbol in (SHORT, LONG):
                to, new = (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
            elif own is not None:
                to, new = own, True
            elif symbol == BLANK:
                to, new = IN_S, state != IN_S
            else:
                to, new = (LED if symbol == SPACE_BEFORE else FRESH), True
            go[symbol, state], begins[symbol, state] = to, new
    go[8:], begins[8:] = go[:8, FRESH][:, None], True
    return go, begins


GO, BEGINS = _automaton()
#: The state after each symbol where its function is constant; for a letter or a contraction quote, that from most states.
AFTER = GO[:, FRESH].copy()


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK of every code point. Letters are what ``isalpha`` is true of; categories are asked of the rest
    that has a numeric value."""
    every = [chr(c) for c in range(0x110000)]
    letter = np.fromiter(map(str.isalpha, every), bool, len(every))
    numeric = np.flatnonzero(np.fromiter(map(str.isnumeric, every), bool, len(every)) & ~letter)
    out = np.where(letter, np.uint8(LETTER), np.uint8(OTHER))
    out[[c for c in numeric.tolist() if unicodedata.category(chr(c))[0] == "N"]] = NUMBER
    out[list(WHITE_SPACE)] = BLANK
    return out


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions in ``points`` (code points of texts laid end to end) where a piece starts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    symbols = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    blank = symbols == BLANK
    before = blank & ~first[1:] & ~np.append(blank[1:], True)
    symbols[before] = np.where(points[before] == 0x20, SPACE_BEFORE, BLANK_BEFORE)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        ahead = np.concatenate((points, [0, 0]))
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        fits = ~first[np.minimum(quotes + 1, n)]
        short = fits & np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        fits &= ~first[np.minimum(quotes + 2, n)]
        long = fits & np.logical_or.reduce([(one == ord(e[0])) & (two == ord(e[1])) for e in LONG_ENDINGS])
        symbols[quotes[short]], symbols[quotes[long]] = SHORT, LONG
    symbols[first[:n]] += 8
    # Every function but those of letters and contraction quotes is constant, so a prefix composition is known at once
    # outside the few places behind a quote; there the (at most three) functions are composed one by one.
    after = AFTER[symbols]
    spots = np.flatnonzero((symbols & 7 == SHORT) | (symbols & 7 == LONG))
    if len(spots):
        state = np.where(spots > 0, after[spots - 1], FRESH).astype(np.uint8)
        for k in range(3):
            live = spots + k < n
            spots, state = spots[live], state[live]
            state = GO[symbols[spots + k], state]
            after[spots + k] = state
    ahead_of = np.concatenate(([np.uint8(FRESH)], after[:-1]))
    return np.flatnonzero(BEGINS.ravel()[symbols.astype(np.int64) * 8 + ahead_of])


NO_PAIR = 1 << 30
#: Longer pieces are merged one by one with a heap.
WIDE = 40


class Encoder:
    """Ranks of one vocabulary, merged pieces by hash, and the table for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(self.ranks.values()) + 1
        parts = [b""] * size
        for piece, rank in self.ranks.items():
            parts[rank] = piece
        self.lengths = np.fromiter(map(len, parts), np.int64, size)
        self.places = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        ranks = self.ranks
        pairs = sorted((ranks[p[:i]] << 32 | ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [NO_PAIR], np.int64)
        every = np.arange(256)
        self.byte_pairs = np.full((int(self.byte_ids.max()) + 1,) * 2, NO_PAIR, np.int32)
        left, right = self.byte_ids[every[:, None]], self.byte_ids[every]
        self.byte_pairs[left, right] = self._pair(*np.broadcast_arrays(left, right))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (and id) of the token that two neighbours make."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], NO_PAIR).astype(np.int32)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each piece has."""
        place, counts, flat, todo = [], [], [], []
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                place.append(i)
                counts.append(1)
                flat.append(whole)
            elif len(p) > WIDE:
                own = self.merge_long(p)
                place.append(i)
                counts.append(len(own))
                flat.extend(own)
            else:
                todo.append(i)
        found = [(np.array(place, np.int64), np.array(counts, np.int64), np.array(flat, np.uint32))]
        todo.sort(key=lambda i: len(pieces[i]))
        for k in range(0, len(todo), 4096):
            some = np.array(todo[k : k + 4096])
            found += [(some[rows], n, ids) for rows, n, ids in self._merge_block([pieces[i] for i in todo[k : k + 4096]])]
        places, sizes, ids = (np.concatenate(x) for x in zip(*found))
        begin, order = np.cumsum(sizes) - sizes, np.argsort(places)
        sizes = sizes[order]
        until = np.cumsum(sizes)
        return ids[np.repeat(begin[order] - (until - sizes), sizes) + np.arange(len(ids))], sizes

    def _merge_block(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, counts and ids of pieces as they are done. In each round, every piece merges its leftmost pair of lowest rank: the left
        place takes the new id and the right one leaves the row's chain (places before and behind; the last column ends it)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        wide = int(sizes.max())
        ids = np.full((len(pieces), wide + 1), -1, np.int32)
        ids[:, :wide][np.arange(wide) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        pair = np.full(ids.shape, NO_PAIR, np.int32)
        pair[:, : wide - 1] = np.where(ids[:, 1:wide] >= 0, self.byte_pairs[ids[:, : wide - 1], ids[:, 1:wide]], NO_PAIR)
        behind = np.tile(np.append(np.arange(1, wide + 1), wide).astype(np.int16), (len(pieces), 1))
        before = np.tile(np.arange(-1, wide, dtype=np.int16), (len(pieces), 1))
        rows = np.arange(len(pieces))
        while len(rows):
            low = pair.argmin(1)
            rank = pair[np.arange(len(rows)), low]
            live = rank < NO_PAIR
            if live.mean() < 0.7:
                done = ids[~live, :wide]
                kept = done >= 0
                yield rows[~live], kept.sum(1), done[kept].astype(np.uint32)
                rows, ids, pair, behind, before, low, rank = (x[live] for x in (rows, ids, pair, behind, before, low, rank))
                live = live[live]
            r = np.flatnonzero(live)
            at, new = low[r], rank[r]
            right, left = behind[r, at], before[r, at]
            end = behind[r, right]
            ids[r, at], ids[r, right], pair[r, right] = new, -1, NO_PAIR
            behind[r, at], before[r, end] = end, at
            pair[r, at], pair[r, left] = self._pair(new, ids[r, end]), self._pair(ids[r, left], new)

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for one piece with a heap of pairs: n bytes take n log n steps."""
        ranks, n = self.ranks, len(piece)
        after, prior = list(range(1, n + 1)) + [n], list(range(-1, n))
        gone = bytearray(n + 1)
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if gone[a] or gone[b] or after[a] != b or after[b] != c:
                continue
            gone[b], after[a] = 1, c
            prior[c] = a
            if c < n and (r := ranks.get(piece[a : after[c]])) is not None:
                heapq.heappush(heap, (r, a, c, after[c]))
            if (p := prior[a]) >= 0 and (r := ranks.get(piece[p:c])) is not None:
                heapq.heappush(heap, (r, p, a, c))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        new, counts = self.merge_all(pieces)
        ends = self.begin[-1] + np.cumsum(counts)
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.begin[-1] : ends[-1]] = new
        first = len(self.begin) - 1
        self.begin = np.concatenate((self.begin, ends))
        self.known.update(zip(hashes, range(first, first + len(hashes))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, where each text's ids begin (plus the end), and each id's byte start and end
        counted from the beginning of the joined texts."""
        joined = "".join(texts)
        raw = joined.encode("utf-8", "replace")
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(sizes)))
        if not len(points):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint32), np.zeros(len(at), np.int64), none, none
        starts = piece_starts(points, at[:-1][sizes > 0])
        data = np.frombuffer(raw, np.uint8)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        low, high = byte_at[starts], byte_at[np.append(starts[1:], len(points))]
        hashes, one, which = np.unique(slice_hashes(data, low, high), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self._forget()
        keys = hashes.tolist()
        missing = [i for i, h in enumerate(keys) if h not in self.known]
        if missing:
            self._learn([keys[i] for i in missing], [raw[low[j] : high[j]] for j in one[missing].tolist()])
        place = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        counts = self.begin[place + 1] - self.begin[place]
        until = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(self.begin[place] - until[:-1], counts) + np.arange(until[-1])]
        if self.decode(ids) != raw:  # two pieces with one hash: merge each piece by itself
            ids, counts = self.merge_all([raw[a:b] for a, b in zip(low.tolist(), high.tolist())])
            until = np.concatenate(([0], np.cumsum(counts)))
        stop = np.cumsum(self.lengths[ids])
        return ids, until[np.searchsorted(starts, at)], stop - self.lengths[ids], stop

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        size = self.lengths[ids]
        shift = self.places[ids] - (np.cumsum(size) - size)
        return self.bytes[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    return Encoder(path)


def split_special(text: str, special: dict[str, int]) -> list[str | int]:
    """Cut a text at special strings; these become ids."""
    parts: list[str | int] = [text]
    for string, number in special.items():
        if string in text:
            parts = [y for x in parts for y in ([x] if isinstance(x, int) else [z for k, s in enumerate(x.split(string)) for z in ([number, s] if k else [s])])]
    return parts


def encode_texts(coder: Encoder, texts: list[str], special: dict[str, int] | None = None) -> Iterator[np.ndarray]:
    """The ids of each text; ``special`` strings are ids of their own."""
    if not special or not any(s in t for t in texts for s in special):
        ids, at, _, _ = coder.encode(texts)
        yield from (ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist()))
        return
    for text in texts:
        parts = [np.array([p], np.uint32) if isinstance(p, int) else coder.encode([p])[0] for p in split_special(text, special)]
        yield np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` array<int> and ``decoded`` binary of every text (null: empty). No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for rows, texts in rows_in_chunks(batches, "_text"):
            each = list(encode_texts(coder, texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), pa.array([coder.decode(x) for x in each], pa.binary())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col].alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: number of ids, sha256 of the decimal ids joined by spaces, sha256 of the bytes decoded from the ids.

    The digests are taken where the ids are made, so that ids never leave the worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        decimal = [str(i) for i in range(len(coder.lengths))]
        for rows, texts in rows_in_chunks(batches, "_text"):
            n, sums, back = [], [], []
            for ids in encode_texts(coder, texts):
                n.append(len(ids))
                sums.append(hashlib.sha256(" ".join([decimal[i] for i in ids.tolist()]).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(sums), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col].alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ranks_path() -> str:
    """Default place of the vocabulary's ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document encoded and decoded again."""
    return digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks_path())
