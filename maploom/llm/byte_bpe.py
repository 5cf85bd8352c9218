"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Many texts are laid end to end as an array of code points, and a table gives each its class: letter, number,
space, other white space, other, and for apostrophes that could begin a contraction (looking ahead) how many
letters it has. A state machine runs over the classes. As a function of the state before it, each code point
maps states to states; such functions compose associatively, so prefixes are found by a scan that doubles its
reach. Nearly every function is constant, and composing with a constant gives a constant: only stretches behind
an apostrophe need the scan, and it ends when all functions there are constant. A boundary is where the state
begins a new piece; a last correction gives the space before a piece to that piece and splits white space before
it. No regular expression is run.

The pieces, slices of the UTF-8 bytes, look up their ids in a cache of bounded size; a new piece merges its
pairs by rank. Token offsets are kept for decoding, which gathers the tokens' bytes.

Defined results: null texts count as empty and have no ids; lone surrogates do not occur in Spark strings; a
null id is an id like any other; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED = 200_000
BATCH_CHARS = 1 << 20
# classes of code points; states are the class of the piece that is open, and what a contraction still needs
LETTER, NUMBER, SPACE, WHITE, OTHER, SHORT, LONG, EDGE = range(8)
IN_SHORT, IN_LONG, LAST, DONE = 8, 9, 10, 11
STATES = 12


def transitions() -> np.ndarray:
    """Row c: the state after a code point of class c, for each state before it.

    SHORT and LONG are apostrophes before one or two letters of a contraction: they open it unless an open
    piece of others, or a space, takes the apostrophe in. EDGE is the break between texts.
    """
    table = np.zeros((8, STATES), np.uint8)
    for c in (LETTER, NUMBER, SPACE, WHITE, OTHER):
        table[c] = c
    table[SHORT], table[LONG] = IN_SHORT, IN_LONG
    for c in (SHORT, LONG):
        table[c, [SPACE, OTHER]] = OTHER
    for c in range(7):  # what a contraction takes is taken whatever it is
        table[c, IN_SHORT], table[c, IN_LONG], table[c, LAST] = DONE, LAST, DONE
    table[EDGE] = EDGE
    return table


def code_point_classes() -> np.ndarray:
    """The class of every code point, by its Unicode category and white space."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    # fixed values: the code points with the property White_Space
    table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    table[32] = SPACE
    return table


TRANSITIONS = transitions()
_classes: list[np.ndarray] = []
_encoders: dict[str, ByteBpe] = {}


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point; -1 marks breaks between texts."""
    if not _classes:
        _classes.append(code_point_classes())
    out = np.where(points >= 0, _classes[0][points], EDGE).astype(np.uint8)
    at = np.flatnonzero(points[:-2] == ord("'"))
    a, b = points[at + 1], points[at + 2]
    out[at[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
    pairs = np.zeros(len(at), bool)
    for two in ("re", "ve", "ll"):
        pairs |= (a == ord(two[0])) & (b == ord(two[1]))
    out[at[pairs]] = LONG
    return out


def scan(kinds: np.ndarray) -> np.ndarray:
    """The state after each code point."""
    state = kinds.copy()  # right wherever the function is constant over the states that can be
    apostrophe = np.flatnonzero((kinds == SHORT) | (kinds == LONG))
    if not len(apostrophe):
        return state
    # a contraction reaches three code points; what follows starts from a state that does not depend on more
    near = np.unique((apostrophe[:, None] + np.arange(-1, 4)).ravel())
    near = near[(near >= 0) & (near < len(kinds))]
    functions = TRANSITIONS[kinds[near]]
    head = np.concatenate(([True], np.diff(near) > 1))
    # before a stretch stands no apostrophe in reach, so its first function is constant: the class itself
    functions[head] = np.where((kinds[near[head]] == SHORT) | (kinds[near[head]] == LONG), np.where(kinds[near[head]] == SHORT, IN_SHORT, IN_LONG), kinds[near[head]])[:, None]
    start = np.maximum.accumulate(np.where(head, np.arange(len(near)), 0))
    reach = 1
    while (functions != functions[:, :1]).any():
        back = np.arange(len(near)) - reach
        own = np.flatnonzero(back >= start)
        functions[own] = np.take_along_axis(functions[own], functions[back[own]], axis=1)
        reach *= 2
    state[near] = functions[:, 0]
    return state


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point of texts divided and followed by -1; the breaks count as pieces."""
    kinds = classes(points)
    state = scan(kinds)
    before = np.concatenate(([EDGE], state[:-1])).astype(np.uint8)
    white = (state == SPACE) | (state == WHITE)
    was_white = (before == SPACE) | (before == WHITE)
    starts = (state != before) & ~(white & was_white)
    starts |= (state == IN_SHORT) | (state == IN_LONG) | (state == EDGE)
    starts &= ~((state == LAST) | (state == DONE))
    # before a piece of its own text a run of white space loses its last code point: a space joins the piece
    # unless that is a contraction, others stand alone
    last = np.flatnonzero(starts[1:] & white[:-1] & ~white[1:] & (state[1:] != EDGE))
    joins = (state[last] == SPACE) & np.isin(state[last + 1], (LETTER, NUMBER, OTHER))
    starts[last] = True
    starts[last[joins] + 1] = False
    return starts


class ByteBpe:
    """Encodes by a file of ranks (base64 token, rank), each piece of text by itself."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a piece: of neighbouring parts the pair of lowest rank joins, until none has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 200:
            return self._merge_long(piece)
        get = self.ranks.get
        cuts = list(range(len(piece) + 1))
        pair = [get(piece[k : k + 2]) for k in range(len(piece) - 1)]
        none = len(self.lengths)
        pair = [none if p is None else p for p in pair]
        while pair and (best := min(pair)) < none:
            k = pair.index(best)
            del cuts[k + 1], pair[k]
            if k < len(pair):
                rank = get(piece[cuts[k] : cuts[k + 2]])
                pair[k] = none if rank is None else rank
            if k:
                rank = get(piece[cuts[k - 1] : cuts[k + 1]])
                pair[k - 1] = none if rank is None else rank
        return tuple(self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """As merge, with a heap: long runs take n log n steps."""
        from heapq import heapify, heappop, heappush

        n, get = len(piece), self.ranks.get
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(piece[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            _, k, end = heappop(heap)
            mid = after[k] if alive[k] else n
            if mid >= n or after[mid] != end:
                continue
            alive[mid] = False
            after[k] = end
            if end < n:
                prior[end] = k
                if (r := get(piece[k : after[end]])) is not None:
                    heappush(heap, (r, k, after[end]))
            if prior[k] >= 0 and (r := get(piece[prior[k] : end])) is not None:
                heappush(heap, (r, prior[k], end))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[piece[k : after[k]]])
            k = after[k]
        return tuple(out)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        texts = [t or "" for t in texts]
        out: list[list[int]] = []
        cache = self.cache
        points = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), "<i4"), np.array([-1], "<i4"))] or [np.zeros(0, "<i4")])
        starts = np.flatnonzero(piece_starts(points)) if len(points) else np.zeros(0, np.int64)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        width[points < 0] = 0
        at = (np.cumsum(width, dtype=np.int64) - width)[starts].tolist()
        breaks = np.flatnonzero(points[starts] < 0).tolist()
        data = "".join(texts).encode()
        at.append(len(data))
        first = 0
        for stop in breaks:
            pieces = [data[a:b] for a, b in zip(at[first:stop], at[first + 1 : stop + 1], strict=True)]
            first = stop + 1
            ids: list[int] = []
            for piece in pieces:
                found = cache.get(piece)
                if found is None:
                    if len(cache) >= CACHED:
                        cache.clear()
                    found = self.merge(piece)
                    if len(piece) <= 64:
                        cache[piece] = found
                ids += found
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, and where each token begins in them."""
        lengths = self.lengths[ids]
        begin = np.cumsum(lengths) - lengths
        source = np.repeat(self.offsets[ids] - begin, lengths) + np.arange(int(lengths.sum()))
        return self.bytes[source].tobytes(), begin


def encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def in_batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about BATCH_CHARS characters."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_CHARS or k + 1 == len(texts):
            yield first, k + 1
            first, size = k + 1, 0


def encoded(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, ids, and the byte offset of each token in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_batches(texts):
                ids = bpe.encode(texts[a:b])
                offsets = [bpe.decode(np.array(x, np.int64))[1] for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], [id_col, "ids", "offsets"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, ids array<int>, offsets array<long>")


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its number of ids, their digest, and the digest of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, sums, decoded = [], [], []
            for a, b in in_batches(texts):
                for ids in bpe.encode(texts[a:b]):
                    counts.append(len(ids))
                    sums.append(sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    decoded.append(sha256(bpe.decode(np.array(ids, np.int64))[0]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
