"""Alignment of two tokenizers over the same texts by galloping intersection of their token ends.

Both cut the bytes of a text, so each is a rising list of byte offsets at which tokens end. Offsets in both lists cut
the text into groups. The shorter list of a document drives the search: each of its ends starts in the longer list at
the place that the lengths suggest, doubles its step until it has passed the value, then halves. A batch of texts lies
end to end, and all ends search at once. Common indices slice the groups; the differences of their ranks in the two
lists are how many tokens of each side overlap.

Counting linked id pairs over the corpus never gathers its pairs. Each batch, a block, has a dictionary of its
distinct pairs, and documents hold places in it. Blocks' dictionaries, in which common words are one row, are added up
by pair and joined back; a block's counts then meet its documents. A pair has at most one row for each block, whatever
share of the documents holds it. In a group of many tokens on both sides pairs are formed of distinct ids, with how
often they occur.

Byte-level files are read by tokenizers. Where their merges can be told from their tokens alone (see ranked), tiktoken
encodes by them, to the same ids in a fraction of the time; other files, and texts with very long runs of white space,
which its regular expression cannot hold, stay with tokenizers.

Defined results: a null or empty text, or one whose tokens of either side do not join to a space and the text, has no
tokens, and counts and digest of nothing; a null id is an id like any other; repeated rows are documents each; an
empty table gives an empty result. Only the two named columns are read. A document is held whole, as the tokenizers do.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.byte_bpe import in_batches
from maploom.llm.shared import written

#: Characters that a tokenizer gets at once, and groups with more links than this are linked by distinct ids.
CALL_CHARS = 1 << 18
CROWDED = 256
#: What the ByteLevel step of tokenizers cuts texts by, and the longest run of white space that tiktoken is given.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_RUN = 1 << 17


class Side:
    """A tokenizer with the bytes and decimal digits of its ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [str(k).encode() for k in range(self.size)]
        self.width = np.fromiter(map(len, digits), np.int64, self.size)
        wide = int(self.width.max(initial=1)) + 1
        self.digits = np.frombuffer(b"".join(d.ljust(wide) for d in digits), np.uint8).reshape(self.size, wide)

    def ids(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def joined(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        return self.bytes[np.repeat(self.offsets[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def ranked(path: str, tokenizer, byte_of: dict[str, int]):
    """A tiktoken encoding with the ids of a byte-level BPE file of tokenizers; None where they could differ.

    It joins two neighbours if their bytes together are a token, where the file's merges name both parts. These are the
    same if the merges turn each token's own bytes into that token: neighbours that no merge names, but that are a token
    together, would be what the token's bytes end as.
    """
    try:
        from tiktoken import Encoding
    except ImportError:
        return None
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True):
        return None
    if any(spec.get(k) for k in ("normalizer", "truncation", "padding")) or not all(t["special"] for t in spec.get("added_tokens", [])):
        return None
    vocabulary = model["vocab"]
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if len(made) != len(set(made)) or vocabulary.keys() != byte_of.keys() | set(made):
        return None
    ids = [vocabulary[t] for t in made]
    if ids != sorted(ids) or any([t.id for t in tokenizer.model.tokenize(token)] != [k] for token, k in vocabulary.items()):
        return None
    return Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte_of[c] for c in token): k for token, k in vocabulary.items()}, special_tokens={})


class ByteLevel(Side):
    """A byte-level BPE file of tokenizers; it encodes a space and the text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # printable bytes stand for themselves, the others follow 255 in order
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            tokens[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        super().__init__(tokens)
        self.ranked = ranked(path, self.tokenizer, byte_of)

    def by_library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return self.by_library(texts)
        long = lambda t: len(t) >= WHITE_RUN and max(map(len, re.findall(r"\s+", t)), default=0) >= WHITE_RUN
        return [self.by_library([t])[0] if long(t) else self.ranked.encode_ordinary(" " + t) for t in texts]


class Pieces(Side):
    """A sentencepiece model, which puts a space before the text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        tokens = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode())
        super().__init__(tokens)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_sides: dict[str, Side] = {}


def side(path: str) -> Side:
    """The tokenizer of a file: a JSON file of tokenizers, else a sentencepiece model; one for each worker."""
    if path not in _sides:
        _sides[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _sides[path]


def gallop(values: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each value the first place in ends, from low to high, that is not below it; ends[high] never is.

    Each search begins at start, in the direction that its value needs, with steps that double; then halves what it passed.
    """
    right = ends[start] < values
    below, reach = np.where(right, start, low - 1), np.where(right, high, start)
    step, on = 1, np.flatnonzero(right)
    while len(on):
        at = np.minimum(below[on] + step, high[on])
        less = ends[at] < values[on]
        reach[on[~less]] = at[~less]
        below[on[less]] = at[less]
        on, step = on[less], step * 2
    step, on = 1, np.flatnonzero(~right)
    while len(on):
        at = np.maximum(reach[on] - step, low[on] - 1)
        more = at >= low[on]
        more[more] = ends[at[more]] >= values[on[more]]
        below[on[~more]] = at[~more]
        reach[on[more]] = at[more]
        on, step = on[more], step * 2
    on = np.flatnonzero(reach - below > 1)
    while len(on):
        at = (below[on] + reach[on]) // 2
        less = ends[at] < values[on]
        below[on[less]], reach[on[~less]] = at[less], at[~less]
        on = on[reach[on] - below[on] > 1]
    return reach


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each of sizes, one after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class Block:
    """Texts of a batch: ids of both sides end to end, tokens for each text, and the groups: their text, first tokens and sizes."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    of: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray


def _ids(tokenizer: Side, texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    chunk, size = [], 0
    for k, text in enumerate(texts):
        chunk.append(text)
        size += len(text)
        if size >= CALL_CHARS or k + 1 == len(texts):
            out += [np.array(x, np.int64) for x in tokenizer.ids(chunk)]
            chunk, size = [], 0
    return out


def align(texts: list[str | None], one: Side, two: Side) -> Block:
    """Groups of the texts; those without tokens have none."""
    some = [k for k, t in enumerate(texts) if t]
    kept_a, kept_b, n_a, n_b = [], [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    given = [texts[k] for k in some]
    for k, text, x, y in zip(some, given, _ids(one, given), _ids(two, given), strict=True):
        whole = np.frombuffer((" " + text).encode(), np.uint8)
        if np.array_equal(one.joined(x), whole) and np.array_equal(two.joined(y), whole):
            kept_a.append(x)
            kept_b.append(y)
            n_a[k], n_b[k] = len(x), len(y)
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *kept_a]), np.concatenate([none, *kept_b])
    ends_a, ends_b = np.cumsum(one.lengths[a]), np.cumsum(two.lengths[b])
    start_a, start_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    at_a, at_b = [none], [none]
    for fewer in (True, False):
        docs = np.flatnonzero((n_a > 0) & ((n_a <= n_b) == fewer))
        (short, n_short, s_short), (long, n_long, s_long) = ((ends_a, n_a, start_a), (ends_b, n_b, start_b))[:: 1 if fewer else -1]
        n, m, low = n_short[docs], n_long[docs], s_long[docs]
        own = _ranges(s_short[docs], n)
        begin = np.repeat(low, n) + _ranges(np.zeros(len(docs), np.int64), n) * np.repeat(m, n) // np.repeat(n, n)
        place = gallop(short[own], long, np.repeat(low, n), np.repeat(low + m - 1, n), begin)
        met = long[place] == short[own]
        at_a.append((own if fewer else place)[met])
        at_b.append((place if fewer else own)[met])
    last_a, last_b = np.sort(np.concatenate(at_a)), np.sort(np.concatenate(at_b))
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    of = np.searchsorted(np.cumsum(n_a), last_a, side="right")
    return Block(a, b, n_a, n_b, of, last_a - size_a + 1, last_b - size_b + 1, size_a, size_b)


def digests(block: Block, one: Side, two: Side) -> list[str]:
    """For each text the digest of its groups: ids by commas, | between the sides, ; between groups; empty without tokens."""
    group_a, group_b = (np.repeat(np.arange(len(s)), s) for s in (block.size_a, block.size_b))
    at_a = np.arange(len(block.a)) + block.first_b[group_a]
    at_b = np.arange(len(block.b)) + (block.first_a + block.size_a)[group_b]
    wide = max(one.digits.shape[1], two.digits.shape[1])
    chars, width = np.zeros((len(at_a) + len(at_b), wide), np.uint8), np.zeros(len(at_a) + len(at_b), np.int64)
    sep = np.full(len(width), ord(","), np.uint8)
    for own, at, ids in ((one, at_a, block.a), (two, at_b, block.b)):
        chars[at, : own.digits.shape[1]] = own.digits[ids]
        width[at] = own.width[ids]
    sep[at_a[block.first_a + block.size_a - 1]] = ord("|")
    sep[at_b[block.first_b + block.size_b - 1]] = ord(";")
    chars[np.arange(len(width)), width] = sep
    flat = chars[np.arange(wide) <= width[:, None]]
    ends = np.concatenate(([0], np.cumsum(width + 1)))
    tokens = block.n_a + block.n_b
    last = np.cumsum(tokens)
    return [sha256(flat[ends[z - n] : ends[z] - 1]).hexdigest() if n else "" for z, n in zip(last.tolist(), tokens.tolist(), strict=True)]


def linked(block: Block, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked id pairs of each text, sorted: the text, a * base + b, and how many links they are."""
    links = block.size_a * block.size_b
    few = np.flatnonzero(links <= CROWDED)
    n = links[few]
    k = _ranges(np.zeros(len(few), np.int64), n)
    wide = np.repeat(block.size_b[few], n)
    pair = block.a[np.repeat(block.first_a[few], n) + k // np.maximum(wide, 1)] * base + block.b[np.repeat(block.first_b[few], n) + k % np.maximum(wide, 1)]
    docs, pairs, times = [np.repeat(block.of[few], n)], [pair], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(links > CROWDED).tolist():
        a, times_a = np.unique(block.a[block.first_a[g] : block.first_a[g] + block.size_a[g]], return_counts=True)
        b, times_b = np.unique(block.b[block.first_b[g] : block.first_b[g] + block.size_b[g]], return_counts=True)
        docs.append(np.full(len(a) * len(b), block.of[g]))
        pairs.append((a[:, None] * base + b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
    doc, pair, times = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
    span = int(pair.max(initial=0)) + 1  # both ids; a batch's texts times this stay far below 2^63
    key = doc * span + pair
    if len(few) == len(links):
        key.sort()  # each is one link: how many are equal is how many links they are
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // span, key[first] % span, np.add.reduceat(times, first) if len(first) else times


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, the ids of both sides, and for each group how many tokens of each side and bytes it takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(a_path), side(b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in in_batches(texts):
                block = align(texts[x:y], one, two)
                groups = np.bincount(block.of, minlength=y - x)
                size = np.add.reduceat(one.lengths[block.a], block.first_a) if len(block.a) else block.a
                lists = [_lists(block.a, block.n_a, pa.int32()), _lists(block.b, block.n_b, pa.int32())]
                lists += [_lists(v, groups, pa.int32()) for v in (block.size_a, block.size_b, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *lists], [id_col, "a_ids", "b_ids", "a_tokens", "b_tokens", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, a_ids array<int>, b_ids array<int>, a_tokens array<int>, b_tokens array<int>, n_bytes array<int>")


BLOCKS = pa.schema(
    [("block", pa.int64()), ("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
    + [(c, pa.list_(pa.int32())) for c in ("places", "times")]
    + [("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))]
)
BLOCKS_SQL = "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<int>, pairs array<long>, docs array<int>"


def _blocks(a_path: str, b_path: str):
    """(id, text) to a row for each document, and one for each block, in which pairs is not null: the block's dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(a_path), side(b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in in_batches(texts):
                block = align(texts[x:y], one, two)
                doc, pair, times = linked(block, two.size)
                known, place = np.unique(pair, return_inverse=True)
                held = np.bincount(doc, minlength=y - x)
                links = np.bincount(block.of, weights=block.size_a * block.size_b, minlength=y - x).astype(np.int64)
                none = lambda kind, n=y - x: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(y - x, number)), batch.column(0).slice(x, y - x), pa.array(block.n_a), pa.array(block.n_b), pa.array(np.bincount(block.of, minlength=y - x)), pa.array(links),
                        pa.array(digests(block, one, two)), _lists(place, held, pa.int32()), _lists(times, held, pa.int32()), none(pa.list_(pa.int64())), none(pa.list_(pa.int32())),
                    ],
                    schema=BLOCKS,
                )
                own = [_lists(known, np.array([len(known)]), pa.int64()), _lists(np.bincount(place, minlength=len(known)), np.array([len(known)]), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.nulls(1, BLOCKS.field(k).type) for k in range(1, 9)], *own], schema=BLOCKS)
                number += 1

    return run


COUNTED = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, whose places point into the block's counts."""
    places = docs["places"].combine_chunks()
    flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    times = docs["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(places.offsets.to_numpy())
    number, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    at = counts["place"].to_numpy()
    number[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    sums = [np.diff(np.concatenate(([0], np.cumsum(times * v[flat])))[np.concatenate(([0], ends))]) for v in (best, number)]
    return pa.table({c: docs[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs["groups_sha256"]})


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row tokens, groups and links, how many links are of their A id's most frequent pairs, and the pairs' counts summed."""
    base = side(b_path).size
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(rows.mapInArrow(_blocks(a_path, b_path), BLOCKS_SQL))
    entries = blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "docs"))).select("block", F.col("pos").alias("place"), "col.pairs", "col.docs")
    counts = written(entries.groupBy("pairs").agg(F.sum("docs").alias("n")))
    # at most a row for each id of the first tokenizer
    most = counts.groupBy(F.expr(f"pairs div {base}").alias("a")).agg(F.max("n").alias("most"))
    known = counts.join(F.broadcast(most), F.expr(f"pairs div {base}") == F.col("a")).select("pairs", "n", (F.col("n") == F.col("most")).alias("best"))
    met = entries.drop("docs").join(known, "pairs").select(F.col("block").alias("of"), "place", "n", "best")
    found = blocks.where("pairs IS NULL").drop("pairs", "docs").groupBy("block").cogroup(met.groupBy("of")).applyInArrow(_counted, COUNTED)
    return found.withColumnRenamed("id", id_col)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
