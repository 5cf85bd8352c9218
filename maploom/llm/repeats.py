"""Removal of byte strings that an earlier document has, after the idea of prefix-free parsing.

A string of `length` bytes is repeated if it also starts in a document with a smaller id; every byte that such a
string covers goes. Matches never cross documents and are judged on the input.

Rolling-hash triggers cut texts into phrases: within each window of `length` bytes the 16-byte string of least
hash is a trigger, so that equal windows have equal triggers. A phrase is the stretch of text whose windows
share a trigger. The dictionary of a trigger is its distinct phrases; the parse is where they occur.

1. Tasks hash their texts (Karp-Rabin, all prefixes at once), find triggers, and compare the phrases that they
   have themselves: of equal ones only that of the smallest id goes on, the others are known to be repeated.
   So a passage in millions of documents is one row for each batch of text, not for each document.
2. (trigger, id, place) rows meet by trigger. A window holds, beside its trigger, half of what is left before
   it or after it; phrases that share neither half with another document (by 16-bit hashes, which may keep too
   much, never too little) end here.
3. For the others, phrases are cut from the texts and meet by trigger in the order of ids. Each block of them has a
   dictionary of distinct phrases and a parse, the phrase of each row. Prefix doubling sorts the dictionary's
   suffixes to the depth of a string, which makes runs of equal strings, bytes alone deciding; the parse brings the
   least id of a run back to the rows. Only the dictionary of one trigger is kept from block to block.
4. The covered stretches meet each text, which is read once more and cut.

The corpus order is (trigger, suffix to the depth of a string): a phrase is cut so that it holds all strings of its
trigger whole, so the order of parse suffixes, which tells apart what follows a phrase, decides nothing here.

Defined results: null texts count as empty; a null id is larger than any other, and null ids are one document
id; rows of the same id and different text are told apart by a 64-bit hash of the text; rows that repeat id and text
have the same result each; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import written

GRAM = 16
BATCH = 1 << 20
LAST = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers and those of its inverse modulo 2^64."""
    if not _powers:
        for base in BASES:
            pair = []
            for factor in (base, pow(base, -1, 1 << 64)):
                all_of = np.full(BATCH + 2048, factor, np.uint64)
                all_of[0] = 1
                pair.append(np.multiply.accumulate(all_of))
            _powers.append((pair[0], pair[1]))
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of data, by prefix sums in which byte i weighs base^-i."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        value = data.astype(np.uint64) + np.uint64(1)
        for _, inverse in powers():
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(value * inverse[: len(data)], out=sums[1:])
            self.sums.append(sums)

    def of(self, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, (up, _) = self.sums[base], powers()[base]
        return _mix((sums[end] - sums[start]) * up[start])

    def grams(self, width: int) -> np.ndarray:
        sums, (up, _) = self.sums[0], powers()[0]
        return _mix((sums[width:] - sums[:-width]) * up[: max(0, len(sums) - width)])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(texts: list[bytes], length: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: their hashes, and each phrase's trigger, text number, first and last window."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes, ends = Hashes(data), np.cumsum(sizes)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return hashes, none, none, none, none
    grams = hashes.grams(GRAM)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
    trigger = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    window = np.flatnonzero(np.arange(len(trigger)) + length <= ends[owner[: len(trigger)]])
    trigger, owner = trigger[window], owner[window]
    if not len(window):
        return hashes, none, none, none, none
    first = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(first[1:], len(window)) - 1
    return hashes, trigger[first], owner[first], window[first], window[last]


def repeated_here(hashes: Hashes, ids: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Phrases equal to one of a smaller id; ids must be in ascending order."""
    a, b = hashes.of(0, first, last + length), hashes.of(1, first, last + length)
    order = np.argsort(a, kind="stable")
    a, b, size = a[order], b[order], (last - first)[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (size[1:] != size[:-1])))[: len(a)]
    least = ids[order[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(a) else ids
    out = np.zeros(len(a), bool)
    out[order] = ids[order] > least
    return out


def stretches(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of owners in ascending order of start, joined where they touch or overlap."""
    if not len(owner):
        return owner, start, end
    reach = np.maximum.accumulate(end + owner * (LAST >> 20)) - owner * (LAST >> 20)
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1]))))
    return owner[new], start[new], reach[np.append(new[1:], len(owner)) - 1]


#: n: of a phrase, 8 bits each for its windows after the first and for where its trigger begins, 16 bits each for
#: the hashes of what stands before and after the trigger; of a stretch known to be repeated, its negative length.
PLACE_SQL = "h long, id long, th long, start long, n long"
SPAN_SQL = PLACE_SQL + ", span binary"
PLACE = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
KEPT_SQL = "id long, th long, start long, n long"
KEPT = pa.schema([PLACE.field(c) for c in ("id", "th", "start", "n")])
SPAN = PLACE.append(pa.field("span", pa.binary()))


def _segments(ids: np.ndarray, texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in batches of about BATCH bytes, ids ascending; long texts overlap where they are cut."""
    out: list[tuple[int, int, bytes]] = []
    size = 0
    for row in np.argsort(ids, kind="stable").tolist():
        text, step = texts[row], BATCH - length
        for at in range(0, max(1, len(text) - length + 1), step):
            part = text[at : at + step + length - 1]
            if size + len(part) > BATCH and out:
                yield out
                out, size = [], 0
            out.append((row, at, part))
            size += len(part)
    if out:
        yield out


def _rows(columns: list[np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _known(ids: np.ndarray, ths: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Columns for stretches found here; spread by a hash of their place."""
    order = np.lexsort((start, rows))
    rows, start, end = stretches(rows[order], start[order], end[order])
    h = _mix((ids[rows].astype(np.uint64) << np.uint64(20)) ^ start.astype(np.uint64)).view(np.int64)
    return [h, ids[rows], ths[rows], start, start - end]


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            for part in _segments(ids, texts, length):
                row, at = np.array([p[0] for p in part]), np.array([p[1] for p in part])
                base = np.cumsum([0, *(len(p[2]) for p in part[:-1])])
                hashes, trigger, own, first, last = phrases([p[2] for p in part], length)
                known = repeated_here(hashes, ids[row[own]], first, last, length)
                place = at[own] - base[own]
                new = ~known
                h, n = hashes.of(0, trigger, trigger + GRAM).view(np.int64), _described(hashes, trigger, first, last, length)
                yield _rows([h[new], ids[row[own[new]]], ths[row[own[new]]], (place + first)[new], n[new]], PLACE)
                if known.any():
                    yield _rows(_known(ids, ths, row[own[known]], (place + first)[known], (place + last)[known] + length), PLACE)

    return run


def _described(hashes: Hashes, trigger: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    half = (length - GRAM) // 2

    def side(there: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(there), np.int64)
        value = hashes.of(1, start[there], end[there]) >> np.uint64(48)
        out[there] = np.maximum(value, np.uint64(1)).astype(np.int64)
        return out

    # a window begins at least half before its trigger, or it reaches more than half beyond
    before = side(first <= trigger - half, trigger - half, trigger + GRAM)
    after = side(last > trigger - half, trigger, trigger + GRAM + half)
    return (last - first) | (trigger - first) << 8 | before << 16 | after << 32


def _of_several(h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which rows share their trigger, and what stands before or after it, with another id; known ones too."""
    keep = n < 0
    for shift in (16, 32):
        side = (n >> shift) & 0xFFFF
        rows = np.flatnonzero((side > 0) & (n >= 0))
        key = _mix(h[rows].view(np.uint64) + (side[rows].astype(np.uint64) << np.uint64(40)))
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
        if len(first):
            own = ids[rows]
            several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
            keep[rows[np.repeat(several, np.diff(np.append(first, len(key))))]] = True
    return keep


def _shared(most: int = 1 << 20):
    """Rows sorted by h to those that may be shared. Of an h with more than most rows all count as shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, passing = 0, None

        def chosen(table: pa.Table, every: bool = False) -> Iterator[pa.RecordBatch]:
            h, ids, n = (table.column(c).to_numpy() for c in ("h", "id", "n"))
            keep = np.ones(len(h), bool) if every else _of_several(h, ids, n)
            columns = [table.column(c).combine_chunks().filter(pa.array(keep)) for c in ("id", "th", "start")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.where(n < 0, n, n & 0xFFFF)[keep])], schema=KEPT)

        for batch in batches:
            h = batch.column(0).to_numpy()
            if len(h) and passing is not None:
                stop = int(np.searchsorted(h != passing, True))
                yield from chosen(pa.Table.from_batches([batch.slice(0, stop)]), True)
                batch, h = batch.slice(stop), h[stop:]
            if not len(h):
                continue
            passing = None
            tail = int(np.flatnonzero(h == h[-1])[0])
            if held and (tail or held[-1].column(0)[0].as_py() != h[0]):
                yield from chosen(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held, size = [], 0
            elif tail:
                yield from chosen(pa.Table.from_batches([batch.slice(0, tail)]))
            held.append(batch.slice(tail))
            size += len(h) - tail
            if size > most:
                yield from chosen(pa.Table.from_batches(held), True)
                held, size, passing = [], 0, h[-1]
        if held:
            yield from chosen(pa.Table.from_batches(held))

    return run


def _cut(length: int):
    """Rows (id, th, text, places) to the phrases at places, equal ones of a batch decided at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, lists = batch.column(2), batch.column(3)
            order, size, group = np.argsort(ids, kind="stable").tolist(), 0, []
            for k, row in enumerate(order):
                group.append(row)
                size += len(lists[row])
                if size >= 1 << 13 or k + 1 == len(order):
                    yield from cut(group, ids, ths, texts, lists)
                    group, size = [], 0

    def cut(group, ids, ths, texts, lists) -> Iterator[pa.RecordBatch]:
        spans: list[bytes] = []
        rows, starts, sizes, offsets = [], [], [], []
        for row in group:
            text, own = (texts[row].as_py() or "").encode(), lists[row].values
            start, n = (own.field(c).to_numpy() for c in ("start", "n"))
            offsets.append(n >> 8)
            n = n & 0xFF
            spans += [text[a:b] for a, b in zip(start.tolist(), (start + n + length).tolist(), strict=True)]
            rows.append(np.full(len(start), row))
            starts.append(start)
            sizes.append(n)
        row, start, n, offset = (np.concatenate(x) for x in (rows, starts, sizes, offsets))
        for a in range(0, len(row), 1 << 13):  # as many phrases as the powers suffice for
            cut_one = slice(a, a + (1 << 13))
            own = spans[cut_one]
            base = np.cumsum([0, *(len(x) for x in own[:-1])])
            r, s, m = row[cut_one], start[cut_one], n[cut_one]
            hashes, trigger = Hashes(np.frombuffer(b"".join(own), np.uint8)), base + offset[cut_one]
            known = repeated_here(hashes, ids[r], base, base + m, length)
            new, h = ~known, hashes.of(0, trigger, trigger + GRAM).view(np.int64)
            yield _rows([h[new], ids[r[new]], ths[r[new]], s[new], m[new], [own[k] for k in np.flatnonzero(new).tolist()]], SPAN)
            if known.any():
                columns = _known(ids, ths, r[known], s[known], (s + m)[known] + length)
                yield _rows([*columns, pa.nulls(len(columns[0]), pa.binary())], SPAN)

    return run


def _ranks(codes: np.ndarray) -> np.ndarray:
    """Numbers from 0 that order codes, equal ones alike."""
    return np.unique(codes, return_inverse=True)[1]


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """For each place of data with length bytes from there on, the rank of these bytes among all places: the order of
    data's suffixes to that depth, by prefix doubling. Places of one rank are a run whose common prefix is that long."""
    n = len(data) - 7
    wide = np.zeros(n, np.uint64)
    for k in range(8):
        wide = wide << np.uint64(8) | data[k : k + n]
    rank, depth = _ranks(wide), 8
    while depth < length:
        step = min(depth, length - depth)
        ahead = rank[step:]
        rank = _ranks(rank[: len(ahead)] * np.int64(len(rank) + 1) + ahead)
        depth += step
    return rank


def _resolve(length: int, least_rows: int):
    """Phrases sorted by h and id to the stretches of them that a smaller id has.

    A block of rows has a dictionary (its distinct phrases, each with the least id that has it) and a parse (which phrase
    a row is). The order of the dictionary's suffixes puts equal strings of length bytes into runs; the least id of a
    run, brought back through the parse, decides which of a row's strings go. Where a trigger goes on in the next block,
    its dictionary does as well.
    """
    out_schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])

    def decided(rows: pa.Table, carried: list[tuple[bytes, int]]) -> tuple[pa.RecordBatch, list[tuple[bytes, int]]]:
        h, ids, spans = rows.column("h").to_numpy(), rows.column("id").to_numpy(), rows.column("span").to_pylist()
        number: dict[bytes, int] = {}
        least: list[int] = []
        for span, own in carried:
            number[span] = len(least)
            least.append(own)
        parse = np.empty(len(spans), np.int64)
        for k, (span, own) in enumerate(zip(spans, ids.tolist(), strict=True)):
            at = number.setdefault(span, len(least))
            if at == len(least):  # ids ascend within a trigger: the first is the least
                least.append(own)
            parse[k] = at
        words, first = list(number), np.array(least, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = sizes - length + 1
        rank = suffix_ranks(np.frombuffer(b"".join(words), np.uint8), length)
        owner = np.repeat(np.arange(len(words)), counts)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        rank = rank[(np.cumsum(sizes) - sizes)[owner] + step]
        best = np.full(int(rank.max()) + 1, LAST)
        np.minimum.at(best, rank, first[owner])
        hit = np.flatnonzero(best[rank] < first[owner])
        word, start, end = stretches(owner[hit], step[hit], step[hit] + length)
        # rows of a larger id than their phrase's least go whole, the others by the stretches of the phrase
        later = np.flatnonzero(ids > first[parse])
        early = np.flatnonzero(ids == first[parse])
        begin, stop = np.searchsorted(word, parse[early]), np.searchsorted(word, parse[early], side="right")
        each = np.repeat(early, stop - begin)
        pick = np.repeat(begin, stop - begin) + np.arange(len(each)) - np.repeat(np.cumsum(stop - begin) - (stop - begin), stop - begin)
        row = np.concatenate((later, each))
        place = rows.column("start").to_numpy()[row] + np.concatenate((np.zeros(len(later), np.int64), start[pick]))
        size = np.concatenate((sizes[parse[later]], (end - start)[pick]))
        goes_on = dict.fromkeys(parse[h == h[-1]].tolist())
        if len(h) and h[0] == h[-1]:
            goes_on = dict.fromkeys([*range(len(carried)), *goes_on])
        return _rows([ids[row], rows.column("th").to_numpy()[row], place, size], out_schema), [(words[k], least[k]) for k in goes_on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        carried: list[tuple[bytes, int]] = []
        size, last_h = 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held, size, carried, last_h
            table = pa.Table.from_batches(held).combine_chunks()
            if last_h != table.column("h")[0].as_py():
                carried = []
            out, carried = decided(table, carried)
            held, size, last_h = [], 0, table.column("h")[-1].as_py()
            return out

        for whole in batches:
            n = whole.column(4).to_numpy()
            known = whole.filter(pa.array(n < 0))
            if known.num_rows:
                yield _rows([known.column(1), known.column(2), known.column(3), -known.column(4).to_numpy()], out_schema)
            open_rows = whole.filter(pa.array(n >= 0))
            for at in range(0, open_rows.num_rows, least_rows):
                held.append(open_rows.slice(at, least_rows))
                size += held[-1].num_rows
                if size >= max(least_rows, len(carried)):
                    yield flush()
        if held:
            yield flush()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, stretches) to sizes, the kept bytes and their digest."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for row in range(batch.num_rows):
            text = (batch.column(1)[row].as_py() or "").encode()
            spans: list[int] = []
            removed, at, digest = 0, 0, sha256()
            if batch.column(2)[row].is_valid:
                own = batch.column(2)[row].values
                start, size = own.field("start").to_numpy(), own.field("size").to_numpy()
                order = np.argsort(start, kind="stable")
                _, start, end = stretches(np.zeros(len(start), np.int64), start[order], (start + size)[order])
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    digest.update(text[at:a])
                    removed, at = removed + b - a, b
                    spans += [a, b]
            digest.update(text[at:])
            for column, value in zip(columns, (batch.column(0)[row].as_py(), len(text), removed, len(spans) // 2, digest.hexdigest(), spans), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_rows: int = 1 << 13) -> DataFrame:
    """Per row its id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start and end of each removed run, in turn).

    block_rows: how many phrases a task sorts at a time, at least; it changes no result.
    """
    if not GRAM <= length <= 64:
        raise ValueError(f"length must be from {GRAM} to 64")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))  # tells rows of one id apart
    places = rows.select("id", "th", "text").mapInArrow(_find(length), PLACE_SQL)
    shared = written(places.repartition("h").sortWithinPartitions("h", "id").mapInArrow(_shared(), KEPT_SQL))
    # sets, for rows that repeat an id and its text have the same places
    asked = shared.where("n >= 0").groupBy("id", "th").agg(F.collect_set(F.struct("start", "n")).alias("places"))
    spans = rows.select("id", "th", "text").join(asked, ["id", "th"]).select("id", "th", "text", "places").mapInArrow(_cut(length), SPAN_SQL)
    found = written(spans.repartition("h").sortWithinPartitions("h", "id").mapInArrow(_resolve(length, block_rows), "id long, th long, start long, size long"))
    known = shared.where("n < 0").select("id", "th", "start", (-F.col("n")).alias("size"))
    cuts = found.unionByName(known).groupBy("id", "th").agg(F.collect_set(F.struct("start", "size")).alias("cuts"))
    out = rows.join(cuts, ["id", "th"], "left").select("doc", "text", "cuts").mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return out.withColumnRenamed("id", id_col)


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
