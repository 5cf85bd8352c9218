"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Tasks tokenise their documents, cut those longer than a sequence and best-fit the pieces they have. Nearly
full bins are final. The others go up a tree: tasks that share a parent hand it their underfull bins as
items of another best-fit round (whole, or taken apart into their pieces where that makes fewer bins, or as many
and leaves one of them emptier), until one task has what is left of all. Texts are not moved; a bin is the
list of its pieces, which is never longer than the sequence has tokens.

A task holds at most about block pieces or bins at a time. Where more underfull bins are left than that, a round has
several tasks; they are dealt anew as long as that makes at least one bin in 200 less. Then what cannot take even the
least filled bin is final; since best fit leaves each task one bin at most that is half full or less, these few meet
in one task, together with as many of the fullest bins, and so on until no two bins that are left fit into one.

Defined results: null and empty texts are the end token alone; a null id is an id like any other; repeated
rows are packed as often as they occur; an empty table gives an empty result. Only the two named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import written
from maploom.llm.word_bpe import WordBpe

PIECE = pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64())])
BIN = pa.schema([("sequence_id", pa.int64()), ("node", pa.int64()), ("fill", pa.int32()), ("pieces", pa.list_(PIECE))])
BIN_SQL = "sequence_id long, node long, fill int, pieces array<struct<id: long, piece: int, start: long, length: int, crc: long>>"
TEXT_BYTES = 1 << 20
_encoders: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest items first, each into the fullest bin that has room for it."""
    bins = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r of rooms: a bin with room r is open
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, made
            made += 1
        bins[item] = own
        left = room - size
        open_bins[left].append(own)
        rooms |= 1 << left
    return bins


def _gather(lists: pa.ListArray, sizes: np.ndarray, capacity: int, round_no: int, node: int) -> pa.RecordBatch:
    """Best-fits items, each a list of pieces, and joins the lists that share a bin."""
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    joined = lists.take(pa.array(order))
    ends = np.concatenate(([0], np.cumsum(joined.value_lengths().to_numpy(zero_copy_only=False))))
    last = np.flatnonzero(np.append(np.diff(bins[order]) != 0, True)) + 1 if len(order) else np.zeros(0, np.int64)
    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends[last])), pa.int32()), joined.flatten())
    fill = np.bincount(bins, weights=sizes).astype(np.int32) if len(bins) else np.zeros(0, np.int32)
    names = (np.int64(round_no) << 57) + (np.int64(node) << 24) + np.arange(len(fill))
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(fill), node, np.int64)), pa.array(fill), pieces], schema=BIN)


def _leaves(path: str, capacity: int, end_id: int, block: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, blocks = encoder(path), TaskContext.get().partitionId(), 0
        ids, numbers, starts, lengths, sums = [], [], [], [], []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())]
            single = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(PIECE)))
            out = _gather(single, np.array(lengths, np.int64), capacity, 0, (blocks << 20) + task)
            for column in (ids, numbers, starts, lengths, sums):
                column.clear()
            return out

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            own, texts, size = [], [], 0
            for i in range(batch.num_rows):
                own.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py())
                size += len(texts[-1] or "")
                if size >= TEXT_BYTES or i + 1 == batch.num_rows:
                    yield from zip(own, bpe.encode(texts), strict=True)
                    own, texts, size = [], [], 0

        for batch in batches:
            for doc, tokens in encoded(batch):
                tokens += end
                for n, at in enumerate(range(0, len(tokens) // 4, capacity)):
                    part = tokens[4 * at : 4 * (at + capacity)]
                    ids.append(doc)
                    numbers.append(n)
                    starts.append(at)
                    lengths.append(len(part) // 4)
                    sums.append(crc32(part))
                if len(ids) >= block:
                    yield packed()
                    blocks += 1
        if ids:
            yield packed()

    return run


def _merge(capacity: int, round_no: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("sequence_id")
        lists, fill = table.column("pieces").combine_chunks(), table.column("fill").to_numpy()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        node = table.column("node")[0].as_py()
        whole = _gather(lists, fill.astype(np.int64), capacity, round_no, node)
        pieces = lists.flatten()
        single = pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1), pa.int32()), pieces)
        apart = _gather(single, pieces.field("length").to_numpy(zero_copy_only=False).astype(np.int64), capacity, round_no, node)
        rank = lambda b: (b.num_rows, min(b.column(2).to_pylist()))
        return pa.Table.from_batches([min(apart, whole, key=rank)])

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each piece, with its place in the sequence."""
    for batch in batches:
        lists = batch.column(1)
        pieces, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        length = pieces.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(length) - length
        first = (np.cumsum(counts) - counts)[counts > 0]
        offset = before - np.repeat(before[first], counts[counts > 0])
        owner = np.repeat(batch.column(0).to_numpy(), counts)
        yield pa.RecordBatch.from_arrays(
            [pieces.field("id"), pieces.field("piece"), pieces.field("start"), pa.array(length), pieces.field("crc"), pa.array(owner), pa.array(offset)],
            ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, spare: int = 4, fan_in: int = 8, block: int = 100_000
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    tokenizer is the path of a word-end BPE file. A bin is final once at most spare tokens are free in it, or once
    no other bin that is left fits into it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bins = written(rows.mapInArrow(_leaves(tokenizer, capacity, end_id, block), BIN_SQL))
    final, round_no = [bins.where(F.col("fill") >= capacity - spare)], 0
    rest, small = bins.where(F.col("fill") < capacity - spare), 2 * F.col("fill") <= capacity
    better, before = True, None
    while least := rest.agg(F.min("fill")).first()[0]:
        left, nodes = rest.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
        parents, apart = max(-(-nodes // fan_in), -(-left // block)), None
        round_no += 1
        if parents < nodes:
            grouped = rest.withColumn("node", F.pmod("node", F.lit(parents)))
        elif parents > 1 and better:  # tasks get other neighbours as long as that pays
            better, before = before is None or left < 0.995 * before, left
            grouped = rest.withColumn("node", F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(parents)))
        else:
            final.append(rest.where(F.col("fill") > capacity - least))
            live = rest.where(F.col("fill") <= capacity - least)
            left, half = live.agg(F.count(F.lit(1)), F.count_if(small)).first()
            if left < 2:
                final.append(live)
                break
            fullest = live.where(~small).orderBy(F.desc("fill"), "sequence_id").limit(block)
            apart = live.where(~small).join(fullest.select("sequence_id"), "sequence_id", "left_anti").select(live.columns)
            grouped = fullest.unionByName(live.where(small)).withColumn("node", F.pmod(F.xxhash64("sequence_id", F.lit(round_no)), F.lit(-(-half // block))))
        bins = written(grouped.groupBy("node").applyInArrow(_merge(capacity, round_no), BIN_SQL))
        final.append(bins.where(F.col("fill") >= capacity - spare))
        rest = bins.where(F.col("fill") < capacity - spare)
        rest = rest if apart is None else written(rest.unionByName(apart))
    out = final[0]
    for done in final[1:]:
        out = out.unionByName(done)
    placed = out.select("sequence_id", "pieces").mapInArrow(_placed, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op4_rows(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return op4_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
