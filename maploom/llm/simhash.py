"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits on a ring of eight 8-bit segments. If two fingerprints differ in at most 4 bits,
some segment starts a chain whose every prefix of n segments differs in at most n * 4 / 8 bits (the ring form
of the pigeonhole principle). So along the first five segments of the chain the differences add up to at most
0, 1, 1, 2, 2: segment 0 is equal, and two of the next four are, one of them next or second. The equal ones
make 24-bit keys, five for each of the eight starts; every link shares one. Fingerprints are dealt by key;
pairs of a key pass the chain test, then the full Hamming test. A key of too many prints for one task is dealt
again by more of its bits: of five parts of those that are left, linked prints share one.

Copies are no pairs: rows of one fingerprint are one vertex. Tasks return a star for each set of linked
fingerprints they see, at most a row for each row read, and star contraction joins these into components.

Defined results: null texts count as empty; texts without words have fingerprint zero; a null id is larger
than any other; repeated rows are rows of one component, and drop_near_duplicates leaves one row of each; an
empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from maploom.llm.components import components
from maploom.llm.shared import row_salt, salt_of, salted_group, written

SEED = 42
#: Segments of a chain that a key takes, counted from its start.
CHAINS = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4))
BLOCK = 1024
SMALL = 64


def fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    bits, values = np.zeros(64, np.int64), np.array(hashes, dtype="<u8")
    for k in range(0, len(values), 1 << 15):
        bits += np.unpackbits(values[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp, x) of every row; fp holds the 64 bits as a long, x is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), batch.column(2)], ["id", "fp", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("x"))
    return rows.mapInArrow(run, "id long, fp long, x long")


def chain_viable(x: np.ndarray, start: np.ndarray, max_diff: int, length: int = 5) -> np.ndarray:
    """Of XORed fingerprints, those whose chain from segment start keeps within the budget of each prefix."""
    turn = (8 * start).astype(np.uint64)
    y = (x >> turn) | (x << ((np.uint64(64) - turn) % np.uint64(64)))
    y = y - ((y >> np.uint64(1)) & np.uint64(0x5555555555555555))
    y = (y & np.uint64(0x3333333333333333)) + ((y >> np.uint64(2)) & np.uint64(0x3333333333333333))
    y = (y + (y >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)
    sums = y * np.uint64(0x0101010101010101)  # byte n holds the bits of segments 0 to n
    budget = sum((0x80 + (n + 1) * max_diff // 8) << (8 * n) for n in range(8))
    high = sum(0x80 << (8 * n) for n in range(length))
    return ((np.uint64(budget) - sums) & np.uint64(high)) == np.uint64(high)


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The least vertex linked to each of 0 to n - 1, given edges a, b and earlier roots."""
    root = np.arange(n) if root is None else root
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _dense_roots(fps: np.ndarray, start: int, max_diff: int) -> np.ndarray:
    """Roots within one large key of a chain from start (-1: any); blocks that are linked throughout need no further test."""
    n, root = len(fps), None
    if n > 2 * BLOCK:  # fps are sorted: neighbours at one bit first
        for bit in range(64):
            other = fps ^ np.uint64(1 << bit)
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.flatnonzero(fps[at] == other)
            root = _roots(n, hit, at[hit], root)
    root = np.arange(n) if root is None else root
    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            ri, rj = root[i : i + BLOCK], root[j : j + BLOCK]
            if (ri == ri[0]).all() and (rj == ri[0]).all():
                continue
            x = fps[i : i + BLOCK, None] ^ fps[None, j : j + BLOCK]
            p, q = np.nonzero(chain_viable(x, np.array(start), max_diff) if start >= 0 else np.bitwise_count(x) <= max_diff)
            near = np.bitwise_count(x[p, q]) <= max_diff
            root = _roots(n, i + p[near], j + q[near], root)
    return root


def _links(keys: np.ndarray, fps: np.ndarray, starts: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole keys, sorted by key and fingerprint: edges that connect what is linked within a key.

    starts: the segment in which the key's chain begins, -1 where the key was dealt again.
    """
    edge = np.flatnonzero(np.diff(keys)) + 1
    first, sizes = np.concatenate(([0], edge)), np.diff(np.concatenate(([0], edge, [len(keys)])))
    a, b = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    k, f, begin = keys[small], fps[small], starts[small]
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        i = np.flatnonzero(k[:-d] == k[d:])
        if not len(i):
            break
        if begin[0] >= 0:
            i = i[chain_viable(f[i] ^ f[i + d], begin[i], max_diff)]
        i = i[np.bitwise_count(f[i] ^ f[i + d]) <= max_diff]
        a.append(f[i])
        b.append(f[i + d])
    for at, size in zip(first[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = fps[at : at + size]
        root = _dense_roots(own, int(starts[at]), max_diff)
        moved = np.flatnonzero(root != np.arange(size))
        a.append(own[moved])
        b.append(own[root[moved]])
    return np.concatenate([*a, fps[:0]]), np.concatenate([*b, fps[:0]])


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("mask", pa.int64()), ("fp", pa.int64())])
LINKS_SQL = "u long, v long, mask long, fp long"


def chain_mask(chain: int) -> int:
    """The bits that a key of this number (start * len(CHAINS) + chain) holds equal."""
    start, own = divmod(chain, len(CHAINS))
    return sum(255 << (8 * ((start + n) % 8)) for n in CHAINS[own])


def further_masks(mask: int, max_diff: int) -> list[int]:
    """mask with each of max_diff + 1 parts of its free bits in turn: two prints that agree on mask and differ in at
    most max_diff bits agree on one of these."""
    free = [n for n in range(64) if not mask >> n & 1]
    parts = [free[len(free) * k // (max_diff + 1) : len(free) * (k + 1) // (max_diff + 1)] for k in range(max_diff + 1)]
    return [mask | sum(1 << n for n in part) for part in parts]


def _stars(max_diff: int, most: int, chain: bool):
    """Rows (key, fp), or (mask, kept, fp) where chain is false, sorted by their key, to links and what is dealt again.

    The prints of a key are compared at once, which takes memory for most of them. Those of a longer key are
    returned as they come, under the mask of the bits that they share, for a finer deal.
    """

    def star(keys: np.ndarray, fps: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        a, b = _links(keys, fps, starts, max_diff)
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _roots(len(names), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(names)))
        none = pa.nulls(len(moved), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(names[moved].view(np.int64)), pa.array(names[root[moved]].view(np.int64)), none, none], schema=LINKS)

    def again(masks: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(fps), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(masks), pa.array(fps.view(np.int64))], schema=LINKS)

    bits = np.array([chain_mask(n) for n in range(8 * len(CHAINS))], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of one key that may go on
        size, long_key = 0, None

        def flush(extra: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            masks, kept, fps = (np.concatenate(x) for x in zip(*held, *extra, strict=True))
            key = np.cumsum(np.concatenate(([0], (masks[1:] != masks[:-1]) | (kept[1:] != kept[:-1]))))
            return star(key, fps, (kept >> 24) // len(CHAINS) if chain else np.full(len(fps), -1))

        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column(0).to_numpy()
            if chain:
                kept, fps = first, batch.column(1).to_numpy().view(np.uint64)
                masks = bits[kept >> 24]
            else:
                masks, kept, fps = first, batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            edge = np.flatnonzero((masks[1:] != masks[:-1]) | (kept[1:] != kept[:-1])) + 1
            ends = np.append(edge, len(fps))
            same = lambda m, k: (masks[0], kept[0]) == (m, k)  # noqa: B023, E731
            at = 0
            if long_key is not None:
                if same(*long_key):
                    at = int(ends[0])
                    yield again(masks[:at], fps[:at])
                if at < len(fps) or not same(*long_key):
                    long_key = None
                if at == len(fps):
                    continue
            elif held and not same(held[0][0][0], held[0][1][0]):
                yield flush([])
                held, size = [], 0
            last = int(edge[-1]) if len(edge) and edge[-1] > at else at  # where the key begins that may go on
            whole = [(masks[at:last], kept[at:last], fps[at:last])] if last > at else []
            if whole:
                sizes = np.diff(np.concatenate(([at], edge[(edge > at) & (edge <= last)])))
                sizes[0] += size
                if (sizes > most).any():
                    own = [np.concatenate(x) for x in zip(*held, *whole, strict=True)]
                    big = np.repeat(sizes > most, sizes)
                    yield again(own[0][big], own[2][big])
                    held, whole = [], [tuple(x[~big] for x in own)]
                if held or len(whole[0][2]):
                    yield flush(whole)
                held, size = [], 0
            held.append((masks[last:], kept[last:], fps[last:]))
            size += len(fps) - last
            if size > most:
                long_key = (held[0][0][0], held[0][1][0])
                for m, _, f in held:
                    yield again(m, f)
                held, size = [], 0
        if held:
            yield flush([])

    return run


def _dealt_again(max_diff: int):
    """Rows (mask, fp) to one (mask, kept, fp) for each further mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            masks, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for mask in np.unique(masks).tolist():
                own = fps[masks == mask]
                if mask not in known:
                    known[mask] = further_masks(mask & ((1 << 64) - 1), max_diff)
                for new in known[mask]:
                    signed = np.uint64(new).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), signed)), pa.array(own & signed), pa.array(own)], ["mask", "kept", "fp"])

    return run


def near_links(prints: DataFrame, max_diff: int = 4, most: int = 1 << 14) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect the same sets as all links at most max_diff apart.

    Keys of more than most prints are dealt again by further bits, as often as it takes. That ends, for a key with
    so few free bits that it cannot have more prints is never dealt again; most is at least 2 ** 13.
    """
    if not 0 <= max_diff <= 4:
        raise ValueError("the keys cover up to 4 differing bits")
    part = lambda n: F.shiftrightunsigned("fp", 8 * (n % 8)).bitwiseAND(F.lit(255))
    keys = [
        F.lit((start * len(CHAINS) + n) << 24).cast("long") + part(start + c[0]) * 65536 + part(start + c[1]) * 256 + part(start + c[2])
        for start in range(8)
        for n, c in enumerate(CHAINS)
    ]
    # as unsigned numbers, in which the task searches
    sortable = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = prints.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition("key").sortWithinPartitions("key", sortable)
    found = written(dealt.mapInArrow(_stars(max_diff, max(most, 1 << 13), True), LINKS_SQL))
    links = found.where("u IS NOT NULL").select("u", "v")
    while not (hot := found.where("mask IS NOT NULL").select("mask", "fp")).isEmpty():
        finer = hot.mapInArrow(_dealt_again(max_diff), "mask long, kept long, fp long").repartition("mask", "kept").sortWithinPartitions("mask", "kept", sortable)
        found = written(finer.mapInArrow(_stars(max_diff, max(most, 1 << 13), False), LINKS_SQL))
        links = links.unionByName(found.where("u IS NOT NULL").select("u", "v"))
    return links


def _placed(docs: DataFrame, id_col: str, text_col: str, max_diff: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (id, fp, x, salt); nodes: the (fp, salt) that rows have; placed: each fp with its component's root and least row."""
    rows = written(fingerprints(docs, id_col, text_col)).withColumn("salt", row_salt("id"))
    own = F.struct(F.col("id").isNull().alias("nameless"), "id", "x")
    nodes = written(salted_group(rows, ["fp"], [F.min(own).alias("least")]))
    vertices = nodes.groupBy("fp").agg(F.min("least").alias("least"))
    roots = components(near_links(vertices.select("fp"), max_diff))
    placed = vertices.join(roots.hint("merge"), F.col("fp") == F.col("vertex"), "left")
    return rows, nodes.select("fp", "salt"), written(placed.select("fp", "least", F.coalesce("root", "fp").alias("root"), salt_of("fp").alias("salt")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = 4) -> DataFrame:
    """For each row its id, fingerprint (16 hex digits) and component_id, the least id that links reach."""
    rows, nodes, placed = _placed(docs, id_col, text_col, max_diff)
    ids = salted_group(placed, ["root"], [F.min("least").alias("least")])
    named = placed.drop("least").join(ids.hint("merge"), ["root", "salt"]).select("fp", F.col("least.id").alias("component_id"))
    found = rows.join(nodes.join(named.hint("merge"), "fp").hint("merge"), ["fp", "salt"])
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = 4) -> DataFrame:
    """Of each component one row that bears its least id, with all columns; where no row has an id, any one row."""
    _, _, placed = _placed(docs, id_col, text_col, max_diff)
    kept = placed.groupBy("root").agg(F.min("least").alias("least"))
    keys = ["_nameless", "_id", "_x"]
    own = F.col(id_col).cast("long")
    rows = docs.select(F.struct("*").alias("_row"), own.isNull().alias(keys[0]), F.coalesce(own, F.lit(0).cast("long")).alias(keys[1]), F.xxhash64(F.col(text_col).cast("string")).alias(keys[2]))
    kept = kept.select(F.col("least.nameless").alias(keys[0]), F.coalesce("least.id", F.lit(0).cast("long")).alias(keys[1]), F.col("least.x").alias(keys[2])).distinct()
    met = rows.join(kept.hint("merge"), keys, "left_semi")
    # rows that repeat an id and its text lie in one partition already
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_x"))).where("_n = 1")
    return first.select("_row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
