import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from maploom.llm import simhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, most=4):
    root = list(range(len(ids)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 6, 50, 70_000]:
        text = rng.choice([" ", ""]) + " \t".join(rng.choice(["The", "cat", "É", "\xa0x", "sat"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint(None) == 0


def test_every_link_shares_a_viable_key():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 5)):
            b ^= 1 << bit
        x, seg = np.array([a ^ b], np.uint64), lambda v, n: v >> (8 * (n % 8)) & 255
        shared = [s for s in range(8) for c in simhash.CHAINS if all(seg(a, s + n) == seg(b, s + n) for n in c)]
        assert any(simhash.chain_viable(x, np.array([s]), 4)[0] for s in shared)


def near(rng, base, bits):
    for bit in rng.sample(range(64), bits):
        base ^= 1 << bit
    return base


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(400):
        prints.append(near(rng, rng.choice(prints), rng.randrange(0, 7)))
    dense = rng.getrandbits(64)
    prints += [near(rng, dense, rng.randrange(0, 4)) for _ in range(3000)]  # one key for thousands
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    at = {x: k for k, x in enumerate(signed)}
    u = np.array(prints, np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    want = simhash._roots(len(u), a, b)
    got = simhash._roots(len(u), np.array([at[x] for x, _ in edges]), np.array([at[y] for _, y in edges]))
    assert (want == got).all() and len(edges) < 40 * len(prints)


def documents(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.choice([1, 3, 4, 80, 300]))]
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = word()
            rows.append((100 + i, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, " \n"), (None, rows[0][1]), (None, "quite alone here"), (3, rows[5][1]), (3, rows[5][1])]


def test_components_equal_brute_force(spark):
    rows = documents(4)
    prints = [brute_print(t) for _, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_components([i for i, _ in rows], prints), strict=True)), key=str)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, salt int").repartition(5)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == want
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_long_chains(spark):
    from maploom.llm.components import components

    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1002, 1001), (-5, 1002)]
    random.Random(1).shuffle(edges)
    found = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(1, 201)} | {1000: -5, 1001: -5, 1002: -5}


def test_keys_of_too_many_prints_are_dealt_again(spark):
    rng = np.random.default_rng(9)
    free = rng.choice(1 << 40, 30_000, replace=False).astype(np.uint64)
    prints = np.concatenate([free, free[:300] ^ np.uint64(0b1011), free[300:600] ^ (np.uint64(1) << np.uint64(33))])  # the upper 24 bits are equal
    prints = np.unique(prints)
    edges = simhash.near_links(spark.createDataFrame([(int(x),) for x in prints], "fp long"), most=1 << 13).collect()
    root = {int(x): int(x) for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges:
        a, b = find(r.u), find(r.v)
        root[max(a, b)] = min(a, b)
    for x in prints[np.isin(prints, free[:600])].tolist():
        for near in (x ^ 0b1011, x ^ (1 << 33)):
            if near in root:
                assert find(x) == find(near)
    # brute force: what lies within 4 bits, by blocks
    groups = {}
    for k in range(0, len(prints), 512):
        a, b = np.nonzero(np.bitwise_count(prints[k : k + 512, None] ^ prints[None, :]) <= 4)
        for x, y in zip(prints[a + k].tolist(), prints[b].tolist(), strict=True):
            if x < y:
                groups.setdefault(x, []).append(y)
    assert all(find(x) == find(y) for x, ys in groups.items() for y in ys)
    pairs = sum(map(len, groups.values()))
    parts = len({find(int(x)) for x in prints})
    assert len(prints) - parts <= pairs
