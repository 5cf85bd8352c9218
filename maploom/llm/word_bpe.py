"""Byte-pair encoding with word ends, many words at once in numpy."""

from __future__ import annotations

import json

import numpy as np
import regex

CACHED = 400_000
NONE = np.int64(1) << 40
#: Text that normalisation changes letter by letter only; the rest goes to the tokenizer library.
PLAIN = regex.compile(r"[\n\x21-\x7e\xa1-ɏ]+")
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
#: Divides the ids of pieces; no id is as large.
DIVIDER = b"\xff" * 4


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """Encodes texts as the tokenizer file at path does, without added special tokens.

    Text is cut at ASCII white space, which no token crosses. A piece seen before comes from a cache of bounded
    size; all new pieces of a batch merge together, the lowest-ranked pair of each in every round.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = [vocab[a] << 20 | vocab[b] for a, b in pairs]
        self.bits = 18
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        for rank, (key, at) in enumerate(zip(keys, self._place(np.array(keys, np.int64)).tolist(), strict=True)):
            while self.keys[at] >= 0:
                at = (at + 1) % (1 << self.bits)
            self.keys[at], self.ranks[at] = key, rank
        self.cache: dict[bytes, bytes] = {}

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE if it never merges."""
        keys = a << 20 | b
        at = self._place(keys)
        rank, there = self.ranks[at], self.keys[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) % (1 << self.bits)
            there = self.keys[at[left]]
            rank[left] = self.ranks[at[left]]
            left = left[(there != keys[left]) & (there >= 0)]
        rank[self.keys[at] != keys] = NONE
        return rank

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit numbers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids, word = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        ids[np.cumsum(lengths) - 1] = self.final[flat[np.cumsum(lengths) - 1]]
        rank = np.full(len(ids), NONE)
        near = np.flatnonzero(word[:-1] == word[1:])
        rank[near] = self._rank(ids[near], ids[near + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            over = np.repeat(best == NONE, size)
            if over.any():
                done.append((word[over], ids[over]))
                live = ~over
                ids, word, rank, best, size = ids[live], word[live], rank[live], best[best != NONE], size[best != NONE]
                if not len(ids):
                    break
            hit = rank == np.repeat(best, size)
            if (hit[1:] & hit[:-1]).any():  # in a row of equal pairs every second one merges
                at = np.arange(len(hit))
                since = at - np.maximum.accumulate(np.where(hit, -1, at))
                hit &= since % 2 == 1
            at = np.flatnonzero(hit)
            ids[at] = self.merged[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for own in (moved, moved[(moved > 0)] - 1):
                more = own[own + 1 < len(ids)]
                same = word[more] == word[more + 1]
                rank[own] = NONE
                more = more[same]
                rank[more] = self._rank(ids[more], ids[more + 1])
        owner, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
        order = np.argsort(owner, kind="stable")
        buffer = ids[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [buffer[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Caches the ids of pieces; those of plain letters are cut and merged together."""
        text = b"\n".join(pieces).decode()
        if "<|" in text or not PLAIN.fullmatch(text):
            plain = [p for p in pieces if b"<|" not in p and PLAIN.fullmatch(p.decode())]
            for piece in set(pieces).difference(plain):
                self.cache[piece] = np.array(self.library.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            pieces, text = plain, b"\n".join(plain).decode()
        if not pieces:
            return
        parts = PARTS.findall(text.lower())
        names = list(set(parts) - {"\n"})
        ids = dict(zip(names, self.merge([n.encode() for n in names]), strict=True)) | {"\n": DIVIDER}
        self.cache.update(zip(pieces, b"".join([ids[p] for p in parts]).split(DIVIDER), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers; null counts as empty."""
        rows = [(t or "").encode().split() for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        self._learn(list(set().union(*rows) - self.cache.keys()))
        get = self.cache.__getitem__
        return [b"".join(map(get, row)) for row in rows]
