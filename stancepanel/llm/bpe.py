"""Byte-pair merging of many pre-tokens at once.

Pre-tokens are held as one ragged array: symbol ids in a row, and the number of the pre-token each belongs to. A round
finds the rank of every adjacent pair, the lowest rank of each pre-token, and merges all pairs of that rank in all
pre-tokens together. A pair made by a merge has a higher rank than the merge, so this gives the result of merging one
pair at a time.
"""

from __future__ import annotations

import json

import numpy as np

NEVER = np.iinfo(np.int64).max
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class RankMerger:
    """Merges of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_characters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.made = made
        self._hash(keys)

    def _hash(self, keys: np.ndarray) -> None:
        """An open-addressing table from pair to rank, four times as large as it needs to be."""
        self.bits = int(4 * len(keys) + 1).bit_length()
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, NEVER, np.int64)
        rank, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(rank):  # every free slot takes the first pair that asks for it, the others go one slot on
            self.probes += 1
            free = self.slot_key[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            who = rank[free][first]
            self.slot_key[taken], self.slot_rank[taken] = keys[who], who
            left = ~np.isin(rank, who)
            rank, slot = rank[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (pair.astype(np.uint64) * SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, pair: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER for pairs that do not merge."""
        slot = self._slot(pair)
        held = self.slot_key[slot]
        rank = np.where(held == pair, self.slot_rank[slot], NEVER)
        open_ = np.flatnonzero((held != pair) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot_ = slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[slot_]
            hit = held == pair[open_]
            rank[open_[hit]] = self.slot_rank[slot_[hit]]
            open_ = open_[~hit & (held >= 0)]
        return rank

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens in a row, and the number of ids of each. Pre-tokens are not empty."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.inner[flat]
        last = np.cumsum(lengths) - 1
        ids[last] = self.final[flat[last]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), NEVER)
            if len(ids) > 1:
                pair = np.where(owner[:-1] == owner[1:], ids[:-1] * self.base + ids[1:], -2)
                rank[:-1] = self.lookup(pair)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, len(ids)])
            open_ = np.repeat(lowest != NEVER, sizes)
            if not open_.all():
                done_ids.append(ids[~open_])
                done_owner.append(owner[~open_])
                lowest = np.repeat(lowest, sizes)[open_]
                ids, owner, rank = ids[open_], owner[open_], rank[open_]
            else:
                lowest = np.repeat(lowest, sizes)
            if not len(ids):
                break
            hit = rank == lowest
            chained = np.flatnonzero(hit[1:] & hit[:-1])
            if len(chained):  # x x x: the pairs overlap; every other one of such a run merges, from its left end
                place = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
                hit &= (place - start) % 2 == 0
            ids[hit] = self.made[rank[hit]]
            keep = np.r_[True, ~hit[:-1]]
            ids, owner = ids[keep], owner[keep]
        if not done_ids:
            return ids, np.bincount(owner, minlength=len(pieces))
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))
