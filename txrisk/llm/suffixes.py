"""Suffix-array deduplication: repeated byte strings by distributed prefix doubling.

Ordering all positions of a corpus by their suffixes would move each of them
through several shuffles.  Positions that cannot repeat go first: a string of
`length` bytes is named by its anchor, and only runs whose anchor occurs with
other content are compared (see `repeats`).  Spark deals those out by anchor and sorts them;
equal strings meet in one shard.  There, positions get the rank of their
first bytes, and pairs of ranks at growing offsets are sorted and ranked anew.  A
window leaves once a rank in it is unique; those that reach the threshold with a
shared rank repeat, and all but the first by place are removed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm import repeats
from txrisk.llm.repeats import prefixes


def _byte_hashes(raw: bytes) -> np.ndarray:
    table = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    table ^= table >> np.uint64(32)
    return table[np.frombuffer(raw, dtype=np.uint8)]


def bytes_of(length: int) -> repeats.Units:
    return repeats.Units(
        split=lambda text: text.encode(), hashes=_byte_hashes, join=bytes, length=length, gram=min(16, length)
    )


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of values by sorting, and how often each rank occurs."""
    order = np.argsort(values)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = values[order][1:] != values[order][:-1]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, np.diff([*np.flatnonzero(fresh), len(order)])


def steps(length: int) -> list[int]:
    """Lengths that ranks stand for, each at most twice the one before; the first is hashed."""
    found = [length]
    while found[0] > 8 and len(found) < 4:
        found.insert(0, -(-found[0] // 2))
    return found


def doubling(length: int):
    """Compares byte strings by prefix doubling; see `repeats.later_windows`."""
    lengths = steps(length)

    def compare(cuts: list[bytes], doc, tag, start) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(c) for c in cuts])
        hashes = _byte_hashes(b"".join(cuts))
        base = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        run = np.repeat(np.arange(len(cuts)), counts)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        active = base[run] + inside  # the windows that may still repeat
        # where in a window the strings of each step begin
        offsets = [[0]]
        for short, long in zip(lengths[-2::-1], lengths[:0:-1], strict=True):
            offsets.insert(0, sorted({o + x for o in offsets[0] for x in (0, long - short)}))
        rank = prefixes(hashes, lengths[0])
        have = 0
        for now, at in zip(lengths, offsets, strict=True):
            wanted = np.zeros(len(hashes), dtype=bool)
            for o in at:
                wanted[active + o] = True
            places = np.flatnonzero(wanted)
            # a pair of ranks at a distance names the longer string; sorting the pairs ranks it
            pair = rank[places] if not have else rank[places] * top + rank[places + now - have]
            found, times = _ranked(pair)
            top, have = len(times), now
            rank = np.zeros(len(hashes), dtype=np.int64)
            rank[places] = found
            keep = np.ones(len(active), dtype=bool)
            for o in at:
                keep &= times[rank[active + o]] > 1
            active, run, inside = active[keep], run[keep], inside[keep]
            if not len(active):
                return run, inside
        # of equal windows the first by document, tag and start stays
        order = np.lexsort([start[run] + inside, tag[run], doc[run], rank[active]])
        later = np.zeros(len(order), dtype=bool)
        later[order[1:]] = rank[active][order][1:] == rank[active][order][:-1]
        return run[later], inside[later]

    return compare


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """Removes every byte that a string of `length` bytes covers which also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left); see `repeats.remove`
    for nulls, repeated rows and ties.
    """
    found = repeats.remove(docs, bytes_of(length), doubling(length), with_text)
    return found.withColumn("n_bytes", F.col("n_units")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])
    )
