"""Where strings of a fixed length repeat: the candidate search of both substring operators.

A text is a sequence of units (bytes, or words) and a window is `length`
consecutive ones.  Every window is named by the first k-gram with the least hash in it, its
anchor; equal windows have equal anchors, and neighbouring windows mostly share one, so
a text is cut into runs of windows, about one for each length / 2 units.  Runs
of equal anchor and equal content repeat as a whole.  Runs of equal anchor and
different content may repeat in part: only their content travels to the shard of
the anchor, where an operator compares their windows by its own method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txrisk.llm.common import texts
from txrisk.session import materialise

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NO_ID = (1 << 63) - 1  # sorts null ids last


@dataclass(frozen=True)
class Units:
    """How a text falls into units.

    split: text -> list or bytes of units; hashes: units -> uint64 each; join: some units -> bytes.
    Runs of anchors with more than `hot` rows are compared window by window in Spark.
    """

    split: Callable[[str], object]
    hashes: Callable[[object], np.ndarray]
    join: Callable[[object], bytes]
    length: int
    gram: int
    hot: int = 50_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=U)
    powers[:1] = 1
    return np.cumprod(powers, dtype=U)


def prefixes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` units from each position on (0 where fewer are left)."""
    found = np.zeros(len(hashes), dtype=np.int64)
    if len(hashes) >= length:
        sums = np.zeros(len(hashes) + 1, dtype=U)
        np.cumsum(hashes * _powers(_BASE, len(hashes)), out=sums[1:])
        back = _powers(_INVERSE, len(hashes) - length + 1)
        found[: len(back)] = _mixed((sums[length:] - sums[:-length]) * back).view(np.int64)
    return found


def runs(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """first window, last window, anchor and content hash of every run of a text."""
    n = len(hashes) - length + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    sums = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=sums[1:])
    back = _powers(_INVERSE, len(hashes))

    def content(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * back[start])

    grams = _mixed((sums[gram:] - sums[:-gram]) * back[: len(hashes) - gram + 1])
    # half a hash and the place, so that the least one is the first of its kind in a window:
    # two windows of a run then differ in where their anchor lies, and cannot be equal
    least = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    wide, have = length - gram + 1, 1
    while have < wide:  # minimum over ever wider windows
        more = min(have, wide - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    anchor = grams[(least[first] & U(0xFFFFFFFF)).astype(np.int64)]
    return first, last, anchor.view(np.int64), content(first, last + length).view(np.int64)


def _pieces(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def numbered(docs: DataFrame) -> DataFrame:
    """doc, tag, text: doc is the id (nulls last), tag tells rows of one id apart (0 if ids are unique)."""
    frame = texts(docs).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text"
    )
    repeated = frame.groupBy("doc").count().filter("count > 1")
    if repeated.isEmpty():
        return frame.select("doc", F.lit(0).alias("tag"), "text")
    tag = F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1
    return materialise(frame.select("doc", tag.alias("tag"), "text"), "numbered")


def _anchored(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                found = [
                    runs(units.hashes(units.split(t)), units.length, units.gram)
                    for t in piece.column("text").to_pylist()
                ]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), pa.int64())
                first, last, anchor, content = (np.concatenate([f[i] for f in found]) for i in range(4))
                doc, tag = piece.column("doc").take(owner), piece.column("tag").take(owner)
                # a run that repeats an earlier one of the same piece is decided here
                order = np.lexsort([first, tag.to_numpy(), doc.to_numpy(), content, anchor])
                spread = np.zeros(len(order), dtype=np.int64)
                again = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1])
                spread[order[1:][again]] = first[order[1:][again]] + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        doc, tag, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                        pa.array(anchor.astype(np.int64)), pa.array(content.astype(np.int64)), pa.array(spread),
                    ],
                    names=["doc", "tag", "first", "last", "anchor", "content", "spread"],
                )

    return run


def _zipped(rows: DataFrame) -> DataFrame:
    """Texts compressed before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for piece in _pieces(batch):
                packed = [pack(t.encode()) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc"), piece.column("tag"), pa.array(packed, pa.binary())],
                    names=["doc", "tag", "packed"],
                )

    return rows.mapInArrow(run, "doc long, tag int, packed binary")


def marked(rows: DataFrame, units: Units) -> DataFrame:
    """For each text with repeats: doc, tag, runs (first, last, anchor, whole, hot).

    `whole` runs repeat earlier as they are; the others share their anchor with other content.
    Of equal runs each task sends one to their anchor; the rest, known to be whole, are spread.
    """
    found = rows.mapInArrow(
        _anchored(units), "doc long, tag int, first int, last int, anchor long, content long, spread long"
    )
    known = F.col("spread") != 0
    found = found.withColumn("part", F.when(known, F.xxhash64("doc", "spread")).otherwise(0))
    same = Window.partitionBy("anchor", "part")
    order = Window.partitionBy("anchor", "part", "content").orderBy("doc", "tag", "first")
    judged = (
        found.withColumn("place", F.row_number().over(order))
        .withColumn("rows", F.count("*").over(same))
        .filter((F.col("rows") > 1) | known)
        .withColumn("mixed", F.min("content").over(same) != F.max("content").over(same))
        .withColumn("whole", (F.col("place") > 1) | known)
        .filter("whole OR mixed")
    )
    run = F.struct("first", "last", "anchor", "whole", (F.col("rows") > units.hot).alias("hot"))
    return materialise(judged.groupBy("doc", "tag").agg(F.collect_list(run).alias("runs")), "marked")


def _cut(units: Units, hot: bool):
    """Content of the runs to compare: whole runs, or single windows of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece in _pieces(batch, 1_000_000):
                owner, start, anchor, cut = [], [], [], []
                columns = zip(piece.column("packed").to_pylist(), piece.column("runs").to_pylist(), strict=True)
                for i, (packed, found) in enumerate(columns):
                    parted = units.split(unpack(packed).decode())
                    for r in found:
                        if r["whole"] or r["hot"] != hot:
                            continue
                        ends = range(r["first"], r["last"] + 1) if hot else [r["first"]]
                        wide = units.length + (0 if hot else r["last"] - r["first"])
                        for at in ends:
                            owner.append(i)
                            start.append(at)
                            anchor.append(r["anchor"])
                            cut.append(units.join(parted[at : at + wide]))
                owner = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc").take(owner), piece.column("tag").take(owner),
                        pa.array(start, pa.int32()), pa.array(anchor, pa.int64()), pa.array(cut, pa.binary()),
                    ],
                    names=["doc", "tag", "start", "anchor", "cut"],
                )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor in tables of about `size` bytes that never part an anchor."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += batch.nbytes
        if have >= size:
            table = pa.Table.from_batches(held)
            anchors = table.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchors, anchors[-1]))
            if whole:
                yield table.slice(0, whole)
                held = table.slice(whole).combine_chunks().to_batches()
                have = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _resolved(compare: Callable, units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2_000_000):
            order = np.lexsort([table.column(c).to_numpy() for c in ("start", "tag", "doc")])
            table = table.take(pa.array(order))
            row, at = compare(table.column("cut").to_pylist(), table.column("doc").to_numpy(),
                              table.column("tag").to_numpy(), table.column("start").to_numpy())
            # neighbouring windows of a run as one stretch
            start = np.asarray(at, dtype=np.int64)
            row = np.asarray(row, dtype=np.int64)
            by = np.lexsort([start, row])
            row, start = row[by], start[by]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:] - 1, [len(row) - 1]])[: len(head)]
            owner, base = pa.array(row[head]), table.column("start").to_numpy()[row[head]]
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc").combine_chunks().take(owner), table.column("tag").combine_chunks().take(owner),
                    pa.array((base + start[head]).astype(np.int32)), pa.array((base + start[tail]).astype(np.int32)),
                ],
                names=["doc", "tag", "first", "last"],
            )

    return run


def later_windows(rows: DataFrame, flags: DataFrame, units: Units, compare: Callable) -> DataFrame:
    """doc, tag, spans (first and last window): every window of a text that also starts earlier.

    `compare(cuts, doc, tag, start)` gets the content of runs with the same anchors, sorted by
    place, and returns the (run, window in it) that are not the first of their content.
    """
    packed = _zipped(rows).join(flags, ["doc", "tag"])
    schema = "doc long, tag int, start int, anchor long, cut binary"
    cut = packed.mapInArrow(_cut(units, False), schema)
    sharded = cut.repartition("anchor").sortWithinPartitions("anchor")
    spans = sharded.mapInArrow(_resolved(compare, units), "doc long, tag int, first int, last int")
    every = flags.select("doc", "tag", F.explode("runs").alias("r"))
    whole = every.filter("r.whole").select("doc", "tag", "r.first", "r.last")
    found = whole.unionByName(spans)
    if not every.filter("r.hot and not r.whole").isEmpty():
        crowded = flags.filter(F.exists("runs", lambda r: r["hot"] & ~r["whole"]))
        windows = _zipped(rows).join(crowded, ["doc", "tag"]).mapInArrow(_cut(units, True), schema).withColumn("name", F.xxhash64("cut"))
        order = Window.partitionBy("name", "cut").orderBy("doc", "tag", "start")
        later = windows.withColumn("place", F.row_number().over(order)).filter("place > 1")
        found = found.unionByName(later.select("doc", "tag", F.col("start").alias("first"), F.col("start").alias("last")))
    return found.groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Stretches of units covered by windows, sorted, apart from each other."""
    ends = sorted((s["first"], s["last"] + length) for s in spans)
    kept: list[list[int]] = []
    for a, b in ends:
        if kept and a <= kept[-1][1]:
            kept[-1][1] = max(kept[-1][1], b)
        else:
            kept.append([a, b])
    return [(a, b) for a, b in kept]


def remove(docs: DataFrame, units: Units, compare: Callable, with_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_units, n_removed, n_spans, kept_sha256; with `with_text` also kept (binary).

    Null texts are empty.  Rows of one doc_id come in the order of their texts; null ids last, each
    with its own place.  An empty table gives no row.
    """
    rows = numbered(docs)
    spans = later_windows(rows, marked(rows, units), units, compare)
    joined = _zipped(rows).join(spans, ["doc", "tag"], "left")
    schema = "doc long, n_units long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for piece in _pieces(batch, 1_000_000):
                made = []
                columns = zip(piece.column("packed").to_pylist(), piece.column("spans").to_pylist(), strict=True)
                for packed, found in columns:
                    parted = units.split(unpack(packed).decode())
                    gone = merged(found or [], units.length)
                    edges = [0, *[x for span in gone for x in span], len(parted)]
                    kept = parted[:0]
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        kept = kept + parted[a:b]
                    body = units.join(kept)
                    row = (len(parted), sum(b - a for a, b in gone), len(gone), sha256(body).hexdigest())
                    made.append((*row, body) if with_text else row)
                names = ["n_units", "n_removed", "n_spans", "kept_sha256", "kept"][: len(made[0])]
                arrays = [pa.array(list(c)) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc"), *arrays], names=["doc", *names])

    found = joined.mapInArrow(run, schema + (", kept binary" if with_text else ""))
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return found.select(doc_id, *[c for c in found.columns if c != "doc"])
