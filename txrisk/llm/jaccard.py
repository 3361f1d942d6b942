"""Exact n-gram Jaccard join as a blocked sparse matrix product.

The rows of the matrix are the distinct shingle sets, its columns the n-grams.

1. Sizes bound what two linked rows may differ in: at most (1 - t) / t of the smaller
   row.  The columns are cut into more blocks than that, so linked rows agree
   entirely in some block; only rows that share a whole block (its hash) can
   link.  Rows connected by such blocks form a candidate component.
2. Inside a candidate component the product of the matrix with its transpose is
   taken in blocks of rows and of columns.  Overlap counts accumulate over the
   column blocks, and a pair goes as soon as the columns left cannot lift it to
   the overlap that its sizes demand.
3. A task returns links enough to connect its rows, not all pairs; the
   components of the links are the classes.  Rows that the links of a first
   block of rows, the pivots, have brought together need not meet again: only rows
   outside the largest class of a component meet the others.

Equal sets are one row, so copies cost nothing; a large component is spread
over many tasks, each with two blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from txrisk.llm.common import give_back, per_row, texts
from txrisk.llm.graph import components
from txrisk.session import materialise

U = np.uint64


@dataclass(frozen=True)
class Settings:
    """Sets link if 100 * overlap >= percent * union.

    `growth` is the ratio of the size classes that share a cut into column
    blocks, `spare` the blocks beyond the bound (at least so many, and
    one for each `spare_part`) that let a row pass over its most frequent keys, `rows` and `columns` the blocks of the product.
    Block keys meet in buckets, one for each `bucket_chars` of text.
    """

    shingle: int = 3
    percent: int = 90
    growth: float = 1.25
    spare: int = 2
    spare_part: int = 10
    rows: int = 256
    columns: int = 4096
    bucket_chars: int = 8_000_000
    # Candidate rows of fixed width (some 100 bytes each) are broadcast to the texts up to so many, else both are shuffled.
    broadcast_rows: int = 200_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mixed(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=U)
    powers[:1] = 1
    return np.cumprod(powers, dtype=U)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word between ASCII white space, from running sums over the bytes."""
    units = np.frombuffer(raw, dtype=np.uint8)
    if not len(units):
        return np.zeros(0, dtype=U)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[units], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(units) + 1, dtype=U)
    np.cumsum(_BYTES[units] * _powers(_BASE, len(units)), out=sums[1:])
    return mixed((sums[end] - sums[start]) * _powers(_INVERSE, len(units))[start])


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text: lower-case A-Z, words between ASCII white space."""
    h = word_hashes(text.encode().lower())
    if not len(h):
        return h
    k = min(size, len(h))
    found = np.full(len(h) - k + 1, k, dtype=U)
    for i in range(k):
        found = (found ^ (found >> U(31))) * U(0x94D049BB133111EB) + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(found))


def size_classes(most: int, settings: Settings) -> np.ndarray:
    """Lower ends of the size classes, to beyond that of the largest row that can link to one of `most`."""
    ends = [1]
    while ends[-1] <= most * 100 / settings.percent * settings.growth**2 + 2:
        ends.append(max(ends[-1] + 1, int(ends[-1] * settings.growth)))
    return np.array(ends)


def most_apart(size: int, settings: Settings) -> int:
    """The most n-grams that lie in only one of two linked sets, the smaller of `size`."""
    return size * (100 - settings.percent) // settings.percent


def block_keys(found: np.ndarray, ends: np.ndarray, settings: Settings) -> tuple[np.ndarray, list[int]]:
    """Hashes of a row's column blocks, and how many of each cut may be passed over.

    A row is cut as for its own size class and for each larger one that may hold a linked row; the lowest
    byte of a key is the size class of the cut.  Linked rows agree in all but `most_apart` blocks of a cut.  Of
    the filled ones among these a row may pass over all but one, the same (most
    frequent) ones in every row.
    """
    n = len(found)
    if not n:
        return np.zeros(0, dtype=U), []
    kind = int(np.searchsorted(ends, n, side="right")) - 1
    place, value = mixed(found ^ U(0x5851F42D4C957F2D)), mixed(found + U(0x14057B7EF767814F))
    keys, spare = [], []
    while True:
        least = most_apart(int(ends[kind + 1]) - 1, settings) + 1
        blocks = least + max(settings.spare, least // settings.spare_part)
        block = place % U(blocks)
        order = np.argsort(block, kind="stable")
        filled, first = np.unique(block[order], return_index=True)
        salt = U(kind << 32)
        made = mixed(mixed(filled + salt) ^ np.add.reduceat(value[order], first))
        agree = len(filled) - most_apart(n, settings)
        if agree < 1:  # agreement may lie in empty blocks alone: they count, and none is passed over
            empty = np.setdiff1d(np.arange(blocks, dtype=U), filled)
            made = np.concatenate([made, mixed(mixed(empty + salt))])
        keys.append(made & ~U(0xFF) | U(kind & 0xFF))
        spare.append(max(agree - 1, 0))
        kind += 1
        if 100 * n < settings.percent * int(ends[kind]):
            return np.concatenate(keys), spare


def _describe(settings: Settings):
    def run(found: list[str]) -> dict[str, list]:
        sets = [shingles(t, settings.shingle) for t in found]
        ends = size_classes(max(map(len, sets), default=0), settings)
        return {
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "row": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "own": pa.array([int(np.searchsorted(ends, len(s), side="right")) - 1 for s in sets], pa.int32()),
            "spare": pa.array([block_keys(s, ends, settings)[1] for s in sets], pa.list_(pa.int32())),
        }

    return run


def _short(row: bytes) -> int:
    """The first 8 bytes of a row's name; a clash only makes two rows candidates."""
    return int.from_bytes(row[:8], "big", signed=True)


def _tiles(settings: Settings, buckets: int, keys: int = 1_000_000):
    """Block keys of a batch of rows, dealt to buckets by key, in tiles of 6 bytes of key and the row's short name."""

    def flush(held: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        key = np.concatenate(held)
        name = np.repeat(np.array(names, dtype=np.int64), [len(h) for h in held])
        bucket = ((key >> U(36)) % U(buckets)).astype(np.int64)
        order = np.lexsort([name, key, bucket])
        key, name, bucket = key[order], name[order], bucket[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, bucket = key[new], name[new], bucket[new]
        low, high = key.astype(np.uint32), (key >> U(32)).astype(np.uint16)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        spans = list(zip(first, [*first[1:], len(key)], strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[first].astype(np.int32)),
                *[pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, high, name)],
            ],
            names=["bucket", "low", "high", "names"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, have = [], [], 0
        ends = size_classes(1024, settings)
        for batch in batches:
            for text in batch.column("text"):
                found = shingles(text.as_py(), settings.shingle)
                if not len(found):
                    continue
                if len(found) * 100 / settings.percent * settings.growth**2 + 2 >= ends[-1]:
                    ends = size_classes(2 * len(found), settings)
                held.append(block_keys(found, ends, settings)[0])
                names.append(_short(xxhash.xxh3_128_digest(found.tobytes())))
                have += len(held[-1])
                if have >= keys:
                    yield flush(held, names)
                    held, names, have = [], [], 0
        if held:
            yield flush(held, names)

    return run


def _shared(tiles: pa.Table) -> pa.Table:
    """The keys of a bucket that several rows have: bucket, key, short, times."""
    low, high, name = (
        np.frombuffer(b"".join(tiles.column(c).to_pylist()), dtype=kind)
        for c, kind in (("low", np.uint32), ("high", np.uint16), ("names", np.int64))
    )
    key = low.astype(np.int64) | high.astype(np.int64) << 32
    order = np.lexsort([name, key])
    key, name = key[order], name[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name = key[new], name[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    times = np.repeat(np.diff([*first, len(key)]), np.diff([*first, len(key)]))
    many = times > 1
    bucket = np.full(int(many.sum()), tiles.column("bucket")[0].as_py(), dtype=np.int32)
    return pa.table({"bucket": bucket, "key": key[many], "short": name[many], "times": times[many].astype(np.int64)})


def candidates(frame: DataFrame, described: DataFrame, settings: Settings) -> DataFrame:
    """node (first 8 bytes of a row's name), root: the candidate components.

    A key that very many rows share says little, and chains rows together that cannot link; each row passes
    over as many of its most frequent keys as its bound allows.
    """
    size = frame.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(min(1 << 20, max(16, size // settings.bucket_chars)))
    tiles = frame.mapInArrow(give_back(_tiles(settings, buckets)), "bucket int, low binary, high binary, names binary")
    shared = tiles.groupBy("bucket").applyInArrow(_shared, "bucket int, key long, short long, times long")
    cut = F.col("key").bitwiseAND(0xFF).cast("int")
    most = Window.partitionBy("short", "cut").orderBy(F.desc("times"), F.desc("key"), F.desc("bucket"))
    allowed = described.filter("n > 0").groupBy("short").agg(F.min(F.struct("own", "spare")).alias("s"))
    kept = materialise(
        shared.withColumn("cut", cut)
        .withColumn("place", F.row_number().over(most))
        .join(allowed, "short")
        .filter(F.col("place") > F.get("s.spare", F.pmod(F.col("cut") - F.col("s.own"), F.lit(256))))
        .select("bucket", "key", "short"),
        "shared-keys",
    )
    centres = kept.groupBy("bucket", "key").agg(F.min("short").alias("centre"))
    return components(kept.join(centres, ["bucket", "key"]).select(F.col("short").alias("a"), F.col("centre").alias("b")))


def overlaps(
    left: list[np.ndarray], right: list[np.ndarray], settings: Settings
) -> np.ndarray:
    """Which rows of `left` link to which of `right`: the blocked product, with pairs dropped by their bounds."""
    names = np.concatenate([*left, *right])
    columns, number, times = np.unique(names, return_inverse=True, return_counts=True)
    number = number.reshape(-1)
    lengths = np.array([len(s) for s in [*left, *right]])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    shared = times[number] > 1
    owner, number = owner[shared], number[shared]
    a, b = lengths[: len(left)], lengths[len(left) :]
    # the least overlap o with 100 o >= percent (a + b - o)
    need = -(-settings.percent * (a[:, None] + b[None, :]) // (100 + settings.percent))
    alive = np.minimum(a[:, None], b[None, :]) >= need
    count = np.zeros(need.shape, dtype=np.int64)
    rest = np.bincount(owner, minlength=len(lengths))
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for first in range(0, len(columns), settings.columns):
        lo, hi = np.searchsorted(number, [first, first + settings.columns])
        alive &= count + np.minimum(rest[: len(a)][:, None], rest[len(a) :][None, :]) >= need
        if not alive.any():
            break
        block = np.zeros((len(lengths), settings.columns), dtype=np.float32)
        block[owner[lo:hi], number[lo:hi] - first] = 1
        count += (block[: len(a)] @ block[len(a) :].T).astype(np.int64)
        rest = rest - np.bincount(owner[lo:hi], minlength=len(lengths))
    return alive & (count >= need)


def _spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to keep connected what `links` connects; rows are numbered by left and right."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, j in zip(*np.nonzero(links), strict=True):
        x, y = find(int(left[i])), find(int(right[j]))
        if x != y:
            root[x] = y
            kept.append((int(left[i]), int(right[j])))
    return kept


def _multiply(settings: Settings):
    """Links enough between the rows on the left and those on the right of a block."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["row", "side"])
        rows, side = frame["row"].tolist(), frame["side"].to_numpy()
        sets = [np.asarray(s, dtype=np.int64).view(U) for s in frame["grams"]]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        links = overlaps([sets[k] for k in left], [sets[k] for k in right], settings)
        kept = [(rows[x], rows[y]) for x, y in _spanning(links, left, right)]
        return pd.DataFrame({"a": [x for x, _ in kept], "b": [y for _, y in kept]})

    return run


_BLOCK = ["root", "i", "j", "side", "row", "grams"]


def _product(blocks: DataFrame, settings: Settings) -> DataFrame:
    return blocks.groupBy("root", "i", "j").applyInPandas(_multiply(settings), "a binary, b binary")


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))


def _links(matrix: DataFrame, settings: Settings) -> DataFrame:
    """Links enough to keep connected all that links connect, within each candidate component.

    First the rows of one part, the pivots, meet all rows.  What they link becomes a
    class, and rows of one class need not meet again; so only rows outside the
    largest class of their component, few where it is made of near copies, then meet
    all others.  A component of one part is done after the first step.
    """
    part = F.pmod(F.xxhash64("row"), F.col("n_parts")).cast("int")
    placed = matrix.select("root", "n_parts", part.alias("part"), "row", "grams")
    rows = placed.select("root", F.col("part").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"), "row", "grams")
    pivots = placed.filter("part = 0").select("root", _each(F.col("n_parts")).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "row", "grams")
    first = materialise(_product(rows.unionByName(pivots), settings), "pivot-links")

    large = placed.filter("n_parts > 1")
    classes = components(first).select(F.col("node").alias("row"), F.col("root").alias("class"))
    named = large.select("root", "row").distinct().join(classes, "row", "left").select("root", "row", F.coalesce("class", "row").alias("class"))
    named = materialise(named, "pivot-classes")
    sizes = named.groupBy("root", "class").agg(F.count("*").alias("n"))
    most = sizes.groupBy("root").agg(
        F.max_by("class", F.struct("n", "class")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("in_largest")
    )
    outside = F.col("all") - F.col("in_largest")
    some = most.filter(outside > 0).select("root", "largest", F.ceil(outside / settings.rows).cast("int").alias("m_parts"))
    told = named.join(some, "root").select("row", "m_parts", (F.col("class") != F.col("largest")).alias("moves"))
    left = large.join(told, "row").withColumn("own", F.pmod(F.xxhash64("row", F.lit(1)), F.col("m_parts")).cast("int"))
    settled, movers = left.filter("not moves"), left.filter("moves")

    def block(frame: DataFrame, i: Column, j: Column, side: int) -> DataFrame:
        # Blocks of settled rows with movers are numbered from 0, those of movers alone from -1 down.
        return frame.select("root", "row", "grams", i.alias("i"), j.alias("j"), F.lit(side).alias("side")).select(_BLOCK)

    pairs = movers.withColumn("with", _each(F.col("m_parts")))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    blocks = [
        block(settled.withColumn("with", _each(F.col("m_parts"))), F.col("part"), F.col("with"), 0),
        block(movers.withColumn("with", _each(F.col("n_parts"))), F.col("with"), F.col("own"), 1),
        block(pairs.filter("own <= with"), -1 - low, high, 0),
        block(pairs.filter("own >= with"), -1 - low, high, 1),
    ]
    second = _product(reduce(DataFrame.unionByName, blocks), settings)
    return first.unionByName(second)


def join_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) for every row.

    Null, empty and blank texts have no shingle and link with nothing: their component is
    their own id.  Rows with equal sets are linked, repeated rows among them.  Null ids
    never name a component that has another id.  An empty table gives no row.
    """
    frame = texts(docs)
    short = F.conv(F.hex(F.substring("row", 1, 8)), 16, -10).cast("long")
    described = materialise(
        per_row(frame, "text", _describe(settings), "n long, row binary, own int, spare array<int>").withColumn(
            "short", short
        ),
        "shingled",
    )
    near = candidates(frame.select("text"), described, settings)

    sizes = near.groupBy("root").agg(F.count("*").alias("of"))
    parts = near.join(sizes, "root").select(
        F.col("node").alias("short"), "root", F.ceil(F.col("of") / settings.rows).alias("n_parts")
    )
    ids = described.filter("n > 0").groupBy("row").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("f"))
    wanted = materialise(
        ids.withColumn("short", short).join(parts, "short").select(F.col("f.doc_id").alias("id"), "row", "root", "n_parts"),
        "candidates",
    )
    fixed = isinstance(wanted.schema["id"].dataType, T.NumericType)
    if fixed and wanted.count() <= settings.broadcast_rows:
        # texts stay where they are; a task that packed them first would hold a second Python worker
        rows = frame.withColumnRenamed("text", "content").join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("id")))
    else:
        rows = packed(frame).withColumnRenamed("packed", "content").join(wanted, F.col("doc_id").eqNullSafe(F.col("id")))
    matrix = materialise(_incidence(rows.select("row", "root", "n_parts", "content"), settings), "incidence")
    links = _links(matrix, settings)
    classes = components(links)

    known = described.select("doc_id", "n", "row").join(classes.withColumnRenamed("node", "row"), "row", "left")
    named = known.select("doc_id", "n", F.coalesce("root", "row").alias("class"))
    least = named.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    return named.join(least, "class", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def packed(frame: DataFrame) -> DataFrame:
    """doc_id, packed: texts compressed before they travel."""

    def run(found: list[str]) -> dict[str, list]:
        pack = zstandard.ZstdCompressor(level=1).compress
        return {"packed": pa.array([pack(t.encode()) for t in found], pa.binary())}

    return per_row(frame, "text", run, "packed binary")


def keep_one(docs: DataFrame, settings: Settings = Settings(shingle=5, percent=80, growth=1.5)) -> DataFrame:
    """The rows of `docs` whose id names their component, with all their columns.

    Rows of one id stand or fall together: all stay if one of them does.
    """
    found = join_components(docs, settings)
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = found.groupBy(F.col("doc_id").alias("__gone")).agg(stays.alias("stays")).filter("not stays")
    gone = materialise(gone.select("__gone"), "near-copies")  # its size then decides how it is joined
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__gone")), "left_anti")


def _incidence(found: DataFrame, settings: Settings) -> DataFrame:
    """The n-grams of candidate rows, their content a text or a packed one.

    A row that shares its doc_id with another text is left to that text's own row."""
    plain = isinstance(found.schema["content"].dataType, T.StringType)
    size = 4_000_000 if plain else 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                held = piece.column("content").to_pylist()
                sets = [shingles(t if plain else unpack(t).decode(), settings.shingle) for t in held]
                names = piece.column("row").to_pylist()
                mine = [k for k, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == names[k]]
                kept = piece.take(pa.array(mine, pa.int64()))
                grams = pa.array([sets[k].view(np.int64) for k in mine], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[kept.column(c) for c in ("row", "root", "n_parts")], grams],
                    names=["row", "root", "n_parts", "grams"],
                )

    return found.mapInArrow(give_back(run), "row binary, root long, n_parts long, grams array<long>")
