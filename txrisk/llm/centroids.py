"""Centroid clustering of integer vectors held as bit planes.

A component x becomes the integer floor(scale * x).  Bit i of all 64
components together is one 64-bit word, the i-th plane of the vector; planes
are in two's complement, so the last one weighs -2^(n-1).  The dot product of
two vectors is the sum over pairs of planes of their weights times the number
of bits set in both, and a distance is |x|^2 - 2 x.c + |c|^2: all exact.

Centroids move by counting set bits.  A task counts, for each cluster, plane
and component, the vectors with that bit; Spark adds these counts, and the
driver sees clusters x planes x 64 numbers, whatever the number of vectors.

Rows without exactly 64 components, or with a null or non-finite one, are left
out.  A null id is kept and named by an empty text; equal ids are rows of
their own, and where seeds tie, the row with the lesser components goes first.
With fewer rows than clusters every row is a seed; no rows give no rows.  The
number of planes follows the largest component; a distance or a sum beyond a
long is null, and its row is still assigned exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.session import materialise

WIDTH = 64
LONGEST = 2**63 - 1
# Up to so many planes all sums fit a 64-bit number; beyond, Python's integers are used.
NARROW = 28
BATCH = 2048


@dataclass(frozen=True)
class Settings:
    clusters: int = 16
    rounds: int = 3
    scale: int = 64
    seed: int = 1


def weights(planes: int) -> np.ndarray:
    kind = np.int64 if planes <= NARROW else object
    found = np.array([1 << i for i in range(planes)], dtype=kind)
    found[-1] = -found[-1]
    return found


def pack(vectors: list[list[int]], planes: int) -> np.ndarray:
    """Planes of 64 integers each, as an array of shape (vectors, planes)."""
    narrow = planes <= NARROW
    values = np.array(vectors, dtype=np.int64 if narrow else object).reshape(-1, WIDTH)
    at = np.arange(WIDTH, dtype=np.uint64)
    found = np.empty((len(values), planes), dtype=np.uint64)
    for i in range(planes):
        found[:, i] = (((values >> i) & 1).astype(np.uint64) << at).sum(axis=1, dtype=np.uint64)
    return found


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of every vector of `left` with every one of `right`."""
    weight = weights(left.shape[1])
    total = np.zeros((len(left), len(right)), dtype=weight.dtype)
    for i in range(left.shape[1]):
        both = np.bitwise_count(left[:, i, None, None] & right[None, :, :]).astype(weight.dtype)
        total = total + weight[i] * (both @ weight)
    return total


def norms(vectors: np.ndarray) -> np.ndarray:
    weight = weights(vectors.shape[1])
    total = np.zeros(len(vectors), dtype=weight.dtype)
    for i in range(vectors.shape[1]):
        both = np.bitwise_count(vectors[:, i, None] & vectors).astype(weight.dtype)
        total = total + weight[i] * (both @ weight)
    return total


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, the least of equals, and its squared distance."""
    apart = norms(vectors)[:, None] - 2 * dots(vectors, centroids) + norms(centroids)[None, :]
    found = np.asarray(apart.argmin(axis=1), dtype=np.int64)
    return found, apart[np.arange(len(vectors)), found]


def _words(column: pa.Array, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, planes)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for any finite double."""
    return int(x) * scale if abs(x) >= 2.0**52 else math.floor(scale * x)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    cell = F.col("cell")
    bad = F.exists(cell, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cells = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("cell"))
    return cells.filter((F.size(cell) == WIDTH) & ~F.coalesce(bad, F.lit(True)))


def cluster(
    vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    Only the id and the vector are read; further columns of any name stay out.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col)
    kind = usable.schema["vec_id"].dataType.simpleString()
    ends = usable.select(F.array_min("cell").alias("low"), F.array_max("cell").alias("high")).agg(F.min("low"), F.max("high")).first()
    if ends[0] is None:
        return spark.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    low, high = (_whole(x, settings.scale) for x in ends)
    planes = 1 + max((~x if x < 0 else x).bit_length() for x in (low, high))

    first = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = usable.orderBy(first, "cell").limit(settings.clusters).collect()
    centroids = [[_whole(x, settings.scale) for x in row["cell"]] for row in seeds]

    def to_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            cells = piece.column("cell").flatten().to_numpy(zero_copy_only=False)
            if planes <= NARROW:
                values = np.floor(settings.scale * cells).astype(np.int64)
            else:
                values = np.array([_whole(x, settings.scale) for x in cells.tolist()], dtype=object)
            packed = pack(values, planes).astype("<u8")
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), pa.array([row.tobytes() for row in packed], pa.binary())], names=["vec_id", "planes"]
            )

    packed = materialise(usable.mapInArrow(to_planes, f"vec_id {kind}, planes binary"), "planes")

    for _ in range(settings.rounds):
        centroids = _moved(packed, centroids, planes)

    last = pack(centroids, planes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            found, apart = nearest(_words(piece.column("planes"), planes), last)
            fits = [int(x) if x <= LONGEST else None for x in apart]
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), pa.array(found, pa.int32()), pa.array(fits, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    assigned = materialise(packed.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned")
    return _with_inertia(assigned, centroids)


def _moved(packed: DataFrame, centroids: list[list[int]], planes: int) -> list[list[int]]:
    """Each centroid at the floor of the mean of its vectors; one without vectors stays."""
    current = pack(centroids, planes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = np.zeros(len(current), dtype=np.int64)
        ones = np.zeros((len(current), planes, WIDTH), dtype=np.int64)
        at = np.arange(WIDTH, dtype=np.uint64)
        for piece in _pieces(batches):
            words = _words(piece.column("planes"), planes)
            found, _ = nearest(words, current)
            members += np.bincount(found, minlength=len(current))
            bits = ((words[:, :, None] >> at) & np.uint64(1)).astype(np.int64)
            for c in np.unique(found):
                ones[c] += bits[found == c].sum(axis=0)
        counts = [[int(m), *row] for m, row in zip(members, ones.reshape(len(current), -1).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(current)), pa.int32()), pa.array(counts, pa.list_(pa.int64()))], names=["cluster", "counts"]
        )

    found = packed.select("planes").mapInArrow(count, "cluster int, counts array<long>")
    sums = found.select("cluster", F.posexplode("counts").alias("place", "n")).groupBy("cluster", "place").agg(F.sum("n").alias("n"))
    table = np.zeros((len(centroids), 1 + planes * WIDTH), dtype=object)
    for c, place, n in sums.collect():
        table[c, place] = int(n)
    weight = [int(w) for w in weights(planes)]
    moved = []
    for old, row in zip(centroids, table, strict=True):
        members, ones = row[0], row[1:].reshape(planes, WIDTH)
        total = [sum(w * n for w, n in zip(weight, ones[:, j], strict=True)) for j in range(WIDTH)]
        moved.append([t // members for t in total] if members else old)
    return moved


def _with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds what all rows of a cluster, and all rows, have in common: one row per cluster."""
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def total(column: str):
        whole = F.when(F.count(F.lit(1)) == F.count(column), F.sum(F.col(column).cast("decimal(38,0)")))
        return F.when(whole <= F.lit(LONGEST), whole).cast("long")

    found = assigned.groupBy("cluster").agg(total("distance")).collect()
    every = None if any(x is None for _, x in found) else sum(x for _, x in found)
    every = every if every is not None and every <= LONGEST else None
    facts = assigned.sparkSession.createDataFrame(
        [(c, x, every, digests[c]) for c, x in found], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # At most one row per centroid.
    return assigned.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def twin(settings: Settings = Settings()) -> str:
    """The same clustering in DuckDB's SQL, of vectors whose components are small."""
    steps = [f"""
    WITH kept AS (
      SELECT row_number() OVER () AS rid, vec_id, embedding, [CAST(floor({settings.scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
      FROM embeddings
      WHERE len(embedding) = {WIDTH} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    long AS (SELECT rid, unnest(v) AS x, unnest(range({WIDTH})) AS place FROM kept),
    first AS (
      SELECT rid, row_number() OVER (ORDER BY sha256('{settings.seed}:' || vec_id), embedding) - 1 AS cluster FROM kept
      QUALIFY row_number() OVER (ORDER BY sha256('{settings.seed}:' || vec_id), embedding) <= {settings.clusters}),
    c0 AS (SELECT cluster, place, x FROM first JOIN long USING (rid))"""]
    for r in range(settings.rounds + 1):
        steps.append(f"""
    d{r} AS (
      SELECT rid, cluster, sum((long.x - c.x) * (long.x - c.x)) AS distance
      FROM long JOIN c{r} AS c USING (place) GROUP BY ALL),
    a{r} AS (SELECT rid, min(distance) AS distance, min_by(cluster, (distance, cluster)) AS cluster FROM d{r} GROUP BY rid)""")
        if r < settings.rounds:
            steps.append(f"""
    m{r} AS (
      SELECT cluster, place, sum(x) AS s, count(*) AS n FROM a{r} JOIN long USING (rid) GROUP BY ALL),
    c{r + 1} AS (
      SELECT c.cluster, c.place,
        CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x
      FROM c{r} AS c LEFT JOIN m{r} USING (cluster, place))""")
    end = settings.rounds
    return ",".join(steps) + f""",
    h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM c{end} GROUP BY cluster)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
      CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{end} JOIN kept USING (rid) JOIN h USING (cluster)"""
