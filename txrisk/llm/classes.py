"""Class-based bigrams: words exchanged between classes, then texts scored.

Tokens are the words of a text, A-Z lower-cased, and one end.  Every word of the
training documents is in one class; a token is predicted by

    P(w | v) = (1 - u(c(v))) * P(c(w) | c(v)) * count(w) / count(c(w))

and a word unknown to the training documents, as one more word, by u(c(v)): the
share of words seen once after that class.  Class transitions are smoothed
towards the classes' own shares, u towards that of the whole corpus; all sums
to one.  The end of a document is also what its first word follows.

Exchange: the most frequent words begin in classes of their own, all others
in the last one.  Words are dealt into batches by hash; the words of a batch
move, all at once, each to the class that most raises the likelihood of the
class bigrams, all others standing still.  The count of pairs of classes is the
only table that reaches every task; its size is the square of the number of classes.

No word and no count is left out, and nothing grows with the corpus in one task:

- documents are encoded in blocks of bounded text, with numbers for the words
  of the block; one very long text is a block of its own;
- words are dealt into shards by hash.  A block sends each shard its words and
  counts once, and for each batch how often its words met which class; a shard
  answers with the classes of the block's words, in the block's order.  A
  frequent word is one entry per block, so no word is a hot key.

A null text is an empty one: a single end.  A null id is held out.  Equal rows
are rows of their own.  With no training documents every token is unknown, and
the base score is zero.  Only the id and the text are read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import fold, texts
from txrisk.session import materialise


@dataclass(frozen=True)
class Settings:
    # Classes, the first of which holds the end alone; at most 127.
    classes: int = 64
    batches: int = 3
    folds: int = 10
    added: float = 0.1
    # Weight of the smoothing distributions, in tokens.
    prior: float = 16.0
    block_bytes: int = 16_000_000


# --- arrays as compressed bytes


def squeeze(values: np.ndarray) -> bytes:
    """Little-endian numbers, equal bytes of all numbers together, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def widen(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


# --- blocks


class _Block:
    """Documents under way: numbers of words by first use, from 1; 0 is the end."""

    def __init__(self):
        self.numbers: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.doc_ids: list = []
        self.held: list[bool] = []
        self.lengths: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, held: bool, text: str) -> None:
        raw = text.encode()
        numbers = list(map(self.numbers.__getitem__, raw.lower().split()))
        numbers.append(0)
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(numbers))
        self.tokens.append(np.array(numbers, dtype=np.int32))
        self.size += len(raw) + 100

    def row(self, shards: int, batches: int) -> dict:
        """Words in order of shard and batch, and the tokens by their place in that order."""
        words = list(self.numbers)
        hashes = np.array([crc32(w) for w in words], dtype=np.int64)
        group = hashes % shards * batches + (hashes >> 16) % batches
        order = np.argsort(group, kind="stable")
        place = np.zeros(len(words) + 1, dtype=np.int32)
        place[order + 1] = np.arange(1, len(words) + 1)
        tokens = place[np.concatenate(self.tokens)]
        lengths = np.array(self.lengths)
        trained = np.repeat(~np.array(self.held), lengths)
        counts = np.bincount(tokens[trained], minlength=len(words) + 1)
        bounds = 1 + np.concatenate([[0], np.cumsum(np.bincount(group, minlength=shards * batches))])
        packets = []
        for s in range(shards):
            a, b = bounds[s * batches], bounds[(s + 1) * batches]
            if b > a:
                own = b"\n".join([words[i] for i in order[a - 1 : b - 1]])
                packets.append(
                    {"shard": s, "words": zstandard.ZstdCompressor(level=3).compress(own), "counts": squeeze(counts[a:b].astype("<i4"))}
                )
        return {
            "doc_ids": self.doc_ids, "held": self.held, "lengths": self.lengths, "tokens": squeeze(tokens.astype("<i4")),
            "bounds": bounds.tolist(), "ends": int(counts[0]), "packets": packets,
        }


def _blocks(docs: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """Encoded documents; block numbers tell the task and its block."""
    ready = docs.select("doc_id", (fold(settings.folds) == 0).alias("held"), "text")
    kind = ready.schema["doc_id"].dataType.simpleString()
    fields = {
        "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "tokens": pa.binary(), "bounds": pa.list_(pa.int32()),
        "ends": pa.int64(), "packets": pa.list_(pa.struct([("shard", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])),
    }

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, task, id_type = _Block(), 0, TaskContext.get().partitionId() << 32, None

        def closed() -> pa.RecordBatch:
            row = block.row(shards, settings.batches)
            columns = [pa.array([task + number], pa.int64()), pa.array([row["doc_ids"]], pa.list_(id_type))]
            columns += [pa.array([row[f]], t) for f, t in fields.items()]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", *fields])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                for doc_id, held, text in zip(*[c.to_pylist() for c in piece.columns], strict=True):
                    block.add(doc_id, held, text)
                    if block.size >= settings.block_bytes:
                        yield closed()
                        block, number = _Block(), number + 1
        if block.doc_ids:
            yield closed()

    schema = (
        f"block long, doc_ids array<{kind}>, held array<boolean>, lengths array<int>, tokens binary, bounds array<int>, "
        "ends long, packets array<struct<shard: int, words: binary, counts: binary>>"
    )
    return materialise(ready.mapInArrow(encode, schema), "blocks")


# --- shards


def _shards(blocks: DataFrame) -> DataFrame:
    """The words of each shard with their counts, and where the words of each block are among them."""

    def merge(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)
        places, parts = [], []
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("block", "words", "counts")], strict=True))
        for block, words, counts in rows:
            own = zstandard.ZstdDecompressor().decompress(words).split(b"\n")
            at = np.array(list(map(numbers.__getitem__, own)), dtype="<i4")
            places.append({"block": block, "at": squeeze(at)})
            parts.append((at, widen(counts, "<i4")))
        total = np.zeros(len(numbers), dtype="<i8")
        for at, counts in parts:
            total[at] += counts
        columns = {
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "words": pa.array([zstandard.ZstdCompressor(level=3).compress(b"\n".join(numbers))], pa.binary()),
            "counts": pa.array([squeeze(total)], pa.binary()),
            "n_tokens": pa.array([int(total.sum())], pa.int64()),
            "n_words": pa.array([int((total > 0).sum())], pa.int64()),
            "n_once": pa.array([int((total == 1).sum())], pa.int64()),
            "places": pa.array([places], pa.list_(pa.struct([("block", pa.int64()), ("at", pa.binary())]))),
        }
        return pa.table(columns)

    packets = blocks.select("block", F.explode("packets").alias("p")).select("block", "p.*")
    return materialise(
        packets.groupBy("shard").applyInArrow(
            merge,
            "shard int, words binary, counts binary, n_tokens long, n_words long, n_once long, "
            "places array<struct<block: long, at: binary>>",
        ),
        "shards",
    )


def _words_of(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split(b"\n")


def _begin(shards: DataFrame, settings: Settings) -> DataFrame:
    """Adds the first classes: the most frequent words alone, all others together."""
    own = settings.classes - 2

    def leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                counts = widen(counts, "<i8")
                words = _words_of(words)
                least = np.partition(counts, max(0, len(counts) - own))[max(0, len(counts) - own)] if own else counts.max() + 1
                top = sorted((-int(counts[i]), words[i]) for i in np.flatnonzero((counts >= least) & (counts > 0)))[:own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for _, w in top], pa.binary()), pa.array([-n for n, _ in top], pa.int64())], names=["word", "n"]
                )

    best = shards.select("words", "counts").mapInArrow(leaders, "word binary, n long")
    first = {row["word"]: 1 + i for i, row in enumerate(best.orderBy(F.desc("n"), "word").limit(max(own, 1)).collect()[:own])}
    first = {bytes(w): c for w, c in first.items()}

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = settings.classes - 1
            found = [squeeze(np.array([first.get(w, rest) for w in _words_of(words)], dtype=np.uint8)) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(found, pa.binary())], names=["shard", "classes"])

    return materialise(shards.select("shard", "words").mapInArrow(start, "shard int, classes binary"), "classes")


# --- between blocks and shards


def _with_classes(blocks: DataFrame, shards: DataFrame, classes: DataFrame, counts: bool) -> DataFrame:
    """Each block beside the classes (and counts) of its words, shard by shard."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = widen(row["classes"], "u1")
                total = widen(row["counts"], "<i8")
                for start in range(0, len(row["places"]), 64):
                    some = row["places"][start : start + 64]
                    at = [widen(p["at"], "<i4") for p in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["block"] for p in some], pa.int64()),
                            pa.array([row["shard"]] * len(some), pa.int32()),
                            pa.array([squeeze(own[a]) for a in at], pa.binary()),
                            pa.array([squeeze(total[a]) if counts else None for a in at], pa.binary()),
                        ],
                        names=["block", "shard", "classes", "counts"],
                    )

    held = shards.select("shard", "counts", "places").join(classes, "shard")
    answers = held.mapInArrow(answer, "block long, shard int, classes binary, counts binary")
    answers = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "classes", "counts"))).alias("answers"))
    return blocks.join(answers, "block", "left")


def _table(answers: list[dict] | None, field: str, kind: str) -> np.ndarray:
    """A value for each number of the block; the end's is 0."""
    parts = [widen(a[field], kind) for a in answers or []]
    return np.concatenate([np.zeros(1, dtype=kind), *parts])


def _stream(row: dict, keep: np.ndarray) -> np.ndarray:
    """An end, then the tokens of the kept documents, each with its end."""
    tokens = widen(row["tokens"], "<i4")
    return np.concatenate([np.zeros(1, dtype=np.int32), tokens[np.repeat(keep, row["lengths"])]])


def _pairs(before: np.ndarray, after: np.ndarray, rows: int, columns: int) -> list[int]:
    key = before.astype(np.int64) * columns + after
    return np.bincount(key, minlength=rows * columns).tolist()


def _summed(frame: DataFrame, column: str, size: int) -> np.ndarray:
    """Sums of an array column, place by place; `size` numbers reach the driver."""
    found = np.zeros(size, dtype=np.int64)
    cells = frame.select(F.posexplode(column).alias("place", "n")).filter("n > 0")
    for place, n in cells.groupBy("place").agg(F.sum("n").alias("n")).collect():
        found[place] = n
    return found


def _met(joined: DataFrame, batch: int, settings: Settings) -> DataFrame:
    """How often the words of a batch precede and follow each class, by shard; and the pairs of classes.

    Slot c: followed by class c; slot classes + c: preceded by it; last slot: followed by itself.
    """
    k, n_batches = settings.classes, settings.batches
    slots = 2 * k + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "word", "slot", "n", "pairs"]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for rows in batches:
            for at in range(rows.num_rows):
                row = rows.slice(at, 1).to_pylist()[0]
                stream = _stream(row, ~np.array(row["held"], dtype=bool))
                of = _table(row["answers"], "classes", "u1")[stream].astype(np.int64)
                bounds = np.array(row["bounds"])
                starts, stops = bounds[batch:-1:n_batches], bounds[batch + 1 :: n_batches]
                chosen = np.zeros(bounds[-1], dtype=bool)
                for a, b in zip(starts, stops, strict=True):
                    chosen[a:b] = True
                inside = chosen[stream]
                left, right = stream[:-1].astype(np.int64), stream[1:].astype(np.int64)
                itself = left == right
                ahead = left * slots + np.where(itself, 2 * k, of[1:])
                behind = right * slots + k + of[:-1]
                keys, n = np.unique(np.concatenate([ahead[inside[:-1]], behind[inside[1:] & ~itself]]), return_counts=True)
                word, slot = keys // slots, (keys % slots).astype(np.uint8)
                out = [(-1, row["block"], None, None, None, _pairs(of[:-1], of[1:], k, k))]
                cuts = np.searchsorted(word, np.stack([starts, stops]))
                for s, (a, b) in enumerate(cuts.T):
                    if b > a:
                        local = (word[a:b] - bounds[s * n_batches]).astype("<i4")
                        out.append((s, row["block"], squeeze(local), squeeze(slot[a:b]), squeeze(n[a:b].astype("<i4")), None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names
                )

    ready = joined.select("block", "held", "lengths", "tokens", "bounds", "answers")
    return materialise(
        ready.mapInArrow(count, "shard int, block long, word binary, slot binary, n binary, pairs array<long>"), "met"
    )


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def gains(
    pairs: np.ndarray, classes: np.ndarray, counts: np.ndarray, word: np.ndarray, slot: np.ndarray, n: np.ndarray
) -> np.ndarray:
    """What each class would add to the log-likelihood of the class bigrams, were each word put into it
    after leaving its own: an array of (words, classes).

    `word`, `slot` and `n` list how often each word met each class, ordered by word.
    """
    k, m = len(pairs), len(classes)
    pairs = pairs.astype(np.float64)
    size = pairs.sum(axis=1)
    whole, rows = _xlogx(pairs), np.arange(m)
    ahead, behind, itself = np.zeros((m, k)), np.zeros((m, k)), np.zeros(m)
    for table, low in ((ahead, 0), (behind, k)):
        some = (slot >= low) & (slot < low + k)
        table[word[some], slot[some] - low] = n[some]
    itself[word[slot == 2 * k]] = n[slot == 2 * k]

    found = np.zeros((m, k))
    for low, cells, filled in ((0, pairs.T, whole.T), (k, pairs, whole)):
        # cells[c] are the counts of class c with every class; the pairs with itself and with its old class follow below.
        own = classes[word]
        some = np.flatnonzero((slot >= low) & (slot < low + k) & (slot - low != own))
        if not len(some):
            continue
        at, c, r, old = word[some], (slot[some] - low).astype(np.int64), n[some].astype(np.float64), own[some]
        gain = _xlogx(cells[c] + r[:, None]) - filled[c]
        line = np.arange(len(some))
        gain[line, old] = filled[c, old] - _xlogx(cells[c, old] - r)
        gain[line, c] = 0
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        found[at[begins]] += np.add.reduceat(gain, begins, axis=0)

    old = classes
    to_old, from_old = pairs[:, old].T - behind, pairs[old, :] - ahead  # without the word: class -> old, old -> class
    moved = _xlogx(to_old + ahead[rows, old][:, None]) - _xlogx(to_old)
    moved += _xlogx(from_old + behind[rows, old][:, None]) - _xlogx(from_old)
    diagonal = np.diagonal(pairs)
    moved += _xlogx(diagonal + ahead + behind + itself[:, None]) - _xlogx(diagonal)
    inner = pairs[old, old]
    moved[rows, old] = _xlogx(inner) - _xlogx(inner - ahead[rows, old] - behind[rows, old] - itself)
    margin = _xlogx(size + counts[:, None]) - _xlogx(size)
    margin[rows, old] = _xlogx(size[old]) - _xlogx(size[old] - counts)
    return found + moved - 2 * margin


def _exchange(shards: DataFrame, classes: DataFrame, met: DataFrame, pairs: np.ndarray, at_once: int = 4096) -> DataFrame:
    """The classes after the words of a batch have moved."""
    k = len(pairs)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1).to_pylist()[0]
                own, counts = widen(row["classes"], "u1").copy(), widen(row["counts"], "<i8")
                places = {p["block"]: p["at"] for p in row["places"]}
                keys, sums = [], []
                for part in row["parts"] or []:
                    at = widen(places[part["block"]], "<i4")[widen(part["word"], "<i4")].astype(np.int64)
                    keys.append(at * (2 * k + 1) + widen(part["slot"], "u1"))
                    sums.append(widen(part["n"], "<i4"))
                if keys:
                    key, where = np.unique(np.concatenate(keys), return_inverse=True)
                    n = np.bincount(where, weights=np.concatenate(sums)).astype(np.int64)
                    word, slot = key // (2 * k + 1), key % (2 * k + 1)
                    chosen, first = np.unique(word, return_index=True)
                    old = own.astype(np.int64)
                    for a in range(0, len(chosen), at_once):
                        some = chosen[a : a + at_once]
                        low, high = first[a], first[a + at_once] if a + at_once < len(first) else len(word)
                        local = np.searchsorted(some, word[low:high])
                        gain = gains(pairs, old[some], counts[some], local, slot[low:high], n[low:high])
                        gain[:, 0] = -np.inf
                        best = gain.argmax(axis=1)
                        line = np.arange(len(some))
                        better = gain[line, best] > gain[line, old[some]] + 1e-9
                        own[some] = np.where(better, best, old[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int32()), pa.array([squeeze(own)], pa.binary())], names=["shard", "classes"]
                )

    parts = met.filter("shard >= 0").groupBy("shard").agg(
        F.sort_array(F.collect_list(F.struct("block", "word", "slot", "n"))).alias("parts")
    )
    held = shards.select("shard", "counts", "places").join(classes, "shard").join(parts, "shard", "left")
    return materialise(held.mapInArrow(move, "shard int, classes binary"), "classes")


# --- the model


@dataclass(frozen=True)
class Model:
    """Probabilities of a fixed number of classes; class `classes` stands for unknown words."""

    tokens: int
    words: int
    added: float
    unknown: np.ndarray  # log10 of u(class)
    known: np.ndarray  # log10 of 1 - u(class)
    follows: np.ndarray  # log10 of P(class | class)
    size: np.ndarray  # tokens of each class

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + self.added) / (self.tokens + self.added * (self.words + 1)))


def _model(counts: np.ndarray, tokens: int, words: int, once: int, settings: Settings) -> Model:
    """`counts`: pairs of classes, with words seen once also as one more class, before and after others."""
    k, prior = settings.classes, settings.prior
    pairs = counts.reshape(k + 1, k + 1).astype(np.float64)
    # A word seen once was unknown to all else: what it follows and what follows it tells of unknown words.
    before, after_once = pairs[:, k].copy(), pairs[k, :k].copy()
    table = np.vstack([pairs[:k, :k], after_once])
    share = (once + 0.5) / (tokens + 1.0)
    size = pairs[:k, :k].sum(axis=1)
    u = (before + prior * share) / (np.append(size, pairs[k, :].sum()) + prior)
    own = size / max(size.sum(), 1.0)
    follows = (table + prior * own) / (table.sum(axis=1, keepdims=True) + prior)
    with np.errstate(divide="ignore"):
        return Model(tokens, words, settings.added, np.log10(u), np.log10(1 - u), np.log10(follows), size)


def _counts(joined: DataFrame, settings: Settings) -> np.ndarray:
    """Pairs of final classes; row and column `classes`: pairs of words seen once, counted there as well."""
    k = settings.classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(rows.num_rows):
                row = rows.slice(at, 1).to_pylist()[0]
                stream = _stream(row, ~np.array(row["held"], dtype=bool))
                of = _table(row["answers"], "classes", "u1")[stream].astype(np.int64)
                once = (_table(row["answers"], "counts", "<i8") == 1)[stream]
                once[stream == 0] = False
                left, right = of[:-1], of[1:]
                keys = [left * (k + 1) + right]
                keys.append((left * (k + 1) + k)[once[1:]])
                keys.append(np.full(np.count_nonzero(once[:-1] & once[1:]), k * (k + 1) + k))
                keys.append((k * (k + 1) + right)[once[:-1] & ~once[1:]])
                found = np.bincount(np.concatenate(keys), minlength=(k + 1) ** 2)
                yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.int64()))], names=["pairs"])

    ready = joined.select("held", "lengths", "tokens", "answers")
    return _summed(ready.mapInArrow(count, "pairs array<long>"), "pairs", (k + 1) ** 2)


def _scores(joined: DataFrame, model: Model, settings: Settings) -> DataFrame:
    k = settings.classes
    kind = joined.schema["doc_ids"].dataType.elementType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(rows.num_rows):
                one = rows.slice(at, 1)
                row = one.to_pylist()[0]
                lengths = np.array(row["lengths"], dtype=np.int64)
                stream = _stream(row, np.ones(len(lengths), dtype=bool))
                total = _table(row["answers"], "counts", "<i8").copy()
                total[0] = model.size[0]
                of = np.where(total > 0, _table(row["answers"], "classes", "u1"), k).astype(np.int64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    emitted = np.log10(total / np.append(model.size, 1.0)[of])
                before, now = of[stream[:-1]], of[stream[1:]]
                # A document follows an end, whether training documents had any or not.
                begins = np.cumsum(lengths) - lengths
                before[begins] = 0
                known = now < k
                inside = model.known[before] + model.follows[before, np.where(known, now, 0)] + emitted[stream[1:]]
                logs = np.where(known, inside, model.unknown[before])
                base = model.base(total)[stream[1:]]
                columns = [
                    one.column("doc_ids").flatten(),
                    pa.array(row["held"], pa.bool_()),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.add.reduceat(known.astype(np.int64), begins), pa.int64()),
                    pa.array(np.full(len(lengths), model.tokens), pa.int64()),
                    pa.array(np.add.reduceat(base, begins), pa.float64()),
                    pa.array(np.add.reduceat(logs, begins), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                )

    return joined.select("doc_ids", "held", "lengths", "tokens", "answers").mapInArrow(
        score,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _learnt(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, shards, and the classes of the words of each shard."""
    size = docs.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    blocks = _blocks(docs, 1 + size // settings.block_bytes, settings)
    shards = _shards(blocks)
    classes = _begin(shards, settings)
    for batch in range(settings.batches):
        met = _met(_with_classes(blocks, shards, classes, False), batch, settings)
        pairs = _summed(met.filter("shard = -1"), "pairs", settings.classes**2).reshape(settings.classes, -1)
        classes = _exchange(shards, classes, met, pairs)
    return blocks, shards, classes


def score_texts(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    The model learns from the documents of all folds but the first; scores are
    log10 probabilities of whole texts, under the model and under single words.
    """
    ready = texts(docs, id_col, text_col)
    blocks, shards, classes = _learnt(ready, settings)
    joined = materialise(_with_classes(blocks.drop("packets"), shards, classes, True), "classed")
    sums = shards.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_words", "n_once")]).first()
    ends = blocks.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    model = _model(_counts(joined, settings), sums["n_tokens"] + ends, sums["n_words"] + (ends > 0), sums["n_once"], settings)
    return _scores(joined, model, settings)


def word_classes(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, count, class of every word of the training documents."""
    _, shards, classes = _learnt(texts(docs, id_col, text_col), settings)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                counts, own = widen(row["counts"], "<i8"), widen(row["classes"], "u1")
                words = _words_of(row["words"])
                for a in range(0, len(words), 100_000):
                    some = a + np.flatnonzero(counts[a : a + 100_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i].decode() for i in some], pa.string()), pa.array(counts[some], pa.int64()), pa.array(own[some].astype(np.int32), pa.int32())],
                        names=["word", "n", "class"],
                    )

    return shards.select("shard", "words", "counts").join(classes, "shard").select("words", "counts", "classes").mapInArrow(
        spell, "word string, n long, class int"
    )
