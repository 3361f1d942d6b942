"""Cost-balanced packing of token ids into sequences of bounded length.

A piece costs `linear * n + quadratic * n^2`, the work of one forward pass.
Pieces are taken by descending cost, and each goes to the cheapest open
sequence that still has room for it.  Packing happens where the tokens are
made, in blocks of a bounded number of tokens, so nothing is shuffled and no
task holds more than a block.

Sequences are padded to their limit unless their length is a power of two.  A
block therefore opens as many full sequences as its tokens fill and one more
for each power of two in the rest; documents are cut where nothing has room
for them whole, so every sequence ends full and none is padded.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from txrisk.llm.common import SPACE, give_back, texts

SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)


@dataclass(frozen=True)
class Settings:
    tokenizer: str
    limit: int = 2048
    end_id: int = 1
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    block_tokens: int = 1_000_000
    cached_bytes: int = 40_000_000
    text_bytes: int = 2_000_000

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


# Letters of Latin-1 in lower case, or anything else but white space: the vocabulary always cuts between them.
_PIECE = re.compile("[a-zªµºß-öø-ÿ]+|[^a-zªµºß-öø-ÿ\\t\\n\\x0b\\x0c\\r \\x85\\xa0]+")


class Encoder:
    """Token ids of whole texts, as bytes of little-endian 32-bit numbers.

    The vocabulary lower-cases and never joins letters with what is none (but
    for apostrophes), so the ids of a text are those of its pieces one after
    the other, and each piece is encoded once.  Words with an apostrophe or
    letters beyond Latin-1 stay whole; so do texts that hold a special token.
    """

    def __init__(self, settings: Settings):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(settings.tokenizer)
        self.most, self.held = settings.cached_bytes, 0
        self.known: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.closes = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.closes[number] = token.endswith("</w>")

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        """Encodes new pieces: a to z by the model alone, other letters many at a time.

        Among the latter each piece ends at its first closing token."""
        known = self.known
        letters = [p for p in new if p.isascii() and p.isalpha()]
        others = set(new).difference(letters) if len(letters) < len(new) else set()
        plain = [p for p in others if p.isalpha() and "\xff" >= max(p)]
        known.update((p, self._ids(p).tobytes()) for p in others.difference(plain))
        cut = self.tokenizer.model.tokenize  # the model's own letters: a to z stand for themselves
        for at in range(0, len(letters), 500):
            some = letters[at : at + 500]
            ids = [[t.id for t in cut(p)] for p in some]
            ends = (4 * np.cumsum([len(i) for i in ids])).tolist()
            raw = np.array(list(chain.from_iterable(ids)), dtype="<u4").tobytes()
            known.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            ids = self._ids(" ".join(some))
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                known.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                known.update((p, self._ids(p).tobytes()) for p in some)

    def _pieces(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            plain = False
        else:
            plain = "'" not in text
        if plain:
            return _PIECE.findall(text.lower())
        words = re.split(SPACE, text)
        return words if len(words) == 1 else [p for w in words for p in self._pieces(w)]

    def encode(self, found: list[str]) -> list[bytes]:
        pieces = [self._pieces(t) for t in found]
        used = set().union(*pieces)
        if self.held > self.most:  # the words of these texts stay known, the frequent ones among them
            known = self.known
            self.known = {p: known[p] for p in used if p in known}
            self.held = 0
            self._count(self.known)
        new = list(used - self.known.keys())
        self._learn(new)
        self._count(new)
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, ps)) for ps in pieces]

    def _count(self, words: Collection[str]) -> None:
        # What Python needs for a word, its ids and their place in the table, beside their own bytes.
        self.held += 150 * len(words) + sum(map(len, words)) + sum(map(len, map(self.known.__getitem__, words)))


def encoder(settings: Settings) -> Encoder:
    """One for each worker process, so that its tasks share what they have encoded."""
    made = vars(sys).setdefault("_packing_encoders", {})
    key = settings.tokenizer, settings.cached_bytes
    if key not in made:
        made[key] = Encoder(settings)
    return made[key]


def room(total: int, limit: int) -> list[int]:
    """Lengths of the sequences that `total` tokens fill: full ones, then powers of two."""
    full, rest = divmod(total, limit)
    return [limit] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], settings: Settings) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, for documents of these lengths.

    Ties go to the earlier document and the earlier sequence.
    """
    limit, cost = settings.limit, settings.cost
    sizes = np.array(room(sum(lengths), limit), dtype=np.int64)
    left, load = sizes.copy(), np.zeros(len(sizes))
    todo = [
        (-cost(min(limit, n - at)), d, at, min(limit, n - at))
        for d, n in enumerate(lengths)
        for at in range(0, n, limit)
    ]
    heapq.heapify(todo)
    placed = []
    while todo:
        _, d, at, n = heapq.heappop(todo)
        fits = np.flatnonzero(left >= n)
        if len(fits):
            s = int(fits[np.argmin(load[fits])])
        else:  # fill the roomiest sequence; the rest of the piece waits its turn
            s = int(np.argmax(left))
            kept = int(left[s])
            heapq.heappush(todo, (-cost(n - kept), d, at + kept, n - kept))
            n = kept
        placed.append((d, at, n, s, int(sizes[s] - left[s])))
        left[s] -= n
        load[s] += cost(n)
    return placed


def pack_documents(docs: DataFrame, settings: Settings, with_ids: bool = False) -> DataFrame:
    """Packs every document's ids and the closing id; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    cost of the piece; with `with_ids` also ids (array).  A null or empty text
    is its closing id alone.  Each id lies in exactly one piece.  Repeated rows
    are packed each; an empty table gives no row.  sequence_id holds the number
    of the task in its upper 31 bits, so a task that runs again gives the same.
    """
    frame = texts(docs)
    kind = frame.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {SCHEMA}" + (", ids array<int>" if with_ids else "")
    last = np.asarray([settings.end_id], dtype="<u4").tobytes()

    def flush(ids: list[pa.Array], rows: list[bytes], base: int) -> pa.RecordBatch:
        keys = pa.chunked_array(ids).combine_chunks()
        found = pack([len(r) // 4 for r in rows], settings)
        cells = [rows[d][4 * at : 4 * (at + n)] for d, at, n, _, _ in found]
        columns = {
            "doc_id": keys.take(pa.array([f[0] for f in found], pa.int64())),
            "start": pa.array([f[1] for f in found], pa.int64()),
            "length": pa.array([f[2] for f in found], pa.int64()),
            "ids_crc32": pa.array([crc32(c) for c in cells], pa.int64()),
            "doc_tokens": pa.array([len(rows[f[0]]) // 4 for f in found], pa.int64()),
            "sequence_id": pa.array([base + f[3] for f in found], pa.int64()),
            "offset": pa.array([f[4] for f in found], pa.int64()),
            "cost": pa.array([settings.cost(f[2]) for f in found], pa.float64()),
        }
        if with_ids:
            columns["ids"] = pa.array([np.frombuffer(c, "<i4") for c in cells], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = encoder(settings), TaskContext.get().partitionId() << 33
        ids: list[pa.Array] = []
        rows: list[bytes] = []
        held = 0
        for batch in batches:
            # Python needs some ten times a text's bytes for its words
            step = max(1, int(batch.num_rows * settings.text_bytes / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                ids.append(piece.column("doc_id"))
                new = [r + last for r in made.encode(piece.column("text").to_pylist())]
                rows += new
                held += sum(map(len, new)) // 4
                if held >= settings.block_tokens:
                    yield flush(ids, rows, base)
                    base += len(room(held, settings.limit))
                    ids, rows, held = [], [], 0
        if rows:
            yield flush(ids, rows, base)

    return frame.mapInArrow(give_back(run), schema)
