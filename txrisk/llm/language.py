"""Language identification with language-bitmask n-gram filters.

One Bloom filter holds every language: a slot is a mask with one bit for each
language, and the masks of an n-gram's slots, combined by AND, name all
languages that contain it.  A document counts its n-grams for each language;
the counts are corrected for the share of n-grams that each language's bits
would accept by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import fold, parts, per_row
from txrisk.session import materialise

UNKNOWN = "und"
U = np.uint64
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def grams(text: str | None, n: int) -> np.ndarray:
    """Hashes of the n-grams of code points of a whole lower-cased text.

    Runs of anything but letters become one blank, as do both ends; n-grams
    that hold no letter are left out.  Empty if the text has no letter.
    """
    if not text:
        return np.zeros(0, dtype=U)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.zeros(0, dtype=U)
    points = np.where(is_letter, points, 32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = np.concatenate([[32], points[keep], [32]]).astype(U)
    if points[1] == 32:
        points = points[1:]
    if points[-2] == 32:
        points = points[:-1]
    while len(points) < n:
        points = np.concatenate([points, np.array([32], dtype=U)])
    h = np.zeros(len(points) - n + 1, dtype=U)
    for i in range(n):
        h = h * U(0x110001) + points[i : len(points) - n + 1 + i]
    return _mixed(h)


@dataclass(frozen=True)
class Settings:
    """An n-gram belongs to a language if it makes up at least `share` of its n-grams."""

    n: int = 3
    slots: int = 1 << 17
    hashes: int = 4
    share: float = 2e-5


@dataclass(frozen=True)
class Filter:
    """masks: slots x words of 64 languages each; chance: a language's share of false hits."""

    languages: tuple[str, ...]
    masks: np.ndarray
    chance: np.ndarray
    settings: Settings

    def contains(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the masks of all languages that contain it."""
        found = None
        for slot in places(h, self.settings):
            found = self.masks[slot] if found is None else found & self.masks[slot]
        return found

    def decide(self, text: str | None) -> tuple[str, float]:
        h = grams(text, self.settings.n)
        if not len(h) or not self.languages:
            return UNKNOWN, 0.0
        found = self.contains(h)
        bits = np.unpackbits(found.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        hits = bits[:, : len(self.languages)].sum(axis=0) / len(h)
        true = np.clip((hits - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        best = int(np.argmax(true))  # ties: the first language by name
        rest = np.delete(true, best)
        margin = float(true[best] - (rest.max() if len(rest) else 0.0))
        return self.languages[best], float(np.clip((true[best] + margin) / 2, 0, 1))


def places(h: np.ndarray, settings: Settings) -> list[np.ndarray]:
    a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    return [((a + U(i) * b) % U(settings.slots)).astype(np.int64) for i in range(settings.hashes)]


def _counts(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts(frames, "text", 4_000_000):
            for lang, group in frame.groupby("lang"):
                found = np.concatenate([grams(t, n) for t in group["text"]])
                gram, count = np.unique(found, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": count})

    return run


def fit(docs: DataFrame, settings: Settings = Settings()) -> Filter:
    """Builds the filter from every row with a text and a language.

    N-grams are counted by Spark over all rows.  The driver receives the slots
    that are not zero, so at most `slots` masks whatever the input.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = materialise(
        rows.mapInPandas(_counts(settings.n), "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "grams",
    )
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(totals))
    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((settings.slots, words), dtype=U)
    if not languages:
        return Filter((), masks, np.zeros(0), settings)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    total = F.create_map(*[F.lit(x) for k in languages for x in (k, int(totals[k]))])
    chosen = counted.filter(F.col("n") >= settings.share * total[F.col("lang")])

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            h = frame["gram"].to_numpy(dtype=np.int64).view(U)
            for slot in places(h, settings):
                yield pd.DataFrame({"slot": slot, "word": frame["no"] // 64, "bit": frame["no"] % 64})

    set_bits = (
        chosen.select("gram", number[F.col("lang")].alias("no"))
        .mapInPandas(bits, "slot int, word int, bit int")
        .withColumn("mask", F.expr("shiftleft(1L, bit)"))
        .groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
        .toPandas()
    )
    masks[set_bits["slot"], set_bits["word"]] = set_bits["mask"].to_numpy(dtype=np.int64).view(U)
    on = np.unpackbits(masks.view(np.uint8).reshape(settings.slots, -1), axis=1, bitorder="little")
    fill = on[:, : len(languages)].mean(axis=0)
    return Filter(languages, masks, fill**settings.hashes, settings)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""

    def run(found: list) -> dict[str, list]:
        decided = [model.decide(t) for t in found]
        return {"lang_pred": [d[0] for d in decided], "score": [d[1] for d in decided]}

    return per_row(docs, "text", run, "lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1, settings: Settings = Settings()) -> DataFrame:
    """Predicts every document's language; learns only outside the held-out fold.

    Returns doc_id, held_out, lang_pred, score, one row per row of `docs`.
    `und` with score 0 if the text is null or has no letter, or if no row has a
    language.  Repeated rows each give a row, an empty table gives none.
    """
    model = fit(docs.filter(fold(folds) != held), settings)
    return predict(docs, model).select(
        "doc_id", (fold(folds) == held).alias("held_out"), "lang_pred", "score"
    )
