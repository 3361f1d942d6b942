"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask fixes which of a few consecutive words count; the others may differ.
The hashes of all masked positions of documents and benchmark items are joined;
a hit fixes how the two texts lie against each other, and the words of that
alignment are compared one by one, so substituted words do not hide a leak.

Seeds, hits and alignments are narrow rows without a word of either text; words
are joined to the distinct alignments only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import texts
from txrisk.session import materialise


@dataclass(frozen=True)
class Settings:
    """The first three masks also pass over every third, fourth or fifth word.

    An alignment is a leak if `window` consecutive words (the item's, if it has
    fewer) agree to `share`, or the whole item agrees to `item_share`.

    Runs of equal words that the window rule cannot avoid are masks, too, so that
    rule misses nothing.  Item_share reaches only alignments that hold a mask.
    Items under `least_words` words are reported only where all their words agree.  The seeds of at most `broadcast_seeds` item positions
    are broadcast (some 50 bytes each), and so are at most as many alignments and leaking documents, and items of at most
    `broadcast_bytes`; more are joined by a shuffle.
    """

    masks: tuple[str, ...] = ("11011011", "1110111", "1111011", "110010011001")
    window: int = 13
    share: float = 0.8
    item_share: float = 0.5
    least_words: int = 7
    broadcast_seeds: int = 200_000
    broadcast_bytes: int = 10_000_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def sure_run(n_words: int, settings: Settings) -> int:
    """Equal words in a row that every leak of an item of so many words by the window rule has."""
    if n_words < settings.least_words:
        return n_words
    window = min(settings.window, n_words)
    others = next(k for k in range(window, -1, -1) if window - k >= settings.share * window)
    return max(1, -(-(window - others) // (others + 1)))


def _seeds(frame: DataFrame, keep: list[str], masks: list[tuple[str, Column]]) -> DataFrame:
    """One row for each mask and position of `words` that its condition admits: keep, at, mask, seed."""
    least = min(len(mask) for mask, _ in masks)
    positions = F.when(F.size("words") >= least, F.sequence(F.lit(0), F.size("words") - least))
    placed = frame.select(*keep, "words", F.explode(positions).alias("at"))
    seeds = []
    for number, (mask, admits) in enumerate(masks):
        fixed = [i for i, c in enumerate(mask) if c == "1"]
        seed = F.xxhash64(*[F.get("words", F.col("at") + i) for i in fixed])
        fits = admits & (F.col("at") + len(mask) <= F.size("words"))
        seeds.append(F.struct(F.lit(number).alias("mask"), F.when(fits, seed).alias("seed")))
    every = placed.select(*keep, "at", F.explode(F.array(*seeds)).alias("s"))
    return every.select(*keep, "at", "s.mask", "s.seed").filter(F.col("seed").isNotNull())


def _compare(placed: DataFrame) -> DataFrame:
    """Compares the aligned words of each row: marks, a string of 1 (equal) and 0, for the item's whole overlap.

    `words` are the document's from where the overlap begins."""
    before = F.greatest(F.lit(0), -F.col("shift"))
    return placed.withColumn(
        "marks",
        F.concat_ws(
            "",
            F.transform(
                "words",
                lambda w, k: F.when(F.get("item_words", k + before) == w, "1").otherwise("0"),
            ),
        ),
    )


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every leak of a benchmark item in a document's whole text.

    Returns one row per document row, item and place: doc_id, text_key (hash of the
    text), item_id, start (word of the document where the item would begin),
    n_words (of the item), n_equal, n_compared, best_window (most equal words in a window).
    Null and empty texts leak nothing; repeated rows with equal text give one row together.
    """
    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    items = texts(benchmark, "item_id").select(F.col("doc_id").alias("item_id"), words(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0).distinct().withColumn("item_key", F.xxhash64("words"))
    long = F.least(F.size("words"), F.lit(max(settings.window, settings.least_words)))
    lengths = [r["n"] for r in items.select(long.alias("n")).distinct().collect()]
    runs: dict[int, list[int]] = {}
    for n in lengths:
        runs.setdefault(sure_run(n, settings), []).append(n)
    masks = [(m, F.lit(True)) for m in settings.masks] + [("1" * r, long.isin(found)) for r, found in sorted(runs.items())]
    theirs = _seeds(items, ["item_id", "item_key"], masks).withColumnRenamed("at", "item_at")
    ours = _seeds(
        keyed.select("doc_id", "text_key", words(F.col("text")).alias("words")),
        ["doc_id", "text_key"],
        [(m, F.lit(True)) for m, _ in masks],
    )
    if theirs.count() <= settings.broadcast_seeds:
        theirs = F.broadcast(theirs)
    met = ours.join(theirs, ["mask", "seed"])
    place = ["doc_id", "text_key", "item_id", "item_key", "shift"]
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    places = materialise(met.select(*place[:-1], shift).distinct(), "alignments")

    # The words of a document and of an item come to its alignments once they are distinct.
    theirs_at = F.collect_list(F.struct(*place[2:])).alias("places")
    by_doc = places.groupBy(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key")).agg(theirs_at)
    if places.count() <= settings.broadcast_seeds:
        by_doc = F.broadcast(by_doc)
    known = items.select(F.col("item_id").alias("i_id"), F.col("item_key").alias("i_key"), F.col("words").alias("item_words"))
    size = items.agg(F.sum(F.octet_length(F.concat_ws(" ", "words"))).alias("n")).first()["n"] or 0
    if size <= settings.broadcast_bytes:
        known = F.broadcast(known)
    here = (
        keyed.join(by_doc, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_key")))
        .select("doc_id", "text_key", words(F.col("text")).alias("words"), F.explode("places").alias("p"))
        .select("doc_id", "text_key", "words", "p.*")
        .join(known, F.col("item_id").eqNullSafe(F.col("i_id")) & (F.col("item_key") == F.col("i_key")))
    )
    start = F.greatest(F.lit(0), -F.col("shift"))
    end = F.least(F.size("item_words"), F.size("words") - F.col("shift"))
    overlap = F.slice("words", start + F.col("shift") + 1, end - start)
    compared = _compare(here.select(*place, "item_words", overlap.alias("words")))
    window = F.least(F.lit(settings.window), F.size("item_words"))
    counted = compared.select(
        *place[:-1],
        F.col("shift").cast("long").alias("start"),
        F.size("item_words").alias("n_words"),
        F.length(F.replace("marks", F.lit("0"), F.lit(""))).alias("n_equal"),
        F.length("marks").alias("n_compared"),
        window.alias("window"),
        F.array_max(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("marks") - window + 1)),
                lambda s: F.length(F.replace(F.substring(F.col("marks"), s, window), F.lit("0"), F.lit(""))),
            )
        ).alias("best_window"),
    )
    agrees = (F.col("best_window") >= settings.share * F.col("window")) | (
        F.col("n_equal") >= settings.item_share * F.col("n_words")
    )
    whole = F.col("n_equal") == F.col("n_words")
    leak = F.when(F.col("n_words") < settings.least_words, whole).otherwise(agrees)
    return counted.filter(leak).distinct().drop("window", "item_key")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` without a leak, with all their columns."""
    found = materialise(leaks(docs, benchmark, settings).select("doc_id", "text_key").distinct(), "leaking")
    if found.count() <= settings.broadcast_seeds:
        found = F.broadcast(found)
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["text_key"]
    )
    return docs.join(found, same, "left_anti")
