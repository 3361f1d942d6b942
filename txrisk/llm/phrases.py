"""Repeated-phrase automata: passages that recur anywhere in the corpus.

A passage is confirmed if its words occur at two places.  Candidates are found
by anchors (see `repeats`) and dealt out by them, so a passage and all places
where it may occur meet in one shard.  Each shard confirms its passages, compiles them into
Aho-Corasick automata of bounded size, and streams the stretches of all documents that came to
it through them to locate every occurrence; the first one stays.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm import repeats

PATTERNS = 20_000  # of one automaton


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def words_of(length: int) -> repeats.Units:
    return repeats.Units(
        split=lambda text: text.encode().split(),
        hashes=_word_hashes,
        join=b" ".join,
        length=length,
        gram=min(4, length),
    )


def automata(length: int):
    """Compares stretches of words by Aho-Corasick automata; see `repeats.later_windows`."""

    def compare(cuts: list[bytes], doc, tag, start) -> tuple[list[int], list[int]]:
        letters: dict[bytes, str] = {}
        # each word of the shard becomes one letter (surrogates left out)
        texts = []
        for cut in cuts:
            spelt = []
            for word in cut.split(b" "):
                letter = letters.get(word)
                if letter is None:
                    n = len(letters) + 1
                    letter = letters[word] = chr(n if n < 0xD800 else n + 0x800)
                spelt.append(letter)
            texts.append("".join(spelt))
        seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        confirmed = [p for p, n in seen.items() if n > 1]
        rows, places = [], []
        for first in range(0, len(confirmed), PATTERNS):
            machine = ahocorasick.Automaton()
            for number, passage in enumerate(confirmed[first : first + PATTERNS]):
                machine.add_word(passage, number)
            machine.make_automaton()
            # runs come sorted by document and start, but runs of one document may overlap
            best: dict[int, tuple] = {}
            met: list[tuple[int, int, tuple]] = []
            for row, text in enumerate(texts):
                for end, number in machine.iter(text):
                    at = end - length + 1
                    place = (doc[row], tag[row], start[row] + at)
                    met.append((row, number, place))
                    if number not in best or place < best[number]:
                        best[number] = place
            for row, number, place in met:
                if place != best[number]:
                    rows.append(row)
                    places.append(int(place[2] - start[row]))
        return rows, places

    return compare


def remove_repeats(docs: DataFrame, length: int = 20, with_text: bool = False) -> DataFrame:
    """Removes every word that a window of `length` words covers which also starts earlier.

    Returns doc_id, n_words, n_removed, n_spans, kept_sha256 (and kept, the words left joined by a blank);
    see `repeats.remove` for nulls, repeated rows and ties.
    """
    found = repeats.remove(docs, words_of(length), automata(length), with_text)
    return found.withColumn("n_words", F.col("n_units")).select(
        "doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])
    )
