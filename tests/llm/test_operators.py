"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import time
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.llm import decontaminate, exact, html, jaccard, language, packing, phrases, quality, suffixes, toxicity
from txrisk.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, words string, row long, first int, key string"


def _documents(spark, rows):
    """rows of (doc_id, text) beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 0.5, "w", 1, 2, "k") for i, t in rows], SCHEMA)


def _corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = prose(60)
    base = prose(120)
    rows = []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            text = prose(rng.randint(1, 150))
        elif kind == 1:
            text = f"{prose(20)} {passage} {prose(rng.randint(0, 30))}"
        elif kind == 2:
            changed = base.split()
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            text = "  ".join(changed)
        elif kind == 3:
            text = "ab ab\tcd " * rng.randint(1, 60)
        elif kind == 4:
            text = rows[rng.randrange(len(rows))][1]
        else:
            text = prose(40) + " " + base[rng.randint(0, 50) :]
        rows.append((1000 - 7 * i, text))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "a" * 400), (5004, prose(4000)), (5005, "Été ÉTÉ ß " * 30)]
    return rows


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return _documents(spark, corpus).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return _documents(spark, []).select("*")


def _rows(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# -- quality, toxicity, language ---------------------------------------------------------------


def _held_out(spark, found, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(column).alias("label"))
    return found.join(labels, "doc_id").filter("held_out").toPandas()


def test_quality_held_out(spark):
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    found = quality.classify(*tables)
    h = _held_out(spark, found, "quality")
    assert (h["predicted"] == h["label"]).mean() > 0.95
    assert all((crc32(str(i).encode()) % 5 == 0) for i in h["doc_id"])
    assert found.agg(F.min("score") >= 0, F.max("score") <= 1).first()[:] == (True, True)


def test_toxicity_held_out(spark):
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    h = _held_out(spark, toxicity.classify(*tables), "toxic")
    assert (h["predicted"] == h["label"]).mean() > 0.9


def test_toxicity_learns_pairs(spark):
    """Two words that are harmless apart and toxic together: no sum of weights separates these."""
    rng = random.Random(1)
    rows = []
    for i in range(1600):
        a, b = i % 2, i // 2 % 2
        words = [f"w{rng.randrange(30)}" for _ in range(5)] + ["loser"] * a + ["people"] * b
        rows.append((i, " ".join(x.replace("w", "word") for x in words), int(a == b)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    settings = toxicity.Settings(least_z=0.0, stems=(), epochs=60)
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "label"), settings)
    scores = toxicity.score(frame, model, settings).join(frame, "doc_id").toPandas()
    assert ((scores["score"] > 0.5) == (scores["label"] == 1)).mean() > 0.95


def test_toxicity_learns_pairs_as_registered(spark):
    """With the settings of the query: neither word tells anything alone, so none may be left out for that."""
    rng = random.Random(1)
    rows = []
    for i in range(1600):
        a, b = i % 2, i // 2 % 2
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(5)] + ["loser"] * a + ["people"] * b
        rows.append((i, " ".join(words), int(a == b)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "label").filter("doc_id < 1200"))
    scores = toxicity.score(frame.filter("doc_id >= 1200"), model).join(frame, "doc_id").toPandas()
    assert ((scores["score"] > 0.5) == (scores["label"] == 1)).mean() > 0.95


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The rows of the sample never reach the driver, and the join is the same at any size."""
    driver, descend = os.getpid(), toxicity._descend

    def elsewhere(*given):
        assert os.getpid() != driver
        return descend(*given)

    monkeypatch.setattr(toxicity, "_descend", elsewhere)
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    plans = []
    write = toxicity.materialise
    monkeypatch.setattr(toxicity, "materialise", lambda f, name: plans.append(f._jdf.queryExecution().toString()) or write(f, name))
    model = toxicity.fit(docs, labels)
    assert len(model.index) and model.factor.shape == (len(model.index), toxicity.Settings().factors)
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_toxicity_sample_by_bounds(spark):
    """Rows left out by the bound on the hash change nothing, also where one id has very many rows."""
    frame = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("doc_id"), (F.col("id") % 2).alias("label"))
    for n in (0, 1, 50, 1499, 2999, 3000, 5000):
        plain = frame.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(n)
        assert toxicity.least_rows(frame, n, 3000).collect() == plain.collect()


def test_classifiers_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in (1000, 993)] + [(None, 1, 1), (986, None, None), (979, 0, 1), (972, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    for classify in (quality.classify, toxicity.classify):
        found = classify(docs.union(docs.limit(3)), labels)
        assert found.count() == docs.count() + 3
        assert found.filter("score is null or score < 0 or score > 1").isEmpty()
        assert classify(none, labels).isEmpty()
        assert classify(docs, labels.limit(0)).count() == docs.count()


def test_language(spark, docs, none):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.identify(real).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97
    odd = _rows(language.identify(docs))
    assert odd[5000]["lang_pred"] == odd[5001]["lang_pred"] == odd[5002]["lang_pred"] == "und"
    assert language.identify(none).isEmpty()
    nobody = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert [r["lang_pred"] for r in nobody.select("lang_pred").distinct().collect()] == ["und"]


def test_language_filter_names_every_language(spark):
    texts = {"a": "aaaa bbbb", "b": "bbbb cccc"}
    frame = spark.createDataFrame([(i, t * 5, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    model = language.fit(frame, language.Settings(share=0.0))
    mask = model.contains(language.grams("bbbb", 3))[1]
    assert int(mask[0]) == 3


# -- packing -----------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, corpus, none):
    from tokenizers import Tokenizer

    settings = packing.Settings(tokenizer_path(), block_tokens=3000, cached_bytes=8000)
    odd = corpus + [
        (7000, "it's don't 'S o'clock. áb \x1c z\x85q İstanbul ΣΑΣ. 12.5 ...! <|endoftext|> hi"),
        (7001, " .a ,.b ' 3rd x1. I'LL ½ naïve été ﬁ x　y"),
    ]
    pieces = packing.pack_documents(_documents(spark, odd).repartition(3), settings, with_ids=True).toPandas()
    encode = Tokenizer.from_file(settings.tokenizer).encode
    for i, text in odd:
        mine = pieces[pieces["doc_id"] == i].sort_values("start")
        want = [*encode(text or "", add_special_tokens=False).ids, settings.end_id]
        assert [x for ids in mine["ids"] for x in ids] == want
        assert set(mine["doc_tokens"]) == {len(want)}
        assert list(mine["start"]) == [0, *np.cumsum(mine["length"])[:-1]]
    for r in pieces.itertuples():
        assert r.ids_crc32 == crc32(np.asarray(r.ids, "<u4").tobytes())
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]]
        n = s["length"].sum()
        assert n == settings.limit or n < settings.limit and n & (n - 1) == 0
    assert packing.pack_documents(none, settings).isEmpty()


def test_packing_balances_cost():
    settings = packing.Settings("", limit=64)
    placed = packing.pack([10] * 32, settings)
    load = np.bincount([p[3] for p in placed], [settings.cost(p[2]) for p in placed])
    assert load.max() / load.min() < 1.3


# -- exact duplicates --------------------------------------------------------------------------


def _exact_by_hand(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    return {
        i: (min(j for j, u in norm if u == t), sum(u == t for _, u in norm), hashlib.sha256(t.encode()).hexdigest())
        for i, t in norm
    }


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.substring(F.sha2(F.encode(t, "UTF-8"), 256), 1, 1)])
def test_exact(spark, docs, corpus, tmp_path, digest):
    """The second digest has 16 values only: every hit must be told apart by its bytes."""
    docs.write.parquet(str(tmp_path / "d"))
    want = _exact_by_hand(corpus)
    got = _rows(exact.deduplicate(spark, str(tmp_path / "d"), digest))
    assert {i: (r["keep_id"], r["group_size"], r["text_sha256"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["keep_id"]) for i, r in got.items())


def test_exact_goes_on_with_its_state(spark, docs, tmp_path):
    path, state = str(tmp_path / "d"), str(tmp_path / "s")
    docs.write.parquet(path)
    once = exact.advance(spark, path, state).agg(F.sum("copies")).first()[0]
    docs.limit(7).write.mode("append").parquet(path)
    assert exact.advance(spark, path, state).agg(F.sum("copies")).first()[0] == once + 7


def test_exact_reads_added_files_of_any_age(spark, docs, tmp_path):
    path, state = tmp_path / "d", str(tmp_path / "s")
    docs.write.parquet(str(path))
    once = exact.advance(spark, str(path), state).agg(F.sum("copies")).first()[0]
    seen = set(path.iterdir())
    docs.limit(7).write.mode("append").parquet(str(path))
    month_ago = time.time() - 30 * 86400
    for added in set(path.iterdir()) - seen:
        os.utime(added, (month_ago, month_ago))
    assert exact.advance(spark, str(path), state).agg(F.sum("copies")).first()[0] == once + 7


def test_exact_odd_rows(spark, none, tmp_path):
    rows = [(1, "x"), (1, "x"), (None, "x"), (None, "y"), (None, "y"), (2, "z\n"), (3, "z ")]
    left = exact.drop_copies(_documents(spark, rows))
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("1", "x"), ("2", "z\n"), ("None", "y")]
    assert left.columns == none.columns
    assert exact.drop_copies(none).isEmpty()


# -- pages -------------------------------------------------------------------------------------


def test_pages(spark):
    def page(i, body):
        return (
            f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav>"
            f"<div class='ad'>Buy {i}</div>{body}<div class=\"comments\"><p>first!</p></div><footer>&copy; x</footer></body>"
        )

    rows = [(i, "http://a.example/x", page(i, f"<article><h1>Head {i}</h1><p>One {i} &amp; <b>tw</b>o<br>three {i}<script>var t='</p>';</script></p></article>")) for i in range(12)]
    rows += [(i, "http://b.example/y", page(i, f"<div id='content'><p>Text number {i} is long enough.</p></div>")) for i in range(20, 32)]
    rows += [(40, None, None), (41, "", ""), (42, "http://c.example", "plain &lt;text"), (43, "http://c.example", "<nav>x</nav")]
    frame = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in html.extract(frame).collect()}
    assert got[3]["text"] == "Head 3 One 3 & two three 3" and got[3]["n_chars"] == 26
    assert got[25]["text"] == "Text number 25 is long enough."
    assert got[40]["text"] == got[41]["text"] == "" and got[42]["text"] == "plain <text"
    assert len(got) == len(rows)
    assert html.extract(frame.limit(0)).isEmpty()


def test_pages_keep_what_copies_and_articles_repeat(spark):
    """27 copies of one page beside three others, and a paragraph that all articles of a host share."""
    copy = "<body><article><p>The copied page.</p></article></body>"
    bare = "<body><p>Only text of a bare copy.</p></body>"
    rows = [(i, "http://a.example/", copy) for i in range(27)]
    rows += [(i, "http://a.example/", f"<body><article><p>Page {i}.</p></article></body>") for i in range(27, 30)]
    rows += [(i, "http://b.example/", f"<body><article><p>Same words.</p><p>Page {i}.</p></article></body>") for i in range(40, 55)]
    rows += [(i, "http://c.example/", bare) for i in range(60, 87)]
    rows += [(i, "http://c.example/", f"<body><p>Bare {i}.</p></body>") for i in range(87, 90)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "The copied page." and got[28] == "Page 28."
    assert got[41] == "Same words. Page 41."
    assert got[61] == "Only text of a bare copy." and got[88] == "Bare 88."


# -- near duplicates ---------------------------------------------------------------------------


def _components_by_hand(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent", "rows"), [(3, 90, 256), (5, 80, 256), (3, 60, 4)])
def test_jaccard(docs, corpus, size, percent, rows):
    settings = jaccard.Settings(size, percent, rows=rows, columns=64, bucket_chars=2000, broadcast_rows=0 if rows == 4 else 200_000)
    got = _rows(jaccard.join_components(docs, settings))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == _components_by_hand(corpus, size, percent)


def test_jaccard_product_bounds():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    settings = jaccard.Settings(percent=50, columns=8)
    got = jaccard.overlaps(sets, sets, settings)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * both >= 50 * (len(a) + len(b) - both))


def test_jaccard_odd_rows(spark, none):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (5, "A\tB  C D"), (6, None), (7, "x"), (8, "X"), (9, "")]
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard.join_components(_documents(spark, rows)).collect())
    assert got == [("4", 4), ("4", 4), ("5", 4), ("6", 6), ("7", 7), ("8", 7), ("9", 9), ("None", 4)]
    assert jaccard.join_components(none).isEmpty()
    assert jaccard.keep_one(none).columns == none.columns


# -- benchmark ---------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontaminate(spark, docs, none, broadcast):
    rng = random.Random(9)
    item = [f"item{rng.randrange(1000)}" for _ in range(40)]
    swapped = [w if k % 5 != 3 else "other" for k, w in enumerate(item)]
    rows = [
        (1, " ".join(["pre"] * 9 + item + ["post"])),
        (2, "Pre! " + ", ".join(swapped).upper()),
        (3, " ".join(item[10:24])),
        (4, " ".join(item[:4] + ["x"] * 30 + item[4:8])),
        (5, None),
        (6, ""),
        (None, " ".join(item)),
        (7, " ".join(w for w in reversed(item))),
    ]
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, "too short", 0), (3, None, 0)], "item_id long, text string, seed int")
    settings = decontaminate.Settings(broadcast_seeds=broadcast)
    frame = _documents(spark, rows)
    found = decontaminate.leaks(frame, bench, settings).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, None}
    first = next(r for r in found if r["doc_id"] == 1)
    assert (first["start"], first["n_words"], first["n_equal"]) == (9, 40, 40)
    kept = decontaminate.drop_leaking(frame, bench, settings)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7] and kept.columns == frame.columns
    assert decontaminate.leaks(docs, bench, settings).isEmpty()
    assert decontaminate.leaks(none, bench, settings).isEmpty()
    assert decontaminate.leaks(frame, bench.limit(0), settings).isEmpty()


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontaminate_misses_no_window(spark, broadcast):
    """Every way to substitute as many words as the window rule allows, and short items word for word."""
    settings = decontaminate.Settings(broadcast_seeds=broadcast)
    bench, rows = [], []
    for n in (2, 6, 7, 8, 10, 12, 13, 20):
        item = [f"i{n}w{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        size = min(n, settings.window)
        others = 0 if n < settings.least_words else size - next(k for k in range(size + 1) if k >= settings.share * size)
        for places in itertools.combinations(range(size), others):
            part = ["other" if k in places else w for k, w in enumerate(item[:size])]
            rows.append((1000 * n + len(rows), " ".join(["pre", *part, "post"])))
    bench_frame = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.leaks(_documents(spark, rows), bench_frame, settings).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in rows}
    half = _documents(spark, [(1, "i6w0 i6w1 i6w2 i6w3 i6w4 other"), (2, "i2w0 other")])
    assert decontaminate.leaks(half, bench_frame, settings).isEmpty()


# -- repeated substrings -----------------------------------------------------------------------


def _removed_by_hand(rows, length, words):
    seen, found = set(), {}
    for i, t in sorted(rows):
        units = (t or "").encode()
        units = units.split() if words else [units[k : k + 1] for k in range(len(units))]
        gone = [False] * len(units)
        for p in range(len(units) - length + 1):
            window = tuple(units[p : p + length])
            if window in seen:
                gone[p : p + length] = [True] * length
            seen.add(window)
        kept = (b" " if words else b"").join(u for u, g in zip(units, gone, strict=True) if not g)
        found[i] = (len(units), sum(gone), hashlib.sha256(kept).hexdigest())
    return found


@pytest.mark.parametrize("hot", [50_000, 1])
@pytest.mark.parametrize("length", [20, 5, 1])
def test_phrases(docs, corpus, monkeypatch, hot, length):
    make = phrases.words_of
    monkeypatch.setattr(phrases, "words_of", lambda n: make(n).__class__(**{**make(n).__dict__, "hot": hot}))
    monkeypatch.setattr(phrases, "PATTERNS", 7)
    got = _rows(phrases.remove_repeats(docs, length, with_text=True))
    want = _removed_by_hand(corpus, length, words=True)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want


@pytest.mark.parametrize("hot", [50_000, 1])
@pytest.mark.parametrize("length", [100, 33, 7])
def test_suffixes(docs, corpus, monkeypatch, hot, length):
    make = suffixes.bytes_of
    monkeypatch.setattr(suffixes, "bytes_of", lambda n: make(n).__class__(**{**make(n).__dict__, "hot": hot}))
    got = _rows(suffixes.remove_repeats(docs, length))
    want = _removed_by_hand(corpus, length, words=False)
    assert {i: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want


def test_substrings_odd_rows(spark, none):
    text = "one two three four five six"
    rows = [(1, text), (1, text), (1, "zzz " + text), (None, text), (None, None), (2, text)]
    for remove in (phrases.remove_repeats, suffixes.remove_repeats):
        found = remove(_documents(spark, rows), 5).collect()
        assert len(found) == len(rows)
        # of the three rows with id 1 the least text comes first
        assert sum(r["n_removed"] == 0 for r in found if r["doc_id"] == 1) == 1
        assert all(r["n_removed"] > 0 for r in found if r["doc_id"] == 2)
        assert remove(none, 5).isEmpty()
