"""Conversation repair against every possible edit, and its SQL twin."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tests import oracle
from txrisk.llm import conversations as C

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, digest int, kind string, stretch string"
PATTERN = re.compile("(s?(ua)+)?")


def _faults(rows):
    """(role, text, fault) of rows in order."""
    seen, found = set(), []
    for role, text in rows:
        body = text.strip(C.BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role, text, fault))
    return found


def _every_repair(rows):
    """The least (cost, audit) and its texts, over all edits with up to two insertions in a place."""
    best = None
    letters = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, _, f in rows]
    inserts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*letters):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for place in range(len(rows) + 1):
                for who in gaps[place]:
                    cost, audit = cost + 3, audit + "I"
                    out.append((C.ROLE[who], ""))
                if place < len(rows):
                    (role, text, fault), edit = rows[place], edits[place]
                    audit += edit[0]
                    cost += {"D": 4, "K": 0, "R": 3}[edit[0]] + 3 * (fault == "truncated" and edit != "D")
                    if edit != "D":
                        out.append((C.ROLE[edit[1]] if edit[0] == "R" else role, text))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            if PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = (cost, audit, out)
    return best


def _plain_chain(rows):
    """(cost, audit) by a program that keeps whole strings."""
    inf = (10**9, "")
    insert = lambda s: {**s, 2: min([s[2]] + [(s[q][0] + 3, s[q][1] + "I") for q in (0, 1, 3)])}
    close = lambda s: (lambda t: {**t, 3: min(t[3], (t[2][0] + 3, t[2][1] + "I"))})(insert(s))
    state = close({0: (0, ""), 1: inf, 2: inf, 3: inf})
    for role, _, fault in rows:
        new = {q: (c + 4, a + "D") for q, (c, a) in state.items()}
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            for q, (letter, after) in enumerate(C.NEXT):
                c, a = state[q]
                new[after] = min(new[after], (c + 3 + more, a + "R"))
                if role[:1] == letter:
                    new[after] = min(new[after], (c + more, a + "K"))
            if role[:1] == "s":
                new[1] = min(new[1], (state[0][0] + more, state[0][1] + "K"))
        state = close(new)
    return min(state[0], state[3])


def _edits(rows, modulus=C.MODULUS):
    edits = C.Edits(0, C.Costs(), modulus)
    for role, _, fault in rows:
        edits.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    found = edits.found()
    return min(found[q] for q in C.ACCEPTED if found[q] is not None)


def _random_rows(rng, n):
    texts = ["Yes.", "No!", "cut", " ", "", "Why?  \n", "tail ", "é."]
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "bot", ""]), rng.choice(texts)) for _ in range(n)]


def test_edits_are_the_best_of_all():
    rng = random.Random(1)
    for n in (0, 1, 2, 2, 3, 3, 3):
        rows = _faults(_random_rows(rng, n))
        assert _edits(rows) == _every_repair(rows)[:2], rows


@pytest.mark.parametrize("modulus", [C.MODULUS, 7, 2, 1])
def test_collisions_are_verified(modulus):
    """With few different hashes nearly all comparisons collide; results stay the same."""
    rng = random.Random(2)
    for n in (1, 2, 5, 9, 17, 40, 90):
        for _ in range(12):
            rows = _faults([(r, f"{t}{i}" if rng.random() < 0.7 else t) for i, (r, t) in enumerate(_random_rows(rng, n))])
            assert _edits(rows, modulus) == _plain_chain(rows)


@pytest.mark.parametrize("modulus", [C.MODULUS, 3])
def test_comparison_of_audits(modulus):
    rng = random.Random(3)
    nodes = [C.Node(None, "", modulus)]
    made = {(0, "")}
    for _ in range(400):
        parent, letter = rng.randrange(len(nodes)), rng.choice("DIKR")
        if (parent, letter) not in made:
            made.add((parent, letter))
            nodes.append(C.Node(nodes[parent], letter, modulus))
    texts = [n.text() for n in nodes]
    for _ in range(3000):
        i, j = rng.randrange(len(nodes)), rng.randrange(len(nodes))
        assert C.less(nodes[i], nodes[j]) == (texts[i] < texts[j])
        assert nodes[i].ancestor(nodes[i].depth // 2).text() == texts[i][: nodes[i].depth // 2]


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "s") for r in rows], SCHEMA).repartition(5)


def _conversations(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn, (role, text) in enumerate(_random_rows(rng, rng.randint(1, 25))):
            where = rng.choice([turn, turn, turn, turn + 3, None])
            role, text = rng.choice([(role, text)] * 8 + [(None, text), (role, None)])
            rows.append((None if c == 0 else c * 11, where, role, text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return rows


def _expected(rows):
    """The report by the definition, for rows (conv_id, turn, role, text) after damage."""
    by_id: dict = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in by_id.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        known = [t for t, _, _ in own if t is not None]
        faults = _faults([r[1:] for r in own])
        initials = [r[:1] for r, _, _ in faults]
        cost, audit = _plain_chain(faults)
        kept, at, state = [], 0, 0
        for letter in audit:
            who, after = C.NEXT[state]
            if letter == "I":
                kept.append((C.ROLE[who], ""))
            else:
                role, text, _ = faults[at]
                at += 1
                if letter == "D":
                    continue
                kept.append((C.ROLE[who] if letter == "R" else role, text))
                after = 1 if letter == "K" and role[:1] == "s" else after
            state = after
        out.append((
            conv, max(known) - min(known) + 1 - len(set(known)) if known else 0,
            *[sum(f == k for _, _, f in faults) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        ))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("stretch", [1, 2, 5, 8192])
def test_report_by_definition(spark, stretch):
    """Short stretches cut every conversation, as ranges cut a long one; the result stays the same."""
    rows = _conversations(4)
    got = C.repair_report(_table(spark, rows), C.Settings(stretch=stretch))
    assert _sorted(got.collect()) == _sorted(_expected(rows))


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "", f"{t}!", f"{t}?"])) for t in range(700)]
    rows += [(1, 9000, "user", "again.")] * 300
    table = _table(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert _sorted(C.repair_report(table).collect()) == _sorted(_expected(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repaired_turns(spark):
    rows = _conversations(6, 20)
    turns = C.repaired_turns(_table(spark, rows)).collect()
    digests = {}
    for conv in {r[0] for r in rows}:
        own = sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.place)
        assert [t.place for t in own] == list(range(len(own)))
        assert PATTERN.fullmatch("".join(t.role[:1] for t in own))
        digests[conv] = hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest()
        assert {t.edit for t in own} <= set("KRI")
    assert digests == {r.conv_id: r.repaired_sha256 for r in C.repair_report(_table(spark, rows)).collect()}


def test_empty_and_dropped(spark):
    table = _table(spark, _conversations(7, 3))
    assert C.repair_report(table.limit(0)).count() == 0
    assert C.repaired_turns(table.limit(0)).count() == 0
    gone = C.repair_report(table.withColumn("copies", F.lit(0)))
    nothing = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in gone.collect()} == {(0, 0, 0, 0, 0, 0, "", nothing)}
    assert gone.count() == 3


def test_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "." + " " * 2_000_000)]
    assert _sorted(C.repair_report(_table(spark, rows)).collect()) == _sorted(_expected(rows))


def test_damage(spark):
    rows = _conversations(8, 60)
    want = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        want.append((conv, turn, "user" if fault == 4 else role, text, {0: 0, 3: 2}.get(fault, 1)))
    assert _sorted(C.damage(_table(spark, rows)).collect()) == _sorted(want)


def test_twin(spark):
    con = oracle.connect(SF)
    got = C.repair_report(C.damage(spark.read.parquet(f"{SF}/conversations.parquet")))
    want = con.execute(C.twin())
    assert [d[0] for d in want.description] == got.columns
    assert _sorted(got.collect()) == _sorted(want.fetchall())
