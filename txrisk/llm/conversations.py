"""Repair of the structure of conversations, with an audit of the edits.

The rows of a conversation are taken by turn (nulls first); rows of one turn
by role, then by the SHA-256 of their text, so that equal rows are adjacent.
The first fault of a row counts: blank (no word), duplicate (role and text
seen earlier in the conversation), truncated (no end mark).

A repair keeps, reroles, deletes and inserts rows until the initials of the
roles read `(s?(ua)+)?`.  A dynamic program over the four states of that
pattern finds the cheapest edits.  Each state holds its audit, the initials of
its edits, as the last node of a chain; audits share their prefixes.  A node
knows its ancestors 1, 2, 4, ... steps up and a rolling hash of its audit.  Of
equally cheap audits the ASCII-least wins: the longest common prefix is searched
by those ancestors and hashes, and what the hashes call equal is verified.

Two audits of one state and one row that cost the same are never prefixes of
each other, as every insertion costs; so the better one stays better whatever
follows, and stretches of a conversation can be solved apart.  Spark sorts all
rows into ranges, which may cut a conversation; each range yields, for each of
its conversations, the best audit from every state to every state, and these
are joined in order.  Equal rows are counted first and sorted once.

Null roles and texts count as one space, and null conversation ids form one
conversation.  Empty tables give no rows.  A conversation's repaired text is
written by one task in order, row by row, so its memory holds the audit but
not the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.session import materialise

# States: nothing yet, after s, after u, after a.
STATES, ACCEPTED = 4, (0, 3)
# What may follow each state: a user everywhere but after a user, else an assistant.
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
ROLE = {"u": "user", "a": "assistant"}
DROPS, EMPTIES, UNMARKS, REPEATS, REROLES = range(5)
BLANKS = " \t\n\x0b\f\r"
MODULUS, BASE = (1 << 61) - 1, 1_000_003
LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


@dataclass(frozen=True)
class Settings:
    costs: Costs = Costs()
    # A conversation is cut after so many different rows, which bounds the nodes a task holds.
    stretch: int = 8192


class Node:
    """The last edit of an audit; the ones before it are its ancestors."""

    __slots__ = ("up", "letter", "depth", "hash")

    def __init__(self, parent: Node | None, letter: str, modulus: int = MODULUS):
        self.letter = letter
        if parent is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        up, at, k = [parent], parent, 0
        while k < len(at.up):
            at = at.up[k]
            up.append(at)
            k += 1
        self.up = tuple(up)
        self.depth = parent.depth + 1
        self.hash = (parent.hash * BASE + ord(letter)) % modulus

    def ancestor(self, depth: int) -> Node:
        node, steps = self, self.depth - depth
        while steps:
            node = node.up[steps.bit_length() - 1]
            steps -= 1 << (steps.bit_length() - 1)
        return node

    def text(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.up[0]
        return "".join(reversed(letters))


def same(a: Node, b: Node) -> bool:
    """Whether two audits of one length are equal, letter by letter back to where they meet."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether the audit of `a` is ASCII-less than that of `b`."""
    if a is b:
        return False
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if x.hash == y.hash:
        return a.depth < b.depth if same(x, y) else a.text() < b.text()
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if not same(x.up[0], y.up[0]):  # a collision hid the first difference
        return a.text() < b.text()
    return x.letter < y.letter


Layer = list[tuple[int, Node] | None]


class Edits:
    """The cheapest audits from one state to each, extended row by row."""

    def __init__(self, start: int, costs: Costs, modulus: int = MODULUS):
        self.costs, self.modulus = costs, modulus
        self.layer: Layer = [None] * STATES
        self.layer[start] = (0, Node(None, "", modulus))
        self._insert()

    def _offer(self, layer: Layer, state: int, cost: int, parent: Node, letter: str) -> None:
        held = layer[state]
        if held is None or cost < held[0]:
            layer[state] = (cost, Node(parent, letter, self.modulus))
        elif cost == held[0]:
            node = Node(parent, letter, self.modulus)
            if less(node, held[1]):
                layer[state] = (cost, node)

    def _insert(self) -> None:
        """Insertions after the last row, from the cheapest state on."""
        left = set(range(STATES))
        while left:
            state = min(left, key=lambda q: (self.layer[q] is None, self.layer[q] and self.layer[q][0], q))
            left.discard(state)
            if self.layer[state] is not None:
                cost, node = self.layer[state]
                self._offer(self.layer, NEXT[state][1], cost + self.costs.insert, node, "I")

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        costs, layer = self.costs, [None] * STATES
        extra = costs.truncated if truncated else 0
        for state, held in enumerate(self.layer):
            if held is None:
                continue
            cost, node = held
            self._offer(layer, state, cost + costs.delete, node, "D")
            if must_go:
                continue
            letter, after = NEXT[state]
            self._offer(layer, after, cost + extra + costs.rerole, node, "R")
            if initial == letter:
                self._offer(layer, after, cost + extra, node, "K")
            elif initial == "s" and state == 0:
                self._offer(layer, 1, cost + extra, node, "K")
        self.layer = layer
        self._insert()

    def found(self) -> list[tuple[int, str] | None]:
        return [held and (held[0], held[1].text()) for held in self.layer]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of a table of conversations after the faults that a hash of each row's place asks for.

    conv_id, turn, role, text, copies; a dropped row has no copies.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    text = blank("text")
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == REROLES, "user").otherwise(blank("role")).alias("role"),
        F.when(fault == EMPTIES, "").when(fault == UNMARKS, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == DROPS, 0).when(fault == REPEATS, 2).otherwise(1).cast("long").alias("copies"),
    )


def _rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies with nulls filled, and the digest that orders texts."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    return turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        copies.cast("long").alias("copies"),
    ).withColumn("digest", F.sha2("text", 256))


def _facts(rows: DataFrame) -> DataFrame:
    """Different rows with their copies and faults; no texts."""
    body = F.rtrim("text", F.lit(BLANKS))
    counted = rows.filter("copies > 0").groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"),
        F.first(body == "").alias("blank"),
        F.first(~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("unended"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = counted.groupBy(*[F.col(c).alias(f"seen_{c}") for c in ("conv_id", "role", "digest")]).agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("places")
    )
    again = seen.filter("places > 1")
    same_row = F.lit(True)
    for c in ("conv_id", "role", "digest"):
        same_row &= F.col(c).eqNullSafe(F.col(f"seen_{c}"))
    late = F.coalesce(F.col("first.known") != F.col("turn").isNotNull(), F.lit(False)) | F.coalesce(
        F.col("first.turn") != F.col("turn"), F.lit(False)
    )
    return counted.join(again, same_row, "left").select(
        "conv_id", "turn", "role", "digest", "copies", "blank", "unended",
        F.substring("role", 1, 1).alias("initial"), late.alias("late"),
    )


_SUMS = ("n_rows", "turns", "blank", "duplicate", "truncated", "illegal")
_ENDS = ("first_turn", "last_turn")
_MARKS = ("first_initial", "last_initial")
_STRETCH = (
    "stretch long, " + ", ".join(f"{c} long" for c in (*_SUMS, *_ENDS)) + ", "
    + ", ".join(f"{c} string" for c in _MARKS) + ", costs array<long>, audits array<string>"
)


class _Stretch:
    """Counts of some consecutive rows of a conversation, and their cheapest edits."""

    def __init__(self, conv_id, starts: list[int], settings: Settings):
        self.conv_id, self.starts, self.different = conv_id, starts, 0
        self.edits = [Edits(s, settings.costs) for s in starts]
        self.sums = dict.fromkeys(_SUMS, 0)
        self.ends = dict.fromkeys(_ENDS)
        self.marks = dict.fromkeys(_MARKS)

    def add(self, turn, initial: str, copies: int, blank: bool, unended: bool, late: bool) -> None:
        sums, ends, marks = self.sums, self.ends, self.marks
        self.different += 1
        if turn is not None and turn != ends["last_turn"]:
            sums["turns"] += 1
            ends["last_turn"] = turn
            if ends["first_turn"] is None:
                ends["first_turn"] = turn
        truncated = not (blank or late) and unended
        sums["n_rows"] += copies
        sums["blank"] += copies * blank
        sums["duplicate"] += 0 if blank else copies - (not late)
        sums["truncated"] += truncated
        if marks["first_initial"] is None:
            marks["first_initial"] = initial
        else:
            sums["illegal"] += not legal(marks["last_initial"], initial)
        sums["illegal"] += (copies - 1) * (not legal(initial, initial))
        marks["last_initial"] = initial
        for edits in self.edits:
            edits.row(initial, blank or late, truncated)
            for _ in range(copies - 1):
                edits.row(initial, True, False)

    def row(self) -> dict:
        costs, audits = [None] * STATES**2, [None] * STATES**2
        for start, edits in zip(self.starts, self.edits, strict=True):
            for end, held in enumerate(edits.found()):
                if held is not None:
                    costs[STATES * start + end], audits[STATES * start + end] = held
        return {**self.sums, **self.ends, **self.marks, "costs": costs, "audits": audits}


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


_FACTS = ("conv_id", "turn", "initial", "copies", "blank", "unended", "late")


def _stretches(facts: DataFrame, settings: Settings) -> DataFrame:
    """One row for each conversation in each range of rows, in the order of `stretch`."""
    kind = facts.schema["conv_id"].dataType.simpleString()
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    ranged = facts.repartitionByRange(*order).sortWithinPartitions(*order).select(*_FACTS)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only the first conversation of a range can have begun before it.
        task, number, at = TaskContext.get().partitionId() << 32, 0, None
        done: list[tuple] = []

        def closed() -> Iterator[pa.RecordBatch]:
            rows = [{"stretch": task + n, **s.row()} for n, s in done]
            ids = pa.array([s.conv_id for _, s in done], ids_type)
            fields = list(rows[0])
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array([r[f] for r in rows], _ARROW.get(f, pa.int64())) for f in fields]], names=["conv_id", *fields]
            )
            done.clear()

        ids_type = None
        for batch in batches:
            ids_type = batch.schema.field("conv_id").type
            for conv_id, *fact in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at is None or at.conv_id != conv_id or at.different >= settings.stretch:
                    whole = at is not None and at.conv_id != conv_id
                    if at is not None:
                        done.append((number, at))
                        number += 1
                    at = _Stretch(conv_id, [0] if whole else list(range(STATES)), settings)
                    if len(done) >= 512:
                        yield from closed()
                at.add(*fact)
        if at is not None:
            done.append((number, at))
            yield from closed()

    return ranged.mapInArrow(solve, f"conv_id {kind}, {_STRETCH}")


_ARROW = {
    **dict.fromkeys(_MARKS, pa.string()),
    "costs": pa.list_(pa.int64()),
    "audits": pa.list_(pa.string()),
}


class _Repair:
    """A conversation while its stretches, then its rows, come by in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.best: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self.sums = dict.fromkeys(_SUMS, 0)
        self.first_turn = self.last_turn = self.last_initial = None
        self.audit, self.at, self.state = None, 0, 0

    def join(self, s: dict) -> None:
        for name in _SUMS:
            self.sums[name] += s[name]
        if s["first_turn"] is not None:
            self.sums["turns"] -= s["first_turn"] == self.last_turn
            self.first_turn = s["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = s["last_turn"]
        if self.last_initial is not None:
            self.sums["illegal"] += not legal(self.last_initial, s["first_initial"])
        self.last_initial = s["last_initial"]
        found: list[tuple[int, str] | None] = [None] * STATES
        for end in range(STATES):
            ways = [
                (held[0] + s["costs"][STATES * q + end], held[1] + s["audits"][STATES * q + end])
                for q, held in enumerate(self.best)
                if held is not None and s["costs"][STATES * q + end] is not None
            ]
            found[end] = min(ways, default=None)
        self.best = found

    def decide(self) -> None:
        self.cost, self.audit = min(self.best[q] for q in ACCEPTED if self.best[q] is not None)

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            letter, self.state = NEXT[self.state]
            self.at += 1
            yield "I", ROLE[letter], ""

    def edit(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands in the place of a row, insertions before it included."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            letter, self.state = NEXT[self.state]
            yield edit, ROLE[letter], text
        elif edit == "K":
            self.state = 1 if role[:1] == "s" else NEXT[self.state][1]
            yield edit, role, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()

    def facts(self) -> dict:
        spread = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.sums["turns"]
        return {
            "conv_id": self.conv_id, "gaps": spread if spread <= LONGEST else None,
            **{c: self.sums[c] for c in ("blank", "duplicate", "truncated", "illegal")},
            "cost": self.cost, "audit": self.audit,
        }


def _replay(turns: DataFrame, settings: Settings) -> DataFrame:
    """Stretches, then rows with texts, of each conversation one after the other in one task."""
    rows = _rows(turns)
    stretches = materialise(_stretches(_facts(rows), settings), "stretches")
    parts = [
        turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind")),
        stretches.withColumn("kind", F.lit(1)),
        rows.filter("copies > 0").withColumn("kind", F.lit(2)),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "stretch", "turn", "role", "digest")]
    return every.repartition("conv_id").sortWithinPartitions(*order)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Repair, Iterator[tuple[str, str, str]]]]:
    """Yields each conversation with the pieces of its repair, in order; the last piece list ends it."""
    now = None
    for batch in batches:
        names = batch.schema.names
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for values in zip(*[c.to_pylist() for c in piece.columns], strict=True):
                row = dict(zip(names, values, strict=True))
                if row["kind"] == 0:
                    if now is not None:
                        yield now, None
                    now = _Repair(row["conv_id"])
                elif row["kind"] == 1:
                    now.join(row)
                else:
                    if now.audit is None:
                        now.decide()
                    for _ in range(row["copies"]):
                        yield now, now.edit(row["role"], row["text"])
    if now is not None:
        yield now, None


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "place long, role string, text string, edit string"


def _emit(frame: DataFrame, fields: str, collect) -> DataFrame:
    kind = frame.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[f.split()[0] for f in fields.split(", ")]]
    types = [pa.int64() if f.endswith(" long") else pa.string() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        weight, id_type = 0, None

        def full() -> pa.RecordBatch:
            columns = [pa.array([r[n] for r in held], t) for n, t in zip(names, [id_type, *types], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("conv_id").type
                yield batch

        for row in collect(_conversations(watched())):
            held.append(row)
            weight += 100 + len(row.get("text") or "") + len(row.get("audit") or "")
            if weight > 2_000_000:
                yield full()
                held, weight = [], 0
        if held:
            yield full()

    return frame.mapInArrow(run, f"conv_id {kind}, {fields}")


def repaired_turns(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I).

    `turns` has conv_id, turn, role, text and, if rows stand for several, copies;
    other columns are left out.
    """

    def collect(found):
        place: dict = {"of": None, "n": 0}
        for repair, pieces in found:
            if place["of"] is not repair:
                place = {"of": repair, "n": 0}
            if pieces is None and repair.audit is None:
                repair.decide()
            for edit, role, text in repair.rest() if pieces is None else pieces:
                yield {"conv_id": repair.conv_id, "place": place["n"], "role": role, "text": text, "edit": edit}
                place["n"] += 1

    return _emit(_replay(turns, settings), _TURNS, collect)


def repair_report(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its repair, and the
    SHA-256 of the repaired `role:text`, newline-joined."""

    def collect(found):
        of, digest, n = None, None, 0
        for repair, pieces in found:
            if of is not repair:
                of, digest, n = repair, hashlib.sha256(), 0
            if pieces is None and repair.audit is None:
                repair.decide()
            for _, role, text in repair.rest() if pieces is None else pieces:
                digest.update((("\n" if n else "") + f"{role}:{text}").encode())
                n += 1
            if pieces is None:
                yield {**repair.facts(), "repaired_sha256": digest.hexdigest()}

    return _emit(_replay(turns, settings), _REPORT, collect)


def _way(name: str, cost: str, letter: str, line: str = "''") -> str:
    return f"struct_pack(c := {name}.c + {cost}, a := {name}.a || '{letter}', t := {name}.t || {line})"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def twin() -> str:
    """damage() and repair_report() in DuckDB's SQL: the four states as (cost, audit, text)."""
    line, none = "chr(10) || role || ':' || text", "struct_pack(c := 1000000000, a := '', t := '')"
    gone = [_way(f"s{q}", "4", "D") for q in range(STATES)]

    def kept(before: str, initial: str) -> str:
        return f"CASE WHEN must_go OR initial <> '{initial}' THEN {none} ELSE {_way(before, 'extra', 'K', line)} END"

    def rerolled(before: str, role: str) -> str:
        return f"CASE WHEN must_go THEN {none} ELSE {_way(before, '3 + extra', 'R', f"chr(10) || '{role}:' || text")} END"

    def inserted(before: str, role: str) -> str:
        return _way(before, "3", "I", f"chr(10) || '{role}:'")

    to_user = ("s0", "s1", "s3")
    t2 = _least(gone[2], *[way for s in to_user for way in (kept(s, "u"), rerolled(s, "user"))])
    u2 = _least("s2", *[inserted(s, "user") for s in to_user])
    bits = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: {bits})"
    key = "string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN {key}]), lambda a, b: {byte}), 4294967295)"
    closed = f"SELECT conv_id, n, s0, s1, s2, {_least('s3', inserted('s2', 'assistant'))} AS s3 FROM (SELECT conv_id, n, s0, s1, {u2} AS s2, s3 FROM"
    return f"""
    WITH RECURSIVE hashed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fault FROM conversations),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM hashed),
    placed AS (
      SELECT *, row_number() OVER w AS n, left(role, 1) AS initial, left(lag(role) OVER w, 1) AS before,
        NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended
      FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
    faulty AS (
      SELECT *, blank OR late AS must_go, CASE WHEN unended AND NOT blank AND NOT late THEN 3 ELSE 0 END AS extra
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS late FROM placed)),
    solved AS (
      {closed} (SELECT DISTINCT conv_id, 0 AS n, struct_pack(c := 0, a := '', t := '') AS s0, {none} AS s1, {none} AS s2, {none} AS s3
        FROM conversations))
      UNION ALL
      {closed} (SELECT solved.conv_id, faulty.n, {gone[0]} AS s0, {_least(gone[1], kept("s0", "s"))} AS s1, {t2} AS s2,
          {_least(gone[3], kept("s2", "a"), rerolled("s2", "assistant"))} AS s3
        FROM solved JOIN faulty ON faulty.conv_id IS NOT DISTINCT FROM solved.conv_id AND faulty.n = solved.n + 1))),
    best AS (
      SELECT conv_id, {_least("s0", "s3")} AS s FROM solved
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
    counted AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
        count_if(late AND NOT blank) AS duplicate, count_if(extra > 0) AS truncated,
        count_if(n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
      FROM faulty GROUP BY conv_id)
    SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
      CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
      CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(s.c AS BIGINT) AS cost, s.a AS audit, sha256(substr(s.t, 2)) AS repaired_sha256
    FROM best LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM best.conv_id"""
