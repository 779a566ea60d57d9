r"""Conversation structure repair (operator 12).

A conversation's rows, in order, pass an edit lattice of nodes (rows consumed, grammar state). Its edges keep a row whose role the grammar
allows, give it the role that the grammar allows (user or assistant), delete it, or insert an empty row; the grammar is `(s?(ua)+)?`
over the roles' initials. The lattice is never built: Dijkstra's algorithm expands nodes from a heap keyed by (cost, audit), the audit
being the edits' initials so far, and stops at the first accepting end that it pops. Equal costs are decided by the smaller audit; no audit of a
node is a prefix of another of the same cost (what follows it would be inserts, which cost), so the smaller prefix stays the smaller whole.

Neither a long conversation nor a hot one is gathered in a task. Rows that are alike in all columns are counted before they move, which of a
role's repeated texts comes first is an aggregate, and rows are then range-partitioned by conversation, turn, role and text. A
task repairs the conversations that lie within its range. Those at its ends may go on elsewhere: for them it gives the
cheapest audit from each state to each state, and a row per task and conversation is put together by the same rule, states
being nodes and tasks edges. Within a task conversations of more than PIECE rows are put together likewise. Texts of such conversations are
then read in order, one at a time.

Order and faults. Rows go by turn (nulls first), then role, then text (its first 32 characters, then its sha256). The first fault of a row counts: blank (no character
but white space), duplicate (role and text seen earlier in the conversation), truncated (the last character that is no white
space is none of `.!?`). Blank and duplicate rows must be deleted.

Edge cases. Null roles and texts count as one space: such a text is blank, such a role fits no grammar state. Null conversation ids are one
conversation, null turns come first and don't count for gaps. A conversation without rows gets zeros and an empty audit. Gaps
beyond 63 bits are given as the largest number. Repeated rows are duplicates. An empty table gives an empty result. Further columns are not read. Very long texts are
whole; a task holds those of one conversation in its range.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1  # costs; CUT: of a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> role's initial -> next state
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The role that a rerole or insert gives in each state.
GIVEN = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ACCEPT = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: Rows of a conversation that one search takes at most.
PIECE = 256
LONG_MAX = 2**63 - 1

#: A row as the lattice sees it: None if it must be deleted, else its role's initial and whether it is truncated.
Row = tuple[str, bool] | None
Found = dict[int, tuple[int, str]]


def search(rows: list[Row], start: int = START, whole: bool = True) -> Found:
    """state -> (cost, audit) from a state before the rows to states after them. whole: stop at the first that accepts."""
    heap, done, found, n = [(0, "", 0, start)], set(), {}, len(rows)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            found[state] = cost, audit
            if whole and state in ACCEPT:
                return {state: found[state]}
        given = GRAMMAR[state][GIVEN[state][0]]
        edges = [(INSERT, "I", i, given)]
        if i < n:
            edges.append((DELETE, "D", i + 1, state))
            if rows[i] is not None:
                initial, cut = rows[i]
                more = CUT if cut else 0
                edges.append((REROLE + more, "R", i + 1, given))
                if initial in GRAMMAR[state]:
                    edges.append((KEEP + more, "K", i + 1, GRAMMAR[state][initial]))
        for more, edit, j, to in edges:
            if (j, to) not in done:
                heapq.heappush(heap, (cost + more, audit + edit, j, to))
    return found


def joined(steps: Iterator[dict[int, Found]], start: int = START) -> Found:
    """The same over rows in pieces, each given as start -> states after it. What all that can still win have in common is set aside, so little is copied."""
    common, now = [], {start: (0, "")}
    for step in steps:
        after: Found = {}
        for state, (cost, audit) in now.items():
            for to, (more, rest) in step[state].items():
                way = cost + more, audit + rest
                if to not in after or way < after[to]:
                    after[to] = way
        shared = os.path.commonprefix([a for _, a in after.values()])
        common.append(shared)
        now = {s: (c, a[len(shared) :]) for s, (c, a) in after.items()}
    head = "".join(common)
    return {s: (c, head + a) for s, (c, a) in now.items()}


def _pieces(rows: list[Row], states) -> list[dict[int, Found]]:
    return [{s: search(rows[i : i + PIECE], s, False) for s in states} for i in range(0, len(rows), PIECE)]


def cheapest(found: Found) -> tuple[int, str]:
    return min(found[s] for s in ACCEPT if s in found)


def repaired(rows: list[Row]) -> tuple[int, str]:
    """cost and audit of the cheapest repair."""
    return cheapest(search(rows) if len(rows) <= PIECE else joined(iter(_pieces(rows, GRAMMAR))))


def across(rows: list[Row]) -> dict[int, Found]:
    """From each state before the rows to each after them."""
    pieces = _pieces(rows, GRAMMAR)
    return {s: joined(iter(pieces), s) for s in GRAMMAR}


class Editor:
    """Applies an audit to rows as they come: yields edit, role and text of those that stay."""

    def __init__(self):
        self.state, self.audit, self.at = START, "", 0

    def follow(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """End what the audit so far inserts, and go on with another."""
        yield from self._inserts()
        self.audit, self.at = audit, 0

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._given("I", "")

    def _given(self, edit: str, text: str) -> tuple[str, str, str]:
        role = GIVEN[self.state]
        self.state = GRAMMAR[self.state][role[0]]
        return edit, role, text

    def row(self, role: str, text: str | None) -> Iterator[tuple[str, str, str]]:
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = GRAMMAR[self.state][role[:1]]
            yield edit, role, text
        elif edit == "R":
            yield self._given(edit, text)

    def run(self, good: bool, gone: int, role: str, text: str | None) -> Iterator[tuple[str, str, str]]:
        """A row that may stay (good), then so many alike that must go."""
        if good:
            yield from self.row(role, text)
        for _ in range(gone):
            yield from self.row(role, None)


class Hash:
    """sha256 of `role:text`, joined by newlines."""

    def __init__(self):
        self.of, self.any = hashlib.sha256(), False

    def add(self, line: tuple[str, str, str]) -> None:
        self.of.update((("\n" if self.any else "") + f"{line[1]}:{line[2]}").encode())
        self.any = True


@dataclass
class Stretch:
    """Rows of one conversation in one task."""

    conv: object
    #: good, gone, role, text of each run of rows alike.
    runs: list[tuple[bool, int, str, str | None]] = field(default_factory=list)
    rows: list[Row] = field(default_factory=list)
    first: bool = False
    stats: dict = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "head": None, "tail": None})

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        st, initial = self.stats, role[:1]
        if turn is not None and turn != st["high"]:
            st["turns"] += 1
            st["high"] = turn
            st["low"] = turn if st["low"] is None else st["low"]
        if st["head"] is None:
            st["head"] = initial
        elif st["tail"] + initial not in LEGAL:
            st["illegal"] += 1
        st["tail"] = initial
        st["illegal"] += copies - 1  # rows alike stand side by side
        end = text.rstrip(BLANK)[-1:]
        good = bool(end) and self.first
        self.first = False
        gone = copies - good
        if not end:
            st["blank"] += copies
        else:
            st["duplicate"] += gone
        if good:
            cut = end not in ".!?"
            st["truncated"] += cut
            self.rows.append((initial, cut))
        self.rows.extend([None] * gone)
        self.runs.append((good, gone, role, text if good else None))


def _together(parts: list[dict]) -> dict:
    """Faults of a conversation from those of its stretches in their order."""
    out = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    turns, low, high, tail = 0, None, None, None
    for p in parts:
        if p["turns"]:
            turns += p["turns"] - (p["low"] == high)
            low, high = p["low"] if low is None else low, p["high"]
        if p["head"] is not None:
            out["illegal"] += tail is not None and tail + p["head"] not in LEGAL
            tail = p["tail"]
    out["gaps"] = min(high - low + 1 - turns, LONG_MAX) if turns else 0
    return out


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_STATS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string"
#: A conversation that is whole, a stretch of one that may not be, a run of rows of such a stretch, a repaired row.
WHOLE, STRETCH, RUN, LINE = range(4)
_OUT = f"kind int, conv_id {{conv}}, chunk int, at long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string, stats struct<{_STATS.replace(' long', ':long').replace(' string', ':string')}>, ways array<struct<start:int,stop:int,cost:long,audit:string>>, good boolean, gone long, edit string, role string, text string"


def _types(conv: pa.DataType) -> pa.Schema:
    stats = pa.struct([(c, pa.string() if c in ("head", "tail") else pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "head", "tail")])
    ways = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.schema([("kind", pa.int32()), ("conv_id", conv), ("chunk", pa.int32()), ("at", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("stats", stats), ("ways", ways), ("good", pa.bool_()), ("gone", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("text") or "") + len(row.get("audit") or "")
        if size > 1 << 22:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _finished(s: Stretch, chunk: int, may_go_on: bool, lines: bool) -> Iterator[dict]:
    if may_go_on:
        ways = [{"start": a, "stop": b, "cost": c, "audit": audit} for a, to in across(s.rows).items() for b, (c, audit) in to.items()]
        yield {"kind": STRETCH, "conv_id": s.conv, "chunk": chunk, "at": -1, "stats": s.stats, "ways": ways}
        for at, (good, gone, role, text) in enumerate(s.runs):
            yield {"kind": RUN, "conv_id": s.conv, "chunk": chunk, "at": at, "good": good, "gone": gone, "role": role, "text": text}
        return
    cost, audit = repaired(s.rows)
    editor, hashed, at = Editor(), Hash(), 0

    def edited() -> Iterator[tuple[str, str, str]]:
        yield from editor.follow(audit)
        for run in s.runs:
            yield from editor.run(*run)
        yield from editor.follow("")

    for line in edited():
        hashed.add(line)
        if lines:
            yield {"kind": LINE, "conv_id": s.conv, "chunk": chunk, "at": at, **dict(zip(("edit", "role", "text"), line))}
            at += 1
    yield {"kind": WHOLE, "conv_id": s.conv, "cost": cost, "audit": audit, "repaired_sha256": hashed.of.hexdigest(), **_together([s.stats])}


def _stretches(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[dict]:
    chunk, now, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        for conv, turn, role, kind, copies, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "kind", "copies", "text"))):
            if now is None or conv != now.conv:
                if now is not None:
                    yield from _finished(now, chunk, first, lines)
                    first = False
                now = Stretch(conv)
            if kind == 1:
                now.first = True
            elif kind == 2:
                now.add(turn, role, text, copies)
    if now is not None:
        yield from _finished(now, chunk, True, lines)


def _put_together(table: pa.Table) -> pa.Table:
    """One conversation: its counts, cost and audit in its first row, and the part of the audit that belongs to each stretch."""
    parts = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    now = {START: (0, "", ())}
    for p in parts:
        after = {}
        for w in p["ways"]:
            if w["start"] in now:
                cost, audit, own = now[w["start"]]
                way = cost + w["cost"], audit + w["audit"], (*own, len(w["audit"]))
                if w["stop"] not in after or way[:2] < after[w["stop"]][:2]:
                    after[w["stop"]] = way
        now = after
    cost, audit, sizes = min(now[s] for s in ACCEPT if s in now)
    out, at = [], 0
    for p, n in zip(parts, sizes):
        out.append({"kind": STRETCH, "conv_id": p["conv_id"], "chunk": p["chunk"], "at": -1, "text": audit[at : at + n]})
        at += n
    out[0] |= {"cost": cost, "audit": audit, **_together([p["stats"] for p in parts])}
    return pa.Table.from_pylist(out, _types(table.schema.field("conv_id").type))


def _streamed(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[dict]:
    """Runs of rows behind the part of the audit that edits them, conversation by conversation: one run is held at a time."""
    conv, editor, hashed, head, n = None, None, None, None, 0

    def put(found: Iterator[tuple[str, str, str]], chunk: int) -> Iterator[dict]:
        nonlocal n
        for line in found:
            hashed.add(line)
            if lines:
                yield {"kind": LINE, "conv_id": conv, "chunk": chunk, "at": n, **dict(zip(("edit", "role", "text"), line))}
                n += 1

    def end() -> Iterator[dict]:
        yield from put(editor.follow(""), last)
        yield {**head, "kind": WHOLE, "repaired_sha256": hashed.of.hexdigest()}

    last = 0
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == STRETCH:
                if editor is None or r["conv_id"] != conv:
                    if editor is not None:
                        yield from end()
                    conv, editor, hashed, n = r["conv_id"], Editor(), Hash(), 0
                    head = {c: r[c] for c in ("conv_id", "audit", *_COUNTS)}
                yield from put(editor.follow(r["text"]), r["chunk"])
            else:
                yield from put(editor.run(r["good"], r["gone"], r["role"], r["text"]), r["chunk"])
            last = r["chunk"]
    if editor is not None:
        yield from end()


def repair(rows: DataFrame, conversations: DataFrame | None = None, lines: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """rows: conv_id, turn, role, text and, if there is one, copies (how often a row stands there).

    Gives conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in rows or in
    conversations (conv_id), and with lines the repaired rows: conv_id, chunk, at (their order within a conversation), edit (K, R or I), role and text."""
    spark = rows.sparkSession
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    text = F.coalesce("text", F.lit(" "))
    each = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.substring(text, 1, 32).alias("head"), F.unhex(F.sha2(text, 256)).alias("digest"), copies.cast("long").alias("copies"), text.alias("text"))
    key = ("conv_id", "turn", "role", "head", "digest")
    alike = each.groupBy(*key).agg(F.sum("copies").alias("copies"), F.first("text").alias("text")).withColumn("kind", F.lit(2))
    earliest = each.groupBy("conv_id", "role", "head", "digest").agg(F.max(F.isnull("turn")).alias("none"), F.min("turn").alias("turn"))
    earliest = earliest.withColumns({"turn": F.when(~F.col("none"), F.col("turn")), "kind": F.lit(1)}).drop("none")
    named = (rows if conversations is None else conversations).select("conv_id").distinct()
    named = named.select("conv_id", F.lit("").alias("role"), F.lit("").alias("head"), F.lit(b"").alias("digest"), F.lit(0).alias("kind"))
    ordered = alike.unionByName(earliest, True).unionByName(named, True).repartitionByRange(*key).sortWithinPartitions(*key, "kind")
    schema = _OUT.format(conv=dict(rows.dtypes)["conv_id"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = next(batches, None)
        if start is not None:
            yield from _batched(_stretches(_again(start, batches), lines), _types(start.schema.field("conv_id").type))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = next(batches, None)
        if start is not None:
            yield from _batched(_streamed(_again(start, batches), lines), _types(start.schema.field("conv_id").type))

    with small_batches(spark):
        found = materialise(ordered.mapInArrow(first, schema), "conversations")
        # a row per task at most, and conversation at its ends
        ends = materialise(found.filter(F.col("kind") == STRETCH).groupBy("conv_id").applyInArrow(_put_together, schema), "stretches")
        runs = found.filter(F.col("kind") == RUN).unionByName(ends).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at")
        rest = materialise(runs.mapInArrow(second, schema), "repaired")
    both = found.unionByName(rest)
    whole = both.filter(F.col("kind") == WHOLE).select("conv_id", *_COUNTS, "audit", "repaired_sha256")
    return whole, both.filter(F.col("kind") == LINE).select("conv_id", "chunk", "at", "edit", "role", "text") if lines else None


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def damaged(convs: DataFrame) -> DataFrame:
    """By the crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its `.!?` away, 3 repeats it (copies), 4 makes its role user. Nulls are one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).alias("how")
    rows = convs.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), how).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("copies"))


def op12(spark, sf_dir: str) -> DataFrame:
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, _ = repair(damaged(convs), convs, lines=False)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
