"""Conversation repair against exhaustive search, and the query against a plain account of it."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.llm import conversations as C
from cellarium.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
OK = re.compile(r"(s?(ua)+)?")


def tried(rows):
    """Least (cost, audit, roles) over all edit strings with at most one insert before each row and three at the end."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(r is None and e != "D" for r, e in zip(rows, edits)):
            continue
        for inserts in itertools.product(range(2), repeat=len(rows)):
            for tail in range(3):
                audit = "".join("I" * k + e for k, e in zip(inserts, edits)) + "I" * tail
                cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] for e in audit) + sum(r is not None and r[1] and e != "D" for r, e in zip(rows, edits))
                if best is not None and (cost, audit) >= best[:2]:
                    continue
                free = audit.count("R") + audit.count("I")
                for given in itertools.product("ua", repeat=free):
                    give, at, roles = iter(given), 0, ""
                    for e in audit:
                        if e in "RI":
                            roles += next(give)
                        if e == "K":
                            roles += rows[at][0] or "?"
                        at += e != "I"
                    if OK.fullmatch(roles):
                        best = cost, audit, roles
                        break
    return best


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_edits(seed):
    r = np.random.default_rng(seed)
    for _ in range(25):
        rows = [None if r.random() < 0.2 else (str(r.choice(["s", "u", "a", " ", ""], p=[0.2, 0.35, 0.35, 0.05, 0.05])), bool(r.random() < 0.3)) for _ in range(r.integers(0, 5))]
        assert C.repaired(rows) == tried(rows)[:2]


def test_pieces_give_what_one_search_gives(monkeypatch):
    r = np.random.default_rng(9)
    for _ in range(40):
        rows = [None if r.random() < 0.2 else (str(r.choice(["s", "u", "a", "x"], p=[0.1, 0.4, 0.4, 0.1])), bool(r.random() < 0.3)) for _ in range(r.integers(0, 40))]
        whole = C.cheapest(C.search(rows))
        monkeypatch.setattr(C, "PIECE", 7)
        assert C.repaired(rows) == whole
        cut = int(r.integers(0, len(rows) + 1))
        assert C.cheapest(C.joined(iter([C.across(rows[:cut]), C.across(rows[cut:])]))) == whole
        monkeypatch.undo()


def plain(convs):
    """The query's rows by its definition, conversation by conversation."""
    sp = lambda x: " " if x is None else str(x)
    groups, out = defaultdict(list), []
    for conv, turn, role, text in convs:
        rows = groups[conv]
        how, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        rows.extend([(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1))
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0], r[1], r[2][:32], hashlib.sha256(r[2].encode()).digest()) if r[0] is not None else (False, 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).digest()))
        seen, lattice, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            lattice.append(None if fault < 2 else (role[:1], fault == 2))
        best = {(0, 0): (0, "")}  # state: 0 nothing, 1 s, 2 u, 3 a
        step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

        def put(i, s, way):
            if (i, s) not in best or way < best[i, s]:
                best[i, s] = way
                return True

        for i in range(len(lattice) + 1):
            for _ in range(5):  # inserts
                for s in range(4):
                    if (i, s) in best:
                        put(i, step[s, "a" if s == 2 else "u"], (best[i, s][0] + 2, best[i, s][1] + "I"))
            if i < len(lattice):
                for s in range(4):
                    if (i, s) in best:
                        cost, audit = best[i, s]
                        put(i + 1, s, (cost + 3, audit + "D"))
                        if lattice[i]:
                            initial, cut = lattice[i]
                            put(i + 1, step[s, "a" if s == 2 else "u"], (cost + 2 + cut, audit + "R"))
                            if (s, initial) in step:
                                put(i + 1, step[s, initial], (cost + cut, audit + "K"))
        cost, audit = min(best[len(lattice), s] for s in (0, 3) if (len(lattice), s) in best)
        lines, at, state = [], 0, 0
        for e in audit:
            role, text = ("user", "assistant")[state == 2], ""
            if e != "I":
                role, text = rows[at][1] if e == "K" else role, rows[at][2]
                at += 1
            if e != "D":
                lines.append(f"{role}:{text}")
                state = step[state, role[0]]
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def answered(spark, tmp_path, rows, partitions=1, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    if extra:
        df = df.withColumns({c: F.lit("x") for c in ("kind", "copies", "chunk", "audit", "head", "digest")})
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


def test_query_against_plain_account(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_conversation_repair"](spark, sf_dir)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def made(seed, n, convs):
    r = np.random.default_rng(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "So it is.", "x" * 50 + ".", "x" * 50 + "!", None, "é. ", "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    return [(None if r.random() < 0.02 else int(r.integers(convs)), None if r.random() < 0.1 else int(r.integers(-3, 2000 // convs)), roles[r.choice(7, p=[0.4, 0.4, 0.08, 0.03, 0.03, 0.03, 0.03])], texts[r.integers(11)]) for _ in range(n)]


@pytest.mark.parametrize("convs", [1, 40])
def test_nulls_ties_and_conversations_over_many_tasks(spark, tmp_path, convs):
    """One conversation over all tasks, and many; odd roles and texts, equal turns, repeated rows."""
    rows = made(convs, 1500, convs)
    assert answered(spark, tmp_path, rows, 3, True) == plain(rows)


def test_hot_row_and_long_conversation(spark, tmp_path):
    rows = [(1, 1, "user", "same.")] * 700 + [(2, i, ("user", "assistant")[i % 2], f"t{i // 3}.") for i in range(900)] + [(3, None, None, None)] * 5 + [(4, -(2**62), "user", "a?"), (4, 2**62 + 5, "assistant", "b" * 300_000 + ".")]
    assert answered(spark, tmp_path, rows) == [tuple(min(x, C.LONG_MAX) if isinstance(x, int) else x for x in r) for r in plain(rows)]


def test_empty(spark, tmp_path):
    assert answered(spark, tmp_path, []) == []
    assert hashlib.sha256(b"").hexdigest() in {r[8] for r in answered(spark, tmp_path, [(i, 0, "user", "") for i in range(40)])}


def test_lines_make_the_hash(spark, sf_dir):
    """The repaired rows themselves, in their order, are what is hashed."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, lines = C.repair(C.damaged(convs), convs)
    texts = defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: (r["conv_id"], r["chunk"], r["at"])):
        texts[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(texts[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]
        assert OK.fullmatch("".join(x[0] for x in texts[r["conv_id"]]))
