"""Personal data: base spans against the patterns as they are stated, disguises against their expected source spans."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cellarium.llm import pii, queries

# the patterns as the contract states them
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, s):
    n = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else 0, "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]


def plain(text):
    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m.group())] for k, p in PATTERNS.items()}


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_are_those_of_the_patterns(seed):
    r = random.Random(seed)
    pieces = ["a", "b.c", "@", ".", "-", "+", " ", "1", "25", "256", "4111", "1111", "(", ")", "x_y", "%", "1.2.3.4", "@d.e", "00", "\n", "é", "+1 ", "4539 1488 0343 6467", "..", "300.1.1.1.1"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        assert {k: f(text) for k, f in pii.FIND.items()} == plain(text), text


CASES = [
    ("mail <john.smith [at] example [dot] com> now", "email", "john.smith [at] example [dot] com", "john.smith@example.com"),
    ("john AT example DOT com", "email", "john AT example DOT com", "john@example.com"),
    ("write to john dot smith at mail dot example dot co dot uk!", "email", "john dot smith at mail dot example dot co dot uk", "john.smith@mail.example.co.uk"),
    ("jоhn@exаmple.com with Cyrillic letters", "email", "jоhn@exаmple.com", "john@example.com"),
    ("full ｊｏｈｎ＠example．com width", "email", "ｊｏｈｎ＠example．com", "john@example.com"),
    ("jo​hn@exam­ple.com", "email", "jo​hn@exam­ple.com", "john@example.com"),
    ("é name(at)host.org é", "email", "name(at)host.org", "name@host.org"),
    ("call plus one four one five five five five one two one two please", "phone", "plus one four one five five five five one two one two", "+14155551212"),
    ("ring +44 seven nine four six - zero nine five eight", "phone", "+44 seven nine four six - zero nine five eight", "+44 7946 - 0958"),
    ("host one nine two dot one six eight dot zero dot one up", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
    ("at 192 dot 168 dot 0 dot 1", "ip", "192 dot 168 dot 0 dot 1", "192.168.0.1"),
    ("at 192[.]168(dot)0[.]1.", "ip", "192[.]168(dot)0[.]1", "192.168.0.1"),
    ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one", "4111111111111111"),
    ("card 4111 1111‑1111 1111", "card", "4111 1111‑1111 1111", "4111 1111-1111 1111"),
    ("card 4l11 1111 llll IIII with 4O4 and 4111l1l1l1l1l111 as numerals", "card", "4111l1l1l1l1l111", "4111111111111111"),
    ("call +1 (seven two four) five five five - seven zero five eight", "phone", "+1 (seven two four) five five five - seven zero five eight", "+1 (724) 555 - 7058"),
    ("call +1 seven two four 555-7058", "phone", "+1 seven two four 555-7058", "+1 724 555-7058"),
    ("mail bosbt.42 at mail8.example.com!", "email", "bosbt.42 at mail8.example.com", "bosbt.42@mail8.example.com"),
    ("mail bosbt.42 at mail8 dot example dot com!", "email", "bosbt.42 at mail8 dot example dot com", "bosbt.42@mail8.example.com"),
    ("𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦", "email", "𝐣𝐨𝐡𝐧@𝐞𝐱𝐚𝐦𝐩𝐥𝐞.𝐜𝐨𝐦", "john@example.com"),
    ("card ٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١", "4111 1111 1111 1111"),
]


@pytest.mark.parametrize("text,kind,source,value", CASES)
def test_disguises(text, kind, source, value):
    a = text.index(source)
    for before in ("", "x" * 1000 + "\n", "😀 "):
        found = [s for s in pii.spans(before + text) if not s[4]]
        assert (kind, a + len(before), a + len(before) + len(source), value, False) in found


@pytest.mark.parametrize("text", ["Look at the dot com bubble.", "Find us at example.com today.", "In 2O21 at l0:30, one or two of 12 at 3.com", "One or two, three; four at five dot six.", "We met at noon.", "Она сказала: у нас 12 – 15 мест.", "Pages 10–12 and 100–120", "a [dot] b", "Be at it, dot the i."])
def test_prose_is_left_alone(text):
    assert pii.spans(text) == []


def test_base_spans_stay():
    r = random.Random(3)
    for _ in range(300):
        parts = [r.choice([t for t, *_ in CASES] + ["a.b@c.de", "1.2.3.4", "+1 (415) 555-1212", "4539 1488 0343 6467", "word"]) for _ in range(6)]
        text = r.choice([" ", "\n", ", "]).join(parts)
        found = pii.spans(text)
        assert {k: [(a, b) for q, a, b, _, base in found if base and q == k] for k in PATTERNS} == plain(text)
        assert all(0 <= a < b <= len(text) for _, a, b, _, _ in found)
        assert all(text[a] == text[a].strip() and text[b - 1] == text[b - 1].strip() for _, a, b, _, _ in found)


@pytest.mark.parametrize("piece", ["a", "1", "1.", "a@", "+1", "1 ", "one two ", " at x", "[at] ", "+1 .", "а", "aa at bb dot ", "at ", "0O", "a.b at c.", "a1 at b.com "])
def test_time_in_proportion(piece):
    def took(n):
        began = time.process_time()
        pii.spans(piece * (n // len(piece)) + "x")
        return time.process_time() - began

    assert took(400_000) < 12 * took(100_000) + 0.5


SCHEMA = "doc_id long, text string"


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op11_pii"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for k, s in want.items() for a, b in s)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        all_spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in all_spans) for k in PATTERNS]
        assert {tuple(x) for x in all_spans} >= {(k, str(a), str(b)) for k, s in want.items() for a, b in s}


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a@b.cd"), (4, "a@b.cd"), (4, "a@b.cd"), (5, "é" * 200_000 + " john at example dot com")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("pii", "n_email", "spans", "kind")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op11_pii"](spark, str(tmp_path)).select("doc_id", "n_email", "spans").collect()), key=repr)
    assert got == sorted([(1, 0, ""), (2, 0, ""), (3, 0, ""), (None, 1, "email:0:6"), (4, 1, "email:0:6"), (4, 1, "email:0:6"), (5, 1, "email:200001:200024")], key=repr)
    assert set(pii.find_pii(df).columns) == set(df.columns)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op11_pii"](spark, f"{tmp_path}/none").count() == 0


def test_masking(spark):
    df = spark.createDataFrame([(1, "é john [at] example [dot] com, 1.2.3.4."), (2, None), (3, "jo​hn@example.com end")], SCHEMA)
    got = {r["doc_id"]: r["m"] for r in pii.find_pii(df).select("doc_id", pii.masked(F.col("text"), F.col("pii")).alias("m")).collect()}
    assert got == {1: "é <email>, <ip>.", 2: None, 3: "<email> end"}
