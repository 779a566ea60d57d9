r"""Personal data, also in disguise (operator 11).

Detectors for e-mail addresses, IPv4 addresses, card and phone numbers run over the text as it is (the base spans), and once more over a
normalised copy, whose matches are mapped back. The copy comes from a chain of transducers, each of which reads a text and writes
another one along with, for every character written, the span of source characters it stands for; so spans of the last text map to
spans of the first whatever was replaced, joined or dropped in between:

* `letters`: full-width forms, look-alike letters, digits of any script, dots, hyphens, spaces and at signs of Unicode become ASCII; characters
  without width disappear;
* `numerals`: the letters O and l among digits become 0 and 1;
* `digits`: where four or more digits, two of seven or more, or three or more dots between numbers, are spelled out in a row (dashes, brackets and a plus may stand
  among them, spelled as well), words become characters, and the space between them goes;
* `signs`: `[at]`, `(at)`, `{dot}` and the like become `@` and `.`, bare ` at ` and ` dot ` only as `name at host dot domain` with a known
  last part, and ` at ` before plain dots only behind a name with a digit or sign in it.

A match on the copy counts where something inside it was changed and no base span of its kind covers it; base spans always stay. A text in
which no transducer finds anything to change (one scan of a character class each) is read once.

Time is linear in the text: detectors start only where a match can start (an address is looked for around its at sign, numbers from the start of their
digits), so that long runs of letters or digits are not scanned again from each of their characters; results are those of the
patterns, leftmost and without overlap.

Edge cases. Null texts count as empty and have no spans. Very long texts are read whole. Every row gets its row, repeated
ones and those with null ids too. An empty table gives an empty result. Columns of the input named like a result give way to it. Spans count code points; their ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, with_columns

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if local else None
        if host:
            out.append((at - local, host.end()))
        done = host.end() if host else at + 1
        at = text.find("@", done)
    return out


def ips(text: str) -> list[Span]:
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 signs between them
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# --- transducers -------------------------------------------------------------------------------------------------------


class Traced:
    """A text and, for each of its characters, where the source characters that it stands for begin and end."""

    def __init__(self, text: str, begin: list[int] | None = None, end: list[int] | None = None):
        self.text, self.begin, self.end = text, begin, end

    def source(self, a: int, b: int) -> Span:
        return (a, b) if self.begin is None else (self.begin[a], self.end[b - 1])

    def replaced(self, edits: list[tuple[int, int, str]]) -> Traced:
        """With new characters in place of spans, in ascending order without overlap. Each new character stands for all of its span."""
        if not edits:
            return self
        begin = self.begin if self.begin is not None else range(len(self.text))
        end = self.end if self.end is not None else range(1, len(self.text) + 1)
        text, b, e, at = [], [], [], 0
        for lo, hi, new in edits:
            text.append(self.text[at:lo])
            b.extend(begin[at:lo])
            e.extend(end[at:lo])
            text.append(new)
            b.extend([begin[lo]] * len(new))
            e.extend([end[hi - 1]] * len(new))
            at = hi
        text.append(self.text[at:])
        b.extend(begin[at:])
        e.extend(end[at:])
        return Traced("".join(text), b, e)


# fixed values: Cyrillic and Greek letters that look like Latin ones, and signs of Unicode that stand for ASCII's
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g",
    "。": ".", "｡": ".", "․": ".", "·": ".", "•": ".", "∙": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    "﹫": "@", "﹢": "+",
}
SPACES = "\u00a0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
WIDTHLESS = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


@cache
def _letters() -> dict[str, str]:
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table |= {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"}
    # circled and mathematical letters and digits
    plain = {chr(c): unicodedata.normalize("NFKC", chr(c)) for r in (range(0x2460, 0x2500), range(0x1D400, 0x1D800)) for c in r}
    table |= {c: n for c, n in plain.items() if len(n) == 1 and n.isascii() and n.isalnum()}
    table |= LOOK_ALIKE | dict.fromkeys(SPACES, " ") | dict.fromkeys(WIDTHLESS, "")
    return table


@lru_cache(1024)
def _any_of(characters: frozenset[str]) -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, sorted(characters))) + "]")


def letters(t: Traced) -> Traced:
    if t.text.isascii():
        return t
    table = _letters()
    there = table.keys() & set(t.text)  # of many a text none; a class of all of them would be slow to search for
    return t.replaced([(m.start(), m.end(), table[m.group()]) for m in _any_of(frozenset(there)).finditer(t.text)]) if there else t


_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[OolI]*[0-9])(?=[0-9]*[OolI])[0-9OolI]{2,}(?![A-Za-z0-9])")
_AS_DIGIT = str.maketrans("OolI", "0011")


def numerals(t: Traced) -> Traced:
    """O and l among digits, of which there are at least as many."""
    found = [m for m in _MIXED.finditer(t.text) if 2 * sum(map(str.isdigit, m.group())) >= len(m.group())]
    return t.replaced([(m.start() + i, m.start() + i + 1, x.translate(_AS_DIGIT)) for m in found for i, x in enumerate(m.group()) if not x.isdigit()])


DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_SIGNS = {"dot": ".", "point": ".", "dash": "-", "hyphen": "-", "plus": "+"}
_ITEM = rf"(?:(?:{'|'.join((*DIGITS, *_SIGNS))})(?![A-Za-z0-9])|[0-9]++(?![A-Za-z]))"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9]){_ITEM}(?:[\x20\t,.()-]{{1,5}}{_ITEM})++", re.I)
_ITEMS = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
_SPELLED_WORD = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(DIGITS)}|dot|point)(?![A-Za-z])", re.I)
#: Digits spelled out, digits of any form if two are spelled out, or else spelled dots, from which a run counts.
LEAST_DIGITS, LEAST_MIXED, LEAST_DOTS = 4, 7, 3


def digits(t: Traced) -> Traced:
    edits = []
    for run in _SPELLED.finditer(t.text) if _SPELLED_WORD.search(t.text) else ():
        items = [(m.start() + run.start(), m.end() + run.start(), m.group()) for m in _ITEMS.finditer(run.group())]
        new = [DIGITS.get(x.lower()) or _SIGNS.get(x.lower()) for _, _, x in items]
        words = sum(n is not None and n.isdigit() for n in new)
        if words < LEAST_DIGITS and new.count(".") < LEAST_DOTS and not (words >= 2 and words + sum(len(x) for _, _, x in items if x.isdigit()) >= LEAST_MIXED):
            continue
        for i, ((a, b, x), n) in enumerate(zip(items, new)):
            if n is not None:
                edits.append((a, b, n))
            elif not x[0].isdigit() and x.strip(" \t,") == "":
                near = new[i - 1], new[i + 1]
                if None not in near or not {".", "-", "+"}.isdisjoint(near):
                    edits.append((a, b, ""))
    return t.replaced(edits)


# fixed values: last parts of host names that a bare ` dot ` may lead to
TLD = "com|org|net|edu|gov|info|io|co|biz|dev|app|ai|me|us|uk|de|fr|es|it|nl|ch|at|eu|ca|au|jp|cn|in|br|ru|pl|se|no|fi|dk"
_OPEN, _CLOSE = r"[\x20\t]{0,3}[\[({<][\x20\t]{0,3}", r"[\x20\t]{0,3}[\])}>][\x20\t]{0,3}"
_BRACKETED = re.compile(rf"{_OPEN}(at|dot|@|\.|point){_CLOSE}", re.I)
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?:\.|[\x20\t]{{1,3}}dot[\x20\t]{{1,3}})[A-Za-z0-9_%+-]+){{0,3}}([\x20\t]{{1,3}}at[\x20\t]{{1,3}})(?!(?:the|an?|this|that|our|your|my|his|her|its|their|one)[\x20\t])[A-Za-z0-9-]+(?:(?:\.|[\x20\t]{{1,3}}dot[\x20\t]{{1,3}})[A-Za-z0-9-]+){{0,3}}?[\x20\t]{{1,3}}dot[\x20\t]{{1,3}}(?:{TLD})(?:(?:\.|[\x20\t]{{1,3}}dot[\x20\t]{{1,3}})(?:{TLD}))?(?![A-Za-z0-9-])", re.I)
_NAMED = re.compile(rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z]*[0-9._%+-])(?=[0-9._%+-]*[A-Za-z])[A-Za-z0-9._%+-]{{2,64}}([\x20\t]{{1,3}}at[\x20\t]{{1,3}})(?:[A-Za-z0-9-]+\.){{1,5}}(?:{TLD})(?![A-Za-z0-9-])", re.I)
_AT = re.compile(r"[\x20\t]at[\x20\t]{1,3}[A-Za-z0-9-]+\.[A-Za-z]", re.I)
_DOT = re.compile(r"[\x20\t]{1,3}dot[\x20\t]{1,3}", re.I)
_AT_DOT = re.compile(r"[\x20\t]at[\x20\t]{1,3}[A-Za-z0-9. \t-]{1,200}?[\x20\t]dot[\x20\t]", re.I)
_BRACKET = re.compile(r"[\[({<][\x20\t]{0,3}(?:at|dot|@|\.|point)[\x20\t]{0,3}[\])}>]", re.I)


def signs(t: Traced) -> Traced:
    if _BRACKET.search(t.text):
        t = t.replaced([(m.start(), m.end(), "@" if m.group(1).lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(t.text)])
    edits, done = [], 0
    for near in _AT_DOT.finditer(t.text):
        # names before ` at ` and after the first ` dot ` are at most so long; the pattern is tried around such places only
        for m in _BARE.finditer(t.text, max(done, near.start() - 100), min(len(t.text), near.end() + 100)) if near.start() >= done else ():
            if m.start(1) < done:
                continue
            a, b = m.span(1)
            dots = [(d.start(), d.end(), ".") for lo, hi in ((m.start(), a), (b, m.end())) for d in _DOT.finditer(t.text, lo, hi)]
            edits += sorted([*dots, (a, b, "@")])
            done = m.end()
    t, edits, done = t.replaced(edits), [], 0
    for near in _AT.finditer(t.text):
        for m in _NAMED.finditer(t.text, max(done, near.start() - 70), min(len(t.text), near.end() + 200)) if near.start() >= done else ():
            edits.append((*m.span(1), "@"))
            done = m.end()
    return t.replaced(edits)


TRANSDUCERS = (letters, numerals, digits, signs)


def spans(text: str) -> list[tuple[str, int, int, str, bool]]:
    """kind, start, end, normalised value, whether it is a base span; by kind, then start, then end."""
    base = {k: f(text) for k, f in FIND.items()}
    out = [(k, a, b, text[a:b], True) for k in KINDS for a, b in base[k]]
    t = Traced(text)
    for step in TRANSDUCERS:
        t = step(t)
    if t.begin is None:
        return out
    more = []
    for k, f in FIND.items():
        for a, b in f(t.text):
            lo, hi = t.source(a, b)
            if text[lo:hi] != t.text[a:b] and not any(x <= lo and hi <= y for x, y in base[k]):
                more.append((k, lo, hi, t.text[a:b], False))
    return sorted(out + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else out


_SPAN = "struct<kind:string,start:int,stop:int,value:string,base:boolean>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("base", pa.bool_())]))


def pii_spans(text: Column) -> Column:
    """Spans of a text column, as an array of kind, start, stop, value (normalised) and base."""

    @F.arrow_udf(f"array<{_SPAN}>")
    def find(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "stop", "value", "base")
        return pa.array([[dict(zip(names, s)) for s in spans(x.as_py())] if x.is_valid else [] for x in texts], _ARROW)

    return find(text)


def find_pii(docs: DataFrame, text_col: str = "text", name: str = "pii") -> DataFrame:
    """docs with a column of their spans."""
    return docs.select(*with_columns(docs, {name: pii_spans(F.col(text_col))}))


def masked(text: Column, found: Column) -> Column:
    """text with each span of pii_spans as its kind in angle brackets; spans that overlap are one, named by the first."""
    sorted_ = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["stop"] - a["stop"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))).otherwise(F.struct(F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["stop"].alias("at")))

    return F.aggregate(sorted_, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with small_batches(spark):
        found = materialise(find_pii(docs).select("doc_id", "pii"), "pii")
    listed = lambda keep: F.concat_ws(",", F.transform(F.filter("pii", keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    counts = [F.size(F.array_remove(F.transform(F.col("pii.kind"), lambda x: x == kind), F.lit(False))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(lambda s: s["base"]), 256).alias("base_sha256"), listed(lambda s: F.lit(True)).alias("spans"))
