r"""Line dedup (operator 1).

Every text is split at \n, its lines are exploded with their positions, and the key of a line (stripped of
white space, A-Z lowered) is hashed. A hash that at least `min_docs` different documents hold loses all its
lines but those in the largest doc_id holding it; what stays is put together again by position.

Only ids, positions and 16-byte hashes are exploded and shuffled for the counts; distinct documents are counted
in two steps (hash and document, then hash), so a line that a third of the documents hold is
spread before it is counted. Hashes held by at least 1/HOT of all lines are at most HOT in number, and are
broadcast; the rest is joined by a shuffle in which no key has more than 1/HOT of the lines. The texts
themselves move once, to meet the positions that they lose.

Edge cases. A null or empty text is one empty line. Rows that repeat a doc_id are the same document for counts;
each keeps and loses lines of its own. A row whose doc_id is null counts for no line and loses none.
Lines whose key is shorter than `min_chars` code points stay. An empty table gives an empty result.
Columns named n_lines or n_dropped in the input give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of, with_columns

HOT = 4096
_BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """__id, __text (a hash that tells rows of one id apart) and the positions that they lose."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.xxhash64(text_of(text_col)).alias("__text"), F.posexplode(F.split(text_of(text_col), "\n", -1)).alias("__pos", "__line")
    )
    lines = lines.select("__id", "__text", "__pos", line_key(F.col("__line")).alias("__key")).filter(F.char_length("__key") >= min_chars)
    lines = materialise(lines.select("__id", "__text", "__pos", F.unhex(F.md5("__key")).alias("__hash")), "lines")
    held = lines.groupBy("__hash", "__id").agg(F.lit(1).alias("n")).groupBy("__hash").agg(F.count("n").alias("__docs"), F.max("__id").alias("__last"))
    held = materialise(held.filter(F.col("__docs") >= min_docs), "repeated")
    hot_from = max(1, lines.count() // HOT)
    hot, cold = held.filter(F.col("__docs") > hot_from), held.filter(F.col("__docs") <= hot_from)
    lost = lines.join(F.broadcast(hot), "__hash").unionByName(lines.join(F.broadcast(hot), "__hash", "left_anti").join(cold, "__hash"))
    return lost.filter(F.col("__id") != F.col("__last")).groupBy("__id", "__text").agg(F.collect_set("__pos").alias("__lost"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the text that stays, n_lines (before) and n_dropped."""
    lost = repeated_lines(docs, id_col, text_col, min_chars, min_docs).withColumnsRenamed({"__id": "__lost_id", "__text": "__lost_text"})
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.xxhash64(text_of(text_col)).alias("__text"), F.split(text_of(text_col), "\n", -1).alias("__lines"))
    # the texts are the large side: the positions are built into the hash table, and texts are not sorted
    rows = rows.join(lost.hint("shuffle_hash"), (rows[f"`{id_col}`"] == lost["__lost_id"]) & (rows["__text"] == lost["__lost_text"]), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce(F.col("__lost"), F.array().cast("array<int>")))
    new = {
        text_col: F.array_join(F.transform(stay, lambda i: F.col("__lines")[i]), "\n"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dropped": F.coalesce(F.size("__lost"), F.lit(0)).cast("long"),
    }
    return rows.select(*with_columns(docs, new))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
held AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, held.k IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
