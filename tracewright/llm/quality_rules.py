"""Quality rules by cross-document line frequency, in DataFrame functions only.

A document's lines that hold a word are normalised (A-Z lowered, digit runs to 0, white space to single
spaces) and hashed. A line that more than ``most_percent`` percent of the documents of a host (the source)
have, and more than ``most_documents``, is removed from all of them; a document that keeps fewer than ``least_words`` words, or less than
``least_share`` of its words, is depleted and rejected, as is one that fails the base rules.

Null text has no words and no lines and fails the base rules. A null source is a host of its own. Every
row is a document, also where doc_ids repeat or are null; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import let, words_of, written

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line is boilerplate of a host above both: this share of the host's documents, and this number of them.
MOST_PERCENT, MOST_DOCUMENTS = 2, 2
LEAST_WORDS = 10
LEAST_SHARE = 0.3
WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""

    def windows(h: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.when(F.size(h) >= WINDOW, F.transform(steps, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>"))

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, j: (F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False))) | (F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False)))
            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(let(ordered, places), start, lambda a, q: F.struct((a["n"] + F.least(F.lit(WINDOW), q - a["last"])).alias("n"), q.alias("last")), lambda a: a["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(line, UPPER, LOWER), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def base_metrics(docs: DataFrame) -> DataFrame:
    """Per row: rid, doc_id, source, the base metrics and lines (hash of the normalised line, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", text.alias("text"), words_of(F.col("text")).alias("words"), F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("kept_lines"))
    return rows.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("kept_lines") - F.size(F.array_distinct("kept_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.transform("kept_lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words_of(x)).alias("w"))).alias("lines"),
    )


def filter_by_lines(docs: DataFrame, most_percent: int = MOST_PERCENT, most_documents: int = MOST_DOCUMENTS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept."""
    base = written(base_metrics(docs), "op1-base")
    # one row for each line of a document; counting is by partial sums, however frequent a line is
    lines = base.select("rid", "source", F.explode("lines").alias("line")).groupBy("rid", "source", "line.h").agg(F.sum("line.w").alias("w"))
    lines = written(lines, "op1-lines")
    hosts = base.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("documents"))
    often = lines.groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") > most_documents).join(hosts, F.col("source").eqNullSafe(F.col("host")))
    frequent = written(often.where(100 * F.col("n") > most_percent * F.col("documents")).select("host", F.col("h").alias("line")), "op1-frequent")
    removed = lines.join(frequent, F.col("source").eqNullSafe(F.col("host")) & (F.col("h") == F.col("line"))).groupBy("rid").agg(F.sum("w").alias("n_removed_words"))
    got = base.drop("lines").join(removed, "rid", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < least_words) | (left < least_share * F.col("n_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed_words")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
v AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid),
l AS (SELECT rid, source, trim(regexp_replace(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT rid, source, unnest(ls) AS x FROM w)),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
f AS (SELECT c.source, x FROM (SELECT source, x, count(DISTINCT rid) AS n FROM l GROUP BY ALL) c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE n > {MOST_DOCUMENTS} AND 100 * n > {MOST_PERCENT} * docs),
m AS (SELECT rid, sum(n) AS n FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.x = f.x GROUP BY rid),
b AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n, 0)::BIGINT AS n_removed_words FROM w LEFT JOIN v USING (rid) LEFT JOIN m USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= {LEAST_WORDS} AND n_words - n_removed_words >= {LEAST_SHARE} * n_words AS kept, n_removed_words
FROM b
"""
