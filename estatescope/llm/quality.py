"""Quality rules over a document's words and its host's lines, in DataFrame operations.

Base rules look at one document: its number of words, and how many of them lie in
three-word windows that the document repeats. The cross-document rule looks at lines.
Each line is normalised (A-Z lower-cased, digits made equal, white space joined) and
hashed; for each host the distinct texts that hold the line are counted, so exact
copies of one text count once and do not condemn each other. A line that is in more
than 20 texts of its host, however large the host is, is taken away, and a document that loses
more than ``depleted`` of its words that way is rejected. The clean text of a document
is its other lines in their order; the base rules look at the text as it came.

Lines are reduced to one row per host, text and line before they are counted, and what
is found is joined back per text, so a line or a text that a third of all documents share
is combined before the shuffle. A null text has no words; a null host is a host of its
own. Repeated rows and ids get a row each. An empty table gives no rows. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.llm.common import SPACE, WORD, lower_ascii, read_table, whole_row, word_count, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
LINE_LIMIT = 20  # of a host's texts, however many it has
DEPLETED = 0.5  # of the document's words


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more in the list."""

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]),
            ),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        # Windows overlap, so each adds only the words up to the next one.
        return _let(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda a, b: a + b,
            ),
        )

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    some = _let(words, lambda w: F.when(F.size(w) > WINDOW, _let(windows(w), counted)))
    return F.coalesce(some, F.lit(0).cast("long"))


def text_metrics(text: Column) -> dict[str, Column]:
    """What the base rules look at; ``text`` is not null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(words_of(text)),
    }


def normal_line(line: Column) -> Column:
    joined = F.trim(F.regexp_replace(line, SPACE, " "))
    return F.regexp_replace(lower_ascii(joined), "[0-9]", "0")


def _among(value: Column, table: Column) -> Column:
    """Whether ``value`` is in the sorted array ``table``, which is not empty; by halving."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(table).cast("double"))).cast("int"))

    def halved(span: Column) -> Column:
        mid = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        up = F.get(table, mid) <= value
        return F.struct(F.when(up, mid).otherwise(span["lo"]).alias("lo"), F.when(up, span["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(table).alias("hi"))
    return F.aggregate(halvings, start, lambda span, _: halved(span), lambda span: F.get(table, span["lo"]) == value)


def clean_text(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose hashes are in the sorted array ``gone``; null: none is."""
    frequent = lambda x: x.rlike(WORD) & _let(_line(x), lambda h: _among(h, gone))
    lines = F.filter(F.split(text, "\n"), lambda x: ~frequent(x))
    return F.when(gone.isNull(), text).otherwise(F.array_join(lines, "\n"))


def _line(raw: Column) -> Column:
    return F.xxhash64(normal_line(raw))


def quality(
    docs: DataFrame,
    line_limit: int = LINE_LIMIT,
    depleted: float = DEPLETED,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, the metrics, line_words (words on lines above the
    limit), base_failed, kept, clean_text (the text without those lines)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.struct(F.col(host_col).alias("host"))
    measured = docs.select(
        F.col(id_col).alias("doc_id"), host.alias("host"), _body(text).alias("body"), text.alias("t"), F.col(text_col).alias("raw")
    ).select("doc_id", "host", "body", "raw", *(c.alias(n) for n, c in text_metrics(F.col("t")).items()))
    lost = lost_words(docs, line_limit, text_col, host_col)
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    joined = measured.join(
        lost, (F.col("host") == F.col("of_host")) & (F.col("body") == F.col("of_body")), "left"
    ).withColumn("line_words", F.coalesce("line_words", F.lit(0).cast("long")))
    return joined.withColumn("base_failed", base_failed).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "line_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("line_words") <= depleted * F.col("n_words"))).alias("kept"),
        clean_text(F.col("raw"), F.col("gone")).alias("clean_text"),
    )


def _body(text: Column) -> Column:
    """A name of a text; equal texts of a host are one text."""
    return F.xxhash64(text, F.octet_length(text))


def lost_words(docs: DataFrame, line_limit: int, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(of_host, of_body, line_words, all_words, gone) of the texts with lines above the limit; ``gone`` has the hashes of those lines, sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(host_col).alias("host")).alias("host"), _body(text).alias("body"), text.alias("t"))
    copies = rows.groupBy("host", "body").agg(F.count("*").alias("copies"))
    lines = (
        rows.select("host", "body", F.explode(F.split("t", "\n")).alias("raw"))
        .where(F.col("raw").rlike(WORD))
        .select("host", "body", _line(F.col("raw")).alias("line"), word_count(F.col("raw")).alias("words"))
    )
    # A copy of a text adds the same lines again; all of its rows stand for one text.
    held = written(lines.groupBy("host", "body", "line").agg(F.sum("words").alias("words")), "lines")
    frequent = held.groupBy("host", "line").agg(F.count("*").alias("texts")).where(F.col("texts") > line_limit)
    frequent = frequent.select("host", "line")
    hit = held.join(frequent, ["host", "line"]).groupBy("host", "body").agg(
        F.sum("words").alias("hit"), F.array_sort(F.collect_list("line")).alias("gone")
    )
    every = held.join(hit.select("host", "body"), ["host", "body"], "left_semi")
    every = every.groupBy("host", "body").agg(F.sum("words").alias("every"))
    return (
        hit.join(every, ["host", "body"])
        .join(copies, ["host", "body"])
        .select(
            F.col("host").alias("of_host"),
            F.col("body").alias("of_body"),
            F.floor(F.col("hit") / F.col("copies")).cast("long").alias("line_words"),
            F.floor(F.col("every") / F.col("copies")).cast("long").alias("all_words"),
            "gone",
        )
    )


def quality_documents(docs: DataFrame, line_limit: int = LINE_LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """Rows of ``docs`` that the rules keep, without the lines above the limit.

    Where lines went, text and n_chars are those of the clean text; all else is as it was.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lost = lost_words(docs, line_limit)
    host = F.struct(F.col("source").alias("host"))
    words = words_of(text)
    good = (F.size(words) >= MIN_WORDS) & (100 * repeated_words(words) <= MAX_REPEAT_PERCENT * F.size(words))
    found = docs.where(good).select(whole_row(docs.columns).alias("row"), host.alias("host"), _body(text).alias("body"))
    found = found.join(lost, (F.col("host") == F.col("of_host")) & (F.col("body") == F.col("of_body")), "left")
    kept = found.where(F.col("gone").isNull() | (F.col("line_words") <= depleted * F.col("all_words")))
    kept = kept.select("row", "gone", clean_text(F.col("row.text"), F.col("gone")).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    old = {c: F.col("row").getField(c) for c in docs.columns}
    return kept.select(*(F.when(F.col("gone").isNull(), old[c]).otherwise(new.get(c, old[c])).alias(c) for c in docs.columns))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and verdict of every document, and its words on frequent lines; texts stay where they are."""
    return quality(read_table(spark, sf_dir, "documents")).drop("clean_text")


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT nr, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT nr, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT nr, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT nr, i FROM windows QUALIFY count(*) OVER (PARTITION BY nr, g) > 1),
repeats AS (SELECT nr, count(DISTINCT i + j) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) o(j) GROUP BY nr),
lines AS (SELECT nr, source, t, unnest(string_split(t, chr(10))) AS raw FROM docs),
worded AS (SELECT *, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(translate(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS line
  FROM lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
dups AS (SELECT nr, count(*) - count(DISTINCT raw) AS n_dup_lines FROM worded GROUP BY nr),
frequent AS (SELECT source, line FROM worded GROUP BY source, line HAVING count(DISTINCT t) > 20),
lost AS (SELECT nr, sum(n) AS line_words FROM worded w SEMI JOIN frequent f
  ON w.source IS NOT DISTINCT FROM f.source AND w.line = f.line GROUP BY nr),
base AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(line_words, 0) AS line_words
  FROM words LEFT JOIN repeats USING (nr) LEFT JOIN dups USING (nr) LEFT JOIN lost USING (nr))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  line_words::BIGINT AS line_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_words <= 0.5 * n_words AS kept
FROM base
"""
