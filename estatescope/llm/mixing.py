"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Each source gets a target in words: its share of the budget by weight, at most
``max_epochs`` times what it has, the excess shared again by weight. Documents are
shuffled by a hash of id and text. A document's virtual finish time is the number of
words of its source up to and with it, divided by the source's target; a second epoch
of the source goes on where the first ended. All documents are then ordered by finish
time and taken while their running total is within the budget, so every source
advances at its rate and ends near its target.

Running totals are made in two steps, a total per bucket (of the hash, then of the
finish time) and a running total within the bucket, so neither a source that holds a
third of all documents nor the whole mix goes through one task. Null text and text
without words have size 0 and are taken with 0 words; a null source is a source of
its own and comes last; equal documents are interchangeable. Other columns of the
input are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatescope.llm.common import read_table, whole_row, word_count, written

WEIGHTS = (3, 1, 2)  # by the sources' order, repeating
SHARE = 1.5  # of all words
MAX_EPOCHS = 2
BUCKETS = 4096


def _up_to_here(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def drawn(doc_id: Column, text: Column) -> Column:
    """The shuffle: a hash of id and text, the same in every run."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(name, F.lit("/"), body).cast("binary"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row per source.

    Sources are stopped in the order of stop size to weight: while the words that are
    left, by weight, would lift the next source above its stop, it is stopped. This is
    where resharing the excess ends.
    """
    # One row per source: sources are few beside documents.
    by_name = Window.partitionBy().orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    everything = Window.partitionBy()
    by_stop = Window.partitionBy().orderBy("fill", "rank")
    ranked = (
        ranked.withColumn("weight", weight)
        .withColumn("stop", F.col("source_size") * max_epochs)
        .withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("fill", F.col("stop") / F.col("weight"))
        .withColumn("stopped", F.sum("stop").over(_up_to_here(by_stop)) - F.col("stop"))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.sum("weight").over(_up_to_here(by_stop)) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open_weight"))
    )
    # The fill level is that of the first source that is not stopped.
    level = F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "rank", "level"))).over(everything)
    return ranked.withColumn("water", level["level"]).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("stop").cast("double"), F.col("weight") * F.col("water")), F.col("stop").cast("double")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, draw, source, size, source_size, target, first_finish,
    copies (how often the mix takes it). Copies follow each other in the order of finish."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digits = max(1, ((buckets - 1).bit_length() + 3) // 4)
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(text).alias("size"),
            drawn(F.col(id_col), text).alias("draw"),
        ),
        "mixing",
    ).withColumn("lot", F.substring("draw", 1, digits))
    lots = sized.groupBy("source", "lot").agg(F.sum("size").alias("lot_size"))
    totals = lots.groupBy("source").agg(F.sum("lot_size").alias("source_size"))
    targets = source_targets(totals, weights, share, max_epochs)
    by_lot = _up_to_here(Window.partitionBy("source").orderBy("lot"))
    starts = lots.select(
        "source", "lot", (F.sum("lot_size").over(by_lot) - F.col("lot_size")).alias("lot_start")
    )
    starts = (
        starts.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select(
            F.col("s.source").alias("of_source"),
            F.col("lot").alias("of_lot"),
            "lot_start",
            "source_size",
            "target",
        )
    )
    within = _up_to_here(Window.partitionBy("source", "lot").orderBy("draw", "doc_id", "size"))
    queued = (
        sized.withColumn("in_lot", F.sum("size").over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("lot") == F.col("of_lot")))
        .withColumn("ends", F.col("lot_start") + F.col("in_lot"))
    )

    def finish(epoch: Column) -> Column:
        words = F.col("ends") + epoch * F.col("source_size")
        return F.coalesce(words / F.when(F.col("target") > 0, F.col("target")), F.lit(0.0))

    copies = queued.withColumn(
        "epoch", F.explode(F.array(*(F.lit(e) for e in range(max_epochs))))
    ).withColumn("finish", finish(F.col("epoch")))
    # The global order by finish time: range buckets, in each the order itself.
    copies = copies.withColumn("tick", F.floor(F.col("finish") * buckets))
    ticks = copies.groupBy("tick").agg(F.sum("size").alias("tick_size"))
    every_tick = _up_to_here(Window.partitionBy().orderBy("tick"))
    # All rows up to the last bucket that fits are taken; in the next one, those that fit.
    last = (
        ticks.withColumn("run", F.sum("tick_size").over(every_tick))
        .crossJoin(F.broadcast(targets.agg(F.sum("target").alias("budget"))))
        .where(F.col("run") > F.col("budget"))
        .agg(F.min(F.struct("tick", (F.col("run") - F.col("tick_size")).alias("before"), "budget")).alias("last"))
        .select("last.tick", "last.before", "last.budget")
    )
    place = F.struct("finish", "source", "draw", "doc_id", "epoch")
    in_tick = _up_to_here(Window.partitionBy("tick").orderBy("finish", "source", "draw", "doc_id", "epoch"))
    cut = (
        copies.join(F.broadcast(last), "tick")
        .withColumn("run", F.col("before") + F.sum("size").over(in_tick))
        .where(F.col("run") > F.col("budget"))
        .agg(F.min(place).alias("cut"))
    )
    taken = [
        F.when(
            F.col("cut").isNull()
            | (
                F.struct(
                    finish(F.lit(e)).alias("finish"), "source", "draw", "doc_id", F.lit(e).alias("epoch")
                )
                < F.col("cut")
            ),
            1,
        ).otherwise(0)
        for e in range(max_epochs)
    ]
    return queued.crossJoin(F.broadcast(cut)).select(
        "doc_id",
        "draw",
        "source",
        "size",
        "source_size",
        "target",
        finish(F.lit(0)).alias("first_finish"),
        reduce(Column.__add__, taken).alias("copies"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, all columns kept.

    Rows that are equal in id and text share what the mix takes of them.
    """
    shares = mix_sources(docs, **settings).groupBy("draw").agg(F.sum("copies").alias("mix_copies"))
    names = docs.columns
    marked = docs.select(whole_row(names).alias("row"), drawn(F.col("doc_id"), F.col("text")).alias("draw"))
    joined = marked.join(shares.withColumnRenamed("draw", "of_draw"), F.col("draw") == F.col("of_draw"))
    twin = Window.partitionBy("of_draw")
    n = F.count("*").over(twin)
    nth = F.row_number().over(twin.orderBy(F.xxhash64(F.col("row").cast("string"))))
    joined = joined.withColumn(
        "mine",
        F.floor(F.col("mix_copies") / n).cast("int") + F.when(nth <= F.col("mix_copies") % n, 1).otherwise(0),
    ).where("mine > 0")
    return joined.select(F.explode(F.array_repeat("row", F.col("mine"))).alias("row")).select("row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS draw
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS stop,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sizes),
ordered AS (SELECT *, stop::DOUBLE / weight AS fill FROM weighed),
levels AS (SELECT *,
    (budget - (sum(stop) OVER w - stop)) / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM ordered WINDOW w AS (ORDER BY fill, rank ROWS UNBOUNDED PRECEDING)),
water AS (SELECT arg_min(level, (fill, rank)) AS level FROM levels WHERE level < fill),
targets AS (SELECT source, source_size, coalesce(least(stop::DOUBLE, weight * water.level), stop::DOUBLE) AS target
  FROM levels, water),
queued AS (SELECT s.*, source_size, target,
    sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, CASE WHEN target > 0 THEN (ends + epoch * source_size)::DOUBLE / target ELSE 0 END AS finish
  FROM queued, (VALUES (0), (1)) e(epoch)),
mixed AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, draw, doc_id NULLS FIRST, epoch
    ROWS UNBOUNDED PRECEDING) <= (SELECT sum(target) FROM targets) AS taken FROM copies)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  (sum(CASE WHEN taken THEN size ELSE 0 END))::BIGINT AS taken
FROM mixed GROUP BY doc_id, draw
"""
