"""Language-model scores by deleted interpolation.

The model is a bigram model: a token's probability is a mixture of the uniform
distribution, its relative frequency, and its relative frequency after the token
before it. The mixture weights depend on how often the token before was seen (one set
per power of two). They are learned by expectation-maximisation: a part of the training
documents is deleted from the counts, and the weights are those that make the deleted
part most likely under the counts of the rest. Counts of the model are then those of
all training documents.

How it runs: documents are encoded once into blocks of a bounded number of tokens, each
with a table of its distinct words. A block asks for the counts of its distinct words,
and of its distinct pairs of words, in one message per range of hashes; the range's
task adds up what all blocks have and answers each block in the order of its question.
A word or pair that is very frequent is one entry per block, so no key gathers rows.
No table of words or pairs is held whole anywhere. Counts use 64-bit hashes of words and
pairs; over all of n distinct keys two are taken for one with a chance of n*n / 2**65.

Expectation-maximisation needs, of each deleted token, its context class and the two
ratios between its three probabilities. These are counted in a grid of fixed size (1/8
of a power of two), for all deleted tokens; only the grid comes to the driver.

A null text is empty: its only token is the end. A null id counts as training, its
text as any other. Repeated rows are scored row by row, and each counts. Other columns
are not looked at. An empty table gives no rows. If there is nothing to learn weights
from, all three parts weigh the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.llm.common import read_table, small_batches, written

BLOCK_TOKENS = 1_000_000
RANGE_KEYS = 1_000_000  # keys that the messages to one task hold, about
FOLDS, HELD_OUT, DELETED = 7, 2, 3
RETAINED_ROLE, DELETED_ROLE, HELD_OUT_ROLE = 0, 1, 2
ROUNDS = 200
# The grid: classes of the context's count, and 8 steps for each doubling of a ratio.
CLASSES, STEP, SPAN = 48, 8, 1024

BLOCKS = "block string, role int, n_tokens long, n_words long, doc_ids binary, ends binary, words binary, tokens binary"
ASKED = "part long, block string, keys binary, retained binary, deleted binary, deleted_context binary"
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)
ANSWERS = "block string, part long, retained binary, deleted binary, n_tokens long, n_types long"


def _packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _array(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), kind)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def encoded_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents as blocks: words are numbered by hash within a block; the end is a word."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        # Per role: rows of ids, numbers of words, tokens by document, number of tokens.
        fresh = lambda: [[], {b" ": 0}, [], 0]  # noqa: E731  no word is a space, so that is the end
        held = [fresh(), fresh(), fresh()]

        def flushed(role: int) -> pa.RecordBatch:
            nonlocal made
            ids, words, texts, n = held[role]
            held[role] = fresh()
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            made += 1
            row = {
                "block": f"{task}-{made}",
                "role": role,
                "n_tokens": n,
                "n_words": len(words),
                "doc_ids": _packed(np.array([[i or 0 for i in ids], [i is None for i in ids]], np.int64)),
                "ends": _packed(np.cumsum([len(t) for t in texts])),
                "words": np.sort(hashes).tobytes(),
                "tokens": _packed(place[np.concatenate(texts)]),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, role, text in zip(*(batch.column(i) for i in range(3))):
                role = role.as_py()
                into = held[role]
                numbers = into[1]
                tokens = (text.as_py() or "").encode().lower().split()
                known = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.uint32, len(tokens))
                into[0].append(doc_id.as_py())
                into[2].append(np.append(known, np.uint32(0)))
                into[3] += len(tokens) + 1
                if into[3] >= block_tokens:
                    yield flushed(role)
        for role in range(3):
            if held[role][0]:
                yield flushed(role)

    fields = [f.split(" ") for f in BLOCKS.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    role = F.when(fold == HELD_OUT, HELD_OUT_ROLE).when(fold == DELETED, DELETED_ROLE).otherwise(RETAINED_ROLE)
    return docs.select(F.col("doc_id").cast("long"), role.alias("role"), "text").mapInArrow(blocks, BLOCKS)


def _ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of 64-bit keys begins and ends in sorted ``keys``."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _asked(block: str, role: int, keys: np.ndarray, counts: np.ndarray, parts: int, context=None) -> pd.DataFrame:
    """A block's messages. Held-out documents ask too, but add nothing."""
    at = _ranges(keys, parts)
    rows = []
    for part in range(parts):
        some = slice(at[part], at[part + 1])
        if some.start == some.stop:
            continue
        mine = _packed(counts[some].astype(np.uint32))
        rows.append(
            (
                part,
                block,
                keys[some].tobytes(),
                mine if role == RETAINED_ROLE else None,
                mine if role == DELETED_ROLE else None,
                None if context is None else _packed(context[:, some]),
            )
        )
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in ASKED.split(", ")])


def _block_pairs(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, second word, pair of each token) of a block; pairs are distinct and sorted by key.

    The word before a document's first is the end.
    """
    words = np.frombuffer(row["words"], np.uint64)
    tokens, ends = _array(row["tokens"], np.uint32), _array(row["ends"], np.int64)
    end = tokens[-1]
    before = np.concatenate([[end], tokens[:-1]]).astype(np.uint32)
    before[ends[:-1]] = end
    pairs, of_token = np.unique(before.astype(np.uint64) << np.uint64(32) | tokens, return_inverse=True)
    first = (pairs >> np.uint64(32)).astype(np.int64)
    second = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys = _pair_keys(words[first], words[second])
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], second[order], keys[order], place[of_token], tokens


def _answered(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(retained, deleted) counts of all keys of a block, in the order of its keys."""
    answers = answers.sort_values("part")
    whole = lambda c: np.concatenate([_array(x, np.uint32) for x in answers[c]]).astype(np.int64)
    return whole("retained"), whole("deleted")


def _cells(context: np.ndarray, uni: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Places in the grid: context class, and the steps of uni / uniform and bi / uniform."""
    step = lambda r: np.where(r > 0, np.clip(np.rint(np.log2(np.maximum(r, 2.0**-60)) * STEP) + SPAN // 2, 1, SPAN - 1), 0)
    kind = np.minimum(np.frexp(context.astype(np.float64))[1], CLASSES - 1)
    return ((kind * SPAN + step(uni)) * SPAN + step(bi)).astype(np.int64)


def _summed(frame: pd.DataFrame, totals: tuple[int, int] | None) -> pd.DataFrame:
    """Answers to all messages of a range. With ``totals`` (retained tokens, types) the deleted
    tokens' grid cells are given as well, in a row without block."""
    keys = [np.frombuffer(x, np.uint64) for x in frame["keys"]]
    at = np.cumsum([0] + [len(k) for k in keys])
    types, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = {}
    for role in ("retained", "deleted"):
        has = [_array(x, np.uint32) if x is not None else np.zeros(len(k), np.uint32) for x, k in zip(frame[role], keys)]
        sums[role] = np.bincount(place, np.concatenate(has), len(types)).astype(np.int64)
    rows = [
        (block, part, *(_packed(sums[r][place[at[i] : at[i + 1]]].astype(np.uint32)) for r in ("retained", "deleted")), None, None)
        for i, (block, part) in enumerate(zip(frame["block"], frame["part"]))
    ]
    both = sums["retained"] + sums["deleted"]
    if totals is None:
        rows.append((None, int(frame["part"].iloc[0]), None, None, int(both.sum()), int((both > 0).sum())))
        rows.append((None, -1, None, None, int(sums["retained"].sum()), int((sums["retained"] > 0).sum())))
    else:
        n, v = totals
        cells, weights = [], []
        for i, (context, counts) in enumerate(zip(frame["deleted_context"], frame["deleted"])):
            if context is None:
                continue
            first, second = _array(context, np.uint32).reshape(2, -1).astype(np.float64)
            pair = sums["retained"][place[at[i] : at[i + 1]]]
            bi = np.where(first > 0, pair / np.maximum(first, 1), 0)
            cells.append(_cells(first, second / max(n, 1) * (v + 1), bi * (v + 1)))
            weights.append(_array(counts, np.uint32))
        if cells:
            cell, place = np.unique(np.concatenate(cells), return_inverse=True)
            weight = np.bincount(place, np.concatenate(weights)).astype(np.int64)
            rows.append((None, 0, cell.tobytes(), weight.tobytes(), None, None))
    frame = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in ANSWERS.split(", ")])
    return frame.astype({"n_tokens": "Int64", "n_types": "Int64"})


def learned_weights(grid: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """(class, part) mixture weights by expectation-maximisation over the grid's cells.

    A context that was never seen has no third part; a class without deleted tokens takes
    the weights of the next class below that has some.
    """
    weights = np.full((CLASSES, 3), 1 / 3)
    kind, rest = grid // SPAN**2, grid % SPAN**2
    ratio = lambda s: np.where(s > 0, 2.0 ** ((s - SPAN // 2) / STEP), 0.0)
    parts = np.stack([np.ones(len(grid)), ratio(rest // SPAN), ratio(rest % SPAN)], axis=1)
    last = np.full(3, 1 / 3)
    for c in range(CLASSES):
        mine, n = parts[kind == c], counts[kind == c]
        if n.sum() > 0:
            last = np.full(3, 1 / 3)
            for _ in range(rounds):
                share = mine * last
                last = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            # Every part keeps a little, so that nothing has probability 0.
            last = (last + 1e-6) / (1 + 3e-6)
        weights[c] = last
    weights[0, 1] += weights[0, 2]
    weights[0, 2] = 0
    return weights


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    range_keys: int = RANGE_KEYS,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = written(encoded_blocks(rows, block_tokens), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    pair_parts, word_parts = (max(1, ceil(n / range_keys)) for n in size)

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                counts = np.bincount(_array(row["tokens"], np.uint32), minlength=row["n_words"])
                yield _asked(row["block"], row["role"], np.frombuffer(row["words"], np.uint64), counts, word_parts)

    def ask_pairs(row, context: np.ndarray | None) -> pd.DataFrame:
        first, second, keys, of_token, _ = _block_pairs(row)
        counts = np.bincount(of_token, minlength=len(keys))
        known = None if context is None else np.stack([context[first], context[second]]).astype(np.uint32)
        return _asked(row["block"], row["role"], keys, counts, pair_parts, known)

    def ask_plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                yield ask_pairs(row, None)

    def ask_deleted(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return ask_pairs(block.iloc[0], _answered(answers)[0])

    asked = blocks.select("block", "role", "n_words", "words", "tokens").mapInPandas(ask_words, ASKED)
    words = written(asked.groupBy("part").applyInPandas(lambda f: _summed(f, None), ANSWERS), "words")
    totals = words.where("block IS NULL").groupBy((F.col("part") < 0).alias("retained"))
    totals = {r["retained"]: r for r in totals.agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).collect()}
    of = lambda retained: (totals[retained]["n"], totals[retained]["v"]) if retained in totals else (0, 0)
    (n, v), retained = of(False), of(True)

    needed = blocks.select("block", "role", "words", "tokens", "ends")
    word_answers = words.where("block IS NOT NULL").select("block", "part", "retained", "deleted")
    plain = needed.where(F.col("role") != DELETED_ROLE).mapInPandas(ask_plain, ASKED)
    some = needed.where(F.col("role") == DELETED_ROLE)
    of_some = word_answers.join(some.select("block"), "block", "left_semi")
    with_context = some.groupBy("block").cogroup(of_some.groupBy("block")).applyInPandas(ask_deleted, ASKED)
    asked = plain.unionByName(with_context)
    pairs = written(asked.groupBy("part").applyInPandas(lambda f: _summed(f, retained), ANSWERS), "pairs")
    # The grid has a fixed number of cells, each message at most that many.
    cells = pairs.where("block IS NULL").select("retained", "deleted")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, count in zip(batch["retained"], batch["deleted"]):
                yield pd.DataFrame({"cell": np.frombuffer(cell, np.int64), "n": np.frombuffer(count, np.int64)})

    grid = cells.mapInPandas(opened, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learned_weights(grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(np.float64))

    def scored(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        first, second, _, of_token, tokens = _block_pairs(row)
        word = sum(_answered(answers[answers["kind"] == 0]))
        pair = sum(_answered(answers[answers["kind"] == 1]))
        context, count = word[first], word[second]
        kind = np.minimum(np.frexp(context.astype(np.float64))[1], CLASSES - 1)
        w = weights[kind]
        mixed = w[:, 0] / (v + 1) + w[:, 1] * count / max(n, 1) + w[:, 2] * pair / np.maximum(context, 1)
        by_token = np.log10(mixed)[of_token]
        base = np.log10((word[tokens] + 1) / (n + v + 1))
        ends = _array(row["ends"], np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        ids = _array(row["doc_ids"], np.int64).reshape(2, -1)
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(ids[0].copy(), ids[1] > 0),
                "held_out": row["role"] == HELD_OUT_ROLE,
                "n_tokens": ends - starts,
                "n_known": np.add.reduceat((word[tokens] > 0).astype(np.int64), starts),
                "train_tokens": n,
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(by_token, starts),
            }
        )

    pair_answers = pairs.where("block IS NOT NULL").select("block", "part", "retained", "deleted")
    answers = word_answers.withColumn("kind", F.lit(0)).unionByName(pair_answers.withColumn("kind", F.lit(1)))
    whole = blocks.select("block", "role", "words", "tokens", "ends", "doc_ids")
    return whole.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, SCORES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document."""
    return score_documents(read_table(spark, sf_dir, "documents"))
