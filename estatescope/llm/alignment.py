"""Alignment of two tokenizers' tokens by merge-path partitioning.

Every text is encoded by tokenizer A (byte-level BPE, with a space before the text) and
tokenizer B (sentence pieces, which adds the space itself). Both token lists then cover
the same bytes, and the byte offsets where tokens of both end cut them into groups.

Finding these offsets is a merge of two sorted lists of ends. Binary searches along
evenly spaced diagonals of the merge cut it into pieces of equal work, whatever the
shares of A and B; equal ends are never parted. Pieces are rows that are merged without
knowledge of each other: each gives the token numbers of the stops that it sees, and is
written with its ids. A group that crosses a piece's border is stitched where the pieces
of a document come together: it has the tokens between one piece's last stop and the next
stop in a later piece.

A token pair is linked where its tokens share a group, and its count is the number of
documents that hold it linked. Counts need a row per pair and batch of documents, not one per link.
Pairs with large counts, at most ``FREQUENT`` of them, are sent to all tasks, which look
up what a document holds of them; what is left, which is spread over many pairs, goes
through a join. The highest count of each A id is one number per id of the vocabulary.

Null and empty texts, and texts whose tokens do not spell the text after a space (B may
rewrite or lack characters) have no tokens: zeros, and '' instead of a hash. Repeated
rows and ids are documents of their own; a null id stays null. Other columns are not
looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.llm.common import read_table, small_batches, written
from estatescope.llm.packing import RANKS
from estatescope.llm.repeats import packed, unpacked

PIECES = "piece_bpe_32k.model"
WORK = 16_384  # ends of A and B together in a piece
FREQUENT = 1_000_000  # pairs that every task knows, 16 bytes each
LINKS = 1 << 19  # links that are listed at a time
HELD = 1 << 20  # distinct pairs that a task gathers before it passes them on

TOKENS = "row long, piece int, pieces int, a_at long, b_at long, a_begin long, b_begin long, a_ids binary, b_ids binary"
MERGED = "row long, piece int, pieces int, a_at long, b_at long, a_ids binary, b_ids binary, a_steps binary, b_steps binary"
SCORES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
NO_PAIR = -1


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def byte_tokens(path: str | None = None) -> tuple:
    """Tokenizer A: text to ids, and the bytes of every id."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary
    table = [b""] * (max(ranks.values()) + 1)
    for data, i in ranks.items():
        table[i] = data
    return lambda text: encode(" " + text), table


def piece_tokens(path: str | None = None) -> tuple:
    """Tokenizer B: text to ids, and the bytes of every id."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))

    def spelt(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda text: model.encode(text, num_threads=1), [spelt(i) for i in range(model.get_piece_size())]


def cuts(a_ends: np.ndarray, b_ends: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A and of B lie before each border of pieces of ``work`` ends, both
    outer borders included.

    On the diagonal d lie the ways to take d ends; the one that a merge takes, A first
    among equals, is found by halving.
    """
    n, m = len(a_ends), len(b_ends)
    d = np.arange(work, n + m, work)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        taken = open_ & (a_ends[np.minimum(mid, n - 1)] <= b_ends[np.clip(d - mid - 1, 0, m - 1)])
        low, high = np.where(taken, mid + 1, low), np.where(open_ & ~taken, mid, high)
    i, j = low, d - low
    if len(d):
        parted = (i > 0) & (j < m) & (a_ends[i - 1] == b_ends[np.minimum(j, m - 1)])
        j = j + parted
    return np.concatenate([[0], i, [n]]), np.concatenate([[0], j, [m]])


def stops(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B tokens up to each end that both have."""
    if not len(b_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(b_ends, a_ends)
    common = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends
    return np.flatnonzero(common) + 1, at[common] + 1


def linked(a_ids: np.ndarray, b_ids: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray, most: int = LINKS) -> tuple:
    """Distinct linked pairs, as A id * 2**32 + B id in order, and how often each is linked.

    Links are listed at most ``most`` at a time, or those of one A token.
    """
    none = np.empty(0, np.int64)
    if not len(a_stops):
        return none, none
    b_sizes = np.diff(b_stops, prepend=0)
    group = np.repeat(np.arange(len(a_stops)), np.diff(a_stops, prepend=0))
    each, first = b_sizes[group], (b_stops - b_sizes)[group]
    until = np.cumsum(each)
    pairs, times, at = [], [], 0
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + most, side="right")))
        n = each[at:stop]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        some = (np.repeat(a_ids[at:stop].astype(np.int64), n) << 32) + b_ids[np.repeat(first[at:stop], n) + within]
        p, t = np.unique(some, return_counts=True)
        pairs.append(p)
        times.append(t)
        if len(pairs) > 1 and sum(map(len, pairs)) > 2 * most:
            pairs, times = ([x] for x in summed(np.concatenate(pairs), np.concatenate(times)))
        at = stop
    return (pairs[0], times[0]) if len(pairs) == 1 else summed(np.concatenate(pairs), np.concatenate(times))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in order, and the sums of their ``values``."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(values, at) if len(at) else values


def _narrow(numbers: np.ndarray) -> bytes:
    """Packed numbers of one, two or four bytes, as few as they fit; the first byte is their width."""
    most = numbers.max(initial=0)
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + packed(numbers.astype(f"<u{width}"))


def _wide(data: bytes) -> np.ndarray:
    return unpacked(data[1:], f"<u{data[0]}")


def token_pieces(docs: DataFrame, work: int, a_path: str | None, b_path: str | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the tokens of all documents in pieces of equal work: where a piece begins in
    tokens (at) and bytes (begin), and its ids."""
    long, short = pa.int64(), pa.int32()
    names = ["doc_id", *_names(TOKENS)]
    kinds = [long, long, short, short, long, long, long, long, pa.binary(), pa.binary()]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (encode_a, a_bytes), (encode_b, b_bytes) = byte_tokens(a_path), piece_tokens(b_path)
        a_length, b_length = _lengths(a_bytes), _lengths(b_bytes)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                text, row = value.as_py(), row + 1
                a, b = (encode_a(text), encode_b(text)) if text else ([], [])
                data = b" " + (text or "").encode()
                if b"".join([a_bytes[i] for i in a]) != data or b"".join([b_bytes[i] for i in b]) != data:
                    a, b = [], []
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                a_ends, b_ends = np.cumsum(a_length[a]), np.cumsum(b_length[b])
                i, j = cuts(a_ends, b_ends, work)
                for k in range(len(i) - 1):
                    mine = slice(i[k], i[k + 1]), slice(j[k], j[k + 1])
                    begin = (int(e[x.start - 1]) if x.start else 0 for e, x in zip((a_ends, b_ends), mine))
                    rows.append((doc_id.as_py(), row, k, len(i) - 1, i[k], j[k], *begin, _narrow(a[mine[0]]), _narrow(b[mine[1]])))
            lists = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(lists, kinds)], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(encoded, f"doc_id long, {TOKENS}")


def _lengths(table: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in table], np.int64)


def merged(pieces: DataFrame, a_path: str | None, b_path: str | None) -> DataFrame:
    """Each piece by itself: its ids, and the tokens from stop to stop, the first from where it begins."""
    a_length, b_length = _lengths(byte_tokens(a_path)[1]), _lengths(piece_tokens(b_path)[1])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {name: batch.column(name) for name in ("a_ids", "b_ids")}
            steps = [[], []]
            for f in zip(*(batch.column(c).to_pylist() for c in ("a_begin", "b_begin", "a_ids", "b_ids"))):
                a_begin, b_begin, a, b = f
                found = stops(a_begin + np.cumsum(a_length[_wide(a)]), b_begin + np.cumsum(b_length[_wide(b)]))
                for side, x in zip(steps, found):
                    side.append(_narrow(np.diff(x, prepend=0)))
            kept = [batch.column(c) for c in ("doc_id", "row", "piece", "pieces", "a_at", "b_at")]
            arrays = [*kept, of["a_ids"], of["b_ids"], *(pa.array(x, pa.binary()) for x in steps)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_names(MERGED)])

    return pieces.mapInArrow(merge, f"doc_id long, {MERGED}")


def alignments(
    docs: DataFrame,
    work: int = WORK,
    a_path: str | None = None,
    b_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The merged pieces of all documents, as a written table: no text is encoded twice."""
    small_batches(docs.sparkSession)
    pieces = token_pieces(docs, work, a_path, b_path, id_col, text_col)
    return written(merged(pieces, a_path, b_path), "alignments")


def _rows(table: DataFrame) -> DataFrame:
    """``table`` with all pieces of a document after each other; only documents of several are moved."""
    table = table.select(*_names(MERGED))
    several = table.where("pieces > 1").repartition("row").sortWithinPartitions("row", "piece")
    return table.where("pieces = 1").unionByName(several)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(row, A ids, B ids, A stops, B stops) of whole documents, one at a time.

    Pieces are put together by their numbers of tokens; so a group may begin in one piece
    and end in a later one.
    """
    parts = []
    for batch in batches:
        for f in batch.itertuples(index=False):
            i, j = (at + np.cumsum(_wide(x), dtype=np.int64) for at, x in ((f.a_at, f.a_steps), (f.b_at, f.b_steps)))
            parts.append((_wide(f.a_ids).astype(np.int64), _wide(f.b_ids).astype(np.int64), i, j))
            if len(parts) == f.pieces:
                yield f.row, *(parts[0] if f.pieces == 1 else map(np.concatenate, zip(*parts)))
                parts = []


def alignment_groups(table: DataFrame) -> DataFrame:
    """One row per group of ``alignments``: doc_id, row (a number of its own for each document),
    nth (from 0), a_ids, b_ids."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, a, b, i, j in _documents(batches):
            if len(i):
                sides = [np.split(x.astype(np.int32), s[:-1]) for x, s in ((a, i), (b, j))]
                yield pd.DataFrame({"row": row, "nth": np.arange(len(i)), "a_ids": sides[0], "b_ids": sides[1]})

    groups = _rows(table).mapInPandas(listed, "row long, nth long, a_ids array<int>, b_ids array<int>")
    ids = table.where("piece = 0").select("row", "doc_id")
    return ids.join(groups, "row").select("doc_id", "row", "nth", "a_ids", "b_ids")


def pair_counts(table: DataFrame, held: int = HELD) -> DataFrame:
    """(pair, docs): in how many documents of ``alignments`` each pair is linked; a written table."""

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.empty(0, np.int64)
        keys, counts, new, size = none, none, [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            fresh, times = np.unique(np.concatenate([none, *new]), return_counts=True)
            return summed(np.concatenate([keys, fresh]), np.concatenate([counts, times]))

        for _, *document in _documents(batches):
            new.append(linked(*document)[0])
            size += len(new[-1])
            if size > held:
                keys, counts = folded()
                new, size = [], 0
                if len(keys) > held:
                    yield pd.DataFrame({"pair": keys, "docs": counts})
                    keys = counts = none
        keys, counts = folded()
        yield pd.DataFrame({"pair": keys, "docs": counts})

    found = _rows(table).mapInPandas(gathered, "pair long, docs long")
    return written(found.groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")


def frequent_pairs(counts: DataFrame, most: int = FREQUENT) -> pd.DataFrame:
    """Pairs, in order, with a count of at least the least power of two that not more than ``most`` reach."""
    powers = range(62)
    reached = counts.agg(*(F.count(F.when(F.col("docs") >= 2**k, 1)).alias(f"p{k}") for k in powers)).first()
    least = next((2**k for k in powers if reached[k] <= most), 2**62)
    return counts.where(F.col("docs") >= least).toPandas().sort_values("pair", ignore_index=True)


def _scored(table: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Sums per document, in one or more rows each: row, SCORES, groups_sha256."""
    known = frequent_pairs(counts, most)
    keys, docs = known["pair"].to_numpy(np.int64), known["docs"].to_numpy(np.int64)
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("best"))
    best = written(best, "best")
    tops = best.toPandas()  # one row per id of the vocabulary at most
    top = np.zeros(int(tops["a"].max()) + 1 if len(tops) else 1, np.int64)
    top[tops["a"].to_numpy(np.int64)] = tops["best"].to_numpy(np.int64)
    told = table.sparkSession.sparkContext.broadcast((keys, docs, top))
    names = ["row", *_names(SCORES), "groups_sha256", "pair", "times"]

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, docs, top = told.value
        texts = np.array([f"{i}{mark}" for mark in ",|;" for i in range(1 << 16)], object)
        rows, rest, size = [], [], 0

        def made() -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=names)
            if not rest:
                return frame
            missed = pd.concat([pd.DataFrame({"row": r, "pair": p, "times": t}) for r, p, t in rest])
            missed = missed.reindex(columns=names, fill_value=0).assign(groups_sha256=None)
            return pd.concat([frame, missed]) if rows else missed

        for row, a, b, i, j in _documents(batches):
            pairs, times = linked(a, b, i, j)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n, t = docs[at[found]], times[found]
            n_best = int(t[n == top[pairs[found] >> 32]].sum())
            digest = hashlib.sha256(_spelt(a, b, i, j, texts).encode()).hexdigest() if len(i) else ""
            rows.append((row, len(a), len(b), len(i), int(times.sum()), n_best, int((n * t).sum()), digest, NO_PAIR, 0))
            if not found.all():
                rest.append((row, pairs[~found], times[~found]))
                size += len(rest[-1][1])
            if len(rows) >= 1000 or size > HELD:
                yield made()
                rows, rest, size = [], [], 0
        if rows:
            yield made()

    both = _rows(table).mapInPandas(looked_up, f"row long, {SCORES}, groups_sha256 string, pair long, times long")
    both = written(both, "scores")
    rare = both.where(F.col("pair") != NO_PAIR).select("row", "pair", "times").join(counts, "pair")
    rare = rare.join(F.broadcast(best), F.shiftright("pair", 32) == F.col("a")).select(
        "row",
        F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
        (F.col("docs") * F.col("times")).alias("count_sum"),
    )
    settled = both.where(F.col("pair") == NO_PAIR).drop("pair", "times")
    return settled.unionByName(rare, allowMissingColumns=True)


def _spelt(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, texts: np.ndarray) -> str:
    """Groups as text: ids of A, a bar, ids of B, a semicolon between groups."""
    size = len(texts) // 3
    if max(a.max(), b.max()) >= size:
        groups = zip(np.split(a, i[:-1]), np.split(b, j[:-1]))
        return ";".join("|".join(",".join(map(str, side.tolist())) for side in group) for group in groups)
    a, b = a.copy(), b.copy()
    a[i - 1] += size
    b[j - 1] += 2 * size
    # Before the A tokens of a group stand the B tokens of those before, and before its B tokens all its A tokens.
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + np.repeat(np.append(0, j[:-1]), np.diff(i, prepend=0))] = a
    codes[np.arange(len(b)) + np.repeat(i, np.diff(j, prepend=0))] = b
    return "".join(texts[codes].tolist())[:-1]


def alignment_scores(docs: DataFrame, most: int = FREQUENT, **settings) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the
    highest count of its A id), count_sum (of its links), groups_sha256; ``settings`` as for ``alignments``."""
    table = alignments(docs, **settings)
    scored = _scored(table, pair_counts(table), most)
    ids = table.where("piece = 0").select("row", "doc_id")
    return (
        ids.unionByName(scored, allowMissingColumns=True)
        .groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in _names(SCORES)),
            F.coalesce(F.max("groups_sha256"), F.lit("")).alias("groups_sha256"),
        )
        .drop("row")
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and pair counts of the two tokenizers over all documents."""
    return alignment_scores(read_table(spark, sf_dir, "documents"))
