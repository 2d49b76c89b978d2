"""Removal of repeated byte windows, by a depth-limited radix sort of windows.

All windows of ``depth`` bytes are sorted by most-significant-digit passes, each of
which looks only at windows that the pass before left in a group of two or more; what
is equal after the last pass is exactly the repeated windows. The digits are taken from
each window in an order that depends on its content alone, so that equal windows are
split alike and one record stands for many windows:

1. The first digit is the window's seed: of its substrings of ``SEED`` bytes the one
   with the smallest hash (the first of these). Neighbouring windows share it, so there
   is one record per some 35 windows: the seed, and the run of starts that it serves.
   Records whose seed no other record has are done.
2. The second digit is the whole stretch that the record's windows cover. Of records
   that are equal in it, all but the first hold only windows that start earlier too.
3. Firsts that share their seed with another stretch are taken apart into windows, and
   the last digit is the window. All but the first of each group start earlier too.

Records are packed in blocks with the text they come from, in a table bucketed by block
that every pass reads in place. In a pass a block sends one packed message to each
range of digits and gets a small number back per entry. A block sends a seed or a
window once, with its first place, so one that is very frequent has one entry per block.

Windows never cross documents. First is by id, then by the order in which rows with
equal or null ids were read; null ids come last. Digits are compared by 64-bit hashes:
of n windows that reach the last pass, n / 2**65 is the chance that one is wrongly
taken for a repeat. Null and empty texts, and texts shorter than a window, lose nothing.
Very long texts are hashed in bounded pieces. Other columns are kept if named. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from estatescope.llm.common import read_table, shared_folder, small_batches, whole_row, written
from estatescope.llm.repeats import QUESTIONS, REPLIES, heard, packed, questions, replies, unpacked

DEPTH = 100
SEED = 32
PIECE = 1 << 17  # bytes that are hashed at a time
BLOCK_BYTES = 2 << 20
NO_ID = 2**63 - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

RANGE_KEYS = 500_000  # entries that the messages to one task hold, about
LATER, SHARED = 1, 2  # bits of the answers: an equal entry comes earlier; the seed has several stretches

BLOCKS = (
    "block string, n_records long, seeds binary, stretches binary, runs binary, pieces binary, "
    "texts binary, sizes binary, doc_ids binary, extras binary"
)


class Rolling:
    """Hashes of substrings of a piece of bytes, by sums of byte * base ** place."""

    def __init__(self, base: int, most: int) -> None:
        self.letters = np.random.default_rng(base).integers(1, 2**63, 256, dtype=np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            steps = np.full(most + 1, base, np.uint64)
            steps[0] = 1
            self.powers = np.multiply.accumulate(steps)
            steps[1:] = np.uint64(pow(base, -1, 1 << 64))
            self.inverse = np.multiply.accumulate(steps)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.inverse[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n, span = len(x) - width + 1, 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def seed_records(data: np.ndarray, ends: np.ndarray, rolling: Rolling, depth: int) -> tuple[np.ndarray, ...]:
    """(seed, stretch, first, last) of the runs of windows in ``data``, which holds texts that
    end at ``ends``; places are those in ``data``."""
    none = np.empty(0, np.int64)
    if len(data) < depth:
        return none.view(np.uint64), none.view(np.uint64), none, none
    sums = rolling.sums(data)
    at = np.arange(len(data) - SEED + 1)
    seeds = rolling.of(sums, at, at + SEED)
    # The place in the low bits makes the first of equal seeds the smallest.
    ranked = (seeds & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    best = (_sliding_least(ranked, depth - SEED + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(best))
    text = np.searchsorted(ends, starts, side="right")
    inside = starts + depth <= ends[text]
    starts, best, text = starts[inside], best[inside], text[inside]
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none
    new = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    first = starts[new]
    last = starts[np.append(new[1:], len(starts)) - 1]
    anchor = best[new]
    with np.errstate(over="ignore"):
        shape = ((anchor - first) * 1024 + (last - first)).astype(np.uint64) * np.uint64(BASES[1])
    return seeds[anchor], rolling.of(sums, first, last + depth) ^ shape, first, last


def _pieces(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, text number, start in the text): texts put together up to ``PIECE`` bytes;
    a longer one in pieces that overlap by depth - 1, so each window is in one of them."""
    some, size = [], 0
    for number, text in enumerate(texts):
        for start in range(0, max(len(text) - depth + 1, 1), PIECE):
            part = text[start : start + PIECE + depth - 1]
            if size and size + len(part) > PIECE + depth:
                yield _joined(some)
                some, size = [], 0
            some.append((part, number, start))
            size += len(part)
    if some:
        yield _joined(some)


def _joined(some: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(x[0] for x in some), np.uint8)
    ends = np.cumsum([len(x[0]) for x in some])
    return data, ends, np.array([x[1] for x in some]), np.array([x[2] for x in some])


def _rolling(base: int, depth: int) -> Rolling:
    return Rolling(base, PIECE + 2 * depth)


def _stream(arrays: list[pa.Array]) -> bytes:
    """Arrow arrays of one type, one after the other, as bytes."""
    if not arrays:
        return b""
    column = pa.concat_arrays(arrays)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("extra", column.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column], names=["extra"]))
    return sink.getvalue().to_pybytes()


def _in_utc(kind: pa.DataType) -> pa.DataType:
    """An Arrow type with its times in the zone in which Spark takes them back."""
    if pa.types.is_timestamp(kind) and kind.tz:
        return pa.timestamp(kind.unit, "UTC")
    if pa.types.is_struct(kind):
        return pa.struct([f.with_type(_in_utc(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(kind.value_field.with_type(_in_utc(kind.value_type)))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_field.with_type(_in_utc(kind.key_type)), kind.item_field.with_type(_in_utc(kind.item_type)))
    return kind


def text_blocks(docs: DataFrame, extras: list[str], depth: int, block_bytes: int) -> DataFrame:
    """Blocks of documents with their texts and seed records."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        rolling = _rolling(BASES[0], depth)
        texts, ids, more, size = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            nonlocal texts, ids, more, size, made
            block = (task << 16) + made
            found = []
            for data, ends, number, start in _pieces(texts, depth):
                seeds, stretch, first, last = seed_records(data, ends, rolling, depth)
                part = np.searchsorted(ends, first, side="right")
                shift = start[part] - np.append(0, ends)[part]
                found.append((seeds, stretch, np.stack([number[part], first + shift, last + shift])))
            runs = np.concatenate([f[2] for f in found], axis=1)
            known = np.array([[i or 0 for i in ids], [i is not None for i in ids]], np.int64)
            row = (
                str(block),
                runs.shape[1],
                np.concatenate([f[0] for f in found]).tobytes(),
                np.concatenate([f[1] for f in found]).tobytes(),
                packed(np.diff(runs, axis=1, prepend=0)),
                packed(np.array([len(f[0]) for f in found], np.int64)),
                packed(np.frombuffer(b"".join(texts), np.uint8)),
                packed(np.array([len(t) for t in texts], np.int64)),
                packed(known),
                packed(np.frombuffer(_stream(more), np.uint8)),
            )
            texts, ids, more, size, made = [], [], [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in batches:
            rest = batch.column(2)
            for i, (doc_id, text) in enumerate(zip(batch.column(0), batch.column(1))):
                extra = rest.slice(i, 1)
                data = (text.as_py() or "").encode()
                texts.append(data)
                ids.append(doc_id.as_py())
                if extras:
                    more.append(extra)
                size += len(data) + 64
                if size >= block_bytes:
                    yield flushed()
        if ids:
            yield flushed()

    names = [f.split(" ")[0] for f in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int64()] + [pa.binary()] * 8
    rest = whole_row(extras) if extras else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), "text", rest.alias("extra")).mapInArrow(blocks, BLOCKS)


def _bucketed(df: DataFrame, purpose: str, column: str, buckets: int) -> DataFrame:
    """A written table, bucketed by ``column``: later groupings by it read it in place."""
    spark = df.sparkSession
    name = f"{purpose}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", shared_folder(spark, purpose)).saveAsTable(name)
    return spark.table(name)


class _Block:
    """What a block knows after the passes so far, worked out again from its row and answers."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, depth: int, parts: tuple[int, int]) -> None:
        self.row, self.answers, self.depth, self.parts = row, answers, depth, parts
        self.seeds = np.frombuffer(row["seeds"], np.uint64)
        self.stretches = np.frombuffer(row["stretches"], np.uint64)
        runs = unpacked(row["runs"], np.int64).reshape(3, -1)
        self.number, self.first, self.last = np.cumsum(runs, axis=1)
        ids = unpacked(row["doc_ids"], np.int64).reshape(2, -1)
        self.doc_id = np.where(ids[1] == 1, ids[0], NO_ID)
        self.rank = np.empty(len(self.doc_id), np.int64)
        self.rank[np.lexsort((np.arange(len(self.doc_id)), self.doc_id))] = np.arange(len(self.doc_id))

    def _place(self, number: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """Columns whose order, over all blocks, says what comes first."""
        return [self.doc_id[number], (int(self.row["block"]) << 20) + number, start]

    def ask_seeds(self) -> tuple[np.ndarray, list[np.ndarray]]:
        seeds, counts = np.unique(self.seeds, return_counts=True)
        return seeds, [counts > 1]

    def ask_stretches(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """One entry for each repeated seed: its first stretch here, and whether it has others."""
        seeds, _ = self.ask_seeds()
        repeated = heard(self.answers, 1, seeds, self.parts[0]) > 0
        mine = np.flatnonzero(repeated[np.searchsorted(seeds, self.seeds)]) if len(seeds) else np.empty(0, np.int64)
        place = self.first[mine], self.rank[self.number[mine]]
        mine = mine[np.lexsort((*place, self.stretches[mine], self.seeds[mine]))]
        seed, stretch = self.seeds[mine], self.stretches[mine]
        new_seed = np.append(True, seed[1:] != seed[:-1])[: len(seed)]
        new = new_seed | np.append(True, stretch[1:] != stretch[:-1])[: len(seed)]
        self.later, self.firsts = mine[~new], mine[new]
        self.seed_of = np.cumsum(new_seed[new]) - 1
        self.chosen = np.flatnonzero(new_seed[new])
        several = np.bincount(self.seed_of, minlength=len(self.chosen)) > 1
        entry = self.firsts[self.chosen]
        order = np.argsort(entry)  # in the order of places, which packs
        self.asked, self.several = order, several
        entry = entry[order]
        columns = [self.stretches[entry].view(np.int64), *self._place(self.number[entry], self.first[entry]), several[order]]
        return self.seeds[entry], columns

    def ask_windows(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The first of each window of the records that are taken apart."""
        seeds, _ = self.ask_stretches()
        said = np.zeros(len(seeds), np.uint8)
        said[self.asked] = heard(self.answers, 2, seeds, self.parts[0])
        apart = ((said & SHARED > 0) | self.several)[self.seed_of]
        gone = np.zeros(len(self.firsts), bool)
        gone[self.chosen] = said & LATER > 0
        self.later = np.concatenate([self.later, self.firsts[gone]])
        keys, number, start = self._windows(np.sort(self.firsts[apart & ~gone]))
        order = np.lexsort((start, self.rank[number], keys))
        new = np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)]
        self.later_windows = number[order[~new]], start[order[~new]]
        once = np.sort(order[new])
        self.windows = number[once], start[once]
        return keys[once], self._place(*self.windows)

    def _windows(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text number, start) of every window of ``records``."""
        bounds = np.append(0, np.cumsum(unpacked(self.row["pieces"], np.int64)))
        rolling, keys, numbers, starts = None, [], [], []
        for k, (data, ends, number, start) in enumerate(_pieces(_texts(self.row), self.depth)):
            mine = records[np.searchsorted(records, bounds[k]) : np.searchsorted(records, bounds[k + 1])]
            if not len(mine):
                continue
            rolling = rolling or _rolling(BASES[1], self.depth)
            count = self.last[mine] - self.first[mine] + 1
            which = np.repeat(np.arange(len(mine)), count)
            begin = self.first[mine][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            # Texts of a piece have rising numbers; a long text is alone in its pieces but the last.
            part = np.searchsorted(number, self.number[mine])[which]
            at = begin - start[part] + np.append(0, ends)[part]
            keys.append(rolling.of(rolling.sums(data), at, at + self.depth))
            numbers.append(self.number[mine][which])
            starts.append(begin)
        none = np.empty(0, np.int64)
        return np.concatenate([none.view(np.uint64), *keys]), np.concatenate([none, *numbers]), np.concatenate([none, *starts])

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end) of what is covered by windows that start earlier too."""
        keys, _ = self.ask_windows()
        later = heard(self.answers, 3, keys, self.parts[1]) & LATER > 0
        number = [self.number[self.later], self.later_windows[0], self.windows[0][later]]
        start = [self.first[self.later], self.later_windows[1], self.windows[1][later]]
        end = [self.last[self.later] + self.depth, *(s + self.depth for s in start[1:])]
        return tuple(map(np.concatenate, (number, start, end)))


def _is_repeated(seeds: np.ndarray, columns: np.ndarray) -> np.ndarray:
    _, place = np.unique(seeds, return_inverse=True)
    return (np.bincount(place, 1 + columns[0]) > 1)[place]


def _compared(seeds: np.ndarray, columns: np.ndarray) -> np.ndarray:
    stretch, doc_id, uid, first, several = columns
    order = np.lexsort((first, uid, doc_id, stretch, seeds))
    seed, stretch = seeds[order], stretch[order]
    new_seed = np.append(True, seed[1:] != seed[:-1])
    new = new_seed | np.append(True, stretch[1:] != stretch[:-1])
    which = np.cumsum(new_seed) - 1
    shared = np.bincount(which, new.astype(np.int64) + several[order]) > 1
    out = np.empty(len(seeds), np.uint8)
    out[order] = LATER * ~new + SHARED * shared[which]
    return out


def _is_later(keys: np.ndarray, columns: np.ndarray) -> np.ndarray:
    doc_id, uid, start = columns
    order = np.lexsort((start, uid, doc_id, keys))
    out = np.empty(len(keys), np.uint8)
    out[order] = LATER * np.append(False, keys[order][1:] == keys[order][:-1])
    return out


def _passes(blocks: DataFrame, depth: int) -> tuple[DataFrame, tuple[int, int]]:
    """The answers of all passes, and the numbers of ranges that they were asked in."""
    records = blocks.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    parts = (max(1, ceil(records / RANGE_KEYS)), max(1, ceil(2 * records / RANGE_KEYS)))
    small = blocks.drop("extras", "texts")
    answers = None
    steps = (
        ("ask_seeds", _is_repeated, 1, small),
        ("ask_stretches", _compared, 5, small),
        ("ask_windows", _is_later, 3, blocks.drop("extras")),
    )

    def asking(ask: str, phase: int):
        def of_block(block: pd.DataFrame, so_far: pd.DataFrame | None) -> pd.DataFrame:
            known = _Block(block.iloc[0], so_far, depth, parts)
            return questions(block["block"].iloc[0], *getattr(known, ask)(), parts[phase == 3])

        return of_block

    def of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                yield asking("ask_seeds", 1)(batch.iloc[i : i + 1], None)

    for phase, (ask, decide, columns, table) in enumerate(steps, 1):
        if answers is None:
            asked = table.mapInPandas(of_batches, QUESTIONS)
        else:
            asked = table.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(asking(ask, phase), QUESTIONS)
        said = written(asked.groupBy("part").applyInPandas(replies(phase, decide, columns), REPLIES), "replies")
        answers = said if answers is None else answers.unionByName(said)
    return answers, parts


def _texts(block: pd.Series) -> list[bytes]:
    data = unpacked(block["texts"], np.uint8).tobytes()
    ends = np.cumsum(unpacked(block["sizes"], np.int64))
    return [data[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def remove_repeats(
    docs: DataFrame,
    depth: int = DEPTH,
    with_text: bool = False,
    extras: tuple[str, ...] = (),
    block_bytes: int = BLOCK_BYTES,
    buckets: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left),
    spans (removed [start, end) one after the other), text (that is left, if asked for; characters
    that are cut go whole), and ``extras``, columns of the input, as the struct ``extra``."""
    small_batches(docs.sparkSession)
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _bucketed(text_blocks(docs, list(extras), depth, block_bytes), "texts", "block", buckets)
    answers, parts = _passes(blocks, depth)
    schema = StructType.fromDDL(
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, text string"
    )
    if extras:
        schema.add("extra", docs.select(whole_row(list(extras))).schema[0].dataType)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.string()]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pandas().iloc[0]
        texts, ids = _texts(row), unpacked(row["doc_ids"], np.int64).reshape(2, -1)
        number, starts, ends = _Block(row, right.to_pandas(), depth, parts).spans()
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(len(texts) + 1))
        starts, ends = starts[order], ends[order]
        out = []
        for i, text in enumerate(texts):
            mine = slice(bounds[i], bounds[i + 1])
            a, b = merged(starts[mine], ends[mine]) if mine.start < mine.stop else (number[:0], number[:0])
            edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
            kept = b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2]))
            digest, rest = hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None
            doc_id = int(ids[0, i]) if ids[1, i] else None
            out.append((doc_id, len(text), len(text) - len(kept), len(a), digest, edges[1:-1], rest))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)]
        if extras:
            with pa.ipc.open_stream(unpacked(row["extras"], np.uint8).tobytes()) as stream:
                extra = stream.read_all().column(0)
            columns.append(extra.cast(_in_utc(extra.type)))
        return pa.Table.from_arrays(columns, names=schema.names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


def unrepeated_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``docs`` with what is left of their texts; n_chars follows. Documents that lose
    everything go; those that were empty stay. Other columns are as they were."""
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, depth, with_text=True, extras=tuple(rest)).where("n_removed < n_bytes OR n_bytes = 0")
    of = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*((of[c] if c in of else F.col("extra").getField(c)).alias(c) for c in names))


def op4_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is left without bytes of earlier 100-byte windows."""
    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP4_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM docs)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
edges AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
    list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    list_zip(list_prepend(0, coalesce(ends, [])), list_append(coalesce(starts, []), length(h) // 2)) AS pieces
  FROM docs LEFT JOIN cuts USING (doc_id))
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, n_removed, n_spans,
  sha256(unhex(array_to_string(list_transform(pieces, lambda p: substr(h, 2 * p[1] + 1, 2 * (p[2] - p[1]))), ''))) AS kept_sha256
FROM kept
"""
