"""N-gram Jaccard join with an R-tree over count vectors.

A document's set is its distinct shingles. Hashing puts each shingle into one of a
fixed number of groups; the numbers of shingles per group are the document's point. Two
documents share at most the sum of the smaller coordinates, so a pair, or all points
below a node of an R-tree, is ruled out where that sum is too small.

Documents meet by shingles that any linked pair must share: of a set of n, the first
n - ceil(t * n) + 1 in an order that all documents agree on, in which shingles that are
frequent in a bounded sample come last (any order is exact; this one keeps passages
that many documents share from bringing them together). Equal sets are one class.

Then, over classes: (1) in every group of classes that share such a shingle each is
paired with the smallest; pairs that the points do not rule out are verified on whole
sets and links joined into components. (2) Groups that still hold several components
build an R-tree over their points, cut by set size, and look up each point. Of the pairs that
survive, a tree gives for any two components the few with the highest bounds; they are
verified in rounds, the best first: what links is contracted, pairs that now lie inside a
component are dropped, and more are verified in the next round, until no pair is left. Groups
that had more pairs to give, and still hold those components apart, are searched again and
give more. So one link joins a stray to a dense component, and its other pairs are
neither listed nor compared. Large groups are dealt into blocks, large components into blocks of their own, and each pair
of blocks that holds two components has a tree; so a tree's size is bounded. Pairs
inside a component need no look: a dense group of n copies costs n comparisons. No
links between different components are lost. Tables in between go as soon as nothing reads
them, and so do the shuffle files of what made them.

Null texts and texts without words have the empty set and link with nothing; with fewer
words than a shingle the whole sequence is the one element. Repeated rows belong to one
class; rows with equal ids and different texts keep rows of their own. Rows without id
do not count for the smallest id. Other columns are not looked at. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatescope.llm.common import WORD, discard, read_table, shuffles_removed, small_batches, whole_row, written
from estatescope.llm.components import connected_components
from estatescope.llm.repeats import BLOCK_KEYS, BLOCKS, block_row, repeated_entries

WORDS = 5
PERCENT = 75
GROUPS = 512  # coordinates of a point
FOLD = 8  # that the R-tree adds up; pairs that it finds are bounded by all coordinates
SAMPLE = 20_000  # documents that the order of shingles is fitted on
FREQUENT = 6  # documents of the sample
MOST = 500_000  # frequent shingles that the order knows, 8 bytes each
BANDED = 10_000  # members from which a group is cut by set size
BLOCK = 4096  # members of a block, about, into which larger groups are cut
BEST = 4  # pairs of any two components that a tree gives at first
FIRST_KEYS = 8  # of a member's groups, that tell where a pair is reported
LEAF = 32  # points of a leaf, and nodes of a node

NO_KEY = np.iinfo(np.int64).max
SETS = "doc_id long, body long, node long, n long, point binary"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``text``."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(total)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def node_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def frequent_shingles(docs: DataFrame, words: int, sample: int, least: int, most: int = MOST) -> np.ndarray:
    """Shingles of at least ``least`` of about ``sample`` documents, the ``most`` most frequent ones.

    Rows of equal id and text are one document.
    """
    with shuffles_removed(docs.sparkSession):
        every = max(1, docs.count() // sample)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"s": shingles(text, words, hashes).view(np.int64)})

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    some = some.select("doc_id", "text").dropDuplicates().select("text")
    counted = some.mapInPandas(listed, "s long").groupBy("s").count().where(F.col("count") >= least)
    counted = written(counted.orderBy(F.desc("count"), "s").limit(most), "frequent")
    found = np.sort(counted.select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64))
    discard(counted)
    return found


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def needed_overlap(a, b, percent: int):
    """Least size of the intersection of sets of ``a`` and ``b`` that are linked."""
    return -(-percent * (a + b) // (100 + percent))


class RTree:
    """Points with sizes, packed into leaves; a node holds the largest of each coordinate, and
    the smallest and largest size, label and side below it. Without sides all pairs count."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray | None = None) -> None:
        _, place, members = np.unique(labels, return_inverse=True, return_counts=True)
        self.sided = sides is not None
        sides = sides if self.sided else np.zeros(len(sizes), np.int64)
        # Each side by itself, the most frequent label too, all by size, then by the widest coordinate.
        order = np.lexsort((points[:, points.var(axis=0).argmax()], sizes, place == members.argmax(), sides))
        level = [points[order].astype(np.int32), *(x[order] for x in (sizes, sizes, labels, labels, sides, sides))]
        self.order, self.levels = order, [level]
        while len(level[0]) > LEAF:
            at = np.arange(0, len(level[0]), LEAF)
            fold = (np.maximum, *(np.minimum, np.maximum) * 3)
            level = [f.reduceat(x, at, axis=0) for f, x in zip(fold, level)]
            self.levels.append(level)

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes of pairs with different labels and sides that may be linked, each pair once."""
        top = len(self.levels[-1][0])
        yield from self._below(len(self.levels) - 1, *np.triu_indices(top), percent)

    def _below(self, depth: int, a: np.ndarray, b: np.ndarray, percent: int) -> Iterator[tuple]:
        high, small, large, low_label, high_label, low_side, high_side = self.levels[depth]
        fits = (large[a] * 100 >= percent * small[b]) & (large[b] * 100 >= percent * small[a])
        fits &= (low_label[a] != high_label[b]) | (low_label[b] != high_label[a])
        if self.sided:
            fits &= (low_side[a] != high_side[b]) | (low_side[b] != high_side[a])
        a, b = a[fits], b[fits]
        # Sizes below that can be linked at all bound the overlap that is needed.
        least = [np.maximum(small[x], -(-percent * small[y] // 100)) for x, y in ((a, b), (b, a))]
        fits = np.minimum(high[a], high[b]).sum(axis=1) >= needed_overlap(*least, percent)
        a, b = a[fits], b[fits]
        if depth == 0:
            if len(a):
                yield self.order[a], self.order[b]
            return
        count = len(self.levels[depth - 1][0])
        step = np.arange(LEAF)
        for at in range(0, len(a), 32):
            p = (a[at : at + 32, None, None] * LEAF + step[:, None]).repeat(LEAF, axis=2).ravel()
            q = (b[at : at + 32, None, None] * LEAF + step).repeat(LEAF, axis=1).ravel()
            real = (q < count) & (p <= q) if depth > 1 else (q < count) & (p < q)
            yield from self._below(depth - 1, p[real], q[real], percent)


def jaccard_components(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    groups: int = GROUPS,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and names of its text (body)
    and of its component (root, null for an empty set)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    late = frequent_shingles(rows, words, sample, frequent)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        hashes = _WordHashes()
        keys, nodes, held = [], [], 0
        for batch in batches:
            out = []
            for doc_id, known, body, text in zip(batch["doc_id"], batch["known"], batch["body"], batch["text"]):
                doc_id = int(doc_id) if known else None
                s = shingles(text, words, hashes)
                if not len(s):
                    out.append((doc_id, body, None, 0, None, None, None, None, None))
                    continue
                node = node_of(s)
                point = np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups)
                out.append((doc_id, body, node, len(s), _narrow(point), None, None, None, None))
                last = _in_sorted(s, late)
                first = np.concatenate([s[~last], s[last]])[: prefix_length(len(s), percent)]
                keys.append(first)
                nodes.append(np.full(len(first), node, np.int64))
                held += len(first)
                if held >= BLOCK_KEYS:
                    made += 1
                    out.append((None, None, None, None, None, *block_row(f"{task}-{made}", np.concatenate(keys), np.concatenate(nodes)[None, :])))
                    keys, nodes, held = [], [], 0
            yield _frame(out)
        if held:
            yield _frame([(None, None, None, None, None, *block_row(f"{task}-last", np.concatenate(keys), np.concatenate(nodes)[None, :]))])

    def _frame(out: list[tuple]) -> pd.DataFrame:
        names = ["doc_id", "body", "node", "n", "point", "block", "n_keys", "keys", "payload"]
        columns = dict(zip(names, zip(*out))) if out else {c: () for c in names}
        # Declared as integers at once: a column with nulls would pass through doubles.
        long = ("doc_id", "body", "node", "n", "n_keys")
        return pd.DataFrame({c: pd.array(x, "Int64") if c in long else pd.Series(x, dtype=object) for c, x in columns.items()})

    # Long ids stay exact only in columns without nulls.
    told = rows.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNotNull().alias("known"),
        F.xxhash64("text").alias("body"),
        "text",
    )
    both = written(told.mapInPandas(measured, f"{SETS}, {BLOCKS}"), "shingle-sets")
    sets = both.where("block IS NULL").select("doc_id", "body", "node", "n", "point")
    classes = sets.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("point").alias("point")
    )
    entries = repeated_entries(both.where("block IS NOT NULL").select(*(c.split(" ")[0] for c in BLOCKS.split(", "))), ["node"])
    members = _members(entries)
    discard(entries)
    points = classes.select("node", "n", "point")
    firsts = members.groupBy("key").agg(F.min("node").alias("a"))
    stars = members.join(firsts, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = verified(_not_ruled_out(stars, points, percent, groups), rows, sets, words, percent)
    roots = connected_components(links)
    best, before, open_keys = BEST, None, None  # before: what the search before found
    while True:
        # Groups with members of different components are looked at as a whole.
        known = members if open_keys is None else members.join(open_keys, "key", "left_semi")
        known = known.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn(
            "root", F.coalesce("component_id", "node")
        )
        mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        mixed = written(known.join(mixed, "key").select("key", "node", "root"), "mixed-groups")
        found = _tree_pairs(mixed, points, percent, groups, best=best)
        discard(mixed, roots)
        fresh = found.where("NOT more").drop("key", "more").distinct()
        if before is not None:
            # All that a search before gave has been settled.
            fresh = fresh.join(before.where("NOT more").select("a", "b"), ["a", "b"], "left_anti")
        links = links.unionByName(_in_rounds(fresh, rows, sets, words, percent))
        roots = connected_components(links)
        if before is not None:
            discard(before)
        with shuffles_removed(docs.sparkSession):
            open_keys = found.where("more").select("key").distinct()
            last = open_keys.isEmpty()
        if last:
            discard(found, links, members)
            break
        before, best = found, best * 16
    rooted = classes.select("node", "least").join(roots.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "least", F.coalesce("component_id", "node").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select(F.col("node").alias("of_node"), "component_id", "root")
    return sets.join(named, F.col("node") == F.col("of_node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "body",
        "root",
    )


def _members(entries: DataFrame) -> DataFrame:
    """(key, node) of groups of two or more; of groups with equal members, one."""
    distinct = entries.select("key", "node").distinct()
    groups = distinct.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("mark"), F.min("node").alias("least")
    )
    kept = groups.where("n > 1").groupBy("n", "mark", "least").agg(F.min("key").alias("key"))
    return written(distinct.join(kept.select("key"), "key"), "members")


def _narrow(point: np.ndarray) -> bytes:
    """A point as little-endian bytes, as narrow as its largest coordinate allows."""
    most = point.max()
    return point.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _point(data: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // groups}").astype(np.int64)


def _not_ruled_out(pairs: DataFrame, points: DataFrame, percent: int, groups: int) -> DataFrame:
    """Pairs (a, b) whose points allow enough common shingles."""
    of = lambda c: points.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("point").alias(f"p_{c}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b")
    sized = sized.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))

    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            bound = [np.minimum(_point(p, groups), _point(q, groups)).sum() for p, q in zip(f["p_a"], f["p_b"])]
            yield f.loc[np.array(bound, np.int64) >= needed_overlap(f["n_a"], f["n_b"], percent), ["a", "b"]]

    return sized.mapInPandas(allowed, "a long, b long")


def whole_sets(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of all classes in ``pairs``, as a written table."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    # One document of each class gives its set.
    chosen = sets.join(wanted, "node", "left_semi").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")).alias("m")
    )
    chosen = chosen.select(F.col("node").alias("of_node"), "m.doc_id", "m.body")
    texts = docs.withColumn("of_body", F.xxhash64("text")).join(
        chosen.withColumnRenamed("doc_id", "of_doc"),
        F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("of_body") == F.col("body")),
    )

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            found = [shingles(text, words, hashes).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"node": batch["of_node"], "shingles": found})

    found = texts.select("of_node", "text").mapInPandas(full, "node long, shingles binary")
    return written(found.dropDuplicates(["node"]), "whole-sets")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that are linked, by their whole sets; a written table."""
    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    whole = whole_sets(pairs, docs, sets, words)
    good = _compared(pairs, whole, percent)
    discard(pairs, whole)
    return good


def _compared(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are linked; a written table."""
    of = lambda c: whole.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}"))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            good = np.zeros(len(f), bool)
            for i, (p, q) in enumerate(zip(f["s_a"], f["s_b"])):
                s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield f.loc[good, ["a", "b"]]

    pairs = pairs.select("a", "b")
    return written(pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(linked, "a long, b long"), "links")


def _in_rounds(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among ``pairs`` (a, b, score, root_a, root_b) that, with those that make the
    roots, connect all that the linked ones of ``pairs`` connect.

    In a round, one pair of any two components is verified, the one with the highest score;
    then four, and so on.
    """
    links = pairs.sparkSession.createDataFrame([], "a long, b long")
    left = written(pairs, "pairs")
    if left.isEmpty():
        discard(left)
        return links
    whole, most = whole_sets(left, docs, sets, words), 1
    while not left.isEmpty():
        two = [F.least("root_a", "root_b"), F.greatest("root_a", "root_b")]
        nth = F.row_number().over(Window.partitionBy(*two).orderBy(F.desc("score"), "a", "b"))
        tried = written(left.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), "tried")
        # Later rounds look at few of the sets; only these are moved.
        nodes = tried.select(F.col("a").alias("node")).union(tried.select(F.col("b").alias("node"))).distinct()
        good = _compared(tried, whole.join(nodes, "node", "left_semi"), percent)
        links = links.unionByName(good)
        joined = tried.join(good, ["a", "b"], "left_semi").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        roots = connected_components(joined)
        former, left = left, left.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        for side in ("root_a", "root_b"):
            of = roots.select(F.col("id").alias(side), F.col("component_id").alias("new"))
            left = left.join(of, side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        left, most = written(left.where("root_a <> root_b"), "pairs"), most * 4
        discard(former, tried, roots)
    discard(left, whole)
    return links


def _in_blocks(placed: DataFrame, block: int) -> DataFrame:
    """Members of groups (key, band) as often as they meet a block of their group, with the two
    blocks that meet, lo and hi, and their own, side.

    A component with more than ``block`` members of a group is dealt into blocks of its own,
    the others together into further ones. Blocks of one component do not meet.
    """
    group = ["key", "band"]
    sizes = placed.groupBy(*group, "root").agg(F.count("*").alias("r"))
    alone = F.col("r") > block
    others = F.sum(F.when(alone, 0).otherwise(F.col("r"))).over(Window.partitionBy(*group))
    sizes = sizes.withColumn("blocks", F.ceil(F.when(alone, F.col("r")).otherwise(others) / block)).select(
        F.col("key").alias("of_key"), F.col("band").alias("of_band"), F.col("root").alias("of_root"), "blocks", alone.alias("alone")
    )
    # A name is a hash; two blocks of one name would be one block, which loses no pair.
    dealt = F.when(F.col("alone"), F.xxhash64("root", F.pmod(F.xxhash64("node"), "blocks"))).otherwise(
        F.xxhash64(F.pmod(F.xxhash64("root"), "blocks"))
    )
    same = (F.col("key") == F.col("of_key")) & (F.col("band") == F.col("of_band")) & (F.col("root") == F.col("of_root"))
    sided = placed.join(sizes, same).withColumn("side", dealt).drop("of_key", "of_band", "of_root", "blocks", "alone")
    sided = written(sided, "blocks")
    blocks = sided.groupBy(*group, "side").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    of = lambda c: blocks.select(*group, F.col("side").alias(c), F.col("least").alias(f"least_{c}"), F.col("most").alias(f"most_{c}"))
    meet = of("lo").join(of("hi"), group).where(
        (F.col("lo") <= F.col("hi")) & (F.least("least_lo", "least_hi") != F.greatest("most_lo", "most_hi"))
    )
    meet = meet.withColumn("side", F.explode(F.array_distinct(F.array("lo", "hi")))).select(*group, "side", "lo", "hi")
    return sided.join(meet, [*group, "side"])


def _tree_groups(members: DataFrame, sizes: DataFrame, percent: int, block: int) -> DataFrame:
    """Members of the groups of which each has a tree, told by key, band, lo and hi; a written table."""
    # Sizes of linked sets differ by a ratio at most, so each is put into its band and the next.
    step = -np.log(percent / 100)
    band = F.floor(F.log(F.col("n").cast("double")) / step - 1e-9)
    large = members.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > min(block, BANDED))
    cut = F.coalesce(F.col("m") > BANDED, F.lit(False))
    placed = (
        members.join(large, "key", "left")
        .join(sizes, "node")
        .withColumn("own", F.when(cut, band).otherwise(0))
        .withColumn("band", F.explode(F.when(cut, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))))
        .withColumn("big", F.coalesce(F.col("m") > block, F.lit(False)))
        .select("key", "node", "root", "own", "band", "big")
    )
    whole = placed.where("NOT big")
    for c in ("side", "lo", "hi"):
        whole = whole.withColumn(c, F.lit(0).cast("long"))
    blocks = _in_blocks(placed.where("big"), block)
    trees = written(whole.unionByName(blocks).drop("big"), "tree-groups")
    discard(blocks)
    return trees


def _tree_pairs(
    members: DataFrame, points: DataFrame, percent: int, groups: int, block: int | None = None, best: int | None = None
) -> DataFrame:
    """Pairs (a, b) of one group and different components (root_a, root_b) that the group's R-tree
    does not rule out, with the Jaccard similarity that their points allow, score; a written table.

    Of the pairs of two components a tree gives the ``best`` with the highest scores, or all. A row
    with ``more`` has only the key of a group that had more.
    """
    # A pair meets in every group that it shares. It is reported in the one with the smallest
    # key, as far as the first few of each member's keys tell; these hold the smallest
    # shared key if they share any.
    keys = F.slice(F.sort_array(F.collect_list("key")), 1, FIRST_KEYS)
    first_keys = members.groupBy("node").agg(keys.alias("keys"))
    trees = _tree_groups(members, points.select("node", "n"), percent, block or BLOCK)
    placed = trees.join(points.join(first_keys, "node"), "node")

    def searched(frame: pd.DataFrame) -> pd.DataFrame:
        unit = ["key", "band", "lo", "hi"]
        frame = frame.sort_values(unit, ignore_index=True)
        own = (frame["own"] == frame["band"]).to_numpy()
        points = np.stack([_point(p, groups) for p in frame["point"]]).astype(np.int32)
        sizes, nodes, roots, sides = (frame[c].to_numpy(np.int64) for c in ("n", "node", "root", "side"))
        alone = (frame["lo"] == frame["hi"]).to_numpy()
        at = frame[unit].to_numpy(np.int64)
        starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1)))
        counts = np.diff(np.append(starts, len(frame)))
        here = frame["key"].to_numpy(np.int64)
        keys = np.full((len(frame), FIRST_KEYS), NO_KEY)
        for i, mine in enumerate(frame["keys"]):
            keys[i, : len(mine)] = mine
        kind = np.dtype([("i", np.int64), ("j", np.int64), ("score", np.float64)])
        got: list[np.ndarray] = []
        opened: list[np.ndarray] = []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            fits = (own[i] | own[j]) & (roots[i] != roots[j]) & (alone[i] | (sides[i] != sides[j]))
            fits &= (sizes[i] * 100 >= percent * sizes[j]) & (sizes[j] * 100 >= percent * sizes[i])
            i, j = i[fits], j[fits]
            for at in range(0, len(i), 4096):
                p, q = i[at : at + 4096], j[at : at + 4096]
                bound = np.minimum(points[p], points[q]).sum(axis=1)
                fits = bound >= needed_overlap(sizes[p], sizes[q], percent)
                p, q, bound = p[fits], q[fits], bound[fits]
                shared = (keys[p][:, :, None] == keys[q][:, None, :]).any(axis=2)
                least = np.where(shared, keys[p], NO_KEY).min(axis=1)
                fits = (least == here[p]) | (least == NO_KEY)
                score = (bound / (sizes[p] + sizes[q] - bound))[fits]
                found = np.empty(len(score), kind)
                found["i"], found["j"], found["score"] = p[fits], q[fits], score
                got.append(found)

        def chosen(first: int) -> None:
            """Of the pairs since ``first``, the best of any two components in each unit."""
            if best is None or len(got) == first:
                return
            some = np.concatenate(got[first:])
            i, j = some["i"], some["j"]
            unit = np.searchsorted(starts, i, side="right")
            low, high = np.minimum(roots[i], roots[j]), np.maximum(roots[i], roots[j])
            order = np.lexsort((nodes[j], nodes[i], -some["score"], high, low, unit))
            some, two = some[order], np.stack([unit, low, high])[:, order]
            new = np.append(True, (two[:, 1:] != two[:, :-1]).any(axis=0))[: len(some)]
            at = np.arange(len(some))
            nth = at - np.maximum.accumulate(np.where(new, at, 0))
            opened.append(here[some["i"][nth >= best]])
            got[first:] = [some[nth < best]]

        # A group that fits a leaf is a tree of one leaf; many of them are gone through at once.
        for m in np.unique(counts[counts <= LEAF]):
            i, j = np.triu_indices(m, 1)
            for some in np.array_split(starts[counts == m], max(1, (counts == m).sum() * len(i) // 1_000_000)):
                first = len(got)
                keep((some[:, None] + i).ravel(), (some[:, None] + j).ravel())
                chosen(first)
        fold = FOLD if groups % FOLD == 0 else 1
        for start, m in zip(starts[counts > LEAF], counts[counts > LEAF]):
            mine = slice(start, start + m)
            tree = RTree(
                points[mine].reshape(m, -1, fold).sum(axis=2), sizes[mine], roots[mine], None if alone[start] else sides[mine]
            )
            first = len(got)
            for i, j in tree.pairs(percent):
                keep(i + start, j + start)
                if len(got) - first > 1000:
                    chosen(first)
            chosen(first)
        pairs = np.concatenate([np.empty(0, kind), *got])
        i, j = pairs["i"], pairs["j"]
        i, j = np.where(nodes[i] < nodes[j], i, j), np.where(nodes[i] < nodes[j], j, i)
        keys = np.unique(np.concatenate([np.empty(0, np.int64), *opened]))
        # A row is a pair or the key of a group that had more; ids stay exact only without nulls.
        told = {"a": nodes[i], "b": nodes[j], "root_a": roots[i], "root_b": roots[j], "key": np.zeros(len(i), np.int64)}
        frame = pd.DataFrame({c: np.append(x, keys if c == "key" else np.zeros(len(keys), np.int64)) for c, x in told.items()})
        return frame.assign(score=np.append(pairs["score"], np.zeros(len(keys))), more=np.arange(len(frame)) >= len(i))

    # A task takes several groups or pairs of blocks, each whole.
    with shuffles_removed(trees.sparkSession):
        parts = max(1, trees.count() // 20_000)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("key", "band", "lo", "hi"), F.lit(parts)))
    pairs = placed.groupBy("part").applyInPandas(
        searched, "a long, b long, root_a long, root_b long, key long, score double, more boolean"
    )
    pairs = written(pairs, "tree-pairs")
    discard(trees)
    return pairs


def distinct_documents(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest id, all columns kept.

    Rows without words are kept. Of rows that are equal in id and text one stays.
    """
    found = jaccard_components(docs, **settings).where("root IS NOT NULL")
    # Nulls count as largest here.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body"))
    chosen = found.groupBy("root").agg(first.alias("at")).select(
        F.col("at.doc_id").alias("of_doc"), F.col("at.body").alias("of_body")
    )
    names = docs.columns
    rows = docs.select(whole_row(names).alias("row"), "doc_id", F.xxhash64("text").alias("body"), "text")
    kept = rows.where(F.col("text").rlike(WORD)).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("body") == F.col("of_body"))
    )
    nth = F.row_number().over(Window.partitionBy("of_doc", "of_body").orderBy(F.xxhash64(F.col("row").cast("string"))))
    kept = kept.withColumn("nth", nth).where("nth = 1").select("row.*")
    return kept.unionByName(docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_components(read_table(spark, sf_dir, "documents")).drop("body", "root")
