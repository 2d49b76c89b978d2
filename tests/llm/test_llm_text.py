import hashlib
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_cases import (
    DOCUMENTS, LONG, PROSE, TABLES, bigram_scores, documents, in_duck, jaccard, rows_of, without_repeats,
)

from estatescope.llm import jaccard_join, lm_scoring, packing, repeated_windows
from estatescope.llm.common import shared_folder
from estatescope.llm.components import connected_components


def table(name="documents"):
    return pq.read_table(f"{TABLES}/{name}.parquet").to_pydict()


# Language-model scores


def test_scores_equal_brute_force(spark, monkeypatch):
    learned = {}
    fit = lm_scoring.learned_weights

    def spied(*a):
        learned["w"] = fit(*a)
        return learned["w"]

    monkeypatch.setattr(lm_scoring, "learned_weights", spied)
    docs = table()
    df = spark.read.parquet(f"{TABLES}/documents.parquet")
    # Small blocks and ranges, so that there are many of both.
    got = lm_scoring.score_documents(df, block_tokens=5000, range_keys=4000).collect()
    want = bigram_scores(zip(docs["doc_id"], docs["text"]), learned["w"], lm_scoring.CLASSES)
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_weights_are_found_again_from_drawn_counts():
    rng = np.random.default_rng(1)
    uni, bi = rng.choice([-32, 0, 24, 40], 4000), rng.choice([0, 1, 64, 96], 4000)
    cells = (5 * lm_scoring.SPAN + uni + lm_scoring.SPAN // 2) * lm_scoring.SPAN + np.where(bi, bi + lm_scoring.SPAN // 2, 0)
    w = lm_scoring.learned_weights(cells, np.ones(len(cells)))
    parts = np.stack([np.ones(4000), 2.0 ** (uni / 8), np.where(bi, 2.0 ** (bi / 8), 0)])
    likely = lambda x: np.log(x @ parts).sum()
    assert w[5].sum() == pytest.approx(1)
    assert all(likely(w[5]) >= likely(np.array(o)) - 1e-3 for o in ([1 / 3] * 3, [0.2, 0.1, 0.7], [0.1, 0.1, 0.8]))
    assert w[0, 2] == 0 and (w[6] == w[5]).all()


def test_scores_of_awkward_rows(spark):
    got = lm_scoring.score_documents(documents(spark)).collect()
    assert len(got) == len(DOCUMENTS)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (5, 6, 7)} == {1}
    assert sum(r["doc_id"] is None for r in got) == 2
    assert all(np.isfinite(r["score"]) for r in got)
    assert lm_scoring.score_documents(documents(spark, [])).count() == 0


# Jaccard join


def check_components(spark, rows, **settings):
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, **settings).collect()}
    assert got == dict(enumerate(jaccard(rows)))


def test_components_equal_brute_force(spark):
    check_components(spark, table()["text"])


def test_components_of_edited_copies_and_shared_passages(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(int(rng.integers(30, 200)))]
        for _ in range(12):
            edited = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 9))):
                edited[at] = f"e{rng.integers(10**6)}"
            rows.append(" ".join(edited[int(rng.integers(0, 12)) :]) + (f" {passage}" if rng.random() < 0.5 else ""))
    check_components(spark, [*rows, "", None, "a b", "A  b", "a b c"], sample=40, frequent=4)


def test_components_of_awkward_rows(spark):
    got = jaccard_join.jaccard_components(documents(spark)).collect()
    assert len(got) == len(DOCUMENTS)
    of = lambda i: {r["component_id"] for r in got if r["doc_id"] == i}
    assert of(2) == {1} and of(3) == {1} and of(9) == {8} and of(5) == {5} and of(6) == {6}
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {1, None}
    assert jaccard_join.jaccard_components(documents(spark, [])).count() == 0


def test_one_document_of_each_component_stays(spark):
    docs = documents(spark)
    kept = jaccard_join.distinct_documents(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 4, 5, 6, 7, 8, 10, 11, 11, None, 2**62 + 1]))


def test_trees_of_large_groups_are_bounded_and_lose_no_pair(spark, monkeypatch):
    """Groups of near copies in one component with strays, and of several components."""
    rng, groups = np.random.default_rng(5), 16
    rows, points = [], []
    for key, roots in enumerate([[1] * 400 + [2], [3] * 90 + [4] * 70 + list(range(10, 60)), [5] * 300, [6] * 9 + [7]]):
        base = rng.integers(3, 9, groups)
        for root in roots:
            node = len(points)
            rows.append((key, node, root))
            point = base + rng.integers(0, 3, groups)
            points.append((node, int(point.sum()), jaccard_join._narrow(point)))
    rows.append((2, 0, 1))  # a node of two groups
    members = spark.createDataFrame(rows, "key long, node long, root long")
    sets = spark.createDataFrame(points, "node long, n long, point binary")
    trees = jaccard_join._tree_groups(members, sets.select("node", "n"), 75, 32).toPandas()
    assert trees.groupby(["key", "band", "lo", "hi"]).size().max() <= 160
    assert len(trees[trees.key == 0]) <= 401 + 14  # the component's blocks meet the stray's only
    at = {node: jaccard_join._point(p, groups) for node, _, p in points}
    want = set()
    for key in range(4):
        mine = [(node, root) for k, node, root in rows if k == key]
        for x, (a, p) in enumerate(mine):
            for b, q in mine[:x]:
                n, m = at[a].sum(), at[b].sum()
                if p != q and 4 * min(n, m) >= 3 * max(n, m) and np.minimum(at[a], at[b]).sum() >= jaccard_join.needed_overlap(n, m, 75):
                    want.add((min(a, b), max(a, b)))
    for banded in (10_000, 100):
        monkeypatch.setattr(jaccard_join, "BANDED", banded)
        got = [tuple(r)[:2] for r in jaccard_join._tree_pairs(members, sets, 75, groups, block=32).distinct().collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_sample_is_bounded_for_a_repeated_id(spark):
    hit = next(i for i in range(1000) if spark.range(i, i + 1).selectExpr("pmod(xxhash64(id), 10) = 0").first()[0])
    rows = [(hit, f"a b c d e {i} f g h i{i}") for i in range(400)] + [(hit, "x y z w v")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = lambda *how: jaccard_join.frequent_shingles(docs, 5, *how)
    assert not len(frequent(80, 300))  # all 800 rows were sampled by their id
    every = frequent(800, 1)
    counts = {s: 400 for s in jaccard_join.shingles("a b c d e", 5, jaccard_join._WordHashes())}
    assert len(every) > 401 and frequent(800, 1, 1).tolist() == list(counts)


def test_tree_rules_out_no_linked_pair():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (500, 16))
    points[250:] = np.maximum(points[:250] + rng.integers(-1, 2, (250, 16)), 0)
    sizes = points.sum(axis=1)
    labels = rng.integers(0, 40, 500)
    labels[:200] = 7
    found = [(int(i), int(j)) for a, b in jaccard_join.RTree(points, sizes, labels).pairs(75) for i, j in zip(a, b)]
    want = set()
    for i in range(500):
        need = jaccard_join.needed_overlap(sizes, sizes[i], 75)
        fits = (np.minimum(points, points[i]).sum(axis=1) >= need) & (sizes * 100 >= 75 * sizes[i]) & (sizes * 75 <= 100 * sizes[i])
        want |= {(i, int(j)) for j in np.flatnonzero(fits & (labels != labels[i])) if i < j}
    assert len(want) > 50 and sorted(tuple(sorted(p)) for p in found) == sorted(want)


def near_copies(n, most):
    """Copies of a text with up to ``most`` of its 400 words changed."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(n):
        text = list(base)
        for at in rng.integers(0, 400, int(rng.integers(0, most + 1))):
            text[at] = f"e{rng.integers(10**9)}"
        rows.append(" ".join(text))
    return rows


def test_pairs_of_trees_grow_with_a_group_in_proportion(spark, monkeypatch):
    plain, listed = jaccard_join._tree_pairs, []

    def noted(*args, **how):
        pairs = plain(*args, **how)
        listed.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard_join, "_tree_pairs", noted)
    totals = []
    for n in (150, 600):
        listed.clear()
        # A dense component and strays that resemble all of it.
        check_components(spark, near_copies(n, 4) + near_copies(20, 40))
        totals.append(sum(listed))
    assert 0 < totals[1] <= 4 * totals[0] + 100


def test_groups_with_more_pairs_are_searched_again(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BEST", 1)
    plain, searches = jaccard_join._tree_pairs, []

    def noted(*args, **how):
        searches.append(how["best"])
        return plain(*args, **how)

    monkeypatch.setattr(jaccard_join, "_tree_pairs", noted)
    check_components(spark, near_copies(200, 40))  # many lie just at the limit
    assert len(searches) > 1


@pytest.mark.parametrize("seed", range(3))
def test_rounds_connect_what_all_links_do(spark, monkeypatch, seed):
    """Random links among random pairs, with a component that most pairs touch."""
    rng = np.random.default_rng(seed)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (500, 2)) if a != b}
    good = {p for p in pairs if rng.random() < 0.15}
    first = [(i, 0) for i in range(25)] + [(i, 30) for i in range(30, 35)]
    root = dict(first)
    rows = [(a, b, float(rng.random())) for a, b in pairs if root.get(a, a) != root.get(b, b)]
    monkeypatch.setattr(jaccard_join, "whole_sets", lambda *_: spark.range(60).withColumnRenamed("id", "node"))
    tried = []

    def compared(some, _, __):
        found = [tuple(r) for r in some.select("a", "b").collect()]
        tried.extend(found)
        return spark.createDataFrame([p for p in found if p in good], "a long, b long")

    monkeypatch.setattr(jaccard_join, "_compared", compared)
    rows = [(*r, root.get(r[0], r[0]), root.get(r[1], r[1])) for r in rows]
    table = spark.createDataFrame(rows, "a long, b long, score double, root_a long, root_b long")
    links = jaccard_join._in_rounds(table, None, None, 5, 75)
    known = spark.createDataFrame(first, "a long, b long")
    every = known.unionByName(spark.createDataFrame([p for p in good if root.get(p[0], p[0]) != root.get(p[1], p[1])], "a long, b long"))
    of = lambda df: {tuple(r) for r in connected_components(df).collect()}
    assert of(known.unionByName(links)) == of(every)
    assert len(tried) == len(set(tried)) < len(rows)


def test_tables_in_between_go(spark):
    """F of round 3 (disk): what nothing reads any more is removed, files of shuffles too."""
    folder = Path(shared_folder(spark, "x").removeprefix("file:")).parent
    held = lambda: {p.name for p in folder.iterdir()} if folder.exists() else set()
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = disk.getAllBlocks()
        return {name for i in range(blocks.length()) if (name := blocks.apply(i).name()).startswith("shuffle_")}

    before, files = held(), shuffles()
    docs = spark.createDataFrame(list(enumerate(near_copies(60, 40))), "doc_id long, text string")
    found = jaccard_join.jaccard_components(docs)
    until = time.time() + 20
    while len(left := shuffles() - files) > 20 and time.time() < until:
        time.sleep(0.2)  # they go in the background
    kinds = Counter(name.rpartition("-")[0] for name in held() - before)
    assert kinds == {"shingle-sets": 1, "links": 1}
    assert len(left) <= 20
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert found.count() == 60 and found.count() == 60


def test_components_of_a_long_chain(spark):
    rng = np.random.default_rng(3)
    order = rng.permutation(300)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])], "a long, b long")
    assert {tuple(r) for r in connected_components(links).collect()} == {(i, 0) for i in range(300)}
    assert connected_components(links.where("a < 0")).count() == 0


# Repeated windows


def test_windows_equal_sql(spark):
    names, want = in_duck(repeated_windows.OP4_SQL)
    assert rows_of(repeated_windows.op4_repeated_windows(spark, TABLES), names) == want


@pytest.mark.parametrize("piece", [1 << 20, 256])
def test_windows_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(repeated_windows, "PIECE", piece)
    rng = np.random.default_rng(4)
    passages = ["".join(rng.choice(list("abcdefgh "), 180)) for _ in range(4)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 400))))
        for _ in range(int(rng.integers(0, 4))):
            p, at = passages[rng.integers(4)], int(rng.integers(0, 100))
            text += p[at : at + int(rng.integers(60, 180))]
        rows.append(text)
    rows += ["ab" * 150, "ba" * 150, "c" * 250, "é" * 120, "é" * 120, "", rows[0], LONG]
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    got = repeated_windows.remove_repeats(df, block_bytes=2000).collect()
    want = without_repeats([t.encode() for t in rows])
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {
        i: (n, s, hashlib.sha256(left).hexdigest()) for i, (n, s, left) in enumerate(want)
    }


def test_windows_of_awkward_rows(spark):
    docs = documents(spark)
    got = repeated_windows.remove_repeats(docs).collect()
    assert len(got) == len(DOCUMENTS)
    assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [0]
    assert [r["n_removed"] for r in got if r["doc_id"] == 2] == [len(PROSE)] * 2
    assert [r["n_bytes"] for r in got if r["doc_id"] == 6] == [0]
    kept = repeated_windows.unrepeated_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sum(r["doc_id"] == 2 for r in rows) == 0 and sum(r["doc_id"] in (5, 6, 7) for r in rows) == 3
    assert all(r["n_chars"] == len(r["text"]) and r["size"] == "x" for r in rows)
    assert repeated_windows.remove_repeats(documents(spark, [])).count() == 0


# Packing


def check_packing(rows, sequence):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    return len(places)


def test_ids_are_those_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = packing.special_tokens()
    assert special == {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()} and special
    encode = packing.encoder(special=special)
    odd = ["  x \n\n\t y", "it's we'LL 12 ½ ¼³ é ẞ 中文 ​ 　 🤦🏽", "\x00\x1c\x85", "a" * 500, "<|endof", "<|ENDOFTEXT|>"]
    for mark in special:
        odd += [mark, f"a{mark}b", f"a {mark} b", f"{mark}{mark}\n", f"{mark} x", f" {mark}", f"<|{mark}|>", f"é{mark}'s"]
    for text in [*table()["text"], *odd]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    ordinary = packing.encoder()
    tokenizer.encode_special_tokens = True
    for text in odd:
        assert ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_ids_have_the_special_token(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in packing.token_pieces(docs, with_ids=True).collect()]
    assert ids == [[64, 50256, 65, 0]]


def test_pieces_of_awkward_rows(spark):
    encode = packing.encoder(special=packing.special_tokens())
    pieces = packing.token_pieces(documents(spark), sequence=64, with_ids=True)
    rows = pieces.collect()
    by_doc = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    parts = sorted(by_doc[4], key=lambda r: r["piece"])
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts])
    assert ids.tolist() == [*encode(LONG), 0]
    assert {r["length"] for r in parts[1:]} == {64}
    assert all([r["length"] for r in by_doc[i]] == [1] for i in (5, 6))
    packed = packing.pack(pieces.drop("ids"), 64).collect()
    assert len(packed) == len(rows) and sum(r["doc_id"] is None for r in packed) == len(by_doc[None])
    check_packing(packed, 64)
    assert packing.pack(packing.token_pieces(documents(spark, []))).count() == 0


def test_packing_is_close_to_the_least(spark):
    rows = packing.op10_packing(spark, TABLES).collect()
    least = -(-sum(r["length"] for r in rows) // packing.SEQUENCE)
    assert check_packing(rows, packing.SEQUENCE) <= 1.05 * least + 1
    assert len({r["doc_id"] for r in rows}) == 200


@pytest.mark.parametrize("lengths", [[], [2048], [1] * 5000, [1024] * 9, [700, 1348] * 50])
def test_sum_of_squares(lengths):
    lengths = np.array(lengths, np.int64)
    numbers, offsets = packing.sum_of_squares(lengths)
    rows = [dict(sequence_id=n, offset=o, length=s) for n, o, s in zip(numbers, offsets, lengths)]
    assert check_packing(rows, 2048) == -(-lengths.sum() // 2048)
