import numpy as np
import pytest
from llm_cases import DOCUMENTS, documents, in_duck, rows_of, TABLES

from estatescope.llm.mixing import OP3_SQL, mix_sources, mixed_documents, op3_mix_sources
from estatescope.llm.sharding import op1_shard_rows, permute, shard_rows, unpermute


@pytest.mark.parametrize("count", [1, 2, 3, 40, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(count):
    places = permute(np.arange(count), count, seed=3)
    assert sorted(places) == list(range(count))
    assert (unpermute(places, count, seed=3) == np.arange(count)).all()
    if count > 100:
        assert (permute(np.arange(count), count, seed=4) != places).any()


def check_shards(rows, shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_of_awkward_rows(spark):
    rows = shard_rows(documents(spark), shards=3).collect()
    assert len(rows) == len(DOCUMENTS)
    check_shards(rows, 3)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 6} == {(16, 0)}
    places = {r["row_number"] for r in rows}
    assert places == set(range(len(rows)))
    assert shard_rows(documents(spark, [])).count() == 0


def test_a_row_repeated_very_often_is_listed_in_runs(spark, monkeypatch):
    monkeypatch.setattr("estatescope.llm.sharding.RUN", 7)
    rows = shard_rows(documents(spark, [(1, "same", "en", "a")] * 50 + [(2, "x", "en", "a")]), shards=4).collect()
    assert len(rows) == 51
    check_shards(rows, 4)


def test_all_documents_are_sharded(spark):
    rows = op1_shard_rows(spark, TABLES).collect()
    check_shards(rows, 40)
    assert len(rows) == 200
    again = op1_shard_rows(spark, TABLES)
    assert rows_of(again, again.columns) == sorted(repr(tuple(r)) for r in rows)


def test_mix_equals_sql(spark):
    names, want = in_duck(OP3_SQL)
    assert rows_of(op3_mix_sources(spark, TABLES), names) == want


def test_mix_of_awkward_rows(spark):
    mixed = mix_sources(documents(spark)).collect()
    assert len(mixed) == len(DOCUMENTS)
    total = sum(r["size"] for r in mixed)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in mixed}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-9 for t, s in targets.values())
    assert all(0 <= r["copies"] <= 2 for r in mixed)
    taken = sum(r["copies"] * r["size"] for r in mixed)
    assert 0 <= 1.5 * total - taken <= max(r["size"] for r in mixed)
    assert mix_sources(documents(spark, [])).count() == 0


def test_mixed_rows_keep_their_columns(spark):
    docs = documents(spark)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = sum(r["copies"] for r in mix_sources(docs).collect())
    assert mixed.count() == want
    assert mixed.exceptAll(docs.unionByName(docs)).count() == 0
    assert mixed_documents(documents(spark, [])).count() == 0


def test_one_source_that_holds_most(spark):
    rows = [(i, "w " * (i % 9 + 1), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(300)]
    mixed = mix_sources(documents(spark, rows)).collect()
    for source in {r["source"] for r in mixed}:
        mine = [r for r in mixed if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 10
