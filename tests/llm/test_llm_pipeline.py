from llm_cases import DOCUMENTS, TABLES, documents, duck, jaccard, without_repeats

import corpus_pipeline
from estatescope.llm import packing
from estatescope.llm.common import read_table
from estatescope.llm.jaccard_join import distinct_documents
from estatescope.llm.mixing import OP3_SQL, mixed_documents
from estatescope.llm.quality import OP7_SQL, quality_documents
from estatescope.llm.repeated_windows import unrepeated_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark):
    """Each stage on its predecessor's rows: SQL, all pairs, all windows, SQL, the packing law."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == [
        "quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "best-fit packing",
    ]
    docs, frames = read_table(spark, TABLES, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        frames.append(docs.toPandas())
        docs = corpus_pipeline.written(stage(spark, docs, TABLES), "test")
        if name != names[-1]:
            assert docs.columns == COLUMNS
    frames.append(docs.toPandas())
    start, good, single, cut, mixed, packed = frames

    judged = duck(documents=start).execute(OP7_SQL).df()
    assert set(good.doc_id) == set(judged.doc_id[judged.kept])

    good = good.sort_values("doc_id").reset_index(drop=True)
    roots = [r for _, r in jaccard(good.text)]
    assert sorted(single.doc_id) == [good.doc_id[i] for i, r in enumerate(roots) if i == r]
    assert single.merge(good, on=COLUMNS).shape[0] == len(single)

    single = single.sort_values("doc_id")
    left = without_repeats([t.encode() for t in single.text])
    want = {i: b.decode("utf-8", "ignore") for i, (n, _, b) in zip(single.doc_id, left) if b}
    assert dict(zip(cut.doc_id, cut.text)) == want
    assert (cut.n_chars == cut.text.str.len()).all()

    taken = duck(documents=cut).execute(OP3_SQL).df()
    copies = {i: t // s if s else None for i, s, t in zip(taken.doc_id, taken["size"], taken.taken)}
    found = mixed.doc_id.value_counts().to_dict()
    assert all(found.get(i, 0) == n for i, n in copies.items() if n is not None)

    encode = packing.encoder()
    assert packed.length.sum() == sum(len(encode(t)) + 1 for t in mixed.text)
    ends = (packed.offset + packed.length).groupby(packed.sequence_id).max()
    assert (ends == packed.length.groupby(packed.sequence_id).sum()).all() and ends.max() <= 2048


def test_stages_take_awkward_and_empty_tables(spark):
    for rows in (DOCUMENTS, []):
        docs = documents(spark, rows).select(*COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.written(stage(spark, docs, TABLES), "test")
            docs = out if out.columns == COLUMNS else docs
        assert out.count() == 0 or rows


def test_stages_leave_other_columns_as_they_were(spark):
    """Times, maps, binary, nested and dotted names; also in a session that is not in UTC."""
    long = " ".join(f"w{k}" for k in range(120))
    rows = [(i, f"{long} own{i} " + " ".join(f"v{i}x{k}" for k in range(300)) if i < 4 else None, "en", "a", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr(
        "*", "timestamp_micros(1700000000123456 + doc_id) AS at", "map(doc_id, named_struct('t', timestamp_micros(doc_id))) AS `a.b`",
        "binary(lang) AS raw", "CAST(doc_id AS decimal(20,3)) AS `d``e`", "array(date '2024-01-01', null) AS days", "CAST(null AS double) AS none",
    )
    others = [f"`{c.replace('`', '``')}`" for c in docs.columns if c not in ("text", "n_chars")]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            kept = docs.where("doc_id < 4")
            for stage, want in ((quality_documents, kept), (distinct_documents, docs), (unrepeated_documents, docs), (mixed_documents, None)):
                got = stage(docs)
                assert got.schema.simpleString() == docs.schema.simpleString()
                found = sorted(map(repr, got.select(*others).collect()))
                # The mix takes documents more or less than once.
                assert found == sorted(map(repr, want.select(*others).collect())) if want else set(found) <= set(map(repr, docs.select(*others).collect()))
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
