import pytest
from llm_cases import DOCUMENTS, TABLES, documents, in_duck, rows_of

from estatescope.llm.quality import OP7_SQL, op7_quality, quality, quality_documents
from estatescope.llm.url_filter import OP5_SQL, compile_rules, judge_urls, op5_url_filter, pattern_rule
from estatescope.llm.warc import OP8_SQL, op8_warc, read_archives, write_archives

URLS = [
    (1, "https://Sub.Example.NET/en/a?x#y", "allow", "example.net/en/"),
    (2, "http://example.net/fr/", "block", "net/"),
    (3, "http://notexample.net", "allow", None),
    (4, "http://myexample.com/de/", "allow", None),
    (5, "http://a.b.example.com/de/x", "block", "example.com/de/"),
    (6, "x.org/fr/", "allow", None),
    (7, "ftp://x.org/fr/", "allow", "org/fr/"),
    (8, None, "allow", None),
    (9, "", "allow", None),
    (10, "https://spam-farm.example.org/en/1", "block", None),
    (10, "https://spam-farm.example.org/about/x", "allow", None),
    (None, "https://a.com/adserver/1", "block", None),
    (11, "https://a.com/adserverx/1", "allow", None),
    (12, "https://a.com/?q=://b.net/", "allow", None),
    (13, "http://" + "long/" * 5000, "allow", None),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS host", "'x' AS rule", "1 AS token", "1 AS refers_to", "1 AS n_chunks", "'x' AS value"
    )


def test_url_verdicts(spark):
    got = judge_urls(pages(spark, [(i, u, None) for i, u, _, _ in URLS])).collect()
    assert sorted(((r["page_id"] or 0, r["verdict"], r["rule"] or "") for r in got)) == sorted(
        ((i or 0, v, rule or "") for i, _, v, rule in URLS)
    )
    assert {(r["host"], r["path"]) for r in got if r["page_id"] == 1} == {("sub.example.net", "/en/a")}
    assert judge_urls(pages(spark, [])).count() == 0


def test_urls_equal_sql(spark):
    names, want = in_duck(OP5_SQL)
    assert rows_of(op5_url_filter(spark, TABLES), names) == want


def test_rules_are_found_by_tokens_that_must_stand_whole():
    assert pattern_rule("||ads.*")[1] == ["ads"]
    assert pattern_rule("*/casino^*")[1] == ["casino"]
    assert pattern_rule("*tail*")[1] == []
    assert all(r[5] for r in compile_rules())


def test_rules_without_tokens_are_tried_on_every_url(spark):
    got = judge_urls(pages(spark, [(1, "http://x.com/retail-1", None), (2, "http://x.com/", None)]), (), (("block", "*tail*"),))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "allow"}


def test_quality_equals_sql(spark):
    names, want = in_duck(OP7_SQL)
    assert rows_of(op7_quality(spark, TABLES), names) == want


def test_quality_of_awkward_rows(spark):
    got = quality(documents(spark)).collect()
    assert len(got) == len(DOCUMENTS)
    empty = [r for r in got if r["doc_id"] in (5, 6, 7)]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in empty)
    repeated = next(r for r in got if r["doc_id"] == 11 and r["n_words"] == 300)
    assert repeated["n_repeat_words"] == 300 and repeated["base_failed"]
    assert quality(documents(spark, [])).count() == 0


def shared_line_rows():
    name = lambda n: "".join(chr(97 + int(c)) for c in str(abs(n)))  # noqa: E731  digits would be made equal
    prose = lambda i: " ".join(f"{'m' * (i < 0)}w{name(i)}x{name(k)}" for k in range(60))
    boiler = " ".join(f"b{k}" for k in range(80))
    rows = [(i, f"{prose(i)}\n{boiler if i < 30 else prose(-i)}", "en", "h") for i in range(60)]
    rows += [(100 + i, prose(500), "en", "h") for i in range(40)]  # copies of one clean text
    return rows + [(200 + i, f"{prose(i)}\n{boiler}", "en", None) for i in range(10)]


def test_lines_of_many_texts_deplete_documents_but_copies_do_not(spark):
    got = {r["doc_id"]: r for r in quality(documents(spark, shared_line_rows())).collect()}
    assert all(got[i]["line_words"] == 80 and not got[i]["kept"] for i in range(30))
    assert all(got[i]["kept"] for i in [*range(30, 60), *range(100, 140), *range(200, 210)])


def test_quality_stage_keeps_the_same_rows(spark):
    for rows in (DOCUMENTS, shared_line_rows(), []):
        docs = documents(spark, rows)
        kept = quality_documents(docs)
        assert kept.columns == docs.columns
        want = sorted(str(r["doc_id"]) for r in quality(docs).where("kept").collect())
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def brute_clean(rows, limit):
    """(id, text without the lines of more than ``limit`` texts of their host) of each row."""
    import re

    space = "[ \\t-\\r]+"
    norm = lambda x: re.sub("[0-9]", "0", re.sub(space, " ", x).strip(" ").lower())
    held = {}
    for _, text, _, host in rows:
        for x in (text or "").split("\n"):
            held.setdefault((host, norm(x)), set()).add(text)
    gone = lambda host, x: norm(x) and len(held[host, norm(x)]) > limit(host)
    return [(i, t and "\n".join(x for x in t.split("\n") if not gone(h, x))) for i, t, _, h in rows]


def boilerplate_rows():
    """Clean texts with frequent lines at the top, within and at the end, some of them often;
    one text is very long, a third of all rows is one text, hosts differ."""
    prose = lambda i, m: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k // 26)}{chr(97 + k % 26)}{m}" for k in range(70))
    rows = []
    for i in range(90):
        lines = [f"Share  {i} this", prose(i, "a"), "", " \t", "share 7 THIS ", prose(i, "b"), "Share 1 this" if i % 2 else "own", ""]
        rows.append((i, "\n".join(lines), "en", "h" if i < 60 else "other" if i < 75 else None))
    rows.append((1000, "\n".join(f"share {k} this\n{prose(k, 'q')}" for k in range(600)), "en", "h"))
    return rows + [(2000 + i, f"{prose(7, 'z')}\nshare 5 this", "en", "h") for i in range(45)]


def test_frequent_lines_leave_the_texts(spark):
    rows = boilerplate_rows()
    want = dict(brute_clean(rows, lambda host: 20))
    assert sum(want[r[0]] != r[1] for r in rows) == 106  # the 60, the long one and the copies
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in quality_documents(docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert {r["doc_id"]: r["clean_text"] for r in quality(docs).collect()} == want
    awkward = sorted(map(repr, ((r["doc_id"], r["clean_text"]) for r in quality(documents(spark)).collect())))
    assert awkward == sorted(repr((i, t)) for i, t, _, _ in DOCUMENTS)


def test_the_limit_of_lines_is_the_same_for_a_large_host(spark):
    """One line in 4 % of 1,000 texts of a host, one in as many as may be."""
    word = lambda i, k: f"w{chr(97 + i // 100)}{chr(97 + i // 10 % 10)}{chr(97 + i % 10)}{chr(97 + k)}"
    prose = lambda i: "\n".join(" ".join(f"{word(i, k)}{m}" for k in range(26)) for m in "abc")
    more = lambda i: "\nread our terms" * (i < 40) + "\nsee the chart" * (i < 20)
    docs = documents(spark, [(i, prose(i) + more(i), "en", "h") for i in range(1000)])
    got = {r["doc_id"]: r["text"] for r in quality_documents(docs).collect()}
    assert got == {i: prose(i) + "\nsee the chart" * (i < 20) for i in range(1000)}


HTML = "<p>é\r\n\r\nWARC/1.1\r\n\r\n" * 20
PAGES = [
    (2, "http://a/", HTML),
    (1, "http://b/ x\r\ny", HTML),
    (1, "http://b/", HTML),
    (None, None, HTML),
    (3, "http://c/", None),
    (4, "http://c/", ""),
    (5, "http://c/", "x" * 99),
    (6, "http://c/", "x" * 99),
    (2**60 + 1, "http://d/", "\r\n\r\n" * 100 + "é" * 90_000),
    (8, "http://e/", "<i>" * 40),
]


def test_archives_equal_sql(spark):
    names, want = in_duck(OP8_SQL)
    assert rows_of(op8_warc(spark, TABLES), names) == want


@pytest.mark.parametrize("chunk", [7, 64 * 1024])
def test_archives_of_awkward_pages(spark, tmp_path, chunk):
    import hashlib

    folder = str(tmp_path / "warc")
    write_archives(pages(spark, PAGES), folder, chunk=chunk)
    chunks = read_archives(spark, folder).collect()
    assert all(r["intact"] for r in chunks)
    last = [r for r in chunks if r["chunk_no"] == r["n_chunks"]]
    assert len(last) == len(PAGES)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = 1 if html == HTML and i != 1 else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if first else "response", first))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in last]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    long = [r for r in chunks if r["page_id"] == 2**60 + 1]
    assert len(long) == -(-(400 + 180_000) // chunk)
    assert sum(r["chunk_bytes"] for r in long) == 180_400
    assert len({r["record_id"] for r in long}) == 1


def test_archives_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "none")
    write_archives(pages(spark, []), folder)
    assert read_archives(spark, folder).count() == 0


def test_damaged_archives_are_told(spark, tmp_path):
    import gzip
    from pathlib import Path

    folder = tmp_path / "warc"
    write_archives(pages(spark, [(1, "http://a/", "abc" * 50)]), str(folder))
    for file in Path(folder).glob("*.gz"):
        data = gzip.decompress(file.read_bytes()).replace(b"abcabc", b"abdabc", 1)
        for crc in Path(folder).glob(".*.crc"):
            crc.unlink()
        file.write_bytes(gzip.compress(data))
    assert [r["intact"] for r in read_archives(spark, str(folder)).collect()] == [False]
