r"""WARC archives through a chunked record table.

A record is a run of rows (record, chunk number), each with a bounded piece of the
payload; an oversized payload is several rows and becomes several WARC records, a
first segment and continuations, so no task holds a whole record. Archives are plain
``.warc.gz`` files written by Spark in a folder that all executors see. Reading back
streams the pieces of each file through a parser that goes by Content-Length, feeds an
incremental digest, and gives the same table of chunks: each row carries the number
of payload bytes and the SHA-256 of the payload up to and with it.

Of records with equal payloads of at least ``revisit_bytes`` the one with the smallest
page id is a response, the others are revisits of it, which hold no payload but name
its length and digest. A null payload is empty. Rows with the smallest page id that
occur twice are all responses; a row without page id revisits a row that has one, and
is a response if there is none. A null URL has no target header; control characters
and spaces in a URL are percent-encoded. Other columns are not looked at. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.llm.common import read_table, shared_folder

CHUNK = 64 * 1024
REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
# The line end, the end of a record, and the HTTP head of every block.
EOL, END = "\r\n", "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, "
    "n_chunks int, chunk_bytes long, payload_bytes long, payload_digest string, intact boolean"
)


def record_roles(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html) with payload, payload_bytes, payload_digest and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    # Only payloads that occur twice are joined; most do not.
    firsts = (
        rows.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy(F.col("payload_digest").alias("of_digest"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
        .where("times > 1 AND first IS NOT NULL")
        .drop("times")
    )
    joined = rows.join(firsts, F.col("payload_digest") == F.col("of_digest"), "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.withColumn("refers_to", refers_to).drop("of_digest", "first")


def _urn(page_id: Column, digest: Column, n: Column) -> Column:
    """A record id in the form of a UUID, made from page id, payload and chunk number."""
    name = F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("none")), digest, n.cast("string"))
    h = F.md5(name.cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def chunk_table(roles: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per record and chunk; revisits have one empty chunk."""
    held = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    last = F.greatest(F.ceil(held / chunk), F.lit(1)).cast("int")
    return (
        roles.withColumn("n_chunks", last)
        .withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.col("n_chunks"))))
        .withColumn(
            "data",
            F.when(
                F.col("refers_to").isNull(),
                F.substring("payload", (F.col("chunk_no") - 1) * chunk + 1, F.lit(chunk)),
            ).otherwise(F.lit("").cast("binary")),
        )
        .drop("payload")
    )


def warc_record(date: str = DATE) -> Column:
    """The bytes of the WARC record of a row of the chunk table, without the end mark."""
    first, revisit = F.col("chunk_no") == 1, F.col("refers_to").isNotNull()
    own = _urn(F.col("page_id"), F.col("payload_digest"), F.lit(1))
    clean = F.col("url")
    for mark in [chr(c) for c in range(33)] + [chr(127)]:
        clean = F.replace(clean, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    head = F.when(first, F.lit(HTTP_HEAD)).otherwise("")

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    many = F.col("n_chunks") > 1
    lines = [
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"), F.col("chunk_no"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Profile", F.lit(PROFILE), revisit),
        line("WARC-Refers-To", _urn(F.col("refers_to"), F.col("payload_digest"), F.lit(1)), revisit),
        line("WARC-Segment-Number", F.col("chunk_no"), many),
        line("WARC-Segment-Origin-ID", own, many & ~first),
        line("WARC-Segment-Total-Length", F.col("payload_bytes") + len(HTTP_HEAD), many & (F.col("chunk_no") == F.col("n_chunks"))),
        line("X-Page-ID", F.col("page_id")),
        line("X-Refers-To-Page-ID", F.col("refers_to"), revisit),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("X-Segments", F.col("n_chunks")),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("Content-Length", F.octet_length(head) + F.octet_length("data")),
        F.lit(EOL),
        head,
    ]
    return F.concat(F.concat(*lines).cast("binary"), F.col("data"))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, chunk: int = CHUNK) -> None:
    """Archives of all pages in ``folder``: one file per task, records in whole files."""
    chunks = chunk_table(record_roles(pages, revisit_bytes), chunk)
    chunks.select(warc_record().cast("string").alias("value")).write.text(folder, compression="gzip", lineSep=END)


class _Reader:
    """Parser of one archive. It takes the file's bytes in pieces of any size, and keeps no more
    than one piece and one header."""

    def __init__(self) -> None:
        self.fields: dict[str, str] | None = None
        self.rest = b""
        self.left = self.fed = self.total = self.skip = 0
        self.digest = hashlib.sha256()

    def rows(self, piece: bytes) -> Iterator[tuple]:
        data = self.rest + piece
        while True:
            if self.fields is None:
                end = data.find(END.encode())
                if end < 0:
                    break
                self._start(data[:end])
                data = data[end + len(END) :]
            elif self.skip:  # the HTTP head of a first segment is no payload
                if len(data) < self.skip:
                    break
                data, self.left, self.skip = data[self.skip :], self.left - self.skip, 0
            elif self.left:
                if not data:
                    break
                some = data[: self.left]
                self.digest.update(some)
                self.fed, self.total, self.left = self.fed + len(some), self.total + len(some), self.left - len(some)
                data = data[len(some) :]
            else:
                if len(data) < len(END):
                    break
                if not data.startswith(END.encode()):
                    raise ValueError("a record does not end where its Content-Length says")
                yield self._row()
                data, self.fields = data[len(END) :], None
        self.rest = data

    def _start(self, header: bytes) -> None:
        if not header.startswith(b"WARC/"):
            raise ValueError(f"no record starts where one is due: {header[:40]!r}")
        lines = header.decode("utf-8", "replace").split(EOL)[1:]
        self.fields = dict(x.split(": ", 1) for x in lines if ": " in x)
        self.left, self.fed = int(self.fields["Content-Length"]), 0
        if self.fields["WARC-Type"] != "continuation":
            self.digest, self.total, self.skip = hashlib.sha256(), 0, len(HTTP_HEAD)

    def _row(self) -> tuple:
        f = self.fields
        number = lambda name: int(f[name]) if name in f else None
        said = f["WARC-Payload-Digest"].removeprefix("sha256:")
        part, parts = int(f.get("WARC-Segment-Number", 1)), int(f["X-Segments"])
        origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
        refers_to = number("X-Refers-To-Page-ID")
        kind = {"revisit": "revisit"}.get(f["WARC-Type"], "response")
        if kind == "revisit":
            total, digest, intact = number("X-Payload-Length"), said, True
        else:
            total, digest = self.total, self.digest.copy().hexdigest()
            intact = part < parts or (digest == said and total == number("X-Payload-Length"))
        return (
            origin, number("X-Page-ID"), f.get("WARC-Target-URI"), kind, refers_to, part, parts, self.fed, total, digest, intact,
        )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of all archives in ``folder``, by streaming each file once."""
    names = [f.split(" ")[0] for f in CHUNK_SCHEMA.split(", ")]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, reader = None, _Reader()
        for batch in batches:
            rows: list[tuple] = []
            for file, part in batch.groupby("file", sort=False)["value"]:
                if file != name:
                    name, reader = file, _Reader()
                for piece in part:
                    rows.extend(reader.rows(piece + END.encode()))
            # Declared as integers at once: a column with nulls would pass through doubles.
            columns = dict(zip(names, zip(*rows))) if rows else {c: () for c in names}
            long = ("page_id", "refers_to", "chunk_bytes", "payload_bytes")
            yield pd.DataFrame(
                {c: pd.array(x, "Int64") if c in long else pd.Series(x, dtype=object) for c, x in columns.items()}
            )

    lines = spark.read.text(folder, lineSep=END, pathGlobFilter="*.gz")
    pieces = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    return pieces.mapInPandas(parsed, CHUNK_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    folder = shared_folder(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    chunks = read_archives(spark, folder)
    damaged = F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))
    return chunks.where("chunk_no = n_chunks").select(
        "page_id",
        "payload_bytes",
        F.when(F.col("intact"), F.col("payload_digest")).otherwise(damaged).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP8_SQL = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM rows),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM digests)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
