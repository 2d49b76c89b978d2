"""Secret scans with one deterministic automaton for all rules.

A rule's matches are those of its head and body, leftmost first, longest, and not
overlapping another match of the rule; those whose body is shorter than ``least`` are
then dropped. The patterns of all rules, turned backwards, are compiled into one minimal
automaton that may begin anywhere (``automata``). It goes over each text's UTF-8 bytes
once, from the end; a state's label tells which rules have a match that starts at this
byte. Only from such starts, from left to right and past the match before, a rule's own
automaton follows the bytes of the match to its end. Matches are thus exact for all rules
at any length, and text without secrets costs one move a byte.

Automata are compiled on the driver from the rules alone and sent with the tasks.

Spans are in code points, the end exclusive. Null and empty texts have none. Repeated
rows and ids get a row each; a null id stays null. Other columns are not looked at;
``without_secrets`` passes them on. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatescope.llm.automata import Automaton, automaton, parsed, turned
from estatescope.llm.common import read_table, small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``head`` (letters in either case, if ``any_case``), then ``body`` of ``least`` bytes."""

    kind: str
    body: str
    least: int = 1
    head: str = ""
    any_case: bool = False


# The base rules. A run of hex digits that is too short cannot hold a long
# enough one, so its length is part of the pattern and short runs are no starts.
BASE_RULES = (
    Rule(
        "assign",
        r"[A-Za-z0-9+/_.=-]+",
        6,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public formats of further keys and tokens.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<kind: string, start: long, end: long>>"


@dataclass(frozen=True)
class Scanner:
    """What tasks need: the combined automaton, and each rule's own and that of its head."""

    rules: tuple[Rule, ...]
    starts: Automaton
    whole: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


def compiled(rules: Sequence[Rule]) -> Scanner:
    heads = [parsed(r.head, r.any_case) for r in rules]
    trees = [("seq", [head, parsed(r.body)]) for head, r in zip(heads, rules)]
    return Scanner(
        tuple(rules),
        automaton([turned(t) for t in trees], anywhere=True),
        tuple(automaton([t]) for t in trees),
        tuple(automaton([h]) if r.head else None for h, r in zip(heads, rules)),
    )


def _linked_rows(machine: Automaton) -> tuple[list, list[int]]:
    """The start state's row; a row holds the next state's row for each kind of byte, and last a
    label. Also the accepting patterns, as bits, of each label."""
    masks, labels = np.unique(machine.accepts, return_inverse=True)
    rows: list[list] = [[] for _ in machine.moves]
    for row, moves, label in zip(rows, machine.moves.tolist(), labels.ravel().tolist()):
        row.extend(rows[m] for m in moves)
        row.append(label)
    return rows[0], masks.tolist()


def _longest(machine: Automaton, data: bytes, at: int) -> int:
    """The end of the longest match that starts at ``at``; -1 if there is none."""
    kinds, moves, accepts, dead = machine.kinds, machine.moves, machine.accepts, machine.dead
    state, end = 0, at if accepts[0] else -1
    while at < len(data):
        state = moves[state, kinds[data[at]]]
        at += 1
        if state == dead:
            break
        if accepts[state]:
            end = at
    return end


def scan(scanner: Scanner):
    """A function from a text to its spans (kind, start, end), by start, then in the order of the rules."""
    first, masks = _linked_rows(scanner.starts)
    kinds = scanner.starts.kinds.tobytes()
    label = itemgetter(-1)
    if len(masks) > 256:
        raise ValueError("rules with more than 256 combinations of starts are to be scanned apart")

    def spans(text: str | None) -> list[tuple[str, int, int]]:
        data = (text or "").encode()
        # The one pass over all bytes, last byte first: rows lead to rows.
        seen = bytes(map(label, accumulate(data.translate(kinds)[::-1], getitem, initial=first)))
        labels = np.frombuffer(seen, np.uint8)[:0:-1]
        if not labels.any():
            return []
        found, after = [], [0] * len(scanner.rules)
        for at in np.flatnonzero(labels).tolist():
            mask = masks[labels[at]]
            for i, rule in enumerate(scanner.rules):
                if mask >> i & 1 and at >= after[i]:
                    end = after[i] = _longest(scanner.whole[i], data, at)
                    body = _longest(scanner.heads[i], data[:end], at) if scanner.heads[i] else at
                    if end - body >= rule.least:
                        found.append((at, i, end))
        found.sort()
        if not data.isascii():
            lead = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            before = np.append(0, lead)
            found = [(int(before[s]), i, int(before[e])) for s, i, e in found]
        return [(scanner.rules[i].kind, s, e) for s, i, e in found]

    return spans


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end)."""
    small_batches(docs.sparkSession)
    scanner = compiled(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = scan(scanner)
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scanned, f"doc_id long, spans {SPANS}")


def without_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """``docs`` with ``mark`` in place of each stretch of a text that spans cover; all else as it was."""
    small_batches(docs.sparkSession)
    scanner, at = compiled(rules), docs.columns.index(text_col)

    def covered(text: str, spans: list[tuple]) -> str:
        parts, done = [], 0
        for _, start, end in spans:
            if start >= done:
                parts += [text[done:start], mark]
            done = max(done, end)
        return "".join([*parts, text[done:]])

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = scan(scanner)
        for batch in batches:
            texts = [t and covered(t, spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(masked, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts of the base kinds, a digest of their spans, and all spans."""
    found = secret_spans(read_table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = [r.kind for r in BASE_RULES]
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_joined(of(*base)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _kind_sql(place: int, kind: str, pattern: str, body: int, least: int) -> str:
    """Spans of one kind: each match with what lies before it gives the match's end."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT nr, {place} AS place, '{kind}' AS kind, finish - length(whole) AS start, finish, length(inner_) AS n, {least} AS least FROM (
  SELECT nr, whole, inner_, sum(length(chunk)) OVER (PARTITION BY nr ORDER BY i) AS finish FROM (
    SELECT nr, unnest(regexp_extract_all(t, '(?s:.*?){pattern}', 0)) AS chunk, unnest(regexp_extract_all(t, '{pattern}', 0)) AS whole,
      unnest(regexp_extract_all(t, '{pattern}', {body})) AS inner_, generate_subscripts(regexp_extract_all(t, '{pattern}', 0), 1) AS i FROM docs))"""


# The same rules as patterns of whole matches, with the group and length that count.
_SQL_RULES = (
    (
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[opsur]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 1),
)

OP12_SQL = (
    "WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS t FROM documents),\nfound AS (\n"
    + "\nUNION ALL ".join(_kind_sql(i, *rule) for i, rule in enumerate(_SQL_RULES))
    + """),
good AS (SELECT *, kind || ':' || start::BIGINT || ':' || finish::BIGINT AS span FROM found WHERE n >= least),
per_doc AS (SELECT nr, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(span, ',' ORDER BY start, place) AS spans FROM good GROUP BY nr)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_doc USING (nr)
"""
)
