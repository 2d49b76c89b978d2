import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import DOCUMENTS, TABLES, documents

from estatescope.llm import alignment

ODD = [
    "a<|endoftext|>b <s> </s> <unk> <0x41>", "  spaces \n\n\n and\ttabs   ", "中文字符和英文 mixed 🤦🏽 ½", "▁ is rewritten", "x" * 3000,
    "=" * 500 + " " * 700, "\x00 \x01", "naïve coöperation — “quotes”", "a", " ", "\n",
]


def whole(text):
    """Tokens of both tokenizers and their groups, as the contract has them."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(whole, "made"):
        a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable}
        back.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)})
        whole.made = a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), back
    a, b, back = whole.made
    if not text:
        return []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = int((ends_a <= end).sum()), int((ends_b <= end).sum())
        groups.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return groups


def brute(texts):
    """The contract's numbers for each text, from all of them."""
    every = [whole(t) for t in texts]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in every]
    held = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for groups, found in zip(every, links):
        spelt = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(found.values()),
            sum(n for p, n in found.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in found.items()),
            hashlib.sha256(spelt.encode()).hexdigest() if groups else "",
        ))
    return out


def numbers(rows):
    return sorted(repr((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in rows)


def expected(rows):
    return sorted(repr((i, *found)) for (i, *_), found in zip(rows, brute([r[1] for r in rows])))


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    assert numbers(alignment.op11_alignment(spark, TABLES).collect()) == expected(rows)


@pytest.mark.parametrize("work,most", [(16, 0), (64, 40), (16_384, 1_000_000)])
def test_awkward_texts_in_pieces(spark, work, most):
    """Small pieces, so that groups cross their borders; few frequent pairs, so that others are joined."""
    rows = [*DOCUMENTS, *((100 + i, t, "en", "z") for i, t in enumerate(ODD))]
    got = alignment.alignment_scores(documents(spark, rows), work=work, most=most).collect()
    assert numbers(got) == expected(rows)


def test_groups(spark):
    rows = [(i, t, "en", "z") for i, t in enumerate(ODD)]
    found = defaultdict(list)
    for r in sorted(alignment.alignment_groups(alignment.alignments(documents(spark, rows), work=32)).collect(), key=lambda r: r.nth):
        found[r.doc_id].append((list(r.a_ids), list(r.b_ids)))
    assert dict(found) == {i: whole(t) for i, t in enumerate(ODD) if whole(t)}


def test_empty_table(spark):
    assert alignment.alignment_scores(documents(spark, [])).count() == 0
    assert alignment.alignment_groups(alignment.alignments(documents(spark, []))).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_even_and_part_no_equal_ends(seed):
    rng = np.random.default_rng(seed)
    a, b = (np.unique(np.append(rng.integers(1, 5000, n), 5000)) for n in rng.integers(1, 3000, 2))
    i, j = alignment.cuts(a, b, 64)
    sizes = np.diff(i) + np.diff(j)
    assert sizes.sum() == len(a) + len(b) and sizes.max() <= 65 and sizes[:-1].min(initial=63) >= 63
    for x, y in zip(i[1:-1], j[1:-1]):
        assert max(a[x - 1], b[y - 1]) < min(a[x], b[y])
    parts = [alignment.stops(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]) for k in range(len(i) - 1)]
    got = np.concatenate([a[x + i[k] - 1] for k, (x, _) in enumerate(parts)])
    assert got.tolist() == sorted(set(a) & set(b))


@pytest.mark.parametrize("most", [1, 7, 1 << 22])
def test_links_in_parts(most):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 5, 200)
    i, j = np.array([3, 100, 104, 300]), np.array([1, 90, 91, 200])
    want = Counter()
    for k in range(4):
        p, q = (0 if k == 0 else x[k - 1] for x in (i, j))
        want.update((int(x) << 32) + int(y) for x in a[p : i[k]] for y in b[q : j[k]])
    pairs, times = alignment.linked(a, b, i, j, most)
    assert pairs.tolist() == sorted(want) and dict(zip(pairs.tolist(), times.tolist())) == want
