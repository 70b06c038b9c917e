import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from bazaar.llm import align, bpe
from bazaar.llm.queries import PIECES, tokenizer_path

A, B = tokenizer_path(), tokenizer_path(PIECES)
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
PARTS = ["a", "the", " ", "  ", "\n", "\n ", "\t", "'s", "12", "é", "!", "<|endoftext|>", "<s>", "<0x0A>", "中", "文", "　", "😀", "\x1c",
         "\x85", "\0", "don't", "====", "▁", "‍", " of", " and", "supercalifragilistic"]


def tokens(text):
    """(id, bytes) of A and of B, without any splitting; None where they do not give a blank and the text."""
    whole = (" " + text).encode()
    a = align._tokenizer(A).encode(" " + text, add_special_tokens=False).ids
    b = align._pieces_model(B).encode(text)
    a, b = [(i, bpe.pieces(A)[i]) for i in a], [(i, align.piece_bytes(B)[i]) for i in b]
    same = b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
    return (a, b) if text and same else None


def grouped(a, b):
    """Groups of ids, by walking along both sides byte by byte."""
    def ends(side):
        at, out = 0, {}
        for i, x in side:
            at += len(x)
            out[at] = i
        return out
    ends_a, ends_b = ends(a), ends(b)
    out, of_a, of_b = [], [], []
    for at in range(1, max(ends_a) + 1):
        if at in ends_a:
            of_a.append(ends_a[at])
        if at in ends_b:
            of_b.append(ends_b[at])
        if at in ends_a and at in ends_b:
            out.append((of_a, of_b))
            of_a, of_b = [], []
    assert not of_a and not of_b
    return out


def brute(rows):
    found, counts = [], Counter()
    for doc_id, text in rows:
        both = tokens(text) if text else None
        groups = grouped(*both) if both else []
        links = Counter((x, y) for of_a, of_b in groups for x in of_a for y in of_b)
        counts.update(links.keys())
        found.append((doc_id, both, groups, links))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return sorted((doc_id, len(both[0]) if both else 0, len(both[1]) if both else 0, len(groups), sum(links.values()),
                   sum(n for p, n in links.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in links.items()),
                   hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if both else "")
                  for doc_id, both, groups, links in found)


def got(df, **more):
    return sorted(tuple(r) for r in align.link_counts(df, A, B, **more).select(*NAMES).collect())


def test_words_split_where_no_token_of_either_crosses():
    random.seed(7)
    words = align.Words(A, B)
    for _ in range(3000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(1, 12)))
        assert "".join(align.split_words(" " + text)) == " " + text
        (found,), both = words.encode([text]), tokens(text)
        assert (found is None) == (both is None), text
        if both:
            assert [np.frombuffer(x, np.int32).tolist() for x in found] == [[i for i, _ in side] for side in both], text


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_pieces_join_to_the_same_groups(piece):
    random.seed(piece)
    for _ in range(300):
        end = random.randint(1, 40)
        a, b = (np.array(sorted({end, *(random.randint(1, end) for _ in range(random.randint(0, 30)))})) for _ in range(2))
        common = sorted(set(a.tolist()) & set(b.tolist()))
        ga, gb = align.groups(a, b, piece)
        assert a[ga - 1].tolist() == common and b[gb - 1].tolist() == common
        of_a, of_b = align.diagonals(a, b, piece)
        assert of_a[-1] == len(a) and of_b[-1] == len(b)
        work = np.diff(of_a + of_b)
        assert work.max() <= piece + 1  # a common end is not cut apart
        cuts = list(zip(of_a, of_a[1:], of_b, of_b[1:]))
        met = [(i, j) for c in cuts for i, j, _ in zip(*align.overlaps(a, b, *c))]
        spans_a, spans_b = list(zip([0, *a], a)), list(zip([0, *b], b))
        assert met == sorted((i, j) for i, (s, e) in enumerate(spans_a) for j, (t, f) in enumerate(spans_b) if max(s, t) < min(e, f))


@pytest.mark.parametrize("most", [1, 5, 1 << 21])
def test_pairs_of_long_groups_in_slices(most):
    random.seed(1)
    x = [random.randrange(9) for _ in range(60)], [random.randrange(7) for _ in range(50)]
    encoded = [tuple(np.array(s[k:], np.int32).tobytes() for s in x) for k in (0, 20)]
    found = align.Aligned(*(np.r_[np.array(s), np.array(s[20:])] for s in x), np.array([60, 100]), np.array([50, 80]),
                          np.array([1, 2, 60, 63, 100]), np.array([4, 5, 50, 51, 80]), np.array([3, 5]))
    assert len(encoded) == 2
    want = Counter()
    for t, (a0, a1, b0, b1) in zip((0, 0, 0, 1, 1), ((0, 1, 0, 4), (1, 2, 4, 5), (2, 60, 5, 50), (60, 63, 50, 51), (63, 100, 51, 80))):
        want.update((t, p * 32000 + q) for p in found.a[a0:a1].tolist() for q in found.b[b0:b1].tolist())
    text, pair, n = align.pairs_of(found, 32000, most)
    assert dict(zip(zip(text.tolist(), pair.tolist()), n.tolist())) == want and len(text) == len(want)


@pytest.mark.parametrize("table_pairs", [0, 200, 1_000_000])
def test_documents_equal_brute_force(spark, documents, table_pairs):
    rows = [(r.doc_id, r.text[:3000]) for r in documents.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, table_pairs=table_pairs) == brute(rows)


def test_odd_rows(spark, nothing):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "  \n "), (6, "é😀 ü\x00 z"), (7, "x ▁y"), (8, "　"), (9, "<|endoftext|> <s>"),
            (10, "word " * 30_000), (11, "中文字" * 500), (12, "=" * 5000), (13, "12345 " * 3 + "‍" * 300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pair int").repartition(2)
    assert got(df) == brute(rows)
    assert got(nothing) == []
    assert [r.n_a for r in align.link_counts(spark.createDataFrame([(None, "a")], "doc_id long, text string"), A, B).collect()] == [1]


def test_alignments_are_the_groups(spark):
    rows = [(1, "The transformation of tokens"), (2, None), (3, "a  b\n\nunbelievable 12345")]
    for r in align.alignments(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect():
        both = tokens(dict(rows)[r.doc_id]) if dict(rows)[r.doc_id] else None
        cut = lambda ids, ends: [ids[x:y] for x, y in zip([0, *ends], ends)]
        assert list(zip(cut(r.a_ids, r.a_ends), cut(r.b_ids, r.b_ends))) == (grouped(*both) if both else [])
