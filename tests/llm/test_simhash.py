import numpy as np
import pytest

from bazaar.llm import simhash


def brute(rows):
    """component_id of each row: all pairs, united."""
    prints = [simhash.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(known) if known else None
    return [(doc_id, prints[i], least[find(i)]) for i, (doc_id, _) in enumerate(rows)]


def test_fingerprint_counts_bits_over_half():
    import xxhash

    def plain(words):
        runs = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
        hashes = [xxhash.xxh64_intdigest(" ".join(r), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in ("A b C d e", "one", "x y", "é É a\x0bb\x1fc  d", "w " * 10):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
        assert simhash.fingerprint(text) == plain(words)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_bit_planes_count_all_distances(radius):
    draw = np.random.default_rng(radius)
    prints = draw.integers(0, 2**63, 300, dtype=np.uint64)
    prints[100:] = prints[0] ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (200, 4)).astype(np.uint64), axis=1)
    got = np.unpackbits(simhash.near(prints, simhash.planes(prints), radius).view(np.uint8), axis=1, bitorder="little", count=300)
    assert (got.astype(bool) == (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius)).all()


def test_components_equal_brute_force(documents, odd):
    for df in (documents.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = [tuple(r) for r in df.collect()]
        got = [(r.doc_id, r.simhash % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_crowded_keys_are_dealt_into_cells(spark):
    draw = np.random.default_rng(1)
    center = int(draw.integers(0, 2**62))
    prints = sorted({center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 63, (400, 2))} | {center})
    df = spark.createDataFrame([(p,) for p in prints], "simhash long")
    from bazaar.llm.components import components
    found = components(simhash.links(df, cell=16))
    roots = {r.a: r.b for r in found.collect()}
    assert set(roots.values()) == {min(prints)} and set(roots) == set(prints) - {min(prints)}


def test_one_of_each_keeps_one_row_of_a_component(odd, nothing):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    assert simhash.one_of_each(nothing).collect() == []
