import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from furrow.llm import chunking, common, minhash, simhash, tiling
from furrow.llm import queries as Q
from tests.llm.conftest import AWKWARD, table


def slow_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, alike):
    """Least position reachable of every value, comparing all pairs."""
    name = list(range(len(values)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if alike(values[i], values[j]):
                x, y = root(i), root(j)
                name[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(values))]


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_simhash_query(spark, sf, texts):
    prints = [slow_fingerprint(t) for _, t in texts]
    roots = components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {(i, format(p, "016x"), texts[r][0]) for (i, _), p, r in zip(texts, prints, roots, strict=True)}
    assert {tuple(r) for r in Q.op8_simhash(spark, sf).collect()} == want


@pytest.mark.parametrize("radius", [0, 1, 4, 10])
def test_bit_planes_count_as_popcount(radius):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 14), replace=False)) for _ in range(500)], dtype=np.uint64)
    near = np.unpackbits(simhash.within(simhash.planes(a), simhash.planes(b), radius).view(np.uint8), bitorder="little")[:500]
    assert np.array_equal(near == 1, np.bitwise_count(a ^ b) <= radius)


def test_forest_connects_what_the_radius_connects():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([centres, *[c ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for c in centres]]))
    group = np.sort(rng.integers(0, 3, len(values)))
    a, b = simhash.forest(values, group, 3)
    assert (group[a] == group[b]).all() and (np.bitwise_count(values[a] ^ values[b]) <= 3).all()
    want = components(list(zip(values.tolist(), group.tolist(), strict=True)), lambda x, y: x[1] == y[1] and (x[0] ^ y[0]).bit_count() <= 3)
    got = components(list(range(len(values))), lambda x, y, links=set(zip(a.tolist(), b.tolist(), strict=True)): (x, y) in links or (y, x) in links)
    assert got == want and len(a) == len(values) - len(set(want))


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << rng.randrange(0, 64) for _ in range(rng.randrange(0, 4))) for _ in range(120)})
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    links = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, 4, block_rows=16).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    got = components(values, lambda x, y: (x, y) in links or (y, x) in links)
    assert got == components(values, lambda x, y: (x ^ y).bit_count() <= 4)


def test_simhash_of_awkward_rows(awkward, nothing):
    got = simhash.simhash_components(awkward).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, format(slow_fingerprint(t), "016x")) for i, t, *_ in AWKWARD)
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 4)} == {2}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 6)} == {1}
    assert simhash.simhash_components(nothing).count() == 0


def test_connected_components(spark):
    rng = random.Random(6)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(30)] + [(500, k) for k in range(501, 540)]
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components(nodes, lambda x, y, s=set(pairs): (x, y) in s or (y, x) in s)
    assert got == {n: nodes[r] for n, r in zip(nodes, want, strict=True)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    out = [" ".join(base)]
    for k in range(6):  # near copies: a few words changed
        other = list(base)
        for _ in range(2):
            other[rng.randrange(300)] = f"n{k}"
        out.append(" ".join(other))
    return out + [" ".join(f"u{rng.randrange(5000)}" for _ in range(200)) for _ in range(5)]


def test_one_of_each_group_stays(spark, awkward, nothing):
    rows = [(i + 1, t, "en", "s") for i, t in enumerate(near_texts())]
    kept = simhash.near_unique(table(spark, rows + [rows[8], (None, rows[9][1], "en", "s")]))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 8, 9, 11, 12]  # a null id is the least
    got = simhash.near_unique(awkward)
    assert got.columns == awkward.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 0, 1, 5, 7, 8, 8, 9]
    assert simhash.near_unique(nothing).count() == 0


def unequal_texts(seed, count, size, least, most):
    """Variants of one text with ``least`` to ``most`` of its words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9000)}" for _ in range(size)]
    out = []
    for k in range(count):
        other = list(base)
        for at in rng.sample(range(size), rng.randrange(least, most + 1)):
            other[at] = f"n{k}x{at}"
        out.append(" ".join(other))
    return out


def kept_of(texts, radius=10, similarity=0.8):
    """Positions that comparing all pairs leaves."""
    rows = [(slow_fingerprint(t, 5), shingle_set(t)) for t in texts]
    return sorted(set(components(rows, lambda a, b: (a[0] ^ b[0]).bit_count() <= radius and jaccard(a[1], b[1]) >= similarity)))


@pytest.mark.parametrize("dealt", [{}, {"block_rows": 32, "block_shingles": 4000}])
def test_near_duplicates_are_all_verified(spark, monkeypatch, dealt):
    texts = unequal_texts(11, 150, 300, 4, 8) + unequal_texts(12, 100, 200, 2, 5)
    whole = simhash.further_links
    monkeypatch.setattr(simhash, "further_links", lambda *a: whole(*a, **dealt))
    kept = simhash.near_unique(table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == kept_of(texts)


def test_equal_fingerprints_are_verified(spark):
    rng = random.Random(13)
    line = " ".join(f"line{k}" for k in range(9))
    own = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    texts = [" ".join([line] * 40 + [o]) for o in own + [own[0] + " end", own[3] + " end"]]
    assert len({slow_fingerprint(t, 5) for t in texts}) < 4
    kept = simhash.near_unique(table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == kept_of(texts) == list(range(12))


def plain_prints(text):
    found = minhash.Prints([text])
    return minhash.components(found.least, found.empty)[0]


def test_minhash_query(spark, sf, texts):
    got = {r["doc_id"]: r for r in Q.op5_minhash(spark, sf).collect()}
    assert len(got) == len(texts)
    errors = []
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = minhash.edit(t, after)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == minhash.fingerprint_text(plain_prints(t)) and r["edited_fingerprint"] == minhash.fingerprint_text(plain_prints(edited))
        errors.append(abs(r["near_edited"] - jaccard(shingle_set(t), shingle_set(edited))))
        assert abs(r["near_next"] - jaccard(shingle_set(t), shingle_set(after))) < 0.2
    assert np.mean(errors) < 0.06 and max(errors) < 0.25


def test_minhash_by_a_plain_loop():
    shingles = np.random.default_rng(2).integers(0, 1 << 63, 9000, dtype=np.uint64)
    bounds = np.array([0, 3, 3, 5000, 9000])
    low = (shingles >> np.uint64(32)).astype(object)
    for k, row in enumerate(minhash.least_values(shingles, bounds)):
        part = low[bounds[k] : bounds[k + 1]]
        for p in (0, 77, 127):
            want = min(((x * int(minhash.FACTORS[p, 0]) + int(minhash.SHIFTS[p, 0])) % 2**32 for x in part), default=2**32 - 1)
            assert row[p] == want


def test_minhash_of_awkward_rows(spark, awkward, nothing):
    got = minhash.compare_with_next(awkward).collect()
    assert Counter(r["n_chars"] for r in got) == Counter(len(t or "") for _, t, *_ in AWKWARD)
    for df in (awkward.filter("doc_id = 7"), awkward.filter("doc_id = 1"), awkward.filter("doc_id IN (2, 3)")):
        assert minhash.compare_with_next(df).count() == df.count()
    one = minhash.compare_with_next(awkward.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0
    many = table(spark, [(k, f"text {k} " + "word " * (k % 9) + "end", "en", "s") for k in range(60)])
    few, more = (sorted(map(tuple, minhash.compare_with_next(many, n).collect())) for n in (1, 25))
    assert few == more
    assert minhash.compare_with_next(nothing).count() == 0


def test_minhash_classes(spark):
    texts = near_texts(3)
    df = table(spark, [(k, t, "en", "s") for k, t in enumerate(texts + [texts[0], None, ""])])
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {**{k: 0 for k in range(7)}, **{k: k for k in range(7, 12)}, 12: 0}


@pytest.mark.parametrize("block_rows", [2048, 24])
def test_minhash_links_are_all_counted(spark, monkeypatch, block_rows):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    texts = unequal_texts(14, 80, 300, 4, 8) + unequal_texts(15, 80, 200, 2, 5)
    sets = [shingle_set(t) for t in texts]
    alike = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and jaccard(sets[i], sets[j]) >= 0.8}
    roots = components(range(len(sets)), lambda i, j: (i, j) in alike)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash.near_duplicates(table(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])).collect()}
    assert got == {k: (roots[k], sum(i == k for i, _ in alike)) for k in range(len(texts))}


def test_tiles_catch_reordered_passages():
    doc, item = np.array([0, 1, 2, 20, 21]), np.array([4, 5, 6, 0, 1])
    assert tiling.tile(doc, item, 3) == [(0, 4, 5), (20, 0, 4)]


def test_tiling_agrees_with_a_plain_search(spark):
    rng = random.Random(8)
    item = [f"i{k}" for k in range(30)]
    mixed = item[15:30] + ["x"] * 4 + item[:15]
    rows = [(1, " ".join(item), "en", "s"), (2, "before " + " ".join(mixed).upper() + "!", "en", "s"), (3, " ".join(rng.sample(item, 30)), "en", "s"),
            (4, " ".join(item[:10]), "en", "s"), (5, " ".join(item[:14] + ["gap"] + item[14:16] + ["gap"] + item[16:30]), "en", "s"), (None, " ".join(item), "en", "s"), (6, None, "en", "s")]
    bench = spark.createDataFrame([(1, ", ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["covered"], r["tiles"]) for r in tiling.contamination(table(spark, rows), bench).collect()}
    assert got == {1: (1, 30, 1), 2: (1, 30, 2), 5: (1, 28, 2), None: (1, 30, 1)}
    clean = tiling.clean_documents(table(spark, rows), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 6]


def test_tiling_query(spark, sf, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}

    def plain(t):
        return "".join(c if c.isalnum() or not c.isascii() else " " for c in t or "").lower().split()

    whole = {(i, k) for i, t in texts for k, b in items.items() if len(plain(b)) >= 5 and " ".join(plain(b)) in " ".join(plain(t))}
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in Q.op7_tiling(spark, sf).collect()}
    assert whole <= set(got) and all(got[p] == 1.0 for p in whole) and all(c >= 0.5 for c in got.values())


def test_tiling_of_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, AWKWARD[0][1]), (1, AWKWARD[0][1])], "item_id long, text string")
    assert {r["doc_id"] for r in tiling.contamination(awkward, bench).collect()} == {1, 6}
    kept = tiling.clean_documents(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 2
    assert tiling.clean_documents(awkward, bench.limit(0)).count() == len(AWKWARD)
    assert tiling.contamination(nothing, bench).count() == 0


def test_chunks_resist_shifts():
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(400))
    whole = passage.encode()

    def cut(text):
        raw = np.frombuffer(text, np.uint8)
        ends, _ = chunking.chunk_ends(raw, np.array([0, len(raw)]))
        assert ends[-1] == len(raw)
        return [text[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    assert b"".join(cut(whole)) == whole and all(16 <= len(c) <= 512 for c in cut(whole)[:-1])
    shared = set(cut(whole)) & set(cut(b"inserted " + whole[:900] + b" more " + whole[900:]))
    assert sum(map(len, shared)) > 0.85 * len(whole)
    raw = np.frombuffer(("é" * 3000).encode(), np.uint8)
    ends, _ = chunking.chunk_ends(raw, np.array([0, len(raw)]))
    assert (ends % 2 == 0).all()


def test_repeated_passages(spark, nothing, awkward):
    rng = random.Random(10)

    def words(n):
        return " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))

    passage = words(60)
    rows = [(1, f"{words(30)} {passage} {words(20)}", "en", "s"), (2, f"{words(5)} {passage}", "en", "s"), (3, words(100), "en", "s"), (4, passage[:100] + words(50), "en", "s"), (5, None, "en", "s")]
    df = table(spark, rows)
    got = {(r["doc_id"], r["action"]): r for r in chunking.repeated_passages(df).collect()}
    assert set(got) == {(1, "keep"), (2, "remove")}
    for r in got.values():
        assert r["first_doc_id"] == 1 and dict((i, t) for i, t, *_ in rows)[r["doc_id"]][r["start"] : r["stop"]] in passage and r["stop"] - r["start"] > 200
    kept = {r["doc_id"]: r["text"] for r in chunking.without_repeats(df).collect()}
    assert kept[1] == rows[0][1] and kept[3] == rows[2][1] and kept[5] is None and len(kept[2]) < len(rows[1][1]) - 200
    assert chunking.without_repeats(awkward).columns == awkward.columns and chunking.without_repeats(awkward).count() == len(AWKWARD)
    assert chunking.repeated_passages(nothing).count() == 0


def test_passages_of_51_words_are_found(spark, texts):
    rng = random.Random(16)
    known = [w for _, t in texts for w in t.split()]

    def words(n):
        return " ".join(rng.choice(known) for _ in range(n))

    shared = [words(51) for _ in range(400)]
    rows = [(2 * k + h, f"{words(40)} {p} {words(40)}", "en", "s") for k, p in enumerate(shared) for h in (0, 1)]
    got = {r["doc_id"] for r in chunking.repeated_passages(table(spark, rows)).collect()}
    assert len(got) >= 0.99 * len(rows)


def test_chunk_query_finds_shared_windows(spark, sf, texts):
    seen = {}
    for i, t in texts:
        words = t.split(" ")
        for k in range(len(words) - 59):
            seen.setdefault(" ".join(words[k : k + 60]), set()).add(i)
    need = {i for v in seen.values() if len(v) > 1 for i in v}
    by_id = dict(texts)
    rows = Q.op9_chunking(spark, sf).collect()
    got = {r["doc_id"] for r in rows}
    assert len(need - got) <= 0.03 * len(need)
    assert all(any(by_id[r["doc_id"]][r["start"] : r["stop"]][:16] in t for i, t in texts if i != r["doc_id"]) for r in rows)
