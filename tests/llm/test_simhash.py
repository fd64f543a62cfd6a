import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracequery.llm import simhash as s
from tracequery.llm.common import components


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def brute_components(rows):
    """Rows link by their fingerprints alone; a class has its smallest id."""
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    linked = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if (a ^ b).bit_count() <= 3]
    low = brute_classes(distinct, linked)
    ids = {c: min((i for i, f in fps if low[f] == c and i is not None), default=None) for c in low.values()}
    return sorted((i, f"{f:016x}", ids[low[f]]) for i, f in fps if i is not None)


@given(st.text(st.sampled_from("aAbB \tıß\x0b\x1c"), max_size=40))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_fingerprint(text)


def test_tree_finds_all_within_radius():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for b in base for _ in range(10)} | set(base))
    values = [v & (2**64 - 1) for v in values]
    tree = s.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:80]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]
    assert s.BKTree().within(5, 3) == []


def test_every_close_pair_shares_a_shard():
    rng = random.Random(2)
    for blocks in (4, 5, 7):
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 3):
                b ^= 1 << bit
            assert any(a & m == b & m for m in s.masks(3, blocks))
    assert s.blocks_for(1000, 3) == 4 and s.blocks_for(10**10, 3) > 4


def collected(df):
    return sorted((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in df.collect() if r.doc_id is not None)


def test_awkward_documents(awkward):
    got = s.near_duplicates(awkward)
    assert got.count() == awkward.count()
    assert collected(got) == brute_components([(r.doc_id, r.text) for r in awkward.collect()])


def test_sample_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert collected(s.near_duplicates(docs)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_split_shards_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    place = {v: i for i, v in enumerate(signed)}
    edges = s.linked_values(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, block=16)
    edges = spark.createDataFrame([(place[r.src], place[r.dst]) for r in edges.collect()], "src long, dst long")
    got = {r.node: r.component for r in components(edges, "src", "dst").collect()}
    linked = [(i, j) for i, a in enumerate(values) for j, b in enumerate(values[:i]) if (a ^ b).bit_count() <= 3]
    want = brute_classes(range(len(values)), linked)
    assert {n: got.get(n, n) for n in range(len(values))} == want


def test_drop_keeps_one_of_each_group_and_all_columns(awkward, no_docs):
    out = s.drop_near_duplicates(awkward)
    assert out.columns == awkward.columns
    want = {low for *_, low in brute_components([(r.doc_id, r.text) for r in awkward.collect()])}
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert s.near_duplicates(no_docs).collect() == [] and s.drop_near_duplicates(no_docs).collect() == []


def test_drop_takes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one text", 7, 7), (2, "one text", 8, 8), (3, "another", 9, 9), (3, "another", 9, 9)], "doc_id long, text string, __ID long, n long")
    out = s.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_hex(spark):
    df = spark.createDataFrame([(-1,), (255,), (0,)], "fp long")
    assert [r[0] for r in df.select(s.hex_of(df.fp)).collect()] == ["f" * 16, "00000000000000ff", "0" * 16]


def test_components_of_a_long_chain(spark):
    n = 200
    order = np.random.default_rng(0).permutation(n).tolist()
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(500, 501), (501, 501)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(n)} | {500: 500, 501: 500}


def brute_similarity(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_similar_copies_are_dropped_and_less_similar_texts_kept(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], set()
    for i in range(60):
        words = [word() for _ in range(rng.randrange(100, 300))]
        copy = list(words)
        for j in range(3, len(copy), rng.choice([15, 30, 48, 60, 100])):
            copy[j] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        want |= {2 * i} | ({2 * i + 1} if brute_similarity(rows[-2][1], rows[-1][1]) < 0.8 else set())
    assert 70 < len(want) < 110
    near = [brute_similarity(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(60)]
    assert sum(0.8 <= x < 0.95 for x in near) > 10
    out = s.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == want


def test_similar_sets_equal_brute_force_also_in_blocks(spark):
    rng = random.Random(12)
    base = [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(50)) for _ in range(60)]
    texts = []
    for _ in range(80):
        words = list(base if rng.random() < 0.7 else texts[rng.randrange(len(texts))].split() if texts else base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = str(rng.random())
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if brute_similarity(texts[i], texts[j]) >= 0.8]
    want = brute_classes(range(len(texts)), linked)
    assert s.similar_sets([s.shingles(t) for t in texts], 0.8).tolist() == [want[i] for i in range(len(texts))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.node: r.component for r in s.similar_texts(docs, block=7).collect()}
    node = [r[0] for r in docs.selectExpr("xxhash64(text)").collect()]
    label = [got.get(n, n) for n in node]
    assert [[a == b for b in label] for a in label] == [[want[i] == want[j] for j in want] for i in want]


def test_unlike_texts_of_one_id_stay_and_copies_without_id_go(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, a), (2, b), (None, c.upper())]
    out = s.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id or 0, r.text.lower()) for r in out.collect())
    assert got == [(0, c), (1, a), (1, b)]


def test_an_id_with_unlike_texts_is_no_link(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, b), (None, "else")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in s.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 2), (1, 1), (2, 1), (2, 2), (3, 2)]


def test_trees_find_near_copies_within_their_radius_and_bands_the_rest(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for i in range(80):
        words = [word() for _ in range(rng.randrange(100, 300))]
        copy = list(words)
        for j in range(3, len(copy), rng.choice([30, 48, 60, 100, 150])):
            copy[j] = word()
        texts += [" ".join(words), " ".join(copy)]
    fps = [s.set_fingerprint(s.shingles(t)) for t in texts]
    like = {2 * i + 1 for i in range(80) if brute_similarity(texts[2 * i], texts[2 * i + 1]) >= 0.8}
    close = {2 * i + 1 for i in range(80) if (fps[2 * i] ^ fps[2 * i + 1]).bit_count() <= s.COPY_RADIUS}
    assert len(like & close) > 10 and len(like - close) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = lambda: set(range(160)) - {r.doc_id for r in s.drop_near_duplicates(docs).collect()}
    assert gone() == like
    monkeypatch.setattr(s, "band_hits", lambda _: spark.createDataFrame([], "src long, dst long"))
    assert gone() == like & close


def test_hits_of_the_trees_are_compared_exactly(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:300]), " ".join(words[:390])]
    assert [brute_similarity(texts[0], t) >= 0.8 for t in texts] == [True, False, True]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) node", "text")
    node = [r[0] for r in docs.select("node").collect()]
    hits = spark.createDataFrame([(n, 1) for n in node], "node long, component long")
    for few in (s.FEW_TEXTS, 0):
        monkeypatch.setattr(s, "FEW_TEXTS", few)
        links = s.compared(docs, hits, 5, 0.8, 512).collect()
        assert {frozenset(r) for r in links} == {frozenset((node[0], node[2]))}


def test_set_fingerprint():
    rng = random.Random(14)
    for n in (1, 2, 9, 9000):
        hashes = [rng.getrandbits(64) for _ in range(n)]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)
        assert s.set_fingerprint(np.array(sorted(hashes), dtype=np.uint64)) == want
