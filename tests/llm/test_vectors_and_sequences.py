"""Clustering, packing and the prefix trie, against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from pageproof.llm import centroids, packing, prefixes

# --- clustering


def plain_clusters(rows, count, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in first[:count]]

    def near(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
        return min(range(len(far)), key=lambda c: (far[c], c)), min(far)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[0], []).append(v)
        centres = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else centres[c] for c in range(len(centres))]
    return sorted((-1 if i is None else i, *near(v)) for i, v in kept), centres


def vectors(rng, n, scale=1.0):
    middles = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(6)]
    return [(i, [m + rng.gauss(0, scale / 4) for m in rng.choice(middles)]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, cluster string, distance int"


@pytest.mark.parametrize("scale", [0.3, 1e9, 1e200])
def test_clusters_are_those_of_plain_rounds(llm, scale):
    rng = random.Random(5)
    rows = vectors(rng, 150, scale)
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[4][1]), (None, rows[5][1])]
    bad = [(600, None), (601, []), (602, [0.0] * 63), (603, [0.0] * 63 + [None]), (604, [math.nan] * 64), (605, [math.inf] * 64)]
    df = llm.createDataFrame([(*r, "x", 1) for r in rows + bad], SCHEMA).repartition(5)
    members, found = centroids.cluster(df, count=7, rounds=3)
    want, centres = plain_clusters(rows, 7, 3)
    assert [[int(x) for x in c] for c in found] == centres
    got = members.collect()
    fits = [(i, c, d if d < 2**63 else None) for i, c, d in want]
    assert sorted((-1 if r["id"] is None else r["id"], r["cluster"], -1 if r["distance"] is None else r["distance"]) for r in got) == sorted(
        (i, c, -1 if d is None else d) for i, c, d in fits
    )
    assert 0 < sum(r["computed"] for r in got) <= 7 * len(got)


def test_pivots_spare_distances_and_ties_go_to_the_smaller_centre():
    rng = random.Random(1)
    data = centroids.scaled(np.array([v for _, v in vectors(rng, 600)]))
    centres = np.concatenate([data[:20], data[:1], data[:1] + 2])
    pivots = centroids.chosen_pivots(centres)
    own, far, computed = centroids.nearest(data, centroids.pivot_distances(data, pivots), centres, pivots)
    plain = np.stack([((data - c) ** 2).sum(axis=1) for c in centres], axis=1)
    assert (own == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all()
    assert computed < 0.8 * plain.size
    halfway = (data[:1] * 0 + 1, np.array([[0] * 64, [2] * 64]))
    assert centroids.nearest(halfway[0], centroids.pivot_distances(halfway[0], pivots), halfway[1], pivots)[0][0] == 0


def test_query_columns_of_clusters_and_an_empty_table(llm):
    rng = random.Random(2)
    df = llm.createDataFrame([(*r, "x", 1) for r in vectors(rng, 60)], SCHEMA)
    rows = centroids.cluster_vectors(df).collect()
    assert sum(r["distance"] for r in rows) == rows[0]["inertia"] and len({r["vec_id"] for r in rows}) == 60
    for r in rows:
        assert r["cluster_inertia"] == sum(x["distance"] for x in rows if x["cluster"] == r["cluster"])
    empty = centroids.cluster_vectors(df.limit(0))
    assert empty.collect() == [] and empty.columns == centroids.cluster_vectors(df).columns


def test_sums_in_limbs_are_exact():
    rng = random.Random(3)
    for value in [0, -1, 2**62, -(2**62) - 1, 2**137, -(2**200), *(rng.randint(-(2**90), 2**90) for _ in range(50))]:
        parts = centroids.limbs(value)
        assert centroids.whole(parts) == value and all(-(2**62) <= p < 2**62 for p in parts)


# --- packing

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE_BPE)


def test_ids_are_the_librarys_over_all_code_points(library):
    own = packing.byte_tokenizer(BYTE_BPE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}! {chr(c)} {chr(c)}{chr(c)}b" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    odd = ["", " ", "x<|endoftext|> y", "a" * 200_000, " " * 200_000 + "b", "　" * 5000, "word " * 50_000, "!?" * 9000]
    for text, want in zip(texts + odd, library.encode_batch_fast(texts + odd, add_special_tokens=False), strict=True):
        assert own.ids(text).tolist() == want.ids


def test_every_piece_has_its_place(docs, library):
    rng = random.Random(4)
    word = lambda: rng.choice(["sun", "river", "is", "été", "!", "\n", "42"])
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 40, 400, 1500, 9000]))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(60, None), (60, ""), (7, "same id again"), (None, "no id")]
    packed = packing.pack(packing.pieces(docs(rows), BYTE_BPE, keep_ids=True)).collect()
    found, at = {}, {}
    for r in packed:
        found.setdefault(r["doc_id"], []).append(r)
        at.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text in enumerate(texts):
        want = [*library.encode(text, add_special_tokens=False).ids, 0]
        own = sorted(found[i], key=lambda r: r["piece"])
        if i != 7:
            assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
            assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == want
            assert all(r["length"] == 2048 for r in own[1:]) and len(own) == -(-len(want) // 2048)
    assert [r["length"] for r in found[60]] == [1, 1] and len(found[None]) == 1
    for own in at.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= 2048
    total = sum(r["length"] for r in packed)
    assert len(at) <= -(-total // 2048) + 1


def test_sequences_hold_their_pieces(docs):
    parts = packing.pieces(docs(["one two", "three", None, "four " * 3000]), BYTE_BPE, keep_ids=True)
    packed = packing.pack(parts, size=2048)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(map(len, whole.values())) == 4 * sum(r["length"] for r in packed.collect())


def plain_best_fit(lengths, size, limit):
    bins, made, out = [], 0, []
    for n in lengths:
        fitting = [b for b in bins if b[1] >= n]
        if fitting:
            own = min(fitting, key=lambda b: b[1])
        else:
            own = [made, size]
            made += 1
            bins.append(own)
        out.append((own[1], size - own[1]))
        own[1] -= n
        bins = [b for b in bins if b[1]]
        while len(bins) > limit:
            bins.remove(min(bins, key=lambda b: b[1]))
    return out, made


@pytest.mark.parametrize("limit", [1, 2, 5, 1000])
def test_bins_follow_plain_bounded_best_fit(limit):
    rng = random.Random(limit)
    lengths = [rng.choice([1, 2, 7, 30, 50, 99, 100, rng.randint(1, 100)]) for _ in range(3000)]
    own = packing.OpenBins(100, limit)
    spaces, fill = [], {}
    for n in lengths:
        number, offset = own.place(n)
        assert fill.get(number, 0) == offset
        fill[number] = offset + n
        spaces.append((100 - offset, offset))
        assert own.open <= limit and max(fill.values()) <= 100
    assert (spaces, own.made) == plain_best_fit(lengths, 100, limit)


def test_an_empty_table_packs_to_nothing(docs):
    assert packing.pack_documents(docs([]), BYTE_BPE).collect() == []


# --- prefix trie


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    below = lambda p: [q for q in members if q[: len(p)] == p]
    inner = {q[:-1] for q in members if q}
    for p, convs in members.items():
        tree = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in tree if q)
        ends = ",".join(str(c) for c in sorted(convs) if len(full[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in tree)
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(p), parent, len(convs), children, sum(q not in inner for q in tree), saved, digest))
    return sorted(out, key=str)


def talk(rng):
    rows = []
    for c in range(60):
        for t in range(rng.choice([0, 1, 3, 6, 12, 30])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t > 8 else "user", rng.choice(["hi", "héllo", "ok"]) if t % 4 == 0 else "same"))
    rows += [(3, None, "user", "before"), (3, 4, None, None), (3, 4, "", ""), (None, 1, "user", "nobody's"), (61, 1, "user", "hi")]
    return rows + rows[:5]


@pytest.mark.parametrize(("shard_turns", "segment"), [(20_000, 1024), (60, 4), (25, 3), (1, 1)])
def test_nodes_are_those_of_a_plain_trie(llm, shard_turns, segment):
    rows = talk(random.Random(9))
    df = llm.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, n_convs string")
    found = prefixes.prefix_trie(*prefixes.rebuilt_turns(df.repartition(6)), shard_turns, segment)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_trie(rows)


def test_one_conversation_over_many_ranges_and_no_conversation(llm):
    rows = [(5, t, "user", str(t % 7)) for t in range(700)] + [(9, 1, "user", "a")]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    turns = prefixes.numbered_turns(df)
    assert [r["pos"] for r in turns.where("conv = 5").orderBy("pos").collect()] == list(range(1, 701))
    found = prefixes.prefix_trie(*prefixes.rebuilt_turns(df), 100, 16)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_trie(rows)
    assert prefixes.conversation_trie(df.limit(0)).collect() == []


def test_ends_are_hashed_in_chunks(llm):
    df = llm.range(1000).select(F.lit(1).cast("long").alias("d1"), (F.col("id") % 2).alias("d2"), F.col("id").alias("conv"))
    found = {r["d2"]: r["ends_sha256"] for r in prefixes.ends_digests(df, 7).collect()}
    for half in (0, 1):
        assert found[half] == hashlib.sha256(",".join(map(str, range(half, 1000, 2))).encode()).hexdigest()


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(6)
    keys = prefixes.distinct(rng.integers(-5, 5, (4000, 2)) + rng.integers(-(2**62), 2**62, (4000, 2)))
    nodes = prefixes.NodeTable(keys)
    assert sorted(nodes.find(keys)) == list(range(len(keys)))
    assert (nodes.find(keys + 1) == -1).all()
    assert prefixes.NodeTable(keys[:0]).find(keys).tolist() == [-1] * len(keys)
    with pytest.raises(ValueError):
        nodes.scattered(np.array([0, 0]), np.array([1, 2]))
