"""Substring dedup, hard negatives and centroid clustering against brute force, with their edge cases."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import hadamard, hardneg, substring
from tapeloom.llm.queries import QUERIES


def cut_by_hand(rows, window):
    """{row place: (n_words, n_removed, kept)} by comparing the windows themselves."""
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[1] or "")  # noqa: E731  id, the text's hash, the text
    seen, out = set(), {}
    for place in sorted({key(r): r for r in rows}.items()):
        r = place[1]
        words = (r[1] or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[place[0]] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return [out[key(r)] for r in rows]


@pytest.mark.parametrize("chunk_bytes", [400, 4000, 1 << 20])
def test_substrings_match_brute_force(spark, chunk_bytes):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)] + ["Ünï", "😀"]
    shared = [" ".join(rng.choice(words, 12)) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(words, rng.integers(0, 30)))]
        if i % 3 == 0:
            parts.insert(int(rng.integers(0, 2)), shared[0])  # a passage of a third of all documents
        if i % 7 == 0:
            parts += [shared[i % 4]] * 2
        rows.append((i * 5 % 600, " \t".join(parts)))
    rows += [(3, None), (4, ""), (7, " \n "), (None, rows[5][1]), (None, rows[6][1] + " end"), rows[0], rows[0], (rows[9][0], rows[10][1]), (9000, " ".join(rng.choice(words, 4000)))]
    rows += [(77, f"{' '.join(rng.choice(words, 9))}") for _ in range(60)]  # one id on a third of all rows
    docs = spark.createDataFrame([(a, b, "x", "kept") for a, b in rows], "doc_id long, text string, removed string, note string")
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), 11).alias("h")).collect()}
    want = cut_by_hand([(a, b, hashes[a, b]) for a, b in rows], 8)
    got = substring.dedupe(docs, window=8, chunk_bytes=chunk_bytes, least_chunk=200).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted((a or -1, b or "", *w) for (a, b), w in zip(rows, want, strict=True))
    for r in got:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(y[0] > x[1] for x, y in zip(spans, spans[1:], strict=False)) and r["note"] == "kept"


def test_substrings_of_empty_and_single_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.dedupe(docs).count() == 0
    one = substring.dedupe(spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")).first()
    assert (one["n_words"], one["n_removed"], one["kept_text"]) == (90, 87, "a b c")  # the window at word 3 equals the one at 0


def test_window_hashes_are_polynomials():
    h = np.random.default_rng(0).integers(0, 1 << 63, 70).astype(np.uint64)
    for size in (1, 2, 3, 8, 19, 20, 21):
        got = substring.rolling(h, size, substring.BASES[0])
        for at in (0, 17, 70 - size):
            x = 0
            for v in h[at : at + size].tolist():
                x = (x * substring.BASES[0] + v) % (1 << 64)
            x ^= x >> 32
            x = x * 0xD6E8FEB86659FD93 % (1 << 64)
            assert got[at] == x ^ (x >> 32)
    assert len(substring.rolling(h, 20, substring.BASES[0])) == 51


def test_equal_keys_of_different_tags_stay_apart():
    key, tag = np.array([5, 9, 5, 5, 9], np.uint64), np.array([1, 2, 3, 1, 2], np.uint16)
    order, new = substring.sorted_order(key, tag)
    assert [(int(key[i]), int(tag[i])) for i in order[new]] == [(5, 1), (5, 3), (9, 2)]
    k, t = substring.unpack(substring.pack(key[order][new], tag[order][new]))
    assert k.tolist() == [5, 5, 9] and t.tolist() == [1, 3, 2]
    assert substring.stands_in(key, np.array([1, 7, 3, 2, 2], np.uint16), [(k, t)]).tolist() == [True, False, True, False, True]


def mined_by_hand(rows, n_pos=5, n_neg=3):
    good = sorted({(i, label, tuple(int(np.floor(256.0 * x)) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    asked, out = {}, []
    for i, label, v in good:
        asked.setdefault(i, (label, v))
    for a, (label, v) in asked.items():
        if a % 50:
            continue
        scored = sorted((-dot(v, w), i, own) for i, own, w in good if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:n_pos]:
            inside = [(n, i) for n, i, own in scored if own != label and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(inside[:n_neg])]
    return sorted(out)


def vectors(n, dim, centers, seed=5):
    """Rows around few centers, one vector on a third of them."""
    rng = np.random.default_rng(seed)
    mid = rng.normal(0, 0.6, (centers, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(centers))
        v = (mid[c] + rng.normal(0, 0.05, dim)).astype(np.float32).tolist() if i % 3 else np.full(dim, 0.25).tolist()
        rows.append((i * 5, int(rng.integers(4)), v))
    return rows


def test_hard_negatives_match_brute_force(spark):
    rows = vectors(360, 8, 6)
    rows += [rows[10], rows[10], (50, 1, rows[3][2]), (100, 2, None), (None, 1, rows[1][2]), (150, None, rows[1][2]), (200, 1, [0.1, None]), (250, 1, [float("nan")] * 8), (300, 1, [float("inf")] * 8), (350, 1, [0.5, 0.5]), (400, 9, rows[4][2]), (450, 1, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, score string")
    for tuning in ({}, {"leaf_rows": 8, "fanout": 3}, {"leaf_rows": 30, "sample_rows": 40}):
        got = hardneg.mine(df, F.col("vec_id") % 50 == 0, **tuning).collect()
        assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == mined_by_hand(rows)
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_ranges_eliminate_leaves_and_lose_nothing(spark):
    rows = vectors(600, 8, 20)
    df = spark.createDataFrame([(i, label, [int(np.floor(256 * np.float32(x))) for x in v]) for i, label, v in rows], "id long, label long, v array<int>")
    tree, _ = hardneg.fit(df, n_rows=600, leaf_rows=20, fanout=4)
    x = np.array([r["v"] for r in df.collect()])
    leaf = hardneg.descend(tree, x)
    assert len(tree.paths) > 10
    s = hardneg.products(x[:60], x)
    low = np.sort(s, axis=1)[:, -5]
    high = s.max(1)
    share = 0
    for k in np.unique(leaf).tolist():
        live = hardneg.alive(tree, k, x[:60], low, high)
        inside = (s[:, leaf == k] >= low[:, None]) & (s[:, leaf == k] <= high[:, None])
        assert not (inside.any(1) & ~live).any()
        share += live.mean() / len(np.unique(leaf))
    assert share < 0.5


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [1e30] * 64)], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="after scaling"):
        hardneg.mine(df, F.col("vec_id") % 50 == 0).collect()
    with pytest.raises(Exception, match="after scaling"):
        hadamard.cluster(df)[0].collect()


def clustered_by_hand(rows, k=16, rounds=3):
    good = [(i, [int(np.floor(64.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    c = [v for _, v in start]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((away(v, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in good:
            members[place(v)[1]].append(v)
        c = [[sum(col) // len(col) for col in zip(*members[n], strict=True)] if n in members else m for n, m in enumerate(c)]
    found = [(i, *place(v)[::-1]) for i, v in good]
    own = defaultdict(int)
    for _, n, d in found:
        own[n] += d
    return sorted((-1 if i is None else i, n, d, own[n], sum(own.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in found)


@pytest.mark.parametrize("n", [0, 5, 400])
def test_clusters_match_brute_force(spark, n):
    rng = np.random.default_rng(n)
    mid = rng.normal(0, 0.3, (7, 64))
    rows = [(i, (mid[i % 7] + rng.normal(0, 0.1, 64)).astype(np.float32).tolist() if i % 3 else [0.1] * 64) for i in range(n)]
    if n:
        rows += [rows[1], rows[1], (1, rows[3][1]), (None, rows[2][1]), (900, None), (901, []), (902, [0.1] * 63), (903, [None] + [0.1] * 63), (904, [float("nan")] + [0.1] * 63), (905, [float("-inf")] + [0.1] * 63)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int")
    found, centroids = hadamard.cluster(df)
    got = found.withColumn("sha", hadamard.digest(centroids, F.col("cluster"))).collect()
    want = clustered_by_hand([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_transform_keeps_distances_and_search_is_plain(spark):
    h = hadamard.transform_matrix()
    assert (h @ h.T == 64 * np.eye(64)).all() and ((np.diff(h, axis=1) != 0).sum(1) == np.arange(64)).all()
    rng = np.random.default_rng(2)
    x, c = rng.integers(-90, 90, (500, 64)), rng.integers(-90, 90, (9, 64))
    c[5] = c[2]  # a tie
    x[:50] = c[5] + rng.integers(-2, 2, (50, 64))
    plain = ((x[:, None] - c[None]) ** 2).sum(2)
    got, d = hadamard.nearest(x, c)
    assert (got == plain.argmin(1)).all() and (d == plain.min(1)).all()


def test_queries_cover_their_tables(spark, sf_dir):
    assert QUERIES["op12_rabin_karp"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert QUERIES["op13_walsh_hadamard"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert QUERIES["op11_gnat_negatives"](spark, sf_dir).count() > 0
