"""The training-data operators: edge cases with defined results, and brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import chat, components, decontam, langid, mixing, pii, quality, rules, simhash, tokenout, urlfilter
from tapeloom.llm.common import held_out
from tapeloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, host string"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1, 0.0, "x"), (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1, 0.0, "x"),
    (2, None, None, None, None, None, None), (3, "", "en", "", 0, 0.0, ""), (4, " \n\t ", None, "b", 3, 1.0, "h"), (5, LONG, "en", "a", len(LONG), 0.5, "h"), (None, "no id at all", "de", "b", 5, 0.1, "z"),
    (6, "12345 678 !!", "de", "b", 3, 0.0, "y"), (7, "Ünïcode  text 😀 with emoji space", "fr", "c", 9, 0.0, "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def test_quality_edges_and_accuracy(spark, sf_dir, docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert len({r["quality_score"] for r in rows if r["doc_id"] == 1}) == 1
    empty = quality.train(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(0), empty).count() == 0 and quality.score(docs, empty).first()["quality_score"] == 0.5
    got = {r["doc_id"]: r for r in QUERIES["op1_quality_mil"](spark, sf_dir).collect()}
    marks = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where(held_out()).collect()]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in marks]) >= 0.9


def test_attention_weights_sum_to_a_mean():
    bags = [np.random.default_rng(i).random((3, quality.WIDTH)).astype(np.float32) + i % 2 for i in range(40)]
    model = quality.learn(bags, np.array([i % 2 for i in range(40)], float), epochs=20)
    text = b"abc " * 2000
    x = np.concatenate(list(quality._features(text)))
    h, e = model.encode(x)
    p = np.exp(e - e.max())
    whole = quality._sigmoid((p / p.sum()) @ h @ model.weights["c"] + model.weights["d"])
    assert abs(whole - model.score(text)) < 1e-5


def test_mixing_matches_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, str(rng.choice(["a", "b", "c", "d"], p=[0.7, 0.1, 0.1, 0.1])), int(rng.integers(0, 400))) for i in range(800)] + [(9001, None, 50), (9002, "", 1)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), shard_words=2000).collect()
    total, taken, target = Counter(), Counter(), {}
    for r in out:
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(x for x in total if x is not None) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = sum(total.values()) - sum(fixed.values())
        new = {s: 3 * total[s] for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 3 * total[s]}
        if not new:
            break
        fixed |= new
    for s in names:
        want = fixed.get(s, left * weight[s] / sum(weight[x] for x in rest))
        assert abs(target[s] - want) < 1e-6 and abs(taken[s] - want) <= max(20, 0.02 * want)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), shard_words=2000).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    assert mixing.mix(sized).count() == len(ROWS) and mixing.mix(sized.limit(0)).count() == 0
    assert set(mixing.materialize(mixing.mix(sized)).columns) >= set(docs.columns)


def test_seats_are_the_highest_quotients(spark):
    rng = np.random.default_rng(3)
    votes = [("g", i, float(v)) for i, v in enumerate(rng.integers(0, 5000, 30))] + [("h", i, float(v)) for i, v in enumerate((1, 1, 1, 0, 7))]
    df = spark.createDataFrame(votes, "g string, i int, v double").withColumn("total", F.when(F.col("g") == "g", 217).otherwise(4))
    got = {(r["g"], r["i"]): r["seats"] for r in mixing.seats(df, ["g"], ["i"], "v", "total", "seats").collect()}
    for g, total in (("g", 217), ("h", 4)):
        best = sorted(((-v / (2 * k - 1), i, k) for x, i, v in votes if x == g and v for k in range(1, total + 1)))[:total]
        want = Counter(i for _, i, _ in best)
        assert {i: got[g, i] for x, i, _ in votes if x == g} == {i: want[i] for x, i, _ in votes if x == g}


def base_spans(t):
    t, out = t or "", []
    out += [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(x.isdigit() for x in m[0]) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_base_spans(spark, sf_dir, docs):
    hard = ["a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9.9.9.9999", "4111 1111-1111 1111 5", "4111111111111111 and 4111-1111-1111-1112", "+1 (017) 555-7713 +12 3 +1  - 9999999", "é😀 me@x.org 10.0.0.1", "@@ a@ @b.c a@b..c", "x" * 50_000 + " 1" * 5000]
    rows = [(i, t) for i, t in enumerate(hard)] + [(100 + i, r[1]) for i, r in enumerate(ROWS)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in got} == {i: base_spans(t) for i, t in rows}
    assert pii.find(docs.limit(0)).count() == 0 and pii.find(docs).count() == len(ROWS)


def test_pii_bootstrap_adds_credible_instances_only(spark):
    seeds = [(i, f"please contact staff{i}@mail.example.com today") for i in range(60)]
    rows = seeds + [(100, "please contact staff77@localhost today"), (101, "nothing of that 12345@here now"), (102, "version 2.0 of 1234567 units")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[100]["spans"]] == [("email", 15, 32)] and not got[101]["spans"] and not got[102]["spans"]
    assert all(got[i]["spans"] == got[i]["base"] for i in range(60))


def test_pii_bootstrap_finds_identifiers_without_a_digit(spark):
    rows = [(i, f"please contact staff{i}@mail.example.com today") for i in range(60)] + [(200 + i, f"the host answers 10.0.0.{i} since noon") for i in range(60)]
    rows += [(100, "please contact john(at)example.com today"), (101, "please contact Jane[AT]example.com today"), (102, "the host answers fe::ab:cd:ef since noon"), (103, "please contact nobody today"), (104, "(at) please [at] a:b:c")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(100, 105)] == [[("email", 15, 34)], [("email", 15, 34)], [("ip", 17, 29)], [], []]


def planted_contexts(n=120):
    """Identifiers of all kinds in some contexts that tell and some that don't, and look-alikes elsewhere."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, truth = [], {}
    for i in range(n):
        for kind, say, x in (("email", "please write to {} about it", f"{word()}.{i}@mail.example.com"), ("ip", "the server at {} answers", f"10.{i}.{i % 7}.9"), ("phone", "call us on {} before noon", f"+1 (555) 01{i % 10}-{1000 + i}"), ("card", "charged to card {} yesterday", "4111 1111 1111 1111")):
            where = " ".join(word() for _ in range(5))
            rows.append((len(rows), f"{where} {say.format(x) if i % 4 else x} {where}"))
    for kind, say, x in (("email", "please write to {} about it", "kim(at)example.org"), ("ip", "the server at {} answers", "fe80::1:2"), ("phone", "call us on {} before noon", "555-0199"), ("email", "please write to {} about it", "root@localhost")):
        truth[len(rows)] = (kind, say.index("{"), say.index("{") + len(x))
        rows.append((len(rows), say.format(x)))
    rows += [(len(rows) + i, f"{word()} {x} {word()}") for i, x in enumerate(["root@here", "1.2.3", "555-0100", "a::b", "please write to somebody about it"])]
    return rows, truth


def test_pii_bootstrap_recovers_hidden_seeds_and_finds_other_shapes(spark):
    rows, truth = planted_contexts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.find(docs).collect()}
    assert {k: v for k, v in got.items() if v} == {k: [v] for k, v in truth.items()}
    hidden = pii.find(docs, hide=5)
    r = pii.recovery(hidden).first()
    told = sum(len(x["hidden"]) for x in hidden.collect() if x["doc_id"] % 16 >= 4)  # those in a context that tells
    assert told > 50 and r["n_again"] >= 0.9 * told and r["n_again"] + len(truth) >= 0.9 * r["n_added"]


def test_pii_accepted_instances_seed_the_next_round(spark):
    rows = [(i, f"please write to staff{i}@mail.example.com about it") for i in range(40)] + [(100 + i, f"please write to desk{i}@intra about it") for i in range(12)]
    rows += [(200 + i, f"ask desk{i}@intra first") for i in range(12)] + [(300, "ask boss@intra first"), (301, "ask somebody first"), (302, "see boss@other first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda **o: {r["doc_id"] for r in pii.find(docs, **o).collect() if r["added"]}
    first = {100 + i for i in range(12)} | {200 + i for i in range(12)}
    assert got(rounds=1) == first and got() == first | {300} and got(rounds=0) == set()


def test_pii_scores_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = sorted({(str(rng.choice(pii.SIDES)), int(rng.integers(0, 6)), "ip", f"x{rng.integers(0, 12)}") for _ in range(70)})
    rows = [(*r, int(rng.integers(1, 4)), r[3] in ("x0", "x1", "x2", "x3")) for r in rows]
    places = {(r[0], r[1]): sum(x[4] for x in rows if x[:2] == r[:2]) + r[1] for r in rows}
    graph = spark.createDataFrame([(*r, places[r[:2]]) for r in rows], "side string, key long, kind string, inst string, n long, is_seed boolean, places long")
    s = {r[3]: float(r[5]) for r in rows}
    for _ in range(3):
        t = {p: sum(r[4] * s[r[3]] for r in rows if r[:2] == p) / (places[p] + 1) for p in places}
        best = lambda x, sides: max((t[r[:2]] for r in rows if r[3] == x and r[0] in sides), default=0.0)
        s = {x: 1.0 if x in ("x0", "x1", "x2", "x3") else max(best(x, ("both",)), 1 - (1 - best(x, ("l1", "l2"))) * (1 - best(x, ("r1", "r2")))) for x in s}
    got = {r["inst"]: r["s"] for r in pii.score(graph).collect()}
    assert got.keys() == s.keys() and all(abs(got[x] - s[x]) < 1e-9 for x in s)


def test_pii_edges(spark, docs):
    many = "mail a@b.cd and 10.0.0.1 now " * 2000
    more = docs.withColumns({"base": F.lit(1), "spans": F.lit(2), "added": F.lit(3)}).unionByName(docs.limit(1).withColumns({"text": F.lit(many), "base": F.lit(1), "spans": F.lit(2), "added": F.lit(3)}))
    got = pii.find(more).collect()
    assert len(got) == len(ROWS) + 1 and max(len(r["base"]) for r in got) == 4000
    whole = next(r for r in got if len(r["base"]) == 4000)
    assert pii.find(docs.limit(0)).count() == 0 and {(s["start"] % 29, s["kind"]) for s in whole["base"]} == {(5, "email"), (16, "ip")}


def test_url_rules_and_propagation(spark):
    page = lambda i, url, html=None: (i, url, html)
    rows = [
        page(1, "http://A.Example.NET/en/x?q"), page(2, "https://b.example.net/de/"), page(3, "http://x.org/fr/#a"), page(4, "http://y.example.com/de/1"), page(5, "no scheme"), page(6, None), page(7, "http://net"), page(8, "http://z.com/a", '<a href="http://b.example.net/q">'),
        page(9, "http://clean.com/a", '<a href="//w.org/">'), page(9, "http://clean.com/a", None),
    ]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["rule"] for i in range(1, 8)] == ["example.net/en/", "net/", "org/fr/", "example.com/de/", None, None, None]
    assert [got[i]["verdict"] for i in range(1, 10)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow"]
    assert (got[1]["host"], got[1]["path"], got[5]["host"], got[7]["path"]) == ("a.example.net", "/en/x", "", "")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_distrust_reaches_hosts_far_from_the_seeds(spark):
    n = 14
    rows = [(i, f"http://h{i}.com/x", f'<a href="http://h{i + 1}.com/">') for i in range(n)] + [(n, f"http://h{n}.com/x", '<a href="http://bad.net/">'), (n + 1, "http://bad.net/x", None), (n + 2, "http://lone.com/x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    assert [got[i]["verdict"] for i in range(n + 3)] == ["block"] * (n + 2) + ["allow"]
    assert all(abs(got[n - d]["host_distrust"] - 0.15 * 0.85 ** (d + 1)) < 1e-4 * 0.85**d for d in range(n + 1))
    with pytest.raises(RuntimeError, match="converged"):
        urlfilter.judge(pages, max_rounds=5)


def test_propagation_matches_power_iteration(spark):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2)) if a != b})
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", a % 3 + 1) for a, b in pairs], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0), ("h1", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: r for r in urlfilter.propagate(edges, seeds, rounds=6).collect()}
    m = np.zeros((12, 12))
    for a, b in pairs:
        m[a, b] = a % 3 + 1
    norm = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1e-300)
    for name, step, seed in (("trust", norm(m), 0), ("distrust", norm(m.T), 1)):
        s = np.eye(12)[seed]
        v = s.copy()
        for _ in range(6):
            v = 0.85 * v @ step + 0.15 * s
        assert all(abs((got[f"h{i}"][name] if f"h{i}" in got else 0) - v[i]) < 1e-9 for i in range(12))


def test_language_edges_and_exact_code_length(spark, docs, sf_dir):
    model = langid.train(docs.select("doc_id", "lang", "text"))
    got = langid.predict(docs, model).collect()
    assert all(r["lang_pred"] == "und" and r["lang_score"] == 0 for r in got if r["text"] is None or not re.search(r"[^\W\d_]", r["text"] or ""))
    assert langid.predict(docs, langid.train(docs.limit(0).select("doc_id", "lang", "text"))).where("lang_pred <> 'und'").count() == 0
    texts = {"x": [b"abracadabra", b"abrab"], "y": [b"zzyzx", b"zyzyz"]}
    counts = {k: Counter(tuple(int(c) for c in (b"\0\0\0" + t)[i : i + 4]) for t in ts for i in range(len(t))) for k, ts in texts.items()}
    rows = sorted((li, (g[0] << 24) | (g[1] << 16) | (g[2] << 8) | g[3], n) for li, k in enumerate(sorted(counts)) for g, n in counts[k].items())
    tiny = {"langs": ["x", "y"], "of": np.array([r[0] for r in rows], np.int16), "gram": np.array([r[1] for r in rows], np.uint32), "n": np.array([r[2] for r in rows]), "max_contexts": 1000, "id": "tiny"}

    def cost(lang, context, byte):
        known = {g[3] for c in counts.values() for g in c}
        seen = lambda c: tuple(x if x in known else -1 for x in c)
        bits = 0.0
        for k in (3, 2, 1, 0):
            after = Counter()
            for g, n in counts[lang].items():
                if seen(g[3 - k : 3]) == seen(context[3 - k :]):
                    after[g[3]] += n
            if after:
                if byte in after:
                    return bits + np.log2((sum(after.values()) + len(after)) / after[byte])
                bits += np.log2((sum(after.values()) + len(after)) / len(after))
        return bits + 8

    for text in (b"abra zyz!", b"x", b"zzabrab"):
        own = b"\0\0\0" + text
        want = [sum(cost(k, tuple(own[i : i + 3]), own[i + 3]) for i in range(len(text))) for k in ("x", "y")]
        assert np.allclose(langid.code_lengths(text, tiny), want, atol=1e-4)
    rows = QUERIES["op5_language_ppm"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95


def test_rule_measurements(spark, sf_dir):
    texts = [r["text"] for r in documents(spark, sf_dir)] + [r[1] for r in ROWS] + ["a b c d e f g h a b c d e f g h", "w " * 50, "x\nx\n\n x\nx"]
    led = rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in led.collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = [0] * len(w)
        for k in range(len(w) - 7):
            if seen[tuple(w[k : k + 8])] > 1:
                cover[k : k + 8] = [1] * 8
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(cover))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["rule_bits"] & 1 == (len(w) < 20) and bool(got[i]["rule_bits"] & 2) == (100 * sum(cover) > 30 * len(w))
    for r in rules.ablations(led, "corpus-1").collect():
        b = 1 << rules.BITS[r["rule"]]
        bits = [x["rule_bits"] & rules.mask(rules.POLICIES["corpus-1"]) for x in got.values()]
        assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))
    assert rules.measure(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_triples_cover_every_four_positions():
    from itertools import combinations

    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def brute_components(ids, fps):
    fps = np.array(fps, np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i in range(len(fps)):
        out[find(i)].append(ids[i])
    return {i: min((x for x in g if x is not None), default=None) for g in out.values() for i in g}


def test_simhash_links_are_whole(spark):
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)]
    for base in (0, fps[0], fps[1]):  # chains, stars and a dense group of near copies
        x = base
        for _ in range(150):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.append(x)
        fps += [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)]
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(nodes)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[roots.get(x, x)].add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_edges(spark, docs):
    got = simhash.groups(docs).collect()
    zero = [r for r in got if r["fp"] == 0]
    assert len(got) == len(ROWS) and {r["doc_id"] for r in zero} == {2, 3, 4} and {r["component_id"] for r in zero} == {2}
    words = WORD.findall("the quick brown fox jumps over the lazy dog near the river bank")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    assert simhash.fingerprint(ROWS[0][1].encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 2: 1, 5: 1, None: 1, 6: 1, 7: 1}
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("the quick brown fox"))).first()[0]
    assert int(np.int64(spark_hash).view(np.uint64)) == xxhash.xxh64_intdigest(b"the quick brown fox", 42)


def tokens_of(rows, plain):
    """(doc_id, ids with the end id) in the order of the files: ids, then the texts' hashes."""
    return [(r["doc_id"], [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy(F.asc_nulls_first("doc_id"), "h", "text").collect()]


ODD_TEXTS = ["two  spaces", " lead and trail ", "tab\t mix \n new", "it's we're <|endoftext|> x", "a" * 20_000, "a\nb c,\nd e,,. f)", "x \n", "ǆ Ÿs, don't.) a1 1a é.é", "a×b ÷ c", "nb\u00a0 x \u2003y", "\u3000 a", "x\x1c\x1dy z\x00", "日本 語 ab", "ɏɐ ʰx q", "«quote» – dash…", "1,000.5 2²", "\u0301x a\u0301b", "_x__ y_", "<|endoftext|>", "\x85 \x85a"]


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = docs.unionByName(spark.createDataFrame([(20 + i, x, None, None, 0, 0.0, "") for i, x in enumerate(ODD_TEXTS)], SCHEMA))
    folder, manifest = tokenout.write(rows, path, seq=64, shards=3)
    got, at = sorted(tokenout.read_documents(spark, folder, manifest).collect(), key=lambda r: r["start"]), 0
    for r, (doc, ids) in zip(got, tokens_of(rows, plain), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    for ids, mask, last, _ in tokenout.sequences(folder, manifest[0][0]):
        assert len(ids) % 64 == 0 and len(ids) == len(mask) == len(last) and not ids.flags.owndata
    assert tokenout.read_documents(spark, *tokenout.write(docs.limit(0), path, shards=2)).count() == 0


def test_one_id_may_fill_several_shards(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(5 if i % 3 else i, f"text number {i % 50} of many") for i in range(300)], "doc_id long, text string")
    folder, manifest = tokenout.write(rows, path, seq=16, shards=6)
    got, at = sorted(tokenout.read_documents(spark, folder, manifest).collect(), key=lambda r: r["start"]), 0
    for r, (doc, ids) in zip(got, tokens_of(rows, Tokenizer.from_file(path)), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(manifest) >= 4 and max(n for _, n in manifest) < at / 2


def test_all_documents_and_other_tokenizers_equal_the_plain_encoder(spark, sf_dir):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [r["text"] or "" for r in documents(spark, sf_dir)] + ODD_TEXTS
    for name in (path, public_tokenizers.path("word_bpe_49k.json")):
        coder, tokenizer = tokenout.Encoder(name), Tokenizer.from_file(name)
        some = texts if name == path else texts[:200]
        ids, sizes = coder.encode([x.encode() for x in some])
        want = [[*e.ids, 2] for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    coder = tokenout.Encoder(path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.sampled_from(" \n\tabZ019.,'’é×ß日\u00a0\u0301<|"), max_size=30), min_size=1, max_size=5))
    def agree(some):
        ids, _ = coder.encode([x.encode() for x in some])
        assert ids.tolist() == [i for x in some for i in [*plain.encode(x, add_special_tokens=False).ids, 2]]

    agree()


def test_chat_round_trip_and_expansion(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "a\\b <\\| \\n", "", None, "multi\nline <", "|pipe"]
    rows = [(c, t, ("user", "assistant", "system", None, "we\\ird\nrole")[(c + t) % 5], odd[(c * 7 + t) % len(odd)]) for c in range(6) for t in range(c + 2)] + [(None, 0, "assistant", "x"), (9, 0, "user", "only a user"), (9, 0, "user", "only a user")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.write(turns)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x for _, role, x in own if role == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["n_turns"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in chat.expand(formatted).collect():
        assert e["text"].endswith(chat.END) and e["text"][: e["context_end"]].count(chat.START) == e["pos"] - 1
        assert chat.unescape(e["text"][e["target_start"] : e["target_end"]]) in {x or "" for x in odd} | {"x"}
    assert chat.read_back(chat.write(turns.limit(0))).count() == 0


def test_chat_examples_hold_their_prefix_and_mask(spark):
    say = [("user", "a\\b<|im_end|>"), ("assistant", "one\n"), ("user", "two"), ("assistant", ""), ("assistant", "three"), ("user", "four")]
    turns = spark.createDataFrame([(7, i, role, x) for i, (role, x) in enumerate(say)], "conv_id long, turn long, role string, text string")
    formatted = chat.write(turns)
    stream = [f"{chat.START}{role}\n{x.replace(chr(92), chr(92) * 2).replace('<|', '<' + chr(92) + '|')}{chat.END}" for role, x in say]
    rows = {r["pos"]: r for r in formatted.collect()}
    assert {p: r["text"] for p, r in rows.items()} == {p: "".join(stream[:p]) for p in (2, 4, 5, 6)}
    assert {p: r["text"][r["target_start"] : r["target_end"]] for p, r in rows.items() if p < 6} == {2: "one\n", 4: "", 5: "three"}
    assert {p: r["context_end"] for p, r in rows.items()} == {2: len(stream[0]), 4: len("".join(stream[:3])), 5: len("".join(stream[:4])), 6: None}
    assert [r["n_examples"] for r in chat.read_back(formatted).collect()] == [3]
    for broken in (formatted.withColumn("text", F.regexp_replace("text", "two", F.concat(F.lit("tw"), F.col("pos").cast("string")))), formatted.withColumn("target_start", F.col("target_start") - 1), formatted.withColumn("text", F.regexp_replace("text", "(?s)^.*?im_end.>\n", ""))):
        with pytest.raises(Exception, match="example"):
            chat.read_back(broken).collect()


def windows_brute(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = fold(text)
    hit, found = [0] * len(w), set()
    for i, t in items:
        p = fold(t)
        k = min(10, len(p))
        for a in range(len(p) - k + 1) if p else ():
            for b in range(len(w) - k + 1):
                if w[b : b + k] == p[a : a + k]:
                    hit[b : b + k] = [1] * k
                    found |= {str(i)} - {"None"}
    return len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_wu_manber_matches_brute_force(spark, docs, part_bytes):
    items = [(1, "quick brown fox"), (2, "Dog"), (10, "one two three four five six seven eight nine ten eleven twelve"), (11, None), (12, " .. "), (3, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (10, "one two three four five six seven eight nine ten eleven twelve"), (13, "üñ"), (None, "near the river"), (5, "word5 word6")]
    more = [(50, "ONE-two three; four five six seven eight nine ten eleven"), (51, "x one two three four five six seven eight nine ten eleven twelve y two three"), (52, "Üñ ün üñ")]
    rows = docs.select("doc_id", "text", F.lit(7).alias("n_hit")).unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("n_hit", F.lit(1)))
    got = decontam.scan(rows, spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes).collect()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["hit_items"]) == windows_brute(r["text"], items)
    assert decontam.scan(rows, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0
    assert decontam.scan(rows.limit(0), spark.createDataFrame(items, "item_id long, text string"), part_bytes=part_bytes).count() == 0
    assert decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).columns == docs.columns


def test_pipeline_stages_keep_columns_and_agree_with_their_operators(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_output"]
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, p.stash(stage(spark, docs, sf_dir), name)
        assert docs.columns == before.columns and docs.count() > 0
        if name == "simhash_near_dedup":
            rows = before.collect()
            want = brute_components([r["doc_id"] for r in rows], [simhash.fingerprint((r["text"] or "").encode()) for r in rows])
            assert {r["doc_id"] for r in docs.collect()} == set(want.values())
    assert p.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_three_hundred_languages_keep_all_their_contexts(spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: alphabet[i % 26] + alphabet[i // 26 % 26] + alphabet[(i * 7) % 26]
    rows = [(3 * i + k, f"lang{i:03d}", f"{word(i)} {word(i)}{word(i)} " * 20) for i in range(300) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(docs)
    assert len(model["langs"]) > 290
    known = {int(x) for x in model["gram"]}
    learnt = {r["doc_id"] for r in docs.where(~held_out()).collect()}
    assert all(int.from_bytes(("\0\0\0" + t).encode()[k : k + 4], "big") in known for i, _, t in rows if i in learnt for k in range(len(t)))
    got = langid.predict(docs, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["lang"] in model["langs"]]) >= 0.95
    parted = langid.train(docs, part_strings=500)  # groups of languages in files give the same codes
    assert len(parted["parts"]) > 5 and parted["langs"] == model["langs"]
    assert all(np.allclose(langid.code_lengths(t, parted), langid.code_lengths(t, model)) for t in (b"abc dcb", rows[7][2].encode()))
    assert sorted(map(tuple, langid.predict(docs, parted).collect())) == sorted(map(tuple, got))


def test_long_texts_cost_the_sum_of_their_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab"[i % 2], ("the cat sat " if i % 2 else "le chat est ") * 5) for i in range(40)], "doc_id long, lang string, text string")
    model = langid.train(docs)
    text = ("the chat sat on le mat " * 300).encode()
    whole = langid.code_lengths(text, model)
    monkeypatch.setattr(langid, "BLOCK", 97)
    langid._TABLES.clear()
    assert np.allclose(langid.code_lengths(text, model), whole, rtol=1e-6)


def test_quality_learning_is_bounded_and_blind_to_held_out_labels(spark):
    rows = [(i % 40 if i % 3 else 7, f"text {i % 40} " + ("good words here " if i % 2 else "%%% $$$ ###") * 5) for i in range(600)]  # a third of all rows has one id
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(docs, labels, max_bags=20)
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, turned, max_bags=20)
    assert model.prior is None and all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    clash = docs.withColumns({"quality_score": F.lit("x"), "score": F.lit(1), "__y": F.lit(2)})
    assert quality.score(clash, model).columns == ["doc_id", "text", "score", "__y", "quality_score"]


def test_attention_gradient_lowers_the_loss_as_finite_differences_say():
    rng = np.random.default_rng(2)
    bags, y = [rng.random((n, quality.WIDTH)).astype(np.float32) for n in (1, 3, 2, 4)], np.array([0.0, 1.0, 1.0, 0.0])

    def loss(model):
        every = np.concatenate(bags)
        out = []
        for b, want in zip(bags, y, strict=True):
            h, e = quality.Model(every.mean(0), every.std(0) + 0.01, model.weights).encode(b)
            p = np.exp(e - e.max())
            s = quality._sigmoid(p / p.sum() @ h @ model.weights["c"] + model.weights["d"])
            out.append(-(want * np.log(s) + (1 - want) * np.log(1 - s)))
        return np.mean(out)

    losses = [loss(quality.learn(bags, y, hidden=5, gate=4, epochs=n, batch=4, rate=1e-3, decay=0.0)) for n in (1, 20, 60)]
    assert losses[0] > losses[1] > losses[2]
    # Adam's first step moves every weight by the rate against its gradient's sign: check that against the loss itself.
    start, step = (quality.learn(bags, y, hidden=5, gate=4, epochs=n, batch=4, rate=r, decay=0.0) for n, r in ((1, 0.0), (1, 1e-3)))
    for k in ("W", "b", "V", "U", "a", "c"):
        flat = np.abs(step.weights[k] - start.weights[k]).ravel()
        at = np.unravel_index(int(flat.argmax()), start.weights[k].shape)
        around = []
        for d in (-1e-2, 1e-2):
            moved = {n: x.astype(np.float64).copy() for n, x in start.weights.items()}
            moved[k][at] += d
            around.append(loss(quality.Model(None, None, moved)))
        assert np.sign(around[1] - around[0]) == -np.sign(step.weights[k][at] - start.weights[k][at])


def test_a_source_of_many_shards_is_dealt_over_groups(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}", 1 + i % 9) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix(df, shard_words=200, group=4).collect()
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(out) == 4000 and all(abs(taken[s] - target[s]) <= max(40, 0.02 * target[s]) for s in target)
    tied = spark.createDataFrame([(1, "a", 5, f"t{i}") for i in range(50)] + [(2, "b", 5, "x")], "doc_id long, source string, size long, text string")
    runs = [sorted((r["text"], r["taken"]) for r in mixing.mix(tied.repartition(k)).collect()) for k in (1, 3)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("heavy", [4096, 20])
def test_fingerprints_of_one_triple_are_parted_and_lose_no_link(spark, heavy):
    rng = np.random.default_rng(9)
    low = 0x0000_0000_00AB_CDEF
    fps = sorted({low | (int(x) << 24) for x in rng.integers(0, 1 << 39, 300)} | {low | 1 << b for b in range(24, 63)} | {low | 3 << b for b in range(24, 60)})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(nodes, heavy=heavy)).collect()}
    want, groups = brute_components(list(range(len(fps))), fps), defaultdict(set)
    for i, x in enumerate(fps):
        groups[roots.get(x, x)].add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_hosts_edges_and_verdicts_match_brute_force(spark):
    rng = np.random.default_rng(6)
    hosts = ["a.ok.org", "b.ok.org", "ok.org", "x.bad.net", "bad.net", "c.com", "d.c.com", "e.com", "f.de", "g.h.i.de"]
    rows = []
    for i in range(60):
        h = hosts[int(rng.integers(0, len(hosts)))]
        links = [hosts[int(k)] for k in rng.integers(0, len(hosts), rng.integers(0, 4))]
        rows.append((i, f"https://{h}/{'fr/' if i % 5 == 0 else 'p'}", " ".join(f'<a href="http://{x}/q">' for x in links)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("old"), "path": F.lit(1), "verdict": F.lit(True), "rule": F.lit(2)})
    count, votes = Counter(), {}
    for _, url, html in rows:
        h = url.split("/")[2]
        for x in set(re.findall("http://([^/]*)", html)):
            if x != h:
                count[h, x] += 1
        parts = h.split(".")
        for k in range(len(parts) - 2):
            a, b = ".".join(parts[k:]), ".".join(parts[k + 1 :])
            votes.setdefault(("up", a, b), 1), votes.setdefault(("up", b, a), 1)
    for _, a, b in votes:
        count[a, b] += 1
    got = {(r["src"], r["dst"]): r["n"] for r in urlfilter.host_edges(pages, url_col="url", html_col="html").collect()}
    assert got == dict(count)
    names = sorted({x for e in count for x in e} | {r[1].split("/")[2] for r in rows})
    m = np.zeros((len(names),) * 2)
    for (a, b), n in count.items():
        m[names.index(a), names.index(b)] = n
    rule = lambda url: "org/fr/" if url.split("/")[2].endswith("org") and url.endswith("/fr/") else "net/" if url.split("/")[2].endswith("net") else None
    seed = {k: np.array([sum(rule(u) == r and u.split("/")[2] == x for _, u, _ in rows) for x in names], float) for k, r in (("t", "org/fr/"), ("d", "net/"))}
    walk = {}
    for k, step in (("t", m), ("d", m.T)):
        p, s = step / np.maximum(step.sum(1, keepdims=True), 1e-300), seed[k] / max(1, seed[k].sum())
        v = s.copy()
        for _ in range(300):
            v = 0.85 * v @ p + 0.15 * s
        walk[k] = v / v.sum()
    want = {i: {"net/": "block", "org/fr/": "allow", None: "block" if walk["d"][k := names.index(u.split("/")[2])] > 0.5 * (walk["t"][k] + walk["d"][k]) else "allow"}[rule(u)] for i, u, _ in rows}
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, tolerance=1e-6).collect()} == want


def test_columns_named_like_results_are_replaced(spark, docs):
    names = ("target", "taken", "source_size", "n_words", "rule_bits", "n_lines", "lang_pred", "lang_score", "fp", "component_id")
    d = docs.withColumns({**{c: F.lit("old") for c in names}, "size": mixing.n_words(F.col("text"))})
    mixed = mixing.mix(d)
    assert sorted(mixed.columns) == sorted(d.columns) and mixed.where("CAST(target AS STRING) = 'old'").count() == 0
    led = rules.measure(d)
    assert len(set(led.columns)) == len(led.columns) and led.where("CAST(n_words AS STRING) = 'old'").count() == 0 and led.count() == len(ROWS)
    said = langid.predict(d, langid.train(d.select("doc_id", "lang", "text")))
    assert sorted(said.columns) == sorted(d.columns) and said.where("lang_pred = 'old'").count() == 0
    assert simhash.deduplicate(d).columns == d.columns and simhash.groups(d).count() == len(ROWS)
    assert decontam.decontaminate(d, spark.createDataFrame([(1, "brown fox")], "item_id long, text string")).columns == d.columns
