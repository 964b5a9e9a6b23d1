"""Exact dedup, n-gram join, sharding and mixing against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import exact_dedup, mixing, ngram_join, queries, sharding
from loamline.llm.components import components

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        best = min(groups[normal(t)])
        out.append((i, best[2], len(groups[normal(t)]), i == best[2] and len(t or "") == -best[0], hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def exact_rows(df, **parameters):
    got = exact_dedup.exact_groups(df, **parameters)
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block", [1500, 4096])
def test_exact_groups(spark, odd_docs, block):
    for df in (odd_docs, documents(spark)) if block == 4096 else (odd_docs,):
        assert exact_rows(df, block_chars=block) == exact_brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_exact_groups_when_fingerprints_meet(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = exact_rows(odd_docs, block_chars=9000, fingerprint=lambda c: F.length(c).cast("long") % 3)
    assert got == exact_brute(rows)


def test_dedup_leaves_one_of_each_text(odd_docs):
    kept = [r["text"] for r in exact_dedup.dedup(odd_docs).collect()]
    assert sorted(map(normal, kept)) == sorted({normal(r["text"]) for r in odd_docs.collect()})


def shingle_sets(rows, words):
    out = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        out.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def near_brute(rows, words, percent):
    sets = shingle_sets(rows, words)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    usable = [i for i in range(len(rows)) if sets[i] and rows[i][0] is not None]
    for x in usable:
        for y in usable:
            if x < y:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    parent[root(x)] = root(y)
    least = defaultdict(lambda: math.inf)
    for i in usable:
        least[root(i)] = min(least[root(i)], rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), least[root(i)] if i in usable else rows[i][0]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_near_components(spark, odd_docs, words, percent):
    for df in (odd_docs, documents(spark)) if words == 3 else (odd_docs,):
        got = sorted((tuple(r) for r in ngram_join.near_components(df, words, percent).collect()), key=repr)
        assert got == near_brute([(r["doc_id"], r["text"]) for r in df.collect()], words, percent)


def variants(seed, n, size=60, most=14):
    """Texts with up to ``most`` words of one text changed: some linked to it, some to one another, some to none."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(size, rng.integers(0, most), replace=False):
            words[at] = f"v{rng.integers(0, 40)}"
        rows.append((int(i), " ".join(words)))
    return rows


@pytest.mark.parametrize("percent", [80, 90])
def test_a_large_group_of_variants_is_joined_exactly(make_docs, percent, monkeypatch):
    rows = variants(percent, 260)
    monkeypatch.setattr(ngram_join, "LEAF", 12)
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    got = ngram_join.near_components(make_docs([(i, t, "a") for i, t in rows]), 1, percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == near_brute(rows, 1, percent)


def test_linked_sets_show_a_slot_in_common():
    rng = np.random.default_rng(5)
    for n in (*range(1, 40), 63, 64, 70, 127, 200, 255, 260, 1500):
        for percent in (80, 90):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            for lost in range(n * (100 - percent) // 100 + 1):
                new = rng.integers(0, 2**63, rng.integers(0, n * (100 - percent) // percent + 1), dtype=np.uint64)
                y = np.concatenate([x[lost:], new])
                if 100 * (n - lost) >= percent * (n + len(new)) and (lost or len(new)):
                    sets = np.concatenate([np.sort(x), np.sort(y)])
                    firsts = np.array([0, n, len(sets)])
                    keys, row = ngram_join.signatures(sets, firsts, percent)
                    assert set(keys[row == 0]) & set(keys[row == 1]), (n, percent, lost, len(new))
                    keys, row = ngram_join.signatures(sets, firsts, percent, np.unique(keys[rng.random(len(keys)) < 0.3]))
                    assert set(keys[row == 0]) & set(keys[row == 1]), (n, percent, lost, len(new))


def test_signatures_are_few():
    sets = np.sort(np.random.default_rng(6).integers(0, 2**63, 3000, dtype=np.uint64))
    for percent, most in ((80, 1600), (90, 800)):
        assert len(ngram_join.signatures(sets, np.array([0, 3000, 3000]), percent)[0]) < most


def test_sketches_bound_differences():
    rng = np.random.default_rng(8)
    x = np.sort(rng.integers(0, 2**63, 700, dtype=np.uint64))
    y = np.sort(np.concatenate([x[90:], rng.integers(0, 2**63, 40, dtype=np.uint64)]))
    bits = ngram_join.sketches(np.concatenate([x, y, x[:3]]), np.array([0, 700, 1350, 1350, 1353]))
    a, b, none, small = (np.frombuffer(v, np.uint64) for v in bits)
    assert len(none) == len(small) == 1 and not none.any() and np.bitwise_count(small).sum() == 3
    for width in (len(a), len(a) // 2, 1):
        assert np.bitwise_count(ngram_join.folded(a, width) ^ ngram_join.folded(b, width)).sum() <= 130
    assert np.bitwise_count(a ^ b).sum() > 100


def test_words_that_differ_have_different_hashes():
    import pyarrow as pa

    def thue(n):
        a, b = "a", "b"
        for _ in range(n):
            a, b = a + b, b + a
        return [a, b]

    texts = [*thue(10), *thue(5), *thue(4), "x" * 64, "x" * 65, "x" * 8, "x" * 9, "xxxxxxxx\0", "日本語日本語", "日本語日本"]
    hashed, firsts = ngram_join.vectors.words(pa.array(texts))
    assert firsts.tolist() == list(range(len(texts) + 1)) and len(set(hashed.tolist())) == len(texts)
    again, _ = ngram_join.vectors.words(pa.array(["q " + t.upper() if t.isascii() else t for t in texts]))
    assert set(hashed.tolist()) <= set(again.tolist())


def test_texts_of_long_words_are_not_linked(make_docs):
    a, b = "0", "1"
    for _ in range(10):
        a, b = a + b, b + a
    got = ngram_join.near_components(make_docs([(1, a, "s"), (2, b, "s")]), 3, 90).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2)]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert set(got[i] for i in range(201)) == {0} and got[501] == 500


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_search(spark, seed):
    rng = np.random.default_rng(seed)
    links = [(int(a), int(b)) for a, b in rng.integers(-90, 90, (110, 2))] + [(200 + seed, k) for k in range(300, 340)]
    want = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    odd = [(7, 7), (None, 3), (5, None), links[0]]
    got = components(spark.createDataFrame(links + odd, "a long, b long")).collect()
    assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want
    assert components(spark.createDataFrame(odd[:3], "a long, b long")).count() == 0


def test_leave_one(odd_docs, make_docs):
    kept = [r["doc_id"] for r in ngram_join.leave_one(odd_docs).collect()]
    assert sorted(kept, key=repr) == sorted([1, 3, 4, 5, 6, 8, 10, None, None], key=repr)
    text, near = " ".join(f"t{i}" for i in range(80)), " ".join(f"t{i}" for i in range(79))
    rows = [(1, text, "a"), (2, near, "a"), (2, "another text of its own", "a"), (1, text, "a"), (3, "alone", "b"), (3, "alone", "a")]
    got = sorted((r["doc_id"], r["text"], r["source"]) for r in ngram_join.leave_one(make_docs(rows)).collect())
    assert got == [(1, text, "a"), (2, "another text of its own", "a"), (3, "alone", "a")]


def test_sharding(odd_docs, spark):
    for df in (odd_docs, documents(spark)):
        source = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        got = sharding.shard_documents(df).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == source
        slots, shard_of = defaultdict(list), defaultdict(set)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            shard_of[r["doc_id"]].add((r["shard"], r["grown_shard"]))
            assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in shard_of.values())


def test_weighted_shards_get_their_share(spark):
    df = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s"))
    assert abs(df.where("s = 1").count() / 20_000 - 0.75) < 0.02


def water_level(sizes, weights, share, most):
    total, caps = sum(sizes) * share, [s * most for s in sizes]
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(caps[i] for i in capped)
        got = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if got[i] > caps[i]]
        if not over:
            return [caps[i] if i in capped else got[i] for i in range(len(sizes))]
        capped |= set(over)


def test_targets(spark):
    sizes = {"sa": 100, "sb": 5000, "sc": 10, "n": 700, "sd": 0, "sB": 900}
    got = {r["skey"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "skey string, source_size long"), [3.0, 1.0, 2.0], 1.5, 2).collect()}
    names = ["sB", "sa", "sb", "sc", "sd", "n"]
    want = water_level([sizes[n] for n in names], [3, 1, 2, 3, 1, 2], 1.5, 2)
    assert [got[n] for n in names] == pytest.approx(want)


def quotients(votes, seats, caps):
    won = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] > 0 and won[i] < caps[i]]
        if not open_:
            break
        won[max(open_, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    rng = np.random.default_rng(seed)
    votes = [float(v) for v in rng.integers(0, 2000, 23)]
    caps = [int(v) for v in np.ceil(np.array(votes) / 8) + rng.integers(0, 3, 23)]
    seats = int(sum(votes) / 16)
    df = spark.createDataFrame([(1, i, v, c, seats) for i, (v, c) in enumerate(zip(votes, caps, strict=True))], "g int, k int, v double, cap long, seats long")
    got = [r["won"] for r in mixing.sainte_lague(df, ["g"], "k", "v", "seats", "cap").orderBy("k").collect()]
    assert got == quotients(votes, seats, caps)


def test_mixing(spark, odd_docs):
    for df in (odd_docs, documents(spark)):
        got = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(7)).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.collect())
        taken, target, size = Counter(), {}, Counter()
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
            size[r["source"]] += r["size"]
            target[r["source"]] = r["target"]
        for s in target:
            assert abs(taken[s] - target[s]) <= 64 + 0.01 * target[s]
            assert target[s] <= 2 * size[s] + 1e-6


def test_mixed_documents_are_whole_rows(odd_docs):
    out = mixing.mixed_documents(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.where("text is null or trim(text) = ''").count() == 0 and out.count() > 0


@pytest.mark.parametrize("share", [0.4, 0.8, 1.5])
def test_mixed_documents_add_up_to_the_targets(make_docs, share):
    # source a is hot and its documents are of many blocks; b has very long ones, c one length only
    sizes = {"a": [300 + 37 * i % 900 for i in range(900)], "b": [60_000, 55_000, 52_000, *[20 * i for i in range(1, 60)]], "c": [640] * 150}
    rows = [(s, n) for s, ns in sizes.items() for n in ns]
    docs = make_docs([(i, f"d{i} " + "w " * (n - 1), s) for i, (s, n) in enumerate(rows)])
    got, copies = Counter(), Counter(r["doc_id"] for r in mixing.mixed_documents(docs, share=share).select("doc_id").collect())
    for i, n in copies.items():
        got[rows[i][0]] += n * rows[i][1]
    target, per_doc = {}, {}
    for r in mixing.mix(docs, share=share).collect():
        target[r["source"]] = r["target"]
        per_doc[r["doc_id"]] = r["taken"] / r["size"]
    for s in sizes:
        assert abs(got[s] - target[s]) <= 64 + 0.01 * target[s] + (320 if s == "c" else 0), (s, got[s], target[s])
    assert all(abs(copies[i] - x) < 1 for i, x in per_doc.items())


def test_empty_tables(make_docs):
    none = make_docs([])
    assert exact_dedup.exact_groups(none).count() == 0
    assert ngram_join.near_components(none).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    import compare

    assert compare.difference(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLES[name]) == ""
