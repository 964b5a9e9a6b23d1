"""License scan, LM scoring, SentencePiece, HTML extraction, top-k search and toxicity against brute force or held-out rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loamline.llm import language_model, licenses, pieces, queries, topk, toxicity, wrappers

SMALL = "/root/testdata/sf0.001"


# -- license scan


def test_phrases_and_templates(make_docs):
    rows = {
        1: "x Under the MIT\nLicense, y. under-the-mit-license", 2: "Apache License Version 2", 3: "cc by ncx cc by nc", 4: None, 5: "",
        6: "Permission is hereby granted, free of charge, to any person obtaining copy of this software", 7: "pré under the mit licenseé", 8: "permission granted free",
    }
    got = {r["doc_id"]: r for r in licenses.scan(make_docs([(i, t, "a") for i, t in rows.items()])).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (10, 2, 1, 6, "mit")
    assert got[2]["base_labels"] == "apache-2" and got[2]["score"] == 1.0
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["base_labels"]) == (1, 3, "cc-by-nc")
    assert (got[4]["n_words"], got[4]["first_word"], got[4]["labels"], got[4]["score"]) == (0, None, "", 0.0) and got[5]["n_words"] == 0
    assert got[6]["base_labels"] == "" and got[6]["labels"] == "mit" and 0.8 <= got[6]["score"] < 1
    assert got[7]["n_base"] == 0 and got[8]["labels"] == ""


# -- language model


def lm_brute(rows, backoff=0.4):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for _, t in rows]
    one, two = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws[:-1], ws[1:], strict=True))
    total, out = sum(map(len, words)), []
    for (i, _), ws in zip(rows, words, strict=True):
        own1, own2 = Counter(ws), Counter(zip(ws[:-1], ws[1:], strict=True))
        n, s, seen = max(total - len(ws), 1), 0.0, 0
        for k, w in enumerate(ws):
            pair = (ws[k - 1], w)
            if k and two[pair] - own2[pair] > 0:
                seen += 1
                s += math.log((two[pair] - own2[pair]) / (one[pair[0]] - own1[pair[0]]))
            else:
                s += math.log(max(one[w] - own1[w], 1) / n) + (math.log(backoff) if k else 0)
        out.append((i, len(ws), seen, round(s, 5)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", [300, 6_000_000])
def test_language_model(odd_docs, make_docs, batch):
    for df in (odd_docs, make_docs([]), make_docs([(1, "a b a b", "x"), (2, "a b c", "x"), (3, "B c", "x")])):
        got = sorted(((r["doc_id"], r["n_words"], r["n_seen"], round(r["log_score"], 5)) for r in language_model.score(df, batch_bytes=batch).collect()), key=repr)
        assert got == lm_brute([(r["doc_id"], r["text"]) for r in df.collect()])


# -- sentencepiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def odd_texts():
    rng = random.Random(3)
    some = ["", " ", "   ", "\n", "Hello  world\n", "▁x ▁▁ y", "你好 мир 🙂👨‍👩‍👧", "<s> </s> <unk> <0x41>", "a" * 300, "ab" * 3000, " " * 37 + "x", "é́ ñ", "\x00a", "�", "日本" * 40]
    return some + ["".join(rng.choice("abcdefgh ▁éß\n你🙂.,<>0123  the") for _ in range(rng.randint(0, 120))) for _ in range(300)]


def test_encoding_and_decoding_equal_the_library(library):
    v = pieces.vocabulary(queries.piece_model())
    for t in odd_texts():
        ids = library.encode(t)
        assert v.encode(t) == ids and v.decode(ids) == library.decode(ids)
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 9))]
        assert v.decode(ids) == library.decode(ids)


def test_the_matrix_and_the_heap_agree():
    v = pieces.vocabulary(queries.piece_model())
    parts = [p for t in odd_texts() for p in v.split(t) if len(p) <= pieces.ROW]
    assert v._rows(parts) == [v._agenda(p) for p in parts]


def test_encoded_documents(odd_docs, make_docs, library):
    got = sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in pieces.encode(odd_docs, queries.piece_model()).collect()), key=repr)
    want = sorted(((r["doc_id"], library.encode(r["text"] or ""), library.decode(library.encode(r["text"] or ""))) for r in odd_docs.collect()), key=repr)
    assert got == want
    digests = pieces.encode_digests(odd_docs, queries.piece_model()).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in digests if r["doc_id"]) == sorted((i, len(x)) for i, x, _ in want if i)
    assert pieces.encode(make_docs([]), queries.piece_model()).count() == 0


# -- html


PAGE = (
    "<!DOCTYPE html><html><head><title>T {n}</title><script>var t='</p>';</script></head><body><header>Site</header><nav><ul>{menu}</ul></nav><div class='ad'>Buy {n}</div>"
    "<div class='cookie-notice'>Cookies</div><article><header><h1>Head {n}</h1></header><p><b>First &amp; {n}<br><p>Second\n  line</p>{more}<section class='comments'><p>Nice {n}</p></section>"
    "<form>Sign up</form></article><aside>Related {n}</aside><footer>&copy; {n}</footer></body></html>"
)


def test_where_the_library_differs_it_is_right(library, make_docs):
    pa = pieces.pa

    class Wrong(pieces.Encoder):
        def run(self, texts):
            for ids, decoded in super().run(texts):
                yield ids + (",5" if "x" in decoded else ""), decoded

    texts = [f"some words {i}" + " x" * (i % 3 == 0) for i in range(200)] + [None, "the longest of them all " * 9 + "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    run = pieces._batches(queries.piece_model(), [], lambda ids, decoded: (ids, decoded), [pa.string()] * 2, ["ids", "decoded"])
    whole = pieces.Encoder
    try:
        pieces.Encoder = Wrong
        got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    finally:
        pieces.Encoder = whole
    for t, r in zip(texts, got, strict=True):
        ids = library.encode(t or "")
        assert r == {"ids": ",".join(map(str, ids)), "decoded": library.decode(ids)}


def page(n, more=""):
    return PAGE.format(n=n, menu="".join(f"<li><a href='/{k}'>m{k}{n}</a></li>" for k in range(n + 2)), more=more)


def test_main_text(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", page(i, "<p>More</p>" * (i % 3))) for i in range(12)]
    rows += [(50, None, None), (51, "x", ""), (None, "https://h0.example/n", page(7)), (52, "https://h9.example/", "<p>only &lt;this&gt;")]
    got = {r["page_id"]: r for r in wrappers.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        want = " ".join([f"Head {i}", f"First & {i}", "Second line", *["More"] * (i % 3)])
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    assert got[50]["text"] == "" and got[51]["text"] == "" and got[None]["text"].startswith("Head 7") and got[52]["text"] == "only <this>"


def test_a_page_without_an_article():
    pages = [f"<body><div class=menu><a href=/>Home</a></div><div class=body><p>Text {n} {'word ' * 30}</p><p>Same line</p></div><div>Imprint</div></body>" for n in range(4)]
    wrapper = wrappers.infer(pages)
    place = wrappers.locate(wrapper, 4)
    assert place.path == ["body", "div.body"] and wrappers.extract(pages[1], place).startswith("Text 1 word")


def test_texts_of_one_sampled_page_are_not_the_template():
    def build(*parts):
        return f"<body><div class=menu>Home</div><div class=body>{''.join(parts)}</div></body>"

    a = build("<h1>Title A</h1>", *[f"<p>first {n} of A</p>" for n in range(2)])
    b = build("<h1>Title B</h1>", "<p>first of B</p><p>second of B</p>", "<blockquote>" + "Quote of B " * 20 + "</blockquote>", "<p>Last words of B</p>")
    text = wrappers.extract(b, wrappers.locate(wrappers.infer([a, b]), 2))
    assert "Quote of B" in text and text.endswith("Last words of B")


def test_long_bodies_are_aligned_to_their_end():
    def build(name, n, more=""):
        return f"<body><div class=body>{more}{''.join(f'<p class=k{i}>text {i} of {name}</p>' for i in range(n))}<p class=same>Same line</p></div></body>"

    a, b = build("A", 950), build("B", 950, "<h2>Only B</h2>")
    place = wrappers.locate(wrappers.infer([a, b]), 2)
    text = wrappers.extract(b, place)
    assert place.template == ["Same line"] and text.startswith("Only B") and text.endswith("text 949 of B")


def test_sections_of_an_article_stay_whatever_their_names_share(spark):
    kept = ["related-work", "search-algorithm", "social-history", "login-flow-explained", "menu-planning"]
    gone = ["related", "related-posts", "cookie-banner", "comment-list", "share-buttons", "ad ad-box", "newsletter"]
    inner = "".join(f"<div class='{c}'>Text {c}.</div>" for c in [*kept, *gone])
    html = f"<html><body><nav>Home</nav><article><h1>T</h1><p>Keep one.</p>{inner}</article></body></html>"
    df = spark.createDataFrame([(1, "https://a.example/x", html), (2, "https://a.example/empty", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()}
    assert got == {1: "T Keep one. " + " ".join(f"Text {c}." for c in kept), 2: ""}
    assert wrappers.extract_pages(df.where("page_id < 0")).count() == 0
    clash = df.selectExpr("*", "'x' as text", "1 as n_chars", "'h' as host")
    assert {r["page_id"]: r["text"] for r in wrappers.extract_pages(clash).collect()} == got


@pytest.mark.parametrize("few", [32, 2])
def test_all_pages_of_a_host_tell_what_is_template(spark, monkeypatch, few):
    """One page of sixty lacks a line, so that it is no template's; sixty tasks, wrappers aligned in one level or in several."""
    monkeypatch.setattr(wrappers, "FEW", few)
    html = [f"<body><div class=menu>Home</div><div class=body><p>Text {n} {f'word{n} ' * 30}</p><h3>Always</h3>{'<h2>Mostly</h2>' * (n != 41)}</div></body>" for n in range(60)]
    df = spark.createDataFrame([(n, f"https://a.example/{n}", h) for n, h in enumerate(html)], "page_id long, url string, html string").repartition(60, "page_id")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()}
    for n in range(60):
        assert got[n].startswith(f"Text {n} ") and "Always" not in got[n] and got[n].endswith("Mostly") == (n != 41)


def test_wrappers_are_union_free_expressions():
    wrapper = wrappers.infer([page(1), page(2, "<p>x</p><table><tr><td>1</td></tr></table>"), page(0)])
    text = wrapper.expression()
    assert "(<li>" in text and ")+" in text and ")?" in text and "#slot" in text and "|" not in text


# -- top k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 16)).astype(np.float32)
    v[100:140] = v[100]
    rows = [(int(i), [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(600, None), (620, []), (640, [float("nan")] * 16), (660, [None] * 16), (680, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, k=7).collect())
    ints = np.floor(64 * v.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 500, 20):
        scores = ints @ ints[q]
        best = sorted((int(-s), i) for i, s in enumerate(scores) if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.where("vec_id < 0")).count() == 0
    clash = df.selectExpr("vec_id", "embedding", "'x' as score", "0 as rank", "'q' as query_id", "1 as c", "2 as side")
    assert sorted(tuple(r) for r in topk.top_k(clash, k=7).collect()) == sorted(want)
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), k=7).collect()
    assert [(r["rank"], r["query_id"]) for r in few] == [(1, 0), (2, 0)]


def test_levels_leave_fewer_pairs(spark):
    rng = np.random.default_rng(1)
    centers = np.repeat(rng.normal(size=(20, 16)) * 200, 4, axis=1)
    c = (centers[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64)) * 10).astype(np.int64)
    left = topk.search(np.arange(10) - 10, c[:10], np.arange(3000), c, 5)[3]
    assert left == sorted(left, reverse=True) and left[-1] < 0.05 * 10 * 3000
    rows = topk._valid(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 64.0).collect()
    c, ids = np.array([r["vector"] for r in rows]), np.array([r["vec_id"] for r in rows])
    asked = ids % 20 == 0
    left = topk.search(ids[asked], c[asked], ids, c, 20)[3]
    assert left == sorted(left, reverse=True) and left[-1] < 0.25 * asked.sum() * len(ids), left


@pytest.mark.parametrize("size", [1, 2, 3, 64])
@pytest.mark.parametrize("top", [3, 2**20, 2**40])
def test_search_of_any_size(size, top):
    rng = np.random.default_rng(size)
    c = rng.integers(-top, top, (200, size))
    i, j, scores, _ = topk.search(np.arange(5), c[:5], np.arange(200), c, 3)
    for n in range(5):
        every = sorted((-sum(int(a) * int(b) for a, b in zip(c[n], c[m], strict=True)), m) for m in range(200) if m != n)[:3]
        assert [(-int(s), int(m)) for m, s in zip(j[i == n], scores[i == n], strict=True)] == every


# -- toxicity


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(documents, toxicity.train(documents, labels)).join(labels, "doc_id").toPandas()
    out = scored[scored["held_out"]]
    assert (out["predicted"] == out["toxic"]).mean() > 0.9
    assert scored["score"].between(0, 1).all()


def toxic_rows():
    rng = random.Random(8)
    groups = ["muslims", "christians", "jews", "hindus"]
    rows = []
    for i in range(900):
        words = [rng.choice(["talk", "walk", "paper", "river", "stone", "cloud", "music"]) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic:
            words += [rng.choice(["idiot", "moron"])]
        # one group is named far more often in toxic texts
        words += ["muslims"] if toxic and rng.random() < 0.7 else [rng.choice(groups)]
        rng.shuffle(words)
        rows.append((" ".join(words), int(toxic)))
    return rows


def fitted(swap, monkeypatch):
    monkeypatch.setattr(toxicity, "SWAP", swap)
    rows = toxic_rows()
    features = sorted({f for t, _ in rows for f in toxicity.text_features(t)})
    x = np.array([[f in toxicity.text_features(t) for f in features] for t, _ in rows], dtype=float)
    return toxicity.fit(x, np.array([y for _, y in rows], dtype=float), features, 800)


def test_swaps_of_groups_hardly_change_the_score(monkeypatch):
    gap = lambda m: abs(m.score("river muslims stone") - m.score("river hindus stone"))
    with_swaps, without = fitted(20.0, monkeypatch), fitted(0.0, monkeypatch)
    assert gap(with_swaps) < gap(without) and gap(with_swaps) < 0.02
    assert with_swaps.score("you moron") > 0.5 > with_swaps.score("muslims and music")


def test_odd_labels(spark, odd_docs, make_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), (6, 7), (9, 0)], "doc_id long, toxic int")
    got = toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    empty = toxicity.train(odd_docs, labels.where("doc_id < 0"))
    assert toxicity.score(make_docs([]), empty).count() == 0 and empty.score(None) == pytest.approx(0.5)


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    places = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
    blocks = [set(words[i : i + licenses.BLOCK]) for i in range(0, len(words), licenses.STRIDE)]
    held = {t: max((len(b & set(t.split())) / len(set(t.split())) for b in blocks), default=0.0) for t in licenses.TEMPLATES}
    held = {t: h for t, h in held.items() if h >= licenses.THRESHOLD - 1e-9}
    base = {licenses.PHRASES[p] for p, at in places.items() if at}
    every = sorted(i for at in places.values() for i in at)
    labels = base | {licenses.TEMPLATES[t] for t in held}
    score = 1.0 if every else max(held.values(), default=0.0)
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_license_scan_equals_brute_force(odd_docs, make_docs):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    pool = [*licenses.PHRASES, *licenses.TEMPLATES]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(pool).split()
            for _ in range(rng.randrange(0, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["the", "x", "license", "of"]))
            parts += words + ["filler"] * rng.randrange(0, 90)
        rows.append((100 + i, rng.choice(["", "  ", "-- "]) + rng.choice([" ", ", "]).join(parts).title() + rng.choice(["", ".", " \n"])))
    long = "word " * 30_000 + "Under THE MIT-license. " + "word " * 30_000 + "cc by nc"
    rows += [(500, long), (500, long), (501, "cc by nc cc by nc"), (502, "1 Apache license, version 2.0"), (None, "under the mit license")]
    docs = make_docs([(i, t, "a") for i, t in rows])
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=repr)
    assert got == sorted(((i, *license_brute(t)) for i, t in rows), key=repr)
    assert licenses.scan(make_docs([])).count() == 0
