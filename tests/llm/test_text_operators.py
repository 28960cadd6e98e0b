"""Language ID, packing, piece sampling, HTML extraction and URL filters."""

import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verisift.llm import html_extraction, language_id, packing, sampled_pieces, url_filters
from verisift.llm.common import tokenizer_path

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, ids string, n long"
ODD = [None, "", "  \n", "123 !?", "İstanbul ǅ é́ <|endoftext|> don't", "日本語 ▁x", "x" * 4000, "a\u0085b\x1cc", "Ünïcödé " * 900]


def odd(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, None, "s", "i", 1) for i, t in enumerate(ODD)] + [(4, ODD[4], None, "s", "i", 1)], DOCS)


def test_language_id_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98
    assert np.mean([r["accepted"] for r in out]) >= 0.97 and all(0 <= r["score"] <= 1 for r in out)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.predict(odd(spark), model, keep=("doc_id", "text")).collect()
    assert all((r["lang_pred"] == "und") == (not language_id.has_letter(r["text"])) for r in found) and len(found) == len(ODD) + 1
    none = odd(spark).filter("false")
    assert language_id.digest(none).count() == 0
    assert language_id.accepted_only(odd(spark)).count() == 0  # nothing to learn from
    assert language_id.accepted_only(docs).columns == docs.columns


def test_unseen_languages_and_random_letters_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("length(text) > 100 AND lang IS NOT NULL").limit(4000).cache()
    draw = np.random.default_rng(3)
    random = [" ".join("".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(2, 10))) for _ in range(n)) for n in (20, 40, 80, 160, 400) for _ in range(40)]
    for unseen in ("de", "fr"):
        model = language_id.fit(docs.filter((docs["lang"] != unseen) & ~language_id.held_out()))
        texts = [r["text"] for r in docs.filter(docs["lang"] == unseen).select("text").limit(400).collect()]
        assert np.mean(language_id.judged(texts, model)[2]) < 0.1
        assert np.mean(language_id.judged(random, model)[2]) < 0.1
    docs.unpersist()


def test_nearest_centroid_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    texts = [r["text"] for r in docs.collect()]
    langs, scores, _ = language_id.judged(texts, model)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        if not language_id.has_letter(text):
            assert (lang, score) == ("und", 0.0)
            continue
        v = np.log1p(language_id.counts([text])[0]) * model.idf
        near = [float(v @ c) / float(np.linalg.norm(v)) for c in model.centres]
        assert abs(score - max(near)) < 1e-4 and near[model.langs.index(lang)] > max(near) - 1e-4 or near[len(model.langs) - 1 - model.langs[::-1].index(lang)] > max(near) - 1e-4


def test_null_and_repeated_ids_in_number(spark):
    docs = spark.createDataFrame([(None, "some words here", "en"), (None, "some words here", "en"), (5, "other words", "en"), (5, "other words", "en"), (6, None, None)], "doc_id long, text string, lang string")
    out = language_id.digest(docs).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in out) == [(0, "en"), (0, "en"), (5, "en"), (5, "en"), (6, "und")] and not any(r["held_out"] for r in out if r["doc_id"] is None)


def test_long_texts_give_the_same_vector(monkeypatch):
    text = "Some words, again and again. " * 200
    whole = language_id.counts([text])
    monkeypatch.setattr(language_id, "BATCH_CHARS", 501)
    assert np.abs(language_id.counts([text]) - whole).sum() < 0.01 * whole.sum()


def test_packing_is_exact_and_unpadded(spark):
    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {10**6 + i: t for i, t in enumerate(ODD)}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts.items():
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == pieces[0]["tier"] <= 2048 and at & (at - 1) == 0
    steps = defaultdict(set)
    for r in rows:
        steps[r["step_id"]].add((r["sequence_id"], r["tier"]))
    assert all(len({t for _, t in s}) == 1 and sum(t for _, t in s) <= packing.STEP_TOKENS for s in steps.values())
    assert packing.pack(odd(spark).filter("false"), path).count() == 0
    assert packing.pack(odd(spark), path).filter("doc_id IS NULL AND start = 0").count() == 1


def test_chunks_of_long_texts(monkeypatch):
    text = "Some words, don't <|x; ÀÉ " * 300
    tokens = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    whole = tokens.encode([text])
    monkeypatch.setattr(packing, "CHUNK_CHARS", 100)
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    assert tokens.encode([text, ""]) == [*whole, b""]


PIECES = tokenizer_path("piece_bpe_32k.model")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\0\naé")), max_size=60), st.integers(-(2**63), 2**63 - 1))
def test_sampled_pieces_are_lossless(text, key):
    lattices = sampled_pieces.lattices_of(PIECES)
    ids = lattices.encode([key], [text])[0]
    assert lattices.decode(ids.tolist()) == text


def test_samples_follow_the_lattice_distribution():
    lattices = sampled_pieces.lattices_of(PIECES)
    names, ways = {lattices.raw[i].decode("utf-8", "replace"): i for i in range(259, len(lattices.raw))}, {}

    def paths(rest, done, weight):
        if not rest:
            ways[done] = weight
        for n in range(1, len(rest) + 1):
            if rest[:n] in names:
                paths(rest[n:], (*done, names[rest[:n]]), weight * lattices.weight[names[rest[:n]]])

    paths(" then", (), 1.0)
    n = 20_000
    drawn = [tuple(i.tolist()) for i in lattices.encode(list(range(n)), ["then"] * n)]
    total = sum(ways.values())
    assert set(drawn) <= set(ways)
    for way, weight in ways.items():
        p = weight / total
        assert abs(drawn.count(way) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_samples_are_reproducible(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    a = {r["doc_id"]: r for r in sampled_pieces.encode(docs, PIECES).collect()}
    b = {r["doc_id"]: r for r in sampled_pieces.encode(docs.repartition(7), PIECES).collect()}
    assert a == b and all(r["lossless"] for r in a.values())
    lattices = sampled_pieces.lattices_of(PIECES)
    monkeypatch.setattr(sampled_pieces, "CACHE_WORDS", 5)
    rows = docs.collect()
    for r in rows[:6]:
        assert lattices.encode([r["doc_id"]], [r["text"]])[0].tolist() == a[r["doc_id"]]["ids"]
    nul = "a\0b \0\0 c"
    once = lattices.encode([9], [nul])[0].tolist()
    lattices.encode([1], ["many other words that clear what is kept"])
    assert lattices.encode([9], [nul])[0].tolist() == once and lattices.decode(once) == nul and lattices.lossless([np.array(once)], [nul]) == [True]
    out = sampled_pieces.encode(odd(spark), PIECES)
    assert [r["text"] for r in sampled_pieces.decode(out, PIECES).collect()] == [r["text"] for r in odd(spark).collect()]
    assert sampled_pieces.encode(odd(spark).filter("false"), PIECES).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><p>Site head</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="box-x"><p>{common}</p></div>
<div class="ad banner">Buy!</div><article><h1>A &amp; B</h1><p><b>First  {n}<br>line</b><p>Second&nbsp;one<ul><li>x<li>y</ul>
<aside>side</aside><form><label>q</label></form><!-- no --><p>&lt;i&gt; &eacute;</article>
<section id="comments"><p>reader</p></section><footer>&copy;</footer></body></html>"""


def test_extraction(spark):
    pages = [(i, f"http://h.com/{i}", PAGE.format(n=i, common="We are the same everywhere")) for i in range(12)]
    pages += [(50, "http://h.com/p", "<p>only</p><div>We <i>are</i></div>"), (51, None, None), (52, "x", ""), (53, "http://q.com", "<p>a<p>b < c &amp; d</div> <b>e")]
    pages += [pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'k' AS keys", "1 AS page")
    out = html_extraction.digest(df)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.count() == len(pages)
    assert got[3] == "A & B\nFirst 3 line\nSecond one\nx\ny\n<i> é"
    assert got[50] == "only\nWe are" and got[51] == got[52] == "" and got[53] == "a\nb < c & d e"
    assert html_extraction.digest(df.filter("false")).count() == 0


def test_templates_are_deleted_by_frequency(spark):
    body = "<html><body><div><p>Shared box</p></div><div><p>Own {}</p></div></body></html>"
    pages = [(i, f"http://h.com/{i}", body.format(i)) for i in range(20)] + [(99, "http://other.com/", body.format(99))]
    got = {r["page_id"]: r["text"] for r in html_extraction.digest(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[4] == "Own 4" and got[99] == "Shared box\nOwn 99"


def test_copies_of_a_page_keep_their_text(spark):
    page = "<html><body><article><p>Let <math><mi>x</mi></math> be</p><div><p>More of it</p></div></article></body></html>"
    pages = [(1, "http://h.com/1", page)] * 6 + [(i, f"http://h.com/{i}", page) for i in range(2, 8)] + [(9, "http://h.com/9", "<article><p>Else</p></article>")]
    out = html_extraction.digest(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(out) == len(pages) and all(r["text"] == ("Else" if r["page_id"] == 9 else "Let x be\nMore of it") for r in out)


def test_subtree_counts_against_brute_force(spark):
    """A subtree is deleted where enough of its host's distinct pages have it, and only there."""
    box = lambda i, j: f"<div><p>Box {j}</p></div>" if (i * 7 + j) % 3 == 0 else ""
    pages = [(i, f"http://h{i % 2}.com/{i}", f"<body>{''.join(box(i, j) for j in range(4))}<p>Own {i}</p></body>") for i in range(40)]
    pages = [p for p in pages if p[0] % 2 == 0 or p[0] < 9]
    held = defaultdict(set)
    for i, _, _ in pages:
        for j in range(4):
            if box(i, j):
                held[i % 2, j].add(i)
    hosts = defaultdict(int)
    for i, _, _ in pages:
        hosts[i % 2] += 1
    gone = {k for k, v in held.items() if len(v) >= html_extraction.MIN_PAGES and len(v) >= html_extraction.MIN_SHARE * hosts[k[0]]}
    assert gone and len(gone) < len(held)
    got = {r["page_id"]: r["text"] for r in html_extraction.digest(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, _ in pages:
        assert got[i] == "\n".join([f"Box {j}" for j in range(4) if box(i, j) and (i % 2, j) not in gone] + [f"Own {i}"])


def test_only_names_of_attributes_drop():
    text = lambda page: html_extraction.blocks(html_extraction.parse(page), set())
    page = """<body><article><p title="the hidden cost">one</p><div data-caption="a hidden gem">two</div><section title='x id=comments y'>three</section>
        <div data-x = 'class="ad"' class=ad>gone</div><div title="a > b" CLASS = "Sidebar x">gone</div><p aria-hidden="false">four</p><p hidden>gone</p><p alt=""'' id="p4">five</p></article></body>"""
    assert " ".join(text(page)).split() == ["one", "two", "three", "four", "five"]


@pytest.mark.parametrize("part", ['<a "', "<a '", '<a x="', "<a b", "<", "</b>", "<!", "<div></b>", "<p><b>", "<b><div></div>", '<a "> '])
def test_broken_pages_take_linear_time(part):
    page = "<article><p>first</p>" + part * (1_000_000 // len(part))
    began = time.process_time()
    root = html_extraction.parse(page)
    assert time.process_time() - began < 8
    assert root.children[0].tag == "article"


def test_text_behind_an_unclosed_quote_is_kept():
    page = '<article><p title="x>first</p><p>second</p></article>'
    assert "second" in " ".join(html_extraction.blocks(html_extraction.parse(page), set()))


def test_names_drop_no_main_text():
    text = lambda page: html_extraction.blocks(html_extraction.parse(page), set())
    main = '<article class="post comment-open"><p>One two</p><p class="alert">Three</p><section id="related-work"><p>Four</p></section></article>'
    for page in (
        f'<body class="single no-sidebar">{main}</body>', f'<body class="sidebar">{main}</body>', f'<div class="layout with-sidebar">{main}</div>',
        f'<main class="search">{main}</main>', f'<div class="sidebar">{main}</div><div class="sidebar">Side</div>',
    ):
        assert text(page) == ["One two", "Three", "Four"], page
    assert text('<body><div class="menu"><p>Most of the words of this page</p></div><p>few</p></body>') == ["Most of the words of this page", "few"]
    assert text('<article><p>Text of it</p><div class="x ad">Buy</div><section id="comments">c</section></article>') == ["Text of it"]


def test_copies_keep_their_text(spark):
    page = "<html><body><article><h1>{}</h1><div class='body'><p>The text of this article</p></div></article></body></html>"
    bare = "<html><body><div><p>The text of a page without article</p></div></body></html>"
    pages = [(i, f"http://h.com/{i}", page.format("Same")) for i in range(6)]
    pages += [(10 + i, f"http://near.com/{i}", page.format(f"No {i}")) for i in range(6)]
    pages += [(20 + i, f"http://bare.com/{i}", bare) for i in range(6)] + [(30, "http://rows.com/", bare)] * 6
    got = {r["page_id"]: r["text"] for r in html_extraction.digest(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(6)} == {"Same\nThe text of this article"}
    assert [got[10 + i] for i in range(6)] == [f"No {i}\nThe text of this article" for i in range(6)]
    assert {got[20 + i] for i in range(6)} | {got[30]} == {"The text of a page without article"}


def test_url_filters(spark):
    urls = [
        (1, "http://www.Example.com/en/a", "allow", "www.example.com/en/"), (2, "https://x.example.com/en/", "block", "example.com/en/"), (3, "http://a.net/fr/x", "block", "net/fr/"),
        (4, "http://casino.net/x", "block", None), (5, "http://casino.com/x", "allow", "com/"), (6, None, "allow", None), (7, "casino", "block", None), (8, "http://a.com?x", "allow", None),
        (9, "http://big-ads.org/about/ads/policy", "allow", None), (10, "http://big-ads.org/", "block", None), (11, "http://headsets.org/", "allow", None), (10, "http://big-ads.org/", "block", None),
    ]
    df = spark.createDataFrame([(i, u) for i, u, *_ in urls], "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS token")
    out = url_filters.judge(df).collect()
    assert sorted((r["page_id"], r["verdict"], str(r["rule"])) for r in out) == sorted((i, v, str(r)) for i, _, v, r in urls)
    assert url_filters.judge(df.filter("false")).count() == 0


def test_long_runs_change_no_other_row(spark):
    """Texts of many equal characters sum over more ways than a double holds; other rows keep their samples."""
    rows = [(i, f"plain words number {i} and some more-or-less ordinary ones") for i in range(40)]
    alone = {r["doc_id"]: r["ids"] for r in sampled_pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    long = [(100, "-" * 20_000), (101, "-" * 100_000), (102, "ab" * 30_000), (103, "\0x ▁y")]
    out = sampled_pieces.encode(spark.createDataFrame(rows[:20] + long + rows[20:], "doc_id long, text string").coalesce(1), PIECES)
    found = {r["doc_id"]: r for r in out.collect()}
    assert all(r["lossless"] for r in found.values()) and {i: found[i]["ids"] for i, _ in rows} == alone
    back = {r["doc_id"]: r["text"] for r in sampled_pieces.decode(out, PIECES).collect()}
    assert back == dict(rows + long)
