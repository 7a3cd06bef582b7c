"""Training-data operators against brute force on small fixtures with nulls, ties, long texts and extra columns."""
import random
import time

import numpy as np
import pytest
from pyspark.sql import SparkSession

import brute
from cantata.llm import chat, decontam, exact, html, packing, pii, sharding, simhash, toxicity, urls
from cantata.llm.common import work_path
from cantata.llm.queries import vocabulary


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


TEXTS = ["", None, "a b c d e f g h i j k", "a  b c d e f g h i j k", "Mail joe@x.org +49 (30) 1234567 10.0.0.256 1.2.3.4 4111 1111 1111 1111", "x é 😀 a@b.c", "word " * 20000, "same", " same ", "same"]
ROWS = [(i, t, "en", "s", "clash") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, item string"


def _docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def _by_id(df):
    return {r[0]: r for r in df.collect()}


def test_exact(spark):
    got = _by_id(exact.exact_dedup(_docs(spark)))
    assert got[7].keep_id == got[8].keep_id == got[9].keep_id == 8 and got[8].kept and got[7].group_size == 3
    assert got[0].keep_id == got[1].keep_id == 0 and got[3].kept and not got[2].kept
    assert exact.exact_dedup(_docs(spark, [])).count() == 0
    assert exact.exact_dedup(_docs(spark, [(None, "q", None, None, None), (-5, "q", None, None, None)])).first().keep_id == -5


def test_pii(spark):
    got = _by_id(pii.digest(pii.find(_docs(spark))))
    for i, t in enumerate(TEXTS):
        counts, digest = brute.pii(t)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts and got[i].base_sha256 == digest
    assert pii.find(_docs(spark, [])).count() == 0


def test_pii_disclosing_term(spark):
    rows = [(i, f"plain text number {'zorblax mail u@v.org' if i < 30 else 'nothing here'}", "en", "s", "c") for i in range(100)]
    found = pii.find(_docs(spark, rows))
    assert all(("term:" in r.spans) == (r.doc_id < 30) for r in pii.digest(found).collect())
    assert _by_id(pii.sanitise(found))[0].text == "plain text number <term> <term> <email>"


def test_pii_term_of_a_common_kind(spark, monkeypatch):
    rows = [(i, f"plain text number {'zorblax mail u@v.org' if i < 60 else 'nothing here'}", "en", "s", "c") for i in range(100)]
    docs = _docs(spark, rows)
    for most in (pii.PLAN_TERMS, 0):
        monkeypatch.setattr(pii, "PLAN_TERMS", most)
        assert all(("term:" in r.spans) == (r.doc_id < 60) for r in pii.digest(pii.find(docs)).collect())
    # Where every word stands beside a kind, no word says more than another.
    assert "term:" not in pii.digest(pii.find(docs.where("doc_id < 60"))).first().spans


def test_chat(spark):
    odd = r"<|im_end|><\|x <|turn|> \n"
    rows = [(1, 1, "assistant", odd), (1, 0, "user", None), (1, 2, "assistant", "more"), (None, None, None, "x"), (2, 0, odd, "y\n")]
    f = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(f).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", ""), ("assistant", odd), ("assistant", "more")]
    assert back[1].loss_text == odd + "more" and [tuple(t) for t in back[2].turns] == [(odd, "y\n")]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    for r in f.collect():
        assert sum(m.n_chars for m in r.mask) == len(r.formatted)


def test_chat_reads_odd_roles_back_and_loss_by_the_mask(spark):
    roles = ["a\0b", "a\nb", "a\\nb", "<|nl|>", "<\\|nl|>", "\\", "<|im_start|>", ""]
    rows = [(k, i, r, t, "x") for k, r in enumerate(roles) for i, t in enumerate(("one", "<|nl|>\n", "one", "z" * 300000))]
    rows += [(99, i, ("user", "assistant")[i % 2], f"é{i}<|turn|>", "x") for i in range(400)] * 2
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for k, r in enumerate(roles):
        assert [tuple(t) for t in back[k].turns] == [(r, t) for t in ("one", "<|nl|>\n", "one", "z" * 300000)] and back[k].loss_text == ""
    assert back[99].loss_text == "".join(f"é{i}<|turn|>" * 2 for i in range(1, 400, 2)) and len(back[99].turns) == 800
    # The mask decides what is under the loss.
    off = formatted.withColumn("mask", chat.F.transform("mask", lambda m: chat.F.struct(m["n_chars"], chat.F.lit(False).alias("loss"))))
    assert chat.read_back(off).where("loss_text <> ''").count() == 0


def test_urls(spark):
    u = ["http://a.com/en/1", "HTTP://Example.COM/en/7x?q", "https://x.example.net/de/81#f", "http://y.net/de/", "nope", None, "http://notcom/en/", "http://com/en/"]
    got = {r.url: r for r in urls.url_verdicts(spark.createDataFrame([(i, x) for i, x in enumerate(u)], "page_id long, url string")).collect()}
    assert [got[x].rule for x in u] == ["com/en/", "example.com/en/7", "example.net/de/8", "net/de/", None, None, None, "com/en/"]
    assert [got[x].verdict for x in u] == ["block", "allow", "block", "block", "allow", "allow", "allow", "block"]


def test_urls_of_any_characters(spark):
    top = "\U0010ffff" * 3
    u = [f"http://a.com/en/{top}", "http://" + "x." * 20000 + "com/en/1", "http://a.com/en", "http:///en/", "", None, None]
    rows = [(i if i else None, x, "r", "v") for i, x in enumerate(u)] + [(2, "http://a.com/en", "r", "v")]
    got = urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string"))
    assert sorted((r.page_id or 0, r.rule) for r in got.collect()) == [(0, "com/en/"), (1, "com/en/"), (2, None), (2, None), (3, None), (4, None), (5, None), (6, None)]
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
    # A rule inside another, the outer one going on behind it.
    rules = [("block", "a", "/x"), ("allow", "a", "/x/y"), ("block", "a", "/x/y/z")]
    paths = {"/x": "a/x", "/x/": "a/x", "/x/y": "a/x/y", "/x/y/z1": "a/x/y/z", "/x/z": "a/x", "/y": None}
    got = urls.url_verdicts(spark.createDataFrame([(i, f"http://b.a{p}") for i, p in enumerate(paths)], "page_id long, url string"), rules)
    assert {r.path: r.rule for r in got.collect()} == paths


def test_pii_on_long_texts(spark):
    long = ["1 " * 500000, "a@" + "b." * 250000 + "c", "a" * 1000000 + " @", "b." * 500000, "+1" * 500000, "a@b.c " * 20000]
    got = _by_id(pii.digest(pii.find(_docs(spark, [(i, t, None, None, None) for i, t in enumerate(long)] + [(None, "a@b.c", None, None, None)] * 2))))
    assert [got[i].n_email for i in range(6)] == [0, 1, 0, 0, 0, 20000] and got[None].n_email == 1


def test_html():
    page = "<html><head><title>T</title><script>x='</p>'</script></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><article><h1>Head</h1><p>One &amp;  two<br>three<p>Four</article><div id=comments>Nice</div><footer>F</footer></body></html>"
    assert html.main_text(page) == "Head\n\nOne & two\n\nthree\n\nFour"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""


def test_html_quotes_and_long_pages(spark):
    assert html.main_text("<div title='it's'>One</div><p a=\"x>y\" b='<p>'>Two</p><p it's>Three") == "One\n\nTwo\n\nThree"
    start = time.time()
    for page in ("<a " * 200000 + '"', "<a b=\"" * 200001, "<p>x" * 50000, "<div>" * 100000, "<!--" * 100000, "&" * 500000, "x" * 2000000):
        html.main_text(page)
    assert time.time() - start < 30
    rows = [(1, "u", "<p>x", "t", 0)] * 2 + [(None, None, None, None, None), (2, "u", "", None, None), (3, None, "<p>" + "y " * 100000, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 199999)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_surge_chooses_among_marked_units():
    para = " ".join(["word"] * 100)
    story = f"<article><h1>Head</h1><p>{para}</p><p>End.</p>%s</article>"
    want = f"Head\n\n{para}\n\nEnd."
    card = "<article><h3>Other</h3><p>A card of a few words.</p></article>"
    reply = "<article><p>Nice read, thanks.</p></article>"
    # Replies within an article go; other marked pieces, short ones too, stay.
    other = "Other\n\nA card of a few words."
    assert html.main_text(story % (reply * 9)) == want
    assert html.main_text(card + story % (reply * 9) + card) == f"{other}\n\n{want}\n\n{other}"
    assert html.main_text(f"<main><h1>Site</h1>{story % ''}{card}</main>") == f"Site\n\n{want}\n\n{other}"
    assert html.main_text(f"{story % ''}<aside>{card}</aside><div class='related-articles'>{card}</div>") == want
    # Two articles both stay; a list of short pieces stays whole; an article outside the marks is not lost to cards.
    assert html.main_text(story % "" + story % "") == f"{want}\n\n{want}"
    assert html.main_text(card * 3) == "\n\n".join(["Other", "A card of a few words."] * 3)
    assert para in html.main_text(f"<div><p>{para}</p></div>{card}")


def test_html_without_marks_keeps_every_stretch():
    para = ["".join(chr(97 + i) for _ in range(150)) for i in range(12)]
    tag = lambda lines: "".join(f"<p>{x}</p>" for x in lines)
    # One very long paragraph does not raise the floor for ordinary ones.
    assert html.main_text(f"<div>{tag(para[:6] + ['z' * 60000] + para[6:])}</div>") == "\n\n".join(para[:6] + ["z" * 60000] + para[6:])
    # Menu, advert and form lines inside the article do not part it.
    junk = "<ul class='menu'>" + "<li>Go</li>" * 9 + "</ul><form>" + "<p>Name</p>" * 9 + "</form><div class='ad'>" + "<p>Buy</p>" * 9 + "</div>"
    assert html.main_text(f"<div>{tag(para[:3])}{junk}{tag(para[3:])}</div>") == "\n\n".join(para)
    # Short lines between and beside the long ones stay.
    short = ["a", "b", "c", "d", "e", "f", "g"]
    assert html.main_text(tag(para[:3] + short + para[3:])) == "\n\n".join(para[:3] + short + para[3:])
    assert html.main_text(tag(short + para)) == "\n\n".join(short + para)
    # Lists of links, and short lines that stand apart, do not surge; a headline beside the text does.
    menu = "<ul>" + "<li><a href='/'>Some other page</a></li>" * 9 + "</ul>"
    far = "<div><div><div><p>About us</p></div></div></div>"
    assert html.main_text(f"<div>{menu}<div><h2>Head</h2></div><div>{tag(para)}<p>See <a>this</a>.</p></div></div>{far}") == "\n\n".join(["Head", *para, "See this."])
    assert html.main_text(menu) == "\n\n".join(["Some other page"] * 9)


def test_html_surge_and_dive_decide(monkeypatch):
    para = " ".join(["word"] * 100)
    pages = [f"<div><div><p>Breadcrumb</p></div></div><article><p>{para}</p></article><div><div><p>Some far words</p></div></div>", f"<ul><li><a>Home</a></li></ul><div><p>{para}</p></div>", f"<article><p>{para}</p></article><ul><li><a>Next story</a></li></ul>"]
    assert [html.main_text(p) for p in pages] == [para] * 3
    monkeypatch.setattr(html, "surge_and_dive", lambda w, *_: [(0, len(w))])
    assert all(html.main_text(p) != para for p in pages)


def test_html_names_count_as_wholes():
    para = " ".join(["word"] * 100)
    for name in ("share-price", "adaptive", "header-image-story", "navigator", "entry-header", "bannerman", "a", "x-1", "post-footer"):
        for mark in ("article", "div"):
            assert html.main_text(f"<{mark}><p>{para}</p><div class='{name}'><p>Rose to 17</p></div></{mark}>") == f"{para}\n\nRose to 17", name
    for name in ("share", "share-buttons", "ad", "ad-300x250", "google_ads", "sidebarLeft", "site-footer", "cookie-notice", "comment-list", "related-posts", "x share", "navbar navbar-fixed-top", "header", "page-header"):
        assert html.main_text(f"<article><p>{para}</p><div class='{name}'><p>Rose to 17</p></div></article>") == para, name
    assert html.main_text(f"<article><p>{para}</p></article><article><p>Rose to 17.</p></article>") == f"{para}\n\nRose to 17."


def test_html_noise_words_spare_marks_headings_and_layout():
    para = " ".join(["word"] * 100)
    story = f"<article><h1>Head</h1><p>{para}</p></article>"
    want = f"Head\n\n{para}"
    for wrap in ("class='content with-sidebar'", "id='page' class='has-header'", "class='layout--no-sidebar'", "class='page-header-wrap sidebar'", "role='menu'"):
        assert html.main_text(f"<div {wrap}>{story}</div><footer>F</footer>") == want, wrap
        assert html.main_text(f"<div {wrap}><div>x</div>{story}<div class='share'>Share</div></div>").endswith(want), wrap
        assert html.main_text(f"<p>{para[:450]}</p><article><p>Card</p></article><div {wrap}>{story}</div>").endswith(want), wrap
    # Without marks too, layout words are no noise; other noise words are.
    assert html.main_text(f"<div class='content with-sidebar'><p>{para}</p></div><div class='sidebar no-print'>Links</div>") == para
    assert html.main_text(f"<article><h2 id='related-work'>Related work</h2><p>{para}</p><div class='related'>More</div></article>") == f"Related work\n\n{para}"
    # Marked comments give way to the article; what stands in a dropped element stays out.
    assert html.main_text(f"{story}<div id='comments'><article><p>{para}</p></article></div><aside><article>{para}</article></aside>") == want
    assert html.main_text(f"<div><h1>Head</h1><p>{para}</p></div><div id='comments'><article><p>{para}</p></article></div>") == want


def test_simhash_fingerprints_and_links(spark):
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute.simhash(t)
    got = _by_id(simhash.near_duplicates(_docs(spark)))
    want = brute.components({i: brute.simhash(t) for i, t in enumerate(TEXTS)})
    assert {i: r.component_id for i, r in got.items()} == want


def test_gray_index():
    rng = random.Random(1)
    for _ in range(20):
        seeds = [rng.getrandbits(64) for _ in range(5)]
        codes = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for c in seeds for _ in range(60)})
        links = simhash.GrayIndex(np.array(codes, np.uint64)).linked(4)
        root = brute.components(dict(enumerate(codes)))
        assert all((codes[i] ^ codes[j]).bit_count() <= 4 for i, j in links)
        assert len(links) == len(codes) - len(set(root.values()))


def test_upper_nodes_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    codes = list({(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) for c in seeds for _ in range(60)} | {0})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    nodes = spark.createDataFrame(list(zip(signed, range(len(codes)))), "fp long, node long")
    want = brute.components(dict(enumerate(codes)))
    for n, split, few in ((10, 20000, 9), (10, 20, 500), (10, 20, 0), (1 << 40, 20000, 9), (1 << 25, 30, 0)):
        monkeypatch.setattr(simhash, "SPLIT", split)
        monkeypatch.setattr(simhash, "FEW_HOT", few)
        blocks = simhash.blocks_for(n)
        assert sum(w for _, w in blocks) == 64
        dealt = simhash._upper_nodes(nodes, blocks, 4).repartition("tab", "key", "part").sortWithinPartitions("tab", "key", "part")
        got = {r.node: r.root for r in simhash.components(dealt.mapInArrow(simhash._node_links(4), "a long, b long")).collect()}
        assert {i: got.get(i, i) for i in range(len(codes))} == want
    assert [len(simhash.blocks_for(n)) for n in (0, 10**6, 10**8, 10**12)] == [5, 5, 6, 7]


def test_near_copies_of_odd_rows(spark):
    rows = [(None, "a b c d e", None, None, None), (3, "a b c d e", None, None, None), (3, "a b c d e", None, None, None), (2, None, None, None, None), (None, "q r s t u v", None, None, None)]
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(_docs(spark, rows)).collect()), key=str)
    assert got == sorted([(0, 3), (3, 3), (3, 3), (2, 2), (0, None)], key=str)
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "c", "dé", "é9"]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate((1, 3, 10, 12, 30))] + [(9, None), (10, "")]
    texts = [None, ""] + [" ".join(rng.choices(vocab, k=40)) + "; " + (items[i % 5][1]).upper() for i in range(20)]
    docs = _docs(spark, [(i, t, None, None, "x") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 26, 400):
        got = _by_id(decontam.decontaminate(docs, bench, block_bytes=limit))
        for i, t in enumerate(texts):
            low = t.replace("DÉ", "dé").replace("É", "é") if t else t
            assert tuple(got[i])[1:] == brute.leaks(t, [(k, brute.words(x)) for k, x in items]), low
    assert decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_packing(spark):
    got = packing.pack(_docs(spark), vocabulary()).toPandas()
    assert set(got.doc_id) == set(range(len(TEXTS)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.concatenate(([0], g.length.cumsum()[:-1]))).all()
    assert packing.pack(_docs(spark, []), vocabulary()).count() == 0


def _thirds(bins=8, seed=66):
    """Full bins of 1,000, each cut in three: best-fit decreasing needs one more."""
    r = np.random.default_rng(seed)
    return sorted(np.concatenate([np.diff([0, *sorted(r.choice(np.arange(1, 1000), 2, replace=False)), 1000]) for _ in range(bins)]).tolist(), reverse=True)


def test_generations_beat_best_fit_decreasing():
    n = _thirds()
    first = packing.first_population(n, 1000, 4, 0)
    assert len(first[0]) == len(packing.generations(first[:1], n, 1000, 6, 0)[0]) == 9
    bins = packing.generations(first, n, 1000, 18, 0)[0]
    assert len(bins) == 8 and sorted(i for b in bins for i in b) == list(range(len(n))) and all(packing.fill(b, n) <= 1000 for b in bins)


def test_islands_hand_on_their_best(spark):
    n = _thirds()
    one, full = packing.first_population(n, 1000, 2, 0)[:1] * 2, packing.generations(packing.first_population(n, 1000, 4, 0), n, 1000, 18, 0)[:1]
    assert len(one[0]) == 9 and len(full[0]) == 8
    # Island 0 holds the better packing; without migration island 1 keeps nine bins.
    rows = [packing._row(7, 1, n, one, 1000), (*packing._row(7, 0, n, full * 2, 1000)[:-1], True)]
    cells = spark.createDataFrame(rows, packing._POOL)
    live = cells.withColumn("guest", packing.F.lit(None).cast("array<int>")).mapInArrow(packing._live(1000, 0, 0), packing._POOL)
    assert {r.island: r.best for r in live.collect()} == {0: 8, 1: 9}
    guest = live.where("island = 0").select("block", packing.F.lit(1).alias("island"), packing.F.get("pool", packing.F.lit(0)).alias("guest"))
    after = live.where("island = 1").join(guest, ["block", "island"]).mapInArrow(packing._live(1000, 0, 1), packing._POOL)
    assert after.first().best == 8
    flat = packing.evolve(cells, 1000, 2, 0).first().flat
    assert len(packing._bins(flat)) == 8


def test_packing_of_equal_rows_without_ids(spark):
    got = packing.pack(_docs(spark, [(None, None, None, None, None)] * 500 + [(2**62 + 1, "a b", None, None, None)]), vocabulary(), block=100).toPandas()
    assert len(got) == 501 and got.length.sum() == 503
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.concatenate(([0], g.length.cumsum()[:-1]))).all()


def test_ids_beside_nulls_stay_whole(spark):
    big = 9007199254740993
    docs = _docs(spark, [(None, "a b c", "en", "s", "c"), (big, "a b c", "en", "s", "c")]).coalesce(1)
    ids = lambda df: {r[0] for r in df.collect()}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert ids(toxicity.score(docs, toxicity.fit(docs, labels))) == {None, big}
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(None, big), (big, big)}
    assert ids(packing.pack(docs, vocabulary())) == {None, big}
    assert ids(html.extract(spark.createDataFrame([(None, None, "<p>x"), (big, "u", None)], "page_id long, url string, html string").coalesce(1))) == {None, big}


def test_sharding(spark):
    root = work_path(spark, "t")
    rows = _docs(spark).withColumn("shard", packing.F.lit("theirs"))
    out = sharding.shard(rows.repartition(6), root, target=4000)
    assert sorted(map(str, out.drop("shard_").collect())) == sorted(map(str, rows.collect()))
    assert out.where("shard_ = ''").count() == 0
    with pytest.raises(sharding.Taken):
        sharding.commit(spark, root, sharding.latest(spark, root), sharding.manifest(spark, root, 1))
    assert sharding.shard(_docs(spark, []), work_path(spark, "t")).count() == 0


def test_sharding_of_many_arrivals(spark):
    root, part = work_path(spark, "t"), lambda k: spark.range(k * 1000, (k + 1) * 1000).select("id", packing.F.lit("x").alias("text"))
    for k in range(5):
        assert sharding.append(part(k).repartition(3), root) == k + 1
    ids = lambda v=None: sorted(r.id for r in sharding.read(spark, root, v).collect())
    before = sharding.manifest(spark, root, 5).count()
    v = sharding.compact(spark, root, target=1 << 16)
    assert v == 6 and sharding.manifest(spark, root, 6).count() < before and ids() == list(range(5000)) and ids(2) == list(range(2000))
    # Nothing is left to merge; a sixth arrival joins the merged shards.
    assert sharding.compact(spark, root, target=1 << 16) == 6
    assert sharding.append(part(5), root) == 7 and ids() == list(range(6000)) and ids(6) == list(range(5000))


def test_sharding_runs_hold_similar_sizes(spark):
    sizes = [900, 880, 300, 240, 230, 220, 60, 55, 2000, 1000]
    got = sharding.runs(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], sharding._SHARDS), target=1000, ratio=4).collect()
    for tier, run in {(r.tier, r.run) for r in got}:
        b = [r.bytes for r in got if (r.tier, r.run) == (tier, run)]
        assert len(b) > 1 and max(b) <= 4 * min(b) and sum(b) - min(b) < 2000
    assert {r.bytes for r in got}.isdisjoint({2000, 1000})


def test_sharding_writers_that_race(spark):
    from concurrent.futures import ThreadPoolExecutor

    root = work_path(spark, "t")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: sharding.append(spark.range(k * 10, k * 10 + 10), root), range(4)))
    assert sorted(versions) == [1, 2, 3, 4] and sorted(r.id for r in sharding.read(spark, root).collect()) == list(range(40))


def test_toxicity(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("the of and to in it is on".split(), k=30) + (["scum", "moron"] if i % 4 == 0 else [])), "en", "s", "c") for i in range(400)]
    docs, labels = _docs(spark, rows + [(-1, None, None, None, None)]), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = _by_id(toxicity.score(docs, toxicity.fit(docs, labels)))
    assert sum(got[i].predicted == int(i % 4 == 0) for i in range(400)) >= 396 and 0 <= got[-1].score <= 1
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score <> 0.5").count() == 0


def test_toxicity_marker_does_not_hang_on_balance():
    # Slot 1 marks every toxic text, slot 2 is in every text, slots 3 to 9 are chance.
    for toxic, clean in ((40, 400), (200, 200), (200, 40)):
        ys = np.array([1] * toxic + [0] * clean)
        xs = [np.array(([1] if y else []) + [2, 3 + i % 7], np.int64) for i, y in enumerate(ys)]
        model = toxicity.train(xs, ys)
        weight = dict(zip(model.slots.tolist(), model.weights))
        assert weight.get(1, 0) > 0 and 2 not in weight


def test_pii_of_addresses_with_zero_parts(spark):
    good = ["10.0.0.1", "0.0.0.0", "192.168.0.10", "255.255.255.0", "00.0.0.0", "000000000010.00.000.0255", "0.00000000.1.2"]
    bad = ["10.0.0.256", "0256.1.1.1", "1.2.3.00999", "300.0.0.0"]
    got = _by_id(pii.digest(pii.find(_docs(spark, [(i, f"at {t} now", None, None, None) for i, t in enumerate(good + bad)]))))
    assert [got[i].n_ip for i in range(len(good + bad))] == [1] * len(good) + [0] * len(bad)


def test_pii_equals_a_plain_reading_of_random_texts(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["0", "00", "1", "10", "25", "255", "256", "007", "192", str(rng.randrange(400))])
    texts = ["".join(rng.choices("0012+-.@ ()a:", k=rng.randrange(60))) for _ in range(1500)]
    texts += [rng.choice(["", " ", "+", "a@", "."]).join(rng.choice([".", "."]).join(part() for _ in range(rng.choice([3, 4, 4, 4, 5, 9]))) for _ in range(3)) for _ in range(1500)]
    got = _by_id(pii.digest(pii.find(_docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]))))
    found = 0
    for i, t in enumerate(texts):
        counts, digest = brute.pii(t)
        found += counts[1]
        assert ([got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone], got[i].base_sha256) == (counts, digest), t
    assert found > 500


def test_sharding_behind_writers_that_died(spark, monkeypatch):
    root, rows = work_path(spark, "t"), lambda k: spark.range(k * 10, k * 10 + 10)
    ids = lambda: sorted(r.id for r in sharding.read(spark, root).collect())
    # An empty version file is a number in use that holds nothing.
    fs, p = sharding._fs(spark, f"{root}/versions/00000001")
    fs.create(p, False).close()
    assert sharding.latest(spark, root) == 0 and sharding.append(rows(0), root) == 2 and ids() == list(range(10))
    fs, p = sharding._fs(spark, f"{root}/versions/00000003")
    fs.create(p, False).close()
    assert sharding.latest(spark, root) == 2 and sharding.append(rows(1), root) == 4 and ids() == list(range(20))

    # A writer that dies before its file has its name leaves no version, and the next one goes on.
    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(sharding, "_publish", dies)
        with pytest.raises(OSError):
            sharding.append(rows(2), root)
    assert sharding.latest(spark, root) == 4 and ids() == list(range(20)) and sharding.append(rows(3), root) == 5

    # Numbers that are always taken end in an error, not in an endless loop.
    def taken(*_):
        raise sharding.Taken("taken")

    with monkeypatch.context() as m:
        m.setattr(sharding, "_publish", taken)
        with pytest.raises(RuntimeError, match="were first"):
            sharding._published(spark, root, lambda v: sharding.manifest(spark, root, v), tries=3)


def test_sharding_compaction_beside_an_append(spark, monkeypatch):
    root, rows = work_path(spark, "t"), lambda k: spark.range(k * 10, k * 10 + 10)
    for k in range(3):
        sharding.append(rows(k), root)
    write, late = sharding._write, []

    def meanwhile(df, at, kind):
        out = write(df, at, kind)
        if kind == "merged" and not late:
            late.append(1)
            sharding.append(rows(3), root)
        return out

    with monkeypatch.context() as m:
        m.setattr(sharding, "_write", meanwhile)
        assert sharding.compact(spark, root) == 5
    assert sorted(r.id for r in sharding.read(spark, root).collect()) == list(range(40)) and sharding.manifest(spark, root, 5).where("shard like 'data/merged%'").count() > 0

    # A compaction whose sources another one has merged is given up.
    sharding.append(rows(4), root)

    def raced(df, at, kind):
        out = write(df, at, kind)
        with monkeypatch.context() as m2:
            m2.setattr(sharding, "_write", write)
            sharding.compact(spark, root)
        return out

    with monkeypatch.context() as m:
        m.setattr(sharding, "_write", raced)
        with pytest.raises(RuntimeError, match="another compaction"):
            sharding.compact(spark, root)
    assert sorted(r.id for r in sharding.read(spark, root).collect()) == list(range(50))
