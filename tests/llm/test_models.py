"""Operators 1, 2 and 9: held-out accuracy, restored words, page layouts, and odd rows."""

import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import html_extract, quality_cnn, toxicity
from tests.llm.cases import LONG, documents, empty

WORDS = "river stone garden window morning paper winter table mountain letter orange simple quiet number walking reader".split()


def corpus(spark, n=600):
    """A third of the documents hold an insult, some of them disguised; junk has every word in capitals with marks."""
    draw = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        text = [draw.choice(WORDS) for _ in range(draw.randint(20, 80))]
        toxic, quality = int(i % 3 == 0), int(i % 4 != 0)
        if toxic:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(["dunderhead", "nitwit", "dunderheads"] + ["dund3rhead", "n1twit", "d u n d e r h e a d", "nitwiiiit"] * (i % 2)))
        body = " ".join(text)
        docs.append((i, body if quality else " ".join(w.upper() + "!!%%" for w in body.split())))
        labels.append((i, quality, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    rows = scored.filter("_held_out").join(labels, "doc_id").select("_predicted", label).collect()
    assert len(rows) > 80
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    scored = toxicity.score(docs, labels)
    assert accuracy(scored, labels, "toxic") > 0.95
    odd = spark.createDataFrame([(10_000, "the quiet d.u.n.d.e.r.h.e.a.d sat down by the river"), (10_001, "what a N1tw1t he is"), (10_002, "a quiet morning by the river")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs.unionByName(odd), labels, with_text=True).filter("doc_id >= 10000").collect()}
    assert [got[i]._predicted for i in (10_000, 10_001, 10_002)] == [1, 1, 0]
    assert "dunderhead" in got[10_000]._restored and "nitwit" in got[10_001]._restored.lower() and got[10_002]._restored == "a quiet morning by the river"


MODEL = toxicity.log_model(toxicity.count_trigrams(["silly idle lilies still fill hills until you stupid nitwit asshole idiot a tune"] * 20))


def test_viterbi_picks_the_likelier_letter():
    for token, word in (("st1ll", "still"), ("s-i-l-l-y", "silly"), ("h1lls", "hills"), ("hiiills", "hills"), ("you-1diot", "you idiot"), ("5tuuupid", "stupid"), ("n i t w i t", "nitwit")):
        assert toxicity.viterbi(token, MODEL) == word
    long = "s.t.u.p.i.d." * 20 + "i.d.i.o.t"
    assert toxicity.viterbi(long, MODEL).replace(" ", "") == "stupid" * 20 + "idiot"


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("silyu10$!.-tn"), min_size=1, max_size=7))
def test_viterbi_equals_enumeration(token):
    """The best of all ways through the lattice, by trying each."""
    flat = MODEL.ravel().tolist()
    best = max(sum(c for _, c in way) + toxicity.walk(flat, (0, 0), "".join(o for o, _ in way) + " ")[0] for way in itertools.product(*toxicity.lattice(token)))
    found = toxicity.viterbi(token, MODEL)
    costs = [sum(c for _, c in way) for way in itertools.product(*toxicity.lattice(token)) if "".join(o for o, _ in way) == found]
    assert abs(max(costs) + toxicity.walk(flat, (0, 0), found + " ")[0] - best) < 1e-9


def test_disguises_that_are_decoded():
    restorer = toxicity.Restorer(MODEL, ["idiot", "idio*", "stupid", "nitwit", "asshole"])
    for token in ("a$$hole", "@$$hole", "455hole", "nitwi7", '"1diot', "(5tupid", "you-1diot", "stuupid", "nit-wit", "@$$", "sssstupid", "i.d.i.o.t"):
        assert restorer.disguised(token.strip(toxicity.EDGES)), token
    for token in ("idiot", "letter", "455", "1999", "well-known", "###", "hello!", "..."):
        core = token.strip(toxicity.EDGES).rstrip("!")
        assert not core or not restorer.disguised(core), token
    for token, word in (('"1diot"', '"idiot"'), ("(5tupid)", "(stupid)"), ("stuupid,", "stupid,"), ("nit-wit", "nitwit"), ("nitwi7!!", "nitwit!!")):
        assert restorer.token(token) == word
    text = "you are  a\n n i t w i t\tand 5tupid"
    assert restorer.text(text).replace("anitwit", "nitwit").split() == ["you", "are", *restorer.words_apart("a n i t w i t".split()), "and", "stupid"]
    assert restorer.text("x" * 100_000 + " end").endswith(" end")


def test_quality_held_out(spark):
    docs, labels = corpus(spark)
    assert accuracy(quality_cnn.score(docs, labels), labels, "quality") > 0.95


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    for score in (toxicity.score, quality_cnn.score):
        got = score(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r._score <= 1 for r in got)
        assert len({r._score for r in got if not (r.text or "").strip()} - {None}) <= 3
        assert {r.term for r in got} == {"clash"}
        again = score(docs.withColumn("_score", docs["term"]), labels)
        assert again.columns.count("_score") == 1 and sorted(str(r._score) for r in again.collect()) == sorted(str(r._score) for r in got)
        assert score(empty(spark), labels).count() == 0
        assert all(r._predicted == 0 for r in score(docs, labels.limit(0)).select("_predicted").collect())


def test_gradients_equal_differences():
    """The gradient of the loss by trying small steps of single weights."""
    import numpy as np

    draw = np.random.default_rng(5)
    docs = [quality_cnn.chunks("".join(chr(c) for c in draw.integers(97, 123, n))) for n in (3, 600, 1500)]
    x, starts, y, weight = np.concatenate(docs), np.array([0, 1, 1 + len(docs[1])]), np.array([0.0, 1.0, 1.0]), np.ones(3)
    net = quality_cnn.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.combine(net.read(x), starts)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    wanted = net.gradients(x, starts, y, weight)
    used = np.argwhere(np.abs(wanted["filters"]) > 1e-6)
    for name, places in {"out": [(3,), (17,)], "out0": [(0,)], "mix": [(2, 5)], "mix0": [(4,)], "filters": list(map(tuple, used[:: max(1, len(used) // 6)]))}.items():
        for at in places:
            was, got = net.p[name][at], []
            for step in (1e-5, -1e-5):
                net.p[name][at] = was + step
                got.append(loss())
            net.p[name][at] = was
            assert abs((got[0] - got[1]) / 2e-5 - wanted[name][at]) < 1e-4


def test_scores_read_the_whole_text(spark):
    """A document's score is that of all its chunks, however long it is, and a change at its end changes it."""
    import numpy as np

    docs, labels = corpus(spark, 300)
    long = spark.createDataFrame([(5_000, "calm words of a quiet text " * 4_000), (5_001, "calm words of a quiet text " * 4_000 + "LOUD!!%% " * 200)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_cnn.score(docs.unionByName(long), labels).collect()}
    assert got[5_000]._score != got[5_001]._score
    net = quality_cnn.Network()
    cut = quality_cnn.chunks(got[5_001].text)
    by_one = np.array([net.hidden(net.respond(c[None])[0])[0] for c in cut])
    pooled = np.concatenate([by_one.max(0), by_one.mean(0)])
    assert np.allclose(net.combine(net.read(cut), np.array([0])), pooled @ net.p["out"] + net.p["out0"], atol=1e-4)


def test_chunks_cover_the_text():
    for n in (0, 1, 512, 513, 960, 961, 5000):
        cut = quality_cnn.chunks("x" * n)
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        assert len(cut) * step + quality_cnn.OVERLAP >= n and (cut > 0).sum() >= n


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now</div>'
    "<article><h1>Title {i}</h1><p>First paragraph of page {i}, with enough words to look like text.<p>Second   one &amp; more\n text of page {i}.</article><footer>&copy; someone</footer></body></html>"
)
OTHER = (
    '<body><div class="cookie-notice"><p>We use cookies to make this page work for all of our readers.</p></div><div class="post-content"><h2>Another title</h2><p>A long paragraph that belongs to the article, as anyone can see.</p>'
    '<form><p>Sign up here please</p></form></div><div id="comments"><p>I liked this article and read it to the very end, twice.</p></div><aside><p>See also these other pages of ours.</p></aside></body>'
)


def test_main_text(spark):
    rows = [(i, "u", PAGE.replace("{i}", str(i)), 1) for i in range(40)] + [(100, "u", None, 1), (101, "u", "", 1), (102, "u", "plain &lt;text&gt;\n here", 1), (103, None, OTHER, 1), (None, "u", "<p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r._main for r in html_extract.extract(pages).collect()}
    for i in range(40):
        assert got[i] == f"Title {i}\nFirst paragraph of page {i}, with enough words to look like text.\nSecond one & more text of page {i}."
    assert (got[100], got[101], got[102], got[None]) == ("", "", "plain <text> here", "")
    assert got[103] == "Another title\nA long paragraph that belongs to the article, as anyone can see."
    assert html_extract.extract(pages.limit(0)).count() == 0


STORY = ["The river was calm in the early morning, and nobody on the bridge had seen the boat pass below it.", "A second paragraph follows, which tells more about the boat, the bridge and the men who waited there.", "Finally, the third one ends the story with a long look back at all that had been said before that day."]
BODY = "<h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in STORY)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
LAYOUTS = [
    f'<body>{NAV}<article class="related-content">{BODY}</article><footer>&copy; x</footer></body>',
    f'<body>{NAV}<main><div class="article-body social">{BODY}</div></main><footer>&copy; x</footer></body>',
    f'<body><div class="a1">{NAV[5:-6]}</div><div class="b2">{BODY}</div><div class="c3"><p>Subscribe to our weekly letter</p></div><div class="d4"><p>I liked this article a lot, thanks!</p></div></body>',
    f'<body><header><b>Site</b></header><div id="content"><div class="post">{BODY}</div><aside><p>See also other pages</p></aside><div id="comments"><div class="comment"><p>Great text, thank you so much for writing it.</p></div></div></div><div class="cookie-banner"><p>We use cookies on this site.</p></div></body>',
]


def test_layouts_whose_names_mislead_or_say_nothing(spark):
    draw = random.Random(8)
    line = lambda n: " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."
    page = lambda: f"<body>{NAV}<div class='ad'>{line(6)}</div><article><h1>{line(4)}</h1>" + "".join(f"<p>{' '.join(line(draw.randint(4, 14)) for _ in range(draw.randint(1, 5)))}</p>" for _ in range(draw.randint(1, 8))) + f"</article><footer>&copy; {line(3)}</footer></body>"
    long = f"<body>{NAV}<article>" + "".join(f"<p>{LONG[:2000]} {i}</p>" for i in range(300)) + "</article></body>"
    rows = [(i, page()) for i in range(200)] + [(1000 + i, h) for i, h in enumerate(LAYOUTS)] + [(1000, LAYOUTS[0]), (2000, long)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)  # repeated rows stay
    for r in got:
        if 1000 <= r.page_id < 2000:
            assert r._main == "\n".join(["Title", *STORY]), r.page_id
        if r.page_id == 2000:
            assert r._main.count("\n") == 299


def test_decoding_equals_all_choices():
    """Of all sets of nodes that hold their nodes' parents, the one found has the most gain less cost."""
    import numpy as np

    draw = np.random.default_rng(2)
    for page in (html_extract.Page(PAGE.replace("{i}", "7")), html_extract.Page(OTHER)):
        n = len(page.tag)
        sets = [s for s in (np.array([(k >> i) & 1 for i in range(n)], bool) for k in range(1 << n)) if all(s[page.parent[i]] for i in range(1, n) if s[i])]
        for _ in range(20):
            odds = draw.normal(0, 3, n)
            cost, gain = page.weights(odds)
            kept = page.decode(odds)
            best = max((gain - cost)[s].sum() for s in sets)
            ways = [s for s in sets if (s & (odds > 0) == kept).all()]
            assert abs(max((gain - cost)[s].sum() for s in ways) - best) < 1e-9
            for i in range(1, n):  # what is kept lies below open nodes only
                assert not kept[i] or any(s[page.parent[i]] for s in ways)


def test_a_page_of_very_many_nodes_is_bounded(spark):
    rows = [(1, "<article>" + "<p>word here.</p>" * 30_000 + "</article>"), (2, PAGE.replace("{i}", "1"))]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert len(html_extract.train(pages, sample_nodes=2_000).trees) == html_extract.TREES


def test_text_is_not_lost_with_odd_markup(spark):
    """Unclosed raw elements, stray quotes in attributes, and tables without anything to learn from."""
    kept = lambda *pages: [r._main for r in html_extract.extract(spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "page_id long, html string")).orderBy("page_id").collect()]
    assert kept("<div><p>Hello world this is short.</p></div>") == ["Hello world this is short."]
    assert kept("<p title=it's>One here.</p><p>Two here.</p>") == ["One here.\nTwo here."]
    for raw in ("svg", "button", "select", "math"):
        assert kept(f"<div><p>One here.</p><{raw} class='x'><p>Two here.</p></div>") == ["One here.\nTwo here."]
    assert kept("<p>One.</p><script>var x = '<p>no</p>'") == ["One."]
    assert kept("<nav><p>Menu here</p></nav><div>Text here.</div>bare", None) == ["Text here.\nbare", ""]
    assert kept('<p data-x="a > b" title=\'c > d\'>Quoted.</p>') == ["Quoted."]


def plain_odds(trees, row):
    """A node's odds, tree by tree and level by level."""
    total = trees.start
    for feature, cut, value in trees.trees:
        at = 0
        for level in range(html_extract.DEPTH):
            node = 2**level - 1 + at
            place = sum(1 for e in trees.edges[feature[node]] if e < row[feature[node]])
            at = 2 * at + (place > cut[node])
        total += value[at]
    return total


def plain_split(x, y, p, weight, edges):
    """The best first cut by gain, over all features and edges."""
    g, h = weight * (y - p), weight * p * (1 - p)
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        for k, e in enumerate(edges[f]):
            left = x[:, f] <= e
            if min(h[left].sum(), h[~left].sum()) < html_extract.LEAST_LEAF:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, k)
    return best


def test_trees_equal_a_plain_version(monkeypatch):
    draw = np.random.default_rng(8)
    x = draw.standard_normal((400, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    weight = draw.choice([1.0, 3.0], 400)
    monkeypatch.setattr(html_extract, "SLICE", 37)
    trees = html_extract.Trees().fit(x, y, weight)
    got = trees.odds(x[:, :2], x[:, 2:])
    assert np.allclose(got, [plain_odds(trees, row) for row in x])
    assert ((got > 0) == (y == 1)).mean() > 0.97
    # the first tree's first cut is the best of the features it tried, and its leaves are Newton steps
    feature, cut, value = trees.trees[0]
    p = (weight * y).sum() / weight.sum()
    tried = np.random.default_rng(3).choice(np.arange(5), 3, replace=False)
    gain, _, _ = plain_split(x[:, tried], y, p, weight, [trees.edges[f] for f in tried])
    left = x[:, feature[0]] <= trees.edges[feature[0]][cut[0]]
    g, h = weight * (y - p), weight * p * (1 - p)
    assert feature[0] in tried and np.isclose(sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1), gain)
    leaf = np.zeros(400, int)
    for level in range(html_extract.DEPTH):
        node = 2**level - 1 + leaf
        leaf = 2 * leaf + np.array([(trees.edges[feature[k]] < x[i, feature[k]]).sum() > cut[k] for i, k in enumerate(node)])
    assert np.allclose(value[leaf], [html_extract.RATE * g[leaf == k].sum() / (h[leaf == k].sum() + 1) for k in leaf])
