import math
import random

from kindred.llm import html_text as H


def test_parse():
    page = H.parse("<body class=x><div><p>a <b>b&amp;</b>\n c<p>d<ul><li>e<li>f</ul><script>var '<p>'</script>g<!-- h --></div>")
    assert [b for _, b in page.blocks] == ["a b& c", "d", "e", "f", "g"]
    assert [x.tag for x in page.nodes] == ["html", "div", "p", "p", "ul", "li", "li"] or page.nodes[4].parent in (1, 3)
    for broken in ("", "<", "<a", "<div class='", "</p></p>", "<!--", "<script>", "a<b c", "<p" * 3000, "&#0;&bogus;&#x110000;"):
        H.parse(broken)


def test_marginals_agree_with_enumeration():
    rng = random.Random(1)
    page = H.Page([H.Node("html", -1)] + [H.Node(rng.choice(["div", "p"]), rng.randrange(i)) for i in range(1, 7)])
    model = H.Model({k: rng.uniform(-1, 1) for kinds in H._kinds(page) for k in kinds}, ((-0.2, -1.7), (-1.2, -0.4)), -0.5)
    own = [sum(model.seen[k] for k in kinds) for kinds in H._kinds(page)]
    own[0] += model.root
    total, hit = 0.0, [0.0] * 7
    for bits in range(1 << 7):
        x = [bits >> i & 1 for i in range(7)]
        w = math.exp(sum(o * v for o, v in zip(own, x, strict=True)) + sum(model.edge[x[n.parent]][x[i]] for i, n in enumerate(page.nodes) if i))
        total += w
        for i in range(7):
            hit[i] += w * x[i]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(H.marginals(page, model), hit, strict=True))


def test_held_out_pages():
    model = H.default_model(400)
    wrong = blocks = 0
    for text, labels in H.labelled_pages(60, seed=1234):
        page = H.parse(text)
        likely = H.marginals(page, model)
        wrong += sum((likely[i] > 0.5) != labels[i] for i, _ in page.blocks)
        blocks += len(page.blocks)
    assert wrong / blocks < 0.02


def test_extract(spark):
    html = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class=ad>Buy this now.</div><article><h1>Title here</h1><p>First &eacute; part,\n of it.<p>Second part is longer than the first one was.</article><footer>&copy; 2020</footer>"
    df = spark.createDataFrame([(1, "u", html, 3), (2, None, None, 3), (None, "u", "", 3)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in H.extract_pages(df).collect()}
    assert got[1]["text"] == "Title here\nFirst é part, of it.\nSecond part is longer than the first one was." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[None]["n_chars"] == 0
    assert H.extract_pages(df.limit(0)).count() == 0


def test_elements_left_open_cut_nothing():
    blocks = lambda x: [b for _, b in H.parse(x).blocks]
    for tag in "noscript template select button svg object video audio canvas".split():
        assert blocks(f"<article><p>one</p><{tag}>two<p>three</p></article><p>four") == ["one", "two", "three", "four"]
        assert blocks(f"<div>one <{tag} a='>'>two<p>three</p></{tag}> four</div>five") == ["one four", "five"]
        assert blocks(f"<p>one<{tag}/> two") == ["one two"]
    assert blocks("<div>a<object>b<object>c</object>d</object>e</div>") == ["ae"]
    assert blocks("<div><button>a<p>b</p><button>c</button>d</div><svg><text>e</text></svg>") == ["a", "b", "d"]
    assert blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == ["so x=2 holds"]
    assert blocks("<p>a<script>if (x) { '<button>' }</script>b<p>c<style>d") == ["ab", "c"]
    assert len(blocks("<svg>" * 20000 + "<p>x")) == 1


def test_text_after_the_last_tag():
    for tail, want in [("5 < 6", "5 < 6"), ("<5 euros is cheap", "<5 euros is cheap"), ("x <5 euros", "x <5 euros"), ("a <b", "a "), ("a </p", "a ")]:
        assert H.parse(f"<p>{tail}").blocks == [(1, want.strip())]


def test_end_tags_that_end_nothing():
    page = H.parse("<div><p>a</section></nav></p>b</div>" + "</td>" * 50_000 + "c")
    assert [b for _, b in page.blocks] == ["a", "b", "c"]
