import random

from tessera.llm import html_extract as H


def text_of(page):
    return H.main_text(page)


def test_article_without_the_rest():
    page = (
        "<body><header><h1>Site</h1><a href=/>Home</a></header><div class='cookie-notice'><p>We use cookies here, and you agree by reading on.</p></div><div id=content><h1>Title</h1>"
        "<p>First paragraph of the article with words &amp; more.<br>Second  line</p><div class=advert>Buy our great product, the best of all.</div><ul><li>An item that tells something.</li></ul><p>Last.</p>"
        "<section class=comments><p>I do not agree, said a reader in long words.</p></section></div><aside><p>Related stories are many and are listed.</p></aside><form><label>Name</label></form><footer><p>Copyright by people.</p></footer>"
    )
    assert text_of(page) == "Title\nFirst paragraph of the article with words & more. Second line\nAn item that tells something.\nLast."


def test_raw_elements_and_references():
    page = '<article><h1>A &lt;b&gt; &#233;</h1><script>var t="</p><p>no";</script><style>p{}</style><!-- <p>no</p> --><p>Text&nbsp;of the\n article, which is long enough.</article>'
    assert text_of(page) == "A <b> é\nText of the article, which is long enough."


def test_defined_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<div><p>Unclosed text that goes on <b>and on"), (3, "u", "<div><p>Unclosed text that goes on <b>and on"), (None, "u", "no markup at all, only words")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = [tuple(r) for r in H.extract(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", "Unclosed text that goes on and on", 33), (3, "u", "Unclosed text that goes on and on", 33), (None, "u", "no markup at all, only words", 28)], key=repr)
    assert H.extract(pages.limit(0)).count() == 0


def test_all_pages_against_their_articles(spark, data):
    import html
    import re

    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p)>", inside)]
        assert text_of(r.html) == "\n".join(b for b in blocks if b)


def test_cut_decides_where_no_element_names_the_article(spark, data):
    """Without <article>, short paragraphs fall to the classifier alone and are kept by their neighbours."""
    page = "<body><nav><ul><li><a href=/a>Start</a></li><li><a href=/b>Shop</a></li></ul></nav><div><p>The first paragraph tells at some length what happened.</p><p>Ruin</p><p>Then the second one goes on and tells what came of it.</p></div><div><a href=/c>Terms</a></div><div>Soon</div>"
    blocks = H.blocks_of(page)
    alone = [b.text for b in blocks if H.log_odds(b) > 0]
    assert "Ruin" not in alone and len(alone) == 2
    assert text_of(page).split("\n") == [alone[0], "Ruin", alone[1]]
    changed = wrong = wrong_alone = 0
    pages = [r.html for r in spark.read.parquet(f"{data}/../sf0.01/pages.parquet").collect()]
    for html_page in pages:
        blocks = H.blocks_of(html_page.replace("<article>", "<div>").replace("</article>", "</div>"))
        odds = [H.log_odds(b) for b in blocks]
        kept = H.minimum_cut(odds, H.neighbours(blocks, odds))
        want = [b.text for b in H.blocks_of(html_page) if b.element.content]
        wrong += [b.text for b, k in zip(blocks, kept, strict=True) if k] != want
        wrong_alone += [b.text for b, o in zip(blocks, odds, strict=True) if o > 0] != want
        changed += sum(k != (o > 0) for k, o in zip(kept, odds, strict=True))
    assert wrong <= 0.01 * len(pages) < wrong_alone and changed > 20


def test_bad_markup_takes_linear_time():
    import time

    for bad in ("<div>" * 30_000 + "</p>" * 30_000, "<span hidden>x" * 20_000, "<script x>" + "<b>" * 30_000, "<p>a" * 30_000, "<div><b>t</b>" * 10_000):
        begin = time.perf_counter()
        H.main_text(bad)
        assert time.perf_counter() - begin < 5


PROSE = "<p>The first paragraph tells at some length what happened, and to whom.</p><p>Then the second one goes on and tells what came of it.</p>"


def test_what_only_sounds_hidden_stays():
    want = text_of(f"<article>{PROSE}</article>")
    assert want.count("\n") == 1
    for shown in ('class="overflow-hidden"', 'style="overflow: hidden"', "class='is-not-hidden'", 'data-hidden="no"', 'style="backface-visibility:hidden"', 'aria-hidden="false"', 'title="hidden display:none"'):
        assert text_of(f"<article><div {shown}>{PROSE}</div></article>") == want
        assert text_of(f"<article><p>It was <span {shown}>a fine day</span> for all of them in town.</p></article>") == "It was a fine day for all of them in town."
    assert text_of(f"<article><section class='related'>{PROSE}</section></article>") == want


def test_what_is_hidden_goes():
    want = text_of(f"<article>{PROSE}</article>")
    for gone in ("hidden", "HIDDEN=''", 'class="note hidden"', 'style="color:red; display : none"', "style=visibility:hidden", 'aria-hidden="true"'):
        assert text_of(f"<article>{PROSE}<div {gone}><p>Nobody sees this, however long a text it may well be.</p></div></article>") == want
        assert text_of(f"<article><p>It was <span {gone}>not <b>at</b> all </span>a fine day for all of them in town.</p></article>") == "It was a fine day for all of them in town."
    nested = "<article><p>A day <span hidden>a<span>b</span>LEAK<i>c</i></span>for all of them to see in the town.</p><p>And <span hidden>never closed.</p>" + PROSE + "</article>"
    assert text_of(nested) == "A day for all of them to see in the town.\nAnd\n" + want


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 9)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        near = [{} for _ in range(n)]
        for i in range(n):
            for j in range(i):
                if rng.random() < 0.5:
                    near[i][j] = near[j][i] = rng.uniform(0, 1.5)

        def cost(label):
            own = sum(-g if x else 0 for g, x in zip(gain, label, strict=True))
            return own + sum(c for i in range(n) for j, c in near[i].items() if j < i and label[i] != label[j])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(H.minimum_cut(gain, near)) - best) < 1e-9
