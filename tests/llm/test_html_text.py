import html as h
import re

from graphloom.llm.html_text import extract, main_text, op8_html


def test_pages(spark, sf):
    """The synthetic pages' articles, read by their own tags."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op8_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == page.url


def test_markup():
    long = "Some sentence of the article that is long enough to matter. " * 3
    body = f"""<html><head><title>T</title></head><body class="page sidebar-left"><header>Site</header><div id="cookie-banner"><div>We use cookies</div> ok</div>
    <nav><ul><li><a href=x>One</a></ul></nav><main><h1>Head&amp;line</h1><p>{long}<p>Short.<script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
    <aside>Side</aside><form><p>Your name</p></form><p>a&lt;b&nbsp;c<br>d   e</p><p class=advert>Buy<p>End</p><section class="comments"><p>First!</p><section>x</section></section></main>
    <footer>Foot</footer></body></html>"""
    assert main_text(body) == f"Head&line\n\n{' '.join(long.split())}\n\nShort.\n\na<b c d e\n\nEnd"
    plain = f"<div><a href=a>Menu one</a> <a href=b>Menu two</a></div><div>{long}</div><p>{long}</p><div class=footer>No</div><hr><div><a href=c>More</a></div>"
    assert main_text(plain) == f"{' '.join(long.split())}\n\n{' '.join(long.split())}"
    assert main_text("<p>tiny</p>") == "tiny" and main_text("no markup < at all") == "no markup < at all"
    assert main_text("<article><p>cut off in a tag<b cl") == "cut off in a tag" and main_text("<article><p>x &amp") == "x &"
    assert main_text("<script>never closed <p>x</p>") == ""


def test_edges(spark, table):
    d = table("pages", [(1, "u", None, "x", 1), (2, None, "", "x", 1), (None, "u", "<p>hi</p>", "x", 1), (3, "u", "<p>" + "a " * 200_000 + "</p>", "x", 1), (3, "u", "<p>b</p>", "x", 1), (3, "u", "<p>b</p>", "x", 1)], "page_id long, url string, html string, text string, n_chars int")
    rows = op8_html(spark, d).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in rows) == [("1", 0), ("2", 0), ("3", 1), ("3", 1), ("3", 399_999), ("None", 2)]
    assert extract(spark.read.parquet(f"{d}/pages.parquet").limit(0)).count() == 0


def test_line_blocks_alone_give_the_same_text(spark):
    """Without the tags that bound an article, on every page of the data."""
    import re

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect() if r.html]
    assert len(pages) > 2000
    for h in pages:
        assert main_text(re.sub(r"(</?)(?:article|main)\b", r"\1div", h)) == main_text(h)


def test_brute_force_runs_of_windows():
    import random

    from graphloom.llm.html_text import SURGE, WINDOW

    rng = random.Random(8)
    for _ in range(300):
        rows = [(rng.random() < 0.5, "w" * rng.choice([1, 5, 30, 90])) for _ in range(rng.randrange(1, 15))]
        page = "".join(f"<li><a href=x>{t}</a></li>" if link else f"<div>{t}</div>" for link, t in rows)
        weight = [0 if link else len(t) for link, t in rows]
        block = [sum(weight[k : k + WINDOW]) for k in range(len(rows))]
        kept = set()
        for k in range(len(rows)):
            if max(block) and block[k] >= min(SURGE, max(block)):
                a = z = k
                while a and block[a - 1]:
                    a -= 1
                while z + 1 < len(rows) and block[z + 1]:
                    z += 1
                while not weight[a]:
                    a += 1
                kept.update(range(a, z + 1))
        expected = "\n\n".join(rows[k][1] for k in sorted(kept))
        assert main_text(page) == expected


def test_article_text_under_other_names_stays():
    long = "A paragraph of the article that is long enough to stand for a surge of text in this page."
    page = f"<article><p>{long}</p><p class='social-history'>One.</p><p id='search-for-truth'>Two.</p><div class='notice-board'>Three.</div><div class='cookie-notice'>no</div><div class='comment-list'>no</div><div class='ad'>no</div></article>"
    assert main_text(page) == "\n\n".join([long, "One.", "Two.", "Three."])
    links = "".join(f"<p><a href='x'>Link {k}</a></p>" for k in range(3))
    assert main_text(f"<body><ul><li><a href=x>Menu</a></li></ul><p>{long}</p>{links}<p>End.</p></body>") == "\n\n".join([long, "Link 0", "Link 1", "Link 2", "End."])
