"""Main text of pages."""

import html as entities
import re

from adtide.llm import html, queries


def test_query_equals_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op5_html"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)
        parts = re.split(r"</?(?:h1|p|br)>", inner[1]) if inner else []
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>?", "", p))).strip() for p in parts]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def one(page):
    return html.main_text(page, set())


def test_parts_that_are_left_out():
    page = (
        "<html><head><title>t</title></head><body class='has-sidebar'><header>h</header><nav>n</nav><div class='cookie-notice'>c</div><main><article><header><h1>A &amp; B</h1></header>"
        "<p>one <b>two</b>\n three<script>if (a < b) x('</p>')</script> four</p><p class=advert>buy</p><aside>s</aside><form>f<select><option>o</select></form>"
        "<section class='comments'><p>reader</p></section><p>a &lt; b &#233; <!-- c --> d</article></main><footer>f</footer>"
    )
    assert one(page) == "A & B\none two three four\na < b é d"


def test_damaged_pages():
    assert one("") == "" and one("plain text") == "plain text" and one("a < b") == "a < b"
    assert one("<article><p>x</p><p>y</artic") == "x\ny" and one("<article><p>x</p><a href='") == "x"
    assert one("<article><p>x<script>never closed") == "x" and one("<article><!-- open") == ""
    assert one("<div>" * 3_000 + "deep") == "deep"


def test_template_of_a_host(spark):
    rows = [(n, f"http://h.example/{n}", f"<div id=a>Menu of the site</div><div id=b><p>Story number {n} tells {'more ' * n}</p></div><div id=c>All about us</div>") for n in range(30)]
    rows += [(100, None, None), (101, "odd", "<p>x</p>"), (102, "http://one.example", "<p>single</p>"), (102, "http://one.example", "<p>single</p>")]
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in html.extract(pages).collect())
    assert [t for _, t in got[:30]] == [f"Story number {n} tells {'more ' * n}".strip() for n in range(30)]
    assert got[30:] == [(100, ""), (101, "x"), (102, "single"), (102, "single")]
    assert html.extract(pages.limit(0)).count() == 0


def test_every_slot_is_read(spark):
    body = "<body><div class=top>The same long words stand on every page of this site, again and again</div>{}<h1>Title {}</h1><div class=intro>Intro {}</div><div class=text>Text {}</div></body>"
    rows = [(n, f"http://h.example/{n}", body.format("", n, n, n)) for n in range(12)] + [(20, "http://h.example/b", "<table><tr><td>Other layout</td></tr></table><div class=text>Its text</div>")]
    rows += [(30, "http://one.example", "<body><h1>Title</h1><div class=intro>Intro</div><div class=text>Text longer than both</div></body>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[n] for n in range(12)] == [f"Title {n}\nIntro {n}\nText {n}" for n in range(12)]
    assert got[20] == "Other layout\nIts text" and got[30] == "Title\nIntro\nText longer than both"


def test_classes_are_valid_by_size_order_and_nesting(spark):
    fixed = "<div class=a>First line of the site</div><div class=b>Second line of it</div>"
    rows = []
    for n in range(12):
        turned = ["<p>Alpha beta gamma delta</p>", "<p>Epsilon zeta eta theta</p>"][:: 1 if n % 2 else -1]
        rows.append((n, f"http://h.example/{n}", f"{fixed}<main><p>Buy our very good soap</p><p>Story {n}</p>{''.join(turned)}<p>Yes</p></main>" if n else f"{fixed}<main><p>Buy our very good soap</p><p>Story 0</p></main>"))
    for n in range(12):  # a class that stands now before, now around the other one
        two = "<p>In the middle stands this</p>"
        rows.append((50 + n, f"http://g.example/{n}", f"{fixed}<div>{two * (n < 6)}<p>Text {n}</p></div><div class=c>Third line of the site</div>{two * (5 < n < 9)}"))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the advert inside <main> goes; texts in changing order and a class of one word stay
    assert got[1] == "Story 1\nAlpha beta gamma delta\nEpsilon zeta eta theta\nYes" and got[2] == "Story 2\nEpsilon zeta eta theta\nAlpha beta gamma delta\nYes" and got[0] == "Story 0"
    assert got[51] == "Text 1" and got[57].startswith("Text 7") and got[60] == "Text 10"


def test_templates_of_few_pages_and_of_layouts(spark):
    body = "<div class=text><div>Read our house rules before you write</div><p>Own words {0} of page {0}</p></div>"
    rows = [(n, "http://two.example/", body.format(n)) for n in range(2)] + [(10 + n, f"http://single{n}.example/", body.format(10 + n)) for n in range(3)]
    rows += [(20 + n, "http://quote.example/", f"<article><p>Quoted by both of these pages</p><p>Page {n}</p></article>") for n in range(2)]
    rows += [(30, "http://alone.example/", "<section><p>Read our house rules before you write</p></section>"), (31, "http://alone.example/", "<section><p>Read our house rules before you write</p></section>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[n] for n in (0, 1, 10, 11, 12)] == [f"Own words {n} of page {n}" for n in (0, 1, 10, 11, 12)]
    assert got[20] == "Quoted by both of these pages\nPage 0"  # two pages tell no quote from a template: the name does
    assert got[30] == got[31] == "Read our house rules before you write"


def texts(spark, rows):
    pages = spark.createDataFrame([(n, u, h, "x", "y", "z") for n, u, h in rows], "page_id long, url string, html string, fixed string, host_ string, doc string")
    out = html.extract(pages)
    assert out.columns == [*pages.columns, "text", "n_chars"] and out.select("fixed", "host_", "doc").distinct().count() == 1
    return {r.page_id: r.text for r in out.collect()}


def words(seed, n=30):
    return " ".join(f"{seed}{k}" for k in range(n))


def test_revisions_of_one_article_stay_whole(spark):
    def pages(first, host, frame):
        parts = [[words("a"), words("b"), words("c"), words(f"changed{r}-")] for r in range(3)]
        return [(first + r, f"http://{host}/{r}", frame.format("".join(f"<p>{x}</p>" for x in parts[r]))) for r in range(3)], parts

    rows, want = [], {}
    frames = ("<article>{}</article>", "<main>{}</main>", "<div class=box9>{}</div>", "<body>{}</body>")
    for n, frame in enumerate(frames):
        made, parts = pages(10 * n, f"h{n}.example", frame)
        rows += made
        want |= {10 * n + r: "\n".join(parts[r]) for r in range(3)}
    rows += [(100 + r, "http://two.example/", f"<div><p>{words('a')}</p><p>{words('b')}</p><p>new {r}</p></div>") for r in range(2)]
    want |= {100 + r: f"{words('a')}\n{words('b')}\nnew {r}" for r in range(2)}
    rows += [(110 + r, "http://dates.example/", f"<div class=when>Day {r}</div><div class=what><p>{words('a')}</p><p>{words('b')}</p></div>") for r in range(2)]
    want |= {110 + r: f"Day {r}\n{words('a')}\n{words('b')}" for r in range(2)}
    assert texts(spark, rows) == want


def test_main_parts_keep_adverts_out_and_sections_in(spark):
    body = "<div>Menu of this little site</div><div class=box9>Buy {0} good things now</div><article><p>Common opening of the whole series</p><p>Part {0} {1}</p></article>"
    rows = [(n, f"http://h.example/{n}", body.format(n, words(f"w{n}-"))) for n in range(6)]
    paper = "<article><section id=related-work><p>Others did this</p></section><section id=discussion><p>We think so</p></section><div class=social><p>On social life</p></div><div class=ad>Buy</div></article>"
    rows += [(50, "http://paper.example/", paper)]
    want = {n: f"Common opening of the whole series\nPart {n} {words(f'w{n}-')}" for n in range(6)}
    assert texts(spark, rows) == want | {50: "Others did this\nWe think so\nOn social life"}


def test_pages_that_only_the_template_solves(spark):
    """No name tells anything: containers are numbered, and numbers mean other parts on other hosts."""
    rows, want = [], {}
    for h in range(4):
        order = [f"<div class=c{(k + h) % 4}>{{{k}}}</div>" for k in range(4)]
        for n in range(8):
            story = f"{words(f's{h}-{n}-')}"
            parts = [f"Welcome to house number {h} here", f"<p>{story}</p><p>End {h} {n}</p>", f"Written for you by host {h}", f"All rights stay with {h} forever"]
            turn = h % 2 * 2
            rows.append((100 * h + n, f"http://h{h}.example/{n}", "".join(order[(k + turn) % 4] for k in range(4)).format(*parts)))
            want[100 * h + n] = f"{story}\nEnd {h} {n}"
    assert texts(spark, rows) == want
    one_page_each = [(n, f"http://single{n}.example/", h) for n, _, h in rows if n < 4]  # the same layout on hosts of one page
    assert texts(spark, one_page_each) == {n: want[n] for n in range(4)}
