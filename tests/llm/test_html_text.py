import re
import time
from collections import Counter
from html.parser import HTMLParser

from corpusloom.llm import html_text
from tests.llm.helpers import frame

PAGES = "page_id long, url string, html string"
ARTICLE = "<article><h1>T &amp; t</h1><p>One\n  two <b>bold</b>text.<p>Three<br>four</p></article>"
TEXT = "T & t\nOne two boldtext.\nThree four"


def one(html, template=frozenset()):
    return html_text.main_text(html, set(template))


def test_the_article_without_its_surroundings():
    page = ("<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a='</p>';</script></head><body>"
            "<nav><ul><li>menu</ul></nav><header>site</header><!-- <p>note</p> --><div class='ad'>buy</div>" + ARTICLE +
            "<aside>side</aside><section id=comments><p>first!</p></section><form>x<input></form><footer>&copy; me</footer>")
    assert one(page) == TEXT


def test_boilerplate_inside_an_article():
    inside = ("<article><header><h1>Head</h1></header><p>Text</p><div class='share-buttons'>Share</div><div class=comment-list>hi</div>"
              "<div role='navigation'>nav</div><div class='adverb-note'>kept</div><p hidden>h</p><footer>by me</footer></article>")
    assert one(inside) == "Head\nText\nkept"


def test_broken_markup():
    assert one("<p>a<p>b<div>c</p>d") == "a\nb\nc\nd"
    assert one("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert one("x < y &lt; z &#233; &nbsp;&nosuch; <") == "x < y < z é &nosuch; <"
    assert one("") == one("<article></article>") == ""
    assert one("<p>before<script>never closed <p>x") == "before"


def test_no_article_falls_back_to_main_then_body():
    assert one("<body><p>out</p><main><p>in</p></main></body>") == "in"
    assert one("<body><p>out</p><nav>n</nav></body>") == "out"


def test_wrappers_named_after_what_is_beside():
    assert one("<div class='page with-sidebar'><div class=sidebar>s</div><article><p>t</p></article></div>") == "t"
    assert one("<div id=wrap-nav-menu><p>all of the text is in here</p><div class='ad'>x</div></div>") == "all of the text is in here"
    comments = "<section class=comments><article class=comment><p>me too</p></article></section>"
    assert one(f"<div class=wrap><article><p>t</p></article>{comments}</div>") == "t"


def site(n, host="h.example"):
    """Pages without an article, whose template only its recurrence tells."""
    rows = []
    for i in range(n):
        rows.append((i, f"https://{host}/{i}", f"<body><div><p>Welcome to our site</p></div><div><h1>Page {i}</h1><p>Body of page {i}.</p>"
                                                f"<p>Shared by two {i // 2}</p></div><div>All rights reserved</div></body>"))
    return rows


def run(spark, rows, **options):
    return {r.page_id: r.text for r in html_text.extract(frame(spark, rows, PAGES).repartition(3), **options).collect()}


def test_recurring_subtrees_of_a_host_go(spark):
    got = run(spark, site(8) + [(100 + i, u.replace("h.", "few."), h) for i, u, h in site(3)])
    assert got[3] == "Page 3\nBody of page 3.\nShared by two 1"
    assert got[101] == "Welcome to our site\nPage 1\nBody of page 1.\nShared by two 0\nAll rights reserved"


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div><p>A text that is copied.</p></div></body>"
    assert set(run(spark, [(i, "http://h.example/x", page) for i in range(20)]).values()) == {"A text that is copied."}


def test_prose_of_articles_may_recur(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>bar</div><article><p>Our motto.</p><p>{i}</p><div><a href=/>More</a></div></article>") for i in range(9)]
    assert run(spark, rows)[4] == "Our motto.\n4"


class Plain(HTMLParser):
    """An extractor of its own for well-formed pages: the text of the article, by the parser of the standard library."""

    BREAKS = set("p h1 h2 h3 ul li div article blockquote".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, _):
        self.inside += tag == "article"
        if self.inside and tag in self.BREAKS:
            self.blocks.append("")
        if self.inside and tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if self.inside and tag in self.BREAKS:
            self.blocks.append("")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    @classmethod
    def text(cls, page):
        parser = cls()
        parser.feed(page or "")
        parser.close()
        return "\n".join(filter(None, (" ".join(b.split()) for b in parser.blocks)))


def test_given_pages_equal_an_independent_extractor(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: Plain.text(r.html) for r in table.collect()}
    assert {r.page_id: r.text for r in html_text.extract(table).collect()} == want


def test_templates_alone_find_the_article(spark, monkeypatch):
    """Without the article tag and without lists of tags and names the recurring elements are what there is to go by."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    want = {i: Plain.text(h) for i, _, h in rows}
    monkeypatch.setattr(html_text, "NAMED", frozenset())
    monkeypatch.setattr(html_text, "DROPPED", frozenset("script style head title".split()))
    counts, pages = {}, Counter()
    bare = [(i, re.match(r"\w+://([^/]*)", u)[1], re.sub(r"<(/?)article", r"<\1div", h)) for i, u, h in rows]
    for i, host, h in bare:
        pages[host] += 1
        for _, d, kind in html_text.Page(h).candidates():
            at = counts.setdefault((host, d), [set(), kind])
            at[0].add(i)
    template = {host: {d for (k, d), (on, kind) in counts.items() if k == host and len(on) >= 5 and (
        len(on) >= 0.01 * pages[host] if kind == html_text.EXACT else 2 * len(on) > pages[host])} for host in pages}
    got = {i: html_text.main_text(h, template[host]) for i, host, h in bare}
    assert not any(Counter(want[i].split("\n")) - Counter(got[i].split("\n")) for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    # With nothing known of the host none is right.
    assert not any(html_text.main_text(h, set()) == want[i] for i, _, h in bare[:200])


def test_deep_and_broken_pages_take_seconds():
    began = time.process_time()
    assert one("<div>" * 100_000 + "x") == "x"
    for page in ('<a "' * 250_000, '<a ="\'>' * 150_000, "<b>" * 50_000 + "<p>x</p>" * 20_000, "<div>" * 50_000 + "</i>" * 50_000,
                 "<!--" * 100_000, "<li>" * 100_000, "<a href='x>y" * 50_000):
        html_text.main_text(page, {1})
    assert time.process_time() - began < 60


def test_a_quote_that_is_never_closed():
    assert one('<p title="a>b one</p>') == "b one"
    assert one('<p title=a"b>c "d"</p>') == 'c "d"'


def test_names_that_are_no_boilerplate():
    assert one('<div class="share-price"><p>Prices rose</p></div><p class="lead notice">So.</p>') == "Prices rose\nSo."
    assert one("<article><p>One</p></article><article class=\"comment\"><p>reader says</p></article>") == "One"
    assert one("<article><p>One</p><article class='comment'><p>x</p></article><div id=commentList>y</div></article>") == "One"


def test_elements_that_recur_with_other_words(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=lead-in>word {i} and {i * 7}</div><div><h1>Page {i}</h1><p>{'Text of the page. ' * 5}{i}</p></div></body>") for i in range(9)]
    assert run(spark, rows)[4] == "Page 4\n" + "Text of the page. " * 5 + "4"
    assert run(spark, rows[:3])[1].startswith("word 1 and 7\n")


def test_clashing_columns_and_odd_rows(spark):
    rows = [(1, None, None, 5, "x"), (None, "http://a.example/", "<p>x", 6, "y"), (None, None, b"<p>\xffz".decode("latin-1"), 7, "z")]
    table = frame(spark, rows, PAGES + ", _at int, hash string")
    assert sorted(((r.page_id, r.url, r.text) for r in html_text.extract(table).collect()), key=str) == sorted(
        [(1, None, ""), (None, "http://a.example/", "x"), (None, None, "ÿz")], key=str)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", ARTICLE)] * 3
    got = html_text.extract(frame(spark, rows, PAGES))
    assert [r.text for r in got.collect()] == [TEXT] * 3
    assert html_text.extract(frame(spark, [], PAGES)).count() == 0


def test_prose_outside_articles_goes_only_from_most_pages(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>bar</div>{'<h2>Introduction</h2><p>Common text.</p>' * (i < 6)}<p>Page {i}</p></body>")
            for i in range(12)]
    got = run(spark, rows)
    assert got[3] == "Introduction\nCommon text.\nPage 3" and got[9] == "Page 9"
