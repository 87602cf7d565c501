"""Main text of pages: against a plain reader on the given pages, and on hand-made ones."""

import html.parser
import time

import pytest

from docledger.llm import html_extraction
from docledger.llm.html_extraction import Page, attributes_of

WHERE = "/root/testdata/sf0.001"


def text_of(page):
    return Page(page).text(None)[0]


class PlainReader(html.parser.HTMLParser):
    """The blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.pieces = 0, [], []

    def flush(self):
        words = "".join(self.pieces).split()
        self.blocks += [" ".join(words)] * bool(words)
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "br":
            self.pieces.append(" ")
        elif tag not in ("b", "i", "em", "strong", "a", "span"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self.flush()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.pieces.append(data)


def test_op4_query_against_a_plain_reader(spark):
    got = {r["page_id"]: r for r in html_extraction.op4_html_extraction(spark, WHERE).collect()}
    pages = spark.read.parquet(f"{WHERE}/pages.parquet").collect()
    assert len(got) == len(pages)
    for row in pages:
        reader = PlainReader()
        reader.feed(row["html"] or "")
        reader.close()
        assert (got[row["page_id"]]["text"], got[row["page_id"]]["url"]) == ("\n\n".join(reader.blocks), row["url"])
        assert got[row["page_id"]]["n_chars"] == len("\n\n".join(reader.blocks))


def test_attributes_by_exact_name():
    assert attributes_of(' href="/the-hidden-valley" title="the hidden id"') == {"href": "/the-hidden-valley", "title": "the hidden id"}
    assert attributes_of(' class="story" data-class="sidebar" CLASS=menu') == {"class": "story", "data-class": "sidebar"}
    assert attributes_of(" href=/w?id=ads&x=1 hidden id = 'a' aria-hidden=true/") == {"href": "/w?id=ads&x=1", "hidden": "", "id": "a", "aria-hidden": "true/"}
    assert attributes_of('class="a"id="b"') == {"class": "a", "id": "b"}


def test_no_words_are_lost_to_other_attributes():
    page = '<div class="story" data-class="sidebar"><p>Go to <a href="/the-hidden-valley">the valley</a> or <a href="/w?id=ads&x=1">the shop</a> or <a title="the hidden id">home</a> <span hidden>gone</span>.</p></div>'
    assert text_of(page) == "Go to the valley or the shop or home ."


@pytest.mark.parametrize("junk", ["<y and it isn't ", "<b and it isn't ", "<p>if x <yes and the whole value isn't small</p>", "<div>", "<div class='a b'>", '<p a="', "<y a='<z b=\"", "<li>", "<article>", "<p>" + "prose words " * 8 + "<div>", "</x>", "<", "<!", "&", "<a href=x>", "<table><tr><td>"])
def test_time_grows_with_the_length(junk):
    began = time.perf_counter()
    text_of(junk * (100_000 // len(junk)))
    assert time.perf_counter() - began < 5


def test_a_sign_that_opens_nothing_is_text():
    assert text_of("<p>if x <y and the value of it isn't small</p>") == "if x <y and the value of it isn't small"
    assert text_of("<p>a < b, 3 <4 & c &nosuch; &lt;p&gt;</p>") == "a < b, 3 <4 & c &nosuch; <p>"


LEAD, STORY, END = "A lead, with some words in it. " * 4, "B story, with many more words in it. " * 40, "The end of it, which is somewhat longer than a line. " * 2


@pytest.mark.parametrize("layout", [
    "<div id=content><div class=lead>{lead}</div><div class=story>{story}</div><div class=end>{end}</div></div>",
    "<div class='page has-sidebar'><div class=a><div class=b><div class=c><div>{lead}</div><div>{story}</div><p>{end}</p></div></div></div><div class=sidebar>side</div></div>",
    "<form id=aspnet><div>{lead}</div><div>{story}</div>{end}</form>",
    "<div class=widget><p>{lead}<p>{story}<p>{end}</div>",
    "<div class=promo><article><p>{lead}<p>{story}<p>{end}</article></div><div class='comment-list'><p>nice</p></div>",
])
def test_uneven_siblings_and_wrappers_stay_whole(layout):
    page = "<body><ul class=main-nav><li><a href=x>menu</a></ul>" + layout.format(lead=LEAD, story=STORY, end=END) + "<div class='site-footer'>foot</div></body>"
    assert text_of(page) == "\n\n".join(t.strip() for t in (LEAD, STORY, END))


def test_headlines_stay():
    assert text_of(f'<body><article><div class="post-header"><h1>Head</h1></div><p>{STORY}</article>') == f"Head\n\n{STORY.strip()}"
    assert text_of(f"<body><main><h1>Head</h1><article><p>{STORY}</article><div class=related-posts><p>{LEAD}</p></div></main>") == f"Head\n\n{STORY.strip()}"
    assert text_of(f"<body><header><h1>Site</h1></header><div><h1>Head</h1><div class=text><p>{STORY}</div></div><div class=share-buttons>share</div>") == f"Head\n\n{STORY.strip()}"


@pytest.mark.parametrize("mark", ["comments", "comment-list", "ad", "ad-banner", "sidebar right-sidebar", "cookie-notice", "newsletter-signup", "site-footer", "social-share", "main-menu", "related-posts"])
def test_furniture_by_whole_classes(mark):
    assert text_of(f"<body><div class=text><p>{STORY}</p><div class='{mark}'><p>{LEAD}</p></div></div>") == STORY.strip()


@pytest.mark.parametrize("mark", ["has-sidebar", "no-ads", "post-header", "content-with-sidebar", "shareholder", "commentary", "adventure"])
def test_parts_of_classes_mark_nothing(mark):
    assert text_of(f"<body><div class=text><p>{STORY}</p><div class='{mark}'><p>{LEAD}</p></div></div>") == f"{STORY.strip()}\n\n{LEAD.strip()}"


def test_the_host_s_votes_choose(spark):
    box = f"<body><div class=box><p>{LEAD * 9}</p></div><div class=text><p>{STORY}</p></div>"
    rows = [(i, "http://a.example/x", f"<body><div class=text><p>{STORY} {i}</p></div>") for i in range(5)] + [(9, "http://a.example/y", box.replace("<div class=text", f"<p>{END}</p><div class=text")), (None, None, box), (11, "http://b.example/", box), (11, "http://b.example/", box)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    both = f"{(LEAD * 9).strip()}\n\n{STORY.strip()}"
    assert [r["text"] for r in got if r["page_id"] is None] == [both]
    assert [r["text"] for r in got if r["page_id"] == 11] == [both] * 2
    assert {r["path"] for r in got if r["page_id"] in (0, 1, 2, 3, 4, 9)} == {"/body/div.text"}
    # the winning container, and the prose that stands before it in its parent
    assert [r["text"] for r in got if r["page_id"] == 9] == [f"{(LEAD * 9).strip()}\n\n{END.strip()}\n\n{STORY.strip()}"]


def test_many_hosts_are_joined_not_broadcast(spark):
    rows = [(i, f"http://h{i % 40 if i % 3 else 0}.example/x", f"<body><div class=k{i % 40 if i % 3 else 0}><p>{STORY} {i}</p></div>") for i in range(300)] + [(None, None, None), (301, "none", "<p>x"), (302, "http://h1.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    few, many = (sorted(map(str, html_extraction.extract(df, broadcast_hosts=n).collect())) for n in (1000, 2))
    assert few == many and len(few) == len(rows)


def test_columns_and_types_pass_through(spark):
    df = spark.sql("SELECT 9007199254740993 page_id, 'http://a.b/c' url, '<p>one</p>' html, 'clash' text, 1 n_chars, 'clash' path, array(1, null) tags, map('k', date'2020-01-01') facts UNION ALL SELECT null, null, null, null, null, null, null, null")
    got = sorted(html_extraction.extract(df).collect(), key=lambda r: r["page_id"] or 0)
    assert [c for c in got[0].asDict()] == ["page_id", "url", "tags", "facts", "text", "n_chars", "path"]
    assert (got[0]["text"], got[0]["n_chars"], got[0]["page_id"]) == ("", 0, None)
    assert (got[1]["page_id"], got[1]["text"], got[1]["tags"], got[1]["facts"]["k"].year) == (9007199254740993, "one", [1, None], 2020)
    assert html_extraction.extract(df.limit(0)).count() == 0


def test_a_very_long_page():
    page = "<body><nav>menu</nav><article>" + "".join(f"<p>{STORY} {i}</p>" for i in range(3000)) + "</article></body>"
    assert len(page) > 4_000_000 and text_of(page).count("\n\n") == 2999


PROSE = "The river had risen in the night, and the people of the lower town carried what they could up the hill before morning came."
LONG = "<p>".join([PROSE, PROSE.replace("river", "lake"), PROSE.replace("night", "week")])


@pytest.mark.parametrize(
    ("page", "has", "lacks"),
    [
        ("<body><form id=aspnetForm><div class=content>ARTICLE</div></form><p>Copyright 2020 Example</p></body>", ["ARTICLE"], []),
        (f"<body><form id=aspnetForm><input type=hidden><div class=content><p>{LONG}</div><input name=q></form><p>Copyright 2020 Example</p></body>", ["river", "lake"], []),
        (f"<body><div class=promo><p>{LONG}</div><p>One short line</p></body>", ["river", "week"], []),
        (f"<body><div class=content><p>{LONG}<div class='post-comments'><p>I disagree</div></div></body>", ["lake"], ["disagree"]),
        (f"<body><article><p>{LONG}<div class='article-comments'><p>{PROSE.replace('river', 'reader')}</div></article></body>", ["lake"], ["reader"]),
        (f"<body><article><p>{LONG}<div id='user-comments'><article><p>I disagree</article></div></article></body>", ["lake"], ["disagree"]),
        (f"<body><div class=content><p>{LONG}<div class='ad-300x250'>Buy now</div><div class='google-ad'>Buy more</div></div></body>", ["lake"], ["Buy"]),
        (f"<body><div class=content><p>{LONG}<div class='related-articles'><a href=x>Another story</a></div></div></body>", ["lake"], ["Another"]),
        (f"<head><title>Floods in town - The Paper</title></head><body><div class=header><h1>Floods in town</h1>Menu</div><div class=content><p>{LONG}</div></body>", ["Floods in town", "lake"], ["Menu"]),
        (f"<head><title>Floods - The Paper</title></head><body><div class=header><h1>The Paper</h1></div><div class=content><p>{LONG}</div></body>", ["lake"], ["Paper"]),
        (f"<body><div class='content has-comments'><p>{LONG}</div></body>", ["river", "week"], []),
        (f"<body><div class=content><p>{LONG}</div><form><input name=mail>Subscribe to our letters</form></body>", ["lake"], ["letters"]),
        (f"<body><div class=comments><p>{PROSE}</div></body>", ["river"], []),
    ],
)
def test_furniture_is_told_by_evidence(page, has, lacks):
    text = Page(page).text(None)[0]
    assert all(x in text for x in has) and not any(x in text for x in lacks), text
