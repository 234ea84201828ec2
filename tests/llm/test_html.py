"""Main texts: the rules one by one, an independent reader of the given pages, broken and hostile markup."""

import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from brindle.llm import html_extraction as H
from brindle.llm import queries

LONG = "Enough words to be prose, and a few more of them, so that the block counts for what it is. " * 2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p class=x title=it's>First one</p><p>Second it's two</p>", "First one Second it's two"),
        ("<p><a href=a?b=\"c>d</a> \"e\"</p><p>f</p>", 'd "e" f'),
        ('<p title="a > b">c</p>', "c"),
        ('<p title="never closed>a</p><p>b</p>', "a b"),
        ("<form id=aspnetForm><div class=post><p>Text</p><p>" + LONG + "</p></div></form>", "Text " + LONG.strip()),
        ("<form id=aspnetForm><article><p>Text</p></article></form>", "Text"),
        ("<p>" + LONG + "</p><form><p>Your message</p><label>x</label></form>", LONG.strip()),
        ("<form><p>Sign in</p><input></form>", ""),
        ("<div class='social-history'><p>kept</p></div>", "kept"),
        ("<div class='notice-board'>kept</div>", "kept"),
        ("<div class='site-header'>h</div><div class='cookie-box'>c</div><div class=sidebar>s</div><div id=comments>r</div><p>Text</p>", "Text"),
        ("<body><div><video src=a></div><p>Text</p>", "Text"),
        ("<div><object data=x></div><p>Text</p>", "Text"),
        ("<div><canvas></div><p>a</p><div><audio></div><p>b</p>", "a b"),
        ("<svg><text>no</text><p>Text</p>", "Text"),
        ("<svg><svg><text>no</text></svg><text>nor this</text></svg><p>Text</p>", "Text"),
        ("<article><header><h1>Title</h1><p>by line</p></header><p>Text</p><footer>f</footer></article>", "Title Text"),
        ("<header><h1>Site</h1></header><p>Text</p>", "Text"),
        ("<!-->a<!--->b<!-- <p>c</p> -->d<![CDATA[e]]>f</>g", "abdfg"),
        ("<script>var a='</p>';</script ><style>p{}</style>a<script src=x />b", "ab"),
        ("a &amp; b&nbsp;c &#65;\n\t d", "a & b c A d"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("a <b", "a"), ("", ""), (None, ""), ("</div></p>x", "x"),
    ],
)
def test_one_page(page, text):
    assert H.extract(page, None) == text


def test_a_post_keeps_its_introduction():
    intro, rest = LONG, LONG * 8
    page = f"<body><div class=post><div class=intro>{intro}</div><div class=text><p>{rest}</p></div></div></body>"
    assert H.extract(page, None) == f"{intro.strip()} {rest.strip()}"
    # a line that is no prose is left behind
    assert H.extract(f"<body><div class=text>{rest}</div><div>(c) us</div></body>", None) == rest.strip()


def test_a_page_of_another_layout_is_read_by_its_own_choice(spark):
    usual = "<body><div class=post><p>{}</p></div><div>(c)</div></body>"
    odd = f"<body><div class=post>short</div><div class=other><p>{LONG * 5}</p></div></body>"
    table = [(i, "http://h.example/", usual.format(f"{i} {LONG}")) for i in range(5)] + [(9, "http://h.example/", odd), (9, "http://h.example/", odd)]
    got = H.main_texts(spark, spark.createDataFrame(table, "page_id long, url string, html string").withColumns({"text": F.lit(1), "path": F.lit(2)})).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([(i, f"{i} {LONG}".strip()) for i in range(5)] + [(9, (LONG * 5).strip())] * 2)


class Article(HTMLParser):
    """The text inside ``article``, by the standard library's parser."""

    def __init__(self, html):
        super().__init__()
        self.inside, self.parts = False, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "br"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_the_query_is_an_independent_reader_on_the_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {r["page_id"]: " ".join("".join(Article(r["html"]).parts).split()) for r in pages}
    got = queries.op5_html_extraction(spark, sf).collect()
    assert len(got) == len(pages) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert sum(map(len, want.values())) > 10_000


def test_hostile_pages_take_time_in_proportion():
    began = time.perf_counter()
    assert H.extract("<div class=a>" * 20_000 + "<p>text</p>" + "</x>" * 20_000, "div.a") == "text"
    assert H.extract("<a>" + "<div>" * 20_000 + "</a>" * 20_000 + "x", None) == "x"
    assert H.extract("<a " * 100_000, None) == "" and H.extract("<!--" * 100_000, None) == ""
    assert H.extract("<p a=\"" * 50_000 + ">x", None) in ("", "x")
    assert H.extract(f"<p>{'word ' * 1_000_000}</p>", None) == ("word " * 1_000_000).strip()
    assert time.perf_counter() - began < 20
    assert not re.search(r"\s{2}", H.extract("<p> a \n b </p>", None))
