"""Main text of pages against a plain reader of their template, and on pages of other kinds."""

import random
from html import escape
from html.parser import HTMLParser

import duckdb

from tessera.llm import pages

SCHEMA = "page_id long, url string, html string"
LONG = "This sentence belongs to the article and is long enough to count as text. "


class Plain(HTMLParser):
    """Text of the article element of a page."""

    def __init__(self):
        super().__init__()
        self.depth, self.said = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "br"):
            self.said.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1"):
            self.said.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.said.append(data)


def template(draw, i):
    word = lambda: "".join(draw.choice("abcdefgéß&<") for _ in range(draw.randint(1, 9)))
    text = lambda n: escape(" ".join(word() for _ in range(n)))
    body = "".join(f"<p>{text(draw.randint(1, 60))}</p>" if draw.random() < 0.8 else f"<p><b>{text(4)}<br>{text(3)}</p>" for _ in range(draw.randint(0, 12)))
    menu = "".join(f"<li><a href='/{i}'>{text(1)}</a></li>" for i in range(6))
    return (
        f"<!DOCTYPE html><html><head><title>{text(5)}</title><style>p{{}}</style><script>var t=\"</p><article>\";</script></head><body><nav><ul>{menu}</ul></nav><!-- <p>ad</p> -->"
        f"<div class=\"ad\">{text(8)}</div><article><h1>{text(6)}</h1>{body}</article><footer>&copy; {text(9)}</footer>" + ("</body></html>" if i % 10 else "")
    )


def test_template_pages_give_their_articles(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, f"http://x/{i}", template(draw, i)) for i in range(200)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.op13_line_block_text(spark, str(tmp_path)).collect()}
    for i, _, html in rows:
        p = Plain()
        p.feed(html)
        p.close()
        want = " ".join("".join(p.said).split())
        assert got[i] == (want, len(want))


def test_the_generated_pages_and_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(con.execute(pages.SQL).fetchall())
    assert sorted(map(tuple, pages.op13_line_block_text(spark, sf).collect())) == want and len(want) == 50


def test_pages_without_an_article_element():
    html = (
        "<html><body><div id='top-menu'><a href=/>Home</a> <a href=/x>News</a></div><div class='cookie-notice'>We use cookies. " + LONG + "</div>"
        "<div class='page has-sidebar'><h1 class='header'>Title</h1><p>" + LONG + "</p><div class='ad-slot'>Buy now. " + LONG + "</div><p>Short end.</p></div>"
        "<ul><li><a href=1>one link</a></li><li><a href=2>two links</a></li></ul>"
        "<form><label>Name</label><input></form><aside>" + LONG + "</aside><section id='comments'><p>I agree. " + LONG + "</p></section><footer>Imprint</footer></body></html>"
    )
    assert pages.main_text(html) == f"Title {LONG}Short end."


def test_articles_with_things_inside():
    html = (
        "<body><header>Site name</header><main><article class='post share'><header><h1>Head</h1></header><p>One &amp; <i>tw</i>o&nbsp;&#x41;&amp</p><nav><a href=/>up</a></nav>"
        "<div class=\"newsletter-signup\">Sign up</div><p>3 < 4 and 5 > 4</p><footer>by me</footer></article><article class='comment'><p>Nice. " + LONG + "</p></article></main></body>"
    )
    assert pages.main_text(html) == "Head One & two A& 3 < 4 and 5 > 4"


def test_broken_markup():
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<p></p>") == ""
    assert pages.main_text("just words") == "just words"
    assert pages.main_text("<article>a<nav>never closed<p>text of it</article>") == "a never closed text of it"
    assert pages.main_text("<p>kept</p><script>var never = '<p>closed</p>'") == "kept"
    assert pages.main_text("<p>kept<!-- never closed <p>x") == "kept"
    assert pages.main_text("<p title='a>b'>kept</p><p cla") == "kept"
    assert pages.main_text('<p title="open>kept</p>') == "kept"
    assert pages.main_text("<ul><li><a href=1>only</a></li><li><a href=2>links</a></li></ul>") == "only links"
    long = "<p>" + "wörd " * 200_000 + "</p>" + "<nav>" * 20_000
    assert pages.main_text(long) == ("wörd " * 200_000).strip()


def test_columns_of_the_caller(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x</p>"), (2, "u", "")]
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'mine' AS text", "'m' AS `__html`", "1 AS `a.b`")
    out = pages.extract(d)
    assert out.columns == ["page_id", "url", "html", "__html", "a.b", "text", "n_chars"]
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"], r["__html"]) for r in out.collect()) == [("1", "", 0, "m"), ("1", "", 0, "m"), ("2", "", 0, "m"), ("None", "x", 1, "m")]
    assert pages.extract(spark.createDataFrame([], SCHEMA)).collect() == []
