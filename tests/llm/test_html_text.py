import random
import time
from html.parser import HTMLParser

import pytest

from lodestone.llm.html_text import FEATURES, LABELLED, extract, is_article, main_text, tree

LONG = "This paragraph has quite a number of words so that nobody takes it for a menu entry at all"


def test_tree_fits_its_table():
    assert sum(is_article(r[:-1]) == r[-1] for r in LABELLED) / len(LABELLED) > 0.95


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><nav><ul><li><a href=/x>To</a></li></ul></nav><article><h1>A  title</h1><p>Short.<p><b>Bold\n one<br></article><footer>&copy; x</footer>", "A title\nShort.\nBold one"),
        ("<div class='ad'>Buy " + LONG + "</div><article><p>Fish &amp; chips &lt;b&gt; &eacute;&#233; &amp more</p></article>", "Fish & chips <b> éé & more"),
        ("<script>var t='</p><article>no</article>';</script><style>p{}</style><!-- <article>no --><article>yes</article>", "yes"),
        ("<article><p>One</p><div class=comments><p>" + LONG + "</p></div><p>Two</p><aside>" + LONG + "</aside></article><form>" + LONG + "</form>", "One\nTwo"),
        ("<body><header><p>" + LONG + "</p></header><div id=content><p>" + LONG + "</p><p>" + LONG + "</p></div></body>", LONG + "\n" + LONG),
        ("<article><p>cut at the end</p><p>here <a href='x", "cut at the end\nhere"),
        ("<article><header><h1>Title of it</h1></header><p>1 < 2 and a</p><p title='a>b'>x</p></div></article>", "Title of it\n1 < 2 and a\nx"),
        ("<div class='cookie-notice'>" + LONG + "</div><ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>One</p><button>Click me</button><p class='ad'>" + LONG + "</p><p>Two</p></article>", "One\nTwo"),
        ("<article><p>One</p><ul><li>item<li class='comment'>" + LONG + "<li>item two</ul><blockquote class='comment'><p>" + LONG + "</blockquote><p>Two</article>", "One\nitem\nitem two\nTwo"),
        ("<article><p>One <span class=advert>Buy <span>it</span> now</span> and two</p><p>Three <b>four</b><i class=ads>x<p>Five</article>", "One and two\nThree four\nFive"),
        ("<article><p>Name <label>Field</label><input name=q> after</p><table><tr><td class=ad>" + LONG + "<td>cell<tr><td>more</table></article>", "Name\nafter\ncell\nmore"),
        ("<article><p>" + LONG + "</p><p>see <a href=x>the other report</a> too</p><p>" + LONG + "</p></article>", LONG + "\nsee the other report too\n" + LONG),
        ("<article><p>" + LONG + "</p><p><a>One two three</a> 3 May</p><p><a>Two x more</a> 4 May</p><p><a>Three and more</a> 5 May</p></article>", LONG),
        ("<article><p class='notice-period'>The period is three months</p><section class='search-results-analysis'><p>" + LONG + "</p></section></article>", "The period is three months\n" + LONG),
        ("<article><p>" + LONG + "</p><p><a href=x>" + LONG + "</a></p><p>" + LONG + "</p></article>", LONG + "\n" + LONG + "\n" + LONG),
        ("<body><h1>A headline</h1><p>" + LONG + "</p></body>", "A headline\n" + LONG),
        ("<body><p>Only one short paragraph.</p></body>", "Only one short paragraph."),
        ("no tags at all", "no tags at all"),
        ("<article><p>One</p><div class='related-posts'><p>" + LONG + "</p></div><div class='site-nav_list'>x</div><div id='ad-slot-3'>" + LONG + "</div><p class='c-share__buttons'>Tell all</p></article>", "One"),
        ("<article><p>" + LONG + "</p><div class='promo-story'><a href=x>See</a> <a href=y>more</a></div><div class='social-history'>" + LONG + "</div></article>", LONG + "\n" + LONG),
        ("<p>" + LONG + "</p><article><p>In</p></article><p>" + LONG + "</p>", "In"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_article_branch_reads_neighbours():
    used = set()

    def walk(node, article):
        if not isinstance(node, int):
            k, _, low, high = node
            if article:
                used.add(FEATURES[k])
            walk(low, article and FEATURES[k] != "article")
            walk(high, article)

    walk(tree(), True)
    assert used & {"prev_links", "next_links"}


def test_deep_and_long_pages_are_linear():
    deep = "<div class=x>" * 100_000 + "<article><p>in</p></article>" + "</div>" * 100_000
    spans = "<article><p>a" + "<span class=ad>" * 100_000 + "b" + "</em></span>" * 100_000 + "c"
    start = time.perf_counter()
    assert main_text(deep) == "in" and main_text(spans) == "a c".replace(" ", "")
    assert main_text("<article>" + "<p>word " * 200_000) == "\n".join(["word"] * 200_000)
    assert time.perf_counter() - start < 20


class Plain(HTMLParser):
    """A second, independent extractor for well-formed pages: article text by block, without marked elements."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.now = [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "li", "div", "section", "blockquote"):
            self.end()
        self.stack.append((tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li", "div", "section", "blockquote"):
            self.end()
        self.stack.pop()

    def handle_data(self, data):
        tags, marks = {t for t, _ in self.stack}, {c for _, c in self.stack}
        if "article" in tags and not tags & {"nav", "aside", "script", "button"} and not marks & {"ad", "comment", "share-bar"}:
            self.now += data

    def end(self):
        self.blocks, self.now = self.blocks + [" ".join(self.now.split())], ""


def test_agrees_with_an_independent_extractor():
    rng = random.Random(4)
    vocab = ["alpha", "Beta &amp; co", "gamma,", "delta &eacute;t&#233;", "x &lt; y", "end."]

    def words(k):
        return " ".join(rng.choice(vocab) for _ in range(k))

    def element(depth):
        mark = rng.choice(["", "", "", " class='ad'", " class='comment'", " class='share-bar'", " class='lead'"])
        kind = rng.choice(["p", "p", "p", "li", "blockquote", "div", "section", "aside", "button", "script"])
        if kind == "script":
            return "<script>if (a < b) { '<p>no</p>' }</script>"
        if kind in ("div", "section", "aside") and depth:
            return f"<{kind}{mark}>" + "".join(element(depth - 1) for _ in range(3)) + f"</{kind}>"
        inner = words(rng.randrange(2, 30)) + rng.choice(["", " <b>bold</b> ", " <span class='ad'>buy</span> ", " <i>it</i>"]) + words(3)
        return f"<{kind}{mark}>{inner}</{kind}>"

    for _ in range(150):
        body = "".join(element(2) for _ in range(8))
        page = f"<html><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>{words(4)}</h1>{body}</article><footer><p>{words(9)}</p></footer></html>"
        other = Plain()
        other.feed(page)
        other.end()
        assert main_text(page) == "\n".join(b for b in other.blocks if b)


def test_rows(spark):
    rows = [(1, "u", "<article>é</article>", "clash"), (1, "u", "<article>é</article>", "clash"), (2, None, None, None), (None, "x", "", ""), (3, "v", "<article>" + "<p>word " * 100_000, "x")]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted(map(str, got))[:2] == ["Row(page_id=1, url='u', text='é', n_chars=1)"] * 2
    assert len(got) == 5 and {r.page_id: r.n_chars for r in got}[3] == 499_999
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
