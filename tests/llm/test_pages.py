"""Pages as blocks: hostile markup by hand, and a second parser over whole tables."""

import time
from html.parser import HTMLParser

import pytest

from braidline.llm import html_text

CASES = {
    '<article><svg class="i"/><p>One</p><p>Two</p></article>': ["One", "Two"],
    '<svg class="i"/><article><p>One</p></article>': ["One"],
    "<html><head><title>t</title><div><article><p>Hello": ["Hello"],
    "<html><head><meta charset=x>Hello<p>you": ["Hello", "you"],
    "<p>a <video src=x> no player </p><p>b</p>": ["a", "b"],
    "<p>a <audio src=x> no player <p>b</p>": ["a", "b"],
    "<div><video><source src=x><p>No player</p></video><p>b</p></div>": ["b"],
    "<p>One <svg><path d='x'><g></svg> two</p><p>Three": ["One two", "Three"],
    "<p>One <svg><path d='x'><g></p><p>Two": ["One", "Two"],
    "<div>One <svg><path><p>Two</p></div><div>Three": ["One", "Two", "Three"],
    "<svg><title>Icon</title><style>a</style><text>drawn</text></svg>Two": ["Two"],
    "<svg><script/></svg><p>Two": ["Two"],
    "<p>One <script>var x = '<p>'</script> two</p>": ["One two"],
    "<p>One <object data=x><p>fallback</p></object> two</p>": ["One two"],
    "<p>One <template><div>x</div></template> two": ["One two"],
    "<p>If <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> then</p>": ["If x=2 then"],
    "<p>If <math><mi>x</mi><annotation encoding='t'>\\x</annotation></math> then</p>": ["If x then"],
    "<p>If <math><mi>x<p>then": ["If x", "then"],
    "<p>If <math><mrow>x<p>then": ["If x", "then"],
    "<p>&#0000000065;&#x000000042; &#0; &#00a &#99999999999; &#x41;": ["AB � �a � A"],
    "<p>a <select><option>x<option>y</select> b": ["a b"],
    "<p>a <select><option>x<p>b": ["a", "b"],
    "<svg><foreignObject><p>shown</p></foreignObject><text>not</text></svg>": ["shown"],
    "<p>a<br>b</br>c": ["a b c"],
}


@pytest.mark.parametrize("page", CASES)
def test_markup_by_hand(page):
    assert [b.text for b in html_text.blocks(page)] == CASES[page]


def test_no_depth_is_too_deep():
    """What names the article or the menu counts however far out it is."""
    deep = "<div>" * 300
    close = "</div>" * 300
    page = html_text.blocks(f"<nav>{deep}<p>menu</p>{close}</nav><article>{deep}<p>text</p>{close}</article>")
    assert html_text.teach(page) == [0, 1]
    menu, text = (path for path, _, _ in html_text.features(page, {}))
    assert html_text._slot("nav", html_text.PATHS) in menu and html_text._slot("article", html_text.PATHS) in text and menu != text


def test_foreign_markup_costs_its_length():
    start = time.time()
    for page in ("<svg>" * 40_000 + "<p>x", "<svg><p>x" * 40_000, "<math><mi>x" * 40_000, "<p><object>" * 40_000 + "<p>x", "<video>" * 40_000 + "x", "<svg><foreignObject>" * 20_000 + "<p>x" * 20_000, "&#" + "0" * 400_000 + "65;", "<head>x" * 40_000, "".join(f'<b class="c{i}">' for i in range(40_000)) + "<p>x" * 20_000):
        html_text.blocks(page)
    assert time.time() - start < 60


class Second(HTMLParser):
    """Another reader of pages that close what they open: texts between the tags that end a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.off = [], "", 0

    def cut(self):
        if self.text.split():
            self.out.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title", "textarea", "noscript", "select", "svg", "iframe")
        if tag == "br":
            self.text += " "
        elif not self.off and tag not in html_text.INLINE:
            self.cut()

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title", "textarea", "noscript", "select", "svg", "iframe")
        if not self.off and tag not in html_text.INLINE | html_text.EMBEDDED:
            self.cut()

    def handle_data(self, data):
        if not self.off:
            self.text += data


def test_a_second_parser_over_whole_tables(spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        second = Second()
        second.feed(row.html or "")
        second.close()
        second.cut()
        assert [b.text for b in html_text.blocks(row.html)] == second.out, row.page_id
