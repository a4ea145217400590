"""Pages whose names or forms once took the article with them."""

import pytest

from apexframe.llm.html_extract import Page

CASES = {
    "values of other attributes": ("<p data-id='ad'>one</p><div data-role='banner'>two</div><p title='set class=ad here'>three</p><p>four</p>", "one two three four"),
    "quotes, case and order": ("<div title=\"a 'b' class=x\" CLASS = 'ad'>gone</div><div id=ad class=story>gone</div><p>kept</p>", "kept"),
    "the first of two attributes of one name": ("<div class=story class=ad>kept</div>", "kept"),
    "anchors of headings": ("<article><h2 id='navigation'>Navigation</h2><p>text</p><h3 id=comments>Comments</h3><p>more</p></article>", "Navigation text Comments more"),
    "a form around the page": ("<form id='aspnetForm'><div><p>First paragraph.</p><p>Second.</p></div><input><button>Go</button><select><option>x</select></form>", "First paragraph. Second."),
    "a form around an article": ("<form><article><p>Text of it.</p></article></form>", "Text of it."),
    "a form below the text": ("<p>A text that is longer than what the form says.</p><form><p>Write to us</p></form>", "A text that is longer than what the form says."),
    "a form alone": ("<form><label>Search this site</label><input></form>", ""),
    "a form beside an article": ("<article><p>Short.</p></article><form><p>A long invitation to write to the editors of this page.</p></form>", "Short."),
}


@pytest.mark.parametrize("name", CASES)
def test_text(name):
    source, expected = CASES[name]
    assert Page(f"<html><body>{source}</body></html>").text(None) == expected


def test_odd_attributes_neither_fail_nor_hang():
    for junk in ("=", "''", '"', "a=", "= =", "/ /", "class", "class=", "a'b\"c", "=" * 5000, "a=" * 5000, "' " * 5000):
        assert Page(f"<div {junk}><p>x</p></div>") is not None
