"""Pages that leave out </head>."""

import pytest

from ledgerloom.llm import html_extract

STORY = "<article><h1>Long title</h1><p>A first paragraph of the story, with a few words more.<p>A second one of the same length, and then some.</article>"
PAGES = {
    "body": f"<html><head><title>T</title><meta charset=utf-8><body class=x>{STORY}</body></html>",
    "no body": f"<!doctype html><head><title>T</title><link rel=x href=y><style>p {{}}</style><script>1</script>{STORY}",
    "template": f"<head><template><p>unseen</p></template><title>T</title><body>{STORY}",
    "closed": f"<html><head><title>T</title></head><body>{STORY}</body></html>",
}


def blocks(html):
    return [b for b in html_extract.parse(html).block if b]


@pytest.mark.parametrize("kind", PAGES)
def test_head_ends_where_the_body_starts(kind):
    assert blocks(PAGES[kind]) == ["Long title", "A first paragraph of the story, with a few words more.", "A second one of the same length, and then some."]


def test_text_ends_a_head():
    assert blocks("<head><title>T</title> \n <!-- c -->Plain text<br>goes on") == ["Plain text goes on"]


def test_extraction_of_an_open_head(spark):
    model = html_extract.fit(html_extract.labelled_pages(150), steps=120)
    rows = [(i, "http://a", html) for i, html in enumerate(PAGES.values())]
    texts = {r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(texts) == 1 and "second one" in texts.pop()
