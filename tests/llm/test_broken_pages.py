"""A page takes time in proportion to its length, however it is broken."""

import time

import pytest
from ledgerloom.llm import html_extract

FORMS = {"tags": "<a ", "quotes": '<p title="', "declarations": "<! ", "ends": "</ ", "blocks": "<div>", "cells": "<td>a", "comment": "<!-- ", "script": "<script>", "mixed": "<a '\" "}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_a_megabyte_of_it(name):
    began = time.process_time()
    page = html_extract.parse("<p>start of it</p>" + FORMS[name] * (1_000_000 // len(FORMS[name])))
    html_extract.forest([page])
    assert "start of it" in page.block and time.process_time() - began < 40


def test_unmatched_ends_and_deep_inline_elements():
    began = time.process_time()
    page = html_extract.parse("<b>" * 100_000 + "<li>x</li>" * 50_000 + "</i>" * 100_000)
    assert page.block.count("x") == 50_000 and time.process_time() - began < 40


def test_an_open_tag_ends_at_the_next():
    assert [b for b in html_extract.parse("<p class=x <b>one</b> two<p>three").block if b] == ["one two", "three"]
