"""HTML on hostile pages, on what is hidden, and against a plain reading of the words of whole pages."""

import re
import time
from html.parser import HTMLParser

import duckdb
import pytest

from shotline.llm import html_text

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("unit", ["<a ", "<a 'x", '<a "\'', "<", "<!", "<!-- ", "</p", "<b>", "<a b='1' ", "<div hidden>", "<td>", "<textarea", "<script>", "&lt;", "<a \"' ", "<table><tr><td>", "<select><option>", "<a<a '"])
def test_time_is_linear(unit):
    """Ten times the page takes about ten times as long, or next to nothing."""
    html_text.render(unit * 100)
    took = []
    for n in (2_000, 20_000):
        began = time.process_time()
        html_text.render(unit * n)
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0] + 0.2, took


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div>" * 300 + "<p hidden>secret <p>x</p></p><b style='display:none'>no <b>no</b> no</b>shown", "shown"),
        ("<div>" * 300 + "<script>if (a < b) {}</script><div hidden><script></div></script>no</div>yes", "yes"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>end", "yes\n\nend"),
        ("<table><tr><td style='visibility:hidden'>no<td>b<tr><td>cc<td>d</table>", "   | b\ncc | d"),
        ("<table><tr><td colspan=120>w<tr><td>a<td>b</table>", "w\na | b"),
        ("<a href='x'>1</a><a title=\"a > b\">2</a><a t='>'>3", "123"), ("<a 'x>y<b>z", "<a 'x>yz"), ("x <y <b>z</b>", "x z"), ("<!doctype html>a<?php x ?>b", "ab"), ("a <!-- open", "a"),
    ],
)
def test_hidden_and_broken(page, text):
    assert html_text.render(page) == text


class Plain(HTMLParser):
    """The words outside of elements that are never shown."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], []

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        if tag not in html_text._VOID and (tag in html_text._HIDDEN or "hidden" in dict(attrs) or re.search(r"display\s*:\s*none", style) or self.off):
            self.off.append(tag)

    def handle_endtag(self, tag):
        if tag in self.off:
            del self.off[len(self.off) - 1 - self.off[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_words_of_whole_pages():
    """The words of every page of the table, in order, marks of lists and tables aside."""
    rows = duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    bare = lambda t: re.findall(r"\w+", t)
    for (page,) in rows:
        plain = Plain()
        plain.feed(page)
        plain.close()
        text = re.sub(r"^(?:[ >]*(?:- |\d+\. ))+", "", html_text.render(page), flags=re.M)
        assert bare(text) == bare("".join(plain.words)) or sorted("".join(bare(text))) == sorted("".join(bare("".join(plain.words))))
