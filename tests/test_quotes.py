"""Quotes against brute force: places in the original, overlaps, folding, and the faults of drafts."""

import re

import pytest

from quern.operators import quotes


def plain(text):
    """By the rule, character by character."""
    stripped = re.sub(r"<[^<>\n]{1,80}>", "", re.sub(r"\{\{<[^}]{0,80}>\}\}", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)))
    return re.sub(r"[\s*`_>#|\-\[\]+()]+", "", stripped).casefold()


TEXTS = [
    "See **the [linked text](http://x/y)** here,\nand the Linked\n> text again.", "Stra\u00dfe STRASSE stra\u00dfe", "aaaa a-a", "{{< note >}}<b>bold</b> words | cells |",
    "\u4e2d\u6587 \uff21\uff22 text", "", None, "x" * 20_000 + " needle " + "y" * 20_000,
]
QUOTES = ["the linked text", "strasse", "aa", "bold words", "words cells", "\u4e2d\u6587", "** __", None, "needle", "missing", "linked\ntext"]


def test_normal_forms():
    for t in TEXTS:
        if t is not None:
            form, places = quotes.normalised(t)
            assert form == plain(t) and len(places) == len(form) and places == sorted(places)


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_places_equal_brute_force(rows, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK_BYTES", block)
    got = quotes.quote_places(rows("doc_id long, text string", list(enumerate(TEXTS))).repartition(3), rows("quote_id int, quote string", list(enumerate(QUOTES))))
    want = []
    for q, quote in enumerate(QUOTES):
        needle = plain(quote) if quote else ""
        for d, text in enumerate(TEXTS):
            if not needle or text is None:
                continue
            form, places = quotes.normalised(text)
            want += [(q, d, places[i], places[i + len(needle) - 1] + 1) for i in range(len(form)) if form.startswith(needle, i)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 12
    first = next(w for w in want if w[:2] == (0, 0))
    assert TEXTS[0][first[2] : first[3]] == "the [linked text"


def test_faults_of_drafts(rows):
    drafts = rows("task_id string, category string, expected_status string, sources array<string>", [
        ("ok", "single", "answered", ["a"]), ("none", "single", "answered", []), ("multi", "multi_document", "refused", ["a", "a"]), ("bad", "single", "answered", ["a", "zz"]),
    ])
    said = rows("task_id string, n int, source string, quote string", [
        ("ok", 0, "a", "Some **words**"), ("bad", 0, "a", "not there"), ("bad", 1, "yy", "some words"), ("bad", 2, "b", "other text"),
    ])
    docs = rows("doc_id string, text string", [("a", "here are some\nwords"), ("b", "Other _text_")])
    assert sorted(map(tuple, quotes.draft_faults(drafts, said, docs).collect())) == sorted([
        ("none", "no_sources", ""), ("multi", "one_source", ""), ("bad", "unknown_source", "zz"), ("bad", "quote_not_found", "0"),
        ("bad", "quote_of_unknown_source", "1"), ("bad", "source_without_quote", "zz"),
    ])
