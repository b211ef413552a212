"""Copies of a notice that lack the word which is rarest in the text."""

from logloom.llm import licenses


def test_copies_without_the_rarest_word_are_found():
    template = licenses.license_words(licenses.TEMPLATES["Apache-2.0-line"].encode())
    notice = b"Licensed under the Apache License 2.0"
    for n in (1, 2):
        middle = b" version 1.0 of the apache under license licensed 2 0" * n + b" other words" * 200
        found = licenses.best(template, licenses.license_words(notice + b" filler" * 50 + middle + b" filler" * 50 + notice))
        assert len(found) == 7
