"""Time in proportion to the text, whatever it is made of; addresses in and beside long runs are found."""

import time

import pytest

from caselattice.llm.pii import EXAMPLE_KEY, Pseudonymiser


@pytest.mark.parametrize("unit", ["a", "a1", "a.b-", "+", "1", "1-", "1 ", "1:", "a:", "a@", "@", "a@a", "a@a.", "key=", "AB12 ", "12.", "(1)", "ghp_", "1/", "_"])
def test_time_grows_with_the_text(unit):
    """Four times the text takes about four times as long, not sixteen."""
    p, took = Pseudonymiser(EXAMPLE_KEY), []
    for size in (60_000, 240_000):
        text = "1 " + unit * (size // len(unit))
        began = time.thread_time()
        p.replace(text)
        took.append(time.thread_time() - began)
    assert took[1] < 9 * took[0] + 0.3


def test_word_characters_in_two_seconds():
    p = Pseudonymiser(EXAMPLE_KEY)
    began = time.thread_time()
    p.replace("x9 " + "QUJD" * 250_000)
    assert time.thread_time() - began < 2


def test_addresses_are_still_found():
    p = Pseudonymiser(EXAMPLE_KEY)
    for text in ("a@b@jane.doe@example.com", "<jane.doe@example.com>", "=jane.doe@example.com", "x" * 5000 + " jane.doe@example.com", "a@" + "jane@example.com"):
        new, kinds = p.replace(text)
        assert kinds == ["mail"] and new.endswith("example.com" + ">" * text.endswith(">")) and new != text
    long = "x" * 3000 + "@example.com"
    assert p.replace(long)[1] == ["mail"]
