"""Values followed by digits or capitals that the pattern swallows."""

import re

import pytest

from caselattice.llm.pii import IBAN_LENGTHS, Pseudonymiser, iban_check, luhn_digit


@pytest.mark.parametrize("value,rest", [
    ("4111 1111 1111 1111", " 12/25"), ("4111111111111111", " 123"), ("4111-1111-1111-1111", " 12"), ("4111 1111 1111 1111", " 1 2 3"),
    ("DE89370400440532013000", " BIC COBADEFF"), ("DE89 3704 0044 0532 0130 00", " EUR 500"), ("NO93 8601 1117 947", " KID 12345"),
])
def test_value_before_more(value, rest):
    text, kinds = Pseudonymiser(b"key").replace(f"x {value}{rest}, y")
    new = text.removeprefix("x ").removesuffix(f"{rest}, y")
    assert len(kinds) == 1 and new != value and re.sub(r"[A-Z0-9]", "0", new) == re.sub(r"[A-Z0-9]", "0", value)
    plain = re.sub(r"[ -]", "", new)
    assert new == Pseudonymiser(b"key").replace(value)[0]
    assert iban_check(plain[:2], plain[4:]) == plain[2:4] if kinds == ["iban"] else luhn_digit(plain[:-1]) == plain[-1]


def test_two_cards_in_a_row():
    text, kinds = Pseudonymiser(b"key").replace("4111 1111 1111 1111 5500 0000 0000 0004")
    assert kinds == ["card", "card"] and "1111 1111" not in text and "0000 0000" not in text


def test_later_kind_at_the_same_place():
    text, kinds = Pseudonymiser(b"key").replace("call 555-123-4567 1235 now")
    assert kinds == ["phone"] and text.endswith(" 1235 now") and "555-123-4567" not in text


def test_numbers_that_are_no_value_stay():
    for text in ("4111 1111 1111 1112 12/25", "DE88 3704 0044 0532 0130 00 EUR 500", "order 1234 5678 9012 3456 78"):
        assert Pseudonymiser(b"key").replace(text) == (text, [])
    assert len(IBAN_LENGTHS) > 80
