"""Brackets are an alternative of their own."""

import pytest

from paperloom.operators.packed import split_packed


@pytest.mark.parametrize(
    "text,items,flags",
    [
        ("Acme (Spain; Portugal) Ltd; Boro AG", ["Acme (Spain; Portugal) Ltd", "Boro AG"], []),
        ("Acme [a | (b | c)] Ltd | Boro AG", ["Acme [a | (b | c)] Ltd", "Boro AG"], []),
        ("Acme (Spain Ltd; Boro AG", ["Acme (Spain Ltd", "Boro AG"], ["unclosed bracket"]),
        ("Acme) Ltd; Boro AG", ["Acme) Ltd", "Boro AG"], []),
        ("Acme Ltd (in brackets, with a comma), Boro AG", ["Acme Ltd (in brackets, with a comma)", "Boro AG"], []),
        ("(" * 3000, [], ["unclosed bracket"]),
    ],
)
def test_brackets(text, items, flags):
    found, flagged = split_packed(text)
    assert found == items and (flagged == flags or not items)
