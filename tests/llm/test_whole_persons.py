"""Persons are found whatever their given name."""

import random

import pytest

from paperloom.llm.names import NearIndex, given_names
from paperloom.llm.personal import KINDS, fitted, propose
from paperloom.llm.personal_training import _Writer
from paperloom.llm.segment_join import banded


@pytest.mark.parametrize("text,name", [
    ("Questions to Sofia Rossi, tel. 555.", "Sofia Rossi"), ("Signed: Ingrid Weber", "Ingrid Weber"), ("Contact: J Smith", "J Smith"), ("Author: ROSSI, SOFIA", "ROSSI, SOFIA"),
    ("Please call Dr. Priya Kapoor before noon.", "Priya Kapoor"), ("Attn: Ingrid Maria Weber", "Ingrid Maria Weber"), ("Sofia de la Cruz confirmed the amount.", "Sofia de la Cruz"),
])
def test_names_outside_the_list_are_found(text, name):
    assert not any(given_names(w) for w in ("sofia", "ingrid", "priya"))
    assert [(text[a:b], k) for a, b, k in fitted().find(text)] == [(name, "person")]


@pytest.mark.parametrize("text", ["Human Resources", "State of Norvale", "Port Melisk", "Sigumox Lifexith Energy Cooperative", "Governing Law: State of Norvale.", "Batch closed by Human Resources, 12 lines open."])
def test_other_capitalised_runs_are_no_persons(text):
    assert fitted().find(text) == []


def test_lower_case_words_after_a_cue_are_proposed():
    assert (12, 23, "person") in {c[:3] for c in propose("approved by sofia rossi.")}


class _Unseen(_Writer):
    """Writes like the training's writer, with given names made up anew for each person."""

    def person(self):
        self.given, self.short = [self.made_up().lower() for _ in range(20)], [self.made_up().lower() for _ in range(5)]
        return super().person()


def test_recall_and_precision_with_given_names_outside_the_list():
    writer = _Unseen(99)
    texts = [writer.text() for _ in range(700)]
    found = fitted().find_many([t for t, _ in texts])
    for kind, least in [("person", 0.92), *((k, 0.97) for k in KINDS if k != "person")]:
        true = {(i, s) for i, (_, truth) in enumerate(texts) for s, _, k in truth if k == kind}
        got = {(i, s) for i, items in enumerate(found) for s, _, k in items if k == kind}
        assert len(true & got) >= least * len(true) and len(true & got) >= 0.96 * len(got), kind


def test_company_tax_ids_alone_are_no_phones():
    assert fitted().find_many(["810.679.909-2", "NIT: 862.183.807-9", "865751859-1"]) == [[], [], []]


@pytest.mark.parametrize("text,span", [("Adresse: Via Garibaldi 12", "Via Garibaldi 12"), ("Home address on file: 12 Piazza Navona.", "12 Piazza Navona"), ("El solicitante vive en Rua do Sol, 45.", "Rua do Sol, 45")])
def test_addresses_of_other_countries(text, span):
    assert [(text[a:b].rstrip("."), k) for a, b, k in fitted().find(text)] == [(span, "address")]


def test_many_items_in_one_long_text():
    text = "Mail a.bc@de.example, [REDACTED:person] lives.\n" * 3000
    assert len(fitted().find(text)) == 3000


def test_index_of_near_words_is_exact():
    r = random.Random(4)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(3, 9))) for _ in range(60)]
    index = NearIndex(words, 2)
    for _ in range(300):
        w = "".join(r.choice("abc") for _ in range(r.randrange(1, 10)))
        for k in (1, 2):
            assert index.near(w, k) == [x for x in dict.fromkeys(words) if banded(w, x, k) <= k]
