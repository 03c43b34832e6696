import pytest

from paperloom.llm.boosting import BoostedTrees
from paperloom.llm.personal import fitted, luhn, mod97, redact_texts, replace_items
from paperloom.llm.personal_training import labelled_texts


@pytest.fixture(scope="module")
def redactor():
    return fitted()


def test_held_out_accuracy(redactor):
    texts = list(labelled_texts(600, 77))
    found = redactor.find_many([t for t, _ in texts])
    true = {(i, s, k) for i, (_, truth) in enumerate(texts) for s, _, k in truth}
    got = {(i, s, k) for i, items in enumerate(found) for s, _, k in items}
    hit = len(true & got)
    assert hit / len(true) > 0.97 and hit / len(got) > 0.97


@pytest.mark.parametrize(
    "text,items",
    [
        ("Please call Dr. Edward E. Hetiram on +34 100 55 01 59 before delivery.", [("person", 16), ("phone", 37)]),
        ("Counted 44 x 12-30-45 brackets, item A64.555.62.", []),
        ("Applicant's SSN 914 93 4000 was checked by Legal.", [("id_number", 16)]),
        ("Bawibum Avenue Hotel Ltd shipped 12 cartons; freight COP 4.331.320.", []),
        ("Mail fafiband_james [at] correo [dot] example", [("email", 5)]),
        ("Pay into [REDACTED:iban] quoting lot 47630488.", []),
    ],
)
def test_items(redactor, text, items):
    assert [(k, s) for s, _, k in redactor.find(text)] == items


def test_checks():
    assert luhn("4242424242424242") and not luhn("4242424242424241") and mod97("DE89370400440532013000") and not mod97("DE88370400440532013000")
    assert replace_items(None, []) is None and replace_items("ab", [(0, 1, "x")]) == "[REDACTED:x]b"


def test_redact_texts_survives_dirt(spark):
    long = "word " * 30000 + "Contact: Henry Seheho Gokecond"
    rows = [(1, None), (2, ""), (3, "   \n"), (4, long), (5, "a.b@c.example"), (5, "a.b@c.example"), (6, "[REDACTED:email]"), (7, "ok")]
    got = redact_texts(spark.createDataFrame(rows, "id int, t string"), ["id"], "t").orderBy("id").collect()
    by = {r.id: r for r in got}
    assert len(got) == len(rows) and by[1].redacted_text is None and by[4].redacted_text.endswith("[REDACTED:person]")
    assert by[5].redacted and by[6].redacted and not by[7].redacted and not by[3].redacted
    assert redact_texts(spark.createDataFrame([], "id int, t string"), ["id"], "t").count() == 0


def test_trees_learn_an_interaction():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (2000, 6)).astype(float)
    y = x[:, 1] != x[:, 4]
    assert ((BoostedTrees().fit(x, y).predict(x) > 0.5) == y).mean() > 0.99
    assert BoostedTrees().fit(x[:0], y[:0]).predict(x[:3]).shape == (3,)
