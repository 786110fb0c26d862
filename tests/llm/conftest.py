import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) with the columns of documents and two more whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "x", 1) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def texts():
    """Odd and ordinary texts: nulls, empty, white space, one very long, copies, near copies, shared passages."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgéñß") for _ in range(rng.randint(1, 9))) for _ in range(600)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(70)
    rows = [(0, None), (1, ""), (2, "  \n "), (3, say(20000)), (4, "One two it's İstanbul 42,7. don't <|endoftext|> \x1c x"), (5, "word")]
    rows += [(6 + i, say(rng.randint(3, 200)) + "\n" + say(8) + ".\n" + say(12)) for i in range(40)]
    rows += [(50, rows[10][1]), (51, rows[10][1]), (52, rows[11][1] + " more"), (53, rows[12][1].replace("a", "A", 3))]
    rows += [(60, say(40) + " " + passage + " " + say(30)), (61, say(55) + " " + passage + " " + say(9)), (62, passage)]
    rows += [(70 + i, rows[20][1] + f"\n{say(7)}") for i in range(4)]
    return rows + [rows[15]]
