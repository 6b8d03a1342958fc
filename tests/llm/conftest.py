"""Small inputs with the awkward cases that every operator must take."""

import pytest

LONG = " ".join(f"long{i} word{i * 7 % 1009}" for i in range(20_000))
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture
def documents(spark):
    """Builds documents from (doc_id, text) with further columns, one with a clashing name."""

    def build(rows):
        # Names that operators use inside for their own columns.
        clashing = "class ids doc h n sketch tail selected expected_grade secrets cut_spans cut_doc gone evidence score part"
        data = [(i, t, "en", "s", None if t is None else len(t), *clashing.split()) for i, t in rows]
        names = ", ".join(f"{name} string" for name in clashing.split())
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {names}")

    return build


@pytest.fixture
def awkward(documents):
    """Nulls, empty, blank, very long, repeated and odd texts."""
    return documents(
        [
            (1, None),
            (2, ""),
            (3, " \n\t"),
            (4, LONG),
            (5, LONG),
            (6, "one two"),
            (6, "one two"),
            (None, "no id at all in this row"),
            (7, "Ünï ©ode   ﬁ 😀 " + "é" * 30),
            (8, "the same the same the same the same " * 40),
            (9, 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" <|endoftext|> it\'s'),
        ]
    )
