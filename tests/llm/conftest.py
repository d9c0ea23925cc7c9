import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, TEXT_SCHEMA)

    return build


def words(seed, n, bank=None):
    """n invented words that depend on the seed."""
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(bank) if bank else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture
def prose():
    return words


#: Rows that every operator must take: nulls, empties, blanks, ties, repeats, a very long text.
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id at all"),
    (6, "é ü ñ 中文   x"), (7, "word " * 20000), (8, "a" * 5000), (9, "line\nline\nline\n"), (10, "x <|endoftext|> y"),
]


@pytest.fixture
def awkward():
    return list(AWKWARD)
