import random

import pytest

_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, row long, words string, fp long, "
    "mix string, sha string, told int, label string, body string, kept boolean, drawn int, content string, host string"
)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    shared, long_text = words(rng, 30), words(rng, 4000)
    texts = [words(rng, 60) for _ in range(20)]
    texts += [texts[0], texts[0] + " tail", words(rng, 20) + "\n" + shared + "\n" + words(rng, 20), shared, long_text, long_text[50:]]
    texts += ["", None, " \t\n", "one", "a" * 300, "a" * 300, "###\n###\n" + "x y z " * 40]
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "a", None, "b"][k % 4], 1) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None), (None, None, "en", "a", 0), (40, texts[5].upper(), "en", "a", 0)]
    return [(*r, 7, 7, "w", 7, "m", "s", 7, "l", "b", True, 7, "c", "h") for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), _SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], _SCHEMA)
