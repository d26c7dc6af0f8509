import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ord int, th string, bucket string"
WORDS = [a + b for a in ("ba", "ko", "lu", "mi", "ne", "pra", "sto", "ti") for b in ("", "da", "ren", "sul", "vik", "wo")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with the operators' inner names."""
    passage, base = prose(1, 70), prose(2, 200)
    near = base.split()
    near[100] = "changed"
    texts = {
        1: base, 2: " ".join(near), 3: base, 4: prose(3, 150) + " " + passage, 5: passage + "\n" + prose(4, 30), 6: "", 7: None, 8: "  \t\n ", 9: "one two", 10: "ONE two",
        11: prose(5, 9000), 12: "ab" * 900, 13: "Und " * 400, 14: "é ñ ü " * 60, 15: prose(6, 49), 16: prose(6, 49) + " tail", 17: passage + " " + passage, 18: "!!! ??? ###",
        19: prose(7, 60), 20: prose(7, 60) + " " + prose(8, 5), 21: prose(9, 50), 22: prose(9, 50),
    }
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    rows += [(1, base, "en", "s1", len(base)), (None, base, None, None, None), (None, None, None, None, None), (9, prose(10, 80), "en", "s0", 1)]
    return [(*r, None, "x", None) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
