import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, rank int, key string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""
    long = prose(1, 30_000)
    near = prose(2, 200)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, long), (6, long), (7, "w " * 80), (8, "w " * 80), (9, near), (10, near + " tail"), (11, prose(3, 60) + " " + prose(4, 55)),
        (12, prose(5, 30) + " " + prose(4, 55) + " end"), (13, "Ünï  cödé\u00a0x <|endoftext|> </s> ▁▁ 漢字"), (None, prose(6, 40)), (14, "five words are just here"), (15, "FIVE words are just here"),
    ]
    return spark.createDataFrame([(i, x, None if i == 4 else "en", "src1" if i else None, None, 1, 2, "k") for i, x in rows], DOCS)


@pytest.fixture
def folder(tmp_path):
    """Writes tables where queries look for them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
