import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns under names that operators might use themselves.
CLASHING = "stats string, score double, of string, listed string, hit string, one int, two int, scan string, id int, size int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows and ids, passages shared by many."""
    rng = random.Random(5)
    passage = words(rng, 70)
    long = words(rng, 30_000, 5000)
    near = words(rng, 300, 5000).split()
    rows = [
        (None, None, None, None, None),
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", None, 4),
        (4, "one", None, "a", 3),
        (None, "two words", "en", "b", 9),
        (5, long, "en", "b", len(long)),
        (6, long, "en", "c", len(long)),
        (None, long, "en", "c", len(long)),
        (7, "a" * 5000, "en", "c", 5000),
        (8, "ab" * 150 + "é" * 120 + "ab" * 150, "fr", "c", 720),
        (9, "Straße ÉTÉ été 東京 tokyo x", "de", "c", 10),
    ]
    rows += [(10 + i, words(rng, 40) + "\n" + passage + "\n" + words(rng, 60), "en", "abc"[i % 3], 0) for i in range(24)]
    for i in range(12):
        edited = list(near)
        for _ in range(i // 3):
            edited[rng.randrange(300)] = f"x{i}"
        rows.append((40 + i, " ".join(edited), "en", "d", 0))
    rows += [(60 + i, words(rng, rng.choice([30, 80, 200])) + "\nHome | About", "en", "site", 0) for i in range(40)]
    rows += [rows[12], rows[12], (10, "another text with the id of another", "en", "a", 0), rows[0]]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    extra = (None,) * 10
    return spark.createDataFrame([r + extra for r in odd_rows], f"{COLUMNS}, {CLASHING}").repartition(5).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
