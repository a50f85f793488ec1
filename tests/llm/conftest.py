"""Documents for the corpus operators' tests: small, and with every awkward row."""

import random

import pytest

WORDS = "the of and to in river mountain house light water stone garden window paper city north morning evening table silver".split()
FREMD = "der die das und zu mit von haus licht wasser stein garten fenster papier stadt norden morgen abend tisch silber".split()


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) + (rng.choice("aeiou") * rng.randint(0, 2)) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, score) rows: nulls in any column, empty and very long texts, ties, repeats."""
    rng = random.Random(7)
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        rows.append((i, prose(rng, rng.randint(5, 160), WORDS if lang == "en" else FREMD), lang, f"s{i % 4}", "clash"))
    shared = prose(rng, 60)
    for i in range(120, 130):
        rows.append((i, prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 20), "en", "s0", "clash"))
    long = prose(rng, 30_000)
    rows += [(130, long, "en", "s1", "x"), (131, None, "en", "s1", None), (132, "", None, None, "x"), (133, " \n\t", "de", "s2", "x"), (134, "1234 !!", "en", None, "x")]
    rows += [(135, rows[3][1], None, "s3", "x"), (135, rows[3][1], None, "s3", "x"), (None, rows[5][1], "en", "s1", "x"), (136, "Öl ÉTÉ ß 中文 " * 30, "de", "s2", "x")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, score string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
