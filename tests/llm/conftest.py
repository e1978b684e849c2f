"""Small tables with nulls, empty and long texts, repeated rows, and columns named like the operators' own."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, doc string, batch int, score string, stratum string, queue string"


def texts(seed: int = 5, n: int = 40) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeghino") for _ in range(rng.randint(2, 8))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    out = [prose(rng.randint(25, 120)) for _ in range(n)]
    base = prose(90)
    out += [base, base, base.upper(), base.replace(base.split()[3], "changed", 1)]
    passage = prose(80)
    out += [prose(20) + " " + passage + " " + prose(15), prose(5) + "\n" + passage, "ab " * 400, prose(4000)]
    return out


@pytest.fixture(scope="session")
def nasty_rows():
    found = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts())]
    found += [(1000, None, "de", "s1"), (1001, "", "de", "s0"), (1002, " \n\t ", None, None), (None, "a row without an id " * 6, "en", "s2")]
    found += [(1003, "twice the same row " * 9, "fr", "s3")] * 2
    found += [(1004, "x", "en", "s0"), (1005, "é ñ 中文 \U0001f600 <|endoftext|> it's", "fr", "s1"), (1006, "lone\x00nul\x85next", "en", "s1")]
    return found


@pytest.fixture(scope="session")
def nasty(spark, nasty_rows):
    rows = [(i, t, lang, source, None if t is None else len(t), 1, "x", "y", 2, "z", "q", "w") for i, t, lang, source in nasty_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, nasty_rows):
    rows = [(r[0], int(len(r[1] or "") > 60), 0) for r in nasty_rows] + [(None, 1, 0), (5, None, None), (7777, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
