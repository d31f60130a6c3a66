import random

import pytest

SCHEMA = "doc_id long, text string, n long, score double, token string, h string, node string, pos int, lines string, a long, b long"


def make(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 0.5, "t", "h", "n", 3, "l", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    r = random.Random(1)
    vocab = ["".join(r.choice(["th", "er", "on", "an", "re", "ti", "é", "ß"]) for _ in range(r.randint(1, 5))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    line = prose(12) + " a line that many documents hold, word for word"
    rows = []
    for i in range(60):
        t = prose(r.randint(5, 120))
        if i % 6 == 0:
            t += "\n" + (line.upper() if i % 12 == 0 else f"  {line}\t")
        rows.append((i, t))
    base = rows[7][1].split()
    for k in range(6):  # near copies, each with one word changed
        w = list(base)
        w[k * 3 % len(w)] = f"changed{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (5, rows[5][1]), (202, ""), (203, None), (None, "no id here"), (None, None), (204, "two words"), (205, "two words"), (206, prose(9000)), (207, "\n\n"), (208, "x" * 5000), (209, "Ünï 日本 <|endoftext|> \x1c\x85 İx ſ")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return make(spark, texts).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, []).cache()
