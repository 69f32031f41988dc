import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("th", "on", "er", "ouv", "é", "sch", "qu") for b in ("e", "and", "ion", "ß", "ing", "a1")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): plain texts, near copies in a chain and a star, copies, repeats, odd and empty ones."""
    rng = random.Random(3)
    out = [(i, prose(rng, rng.choice((3, 8, 40, 120)))) for i in range(60)]
    base = prose(rng, 90).split()
    for i in range(25):  # near copies of one base
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(90)] = rng.choice(WORDS)
        out.append((100 + i, " ".join(near)))
    chain = list(base[:60])
    for i in range(12):  # each a step from the one before
        chain[rng.randrange(60)] = rng.choice(WORDS)
        out.append((200 + i, "\n".join(chain)))
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "!!! ... ???"), (304, "one two three"), (305, "ONE  two\tthree"), (306, "x" * 50_000), (307, prose(rng, 20_000))]
    out += [(310 + i, out[5][1]) for i in range(40)] + [(400, out[7][1])] * 2
    out += [(500, "漢字 кириллица \U0001F600 ▁ \0 a b c")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with a language and columns whose names an operator might use itself."""
    rng = random.Random(4)
    rows = [(i, t, rng.choice(("en", "fr", None)), rng.choice(("a", "b", None)), len(t or "")) for i, t in texts]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n", "key", "class", "root", "row", "items", "spans", "score", "size", "shard", "part", "cell", "first", "ids", "digest", "license", "good", "ref"):
        frame = frame.withColumn(name, F.lit("extra"))
    return frame.repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
