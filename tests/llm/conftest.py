import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, score double, list string, _key long"


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Plain texts, exact and near copies, shared passages, and texts that try operators."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(60, 260)) for _ in range(40)]
    passage = prose(rng, 60)
    out = list(base)
    out += base[:5] * 3
    for t in base[5:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    for t in base[12:18]:
        out.append(t + " " + passage)
        out.append(passage + "\n" + t[:200])
    out += [passage + " " + passage, "a " * 300, "", " \t\n", None, None, "one two", "one two", "é" * 150 + "日本語 " * 60, prose(rng, 20_000)]
    return dict(enumerate(out, 1))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or ""), "k", "x", 1.0, "l", 5) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated and null ids, repeated rows."""
    rng = random.Random(4)
    t = prose(rng, 120)
    rows = [(None, t), (None, None), (7, t), (7, t), (7, "other"), (8, ""), (8, "")]
    return spark.createDataFrame([(i, x, "en", "s", 1, None, None, None, None, None) for i, x in rows], SCHEMA)
