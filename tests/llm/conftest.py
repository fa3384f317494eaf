import random
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from wattloom.session import local_session
    s = local_session()
    s.sparkContext.environment["PYTHONPATH"] = ROOT          # Python workers find the package from any working folder
    return s


@pytest.fixture(autouse=True)
def few_blocks(monkeypatch):
    """Small tables need few blocks; the results don't depend on their number."""
    from wattloom.llm import common
    monkeypatch.setattr(common, "LEAST_BLOCKS", 5)


def words(rng, n):
    return [rng.choice(["the", "of", "a", "in", "to"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, a hot group, edges of every kind, one row twice and two null ids."""
    rng = random.Random(7)
    bases = [words(rng, rng.choice([3, 30, 90, 200, 400])) for _ in range(30)]
    passage = words(rng, 60)
    out = [" ".join(b) for b in bases]
    out += [" ".join(bases[i]) for i in (1, 2, 2, 5, 7)]
    for _ in range(40):                                       # one hot group of near copies
        w = list(bases[4])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "zz"
        out.append(" ".join(w))
    for _ in range(25):
        w = words(rng, rng.randint(40, 120))
        at = rng.randrange(len(w))
        out.append(" ".join(w[:at] + passage + w[at:]))
    out += [None, "", " \n\t ", "one", "One", "two words", "TWO Words", "a b c d e", "a b c d e", "x" * 5000, "q " * 900, "é ü " * 300, "é ü " * 300, "a b c\x0bd", " ".join(words(rng, 20000))]
    rows = [(i, t) for i, t in enumerate(out)]
    rng.shuffle(rows)
    return rows + [rows[0], (None, out[0]), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names clash with those the operators use."""
    rows = [(i, t, "en", "src", len(t or ""), 1, "x", 2, 3, None) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int, shard string, n long, component_id long, _text string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
