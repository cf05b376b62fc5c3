import random

import pytest

#: Names that operators use inside; a table may have them too.
CLASHES = {"id": 1, "text_a": "x", "mark": 2, "host": "h", "key": 3, "n": 4, "h": 5, "pos": 6, "a": 7, "_id": 8, "start": 9, "_row": 1, "_text": "t", "length": 1, "w": 2}


def corpus(seed=1):
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, blank, short, accented and long texts, repeated rows."""
    random.seed(seed)
    word = lambda: "".join(random.choice(["th", "er", "é", "on", "an", "re", "ü", "ing"]) for _ in range(random.randrange(1, 4)))
    text = lambda n: " ".join(word() + ("\n" if random.random() < 0.08 else "") for _ in range(n))
    base, passage = text(160), text(60)
    rows = [(0, base), (1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one two"), (6, base), (7, base.upper())]
    for i in range(8, 20):
        words = base.split(" ")
        for _ in range(i // 2):
            words[random.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(i, text(random.randrange(50, 120)) + "\n" + passage + "\n" + text(30)) for i in range(20, 32)]
    rows += [(32, text(6000)), (33, "ab " * 400), (34, "ab " * 300), (35, "x" * 5000), (6, base), (36, "### $$ !! 日本語 １２３")]
    rows += [(None, base), (None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en", None if i == 3 else f"src{(i or 0) % 2}", None, *CLASHES.values()) for i, t in rows]
    kinds = ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'long'}" for k, v in CLASHES.items())
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)
