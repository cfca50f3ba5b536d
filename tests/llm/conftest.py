import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, loops, nulls, empties and repeated rows."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(60), words(40), words(34), words(35)]
    texts = [words(rng.choice([3, 20, 80, 150])) for _ in range(40)]
    for _ in range(25):
        t = words(30)
        for p in rng.sample(passages, 2):
            at = rng.randrange(len(t))
            t = t[:at] + p + t[at:]
        texts.append(t)
    base = words(120)
    for _ in range(12):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = "edit" + str(rng.randrange(99))
        texts.append(near)
    texts += [texts[3], texts[5], ["loop"] * 90, ["a", "b", "c"] * 40, ["x"] * 35, ["ünï", "çödé", "日本"] * 14, ["one"], ["one"]]
    rows = [(i, rng.choice([" ", "  "]).join(t[: len(t) // 2]) + "\n" + "\t".join(t[len(t) // 2 :]), "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, " \n\t ", "en", "s0", 3), (None, " ".join(base), "en", None, 1), rows[2], rows[2], (rows[4][0], "same id other text", "en", "s1", 9)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
