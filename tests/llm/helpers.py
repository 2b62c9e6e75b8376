"""Small documents with the awkward cases every operator must handle, and plain versions of shared rules."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string, n long, rep long, block string"


def words(text):
    return WORD.findall(text or "")


def texts(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Été", "naïve", "x", "word", "Übung", "token", "a", "edge", "1234", "中文", "!!", "|", "foo-bar"]
    draw = lambda k: " ".join(rng.choice(vocabulary) + (rng.choice("abcdefgh") if rng.random() < 0.7 else "") for _ in range(k))
    passage, base = draw(45), draw(120)
    out = [None, "", " \t\n", "one", "One", "two words", "ONE", "a\n\na\n a", base, base, base.upper(), base + " end", "start " + base, base.replace("the", "teh", 1)]
    for i in range(n):
        body = draw(rng.randint(1, 150))
        out.append(body if i % 4 else f"{body}\n{passage}  {draw(5)}\n{body[:200]}")
    out += [base + " " + draw(1) for _ in range(12)] + [draw(3000), "z" * 20_000, ("loop " * 400).strip()]
    return out


def documents(spark, values=None):
    """Ids in no order, with extra columns whose names clash with ones that operators use inside."""
    values = texts() if values is None else values
    rows = [((i * 37) % 1009, t, "en", "src0", None if t is None else len(t), "p", 7, 3, "b") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def as_dict(values):
    return {(i * 37) % 1009: t for i, t in enumerate(values)}
