"""A few hand-made documents with nulls, empty and long texts, ties, copies and a clashing extra column."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus() -> list[tuple]:
    base = " ".join(words(1, 120))
    passage = " ".join(words(2, 60))
    texts = [
        (1, base), (2, base), (3, base.replace(" ", "\n ", 3)), (4, base + " end"), (5, None), (6, ""), (7, " \t\n"),
        (8, " ".join(words(3, 40)) + " " + passage + " " + " ".join(words(4, 30))),
        (9, " ".join(words(5, 70)) + " " + passage), (10, passage + " " + " ".join(words(6, 20))),
        (11, "Größe 😀 naïve  123 – ok"), (12, "x" * 3000), (13, "la la " * 400), (14, " ".join(words(7, 5000))),
        (None, "no id here at all"), (15, "one"), (15, "one"), (16, "two words"), (17, "??? 123"),
    ]
    return [(i, t, "en" if i and i % 3 else None, f"s{i % 4}" if i and i % 5 else None, 0, 7, 8) for i, t in texts]


def documents(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)
