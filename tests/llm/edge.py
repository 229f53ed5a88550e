"""Documents that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key long, n long, row long, node long, pos int, "
          "shard int, term string, salt int, bucket int, component long, chosen_id long, grams string, score double")


def words(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeéü") for _ in range(draw.randint(1, 6))) for _ in range(n))


BASE = words(60, 1)
TEXTS = [
    (1, BASE), (2, BASE.replace(" ", "\n\t", 3)), (3, BASE + " more words"), (4, None), (5, ""), (6, " \n\t "), (7, "!!! ... ###"),
    (8, words(30_000, 2)), (9, "x" * 200_000), (10, "Zzz"), (11, "zzz"), (12, "ÀB c D e"), (13, "Àb C d E"), (14, words(3, 3)), (15, words(3, 3)),
    (16, BASE), (16, BASE), (17, "one text"), (17, "another text of the same id with some words"), (None, BASE), (None, None), (None, "alone here"),
    (-3, words(60, 4)), (18, words(60, 4)), (19, "日本語のテキスト <|endoftext|> \U0001f600"),
]
ROWS = [(i, t, None if k % 5 == 0 else "en", f"s{k}", None, 1, 1, 1, 1, 1, 1, "t", 1, 1, 1, 1, "g", 1.0) for k, (i, t) in enumerate(TEXTS)]


def docs(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
