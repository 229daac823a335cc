"""Small tables with awkward rows."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        # names that operators use inside
        T.StructField("fp", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("component_id", T.LongType()),
        T.StructField("h", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("levels", T.StringType()),
    ]
)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdeoust") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def awkward_texts(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text): plain texts, copies, near copies, null, empty and blank
    texts, a very long one, repeated rows and a null id."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    for i in range(n):
        rows.append((i, " ".join(words(rng, rng.randint(1, 120)))))
    for i in range(5):
        base = rows[i][1].split()
        rows.append((100 + i, rows[i][1]))
        near = base[:]
        near[len(near) // 2] = "changed"
        rows.append((200 + i, "  ".join(near).upper()))
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "É café ñandú 日本 ①"), (None, "no id here at all"), (None, None)]
    rows.append((305, " ".join(words(rng, 30_000))))
    rows += [rows[7], rows[7], (306, "x " * 5000)]
    return rows


def docs(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "f", 0.5, -1, 2, "k", "l") for i, t in rows], DOCS)
