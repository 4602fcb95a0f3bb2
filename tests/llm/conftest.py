import random
import re

import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER) if lower else text or "")


def corpus(seed=0, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abdeghilnorst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(70)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, text(9000))]
    base = text(120)
    for k in range(7, n):
        kind = k % 6
        if kind == 0:
            out.append((k, base))
        elif kind == 1:
            w = base.split()
            for _ in range(r.randint(1, 12)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append((k, " ".join(w)))
        elif kind == 2:
            out.append((k, text(20) + "\n" + passage + " " + text(15)))
        elif kind == 3:
            out.append((k, " ".join(passage.split()[5 : 5 + r.randint(48, 60)]) + " " + text(30)))
        else:
            out.append((k, text(r.randint(1, 200))))
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns of its own and clashing ones, over several partitions."""
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    return df.withColumns({"n": F.lit(1), "key": F.lit("k"), "component": F.lit(None).cast("string"), "spans": F.lit(2.5), "doc": F.lit(9)}).repartition(3).persist()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
