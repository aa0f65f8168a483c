import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text[, lang[, source]]), with an extra column that clashes with names inside the operators."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            from pyspark.sql import functions as F

            for name in ("node", "n", "key", "row", "size", "score", "pattern", "n_lines", "component_id"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture
def talk():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioudlrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def make(n, seed):
        r = random.Random(seed)
        return [r.choice(vocabulary) for _ in range(n)]

    return make
