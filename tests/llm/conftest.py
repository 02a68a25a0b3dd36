import random

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """rows of (doc_id, text[, source[, lang]]) -> documents, with columns whose names the operators use themselves."""

    def make(rows, clash=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if clash:
            for c in ("id", "n", "key", "hits", "dropped", "component", "u", "v", "_size", "_copies", "_evidence", "_host", "copy", "line", "n_lines", "spans"):
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make


WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega été für".split()


@pytest.fixture
def prose():
    """prose(seed, n): n random words, a line break now and then."""

    def make(seed, n):
        r = random.Random(seed)
        return "".join(r.choice(WORDS) + str(r.randrange(40)) + (r.choice("\n      ") if i < n - 1 else "") for i in range(n))

    return make

