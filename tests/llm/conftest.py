import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF_DIR = "/root/testdata/sf0.001"

#: texts every operator on texts must survive
ODD_TEXTS = [None, "", " ", "\n\n\n", "a", "…", "ÄÖ ß x", "word " * 30_000, "x" * 120_000, "1" * 60_000,
             "a@" * 5_000, "+" * 5_000, "same text twice over again", "same text twice over again"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with a null id, repeated ids and columns whose names clash with results."""
    rows = [(i, t, "spans", 1, True) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "text without id", "x", None, None), (1, "id given twice", None, 2, False)]
    schema = "doc_id long, text string, spans string, n_words int, contaminated boolean"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
