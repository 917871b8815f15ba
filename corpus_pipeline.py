"""A cleaning and packing pipeline over ``documents``: five stages, each one operator's decisions applied.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of their input. ``run`` writes every stage as Parquet in the shared folder and
rereads it as the next one's input, so a lost executor costs no finished stage.

1. toxicity: texts scored 0.5 or more go. Labels come from the table ``labels``.
2. n-gram Jaccard join: of the texts linked by a similarity of 0.8 on five-word shingles, the one with the
   smallest id stays.
3. benchmark decontamination: texts that hold a ten-word window of the benchmark go.
4. secret scans: found secrets are replaced by a mark, and n_chars follows the text.
5. best-fit packing: the remaining texts in bins.

Rows without an id stay in every stage that judges by id. Rows that repeat an id are one document for
stage 2, of which the row with the smallest text stays. Extra columns go through untouched.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from shutterlake.llm.common import fresh_prefix, prepare, table  # noqa: E402
from shutterlake.llm.decontamination import mark_contamination  # noqa: E402
from shutterlake.llm.jaccard_join import keep_one_per_component  # noqa: E402
from shutterlake.llm.packing import pack_documents  # noqa: E402
from shutterlake.llm.secrets import learn_formats, redact_secrets  # noqa: E402
from shutterlake.llm.toxicity import score_texts, train  # noqa: E402
from shutterlake.session import cut_lineage  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    prefix = fresh_prefix(docs)
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_texts(docs, model, prefix=prefix)
    return scored.filter(F.col(f"{prefix}predicted") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one_per_component(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    prefix = fresh_prefix(docs)
    marked = mark_contamination(docs, table(spark, sf_dir, "benchmark"), prefix=prefix)
    return marked.filter(~F.col(f"{prefix}contaminated")).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    before = f"{fresh_prefix(docs)}text"
    cleaned = redact_secrets(docs.withColumn(before, F.col("text")), formats=learn_formats(docs))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    kind = docs.schema["n_chars"].dataType
    length = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact),
    ("best_fit_packing", pack),
]

#: scoring, inferred automata and packing have no SQL form; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of what remains of ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
