"""Documents to training data in stages; each stage calls one operator of `plotweave.llm`.

Defined cases: a null or empty text fails the quality rules; of rows equal in id and text one stays as a near copy;
a null id is an id like any other; an empty table gives an empty result; other columns are handed on to the last stage,
which returns those of the token files. The files hold the documents in the order of training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm.decontaminate import decontamination_stage
from plotweave.llm.mixing import mixing_stage
from plotweave.llm.near_copies import near_copy_stage
from plotweave.llm.quality_rules import quality_stage
from plotweave.llm.token_files import token_stage
from plotweave.session import cut

STAGES = [
    ("quality rules", quality_stage),
    ("near-copy classes", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token files", token_stage),
]

# The quality model and the approximate candidate search have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage kept is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
