"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

1. toxicity: documents that the class-conditional models call toxic go.
2. near_duplicates: one document of each group of near copies (five-word shingles,
   similarity 0.8) stays.
3. decontamination: documents contaminated with benchmark passages go.
4. mixing: rows are repeated so that expected domain tokens reach their target shares;
   the token budget is the least at which no domain shrinks, and every document stays
   at least once.
5. tokens: the ids of what is left, as bit-packed files, read back.  The files stay in the
   folder that ``run`` or ``tokens`` is given; without one they go when the driver ends.

A stage's rows are written before the next one begins, so each stage first takes the
broadcasts of the one before back from the executors and removes its intermediate tables.
Where the session has Spark's default of 10,000 rows for a batch that goes to Python, a stage
sets it to ``BATCH_ROWS``: batches of whole texts are held several times on either side.
"""

from __future__ import annotations

import functools

from slotloom.llm.decontaminate import decontaminate
from slotloom.llm.mixing import TARGET_WEIGHTS, known_domains, mixed
from slotloom.llm.near_dedup import drop_near_duplicates
from slotloom.llm.shared import fresh_path, made, recall, removed, stored
from slotloom.llm.token_files import read_token_files, tokenizer_file, write_token_files
from slotloom.llm.toxicity import drop_toxic


BATCH_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Intermediate tables of the last stage.
_left: list = []


def _stage(run):
    @functools.wraps(run)
    def wrapped(spark, docs, sf_dir: str, *more):
        recall()
        removed(_left)
        if spark.conf.get(_BATCH, "10000") == "10000":
            spark.conf.set(_BATCH, BATCH_ROWS)
        before = made()
        out = run(spark, docs, sf_dir, *more)
        # The token files are what that stage is for: they stay.
        _left[:] = [] if run.__name__ == "tokens" else [m for m in made() if m not in before]
        return out

    return wrapped


@_stage
def toxicity(spark, docs, sf_dir: str):
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark, docs, sf_dir: str):
    return drop_near_duplicates(docs, size=5, similarity=(80, 100))


@_stage
def decontamination(spark, docs, sf_dir: str):
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mixing(spark, docs, sf_dir: str):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixed(docs, known_domains(docs, labels), TARGET_WEIGHTS, at_least=1)


@_stage
def tokens(spark, docs, sf_dir: str, folder: str | None = None):
    manifest = write_token_files(docs, folder or fresh_path(spark, "pipeline-tokens"), tokenizer_file())
    return read_token_files(manifest, docs.schema["doc_id"].dataType.simpleString())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL has no classifier, signatures or tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str, folder: str | None = None):
    """The rows of the last stage; ``folder`` keeps the token files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return tokens(spark, docs, sf_dir, folder)
