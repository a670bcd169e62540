"""Corpus pipeline: from documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the columns
of documents.  The language stage drops texts that hold no letter of any language (null texts, too); exact and near
duplicates leave one row a group; leaking documents go; the last stage encodes what is left.

Rows are judged by their own id and text, so an id that has several texts loses only those that a stage rejects.  Rows with
a null id stay unless their text is null or a row with an id has it.  Repeated rows leave one.  Long texts are read whole, an empty table passes all stages as one, and further columns
of any name come through.
"""

from __future__ import annotations

import uuid

from askwright.llm import bpe, decontamination, exact_dedup, language_id, simhash
from askwright.llm.common import shared_dir, table, without
from askwright.llm.queries import ranks_path


def identify_language(spark, docs, sf_dir):
    """Rows whose language is identified, each judged by its own id and text (a null id stays unless its text is null); the model
    learns from the rows of docs that are not held out."""
    model = language_id.train(docs.where(~language_id.held_out()))
    return without(docs.where("text is not null"), lambda rows: language_id.identify(rows, model).where("lang_pred = 'und'"))


def drop_exact_duplicates(spark, docs, sf_dir):
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    return simhash.one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """doc_id, ids and their digests: what decodes to the text again."""
    path = ranks_path()
    return bpe.digests(bpe.encode(docs, path), path)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The stages learn models and hash: SQL cannot express them.  tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another; what each keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/askwright/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
