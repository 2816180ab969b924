"""Corpus pipeline: five stages from raw documents to sampled token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns the columns of ``documents`` (the last one its samples).
"""

from __future__ import annotations

from hustings.llm import decontaminate, language_id, line_dedup, minhash, sample_encode
from hustings.llm.common import settled


def identify_language(spark, docs, sf_dir):
    """Texts in which no language is found go."""
    return language_id.stage(spark, docs, sf_dir)


def drop_repeated_lines(spark, docs, sf_dir):
    """Lines that another document holds already go from the text; documents stay."""
    return line_dedup.stage(spark, docs, sf_dir)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return minhash.stage(spark, docs, sf_dir)


def decontaminate_benchmark(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.stage(spark, docs, sf_dir)


def sample_segmentations(spark, docs, sf_dir):
    """Distinct sampled segmentations of what is left."""
    return sample_encode.stage(spark, docs, sf_dir)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("sentencepiece_sampling", sample_segmentations),
]

#: The first and the last stage are no SQL; tests hold all against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; what a stage returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
