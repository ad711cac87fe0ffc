"""A corpus prepared for training, stage by stage.

Documents whose language can't be told go, one document of each group of near
copies stays, documents that hold benchmark passages go, secrets are masked,
and the rest is sampled to target weights.  Every stage is written before the
next one reads it, so each is checkpointed, and a lost executor costs a part of
one stage only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillsight.llm import decontamination, language_id, mixing, ngram_join, secret_scan
from tillsight.llm.oracle import ORACLE as OPERATOR_ORACLE
from tillsight.llm.queries import MIX, QUERIES as OPERATOR_QUERIES, topic_of
from tillsight.llm.storage import Scratch, table

# Near copies share four fifths of their runs of five words.
COPY_WORDS, COPY_SIMILARITY = 5, ngram_join.Threshold(80, 100)

_open: list[Scratch] = []


def _scratch(spark: SparkSession, label: str) -> Scratch:
    """A stage's own tables; those of the stage before, whose result is stored by now, are dropped."""
    while _open:
        _open.pop().clear()
    _open.append(Scratch(spark, f"pipeline-{label}"))
    return _open[-1]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no language model explains; fills in a missing language.

    Null and empty texts, and those without a letter, go.  Rows without an id stay
    if their text is known, repeated rows stay or go together.  All columns stay,
    whatever their names.
    """
    model = language_id.fit(docs.where(language_id.remainder(F.col("doc_id"), 4) != 2))
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc")
    found = language_id.identify(docs.select(whole, "text"), model).where("accepted")
    language = F.coalesce("doc.lang", "lang_pred").alias("lang")
    return found.select(*[language if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies.

    Rows without an id stay, and so do those without words; of rows that repeat id
    and tokens one stays, different texts of one id are different documents (see
    ``ngram_join.keep_one``).
    """
    return ngram_join.keep_one(docs, COPY_WORDS, COPY_SIMILARITY, _scratch(spark, "copies"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, whether that has an id or not.

    Null and empty texts hold none; repeated rows stay or go together.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; the documents stay, null and empty texts as they are.

    Rows that share an id, or have none, share their secrets.
    """
    scratch = _scratch(spark, "secrets")
    secrets = scratch.table(secret_scan.scan(docs, scratch=scratch), "secrets")
    return secret_scan.redact(docs, secrets)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by their calibrated probabilities.

    Null sources and languages are values of their own, rows that share an id, or
    have none, are drawn together, and texts without words with their cell.
    """
    return mixing.sample(docs, topic_of(F.col("text")), MIX, scratch=_scratch(spark, "mixing"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("ngram_join", without_copies),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is read from the last one's files."""
    stored = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stored.table(stage(spark, docs, sf_dir), name)
        if number:
            stored.drop(STAGES[number - 1][0])
    return docs


# The models of languages and the forest have no form in SQL; tests compare
# the stages with plain versions instead.
ORACLE_SQL = None

QUERIES = OPERATOR_QUERIES | {"pipeline": run}
ORACLE = dict(OPERATOR_ORACLE)
