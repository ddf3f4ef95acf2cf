"""From raw documents to packed training sequences, stage by stage.

Each stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.jaccard_join import first_of_each
from millrace.llm.langid import held_out, identify
from millrace.llm.line_dedup import line_dedup
from millrace.llm.mixing import emit, mix
from millrace.llm.packing import pack
from millrace.llm.queries import tokenizer_path
from millrace.llm.store import keep

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of its n-grams that a text's language must account for.
LEAST_SCORE = 0.5
#: A document that keeps less than this share of its characters was another document's copy: its rest goes as well.
LEAST_LEFT = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the filter knows; rejects texts without letters (null and empty ones too) and texts like no language.

    Rows that repeat fare alike. Without a labelled language to learn from there is no
    ground to reject anything: all documents stay. Further columns are not read; an empty
    table stays empty; a text of any length is judged whole.
    """
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    if labelled.isEmpty():
        return docs.select(*COLUMNS)
    return identify(docs).filter(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select(*COLUMNS)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and near-repeated lines.

    A document of which no line is left, or less than half of the characters, goes: what
    remains of a copy are its few edited lines, and they are no document. Documents
    without lines (null, empty, white space) lose nothing and stay; of rows that repeat
    the first keeps its lines; ties are settled by id, then text. n_chars counts the new
    text. Further columns are not read; an empty table stays empty.
    """
    old = docs.select(*COLUMNS).withColumn("__before", F.length("text"))
    left = line_dedup(old).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))
    return left.filter(f"n_lines = 0 or n_kept > 0 and n_chars >= {LEAST_LEFT} * __before").select(*COLUMNS)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the least id, then the least hash of its text.

    Null ids stand below all others; of rows equal in id and text one stays; texts
    without words (null, empty) are copies of nothing and stay. Further columns are not
    read; an empty table stays empty.
    """
    return first_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null sources form one source, the last; rows of equal id draw alike; documents
    without words (null, empty) draw like others, unless their whole source has none:
    it has no target and goes. Further columns are not read; an empty table stays empty.
    """
    return emit(mix(docs.select(*COLUMNS)), COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences.

    Null and empty texts are their end id alone; rows that repeat are packed each time;
    null sources form a queue of their own; an empty table gives no piece.
    """
    return pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("language ID", known_language),
    ("line dedup", unique_lines),
    ("n-gram Jaccard join", unique_documents),
    ("mixing", mixed),
    ("packing", packed),
]

#: Languages, near duplicates, draws and tokens are beyond SQL: the tests hold run() and each stage against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
