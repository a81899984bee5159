"""From raw documents to packed training sequences: stages applied in order, each over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convgraph.functions.lineage import BATCH, cut_lineage, setting
from convgraph.llm import labels, mixing, packing, secretscan, simhash, toxicity
from convgraph.llm.common import among, numbered

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC = 0.7  # scores from which a document goes
ROWS = 500  # documents scored or encoded at a time; Python's processes keep for later stages what their largest batch took


def _row(docs: DataFrame) -> Column:
    """A whole row as one column ``row``, so that no working column can meet a column of the table."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_row(docs))


def _field(name: str) -> Column:
    return F.col("row").getField(name)


def _columns(rows: DataFrame, **instead: Column) -> DataFrame:
    """The columns that ``row`` holds, some with other values."""
    names = rows.schema["row"].dataType.names
    return rows.select(*[instead.get(c, _field(c)).alias(c) for c in names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by a model of the labelled ones among them.

    A null text counts as empty, and both are kept; repeated rows are judged alike; without labels nothing goes; an empty
    table stays empty; other columns, whatever their names, are passed on.
    """
    known = labels.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    d = numbered(docs, _row(docs))
    texts = d.select("rid", _field("doc_id").alias("doc_id"), _field("text").alias("text"))
    with setting(spark, BATCH, str(ROWS)):  # only the numbers of kept rows are written
        kept = cut_lineage(toxicity.score_documents(texts, known, out="toxic").where(F.col("toxic") < TOXIC).select("rid"))
    return _columns(among(d, kept, "rid"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts with a resemblance of 0.8 or more on five-word shingles.

    Null and empty texts are one class; of repeated rows one stays; ids are not looked at and may be null; an empty table
    stays empty; texts are compared whole; other columns, whatever their names, are passed on.
    """
    d = numbered(docs, _row(docs))
    classes = simhash.similar_documents(d.select("rid", _field("text").alias("text")), rid="rid", shingle=5, similarity=0.8)
    kept = cut_lineage(classes.where("rid = root").select("rid"))
    return _columns(among(d, kept, "rid"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted again.

    A null text stays null with its n_chars; a null source is no path; repeated rows are masked alike; an empty table
    stays empty; other columns, whatever their names, are passed on.
    """
    d = _rows(docs).withColumns({"text": _field("text"), "source": _field("source")})
    masked = secretscan.redact(secretscan.scan(d, secretscan.train(d)))
    instead = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(_field("n_chars"))
    return _columns(masked, **instead)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (up to three times, some not at all).

    A null source is a source of its own; null and empty texts have no words and are taken once or not; repeated rows are
    documents of their own; an empty table stays empty; other columns, whatever their names, are passed on.
    """
    rows = _rows(docs).withColumns({c: _field(c) for c in ("doc_id", "text", "source")})
    mixed = mixing.mix(rows, weights=(5, 2, 1), cap=3.0, carry=("row",))
    return _columns(mixing.repeat_documents(mixed))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences of at most 1024 tokens.

    Null and empty texts are the end id alone; repeated rows and ids are documents of their own; an empty table gives no
    pieces; other columns are not read.
    """
    with setting(spark, BATCH, str(ROWS)):
        return packing.pack(docs, packing.default_tokenizer(), window=1024, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, fingerprints and token ids are beyond SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of ``sf_dir``; between two stages the rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
