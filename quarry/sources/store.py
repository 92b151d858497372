"""Where tables that queries share are kept, and the indexes made so far."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from quarry.operators.keyword_index import KeywordIndex
from quarry.operators.vector_index import VectorIndex
from quarry.sources.tables import table

_INDEXES: dict[tuple[str, str, str], KeywordIndex | VectorIndex] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which all machines share; without the setting only a local session gets one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", there)
    return f"{there}/quarry/{name}-{uuid.uuid4().hex}"


def documents_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The stored keyword index of ``documents``, made at the first call of an application; it is a snapshot, kept up by ``update``."""
    key = (spark.sparkContext.applicationId, sf_dir, "documents")
    if key not in _INDEXES:
        corpus = table(spark, sf_dir, "documents").select("doc_id", "text")
        _INDEXES[key] = KeywordIndex.build(corpus, new_folder(spark, "keyword-index"))
    return _INDEXES[key]


def embeddings_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored index of ``embeddings``, made likewise."""
    key = (spark.sparkContext.applicationId, sf_dir, "embeddings")
    if key not in _INDEXES:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        _INDEXES[key] = VectorIndex.build(rows, new_folder(spark, "vector-index"))
    return _INDEXES[key]
