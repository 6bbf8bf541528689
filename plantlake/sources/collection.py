"""A collection of chunks and vectors kept as one Parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantlake.functions.embedding import Embedder, embed_column
from plantlake.operators.answers import INDEXES, answer_questions, nearest_chunks
from plantlake.operators.neighbours import K

HEADINGS = "headings"


def flatten_metadata(json_text: Column) -> Column:
    """Map of the plain values of a metadata object; a list of headings becomes one line; other nested values go.

    The null values of plain keys stay.
    """
    parsed = F.from_json(json_text, "map<string,variant>")
    plain = F.map_filter(parsed, lambda k, v: v.isNull() | F.is_variant_null(v) | ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"))
    flat = F.transform_values(plain, lambda k, v: F.try_variant_get(v, "$", "string"))
    parts = F.from_json(F.get_json_object(json_text, f"$.{HEADINGS}"), "array<string>")
    line = F.array_join(F.filter(parts, lambda h: h.isNotNull() & (h != "")), " > ")
    with_line = F.map_concat(flat, F.create_map(F.lit(HEADINGS), line))
    listed = F.get_json_object(json_text, f"$.{HEADINGS}").startswith("[")
    return F.when(listed, with_line).otherwise(flat)


class Collection:
    """Named table of chunks with their vectors; the same embedder serves chunks and questions."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, index: str = "exact"):
        if index not in INDEXES:
            raise ValueError(f"unknown index {index!r}, use one of {INDEXES}")
        self.spark, self.path, self.embedder, self.index = spark, path, embedder, index

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def add(self, chunks: DataFrame, rebuild: bool = False) -> None:
        """Append chunks whose id is not stored yet; ``rebuild`` drops the old content. Empty texts are left out."""
        fresh = chunks.where(F.length("text") > 0).dropDuplicates(["chunk_id"])
        if not rebuild and self.exists():
            fresh = fresh.join(self.read().select("chunk_id"), "chunk_id", "left_anti")
        if "embedding" not in fresh.columns:
            fresh = embed_column(fresh, "text", self.embedder)
        fresh.write.mode("overwrite" if rebuild else "append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def clear(self) -> None:
        """Keep the table, drop its rows."""
        empty = self.spark.createDataFrame([], self.read().schema)
        empty.write.mode("overwrite").parquet(self.path)

    def retrieve(self, questions: DataFrame, k: int = K, **options) -> DataFrame:
        """(question_id, rank, chunk_id, distance); questions need ``embedding`` or ``query``."""
        if "embedding" not in questions.columns:
            questions = embed_column(questions, "query", self.embedder)
        return nearest_chunks(questions, self.read(), k, self.index, **options)

    def answer(self, questions: DataFrame, k: int = K, **options) -> DataFrame:
        return answer_questions(questions, self.read(), k, self.index, embedder=self.embedder, **options)
