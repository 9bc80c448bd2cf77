"""Tables in buckets: a change rewrites the buckets that it touches, and no others.

Rows lie in buckets by the hash of their owner (the session that a turn's id begins with; so a session's turns, chunks and
vectors have the same bucket). A version of the table is a list that says for each bucket which change wrote it last, a row a
bucket. A change writes its buckets below `data=<number>` and then the list; readers see it once Spark has committed that, and one
that fails is not seen. All of the table is one scan over the listed folders. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from convoweave.session import last_version

BUCKETS = 64
LIST = "bucket int, change int"


def owner(turn_id: Column) -> Column:
    """What a turn's id begins with, before the first colon."""
    return F.regexp_extract(turn_id, "^([^:]*)", 1)


class Bucketed:
    """The table in a folder that Spark can reach. key: the id by whose owner rows are dealt."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Column, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.columns = [f.split()[0] for f in schema.split(", ")]
        self.bucket = F.pmod(F.xxhash64(owner(key)), F.lit(buckets)).cast("int")

    def _listed(self) -> dict[int, int]:
        """The change that holds each bucket; empty ones are left out."""
        version = last_version(self.spark, self.path)
        return dict(self.spark.read.schema(LIST).parquet(f"{self.path}/version={version}").collect()) if version else {}

    def read(self, only: Collection[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        paths = [f"{self.path}/data={change}/bucket={b}" for b, change in sorted(self._listed().items()) if only is None or b in only]
        if not paths:
            return self.spark.range(0).select(F.from_json(F.lit("{}"), self.schema).alias("x")).select("x.*")
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of `rows` (with the key's column)."""
        return sorted(r[0] for r in rows.select(self.bucket).distinct().collect())

    def put(self, rows: DataFrame, only: Collection[int] | None = None) -> None:
        """Makes `rows` the content of the buckets `only` (default: of all); rows of other buckets are no part of a change."""
        dealt = rows.select(*self.columns, self.bucket.alias("bucket"))
        if only is not None:
            dealt = dealt.where(F.col("bucket").isin(*only))
        change = last_version(self.spark, self.path) + 1
        folder = f"{self.path}/data={change}"
        dealt.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        # Their names alone are read: what Spark has written, a folder for each bucket.
        full = {r[0] for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).select("bucket").distinct().collect()}
        kept = {b: c for b, c in self._listed().items() if only is not None and b not in only}
        told = self.spark.createDataFrame(sorted((kept | dict.fromkeys(full, change)).items()), LIST)
        told.coalesce(1).write.parquet(f"{self.path}/version={change}")
