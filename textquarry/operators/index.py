"""A persistent fingerprint index that is looked up and appended to, never rebuilt.

Rows (key, kind, id, f, s, size) lie in a shared folder as batch=NAME/part=P Parquet files,
P being the key modulo the number of parts and the rows of a file sorted by key.  A
look-up reads only the parts that its keys fall into and, by the statistics of the sorted
files, only row groups that may hold them.  A batch is written whole under its own name
and counts only when its _SUCCESS file is there; writing it again replaces it, so a job
that died may be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.state import cut, path_exists
from textquarry.functions.text import hamming
from textquarry.operators.dedup import MAX_DISTANCE, block_keys, both_ways, decide_in_order, near_values, nodes_of
from textquarry.operators.registry import require, unique, violation

#: Kinds of keys: a record's name, its exact fingerprint, and blocks of its simhash.
NAME, EXACT, BLOCK = 0, 1, 2
PARTS = 64


class FingerprintIndex:
    """Accepted records under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string", parts: int = PARTS, most: int = MAX_DISTANCE):
        self.spark, self.path, self.parts, self.most, self.id_type = spark, path.rstrip("/"), parts, most, id_type
        self.schema = f"key bigint, kind tinyint, id {id_type}, f string, s bigint, size int, batch string, part int"

    def batches(self) -> list[str]:
        """Names of the batches that were written whole."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and path_exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def rows(self, kind: int | None = None) -> DataFrame:
        """Everything in the index, or the rows of one kind."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in names])
        return df if kind is None else df.where(F.col("kind") == kind)

    def count(self) -> int:
        """Number of records in the index."""
        return self.rows(NAME).count()

    def key_rows(self, records: DataFrame) -> DataFrame:
        """Rows (key, kind, id, f, s, size) of records (id, f, s): names, and the smallest id of each fingerprint and simhash."""
        none = F.lit(None)
        name = records.select(F.xxhash64(F.lit("name"), "id").alias("key"), F.lit(NAME).cast("tinyint").alias("kind"), "id", "f", "s", none.cast("int").alias("size"))
        exact = records.where("f is not null").groupBy("f").agg(F.min("id").alias("id"))
        exact = exact.select(F.xxhash64(F.lit("exact"), "f").alias("key"), F.lit(EXACT).cast("tinyint").alias("kind"), "id", "f", none.cast("bigint").alias("s"), none.cast("int").alias("size"))
        near = records.where("s is not null").groupBy("s").agg(F.min("id").alias("id"))
        near = near.select(F.explode(block_keys("s", self.most)).alias("key"), F.lit(BLOCK).cast("tinyint").alias("kind"), "id", none.cast("string").alias("f"), "s", none.cast("int").alias("size"))
        return name.unionByName(exact).unionByName(near)

    def write(self, rows: DataFrame, batch: str) -> None:
        """Write key rows as one batch."""
        if not batch or "/" in batch or "=" in batch:
            raise ValueError("a batch needs a name without / and =")
        spread = rows.withColumn("part", F.pmod("key", F.lit(self.parts)).cast("int"))
        # parts are gathered and divided by their measured size, so no task grows with a part;
        # sorted by part first, a task holds one open file at a time
        even = spread.hint("rebalance", F.col("part")).sortWithinPartitions("part", "kind", "key")
        even.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/batch={batch}")

    def add(self, records: DataFrame, batch: str) -> None:
        """Append records (id, f, s); a blank id or one that is there already, in the batch or the index, is an error."""
        blank = violation(records, "blank_id", "id", F.length(F.trim(F.col("id").cast("string"))) == 0)
        have = self.rows_of_parts(records.select(F.xxhash64(F.lit("name"), "id").alias("key")), NAME).where(F.col("batch") != batch).select("id")
        again = violation(records.join(have, "id", "left_semi"), "repeated_id", "id", F.lit(True))
        require(blank.unionByName(unique(records, "id")).unionByName(again), batch)
        self.write(self.key_rows(records), batch)

    def rows_of_parts(self, keys: DataFrame, kind: int) -> DataFrame:
        """Index rows of one kind in the parts that ``keys`` (key) fall into."""
        hit = [r[0] for r in keys.select(F.pmod("key", F.lit(self.parts)).cast("int").alias("p")).distinct().collect()]  # at most ``parts`` numbers
        return self.rows(kind).where(F.col("part").isin(hit))

    def exact_matches(self, nodes: DataFrame) -> DataFrame:
        """(f, name): of each fingerprint of ``nodes`` that is in the index, its record of the smallest id."""
        asked = nodes.where("f is not null").select("f", F.xxhash64(F.lit("exact"), "f").alias("key")).distinct()
        return self.rows_of_parts(asked, EXACT).join(asked, ["key", "f"], "left_semi").groupBy("f").agg(F.min("id").alias("name"))

    def near_matches(self, nodes: DataFrame) -> DataFrame:
        """(s, distance, name) of each simhash of ``nodes`` and each record of the index within reach, copies of a simhash once."""
        asked = cut(nodes.where("s is not null").select("s").distinct().select("s", F.explode(block_keys("s", self.most)).alias("key")))
        there = self.rows_of_parts(asked, BLOCK).select("key", F.col("s").alias("b"), F.col("id").alias("name"))
        met = asked.join(there, "key").select("s", hamming("s", "b").alias("distance"), "name")
        return met.where(F.col("distance") <= self.most).distinct()

    def find(self, query: DataFrame, id_col: str, fingerprint: str, most: int | None = None) -> DataFrame:
        """(query_id, match_id, distance) of each query's simhash and the records of the index within reach, its own id excepted."""
        q = query.select(F.col(id_col).alias("query_id"), F.col(fingerprint).alias("s"))
        if most is not None and most > self.most:
            raise ValueError(f"the index reaches {self.most} bits")
        found = self.near_matches(q).where(F.col("distance") <= (self.most if most is None else most))
        return q.join(found, "s").where(F.col("query_id") != F.col("name")).select("query_id", F.col("name").alias("match_id"), "distance")

    def consider(self, records: DataFrame, id_col: str, order: list[str], fingerprint: str, simhash: str, batch: str) -> DataFrame:
        """Decide a batch against everything accepted so far and append what it adds.

        Result: (id_col, name, f, s, rank, exact, distance, other) as of
        :func:`decide_in_order`, from the shared folder.  Records are taken in order within
        the batch; they are read several times and should lie in the shared folder.  What
        lies in the index is not computed again, and only the parts that the batch's keys
        fall into are read.
        """
        own = records.select(
            F.col(id_col).alias("id"), F.col(id_col).alias("name"), F.struct(*order).alias("rank"), F.col(fingerprint).alias("f"), F.col(simhash).alias("s"), *self.extra
        )
        nodes = cut(nodes_of(own, self.extra))
        near, pairs = self.matches(nodes)
        rows = own.drop(*self.extra)
        decided = cut(decide_in_order(rows, nodes.drop(*self.extra), cut(both_ways(pairs)), self.exact_matches(nodes), self.best_near(near)))
        new = own.select("id", "f", "s", *self.extra) if self.extra else decided.select("id", "f", "s")
        accepted = decided.where("other is null").select("id")
        self.write(self.key_rows(new.join(accepted, "id", "left_semi")), batch)
        return decided.withColumnRenamed("id", id_col)

    #: Columns of a record besides id, f and s that a richer index keeps.
    extra: tuple[str, ...] = ()

    def matches(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(s, distance, name) against the index, and (a, b, distance) of a < b within the batch."""
        return self.near_matches(nodes), near_values(nodes, "s", self.most)

    @staticmethod
    def best_near(found: DataFrame) -> DataFrame:
        """The closest match of each simhash, of equally close ones that of the smallest id."""
        best = found.groupBy("s").agg(F.min(F.struct("distance", "name")).alias("best"))
        return best.select("s", F.col("best.distance").cast("int").alias("distance"), F.col("best.name").alias("name"))

