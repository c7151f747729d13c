"""Continuous linking: a micro-batch of changed files rechecks them and what imports them, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marklens.operators import link, markup, tokens
from marklens.sources import shared, store


class Linked:
    """A corpus under ``folder``: its macro table and its diagnostics, each kept per file.

    ``check(args)`` gives ``(path, ...)`` rows of ``schema`` for a macro table; rows of a file may hang on the files that its imports lead to,
    directly or through others, and on no other.
    """

    def __init__(self, spark: SparkSession, folder: str, check: Callable[[DataFrame], DataFrame], schema: str):
        self.spark, self.folder, self.check = spark, folder, check
        empty = markup.with_offsets(markup.arguments(markup.macros(spark.createDataFrame([], "path string, text string"))))
        self.macros, self.rows = empty.schema, StructType.fromDDL(schema)

    def args(self) -> DataFrame:
        return store.get(self.spark, f"{self.folder}/macros", self.macros)

    def diagnostics(self) -> DataFrame:
        return store.get(self.spark, f"{self.folder}/diagnostics", self.rows)

    @staticmethod
    def imports(args: DataFrame) -> DataFrame:
        """``(src, dst)``: which file names which in an import, whether it is there or not."""
        regions = markup.regions(args, tokens.environments(args))
        return markup.dependencies(args, regions).filter("hint IS NOT NULL AND hint <> path").select(F.col("path").alias("src"), F.col("hint").alias("dst")).distinct()

    def update(self, batch: DataFrame, number: int) -> None:
        """Take ``batch(path, text)`` in: new texts of files, null for deleted ones; of repeated paths any one counts. For ``foreachBatch``.

        The import graph is walked backward from the changed files to all that hang on them, and forward from those to
        what they need; only these rows are read by the check. Each table is replaced per file, so a replay changes nothing.
        """
        new = shared.checkpoint(batch.select("path", "text").filter("path IS NOT NULL").dropDuplicates(["path"]))
        store.put(f"{self.folder}/macros", number, new, markup.with_offsets(markup.arguments(markup.macros(new.filter("text IS NOT NULL")))))
        args = self.args()
        edges = shared.checkpoint(self.imports(args))
        changed = new.select(F.col("path").alias("node"))
        back = link.closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed, rule="all", pairs=False)
        affected = shared.checkpoint(changed.union(back.select("node")).distinct())
        needed = affected.union(link.closure(edges, affected, rule="all", pairs=False).select("node")).distinct()
        rows = self.check(args.join(needed.withColumnRenamed("node", "path"), "path", "left_semi"))
        store.put(f"{self.folder}/diagnostics", number, affected.withColumnRenamed("node", "path"), rows)
