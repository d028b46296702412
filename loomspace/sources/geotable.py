"""The table of geometries as a table: created empty, filled, emptied in part, filled again.

The table is Parquet, parted by scene.  An INSERT or DELETE finds the scenes that it touches,
writes their new rows to a staging folder beside the table, and then puts them in the place of
those scenes' old rows, the others stay as they are.  What goes in comes from the staging
folder alone, so a run that is broken off after staging can be repeated, and a statement that
is run again changes nothing: names are unique within a scene, and a name that is there keeps
its row.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.functions.geometry import GEOMETRY
from loomspace.operators.predicates import register

COLUMNS = f"name STRING, geom_type STRING, style STRING, vertices INT, geom {GEOMETRY}, scene_id BIGINT"
_DELETE = re.compile(r"^\s*DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*?))?\s*;?\s*$", re.I | re.S)
_INSERT = re.compile(r"^\s*INSERT\s+INTO\s+(\w+)\s*\(([^)]*)\)\s*VALUES\s*(.*?)\s*;?\s*$", re.I | re.S)


class GeometryTable:
    def __init__(self, spark: SparkSession, path: str, name: str = "generated_geometries") -> None:
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self.schema: T.StructType = spark.createDataFrame([], COLUMNS).schema

    def create(self) -> GeometryTable:
        """The table without rows, unless it is there."""
        if not self._there(self.path):
            self.spark.createDataFrame([], self.schema).write.partitionBy("scene_id").parquet(self.path)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def insert(self, rows: DataFrame) -> None:
        """Adds rows; a null scene_id is scene 0, of rows that share a name in a scene one stays, and a name that is there already keeps its row."""
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn("scene_id", F.coalesce("scene_id", F.lit(0).cast("long")))
        new = self._staged(rows.dropDuplicates(["scene_id", "name"]).join(self.rows().select("scene_id", "name"), ["scene_id", "name"], "left_anti"))
        touched = new.select("scene_id").distinct()
        self._put(self.rows().join(touched, "scene_id", "left_semi").unionByName(new), touched)

    def delete(self, condition: str | None = None) -> None:
        """Takes away the rows for which a condition holds; without one, all."""
        register(self.spark)
        hit = F.expr(condition).cast("boolean") if condition else F.lit(True)
        touched = self._staged(self.rows().where(hit).select("scene_id").distinct())
        self._put(self.rows().join(touched, "scene_id", "left_semi").where(~F.coalesce(hit, F.lit(False))), touched)

    def sql(self, statement: str) -> None:
        """A DELETE, or an INSERT of values as `insert_sql` writes it, against this table."""
        if found := _DELETE.match(statement):
            self._named(found[1])
            return self.delete(found[2])
        if found := _INSERT.match(statement):
            self._named(found[1])
            register(self.spark)
            rows = self._values(found[2].split(","), found[3])
            for f in self.schema:
                if f.name not in rows.columns:
                    rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
            return self.insert(rows)
        raise ValueError("only DELETE and INSERT of values change a table")

    def _values(self, columns: list[str], values: str) -> DataFrame:
        """The rows of VALUES, read by Spark's parser, as SELECTs: an inline table can't hold a function like ST_GeomFromText."""
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(f"VALUES {values}")
        while plan.nodeName() != "UnresolvedInlineTable" and plan.children().size():
            plan = plan.children().apply(0)
        wrong = ValueError("a row of VALUES has more or fewer values than columns are named")
        if plan.nodeName() != "UnresolvedInlineTable":  # plain literals are a table already
            if plan.output().size() != len(columns):
                raise wrong
            return self.spark.sql(f"SELECT * FROM VALUES {values} AS v({', '.join(columns)})")
        rows = plan.rows()
        one = lambda row: ", ".join(f"{row.apply(i).sql()} AS {c.strip()}" for i, c in enumerate(columns))
        if any(rows.apply(k).size() != len(columns) for k in range(rows.size())):
            raise wrong
        return self.spark.sql(" UNION ALL ".join(f"SELECT {one(rows.apply(k))}" for k in range(rows.size())))

    def _named(self, name: str) -> None:
        if name.lower() != self.name.lower():
            raise ValueError(f"another table: {name}")

    def _path(self, path: str):
        of = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return of, of.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        of, fs = self._path(path)
        return fs.exists(of)

    def _staged(self, df: DataFrame) -> DataFrame:
        """The rows, written beside the table."""
        path = f"{self.path}.staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _put(self, rows: DataFrame, touched: DataFrame) -> None:
        """rows in the place of all rows of the touched scenes."""
        staged = self._staged(rows)
        # A scene's rows lie together, in as many files as they need.
        staged.repartition("scene_id", F.pmod(F.xxhash64("name"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(self.path)
        # Scenes that have lost their last row; their names alone come to the driver.
        for r in touched.join(staged.select("scene_id").distinct(), "scene_id", "left_anti").toLocalIterator():
            of, fs = self._path(f"{self.path}/scene_id={r.scene_id}")
            fs.delete(of, True)
        of, fs = self._path(f"{self.path}.staged")
        fs.delete(of, True)
