"""A stored index: its parts, taxa, targets with lineages, and sketching parameters."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import SketchOptions

VERSION = 2
META = "k int, size int, window int, stride int, hash_name string, max_locations int, version int, buckets int"


def _table(path: str) -> str:
    """The name under which a session knows the index at a path. Its files are outside of the session's own folder, and stay."""
    return f"strandline_{hashlib.md5(path.encode()).hexdigest()}"


@dataclass
class Index:
    """features: (feature, tgt, win, part); taxa: (id, parent, name, rank); targets: (tgt, id, name, given, parent, file, index, windows); lineages: (id, lineage) of taxa and targets."""

    features: DataFrame
    taxa: DataFrame
    targets: DataFrame
    lineages: DataFrame
    sketch: SketchOptions
    max_locations: int = 254

    @property
    def target_lineages(self) -> DataFrame:
        """(tgt, lineage)."""
        return self.lineages.where("id < 0").select((-F.col("id") - 1).alias("tgt"), "lineage")

    def save(self, path: str, parts: int = 1, buckets: int | None = None) -> None:
        """Writes the index under path. Features are spread over `parts` by their hash, so a part holds all locations of its features.

        In each part they are in buckets (as many as shuffles have partitions), sorted: a query moves its own features to them,
        and the index stays where it is. A task writes one bucket, so there is a file for each bucket and part.
        """
        spark = self.features.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64("feature"), F.lit(parts)).cast("int")
        rows = self.features.select("feature", "tgt", "win", part.alias("part")).repartition(buckets, "feature")
        name = _table(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows.write.partitionBy("part").bucketBy(buckets, "feature").sortBy("feature").mode("overwrite").option("path", f"{path}/index").saveAsTable(name, format="parquet")
        for name in ("taxa", "targets", "lineages"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        meta = asdict(self.sketch) | {"max_locations": self.max_locations, "version": VERSION, "buckets": buckets}
        spark.createDataFrame([tuple(meta.values())], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, part: int | None = None) -> Index:
        """Reads an index, whole or one part of it, which then is all that is read. Another version is refused."""
        meta = spark.read.schema(META).json(f"{path}/meta").first()
        if meta is None or meta["version"] != VERSION:
            raise ValueError(f"{path}: no index of version {VERSION}")
        name = _table(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} (feature BIGINT, tgt BIGINT, win BIGINT, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY (feature) SORTED BY (feature) INTO {meta['buckets']} BUCKETS LOCATION '{where}/index'")
        spark.sql(f"MSCK REPAIR TABLE {name}")
        features = spark.table(name)
        if part is not None:
            features = features.where(F.col("part") == part)
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("taxa", "targets", "lineages")}
        return cls(features.drop("part"), **tables, sketch=SketchOptions(meta["k"], meta["size"], meta["window"], meta["stride"], meta["hash_name"]), max_locations=meta["max_locations"])
