"""Weights of pairs, kept up to date as files of evidence come and go."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions

FILE = ["source_id", "source_file"]
EVIDENCE = "source_id string, source_file string, gallery_id string, kind string, norm string"
PAIRS = "source_id string, artist string, group string, weight long"
#: So many differences are added up when they are read; beyond, they become one.
MOST_PARTS = 32


def contributions(rows: DataFrame) -> DataFrame:
    """source_id, artist, group, weight: works in whose newest file both stand. rows: EVIDENCE."""
    names = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.struct(F.col("source_file").alias("f"), F.col("norm").alias("n"))))
    works = rows.groupBy("source_id", "gallery_id").agg(F.max("source_file").alias("top"), names("Artist").alias("a"), names("Group").alias("g"))
    new = lambda c: F.transform(F.filter(c, lambda x: x["f"] == F.col("top")), lambda x: x["n"])
    pairs = works.select("source_id", F.explode(new("a")).alias("artist"), new("g").alias("g")).select("source_id", "artist", F.explode("g").alias("group"))
    return pairs.groupBy("source_id", "artist", "group").agg(F.count(F.lit(1)).alias("weight"))


class PairStore:
    """Evidence by (source, file) and the pairs' weights, one version for each change.

    A change replaces or withdraws files as units. Only works that the changed files name, before or after, are paired again: what they counted before and
    count after gives a difference, retractions included, that is written beside the earlier ones. Weights are the differences' sums. Evidence and
    differences become visible together, by the manifest."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.versions = spark, Versions(spark, base)

    def evidence(self, files: dict[str, str]) -> DataFrame:
        """Rows of the files that a manifest names."""
        if not files:
            return self.spark.createDataFrame([], EVIDENCE)
        by_part: dict[str, list[str]] = {}
        for key, part in files.items():
            by_part.setdefault(part, []).append(key)
        out = None
        for part, keys in by_part.items():
            rows = self.spark.read.schema(EVIDENCE).parquet(f"{self.versions.base}/{part}").filter(F.struct(*FILE).isin([F.struct(*[F.lit(x) for x in key.split("\n")]) for key in keys]))
            out = rows if out is None else out.unionByName(rows)
        return out.select("source_id", "source_file", "gallery_id", "kind", "norm")

    def change(self, added: DataFrame | None = None, withdrawn: Iterable[tuple[str, str]] = ()) -> int:
        """The version with the files of added (EVIDENCE) in place of those of the same names, and without the withdrawn ones."""
        on = self.versions.latest()
        m = self.versions.manifest(on) or {"files": {}, "parts": []}
        files = dict(m["files"])
        changed = {f"{s}\n{f}" for s, f in withdrawn}
        for key in changed:
            files.pop(key, None)
        if added is not None:
            part = self.versions.write(added.select("source_id", "source_file", "gallery_id", "kind", "norm"), FILE)
            new = [f"{r[0]}\n{r[1]}" for r in self.spark.read.schema(EVIDENCE).parquet(f"{self.versions.base}/{part}").select(*FILE).distinct().collect()]  # one row a file
            changed.update(new)
            files.update(dict.fromkeys(new, part))
        of = lambda fs, keys: self.evidence({k: v for k, v in fs.items() if k in keys}).select("source_id", "gallery_id")
        works = of(m["files"], changed).unionByName(of(files, changed)).distinct()
        sources = {k.split("\n")[0] for k in changed}
        own = lambda fs: {k: v for k, v in fs.items() if k.split("\n")[0] in sources}
        count = lambda fs: contributions(self.evidence(own(fs)).join(works, ["source_id", "gallery_id"], "left_semi"))
        both = count(files).unionByName(count(m["files"]).withColumn("weight", -F.col("weight")))
        difference = both.groupBy("source_id", "artist", "group").agg(F.sum("weight").alias("weight")).filter("weight <> 0")
        parts = [*m["parts"], self.versions.write(difference)]
        if len(parts) > MOST_PARTS:
            parts = [self.versions.write(self._summed(parts))]
        return self.versions.commit(on, {"files": files, "parts": parts})

    def _summed(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], PAIRS)
        rows = self.spark.read.schema(PAIRS).parquet(*[f"{self.versions.base}/{p}" for p in parts])
        return rows.groupBy("source_id", "artist", "group").agg(F.sum("weight").alias("weight")).filter("weight <> 0")

    def by_source(self, version: int | None = None) -> DataFrame:
        """source_id, artist, group, weight."""
        return self._summed(self.versions.manifest(version).get("parts", []))

    def weights(self, version: int | None = None) -> DataFrame:
        """Artist, group, weight: the largest over sources."""
        return self.by_source(version).groupBy("artist", "group").agg(F.max("weight").alias("weight"))
