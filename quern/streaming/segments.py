"""A corpus with its indexes that grows by segments: a change costs what changed, not a rebuild.

Each change is a segment of tables beside the earlier ones: the rows that are new or differ, their
postings and vectors, which earlier rows they replace, and by how much they move document frequencies
and sizes. Nothing that is written changes afterwards. A manifest names the segments that hold; the next
one is written aside and put in place by one rename, so a reader sees a change whole or not at all, and a
change that fails leaves the last manifest in force. Reading merges: rows, postings and vectors of a
segment less what later segments replace, frequencies and sizes by adding up. compact() writes the
merged state as one segment.

Rows are known by corpus_idx and compared by a digest of all their columns. A row that comes unchanged
is left alone: it is not written, counted or encoded again, so a repeated change is none. Of rows
of one id in a change the greatest digest counts. Null ids are left out.

What changed is found by ids and digests alone. A change is read twice, for its digests and for the rows that
changed, so it must give the same rows both times; these rows go straight from there into the segment, with their terms
counted, and only rows of an id that comes more than once, or those of very large changes, are shuffled with their texts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.fixed import K1, B
from quern.operators import bm25, dense
from quern.operators.sizes import settled
from quern.sources.kept import kept

TABLES = ("rows", "postings", "gone", "df", "size", "vectors")


#: Ids that are broadcast at most, so that texts and postings meet them without a shuffle.
MOST_IDS = 2_000_000


def near(ids: DataFrame, n: int) -> DataFrame:
    """Ids, n of them, to be broadcast if they are few enough; Spark decides about more."""
    return F.broadcast(ids) if n <= MOST_IDS else ids


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class Store:
    """The segments under a path. Writers are one at a time; a second one that publishes the same version is refused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        """The newest manifest: version, segments, and the batches that they hold."""
        files, folder = _files(self.spark, f"{self.path}/manifests")
        names = sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []
        names = [n for n in names if n.startswith("manifest-")]
        if not names:
            return {"version": 0, "segments": [], "batches": [], "encoder": False, "report": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        files, aside = _files(self.spark, f"{self.path}/manifests/_aside-{uuid.uuid4().hex}")
        final = _files(self.spark, f"{self.path}/manifests/manifest-{manifest['version']:012d}")[1]
        out = files.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(final) or not files.rename(aside, final):
            files.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} has been published by another writer")

    def _table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment}/{name}")

    def _merged(self, manifest: dict, name: str) -> DataFrame | None:
        """A table of all segments, each less the rows that later ones replace."""
        segments, parts = manifest["segments"], []
        for i, segment in enumerate(segments):
            part = self._table(segment, name)
            later = [self._table(s, "gone") for s in segments[i + 1 :]]
            if later:
                part = part.join(settled(reduce(DataFrame.unionByName, later).distinct()), "corpus_idx", "left_anti")
            parts.append(part)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def rows(self) -> DataFrame | None:
        """The corpus as it stands; None before the first change."""
        found = self._merged(self.manifest(), "rows")
        return None if found is None else found.drop("digest", bm25.BAG)

    def vectors(self) -> DataFrame | None:
        manifest = self.manifest()
        return self._merged(manifest, "vectors") if manifest["encoder"] else None

    def index(self) -> bm25.Index | None:
        """The keyword index as it stands: frequencies and sizes added up, impacts by the mean length of now."""
        manifest = self.manifest()
        postings = self._merged(manifest, "postings")
        if postings is None:
            return None
        add = lambda name: reduce(DataFrame.unionByName, [self._table(s, name) for s in manifest["segments"]])
        size = add("size").agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
        seen = add("df").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        seen = seen.crossJoin(F.broadcast(size)).withColumn("raw", raw)  # one row
        stats = size.crossJoin(seen.agg(F.avg("raw").alias("mean_idf")))
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        weighed = postings.crossJoin(F.broadcast(size.select("avgdl"))).select("term", "corpus_idx", "tf", impact.alias("impact"))
        terms = seen.select("term", "df", "raw").crossJoin(F.broadcast(stats.select("mean_idf"))).select("term", "df", bm25.idf(F.col("raw"), F.col("mean_idf")).alias("idf"))
        return bm25.Index(weighed, terms, self._merged(manifest, "rows").select("corpus_idx", F.col("dl")), stats)

    def apply(self, rows: DataFrame, batch: str, encoder: Callable[[], dense.Encoder] | None = None, snapshot: bool = False) -> dict:
        """Take rows (corpus_idx, text, ...) in as a segment; what changed: added, replaced, removed, unchanged.

        A batch that the manifest has, or that changes nothing, publishes nothing. Of a snapshot, rows that are missing are removed.
        """
        manifest = self.manifest()
        if manifest["segments"] and bool(encoder) != manifest["encoder"]:
            raise ValueError("a store has vectors of all its rows or of none: give every change an encoder, or no change")
        if batch in manifest["batches"]:
            return {"batch": batch, "added": 0, "replaced": 0, "removed": 0, "unchanged": 0}
        names = [c for c in rows.columns if c not in ("digest", "dl", bm25.BAG)]
        digest = F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)
        given = rows.where("corpus_idx is not null").select(*names).withColumn("digest", digest)
        told = given.groupBy("corpus_idx").agg(F.max("digest").alias("digest"), (F.count(F.lit(1)) > 1).alias("again"))
        held = self._merged(manifest, "rows")
        if held is None:
            told = told.withColumn("old", F.lit(None).cast("string"))
        else:
            told = told.join(held.select("corpus_idx", F.col("digest").alias("old")), "corpus_idx", "full" if snapshot else "left")
        kind = F.when(F.col("digest").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") == F.col("digest"), "unchanged").otherwise("replaced")
        told = kept(told.select("corpus_idx", kind.alias("kind"), F.coalesce("again", F.lit(False)).alias("again")), "segment-told")
        counts = {(r["kind"], r["again"]): r["count"] for r in told.groupBy("kind", "again").count().collect()}
        said = {"batch": batch, **{k: counts.get((k, False), 0) + counts.get((k, True), 0) for k in ("added", "replaced", "removed", "unchanged")}}
        if not said["added"] + said["replaced"] + said["removed"]:
            return said
        segment = f"{manifest['version'] + 1:06d}-{uuid.uuid4().hex}"
        path = f"{self.path}/segments/{segment}"
        gone = told.where("kind in ('replaced', 'removed')").select("corpus_idx")
        gone.write.parquet(f"{path}/gone")
        gone = near(self.spark.read.parquet(f"{path}/gone"), said["replaced"] + said["removed"])
        self._write(path, self._changed(given, told, counts), manifest, gone, encoder)
        manifest["batches"].append(batch)
        self._publish(manifest | {"version": manifest["version"] + 1, "segments": [*manifest["segments"], segment], "encoder": bool(encoder), "report": [*manifest["report"], said]})
        return said

    @staticmethod
    def _changed(given: DataFrame, told: DataFrame, counts: dict) -> DataFrame:
        """The rows that are new or differ, one an id: those of ids that come once meet the shorter list, of ids to take or of ids to leave."""
        take = "kind in ('added', 'replaced')"
        taken = sum(n for (kind, again), n in counts.items() if kind in ("added", "replaced") and not again)
        more = sum(n for (kind, again), n in counts.items() if kind in ("added", "replaced") and again)
        left = sum(n for (kind, again), n in counts.items() if kind != "removed") - taken
        if not left:
            return given
        listed = told.where(f"{take} and not again") if taken <= left else told.where(f"kind <> 'removed' and (again or not {take})")
        once = given.join(near(listed.select("corpus_idx"), min(taken, left)), "corpus_idx", "left_semi" if taken <= left else "left_anti")
        if not more:
            return once
        many = given.join(near(told.where(f"{take} and again").select("corpus_idx"), more), "corpus_idx", "left_semi")
        names = [c for c in given.columns if c != "digest"]
        best = many.groupBy("corpus_idx").agg(F.max_by(F.struct(*names), "digest").alias("r"), F.max("digest").alias("digest"))
        return once.select(*names, "digest").unionByName(best.select("r.*", "digest"))

    def _write(self, path: str, changed: DataFrame, manifest: dict, gone: DataFrame, encoder: Callable[[], dense.Encoder] | None) -> None:
        bm25.bagged(changed, changed.columns).write.parquet(f"{path}/rows")
        rows = self.spark.read.parquet(f"{path}/rows")
        bm25.unpacked(rows).repartitionByRange("term", "corpus_idx").sortWithinPartitions("term", "corpus_idx").write.parquet(f"{path}/postings")
        postings = self.spark.read.parquet(f"{path}/postings")
        df, size = postings.select("term", F.lit(1).alias("df")), rows.select(F.lit(1).alias("n"), F.col("dl").alias("tokens"))
        if manifest["segments"]:  # what the replaced rows had counts less
            before = lambda name: self._merged(manifest, name).join(gone, "corpus_idx", "left_semi")
            df = df.unionByName(before("postings").select("term", F.lit(-1).alias("df")))
            size = size.unionByName(before("rows").select(F.lit(-1).alias("n"), (-F.col("dl")).alias("tokens")))
        df.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(f"{path}/df")
        size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).write.parquet(f"{path}/size")
        if encoder is not None:
            dense.build(rows.drop(bm25.BAG), encoder).write.parquet(f"{path}/vectors")

    def compact(self) -> None:
        """The state as it stands as one segment; readers of the earlier ones go on until they are deleted by vacuum()."""
        manifest = self.manifest()
        if len(manifest["segments"]) < 2:
            return
        segment = f"{manifest['version'] + 1:06d}-{uuid.uuid4().hex}"
        path = f"{self.path}/segments/{segment}"
        for name in TABLES[: 5 + bool(manifest["encoder"])]:
            if name == "gone":
                out = self._table(manifest["segments"][0], "gone").limit(0)
            elif name == "df":
                out = reduce(DataFrame.unionByName, [self._table(s, "df") for s in manifest["segments"]]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
            elif name == "size":
                out = reduce(DataFrame.unionByName, [self._table(s, "size") for s in manifest["segments"]]).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
            else:
                out = self._merged(manifest, name)
                if name == "postings":
                    out = out.repartitionByRange("term", "corpus_idx").sortWithinPartitions("term", "corpus_idx")
            out.write.parquet(f"{path}/{name}")
        self._publish(manifest | {"version": manifest["version"] + 1, "segments": [segment]})

    def vacuum(self) -> int:
        """Delete segments that the newest manifest does not name; how many went."""
        files, folder = _files(self.spark, f"{self.path}/segments")
        named, went = set(self.manifest()["segments"]), 0
        for found in files.listStatus(folder) if files.exists(folder) else []:
            if found.getPath().getName() not in named:
                went += bool(files.delete(found.getPath(), True))
        return went
