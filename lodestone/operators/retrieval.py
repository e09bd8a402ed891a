"""A kept positional index: postings bucketed and sorted by token, renewed for changed documents only.

The index is a folder of two tables. ``postings`` (token, doc, positions) is bucketed by token and written in
segments; a search for some tokens reads the buckets of these tokens alone. ``documents`` has one row for each
document and segment: its digest, whether it went away, and the columns that searches filter by. A document's newest
row says which of its postings count, so an update writes one segment with what changed and touches nothing else.

* Tokens are the lower-cased runs of letters and digits; positions count them from 0.
* Null and empty texts are documents without postings. Ids do not repeat: the caller removes repeats first.
* A token that a third of the documents hold fills its bucket with several files, dealt by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import small_batches

BUCKETS, SPREAD = 16, 4


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, doc, positions) of batches of (doc, tokens): a document's words are put together where it is read, so one
    row of each of its tokens is dealt and not one of each word."""
    for batch in batches:
        words = batch.column("tokens")
        counts = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = pa.table([batch.column("doc").take(pc.list_parent_indices(words)), pc.list_flatten(words), pa.array(at, pa.int32())], ["doc", "token", "at"])
        grouped = flat.group_by(["doc", "token"], use_threads=False).aggregate([("at", "list")]).select(["token", "doc", "at_list"])
        yield from grouped.rename_columns(["token", "doc", "positions"]).combine_chunks().to_batches(max_chunksize=20_000)


class TextIndex:
    """An index named ``name`` in ``folder``; ``kept`` are the columns that searches can filter by."""

    def __init__(self, spark: SparkSession, name: str, folder: str, kept: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.name, self.folder, self.kept, self.buckets = spark, name, folder.rstrip("/"), kept, buckets

    def _attach(self) -> None:
        """The postings folder as a bucketed table of this session."""
        if not self.spark.catalog.tableExists(self.name):
            root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/postings")
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(root)
            self.spark.sql(
                f"CREATE TABLE {self.name} (token STRING, doc BIGINT, positions ARRAY<INT>, segment INT) USING parquet PARTITIONED BY (segment)"
                f" CLUSTERED BY (token) SORTED BY (token, doc) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/postings'"
            )
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _segments(self) -> list[int]:
        """Numbers of the finished segments, from the folder's names."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        done = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.removeprefix("segment=")) for n in done)

    def documents(self) -> DataFrame | None:
        """The newest row of each document: doc, segment, digest, gone and the kept columns."""
        done = self._segments()
        if not done:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/documents").parquet(*(f"{self.folder}/documents/segment={n}" for n in done))
        others = [c for c in rows.columns if c not in ("doc", "segment")]
        newest = rows.groupBy("doc").agg(F.max_by(F.struct(*others), "segment").alias("r"), F.max("segment").alias("segment"))
        return newest.select("doc", "segment", "r.*")

    def update(self, rows: DataFrame, id_col: str, text_col: str) -> dict[str, int]:
        """Make the index that of ``rows``: new and changed texts are read into a new segment, documents that are
        no longer among the rows are marked gone. Returns how many of each. A failed update leaves an unfinished
        segment that no search reads and the next update writes over."""
        last = max(self._segments(), default=0)
        digest = F.sha2(F.coalesce(F.concat(F.lit("="), F.col(text_col)), F.lit("-")).cast("binary"), 256)
        new = rows.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("_text"), digest.alias("digest"), *self.kept)
        old = self.documents()
        if old is None:
            changed, gone = new, None
        else:
            was = old.select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), F.col("gone").alias("_gone"), *(F.col(c).alias(f"_{c}") for c in self.kept))
            met = new.join(was, F.col("doc") == F.col("_doc"), "left")
            same = F.col("_digest").eqNullSafe(F.col("digest")) & ~F.coalesce("_gone", F.lit(True))
            for c in self.kept:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            changed = met.where(~same).select(*new.columns)
            gone = old.where("not gone").join(new.select("doc"), "doc", "left_anti").select("doc", "digest", F.lit(True).alias("gone"), *self.kept)
        part = F.pmod(F.xxhash64("doc"), F.lit(SPREAD))
        words = small_batches(changed.select("doc", tokens(F.col("_text")).alias("tokens")))
        dealt = words.mapInArrow(posted, "token string, doc bigint, positions array<int>").repartition(self.buckets * SPREAD, "token", part)
        segment = last + 1
        postings = dealt.select("token", "doc", "positions", F.lit(segment).alias("segment"))
        # the segment's documents are written last: without them its postings do not count
        self._attach()
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (segment = {segment})")
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/postings/segment={segment}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        postings.write.format("parquet").partitionBy("segment").bucketBy(self.buckets, "token").sortBy("token", "doc").mode("append").saveAsTable(self.name)
        listed = changed.select("doc", "digest", F.lit(False).alias("gone"), *self.kept)
        listed = listed if gone is None else listed.unionByName(gone)
        listed.write.mode("overwrite").parquet(f"{self.folder}/documents/segment={segment}")
        counts = {r["gone"]: r["n"] for r in self.spark.read.parquet(f"{self.folder}/documents/segment={segment}").groupBy("gone").agg(F.count("*").alias("n")).collect()}
        return {"written": counts.get(False, 0), "gone": counts.get(True, 0)}

    def live(self) -> DataFrame:
        """The documents that searches find."""
        found = self.documents()
        if found is None:
            raise ValueError(f"the index {self.name} is empty")
        return found.where("not gone").drop("gone")

    def postings(self, wanted: Column) -> DataFrame:
        """(doc, token, positions) of the live documents for the tokens that ``wanted`` takes."""
        self._attach()
        hits = self.spark.table(self.name).where(wanted)
        return hits.join(self.live().select("doc", "segment"), ["doc", "segment"]).drop("segment")

    def _terms(self, words: list[str]) -> list[str]:
        terms = [w.lower() for w in words]
        if not terms:
            raise ValueError("a search has at least one word")
        return terms

    def holding(self, words: list[str]) -> DataFrame:
        """(doc): documents that hold all words."""
        terms = sorted(set(self._terms(words)))
        hits = self.postings(F.col("token").isin(terms))
        return hits.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("doc")

    def phrase(self, words: list[str]) -> DataFrame:
        """(doc, starts): documents that hold the words one after another, and where."""
        terms = self._terms(words)
        hits = self.postings(F.col("token").isin(sorted(set(terms))))
        per = hits.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"), F.count("*").alias("n"))
        starts = lambda i: F.transform(F.element_at("at", F.lit(terms[i])), lambda p: p - i)
        common = starts(0)
        for i in range(1, len(terms)):
            common = F.array_intersect(common, starts(i))
        found = per.where(F.col("n") == len(set(terms))).select("doc", F.array_sort(common).alias("starts"))
        return found.where(F.size("starts") > 0)

    def prefix(self, start: str) -> DataFrame:
        """(doc, token): tokens that begin with ``start``; the sorted files are read where they hold such tokens."""
        low = start.lower()
        return self.postings(F.col("token").startswith(low) & (F.col("token") >= low)).select("doc", "token")

    def retrieve(self, found: DataFrame, *where: Column, related: DataFrame | None = None) -> DataFrame:
        """Live documents among ``found`` that meet all filters over the kept columns and, if given, have a row in
        ``related`` (doc, …: entities, tags, relations). In the order of their ids."""
        rows = self.live().join(found.select("doc"), "doc", "left_semi")
        for w in where:
            rows = rows.where(w)
        if related is not None:
            rows = rows.join(related.select("doc"), "doc", "left_semi")
        return rows.select("doc", *self.kept).orderBy("doc")
