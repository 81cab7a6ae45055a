"""A kept search index: postings in files ordered by term, so that a query reads only the files that hold its terms.

An index is a folder of segments, the first from ``build``, one more from each ``upsert``. A segment has postings
(term, doc, tf, len), sorted and dealt by (term, doc), so that common terms are spread over files and the files' own
statistics tell which of them hold a term; documents (doc, len); and the dictionary (term, df). A document counts in the
newest segment that has it; ``changed`` of a segment names the documents of older segments that it replaces or deletes.
``compact`` makes one segment of all. Only what an upsert changes is written; nothing is read back for it.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import shared_dir

POSTINGS = "term string, doc {id}, tf long, len int"
#: Changed documents that are broadcast; more are taken out by a shuffle join.
BROADCAST_IDS = 500_000


def tokenised(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(doc, len, pairs array<struct<term,tf>>): a document's words are sorted and counted where they are, no shuffle."""

    def pairs(w: Column, b: Column) -> Column:
        """``b``: places at which a run of equal words begins; its length is the distance to the next."""
        ends = F.concat(F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0))), F.array(F.size(w) + 1))
        return F.zip_with(b, ends, lambda x, y: F.struct(F.get(w, x - 1).alias("term"), (y - x).cast("long").alias("tf")))

    def of(w: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1) != F.get(w, i - 2)))
        none = F.array().cast("array<struct<term:string,tf:bigint>>")
        return F.struct(F.size(w).alias("len"), F.when(F.size(w) > 0, tx.let(begins, lambda b: pairs(w, b))).otherwise(none).alias("pairs"))

    # Variables of lambdas: an array that a plan's projections share might be found again for each of its elements.
    return docs.select(F.col(id_col).alias("doc"), tx.let(F.sort_array(words), of).alias("t")).select("doc", "t.len", "t.pairs")


def exploded(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc", "len", F.explode("pairs").alias("p")).select("p.term", "doc", "p.tf", "len")


def counted(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(term, doc, tf, len) of a table."""
    return exploded(tokenised(docs, id_col, words))


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    @cached_property
    def segments(self) -> list[str]:
        """Folders of the segments that are whole, oldest first."""
        fs, p = self._fs(self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return [f"{self.path}/{n}" for n in names if fs.exists(self._fs(f"{self.path}/{n}/documents/_SUCCESS")[1])]

    def _write(self, docs: DataFrame, id_col: str, text_col: str, gone: DataFrame | None, files: int | None) -> Index:
        at = f"{self.path}/{len(self.segments):06d}-{uuid.uuid4().hex[:8]}"
        # Written first: texts are cut into words once, not again for the sample that deals the postings.
        tokenised(docs, id_col, tx.words(F.col(text_col))).write.option("compression", "zstd").parquet(f"{at}/tokens")
        tokens = self.spark.read.parquet(f"{at}/tokens")
        post = exploded(tokens)
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        post.repartitionByRange(n, "term", "doc").sortWithinPartitions("term", "doc").write.option("compression", "zstd").parquet(f"{at}/postings")
        kept = self.spark.read.parquet(f"{at}/postings")
        kept.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange(max(1, n // 8), "term").sortWithinPartitions("term").write.parquet(f"{at}/dictionary")
        ids = docs.select(F.col(id_col).alias("doc"))
        changed = ids if gone is None else ids.union(gone.select(F.col(id_col).alias("doc")))
        if self.segments:
            changed.distinct().write.parquet(f"{at}/changed")
        # Last: a segment without its documents is not there.
        tokens.select("doc", "len").write.parquet(f"{at}/documents")
        fs, p = self._fs(f"{at}/tokens")
        fs.delete(p, True)
        return Index(self.spark, self.path)

    def build(self, docs: DataFrame, id_col: str, text_col: str, files: int | None = None) -> Index:
        return self._write(docs, id_col, text_col, None, files)

    def upsert(self, docs: DataFrame, id_col: str, text_col: str, deleted: DataFrame | None = None, files: int | None = None) -> Index:
        """Replace or add ``docs`` and delete the ids of ``deleted``: one more segment."""
        return self._write(docs, id_col, text_col, deleted, files)

    def _live(self, part: str, pick=lambda df: df) -> DataFrame:
        """Rows of a part of all segments, without documents that a later segment changed."""
        out = []
        for i, s in enumerate(self.segments):
            rows = pick(self.spark.read.parquet(f"{s}/{part}"))
            for later in self.segments[i + 1 :]:
                ids = self.spark.read.parquet(f"{later}/changed")
                rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_anti")
            out.append(rows)
        return reduce(DataFrame.unionByName, out)

    def postings(self, terms: list[str]) -> DataFrame:
        """(doc, term, tf, len) of some terms: a filter that the files' statistics answer."""
        return self._live("postings", lambda df: df.where(F.col("term").isin(terms))).select("doc", "term", "tf", "len")

    @cached_property
    def statistics(self) -> tuple[int, float]:
        """Documents and their mean length."""
        r = self._live("documents").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words")).first()
        return r["n"], (r["words"] or 0) / max(1, r["n"])

    def dictionary(self, pick=lambda df: df) -> DataFrame:
        """(term, df) of the terms that ``pick`` keeps; with one segment as it was written, else counted over its postings."""
        if len(self.segments) == 1:
            return pick(self.spark.read.parquet(f"{self.segments[0]}/dictionary"))
        return self._live("postings", pick).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def compact(self, path: str, files: int | None = None) -> Index:
        """The same index as one segment under another path."""
        n, at = files or int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"{path}/000000-{uuid.uuid4().hex[:8]}"
        self._live("postings").repartitionByRange(n, "term", "doc").sortWithinPartitions("term", "doc").write.option("compression", "zstd").parquet(f"{at}/postings")
        self.spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term").write.parquet(f"{at}/dictionary")
        self._live("documents").write.parquet(f"{at}/documents")
        return Index(self.spark, path)


def kept(docs: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of a stored table, built once and found again as long as the table's files are the same."""
    spark = docs.sparkSession
    facts = []
    for f in sorted(docs.inputFiles()):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        facts.append(f"{f} {s.getLen()} {s.getModificationTime()}")
    name = hashlib.sha256("\n".join([id_col, text_col, *facts]).encode()).hexdigest()[:32]
    found = Index(spark, f"{shared_dir(spark)}/tidemark-index-{name}")
    return found if found.segments else found.build(docs.select(id_col, text_col), id_col, text_col)
