"""Several scans of the same documents in the same partitions, and tables that one scan leaves for the next, by partition.

A task of the next scan reads what was left for its partition from the shared folder, so texts need not be shuffled to
meet it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, filesystem

#: Logical operators through which a scan's rows stay in the scan's partitions and order.
_NARROW = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation"}


def fixed_scan(docs: DataFrame, *more) -> DataFrame:
    """doc_id and text (and more) in partitions that stay as they are from scan to scan.

    How files are dealt to partitions depends on the number of cores at hand, which changes as executors come and go: the
    present number is held for the session, unless one is set. Anything but a plain file scan is checkpointed first."""
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", max(1, spark.sparkContext.defaultParallelism))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)

    def plain(node) -> bool:
        children = node.children()
        return node.nodeName() in _NARROW and node.deterministic() and all(plain(children.apply(k)) for k in range(children.size()))

    return chosen if plain(docs._jdf.queryExecution().optimizedPlan()) else checkpoint(chosen)


def write_side(rows: DataFrame, folder: str) -> None:
    """A table with a folder per scan partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionById(n, "pid").write.partitionBy("pid").parquet(folder)


def side(folders: list[str], pid: int, columns=("kind", "blob"), batch: int = 64):
    """The columns' values that earlier passes left for a scan partition."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for folder in folders:
        store, root = filesystem(folder)
        for f in store.get_file_info(fs.FileSelector(f"{root}/pid={pid}", allow_not_found=True)):
            if f.base_name.endswith(".parquet"):
                with store.open_input_file(f.path) as at:
                    for part in pq.ParquetFile(at).iter_batches(batch, columns=list(columns)):
                        yield from zip(*[c.to_pylist() for c in part.columns], strict=True)
