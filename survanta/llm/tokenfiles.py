"""Token ids as flat binary files with document offsets.

Documents are range-partitioned and sorted by id; each partition becomes one shard of three files, so that shard after
shard holds the documents in ascending order of id:

* ``shard-NNNNN.bin``: the ids of its documents, unsigned little-endian integers of 16 or 32 bits, nothing else; 16 bits
  where the vocabulary and the end id fit, unless a width is asked for;
* ``shard-NNNNN.off``: signed 64-bit offsets in ids, one per document and one at the end, starting at 0;
* ``shard-NNNNN.doc``: the document ids, signed 64-bit.

A shard's place in the whole is its base, the prefix sum of the sizes of the shards before it; the bases stand in the
small table ``manifest`` next to the files (a row per shard). A task writes under a name of its own attempt and renames
at the end, so tasks that are lost or run twice leave one whole shard. Reading maps the files into memory where the
folder is local to the task and else reads them through the file system's own client; a shard is one task.

Defined cases: null and empty texts hold only the end id; rows with equal document ids keep the order of their texts;
rows with a null document id come first and are stored as ``NO_ID``; an empty table gives no shard; ids must fit the
width, else writing fails; only named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from . import bpe

NO_ID = -(1 << 63)
PARTS = ("bin", "off", "doc")


def _where(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _flat(enc: bpe.Encoder, texts: list[str | None], end: int, kind: np.dtype) -> list[bytes]:
    """Encoded documents as bytes, the end id appended."""
    units = [bpe.cut(t or "") for t in texts]
    enc.forget()
    enc.know({u for us in units for u in us})
    tail = np.array([end], "<u4").tobytes()
    whole = [b"".join(map(enc.kept.__getitem__, us)) + tail for us in units]
    if kind.itemsize == 4:
        return whole
    ids = [np.frombuffer(x, "<u4") for x in whole]
    if max((int(x.max()) for x in ids), default=0) > np.iinfo(kind).max:
        raise ValueError(f"an id does not fit {kind}")
    return [x.astype(kind).tobytes() for x in ids]


def write(df: DataFrame, folder: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text: str = "text",
          width: int | None = None, shards: int | None = None) -> DataFrame:
    """Writes the shards and the manifest under ``folder``; gives the manifest (shard, n_docs, n_tokens, doc_base, base, width)."""
    spark = df.sparkSession
    width = width or width_for(tokenizer, end)
    kind = np.dtype("<u4" if width == 4 else "<u2")
    fs, path = _where(folder)
    fs.create_dir(path)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t"))
            .repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "t"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        fs, path = _where(folder)
        name, attempt = f"{path}/shard-{ctx.partitionId():05d}", f"{path}/_attempt-{ctx.taskAttemptId()}"
        enc, offsets, ids, at = bpe.encoder(tokenizer), [0], [], 0
        out = None
        for batch in batches:
            for part in bpe._parts(batch):
                out = out or fs.open_output_stream(f"{attempt}.bin")
                for data in _flat(enc, part.column("t").to_pylist(), end, kind):
                    out.write(data)
                    at += len(data) // kind.itemsize
                    offsets.append(at)
                ids.extend(NO_ID if x is None else x for x in part.column("doc_id").to_pylist())
        if out is not None:
            out.close()
            for ext, values in (("off", offsets), ("doc", ids)):
                with fs.open_output_stream(f"{attempt}.{ext}") as f:
                    f.write(np.array(values, "<i8").tobytes())
            for ext in PARTS:
                fs.move(f"{attempt}.{ext}", f"{name}.{ext}")
            yield pa.RecordBatch.from_pydict({"shard": [ctx.partitionId()], "n_docs": [len(ids)], "n_tokens": [at]},
                                             schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    totals = rows.mapInArrow(shard, "shard int, n_docs long, n_tokens long")
    totals.write.parquet(f"{folder}/totals")
    return bases(spark.read.schema(totals.schema).parquet(f"{folder}/totals")).withColumn("width", F.lit(width))


def width_for(tokenizer: str, end: int) -> int:
    """Bytes of an id: 2 where all ids of the vocabulary and the end id fit, else 4."""
    highest = max([end, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    return 2 if highest < 1 << 16 else 4


def bases(totals: DataFrame) -> DataFrame:
    """Prefix sums over the shards: one row per shard, as many as there are partitions."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({"doc_base": F.coalesce(F.sum("n_docs").over(before), F.lit(0)),
                               "base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0))})


def _values(fs: pafs.FileSystem, name: str, kind: str) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype=kind, mode="r") if fs.get_file_info(name).size else np.zeros(0, kind)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def read(manifest: DataFrame, folder: str, width: int | None = None, crc_width: int | None = None) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (unsigned, over the
    ids as they lie in the file, or as integers of ``crc_width`` bytes). ``width`` is the manifest's unless given."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def documents(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _where(folder)
        for part in parts:
            for shard, base, size in zip(part["shard"], part["base"], part["width"]):
                name = f"{path}/shard-{shard:05d}"
                ids = _values(fs, f"{name}.bin", "<u4" if size == 4 else "<u2")
                off, doc = _values(fs, f"{name}.off", "<i8"), _values(fs, f"{name}.doc", "<i8")
                for a in range(0, len(doc), 10_000):
                    b = min(a + 10_000, len(doc))
                    own = pd.Series(np.array(doc[a:b]), dtype="Int64").mask(np.array(doc[a:b]) == NO_ID)
                    yield pd.DataFrame({"doc_id": own, "start": base + off[a:b], "n_tokens": np.diff(off[a:b + 1]),
                                        "ids_crc32": [zlib.crc32(ids[off[i]:off[i + 1]].astype(f"<u{crc_width or size}")) for i in range(a, b)]})

    size = F.lit(width) if width else F.col("width")
    return (manifest.select("shard", "base", size.cast("int").alias("width")).repartition(n, "shard")
            .mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def ids_of(spark: SparkSession, folder: str, shard: int, place: int, width: int = 4) -> np.ndarray:
    """The ids of one document of a shard, by its place there, without reading the rest."""
    fs, path = _where(folder)
    off = _values(fs, f"{path}/shard-{shard:05d}.off", "<i8")
    return _values(fs, f"{path}/shard-{shard:05d}.bin", "<u4" if width == 4 else "<u2")[off[place]:off[place + 1]]
