"""Token-id files: each document's ids compressed by itself with a shared
zstandard dictionary, so that a short document can be read without its shard.

A file set is a folder of shards in ascending document order.  A shard is the
concatenated zstandard frames of its documents followed by its index; the
layout, little-endian:

    frame 0 | frame 1 | ... | index | footer
    index:  for each document: frame end (u64), ids up to its end in this shard (u64), id (i64)
    footer: documents (u64), first byte of the index (u64), documents without an id,
            which come first (u64), first 16 bytes of the dictionary's SHA-256, magic ``TIDZ0002``

A frame holds the ids as unsigned 16-bit integers when all fit, else 32-bit;
its first byte tells which.  The dictionary is trained on the serialized ids of
a bounded sample (distinct texts, a window from anywhere in each) and lies beside
the shards as ``dictionary``.  Reading checks that its hash is the one in the
footer.  ``manifest``, a Parquet table with one row for each shard, holds its file,
its lowest and highest id, its counts and ``base``, the ids of all shards before
it, so the folder alone finds every document.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, by_value, column_of, emit, partitions_for, scratch_path, store
from .tokens import encoder

by_value(__name__)

MAGIC = b"TIDZ0002"
FOOTER, FOOTER_BYTES = "<QQQ16s8s", 48
MANIFEST = "shard long, file string, low_id long, high_id long, n_docs long, n_tokens long, base long"
#: The dictionary: bytes, sample documents to expect at most, and characters of each it is trained on.
DICT_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 32 << 10, 1000, 4000
LEVEL = 3
#: Texts encoded at once in a task.
TEXTS_AT_ONCE = 256


def serialize(ids: bytes) -> bytes:
    """Little-endian u32 ids -> width byte and ids."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        return b"\x04" + ids
    return b"\x02" + wide.astype("<u2").tobytes()


def deserialize(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def train_dictionary(samples: list[bytes]) -> bytes:
    """Trained if the samples allow it, else their raw content (also a valid dictionary)."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


#: Schemes under which Hadoop knows a store that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "file": "file", "s3": "s3"}


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI that names one place to the driver and every task:
    without a scheme it lies where Spark's default file system says.  A store
    that Arrow cannot write is an error here, before any work."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, rest = uri.split(":", 1)
    if scheme not in _SCHEMES:
        raise ValueError(f"{uri}: token files are written by Arrow, which has no file system for {scheme}")
    return f"{_SCHEMES[scheme]}://{rest.removeprefix('//')}"


def filesystem(path: str):
    """Arrow's file system and path for a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def put(path: str, pieces: Iterator[bytes]) -> None:
    """Write under another name, then rename: a task that is run again, or twice
    at once, leaves one whole file."""
    import uuid

    system, place = filesystem(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(other := f"{place}.{uuid.uuid4().hex}.part") as out:
        for piece in pieces:
            out.write(piece)
    system.move(other, place)


class Shard:
    """A shard opened for reading; ``ids(i)`` reads one document."""

    def __init__(self, path: str, dictionary: bytes):
        system, place = filesystem(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        n, at, no_id, digest, magic = struct.unpack(FOOTER, self.file.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest()[:16]:
            raise ValueError(f"{path}: not written with this dictionary")
        index = np.frombuffer(self.file.read_at(24 * n, at), "<u8").reshape(n, 3)
        self.frames, self.ends = np.append(0, index[:, 0]).astype(np.int64), np.append(0, index[:, 1]).astype(np.int64)
        #: ids in ascending order, behind ``no_id`` documents that have none
        self.no_id, self.doc_ids = no_id, index[:, 2].astype("<i8")
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.frames) - 1

    def find(self, doc_id: int) -> range:
        """Places of the documents with this id."""
        known = self.doc_ids[self.no_id:]
        return range(*(self.no_id + int(np.searchsorted(known, doc_id, side)) for side in ("left", "right")))

    def ids(self, i: int) -> np.ndarray:
        frame = self.file.read_at(int(self.frames[i + 1] - self.frames[i]), int(self.frames[i]))
        return deserialize(self.zstd.decompress(frame))


def sample_texts(rows: DataFrame) -> list[str]:
    """About ``SAMPLE_DOCS`` rows of ``rows(id, t)`` at most, of each text one, cut
    to a window of ``SAMPLE_CHARS`` that starts anywhere in it.  A threshold from the
    row count on a hash of each row's place chooses them, whatever copies there are,
    so the tasks send what they chose and no more, without an exchange."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    chosen = rows.withColumn("place", F.monotonically_increasing_id()) \
        .where(F.pmod(F.xxhash64("place"), F.lit(1 << 53)) < int(share * (1 << 53)))
    at = F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    return sorted({r["t"] for r in chosen.select(F.substring("t", at, F.lit(SAMPLE_CHARS)).alias("t")).collect()})


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, text: str = "text",
                      id_col: str = "doc_id") -> DataFrame:
    """Encode every text, append ``end_id``, write the file set to ``folder`` in
    ascending id order (null ids first; equal ids by text, then in any order).

    Returns the manifest, stored in the folder: one row per shard.  One exchange:
    the texts, by ranges of the id.  Null text counts as empty; an empty table
    gives an empty manifest.  Shards are of about equal numbers of documents.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = qualified(spark, folder)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    samples = sample_texts(rows)
    tail = np.array([end_id], "<u4").tobytes()
    dictionary = train_dictionary([serialize(x + tail) for x in encoder(tokenizer).encode(samples)]) if samples else b""
    put(f"{folder}/dictionary", iter([dictionary]))
    digest = hashlib.sha256(dictionary).digest()[:16]
    fields = MANIFEST.rsplit(", ", 1)[0]
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in fields.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
                                        write_content_size=True)
        doc_ids, frames, counts = [], [], []

        def pieces() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, len(batch), TEXTS_AT_ONCE):
                    some = batch.slice(at, TEXTS_AT_ONCE)
                    doc_ids.extend(column_of(some, "id").to_pylist())
                    for ids in encode(column_of(some, "t").to_pylist()):
                        frame = zstd.compress(serialize(ids + tail))
                        frames.append(len(frame))
                        counts.append(len(ids) // 4 + 1)
                        yield frame
            numbers = np.array([i or 0 for i in doc_ids], "<i8").view("<u8")
            yield np.stack([np.cumsum(frames, dtype="<u8"), np.cumsum(counts, dtype="<u8"), numbers], 1).astype("<u8").tobytes()
            yield struct.pack(FOOTER, len(frames), sum(frames), doc_ids.count(None), digest, MAGIC)

        name = f"shard-{shard:07d}"
        first = next(batches, None)
        if first is not None:
            import itertools

            batches = itertools.chain([first], batches)
            put(f"{folder}/{name}", pieces())
            known = [i for i in (doc_ids[doc_ids.count(None):][:1] + doc_ids[-1:]) if i is not None] or [None]
            yield emit({"shard": [shard], "file": [name], "low_id": known[:1], "high_id": known[-1:], "n_docs": [len(doc_ids)],
                        "n_tokens": [sum(counts)]}, schema)

    ordered = rows.repartitionByRange(partitions_for(docs), "id", F.xxhash64("t")).sortWithinPartitions("id", F.xxhash64("t"))
    shards = store(ordered.mapInArrow(write, fields), "shards")
    # one thin row a shard: a running sum over them is small at any scale
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.withColumn("base", F.coalesce(before, F.lit(0))).write.parquet(manifest_of(folder))
    return read_manifest(spark, folder)


def manifest_of(folder: str) -> str:
    """Hadoop's name of the manifest of a qualified folder."""
    scheme, rest = folder.split("://", 1)
    return f"{'s3a' if scheme == 's3' else scheme}://{rest}/manifest"


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(manifest_of(qualified(spark, folder)))


def open_dictionary(folder: str) -> bytes:
    system, place = filesystem(f"{folder}/dictionary")
    with system.open_input_stream(place) as f:
        return f.read()


def find_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Token ids of every document with this id (more than one if ids repeat):
    the manifest names its shards, of which only the index and its own frames are read."""
    folder = qualified(spark, folder)
    shards = read_manifest(spark, folder).where((F.col("low_id") <= doc_id) & (F.col("high_id") >= doc_id)).orderBy("shard").collect()
    dictionary, found = open_dictionary(folder) if shards else b"", []
    for row in shards:
        shard = Shard(f"{folder}/{row['file']}", dictionary)
        found += [shard.ids(i) for i in shard.find(doc_id)]
    return found


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Read every document of the file set in ``folder`` back: ``doc_id, start`` (ids of
    all documents before it), ``n_tokens``, ``ids_crc32``, ``shard``, ``place``."""
    folder = qualified(spark, folder)
    shards = read_manifest(spark, folder)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
                        ("shard", pa.int64()), ("place", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for row in batch.to_pylist():
                dictionary = open_dictionary(folder) if dictionary is None else dictionary
                shard = Shard(f"{folder}/{row['file']}", dictionary)
                if len(shard) != row["n_docs"]:
                    raise ValueError(f"{row['file']}: {len(shard)} documents instead of {row['n_docs']}")
                crcs, sizes = [], []
                for i in range(len(shard)):
                    ids = shard.ids(i)
                    sizes.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                doc_ids = [None] * shard.no_id + shard.doc_ids[shard.no_id:].tolist()
                yield emit({"doc_id": doc_ids, "start": shard.ends[:-1] + row["base"], "n_tokens": sizes,
                            "ids_crc32": crcs, "shard": [row["shard"]] * len(sizes), "place": list(range(len(sizes)))}, schema)

    cores = spark.sparkContext.defaultParallelism
    return shards.repartition(max(cores, shards.count()), "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, place long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write a file set to the shared folder and read it back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, end_id, folder)
    return read_token_files(docs.sparkSession, folder)
