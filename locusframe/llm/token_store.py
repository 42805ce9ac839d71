"""Token shards with a minimal perfect hash index from document keys to offsets.

A store is a folder of

``shards/<n>.ids``   a 16-byte header (magic, bytes an id, spare) and then raw
                     little-endian ids, 2 bytes each where the vocabulary allows
                     it and 4 otherwise; documents lie in ascending doc_id order
                     within a shard and from shard to shard;
``index/<p>.mph``    for one hash class of keys, the displacements of a minimal
                     perfect hash and one slot a key: fingerprint, shard,
                     offset and length in ids;
``manifest``         (parquet) one row a document, as the shards were written.

Files go through ``pyarrow.fs``, so a store can be in any folder that it knows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.llm.common import slices
from locusframe.session import shared_folder

MAGIC = b"LFTOKEN1"
HEADER, HEADER_SIZE = "<8sII", 16
#: Keys of one index file.
KEYS_PER_INDEX = 50_000
MANIFEST = "doc_id bigint, copy int, shard int, offset bigint, n_tokens bigint"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _write(uri: str, parts) -> None:
    """Write to a name of its own, then move: a repeated task replaces a file whole."""
    store, path = _open(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(made) as out:
        for part in parts:
            out.write(part)
    store.move(made, path)


def write_store(docs: DataFrame, root: str, tokenizer: str, end_id: int = 1, id_bytes: int = 2) -> str:
    """Encode ``docs`` (doc_id, text) into a store at ``root`` and return ``root``.

    Each text is encoded whole and gets ``end_id`` at its end. ``tokenizer`` is
    the path of a tokenizer file that executors can read; ``id_bytes`` is 2 for
    vocabularies of up to 65,536 ids.

    A null text is empty and holds the end id alone; a null doc_id sorts first.
    Rows of one doc_id lie side by side, ordered by text, and are told apart by
    ``copy`` (0, 1, ...). An empty table gives a store without documents. Other
    columns are not read.
    """
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def shards(batches):
        from locusframe.llm.tokens import encoder as encoder_of

        encoder = encoder_of(tokenizer)
        number = TaskContext.get().partitionId()
        end = np.array([end_id], dtype=kind).tobytes()
        rows = {"doc_id": [], "copy": [], "offset": [], "n_tokens": []}
        last, copy, offset = object(), 0, 0

        def parts():
            nonlocal last, copy, offset
            yield struct.pack(HEADER, MAGIC, id_bytes, 0)
            for batch in batches:
                for part in slices(batch, 128):
                    found = encoder.encode(part.column("text").to_pylist())
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), found, strict=True):
                        ids = np.frombuffer(ids, dtype="<u4").astype(kind).tobytes() + end
                        copy = copy + 1 if doc_id == last else 0
                        last, n = doc_id, len(ids) // id_bytes
                        for name, value in zip(rows, (doc_id, copy, offset, n), strict=True):
                            rows[name].append(value)
                        offset += n
                        yield ids

        _write(f"{root}/shards/{number}.ids", parts())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows["doc_id"], pa.int64()),
                pa.array(rows["copy"], pa.int32()),
                pa.array([number] * len(rows["doc_id"]), pa.int32()),
                pa.array(rows["offset"], pa.int64()),
                pa.array(rows["n_tokens"], pa.int64()),
            ],
            names=["doc_id", "copy", "shard", "offset", "n_tokens"],
        )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, MANIFEST).write.parquet(f"{root}/manifest")
    return build_index(docs.sparkSession, root)


def _hashed(keys: DataFrame, classes: int) -> DataFrame:
    """``keys`` (doc_id, copy) with the index class, two hashes and the fingerprint of each key."""
    key = (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull().cast("int"), F.col("copy"))
    return keys.select(
        "*",
        F.pmod(F.xxhash64(F.lit(1), *key), F.lit(classes)).cast("int").alias("class"),
        F.xxhash64(F.lit(2), *key).alias("h1"),
        F.xxhash64(F.lit(3), *key).alias("h2"),
        F.xxhash64(F.lit(4), *key).bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark"),
    )


def _slot(h1: np.ndarray, h2: np.ndarray, d, m: int) -> np.ndarray:
    x = h1 + h2 * np.asarray(d, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(m)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key): hash and displace, as many slots as keys.

    Keys fall in groups of about four. The largest groups come first, each with
    the smallest displacement that sends its keys to free slots; a group of one
    key names a free slot itself, as a negative displacement.
    """
    m = len(h1)
    groups = max(1, (m + 3) // 4)
    of = (h1 % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=groups)
    ends = np.cumsum(counts)
    shift, slot, used = np.zeros(groups, dtype=np.int64), np.empty(m, dtype=np.int64), np.zeros(m, dtype=bool)
    tries = np.arange(1, 65, dtype=np.uint64)[:, None]
    for g in np.argsort(-counts, kind="stable"):
        n = counts[g]
        if n <= 1:
            break
        keys = order[ends[g] - n : ends[g]]
        base = 0
        while True:
            at = _slot(h1[keys], h2[keys], tries + np.uint64(base), m)
            fits = ~used[at].any(axis=1)
            if n > 1:
                fits &= (np.diff(np.sort(at, axis=1), axis=1) != 0).all(axis=1)
            if fits.any():
                k = int(fits.argmax())
                shift[g], slot[keys], used[at[k]] = base + k + 1, at[k], True
                break
            base += 64
            if base > 64 * max(4096, m):
                raise ValueError("two keys have equal hashes")
    free = iter(np.flatnonzero(~used))
    for g in np.flatnonzero(counts == 1):
        at = next(free)
        shift[g], slot[order[ends[g] - 1]] = -1 - at, at
    return shift, slot


_COUNTS, _COUNTS_SIZE = "<QQ", 16
_SLOTS = (("mark", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("n_tokens", "<i8"))


def build_index(spark: SparkSession, root: str) -> str:
    """Index the manifest of a store: keys are dealt by hash, so every file holds about as many."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    classes = max(1, -(-manifest.count() // KEYS_PER_INDEX))
    spark.createDataFrame([(classes,)], "classes int").write.parquet(f"{root}/classes")

    def index(pdf):
        h1, h2 = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        shift, slot = perfect_hash(h1, h2)
        columns = []
        for name, kind in _SLOTS:
            column = np.empty(len(pdf), dtype=kind)
            column[slot] = pdf[name].to_numpy()
            columns.append(column.tobytes())
        number = int(pdf["class"].iloc[0])
        _write(f"{root}/index/{number}.mph", [struct.pack(_COUNTS, len(shift), len(slot)), shift.astype("<i8").tobytes(), *columns])
        return pdf[["class"]].head(1)

    _hashed(manifest, classes).groupBy("class").applyInPandas(index, "class int").agg(F.count("class")).collect()
    return root


def lookup(keys: DataFrame, root: str) -> DataFrame:
    """(doc_id, copy, shard, offset, n_tokens) of each of ``keys`` (doc_id, copy) that the store holds.

    One hash, one displacement and one slot answer a key; its stored fingerprint
    of 32 bits turns away keys that the store lacks.
    """
    spark = keys.sparkSession
    classes = spark.read.parquet(f"{root}/classes").first()[0]

    def find(pdf):
        store, path = _open(f"{root}/index/{int(pdf['class'].iloc[0])}.mph")
        from pyarrow import fs

        if store.get_file_info(path).type == fs.FileType.NotFound:
            return pdf[["doc_id", "copy"]].assign(shard=0, offset=0, n_tokens=0).head(0)
        with store.open_input_stream(path) as f:
            data = f.read()
        groups, m = struct.unpack_from(_COUNTS, data)
        at = _COUNTS_SIZE
        shift = np.frombuffer(data, "<i8", groups, at)
        at += 8 * groups
        slots = {}
        for name, kind in _SLOTS:
            slots[name] = np.frombuffer(data, kind, m, at)
            at += m * slots[name].itemsize
        h1, h2 = (pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        d = shift[(h1 % np.uint64(groups)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, _slot(h1, h2, np.maximum(d, 0), m))
        hit = slots["mark"][slot] == pdf["mark"].to_numpy()
        out = pdf[["doc_id", "copy"]].copy()
        for name in ("shard", "offset", "n_tokens"):
            out[name] = slots[name][slot]
        return out[hit]

    return _hashed(keys.select("doc_id", "copy"), classes).groupBy("class").applyInPandas(find, MANIFEST)


def read_ids(places: DataFrame, root: str, checksum: bool = False) -> DataFrame:
    """``places`` (as ``lookup`` gives them) with ``ids``, read from the shards in file order.

    With ``checksum`` their number ``n_read`` and ``ids_crc32`` (of little-endian
    unsigned 32-bit integers) stand for the ids, which then stay in the task.
    """

    def rows(batches):
        number, handle, width = None, None, 0
        try:
            for batch in batches:
                for part in slices(batch, 256):
                    found = []
                    cols = (part.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))
                    for shard, offset, n in zip(*cols, strict=True):
                        if shard != number:
                            if handle:
                                handle.close()
                            store, path = _open(f"{root}/shards/{shard}.ids")
                            number, handle = shard, store.open_input_file(path)
                            magic, width, _ = struct.unpack(HEADER, handle.read(HEADER_SIZE))
                            if magic != MAGIC:
                                raise ValueError(f"{path} is no token shard")
                        at = HEADER_SIZE + offset * width
                        if handle.tell() != at:
                            handle.seek(at)
                        ids = np.frombuffer(handle.read(n * width), dtype={2: "<u2", 4: "<u4"}[width])
                        found.append((len(ids), zlib.crc32(ids.astype("<u4"))) if checksum else ids.astype("<i4"))
                    if checksum:
                        new = {name: pa.array([x[k] for x in found], pa.int64()) for k, name in enumerate(("n_read", "ids_crc32"))}
                    else:
                        new = {"ids": pa.array(found, pa.list_(pa.int32()))}
                    yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], names=[*part.schema.names, *new])
        finally:
            if handle:
                handle.close()

    in_order = places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return in_order.mapInArrow(rows, MANIFEST + (", n_read bigint, ids_crc32 bigint" if checksum else ", ids array<int>"))


def shard_starts(spark: SparkSession, root: str) -> DataFrame:
    """(shard, base): ids before each shard; one row a shard, so the running sum is over a small table."""
    totals = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))


def store_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, root: str | None = None) -> DataFrame:
    """Write ``docs`` to a store, look every document up and read it back.

    Returns doc_id, start (ids of all documents before it), n_tokens and the
    unsigned crc32 of its ids as little-endian 32-bit integers, all from files.
    """
    spark = docs.sparkSession
    root = root or f"{shared_folder(spark)}/locusframe/tokens-{uuid.uuid4().hex}"
    write_store(docs, root, tokenizer, end_id)
    keys = docs.groupBy("doc_id").count().select("doc_id", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)).alias("copy"))
    made = read_ids(lookup(keys, root), root, checksum=True)
    return made.join(shard_starts(spark, root), "shard").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32"
    )
