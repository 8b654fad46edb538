"""Token ids in seekable zstandard files (operator 4).

A file holds documents in ascending doc_id order:

    data frames   independent zstandard frames of whole documents' ids, each id
                  a little-endian unsigned 32-bit integer (a longer document
                  has several frames)
    index frame   a skippable frame (magic 0x184D2A50): a zstandard frame of
                  the doc_ids (int64, then a byte for each: 1 if null) and the
                  numbers of ids (int64)
    seek table    the skippable frame of the public seekable format (magic
                  0x184D2A5E): for each frame its compressed size, its size
                  and, of data, the low 32 bits of its XXH64; then the number
                  of frames, a flag byte and the magic 0x8F92EAB1

so that a reader finds a document's frames from the file's tail, fetches only
those, decompresses each on its own and checks it."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, shared_dir, ship, slices, small, written
from .token_counts import cut_word

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME = 1 << 18
LEVEL = 3
END_ID = 2
#: Bytes of one Python worker's table (with OVERHEAD for each entry), bytes and
#: words that the library encodes at once, bytes of text that are split at once.
TABLE, OVERHEAD, BYTES_AT_ONCE, AT_ONCE, SLICE = 224 << 20, 200, 1 << 18, 4_096, 2 << 20
#: Longer words aren't remembered.
REMEMBERED = 64


class Encoder:
    """Ids of a text as the library gives them.  The library never merges over
    white space (its pre-tokenizer matches none), so words between ASCII white
    space are encoded one by one, a long one in parts where splitting is certain;
    a table of bounded bytes keeps short words already seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.held = 0

    def _encode(self, words: list[bytes]) -> list[bytes]:
        got = self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _learn(self, words: list[bytes]) -> None:
        for word, ids in zip(words, self._encode(words), strict=True):
            self.words[word] = ids
            self.held += len(word) + len(ids) + OVERHEAD

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        if self.held > TABLE:
            self.words.clear()
            self.held = 0
        known = self.words
        fresh, size = [], 0
        for word in {w for words in split for w in words if w not in known and len(w) <= REMEMBERED}:
            fresh.append(word)
            size += len(word)
            if len(fresh) >= AT_ONCE or size >= BYTES_AT_ONCE:
                self._learn(fresh)
                fresh, size = [], 0
        self._learn(fresh)
        out = []
        for words in split:
            try:
                out.append(b"".join(map(known.__getitem__, words)))
            except KeyError:  # a long word
                out.append(b"".join([ids if (ids := known.get(w)) is not None else self._long(w) for w in words]))
        return out

    def _long(self, word: bytes) -> bytes:
        return b"".join([self._encode([part])[0] for part in cut_word(word)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, out):
        self.out, self.held, self.docs, self.counts, self.frames = out, bytearray(), [], [], []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and len(self.held) + len(ids) > FRAME:
            self._frame()
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held += ids
        while len(self.held) > FRAME:
            self._frame()

    def _frame(self) -> None:
        data = bytes(self.held[:FRAME])
        del self.held[:FRAME]
        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame()
        null = np.array([d is None for d in self.docs], np.uint8)
        index = np.array([d or 0 for d in self.docs], "<i8").tobytes() + null.tobytes() + np.array(self.counts, "<i8").tobytes()
        packed = self.zstd.compress(index)
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, 0))
        rows = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(rows) + 9) + rows + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC))


class Reader:
    """Reads documents of one file; ``read(offset, size)`` fetches bytes."""

    def __init__(self, read, size: int):
        self.read, self.unzstd = read, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        rows = np.frombuffer(read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.checks = rows[:-1, 2]
        self.at = np.r_[0, np.cumsum(rows[:, 0])]
        self.starts = np.r_[0, np.cumsum(rows[:-1, 1])]
        index = self.unzstd.decompress(read(int(self.at[-2]) + 8, int(rows[-1, 0]) - 8))
        k = len(index) // 17
        null = np.frombuffer(index, np.uint8, k, 8 * k)
        self.docs = [None if z else d for d, z in zip(np.frombuffer(index, "<i8", k).tolist(), null.tolist(), strict=True)]
        self.counts = np.frombuffer(index, "<i8", k, 9 * k)
        self.bounds = np.r_[0, np.cumsum(self.counts * 4)]
        self.last: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            data = self.unzstd.decompress(self.read(int(self.at[k]), int(self.at[k + 1] - self.at[k])), int(self.starts[k + 1] - self.starts[k]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k}: wrong checksum")
            self.last = (k, data)
        return self.last[1]

    def document(self, i: int) -> bytes:
        """Ids of the i-th document; only its frames are read."""
        a, b = int(self.bounds[i]), int(self.bounds[i + 1])
        parts = []
        for k in range(int(np.searchsorted(self.starts, a, "right")) - 1, len(self.starts) - 1):
            if self.starts[k] >= b:
                break
            start = int(self.starts[k])
            parts.append(self._frame(k)[max(0, a - start) : b - start])
        return b"".join(parts)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def reader(uri: str) -> Reader:
    fs, path = _opened(uri)
    source = fs.open_input_file(path)

    def read(offset: int, size: int) -> bytes:
        source.seek(offset)
        return source.read(size)

    return Reader(read, source.size())


def write_documents(documents: DataFrame, path: str, folder: str, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encodes and writes all documents; returns the written files (file, part,
    n_docs, n_ids), part ascending with doc_id.

    Texts are shuffled once, by ranges of doc_id (rows of one id by their text's
    hash), and encoded after it.  A task writes its file under a name of its own attempt;
    only names that the driver's table lists count, so repeated and speculative
    attempts do no harm.  ``folder``: a URI that executors can write.  Null and
    empty texts are the end id alone; null ids come first."""
    spark = ship(documents.sparkSession)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, coder, n = None, encoder(path), 0
        for batch in slices(batches, "text", SLICE):
            if writer is None:
                part = TaskContext.get().partitionId()
                uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                fs, at = _opened(uri)
                fs.create_dir(os.path.dirname(at))
                out = fs.open_output_stream(at, compression=None)
                writer = Writer(out)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.ids([t or b"" for t in as_bytes(batch.column("text"))]), strict=True):
                writer.add(doc, ids + end)
                n += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([uri, part, len(writer.docs), n], schema.types, strict=True)], schema=schema)

    # rows of one id, and of null ids, may be spread over several ranges
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    texts = texts.repartitionByRange(files, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return written(texts.mapInArrow(run, "file string, part long, n_docs long, n_ids long"), "files")


def read_documents(files: DataFrame) -> DataFrame:
    """(part, place, doc_id, n_tokens, ids_crc32, ids_before) of every document
    in ``files``, read back from them: place counts in the file, ids_before is
    the number of ids before it in the file."""
    ship(files.sparkSession)
    schema = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids_before", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri, part in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), strict=True):
                r = reader(uri)
                for a in range(0, len(r.docs), 4096):
                    n = min(4096, len(r.docs) - a)
                    crcs = [zlib.crc32(r.document(i)) for i in range(a, a + n)]
                    columns = [[part] * n, range(a, a + n), r.docs[a : a + n], r.counts[a : a + n].tolist(), crcs, (r.bounds[a : a + n] // 4).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("file", "part").repartition(tasks, "part")
    return spread.mapInArrow(run, "part long, place long, doc_id long, n_tokens long, ids_crc32 long, ids_before long")


def token_files(documents: DataFrame, path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes all documents' ids and returns, from the files read back, one row
    per document: doc_id, start (ids of all documents before it), n_tokens
    (with the end id), ids_crc32 (of those ids as little-endian unsigned 32-bit
    integers) and file.

    Texts: null as empty.  Repeated ids stay separate documents, next to each
    other.  Other columns of ``documents`` are not written.  An empty table
    gives no file and no row.  ``folder`` is by default a new one in the shared
    folder."""
    spark = documents.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex[:12]}"
    files = write_documents(documents, path, folder, end_id)
    # one row a file: blocks of files, then files in a block
    blocks = files.withColumn("block", F.floor(F.col("part") / 1024))
    from pyspark.sql import Window

    def before(by):
        return F.coalesce(F.sum("n_ids").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ahead = blocks.groupBy("block").agg(F.sum("n_ids").alias("n_ids")).select("block", before(Window.orderBy("block")).alias("block_start"))
    starts = blocks.withColumn("in_block", before(Window.partitionBy("block").orderBy("part"))).join(ahead, "block").select("part", "file", (F.col("block_start") + F.col("in_block")).alias("file_start"))
    # the files' starts may be broadcast, the documents never
    docs = read_documents(files).join(small(written(starts, "starts"), 300), "part")
    return docs.select("doc_id", (F.col("file_start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32", "file", "place")

