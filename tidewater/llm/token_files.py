"""Token-id files: independent zstandard frames with a trailing seek table.

File layout (all numbers little-endian)::

    frame 0 .. n-1      zstandard frames; each holds the ids of whole documents
    index frame         zstandard frame: doc ids, null marks, tokens per document, frame of each
    seek table          skippable frame 0x184D2A5E: per frame compressed size, plain size and
                        checksum (lower half of its XXH64), then frame count, flags, 0x8F92EAB1

The seek table is that of the public seekable zstandard format, so a plain
decompressor still reads the file. A reader takes the footer, the table and the
index, and then decompresses only the frames of the documents it wants; every
frame is checked against its checksum.

Documents are range-partitioned and sorted by id, and each partition becomes
one or more files in the shared folder, of ``FILE_TOKENS`` tokens and the last
document's rest at most: a file's index stays small. A task attempt writes to a name of its own; only
the names of successful attempts reach the manifest, so lost executors leave at
most unused files behind.

Defined cases: null text counts as empty; a null doc_id sorts first; rows that
repeat an id are separate documents, ordered by a hash of the text and then the
text; an empty table gives no files; other columns are ignored. A document's ids
are in one frame whatever their number, so a very long text is held whole by
the one task that writes it, and by the one that reads it.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.base import fresh_path, read, schema, ship, shuffle_parts
from tidewater.llm.tokens import encoder, slices, with_endings

FRAME_TOKENS = 1 << 16
#: A file ends with the document that reaches this many tokens.
FILE_TOKENS = 1 << 26
END_ID = 2
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
LEVEL = 3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenFileWriter:
    """Writes one file; ``add`` takes ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, sink, frame_tokens: int = FRAME_TOKENS):
        import zstandard

        self.sink, self.frame_bytes = sink, 4 * frame_tokens
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[bytes] = []
        self.size = 0
        self.tokens = 0
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.frames: list[int] = []

    def add(self, doc_id: int | None, ids: bytes | memoryview) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.frames.append(len(self.table))
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        if self.size >= self.frame_bytes:
            self._flush()

    def _frame(self, plain: bytes) -> None:
        import xxhash

        packed = self.packer.compress(plain)
        self.sink.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64(plain).intdigest() & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def close(self) -> None:
        import numpy as np

        self._flush()
        n = len(self.ids)
        index = [
            struct.pack("<Q", n),
            np.array([0 if i is None else i for i in self.ids], "<i8").tobytes(),
            np.array([i is None for i in self.ids], "u1").tobytes(),
            np.array(self.counts, "<u8").tobytes(),
            np.array(self.frames, "<u4").tobytes(),
        ]
        self._frame(b"".join(index))
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class TokenFileReader:
    """Random access to one file. ``source`` needs ``read``, ``seek`` and ``size``."""

    def __init__(self, source):
        import numpy as np

        self.source = source
        end = source.size()
        footer = self._at(end - 9, 9)
        count, flags, magic = struct.unpack("<IBI", footer)
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        body = self._at(end - 9 - 12 * count, 12 * count)
        self.table = [struct.unpack_from("<III", body, 12 * i) for i in range(count)]
        self.starts = [0]
        for packed, _, _ in self.table:
            self.starts.append(self.starts[-1] + packed)
        index = self.frame(count - 1)
        n = struct.unpack_from("<Q", index)[0]
        columns, at = [], 8
        for kind, width in (("<i8", 8), ("u1", 1), ("<u8", 8), ("<u4", 4)):
            columns.append(np.frombuffer(index, kind, n, at))
            at += width * n
        self.doc_ids, null, counts, self.frames = columns
        self.null, self.counts = null.astype(bool), counts.astype("i8")
        self.starts_tokens = np.concatenate([[0], np.cumsum(self.counts)])

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, plain, check = self.table[k]
        out = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], packed), max_output_size=max(1, plain))
        if len(out) != plain or xxhash.xxh64(out).intdigest() & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return out

    def document(self, row: int) -> bytes:
        """The ids of the document in this row of the index; decompresses one frame."""
        import numpy as np

        k = int(self.frames[row])
        first = int(np.searchsorted(self.frames, k))
        skip = 4 * int(self.starts_tokens[row] - self.starts_tokens[first])
        return self.frame(k)[skip : skip + 4 * int(self.counts[row])]

    def frames_of_documents(self):
        """Each frame's list of (doc_id, ids)."""
        row, n = 0, len(self.counts)
        while row < n:
            k, at, plain, rows = int(self.frames[row]), 0, self.frame(int(self.frames[row])), []
            while row < n and int(self.frames[row]) == k:
                size = 4 * int(self.counts[row])
                rows.append((None if self.null[row] else int(self.doc_ids[row]), plain[at : at + size]))
                at += size
                row += 1
            yield rows

    def documents(self):
        """All (doc_id, ids), frame by frame."""
        for rows in self.frames_of_documents():
            yield from rows


def open_file(path: str, mode: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if mode == "w":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_file(inner)


MANIFEST = "part int, file int, path string, n_docs bigint, n_tokens bigint"


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, shards: int | None = None, file_tokens: int = FILE_TOKENS) -> list[dict]:
    """Tokenize and write; one manifest entry per file, in ascending document order."""
    ship(docs.sparkSession)
    shards = shards or shuffle_parts(docs.sparkSession)

    def write(parts):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        done = {"part": [], "file": [], "path": [], "n_docs": [], "n_tokens": []}
        sink, writer, path = None, None, ""

        def close():
            writer.close()
            sink.close()
            for name, x in zip(done, (part, len(done["file"]), path, len(writer.ids), sum(writer.counts)), strict=True):
                done[name].append(x)

        for batch in parts:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts):
                found, bounds = with_endings(*encoder(vocabulary, True).encode(texts.slice(a, b - a)), end_id)
                raw, bounds = memoryview(found.tobytes()), (4 * bounds).tolist()
                for k, doc_id in enumerate(ids[a:b]):
                    if sink is None:
                        path = f"{folder}/{part:06d}-{len(done['file']):04d}-{uuid.uuid4().hex}.tok"
                        sink = open_file(path, "w")
                        writer = TokenFileWriter(sink)
                    writer.add(doc_id, raw[bounds[k] : bounds[k + 1]])
                    if writer.tokens >= file_tokens:
                        close()
                        sink = None
        if sink is not None:
            close()
        if done["file"]:
            yield pa.RecordBatch.from_pydict(done, pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows that share an id are dealt by their texts, so that one id's rows needn't meet in one task.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = own.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")
    # Sorted here: a sort in Spark would sample, and so run, the writing twice.
    return sorted((r.asDict() for r in dealt.mapInArrow(write, schema(MANIFEST)).collect()), key=lambda m: (m["part"], m["file"]))


TOKENS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; a task reads a file frame by frame."""
    if not manifest:
        return spark.createDataFrame([], schema(TOKENS))
    ship(spark)
    files, total = [], 0
    for m in manifest:
        files.append((m["path"], total))
        total += m["n_tokens"]

    def load(parts):
        import pyarrow as pa

        for batch in parts:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path, "r") as source:
                    for rows in TokenFileReader(source).frames_of_documents():
                        sizes = [len(ids) // 4 for _, ids in rows]
                        starts = list(itertools.accumulate(sizes, initial=at))
                        at = starts.pop()
                        columns = [[i for i, _ in rows], starts, sizes, [zlib.crc32(ids) for _, ids in rows]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(files, schema("path string, start bigint"))
    return listed.repartition(len(files)).mapInArrow(load, schema(TOKENS))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    manifest = write_token_files(docs, default_vocabulary(), fresh_path(spark, "tokens"))
    return read_token_files(spark, manifest)
