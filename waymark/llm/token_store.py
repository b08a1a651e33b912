"""Operator 4: token ids in a seekable binary file.

A file is a row of independent zstandard frames. A frame holds whole documents: their number, the width of an id, doc_ids,
lengths, ids. Two skippable frames end the file: the document index (for each frame its first doc_id, documents and ids)
and the seek table of the public seekable format (for each frame its packed size, size and the low 32 bits of its XXH64).
A reader fetches the two tables, then only the frames that hold the documents asked for, and checks each frame's sum.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import shared_folder, table, texts
from waymark.llm.tokens import pieces

# Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_DOC = -(2**63)  # stands for a null doc_id
INDEX = np.dtype([("first", "<i8"), ("docs", "<u8"), ("ids", "<u8")])
SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


class Writer:
    """Writes documents into a stream; frames close once they hold frame_bytes of ids. A frame has one document at least."""

    def __init__(self, stream, width: int, frame_bytes: int = 1 << 18, level: int = 1):
        self.stream, self.width, self.frame_bytes = stream, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.seek, self.index, self.held, self.size = [], [], [], 0

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.held.append((doc_id, ids))
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        lengths = np.array([len(x) // self.width for _, x in self.held], "<u4")
        raw = b"".join([struct.pack("<II", len(self.held), self.width), np.array([d for d, _ in self.held], "<i8").tobytes(), lengths.tobytes(), *[x for _, x in self.held]])
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((self.held[0][0], len(self.held), int(lengths.sum(dtype=np.int64))))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.index, INDEX).tobytes()
        seek = np.array(self.seek, SEEK).tobytes() + struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)
        self.stream.close()


class Reader:
    """Random access to the documents of one file (an object with seek, read and size())."""

    def __init__(self, source):
        self.source, end = source, source.size()
        source.seek(end - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        tail = frames * (SEEK.itemsize + INDEX.itemsize) + 16 + 9
        source.seek(end - tail)
        block = source.read(tail)
        at = frames * INDEX.itemsize
        self.index = np.frombuffer(block[8 : 8 + at], INDEX)
        self.seek = np.frombuffer(block[at + 16 : -9], SEEK)
        self.at = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        self.before = np.concatenate([[0], np.cumsum(self.index["ids"], dtype=np.int64)])

    def frame(self, k: int) -> list[tuple[int, bytes]]:
        """The documents of frame k with their ids as unsigned 32-bit integers."""
        self.source.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.seek["packed"][k])))
        if len(raw) != self.seek["size"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek["sum"][k]:
            raise ValueError(f"frame {k} is damaged")
        n, width = struct.unpack_from("<II", raw)
        docs, lengths = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u4", n, 8 + 8 * n)
        ends = 8 + 12 * n + np.cumsum(lengths, dtype=np.int64) * width
        out = []
        for d, length, end in zip(docs.tolist(), lengths.tolist(), ends.tolist()):
            ids = raw[end - length * width : end]
            out.append((d, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids))
        return out

    def document(self, doc_id: int) -> list[bytes]:
        """Ids of every document with this doc_id; unpacks only the frames that may hold it."""
        last = int(np.searchsorted(self.index["first"], doc_id, "right"))
        first = max(0, int(np.searchsorted(self.index["first"], doc_id, "left")) - 1)
        return [ids for k in range(first, last) for d, ids in self.frame(k) if d == doc_id]


def opened(path: str):
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system, inner


def write(docs: DataFrame, folder: str, tokenizer: str, cut: str, end_id: int | None, vocabulary: int) -> list[tuple[str, int, int]]:
    """Files (path, documents, ids) in ascending doc_id order, written by the tasks that hold a range of doc_ids.

    A file's name is its attempt's own, and only files of tasks that ended are listed: a lost executor leaves no gap.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    width = 2 if vocabulary <= 1 << 16 else 4

    def write_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library, part = pieces(tokenizer, cut, limit=500_000), TaskContext.get().partitionId()
        writer, docs_n, ids_n, path = None, 0, 0, f"{folder}/{part:07d}-{uuid.uuid4().hex}.zst"
        for pdf in batches:
            if writer is None and len(pdf):
                system, inner = opened(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                writer = Writer(system.open_output_stream(inner, compression=None), width)
            for doc, ids in zip(pdf["doc_id"], library.batch(texts(pdf["text"]))):
                ids += end
                writer.add(NO_DOC if pd.isna(doc) else int(doc), ids)
                docs_n, ids_n = docs_n + 1, ids_n + len(ids) // 4
        if writer is not None:
            writer.close()
            yield pd.DataFrame({"part": [part], "path": [path], "docs": [docs_n], "ids": [ids_n]})

    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    listed = ranged.mapInPandas(write_part, "part int, path string, docs long, ids long").collect()  # one row a file
    return [(r.path, r.docs, r.ids) for r in sorted(listed, key=lambda r: r.part)]


def read(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of each document of the files."""
    base, rows = 0, []
    for path, _, ids in files:
        rows.append((path, base))
        base += ids

    def read_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["base"].tolist()):
                system, inner = opened(path)
                with system.open_input_file(inner) as source:
                    reader = Reader(source)
                    for k in range(len(reader.index)):
                        got = reader.frame(k)
                        n = np.array([len(ids) // 4 for _, ids in got], np.int64)
                        yield pd.DataFrame({
                            "doc_id": pd.array([None if d == NO_DOC else d for d, _ in got], "Int64"),
                            "start": start + np.concatenate([[0], np.cumsum(n)[:-1]]), "n_tokens": n, "ids_crc32": [zlib.crc32(ids) for _, ids in got],
                        })
                        start += int(n.sum())

    listed = spark.createDataFrame(rows, "path string, base long")
    return listed.repartition(max(1, len(rows))).mapInPandas(read_part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text is empty (end id alone), null doc_id sorts first, rows with the same doc_id follow each other by text."""
    import public_tokenizers

    folder = shared_folder(spark, "token-store")
    files = write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), "lead", 2, 50_257)
    return read(spark, files)
