"""Length-delimited binary records of token ids.

A record frames one document's sequence: the payload's length as unsigned 64-bit integer, the masked checksum of those eight
bytes, the payload, the masked checksum of the payload; all little-endian. The masking is that of the public TFRecord format
(rotate right by 15 bits, add a constant), over zlib's crc32, as the standard library has no crc32c. The payload is a flag byte (1:
the id is null), the id as signed 64-bit, the width of an id in bytes (2 or 4, by the vocabulary), then the ids.

Beside each data file lies an index of its own: per record the byte offset, the number of ids and the document's id, then the
masked checksum of all that. With it a reader takes records in any (shuffled) order without a scan.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import in_id_order, local_files, materialize, scratch, shuffle_partitions, table
from threadloom.llm.wordcodec import codec, tokenizer_path

#: Fixed value of the format.
MASK = 0xA282EAD8
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
HEAD = struct.Struct("<Bqb")
ENTRY = np.dtype([("at", "<u8"), ("n", "<u8"), ("null", "u1"), ("id", "<i8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return HEAD.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    null, doc_id, width = HEAD.unpack_from(data)
    return (None if null else doc_id), np.frombuffer(data, f"<u{width}", offset=HEAD.size).astype("<u4")


def read_frame(f) -> bytes | None:
    """The payload of the next record; None at the end. A wrong checksum or a cut record raises ValueError."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("corrupt record length")
    (size,) = struct.unpack("<Q", head[:8])
    data = f.read(size)
    tail = f.read(4)
    if len(data) < size or len(tail) < 4 or masked(data) != struct.unpack("<I", tail)[0]:
        raise ValueError("corrupt record")
    return data


def read_records(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each record of a data file, in order."""
    fs, name = local_files(path)
    with fs.open_input_stream(name, buffer_size=1 << 20) as f:
        while (data := read_frame(f)) is not None:
            yield parse(data)


def read_index(path: str) -> np.ndarray:
    """The index of the data file `path`, as an array of ENTRY."""
    fs, name = local_files(path + ".idx")
    with fs.open_input_stream(name) as f:
        raw = f.read()
    if masked(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("corrupt index")
    return np.frombuffer(raw[:-4], ENTRY)


def read_at(path: str, numbers: Sequence[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of these numbers, in the order asked for, by way of the index."""
    index = read_index(path)
    fs, name = local_files(path)
    out = []
    with fs.open_input_file(name) as f:
        for k in numbers:
            f.seek(int(index["at"][k]))
            out.append(parse(read_frame(f)))
    return out


def write_records(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Encode every text, add end_id, and write data files and indexes to the folder `out` in ascending id order (nulls first, equal ids by text). Returns the files: part, path, n_docs, n_tokens.

    Documents are dealt out by ranges of id and text's beginning, so file k's ids precede those of file k + 1, and rows that
    share an id, or have none, are spread too. A null or empty text is end_id alone. A task writes
    under a name of its own and renames at the end, so that a repeated or lost task leaves whole files or none. Only id_col and
    text_col are read, whatever other columns are called. An empty table gives no files.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    n = partitions or shuffle_partitions(docs.sparkSession)

    def write(batches):
        part, own, fs_out = TaskContext.get().partitionId(), codec(path), None
        width = 2 if own.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end, at, total, entries = np.uint32(end_id), 0, 0, []
        fs, folder = local_files(out)
        name, temp = f"{folder}/part-{part:06d}.rec", f"{folder}/.{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if fs_out is None:
                fs.create_dir(folder, recursive=True)
                fs_out = fs.open_output_stream(temp, buffer_size=1 << 20)
            for first, counts, tokens in own.groups(batch):
                b = 0
                for k, n in enumerate(counts.tolist()):
                    a, b = b, b + n
                    doc_id, seq = ids[first + k], np.append(tokens[a:b], end)
                    record = frame(payload(doc_id, seq, width))
                    fs_out.write(record)
                    entries.append((at, len(seq), doc_id is None, doc_id or 0))
                    at += len(record)
                    total += len(seq)
        if fs_out is None:
            return
        fs_out.close()
        index = np.array(entries, ENTRY).tobytes()
        with fs.open_output_stream(temp + ".idx") as f:
            f.write(index + struct.pack("<I", masked(index)))
        fs.move(temp + ".idx", name + ".idx")
        fs.move(temp, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{out}/part-{part:06d}.rec"], "n_docs": [len(entries)], "n_tokens": [total]})

    return materialize(in_id_order(docs, id_col, text_col, n).mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "record-files")


def read_digests(files: DataFrame) -> DataFrame:
    """Per record of the files: doc_id, start (ids of all records before it, over all files), n_tokens, ids_crc32, read back from the data files with each checksum verified."""

    def digests(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, ids in read_records(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    # one row a file: the sum over them is small whatever the files hold
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    at = at.repartitionByRange(shuffle_partitions(files.sparkSession), "part").select("path", "start")
    return at.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op9_binary_records(spark, sf_dir):
    return read_digests(write_records(table(spark, sf_dir, "documents"), scratch(spark, "records")))
