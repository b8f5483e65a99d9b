"""Token-ID output as Arrow files of fixed-size lists.

Texts are encoded with a byte-level BPE vocabulary (a file whose path is a parameter), laid end to end with an
end-of-text token after each, and cut into sequences of equal length. Sequences go, ``rows_per_file`` at a
time, into Arrow IPC files whose two columns are fixed-size lists: ``input_ids`` (uint16 or uint32) and ``mask``
(uint8; 0 where the last sequence is padded). A reader maps a file and takes any sequence or mask without a copy.

Plan: one narrow pass; each task packs the rows of its input partition in their order, so a task that is run
again writes the same. The result's rows hold whole Arrow files as binary, so they are committed by Spark's own
output protocol like any table; ``save`` puts them out as files.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import col, file_system, release, text_batches

LENGTH, ROWS_PER_FILE, EOT = 2048, 512, 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer pattern published with the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "file_id string, sequences int, tokens long, padding int, doc_ids array<long>, doc_starts array<long>, arrow binary"

_ENCODERS: dict = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer, loaded once in a process. Special tokens' texts are ordinary text."""
    key = vocabulary, pattern
    if key not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def arrow_file(ids: np.ndarray, mask: np.ndarray) -> bytes:
    """An Arrow IPC file with one batch; ids and mask: (sequences, length)."""
    length = ids.shape[1]
    columns = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), length) for x in (ids, mask)]
    batch = pa.RecordBatch.from_arrays(columns, names=["input_ids", "mask"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def open_sequences(source) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of an Arrow file (a path, which is mapped, or bytes) as (sequences, length) views, without a copy."""
    source = pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source)
    batch = pa.ipc.open_file(source).get_batch(0)
    length = batch.schema.field("input_ids").type.list_size
    return tuple(batch.column(c).values.to_numpy(zero_copy_only=True).reshape(-1, length) for c in ("input_ids", "mask"))


class Packer:
    """Takes (doc_id, tokens), gives full files as rows of SCHEMA."""

    def __init__(self, length: int, rows: int, eot: int, name: str):
        self.length, self.rows, self.eot, self.name, self.number = length, rows, eot, name, 0
        self.dtype = np.uint16 if eot < 65536 else np.uint32
        self.size = length * rows
        self.buffer, self.fill, self.ids, self.starts = np.empty(self.size, self.dtype), 0, [], []

    def add(self, doc, tokens: np.ndarray):
        tokens = np.append(tokens.astype(self.dtype), self.dtype(self.eot))
        at = 0
        while at < len(tokens):
            self.ids.append(doc)
            self.starts.append(self.fill if at == 0 else -1)
            n = min(self.size - self.fill, len(tokens) - at)
            self.buffer[self.fill : self.fill + n] = tokens[at : at + n]
            self.fill += n
            at += n
            if self.fill == self.size:
                yield self.take()

    def take(self) -> tuple:
        rows = -(-self.fill // self.length)
        ids = self.buffer[: rows * self.length]
        ids[self.fill :] = self.eot
        mask = np.zeros(rows * self.length, np.uint8)
        mask[: self.fill] = 1
        out = (f"{self.name}-{self.number:06d}", rows, self.fill, rows * self.length - self.fill, self.ids, self.starts, arrow_file(ids.reshape(rows, -1), mask.reshape(rows, -1)))
        self.number, self.fill, self.ids, self.starts = self.number + 1, 0, [], []
        self.buffer = np.empty(self.size, self.dtype)
        return out


def sequences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, length: int = LENGTH, rows_per_file: int = ROWS_PER_FILE, eot: int = EOT) -> DataFrame:
    """(file_id, sequences, tokens, padding, doc_ids, doc_starts, arrow), a row for each Arrow file.

    doc_ids lists the documents with tokens in the file, in order, and doc_starts the place of each one's first
    token in the file (-1: it began in a former file of the same partition). tokens counts those with mask 1, an
    end-of-text token after each document included. file_id is unique within a run.

    Only the last sequence of a partition is padded, with the end-of-text token. A null text gives no tokens and
    isn't listed; an empty one gives its end-of-text token. A null id is listed as null. Repeated rows are
    encoded each. A long text goes on over sequences and files. Other columns aren't read. An empty table gives
    no rows.
    """
    docs = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text")).where("text IS NOT NULL")

    def run(batches):
        task = TaskContext.get()
        encoding = encoder(vocabulary, pattern)
        packer = Packer(length, rows_per_file, eot, f"part-{task.partitionId() if task else 0:06d}")
        for whole in batches:
            for b in text_batches(whole, "text", 1 << 20):
                for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    for row in packer.add(doc, np.array(_encode(encoding, t), packer.dtype)):
                        yield _batch(row)
        if packer.fill:
            yield _batch(packer.take())
        release()

    return docs.mapInArrow(run, SCHEMA)


#: The white space of the pattern.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_SPACE = re.compile(f"[{_SPACE}]{{1000,}}")


def _encode(encoding, text: str, limit: int = 1 << 20) -> list[int]:
    """The tokens of the whole text, though long ones are encoded in parts, each cut where the pattern begins a new
    piece in any case: at long white space and, in what lies between, before a blank between two letters. Of white
    space that isn't at the end all but the last character are a piece; the pattern itself, which would go back a
    character at a time, isn't run over it."""
    out, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += _in_parts(encoding.encode_ordinary, text[at : m.start()], limit)
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + _in_parts(encoding.encode_ordinary, text[at:], limit)


def _in_parts(encode, text: str, limit: int) -> list[int]:
    if len(text) <= limit:
        return encode(text)
    out, at = [], 0
    while at < len(text):
        end = at + limit
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and end + 1 < len(text) and text[end + 1].isalpha()):
            end += 1
        out += encode(text[at:end])
        at = end
    return out


def _batch(row: tuple) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["file_id", "sequences", "tokens", "padding", "doc_ids", "doc_starts", "arrow"])


def save(files: DataFrame, folder: str) -> DataFrame:
    """(path, bytes): writes each row's Arrow file to folder/<file_id>.arrow, a path or URI that all executors see.
    A file appears whole or not at all, also if a task runs twice. A row with a null file_id or file is left out; of
    rows that repeat a file_id the last written stays. An empty table writes nothing."""

    def run(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            for name, data in zip(b.column("file_id").to_pylist(), b.column("arrow"), strict=True):
                temporary = f"{base}/.{name}.{os.urandom(8).hex()}.tmp"
                with system.open_output_stream(temporary, compression=None) as f:
                    f.write(data.as_buffer())
                system.move(temporary, f"{base}/{name}.arrow")
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}.arrow"]), pa.array([data.as_buffer().size], pa.int64())], names=["path", "bytes"])

    return files.select("file_id", "arrow").where("file_id IS NOT NULL AND arrow IS NOT NULL").mapInArrow(run, "path string, bytes long")
