"""Token ids in Arrow files of equal-length sequences, and reading them back.

Documents are range-sorted by id. Each partition writes one Arrow IPC file whose
batches hold ``ids`` (fixed-size list of unsigned integers) and ``mask`` (fixed-size
list of booleans, false on the padding of the last sequence), so row ``i`` of a batch
is at a fixed place in the mapped file and is read without copying. A second, small
Arrow file lists the documents: id, first token in the file, number of tokens.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark import TaskContext

from ..session import scratch_path
from .common import held, picked
from .word_pieces import Memo, vocabulary

BATCH_SEQUENCES = 256
TARGET_BYTES = 32 << 20
_MODELS: dict[str, object] = {}


def _model(path: str):
    """The library's model alone; texts are split by ``word_pieces``."""
    if path not in _MODELS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        bare = Tokenizer(Tokenizer.from_file(path).model)
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        model = vocabulary(path).model
        last = np.zeros(max(model["vocab"].values()) + 1, bool)  # ids that end a word
        last[[i for piece, i in model["vocab"].items() if piece.endswith(model["end_of_word_suffix"])]] = True
        _MODELS[path] = bare, last
    return _MODELS[path]


def _encode_words(v, words: list[str], kind) -> list[bytes]:
    """Ids of words in the byte alphabet; all of them go through the library in one call."""
    if not words:
        return []
    bare, last = _model(v.path)
    ids = np.array(bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids)
    at = [0, *((np.flatnonzero(last[ids]) + 1) * np.dtype(kind).itemsize).tolist()]
    block = ids.astype(kind).tobytes()
    return [block[i:j] for i, j in zip(at, at[1:])]


def encode(texts: list[str | None], path: str, kind=np.uint16) -> list[bytes]:
    """Ids of whole texts as little-endian ``kind``."""
    key = path, np.dtype(kind).name
    memo = held(f"ids {key}", lambda: Memo(path, lambda v, words: _encode_words(v, words, kind), b"".join))
    special = {s: np.array([i], kind).tobytes() for s, i in memo.v.special.items()}
    return [b"".join(special[s] if s else b"".join(ids) for s, ids in parts) for parts in memo.values(texts)]


def id_type(path: str):
    """The smallest unsigned type that holds every id of the vocabulary."""
    v = vocabulary(path)
    top = max([len(v.model["vocab"]), *v.special.values()])
    return np.uint16 if top < 1 << 16 else np.uint32


class SequenceFile:
    """Writes tokens as rows of ``length`` ids and masks, a bounded batch at a time."""

    def __init__(self, path: str, length: int, kind):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.length, self.kind, self.rest, self.total = length, np.dtype(kind), b"", 0
        self.size = self.kind.itemsize
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)),
                            ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(self.path)
        self.file, self.schema = pa.ipc.new_file(self.sink, schema), schema

    def add(self, ids: bytes) -> None:
        self.total += len(ids) // self.size
        step = BATCH_SEQUENCES * self.length * self.size
        ids, at = self.rest + ids, 0
        while len(ids) - at >= step:
            self._write(ids[at:at + step], None)
            at += step
        self.rest = ids[at:]

    def _write(self, block: bytes, filled: int | None) -> None:
        ids = np.frombuffer(block, self.kind)
        mask = np.ones(len(ids), bool) if filled is None else np.arange(len(ids)) < filled
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.rest:
            filled = len(self.rest) // self.size
            self._write(self.rest.ljust(-(-filled // self.length) * self.length * self.size, b"\0"), filled)
        self.file.close()
        self.sink.close()


def _joined(folder: str, name: str) -> str:
    return re.sub("^file:/+", "/", folder).rstrip("/") + "/" + name


def write_token_files(docs: DataFrame, path: str, folder: str | None = None, length: int = 2048, end_id: int = 2,
                      id: str = "doc_id", text: str = "text") -> tuple[str, list[tuple[str, int]]]:
    """Writes the files; returns the folder and ``file, tokens`` of each file, in order.

    Rows go in ascending id, nulls first, equal ids by text. A null text is empty: it
    has the end id alone. Repeated rows are written as often as they come; an empty
    table gives a folder without files. Tasks write under a name of their own attempt
    and rename at the end, so a task that runs again leaves one file.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = picked(docs, doc_id=id, text=text)
    kind = id_type(path)
    fs, place = pafs.FileSystem.from_uri(_joined(folder, ""))
    fs.create_dir(place, recursive=True)
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, size // TARGET_BYTES))
    order = ["doc_id", F.xxhash64("text"), "text"]

    def write(batches):
        task = TaskContext.get()
        name = f"{task.partitionId():06d}"
        attempt = f"{name}.{task.taskAttemptId()}"
        out, index = None, []
        for batch in batches:
            if out is None and batch.num_rows:
                out = SequenceFile(_joined(folder, f"{attempt}.tokens"), length, kind)
            ends = np.array([end_id], kind).tobytes()
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                counts, start = [], out.total
                for ids in encode(part.column(1).to_pylist(), path, kind):
                    out.add(ids + ends)
                    counts.append(len(ids) // out.size + 1)
                begin = start + np.cumsum([0, *counts[:-1]])
                index.append(pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(begin, pa.int64()), pa.array(counts, pa.int64())],
                    names=["doc_id", "first", "n_tokens"]))
        if out is None:
            return
        out.close()
        sink = out.fs.open_output_stream(out.path.removesuffix(".tokens") + ".index")
        with pa.ipc.new_file(sink, index[0].schema) as f:
            for b in index:
                f.write_batch(b)
        sink.close()
        base = out.path.removesuffix(f"{attempt}.tokens")
        for ending, to in ((".tokens", ".arrow"), (".index", ".index.arrow")):
            out.fs.move(f"{base}{attempt}{ending}", f"{base}{name}{to}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.total], pa.int64())], names=["file", "tokens"])

    done = (rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
            .mapInArrow(write, "file string, tokens long"))
    files = sorted(tuple(r) for r in done.collect())  # one short row for each file
    return folder, files


def read_token_files(spark: SparkSession, folder: str, files: list[tuple[str, int]], id_kind: str = "long",
                     verify: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files alone."""
    starts = np.cumsum([0, *[n for _, n in files]]).tolist()
    schema = f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    plan = spark.createDataFrame([(f, starts[i]) for i, (f, _) in enumerate(files)], "file string, offset long")

    def read(batches):
        for batch in batches:
            for name, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = pafs.FileSystem.from_uri(_joined(folder, name))
                local = isinstance(fs, pafs.LocalFileSystem)
                opened = (lambda p: pa.memory_map(p)) if local else fs.open_input_file
                with opened(f"{at}.index.arrow") as f:
                    index = pa.ipc.open_file(f).read_all()
                with opened(f"{at}.arrow") as f:
                    tokens = Tokens(pa.ipc.open_file(f))
                    begin, count = (index.column(c).to_numpy() for c in ("first", "n_tokens"))
                    crc = [zlib.crc32(tokens.read(int(b), int(n)).astype("<u4").tobytes())
                           for b, n in zip(begin, count)]
                yield pa.RecordBatch.from_arrays(
                    [index.column("doc_id").combine_chunks(), pa.array(begin + offset, pa.int64()),
                     pa.array(count, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    return plan.repartition(spread).mapInArrow(read, schema)


class Tokens:
    """Random access to the tokens of an open file; only the batches asked for are touched."""

    def __init__(self, file):
        self.file = file
        self.length = file.schema.field("ids").type.list_size
        self.block = BATCH_SEQUENCES * self.length
        self._at, self._ids = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._ids = k, self.file.get_batch(k).column(0).flatten().to_numpy()
        return self._ids

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        batch = self.file.get_batch(i // BATCH_SEQUENCES)
        k = i % BATCH_SEQUENCES
        return batch.column(0)[k].values.to_numpy(), batch.column(1)[k].values.to_numpy(zero_copy_only=False)

    def read(self, begin: int, count: int) -> np.ndarray:
        parts = []
        while count:
            k, inside = divmod(begin, self.block)
            part = self._batch(k)[inside:inside + count]
            parts.append(part)
            begin, count = begin + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def token_files(docs: DataFrame, path: str, folder: str | None = None, length: int = 2048, end_id: int = 2,
                id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files and returns the documents as read back from them."""
    id_kind = docs.schema[id].dataType.simpleString()
    folder, files = write_token_files(docs, path, folder, length, end_id, id, text)
    return read_token_files(docs.sparkSession, folder, files, id_kind)
