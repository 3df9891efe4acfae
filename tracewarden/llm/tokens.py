"""Token ids in Arrow files of fixed-size-list batches.

A file is a shard: the documents of one range of doc_id, in order, as one stream of ids cut into sequences of equal
length. Each record batch holds ``input_ids`` (fixed-size lists of unsigned integers) and ``mask`` (fixed-size lists of
booleans, false on the padding of a shard's last sequence). Nothing is compressed: a memory-mapped file gives any
sequence, or any document through the index, without a copy.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID, documents, partitions, saved, shared_folder

LENGTH = 1024
#: Sequences in a record batch; words and pieces whose ids a worker remembers.
SEQUENCES, REMEMBERED = 64, 500_000
END = 0
#: How byte-level tokenizers cut texts.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Whole-text encoding through the tokenizers library, remembering words.

    A byte-level tokenizer attaches a lone space to what follows it and lets no piece reach over it; texts are cut
    there, the pieces of each different word go through the library's model once, and the ids are strung together.
    Texts in which a space stands beside white space are cut into pieces as a whole. Texts that hold an added token,
    and all texts of tokenizers of another kind, go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.by_word = self.tokenizer.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space
        # The letter that stands for each byte in the vocabulary.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}
        self.cut = regex.compile(PIECES).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            letters = piece.encode().decode("latin-1").translate(self.letters)
            found = self.pieces[piece] = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        return found

    def _cut(self, text: str) -> bytes:
        return b"".join([self._piece(p) for p in self.cut(text)])

    def _word(self, word: str) -> bytes:
        body = word[1:] if word[:1] == " " else word
        if body.isalpha():
            return self._piece(word)
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return self._piece(word[:-1]) + self._piece(word[-1])
        return self._cut(word)

    def _encoded(self, text: str) -> bytes:
        if not self.by_word or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        first, *words = text.split(" ")
        last = words.pop() if words else "."
        known = self.words
        new = set(words).difference(known)
        if any(not w or w[0].isspace() or w[-1].isspace() for w in new) or not first or first[-1].isspace() or not last or last[0].isspace():
            return self._cut(text)
        for word in new:
            known[word] = self._word(" " + word)
        parts = [known[w] for w in words]
        return self._word(first) + b"".join(parts) + (self._word(" " + last) if " " in text else b"")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        for memory in (self.words, self.pieces):
            if len(memory) > REMEMBERED:
                memory.clear()
        return [np.frombuffer(self._encoded(text), self.kind) for text in texts]


def _qualified(spark: SparkSession, path: str) -> str:
    """With scheme and authority, as executors need it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", full)


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Takes ids document by document, writes full record batches, pads the last sequence."""

    def __init__(self, folder: str, kind: np.dtype, length: int):
        self.path, self.length, self.written, self.waiting, self.held = f"{folder}/{uuid.uuid4().hex}.arrow", length, 0, [], 0
        filesystem, inner = fs.FileSystem.from_uri(self.path)
        filesystem.create_dir(inner.rpartition("/")[0], recursive=True)
        self.file = filesystem.open_output_stream(inner)
        self.schema = _schema(kind, length)
        self.writer = pa.ipc.new_file(self.file, self.schema)

    def add(self, ids: np.ndarray) -> int:
        """The first id's position in the shard."""
        at = self.written + self.held
        self.waiting.append(ids)
        self.held += len(ids)
        step = SEQUENCES * self.length
        if self.held >= step:
            ids = np.concatenate(self.waiting)
            full = len(ids) // step * step
            for a in range(0, full, step):
                self._batch(ids[a : a + step], step)
            self.waiting, self.held = [ids[full:]], len(ids) - full
            self.written += full
        return at

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.waiting)
            self._batch(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.writer.close()
        self.file.close()


class Shard:
    """A written file, memory-mapped where its file system is local."""

    def __init__(self, path: str):
        filesystem, inner = fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(inner) if isinstance(filesystem, fs.LocalFileSystem) else filesystem.open_input_file(inner)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.number, self.values = -1, np.zeros(0)

    def _batch(self, number: int) -> np.ndarray:
        if number != self.number:
            self.number, self.values = number, self.reader.get_batch(number).column("input_ids").values.to_numpy(zero_copy_only=True)
        return self.values

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of the sequence with this number in the shard; the ids are a view."""
        batch, row = divmod(number, SEQUENCES)
        mask = self.reader.get_batch(batch).column("mask")[row].values.to_numpy(zero_copy_only=False)
        return self._batch(batch)[row * self.length : (row + 1) * self.length], mask

    def ids(self, start: int, count: int) -> np.ndarray:
        step, parts = SEQUENCES * self.length, []
        while count:
            batch, at = divmod(start, step)
            parts.append(self._batch(batch)[at : at + count])
            start, count = start + len(parts[-1]), count - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else self._batch(0)[:0]


def write(df: DataFrame, folder: str | None = None, path: str | None = None, length: int = LENGTH, end: int | None = END, shards: int | None = None) -> DataFrame:
    """Write all documents' ids and return the index: doc_id, path, at (position in the shard), start (position in the
    whole), n_tokens (with the end id).

    Documents are taken in ascending doc_id, missing ids last, rows of one id in order of their texts' hash and then
    text. A null text is empty and has the end id alone. An empty table gives no files and no rows. A retried task
    writes a file of another name; the index names only files of tasks that ended well.
    """
    spark = df.sparkSession
    folder, path = _qualified(spark, folder or f"{shared_folder(spark)}/shards"), path or tokenizer_file()
    shards = shards or partitions(spark)

    def run(batches):
        encoder, writer = Encoder(path), None
        for batch in batches:
            writer = writer or ShardWriter(folder, encoder.kind, length)
            found = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            if end is not None:
                found = [np.append(ids, np.array(end, encoder.kind)) for ids in found]
            at = [writer.add(ids) for ids in found]
            n = pa.array([len(ids) for ids in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([writer.path] * len(at)), pa.array(at, pa.int64()), n], names=["doc_id", "row", "path", "at", "n_tokens"])
        if writer:
            writer.close()

    keyed = documents(df).withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "row": F.xxhash64(F.coalesce("text", F.lit("")))})
    ordered = keyed.repartitionByRange(shards, "id", "row").sortWithinPartitions("id", "row", "text").select("doc_id", "row", "text")
    index = saved(ordered.mapInArrow(run, "doc_id long, row long, path string, at long, n_tokens long"), "index")
    # One row for each shard.
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row")).alias("first")
    sizes = index.groupBy(F.col("path").alias("shard")).agg(F.sum("n_tokens").alias("size"), first)
    before = F.sum("size").over(Window.orderBy("first", "shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return index.join(F.broadcast(bases), index.path == bases.shard).select("doc_id", "path", "at", (F.col("base") + F.col("at")).alias("start"), "n_tokens")


def read(index: DataFrame) -> DataFrame:
    """Per document of the index, from the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian
    unsigned 32-bit integers)."""

    def run(batches):
        path, shard = None, None
        for batch in batches:
            sums = []
            for where, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "n_tokens"))):
                if where != path:
                    path, shard = where, Shard(where)
                sums.append(zlib.crc32(shard.ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
