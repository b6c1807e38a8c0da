"""Token ids in the Arrow file format with fixed-size-list batches.

A file holds equal-length sequences: column ``tokens`` is fixed_size_list<uint16 or uint32>[length], column
``mask`` fixed_size_list<bool>[length] (false only on the padding behind a file's last token). Buffers are
not compressed, so any sequence of a memory-mapped file is a zero-copy slice. A second small Arrow file
beside it (``.docs.arrow``) names each document's place: doc_id, offset in the file, n_tokens.

Documents are dealt to files by ascending id ranges and are sorted inside; a file's name carries the task
attempt, and only files named in the manifest, the written table of successful attempts, are ever read, so a
lost executor or a repeated task leaves orphans but never double rows. Files go to the folder named by the
caller through pyarrow's file systems (local, HDFS, S3 or GCS paths).

Encoding: where the tokenizer's file says that it is a byte-level BPE (``byte_level``), the library's pre-tokenizer always cuts before a
single space that stands between two characters that aren't white space, so such pieces are encoded once and remembered (bounded); texts
with other white space around a space are encoded whole. With any other file all texts are encoded whole.

Defined results: null and empty texts have the end id alone; repeated rows are repeated; an empty table
writes no file and reads back no rows; very long texts run over many sequences and batches.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, parallelism, text_batches, written

ODD_SPACE = re.compile(r"\s |^ | $")
ENDS = ".,;:!?"
LONG = 256
# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}


def _odd(text: str) -> bool:
    """Whether a space stands at an end or behind other white space."""
    if text.isascii():
        return text[0] == " " or text[-1] == " " or any(x in text for x in _ODD_ASCII)
    return ODD_SPACE.search(text) is not None


_ODD_ASCII = [c + " " for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f"]


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer's file describes a byte-level BPE without a normalizer, prefix space, dropout or added tokens that take in what stands beside them."""
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        spec.get("normalizer") is None
        and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        and not any(t.get(k) for t in spec.get("added_tokens") or () for k in ("lstrip", "rstrip", "single_word"))
    )


class _Pieces(dict):
    """Ids in bytes of pieces of text, by their words; at most ``most`` are kept, none of over ``LONG`` characters, and all are dropped when that many times
    four didn't fit."""

    def __init__(self, encode, most: int):
        self.encode, self.most, self.left_out = encode, most, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) > LONG:
            return ids
        if len(self) < self.most:
            self[word] = ids
        else:
            self.left_out += 1
            if self.left_out > 4 * self.most:
                self.clear()
                self.left_out = 0
        return ids


class Encoder:
    """Whole texts to arrays of token ids, with the end id appended.

    ``most`` bounds the pieces remembered; they are kept for the life of a Python worker.
    """

    def __init__(self, path: str, end_id: int, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_pieces = byte_level(json.load(f))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if max(size, end_id) < 1 << 16 else np.uint32
        self.last = np.array([end_id], self.dtype).tobytes()
        raw, width = np.arange(size, dtype=self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        self.raw = [raw[i : i + width] for i in range(0, len(raw), width)]  # an id's bytes
        self.tokens_of = self.tokenizer.model.tokenize
        self.spaced = _Pieces(lambda w: self._piece(w, "\u0120"), most)  # of " " + word
        self.bare = _Pieces(lambda w: self._piece(w, ""), most // 8)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()

    def _letters(self, word: str, space: str) -> bytes:
        """The ids of one pre-token of letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_CHARS)
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokens_of(space + word)])

    def _piece(self, word: str, space: str) -> bytes:
        """The ids of a piece. Letters, marks behind them, and what follows a single line end are pre-tokens of their own and are encoded apart; other pieces
        are encoded as they are."""
        core = word.rstrip(ENDS)
        if core.isalpha() and (core.isascii() or max(core) <= "\u024f"):
            if len(core) == len(word):
                return self._letters(word, space)
            return (self.spaced if space else self.bare)[core] + self.bare[word[len(core) :]]
        at, known, ids = 0, self.spaced if space else self.bare, []
        while (cut := word.find("\n", at)) > at and word[cut + 1 : cut + 2].isalpha() and word[cut + 1] <= "\u024f" and not word[cut - 1].isspace():
            ids += [known[word[at:cut]], self.bare["\n"]]
            at, known = cut + 1, self.bare
        if at:
            ids.append(self.whole(word[at:]) if cut >= 0 else self.bare[word[at:]])
            return b"".join(ids)
        return self.whole(" " + word if space else word)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_pieces:
            return [np.frombuffer((self.whole(t) if t else b"") + self.last, self.dtype) for t in texts]
        out, spaced, bare = [], self.spaced.__getitem__, self.bare
        for t in texts:
            if not t:
                ids = b""
            elif _odd(t):
                ids = self.whole(t)
            else:
                first, *rest = t.split(" ")
                ids = bare[first] + b"".join(map(spaced, rest))
            out.append(np.frombuffer(ids + self.last, self.dtype))
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _file_system(folder: str):
    return pafs.FileSystem.from_uri(folder)


class _Sequences:
    """One open file: takes ids in any lengths, writes full batches of sequences."""

    def __init__(self, folder: str, length: int, rows: int, dtype):
        self.fs, base = _file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.arrow"
        self.base, self.length, self.rows, self.dtype = base, length, rows, dtype
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.out = self.fs.open_output_stream(f"{base}/{self.name}")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0
        self.docs: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, full = np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype), self.length * self.rows
        while len(ids) >= full or last and len(ids):
            part, ids = ids[:full], ids[full:]
            pad = -len(part) % self.length
            mask = np.ones(len(part) + pad, bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(pad, self.dtype)])
            self.file.write_batch(
                pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(k).type) for k, x in enumerate((part, mask))],
                    schema=self.schema,
                )
            )
        self.parts, self.held = [ids], len(ids)

    def close(self) -> tuple:
        self._flush(True)
        self.file.close()
        self.out.close()
        table = pa.table({"doc_id": pa.array([d[0] for d in self.docs], pa.int64()), "offset": pa.array([d[1] for d in self.docs], pa.int64()), "n_tokens": pa.array([d[2] for d in self.docs], pa.int64())})
        with self.fs.open_output_stream(f"{self.base}/{self.name}.docs.arrow") as out, pa.ipc.new_file(out, table.schema) as f:
            f.write_table(table, max_chunksize=1 << 16)
        return self.name, len(self.docs), self.total


def write_sequences(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, length: int = 2048, id_col: str = "doc_id",
    text_col: str = "text", batch_rows: int = 256, file_tokens: int = 1 << 26,
) -> DataFrame:
    """Writes the files and returns the manifest: (part, no, file, docs, tokens, before), before being the
    number of ids in the files ahead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, no = _encoder(tokenizer, end_id), None, 0
        for batch in batches:
            part = batch.column(0)[0].as_py()
            for start in range(0, batch.num_rows, 256):
                ids = batch.column(1).slice(start, 256).to_pylist()
                for doc_id, x in zip(ids, encoder.encode(batch.column(2).slice(start, 256).to_pylist())):
                    out = out or _Sequences(folder, length, batch_rows, encoder.dtype)
                    out.add(doc_id, x)
                    if out.total >= file_tokens:
                        yield entry(part, no, out.close())
                        out, no = None, no + 1
        if out:
            yield entry(part, no, out.close())

    def entry(part, no, closed):
        return pa.RecordBatch.from_pylist([{"part": part, "no": no, "file": closed[0], "docs": closed[1], "tokens": closed[2]}], MANIFEST)

    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(parallelism(spark), "id").sortWithinPartitions("id")
    done = ranged.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(run, "part int, no int, file string, docs long, tokens long")
    done = written(done, "t2-manifest")
    ahead = Window.orderBy("part", "no")  # a row for each file
    return done.withColumn("before", F.sum("tokens").over(ahead) - F.col("tokens"))


MANIFEST = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


class SequenceFile:
    """Random access to one file: sequences, and documents by their place."""

    def __init__(self, folder: str, name: str):
        fs, base = _file_system(folder)
        path = f"{base}/{name}"
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("tokens").type.list_size
        self.batch_rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        docs = f"{path}.docs.arrow"
        self.docs = pa.ipc.open_file(pa.memory_map(docs) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(docs))

    def batch(self, k: int, column: str) -> np.ndarray:
        """The values of a batch; for tokens a view of the file's own buffer."""
        return self.reader.get_batch(k).column(column).flatten().to_numpy(zero_copy_only=column == "tokens")

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        k, r = divmod(i, self.batch_rows)
        span = slice(r * self.length, (r + 1) * self.length)
        return self.batch(k, "tokens")[span], self.batch(k, "mask")[span]

    def ids(self, offset: int, n: int) -> np.ndarray:
        size, parts = self.batch_rows * self.length, []
        while n:
            k, at = divmod(offset, size)
            got = self.batch(k, "tokens")[at : at + n]
            parts.append(got)
            offset, n = offset + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = SequenceFile(folder, name)
                for k in range(f.docs.num_record_batches):
                    d = f.docs.get_batch(k)
                    offset, n = (d.column(c).to_numpy() for c in ("offset", "n_tokens"))
                    crc = [zlib.crc32(f.ids(int(o), int(m)).astype("<u4").tobytes()) for o, m in zip(offset, n)]
                    yield pa.RecordBatch.from_arrays(
                        [d.column("doc_id"), pa.array(offset + before), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    files = manifest.select("file", "before").repartition(parallelism(manifest.sparkSession), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "t2-sequences")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_sequences(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(manifest, folder)
