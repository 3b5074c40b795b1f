"""Token ids of documents in wavelet files, in ascending order of document id.

Documents are dealt by ranges of (id, hash of the text), each range is sorted in its task, and every task cuts its ids
into files of about SHARD_TOKENS, so no task holds more than one file and the longest document. A file has a name of
its own for each attempt; the list of files is a table that Spark commits, so files of lost or repeated tasks are never
read. The first place of a file is the sum over the files before it.

Texts are cut where no piece of the vocabulary's own pre-tokenizer goes on (before and behind words, or at least where a
space follows a visible character), so the ids of the parts, joined, are the ids of the text. Ids of parts are remembered
within REMEMBERED bytes; the library gets each new part once.

Edge cases: a null text is empty; an empty document has the end id only; rows of one id (or of none: they come first)
follow each other by the hash of their text, and equal rows by their place in the input, which must be files or a
written table, so that a repeated task gives its rows the same places; an empty table gives no file and no row; other
columns are not read. A document is never split, so one longer than SHARD_TOKENS is a file of its own.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.llm.scratch import cut, shared_dir
from kilnworks.llm.wavelet import WaveletFile, encode

END = 0
SHARD_TOKENS = 1 << 25
#: Bytes of ids and parts that a task remembers, and the longest part that is remembered.
REMEMBERED, PART_CHARS = 128 << 20, 64
#: Characters of a text that are cut at once, and rows.
SLICE, ROWS = 1 << 20, 256
#: A space after a visible character: any text may be cut there.
CUT = re.compile(r"(?<=\S)(?= )")
#: Letters that a fine cut knows. Texts with those of other scripts are cut at spaces only.
_OWN = "A-Za-zÀ-ÖØ-öø-ɏ"
WORD, PLAIN = re.compile(f" [{_OWN}]+"), re.compile(rf"[\x00-\x7f{_OWN}]*")
#: Words with the space before them, and what stands between words; white space or an apostrophe keeps the letters behind it.
FINE = re.compile(rf" ?[{_OWN}]+|[^{_OWN}]+?(?:(?<=[\s'])[{_OWN}]+|(?= ?[{_OWN}])|\Z)")
#: The vocabulary's letter for each byte: visible ones stand for themselves, the others for 256 and up, in order.
_HIDDEN = [*range(33), *range(127, 161), 173]
BYTE_LETTERS = np.arange(256, dtype="<u4")
BYTE_LETTERS[_HIDDEN] = 256 + np.arange(len(_HIDDEN))
#: Tasks that read files back, at most.
READERS = 10_000


def vocabulary() -> str:
    """The path of the vocabulary that is taken unless another is named."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian bytes."""

    def __init__(self, model: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = special_as_text
        self.width = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.width <= 16 else "<u4")
        #: The same model, on words that are spelt in its own letters and begin with its letter for a space.
        self.words = Tokenizer.from_str(model)
        self.words.pre_tokenizer = pre_tokenizers.Split(chr(BYTE_LETTERS[ord(" ")]), "merged_with_next")
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Bytes of text that each id stands for: pieces have a character for each byte, special tokens stand for themselves.
        special = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = np.array([special.get(i, len(self.tokenizer.id_to_token(i) or "")) for i in range(1 << self.width)], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, parts: list[str]) -> list[bytes]:
        """The ids of parts. Words with a space before them go to the library as one text in the vocabulary's own letters, others one by one."""
        words, single = [], []
        for part in parts:
            (words if WORD.fullmatch(part) else single).append(part)
        letters = BYTE_LETTERS[np.frombuffer("".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.words.encode_batch_fast([letters], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends = np.cumsum(np.array([len(p.encode()) for p in words], dtype=np.int64))
        stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        found, start, ids = {}, 0, ids.tobytes()
        for part, stop in zip(words, (stops * self.dtype.itemsize).tolist(), strict=True):
            found[part] = ids[start:stop]
            start = stop
        for part, made in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
            found[part] = np.array(made.ids, dtype=self.dtype).tobytes()
        for part, ids in found.items():
            if len(part) <= PART_CHARS and PLAIN.fullmatch(part):
                self.known[part] = ids
                self.held += len(part) + len(ids) + 200
        return [found[p] for p in parts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, without an end; a null text has none. Long texts are taken in slices."""
        if all(len(t) <= SLICE for t in texts if t):
            return self._encode([t or "" for t in texts])
        return [b"".join(self._encode([part])[0] for part in _slices(text or "")) for text in texts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        known, made, gaps, new = self.known.get, [], [], {}
        for text in texts:
            parts = FINE.findall(text)
            found = list(map(known, parts))
            gap = [k for k, ids in enumerate(found) if ids is None] if None in found else []
            # Parts of other scripts are never remembered, so each is in the gap.
            if any(s in text for s in self.special) or gap and not PLAIN.fullmatch("".join([parts[k] for k in gap])):
                parts = CUT.split(text)
                found = list(map(known, parts))
                gap = [k for k, ids in enumerate(found) if ids is None]
            made.append(found)
            gaps.append((parts, gap))
            new.update(dict.fromkeys([parts[k] for k in gap]))
        learnt = dict(zip(new, self._learn(list(new)), strict=True))
        for found, (parts, gap) in zip(made, gaps, strict=True):
            for k in gap:
                found[k] = learnt[parts[k]]
        return [b"".join(ids) for ids in made]


def _slices(text: str) -> Iterator[str]:
    """A long text in parts that begin where it may be cut."""
    at = 0
    while len(text) - at > SLICE and (found := CUT.search(text, at + SLICE)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


@lru_cache(2)
def encoder_of(model: str, special_as_text: bool) -> Encoder:
    """The encoder of this worker process, which keeps what it has learnt from task to task."""
    return Encoder(model, special_as_text)


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_files(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", model: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS, special_as_text: bool = False) -> DataFrame:
    """Files of ids in a shared folder, and their list: part and number (which give the order), path, n_docs, n_tokens and n_bytes of each."""
    with open(model or vocabulary(), encoding="utf-8") as source:
        model_text = docs.sparkSession.sparkContext.broadcast(source.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_text.value, special_as_text)
        part, number, ending = TaskContext.get().partitionId(), 0, np.array([end], dtype=encoder.dtype).tobytes()
        store, path = _folder(folder)
        ids: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            data = encode(np.frombuffer(b"".join(ids), encoder.dtype), names, np.array([len(x) // encoder.dtype.itemsize for x in ids]), encoder.width)
            name = f"{path}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.kwmx"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(name) as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [name], "n_docs": [len(names)], "n_tokens": [size], "n_bytes": [len(data)]}, schema=_LIST)
            number, size = number + 1, 0
            ids.clear()
            names.clear()
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                for one, found in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    n = len(found) // encoder.dtype.itemsize + 1
                    if ids and size + n > shard_tokens:
                        yield flush()
                    ids.append(found + ending)
                    names.append(one)
                    size += n
        if ids:
            yield flush()

    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"), F.monotonically_increasing_id().alias("place"))
    dealt = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "copy", "place").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "copy", "place")
    return cut(dealt.select("doc_id", "text").mapInArrow(write, "part int, number int, path string, n_docs long, n_tokens long, n_bytes long"), "token-files")


_LIST = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def open_file(folder: str, path: str) -> WaveletFile:
    """A file of the list, read piece by piece."""
    source = _folder(folder)[0].open_input_file(path)

    def read(offset: int, size: int) -> bytes:
        source.seek(offset)
        return source.read(size)

    return WaveletFile(read)


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("path", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = open_file(folder, path)
                ids = file.tokens().astype("<u4")
                names, lengths = file.documents()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + start), pa.array(lengths), pa.array(sums, pa.int64())], schema=_READ)

    tasks = min(READERS, max(1, files.count()))
    return placed.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_token(files: DataFrame, folder: str, token: int) -> DataFrame:
    """path and occurrences of one token id in each file; a few blocks of each are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"path": paths, "n": [open_file(folder, p).count(token) for p in paths]}, schema=pa.schema([("path", pa.string()), ("n", pa.int64())]))

    return files.select("path").mapInArrow(count, "path string, n long")


def encode_documents(docs: DataFrame, **options: object) -> DataFrame:
    """Writes the ids of documents to files of the shared folder and reads back what each document has there."""
    folder = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    return read_files(write_files(docs, folder, **options), folder)
