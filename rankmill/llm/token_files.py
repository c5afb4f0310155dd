"""Token-id files of articles: independent zstandard frames, a trailing seek table, a checksum per frame.

One file is the concatenation of

* frames: each one zstandard frame that decompresses by itself and holds the ids of whole
  articles as little-endian unsigned 32-bit integers. An article longer than FRAME_IDS ids is
  a frame of its own;
* one skippable frame (magic 0x184D2A5E) that holds an index: a zstandard frame of rows of
  little-endian 64-bit integers, one per article: row number in the file, article id, 1 if the
  id is null, frame number, offset of its ids in the frame, number of ids;
* the seek table of the seekable zstandard format, itself a skippable frame: per frame the
  compressed size, the decompressed size and the low 32 bits of the XXH64 of the decompressed
  bytes; the index counts as a frame without decompressed bytes. A reader reads the last
  nine bytes, the table, the index, and then only the frames that hold the articles it wants.

Files are objects in the shared folder, written and read by ranges through Arrow's file systems (local and mounted
folders, S3, GCS, HDFS). A task holds one range of article ids and begins a new file when one is FILE_BYTES long, so files in the order
of their numbers, and rows in the order of a file, are in ascending order of the ids; null ids come first. Writers and readers
hold a frame at a time.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.words import hashes, pieces
from rankmill.session import settle, work_path

FRAME_IDS = 1 << 16
RANGE_BYTES, FILE_BYTES = 32 << 20, 64 << 20
END_ID = 2
#: fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80

TOKENS = "file long, row long, id long, n_tokens long, ids_crc32 long"


def _skippable(data: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(data)) + data


class FileWriter:
    """Writes one file from articles in order. write: takes the next bytes."""

    def __init__(self, write: Callable[[bytes], object]):
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.write = write
        self.size = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int, int]] = []
        self.open: list[bytes] = []
        self.n_open = 0

    def _put(self, data: bytes) -> None:
        self.write(data)
        self.size += len(data)

    def add(self, id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.n_open and self.n_open + n > FRAME_IDS:
            self._close_frame()
        self.index.append((len(self.index), id or 0, int(id is None), len(self.seek), self.n_open, n))
        self.open.append(ids)
        self.n_open += n

    def _close_frame(self) -> None:
        raw = b"".join(self.open)
        frame = self.compress(raw)
        self._put(frame)
        self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.n_open = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        index = _skippable(self.compress(np.array(self.index, dtype="<i8").tobytes()))
        self._put(index)
        seek = [*self.seek, (len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *x) for x in seek)
        table += struct.pack("<IBI", len(seek), WITH_CHECKSUMS, SEEKABLE)
        self._put(_skippable(table))


class FileReader:
    """Reads articles from a file by ranges, decompressing only their frames. A wrong checksum is a ValueError.

    read: (start, length) -> bytes of the file.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        table = read(size - 9 - 12 * n, 12 * n)
        self.seek = [struct.unpack_from("<III", table, 12 * i) for i in range(n)]
        self.starts = np.concatenate([[0], np.cumsum([x[0] for x in self.seek])]).astype(int)
        self.decompress = zstandard.ZstdDecompressor().decompress
        at = int(self.starts[n - 1]) + 8
        raw = self.decompress(read(at, int(self.starts[n]) - at))
        self.index = np.frombuffer(raw, dtype="<i8").reshape(-1, 6)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.seek[k]
        raw = self.decompress(self.read(int(self.starts[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, dtype="<u4")

    def articles(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(row, article id, token ids) of the wanted rows of the index, of all by default."""
        at, ids = -1, None
        for row in range(len(self.index)) if rows is None else rows:
            _, id, is_null, frame, start, n = self.index[row].tolist()
            if frame != at:
                at, ids = frame, self.frame(frame)
            yield row, None if is_null else id, ids[start : start + n]


def file_system(path: str):
    """(file system, path in it) of a path or address, in the process that asks."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@contextmanager
def opened_file(path: str) -> Iterator[FileReader]:
    system, place = file_system(path)
    with system.open_input_file(place) as file:
        yield FileReader(lambda start, n: file.read_at(n, start), file.size())


class Encoder:
    """Texts -> ids, by the tokenizers library (a byte-level BPE); no special tokens are added, those written in a text are encoded.

    The library parts a text at special tokens first, so what stands between them is encoded by itself. Its pre-tokenizer attaches a space to the word after it and parts letters
    from punctuation and line ends, so texts can be cut at such places without
    changing their ids. The pieces repeat: each distinct one is encoded once, and
    ids are put together by index. Pieces that begin with a space are encoded
    joined, as the cut before each of them holds in any surrounding; tokens are
    parted again by their number of bytes. Memory is emptied when it holds `most` pieces.
    """

    def __init__(self, tokenizer_file: str, most: int = 800_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        special = {x.content.encode(): id for id, x in self.tokenizer.get_added_tokens_decoder().items() if x.special}
        self.special = {text: np.array([id], dtype=np.uint32) for text, id in special.items()}
        self.parted = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + b")" if special else b"(?!)")
        self.tokenizer.encode_special_tokens = True  # they don't occur in what is encoded
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, id in vocabulary.items():
            self.n_bytes[id] = len(token)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # hashes of the pieces, sorted
        self.number = np.zeros(0, dtype=np.int32)  # place of each in `at`
        self.ids = np.zeros(0, dtype=np.uint32)
        self.at = np.zeros(1, dtype=np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Appends the ids of these pieces; keys: their hashes, sorted."""
        spaced = np.array([p[:1] == b" " for p in pieces], dtype=bool)
        joined = [p for p, s in zip(pieces, spaced) if s]
        groups = [joined[i : i + 5000] for i in range(0, len(joined), 5000)]
        alone = [p for p, s in zip(pieces, spaced) if not s]
        together = self.plain([b"".join(g).decode() for g in groups])
        ids, counts = [*together], []
        for group, found in zip(groups, together):
            ends = np.cumsum(self.n_bytes[found])
            cuts = np.cumsum([len(p) for p in group])
            counts.append(np.diff(np.searchsorted(ends, cuts), prepend=-1))
        rest = self.plain([p.decode() for p in alone])
        ids += rest
        counts.append(np.array([len(x) for x in rest], dtype=np.int64))
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        base = len(self.at) - 1
        starts = self.at[-1] + np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
        self.ids = np.concatenate([self.ids, *ids])
        self.at = np.concatenate([self.at, starts[1:]])
        number = np.empty(len(keys), dtype=np.int32)
        number[order] = base + np.arange(len(keys))
        places = np.searchsorted(self.known, keys)
        self.known, self.number = np.insert(self.known, places, keys), np.insert(self.number, places, number)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many texts and their offsets -> all ids, and the offsets of the texts in them."""
        raw = data.tobytes()
        if not self.parted.search(raw):
            return self._between(data, offsets)
        parts, counts = [], []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            texts = self.parted.split(raw[a:b])
            between = texts[::2]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in between])]).astype(np.int64)
            ids, at = self._between(np.frombuffer(b"".join(between), dtype=np.uint8), cuts)
            found = [ids[at[0] : at[1]]]
            for k, token in enumerate(texts[1::2], 1):
                found += [self.special[token], ids[at[k] : at[k + 1]]]
            parts += found
            counts.append(sum(map(len, found)))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def _between(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, of_text = cut_points(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        ends = np.append(starts[1:], len(data))
        keys, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._forget()
        at = np.searchsorted(self.known, keys)
        new = np.append(self.known, np.uint64(0))[at] != keys
        new[at == len(self.known)] = True
        if new.any():
            raw, places = data.tobytes(), first[new]
            self._learn(keys[new], [raw[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist())])
        index = self.number[np.searchsorted(self.known, keys)][inverse].astype(np.int64)
        counts = self.at[index + 1] - self.at[index]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.at[index] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, upto[of_text]


def worker_encoder(tokenizer_file: str) -> Encoder:
    """The encoder of this Python worker: loading it and learning the common pieces is done once, not in every task."""
    kept = sys.modules.setdefault("_rankmill_worker", types.ModuleType("_rankmill_worker"))
    encoders = kept.__dict__.setdefault("encoders", {})
    if tokenizer_file not in encoders:
        encoders[tokenizer_file] = Encoder(tokenizer_file)
    return encoders[tokenizer_file]


def _table(values: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


_LETTER = _table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
_POINT = _table(b",.")
#: bytes that white space can begin with; no cut before a space that one of them follows
_BLANK = _table(bytes([*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]))


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces, and the first piece of every text (one more than texts)."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    cut = np.zeros(len(data), dtype=bool)
    before, here = data[:-1], data[1:]
    cut[1:] = _LETTER[before] & _POINT[here] | (_LETTER[before] | _POINT[before]) & (here == 0x0A)
    space = data == 0x20
    space[:-1] &= ~_BLANK[here]
    last = offsets[1:] - 1
    space[last[last >= 0]] = False
    cut |= space
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


FILES = "file long, path string, n_rows long, size long"
FILES_OF_RANGE = 1 << 20


def write_token_files(
    articles: DataFrame, tokenizer_file: str, *, end_id: int = END_ID, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encodes every article and writes the files into the shared folder.

    articles: `id` (integer), `content`; other columns are not read. Rows are
    ranged by id (rows of one id by a hash of the content), about `range_bytes` of content to a
    task, and sorted inside. Every article ends with `end_id`, so null or
    empty content is one id. Returns a written table `file, path, n_rows, size`, where `file` numbers the files in the
    order of ids; empty tables give no files. A task that is repeated writes its files anew, each under
    its name only when whole. `tokenizer_file` must be readable on the executors.
    """
    spark = articles.sparkSession
    rows = articles.select(F.col("id").cast("long").alias("id"), "content")
    total = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.xxhash64("content").asc()]
    ranged = rows.repartitionByRange(max(1, -(-total // range_bytes)), *order).sortWithinPartitions(*order)
    folder = work_path(spark, "tokens")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, place = file_system(folder)
        system.create_dir(place)
        encoder, end = worker_encoder(tokenizer_file), struct.pack("<I", end_id)
        made: list[tuple[int, str, int, int]] = []
        number = task.partitionId() * FILES_OF_RANGE
        writer = stream = None

        def finish() -> None:
            nonlocal writer, number
            writer.close()
            stream.close()
            name = f"{number:016d}.zst"
            system.move(f"{place}/_{number}-{task.taskAttemptId()}", f"{place}/{name}")
            made.append((number, f"{folder}/{name}", len(writer.index), writer.size))
            writer, number = None, number + 1

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, data, offsets in pieces(batch.column(1)):
                found, at = encoder.encode(data, offsets)
                raw, at = found.astype("<u4").tobytes(), (at * 4).tolist()
                for k in range(len(offsets) - 1):
                    if writer is None:
                        stream = system.open_output_stream(f"{place}/_{number}-{task.taskAttemptId()}")
                        writer = FileWriter(stream.write)
                    writer.add(ids[first + k], raw[at[k] : at[k + 1]] + end)
                    if writer.size >= file_bytes:
                        finish()
        if writer is not None:
            finish()
        schema = pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("size", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in made], schema.field(c).type) for c in range(4)], schema=schema)

    return settle(ranged.mapInArrow(build, FILES))


def read_token_files(files: DataFrame) -> DataFrame:
    """Every article of the files: `file`, `row` (in the file), `id`, `n_tokens`, `ids_crc32`. A task reads a file."""
    schema = pa.schema([(c, pa.int64()) for c in ("file", "row", "id", "n_tokens", "ids_crc32")])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened_file(path) as reader:
                    found = ((file, row, id, len(ids), zlib.crc32(ids.tobytes())) for row, id, ids in reader.articles())
                    while rows := list(islice(found, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], schema=schema)

    return files.select("file", "path").repartition(max(1, files.count())).mapInArrow(unpack, TOKENS)


def fetch_articles(files: DataFrame, file: int, rows: list[int]) -> list[tuple[int | None, list[int]]]:
    """Ids and tokens of a few articles of one file; besides its end, only their frames are read."""
    found = files.where(F.col("file") == file).select("path").first()
    if found is None:
        return []
    with opened_file(found[0]) as reader:
        return [(id, ids.tolist()) for _, id, ids in reader.articles(rows)]


def token_index(files: DataFrame) -> DataFrame:
    """The articles in the files with `start`, the number of ids of all articles before each.

    One sum per file, prefix sums over these few, then a running sum inside each file.
    """
    from pyspark.sql import Window

    rows = settle(read_token_files(files))
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("file", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(before, "file").select(
        "id", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )
