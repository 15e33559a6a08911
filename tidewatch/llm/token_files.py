"""Token ids in binary files: one concatenated id array per file, document boundaries and ids in Elias-Fano code.

A file holds, in this order: the ids of all its documents (unsigned little-endian, 2 or 4 bytes), the encoded
document ends, the encoded document ids, a JSON footer, the footer's length (4 bytes) and the mark. A monotone
list of n numbers below u takes about 2 + log2(u / n) bits a number; select(i) reads one number through a small
stored directory of counts, without a table of 64-bit offsets.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import shared

MARK = b"TWTOKEN1"
#: Bits of the high part that one count of the directory covers.
BLOCK_BITS = 512
#: Numbers whose low bits are packed at a time; a multiple of 8.
SLICE = 65_536
FILES = "file string, part int, n_docs bigint, n_ids bigint"


class EliasFano:
    """A list of whole numbers that never falls, relative to its first.

    directory: the ones of the high part before each block, 4 bytes for 512 bits; it is stored with the list.
    """

    def __init__(self, base: int, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray) -> None:
        self.base, self.n, self.low_bits = base, n, low_bits
        self.low, self.high, self.directory = low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        base = int(values[0]) if n else 0
        offsets = (values.astype(np.int64).view(np.uint64) - np.uint64(base % 2**64)) if n else np.zeros(0, np.uint64)
        top = int(offsets[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.concatenate([cls._packed(offsets[at:at + SLICE], low_bits) for at in range(0, n, SLICE)] or [np.zeros(0, np.uint8)])
        marks = np.zeros((top >> low_bits) + n + 1, np.uint8)
        marks[(offsets >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little")
        ones = np.bitwise_count(high).astype(np.int64)
        per_block = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK_BITS // 8))
        return cls(base, n, low_bits, low, high, np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32))

    @staticmethod
    def _packed(offsets: np.ndarray, low_bits: int) -> np.ndarray:
        """The low bits of some numbers, one after the other; SLICE of them end on a whole byte."""
        bits = ((offsets[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return np.packbits(bits.ravel(), bitorder="little")

    def select(self, i: int) -> int:
        """Number i of the list."""
        return int(self.slice(i, i + 1)[0])

    def slice(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j of the list, from the blocks of the high part that hold their ones and no others."""
        if j <= i:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.directory, i, side="right")) - 1
        last = int(np.searchsorted(self.directory, j - 1, side="right"))
        start = first * (BLOCK_BITS // 8)
        bits = np.unpackbits(self.high[start:last * (BLOCK_BITS // 8)], bitorder="little")
        skip = i - int(self.directory[first])
        places = start * 8 + np.flatnonzero(bits)[skip:skip + j - i].astype(np.int64)
        high = (places - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        return (high + self._low(i, j) + np.uint64(self.base % 2**64)).view(np.int64)

    def _low(self, i: int, j: int) -> np.ndarray:
        first, n = i * self.low_bits, (j - i) * self.low_bits
        bits = np.unpackbits(self.low[first // 8:-(-(first + n) // 8)], bitorder="little")[first % 8:first % 8 + n]
        out = np.zeros(j - i, np.uint64)
        for k in range(self.low_bits):
            out |= bits[k::self.low_bits].astype(np.uint64) << np.uint64(k)
        return out

    def head(self) -> dict[str, int]:
        return {"base": self.base, "n": self.n, "low_bits": self.low_bits, "low": len(self.low), "high": len(self.high),
                "blocks": len(self.directory)}

    @staticmethod
    def size(head: dict[str, int]) -> int:
        return head["low"] + head["high"] + 4 * head["blocks"]

    @classmethod
    def read(cls, head: dict[str, int], data: bytes) -> "EliasFano":
        low, high = head["low"], head["high"]
        return cls(
            head["base"], head["n"], head["low_bits"], np.frombuffer(data, np.uint8, low),
            np.frombuffer(data, np.uint8, high, low), np.frombuffer(data, "<u4", head["blocks"], low + high))

    def tobytes(self) -> bytes:
        return self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()


class WordEncoder:
    """Ids of whole texts from a tokenizer that never lets a token cross white space, each word encoded once.

    The tokenizer's pieces hold no white space and its normaliser works on either side of it alone, so a text's
    ids are those of its words in order. Texts of ASCII and Latin-1 letters are cut further, at the tokenizer's
    own piece boundaries, where its pattern is the known one: "end." and "END" share a piece. Whatever is new
    goes to the tokenizer, many at once. Texts with the four separators that only Python counts as white space
    go to the tokenizer whole.
    """

    _OTHER = re.compile("[\x1c-\x1f]")
    # fixed values: the tokenizer's pattern, and the same over lower-case ASCII and Latin-1 letters
    _PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    _SIMPLE = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    _GAP = " \x00 "

    def __init__(self, path: str, most_known: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        self.most_known = most_known
        self.known: dict[str, bytes] = {}
        self.cuts = json.dumps(self._PATTERN) in self.tokenizer.to_str()
        gap = self.tokenizer.encode(self._GAP, add_special_tokens=False).ids
        self.gap = gap[0] if len(gap) == 1 else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of id_type."""
        split = [self._split(t) for t in texts]
        if len(self.known) > self.most_known:
            self.known.clear()
        fresh = list(set().union(*(w for w in split if w)).difference(self.known))
        self.known.update(zip(fresh, self._encoded(fresh)))
        get = self.known.__getitem__
        return [
            self._bytes(self.tokenizer.encode(t, add_special_tokens=False).ids) if w is None else b"".join(map(get, w))
            for t, w in zip(texts, split)]

    def _split(self, text: str) -> list[str] | None:
        """Pieces or words whose ids make up those of the text; None for a text to be encoded whole."""
        if self.cuts and self._SIMPLE.fullmatch(text) and "<|" not in text:
            return self._PIECE.findall(text.lower())
        return None if self._OTHER.search(text) else text.split()

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of each word; words are joined with a gap of one known id, which saves most of the calls."""
        out: list[bytes] = [b""] * len(words)
        joined = [k for k, w in enumerate(words) if self.gap is not None and "\x00" not in w]
        for at in range(0, len(joined), 256):
            part = joined[at:at + 256]
            text = self._GAP.join(words[k] for k in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.id_type)
            stops = [*np.flatnonzero(ids == self.gap).tolist(), len(ids)]
            raw, width, start = ids.tobytes(), self.id_type.itemsize, 0
            for k, stop in zip(part, stops, strict=True):
                out[k] = raw[start * width:stop * width]
                start = stop + 1
        for k in set(range(len(words))).difference(joined):
            out[k] = self._bytes(self.tokenizer.encode(words[k], add_special_tokens=False).ids)
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.id_type).tobytes()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Encode all texts, end_id after each, into files in ascending order of ids; one row per file.

    Rows are range-partitioned and sorted by id; each partition streams into one file under a name of its own,
    so a task that runs twice leaves an unused file and never a torn one. Null texts are empty; null ids come
    before all others and are read back as null; repeated ids keep all their rows, equal rows in any order. An
    empty table gives no files. Whole-number ids only.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), shared.text_or_empty(text_col).alias("text")
    ).repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.kept("token_files", tokenizer_path, lambda: WordEncoder(tokenizer_path))
        end = np.array([end_id], own.id_type).tobytes()
        lengths, ids, out, file, n_null = [], [], None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                filesystem, path = pafs.FileSystem.from_uri(folder)
                filesystem.create_dir(path, recursive=True)
                file = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tok"
                out = filesystem.open_output_stream(f"{path}/{file}", compression=None)
            own_ids = batch.column("id")
            n_null += own_ids.null_count
            ids.append(own_ids.drop_null().to_numpy())
            texts = batch.column("text").to_pylist()
            for start in range(0, len(texts), 250):
                coded = own.encode(texts[start:start + 250])
                lengths.append(np.array([len(c) // own.id_type.itemsize + 1 for c in coded]))
                out.write(b"".join(c + end for c in coded))
        if out is None:
            return
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        known = np.concatenate(ids)  # rows without an id come first and are told by their number alone
        parts = {"ends": EliasFano.of(ends), "docs": EliasFano.of(known)}
        for part in parts.values():
            out.write(part.tobytes())
        footer = json.dumps({"id_bytes": own.id_type.itemsize, "n_ids": int(ends[-1]), "n_null": n_null}
                            | {name: part.head() for name, part in parts.items()}).encode()
        out.write(footer + len(footer).to_bytes(4, "little") + MARK)
        out.close()
        yield pa.RecordBatch.from_pydict({
            "file": [file], "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "n_docs": [len(ends) - 1], "n_ids": [int(ends[-1])]})

    return shared.written(rows.mapInArrow(write, FILES), "files")


class TokenFile:
    """A token file open for reading."""

    def __init__(self, filesystem: pafs.FileSystem, path: str) -> None:
        self.source = filesystem.open_input_file(path)
        size = self.source.size()
        tail = self.source.read_at(12, size - 12)
        if tail[4:] != MARK:
            raise ValueError(f"{path} is no token file")
        length = int.from_bytes(tail[:4], "little")
        head = json.loads(self.source.read_at(length, size - 12 - length))
        self.n_ids, self.n_null, self.id_type = head["n_ids"], head["n_null"], np.dtype(f"<u{head['id_bytes']}")
        at = self.n_ids * self.id_type.itemsize
        lists = []
        for name in ("ends", "docs"):
            n = EliasFano.size(head[name])
            lists.append(EliasFano.read(head[name], self.source.read_at(n, at)))
            at += n
        self.ends, self.docs = lists

    def __len__(self) -> int:
        return self.n_null + self.docs.n

    def ids(self, start: int, stop: int) -> np.ndarray:
        width = self.id_type.itemsize
        return np.frombuffer(self.source.read_at((stop - start) * width, start * width), self.id_type)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, found through select."""
        return self.ids(self.ends.select(i), self.ends.select(i + 1))

    def documents(self, i: int, j: int) -> pa.Array:
        """The ids that name documents i to j; null ones first."""
        none = max(0, min(j, self.n_null) - i)
        known = self.docs.slice(max(i - self.n_null, 0), max(j - self.n_null, 0))
        return pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(known, pa.int64())])

    def piece(self, i: int, most_docs: int, most_ids: int) -> int:
        """Where a piece from document i ends: at most so many documents and ids, one document at least."""
        start, low, high = self.ends.select(i), i + 1, min(len(self), i + most_docs)
        while low < high:
            middle = (low + high + 1) // 2
            if self.ends.select(middle) - start <= most_ids:
                low = middle
            else:
                high = middle - 1
        return low


def read_token_files(files: DataFrame, folder: str, *, piece_ids: int = 4_000_000, piece_docs: int = 16_384) -> DataFrame:
    """One row per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    A file is read in pieces whose bounds select finds; a piece's ends and ids are decoded from its own blocks, so
    no table of a whole file's offsets is made. No files give no rows.
    """
    spark = files.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    spread = placed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, path = pafs.FileSystem.from_uri(folder)
                file = TokenFile(filesystem, f"{path}/{row['file']}")
                i = 0
                while i < len(file):
                    j = file.piece(i, piece_docs, piece_ids)
                    ends = file.ends.slice(i, j + 1)
                    wide = memoryview(file.ids(int(ends[0]), int(ends[-1])).astype("<u4").tobytes())
                    cut = ((ends - ends[0]) * 4).tolist()
                    yield pa.RecordBatch.from_pydict({
                        "id": file.documents(i, j), "start": ends[:-1] + row["base"], "n_tokens": np.diff(ends),
                        "ids_crc32": pa.array([zlib.crc32(wide[a:b]) for a, b in zip(cut, cut[1:])], pa.int64())})
                    i = j

    return spread.mapInArrow(read, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
