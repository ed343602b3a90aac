"""Token ids as files of compressed bit or byte planes.

A file holds one range of the documents in ascending id order:

    magic | chunk 0 | chunk 1 | ... | document index | chunk index | length of the indexes | magic

A chunk is a block of a fixed number of ids (the last of a file may be shorter).
Its ids are transposed: plane k holds bit k (or byte k) of every id, and each
plane is compressed with zstandard on its own, as the high planes are nearly
constant. The chunk index keeps offset, first id, number of ids and the length of
each plane, so a reader can fetch any chunk without the others; the document
index keeps ids and token counts.

Files are written to a temporary name and renamed, and their content depends on
nothing but the rows of the range, so a repeated or twin task does no harm. Any
folder that Arrow's file systems can open will do (``file``, ``hdfs``, ``s3``).

Null texts encode like empty ones, to the end id alone. A null id sorts first.
Documents of one id follow by hash of their text. An empty table gives no rows. Texts of
any length are encoded whole; the chunks that a worker keeps between slices are bounded
in number and bytes, which changes no id. Further columns, whatever their names, are
left out.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import byte_lengths, slices, small_batches
from rasterloom.plans.scratch import scratch_path

MAGIC = b"TKPLANE1"
BLOCK_IDS = 1 << 16
END_ID = 0
MOST_CHUNKS, MOST_BYTES = 200_000, 48 << 20  # of the chunks kept between slices: their number, and bytes of their texts and ids
KEPT_CHUNK = 64  # longer chunks are not kept
SLICE_TEXT = 2 << 20

# Classes of bytes. OTHER: control characters and white space outside ASCII, MARK: visible ASCII but the
# apostrophe, VISIBLE: of characters that may be letters, digits or marks.
OTHER, LETTER, DIGIT, SPACE, WHITE, MARK, APOSTROPHE, VISIBLE = range(8)


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; whether a chunk ends between two classes; the code point that stands for a byte in a byte-level vocabulary."""
    kinds = np.full(256, VISIBLE, np.uint8)
    kinds[:32] = kinds[127] = OTHER
    kinds[33:127], kinds[32], kinds[9:14], kinds[39] = MARK, SPACE, WHITE, APOSTROPHE
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    kinds[0xC3:0xC9] = LETTER  # these open U+00C0 to U+023F, letters but for two signs
    ends = np.zeros((8, 8), bool)
    visible = [LETTER, DIGIT, MARK, APOSTROPHE, VISIBLE]
    ends[visible, SPACE] = ends[visible, WHITE] = ends[WHITE, visible] = True
    ends[LETTER, [DIGIT, MARK, APOSTROPHE]] = ends[DIGIT, [LETTER, MARK, APOSTROPHE]] = ends[MARK, [LETTER, DIGIT]] = True
    points = np.arange(256, dtype="<u4")
    hidden = np.r_[0:33, 127:161, 173]
    points[hidden] = 256 + np.arange(len(hidden))
    return kinds, ends.ravel(), points


_KINDS, _ENDS, _POINTS = _byte_tables()


def _parts(texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The bytes of all texts (string or binary, without nulls) as a buffer and as an array, and their offsets."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])) if data is not None else pa.py_buffer(b"")
    return data, np.frombuffer(data, np.uint8), offsets - offsets[0]


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text."""
    kinds = _KINDS[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    kinds[lead + 1] = LETTER
    signs = lead[(data[lead] == 0xC3) & np.isin(data[lead + 1], (0x97, 0xB7))]
    kinds[signs] = kinds[signs + 1] = VISIBLE
    two = np.flatnonzero(data == 0xC2)
    two = two[np.isin(data[two + 1], (0x85, 0xA0))]
    kinds[two] = kinds[two + 1] = OTHER
    three = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    if len(three):
        point = (data[three].astype(np.int64) & 15) << 12 | (data[three + 1].astype(np.int64) & 63) << 6 | data[three + 2] & 63
        blank = (point == 0x1680) | (point >= 0x2000) & (point <= 0x200A) | np.isin(point, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
        for k in range(3):
            kinds[three[blank] + k] = OTHER
    return kinds


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the bytes where a chunk begins.

    All marks are boundaries of the byte-level pre-tokenizer, whatever stands before
    or behind, and no chunk but the last of a text ends in white space that would
    be split in another way at the end of a text. Where a character's class is
    unknown, there is no mark.
    """
    kinds = byte_kinds(data)
    starts = np.empty(len(data), bool)
    starts[1:] = _ENDS[(kinds[:-1] << 3) | kinds[1:]]
    first = offsets[:-1][offsets[:-1] < len(data)]
    head = np.zeros(len(data) + 2, bool)
    head[first] = True
    white = kinds == SPACE
    white |= kinds == WHITE
    # Of white space in front of a visible character, the last one stands apart from the rest.
    last = np.flatnonzero(white[1:] & white[:-1]) + 1
    last = last[last + 1 < len(data)]
    last = last[~white[last + 1] & (kinds[last + 1] != OTHER) & ~head[last] & ~head[last + 1]]
    starts[last] = True
    # A single one may belong to white space of another class before it.
    odd = np.flatnonzero(kinds[:-1] == OTHER) + 1
    odd = odd[(kinds[odd] == WHITE) & (odd + 1 < len(data))]
    starts[odd[~white[odd + 1]] + 1] = False
    starts[first] = True
    return starts


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk once.

    The byte-level pre-tokenizer cuts a text at places that two or three characters
    show, and the model encodes what lies between on its own, so a text can be cut at
    such places and its chunks encoded apart. Chunks are found, looked up and put
    together for a whole slice of texts at a time. A new chunk of one kind of
    characters goes to the library's model, any other one through the whole library,
    as do whole texts that hold an added token, and all texts if the vocabulary has
    another pre-tokenizer. When the memory of chunks is full, chunks met only once
    leave it.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, cuts = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = isinstance(self.model, BPE) and self.model.dropout is None and isinstance(cuts, ByteLevel) and cuts.use_regex and not cuts.add_prefix_space
        self.cuts &= self.tokenizer.normalizer is None and self.tokenizer.truncation is None and self.tokenizer.padding is None
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.binary())
        self.uses = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    @property
    def held(self) -> int:
        return self.known.nbytes + self.flat.nbytes

    def shrink(self) -> None:
        keep = self.uses > 1
        if self.held > MOST_BYTES:
            keep &= byte_lengths(self.known) <= KEPT_CHUNK
        old = np.flatnonzero(keep)
        self.known = self.known.filter(pa.array(keep))
        self.flat, ends = self._gather(old)
        self.lengths = self.lengths[old]
        self.starts, self.uses = ends - self.lengths, self.uses[old] // 2
        if self.held > MOST_BYTES // 2:
            self.clear()

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the coded chunks one after the other, and where each chunk's ids end."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[codes] - (ends - lengths), lengths)
        places += np.arange(len(places))
        return self.flat[places], ends

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks of the texts, and the number of chunks before each text and at the end."""
        import pyarrow.compute as pc

        buffer, data, offsets = _parts(texts)
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
        if self.cuts:
            starts = chunk_starts(data, offsets)
            for special in self.special:
                for row in np.flatnonzero(np.asarray(pc.match_substring(texts, special))):
                    starts[offsets[row] + 1 : offsets[row + 1]] = False
        else:
            starts = np.zeros(len(data), bool)
            starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        places = np.flatnonzero(starts)
        bounds = pa.py_buffer(np.append(places, len(data)).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(places), [None, bounds, buffer]), np.searchsorted(places, offsets)

    def learn(self, chunks: pa.Array) -> np.ndarray:
        """Add distinct chunks that are not known yet; their codes."""
        import pyarrow.compute as pc

        _, data, offsets = _parts(chunks)
        kinds = byte_kinds(data)
        begin, last = offsets[:-1] + (data[offsets[:-1]] == 32), offsets[1:] - 1
        changes = np.concatenate([[0], np.cumsum(kinds[1:] != kinds[:-1])])
        plain = begin <= last
        begin = np.minimum(begin, last)
        plain &= np.isin(kinds[begin], (LETTER, DIGIT, MARK)) & (changes[begin] == changes[last]) & self.cuts
        for special in self.special:
            plain &= ~np.asarray(pc.match_substring(chunks, special))
        own, rest = chunks.filter(pa.array(plain)), chunks.filter(pa.array(~plain))
        _, data, offsets = _parts(own)
        letters, places = _POINTS[data].tobytes().decode("utf-32-le"), offsets.tolist()
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(letters[a:z])] for a, z in pairwise(places)]
        found += [e.ids for e in self.tokenizer.encode_batch_fast(rest.cast(pa.string()).to_pylist(), add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.empty(len(chunks), np.int64)
        codes[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = len(self.known) + np.arange(len(chunks))
        self.known = pa.concat_arrays([self.known, own, rest])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(found), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])
        return codes

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text (null: none)."""
        import pyarrow.compute as pc

        if len(self.known) > MOST_CHUNKS or self.held > MOST_BYTES:
            self.shrink()
        texts = (pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())).fill_null("")
        chunks, rows = self.chunks(texts)
        codes = np.asarray(pc.index_in(chunks, value_set=self.known).fill_null(-1)).astype(np.int64)
        new = np.flatnonzero(codes < 0)
        if len(new):
            unknown = chunks.filter(pa.array(codes < 0)).dictionary_encode()
            codes[new] = self.learn(unknown.dictionary)[np.asarray(unknown.indices)]
        self.uses += np.bincount(codes, minlength=len(self.uses))
        ids, ends = self._gather(codes)
        return ids, np.diff(np.concatenate([[0], ends])[rows])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """The encoder of this worker process; what it has learnt serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The end id after each text's ids."""
    return np.insert(ids, np.cumsum(counts), end_id)


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of a block of ids: 32 bit planes or 4 byte planes, lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if kind == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").ravel()
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


def _open(uri: str):
    from pyarrow import fs

    uri = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", uri))
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class Writer:
    """Writes ids to one file in blocks of ``block`` ids."""

    def __init__(self, uri: str, attempt: str, kind: str, block: int) -> None:
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{attempt}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.kind, self.block = kind, block
        self.pending: list[np.ndarray] = []
        self.held, self.written, self.offset = 0, 0, len(MAGIC)
        self.index: list[list] = []
        self.docs: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.packer = zstandard.ZstdCompressor(level=3)
        self.out.write(MAGIC)

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.counts.append(counts)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.pending)
            whole = len(ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._chunk(ids[at : at + self.block])
            self.pending, self.held = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.packer.compress(p) for p in split_planes(ids, self.kind)]
        self.out.write(b"".join(planes))
        self.index.append([self.offset, self.written, len(ids), [len(p) for p in planes]])
        self.offset += sum(map(len, planes))
        self.written += len(ids)

    def close(self) -> int:
        rest = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        if len(rest):
            self._chunk(rest)
        docs = pa.concat_arrays(self.docs) if self.docs else pa.array([], pa.int64())
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        parts = [
            self.packer.compress(np.asarray(docs.fill_null(0), dtype="<i8").tobytes()),
            self.packer.compress(np.asarray(docs.is_null(), dtype=np.uint8).tobytes()),
            self.packer.compress(counts.astype("<i8").tobytes()),
            self.packer.compress(json.dumps({"planes": self.kind, "block": self.block, "chunks": self.index}).encode()),
        ]
        tail = struct.pack("<4q", *map(len, parts)) + MAGIC
        self.out.write(b"".join(parts) + tail)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.written


class Reader:
    """Reads the indexes of a file at once and its chunks one by one."""

    def __init__(self, uri: str) -> None:
        self.fs, path = _open(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(32 + len(MAGIC), size - 32 - len(MAGIC))
        if tail[32:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a file of token planes: {uri}")
        lengths = struct.unpack("<4q", tail[:32])
        at = size - len(tail) - sum(lengths)
        unpack, parts = zstandard.ZstdDecompressor(), []
        for n in lengths:
            parts.append(unpack.decompress(self.file.read_at(n, at)))
            at += n
        self.doc_ids = pa.array(np.frombuffer(parts[0], "<i8"), pa.int64(), mask=np.frombuffer(parts[1], np.uint8).astype(bool))
        self.counts = np.frombuffer(parts[2], "<i8")
        about = json.loads(parts[3])
        self.kind, self.index, self.unpack = about["planes"], about["chunks"], unpack

    def chunk(self, k: int) -> np.ndarray:
        offset, _, n, lengths = self.index[k]
        raw, planes, at = self.file.read_at(sum(lengths), offset), [], 0
        for length in lengths:
            planes.append(self.unpack.decompress(raw[at : at + length]))
            at += length
        return join_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row of the document index, ids) in file order; no more than a chunk and a document in memory."""
        held, k = np.zeros(0, np.uint32), 0
        for row, n in enumerate(self.counts.tolist()):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.chunk(k))
                    have, k = have + len(parts[-1]), k + 1
                held = np.concatenate(parts)
            yield row, held[:n]
            held = held[n:]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, planes: str = "byte", block: int = BLOCK_IDS
) -> list[tuple[int, str, int, int]]:
    """Encode all documents and write them in ascending id order; (file number, uri, documents, ids) per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        uri = f"{folder}/ids-{part:06d}.planes"
        encoder = writer = None
        n = 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE_TEXT):
                if writer is None:
                    encoder = encoder_of(tokenizer)
                    writer = Writer(uri, f"{context.taskAttemptId()}.tmp", planes, block)
                ids, counts = encoder.encode(piece.column("text"))
                writer.add(piece.column("doc_id"), counts + 1, with_ends(ids, counts, end_id))
                n += piece.num_rows
        if writer is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "docs": pa.array([n], pa.int64()), "ids": pa.array([writer.close()], pa.int64())})

    keys = ["doc_id", "tie", "salt"]
    narrow = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = narrow.repartitionByRange(parts, *[F.col(k) for k in keys]).sortWithinPartitions(*keys).select("doc_id", "text")
    found = ranged.mapInArrow(run, "part int, uri string, docs long, ids long").collect()  # a row per file
    return sorted((r.part, r.uri, r.docs, r.ids) for r in found)


def read_token_files(spark, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of every document of the files."""
    rows, before = [], 0
    for part, uri, _, ids in files:
        rows.append((part, uri, before))
        before += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
                reader = Reader(uri)
                starts = first + np.cumsum(reader.counts) - reader.counts
                held: list[np.ndarray] = []
                size = done = 0
                for row, ids in reader.documents():
                    held.append(ids)
                    size += len(ids)
                    if size >= BLOCK_IDS * 8 or row + 1 == len(reader.counts):
                        at = slice(done, row + 1)
                        offsets = pa.array(np.concatenate([[0], np.cumsum(reader.counts[at])]), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [reader.doc_ids[at], pa.array(starts[at]), pa.array(reader.counts[at]), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held).astype(np.int32)))],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        held, size, done = [], 0, row + 1

    table = spark.createDataFrame(rows, "part int, uri string, first long").repartition(max(1, len(rows)))
    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def id_checksums(tokens: DataFrame) -> DataFrame:
    """The documents with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("ids")
            values, offsets = np.asarray(column.values).astype("<u4"), np.asarray(column.offsets)
            crc = [zlib.crc32(values[a:z]) for a, z in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents to a fresh shared folder and return what the files hold."""
    spark = docs.sparkSession
    files = write_token_files(docs, scratch_path(spark, "token-files"), tokenizer, **options)
    return read_token_files(spark, files)
