"""Token ids as compressed binary, with a shared dictionary.

Every document's ids become an array of little-endian 16-bit numbers (32 where
the vocabulary needs it), compressed on its own with a zstandard dictionary
trained on such arrays. A document is a row: its frame, the shard it lies in,
and where it begins there. The dictionary's hash stands with every row, and its
bytes on the row at offset 0 of each shard, so each shard can be read alone.

:func:`write_shards` puts the frames into files, a file a shard, headed by the
dictionary, and returns the index of offsets: a short document is read by one
slice and one decompression (:func:`read_frame`). Files are written by the tasks
and named by attempt, so a lost executor leaves a file that no index row names.

Encoding splits all texts of a batch at once, on bytes, by the tokenizer's own
pattern, and asks the tokenizer only for pieces not met before by the worker;
pieces of more than 64 bytes are always asked for. Rows with a character that
this Python's Unicode tables don't know go to the tokenizer whole. The plan is
one narrow pass over the texts.

The dictionary is trained on about ``SAMPLE`` bytes of arrays of documents
chosen by hash over the whole table (zstandard takes a bounded sample; the
bound is a parameter). Where there is too little to train one, frames have no
dictionary, ``dict_hash`` is empty and ``dictionary`` null.

Defined results: a row for each input row; null, empty texts have no tokens and
a frame of an empty array; repeated rows each have their own frame; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import os
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

U64 = np.uint64
#: A rank file: base64 of a token's bytes, space, its id.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DICT_BYTES, SAMPLE, LEVEL = 64 << 10, 8 << 20, 3
#: Bytes of frames after which a new shard begins.
SHARD = 64 << 20
CACHED = 1_000_000
LONG = 64
L, N, S, O, X = range(5)  # letter, number, space, other, unknown to this Python
_classes: np.ndarray | None = None
_encoders: dict[str, Encoder] = {}
MAGIC = b"IDS1"


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        out = np.full(0x110000, O, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LN" or kind == "Cn":
                out[c] = L if kind[0] == "L" else N if kind[0] == "N" else X
        out[[0x85, 0xA0, 0x1680, *range(9, 14), 32, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = S
        _classes = out
    return _classes


def classes(b: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    table = _class_table()
    out = table[b]
    lead = np.flatnonzero(b >= 0xC0)
    if len(lead):
        x = b[lead].astype(np.int64)
        size = 2 + (x >= 0xE0) + (x >= 0xF0)
        code = x & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << 6) | (b[lead[more] + k] & 0x3F)
        for k in range(4):
            more = size > k
            out[lead[more] + k] = table[code[more]]
    return out


def pieces(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of pieces, class of each byte) of texts end to end; the texts
    begin at ``off`` (from 0, the last entry being the total length)."""
    n = len(b)
    c = classes(b)
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # where a document begins
    run = edge[:n].copy()
    run[1:] |= c[1:] != c[:-1]
    start = run.copy()
    # the last of a run of spaces goes with what follows, if it is a blank, else it stands alone
    after = np.flatnonzero(run[1:] & (c[1:] != S) & (c[:-1] == S) & ~edge[1:n]) + 1
    last = after - 1
    while (inner := (b[last] & 0xC0) == 0x80).any():
        last[inner] -= 1
    start[last] = True
    start[after[b[after - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll: a quote by itself, not after a blank, and letters
    q = np.flatnonzero((b[:-1] == 39) & run[:-1] & run[1:] & (c[1:] == L) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    q = q[edge[q] | (b[np.maximum(q - 1, 0)] != 32)]
    one, two = b[q + 1], np.where((q + 2 < n) & ~edge[np.minimum(q + 2, n)], b[np.minimum(q + 2, n - 1)], 0)
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for at, k in ((q[single], 2), (q[double & ~single], 3)):
        start[at + 1] = False
        start[(at + k)[at + k < n]] = True
    return np.flatnonzero(start), c


class Encoder:
    """Ids of batches of texts, the same as the tokenizer's own."""

    def __init__(self, path: str, raw: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(i) for a, i in map(bytes.split, raw.splitlines())}
        self.own = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        self.piece = self.own._core_bpe.encode_single_piece
        self.clear()

    def clear(self) -> None:
        #: Hashes of pieces in order, and where in the pool their ids are.
        self.key, self.begin, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _ids(self, h: np.ndarray, first: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of each of the distinct pieces are."""
        at = np.searchsorted(self.key, h)
        place = np.minimum(at, max(0, len(self.key) - 1))
        new = self.key[place] != h if len(self.key) else np.ones(len(h), bool)
        begin, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int32)
        begin[~new], size[~new] = self.begin[place[~new]], self.size[place[~new]]
        if new.any():
            a, z, piece = start[first[new]], end[first[new]], self.piece
            found = [piece(raw[i:j]) for i, j in zip(a.tolist(), z.tolist(), strict=True)]
            size[new] = np.fromiter(map(len, found), np.int32, len(found))
            ends = self.used + np.cumsum(size[new], dtype=np.int64)
            begin[new] = ends - size[new]
            while ends[-1] > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : ends[-1]] = np.fromiter(chain.from_iterable(found), self.kind, int(ends[-1]) - self.used)
            self.used = int(ends[-1])
            kept = new.copy()
            kept[new] = z - a <= LONG
            self.key, self.begin, self.size = (np.insert(x, at[kept], y[kept]) for x, y in ((self.key, h), (self.begin, begin), (self.size, size)))
        return begin, size

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, where each text's ids begin and the last end)."""
        b, at = data[off[0] : off[-1]], off - off[0]
        n = len(b)
        if not n:
            return np.zeros(0, self.kind), np.zeros(len(off), np.int64)
        if len(self.key) > CACHED:
            self.clear()
        start, c = pieces(b, at)
        raw = b.tobytes()
        unknown = np.zeros(len(at) - 1, bool)
        if (c == X).any():
            unknown[np.searchsorted(at, np.flatnonzero(c == X), "right") - 1] = True
        end = np.append(start[1:], n)
        pw, inv = C._powers(n + 1)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        np.cumsum((b.astype(U64) + U64(1)) * pw[:n], out=sums[1:])
        h = C.mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(U64))
        long = np.flatnonzero(end - start > LONG)
        h[long] = long.astype(U64)  # told apart by place, and not kept
        order = np.argsort(h)
        u = h[order]
        new = np.concatenate([[True], u[1:] != u[:-1]])
        begin, size = self._ids(u[new], order[new], raw, start, end)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        begin, size = begin[which], size[which].astype(np.int64)
        ends = np.cumsum(size)
        out = self.pool[np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)]
        edges = np.concatenate([[0], ends])[np.searchsorted(start, at)]
        if unknown.any():
            parts = [np.array(self.own.encode_ordinary(raw[at[k] : at[k + 1]].decode()), self.kind) if unknown[k] else out[edges[k] : edges[k + 1]] for k in range(len(at) - 1)]
            out, edges = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, edges


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str, raw: bytes | None = None) -> Encoder:
    """``raw``: the file's bytes, for executors that don't have the file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, vocabulary(path) if raw is None else raw)
    return _encoders[path]


def id_arrays(col: pa.Array, path: str, raw: bytes | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, ids, offsets) of runs of rows."""
    enc = encoder(path, raw)
    off, data = C.string_buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + C.CHUNK_BYTES, "right")) - 1)
        yield i, j, *enc.encode(data, off[i : j + 1])
        i = j


def dictionary(docs: DataFrame, path: str = VOCABULARY, dict_bytes: int = DICT_BYTES, sample: int = SAMPLE) -> bytes:
    """A dictionary trained on id arrays of distinct texts chosen by hash."""
    import zstandard

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, 1.25 * sample / max(total, 1))  # an array takes about 0.8 of its text
    own = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    own = own.withColumn("h", F.xxhash64("text")).dropDuplicates(["h"]).select("text")  # of many copies one

    raw = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, ids, at in id_arrays(b.column(0), path, raw.value):
                yield pa.RecordBatch.from_arrays([pa.array([ids[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["ids"])

    samples = sorted(x for x in own.mapInArrow(arrays, "ids binary").toArrow()["ids"].to_pylist() if x)
    try:
        return zstandard.train_dictionary(min(dict_bytes, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


def binary(spark: SparkSession, docs: DataFrame, path: str = VOCABULARY, dict_bytes: int = DICT_BYTES, sample: int = SAMPLE, level: int = LEVEL, shard_bytes: int = SHARD) -> DataFrame:
    """(doc_id, shard, offset, length, n_tokens, dict_hash, dictionary, frame)."""
    shared = spark.sparkContext.broadcast(dictionary(docs, path, dict_bytes, sample))
    raw = spark.sparkContext.broadcast(vocabulary(path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        known = shared.value
        name = hashlib.sha256(known).hexdigest() if known else ""
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known) if known else None).compress
        shard, place = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for first, last, ids, at in id_arrays(b.column("text"), path, raw.value):
                frames = [press(ids[a:z].tobytes()) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                shards, places, heads = [], [], []
                for f in frames:
                    if place and place + len(f) > shard_bytes:
                        shard, place = shard + 1, 0
                    shards.append(shard)
                    places.append(place)
                    heads.append(known if known and not place else None)
                    place += len(f)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, last - first), pa.array(shards, pa.int64()), pa.array(places, pa.int64()), pa.array(list(map(len, frames)), pa.int32()), pa.array(np.diff(at).astype(np.int32)), pa.array([name] * len(frames)), pa.array(heads, pa.binary()), pa.array(frames, pa.binary())],
                    names=["doc_id", "shard", "offset", "length", "n_tokens", "dict_hash", "dictionary", "frame"],
                )

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return thin.mapInArrow(rows, "doc_id long, shard long, offset long, length int, n_tokens int, dict_hash string, dictionary binary, frame binary")


def write_shards(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """The frames of :func:`binary` as files in ``folder`` (a URI or an absolute
    path that all executors share), and their stored index: (doc_id, file,
    offset, length, n_tokens, dict_hash), the offset being that in the file."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder)
        name, out, head, now = "", None, 0, None
        for b in batches:
            files, places = [], []
            for shard, place, known, frame in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "dictionary", "frame")), strict=True):
                if shard != now:
                    if out:
                        out.close()
                    now, name = shard, f"shard-{shard:016x}-{TaskContext.get().taskAttemptId()}.bin"
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                    head = MAGIC + len(known or b"").to_bytes(4, "little") + (known or b"")
                    out.write(head)
                    head = len(head)
                out.write(frame)
                files.append(name)
                places.append(head + place)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(files, pa.string()), pa.array(places, pa.int64()), *(b.column(c) for c in ("length", "n_tokens", "dict_hash"))], names=["doc_id", "file", "offset", "length", "n_tokens", "dict_hash"])
        if out:
            out.close()

    index = rows.mapInArrow(write, "doc_id long, file string, offset long, length int, n_tokens int, dict_hash string")
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_head(folder: str, file: str) -> bytes | None:
    """The dictionary of a shard file."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    with where.open_input_file(f"{root}/{file}") as f:
        if f.read(4) != MAGIC:
            raise ValueError(f"{file} is not a shard")
        return f.read(int.from_bytes(f.read(4), "little")) or None


def read_frame(folder: str, file: str, offset: int, length: int) -> bytes:
    """One document's frame, by one slice."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    with where.open_input_file(f"{root}/{file}") as f:
        return f.read_at(length, offset)


def ids_of(frame: bytes, known: bytes | None, path: str = VOCABULARY) -> np.ndarray:
    """The ids of one frame."""
    import zstandard

    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
    return np.frombuffer(press.decompress(frame), encoder(path).kind)


def text_of(frame: bytes, known: bytes | None, path: str = VOCABULARY) -> str:
    return encoder(path).own.decode(ids_of(frame, known, path).tolist())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary(spark, C.table(spark, sf_dir, "documents"))


assert sys.byteorder == "little"
