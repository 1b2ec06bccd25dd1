"""Token ids in fixed-width bit-packed shard files.

Every document is encoded by a public tokenizer, an end id is appended, and the
ids are written in ascending doc_id order with the least number of bits that the
vocabulary needs.  A shard file is

    magic ``SLTB``, uint32 version, uint32 bits, uint32 ids per block,
    uint64 documents, uint64 ids, uint64 blocks, uint64 bytes of doc_ids,
    doc_ids as an Arrow stream of one column, uint64 id offsets (documents + 1),
    uint64 block offsets (bytes from the payload's start, blocks + 1), payload

Blocks start at whole bytes, so any range of ids is read by unpacking only its
blocks with numpy.  Shards are written under a name of the attempt and renamed,
so a task that runs again on another executor leaves one whole file; a failed attempt
removes what it wrote.

The tokenizer splits texts at places that depend on neighbouring characters only
(before a single space, around a single line feed, between a letter and ASCII
punctuation), so the pieces between such places are encoded once per distinct piece and the ids
are gathered; the ids equal those of the whole text (tested).  Pieces are found by a hash and
compared byte for byte; where two share a hash, or a token crosses a cut, the chunk's texts are
encoded whole.

Defined results: null and empty texts are the end id alone; null doc_ids come
first; equal doc_ids are ordered by their text; doc_ids of any ordered type go; an
empty table writes nothing; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import fresh_path, partitions, planned_bytes
from slotloom.llm.words import U64, chunks, ragged, text_column, tidy, word_hashes

BLOCK_IDS = 1 << 16
SHARD_BYTES = 32 << 20
#: What known pieces may take in a worker, and the text that is encoded at a time.
CACHE_BYTES, ENCODE_BYTES = 32 << 20, 1 << 19
#: Ranges of equal doc_ids may be cut between texts that differ in so many characters.
ORDER_CHARS = 32
_MAGIC, _VERSION, _HEAD = b"SLTB", 2, 48

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_PUNCT = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)])
_SOLID = np.array([33 <= b <= 126 for b in range(256)])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bits first, padded to whole groups of eight ids."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    n = -(-len(ids) // 8)
    groups = np.zeros((n, 8), U64)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, bits + 8), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = groups[:, k] << U64(shift)
        for m in range((bits + shift + 7) // 8):
            out[:, byte + m] |= (value >> U64(8 * m)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype(np.uint32)
    groups = np.frombuffer(raw, np.uint8).reshape(-1, bits)
    wide = np.zeros((len(groups), bits + 8), np.uint8)
    wide[:, :bits] = groups
    out = np.empty((len(groups), 8), np.uint32)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = np.zeros(len(groups), U64)
        for m in range((bits + shift + 7) // 8):
            value |= wide[:, byte + m].astype(U64) << U64(8 * m)
        out[:, k] = (value >> U64(shift)) & U64((1 << bits) - 1)
    return out.reshape(-1)[:n]


def _filesystem(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


class ShardWriter:
    """Writes one shard; documents are added in order."""

    def __init__(self, url: str, bits: int):
        self.fs, self.path = _filesystem(url)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.bits, self.doc_ids, self.lengths, self.held, self.n_held = bits, [], [], [], 0
        self.payload = self.fs.open_output_stream(f"{self.part}.payload")
        self.offsets = [0]

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.lengths.append(lengths.astype(np.uint64))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 16 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        for at in range(0, whole, BLOCK_IDS):
            raw = pack(ids[at : min(at + BLOCK_IDS, whole)], self.bits)
            self.payload.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        """Joins header and payload under the shard's own name; the number of ids."""
        self._flush(True)
        self.payload.close()
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.uint64)
        starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lengths, dtype=np.uint64)])
        named = pa.BufferOutputStream()
        with pa.ipc.new_stream(named, pa.schema([("doc_id", self.doc_ids[0].type)])) as stream:
            for part in self.doc_ids:
                stream.write_batch(pa.record_batch([part], ["doc_id"]))
        named = named.getvalue()
        with self.fs.open_output_stream(self.part) as out:
            out.write(_MAGIC + np.array([_VERSION, self.bits, BLOCK_IDS], "<u4").tobytes())
            out.write(np.array([len(lengths), starts[-1], len(self.offsets) - 1, named.size], "<u8").tobytes())
            out.write(named)
            out.write(starts.astype("<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
            with self.fs.open_input_stream(f"{self.part}.payload") as payload:
                while raw := payload.read(8 << 20):
                    out.write(raw)
        self.fs.delete_file(f"{self.part}.payload")
        self.fs.move(self.part, self.path)
        return int(starts[-1])

    def abandon(self) -> None:
        """Removes what a failed attempt has written."""
        with contextlib.suppress(OSError, ValueError):
            self.payload.close()
        for path in (self.part, f"{self.part}.payload"):
            with contextlib.suppress(OSError):
                self.fs.delete_file(path)


class ShardReader:
    """Random access to a shard: only the blocks of the asked ids are read."""

    def __init__(self, url: str):
        self.fs, self.path = _filesystem(url)
        self.file = self.fs.open_input_file(self.path)
        head = self.file.read(_HEAD)
        if head[:4] != _MAGIC or int(np.frombuffer(head, "<u4", 1, 4)[0]) != _VERSION:
            raise ValueError(f"{url} is not a token shard of version {_VERSION}")
        self.bits, self.block = (int(x) for x in np.frombuffer(head, "<u4", 2, 8))
        self.n_docs, self.n_ids, n_blocks, named = (int(x) for x in np.frombuffer(head, "<u8", 4, 16))
        self.doc_ids = pa.ipc.open_stream(self.file.read(named)).read_all()["doc_id"].combine_chunks()
        self.starts = np.frombuffer(self.file.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self.file.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.base = _HEAD + named + 8 * (self.n_docs + 1) + 8 * (n_blocks + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.file.seek(self.base + int(self.offsets[first]))
        raw = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        out, at = [], 0
        for b in range(first, last + 1):
            size = int(self.offsets[b + 1] - self.offsets[b])
            out.append(unpack(raw[at : at + size], min(self.block, self.n_ids - b * self.block), self.bits))
            at += size
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _latin(data: np.ndarray) -> np.ndarray:
    """Where a letter of U+00C0 to U+00FF (without the two signs there) ends: it takes two bytes."""
    out = np.zeros(len(data), bool)
    last = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[last] = (data[last] >= 0x80) & (data[last] != 0x97) & (data[last] != 0xB7)
    return out


class PieceEncoder:
    """Encodes documents piece by piece; known pieces are kept by their hash."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Of byte-level tokens each character stands for one byte; added tokens stand for their own text.
        self.width = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(t.content.encode())
        self.forget()

    def forget(self) -> None:
        self.hashes, self.ids, self.raw = np.zeros(0, U64), np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        #: Of each known piece its first id and byte, and how many it has of both.
        self.at, self.n, self.raw_at, self.raw_n = (np.zeros(0, np.int32) for _ in range(4))
        #: In how many chunks each was met.
        self.used = np.zeros(0, np.int32)

    def _held(self) -> int:
        return 28 * len(self.hashes) + 4 * len(self.ids) + len(self.raw)

    def _thin_out(self) -> None:
        """Forgets the pieces that were met least, at least half of them."""
        stay = np.flatnonzero(self.used > max(1, np.median(self.used)))
        ids, raw = self.ids[ragged(self.at[stay].astype(np.int64), self.n[stay])], self.raw[ragged(self.raw_at[stay].astype(np.int64), self.raw_n[stay])]
        self.hashes, self.n, self.raw_n, self.used = self.hashes[stay], self.n[stay], self.raw_n[stay], self.used[stay] // 2
        self.ids, self.raw = ids, raw
        self.at, self.raw_at = ((np.cumsum(n) - n).astype(np.int32) for n in (self.n, self.raw_n))

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of pieces: document starts, single spaces between solid characters, letter to punctuation."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            solid, letter = _SOLID[data], _latin(data)
            opens, closes = solid | (data >= 0xC3), solid | letter
            cut[1 : n - 1] = (data[1:-1] == 32) & closes[:-2] & opens[2:]
            cut[1:n] |= (_LETTER[data[:-1]] | letter[:-1]) & _PUNCT[data[1:]]
            # A single line feed between solid characters is a piece of its own.
            feed = np.flatnonzero(data[1:-1] == 10) + 1
            feed = feed[closes[feed - 1] & opens[feed + 1]]
            cut[feed] = cut[feed + 1] = True
        for s in self.special:  # a special token is not cut
            raw, at = data.tobytes(), -1
            while (at := raw.find(s, at + 1)) >= 0:
                cut[at : at + len(s) + 1] = False
        cut[offsets] = True
        return np.flatnonzero(cut[:n])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, number of ids of each) of a chunk."""
        docs = len(offsets) - 1
        starts = self._cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        ends = np.append(starts[1:], len(data))
        distinct, first, which = np.unique(word_hashes(data, starts, ends, False), return_index=True, return_inverse=True)
        lengths = ends - starts
        alike = lengths[first]
        # Pieces tile the chunk, so the first pieces of their hashes must give the chunk again.
        same = (alike[which] == lengths).all() and (data[ragged(starts[first][which], lengths)] == data[starts[0] :]).all()
        if self._held() > CACHE_BYTES:
            self._thin_out()
        place = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = np.ones(len(distinct), bool) if not len(self.hashes) else self.hashes[place] != distinct
        if same and not new.all():
            old, p = first[~new], place[~new]
            same = (self.raw_n[p] == lengths[old]).all() and (self.raw[ragged(self.raw_at[p].astype(np.int64), lengths[old])] == data[ragged(starts[old], lengths[old])]).all()
        if not same or (new.any() and not self._learn(data, starts[first[new]], ends[first[new]], distinct[new])):
            return self._whole(data, offsets)
        place = np.searchsorted(self.hashes, distinct)
        self.used[place] += 1
        at, n = self.at[place][which].astype(np.int64), self.n[place][which]
        doc = np.searchsorted(offsets, starts, "right") - 1
        return self.ids[ragged(at, n)], np.bincount(doc, n, docs).astype(np.int64)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` without pieces."""
        raw = data.tobytes()
        found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])], add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.uint32) for e in found]), np.array([len(e.ids) for e in found], np.int64)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> bool:
        """Encodes new pieces; false, with nothing learned, if a token crosses two of them."""
        # Pieces that start with a space and end in a solid character or a letter may follow each other in one
        # text: the splits between them stay.  Others are encoded alone.
        lengths = ends - starts
        chained = (lengths > 1) & (data[starts] == 32) & (_SOLID[data[ends - 1]] | _latin(data)[ends - 1])
        order = np.concatenate([np.flatnonzero(chained), np.flatnonzero(~chained)])
        starts, lengths, hashes, k = starts[order], lengths[order], hashes[order], int(chained.sum())
        texts, groups = [], []
        for a in range(0, k, 4096):
            b = min(a + 4096, k)
            texts.append(data[ragged(starts[a:b], lengths[a:b])].tobytes().decode())
            groups.append((a, b))
        for i in range(k, len(starts)):
            texts.append(data[starts[i] : starts[i] + lengths[i]].tobytes().decode())
            groups.append((i, i + 1))
        flat, counts = [self.ids], np.zeros(len(starts), np.int32)
        for (a, b), enc in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(enc.ids, np.uint32)
            flat.append(ids)
            if b - a == 1:
                counts[a] = len(ids)
            else:
                upto = np.cumsum(self.width[ids])
                bounds = np.cumsum(lengths[a:b])
                last = np.minimum(np.searchsorted(upto, bounds), len(upto) - 1)
                if upto[-1] != bounds[-1] or (upto[last] != bounds).any():
                    return False
                counts[a:b] = np.diff(last + 1, prepend=0)
        at, raw_at = len(self.ids) + np.cumsum(counts) - counts, len(self.raw) + np.cumsum(lengths) - lengths
        order = np.argsort(hashes)
        # Both are in order, so the new ones are put between the known ones.
        to = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.used = np.insert(self.hashes, to, hashes[order]), np.insert(self.used, to, 0)
        self.at, self.n, self.raw_at, self.raw_n = (np.insert(old, to, more.astype(np.int32)[order]) for old, more in ((self.at, at), (self.n, counts), (self.raw_at, raw_at), (self.raw_n, lengths)))
        self.ids, self.raw = np.concatenate(flat), np.concatenate([self.raw, data[ragged(starts, lengths)]])
        return True


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _write(folder: str, tokenizer_path: str, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, shard = encoder(tokenizer_path), None, TaskContext.get().partitionId()
        url, docs = f"{folder}/shard-{shard:08d}.sltb", 0
        try:
            for batch in batches:
                for lo, hi, data, offsets in chunks(text_column(batch.column(1)), ENCODE_BYTES):
                    ids, n = enc.encode(data, offsets)
                    writer = writer or ShardWriter(url, bits_for(enc.vocabulary))
                    writer.add(pa.concat_arrays([batch.column(0).slice(lo, hi - lo)]), n + 1, np.insert(ids, np.cumsum(n), np.uint32(end_id)))
                    docs += hi - lo
            n_ids = writer.close() if writer else 0
        except BaseException:
            if writer:
                writer.abandon()
            raise
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([url]), pa.array([docs], pa.int64()), pa.array([n_ids], pa.int64())], ["shard", "url", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes the shards and gives their manifest: shard, url, n_docs, n_ids, start (ids in earlier shards).

    The manifest has one row per shard, so the driver may sum it up.
    """
    spark = docs.sparkSession
    shards = max(partitions(spark), planned_bytes(docs) // SHARD_BYTES)
    rows = docs.select("doc_id", "text")
    # Rows of one doc_id, or of none, may be cut by their texts, in the same order.
    rows = rows.repartitionByRange(int(shards), F.col("doc_id"), F.substring("text", 1, ORDER_CHARS)).sortWithinPartitions("doc_id", "text")
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    manifest = rows.mapInArrow(_write(folder, tokenizer_path, end_id), "shard int, url string, n_docs long, n_ids long").collect()
    start, out = 0, []
    for r in sorted(manifest, key=lambda r: r.shard):
        out.append((r.shard, r.url, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(out, "shard int, url string, n_docs long, n_ids long, start long")


def read_token_files(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """doc_id (of type ``kind``), start, n_tokens, ids_crc32 of each document, from the shard files."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader, at = ShardReader(url), 0
                while at < reader.n_docs:
                    end = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + 8 * BLOCK_IDS, "right")) - 1)
                    base = int(reader.starts[at])
                    ids = reader.ids(base, int(reader.starts[end])).astype("<u4")
                    edges = reader.starts[at : end + 1] - base
                    crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
                    columns = [reader.doc_ids.slice(at, end - at), pa.array(edges[:-1] + base + start), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = end

    spark = manifest.sparkSession
    spread = manifest.select("url", "start").repartition(max(1, min(manifest.count(), 4 * partitions(spark))))
    return spread.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, fresh_path(spark, "tokens"), tokenizer_file()), docs.schema["doc_id"].dataType.simpleString())
