"""Token ids as patched frame-of-reference blocks.

Documents are dealt by ranges of id and sorted; each task encodes its range and
cuts it into *chunks* of whole documents. A chunk is one binary value:

    magic "PFOR" | version u16 | block size u16 | documents u32 | ids u64 | blocks u32
    document ids i64[documents] | ids of each document u32[documents]
    byte where each block starts, from the first block, u64[blocks]
    blocks: minimum u32 | width u8 | exceptions u16 | packed u64[...] | position u16[] | value u32[]

All numbers are little-endian. A block holds its ids minus their minimum, packed
at the width that holds ``percentile`` percent of them; ids that need more bits
stand in the exception list with their position. Block starts allow reading one
block alone (``read_block``).

Chunks are rows of a Parquet table (shard, chunk, start, n_ids, payload), so any
store that Spark writes will do and only finished tasks leave files; ``start``
counts the ids of the shard before the chunk.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import back_id, per_process, slices, span_hashes, width

BLOCK = 1024
HEAD = "<4sHHIQI"
BLOCK_HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("n", "<u2")])
CHUNK_IDS = 1 << 20
CACHE = 2_000_000
#: New words that are encoded as one text.
RUN_WORDS = 10_000
#: How a byte-level vocabulary spells the space.
SPACE_MARK = "\u0120"


class Encoder:
    """Encodes texts by the tokenizers library, each distinct word once while it is remembered.

    Byte-level pre-tokenizing always starts a token at a single space that is
    followed by something else than white space, so a text may be cut there.
    Words are found and hashed as spans of one byte buffer; only those not seen
    before become strings. Texts where a space is followed by white space are
    cut with more care. Known words are sorted arrays of hash, place and number
    of ids, about 20 bytes a word; beyond CACHE words they are learned anew.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[k for token, k in vocabulary.items() if token.startswith(SPACE_MARK)]] = True
        self.white = np.zeros(256, dtype=bool)
        self.white[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self._forget()
        self.careful = re.compile(r"(?= \S)")

    def _forget(self) -> None:
        self.keys, self.ids = np.zeros(0, dtype=np.uint64), np.array([self.end_id], dtype="<u4")  # place 0: the end id
        self.places, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _plain(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _learn(self, hashes: np.ndarray, buffer: bytes, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> None:
        """Add the words whose hashes (sorted) are not known; size -1 marks words that do not stand alone."""
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != hashes[inside]
        new = np.nonzero(new)[0]
        start, end, head = start[new], end[new], head[new]
        plain = ~head & (end > start)
        # white space after a space; only words that do not begin with ASCII need a look at the character
        plain[plain] = ~self.white[np.frombuffer(buffer, dtype=np.uint8)[start[plain]]]
        for k in np.flatnonzero(plain & (np.frombuffer(buffer, dtype=np.uint8)[start] > 127)).tolist():
            plain[k] = not buffer[start[k] : start[k] + 4].decode(errors="ignore")[0].isspace()
        ids, sizes = [], np.full(len(new), -1, dtype=np.int32)
        if plain.any():
            # with the space before each word; a token that starts with a space starts a word
            joined = [buffer[a - 1 : b] for a, b in zip(start[plain].tolist(), end[plain].tolist(), strict=True)]
            texts = [b"".join(joined[k : k + RUN_WORDS]).decode() for k in range(0, len(joined), RUN_WORDS)]
            ids = self._plain(texts)
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            opened = np.flatnonzero(self.opens[flat])
            if len(opened) != len(joined):
                raise ValueError("this tokenizer does not start a token at every space before a word")
            sizes[plain] = np.diff(np.append(opened, len(flat)))
        first = self._plain([buffer[a:b].decode() for a, b in zip(start[head].tolist(), end[head].tolist(), strict=True)])
        sizes[head] = np.array(list(map(len, first)), dtype=np.int32) // 4
        counts = np.concatenate([sizes[plain], sizes[head]]).astype(np.int64)
        places = np.zeros(len(new), dtype=np.int64)
        places[np.append(np.flatnonzero(plain), np.flatnonzero(head))] = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids + first), dtype="<u4")])
        self.keys = np.insert(self.keys, at[new], hashes[new])
        self.places, self.sizes = np.insert(self.places, at[new], places), np.insert(self.sizes, at[new], sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and their number for each text."""
        if len(self.keys) > CACHE:
            self._forget()
        raw = [text.encode() for text in texts]
        buffer = b" ".join(raw) + b" "
        data = np.frombuffer(buffer, dtype=np.uint8)
        end = np.nonzero(data == 32)[0]
        start = np.append(0, end[:-1] + 1)
        sizes = np.array([len(x) + 1 for x in raw])
        doc_end = np.searchsorted(end, np.cumsum(sizes) - 1) + 1  # words up to the end of each text
        first = np.append(0, doc_end[:-1])
        hashes = span_hashes(data, start, end)
        hashes[first] ^= np.uint64(0x5555555555555555)  # the first word of a text has no space before it
        distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        heads = np.zeros(len(start), dtype=bool)
        heads[first] = True
        self._learn(distinct, buffer, start[sample], end[sample], heads[sample])
        at = np.searchsorted(self.keys, distinct)
        odd, counts, places = self.sizes[at] < 0, np.maximum(self.sizes[at], 0), self.places[at]
        # the end id is one more word
        words = np.insert(inverse, doc_end, len(counts))
        counts, places = np.append(counts, 1)[words], np.append(places, 0)[words]
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(places - (total - counts), counts) + np.arange(total[-1])]
        n_docs = np.diff(np.append(0, total[doc_end + np.arange(len(texts))]))
        if odd.any():
            strange = np.zeros(len(start) + 1, dtype=np.int64)
            np.cumsum(odd[inverse], out=strange[1:])
            parts = np.split(ids, np.cumsum(n_docs)[:-1])
            for d in np.nonzero(strange[doc_end] > strange[first])[0].tolist():
                again = b"".join(self._plain(self.careful.split(texts[d]))) + self.end
                parts[d] = np.frombuffer(again, dtype="<u4")
            ids, n_docs = np.concatenate(parts), np.array(list(map(len, parts)))
        return ids, n_docs


def pack(blocks: np.ndarray, bits: int) -> np.ndarray:
    """Rows of BLOCK values as rows of bits * BLOCK / 64 words."""
    lanes = np.ascontiguousarray(blocks.reshape(len(blocks), -1, 64).transpose(2, 0, 1)).astype(np.uint64)
    out = np.zeros((bits, *lanes.shape[1:]), dtype=np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[word] |= lanes[lane] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(len(blocks), -1)


def unpack(words: np.ndarray, bits: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.reshape(len(words), -1, bits).transpose(2, 0, 1)) if bits else None
    out = np.zeros((64, len(words), BLOCK // 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64 if bits else 0):
        word, shift = divmod(lane * bits, 64)
        value = lanes[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (lanes[word + 1] << np.uint64(64 - shift))
        out[lane] = (value & mask).astype(np.uint32)
    return np.ascontiguousarray(out.transpose(1, 2, 0)).reshape(len(words), BLOCK)


def write_chunk(doc_ids: list[int], sizes: list[int], ids: np.ndarray, percentile: float) -> bytes:
    count = -(-len(ids) // BLOCK)
    blocks = np.zeros((count, BLOCK), dtype=np.uint32)
    flat = blocks.reshape(-1)
    flat[: len(ids)] = ids
    flat[len(ids) :] = ids[-1] if len(ids) else 0
    least = blocks.min(axis=1)
    above = blocks - least[:, None]
    held = np.partition(above, int((BLOCK - 1) * percentile / 100), axis=1)[:, int((BLOCK - 1) * percentile / 100)]
    bits = np.ceil(np.log2(held.astype(np.float64) + 1)).astype(np.int64)
    packed: list[bytes] = [b""] * count
    for w in np.unique(bits).tolist():
        rows = np.nonzero(bits == w)[0]
        words = pack(above[rows] & np.uint32((1 << w) - 1), w) if w else np.zeros((len(rows), 0), dtype=np.uint64)
        for row, value in zip(rows.tolist(), words, strict=True):
            packed[row] = value.astype("<u8").tobytes()
    odd = (above.astype(np.uint64) >> bits.astype(np.uint64)[:, None]) > 0
    n_odd = odd.sum(axis=1)
    where, value = np.nonzero(odd)[1].astype("<u2"), blocks[odd].astype("<u4")
    ends = np.cumsum(n_odd)
    parts = []
    for k in range(count):
        a, b = ends[k] - n_odd[k], ends[k]
        head = np.array([(least[k], bits[k], n_odd[k])], dtype=BLOCK_HEAD).tobytes()
        parts.append(head + packed[k] + where[a:b].tobytes() + value[a:b].tobytes())
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype("<u8")
    head = struct.pack(HEAD, b"PFOR", 1, BLOCK, len(doc_ids), len(ids), count)
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), starts.tobytes(), *parts])


def _layout(payload: bytes):
    magic, version, size, docs, n, count = struct.unpack_from(HEAD, payload)
    if magic != b"PFOR" or version != 1 or size != BLOCK:
        raise ValueError("not a chunk of token blocks")
    at = struct.calcsize(HEAD)
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    sizes = np.frombuffer(payload, "<u4", docs, at + 8 * docs)
    starts = np.frombuffer(payload, "<u8", count, at + 12 * docs).astype(np.int64) + at + 12 * docs + 8 * count
    return doc_ids, sizes, starts, n


def _blocks(payload: bytes, starts: np.ndarray) -> np.ndarray:
    """The blocks that start at the given bytes."""
    raw = np.frombuffer(payload, np.uint8)
    heads = raw[starts[:, None] + np.arange(BLOCK_HEAD.itemsize)].copy().view(BLOCK_HEAD).reshape(-1)
    out = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    for w in np.unique(heads["width"]).tolist():
        rows = np.nonzero(heads["width"] == w)[0]
        if w:
            at = starts[rows] + BLOCK_HEAD.itemsize
            words = raw[at[:, None] + np.arange(w * BLOCK // 8)].view("<u8")
            out[rows] = unpack(words, w)
    out += heads["least"][:, None]
    for k in np.nonzero(heads["n"])[0].tolist():
        at, n = int(starts[k]) + BLOCK_HEAD.itemsize + int(heads["width"][k]) * BLOCK // 8, int(heads["n"][k])
        out[k, np.frombuffer(payload, "<u2", n, at)] = np.frombuffer(payload, "<u4", n, at + 2 * n)
    return out


def read_chunk(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, number of ids of each, and all ids."""
    doc_ids, sizes, starts, n = _layout(payload)
    ids = _blocks(payload, starts).reshape(-1)[:n] if len(starts) else np.zeros(0, dtype=np.uint32)
    return doc_ids, sizes, ids


def read_block(payload: bytes, k: int) -> np.ndarray:
    """Block k alone, found by the index."""
    _, _, starts, n = _layout(payload)
    return _blocks(payload, starts[k : k + 1]).reshape(-1)[: min(BLOCK, n - k * BLOCK)]


CHUNKS = "shard int, chunk int, start long, n_ids long, payload binary"


def _encode(path: str, end_id: int, percentile: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = per_process(f"encoder {path} {end_id}", lambda: Encoder(path, end_id)), TaskContext.get().partitionId()
        doc_ids, sizes, parts, held, start, chunk = [], [], [], 0, 0, 0

        def flush():
            nonlocal doc_ids, sizes, parts, held, start, chunk
            ids = np.concatenate(parts)
            payload = write_chunk(doc_ids, sizes, ids, percentile)
            row = pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((shard, pa.int32()), (chunk, pa.int32()), (start, pa.int64()), (len(ids), pa.int64()), (payload, pa.binary()))],
                ["shard", "chunk", "start", "n_ids", "payload"],
            )
            start, chunk = start + len(ids), chunk + 1
            doc_ids, sizes, parts, held = [], [], [], 0
            return row

        for batch in slices(batches, "_text", 1 << 20):
            ids, n = encoder.encode(batch.column("_text").to_pylist())
            doc_ids += batch.column("_id").to_pylist()
            sizes += n.tolist()
            parts.append(ids)
            held += len(ids)
            if held >= CHUNK_IDS:
                yield flush()
        if doc_ids:
            yield flush()

    return rows


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, percentile: float = 90
) -> None:
    """Encode every text, append ``end_id`` and write the chunks under ``path``, in ascending order of id.

    Null and empty texts are the end id alone. A null id counts as the least;
    rows that share an id follow in the order of their texts, repeated rows are
    kept. Extra columns are not looked at, whatever their names. An empty table
    writes no chunk.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    order = [F.col("_id"), F.xxhash64("_text")]
    dealt = rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_encode(vocabulary, end_id, percentile), CHUNKS).write.parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            shard, start, payload = batch.column("shard")[k].as_py(), batch.column("start")[k].as_py(), batch.column("payload")[k].as_py()
            doc_ids, sizes, ids = read_chunk(payload)
            ends = np.cumsum(sizes, dtype=np.int64)
            if not len(doc_ids):
                continue
            offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64).tobytes())
            tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc_ids), [None, offsets, pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc_ids), shard), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes + start), tokens.cast(pa.binary())],
                ["shard", "_id", "begin", "tokens"],
            )


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, tokens): tokens are little-endian unsigned 32-bit ids with the end id.

    ``start`` counts the ids of all documents before. Shards are few (one per
    task that wrote); only their totals are summed in one task and
    sent to all.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    rows = chunks.select("shard", "start", "payload").mapInArrow(_decode, "shard int, _id long, begin long, tokens binary")
    return rows.join(F.broadcast(shards), "shard").select(
        back_id().alias(id_col), (F.col("before") + F.col("begin")).alias("start"),
        (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), "tokens",
    )
