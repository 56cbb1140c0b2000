"""Byte-level BPE encoding and decoding by a given table of ranks.

Texts are cut into pre-tokens.  A pack of documents keeps the codes of its pre-tokens in
order and sends out each distinct one once; all packs' words meet in one shuffle, where
every distinct word is encoded once; the ids go back to the packs, which put them in place
of the codes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Mapping
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern that cuts a text before the merges.
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
# Text of a pack in characters, beyond which it is closed: bounds what a task holds.
PACK_CHARS = 12_000_000
# Buckets of words at most, and so blocks of a pack, however many partitions there are.
BUCKETS = 4096
# How hard blocks are squeezed: the codes go through two shuffles.
SQUEEZE = 5
# Words longer than this are merged with a heap.
SHORT_WORD = 48
OUT_ROWS = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids from a file of base64 tokens and ranks, one pair a line.

    The table has as many rows as the vocabulary, whatever the corpus.
    """
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def encode_word(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one pre-token: neighbours of the lowest rank merge first, the left one of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT_WORD:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, rank in enumerate(pairs):
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])


def _encode_long(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """The same with a linked list and a heap of pairs, so that length costs n log n."""
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: merged away
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte planes apart so that they compress well."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=SQUEEZE).compress(planes)


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


class _Pack:
    """Documents of one task, cut into pre-tokens; distinct ones have codes."""

    def __init__(self, place: tuple[int, int]) -> None:
        self.place = place
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.chars = 0

    def add(self, row_id: int | None, text: str | None, pattern: regex.Pattern) -> None:
        text, known = text or "", self.known
        found = [known.setdefault(w, len(known)) for w in pattern.findall(text)]
        self.rows.append(np.array(found, np.uint32))
        self.ids.append(row_id)
        self.chars += len(text) + 64

    def closed(self) -> _Pack:
        """Number the words anew, frequent ones first, and name the pack after them.

        The name has the place in the table, so equal packs differ, and the words, so that
        words and codes of different readings of a changing table (a task that is run again)
        can never be mixed up.
        """
        flat = np.concatenate(self.rows)
        counts = np.bincount(flat, minlength=len(self.known))
        order = np.argsort(-counts, kind="stable")
        code = np.empty(len(order), np.uint32)
        code[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.known)
        self.words = [words[i].encode() for i in order]
        self.codes = code[flat] if len(flat) else flat
        name = blake2b(np.array(self.place, np.int64).tobytes(), digest_size=8)
        name.update(b"\x00".join(self.words))
        self.name = int(np.frombuffer(name.digest(), np.int64)[0])
        self.sizes = np.array([len(r) for r in self.rows], np.int64)
        self.known, self.rows = {}, []
        return self

    def buckets(self, n: int) -> np.ndarray:
        """Where each word goes, by code."""
        return np.array([crc32(w) % n for w in self.words], np.int64)


def _packs(batches: Iterator[pa.RecordBatch], pack_chars: int) -> Iterator[_Pack]:
    pattern = regex.compile(PATTERN)
    part, n = TaskContext.get().partitionId(), 0
    pack = _Pack((part, n))
    for batch in batches:
        for row_id, text in zip(batch.column(0), batch.column(1)):
            pack.add(row_id.as_py(), text.as_py(), pattern)
            if pack.chars >= pack_chars:
                yield pack.closed()
                n += 1
                pack = _Pack((part, n))
        pa.default_memory_pool().release_unused()
    if pack.ids:
        yield pack.closed()


def _send(batches: Iterator[pa.RecordBatch], pack_chars: int, n: int) -> Iterator[pa.RecordBatch]:
    """For each pack a row with its documents' ids and sizes, its words' buckets and the codes,
    and a block for each bucket that it has words of: their lengths and their bytes."""
    for pack in _packs(batches, pack_chars):
        bucket = pack.buckets(n)
        row_ids = pa.array(pack.ids, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([pack.name % n], pa.int32()),
                pa.array([pack.name], pa.int64()),
                pa.array([-1], pa.int32()),
                pa.array([_packed(pack.codes)], pa.binary()),
                pa.array([_packed(bucket)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(row_ids)], pa.int32()), row_ids),
                pa.array([pack.sizes], pa.list_(pa.int64())),
            ],
            names=_SENT,
        )
        order = np.argsort(bucket, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(bucket, minlength=n)))
        squeeze = zstandard.ZstdCompressor(level=SQUEEZE)
        names, blocks = [], []
        for b in np.flatnonzero(np.diff(ends)).tolist():
            words = [pack.words[i] for i in order[ends[b] : ends[b + 1]].tolist()]
            sizes = np.array([len(w) for w in words], "<u4")
            head = np.array([len(words)], "<u4").tobytes() + sizes.tobytes()
            names.append(b)
            blocks.append(squeeze.compress(head + b"".join(words)))
        for at in range(0, len(names), 256):
            part = names[at : at + 256]
            yield _block_rows(
                pa.array([pack.name] * len(part), pa.int64()),
                pa.array(part, pa.int32()),
                pa.array(blocks[at : at + 256], pa.binary()),
            )


_SENT = ["_to", "_pack", "_bucket", "_block", "_buckets", "_rows", "_sizes"]
_SENT_TYPES = "_to int, _pack long, _bucket int, _block binary, _buckets binary, _rows array<long>, _sizes array<long>"


def _block_rows(pack: pa.Array, bucket: pa.Array, block: pa.Array) -> pa.RecordBatch:
    lists = pa.nulls(len(pack), pa.list_(pa.int64()))
    rest = [pa.nulls(len(pack), pa.binary()), lists, lists]
    return pa.RecordBatch.from_arrays([bucket, pack, bucket, block, *rest], names=_SENT)


def _encode_words(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    """Blocks of words, sorted by bucket, to blocks of ids; each distinct word once.

    The packs' own rows, which come first, go through as they are.
    """
    table, bucket, known = ranks.value, None, {}
    open_up = zstandard.ZstdDecompressor()
    for batch in batches:
        own = int(np.searchsorted(batch.column("_bucket").to_numpy(), 0))
        if own:
            yield batch.slice(0, own)
            batch = batch.slice(own)
        out = []
        for b, block in zip(batch.column("_bucket").to_pylist(), batch.column("_block")):
            if b != bucket:
                bucket, known = b, {}
            data = open_up.decompress(block.as_py())
            n = int(np.frombuffer(data, "<u4", 1)[0])
            ends = 4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4).astype(np.int64))
            ids, at = [], 4 + 4 * n
            for end in ends.tolist():
                word, at = data[at:end], end
                found = known.get(word)
                if found is None:
                    found = known[word] = np.array(encode_word(word, table), "<u4")
                ids.append(found)
            sizes = np.array([n, *map(len, ids)], "<u4")
            out.append(_packed(np.concatenate([sizes, *ids])))
        if out:
            yield _block_rows(batch.column("_pack"), batch.column("_bucket"), pa.array(out, pa.binary()))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pack and bucket, its codes first, to documents."""
    head, blocks = None, []
    for batch in batches:
        for i, b in enumerate(batch.column("_bucket").to_pylist()):
            if b < 0:
                yield from _unpack(head, blocks)
                head, blocks = {n: batch.column(n)[i] for n in batch.schema.names}, []
            elif head is None or head["_pack"].as_py() != batch.column("_pack")[i].as_py():
                raise ValueError("the table gave other rows when it was read again; write it first")
            else:
                blocks.append((b, batch.column("_block")[i].as_py()))
    yield from _unpack(head, blocks)


def _unpack(head: dict | None, blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if head is None:
        return
    codes, bucket = _numbers(head["_block"].as_py()), _numbers(head["_buckets"].as_py())
    words = np.empty(len(bucket), object)
    seen = 0
    by_bucket = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[by_bucket], [b for b, _ in blocks])
    for (b, block), start in zip(blocks, starts.tolist()):
        numbers = _numbers(block)
        n = int(numbers[0])
        ends = 1 + n + np.cumsum(numbers[1 : n + 1].astype(np.int64))
        first = ends - numbers[1 : n + 1]
        raw = numbers.tobytes()
        for code, lo, hi in zip(by_bucket[start : start + n].tolist(), first.tolist(), ends.tolist()):
            words[code] = raw[4 * lo : 4 * hi]
        seen += n
    if seen != len(words):
        raise ValueError("the table gave other rows when it was read again; write it first")
    rows = head["_rows"].values
    ends = np.append(0, np.cumsum(_values(head["_sizes"])))
    for at in range(0, len(rows), OUT_ROWS):
        to = min(at + OUT_ROWS, len(rows))
        flat = [b"".join(words[codes[ends[i] : ends[i + 1]]].tolist()) for i in range(at, to)]
        bounds = np.append(0, np.cumsum([len(f) // 4 for f in flat])).astype(np.int32)
        tokens = pa.array(np.frombuffer(b"".join(flat), "<i4"))
        yield pa.RecordBatch.from_arrays(
            [rows.slice(at, to - at), pa.ListArray.from_arrays(pa.array(bounds), tokens)],
            names=["_row", "ids"],
        )


def _gathered(
    docs: DataFrame,
    ranks: Mapping[bytes, int],
    id_col: str,
    text_col: str,
    pack_chars: int,
) -> DataFrame:
    """Each pack's codes and its words' ids, sorted by pack, the codes first."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(dict(ranks))  # as large as the vocabulary, no more
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(parts, BUCKETS)
    found = (
        rows.mapInArrow(lambda batches: _send(batches, pack_chars, n), _SENT_TYPES)
        .repartition(parts, "_to")
        .sortWithinPartitions("_bucket")
        .mapInArrow(lambda batches: _encode_words(batches, sent), _SENT_TYPES)
    )
    return found.repartition(parts, "_pack").sortWithinPartitions("_pack", "_bucket")


def encode(
    docs: DataFrame,
    ranks: Mapping[bytes, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    pack_chars: int = PACK_CHARS,
) -> DataFrame:
    """Per row: the id (a long) and ``ids``, the token ids of the text.

    Null and empty texts have no tokens; a null id stays null; rows that repeat stay, each
    on its own; other columns are not looked at.  No special tokens.

    Texts are read and cut into words once.  What is shuffled is every pack's distinct words,
    there and back in blocks, and with both the codes of its documents, compressed.  A word
    that all documents have is one entry per pack.  A task holds one pack, which has
    ``pack_chars`` characters or is one document, or the distinct words of one bucket.  A task
    that is run again has to find the same rows, as it does in files; if it doesn't, the job
    fails rather than mix them up.
    """
    home = _gathered(docs, ranks, id_col, text_col, pack_chars)
    return home.mapInArrow(_assemble, "_row long, ids array<int>").withColumnRenamed("_row", id_col)


def _decoded(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """The id, the ids, their little-endian bytes, and the bytes each id stands for."""
    bytes_of, ends = table.value
    for whole in batches:
        for start in range(0, whole.num_rows, OUT_ROWS):
            batch = whole.slice(start, OUT_ROWS)
            raw, out = [], []
            for ids in batch.column("ids"):
                at = _values(ids)
                sizes = ends[at + 1] - ends[at]
                first = np.cumsum(sizes) - sizes
                take = np.arange(int(sizes.sum())) + np.repeat(ends[at] - first, sizes)
                out.append(bytes_of[take].tobytes())
                raw.append(at.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary()), pa.array(out, pa.binary())],
                names=[*batch.schema.names, "id_bytes", "decoded"],
            )
        pa.default_memory_pool().release_unused()


def _values(ids: pa.ListScalar) -> np.ndarray:
    if not ids.is_valid or not len(ids.values):
        return np.zeros(0, np.int64)
    return ids.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _sent_tokens(spark: SparkSession, ranks: Mapping[bytes, int]):
    """The token-byte table, with a row per id of the vocabulary, for every task."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    ends = np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int64)
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(tokens), np.uint8), ends))


_DECODED = "_row long, ids array<int>, id_bytes binary, decoded binary"


def decode(encoded: DataFrame, ranks: Mapping[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """The id, ``ids``, ``id_bytes`` (little-endian, 32 bits each) and ``decoded``, the bytes
    the ids stand for.

    Every task has the token-byte table, so the join needs no shuffle.  Null ids decode to
    nothing.
    """
    sent = _sent_tokens(encoded.sparkSession, ranks)
    rows = encoded.select(F.col(id_col).cast("long").alias("_row"), "ids")
    out = rows.mapInArrow(lambda batches: _decoded(batches, sent), _DECODED)
    return out.withColumnRenamed("_row", id_col)


def round_trip(
    docs: DataFrame,
    ranks: Mapping[bytes, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    pack_chars: int = PACK_CHARS,
) -> DataFrame:
    """``decode(encode(docs))``, both in the same tasks: one Python process instead of two."""
    sent = _sent_tokens(docs.sparkSession, ranks)
    home = _gathered(docs, ranks, id_col, text_col, pack_chars)
    out = home.mapInArrow(lambda batches: _decoded(_assemble(batches), sent), _DECODED)
    return out.withColumnRenamed("_row", id_col)


def token_digests(decoded: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens`` and the SHA-256 of the ids and of the bytes."""
    return decoded.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2("id_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *["ids"] * keep_ids,
    )
