"""Byte-level BPE over a global shuffle of distinct words (operator 3).

1. Texts are cut into pre-tokens.  A task collects them block by block: the
   distinct pre-tokens of the block, numbered by frequency, and the numbers in
   the order of its documents (the positions, pre-aggregated).
2. The blocks' words meet by value: those of a block that hash to one bucket
   travel in one packed row, all rows of a bucket land in one task, and each
   distinct word is merged once.
3. The ids go back to their block, where the sequences are reassembled by
   position; decoding looks each id up in the table of token bytes.

A word that every document holds costs one entry per block, so no key is hot.
A block holds about ``BLOCK_TOKENS`` pre-tokens, or one document if that is
larger.  The rank file (a vocabulary, fixed in size) is read by the driver and
broadcast.

Texts are cut twice, once for the words and once for the sequences, so that
sequences, the larger part, cross the network once.  Blocks are named by a
digest of their documents: should the second reading meet rows in another order
than the first, a block lacks its words and the job fails instead of giving
wrong ids.  Input that is not a stored table is therefore stored first.

Defined results: null text is the empty text (no tokens); null ids and repeated
rows are carried along; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged
from .common import PACKED, bucket_count, packed_rows, squeeze, unsqueeze, whole_text

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens in a block.
BLOCK_TOKENS = 4_000_000
#: Pre-tokens in one row of sequences, or one document's.
CHUNK_TOKENS = 500_000
#: Words up to this length are merged by scanning, longer ones with a heap.
SHORT = 64
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always joins the leftmost pair of lowest rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    joins = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
    while joins:
        best = min(joins)
        if best == NEVER:
            break
        i = joins.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joins[i]
        if i:
            joins[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        if i < len(joins):
            joins[i] = get(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    start_to_end = list(range(1, n + 1))  # 0 once swallowed
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(word[i : start_to_end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, start_to_end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not start_to_end[i] or j >= n or start_to_end[j] != end or start_to_end[i] != j:
            continue
        start_to_end[i], start_to_end[j] = end, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : start_to_end[i]]])
        i = after[i]
    return out


def _pack(ids: list, lengths: list[int], numbers: np.ndarray) -> bytes:
    """Documents of a chunk and the numbers of their words, byte planes apart so that they compress."""
    nulls = np.array([x is None for x in ids], np.uint8)
    own = np.array([0 if x is None else x for x in ids], "<i8")
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return squeeze([own, np.array(lengths, "<i8"), nulls, planes])


def _unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    own, lengths, nulls, planes = unsqueeze(data, ("<i8", "<i8", np.uint8, np.uint8))
    numbers = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)
    return [None if gone else int(x) for x, gone in zip(own, nulls)], lengths, numbers


class _Block:
    """Documents cut so far: their words, and each document's sequence of word numbers."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.ids: list = []
        self.numbers: list[np.ndarray] = []
        self.held = 0
        self.digest = xxhash.xxh64()

    def add(self, own, text: str, tokens: list[str]) -> None:
        number, words = self.words.setdefault, self.words
        self.ids.append(own)
        self.numbers.append(np.fromiter((number(t, len(words)) for t in tokens), np.uint32, len(tokens)))
        self.held += len(tokens)
        self.digest.update(f"{own}:{len(text)}:".encode())
        self.digest.update(text.encode())

    def ranked(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Name, all numbers, words by falling frequency, and each word's place in that order."""
        every = np.concatenate(self.numbers)
        order = np.argsort(-np.bincount(every, minlength=len(self.words)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return self.digest.intdigest() - 2**63, every, order, place

    def sequences(self, _) -> Iterator[pa.RecordBatch]:
        name, every, _, place = self.ranked()
        at, size, start, chunk = 0, 0, 0, 0
        for k, one in enumerate(self.numbers):
            size += len(one)
            if size >= CHUNK_TOKENS or k == len(self.numbers) - 1:
                lengths = [len(x) for x in self.numbers[at : k + 1]]
                chunk -= 1
                yield packed_rows(name, [chunk], [_pack(self.ids[at : k + 1], lengths, place[every[start : start + size]])])
                at, start, size = k + 1, start + size, 0

    def vocabulary(self, buckets: int) -> Iterator[pa.RecordBatch]:
        name, _, order, _ = self.ranked()
        listed = [w.encode() for w in self.words]
        listed = [listed[i] for i in order.tolist()]
        home = np.fromiter((zlib.crc32(w) % buckets for w in listed), np.int64, len(listed))
        sizes = np.fromiter(map(len, listed), np.uint32, len(listed))
        by_bucket = np.argsort(home, kind="stable")
        edges = np.flatnonzero(np.diff(home[by_bucket], prepend=-1))
        out, where = [], []
        for places in np.split(by_bucket, edges[1:]) if len(edges) else ():
            gaps = np.diff(places, prepend=0).astype("<u4")
            out.append(squeeze([gaps, sizes[places].astype("<u4"), b"".join([listed[i] for i in places.tolist()])]))
            where.append(int(home[places[0]]))
        yield packed_rows(name, where, out)


def _cutter(pattern: str, block_tokens: int, flush, buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, block = regex.compile(pattern).findall, _Block()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(own, text, find(text))
                if block.held >= block_tokens:
                    yield from flush(block, buckets)
                    block = _Block()
        if block.ids:
            yield from flush(block, buckets)

    return cut


def _encoder(ranks):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        kind, now, known = _id_type(table), None, {}
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != now:  # rows come by bucket, so no word of the last one comes again
                    now, known = bucket, {}
                gaps, sizes, blob = unsqueeze(data, ("<u4", "<u4", bytes))
                at, ids, counts = 0, [], []
                for size in sizes.tolist():
                    word = blob[at : at + size]
                    at += size
                    got = known.get(word)
                    if got is None:
                        got = known[word] = merge(word, table)
                    ids += got
                    counts.append(len(got))
                out.append(squeeze([gaps, np.array(counts, "<u4"), np.array(ids, kind)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "bucket", "data"])

    return encode


def _id_type(ranks: dict[bytes, int]) -> str:
    return "<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4"


class _Returned:
    """What came back for a block: packed sequences, and ids of words by place."""

    def __init__(self) -> None:
        self.chunks: list[bytes] = []
        self.packed: list[bytes] = []

    def words(self, kind: str) -> list[list[int] | None]:
        """Ids of each word; blocks that are equal have one name and agree here."""
        found: dict[int, list[int]] = {}
        for data in self.packed:
            gaps, counts, ids = unsqueeze(data, ("<u4", "<u4", kind))
            listed, ends = ids.tolist(), np.cumsum(counts).tolist()
            for place, n, end in zip(np.cumsum(gaps.astype(np.int64)).tolist(), counts.tolist(), ends):
                found[place] = listed[end - n : end]
        return [found[i] for i in range(len(found))]


def _finish_digests(block: _Returned, kind: str, token_bytes: list[bytes], token_texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    words = block.words(kind)
    texts = [b" ".join([token_texts[t] for t in ids]) for ids in words]
    decoded = [b"".join([token_bytes[t] for t in ids]) for ids in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for chunk in block.chunks:
        own, lengths, numbers = _unpack(chunk)
        counts, shown, shown_decoded, at = [], [], [], 0
        for length in lengths.tolist():
            part = numbers[at : at + length]
            at += length
            places = part.tolist()
            counts.append(int(sizes[part].sum()))
            shown.append(hashlib.sha256(b" ".join([texts[i] for i in places])).hexdigest())
            shown_decoded.append(hashlib.sha256(b"".join([decoded[i] for i in places])).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int64()), pa.array(counts, pa.int64()), pa.array(shown), pa.array(shown_decoded)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _finish_ids(block: _Returned, kind: str, token_bytes, token_texts) -> Iterator[pa.RecordBatch]:
    words = [np.array(ids, np.int32) for ids in block.words(kind)]
    for chunk in block.chunks:
        own, lengths, numbers = _unpack(chunk)
        at = 0
        for name, length in zip(own, lengths.tolist()):
            places = numbers[at : at + length].tolist()
            at += length
            ids = np.concatenate([words[i] for i in places]) if places else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )


def _assembler(ranks, finish):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        kind, token_bytes = _id_type(table), _token_table(table)
        token_texts = [b"%d" % i for i in range(len(token_bytes))]
        now, block = None, _Returned()
        for batch in batches:
            for name, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if name != now:
                    if now is not None:
                        yield from finish(block, kind, token_bytes, token_texts)
                    now, block = name, _Returned()
                (block.packed if bucket >= 0 else block.chunks).append(data)
        if now is not None:
            yield from finish(block, kind, token_bytes, token_texts)

    return assemble


def _token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """Token bytes by id; ids that no token has are empty."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _encoded(docs: DataFrame, ranks_path: str | None, pattern: str, block_tokens: int, stored: bool, finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path or public_tokenizers.path(RANKS)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    if not stored:
        texts = staged(texts)
    buckets = bucket_count(spark)
    words = texts.mapInArrow(_cutter(pattern, block_tokens, _Block.vocabulary, buckets), PACKED)
    merged = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoder(ranks), PACKED)
    sequences = texts.mapInArrow(_cutter(pattern, block_tokens, _Block.sequences, buckets), PACKED)
    home = merged.unionAll(sequences).repartition("block").sortWithinPartitions("block")
    return home.mapInArrow(_assembler(ranks, finish), schema)


def encode_digests(
    docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN,
    block_tokens: int = BLOCK_TOKENS, stored: bool = False,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded again, and digested.

    ``stored``: ``docs`` is read from files as it is, so that reading it again gives the same rows in the same order.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, ranks_path, pattern, block_tokens, stored, _finish_digests, schema)


def encode(
    docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN,
    block_tokens: int = BLOCK_TOKENS, stored: bool = False,
) -> DataFrame:
    """(doc_id, ids): the ids of every text."""
    return _encoded(docs, ranks_path, pattern, block_tokens, stored, _finish_ids, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, data): the bytes of (doc_id, ids), looked up in the table of token bytes."""
    spark: SparkSession = encoded.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path or public_tokenizers.path(RANKS)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = _token_table(ranks.value)
        for batch in batches:
            data = [b"".join([token_bytes[t] for t in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(look_up, "doc_id long, data binary")
