"""Packing along a space-filling curve.

A document's hashed word vector is projected to a few dimensions; the cell
that it falls in has a place on the Hilbert curve. Documents are range-sorted
by that place, so every task holds a stretch of the curve, and packed in this
order into sequences of a fixed number of tokens.

Only texts move, once. The bounds between tasks come from the keys of a bounded
sample of documents (SAMPLE_EACH for each task, SAMPLE_MOST in all); they decide
where a document is packed, never whether. Every key is computed once, before
the exchange; the tokenizer runs after it, once for each document, and a task
holds one open sequence. The last, incomplete sequence of a task is cut into
sequences whose lengths are powers of two, which need no padding.

Ids are those that the tokenizers library gives by default: the strings of added
tokens in a text are these tokens.

Defined results: a null or empty text is the end token alone. Very long texts
are packed whole, over as many sequences as they need. Equal rows are packed as
often as they occur. An empty table gives an empty result. Null ids stay null.
Other columns, of any name, are not looked at. The key ends in a hash of id and
text, so that a large group of copies is dealt to many tasks.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MAX_TOKENS = 2048
END = 1
#: Dimensions of the projection and bits of each one's cell.
DIMS, BITS = 4, 8
#: Hash buckets of the word vector.
BUCKETS = 1 << 14
#: Bits of the tie in a key, below those of the place on the curve.
TIE_BITS = 63 - DIMS * BITS
#: Documents sampled for the bounds between tasks, for each task and in all.
SAMPLE_EACH, SAMPLE_MOST = 50, 1_000_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n x dims, values under
    2**bits), by the transposed Gray code of Skilling (2004)."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(dims):
            high = (x[i] & np.uint64(q)) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


def projection(seed: int, dims: int = DIMS) -> np.ndarray:
    """Random directions of the hash buckets; signs and sizes from one seed."""
    return np.random.default_rng(seed).standard_normal((BUCKETS, dims)).astype(np.float32)


def cells_of(text: str, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The cell of a text. A sum of n random directions has size sqrt(n), which
    is divided out; the normal distribution function spreads the rest evenly
    (here its logistic approximation)."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.full(table.shape[1], 1 << (bits - 1), dtype=np.int64)
    h = np.fromiter(map(zlib.crc32, found), dtype=np.uint32, count=len(found))
    z = table[h & np.uint32(BUCKETS - 1)].sum(0, dtype=np.float64) / np.sqrt(len(found))
    even = 1 / (1 + np.exp(-np.clip(1.702 * z, -30, 30)))
    return np.minimum((even * (1 << bits)).astype(np.int64), (1 << bits) - 1)


def curve_key(text: Column, tie: Column, seed: int = 42, bounds: np.ndarray | None = None) -> Column:
    """key: the Hilbert place of a text and then a part of the tie; part: the
    number of bounds up to it."""

    @F.pandas_udf("key long, part int")
    def key(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = projection(seed)
        for texts, ties in batches:
            cells = np.array([cells_of(t, table) for t in texts], dtype=np.int64).reshape(-1, DIMS)
            low = ties.to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(64 - TIE_BITS)
            keys = (hilbert_index(cells, BITS) << TIE_BITS) | low.astype(np.int64)
            part = np.zeros(len(keys), np.int32) if bounds is None else np.searchsorted(bounds, keys, side="right").astype(np.int32)
            yield pd.DataFrame({"key": keys, "part": part})

    return key(text, tie)


def bounds_of(docs: DataFrame, seed: int, parts: int) -> np.ndarray:
    """Keys that divide docs (text, tie) into about equal parts, from a sample."""
    n = docs.count()
    wanted = min(SAMPLE_EACH * parts, SAMPLE_MOST)
    some = docs.sample(min(1.0, wanted / max(n, 1)), seed) if n > wanted else docs
    keys = np.sort(some.select(curve_key(F.col("text"), F.col("tie"), seed)["key"].alias("key")).toPandas()["key"].to_numpy(dtype=np.int64))
    return keys[np.arange(1, parts) * len(keys) // parts] if len(keys) else keys


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: the
    printable Latin-1 ones as themselves, the others, in order, from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextTokenizer:
    """Ids of a tokenizers file: no special tokens are added, and the strings of
    added tokens in a text are these tokens, as is the library's default. A
    byte-level file whose ids follow its merges is run by tiktoken, which gives
    the same ids several times faster; any other file by its own library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.encode = self._ranked(spec)
        self.ranked = self.encode is not None
        if not self.ranked:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(json.dumps(spec))
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranked(spec: dict):
        model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        added = spec.get("added_tokens") or []
        special = {t["content"]: t["id"] for t in added}
        if any(not t.get("special") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            return None
        if "" in special or any(x != y and y.startswith(x) for x in special for y in special):
            return None
        letters = byte_letters()
        try:
            ranks = {bytes(letters[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
            merged = [b"".join(bytes(letters[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        except KeyError:
            return None
        if [ranks.get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        import public_tokenizers
        import tiktoken

        own = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: own.encode(text, allowed_special="all") if any(x in text for x in special) else own.encode_ordinary(text)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), dtype=np.uint32)


def worker_tokenizer(path: str) -> TextTokenizer:
    """One for each worker process, which outlives its tasks."""
    kept = sys.__dict__.setdefault("_tidemark_tokenizers", {})
    if path not in kept:
        kept[path] = TextTokenizer(path)
    return kept[path]


def cut_sequences(docs: Iterable[tuple], max_tokens: int, base: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, crc, tokens, sequence, offset, ids) of
    documents (doc_id, ids), laid one after another."""
    sequence, fill, open_pieces = base, 0, []
    for doc_id, ids in docs:
        start, n = 0, len(ids)
        while start < n:
            take = min(max_tokens - fill, n - start)
            open_pieces.append((doc_id, start, ids[start : start + take], n, fill))
            start, fill = start + take, fill + take
            if fill == max_tokens:
                for d, s, part, total, at in open_pieces:
                    yield d, s, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, sequence, at, part
                sequence, fill, open_pieces = sequence + 1, 0, []
    room = at = 0
    for d, s, part, total, _ in open_pieces:
        while len(part):
            if at == room:  # the next power of two in what is left
                sequence, room, at = sequence + bool(room), 1 << (fill.bit_length() - 1), 0
                fill -= room
            now = part[: room - at]
            yield d, s, len(now), zlib.crc32(now.astype("<u4").tobytes()), total, sequence, at, now
            part, s, at = part[len(now) :], s + len(now), at + len(now)


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, seed: int = 42, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents (doc_id, text), with their token ids if asked."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType
    schema = PIECES.format(id=kind.simpleString()) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = worker_tokenizer(path)
        out = pa.schema([pa.field("doc_id", arrow_id), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
        end = np.array([END], dtype=np.uint32)

        def tokenized() -> Iterator[tuple]:
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    yield i, np.concatenate([own.ids(s), end]) if (s := t.as_py()) else end

        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, out, strict=False)], schema=out)

        for piece in cut_sequences(tokenized(), max_tokens, TaskContext.get().partitionId() << 33):
            rows.append(piece)
            if len(rows) == 4096:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(kind)
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("tie", F.xxhash64("doc_id", "text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = curve_key(F.col("text"), F.col("tie"), seed, bounds_of(texts.select("text", "tie"), seed, parts))
    keyed = texts.withColumn("at", place).select("doc_id", "text", "tie", "at.key", "at.part")
    return keyed.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "tie", "doc_id", "text").select("doc_id", "text").mapInArrow(run, schema)
