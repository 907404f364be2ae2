"""BPE encoding over a distinct-word table, and decoding through an id-to-piece table.

Documents are split into pre-tokens block by block (a block is a run of rows of one input
partition).  A block keeps its documents as word numbers and lists each of its distinct words
once; the lists are dealt out by word hash, so that each distinct word of the corpus is encoded by
exactly one task, once.  The ids go back to the blocks by position and replace the word numbers.
What moves is a compressed list of distinct words per block and the word numbers, not the text.

Tokenizers are read from a file and never trained.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, shuffle_parts, trim, trimmed

#: Fixed value: the pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A block is closed once it holds so many code points; its words and numbers fit a task's memory.
BLOCK_CHARS = 24_000_000
#: Word numbers in one shuffled row.
CHUNK_WORDS = 300_000
#: Bytes of text to a bucket at most; its blocks list about an eighth of it as distinct words.
BUCKET_BYTES = 128_000_000
#: A longer text is split into words piece by piece.
PIECE_CHARS = 1_000_000


class ByteBpe:
    """The parts of a tokenizer file that the operators need.  Only byte-level BPE without a normaliser is taken."""

    def __init__(self, path: str, odd: str | None = None) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a byte-level BPE file without prefix space and normaliser")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or match whole words aren't supported")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.words = regex.compile(PRETOKEN)
        self.cut_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.odd_ranges = disagreeing(self.tok) if odd is None else odd
        self.odd = regex.compile(f"[{self.odd_ranges}]") if self.odd_ranges else None
        least = int(self.odd_ranges[2:10], 16) if self.odd_ranges else 0x110000
        #: rules out most texts quickly
        self.high = re.compile(f"[\\U{least:08x}-\\U0010ffff]") if self.odd_ranges else None
        self.between = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")

    def split(self, text: str):
        """Lists of pre-tokens, together those of ``text``; each pre-token encodes alone as it does in place."""
        slow = not text.isascii() and self.high is not None and self.high.search(text) and self.odd.search(text)
        if self.cut_added is None or not any(x in text for x in self.added):
            yield from self._plain(text, slow)
            return
        for k, part in enumerate(self.cut_added.split(text)):
            if k % 2:
                yield [part]
            else:
                yield from self._plain(part, slow)

    def _plain(self, text: str, slow) -> list[list[str]]:
        """Pre-tokens of a text without added tokens; ``slow``: it has code points that the two Unicode tables class differently."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE_CHARS and (m := self.between.search(text, at + PIECE_CHARS)):
                end = m.start()  # a letter, then a space before a letter: always a boundary
            part = text[at:end]
            yield [part[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(part)] if slow else self.words.findall(part)
            at = end

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)]

    def pieces(self) -> pa.Array:
        """Bytes of each id, in order; an id that is not taken gives no bytes."""
        back = byte_of_char()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        out: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            out[i] = piece.encode() if piece in self.added else bytes(back[c] for c in piece)
        return pa.array(out, pa.large_binary())


def byte_of_char() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def disagreeing(tok) -> str:
    """Ranges, as the inside of a character class, that the tokenizer's pattern engine and this one class differently.

    The two follow different versions of Unicode.  Both split a probe with every code point of the
    planes that hold letters, between letters and between digits; the planes above hold none.
    """
    ours, bad = regex.compile(PRETOKEN), np.zeros(0x110000, bool)
    for lo, hi in ((0, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000)):
        for around in "a1":
            probe = "".join(f"{around}{chr(c)}{around} " for c in range(lo, hi))
            marks = np.zeros((2, len(probe) + 1), bool)
            marks[0, [m.start() for m in ours.finditer(probe)]] = True
            marks[1, [s for _, (s, _) in tok.pre_tokenizer.pre_tokenize_str(probe)]] = True
            bad[lo + np.flatnonzero(marks[0] != marks[1]) // 4] = True
    at = np.flatnonzero(bad)
    first = at[np.diff(at, prepend=-9) > 1]
    last = at[np.diff(at, append=0x200000) > 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True))


@lru_cache(maxsize=4)
def load(path: str, odd: str | None = None) -> ByteBpe:
    """The tokenizer of a process; ``odd``: what :func:`disagreeing` found, where that is known."""
    return ByteBpe(path, odd)


def bucket_of(words: list[str], n: int) -> np.ndarray:
    """A stable bucket of each word."""
    crc = zlib.crc32
    return np.fromiter((crc(w.encode()) for w in words), np.uint32, len(words)) % np.uint32(n)


#: Numbers under ONE take a byte; of others the first byte holds what lies above SHIFT bits, up to 30.
ONE, SHIFT = 224, 14


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes: small ones in the first alone, so that numbers by frequency cost little more than their entropy."""
    v = values.astype(np.uint32, copy=False)
    top = v >> np.uint32(SHIFT)
    first = np.where(v < ONE, v, ONE + np.minimum(31, top)).astype(np.uint8)
    large = v[v >= ONE]
    huge = (large >> np.uint32(SHIFT))[large >> np.uint32(SHIFT) >= 31]
    codec = pa.Codec("zstd", compression_level=3)
    planes = (first, (large & 0xFF).astype(np.uint8), (large >> 8 & 0x3F).astype(np.uint8), huge.astype("<u4"))
    blobs = [codec.compress(x.tobytes(), asbytes=True) if x.size else b"" for x in planes]
    return np.array([len(x) for x in blobs] + [len(large), len(huge)], "<u4").tobytes() + b"".join(blobs)


def unpack(blob: bytes, n: int) -> np.ndarray:
    head = np.frombuffer(blob, "<u4", 6)
    codec, at, planes = pa.Codec("zstd"), 24, []
    for size, items, kind in zip(head[:4].tolist(), (n, int(head[4]), int(head[4]), int(head[5])), (np.uint8, np.uint8, np.uint8, "<u4"), strict=True):
        raw = codec.decompress(blob[at : at + size], items * np.dtype(kind).itemsize, asbytes=True) if items else b""
        planes.append(np.frombuffer(raw, kind).astype(np.uint32))
        at += size
    out, low, high, huge = planes
    big = out >= ONE
    top = out[big] - np.uint32(ONE)
    top[top == 31] = huge
    out[big] = top << np.uint32(SHIFT) | high << np.uint32(8) | low
    return out


class Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Blocks:
    """Splits the rows of one partition into blocks of (keys, word counts, word numbers by frequency, words in bucket order, their buckets and numbers)."""

    def __init__(self, path: str, odd: str, buckets: int) -> None:
        self.path, self.odd, self.buckets = path, odd, buckets

    def __call__(self, batches):
        bpe, n, chars = load(self.path, self.odd), 0, 0
        keys, counts, seen, runs = [], [], Numbers(), []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                total = 0
                for words in bpe.split(text):
                    total += len(words)
                    runs.append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                keys.append(key.as_py())
                counts.append(total)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield n, *self.closed(keys, counts, seen, runs)
                    n, chars, keys, counts, seen, runs = n + 1, 0, [], [], Numbers(), []
        if keys:
            yield n, *self.closed(keys, counts, seen, runs)

    def closed(self, keys, counts, seen, runs):
        words = sorted(seen)
        at = bucket_of(words, self.buckets)
        order = np.argsort(at, kind="stable")
        number = np.fromiter(map(seen.__getitem__, words), np.uint32, len(words))[order]
        flat = np.concatenate(runs) if runs else np.zeros(0, np.uint32)
        runs.clear()
        often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[often] = np.arange(len(words), dtype=np.uint32)
        return keys, np.array(counts, np.int64), rank[flat], [words[i] for i in order], at[order], rank[number]


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets of words by the corpus's size: the lists of distinct words of all blocks in one bucket fit a task's memory."""
    held = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(2 * shuffle_parts(docs.sparkSession), -(-held // BUCKET_BYTES))


def _block_name(k: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 20) | k


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, n_tokens, ids) per row of ``docs``; ``ids`` holds unsigned 32-bit integers, little-endian.

    The ids are those that the tokenizers library gives with ``add_special_tokens=False``; an added
    token's string in a text becomes its id.  Null and empty texts give no ids.  Rows are kept as
    they are: repeated rows and null or repeated keys each give a row.  No rows: an empty frame.
    Columns besides the two are not read.  A text of any length is encoded whole; a block holds at
    least one text, so memory follows the longest one.

    The split texts are written to the shared folder as word numbers and word lists, so every block
    is made once, whatever happens to the executors.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    two = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    n = buckets or bucket_count(two)
    odd = load(tokenizer).odd_ranges
    kind = two.schema["key"].dataType.simpleString()
    two_key = to_arrow_type(two.schema["key"].dataType)
    made = pa.schema([
        ("block", pa.int64()), ("bucket", pa.int32()), ("size", pa.int64()), ("words", pa.binary()),
        ("keys", pa.list_(two_key)), ("counts", pa.list_(pa.int64())), ("distinct", pa.int64()), ("numbers", pa.binary()),
    ])

    def row(**x):
        return pa.RecordBatch.from_pydict({f.name: pa.array([x.get(f.name)], f.type) for f in made}, schema=made)

    def split(batches):
        """A block as rows of words (one a bucket), of word numbers, and one (bucket -1) with the numbers of the words in bucket order."""
        for k, keys, counts, numbers, words, at, number in Blocks(tokenizer, odd, n)(batches):
            name = _block_name(k)
            edges = np.searchsorted(at, np.arange(n + 1))
            for b in range(n):
                if edges[b] < edges[b + 1]:
                    raw = "\0".join(w.replace("\1", "\1\1").replace("\0", "\1\2") for w in words[edges[b] : edges[b + 1]]).encode()
                    yield row(block=name, bucket=b, size=len(raw), words=pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True))
            distinct = len(words)
            del words
            yield row(block=name, bucket=-1, distinct=distinct, numbers=pack(number))
            ends, a = np.cumsum(counts), 0
            while a < len(keys):
                lo = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, lo + CHUNK_WORDS, "right")))
                yield row(block=name, bucket=a, keys=keys[a:b], counts=counts[a:b].tolist(), distinct=distinct, numbers=pack(numbers[lo : ends[b - 1]]))
                a = b

    def encoded(table: pa.Table) -> pa.Table:
        """The words of one bucket, from all blocks; each distinct one is encoded once."""
        bpe = load(tokenizer, odd)
        place, lists = Numbers(), []
        for raw, size in zip(table["words"].to_pylist(), table["size"].to_pylist(), strict=True):
            own = pa.decompress(raw, size, "zstd", asbytes=True).decode().split("\0")
            lists.append(np.fromiter(map(place.__getitem__, own), np.int64, len(own)))
        words, width, parts = list(place), [], []
        del place
        for lo in range(0, len(words), 20_000):
            ids = bpe.encode([re.sub("\1([\1\2])", lambda m: "\0" if m[1] == "\2" else "\1", w) if "\1" in w else w for w in words[lo : lo + 20_000]])
            width.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            parts.append(np.fromiter((i for x in ids for i in x), np.uint32, int(width[-1].sum())))
        width, flat = np.concatenate(width), np.concatenate(parts)
        start = np.cumsum(width) - width
        sizes, blobs, total = [], [], []
        for own in lists:
            w = width[own]
            sizes.append(pack(w))
            blobs.append(pack(flat[spans(start[own], w)]))
            total.append(int(w.sum()))
        del words, parts, flat, start
        trim()
        return pa.table({
            "block": table["block"], "bucket": table["bucket"], "n": pa.array([len(x) for x in lists], pa.int64()), "total": pa.array(total, pa.int64()),
            "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(blobs, pa.binary()),
        })

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of one block: word numbers become ids."""
        trim()
        right = right.sort_by("bucket")
        meta = right.select(["n", "total"]).to_pydict()
        width = np.concatenate([unpack(b, c) for b, c in zip(right["sizes"].to_pylist(), meta["n"], strict=True)] or [np.zeros(0, np.uint32)]).astype(np.int64)
        flat = np.concatenate([unpack(b, c) for b, c in zip(right["ids"].to_pylist(), meta["total"], strict=True)] or [np.zeros(0, np.uint32)])
        del right
        left = left.sort_by("bucket")
        if left["bucket"][0].as_py() != -1 or left["distinct"][0].as_py() != len(width):
            raise ValueError("a block and its words don't belong together")
        number = unpack(left["numbers"][0].as_py(), len(width))
        place = np.empty(len(width), np.int64)
        place[number] = np.arange(len(width))
        start, width = (np.cumsum(width) - width)[place], width[place]
        out_keys, out_n, out_ids = [], [], []
        for k in range(1, left.num_rows):
            counts = np.array(left["counts"][k].as_py(), np.int64)
            numbers = unpack(left["numbers"][k].as_py(), int(counts.sum()))
            w = width[numbers]
            ids = flat[spans(start[numbers], w)].astype("<u4", copy=False)
            ends = np.concatenate([[0], np.cumsum(w)])[np.concatenate([[0], np.cumsum(counts)])]
            out_keys.append(pa.array(left["keys"][k].as_py(), two_key))
            out_n.append(pa.array(np.diff(ends), pa.int64()))
            out_ids.append(pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids)]))
        return pa.table({"key": pa.chunked_array(out_keys, two_key), "n_tokens": pa.chunked_array(out_n, pa.int64()), "ids": pa.chunked_array(out_ids, pa.binary())})

    blocks = cut(
        two.mapInArrow(lambda batches: trimmed(split(batches)), f"block long, bucket int, size long, words binary, keys array<{kind}>, counts array<long>, distinct long, numbers binary"), "bpe-blocks"
    )
    words = blocks.where("words is not null").select("block", "bucket", "size", "words")
    encoded_words = words.groupBy("bucket").applyInArrow(encoded, "block long, bucket int, n long, total long, sizes binary, ids binary")
    numbers = blocks.where("numbers is not null").select("block", "bucket", "keys", "counts", "distinct", "numbers")
    out = numbers.groupBy("block").cogroup(encoded_words.groupBy("block")).applyInArrow(placed, f"key {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("key", key)


def spans(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Positions start[0], start[0]+1, ... for each span in turn."""
    ends = np.cumsum(width)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - width), width) + np.arange(total, dtype=np.int64)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: each id is joined with its piece and the bytes are read as UTF-8.

    The piece table is as large as the vocabulary, whatever the corpus; every task holds it.  Bytes
    that are no UTF-8 become U+FFFD.  Special tokens are kept.  Null ids give null, no ids an empty
    text; an id outside the vocabulary is an error.  A column named ``out`` is replaced; others stay.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    odd = load(tokenizer).odd_ranges
    encoded = encoded.drop(out)
    schema = StructType([*encoded.schema.fields, StructField(out, StringType())])

    def run(batches):
        pieces = load(tokenizer, odd).pieces()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = []
                for blob in part.column(ids):
                    if not blob.is_valid:
                        texts.append(None)
                        continue
                    joined = pieces.take(pa.array(np.frombuffer(blob.as_buffer(), "<u4")))
                    off = np.frombuffer(joined.buffers()[1], np.int64)
                    texts.append(joined.buffers()[2].to_pybytes()[off[joined.offset] : off[joined.offset + len(joined)]].decode("utf-8", "replace") if len(joined) else "")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return encoded.mapInArrow(lambda batches: trimmed(run(batches)), schema)
