"""Token ids of documents in binary files, and their offsets in little space.

A shard holds the ids of its documents one after the other, then the ends of the
documents as an Elias-Fano list: of n increasing values up to u, the low
floor(log2(u / n)) bits are stored as they are, the high parts in unary as one
bit string.  The end of document i is found by select(i) on that string: the
place of every 256th one is stored (the select directory), and from there whole
64-bit words are counted.  That is about 2 + log2(u / n) bits a document.

    shard:  ids, little-endian, 2 or 4 bytes each (2 where the vocabulary allows)
            zero bytes up to a multiple of 8
            lows (uint64 words), highs (uint64 words), directory (uint32 each)
            doc_ids (int64 each), nulls (1 byte each)
            header: magic, width, n documents, n ids, low bits, byte length of each part
            (the header has a fixed size and is the end of the file: shards are written in one pass)

Shards are ranges of doc_id; a table of shards (one row each) has their order
and how many ids come before.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliogable.llm import store

MAGIC = b"HGTOK002"
_HEADER = struct.Struct("<8s4Qq8Q")
SAMPLE = 256
#: A shard ends after so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 20
#: Distinct words whose ids a worker remembers.
REMEMBER = 500_000
STEMS = 600_000
PARTITION_BYTES = 64 << 20
_U = np.uint64


class EliasFano:
    """Increasing whole numbers in near-minimal space, with access by place."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.directory = n, low_bits, lows, highs, directory

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, _U)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        place = np.arange(n, dtype=np.int64) + (values >> _U(low_bits)).astype(np.int64)
        highs = np.zeros((int(place[-1]) // 64 + 1) if n else 0, _U)
        np.bitwise_or.at(highs, place // 64, _U(1) << (place % 64).astype(_U))
        lows = np.zeros(-(-n * low_bits // 64) + 1, _U)
        if low_bits:
            part = values & _U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            shift = (at % 64).astype(_U)
            np.bitwise_or.at(lows, at // 64, part << shift)
            over = (at % 64) + low_bits > 64
            np.bitwise_or.at(lows, at[over] // 64 + 1, part[over] >> (_U(64) - shift[over]))
        return cls(n, low_bits, lows, highs, place[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The place of the one numbered i in the unary part."""
        at = int(self.directory[i // SAMPLE])
        left, word = i % SAMPLE, at // 64
        bits = int(self.highs[word]) >> (at % 64) << (at % 64)
        while (count := bits.bit_count()) <= left:
            left -= count
            word += 1
            bits = int(self.highs[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + ((bits & -bits).bit_length() - 1)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        high, low = self.select(i) - i, 0
        if self.low_bits:
            word, shift = divmod(i * self.low_bits, 64)
            low = (int(self.lows[word]) | int(self.lows[word + 1]) << 64) >> shift & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low


class ShardWriter:
    """One shard, written in one pass: ids as they come, what finds them at the end."""

    def __init__(self, out, width: int):
        self.out, self.type, self.width = out, {2: "<u2", 4: "<u4"}[width], width
        self.docs, self.ends, self.n = [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Ids as little-endian numbers of this shard's width; documents come in ascending order, null first."""
        if self.docs and self.docs[-1] is not None and (doc_id is None or doc_id < self.docs[-1]):
            raise ValueError("documents out of order")
        self.out.write(ids)
        self.n += len(ids) // self.width
        self.docs.append(doc_id)
        self.ends.append(self.n)

    def close(self) -> None:
        self.out.write(b"\0" * (-self.n * self.width % 8))
        # Ids ascend, those that are null first, so they are coded like the ends, counted from the smallest.
        given = [d for d in self.docs if d is not None]
        base = given[0] if given else 0
        ends, ids = EliasFano.encode(np.array(self.ends, _U)), EliasFano.encode(np.array([d - base for d in given], _U))
        parts = [p.tobytes() for index in (ends, ids) for p in (index.lows, index.highs, index.directory)]
        for part in parts:
            self.out.write(part)
        lengths = [len(p) for p in parts]
        self.out.write(_HEADER.pack(MAGIC, self.width, len(self.docs), self.n, len(given), base, ends.low_bits, *lengths[:3], ids.low_bits, *lengths[3:]))


class Shard:
    """A shard opened for reading: any document's ids by its place, without a table of offsets."""

    def __init__(self, source):
        source.seek(0, 2)
        size = source.tell()
        if size < _HEADER.size:
            raise ValueError("too short for a shard")
        source.seek(size - _HEADER.size)
        magic, self.width, self.n_docs, self.n_ids, given, self.base, low_ends, *lengths = _HEADER.unpack(source.read(_HEADER.size))
        low_ids = lengths.pop(3)
        begin = -(-self.n_ids * self.width // 8) * 8
        if magic != MAGIC or begin + sum(lengths) + _HEADER.size != size:
            raise ValueError("not a whole shard")
        source.seek(begin)
        parts = [np.frombuffer(source.read(n), t) for n, t in zip(lengths, (_U, _U, np.uint32) * 2, strict=True)]
        self.ends, self.keys = EliasFano(self.n_docs, low_ends, *parts[:3]), EliasFano(given, low_ids, *parts[3:])
        self.source = source

    def doc_id(self, i: int) -> int | None:
        nulls = self.n_docs - self.keys.n
        return None if i < nulls else self.base + self.keys[i - nulls]

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, i: int) -> np.ndarray:
        a, b = self.offsets(i)
        return self._read(a, b)

    def _read(self, a: int, b: int) -> np.ndarray:
        self.source.seek(a * self.width)
        return np.frombuffer(self.source.read((b - a) * self.width), f"<u{self.width}")

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, first place and ids, in order, a run of documents read at a time; places come from the index by select."""
        i = start = 0
        while i < self.n_docs:
            ends = [self.ends[i]]
            while i + len(ends) < self.n_docs and ends[-1] - start < at_once:
                ends.append(self.ends[i + len(ends)])
            run, first = self._read(start, ends[-1]), start
            for k, end in enumerate(ends, i):
                yield self.doc_id(k), start, run[start - first : end - first]
                start = end
            i += len(ends)


def _split(text: str) -> list[str]:
    """Parts between white space; str.split() alone would also split at the separators 0x1C to 0x1F, which are none for a tokenizer."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [x for x in re.split("[ \t\n\x0b\x0c\r]+", text) if x]
    return text.split()


#: Marks that no letter or digit before them joins with, in NFC or in a token.
_MARKS = ".,;:!?*#$%&|\"()"


class WordEncoder:
    """Ids of a text by the tokenizers library, each distinct word encoded once and remembered.

    Only for tokenizers that lower the case, split at white space (which they
    drop) and between letters or digits and other characters, so that a text's
    ids are those of its words one after the other, and a word's those of what
    stands before its last marks and of these.  Other tokenizers are given whole
    texts.
    """

    def __init__(self, path: str, width: int):
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.tokenizer, self.type = Tokenizer.from_file(path), f"<u{width}"
        self.pack = [struct.Struct(f"<{n}{'H' if width == 2 else 'I'}").pack for n in range(32)]
        parts = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and "\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(parts["pre_tokenizer"]).replace("\\\\", "\\")
        # Two generations each: what is in use survives when a generation is full.
        self.words, self.old_words, self.stems, self.old_stems = {}, {}, {}, {}

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        for a in range(0, len(texts), 1024):
            for e in self.tokenizer.encode_batch_fast(texts[a : a + 1024], add_special_tokens=False):
                ids = e.ids
                yield self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, self.type).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Remember words; most differ from known stems by case or a mark at the end only."""
        pairs = []
        for w in new:
            stem = w.rstrip(_MARKS)
            if stem and not stem[-1].isalnum():
                stem = w
            pairs.append((stem.lower() if stem.isascii() else stem, w[len(stem) :]))
        stems, young, old = {x for pair in pairs for x in pair}, self.stems, self.old_stems
        unknown = []
        for x in stems.difference(young):
            if x in old:
                young[x] = old[x]
            else:
                unknown.append(x)
        young.update(zip(unknown, self._ids(unknown), strict=True))
        self.words.update(zip(new, [young[stem] + young[marks] if marks else young[stem] for stem, marks in pairs], strict=True))
        if len(young) > STEMS:
            self.stems, self.old_stems = {}, young

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_word:
            yield from self._ids(texts)
            return
        for a in range(0, len(texts), 256):
            parts = [_split(t) for t in texts[a : a + 256]]
            if len(self.words) > REMEMBER:
                self.words, self.old_words = {}, self.words
            new, old = set().union(*parts).difference(self.words), self.old_words
            again = new & old.keys()
            self.words.update((w, old[w]) for w in again)
            self._learn(list(new - again))
            known = self.words.__getitem__
            for p in parts:
                yield b"".join(map(known, p))


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int) -> WordEncoder:
    """A worker's own encoder, kept from task to task with what it remembers."""
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = WordEncoder(path, width)
    return _ENCODERS[path, width]


def width_of(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _write(folder: str, tokenizer: str, width: int, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encode = encoder(tokenizer, width)
        end = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()
        held, path, place, first, order = None, "", None, None, 0

        def finish():
            held.close()
            place.__exit__(None, None, None)
            return pa.RecordBatch.from_pylist([{"path": path, "first": first, "part": order, "n_docs": len(held.docs), "n_ids": held.n}], schema=_SHARDS)

        try:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc_id, body in zip(ids, encode(texts), strict=True):
                    if held is None:
                        path, first, order = f"{folder}/{uuid.uuid4().hex}.tok", doc_id, order + 1
                        place = store.create(path)
                        held = ShardWriter(place.__enter__(), width)
                    held.add(doc_id, body + end)
                    if held.n >= SHARD_IDS or len(held.docs) >= SHARD_DOCS:
                        yield finish()
                        held = None
            if held is not None:
                yield finish()
                held = None
        except BaseException as e:
            if held is not None:
                place.__exit__(type(e), e, e.__traceback__)
            raise

    return run


_SHARDS = pa.schema([("path", pa.string()), ("first", pa.int64()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ids of whole texts in ascending doc_id order; returns the table of shards with the ids before each.

    ``tokenizer`` is the path of a tokenizers file.  A null text counts as empty
    (only the end id); null ids come first; rows of one id stay apart, one after
    the other.  An empty table makes no shard.
    """
    spark = docs.sparkSession
    place = store.folder(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(store.partitions(spark), -(-size // PARTITION_BYTES))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = ordered.mapInArrow(_write(place, tokenizer, width_of(tokenizer), end_id), "path string, first long, part long, n_docs long, n_ids long")
    shards = store.keep(shards, f"{place}/shards")
    # One row a shard, so this order is small whatever the corpus is.
    before = Window.orderBy(F.col("first").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(shards: DataFrame, digest: bool = False) -> DataFrame:
    """Each document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless ``digest``, the ids.

    The checksum is of the ids as little-endian unsigned 32-bit numbers.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([] if digest else [("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with store.opened(row["path"]) as f:
                    out = []
                    for doc_id, start, ids in Shard(f).documents():
                        item = {"doc_id": doc_id, "start": row["start"] + start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                        out.append(item if digest else item | {"ids": ids.astype(np.int32)})
                        if len(out) == 2000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest else ", ids array<int>")
    tasks = max(1, min(10_000, shards.count()))
    return shards.select("path", "start").repartition(tasks).mapInArrow(run, ddl)
