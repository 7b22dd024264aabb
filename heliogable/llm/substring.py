"""Removal of passages that an earlier document already holds, found by difference-cover anchors.

A window is 13 consecutive words.  A word goes if some window that covers it
also starts in a document with a smaller id.

Two texts that share 13 words at places i and j share, for some t < 7, the
seven words at i + t and j + t with both places in the cover {0, 1, 3} modulo 7
(every difference modulo 7 is a difference of two members).  So it is enough to
hash seven-word anchors at cover places, three of each seven, and to look for
equal ones in different documents.  Only windows that hold such an anchor can
match; these are extended to 13 words and compared by a 96-bit hash.

Data flow, in chunks of about 8 MB of text that are written once to the shared
folder and read again by each pass:

1. anchors of a chunk, distinct and sorted, go to hash buckets; a bucket sends
   back one bit for each: found in another chunk or not;
2. windows that hold a marked anchor go to hash buckets with the smallest id
   that has them in the chunk; a bucket sends back one bit: another chunk has a
   smaller id or not;
3. each chunk's words are marked and its documents written.

What moves is 8 bytes for an anchor, 16 for a candidate window and one bit
back; no text is shuffled, and a passage in a million documents is one entry a
chunk, so no key grows with its frequency.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogable.llm import store, words

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
_ENTRIES = "bucket int, kind int, chunk string, body binary"
_U = np.uint64
_COVERED = np.isin(np.arange(PERIOD), COVER)


class _Chunk:
    """A chunk's words as hashes, its anchors and, given marks for them, its candidate windows; only ``whole`` keeps its texts."""

    first, second = words.Hasher(11), words.Hasher(12)
    in_anchor, in_window, in_check = words.odd(13, ANCHOR), words.odd(14, WINDOW), words.odd(15, WINDOW)

    def __init__(self, path: str, checked: bool = False, whole: bool = False):
        words.trim()
        with store.opened(path) as f:
            table = pa.ipc.open_file(f).read_all()
        ids = table["id"].combine_chunks()
        self.ids = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        texts = words.as_bytes(table["text"])
        if whole:
            self.table, self.texts = table.drop_columns(["text"]), texts
        del table
        self.offsets, found = words.hashes(texts, *([self.first, self.second] if checked else [self.first]))
        self.hashes, self.checks = found[0], found[-1]
        self.document = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.offsets))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of anchors, and the distinct anchors with each place's index among them."""
        at = words.starts_of(self.offsets, ANCHOR)
        at = at[_COVERED[(at - self.offsets[self.document[at]]) % PERIOD]]
        found, which = np.unique(words.grams(self.hashes, at, self.in_anchor), return_inverse=True)
        return at, found, which

    def marked(self, elsewhere: np.ndarray, at: np.ndarray, n: int, which: np.ndarray) -> np.ndarray:
        """Of all windows in order, those that hold an anchor of another document."""
        ids = self.ids[self.document[at]]
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        shared = elsewhere | (low < high)
        sums = np.zeros(len(self.hashes) + 1, np.int32)
        sums[at + 1] = shared[which]
        np.cumsum(sums, out=sums)
        starts = words.starts_of(self.offsets, WINDOW)
        return sums[starts + PERIOD] > sums[starts]

    def windows(self, mask: np.ndarray):
        """Places of the windows in the mask; the distinct windows: two hashes and the smallest id; each place's index."""
        at = words.starts_of(self.offsets, WINDOW)[mask]
        one = words.grams(self.hashes, at, self.in_window)
        two = (words.grams(self.checks, at, self.in_check) >> _U(32)).astype(np.uint32)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(at), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        which = np.empty(len(at), np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        lowest = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(lowest, which, self.ids[self.document[at]])
        return at, one[new], two[new], lowest, which


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of a sorted array begins, and its end."""
    step = (1 << 64) // buckets + 1
    return np.searchsorted(hashes, np.array([min(i * step, 2**64 - 1) for i in range(buckets)], _U)).tolist() + [len(hashes)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.binary()))], names=["bucket", "kind", "chunk", "body"])


def _pack(folder: str, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            path = f"{folder}/{uuid.uuid4().hex}.arrow"
            table = pa.Table.from_batches(held)
            with store.create(path) as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["chunk", "size"])

        for batch in batches:
            lengths = np.array([len(x) for x in words.as_bytes(batch.column("text"))], np.int64)
            begin = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= CHUNK_BYTES:
                    held.append(batch.slice(begin, i + 1 - begin))
                    yield flush()
                    held, size, begin = [], 0, i + 1
            if begin < len(lengths):
                held.append(batch.slice(begin))
        if held:
            yield flush()

    return run


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("chunk").to_pylist():
                _, found, _ = _Chunk(path).anchors()
                cut = _cuts(found, buckets)
                yield _rows([(b, 0, path, found[cut[b] : cut[b + 1]].tobytes()) for b in range(buckets) if cut[b] < cut[b + 1]])

    return run


def _match_anchors(group: pa.Table) -> pa.Table:
    """One bucket: which entries other chunks have too."""
    words.trim()
    bodies = [np.frombuffer(x, _U) for x in group["body"].to_pylist()]
    together = np.concatenate(bodies)
    order = np.argsort(together)
    same = together[order][1:] == together[order][:-1]
    twice = np.zeros(len(together), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    bits = [np.packbits(x).tobytes() for x in np.split(twice, np.cumsum([len(x) for x in bodies])[:-1])]
    return pa.table({"bucket": group["bucket"], "kind": group["kind"], "chunk": group["chunk"], "body": pa.array(bits, pa.binary())})


def _bits(group: pa.Table, cut: list[int]) -> np.ndarray:
    """A chunk's marks, put together from its buckets' bits."""
    out = np.zeros(cut[-1], bool)
    for bucket, kind, body in zip(group["bucket"].to_pylist(), group["kind"].to_pylist(), group["body"].to_pylist(), strict=True):
        if kind == 0:
            a, b = cut[bucket], cut[bucket + 1]
            out[a:b] = np.unpackbits(np.frombuffer(body, np.uint8), count=b - a).astype(bool)
    return out


def _send_windows(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        path = group["chunk"][0].as_py()
        chunk = _Chunk(path, checked=True)
        at, found, which = chunk.anchors()
        mask = chunk.marked(_bits(group, _cuts(found, buckets)), at, len(found), which)
        del at, found, which
        _, one, two, lowest, _ = chunk.windows(mask)
        cut = _cuts(one, buckets)
        rows = [(int(uuid.UUID(path.rsplit("/", 1)[1][:32]).int % buckets), 1, path, np.packbits(mask).tobytes())]
        base = int(lowest.min()) if len(lowest) else 0
        narrow = len(lowest) > 0 and int(lowest.max()) - base < 2**32
        for b in range(buckets):
            x = slice(cut[b], cut[b + 1])
            if cut[b] < cut[b + 1]:
                ids = (lowest[x] - base).astype("<u4") if narrow else lowest[x].astype("<i8")
                rows.append((b, 0 if narrow else 2, path, np.int64(base).tobytes() + one[x].tobytes() + two[x].tobytes() + ids.tobytes()))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _match_windows(group: pa.Table) -> pa.Table:
    """One bucket: which entries have a smaller id in another chunk; masks pass through."""
    words.trim()
    kinds, bodies = group["kind"].to_pylist(), group["body"].to_pylist()
    one, two, ids, counts = [], [], [], []
    for kind, body in zip(kinds, bodies, strict=True):
        if kind == 1:
            counts.append(0)
            continue
        wide = 16 if kind == 0 else 20
        n = (len(body) - 8) // wide
        one.append(np.frombuffer(body, _U, n, 8))
        two.append(np.frombuffer(body, np.uint32, n, 8 + 8 * n))
        tail = np.frombuffer(body, "<u4" if kind == 0 else "<i8", n, 8 + 12 * n).astype(np.int64)
        ids.append(tail + (np.frombuffer(body, np.int64, 1)[0] if kind == 0 else 0))
        counts.append(n)
    out = list(bodies)
    if one:
        one, two, ids = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
        order = np.lexsort((ids, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        least = ids[order][new][np.cumsum(new) - 1]
        later = np.empty(len(order), bool)
        later[order] = least < ids[order]
        ends = np.cumsum(counts)
        for i, kind in enumerate(kinds):
            if kind != 1:
                out[i] = np.packbits(later[ends[i] - counts[i] : ends[i]]).tobytes()
    kinds = [1 if k == 1 else 0 for k in kinds]
    return pa.table({"bucket": group["bucket"], "kind": pa.array(kinds, pa.int32()), "chunk": group["chunk"], "body": pa.array(out, pa.binary())})


def _finish(buckets: int, carry: list[str], with_text: bool):
    def run(group: pa.Table) -> pa.Table:
        chunk = _Chunk(group["chunk"][0].as_py(), checked=True, whole=True)
        starts = words.starts_of(chunk.offsets, WINDOW)
        mask = np.zeros(len(starts), bool)
        for kind, body in zip(group["kind"].to_pylist(), group["body"].to_pylist(), strict=True):
            if kind == 1:
                mask = np.unpackbits(np.frombuffer(body, np.uint8), count=len(starts)).astype(bool)
        del starts
        at, one, _, lowest, which = chunk.windows(mask)
        later = _bits(group, _cuts(one, buckets))
        hit = at[later[which] | (chunk.ids[chunk.document[at]] > lowest[which])]
        del at, one, lowest, which, later
        change = np.zeros(len(chunk.hashes) + 1, np.int64)
        chunk.hashes = chunk.checks = chunk.document = None
        np.add.at(change, hit, 1)
        np.add.at(change, hit + WINDOW, -1)
        gone = np.cumsum(change[:-1]) > 0
        del change, hit
        sums = np.concatenate(([0], np.cumsum(gone)))
        removed = sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]
        digests, texts = [], []
        for i, text in enumerate(chunk.texts):
            own = text.split()
            if removed[i]:
                own = list(compress(own, (~gone[chunk.offsets[i] : chunk.offsets[i + 1]]).tolist()))
            kept = b" ".join(own)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode() if removed[i] else text.decode())
        out = {"doc_id": chunk.table["id"], "n_words": pa.array(np.diff(chunk.offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests)}
        if with_text:
            out["text"] = pa.array(texts, pa.string())
        return pa.table(out | {c: chunk.table["c_" + c] for c in carry})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """Each document without the words that an earlier document's 13-word passages cover.

    Returns doc_id, n_words, n_removed, kept_sha256, with ``with_text`` also
    ``text`` (unchanged where nothing goes, else the kept words joined by one
    space), and the columns named in ``carry``.

    A null text has no words.  A null id counts as smaller than all others.
    Rows of one id are one document's: they do not remove from each other.  An
    empty table gives an empty one.  Other columns of the input are not read;
    a carried column may not have the name of a column returned.
    """
    spark, carry = docs.sparkSession, list(carry or [])
    own = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    if clash := set(carry) & set(own):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    place = store.folder(spark, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias("c_" + c) for c in carry])
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    chunks = store.keep(rows.mapInArrow(_pack(f"{place}/chunks", carry), "chunk string, size long"), f"{place}/list")
    n, size = chunks.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(store.partitions(spark), -(-size // BUCKET_BYTES))
    tasks = max(1, min(n, 10_000))

    def by(df: DataFrame, parts: int, key: str):
        """Dealt out by a key to a set number of tasks, which adaptive execution doesn't merge: entries are small, the work behind them isn't."""
        return df.repartition(parts, key).groupBy(key)

    all_chunks = chunks.select(F.lit(-1).alias("bucket"), F.lit(3).alias("kind"), "chunk", F.lit(None).cast("binary").alias("body"))
    sent = chunks.select("chunk").repartition(tasks).mapInArrow(_send_anchors(buckets), _ENTRIES)
    back = by(sent, buckets, "bucket").applyInArrow(_match_anchors, _ENTRIES).unionByName(all_chunks)
    sent = by(back, tasks, "chunk").applyInArrow(_send_windows(buckets), _ENTRIES)
    back = by(sent, buckets, "bucket").applyInArrow(_match_windows, _ENTRIES)
    return by(back, tasks, "chunk").applyInArrow(_finish(buckets, carry, with_text), schema)
