"""Join of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Documents of equal word sequences are one class, numbered on its own: ids may repeat or be null.
2. A class has 36 x 5 MinHash values.  Two classes are candidates if a band of
   five values is equal; at similarity 0.8 all 36 bands differ with probability
   6e-7.
3. Candidates' coarse groups (components over "shares a band with the band's
   smallest id", a row for each class and band, never a row for each pair) are
   work units.  A group beyond a unit's size is cut into blocks, with a unit for
   each pair of blocks, or worked off band by band where that moves less.
4. In a unit, pairs that share a band are compared MinHash value by value, 36 at
   a time: with m of n values equal and a uniform prior the similarity is
   Beta(m + 1, n - m + 1), and a pair goes once the probability of 0.8 or more
   is below 1e-6.  The rest are verified exactly on their shingle sets.
5. A unit returns, for each class, its number of links and the smallest class
   that it hangs together with in the unit: rows as many as classes, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogable.llm import store, words
from heliogable.llm.components import components

SHINGLE, THRESHOLD, BANDS, ROWS, TOLERANCE = 5, 0.8, 36, 5, 1e-6
UNIT, UNIT_WORDS = 600, 1_000_000
_U = np.uint64
_FACTORS = words.odd(21, SHINGLE)
_SHIFT, _SCALE = np.random.default_rng(22).integers(0, 2**32, BANDS * ROWS, dtype=np.uint32), words.odd(23, BANDS * ROWS).astype(np.uint32) | np.uint32(1)
_IN_BAND = words.odd(24, ROWS)
_ONE, _TWO = words.Hasher(25), words.Hasher(26)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Offsets and sorted distinct shingles of each text, and a 128-bit key of its word sequence.

    A text of one to four words has itself as its only shingle; one without words has none.
    """
    offsets, (one, two) = words.hashes(texts, _ONE, _TWO)
    counts = np.diff(offsets)
    at = words.starts_of(offsets, SHINGLE)
    doc = np.repeat(np.arange(len(texts)), np.maximum(counts - SHINGLE + 1, 0))
    found = words.grams(one, at, _FACTORS)
    place = np.arange(len(one)) - np.repeat(offsets[:-1], counts)
    filled = offsets[:-1][counts > 0]
    keys = np.zeros((len(texts), 2), _U)
    for k, h in enumerate((one, two)):
        if len(filled):
            keys[counts > 0, k] = np.add.reduceat(words.mix(h + place.astype(_U) * _U(0x9E3779B97F4A7C15)), filled)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    doc, found = np.concatenate((doc, short)), np.concatenate((found, keys[short, 0]))
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    doc, found = doc[new], found[new]
    return np.searchsorted(doc, np.arange(len(texts) + 1)), found, [k.tobytes() for k in keys]


def signatures(offsets: np.ndarray, found: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each text that has a shingle."""
    filled = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(filled), BANDS * ROWS), np.uint32)
    for a in range(0, len(filled), 256):
        begin = filled[a]
        end = filled[a + 256] if a + 256 < len(filled) else len(found)
        part = (found[begin:end] >> _U(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            out[a : a + 256, k] = np.minimum.reduceat((part ^ _SHIFT[k]) * _SCALE[k], filled[a : a + 256] - begin)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    out = np.zeros((len(sig), BANDS), _U)
    for k in range(BANDS):
        for r in range(ROWS):
            out[:, k] += words.mix(sig[:, k * ROWS + r].astype(_U) + _U(k + 1)) * _IN_BAND[r]
    return words.mix(out)


def least_equal(n: int) -> int:
    """The smallest number of equal values among n at which 0.8 or more isn't ruled out.

    P(s >= t) under Beta(m + 1, n - m + 1) is the chance of at most m successes in n + 1 throws of a t coin.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        if tail >= TOLERANCE:
            return m
    return n


_LEAST = [(k * ROWS * 6, least_equal(k * ROWS * 6)) for k in range(1, BANDS * ROWS // (ROWS * 6) + 1)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words.trim()
    for batch in batches:
        texts = words.as_bytes(batch.column("text"))
        ids, marks = batch.column("doc_id"), batch.column("mark")
        for a, b in words.blocks(texts):
            offsets, found, keys = shingles(texts[a:b])
            sizes = np.diff(offsets)
            first = {}
            for i, k in enumerate(keys):
                first.setdefault(k, i)
            own = np.array([i for i in sorted(first.values()) if sizes[i]], np.int64)
            pick = np.zeros(len(sizes), bool)
            pick[own] = True
            chosen = np.repeat(pick, sizes)
            keyed = bands(signatures(np.concatenate(([0], np.cumsum(sizes[own]))), found[chosen]))
            rows = {k: keyed[n].view(np.int64) for n, k in enumerate([keys[i] for i in own])}
            n_words = [len(t) // 6 + 1 for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), marks.slice(a, b - a), pa.array([k if s else None for k, s in zip(keys, sizes, strict=True)], pa.binary()), pa.array(n_words, pa.int64()), pa.array([rows.get(k) if first[k] == i else None for i, k in enumerate(keys)], pa.list_(pa.int64()))],
                names=["doc_id", "mark", "class", "weight", "bands"],
            )


def _pairs(keyed: np.ndarray, sides: np.ndarray | None, band: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs that share a band, each in the first that they share; of two blocks only pairs across; of a band's unit only pairs first met there."""
    for k in range(BANDS) if band is None else [band]:
        order = np.argsort(keyed[:, k], kind="stable")
        column = keyed[order, k]
        cut = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1], [True])))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            members = order[a:b]
            if len(members) < 2:
                continue
            for x in range(0, len(members) - 1):
                i, j = members[x], members[x + 1 :]
                if sides is not None:
                    j = j[sides[j] != sides[i]]
                if k:
                    j = j[~(keyed[j, :k] == keyed[i, :k]).any(axis=1)]
                if len(j):
                    yield i, j


def _links(offsets: np.ndarray, found: np.ndarray, sig: np.ndarray, keyed: np.ndarray, sides: np.ndarray | None, band: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """Linked pairs of a unit: a text and those that it is linked to."""
    _, code = np.unique(found, return_inverse=True)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(code, kind="stable")
    begins = np.searchsorted(code[order], np.arange(code.max() + 2 if len(code) else 1))
    holders = owner[order]
    cached, shared = -1, None
    for i, j in _pairs(keyed, sides, band):
        last = 0
        equal = np.zeros(len(j), np.int64)
        for n, least in _LEAST:
            equal += (sig[j, last:n] == sig[i, last:n]).sum(axis=1)
            keep, last = equal >= least, n
            if not keep.all():
                j, equal = j[keep], equal[keep]
            if not len(j):
                break
        if not len(j):
            continue
        if cached != i:
            own = code[offsets[i] : offsets[i + 1]]
            near = np.concatenate([holders[begins[c] : begins[c + 1]] for c in own])
            cached, shared = i, np.bincount(near, minlength=len(sizes))
        both = shared[j]
        j = j[both >= THRESHOLD * (sizes[i] + sizes[j] - both) - 1e-9]
        if len(j):
            yield i, j


def _work(group: pa.Table) -> pa.Table:
    """One bin of units: a row for each class of a unit."""
    words.trim()
    group = group.sort_by([("unit", "ascending"), ("node", "ascending")])
    units = np.array(group["unit"].combine_chunks().dictionary_encode().indices)
    limits = np.concatenate((np.flatnonzero(np.diff(units, prepend=-1)), [len(units)]))
    out_id, out_unit, out_links, out_texts, out_label = [], [], [], [], []
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        part = group.slice(a, b - a)
        ids, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        side, band = part["side"].to_numpy(), part["band"][0].as_py()
        if side[0] >= 0 and side.min() == side.max():
            continue  # the other block is empty: no pairs across
        offsets, found, _ = shingles(words.as_bytes(part["text"]))
        sig = signatures(offsets, found)
        keyed = bands(sig)
        links, texts, parent = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.arange(len(ids))

        def root(x, parent=parent):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in _links(offsets, found, sig, keyed, side if side[0] >= 0 else None, band):
            links[i] += copies[j].sum()
            links[j] += copies[i]
            texts[i] += len(j)
            texts[j] += 1
            for y in j.tolist():
                x, y = root(i), root(y)
                parent[max(x, y)] = min(x, y)
        out_id.append(ids)
        out_unit += part["unit"].to_pylist()
        out_links.append(links)
        out_texts.append(texts)
        out_label.append(ids[[root(x) for x in range(len(ids))]])
    cat = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
    return pa.table({"node": cat(out_id), "links": cat(out_links), "texts": cat(out_texts), "label": cat(out_label)})


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its links and its group.

    Returns doc_id; rep_id, the smallest id of an equal word sequence; class_id,
    the smallest id of its group (connected by links); copies, documents of
    that word sequence; linked_texts, other word sequences at 0.8 or more;
    links, other documents at 0.8 or more (copies counted).

    A null or empty text, or one without words, is linked to nothing and its own
    class.  Rows that repeat an id are documents each, whatever their texts, and
    so are rows with a null id: they are linked like others, and an id of a
    sequence or group is null only where it has no other.  An empty table gives
    an empty one.  Other columns of the input are not read.
    """
    spark = docs.sparkSession
    place = store.folder(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    sketch = store.keep(rows.mapInArrow(_sketch, "doc_id long, mark long, class binary, weight long, bands array<long>"), f"{place}/sketch")
    known = sketch.filter("class is not null")
    # A class is represented by its smallest id and, as an id may have several texts, the text's hash.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    classes = known.groupBy("class").agg(rep.alias("rep"), F.count("*").alias("copies"), F.first("bands", ignorenulls=True).alias("bands"), F.first("weight").alias("weight"))
    classes = store.keep(classes.select("class", F.monotonically_increasing_id().alias("node"), F.col("rep.doc_id").alias("rep_id"), "rep.mark", "copies", "bands", "weight"), f"{place}/classes")

    entries = classes.select("node", "weight", F.posexplode("bands").alias("band", "key"))
    met = entries.groupBy("band", "key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = store.keep(entries.join(met, ["band", "key"]), f"{place}/met")
    # A class hangs on the smallest of its bands' first classes, and these hang on that one: what many classes share is one edge.
    firsts = met.groupBy("node").agg(F.collect_set("first").alias("firsts")).withColumn("b", F.array_min("firsts"))
    edges = firsts.select(F.col("node").alias("a"), "b").union(firsts.select("firsts", "b").distinct().select(F.explode("firsts").alias("a"), "b").distinct())
    coarse = components(edges.filter("a != b"), f"{place}/coarse")

    # How many blocks a group needs, and whether its bands are the smaller work.
    member = coarse.join(classes.select("node", "weight"), "node")
    need = F.greatest(F.ceil(F.col("n") / UNIT), F.ceil(F.col("size") / UNIT_WORDS))
    of_group = member.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("size")).select("label", "n", need.alias("blocks"))
    of_band = met.join(coarse, "node").groupBy("label", "band", "key").agg(F.count("*").alias("n"), F.sum("weight").alias("size")).select("label", "band", "key", "n", need.alias("blocks"))
    by_band = of_band.groupBy("label").agg(F.sum(F.col("n") * F.col("blocks")).alias("moved"))
    plan = store.keep(of_group.join(by_band, "label").select("label", "blocks", ((F.col("blocks") > 1) & (F.col("moved") < F.col("n") * F.col("blocks"))).alias("banded")), f"{place}/plan")

    def units(df: DataFrame, name) -> DataFrame:
        """Each member of something with so many blocks, in a unit for each pair of blocks that its own is part of; side is -1 where both are one block."""
        own = df.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        other = own.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
        unit = F.concat_ws(":", name, F.least("own", "other"), F.greatest("own", "other"))
        return other.select("node", unit.alias("unit"), F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(-1).alias("side"), "band")

    members = coarse.join(plan, "label")
    whole = units(members.filter("not banded").withColumn("band", F.lit(None).cast("int")), F.concat(F.lit("g"), F.col("label")))
    banded = met.select("node", "band", "key").join(members.filter("banded").select("node", "label"), "node").join(of_band.select("band", "key", "blocks", "label"), ["label", "band", "key"])
    banded = units(banded, F.concat_ws("/", F.lit("b"), F.col("label"), F.col("band"), F.col("key")))
    work = whole.unionByName(banded).join(classes.select("node", "rep_id", F.col("mark").alias("rep_mark"), "copies"), "node")
    texts = rows.join(work, rows["doc_id"].eqNullSafe(work["rep_id"]) & (rows["mark"] == work["rep_mark"])).drop("doc_id", "mark", "rep_id", "rep_mark").dropDuplicates(["node", "unit"])
    tasks = max(store.partitions(spark), -(-met.select("node").distinct().count() // (2 * UNIT)))
    found = texts.withColumn("bin", F.pmod(F.xxhash64("unit"), F.lit(tasks * 4)).cast("int")).repartition(tasks, "bin").groupBy("bin").applyInArrow(_work, "node long, links long, texts long, label long")
    found = store.keep(found, f"{place}/found")

    groups = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a != b"), f"{place}/groups")
    of_class = store.keep(groups.join(classes.select("node", "rep_id"), "node"), f"{place}/of-class")
    smallest = of_class.groupBy("label").agg(F.min("rep_id").alias("least"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("linked_texts"))
    result = classes.select("class", "node", "rep_id", "copies").join(links, "node", "left").join(of_class.select("node", "label").join(smallest, "label"), "node", "left")
    class_id = F.when(F.col("label").isNull(), F.col("rep_id")).otherwise(F.col("least"))
    result = result.select("class", "rep_id", class_id.alias("class_id"), "copies", F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    joined = known.select("doc_id", "class").join(result, "class").drop("class")
    alone = sketch.filter("class is null").select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("linked_texts"), F.lit(0).cast("long").alias("links"))
    return joined.unionByName(alone)
