"""Operators over words, each against brute force on odd rows and on the small tables."""

from __future__ import annotations

import hashlib
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from heliogable.llm.jaccard import jaccard_join, least_equal
from heliogable.llm.mixing import mix, targets
from heliogable.llm.quality import quality
from heliogable.llm.substring import substring_dedup

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def words(text):
    return (text or "").encode().split()


def brute_substring(rows):
    first = {}
    key = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            first[k] = min(first.get(k, 2**63), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < key(i):
                gone[j : j + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_odd_rows(frame, odd_rows):
    rows = odd_rows + [odd_rows[10]]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(rows)).collect()), key=str)
    assert got == brute_substring(rows)


def test_substring_texts(frame):
    passage = " ".join(f"p{i}" for i in range(20))
    got = {r.doc_id: r for r in substring_dedup(frame([(1, "a " + passage), (2, passage + "\n z")]), carry=["lang", "n_chars"]).collect()}
    assert got[1].text == "a " + passage and got[2].text == "z" and got[2].lang == "en"
    with pytest.raises(ValueError):
        substring_dedup(frame([(1, "a")]), carry=["n_words"])


def test_substring_every_alignment(frame):
    """A shared passage of exactly 13 words is found wherever it begins in either document."""
    passage = [f"p{i}" for i in range(13)]
    for shift in range(7):
        rows = [(1, " ".join(passage + ["q"]))] + [(2 + k, " ".join([f"f{k}x{i}" for i in range(shift * 7 + k)] + passage)) for k in range(7)]
        assert {r.n_removed for r in substring_dedup(frame(rows)).filter("doc_id > 1").collect()} == {13}


def shingle_set(text):
    w = words(text)
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(rows):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    links[a].add(b)
                    links[b].add(a)
    group = {}
    for i in sorted(sets):
        if i not in group:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = i
                    todo += links[x]
    return links, group


def check_links(rows, df):
    links, group = brute_links(rows)
    got = {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    assert {i: r.links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r.class_id for i, r in got.items()} == group


def test_jaccard_odd_rows(frame, odd_rows):
    df = jaccard_join(frame(odd_rows))
    check_links(odd_rows, df)
    alone = df.filter("doc_id is null").collect()
    assert len(alone) == 1 and alone[0].links == 0


def test_jaccard_repeated_ids(frame):
    """Rows are documents each, whatever their ids: counts against all pairs of rows."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "z"])), (3, " ".join([*b, "z"])), (None, " ".join([*a, "y"])), (None, "alone in the world with these words"), (None, "alone in the world with these  words"), (4, " ".join(b)), (4, " ".join(b))]
    sets = [shingle_set(t) for _, t in rows]
    near = [[i != j and len(x & y) >= 0.8 * len(x | y) for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    want = sorted((str(i), sum(row)) for (i, _), row in zip(rows, near, strict=True))
    got = jaccard_join(frame(rows)).collect()
    assert sorted((str(r.doc_id), r.links) for r in got) == want
    assert {(r.doc_id, r.class_id) for r in got} == {(1, 1), (2, 1), (3, 1), (None, 1), (None, None), (4, 1)}


def test_jaccard_large_groups(frame, monkeypatch):
    """A group that is cut into blocks, whole or by bands, loses no link."""
    from heliogable.llm import jaccard

    monkeypatch.setattr(jaccard, "UNIT", 8)
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(base[: 110 - k % 7] + [f"e{k}"] * (k % 3) + base[110:])) for k in range(60)] + [(100 + k, " ".join(f"u{k}x{i}" for i in range(30))) for k in range(5)]
    check_links(rows, jaccard_join(frame(rows)))


def test_jaccard_few_long_texts(frame, monkeypatch):
    """Blocks that no text falls in leave the links as they are: groups of two to four texts, cut by their size."""
    from heliogable.llm import jaccard

    monkeypatch.setattr(jaccard, "UNIT_WORDS", 200)
    rows = [(10 * g + k, " ".join([f"g{g}w{i}" for i in range(200)] + [f"e{k}"] * k)) for g in range(12) for k in range(2 + g % 3)]
    check_links(rows, jaccard_join(frame(rows)))


@pytest.mark.skipif(not DATA.is_dir(), reason="no test data")
def test_jaccard_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    check_links([(r.doc_id, r.text) for r in docs.collect()], jaccard_join(docs))


def test_pruning_limits():
    """With every value equal nothing is ruled out; a pair at 0.8 is dropped about once in a million."""
    assert all(0 < least_equal(n) < 0.8 * n for n in (30, 60, 180))
    assert least_equal(180) / 180 > least_equal(30) / 30


def brute_quality(text):
    w = [x.decode() for x in words(text)]
    seen = {}
    for j in range(len(w) - 7):
        seen.setdefault(tuple(w[j : j + 8]), []).append(j)
    repeat = {k for at in seen.values() if len(at) > 1 for j in at for k in range(j, j + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat), failed


def test_quality_odd_rows(frame, odd_rows):
    rows = odd_rows + [(20, "a b c d e f g h " * 3 + "x " * 3), (21, "## ** | <b> $5 % & " * 4), (22, "same\nsame\n\n\n same\n")]
    got = {r.doc_id: r for r in quality(frame(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), i
        assert r.kept is False if r.base_failed else r.kept is not None


def test_quality_fences_follow_groups(frame):
    """What is usual in one group is not in another; null groups are groups."""
    from heliogable.llm import quality as q

    text = lambda k, mark: " ".join(f"word{k}x{i}" + (mark if i % 2 else "") for i in range(30))
    rows = [(k, text(k, ""), "en", "a") for k in range(q.ENOUGH + 20)] + [(1000 + k, text(k, "#"), None, "b") for k in range(q.ENOUGH + 20)] + [(5000, text(1, "#"), "en", "a")]
    got = {r.doc_id: r for r in quality(frame(rows)).collect()}
    assert not got[5000].kept and got[1000].kept and got[0].kept and got[1000].basis == 2


def brute_targets(sizes, weights, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, held, free = sum(sizes.values()), {}, set(order)
    while free:
        left, among = total - sum(held.values()), sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / among > cap * sizes[s]}
        if not over:
            return held | {s: left * w[s] / among for s in free}
        for s in over:
            held[s] = cap * sizes[s]
        free -= over
    return held


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 3, "d": 0, None: 50}, {"x": 7}, {"a": 0}, {"a": 5, "b": 1, "c": 1, "d": 1000}])
def test_water_filling(spark, sizes):
    df = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 3, 1)
    got = {r.source: r.target for r in df.collect()}
    assert got == pytest.approx(brute_targets(sizes, (5, 2, 1)))


def test_mix_odd_rows(frame, odd_rows):
    rows = [(*r, "en", ["b", "a", None][k % 3]) for k, r in enumerate(odd_rows + [odd_rows[6]])]
    rows += [(100 + k, f"w{k} " * (1 + k % 9), "en", "a") for k in range(300)]
    df = mix(frame(rows))
    got = df.toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken == got.times * got["size"]).all()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    want = brute_targets(sizes, (5, 2, 1))
    for source, size in sizes.items():
        own = got[(got.source_size == size)]
        assert own.target.iloc[0] == pytest.approx(want[source])
        assert abs(own.taken.sum() - want[source]) <= own["size"].max()
    again = mix(frame(rows).repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist() or got[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()


@pytest.mark.parametrize("operator", [substring_dedup, jaccard_join, quality, mix])
def test_empty(frame, operator):
    assert operator(frame([(1, "x")]).filter(F.lit(False))).count() == 0
