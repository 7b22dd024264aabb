"""Archives, rendering, neighbours, toxicity and the pipeline."""

from __future__ import annotations

import io
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogable.llm import toxicity, warc
from heliogable.llm.html import extract_html, text_of
from heliogable.llm.neighbours import SURE, Tree, chi_square, nearest, quantile

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="no test data")

PAGES = "page_id long, url string, html string, payload string, last long, `of` string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], PAGES).repartition(3)


def test_warc_round_trip(spark):
    many = [(100 + k, f"http://h/{k}", f"<p>{'text ' * (k % 40)}{k % 13}</p>") for k in range(200)]
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (3, None, "same"), (4, "http://c\r\nX: y", ""), (6, "http://d", None), (7, "u", "é\r\n\r\n" * 9), (None, "v", "same"), (9, "w", "x" * 300_000), (5, "again", "same")] + many
    got = warc.read_warc(warc.write_warc(pages(spark, rows))).collect()
    assert len(got) == len(rows) and not [r.problem for r in got if r.problem]
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for r in got:
        same = [h or "" for i, _, h in rows if i == r.page_id]
        body = next(h.encode() for h in same if warc.sha1_base32(h.encode()) == r.payload_digest)
        top = last[body.decode()]
        assert r.payload_bytes == len(body) and r.record_type == ("response" if r.page_id == top else "revisit")
        assert (r.refers_to is None and r.payload == body) if r.record_type == "response" else (r.refers_to == top and r.payload is None)


def test_warc_least_bytes(spark):
    got = warc.read_warc(warc.write_warc(pages(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "x" * 9), (4, "d", "x" * 9)]), least_bytes=5)).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def archive(records, dictionary=b"", plain=False):
    import zstandard

    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(dict_data=held)
    lead = warc.dictionary_frame(dictionary)
    if plain:
        lead = lead[:4] + len(dictionary).to_bytes(4, "little") + dictionary
    return lead + b"".join(pack.compress(r) for r in records)


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_warc_dictionary(plain, step):
    samples = [f"<html><body>page {k} with words {k * k}</body></html>".encode() * 3 for k in range(200)]
    dictionary = warc.train(samples)
    records = [warc.record(k, "u", s, warc.sha1_base32(s), None, False) for k, s in enumerate(samples[:30])]
    raw = archive(records, dictionary, plain)
    read = warc.Archive(io.BytesIO(raw), step)
    assert list(read.frames()) == records and read.dictionary == dictionary


def test_warc_faults():
    good = warc.record(1, "u", b"body", warc.sha1_base32(b"body"), None, False)
    assert warc.read_record(good)["problem"] is None
    for bad in (good.replace(b"WARC/1.1", b"WORC/1.1"), good[:-1], good.replace(b"body", b"bodY"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1), b"", good.replace(b"WARC-Type: ", b"WARC-Type ")):
        assert warc.read_record(bad)["problem"], bad
    raw = archive([good, good])
    assert len(list(warc.Archive(io.BytesIO(raw)).frames())) == 2
    for cut in (len(raw) - 3, 10, 5):
        with pytest.raises(ValueError):
            list(warc.Archive(io.BytesIO(raw[:cut])).frames())


CASES = [
    ("<p>a<p>b", "a\n\nb"), ("a  <b>b</b>\n c", "a b c"), ("<ul><li>x<li>y<ol><li>z</ol></ul>", "- x\n- y\n  1. z"), ("<ol start=9><li>x<li value=4>y</ol>", "9. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>Long name<td>1</table>", "Name       N\nLong name  1"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide  z\na  b  c"),
    ("<pre>\n a\n  b</pre>", " a\n  b"), ("x<br>y<br><br>z", "x\ny\n\nz"), ("<div hidden>a</div>b<span style='DISPLAY : none'>c</span>", "b"), ("<style>.q,#w{display:none}</style><p class='k q'>a<p id=w>b<p>c", "c"),
    ("<script>if (a</script>b<!-- c --><title>t</title>", "b"), ("<details><summary>s</summary>d</details><details open><summary>s</summary>e</details>", "s\ns\ne"), ("&lt;p&gt; &eacute;&#65;", "<p> éA"), ("a</p>b", "a\n\nb"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<select><option>a<option>b</select>", "a\nb"), ("<input value=v><input type=hidden value=h>", "v"), ("<q>x</q>", "“x”"), ("", ""), (None, ""), ("<", "<"), ("<a href='x>y", ""), ("a<b", "a"), ("<textarea>\n<b>x</textarea>", "<b>x"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"), ("<h1>t</h1>x<div>y</div>z", "t\n\nx\ny\nz"), ("<table><caption>cap</caption><tr><td>x</table>", "cap\nx"), ("<td>x</td>y", "xy"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_rendering(page, text):
    assert text_of(page) == text


def test_rendering_depth():
    assert text_of("<div>" * 30_000 + "x") == "x" and "x" in text_of("<table><tr><td>" * 300 + "x") and text_of("<ul><li>" * 2000 + "x").endswith("x")


def test_broken_dictionary(spark, tmp_path):
    """An archive whose dictionary is broken is a row with a problem; the others are read."""
    import struct

    import zstandard

    from heliogable.llm import warc

    rows = [(k, f"http://x/{k}", f"<p>page {k} " + "some words of the page " * 30) for k in range(60)] + [(100 + k, None, "<p>the same body") for k in range(40)]
    listed = warc.write_warc(pages(spark, rows)).collect()
    sound = open(listed[0].path.removeprefix("file://"), "rb").read()
    size = struct.unpack("<I", sound[4:8])[0]
    assert size > 100
    broken = [sound[:8] + bytes([sound[8 + k] ^ (255 if k in (6, 7, 8, 30) else 0) for k in range(size)]) + sound[8 + size :], sound[:4] + struct.pack("<I", len(sound)) + sound[8:], struct.pack("<II", warc.DICTIONARY_MAGIC, 8) + zstandard.MAGIC_NUMBER.to_bytes(4, "little") + b"\xff" * 4]
    paths = [(listed[0].path,)]
    for k, body in enumerate(broken):
        (tmp_path / f"{k}.zst").write_bytes(body)
        paths.append((f"file://{tmp_path}/{k}.zst",))
    got = warc.read_warc(spark.createDataFrame(paths, "path string"), with_payload=False).collect()
    assert sum(r.problem is None for r in got) >= listed[0].records and sum(r.problem is not None for r in got) >= 3


def test_frequent_bodies(spark, monkeypatch):
    """More frequent bodies than are looked up by broadcast, and those that are not."""
    from heliogable.llm import warc

    monkeypatch.setattr(warc, "HOT", 2)
    rows = [(k, "u", f"body {k % 7}" if k % 3 else "hot") for k in range(90)] + [(None, "u", "hot"), (200, "u", None), (201, "u", "")]
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(pages(spark, rows))).collect()}
    last = {}
    for k, _, body in rows:
        last[body or ""] = max(last.get(body or "", -1), -1 if k is None else k)
    for k, _, body in rows:
        first = last[body or ""]
        assert (got[k].record_type, got[k].refers_to) == (("response", None) if k == first else ("revisit", first))


def test_html_rows(spark):
    got = {r.page_id: r.text for r in extract_html(pages(spark, [(1, "u", "<p>a<p>b"), (2, None, None), (None, "u", "c"), (3, "u", "<p>" + "word " * 200_000)])).collect()}
    assert got[1] == "a\n\nb" and got[2] == "" and got[None] == "c" and len(got[3]) == 999_999
    assert extract_html(pages(spark, [(1, "u", "x")]).filter(F.lit(False))).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, block int, rank int"


def brute_nearest(rows, ask, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max({len(v) for _, v in good}, key=lambda d: (sum(len(v) == d for _, v in good), d))
    good = [(i, v) for i, v in good if len(v) == dim]
    out = {}
    for q, v in good:
        if ask(q) and q not in out:
            out[q] = [(i, s) for s, i in sorted(((float(w @ v), i) for i, w in good if i != q), key=lambda t: (-t[0], t[1]))[:k]]
    return out


def test_neighbours_exact_when_few(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [(200, None), (220, []), (240, [0.0] * 6), (260, [None] + [1.0] * 5), (280, [float("nan")] * 6), (300, [float("inf")] * 6), (320, [1.0, 2.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest(rows, lambda q: q % 20 == 0, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in want for a, b in zip(got[q], want[q], strict=True))
    few = nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 2 and nearest(df.filter(F.lit(False)), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("spread", [0.05, 5.0])
def test_neighbours_recall(spark, monkeypatch, spread):
    """Many blocks, hot copies, clustered and scattered: recall of 0.9 and more, scores exact."""
    from heliogable.llm import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "LEAF", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + spread * rng.normal(size=32)).tolist()) for i in range(2000)] + [(5000 + i, centres[0].tolist()) for i in range(900)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], VECTORS)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_nearest(rows, lambda q: q % 50 == 0, 20)
    assert got.keys() == want.keys()
    assert np.mean([len(got[q] & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.9


@needs_data
def test_neighbours_share():
    """Of the table's isotropic vectors, what the search verifies in one block, and what it finds."""
    import pyarrow.parquet as pq

    from heliogable.llm import neighbours

    v = [r for r in pq.read_table(DATA / "embeddings.parquet").to_pylist() if r["embedding"]]
    base = np.array([r["embedding"] for r in v], np.float64)
    rng = np.random.default_rng(9)
    x = np.concatenate([base, rng.standard_normal((8000, base.shape[1])) / base.shape[1] ** 0.5])
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 80)
    tally: list[int] = []
    q, found, _ = neighbours.search(neighbours.Space(x.shape[1], 1.0), ids, x, asked, x[asked], np.full(len(asked), np.inf), 20, quantile(SURE, neighbours.M), tally)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    recall = np.mean([len(set(found[q == a]) & set(best[k])) / 20 for k, a in enumerate(asked)])
    share = sum(tally) / (len(asked) * (len(x) - 1))
    print(f"recall {recall:.3f}, verified {share:.3f}")
    assert recall >= 0.9 and share < 0.55


def test_stopping():
    assert chi_square(quantile(SURE, 8), 8) == pytest.approx(SURE)
    draws = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(1)
    assert (draws <= quantile(0.9, 8)).mean() == pytest.approx(0.9, abs=0.005)
    points = np.concatenate((np.zeros((500, 3)), np.random.default_rng(1).normal(size=(500, 3))))
    tree = Tree(points, 20)
    leaf = tree.place(points)
    assert all((leaf[tree.order[a:b]] == k).all() for k, (a, b) in enumerate(tree.leaves))


def test_isotonic():
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    assert np.interp(2.5, knots, values) == pytest.approx(0.5)


def test_trees_learn_a_corner():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    score = toxicity.Trees.fit(x[:2000], y[:2000], n=30)(x[2000:])
    assert ((score > 0) == (y[2000:] > 0)).mean() > 0.97


def test_plain_words():
    assert [toxicity.plain(w) for w in ("IDIOT!!", "m0r0n,", "$tup1d", "l-o-s-e-r", "123", "...", "Été")] == ["idiot", "moron", "stupid", "loser", "", "", "été"]


def toxic_rows(n):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                w[rng.integers(60)] = rng.choice(["zorgons", "Zorgoff!", "idiot", "blurx"])
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return texts, labels


def test_toxicity(spark, frame, odd_rows):
    texts, labels = toxic_rows(900)
    odd = [(10_000 + i if i is not None else None, t) for i, t in odd_rows]
    labels += [(10_001, 1, None), (None, 1, 1), (10_002, 1, 7), (0, 1, 1)]
    docs, marks = frame(texts + odd), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model, carry=["lang"]).withColumn("held_out", toxicity.held_out("doc_id")).toPandas()
    assert len(got) == len(texts + odd) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    own = got[got.held_out & got.doc_id.between(0, 899)]
    truth = own.doc_id % 4 == 0
    assert ((own.score >= 0.5) == truth).mean() > 0.95
    again = toxicity.score(docs, toxicity.fit(docs.repartition(5), marks)).toPandas()
    assert got.sort_values("doc_id").score.tolist() == again.sort_values("doc_id").score.tolist()
    with pytest.raises(ValueError):
        toxicity.score(docs, model, carry=["score"])


def test_toxicity_without_labels(spark, frame):
    docs = frame([(1, "a"), (2, None)])
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1.0}
    assert toxicity.score(docs.filter(F.lit(False)), toxicity.fit(docs, marks)).count() == 0


@needs_data
def test_pipeline(spark):
    """Each stage against what it must leave, and the last against the library."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    from tests.llm.test_text_operators import brute_links, brute_substring, brute_targets, words

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs
    seen = []
    for name, stage in pipeline.STAGES:
        left = stage(spark, left, str(DATA)).cache()
        seen.append(left.toPandas())
    calm, single, cut, mixed, pieces = seen
    assert set(calm.doc_id) < set(docs.toPandas().doc_id)
    _, group = brute_links(list(zip(calm.doc_id, calm.text, strict=True)))
    assert sorted(single.doc_id) == sorted(i for i, g in group.items() if i == g)
    want = {r[0]: r for r in brute_substring(list(zip(single.doc_id, single.text, strict=True)))}
    assert {i: len(words(t)) for i, t in zip(cut.doc_id, cut.text, strict=True)} == {i: r[1] - r[2] for i, r in want.items()}
    assert (cut.n_chars == cut.text.map(len)).all()
    size = {i: len(words(t)) for i, t in zip(cut.doc_id, cut.text, strict=True)}
    of = dict(zip(cut.doc_id, cut.source, strict=True))
    sizes = {}
    for i, n in size.items():
        sizes[of[i]] = sizes.get(of[i], 0) + n
    target = brute_targets(sizes, (5, 2, 1))
    for source in sizes:
        taken = sum(size[i] for i in mixed[mixed.source == source].doc_id)
        assert abs(taken - target[source]) <= max(n for i, n in size.items() if of[i] == source)
    assert mixed.groupby("doc_id").size().max() <= 3
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    text = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert len(pieces) == len(mixed) and all(list(r.ids) == library.encode(text[r.doc_id]) for r in pieces.itertuples())


def test_pipeline_null_and_repeated_ids(spark, frame):
    """Rows without an id and rows that share one go through near duplicates and mixing each for itself."""
    pipeline = pytest.importorskip("corpus_pipeline")
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, one), (1, one), (2, one + " end"), (3, two), (2, " ".join(f"c{i}" for i in range(50))), (None, "no id here at all"), (None, "nor any id in here"), (7, "seven"), (7, "seven more words")]
    single = pipeline.drop_near_copies(spark, frame(rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in single) == sorted((i or 0, t) for i, t in [rows[0], *rows[3:]])
    same = [(k % 4 or None, f"{k} " + "w " * (k % 3), "en", "ab"[k % 2]) for k in range(40)]
    mixed = pipeline.mix_sources(spark, frame(same), "").toPandas()
    size = {t: len(t.split()) for _, t, _, _ in same}
    times = mixed.groupby("text").size()
    assert times.max() <= 3 and mixed.doc_id.isna().any()
    of, sizes = {t: s for _, t, _, s in same}, {}
    for t, n in size.items():
        sizes[of[t]] = sizes.get(of[t], 0) + n
    from tests.llm.test_text_operators import brute_targets

    for source, target in brute_targets(sizes, (5, 2, 1)).items():
        assert abs(sum(size[t] * n for t, n in times.items() if of[t] == source) - target) <= max(size.values())
