"""SentencePiece encoding and decoding by forward cells shared along a trie of words.

A text becomes marked words: spaces turn into the mark, a mark is put in front,
and a word is its leading marks and what follows up to the next mark (no piece
has a mark behind another character, so words don't affect each other).  The
distinct words of a run of texts are sorted; sorted order is a depth-first walk
of their trie, so the forward cells of a common prefix are those of the word
before, and only what differs is computed.

A cell says by which piece the best segmentation of a prefix ends:

* unigram models: the one of the highest sum of scores (Viterbi);
* BPE models: sums of scores don't give the model's result.  There the prefix
  has one valid segmentation, and its last piece is the only one that ends here
  and whose merge with the cell before it the model itself would leave apart:
  encoding the two pieces together gives those two.  Such checks are remembered
  by pair.  Cells depend on the prefix only, so they are shared all the same.

Characters without a piece become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogable.llm import words

MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
#: Distinct words whose ids a worker remembers.
REMEMBER = 800_000
#: Ids in an output batch.
BATCH_IDS = 1 << 20
#: Texts that are taken apart at a time.
TEXTS = 256
UNIGRAM, BPE = 1, 2


class Model:
    """A model file's pieces, and words' ids by them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only unigram and BPE models that keep texts as they are, with a mark in front")
        kinds = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte = [0] * 256
        self.written: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            kind = kinds[p.type]
            if kind == "user":
                raise ValueError("user-defined pieces are not supported")
            self.scores.append(p.score)
            if kind == "byte":
                self.byte[int(p.piece[1:-1], 16)] = i
            elif kind == "normal":
                self.ids[p.piece] = i
            self.written.append({"byte": lambda p=p: bytes([int(p.piece[1:-1], 16)]), "control": lambda: b"", "unknown": lambda: " ⁇ ".encode()}.get(kind, lambda p=p: p.piece.replace(MARK, " ").encode())())
        self.names = {i: p for p, i in self.ids.items()}
        #: Ends of pieces: their ids, -1 for those that are no pieces themselves.
        self.tails = {p[k:]: self.ids.get(p[k:], -1) for p in self.ids for k in range(len(p))}
        self.worst = min(self.scores) - 10
        marks = {p for p in self.ids if p.startswith(MARK + MARK)}
        self.marks_last = all(not p.strip(MARK) for p in marks) and max((self.scores[self.ids[p]] for p in marks), default=-np.inf) < min((self.scores[i] for p, i in self.ids.items() if len(p) > 1 and p not in marks), default=np.inf)
        self.apart: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list] | None] = {}
        self.runs: dict[int, list[int]] = {}
        self.marked: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the pair whose piece scores highest, the leftmost of equals, until none is left.

        A heap holds the pairs that are there and those that were; a pair counts if both its sides are still as long as when it came in.
        """
        size, after, before = [1] * len(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(text)
            if b < len(text) and (i := self.ids.get(text[a : b + size[b]])) is not None:
                heappush(heap, (-self.scores[i], a, size[a], size[b]))

        for a in range(len(text) - 1):
            offer(a)
        while heap:
            _, a, left, right = heappop(heap)
            b = after[a]
            if size[a] != left or b >= len(text) or size[b] != right:
                continue
            size[a], size[b], after[a], self.cut = left + right, 0, after[b], b
            if after[b] < len(text):
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [text[a : a + n] for a, n in enumerate(size) if n]

    def _as_ids(self, parts: list[str]) -> list[int]:
        return [i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()])]

    def _spines(self, piece: int) -> tuple[list, list] | None:
        """What stands at a piece's right and left end while it forms, with the score of the merge that ends it; None if BPE makes other pieces of its text, or out of the order of scores."""
        if piece not in self.spines:
            name, ends = self.names[piece], None
            if self.merged(name) == [name]:
                ends = ([(name, -np.inf)], [(name, -np.inf)])
                if len(name) > 1:
                    score, cut = self.scores[piece], self.cut
                    for side, part in ((0, name[cut:]), (1, name[:cut])):
                        below = self._spines(self.ids[part]) if part in self.ids else ([(part, -np.inf)],) * 2
                        if below is None or (len(part) > 1 and self.scores[self.ids[part]] < score):
                            ends = None
                            break
                        ends[side].extend([(part, score), *below[side][1:]])
            self.spines[piece] = ends
        return self.spines[piece]

    def _stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves two pieces apart; left is -1 at the start and after a character without a piece.

        They merge if a symbol at the end of the one and a symbol at the start of
        the other, there at the same time, form a piece that scores higher than
        what ends either (of equals the leftmost goes first).
        """
        ends = self._spines(right)
        if left < 0 or ends is None:
            return ends is not None
        before = self._spines(left)
        if before is None:
            return False
        for x, x_ends in before[0]:
            for y, y_ends in ends[1]:
                i = self.ids.get(x + y)
                if i is not None and self.scores[i] > x_ends and self.scores[i] >= y_ends:
                    return False
        return True

    def _cells(self, word: str, piece: list[int], begins: list[int], score: list[float]) -> None:
        """Append the cells of the prefixes of a word that are not there yet: last piece or -1, where it begins, score."""
        tails, apart, scores, kind = self.tails, self.apart, self.scores, self.kind
        for end in range(len(piece), len(word) + 1):
            best, begin = None, end - 1
            while begin >= 0:
                p = tails.get(word[begin:end])
                if p is None:
                    break
                if p >= 0:
                    if kind == BPE:
                        key = piece[begin] << 20 | p
                        stays = apart.get(key)
                        if stays is None:
                            stays = apart[key] = self._stays(piece[begin], p)
                        if stays:
                            best = p, begin, 0.0
                            break
                    elif best is None or score[begin] + scores[p] > best[2]:
                        best = p, begin, score[begin] + scores[p]
                begin -= 1
            if kind != BPE or best is None:
                if tails.get(word[end - 1], -1) < 0:  # bytes, which nothing merges with
                    if best is None or score[end - 1] + self.worst > best[2]:
                        best = -1, end - 1, score[end - 1] + self.worst
                elif best is None:
                    raise ValueError(f"no segmentation of {word[:end]!r}")
            piece.append(best[0])
            begins.append(best[1])
            score.append(best[2])

    def _forward(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Words in sorted order, each with its ids, by the cells of their trie."""
        piece, begins, score, before = [-1], [0], [0.0], ""
        for word in sorted(words):
            same, least = 0, min(len(before), len(word))
            while same < least and before[same] == word[same]:
                same += 1
            del piece[same + 1 :], begins[same + 1 :], score[same + 1 :]
            self._cells(word, piece, begins, score)
            before, out, end = word, [], len(word)
            while end:
                begin = begins[end]
                if piece[end] >= 0:
                    out.append(piece[end])
                else:
                    out += [self.byte[b] for b in reversed(word[begin:end].encode())]
                end = begin
            out.reverse()
            yield word, out

    def _run_of_marks(self, n: int) -> list[int]:
        if n not in self.runs:
            self.runs[n] = self._as_ids(self.merged(MARK * n))
        return self.runs[n]

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Distinct words, each with its ids.

        Of several marks in front of a BPE word only the last can join the word,
        and pieces of marks alone score lowest, so they form after everything
        else: the word with one mark goes through the trie, and the other marks
        (with that one, if it stayed alone) are a run of their own.
        """
        if self.kind != BPE:
            yield from self._forward(words)
            return
        runs: dict[str, list[tuple[int, str]]] = {}
        plain = set()
        for word in words:
            if word.startswith(MARK + MARK):
                body = word.lstrip(MARK)
                if not body:
                    yield word, self._run_of_marks(len(word))
                elif self.marks_last:
                    runs.setdefault(MARK + body, []).append((len(word) - len(body), word))
                else:
                    yield word, self._as_ids(self.merged(word))
            else:
                plain.add(word)
        lone = self.ids.get(MARK, -1)
        for word, ids in self._forward(plain | runs.keys()):
            if word in plain:
                yield word, ids
            for n, whole in runs.get(word, ()):
                yield whole, self._run_of_marks(n) + ids[1:] if ids[0] == lone else self._run_of_marks(n - 1) + ids

    def _learn(self, marked: set[str], others: set[str]) -> None:
        """Remember the ids of words, forgetting others where they would be too many."""
        if len(self.marked) + len(self.others) + len(marked) + len(others) > REMEMBER:
            self.marked, self.others = {}, {}
        new = {MARK + w for w in marked - self.marked.keys()}
        rest = others - self.others.keys()
        for word, ids in self.walk([*(new | rest)]):
            held = array("i", ids).tobytes()
            if word in new:
                self.marked[word[1:]] = held
            if word in rest:
                self.others[word] = held

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for a in range(0, len(texts), TEXTS):
            # A line's words after its first stand behind one mark each, unless there are more spaces.
            marked: set[str] = set()
            others = {"\n"}
            cut: list[list[tuple[list[str], list[str]]]] = []
            for text in texts[a : a + TEXTS]:
                own, odd_mark = [], MARK in text
                for k, chunks in enumerate(line.split(" ") for line in text.split("\n")) if text else ():
                    if "" in chunks or odd_mark:
                        odd = _WORD.findall((MARK if k == 0 else "") + " ".join(chunks).replace(" ", MARK))
                        others.update(odd)
                        own.append((odd, []))
                    elif k:
                        others.add(chunks[0])
                        marked.update(chunks[1:])
                        own.append((chunks[:1], chunks[1:]))
                    else:
                        marked.update(chunks)
                        own.append(([], chunks))
                cut.append(own)
            self._learn(marked, others)
            of, one = self.others.__getitem__, self.marked.__getitem__
            for own in cut:
                yield np.frombuffer(of("\n").join([b"".join([*map(of, odd), *map(one, chunks)]) for odd, chunks in own]), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are spaces, the one in front goes; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.written.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """A worker's own copy of a model."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _run(path: str, carry: list[str], checked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.trim()
        m = model(path)
        for batch in batches:
            begin = held = 0
            out: list[np.ndarray] = []
            rows: list[tuple] = []

            def flush(begin, end, out, rows, batch=batch):
                ends = np.cumsum([0] + [len(x) for x in out]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32), pa.int32()))
                columns = [batch.column("doc_id").slice(begin, end - begin), ids, pa.array(np.diff(ends), pa.int64())]
                names = ["doc_id", "ids", "n_pieces"]
                if checked:
                    columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.bool_()))]
                    names += ["ids_crc32", "round_trip"]
                return pa.RecordBatch.from_arrays(columns + [batch.column("c_" + c).slice(begin, end - begin) for c in carry], names=names + carry)

            def encoded(column=batch.column("text")):
                for a in range(0, len(column), TEXTS):
                    texts = [t or "" for t in column.slice(a, TEXTS).to_pylist()]
                    yield from zip(texts, m.encode(texts), strict=True)

            for i, (text, ids) in enumerate(encoded()):
                if out and held + len(ids) > BATCH_IDS:
                    yield flush(begin, i, out, rows)
                    begin, held, out, rows = i, 0, [], []
                out.append(ids)
                held += len(ids)
                if checked:
                    rows.append((zlib.crc32(ids.astype("<u4").tobytes()), m.decode(ids) == text.replace(MARK, " ")))
            if out:
                yield flush(begin, len(batch), out, rows)

    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, checked: bool = True) -> DataFrame:
    """Each document's piece ids: doc_id, ids, n_pieces, with ``checked`` also ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers) and round_trip (decoding gives the text; a mark in the text itself reads as a space), and the
    columns named in ``carry``.

    A null or empty text has no ids.  Ids may be null or repeat; each row is encoded.  An empty table gives an empty one.
    Other columns of the input are not read; a carried column may not have the name of a column returned.
    """
    carry = list(carry or [])
    own = {"doc_id", "ids", "n_pieces", "ids_crc32", "round_trip"}
    if clash := own & set(carry):
        raise ValueError(f"carried columns have names of the result: {sorted(clash)}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias("c_" + c) for c in carry])
    schema = "doc_id long, ids array<int>, n_pieces long" + ", ids_crc32 long, round_trip boolean" * checked
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(_run(model_path, carry, checked), schema)


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
