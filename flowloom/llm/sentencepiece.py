"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice has a place between any two characters and an edge for every piece; the search
keeps, for each place, the best path's last edge. Only the places of a window as long as the
longest piece can still be continued; whenever the paths back from all of them meet in one
boundary, the ids up to it are committed and the lattice before it is dropped. So memory is
bounded by the window and what is still open, not by the text.

* Unigram models: an edge's weight is its piece's log probability, and the best sum wins.
* BPE models: an edge may follow another only if merging the two pieces' text by itself
  gives just these two pieces. A sequence is the result of all merges if and only if each
  piece and each neighbouring pair is (a first merge across a boundary would also happen in
  the pair by itself), so one path survives at each place and it is the exact encoding.

Texts stream through in blocks of BLOCK bytes. Places that no piece of the vocabulary can
reach across (before a run of blanks, between a letter and certain marks) are boundaries of
every path, so the ids up to the last one of a block are committed and only the open stretch
behind it goes on to the next block. Equal stretches of a block are searched once, and those
of one window are kept in a bounded table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Bytes of text that are searched at a time, and texts of a result batch.
BLOCK, BATCH_BYTES = 1 << 20, 1 << 22
#: Letters after which a mark may end a stretch.
LETTERS = "[A-Za-z]"
#: Stretches (in two generations) and pairs whose results are kept; the tables are bounded.
KEPT, KEPT_LENGTH = 300_000, 48


@dataclass
class Vocabulary:
    """What encoding needs of a model file; small and sent to the executors as it is."""

    ids: dict[str, int]
    scores: dict[str, float]
    pieces: list[str]
    bytes_at: dict[int, int]  # byte value -> id
    unknown: int
    bpe: bool
    dummy_prefix: bool = True
    longest: int = 0
    floor: float = 0.0
    kinds: dict = field(default_factory=dict)
    blank_cuts: bool = False
    marks: str = ""
    _stretch: dict = field(default_factory=dict, repr=False)
    _older: dict = field(default_factory=dict, repr=False)
    _pair: dict = field(default_factory=dict, repr=False)
    _raw: list = field(default_factory=list, repr=False)
    _trie: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        self.floor = min(self.scores.values(), default=0.0) - 10.0  # of a character without a piece
        # a text is a piece that merging can make (True), the beginning of one (False), or neither
        self.kinds = {p[:k]: False for p in self.ids for k in range(1, len(p) + 1)} | {p: True for p in self.ids if not self.bpe or self.merged(p) == [p]}
        follows: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):  # noqa: B905
                follows.setdefault(b, set()).add(a)
        # a blank may only be reached from a blank; marks that no letter reaches
        self.blank_cuts = follows.get(BLANK, set()) <= {BLANK}
        self.marks = "".join(m for m in "!\"#$%&()*,.:;?@[]|<>" if not any(re.match(LETTERS, a) for a in follows.get(m, ())))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_stretch", "_older", "_pair", "_raw", "_trie")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._stretch, self._older, self._pair, self._raw, self._trie = {}, {}, {}, [], {}

    # ------------------------------------------------------------ BPE pairs

    def merged(self, text: str) -> list[str]:
        """Merges of a short text: best score first, of equal ones the leftmost."""
        s, scores = list(text), self.scores
        while len(s) > 1:
            best, at = None, -1
            for k in range(len(s) - 1):
                score = scores.get(s[k] + s[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def follows(self, a: str, b: str) -> bool:
        return self.pair(self.ids.get(a, -1), self.ids.get(b, -1))

    def pair(self, a: int, b: int) -> bool:
        """Whether merging the joint text of two pieces gives just them; -1 merges with nothing."""
        if a < 0 or b < 0:
            return True
        key = a << 32 | b
        got = self._pair.get(key)
        if got is None:
            if len(self._pair) >= KEPT * 4:
                self._pair.clear()
            one, two = self.pieces[a], self.pieces[b]
            got = self._pair[key] = self.merged(one + two) == [one, two]
        return got

    @property
    def trie(self) -> dict:
        """Pieces by character; a node's id, if it is one that merging can make, under None."""
        if not self._trie:
            for p, i in self.ids.items():
                if self.kinds.get(p):
                    node = self._trie
                    for c in p:
                        node = node.setdefault(c, {})
                    node[None] = i
        return self._trie

    # ------------------------------------------------------------ search

    def search(self, text: str) -> Iterator[str]:
        """The pieces of a text, committed as soon as all open paths agree on them."""
        n, longest, scores, kinds = len(text), self.longest, self.scores, self.kinds
        bpe, floor = self.bpe, self.floor
        # by place: (sum, start of the last edge); places before `done` are dropped
        best: dict[int, tuple[float, int]] = {0: (0.0, -1)}
        done, check = 0, 64
        for j in range(n):
            here = best.get(j)
            if here is None:
                continue
            before = text[here[1] : j] if here[1] >= 0 else None
            for k in range(j + 1, min(n, j + longest) + 1):
                p = text[j:k]
                kind = kinds.get(p)
                if not kind and k > j + 1:
                    if kind is None:
                        break
                    continue
                score = scores[p] if kind else floor
                if bpe:
                    if k not in best and (before is None or self.follows(before, p)):
                        best[k] = (0.0, j)
                else:
                    total = here[0] + score
                    old = best.get(k)
                    if old is None or total > old[0]:
                        best[k] = (total, j)
                if kind is None:
                    break
            if j - done >= check:
                meet = self._meeting(best, j + 1, done, longest)
                if meet > done:
                    yield from self._path(best, text, done, meet)
                    for q in [q for q in best if q < meet]:
                        del best[q]
                    best[meet] = (best[meet][0], best[meet][1])
                    done, check = meet, 64
                else:
                    check *= 2
        yield from self._path(best, text, done, n)

    def short(self, text: str) -> list[int]:
        """The same for a BPE model and a text that is a window by itself; gives ids."""
        n, longest, root, pairs, pair = len(text), self.longest, self.trie, self._pair, self.pair
        back, edge = [-1] * (n + 1), [-1] * (n + 1)  # start and id of the one edge that survives at each place
        for j in range(n):
            if j and back[j] < 0:
                continue
            before, node, k = edge[j], root, j
            for c in text[j : j + longest]:
                node = node.get(c)
                if node is None:
                    break
                k += 1
                i = node.get(None)
                if i is not None and back[k] < 0:
                    ok = before < 0 or pairs.get(before << 32 | i)
                    if ok or (ok is None and pair(before, i)):
                        back[k], edge[k] = j, i
            if back[j + 1] < 0 and None not in root.get(text[j], ()):  # a character without a piece
                back[j + 1] = j
        out = []
        while n:
            i, k = edge[n], back[n]
            out.append((i,) if i >= 0 else self._ids_of(text[k:n]))
            n = k
        return [i for ids in reversed(out) for i in ids]

    @staticmethod
    def _meeting(best, j: int, done: int, longest: int) -> int:
        """The last place that the paths back from all open places share."""
        # open: places an edge from before j may have reached or will start from
        heads = {q for q in best if q >= j - longest and q > done}
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            back = best[top][1]
            if back <= done:
                return done
            heads.add(back)
        return min(heads) if heads else done

    @staticmethod
    def _path(best, text: str, start: int, end: int) -> list[str]:
        out = []
        while end > start:
            back = best[end][1]
            out.append(text[back:end])
            end = back
        return out[::-1]

    def _ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if self.bytes_at:
            return [self.bytes_at[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def _ids(self, stretch: bytes) -> bytes:
        """The ids of a stretch; those of one window are kept, in two generations."""
        got = self._stretch.get(stretch)
        if got is None:
            got = self._older.get(stretch)
            if got is None:
                text = stretch.decode("utf-8", "surrogatepass").replace(" ", BLANK)
                ids = self.short(text) if self.bpe and len(text) <= KEPT_LENGTH else (i for p in self.search(text) for i in self._ids_of(p))
                got = array("i", ids).tobytes()
            if len(stretch) <= 2 * KEPT_LENGTH:
                if len(self._stretch) >= KEPT:  # what isn't used again goes with the older table
                    self._older, self._stretch = self._stretch, {}
                self._stretch[stretch] = got
        return got

    def _cuts(self, data: np.ndarray, at: int, heads: np.ndarray) -> np.ndarray:
        """Places in data, counted from `at`, that every path goes through: heads of texts and others."""
        if not self.blank_cuts:
            return heads
        before = np.r_[np.uint8(0), data[:-1]]
        cut = (data == 32) & (before != 32)
        if self.marks:
            cut |= _among(self.marks)[data] & _among("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")[before]
        cut[heads - at] = True
        return np.flatnonzero(cut) + at

    def encode_many(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts (UTF-8 bytes and len(texts) + 1 places): all ids, and each text's number."""
        count = np.zeros(len(offsets) - 1, np.int64)
        heads = offsets[:-1][np.diff(offsets) > 0]
        values, at, n = [], 0, len(data)
        while at < n:
            size = BLOCK
            while True:
                end = min(n, at + size)
                cuts = self._cuts(data[at:end], at, heads[np.searchsorted(heads, at) : np.searchsorted(heads, end)])
                cuts = cuts[np.searchsorted(cuts, at, "right") :]
                if end == n or len(cuts):
                    break
                size *= 2  # an open stretch longer than a block
            starts = np.r_[at, cuts]
            if end < n:  # what is open goes on in the next block
                starts, end = starts[:-1], int(starts[-1])
            places = np.append(starts - at, end - at).astype(np.int64)
            text = np.searchsorted(offsets, starts, "right") - 1
            stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data[at:end].tobytes())])
            coded = stretches.dictionary_encode()
            got = [self._ids(s) for s in coded.dictionary.to_pylist()]
            which = coded.indices.to_numpy()
            if self.dummy_prefix:
                first = np.flatnonzero(starts == offsets[text])
                which = which.astype(np.int64)
                which[first] = len(got) + np.arange(len(first))
                got += [self._ids(b" " + data[starts[k] : at + places[k + 1]].tobytes()) for k in first]
            lengths = np.array([len(g) // 4 for g in got], np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)]), pa.array(np.frombuffer(b"".join(got), np.int32)))
            values.append(lists.take(pa.array(which)).flatten().to_numpy())
            np.add.at(count, text, lengths[which])
            at = end
        return np.concatenate(values) if values else np.empty(0, np.int32), count

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers, one after another."""
        raw = np.frombuffer(text.replace(BLANK, " ").encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_many(raw, np.array([0, len(raw)]))[0].astype(np.int32).tobytes()

    def raw(self) -> list[bytes]:
        """The bytes that each id stands for."""
        if not self._raw:
            value = {i: bytes([b]) for b, i in self.bytes_at.items()}
            self._raw = [value.get(i, p.replace(BLANK, " ").encode()) for i, p in enumerate(self.pieces)]
            for i in range(len(self.pieces)):
                if i not in value and self.pieces[i] not in self.ids:
                    self._raw[i] = b"" if i != self.unknown else " ⁇ ".encode()
        return self._raw

    def round_trips(self, data: np.ndarray, offsets: np.ndarray, values: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether each text's ids decode to it."""
        raw = pa.array(self.raw(), pa.large_binary())
        lengths = np.array([len(r) for r in self.raw()], np.int64)
        back = pa.concat_arrays([raw.take(pa.array(values))])
        joined = memoryview(back.buffers()[2] or b"")
        ends = np.r_[0, np.cumsum(lengths[values])][np.r_[0, np.cumsum(count)]]
        ids, own = np.r_[0, np.cumsum(count)], memoryview(data)
        ok = np.zeros(len(count), bool)
        for k in range(len(count)):
            got, text = bytes(joined[ends[k] : ends[k + 1]]), bytes(own[offsets[k] : offsets[k + 1]])
            ok[k] = (got[1:] == text and got[:1] == b" ") if self.dummy_prefix and len(got) else got == text
            if not ok[k]:  # bytes that aren't UTF-8, or no blank in front
                ok[k] = self.decode(values[ids[k] : ids[k + 1]].tolist()) == text.decode()
        return ok

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that aren't UTF-8 become U+FFFD."""
        raw = self.raw()
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def load(path: str = MODEL) -> Vocabulary:
    """Reads a model file with the public library; nothing is trained or copied."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    usable = [i for i in range(len(pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {pieces[i]: sp.get_score(i) for i in usable}
    # merge ranks are whole numbers below zero, log probabilities are not
    bpe = all(float(s).is_integer() for s in list(scores.values())[:2000])
    return Vocabulary(
        ids={pieces[i]: i for i in usable}, scores=scores, pieces=pieces,
        bytes_at={int(pieces[i][1:-1], 16): i for i in range(len(pieces)) if sp.is_byte(i)}, unknown=sp.unk_id(), bpe=bpe,
    )


def _among(chars: str) -> np.ndarray:
    """A table by byte: whether it is one of chars."""
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


def _encode_task(vocabulary, check: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        for batch in batches:
            data, offsets = text_buffers(pc.replace_substring(batch.column(1), BLANK, " "))
            for i, j in chunks(offsets, BATCH_BYTES):
                own, places = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                values, count = v.encode_many(own, places)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(values, pa.int32()))
                cols, names = [batch.column(0).slice(i, j - i), pa.array(count), ids], ["id", "n_tokens", "ids"]
                if check:
                    cols.append(pa.array(v.round_trips(own, places, values, count)))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return task


def encoded(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_tokens, ids and, with check, round_trip.

    round_trip says that decoding gives the text back (U+2581 counts as a blank, as in the
    public library). Null and empty texts have no ids. Equal texts get equal ids. A text of
    any length streams through; only its ids are held whole. An empty table gives no rows;
    other columns aren't read.
    """
    v = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode_task(v, check), f"id {kind}, n_tokens long, ids array<int>" + (", round_trip boolean" if check else ""))


def decoded(tokens: DataFrame, model: str = MODEL, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """A row for each row of tokens: id, text. Null or no ids give the empty text."""
    v = tokens.sparkSession.sparkContext.broadcast(load(model))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [v.value.decode([x for x in ids if x is not None]) if ids else "" for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, round_trip."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, check=True).withColumnRenamed("id", "doc_id")
