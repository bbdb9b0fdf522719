"""Substring deduplication: a count-min prefilter, then an exact pass.

A window is `window` consecutive words of one text. Every word that is covered by a window
whose word sequence also starts anywhere else (same text included) is removed.

1. Each task builds a count-min sketch of its windows' counts, the sketches are merged on
   the executors, and what is broadcast is one bit per counter (two or more). A window is
   counted under its anchor: the first smallest hash among its inner `anchor`-word runs.
   Equal windows have equal anchors at different places, so the merged count of the anchor
   never falls below the window's own count, and the sketch holds about an eighth of the
   entries that one per window would need.
2. A second pass over the texts keeps the windows whose estimate is two or more. A task
   first joins its own equal windows, so that a passage in every document leaves it once;
   what is left is dealt by anchor, or by anchor and window where the sketch says that the
   anchor is frequent (HOT), so that the many contexts of a common passage spread. Equal
   windows are counted exactly on 128 bits (anchor and window hash). No window whose sequence
   repeats is lost at any step.

The sketch is sized from the bytes of text, up to `max_cells` counters a row; beyond that
more windows reach the exact pass and, once counters fill up, are dealt one by one: no hot
anchor stays whole, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, chunks, mix, rolling, small_batches, text_buffers

WINDOW = 35
ANCHOR = 20
ROWS = 2
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 29
#: Counters to a block of the sketch: blocks are what tasks send and executors merge.
BLOCK_BITS = 16
#: Counters end here; all anchors whose counter reaches it are dealt window by window. Which
#: they are makes no difference to the result.
HOT = 255
#: Candidate windows that a task gathers before it joins equal ones and sends them.
FLUSH = 1_500_000


def _windows(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window that lies in one text: first word, text, place and hash of its anchor."""
    n = len(words.hashes)
    if n < window:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, U64)
    lengths = np.diff(words.first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(n - window + 1)
    inside = doc[start] == doc[start + window - 1]
    value = rolling(words.hashes, anchor)
    place = np.arange(len(value))
    # smallest of `span` neighbours by doubling; ties keep the first place
    span, have = window - anchor + 1, 1
    while have < span:
        step = min(have, span - have)
        later = value[step:] < value[:-step]
        place = np.where(later, place[step:], place[:-step])
        value = np.where(later, value[step:], value[:-step])
        have += step
    start = start[inside]
    return start, doc[start], place[start], value[start]


def _cells(value: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(value, row + 1) >> U64(64 - bits)


def _bit(row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (row[cell >> U64(3)] >> (cell & U64(7)).astype(np.uint8)) & 1 == 1


def _sketch_task(bits: int, window: int, anchor: int):
    """mapInArrow: the count-min sketch of a task's texts, as its blocks' used counters."""
    low = U64((1 << BLOCK_BITS) - 1)

    def send(anchors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [])
        allv = np.concatenate(anchors) if anchors else np.empty(0, U64)
        for row in range(ROWS):
            cell, count = np.unique(_cells(allv, row, bits), return_counts=True)
            block = (cell >> U64(BLOCK_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(block)) + 1
            for c, k in zip(np.split((cell & low).astype(np.uint16), cuts), np.split(count, cuts), strict=True):
                if len(c):
                    out[1].append(c[k == 1].tobytes())
                    out[2].append(c[k > 1].tobytes())
                    out[4].append(np.minimum(k[k > 1], HOT).astype(np.uint8).tobytes())
            if len(block):
                out[0].extend(block[np.r_[0, cuts]].tolist())
                out[3].extend([row] * (len(cuts) + 1))
        for i in range(0, len(out[0]), 1000):
            s = slice(i, i + 1000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[3][s], pa.int32()), pa.array(out[0][s], pa.int64()), *(pa.array(out[k][s], pa.binary()) for k in (1, 2, 4))],
                names=["row", "block", "once", "more", "counts"],
            )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in chunks(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                _, _, place, value = _windows(w, window, anchor)
                if len(place):
                    new = np.r_[True, place[1:] != place[:-1]]
                    held.append(value[new])
                    size += int(new.sum())
            if size > 2 * FLUSH:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return task


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: adds a partition's sketch blocks; gives a bit a counter (two or more) and,
    for the first row, a second one (hot), where a block has any."""
    counts: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, block, once, more, often in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c = counts.setdefault((row, block), np.zeros(1 << BLOCK_BITS, np.uint8))
            for at, n in ((np.frombuffer(once, np.uint16), 1), (np.frombuffer(more, np.uint16), np.frombuffer(often, np.uint8))):
                c[at] = np.minimum(c[at].astype(np.int16) + n, HOT)
    for (row, block), c in counts.items():
        hot = np.packbits(c == HOT, bitorder="little").tobytes() if row == 0 and (c == HOT).any() else b""
        yield pa.RecordBatch.from_arrays(
            [pa.array([row], pa.int32()), pa.array([block], pa.int64()), pa.array([np.packbits(c > 1, bitorder="little").tobytes()], pa.binary()), pa.array([hot], pa.binary())],
            names=["row", "block", "bits", "hot"],
        )


def sketch(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, max_cells: int = MAX_CELLS) -> tuple[int, np.ndarray, np.ndarray]:
    """The merged sketch of a one-column table of texts: counter bits, ROWS bit rows, and a bit
    for each counter of the first row that is hot.

    What reaches the driver is (ROWS + 1) * cells / 8 bytes, 192 MB at the largest, whatever
    the number of hot counters.
    """
    n_bytes = texts.agg(F.sum(F.octet_length(F.col(texts.columns[0])))).first()[0] or 0
    cells = MIN_CELLS
    while cells < max_cells and cells < 8 * n_bytes / 50:  # an anchor in about 50 bytes
        cells *= 2
    bits = cells.bit_length() - 1
    spark = texts.sparkSession
    # each partition is fetched by a job of its own; it holds cells / 32 bytes at most
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), 64)
    merged = (
        texts.mapInArrow(_sketch_task(bits, window, anchor), "row int, block long, once binary, more binary, counts binary")
        .repartition(parts, "row", "block")
        .mapInArrow(_merge_task, "row int, block long, bits binary, hot binary")
    )
    out, hot = np.zeros((ROWS, cells // 8), np.uint8), np.zeros(cells // 8, np.uint8)
    width = (1 << BLOCK_BITS) // 8
    for r in merged.toLocalIterator():
        own = slice(r["block"] * width, (r["block"] + 1) * width)
        out[r["row"], own] = np.frombuffer(r["bits"], np.uint8)
        if r["hot"]:
            hot[own] = np.frombuffer(r["hot"], np.uint8)
    return bits, out, hot


_RUN = "anchor long, id long, tag int, place int, mask int, twice int, hashes binary"
_HIT = "id long, tag int, place int, mask int"


def _query_task(bits: int, sketch_bits, window: int, anchor: int):
    """mapInArrow over (id, tag, text): the windows estimated repeated, a row an anchor.

    A window of a hot anchor is a row of its own: its `anchor` is made of anchor and window.
    `mask` has the windows at place + 0, 1, ... (31 at most). anchor null: windows that the
    task itself has seen twice, whose result is known; else windows to be counted, `twice`
    marking those seen twice here.
    """
    span = window - anchor + 1

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ident, tag, place, value, h = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h, value))
        v, w = value[order], h[order]
        first = np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]
        group = np.cumsum(first) - 1
        several = np.bincount(group)[group] > 1
        known, ask, double = np.zeros(len(v), bool), np.zeros(len(v), bool), np.zeros(len(v), bool)
        known[order], ask[order], double[order] = several, first, several & first
        for rows, asked in ((ask, True), (known, False)):
            r = np.flatnonzero(rows)
            if not len(r):
                continue
            # a run: windows of one text with one anchor, less than `span` places apart
            i, t, p, a = ident[r], tag[r], place[r], value[r]
            new = np.r_[True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (p[1:] <= p[:-1]) | (p[1:] - p[:-1] >= span)]
            head = np.flatnonzero(new)
            base = p[head][np.cumsum(new) - 1]
            far = p - base >= span
            if far.any():  # a run longer than a mask, of a text that repeats itself
                new |= np.r_[True, ((p - base) // span)[1:] != ((p - base) // span)[:-1]]
                head = np.flatnonzero(new)
                base = p[head][np.cumsum(new) - 1]
            bit = np.int64(1) << (p - base)
            mask = np.add.reduceat(bit, head)
            twice = np.add.reduceat(np.where(double[r], bit, 0), head)
            ends = np.r_[head[1:], len(r)]
            raw = h[r].tobytes() if asked else b""
            for s in range(0, len(head), 20_000):
                x = slice(s, s + 20_000)
                n = len(head[x])
                if asked:
                    off = np.r_[head[x], ends[x][-1:]] * 8
                    data = raw[off[0] : off[-1]]
                    blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((off - off[0]).astype(np.int32).tobytes()), pa.py_buffer(data)])
                    key = pa.array(a[head[x]].view(np.int64))
                else:
                    blob, key = pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(i[head[x]]), pa.array(t[head[x]], pa.int32()), pa.array(base[head[x]], pa.int32()), pa.array(mask[x], pa.int32()), pa.array(twice[x], pa.int32()), blob],
                    names=["anchor", "id", "tag", "place", "mask", "twice", "hashes"],
                )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, hot = sketch_bits.value
        held, size = [], 0
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = text_buffers(batch.column(2))
            for i, j in chunks(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                start, doc, _, value = _windows(w, window, anchor)
                if not len(start):
                    continue
                often = np.ones(len(start), bool)
                for row in range(ROWS):
                    often &= _bit(filled[row], _cells(value, row, bits))
                if often.any():
                    start, doc, value = start[often], doc[often], value[often]
                    h = rolling(w.hashes, window)[start]
                    common = _bit(hot, _cells(value, 0, bits))
                    value = np.where(common, mix(value ^ mix(h, 31), 32), value)
                    held.append((ids[i + doc], tags[i + doc], (start - w.first[doc]).astype(np.int32), value, h))
                    size += len(start)
                if size > FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return task


def _exact_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over runs sorted by anchor: the windows whose sequence occurs twice."""

    def result(ident, tag, place, mask) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ident), pa.array(tag, pa.int32()), pa.array(place, pa.int32()), pa.array(mask, pa.int32())], names=["id", "tag", "place", "mask"])

    def judge(t: pa.Table) -> pa.RecordBatch | None:
        key, ident, tag, place, mask, twice = (t.column(k).to_numpy() for k in range(6))
        blob = t.column(6).combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        h = np.frombuffer(b"".join(blob.to_pylist()), U64)
        bits = (mask[:, None] >> np.arange(31)) & 1 == 1
        run, at = np.nonzero(bits)
        double = (twice[run] >> at) & 1
        order = np.lexsort((h, key[run]))
        v, w = key[run][order], h[order]
        first = np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]
        group = np.cumsum(first) - 1
        total = np.bincount(group, weights=1 + double[order])
        hit = np.zeros(len(v), bool)
        hit[order] = total[group] > 1
        got = np.bincount(run[hit], weights=(np.int64(1) << at[hit]).astype(np.float64), minlength=len(key)).astype(np.int64)
        some = got > 0
        return result(ident[some], tag[some], place[some], got[some]) if some.any() else None

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        null = np.asarray(t.column(0).is_null())
        if null.any():
            k = t.filter(pa.array(null))
            yield result(*(k.column(x).to_numpy() for x in (1, 2, 3, 4)))
            t = t.filter(pa.array(~null))
        if not t.num_rows:
            continue
        t = pa.concat_tables([rest, t]) if rest is not None else t
        key = t.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last anchor's runs may go on in the next batch
        if cut and (done := judge(t.slice(0, cut))) is not None:
            yield done
        rest = t.slice(cut)
    if rest is not None and (done := judge(rest)) is not None:
        yield done


def _cut_task(window: int, with_text: bool):
    """mapInArrow over (text, hits, ...): counts, digest and, on demand, the kept text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big):
                n_words, n_gone, digests, kept = [], [], [], []
                for text, places, masks in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    words = (text or "").encode().split()
                    n_words.append(len(words))
                    if places:
                        gone = np.zeros(len(words) + 1, np.int64)
                        p, m = np.array(places), np.array(masks)
                        run, at = np.nonzero((m[:, None] >> np.arange(31)) & 1)
                        start = p[run] + at
                        np.add.at(gone, start, 1)
                        np.add.at(gone, start + window, -1)
                        keep = np.cumsum(gone)[:-1] == 0
                        n_gone.append(int((~keep).sum()))
                        words = [words[k] for k in np.flatnonzero(keep)]
                    else:
                        n_gone.append(0)
                    out = b" ".join(words)
                    digests.append(hashlib.sha256(out).hexdigest())
                    if with_text:  # a text that loses nothing stays as it is, with its blanks
                        kept.append(out.decode() if places else text)
                cols = [pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string())]
                names = ["n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                cols.append(batch.column(3))
                names.append("row")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return task


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, max_cells: int = MAX_CELLS) -> DataFrame:
    """(id, tag, place, mask): the windows at words place + bit that also start elsewhere.

    `tag` is a hash of the text, so that rows with one id and different texts stay apart.
    """
    if not 0 < anchor <= window or window - anchor + 1 > 31:
        raise ValueError("0 < anchor <= window, and window - anchor below 31")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    bits, *found = sketch(texts, window, anchor, max_cells)
    keyed = docs.select(F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("id"), F.hash(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    runs = keyed.mapInArrow(_query_task(bits, spark.sparkContext.broadcast(found), window, anchor), _RUN)
    dealt = runs.repartition(F.coalesce("anchor", F.xxhash64("id", "place")))
    return dealt.sortWithinPartitions("anchor").mapInArrow(_exact_task, _HIT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, max_cells: int = MAX_CELLS, with_text: bool = False) -> DataFrame:
    """A row for each row of docs: `row` (struct of its other columns), n_words, n_removed,
    kept_sha256 and, with_text, kept_text.

    Null and empty texts have no words. Texts shorter than the window lose nothing. Rows
    that occur twice are copies of each other and lose what repeats like any others; so do
    rows with one id and different texts, each by its own text. A null id is one id. A very
    long text is one step of its task. An empty table gives no rows; columns of any name go
    through in `row`.
    """
    hits = repeated_windows(docs, id_col, text_col, window, anchor, max_cells)
    by_doc = hits.groupBy(F.col("id").alias("_i"), F.col("tag").alias("_t")).agg(F.collect_list(F.struct("place", "mask")).alias("_h"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(
        F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("_id"), F.hash(F.col(text_col)).alias("_tag"),
        F.col(text_col).alias("_text"), F.struct(*others).alias("row"),
    )
    joined = rows.join(by_doc, (F.col("_id") == F.col("_i")) & (F.col("_tag") == F.col("_t")), "left")
    ready = joined.select("_text", F.col("_h.place").alias("_p"), F.col("_h.mask").alias("_m"), "row")
    kind = ready.schema["row"].dataType.simpleString()
    extra = ", kept_text string" if with_text else ""
    return ready.mapInArrow(_cut_task(window, with_text), f"n_words long, n_removed long, kept_sha256 string{extra}, row {kind}")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_chars", **options) -> DataFrame:
    """docs with the columns it has, its texts without what repeats.

    A text that loses nothing stays as it is, null included; `count_col` follows the others.
    """
    out = remove_repeats(docs, id_col, text_col, with_text=True, **options)
    made = {text_col: F.col("kept_text")}
    if count_col in docs.columns:
        made[count_col] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema[count_col].dataType)).otherwise(F.col(f"row.`{count_col}`"))
    return out.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


#: The same in DuckDB.
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, CASE WHEN regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') = '' THEN []::VARCHAR[]
    ELSE string_split_regex(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') END AS words
  FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(words[s:s+34], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM rep),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
