"""Near-duplicate documents by SetSketch registers.

A document's set has its distinct runs of `shingle` words (A-Z in lower case); a shorter
text is one run; a text without words has an empty set and is linked with nothing. Two sets
are linked if 100 * |intersection| >= percent * |union|.

1. Registers: for each of `bands * rows` hash functions the smallest exponential variate
   over the set, on the scale 1 - log_b (b = 1.001), cut to 16 bits. Registers of a union are
   the larger ones (mergeable), and two sets agree in a register about as often as their
   Jaccard similarity says.
2. Equal sets (128-bit digest and size) become one class, so that thousands of copies are
   one row from here on.
3. Classes that share a band of registers are candidates: all pairs of buckets of up to
   ALL_PAIRS members; of wider ones each member and the smallest. Then, only where a wide
   bucket still holds several components, the members of different components meet: pairwise
   in small buckets, and in large ones in blocks of about BLOCK by BLOCK that compare full
   sets and let nothing but links between components out; there the members of the bucket's
   largest component meet the others only.
4. A pair's registers and sets come together once: its similarity is estimated by maximum
   likelihood from the numbers of larger, equal and smaller registers and the two sizes;
   pairs far below the limit go, and the others are verified on the full sets.

Within one component no further pair can change the result, so none is made: the work stays
near-linear in large groups, and every link between different components is looked for.
With 32 bands of 4 registers a pair at 0.75 shares no band with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, chunks, components, contracted, gathered, mix, rolling, text_buffers

SHINGLE, PERCENT = 5, 75
BANDS, BAND_ROWS = 32, 4
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: Candidates whose estimate is this far below the limit aren't verified: over six standard
#: deviations of 128 registers at 0.75.
MARGIN = 0.24
#: Members of a bucket that are all paired at once; classes whose bands a task sorts at a time.
ALL_PAIRS, CHUNK_CLASSES = 4, 1 << 15
#: Members of a mixed bucket that are paired by a join; beyond, in blocks of so many.
SMALL, BLOCK, BLOCK_SHINGLES = 48, 512, 1 << 20


def _shingles(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs, sorted by text and hash without repeats, and where each text's start."""
    lengths = np.diff(words.first)
    n = len(lengths)
    h = rolling(words.hashes, shingle)
    doc = np.repeat(np.arange(n), lengths)
    start = np.flatnonzero(doc[: len(h)] == doc[shingle - 1 :]) if len(h) else np.empty(0, np.int64)
    value, owner = h[start], doc[start]
    short = np.flatnonzero((lengths > 0) & (lengths < shingle))
    if len(short):
        extra = np.array([rolling(words.hashes[words.first[d] : words.first[d + 1]], int(lengths[d]))[0] + U64(lengths[d]) for d in short], U64)
        value, owner = np.r_[value, extra], np.r_[owner, short]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(n + 1))


_MULTIPLIERS = mix(np.arange(1, 1025, dtype=U64)) | U64(1)


def registers(value: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """SetSketch registers (sets x count, uint16); an empty set's are 0."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, count), np.uint16)
    if not len(some):
        return out
    at = first[some]
    least = np.empty((len(some), count), U64)
    for k in range(count):
        least[:, k] = np.minimum.reduceat(mix_light(value, k), at)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    out[some] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP)
    return out


def mix_light(value: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of values that are well mixed already."""
    y = value * _MULTIPLIERS[k]
    return (y ^ (y >> U64(32))) * _MULTIPLIERS[1023 - k]


def _signature_task(shingle: int, count: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets, 1 << 19):
                value, first = _shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), shingle)
                regs = registers(value, first, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(np.diff(first)),
                        *(pa.array(_digest(value, first, seed)) for seed in (11, 12)),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    names=["id", "n", "s1", "s2", "regs"],
                )

    return task


def band_keys(regs: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    r = regs.reshape(len(regs), bands, -1).astype(U64)
    key = np.zeros(r.shape[:2], U64) + mix(np.arange(bands, dtype=U64), 77)[None, :]
    for k in range(r.shape[2]):
        key = mix(key ^ r[:, :, k], k)
    return key


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: where each run of equal values starts, and the runs' lengths."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def _band_task(bands: int):
    """mapInArrow over classes (rep, regs): rows (at, rep, hub, hidden, band).

    With hub null: rep is in bucket `band` and goes to it. Of more than ALL_PAIRS members
    that a task has in one bucket only the smallest goes there; the others (`hidden` says
    how many) are paired with it and dealt by their own id, so no bucket is hot.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, CHUNK_CLASSES):
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            key = band_keys(regs, bands).ravel().view(np.int64)
            rep = np.repeat(batch.column(0).to_numpy(), bands)
            order = np.lexsort((rep, key))
            key, rep = key[order], rep[order]
            start, length = _runs(key)
            first = np.repeat(start, length)
            wide = np.repeat(length > ALL_PAIRS, length)
            away = wide & (np.arange(len(key)) != first)
            hidden = np.where(wide & ~away, np.repeat(length, length) - 1, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(away, rep, key)), pa.array(rep), pa.array(rep[first], mask=~away), pa.array(hidden), pa.array(key)], names=["at", "rep", "hub", "hidden", "band"]
            )

    return task


def _pair_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over the rows above, sorted by at and rep: candidates (a, b, band).

    A bucket of up to ALL_PAIRS members gives all its pairs (band null), a larger one pairs
    each member with its smallest.
    """
    held = None

    def pairs(t: pa.Table) -> pa.RecordBatch:
        alone = t.column("hub").is_null().combine_chunks().to_numpy(zero_copy_only=False)
        rep, band, hidden = (t.column(c).to_numpy()[alone] for c in ("rep", "band", "hidden"))
        order = np.lexsort((rep, band))
        rep, band, hidden = rep[order], band[order], hidden[order]
        start, length = _runs(band)
        first = np.repeat(start, length)
        total = length + (np.add.reduceat(hidden, start) if len(start) else 0)
        wide = np.repeat(total > ALL_PAIRS, length)
        star = np.flatnonzero(wide & (np.arange(len(rep)) != first))
        a, b, by, narrow = [rep[first[star]]], [rep[star]], [band[star]], [np.zeros(len(star), bool)]
        for d in range(1, ALL_PAIRS):
            i = np.flatnonzero(~wide[:-d] & (band[d:] == band[:-d])) if len(rep) > d else np.empty(0, np.int64)
            a, b, by, narrow = [*a, rep[i]], [*b, rep[i + d]], [*by, band[i]], [*narrow, np.ones(len(i), bool)]
        paired = t.filter(pa.array(~alone))
        for out, c in ((a, "hub"), (b, "rep"), (by, "band")):
            out.append(paired.column(c).to_numpy())
        narrow = np.concatenate([*narrow, np.zeros(int((~alone).sum()), bool)])
        a, b, by = (np.concatenate(x) for x in (a, b, by))
        ok = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(by[ok], mask=narrow[ok])], names=["a", "b", "band"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        at = t.column("at").to_numpy()
        cut = int(np.searchsorted(at, at[-1]))  # the last bucket may go on in the next batch
        if cut:
            yield pairs(t.slice(0, cut))
        held = t.slice(cut).combine_chunks()
    if held is not None:
        yield pairs(held)


def estimate(larger: np.ndarray, smaller: np.ndarray, count: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from joint register counts and known sizes.

    Registers of the first set are larger with probability p(u - v J), smaller with p(v - u J),
    p(x) = -log_b(1 - x (b - 1) / b), u and v being the sets' shares of na + nb. The
    log-likelihood is concave in J on (0, min(u / v, v / u)); golden-section search.
    """
    u = na / (na + nb)
    v = 1 - u
    equal = count - larger - smaller
    top = np.minimum(u / v, v / u)

    def p(x):
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    def like(j):
        a, b = p(u - v * j), p(v - u * j)
        return larger * np.log(a) + smaller * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi, g = np.zeros_like(u), top.copy(), (5**0.5 - 1) / 2
    c, d = hi - g * (hi - lo), lo + g * (hi - lo)
    fc, fd = like(c), like(d)
    for _ in range(24):
        left = fc > fd
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        fc, fd = like(c), like(d)
    return (lo + hi) / 2


def _close(ra, rb, na, nb, percent: int) -> np.ndarray:
    limit = percent / 100 - MARGIN
    fits = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
    out = np.zeros(len(na), bool)
    k = np.flatnonzero(fits)
    for i in range(0, len(k), 20_000):
        s = k[i : i + 20_000]
        a, b = ra[s], rb[s]
        out[s] = estimate((a > b).sum(1), (a < b).sum(1), ra.shape[1], na[s].astype(float), nb[s].astype(float)) >= limit
    return out


def _link_task(percent: int):
    """mapInArrow over (ca, cb, na, nb, ra, rb, sa, sb): (ca, cb) of the pairs that are links.

    The similarity estimated from the registers decides which are compared on full sets.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (4, 5))
            link = _close(ra, rb, na, nb, percent)
            for i in np.flatnonzero(link):
                both = np.concatenate([np.frombuffer(batch.column(k)[i].as_buffer(), U64) for k in (6, 7)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                link[i] = 100 * common >= percent * (int(na[i]) + int(nb[i]) - common)
            keep = pa.array(link)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return task


def _block_task(percent: int, bands: int):
    """applyInArrow on a pair of blocks of one bucket: (a, b), linked components.

    Rows of side 0 meet those of side 1. A pair that shares several buckets is compared in the one of its first shared band.
    """

    def task(t: pa.Table) -> pa.Table:
        side, comp, n = (t.column(c).to_numpy() for c in ("side", "comp", "n"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        if len(left) and len(right):
            band = t.column("band")[0].as_py()
            keys = band_keys(np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(len(n), -1), bands).view(np.int64)
            _, number = np.unique(np.frombuffer(b"".join(t.column("set").to_pylist()), U64), return_inverse=True)
            ends = np.cumsum(n)
            # the right side's sets one after another, as numbers of shingles
            theirs = np.concatenate([number[ends[j] - n[j] : ends[j]] for j in right])
            starts = np.r_[0, np.cumsum(n[right])[:-1]]
            mark = np.zeros(int(number.max()) + 1, np.int32)
            for i in left:
                here = comp[right] != comp[i]
                if here.any():
                    here &= keys[i][np.argmax(keys[right] == keys[i], axis=1)] == band
                if not here.any():
                    continue
                own = number[ends[i] - n[i] : ends[i]]
                mark[own] = 1
                common = np.add.reduceat(mark[theirs], starts)
                mark[own] = 0
                met = np.unique(comp[right[here & (100 * common >= percent * (n[i] + n[right] - common))]])
                a.append(np.full(len(met), comp[i]))
                b.append(met)
        z = np.empty(0, np.int64)
        a, b = (np.concatenate(x) if x else z for x in (a, b))
        return pa.table({"a": a, "b": b})

    return task


def _sets_task(shingle: int):
    """mapInArrow over (rep, n, s1, regs, text): (rep, n, regs, set); texts that aren't of the
    class named beside them (an id with several texts) go."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(4))
            for i, j in chunks(offsets, 1 << 19):
                value, first = _shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), shingle)
                part = batch.slice(i, j - i)
                own = pa.array((_digest(value, first, 11) == part.column(2).to_numpy()) & (np.diff(first) == part.column(1).to_numpy()))
                sets = pa.array([value[p:q].tobytes() for p, q in zip(first[:-1], first[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([c.filter(own) for c in (part.column(0), part.column(1), part.column(3), sets)], names=["rep", "n", "regs", "set"])

    return task


def _digest(value: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each set, whatever its order."""
    c = np.r_[U64(0), np.cumsum(mix(value, seed))]
    return (c[first[1:]] - c[first[:-1]]).view(np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id, kept.

    component_id is the smallest id reachable by links, the row's own included; kept says
    that it is the row's own. Null, empty and blank texts have an empty set and stay alone.
    Texts of any length are one set. A row without id takes part through its text; its
    component_id is null if no id is in reach, and kept is true only then. Rows that occur
    twice carry one id and one result; an id with different texts is one document with the
    links of all of them. An empty table gives no rows; other columns aren't read.
    """
    return _near(docs, id_col, text_col, shingle, percent, bands, rows)[0]


def _near(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = BAND_ROWS) -> tuple[DataFrame, bool]:
    """The above, and whether all texts with words have ids of their own."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = scratch.save(source.mapInArrow(_signature_task(shingle, bands * rows), "id long, n long, s1 long, s2 long, regs binary"), "signatures")
    # a class without any id is named by its digest
    cls = sig.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("low"), F.first("regs").alias("regs")).withColumn("rep", F.coalesce("low", "s1"))
    cls = scratch.save(cls, "classes", nameless=F.col("low").isNull())
    nameless = cls.counted["nameless"]

    members = cls.select("rep", "regs").mapInArrow(_band_task(bands), "at long, rep long, hub long, hidden long, band long")
    stars = members.repartition("at").sortWithinPartitions("at", "rep").mapInArrow(_pair_task, "a long, b long, band long")
    stars = scratch.save(stars, "candidates")
    pairs = stars.select("a", "b").repartition("b").dropDuplicates(["a", "b"])
    pairs = scratch.save(pairs, "pairs")

    # sets are made once, for those classes that share a bucket with another
    need = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = cls.join(need, "rep").select("rep", "n", "s1", "regs", "low")
    texts = wanted.where("low is not null").join(source.where("id is not null and text is not null"), F.col("rep") == F.col("id"))
    texts = texts.select("rep", "n", "s1", "regs", "text").dropDuplicates()
    if nameless:
        digests = source.where("id is null and text is not null").select("text").distinct()
        named = digests.mapInArrow(_named_task(shingle), "s1 long, n long, text string").join(wanted.where("low is null"), ["s1", "n"])
        texts = texts.unionByName(named.select("rep", "n", "s1", "regs", "text").dropDuplicates(["rep", "n"]))
    sets = scratch.save(texts.mapInArrow(_sets_task(shingle), "rep long, n long, regs binary, set binary"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("regs").alias("r" + x), F.col("set").alias("s" + x)) for x in "ab")
        both = pairs.join(two, "b").join(one, "a").select("ca", "cb", "na", "nb", "ra", "rb", "sa", "sb")
        return both.mapInArrow(contracted(_link_task(percent)), "a long, b long")

    links = linked(pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    # ids that stand in several classes join them
    several = sig.where("n > 0").groupBy("id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.count("*").alias("rows")).where("rows > 1 or id is null")
    several = scratch.save(several.select("id", "lo", "hi"), "several", rows=F.lit(True), apart=F.expr("id is not null and lo < hi"))
    plain = not several.counted["rows"]
    if several.counted["apart"]:
        several = several.where("id is not null and lo < hi").select("id")
        places = sig.where("n > 0").select("id", "n", "s1", "s2").join(several, "id").join(cls.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"])
        links = links.unionByName(places.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    comp = components(links, scratch, roots=False)

    # what can still join components: wide buckets that hold more than one of them
    def place(x: str) -> DataFrame:
        return comp.select(F.col("id").alias(x), F.col("component").alias("c" + x))

    seen = stars.where("band is not null").join(place("a"), "a", "left").join(place("b"), "b", "left")
    seen = seen.select("band", "a", F.coalesce("ca", "a").alias("ca"), "b", F.coalesce("cb", "b").alias("cb"))
    seen = scratch.save(seen, "wide", apart=F.col("ca") != F.col("cb"))
    if seen.counted["apart"]:
        mixed = seen.where("ca <> cb").select("band").distinct()
        both = F.array(F.struct(F.col("a").alias("rep"), F.col("ca").alias("comp")), F.struct(F.col("b").alias("rep"), F.col("cb").alias("comp")))
        inside = seen.join(mixed, "band", "left_semi").select("band", F.explode(both).alias("m")).select("band", "m.rep", "m.comp").distinct()
        sized = inside.join(cls.select("rep", "n").groupBy("rep").agg(F.max("n").alias("n")), "rep")
        sized = scratch.save(sized, "mixed")
        parts = sized.groupBy("band", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
        first = F.struct("m", "comp")  # a bucket's largest component: its members needn't meet each other
        sizes = parts.groupBy("band").agg(
            F.sum("m").alias("size"), F.sum("t").alias("total"), F.max_by("comp", first).alias("main"), (F.sum("m") - F.max("m")).alias("others"), (F.sum("t") - F.max_by("t", first)).alias("rest")
        )
        left = scratch.save(sized.join(sizes, "band"), "sized", many=F.col("size") > SMALL)
        few = left.where(F.col("size") <= SMALL)
        one, two = (few.select("band", F.col("rep").alias(x), F.col("comp").alias("c" + x)) for x in "ab")
        found = linked(one.join(two, "band").where("a < b and ca <> cb").select("a", "b", "ca", "cb").repartition("b").dropDuplicates(["a", "b"]))
        if left.counted["many"]:
            # blocks are bounded in members and in shingles; members of other components than
            # the largest meet all members: p numbers blocks of members, q blocks of the others
            def blocks(n: str, shingles: str):
                return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")

            def own(k: str, seed: int):
                return F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(k)).cast("int")

            wide = left.where(F.col("size") > SMALL).drop("n").withColumns({"kp": blocks("size", "total"), "kq": blocks("others", "rest")})
            wide = wide.withColumns({"p": own("kp", 1), "q": own("kq", 2)})
            place = lambda p, q, side: F.struct(p.alias("p"), q.alias("q"), F.lit(side).alias("side"))
            member = F.transform(F.sequence(F.lit(0), F.col("kq") - 1), lambda x: place(F.col("p"), x, 1))
            other = F.when(F.col("comp") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("kp") - 1), lambda x: place(x, F.col("q"), 0))).otherwise(F.array().cast("array<struct<p:int,q:int,side:int>>"))
            dealt = wide.join(sets, "rep").select("band", "comp", "n", "regs", "set", F.explode(F.concat(member, other)).alias("at")).select("band", "at.*", "comp", "n", "regs", "set")
            found = found.unionByName(dealt.groupBy("band", "p", "q").applyInArrow(_block_task(percent, bands), "a long, b long"))
        joined = components(found, scratch, roots=False).select(F.col("id").alias("component"), F.col("component").alias("joined"))
        comp = comp.join(joined, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
        # a component's smallest class has no row so far
        comp = scratch.save(comp.unionByName(joined.select(F.col("component").alias("id"), F.col("joined").alias("component"))), "joined")
        scratch.drop(sized, left)
    scratch.drop(seen, sets, stars)

    whole = cls.join(comp, cls["rep"] == comp["id"], "left").select("n", "s1", "s2", "low", F.coalesce("component", "rep").alias("comp"))
    if nameless:  # a digest may be smaller than the smallest id
        whole = scratch.save(whole, "whole")
        real = whole.groupBy("comp").agg(F.min("low").alias("real"))
        whole = whole.join(real, "comp").drop("comp").withColumnRenamed("real", "comp")
    out = sig.select("id", "n", "s1", "s2").join(whole.drop("low"), ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id"))
    out = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out, plain


def _named_task(shingle: int):
    """mapInArrow over (text): (s1, n, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in chunks(offsets, 1 << 19):
                value, first = _shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(_digest(value, first, 11)), pa.array(np.diff(first)), batch.column(0).slice(i, j - i)], names=["s1", "n", "text"])

    return task


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs' rows without those that another document stands for, with docs' columns.

    One row of each group of near duplicates stays: that of the smallest id, of rows without
    or with equal ids any one. Texts without words (null, empty, blank) are in no group and
    stay. An empty table gives no rows.
    """
    found, plain = _near(docs, id_col, text_col, **options)
    if plain:
        gone = found.where("not kept").select(F.col("id").alias("_gone"))
        return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    # rows get keys of their own, written once so that they don't change
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = Scratch(docs.sparkSession, "rows").save(docs.select(row, F.monotonically_increasing_id().alias("key"), F.col(text_col).cast("string").alias("text")), "rows")
    found, _ = _near(keyed, "key", "text", **options)
    found = found.withColumnRenamed("id", "key").where("n_shingles > 0").join(keyed.select("key", F.col(f"row.`{id_col}`").cast("long").alias("id")), "key")
    stays = found.groupBy("component_id").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("stays"))
    gone = found.join(stays, "component_id").where("key <> stays").select("key")
    return keyed.join(gone, "key", "left_anti").select("row.*")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")


#: The same in DuckDB: all pairs that share a shingle.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split_regex(t, '[\x20\x09-\x0D]+') END AS words
  FROM (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM documents)),
sh AS (SELECT DISTINCT doc_id, md5_number_lower(array_to_string(words[s:s+4], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS s FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(r) AS m FROM reach GROUP BY v) ON v = d.doc_id
"""
