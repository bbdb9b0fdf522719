"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans come from four strict patterns with their checks (e-mail, IP, card, phone). On
top of them high-recall generators propose further, possibly overlapping spans: keys and
passwords, national numbers, bank accounts, unprefixed phone numbers. Format and context
features of each candidate go through boosted trees; a kind's calibrated threshold decides.

The trees are trained here, on candidates made from the formats below and from look-alikes
(order numbers, versions, dates, hashes in prose); they become CASE expressions. There is
no Python on the executors.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Fixed patterns. Possessive loops match the same and don't recurse in Java; a start inside
#: a run whose first place has failed is skipped, as it would fail alike (\G: where the last
#: match ended, a run may start anew).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
#: Runs of 14 digits or more: a shorter run can't be a card number, wherever in it one starts.
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban", "telephone")
#: In the order that spans are sorted by. `before` is what stands before a candidate.
SPAN = "array<struct<start:int,kind:int,end:int,value:string,before:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 2 digits or more pass the Luhn check."""

    def add(i: Column) -> Column:
        d = F.substr(value, F.char_length(value) - i + 1, F.lit(1)).cast("int")
        double = d * 2
        return F.when(i % 2 == 1, d).when(double > 9, double - 9).otherwise(double)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(value)), add), F.lit(0), lambda a, x: a + x)
    return (F.char_length(value) >= 2) & (total % 10 == 0)


def running(xs: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Of an int array, at each place op over all entries up to it.

    By doubling distances, so n entries take n log n steps; an array that grows by one entry
    at a time would be copied n times.
    """

    def doubled(a: Column) -> Column:
        powers = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.when(F.size(a) < 2, a).otherwise(
            F.aggregate(powers, a, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, op(x, F.get(acc, i - d))).otherwise(x)))
        )

    return let(xs, doubled)


def located(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column] | None = None, context: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern with their code point places.

    With context, `before` holds so many characters before the match, back to the start of
    the match before it.
    """
    empty = F.array().cast(SPAN)

    def places(found: Column) -> Column:
        def build(gaps: Column) -> Column:
            def span(end: Column, i: Column) -> Column:
                m = F.get(found, i)
                before = F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(context)) if context else F.lit(None).cast("string")
                return F.struct((end - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("value"), before.alias("before"))

            lengths = F.transform(found, lambda m, i: F.char_length(F.get(gaps, i)) + F.char_length(m))
            return F.transform(running(lengths, lambda x, y: x + y), span)

        return F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), build))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)
    return spans if valid is None else F.filter(spans, lambda s: valid(s["value"]))


def _ip_valid(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))


def _card_valid(v: Column) -> Column:
    d = digits(v)
    return F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))


def _phone_valid(v: Column) -> Column:
    return F.char_length(digits(v)).between(10, 15)


def base_spans(text: Column) -> Column:
    """The base kinds' spans, by start and then kind as listed."""
    return F.sort_array(
        F.concat(
            F.when(F.contains(text, F.lit("@")), located(text, EMAIL, 0)).otherwise(F.array().cast(SPAN)),
            F.when(F.contains(text, F.lit(".")), located(text, IP, 1, _ip_valid)).otherwise(F.array().cast(SPAN)),
            located(text, CARD, 2, _card_valid),
            F.when(F.contains(text, F.lit("+")), located(text, PHONE, 3, _phone_valid)).otherwise(F.array().cast(SPAN)),
        )
    )


#: Generators: kind, pattern. High recall; what they propose may overlap.
GENERATORS = (
    (4, r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{16,}+"),
    (4, r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\x20]?[:=][\x20]?[^\x20\x09-\x0D]{4,}+"),
    (5, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    (6, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7}+(?:[\x20]?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
    (7, r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
)
#: Characters before a candidate in which context words count.
CONTEXT = 40
#: Fixed context words by kind.
CUES = {
    4: "password|passwd|pwd|secret|token|key|credential|login",
    5: "ssn|social security|national|insurance|tax",
    6: "iban|account|bank|konto|compte|cuenta",
    7: "phone|tel|call|mobile|fax|contact|reach",
}
PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|AIza|eyJ)"

FEATURES = ("kind", "length", "digits", "uppers", "lowers", "marks", "variety", "switches", "cue", "prefix", "assigned", "letters_only_tail", "plain_ssn")


def features(span: Column) -> Column:
    """A candidate's features as an array of doubles, in the order of FEATURES."""
    v = span["value"]
    n = F.char_length(v)

    def count(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(v, pattern, "")).cast("double")

    before = F.lower(span["before"])
    cue = functools.reduce(lambda e, k: e.when(span["kind"] == k, before.rlike(CUES[k])), CUES, F.when(F.lit(False), F.lit(False)))
    return F.array(
        span["kind"].cast("double"),
        n.cast("double"),
        count("[^0-9]") / n,
        count("[^A-Z]") / n,
        count("[^a-z]") / n,
        count("[A-Za-z0-9]") / n,
        F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
        F.size(F.regexp_extract_all(v, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0))).cast("double") / n,
        F.coalesce(cue, F.lit(False)).cast("double"),
        v.rlike(PREFIXES).cast("double"),
        v.rlike("(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[:=]").cast("double"),
        v.rlike("[A-Za-z]{6,}$").cast("double"),
        v.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$").cast("double"),
    )


def _plain_features(kind: int, value: str, before: str) -> list[float]:
    """The same features of a training candidate."""
    n = len(value)
    before = before[-CONTEXT:].lower()
    return [
        float(kind), float(n), len(re.sub("[^0-9]", "", value)) / n, len(re.sub("[^A-Z]", "", value)) / n,
        len(re.sub("[^a-z]", "", value)) / n, len(re.sub("[A-Za-z0-9]", "", value)) / n, len(set(value)) / n,
        len(re.findall("[A-Za-z][0-9]|[0-9][A-Za-z]", value)) / n, float(bool(re.search(CUES[kind], before))),
        float(bool(re.match(PREFIXES, value))), float(bool(re.match("(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[:=]", value))),
        float(bool(re.search("[A-Za-z]{6,}$", value))),
        float(bool(re.match("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", value))),
    ]


def training_candidates(seed: int = 7, each: int = 120) -> list[tuple[list[float], int]]:
    """Made candidates with their truth: `each` of every format and look-alike."""
    r = random.Random(seed)
    low, up, dig, b64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def s(chars: str, n: int) -> str:
        return "".join(r.choice(chars) for _ in range(n))

    def prose() -> str:
        return " ".join(s(low, r.randint(2, 9)) for _ in range(6)) + " "

    def cued(kind: int) -> str:
        return prose() + (r.choice(CUES[kind].split("|")) + r.choice([": ", " ", " is "]) if r.random() < 0.5 else "")

    def word() -> str:
        return s(low, r.randint(4, 9))

    good = (
        lambda: (4, "AKIA" + s(up + dig, 16), cued(4)),
        lambda: (4, "ghp_" + s(b64, 36), cued(4)),
        lambda: (4, "sk-" + s(b64, r.randint(20, 48)), cued(4)),
        lambda: (4, s(b64, r.randint(20, 44)), prose() + r.choice(CUES[4].split("|")) + "="),
        lambda: (4, r.choice(["password", "passwd", "secret", "token", "api_key", "pwd"]) + r.choice(["=", ": ", ":"]) + s(low + dig, r.randint(8, 24)), prose()),
        lambda: (5, f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", cued(5)),
        lambda: (6, s(up, 2) + s(dig, 2) + " " + " ".join(s(dig, 4) for _ in range(r.randint(3, 5))) + r.choice(["", " " + s(dig, 2)]), cued(6)),
        lambda: (6, s(up, 2) + s(dig, r.randint(14, 24)), cued(6)),
        lambda: (7, f"({s(dig, 3)}) {s(dig, 3)}-{s(dig, 4)}", cued(7)),
        lambda: (7, r.choice(["-", ".", " "]).join((s(dig, 3), s(dig, 3), s(dig, 4))), prose() + r.choice(CUES[7].split("|")) + " "),
    )
    alike = (
        lambda: (4, s(dig, r.randint(16, 24)), prose()),
        lambda: (4, "-".join(word() for _ in range(3)) + "-" + s(dig, r.randint(1, 4)), prose()),
        lambda: (4, "_".join(word() for _ in range(3)) + s(dig, 1), prose()),
        lambda: (4, f"20{s(dig, 2)}-{s(dig, 2)}-{s(dig, 2)}-{word()}-{word()}", prose()),
        lambda: (4, "/".join(word() for _ in range(4)) + "/" + s(dig, 2), prose()),
        lambda: (4, word() + word() + word() + s(dig, 1), prose()),
        lambda: (4, "=" * r.randint(8, 20) + s(dig, 2) + "=" * r.randint(8, 20), prose()),
        lambda: (4, r.choice(["password: ", "token: ", "secret: "]) + word() + r.choice([",", ".", ""]), prose()),
        lambda: (5, f"{r.choice(['000', '666', '9' + s(dig, 2)])}-{s(dig, 2)}-{s(dig, 4)}", prose()),
        lambda: (5, f"{s(dig, 3)}-00-{s(dig, 4)}", prose()),
        lambda: (6, s(up, 2) + s(dig, 2) + " " + " ".join(s(up, 4) for _ in range(4)), prose()),
        lambda: (7, " ".join((s(dig, 3), s(dig, 3), s(dig, 4))), prose()),
    )
    out = []
    for makers, truth in ((good, 1), (alike, 0)):
        for make in makers:
            out += [(_plain_features(*make()), truth) for _ in range(each)]
    r.shuffle(out)
    return out


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth 2: (feature, cut, (feature, cut, low, high), (...)) each."""

    start: float
    trees: tuple
    scale: float
    shift: float
    thresholds: dict[int, float]

    def margin(self, x: list[float]) -> float:
        s = self.start
        for f, c, left, right in self.trees:
            g, d, a, b = left if x[f] <= c else right
            s += a if x[g] <= d else b
        return s

    def probability(self, x: list[float]) -> float:
        return 1 / (1 + math.exp(-(self.scale * self.margin(x) + self.shift)))

    def score(self, x: Column) -> Column:
        """The calibrated probability as an expression over a feature array."""
        s = F.lit(self.start)
        for f, c, left, right in self.trees:
            sides = [F.when(F.get(x, g) <= d, F.lit(a)).otherwise(F.lit(b)) for g, d, a, b in (left, right)]
            s = s + F.when(F.get(x, f) <= c, sides[0]).otherwise(sides[1])
        return 1 / (1 + F.exp(-(s * self.scale + self.shift)))


def _stump(xs, grad, hess, rows, shrink: float):
    """Best split of rows: gain, feature, cut, values of both sides."""
    total_g, total_h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    leaf = shrink * total_g / (total_h + 1)
    best = (0.0, 0, math.inf, leaf, leaf)
    for f in range(len(FEATURES)):
        order = sorted(rows, key=lambda i: xs[i][f])
        g = h = 0.0
        for k in range(len(order) - 1):
            g += grad[order[k]]
            h += hess[order[k]]
            a, b = xs[order[k]][f], xs[order[k + 1]][f]
            if a == b:
                continue
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best[0] + 1e-12:
                best = (gain, f, (a + b) / 2, shrink * g / (h + 1), shrink * (total_g - g) / (total_h - h + 1))
    return best


@functools.lru_cache(maxsize=4)
def train(rounds: int = 25, shrink: float = 0.4, precision: float = 0.97, seed: int = 7) -> Trees:
    """Gradient boosting on logistic loss; a fifth is held out to calibrate and set thresholds."""
    data = training_candidates(seed)
    held, used = data[: len(data) // 5], data[len(data) // 5 :]
    xs, ys = [x for x, _ in used], [y for _, y in used]
    p0 = sum(ys) / len(ys)
    start = math.log(p0 / (1 - p0))
    margin, trees = [start] * len(xs), []
    for _ in range(rounds):
        prob = [1 / (1 + math.exp(-m)) for m in margin]
        grad, hess = [y - p for y, p in zip(ys, prob, strict=True)], [p * (1 - p) for p in prob]
        _, f, c, _, _ = _stump(xs, grad, hess, range(len(xs)), shrink)
        sides = []
        for keep in (lambda x: x[f] <= c, lambda x: x[f] > c):
            rows = [i for i, x in enumerate(xs) if keep(x)]
            _, g, d, a, b = _stump(xs, grad, hess, rows, shrink) if rows else (0, 0, math.inf, 0.0, 0.0)
            sides.append((g, min(d, 1e9), a, b))
        trees.append((f, min(c, 1e9), *sides))
        for i, x in enumerate(xs):
            g, d, a, b = sides[0] if x[f] <= c else sides[1]
            margin[i] += a if x[g] <= d else b
    model = Trees(start, tuple(trees), 1.0, 0.0, {})
    scale, shift = 1.0, 0.0  # Platt's scaling on the held-out part
    pairs = [(model.margin(x), y) for x, y in held]
    for _ in range(300):
        gs = gb = 0.0
        for m, y in pairs:
            e = y - 1 / (1 + math.exp(-max(-50, min(50, scale * m + shift))))
            gs += e * m
            gb += e
        scale += 0.01 * gs / len(pairs)
        shift += 0.1 * gb / len(pairs)
    model = Trees(start, tuple(trees), scale, shift, {})
    thresholds = {}
    for kind in CUES:  # the lowest threshold that holds the precision from there up, 0.5 at least
        ranked = sorted(((model.probability(x), y) for x, y in held if x[0] == kind), reverse=True)
        best, right = 0.5, 0
        for n, (p, y) in enumerate(ranked, 1):
            right += y
            if right < precision * n:
                best = max(best, p + 1e-6)
                break
        thresholds[kind] = best
    return Trees(start, tuple(trees), scale, shift, thresholds)


def method_spans(text: Column, base: Column, model: Trees | None = None) -> Column:
    """Accepted candidates that no base span and no longer accepted one holds wholly."""
    model = model or train()
    proposed = F.concat(*(located(text, pattern, kind, context=CONTEXT) for kind, pattern in GENERATORS))

    def accepted(s: Column) -> Column:
        limit = functools.reduce(lambda e, k: e.when(s["kind"] == k, F.lit(model.thresholds[k])), CUES, F.when(F.lit(False), F.lit(1.0)))
        return let(features(s), model.score) >= limit

    def outermost(kept: Column) -> Column:
        def of(spans: Column) -> Column:
            ends = running(F.transform(spans, lambda x: x["end"]), F.greatest)
            return let(ends, lambda e: F.filter(spans, lambda x, i: (x["kind"] >= 4) & F.coalesce(F.get(e, i - 1) < x["end"], F.lit(True))))

        # by start, of equal starts base spans first and then the longest
        order = F.transform(
            F.concat(base, kept),
            lambda s: F.struct(s["start"].alias("start"), F.when(s["kind"] < 4, -s["end"] - 2**30).otherwise(-s["end"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")),
        )
        return F.transform(
            let(F.sort_array(order), of),
            lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.lit(None).cast("string").alias("before")),
        )

    some = lambda found, then: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(then(found))
    return let(proposed, lambda p: some(p, lambda q: let(F.filter(q, accepted), lambda kept: some(kept, outermost))))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, text_col: str = "text", method: bool = True) -> DataFrame:
    """`row` (docs' columns), `text` (null: empty), `base` and `spans` (arrays of spans).

    Spans are sorted by start, then kind; places are code points, ends exclusive. Empty
    texts have none, an empty table gives no rows, rows that occur twice get equal spans, and
    columns of any name go through in `row`. The work grows with the text and n log n of
    its n spans, so a very long text is one long step of its task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"))
    b = a.select("row", "text", let(base_spans(F.col("text")), lambda s: F.struct(s.alias("base"), method_spans(F.col("text"), s).alias("more") if method else F.array().cast(SPAN).alias("more"))).alias("s"))
    return b.select("row", "text", F.col("s.base").alias("base"), F.sort_array(F.concat("s.base", "s.more")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans as one.

    The spans are taken in blocks of about the root of their number: a cut finds its place
    by counting characters, and so does it in its block only.
    """
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def marked(ends: Column) -> Column:
        # each span that begins beyond all before it: where the gap before it starts, its start, its kind
        fresh = F.filter(
            F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("gap"), s["start"].alias("start"), s["kind"].alias("kind"))),
            lambda x: x["gap"] <= x["start"],
        )

        def joined(cuts: Column) -> Column:
            size = F.ceil(F.sqrt(F.size(cuts))).cast("int")

            def block(k: Column) -> Column:
                def pieces(own: Column) -> Column:
                    at = F.get(own, 0)["gap"]
                    stop = F.element_at(own, -1)["start"]
                    cut = F.substr(text, at + 1, stop - at)
                    return let(cut, lambda c: F.array_join(F.transform(own, lambda x: F.concat(F.substr(c, x["gap"] - at + 1, x["start"] - x["gap"]), F.get(name, x["kind"]))), ""))

                return let(F.slice(cuts, k * size + 1, size), pieces)

            blocks = F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / size).cast("int"))
            return F.concat(F.array_join(F.transform(blocks, block), ""), F.substr(text, F.array_max(ends) + 1, F.char_length(text)))

        return let(fresh, joined)

    return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), marked)


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with the columns it has, personal data in its texts replaced.

    Null texts stay null and empty ones empty; `count_col` follows the new texts.
    """
    found = personal_data(docs, text_col)
    some = F.size("spans") > 0
    clean = F.when(some, redact(F.col("text"), F.col("spans"))).otherwise(F.col(f"row.`{text_col}`"))
    out = found.select("row", some.alias("some"), clean.alias("clean"))
    made = {text_col: F.col("clean")}
    if count_col in docs.columns:
        made[count_col] = F.when(F.col("some"), F.char_length("clean").cast(docs.schema[count_col].dataType)).otherwise(F.col(f"row.`{count_col}`"))
    return out.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data(docs)

    def of(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [of(k) for k in range(4)]
    return found.select("row.doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
