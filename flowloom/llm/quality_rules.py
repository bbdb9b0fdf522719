"""Quality rules combined by weak supervision.

Each rule looks at a text's measures and votes 1 (good), 0 (bad) or abstains. The votes of
all documents are counted by pattern (at most 3 ** rules rows reach the driver), and
expectation-maximisation on these counts estimates how often good and bad documents give
each vote, and how common good documents are. A document's posterior probability of being
good then decides, instead of a demand that it pass every rule.

All measures and votes are DataFrame expressions; there is no Python on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, Scratch, let, words_of

KEEP_AT = 0.5
#: Symbols that count against a text.
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in runs of `width` words that the array holds twice or more."""
    n = F.size(words)

    def runs(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))),
        )

    def covered(places: Column) -> Column:
        # places ascend: each covers `width` words or as many as lie before the next one
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-width).alias("at")),
            lambda a, p: F.struct((a["sum"] + F.least(F.lit(width), p - a["at"])).alias("sum"), p.alias("at")),
            lambda a: a["sum"],
        )

    def marked(keyed: Column) -> Column:
        # keyed is sorted by (hash, place): a run repeats if a neighbour has its hash
        def repeats(x: Column, i: Column) -> Column:
            before = F.get(keyed, i - 1)["h"].eqNullSafe(x["h"])
            after = F.get(keyed, i + 1)["h"].eqNullSafe(x["h"])
            return before | after

        return covered(F.sort_array(F.transform(F.filter(keyed, repeats), lambda x: x["i"])))

    def count(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(keyed, marked))

    return F.when(n < width + 1, F.lit(0).cast("long")).otherwise(let(words, lambda w: let(runs(w), count)))


def duplicate_lines(text: Column) -> Column:
    """How many \\n-separated lines with a word equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    return let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those to carry) as struct `row`, with the measures of its text column
    (null: empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("row"), text.alias("_t")).select(
        "row",
        F.struct(
            F.size(words_of(F.col("_t"))).cast("long").alias("n_words"),
            # code points outside blanks
            F.char_length(F.translate("_t", BLANK_CHARS, "")).cast("long").alias("word_chars"),
            F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            duplicate_lines(F.col("_t")).alias("n_dup_lines"),
            repeated_words(words_of(F.col("_t"))).alias("n_repeat_words"),
            # further measures for the rules: capital and small letters, distinct words
            F.char_length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).alias("n_upper"),
            F.char_length(F.regexp_replace("_t", r"[^\p{L}]+", "")).alias("n_letters"),
        ).alias("m"),
    )


@dataclass(frozen=True)
class Rule:
    """name; when it votes bad and when it votes good ("false": never); else it abstains.

    `rates` are how often good and bad documents are believed to get its bad vote. They are
    where the estimate starts; those of a `held` rule stay.
    """

    name: str
    bad: str
    good: str = "false"
    rates: tuple[float, float] = (0.01, 0.2)
    held: bool = False


#: The rules, over the measures: each looks at one aspect, votes bad at one end and good at
#: the other and abstains between. Each is a hint only: the estimated rates weigh it. A text
#: in capitals is fine in all other respects, so how much that rule says can't be learned from
#: agreement: its rates are held.
RULES = (
    Rule("word_length", "word_chars < 3.0 * n_words or word_chars > 10.0 * n_words", "word_chars between 3.5 * n_words and 8.0 * n_words"),
    Rule("symbols", "n_symbols > 0.2 * n_words", "n_symbols <= 0.05 * n_words"),
    Rule("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.15 * n_words"),
    Rule("lines", "n_dup_lines >= 5", "n_dup_lines <= 1"),
    Rule("capitals", "n_upper > 0.3 * n_letters", "n_upper <= 0.1 * n_letters", (0.0005, 0.4), True),
    Rule("letters", "n_letters < 0.8 * word_chars", "n_letters >= 0.9 * word_chars"),
    Rule("length", "n_words < 20", "n_words >= 60"),
)


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of a row's votes: 1, 0 or null, one for each rule."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")

    def on_struct(sql: str) -> str:
        for n in sorted(names, key=len, reverse=True):
            sql = sql.replace(n, f"m.{n}")
        return sql

    return F.array(*(F.expr(f"CASE WHEN {on_struct(r.bad)} THEN 0 WHEN {on_struct(r.good)} THEN 1 END") for r in rules))


@dataclass(frozen=True)
class LabelModel:
    """log_odds[i]: what rule i's vote 0, vote 1 or abstention adds to the log-odds of good."""

    prior: float
    log_odds: tuple[tuple[float, float, float], ...]

    def posterior(self, vote: Column) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for i, (bad, good, none) in enumerate(self.log_odds):
            v = F.get(vote, i)
            total = total + F.when(v == 0, F.lit(bad)).when(v == 1, F.lit(good)).otherwise(F.lit(none))
        return 1 / (1 + F.exp(-total))


#: How often a rule is believed to abstain, in both classes, at the start.
ABSTAIN = 0.3


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rules: tuple[Rule, ...] | int, rounds: int = 200, prior: float = 0.9, weight: float = 0.01) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents have each.

    A rule votes bad, votes good or abstains with rates of its own among good and among bad
    documents. What is believed at the start counts as `weight` of the documents, so that
    rates stay inside (0, 1), few documents don't overturn it, and which class is the good
    one is settled. No documents leave the beliefs. `rules` may be their number only.
    """
    if isinstance(rules, int):
        rules = (Rule("", "false"),) * rules
    total = sum(c for _, c in patterns)
    belief = max(1.0, weight * total)
    start = [[(r, 1 - ABSTAIN - r, ABSTAIN) for r in rule.rates] for rule in rules]
    p, good, bad = prior, [g for g, _ in start], [b for _, b in start]
    for _ in range(rounds if total else 0):
        sums = [[[belief * x for x in side] for side in rule] for rule in start]
        mass = belief * prior
        for vote, count in patterns:
            k = [2 if v is None else v for v in vote]
            s = math.log(p / (1 - p)) + sum(math.log(good[i][v] / bad[i][v]) for i, v in enumerate(k))
            q = 1 / (1 + math.exp(-max(-500.0, min(500.0, s))))
            mass += q * count
            for i, v in enumerate(k):
                sums[i][0][v] += q * count
                sums[i][1][v] += (1 - q) * count
        was, p = p, mass / (total + belief)
        for i, rule in enumerate(rules):
            if not rule.held:
                good[i], bad[i] = (tuple(x / sum(side) for x in side) for side in sums[i])
        if abs(p - was) < 1e-10:
            break
    return LabelModel(p, tuple(tuple(math.log(x / y) for x, y in zip(gr, br, strict=True)) for gr, br in zip(good, bad, strict=True)))


def label_model(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    counted = measured.select(votes(rules).alias("v")).groupBy("v").count().collect()
    return fit(sorted(((tuple(r["v"]), r["count"]) for r in counted), key=repr), rules)


def judged(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT, rules: tuple[Rule, ...] = RULES, carry: list[str] | None = None) -> DataFrame:
    """`row` (docs' columns, or those to carry), the base measures, base_failed, quality (posterior) and kept.

    Null and empty texts have no words and fail the base rule. Equal texts get equal
    verdicts. An empty table gives no rows. Columns of any name go through in `row`. A very
    long text is measured whole, its words in one array. Measures are written to the shared
    folder once, as they cost far more than a table: the rates and the verdicts both read
    them there.
    """
    measured = Scratch(docs.sparkSession, "quality").save(measures(docs, text_col, carry), "measures")
    model = label_model(measured, rules)
    m = F.col("m")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    quality = model.posterior(F.col("v"))
    return (
        measured.select("row", "m", votes(rules).alias("v"))
        .select("row", *(m[c].alias(c) for c in MEASURES), failed.alias("base_failed"), quality.alias("quality"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
    )


def good_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs' rows that are kept, with docs' columns."""
    return judged(docs, text_col, **options).where("kept").select("row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, the base measures, base_failed, kept and the posterior."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, carry=["doc_id"]).select("row.doc_id", *MEASURES, "base_failed", "kept", "quality")
