"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, votes bad or abstains. Votes are counted by pattern, at most three to the
power of the number of rules, and expectation-maximisation over the patterns estimates how often
each rule votes each way on good and on bad documents. A document is kept if the posterior that it
is good reaches the threshold and the base rules don't reject it. So rules are weighed against each
other: one bad vote of a rule that often errs is outweighed by good votes, and several weak bad
votes together drop a document that no base rule rejects.

Rules overlap on purpose (marks, for example, lower the share of letters, end words oddly and count
as symbols), as it is from their agreement that accuracies are learned. So they are not independent, and
the posterior is surer than it should be. Taking the rules of a trait as one voter, or weighing them by
their correlation, leaves nothing that agrees, and the estimation then finds other classes than good
and bad (figures in README).

Defined cases: null text has no words and fails the base rules, like an empty one; very long texts
are counted whole, in one row of one task; repeated rows are judged alike; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import column, written

WINDOW = 5
ROUNDS = 40
THRESHOLD = 0.5
#: Before any vote is seen: the share of good documents, and by class (bad, good) the probabilities of a
#: bad vote, a good vote and none. They start the estimation and count as PRIOR_DOCUMENTS documents in it.
PRIOR_GOOD = 0.75
PRIOR_VOTES = ((0.4, 0.2, 0.4), (0.02, 0.7, 0.28))
PRIOR_DOCUMENTS = 20.0
SPACES = r"[\x20\x09-\x0D]+"


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(text_windows: Column) -> Column:
    """Words covered by the windows (as hashes, in text order) that occur twice or more."""
    pairs = F.sort_array(F.transform(text_windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(e["h"])))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("words"))
        return F.aggregate(
            at, start,
            lambda a, p: F.struct(p.alias("last"), (a["words"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("words")),
            lambda a: a["words"],
        )

    return _bound(pairs, covered)


def features(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts over whole texts, a row per document; nothing is shuffled."""
    kept = [F.col(c).alias(c) for c in keep or []]
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select(*kept, F.col("doc_id").cast("long").alias("_id"), text.alias("_text"), F.array_remove(F.split(text, SPACES), "").alias("_words"))
    two = one.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    two = two.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0))
    n = F.size("_hashes")
    three = two.withColumn(
        "_windows",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]))),
    )
    return three.select(
        *kept,
        "_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeat_words(F.col("_windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_hashes", lambda h, i: F.get(F.col("_hashes"), i - 1) == h)).cast("long").alias("_n_stutter"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{L}+", ""))).cast("long").alias("_n_letters"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("_n_upper"),
        F.regexp_count("_text", F.lit(r"(?:[#*$%&|<>=~^_+@\\/]|[!?.]{2})(?=[\x20\x09-\x0D]|\z)")).cast("long").alias("_n_odd_ends"),
        F.regexp_count("_text", F.lit(r"(?:\A|[\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|\z)")).cast("long").alias("_n_bare_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(2))


def votes() -> dict[str, Column]:
    """By rule: 0 votes bad, 1 votes good, 2 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("_n_lines"), F.lit(1))

    def share(count: str, of: Column, good: float, bad: float) -> Column:
        return _vote(F.col(count) / of <= good, F.col(count) / of > bad)

    letters = F.col("_n_letters") / chars
    return {
        "length": _vote(F.col("n_words") >= 40, F.col("n_words") < 10),
        "symbols": share("n_symbols", words, 0.05, 0.2),
        "dup_lines": share("n_dup_lines", lines, 0.1, 0.5),
        "repeats": share("n_repeat_words", words, 0.05, 0.2),
        "stutter": share("_n_stutter", words, 0.05, 0.2),
        "letters": _vote(letters >= 0.9, letters < 0.8),
        "capitals": share("_n_upper", F.greatest(F.col("_n_letters"), F.lit(1)), 0.2, 0.5),
        "odd_ends": share("_n_odd_ends", words, 0.05, 0.2),
        "bare_marks": share("_n_bare_marks", words, 0.05, 0.2),
    }


def _posterior(names: list[str], prior: float, table: dict[str, list[list[float]]]) -> Column:
    """P(good | votes). table[rule][class][vote] is a probability."""
    score = F.lit(math.log(prior / (1 - prior)))
    for name in names:
        weights = [math.log(table[name][1][v] / table[name][0][v]) for v in range(3)]
        score = score + F.get(F.array(*[F.lit(w) for w in weights]), F.col(name))
    return 1 / (1 + F.exp(-score))


def _estimated(patterns: Column, rules: int, rounds: int) -> Column:
    """The share of good documents, then P(vote | class) by class (bad, good), rule and vote, after the rounds.

    patterns holds (n, at): a number of documents and, for each rule, 3 * rule + vote.
    """
    size = 3 * rules
    pseudo = [PRIOR_DOCUMENTS * x for c in PRIOR_VOTES for _ in range(rules) for x in c]
    start = [PRIOR_GOOD] + [x for c in PRIOR_VOTES for _ in range(rules) for x in c]
    numbers = lambda values: F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")
    none = numbers([0.0] * (2 * size))

    def expected(p: Column, ratios: Column) -> Column:
        """Expected votes by class, rule and vote."""
        odds = F.log(p[0] / (1 - p[0]))

        def add(total: Column, x: Column) -> Column:
            good = 1 / (1 + F.exp(-F.aggregate(x["at"], odds, lambda a, i: a + F.get(ratios, i))))
            return _bound(
                good,
                lambda g: F.transform(
                    total,
                    lambda t, i: t + F.when(F.array_contains(x["at"], (i % size).cast("int")), x["n"] * F.when(i < size, 1 - g).otherwise(g)).otherwise(F.lit(0.0)),
                ),
            )

        return F.aggregate(patterns, none, add)

    def maximised(seen: Column) -> Column:
        """Shares of the expected votes; each rule votes once for each document, so rule 0 gives the totals."""
        counts = F.zip_with(seen, numbers(pseudo), lambda a, b: a + b)

        def shares(c: Column) -> Column:
            in_rule = lambda i: sum((F.get(c, i - i % 3 + v) for v in range(3)), F.lit(0.0))
            bad, good = (seen[k] + seen[k + 1] + seen[k + 2] for k in (0, size))
            prior = (good + PRIOR_DOCUMENTS * PRIOR_GOOD) / (good + bad + PRIOR_DOCUMENTS)
            return F.concat(F.array(prior), F.transform(c, lambda x, i: x / in_rule(i)))

        return _bound(counts, shares)

    def one_round(p: Column, _: Column) -> Column:
        ratios = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.log(F.get(p, i + size) / F.get(p, i)))
        return _bound(_bound(ratios, lambda r: expected(p, r)), maximised)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), numbers(start), one_round)


def fit(voted: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict[str, list[list[float]]]]:
    """Expectation-maximisation over the vote patterns, at most 3**rules structs in one row; one job for all rounds."""
    at = F.array(*[(F.col(name) + 3 * k).cast("int") for k, name in enumerate(names)])
    patterns = voted.groupBy(at.alias("at")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("patterns"))
    p = gathered.select(_estimated(F.col("patterns"), len(names), rounds).alias("p")).first()["p"]
    cell = lambda c, k: p[1 + 3 * (c * len(names) + k) :][:3]
    return p[0], {name: [cell(0, k), cell(1, k)] for k, name in enumerate(names)}


def judged(docs: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """Counts, votes, posterior and verdict of every document, with docs' columns in keep."""
    rules = votes()
    voted = written(features(docs, keep).select("*", *[v.cast("int").alias(f"vote_{n}") for n, v in rules.items()]), "quality-votes")
    names = [f"vote_{n}" for n in rules]
    prior, table = fit(voted, names, rounds)
    return (
        voted.withColumn("base_failed", base_failed())
        .withColumn("quality", _posterior(names, prior, table))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with docs' columns as they are."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select("doc_id", "text", *[column(c).alias(n) for c, n in own.items()])
    return judged(plain, list(own.values()), threshold).where("kept").select(*[F.col(n).alias(c) for c, n in own.items()])


def op9_weak_supervision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("_id").alias("doc_id"), *columns, F.round("quality", 6).alias("quality"))
