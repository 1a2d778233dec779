"""Quality rules as weak supervision: rules vote or abstain, EM weighs them."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sulatan.llm.store import docs_of, save

BLANK = r"[ \x09-\x0D]+"
RUN = 5


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    """1 for good, 0 for bad, null to abstain."""
    return F.when(bad, 0).when(good, 1)


#: rule name -> (measure, good if, bad if); between the two a rule abstains
RULES: dict[str, tuple[Column, object, object]] = {
    "symbols": (lambda: _share("n_symbols", "n_words"), lambda v: v <= 0.01, lambda v: v > 0.1),
    "upper": (lambda: _share("n_upper", "word_chars"), lambda v: v <= 0.1, lambda v: v > 0.3),
    "letters": (lambda: _share("n_letters", "word_chars"), lambda v: v >= 0.8, lambda v: v < 0.65),
    "bare": (lambda: _share("n_bare", "n_words"), lambda v: v <= 0.02, lambda v: v > 0.2),
    "lines": (lambda: _share("n_dup_lines", "n_lines"), lambda v: v <= 0.02, lambda v: v > 0.3),
    "repeats": (lambda: _share("n_repeat_words", "n_words"), lambda v: v <= 0.03, lambda v: v > 0.15),
    "word_size": (lambda: _share("word_chars", "n_words"), lambda v: (v >= 3) & (v <= 9), lambda v: (v < 2.5) | (v > 12)),
    "shouts": (lambda: _share("n_shouts", "n_words"), lambda v: v <= 0.01, lambda v: v > 0.1),
    "stops": (lambda: _share("n_stops", "n_words"), lambda v: v >= 0.02, lambda v: (v == 0) & (F.col("n_words") >= 50)),
}


def measures(docs: DataFrame) -> DataFrame:
    """Counts per row of ``docs(row, text)``, all by built-in functions; ``row`` is passed on.

    Repeated windows: 64-bit window hashes are compared; only rows that have a
    repeat sort them, and the covered words follow from the sorted positions.
    """
    words = docs.select("row", F.coalesce("text", F.lit("")).alias("text")).select(
        "row", "text", F.array_remove(F.split("text", BLANK), "").alias("words"))
    left = words.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        F.char_length(F.regexp_replace("text", r"[^\p{L}\p{M}]+", "")).alias("n_letters"),
        F.regexp_count("text", F.lit("!")).alias("n_shouts"),
        F.regexp_count("text", F.lit("[.?!]")).alias("n_stops"),
        # words without a letter
        F.regexp_count("text", F.lit(r"(?<![^ \x09-\x0D])[^\p{L} \x09-\x0D]+(?![^ \x09-\x0D])")).alias("n_bare"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")).alias("lines"),
        F.expr(f"transform(slice(words, 1, greatest(size(words) - {RUN - 1}, 0)), (w, i) -> xxhash64(w, {', '.join(f'words[i + {k}]' for k in range(1, RUN))}))").alias("runs"),
    )
    left = left.select("*", F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")).drop("lines")
    left = left.withColumn("sorted", F.expr("case when size(array_distinct(runs)) < size(runs) then sort_array(transform(runs, (x, i) -> struct(x as h, i as i))) end")).drop("runs")
    left = left.withColumn("at", F.expr("sort_array(transform(filter(sorted, (x, k) -> x.h <=> get(sorted, k - 1).h or x.h <=> get(sorted, k + 1).h), x -> x.i))")).drop("sorted")
    covered = F.expr(f"aggregate(transform(at, (x, k) -> least({RUN}, coalesce(get(at, k + 1) - x, {RUN}))), 0L, (a, v) -> a + v)")
    return left.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")


def fit_rules(votes: DataFrame, names: list[str], rounds: int = 40, tol: float = 1e-5) -> tuple[float, dict[str, tuple[float, float]]]:
    """EM on ``votes(<rule columns>, n)``, one row per vote pattern.

    Returns the share of good texts and, per rule, how often its votes are
    right on good and on bad texts. Patterns number at most ``3 ** rules``,
    whatever the number of texts, so their counts are taken to the driver.
    """
    rows = [(tuple(r[k] for k in names), r["n"]) for r in votes.orderBy(*names).collect()]
    total = sum(n for _, n in rows)
    # start: a rule seldom fires on good text and catches only some of the bad
    prior, right = 0.8, {r: (0.999, 0.3) for r in names}
    for _ in range(rounds if total else 0):
        start, adds = _odds(prior, right)
        good = [n / (1 + exp(-start - sum(adds[k][v] for k, v in enumerate(vote) if v is not None))) for vote, n in rows]

        def rate(k: int, vote: int, weights: list[float], share: float) -> float:
            # ten virtual votes at the starting rates keep rates off 0 and 1
            cast = [(v[k], w) for (v, _), w in zip(rows, weights) if v[k] is not None]
            return (sum(w for v, w in cast if v == vote) + 10 * share) / (sum(w for _, w in cast) + 10)  # noqa: B023

        bad = [n - g for (_, n), g in zip(rows, good)]
        new_prior, new = (sum(good) + 9) / (total + 10), {r: (rate(k, 1, good, 0.999), rate(k, 0, bad, 0.3)) for k, r in enumerate(names)}
        moved = max([abs(new_prior - prior), *(abs(x - y) for r in names for x, y in zip(new[r], right[r]))])
        prior, right = new_prior, new
        if moved < tol:
            break
    return prior, right


def _odds(prior: float, right: dict[str, tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log-odds of a good text before any vote, and what each rule's bad and good vote adds."""
    return log(prior) - log(1 - prior), [(log((1 - good) / bad), log(good / (1 - bad))) for good, bad in right.values()]


def posterior(prior: float, right: dict[str, tuple[float, float]]) -> Column:
    """Probability of a good text given its votes."""
    start, adds = _odds(prior, right)
    odds = F.lit(start)
    for r, (no, yes) in zip(right, adds):
        odds = odds + F.when(F.col(r) == 1, yes).when(F.col(r) == 0, no).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def _votes(seen: DataFrame) -> DataFrame:
    return seen.select("*", *(_vote(m(), good(m()), bad(m())).alias(r) for r, (m, good, bad) in RULES.items()))


def _verdict(votes: DataFrame, patterns: DataFrame, threshold: float) -> DataFrame:
    """Adds ``base_failed``, ``p_good`` and ``kept``; EM runs on the pattern counts."""
    prior, right = fit_rules(patterns, list(RULES))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    p = posterior(prior, right)
    return votes.withColumns({"base_failed": failed, "p_good": p, "kept": ~failed & (p >= threshold)})


def _patterns(votes: DataFrame) -> DataFrame:
    return votes.groupBy(*RULES).agg(F.count("*").alias("n"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Base counts, each rule's vote, ``p_good`` and ``kept`` for every row.

    Words are runs without ASCII white space. ``base_failed``: fewer than 10
    words, or over 20 % of the words in 5-word windows found twice or more.
    ``kept``: not ``base_failed`` and posterior quality of at least
    ``threshold``. Rules vote good (1), bad (0) or abstain (null); EM over the
    counts of vote patterns of all rows estimates how often each is right.

    Null and empty texts have no words and fail the base rule; a null id is
    kept as a row; repeated rows are judged separately and alike; extra
    columns are ignored; an empty table gives no rows.
    """
    rows = docs_of(docs, id_col, text_col).withColumnRenamed("doc_id", "row")
    votes = _votes(save(measures(rows), "measures"))
    out = _verdict(votes, _patterns(votes), threshold)
    return out.select(F.col("row").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good", *RULES)


def good_rows(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that `quality_rules` keeps, with all their columns.

    Rows are written with their measures, so the measures are taken once and
    no text is shuffled.
    """
    rows = docs.select(F.struct("*").alias("row"), docs[text_col].cast("string").alias("text"))
    votes = _votes(save(measures(rows), "measures"))
    return _verdict(votes, _patterns(votes), threshold).where("kept").select("row.*")
