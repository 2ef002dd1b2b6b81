"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Column expressions only. Every rule says good (1), bad (-1) or nothing (0) about a text. Texts
with the same votes are alike, so the votes are counted once over all documents: a table of at
most 3^rules rows. Expectation-maximisation over that table estimates the share of good texts and, for
good and bad texts apart, how often each rule votes each way when it does not abstain. The posterior probability of good then decides; no rule has to pass.

Words are runs of characters other than space and U+0009 to U+000D. Null and empty texts have
zero counts and fail the base rule. Repeated rows are judged each, and weigh each in the estimate; an empty
table gives an empty one. Columns of the input that are named like one made here get underscores
behind their names. Windows are equal if 64-bit hashes of their words' 64-bit hashes are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrove.runtime import materialize

from .names import set_aside

SPACE = "[ \\t-\\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_upper", "n_digits", "n_marks")
_INNER = ("_words", "_lines", "_h", "_bits", "_s", "_near", "_p")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts and those of the rules."""
    docs = set_aside(docs, (*COUNTS, *MORE_COUNTS, *_INNER))
    rest = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        *rest,
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
    )
    hashed = split.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    ).drop("_words", "_lines")
    # a window as one number: hash above, place below, so that sorting brings equal windows together;
    # the hash loses the bits of the place, so its repeats are compared again by whole hashes
    placed = hashed.select(
        "*", F.ceil(F.log2(F.col("n_words") + 1)).cast("int").alias("_bits")
    ).select(
        "*",
        F.sort_array(
            F.transform(
                F.expr("slice(_h, 1, greatest(size(_h) - 2, 0))"),
                _window,
            )
        ).alias("_s"),
    )
    near = placed.select(
        "*",
        F.expr("""
            sort_array(transform(
              filter(_s, (x, k) ->
                coalesce(shiftrightunsigned(get(_s, k - 1), _bits) = shiftrightunsigned(x, _bits), false)
                or coalesce(shiftrightunsigned(get(_s, k + 1), _bits) = shiftrightunsigned(x, _bits), false)),
              x -> named_struct(
                'key', xxhash64(
                  get(_h, cast(x & (shiftleft(1L, _bits) - 1L) as int)),
                  get(_h, cast(x & (shiftleft(1L, _bits) - 1L) as int) + 1),
                  get(_h, cast(x & (shiftleft(1L, _bits) - 1L) as int) + 2)),
                'place', x & (shiftleft(1L, _bits) - 1L))))
        """).alias("_near"),
    ).drop("_s")
    twice = near.select(
        "*",
        F.expr("""
            sort_array(transform(
              filter(_near, (x, k) ->
                coalesce(get(_near, k - 1).key = x.key, false) or coalesce(get(_near, k + 1).key = x.key, false)),
              x -> x.place))
        """).alias("_p"),
    )
    covered = F.expr(
        "aggregate(transform(_p, (x, k) -> least(3L, coalesce(get(_p, k + 1) - x, 3L))), 0L, (a, x) -> a + x)"
    )
    names = [*docs.columns, *COUNTS, *MORE_COUNTS]
    return twice.withColumn("n_repeat_words", covered).select(*[F.col(f"`{c}`") for c in names])


def _window(x: Column, i: Column) -> Column:
    h = F.col("_h")
    key = F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
    return F.call_function("shiftleft", key, F.col("_bits")).bitwiseOR(i.cast("long"))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the counts; limits on shares leave a band in which a rule abstains."""
    mean = _share("word_chars", "n_words")
    symbols, upper = _share("n_symbols", "n_words"), _share("n_upper", "word_chars")
    digits, marks = _share("n_digits", "word_chars"), _share("n_marks", "n_words")
    dup, repeat = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    return {
        "word_length": _vote(mean.between(3, 10), (mean < 2) | (mean > 15)),
        "symbols": _vote(symbols <= 0.05, symbols >= 0.3),
        "capitals": _vote(upper <= 0.1, upper >= 0.4),
        "digits": _vote(digits <= 0.1, digits >= 0.3),
        "marks": _vote(marks <= 0.05, marks >= 0.3),
        "dup_lines": _vote(dup <= 0.1, dup >= 0.3),
        "repeats": _vote(repeat <= 0.1, repeat >= 0.3),
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < 10),
    }


def _posterior(names: list[str], state: dict[str, float]) -> Column:
    """P(good | votes) under the estimates."""
    odds = F.lit(state["prior"])
    for name in names:
        odds = odds + F.when(F.col(name) > 0, state[f"{name}+"]).when(
            F.col(name) < 0, state[f"{name}-"]
        ).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(
    patterns: list[tuple[tuple[int, ...], int]], names: list[str], iterations: int = 500, tolerance: float = 1e-9
) -> dict[str, float]:
    """Log odds of the prior (``prior``) and of a good or bad vote of each rule (``rule+``, ``rule-``).

    Expectation-maximisation over (votes, number of texts), from rules that are right nine times
    in ten and one bad text in ten; a count of one is added to each estimate. Ends when no log
    odds move by ``tolerance``; ``iterations`` and ``moved`` come with the estimates, so that
    an unfinished fit shows.
    """
    patterns = sorted(patterns)
    nine = math.log(9.0)
    state = {"prior": nine} | {f"{x}+": 0.5 for x in names} | {f"{x}-": -nine for x in names}
    moved, done = math.inf, 0
    while done < iterations and moved > tolerance:
        share, votes = [1.0, 1.0], {(x, v): [1.0, 1.0] for x in names for v in (1, -1)}
        for cast, n in patterns:
            odds = state["prior"] + sum(state[x + "+-"[v < 0]] for x, v in zip(names, cast) if v)
            good = 1 / (1 + math.exp(-odds))
            for to in (share, *(votes[x, v] for x, v in zip(names, cast) if v)):
                to[0] += n * good
                to[1] += n * (1 - good)
        new = {"prior": math.log(share[0] / share[1])}
        for x in names:
            total = [votes[x, 1][i] + votes[x, -1][i] for i in (0, 1)]
            for sign, v in (("+", 1), ("-", -1)):
                new[x + sign] = math.log(votes[x, v][0] / total[0]) - math.log(votes[x, v][1] / total[1])
        moved = max(abs(new[k] - state[k]) for k in new)
        state, done = new, done + 1
    return state | {"iterations": done, "moved": moved}


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` but the text, the counts, votes, ``base_failed``, ``posterior`` and ``kept``.

    ``em_iterations`` and ``em_moved`` tell in each row how the estimate ended.
    """
    named = rules()
    names = [f"rule_{x}" for x in named]
    docs = set_aside(docs, (*names, "base_failed", "posterior", "kept", "em_iterations", "em_moved"))
    counted = materialize(with_counts(docs, text_col).drop(text_col), "quality-counts")
    voted = counted.withColumns(dict(zip(names, named.values())))
    votes = voted.groupBy(*names).agg(F.count("*").alias("n_texts")).collect()  # 3 ** rules at most
    state = estimate([(tuple(r)[:-1], r["n_texts"]) for r in votes], names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("posterior", _posterior(names, state))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .withColumn("em_iterations", F.lit(state["iterations"]))
        .withColumn("em_moved", F.lit(float(state["moved"])))
    )
