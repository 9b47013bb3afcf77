"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Four rule scores are computed per document (higher is worse). A labelled
holdout gives, per stratum, rule and candidate cutoff, how many documents of
good quality the rule would reject. A document is rejected if any rule rejects it, so
each rule may spend its part of ``alpha``: a cutoff is certified when the exact
binomial tail P[Bin(n, alpha / rules) <= k] is at most delta / (number of tests), a
Bonferroni correction over all strata, rules and cutoffs; the smallest certified
cutoff is used. With probability 1 - delta all rules together reject at most ``alpha`` of
the good documents of any stratum. A stratum without a certified cutoff is not
filtered by that rule.

Defined results: a null or blank text has zero words and fails the base rule;
a null stratum is a stratum of its own; labels that are null, or documents that
have both a good and a bad label, do not count in the holdout; repeated rows
are judged one by one, but a labelled id is one trial (of its texts the one that
comes first by stratum and scores); an empty label table certifies
nothing; an empty document table gives an empty result. Extra columns never
reach the operator's own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.llm.common import SPACE, cut, free_name, own

#: Rules and their candidate cutoffs, loosest last.
CUTOFFS = {
    "word_length": [float(x) for x in (6, 7, 8, 9, 10, 12, 14, 16, 20, 24)],
    "symbol_share": [0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2],
    "dup_line_share": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6],
    "repeat_share": [0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18],
}
#: Share of a stratum's good documents that all rules together may reject, and the
#: probability that they reject more.
ALPHA = 0.04
DELTA = 0.05
#: Certified cutoffs are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 100_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(ws: Column, n: Column, window: int = 5) -> Column:
    """Words inside windows that occur twice or more, first occurrence included.

    Windows are hashed; only a document with a repeated hash pays for the
    second step, which sorts (hash, position) and unions the covered positions.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), n - F.lit(window)),
        lambda i: F.xxhash64(*[F.get(ws, i + F.lit(j)) for j in range(window)]),
    )

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")
            ),
            lambda acc: acc["n"],
        )

    def same(pairs: Column, p: Column, at: Column) -> Column:
        return F.coalesce(F.get(pairs, at)["h"] == p["h"], F.lit(False))

    def repeated(pairs: Column) -> Column:
        hits = F.filter(
            pairs, lambda p, k: same(pairs, p, k - F.lit(1)) | same(pairs, p, k + F.lit(1))
        )
        return covered(F.sort_array(F.transform(hits, lambda p: p["i"])))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(pairs, repeated)).otherwise(F.lit(0))

    return F.when(n >= window, _let(hashes, count)).otherwise(F.lit(0))


def with_measures(df: DataFrame, text: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the rule inputs; returns the names given to them."""
    names = free_name(
        df, "q_text", "q_words", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "q_lines",
    )
    t, ws, n, chars, sym, dup, rep, failed, lines = names
    c = F.col
    df = df.withColumn(t, F.coalesce(c(text), F.lit("")))
    df = df.withColumn(ws, _words(c(t))).withColumn(
        lines, F.filter(F.split(c(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    df = df.withColumn(n, F.size(ws))
    df = df.withColumns(
        {
            chars: F.char_length(F.array_join(c(ws), "")).cast("long"),
            sym: F.regexp_count(c(t), F.lit(r"[#*$%&|<>]")).cast("long"),
            dup: (F.size(lines) - F.size(F.array_distinct(c(lines)))).cast("long"),
            rep: _repeat_words(c(ws), c(n)).cast("long"),
        }
    )
    df = df.withColumn(n, c(n).cast("long"))
    df = df.withColumn(failed, (c(n) < 10) | (100 * c(rep) > 20 * c(n)))
    return df.drop(t, ws, lines), {
        "n_words": n, "word_chars": chars, "n_symbols": sym, "n_dup_lines": dup,
        "n_repeat_words": rep, "base_failed": failed,
    }


def scores(m: dict[str, str]) -> dict[str, Column]:
    """Rule scores from the measures; zero words score zero everywhere."""
    c = lambda k: F.col(m[k]).cast("double")
    safe = F.greatest(c("n_words"), F.lit(1.0))
    return {
        "word_length": c("word_chars") / safe,
        "symbol_share": c("n_symbols") / F.greatest(c("word_chars"), F.lit(1.0)),
        "dup_line_share": c("n_dup_lines") * 5.0 / safe,
        "repeat_share": c("n_repeat_words") / safe,
    }


def _log_tail(n: Column, k: Column, p: float) -> Column:
    """log P[Bin(n, p) <= k], summed exactly term by term in log space."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = n.cast("double") * F.lit(math.log1p(-p))
    acc = F.struct(start.alias("t"), start.alias("s"))

    def step(a, i):
        j = i.cast("double")
        t = a["t"] + F.log((n - j + 1.0) / j) + F.lit(odds)
        hi, lo = F.greatest(a["s"], t), F.least(a["s"], t)
        return F.struct(t.alias("t"), (hi + F.log1p(F.exp(lo - hi))).alias("s"))

    return F.when(
        k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), k), acc, step, lambda a: a["s"])
    ).otherwise(start)


def certify(
    scored: DataFrame, stratum: str, good: str, alpha: float = ALPHA, delta: float = DELTA,
    cutoffs: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Certified cutoff per stratum: ``stratum`` and one column per rule.

    ``scored`` has one row per labelled document: the stratum, whether it is
    good, and a column per rule score. Every rule gets an equal part of ``alpha``.
    """
    import math

    cutoffs = CUTOFFS if cutoffs is None else cutoffs
    tests = sum(map(len, cutoffs.values()))
    alpha = alpha / max(1, len(cutoffs))
    good_rows = scored.filter(F.col(good))
    sums = [
        F.sum((F.col(rule) > F.lit(x)).cast("long")).alias(f"{rule}_{i}")
        for rule, xs in cutoffs.items()
        for i, x in enumerate(xs)
    ]
    counts = good_rows.groupBy(F.col(stratum).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), *sums
    )
    strata = counts.select(F.count(F.lit(1)).alias("n_strata"))
    counts = counts.crossJoin(F.broadcast(strata))  # one row, by construction
    limit = F.lit(math.log(delta)) - F.log(F.col("n_strata").cast("double") * tests)
    out = [F.col("stratum")]
    for rule, xs in cutoffs.items():
        ok = None
        for i, x in reversed(list(enumerate(xs))):
            k = F.col(f"{rule}_{i}")
            # a tail at or below the mean cannot be small; that skips long sums
            passes = (k < F.lit(alpha) * F.col("n")) & (_log_tail(F.col("n"), k, alpha) <= limit)
            ok = F.when(passes, F.lit(x)).otherwise(ok if ok is not None else F.lit(None).cast("double"))
        out.append(ok.alias(rule))
    return counts.select(*out)


def _holdout(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    """One row per labelled document whose labels agree."""
    return (
        labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
        .groupBy(F.col(doc_id).alias("l_id"))
        .agg(F.min(quality).alias("lo"), F.max(quality).alias("hi"))
        .filter(F.col("lo") == F.col("hi"))
        .select("l_id", (F.col("lo") == 1).alias("l_good"))
    )


def measured(docs: DataFrame, doc_id: str, text: str, stratum: str, mark: Column | None = None) -> DataFrame:
    """(doc_id, stratum, mark, measures, scores), one narrow row per document."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"),
        (F.lit(0) if mark is None else mark).alias("mark"),
    )
    df, m = with_measures(narrow, "text")
    return df.select("doc_id", "stratum", "mark", *m.values(), *[e.alias(r) for r, e in scores(m).items()])


def cutoffs_for(rows: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Certified cutoffs from measured rows that pass the base rule; a trial per labelled id."""
    held = rows.filter(~F.col("base_failed")).join(
        _holdout(labels, "doc_id", "quality"), F.col("doc_id") == F.col("l_id")
    )
    one = held.groupBy("l_id", "l_good").agg(F.min(F.struct("stratum", *CUTOFFS)).alias("first"))
    return certify(one.select("l_good", "first.*"), "stratum", "l_good", alpha, delta)


def _small(limits: DataFrame) -> DataFrame:
    limits = cut(limits)
    return F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits


def _verdict(rules: dict[str, Column], limit) -> Column:
    bad = F.lit(False)
    for rule, score in rules.items():
        bad = bad | F.coalesce(score > limit(rule), F.lit(False))
    return ~bad


def _judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with ``kept``."""
    limits = limits.select(F.col("stratum").alias("s_key"), *[F.col(r).alias(f"max_{r}") for r in CUTOFFS])
    joined = rows.join(limits, F.col("stratum").eqNullSafe(F.col("s_key")), "left")
    keep = ~F.col("base_failed") & _verdict(
        {r: F.col(r) for r in CUTOFFS}, lambda r: F.col(f"max_{r}")
    )
    return joined.withColumn("kept", keep).drop("s_key")


def judge(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """Measures, base verdict and risk-controlled verdict of every document."""
    rows = cut(measured(docs, doc_id, text, stratum))
    return _judged(rows, _small(cutoffs_for(rows, labels, alpha, delta)))


def keep_good(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """The documents that :func:`judge` keeps, with their own columns only.

    Texts are measured once; the rejected rows, named by id, stratum and a hash of the
    text, then leave through an anti-join.
    """
    mark = lambda: F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(stratum))
    rows = cut(measured(docs, doc_id, text, stratum, mark()))
    limits = _small(cutoffs_for(rows, labels, alpha, delta))
    gone = _judged(rows, limits).filter(~F.col("kept"))
    of_id, of_mark, own_mark = free_name(docs, "of_id", "of_mark", "own_mark")
    gone = gone.select(F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark)).distinct()
    marked = docs.withColumn(own_mark, mark())
    same = F.col(doc_id).eqNullSafe(F.col(of_id)) & (F.col(own_mark) == F.col(of_mark))
    return marked.join(gone, same, "left_anti").select(*own(docs))
