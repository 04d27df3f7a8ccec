"""Quality rules with risk-controlled cutoffs, in DataFrame and SQL functions only.

measure() counts each whole text within its own row: no shuffle. One combined risk
score is the largest of several rates over their usual limits. Labelled documents,
which nothing else is fitted on, are the holdout: for each stratum (language), a
cutoff counts as certified if an exact binomial bound shows that it rejects at most
ALPHA of good documents, at a confidence that Bonferroni's correction shares out over
all strata and cutoffs. The certified cutoff that gains most is used; without one,
only the base rules reject.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, save, scratch

#: At most this share of a stratum's good documents may be rejected by the method ...
ALPHA = 0.02
#: ... with all strata and cutoffs together wrong with at most this probability.
DELTA = 0.05
#: Cutoffs are FIRST * RATIO ** j for j below CUTOFFS.
FIRST, RATIO, CUTOFFS = 0.05, 1.1, 60
#: Cutoffs of up to so many strata are broadcast; more are joined by a shuffle.
MOST_BROADCAST_STRATA = 100_000
#: The stratum of null languages; those of others begin with "=".
OTHER = "*"

#: Where a rate is usual in bad text: symbols and capitals and exclamation marks in all
#: word characters, repeated lines in all, repeated words in all, characters in a word.
LIMITS = {"symbols": 0.10, "marks": 0.08, "capitals": 0.50, "dup_lines": 0.50, "repeats": 0.50, "word_length": 20.0}

#: Words are runs without these: space and U+0009 to U+000D.
#: The backslashes are doubled for SQL literals.
_SPACE = r"[\\x20\\x09-\\x0D]+"
_WORD = r"[^\\x20\\x09-\\x0D]"
_WINDOW_HASH = "xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))"


def measure(docs: DataFrame, into: str = "rules") -> DataFrame:
    """``docs`` (text, any others) with one more struct column: the counts and the risk score.

    Null text counts as empty. Repeated words are those in 3-word windows found twice or
    more: window hashes and positions share one sorted array of longs, and neighbours that
    share a hash are compared word by word. Where two different windows share one, the
    windows themselves are sorted. Save the result before filtering by it, or Spark may
    measure texts more than once.
    """
    t = "coalesce(cast(text as string), '')"
    p = free_prefix(docs)
    own = lambda sql: re.sub(r"(?<![\w'])_(?=[a-z]\b)", p, sql)  # noqa: E731  _t, _w and so on are columns of our own
    # counted where words and lines are known; Catalyst keeps such projections apart
    step = docs.selectExpr("*", *map(own, (f"{t} as _t", f"array_remove(split({t}, '{_SPACE}'), '') as _w", f"filter(split({t}, '\\n'), x -> x rlike '{_WORD}') as _l",)))
    step = step.selectExpr("*", *map(own, ("size(_w) as _n", "cast(ceil(log2(size(_w) + 2)) as int) as _b",)))
    step = step.selectExpr("*", *map(own, (f"if(_n < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, _n - 3), i -> shiftleft({_WINDOW_HASH}, _b) | i))) as _s",)))
    step = step.selectExpr("*", *map(own, ("if(size(_s) < 2, cast(array() as array<struct<p:int,q:int>>), filter(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1), (x, y) -> if(shiftright(x ^ y, _b) = 0, struct(cast(x & (shiftleft(1L, _b) - 1) as int) as p, cast(y & (shiftleft(1L, _b) - 1) as int) as q), null)), z -> z is not null)) as _z",)))
    same = "get(_w, z.p) = get(_w, z.q) and get(_w, z.p + 1) = get(_w, z.q + 1) and get(_w, z.p + 2) = get(_w, z.q + 2)"
    step = step.selectExpr("*", *map(own, (f"if(forall(_z, z -> {same}), cast(array() as array<struct<k:string,i:int>>), sort_array(transform(sequence(0, _n - 3), i -> named_struct('k', concat_ws(' ', get(_w, i), get(_w, i + 1), get(_w, i + 2)), 'i', i)))) as _e",)))
    step = step.selectExpr("*", *map(own, ("array_sort(array_distinct(flatten(if(size(_e) = 0, transform(_z, z -> array(z.p, z.q)), filter(zip_with(slice(_e, 1, size(_e) - 1), slice(_e, 2, size(_e) - 1), (x, y) -> if(x.k = y.k, array(x.i, y.i), null)), z -> z is not null))))) as _p",)))
    counts = {
        "n_words": "cast(_n as bigint)",
        "word_chars": "cast(length(translate(_t, ' \\t\\n\\u000B\\u000C\\r', '')) as bigint)",
        "n_symbols": f"cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as bigint)",
        "n_dup_lines": "cast(size(_l) - size(array_distinct(_l)) as bigint)",
        "n_repeat_words": "cast(aggregate(_p, named_struct('e', 0, 'c', 0), (a, p) -> named_struct('e', p + 3, 'c', a.c + p + 3 - greatest(a.e, p)), a -> a.c) as bigint)",
        "n_lines": "cast(size(_l) as bigint)",
        "n_marks": "cast(regexp_count(_t, '[!?]') as bigint)",
        "n_capitals": "cast(regexp_count(_t, '[A-Z]') as bigint)",
    }
    step = step.selectExpr(*[f"`{c}`" for c in docs.columns], own(f"named_struct({', '.join(f"'{k}', {v}" for k, v in counts.items())}) as _c"))
    rate = {"symbols": "_c.n_symbols / greatest(1, _c.word_chars)", "marks": "_c.n_marks / greatest(1, _c.word_chars)", "capitals": "_c.n_capitals / greatest(1, _c.word_chars)", "dup_lines": "_c.n_dup_lines / greatest(1, _c.n_lines)", "repeats": "_c.n_repeat_words / greatest(1, _c.n_words)", "word_length": "_c.word_chars / greatest(1, _c.n_words)"}
    risk = f"greatest({', '.join(f'{v} / {LIMITS[k]}D' for k, v in rate.items())})"
    step = step.selectExpr("*", *map(own, (f"{risk} as _r",)))
    bucket = f"cast(least({CUTOFFS}, ceil(ln(greatest(_r / {FIRST}, 1D)) / {math.log(RATIO)})) as int)"
    failed = "_c.n_words < 50 or 100 * _c.n_repeat_words > 50 * _c.n_words"
    fields = [f"'{k}', _c.{k}" for k in counts] + ["'risk', _r", f"'bucket', {bucket}", f"'base_failed', {failed}"]
    return step.selectExpr(*[f"`{c}`" for c in docs.columns], own(f"named_struct({', '.join(fields)})") + f" as `{into}`")


def stratum_of(lang: Column) -> Column:
    return F.when(lang.isNull(), OTHER).otherwise(F.concat(F.lit("="), lang.cast("string")))


def cutoffs(measured: DataFrame, labels: DataFrame, rules: str = "rules") -> DataFrame:
    """stratum, cutoff: the chosen bucket for each stratum that has a certified one.

    A document is rejected if its bucket is above the cutoff. Each labelled language is a stratum, and null ones are one.
    """
    good = F.col("quality") == 1
    held = measured.select(F.col("doc_id"), stratum_of(F.col("lang")).alias("lang"), F.col(f"{rules}.bucket").alias("bucket")).join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    counts = held.groupBy("lang", "bucket").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    counts = save(counts, "rule_counts")
    counts = counts.withColumnRenamed("lang", "stratum")
    total = counts.groupBy("stratum").agg(F.sum("good").alias("n"), F.sum("bad").alias("m"))
    tests = total.count() * CUTOFFS
    every = total.withColumn("cutoff", F.explode(F.sequence(F.lit(0), F.lit(CUTOFFS - 1))))
    above = counts.withColumn("cutoff", F.explode(F.sequence(F.lit(0), F.col("bucket")))).where("cutoff < bucket")
    above = above.groupBy("stratum", "cutoff").agg(F.sum("good").alias("k"), F.sum("bad").alias("hit"))
    tried = every.join(above, ["stratum", "cutoff"], "left").fillna(0, ["k", "hit"])
    # ln P(X <= k) for X ~ Binomial(n, ALPHA), summed in logarithms; k >= ALPHA * n can't be certified
    start = f"n * {math.log1p(-ALPHA)}D"
    term = f"a.t + ln((n - i + 1) / i * {ALPHA / (1 - ALPHA)}D)"
    bound = f"aggregate(if(k = 0, cast(array() as array<bigint>), sequence(1L, k)), named_struct('t', {start}, 's', {start}), (a, i) -> named_struct('t', {term}, 's', greatest(a.s, {term}) + log1p(exp(-abs(a.s - ({term}))))), a -> a.s)"
    tried = tried.where(f"k < {ALPHA} * n and hit > 0").withColumn("ln_p", F.expr(bound))
    certified = tried.where(F.col("ln_p") <= math.log(DELTA / max(tests, 1)))
    gain = F.col("hit") / F.col("m") - F.col("k") / F.col("n")
    best = certified.groupBy("stratum").agg(F.max(F.struct(gain.alias("gain"), "cutoff")).alias("best"))
    strata = total.select("stratum").join(best, "stratum", "left")
    return strata.select("stratum", F.col("best.cutoff").alias("cutoff"))


def judge(measured: DataFrame, labels: DataFrame, rules: str = "rules", kept: str = "kept") -> DataFrame:
    """``measured`` with a boolean column: passes the base rules and its stratum's cutoff.

    Without labels or without a certified cutoff, the base rules alone decide. An empty
    table stays empty; repeated rows are judged alike; null and blank texts have no words
    and fail the base rules.
    """
    return judge_by(measured, learnt(measured, labels, rules), rules, kept)


def learnt(measured: DataFrame, labels: DataFrame, rules: str = "rules") -> DataFrame:
    """cutoffs() as a table that stays."""
    with scratch(measured.sparkSession):
        return save(cutoffs(measured, labels, rules), "cutoffs", keep=True)


def judge_by(measured: DataFrame, table: DataFrame, rules: str = "rules", kept: str = "kept") -> DataFrame:
    """judge() by cutoffs learnt before."""
    stratum, cutoff = (free_prefix(measured) + n for n in ("stratum", "cutoff"))
    own = table.where("cutoff is not null").select(F.col("stratum").alias(stratum), F.col("cutoff").alias(cutoff))
    few = own.count() <= MOST_BROADCAST_STRATA
    out = measured.join(F.broadcast(own) if few else own, stratum_of(F.col("lang")) == F.col(stratum), "left")
    fine = F.col(f"{rules}.bucket") <= F.coalesce(cutoff, F.lit(CUTOFFS))
    return out.withColumn(kept, ~F.col(f"{rules}.base_failed") & fine).drop(stratum, cutoff)
