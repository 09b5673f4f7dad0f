"""Quality rules by weak supervision, in Spark expressions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over all documents' vote patterns
estimates each rule's accuracies on good and on bad documents, without labels; a document is kept by its posterior
probability of being good. The corpus enters the estimate as counts of vote patterns, at most 3 ** rules rows, and the
iterations are one fold over those counts.

Defined cases: null or blank text: no words, base_failed. Null ids stay. Repeated rows are scored alike. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

_SPACE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(words: Column, n: int = 5) -> Column:
    """Number of words that lie in n-word windows found at least twice."""

    def covered(wins: Column) -> Column:
        at = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def total(s: Column) -> Column:
            twin = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
            found = F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(twin(e, k), F.lit(False))), lambda e: e["i"]))
            start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum"))
            step = lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(n), i - a["last"])).alias("sum"))
            return F.aggregate(found, start, step, lambda a: a["sum"])

        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), 0).otherwise(let(at, total))

    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
    return F.when(F.size(words) < n, 0).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), covered))


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The statistics that base checks and rules use, of every whole text."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    words = F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", "[ \\t\\n\\x0B\\f\\r]+"))
    # lines keep their own white space; only whether they have a word looks past it
    full = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.btrim(s, F.lit(_SPACE)) != "")
    d = documents.select(F.col(key).alias("doc_id"), bare.alias("t"), full.alias("lines"))
    return d.select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("[^\\p{L} \\n.,;:'-]")).cast("long").alias("n_odd"),
    ).select("doc_id", "w.*", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_odd")


def rules() -> dict[str, Column]:
    """Votes by name: 1 good, -1 bad, 0 no opinion."""
    c = F.col
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    per_char = lambda x: c(x) / F.greatest(c("word_chars"), F.lit(1))
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    dup = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    return {
        "length": vote(c("n_words") >= 30, c("n_words") < 10),
        "word_length": vote(per_word("word_chars").between(3, 9), ~per_word("word_chars").between(2.2, 14)),
        "symbols": vote(per_word("n_symbols") < 0.02, per_word("n_symbols") > 0.1),
        "lines": vote(dup < 0.1, dup > 0.3),
        "repetition": vote(per_word("n_repeat_words") < 0.05, per_word("n_repeat_words") > 0.15),
        "upper_case": vote(per_char("n_upper") < 0.15, per_char("n_upper") > 0.3),
        "odd_characters": vote(per_char("n_odd") < 0.04, per_char("n_odd") > 0.08),
    }


def _logit(votes: Column, m: Column) -> Column:
    """Log odds of good: a is P(good vote | good), b is P(bad vote | bad)."""
    each = F.zip_with(votes, F.arrays_zip(m["a"].alias("a"), m["b"].alias("b")), lambda v, r: F.when(v == 1, F.log(r["a"] / (1 - r["b"]))).when(v == -1, F.log((1 - r["a"]) / r["b"])).otherwise(0.0))
    return F.aggregate(each, F.log(m["pi"] / (1 - m["pi"])), lambda s, x: s + x)


def _posterior(votes: Column, m: Column) -> Column:
    return 1 / (1 + F.exp(-_logit(votes, m)))


def fitted(votes: DataFrame, n_rules: int, rounds: int = 25, prior: float = 0.85) -> DataFrame:
    """One row: pi and the rules' accuracies a and b. ``votes`` has the column votes, array<int>."""
    patterns = votes.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("pats"))
    model = lambda pi, a, b: F.struct(pi.cast("double").alias("pi"), a.cast("array<double>").alias("a"), b.cast("array<double>").alias("b"))
    inside = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    start = model(F.lit(prior), F.array_repeat(F.lit(0.95), n_rules), F.array_repeat(F.lit(0.4), n_rules))

    def one(m: Column, _: Column) -> Column:
        weighed = F.transform("pats", lambda p: F.struct(p["votes"].alias("v"), p["n"].alias("n"), (p["n"] * _posterior(p["votes"], m)).alias("g")))

        def update(ps: Column) -> Column:
            total = lambda f: F.aggregate(ps, F.lit(0.0), lambda s, p: s + f(p))
            when = lambda ok, x: F.when(ok, x).otherwise(0.0)
            pi = (total(lambda p: p["g"]) + 0.85) / (total(lambda p: p["n"]) + 1)
            # a rule's accuracies start out near 0.95 and 0.4, as if it had been seen on a few documents
            a = F.array(*[(total(lambda p, j=j: when(p["v"][j] == 1, p["g"])) + 9.5) / (total(lambda p, j=j: when(p["v"][j] != 0, p["g"])) + 10) for j in range(n_rules)])
            b = F.array(*[(total(lambda p, j=j: when(p["v"][j] == -1, p["n"] - p["g"])) + 4) / (total(lambda p, j=j: when(p["v"][j] != 0, p["n"] - p["g"])) + 10) for j in range(n_rules)])
            # a good vote never speaks for bad: a stays at least 1 - b
            b = F.transform(b, lambda x: inside(x, 0.02, 0.99))
            a = F.zip_with(a, b, lambda x, y: F.least(F.greatest(x, F.lit(0.5), 1 - y), F.lit(0.9999)))
            return model(inside(pi, 0.3, 0.99), a, b)

        return let(weighed, update)

    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one).alias("m"))


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Statistics, votes and ``p_good`` of each document, with ``kept``: p_good of at least ``least`` and no base failure."""
    named = rules()
    f = measured(documents, key, text)
    f = f.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    f = written(f.withColumn("votes", F.array(*named.values())), "votes")
    m = fitted(f, len(named))
    p = f.crossJoin(F.broadcast(m)).withColumn("p_good", _posterior(F.col("votes"), F.col("m"))).drop("m")
    return p.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(table(spark, sf_dir, "documents"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
