"""Quality rules: a learned decision list over text statistics.

Statistics are Spark expressions, one row per document and no shuffle. A list of rules is learned
from a bounded sample of labelled rows by sequential covering: a rule grows threshold by threshold on two thirds of the
sample by information gain, is pruned on the rest, and is kept only if it is precise there; the
documents it covers leave and the next rule is grown. The list becomes one ordered CASE expression,
so that it is applied, as the statistics are, by DataFrame operations alone.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, materialise, read

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
#: Labelled rows that are fetched to learn from, at most: those whose hashed ids are smallest.
MAX_LABELLED = 20_000


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns BASE, and the ratios that rules may test (FEATURES); and columns of docs to keep, as numbers of rows.

    Null and empty texts, and texts of white space, have 0 everywhere. Rows that repeat an id or a text are counted
    alike. Windows are told apart by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("t"))
    df = df.select("doc_id", *keep, "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.split("t", "\n").alias("lines"))
    df = df.withColumn("lines", F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("w")
    window = lambda i: F.xxhash64(*[F.get(F.col("w"), (i + k).cast("int")) for k in range(WINDOW)])
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        "doc_id",
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size(F.filter("w", lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
        hashes.alias("h"),
    )
    repeats = F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0)).otherwise(_covered(F.col("h")))
    df = df.withColumn("n_repeat_words", repeats.cast("long")).drop("h")
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    ratios = {
        "word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"), "digit_ratio": per("n_digits", "word_chars"), "mark_ratio": per("n_marks", "n_words"), "diversity": F.when(F.col("n_words") > 1, F.log(F.col("n_distinct").cast("double")) / F.log(F.col("n_words").cast("double"))).otherwise(F.lit(1.0)), "short_ratio": per("n_short", "n_words"), "line_words": per("n_words", "n_lines"),
    }
    return df.select("doc_id", *keep, *BASE, *[v.alias(k) for k, v in ratios.items()])


FEATURES = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "diversity", "short_ratio", "line_words")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, place), keep those with an equal neighbour, join their spans."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    twice = lambda s: F.filter(s, lambda x, j: same(F.get(s, j + 1)["h"], x["h"]) | same(F.get(s, j - 1)["h"], x["h"]))
    places = F.array_sort(F.transform(let(pairs, twice), lambda x: x["i"]))
    span = lambda p: F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(WINDOW), F.get(p, j + 1) - x), F.lit(WINDOW)))
    return F.aggregate(let(places, span), F.lit(0), lambda a, x: a + x)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Documents that meet every (feature, '<=' or '>', threshold) are rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.tests:
            out = out & (F.col(name) <= F.lit(at) if sign == "<=" else F.col(name) > F.lit(at))
        return out

    def covers(self, row: dict) -> bool:
        return all(row[n] <= at if sign == "<=" else row[n] > at for n, sign, at in self.tests)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _grow(rows: list[dict], features: tuple[str, ...], most_tests: int) -> Rule:
    tests: tuple = ()
    while len(tests) < most_tests and any(not r["bad"] for r in rows) and rows:
        p0 = sum(r["bad"] for r in rows)
        n0, best = len(rows) - p0, (1e-9, None)
        for name in features:
            order = sorted(rows, key=lambda r: r[name])
            p = n = 0
            for a, b in zip(order, order[1:], strict=False):
                p, n = p + a["bad"], n + (not a["bad"])
                if a[name] != b[name]:
                    middle = (a[name] + b[name]) / 2
                    best = max(best, (_gain(p0, n0, p, n), (name, "<=", middle)), (_gain(p0, n0, p0 - p, n0 - n), (name, ">", middle)), key=lambda x: x[0])
        if best[1] is None:
            break
        tests += (best[1],)
        rows = [r for r in rows if Rule((best[1],)).covers(r)]
    return Rule(tests)


def _worth(rule: Rule, rows: list[dict]) -> float:
    """(p - n) / (p + n) on the pruning rows."""
    hit = [r["bad"] for r in rows if rule.covers(r)]
    return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0


def learn_rules(rows: list[dict], *, features: tuple[str, ...] = FEATURES, precision: float = 0.9, most_rules: int = 16, most_tests: int = 4, least_cover: int = 3) -> list[Rule]:
    """Sequential covering over rows that have the features and `bad`. Deterministic: every third row prunes.

    A rule is kept only if at least `precision` of the rows it covers, in both parts together, are bad, and it covers
    least_cover of them; the first that is not ends the list. No bad rows: no rules.
    """
    left, rules = list(rows), []
    while len(rules) < most_rules and sum(r["bad"] for r in left) >= least_cover:
        prune, grow = left[::3], [r for i, r in enumerate(left) if i % 3]
        if not any(r["bad"] for r in grow):
            break
        rule = _grow(grow, features, most_tests)
        if not rule.tests:
            break
        cuts = [Rule(rule.tests[:k]) for k in range(len(rule.tests), 0, -1)]
        rule = max(cuts, key=lambda c: _worth(c, prune))  # the longest of equals
        hit = [r["bad"] for r in left if rule.covers(r)]
        if sum(hit) < max(least_cover, precision * len(hit)):
            break
        rules.append(rule)
        left = [r for r in left if not rule.covers(r)]
    return rules


def fit_rules(statistics: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Learns from the rows of statistics that labels knows and the base rules pass; bad: label 0. Null labels and ids are left out."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = statistics.filter(~base_failed()).join(known, "doc_id").select("doc_id", *FEATURES, (F.col("label") == 0).alias("bad"))
    # a share of the hashes that holds about nine tenths of the bound, so that no more is sent to the driver
    share = min(1.0, 0.9 * max_labelled / max(1, known.count()))
    sample = sample.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = sorted((r.asDict() for r in sample.collect()), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).digest())
    return learn_rules(rows[:max_labelled], **options)


def kept(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: base rules first, then each learned rule, else keep."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def judge_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Statistics of every document (with columns to keep), base_failed, and kept: the verdict of base rules and learned list. No rows: no rows."""
    statistics = materialise(text_statistics(docs, id_col=id_col, text_col=text_col, keep=keep), "quality")
    rules = fit_rules(statistics, labels, **options)
    return statistics.withColumn("base_failed", base_failed()).withColumn("kept", kept(rules))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept")


__all__ = ["FEATURES", "Rule", "base_failed", "fit_rules", "judge_quality", "kept", "learn_rules", "text_statistics"]
