"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose statistic is above a cutoff. Cutoffs are not set by hand:
labelled documents of a stratum (a language) are split by hash into a tuning part and a holdout.
The tuning part proposes one sequence for all rules together, from lenient to strict: each step
tightens the rule that rejects the most bad documents more for each good one, and the documents
rejected are those of any rule. The holdout certifies the steps in order. A step is certified if, were
the rules together to reject a good document with a probability above `risk`, as few rejected good
documents as the holdout shows would come up with a probability (exact binomial) of `error` / strata
at most. The first step that fails ends the sequence, so the sequence needs no further correction, and
with a confidence of 1 - `error` no stratum loses more than `risk` of its good documents. The last
certified step gives the cutoffs. With risk and error of 5 % and five strata, 90 good documents without
a rejection certify a step; a stratum with fewer certifies nothing and keeps all.

Texts are split and counted by their hash: copies are on one side, and count once, as the bound is for
independent documents. Near copies still count one by one.

Strata are a fixed list, and documents are counted by the places of their statistics between the
cutoffs, so what the driver gets is bounded by the grids; it is taken over all labelled documents.

Defined results: a null or empty text has no words and fails the base rule; a null or unlisted
language belongs to the stratum `other`; a document with several labels, and a text of several
documents, is good if all say so; repeated rows are judged alike; an empty table gives an empty table;
without labels, only the base rule decides; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, checkpointed, map_rows, quoted, table

STRATA = ("en", "de", "fr", "es", "other")
RISK, ERROR = 0.05, 0.05
#: Labelled documents of which one in this many tunes; the others are the holdout.
TUNE_ONE_IN = 4
#: Bad tuning documents that a step must reject for each good one.
MIN_ODDS = 10

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
STATS_DDL = ", ".join(f"{f} long" for f in FIELDS)

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_KEEP_SYMBOLS = bytes(c for c in range(256) if c not in _SYMBOLS)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The FIELDS of a text; lines count if they have a word, capitals are A-Z."""
    if not text:
        return (0,) * len(FIELDS)
    data = text.encode()
    words = data.split()  # bytes split at exactly 0x20 and 0x09 to 0x0D
    n_lines = n_dup = 0
    seen: set[bytes] = set()
    for line in data.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    codes = np.frombuffer(data, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        len(data.translate(None, _KEEP_SYMBOLS)),
        n_dup,
        repeated_words(words),
        n_lines,
        int(np.count_nonzero((codes >= 65) & (codes <= 90))),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # three numbers would not fit 64 bits
        pairs, n = np.unique(pairs, return_inverse=True)[1], len(words)
    windows = pairs[:-1] * len(number) + ids[2:] if n == len(number) else pairs[:-1] * n + ids[2:]
    kinds, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(kinds) == len(windows):
        return 0
    twice = counts[inverse] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def stats_column(text: pa.Array) -> pa.Array:
    rows = [text_stats(x.as_py()) for x in text]
    columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(FIELDS))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: Name, statistic of the FIELDS and the grid of cutoffs, from lenient to strict.
RULES = (
    ("symbols", lambda: _ratio("n_symbols", "n_words"), (3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.8, 0.65, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    ("dup_lines", lambda: _ratio("n_dup_lines", "n_lines"), (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("repeats", lambda: _ratio("n_repeat_words", "n_words"), (0.48, 0.45, 0.42, 0.39, 0.36, 0.33, 0.3, 0.27, 0.24, 0.21, 0.18, 0.15, 0.12, 0.1)),
    ("capitals", lambda: _ratio("n_capitals", "word_chars"), (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA[:-1]), lang).otherwise(F.lit(STRATA[-1]))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n and p."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def levels() -> list[Column]:
    """For each rule, how many cutoffs of its grid do not reject the document: the rest of the grid does."""

    def level(value: Column, grid: tuple[float, ...]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c >= value))

    return [level(value(), grid) for _, value, grid in RULES]


def proposed(places: np.ndarray, good: np.ndarray, bad: np.ndarray, sizes: list[int], risk: float, min_odds: float = MIN_ODDS) -> list[tuple[int, ...]]:
    """The sequence of steps: for each rule the place of its cutoff in the grid, -1 for none.

    places: a row for each kind of tuning document, by rule; good, bad: how many there are of it; sizes: of the grids.
    """
    cuts, steps = [-1] * len(sizes), []
    left, lost = np.ones(len(places), bool), 0
    while True:
        best = None
        for rule, size in enumerate(sizes):
            at = places[left, rule]
            lose, gain = (np.bincount(at, n[left], size + 1).cumsum() for n in (good, bad))
            for cut in range(cuts[rule] + 1, size):
                if gain[cut] and gain[cut] >= min_odds * lose[cut]:
                    value = gain[cut] / (lose[cut] + 1)
                    if best is None or value > best[0]:
                        best = value, rule, cut
                    break  # the most lenient one
        if best is None:
            return steps
        _, rule, cut = best
        cuts[rule] = cut
        gone = left & (places[:, rule] <= cut)
        lost += good[gone].sum()
        if lost > risk * good.sum():
            return steps
        left &= ~gone
        steps.append(tuple(cuts))


def certified(steps: list[tuple[int, ...]], places: np.ndarray, good: np.ndarray, risk: float, error: float) -> tuple[int, ...] | None:
    """The last step of the sequence before the first that the holdout's good documents (as for `proposed`) don't certify."""
    found = None
    for cuts in steps:
        rejected = int(good[(places <= np.array(cuts)).any(axis=1)].sum()) if len(good) else 0
        if binomial_at_most(rejected, int(good.sum()), risk) > error:
            break
        found = cuts
    return found


def calibrate(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule, from rows (doc_id, lang, text_hash, the FIELDS) and labels (doc_id, quality)."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("good"))
    names = [f"level_{k}" for k in range(len(RULES))]
    texts = (
        stats.join(good, "doc_id")
        .where(~base_failed())
        .groupBy("text_hash", stratum(F.col("lang")).alias("stratum"), *[x.alias(n) for x, n in zip(levels(), names, strict=True)])
        .agg(F.min("good").alias("good"))
    )
    tunes = (F.pmod(F.col("text_hash"), F.lit(TUNE_ONE_IN)) == 0).alias("tunes")
    found = texts.groupBy("stratum", tunes, *names).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).orderBy("stratum", *names).collect()

    def part(s: str, tunes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [r for r in found if (r["stratum"], r["tunes"]) == (s, tunes)]
        return np.array([[r[n] for n in names] for r in rows], np.int64).reshape(-1, len(RULES)), *(np.array([r[c] for r in rows], np.int64) for c in ("good", "bad"))

    cutoffs: dict[str, dict[str, float]] = {}
    for s in STRATA:
        steps = proposed(*part(s, True), [len(grid) for _, _, grid in RULES], risk)
        cuts = certified(steps, *part(s, False)[:2], risk, error / len(STRATA)) or ()
        cutoffs[s] = {name: grid[cut] for (name, _, grid), cut in zip(RULES, cuts, strict=False) if cut >= 0}
    return cutoffs


def failed_rules(cutoffs: dict[str, dict[str, float]], lang: Column) -> Column:
    """The names of the rules that reject a row with the FIELDS, as an array."""
    of = stratum(lang)
    tests = []
    for name, value, _ in RULES:
        limits = {s: c[name] for s, c in cutoffs.items() if name in c}
        if limits:
            hit = F.lit(False)
            for s, c in limits.items():
                hit = hit | ((of == s) & (value() > c))
            tests.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def stats_table(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash and the FIELDS of each row's whole text."""
    kind = dict(docs.dtypes)["doc_id"]
    columns = [F.col("text"), F.col("doc_id"), F.col("lang"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))]
    return map_rows(docs, columns, f"doc_id {kind}, lang string, text_hash long, {STATS_DDL}", lambda: lambda text, key, lang, h: (key, lang, h, *text_stats(text)))


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs, with their columns, that no rule rejects."""
    cutoffs = calibrate(stats_table(docs), labels, risk, error)
    bound_batches(docs.sparkSession)
    stats = F.arrow_udf(stats_column, f"struct<{', '.join(f'{f}: bigint' for f in FIELDS)}>")
    # The row as one column, so that no name in it can clash with a field.
    judged = docs.select(F.struct(*quoted(docs)).alias("row"), stats(F.col("text")).alias("stats")).select("row", "stats.*")
    return judged.where(~base_failed() & (F.size(failed_rules(cutoffs, F.col("row.lang"))) == 0)).select("row.*")


def op1_quality_rules(spark, sf_dir):
    stats = checkpointed(stats_table(table(spark, sf_dir, "documents")))
    cutoffs = calibrate(stats, table(spark, sf_dir, "labels"))
    rules = failed_rules(cutoffs, F.col("lang"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (F.size(rules) == 0)).alias("kept"), stratum(F.col("lang")).alias("stratum"), F.array_join(rules, ",").alias("rules")
    )
