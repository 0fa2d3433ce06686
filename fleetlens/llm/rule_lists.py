"""Quality rules: base statistics of a text and a learned decision list, all in Spark expressions.

``statistics`` adds the base counts of a whole text. ``learn`` builds an ordered list of threshold
conjunctions by sequential covering on the statistics of labelled rows: a rule grows by the
condition of best information gain on two thirds of the rows, is pruned back to the prefix that
is most precise on the other third, and is kept if it is precise there; the rows it covers leave,
and the next rule is grown. Every step is one aggregate over the labelled statistics, of which the
driver sees only sums per feature and threshold. ``verdict`` is the list as one conditional
expression.

Defined results: a null or empty text has no words, all counts 0, and fails the base rule; equal
lines and words are compared exactly; without labelled rows of both classes the list is empty and
only the base rule rejects; rows with a null label teach nothing; repeated rows count each. A
column that has the name of an added one is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.common import SPACE, unique_name

WINDOW = 5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper_words", "n_distinct_words", "n_lines"]


def repeated_starts(placed: Column) -> Column:
    """Sorted starts of the windows whose hash occurs twice or more, from (hash, start) in hash order."""
    same = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
    found = F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))
    return F.sort_array(F.transform(found, lambda x: x["i"].cast("long")))


def covered(starts: Column) -> Column:
    """Words in the windows that begin at the sorted starts."""
    zero = F.lit(0).cast("long")
    first = F.struct(zero.alias("total"), zero.alias("end"))
    step = lambda acc, at: F.struct(
        (acc["total"] + WINDOW - F.greatest(zero, acc["end"] - at)).alias("total"), (at + WINDOW).alias("end"))
    return F.aggregate(starts, first, step, lambda acc: acc["total"])


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of BASE and EXTRA and ``base_failed``."""
    words, windows, lines, raw, placed = (
        unique_name(df, f"{x}_of_text") for x in ("words", "windows", "lines", "raw", "placed"))
    columns = df.columns
    df = df.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    trimmed = F.btrim(F.col(raw), F.lit(SPACE))
    df = df.withColumns({
        words: F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")),
        lines: F.filter(F.split(F.col(raw), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
    })
    w = F.col(words)
    df = df.withColumn(windows, F.when(
        F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>")))
    g = F.col(windows)
    # A column of its own: an expression inside a lambda would be computed anew for every element.
    df = df.withColumn(placed, F.when(
        F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    found = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(F.col(raw), F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered(repeated_starts(F.col(placed))), F.lit(0).cast("long")),
        "n_upper_words": F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(w)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }
    # One row stays one row; the generator keeps a later filter on the counts from being pushed
    # below, where their expressions would be nested into each other and computed many times.
    kept = [c for c in columns if c not in found and c != "base_failed"]
    df = df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))).alias(placed)).select(*kept, f"{placed}.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def features() -> dict[str, Column]:
    """What rules may ask for, from the statistics."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "upper_share": F.col("n_upper_words") / words,
        "distinct_share": F.col("n_distinct_words") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "words_a_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, or else value <= threshold
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the row, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(holds(rule), i) if out is None else out.when(holds(rule), i)
    return F.lit(0) if out is None else out.otherwise(0)


def thresholds(rows: DataFrame, cuts: int = 24) -> dict[str, list[float]]:
    """Candidate thresholds of each feature: quantiles of the bad rows and of the good ones."""
    shares = [i / cuts for i in range(1, cuts)]
    named = features()
    cells = [
        F.percentile_approx(F.when(F.col("bad") == bad, c), shares, 10000).alias(f"{name}_{bad}")
        for name, c in named.items() for bad in (0, 1)
    ]
    found = rows.agg(*cells).first()
    return {name: sorted({*(found[f"{name}_0"] or []), *(found[f"{name}_1"] or [])}) for name in named}


def grow_step(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, float, int, int] | None:
    """The condition of best gain among the rows, its gain, and the bad and good rows that it keeps."""
    cells = [
        F.struct(F.lit(name).alias("feature"), F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda t: t < c)).alias("bin"))  # noqa: B023
        for name, c in features().items() if cuts[name]
    ]
    if not cells:
        return None
    sums = rows.select("bad", F.explode(F.array(*cells)).alias("cell")).groupBy("cell.feature", "cell.bin").agg(
        F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in sums:
        by.setdefault(r.feature, {})[r.bin] = (r.p, r.n)
    best = None
    for name in sorted(by):
        bins, values = by[name], cuts[name]
        p_all, n_all = sum(p for p, _ in bins.values()), sum(n for _, n in bins.values())
        p_low = n_low = 0
        for i, threshold in enumerate(values):
            p_low, n_low = p_low + bins.get(i, (0, 0))[0], n_low + bins.get(i, (0, 0))[1]
            for above, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
                if p and (p, n) != (p_all, n_all):
                    gain = p * (math.log2(p / (p + n)) - math.log2(p_all / (p_all + n_all)))
                    if gain > 1e-9 and (best is None or gain > best[1]):
                        best = (Condition(name, above, threshold), gain, p, n)
    return best


def learn(labelled: DataFrame, label: str = "quality", key: str = "doc_id", most_rules: int = 8, most_conditions: int = 3,
          least_precision: float = 0.95, least_rows: int = 8) -> list[Rule]:
    """Decision list from rows that have the statistics and a label, 1 for good and 0 for bad texts."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        *BASE, *EXTRA, (1 - F.col(label)).cast("long").alias("bad"), (F.pmod(F.xxhash64(key, "word_chars"), F.lit(3)) == 0).alias("prunes"))
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.where(verdict(rules) == 0) if rules else rows
        grows = left.where(~F.col("prunes"))
        cuts = thresholds(grows)
        rule: Rule = ()
        while len(rule) < most_conditions:
            step = grow_step(grows.where(holds(rule)), cuts)
            if step is None:
                break
            rule += (step[0],)
            if step[3] == 0:
                break
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        sums = left.where(F.col("prunes")).agg(*[
            F.coalesce(F.sum(F.when(holds(r), x)), F.lit(0)).alias(f"{name}{i}")
            for i, r in enumerate(prefixes) for name, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))
        ]).first()
        seen = [(sums[f"p{i}"], sums[f"n{i}"]) for i in range(len(prefixes))]
        worth = [((p + 1) / (p + n + 2), p) for p, n in seen]
        best = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        p, n = seen[best]
        if p + n < least_rows or p < least_precision * (p + n):
            break
        rules.append(prefixes[best])
    return rules
