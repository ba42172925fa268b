r"""Quality rules: statistics, a base rule, and a learned decision list, all in DataFrame functions.

Statistics take words ``[^\x20\x09-\x0D]+`` of the whole text. Words in repeated 5-word windows are counted without
pairs: window hashes are sorted with their positions, windows equal to a neighbour are the repeated ones, and the gaps
between their positions give the words covered.

Method. Sequential covering: from labelled statistics a rule is grown, threshold by threshold, on two thirds of the rows
that pass the base rule and that no rule before it covers, then pruned on the last third while its precision there doesn't fall. A rule is kept if
it rejects bad rows with at least ``precision``; the list ends where none is found. It is emitted as ordered conditions,
one Spark ``when`` chain; what no rule covers is kept. The learner sees a bounded sample (``sample_rows`` labelled
rows, those of the smallest id hashes); the statistics and verdicts cover all rows.

Defined cases: a null text has no words and fails the base rule; documents without labels are judged as all others;
without any labelled row the list is empty; repeated labels of an id count by their mean, a tie as good; an empty
table gives an empty one.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import masked

WINDOW = 5
#: The counted symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Shares only: lengths of texts and words tell languages and genres apart before they tell quality.
FEATURES = ("symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+", -1), "")


def _window_hashes(w: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(w) - WINDOW)
    return F.when(F.size(w) >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(ordered: Column) -> Column:
    """ordered: sorted structs of window hash and position. Words in windows that have an equal neighbour there."""

    def same(k: Column, x: Column) -> Column:
        return F.coalesce(F.get(ordered, k)["h"] == x["h"], F.lit(False))

    twice = F.filter(ordered, lambda x, k: same(k + 1, x) | ((k > 0) & same(F.greatest(k - 1, F.lit(0)), x)))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step)["n"]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the shares rules are learned from.

    The names are prefixed with ``q_``, so that they don't clash with the input's columns.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.withColumn("q__w", split_words(F.col(f"`{text_col}`")))
    d = d.withColumn("q__h", _window_hashes(F.col("q__w")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    # Texts whose windows are all different, most of them, are done by a hash set and need no sort.
    pairs = F.transform("q__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("q__o", F.when(F.size(F.array_distinct("q__h")) < F.size("q__h"), F.array_sort(pairs)))
    joined = F.array_join("q__w", "")
    d = d.withColumns({
        "q_n_words": F.size("q__w").cast("long"),
        "q_word_chars": F.length(joined).cast("long"),
        "q_n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "q_n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "q_n_lines": F.size(lines).cast("long"),
        "q_n_repeat_words": F.when(F.col("q__o").isNull(), F.lit(0)).otherwise(_covered(F.col("q__o"))).cast("long"),
        "q__upper": F.length(F.regexp_replace(joined, r"[^A-ZÀ-ÖØ-Þ]+", "")),
        "q__mark": F.length(F.regexp_replace(joined, r"[^!?]+", "")),
    })
    chars, n = F.greatest("q_word_chars", F.lit(1)), F.greatest("q_n_words", F.lit(1))
    d = d.withColumns({
        "q_symbol_share": F.col("q_n_symbols") / chars,
        "q_upper_share": F.col("q__upper") / chars,
        "q_mark_share": F.col("q__mark") / chars,
        "q_dup_line_share": F.col("q_n_dup_lines") / F.greatest("q_n_lines", F.lit(1)),
        "q_repeat_share": F.col("q_n_repeat_words") / n,
    })
    return d.drop("q__w", "q__h", "q__o", "q__upper", "q__mark")


def base_failed() -> Column:
    return (F.col("q_n_words") < 10) | (100 * F.col("q_n_repeat_words") > 20 * F.col("q_n_words"))


Rule = list[tuple[str, str, float]]


def _holds(rule: Rule, x: dict[str, float]) -> bool:
    return all(x[f] >= t if op == ">=" else x[f] < t for f, op, t in rule)


def _counts(rule: Rule, rows: list[tuple[dict, int]]) -> tuple[int, int]:
    hit = [bad for x, bad in rows if _holds(rule, x)]
    return sum(hit), len(hit)


def learn(rows: list[tuple[dict, int]], precision: float = 0.99, least: int = 8, max_rules: int = 12, max_terms: int = 3) -> list[Rule]:
    """An ordered list of conjunctions. rows: (statistics, 1 for bad), in an order that doesn't follow the label."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < max_rules and sum(b for _, b in left) >= least:
        grow, prune = [r for i, r in enumerate(left) if i % 3], left[::3]
        rule: Rule = []
        inside = grow
        while len(rule) < max_terms:
            p0, n0 = sum(b for _, b in inside), len(inside)
            if not n0 or p0 == n0:
                break
            best, gain = None, 1e-9
            for f in FEATURES:
                order = sorted((x[f], b) for x, b in inside)
                below = 0
                for k in range(1, len(order)):
                    below += order[k - 1][1]
                    if order[k][0] == order[k - 1][0]:
                        continue
                    t = (order[k][0] + order[k - 1][0]) / 2
                    for op, p, n in (("<", below, k), (">=", p0 - below, len(order) - k)):
                        if p >= least // 2:
                            g = _foil(p, n, p0, n0)
                            if g > gain:
                                best, gain = (f, op, t), g
            if best is None:
                break
            rule.append(best)
            inside = [r for r in inside if _holds([best], r[0])]
        while len(rule) > 1:  # the last terms go while the rows kept for pruning don't speak against it
            p, n = _counts(rule, prune)
            q, m = _counts(rule[:-1], prune)
            if (q + 1) / (m + 2) < (p + 1) / (n + 2):
                break
            rule = rule[:-1]
        p, n = _counts(rule, left)
        if not rule or p < least or p < precision * n:
            break
        rules.append(rule)
        left = [r for r in left if not _holds(rule, r[0])]
    return rules


def _foil(p: int, n: int, p0: int, n0: int) -> float:
    """What a term gains. A good row inside costs as much as ten bad ones: a wrongly rejected text is lost."""
    n, n0 = p + 10 * (n - p), p0 + 10 * (n0 - p0)
    return p * (log2((p + 1) / (n + 2)) - log2((p0 + 1) / (n0 + 2)))


def condition(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, or 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        term = F.lit(True)
        for f, op, t in rule:
            c = F.col(f"q_{f}")
            term = term & ((c >= t) if op == ">=" else (c < t))
        out = F.when(term, k) if out is None else out.when(term, k)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, label_col: str = "quality", precision: float = 0.99) -> list[Rule]:
    """Learns the list from at most ``sample_rows`` labelled rows; only their few statistics reach the driver."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label_col).alias("good"))
    # The smallest hashes: a top-k, so at most sample_rows rows whatever the size of the input.
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # What the base rule rejects is rejected without the list, so the list is learned on the rest.
    got = statistics(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")).withColumn("q__stop", F.monotonically_increasing_id())
    rows = got.where(~base_failed() & (F.col("q__stop") >= 0)).select(F.xxhash64("doc_id", F.lit(3)).alias("k"), "doc_id", (F.col("good") < 0.5).cast("int").alias("bad"), *[F.col(f"q_{f}").cast("double").alias(f) for f in FEATURES]).collect()
    rows = sorted(rows, key=lambda r: (r["k"], r["doc_id"]))
    return learn([({f: r[f] for f in FEATURES}, r["bad"]) for r in rows], precision)


def verdicts(d: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with ``q_base_failed``, ``q_rule`` and ``q_kept``."""
    return d.withColumn("q_base_failed", base_failed()).withColumn("q_rule", condition(rules)).withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_rule") == 0))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """doc_id and text with their statistics, ``q_base_failed``, ``q_rule`` and ``q_kept``."""
    return verdicts(statistics(docs.select("doc_id", "text")), fit(docs, labels, sample_rows))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """``docs`` without the rows that are rejected.

    The row number is there to keep the filter above the statistics: pushed below them, each of its terms would carry
    a copy of all they are made of, and the plan would grow without end.
    """
    inner, at, back = masked(docs)
    learned = fit(docs, labels, sample_rows)
    d = verdicts(statistics(inner, at["text"]), learned).withColumn("q__stop", F.monotonically_increasing_id())
    return back(d.where(F.col("q_kept") & (F.col("q__stop") >= 0)))


def rule_digests(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    d = judge(docs, labels, sample_rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return d.select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names], F.col("q_rule").alias("rule"))
