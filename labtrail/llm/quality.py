"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a condition that rejects a text. A bounded sample tells how many rows each rule
rejects and how many elementary steps (characters or words looked at) it takes; rules then run in
the order of rejection per cost, inside one CASE expression, so a text that an early rule rejects
never pays for a later one. The order changes the work, never the verdict.

Defined cases: a null or empty text has no words and fails the base; white space alone likewise.
Repeated rows are judged each on its own. Columns of the input that share a name with a result
column are replaced by the result. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labtrail.llm.common import restored, whole_row, words

# fixed values: the symbols that count and the limits of the base
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rows of the sample that orders the rules, about.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """`rejects` over the columns that `measured` adds; `steps` is its cost for a row."""

    name: str
    rejects: Column
    steps: Column


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `n_words` and the four base counts (all long) to every row.

    Adds also the arrays `_words` and `_lines`, for rules; drop them at the end.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": words(F.col(text)), "_lines": filled})
    out = out.withColumn("_counts", F.expr(_COUNTS))
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.col("_counts.word_chars").cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.col("_counts.n_repeat_words").cast("long"),
        }
    ).drop("_counts")


def _let(name: str, value: str, body: str) -> str:
    """SQL for `body` with `name` bound to a value that is computed once a row.

    Catalyst may paste a column's expression into the lambdas that use it, which would compute it
    again for every element; a lambda variable cannot be pasted.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: 64-bit fingerprints `h` of the 3-word windows with their places `i`, sorted, so equal ones meet.
_SORTED_WINDOWS = """case when size(w) < 3 then cast(array() as array<struct<h: bigint, i: int>>)
    else sort_array(transform(sequence(0, size(w) - 3),
         i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i))) end"""
_PLACES = """transform(filter(g, (x, k) -> coalesce(x.h = get(g, k - 1).h, false)
    or coalesce(x.h = get(g, k + 1).h, false)), x -> x.i)"""
_COUNTS = _let(
    "w",
    "_words",
    "named_struct('word_chars', length(array_join(w, '')), 'n_repeat_words', "
    + _let("g", _SORTED_WINDOWS, f"size(array_distinct(flatten(transform({_PLACES}, p -> array(p, p + 1, p + 2)))))")
    + ")",
)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )


def standard_rules() -> list[Rule]:
    """Limits for prose in any language; shares are of words or of lines that hold a word."""
    one = F.lit(1.0)
    n_words, n_lines = F.col("n_words"), F.size("_lines")
    steps_words, steps_lines = F.size("_words").cast("double"), n_lines.cast("double")
    listed = F.expr(r"size(filter(_lines, x -> x rlike '^[\\x20\\t]*[-*•]'))")
    cut_off = F.expr(r"size(filter(_lines, x -> x rlike '(\\.\\.\\.|…)[\\x20\\t\\r]*$'))")
    letters = F.expr(r"size(filter(_words, x -> x rlike '\\p{L}'))")
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n_words, one),
        Rule("short_words", F.col("word_chars") < n_words * 2, one),
        Rule("long_words", F.col("word_chars") > n_words * 15, one),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > n_lines * 3, one),
        Rule("list_lines", listed * 10 > n_lines * 9, steps_lines),
        Rule("cut_lines", cut_off * 10 > n_lines * 3, steps_lines * 4),
        Rule("few_letters", letters * 10 < n_words * 8, steps_words),
    ]


def order_rules(rows: DataFrame, rules: list[Rule]) -> list[str]:
    """Names of the rules by rejection per cost on the `rows` that pass the base, best first.

    One aggregation over the sample; a rule that rejects nothing goes last, cheap ones first.
    """
    passes = F.col("base_failed") == F.lit(False)
    stats = rows.agg(
        *[F.avg(F.when(passes, r.rejects.cast("double"))).alias(f"share_{r.name}") for r in rules],
        *[F.avg(F.when(passes, r.steps)).alias(f"steps_{r.name}") for r in rules],
    ).first()

    def rank(rule: Rule) -> tuple:
        share, steps = stats[f"share_{rule.name}"] or 0.0, max(stats[f"steps_{rule.name}"] or 0.0, 1.0)
        return -share / steps, steps, rule.name

    return [r.name for r in sorted(rules, key=rank)]


def sample_of(docs: DataFrame, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` rows, chosen by a hash of the key, so the same rows each time."""
    total = docs.count()
    share = min(1.0, rows / max(total, 1))
    return docs.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)


def quality(
    docs: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Add the base counts, `base_failed`, `kept` and `failed_rule` to every row.

    `kept` is false if the base or any rule fails. `failed_rule` names the first rule of the
    cascade that rejected the row (`base` for the base); it is null for kept rows.
    """
    rules = standard_rules() if rules is None else rules
    taken = sample_of(docs, key, rows).select(text)
    names = order_rules(measured(taken, text).withColumn("base_failed", base_failed()), rules)
    by_name = {r.name: r for r in rules}
    chain = F.when(base_failed(), F.lit("base"))
    for name in names:
        chain = chain.when(by_name[name].rejects, F.lit(name))
    out = measured(whole_row(docs, text), text).withColumn("base_failed", base_failed()).withColumn("failed_rule", chain)
    out = out.withColumn("kept", F.col("failed_rule").isNull())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select(*restored(out, *counts, "base_failed", "failed_rule", "kept"))
