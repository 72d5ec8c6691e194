"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "on", "was", "with", "as", "by", "this", "are", "be", "or", "an", "from", "at",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "est", "que", "qui", "dans", "pour", "par", "pas", "sur", "au", "avec", "en",
    "el", "los", "las", "del", "y", "no", "una", "con", "para", "por", "se", "su", "es",
    "der", "die", "das", "und", "den", "dem", "von", "mit", "ist", "im", "ein", "eine", "nicht", "auf", "ich", "zu", "für", "auch",
)

_WORD_GAP = "[\\\\x20\\\\x09-\\\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A document fails the rule when `metric`, an SQL expression over METRICS, lies outside [least, most]."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are null without words or lines, and a null metric fails no rule.
RULES = (
    Rule("word_length", "word_chars / nullif(n_words, 0)", 1.5, 20.0),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", None, 0.1),
    Rule("exclamation_ratio", "n_exclamations / nullif(n_words, 0)", None, 0.3),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines / nullif(n_lines, 0)", None, 0.6),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / nullif(n_lines, 0)", None, 0.5),
)


def _let(value: str, name: str, body: str) -> str:
    """SQL in which `name` is `value`, evaluated once: a lambda over an array of one."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """Words inside three-word windows that occur twice or more, over the array `w`."""
    windows = "transform(sequence(1, size(w) - 2), i -> concat(element_at(w, i), ' ', element_at(w, i + 1), ' ', element_at(w, i + 2)))"
    pairs = "sort_array(transform(g, (x, i) -> struct(x AS x, i AS i)))"
    twice = "filter(transform(s, (e, k) -> if((k > 0 AND s[greatest(k - 1, 0)].x = e.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = e.x), e.i, -1)), j -> j >= 0)"
    covered = "aggregate(transform(p, (x, k) -> if(k = size(p) - 1, 3, least(3, p[least(k + 1, size(p) - 1)] - x))), 0L, (a, x) -> a + x)"
    found = _let(pairs, "s", _let(f"sort_array({twice})", "p", covered))
    return f"if(size(w) < 4, 0L, {_let(windows, 'g', f'if(size(array_distinct(g)) = size(g), 0L, {found})')})"


def _metrics(text: str) -> str:
    """One struct of all metrics of the SQL expression `text`; the word and line arrays are made once."""
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    by_words = f"""named_struct(
        'n_words', cast(size(w) AS bigint),
        'n_stop_words', cast(size(filter(w, x -> lower(x) IN ({stop}))) AS bigint),
        'n_repeat_words', {_repeat_words()})"""
    by_lines = """named_struct(
        'n_lines', cast(size(l) AS bigint),
        'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint),
        'n_ellipsis_lines', cast(size(filter(l, x -> endswith(x, '...') OR endswith(x, '…'))) AS bigint))"""
    words = f"filter(split(t, '{_WORD_GAP}'), x -> x != '')"
    lines = "filter(split(t, '\\n'), x -> translate(x, ' \\t\\n\\u000B\\u000C\\r', '') != '')"
    body = f"""named_struct(
        'word_chars', cast(char_length(translate(t, ' \\t\\n\\u000B\\u000C\\r', '')) AS bigint),
        'n_symbols', cast(char_length(t) - char_length(translate(t, '#*$%&|<>', '')) AS bigint),
        'n_exclamations', cast(char_length(t) - char_length(translate(t, '!', '')) AS bigint),
        'w', {_let(words, 'w', by_words)},
        'l', {_let(lines, 'l', by_lines)})"""
    return _let(f"coalesce({text}, '')", "t", body)


def quality_metrics(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with a struct column `quality`: the metrics, `failed` (names of failed rules), base_failed and kept.

    Words are runs of anything but space and \\t-\\r; lines are \\n-split and count with a word in them. A null or
    empty text has no words, so base_failed is true and kept false. Repeated rows are judged each on their own; a
    column of `docs` that is called `quality` is replaced. All of it is one map-only projection without user
    functions: nothing is shuffled, and the cost of a text is n log n in its words.
    """
    made = F.expr(_metrics(f"`{text}`"))
    flat = ("word_chars", "n_symbols", "n_exclamations")
    nested = {"w": ("n_words", "n_stop_words", "n_repeat_words"), "l": ("n_lines", "n_dup_lines", "n_ellipsis_lines")}

    def verdict(m: Column) -> Column:
        at = {c: m[c] for c in flat} | {c: m[k][c] for k, cs in nested.items() for c in cs}
        failed = []
        for rule in rules:
            value = _over(rule.metric, at)
            bad = [x for x in ((value < rule.least) if rule.least is not None else None, (value > rule.most) if rule.most is not None else None) if x is not None]
            out = bad[0] if len(bad) == 1 else bad[0] | bad[1]
            failed.append(F.when(F.coalesce(out, F.lit(False)), F.lit(rule.name)))
        base = (at["n_words"] < 50) | (100 * at["n_repeat_words"] > 50 * at["n_words"])
        names = F.filter(F.array(*failed), lambda x: x.isNotNull())
        return F.struct(*[v.alias(k) for k, v in at.items()], names.alias("failed"), base.alias("base_failed"), (~base & (F.size(names) == 0)).alias("kept"))

    return docs.withColumn("quality", F.element_at(F.transform(F.array(made), verdict), 1))


def _over(metric: str, at: dict[str, Column]) -> Column:
    """The ratio `a / nullif(b, 0)` of a rule over the columns in `at`."""
    top, _, bottom = metric.partition(" / nullif(")
    below = at[bottom.removesuffix(", 0)")]
    return at[top].cast("double") / F.when(below != 0, below)
