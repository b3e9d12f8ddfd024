"""Prompt rendering (T7-T9) with ``concat`` only: text containing braces,
``$`` or backslashes is inserted verbatim (no format strings, no regex)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions.lexicon import (KEYWORDS, TONE_MARKERS_BINARY, context_indicators, exception_reason,
                                       keyword_hits, tone)

# The cluster prompt's sections: group number -> heading. Groups 1 and 2 follow the pattern, 3 and 4 do not.
SECTIONS = [(1, "### Pattern: cue words, positive"), (2, "### Pattern: no cue words, negative"),
            (3, "### Exception: no cue words, positive"), (4, "### Exception: cue words, negative")]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def render_prompt(text, prefix: str, suffix: str = "") -> Column:
    """``prefix + text + suffix``."""
    return F.concat(F.lit(prefix), F.coalesce(_col(text), F.lit("")), F.lit(suffix))


def system_rules(task: str = "the positive class", keywords: Sequence[str] = KEYWORDS,
                 with_keywords: bool = True) -> str:
    lines = [f"Decide whether a message belongs to {task}.",
             "Answer with a single digit: 1 for yes, 0 for no.", ""]
    if with_keywords:
        lines.append("Cue words: " + ", ".join(keywords))
    return "\n".join(lines)


def example_line(text, label, reasoning: Column | None = None) -> Column:
    """One example block: message, optional reasoning, answer."""
    parts = [F.lit("\nMessage: \""), F.coalesce(_col(text), F.lit("")), F.lit("\"")]
    if reasoning is not None:
        parts += [F.lit("\nReasoning: "), reasoning]
    parts += [F.lit("\nAnswer: "), _col(label).cast("string")]
    return F.concat(*parts)


def _percent(p: Column) -> Column:
    return F.concat(F.round(100 * p, 0).cast("int").cast("string"), F.lit("%"))


def pattern_note(rates: Column) -> Column:
    """What the cue words are worth, from the data: ``rates`` is a struct of the G14 row."""
    return F.concat(F.lit("\nMost messages with a cue word belong to it ("), _percent(rates["p_pos_given_kw"]),
                    F.lit("), and most without one do not ("), _percent(rates["p_neg_given_nokw"]),
                    F.lit("). There are exceptions both ways: read the whole message."))


def quadrant_reasoning(text, group: Column, rates: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """T3-T6 in one reasoning sentence per group (1 to 4, see ``SECTIONS``)."""
    hits = F.concat(F.lit("cue words present: "), F.array_join(keyword_hits(text, keywords), ", "))
    return (F.when(group == 1, F.concat(hits, F.lit("; follows the pattern ("), _percent(rates["p_pos_given_kw"]),
                                        F.lit(" of messages with cue words are positive).")))
            .when(group == 2, F.concat(F.lit("no cue words; follows the pattern ("), _percent(rates["p_neg_given_nokw"]),
                                       F.lit(" of messages without cue words are negative).")))
            .when(group == 3, F.concat(F.lit("no cue words, yet indicators: "), context_indicators(text),
                                       F.lit("; an exception ("), _percent(rates["p_pos_given_nokw"]),
                                       F.lit(" of messages without cue words are positive).")))
            .otherwise(F.concat(hits, F.lit("; an exception ("), _percent(rates["p_neg_given_kw"]),
                                F.lit(" of messages with cue words are negative); reason: "), exception_reason(text),
                                F.lit("."))))


def quadrant_lead(text, group: Column, rates: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """The worked example's reasoning: a positive one, by pattern (group 1) or else an exception (3)."""
    return (F.when(group == 1, F.concat(F.lit("cue words present: "), F.array_join(keyword_hits(text, keywords), ", "),
                                        F.lit("; tone: "), tone(text), F.lit("; follows the pattern ("),
                                        _percent(rates["p_pos_given_kw"]), F.lit("), and the context bears it out.")))
            .when(group == 3, F.concat(F.lit("no cue words; indicators: "), context_indicators(text),
                                       F.lit("; an exception ("), _percent(rates["p_pos_given_nokw"]),
                                       F.lit("), which context and tone bear out."))))


def binary_lead(text, label, keywords: Sequence[str] = KEYWORDS) -> Column:
    """The worked example's reasoning in the binary prompt, for a positive example."""
    hits = F.array_join(keyword_hits(text, keywords), ", ")
    return F.when(_col(label) == 1, F.concat(
        F.lit("cue words present: "), F.when(hits == "", "none").otherwise(hits), F.lit("; tone: "),
        tone(text, TONE_MARKERS_BINARY), F.lit("; indicators: "), context_indicators(text), F.lit(".")))


def example(order, id_col, text, label, group=None, reasoning: Column | None = None,
            lead: Column | None = None) -> Column:
    """One example as a struct, ordered by (group, order): its lines without and with reasoning, and its
    lines as the worked example (null where it cannot serve as one)."""
    null = F.lit(None).cast("string")
    return F.struct(
        (_col(group) if group is not None else F.lit(0)).alias("grp"), _col(order).alias("ord"), _col(id_col).alias("id"),
        example_line(text, label).alias("plain"),
        (example_line(text, label, reasoning) if reasoning is not None else null).alias("reasoned"),
        (F.when(lead.isNotNull(), example_line(text, label, lead)) if lead is not None else null).alias("lead"))


def few_shot_prompt(target, examples: Column, rules: Column, sections=None, target_id=None,
                    chain_of_thought: bool = True) -> Column:
    """Rules, a worked example, the examples (by section, or all in order), the target.

    ``examples`` is a sorted array of ``example`` structs. With ``target_id`` a target never sees itself among
    them. Without ``chain_of_thought`` there is no worked example and no reasoning.
    """
    ex = examples
    if target_id is not None:
        ex = F.filter(ex, lambda e: ~e["id"].eqNullSafe(_col(target_id)))
    parts = [rules]
    if chain_of_thought:
        lead = F.get(F.filter(F.transform(ex, lambda e: e["lead"]), lambda x: x.isNotNull()), F.lit(0))
        parts.append(F.coalesce(F.concat(F.lit("\n\n### Worked example"), lead), F.lit("")))
    line = lambda e: F.coalesce(e["reasoned"], e["plain"]) if chain_of_thought else e["plain"]
    if sections is None:
        parts += [F.lit("\n\n### Examples"), F.array_join(F.transform(ex, line), "")]
    for g, title in sections or []:
        own = F.filter(ex, lambda e: e["grp"] == g)
        parts.append(F.when(F.size(own) > 0, F.concat(F.lit("\n\n" + title), F.array_join(F.transform(own, line), "")))
                     .otherwise(F.lit("")))
    return F.concat(*parts, target_block(target))


def target_block(text) -> Column:
    return F.concat(F.lit("\n\n### Target\nMessage: \""), F.coalesce(_col(text), F.lit("")),
                    F.lit("\"\nAnswer:"))


def fallback_prompt(text, task: str = "the positive class",
                    keywords: Sequence[str] | None = KEYWORDS) -> Column:
    """Short instruction (+ cue words) when there are no examples."""
    head = f"Decide whether a message belongs to {task}. Answer 1 or 0."
    if keywords:
        head += " Cue words: " + ", ".join(keywords) + "."
    return F.concat(F.lit(head), target_block(text))
