"""What the reports say, in one place: a code and a value make a sentence."""

from __future__ import annotations

#: Remarks on a column, and reasons and notes of a cleaning plan.
SENTENCES = {
    "no_values": "holds no value",
    "one_value": "holds one value only",
    "gaps_prevail": "gaps in {:.1f}% of the rows, more than a fill can stand for",
    "gaps_matter": "gaps in {:.1f}% of the rows, so a flag for them is worth having",
    "odd_cells": "{} cells do not read as numbers",
    "lopsided": "skewness {:.2f}, so the middle value fits gaps better than the average",
    "names_rows": "names rows, so it stays text",
    "drop_empty": "without a value",
    "drop_constant": "the same value everywhere",
    "drop_identifier": "names rows instead of describing them",
    "drop_text": "{} different texts, which no step here turns into numbers",
    "drop_datetime": "a point in time: make features of it first",
    "drop_gaps": "too few values ({:.0f}% gaps)",
    "lopsided_numbers": "numbers, lopsided",
    "even_numbers": "numbers, even on both sides",
    "and_gaps": "; {:.0f}% gaps",
    "levels": "{} levels",
    "far_values": "{}: {} far values ({:.1f}%) stay, robust scaling bears them",
    "copies": "{} copies of rows go in the structural repair",
    "whole_table": "Every row had a part in these fills: read and report them, but fit anew on each training part before you validate.",
}


def say(code: str, *values: object) -> str:
    return SENTENCES[code].format(*values)
