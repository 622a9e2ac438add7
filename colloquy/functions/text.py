"""Scalar text expressions: H1-H5, H9-H12, P6, P18.  All native Column
expressions (codegen'd, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.plans.hashing import seeded_key

# Java's \s is ASCII-only; Python str.strip() removes any Unicode whitespace.
WS = r"[\s\p{Z}\u0085\u001c-\u001f]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(col: Column | str) -> Column:
    """H5: Python ``str.strip()`` (all leading / trailing whitespace)."""
    return F.regexp_replace(F.regexp_replace(_c(col), "^" + WS + "+", ""), WS + "+$", "")


def strip_quotes(col: Column | str) -> Column:
    """Strip leading / trailing ``'`` and ``"`` characters."""
    return F.btrim(_c(col), F.lit("'\""))


def build_tags(*labels: Column | str) -> Column:
    """H1: labels -> list of trimmed non-blank values; empty list -> NULL.
    (``normal`` is kept, as the reference code does.)"""
    arr = F.filter(F.array(*[strip_ws(_c(x).cast("string")) for x in labels]),
                   lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(arr) > 0, arr)


# Fixed phrase templates of the style sentence.
STYLE_PREFIX = "The speaker speaks "
PHRASES = ("in a {} tone", "at a {} volume", "at a {} speed")
_PERMS = ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0))


def build_style_desc(emotion: Column | str, speed: Column | str, volume: Column | str,
                     seed: int, key: Column | str) -> Column:
    """H2: "The speaker speaks in a X tone, at a Y volume, at a Z speed." with
    the phrase order picked from the 6 orders by a seeded hash of ``key``; a
    NULL label drops its phrase (Q6)."""
    vals = [_c(emotion), _c(volume), _c(speed)]
    phrases = [F.when(v.isNotNull(), F.concat(F.lit(t.split("{}")[0]), v.cast("string"),
                                              F.lit(t.split("{}")[1])))
               for t, v in zip(PHRASES, vals)]
    pick = F.conv(F.substring(seeded_key(seed, _c(key)), 1, 4), 16, 10).cast("int") % 6
    ordered = None
    for i, perm in enumerate(_PERMS):
        body = F.concat_ws(", ", *[phrases[j] for j in perm])
        ordered = F.when(pick == i, body) if ordered is None else ordered.when(pick == i, body)
    return F.concat(F.lit(STYLE_PREFIX), ordered, F.lit("."))


def format_duration(seconds: Column | str) -> Column:
    """Seconds -> ``"1h 2m 3.45s"``; minutes shown whenever hours are."""
    s = _c(seconds).cast("double")
    h = F.floor(s / 3600)
    m = F.floor((s - h * 3600) / 60)
    rest = s - h * 3600 - m * 60
    sec = F.format_string("%.2fs", rest)
    return (F.when(h > 0, F.concat_ws(" ", F.concat(h.cast("string"), F.lit("h")),
                                       F.concat(m.cast("string"), F.lit("m")), sec))
            .when(m > 0, F.concat_ws(" ", F.concat(m.cast("string"), F.lit("m")), sec))
            .otherwise(sec))


# ---------------------------------------------------------------------------
# prompt text.
# The few-shot baseline's prompt wording and layout.

TASK_DESCRIPTION = (
    "You are a prompt assistant for a conversational, instruction-guided text-to-speech system.\n"
    "Your task is to predict an appropriate natural-language style description (style prompt) for the NEXT utterance\n"
    "to be synthesized, given the dialogue history and the script (transcription) of that next utterance.\n"
    "\n"
    "The style description should reflect how the speech should sound -- covering aspects like emotion,\n"
    "speaking rate, vocal quality, and energy level -- and should be consistent with the speaker's\n"
    "established style, and be appropriate to the conversational flow. Be concise: 1-3 sentences is ideal.\n"
    "\n"
    "Each turn shows the transcription, and (for all turns except the final query turn) the speaking style.\n"
    "For the final turn, only the transcription is provided.\n"
    "Predict the style for that final turn and output it as \"Style: <your prediction>\".\n"
    "Respond with only the content of your style prediction for the final turn, nothing else.\n"
    "\n"
)
USER_QUESTION = ("Given the dialogue history and the script for the final turn, "
                 "predict only the final style description.\n\n")
UNKNOWN_STYLE = "unknown"
EXAMPLE_SEPARATOR = "\n\n---\n\n"


def _style(u: Column, style_field: str) -> Column:
    raw = u[style_field]
    return strip_ws(F.coalesce(F.nullif(raw, F.lit("")), F.lit(UNKNOWN_STYLE)))


def _turn_lines(u: Column, i: Column, style: Column | None) -> Column:
    head = F.concat(F.lit("[Turn "), (i + 1).cast("string"), F.lit("]\n  Transcription: \""),
                    strip_ws(F.coalesce(u["transcription"], F.lit(""))), F.lit("\"\n  Speaking style:"))
    return head if style is None else F.concat(head, F.lit(" "), style)


def chain_to_text(chain: Column | str, style_field: str = "text_description") -> Column:
    """H9: dialogue text; every turn has a ``[Turn i]`` header, its quoted
    transcription and its style (``unknown`` when missing); the last turn's
    style is left blank."""
    c = _c(chain)
    n = F.size(c)
    return F.array_join(F.transform(c, lambda u, i: F.when(i == n - 1, _turn_lines(u, i, None))
                                    .otherwise(_turn_lines(u, i, _style(u, style_field)))), "\n")


def few_shot_example(chain: Column | str, style_field: str = "text_description") -> Column:
    """Example text with the style on every turn."""
    return F.array_join(F.transform(_c(chain), lambda u, i: _turn_lines(u, i, _style(u, style_field))), "\n")


def system_prompt(examples: Column, task: str = TASK_DESCRIPTION) -> Column:
    """Task text + numbered examples joined by ``---``.  ``examples`` is an
    array of ``struct(rank, text)``; it is sorted by rank here."""
    ordered = F.transform(F.array_sort(examples), lambda e: F.concat(
        F.lit("Example "), (e["rank"] + 1).cast("string"), F.lit(":\n"), e["text"]))
    return F.concat(F.lit(task), F.lit("\nHere are "), F.size(examples).cast("string"),
                    F.lit(" examples:\n\n"), F.array_join(ordered, EXAMPLE_SEPARATOR))


def user_prompt(chain: Column | str, style_field: str = "text_description") -> Column:
    """Question + dialogue text (H9) + newline."""
    return F.concat(F.lit(USER_QUESTION), chain_to_text(chain, style_field), F.lit("\n"))


PROMPT_SEPARATOR = "\n\n---\n\n"


def full_prompt(system: Column | str, user: Column | str) -> Column:
    """The full prompt, system and user parts joined by ``---``."""
    return F.concat(_c(system), F.lit(PROMPT_SEPARATOR), _c(user))


def ground_truth(chain: Column | str, style_field: str = "text_description") -> Column:
    """The target of a chain: the last turn's style, stripped."""
    return strip_ws(F.coalesce(F.element_at(_c(chain), -1)[style_field], F.lit("")))


def joined_dialogue(chain: Column | str, field: str = "transcription") -> Column:
    """Transcriptions joined with `` | ``, blanks skipped."""
    c = _c(chain)
    return F.array_join(F.filter(F.transform(c, lambda u: strip_ws(u[field])),
                                 lambda t: t.isNotNull() & (t != "")), " | ")
