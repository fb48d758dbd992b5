"""Prompt texts as columns: sections that begin with a header are replaced or moved to the end, and the settings of examples shown with a prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Providers that learn from examples in the prompt, media types by ending, examples shown unless told otherwise.
EXAMPLES_FOR = ("claude", "gemini")
MEDIA = (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"), ("gif", "image/gif"), ("webp", "image/webp"))
EXAMPLES = 3
# Headers of sections that providers get in another form.
TABLE_HEADER = "=== CHARACTER DISAMBIGUATION ==="
READING_HEADER = "=== HANDWRITING READING PROTOCOL (MULTI-PASS) ==="
FIDELITY_HEADER = "=== CRITICAL TRANSCRIPTION RULE"
# Fixed value: what is put before the user's prompt for one provider.
LITERAL_TASK = "Transcribe all handwritten text from this image exactly as written. Preserve original spelling, line breaks, and formatting. Output ONLY the transcribed text.\n\n"


def _section(prompt: Column, header: str) -> tuple[Column, Column, Column]:
    """(place of the first such header or 0, the text after the header, place of the next section in it or 0)."""
    at = F.instr(prompt, header)
    rest = F.substr(prompt, at + len(header))
    return at, rest, F.instr(rest, "\n===")


def replace_section(prompt: Column, header: str, instead: str) -> Column:
    """The section that begins with ``header`` gives way to ``instead``; a prompt without it stays as it is."""
    at, rest, end = _section(prompt, header)
    after = F.when(end > 0, F.substr(rest, end)).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(F.substr(prompt, F.lit(1), at - 1), F.lit(instead), after)).otherwise(prompt)


def section_last(prompt: Column, header: str) -> Column:
    """The section that begins with ``header`` goes to the end, after a blank line."""
    at, rest, end = _section(prompt, header)
    moved = F.concat(F.substr(prompt, F.lit(1), at - 1), F.substr(rest, end), F.lit("\n\n" + header), F.substr(rest, F.lit(1), end - 1))
    return F.when((at > 0) & (end > 0), moved).otherwise(prompt)


def compact_table(pairs: Sequence[tuple[str, str]]) -> str:
    """The short form of the table of characters that are mistaken for each other."""
    lines = [f"=== CHARACTER DISAMBIGUATION (TOP {len(pairs)}) ===", "When a character is ambiguous, use context:", *(f"  {pair}: {rule}" for pair, rule in pairs), ""]
    return "\n".join([*lines, "VALIDATION: If a word doesn't look right, try swapping confusion pair characters."])


def adapt_system(prompt: Column, provider: Column, table: str, reading: str) -> Column:
    """One provider gets the short table; another the short table and reading rules, with the rule of fidelity last; all others the whole prompt."""
    short = replace_section(prompt, TABLE_HEADER, table)
    literal = section_last(replace_section(short, READING_HEADER, reading), FIDELITY_HEADER)
    return F.when(provider == "gemini", short).when(provider == "openai", literal).otherwise(prompt)


def adapt_user(prompt: Column, provider: Column) -> Column:
    return F.when(provider == "openai", F.concat(F.lit(LITERAL_TASK), prompt)).otherwise(prompt)


def example_count(setting: Column) -> Column:
    """The setting as a number; unset, negative or unreadable: the default. 0 turns examples off."""
    value = F.when(F.trim(setting).rlike(r"^[+-]?[0-9]+$"), F.trim(setting).try_cast("long"))
    return F.when(value >= 0, value).otherwise(F.lit(EXAMPLES)).cast("long")


def shows_examples(provider: Column) -> Column:
    return F.coalesce(provider.isin(*EXAMPLES_FOR), F.lit(False))


def media_type(path: Column) -> Column:
    """By the ending of the file's name, in any case; another or none: jpeg."""
    ending = F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in MEDIA for x in pair))
    return F.coalesce(F.try_element_at(kinds, ending), F.lit("image/jpeg"))
