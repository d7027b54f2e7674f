"""Column functions for text, JSON and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of the full-text index.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was
were be been being have has had having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now""".split()
#: Fixed value: what separates the words of the full-text index.
NO_WORD = r"[^\p{L}\p{N}]+"


def trimmed(c: Column) -> Column:
    """Without characters up to the space at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) == "", F.lit(True))


def normalize_whitespace(c: Column) -> Column:
    """Runs of spaces and tabs become one space, three and more line ends two, lines lose leading blanks."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return trimmed(F.regexp_replace(c, r"(?m)^[ \t]+", ""))


def words(c: Column) -> Column:
    """Lower-case words in order."""
    return F.filter(F.split(F.lower(c), NO_WORD), lambda w: w != "")


def stop_words() -> Column:
    return F.array(*map(F.lit, STOP_WORDS))


def title_key(c: Column) -> Column:
    """The first two words of a title, or its only word, in lower case."""
    return F.array_join(F.slice(F.split(trimmed(F.lower(c)), r"[\x00-\x20]+"), 1, 2), " ")


def strip_fences(c: Column) -> Column:
    """Without the code fences that models put around JSON."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), "```json", ""), "```", ""))


def json_text(json: Column, key: str) -> Column:
    """The value of a key as text; empty if absent, null or the JSON is broken."""
    return F.coalesce(F.get_json_object(json, f"$.{key}"), F.lit(""))


def parse_vector(c: Column) -> Column:
    """'[a,b,c]' to an array of floats; null if it is none."""
    return F.from_json(c, "array<float>")


def format_vector(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def encode_gaps(c: Column) -> Column:
    """Array to one text; null and empty arrays give null."""
    return F.when(F.size(c) > 0, F.array_join(c, "||"))


def decode_gaps(c: Column) -> Column:
    """Text to array; null gives an empty array."""
    return F.coalesce(F.split(c, r"\|\|"), F.array().cast("array<string>"))


#: How lines start that only cite, the address they contain, and the parts of a Markdown link.
CITES, WIKI_HOST, LINK = ["📄", "Source:", "Sources:"], "atlassian.net", ("[", "](http")


def strip_citation_lines(c: Column) -> Column:
    """Without lines that only cite: a page sign or 'Source' in front, a wiki address, or a Markdown link."""

    def cites(line: Column) -> Column:
        text = trimmed(line)
        hit = F.contains(text, F.lit(WIKI_HOST)) | (F.startswith(text, F.lit(LINK[0])) & F.contains(text, F.lit(LINK[1])))
        for mark in CITES:
            hit = hit | F.startswith(text, F.lit(mark))
        return hit

    return trimmed(F.array_join(F.filter(F.split(c, "\n"), lambda line: ~cites(line)), "\n"))
