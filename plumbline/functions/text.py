"""Text measures as Column expressions; all of a document's come from one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[.!?]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
PUNCTUATION_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = r"[\s\x1c-\x1f\x85   -     　]"

# Common English words without content.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down"
    " during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my"
    " myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them"
    " themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would"
    " you your yours yourself yourselves".split()
)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 without any whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def matching(text: Column, pattern: str) -> Column:
    """How many characters match a one-character pattern."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def num_lines(text: Column) -> Column:
    """Lines as Python splits them: a final break opens no line, an empty text has none."""
    body = F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, LINE_BREAK, -1)))


def sentences(full: Column) -> Column:
    """How many sentences a text has, of which ``full`` is all but white space: what is between ends, if there is anything."""
    return F.size(F.filter(F.split(full, SENTENCE_END + "+"), lambda s: s != ""))


def num_paragraphs(text: Column) -> Column:
    return F.size(F.split(text, "\n\n", -1))


def flesch_kincaid_grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    grade = 0.39 * n_words / n_sentences + 11.8 * n_syllables / n_words - 15.59
    return F.when((n_words > 0) & (n_sentences > 0), grade).otherwise(F.lit(0.0))


def word_of_length(found: Column, lengths: Column, n: Column) -> Column:
    """The first word of that length; empty without words."""
    return F.coalesce(F.get(found, F.array_position(lengths, n).cast("int") - 1), F.lit(""))


def header_and_body(text: Column, separator: str, header_index: int = 0, body_index: int = 1) -> tuple[Column, Column]:
    """The two wanted parts of a text cut at ``separator``, blank parts aside; without a separator (null, text)."""
    blank = lambda s: F.regexp_replace(s, SPACE, "") == ""
    strip = lambda s: F.regexp_replace(s, rf"\A{SPACE}+|{SPACE}+\z", "")
    if not separator:
        return F.lit(None).cast("string"), strip(text)
    parts = F.filter(F.split(text, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda s: ~blank(s))
    found = F.contains(text, F.lit(separator))
    body = F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(body_index)))).otherwise(F.lit(""))
    return F.when(found, strip(F.get(parts, F.lit(header_index)))), F.when(found, body).otherwise(strip(text))
