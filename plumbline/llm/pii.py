"""Personal data by offset-preserving deobfuscation.

Detectors run on the source text, and again on a normalised text that a chain of transducers
makes of it: look-alike letters and digits become ASCII, invisible characters go, spelled digits
become digits, disguised "at" and "dot" become signs. Every normalised character carries the
span of source characters it stands for, so what is found there maps back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, map_texts, whole_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match that could begin within a run of digits begins at its start, so later starts need no trial.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters and signs of other scripts, below each the ASCII one that it is taken for.
CYRILLIC = (
    "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјкорсухүһӏѵԁԛԝ",
    "ABESIJKMHOPCTYXYGQWaesijkopcyxyhlvdqw",
)
GREEK = (
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυϲϳ",
    "ABEZHIKMNOPTYXayikvopucj",
)
ARMENIAN = (
    "ԼՍՏՕհոսցօ",
    "LUSOhnugo",
)
CHEROKEE = (
    "ᎠᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏚᏞᏟᏢᏦᏩᏴ",
    "DTAJEWMHGZRWSLCPKGB",
)
LATIN = (
    "ıɑɡɩᴄᴏᴜᴠᴡᴢꜱ",
    "iagicouvwzs",
)
SIGNS = (
    "＠﹫․。｡．﹒＋﹢‐‑‒–—−－",
    "@@.....++-------",
)
LOOKALIKES = {c: plain for other, ascii_ in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LATIN, SIGNS) for c, plain in zip(other, ascii_, strict=True)}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}

_WORD = "|".join(DIGIT_WORDS)
_DIGIT = re.compile("[0-9]")
_SAID = rf"(?:(?:double|triple)[ -]+)?(?:{_WORD})"
SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ -]+)?{_SAID}(?:[ ,-]+{_SAID})+(?![A-Za-z0-9])", re.I)
_DOT = r"(?: *[\[({<] *(?:dot|punkt|point|punto|\.) *[\])}>] *| +dot +)"
DOT = re.compile(rf"(?<=[A-Za-z0-9]){_DOT}(?=[A-Za-z0-9])", re.I)
AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?: *[\[({{<] *(?:at|@) *[\])}}>] *| +at +(?=[A-Za-z0-9-]+{_DOT}))(?=[A-Za-z0-9])", re.I)
# Character references, and words between low lines or hyphens; "at" is such a word only before a "dot".
SIGN = re.compile("&(?:#0*64|#x0*40|commat|#0*46|#x0*2e|period);", re.I)
JOINED = re.compile("(?<=[A-Za-z0-9])(?:_at_[A-Za-z0-9-]+(?:_dot_[A-Za-z0-9-]+)+|-at-[A-Za-z0-9]+(?:-dot-[A-Za-z0-9]+)+)", re.I)
JOINED_SIGN = re.compile("[_-](at|dot)[_-]", re.I)
# Signs with spaces around: an @ before a whole domain, and the dots of a domain that begins after an @. A capital after a dot begins a sentence.
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9]) @ (?=[A-Za-z0-9-]{2,}(?:\.[A-Za-z]| \. [a-z])[A-Za-z])")
SPACED_DOTS = re.compile(r"(?<=@)[A-Za-z0-9-]{2,}+(?: \. [a-z0-9][A-Za-z0-9-]++)+")
# A bare "at" before a domain as it is: only after a name of two words, as "look at example.com" is no address.
NAMED_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z]++[._][A-Za-z]++( +at +)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2})", re.I)
THREE_DOTS = re.compile(r"\.[A-Za-z0-9]+\.[A-Za-z0-9]+\.")
BRACKETED = re.compile(r"[\[({<] *(?:at|@|dot|punkt|point|punto|\.)")
QUAD = re.compile(rf"(?<![A-Za-z0-9.])(?:(?:{_WORD}|[0-9]+)\.){{3}}(?:{_WORD}|[0-9]+)(?![A-Za-z0-9])", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in found.split(".")))
    if kind == "card":
        digits = found.replace(" ", "").replace("-", "")
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= sum(c.isdigit() for c in found) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping local@domain: from each @ to the left as far as it goes, and on to the right."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the leftmost non-overlapping matches of each kind that hold, in time linear in the text."""
    out = [(0, s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, needs in ((1, IP, "."), (2, CARD, ""), (3, PHONE, "+")):
            if needs in text:
                out += [(kind, *m.span()) for m in pattern.finditer(text) if holds(KINDS[kind], m.group())]
    return out


class Tape:
    """A text whose every character knows its source span, in eight bytes."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None  # positions are made when the first character moves

    def rewrite(self, pattern: re.Pattern, into: Callable[[str], str], group: int = 0) -> None:
        """Put ``into`` of what ``group`` has matched in its place."""
        parts, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            if self.start is None:
                self.start = np.arange(len(self.text), dtype=np.int32)
                self.end = self.start + np.int32(1)
            s, e = m.span(group)
            new = into(m.group(group))
            parts += self.text[at:s], new
            start += self.start[at:s], np.full(len(new), self.start[s])
            end += self.end[at:s], np.full(len(new), self.end[e - 1])
            at = e
        if parts:
            self.text = "".join(parts) + self.text[at:]
            self.start = np.concatenate([*start, self.start[at:]])
            self.end = np.concatenate([*end, self.end[at:]])

    def source(self, s: int, e: int) -> tuple[int, int]:
        return int(self.start[s]), int(self.end[e - 1])


class Plain(dict):
    """The plain form of each character: itself, if it isn't taken for any other."""

    def __missing__(self, c: str) -> str:
        digit = unicodedata.digit(c, None)
        if c.isascii():
            form = c
        elif c in INVISIBLE:
            form = ""
        elif c in LOOKALIKES:
            form = LOOKALIKES[c]
        elif digit is not None:
            form = str(digit)
        else:  # letters and numbers in another dress: full-width, mathematical, ligatures
            form = unicodedata.normalize("NFKC", c) if unicodedata.category(c)[0] in "LN" else c
            form = form if form.isascii() else c
        self[c] = form
        return form


PLAIN = Plain()


def spelled_digits(found: str) -> str:
    out, times = [], 1
    for w in re.findall("[a-z]+", found.lower()):
        if w in TIMES:
            times = TIMES[w]
        else:
            out.append("+" if w == "plus" else DIGIT_WORDS[w] * times)
            times = 1
    return "".join(out)


def at_or_dot(reference: str) -> str:
    return "@" if re.search("64|40|at", reference) else "."


def joined_signs(found: str) -> str:
    return JOINED_SIGN.sub(lambda m: "@" if m[1].lower() == "at" else ".", found)


def some(low: str, *parts: str) -> bool:
    return any(p in low for p in parts)


# Each transducer: what a lower-cased text must have for it to find anything (searches for fixed parts are fast), its pattern, what it writes, and for which group.
TRANSDUCERS = (
    (lambda low: some(low, "&#", "&commat;", "&period;"), SIGN, at_or_dot, 0),
    (lambda low: sum(low.count(w) for w in DIGIT_WORDS) > 1, SPELLED, spelled_digits, 0),
    (lambda low: some(low, "_at_", "-at-"), JOINED, joined_signs, 0),
    (lambda low: BRACKETED.search(low) or (" at " in low and " dot " in low), AT, lambda _: "@", 0),
    (lambda low: BRACKETED.search(low) or " dot " in low, DOT, lambda _: ".", 0),
    (lambda low: " at " in low, NAMED_AT, lambda _: "@", 1),
    (lambda low: " @ " in low, SPACED_AT, lambda _: "@", 0),
    (lambda low: "@" in low and " . " in low, SPACED_DOTS, lambda d: d.replace(" ", ""), 0),
    (THREE_DOTS.search, QUAD, lambda q: ".".join(DIGIT_WORDS.get(p.lower(), p) for p in q.split(".")), 0),
)


def lowered(text: str) -> str:
    return text.lower().replace("i\u0307", "i")  # patterns that ignore case take a dotted capital I for an i


def normalised(text: str) -> Tape | None:
    """The text after all transducers, or None if none of them has anything to do."""
    odd = "" if text.isascii() else "".join(c for c in set(text) if PLAIN[c] != c)
    tape = Tape(text)
    if odd:
        tape.rewrite(re.compile(f"[{re.escape(odd)}]"), PLAIN.__getitem__)
    seen, low = tape.text, lowered(tape.text)
    for can_find, pattern, into, group in TRANSDUCERS:
        if tape.text is not seen:
            seen, low = tape.text, lowered(tape.text)
        if can_find(low):
            tape.rewrite(pattern, into, group)
    return None if tape.text == text else tape


def find(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(kind, start, end, base, normalised value), by kind and start.

    What is found on the normalised text is added unless it lies in a base span of its kind; so an
    identifier that base has cut is there as a whole too.
    """
    base = detect(text)
    out = [(*b, True, text[b[1] : b[2]]) for b in base]
    tape = normalised(text)
    if tape:
        starts = {k: [s for kind, s, _ in base if kind == k] for k in range(len(KINDS))}
        ends = {k: [e for kind, _, e in base if kind == k] for k in range(len(KINDS))}
        for kind, s, e in detect(tape.text):
            a, z = tape.source(s, e)
            i = bisect_right(starts[kind], a) - 1  # the only base span that can hold it
            if i < 0 or z > ends[kind][i]:
                out.append((kind, a, z, False, tape.text[s:e]))
    return sorted(out)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())]))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in arrow_texts(batches):
        rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b, "value": v} for k, s, e, b, v in find(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(rows, _TYPE)], ["_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``spans`` (kind, start, end, base, value).

    Spans are in code points of the source, end exclusive, by kind (as in KINDS) and start. ``base``
    tells what stands in the source as it is; the others were disguised, and ``value`` has
    their plain form. If a base span is a part of a disguised identifier, the whole is added beside it. Null
    and empty texts have none; very long ones are searched whole, in time proportional to their length. Repeated rows
    and null ids are kept as they are, other columns are ignored, whatever their names; an empty table gives an empty result.
    A bare "at" before an undisguised domain makes an address only after a name of two words (``jo.doe at example.com``):
    "look at example.com" is none. Nothing is shuffled.
    """
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(texts, _run, f"_id {kind}, spans {SPANS}").withColumnRenamed("_id", id_col)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
