"""Personal data, also where it is disguised, with offsets into the source text.

Four plain patterns give the base spans. For texts that hold a disguise, a chain of
transducers writes a normalised copy: look-alike letters and foreign digits become
ASCII, invisible characters go, "(at)" and "[dot]" or "at ... dot ..." become "@" and
".", runs of spelled digits become digits. Each keeps, for every character that it
writes, where in the source it came from, so that a span found in the copy is mapped
back to the source characters that made it. Such a span is added where no base span
of its kind overlaps it; base spans always stay.

Every row is handled alone and whole, in Arrow batches; nothing is shuffled.

Defined results: a null or empty text has no spans; repeated rows give repeated
results; an empty table gives no rows.
"""

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfwatch.llm.common import narrowed

# The kinds, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")

# Characters that look like a Latin letter or sign.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".",
}

# Digits as words.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}

# --- plain patterns -----------------------------------------------------------------

_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
# A run of digits in which the first digit starts no match holds none: only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Found from the "@" outwards, which reads each character once."""
    found, free = [], 0
    for tail in _AFTER_AT.finditer(text) if "@" in text else ():
        start = tail.start()
        while start > free and text[start - 1] in _BEFORE_AT:
            start -= 1
        if start < tail.start():
            found.append((start, free := tail.end()))
    return found


def ips(text: str) -> list[Span]:
    small = lambda part: len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def _luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    found = []
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(m.span())
    return found


def plain_spans(text: str) -> dict[str, list[Span]]:
    with_digits = _DIGIT.search(text) is not None
    return {
        "email": emails(text),
        "ip": ips(text) if with_digits else [],
        "card": cards(text) if with_digits else [],
        "phone": phones(text) if with_digits else [],
    }


# --- transducers --------------------------------------------------------------------


class Tape:
    """A text with, for each character, the source span that it was made from."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, written) -> None:
        """Replace each match by ``written(match)``; all its characters come from the whole match."""
        pieces, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = written(m)
            if m.end() == m.start() or new is None:
                continue
            pieces += [self.text[at : m.start()], new]
            starts += self.starts[at : m.start()] + [self.starts[m.start()]] * len(new)
            ends += self.ends[at : m.start()] + [self.ends[m.end() - 1]] * len(new)
            at = m.end()
        if at:
            self.text = "".join([*pieces, self.text[at:]])
            self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


_FOREIGN = re.compile("[\u0370-\U0010ffff]")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
_AT = re.compile(r"\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*|(?<=\w)\s*[_*-]at[_*-]\s*(?=\w)", re.I)
_DOT = re.compile(r"\s*[(\[{<]\s*(?:dot|\.)\s*[)\]}>]\s*", re.I)
_AT_WORD = re.compile(r"\s+at\s+(?=[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+|\.[A-Za-z0-9-]+\s+dot\s))", re.I)
_DOT_WORD = re.compile(r"(?<=[A-Za-z0-9])\s+(?:dot|point)\s+(?=[A-Za-z0-9])", re.I)
_NUMBER = "|".join(sorted(SPELLED, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:plus[\s,-]+)?(?:{_NUMBER})(?:[\s,-]+(?:(?:dot|point)[\s,-]+)?(?:{_NUMBER})){{2,}}\b", re.I)
_SIGN_WORD = re.compile(r"[^\s,-]+")
def _latin(m: re.Match) -> str:
    """One character for one: look-alikes, foreign digits and full-width forms."""
    char = m.group()
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if (digit := unicodedata.digit(char, None)) is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() else char


def _digits(m: re.Match) -> str:
    signs = {"plus": "+", "dot": ".", "point": "."}
    return "".join(SPELLED.get(w, signs.get(w, "")) for w in map(str.lower, _SIGN_WORD.findall(m.group())))


# The transducers in the order in which they are applied.
_RULES = [
    (_UNSEEN, lambda m: ""), (_FOREIGN, _latin), (_SPELLED, _digits), (_AT, lambda m: "@"), (_DOT, lambda m: "."),
    (_AT_WORD, lambda m: "@"), (_DOT_WORD, lambda m: "."),
]


def normalised(text: str) -> Tape:
    tape = Tape(text)
    for pattern, written in _RULES:
        tape.rewrite(pattern, written)
    return tape


def is_disguised(text: str) -> bool:
    """Whether a transducer has anything to rewrite; if none has in the text itself, none gets to."""
    return any(pattern.search(text) for pattern, _ in _RULES)


def all_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The base spans and those that only the normalised text shows."""
    if not is_disguised(text):
        return base
    tape = normalised(text)
    if tape.text == text:
        return base
    found = {}
    for kind, spans in plain_spans(tape.text).items():
        mapped = [tape.source(s) for s in spans]
        extra = [s for s in mapped if not any(s[0] < b[1] and b[0] < s[1] for b in base[kind])]
        found[kind] = sorted([*base[kind], *extra])
    return found


# --- the operator -------------------------------------------------------------------


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in spans[kind])


_NAMES = ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans", "n_disguised"]
_TYPES = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.int64()]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = plain_spans(text)
            spans = all_spans(text, base)
            rows.append((
                *(len(base[kind]) for kind in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(),
                _joined(spans), sum(len(spans[k]) - len(base[k]) for k in KINDS),
            ))
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), _TYPES)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=_NAMES)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the number of base spans by kind, their digest, all spans.

    ``n_email`` to ``n_phone`` and ``base_sha256`` describe the base spans; ``spans``
    holds these and the disguised ones, whose number is ``n_disguised``.
    """
    return narrowed(docs, "doc_id", "text").mapInArrow(
        _batches,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
        "n_disguised long",
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
