"""Secret scans: fixed forms, and the token-efficiency test for random strings.

Fixed forms (kinds ``assign``, ``access``, ``hex``): leftmost non-overlapping matches per kind, those below the
kind's length dropped.

Token efficiency (kind ``random``): a run of ``[A-Za-z0-9+/_=.-]`` is cut into parts at its punctuation.  Parts
that a fixed form touches, hex digests of known lengths and UUIDs are left out and divide the run into stretches.  A
candidate of ``min_chars`` characters or more, of whatever case, is encoded with a tiktoken vocabulary.  Ordinary words
and identifiers need few tokens; where a token covers fewer than ``max_ratio`` characters on average, the string is
random.  Where all parts are of one case (``HAVE_SYS_TYPES_H``), the parts without the signs that join them must also
be below the stricter ``NAME_RATIO``.  Candidates of a stretch, the first that is random wins: the stretch without ordinary parts at its ends; the
whole stretch; else its pieces between ordinary parts, and the parts of a piece that is not random.  Left out of the
candidates: numbers, versions, dates and times.

Defined results: null or empty text has no spans.  Offsets are code points, ends exclusive.  Rows are
independent; other columns pass through.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busguard.llm.common import col, free_name, text_or_empty

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_CHARS = 16
MAX_RATIO = 1.85
NAME_RATIO = 1.6  # of parts of one case that are joined: of 6,371 such names in Python sources 6 are below

SPANS = "array<struct<kind:string,start:long,end:long>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run too short holds no longer one that starts later
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PART = re.compile(f"{UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_./+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+")
NUMBER = re.compile(r"[0-9]+(?:[-_./+=][0-9]+)*")
STAMP = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}(?:[T_-]?[0-9:.+-]*Z?)?")
VERSION = re.compile(r"(?:[A-Za-z]+[-_])*v?[0-9]+(?:\.[0-9]+)+(?:[-_.+][A-Za-z0-9]{1,8})*")


@functools.lru_cache(maxsize=4)
def vocabulary(name_or_path: str):
    import public_tokenizers
    import tiktoken
    path = name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_digest(s: str) -> bool:
    return bool(len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s) or UUID.fullmatch(s))


def is_known_form(s: str) -> bool:
    """Digests, UUIDs, numbers, versions, dates and times: not secrets however they are tokenised."""
    return is_digest(s) or any(form.fullmatch(s) for form in (NUMBER, STAMP, VERSION))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def random_spans(text: str, taken: list[tuple[str, int, int]], encoding, min_chars: int,
                 max_ratio: float) -> list[tuple[str, int, int]]:
    begins: list[int] = []  # what base spans cover, as ascending stretches
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in taken):
        if begins and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)

    def meets(a: int, b: int) -> bool:
        at = bisect.bisect_right(ends, a)
        return at < len(begins) and begins[at] < b

    def dense(s: str) -> bool:
        return len(s) < max_ratio * len(encoding.encode_ordinary(s))

    def is_random(a: int, b: int) -> bool:
        s = text[a:b]
        if b - a < min_chars or is_known_form(s) or not dense(s):
            return False
        if not NAME.fullmatch(s):
            return True
        parts = [p[0] for p in PART.finditer(s)]  # parts of one case joined: the joints are tokens that tell nothing
        return sum(map(len, parts)) < NAME_RATIO * sum(len(encoding.encode_ordinary(p)) for p in parts)

    def in_stretch(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if not parts or parts[-1][1] - parts[0][0] < min_chars:
            return []
        pieces: list[list[tuple[int, int]]] = [[]]
        for a, b in parts:
            if dense(text[a:b]):
                pieces[-1].append((a, b))
            elif pieces[-1]:
                pieces.append([])
        pieces = [p for p in pieces if p]
        if not pieces:
            return []
        for a, b in ((pieces[0][0][0], pieces[-1][-1][1]), (parts[0][0], parts[-1][1])):
            if is_random(a, b):
                return [(a, b)]
        out = []
        for piece in pieces:
            whole = (piece[0][0], piece[-1][1])
            out += [whole] if is_random(*whole) else [part for part in piece if is_random(*part)]
        return out

    out = []
    for m in RUN.finditer(text):
        stretch: list[tuple[int, int]] = []
        for p in PART.finditer(m[0]):
            a, b = m.start() + p.start(), m.start() + p.end()
            if is_digest(p[0]) or meets(a, b):
                out += in_stretch(stretch)
                stretch = []
            else:
                stretch.append((a, b))
        out += in_stretch(stretch)
    return [("random", a, b) for a, b in out]


def scan(text: str, encoding, min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind in the order of ``KINDS``."""
    base = base_spans(text)
    found = base + random_spans(text, base, encoding, min_chars, max_ratio)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, text: str = "text", spans_as: str = "secrets", vocabulary_file: str = VOCABULARY,
                 min_chars: int = MIN_CHARS, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with the spans of secrets in each text."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = vocabulary(vocabulary_file)
        for batch in batches:
            yield batch.map(lambda t: [f"{k}:{a}:{b}" for k, a, b in scan(t, encoding, min_chars, max_ratio)])

    raw = free_name(docs, "spans")
    found = docs.withColumn(raw, run(text_or_empty(col(docs, text))))
    part = lambda s, i: F.split(s, ":")[i]
    return found.withColumn(spans_as, F.transform(raw, lambda s: F.struct(
        part(s, 0).alias("kind"), part(s, 1).cast("long").alias("start"), part(s, 2).cast("long").alias("end")))).drop(raw)
