"""Secret scans: patterns, and novelty against a primed zstandard dictionary.

Three patterns find assignments, access keys and hex runs. Beyond them, strings
that stand close after a sensitive word are candidates; each is measured by the
bytes it adds when compressed together with the text around it, by a compressor
primed with code words and common identifiers. Names and prose repeat what the
dictionary or the surroundings hold, secrets do not: candidates that cost
MIN_COST bytes a character or more are reported as `novel`. Long strings over
few characters cannot cost that much, even random ones, so candidates that cost
about what a random string of their own characters and length does are novel too.

Defined results: a null text is an empty one; empty texts have no spans.
Positions are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in their order, and the least length of each.
KINDS = ("assign", "access", "hex", "novel")
MIN_VALUE = 12
MIN_ACCESS = 18
MIN_HEX = 16

# What the patterns look for.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(?:" + "|".join(map(_any_case, NAMES)) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
# Runs shorter than the least length match nowhere, so only long ones are sought.
_HEX = re.compile("[0-9a-f]{%d,}" % MIN_HEX)

# Words after which a string may be a secret, and how close it must stand.
SENSITIVE = (
    "password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api key",
    "bearer", "credential", "private_key", "private key", "access_key", "access key",
    "client_secret", "authorization",
)
REACH = 48
_CONTEXT = re.compile("|".join(map(_any_case, SENSITIVE)))
MIN_STRING = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{%d,}" % MIN_STRING)
AROUND = 256
MIN_COST = 0.8
MIN_BYTES = 12
# Share of the least cost of DRAWN random strings; random strings differ by less than the rest.
MIN_SHARE = 0.95
DRAWN = 4
# Strings without digits are words when more of their letter pairs are known ones.
MAX_KNOWN = 0.6

# Code words and identifiers that are no secrets.
IDENTIFIERS = """
def class return import from self None True False lambda yield async await function const var let
public private protected static final void string boolean integer double float struct interface
password passwd passphrase secret token api_key apikey bearer authorization credential credentials
client_id client_secret access_key secret_key private_key public_key session_token refresh_token
access_token id_token csrf_token user_name username user_id email address host hostname localhost
port database connection config configuration environment variable example placeholder changeme
your_password_here your_api_key_here your_token_here my_secret_value process.env os.environ getenv
settings.SECRET_KEY config.api_key request.headers response.status_code application/json
Content-Type text/plain https://www.example.com/index.html http://localhost:8080/api/v1/users
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx
"""


def pairs(text: str) -> set[str]:
    """Pairs of neighbouring ASCII letters, in lower case."""
    return {a + b for run in re.findall("[a-z]+", text.lower()) for a, b in zip(run, run[1:])}


class Novelty:
    """Marginal compressed bytes of a string, given the text around it."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(
            identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        self._pairs = pairs(identifiers)
        self._pack = zstandard.ZstdCompressor(
            level=9, dict_data=primed, write_checksum=False, write_content_size=False
        ).compress

    def cost(self, string: str, before: str, after: str) -> int:
        around = (before + "\n" + after).encode()
        return len(self._pack(around + b"\n" + string.encode())) - len(self._pack(around))

    def is_novel(self, string: str, before: str, after: str) -> bool:
        cost = self.cost(string, before, after)
        if cost < MIN_BYTES or (not any(map(str.isdigit, string)) and self._is_wording(string, before, after)):
            return False
        if cost >= MIN_COST * len(string):
            return True
        # The same strings at each call, so results do not depend on the order of documents.
        draw, letters = random.Random(len(string)), sorted(set(string))
        drawn = ("".join(draw.choices(letters, k=len(string))) for _ in range(DRAWN))
        return any(cost >= MIN_SHARE * self.cost(other, before, after) for other in drawn)

    def _is_wording(self, string: str, before: str, after: str) -> bool:
        own = pairs(string)
        return len(own & (self._pairs | pairs(before) | pairs(after))) > MAX_KNOWN * len(own)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all pattern matches, leftmost and non-overlapping in each kind."""
    out = []
    lower = text.encode().lower()
    if any(name.encode() in lower for name in NAMES):
        # A short value uses up its text, so matches are dropped after the search.
        out += [
            (m.start(), m.end(), "assign")
            for m in _ASSIGN.finditer(text)
            if m.end(1) - m.start(1) >= MIN_VALUE
        ]
    if "AKIA" in text:
        found = ((m.start(), m.end()) for m in _ACCESS.finditer(text))
        out += [(a, b, "access") for a, b in found if b - a >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def novel_spans(
    text: str, novelty: Novelty, taken: list[tuple[int, int, str]]
) -> list[tuple[int, int, str]]:
    """Incompressible strings after sensitive words, but those inside a span of `taken`.

    A run of characters that sensitive words lead into, or lie in, is measured
    once from its first start, and if it is none once more in pieces, so the work
    grows with the text. `taken` is in order.
    """
    lower = text.encode().lower()
    if not any(word.encode() in lower for word in SENSITIVE):
        return []
    # Runs by their end: where a candidate starts, and the sensitive word before it.
    runs: dict[int, list[tuple[int, int]]] = {}
    end = 0
    for word in _CONTEXT.finditer(text):
        # A string that starts within the reach has its least length by then.
        for match in _CANDIDATE.finditer(text, word.end(), word.end() + REACH + MIN_STRING - 1):
            # The reach may end inside a string; the string counts whole, and is walked once.
            if match.start() >= end:
                end = _CANDIDATE.match(text, match.start()).end()
            starts = runs.setdefault(end, [])
            if not starts or starts[-1][0] < match.start():
                starts.append((match.start(), word.start()))
    # Spans that start no later than a place: how far they reach at most.
    begun, reached = [a for a, _, _ in taken], list(accumulate((b for _, b, _ in taken), max))

    def secret(start: int, stop: int) -> bool:
        # A long random string may hold a run of digits that is a span by itself.
        at = bisect_right(begun, start)
        if stop - start < MIN_STRING or (at and reached[at - 1] >= stop):
            return False
        string = text[start:stop]
        before, after = text[max(0, start - AROUND) : start], text[stop : stop + AROUND]
        return any(c.isalpha() for c in string) and novelty.is_novel(string, before, after)

    out = []
    for end, starts in runs.items():
        if secret(starts[0][0], end):
            out.append((starts[0][0], end, "novel"))
        elif len(starts) > 1:
            # No secret as a whole: the pieces between its sensitive words, each once.
            stops = [word for _, word in starts[1:]] + [end]
            out += [(at, stop, "novel") for (at, _), stop in zip(starts, stops) if secret(at, stop)]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=_order))


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_text(text: str | None, novelty: Novelty) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    kinds = [kind for _, _, kind in base]
    return (
        *(kinds.count(kind) for kind in KINDS[:3]),
        hashlib.sha256(joined(base).encode()).hexdigest(),
        joined(base + novel_spans(text, novelty, base)),
    )


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of every whole text, one row per document, scanned where it lies."""

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        novelty = Novelty()
        columns = [c.split()[0] for c in FOUND.split(", ")]
        for texts in batches:
            yield pd.DataFrame([scan_text(x, novelty) for x in texts], columns=columns)

    out = docs.select("doc_id", F.pandas_udf(scanned, FOUND)("text").alias("_found"))
    return out.select("doc_id", "_found.*")
