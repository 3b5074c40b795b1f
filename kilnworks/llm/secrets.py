"""Secret scans: patterns for well-known credentials, and a token-efficiency test for everything else that looks random.

A run of 20 or more letters, digits and + / _ = - that holds a letter is put through a byte-pair vocabulary. Ordinary
words take several characters a token; a run that gets fewer than `chars_per_token` is random. Left out first, as known
digests and identifiers: hexadecimal runs of a digest's length, UUIDs, and runs of words with numbers behind them
(names, versions, dates) whose groups of letters get `chars_per_token` or more together. Of a run that a pattern has
reported in part, the stretches of 20 or more characters beside the report are tested by themselves.

Only the bytes of the vocabulary (under 1 MB) travel to the executors, so its path is needed on the driver alone.

Edge cases: null and empty texts have no spans; spans are in code points, end exclusive, of the whole text; rows are
judged one by one, so repeated rows get equal spans; other columns pass through, and one named like the result is
replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHARS_PER_TOKEN = 2.0
KINDS = ["assign", "access", "hex", "random"]
SPANS = "array<struct<kind:string,start:int,end:int>>"
# The patterns of the contract. Letters of the keywords in either case, written out.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# The shortest hexadecimal run counts 24, so looking for 24 or more finds the same runs as looking for all.
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LETTER = re.compile(r"[A-Za-z]")
WORD = re.compile(r"[A-Za-z]{2,}")
LEAST = 20
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})=*")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(r"[/_=+-]*(?:[A-Za-z]{2,}|[0-9]+|[A-Za-z]{2,}[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]+|[A-Za-z]))*[/_=+-]*")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict[int, object] = {}


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(raw: bytes):
    """The encoding of a vocabulary file, built once in each process."""
    import tiktoken

    if (key := hash(raw)) not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the patterns that are long enough, by kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def random_like(words: list[str], enc, chars_per_token: float) -> bool:
    """Whether words get fewer characters a token than ordinary text does."""
    return sum(map(len, words)) < chars_per_token * sum(len(enc.encode_ordinary(w)) for w in words)


def known(run: str, enc, chars_per_token: float = CHARS_PER_TOKEN) -> bool:
    """Whether a run is a digest or an identifier rather than a secret."""
    if not LETTER.search(run) or DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return True
    return bool(IDENTIFIER.fullmatch(run)) and not random_like(WORD.findall(run), enc, chars_per_token)


def uncovered(start: int, end: int, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches of a run, long enough to test, that no base span covers."""
    for a, b in sorted((a, b) for _, a, b in base if a < end and start < b):
        if a - start >= LEAST:
            yield start, a
        start = max(start, b)
    if end - start >= LEAST:
        yield start, end


def scan(text: str, enc, chars_per_token: float = CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    base = base_spans(text)
    more = []
    for m in RUN.finditer(text):
        for a, b in uncovered(m.start(), m.end(), base):
            if not known(text[a:b], enc, chars_per_token) and random_like([text[a:b]], enc, chars_per_token):
                more.append(("random", a, b))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def find_spans(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, chars_per_token: float = CHARS_PER_TOKEN, out: str = "spans") -> DataFrame:
    """docs with the secrets of each text: kind, start and end."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf(SPANS)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(raw.value)
        for texts in parts:
            yield pd.Series([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(t or "", enc, chars_per_token)] for t in texts])

    return docs.withColumn(out, spans(F.col(text)))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each stretch of overlapping spans replaced by a mark; null stays null."""

    @F.pandas_udf("string")
    def cover(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, found, strict=True):
            if t is None or spans_ is None or not len(spans_):
                out.append(t)
                continue
            parts, at = [], 0
            for s in spans_:
                if s["start"] >= at:
                    parts += [t[at : s["start"]], mark]
                at = max(at, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return cover(text, spans)


def as_text(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end, comma-joined; only of some kinds if given."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
