"""Secret scans: fixed patterns, and strings that a tokeniser finds inefficient.

Words, identifiers and paths are what a vocabulary was made for; a random string costs
a token every two characters or so. Runs of at least 20 characters of a key's alphabet
are candidates; they are secrets if they hold few characters a token under a byte-level
BPE vocabulary. Digests of known length, UUIDs, numbers and identifiers are excluded; an
identifier's letters, apart from its digits and joints, hold several characters a token,
so shape alone excludes nothing. A run that is not random as a whole may hold a random
string beside words: its parts between joints are tested too, and what a fixed pattern
leaves of it. The fixed patterns' spans always stay; spans that the test adds never
overlap them.

Texts are read whole and once, each in the task that reads it; nothing is shuffled.

Nulls: a null text is empty and has no spans. Every row gives one row, repeated rows too.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_long, lean, text_column

KINDS = ("assign", "access", "hex", "opaque")
#: Characters a token below which a string counts as random.
LEAST_A_TOKEN = 2.1
#: Characters a token from which the letters of a string count as words.
LEAST_A_WORD_TOKEN = 2.5
#: Parts of an identifier from this length on must be words by themselves.
LONG_PART = 8
LEAST_LENGTH = 20
#: Lengths of hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
LOOSE = re.compile("[^-_/=]+=*$|[^-_/=]+")
JOINT = re.compile("[-_/+=]+")
WORDS = ("passw", "secret", "token", "api")

_IS_HEX = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_IS_KEY = bytes(49 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") else 48 for b in range(256))
_LONG_HEX, _LONG_KEY = b"1" * 32, b"1" * LEAST_LENGTH
_COUNTERS: dict = {}


def token_counter(ranks: str):
    """A function that counts a string's tokens under a tiktoken rank file."""
    if ranks not in _COUNTERS:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        _COUNTERS[ranks] = lambda s: len(own.encode_ordinary(s))
    return _COUNTERS[ranks]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches that pass their checks, in code points."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = []
    low = raw.lower()
    if any(w.encode() in low for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _LONG_HEX in raw.translate(_IS_HEX):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def words(s: str, count) -> bool:
    """Whether the letters of s, if any, hold several characters a token."""
    letters = [p for p in PART.findall(s) if not p.isdigit()]
    # words are words in capitals too, and the vocabulary knows most of them after a space
    return not letters or sum(map(len, letters)) >= LEAST_A_WORD_TOKEN * sum(min(count(p), count(p.lower()), count(" " + p.lower())) for p in letters)


def is_digest(s: str) -> bool:
    return len(s) in DIGESTS and bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", s))


def known_form(s: str, count) -> bool:
    """Whether s is a digest, a UUID, a number or an identifier made of words rather than a key."""
    s = s.strip("=-_/+")
    if UUID.fullmatch(s) or is_digest(s):
        return True
    # words do not hide a long part that is none
    return words(s, count) and all(words(p, count) for p in JOINT.split(s) if len(p) >= LONG_PART)


def opaque_spans(text: str, raw: bytes, taken: list[tuple[int, int, str]], count, least: float = LEAST_A_TOKEN) -> list[tuple[int, int, str]]:
    if _LONG_KEY not in raw.translate(_IS_KEY):
        return []
    out = []
    for m in OPAQUE.finditer(text):
        at = m.start()
        # what a fixed pattern takes is cut out of the run, the rest is tested
        for x, y in [*((x, y) for x, y, _ in taken if x < m.end() and m.start() < y), (m.end(), m.end())]:
            out += ((at + a, at + b, "opaque") for a, b in random_parts(text[at:x], count, least, at == m.start() and x == m.end()))
            at = max(at, y)
    return out


def random_parts(s: str, count, least: float, whole: bool) -> list[tuple[int, int]]:
    """Where s is random: all of it, or stretches of its parts between joints, each by its own ratio. whole: s is a run of its own."""

    def is_random(a: int, b: int) -> bool:
        return b - a >= LEAST_LENGTH and (b - a) / count(s[a:b]) < least and not known_form(s[a:b], count)

    if len(s) < LEAST_LENGTH:
        return []
    # the joints beside a fixed pattern belong to neither
    a, b = (0, len(s)) if whole else (len(s) - len(s.lstrip("-_/=")), len(s.rstrip("-_/")))
    if is_random(a, b):
        return [(a, b)]
    parts = [(p.start(), p.end()) for p in LOOSE.finditer(s, a, b)]
    uuids = [m.span() for m in UUID.finditer(s, a, b)]
    weights, before, k = [], a, 0
    for x, y in parts:
        while k < len(uuids) and uuids[k][1] <= x:
            k += 1
        plain = k < len(uuids) and uuids[k][0] <= x and y <= uuids[k][1] or s[x:y].isdigit() or is_digest(s[x:y])
        weights.append((y - before, 0 if plain else count(s[before:y])))
        before = y
    out = []
    for first, last in stretches(weights, least):
        if is_random(parts[first][0], parts[last][1]):
            out.append((parts[first][0], parts[last][1]))
        else:
            out += (p for p in parts[first : last + 1] if is_random(*p))
    return out


def stretches(parts: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """First and last of the stretches of (characters, tokens) whose tokens outweigh their characters most.

    All maximal scoring subsequences (Ruzzo and Tompa); every part of few characters a token
    is in one of them. A part without tokens counts for nothing. Linear in the parts.
    """
    held: list[tuple[int, int, float, float]] = []  # first, last, the sum before and that up to the last
    left: list[int] = []  # for each, the nearest earlier one of a lesser sum before
    total = 0.0
    for i, (n, tokens) in enumerate(parts):
        worth = tokens * least - n if tokens else 0.0
        before, total = total, total + worth
        if worth <= 0:
            continue
        new = (i, i, before, total)
        k = len(held) - 1
        while k >= 0:
            if held[k][2] >= new[2]:
                k = left[k]
            elif held[k][3] >= new[3]:
                break
            else:
                new = (held[k][0], i, held[k][2], total)
                del held[k:], left[k:]
                k = len(held) - 1
        held.append(new)
        left.append(k)
    return [x[:2] for x in held]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, least: float = LEAST_A_TOKEN) -> DataFrame:
    """doc_id and an array of spans (start, end, kind) of every row, base and added, in order."""
    path = ranks or default_ranks()

    def find(batches):
        count = token_counter(path)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                base = base_spans(text, raw)
                more = opaque_spans(text, raw, base, count, least)
                out.append([{"start": a, "end": b, "kind": k} for a, b, k in sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(as_long(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text")).mapInArrow(lean(find), "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "opaque")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


SQL = None
