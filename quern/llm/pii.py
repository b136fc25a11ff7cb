"""Personal data by patterns and a semi-Markov conditional random field.

The patterns' spans (email, ip, card, phone) always stay. Around digits and at-signs a
segment model then looks for what they miss: numbers that run into each other, spelt-out
addresses, other punctuation. Its features are of whole spans (digit count, Luhn sum,
octets, punctuation used, balanced brackets, what stands on either side), and the move from
one entity's type to the next one's, with nothing but separators between, has a weight of its
own. So boundaries and types are chosen jointly: the Viterbi path over all segmentations of a
window into entities of bounded length and single outside tokens. A segment of that path is
added if it overlaps no pattern span and its log-odds, over all segmentations with and
without it, reach a margin.

A window is what stands around triggers; those that touch are one. It is decoded in
stretches, between words that no candidate covers: these are outside on every path, so the
stretches' paths are independent and the result is that of the whole window.

The weights are trained here by gradient ascent on the conditional likelihood of
generated windows (forward and backward sums over segmentations); the generator and its
seed are fixed, so the model depends on no corpus.

Texts are read whole and once, each in the task that reads it; nothing is shuffled. The work
is linear in a text's length.

Nulls: a null text is empty and has no spans. A null id stays null. Every row gives one row,
repeated rows too; an empty table gives none. Columns other than id and text are not carried.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_long, lean, text_column

KINDS = ("email", "ip", "card", "phone")
#: Tokens, characters and groups of digits of an entity at most.
LONGEST, LONGEST_CHARS, MOST_GROUPS = 24, 320, 6
#: Log-odds of a segment from which it is added.
MARGIN = 1.0
SEED, WINDOWS, EPOCHS = 7, 160, 14

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match starts and ends at the edges of digit runs, so those are never tried inside: long runs take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches that pass their checks, by kind and start."""
    out = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


# ---- the segment model ----

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
ADDRESS_MARKS = frozenset("._%+-@")
DIGITS, LETTER = re.compile("[0-9]+"), re.compile(r"[^\W\d_]")
AT_WORDS, DOT_WORDS = {"at", "AT"}, {"dot", "DOT"}
#: Tokens beside blanks that stand between the entries of a list.
SEPARATORS = frozenset(",;/|")
FEATURES = (
    "bias", "digits<7", "digits 7", "digits 8-9", "digits 10-11", "digits 12", "digits 13-15", "digits 16", "digits 17-19", "digits>19", "luhn", "not luhn", "plus",
    "four octets", "octet over 255", "at sign", "at word", "dot word", "letters", "no letters", "phone marks only", "spaces", "dots", "hyphens", "slashes", "other marks",
    "balanced", "unbalanced", "edge is alnum", "edge is mark", "joined left", "joined right", "groups 1", "groups 2-3", "groups 4", "groups>4", "equal groups of 4",
    "ends in letters", "two spaces", "email shape", "spelt email shape", "groups 3-3-4", "number goes on left", "number goes on right", "address goes on left",
)
_AT = {name: i for i, name in enumerate(FEATURES)}
EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOT = r"(?: dot | DOT |\[(?:dot|DOT)\]| ?\((?:dot|DOT)\) ?)"
SPELT_SHAPE = re.compile(
    r"[A-Za-z0-9._%+-]+(?: ?@ ?|\[(?:at|AT)\]| ?\((?:at|AT)\) ?)[A-Za-z0-9-]+(?:(?:" + _DOT + r"|\.)[A-Za-z0-9-]+)+|[A-Za-z0-9._%+-]+ (?:at|AT) [A-Za-z0-9-]+(?:" + _DOT + r"[A-Za-z0-9-]+)*" + _DOT + r"(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|co)\b"
)


def span_features(text: str, a: int, b: int) -> list[int]:
    """Indexes of the features that text[a:b] has as a whole."""
    s = text[a:b]
    groups = DIGITS.findall(s)
    d = "".join(groups)
    n = len(d)
    letters = LETTER.search(s) is not None
    names = ["bias"]
    names.append(
        "digits<7" if n < 7 else "digits 7" if n == 7 else "digits 8-9" if n < 10 else "digits 10-11" if n < 12 else "digits 12" if n == 12 else "digits 13-15" if n < 16
        else "digits 16" if n == 16 else "digits 17-19" if n < 20 else "digits>19"
    )
    if n >= 12:
        names.append("luhn" if luhn(d) else "not luhn")
    if s[0] == "+":
        names.append("plus")
    if len(groups) == 4 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s):
        names.append("four octets" if all(int(g[:9]) <= 255 for g in groups) else "octet over 255")
    if "@" in s:
        names.append("at sign")
    words = set(re.findall("[A-Za-z]+", s)) if letters else ()
    if AT_WORDS & set(words):
        names.append("at word")
    if DOT_WORDS & set(words):
        names.append("dot word")
    names.append("letters" if letters else "no letters")
    marks = {c for c in s if not c.isalnum()}
    if not letters and marks <= set("+ ().-"):
        names.append("phone marks only")
    names += [k for c, k in ((" ", "spaces"), (".", "dots"), ("-", "hyphens"), ("/", "slashes")) if c in marks]
    if marks - set("+ ().-/@"):
        names.append("other marks")
    if marks & set("()"):
        names.append("balanced" if s.count("(") == s.count(")") == 1 and s.find("(") < s.find(")") else "unbalanced")
    names.append("edge is alnum" if s[-1].isalnum() and (s[0].isalnum() or s[0] in "+(") else "edge is mark")
    if a and text[a - 1].isalnum():
        names.append("joined left")
    if b < len(text) and text[b].isalnum():
        names.append("joined right")
    k = len(groups)
    names.append("groups 1" if k <= 1 else "groups 2-3" if k < 4 else "groups 4" if k == 4 else "groups>4")
    if k == 4 and all(len(g) == 4 for g in groups):
        names.append("equal groups of 4")
    if [len(g) for g in groups][-3:] == [3, 3, 4] and k <= 4:
        names.append("groups 3-3-4")
    if s[-1].isalpha():
        names.append("ends in letters")
    if "  " in s or "\n" in s:
        names.append("two spaces")
    if letters and EMAIL_SHAPE.fullmatch(s):
        names.append("email shape")
    elif letters and SPELT_SHAPE.fullmatch(s):
        names.append("spelt email shape")
    if re.search(r"[0-9][-./]\Z", text[max(0, a - 2) : a]):
        names.append("number goes on left")
    if letters and text[max(0, a - 1) : a] in ADDRESS_MARKS:
        names.append("address goes on left")
    if re.match(r"[-./][0-9]", text[b : b + 2]):
        names.append("number goes on right")
    return [_AT[x] for x in names]


def segments(text: str) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token edges of a window, and its candidate entities as (first token, token after the last, features)."""
    edges = _edges(text)
    return edges, list(_candidates(text, edges))


def _edges(text: str) -> list[int]:
    return [0, *(m.end() for m in TOKEN.finditer(text))]


def _candidates(text: str, edges: list[int]):
    """Candidate entities in order of their first tokens."""
    for i in range(len(edges) - 1):
        start = text[edges[i]]
        if not (start.isalnum() or start in "+("):
            continue
        digits, groups, widest, dots, at = 0, 0, 0, 0, False
        for j in range(i + 1, min(i + LONGEST, len(edges) - 1) + 1):
            a, b = edges[j - 1], edges[j]
            if b - edges[i] > LONGEST_CHARS or "\n" in text[a:b]:
                break
            if "0" <= text[a] <= "9":
                digits, groups, widest = digits + b - a, groups + 1, max(widest, b - a)
                if digits > LONGEST or groups > MOST_GROUPS:
                    break
            dots += text[a] == "."
            at |= text[a:b] == "@" or text[a:b] in AT_WORDS
            if not text[b - 1].isalnum():
                continue
            # a number starts with a mark, has a long group, or is four octets
            number = digits >= 7 and (start in "+(" or start in "0123456789" and widest >= 3) or start in "0123456789" and digits >= 4 and dots >= 3
            if number or at:
                s = text[edges[i] : b]
                if LETTER.search(s) and not SPELT_SHAPE.fullmatch(s):
                    continue
                yield i, j, span_features(text, edges[i], b)


@dataclass
class Weights:
    """Weights of features [kind, feature], and of moves [state, kind]: state 0 is plain text, the others follow an entity of a kind."""

    spans: np.ndarray
    moves: np.ndarray


def _scores(weights: np.ndarray, spans) -> np.ndarray:
    out = np.empty((len(spans), len(weights)))
    for x, (_, _, f) in enumerate(spans):
        out[x] = weights[:, f].sum(1)
    return out


def _grouped(n: int, spans, which: int) -> list[list[int]]:
    """Places in spans by their first token (which 0) or the token after their last (1)."""
    out: list[list[int]] = [[] for _ in range(n + 1)]
    for x, span in enumerate(spans):
        out[span[which]].append(x)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def forward(n: int, spans, scores: np.ndarray, moves: np.ndarray, between) -> np.ndarray:
    """Log sums over segmentations of the first k tokens by the state after them; between: which tokens are separators."""
    ending, first = _grouped(n, spans, 1), np.array([s[0] for s in spans], int)
    out = np.full((n + 1, len(moves)), -np.inf)
    out[0, 0] = 0
    for k in range(1, n + 1):
        if between[k - 1]:
            out[k] = out[k - 1]
        else:
            out[k, 0] = _log_sum(out[k - 1], 0)
        if x := ending[k]:
            into = _log_sum(out[first[x]][:, :, None] + moves, 1)
            out[k, 1:] = np.logaddexp(out[k, 1:], _log_sum(into + scores[x], 0))
    return out


def backward(n: int, spans, scores: np.ndarray, moves: np.ndarray, between) -> np.ndarray:
    """Log sums over segmentations of what follows the first k tokens, by the state after these."""
    starting, last = _grouped(n, spans, 0), np.array([s[1] for s in spans], int)
    out = np.zeros((n + 1, len(moves)))
    for k in range(n - 1, -1, -1):
        out[k] = out[k + 1] if between[k] else out[k + 1, 0]
        if x := starting[k]:
            ahead = _log_sum(scores[x] + out[last[x], 1:], 0)
            out[k] = np.logaddexp(out[k], _log_sum(moves + ahead, 1))
    return out


def viterbi(n: int, spans, scores: np.ndarray, moves: np.ndarray, between) -> list[tuple[int, int]]:
    """The best segmentation's entities: (place in spans, place in KINDS) in order."""
    ending, first = _grouped(n, spans, 1), np.array([s[0] for s in spans], int)
    kinds = np.arange(moves.shape[1])
    best = np.full((n + 1, len(moves)), -np.inf)
    # of each state, the state before its last token, and the entity that ends there if any
    before, entity = np.zeros((n + 1, len(moves)), int), np.full((n + 1, len(moves)), -1)
    best[0, 0] = 0
    for k in range(1, n + 1):
        if between[k - 1]:
            best[k], before[k] = best[k - 1], range(len(moves))
        else:
            before[k] = best[k - 1].argmax()
            best[k, 0] = best[k - 1].max()
        if x := ending[k]:
            moved = best[first[x]][:, :, None] + moves
            found = moved.max(1) + scores[x]
            top = found.argmax(0)
            more = np.flatnonzero(found[top, kinds] > best[k, 1:])
            best[k, more + 1] = found[top[more], more]
            before[k, more + 1] = moved.argmax(1)[top[more], more]
            entity[k, more + 1] = np.array(x)[top[more]]
    out, k, state = [], n, int(best[n].argmax())
    while k:
        x, state, kind = int(entity[k, state]), int(before[k, state]), state - 1
        if x >= 0:
            out.append((x, kind))
        k = spans[x][0] if x >= 0 else k - 1
    return out[::-1]


def _plain(n: int, scores) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """Scores, moves without weight, and no separators."""
    table = np.array(scores, float).reshape(len(scores), -1) if len(scores) else np.zeros((0, len(KINDS)))
    return table, np.zeros((table.shape[1] + 1, table.shape[1])), [False] * n


def log_forward(n: int, spans, scores) -> np.ndarray:
    """Log sums over segmentations of the first k tokens, for each k, where moves weigh nothing."""
    return _log_sum(forward(n, spans, *_plain(n, scores)), 1)


def log_backward(n: int, spans, scores) -> np.ndarray:
    """Log sums over segmentations of what follows the first k tokens, where moves weigh nothing."""
    return backward(n, spans, *_plain(n, scores))[:, 0]


def generated(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A window of text and its entities."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvwy") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(n):
        body = num(n - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def phone():
        a, b, c = str(rng.randint(200, 989)), num(3), num(4)
        plus = rng.choice(["+1 ", "+44 ", "+49-", "+1-", "", ""])
        return plus + rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])

    def email():
        user = rng.choice([word(), word() + "." + word(), word() + num(2)])
        at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", ".")])
        return user + at + word() + dot + rng.choice(["com", "org", "net"])

    def ip():
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))

    def number():
        c = card(16)
        return rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4)), ".".join(c[i : i + 4] for i in range(0, 16, 4)), card(15), card(13)])

    def other():
        bad = next(c for c in iter(lambda: num(16), "") if not luhn(c))
        return rng.choice([num(rng.randint(1, 6)), "20%s-%s-%s" % (num(2), num(2), num(2)), f"{num(2)}.{num(2)}.{num(4)}", num(rng.randint(7, 12)), bad, f"{num(3)}-{num(4)}", f"{num(1)}.{num(1)}.{num(2)}", "300.%s.999.1" % num(3), f"{num(2)}:{num(2)}:{num(2)}", f"{num(5)}/{num(3)}-{num(2)}", f"$ {num(3)}.{num(2)}", f"at {word()} dot", "ISBN 978-%s-%s-%s-%s" % (num(1), num(4), num(4), num(1)), f"{num(4)} {num(4)} {num(3)}", f"{word()} at {word()}", num(21)])

    text, found = word() + " ", []
    kind = "other"
    for _ in range(rng.randint(1, 4)):
        if kind == "other" or rng.random() < 0.6:  # else a list of one kind goes on
            kind = rng.choice([*KINDS, "other", "other", "other"])
        s = {"email": email, "ip": ip, "card": number, "phone": phone, "other": other}[kind]()
        if kind != "other":
            found.append((len(text), len(text) + len(s), kind))
        text += s + rng.choice([" ", " ", " ", ", ", ". ", " " + word() + " "])
    return text + word(), found


def _separators(text: str, edges: list[int]) -> list[bool]:
    return [text[a].isspace() and "\n" not in text[a:b] or text[a:b] in SEPARATORS for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=1)
def trained() -> Weights:
    """Weights that maximise the likelihood of generated windows."""
    rng = random.Random(SEED)
    data = []
    for _ in range(WINDOWS):
        text, found = generated(rng)
        edges, spans = segments(text)
        place = {s[:2]: x for x, s in enumerate(spans)}
        want = sorted((place[edges.index(a), edges.index(b)], KINDS.index(k)) for a, b, k in found if a in edges and b in edges and (edges.index(a), edges.index(b)) in place)
        data.append((len(edges) - 1, spans, want, _separators(text, edges)))
    w = Weights(np.zeros((len(KINDS), len(FEATURES))), np.zeros((len(KINDS) + 1, len(KINDS))))
    w.spans[:, 0] = -2.0
    seen = Weights(np.full_like(w.spans, 1e-6), np.full_like(w.moves, 1e-6))
    for _ in range(EPOCHS):
        grad = Weights(np.zeros_like(w.spans), np.zeros_like(w.moves))
        for i, (n, spans, want, between) in enumerate(data):
            scores = _scores(w.spans, spans)
            behind, ahead = (f(n, spans, scores, w.moves, between) for f in (forward, backward))
            total = ahead[0, 0]
            for x, (a, b, f) in enumerate(spans):
                p = np.exp(behind[a][:, None] + w.moves + scores[x] + ahead[b, 1:] - total)
                grad.moves -= p
                grad.spans[:, f] -= p.sum(0)[:, None]
            at = state = 0
            for x, kind in want:
                a, b, f = spans[x]
                grad.moves[state if all(between[at:a]) else 0, kind] += 1
                grad.spans[kind, list(f)] += 1
                at, state = b, kind + 1
            if i % 8 == 7:
                for g, v, past in ((grad.spans, w.spans, seen.spans), (grad.moves, w.moves, seen.moves)):
                    g -= 0.01 * v
                    past += g**2
                    v += 0.5 * g / np.sqrt(past)
                    g[:] = 0
    return w


def _stretches(text: str, edges: list[int], between: list[bool]):
    """First token, number of tokens and candidates of each stretch of a window between words that none covers."""
    held, reach = [], 0
    for span in _candidates(text, edges):
        if held and span[0] > reach and not all(between[reach : span[0]]):
            yield held[0][0], reach - held[0][0], held
            held = []
        held.append(span)
        reach = max(reach, span[1])
    if held:
        yield held[0][0], reach - held[0][0], held


def log_odds(spans, scores: np.ndarray, path: list[tuple[int, int]], behind: np.ndarray, ahead: np.ndarray, moves: np.ndarray) -> list[float]:
    """Of each entity of a path, its probability over all segmentations against that of the ones without it."""
    out = []
    for x, kind in path:
        a, b, _ = spans[x]
        log_p = min(0.0, float(_log_sum(behind[a] + moves[:, kind], 0) + scores[x][kind] + ahead[b, kind + 1] - ahead[0, 0]))
        out.append(log_p - np.log(max(-np.expm1(log_p), 1e-300)))
    return out


def decode(text: str, weights: Weights, margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """The entities of the best segmentation whose log-odds reach the margin."""
    edges, out = _edges(text), []
    between, most = _separators(text, edges), weights.moves.max()
    for shift, n, spans in _stretches(text, edges, between):
        spans = [(i - shift, j - shift, f) for i, j, f in spans]
        scores, apart = _scores(weights.spans, spans), between[shift : shift + n]
        if scores.max() + most <= 0:  # no entity is worth its place on any path
            continue
        if path := viterbi(n, spans, scores, weights.moves, apart):
            behind, ahead = (f(n, spans, scores, weights.moves, apart) for f in (forward, backward))
            for (x, kind), odds in zip(path, log_odds(spans, scores, path, behind, ahead, weights.moves), strict=True):
                if odds >= margin:
                    out.append((edges[spans[x][0] + shift], edges[spans[x][1] + shift], KINDS[kind]))
    return out


TRIGGER = re.compile(r"[0-9][0-9 ().+/-]{5,}[0-9]|@|(?<=[A-Za-z0-9])[\x20\[({]+(?:at|AT)[\x20\])}]+[A-Za-z0-9-]+[\x20\[({]*(?:dot|DOT|\.)(?=[\x20\])}A-Za-z])")
AROUND = 48


def windows(text: str):
    """Ranges around triggers; those that touch are one."""
    last = None
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if last and a <= last[1]:
            last[1] = b
            continue
        if last:
            yield tuple(last)
        last = [a, b]
    if last:
        yield tuple(last)


def added_spans(text: str, base: list[tuple[int, int, str]], weights: Weights) -> list[tuple[int, int, str]]:
    """What the model finds beyond the base spans; a window that they explain alone is not decoded."""
    out, rest = [], text
    if base:  # base spans are ends of lines to the model
        marked = list(text)
        for a, b, _ in base:
            marked[a:b] = "\n" * (b - a)
        rest = "".join(marked)
    for a, b in windows(text):
        left = rest[a:b]
        if left != text[a:b] and not TRIGGER.search(left):
            continue
        for x, y, kind in decode(left, weights):
            # a word that the window's edge cuts is not whole
            if (x or not a or not text[a - 1].isalnum()) and (y < b - a or b == len(text) or not text[b].isalnum()):
                out.append((a + x, a + y, kind))
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id and an array of spans (start, end, kind, added) of every row, by kind and start."""
    weights = trained()

    def find(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("added", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                every = [(*s, False) for s in base] + [(*s, True) for s in added_spans(text, base, weights)]
                every.sort(key=lambda s: (KINDS.index(s[2]), s[0], s[1]))
                out.append([{"start": a, "end": b, "kind": k, "added": m} for a, b, k, m in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<start:long,end:long,kind:string,added:boolean>>"
    return docs.select(as_long(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text")).mapInArrow(lean(find), schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: ~s["added"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & ~s["added"])).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


SQL = None
