"""Personal data: fixed patterns, and a semi-Markov conditional random field for the forms they miss.

The base patterns find plain e-mail addresses, IPv4 addresses, 16 to 19 digit card numbers and international phone
numbers. The semi-CRF adds whole spans that the patterns leave out: spelled-out e-mail addresses (``jo at mail dot
org``), national phone numbers, 13 to 15 digit cards, IPv6 addresses and social security numbers. It scores candidate
segments by features of the whole span (its digit groups, checksum, separators, neighbours), and a dynamic program
over segments picks boundaries and kinds jointly. Entities are bounded: a segment has at most MAX_LEN tokens, and MAX_CHARS
characters, the length of the longest mail address. ``CANDIDATE`` is the one rule for what can be a segment at all
(enough digits and no letters, two colons, or a spoken "at" beside a spoken "dot" or in brackets); it is evaluated for
all segments of a text at once, on counts per token, and every segment that it admits is scored.

The weights are trained here, on the driver, by gradient ascent on the conditional log-likelihood of generated
sentences (``training_sentences``; a fixed number from a fixed seed): there is no labelled personal data to learn from.

Defined cases: a null or empty text has no spans (its hash is that of the empty string); texts of any length are read
whole, in time linear in their length; null and repeated ids are carried through; repeated rows give repeated results; of
two segmentations with one score the one with fewer spans is taken; extra columns are ignored by the scan and kept by
the redaction; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn")
MAX_LEN, MAX_CHARS = 31, 320
MARGIN = 2.0
# The base forms. Possessive and anchored where this cannot change a match, so that they stay linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DOTTED = re.compile(r"[0-9][0-9.]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns: leftmost, non-overlapping for each kind; failing matches are dropped without a retry."""
    out = []
    at, p = 0, text.find("@")
    while p >= 0:
        s = p
        while s > at and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            out.append(("email", s, m.end()))
            at = m.end()
        else:
            at = p + 1
        p = text.find("@", at)
    if not _DIGITS.search(text):
        return out
    if text.count(".") >= 3:
        for run in _DOTTED.finditer(text):
            if run[0].count(".") >= 3:
                for m in _IP.finditer(text, *run.span()):
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                        out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --------------------------------------------------------------------------------------------------------------
# semi-CRF

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_SPOKEN = re.compile(r"(?<![^\W_])(?:dot|DOT|Dot)(?![^\W_])")
_PREFIX = re.compile(r"\+[0-9]{1,3}[ .-]?\Z")  # a country code left of a national number
_AT = re.compile(r"(?<![^\W_])at(?![^\W_])", re.I)
_BRACKETED = re.compile(r"[\[(]at[\])]", re.I)
_STARTS = 1 << 15  # segments of so many first tokens are looked at together
_CUES = {
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "dial"},
    "card": {"card", "visa", "amex", "mastercard", "credit", "cc"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "email": {"email", "mail", "contact", "write", "e"},
    "ssn": {"ssn", "social", "security"},
    "number": {"order", "version", "page", "year", "invoice", "total", "price", "date", "section", "items", "v", "no", "nr"},
}


def features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the segment of tokens i to j-1: of the span as a whole and of its neighbours."""
    s, e = toks[i][0], toks[j - 1][1]
    span = text[s:e]
    digits = "".join(_DIGITS.findall(span))
    letters = re.findall(r"[^\W\d_]+", span)
    low = {w.lower() for w in letters}
    n = len(digits)
    groups = tuple(len(g) for g in re.findall(r"[0-9]+", span))
    f = ["bias", f"nd={min(n, 20)}", f"groups={groups[:6]}", f"letters={bool(letters)}", f"len={j - i}"]
    f.append(f"luhn={n >= 13 and luhn(digits)},{min(n, 20)}")
    f.append("seps=" + "".join(sorted(set(re.sub(r"[\w]", "", span))))[:8])
    f.append(f"mailish={'at' in low and bool(re.fullmatch(_SPELLED, span))}")
    f.append(f"ipv6={bool(re.fullmatch(_IPV6, span))}")
    f.append(f"nanp={bool(re.fullmatch(_NANP, span))}")
    f.append(f"ssnish={bool(re.fullmatch(_SSN, span))}")
    before = text[s - 1] if s else " "
    after = text[e] if e < len(text) else " "
    glued = (before.isalnum() or before in "-._+/$€:@") or (after.isalnum() or after in "-_/%@" or (after in ".:," and e + 1 < len(text) and text[e + 1].isalnum()))
    f.append(f"glued={glued}")
    near = {text[a:b].lower() for a, b in toks[max(0, i - 3) : i]}
    f += [f"cue={k}" for k, words in _CUES.items() if near & words]
    # a span that stops short of a neighbouring dot or at, or of one more group of digits
    spoken = lambda k: 0 <= k < len(toks) and text[slice(*toks[k])].lower() in ("dot", "at")
    more = lambda k, a, b: 0 <= k < len(toks) and text[toks[k][0]].isdigit() and text[a:b] in (" ", "-", ".", "")
    edge = lambda k: spoken(k) or (0 <= k < len(toks) and text[toks[k][0]] in "[]()" and (spoken(k - 1) or spoken(k + 1)))
    f.append(f"open={bool(letters) and (edge(i - 1) or edge(j))}")
    f.append(f"cut={not letters and (more(i - 1, toks[i - 1][1], s) or more(j, e, toks[j][0] if j < len(toks) else e))}")
    if n and not letters:
        f += [f"lead={digits[0]}", f"lead={digits[0]},groups={groups[:6]}"]
    return f


_SAID_AT = r"(?:[ ](?:at|AT|At)[ ]|[ ]?[\[(](?:at|AT|At)[\])][ ]?)"
_SAID_DOT = r"(?:[ ](?:dot|DOT|Dot)[ ]|[ ]?[\[(](?:dot|DOT|Dot)[\])][ ]?)"
_SPELLED = rf"[A-Za-z0-9]+(?:(?:[ ]?[._-][ ]?|{_SAID_DOT})[A-Za-z0-9]+)*(?:{_SAID_AT}[A-Za-z0-9-]+(?:{_SAID_DOT}[A-Za-z0-9-]+)+|[ ]?[\[(](?:at|AT|At)[\])][ ]?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
_IPV6 = r"(?=.*:.*:)(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4})?"
_NANP = r"(?:1[-. ])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}"
_SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"


def tokens(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, lo, hi)]


def candidate(text: str, toks: list[tuple[int, int]], i: int, j: int) -> bool:
    """A segment that can be personal data at all: it starts and ends with a word, number or bracket, in one line."""
    s, e = toks[i][0], toks[j - 1][1]
    first, last = text[s], text[e - 1]
    if not (first.isalnum() or first in "(:") or not (last.isalnum() or last in ":)") or e - s > MAX_CHARS or "\n" in text[s:e]:
        return False
    span = text[s:e]
    if span.count(":") >= 2:
        return True
    if any(ch.isalpha() for ch in span):
        return j - i >= 5 and bool(_AT.search(span)) and bool(_SPOKEN.search(span) or _BRACKETED.search(span))
    return 7 <= len(_DIGITS.findall(span)) <= 19


def candidates(text: str, toks: list[tuple[int, int]], lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int]]:
    """All (i, j) of ``candidate`` with lo <= i < hi, by counts of each token's colons, letters, digits and marks."""
    n = len(toks)
    hi = n if hi is None else hi
    for a in range(lo, hi, _STARTS):
        b, top = min(hi, a + _STARTS), min(n, a + _STARTS + MAX_LEN)
        part = toks[a:top]
        if not part:
            return
        words = [text[s:e] for s, e in part]
        before = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        colons = before([w == ":" for w in words])
        letters = before([not w.isdigit() and any(map(str.isalpha, w)) for w in words])
        digits = before([len(_DIGITS.findall(w)) if not w.isalpha() else 0 for w in words])
        start, stop = np.array(part, np.int64).T
        # a mark counts at its first and is complete at its last token
        base, window = part[0][0], text[part[0][0] : part[-1][1]]
        marks = {}
        for name, pattern in (("at", _AT), ("dot", _SPOKEN), ("round", _BRACKETED)):
            got = np.array([m.span() for m in pattern.finditer(window)], np.int64).reshape(-1, 2) + base
            firsts = np.searchsorted(start, got[:, 0], "right") - 1
            lasts = np.searchsorted(stop, got[:, 1], "left")
            marks[name] = (firsts, lasts)
        breaks = np.array([m.start() for m in re.finditer("\n", window)], np.int64) + base
        line = np.searchsorted(breaks, start)
        opens = np.array([w[0].isalnum() or w[0] in "(:" for w in words])
        closes = np.array([w[-1].isalnum() or w[-1] in ":)" for w in words])
        i = np.arange(b - a)
        found = []
        for size in range(1, min(MAX_LEN, len(part)) + 1):
            x = i[: len(part) - size + 1]
            y = x + size
            ok = opens[x] & closes[y - 1] & (stop[y - 1] - start[x] <= MAX_CHARS) & (line[x] == line[y - 1])
            plain = (letters[y] == letters[x]) & (digits[y] - digits[x] >= 7) & (digits[y] - digits[x] <= 19)
            hit = plain | (colons[y] - colons[x] >= 2)
            if size >= 5 and len(marks["at"][0]):
                inside = lambda m: _inside(*m, x, y)  # noqa: B023, E731
                hit = hit | ((letters[y] > letters[x]) & inside(marks["at"]) & (inside(marks["dot"]) | inside(marks["round"])))
            x = x[ok & hit]
            found += zip((x + a).tolist(), (x + a + size).tolist())
        yield from sorted(found)


def _inside(firsts: np.ndarray, lasts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether segments [x, y) hold a mark from its first to its last token."""
    if not len(firsts):
        return np.zeros(len(x), bool)
    k = np.searchsorted(firsts, x)
    return (k < len(firsts)) & (lasts[np.minimum(k, len(firsts) - 1)] < y)


class SemiCRF:
    """Weights of each feature, one for each kind. Outside tokens are segments of one token and score 0."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.w = weights or {}

    def scores(self, f: list[str]) -> list[float]:
        return [sum(v) for v in zip(*(self.w[x] for x in f if x in self.w))] or [0.0] * len(KINDS)

    def segments(self, text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
        return [(i, j, features(text, toks, i, j)) for i, j in candidates(text, toks)]

    def decode(self, text: str, toks: list[tuple[int, int]], taken: list[tuple[int, int]] = ()) -> list[tuple[str, int, int]]:
        """Best segmentation whose segments touch no ``taken`` characters: values are kept at segment ends only, as
        outside tokens score 0."""
        free = np.array([-1, *(e for _, e in taken)])
        busy = [s for s, _ in taken] + [len(text) + 1]
        scored = []
        for i, j in candidates(text, toks):
            s, e = toks[i][0], toks[j - 1][1]
            if not taken or busy[int(np.searchsorted(free, s, "right")) - 1] >= e:
                f = features(text, toks, i, j)
                scored += [(j, x, i, k) for k, x in zip(KINDS, self.scores(f)) if x > MARGIN]
        if not scored:
            return []
        ends, value, back = [0], [0.0], [None]
        for j, x, i, k in sorted(scored, key=lambda v: v[0]):
            if j > ends[-1]:
                ends.append(j)
                value.append(value[-1])
                back.append(None)
            before = bisect_right(ends, i) - 1
            if value[before] + x > value[-1]:
                value[-1], back[-1] = value[before] + x, (before, i, k)
        out, at = [], len(ends) - 1
        while at:
            if back[at]:
                before, i, k = back[at]
                out.append((k, toks[i][0], toks[ends[at] - 1][1]))
                at = before
            else:
                at -= 1
        return out[::-1]

    def step(self, toks: list[tuple[int, int]], segments: list[tuple[int, int, list[str]]], gold: list[tuple[str, int, int]], rate: float) -> float:
        """One step of ascent on log p(gold | text): forward and backward sums over segmentations."""
        n = len(toks)
        segs = [(i, j, f, k, s) for i, j, f in segments for k, s in enumerate(self.scores(f))]
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for x in segs:
            by_end.setdefault(x[1], []).append(x)
            by_start.setdefault(x[0], []).append(x)
        fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            fwd[j] = _logsum([fwd[j - 1], *(fwd[x[0]] + x[4] for x in by_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            bwd[i] = _logsum([bwd[i + 1], *(x[4] + bwd[x[1]] for x in by_start.get(i, ()))])
        want = {(s, e, k) for k, s, e in gold}
        total = fwd[n]
        for i, j, f, k, s in segs:
            hit = (toks[i][0], toks[j - 1][1], KINDS[k]) in want
            total -= s * hit
            d = rate * (hit - math.exp(fwd[i] + s + bwd[j] - fwd[n]))
            if abs(d) > 1e-6:
                for x in f:
                    self.w.setdefault(x, [0.0] * len(KINDS))[k] += d
        return total


def _logsum(v: list[float]) -> float:
    m = max(v)
    return m + math.log(sum(math.exp(x - m) for x in v))


def training_sentences(n: int = 700, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with at most two marked spans each, and look-alikes that are not personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(1, 9)))

    def card(k):
        x = r.choice("3456") + d(k - 2)
        x = next(x + str(t) for t in range(10) if luhn(x + str(t)))
        gap = r.choice(["", "", " ", "-"])
        return x if k != 15 else gap.join((x[:4], x[4:10], x[10:]))

    def phone():
        a, b, e = str(r.randint(2, 9)) + d(2), str(r.randint(2, 9)) + d(2), d(4)
        pairs = " ".join(d(2) for _ in range(4))
        national = [f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(4)} {d(6)}", f"0{r.randint(1, 9)} {pairs}", f"0{d(2)} {d(7)}", f"0{d(3)} {d(6)}", f"0{d(2)}-{d(4)}-{d(4)}", f"0{d(2)}/{d(7)}", f"0{d(3)}-{d(7)}", f"00{d(2)} {d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(6)}"]
        return r.choice([f"({a}) {b}-{e}", f"{a}-{b}-{e}", f"{a}.{b}.{e}", f"1-{a}-{b}-{e}", *r.sample(national, 6)])

    def mail():
        at, dot = r.choice([("at", "dot"), ("[at]", "[dot]"), ("(at)", "(dot)"), ("AT", "DOT")])
        local = [word() + r.choice(["", d(2)]) for _ in range(r.choice([1, 1, 2, 3]))]
        domain = [word() for _ in range(r.choice([1, 1, 2]))] + [r.choice(["com", "org", "net", "de", "uk"])]
        if at[0] in "[(" and r.random() < 0.4:  # no blanks, or a written dot
            gap, said = r.choice([("", dot), ("", "."), (" ", ".")])
            return r.choice([".", "_"]).join(local) + f"{gap}{at}{gap}" + said.join(domain)
        return r.choice([f" {dot} ", f" {dot} ", ".", "_"]).join(local) + f" {at} " + f" {dot} ".join(domain)

    def ssn():
        return f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"

    def six():
        return ":".join(f"{r.randint(1, 65535):x}" for _ in range(8)) if r.random() < 0.6 else f"fe80::{r.randint(256, 65535):x}:{r.randint(256, 65535):x}"

    marked = {"card": lambda: card(r.choice([13, 14, 15, 15])), "phone": phone, "email": mail, "ssn": ssn, "ip": six}
    plain = [lambda: d(r.randint(1, 12)), lambda: d(r.randint(13, 22)), lambda: f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}",
             lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: f"look at {word()} and {word()} dot {word()}", lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(2)}-{d(3)}-{d(2)}",
             lambda: f"{d(1)} {d(2)} {d(3)} {d(1)} {d(2)}", lambda: f"{d(3)}-{d(4)}-{d(5)}", lambda: hashlib.md5(d(5).encode()).hexdigest(), lambda: f"{d(6)}/{d(4)}", lambda: f"{d(5)}-{d(4)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + r.choice([" ", ": ", " "])
            if r.random() < 0.45:
                k = r.choice(list(marked))
                if r.random() < 0.4:
                    text += r.choice(sorted(_CUES[k])) + " "
                v = marked[k]()
                gold.append((k, len(text), len(text) + len(v)))
            else:
                if r.random() < 0.2:
                    text += r.choice(sorted(_CUES[r.choice(list(_CUES))])) + " "
                v = r.choice(plain)()
            text += v + r.choice([" ", ". ", ", "])
        out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiCRF:
    model = SemiCRF()
    data = [(t := tokens(text, 0, len(text)), model.segments(text, t), gold) for text, gold in training_sentences()]
    for epoch in range(3):
        for toks, segments, gold in data:
            model.step(toks, segments, gold, 0.5 / (1 + epoch))
    return model


def added_spans(text: str, model: SemiCRF, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Segments of the semi-CRF, over the whole text, that no base span touches."""
    if text.count(":") < 2 and not (_AT.search(text) and (_SPOKEN.search(text) or _BRACKETED.search(text))) and len(_DIGITS.findall(text)) < 7:
        return []  # nothing in the text can be a candidate
    taken: list[tuple[int, int]] = []
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = []
    for k, s, e in model.decode(text, tokens(text, 0, len(text)), taken):
        m = _PREFIX.search(text, max(0, s - 6), s) if k == "phone" else None
        out.append((k, m.start() if m else s, e))
    return out


def find_pii(text: str, model: SemiCRF) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, each by kind as listed, then start."""
    base = base_spans(text)
    order = lambda spans: sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))
    return order(base), order(base + added_spans(text, model, base))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind, e.g. ``[EMAIL]``; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pa.RecordBatch], model: SemiCRF) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 5 + [pa.string()] * 2
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            base, spans = find_pii(text.as_py() or "", model)
            say = lambda v: ",".join(f"{k}:{s}:{e}" for k, s, e in v)
            rows.append((doc_id.as_py(), *(sum(x[0] == k for x in base) for k in BASE_KINDS), hashlib.sha256(say(base).encode()).hexdigest(), say(spans)))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    model = trained()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scan(b, model), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact_pii(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data replaced in ``text`` (null stays null); ``n_chars``, if there, follows."""
    model = trained()

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = [None if (t := v.as_py()) is None else redact(t, s) if (s := find_pii(t, model)[1]) else t for v in batch.column(i)]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            k = batch.schema.get_field_index("n_chars")
            if k >= 0:
                chars = [old.as_py() if t is None else len(t) for t, old in zip(texts, batch.column(k))]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(chars, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
