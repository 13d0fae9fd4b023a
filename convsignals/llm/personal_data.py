"""Personal data as a semi-Markov conditional random field over text segments.

Fixed patterns give the base spans. Around digits, ``@`` and spelled-out addresses the model scores whole candidate
segments of up to MAX_TOKENS tokens (shape, checksum, separators, words before) and a dynamic program chooses boundaries and
types together. It is trained by the gradient of its log likelihood on a bounded sample of snippets of the corpus: base
spans are the labels, and rewritten forms that the patterns miss (no plus sign, other separators, spelled-out ``@``)
teach it to go further. Base spans always stay; the model adds spans that do not overlap them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
TYPES = ["other", *KINDS]
#: An entity has at most so many tokens.
MAX_TOKENS = 8
#: Bound on the snippets of the corpus that a fit reads.
SAMPLE_SNIPPETS = 300
CONTEXT = 8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[\[({]at[\])}]|\bdot\b")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind in the order of KINDS; code points, end exclusive."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


# ------------------------------------------------------------------ segments
_MAILISH = re.compile(r"[\w.%+-]+\s*(?:@|[\[({]\s*at\s*[\])}]|\sat\s)\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[({]\s*dot\s*[\])}]|\sdot\s)\s*[A-Za-z0-9-]+)+", re.I)
_IPISH = re.compile(r"\d{1,3}(?:\s*(?:\.|\[\.\]|\(\.\))\s*\d{1,3}){3}")
_CARDISH = re.compile(r"\d{4}(?:[\s./_-]?\d{4}){2}[\s./_-]?\d{2,7}|\d{14,19}")
_PHONEISH = re.compile(r"(?:\+|00)?[\s]?\d{0,3}[\s.-]?\(?\d{2,4}\)?(?:[\s./-]\d{2,4}){1,4}")
_HINTS = {
    "phone": re.compile(r"^(?:tel|phone|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\W*$", re.I),
    "card": re.compile(r"^(?:card|visa|mastercard|credit|karte|carte|tarjeta)\W*$", re.I),
    "email": re.compile(r"^(?:mail|e-?mail|contact|correo)\W*$", re.I),
    "ip": re.compile(r"^(?:ip|host|server|address|addr)\W*$", re.I),
}
_JOINT = re.compile(r"[\[({]?(?:at|dot)[\])}]?", re.I)
FEATURES = [
    "bias", "mailish", "ipish", "octets", "cardish", "luhn", "phoneish", "plus", "paren", "at", "hex",
    "letters", "digits<7", "digits7-9", "digits10-12", "digits13-15", "digits16+", "one", "two", "three+",
    *(f"hint {k}" for k in KINDS), "glued left", "glued right", "open left", "open right",
]
_AT = {f: k for k, f in enumerate(FEATURES)}


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    """Without the punctuation around a segment."""
    while b > a and not (text[b - 1].isalnum()):
        b -= 1
    while a < b and not (text[a].isalnum() or text[a] == "+" or (text[a] == "(" and a + 1 < b and text[a + 1].isdigit())):
        a += 1
    return a, b


def _features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[int] | None:
    """Features of the segment of tokens i..j-1, or None if it cannot be an entity."""
    a, b = _trim(text, toks[i][0], toks[j - 1][1])
    if a >= b or (j - i > 1 and (a >= toks[i][1] or b <= toks[j - 1][0])):
        return None
    s = text[a:b]
    d = _digits(s)
    mail = bool(_MAILISH.fullmatch(s))
    if not mail and (len(d) < 7 and not (len(d) >= 4 and s.count(".") >= 3)):
        return None
    n = len(d)
    names = ["bias", "one" if j - i == 1 else "two" if j - i == 2 else "three+"]
    names.append("digits<7" if n < 7 else "digits7-9" if n < 10 else "digits10-12" if n < 13 else "digits13-15" if n < 16 else "digits16+")
    if mail:
        names.append("mailish")
    if _IPISH.fullmatch(s):
        names.append("ipish")
        if all(int(p) <= 255 for p in re.findall(r"\d+", s)):
            names.append("octets")
    if _CARDISH.fullmatch(s):
        names.append("cardish")
        if 14 <= n <= 19 and luhn(d):
            names.append("luhn")
    if _PHONEISH.fullmatch(s):
        names.append("phoneish")
    if s[0] == "+":
        names.append("plus")
    if s[0] == "(" or "(" in s:
        names.append("paren")
    if "@" in s:
        names.append("at")
    if re.fullmatch(r"[0-9a-f]{12,}", s) and not s.isdigit():
        names.append("hex")
    if any(c.isalpha() for c in s) and not mail:
        names.append("letters")
    if i:
        before = text[toks[i - 1][0] : toks[i - 1][1]]
        names += [f"hint {k}" for k, p in _HINTS.items() if p.match(before)]
        if _JOINT.fullmatch(before):
            names.append("open left")
    if j < len(toks) and _JOINT.fullmatch(text[toks[j][0] : toks[j][1]]):
        names.append("open right")
    if a > 0 and not text[a - 1].isspace():
        names.append("glued left")
    if b < len(text) and not text[b].isspace():
        names.append("glued right")
    return [_AT[x] for x in names]


def _candidates(text: str, toks: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    marked = [bool(_ANY.search(text, a, b)) for a, b in toks]
    out = {}
    for i in range(len(toks)):
        if not any(marked[i : i + MAX_TOKENS]):
            continue
        for j in range(i + 1, min(len(toks), i + MAX_TOKENS) + 1):
            if any(marked[i:j]):
                f = _features(text, toks, i, j)
                if f is not None:
                    out[i, j] = f
    return out


class SegmentModel:
    """Weights of segment features by type and of the succession of types; ``other`` segments are single tokens of score 0."""

    def __init__(self) -> None:
        self.w = np.zeros((len(FEATURES), len(TYPES)))
        self.t = np.zeros((len(TYPES), len(TYPES)))

    def _lattice(self, n: int, cand: dict) -> list[list[tuple[int, np.ndarray, list[int]]]]:
        """For each end: (start, score by type, features)."""
        other = np.full(len(TYPES), -np.inf)
        other[0] = 0.0
        ends = [[(j - 1, other, [])] if j else [] for j in range(n + 1)]
        for (i, j), f in cand.items():
            score = self.w[f].sum(0)
            score[0] = -np.inf
            ends[j].append((i, score, f))
        return ends

    def decode(self, n: int, cand: dict) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, end token, type) of its entities."""
        ends = self._lattice(n, cand)
        best = [(np.full(len(TYPES), -np.inf), None) for _ in range(n + 1)]
        best[0][0][0] = 0.0
        back: list[dict[int, tuple[int, int]]] = [{} for _ in range(n + 1)]
        for j in range(1, n + 1):
            here = best[j][0]
            for i, score, _ in ends[j]:
                step = best[i][0][:, None] + self.t + score
                prev = step.argmax(0)
                for k in range(len(TYPES)):
                    if step[prev[k], k] > here[k]:
                        here[k] = step[prev[k], k]
                        back[j][k] = (i, int(prev[k]))
        j, k, out = n, int(best[n][0].argmax()), []
        while j:
            i, p = back[j][k]
            if k:
                out.append((i, j, k))
            j, k = i, p
        return out[::-1]

    def step(self, n: int, cand: dict, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log likelihood: observed minus expected features, by forward and backward sums."""
        ends, kinds = self._lattice(n, cand), len(TYPES)
        alpha, beta = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
        alpha[0, 0], beta[n] = 0.0, 0.0
        for j in range(1, n + 1):
            steps = [np.logaddexp.reduce(alpha[i][:, None] + self.t, 0) + s for i, s, _ in ends[j]]
            alpha[j] = np.logaddexp.reduce(steps, 0)
        for j in range(n, 0, -1):
            for i, s, _ in ends[j]:
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.t + s + beta[j], 1))
        z = np.logaddexp.reduce(alpha[n])
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        for j in range(1, n + 1):
            for i, s, f in ends[j]:
                p = np.exp(alpha[i][:, None] + self.t + s + beta[j] - z)
                gt -= p
                if f:
                    gw[f] -= p.sum(0)
        at = {j: (i, k) for i, j, k in gold}
        j, spans = n, []
        while j:
            i, k = at.get(j, (j - 1, 0))
            spans.append((i, j, k))
            j = i
        prev = 0
        for i, j, k in reversed(spans):
            gt[prev, k] += 1
            if k:
                gw[cand[i, j], k] += 1
            prev = k
        gw[:, 0] = 0
        self.w += rate * (gw - 0.002 * self.w)
        self.t += rate * (gt - 0.002 * self.t)


def _example(text: str, spans: list[tuple[int, str, int]]):
    """(tokens, candidates, gold) or None if a span is no candidate segment."""
    toks = _tokens(text)
    cand = _candidates(text, toks)
    gold = []
    for a, kind, b in spans:
        hit = [(i, j) for i, j in cand if _trim(text, toks[i][0], toks[j - 1][1]) == (a, b)]
        if not hit:
            return None
        gold.append((*hit[0], TYPES.index(kind)))
    gold.sort()
    return None if any(x[1] > y[0] for x, y in zip(gold, gold[1:])) else (len(toks), cand, gold)


def _rewritten(kind: str, s: str, turn: int) -> str:
    """Another common form of an entity, which the fixed patterns do not match."""
    d = _digits(s)
    if kind == "email":
        name, _, host = s.partition("@")
        return [f"{name} [at] {host}", f"{name} at {host.replace('.', ' dot ')}", f"{name}(at){host.replace('.', '(dot)')}"][turn % 3]
    if kind == "ip":
        return s.replace(".", ["[.]", " . ", "(.)"][turn % 3])
    if kind == "card":
        return [".", "/", "_"][turn % 3].join(d[k : k + 4] for k in range(0, len(d), 4))
    n = d[-10:]
    return [f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}"][turn % 3]


def fit(snippets: list[str], epochs: int = 6) -> SegmentModel:
    """Model from snippets labelled by the fixed patterns, each also in a rewritten form. No snippets: it adds nothing."""
    examples = []
    for turn, text in enumerate(snippets):
        spans = base_spans(text)
        if any(x[2] > y[0] for x, y in zip(spans, spans[1:])):
            continue
        examples.append(_example(text, spans))
        if spans:
            out, places, at = "", [], 0
            for a, kind, b in spans:
                new = _rewritten(kind, text[a:b], turn)
                out += text[at:a]
                places.append((len(out), kind, len(out) + len(new)))
                out += new
                at = b
            examples.append(_example(out + text[at:], places))
    model = SegmentModel()
    model.w[_AT["bias"], 1:] = -2.0
    examples = [x for x in examples if x]
    for k in range(epochs):
        for n, cand, gold in examples:
            model.step(n, cand, gold, 0.3 / (1 + k))
    return model


def all_spans(text: str, model: SegmentModel) -> tuple[list, list]:
    """Base spans and all spans of a whole text."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    toks = _tokens(text)
    cand = _candidates(text, toks)
    found = list(base)
    # Tokens without a candidate split the text into independent stretches.
    stretch: list[tuple[int, int]] = []
    for i, j in sorted(cand):
        if stretch and i <= stretch[-1][1]:
            stretch[-1] = (stretch[-1][0], max(j, stretch[-1][1]))
        else:
            stretch.append((i, j))
    by_start: dict[int, list[int]] = {}
    for i, j in cand:
        by_start.setdefault(i, []).append(j)
    for lo, hi in stretch:
        part = {(i - lo, j - lo): cand[i, j] for i in range(lo, hi) for j in by_start.get(i, ()) if j <= hi}
        for i, j, k in model.decode(hi - lo, part):
            a, b = _trim(text, toks[lo + i][0], toks[lo + j - 1][1])
            if not any(a < e and s < b for s, _, e in base):
                found.append((a, TYPES[k], b))
    return base, sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _snippets(text: str, most: int = 3) -> list[str]:
    """Up to ``most`` stretches of tokens around what may be personal data, for training only."""
    toks, out, last = _tokens(text), [], -1
    for k, (a, b) in enumerate(toks):
        if k > last and _ANY.search(text, a, b) and len(out) < most:
            lo, last = max(0, k - CONTEXT), min(len(toks), k + CONTEXT) - 1
            out.append(text[toks[lo][0] : toks[last][1]])
    return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def training_snippets(docs: DataFrame, most: int = SAMPLE_SNIPPETS) -> list[str]:
    """At most ``most`` snippets, the first in the order of a hash of their text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {s for t in b["text"] for s in _snippets(t) if len(s) <= 400}
            yield pd.DataFrame({"s": sorted(rows)}, dtype="object")

    some = docs.filter(F.col("text").rlike("[0-9]{5}|[0-9]\\.[0-9]+\\.|@")).select("text")
    rows = some.mapInPandas(cut, "s string").distinct().orderBy(F.xxhash64("s"), "s").limit(most).collect()
    return [r["s"] for r in rows]


def personal_data(docs: DataFrame, sample_snippets: int = SAMPLE_SNIPPETS) -> DataFrame:
    """Personal data of every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (long; base spans), base_sha256 (of the base spans), spans (all spans,
    ``kind:start:end`` by start, then kind, joined by commas; empty for none), n_added (spans of the model alone). A null
    text counts as empty; null ids and repeated rows stay; an empty table gives an empty result; other columns are not
    read. A text without digits, ``@`` or a spelled-out address is passed over; all others are read to their end.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    model = fit(training_snippets(d, sample_snippets))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                base, found = all_spans(text, model)
                count = [sum(kind == k for _, kind, _ in base) for k in KINDS]
                rows.append((*count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), len(found) - len(base)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return d.mapInPandas(find, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")
