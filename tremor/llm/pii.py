"""Personal data in whole texts: generators propose spans, boosted trees choose among them.

The base spans of four kinds (email, ip, card, phone) follow fixed patterns and checks and
always stay.  Generators of high recall propose further spans: looser forms of the four, and
secrets and account numbers.  A gradient-boosted model scores each proposal by its format and
its context; its probabilities are calibrated on a quarter of the cases, set aside, and each kind has the
lowest threshold (halfway to the next case) at which those cases reach ``PRECISION``.  Chosen spans that overlap no base span and
no better chosen one are added.

There are no labelled spans, so the model learns from the corpus by rules that are sure: base
spans, in their contexts and also written in other ways (spaced, spelled out, without a country
code), are positive; proposals that fail the checks, and look-alikes (dates, versions, sums,
order numbers, digests) put in the same contexts, are negative.  Every document gives its cases, and
all of them are learned from, in tasks: equal cases are counted, each tree level is a pass over them.

Positions are code points, the end is exclusive.  Null texts count as empty.  A null doc_id
stays null; rows that repeat are each looked at; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .boosting import BINS, STEPS, Boosted, boost_cases, margin_counts, platt, sigmoid
from .common import hands, mapped, record

KINDS = ("email", "ip", "card", "phone", "secret", "account")
BASE = KINDS[:4]
# Fewer cases than this teach nothing, and one of so many is set aside.
FEWEST = 50
ASIDE = 4
PRECISION = 0.98
CONTEXT = 40

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str):
    """Matches of the email pattern, found from their @ so that long runs are read once."""
    at, done = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            yield start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans by kind and start, and the matches of the patterns that fail the checks."""
    found, failed = [], []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            (found if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts) else failed).append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            (found if 16 <= len(digits) <= 19 and luhn(digits) else failed).append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            (found if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15 else failed).append(("phone", *m.span()))
    return found, failed


# The generators of further proposals.
_AT, _DOT = r"(?:\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\s(?:at|AT)\s|@)", r"(?:\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s|\.)"
_GENERATORS = [
    ("email", re.compile(rf"(?<![\w.])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}(?!\w)")),
    ("ip", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4}){1,2}(?![\w:])")),
    ("card", re.compile(r"(?<![\w.-])[0-9]{4}(?:[ .– -]?[0-9]{4}){2}[ .– -]?[0-9]{1,7}(?![\w-])|(?<!\w)3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?!\w)")),
    ("card", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w.+-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-])")),
    ("account", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)|(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("secret", re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<![A-Za-z])(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,200}"
                         r"|(?<![\w/-])(?:gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,200}")),
]
_HINTS = {
    "email": re.compile(r"mail|contact|write to|address", re.I), "ip": re.compile(r"\bip\b|host|server|addr|login", re.I),
    "card": re.compile(r"card|visa|credit|pay", re.I), "phone": re.compile(r"phone|call|tel\b|tel:|mobile|fax|dial", re.I),
    "secret": re.compile(r"pass|token|secret|key|=", re.I), "account": re.compile(r"iban|account|ssn|social|bank", re.I),
}
_AGAINST = re.compile(r"version|order|invoice|isbn|date|no\.|nr\.|page|ticket|ref|build|\bv\.?$|[$€£]\s*$", re.I)
# What a text must hold for any proposal of a generator, in the order of the generators: whatever it finds has one of these.
_DIGITS = tuple("0123456789")
_NEEDS = [("@", "at", "AT"), (":",), _DIGITS, _DIGITS, _DIGITS, _DIGITS, ("=", ":", "AKIA", "ASIA", "gh", "sk-", "xox")]


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans that the generators propose, overlapping ones too.  A card number always passes its check digit."""
    found = [(kind, *m.span()) for (kind, pattern), needs in zip(_GENERATORS, _NEEDS, strict=True) if any(x in text for x in needs) for m in pattern.finditer(text)]
    return [(kind, a, b) for kind, a, b in found if kind != "card" or luhn(re.sub("[^0-9]", "", text[a:b]))]


def features(kind: str, value: str, before: str, after: str) -> list[float]:
    """Format of a span, and what stands around it."""
    digits = re.sub("[^0-9]", "", value)
    groups = [len(g) for g in re.findall("[0-9]+", value)]
    n = max(1, len(value))
    chars = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * np.log2(k / n) for k in chars.values())
    day = len(groups) == 3 and (groups in ([4, 2, 2], [2, 2, 4]) or max(groups) <= 2)
    return [
        *(float(kind == k) for k in KINDS), len(value), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        sum(map(str.isalpha, value)) / n, sum(map(str.isupper, value)) / n, sum(map(str.isspace, value)), sum(value.count(c) for c in "-./"),
        value.count("("), float(value[:1] == "+"), float(bool(digits) and luhn(digits)), float(len(set(groups)) == 1), entropy, float(day),
        value.count("@"), value.count(":"), value.count("="), float(value[:2] == "00"),
        float(len(re.findall("(?i)\\b(?:at|dot)\\b", value))), float(bool(digits) and len(set(digits)) <= 2),
        float(before[-1:].isspace() or not before), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1].isspace() or not after),
        float(bool(_HINTS[kind].search(before))), float(bool(_AGAINST.search(before[-16:]))),
    ]


# The bins of the features, in their order.
_FLAG, _COUNT, _SHARE, _ENTROPY = (np.array(e, dtype=float) for e in (
    [0.5], [*range(21), 22, 24, 28, 32, 36, 40, 48, 64, 128, 256], np.arange(1, BINS) / BINS, np.arange(1, BINS) / 5))
EDGES = [*[_FLAG] * len(KINDS), *[_COUNT] * 5, _SHARE, _SHARE, *[_COUNT] * 3, *[_FLAG] * 3, _ENTROPY, _FLAG, *[_COUNT] * 3, _FLAG, _COUNT, *[_FLAG] * 7]


def _rewritten(kind: str, value: str, draw: random.Random) -> tuple[str, str]:
    """A base span written in another way that only the generators know, or as another kind of personal data."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        local, _, domain = value.partition("@")
        at = draw.choice([" [at] ", "(at)", " at ", " {at} ", "@"])
        return kind, f"{local}{at}{domain.replace('.', draw.choice([' [dot] ', ' dot ', '(dot)', ' (dot) '] + ['.'] * (at != '@')))}"
    if kind == "phone":
        d = digits[-10:].rjust(10, "5")
        return kind, draw.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}"])
    if kind == "card":
        return draw.choice([(kind, ".".join(digits[i:i + 4] for i in range(0, 16, 4))), ("account", "DE" + digits[:2] + " " + " ".join(digits[i:i + 4] for i in range(0, 16, 4))),
                            ("account", f"{digits[:3]}-{digits[3:5]}-{digits[5:9]}")])
    hexes = hashlib.sha256(value.encode()).hexdigest()
    if draw.random() < 0.3:
        return kind, ":".join(hexes[i:i + 4] for i in range(0, 32, 4))
    return "secret", _secret(hexes, draw)


def _secret(hexes: str, draw: random.Random) -> str:
    """A secret in one of many forms."""
    letters = "".join(chr(97 + int(c, 16) + (8 if draw.random() < 0.5 else 0)) for c in hexes[:24])
    mixed = "".join(c.upper() if draw.random() < 0.4 else c for c in letters)
    value = draw.choice([hexes[:draw.choice([12, 16, 24, 32, 40])], letters[:draw.randint(8, 20)] + draw.choice(["", "!", "1", "#7"]), mixed[:draw.randint(8, 24)], mixed[:8] + hexes[:8]])
    name = draw.choice(["password", "passwd", "pass", "pwd", "token", "api_key", "apikey", "api-key"])
    return draw.choice([f"{name}{draw.choice(['=', ': ', ' = ', ':'])}{draw.choice(['', chr(34), chr(39)])}{value}", "AKIA" + hexes[:16].upper(),
                        "ghp_" + (mixed + hexes)[:36], "sk-" + (mixed + hexes)[:draw.choice([32, 48])]])


def _lookalike(value: str, draw: random.Random) -> tuple[str, str]:
    """Something of the kinds' form that isn't personal data."""
    d = [draw.randrange(10) for _ in range(24)]
    s = "".join(map(str, d))
    return draw.choice([
        ("phone", f"20{s[:2]}-0{d[2] % 9 + 1}-{d[3] % 3}{d[4]}"), ("phone", f"{s[:3]} {s[3:6]} {s[6:9]}"), ("phone", f"{s[:2]}.{s[2:5]}.{s[5:8]}"), ("phone", f"{s[:3]}/{s[3:7]}"),
        ("phone", f"{s[:4]}-{s[4:8]}"), ("card", " ".join(["0000"] * 4)), ("card", s[:13]), ("card", s[:16] if not luhn(s[:16]) else s[:12]), ("card", " ".join(s[i:i + 4] for i in range(0, 12, 4))),
        ("account", "AB12" + " ABCD" * 2), ("account", f"000-00-{s[:4]}"), ("ip", f"{s[0]}:{s[1:3]}:{s[3:5]}:{s[5:7]}"), ("email", "meet at noon dot com"), ("email", f"look at {s[:2]}.{s[2:4]}"),
        ("email", "be at home.The"), ("email", "is at it.And"), ("secret", "password: required"), ("secret", "token: string."), ("secret", "token = tokens"), ("secret", "pass = passage")])


_NO_SECRETS = ("password: required", "token: string.", "token = tokens", "pass = passage", "password: (none)", "Token: expires", "pwd = getpwd()", "secret: unknown",
               "pass: <empty>", "api_key: string,", "password: ********", "passwd: command")


def cases(text: str, seed: int) -> list[tuple[list[float], int]]:
    """Labelled feature vectors that a text gives."""
    draw = random.Random(seed)
    found, failed = base_spans(text)
    out = []
    for kind, a, b in found:
        before, after = text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
        out.append((features(kind, text[a:b], before, after), 1))
        for _ in range(2):
            other, value = _rewritten(kind, text[a:b], draw)
            out.append((features(other, value, before, after), 1))
            other, value = _lookalike(text[a:b], draw)
            out.append((features(other, value, before, after), 0))
            # Secrets have the most forms, so every span stands in for some.
            value = _secret(hashlib.sha256(f"{text[a:b]} {draw.random()}".encode()).hexdigest(), draw)
            out.append((features("secret", value, before, after), 1))
            out.append((features("secret", draw.choice(_NO_SECRETS), before, after), 0))
    spans = {s[1:] for s in found}
    for kind, a, b in failed:
        if not any(x <= a < y or a <= x < b for x, y in spans):
            out.append((features(kind, text[a:b], text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]), 0))
    return out


@dataclass
class Chooser:
    model: Boosted | None
    thresholds: dict[str, float]


def case_counts(docs: DataFrame) -> DataFrame:
    """``x, y, aside, n``: the different binned cases of all documents, and how many there are of each."""
    schema = pa.schema([("x", pa.binary()), ("y", pa.int32()), ("aside", pa.bool_()), ("n", pa.int64())])
    binned = Boosted(EDGES, 0.0, 0.0).binned

    def run(batches):
        for batch in hands(batches):
            counts = Counter()
            for text in batch.column("text").to_pylist():
                # Which cases are set aside depends on the text, not on how the table is cut into files.
                draw = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                if got := cases(text, len(text)):
                    counts.update((x.tobytes(), y, not draw.randrange(ASIDE)) for x, (_, y) in zip(binned(np.array([c[0] for c in got])).astype(np.uint8), got, strict=True))
            if counts:
                x, y, aside = zip(*counts, strict=True)
                yield record(schema, x=list(x), y=list(y), aside=list(aside), n=list(counts.values()))

    # A text without a digit or an @ has no base span, and no match that fails.
    marked = docs.select("text").filter(F.col("text").rlike("[0-9@]"))
    return mapped(marked, run, "x binary, y int, aside boolean, n long").groupBy("x", "y", "aside").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Chooser:
    """Learn from the cases of all documents."""
    known = written(case_counts(docs), "cases")
    n = {(r["aside"], r["y"]): r["n"] for r in known.groupBy("aside", "y").agg(F.sum("n").alias("n")).collect()}
    if sum(n.values()) < FEWEST or len(n) < 4:
        return Chooser(None, {})
    model = boost_cases(known.filter("not aside"), EDGES)
    # One row for each margin there is, kind and label.
    rows = sorted(tuple(r) for r in margin_counts(known.filter("aside"), model, len(KINDS)).collect())
    kind, y, step, n = (np.array(c) for c in zip(*rows, strict=True))
    platt(model, step / STEPS, y, n)
    return Chooser(model, thresholds(sigmoid(model.slope * step / STEPS + model.shift), y, kind, n))


def thresholds(p: np.ndarray, y: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """The lowest probability, of at least a half, at which each kind's cases reach the precision; kinds without cases take 0.9.

    There are ``n`` cases of each probability, label and kind.
    """
    out = {}
    for i, kind in enumerate(KINDS):
        of = kinds == i
        level, place = np.unique(-p[of], return_inverse=True)
        right, all_ = (np.cumsum(np.bincount(place, w[of], len(level))) for w in (n * y, n))
        good = np.flatnonzero(right >= PRECISION * all_)
        if not len(good):
            out[kind] = 0.9
            continue
        last = good[-1]
        below = -level[last + 1] if last + 1 < len(level) else 0.0
        out[kind] = float(max(0.5, (-level[last] + below) / 2))
    return out


def added(text: str, found: list[tuple[str, int, int]], chooser: Chooser) -> list[tuple[str, int, int]]:
    """Proposals that the model chooses beside the base spans."""
    if chooser.model is None:
        return []
    taken = np.array(sorted((a, b) for _, a, b in found), dtype=np.int64).reshape(-1, 2)
    open_ = []
    ends = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    for kind, a, b in proposals(text):
        before = int(np.searchsorted(taken[:, 0], b))
        if not before or ends[before - 1] <= a:
            open_.append((kind, a, b))
    if not open_:
        return []
    p = chooser.model.probability(np.array([features(k, text[a:b], text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]) for k, a, b in open_]))
    chosen, used = [], []
    for q, (kind, a, b) in sorted(zip(p.tolist(), open_, strict=True), key=lambda s: (-s[0], s[1][1], s[1])):
        if q >= chooser.thresholds[kind] and _free(used, a, b):
            chosen.append((kind, a, b))
    return chosen


def _free(used: list[tuple[int, int]], a: int, b: int) -> bool:
    """Takes the place from a to b if no earlier span overlaps it."""
    import bisect

    i = bisect.bisect_left(used, (b, b))
    if i and used[i - 1][1] > a:
        return False
    bisect.insort(used, (a, b))
    return True


def written_out(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, chooser: Chooser) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` of every row: base counts and spans, and all spans."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in hands(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                base, _ = base_spans(text)
                counts = [sum(s[0] == k for s in base) for k in BASE]
                rows.append((doc_id, *counts, written_out(base), written_out(base + added(text, base, chooser))))
            yield record(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redacted(text: str, spans: str) -> str:
    """The text with each span replaced by its kind."""
    places = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in places:
        if b > at:
            out += [text[at:max(at, a)], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row, and ``all_<kind>``: the spans of each kind."""
    found = find(docs, fit(docs))
    chosen = F.split("spans", ",")
    counts = [F.size(F.filter(chosen, lambda s, kind=kind: F.startswith(s, F.lit(f"{kind}:")))).cast("long").alias(f"all_{kind}") for kind in KINDS]
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", *counts)
