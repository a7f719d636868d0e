"""Personal data: exact base patterns, and spans that boosted trees add to them.

Base spans of each kind are leftmost and non-overlapping; a match that fails its
check is dropped without another try. All scans take time in proportion to the
text: an e-mail is found at its @ and extended to the left, digit runs are tried
at their start only.

High-recall generators then propose overlapping candidates that the base missed
(obfuscated addresses, phone numbers without +, card and IPv6 spellings, secret
keys). Boosted trees over format and context features score them. Each kind has a
calibration of its own, and as threshold the least calibrated score, 0.5 at least,
from which ``PRECISION`` of its calibration rows are right; a candidate that reaches it
is added, best first, where it overlaps nothing taken. The trees train on the driver on
synthetic labelled snippets from a fixed seed: the corpus has no labelled spans.

Odd cases: null and empty texts have no spans; offsets are code points; rows with
equal texts get equal spans; of candidates of equal score the earlier, then the
shorter one goes first; a very long text is scanned whole, in time in proportion to
its length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import cache, doc_frame, small_batches, trim

KINDS = ("email", "ip", "card", "phone", "secret")
PRECISION = 0.97
BATCH = 256  # rows of one output batch

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
AT = (re.compile(r"[\[({] ?[aA][tT] ?[\])}]"), re.compile(r" [aA][tT] [A-Za-z0-9-]{1,63} ?(?:\.| [dD][oO][tT] |[\[({] ?[dD][oO][tT])"))

GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?(?:[\[({] ?at ?[\])}]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:00 ?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,5}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/ -]{1,3}[0-9]{4,6}){2,4}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}(?![A-Za-z0-9_/+-])")),
)
HINTS = tuple(re.compile(p, re.I) for p in (r"mail|contact|kontakt|correo|courriel", r"\bip\b|host|server|addr", r"card|visa|karte|carte|tarjeta|pay", r"phone|tel|call|fax|mobil|whatsapp", r"token|secret|key|passw|api|auth|bearer"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append(("email", start, m.end()))
                end = m.end()
    if DIGITS.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Proposed spans that overlap no base span; they may overlap each other."""
    digits = DIGITS.search(text) is not None
    cover = sorted((s, e) for _, s, e in taken)
    starts = [s for s, _ in cover]
    longest = max((e - s for s, e in cover), default=0)
    out = []
    for kind, pattern in GENERATORS:
        if kind == "email" and not any(x.search(text) for x in AT):
            continue
        if kind in ("phone", "card") and not digits:  # they begin with one
            continue
        for m in pattern.finditer(text):
            s, e = m.span()
            k = bisect_left(starts, s - longest)
            clash = False
            while k < len(cover) and cover[k][0] < e:
                if cover[k][1] > s:
                    clash = True
                    break
                k += 1
            if not clash:
                out.append((kind, s, e))
    return out


def features(text: str, kind: str, s: int, e: int) -> list[float]:
    span, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 20]
    digits = "".join(c for c in span if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in span)
    upper = sum(c.isupper() for c in span)
    seps = len(span) - len(digits) - letters
    counts = Counter(span)
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in counts.values())
    groups = re.split(r"[^0-9A-Za-z]+", span)
    hints = [float(bool(h.search(before))) for h in HINTS]
    hexed = float(all(c in "0123456789abcdefABCDEF" for c in span))
    return [
        float(KINDS.index(kind)), len(span), len(digits), letters, upper, seps, entropy, len(groups), max(map(len, groups)), min(map(len, groups)),
        float(len(digits) >= 13 and luhn(digits)), len(set(digits)), hexed, span.count(":"), float("(" in span), float("[" in span or "{" in span),
        float(bool(re.search(r"\bdot\b", span, re.I))), float(before[-1:] in "\"'=:`" if before else 0), float(after[:1] in "\"'`" if after else 0),
        float(bool(re.search(r"(?:19|20)[0-9]{2}", span))), *hints, hints[KINDS.index(kind)],
    ]


def synthetic(n: int = 3000, seed: int = 11) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): generated look-alikes of both classes."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=2, b=9: "".join(r.choice("aeinrstlodhmu") for _ in range(r.randint(a, b)))
    key = lambda k, s: "".join(r.choice(s) for _ in range(k))
    hexa, b62 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def card() -> str:
        d = "4" + digit(14)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    def four(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    good = {
        "email": (lambda: f"{word()}.{word()}{r.choice([' [at] ', '(at)', ' (at) ', '[at]'])}{word()}{r.choice(['.', ' [dot] ', '(dot)', ' dot '])}{r.choice(['com', 'org', 'net', 'de', 'fr'])}", lambda: f"{word()}{digit(2)} at {word()} dot {r.choice(['com', 'org', 'es'])}"),
        "phone": (lambda: f"({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"{digit(3)}-{digit(3)}-{digit(4)}", lambda: f"0{digit(2)} {digit(3)} {digit(4)}", lambda: f"{digit(3)}.{digit(3)}.{digit(4)}", lambda: f"00 {digit(2)} {digit(3)} {digit(4)}"),
        "card": (lambda: four(card(), r.choice([".", "_", "/", " - "])),),
        "ip": (lambda: ":".join(key(4, hexa) for _ in range(8)), lambda: "[.]".join(str(r.randint(1, 255)) for _ in range(4))),
        "secret": (lambda: key(r.choice([32, 40, 64]), hexa), lambda: key(r.randint(24, 48), b62), lambda: "sk_" + key(24, b62), lambda: key(r.randint(100, 400), b62 + "_-"), lambda: key(r.randint(24, 60), b62[:52])),
    }
    bad = {
        "email": (lambda: f"{word()} at {word()}.{word()}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} at {word()}. {word()}"),
        "phone": (lambda: f"20{digit(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{digit(2)}/{digit(2)}/20{digit(2)}", lambda: f"{digit(3)} {digit(3)}", lambda: f"{digit(2)}.{digit(2)}", lambda: f"{digit(4)}-{digit(4)}", lambda: " ".join(digit(2) for _ in range(r.randint(3, 6)))),
        "card": (lambda: four("9" + digit(15), r.choice([".", "_", "/", " - "])), lambda: four(digit(12), " ")),
        "ip": (lambda: ":".join(digit(2) for _ in range(4)), lambda: "[.]".join(str(r.randint(300, 999)) for _ in range(4))),
        "secret": (lambda: word(20, 40), lambda: digit(r.randint(20, 40)), lambda: "-".join(word(3, 8) for _ in range(6)), lambda: "_".join(word(3, 8) for _ in range(5)) + digit(2), lambda: "/".join(word(3, 8) for _ in range(5)) + "/" + digit(2), lambda: "-" * 24, lambda: "_".join(word(3, 8) for _ in range(30)), lambda: word(60, 200), lambda: "-".join(word(4, 9).capitalize() for _ in range(4))),
    }
    lead = {"email": ("mail ", "contact: "), "phone": ("call ", "tel. ", "phone: "), "card": ("card ", "visa: "), "ip": ("host ", "ip "), "secret": ('token = "', "api_key=", "secret: ")}
    out = []
    for _ in range(n):
        kind = r.choice(KINDS)
        label = int(r.random() < 0.5)
        span = r.choice((good if label else bad)[kind])()
        hint = r.random() < (0.5 if kind != "secret" else 0.8) if label else r.random() < 0.1
        if kind == "secret" and label and not hint and len(span) < 32:
            hint = True
        before = f"{word()} {word()} " + (r.choice(lead[kind]) if hint else "")
        close = '"' if before.endswith('"') else " "
        out.append((f"{before}{span}{close}{word()} {word()}", kind, len(before), len(before) + len(span), label))
    return out


def trained() -> dict:
    """The trees, and each kind's calibration and threshold; the same on every call. Every third row calibrates."""
    c = cache()
    if "pii_model" not in c:
        rows = synthetic(6000)
        x = np.array([features(t, k, s, e) for t, k, s, e, _ in rows])
        y, kinds = np.array([r[4] for r in rows]), np.array([r[1] for r in rows])
        held = np.arange(len(rows)) % 3 == 2
        model = boosting.fit(x[~held], y[~held]) | {"scale": {}, "least": {}}
        raw = boosting.raw(model, x)
        for kind in KINDS:
            own = held & (kinds == kind)
            a, b = model["scale"][kind] = boosting.platt(raw[own], y[own])
            p = 1 / (1 + np.exp(-(a * raw[own] + b)))
            order = np.argsort(-p, kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero((right >= PRECISION) & (np.append(np.diff(p[order]) < 0, True)))
            model["least"][kind] = max(0.5, float(p[order][good[-1]])) if len(good) else 2.0
        c["pii_model"] = model
    return c["pii_model"]


def probability(model: dict, kinds: list[str], x: np.ndarray) -> np.ndarray:
    """Calibrated by kind."""
    a, b = np.array([model["scale"][k] for k in kinds]).T
    return 1 / (1 + np.exp(-(a * boosting.raw(model, x) + b)))


def chosen(found: list[tuple[str, int, int]], p: np.ndarray, least: dict[str, float]) -> list[tuple[str, int, int]]:
    """Candidates that reach their kind's threshold, best first, each where it overlaps none before it."""
    starts, ends, out = [], [], []  # taken, in order; they don't overlap
    for i in sorted(range(len(found)), key=lambda i: (-p[i], *found[i][1:])):
        kind, s, e = found[i]
        if p[i] >= least[kind]:
            k = bisect_left(starts, e)
            if not k or ends[k - 1] <= s:
                starts.insert(k, s)
                ends.insert(k, e)
                out.append(found[i])
    return out


def all_spans(text: str, model: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), both by kind, then start."""
    base = base_spans(text)
    found = candidates(text, base)
    if not found:
        return base, base
    p = probability(model, [k for k, _, _ in found], np.array([features(text, *c) for c in found]))
    return base, sorted(base + chosen(found, p, model["least"]), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                counts, digests, lines = {k: [] for k in KINDS[:4]}, [], []
                for x in part.column(1):
                    base, every = all_spans(x.as_py() or "", model.value)
                    for k, c in counts.items():
                        c.append(sum(s[0] == k for s in base))
                    digests.append(hashlib.sha256(_line(base).encode()).hexdigest())
                    lines.append(_line(every))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests, pa.string()), pa.array(lines, pa.string())], ["doc_id", *(f"n_{k}" for k in counts), "base_sha256", "spans"])
        trim()

    return doc_frame(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes ``[KIND]`` of its first span."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced by their kind, and ``n_chars`` counted again where there is such a column."""
    model = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = names.index("text")
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                texts = [None if (t := x.as_py()) is None else redact(t, all_spans(t, model.value)[1]) for x in part.column(at)]
                yield part.set_column(at, "text", pa.array(texts, part.column(at).type))
        trim()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
