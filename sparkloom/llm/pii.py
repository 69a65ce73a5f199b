"""PII by candidate gradient boosting.

Base spans (email, ip, card, phone in plain formats) are found by fixed patterns and
checks, and always stay.  High-recall generators then propose further, overlapping spans in looser
formats - spelled-out or spaced emails, defanged addresses, phones without a country sign, cards with
other separators - and boosted trees judge each by its format and context.  A candidate
is selected when its probability reaches its kind's calibrated threshold; of overlapping ones
the likeliest stays, and none overlaps a base span.

The trees learn from disguises: base spans of up to SAMPLE documents (those with the smallest hashed
ids; TAUGHT spans of each kind a document, drawn by its id) are rewritten in place in looser formats as positives, and
look-alikes (dates, versions, amounts, failing numbers) put in the same places are negatives.  What the
generators propose elsewhere in those documents (up to SEEN of each kind a document) has no label: what trees of the
labelled examples hold for unlikely joins the negatives, the rest teaches nothing.  A quarter of the examples
sets the thresholds.

Defined results: a null or empty text has no spans; positions are code points, end exclusive;
repeated rows get equal results; null ids are kept; with too few examples nothing is
added; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE, TAUGHT, SEEN = 4000, 4, 16
#: What is written over a span.
MARKS = {k: f"[{k.upper()}]" for k in KINDS}

# Fixed patterns of the base formats.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser formats, with bounded repeats so that no text makes them slow.
LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,5}", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\])\s?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{1,3}[0-9]{2,6}){2,4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "phone": re.compile(r"(?<![\w.+-])(?:00\s?[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![\w-])"),
}
CUES = {
    "email": ("mail", "contact", "write", "reach", "@"),
    "ip": ("ip", "host", "server", "address", "ping", "login"),
    "card": ("card", "visa", "pay", "credit", "iban", "account"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "text", "dial"),
}
AGAINST = ("version", "v.", "date", "isbn", "page", "figure", "fig.", "no.", "section", "price", "order")
ENDINGS = frozenset("com org net edu gov io info de fr es uk eu us co".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain formats, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


class Clear:
    """Ranges of a text, merged, that tell whether a span overlaps none of them."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, s, e in sorted(spans, key=lambda x: x[1:]):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def of(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i == len(self.starts) or end <= self.starts[i]

    def add(self, start: int, end: int) -> None:
        """A span that is clear of all."""
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def proposals(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the generators find clear of the spans taken; proposals may overlap one another."""
    clear = Clear(taken)
    return [(kind, *m.span()) for kind, pattern in LOOSE.items() for m in pattern.finditer(text) if clear.of(*m.span())]


FEATURES = 26


def level(n: int, *steps: int) -> int:
    return sum(n >= s for s in steps)


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Format and context of a span, as small levels."""
    span, before, after = text[start:end], text[max(0, start - 32) : start].lower(), text[end : end + 16]
    digits = digits_of(span)
    runs = re.findall(r"[0-9]+", span)
    words = re.findall(r"[A-Za-z]+", span)
    spelled = span.lower()
    return [
        KINDS.index(kind), level(len(span), 8, 10, 12, 14, 16, 19, 24, 32), level(len(digits), 4, 7, 8, 9, 10, 11, 13, 16, 17, 20), level(len(runs), 1, 2, 3, 4, 5),
        int(bool(digits) and luhn(digits)), level(len(set(digits)), 2, 4, 6), int("(" in span), int("." in span), int("-" in span), int(" " in span), int("/" in span or "_" in span),
        int("@" in span), int("(at)" in spelled or "[at]" in spelled or "{at}" in spelled), int(" at " in spelled), level(len(re.findall(r"dot|\.", spelled)), 1, 2, 3, 4),
        int(bool(words) and words[-1].lower() in ENDINGS), int(len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs)), int(bool(runs) and len({len(r) for r in runs}) == 1),
        int(any(c in before for c in CUES[kind])), int(any(c in before for c in AGAINST)), int(before[-1:].isalnum()), int(before[-1:] in "$#./:=-"), int(after[:1].isalnum()), int(after[:1] in "./:%-"),
        int(len(runs) >= 1 and len(runs[0]) == 4 and runs[0][:2] in ("19", "20")), level(max(map(len, runs), default=0), 2, 3, 4, 5, 8),
    ]


def disguises(kind: str, span: str, rng: random.Random) -> list[str]:
    """The span in looser formats."""
    d = digits_of(span)
    if kind == "email":
        name, host = span.split("@")
        names, parts = [name, re.sub("[0-9._%+-]+", "", name) or name], host.split(".")
        hosts = [host, ".".join(parts[-2:]), ".".join([re.sub("[0-9-]+", "", parts[0]) or parts[0], *parts[1:]])]
        any_of = lambda: (rng.choice(names), rng.choice(hosts))
        return [f"{n}{at}{h.replace('.', dot)}" for at, dot in ((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", "."), (" at ", "."), ("{at}", "{dot}")) for n, h in [any_of()]]
    if kind == "ip":
        return [span.replace(".", "[.]"), span.replace(".", " . "), span.replace(".", "(dot)")]
    if kind == "card":
        four = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [".".join(four), "  ".join(four), "/".join(four), " - ".join(four)]
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}", f"{a}.{b}.{c}", f"{a} {b} {c}"] if a else []


def lookalikes(rng: random.Random) -> list[str]:
    """Numbers and phrases that are no personal data."""
    n = rng.randrange
    wrong = "".join(str(n(10)) for _ in range(15))
    wrong += str((next(k for k in range(10) if luhn(wrong + str(k))) + 1 + n(9)) % 10)
    return [
        f"{n(1990, 2030)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29):02}.{n(1, 13):02}.{n(1990, 2030)}", f"{n(24):02}:{n(60):02}-{n(24):02}:{n(60):02}", f"{n(9)}.{n(20)}.{n(9999)}", f"version {n(9)}.{n(9)}.{n(9)}.{n(300, 999)}",
        f"${n(1, 999)},{n(100, 999)}.{n(100):02}", f"978-3-{n(10, 99)}-{n(100000, 999999)}-{n(10)}", f"{n(300, 999)} . {n(256)} . {n(256)} . {n(256)}", ".".join(wrong[i : i + 4] for i in range(0, 16, 4)), wrong, "  ".join(wrong[i : i + 4] for i in range(0, 16, 4)),
        f"{n(1, 9)} {n(100, 999)} {n(100, 999)} {n(100, 999)}", f"page {n(10, 99)} {n(100, 999)} {n(100, 999)}", f"look at line {n(99)}. Then", "we met at noon. After", f"come at {n(24)}.{n(10, 60)}", f"{n(2, 99)} @ {n(100)}.{n(100):02}", f"stay at home.{n(9)}", f"order {n(10**8, 10**10)}", f"{n(1900, 2030)} {n(1900, 2030)} {n(1900, 2030)} {n(1900, 2030)}", f"{n(100, 999)}.{n(100, 999)}.{n(100, 999)},{n(10, 99)}", f"{n(10**12, 10**14)}",
    ]


def drawn(spans: list[tuple[str, int, int]], each: int, rng: random.Random) -> list[tuple[str, int, int]]:
    """Up to so many spans of each kind."""
    by = [[s for s in spans if s[0] == kind] for kind in KINDS]
    return [s for own in by for s in (rng.sample(own, each) if len(own) > each else own)]


#: Labels of examples: no personal data, personal data, unknown.
NO, YES, UNKNOWN = 0, 1, 2


def examples(text: str, base: list[tuple[str, int, int]], seed: int) -> tuple[list[list[int]], list[int]]:
    """Features and labels from one document with base spans."""
    rng = random.Random(seed)
    x, y = [], []
    for f in drawn(proposals(text, base), SEEN, rng):
        x.append(features(text, *f))
        y.append(UNKNOWN)
    for kind, s, e in drawn(base, TAUGHT, rng):
        left, right = text[max(0, s - 64) : s], text[e : e + 64]
        for label, forms in ((YES, disguises(kind, text[s:e], rng)), (NO, rng.sample(lookalikes(rng), 4))):
            for form in forms:
                near = left + form + right
                own = base_spans(near)
                for f in proposals(near, own):
                    if f[1] < len(left) + len(form) and f[2] > len(left) and (label == NO or f[0] == kind):
                        x.append(features(near, *f))
                        y.append(label)
    return x, y


def labelled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The examples without those of unknown label that may be personal data; the rest of these are none."""
    sure = y != UNKNOWN
    if sure.all() or not 0 < y[sure].mean() < 1:
        return x[sure], y[sure].astype(float)
    use = sure | (Boosted(x[sure], y[sure].astype(float)).predict(x) < 0.5)
    return x[use], (y[use] == YES).astype(float)


class Boosted:
    """Gradient-boosted trees of DEPTH levels on small integer features, log loss."""

    DEPTH, TREES, RATE, SMOOTH = 3, 60, 0.2, 4.0

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.base)
        for _ in range(self.TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(x, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self.RATE * tree[2][self._leaf(tree, x)]

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner, top = 2**self.DEPTH - 1, int(x.max(initial=0)) + 1
        feature, cut = np.zeros(inner, int), np.full(inner, top)
        node = np.zeros(len(x), int)
        for n in range(inner):
            at = np.flatnonzero(node == n)
            best = 1e-6
            whole = g[at].sum() ** 2 / (h[at].sum() + self.SMOOTH)
            for f in range(x.shape[1]):
                gs, hs = (np.cumsum(np.bincount(x[at, f], v[at], top)) for v in (g, h))
                gain = gs**2 / (hs + self.SMOOTH) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.SMOOTH) - whole
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[n], cut[n] = gain[k], f, k
            node[at] = 2 * n + 1 + (x[at, feature[n]] > cut[n])
        leaves = node - inner
        size = 2**self.DEPTH
        return feature, cut, -np.bincount(leaves, g, size) / (np.bincount(leaves, h, size) + self.SMOOTH)

    def _leaf(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, _ = tree
        node = np.zeros(len(x), int)
        for _ in range(self.DEPTH):
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        return node - (2**self.DEPTH - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.RATE * tree[2][self._leaf(tree, x)]
        return 1 / (1 + np.exp(-score))


def thresholds(p: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float = 0.98) -> np.ndarray:
    """By kind, the lowest probability above which the wanted share is right; over 1 where none is."""
    out = np.full(len(KINDS), 2.0)
    for k in range(len(KINDS)):
        own = kind == k
        order = np.argsort(-p[own], kind="stable")
        right, ps = y[own][order], p[own][order]
        good = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= precision)
        if len(good) and right.sum() >= 5:
            out[k] = max(0.5, ps[good[-1]])
    return out


TRIGGER = re.compile("[0-9@]")
#: What every base format and every generator needs.
SPELLED = re.compile(r"[0-9@]|\(at\)|\[at\]|\{at\}|\sat\s", re.I)


def suspicious(text: str) -> bool:
    return bool(SPELLED.search(text))


def fit(documents: DataFrame) -> tuple[Boosted, np.ndarray] | None:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            rows = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and TRIGGER.search(text) and (base := base_spans(text)):
                    x, y = examples(text, base, h)
                    if y:
                        rows.append((h, np.array(x, np.uint8).tobytes(), np.array(y, np.uint8).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["h", "x", "y"])

    # different documents by hash; only a share of them is looked at, and more if too few of these have base spans
    hashed = documents.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    n = hashed.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    share, taught = 4 * SAMPLE / max(n, 1), []
    while True:
        found = hashed.where(common.under("h", share)).mapInArrow(work, "h long, x binary, y binary")
        taught = found.groupBy("h").agg(F.min(F.struct("x", "y")).alias("own")).select("h", "own.x", "own.y").orderBy("h").limit(SAMPLE).collect()
        if len(taught) == SAMPLE or share >= 1:
            break
        share *= max(8, 2 * SAMPLE / max(len(taught), 1))
    x = np.frombuffer(b"".join(r.x for r in taught), np.uint8).reshape(-1, FEATURES)
    y = np.frombuffer(b"".join(r.y for r in taught), np.uint8)
    apart = np.concatenate([np.full(len(r.y), r.h % 4 == 0) for r in taught]) if taught else np.zeros(0, bool)
    (x, y), (x_apart, y_apart) = labelled(x[~apart], y[~apart]), labelled(x[apart], y[apart])
    if len(y) < 40 or not 0 < y.mean() < 1 or not len(y_apart):
        return None
    trees = Boosted(x, y)
    return trees, thresholds(trees.predict(x_apart), y_apart, x_apart[:, 0])


def added(text: str, base: list[tuple[str, int, int]], model) -> list[tuple[str, int, int]]:
    found = proposals(text, base) if model else []
    if not found:
        return []
    trees, least = model
    p = trees.predict(np.array([features(text, *f) for f in found], np.uint8))
    out: list[tuple[str, int, int]] = []
    clear = Clear([])
    for q, f in sorted(zip(p, found, strict=True), key=lambda z: (-z[0], z[1][1], -z[1][2], z[1][0])):
        if q >= least[KINDS.index(f[0])] and clear.of(*f[1:]):
            out.append(f)
            clear.add(*f[1:])
    return out


def ordered(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def spans_of(text: str | None, model) -> tuple[list, list]:
    if not text or not suspicious(text):
        return [], []
    base = base_spans(text)
    return base, added(text, base, model)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans of every row, all spans, and how many the method added."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(rows)  # a few trees: they travel with the function

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            found = [spans_of(t, model) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS), pa.array([hashlib.sha256(ordered(base).encode()).hexdigest() for base, _ in found], pa.string()), pa.array([ordered(base + more) for base, more in found], pa.string()), pa.array([len(more) for _, more in found], pa.int64())],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

    return rows.mapInArrow(work, RESULT)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or overlapping spans together, replaced by the mark of the first."""
    out, at, reach = [], 0, 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= reach:
            out += [text[at:s], MARKS[kind]]
        at = reach = max(reach, e)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """The rows with all spans replaced in text, and n_chars, where there is one, made to fit changed texts."""
    kept = documents.columns
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(rows)  # a few trees: they travel with the function

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches):
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            texts = columns["text"].to_pylist()
            new = [redacted(t, base + more) if base or more else t for t in texts for base, more in [spans_of(t, model)]]
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), texts, new, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return documents.mapInArrow(work, documents.schema).select(*kept)


def op1_pii_spans(spark, sf_dir):
    return find(common.table(spark, sf_dir, "documents", "doc_id", "text"))
