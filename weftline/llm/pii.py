"""Personal data by fixed rules and by a semi-Markov conditional random field.

The rules give base spans. The field scores whole candidate segments (runs of a few words) with features of the whole
span; dynamic programming over segments of bounded length jointly chooses boundaries and types in what the rules left.
It is trained here, on segmentations that the rules give, and on variants of them that the rules don't reach.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import smallest

KINDS = ("email", "ip", "card", "phone")
TYPES = (*KINDS, "O")
MOST_WORDS = 5
DIM = 1 << 13

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_HOT = re.compile(r"[0-9@]")
_TRIM = ".,;:!?\"'<>[]{}|*#$%&="
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) by the rules, in order; linear in the text's length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # an address is the run of local characters before an @, and a dotted domain after it
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, done := domain.end()))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def span_features(words: list[str]) -> list[str]:
    """Features of a candidate segment as a whole."""
    span = " ".join(words).strip(_TRIM)
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    rest = re.sub(r"[0-9A-Za-z]", "", span)
    letters = sum(c.isalpha() for c in span)
    dotted, numeric = span.count("."), letters == 0
    shape = ".".join(str(min(len(g), 9)) for g in groups[:6])
    out = ["bias", f"words{len(words)}", f"digits{min(len(digits), 20)}", f"groups{min(len(groups), 7)}", f"letters{min(letters, 3)}", f"marks{''.join(sorted(set(rest)))[:8]}"]
    if numeric:
        out += [f"shape{shape}", f"len{min(len(span), 24) // 2}"]
        if 12 <= len(digits) <= 19:
            out.append(f"luhn{luhn(digits)}")
        if len(groups) == 4 and dotted == 3 and len(rest) == 3:
            out.append(f"quad{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
        if span[:1] in "+(":
            out.append(f"opens{span[:1]}")
    if "@" in span:
        name, _, host = span.rpartition("@")
        out += [f"at{span.count('@')}", f"named{bool(name)}", f"host{'.' in host.strip('.')}", f"tld{min(len(host.rpartition('.')[2]), 6)}"]
    if any(not _HOT.search(w) for w in words):
        out.append("plain")
    return out


def _codes(words: list[str]) -> dict[str, np.ndarray]:
    found = span_features(words)
    return {t: np.array([zlib.crc32(f"{t}|{f}".encode()) % DIM for f in found]) for t in (TYPES if len(words) == 1 else KINDS)}


class Field:
    """Segment scores and the sums and maxima over segmentations of a run of words; O segments are single words."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.codes = {(i, j): _codes(words[i:j]) for j in range(1, self.n + 1) for i in range(max(0, j - MOST_WORDS), j)}

    def scores(self, w: np.ndarray) -> dict:
        return {ij: {t: float(w[c].sum()) for t, c in by.items()} for ij, by in self.codes.items()}

    def best(self, w: np.ndarray) -> list[tuple[int, int, str]]:
        top, back = [0.0] + [-math.inf] * self.n, [None] * (self.n + 1)
        for (i, j), by in sorted(self.scores(w).items(), key=lambda x: x[0][1]):
            for t, s in by.items():
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, j, t)
        out, j = [], self.n
        while j:
            out.append(back[j])
            j = back[j][0]
        return out[::-1]

    def gradient(self, w: np.ndarray, gold: list[tuple[int, int, str]], rate: float) -> None:
        """One step up the conditional log-likelihood of a segmentation."""
        s = self.scores(w)
        fore, back = [0.0] + [-math.inf] * self.n, [-math.inf] * self.n + [0.0]
        for j in range(1, self.n + 1):
            fore[j] = _logsum([fore[i] + v for i in range(max(0, j - MOST_WORDS), j) for v in s[i, j].values()])
        for i in reversed(range(self.n)):
            back[i] = _logsum([back[j] + v for j in range(i + 1, min(self.n, i + MOST_WORDS) + 1) for v in s[i, j].values()])
        for (i, j), by in s.items():
            for t, v in by.items():
                p = math.exp(fore[i] + v + back[j] - fore[self.n])
                if p > 1e-4:
                    np.subtract.at(w, self.codes[i, j][t], rate * p)
        for i, j, t in gold:
            np.add.at(w, self.codes[i, j][t], rate)


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def regions(text: str, base: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of words (start, end) that hold a digit or @ and touch no base span; all other words are certain to be O."""
    run, k, covered = [], 0, sorted((a, b) for a, _, b in base)
    if not _HOT.search(text):
        return
    for m in _WORD.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        taken = any(a < m.end() and m.start() < b for a, b in covered[k : k + 8])
        if _HOT.search(m[0]) and not taken:
            run.append(m.span())
        elif run:
            yield run
            run = []
    if run:
        yield run


def best_segments(words: Iterator[str], w: np.ndarray) -> list[tuple[int, int, str]]:
    """What Field(words).best(w) gives; of the words and scores only the last MOST_WORDS are held, besides a pointer a word."""
    top, back, near, n = [0.0], [None], [], 0
    for word in words:
        n, near = n + 1, [*near[1 - MOST_WORDS :], word]
        best, step = -math.inf, None
        for i in range(n - len(near), n):
            start = top[i - n]
            for t, c in _codes(near[i - n :]).items():
                s = start + float(w[c].sum())
                if s > best:
                    best, step = s, (i, t)
        top = [*top[1 - MOST_WORDS :], best]
        back.append(step)
    out = []
    while n:
        i, t = back[n]
        out.append((i, n, t))
        n = i
    return out[::-1]


def added_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray) -> list[tuple[int, int, int]]:
    out = []
    for run in regions(text, base):
        for i, j, t in best_segments((text[a:b] for a, b in run), w):
            if t != "O":
                a, b = run[i][0], run[j - 1][1]
                span = text[a:b]
                a += len(span) - len(span.lstrip(_TRIM))
                b -= len(span) - len(span.rstrip(_TRIM))
                if a < b and not any(x < b and a < y for x, _, y in base):
                    out.append((a, KINDS.index(t), b))
    return out


def _examples(text: str, chance: random.Random) -> Iterator[tuple[list[str], list[tuple[int, int, str]]]]:
    """Segmentations of runs around the rules' spans, and the same with a variant of each span."""
    base = base_spans(text)
    words = [m.span() for m in _WORD.finditer(text)] if base or _HOT.search(text) else []
    k, run, gold = 0, [], []
    while k <= len(words):
        hit = k < len(words) and next(((a, t, b) for a, t, b in base if a < words[k][1] and words[k][0] < b), None)
        if hit:
            last = k
            while last + 1 < len(words) and words[last + 1][0] < hit[2]:
                last += 1
            inner = [text[a:b] for a, b in words[k : last + 1]]
            if len(inner) <= MOST_WORDS:
                gold.append((len(run), len(run) + len(inner), KINDS[hit[1]]))
                run += inner
            k = last + 1
        elif k < len(words) and _HOT.search(text[slice(*words[k])]):
            gold.append((len(run), len(run) + 1, "O"))
            run.append(text[slice(*words[k])])
            k += 1
        else:
            if run and len(run) <= 24:
                yield run, gold
                if any(t != "O" for *_, t in gold):
                    yield _varied(run, gold, chance)
            run, gold = [], []
            k += 1


def _varied(run, gold, chance):
    """Phones without + and country, cards with other separators; and spans spoilt so that they are no personal data."""
    words, spans = [], []
    for i, j, t in gold:
        own, kind = run[i:j], t
        if t == "phone" and len(own) > 1 and chance.random() < 0.7:
            own = own[1:] if len(own[0]) <= 4 else own
        elif t == "card" and len(own) == 1 and chance.random() < 0.6:
            d = own[0].strip(_TRIM)
            if chance.random() < 0.5:
                d, kind = d[:-1] + str((int(d[-1]) + 1 + chance.randrange(8)) % 10) if d[-1:].isdigit() else d, "O"
            else:
                d = ".".join(d[x : x + 4] for x in range(0, len(d), 4))
            own = [d]
        elif t == "ip" and chance.random() < 0.4:
            own, kind = [own[0].rpartition(".")[0] + ".777"], "O"
        elif t == "email" and chance.random() < 0.4:
            own, kind = [own[0].partition("@")[0] + "@"], "O"
        if kind == "O":
            spans += [(len(words) + x, len(words) + x + 1, "O") for x in range(len(own))]
        else:
            spans.append((len(words), len(words) + len(own), kind))
        words += own
    return words, spans


#: Runs that are in no class, so that plain numbers stay out whatever the corpus holds.
_PLAIN = ("7", "42", "1999", "2024-05-17", "12:30", "3.14", "10,000", "v2.1.3", "007", "50%", "1st", "123456", "2,", "[3]", "1.2.3", "@home", "C3PO", "4 5 6", "10 20 30 40", "1914-1918", "555", "a1b2c3", "0.5 0.25", "12 345 678")


def train(docs: DataFrame, *, sample_rows: int = 2000, most_runs: int = 2500, epochs: int = 4, seed: int = 11) -> np.ndarray:
    """Weights from the sample_rows distinct texts, of those with a digit or @, whose hash is smallest.

    Of the runs of all those texts, the most_runs whose hash is smallest are learned from, wherever they stand.
    """
    near = smallest(docs.where(F.col("text").rlike("[0-9@]")).select("text"), F.xxhash64("text"), sample_rows)
    drawn = near.distinct().orderBy(F.xxhash64("text"), "text").limit(sample_rows).select(F.col("text")).mapInArrow(_drawn(seed), "run array<string>, gold array<string>")
    few = drawn.orderBy(F.xxhash64("run", "gold"), "run", "gold").limit(most_runs)
    runs = [(r["run"], [(int(a), int(b), t) for a, b, t in (g.split(":") for g in r["gold"])]) for r in few.collect()]
    runs.sort(key=lambda r: zlib.crc32(repr(r).encode()))
    runs += [(p.split(), [(i, i + 1, "O") for i in range(len(p.split()))]) for p in _PLAIN] * max(1, len(runs) // 100)
    w, chance = np.zeros(DIM), random.Random(seed)
    w[[zlib.crc32(b"O|bias") % DIM]] = 1.0
    fields = [(Field(run), gold) for run, gold in runs]
    for at in range(epochs):
        chance.shuffle(fields)
        for field, gold in fields:
            field.gradient(w, gold, 0.2 / (1 + at))
    return w


def _drawn(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, golds = [], []
            for text in batch.column(0).to_pylist():
                for words, gold in _examples(text, random.Random(zlib.crc32(text.encode()) + seed)):
                    runs.append(words)
                    golds.append([f"{i}:{j}:{t}" for i, j, t in gold])
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.list_(pa.string())), pa.array(golds, pa.list_(pa.string()))], ["run", "gold"])

    return run


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, spans): the rules' spans and all spans of each whole text, as kind:start:end in code points.

    Null or empty text has no spans. Null and repeated doc_ids are kept as they are. A table without a digit or @
    trains on plain numbers alone, and nothing is added then.
    """
    w = docs.sparkSession.sparkContext.broadcast(train(docs.select("text"), **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text) if text and _HOT.search(text) else []
                more = added_spans(text, own, w.value) if text else []
                base.append(_joined(own))
                spans.append(_joined(own + more) if more else base[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base string, spans string")


def _of_kind(kind: str):
    return lambda x: F.startswith(x, F.lit(f"{kind}:"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.split("base", ",")
    counts = [F.size(F.filter(kinds, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
