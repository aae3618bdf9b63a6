"""Secret scan: fixed patterns plus a randomness test battery.

Patterns find assigned secrets, access keys and long hexadecimal strings. Beyond them, every run of
token characters in a text gives candidates: its stretches between signs of equality and what these
hold between slashes and between other signs, outside the patterns' finds. Of those that overlap the one
least like writing stays, its p-value times the number tried. A candidate's encoding is inferred, and three tests ask whether it
looks like random symbols of that encoding's alphabet: a chi-squared test of uniform symbols, a runs
test about the middle of the alphabet and a test of serial correlation. A candidate that one of these
rejects is no secret. A last p-value says how likely ordinary writing of the same length would come as
near to uniform. Long tokens tell more than short ones, so these p-values are held against each other
within strata of length: in each stratum the Benjamini-Hochberg step-up keeps the expected share of
false finds under `rate`. Every candidate tried counts as a test, those that the battery rejects too.
The step-up works on counts of p-values in fine fixed bins, summed over the whole corpus; no candidate
is collected.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right as bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundarylens.llm.common import blobs, durable, map_batches

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Candidates in a run, from long to short; padding belongs to what it ends.
_PIECES = (re.compile(rb"[A-Za-z0-9+/_-]{20,}=*"), re.compile(rb"[A-Za-z0-9+_-]{20,}=*"), re.compile(rb"[A-Za-z0-9]{20,}=*"))

#: Alphabets tried from the smallest on; the first that has all of a token's symbols is its encoding.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex capitals", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36 capitals", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("words", "abcdefghijklmnopqrstuvwxyz0123456789_-/+"),
    ("words in capitals", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-/+"),
    ("mixed letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Rough relative frequencies of letters in ordinary writing, a to z, in parts per thousand.
LETTERS = np.array([82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1])
STRATA = (20, 24, 32, 40, 48, 64, 96, 128, 256)
BINS, BIN_WIDTH = 400, 0.1  # of -log10 p


def _ordinary(alphabet: str) -> np.ndarray:
    """How ordinary writing uses an alphabet: letters by their frequency (nine in ten lower case where both occur), digits seldom, signs between words of one case often."""
    lower = sum(c.islower() for c in alphabet) > 6
    one_case = alphabet.islower() or alphabet.isupper()
    out = []
    for c in alphabet:
        if c.isalpha():
            case = 1.0 if not lower or not any(x.isupper() for x in alphabet) else (0.9 if c.islower() else 0.1)
            out.append(LETTERS[ord(c.lower()) - 97] * case)
        else:
            out.append(40.0 if one_case and not c.isdigit() else 4.0)
    p = np.array(out)
    return p / p.sum()


_ALPHABETS = [(name, {ord(c): i for i, c in enumerate(a)}, _ordinary(a)) for name, a in ENCODINGS]


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """P(chi-squared > x), by the cube root approximation."""
    return _upper_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def battery(token: bytes) -> tuple[str, float, float, float, float] | None:
    """(encoding, p of uniformity, of runs, of serial correlation, p of ordinary writing), or None if no encoding fits.

    The first three are small for tokens unlike random ones, the last for tokens unlike writing.
    """
    body = token.rstrip(b"=")
    if len(body) < 8:
        return None
    for name, index, ordinary in _ALPHABETS:
        if index.keys() >= set(body):
            break
    else:
        return None
    x, k = np.array([index[c] for c in body]), len(index)
    n = len(x)
    seen = np.bincount(x, minlength=k)
    chi = float(((seen - n / k) ** 2).sum() * k / n)
    # With few expected per symbol the statistic's variance is less than 2(k - 1): match both moments.
    variance = 2 * (k - 1) * (n - 1) / n
    scale = variance / (2 * (k - 1))
    uniform = _chi_tail(max(chi / scale, 1e-9), max(1, round((k - 1) / scale)))
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        run_p = math.erfc(abs(runs - mean) / spread / math.sqrt(2))
    else:
        run_p = 2.0 ** (1 - n)
    d = x - x.mean()
    square = float((d * d).sum())
    serial = float((d[1:] * d[:-1]).sum()) / square if square else 1.0
    serial_p = math.erfc(abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2))
    # Ordinary writing: log likelihood ratio of uniform against writing, as a sum of independent terms.
    score = -np.log(k * ordinary)
    mean, var = float((ordinary * score).sum()), float((ordinary * score**2).sum())
    var -= mean**2
    writing = _upper_tail((float(score[x].sum()) - n * mean) / math.sqrt(n * var))
    return name, uniform, run_p, serial_p, writing


def _base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the fixed patterns."""
    out = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _candidates(text: bytes, base: list[tuple[int, int, str]], reject: float) -> tuple[list[tuple[int, int, str, float]], list[int]]:
    """Byte spans outside the base ones that pass the battery, with the p-value of ordinary writing; and how many were tried in each stratum."""
    out, tried = [], [0] * len(STRATA)
    apart: list[list[int]] = []  # base spans, joined where they overlap, so that one sweep takes runs and spans along
    for a, b, _ in base:
        if apart and a <= apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], b)
        else:
            apart.append([a, b])
    next_span = 0
    for m in _RUN.finditer(text):
        at = m.start()
        while next_span < len(apart) and apart[next_span][1] <= at:
            next_span += 1
        while at < m.end():
            stop, after = apart[next_span] if next_span < len(apart) and apart[next_span][0] < m.end() else (m.end(), m.end())
            if stop - at >= 20:
                out += _in_run(text, at, stop, reject, tried)
            at = after
            if at < m.end():
                next_span += 1
    return out, tried


def _in_run(text: bytes, start: int, end: int, reject: float, by_stratum: list[int]) -> list[tuple[int, int, str, float]]:
    """Of the candidates in a run that pass the battery, those least like writing that do not overlap. by_stratum counts all that are tried."""
    tried, passed = set(), []
    for pieces in _PIECES:
        for m in pieces.finditer(text, start, end):
            span = m.span()
            if span in tried:
                continue
            tried.add(span)
            by_stratum[sum(span[1] - span[0] >= x for x in STRATA[1:])] += 1
            found = battery(m.group())
            if found and min(found[1:4]) >= reject:
                passed.append((*span, found[0], found[4]))
    out: list[tuple[int, int, str, float]] = []  # in order, and apart from each other: only the neighbours of a place can overlap
    for a, b, encoding, p in sorted(passed, key=lambda x: (x[3], x[0] - x[1], x[0])):
        at = bisect(out, a, key=lambda x: x[0])
        if (not at or out[at - 1][1] <= a) and (at == len(out) or b <= out[at][0]):
            out.insert(at, (a, b, encoding, min(1.0, p * len(tried))))
    return out


SCANNED = "doc_id long, base array<struct<kind: string, start: int, end: int>>, more array<struct<kind: string, start: int, end: int, encoding: string, p: double>>, tried array<int>"


def _scanned(docs: DataFrame, text: str, doc_id: str, reject: float) -> DataFrame:
    """Per document the base spans and the candidates, in code points, and how many candidates were tried in each stratum (null: none)."""
    kinds = [pa.int64()]
    kinds.append(pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
    kinds.append(pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("p", pa.float64())])))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        bases, mores, tries = [], [], []
        for t in blobs(batch.column(1)):
            base = _base_spans(t)
            more, tried = _candidates(t, base, reject)
            tries.append(tried if any(tried) else None)
            at = {0: 0}
            if base or more:
                starts = np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)
                point = lambda i, starts=starts: int(starts[i - 1]) if i else 0
            else:
                point = at.get
            bases.append([{"kind": k, "start": point(a), "end": point(b)} for a, b, k in base])
            mores.append([{"kind": "random", "start": point(a), "end": point(b), "encoding": e, "p": p} for a, b, e, p in more])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, kinds[1]), pa.array(mores, kinds[2]), pa.array(tries, pa.list_(pa.int32()))], names=["doc_id", "base", "more", "tried"])

    return map_batches(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")), scan, SCANNED)


def _stratum(length: Column) -> Column:
    return sum(((length >= s).cast("int") for s in STRATA[1:]), F.lit(0))


def _bin(p: Column) -> Column:
    """Bin of -log10 p, rounded down, so that a bin's p-values are at most 10 ** (-bin * width)."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / BIN_WIDTH), F.lit(BINS - 1)).cast("int")


def step_up(counts: dict[tuple[int, int], int], tests: dict[int, int], rate: float) -> dict[int, int]:
    """The lowest bin that counts as found in each stratum, by Benjamini-Hochberg on binned p-values.

    counts: candidates that passed the battery by (stratum, bin). tests: all that were tried by stratum;
    those that the battery rejected have a p-value of 1.
    """
    out = {}
    for stratum in {s for s, _ in counts}:
        found, lowest = 0, BINS
        for b in range(BINS - 1, -1, -1):
            found += counts.get((stratum, b), 0)
            if counts.get((stratum, b)) and 10 ** (-b * BIN_WIDTH) <= rate * found / tests[stratum]:
                lowest = b
        out[stratum] = lowest
    return out


def scan_secrets(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", rate: float = 0.001, reject: float = 0.001) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), in code points, end exclusive, by start and then kind.

    Kinds: assign, access, hex and, from the battery, random (never overlapping the others). A null text
    is empty; a document without finds has an empty array. Every row is scanned for itself, repeated ids
    included; an empty table gives an empty result. `rate` bounds the expected share of false finds in
    each stratum of length, `reject` is the p-value under which a test of the battery speaks against a
    random token. Other columns are not read.
    """
    scanned = durable(_scanned(docs, text, doc_id, reject), "secrets-scanned")
    lowest = step_up(*_bin_counts(scanned), rate)
    return scanned.select("doc_id", _spans(lowest).alias("spans"))


def _bin_counts(scanned: DataFrame) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """Candidates by stratum of length and bin of p, and tests by stratum; so few rows reach the driver whatever the corpus."""
    c = scanned.select(F.explode("more").alias("c"))
    rows = c.groupBy(_stratum(F.col("c.end") - F.col("c.start")).alias("s"), _bin(F.col("c.p")).alias("b")).count().collect()
    tests = scanned.agg(*[F.sum(F.get("tried", i)) for i in range(len(STRATA))]).first()
    return {(r["s"], r["b"]): r["count"] for r in rows}, {i: n or 0 for i, n in enumerate(tests)}


def _spans(lowest: dict[int, int]) -> Column:
    def accepted(c: Column) -> Column:
        stratum, limit = _stratum(c.end - c.start), F.lit(BINS)
        for s, b in lowest.items():
            limit = F.when(stratum == s, F.lit(b)).otherwise(limit)
        return _bin(c.p) >= limit

    plain = lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"))
    rank = lambda c: F.struct(c.start.alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), c.kind).alias("place"), c.kind.alias("kind"), c.end.alias("end"))
    found = F.concat(F.col("base"), F.transform(F.filter("more", accepted), plain))
    return F.transform(F.sort_array(F.transform(found, rank)), plain)


def digest(scan: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text, n_random."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return scan.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s.kind != "random")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), n("random").alias("n_random"),
    )


def redact(docs: DataFrame, *, text: str = "text", rate: float = 0.001, reject: float = 0.001, mark: str = "<secret>") -> DataFrame:
    """The documents with every find replaced by a mark (overlapping finds by one); all columns stay, also of rows without finds.

    The first pass measures the corpus for the step-up, the second scans again and replaces. A null text
    stays null; columns may have any names; an empty table gives an empty result.
    """
    names = docs.columns
    scanned = durable(_scanned(docs.select(F.lit(0).alias("id"), F.col(f"`{text}`").alias("body")), "body", "id", reject), "secrets-scanned")
    lowest = step_up(*_bin_counts(scanned), rate)

    def clean(t: bytes) -> bytes:
        base = _base_spans(t)
        found = [(a, b) for a, b, _ in base]
        for a, b, _, p in _candidates(t, base, reject)[0]:
            stratum = sum(b - a >= s for s in STRATA[1:])
            if min(int(-math.log10(max(p, 1e-300)) / BIN_WIDTH), BINS - 1) >= lowest.get(stratum, BINS):
                found.append((a, b))
        out, at, masked = [], 0, 0
        for a, b in sorted(found):
            if a >= masked:
                out += [t[at:a], mark.encode()]
            at = masked = max(masked, b)
        return b"".join([*out, t[at:]])

    def replace(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(1)
        texts = [None if not ok else clean(t).decode() for t, ok in zip(blobs(raw), raw.is_valid().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "body"])

    held = docs.select(F.struct(*[F.lit(None).cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").cast("string").alias("body"))
    return map_batches(held, replace, held.schema).select(*[(F.col("body") if c == text else F.col(f"row.`{c}`")).alias(c) for c in names])
