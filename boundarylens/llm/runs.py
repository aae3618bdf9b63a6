"""Periodic runs of words after Kolpakov and Kucherov, document by document.

A suffix automaton of a text's words gives its factorisation: each factor is the longest stretch that also
starts earlier, or one new word. Every run either touches a border of factors or lies strictly inside
one. Main's algorithm finds the first kind at each border, from the lengths of common extensions to both
sides of it; a run inside a factor is a copy of one inside the factor's earlier occurrence, and is copied
from there in ascending order of starts. All of it is linear in the words of a text, but for the output.

Only texts that can hold a run that is asked for come so far: in a run of at least `least` words and `power` periods every
stretch of `least // 3` words occurs again, so words outside such stretches are left out first. That
leaves nothing of most prose, and changes no result: words that stand together in a run stay together.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundarylens.llm.common import blobs, map_batches


class SuffixAutomaton:
    """States of all stretches of a text: transitions, and the place where a state's stretches first end."""

    def __init__(self, word: Sequence[int]):
        self.next: list[dict[int, int]] = [{}]
        self.first = [-1]
        link, length = [-1], [0]
        last = 0
        for at, symbol in enumerate(word):
            new = len(self.next)
            self.next.append({})
            self.first.append(at)
            length.append(length[last] + 1)
            link.append(0)
            state = last
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = link[state]
            if state >= 0:
                target = self.next[state][symbol]
                if length[target] != length[state] + 1:
                    twin = len(self.next)
                    self.next.append(self.next[target].copy())
                    self.first.append(self.first[target])
                    length.append(length[state] + 1)
                    link.append(link[target])
                    link[target] = twin
                    while state >= 0 and self.next[state].get(symbol) == target:
                        self.next[state][symbol] = twin
                        state = link[state]
                    target = twin
                link[new] = target
            last = new


def factors(word: Sequence[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of each factor; a new symbol has -1. The earlier occurrence may overlap the factor."""
    automaton = SuffixAutomaton(word)
    out, start = [], 0
    while start < len(word):
        state, end = 0, start
        while end < len(word):
            to = automaton.next[state].get(word[end], 0)
            if not to or automaton.first[to] >= end:
                break
            state, end = to, end + 1
        if end == start:
            out.append((start, start := start + 1, -1))
        else:
            out.append((start, end, automaton.first[state] - (end - start) + 1))
            start = end
    return out


def common_prefixes(word: Sequence[int]) -> list[int]:
    """For each place the length of the longest common prefix of the word and its rest from there."""
    n = len(word)
    out = [n] + [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(out[i - left], right - i) if i < right else 0
        while i + k < n and word[k] == word[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(word: Sequence[int], before: int, border: int, end: int, power: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that touch the border and end in the factor behind it, border to end; the factor in front starts at before.

    Had such a run its second period at or before `before`, the factor there would reach beyond the border;
    so it starts within twice the front factor and once the other one of the border, and its period is short.
    """
    low = max(0, border - 2 * (border - before) - (end - border) - 1)
    most = (end - before - 1) // (power - 1)
    left, right = list(word[low:border])[::-1], list(word[border : end + 1])
    both = list(word[low:end])
    back, ahead = common_prefixes(left), common_prefixes(right)
    back_far = common_prefixes([*left, None, *both[::-1]])[len(left) + 1 :]
    ahead_far = common_prefixes([*right, None, *word[low : end + 1]])[len(right) + 1 :]
    for period in range(1, most + 1):
        if period <= end - border:  # a whole period behind the border
            start, stop = border - back_far[end - border - period], border + period + (ahead[period] if period < len(right) else 0)
            if stop <= end and stop - start >= power * period and (start > low or not low):
                yield start, stop, period
        if period <= border - low:  # a whole period in front of it
            start, stop = border - period - (back[period] if period < len(left) else 0), border + ahead_far[border - period - low]
            if stop <= end and stop - start >= power * period and (start > low or not low):
                yield start, stop, period


def runs(word: Sequence[int], least: int = 24, power: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run of at least `least` symbols and `power` (2 or more) periods, in order."""
    parts = factors(word)
    borders = [(a[0], b[0], b[1]) for a, b in pairwise(parts)]
    if parts:
        borders.append((parts[-1][0], len(word), len(word)))
    found: dict[tuple[int, int], int] = {}
    for before, border, end in borders:
        if (end - before - 1) * power >= least * (power - 1):  # else too short for what follows a run's first period
            for start, stop, period in crossing(word, before, border, end, power):
                if stop - start >= least:
                    found[start, stop] = min(period, found.get((start, stop), period))
    at: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (start, stop), period in found.items():
        at[start].append((stop, period))
    if found:
        for start, end, earlier in parts:
            shift = start - earlier
            if earlier >= 0 and end - start > least:
                for s in range(earlier + 1, end - shift - least):
                    for stop, period in at.get(s, ()):
                        if stop < end - shift:
                            at[s + shift].append((stop + shift, period))
    return sorted((start, stop, period) for start, ends in at.items() for stop, period in ends)


def repeating(hashes: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least `least` words in which every `size` words occur again in the text. Equal hashes of different words only add some."""
    n = len(hashes) - size + 1
    if n < 2:
        return []
    mix = np.zeros(n, np.uint64)
    for j in range(size):
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    order = np.argsort(mix, kind="stable")
    same = mix[order][1:] == mix[order][:-1]
    again = np.zeros(n + 2, np.int8)
    again[1 + order[1:][same]] = 1
    again[1 + order[:-1][same]] = 1
    edge = np.flatnonzero(np.diff(again))
    return [(a, b) for a, b in zip(edge[::2].tolist(), (edge[1::2] + size - 1).tolist(), strict=True) if b - a >= least]


def word_runs(words: list[bytes], least: int = 24, power: int = 3) -> list[tuple[int, int, int]]:
    """Runs of a text's words."""
    if len(words) < least:
        return []
    spots = repeating(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), least // 3, least)
    if not spots:
        return []
    known: dict[bytes, int] = {}
    word: list[int] = []
    place: list[int] = []
    reach = 0
    for number, (start, end) in enumerate(spots):
        if start > reach:  # stretches may share words at their ends; apart from that a symbol of its own stands between them
            word.append(-1 - number)
            place.append(-1)
        word += [known.setdefault(w, len(known)) for w in words[max(start, reach) : end]]
        place += range(max(start, reach), end)
        reach = max(reach, end)
    return [(place[s], place[e - 1] + 1, p) for s, e, p in runs(word, least, power)]


def repeated_words(words: list[bytes], h: int) -> list[bytes]:
    """The contract's altered texts: from word g mod n on, the first words there over and over."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least: int = 24, power: int = 3, alter: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period, in words, by start and period), collapsed (the text without repeated periods).

    Words are what stands between ASCII white space. A word goes if a run holds it after the run's
    first period; the rest is joined by one space. With `alter` texts are first altered as op11's contract
    says, by the crc32 of the id; rows of null id are not altered. A null text has no words, no runs and an
    empty collapsed text, as have empty and blank ones. Each row is by itself: repeated rows give repeated results, an empty
    table an empty one. A text's memory is linear in those of its words that can belong to runs. Other columns are not read.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        found, left = [], []
        for i, body in zip(ids, blobs(batch.column(1)), strict=True):
            words = body.split()
            if alter and i is not None:
                words = repeated_words(words, crc32(b"%d" % i))
            spans = word_runs(words, least, power)
            found.append([{"start": s, "length": e - s, "period": p} for s, e, p in sorted(spans, key=lambda x: (x[0], x[2]))])
            kept, upto = [], 0
            for s, e, p in sorted((s + p, e, p) for s, e, p in spans):
                kept += words[upto : max(s, upto)]
                upto = max(upto, e)
            left.append(b" ".join(kept + words[upto:] if spans else words))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(given, each, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts, the run of greatest exponent, and digests of runs and collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    # length a of period p is the greater exponent beside length b of period q if a * q > b * p: exact in integers.
    first = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.col("runs").getItem(0),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    best = F.when(F.size("runs") > 0, first)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
