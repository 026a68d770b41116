"""How texts end: a terminal-context model, and right-censored length distributions.

The model counts, over all texts of a table, how often the last one to four words before a place are followed by the
end of a sentence. A text without a final stop is judged by the contexts it ends in, with longer contexts backed off to
shorter ones. Lengths are modelled as lognormal per source, censored at candidate limits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillstone.session import materialize

#: Longest context in words; weight of the shorter context in the estimate of a longer one.
ORDER, BACKOFF = 4, 1.0
#: Bound on the contexts that are sent to every task as a filter; beyond it all contexts are counted by a shuffle.
MAX_CONTEXTS = 1_000_000
KEEP = 300_000

_INVISIBLE = "­​‌‍⁠﻿"
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + _INVISIBLE
_TOKEN = re.compile(r"`[^`\n]*`|\w+(?:['’]\w+)*|[.!?]+(?=[\s)\"'”’»\]*_]|\Z)|[^\w\s]")
#: A mark in brackets that something was left out, at the end of a text; dots need none.
_OMITTED = re.compile(r"[\[(]\s*(?:\.{2,}|…|truncated|cut|continued|unfinished|snip|more)\s*[\])]?|<(?:truncated|cut|snip)>", re.I)
_FILLED = re.compile(r"`[^`\n]*`|\d+")
_STOPPED = re.compile(r"[.!?。][)\"'”’»\]*_]*\Z")
#: Codes of a final stop and of a mark of omission, which tells nothing of sentence ends.
_STOP, _LEFT_OUT = 1, 2
_MASK = np.uint64(0x9E3779B97F4A7C15)


def state_of(text: str) -> str:
    """`omitted` (a mark says so), `open` (an unclosed quote or bracket), `stop` (a final stop) or `none`."""
    t = text.rstrip(_BLANKS)
    marked = t.endswith(("..", "…")) or _OMITTED.fullmatch(t, max(0, *(t.rfind(x) for x in "[(<")))
    if marked and re.search(r"\w", t):
        return "omitted"
    if t.count("`") % 2:
        return "open"
    bare = re.sub(r"`[^`]*`", "", t)
    stopped = bool(_STOPPED.search(t))
    if any(bare.count(a) > bare.count(b) and (not stopped or bare.startswith(a)) for a, b in ("()", "[]", "“”")):
        return "open"  # with a final stop only if the whole text stands in the bracket
    return "stop" if stopped else "none"


def shape(text: str) -> int:
    """A hash of the text but for its numbers and quoted names: texts of one pattern are alike in length, too."""
    return xxhash.xxh3_64_intdigest(_FILLED.sub("#", text).encode("utf-8", "surrogatepass")) - (1 << 63)


class Contexts:
    """Codes of words and of the contexts that end at each of them."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}

    def code(self, t: str) -> int:
        got = self.codes.get(t)
        if got is None:
            if len(self.codes) >= KEEP:
                self.codes.clear()
            if t[0] in ".!?" and t.strip(".!?") == "":
                got = _LEFT_OUT if ".." in t else _STOP
            elif t == "…":
                got = _LEFT_OUT
            else:
                got = xxhash.xxh3_64_intdigest("`" if t[0] == "`" and len(t) > 1 else "9" if t[0].isdigit() else t.lower()) | 4
            self.codes[t] = got
        return got

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, codes, hashes of the contexts ending at each word by order) of all words."""
        code = self.code
        words = [_TOKEN.findall(t) for t in texts]
        text = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        codes = np.array([code(x) for w in words for x in w], np.uint64)
        h = np.zeros((ORDER, len(codes)), np.uint64)
        last = np.zeros(len(codes), np.uint64)
        for k in range(ORDER):
            if k < len(codes):
                before = np.zeros(len(codes), np.uint64)
                same = np.zeros(len(codes), bool)
                before[k:] = codes[: len(codes) - k]
                same[k:] = text[k:] == text[: len(codes) - k]
                before[~same] = 0  # before the text begins
                last = (last ^ before) * _MASK
                last ^= last >> np.uint64(29)
                h[k] = last + np.uint64(k)
        return text, codes, h


def last_contexts(texts: list[str], contexts: Contexts) -> list[list[int] | None]:
    """The hashes of the contexts in which each text ends, by order; null for a text without words."""
    text, _, h = contexts.of([t.rstrip(_BLANKS) for t in texts])
    out: list[list[int] | None] = [None] * len(texts)
    if len(text):
        ends = np.append(np.nonzero(text[1:] != text[:-1])[0], len(text) - 1)
        for e in ends:
            out[text[e]] = h[:, e].view(np.int64).tolist()
    return out


def count_contexts(df: DataFrame, columns: list[str], wanted: np.ndarray | None) -> DataFrame:
    """(ctx, n_all, n_stop) over the array<string> columns of `df`; context 0 has the totals.

    Counts are summed per batch before the shuffle. With `wanted`, only those contexts are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts()
        for b in batches:
            texts = [t for c in b.columns for x in c.to_pylist() if x for t in x if t]
            text, codes, h = contexts.of(texts)
            if not len(codes):
                continue
            follows = np.zeros(len(codes), bool)
            follows[:-1] = text[1:] == text[:-1]
            follows &= codes > _LEFT_OUT
            follows[:-1] &= codes[1:] != _LEFT_OUT
            stop = np.zeros(len(codes), bool)
            stop[:-1] = codes[1:] == _STOP
            stop &= follows
            keys, alls, stops = [np.zeros(1, np.int64)], [np.array([int(follows.sum())])], [np.array([int(stop.sum())])]
            for k in range(ORDER):
                x, s = h[k][follows].view(np.int64), stop[follows]
                if wanted is not None:
                    at = np.minimum(np.searchsorted(wanted, x), max(len(wanted) - 1, 0))
                    hit = wanted[at] == x if len(wanted) else np.zeros(len(x), bool)
                    x, s = x[hit], s[hit]
                u, inv = np.unique(x, return_inverse=True)
                keys.append(u)
                alls.append(np.bincount(inv, minlength=len(u)))
                stops.append(np.bincount(inv, weights=s, minlength=len(u)).astype(np.int64))
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(alls).astype(np.int64)), pa.array(np.concatenate(stops).astype(np.int64))], names=["ctx", "n_all", "n_stop"])

    counted = df.select(*columns).mapInArrow(run, "ctx long, n_all long, n_stop long")
    return counted.groupBy("ctx").agg(F.sum("n_all").alias("n_all"), F.sum("n_stop").alias("n_stop"))


def stop_probability(ends: DataFrame, texts: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """(key, p_stop, base, known): how likely a sentence ends after the contexts in `ends.ctx` (array by order).

    base is the share of words before a stop; known tells whether the last word occurs before another one anywhere.
    """
    flat = ends.select(*key, F.posexplode("ctx").alias("k", "c"))
    need = flat.select("c").distinct()
    wanted = need.limit(MAX_CONTEXTS + 1).toArrow().column(0).to_numpy() if need.limit(MAX_CONTEXTS + 1).count() <= MAX_CONTEXTS else None
    counts = count_contexts(texts, columns, None if wanted is None else np.sort(wanted))
    counts = materialize(counts, "ctx")
    total = counts.filter("ctx = 0").agg(F.sum("n_all"), F.sum("n_stop")).first()
    base = (total[1] or 0) / total[0] if total[0] else 0.0
    joined = flat.join(counts.withColumnRenamed("ctx", "c"), "c", "left")
    zero = F.lit(0).cast("long")
    got = joined.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("n_all", zero).alias("a"), F.coalesce("n_stop", zero).alias("s")))).alias("x"))
    p = F.aggregate("x", F.lit(base), lambda acc, x: (x["s"] + F.lit(BACKOFF) * acc) / (x["a"] + F.lit(BACKOFF)))
    return got.select(*key, p.alias("p_stop"), F.lit(base).alias("base"), (F.col("x")[0]["a"] > 0).alias("known"))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limit: float | None, share: float | None = None) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood, lengths at or beyond `limit` being censored there.

    With `share`, only that share of the values at `limit` is censored, and none beyond it. Expectation maximisation on
    the histogram; exact for no limit.
    """
    x, n = np.log(lengths.astype(float)), counts.astype(float)
    part = np.zeros(len(x))
    if limit is not None:
        part = (lengths >= limit).astype(float) if share is None else np.where(lengths == limit, share, 0.0)
    mu, sigma = float(np.average(x, weights=n)), max(0.05, float(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n))))
    if not part.any() or part.all() and part.min() == 1.0:
        return mu, sigma
    c = math.log(limit)
    for _ in range(60):
        a = (c - mu) / sigma
        tail = max(1e-12, 0.5 * math.erfc(a / math.sqrt(2)))
        hazard = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
        m1 = mu + sigma * hazard
        m2 = mu * mu + sigma * sigma + sigma * (c + mu) * hazard
        new_mu = float(np.average(part * m1 + (1 - part) * x, weights=n))
        new_sigma = max(0.05, math.sqrt(max(0.0, float(np.average(part * m2 + (1 - part) * x * x, weights=n)) - new_mu * new_mu)))
        if abs(new_mu - mu) + abs(new_sigma - sigma) < 1e-7:
            break
        mu, sigma = new_mu, new_sigma
    return mu, sigma


def limits_of(lengths: np.ndarray, counts: np.ndarray, least: int = 4, factor: float = 6.0) -> list[tuple[int, float]]:
    """(limit, posterior that a value of that length was cut) at the limits of one source.

    Every length with at least `least` values and `factor` times what its neighbours have is a candidate. A share of the
    source's values is subject to a limit: all of them, or those of a feed or of a time. With S the tail and f the
    density of the lengths fitted with censoring there, the likelihood of the share w is that of the values at the limit
    (f + w S) and of those beyond it (1 - w); the candidate is a limit if the best w is so much likelier than 0 that it
    stands out among all lengths.
    """
    o = np.argsort(lengths)
    lengths, counts = lengths[o], counts[o]
    keep = lengths > 0
    lengths, counts = lengths[keep], counts[keep]
    if not len(lengths):
        return []
    total, out = counts.sum(), []
    beyond, before = total - np.cumsum(counts), np.concatenate([[0], np.cumsum(counts)])
    around = before[np.searchsorted(lengths, lengths + 12, "right")] - before[np.searchsorted(lengths, lengths - 12, "left")] - counts
    below = before[np.arange(len(lengths))] - before[np.searchsorted(lengths, lengths - 12, "left")]
    near = np.maximum(below / 12, np.where(beyond > 0.002 * total, around / 24, 0))  # none lie behind a limit for all
    spikes = (counts >= least) & (counts >= factor * np.maximum(near, 0.25))
    for v, n, more, by in zip(lengths[spikes].tolist(), counts[spikes].tolist(), beyond[spikes].tolist(), near[spikes].tolist()):
        all_ = more <= 0.002 * total  # then those beyond are taken for errors of storage
        w = share = 1.0
        for _ in range(3):
            mu, sigma = fit_censored(lengths, counts, float(v), None if all_ else share)
            z = (math.log(v) - mu) / sigma
            density = math.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * sigma * v)
            tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
            usual = max(density, by / total, 0.25 / total)
            r = tail / usual
            w = 1.0 if all_ else min(1.0, max(0.0, (n * r - more) / (r * (n + more))))
            share = w * tail / (usual + w * tail)
            if all_ or not share:
                break
        if n < factor * max(total * density, by, 0.25) or not share:
            continue
        gain = n * math.log1p(w * r) + (0.0 if all_ else more * math.log1p(-min(w, 1 - 1e-12)))
        if gain > math.log(len(lengths)) + SURE:
            p = tail / (tail + density) if all_ else share
            out.append((int(v), float(min(p, 1 - 0.5 / (n + 1)))))
    return out


def limits(values: DataFrame) -> DataFrame:
    """(source, field, n_chars, p_cut) of the limits of each source and field of `values`; h is the shape of the text."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, field, hist in zip(*(c.to_pylist() for c in b.columns)):
                got = limits_of(np.array([x["n_chars"] for x in hist], np.int64), np.array([x["n"] for x in hist], np.int64))
                rows += [(source, field, a, c) for a, c in got]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["source", "field", "n_chars", "p_cut"])

    # a histogram per source and field: as many entries as there are lengths; texts of equal shape count once, they are no spike
    once = values.select("source", "field", "n_chars", "h").distinct()
    h = once.groupBy("source", "field", "n_chars").agg(F.count(F.lit(1)).alias("n")).groupBy("source", "field").agg(F.collect_list(F.struct("n_chars", "n")).alias("hist"))
    return h.mapInArrow(fit, "source string, field string, n_chars long, p_cut double")


#: Prior odds of a cut text; share of mid-word cuts among cuts, and of words that are new to the model among ends of
#: complete texts; odds of a cut after trailing white space.
PRIOR, NEW_IF_CUT, NEW_IF_WHOLE, BLANK = 0.1, 0.5, 0.02, 6.0
#: How much likelier a mark of omission, and an unclosed quote or bracket, is in a cut text than in a whole one; share of
#: cut texts that end in a stop; share of texts ending in a stop whose last sentence is not complete all the same.
MARKED, UNCLOSED, STOP_IF_CUT, STOP_INSIDE = 5_000.0, 2_000.0, 0.03, 0.01
#: Log likelihood by which a limit must beat the luckiest of all lengths.
SURE = 3.0


def cut_probability(state: Column, p_stop: Column, base: Column, known: Column, stop_rate: Column, p_limit: Column, blank: Column) -> Column:
    """Posterior that a text is incomplete because it was cut.

    The log odds of a cut add up the prior, the censoring posterior at the limits of the source, and the evidence of the
    ending: a mark of omission, an open quote or bracket, a stop (all by how much likelier they are in cut texts), or
    else the last contexts, how often the source writes stops, and trailing white space. A text that was cut is
    incomplete unless the cut came right behind a sentence, which a stop tells.
    """
    plain = (
        F.when(known, F.log(F.greatest(base, F.lit(1e-6)) / F.greatest(p_stop, F.lit(1e-6)))).otherwise(F.lit(math.log(NEW_IF_CUT / NEW_IF_WHOLE)))
        - F.log(F.greatest(F.lit(1.0) - stop_rate, F.lit(0.002)))
        + F.when(blank, F.lit(math.log(BLANK))).otherwise(F.lit(0.0))
    )
    ending = (
        F.when(state == "omitted", F.lit(math.log(MARKED))).when(state == "open", F.lit(math.log(UNCLOSED)))
        .when(state == "stop", F.log(F.lit(STOP_IF_CUT) / F.greatest(stop_rate, F.lit(0.002)))).otherwise(plain)
    )
    prior = F.lit(math.log(PRIOR / (1 - PRIOR)))
    limit = F.coalesce(p_limit, F.lit(0.0))
    censored = F.when(limit > 0, F.log(limit / (F.lit(1.0) - limit)) - prior).otherwise(F.lit(0.0))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(prior + censored + ending)))
    return p * F.when(state == "stop", F.lit(STOP_INSIDE)).otherwise(F.lit(1.0))
