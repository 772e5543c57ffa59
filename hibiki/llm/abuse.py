"""Abusive, hateful and sexual passages, by a factorization machine over hashed character terms.

A text is cut into passages at closing marks and line breaks, and these are undisguised: width and look-alike
letters, digits that stand for letters, letters set apart.  A passage's terms are its character n-grams, hashed.
score = w0 + sum w_i + sum_{i<j} <v_i, v_j>: the factors catch pairs, such as an insult with the mention of a group,
that no single term gives away.  A document is as bad as its worst passage, or two neighbouring passages together: the
sums that make up a score add up over passages, so the pairs between neighbours cost next to nothing.
No list of words is used; what is abusive is learned from the labels alone.

Labels are of documents, passages have none: training alternates between choosing the passage that best explains
each labelled document and fitting the machine; documents whose raters seem wrong are set aside on the way.  The fit
uses at most *max_docs* labelled documents of *max_chars* characters in all, documented bounds; scoring reads every
document whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread

BITS = 18
NGRAMS = (2, 3, 4, 6)
FACTORS = 4
_P = np.uint64(0x100000001B3)

# Look-alike letters and what they stand for.
_LIKE = dict(zip("авекмнорстухіѕјαβεικνορτυχ", "abekmhopctyxisjabeiknoptyx", strict=True))
_LIKE_KANA = dict(zip("力口工二夕卜八", "カロエニタトハ", strict=True))
_LEET = str.maketrans("013457@$!8", "oieastasib")
_HIDDEN = re.compile("[­͏​-‏‪-‮⁠-⁯︀-️﻿]")
_LEET_WORD = re.compile(r"(?<![^\W_])(?=[a-z]*[013457@$!8]+[a-z])[a-z@$!\d]{2,}(?![^\W_])|(?<![^\W_])[013457@$][a-z]{1,}(?![^\W_])")
_APART = re.compile(r"(?<![^\W\d_])(?:[a-z][ .*_\-]){2,}[a-z](?![^\W\d_])")
_APART_CJK = re.compile(r"(?<=[ぁ-ヴ一-龥가-힣ー])[ ・.*_\-　]+(?=[ぁ-ヴ一-龥가-힣ー])")
_FOREIGN = re.compile(f"[{''.join(_LIKE)}]")
_KANA = re.compile("(?<=[ァ-ヴー])[力口工二夕卜八]|[力口工二夕卜八](?=[ァ-ヴー])")
_LEET_MAYBE = re.compile(r"[a-z][013457@$!8]+[a-z]|(?<![^\W_])[013457@$][a-z]")
_LONE = re.compile(r"(?<![A-Za-z\d])\d+(?![A-Za-z\d@$!])")
_DIGITS = re.compile(r"\d+")
_ENDS = re.compile(r"[。.!?！？…।．]+(?=[\s」』）)\"”»]|$|[^\x00-\x7f])[」』）)\"”»]*|\n+|｡|\s{2,}")
_CODE = re.compile(r"[A-Z0-9]*\d[A-Z0-9]*(?:-[A-Z0-9]+)+|[A-Z]{2}-?\d{3,}")


def lines(text: str) -> list[str]:
    """The passages of a text with codes and numbers masked, so that like passages are alike."""
    return _LONE.sub("0", _ENDS.sub("\n", _CODE.sub("#", text))).split("\n")


def undisguised(line: str) -> str:
    """A passage as it is meant to be read, in lower case."""
    foreign = not line.isascii()
    if foreign:
        line = _HIDDEN.sub("", line)
        if not unicodedata.is_normalized("NFKC", line):
            line = unicodedata.normalize("NFKC", line)
    if _LEET_MAYBE.search(line):
        line = _LEET_WORD.sub(lambda m: m.group().translate(_LEET), line)
    line = line.lower()
    if foreign:
        line = _KANA.sub(lambda m: _LIKE_KANA[m.group()], _APART_CJK.sub("", line))
        if _FOREIGN.search(line):
            line = _FOREIGN.sub(lambda m: _LIKE[m.group()], line)
    line = _APART.sub(lambda m: re.sub(r"[ .*_\-]", "", m.group()), line)
    return _DIGITS.sub("0", line).strip().replace("\n", " ")


def _hashes(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, (hashed n-grams, line of each) within the lines of undisguised text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return
    line = np.cumsum(codes == 10, dtype=np.int32)
    c = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c ^= c >> np.uint64(31)
    inner = np.flatnonzero(codes != 10)
    h = c
    for n in range(2, max(NGRAMS) + 1):
        if len(codes) < n:
            return
        h = h[:-1] * _P + c[n - 1 :]
        if n in NGRAMS:
            at = inner[: np.searchsorted(inner, len(h))]
            at = at[line[at] == line[at + n - 1]]
            yield (((h[at] ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32), line[at]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashed terms, passage number of each) of undisguised text; passages are its lines."""
    parts = list(_hashes(text))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


class Machine:
    """A factorization machine; terms weigh by one over the root of the number of terms of the passage."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w0 = -2.0
        self.w = np.zeros(1 << BITS, np.float32)
        self.v = rng.normal(0, 0.02, (1 << BITS, FACTORS)).astype(np.float32)

    def scores(self, terms: np.ndarray, starts: np.ndarray, block: int = 1 << 20) -> np.ndarray:
        """Log-odds of passages; the terms of passage i are terms[starts[i]:starts[i + 1]].  Works in blocks of bounded size."""
        n = len(starts) - 1
        out = np.full(n, self.w0, np.float64)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + block, "right")) - 1)
            t = terms[starts[first] : starts[last]]
            size = np.diff(starts[first : last + 1])
            owner = np.repeat(np.arange(last - first, dtype=np.int32), size)
            x = 1 / np.sqrt(np.maximum(size, 1))
            total = np.bincount(owner, self.w[t], last - first) * x
            for f in range(FACTORS):
                v = self.v[t, f]
                total += 0.5 * (np.bincount(owner, v, last - first) ** 2 - np.bincount(owner, v * v, last - first)) * x * x
            out[first:last] += total
            first = last
        return out

    def line_sums(self, text: str, n: int) -> np.ndarray:
        """Of each of the n lines of undisguised text what its score is made of: sums of weights, of factors and of their
        squares, and the number of terms.  The sums of neighbouring lines add up to those of both together."""
        table = getattr(self, "_table", None)
        if table is None:
            table = self._table = np.concatenate([self.w[:, None], self.v, (self.v**2).sum(1, keepdims=True)], 1)
        sums = np.zeros((n, FACTORS + 3))
        for terms, line in _hashes(text):
            if len(terms):
                first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                at = line[first]
                sums[at, :-1] += np.add.reduceat(table[terms], first, 0)
                sums[at, -1] += np.diff(np.append(first, len(terms)))
        return sums

    def odds(self, sums: np.ndarray) -> np.ndarray:
        """Log-odds from line_sums(), -inf where there is no term."""
        size = sums[:, -1]
        x = 1 / np.sqrt(np.maximum(size, 1))
        z = self.w0 + sums[:, 0] * x + 0.5 * ((sums[:, 1:-2] ** 2).sum(1) - sums[:, -2]) * x * x
        return np.where(size > 0, z, -np.inf)

    def line_scores(self, text: str, n: int) -> np.ndarray:
        return self.odds(self.line_sums(text, n))

    def fit(self, terms: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 0, batch: int = 512, rate: float = 0.25, decay: float = 2e-4, seed: int = 5) -> None:
        """Adagrad on the weighted logistic loss of passages, whose terms are terms[first:first + size], not copied.

        epochs 0: as many as make 400,000 steps over passages, 3 to 12.
        """
        rng = np.random.default_rng(seed)
        n = len(y)
        epochs = epochs or max(3, min(12, 400_000 // max(1, n)))
        gw, gv, g0 = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                rows = order[i : i + batch]
                sizes = size[rows]
                at = np.repeat(first[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                t, o = terms[at], np.repeat(np.arange(len(rows)), sizes)
                x = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)
                xo = x[o]
                v = self.v[t]
                sums = np.stack([np.bincount(o, v[:, f], len(rows)) for f in range(FACTORS)], 1).astype(np.float32)
                pair = 0.5 * ((sums**2).sum(1) - np.bincount(o, (v * v).sum(1), len(rows))) * x * x
                z = self.w0 + np.bincount(o, self.w[t], len(rows)) * x + pair
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]).astype(np.float32)
                unique, inverse = np.unique(t, return_inverse=True)
                dw = np.bincount(inverse, g[o] * xo, len(unique)).astype(np.float32) + decay * self.w[unique]
                gw[unique] += dw * dw
                self.w[unique] -= rate * dw / np.sqrt(gw[unique])
                for f in range(FACTORS):
                    d = np.bincount(inverse, g[o] * xo * xo * (sums[o, f] - v[:, f]), len(unique)).astype(np.float32) + decay * self.v[unique, f]
                    gv[unique, f] += d * d
                    self.v[unique, f] -= 0.3 * rate * d / np.sqrt(gv[unique, f])
                d0 = float(g.sum())
                g0 += d0 * d0
                self.w0 -= 0.1 * rate * d0 / np.sqrt(g0)


def passages_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Distinct passages over all texts and, text by text, the numbers of its passages: (passages, (text, passage) pairs)."""
    index: dict[str, int] = {}
    pairs: list[tuple[int, int]] = []
    plain: dict[str, str] = {}
    for i, t in enumerate(texts):
        for x in set(lines(t)):
            if x not in plain:
                plain[x] = undisguised(x)
            if len(plain[x]) >= 2:
                pairs.append((i, index.setdefault(plain[x], len(index))))
    return list(index), np.array(pairs, np.int64).reshape(-1, 2)


def _terms_of(passages: list[str], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all passages one after another, where each begins), gathered in blocks."""
    parts, sizes = [], []
    for i in range(0, len(passages), block):
        some = passages[i : i + block]
        terms, owner = features("\n".join(some))
        parts.append(terms[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner, minlength=len(some)))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def train(texts: list[str], votes: np.ndarray, rounds: int = 2, folds: int = 2, seed: int = 5) -> Machine:
    """Fit on texts and the mean vote of each (0 to 1).

    Which passage made a document bad is told by others only: at first by log-odds of its terms without its own
    document, then by machines fitted on other folds of the documents.  A bad document none of whose passages
    looks bad to the others counts as misjudged and teaches nothing.
    """
    machine = Machine(seed)
    passages, pairs = passages_of(texts)
    bad, good = votes > 0.5, votes < 0.5
    if not passages or not bad.any() or not good.any():
        machine.w0 = -20.0
        return machine
    n = len(passages)
    terms, starts = _terms_of(passages)
    sizes = np.diff(starts)
    doc, pas = pairs[:, 0], pairs[:, 1]
    n_bad, n_good = np.bincount(pas[bad[doc]], minlength=n), np.bincount(pas[good[doc]], minlength=n)
    in_bad, in_good_docs = np.zeros(1 << BITS), np.zeros(1 << BITS)
    blocks = [(i, min(n, i + 8192)) for i in range(0, n, 8192)]
    for i, j in blocks:
        t = terms[starts[i] : starts[j]]
        in_bad += np.bincount(t, np.repeat(n_bad[i:j], sizes[i:j]), 1 << BITS)
        in_good_docs += np.bincount(t, np.repeat(n_good[i:j], sizes[i:j]), 1 << BITS)
    score = np.empty(n)
    for i, j in blocks:  # log-odds of a passage's terms in the documents, its own one left out
        t, own = terms[starts[i] : starts[j]], np.repeat(np.arange(j - i), sizes[i:j])
        odds = np.log((np.maximum(in_bad[t] - (n_bad[i:j] > 0)[own], 0) + 0.3) / bad.sum()) - np.log((np.maximum(in_good_docs[t] - (n_good[i:j] > 0)[own], 0) + 0.3) / good.sum())
        score[i:j] = np.bincount(own, np.clip(odds, -3, 3), j - i) / np.maximum(sizes[i:j], 1) * 3 - 2.0
    fold = np.random.default_rng(seed).integers(0, folds, len(texts))

    def fitted(score: np.ndarray, keep: np.ndarray) -> Machine:
        """A machine on the documents of keep, the bad passages picked by score."""
        of_bad = bad[doc] & keep[doc]
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc[of_bad], score[pas[of_bad]])
        chosen = np.unique(pas[of_bad & (score[pas] > 0) & (score[pas] >= np.minimum(top[doc], 2.0))])
        in_good = np.zeros(n, bool)
        in_good[pas[good[doc] & keep[doc]]] = True
        chosen = chosen[n_bad[chosen] >= 3 * n_good[chosen]]
        y, weight = np.zeros(n, np.float32), np.zeros(n, np.float32)
        weight[in_good & ((score < 2) | (n_good > 1))] = 1
        weight[chosen], y[chosen] = 2, 1
        use = np.flatnonzero(weight > 0)
        m = Machine(seed)
        m.fit(terms, starts[use], sizes[use], y[use], weight[use], seed=seed)
        return m

    everyone = np.ones(len(texts), bool)
    for _ in range(rounds - 1):
        fresh = np.full(n, -np.inf)
        for f in range(folds):
            z = fitted(score, fold != f).scores(terms, starts)
            mine = np.unique(pas[fold[doc] == f])
            fresh[mine] = np.maximum(fresh[mine], z[mine])
        score = fresh
    return fitted(score, everyone)


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, max_docs: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and mean votes of labelled documents, in the order of their hashes: at most max_docs and max_chars characters."""
    votes = labels.filter(F.col(toxic).isNotNull()).groupBy(doc_id).agg(F.avg(F.col(toxic).cast("double")).alias("vote"), F.count("*").alias("n"))
    votes = votes.orderBy(F.xxhash64(doc_id), doc_id).limit(max_docs)
    rows = docs.filter(F.col(text).isNotNull()).select(doc_id, text).join(F.broadcast(votes), doc_id)
    before = F.sum(F.length(text)).over(W.orderBy(F.xxhash64(doc_id), doc_id).rowsBetween(W.unboundedPreceding, 0))  # max_docs rows
    rows = rows.withColumn("chars", before).filter(F.col("chars") <= max_chars).orderBy(F.xxhash64(doc_id), doc_id).select(text, "vote").toPandas()
    return rows[text].tolist(), rows["vote"].to_numpy(float)


def abuse_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", toxic: str = "toxic", max_docs: int = 20_000, max_chars: int = 100_000_000, remembered: int = 200_000) -> DataFrame:
    """(doc_id, source, score) of every document: the probability of its worst passage.  Null and empty texts score 0."""
    texts, votes = labelled(docs, labels, doc_id, text, toxic, max_docs, max_chars)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, votes))
    kept = spread(docs.select(F.col(doc_id), F.col(source), F.col(text).cast("string").alias("__text")))
    schema = T.StructType([kept.schema[doc_id], kept.schema[source], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = model.value
        known: dict[str, int] = {}  # places of passages met before, at most *remembered*
        sums = np.zeros((0, FACTORS + 3))
        for b in batches:
            cut = [lines(t) if t else [""] for t in b.column(2).to_pylist()]
            if len(known) > remembered:
                known, sums = {}, sums[:0]
            fresh = list({x for part in cut for x in part} - known.keys())
            known |= zip(fresh, range(len(known), len(known) + len(fresh)), strict=True)
            parts = [fresh[i : i + 20_000] for i in range(0, len(fresh), 20_000)]
            sums = np.concatenate([sums, *[machine.line_sums("\n".join(map(undisguised, some)), len(some)) for some in parts]])
            of = np.array([known[x] for part in cut for x in part])
            ends = np.cumsum([len(part) for part in cut])
            odds = machine.odds(sums)[of]
            if len(of) > 1:  # a passage with the next one of its document, unless it is the last
                pair = machine.odds(sums[of[:-1]] + sums[of[1:]])
                pair[ends[:-1] - 1] = -np.inf
                odds[:-1] = np.maximum(odds[:-1], pair)
            worst = np.maximum.reduceat(odds, ends - [len(part) for part in cut]) if len(cut) else odds
            score = np.where(np.isneginf(worst), 0, 1 / (1 + np.exp(-np.clip(worst, -40, 40))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def abuse_rates(scores: DataFrame, source: str = "source", threshold: float = 0.5) -> DataFrame:
    """(source, n_docs, n_flagged, rate): documents at or above the threshold, per source; a null source is one of them."""
    flagged = F.sum((F.col("score") >= threshold).cast("long"))
    return scores.groupBy(source).agg(F.count("*").alias("n_docs"), flagged.alias("n_flagged"), (flagged / F.count("*")).alias("rate"))
