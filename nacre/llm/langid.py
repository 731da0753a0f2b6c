"""Operator 9: language identification by scripts, word scores and a Viterbi pass over each text's words."""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import mix64

#: Documents to fit on for each language, at most.
FIT_ROWS_PER_LANGUAGE = 400
#: Cost in nats of changing language between two words; the largest score of a single word.
SWITCH, WORD_CAP = 12.0, 6.0
#: Words that a worker remembers the scores of, with up to four languages; with more, as many fewer.
CACHE_WORDS = 500_000
#: Share of the letters from which the language that opens a mixed text is taken for the text's own.
FRAME = 0.3
#: Longer runs of letters, as of scripts without spaces, are cut into words of so many letters and a rest.
WORD_LETTERS = 40


@lru_cache(maxsize=1)
def _letters() -> re.Pattern:
    """Runs of Unicode's letters (L*) and the marks (M*) that follow them; digits, fractions, circled and Roman numbers are none."""
    ranges: dict[str, list[list[int]]] = {"L": [], "M": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in ranges:
            if ranges[kind] and ranges[kind][-1][1] == c - 1:
                ranges[kind][-1][1] = c
            else:
                ranges[kind].append([c, c])
    letter, mark = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges[k]) for k in "LM")
    return re.compile(f"[{letter}][{letter}{mark}]{{0,{WORD_LETTERS - 1}}}")

# First code points of letter ranges by script; a letter belongs to the last range that starts at or below it.
_SCRIPTS = [(0x00, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "other"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
_STARTS = [s for s, _ in _SCRIPTS]


def script(word: str) -> str:
    """The script of a word's first letter."""
    return _SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def words(text: str | None) -> list[str]:
    """Runs of letters with their marks, lower-cased in normal form C: maximal ones, or consecutive pieces of WORD_LETTERS of
    those that are longer."""
    return _letters().findall(unicodedata.normalize("NFC", text).lower()) if text else []


_MOST_N = 4


def _grams(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 1 to _MOST_N: the hashes of all n-grams of the words with marks at both ends, and the word each is of."""
    code = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    of = np.cumsum(code == 2) - 1
    h = np.zeros(len(code), dtype=np.uint64)
    for n in range(1, _MOST_N + 1):
        m = len(code) - n + 1
        if m <= 0:
            return
        h = mix64(h[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n))
        inside = of[:m] == of[n - 1 :] if n > 1 else code > 3
        yield n, h[inside], of[:m][inside]


class Model:
    """Log shares of character n-grams (1 to 4) and of whole words by language, and the scripts each language is written in."""

    def __init__(self, examples: Iterable[tuple[str, str]]):
        whole: dict[str, Counter] = defaultdict(Counter)
        scripts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in examples:
            for w in words(text):
                whole[lang][w] += 1
                scripts[lang][script(w)] += 1
        self.languages = sorted(whole)
        k = len(self.languages)
        seen: list[list[np.ndarray]] = [[] for _ in range(_MOST_N + 1)]
        for x, lang in enumerate(self.languages):
            ws = sorted(whole[lang])
            times = np.array([whole[lang][w] for w in ws], dtype=np.float64)
            for n, h, of in _grams(ws):
                terms, at = np.unique(h, return_inverse=True)
                seen[n].append((x, terms, np.bincount(at, weights=times[of])))
        self.terms, self.shares = [np.empty(0, np.uint64)], [np.zeros((1, k))]
        for n in range(1, _MOST_N + 1):
            terms = np.unique(np.concatenate([t for _, t, _ in seen[n]])) if seen[n] else np.empty(0, np.uint64)
            c = np.zeros((len(terms), k))
            for x, t, v in seen[n]:
                c[np.searchsorted(terms, t), x] = v
            share = np.log((c + 0.2) / (c.sum(0) + 1 + 0.2 * len(terms)))
            self.terms.append(terms)  # the last row: an unseen n-gram says nothing about which language it is
            self.shares.append(np.vstack([share - share.sum(1, keepdims=True) / max(k, 1), np.zeros((1, k))]))
        count = {x: sum(whole[x].values()) + 1 for x in self.languages}
        self.common = {w: np.array([np.log((whole[x][w] + 0.05) / count[x]) for x in self.languages]) for c in whole.values() for w, k in c.items() if k >= 5}
        self.writes = {s: np.array([scripts[x][s] > 0.02 * sum(scripts[x].values()) for x in self.languages]) for s in {s for c in scripts.values() for s in c}}

    def of_words(self, ws: list[str]) -> np.ndarray:
        """Scores of words by language, each row's mean at 0: sums over a word's n-grams, or its own share if it is common.

        Languages not written in its script fall back by WORD_CAP; a script that no language has leaves all at 0."""
        s = np.zeros((len(ws), len(self.languages)))
        for n, h, of in _grams(ws):
            at = np.minimum(np.searchsorted(self.terms[n], h), max(len(self.terms[n]) - 1, 0))
            row = np.where(self.terms[n][at] == h, at, len(self.terms[n])) if len(self.terms[n]) else np.zeros(len(h), np.int64)
            for x in range(s.shape[1]):
                s[:, x] += np.bincount(of, weights=self.shares[n][row, x], minlength=len(ws)) / 3.0
        for i, w in enumerate(ws):
            own = self.common.get(w)
            if own is not None:
                s[i] = own
        kinds = [script(w) for w in ws]
        for kind in set(kinds):
            rows = np.array([k == kind for k in kinds])
            may = self.writes.get(kind)
            if may is None or not may.any():
                s[rows] = 0
            else:
                t = s[rows] - s[rows][:, may].max(1, keepdims=True)
                s[rows] = np.where(may, np.maximum(t, -WORD_CAP), -2 * WORD_CAP)
        return s - s.mean(1, keepdims=True)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: the largest sum of scores less `switch` for each change.

    A labelling with m changes has a first run, a last one and m - 1 between. If no other language gains more than one switch
    over the best single one in any run, nor more than one in the best first and the best last run together, no labelling
    with a change beats that one, and it is returned without the pass."""
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain[:-1]]), axis=0)
    if (gain - low).max() <= switch and gain.max() + (gain[-1] - low[-1]).max() <= switch:
        return np.full(n, best)
    back = np.empty((n, k), dtype=np.int16)
    here = np.arange(k)
    v = scores[0].copy()
    for t in range(1, n):
        j = int(v.argmax())
        stay = v >= v[j] - switch
        back[t] = np.where(stay, here, j)
        v = np.where(stay, v, v[j] - switch) + scores[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = v.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


class Labeller:
    def __init__(self, model: Model):
        self.model, self.index, self.rows = model, {}, np.zeros((1024, len(model.languages)))

    def learn(self, texts: list[list[str]]) -> None:
        """Score the words of a batch of texts that aren't known yet."""
        if len(self.index) > CACHE_WORDS * 4 // max(4, len(self.model.languages)):
            self.index.clear()
        new = list({w for ws in texts for w in ws if w not in self.index})
        n = len(self.index)
        while len(self.rows) < n + len(new):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.rows[n + at : n + at + len(part)] = self.model.of_words(part)
        self.index.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        split = [words(t) for t in texts]
        self.learn(split)
        return [self.label(ws) for ws in split]

    def label(self, ws: list[str]) -> tuple[str, float, list[tuple[int, int, str]]]:
        """(language, score, spans): the language that opens the text if it holds FRAME of the letters, else that of most letters;
        its share of the letters (or belief in it, if alone); and runs (first word, words, language)."""
        if not ws or not self.model.languages:
            return "und", 0.0, []
        s = self.rows[np.fromiter(map(self.index.__getitem__, ws), dtype=np.int64, count=len(ws))]
        path = viterbi(s)
        size = np.fromiter(map(len, ws), dtype=np.float64, count=len(ws))
        held = np.bincount(path, weights=size, minlength=s.shape[1])
        top = int(held.argmax())
        if held[path[0]] >= FRAME * held.sum():  # a text's own language opens it; what it quotes comes later
            top = int(path[0])
        total = s.sum(0)
        odds = np.exp(np.clip(total - total[top], -50, 50))
        cut = np.flatnonzero(np.diff(path)) + 1
        edges = np.r_[0, cut, len(path)]
        spans = [(int(a), int(b - a), self.model.languages[path[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return self.model.languages[top], float(min(1.0, held[top] / held.sum() * (1 / odds.sum() if len(spans) == 1 else 1.0))), spans


def fit(documents: DataFrame, per_language: int = FIT_ROWS_PER_LANGUAGE) -> Model:
    """Fit on rows with a lang and text: whole texts of at most `per_language` rows of each, chosen by lowest hash of id and text.

    Every language is learned. By a language's count, a bound on the hash leaves some more rows than are wanted (six standard
    deviations), so no task gets more of them as the input grows. The driver holds a part of the texts at a time and counts words."""
    rows = documents.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").select("lang", "text", F.xxhash64("doc_id", F.lit(9)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    low = (F.col("h") == F.col("least")) | (F.col("h") / F.lit(2.0**64) + 0.5 <= F.lit(per_language + 6 * per_language**0.5 + 36) / F.col("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    chosen = rows.join(F.broadcast(counts), "lang").where(low).withColumn("rank", rank).where(F.col("rank") <= per_language)
    return Model((r["lang"], r["text"]) for r in chosen.select("lang", "text").toLocalIterator())


def identify(documents: DataFrame, train: DataFrame, per_language: int = FIT_ROWS_PER_LANGUAGE) -> DataFrame:
    """`documents` with lang_pred, score (0 to 1) and spans (first word, words, lang) of each whole text; words are those of words().

    `train` (doc_id, text, lang) are the rows to learn from. Texts that are null or without a letter get `und`, score 0 and no spans;
    so do all texts if nothing was learned. Columns of those three names are replaced."""
    ship(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(fit(train, per_language))
    kept = documents.drop("lang_pred", "score", "spans")
    schema = kept.limit(0).selectExpr("*", "'' AS lang_pred", "0D AS score", "CAST(NULL AS ARRAY<STRUCT<first: INT, words: INT, lang: STRING>>) AS spans").schema
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = model.value
        label = learned.__dict__.setdefault("_labeller", None) or Labeller(learned)
        learned._labeller = label  # a worker's tasks share what it remembers of words
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = label(part.column("text").to_pylist())
                spans = pa.array([[dict(zip(("first", "words", "lang"), x, strict=True)) for x in g[2]] for g in got], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans], [*part.schema.names, "lang_pred", "score", "spans"])

    return kept.mapInArrow(run, schema)
