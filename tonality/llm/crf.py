"""Language identification: a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its character n-grams and the languages in whose learned lexicon it
stands; transitions between the languages of neighbouring words are learned too.  Forward-backward over stretches of
``CHAIN`` words gives each word's distribution, so that code-switched text gets its languages word by word; a
document's language is the one with the largest mean over its words with letters, and that mean is its score.

Learning uses a sample of about ``SAMPLE_DOCS`` documents of each language (repeated rows once), each with its whole text.  The
sample is taken among texts of at most ``SAMPLE_CHARS`` characters, among all texts of a language that has none so short (bounds for
fitting only; every text is labelled whole).  Half of the sample makes the lexicons, the other half the training chains, in which
stretches of documents in different languages alternate.  All chains of a batch are worked through together.

Defined results: null text, and text without a letter, is ``und`` with score 0; without any labelled rows everything
is ``und``; repeated rows are labelled each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonality.llm.common import worker_memo

CHAIN = 64
BUCKETS = 1 << 17
SAMPLE_DOCS = 300
SAMPLE_CHARS = 128_000
ROUNDS = 30
STEP = 0.5
L2 = 1e-4
LEXICON_COUNT, LEXICON_SHARE = 3, 0.95
MEMO_WORDS = 300_000
MEMO_FEATURES = 200_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def core(chunk: str) -> str:
    """The word in a chunk: lower case, without what is no letter at its ends; empty without letters."""
    return _EDGES.sub("", chunk.lower())


class Buckets(dict):
    """Hash bucket of a feature, remembered: words are many, their parts are few."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= MEMO_FEATURES:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature.encode()) % BUCKETS
        return bucket


def features(word: str, buckets: Buckets) -> list[int]:
    """Hashed features of a word's spelling; at least one for a word that is not empty."""
    n, marked = len(word), f"^{word}$"
    ends = range(1, min(4, n) + 1)
    own = ["p" + word[:i] for i in ends] + ["s" + word[-i:] for i in ends]
    own += [marked[i:i + 2] for i in range(n + 1)]
    own += [marked[i:i + 3] for i in range(n)]
    return list(map(buckets.__getitem__, own))


def forward_backward(emission: np.ndarray, transition: np.ndarray, mask: np.ndarray
                     ) -> tuple[np.ndarray, np.ndarray]:
    """Distributions of all positions, and expected transitions summed over all chains.

    ``emission``: (chains, length, languages) scores; ``mask``: which positions are words, from the left.
    """
    e = np.exp(emission - emission.max(2, keepdims=True))
    a = np.exp(transition - transition.max())
    n, length, k = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        x = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = x / x.sum(1, keepdims=True)
    moves = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        x = e[:, t + 1] * beta[:, t + 1]
        y = x @ a.T
        own = mask[:, t + 1]
        beta[:, t] = np.where(own[:, None], y / y.sum(1, keepdims=True), 1.0)
        norm = (alpha[:, t] * y).sum(1)
        moves += a * ((alpha[:, t] * (own / norm)[:, None]).T @ x)
    p = alpha * beta
    return p / p.sum(2, keepdims=True), moves


@dataclass
class Model:
    """Learned weights; ``key`` names them, so that workers never mix two models' memos."""

    langs: list[str]
    weights: np.ndarray            # (BUCKETS, languages)
    lexicon_weights: np.ndarray    # (languages, languages): in the lexicon of row, label column
    transition: np.ndarray
    lexicon: dict[str, int] = field(repr=False)
    key: str = ""

    def emissions(self, words: list[str], buckets: Buckets) -> np.ndarray:
        """Scores of words that are not empty."""
        lists = [features(w, buckets) for w in words]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((f for own in lists for f in own), np.int64, int(sizes.sum()))
        out = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes)
        at = np.array([self.lexicon.get(w, -1) for w in words])
        out[at >= 0] += self.lexicon_weights[at[at >= 0]]
        return out


class Labeller:
    """A worker's memo of emissions for one model."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.buckets = Buckets()
        self.row: dict[str, int] = {}        # of chunks
        self.word_row: dict[str, int] = {"": 0}
        self.table = np.zeros((1, len(self.model.langs)), np.float32)  # row 0: no letters

    def _learn(self, chunks: set[str]) -> None:
        words = {c: core(c) for c in chunks}
        new = sorted({w for w in words.values() if w not in self.word_row})
        if new:
            self.word_row.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, self.model.emissions(new, self.buckets)])
        self.row.update((c, self.word_row[w]) for c, w in words.items())

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distribution of every word of all texts, whether it has letters, and its text's number."""
        if len(self.row) > MEMO_WORDS:
            self._clear()
        k = len(self.model.langs)
        new = {c for chunks in texts for c in chunks if c not in self.row}
        if new:
            self._learn(new)
        rows = [list(map(self.row.__getitem__, chunks)) for chunks in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((r for own in rows for r in own), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(rows)), sizes)
        if not len(flat):
            return np.zeros((0, k)), np.zeros(0, bool), owner
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        chains = -(-sizes // CHAIN)
        chain = np.repeat(np.cumsum(chains) - chains, sizes) + place // CHAIN
        emission = np.zeros((int(chains.sum()), CHAIN, k), np.float32)
        mask = np.zeros(emission.shape[:2], bool)
        emission[chain, place % CHAIN] = self.table[flat]
        mask[chain, place % CHAIN] = True
        p, _ = forward_backward(emission, self.model.transition.astype(np.float32), mask)
        return p[chain, place % CHAIN], flat > 0, owner

    def documents(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n, k = len(texts), len(self.model.langs)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        p, letters, owner = self.marginals([(t or "").split() for t in texts])
        count = np.bincount(owner[letters], minlength=n)
        mean = np.column_stack([np.bincount(owner[letters], p[letters, j], minlength=n) for j in range(k)])
        mean = mean / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        score = np.clip(mean[np.arange(n), best], 0, 1)
        return [self.model.langs[b] if c else UNKNOWN for b, c in zip(best, count, strict=True)], np.where(count, score, 0.0)


def labeller(model: Model) -> Labeller:
    """The worker's labeller of this model."""
    return worker_memo(("crf", model.key), lambda: Labeller(model))


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fit on texts with their languages."""
    names = sorted(set(langs))
    k = len(names)
    if not k:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)), np.zeros((0, 0)), {}, "none")
    order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode()), texts[i], langs[i]))
    docs = [([core(c) for c in texts[i].split()], names.index(langs[i])) for i in order]
    seen: dict[str, Counter] = {}
    for words, lang in docs[::2]:
        for w in words:
            if w:
                seen.setdefault(w, Counter())[lang] += 1
    lexicon = {}
    for w, c in seen.items():
        lang, n = min(c.most_common(), key=lambda x: (-x[1], x[0]))
        if n >= LEXICON_COUNT and n >= LEXICON_SHARE * c.total():
            lexicon[w] = lang
    # chains of stretches of one document each, half of them going on in the same document
    rng = np.random.default_rng(seed)
    half = [d for d in docs[1::2] if d[0]] or [d for d in docs if d[0]]
    by_lang = [[d for d in half if d[1] == j] for j in range(k)]
    by_lang = [d for d in by_lang if d]
    vocabulary: dict[str, int] = {}
    rows, tags = [], []
    at = {id(d): 0 for d in half}
    for words, lang in half:
        for low in range(0, len(words), CHAIN):
            chain, tag = words[low:low + CHAIN], [lang] * len(words[low:low + CHAIN])
            if rng.random() < 0.5 and len(chain) > 8:
                other = by_lang[rng.integers(len(by_lang))]
                d = other[rng.integers(len(other))]
                i, n = int(rng.integers(len(chain) - 4)), int(rng.integers(4, 24))
                start = at[id(d)] % len(d[0])
                at[id(d)] += n
                put = d[0][start:start + n][:len(chain) - i]
                chain = chain[:i] + put + chain[i + len(put):]
                tag[i:i + len(put)] = [d[1]] * len(put)
            rows.append([vocabulary.setdefault(w, len(vocabulary)) for w in chain])
            tags.append(tag)
    if not rows:  # no words at all
        return Model(names, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros((k, k)), lexicon, "empty")
    mask = np.zeros((len(rows), CHAIN), bool)
    word, gold = np.zeros(mask.shape, np.int64), np.zeros(mask.shape, np.int64)
    for i, (r, t) in enumerate(zip(rows, tags, strict=True)):
        mask[i, :len(r)], word[i, :len(r)], gold[i, :len(t)] = True, r, t
    buckets = Buckets()
    spelled = [features(w, buckets) if w else [] for w in vocabulary]
    f_word = np.repeat(np.arange(len(spelled)), [len(f) for f in spelled])
    f_id = np.array([x for f in spelled for x in f], np.int64)
    lex = np.array([lexicon.get(w, -1) for w in vocabulary], np.int64)
    in_lex = lex >= 0
    used, f_at = np.unique(f_id, return_inverse=True)
    target = np.zeros((len(vocabulary), k))
    np.add.at(target, (word[mask], gold[mask]), 1)
    both = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    w, lw, tr = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros((k, k))
    sq = [np.full_like(x, 1e-8) for x in (w, lw, tr)]
    total = mask.sum()
    for _ in range(ROUNDS):
        table = np.column_stack([np.bincount(f_word, w[f_at, j], minlength=len(spelled)) for j in range(k)])
        table[in_lex] += lw[lex[in_lex]]
        p, moves = forward_backward(table[word], tr, mask)
        expected = np.column_stack([np.bincount(word[mask], p[mask][:, j], minlength=len(spelled)) for j in range(k)])
        by_word = (expected - target) / total
        grads = [np.column_stack([np.bincount(f_at, by_word[f_word, j], minlength=len(used)) for j in range(k)]) + L2 * w / total,
                 np.zeros((k, k)), (moves - gold_moves) / total]
        np.add.at(grads[1], lex[in_lex], by_word[in_lex])
        for x, g, s in zip((w, lw, tr), grads, sq, strict=True):
            s += g * g
            x -= STEP * g / np.sqrt(s)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = w
    digest = hashlib.sha256(weights.tobytes() + lw.tobytes() + tr.tobytes() + repr(names).encode()).hexdigest()
    return Model(names, weights, lw.astype(np.float32), tr, lexicon, digest)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of documents outside the held-out fold."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    short = F.char_length("text") <= SAMPLE_CHARS
    # one row per language
    counts = {r["lang"]: (r["n"], r["n_short"]) for r in known.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(short).alias("n_short")).collect()}
    if not counts:
        return train([], [])
    span = 1 << 30
    share = F.create_map(*(F.lit(x) for lang, (n, n_short) in counts.items()
                           for x in (lang, min(span, span * per_language // (n_short or n) + 1))))
    only_long = [lang for lang, (_, n_short) in counts.items() if not n_short]
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(span))
    rows = (known.where(short | F.col("lang").isin(only_long)).select("doc_id", "lang", "text", place.alias("place"))
            .where(F.col("place") < share[F.col("lang")]).distinct()  # repeated rows count once
            .orderBy("place", "doc_id", "lang", "text").limit(2 * per_language * len(counts) + 100).collect())
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> Column:
    """Column ``struct(lang_pred, score)`` of the ``text`` column."""
    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for low in range(0, len(texts), 256):
                lang, score = labeller(model).documents(texts.iloc[low:low + 256].tolist())
                out.append(pd.DataFrame({"lang_pred": lang, "score": score}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": []})

    return label(docs["text"])


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, words``: every word of every text with its language and that language's probability."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), 512):
                part = frame.iloc[low:low + 512]
                chunks = [(t or "").split() for t in part["text"]]
                if model.langs:
                    p, letters, owner = labeller(model).marginals(chunks)
                    best = p.argmax(1)
                    names = [model.langs[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)]
                    prob = p[np.arange(len(p)), best]
                words, at = [], 0
                for own in chunks:
                    words.append([{"word": c, "lang": names[at + i] if model.langs else UNKNOWN,
                                   "p": float(prob[at + i]) if model.langs else 0.0} for i, c in enumerate(own)])
                    at += len(own)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "words": words})

    return docs.select("doc_id", "text").mapInPandas(
        work, f"doc_id {kind}, words array<struct<word: string, lang: string, p: double>>")


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each document."""
    model = fit(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(docs, model).alias("r")).select(
        "doc_id", "held_out", "r.lang_pred", "r.score")
