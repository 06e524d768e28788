"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed lexicon and of a lexicon learned from
the labelled sample (whole words and word beginnings, so inflected and compound
forms count), the same after undoing character substitutions, how near lexicon
words are to second-person words, and rates of capitals, punctuation, digits and
obfuscated words.  Trees and lexicons are fitted on the driver from a bounded
sample (``rows``) and sent to the tasks; their size does not grow with the data.

Scores lie in [0, 1].  Null and empty texts get the score of a text without
words.  A sample that lacks a label gives everything one score: the share of
label 1 (0 where there are no rows).  Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import labelled, scan
from webquarry.llm.boosting import Boosted, Isotonic
from webquarry.llm.udf import text_udf, with_struct

U = np.uint64
#: A small general lexicon; the learned one carries what a corpus adds.
INSULTS = ("idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown jerk fool imbecile filth vermin bastard bitch shit fuck fucking asshole crap "
           "idiota imbécil estúpido estúpida basura asqueroso mierda puta idiote imbécile stupide ordure connard salaud merde dégoûtant dumm blödmann trottel abschaum arschloch scheiße widerlich").split()
#: Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself u ur thou du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os su".split()
STEMS = (4, 5, 6)
NEAR = 6
#: Substitutions undone: digit or sign to the letter it stands for.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_FOLD = scan.LOWER.copy()
_PLAIN = scan.LOWER.copy()
for _a, _b in SUBSTITUTES.items():
    _PLAIN[ord(_a)] = ord(_b)
_SIGNS = scan.byte_class((0x24, 0x24), (0x40, 0x40), (0x2A, 0x2A))
_LETTER = scan.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_DIGIT = scan.byte_class((0x30, 0x39))
_UPPER = scan.byte_class((0x41, 0x5A))
_PUNCT = scan.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_LEAD = ~scan.byte_class((0x80, 0xBF))  # first bytes of characters
_WORD = scan.ALNUM_LOWER
FEATURES = ["log_words", "learned_rate", "learned_log", "stem_rate", "stem_log", "fixed_rate", "fixed_log", "undone_log", "second_rate", "near_rate", "near_log", "upper_rate", "capital_words", "bangs", "questions", "punctuation", "digits", "obfuscated", "word_length", "distinct_hits"]


def _stem_hashes(s: scan.Scan, size: int) -> np.ndarray:
    """Hash of each word's first ``size`` bytes, 0 for shorter words."""
    long = s.end - s.start > size
    out = np.zeros(len(s.start), dtype=U)
    out[long] = s.hashes(s.start[long], s.start[long] + size) ^ U(size)
    return out


@dataclass
class Lexicon:
    learned: np.ndarray
    stems: np.ndarray

    def features(self, chunk: pa.Array) -> np.ndarray:
        """A row of FEATURES for each text of a chunk."""
        s = scan.Scan(chunk, word=_WORD, fold=_FOLD)
        h = s.words()
        n = np.diff(s.first).astype(float)
        some = np.maximum(n, 1)
        chars = np.maximum(s.count(_LEAD), 1)
        flag = lambda table: self._flag(table, h)
        learned, fixed, second = flag(self.learned), flag(_fixed()), flag(_second())
        stem = np.zeros(len(h), dtype=bool)
        table = scan.Lookup(self.stems)
        for size in STEMS:
            stem[table.find(_stem_hashes(s, size))[0]] = True
        hit = learned | fixed | stem
        # second-person word of the same text within NEAR words of a hit
        place = np.flatnonzero(second)
        at = np.flatnonzero(hit)
        near = np.zeros(len(h), dtype=bool)
        if len(place) and len(at):
            for side in (np.searchsorted(place, at) - 1, np.searchsorted(place, at)):
                ok = (side >= 0) & (side < len(place))
                p = place[np.clip(side, 0, len(place) - 1)]
                near[at[ok & (np.abs(p - at) <= NEAR) & (s.doc[p] == s.doc[at])]] = True
        upper = _UPPER[s.buf]
        letter = _LETTER[s.buf]
        odd = (_DIGIT | _SIGNS)[s.buf]
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        ups = total(upper)
        word_ups = ups[s.end] - ups[s.start]
        # a digit or sign between two letters
        between = np.zeros(len(s.buf), dtype=bool)
        between[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
        undone = np.zeros(s.n_docs)
        if between.any():
            touched = np.flatnonzero(s.sums(between) > 0)
            plain = scan.Scan(chunk.take(pa.array(touched)), word=_WORD, fold=_PLAIN)
            ph = plain.words()
            mark = self._flag(self.learned, ph) | self._flag(_fixed(), ph)
            for size in STEMS:
                mark[table.find(_stem_hashes(plain, size))[0]] = True
            undone[touched] = plain.word_sums(mark)
        sums = s.word_sums
        counts = {"learned": sums(learned), "stem": sums(stem), "fixed": sums(fixed), "near": sums(near), "hits": sums(hit)}
        undone = np.maximum(undone - counts["hits"], 0)
        distinct = np.zeros(s.n_docs)
        if len(at):
            pairs = np.unique(np.stack([s.doc[at].astype(U), h[at]], axis=1), axis=0)
            distinct = np.bincount(pairs[:, 0].astype(int), minlength=s.n_docs).astype(float)
        of = lambda c: s.count(scan.byte_class((ord(c), ord(c)))) / chars
        columns = [np.log1p(n), counts["learned"] / some, np.log1p(counts["learned"]), counts["stem"] / some, np.log1p(counts["stem"]), counts["fixed"] / some, np.log1p(counts["fixed"]), np.log1p(undone), sums(second) / some, counts["near"] / some, np.log1p(counts["near"]),
                   s.sums(upper) / chars, sums((word_ups > 1) & (word_ups == s.end - s.start)) / some, of("!"), of("?"), s.count(_PUNCT) / chars, s.count(_DIGIT) / chars, s.sums(between) / some, chars / some, np.log1p(distinct)]
        return np.stack(columns, axis=1)

    @staticmethod
    def _flag(table: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=bool)
        out[scan.Lookup(table).find(h)[0]] = True
        return out


_known: dict[str, np.ndarray] = {}


def _fixed() -> np.ndarray:
    if "fixed" not in _known:
        _known["fixed"] = np.array([scan.hash_of(w) for w in INSULTS], dtype=U)
    return _known["fixed"]


def _second() -> np.ndarray:
    if "second" not in _known:
        _known["second"] = np.array([scan.hash_of(w) for w in SECOND_PERSON], dtype=U)
    return _known["second"]


def learn_lexicon(texts: list[str], y: np.ndarray, size: int = 400) -> Lexicon:
    """Words and word beginnings that mark label 1: by lower bounds of their log-odds."""
    keys = {"word": [[], []], "stem": [[], []]}
    base = 0
    for chunk in scan.chunks(pa.array(texts, type=pa.string())):
        s = scan.Scan(chunk, word=_WORD, fold=_FOLD)
        label = y[base + s.doc].astype(int)
        doc = scan.mix((base + s.doc + 1).astype(U))
        base += s.n_docs
        for kind, h in [("word", s.words()), *(("stem", _stem_hashes(s, k)) for k in STEMS)]:
            once = np.unique(h ^ doc, return_index=True)[1]
            once = once[h[once] != 0]
            for v in (0, 1):
                keys[kind][v].append(h[once][label[once] == v])
    n1, n0 = y.sum(), (1 - y).sum()

    def best(kind: str) -> np.ndarray:
        bad, bad_n = np.unique(np.concatenate(keys[kind][1]) if keys[kind][1] else np.zeros(0, U), return_counts=True)
        good, good_n = np.unique(np.concatenate(keys[kind][0]) if keys[kind][0] else np.zeros(0, U), return_counts=True)
        place = np.minimum(np.searchsorted(good, bad), max(len(good) - 1, 0))
        other = np.where(good[place] == bad, good_n[place], 0) if len(good) else np.zeros(len(bad))
        odds = np.log((bad_n + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
        low = odds - 1.64 * np.sqrt(1 / (bad_n + 0.5) + 1 / (other + 0.5))
        keep = (bad_n >= 3) & (low > 1.0)
        order = np.argsort(-(low * np.sqrt(bad_n))[keep], kind="stable")[:size]
        return bad[keep][order]

    return Lexicon(best("word"), best("stem"))


@dataclass
class ToxicityModel:
    lexicon: Lexicon | None
    trees: Boosted | None
    calibrate: Isotonic | None
    constant: float = 0.0

    def score(self, chunk: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(chunk), self.constant)
        return self.calibrate(self.trees(self.lexicon.features(chunk)))


def fit_toxicity(rows: list[tuple[str, int]]) -> ToxicityModel:
    """A model from (text, label) pairs.

    The features of each third come from a lexicon of the other two, so that the
    trees see lexicons as they meet unseen texts; the calibration likewise sees
    out-of-fold log-odds.  The final lexicon and trees use all rows.
    """
    texts = [t for t, _ in rows]
    y = np.array([v for _, v in rows], dtype=float)
    constant = ToxicityModel(None, None, None, float(y.mean()) if len(y) else 0.0)
    if len(y) < 12 or y.min() == y.max():
        return constant
    part = np.zeros(len(y), dtype=int)
    for v in (0, 1):  # both labels in every part
        part[y == v] = np.arange((y == v).sum()) % 3
    if len(set(part[y == 1])) < 3 or len(set(part[y == 0])) < 3:
        return constant
    pick = lambda m: pa.array([texts[i] for i in np.flatnonzero(m)], type=pa.string())
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(3):
        lexicon = learn_lexicon(pick(part != k).to_pylist(), y[part != k])
        x[part == k] = np.concatenate([lexicon.features(c) for c in scan.chunks(pick(part == k))])
    out = np.zeros(len(y))
    for k in range(3):
        out[part == k] = Boosted(x[part != k], y[part != k])(x[part == k])
    return ToxicityModel(learn_lexicon(texts, y), Boosted(x, y), Isotonic(out, y))


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7, prefix: str = "") -> DataFrame:
    """df with score and predicted (1 at the threshold or above); clashing columns are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        ready = sent.value
        return lambda chunk: {"score": (p := ready.score(chunk)), "predicted": (p >= threshold).astype(np.int32)}

    return with_struct(df, text_udf("score double, predicted int", start)(F.col(f"`{text_col}`").cast("string")), ["score", "predicted"], prefix)


#: Labelled rows that a model is fitted on, at most.
ROWS = 5000
FOLDS, HELD = 3, 1


def fitted(documents: DataFrame, labels: DataFrame, rows: int = ROWS) -> ToxicityModel:
    """A model from the folds of ``labels`` that are not held out."""
    return fit_toxicity(labelled.sample(documents, labels, "toxic", FOLDS, HELD, rows))


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """df without the texts that score the threshold or above; its columns stay."""
    tag = "toxicity_of_" + "_".join(df.columns)[:120] + "_"
    return score_toxicity(df, model, text_col, threshold, prefix=tag).filter(F.col(f"`{tag}predicted`") == 0).select(*[F.col(f"`{c}`") for c in df.columns])
