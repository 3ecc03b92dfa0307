"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary,
estimated from labelled texts. A word's probability in a language is the sum over all
ways to cut it into pieces, found by the forward algorithm; a text's is the product
over its words (pieces never cross white space). Words are counted per batch, and each
distinct word runs through the forward algorithm once.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import held, parts, picked

CACHE = 300_000
CACHED_CHARS = 64
UNDETERMINED = "und"
_MARK = "▁"
_SCALE = 7.0  # nats added per letter while summing, so that long words stay in range
_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[dict[str, int], object]:
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=path)
    keep = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {sp.id_to_piece(i): i for i in keep}, sp


def words(text: str) -> list[str]:
    return text.lower().split()


class Scorer:
    """Word log-likelihoods under each language, with a bounded cache.

    A letter that no piece covers is spelled by bytes of one small probability that is
    the same in all languages, so it never decides.
    """

    def __init__(self, path: str, langs: list[str], log_p: np.ndarray, floor: float):
        self.ids, _ = _pieces(path)
        self.langs = langs
        self.longest = max(map(len, self.ids))
        width = np.zeros(len(log_p))
        for piece, i in self.ids.items():
            width[i] = len(piece)
        self.log_p = log_p
        self.p = np.exp(np.minimum(log_p + _SCALE * width[:, None], 600))
        self.floor = floor
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((CACHE, len(langs)))

    def _spelled(self, letter: str) -> float:
        return len(letter.encode("utf-8", "surrogatepass")) * self.floor

    def _long(self, word: str) -> np.ndarray:
        """The forward algorithm in logarithms, for words that would leave the range."""
        out = [np.zeros(len(self.langs))]
        for j in range(1, len(word) + 1):
            terms = [out[i - max(0, j - self.longest)] + self.log_p[k]
                     for i in range(max(0, j - self.longest), j) if (k := self.ids.get(word[i:j])) is not None]
            if word[j - 1] not in self.ids:
                terms.append(out[-1] + self._spelled(word[j - 1]))
            out = (out + [np.logaddexp.reduce(terms)])[-self.longest:]
        return out[-1]

    def _alike(self, group: list[str]) -> np.ndarray:
        """The forward algorithm over words of one length at once."""
        n, get = len(group[0]), self.ids.get
        a = np.zeros((n + 1, len(group), len(self.langs)))
        a[0] = 1
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                found = [get(w[i:j], -1) for w in group]
                ids = np.array(found)
                at = np.flatnonzero(ids >= 0)
                if len(at):
                    a[j, at] += a[i, at] * self.p[ids[at]]
                if i == j - 1 and len(at) < len(group):
                    rest = np.flatnonzero(ids < 0)
                    spelled = np.array([self._spelled(group[k][i]) for k in rest])
                    a[j, rest] += a[i, rest] * np.exp(spelled + _SCALE)[:, None]
        with np.errstate(divide="ignore"):
            return np.log(a[n]) - _SCALE * n

    def score_words(self, new: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language."""
        out = np.zeros((len(new), len(self.langs)))
        lengths: dict[int, list[int]] = {}
        for i, w in enumerate(new):
            lengths.setdefault(len(w), []).append(i)
        for n, at in lengths.items():
            for first in range(0, len(at), 4096):
                part = at[first:first + 4096]
                group = [_MARK + new[i] for i in part]
                out[part] = self._alike(group) if n <= CACHED_CHARS else [self._long(w) for w in group]
        weak = np.flatnonzero(~np.isfinite(out).all(axis=1))
        for i in weak:
            out[i] = self._long(_MARK + new[i])
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior (all languages equally likely before) for each text."""
        langs, scores = [], []
        for first in range(0, len(texts), 256):
            split = [words(t) if t is not None and _LETTER.search(t) else None for t in texts[first:first + 256]]
            seen = set().union(*(s for s in split if s))
            short = [w for w in seen if w not in self.cache and len(w) <= CACHED_CHARS]
            if len(self.cache) + len(short) > CACHE:
                self.cache.clear()
                short = [w for w in seen if len(w) <= CACHED_CHARS][:CACHE]
            base = len(self.cache)
            self.rows[base:base + len(short)] = self.score_words(short)
            self.cache.update(zip(short, range(base, base + len(short))))
            rest = [w for w in seen if w not in self.cache]
            other = dict(zip(rest, self.score_words(rest)))
            for s in split:
                if not s or not self.langs:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                ids = [self.cache.get(w, -1) for w in s] if other else list(map(self.cache.__getitem__, s))
                ids = np.array(ids)
                total = self.rows[ids[ids >= 0]].sum(axis=0)
                for w, i in zip(s, ids) if other else ():
                    if i < 0:
                        total = total + other[w]
                p = np.exp(total - total.max())
                best = int(p.argmax())
                langs.append(self.langs[best])
                scores.append(float(p[best] / p.sum()))
        return langs, scores


def is_held_out(id: Column) -> Column:
    return F.crc32(F.coalesce(id.cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, path: str, per_language: int = 400, smoothing: float = 0.05, id: str = "doc_id",
        text: str = "text", lang: str = "lang") -> dict:
    """Piece probabilities of each language, from labelled rows that are not held out.

    The sample is bounded: about ``per_language`` rows of each language, chosen by a hash of
    id and text (all of them where there are fewer). Pieces are counted on the vocabulary's own best
    segmentation and smoothed. Rows without a text or label teach nothing; without any
    labelled row the model has no language and every text is undetermined.
    """
    rows = picked(docs, doc_id=id, text=text, lang=lang)
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    ids, sp = _pieces(path)
    counts = np.zeros((sp.get_piece_size(), len(langs)))
    if langs:
        share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(per_language / sizes[k]))])
        chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

        def counted(batches):
            _, own = _pieces(path)
            for batch in parts(batches):
                seen = Counter()
                for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for part in own.encode([" ".join(words(text))], num_threads=1):
                        seen.update((label, i) for i in part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()),
                     pa.array(list(seen.values()), pa.int64())], names=["lang", "piece", "n"])

        sample = rows.where(chance < F.element_at(share, F.col("lang"))).select("text", "lang")
        found = (sample.mapInArrow(counted, "lang string, piece int, n long")
                 .groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect())  # at most languages x vocabulary
        at = {k: i for i, k in enumerate(langs)}
        for r in found:
            counts[r["piece"], at[r["lang"]]] += r["n"]
    known = np.zeros(len(counts), bool)
    known[list(ids.values())] = True
    counts[~known] = 0
    total = counts.sum(axis=0) + smoothing * known.sum()
    log_p = np.where(known[:, None], np.log((counts + smoothing) / total), -np.inf)
    floor = float(np.log(smoothing) - np.log(total).max()) if langs else 0.0
    return {"path": path, "langs": langs, "log_p": log_p, "floor": floor}


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which depend on the text alone.

    A null text, or one without a letter, is ``und`` with score 0. Rows keep their other
    columns as they are; columns named ``lang_pred`` or ``score`` are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages doubles
    key = f"language {id(sent)}-{docs.sparkSession.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 62)}"
    place = docs.columns.index(text)

    def scored(batches):
        own = held(key, lambda: Scorer(**sent.value))
        for batch in parts(batches):
            langs, scores = own.score(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType
    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(scored, schema)


def identify(docs: DataFrame, path: str, per_language: int = 400, id: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: a model fitted on ``docs`` and applied to all of them.

    Null ids are learned from as the empty id; repeated rows and ids are scored one by one.
    """
    model = fit(docs, path, per_language, id=id, text=text, lang=lang)
    rows = picked(docs, doc_id=id, text=text).withColumn("held_out", is_held_out(F.col("doc_id")))
    out = predict(rows, model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
