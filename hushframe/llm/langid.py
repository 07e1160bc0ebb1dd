"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays.

A model covers words with a mark at both ends, lower-cased, contexts not reaching over a word's start; so a word's
log-probability depends on the word alone, and the words of a text can be counted before they are scored. Each language
is fitted by a task of its own and keeps only its own n-grams: a sorted array of 64-bit hashes per order, with a
log-probability and a back-off weight beside each. The language with the lowest cross-entropy per character wins; its
score is calibrated on texts held back from training. `rejected` marks texts that no learned language explains: the bound
on their cross-entropy is set where texts judged by their own language's model are best told apart from the same texts
judged by all others, as a text of an unknown language would be.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import BROADCAST_BYTES, checkpoint, mix64, release

#: Bounds of the labelled sample a model is fitted on: texts a language, and characters of all its texts (one text at least).
MAX_DOCS, MAX_CHARS = 600, 8_000_000
ORDER = 5
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[str]) -> np.ndarray:
    """Mixed values of the code points of joined texts."""
    return mix64(np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1))


def gram_hashes(grams: list[str], n: int) -> np.ndarray:
    """64-bit hashes of strings of n characters each."""
    codes = _codes(grams).reshape(-1, n)
    h = np.zeros(len(codes), np.uint64)
    for j in range(n):
        h = h * _STEP + codes[:, j]
    return mix64(h + np.uint64(n))


@dataclass
class Model:
    langs: list[str]
    order: int
    hashes: list[np.ndarray]  # per order, sorted
    logp: list[np.ndarray]  # per order, (n-grams, languages)
    backoff: list[np.ndarray]  # per order, log weight when it is a context
    unseen: np.ndarray  # log-probability of a character seen in no language

    def _rows(self, n: int, h: np.ndarray) -> np.ndarray:
        """Rows of n-grams by hash, -1 where there is none."""
        own = self.hashes[n - 1]
        if not len(own):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(own, h), len(own) - 1)
        return np.where(own[i] == h, i, -1)

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word's characters and end, for each language: (words, languages)."""
        marked = [f"\x02{w}\x03" for w in words]
        lengths = np.array([len(w) for w in marked])
        codes, begin = _codes(marked), np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(begin, lengths)
        raw, last, power = [codes], codes, 1
        for _ in range(1, self.order):  # value of the last n characters from that of the last n-1
            power = power * int(_STEP) & 0xFFFFFFFFFFFFFFFF
            longer = last.copy()
            longer[len(raw) :] += codes[: max(0, len(codes) - len(raw))] * np.uint64(power)
            raw.append(longer)
            last = longer
        out = np.zeros((len(codes), len(self.langs)))
        open_ = np.flatnonzero(place > 0)  # the mark at the start isn't predicted
        for n in range(self.order, 0, -1):
            fit = place[open_] + 1 >= n
            at = open_[fit]
            if len(at):
                rows = self._rows(n, mix64(raw[n - 1][at] + np.uint64(n)))
                hit = rows >= 0
                out[at[hit]] += self.logp[n - 1][rows[hit]]
                miss = at[~hit]
                if n > 1 and len(miss):
                    rows = self._rows(n - 1, mix64(raw[n - 2][miss - 1] + np.uint64(n - 1)))
                    out[miss[rows >= 0]] += self.backoff[n - 2][rows[rows >= 0]]
                elif len(miss):
                    out[miss] += self.unseen
                open_ = np.concatenate([open_[~fit], miss])
        return np.add.reduceat(out, begin, axis=0) if len(words) else np.zeros((0, len(self.langs)))


@dataclass
class Models:
    """Models of languages side by side."""

    parts: list[Model]
    ceiling: float = math.inf  # cross-entropy in nats a character above which a text is rejected
    slope: float = 1.0  # of the score's logistic curve

    @property
    def langs(self) -> list[str]:
        return [lang for m in self.parts for lang in m.langs]

    def words(self, words: list[str]) -> np.ndarray:
        return np.concatenate([m.words(words) for m in self.parts], axis=1)


def kneser_ney(grams: dict[str, dict[str, int]], order: int, discount: float = 0.75, characters: int | None = None) -> Model:
    """A model from counts of n-grams up to `order` of each language: lang -> gram -> count.

    characters: size of the alphabet if other groups of languages add to it; by default that of `grams`. A language's
    probabilities don't depend on the others in its group: where it lacks an n-gram, it backs off. The highest order (and grams from a word's start) uses counts, the lower ones the number of different characters before.
    """
    langs = sorted(grams)
    effective: list[dict[str, Counter]] = []
    for lang in langs:
        counts: dict[str, Counter] = {}
        before: Counter = Counter()
        for g, c in grams[lang].items():
            if len(g) > 1:
                before[g[1:]] += 1
        for g, c in grams[lang].items():
            if g != "\x02":
                counts.setdefault(g[:-1], Counter())[g[-1]] = c if len(g) == order or g[0] == "\x02" else max(before[g], 1)
        effective.append(counts)
    if characters is None:
        characters = len({g[-1] for counts in grams.values() for g in counts if g != "\x02"})
    uniform = 1.0 / (characters + 1)
    everything = sorted({g for counts in grams.values() for g in counts}, key=len)
    probability = [dict() for _ in langs]
    weights = [{} for _ in langs]
    for i, counts in enumerate(effective):
        for context, nexts in counts.items():
            weights[i][context] = discount * len(nexts) / sum(nexts.values())
    for g in everything:
        if g == "\x02":
            continue
        for i, counts in enumerate(effective):
            context, c = g[:-1], g[-1]
            lower = probability[i][g[1:]] if len(g) > 1 and g[1:] in probability[i] else uniform
            nexts = counts.get(context)
            if nexts is None:
                probability[i][g] = lower
            else:
                total = sum(nexts.values())
                probability[i][g] = max(nexts.get(c, 0) - discount, 0) / total + weights[i][context] * lower
    hashes, logp, backoff = [], [], []
    for n in range(1, order + 1):
        own = [g for g in everything if len(g) == n]
        h = gram_hashes(own, n)
        order_ = np.argsort(h)
        hashes.append(h[order_])
        own = [own[i] for i in order_.tolist()]
        logp.append(np.log([[max(p.get(g, uniform), 1e-12) for p in probability] for g in own]).reshape(len(own), len(langs)))
        backoff.append(np.log([[w.get(g, 1.0) for w in weights] for g in own]).reshape(len(own), len(langs)))
    base = [math.log(uniform * w.get("", 1.0)) for w in weights]
    return Model(langs, order, hashes, logp, backoff, np.array(base))


def grams_of(word: str, order: int) -> Iterator[str]:
    text = f"\x02{word}\x03"
    for i in range(len(text)):
        for n in range(1, min(order, i + 1) + 1):
            yield text[i + 1 - n : i + 1]


def labelled_sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, seed: int = 3) -> DataFrame:
    """Different texts of each label of docs(text, lang): the first by a hash, up to max_docs and max_chars (whole texts, one at least).

    calibrates: a fifth of them, by another hash; none of a label whose texts would all be in it, so that every label is learned.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    marked = rows.withColumn("h", F.xxhash64("text", F.lit(seed))).withColumn("half", F.xxhash64("text", F.lit(seed + 1)))
    keys = checkpoint(marked.groupBy("lang", "h", "half").agg(F.max(F.length("text")).alias("chars")))
    # Hashes are spread evenly: the lowest share of a label's that holds four times the texts wanted is all that has to be ranked.
    counts = checkpoint(keys.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.least(F.lit(1.0), F.lit(4.0 * max_docs) / F.col("n"))
    low = (F.col("n") <= 8 * max_docs) | (F.col("h").cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * share)
    first = Window.partitionBy("lang").orderBy("h", "half")
    ranked = keys.join(counts, "lang").filter(low).withColumn("k", F.row_number().over(first)).withColumn("upto", F.sum("chars").over(first.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.filter((F.col("k") <= max_docs) & ((F.col("k") == 1) | (F.col("upto") <= max_chars)))
    fifth = F.pmod("half", F.lit(5)) == 0
    kept = kept.withColumn("calibrates", fifth & ~F.min(fifth).over(Window.partitionBy("lang")))
    kept = checkpoint(kept.select("lang", "h", "half", "calibrates"))
    release(keys, counts)
    # At most max_docs keys a label, so texts needn't be shuffled to find the few that are kept unless labels are very many.
    picked = F.broadcast(kept) if kept.count() * 64 <= BROADCAST_BYTES else kept
    return checkpoint(marked.join(picked, ["lang", "h", "half"]).dropDuplicates(["lang", "h", "half"]))


def fit(docs: DataFrame, order: int = ORDER, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, seed: int = 3) -> Models:
    """Fit on a bounded sample of docs(text, lang): see `labelled_sample`. All n-grams of the sample are kept, and every label is learned.

    Rows with a null text or label teach nothing; repeated texts of a label teach once. A label's model takes 24 bytes an
    n-gram, at most some ten MB by the bound of its sample; the driver gathers the models, so their total grows with the
    number of labels, not with the rows. Without any labelled row (an empty table, null labels) the model knows no language.
    """
    rows = labelled_sample(docs, max_docs, max_chars, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(w.lower() for w in WORD.findall(text))
        for lang, words in found.items():
            grams: Counter = Counter()
            for word, n in words.items():
                for g in grams_of(word, order):
                    grams[g] += n
            items = list(grams.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([g for g, _ in part]), pa.array([c for _, c in part], pa.int64())], names=["lang", "gram", "n"])

    counted = rows.filter("not calibrates").select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = checkpoint(counted)
    characters = counted.filter(F.col("gram") != "\x02").select(F.right("gram", F.lit(1))).distinct().count()

    def train(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        model = kneser_ney({lang: dict(zip(table["gram"].to_pylist(), table["n"].to_pylist(), strict=True))}, order, characters=characters)
        arrays = [pa.array([[x.tobytes() for x in part]], pa.list_(pa.binary())) for part in (model.hashes, model.logp, model.backoff)]
        return pa.table([pa.array([lang]), *arrays, pa.array([float(model.unseen[0])])], names=["lang", "hashes", "logp", "backoff", "unseen"])

    trained = counted.groupBy("lang").applyInArrow(train, "lang string, hashes array<binary>, logp array<binary>, backoff array<binary>, unseen double")
    array = lambda x, kind: np.frombuffer(x, kind) if x else np.zeros(0, kind)
    column = lambda parts: [array(x, np.float64).reshape(-1, 1) for x in parts]
    parts = []
    for r in sorted(trained.collect(), key=lambda r: r.lang):  # a row per label, bounded by its sample
        parts.append(Model([r.lang], order, [array(x, np.uint64) for x in r.hashes], column(r.logp), column(r.backoff), np.array([r.unseen])))
    if not parts:
        release(rows, counted)
        return Models([])
    model = Models(parts)
    judged = score_texts(rows.filter("calibrates").select(F.lit(0).cast("long").alias("doc_id"), "text", "lang"), model).filter(F.col("lang_pred") != UNKNOWN)
    pairs = [(r.entropy, r.margin, r.lang_pred == r.lang) for r in judged.select("entropy", "margin", "lang_pred", "lang").collect()]  # at most max_docs rows a label
    release(rows, counted)
    return calibrate(model, pairs)


def calibrate(model: Models, pairs: list[tuple[float, float, bool]]) -> Models:
    """Set slope and ceiling from texts held back: (lowest cross-entropy, margin to the second lowest, whether it is the right language).

    slope: of the score, by likelihood. ceiling: a text's lowest cross-entropy is what its own language gives, the second
    lowest what it would have if that language weren't known; the bound is the one with the fewest errors on both, in the
    middle of the gap if there is one.
    """
    if not pairs:
        return model
    entropy, margin, right = (np.array(x) for x in zip(*pairs, strict=True))

    def loss(slope: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * margin, -50, 50))), 1e-9, 1 - 1e-9)
        return float(-(np.log(p[right]).sum() + np.log(1 - p[~right]).sum()))

    model.slope = min((2.0**k for k in range(-3, 9)), key=loss)
    own = np.sort(entropy[right])
    if not len(own):
        return model
    if len(model.parts) == 1:  # nothing to compare with: what is as far above the median as ten times the usual spread
        model.ceiling = float(np.median(own) + 10 * (np.median(np.abs(own - np.median(own))) + 0.1))
        return model
    others = np.sort((entropy + margin)[right])
    cuts = np.unique(np.concatenate([own, others]))
    wrong = (len(own) - np.searchsorted(own, cuts, "right")) / len(own) + np.searchsorted(others, cuts, "right") / len(others)
    best = int(np.argmin(wrong))
    model.ceiling = float((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2)
    return model


def score_texts(docs: DataFrame, model: Models) -> DataFrame:
    """docs(doc_id, text, ...) without text, with lang_pred, score (0 to 1), entropy (nats a character), margin (to the second best) and rejected.

    A model that knows no language calls every text `und`, with score 0, and rejects it.
    """
    if not model.parts:
        zero = F.lit(0.0)
        found = (F.lit(UNKNOWN).alias("lang_pred"), zero.alias("score"), zero.alias("entropy"), zero.alias("margin"), F.lit(True).alias("rejected"))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *docs.columns[2:], *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        langs = model.langs
        table, lengths = np.zeros((0, len(langs))), np.zeros(0)
        # With many languages, fewer texts at once and fewer words in the cache.
        step, cache = max(1, min(256, 2048 // len(langs))), _CACHE * 4 // max(4, len(langs))

        def judge(rows: list[int]) -> tuple:
            size = lengths[rows].sum() if rows else 0.0
            if not size:
                return UNKNOWN, 0.0, 0.0, 0.0, True
            entropy = -table[rows].sum(axis=0) / size
            order = np.argsort(entropy, kind="stable")
            margin = float(entropy[order[1]] - entropy[order[0]]) if len(order) > 1 else 0.0
            return langs[order[0]], 1 / (1 + math.exp(-min(model.slope * margin, 50.0))), float(entropy[order[0]]), margin, bool(entropy[order[0]] > model.ceiling)

        for whole in batches:
            for first in range(0, len(whole), step):
                batch = whole.slice(first, step)
                if len(place) > cache:
                    place, table, lengths = {}, table[:0], lengths[:0]
                texts, new = [], []
                for value in batch.column(1):
                    rows = []
                    for w in WORD.findall((value.as_py() or "").lower()):
                        i = place.get(w)
                        if i is None:
                            i = place[w] = len(place)
                            new.append(w)
                        rows.append(i)
                    texts.append(rows)
                if new:
                    table = np.concatenate([table, model.words(new)])
                    lengths = np.concatenate([lengths, [len(w) + 1.0 if any(map(str.isalpha, w)) else 0.0 for w in new]])
                out = [judge(rows) for rows in texts]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *batch.schema.names[2:], "lang_pred", "score", "entropy", "margin", "rejected"])

    rest = "".join(f", `{c}` {t}" for c, t in docs.dtypes[2:])
    return docs.mapInArrow(run, f"doc_id long{rest}, lang_pred string, score double, entropy double, margin double, rejected boolean")


def predict(docs: DataFrame, model: Models) -> DataFrame:
    """The language of each whole text: (doc_id, lang_pred, score, entropy, margin, rejected), a row per row of docs.

    lang_pred is a learned label, or `und` with score 0 if the text is null or has no letter. rejected: no learned language
    explains the text. Nothing but the text is read, other columns are ignored, doc_id may be null, and texts go as a whole.
    Ties go to the label first in order; repeated rows are judged alike; an empty table gives no rows.
    """
    return score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
