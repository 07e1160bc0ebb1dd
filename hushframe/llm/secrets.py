"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns find secrets by their surroundings or form. The models find the rest: long tokens whose character transitions
are likelier under a model of random strings than under one of ordinary identifiers; where a token as a whole isn't, parts of it
may be, so a key is found behind a path or a name as well. Both models are order-2 chains,
interpolated with the shorter contexts, trained from labelled samples; the default sample is made by a fixed rule (see `sample`), so no secret
has to be stored here, and a table of labelled strings may be given instead.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
# Letters of the keyword in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What may be a random secret: any long token; the models decide.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What parts of a path, a name or an assignment stand between.
SEPARATOR = re.compile(r"[/=_-]")
#: Least characters of a secret; nats above the threshold that a part of a token must gain, and that its ends may lose to reach a separator.
LEAST, GAIN, EDGE = 16, 8.0, 6.0
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Parts of ordinary identifiers from which the default sample is made.
PARTS = (
    "user name time date value index count list item data file path size type node text line word page link html http www com org "
    "get set add new old max min sum avg first last next prev start end begin stop open close read write load save send receive "
    "error warning info debug trace config option setting default custom public private static final abstract class function method "
    "table column row query select insert update delete join group order limit offset where from into database schema "
    "server client request response session cookie header body status code message event handler callback promise async await "
    "image video audio document folder archive backup version release build test unit mock sample example "
    "the and of to in that with information international communication development environment "
    "und der die das nicht eine gesellschaft verantwortung entwicklung möglichkeit "
    "les des pour dans avec sur tion ment développement environnement "
    "los las para con por ción mente desarrollo comunicación"
).split()
#: Parts of syllables, of which the sample's long words are made: what words of several languages begin, go on and end with.
ONSETS = ["", *"bl br ch cl cr dr fl fr gl gr h j k kl kn kr pf ph pl pr qu rh sc sch sh sk sl sp str sw th tr v w wh y z zw".split(), *"b c d f g h l m n p r s t v w st".split() * 6]
NUCLEI = "y ai au ea eau ee ei eu ia ie io oa oi oo ou ue ui".split() + "a e i o u e".split() * 9
CODAS = "b c ch ck ct d f ff g gh k ld ll ls lt m mp nd ng ns nt p pf rd rm rn rs rt sch sh ss st t th ts tt tz x z".split() + "l n r s t".split() * 7 + [""] * 70
#: Sizes of the default sample: strings of each label.
SAMPLE = 4000
ORDER, SYMBOLS = 2, 68
_ALPHABETS = ("0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

_RULERS = "=-_/+" * 8 + "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sample(n: int = SAMPLE, seed: int = 5) -> list[tuple[str, bool]]:
    """n random strings (True) and n others (False), by rule.

    Letters drawn evenly from an alphabet; joined PARTS, words of 4 to 14 syllables in three cases, one character repeated, and
    what identifies things without being secret: UUIDs, short hashes of commits, dates with times, and numbers with separators.
    """
    dice, out = random.Random(seed), []
    for _ in range(n):
        out.append(("".join(dice.choices(dice.choice(_ALPHABETS), k=dice.randint(20, 48))), True))
        kind = dice.random()
        if kind < 0.02:
            out.append((dice.choice(_RULERS) * dice.randint(16, 80), False))
            continue
        if kind < 0.07:
            out.append((_public_id(dice), False))
            continue
        if kind < 0.15:
            word = "".join(dice.choice(ONSETS) + dice.choice(NUCLEI) + dice.choice(CODAS) for _ in range(dice.randint(4, 14)))
            out.append((dice.choice((str, str, str.title, str.upper))(word), False))
            continue
        parts = [dice.choice(PARTS) for _ in range(dice.randint(2, 6))]
        style = dice.randrange(6)
        if style == 0:
            text = "_".join(parts)
        elif style == 1:
            text = "-".join(parts)
        elif style == 2:
            text = "".join(p.title() for p in parts)
        elif style == 3:
            text = "_".join(parts).upper()
        elif style == 4:
            text = "/".join(parts)
        else:
            text = "".join(parts)
        if dice.random() < 0.4:
            text += dice.choice(("", "_", "-", "/")) + str(dice.choice((dice.randrange(10), dice.randrange(1900, 2100), dice.randrange(10**6))))
        out.append((text, False))
    return out


def _public_id(dice: random.Random) -> str:
    hexa = lambda n: "".join(dice.choices("0123456789abcdef", k=n))
    case = dice.choice((str, str, str.upper))
    match dice.randrange(4):
        case 0 | 1:
            return case("-".join(map(hexa, (8, 4, 4, 4, 12))))
        case 2:
            return f"20{dice.randrange(100):02d}-{dice.randint(1, 12):02d}-{dice.randint(1, 28):02d}T{dice.randrange(24):02d}-{dice.randrange(60):02d}-{dice.randrange(60):02d}"
        case _:
            return dice.choice("-_/").join(str(dice.randrange(10 ** dice.randint(2, 6))) for _ in range(dice.randint(4, 7)))


def _class_table() -> np.ndarray:
    """Code of each byte: digits, letters of both cases, the five symbols of tokens, and one for all else."""
    codes = np.full(256, SYMBOLS - 1, np.int64)
    for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"):
        codes[ord(c)] = i
    return codes


CODES = _class_table()


class Models:
    """Log-likelihood ratio per transition, random over identifier."""

    def __init__(self, ratio: np.ndarray):
        self.ratio = ratio

    @classmethod
    def train(cls, labelled: Iterable[tuple[str, bool]]) -> Models:
        counts = np.full((2, SYMBOLS, SYMBOLS, SYMBOLS), 0.0)
        for text, is_random in labelled:
            c = CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
            np.add.at(counts[int(is_random)], (c[:-2], c[1:-1], c[2:]), 1)
        # Interpolated with the shorter context, so that an unseen pair of characters is judged by one.
        logs = []
        for n in counts:
            one = n.sum(axis=(0, 1)) + 0.5
            p1 = one / one.sum()
            two = n.sum(axis=0) + 4 * p1[None]
            p2 = two / two.sum(axis=1, keepdims=True)
            three = n + 4 * p2[None]
            logs.append(np.log(three / three.sum(axis=2, keepdims=True)))
        return cls((logs[1] - logs[0]).astype(np.float64))

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio per transition, in nats; above 0 the token looks random."""
        c = CODES[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean()) if len(c) > 2 else 0.0


_default: list[Models] = []


def default_models() -> Models:
    if not _default:
        _default.append(Models.train(sample()))
    return _default[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the patterns' matches, by start, then kind; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def stretches(gains: list[float]) -> list[tuple[int, int]]:
    """All maximal stretches of positive sum, apart and in order: none can be lengthened or shortened to a larger sum, in linear time.

    A stretch is kept with the sum before it, the sum at its end, and the number of the nearest stretch before it that begins lower.
    """
    kept: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for k, gain in enumerate(gains):
        before, total = total, total + gain
        if gain <= 0:
            continue
        start, low = k, before
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((start, k + 1, low, total, j))
                break
            start, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(s, e) for s, e, *_ in kept]


def windows(token: str, models: Models, threshold: float, least: int = LEAST) -> list[tuple[int, int]]:
    """Parts of a token, of `least` characters or more, that the models call random while the whole may be ordinary: (start, end).

    A part is a stretch whose transitions exceed the threshold most, its ends moved to a separator before or behind if that
    is likelier: a key after a path or a name, or between two of them.
    """
    c = CODES[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
    gains = models.ratio[c[:-2], c[1:-1], c[2:]] - threshold
    upto = np.concatenate([[0.0], np.cumsum(gains)])
    cuts = [-1, *(m.start() for m in SEPARATOR.finditer(token)), len(token)]
    out: list[tuple[int, int]] = []
    for first, last in stretches(gains.tolist()):
        start, end = first, last + 2  # a transition spans three characters
        if end - start < least // 2 or upto[last] - upto[first] < GAIN:
            continue
        i, j = bisect_left(cuts, start), bisect_left(cuts, end)
        starts = {start, cuts[i - 1] + 1, min(cuts[i] + 1, end)}
        ends = {end, cuts[min(j, len(cuts) - 1)], max(cuts[j - 1], start)}
        fits = [(float(upto[e - 2] - upto[s]), s, e) for s in starts for e in ends if e - s >= least and upto[e - 2] > upto[s]]
        if fits:
            # Between like gains the longer part: what stands between separators is one thing.
            best = max(fits)[0]
            _, s, e = max((f for f in fits if f[0] >= best - EDGE), key=lambda f: (f[2] - f[1], f[0]))
            if not out or s >= out[-1][1]:
                out.append((s, e))
    return out


def model_spans(text: str, base: list[tuple[int, int, int]], models: Models, threshold: float) -> list[tuple[int, int, int]]:
    """Tokens, or parts of them, that the models call random and that touch no base span."""
    out = []
    for m in TOKEN.finditer(text):
        token, at = m.group(), m.start()
        parts = [(0, len(token))] if models.score(token) > threshold else windows(token, models, threshold)
        out += [(at + s, 3, at + e) for s, e in parts if not any(b < at + e and at + s < f for b, _, f in base)]
    return out


def scan(docs: DataFrame, models: Models | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in each text: (doc_id, spans array<struct<kind, start, end, base, secret>>), a row per row of docs.

    Spans are ordered by start, then kind as in KINDS; offsets are code points, end exclusive; base tells the patterns'
    spans from the models'. A null text counts as empty and has no spans. Repeated rows are scanned alike, texts of any
    length whole, and other columns are ignored. threshold: nats per character above which a token counts as random.
    """
    models = models or default_models()
    ratio = models.ratio.astype(np.float32)  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Models(ratio)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("secret", pa.string())]))
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                spans = sorted(base + model_spans(text, base, here, threshold))
                out.append([{"kind": KINDS[k], "start": s, "end": e, "base": k < 3, "secret": text[s:e]} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean,secret:string>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
