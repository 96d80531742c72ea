"""Operator 6: toxicity of texts that may hide their words.

A token with digits or signs among its letters, with letters thrice in a row, or spelled with gaps is read as the output of
a noisy channel. Its characters span a lattice: a sign may stand for letters that look like it, a repeated letter or a
separator for nothing. Viterbi decoding under a character trigram model, counted over all documents, gives the most likely
word, which is scored in the token's place along with the token's own letters.

The classifier is a logistic regression on words and their beginnings, learned from labelled rows that aren't held out. Its
sample is bounded by `most_toxic` and `most_clean` rows (the first by a hash of the id); its prior comes from all labels.
No other number is bounded.

Cases: a null or empty text has the score of a text without evidence; where the labels, or the labelled documents of the
table, aren't of both kinds, no word has a weight and all scores are the share of toxic labels (0 without labels); several labels of an id count as toxic if one is; repeated rows and null ids are scored
each; texts of any length are scored whole; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.byte_bpe import packed
from daybook.llm.common import id_and_text, small_batches, summed

# Letters of the character model beside a-z; all others share one code.
ACCENTED = "àâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿßışğ"
LETTERS = "\0abcdefghijklmnopqrstuvwxyz" + ACCENTED
CODES = 64
OTHER_LETTER = CODES - 1
# What signs may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou", "(": "c", "¡": "i"}
SEPARATORS = ".-_*~ \t"

KEEP, READ, DROP_REPEAT, DROP_SEPARATOR = log(0.9), log(0.3), log(0.25), log(0.6)
LETTER = re.compile(r"[^\W\d_]+")
SIGNS = "".join(map(re.escape, LOOKS_LIKE))
HIDDEN = re.compile(rf"[^\W\d_][{SIGNS}]+[^\W\d_]|^[{SIGNS}][^\W\d_]{{2}}|([^\W\d_])\1\1|^[^\W\d_](?:[.\-_*~][^\W\d_]){{2,}}$|[^\W\d_]{{2}}[{re.escape('013457@$')}]$")
SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]{1,3}){3,}\S(?!\S)")


def _code_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    points = np.arange(0x250)
    table[points] = [OTHER_LETTER if chr(p).isalpha() else 0 for p in points]
    table[0x250:] = OTHER_LETTER
    for k, c in enumerate(LETTERS):
        table[ord(c)] = k
        if len(c.upper()) == 1:
            table[ord(c.upper())] = k
    table[0x2000:0x3004] = 0
    return table


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams of all texts, CODES^3 numbers; a text's start and end are boundaries."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table, out = _code_table(), np.zeros(CODES**3, np.int64)
        for batch in batches:
            for _, _, data, bounds in packed(batch.column("text")):
                edges = bounds.tolist()
                text = b"\n\n".join(data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))
                codes = np.concatenate([[0, 0], table[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)], [0, 0]]).astype(np.int64)
                out += np.bincount((codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:], minlength=CODES**3)
        return out

    return summed(docs.select("text"), count, CODES**3)


class CharacterModel:
    """Trigram probabilities, smoothed with bigrams and single characters."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(CODES, CODES, CODES).astype(np.float64)
        three[0, 0, 0] = 0
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + CODES)
        p2 = (two + 4 * p1[None, :]) / (two.sum(axis=1, keepdims=True) + 4)
        p3 = (three + 4 * p2[None, :, :]) / (three.sum(axis=2, keepdims=True) + 4)
        self.log3 = np.log(p3).astype(np.float32)
        self.code = {c: k for k, c in enumerate(LETTERS)}

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """What each character may have been, with the channel's log probability."""
        out = []
        runs = [(c, len(list(g))) for c, g in groupby(token)]
        for c, n in runs:
            for i in range(n):
                ways = []
                if c.isalpha():
                    ways.append((c, KEEP))
                    if i and n > 2:
                        ways.append(("", DROP_REPEAT))
                else:
                    ways += [(x, READ - log(len(LOOKS_LIKE[c]))) for x in LOOKS_LIKE.get(c, "")]
                    if c in SEPARATORS or not ways or (i and n > 1):
                        ways.append(("", DROP_SEPARATOR))
                out.append(ways)
        return out

    def decode(self, token: str) -> str:
        """The most likely word behind a token, by Viterbi over pairs of last letters."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for ways in self.lattice(token):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (p, q), (score, path) in best.items():
                for c, cost in ways:
                    if c:
                        k = self.code.get(c, OTHER_LETTER)
                        state, value, way = (q, k), score + cost + float(self.log3[p, q, k]), (c, path)
                    else:
                        state, value, way = (p, q), score + cost, path
                    if state not in new or value > new[state][0]:
                        new[state] = (value, way)
            best = new
        _, path = max(((s + float(self.log3[p, q, 0]), w) for (p, q), (s, w) in best.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))


class Restorer(dict):
    """The words of a token, its own and restored ones; keeps what it has worked out, `most` tokens at a time."""

    def __init__(self, model: CharacterModel, most: int = 200_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = tuple(LETTER.findall(token))
        if words and HIDDEN.search(token):
            restored = self.model.decode(token.strip(".,;:?'\"()[]{}<>#%&=/\\~-_"))
            if restored and restored not in words:
                words = (*words, restored)
        if len(self) >= self.most:
            self.clear()
        if len(token) <= 64:
            self[token] = words
        return words

    def tokens(self, text: str) -> set[str]:
        """Distinct lower-case tokens, and words spelled out letter by letter."""
        text = text.lower()
        out = set(text.split())
        for m in SPELLED.finditer(text):
            out.add("-".join(m.group().split()))
        return out

    def restore(self, text: str) -> str:
        """The text with hidden words in clear."""
        text = SPELLED.sub(lambda m: "-".join(m.group().split()), text.lower())
        return re.sub(r"\S+", lambda m: self[m.group()][-1] if HIDDEN.search(m.group()) and self[m.group()] else m.group(), text)


def features(word: str) -> list[str]:
    """The word and its beginnings of 3 to 10 letters."""
    return [word, *(f"{word[:k]}~" for k in range(3, min(10, len(word) - 1) + 1))]


@dataclass
class Model:
    """weights: of words and beginnings; a text's score is the logistic of bias and the weights that its words have."""

    characters: np.ndarray
    bias: float
    weights: dict[str, float] = field(default_factory=dict)


def logistic(x: float) -> float:
    return 1 / (1 + exp(-x)) if x >= 0 else exp(x) / (1 + exp(x))


def _fit(rows: np.ndarray, columns: np.ndarray, label: np.ndarray, width: int, rounds: int = 400, penalty: float = 1e-4) -> tuple[float, np.ndarray]:
    """Logistic regression by accelerated gradient steps. rows, columns: where the present features stand."""
    n = len(label)
    step = 4.0 / (1 + np.bincount(rows, minlength=n).max(initial=0))
    w, bias = np.zeros(width), 0.0
    v, c = w.copy(), bias
    for t in range(rounds):
        margin = c + np.bincount(rows, weights=v[columns], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label
        new = v - step * 8 * (np.bincount(columns, weights=error[rows], minlength=width) / n + penalty * v)
        fresh = c - step * 8 * error.mean()
        pull = t / (t + 3)
        v, c = new + pull * (new - w), fresh + pull * (fresh - bias)
        w, bias = new, fresh
    return bias, w


def train(docs: DataFrame, labels: DataFrame, held_out=None, most_toxic: int = 3000, most_clean: int = 6000) -> Model:
    """labels: doc_id, toxic. held_out: a condition on doc_id; such rows are never read. Labelled rows are sampled up to
    most_toxic and most_clean; all features of the sample take part that three of its toxic texts have."""
    docs = id_and_text(docs)
    spark = docs.sparkSession
    characters = count_trigrams(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if held_out is not None:
        known = known.where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    ones, zeros = total.get(1, 0), total.get(0, 0)
    odds = log((ones + 1e-6) / (zeros + 1e-6)) if ones and zeros else (20.0 if ones else -20.0)
    if not ones or not zeros:
        return Model(characters, odds)
    spread = F.xxhash64("doc_id", F.lit(6))
    sample = known.where("toxic = 1").orderBy(spread, "doc_id").limit(most_toxic).union(known.where("toxic = 0").orderBy(spread, "doc_id").limit(most_clean))
    sample = spark.createDataFrame(sample.collect(), "doc_id long, toxic int")  # bounded by the two limits
    rows = docs.join(F.broadcast(sample), "doc_id")
    model = spark.sparkContext.broadcast(characters)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, set[str]]]:
        restorer = Restorer(CharacterModel(model.value))
        for batch in batches:
            for doc, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                yield doc, toxic, {f for t in restorer.tokens(text or "") for w in restorer[t] for f in features(w)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for _, _, found in words_of(batches):
            counts.update(found)
        for part in ([*counts.items()][i : i + 50_000] for i in range(0, len(counts), 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["feature", "n"])

    frequent = rows.where("toxic = 1").select("doc_id", "toxic", "text").mapInArrow(counted, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).where("n >= 3")
    candidates = {f: k for k, f in enumerate(sorted(frequent.select("feature").toArrow().column(0).to_pylist()))}  # of the bounded sample only
    shared = spark.sparkContext.broadcast(candidates)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for doc, toxic, found in words_of(batches):
            own = sorted(index[f] for f in found if f in index)
            yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([toxic], pa.int32()), pa.array([np.array(own, "<i4").tobytes()], pa.binary())], ["doc_id", "toxic", "present"])

    seen = sorted(rows.select("doc_id", "toxic", "text").mapInArrow(placed, "doc_id long, toxic int, present binary").collect(), key=lambda r: (r.doc_id, r.present))
    label = np.array([r.toxic for r in seen], np.float64)
    if not 0 < label.sum() < len(label):  # labelled documents of one kind, or none, are in the table
        return Model(characters, odds)
    present = [np.frombuffer(r.present, "<i4") for r in seen]
    at, what = np.repeat(np.arange(len(seen)), [len(x) for x in present]), np.concatenate(present).astype(np.int64)
    n1, n0 = label.sum(), (1 - label).sum()
    d1, d0 = (np.bincount(what, weights=(label == y)[at].astype(float), minlength=len(candidates)) for y in (1, 0))
    lift = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    gain = np.where(lift > 1.5, d1 * lift, 0)
    chosen = np.flatnonzero(gain > 0)
    place = np.full(len(candidates), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[what] >= 0
    bias, weights = _fit(at[use], place[what[use]], label, len(chosen))
    names = list(candidates)
    bias += odds - log(n1 / n0)  # from the sample's share of toxic rows to that of all labels
    return Model(characters, bias, {names[k]: float(w) for k, w in zip(chosen.tolist(), weights, strict=True) if w})


def score(docs: DataFrame, model: Model, restored: bool = False) -> DataFrame:
    """doc_id, score, evidence (number of weighted features that the text has), and the restored text if asked for."""
    return scored(id_and_text(docs), model, restored).drop("text")


def scored(docs: DataFrame, model: Model, restored: bool = False, text: str = "text", names: tuple[str, str, str] = ("score", "evidence", "restored")) -> DataFrame:
    """docs with all their columns, and the score, the evidence and the restored text (if asked for) under `names`; a column
    that has such a name gives way."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = names[: 2 + restored]
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.IntegerType(), T.StringType()), strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer = Restorer(CharacterModel(model.characters))
        weights = model.weights
        known: dict[str, tuple[str, ...]] = {}

        def weighted(token: str) -> tuple[str, ...]:
            found = known.get(token)
            if found is None:
                found = tuple(f for w in restorer[token] for f in features(w) if f in weights)
                if len(known) > 300_000:
                    known.clear()
                if len(token) <= 64:
                    known[token] = found
            return found

        for batch in batches:
            scores, evidence, texts = [], [], []
            for text_ in batch.column(kept.index(text)).to_pylist():
                found = {f for t in restorer.tokens(text_ or "") if (own := weighted(t)) for f in own}
                scores.append(logistic(model.bias + sum(weights[f] for f in sorted(found))))
                evidence.append(len(found))
                if restored:
                    texts.append(restorer.restore(text_ or ""))
            more = [pa.array(scores, pa.float64()), pa.array(evidence, pa.int32()), *([pa.array(texts, pa.string())] if restored else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*kept, *names])

    return rows.mapInArrow(run, schema)


def is_held_out(doc_id="doc_id"):
    """Rows that learning must not see: crc32 of the id as text leaves no remainder by five. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
