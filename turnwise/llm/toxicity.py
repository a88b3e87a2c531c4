"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

A text is scored by its words (units). The kernel of two units counts the subsequences of four letters
that they share, within six places, each gap halving the weight; ends of a unit are letters of their
own. Letters in between (idXiot) only widen gaps, signs in between (i.d-i*o.t) are left out, whatever
their script, as are invisible characters; digits that stand for letters are read as such, wide and
accented letters as their plain ones, and runs of single letters (i d i o t) are put together. Units of
over 20 letters are taken in pieces; of fewer than three they have no subsequence of four, so they
score as nothing.

Nyström features of landmark units make the machine linear. Its decision is a weighted sum of kernels
with the landmarks, which folds into one table over all subsequences (32 letters to the fourth): scoring is a
table lookup for each place, whatever the number of landmarks. A text's score is that of its highest unit.

Labels are of texts, not units, so training picks the units of toxic texts that stand out against clean
ones (by log odds and by a likelihood ratio, against the number of units that were looked at), learns
them as they are and with a letter slipped in, and fits twice more with the units of clean texts that
came out highest. A quarter of the clean texts takes no part in that: their highest decisions say from
where on a text is called toxic (FALSE_ALARMS of them lie above), and a logistic curve through that place
makes scores of decisions.

Fitting takes at most TRAIN toxic and TRAIN_CLEAN other labelled texts, by order of a hash of doc_id, in one task, and
of their units at most what the constants below say; these are its documented bounds. Scoring covers
every text whole, in bounded slices.

Defined cases: null and empty texts have no units and score as such; doc_ids labelled both ways count
as toxic; of texts that share a doc_id one is learned from, by a hash; null labels and null doc_ids are not learned from; without both classes every score is 0.
"""

from __future__ import annotations

import functools
import multiprocessing
import pickle
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_batches, crc_mod, lean, text_of
from turnwise.llm.encoder import slices

TRAIN, TRAIN_CLEAN = 800, 3000
LANDMARKS = 256
DECAY, REACH, PIECE = 0.5, 5, 20
CODES = 1 << 20
#: Distances of the other three letters from the first, and the weight.
PATTERNS = tuple((p, q, r, DECAY ** (r - 3)) for r in range(3, REACH + 1) for q in range(2, r) for p in range(1, q))
FLOOR = -3.0
LIMIT = 0.7
#: Log odds from which a unit, or a part of five letters, may mark a unit to begin the training with.
STANDS_OUT = 2.2
#: Units that stand out, those of them that are also learned with a letter slipped in, clean units by hash
#: and by frequency, and clean ones that came out highest and are learned in each of two more rounds.
POSITIVE, SLIPPED, CLEAN, FREQUENT, HARD = 2000, 400, 6000, 1500, 3000
SLIP_WEIGHT = 4.0
#: Share of unseen clean texts that may lie above a place, and how far the limit moves on from there towards
#: the median of the units that stand out; and the score of that place.
FALSE_ALARMS, MARGIN, CLEAN_END = 0.01, 0.08, 0.05

_LETTERS = np.zeros(256, np.uint8)
_FOLD = {
    "a": "aàáâãäå@4", "c": "cç", "e": "eèéêë3", "i": "iìíîï1", "n": "nñ", "o": "oòóôõöø0",
    "s": "s$5ß", "t": "t7", "u": "uùúûü", "y": "yýÿ",
}
for _c in "abcdefghijklmnopqrstuvwxyz":
    for _x in _FOLD.get(_c, _c):
        _LETTERS[[ord(_x), ord(_x.upper()) if len(_x.upper()) == 1 and ord(_x.upper()) < 256 else ord(_x)]] = ord(_c) - 96
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0xA0, *range(0x09, 0x0E)]] = True
SIGN, SPACE = 0, 255


@functools.cache
def _letter(code: int) -> int:
    """Of a character over 255: its plain letter if it has one, one of four codes for other letters, SIGN, or
    SPACE."""
    c = chr(code)
    plain = unicodedata.normalize("NFKD", c)[:1]
    if plain != c and ord(plain) < 256:
        return SPACE if _BLANK[ord(plain)] else int(_LETTERS[ord(plain)])
    kind = unicodedata.category(c)[0]
    return SPACE if kind == "Z" else 27 + code % 4 if kind == "L" else SIGN



def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters (0 at both ends of each unit), where units begin among them, and the text of each unit."""
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts])
    opens = np.cumsum(sizes + 1) - sizes - 1
    low = np.minimum(code, 255).astype(np.uint8)
    letter = _LETTERS[low]
    high = code > 255
    blank = _BLANK[low] & ~high
    if high.any():
        codes, which = np.unique(code[high], return_inverse=True)
        found = np.array([_letter(int(c)) for c in codes], np.uint8)[which]
        blank[high] = found == SPACE
        letter[high] = np.where(found == SPACE, SIGN, found)
    word = np.cumsum(blank)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.searchsorted(opens, at, "right") - 1
    word = word[at]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(first, append=len(at))
    single = (size[1:] == 1) & (size[:-1] == 1) & (doc[first[1:]] == doc[first[:-1]])
    begin = np.zeros(len(at), bool)
    begin[first[np.append(True, ~single)]] = True
    first = np.flatnonzero(begin)
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    begin |= place % PIECE == 0
    first = np.flatnonzero(begin)
    size = np.diff(first, append=len(at))
    starts = first + 2 * np.arange(len(first))
    out = np.zeros(len(at) + 2 * len(first), np.uint8)
    out[np.arange(len(at)) + 1 + 2 * np.repeat(np.arange(len(first)), size)] = letter[at]
    return out, starts, doc[first]


def _norms(size: np.ndarray) -> np.ndarray:
    """Of units by length, ends included: the root of the sum of squared weights."""
    total = sum(np.maximum(size - r, 0) * w * w for _, _, r, w in PATTERNS)
    return np.sqrt(np.maximum(total, 1e-9))


def _places(letters: np.ndarray, starts: np.ndarray):
    """For each pattern: places whose subsequence stays in its unit, its code, its weight."""
    unit = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(letters)))
    wide = letters.astype(np.int32)
    for p, q, r, w in PATTERNS:
        n = len(letters) - r
        if n > 0:
            inside = unit[:n] == unit[r:]
            yield inside, wide[:n] << 15 | wide[p : p + n] << 10 | wide[q : q + n] << 5 | wide[r:], w


def decisions(letters: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0)
    total = np.zeros(len(letters), np.float32)
    for inside, code, w in _places(letters, starts):
        total[: len(code)] += table[code] * (inside * np.float32(w))
    size = np.diff(starts, append=len(letters))
    return np.add.reduceat(total, starts) / _norms(size)


@dataclass(frozen=True)
class Model:
    table: np.ndarray
    bias: float
    slope: float
    limit: float  # the decision that scores LIMIT

    def highest(self, texts: list[str]) -> np.ndarray:
        """The highest decision of each text."""
        out = np.full(len(texts), FLOOR)
        letters, starts, doc = units(texts)
        f = decisions(letters, starts, self.table) + self.bias
        if len(f):
            begin = np.flatnonzero(np.diff(doc, prepend=-1))
            out[doc[begin]] = np.maximum(np.maximum.reduceat(f, begin), FLOOR)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        odds = self.slope * (self.highest(texts) - self.limit) + np.log(LIMIT / (1 - LIMIT))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


NEVER = Model(np.zeros(CODES, np.float32), 0.0, 1.0, 60.0)


def _packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size


class Landmarks:
    """Their normalised subsequence weights: a row for each code that any of them has, after row 0."""

    def __init__(self, words: list[bytes]):
        codes = []
        for w in words:
            letters, starts = _packed([w])
            codes += [(code[inside], weight) for inside, code, weight in _places(letters, starts)]
            codes.append((None, w))
        self.codes = np.unique(np.concatenate([c for c, _ in codes if c is not None]))
        self.row = np.zeros(CODES, np.int32)
        self.row[self.codes] = np.arange(1, len(self.codes) + 1)
        self.weights = np.zeros((len(self.codes) + 1, len(words)), np.float32)
        j = 0
        for code, w in codes:
            if code is None:
                self.weights[:, j] /= _norms(np.array([len(w)]))
                j += 1
            else:
                np.add.at(self.weights[:, j], self.row[code], w)

    def kernel(self, words: list[bytes]) -> np.ndarray:
        out = np.empty((len(words), self.weights.shape[1]), np.float32)
        for lo in range(0, len(words), 500):
            letters, starts = _packed(words[lo : lo + 500])
            total = np.zeros((len(letters), self.weights.shape[1]), np.float32)
            for inside, code, w in _places(letters, starts):
                row = self.row[code] * inside
                at = np.flatnonzero(row)  # most subsequences are in no landmark
                total[at] += self.weights[row[at]] * np.float32(w)
            out[lo : lo + 500] = np.add.reduceat(total, starts) / _norms(np.diff(starts, append=len(letters)))[:, None]
        return out

    def folded(self, weight: np.ndarray) -> np.ndarray:
        table = np.zeros(CODES, np.float32)
        table[self.codes] = self.weights[1:] @ weight
        return table


def _machine(z: np.ndarray, y: np.ndarray, n: np.ndarray, cost: float = 4.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last weight is the bias. n weighs rows
    within their class, and both classes weigh the same."""
    x = np.hstack([z, np.ones((len(z), 1))]).astype(np.float64)
    c = n * np.where(y > 0, 0.5 / max(1, n[y > 0].sum()), 0.5 / max(1, n[y < 0].sum())) * len(y) * cost
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(20):
        on = y * (x @ w) < 1
        a = x[on] * c[on][:, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _telling(toxic: Iterable[set[bytes]], clean: Iterable[set[bytes]]) -> set[bytes]:
    """What stands out in toxic texts: high log odds less a standard error, and a likelihood ratio that chance
    would reach for about one in ten such samples."""
    (bad, n_bad), (good, n_good) = map(_counted, (toxic, clean))
    looked_at = {w: k for w, k in bad.items() if k > 2}
    enough = 2 * np.log(10 * max(1, len(looked_at)))
    share = n_bad / max(1, n_bad + n_good)
    out = set()
    for w, k in looked_at.items():
        n = k + (other := good[w])
        odds = np.log((k + 0.5) / (n_bad + 1)) - np.log((other + 0.5) / (n_good + 1))
        ratio = k * np.log(k / (n * share)) + (other * np.log(other / (n * (1 - share))) if other else 0.0)
        if odds - np.sqrt(1 / (k + 0.5) + 1 / (other + 0.5)) > STANDS_OUT and 2 * ratio > enough:
            out.add(w)
    return out


def _counted(docs: Iterable[set[bytes]]) -> tuple[Counter, int]:
    """In how many of docs each thing is, and their number; docs may be made as they are counted."""
    counts: Counter = Counter()
    n = 0
    for words in docs:
        counts.update(words)
        n += 1
    return counts, n


def fit(texts: list[str], toxic: list[bool]) -> Model:
    if all(toxic) or not any(toxic):
        return NEVER
    of_doc: list[set[bytes]] = [set() for _ in texts]
    known: dict[bytes, bytes] = {}  # one object for each unit
    for lo, hi in slices(texts, 500_000):
        letters, starts, doc = units(texts[lo:hi])
        raw, ends = letters.tobytes(), np.append(starts[1:], len(letters)).tolist()
        for s, e, d in zip(starts.tolist(), ends, doc.tolist()):
            if e - s > 4:
                w = raw[s:e]
                of_doc[lo + d].add(known.setdefault(w, w))
    apart = np.array([not t and zlib.crc32(x.encode("utf-8", "surrogatepass")) % 4 == 0 for x, t in zip(texts, toxic)])
    unseen = [x for x, out in zip(texts, apart) if out]
    of_doc, toxic = ([x for x, out in zip(of, apart) if not out] for of in (map(frozenset, of_doc), toxic))
    in_clean = {words for words, t in zip(of_doc, toxic) if not t}
    clean = sorted(set().union(*in_clean), key=lambda w: (hash_of(w), w))
    clean_words = set(clean)
    in_toxic = {words for words, t in zip(of_doc, toxic) if t}  # copies count once
    # units that are telling as a whole, and those with a part of five letters that is telling in the other units
    whole = _telling(in_toxic, in_clean) - clean_words
    parts = lambda w: [w[i : i + 5] for i in range(max(1, len(w) - 4))]
    in_parts = lambda docs: ({p for w in words - whole for p in parts(w)} for words in docs)
    telling_parts = _telling(in_parts(in_toxic), in_parts(in_clean))
    picked: Counter = Counter()
    for words, t in zip(of_doc, toxic):
        if t:
            picked.update({w for w in words if w in whole or w not in clean_words and not telling_parts.isdisjoint(parts(w))})
    if not picked:
        return NEVER
    positive = [w for w, _ in sorted(picked.items(), key=lambda x: (-x[1], x[0]))[:POSITIVE]]
    common = Counter(w for words, t in zip(of_doc, toxic) if not t for w in words)
    frequent = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    # the same with a letter slipped in, as such texts do
    slipped = [w[:i] + bytes([1 + hash_of(w + bytes([i])) % 26]) + w[i:] for w in positive[:SLIPPED] for i in range(2, len(w) - 1)]
    often = np.sqrt([picked[w] for w in positive] + [picked[w] * SLIP_WEIGHT / (len(w) - 3) for w in positive[:SLIPPED] for _ in range(2, len(w) - 1)])
    marks = positive[: LANDMARKS // 2]
    marks += [w for w in frequent if w not in set(marks)][: LANDMARKS - len(marks)]
    landmarks = Landmarks(marks)
    gram = landmarks.kernel(marks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-4)) @ vector.T
    negative = clean[:CLEAN] + frequent[:FREQUENT]
    model = NEVER
    for turn in range(3):
        words = positive + slipped + negative
        sign = np.array([1.0] * (len(positive) + len(slipped)) + [-1.0] * len(negative))
        n = np.concatenate([often, np.ones(len(negative))])
        w = _machine(landmarks.kernel(words) @ root, sign, n)
        model = Model(landmarks.folded(root @ w[:-1]), float(w[-1]), 1.0, 0.0)
        if turn == 2:
            break
        # what the machine wrongly finds in clean texts is learned as well
        f = dict(zip(clean, decisions(*_packed(clean), model.table).tolist()))
        negative = list(dict.fromkeys(negative + sorted(clean, key=lambda x: -f[x])[:HARD]))
    alone = float(np.median(np.repeat(decisions(*_packed(positive), model.table), [picked[w] for w in positive]))) + model.bias
    quiet = np.concatenate([model.highest(unseen[lo:hi]) for lo, hi in slices(unseen, 500_000)] or [np.empty(0)])
    limit = float(np.quantile(quiet, 1 - FALSE_ALARMS, method="higher")) if len(quiet) else 0.0
    # on from clean texts towards units that stand out; where the two mix, these come first
    margin = max(MARGIN * (alone - limit), 0.1)
    # the limit scores LIMIT, and the place where clean texts end CLEAN_END
    rise = np.log(LIMIT / (1 - LIMIT)) - np.log(CLEAN_END / (1 - CLEAN_END))
    return Model(model.table, model.bias, float(rise) / margin, min(limit + margin, alone))


def _by_child(f, *args) -> bytes:
    """What f returns, pickled, from a child process: a fit leaves its many small objects' memory in pieces,
    which a worker that is used again would keep."""
    fork = multiprocessing.get_context("fork")
    receive, send = fork.Pipe(duplex=False)
    child = fork.Process(target=lambda: send.send_bytes(pickle.dumps(f(*args))), daemon=True)
    child.start()
    send.close()
    try:
        return receive.recv_bytes()
    except EOFError:
        child.join()
        raise RuntimeError(f"the child process ended with {child.exitcode}") from None
    finally:
        receive.close()
        child.join()


def hash_of(word: bytes) -> int:
    return zlib.crc32(word)


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """From at most TRAIN toxic and TRAIN_CLEAN other labelled texts that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.crc32(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(TRAIN).unionByName(known.where("toxic = 0").orderBy(*order).limit(TRAIN_CLEAN))
    picked = F.broadcast(picked.withColumnRenamed("doc_id", "l_doc"))  # TRAIN + TRAIN_CLEAN rows at most
    rows = docs.select("doc_id", text_of().alias("text")).join(picked, F.col("doc_id") == F.col("l_doc"))
    # of texts that share a doc_id one, so that the bound holds
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        model = _by_child(fit, [t for _, t, _ in got], [y == 1 for _, _, y in got])
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    # the bounded sample is one task's; the driver gets a table of 2^20 numbers
    one = rows.select("doc_id", "text", "toxic").repartition(1).sortWithinPartitions("doc_id", "text")
    found = one.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else NEVER


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep, then score for each row of docs."""
    keep = keep or ("doc_id",)
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^20 numbers

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            score = [held.value.scores(texts[lo:hi]) for lo, hi in slices(texts, 400_000)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score or [np.empty(0)]))], ["__key", "score"])

    key = F.struct(*(docs[c].alias(f"k{i}") for i, c in enumerate(keep))).alias("__key")
    rows = docs.select(key, text_of().alias("__text"))
    out = rows.mapInArrow(run, f"__key {rows.schema['__key'].dataType.simpleString()}, score double")
    return out.select(*(F.col(f"__key.k{i}").alias(c) for i, c in enumerate(keep)), "score")


def keep_clean(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The rows of docs that score under the limit, with all their columns."""
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs["text"])
    return scored(row, model, "__row").where(F.col("score") < limit).select("__row.*")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
