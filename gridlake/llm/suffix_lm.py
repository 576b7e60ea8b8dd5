"""Language-model scores from a probabilistic suffix tree.

The symbols are the bytes of a text's canonical form: its words, A-Z lower-cased,
with one blank between them and a line feed, the end, after the last. A context
of up to DEPTH bytes is a candidate if it begins at least LEAST training
positions, a number that does not rise with the corpus: at 1 every context seen
is one, and the tree grows with what the corpus holds. A candidate is retained
if its next-symbol counts diverge from its suffix's: twice its count times the
Kullback-Leibler divergence must exceed DIVERGENCE for each symbol seen.
Suffixes and prefixes of retained contexts are kept as well. Distributions are
smoothed by the suffix's distribution, weighted with the number of symbols seen
(Witten and Bell), and at the root with all 256 byte values.

Only symbols seen after a context are stored, 12 bytes each; what a context
leaves to its suffix gives the others. Scoring looks up each distinct n-gram of a
block of texts once, from the longest retained context down. Each row's score is
the log10 probability of all its symbols.

The unigram base counts whole words over the training rows. Counts and n-grams
come from one pass and one partial aggregation. Words of HEAD or fewer that are
most frequent are looked up in a broadcast table; the others go to their counts
by one shuffle on the word, and come back as sums by row. So a frequent word is
never a hot key, and the vocabulary is never collected.

Words are counted by 64-bit hashes: of V distinct words a share of about
V / 2**65 has another's count added.

Defined results: a null text is an empty one, whose only token is the end;
repeated rows are scored each; without training rows all counts are zero and
every symbol has probability 1/256. The rows of the input must come in the same
order when a task is repeated, as those of a file scan or checkpoint do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .run import cut
from .text import NOT_SPACE, Words, parts

DEPTH, LEAST, DIVERGENCE = 5, 1, 3.0
HEAD = 200_000
#: Blocks of texts whose counts a worker adds up before it hands them on.
TOGETHER = 4
END = 10
#: The word hash that stands for the end of a text.
END_WORD = np.uint64(0x2545F4914F6CDD1D)


def canonical(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of some texts, DEPTH ends before each text, with the place and number of each one's own symbols."""
    letters, begin = words.spaced()
    n = len(words.count)
    ends = np.append(begin, len(letters))[words.at + words.count]
    starts = np.append(begin, len(letters))[words.at]
    own = np.where(words.count > 0, ends - starts, 1)  # the blank after the last word becomes the end
    place = np.cumsum(own + DEPTH) - own
    out = np.full(int((own + DEPTH).sum()), END, np.uint8)
    some = np.repeat(words.count > 0, own)
    target = np.repeat(place - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    out[target[some]] = letters
    out[place + own - 1] = END
    return out, place, own if n else np.zeros(0, np.int64)


def grams(symbols: np.ndarray, place: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The DEPTH symbols before each own symbol and itself, as one integer."""
    at = np.repeat(place - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    code = np.zeros(len(at), np.uint64)
    for k in range(DEPTH, -1, -1):
        code = code << np.uint64(8) | symbols[at - k]
    return code


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (kind 0) and n-grams (kind 1) of some blocks of texts at a time."""
    found: tuple[list, list] = ([], [])

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, part in enumerate(found):
            if part:
                key, back = np.unique(np.concatenate([k for k, _ in part]), return_inverse=True)
                count = np.bincount(back, np.concatenate([c for _, c in part])).astype(np.int64)
                part.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(count)], ["kind", "key", "c"])

    for batch in batches:
        for lo, hi, texts in parts(batch["text"]):
            w = Words(texts, NOT_SPACE)
            for part, x in zip(found, (np.append(w.hashes(), np.full(hi - lo, END_WORD)), grams(*canonical(w))), strict=True):
                part.append(np.unique(x, return_counts=True))
            if len(found[0]) == TOGETHER:
                yield from flush()
    yield from flush()


@dataclass
class Tree:
    """What is retained: for each context length the contexts, and the symbols seen after them."""

    symbol: np.ndarray  # the column of each byte; the last stands for bytes never seen
    root: np.ndarray  # log10 probability of each byte without context
    contexts: list[np.ndarray]  # sorted codes by length, from 0 on
    spare: list[np.ndarray]  # log10 of what each context leaves to its suffix for a symbol it has not seen
    grams: list[np.ndarray]  # sorted codes of (context, symbol)
    gains: list[np.ndarray]  # their log10 probability

    def log(self, code: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """log10 probability of the last byte of each code after the longest retained context of up to `depth` bytes before it."""
        out = np.zeros(len(code))
        open_ = np.arange(len(code))
        for k in range(min(depth, len(self.contexts) - 1), 0, -1):
            part = code[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, found = _find(self.contexts[k], part >> np.uint64(8))
            gram, seen = _find(self.grams[k], part)
            seen &= found
            out[open_[seen]] += self.gains[k][gram[seen]]
            less = found & ~seen
            out[open_[less]] += self.spare[k][at[less]]
            open_ = open_[~seen]
        out[open_] += self.root[(code[open_] & np.uint64(255)).astype(np.int64)]
        return out

    def score(self, symbols: np.ndarray, place: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        code, back = np.unique(grams(symbols, place, own), return_inverse=True)
        return np.bincount(np.repeat(np.arange(len(own)), own), self.log(code)[back], minlength=len(own))

    @property
    def states(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The automaton's states: their codes and lengths, the first of each length, and the bytes of all columns."""
        size = [len(c) for c in self.contexts]
        byte = np.append(np.flatnonzero(self.symbol < self.symbol.max()), np.flatnonzero(self.symbol == self.symbol.max())[:1]).astype(np.uint64)
        return np.concatenate(self.contexts), np.repeat(np.arange(len(size)), size), np.cumsum([0, *size]), byte

    @property
    def logp(self) -> np.ndarray:
        """log10 probability for each state and symbol, in full: only for small trees."""
        every, depth, _, byte = self.states
        return np.concatenate([self.log((every[depth == k][:, None] << np.uint64(8) | byte).ravel(), k).reshape(-1, len(byte)) for k in range(len(self.contexts))])

    @property
    def next(self) -> np.ndarray:
        """The next state for each state and symbol, in full: only for small trees."""
        every, depth, first, byte = self.states
        longer = every[:, None] << np.uint64(8) | byte[None, :]
        follow = np.zeros(longer.shape, np.int32)
        for k in range(1, len(self.contexts)):
            at, found = _find(self.contexts[k], longer & np.uint64((1 << 8 * k) - 1))
            found &= (depth[:, None] >= k - 1) & (self.symbol[byte.astype(np.int64)] < self.symbol.max())
            follow[found] = first[k] + at[found]
        return follow


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x is in a sorted table, and whether it is."""
    if not len(table):
        return np.zeros(x.shape, np.int64), np.zeros(x.shape, bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def build(contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], divergence: float = DIVERGENCE) -> Tree:
    """A tree from, for each context length, the codes of (context, symbol), their counts, and the candidate contexts."""
    root = np.zeros(256)
    code, count, _ = contexts[0]
    root[code.astype(np.int64)] = count
    seen = np.flatnonzero(root)
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    most = (root + 1) / (root.sum() + 256)
    known = [np.zeros(1, np.uint64), *(c for _, _, c in contexts[1:])]
    # smoothed probabilities of all that was seen, and which candidates tell something new
    smooth, spare, keep, shorter = [most[code.astype(np.int64)]], [np.zeros(1)], [np.ones(1, bool)], code
    for k, (code, count, own) in enumerate(contexts[1:], 1):
        row = np.searchsorted(own, code >> np.uint64(8))
        before = smooth[k - 1][np.searchsorted(shorter, code & np.uint64((1 << 8 * k) - 1))]
        total, kinds = np.bincount(row, count, len(own)), np.bincount(row, minlength=len(own))
        smooth.append((count + kinds[row] * before) / (total + kinds)[row])
        spare.append(np.log10(kinds / (total + kinds)))
        gain = np.bincount(row, count * np.log(count / total[row] / before), len(own))
        keep.append(2 * gain > divergence * kinds)
        shorter = code
    for k in range(len(keep) - 1, 1, -1):  # suffixes and prefixes of what is kept
        kept = known[k][keep[k]]
        for x in (kept & np.uint64((1 << 8 * (k - 1)) - 1), kept >> np.uint64(8)):
            keep[k - 1][np.searchsorted(known[k - 1], x)] = True
    left = [m[np.searchsorted(x, c >> np.uint64(8))] for (c, _, _), x, m in zip(contexts, known, keep, strict=True)]
    return Tree(
        symbol, np.log10(most), [x[m] for x, m in zip(known, keep, strict=True)], [x[m].astype(np.float32) for x, m in zip(spare, keep, strict=True)],
        [c[m] for (c, _, _), m in zip(contexts, left, strict=True)], [np.log10(x[m]).astype(np.float32) for x, m in zip(smooth, left, strict=True)],
    )


@dataclass
class Model:
    counts: DataFrame  # key, c of every training word
    tokens: int
    distinct: int
    head: tuple[np.ndarray, np.ndarray]
    tree: Tree


def train(df: DataFrame, text: str = "text", least: float = LEAST, divergence: float = DIVERGENCE, head: int = HEAD) -> Model:
    """Word counts and suffix tree of all texts of df."""
    rows = df.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(_counted, "kind byte, key long, c long")
    counted = cut(rows.groupBy("kind", "key").agg(F.sum("c").alias("c")))
    words = counted.where("kind = 0").select("key", "c")
    # how many words have counts of at least each power of two: the head's smallest count
    sizes = {r.p: (r.n, r.c) for r in words.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    power, room = max(sizes, default=0) + 1, head
    while power > 0 and room >= sizes.get(power - 1, (0, 0))[0]:
        power -= 1
        room -= sizes.get(power, (0, 0))[0]
    table = words.where(F.col("c") >= 2**power).toArrow()
    key = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    tokens, distinct = sum(c for _, c in sizes.values()), sum(n for n, _ in sizes.values())
    return Model(words, tokens, distinct, (key[order], table["c"].to_numpy()[order]), build(_contexts(counted, least), divergence))


def _contexts(counted: DataFrame, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each context length the candidates and the counts of what follows them."""
    whole = counted.where("kind = 1").select("key", "c")
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)) if k < 7 else F.col("key")).alias("code")) for k in range(DEPTH + 1)]))
    grams_ = whole.select(orders.alias("x"), "c").groupBy("x.k", "x.code").agg(F.sum("c").alias("c"))
    if least > 1:
        grams_ = cut(grams_)
        contexts = grams_.groupBy("k", F.shiftrightunsigned("code", 8).alias("context")).agg(F.sum("c").alias("n")).where(F.col("n") >= least)
        same = [F.col("g.k") == F.col("s.k"), F.shiftrightunsigned("g.code", 8) == F.col("s.context")]
        grams_ = grams_.alias("g").join(contexts.alias("s"), same).select("g.k", "g.code", "g.c")
    table = grams_.toArrow()
    k, code, c = table["k"].to_numpy(), table["code"].to_numpy().view(np.uint64), table["c"].to_numpy()
    out = []
    for i in range(DEPTH + 1):
        own = code[k == i]
        order = np.argsort(own)
        out.append((own[order], c[k == i][order], np.unique(own >> np.uint64(8))))
    return out


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without its text, with n_tokens, n_known, train_tokens, base_score and score (new names)."""
    kept = [f for f in df.schema.fields if f.name != text]
    if taken := {"n_tokens", "n_known", "train_tokens", "base_score", "score"} & {f.name for f in kept}:
        raise ValueError(f"column names taken: {sorted(taken)}")
    sent = df.sparkSession.sparkContext.broadcast((model.head, model.tree))
    names = [f.name for f in kept]

    schema = T.StructType().add("rid", "long").add("key", "long").add("times", "long").add("n_tokens", "long").add("known", "long").add("logs", "double").add("value", "double")
    for i, f in enumerate(kept):
        schema = schema.add(f"own{i}", f.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, counts), tree = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, texts in parts(batch[text]):
                n = hi - lo
                w = Words(texts, NOT_SPACE)
                rid = row + np.arange(n)
                row += n
                hashes = np.append(w.hashes(), np.full(n, END_WORD))
                doc = np.append(w.doc, np.arange(n))
                word, back = np.unique(hashes, return_inverse=True)
                at = np.minimum(np.searchsorted(head, word), max(len(head) - 1, 0))
                in_head = (head[at] == word) if len(head) else np.zeros(len(word), bool)
                c = np.where(in_head, counts[at], 0) if len(head) else np.zeros(len(word), np.int64)
                known = np.bincount(doc, in_head[back], minlength=n).astype(np.int64)
                logs = np.bincount(doc, np.log10(c + 1.0)[back], minlength=n)
                value = tree.score(*canonical(w))
                # a row for each text, under a key that meets no word, and one for each other word of it
                tail = np.flatnonzero(~in_head[back])
                pair, times = np.unique(np.stack((doc[tail], back[tail])), axis=1, return_counts=True) if len(tail) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                part = batch.slice(lo, n)
                m = len(times)
                own = [pa.concat_arrays([part[k], pa.nulls(m, part[k].type)]) for k in names]  # null but in the text's row
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(rid, rid[pair[0]])),
                        pa.array(np.append(rid * 0x9E3779B1 ^ 0x5DEECE66D, word[pair[1]].view(np.int64))),
                        pa.array(np.append(np.zeros(n, np.int64), times)),
                        pa.array(np.append(w.count + 1, np.zeros(m, np.int64))),
                        pa.array(np.append(known, np.zeros(m, np.int64))),
                        pa.array(np.append(logs, np.zeros(m))),
                        pa.array(np.append(value, np.zeros(m))),
                        *own,
                    ],
                    schema.names,
                )

    rows = df.select(*names, text).mapInArrow(run, schema)
    met = rows.join(model.counts, "key", "left")
    c = F.coalesce(F.when(F.col("times") > 0, F.col("c")), F.lit(0))
    sums = met.groupBy("rid").agg(
        *[F.first(f"own{i}", ignorenulls=True).alias(f"own{i}") for i in range(len(kept))],
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.col("times") * F.log10(c + 1.0)).alias("logs"),
        F.sum("value").alias("score"),
    )
    floor = float(np.log10(model.tokens + model.distinct + 1))
    return sums.select(*[F.col(f"own{i}").alias(k) for i, k in enumerate(names)], "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"), "score")
