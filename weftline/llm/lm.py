"""LM scoring by a hashed maximum-entropy model.

Every word and the end of a text are predicted from hashed features of what came before: the last word, the last two,
and the last but one alone (skip). The softmax over words is factored into classes within classes, down to two-way
choices (a Huffman tree over the training counts), each of them logistic in the features. The frequent words are leaves
of their own; each other word falls into one of many hashed leaves, whose words share its probability by their counts.
Leaves and buckets of features grow with the number of different training words. Weights are trained by distributed
gradient updates: rounds over disjoint parts of the training texts, in which each task updates its own copy, and the
copies' changes are averaged by how often each bucket was seen. Every training text is learned from once, and counts of
all words come from all training texts. Learning and scoring take the choices of a batch of tokens level by level.

A word is known by its 64-bit hash: two of 10^8 different words share one with a chance of 1 in 3,700.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import written
from weftline.llm.words import mixed, sliced, word_hashes

HOT_WORDS = 65_536  # frequent words at least, where there are so many
CHUNK = 4_096
COUNTED = 1 << 22  # words that a task holds before it counts them
CALM = 32
DEEP, LINE = 4, 16  # choices of a group below one another, and weights of a line (place 0 is of no choice)
HALVES = np.float32(0.5) ** np.arange(DEEP, dtype=np.float32)
BLOCK = 1024  # lines that are summed together
OCTAVE = 64  # classes of counts for each doubling, when the frequent words are looked for
BEFORE, END_CODE = 11, 13  # stand for what comes before a text, and for its end
END = 0  # the leaf of a text's end; frequent words follow, then the hashed leaves


def _power(x: float) -> int:
    return max(0, math.ceil(math.log2(max(x, 1))))


def sizes_for(kinds: int) -> tuple[int, int, int]:
    """Most frequent words, hashed leaves for the rest, and bits of the number of a line of weights, for so many different words.

    All three grow as the square root of it, and so do the tasks of a round with the tokens (tasks_for): what the
    tasks send in a round then grows as the input, and what each holds more slowly.
    """
    hot = min(kinds, max(HOT_WORDS, int(64 * math.sqrt(kinds))))
    return hot, 1 << _power(4 * math.sqrt(kinds - hot)), _power(32 * math.sqrt(kinds))


def tasks_for(n_tokens: int) -> int:
    return max(12, int(math.sqrt(n_tokens) / 800))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(held):
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

    held, size = [], 0
    for batch in sliced(batches, 0):
        held.append(word_hashes(batch.column(0), lower=True)[0])
        size += len(held[-1])
        if size > COUNTED:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


class Vocabulary:
    """Leaves of words by their hash, in tables that each take what collides in the one before."""

    def __init__(self, words: np.ndarray, tail: int):
        self.words, self.tail, self.tables = words, tail, []
        left, bits = np.arange(len(words)), _power(8 * max(len(words), 1))
        while len(left):
            salt = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.tables))
            table = np.full(1 << bits, -1, np.int32)
            table[self._slot(words[left], salt, bits)] = left
            self.tables.append((salt, bits, table))
            left = left[table[self._slot(words[left], salt, bits)] != left]
            bits = _power(8 * max(len(left), 1))

    @staticmethod
    def _slot(words: np.ndarray, salt: np.uint64, bits: int) -> np.ndarray:
        return (words * salt >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)

    def leaves(self, words: np.ndarray) -> np.ndarray:
        out = 1 + len(self.words) + ((words >> np.uint64(16)) % np.uint64(self.tail)).astype(np.int64)
        for salt, bits, table in self.tables:
            found = table[self._slot(words, salt, bits)]
            hit = np.flatnonzero(found >= 0)
            hit = hit[self.words[found[hit]] == words[hit]]
            out[hit] = 1 + found[hit]
        return out


def _line(code: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """A number of so many bits."""
    h = (code + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at]; at is in range, which spares numpy a slower way."""
    return table.take(at, axis=0, mode="clip")


def token_codes(texts: pa.Array, vocabulary: Vocabulary) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of texts end to end: codes of the three features, leaves and words; and where each text's begin."""
    words, bounds = word_hashes(texts, lower=True)
    n = len(texts)
    at = bounds + np.arange(n + 1)
    flat = np.full(at[-1], np.uint64(END_CODE))
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(bounds))
    flat[place] = words
    leaf = np.full(len(flat), END)
    leaf[place] = vocabulary.leaves(words)
    last, before = np.empty_like(flat), np.empty_like(flat)
    last[1:], before[2:] = flat[:-1], flat[:-2]
    first = at[:-1]
    last[first] = before[first] = np.uint64(BEFORE)
    before[first[np.diff(bounds) > 0] + 1] = np.uint64(BEFORE)
    return [last, last * np.uint64(31) + before * np.uint64(0xD1342543DE82EF95), before ^ np.uint64(0xA5A5A5A5)], leaf, flat, at


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each node and weight of each: leaves in the order given, then inner nodes, the root last."""
    n = len(weights)
    order, parent, total = np.argsort(weights, kind="stable").tolist(), [0] * (2 * n - 1), [*weights.tolist(), *[0.0] * (n - 1)]
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):
        for _ in range(2):
            if inner == new or (leaf < n and total[order[leaf]] <= total[inner]):
                x, leaf = order[leaf], leaf + 1
            else:
                x, inner = inner, inner + 1
            parent[x] = new
            total[new] += total[x]
    return np.array(parent, np.int32), np.array(total)


class Tree:
    """The ways to the leaves, cut into groups of up to DEEP choices below one another.

    A way is a chain of exits: a leaf is the exit of its last group, the group's first node the exit of the one above.
    An exit has the line of its group (a feature's weights for all choices of a group lie together), and for each choice
    the place in the line, the direction (1 or -1, 0 where there is no such choice) and the bias in that direction.
    """

    def __init__(self, parent: np.ndarray, total: np.ndarray, bits: int):
        n, root = (len(parent) + 1) // 2, len(parent) - 1
        children = np.argsort(parent[:-1], kind="stable")  # two of each inner node
        way = np.full(len(parent), -1, np.float32)
        way[children[1::2]] = 1
        odds = np.zeros(len(parent), np.float32)
        odds[parent[children[1::2]]] = np.log(total[children[1::2]] / total[children[::2]])
        level, place, at = np.zeros(len(parent), np.int64), np.ones(len(parent), np.int64), np.array([root])
        self.groups = np.zeros(len(parent), np.int16)
        while len(at := at[at >= n]):
            below = np.concatenate([children[2 * (at - n)], children[2 * (at - n) + 1]])
            above = parent[below]
            level[below] = (level[above] + 1) % DEEP
            place[below] = np.where(level[below] == 0, 1, 2 * place[above] + (way[below] > 0))
            self.groups[below] = self.groups[above] + (level[above] == 0)
            at = below
        self.place, self.way, self.bias = np.zeros((len(parent), DEEP), np.int32), np.zeros((len(parent), DEEP), np.float32), np.full((len(parent), DEEP), 30, np.float32)
        self.up, self.line = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
        exits = np.flatnonzero((np.arange(len(parent)) < n) | (level == 0))
        exits = at = exits[exits != root]
        while len(exits):
            above = parent[at]
            self.place[exits, level[above]], self.way[exits, level[above]], self.bias[exits, level[above]] = place[above], way[at], odds[above] * way[at]
            done = level[above] == 0
            self.up[exits[done]], self.line[exits[done]] = above[done], _line(above[done].astype(np.uint64), 29, bits)
            exits, at = exits[~done], above[~done]


def _aligned(table: np.ndarray) -> np.ndarray:
    """A copy whose lines each fill one line of the processor's cache."""
    raw = np.empty(table.nbytes + 64, np.uint8)
    out = raw[-raw.ctypes.data % 64 :][: table.nbytes].view(np.float32).reshape(table.shape)
    out[:] = table
    return out


class Model:
    def __init__(self, parent: np.ndarray, total: np.ndarray, table: np.ndarray):
        self.parent, self.total, self.table = parent, total, _aligned(table)
        self.bits, self._tree = _power(len(table)), None

    @classmethod
    def start(cls, weights: np.ndarray, bits: int) -> "Model":
        """No features yet: the leaves' own frequencies."""
        return cls(*huffman(weights), np.zeros((1 << bits, LINE), np.float32))

    def __reduce__(self):
        return Model, (self.parent, self.total, self.table)

    @property
    def tree(self) -> Tree:
        if self._tree is None:
            self._tree = Tree(self.parent, self.total, self.bits)
        return self._tree

    def _groups(self, codes, leaf):
        """The order of tokens in which longest ways come first; then for each group from the leaves up: the first tokens
        that have one, their lines of the features, and places, directions and log-odds of their choices."""
        tree = self.tree
        order = np.argsort(-tree.groups[leaf], kind="stable")
        at, lines = leaf[order], [_line(c[order], 1 + i, self.bits) for i, c in enumerate(codes)]
        left, starts = -tree.groups[at], (np.arange(len(at)) * LINE)[:, None]
        yield order
        for group in range(-int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(left, -group, "left"))
            at = at[:n]
            own = _rows(tree.line, at)
            rows = [x[:n] ^ own for x in lines]
            weights = _rows(self.table, rows[0])
            for r in rows[1:]:
                weights += _rows(self.table, r)
            place, way = _rows(tree.place, at), _rows(tree.way, at)
            z = weights.reshape(-1)[place + starts[:n]]
            z *= way
            z += _rows(tree.bias, at)
            np.clip(z, -20, 20, out=z)
            yield n, rows, place, way, z
            at = _rows(tree.up, at)

    def log_prob(self, codes, leaf) -> np.ndarray:
        """Natural log of each token's leaf."""
        out = np.zeros(len(leaf))
        for at in range(0, len(leaf) if len(self.parent) > 1 else 0, CHUNK):
            cut = slice(at, at + CHUNK)
            groups = self._groups([c[cut] for c in codes], leaf[cut])
            order = next(groups)
            total = np.zeros(len(order))
            for n, _, _, _, z in groups:
                odds = 1 + np.exp(-z)  # of a group the product stays below the largest float
                total[:n] += np.log(functools.reduce(np.multiply, odds.T))
            out[at + order] = -total
        return out

    def learn(self, codes, leaf, rate: float, seen: np.ndarray) -> None:
        """Steps along the gradient, shorter for lines seen often (deeper choices of a group are taken to be seen half as
        often as those above them). The tokens of a chunk meet the same weights of a group."""
        flat = self.table.reshape(-1)
        for at in range(0, len(leaf) if len(self.parent) > 1 else 0, CHUNK):
            cut = slice(at, at + CHUNK)
            groups = self._groups([c[cut] for c in codes], leaf[cut])
            next(groups)
            for _, rows, place, way, z in groups:
                up = 4 * rate * way / (1 + np.exp(z))
                for r in rows:
                    np.add.at(seen, r, np.float32(1))
                for r in rows:
                    step = up / (_rows(seen, r)[:, None] * HALVES + CALM)
                    np.add.at(flat, (place + (r * LINE)[:, None]).reshape(-1), step.reshape(-1))


def _round(held, rate: float):
    """A mapInArrow function: one task's changes of the table, weighted by how often each bucket was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, start = held.value
        model = Model(start.parent, start.total, start.table)
        seen = np.zeros(len(start.table), np.float32)
        for batch in sliced(batches, 0):
            codes, leaf, _, _ = token_codes(batch.column(0), vocabulary)
            model.learn(codes, leaf, rate, seen)
        for at in range(0, len(seen), BLOCK):
            own = seen[at : at + BLOCK]
            if own.any():
                change = (model.table[at : at + BLOCK] - start.table[at : at + BLOCK]) * own[:, None]
                values = np.concatenate([change.reshape(-1), own]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["at", "change"])

    return run


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, "<f4").astype(np.float64) for c in pdf["change"])
    n = len(total) // (LINE + 1)
    change = total[: n * LINE].reshape(n, LINE) / np.maximum(total[n * LINE :], 1)[:, None]
    return pd.DataFrame({"at": [pdf["at"].iloc[0]], "change": [change.astype("<f4").tobytes()]})


def train(texts: DataFrame, vocabulary: Vocabulary, model: Model, *, tasks: int, rounds: int = 3, rate: float = 0.3) -> Model:
    """texts: (text, part) of training documents; part, from 0 to rounds - 1, says in which round a text is used."""
    for at in range(rounds):
        held = texts.sparkSession.sparkContext.broadcast((vocabulary, model))
        changes = texts.where(F.col("part") == at).select("text").coalesce(tasks).mapInArrow(_round(held, rate), "at int, change binary")
        table = model.table.copy()
        for r in changes.groupBy("at").applyInPandas(_summed, "at int, change binary").toLocalIterator():
            values = np.frombuffer(bytes(r["change"]), "<f4").reshape(-1, LINE)
            table[r["at"] : r["at"] + len(values)] += values
        model = Model(model.parent, model.total, table)
        held.destroy()
    return model


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts), most frequent first: as many of the classes of most frequent words as hold no more than `most`.

    A histogram of the counts finds the class to stop at, so no task and no partition sends more than is kept.
    """
    rank = F.floor(F.log2(F.col("n").cast("double")) * OCTAVE).cast("int")
    sizes = sorted(((r["rank"], r["kinds"]) for r in counts.groupBy(rank.alias("rank")).agg(F.count("*").alias("kinds")).collect()), reverse=True)
    least, held = None, 0
    for at, kinds in sizes:
        held += kinds
        if held > most:
            break
        least = at
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where(rank >= least).select("word", "n").toArrow()
    words, n = rows["word"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.lexsort((words, -n))
    return words[order], n[order]


def _score(held):
    """A mapInArrow function: a row for each text, with what the leaves give and the words of hashed leaves listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model, count, share_total, base_total = held.value
        hot = len(vocabulary.words)
        base_of, share_of = np.log10(count + 0.5) - np.log10(base_total), np.log10(share_total)
        for batch in sliced(batches, 2):
            codes, leaf, flat, at = token_codes(batch.column(2), vocabulary)
            known = leaf <= hot
            given = model.log_prob(codes, leaf) / np.log(10)
            given[~known] -= share_of[leaf[~known] - 1 - hot]
            base = np.zeros(len(leaf))
            base[known] = base_of[leaf[known]]
            total = lambda x: np.add.reduceat(x, at[:-1])
            rare = flat[~known]
            ends = np.cumsum(~known)[at[1:] - 1]
            lists = [np.unique(rare[a:b], return_counts=True) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)]
            sizes = pa.array(np.cumsum([0, *(len(w) for w, _ in lists)]), pa.int32())
            both = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(x).view(np.int64))) for x in zip(*lists, strict=True)]
            columns = [batch.column(0), batch.column(1), np.diff(at), total(known.astype(np.int64)) - (0 if count[END] else 1), total(base), total(given)]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *both], ["doc_id", "held_out", "n_tokens", "known", "base", "given", "rare", "times"])

    return run


def lm_scores(docs: DataFrame, *, folds: int = 5, rounds: int = 3, rate: float = 0.3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    held_out documents (crc32 of the doc_id as text, mod folds, is 1) are never learned from, nor are rows without
    doc_id (not held out, but scored). Null, empty and blank texts are one end token. base_score is the add-half
    unigram's log10 probability over counts of all training texts, score the model's; where nothing is to be learned
    from, score equals base_score. Repeated rows count each. Driver and tasks hold the weights, the most frequent words
    and the hashed leaves, which all grow as the square root of the number of different words; the other words meet
    their counts in a join, and none of those can be frequent there.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    training = docs.where("doc_id is not null and not held_out")
    counts = written(training.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    ends = training.count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, v_all = total + ends, kinds + (ends > 0)
    hot, tail, bits = sizes_for(kinds)
    words, n_words = frequent_words(counts, hot)
    vocabulary = Vocabulary(words, tail)
    count = np.concatenate([[ends], n_words]).astype(np.float64)
    shared = np.full(tail, 0.5)  # of a hashed leaf: its words' counts and a half each, and a half for an unknown word
    leaf = F.pmod(F.shiftrightunsigned("word", 16), F.lit(tail)).cast("int")
    for r in counts.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toLocalIterator():
        shared[r["leaf"]] += r["n"] + 0.5 * r["kinds"]
    np.subtract.at(shared, ((words >> np.uint64(16)) % np.uint64(tail)).astype(np.int64), count[1:] + 0.5)
    parts = training.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(rounds)).cast("int").alias("part"))
    model = Model.start(np.concatenate([count + 0.5, shared]), bits)
    if ends:
        model = train(parts, vocabulary, model, tasks=tasks_for(n_all), rounds=rounds, rate=rate)
    base_total = n_all + 0.5 * (v_all + 1)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, model, count, shared, base_total))
    scanned = docs.mapInArrow(_score(held), "doc_id long, held_out boolean, n_tokens long, known long, base double, given double, rare array<long>, times array<long>")
    rows = written(scanned.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("met"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("logs"))
    both = rows.drop("rare", "times").join(met, "row", "left").withColumns({"met": F.coalesce("met", F.lit(0)), "logs": F.coalesce("logs", F.lit(0.0))})
    first_end = 0 if ends else 1
    unknown = F.col("n_tokens") - F.col("known") - F.col("met") - first_end
    rest = F.col("logs") + unknown * F.lit(float(np.log10(0.5)))
    base = F.col("base") + rest - (F.col("met") + unknown) * F.lit(float(np.log10(base_total)))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("met")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("given") + rest if ends else base).alias("score"))


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
