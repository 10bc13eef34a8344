"""Words of scripts without spaces: the best path through a lattice of dictionary words.

A run of characters is cut where a model of single words makes it most likely: each word has a cost (the
negative logarithm of its probability, in thousandths), and the cut of least total cost is found by dynamic
programming over the places of the run. The model is made of the corpus alone: substrings that occur often
are candidates, and rounds of expectation and maximisation replace their counts by soft counts, the
number of times that a word is expected in all cuts of all runs. Runs are counted once for each distinct
one, and both passes treat a batch of runs place by place, so that numpy works on all of them at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.functions import text
from topicloom.store import staged

#: Characters of scripts that are written without spaces; those of Korean have spaces.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー"
#: Languages whose questions are cut.
LANGUAGES = ("zh", "zh_cn", "zh_tw", "ja", "japanese")
#: Letters of a word, words of a model, and occurrences of a candidate, at most, at most and at least.
LONGEST, WORDS, LEAST = 4, 1 << 17, 3
#: Thousandths of a natural logarithm that a character costs which the model doesn't hold; more than any word of it.
UNKNOWN = 40_000
#: Thousandths by which a word must cost less than its best cut into others, else it goes: a chance meeting of words is none.
GAIN = 1500
#: Cells of the tables of a batch: runs times places.
CELLS = 1 << 18
#: Runs of texts that are looked up at once, and runs whose cuts a worker remembers, none of them longer than so many letters.
RUNS, MET, SHORT = 1 << 18, 1 << 16, 32


def runs(texts: DataFrame, column: str = "text", script: str = UNSPACED) -> DataFrame:
    """``(run, n)``: the distinct maximal runs of the script's characters with their numbers."""
    cut = F.split(F.col(column), f"[^{script}]+")
    return texts.select(F.explode(cut).alias("run")).where("run <> ''").groupBy("run").agg(F.count("*").alias("n"))


def candidates(runs_: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``(word, cnt)``: substrings of up to ``longest`` characters that occur ``least`` times or more, and all single characters."""

    def of(m):
        starts = F.when(F.length("run") >= m, F.sequence(F.lit(1), F.length("run") - (m - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring("run", i, F.lit(m)))

    parts = F.flatten(F.array(*[of(m) for m in range(1, longest + 1)]))
    found = runs_.select(F.explode(parts).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("cnt"))
    return found.where((F.col("cnt") >= least) | (F.length("word") == 1))


def costs(counts: DataFrame, size: int = WORDS) -> DataFrame:
    """``(word, cost int)`` of ``counts(word, cnt)``: thousandths of ln(characters / cnt); the ``size`` words that cover most characters, single characters first.

    ``size`` is the model's size, so that a task can hold it.
    """
    single = F.length("word") == 1
    kept = counts.orderBy(single.desc(), (F.col("cnt") * F.length("word")).desc(), "word").limit(size)
    total = counts.agg(F.sum(F.when(single, F.col("cnt"))).alias("_all"))
    cost = F.round(F.log(F.col("_all") / F.col("cnt")) * 1000).cast("int")
    return kept.crossJoin(F.broadcast(total)).select("word", F.greatest(F.lit(1), F.least(cost, F.lit(UNKNOWN - 1))).alias("cost"))  # one row


class Lattice:
    """A model in a form that numpy can look up: a trie whose edges are sorted numbers, node times alphabet plus letter."""

    def __init__(self, words: list[str], cost: np.ndarray):
        letters = sorted({c for w in words for c in w})
        self.words, self.cost = words, np.append(np.asarray(cost, float), UNKNOWN)
        self.letters = np.array([ord(c) for c in letters], np.int64)
        self.size, self.longest = len(letters) + 1, max(map(len, words), default=1)
        at = {c: i for i, c in enumerate(letters)}
        nodes, edges, ends = {"": 0}, [], {}
        for w in sorted(words):
            for i in range(1, len(w) + 1):
                if w[:i] not in nodes:
                    nodes[w[:i]] = len(nodes)
                    edges.append((nodes[w[: i - 1]] * self.size + at[w[i - 1]], nodes[w[:i]]))
        for k, w in enumerate(words):
            ends[nodes[w]] = k
        edges.sort()
        self.edges = np.array([e for e, _ in edges], np.int64)
        self.to = np.array([t for _, t in edges], np.int64)
        self.word = np.full(len(nodes), -1, np.int64)
        self.word[list(ends)] = list(ends.values())

    def table(self, runs_: list[str]):
        """Numbers of the words that start at each place, ``(run, place, letters - 1)``; -1 for none, and the place's unknown character is ``len(words)``."""
        width = max(map(len, runs_))
        data = np.zeros((len(runs_), width + self.longest), np.uint32)
        for i, r in enumerate(runs_):
            data[i, : len(r)] = np.frombuffer(r.encode("utf-32-le"), np.uint32)
        code = data.astype(np.int64)
        at = np.searchsorted(self.letters, code)
        letter = np.where((at < len(self.letters)) & (self.letters[np.minimum(at, len(self.letters) - 1)] == code), at, self.size - 1) if len(self.letters) else np.full(code.shape, self.size - 1)
        node = np.zeros((len(runs_), width), np.int64)
        out = np.full((len(runs_), width, self.longest), -1, np.int64)
        for k in range(self.longest):
            key = node * self.size + letter[:, k : k + width]
            e = np.minimum(np.searchsorted(self.edges, key), max(len(self.edges) - 1, 0))
            there = (node >= 0) & (self.edges[e] == key) if len(self.edges) else np.zeros(node.shape, bool)
            node = np.where(there, self.to[e] if len(self.edges) else -1, -1)
            out[:, :, k] = np.where(node >= 0, self.word[node], -1)
        real = np.arange(width)[None, :] < np.array([len(r) for r in runs_])[:, None]
        out[:, :, 0] = np.where(real & (out[:, :, 0] < 0), len(self.words), out[:, :, 0])
        return out

    def _batches(self, runs_: list[str]):
        """Places of runs in the list, longest first, in batches of bounded tables."""
        order = sorted((i for i, r in enumerate(runs_) if r), key=lambda i: -len(runs_[i]))
        at = 0
        while at < len(order):
            n = max(1, CELLS // (len(runs_[order[at]]) + self.longest))
            yield order[at : at + n]
            at += n

    def cut(self, runs_: list[str]) -> list[list[str]]:
        """The words of each run on its path of least cost; of equal paths, the one whose last word is longest, and so on backwards."""
        out: list[list[str]] = [[] for _ in runs_]
        for places in self._batches(runs_):
            own = [runs_[i] for i in places]
            lengths = np.array([len(r) for r in own])
            table = self.table(own)
            best = np.full((len(own), table.shape[1] + 1), np.inf)
            best[:, 0] = 0
            back = np.zeros(best.shape, np.int64)
            for t in range(1, best.shape[1]):
                n = int(np.searchsorted(-lengths, -t, side="right"))  # runs that reach this place
                for k in range(min(self.longest, t), 0, -1):
                    w = table[:n, t - k, k - 1]
                    c = np.where(w >= 0, best[:n, t - k] + self.cost[w], np.inf)
                    better = c < best[:n, t]
                    best[:n, t][better] = c[better]
                    back[:n, t][better] = k
            for row, (i, r) in enumerate(zip(places, own, strict=True)):
                t, words = len(r), []
                steps = back[row]
                while t:
                    k = int(steps[t])
                    words.append(r[t - k : t])
                    t -= k
                out[i] = words[::-1]
        return out

    def savings(self, words: list[str]) -> np.ndarray:
        """What each word of the model costs less than the best cut of it into others."""
        out = np.full(len(words), np.inf)
        at = {w: i for i, w in enumerate(self.words)}
        one = lambda c: self.cost[at.get(c, len(self.words))] if len(c) == 1 or c in at else np.inf
        for i, w in enumerate(words):
            if len(w) > 1:
                best = [0.0]
                for t in range(1, len(w) + 1):
                    best.append(min(best[t - k] + one(w[t - k : t]) for k in range(1, t + 1) if k < len(w)))
                out[i] = best[-1] - one(w)
        return out

    def soft(self, runs_: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected numbers of each word, unknown characters last, over all cuts of all runs."""
        out = np.zeros(len(self.words) + 1)
        logp = -self.cost / 1000
        for places in self._batches(runs_):
            own = [runs_[i] for i in places]
            lengths = np.array([len(r) for r in own])
            table = self.table(own)
            width, rows = table.shape[1], np.arange(len(own))
            p = np.where(table >= 0, logp[table], -np.inf)
            ahead = np.full((len(own), width + 1), -np.inf)
            ahead[:, 0] = 0
            for t in range(1, width + 1):
                n = int(np.searchsorted(-lengths, -t, side="right"))
                ks = range(1, min(self.longest, t) + 1)
                ahead[:n, t] = np.logaddexp.reduce([ahead[:n, t - k] + p[:n, t - k, k - 1] for k in ks])
            after = np.full((len(own), width + self.longest + 1), -np.inf)
            after[rows, lengths] = 0
            for t in range(width - 1, -1, -1):
                n = int(np.searchsorted(-lengths, -t, side="left"))  # runs that go on here
                after[:n, t] = np.logaddexp.reduce([p[:n, t, k - 1] + after[:n, t + k] for k in range(1, self.longest + 1)])
            every = ahead[rows, lengths][:, None]
            w = np.asarray(weights, float)[places][:, None]
            for k in range(1, self.longest + 1):
                share = np.exp(ahead[:, :width] + p[:, :, k - 1] + after[:, k : k + width] - every) * w
                there = table[:, :, k - 1] >= 0
                out += np.bincount(table[:, :, k - 1][there], share[there], minlength=len(out))
        return out


def _held(model: DataFrame) -> Lattice:
    """A model of bounded size on the driver, to be sent to tasks."""
    rows = model.select("word", "cost").orderBy("word").toArrow()
    return Lattice(rows["word"].to_pylist(), rows["cost"].to_numpy())


def soft_counts(runs_: DataFrame, model: DataFrame) -> DataFrame:
    """``(word, cnt double)``: the expected number of each word of ``model(word, cost)`` over all cuts of ``runs_(run, n)``.

    A task adds up its own runs and sends a row for each word once.
    """
    held = runs_.sparkSession.sparkContext.broadcast(_held(model))

    def count(batches):
        lattice = held.value
        total = np.zeros(len(lattice.words) + 1)
        for batch in batches:
            if batch.num_rows:
                total += lattice.soft(batch.column(0).to_pylist(), batch.column(1).to_numpy())
        found = np.nonzero(total[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array([lattice.words[i] for i in found], pa.string()), pa.array(total[found])], ["word", "cnt"])

    return runs_.select("run", "n").mapInArrow(count, "word string, cnt double").groupBy("word").agg(F.sum("cnt").alias("cnt"))


def telling(model: DataFrame, gain: int = GAIN) -> DataFrame:
    """``model(word, cost)`` without the words that save less than ``gain`` against their best cut into others."""
    held = model.sparkSession.sparkContext.broadcast(_held(model))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.savings(batch.column(0).to_pylist()) >= gain))

    return model.select("word", "cost").mapInArrow(keep, "word string, cost int")


def learn(texts: DataFrame, column: str = "text", script: str = UNSPACED, longest: int = LONGEST, size: int = WORDS, least: int = LEAST, rounds: int = 3, gain: int = GAIN) -> DataFrame:
    """``(word, cost)``: a model of the texts' runs, by ``rounds`` of soft counts from the counts of substrings.

    A word of several characters goes if it is expected fewer than ``least`` times, or saves less than ``gain``
    against its parts. Texts without such runs give an empty model, by which every character is a word.
    """
    own = staged(runs(texts, column, script), "segment-runs")
    model = staged(costs(candidates(own, longest, least), size), "segment-model")
    singles = model.where(F.length("word") == 1).select("word")
    for _ in range(rounds):
        model = staged(telling(model, gain), "segment-model")
        soft = staged(soft_counts(own, model).where((F.col("cnt") >= least) | (F.length("word") == 1)), "segment-soft")
        total = soft.agg(F.sum("cnt").alias("_all"))
        cost = F.round(F.log(F.col("_all") / F.greatest("cnt", F.lit(1e-3))) * 1000).cast("int")
        next_ = soft.crossJoin(F.broadcast(total)).select("word", F.greatest(F.lit(1), F.least(cost, F.lit(UNKNOWN - 1))).alias("cost"))  # one row
        # a character that no cut has as a word is still one
        rest = singles.join(next_.select("word"), "word", "left_anti").select("word", F.lit(UNKNOWN - 1).alias("cost"))
        model = staged(next_.unionByName(rest), "segment-model")
    return model


def spaced(texts: Column, model: DataFrame, script: str = UNSPACED) -> Column:
    """The text with spaces between the words of its runs, and around them. Null stays null."""
    held = model.sparkSession.sparkContext.broadcast(_held(model))
    named = script.replace(r"\p{Is", r"\p{")

    def cut(column: pa.Array) -> pa.Array:
        import regex

        between = regex.compile(f"([{named}]+)")
        parts = [None if t is None else between.split(t) for t in column.to_pylist()]
        known = list(dict.fromkeys(r for p in parts if p for r in p[1::2]))
        words = dict(zip(known, map(" ".join, held.value.cut(known)), strict=True))
        return pa.array([None if p is None else "".join(f" {words[x]} " if i % 2 else x for i, x in enumerate(p)) for p in parts], pa.string())

    return arrow_udf(cut, "string")(texts)


def segmented(questions: DataFrame, model: DataFrame | None = None, script: str = UNSPACED) -> DataFrame:
    """``questions(question, normalized, ...)`` with words apart in ``normalized`` and in a column ``words`` of the question.

    What counts, matches and filters words then sees them. The model is learnt from the questions if none is given.
    """
    model = learn(questions, "normalized", script) if model is None else model
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return questions.withColumn("normalized", plain(spaced(F.col("normalized"), model, script))).withColumn("words", plain(F.regexp_replace(spaced(F.lower("question"), model, script), text.NON_WORD, " ")))


def document_words(docs: DataFrame, model: DataFrame, script: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``(key, words array<string>)``: the words of the script's runs of each text, in order; other characters only part runs. A null text has none.

    Texts stay in Arrow's form: only the distinct runs of some texts become Python strings, and a worker
    remembers few cuts, so its memory is that of a batch and doesn't grow with the input.
    """
    held = model.sparkSession.sparkContext.broadcast(_held(model))
    met: dict[str, list[str]] = {}

    def words_of(known: list[str]) -> pa.Array:
        """The words of distinct runs."""
        if len(met) + len(known) > MET:
            met.clear()
        new = [r for r in known if r not in met]
        own = dict(zip(new, held.value.cut(new), strict=True))
        out = pa.array([own[r] if r in own else met[r] for r in known], pa.list_(pa.string()))
        if len(met) + len(own) <= MET:
            met.update((r, w) for r, w in own.items() if len(r) <= SHORT)
        return out

    def part(column: pa.Array) -> pa.Array:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = column.flatten().dictionary_encode()
        found = words_of(coded.dictionary.to_pylist()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), found.flatten())

    def cut(column: pa.Array) -> pa.Array:
        column = column.cast(pa.list_(pa.string()))
        runs_before = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts, lo = [], 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(runs_before, (runs_before[lo - 1] if lo else 0) + RUNS, "right")))
            parts.append(part(column.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    found = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), f"[^{script}]+"), lambda r: r != "")
    return docs.select(F.col(key), arrow_udf(cut, "array<string>")(found).alias("words"))
