"""Language ID by prediction by partial matching: a byte context tree per language, scores by exact code lengths.

A byte is coded in the longest context (the ORDER bytes before it, or fewer) that its tree holds. A context has seen n bytes, q of
them distinct: a byte seen c times has probability c / (n + q), the escape to the next shorter context q / (n + q) (method C).
After an escape the bytes of the longer context are excluded; below order 0 all bytes left are alike. A text's code length is
the sum over its bytes, its first ones after newlines. Trees are frozen: scoring changes no count.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import discard, free_name, worker_cache, written
from .toxicity import held_out
from .words import bytes_of, slices

ORDER = 4
#: The model's bound: so many (context, byte) entries over all languages, an equal share each, those seen most often.
MOST_ENTRIES = 1 << 20
#: Costs that a worker keeps, in numbers (distinct windows times languages).
MOST_KEPT = 1 << 22
#: Windows of a task that are counted before they are handed on.
MOST_COUNTED = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def windows(data: np.ndarray, offsets: np.ndarray, order: int = ORDER, part: int = 1 << 18):
    """(texts, windows) of runs of bytes: the text of each byte, and the order bytes before it and itself as a number, the byte lowest.

    Newlines stand before a text. A run has at most part bytes, however long a text is.
    """
    for a in range(0, len(data), part):
        at = np.arange(a, min(a + part, len(data)))
        text = np.searchsorted(offsets, at, "right") - 1
        begin = offsets[text]
        out = data[at].astype(np.int64)
        for j in range(1, order + 1):
            out |= np.where(at - j < begin, 0x0A, data[np.maximum(at - j, 0)]).astype(np.int64) << (8 * j)
        yield text, out


def _mask(k: int) -> int:
    return (1 << (8 * k)) - 1


@dataclass
class Tree:
    """Per order k: grams (k context bytes and the byte), their counts; contexts, with n, q, and what a byte of their suffix is out of after an escape (den, q left)."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    n: list[np.ndarray]
    q: list[np.ndarray]
    den: list[np.ndarray]
    left: list[np.ndarray]

    @classmethod
    def of(cls, grams: list[np.ndarray], counts: list[np.ndarray]) -> "Tree":
        """From the entries of every order; an entry's suffix is an entry, too."""
        tree = cls([], [], [], [], [], [], [])
        for k, (g, c) in enumerate(zip(grams, counts)):
            by = np.argsort(g)
            g, c = g[by], c[by].astype(np.int64)
            contexts, inverse = np.unique(g >> 8, return_inverse=True)
            n = np.bincount(inverse, c, len(contexts)).astype(np.int64)
            q = np.bincount(inverse, minlength=len(contexts))
            den, left = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
            if k and len(g):
                shorter = tree.counts[k - 1][np.searchsorted(tree.grams[k - 1], g & _mask(k))]
                at = np.searchsorted(tree.contexts[k - 1], contexts & _mask(k - 1))
                left = tree.q[k - 1][at] - q
                den = tree.n[k - 1][at] - np.bincount(inverse, shorter, len(contexts)).astype(np.int64) + left
            for held, new in zip((tree.grams, tree.counts, tree.contexts, tree.n, tree.q, tree.den, tree.left), (g, c, contexts, n, q, den, left)):
                held.append(new)
        return tree

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each window, in bits."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        den, left = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64)
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(self.contexts[k]):
                continue
            u = codes[open_] & _mask(k + 1)
            at = np.minimum(np.searchsorted(self.contexts[k], u >> 8), len(self.contexts[k]) - 1)
            here = self.contexts[k][at] == u >> 8
            i, u, at = open_[here], u[here], at[here]
            first = den[i] < 0
            d, e = np.where(first, self.n[k][at] + self.q[k][at], den[i]), np.where(first, self.q[k][at], left[i])
            g = np.minimum(np.searchsorted(self.grams[k], u), len(self.grams[k]) - 1)
            hit = self.grams[k][g] == u
            out[i[hit]] += np.log2(d[hit] / self.counts[k][g[hit]])
            some = ~hit & (e > 0)  # none left after the exclusions: the escape is certain
            out[i[some]] += np.log2(d[some] / e[some])
            den[i], left[i] = self.den[k][at], self.left[k][at]
            closed = np.zeros(len(codes), bool)
            closed[i[hit]] = True
            open_ = open_[~closed[open_]]
        if len(open_):
            out[open_] += np.log2(256 - (self.q[0][0] if len(self.q[0]) else 0))
        return out


@dataclass
class Model:
    """languages in order, a tree each."""

    languages: list[str]
    trees: list[Tree]
    order: int = ORDER


class Costs:
    """A worker's table of the windows met so far: a row of code lengths, one for each language. A full table is emptied."""

    def __init__(self, model: Model):
        self.model = model
        self.most = max(1 << 12, MOST_KEPT // max(1, len(model.languages)))
        self._empty(1 << 13)

    def _empty(self, slots: int) -> None:
        self.bits = slots.bit_length() - 1
        self.keys, self.rows = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
        self.held, self.costs = 0, np.zeros((slots // 2, len(self.model.languages)))

    def _find(self, codes: np.ndarray) -> np.ndarray:
        """The slot of each window, or -1 - slot of the free place for it."""
        at = ((codes.astype(np.uint64) * _PRIME) >> np.uint64(64 - self.bits)).astype(np.int64)
        found, open_ = np.empty(len(codes), np.int64), np.arange(len(codes))
        while len(open_):
            here = self.keys[at]
            hit, free = here == codes[open_], here == -1
            found[open_] = np.where(hit, at, -1 - at)
            rest = ~(hit | free)
            open_, at = open_[rest], (at[rest] + 1) & (len(self.keys) - 1)
        return found

    def _insert(self, codes: np.ndarray, rows: np.ndarray) -> None:
        while len(codes):
            at = -1 - self._find(codes)
            won = np.unique(at, return_index=True)[1]
            self.keys[at[won]], self.rows[at[won]] = codes[won], rows[won]
            lost = np.ones(len(codes), bool)
            lost[won] = False
            codes, rows = codes[lost], rows[lost]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """A row of costs for each window, by its number in self.costs."""
        slots = self._find(codes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh = np.unique(codes[new])
            if self.held + len(fresh) > self.most:
                self._empty(1 << 13)
                fresh = np.unique(codes)
            need = self.held + len(fresh)
            if 2 * need > len(self.keys):
                used = self.keys >= 0
                old, rows, held, costs = self.keys[used], self.rows[used], self.held, self.costs
                self._empty(1 << (4 * need).bit_length())
                self.costs[:held], self.held = costs[:held], held
                self._insert(old, rows)
            for i, tree in enumerate(self.model.trees):
                self.costs[self.held : need, i] = tree.bits(fresh)
            self._insert(fresh, np.arange(self.held, need, dtype=np.int32))
            self.held = need
            slots = self._find(codes)
        return self.rows[slots]

    def lengths(self, column) -> np.ndarray:
        """Code lengths in bits of each text of an Arrow string column under each language; a null text has no bytes."""
        data, offsets = bytes_of(column)
        out = np.zeros((len(column), len(self.model.languages)))
        for text, codes in windows(data, offsets, self.model.order):
            rows, low = self.of(codes), text[0]
            for i in range(out.shape[1]):
                got = np.bincount(text - low, self.costs[rows, i])
                out[low : low + len(got), i] += got
        return out


def counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, gram, c) over all rows (lang, text): how often each byte followed each context of k bytes; sums of tasks first."""

    def counted(parts):
        import pyarrow as pa

        kept, held = {}, 0

        def given(lang, u, c):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u), pa.array(c)], ["lang", "gram", "c"])

        for batch in parts:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                texts = batch.column(1).take(np.flatnonzero(langs == lang))
                for _, codes in windows(*bytes_of(texts), order, 1 << 20):
                    u, c = np.unique(codes, return_counts=True)
                    kept.setdefault(lang, []).append((u, c))
                    held += len(u)
            if held > MOST_COUNTED:
                held = 0
                for lang, found in kept.items():
                    kept[lang] = [_summed(found)]
                    held += len(kept[lang][0][0])
                if held > MOST_COUNTED // 2:
                    for lang, found in kept.items():
                        yield given(lang, *found[0])
                    kept, held = {}, 0
        for lang, found in kept.items():
            yield given(lang, *_summed(found))

    longest = rows.mapInArrow(counted, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    longest = written(longest, "windows")
    each = longest.select("lang", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"), "gram", "c")
    mask = F.element_at(F.array(*(F.lit(_mask(k + 1)) for k in range(order + 1))), F.col("k") + 1)
    found = written(each.groupBy("lang", "k", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum("c").alias("c")), "contexts")
    discard(longest)
    return found


def _summed(found: list) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate([f[1] for f in found]), len(u)).astype(np.int64)


def fit(rows: DataFrame, order: int = ORDER, most: int = MOST_ENTRIES) -> Model:
    """Trees from all rows (lang, text); rows without language or text teach nothing.

    Counts cover every row; a tree then holds at most most / languages entries: those seen t times or more, with the least t that
    fits, so that suffixes of entries are entries. Code lengths are those under the trees as held.
    """
    found = counts(rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"), order)
    # counts in steps of 2 %: languages times some 2,200 rows at most, whatever the corpus
    step = F.floor(F.log(F.col("c").cast("double")) * 50)
    spread = written(found.groupBy("lang", step.alias("step")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("entries")), "spread")
    n = spread.select("lang").distinct().count()
    if n > most // 256:
        raise ValueError(f"{n} languages leave no room for a tree each among {most} entries")
    steps = spread.toArrow().to_pandas().sort_values(["lang", "c"], ascending=[True, False])
    discard(spread)
    steps = steps[steps.groupby("lang")["entries"].cumsum() <= most // max(1, n)]
    least = steps.groupby("lang")["c"].min()
    languages = [str(x) for x in least.index]
    given = found.sparkSession.createDataFrame([(x, int(t)) for x, t in least.items()], "lang string, t long")
    held = found.join(F.broadcast(given), "lang").where("c >= t").select("lang", "k", "gram", "c").toArrow()  # `most` rows at most
    discard(found)
    lang, k, gram, c = (held.column(i).to_numpy() for i in range(4))
    trees = []
    for name in languages:
        own = [(lang == name) & (k == i) for i in range(order + 1)]
        trees.append(Tree.of([gram[o] for o in own], [c[o] for o in own]))
    return Model(languages, trees, order)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language of the least code length and its posterior probability, all languages alike before.

    Whole texts count, however long. A null text, or one without a letter, is `und` with score 0, and so is any text where no
    language was learned; of equal lengths the language first in order wins. Columns with these names are replaced;
    repeated rows are scored apart.
    """
    lang_name, score_name = names
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    docs = docs.drop(*names)
    columns = docs.columns
    docs = docs.select("*", letters.alias(free_name([*columns, *names], "has_letter")))
    given, stamp = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(parts):
        import pyarrow as pa

        kept = worker_cache("langid")
        if stamp not in kept:  # costs of another model go
            kept.clear()
            kept[stamp] = Costs(given.value)
        costs, languages = kept[stamp], np.array([*given.value.languages, "und"], object)
        for batch in parts:
            texts = batch.column(columns.index(text))
            known = batch.column(len(columns)).to_numpy(zero_copy_only=False).astype(bool) & bool(len(given.value.languages))
            best, score = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
            if len(given.value.languages):
                for a, b in slices(texts):
                    bits = costs.lengths(texts.slice(a, b - a))
                    best[a:b] = bits.argmin(axis=1)
                    score[a:b] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            best, score = np.where(known, best, len(languages) - 1), np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages[best], pa.string()), pa.array(score)], [*columns, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields[:-1]]).add(lang_name, StringType()).add(score_name, DoubleType()))


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(lang, text) of the rows that are not held out."""
    return docs.where(~held_out(F.col(key))).select("lang", "text")
