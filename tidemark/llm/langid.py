"""Language identification by cross-parsing.

For each language a suffix automaton is built over labelled text. Another text is parsed against it greedily: follow
the automaton as far as it goes, end the phrase, start again. The number of phrases per symbol estimates the cross
entropy between text and language; the language with fewest phrases wins.

Learning reads a bounded sample: per language the PER_LANGUAGE labelled documents of smallest hash, and of their
text the first SYMBOLS symbols. Prediction parses whole texts. Text is reduced to lower-case letters and single
separators. All texts of a batch are cut into blocks of BLOCK symbols, and one numpy step moves every block of every
text by one symbol. Blocks are parsed as if a phrase began with them, then again from where the block before ended, up
to the first symbol at which both begin a phrase: from there they are the same. Phrases thus cross blocks freely, and
the counts are those of a parse of the whole text. Every learned letter is a symbol of its own; a language's table is
dense over its own letters where that takes at most DENSE entries, and a hash table of its edges otherwise.

The sample takes at most SYMBOLS characters of a language several times over, some 100 KB; it grows with the number of
languages only.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a language without a learned letter
isn't learned; without any learned language all are ``und``; ties go to the smaller language name; repeated rows get
equal answers; an empty table gives an empty table; clashing extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import PairTable
from .common import map_arrow, slices, utf8

PER_LANGUAGE = 64
SYMBOLS = 40_000
BLOCK = 256
SLICE = 1 << 21
#: Entries of a language's dense table, at most.
DENSE = 1 << 23
HELD_OUT = 1


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def _letters() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane, 0 for others."""
    out = np.zeros(65536, np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0])
    return out


_LETTERS = None


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters (code points, lower case) and 0 for separators of the texts, runs of separators as one, and the
    number of each text."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _letters()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _LETTERS[np.minimum(points, 65535)]
    for i in np.flatnonzero(points > 65535).tolist():
        found[i] = points[i] if chr(points[i]).isalpha() else 0
    owner = np.repeat(np.arange(len(texts)), size)
    keep = found != 0
    if len(keep):
        after = np.concatenate([[False], (found[:-1] != 0) & (owner[1:] == owner[:-1])])
        keep |= after  # one separator after a word
    return found[keep], np.bincount(owner[keep], minlength=len(texts)).astype(np.int64)


class Automaton:
    """Suffix automaton of a sequence of classes below ``alphabet``; further classes are letters it doesn't have.

    A step gives the next state * 4 + the phrases that began with the symbol: where the automaton has no edge, the
    symbol begins a phrase at the root, state 0; a letter that it doesn't have is two, an escape and itself.
    """

    def __init__(self, text: list[int], alphabet: int):
        edges: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            now = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in edges[at]:
                edges[at][c] = now
                at = link[at]
            if at >= 0:
                to = edges[at][c]
                if length[at] + 1 == length[to]:
                    link[now] = to
                else:
                    clone = len(edges)
                    edges.append(dict(edges[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and edges[at].get(c) == to:
                        edges[at][c] = clone
                        at = link[at]
                    link[to] = link[now] = clone
            last = now
        self.width = alphabet + 1
        self.root = np.full(self.width, 2, np.int32)
        for c, to in edges[0].items():
            self.root[c] = to * 4 + 1
        owner = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
        cls = np.fromiter((c for e in edges for c in e), np.int64, len(owner))
        to = np.fromiter((t for e in edges for t in e.values()), np.int64, len(owner))
        inner = owner > 0
        owner, cls, to = owner[inner], cls[inner], to[inner]
        self.table = self.pairs = None
        if len(edges) * self.width <= DENSE:
            table = np.tile(self.root, (len(edges), 1))
            table[owner, cls] = to * 4
            self.table = table.ravel()
            self.cells = memoryview(self.table)
        else:
            self.pairs = PairTable(owner.astype(np.uint64) << np.uint64(32) | cls.astype(np.uint64), to.astype(np.int32))
            self.edges = edges

    def step(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + cls]
        to = self.pairs(state, cls)
        return np.where(to >= 0, to * 4, self.root[cls])

    def one(self, state: int, cls: int) -> int:
        if self.table is not None:
            return self.cells[state * self.width + cls]
        to = self.edges[state].get(cls, -1) if state else -1
        return to * 4 if to >= 0 else int(self.root[cls])


class Blocks:
    """Texts of classes cut into blocks, longest first: columns[t, k] is symbol t of block order[k]."""

    def __init__(self, classes: np.ndarray, size: np.ndarray):
        blocks = -(-size // BLOCK)
        self.texts = len(size)
        self.owner = np.repeat(np.arange(len(size)), blocks)
        n = len(self.owner)
        self.first = np.repeat(np.cumsum(blocks) - blocks, blocks) == np.arange(n)  # whether a text begins with the block
        inner = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(np.repeat(size, blocks) - inner * BLOCK, BLOCK)
        matrix = np.zeros((n, BLOCK), classes.dtype)
        matrix[np.arange(BLOCK)[None, :] < length[:, None]] = classes  # blocks lie in text order, so row-major is text order
        self.order = np.argsort(-length, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.length = length[self.order]
        self.columns = np.ascontiguousarray(matrix[self.order].T)
        self.live = np.searchsorted(-self.length, -np.arange(1, BLOCK + 1), side="right").tolist()

    def phrases(self, automaton: Automaton, local: np.ndarray) -> np.ndarray:
        """Phrases of each text."""
        n = len(self.order)
        state, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        began = np.zeros((BLOCK, n), np.int8)  # phrases that begin with a symbol
        for t, k in enumerate(self.live):
            if not k:
                break
            step = automaton.step(state[:k], local[self.columns[t, :k]])
            began[t, :k] = step & 3
            count[:k] += step & 3
            state[:k] = step >> 2
        # again from the state in which the block before ended
        later = np.flatnonzero(~self.first)
        entry, at = state[self.place[later - 1]], self.place[later]
        at, entry = at[entry != 0], entry[entry != 0]
        leaves = np.full(n, -1, np.int64)  # the state in which a block ends, where it isn't the one found first
        for t in range(BLOCK):
            if not len(at):
                break
            step = automaton.step(entry, local[self.columns[t, at]])
            new, old = step & 3, began[t, at]
            count[at] += new - old
            entry, met = step >> 2, (new > 0) & (old > 0)
            ends = ~met & (self.length[at] == t + 1) & (entry != state[at])
            leaves[at[ends]] = entry[ends]
            on = ~met & (self.length[at] > t + 1)
            at, entry = at[on], entry[on]
        # what still differs at the end of its block goes on, symbol by symbol
        done = 0
        for b in np.sort(self.order[leaves >= 0]).tolist():
            while b >= done and leaves[self.place[b]] >= 0 and b + 1 < n and not self.first[b + 1]:
                now, b = int(leaves[self.place[b]]), b + 1
                k = self.place[b]
                m = int(self.length[k])
                symbols_, old = local[self.columns[:m, k]].tolist(), began[:m, k].tolist()
                total, same = 0, False
                for t in range(m):
                    step = automaton.one(now, symbols_[t])
                    total, now = total + (step & 3), step >> 2
                    if step & 3 and old[t]:
                        total, same = total + sum(old[t + 1 :]), True
                        break
                count[k] = total
                leaves[k] = -1 if same or now == state[k] else now
                if leaves[k] < 0:
                    done = b + 1
        return np.bincount(self.owner[self.order], weights=count, minlength=self.texts).astype(np.int64)


class Model:
    """Automata of the learned languages."""

    def __init__(self, samples: dict[str, list[str]]):
        parts = {lang: symbols(texts)[0][:SYMBOLS] for lang, texts in sorted(samples.items())}
        parts = {lang: x for lang, x in parts.items() if (x != 0).any()}
        self.languages = list(parts)
        points = np.unique(np.concatenate([np.zeros(1, np.uint32), *parts.values()]))  # the separator is class 0
        self.lookup = np.full(0x110000, len(points), np.uint16 if len(points) < 65535 else np.int32)  # the last: never seen
        self.lookup[points] = np.arange(len(points))
        self.automata, self.local = [], []
        for x in parts.values():
            own, classes = np.unique(self.lookup[x], return_inverse=True)
            local = np.full(len(points) + 1, len(own), np.int64)
            local[own] = np.arange(len(own))
            self.local.append(local)
            self.automata.append(Automaton(classes.tolist(), len(own)))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of each text, whether it has a letter, and phrases by text and language."""
        found, size = symbols(texts)
        cut = Blocks(self.lookup[found], size)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        for k, (automaton, local) in enumerate(zip(self.automata, self.local, strict=True)):
            counts[:, k] = cut.phrases(automaton, local)
        has = np.bincount(np.repeat(np.arange(len(texts)), size)[found != 0], minlength=len(texts)) > 0
        return size, has, counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: how far, of the runner-up's phrases, the winner stays below it."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        size, has, counts = self.phrases(texts)
        rate = counts / np.maximum(size, 1)[:, None]
        best = rate.argmin(axis=1)
        each = np.arange(len(texts))
        first = rate[each, best]
        if len(self.languages) > 1:
            rest = rate.copy()
            rest[each, best] = np.inf
            second = rest.min(axis=1)
            score = np.where(second > 0, 1 - first / np.maximum(second, 1e-12), 0.0)
        else:
            score = np.ones(len(texts))
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, np.clip(score, 0, 1), 0.0)


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The bounded sample: for each language the texts of its per_language smallest hashed ids.

    Candidates are ranked without their texts; each task keeps at most per_language of a language before anything
    is shuffled. Texts are cut to SYMBOLS characters before they reach the driver.
    """
    keyed = labelled.where(f"`{lang_col}` is not null and `{text_col}` is not null").select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.xxhash64(id_col).alias("h"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))
    chosen = keyed.withColumn("r", rank).where(F.col("r") <= per_language).select("i", "l").distinct()
    texts = labelled.select(F.col(id_col).alias("i"), F.substring(text_col, 1, SYMBOLS).alias("t"), F.col(lang_col).alias("l"))
    rows = texts.join(F.broadcast(chosen), ["i", "l"], "left_semi").collect()  # per_language ids of each language
    sample: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["l"], zlib.crc32(str(r["i"]).encode()), r["i"])):
        sample.setdefault(row["l"], []).append(row["t"])
    for lang, parts in sample.items():  # no more than the automaton will read
        total, kept = 0, []
        for part in parts:
            if total < 2 * SYMBOLS:
                kept.append(part)
                total += len(part)
        sample[lang] = kept
    return sample


_MODELS: dict[int, Model] = {}


def identify(docs: DataFrame, sample: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of every whole text. The sample is bounded, and each worker builds its automata once."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(sample)
    name = zlib.crc32(repr(sorted(sample.items())).encode())

    def run(batches):
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Model(shared.value)
        model = _MODELS[name]
        for batch in batches:
            _, at = utf8(batch.column(1))
            for lo, hi in slices(np.diff(at), SLICE):
                langs, score = model.predict([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return map_arrow(docs.select(f"`{id_col}`", f"`{text_col}`"), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
