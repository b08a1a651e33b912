"""Operator 9: language-model scoring by online logistic context mixing.

A token is coded as a path of binary decisions to its class (a Huffman tree over 1,024 classes: the most frequent words have
one each, the others share the rest by hash) and, in a shared class, by its count there. Each decision has several bit
predictors, tables of counts addressed by hashed contexts: none, the class before, the two classes before, the word before.
Their log odds are summed with weights that a gate chooses by how much two of the contexts have seen; weights are learnt
online, by gradient steps on coding cost. While a text is scored, a scale and an offset of its mixed odds are learnt from its own
earlier decisions, and a last table refines the odds by what was seen at such odds and depth.
Counts come from all training texts but a tenth, weights and refinement from that tenth, so neither flatters the other. That
tenth is dealt by a hash of its rows into slices of a fixed size, each learnt from in a fixed order, and a text's own learning
starts anew, so no score depends on how rows are partitioned.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import blank_words, narrow, remove, segment_of, shared_folder, stored, summed_segments, table, texts, trim, vector_rows, word_hashes

ALPHA = 0.1
CLASSES, OWN = 1024, 512  # classes, and those with one word
TOP = 1 << 18  # words whose counts are sent to every task; the others are joined
SLOT_BITS, ORDERS = 19, 3  # size and number of the hashed tables
LEVELS, INPUTS = 5, ORDERS + 2  # gate levels of a context; inputs: order 0, the tables, a constant
BINS, DEPTHS = 33, 24
FIND_BITS = 20  # size of the table by which those words are found: a quarter of it is used
DISTINCT, TOKENS = 300_000, 1 << 20  # words whose counts a task holds, and tokens it holds uncounted
END = b" end"  # no word has a blank
SCALE = 1 << 20  # fixed point of what tasks report
SLICE = 1 << 15
ROWS = 500  # texts worked on at once
LEARN_BYTES = 2 << 20  # text of a slice from which weights are learnt
BLOCK, RATE = 512, 0.02  # decisions after which a text's scale and offset move, and how fast
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def fold(doc_id) -> int:
    return zlib.crc32(b"" if pd.isna(doc_id) else str(int(doc_id)).encode()) % 10


def slices(batches: Iterator[pd.DataFrame], wanted) -> Iterator[list[str | None]]:
    """Texts of the folds wanted, ROWS at most at a time."""
    for pdf in batches:
        held = [t for d, t in zip(pdf["doc_id"], texts(pdf["text"])) if wanted(fold(d))]
        for k in range(0, len(held), ROWS):
            yield held[k : k + ROWS]


def tokens(held: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text's followed by the end's; the number of tokens of each."""
    words, sizes = [], np.empty(len(held), np.int64)
    for k, text in enumerate(held):
        before = len(words)
        words += blank_words(text)
        words.append(END)
        sizes[k] = len(words) - before
    return word_hashes(words).view(np.int64), sizes


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each class's path in the flat arrays of tree nodes and bits (one more start ends the last)."""
    heap = [(float(w), k, k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    new = len(weights)
    while len(heap) > 1:
        (wa, _, a), (wb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (new, 0), (new, 1)
        heapq.heappush(heap, (wa + wb, new, new))
        new += 1
    starts, nodes, bits = [0], [], []
    for k in range(len(weights)):
        path, at = [], k
        while at in parent:
            at, bit = parent[at]
            path.append((at - len(weights), bit))
        for node, bit in reversed(path):
            nodes.append(node)
            bits.append(bit)
        starts.append(len(nodes))
    return np.array(starts, np.int64), np.array(nodes, np.int64), np.array(bits, np.int8)


class Code:
    """What tasks need to know of the words: counts of the frequent ones, classes, paths."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, class_counts: np.ndarray, class_words: np.ndarray):
        rank = np.empty(len(hashes), np.int64)
        rank[np.lexsort((hashes, -counts))] = np.arange(len(hashes))  # place by count
        own = np.where(rank < OWN, rank, -1)
        self.total, self.distinct = total, distinct
        self.log_total = np.log10(total + ALPHA * (distinct + 1))
        self.log_class = np.log10(class_counts + ALPHA * (class_words + 1))
        logs = np.log10(counts + ALPHA)
        # What is known of the frequent words, in the order given; last what holds for all others.
        self.hashes, self.own = np.append(hashes, 0), np.append(own, -1)
        self.base = np.append(logs - self.log_total, 0.0)
        self.inner = np.append(np.where(own < 0, logs - self.log_class[hashes & (CLASSES - OWN - 1)], 0.0), 0.0)
        # Each stands at the first free place from the one its hash names on.
        self.places = np.full(1 << FIND_BITS, -1, np.int32)
        left = np.arange(len(hashes), dtype=np.int32)
        at = self.place(hashes)
        while len(left):
            free = self.places[at] < 0
            self.places[at[free]] = left[free]
            out = self.places[at] != left
            left, at = left[out], (at[out] + 1) & ((1 << FIND_BITS) - 1)
        weights = np.concatenate([np.zeros(OWN), class_counts]) + 0.5
        weights[own[own >= 0]] += counts[own >= 0]
        self.starts, self.nodes, self.bits = huffman(weights)

    @staticmethod
    def place(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - FIND_BITS)).view(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the frequent words among the hashes, -1 for all others."""
        at = self.place(h)
        found = self.places[at]
        left = np.flatnonzero((found >= 0) & (self.hashes[found] != h))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << FIND_BITS) - 1)
            found[left] = self.places[at]
            on = (found[left] >= 0) & (self.hashes[found[left]] != h[left])
            left, at = left[on], at[on]
        return found

    def classes(self, h: np.ndarray, found: np.ndarray) -> np.ndarray:
        own = self.own[found]
        return np.where(own >= 0, own, OWN + (h & (CLASSES - OWN - 1)))


def neighbours(cls: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the class before, the class before that, the word before."""
    first = np.zeros(len(cls), bool)
    first[np.cumsum(sizes) - sizes] = True
    before = np.where(first, CLASSES, np.roll(cls, 1)).astype(np.uint64)
    return before, np.where(first, CLASSES, np.roll(before, 1)).astype(np.uint64), np.where(first, 0, np.roll(hashes, 1)).view(np.uint64)


def contexts(before: np.ndarray, second: np.ndarray | None = None, word: np.ndarray | None = None) -> list[np.ndarray]:
    """Contexts of the tables; of the first alone without the others."""
    return [before * M1] + ([] if second is None else [(before * M2 + second) * M1, word * M3 + M2])


def walk(code: Code, cls: np.ndarray, given: list[np.ndarray]) -> Iterator[tuple]:
    """For slices of the tokens: first token, bounds of each token's decisions, tree node, bit, depth, table slots of the contexts."""
    for a in range(0, len(cls), SLICE):
        c = cls[a : a + SLICE]
        start = code.starts[c]
        length = code.starts[c + 1] - start
        bounds = np.cumsum(length) - length
        depth = np.arange(int(length.sum())) - np.repeat(bounds, length)
        at = np.repeat(start, length) + depth
        node = code.nodes[at]
        mixed = (node.astype(np.uint64) + np.uint64(1)) * M3
        slots = []
        for x in given:
            y = np.repeat(x[a : a + SLICE], length)
            y ^= mixed
            y *= M1
            y >>= np.uint64(64 - SLOT_BITS)
            slots.append(y.view(np.int64))
        yield a, bounds, node, code.bits[at], np.minimum(depth, DEPTHS - 1), slots


def decisions(code: Code, cls: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    """walk() through whole texts with all their contexts."""
    return walk(code, cls, contexts(*neighbours(cls, hashes, sizes)))


class Seen:
    """Counts of bits by order 0 and table from the texts of a task.

    Order 0 and the first table know of a token its class and the class before, so pairs are counted and each one's path is walked once.
    """

    def __init__(self, code: Code):
        self.code, self.tables = code, [np.zeros(2 * CLASSES, np.int64)] + [np.zeros(2 << SLOT_BITS, np.int64) for _ in range(ORDERS)]
        self.pairs = np.zeros((CLASSES + 1) * CLASSES, np.int64)
        self.held: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]

    def add(self, cls: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> None:
        before, second, word = neighbours(cls, hashes, sizes)
        self.held[0].append(before.view(np.int64) * CLASSES + cls)
        for _, _, _, bit, _, slots in walk(self.code, cls, contexts(before, second, word)[1:]):
            for places, at in zip(self.held[1:], slots):
                places.append(2 * at + bit)
            if sum(map(len, self.held[1])) >= TOKENS:
                self.count()

    def count(self) -> None:
        for table, places in zip([self.pairs, *self.tables[2:]], self.held):
            if places:
                table += np.bincount(np.concatenate(places), minlength=len(table))
                places.clear()

    def all(self) -> list[np.ndarray]:
        self.count()
        used = np.flatnonzero(self.pairs)
        before, cls = np.divmod(used, CLASSES)
        for a, bounds, node, bit, _, slots in walk(self.code, cls, contexts(before.astype(np.uint64))):
            times = np.repeat(self.pairs[used[a : a + len(bounds)]], np.diff(np.append(bounds, len(node))))
            for table, at in zip(self.tables, [node, slots[0]]):
                np.add.at(table, 2 * at + bit, times)
        return self.tables


class Own:
    """What the texts of a batch learn of themselves while they are scored: a scale and an offset of the mixed odds of each."""

    def __init__(self, decisions: np.ndarray):
        """decisions: how many each text has."""
        n = len(decisions)
        self.long = decisions > BLOCK  # shorter texts are over before their first step
        self.scale, self.offset = np.ones(n), np.zeros(n)
        self.pull, self.push, self.held = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)

    def adapt(self, t: np.ndarray, bit: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The odds of decisions in coding order, who's text is whose, as the texts' own learning moves them: the same for all of a
        block, which then takes one gradient step on its coding cost."""
        edge = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
        size, text = np.diff(np.append(edge, len(who))), who[edge]
        edge, size, text = (x[self.long[text]] for x in (edge, size, text))
        if not len(text):
            return t
        # Cells: a text's decisions up to the end of a block, those of the texts' first blocks here first.
        first = np.minimum(size, BLOCK - self.held[text])
        cells = 1 + -(-(size - first) // BLOCK)
        turn = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        begin = np.where(turn > 0, np.repeat(first - BLOCK, cells) + turn * BLOCK, 0)
        length = np.where(turn > 0, np.minimum(BLOCK, np.repeat(size, cells) - begin), np.repeat(first, cells))
        order = np.argsort(turn, kind="stable")
        begin, length, text = (x[order] for x in (begin + np.repeat(edge, cells), length, np.repeat(text, cells)))
        ends = np.cumsum(length)
        place = np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)
        raw, one = t[place], bit[place]
        odds = np.empty_like(raw)
        cuts = np.searchsorted(turn[order], np.arange(cells.max() + 1))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            d, n, part = text[lo:hi], length[lo:hi], slice(ends[lo] - length[lo], ends[hi - 1])
            o = raw[part] * np.repeat(self.scale[d].astype(np.float32), n) + np.repeat(self.offset[d].astype(np.float32), n)
            odds[part] = o
            error = (one[part] - 1 / (1 + np.exp(-o))).astype(np.float64)
            starts = np.cumsum(n) - n
            self.push[d] += np.add.reduceat(error, starts)
            self.pull[d] += np.add.reduceat(error * raw[part], starts)
            self.held[d] += n
            full = d[self.held[d] == BLOCK]
            self.offset[full] += RATE * self.push[full] / BLOCK**0.5
            self.scale[full] += 0.1 * RATE * self.pull[full] / BLOCK**0.5
            self.push[full], self.pull[full], self.held[full] = 0, 0, 0
        out = t.copy()
        out[place] = odds
        return out


class Model:
    def __init__(self, counts: list[np.ndarray]):
        """counts: of order 0 and of each table, twice the slots: zeros, ones."""
        self.odds, self.level = [], []
        for c in counts:
            zero, one = c[0::2].astype(np.float32), c[1::2].astype(np.float32)
            self.odds.append(np.log((one + np.float32(0.4)) / (zero + np.float32(0.4))))
            self.level.append(np.minimum(LEVELS - 1, np.log2(zero + one + 1) / 2.5).astype(np.uint8))
        self.weights = np.zeros((LEVELS * LEVELS, INPUTS), np.float32)
        self.weights[:, :] = np.array([0.3] + [0.25] * ORDERS + [0.0], np.float32)
        self.refine = None

    def inputs(self, node: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.empty((INPUTS, len(node)), np.float32)
        np.take(self.odds[0], node, out=x[0], mode="clip")
        for k, s in enumerate(slots):
            np.take(self.odds[k + 1], s, out=x[k + 1], mode="clip")
        x[-1] = 0.3
        return x, self.level[2].take(slots[1]).astype(np.int64) * LEVELS + self.level[3].take(slots[2])

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(self.weights.T)
        t = w[0].take(gate) * x[0]
        for k in range(1, INPUTS):
            t += w[k].take(gate) * x[k]
        return t

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, rate: float = 0.02, step: int = 2048) -> np.ndarray:
        """Online gradient steps; the mixed odds as they were before each step."""
        out = np.empty(len(gate), np.float32)
        for a in range(0, len(gate), step):
            part, g = x[:, a : a + step], gate[a : a + step]
            t = self.mix(part, g)
            out[a : a + step] = t
            error = bit[a : a + step] - 1 / (1 + np.exp(-t))
            n = np.bincount(g, minlength=LEVELS * LEVELS)
            pull = np.stack([np.bincount(g, error * row, LEVELS * LEVELS) for row in part], 1)
            self.weights += (rate * pull / np.sqrt(np.maximum(n, 1))[:, None]).astype(np.float32)
        return out

    @staticmethod
    def bins(t: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(t * 2) + BINS // 2, 0, BINS - 1).astype(np.int64) * DEPTHS + depth

    def cost(self, t: np.ndarray, bit: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bit at mixed odds t."""
        p = 1 / (1 + np.exp(-t))
        if self.refine is not None:
            p = np.float32(0.5) * p + np.float32(0.5) * self.refine.take(self.bins(t, depth))
        return np.log10(np.clip(np.abs(p - (1 - bit).astype(np.float32)), np.float32(1e-6), np.float32(1)))


def packed(tables: list[np.ndarray]) -> pd.DataFrame:
    """A task's 64-bit count tables as rows (part, segment, blob), empty segments left out."""
    packer = zstandard.ZstdCompressor(level=1)
    return pd.DataFrame([(k, s, b) for k, t in enumerate(tables) for s, b in enumerate(vector_rows(t, 16 if k else 1, packer)) if b], columns=["part", "segment", "blob"])


def merged(made: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Sums of the tasks' tables in 64 bits: a side of the root node has as many counts as the corpus has tokens."""
    tables = [np.zeros(s, np.int64) for s in sizes]
    for condition, size in (("part = 0", sizes[0]), ("part > 0", sizes[1] // 16)):
        for r in summed_segments(made.where(condition), ["part", "segment"], size).toLocalIterator():
            tables[r.part][r.segment * size : (r.segment + 1) * size] = segment_of(r.blob, size)
    return tables


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row of docs (doc_id, text).

    Texts with crc32(doc_id as text) mod 10 = 0 are held out of all learning (null doc_id: the sum of no bytes, held out). Null
    and empty texts are one end token; without a byte bits_per_byte is null. Repeated rows are each learnt from and scored.
    Counts of frequent words (2**18 at most), class and predictor tables have fixed sizes and are sent to the tasks; all other
    words meet their counts in a join of one row for each text and rare word; which words are frequent is cut at a count, so words
    that tie are treated alike. The predictor tables are untagged and don't grow with the corpus: contexts share slots, the more
    the larger it is. Words are told apart by 64-bit hashes. Texts of any length are scored whole, no rows give no rows, and other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "language-model")
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            nonlocal seen, times
            h = np.concatenate([seen, *held])
            n = np.concatenate([times, np.ones(len(h) - len(seen), np.int64)])
            held.clear()
            order = np.argsort(h, kind="stable")
            h = h[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            seen, times = h[starts], np.add.reduceat(n[order], starts) if len(h) else n

        for part in slices(batches, lambda f: f > 0):
            held.append(tokens(part)[0])
            if sum(map(len, held)) >= TOKENS:
                add()
                if len(seen) > DISTINCT:
                    yield pd.DataFrame({"h": seen, "c": times})
                    seen, times = seen[:0], times[:0]
        add()
        yield pd.DataFrame({"h": seen, "c": times})
        trim()

    counts = stored(chosen.mapInPandas(count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), f"{folder}/counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The words above a count, TOP at most: found by a histogram of bounded size, so no task sends more than it has of them.
    cell = F.when(F.col("c") < 4096, F.col("c")).otherwise(3328 + F.floor(64 * F.log2("c")))
    cells = sorted(counts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r.cell)
    many, cut = 0, None
    for r in cells:
        many += r.n
        if many > TOP:
            break
        cut = r.least
    top = counts.where(F.col("c") >= cut if cut is not None else F.lit(False)).toPandas()  # TOP rows at most
    hashes, c = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    shared = counts.groupBy(F.col("h").bitwiseAND(CLASSES - OWN - 1).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    class_counts, class_words = np.zeros(CLASSES - OWN, np.int64), np.zeros(CLASSES - OWN, np.int64)
    for r in shared:
        class_counts[r.k], class_words[r.k] = r.c, r.v
    own = np.lexsort((hashes, -c))[:OWN]
    np.subtract.at(class_counts, hashes[own] & (CLASSES - OWN - 1), c[own])
    np.subtract.at(class_words, hashes[own] & (CLASSES - OWN - 1), 1)
    code = Code(hashes, c, n, v, class_counts, class_words)
    sent_code = spark.sparkContext.broadcast(code)
    sizes = [2 * CLASSES] + [2 << SLOT_BITS] * ORDERS

    def learn_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = sent_code.value
        seen = Seen(code)
        for part in slices(batches, lambda f: f > 1):
            h, lengths = tokens(part)
            seen.add(code.classes(h, code.find(h)), h, lengths)
        yield packed(seen.all())
        del seen
        trim()

    made = stored(chosen.mapInPandas(learn_counts, "part int, segment int, blob binary"), f"{folder}/tables")
    tables = merged(made, sizes)
    remove(spark, f"{folder}/tables")
    model = Model(tables)
    sent = spark.sparkContext.broadcast(model)

    def learn_weights(pdf: pd.DataFrame) -> pd.DataFrame:
        """From a slice, fixed-point sums: weights times bits seen by gate, bits seen by gate, and bits and ones by refinement bin."""
        code, model = sent_code.value, Model.__new__(Model)
        model.__dict__ = sent.value.__dict__ | {"weights": sent.value.weights.copy()}
        gates = np.zeros(LEVELS * LEVELS, np.int64)
        seen, ones = np.zeros(BINS * DEPTHS, np.int64), np.zeros(BINS * DEPTHS, np.int64)
        held = texts(pdf.sort_values(["doc_id", "text"], na_position="first", kind="stable")["text"])
        for k in range(0, len(held), ROWS):
            h, lengths = tokens(held[k : k + ROWS])
            cls = code.classes(h, code.find(h))
            for _, _, node, bit, depth, slots in decisions(code, cls, h, lengths):
                x, gate = model.inputs(node, slots)
                at = Model.bins(model.learn(x, gate, bit), depth)
                gates += np.bincount(gate, minlength=len(gates))
                seen += np.bincount(at, minlength=len(seen))
                ones += np.bincount(at, bit, len(ones)).astype(np.int64)
        told = np.concatenate([np.rint(model.weights * SCALE).astype(np.int64).ravel() * np.repeat(gates, INPUTS), gates, seen, ones])
        return pd.DataFrame({"segment": [0], "blob": [zstandard.ZstdCompressor(1).compress(narrow(told))]})

    tenth = chosen.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 1)
    bytes_of = tenth.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    dealt = tenth.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(int(bytes_of // LEARN_BYTES) + 1)))
    size = LEVELS * LEVELS * (INPUTS + 1) + 2 * BINS * DEPTHS
    found = summed_segments(dealt.groupBy("slice").applyInPandas(learn_weights, "segment int, blob binary"), ["segment"], size).collect()
    if found:
        told = segment_of(found[0].blob, size)
        cut = np.cumsum([LEVELS * LEVELS * INPUTS, LEVELS * LEVELS, BINS * DEPTHS])
        w, gates, seen, ones = np.split(told, cut)
        used = gates > 0
        model.weights[used] = (w.reshape(-1, INPUTS)[used] / gates[used, None] / SCALE).astype(np.float32)
        centre = 1 / (1 + np.exp(-(np.repeat(np.arange(BINS), DEPTHS) - BINS // 2) / 2))
        model.refine = ((ones + 20 * centre) / (seen + 20)).astype(np.float32)
    sent_model = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, model, row = sent_code.value, sent_model.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for k in range(0, len(whole), ROWS):
                pdf = whole[k : k + ROWS]
                held = texts(pdf["text"])
                h, lengths = tokens(held)
                found = code.find(h)
                cls, top = code.classes(h, found), found >= 0
                base, inner = code.base[found], code.inner[found]
                bits = np.empty(len(h))
                ends = np.cumsum(lengths)
                starts = ends - lengths
                paths = code.starts[cls + 1] - code.starts[cls]
                own, text_of = Own(np.add.reduceat(paths, starts)), np.repeat(np.arange(len(held)), lengths)
                for a, bounds, node, bit, depth, slots in decisions(code, cls, h, lengths):
                    t = model.mix(*model.inputs(node, slots))
                    t = own.adapt(t, bit, np.repeat(text_of[a : a + len(bounds)], paths[a : a + len(bounds)]))
                    bits[a : a + len(bounds)] = np.add.reduceat(model.cost(t, bit, depth).astype(np.float64), bounds)
                rare_h, rare_n = [], []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    part, many = np.unique(h[a:b][~top[a:b]], return_counts=True)
                    rare_h.append(part)
                    rare_n.append(many.astype(np.int32))
                yield pd.DataFrame({
                    "row": row + np.arange(len(pdf)), "doc_id": pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "held_out": [fold(d) == 0 for d in pdf["doc_id"]],
                    "n_tokens": lengths, "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in held], "known": np.add.reduceat(top.astype(np.int64), starts),
                    "base": np.add.reduceat(base, starts), "mixed": np.add.reduceat(bits + inner, starts), "rare": rare_h, "times": rare_n,
                })
                row += len(pdf)
        trim()

    judged = stored(chosen.mapInPandas(judge, "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, mixed double, rare array<long>, times array<int>"), f"{folder}/judged")
    rare = judged.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select("row", F.col("e.rare").alias("h"), F.col("e.times").alias("times"))
    logs = F.array(*[F.lit(float(x)) for x in code.log_class])
    c = F.coalesce("c", F.lit(0))
    term = F.log10(c + ALPHA)
    joined = rare.join(counts, "h", "left").select("row", F.when(c > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * (term - float(code.log_total))).alias("base"), (F.col("times") * (term - F.element_at(logs, F.col("h").bitwiseAND(CLASSES - OWN - 1).cast("int") + 1))).alias("mixed"))
    more = joined.groupBy("row").agg(*[F.sum(x).alias(f"more_{x}") for x in ("known", "base", "mixed")])
    plus = lambda x: F.col(x) + F.coalesce(f"more_{x}", F.lit(0))
    return judged.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known").cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), plus("base").alias("base_score"), plus("mixed").alias("score"),
        F.when(F.col("n_bytes") > 0, -plus("mixed") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
