"""Operator 2, LM scoring with a gated recurrent network.

Tokens are words with A-Z lower-cased, and one end for each text. The network reads each text from a zero
state in windows, carrying the state from window to window to the end, and predicts a token's class and
then the token within its class. The most frequent words form the classes of the head, the fewer the more
frequent. All others are the last class, within which a word is predicted by its shape (letters outside
ASCII, length, last character) and has, within its shape, its smoothed share of the training counts; so every
text has a probability. Training is truncated backpropagation through time, in numpy. A bounded sample of
short documents gives the weights to start from; from these each shard of the training rows is learned in one
pass, texts of any length whole. The shards grow in number with the rows, not in size; each task adds up the
weights of its own, and their mean by tokens is the model. The head grows with the root of the distinct words.

Word counts cover all training rows. Executors get the model and the counts of the KNOWN most frequent
words, a bounded table; the counts of the rest come by a join on the word's hash. Once all are counted each text is
read once more, into ids; the sample, the pass of learning and the scoring have these and no text. Both readings
find, hash and look up the words of some texts at once, as stretches of bytes.

Defined results: a null or empty text is one end token. Rows that repeat a doc_id are each scored by
their own text. A null doc_id is never held out. With no training rows every count is 0. Words tied in
count are all known or all left to the join. Extra columns are never read.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT = 7, 2
HEAD, FIRST_CLASS, KNOWN = 1000, 16, 100_000
STATE, WINDOW, LANES, START_LANES = 32, 32, 256, 64
#: Steps that are laid out at a time, to be cut into windows.
STRETCH = 4 * WINDOW
#: The sample to start from: documents expected, most documents, and the longest text (characters) among them.
SAMPLE, MOST_SAMPLE, LONGEST_SAMPLE = 800, 1600, 50_000
EPOCHS, RATE = 3, 4e-3
#: The pass over all training rows: tokens of a shard, and the rate to begin with.
SHARD_TOKENS, PASS_RATE = 2_000_000, 4e-3
#: A shard's texts begin in the order of their lengths in so many tokens, the longest first.
LONG = 2_600
#: Most tasks of the pass; weights are added up in chunks of so many, of at most so many tasks at a time.
MOST_TASKS, CHUNK, FAN = 50_000, 16_384, 256
END = b""
SHAPES = 2 * 3 * 4
#: Most words with counts that a task holds.
FLUSH = 1_000_000
#: Characters of short texts whose words are looked up together.
READ = 1 << 18


def tokens(text: str | None) -> list[bytes]:
    return [*common.lowered(text).split(), END]


def shape(word: bytes) -> int:
    """The class of a word outside the head."""
    size = 0 if len(word) <= 4 else 1 if len(word) <= 8 else 2
    last = word[-1:] or b"a"
    end = 0 if last.isalnum() or last >= b"\x80" else 1 if last in b".!?" else 2 if last in b",;:" else 3
    return (0 if word.isascii() else 12) + size * 4 + end


#: What shape() makes of a word's last byte.
_ENDS = np.array([shape(bytes([b])) % 4 for b in range(256)], np.int32)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_HIGH = np.uint64(0x8080808080808080)
_SIZE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words that are hashed together, and the longest (bytes) that are; so that what is between fits a cache.
TOGETHER, LONGEST_WORD = 1 << 14, 64


class Words:
    """Words as stretches of bytes, with what is found of all at once; a word of no bytes is an end."""

    def __init__(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Behind the last word data needs 16 bytes that nothing reads as words."""
        self.bytes = np.frombuffer(data, np.uint8)
        self.eights = np.frombuffer(data, "<u8", len(data) // 8)
        self.starts, self.sizes = starts, sizes
        #: Bits that are set where a word has letters outside ASCII; hashes() finds them.
        self.high = np.zeros(len(starts), np.uint64)

    @classmethod
    def listed(cls, words: list[bytes]) -> Words:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return cls(b"".join([*words, bytes(16)]), np.cumsum(sizes) - sizes, sizes)

    @classmethod
    def of(cls, texts: list[str | None]) -> tuple[Words, np.ndarray]:
        """The tokens of texts, and how many each has."""
        each = [common.lowered(t) for t in texts]
        data = b"\n".join([b"", *each, b" " * 16])
        found = np.frombuffer(data, np.uint8)
        space = found == 32
        space |= found - np.uint8(9) < 5
        edges = np.flatnonzero(space[1:] != space[:-1])
        edges += 1
        starts, ends = edges[::2], edges[1::2]
        after = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) + 1)
        stops = np.searchsorted(starts, after) + np.arange(len(each))  # where the ends of the texts come
        word = np.ones(len(starts) + len(each), bool)
        word[stops] = False
        sizes, begins = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        begins[word], sizes[word] = starts, ends - starts
        return cls(data, begins, sizes), np.diff(stops, prepend=-1)

    def _eight(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The next eight bytes of each, as far as there are so many."""
        at, shift = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
        out = self.eights.take(at)
        out >>= shift
        at += 1
        more = self.eights.take(at)
        more <<= np.uint64(1)
        more <<= np.uint64(63) - shift
        out |= more
        out &= _LOW.take(np.minimum(sizes, 8))
        return out

    def hashes(self) -> np.ndarray:
        """64 bits of each word: those of up to eight bytes are mixed, longer ones eight by eight."""
        out = np.empty(len(self.starts), np.uint64)
        for a in range(0, len(out), TOGETHER):
            starts, sizes = self.starts[a : a + TOGETHER], self.sizes[a : a + TOGETHER]
            now = self._eight(starts, sizes)
            high = now & _HIGH
            now ^= (sizes + 1).astype(np.uint64) * _SIZE
            now = common.mix(now)
            rest, done = np.flatnonzero(sizes > 8), 8
            while rest.size and done < LONGEST_WORD:
                more = self._eight(starts[rest] + done, sizes[rest] - done)
                high[rest] |= more & _HIGH
                now[rest] = common.mix(now[rest] * _STEP ^ more)
                done += 8
                rest = rest[sizes[rest] > done]
            for k in rest.tolist():
                word = self.bytes[starts[k] : starts[k] + sizes[k]].tobytes()
                now[k], high[k] = common.xxhash.xxh3_64_intdigest(word), 0 if word.isascii() else _HIGH
            out[a : a + TOGETHER], self.high[a : a + TOGETHER] = now, high
        return out

    def shapes(self, which: np.ndarray) -> np.ndarray:
        """shape() of the words at these places; hashes() comes first."""
        sizes = self.sizes[which]
        ends = np.where(sizes > 0, self.bytes.take(self.starts[which] + np.maximum(sizes, 1) - 1), 97)
        return np.where(self.high[which] > 0, 12, 0).astype(np.int32) + 4 * ((sizes > 4).astype(np.int32) + (sizes > 8)) + _ENDS[ends]


def shapes_of(words: list[bytes]) -> np.ndarray:
    """shape() of each word."""
    listed = Words.listed(words)
    listed.hashes()
    return listed.shapes(np.arange(len(words)))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return Words.listed(words).hashes()


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(docs["doc_id"]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _totals(h: np.ndarray, shapes: np.ndarray | Words, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different h, of one at least, each with its shape and the sum of its n (one each, where none is given)."""
    order = np.argsort(h)
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(starts, append=len(h)) if n is None else np.add.reduceat(n[order], starts)
    first = order[starts]
    return h[starts], shapes.shapes(first) if isinstance(shapes, Words) else shapes[first], n


def counted(docs: DataFrame) -> DataFrame:
    """(h, shape, n): the words of docs by hash, with counts. Each task adds up what it can hold."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        common.keep_memory()
        for part in parts:
            for some in common.batches(((len(t or ""), t) for t in part["text"]), READ):
                words, _ = Words.of(some)
                held.append(_totals(words.hashes(), words))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [_totals(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield _counts(*held.pop())
                        size = 0
        if held:
            yield _counts(*_totals(*map(np.concatenate, zip(*held, strict=True))))

    found = docs.select("text").mapInPandas(run, "h long, shape int, n long")
    return found.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def _counts(h: np.ndarray, shapes: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"h": h.view(np.int64), "shape": shapes, "n": n})


def class_edges(head: int) -> np.ndarray:
    """Where the classes of the head's words begin and end: FIRST_CLASS words, and then an eighth of the words before."""
    edges = [0]
    while edges[-1] < head:
        edges.append(min(head, edges[-1] + max(FIRST_CLASS, edges[-1] // 8)))
    return np.array(edges, np.int64)


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x as odds, in place, with their sums; where some are so large that these could overflow, each row's greatest is 1."""
    if x.size and not -60 < x.min() <= x.max() < 60:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _summed(rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each word, and the words: sorted by word, neighbours are added up pair by pair."""
    small = words.astype(np.uint16) if words.size and words.max() < 1 << 16 else words  # 16 bits are sorted by radix
    order = np.argsort(small, kind="stable")
    rows, words = rows.take(order, axis=0), words[order]
    starts = np.concatenate([[True], words[1:] != words[:-1]])
    place = np.arange(len(words))
    place -= np.maximum.accumulate(np.where(starts, place, 0))
    words = words[starts]
    while len(rows) > len(words):
        odd = (place & 1).astype(bool)
        second = np.flatnonzero(odd)
        rows[second - 1] += rows.take(second, axis=0)
        first = np.flatnonzero(~odd)
        rows, place = rows.take(first, axis=0), place[first] >> 1
    return rows, words


class Network:
    """A gated recurrent network with a class-factored softmax; float32 throughout.

    The first factor is a word's class: one for each stretch of the head's words by frequency, and one for all
    words outside it. The second is the word within its class, or the shape of a word outside the head.
    """

    def __init__(self, head: int, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        self.head = head
        # the words outside the head, by shape, are the last class
        self.edges = np.append(class_edges(head), head + SHAPES)
        self.classes = len(self.edges) - 1
        self.of_class = np.repeat(np.arange(self.classes, dtype=np.int16), np.diff(self.edges))
        h, scale = STATE, STATE**-0.5
        shapes = {
            "table": (head + SHAPES, 3 * h), "turn": (h, 3 * h), "bias": (3 * h,), "classes": (self.classes, h), "class_bias": (self.classes,),
            "words": (head + SHAPES, h), "word_bias": (head + SHAPES,),
        }
        self.w = {k: (np.zeros(s) if "bias" in k else random.normal(size=s) * scale).astype(np.float32) for k, s in shapes.items()}

    def biased(self) -> np.ndarray:
        """The table with the bias, the gates negated: 1 / (1 + exp(-x)) is what they come to."""
        table = self.w["table"] + self.w["bias"]
        table[:, : 2 * STATE] *= -1
        return table

    def given(self, inputs: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """(3, steps, lanes, STATE): what inputs give the two gates, negated, and the new value; table is biased(), where made already."""
        if table is None and self.w["table"].shape[0] <= inputs.size:
            table = self.biased()
        at = inputs.astype(np.int64) * 3 + np.arange(3)[:, None, None]
        if table is not None:
            return table.reshape(-1, STATE).take(at, axis=0)
        found = self.w["table"].reshape(-1, STATE).take(at, axis=0)
        found += self.w["bias"].reshape(3, 1, 1, STATE)
        np.negative(found[:2], out=found[:2])
        return found

    def run(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: dict | None = None, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each of (steps, lanes) inputs; fresh marks where a document begins and the state is zero."""
        h = STATE
        steps, lanes = inputs.shape
        given = self.given(inputs, table)
        turn = np.array(self.w["turn"].reshape(h, 3, h).transpose(1, 0, 2), order="C")
        turn[:2] *= -1
        out = np.empty((steps, lanes, h), given.dtype)
        begins = fresh.any(axis=1).tolist()
        if keep is not None:
            before, candidate = np.empty_like(out), np.empty_like(out)
        turned = np.empty((3, lanes, h), out.dtype)
        held = np.empty((lanes, h), out.dtype)
        with np.errstate(over="ignore"):  # a gate that is all but shut
            for t in range(steps):
                if begins[t]:
                    state = np.array(state)
                    state[fresh[t]] = 0
                np.matmul(state, turn, out=turned)
                gates = given[:2, t]
                gates += turned[:2]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                new = given[2, t]
                if keep is not None:
                    before[t], candidate[t] = state, turned[2]
                np.multiply(gates[1], turned[2], out=held)
                new += held
                np.tanh(new, out=new)
                following = out[t]
                np.subtract(state, new, out=following)
                following *= gates[0]
                following += new
                state = following
        if keep is not None:
            keep |= {"before": before, "candidate": candidate, "update": given[0], "reset": given[1], "new": given[2]}
        return out, state

    def log_probs(self, states: np.ndarray, targets: np.ndarray, gradients: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each target's probability (of its shape outside the head); with gradients also those of the states."""
        w = self.w
        of_class = self.of_class[targets]
        order = np.argsort(of_class, kind="stable")
        states, targets, of_class = states.take(order, axis=0), targets[order], of_class[order]
        at = np.arange(len(targets))
        odds = states @ w["classes"].T
        odds += w["class_bias"]
        odds, sums = _softmax(odds)
        own = at * self.classes + of_class
        chances = odds.ravel()[own] / sums
        back = None
        if gradients is not None:
            odds *= (1 / sums)[:, None]
            odds.reshape(-1)[own] -= 1
            gradients["classes"] += odds.T @ states
            gradients["class_bias"] += np.ones(len(odds), odds.dtype) @ odds
            back = odds @ w["classes"]
        cuts = np.searchsorted(of_class, np.arange(self.classes + 1))
        edges = self.edges.tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a == b:
                continue
            begin, end = edges[k], edges[k + 1]
            s, word, mine, words = states[a:b], targets[a:b] - begin, at[: b - a], w["words"][begin:end]
            odds = s @ words.T
            odds += w["word_bias"][begin:end]
            odds, sums = _softmax(odds)
            own = mine * (end - begin) + word
            chances[a:b] *= odds.ravel()[own] / sums
            if gradients is not None:
                odds *= (1 / sums)[:, None]
                odds.reshape(-1)[own] -= 1
                gradients["words"][begin:end] += odds.T @ s
                gradients["word_bias"][begin:end] += np.ones(len(odds), odds.dtype) @ odds
                back[a:b] += odds @ words
        unsorted = np.empty_like(order)
        unsorted[order] = at
        out = np.log(np.maximum(chances, np.finfo(chances.dtype).tiny))[unsorted]
        return out, back.take(unsorted, axis=0) if back is not None else None

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, used: np.ndarray, state: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """One window of truncated backpropagation: minus the summed log-probability, its gradients, and the state carried on.

        Of the table only rows of inputs have a gradient: "rows" names them.
        """
        h, keep = STATE, {}
        states, last = self.run(inputs, fresh, state, keep)
        steps, lanes, _ = states.shape
        found = {k: np.zeros_like(v) for k, v in self.w.items() if k != "table"}
        if used.all():
            logs, down = self.log_probs(states.reshape(-1, h), targets.ravel(), found)
        else:
            at = np.flatnonzero(used)
            down = np.zeros((steps * lanes, h), states.dtype)
            logs, down[at] = self.log_probs(states.reshape(-1, h).take(at, axis=0), targets.ravel()[at], found)
        down = down.reshape(steps, lanes, h)
        update, reset, new, before = keep["update"], keep["reset"], keep["new"], keep["before"]
        # what a state's gradient comes to at the gates and the new value, before the recurrent weights
        turned = np.empty((3, steps, lanes, h), states.dtype)
        shut = 1 - update
        new_factor = 1 - new * new
        new_factor *= shut
        np.subtract(before, new, out=turned[0])
        turned[0] *= update
        turned[0] *= shut
        np.multiply(new_factor, reset, out=turned[2])
        np.multiply(turned[2], keep["candidate"], out=turned[1])
        turned[1] *= 1 - reset
        later = np.zeros((lanes, h), states.dtype)
        turn_back = np.ascontiguousarray(self.w["turn"].reshape(h, 3, h).transpose(1, 2, 0))
        each = np.empty((3, lanes, h), states.dtype)
        begins = fresh.any(axis=1).tolist()
        for t in range(steps - 1, -1, -1):
            d = down[t]
            d += later
            now = turned[:, t]
            now *= d
            np.matmul(now, turn_back, out=each)
            np.multiply(d, update[t], out=later)
            later += each[0]
            later += each[1]
            later += each[2]
            if begins[t]:
                later[fresh[t]] = 0
        flat = turned.reshape(3, -1, h)
        found["turn"] = np.matmul(before.reshape(-1, h).T, flat).transpose(1, 0, 2).reshape(h, 3 * h)
        np.multiply(down, new_factor, out=turned[2])  # at the inputs the new value isn't reset
        found["bias"] = (np.ones(flat.shape[1], flat.dtype) @ flat).ravel()
        found["table"], found["rows"] = _summed(flat.transpose(1, 0, 2).reshape(-1, 3 * h), inputs.ravel())
        return -float(logs.sum()), found, last

    def learn(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, used: np.ndarray, state: np.ndarray, adam: dict) -> np.ndarray:
        """One step of Adam, on one window; returns the state carried on. Rows of the table move when their words are seen."""
        _, found, last = self.gradients(inputs, targets, fresh, used, state)
        rows = found.pop("rows")
        scale = 1 / max(1, used.sum())
        norm = scale * math.sqrt(sum(float(np.vdot(g, g)) for g in found.values()))
        scale = np.float32(scale * min(1, 1 / max(norm, 1e-9)))
        adam["t"] += 1
        rate, unbias = np.float32(adam["rate"] / (1 - 0.9 ** adam["t"])), np.float32((1 - 0.999 ** adam["t"]) ** -0.5)
        for k, g in found.items():
            g *= scale
            m, v = adam.setdefault(k, (np.zeros_like(self.w[k]), np.zeros_like(self.w[k])))
            new_m, new_v = (m.take(rows, axis=0), v.take(rows, axis=0)) if k == "table" else (m, v)
            new_m *= np.float32(0.9)
            new_v *= np.float32(0.999)
            new_m += np.float32(0.1) * g
            np.multiply(g, g, out=g)
            g *= np.float32(0.001)
            new_v += g
            np.sqrt(new_v, out=g)
            g *= unbias
            g += np.float32(1e-8)
            np.divide(new_m, g, out=g)
            g *= rate
            if k == "table":
                m[rows], v[rows] = new_m, new_v
                g = self.w[k].take(rows, axis=0) - g
                self.w[k][rows] = g
            else:
                self.w[k] -= g
        return last


def lanes_of(texts: list[np.ndarray], most: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end in at most that many lanes: (steps, lanes) of inputs, targets, text numbers (-1: none), text begins here.

    The longest text goes to the emptiest lane, and the fullest lane comes first.
    """
    n = max(1, min(most, len(texts)))
    rows: list[list[int]] = [[] for _ in range(n)]
    sizes = np.zeros(n, np.int64)
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k])):
        at = int(sizes.argmin())
        rows[at].append(k)
        sizes[at] += len(texts[k])
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max()) if len(texts) else 0
    targets, numbers = np.zeros((n, steps), np.int32), np.full((n, steps), -1, np.int32)
    inputs, fresh = np.zeros((n, steps), np.int32), np.zeros((n, steps), bool)
    for lane, at in enumerate(order):
        begin = 0
        for k in rows[at]:
            end = begin + len(texts[k])
            targets[lane, begin:end], numbers[lane, begin:end] = texts[k], k
            inputs[lane, begin], inputs[lane, begin + 1 : end] = first, texts[k][:-1]
            fresh[lane, begin] = True
            begin = end
    return inputs.T, targets.T, numbers.T, fresh.T


def train(texts: list[np.ndarray], head: int, first: int) -> Network:
    """A network that has seen the sample EPOCHS times."""
    out = Network(head)
    adam = {"t": 0, "rate": RATE}
    random = np.random.default_rng(3)
    for epoch in range(EPOCHS if texts else 0):
        adam["rate"] = RATE * (1 - epoch / EPOCHS)
        mixed = [texts[k] for k in random.permutation(len(texts))]
        inputs, targets, numbers, fresh = lanes_of(mixed, START_LANES, first)
        state = np.zeros((inputs.shape[1], STATE), np.float32)
        for at in range(0, len(inputs), WINDOW):
            window = slice(at, at + WINDOW)
            used = numbers[window] >= 0
            if used.sum() >= WINDOW:
                state = out.learn(inputs[window], targets[window], fresh[window], used, state, adam)
    return out


def numbered_windows(texts: Iterator[np.ndarray], first: int, widen: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All texts through LANES lanes, each text whole in one lane.

    Yields the lanes in use and, each (steps, lanes), inputs, targets, whether a text begins here, and the
    text's number (-1: none). A lane without a text left stays empty. A window has WINDOW steps; to widen makes it
    STRETCH where so few lanes are left that it is no larger, which scores alike but learns less often.
    """
    texts = iter(texts)
    held: list[tuple[np.ndarray, int, int] | None] = [None] * LANES
    n_texts = 0
    while True:
        inputs, targets = np.zeros((LANES, STRETCH), np.int32), np.zeros((LANES, STRETCH), np.int32)
        fresh, numbers = np.zeros((LANES, STRETCH), bool), np.full((LANES, STRETCH), -1, np.int64)
        for lane in range(LANES):
            now, row = held[lane], 0
            while row < STRETCH:
                if now is None:
                    if (ids := next(texts, None)) is None:
                        break
                    now, n_texts = (ids, 0, n_texts), n_texts + 1
                ids, at, number = now
                n = min(STRETCH - row, len(ids) - at)
                end = row + n
                targets[lane, row:end], numbers[lane, row:end] = ids[at : at + n], number
                inputs[lane, row], inputs[lane, row + 1 : end] = ids[at - 1] if at else first, ids[at : at + n - 1]
                fresh[lane, row] = not at
                now = (ids, at + n, number) if at + n < len(ids) else None
                row = end
            held[lane] = now
        if numbers.max() < 0:
            return
        width = STRETCH if widen and np.count_nonzero(numbers[:, 0] >= 0) * STRETCH <= LANES * WINDOW else WINDOW
        for at in range(0, STRETCH, width):
            cut = slice(at, at + width)
            lanes = np.flatnonzero(numbers[:, at] >= 0)  # a lane that is empty here is empty from here on
            if len(lanes):
                yield lanes, *(np.ascontiguousarray(x[lanes, cut].T) for x in (inputs, targets, fresh, numbers))


def windows(texts: Iterator[np.ndarray], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, text begins here, used) of the windows of texts."""
    for _, inputs, targets, fresh, numbers in numbered_windows(texts, first):
        yield inputs, targets, fresh, numbers >= 0


def learn_all(network: Network, texts: Iterator[np.ndarray], first: int, expected: int) -> int:
    """One pass of a network over texts of about that many tokens; returns their number."""
    common.keep_memory()
    adam = {"t": 0}
    state = np.zeros((LANES, STATE), np.float32)
    seen = 0
    for lanes, inputs, targets, fresh, numbers in numbered_windows(texts, first):
        used = numbers >= 0
        n = int(used.sum())
        # a window of few tokens is a noisy one
        adam["rate"] = PASS_RATE * max(0.1, 1 - seen / max(1, expected)) * math.sqrt(n / (LANES * WINDOW))
        state[lanes] = network.learn(inputs, targets, fresh, used, state[lanes], adam)
        seen += n
    return seen


def ids_kind(head: int) -> str:
    """The type of a text's ids as read_texts() writes them."""
    return "<u2" if head + SHAPES <= 1 << 16 else "<i4"


def learned(read: DataFrame, start: Network, first: int, total: int) -> Network:
    """The network after a pass over all rows of read (at, n_tokens, ids), by shards that don't depend on how these are partitioned."""
    shards = max(1, total // SHARD_TOKENS)
    begun = read.sparkSession.sparkContext.broadcast(start)
    kind = ids_kind(start.head)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, ids) for part in parts for s, ids in zip(part["shard"], part["ids"], strict=True))
        added, seen, task = 0.0, 0, -1
        for shard, group in groupby(rows, lambda r: r[0]):
            network = copy.deepcopy(begun.value)
            n = learn_all(network, (np.frombuffer(ids, kind) for _, ids in group), first, total // shards)
            added = added + n * np.concatenate([network.w[k].ravel() for k in sorted(network.w)]).astype(float)
            seen, task = seen + n, max(task, shard)
        if seen:
            for at in range(0, len(added), CHUNK):
                yield pd.DataFrame({"chunk": [at], "task": [task], "n": [seen], "w": [(added[at : at + CHUNK] / seen).tobytes()]})

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        n = group["n"].sum()
        out = sum(k * np.frombuffer(w, float) for k, w in zip(group["n"], group["w"], strict=True)) / n
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "task": [group["task"].iloc[0]], "n": [n], "w": [out.tobytes()]})

    schema = "chunk long, task long, n long, w binary"
    # long texts begin first, so that few lanes are left to them at the end; a sort by an expression would find it at each comparison
    size = F.floor(F.col("n_tokens") / LONG)
    dealt = read.select("ids", "at", size.alias("size")).withColumn("shard", F.pmod("at", F.lit(shards)))
    # a task of its own for most shards, however small they are; beyond MOST_TASKS a task learns several
    dealt = dealt.repartition(min(4 * shards, MOST_TASKS), "shard").sortWithinPartitions("shard", F.desc("size"), "at")
    made = common.table(dealt.select("shard", "ids").mapInPandas(run, schema), "weights")
    # sums of at most FAN tasks, then of as many of these; a number of shards has a few levels
    left = shards
    while left > 1:
        few = made.groupBy("chunk", F.pmod(F.xxhash64("task"), F.lit(-(-left // FAN))).alias("some")).applyInPandas(mean, schema)
        few = common.table(few, "weights")
        common.drop(made)
        made, left = few, -(-left // FAN)
    found = made.collect()  # one model, in chunks
    common.drop(made)
    out = copy.deepcopy(start)
    if found:
        flat = np.concatenate([np.frombuffer(r["w"], float) for r in sorted(found, key=lambda r: r["chunk"])]).astype(np.float32)
        at = 0
        for k in sorted(out.w):
            out.w[k] = flat[at : at + out.w[k].size].reshape(out.w[k].shape).copy()
            at += out.w[k].size
    return out


def streamed(network: Network, texts: Iterator[np.ndarray], first: int) -> Iterator[tuple[int, float]]:
    """(number, log10 of its probability but for the words within shapes) of each whole text, as they end."""
    state = np.zeros((LANES, STATE), np.float32)
    common.keep_memory()
    table = network.biased()
    open_: dict[int, float] = {}
    for lanes, inputs, targets, fresh, numbers in numbered_windows(texts, first, widen=True):
        states, state[lanes] = network.run(inputs, fresh, state[lanes], table=table)
        states, numbers_, targets = states.reshape(-1, STATE), numbers.ravel(), targets.ravel()
        if numbers_.min() < 0:
            used = np.flatnonzero(numbers_ >= 0)
            states, numbers_, targets = states.take(used, axis=0), numbers_[used], targets[used]
        logs, _ = network.log_probs(states, targets)
        base = numbers_.min()
        if numbers_.max() - base < 4 * LANES * WINDOW:
            which = numbers_ - base
            mine = np.flatnonzero(np.bincount(which))
            sums, mine = np.bincount(which, logs)[mine], mine + base
        else:  # a very long text beside others
            mine, which = np.unique(numbers_, return_inverse=True)
            sums = np.bincount(which, logs)
        for k, x in zip(mine.tolist(), sums.tolist(), strict=True):
            open_[k] = open_.get(k, 0.0) + x
        going = set(numbers[-1].tolist())  # the last step's texts may go on
        for k in [k for k in open_ if k not in going]:
            yield k, open_.pop(k) / math.log(10)
    for k, x in open_.items():
        yield k, x / math.log(10)


def log10_probs(network: Network, texts: list[np.ndarray], first: int) -> np.ndarray:
    """log10 of each whole text's probability, but for the words within shapes."""
    out = np.zeros(len(texts))
    for k, x in streamed(network, iter(texts), first):
        out[k] = x
    return out


class Reader:
    """Turns words into ids and counts, by the bounded tables that every executor has."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, head: int) -> None:
        self.none, self.head = len(hashes), head
        self.hashes, self.counts = np.append(hashes, np.uint64(0)), np.append(counts, -1)
        # an open-addressed table of places in these: a word that finds a slot taken goes to the next
        bits = max(4, (4 * self.none).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, self.none, np.int32)
        left, slot = np.arange(self.none), (hashes >> self.shift).astype(np.int64)
        while left.size:
            free = self.slots[slot] == self.none
            self.slots[slot[free]] = left[free]
            again = self.slots[slot] != left
            left, slot = left[again], (slot[again] + 1) & self.last

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where the tables have each word: its number by frequency, or none where only the join knows it."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.slots.take(slot)
        left = np.flatnonzero((self.hashes.take(out) != hashes) & (out < self.none))
        while left.size:
            slot[left] = (slot[left] + 1) & self.last
            out[left] = now = self.slots[slot[left]]
            left = left[(self.hashes[now] != hashes[left]) & (now < self.none)]
        return out

    def look_up(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, places, ids) of words."""
        hashes = words.hashes()
        places = self.places(hashes)
        ids, outside = places.copy(), np.flatnonzero(places >= self.head)
        ids[outside] = self.head + words.shapes(outside)
        return hashes, places, ids

    def read(self, word: bytes) -> tuple[int, int, int]:
        """(hash, id, count or -1) of a word."""
        hashes, places, ids = self.look_up(Words.listed([word]))
        return int(hashes[0]), int(ids[0]), int(self.counts[places[0]])

    def ids_of(self, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, read some texts at a time."""
        for some in common.batches(((len(t or ""), t) for t in texts), READ):
            words, sizes = Words.of(some)
            yield from np.split(self.look_up(words)[2], np.cumsum(sizes[:-1]))


def most_frequent(words: DataFrame, most: int = KNOWN) -> DataFrame:
    """At most that many of words, the most frequent: those above a count that a small histogram of counts gives."""
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 8) + 16).cast("int")  # 64 comes to 64
    held = 0
    least = None
    for row in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    return words.where(level >= least) if least is not None else words.limit(0)


_READ = "doc_id long, at long, learn boolean, begins boolean, n_tokens long, n_known long, base_score double, own double, rare array<long>, times array<int>, ids binary"


def read_texts(given: DataFrame, tables: tuple[np.ndarray, np.ndarray, int], base_log: float, shape_log: np.ndarray) -> DataFrame:
    """given (doc_id, at, learn, begins, text) with ids for the text, and what counts alone give: rows of _READ."""
    sent = given.sparkSession.sparkContext.broadcast((tables, base_log, shape_log))
    names = [x.split()[0] for x in _READ.split(", ")]
    head = tables[2]
    kind = ids_kind(head)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables, base_log, shape_log = sent.value
        mine = Reader(*tables)
        count_logs = np.log10(np.maximum(mine.counts, 0) + 1)
        common.keep_memory()
        for part in parts:
            given = zip(part["doc_id"].astype("Int64"), *[part[x] for x in ("at", "learn", "begins", "text")], strict=True)
            for some in common.batches(((len(r[4] or ""), r) for r in given), READ):
                words, sizes = Words.of([r[4] for r in some])
                hashes, places, ids = mine.look_up(words)
                counts, logs = mine.counts.take(places), count_logs.take(places)
                own = np.zeros(len(ids))
                outside = np.flatnonzero(ids >= head)
                own[outside] = logs[outside] - shape_log[ids[outside] - head]
                ends = np.cumsum(sizes)
                begins = ends - sizes  # a text has its end at least, so that no stretch is empty
                known, base, own = (np.add.reduceat(x, begins) for x in ((counts > 0).astype(np.int64), logs, own))
                data, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                unknown = np.flatnonzero(places == mine.none)
                rare, row = hashes[unknown].view(np.int64), np.searchsorted(ends, unknown, side="right")
                order = np.lexsort((rare, row))
                rare, row = rare[order], row[order]
                firsts = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (row[1:] != row[:-1])])[: len(rare)])
                times = np.diff(firsts, append=len(rare))
                cuts = np.searchsorted(row[firsts], np.arange(1, len(sizes)))
                columns = [
                    pd.array([r[0] for r in some], "Int64"), [r[1] for r in some], [r[2] for r in some], [r[3] for r in some],
                    sizes, known, base - sizes * base_log, own, np.split(rare[firsts], cuts), np.split(times, cuts),
                    [data[width * a : width * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)],
                ]
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    return given.mapInPandas(run, _READ)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    words = common.table(counted(training(docs)), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = most_frequent(words).toPandas().sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    hashes, counts = frequent["h"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64)
    head = min(max(HEAD, 2 * math.isqrt(distinct)), len(hashes))
    # mass and distinct words of each shape outside the head
    by_shape = words.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    mass, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    mass[by_shape["shape"]], kinds[by_shape["shape"]] = by_shape["n"], by_shape["v"]
    np.subtract.at(mass, frequent["shape"][:head], counts[:head])
    np.subtract.at(kinds, frequent["shape"][:head], 1)
    reader = Reader(hashes, counts, head)
    _, first, end_count = reader.read(END)
    n_docs = max(1, end_count)

    # what is scored but for the network: the counts' share in base_score, and a word's share within its shape
    base_log, shape_log = np.log10(total + distinct + 1), np.log10(mass + kinds + 1)
    share = F.lit(min(1 << 30, int(SAMPLE / n_docs * (1 << 30))))
    begins = (F.pmod(F.xxhash64(F.coalesce(docs["doc_id"], F.lit(0)), F.lit(11)), F.lit(1 << 30)) < share) & (F.length("text") <= LONGEST_SAMPLE)
    learn = ~held_out(docs["doc_id"])
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("at"), learn.alias("learn"), (learn & F.coalesce(begins, F.lit(False))).alias("begins"), "text")
    read = read_texts(given, (hashes, counts, head), base_log, shape_log)
    read = common.table(read.withColumn("id", F.monotonically_increasing_id()), "read")  # written once, so ids are settled
    sample = read.where("begins").limit(MOST_SAMPLE).select("doc_id", "ids").collect()
    sample.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, len(r["ids"])))
    kind = ids_kind(head)
    network = train([np.frombuffer(r["ids"], kind).astype(np.int32) for r in sample], head, first)
    network = learned(read.where("learn"), network, first, total)

    model = spark.sparkContext.broadcast((network, first))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network, first = model.value
        rows: dict[int, tuple[int, float]] = {}

        def texts() -> Iterator[np.ndarray]:
            n = 0
            for part in parts:
                # long texts first, so that few lanes are left to them at the end
                for id_, own, ids in sorted(zip(part["id"], part["own"], part["ids"], strict=True), key=lambda r: -len(r[2])):
                    rows[n] = (id_, own)
                    n += 1
                    yield np.frombuffer(ids, kind)

        done: list[tuple] = []
        for k, score in streamed(network, texts(), first):
            id_, own = rows.pop(k)
            done.append((id_, own + score))
            if len(done) == 500:
                yield pd.DataFrame(done, columns=["id", "score"])
                done = []
        yield pd.DataFrame(done, columns=["id", "score"]).astype({"id": "int64", "score": "float64"})

    scores = common.table(read.select("id", "own", "ids").mapInPandas(run, "id long, score double"), "scores")
    rare = read.select("id", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("id", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    added = rare.join(words.select("h", "n"), "h").groupBy("id").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), F.sum("times").alias("found"))
    out = read.select("id", "doc_id", "n_tokens", "n_known", "base_score").join(scores, "id").join(added, "id", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.documents(spark, sf_dir))
