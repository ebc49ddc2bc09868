"""Toxicity: a support vector machine over a gapped subsequence kernel, with Nystrom landmarks, learned from sentences.

The kernel of two strings sums, over all subsequences of ORDER characters that they share, DECAY to the power of the
places the subsequence spans in each; marks for the beginning and the end of a word are characters too.  An insult with
inserted characters shares its subsequences at longer spans, so it keeps part of the weight.  The kernel is normalised and
raised to POWER, which is a kernel again.

Landmarks are the parts of words that tell labelled toxic documents from others, and for each of them the words of clean
documents that are likest to it.  Nystrom features are kernel values with the landmarks, whitened by their own kernel.

Labels are of documents, so learning is by multiple instances: a sentence is a bag of words, and as toxic as its worst
word.  Round by round the worst words of the sentences of clean documents are negative; those of toxic documents are
positive if fewer clean ones reach their margin than may be labelled wrongly.  Disguised copies of the positive words (characters put
in, one left out, a space inside) are positive too.  A document scores by its worst sentence.

Words are runs between white space, lower-cased, without marks inside.  Short neighbours in a sentence also count as one
word with a gap, and runs of single characters ("x y z") as one word.  Long words are seen through overlapping windows, so
whole texts are scored.  Each worker computes a distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from random import Random

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarium.llm.tables import id_and_text, slices, written

ORDER, DECAY, POWER = 3, 0.75, 3
#: A landmark's length, marks included; landmarks at most (the labels yield far fewer).
SHORTEST, LONGEST, LANDMARKS = 4, 12, 256
#: Share of a landmark's letters that a word must have at all.
NEEDED = 0.75
#: Characters of a word seen at once, and the step from one view to the next.
VIEW, STEP = 24, 12
#: Characters of a word's beginning, BEGIN included.
STEM = 7
#: Words in a sentence at most; longer ones are cut.
SENTENCE_WORDS = 16
#: Neighbours with so many characters together count as one word, too.
PAIR_CHARS = 11
#: Bounds of what is learned from: labelled documents, and substrings that may be landmarks.
MAX_LABELLED, MAX_CANDIDATES = 12_000, 20_000
#: Log-likelihood ratio above which a substring is no chance find among some millions.
EVIDENCE = 17.0
#: A landmark's documents are toxic in so many of all cases at least.
PURITY = 0.9
#: For each insult, words of clean documents that are landmarks too; and how like an insult a word is at least.
CONTRASTS, LIKE = 6, 0.15
#: Clean documents at most that such words are sought in.
CONTRASTED = 3_000
#: Words of a document that are likest to insults and learned from, those of them in a round, and the rounds.
NEAREST, WORST, ROUNDS = 64, 8, 4
#: Share of clean documents that may be labelled so wrongly.
MISLABELLED = 0.02
#: Share of the cost of errors that positive examples have together.
POSITIVE = 0.2
#: Positive words that are disguised, what all disguises weigh in calibration against all toxic
#: documents, and what a clean document weighs there against a toxic one.
DISGUISED, CHANGED, FALSE_ALARM = 2_000, 1.0, 1.0
BEGIN, END = "^", "$"
HELD = 500_000
REMEMBERED = 300_000

_ENDS = re.compile(r"[.!?]+(?=\s)|\n")


def letters(word: str) -> str:
    """Letters, digits and spaces of a word between BEGIN and END; marks put between them are gone."""
    plain = word.isalnum() or word.replace(" ", "").isalnum()
    return BEGIN + (word if plain else "".join(c for c in word if c.isalnum() or c == " ")) + END


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence of a text in lower case, at most SENTENCE_WORDS in each."""
    out = []
    for part in _ENDS.split(text.lower()):
        words = part.split()
        out += [words[i : i + SENTENCE_WORDS] for i in range(0, len(words), SENTENCE_WORDS)]
    return out


def words_of(sentence: list[str]) -> list[str]:
    """A sentence's words, its short neighbours joined by a space, and runs of three or more single characters joined."""
    sizes = list(map(len, sentence))
    out = sentence + [f"{a} {b}" for a, b, m, n in zip(sentence, sentence[1:], sizes, sizes[1:], strict=False) if m + n <= PAIR_CHARS]
    run: list[str] = []
    for w in [*sentence, "  "] if 1 in sizes else []:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) > 2:
                out.append("".join(run))
            run = []
    return out


def views(word: str) -> list[str]:
    """A marked word, or overlapping windows that cover all of a long one; and its beginning, which stems are compared with."""
    whole = [word] if len(word) <= VIEW else [word[i : i + VIEW] for i in range(0, len(word) - STEP, STEP)]
    return whole if len(word) <= STEM + 1 else [*whole, word[:STEM]]


@dataclass
class Landmarks:
    """Landmark strings laid side by side in one array of LONGEST columns each."""

    words: list[str]

    def __post_init__(self):
        characters = sorted({c for w in self.words for c in w})
        #: Codes by code point; all from the last on have none.
        self.table = np.zeros(max(map(ord, characters)) + 2, np.uint16)
        self.table[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        grid = np.zeros((len(self.words), LONGEST), np.int32)
        for n, w in enumerate(self.words):
            grid[n, : len(w)] = self.table[[ord(c) for c in w]]
        #: match[c]: where the landmarks have the character of code c.
        self.match = np.stack([(grid == c).astype(np.float32) * (c > 0) for c in range(len(characters) + 1)])
        gap = np.arange(LONGEST)[None, :] - np.arange(LONGEST)[:, None]
        self.spread = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
        #: A string must have so many of a landmark's letters, by place.
        self.needed = np.array([np.ceil(NEEDED * sum(c not in BEGIN + END for c in w)) for w in self.words])
        self.letters = self.match.sum(axis=2)
        self.letters[self.table[[ord(c) for c in BEGIN + END if c in characters]]] = 0
        #: at[c]: a bit for each place among a landmark's letters that has the character of code c.
        plain = ["".join(c for c in w if c not in BEGIN + END) for w in self.words]
        self.count = np.array([len(w) for w in plain])
        self.at = np.zeros((len(self.match), len(plain)), np.uint32)
        for n, w in enumerate(plain):
            for i, c in enumerate(w):
                self.at[self.table[ord(c)], n] |= np.uint32(1 << i)
        #: A bit for each code; should there be over 64, some share one.
        self.bits = np.where(self.table > 0, np.uint64(1) << (self.table % 64).astype(np.uint64), np.uint64(0))
        self.bit_letters = np.zeros((64, len(self.words)), np.float32)
        np.add.at(self.bit_letters, np.arange(1, len(self.letters)) % 64, self.letters[1:])

    def kernel(self, strings: list[str], first: int = 0, last: int | None = None) -> np.ndarray:
        """Kernel of each string with the landmarks from ``first`` to before ``last``, over the root of the string's kernel with itself.

        By dynamic programming over the strings' characters: ``tail[p]`` at a landmark's place sums the common subsequences of
        p + 1 characters that end at or before it, weighted to the current places in both strings.  A string that has
        less than NEEDED of a landmark's letters in order, whatever is between them, is taken to have nothing of it.
        """
        codes, sizes = self.coded(strings)
        n, width = codes.shape
        has = np.zeros((n, len(self.match)), np.float32)
        has[np.arange(n)[:, None], codes] = 1
        of, mark = np.nonzero(has @ self.letters[:, first:last] >= self.needed[first:last])
        mark = mark + first
        keep = self.in_order(codes, of, mark) >= self.needed[mark]
        of, mark = of[keep], mark[keep]
        out = np.zeros((n, len(self.words[first:last])))
        if not len(of):
            return out
        whole = sizes
        # Longest strings first, so that the pairs still going are a prefix.
        sizes = sizes[of]
        order = np.argsort(-sizes, kind="stable")
        of, mark, sizes = of[order], mark[order], sizes[order]
        total = np.zeros(len(of))
        tail = [np.zeros((len(of), LONGEST), np.float32) for _ in range(ORDER - 1)]
        for i in range(width):
            k = int(np.searchsorted(-sizes, -i))
            if not k:
                break
            hit = self.match[codes[of[:k], i], mark[:k]] * np.float32(DECAY * DECAY)
            ends = [hit]
            for p in range(1, ORDER):
                end = np.zeros_like(hit)
                np.multiply(hit[:, 1:], tail[p - 1][:k, :-1], out=end[:, 1:])
                ends.append(end)
            total[:k] += ends[-1].sum(axis=1)
            for p in range(ORDER - 1):
                tail[p][:k] *= np.float32(DECAY)
                tail[p][:k] += ends[p] @ self.spread
        out[of, mark - first] = total
        some = np.unique(of)
        out[some] /= np.sqrt(_own_kernel(codes[some], whole[some]))[:, None]
        return out

    def in_order(self, codes: np.ndarray, of: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Letters of the longest common subsequence of pairs of strings and landmarks, bit by bit at once."""
        row = np.full(len(of), ~np.uint32(0))
        for i in range(codes.shape[1]):
            hit = row & self.at[codes[of, i], mark]
            row = (row + hit) | (row - hit)
        return self.count[mark] - np.bitwise_count(row & ((np.uint32(1) << self.count[mark].astype(np.uint32)) - np.uint32(1)))

    def coded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the strings' characters, 0 for those that no landmark has, and the strings' lengths."""
        sizes = np.array([len(s) for s in strings], np.int64)
        codes = np.zeros((len(strings), int(sizes.max(initial=0))), np.uint16)
        codes[np.arange(codes.shape[1])[None, :] < sizes[:, None]] = self.table[self.points("".join(strings))]
        return codes, sizes

    def points(self, text: str) -> np.ndarray:
        """Code points, those beyond the table as its last."""
        return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(self.table) - 1)

    def plausible(self, words: list[str], last: int) -> np.ndarray:
        """Whether each word, none with a newline, has the letters in order that ``kernel`` needs for any landmark before ``last``."""
        raw = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(raw == 10)
        starts = np.append(0, ends[:-1] + 1)
        masks, sizes = np.bitwise_or.reduceat(self.bits[np.minimum(raw, len(self.table) - 1)], starts), ends - starts
        out = np.zeros(len(words), bool)
        for at in range(0, len(words), 1 << 15):
            has = np.unpackbits(masks[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            of, mark = np.nonzero(has.astype(np.float32) @ self.bit_letters[:, :last] >= self.needed[:last])
            of += at
            # Only a part of a long word is seen at once, so its letters alone rule it out.
            long = sizes[of] > VIEW
            out[of[long]] = True
            of, mark = of[~long], mark[~long]
            some, place = np.unique(of, return_inverse=True)
            if len(some):
                codes, _ = self.coded([words[i] for i in some])
                out[of[self.in_order(codes, place, mark) >= self.needed[mark]]] = True
        return out


def _own_kernel(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Kernel of each string with itself; characters that no landmark has count as one and the same."""
    n, width = codes.shape
    there = np.arange(width)[None, :] < sizes[:, None]
    gap = np.arange(width)[None, :] - np.arange(width)[:, None]
    spread = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0).astype(np.float32)
    total = np.zeros(n, np.float32)
    tail = [np.zeros((n, width), np.float32) for _ in range(ORDER - 1)]
    for i in range(width):
        hit = ((codes == codes[:, i : i + 1]) & there & there[:, i : i + 1]).astype(np.float32) * np.float32(DECAY * DECAY)
        ends = [hit]
        for p in range(1, ORDER):
            end = np.zeros_like(hit)
            np.multiply(hit[:, 1:], tail[p - 1][:, :-1], out=end[:, 1:])
            ends.append(end)
        total += ends[-1].sum(axis=1)
        for p in range(ORDER - 1):
            tail[p] *= np.float32(DECAY)
            tail[p] += ends[p] @ spread
    return total


@dataclass
class Machine:
    """Landmarks, their own kernel, whitening, linear weights, and the probability of a margin.

    The first ``insults`` landmarks come from toxic documents, the others from clean ones.
    """

    landmarks: Landmarks
    insults: int
    own: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 4.0
    shift: float = 0.0

    @classmethod
    def of(cls, insults: list[str], others: list[str]) -> Machine:
        """A machine that is not trained yet."""
        marks = Landmarks([*insults, *others])
        kernel = marks.kernel(marks.words)
        own = np.diag(kernel).copy()
        kernel = kernel / own
        values, vectors = np.linalg.eigh(((kernel + kernel.T) / 2) ** POWER)
        keep = values > 1e-3
        return cls(marks, len(insults), own, vectors[:, keep] / np.sqrt(values[keep]), np.zeros(int(keep.sum())))

    def kernels(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with the landmarks, to the POWER; of a long word the most of its views.

        Words whose likeness to every insult is LIKE or less count as having none at all.
        """
        cut = [views(letters(w)) for w in words]
        every = [v for c in cut for v in c]
        out = np.zeros((len(every), len(self.own)), np.float32)
        order = np.argsort([len(v) for v in every], kind="stable")
        for at in range(0, len(every), 2048):
            part = order[at : at + 2048]
            strings = [every[i] for i in part]
            found = (self.landmarks.kernel(strings, 0, self.insults) / self.own[: self.insults]) ** POWER
            some = np.flatnonzero(found.max(axis=1, initial=0) > LIKE)
            out[part[some], : self.insults] = found[some]
            if len(some) and self.insults < len(self.own):
                rest = self.landmarks.kernel([strings[i] for i in some], self.insults, len(self.own))
                out[part[some], self.insults :] = (rest / self.own[self.insults :]) ** POWER
        starts = np.cumsum([0, *map(len, cut)])[:-1]
        return np.maximum.reduceat(out, starts, axis=0) if len(every) else out

    def suspects(self, words: list[str]) -> list[str]:
        """The words that may be like an insult at all."""
        return [w for w, p in zip(words, self.landmarks.plausible(words, self.insults).tolist(), strict=True) if p] if words else []

    def word_margins(self, words: list[str]) -> np.ndarray:
        """What each word adds to the margin of its sentence."""
        return self.kernels(words) @ (self.whiten @ self.weights)

    @cached_property
    def scorer(self) -> Scorer:
        """What this worker remembers of the words it has scored."""
        return Scorer(self)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


class Scorer:
    """Margins of texts, with what distinct words add remembered."""

    def __init__(self, machine: Machine):
        self.machine, self.recent, self.older = machine, {}, {}

    def _learn(self, words: set[str]) -> None:
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        new = words.difference(self.recent)
        known = [w for w in new if w in self.older]
        self.recent.update(zip(known, map(self.older.__getitem__, known), strict=True))
        new = list(new.difference(known))
        self.recent.update(dict.fromkeys(new, 0.0))
        new = self.machine.suspects(new)
        self.recent.update(zip(new, self.machine.word_margins(new).tolist(), strict=True))

    def margins(self, texts: list[str]) -> list[float]:
        """Margin of each text's worst sentence; that of no words for a text without any."""
        each = [{w for s in sentences(t) for w in words_of(s)} for t in texts]
        self._learn(set().union(*each))
        value, bias = self.recent.__getitem__, self.machine.bias
        return [bias + max(map(value, words), default=0.0) for words in each]


def pick_landmarks(evidence: dict[str, float], words: dict[str, int], least: int, most: int = LANDMARKS) -> list[str]:
    """Substrings by evidence, each as long as its evidence lasts.

    ``words`` (marked, with their toxic documents) are what substrings are found in: one is of use if the words that hold
    it, but no substring chosen before, have ``least`` documents.
    """
    left, chosen = dict(words), []
    for s in sorted(evidence, key=lambda s: (-evidence[s], -len(s), s)):
        if len(chosen) == most:
            break
        if sum(n for w, n in left.items() if s in w) < least:
            continue
        best = max((t for t in evidence if s in t and evidence[t] >= 0.9 * evidence[s]), key=lambda t: (len(t), evidence[t], t))
        chosen.append(best)
        left = {w: n for w, n in left.items() if s not in w}
    return list(dict.fromkeys(chosen))


def train_linear(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal, by Newton steps over the current support vectors.

    The positive examples together have the share POSITIVE of the total cost."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, POSITIVE / max(1, (y > 0).sum()), (1 - POSITIVE) / max(1, (y < 0).sum())) * cost * len(y)
    penalty = np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        own = z[inside] * weight[inside, None]
        new = np.linalg.solve(penalty + own.T @ z[inside], own.T @ y[inside])
        done = np.allclose(new, w, atol=1e-9)
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic function for weighted margins and labels 0 or 1.

    One half is where the weighted errors are fewest, whatever the margins of documents that are labelled toxic without an
    insult; the slope is the likeliest one there.
    """
    order = np.argsort(margins, kind="stable")
    m, errors = margins[order], np.where(y[order] > 0, weight[order], -weight[order])
    # Errors with a bound below each margin in turn: positives under it are missed, others from it on are false.
    missed = np.concatenate([[0.0], np.cumsum(errors)])
    missed[1:-1][np.diff(m) < 1e-6] = np.inf  # no bound between equal margins
    fewest = np.flatnonzero(missed <= missed.min() + 1e-9)
    at = int(fewest[len(fewest) // 2])
    bound = (m[max(0, at - 1)] + m[min(len(m) - 1, at)]) / 2
    x, slope = margins - bound, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x * slope, -500, 500)))
        step = ((weight * (p - y) * x).sum() + 1e-3 * slope) / ((weight * p * (1 - p) * x * x).sum() + 1e-3)
        slope = max(0.1, slope - step)
        if abs(step) < 1e-9:
            break
    return float(slope), float(-slope * bound)


def disguises(word: str, dice: Random) -> list[str]:
    """A word with one and with two characters put in, one left out, and a space inside."""

    def put(w: str, c: str) -> str:
        at = dice.randrange(1, len(w))
        return w[:at] + c + w[at:]

    one = put(word, dice.choice("abcdefghijklmnopqrstuvwxyz"))
    out = [one, put(one, dice.choice("abcdefghijklmnopqrstuvwxyz")), put(word, " ")]
    if len(word) > 4:
        at = dice.randrange(1, len(word) - 1)
        out.append(word[:at] + word[at + 1 :])
    return out


def _distinct(labelled: DataFrame) -> DataFrame:
    """(text, toxic) with one of each group of copies: equal least hash of three words in a row, and equal label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys = []
                for text in part.column("text").to_pylist():
                    words = text.lower().split()
                    three = map(" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [" ".join(words)]
                    keys.append(min(map(xxhash.xxh64_intdigest, three)) - (1 << 63))
                yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), pa.array(keys, pa.int64())], ["text", "toxic", "key"])

    keyed = labelled.select("text", "toxic").mapInArrow(run, "text string, toxic int, key long")
    return keyed.groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _counted(docs: DataFrame, find) -> DataFrame:
    """(part, n): in how many texts ``find`` (a text's distinct parts) has each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(held.values(), pa.int64())], ["part", "n"])

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    held.update(find(text))
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def _marked(text: str) -> set[str]:
    """Distinct words of a text between their marks."""
    return {v for w in set(text.lower().split()) for v in views(letters(w))}


def _substrings(text: str) -> set[str]:
    return {t[i : i + n] for t in _marked(text) for n in range(SHORTEST, LONGEST + 1) for i in range(len(t) - n + 1)}


def searching(made: dict, parts: Broadcast) -> ahocorasick.Automaton:
    """A search for the broadcast strings, made once in each worker and kept in ``made``."""
    if "search" not in made:
        made["search"] = ahocorasick.Automaton()
        for p in parts.value:
            made["search"].add_word(p, p)
        made["search"].make_automaton()
    return made["search"]


def landmarks_of(src: DataFrame) -> list[str]:
    """Landmarks from (text, toxic): substrings of toxic documents first, those frequent enough then sought in the others.

    A substring found in ``bad`` toxic documents and none else has the evidence bad times the log of 1 over the share of
    toxic documents, so fewer cannot pass; at most MAX_CANDIDATES, the most frequent, come to the driver.
    """
    toxic, clean = src.where("toxic = 1"), src.where("toxic = 0")
    n_bad, n_good = toxic.count(), clean.count()
    if not n_bad or not n_good:
        return []
    rate = n_bad / (n_bad + n_good)
    least = max(3, int(np.ceil(EVIDENCE / -np.log(rate))))
    often = _counted(toxic, _substrings).where(F.col("n") >= least)
    # Parts that are far too common in some clean documents need not be sought in all.
    few = min(n_good, 500)
    usual = _counted(clean.orderBy(F.xxhash64("text")).limit(few), _substrings).where("n > 1").select("part", F.col("n").alias("seen"))
    most = F.col("n") * (2 * (1 - PURITY) / PURITY)
    often = often.join(usual, "part", "left").where(F.coalesce("seen", F.lit(0)) * (n_good / few) <= F.greatest(most, F.lit(n_good / few)))
    bad = {r.part: r.n for r in often.orderBy(F.desc("n"), "part").limit(MAX_CANDIDATES).collect()}
    if not bad:
        return []
    parts = src.sparkSession.sparkContext.broadcast(sorted(bad))

    def seen(text: str) -> set[str]:
        return {p for _, p in searching(tool, parts).iter(" ".join(_marked(text)))}

    tool: dict = {}
    good = {r.part: r.n for r in _counted(clean, seen).collect()}
    evidence = {}
    for p, b in bad.items():
        g = good.get(p, 0)
        share = b / (b + g)
        gain = b * np.log(share / rate) + (g * np.log((1 - share) / (1 - rate)) if g else 0.0)
        if share >= PURITY and gain >= EVIDENCE:
            evidence[p] = float(gain)
    if not evidence:
        return []
    shipped = src.sparkSession.sparkContext.broadcast(sorted(evidence))

    def holding(text: str) -> set[str]:
        return {w for w in _marked(text) if any(True for _ in searching(found, shipped).iter(w))}

    found: dict = {}
    words = {r.part: r.n for r in _counted(toxic, holding).orderBy(F.desc("n"), "part").limit(MAX_CANDIDATES).collect()}
    return pick_landmarks(evidence, words, least)


def contrasts(clean: DataFrame, machine: Machine) -> list[str]:
    """For each insult the CONTRASTS words that are likest to it in most clean documents, marked.

    As landmarks they tell an insult from its likes.
    """
    shipped = clean.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped.value
        for batch in batches:
            for part in slices(batch):
                each = [{w for s in sentences(t) for w in words_of(s)} for t in part.column("text").to_pylist()]
                words = machine.suspects(sorted(set().union(*each)))
                k = machine.kernels(words) if words else np.zeros((0, machine.insults))
                place, nearest = {w: n for n, w in enumerate(words)}, Counter()
                for own in each:
                    at = np.array([place[w] for w in own if w in place], np.int64)
                    if len(at):
                        best = at[k[at].argmax(axis=0)]
                        nearest.update((m, words[i]) for m, i in enumerate(best) if k[i, m] > LIKE)
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in nearest], pa.int32()), pa.array([w for _, w in nearest], pa.string()), pa.array(nearest.values(), pa.int64())], ["insult", "word", "n"])

    found = clean.select("text").mapInArrow(run, "insult int, word string, n long").groupBy("insult", "word").agg(F.sum("n").alias("n"))
    first = F.row_number().over(W.partitionBy("insult").orderBy(F.desc("n"), "word"))
    return sorted({letters(r.word)[:LONGEST] for r in found.withColumn("place", first).where(F.col("place") <= CONTRASTS).collect()})


def _table(src: DataFrame, machine: Machine) -> DataFrame:
    """(toxic, words, likeness, features): a document's NEAREST words with some likeness to an insult, features end to end."""
    shipped = src.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped.value
        for batch in batches:
            for part in slices(batch):
                each = [sorted({w for s in sentences(t) for w in words_of(s)}) for t in part.column("text").to_pylist()]
                place = {w: n for n, w in enumerate(machine.suspects(sorted(set().union(*each))))}
                k = machine.kernels(list(place)) if place else np.zeros((0, len(machine.own)), np.float32)
                like = k[:, : machine.insults].max(axis=1, initial=0)
                chosen, ends = [], [0]
                for words in each:
                    at = np.array([place[w] for w in words if w in place], np.int64)
                    at = at[like[at] > LIKE]
                    chosen.append(at[np.argsort(-like[at], kind="stable")[:NEAREST]])
                    ends.append(ends[-1] + len(chosen[-1]))
                at = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                names, x = np.array([*place, None], object)[:-1], (k[at] @ machine.whiten).astype(np.float32)
                cut = np.array(ends, np.int32)
                columns = ((1, names[at], pa.string()), (1, like[at], pa.float32()), (x.shape[1], x.ravel(), pa.float32()))
                lists = [pa.ListArray.from_arrays(cut * n, pa.array(v, kind)) for n, v, kind in columns]
                yield pa.RecordBatch.from_arrays([part.column("toxic"), *lists], ["toxic", "words", "likeness", "features"])

    return src.select("toxic", "text").mapInArrow(run, "toxic int, words array<string>, likeness array<float>, features array<float>")


def _worst(table: DataFrame, machine: Machine, most: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(document's label, margin, word, features) of the ``most`` worst words of each document, at the driver.

    Before anything is learned likeness is the margin.
    """
    weights, bias, width = machine.weights, machine.bias, machine.whiten.shape[1]
    trained = bool(weights.any())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, margins, words, rows = [], [], [], []
            for toxic, own, like, flat in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), batch.column("likeness"), batch.column("features"), strict=True):
                x = flat.values.to_numpy().reshape(-1, width)
                f = x @ weights + bias if trained else like.values.to_numpy()
                for i in np.argsort(-f, kind="stable")[:most]:
                    labels.append(toxic)
                    margins.append(float(f[i]))
                    words.append(own[i])
                    rows.append(x[i])
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32), pa.float32())
            features = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * width, flat)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(margins, pa.float64()), pa.array(words, pa.string()), features], ["toxic", "margin", "word", "features"])

    got = table.where(F.size("words") > 0).mapInArrow(run, "toxic int, margin double, word string, features array<float>").toArrow()
    x = got.column("features").combine_chunks().flatten().to_numpy().reshape(-1, width)
    return got.column("toxic").to_numpy(), got.column("margin").to_numpy(), got.column("word").to_pylist(), x


def fit(labelled: DataFrame) -> Machine | None:
    """Train on ``labelled`` (doc_id, text, toxic 0 or 1), at most MAX_LABELLED of its documents by a digest of the id.

    The driver gets at most WORST words of each of these documents in a round, with their features.  None if no insult can
    be told.
    """
    src = labelled.select(labelled["doc_id"], F.coalesce(labelled["text"], F.lit("")).alias("text"), labelled["toxic"].cast("int").alias("toxic")).where("toxic IN (0, 1)")
    order = F.xxhash64("doc_id")
    edge = src.select(order.alias("h")).orderBy("h").limit(MAX_LABELLED).agg(F.max("h")).first()[0]
    if edge is None:
        return None
    src = written(_distinct(src.where(order <= edge)), "labelled")
    words = landmarks_of(src)
    if not words:
        return None
    machine = Machine.of(words, [w for w in contrasts(src.where("toxic = 0").orderBy(F.xxhash64("text")).limit(CONTRASTED).repartition(16), Machine.of(words, [])) if w not in words])
    table = written(_table(src, machine), "words")
    sizes = {r.toxic: r["count"] for r in src.groupBy("toxic").count().collect()}
    wrong = int(MISLABELLED * sizes[0])
    for n in range(ROUNDS):
        toxic, margins, found, x = _worst(table, machine, WORST)
        clean = toxic == 0
        highest = np.sort(margins[clean])[::-1]
        bar = max(0.0, float(highest[wrong]) if len(highest) > wrong else 0.0)
        positive = ~clean & (margins > bar)
        if not positive.any():
            return None
        more = np.zeros((0, x.shape[1]))
        if n:
            dice, worst = Random(1), sorted({w for w, p in zip(found, positive, strict=True) if p and len(w) >= SHORTEST})
            worst = dice.sample(worst, min(DISGUISED, len(worst)))
            more = machine.kernels([d for w in worst for d in disguises(w, dice)]) @ machine.whiten
        # Words that are like no insult are most of all words, so one stands for each clean document.
        plain = np.zeros((int(clean.sum()) // WORST + 1, x.shape[1]))
        rows = np.concatenate([x[positive], more, x[clean], plain])
        y = np.where(np.arange(len(rows)) < positive.sum() + len(more), 1.0, -1.0)
        machine = replace(machine)
        machine.weights, machine.bias = train_linear(rows, y)
    toxic, margins, _, _ = _worst(table, machine, 1)
    # Documents without a word of the table have the margin of no likeness at all.
    for label, n in sizes.items():
        rest = n - int((toxic == label).sum())
        toxic, margins = np.append(toxic, np.full(rest, label)), np.append(margins, np.full(rest, machine.bias))
    margins = np.maximum(margins, machine.bias)
    # All disguises together weigh as much as a share of the documents labelled toxic.
    changed = more @ machine.weights + machine.bias
    weight = np.concatenate([np.where(toxic > 0, 1.0, FALSE_ALARM), np.full(len(changed), CHANGED * toxic.sum() / max(1, len(changed)))])
    machine.slope, machine.shift = calibrate(np.concatenate([margins, changed]), np.concatenate([toxic, np.ones(len(changed))]).astype(float), weight)
    return machine


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``: probability that it is toxic, and whether that is 0.5 or more.

    A null or empty text scores as one without words.  Without a machine all scores are 0.  Only doc_id and text are read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped.value
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                scores = machine.probability(np.array(machine.scorer.margins(texts))) if machine else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
