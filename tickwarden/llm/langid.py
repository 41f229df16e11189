"""Language by cross-parsing: the language whose sample a text can be put together from with the fewest phrases."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwarden.llm.sampling import sample
from tickwarden.llm.words import fold

SAMPLE = 30_000  # characters of labelled text a language
TOTAL = 240_000  # characters of all languages together; with more languages each gets less
LONGEST = 3_000  # of one labelled text; longer ones give a piece
DENSE = 64  # codes with a column of the table: 0 for what is no letter, 1 for letters that the sample lacks, 62 letters
BLOCK = 512  # characters of a text that one lane parses
LANES = 2048  # blocks parsed side by side
PHRASE = 1 << 29  # added to a table entry for each phrase that ends there
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point whether it is a letter (2), a mark (1) or neither (0)."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            kinds[c] = 2
        elif c > 767 and unicodedata.category(s)[0] == "M":
            kinds[c] = 1
    return kinds


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


def plain(text: str, kinds: np.ndarray) -> np.ndarray:
    """Lower-case code points; each run of what is neither letter nor mark becomes one space."""
    p = points(text.lower())
    space = kinds[p] == 0
    p = np.where(space, 32, p)
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[:1] = True
    return p[keep]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence: from state 0 it reads exactly its substrings."""
    move, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(move)
        move.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return move


class Language:
    """Codes of the sample's letters, and where each state of its automaton goes on, with a mark for phrases that end.

    The most frequent letters have columns in a table; the moves of all others are sorted by (state, code).
    """

    def __init__(self, name: str, text: str, kinds: np.ndarray) -> None:
        p = plain(text, kinds)
        letters = [c for c, _ in sorted(Counter(p[p != 32].tolist()).items(), key=lambda x: (-x[1], x[0]))]
        self.name, self.length = name, max(2, len(p))
        self.codes = np.where(kinds > 0, 1, 0).astype(np.uint16)
        self.codes[letters] = np.arange(2, 2 + len(letters), dtype=np.uint16)
        move = automaton(self.codes[p].tolist())
        start = np.full(DENSE, 2 * PHRASE, dtype=np.int32)  # the phrase so far, and a letter that is one by itself
        self.alone = np.zeros(2 + len(letters), dtype=np.int32)
        for c, to in move[0].items():
            self.alone[c] = to * DENSE
            if c < DENSE:
                start[c] = PHRASE + to * DENSE
        table = np.tile(start, (len(move), 1))
        table[0] -= PHRASE  # there is no phrase yet
        far = []
        for state, moves in enumerate(move):
            for c, to in moves.items():
                if c < DENSE:
                    table[state, c] = to * DENSE
                else:
                    far.append((state * DENSE << 16 | c, to * DENSE))
        self.table = table.ravel()
        self.far, self.far_to = np.array(sorted(far), dtype=np.int64).reshape(-1, 2).T.copy()

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where each lane goes from its state with its code, plus PHRASE for each phrase that ends there."""
        if not len(self.far):
            return self.table.take(state + code)
        far = np.flatnonzero(code >= DENSE)
        went = self.table.take(state + np.where(code < DENSE, code, 1))
        if len(far):
            s, c = state[far], code[far]
            keys = s.astype(np.int64) << 16 | c
            at = np.minimum(np.searchsorted(self.far, keys), len(self.far) - 1)
            went[far] = np.where(self.far[at] == keys, self.far_to[at], self.alone[c] + np.where(s > 0, PHRASE, 0))
        return went

    def phrases(self, blocks: np.ndarray, active: np.ndarray, lengths: np.ndarray, lane: np.ndarray, joined: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that end inside, state at the end) of each block of whole texts, parsed as if they were not cut.

        `blocks` is (step, lane); at step t only the first active[t] lanes still have text; block k is in lane[k] and
        goes on where block k - 1 ends if joined[k]; block 0 starts in state `first`. All blocks are parsed from the empty state at
        first. Then each joined one is parsed again from the state in which the block before it ends, until it meets the
        first parse, from where both agree; blocks after one that ends otherwise than before take another turn.
        """
        codes = self.codes[blocks]
        state = np.zeros(blocks.shape[1], dtype=np.int32)
        state[lane[0]] = first
        count = np.zeros(blocks.shape[1], dtype=np.int16)
        states, counts = np.zeros(blocks.shape, dtype=np.int32), np.zeros(blocks.shape, dtype=np.int16)
        for t, n in enumerate(active):
            if n == 0:
                break
            went = self.step(state[:n], codes[t, :n])
            count[:n] += (went >> 29).astype(np.int16)
            np.bitwise_and(went, PHRASE - 1, out=state[:n])
            states[t, :n], counts[t, :n] = state[:n], count[:n]
        whole, end = count[lane].astype(np.int64), state[lane]
        plain_whole, plain_end = whole.copy(), end.copy()
        todo = np.flatnonzero(joined)
        todo = todo[end[todo - 1] > 0]
        while len(todo):
            before = end[todo].copy()
            live, s, n = todo, end[todo - 1], np.zeros(len(todo), dtype=np.int64)
            for t in range(BLOCK):
                at = lane[live]
                went = self.step(s, codes[t, at])
                n, s = n + (went >> 29), went & (PHRASE - 1)
                met, over = s == states[t, at], lengths[live] == t + 1
                done = met | over
                if done.any():
                    who = live[done]
                    whole[who] = np.where(met[done], n[done] + plain_whole[who] - counts[t, at[done]], n[done])
                    end[who] = np.where(met[done], plain_end[who], s[done])
                    live, s, n = live[~done], s[~done], n[~done]
                    if not len(live):
                        break
            after = todo[end[todo] != before] + 1
            after = after[after < len(lane)]
            todo = after[joined[after]]
        return whole, end


class Model:
    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.kinds = _letters()
        self.languages = [Language(name, text, self.kinds) for name, text in samples]

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, score) of each text; texts are parsed some LANES blocks at a time."""
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        whole, owner = [], []
        totals = np.zeros((len(self.languages), len(texts)))
        sizes = np.zeros(len(texts))
        states = [0] * len(self.languages)
        for i, t in enumerate(texts):
            if t and (self.kinds[points(t)] == 2).any():
                p = plain(t, self.kinds)
                sizes[i] = len(p)
                for at in range(0, len(p), BLOCK):
                    whole.append(p[at:at + BLOCK])
                    owner.append(i)
                    if len(whole) == LANES:
                        states = self._parse(whole, owner, totals, states, at + BLOCK < len(p))
                        whole, owner = [], []
        if whole:
            self._parse(whole, owner, totals, states, False)
        if not self.languages:
            return iter(found)
        bits = np.array([math.log2(x.length) for x in self.languages])[:, None]
        cost = totals * bits
        for i in np.flatnonzero(sizes):
            order = np.argsort(cost[:, i], kind="stable")
            best = cost[order[0], i]
            second = cost[order[1], i] if len(order) > 1 else 2 * best
            found[i] = self.languages[order[0]].name, float(second / (best + second))
        return iter(found)

    def _parse(self, whole: list[np.ndarray], owner: list[int], totals: np.ndarray, states: list[int], goes_on: bool) -> list[int]:
        """Add the phrases of the blocks to `totals`; `states` are those before the first block, the result those after
        the last one where its text goes on, else 0."""
        lengths = np.array([len(w) for w in whole])
        order = np.argsort(-lengths, kind="stable")
        lane = np.empty_like(order)
        lane[order] = np.arange(len(order))
        blocks = np.zeros((len(whole), BLOCK), dtype="<u4")
        for k, w in enumerate(whole):
            blocks[lane[k], :lengths[k]] = w
        blocks = np.ascontiguousarray(blocks.T)
        active = np.searchsorted(-lengths[order], -np.arange(BLOCK), side="left")
        who = np.array(owner)
        joined = np.r_[False, who[1:] == who[:-1]]
        last = np.r_[~joined[1:], not goes_on]
        after = []
        for n, language in enumerate(self.languages):
            count, end = language.phrases(blocks, active, lengths, lane, joined, states[n])
            totals[n] += np.bincount(who, weights=count + (last & (end > 0)), minlength=totals.shape[1])
            after.append(int(end[-1]) if goes_on else 0)
        return after


_models: dict[int, Model] = {}


def model(samples: tuple[tuple[str, str], ...]) -> Model:
    """One model a set of samples and Python worker."""
    mark = zlib.crc32(repr(samples).encode("utf-8", "replace"))
    if mark not in _models:
        _models.clear()
        _models[mark] = Model(samples)
    return _models[mark]


def fit(labelled: DataFrame) -> tuple[tuple[str, str], ...]:
    """(language, sample text) in order, from (label, key, text): SAMPLE characters a language, TOTAL in all.

    Texts of more than LONGEST characters give a piece of that length, so a language of long texts only is learned too.
    """
    got: dict[str, str] = {}
    for label, _, text in sample(labelled.filter("label is not null"), None, rows=400, characters=SAMPLE, longest=LONGEST, pieces=True):
        got[label] = got.get(label, "") + text + "\n"
    most = min(SAMPLE, TOTAL // max(1, len(got)))
    return tuple((name, got[name][:most]) for name in sorted(got))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, lang_pred, score) for each row; `row` is the input row as a struct.

    The whole text is lower-cased, runs of anything but letters and marks become one space, and for each language it is
    parsed greedily into the longest phrases that occur in the language's sample, found by the suffix automaton of the
    sample. The language with the fewest phrases, each weighed by log2 of the sample's length, wins; ties go to the first
    name. score: the runner-up's share of both costs, 0.5 for a tie; 2/3 with one language.

    Null texts and texts without a letter, and all texts if no language was learned, are `und` with score 0. Repeated
    rows are kept. No rows give no rows.
    """
    names = docs.columns
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = names.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model(sent.value).predict
        for batch in batches:
            found = []
            for start in range(0, batch.num_rows, 256):
                found += predict(batch.column(at).slice(start, 256).to_pylist())
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays(
                [row, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["row", "lang_pred", "score"])

    return docs.mapInArrow(work, schema)


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """(label, key, text) of the rows a model may learn from."""
    rows = docs.select(docs[label].alias("label"), docs[key].alias("key"), docs[text].alias("text"))
    return rows.filter(fold(F.col("key"), folds) != held)
