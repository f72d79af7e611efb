"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text gives the longest match of what comes next: a text is parsed
into phrases, each the longest string that occurs in the language's sample (or one character that does not). The
language that needs the fewest phrases for a text's characters, fewest per character, wins.

A phrase is followed by single steps through the automaton and ends where there is no step, so parsing needs its
transitions only. Every letter of every script has a number of its own. The transitions of all languages are one hash
table, or, where all pairs of states and letters are ``PLAIN_CELLS`` at most (64 MB), one plain table, which is faster.
Texts are parsed in lanes side by side, a character of every lane at a time. Long texts are cut into pieces of ``PIECE``
characters, each a lane, whose phrases are added up; a piece is entered ``WARM`` characters before it begins, where
parsing falls in step with that of the text before (on random texts, under one phrase in 3 000 differs).

Scale: learned from a bounded sample of labelled text (``SAMPLE_SLOTS`` excerpts and ``SAMPLE_CHARS`` characters of a
language, ``TOTAL_SLOTS`` and ``TOTAL_CHARS`` in all, shared out evenly among the languages); then one narrow stage
reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import parts, table, trimmed

SAMPLE_SLOTS, SAMPLE_CHARS, TEXT_CHARS = 128, 24_000, 1_200
TOTAL_SLOTS, TOTAL_CHARS, MAX_LANGUAGES = 32_768, 1_000_000, 8_192
PIECE, WARM, LANES, PLAIN_CELLS = 512, 48, 32_768, 1 << 24
UNKNOWN = "und"


def plain(text: str) -> str:
    """Lower case, every run of other characters than letters one space."""
    out = "".join(c if c.isalpha() else " " for c in text.lower())
    return " ".join(out.split())


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a string; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


LETTER_BITS = 21
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Steps:
    """Transitions (state, letter) -> state by open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, states: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.keys, self.states = np.full(1 << (64 - int(self.shift)), -1, np.int64), np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left, at = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.keys[slot], self.states[slot] = keys[put], states[put]
            rest = self.keys[at] != keys[left]
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def step(self, now: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """States reached from ``now`` (a row for each text, a column for each language), or -1."""
        return self.get((now.astype(np.int64) << LETTER_BITS | letter[:, None]).ravel()).reshape(now.shape)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The state reached, or -1; keys have one dimension."""
        at = self.place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.states[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            found, wanted = self.keys[at], keys[left]
            out[left] = np.where(found == wanted, self.states[at], np.int32(-1))
            rest = (found != wanted) & (found >= 0)
            left, at = left[rest], at[rest]
        return out


class PlainSteps:
    """The same as a table of all pairs."""

    def __init__(self, keys: np.ndarray, states: np.ndarray, size: int, letters: int):
        self.letters, self.states = letters, np.full(size * letters, -1, np.int32)
        self.states[(keys >> LETTER_BITS) * letters + (keys & (1 << LETTER_BITS) - 1)] = states

    def step(self, now: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return self.states[now * np.int32(self.letters) + letter[:, None]]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # code point -> letter's number, for those under its length; 1 for letters not learned
    starts: np.ndarray  # each language's start state
    first: np.ndarray  # [language, letter] -> state reached from the start, which itself where there is no such step
    steps: Steps | PlainSteps


def fit(samples: dict[str, list[str]]) -> Model:
    """From excerpts of each language, which give equal parts of what is taken."""
    languages = sorted(samples)
    size = min(SAMPLE_CHARS, TOTAL_CHARS // max(1, len(languages)))
    texts = {k: plain(" ".join(plain(t)[: max(32, size // max(1, len(samples[k])))] for t in samples[k]))[:size] for k in languages}
    letters = sorted(set().union(*texts.values(), " ") - {" "})
    codes = np.ones(ord(max(letters, default=" ")) + 1, np.int32)
    codes[32] = 0
    codes[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
    starts, keys, reached, base = [], [], [], 0
    first = np.zeros((len(languages), len(letters) + 2), np.int32)
    for k, name in enumerate(languages):
        step = automaton(codes[[ord(c) for c in texts[name]]].tolist())
        first[k] = base
        for c, to in step[0].items():
            first[k, c] = base + to
        keys += [(base + s) << LETTER_BITS | c for s, out in enumerate(step) if s for c in out]
        reached += [base + to for s, out in enumerate(step) if s for to in out.values()]
        starts.append(base)
        base += len(step)
    table = np.array(keys, np.int64), np.array(reached, np.int32)
    steps = PlainSteps(*table, base, len(letters) + 2) if base * (len(letters) + 2) <= PLAIN_CELLS else Steps(*table)
    return Model(languages, codes, np.array(starts, np.int32), first, steps)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letters_of(texts: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letter numbers, offsets) of plain texts: one block of whole texts at once."""
    low = pc.utf8_lower(texts.fill_null("").cast(pa.large_string()))
    joined = "\n".join(low.to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    kind = (LETTER if int(points.max()) < len(LETTER) else letter_table())[points]
    number = np.where(kind, codes[np.minimum(points, len(codes) - 1)], 0).astype(np.int32)
    number[(points >= len(codes)) & kind] = 1
    keep = kind.copy()
    # a run of others is one space, where it begins; those at a text's start and end go
    begins = np.zeros(len(points), bool)
    begins[offsets[:-1]] = True
    keep[1:] |= ~kind[1:] & kind[:-1] & ~begins[1:]
    keep[offsets[1:] - 1] = False
    number, offsets = number[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    last = offsets[1:] - 1
    trailing = (np.diff(offsets) > 0) & (number[np.maximum(last, 0)] == 0 if len(number) else False)
    offsets[1:] -= np.cumsum(trailing)
    return np.delete(number, last[trailing]), offsets


LETTER = np.array([chr(i).isalpha() for i in range(0x3000)])


def count_phrases(model: Model, numbers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each text (row) in each language (column)."""
    n, languages = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, languages), np.int64)
    lengths = np.diff(offsets)
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(n), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    warm = np.where(nth > 0, WARM, 0)
    begin = offsets[:-1][owner] + PIECE * nth
    size = np.minimum(offsets[1:][owner] - begin, PIECE) + warm
    begin -= warm
    order = np.argsort(-size, kind="stable")
    width = max(64, LANES // max(1, languages))
    every = np.arange(languages)
    for at in range(0, len(order), width):
        lanes = order[at : at + width]
        where, left, skip = begin[lanes], size[lanes], warm[lanes]
        states = np.tile(model.starts, (len(lanes), 1))
        phrases = np.zeros((len(lanes), languages), np.int32)
        live = len(lanes)
        for i in range(int(left[0]) if len(left) else 0):
            while live and left[live - 1] <= i:
                live -= 1
            now, c = states[:live], numbers[where[:live] + i]
            reached = model.steps.step(now, c)
            # no step (as at the start): a phrase begins with this character, if the language has it at all
            fresh = reached < 0
            states[:live] = np.where(fresh, model.first[every, c[:, None]], reached)
            phrases[:live] += fresh if i >= WARM else fresh & (skip[:live, None] <= i)
        np.add.at(out, owner[lanes], phrases)
    return out


def labelled_texts(docs: DataFrame, keep: Column, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Excerpts of each language: of the labelled documents that hash to one of so many slots, the first by hash gives
    ``TEXT_CHARS`` characters from a place in its whole text that the hash chooses. Every language has its slots: up to
    ``SAMPLE_SLOTS``, of ``TOTAL_SLOTS`` in all; more than ``MAX_LANGUAGES`` are an error."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & keep).withColumn("h", F.xxhash64("doc_id"))
    languages = rows.select("lang").distinct().count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MAX_LANGUAGES} can be learned")
    slots = max(4, min(SAMPLE_SLOTS, TOTAL_SLOTS // max(1, languages)))
    first = rows.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    picked = [tuple(r) for r in first.collect()]  # at most so many slots
    if not picked:
        return {}
    wanted = docs.sparkSession.createDataFrame(picked, "lang string, h long")
    begin = F.pmod("h", F.greatest(F.length("text") - TEXT_CHARS + 1, F.lit(1))).cast("int") + 1
    near = rows.join(F.broadcast(wanted), ["lang", "h"]).select("lang", "h", F.substring("text", begin, F.lit(TEXT_CHARS)).alias("text"))
    got = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(map(tuple, got.collect())):
        out.setdefault(r[0], []).append(r[2])
    return {k: v for k, v in out.items() if any(c.isalpha() for t in v for c in t)}


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text.

    Texts that are null or have no letter are ``und`` with score 0, as all are where nothing was learned. The score is
    the share of the runner-up in the phrases of both (0.5: a tie, which goes to the first in order of names); with one
    language it is 1. A null id stays null; repeated rows stay repeated; no other column is read. An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for part in parts(batch, 1):
                best, score = np.full(part.num_rows, len(m.languages)), np.zeros(part.num_rows)
                if m.languages:
                    numbers, offsets = letters_of(part.column(1), m.codes)
                    has = np.diff(offsets) > 0
                    p = count_phrases(m, numbers, offsets)[has]
                    best[has] = p.argmin(1)
                    if p.shape[1] > 1:
                        two = np.partition(p, 1, axis=1)[:, :2]
                        score[has] = two[:, 1] / two.sum(1)
                    else:
                        score[has] = 1.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    took = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return took.mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: language of all documents, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(labelled_texts(docs, ~held_out, "doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
