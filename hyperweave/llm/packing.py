"""Packing examples into training sequences: vector bin packing with the dot-product heuristic.

Every example demands a vector (tokens, segments, loss-bearing tokens); a sequence has a capacity in each
dimension. One sequence is open at a time. The next example is the one, of those that fit, whose demand has
the largest dot product with what the sequence has left, both as shares of the capacity, so that examples that
use what is plentiful go first (ties: the earlier example).

Scale: packing is local to a task. Each task packs what it reads in windows of bounded size and carries what is
left to the next window, so there is no shuffle at all, and a lost task is simply run again: its sequences hold
its own rows only, and their ids start with the task's partition number.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm.common import table, trimmed

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 64
WINDOW_ITEMS = 512
CACHE_WORDS = 1_000_000
END_ID = 1

# Fixed values of the vocabulary: its pre-token classes for plain text (the apostrophe, which begins contractions,
# is left out), and the characters that stand for the bytes of other letters.
PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+").fullmatch
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+").findall
BYTE_CHARS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose(demand: np.ndarray, share: np.ndarray, left: np.ndarray, capacity: np.ndarray) -> int:
    """The row of ``demand`` that fits in ``left`` with the largest dot product; -1 if none fits.

    ``share``: demand / capacity."""
    score = share @ (left / capacity)
    score[(demand > left).any(1)] = -1.0
    best = int(score.argmax())
    return best if score[best] >= 0 else -1


class Packer:
    """Packs examples as they come. ``cut``: examples may be cut anywhere, so sequences fill up wholly.

    ``add`` and ``finish`` return closed sequences: lists of (example key, start, tokens, loss tokens).
    Without ``cut`` an example larger than the capacity gets a sequence of its own.
    With ``cut`` each sequence has ``capacity`` tokens or a power of two of them, so none needs padding.
    The loss-bearing tokens of a cut example are taken to be spread evenly, rounded up for the first part.
    """

    def __init__(self, tokens: int, segments: int, loss_tokens: int, window: int, cut: bool):
        self.capacity = np.array([tokens, segments, loss_tokens], np.int64)
        if (self.capacity < 1).any():
            raise ValueError("every capacity must be at least 1")
        self.window, self.cut = window, cut
        self.keys: list = []
        self.starts: list[int] = []
        self.demands: list[tuple[int, int, int]] = []

    def add(self, key, tokens: int, loss: int, segments: int = 1) -> list[list[tuple]]:
        out, start, full = [], 0, int(self.capacity[0])
        if self.cut:
            whole = loss
            while tokens - start >= full and min(whole, full) <= self.capacity[2]:
                part = min(whole, full)
                out.append([(key, start, full, part)])
                start, whole = start + full, whole - part
            loss = whole
        if tokens > start or not self.cut:
            self.keys.append(key)
            self.starts.append(start)
            self.demands.append((tokens - start, segments, loss))
        if len(self.keys) >= self.window:
            out += self._pack(last=False)
        return out

    def finish(self) -> list[list[tuple]]:
        return self._pack(last=True)

    def _pack(self, last: bool) -> list[list[tuple]]:
        keys, starts = self.keys, self.starts
        demand = np.array(self.demands, np.int64).reshape(-1, 3)
        there = np.arange(len(keys))
        out = []
        # A window that is not the last keeps half of its examples back, for the choice among them.
        keep = 0 if last else len(keys) // 2
        while len(there) > keep:
            left, own = self.capacity.copy(), []
            d = demand[there]
            share = d / self.capacity
            while len(there) and left.min() > 0:
                i = choose(d, share, left, self.capacity)
                if i < 0:
                    if not self.cut:
                        break
                    # none fits: the one with the best part that fits is cut
                    fit = np.floor(d[:, 0] * np.minimum(1.0, (left / np.maximum(d, 1)).min(1))).astype(np.int64)
                    fit[left[1] < 1] = 0
                    i = int(fit.argmax())
                    take = int(fit[i])
                    if take < 1:
                        break
                    k = there[i]
                    loss = min(int(-(-demand[k, 2] * take // demand[k, 0])), int(left[2]))
                    own.append([k, starts[k], take, loss])
                    starts[k] += take
                    demand[k] -= (take, 0, loss)
                    left -= (take, 1, loss)
                    d[i], share[i] = demand[k], demand[k] / self.capacity
                    continue
                k = there[i]
                own.append([k, starts[k], int(demand[k, 0]), int(demand[k, 2])])
                left -= demand[k]
                keep_rows = np.arange(len(there)) != i
                there, d, share = there[keep_rows], d[keep_rows], share[keep_rows]
            if not own:  # without cutting: an example over the capacity stands alone
                k, there = there[0], there[1:]
                own.append([k, starts[k], int(demand[k, 0]), int(demand[k, 2])])
            elif self.cut:
                there = self._trim(own, there, demand, starts)
            out.append([(keys[k], s, n, loss) for k, s, n, loss in own])
        self.keys = [keys[k] for k in there]
        self.starts = [starts[k] for k in there]
        self.demands = [tuple(demand[k].tolist()) for k in there]
        return out

    def _trim(self, own: list[list], there: np.ndarray, demand: np.ndarray, starts: list[int]) -> np.ndarray:
        """Cut a sequence that isn't full back to a power of two; what goes stays to be packed."""
        total = sum(x[2] for x in own)
        if total == self.capacity[0]:
            return there
        over = total - (1 << (total.bit_length() - 1))
        while over:
            k, start, n, loss = own.pop()
            gone = min(over, n)
            back = min(loss, -(-loss * gone // n))
            waits = (there == k).any()  # its rest, cut off before, still waits
            starts[k] = start + n - gone
            demand[k] = (gone + (demand[k, 0] if waits else 0), 1, back + (demand[k, 2] if waits else 0))
            if not waits:
                there = np.append(there, k)
            if gone < n:
                own.append([k, start, n - gone, loss - back])
            over -= gone
        return there


def pack_examples(df: DataFrame, key: str, tokens: str, loss_tokens: str, segments: str | None = None, *, max_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss_tokens: int = SEQUENCE_TOKENS, window: int = WINDOW_ITEMS) -> DataFrame:
    """Place whole examples, as instruction data needs: (key, tokens, loss_tokens, segments, sequence_id, offset, oversized).

    Sizes that are null or negative count as 0 (``segments``: 1); an empty example takes a place of no tokens.
    Repeated rows are examples of their own. An example over a limit stands alone, marked ``oversized``.
    Other columns of ``df`` do not matter. An empty table gives an empty result.
    """
    size = lambda c, least=0: F.greatest(F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(least)), F.lit(least)).cast("long")
    took = df.select(F.col(f"`{key}`").alias("key"), size(tokens).alias("tokens"), size(loss_tokens).alias("loss_tokens"), (size(segments, 1) if segments else F.lit(1).cast("long")).alias("segments"))
    limits = (max_tokens, max_segments, max_loss_tokens)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ids = Packer(*limits, window, cut=False), _sequence_ids()

        def rows(sequences):
            got = [(*k, next_id, at) for seq in sequences for next_id in (next(ids),) for k, at in zip([x[0] for x in seq], np.cumsum([0] + [x[2] for x in seq]).tolist())]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], t) for i, t in enumerate((key_type, *[pa.int64()] * 5))] + [pa.array([x[1] > limits[0] or x[3] > limits[1] or x[2] > limits[2] for x in got], pa.bool_())], names=["key", "tokens", "loss_tokens", "segments", "sequence_id", "offset", "oversized"])

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            done = []
            for k, n, loss, seg in zip(*(c.to_pylist() for c in batch.columns)):
                done += packer.add((k, n, loss, seg), n, loss, seg)
            yield rows(done)
        if key_type is not None:
            yield rows(packer.finish())

    return took.mapInArrow(pack, f"key {took.schema['key'].dataType.simpleString()}, tokens long, loss_tokens long, segments long, sequence_id long, offset long, oversized boolean")


def _sequence_ids() -> Iterator[int]:
    n = TaskContext.get().partitionId() << 40
    while True:
        yield n
        n += 1


class WordTokens(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of texts under a vocabulary that ends words at white space.

    Words between spaces and newlines are encoded once and kept, up to ``CACHE_WORDS``, within one task; a text's ids are the join of
    its words' ids.
    """

    def __init__(self, path: str):
        super().__init__({b"": b""})
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # of words in lower case, which no longer hold their strings
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]

    def _run(self, run: str) -> bytes:
        """Ids of one pre-token; the vocabulary's model takes its bytes as printable characters."""
        raw = run.encode()
        found = self.get(raw)
        if found is None:
            chars = run if run.isascii() else raw.decode("latin-1").translate(BYTE_CHARS)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(chars)]).tobytes()
        return found

    def __missing__(self, word: bytes) -> bytes:
        """Plain Latin letters, digits and marks need only lower case and are cut into pre-tokens here; any other word
        goes through the whole tokenizer."""
        text = word.decode()
        plain = text.lower()
        if len(word) <= 64 and PLAIN(plain):
            runs = RUNS(plain)
            ids = self._run(plain) if len(runs) == 1 else b"".join(map(self._run, runs))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self[b""] = b""

    def _with_special(self, text: bytes) -> bytes:
        """Ids of a text that holds strings of added tokens: those words go through the whole tokenizer as they are."""
        whole = lambda t: array("I", self.whole.encode(t.decode(), add_special_tokens=False).ids).tobytes()
        if any(b" " in s or b"\n" in s for s in self.special):
            return whole(text)
        return b"".join(whole(w) if any(s in w for s in self.special) else self.encode(w) for w in text.replace(b"\n", b" ").split(b" "))

    def encode(self, text: bytes) -> bytes:
        if any(s in text for s in self.special):
            return self._with_special(text)
        if len(self) > CACHE_WORDS:
            self.forget()
        # ASCII letters may be lower-cased first, as the vocabulary does; not beside combining marks, which
        # are composed before that.
        if b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace(b"\n", b" ").split(b" ")))


_TOKENS: dict[str, WordTokens] = {}


def _tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss_tokens: int = SEQUENCE_TOKENS, window: int = WINDOW_ITEMS) -> DataFrame:
    """Tokenise whole documents and pack them, cut where needed; one row per piece (columns of ``PIECES``).

    Strings of the vocabulary's added tokens become those tokens, as its tokenizer has it. All tokens of a document bear
    loss. A null text is empty and has the end id alone; a null id stays null;
    repeated rows are documents of their own; a very long text is cut into full sequences as it is read.
    Other columns of ``docs``, whatever their names, are not read. An empty table gives an empty result.
    ``vocabulary``: path of a tokenizer file that every executor has.
    """
    limits = (max_tokens, max_segments, max_loss_tokens, window)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, ids = _tokens(vocabulary), Packer(*limits, cut=True), _sequence_ids()
        kept: dict[int, list] = {}  # serial: [doc_id, tokens, bytes, offset in bytes, tokens not yet placed]
        serial = 0

        def rows(sequences):
            cols = [[] for _ in range(7)]
            for seq in sequences:
                sequence, at = next(ids), 0
                for key, start, n, _ in seq:
                    doc = kept[key]
                    for c, v in zip(cols, (doc[0], start, n, zlib.crc32(doc[2][4 * start : 4 * (start + n)]), doc[1], sequence, at)):
                        c.append(v)
                    at += n
                    doc[3] -= n
                    if not doc[3]:
                        del kept[key]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            done = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                got = words.encode(text.as_py())
                n = len(got) // 4 + 1
                kept[serial] = [doc_id, n, got + end, n]
                done += packer.add(serial, n, n)
                serial += 1
                if len(done) > 1024:
                    yield rows(done)
                    done = []
            if done:
                yield rows(done)
        yield rows(packer.finish())
        words.forget()  # the process goes on to other stages

    took = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return took.mapInArrow(trimmed(pack), PIECES)


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
