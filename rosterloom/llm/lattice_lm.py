"""Language-model scores of documents: marginal probability over all segmentations into subwords.

The pieces are those of an existing public vocabulary; they are not trained.  A document is generated as a
sequence of pieces: a word begins with a piece marked by ``MARK``, a document ends with the end piece.  The probability
of a word is the sum over all its segmentations of the products of its pieces' probabilities, by a forward recursion in
log space over the lattice of pieces.  Pieces never cross a word, so the probability of a document is the product over its
words, times that of the end.  Every character can also be told by the vocabulary's byte pieces, so each text has
a probability above 0.

The vocabulary's own scores give the first weights (``prior``: its scores are ranks, read as a Zipf law) and stay as
``PRIOR`` pieces' worth of evidence.  ``ROUNDS`` rounds of expectation and maximisation over the word counts of all
training documents revise them: expected uses of the pieces, by forward and backward recursions over each distinct
training word, are summed by Spark; only the sums per piece of the fixed vocabulary come to the driver.

Texts are read once into blocks of documents with their words (``block_index``).  Counts, model and lattice are worked out
once per distinct word and brought to the blocks by a join; documents are summed within their block.

Defined cases: null and empty texts have the end alone; a document without doc_id is a training document (its id
as text is empty); repeated rows count and are scored each; without training documents all counts are 0 and the prior alone
is the model; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.block_index import byte_table, whole_blocks
from rosterloom.session import cut_lineage

PIECES_32K = "piece_bpe_32k.model"
MARK = "▁"
PRIOR = 10_000.0
ROUNDS = 2
FOLDS, HELD_OUT = 5, 1
WORDS_PER_STEP = 20_000
WORD_BYTES = byte_table(b"\t\n\x0b\x0c\r")
_LOG10 = np.log(10.0)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def trains(doc_id: int | None) -> bool:
    return not held_out(doc_id)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes as places in a filter of 2 ** _FILTER_BITS cells."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Vocabulary:
    """Pieces of a public vocabulary that can occur in lower-cased words, numbered, with the end piece last."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found, scores, self.byte = {}, [], np.full(256, -1)
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(text[3:5], 16)] = len(scores)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            elif MARK in text[1:] or any("A" <= c <= "Z" or c in " \t\n\x0b\x0c\r" for c in text):
                continue
            else:
                found[text] = len(scores)
            scores.append(model.get_score(i))
        if (self.byte < 0).any() or MARK not in found:
            raise ValueError(f"{path}: byte pieces and {MARK} are needed")
        self.pieces = found
        self.end = len(scores)
        self.size = len(scores) + 1
        # The scores are ranks in order of merging, 0 first; pieces without one are put last, byte pieces among them.
        rank = -np.array([*scores, 0.0])
        rank[self.byte] = len(scores)
        rank = np.clip(rank, 0, len(scores))
        self.prior = 1 / (rank + 2)
        self.prior /= self.prior.sum()
        self._index()

    def _index(self) -> None:
        """Per length the pieces by hash, and a filter of the hashes of all beginnings of pieces."""
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.beginnings = np.zeros(1 << _FILTER_BITS, bool)
        lengths: dict[int, list[str]] = {}
        for text in self.pieces:
            lengths.setdefault(len(text), []).append(text)
        for length, texts in lengths.items():
            codes = _codes("".join(texts)).reshape(len(texts), length)
            h = np.zeros(len(texts), np.uint64)
            for k in range(length):
                h = h * _BASE + codes[:, k] + np.uint64(1)
                self.beginnings[_spread(h)] = True
            order = np.argsort(h)
            self.by_length[length] = (h[order], codes[order], np.array([self.pieces[t] for t in texts])[order])
        self.longest = max(self.by_length)


@lru_cache(maxsize=2)
def vocabulary(name: str = PIECES_32K) -> Vocabulary:
    return Vocabulary(name if "/" in name else public_tokenizers.path(name))


class Lattices:
    """The lattices of several words, worked on together.

    A word of n characters has n + 2 nodes: before its mark, behind it, and behind each character.  Arcs are the pieces that
    stand between two nodes, and for each character its bytes as one arc.  A mark inside a word is no beginning; it can only
    be told by its bytes, while the mark of the word cannot.  A step handles the arcs into one place of every word.
    """

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        code = _codes("".join([MARK + w for w in words]))
        self.lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(self.lengths)])
        word = np.repeat(np.arange(len(words)), self.lengths)
        at = np.arange(len(code)) - first[word]
        node = np.arange(len(code)) + word
        starts, ends, names = [], [], []
        left, mark = self.lengths[word] - at, np.uint64(ord(MARK))
        here = np.flatnonzero((at == 0) | (code != mark))
        h = np.zeros(len(here), np.uint64)
        for length in range(1, vocabulary.longest + 1):
            h = h * _BASE + code[here + length - 1] + np.uint64(1)
            going = vocabulary.beginnings[_spread(h)]
            here, h = here[going], h[going]
            if length in vocabulary.by_length and len(here):
                hashes, codes, numbers = vocabulary.by_length[length]
                place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                met = np.flatnonzero(hashes[place] == h)
                spelled = (code[here[met][:, None] + np.arange(length)] == codes[place[met]]).all(axis=1)
                met = met[spelled]
                starts.append(node[here[met]])
                ends.append(node[here[met]] + length)
                names.append(numbers[place[met]])
            more = left[here] > length
            here, h = here[more], h[more]
        inner = np.flatnonzero(at > 0)
        self.name = np.concatenate([np.empty(0, np.int64), *names])
        self.bytes = self._bytes(code[inner].astype(np.int64), vocabulary)
        self.start = np.concatenate([*starts, node[inner]]).astype(np.int64)
        self.end = np.concatenate([*ends, node[inner] + 1]).astype(np.int64)
        nodes = len(code) + len(words)
        self.first = first[:-1] + np.arange(len(words))
        self.last = self.first + self.lengths
        self.word = np.repeat(np.arange(len(words)), self.lengths + 1)
        self.place = np.arange(nodes) - self.first[self.word]
        self.ahead = self._order(self.place[self.end], self.end)
        self.behind = None

    @staticmethod
    def _bytes(code: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """The byte pieces of characters, -1 where there are fewer than four."""
        n = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.full((len(code), 4), -1)
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        for k in range(4):
            shift = 6 * np.maximum(n - 1 - k, 0)
            raw = (code >> shift) & np.where(n == 1, 0x7F, 0x3F) | np.where(n == 1, 0, 0x80)
            if k == 0:
                raw = np.where(n == 1, code, (code >> shift) | head)
            out[:, k] = np.where(k < n, vocabulary.byte[raw & 0xFF], -1)
        return out

    @staticmethod
    def _order(step: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs by step and target, with the first of each step and of each target."""
        order = np.lexsort((target, step))
        step, target = step[order], target[order]
        if not len(order):
            return order, np.zeros(1, np.int64), np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]]))
        return order, cuts, np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))

    def _weights(self, log_p: np.ndarray) -> np.ndarray:
        return np.concatenate([log_p[self.name], np.append(log_p, 0.0)[self.bytes].sum(axis=1)])

    def _sweep(self, weight: np.ndarray, source: np.ndarray, target: np.ndarray, plan: tuple, begin: np.ndarray) -> np.ndarray:
        """Log sums over the paths from ``begin`` to every node."""
        order, cuts, firsts = plan
        total = np.full(len(self.place), -np.inf)
        total[begin] = 0.0
        source, target, weight = source[order], target[order], weight[order]
        at = np.searchsorted(firsts, cuts)
        for k in range(len(cuts) - 1):
            a, b = cuts[k], cuts[k + 1]
            value, first = total[source[a:b]] + weight[a:b], firsts[at[k] : at[k + 1]] - a
            top = np.maximum.reduceat(value, first)
            top[~np.isfinite(top)] = 0.0
            sums = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(first, b - a)))), first)
            with np.errstate(divide="ignore"):
                total[target[a + first]] = top + np.log(sums)
        return total

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        return self._sweep(self._weights(log_p), self.start, self.end, self.ahead, self.first)[self.last]

    def uses(self, log_p: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of every piece in the words, each word taken ``times``."""
        if self.behind is None:
            self.behind = self._order(-self.place[self.start], self.start)
        weight = self._weights(log_p)
        ahead = self._sweep(weight, self.start, self.end, self.ahead, self.first)
        behind = self._sweep(weight, self.end, self.start, self.behind, self.last)
        word = self.word[self.start]
        share = np.exp(ahead[self.start] + weight + behind[self.end] - ahead[self.last][word]) * times[word]
        out = np.bincount(self.name, weights=share[: len(self.name)], minlength=size)
        for column in self.bytes.T:
            held = column >= 0
            out += np.bincount(column[held], weights=share[len(self.name) :][held], minlength=size)
        return out


def word_counts(blocks: DataFrame) -> DataFrame:
    """(term, n): uses of each distinct word in the training documents, also of words that only others hold."""
    # The list of counts is looked up by place: zipped lists would make an object of every word of a block at once.
    told = blocks.select(F.posexplode("terms").alias("pos", "term"), "gathered").select("term", F.get("gathered", F.col("pos")).alias("n"))
    return told.groupBy("term").agg(F.sum("n").alias("n"))


def _expected(words: DataFrame, log_p: np.ndarray, name: str) -> np.ndarray:
    """Expected uses of the pieces in all training words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = vocabulary(name), None
        for terms, times in _steps(batches):
            found = Lattices(terms, known).uses(log_p, times, known.size)
            out = found if out is None else out + found
        if out is not None:
            held = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(out[held])], names=["piece", "uses"])

    sums = words.select("term", "n").mapInArrow(work, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
    out = np.zeros(vocabulary(name).size)
    for row in sums.toLocalIterator():
        out[row["piece"]] = row["uses"]
    return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words, counts) in lots of bounded size, whatever the batches are."""
    terms: list[str] = []
    times: list[int] = []
    letters = 0
    for batch in batches:
        for term, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms.append(term)
            times.append(n)
            letters += len(term)
            if len(terms) >= WORDS_PER_STEP or letters >= 20 * WORDS_PER_STEP:
                yield terms, np.array(times, dtype=float)
                terms, times, letters = [], [], 0
    if terms:
        yield terms, np.array(times, dtype=float)


def fit(words: DataFrame, n_docs: int, rounds: int = ROUNDS, name: str = PIECES_32K) -> np.ndarray:
    """Log probabilities of the pieces from training words (term, n) and the number of training documents."""
    known = vocabulary(name)
    prior, p = PRIOR * known.prior, known.prior
    for _ in range(rounds):
        uses = _expected(words.filter("n > 0"), np.log(p), name)
        uses[known.end] += n_docs
        p = (uses + prior) / (uses + prior).sum()
    return np.log(p)


def _scored_words(words: DataFrame, log_p: np.ndarray, name: str) -> DataFrame:
    """(term, n, log10_p) of every distinct word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(name)
        for terms, times in _steps(batches):
            value = Lattices(terms, known).forward(log_p) / _LOG10
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(times.astype(np.int64)), pa.array(value)], names=["term", "n", "log10_p"])

    return words.select("term", "n").mapInArrow(work, "term string, n long, log10_p double")


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, rounds: int = ROUNDS, name: str = PIECES_32K) -> DataFrame:
    """Rows of ``_SCORES``: whole texts of docs (doc_id, text), scored by what the training documents among them hold."""
    # A task has the more blocks the larger its part of the input is; they are written and read one by one.
    blocks = cut_lineage(whole_blocks(docs, WORD_BYTES, trains), rows_at_once=1)
    words = cut_lineage(word_counts(blocks))
    in_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    training = F.udf(lambda ids: sum(map(trains, ids)), "long")
    ends = int(blocks.agg(F.coalesce(F.sum(training("ids")), F.lit(0))).first()[0])
    train_tokens, distinct = int(in_words["n"]) + ends, int(in_words["v"]) + (ends > 0)
    log_p = fit(words, ends, rounds, name)
    whole = train_tokens + 0.5 * (distinct + 1)
    end_base, end_score = float(np.log10((ends + 0.5) / whole)), float(log_p[vocabulary(name).end] / _LOG10)

    def sums(block: pa.Table, values: pa.Table) -> pa.Table:
        part = {c: block[c].combine_chunks().flatten() for c in ("terms", "ends", "places", "counts", "ids", "lengths")}
        n, value = np.zeros(len(part["terms"]), np.int64), np.zeros(len(part["terms"]))
        at = values["pos"].to_numpy()
        n[at], value[at] = values["n"].to_numpy(), values["log10_p"].to_numpy()
        row = np.repeat(np.arange(len(n)), np.diff(part["ends"].to_numpy(), prepend=0))
        # Sums are taken in the order of the words, so that equal texts get equal sums in every block.
        order = np.argsort(np.argsort(np.asarray(part["terms"], dtype=object)))[row].argsort(kind="stable") if len(n) else row
        row, places, times = row[order], part["places"].to_numpy()[order], part["counts"].to_numpy().astype(np.int64)[order]
        size = len(part["ids"])
        by_doc = lambda w: np.bincount(places, weights=times * w[row], minlength=size)
        return pa.table(
            {
                "doc_id": part["ids"],
                "held_out": pa.array([held_out(d) for d in part["ids"].to_pylist()]),
                "n_tokens": part["lengths"].to_numpy() + 1,
                "n_known": by_doc((n > 0).astype(float)).astype(np.int64) + (ends > 0),
                "train_tokens": pa.array(np.full(size, train_tokens)),
                "base_score": by_doc(np.log10((n + 0.5) / whole)) + end_base,
                "score": by_doc(value) + end_score,
            }
        )

    valued = cut_lineage(_scored_words(words, log_p, name))
    # Only words and their places travel to their values and back; the lists stay with their block.
    places = blocks.select("block", F.posexplode("terms").alias("pos", "term"))
    values = places.join(valued, "term").select(F.col("block").alias("of_block"), "pos", "n", "log10_p")
    return blocks.drop("gathered").groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(sums, _SCORES)
