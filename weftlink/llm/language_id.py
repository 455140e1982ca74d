"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. A word's probability is
the sum over all its segmentations into pieces, found by a forward algorithm; a text's is the
product over its words (maximal runs of letters, lower-cased, each with the vocabulary's word mark in
front). Piece probabilities are learned by expectation-maximisation, whose expected counts come from the
forward and backward sums. Both run over many words at once, as arrays.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, carried, picked, text_of, unpacked

_LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
LONGEST = 16
#: Letters times languages of words that are worked on at once; known words times languages that a worker keeps; letters of a run of a longer word.
CELLS, KEPT_CELLS, RUN = 800_000, 8_000_000, 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(LONGEST + 1, _BASE, dtype=np.uint64)) * np.uint64(0xD1B54A32D192ED03)


def letter_words(text: str) -> list[str]:
    """Maximal runs of letters of the lower-cased text. The pattern also takes signs of numbers such as fractions; they part words."""
    found = _LETTERS.findall(text.lower())
    if "".join(found).isalpha() or not found:
        return found
    return ["".join(run) for word in found for alpha, run in groupby(word, str.isalpha) if alpha]


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` code points from each place on."""
    n = codes.shape[1] - length + 1
    out = np.zeros((codes.shape[0], n), dtype=np.uint64)
    for k in range(length):
        out += (codes[:, k : k + n].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length)


def public_pieces(path: str | None = None) -> list[str]:
    """Pieces of up to 16 letters, with or without the word mark, of the public vocabulary."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    lowered = {x.lower() for x in found}
    return sorted(x for x in lowered if len(x) <= LONGEST and (x == MARK or x.removeprefix(MARK).isalpha()))


class PieceModel:
    """``chance[i, l]``: probability of piece i in language l; the last row is for a letter that is no piece."""

    def __init__(self, pieces: list[str], languages: list[str], chance: np.ndarray | None = None, prior: np.ndarray | None = None):
        self.pieces, self.languages = pieces, languages
        keys = np.zeros(len(pieces), dtype=np.uint64)
        for n in {len(x) for x in pieces}:
            at = [k for k, x in enumerate(pieces) if len(x) == n]
            keys[at] = _hashes(_codes([pieces[k] for k in at]), n)[:, 0]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.chance = chance if chance is not None else np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
        self.prior = prior if prior is not None else np.zeros(len(languages))

    def _find(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Piece of this length at each place; -1: none."""
        h = _hashes(codes, length)
        at = np.minimum(np.searchsorted(self.keys, h.ravel()), len(self.keys) - 1).reshape(h.shape)
        found = np.where(self.keys[at] == h, self.order[at], -1)
        return np.where(found < 0, len(self.pieces), found) if length == 1 else found

    def _sums(self, codes: np.ndarray, found: list[np.ndarray], backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of the first j letters of every word, or the last j, in each language, and the logarithm that each was
        divided by. Every 16 letters what later places still read is divided by its newest sum, so words may be of any length."""
        m, n = codes.shape
        table = np.vstack([self.chance, np.zeros(self.chance.shape[1])])  # row -1: no piece
        sums, scale = np.zeros((m, n + 1, table.shape[1])), np.zeros((m, n + 1, table.shape[1]))
        sums[:, 0] = 1.0
        for j in range(1, n + 1):
            total = sums[:, j]
            scale[:, j] = scale[:, j - 1]
            for length in range(1, min(LONGEST, j) + 1):
                total += sums[:, j - length] * table[found[length - 1][:, n - j if backward else j - length]]
            if j % 16 == 0:
                low = max(0, j - LONGEST + 1)
                top = np.maximum(total, 1e-300)
                sums[:, low : j + 1] /= top[:, None]
                scale[:, low : j + 1] += np.log(top)[:, None]
        return sums, scale

    def _by_length(self, words: list[str], cells: int) -> Iterator[tuple[list[int], np.ndarray, list[np.ndarray]]]:
        """Words of one length together, of about ``cells`` letters: their numbers, codes, and pieces of each length at each place."""
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, every in by_length.items():
            step = max(1, cells // (n + 1))
            for at in range(0, len(every), step):
                some = every[at : at + step]
                codes = _codes([MARK + words[k] for k in some])
                yield some, codes, [self._find(codes, length) for length in range(1, min(LONGEST, codes.shape[1]) + 1)]

    def log_chances(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability in each language."""
        out = np.zeros((len(words), len(self.languages)))
        long = [k for k, w in enumerate(words) if len(w) > RUN]
        short = [k for k, w in enumerate(words) if len(w) <= RUN] if long else range(len(words))
        for some, codes, found in self._by_length([words[k] for k in short], CELLS // max(1, len(self.languages))):
            sums, scale = self._sums(codes, found)
            out[[short[k] for k in some]] = np.log(np.maximum(sums[:, -1], 1e-300)) + scale[:, -1]
        for k in long:
            out[k] = self._long_chance(MARK + words[k])
        return out

    def _long_chance(self, word: str) -> np.ndarray:
        """The same of one long word, in runs of letters: only the sums of the last ``LONGEST`` places are kept."""
        table = np.vstack([self.chance, np.zeros(self.chance.shape[1])])
        last, log = [np.ones(table.shape[1])], np.zeros(table.shape[1])  # sums up to the letters before, the newest last
        for at in range(0, len(word), RUN):
            low = max(0, at - LONGEST)
            codes = _codes([word[low : at + RUN]])
            found = [self._find(codes, length)[0] for length in range(1, min(LONGEST, codes.shape[1]) + 1)]
            for j in range(at + 1, min(at + RUN, len(word)) + 1):
                last.append(sum(last[-length] * table[found[length - 1][j - length - low]] for length in range(1, min(LONGEST, j) + 1)))
                del last[:-LONGEST]
                if j % 16 == 0:
                    top = np.maximum(last[-1], 1e-300)
                    last, log = [x / top for x in last], log + np.log(top)
        return np.log(np.maximum(last[-1], 1e-300)) + log

    def expected_counts(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; ``counts[w, l]``: how often word w is in language l."""
        out = np.zeros_like(self.chance)
        for some, codes, found in self._by_length(words, CELLS // 2 // max(1, len(self.languages))):
            size = codes.shape[1]
            forward, before = self._sums(codes, found)
            backward, after = self._sums(codes, found, backward=True)
            backward, after = backward[:, ::-1], after[:, ::-1]
            share, whole = counts[some] / np.maximum(forward[:, size], 1e-300), before[:, size]
            for i in range(size):
                for length in range(1, min(LONGEST, size - i) + 1):
                    piece = found[length - 1][:, i]
                    there = piece >= 0
                    if there.any():
                        used = (share * forward[:, i] * backward[:, i + length] * np.exp(before[:, i] + after[:, i + length] - whole))[there] * self.chance[piece[there]]
                        order = np.argsort(piece[there], kind="stable")
                        pieces = piece[there][order]
                        heads = np.flatnonzero(np.diff(pieces, prepend=-1))
                        out[pieces[heads]] += np.add.reduceat(used[order], heads, axis=0)
        return out

    def updated(self, expected: np.ndarray) -> PieceModel:
        pooled = expected.sum(axis=1, keepdims=True) + 0.05
        raw = expected + 20.0 * pooled / pooled.sum() + 1e-3
        return PieceModel(self.pieces, self.languages, raw / raw.sum(axis=0), self.prior)


def id_fold(column: Column, folds: int) -> Column:
    """Remainder of the CRC-32 of the id as text; a null id counts as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array(held.values(), pa.int64())], ["k", "word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.update((lang, w[at : at + RUN]) for w in letter_words(text) for at in range(0, len(w), RUN))
            if len(held) > 200_000:
                yield out()
    yield out()


def train_language_model(labelled: DataFrame, sample: int = 1000, rounds: int = 3, pieces_path: str | None = None) -> PieceModel:
    """Learns from ``labelled`` (doc_id, lang, body): about ``sample`` documents of each language, chosen by a hash of their ids. That bound
    and ``rounds`` of expectation-maximisation are the parameters of the fit.

    Every label is a language, but ``und``, which says that there is none: its rows are not learned from. The driver holds the counts of
    the vocabulary's pieces in each language. Texts are read whole; words of more than ``RUN`` letters are learned from in runs of that length; repeated
    rows count as often as they come; null ids are one id; without rows the model knows no language.
    """
    labelled = labelled.where("lang <> 'und'")
    many = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}  # a row a label
    names = sorted(many)
    pieces = public_pieces(pieces_path)
    model = PieceModel(pieces, names)
    if not names:
        return model
    model.prior = np.log(np.array([many[x] for x in names]) / sum(many.values()))
    spark, work, total_width = labelled.sparkSession, Workspace(labelled.sparkSession, "language-id"), len(names)
    share = spark.createDataFrame([(x, k, min(1.0, sample / many[x])) for k, x in enumerate(names)], "lang string, k int, share double")
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < F.col("share") * 1_000_000
    taken = labelled.join(F.broadcast(share), "lang").where(chosen).select("k", "body")
    words = taken.mapInArrow(_word_counts, "k int, word string, n long").groupBy("word", "k").agg(F.sum("n").alias("n"))
    words = work.put(words.groupBy("word").agg(F.collect_list("k").alias("k"), F.collect_list("n").alias("n")), "words")
    for _ in range(rounds):
        current = model

        def expect(batches: Iterator[pa.RecordBatch], model: PieceModel = current) -> Iterator[pa.RecordBatch]:
            total, step = np.zeros_like(model.chance), max(1, KEPT_CELLS // total_width)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    langs, used = some.column("k"), some.column("n")
                    counts = np.zeros((some.num_rows, total_width))
                    counts[np.repeat(np.arange(some.num_rows), langs.value_lengths().to_numpy()), langs.flatten().to_numpy()] = used.flatten().to_numpy()
                    total += model.expected_counts(some.column("word").to_pylist(), counts)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "used"])

        expected = np.zeros_like(model.chance)
        parts = words.mapInArrow(expect, "piece long, lang long, used double").groupBy("piece", "lang").agg(F.sum("used").alias("used"))
        found = parts.toPandas()  # one number for each piece of the fixed vocabulary and language
        expected[found["piece"], found["lang"]] = found["used"]
        model = model.updated(expected)
    work.clear()
    return model


class _Words:
    """Chances of the words that a worker has met, in a table of bounded size."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}
        self.room = max(1024, KEPT_CELLS // max(1, len(model.languages)))
        self.table = np.empty((self.room, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.room:
            self.known, new = {}, words
        if new:
            at = len(self.known)
            self.table[at : at + len(new)] = self.model.log_chances(list(new))
            self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def total(self, words: list[str], learned: bool) -> np.ndarray:
        out = self.model.prior.copy()
        for at in range(0, len(words), self.room if not learned else len(words)):
            some = words[at : at + self.room] if not learned else words
            if not learned:
                self.learn(set(some))
            rows = np.fromiter(map(self.known.__getitem__, some), np.int64, len(some))
            for k in range(0, len(rows), 1 << 16):
                out += self.table[rows[k : k + (1 << 16)]].sum(axis=0)
        return out


def _groups(texts: list[str], most: int = 256, letters: int = 1 << 20) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if len(held) == most or size > letters:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scorer(model: PieceModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(model)
        for batch in batches:
            picked, scores = [], []
            for texts in _groups(batch.column(1).to_pylist()):
                split = [letter_words(x) for x in texts]
                every = set().union(*split)
                if learned := len(every) <= words.room:
                    words.learn(every)
                for found in split:
                    if not found or not model.languages:
                        picked.append("und")
                        scores.append(0.0)
                        continue
                    total = words.total(found, learned)
                    best = int(total.argmax())
                    picked.append(model.languages[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(picked, pa.string()), pa.array(scores, pa.float64())], [batch.schema.names[0], *batch.schema.names[2:], "lang_pred", "score"])

    return score


def identify_language(docs: DataFrame, model: PieceModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``; only the text decides.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. The score is the
    posterior probability of the language. Texts of any length are read whole; ties go to the first language.
    """
    plain = docs.select(docs[id_column].alias("doc_id"), text_of(docs, text_column).alias("body"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_scorer(model), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: PieceModel, text_column: str = "text") -> DataFrame:
    """Rows of ``docs``, with all columns, whose text is in some language; those that are ``und`` go: null texts, texts without a
    letter, and all where nothing was learned. Repeated rows stay as often as they come, ids and other columns may hold anything, and
    columns may have any names. An empty table gives no rows."""
    rows = carried(docs, body=text_column)
    plain = rows.select("row", text_of(rows, "body").alias("body"))
    schema = plain.select("row").schema.add("lang_pred", "string").add("score", "double")
    found = plain.mapInArrow(_scorer(model), schema).where("lang_pred <> 'und'")
    return found.select(*unpacked(docs.columns))


def train_on_folds(docs: DataFrame, folds: int = 5, held_out: int = 0, **options) -> PieceModel:
    """Learns from labelled rows of ``docs`` (doc_id, text, lang) outside the held-out fold of ids; null texts and labels are left out."""
    own = picked(docs, doc_id="doc_id", lang="lang", body="text")
    return train_language_model(own.where(F.col("lang").isNotNull() & F.col("body").isNotNull() & (id_fold(F.col("doc_id"), folds) != held_out)), **options)
