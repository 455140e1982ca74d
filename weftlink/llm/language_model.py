"""A trigram language model by deleted interpolation.

Maximum-likelihood estimates of a word after its two predecessors, after the last one, of the word alone, and a uniform one are
mixed; the weights depend on a bucket of the context's frequency: that of the two predecessors, or of the last one where the
two never came. They are learned by expectation-maximisation on held-out counts: one fold of ``FOLDS`` of the training documents is
judged by the counts of the others, its own deleted. A hash of the text decides the fold, so equal texts are held out together and the
model doesn't depend on how the input is dealt. Estimates come from the counts of every training document.

Plan: parts of chunks send their distinct words, pairs and triples, as hashes with counts, to owners of hash ranges, those of the held-out
fold apart; owners answer with totals over the corpus, and for the fold with its own. A part names a triple once or
twice however often it has it, so frequent words and triples are no hot keys. Chunks are then read again with their answers, held-out
documents for the cells and all for the scores.
Driver and model hold a few numbers for each of about a hundred buckets. Words are 64-bit hashes; those of pairs and triples have
``SPARE_BITS`` bits more than the number of tokens has, so one in 16 million shares its count with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_owner, owner_bits, pack_keys, pack_numbers, parts_of, unpack_keys, unpack_numbers, write_chunks
from .common import Workspace, text_of
from .grams import mix, text_buffers, words_of

END, BEGIN = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
BUCKETS, ORDERS, SPARE_BITS, FOLDS = 48, 3, 24, 8


def _tokens(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts one after another, the token before each (or BEGIN), and where texts begin."""
    words, starts = words_of(*text_buffers(bodies))
    tokens = np.insert(words, starts[1:], END)
    at = starts + np.arange(len(starts))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = BEGIN
    return tokens, before, at


def _keys(tokens: np.ndarray, before: np.ndarray, starts: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Keys by order: words (with one BEGIN a text, the context count of first words), pairs and triples; high bits decide the owner."""
    begun = np.full(len(starts) - 1, BEGIN)
    short = ~np.uint64((1 << (64 - width)) - 1)
    pairs = mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens)
    last = np.empty_like(pairs)  # the pair that ends with the predecessor
    last[1:] = pairs[:-1]
    last[starts[:-1]] = BEGIN
    return {1: np.concatenate([tokens, begun]), 2: pairs & short, 3: mix(last * np.uint64(0xA24BAED4963EE407) + tokens) & short}


def _packed(order: int, keys: np.ndarray, width: int) -> bytes:
    return pack_keys(keys if order == 1 else keys >> np.uint64(64 - width))


def _send(bits: int, width: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, low, high, rows in parts_of(batch):
                tokens, before, starts = _tokens(rows.column("body"))
                trained, held = (np.asarray(rows.column(c).to_numpy(zero_copy_only=False), dtype=bool) for c in ("trained", "held"))
                weight, apart = np.repeat(trained, np.diff(starts)), np.repeat(held, np.diff(starts))
                out: list[tuple] = []
                for order, keys in _keys(tokens, before, starts, width).items():
                    weights, folds = (np.append(weight, trained), np.append(apart, held)) if order == 1 else (weight, apart)
                    for fold in (False, True):
                        distinct, inverse = np.unique(keys[folds == fold], return_inverse=True)
                        counts = np.bincount(inverse, weights[folds == fold], len(distinct)).astype(np.int64)
                        owners, cuts = by_owner(distinct, bits)
                        out += [(order * (1 << bits) + int(o), chunk, low, high, fold, _packed(order, distinct[a:b], width), pack_numbers(counts[a:b])) for o, a, b in zip(owners, cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(),) * 4 + (pa.bool_(),) + (pa.binary(),) * 2, strict=True)], ["owner", "chunk", "low", "high", "held", "keys", "counts"])

    return send


def _answer(bits: int):
    def answer(table: pa.Table) -> pa.Table:
        owner = table.column("owner")[0].as_py()
        lists = [unpack_keys(x.as_py()) for x in table.column("keys")]
        counts = np.concatenate([unpack_numbers(x.as_py()) for x in table.column("counts")])
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        held = table.column("held").to_pylist()
        apart = np.repeat(held, [len(x) for x in lists])
        total, own = (np.bincount(inverse[some], counts[some], len(distinct)).astype(np.int64) for some in (slice(None), apart))
        parts = np.split(inverse, np.cumsum([len(x) for x in lists])[:-1])
        answers = [pack_numbers(total[x]) for x in parts]
        others = [pack_numbers(total[x] - own[x]) if h else None for x, h in zip(parts, held, strict=True)]
        words = np.zeros(len(lists), dtype=np.int64)
        known, kept = words.copy(), words.copy()
        if owner >> bits == 1:  # once for each owner: tokens, distinct ones, and tokens of other folds, without BEGIN
            real = distinct != BEGIN
            words[0], known[0], kept[0] = total[real].sum(), (total[real] > 0).sum(), (total - own)[real].sum()
        same = {c: table.column(c) for c in ("owner", "chunk", "low", "high", "held")}
        return pa.table(same | {"totals": pa.array(answers, pa.binary()), "others": pa.array(others, pa.binary()), "words": words, "known": known, "kept": kept})

    return answer


def _parts_with_totals(rows: pa.Table, answers: pa.Table, bits: int, width: int, others: bool = False) -> Iterator[tuple]:
    """For each part: its rows, token starts, and by token the totals of word, last one, pair, pair before, triple.

    With ``others``: held-out rows alone, and totals of the documents that are not.
    """
    if others:
        rows, answers = rows.filter(rows.column("held")), answers.filter(answers.column("held"))
    rows = rows.sort_by("uid")
    uid = rows.column("uid").to_numpy()
    answers = answers.select(["owner", "low", "high", "held", "others" if others else "totals"]).sort_by([("low", "ascending"), ("owner", "ascending")])
    lows, highs = answers.column("low").to_numpy(), answers.column("high").to_numpy()
    for low in np.unique(lows):
        mine = np.flatnonzero(lows == low)
        a, b = np.searchsorted(uid, [low, highs[mine[0]] + 1])
        part = rows.slice(a, b - a)
        tokens, before, starts = _tokens(part.column("body"))
        held = np.asarray(part.column("held").to_numpy(), dtype=bool)
        apart = np.repeat(held, np.diff(starts))
        order, fold = answers.column("owner").to_numpy()[mine] >> bits, answers.column("held").to_numpy()[mine]
        found = {}
        for k, keys in _keys(tokens, before, starts, width).items():
            folds = np.append(apart, held) if k == 1 else apart
            total = np.zeros(len(keys), dtype=np.int64)
            for f in (False, True):
                if (some := folds == f).any():
                    inverse = np.unique(keys[some], return_inverse=True)[1]
                    total[some] = np.concatenate([unpack_numbers(answers.column(4)[int(i)].as_py()) for i in mine[(order == k) & (fold == f)]])[inverse]
            if k == 1:
                begun = total[len(tokens) :]
            found[k] = total[: len(tokens)]
            del keys, total
        last, two = np.empty_like(found[1]), np.empty_like(found[2])
        last[1:], two[1:] = found[1][:-1], found[2][:-1]
        last[starts[:-1]] = two[starts[:-1]] = begun
        yield part, starts, (found[1], last, found[2], two, found[3])


def bucket_of(two: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bucket of a context: a step for each doubling of the frequency of both predecessors, or, below those steps, of the last one; 0 for none."""
    step = lambda x: np.minimum(np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, BUCKETS - 1)
    return np.where(two > 0, BUCKETS + step(two), np.where(last > 0, step(last), 0))


def _level(share: np.ndarray) -> np.ndarray:
    """Step of a quarter of a decade; -1 for nothing."""
    return np.where(share > 0, np.floor(-4 * np.log10(np.maximum(share, 1e-12))), -1).astype(np.int64)


def shares_of(counts: tuple[np.ndarray, ...], tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of order 3, 2 and 1; 0 where the context never came."""
    word, last, pair, two, triple = counts
    return triple / np.maximum(two, 1), pair / np.maximum(last, 1), word / max(tokens, 1)


def cells_of(counts: tuple[np.ndarray, ...], tokens: int) -> pd.DataFrame:
    """Cells of tokens with these counts: bucket, steps of the three estimates, number, and sums of the estimates."""
    shares = shares_of(counts, tokens)
    code = bucket_of(counts[3], counts[1])
    for x in shares:
        code = code * 64 + _level(x) + 1
    cells, inverse = np.unique(code, return_inverse=True)
    steps = {name: (cells >> (6 * k) & 63) - 1 for k, name in ((2, "a"), (1, "b"), (0, "c"))}
    sums = {name: np.bincount(inverse, x, len(cells)).astype(np.float64) for name, x in zip(("triple", "pair", "word"), shares, strict=True)}
    return pd.DataFrame({"bucket": cells >> 18, **steps, "n": np.bincount(inverse, minlength=len(cells)), **sums})


def learn_weights(cells: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights (triple, pair, word, uniform) of each bucket, by expectation-maximisation over cells of held-out counts.

    A cell is a number ``n`` of held-out tokens of one bucket with nearly equal estimates, and the sums of their estimates.
    Buckets without held-out tokens take the weights of all together; estimates that a bucket cannot have get no weight.
    """
    def fit(some: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        weights, n = start.copy(), some["n"].to_numpy(dtype=np.float64)
        shares = np.column_stack([some["triple"] / n, some["pair"] / n, some["word"] / n, np.full(len(some), uniform)])
        for _ in range(rounds):
            joint = shares * weights
            total = np.maximum(joint.sum(axis=1), 1e-300)
            weights = (joint * (n / total)[:, None]).sum(axis=0) / n.sum()
        weights = np.maximum(weights, 1e-6)
        return weights / weights.sum()

    start = np.array([0.3, 0.3, 0.3, 0.1])
    overall = fit(cells, start) if len(cells) else start
    out = np.tile(overall, (2 * BUCKETS, 1))
    for bucket, some in cells.groupby("bucket"):
        out[int(bucket)] = fit(some, overall)
    out[:BUCKETS, 0] = 0.0
    out[0, 1] = 0.0
    return out / out.sum(axis=1, keepdims=True)


def score_documents(docs: DataFrame, trained, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``trained``: a boolean column, true where the row is learned from (null: false). ``base_score`` is that of add-one unigrams.
    Without a held-out document, as in tiny tables, the weights are those that learning starts from. Tokens are the words of the lower-cased (A-Z) text and one end. A null text is just an end; null ids are scored; repeated rows
    count as often as they come; an empty table gives no rows; other columns are not read. What SQL could express of this, the
    counts and ``base_score``, tests compare with plain Python; scores too, with the model's weights.
    """
    return language_model(docs, trained, id_column, text_column)[0]


def language_model(docs: DataFrame, trained, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, np.ndarray]:
    """The rows of ``score_documents``, and the weights of the mixture by bucket."""
    with Workspace(docs.sparkSession, "language-model") as work:
        plain = docs.select(docs[id_column].alias("doc_id"), F.coalesce(trained, F.lit(False)).alias("trained"), text_of(docs, text_column).alias("body"))
        plain = plain.withColumn("held", F.col("trained") & (F.pmod(F.xxhash64("body"), F.lit(FOLDS)) == 0))
        corpus, size = write_chunks(plain, F.col("body"), work)
        bits, width = owner_bits(size / 6), min(64, int(size / 6).bit_length() + SPARE_BITS)
        kind = corpus.schema["doc_id"].dataType.simpleString()
        sent = corpus.select("chunk", "uid", "trained", "held", "body").mapInArrow(_send(bits, width), "owner long, chunk long, low long, high long, held boolean, keys binary, counts binary")
        answered = "owner long, chunk long, low long, high long, held boolean, totals binary, others binary, words long, known long, kept long"
        answers = work.put(sent.groupBy("owner").applyInArrow(_answer(bits), answered), "answers", "zstd")
        train_tokens, vocabulary, kept_tokens = (x or 0 for x in answers.agg(F.sum("words"), F.sum("known"), F.sum("kept")).first())
        uniform = 1.0 / (vocabulary + 1)

        def held_out(rows: pa.Table, found: pa.Table) -> pa.Table:
            every = [cells_of(counts, kept_tokens) for _, _, counts in _parts_with_totals(rows, found, bits, width, others=True)]
            return pa.Table.from_pandas(pd.concat(every), preserve_index=False)

        schema = "bucket long, a long, b long, c long, n long, triple double, pair double, word double"
        told = answers.where("held").select("owner", "chunk", "low", "high", "held", "others").groupBy("chunk")
        cells = corpus.where("held").drop("doc_id").groupBy("chunk").cogroup(told).applyInArrow(held_out, schema)
        cells = cells.groupBy("bucket", "a", "b", "c").agg(*[F.sum(x).alias(x) for x in ("n", "triple", "pair", "word")])
        weights = learn_weights(cells.toPandas(), uniform)  # cells, not tokens: bounded by the steps of three estimates

        def score(rows: pa.Table, found: pa.Table) -> pa.Table:
            outs = []
            for part, starts, counts in _parts_with_totals(rows, found, bits, width):
                mixed = weights[bucket_of(counts[3], counts[1])]
                chance = sum((mixed[:, k] * x for k, x in enumerate(shares_of(counts, train_tokens))), mixed[:, 3] * uniform)
                base = np.log10((counts[0] + 1) / (train_tokens + vocabulary + 1))
                sums = [np.add.reduceat(x, starts[:-1]) for x in ((counts[0] > 0).astype(np.int64), base, np.log10(chance))]
                outs.append(pa.table({"doc_id": part.column("doc_id"), "n_tokens": np.diff(starts), "n_known": sums[0], "train_tokens": np.full(len(part), train_tokens, np.int64), "base_score": sums[1], "score": sums[2]}))
            return pa.concat_tables(outs)

        found = answers.select("owner", "chunk", "low", "high", "held", "totals").groupBy("chunk")
        scored = corpus.groupBy("chunk").cogroup(found).applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        out = work.put(scored, "scores")
        work.clear("scores")
        return out, weights
