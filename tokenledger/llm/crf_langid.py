"""Language ID by a linear-chain conditional random field over words.

Every word's label is a language. A word's features are its prefixes and suffixes, its character n-grams, the
word itself and the languages whose lexicons (frequent words of the sample) hold it, all hashed to one weight
table; label transitions are learned with them. Training sequences are runs of words taken from documents of
different languages in turn, so that the chain sees switches. A text's words are labelled by
forward-backward over the whole text: runs of words of one label show where the text switches, and its language
is the label with the largest mean posterior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, offsets_of, ship, text_slices, texts_of, words_of

#: Bounds of the sample that the model is fitted on: documents of each language, code points of a document, and
#: languages (the most frequent ones; a language beyond them is not learned, and its texts get another label).
#: Counts, prediction and everything else cover all rows and whole texts.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_LANGS = 150, 4000, 64
BITS, GRAMS, LEXICON, EPOCHS, RUN, DECAY = 17, (2, 3, 4), 300, 12, 24, 1e-2
#: Bytes of text labelled at once (or one text), and bytes of emission scores that a worker remembers.
SLICE, CACHE = 1 << 20, 24 << 20
_LETTERS = regex.compile(r"\PL+")


def letters(token: str) -> str:
    """A token's letters in lower case."""
    return token.lower() if token.isalpha() else _LETTERS.sub("", token).lower()


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hashed feature) pairs of words of letters, one kind at a time: word, lexicons, affixes, n-grams. Empty words have none."""
    sizes = np.array([len(w) for w in words], np.int32)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    if not len(some):
        return
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    within = np.arange(len(points), dtype=np.int32) - starts[owner].astype(np.int32)
    power = np.cumprod(np.full(int(sizes.max()), 0x01000193, np.uint32), dtype=np.uint32)
    yield some, _mixed(np.add.reduceat(points * power[within], starts[some], dtype=np.uint32), 1)
    listed = [(i, lang) for i, w in enumerate(words) for lang in lexicon.get(w, ())]
    if listed:
        at, lang = np.array(listed, np.int64).T
        yield at, _mixed(lang.astype(np.uint32), 2)
    rolling = points * np.uint32(0x2C1B3C6D)
    for n in range(1, max(3, *GRAMS) + 1):
        if n > 1:
            rolling = rolling[: max(0, len(points) - n + 1)] * np.uint32(0x297A2D39) + points[n - 1 :]
        if n <= 3:
            at = np.flatnonzero(sizes >= n)
            yield at, _mixed(rolling[starts[at]], 2 + n)
            yield at, _mixed(rolling[starts[at] + sizes[at] - n], 5 + n)
        if n in GRAMS:
            at = np.flatnonzero((sizes[owner] - within >= n)[: len(rolling)])
            yield owner[at], _mixed(rolling[at], 8 + n)


class Model:
    """Weights, transitions, first-label scores, labels and lexicon; emissions of distinct words are remembered."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, first: np.ndarray, lexicon: dict) -> None:
        self.labels, self.weights, self.moves, self.first, self.lexicon = labels, weights, moves, first, lexicon
        self.columns = [np.ascontiguousarray(weights[:, j]) for j in range(len(labels))]
        self.clear()

    def __reduce__(self):
        return Model, (self.labels, self.weights, self.moves, self.first, self.lexicon)

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table, self.held = np.empty((1024, len(self.labels)), np.float32), 0

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores: a word's weights summed over its features, over the root of their number."""
        score, counts = np.zeros((len(words), len(self.labels))), np.zeros(len(words), np.int64)
        for owner, index in features(words, self.lexicon):
            counts += np.bincount(owner, minlength=len(words))
            for j, column in enumerate(self.columns):
                score[:, j] += np.bincount(owner, column[index], len(words))
        return (score / np.sqrt(np.maximum(counts, 1))[:, None]).astype(np.float32)

    def emissions(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(emission scores, whether the token has a letter) of distinct tokens."""
        if self.held > CACHE:
            self.clear()
        words = [letters(x) for x in names]
        new = list({x for x in words if x not in self.rows})
        at = 0
        while at < len(new):  # a bounded number of letters at a time, or one word
            to, size = at, 0
            while to < len(new) and (to == at or size + len(new[to]) <= 100_000):
                size += len(new[to])
                to += 1
            some, begin = new[at:to], len(self.rows)
            if begin + len(some) > len(self.table):
                grown = np.empty((max(2 * len(self.table), begin + len(some)), len(self.labels)), np.float32)
                grown[:begin] = self.table[:begin]
                self.table = grown
            self.table[begin : begin + len(some)] = self.scores(some)
            self.rows.update(zip(some, range(begin, begin + len(some)), strict=True))
            self.held += size + len(some) * (4 * len(self.labels) + 160)
            at = to
        if not names:
            return np.empty((0, len(self.labels)), np.float32), np.empty(0, bool)
        known = np.array([bool(x) for x in words])
        return np.where(known[:, None], self.table[[self.rows[x] for x in words]], 0), known


def posteriors(emit: np.ndarray, starts: np.ndarray, moves: np.ndarray, first: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward marginals of a row of words that holds several sequences (starts marks first words).

    `pairs`, if given, is a matrix to which the marginals of neighbouring words' labels are added. The row is cut
    into lanes that advance together. Products of each lane's step matrices carry the exact forward and backward
    vectors across lanes, so a long text costs no more steps than many short ones.
    """
    n, k = emit.shape
    if not n:
        return np.empty((0, k))
    lanes = max(1, min(2048, int(np.sqrt(n) * 2)))
    steps = -(-n // lanes)
    pad = lanes * steps - n
    e = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float64)
    # step by step in memory: [step, lane, label]
    e = np.ascontiguousarray(np.concatenate([e, np.ones((pad, k))]).reshape(lanes, steps, k).swapaxes(0, 1))
    s = np.concatenate([starts, np.ones(pad, bool)]).reshape(lanes, steps)
    s[0, 0] = True
    s = np.ascontiguousarray(s.T)
    some = s.any(1).tolist()
    move, begin = np.exp(moves - moves.max()), np.exp(first - first.max())
    product = np.tile(np.eye(k), (lanes, 1, 1))
    for t in range(steps):
        product = (product.reshape(-1, k) @ move).reshape(lanes, k, k)
        if some[t]:
            product[s[t]] = begin
        product *= e[t][:, None, :]
        if t % 8 == 7:
            product /= product.max((1, 2), keepdims=True)
    forward, backward = np.empty((lanes, k)), np.empty((lanes, k))
    vector = np.ones(k)
    for i in range(lanes):
        forward[i] = vector
        vector = vector @ product[i]
        vector /= vector.sum()
    # a lane's product with all-equal rows (a restart inside) passes no information back; its rows' scales do not matter
    vector, cut = np.ones(k), s.any(0).tolist()
    for i in range(lanes - 1, -1, -1):
        backward[i] = vector
        vector = product[i] @ vector if not cut[i] else _back(e[:, i], s[:, i], move)
        vector /= vector.sum()
    ones = np.ones((k, 1))
    alpha = np.empty((steps, lanes, k))
    a = forward
    for t in range(steps):
        a = a @ move
        if some[t]:
            a[s[t]] = begin
        a *= e[t]
        a /= a @ ones
        alpha[t] = a
    b = backward
    for t in range(steps - 1, -1, -1):
        alpha[t] *= b
        b = b * e[t]
        if pairs is not None:
            before, inner = alpha[t - 1] if t else forward, ~s[t]
            mass = ((before @ move) * b).sum(1, keepdims=True)
            pairs += move * (before[inner].T @ (b / mass)[inner])
        b = b @ move.T
        if some[t]:
            b[s[t]] = 1.0
        b /= b @ ones
    alpha /= alpha @ ones
    return alpha.swapaxes(0, 1).reshape(-1, k)[:n]


def _back(e: np.ndarray, s: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Backward vector at the front of a lane in which a sequence starts: only the words before it count."""
    b = np.ones(e.shape[1])
    for t in range(int(np.argmax(s)) - 1, -1, -1):
        b = move @ (e[t] * b)
        b /= b.sum()
    return b


class Chain:
    """The training sequences, and the gradient of their log-likelihood."""

    def __init__(self, runs: list[tuple[int, list[str]]], labels: int, lexicon: dict) -> None:
        names = sorted({w for _, run in runs for w in run})
        where = {w: i for i, w in enumerate(names)}
        found = list(features(names, lexicon))
        self.owner, self.index = (np.concatenate([np.asarray(x[i], np.int64) for x in found]) for i in (0, 1))
        self.n, self.k = len(names), labels
        self.scale = 1 / np.sqrt(np.bincount(self.owner, minlength=self.n))
        self.code = np.array([where[w] for _, run in runs for w in run])
        truth = np.repeat([lang for lang, _ in runs], [len(run) for _, run in runs])
        ends = np.cumsum([len(run) for _, run in runs])
        self.starts = np.zeros(len(self.code), bool)
        self.starts[[0, *ends[3:-1:4]]] = True  # a sequence is four runs
        self.gold = np.eye(labels)[truth]
        inner = np.flatnonzero(~self.starts)
        self.inner, self.moves = len(inner), np.zeros((labels, labels))
        np.add.at(self.moves, (truth[inner - 1], truth[inner]), 1)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Scores of all places in the sequences, as Model.scores has them."""
        table = np.stack([np.bincount(self.owner, weights[self.index, j], self.n) for j in range(self.k)], 1)
        return (table * self.scale[:, None])[self.code]

    def gradient(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log-likelihood by weights, moves and first: what the truth has less what the chain expects."""
        pairs = np.zeros((self.k, self.k))
        error = self.gold - posteriors(self.emissions(weights), self.starts, moves, first, pairs)
        by_word = np.stack([np.bincount(self.code, error[:, j], self.n) for j in range(self.k)], 1) * self.scale[:, None]
        by_weight = np.stack([np.bincount(self.index, by_word[self.owner, j], len(weights)) for j in range(self.k)], 1)
        return by_weight, self.moves - pairs, error[self.starts].sum(0)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (text, language) rows by gradient ascent of the chain's log-likelihood with decay (Adagrad, fixed epochs)."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in rows})
    k = len(labels)
    runs: list[tuple[int, list[str]]] = []
    counts = [Counter() for _ in labels]
    for text, lang in rows:
        words = [w for w in map(letters, text.split()) if w]
        counts[labels.index(lang)].update(words)
        runs += [(labels.index(lang), words[i : i + RUN]) for i in range(0, len(words), RUN)]
    lexicon: dict[str, tuple[int, ...]] = {}
    for i, count in enumerate(counts):
        for word, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[word] = (*lexicon.get(word, ()), i)
    weights, moves, first = np.zeros((1 << BITS, k)), np.eye(k), np.zeros(k)
    if not runs:
        return Model(labels, weights.astype(np.float32), moves, first, lexicon)
    chain = Chain([runs[i] for i in rng.permutation(len(runs))], k, lexicon)
    seen, moves_seen, first_seen = np.full_like(weights, 1e-3), np.ones((k, k)), np.ones(k)
    for _ in range(EPOCHS):
        step, by_move, by_first = chain.gradient(weights, moves, first)
        step -= DECAY * weights
        seen += step**2
        weights += 0.7 * step / np.sqrt(seen)
        by_move *= 50 / max(1, chain.inner)
        moves_seen += by_move**2
        moves += by_move / np.sqrt(moves_seen)
        by_first /= chain.starts.sum()
        first_seen += by_first**2
        first += by_first / np.sqrt(first_seen)
    return Model(labels, weights.astype(np.float32), moves, first, lexicon)


def sample(labelled: DataFrame, text: str, lang: str, key: str) -> list[tuple[str, str]]:
    """At most SAMPLE_DOCS documents of each of the SAMPLE_LANGS most frequent languages; of a longer text, SAMPLE_CHARS code points from its first letter on.

    Two passes over the rows, whatever the number of languages: one counts, one draws by a hash of key and text.
    """
    rows = labelled.select(labelled[lang].cast("string").alias("lang"), labelled[text].cast("string").alias("t"), labelled[key].cast("string").alias("k"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_LANGS).collect()
    if not counts:
        return []
    shares = labelled.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 2.0 * SAMPLE_DOCS / r["count"]) * (1 << 40))) for r in counts], "lang string, share long")
    head = F.when(F.char_length("t") <= SAMPLE_CHARS, F.col("t")).otherwise(F.regexp_replace("t", r"^[^\p{L}]++", "").substr(1, SAMPLE_CHARS))
    drawn = rows.select("lang", F.xxhash64("k", F.xxhash64("t")).alias("draw"), head.alias("t")).join(F.broadcast(shares), "lang")  # SAMPLE_LANGS rows
    drawn = drawn.where(F.pmod("draw", F.lit(1 << 40)) <= F.col("share"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw", "t"))
    out = drawn.select("lang", "draw", "t", nth.alias("nth")).where(F.col("nth") <= SAMPLE_DOCS).collect()
    return [(r.t, r["lang"]) for r in sorted(out, key=lambda r: (r["lang"], r.nth))]


def places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first code points, code points after the last) of all words of all texts, each counted in its own text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    points = offsets_of((data & 0xC0) != 0x80)
    inside = (data != 0x20) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end with their text
    first = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    last = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    base = points[offsets[np.searchsorted(offsets, first, "right") - 1]]
    return points[first] - base, points[last] - base


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score"), runs: str | None = None) -> DataFrame:
    """The columns `keep` of docs, then the language and its score (mean posterior of the label, 0 to 1) under `names`.

    With `runs`, a column of that name holds the text's labelled words as runs of one label each, in order:
    array of (start, end, lang), in code points, from a run's first word to the end of its last one; words
    without letters have no label and don't end a run. A text that is null, empty or without letters, and any text
    if nothing was learned, is `und` with score 0 and no runs. Of labels with equal means the first in
    alphabetical order is taken. Repeated rows and keys get equal results; an empty table gives none. Columns of
    docs may have any names but those asked for here. One pass, no shuffle; the model travels as a broadcast of
    fixed size. A worker holds SLICE bytes of text, or one longer text with its words' posteriors.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at_text = keep.index(text) if text in keep and docs.schema[text].dataType.simpleString() == "string" else len(keep)
    parts = [docs[c].alias(f"c{i}") for i, c in enumerate(keep)] + ([docs[text].cast("string").alias(f"c{len(keep)}")] if at_text == len(keep) else [])
    kept = docs.select(*parts)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    out = [*keep, *names, *([runs] if runs else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in text_slices(batches, f"c{at_text}", SLICE):
            texts = texts_of(part, f"c{at_text}")
            codes, offsets, tokens = words_of(texts, lower=False)
            emit, known = own.emissions(tokens)
            real = known[codes] if len(own.labels) else np.zeros(len(codes), bool)
            ends = offsets_of(real)[offsets]
            codes = codes[real]
            starts = np.zeros(len(codes), bool)
            counts = np.diff(ends)
            has = np.flatnonzero(counts)
            starts[ends[:-1][has]] = True
            labels, scores = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            best = np.empty(0, np.int64)
            if len(has):
                mean = posteriors(emit[codes], starts, own.moves, own.first)
                share = np.add.reduceat(mean, ends[:-1][has], axis=0) / counts[has][:, None]
                labels[has] = np.array(own.labels, object)[share.argmax(1)]
                scores[has] = np.clip(share.max(1), 0, 1)
                best = mean.argmax(1)
            columns = [*part.columns[: len(keep)], pa.array(labels, pa.string()), pa.array(scores)]
            if runs:
                low, high = (x[real] for x in places(texts))
                turn = np.flatnonzero(starts | np.append(True, best[1:] != best[:-1])[: len(best)])
                stop = np.append(turn[1:], len(best))[: len(turn)] - 1
                lang = pa.array(own.labels, pa.string()).take(pa.array(best[turn]))
                cells = pa.StructArray.from_arrays([pa.array(low[turn], pa.int64()), pa.array(high[stop], pa.int64()), lang], fields=list(kind.value_type))
                columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(turn, ends), pa.int32()), cells))
            yield pa.RecordBatch.from_arrays(columns, out)

    schema = [f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, kept.schema, strict=False)] + [f"`{names[0]}` string", f"`{names[1]}` double"]
    return kept.mapInArrow(run, ", ".join([*schema, *([f"`{runs}` array<struct<start:bigint,end:bigint,lang:string>>"] if runs else [])]))


def drop_unclear(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of docs whose language stands out: not `und`, and a score of `least` or more. Columns are unchanged.

    If nothing was learned, rows whose text has a letter stay.
    """
    if not model.labels:
        return docs.where(F.coalesce(docs[text].cast("string").rlike(r"\p{L}"), F.lit(False)))
    names = (fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score"))
    out = predict(docs, model, text, tuple(docs.columns), names)
    return out.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).drop(*names)


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on the rows of docs that aren't held out (crc32 of the key as text, modulo 4, is 2)."""
    return fit(sample(docs.where(~held_out(docs[key])), text, lang, key))
