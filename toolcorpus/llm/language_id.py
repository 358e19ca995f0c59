"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.llm.common import hash_unit

# Bounds of the training sample: labelled texts per language, and languages.
TEXTS_PER_LANGUAGE, MAX_LANGUAGES = 150, 256
SEQUENCES, SEQUENCE_WORDS, SEGMENT_WORDS, STEPS, RATE, DECAY = 1600, 64, 12, 80, 0.1, 1e-4
FEATURE_BITS = 17
# Texts that noise is made of, and how often a letter occurs in the sample at least to be one of the alphabet.
NOISE_TEXTS, LEAST_LETTERS = 300, 5
VOCABULARY = 1 << 17
# Emission values held at once while decoding.
HELD = 1 << 22
# Texts split into words at once.
TOGETHER = 256
UNKNOWN = "und"
# The label of what is no language, and the letter that stands for all that were not learned.
OTHER, STRANGE = "(other)", "\ufffd"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of all words and where each word's begin.

    Of ``^word$``: all character n-grams up to three, the prefixes and suffixes
    up to three letters (n-grams with a mark, up to four characters), and the
    whole word as the lexicon feature.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join(["^" + w + "$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    begins, left = ends - sizes, np.repeat(ends, sizes) - np.arange(len(chars))
    mask, ids, owners = np.uint64((1 << FEATURE_BITS) - 1), [], []
    word_of = np.repeat(np.arange(len(words)), sizes)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)) & mask
    run = np.zeros(len(chars), np.uint64)
    for n in range(1, 5):
        run = run * np.uint64(0x100000001B3) + np.append(chars[n - 1:], np.zeros(n - 1, np.uint64))
        inside = left >= n
        if n == 4:
            first = np.zeros(len(chars), bool)
            first[begins] = True
            inside &= first | (left == 4)
        at = np.flatnonzero(inside)
        ids.append(mix(run[at] + np.uint64(n)))
        owners.append(word_of[at])
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0xC2B2AE3D27D4EB4F, np.uint64))
    whole = np.add.reduceat(chars * powers[np.arange(len(chars)) - np.repeat(begins, sizes)], begins)
    ids.append(mix(whole ^ np.uint64(0xABCDEF)))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(words))
    return np.concatenate(ids)[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]])


def letters(token: str, keep: str = "") -> str:
    """The letters of a token in lower case, and the characters ``keep``; empty if it has none."""
    token = token.lower()
    return token if token.isalpha() else "".join(c for c in token if c.isalpha() or c in keep)


def known_letters(word: str, alphabet: frozenset[str]) -> str:
    """The word with every letter outside ``alphabet`` as the unknown letter."""
    return word if alphabet.issuperset(word) else "".join(c if c in alphabet else STRANGE for c in word)


@dataclass
class Model:
    """Labels, feature weights ``(features, labels)``, transition weights and start weights.

    With an ``alphabet``, letters outside it are all read as one unknown letter.
    """

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    alphabet: frozenset[str] | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        if self.alphabet is not None:
            words = [known_letters(w, self.alphabet) for w in words]
        ids, begins = features(words)
        return np.add.reduceat(self.weights[ids], begins, axis=0)


def marginals(emission: np.ndarray, begins: np.ndarray, sizes: np.ndarray, transitions: np.ndarray,
              start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many sequences at once.

    ``emission`` holds the sequences' words one after another; sequences must be
    sorted by falling size. Returns word posteriors, summed transition
    posteriors and the log partition sum.
    """
    e = np.exp(emission - emission.max(1, keepdims=True))
    t, logz = np.exp(transitions), float(emission.max(1).sum())
    alpha = np.empty_like(e)
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    state = None
    for step, m in enumerate(active):
        at = begins[:m] + step
        state = (np.exp(start) if step == 0 else state[:m] @ t) * e[at]
        scale = state.sum(1, keepdims=True)
        state = state / scale
        logz += float(np.log(scale).sum())
        alpha[at] = state
    pairs = np.zeros_like(t, dtype=np.float64)
    beta = np.ones((len(sizes), e.shape[1]), e.dtype)
    for step in range(len(active) - 1, -1, -1):
        m, at = active[step], begins[:active[step]] + step
        if step + 1 < len(active):
            n = active[step + 1]
            ahead = e[begins[:n] + step + 1] * beta[:n]
            old = alpha[begins[:n] + step]
            both = old.T @ (ahead / ((old @ t) * ahead).sum(1, keepdims=True))
            pairs += both * t
            back = ahead @ t.T
            beta[:n] = back / back.sum(1, keepdims=True)
        post = alpha[at] * beta[:m]
        alpha[at] = post / post.sum(1, keepdims=True)
    return alpha, pairs, logz


def code_switched(texts: list[tuple[int, np.ndarray]], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Training sequences ``(words, labels)`` of segments from texts of changing languages."""
    rng = np.random.default_rng(seed)
    by = {}
    for label, words in texts:
        if len(words):
            by.setdefault(label, []).append(words)
    kinds, total = sorted(by), SEQUENCES * SEQUENCE_WORDS
    words, labels, have = [], [], 0
    while have < total:
        label = kinds[rng.integers(len(kinds))]
        text = by[label][rng.integers(len(by[label]))]
        at = rng.integers(len(text))
        piece = text[at:at + rng.geometric(1 / SEGMENT_WORDS)]
        words.append(piece)
        labels.append(np.full(len(piece), label))
        have += len(piece)
    shape = (SEQUENCES, SEQUENCE_WORDS)
    return np.concatenate(words)[:total].reshape(shape), np.concatenate(labels)[:total].reshape(shape)


def train(texts: list[tuple[str, str]], seed: int = 11, keep: str = "") -> Model:
    """Fit the field to ``(language, text)`` by gradient steps on the likelihood of code-switched sequences."""
    kinds = sorted({lang for lang, _ in texts})
    slots: dict[str, int] = {}
    coded = [(kinds.index(lang), np.array([slots.setdefault(w, len(slots)) for w in (letters(x, keep) for x in text.split()) if w], np.int64))
             for lang, text in sorted(texts)]
    size, n_feat = len(kinds), 1 << FEATURE_BITS
    weights, trans, start = np.zeros((n_feat, size)), np.zeros((size, size)), np.zeros(size)
    if slots and size > 1:
        words, labels = code_switched(coded, seed)
        used, words = np.unique(words, return_inverse=True)
        vocabulary = list(slots)
        ids, at = features([vocabulary[i] for i in used])
        owner = np.repeat(np.arange(len(used)), np.diff(np.append(at, len(ids))))
        words, gold = words.ravel(), labels.ravel()
        begins, sizes = np.arange(SEQUENCES) * SEQUENCE_WORDS, np.full(SEQUENCES, SEQUENCE_WORDS)
        seen_pairs = np.zeros((size, size))
        np.add.at(seen_pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
        seen_start = np.bincount(labels[:, 0], minlength=size)
        params = [weights, trans, start]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        for step in range(1, STEPS + 1):
            own = np.add.reduceat(weights[ids], at, axis=0)
            post, pairs, _ = marginals(own[words], begins, sizes, trans, start)
            gap = -post
            gap[np.arange(len(gold)), gold] += 1
            by_word = np.stack([np.bincount(words, gap[:, k], len(used)) for k in range(size)], 1)
            by_feat = np.stack([np.bincount(ids, by_word[owner, k], n_feat) for k in range(size)], 1)
            grads = [by_feat, seen_pairs - pairs, seen_start - post[begins].sum(0)]
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g = g / len(gold) - DECAY * p / len(gold)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(kinds, weights.astype(np.float32), trans.astype(np.float32), start.astype(np.float32))


def noise(texts: list[str], alphabet: list[str], rng: np.random.Generator) -> list[str]:
    """Texts that are in no language, made from texts that are: the letters of every word shuffled, drawn anew from the
    whole alphabet, or unknown, a kind for each text in turn and words of one or two letters left out."""
    out = []
    for i, text in enumerate(texts):
        words = [w for w in map(letters, text.split()) if len(w) > 2]
        if i % 3 == 0:
            words = ["".join(rng.permutation(list(w))) for w in words]
        elif i % 3 == 1:
            words = ["".join(rng.choice(alphabet, len(w))) for w in words]
        else:
            share = rng.choice([0.5, 1.0])
            words = ["".join(STRANGE if rng.random() < share else c for c in w) for w in words]
        out.append(" ".join(words))
    return out


def train_with_other(texts: list[tuple[str, str]], seed: int = 11) -> Model:
    """The field over the languages and ``OTHER``, which is learned from noise made of the same texts."""
    if not texts:
        return train(texts, seed)
    texts = sorted(texts)
    counts = Counter(c for _, t in texts for c in t.lower() if c.isalpha())
    alphabet = frozenset(c for c, n in counts.items() if n >= LEAST_LETTERS) or frozenset(counts)
    rng = np.random.default_rng(seed)
    drawn = [texts[i][1] for i in rng.permutation(len(texts))[:NOISE_TEXTS]]
    known = [(lang, " ".join(known_letters(letters(w), alphabet) for w in t.split())) for lang, t in texts]
    marked = [(OTHER, t) for t in noise(drawn, sorted(alphabet), rng)]
    model = train(known + marked, seed, keep=STRANGE)
    model.alphabet = alphabet
    return model


class Decoder:
    """Label shares of texts; emissions of words are kept until ``VOCABULARY`` of them are."""

    def __init__(self, model: Model):
        self.model, self.slots = model, {}
        self.rows = np.zeros((0, len(model.labels)), np.float32)

    def coded(self, texts: list[str | None]) -> list[np.ndarray]:
        """Slots of each text's words; -1 for words without a letter."""
        if len(self.slots) > VOCABULARY:
            self.slots, self.rows = {}, self.rows[:0]
        out = []
        for at in range(0, len(texts), TOGETHER):
            split = [t.split() if t else [] for t in texts[at:at + TOGETHER]]
            new = [w for w in set().union(*split) if w not in self.slots]
            if new:
                plain = [letters(w) for w in new]
                slot = len(self.rows)
                for w, p in zip(new, plain, strict=True):
                    self.slots[w] = slot if p else -1
                    slot += bool(p)
                if slot > len(self.rows):
                    self.rows = np.concatenate([self.rows, self.model.emissions([p for p in plain if p])])
            get = self.slots.__getitem__
            out += [np.fromiter(map(get, words), np.int32, len(words)) for words in split]
        return out

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean posterior of each label, and mean of the largest posterior, over a text's words with letters; zeros if it has none."""
        out, sure = np.zeros((len(texts), len(self.model.labels))), np.zeros(len(texts))
        words = [w[w >= 0] for w in self.coded(texts)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if len(order):
            flat, n = np.concatenate([words[i] for i in order]), sizes[order]
            begins = np.cumsum(n) - n
            post, _, _ = marginals(self.rows[flat], begins, n, self.model.transitions, self.model.start)
            out[order] = np.add.reduceat(post, begins, axis=0, dtype=np.float64) / n[:, None]
            sure[order] = np.add.reduceat(post.max(1), begins, dtype=np.float64) / n
        return out, sure

    def known(self, shares: np.ndarray) -> np.ndarray:
        """The share of a text's words that are in a language, whichever it is."""
        return shares[:, [k for k, label in enumerate(self.model.labels) if label != OTHER]].sum(1)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    decoder, size = Decoder(model), max(1, len(model.labels))
    for batch in batches:
        texts = batch.column("txt").to_pylist()
        labels, scores, sures, at = [], [], [], 0
        while at < len(texts):
            to, room = at, HELD // size * 6
            while to < len(texts) and (to == at or room > 0):
                room -= len(texts[to] or "")
                to += 1
            shares, sure = decoder.shares(texts[at:to]) if model.labels else (np.zeros((to - at, 1)), np.zeros(to - at))
            best = shares.argmax(1)
            top = shares[np.arange(len(best)), best]
            labels += [model.labels[b] if s > 0 else UNKNOWN for b, s in zip(best, top, strict=True)]
            scores.append(np.minimum(top, 1.0))
            sures.append(np.minimum(sure, 1.0))
            at = to
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(labels, pa.string()),
             *(pa.array(np.concatenate(x) if x else [], pa.float64()) for x in (scores, sures))],
            [*batch.schema.names[:-1], "lang_pred", "score", "sureness"])


def held_out(id_col: Column, parts: int = 4, which: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == which


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None,
        per_language: int = TEXTS_PER_LANGUAGE, other: bool = False) -> Model:
    """Fit to a sample of about ``per_language`` labelled texts of each language, drawn by a hash of ``key``.

    Of more than ``MAX_LANGUAGES`` labels, the most frequent are learned (ties: the smallest). With ``other``, what
    is in none of them has a label of its own (``train_with_other``).
    """
    counts = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n"))
    found = counts.orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()
    draw = hash_unit("language", key if key is not None else F.col(text_col))
    share = F.lit(0.0)
    for r in found:
        share = F.when(F.col(lang_col) == r["l"], F.lit(min(1.0, per_language / r["n"]))).otherwise(share)
    rows = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (draw < share))
            .select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).limit(2 * per_language * max(1, len(found))).collect())
    return (train_with_other if other else train)([(r["l"], r["t"]) for r in rows])


def identify(docs: DataFrame, model: Model, text_col: str = "text", **keep: Column) -> DataFrame:
    """The columns ``keep`` and ``lang_pred, score, sureness`` for every text."""
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("txt"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda b: _predict(b, model), f"{fields}, lang_pred string, score double, sureness double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every whole text.

    Learns from text and non-null language of the rows whose crc32 of the
    identifier (null: of nothing) modulo 4 is not 2; the sample is bounded by
    ``TEXTS_PER_LANGUAGE`` and ``MAX_LANGUAGES``. Words are labelled by
    forward-backward over the whole text; a text's language is the label with
    the largest mean posterior over its words with letters, its score that
    mean. A null text, or one without letters, is ``und`` with score 0, and so
    is every text if there is nothing to learn from. Repeated rows get a row
    each; an empty table gives none; other columns are ignored.
    """
    model = fit(docs.where(~held_out(F.col(id_col))), text_col, lang_col, F.col(id_col))
    return identify(docs, model, text_col, doc_id=F.col(id_col), held_out=held_out(F.col(id_col))).drop("sureness")


def accepted(docs: DataFrame, model: Model, min_known: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, of whose words with letters ``min_known`` are in a language of ``model``.

    The model knows ``OTHER`` (``fit`` with ``other``), and the posteriors of all other labels count together, so
    a text spread evenly over many languages stays. Texts that are null or have no letter go, and so does every text
    if nothing was learned.
    """
    from toolcorpus.llm.common import packed

    rows = packed(docs, __text=F.col(text_col))
    kind = rows.schema["__row"].dataType.simpleString()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            texts, keep, at = batch.column("__text").to_pylist(), [], 0
            while at < len(texts):
                to, room = at, HELD // max(1, len(model.labels)) * 6
                while to < len(texts) and (to == at or room > 0):
                    room -= len(texts[to] or "")
                    to += 1
                share = decoder.known(decoder.shares(texts[at:to])[0]) if model.labels else np.zeros(to - at)
                keep += (share >= min_known).tolist()
                at = to
            yield batch.select(["__row"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(kept, f"__row {kind}").select("__row.*")
