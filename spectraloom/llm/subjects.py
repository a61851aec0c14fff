"""Subject areas of documents, learnt from a labelled sample."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.prose import sections
from spectraloom.runtime import col, materialize

BAG = "doc_id long, mask long, lang int, words array<int>, distinct array<int>, w array<int>, n array<int>"


@dataclass(frozen=True)
class Subjects:
    """``documents(doc_id, words, shares)``: for every document with prose its number of words and the share of each subject.

    ``names`` are the subjects in the order of ``shares``; ``slopes`` and ``midpoints``
    give the calibrated, independent posterior of a subject: logistic(slope * (share -
    midpoint)). ``held_out(doc_id, subject, share, posterior, labelled)`` are the
    labelled documents of the calibration, as a classifier sees them that they did not train.
    """

    documents: DataFrame
    names: list[str]
    slopes: list[float]
    midpoints: list[float]
    held: DataFrame

    def _named(self, k: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.names)), k)

    def _posterior(self, k: Column, share: Column) -> Column:
        slope, middle = (F.get(F.array(*(F.lit(float(s)) for s in x)), k) for x in (self.slopes, self.midpoints))
        return 1 / (1 + F.exp(-slope * (share - middle)))

    def held_out(self) -> DataFrame:
        rows = self.held.select("doc_id", "mask", F.posexplode("shares").alias("k", "share"))
        labelled = F.get(F.array(*(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0 for k in range(len(self.names)))), F.col("k"))
        return rows.select("doc_id", self._named(F.col("k")).alias("subject"), "share", self._posterior(F.col("k"), F.col("share")).alias("posterior"), labelled.alias("labelled"))

    def reliability(self, bins: int = 10) -> DataFrame:
        """Held-out pairs of document and subject by posterior: ``bin, pairs, mean_posterior, labelled_share``."""
        place = F.least(F.lit(bins - 1), F.floor(F.col("posterior") * bins)).cast("int")
        rows = self.held_out().groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("pairs"), F.avg("posterior").alias("mean_posterior"), F.avg(F.col("labelled").cast("double")).alias("labelled_share"))
        return rows

    def posteriors(self) -> DataFrame:
        """``doc_id, subject, share, posterior`` of all subjects with a share above 0."""
        rows = self.documents.select("doc_id", F.posexplode("shares").alias("k", "share")).where(F.col("share") > 0)
        return rows.select("doc_id", self._named(F.col("k")).alias("subject"), "share", self._posterior(F.col("k"), F.col("share")).alias("posterior"))

    def assigned(self) -> DataFrame:
        """``doc_id, subject`` where the posterior is at least one half."""
        return self.posteriors().where(F.col("posterior") >= 0.5).select("doc_id", "subject")

    def composition(self) -> DataFrame:
        """Per subject, and null for prose without one: documents assigned, words, and its part of all words."""
        parts = F.concat(F.col("shares"), F.array(1 - F.aggregate("shares", F.lit(0.0), lambda s, x: s + x)))
        rows = self.documents.select("words", F.posexplode(parts).alias("k", "share"))
        sums = rows.groupBy("k").agg(F.count(F.when((F.col("share") > 0) & (self._posterior(F.col("k"), F.col("share")) >= 0.5), 1)).alias("documents"), F.sum(F.col("words") * F.col("share")).alias("words"))
        name = self._named(F.col("k"))
        every = sums.agg(F.sum("words").alias("every"))
        return sums.join(F.broadcast(every)).select(name.alias("subject"), "documents", F.round("words").cast("long").alias("words"), F.round(F.try_divide("words", "every"), 6).alias("share"))


def subject_areas(
    df: DataFrame,
    id: str,
    text: str,
    labels: DataFrame,
    names: list[str],
    *,
    lang: str | None = None,
    languages: int = 7,
    least: float = 0.25,
    rounds: int = 4,
    hash_bits: int = 17,
    max_labels: int = 200_000,
    held_out: float = 0.2,
    min_density: float = 0.02,
    smoothing: float = 0.2,
    untelling: tuple[float, float] = (0.4, 0.8),
    doubt: float = 0.02,
    sharing: float = 0.05,
) -> Subjects:
    """Assign each document the subjects that at least ``least`` of its prose is about.

    ``labels(doc_id, subject)`` is the labelled sample; subjects are compared in lower
    case and trimmed, unknown ones are ignored, and at most ``max_labels`` rows are used
    (those lowest by hash of the id), which bounds what is sent to every task. All else
    covers all documents. There can be up to 62 subjects.

    A document's prose is divided into sections; words are hashed to ``hash_bits`` bits.
    ``lang`` names a column with the language of most documents, right more often than
    not. Its ``languages`` most frequent values each have a model, the others share one;
    which of them a document is in is decided by the common words of these languages,
    learnt from all documents, and not by its own entry, which can be missing or wrong.
    Without the column all documents are of one language.

    A word counts the less the larger the part of the language's documents that contain
    it: not at all from exp(-``untelling[0]``) on, fully below exp(-``untelling[1]``), so
    that the common words of a language do not stand for a subject. A complement naive
    Bayes classifier of sections is trained on the sections of the labelled documents,
    then refined by expectation-maximization over all sections, labelled or not: a
    labelled document's sections keep to its labels but for ``doubt``, as some are wrong.
    A word takes ``sharing`` of its use in the other languages, so one unseen in a
    language is not without evidence. A section of which less than ``min_density`` of the
    words tell of a subject is about none. A subject's share is the part of the
    document's words in its sections.

    ``held_out`` of the labelled documents, chosen by hash, are kept from a first
    classifier; on them the posterior of each subject, a logistic curve in its share, is
    calibrated. A second one, trained with all labels, gives the shares. Slope and
    midpoint are those of the highest likelihood, under a prior that puts the midpoint
    near ``least`` (within about 0.05) and lets some labels be wrong. A subject is
    assigned where its posterior is one half or more.

    Null texts, empty ones and texts without prose do not appear; whole texts are used;
    a repeated id is treated as another document. Without labels nothing is assigned.
    """
    if len(names) > 62:
        raise ValueError("more than 62 subjects")
    c = len(names)
    given = labels.select(col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("subject")).alias("s")).where(F.col("doc_id").isNotNull()).distinct()
    place = {s.lower(): k for k, s in enumerate(names)}
    number = F.create_map(*(F.lit(x) for pair in place.items() for x in pair)) if place else F.create_map(F.lit(""), F.lit(0))
    given = given.where(F.col("s").isin(list(place))).orderBy(F.xxhash64("doc_id"), "doc_id", "s").limit(max_labels)
    masks = given.groupBy("doc_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.try_element_at(number, F.col("s")))).alias("mask"))
    code = F.lower(F.trim(col(lang))) if lang is not None else F.lit("")
    known: list[str] = []
    if lang is not None:
        spoken = df.select(code.alias("l")).where(F.col("l") != "").groupBy("l").count()
        known = sorted(r["l"] for r in spoken.orderBy(F.desc("count"), "l").limit(languages).collect())
    several = len(known) + 1
    given_lang = F.coalesce(F.array_position(F.array(*map(F.lit, known)), code).cast("int"), F.lit(0)) - 1 if known else F.lit(0)
    docs = df.select(col(id).cast("long").alias("doc_id"), col(text).alias("text"), given_lang.cast("int").alias("lang")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    docs = docs.join(F.broadcast(masks), "doc_id", "left")
    bags = materialize(docs.mapInArrow(_bags(hash_bits), BAG), "bags")

    speech = _speech(bags, several, hash_bits) if known else None
    setup = _Setup(hash_bits, several, held_out, min_density, doubt, sharing, speech)
    telling = _telling(bags, setup, untelling)
    told = np.flatnonzero(telling > 0)
    active = _Active(told.astype(np.int32), telling[told].astype(np.float32))
    bags = _compact(bags, active, setup)

    def train(setup: _Setup) -> _Model:
        model = None
        for _ in range(rounds + 1):
            counts = _expected(bags, model, active, c, setup)
            model = _complement(counts, active, setup, smoothing)
        return model

    some = bags.where(F.col("mask").isNotNull() & _is_held(F.col("doc_id"), held_out))
    held = _shares(some, train(setup), active, c, setup, "held-out")
    slopes, midpoints = _calibrate(held, c, least)
    whole = replace(setup, held_out=0.0)
    shares = _shares(bags, train(whole), active, c, whole, "shares")
    return Subjects(shares.select("doc_id", "words", "shares"), names, slopes, midpoints, held)


def _is_held(doc_id: Column, part: float) -> Column:
    """Whether a document is among those held out; ``_held`` is the same in numpy."""
    return F.pmod(F.pmod(doc_id, F.lit(1_000_003)) * 7919 + F.pmod(doc_id, F.lit(997)), F.lit(1000)) < int(part * 1000)


def _held(doc_id: np.ndarray, part: float) -> np.ndarray:
    return ((doc_id % 1_000_003) * 7919 + doc_id % 997) % 1000 < int(part * 1000)


@dataclass(frozen=True)
class _Setup:
    hash_bits: int
    several: int
    held_out: float
    min_density: float
    doubt: float
    sharing: float
    speech: tuple[np.ndarray, np.ndarray] | None

    @property
    def features(self) -> int:
        return self.several << self.hash_bits


def _bags(hash_bits: int):
    limit = (1 << hash_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def code(word: str) -> int:
            if word not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen[word] = zlib.crc32(word.encode()) & limit
            return seen[word]

        for batch in batches:
            ids, marks, langs, sizes, kinds, ws, ns = [], [], [], [], [], [], []
            for doc, mask, lang, text in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "mask", "lang")), batch.column("text")):
                parts = sections(text.as_py())
                if not parts:
                    continue
                w, n, kind = [], [], []
                for part in parts:
                    bag: dict[str, int] = {}
                    for x in part:
                        bag[x] = bag.get(x, 0) + 1
                    w += map(code, bag)
                    n += bag.values()
                    kind.append(len(bag))
                ids.append(doc)
                marks.append(mask)
                langs.append(lang)
                sizes.append([len(p) for p in parts])
                kinds.append(kind)
                ws.append(np.array(w, np.int32))
                ns.append(np.array(n, np.int32))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(langs, pa.int32()), *(pa.array(x, ints) for x in (sizes, kinds, ws, ns))], ["doc_id", "mask", "lang", "words", "distinct", "w", "n"])

    return run


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Some thousand documents at a time, so that flat arrays of their words stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Batch:
    """A batch of bags in flat arrays: ``feature, n, section`` of the entries, ``doc, words`` of the sections, ``lang`` of the documents."""

    def __init__(self, batch: pa.RecordBatch, setup: _Setup) -> None:
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        length = lambda name: batch.column(name).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.docs = batch.num_rows
        self.ids = batch.column("doc_id")
        self.words = flat("words").astype(np.float64)
        self.doc = np.repeat(np.arange(self.docs), length("words"))
        self.section = np.repeat(np.arange(len(self.words)), flat("distinct"))
        self.word = flat("w").astype(np.int64)
        self.n = flat("n").astype(np.float64)
        self.entry_doc = np.repeat(np.arange(self.docs), length("w"))
        self.lang = batch.column("lang").to_numpy().astype(np.int64)
        self.lang[self.lang < 0] = setup.several - 1
        if setup.speech is not None:
            words, weight = setup.speech
            at = np.minimum(np.searchsorted(words, self.word), len(words) - 1) if len(words) else np.zeros(len(self.word), np.int64)
            on = words[at] == self.word if len(words) else np.zeros(len(self.word), bool)
            key = np.unique(self.entry_doc[on] * max(1, len(words)) + at[on])
            doc, at = key // max(1, len(words)), key % max(1, len(words))
            score = np.stack([np.bincount(doc, weights=weight[at, k], minlength=self.docs) for k in range(setup.several)], 1)
            spoken = np.bincount(doc, minlength=self.docs) > 0
            self.lang = np.where(spoken, score.argmax(1), self.lang)
        self.feature = self.word + (self.lang[self.entry_doc] << setup.hash_bits)


def _document_counts(bags: DataFrame, setup: _Setup) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each language, and those of them that contain each feature."""
    features, several = setup.features, setup.several

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(features, np.int64), np.zeros(several, np.int64)
        for batch in _slices(batches):
            b = _Batch(batch, setup)
            key = np.unique(b.entry_doc * features + b.feature)
            df += np.bincount(key % features, minlength=features)
            docs += np.bincount(b.lang, minlength=several)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[own, -1 - np.arange(several)]), pa.array(np.r_[df[own], docs])], ["feature", "df"])

    # at most as many rows as there are features
    got = bags.mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    feature, count = got["feature"].to_numpy(np.int64), got["df"].to_numpy(np.int64)
    docs, df = np.zeros(several), np.zeros(features)
    docs[-1 - feature[feature < 0]] = count[feature < 0]
    df[feature[feature >= 0]] = count[feature >= 0]
    return docs, df


def _speech(bags: DataFrame, several: int, hash_bits: int, common: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """How the words that at least ``common`` of some language's documents contain tell the languages, by the documents' own entries: those words, rising, and their weights."""
    docs, df = _document_counts(bags, _Setup(hash_bits, several, 0.0, 0.0, 0.0, 0.0, None))
    part = (df.reshape(several, -1).T + 0.5) / (docs + 1.0)
    part[:, docs < 1] = 1e-9  # nobody's language
    words = np.flatnonzero((part[:, :-1] >= common).any(1))
    weight = np.log(part[words])
    weight[:, -1] = np.minimum(weight[:, -1], weight[:, :-1].max(1) - 0.1)  # documents without an entry are not a language of their own
    return words, weight


def _telling(bags: DataFrame, setup: _Setup, untelling: tuple[float, float]) -> np.ndarray:
    """How much a word of a language tells, 0 to 1, from the part of the language's documents that contain it."""
    docs, df = _document_counts(bags, setup)
    idf = np.log((np.repeat(docs, 1 << setup.hash_bits) + 1) / (df + 1))
    return np.where(df > 0, np.clip((idf - untelling[0]) / (untelling[1] - untelling[0]), 0, 1), 0)


@dataclass(frozen=True)
class _Model:
    """Weights (subjects, active features), and which features are evidence of a subject."""

    weights: np.ndarray
    evident: np.ndarray


@dataclass(frozen=True)
class _Active:
    """The features that tell anything: their numbers, rising, and how much; nothing else is sent to the tasks."""

    feature: np.ndarray
    telling: np.ndarray


def _compact(bags: DataFrame, active: _Active, setup: _Setup) -> DataFrame:
    """The bags with the active features only, by their place among them: what the passes read."""
    shared = bags.sparkSession.sparkContext.broadcast(active.feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.full(setup.features, -1, np.int32)
        row[shared.value] = np.arange(len(shared.value))
        for batch in _slices(batches):
            b = _Batch(batch, setup)
            at = row[b.feature]
            on = at >= 0
            ends = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            per_doc = ends(np.bincount(b.entry_doc[on], minlength=b.docs))
            lists = [pa.ListArray.from_arrays(per_doc, pa.array(x[on].astype(np.int32))) for x in (at, b.n)]
            distinct = pa.ListArray.from_arrays(ends(np.bincount(b.doc, minlength=b.docs)), pa.array(np.bincount(b.section[on], minlength=len(b.words)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.ids, batch.column("mask"), batch.column("words"), distinct, *lists], ["doc_id", "mask", "words", "distinct", "at", "n"])

    done = materialize(bags.mapInArrow(run, "doc_id long, mask long, words array<int>, distinct array<int>, at array<int>, n array<int>"), "compact-bags")
    shared.destroy()
    return done


class _Entries:
    """A batch of compact bags: ``at, n, section`` of the entries, ``doc, words`` of the sections."""

    def __init__(self, batch: pa.RecordBatch, setup: _Setup) -> None:
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        self.docs, self.ids = batch.num_rows, batch.column("doc_id")
        self.mask = np.where(_held(self.ids.to_numpy(), setup.held_out), 0, batch.column("mask").fill_null(0).to_numpy())  # of those that train
        self.words = flat("words").astype(np.float64)
        self.doc = np.repeat(np.arange(self.docs), batch.column("words").value_lengths().to_numpy(zero_copy_only=False))
        self.section = np.repeat(np.arange(len(self.words)), flat("distinct"))
        self.at, self.n = flat("at"), flat("n")


def _posterior(b: _Entries, model: _Model, telling: np.ndarray, min_density: float) -> np.ndarray:
    """Posteriors of all sections of a batch; rows of 0 for sections about no subject."""
    x = np.minimum(b.n, 3) * telling[b.at]
    s = np.stack([np.bincount(b.section, weights=x * w[b.at], minlength=len(b.words)) for w in model.weights], 1)
    s = np.exp(s - s.max(1, keepdims=True))
    evidence = np.bincount(b.section, weights=b.n * model.evident[b.at], minlength=len(b.words))
    s[evidence < min_density * b.words] = 0
    return s


def _expected(bags: DataFrame, model: _Model | None, active: _Active, c: int, setup: _Setup) -> np.ndarray:
    """Expected counts (active features, subjects): from the labels alone at first, then from the model."""
    shared = bags.sparkSession.sparkContext.broadcast((model, active.telling))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, telling = shared.value
        total = np.zeros((c, len(telling)))
        for batch in _slices(batches):
            b = _Entries(batch, setup)
            asked = ((b.mask[:, None] >> np.arange(c)) & 1).astype(np.float64)
            if model is None:
                r = asked[b.doc]
            else:
                r = _posterior(b, model, telling, setup.min_density) * np.where(b.mask[:, None] > 0, np.maximum(asked, setup.doubt), 1.0)[b.doc]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            x = np.minimum(b.n, 3) * telling[b.at]
            for k in range(c):
                part = np.ascontiguousarray(r[:, k])
                if part.any():
                    total[k] += np.bincount(b.at, weights=x * part[b.section], minlength=len(telling))
        own = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(total[k, own]) for k in range(c))], ["row", *(f"n{k}" for k in range(c))])

    cols = [f"n{k}" for k in range(c)]
    source = bags.where(F.col("mask").isNotNull()) if model is None else bags  # at first only labelled documents count
    got = source.mapInArrow(run, "row long, " + ", ".join(f"{x} double" for x in cols)).groupBy("row").agg(*(F.sum(x).alias(x) for x in cols)).toPandas()
    shared.destroy()
    out = np.zeros((len(active.telling), c))
    out[got["row"].to_numpy(np.int64)] = got[cols].to_numpy(np.float64).round(6)
    return out


def _complement(counts: np.ndarray, active: _Active, setup: _Setup, smoothing: float) -> _Model:
    """Weights of complement naive Bayes, each language by itself: minus the log of a word's part in all other subjects.

    A word is evidence if, all subjects being equally large, at least half of its use is in one.
    """
    word, lang = active.feature & ((1 << setup.hash_bits) - 1), active.feature >> setup.hash_bits
    everywhere = np.zeros((1 << setup.hash_bits, counts.shape[1]))
    np.add.at(everywhere, word, counts)
    counts = counts + setup.sharing * (everywhere[word] - counts)
    out, evident = np.zeros_like(counts), np.zeros(len(counts), bool)
    for own in range(setup.several):
        at = lang == own
        if at.any():
            rate = counts[at] / np.maximum(counts[at].sum(0), 1.0)
            evident[at] = rate.max(1) * 2 >= np.maximum(rate.sum(1), 1e-12)
            others = counts[at].sum(1, keepdims=True) - counts[at] + smoothing
            out[at] = -np.log(others / others.sum(0, keepdims=True))
    return _Model(np.ascontiguousarray(out.T.astype(np.float32)), evident)


def _shares(bags: DataFrame, model: _Model, active: _Active, c: int, setup: _Setup, name: str) -> DataFrame:
    """``doc_id, mask, words, shares``, written to the shared folder."""
    shared = bags.sparkSession.sparkContext.broadcast((model, active.telling))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, telling = shared.value
        for batch in _slices(batches):
            b = _Entries(batch, setup)
            r = _posterior(b, model, telling, setup.min_density)
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            words = np.bincount(b.doc, weights=b.words, minlength=b.docs)
            share = np.stack([np.bincount(b.doc, weights=b.words * r[:, k], minlength=b.docs) for k in range(c)], 1) / words[:, None]
            ends = pa.array((np.arange(b.docs + 1) * c).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.ids, batch.column("mask"), pa.array(words.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(share.ravel()))], ["doc_id", "mask", "words", "shares"])

    done = materialize(bags.mapInArrow(run, "doc_id long, mask long, words long, shares array<double>"), name)
    shared.destroy()
    return done


def _calibrate(held: DataFrame, c: int, least: float) -> tuple[list[float], list[float]]:
    """Slope and midpoint of each subject's logistic curve, by penalized likelihood over the held-out documents."""
    got = held.select("mask", "shares").toPandas()  # bounded by the labels
    if not len(got):
        return [20.0] * c, [least] * c
    x = np.stack(got["shares"].to_numpy())
    y = (got["mask"].to_numpy(np.int64)[:, None] >> np.arange(c)) & 1
    slope, middle = np.meshgrid(np.linspace(1, 60, 60), least + np.linspace(-0.15, 0.15, 31), indexing="ij")
    slopes, midpoints = [], []
    for k in range(c):
        z = slope[..., None] * (x[:, k] - middle[..., None])
        hit = 0.97 / (1 + np.exp(-np.clip(z, -500, 500))) + 0.015  # a few labels are wrong
        cost = -np.where(y[:, k] == 1, np.log(hit), np.log(1 - hit)).sum(-1) + (slope - 20) ** 2 / 200 + ((middle - least) / 0.05) ** 2 / 2
        best = np.unravel_index(np.argmin(cost), cost.shape)
        slopes.append(float(slope[best]))
        midpoints.append(float(middle[best]))
    return slopes, midpoints
