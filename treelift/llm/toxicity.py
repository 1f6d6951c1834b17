"""Toxicity by the nearest labelled examples, in exact TF-IDF cosine over a block-max inverted index.

A term is a word, a run of letters, digits and underscores of any script, folded by Unicode case; a run of more than ``LONG_RUN`` characters (scripts
without spaces) gives all its pieces of ``PIECE``.  A weight is (1 + log count) * idf.  idf is log((1 + n) / (1 + held)) + 1 with the
number of all documents and of those that hold the term, counted over all documents for the terms of the examples; a term that no example
holds weighs as one that no document holds, whatever its count over the documents.  It is in a text's norm, so a similarity is the cosine of whole texts.

The examples are at most ``MAX_EXAMPLES`` labelled rows, with all their terms.  The index keeps, for each term, the examples that hold
it, in blocks of ``BLOCK`` of like ones, with the largest weight of each.  A query bounds every block by its terms' block maxima, opens the
most promising blocks, and then those whose bound reaches the neighbours at hand; so the neighbours are exact.  What the commonest terms add
is worked out for many queries at once, and is exact in the bounds.

Each neighbour votes with its cosine times ``FLOOR``, and with what the terms that it shares with the text add to the cosine, times how far labelled texts
of either kind differ in holding them: the square of the standard errors above ``NOISE``.  The share of label 1 among the votes is calibrated by
isotonic regression, drawn straight between the middles of its steps: the examples are dealt to ``FOLDS`` parts, and each part is scored with
neighbours and contrasts of the others only.

Defined results: a text that shares no term with the examples (a null or empty one, too) gets the least calibrated score; with no
labelled rows every score is 0; of a document's labels the largest counts, null labels don't; rows repeated are scored each;
a null id is not held out; an empty table gives an empty result; additional columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.llm.text import free_name
from treelift.sources.scratch import Scratch

MAX_EXAMPLES = 4096
NEIGHBOURS = 64
EVIDENCE = 8
BLOCK = 64
OPENED = 16
CLUSTERS = 16
COMMON = 32
TOGETHER = 128
HELD_TOGETHER = 256
THRESHOLD = 0.7
LONG_RUN, PIECE = 24, 4
FOLDS = 5
NOISE = 2.0
FLOOR = 0.1

_WORD = re.compile(r"\w+")
#: bytes.translate table that makes a space of every ASCII character outside words.
_APART = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _words(text: str | None) -> list[str]:
    """The runs of letters, digits and underscores, in order: split at ASCII characters; a pattern serves texts with other marks."""
    folded = (text or "").casefold()
    words = folded.encode("utf-8", "surrogatepass").translate(_APART).decode("utf-8", "surrogatepass").split()
    if folded.isascii() or all(w.isascii() or w.isalnum() for w in words):
        return words
    return _WORD.findall(folded)


def distinct_terms(text: str | None) -> set[str]:
    """The terms that a text holds."""
    terms = set(_words(text))
    if max(map(len, terms), default=0) > LONG_RUN:
        for run in [w for w in terms if len(w) > LONG_RUN]:
            terms.remove(run)
            terms.update(run[k : k + PIECE] for k in range(0, len(run), PIECE))
    return terms


def term_counts(text: str | None) -> Counter[str]:
    """How often a text holds each of its terms."""
    counts = Counter(_words(text))
    if max(map(len, counts), default=0) > LONG_RUN:
        for run in [w for w in counts if len(w) > LONG_RUN]:
            n = counts.pop(run)
            for k in range(0, len(run), PIECE):
                counts[run[k : k + PIECE]] += n
    return counts


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, fold, text) to (doc_id, toxic, fold, terms, counts)."""
    for batch in batches:
        counts = [term_counts(t) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:3],
                pa.array([list(c) for c in counts], pa.list_(pa.string())),
                pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())),
            ],
            ["doc_id", "toxic", "fold", "terms", "counts"],
        )


def _holding(shared):
    """Texts to the number of them that hold each term of the vocabulary, and the number of texts under term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        held, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, HELD_TOGETHER):  # terms of many texts are looked up once
                texts, here = batch.column(0).slice(at, HELD_TOGETHER).to_pylist(), Counter()
                for text in texts:
                    here.update(distinct_terms(text))
                terms = np.fromiter(map(vocabulary.get, here, repeat(-1)), np.int64, len(here))
                known = terms >= 0
                held[terms[known]] += np.fromiter(here.values(), np.int64, len(here))[known]
                n += len(texts)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(held[at], n))], ["term", "n"])

    return run


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after the other."""
    total = np.cumsum(count)
    return np.repeat(begin - total + count, count) + np.arange(total[-1] if len(total) else 0)


class Vectors:
    """Unit vectors of examples, one after the other."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.weights = terms, weights

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Vectors:
        none = np.zeros(0, np.int64)
        return cls(np.array([len(t) for t, _ in rows], np.int64), np.concatenate([none, *(t for t, _ in rows)]), np.concatenate([np.zeros(0), *(w for _, w in rows)]))

    def __len__(self) -> int:
        return len(self.begin) - 1

    def take(self, rows: np.ndarray) -> Vectors:
        sizes = self.begin[rows + 1] - self.begin[rows]
        at = _ranges(self.begin[rows], sizes)
        return Vectors(sizes, self.terms[at], self.weights[at])

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begin[k], self.begin[k + 1])
        return self.terms[part], self.weights[part]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.begin))


class BlockMaxIndex:
    """Inverted lists over unit vectors in blocks of examples, with the largest weight of each list in each block."""

    def __init__(self, vectors: Vectors, n_terms: int) -> None:
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        order = np.argsort(vectors.terms, kind="stable")  # by term, then by example
        terms, examples, weights = vectors.terms[order].astype(np.int64), vectors.owners()[order], vectors.weights[order]
        del order
        # lists that hold a good part of all examples are kept as rows, a place for each example of each block
        common = np.bincount(terms, minlength=n_terms) * COMMON >= max(self.n, 1)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), self.blocks * BLOCK))
        full = common[terms]
        self.rows[self.row[terms[full]], examples[full]] = weights[full]
        # the others are kept as cells, the part of a list that lies in a block
        terms, self.examples, self.weights = terms[~full], examples[~full], weights[~full]
        cell = terms * max(self.blocks, 1) + self.examples // BLOCK
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_begin = np.append(starts, len(cell))
        self.cell_block = self.examples[starts] // BLOCK
        self.cell_most = np.maximum.reduceat(self.weights, starts) if len(starts) else np.zeros(0)
        self.cells = np.searchsorted(terms[starts], np.arange(n_terms + 1))

    def common_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosines of all examples, by query, block and place: one product for many queries."""
        spread = np.zeros((len(queries), len(self.rows)))
        for q, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            spread[q, row[row >= 0]] = weights[row >= 0]
        return (spread @ self.rows).reshape(len(queries), self.blocks, BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (of equals, the first), and their cosines. common: what :meth:`common_part` gave for this query."""
        if common is None:
            common = self.common_part([(terms, weights)])[0]
        rare = self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        count = self.cells[terms + 1] - self.cells[terms]
        cells, weights = _ranges(self.cells[terms], count), np.repeat(weights, count)
        block = self.cell_block[cells]
        bound = common.max(1) + np.bincount(block, weights * self.cell_most[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        ids, cosines = np.zeros(0, np.int64), np.zeros(0)
        for blocks in (order[:OPENED], order[OPENED:]):
            if len(ids) == k:
                blocks = blocks[bound[blocks] >= cosines[-1] - 1e-12]
            if not len(blocks):
                continue
            chosen = np.zeros(self.blocks, bool)
            chosen[blocks] = True
            mine = np.flatnonzero(chosen[block])
            opened = cells[mine]
            begin = self.cell_begin[opened]
            size = self.cell_begin[opened + 1] - begin
            at = _ranges(begin, size)
            added = np.bincount(self.examples[at], np.repeat(weights[mine], size) * self.weights[at], self.blocks * BLOCK)
            scores, here = (common[blocks] + added.reshape(-1, BLOCK)[blocks]).ravel(), (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            scores[here >= self.n] = -1
            least = cosines[-1] if len(ids) == k else np.partition(scores, -k)[-k] if len(scores) > k else -0.5
            good = np.flatnonzero(scores >= max(least, -0.5))
            ids, cosines = np.concatenate([ids, here[good]]), np.concatenate([cosines, scores[good]])
            top = np.lexsort((ids, -cosines))[:k]
            ids, cosines = ids[top], cosines[top]
        return ids, cosines


def alike(vectors: Vectors, n_terms: int) -> np.ndarray:
    """An order that puts rows with the same kind of terms (a language, a topic) side by side, so that blocks differ in what they hold."""
    n = len(vectors)
    if n <= BLOCK:
        return np.arange(n)
    rnd = np.random.default_rng(5)
    axes = rnd.standard_normal((n_terms, 32), dtype=np.float32)
    places = np.array([vectors.weights[a:b] @ axes[vectors.terms[a:b]] for a, b in zip(vectors.begin, vectors.begin[1:], strict=False)])
    places /= np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-12)
    centres = places[rnd.choice(n, min(CLUSTERS, n), replace=False)]
    for _ in range(8):
        nearest = (places @ centres.T).argmax(1)
        centres = np.array([places[nearest == c].mean(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
    return np.lexsort((places @ centres[0], nearest))


class Neighbours:
    """Votes of labelled examples on a text."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, counted: Vectors, vocabulary: dict[str, int], idf: np.ndarray, unknown: float) -> None:
        """counted: examples' terms, with their counts for weights. unknown: idf of a term that no example holds."""
        self.vocabulary, self.idf, self.unknown = vocabulary, idf, unknown
        self.contrast = self._contrast(counted, labels.astype(int))
        weights = (1 + np.log(counted.weights)) * idf[counted.terms]
        owners = counted.owners()
        norms = np.sqrt(np.bincount(owners, weights * weights, len(counted)))
        weights /= np.maximum(norms, 1e-300)[owners]
        unit = Vectors(np.diff(counted.begin), counted.terms, weights)
        del owners, weights
        order = alike(unit, len(idf))
        self.ids, self.labels, vectors = ids[order], labels[order].astype(float), unit.take(order)
        del unit
        self.index = BlockMaxIndex(vectors, len(idf))
        # of the neighbours' vectors, a vote needs the terms with a contrast only; these have numbers of their own
        tells = self.contrast > 0
        self.told = np.where(tells, np.cumsum(tells) - 1, -1)
        telling = tells[vectors.terms]
        sizes = np.bincount(vectors.owners()[telling], minlength=len(vectors))
        self.telling = Vectors(sizes, self.told[vectors.terms[telling]], vectors.weights[telling])
        self._spread = np.zeros(int(tells.sum()))

    def _contrast(self, counted: Vectors, labels: np.ndarray) -> np.ndarray:
        held = np.array([np.bincount(counted.terms[labels[counted.owners()] == label], minlength=len(self.idf)) for label in (0, 1)], float)
        n = np.bincount(labels, minlength=2)
        if not n.all():
            return np.zeros(len(self.idf))
        shares = (held + 0.5) / (n[:, None] + 1)
        both = (held.sum(0) + 0.5) / (n.sum() + 1)
        errors = np.abs(shares[1] - shares[0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
        return np.maximum(0, errors - NOISE) ** 2

    def query(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their weights in its unit vector."""
        terms = np.fromiter(map(self.vocabulary.get, counts, repeat(-1)), np.int64, len(counts))
        times = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        known = terms >= 0
        terms, weights, rest = terms[known], times[known], times[~known] * self.unknown
        if len(terms):
            weights = weights * self.idf[terms]
            weights /= np.sqrt(weights @ weights + rest @ rest)
        return terms, weights

    def votes(self, texts: list[dict[str, int]]) -> Iterator[tuple[float, list[tuple[int, float, int]]]]:
        """For each text's counts the share of label 1 among the votes, and the strongest ones as (id, cosine, label)."""
        yield from self.votes_of(map(self.query, texts))

    def votes_of(self, queries: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[tuple[int, float, int]]]]:
        """The same for known terms and their weights."""
        while together := list(islice(queries, TOGETHER)):
            for query, part in zip(together, self.index.common_part(together), strict=True):
                yield self._vote(*query, part)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text that has no others, and their weights in its unit vector."""
        weights = (1 + np.log(counts)) * self.idf[terms]
        return terms, weights / np.sqrt(weights @ weights) if len(terms) else weights

    def _vote(self, terms: np.ndarray, weights: np.ndarray, common: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
        if not len(terms) or not len(self.ids):
            return 0.0, []
        ids, cosines = self.index.nearest(terms, weights, NEIGHBOURS, common)
        told = self.told[terms]
        tells = told >= 0
        told = told[tells]
        self._spread[told] = weights[tells] * self.contrast[terms[tells]]
        begin = self.telling.begin[ids]
        sizes = self.telling.begin[ids + 1] - begin
        at = _ranges(begin, sizes)
        telling = np.bincount(np.repeat(np.arange(len(ids)), sizes), self._spread[self.telling.terms[at]] * self.telling.weights[at], len(ids))
        self._spread[told] = 0
        power = FLOOR * cosines + telling
        share = float(power @ self.labels[ids] / power.sum()) if power.sum() > 0 else 0.0
        first = [k for k in np.lexsort((self.ids[ids], -power))[:EVIDENCE] if cosines[k] > 0]
        return share, [(int(self.ids[ids[k]]), float(cosines[k]), int(self.labels[ids[k]])) for k in first]

    def vote(self, counts: dict[str, int]) -> tuple[float, list[tuple[int, float, int]]]:
        return next(self.votes([counts]))


def isotonic(x, y) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the middles of the steps of the rising function that fits y best; values are a little drawn off 0 and 1."""
    steps: list[list[float]] = []  # sum of x, sum of y, number, greatest x
    for a, b in sorted(zip(x, y, strict=True)):
        steps.append([a, b, 1.0, a])
        while len(steps) > 1 and (steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2] or steps[-2][3] == steps[-1][0] / steps[-1][2]):
            last = steps.pop()
            steps[-1] = [steps[-1][0] + last[0], steps[-1][1] + last[1], steps[-1][2] + last[2], last[3]]
    values = np.maximum.accumulate([(s + 0.05) / (n + 0.1) for _, s, n, _ in steps]) if steps else np.zeros(0)
    return np.array([a / n for a, _, n, _ in steps]), values


_EVIDENCE = {"doc_id": pa.int64(), "similarity": pa.float64(), "toxic": pa.int32()}


def _evidence(rows: tuple[list[tuple[int, float, int]], ...]) -> pa.ListArray:
    columns = list(zip(*(x for near in rows for x in near), strict=True)) or [()] * len(_EVIDENCE)
    structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, _EVIDENCE.values(), strict=True)], list(_EVIDENCE))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), structs)


_models: WeakKeyDictionary[Broadcast, dict[int | None, Neighbours]] = WeakKeyDictionary()


def _model(shared: Broadcast, fold: int | None = None, vocabulary: dict[str, int] | None = None) -> Neighbours:
    """The model of all examples, or of those outside a fold; a worker keeps the last one, as long as it keeps the broadcast."""
    kept = _models.setdefault(shared, {})
    if fold not in kept:
        kept.clear()
        ids, labels, folds, counted, idf, unknown = shared.value
        if fold is None:
            kept[fold] = Neighbours(ids, labels, counted, vocabulary or {}, idf, unknown)
        else:
            rows = np.flatnonzero(folds != fold)
            kept[fold] = Neighbours(ids[rows], labels[rows], counted.take(rows), {}, idf, unknown)
    return kept[fold]


def _cross_votes(shared: Broadcast):
    """(fold, example) to (vote by the other folds, label); the examples' terms are in the broadcast, so no vocabulary is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, _, counted, _, _ = shared.value
        for batch in batches:
            folds, examples = (c.to_numpy() for c in batch.columns)
            for fold in np.unique(folds).tolist():
                model, mine = _model(shared, fold), examples[folds == fold]
                votes = [share for share, _ in model.votes_of(map(model.unit, *zip(*(counted.row(k) for k in mine.tolist()), strict=True)))]
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), pa.array(labels[mine], pa.int32())], ["vote", "toxic"])

    return run


def _scored(shared: Broadcast, words: Broadcast, curve: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (x, y) = _model(shared, None, words.value), curve
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):  # terms and evidence of a few texts at a time
                part = batch.slice(at, TOGETHER)
                shares, evidence = zip(*model.votes([term_counts(t) for t in part.column(1).to_pylist()]), strict=True)
                scores = np.interp(shares, x, y) if len(x) else np.zeros(len(shares))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), _evidence(evidence)], ["doc_id", "score", "evidence"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """One row per document: held_out, score, predicted, and the examples that voted."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    examples = docs.join(F.broadcast(chosen), "doc_id").select(
        "doc_id",
        F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"),
        F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(FOLDS)).cast("int").alias("fold"),
        "text",
    )
    examples = scratch.keep(
        examples.mapInArrow(_example_terms, "doc_id long, toxic int, fold int, terms array<string>, counts array<int>"), "examples"
    )

    context = spark.sparkContext
    rows = examples.toArrow().sort_by("doc_id")  # bounded by max_examples; terms, not texts
    flat = rows.column("terms").combine_chunks().flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    vocabulary = {t: k for k, t in enumerate(sorted(words))}
    terms = np.array([vocabulary[t] for t in words], np.int64)[flat.indices.to_numpy()]
    known_words = context.broadcast(vocabulary)
    counted = docs.select("text").mapInArrow(_holding(known_words), "term long, n long")
    held = dict(counted.groupBy("term").agg(F.sum("n")).collect())
    n_docs = held.get(-1, 0)
    held_by = np.array([held.get(k, 0) for k in range(len(vocabulary))], float)
    idf, unknown = np.log((1 + n_docs) / (1 + held_by)) + 1, float(np.log(1 + n_docs) + 1)
    sizes = rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    counted = Vectors(sizes, terms.astype(np.int32), rows.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False))
    ids, known_labels, folds = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "toxic", "fold"))
    del rows, flat, words
    shared = context.broadcast((ids, known_labels, folds, counted, idf, unknown))
    places = spark.createDataFrame([(int(h), k) for k, h in enumerate(folds)], "fold int, example int")
    crossed = places.repartition(FOLDS, "fold").mapInArrow(_cross_votes(shared), "vote double, toxic int").collect()
    curve = isotonic([r.vote for r in crossed], [r.toxic for r in crossed])
    schema = "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"
    return docs.mapInArrow(_scored(shared, known_words, curve), schema).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic; a row without id stays."""
    ident = free_name(docs, "id")
    bad = score_documents(docs, labels).where("predicted = 1").select(F.col("doc_id").alias(ident)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[ident], "left_anti")
