"""Toxicity by the nearest labelled examples (operator 2).

A text is the TF-IDF vector of its words over the vocabulary of the labelled examples:
every word of two examples or more, without a cap.  The weight of a word is
(1 + log count) * idf * relevance; idf comes from all documents, and the relevance, a
power of the log-likelihood ratio of the word between the two classes of examples, is
near 0 for words that say nothing about the class and drops none.

Examples are filed in an inverted index: the postings of a word are cut into blocks of
examples, with the largest weight of each block beside it.  A query adds up those
maxima to bound the cosine that any example of a block can reach, opens blocks from
the highest bound down, and stops when the k-th best cosine found is no lower than the
next bound, so the k nearest examples are exact.  Their votes are weighted by distance
and class size, and mapped to probabilities by a monotone fit on the examples' own
votes, each left out of its own search.

Examples are bounded: per class those with the smallest hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core
from .decontaminate import lookup, words_of

MAX_EXAMPLES = 1_200
#: A word of a single example can bring no other text nearer to any but that one.
LEAST_EXAMPLES = 2
RELEVANCE_POWER = 0.75
NEIGHBOURS = 15
NO_VOTE = 0.01
BLOCK = 64


def held_out(id_col: Column) -> Column:
    """Whether a row is kept away from training: crc32 of the id as text is 2 modulo 4."""
    return core.crc_mod(id_col, 4) == 2


def bags(texts: list[bytes], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, count) of a chunk, by document and word; word: number in the sorted vocabulary of hashes."""
    words = words_of(texts)
    place, word = lookup(words.hash, vocabulary)
    key = np.sort(words.doc[place] * len(vocabulary) + word) if len(place) else place
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
    n = np.diff(np.append(edge, len(key))) if len(key) else key
    return key[edge] // max(1, len(vocabulary)), key[edge] % max(1, len(vocabulary)), n


def distinct_words(texts: list[bytes]) -> np.ndarray:
    """The hash of each distinct word of each document of a chunk."""
    words = words_of(texts)
    by = np.lexsort((words.hash, words.doc))
    doc, value = words.doc[by], words.hash[by]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new]


def _vocabulary(sample: DataFrame) -> DataFrame:
    """w, toxic, clean: examples of each class that hold a word, for words of LEAST_EXAMPLES or more."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy() == 1
            texts = core.byte_list(batch.column(1))
            for label in (True, False):
                mine = [texts[i] for i in np.flatnonzero(toxic == label)]
                for a, b in core.chunks(mine):
                    w, n = np.unique(distinct_words(mine[a:b]), return_counts=True)
                    zero = np.zeros(len(n), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([core.as_long(w), pa.array(n if label else zero), pa.array(zero if label else n)], ["w", "toxic", "clean"])

    counts = sample.select("label", "body").mapInArrow(counting, "w long, toxic long, clean long")
    return counts.groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") + F.col("clean") >= LEAST_EXAMPLES)


def _document_counts(rows: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """In how many of all documents each word of the vocabulary stands."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            texts = core.byte_list(batch.column(0))
            for a, b in core.chunks(texts):
                total += np.bincount(bags(texts[a:b], vocabulary)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["w", "n"])

    out = np.zeros(len(vocabulary), dtype=np.int64)
    counted = rows.select("body").mapInArrow(counting, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toPandas()  # a row per word of the examples
    out[counted["w"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    return out


def log_likelihood(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """2 * sum(observed * log(observed / expected)) of counts a of na and b of nb."""
    both = a + b
    ea, eb = both * na / (na + nb), both * nb / (na + nb)
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    return 2 * (part(a, ea) + part(b, eb) + part(na - a, na - ea) + part(nb - b, nb - eb))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for n[i] values, one range after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class BlockMaxIndex:
    """Postings of unit vectors by term, in blocks of BLOCK examples with the largest weight of each.

    first[t] to first[t + 1]: the blocks of term t; block, top, at, size: number, largest weight and range of postings of
    each; example, weight: the postings.
    """

    def __init__(self, term: np.ndarray, example: np.ndarray, weight: np.ndarray, n_terms: int, labels: np.ndarray, ids: np.ndarray, class_weight: tuple[float, float]):
        n = len(labels)
        # examples of a class that share their heaviest term stand together, so blocks have few high maxima
        heaviest = np.full(n, -1, dtype=np.int64)
        by = np.lexsort((weight, example))
        heaviest[example[by]] = term[by]
        order = np.lexsort((ids, heaviest, labels))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.labels, self.ids = labels[order], ids[order]
        example = place[example]
        by = np.lexsort((example, term))
        term, self.example, self.weight = term[by], example[by].astype(np.int32), weight[by]
        self.n_blocks = -(-n // BLOCK)
        key = term * max(1, self.n_blocks) + self.example // BLOCK
        self.at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        self.size = np.diff(np.append(self.at, len(key)))
        self.block = (self.example[self.at] // BLOCK).astype(np.int64)
        self.top = np.maximum.reduceat(self.weight, self.at) if len(self.at) else np.zeros(0)
        self.first = np.searchsorted(term[self.at], np.arange(n_terms + 1))
        self.votes = np.where(self.labels == 1, class_weight[1], class_weight[0])
        self.opened = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k examples of largest cosine above 0, ties by id; terms: distinct."""
        n = self.first[terms + 1] - self.first[terms]
        held = _ranges(self.first[terms], n)
        block, weight = self.block[held], np.repeat(weights, n)
        bounds = np.bincount(block, weights=weight * self.top[held], minlength=self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        best_i, best_c = np.zeros(0, dtype=np.int64), np.zeros(0)
        done, step = 0, 8
        while done < len(order) and not (len(best_c) == k and best_c[-1] >= bounds[order[done]] + 1e-12):
            wanted = np.zeros(self.n_blocks, dtype=bool)
            wanted[order[done : done + step]] = True
            self.opened += int(wanted.sum())
            some = wanted[block]
            size = self.size[held[some]]
            posting = _ranges(self.at[held[some]], size)
            cosine = np.bincount(self.example[posting], weights=self.weight[posting] * np.repeat(weight[some], size), minlength=len(self.labels))
            i = np.flatnonzero(cosine > 0)
            if without is not None:
                i = i[self.ids[i] != without]
            i, c = np.concatenate((best_i, i)), np.concatenate((best_c, cosine[i]))
            if len(i) > 4 * k:
                least = np.partition(c, len(c) - k)[len(c) - k]
                i, c = i[c >= least], c[c >= least]
            by = np.lexsort((self.ids[i], -c))[:k]
            best_i, best_c = i[by], c[by]
            done, step = done + step, 2 * step
        return best_i, best_c

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic votes: closeness times class weight, against a fixed vote for neither, so that far neighbours decide nothing."""
        w = self.votes[found] / self.votes.mean() * cosine * cosine / (1.05 - np.minimum(cosine, 1.0))
        return float((w * self.labels[found]).sum() / (w.sum() + NO_VOTE))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone fit by pooling neighbours: knots and values for linear interpolation."""
    by = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[by].tolist(), y[by].tolist(), w[by].tolist(), strict=True):
        pools.append([a, b, c])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            p, q = pools[-2], pools.pop()
            total = p[2] + q[2]
            pools[-1] = [(p[0] * p[2] + q[0] * q[2]) / total, (p[1] * p[2] + q[1] * q[2]) / total, total]
    return np.array([p[0] for p in pools]), np.array([p[1] for p in pools])


class Model:
    """Vocabulary, its weights, the index of the examples, and the map from votes to probabilities."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_examples: int):
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        mine = labels.filter(~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
        mine = mine.groupBy("id").agg(F.max("label").alias("label"))
        sizes = {r[0]: r[1] for r in mine.groupBy("label").count().collect()}
        pick = lambda c: mine.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(max_examples)
        chosen = pick(0).unionByName(pick(1))  # 2 * max_examples rows at most
        sample = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("body")).join(F.broadcast(chosen), "id")
        # copies of a text speak once
        written = sample = core.checkpointed(sample.groupBy(F.xxhash64("body").alias("h"), "label").agg(F.min("id").alias("id"), F.first("body").alias("body")))
        n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
        self.counts = n.get(0, 0), n.get(1, 0)
        self.class_weight = tuple(sizes.get(c, 0) / max(1, n.get(c, 0)) for c in (0, 1))
        self.words, self.weights = np.zeros(0, dtype=core.U64), np.zeros(0)
        if all(self.counts):
            found = _vocabulary(sample).toPandas()  # words of the examples only
            self.words = found["w"].to_numpy(dtype=np.int64).view(core.U64)
            by = np.argsort(self.words)
            self.words = self.words[by]
            toxic, clean = (found[c].to_numpy(dtype=np.float64)[by] for c in ("toxic", "clean"))
            relevance = np.maximum(log_likelihood(toxic, clean, self.counts[1], self.counts[0]), 0.0) ** RELEVANCE_POWER
            rows = docs.select(text.alias("body"))
            df = _document_counts(rows, self.words)
            self.weights = (np.log((rows.count() + 1.0) / (df + 1.0)) + 1.0) * relevance
        self._index(sample)
        core.discard(written)

    def vectors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word, weight) of the unit vectors of a chunk; texts without words of the vocabulary have none."""
        doc, word, n = bags(texts, self.words)
        w = (1.0 + np.log(n)) * self.weights[word] if len(doc) else np.zeros(0)
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=len(texts)))
        some = norm[doc] > 0 if len(doc) else np.zeros(0, dtype=bool)
        return doc[some], word[some], w[some] / norm[doc[some]]

    def _index(self, sample: DataFrame) -> None:
        """Files the examples (a bounded number) and fits the map on the votes that each gets from the others."""
        examples = sorted((r[0], r[1], r[2].encode()) for r in sample.select("id", "label", "body").collect())
        ids, labels = (np.array([r[k] for r in examples], dtype=np.int64) for k in (0, 1))
        texts = [r[2] for r in examples]
        doc, word, weight = [], [], []
        for a, b in core.chunks(texts):
            d, t, w = self.vectors(texts[a:b])
            doc.append(d + a)
            word.append(t)
            weight.append(w)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
        doc, word, weight = cat(doc, np.int64), cat(word, np.int64), cat(weight, float)
        self.index = BlockMaxIndex(word, doc, weight, len(self.words), labels, ids, self.class_weight)
        per = np.array([self.class_weight[c] for c in labels.tolist()])
        bare = np.bincount(doc, minlength=len(ids)) == 0
        self.base = float(((per * labels)[bare].sum() + 0.5) / (per[bare].sum() + 1.0)) if len(ids) else 0.0
        if len(ids) and not bare.any():
            self.base = float((per * labels).sum() / per.sum())
        self.knots = np.zeros(1), np.zeros(1)
        if len(doc):
            model = sample.sparkSession.sparkContext.broadcast(self)  # bounded by max_examples

            def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                me = model.value
                for batch in batches:
                    texts, out = core.byte_list(batch.column(1)), []
                    for a, b in core.chunks(texts):
                        out += [me.index.vote(*me.index.nearest(t, w, NEIGHBOURS, without=i)) for i, (t, w) in zip(batch.column(0).to_pylist()[a:b], me.each(texts[a:b]), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.float64())], ["id", "vote"])

            own = {r[0]: r[1] for r in sample.repartition(sample.sparkSession.sparkContext.defaultParallelism).select("id", "body").mapInArrow(votes, "id long, vote double").collect()}
            some = np.flatnonzero(~bare)
            self.knots = isotonic(np.array([own[i] for i in ids[some].tolist()]), labels[some].astype(float), per[some])

    def each(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, weights) of every text of a chunk."""
        doc, word, weight = self.vectors(texts)
        edge = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield word[a:b], weight[a:b]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """Score and evidence (ids and cosines of the nearest examples) of each text."""
        score = np.full(len(texts), self.base)
        ids: list[list[int]] = []
        cosines: list[list[float]] = []
        for d, (terms, weights) in enumerate(self.each(texts)):
            found, cosine = self.index.nearest(terms, weights, NEIGHBOURS) if len(terms) else (np.zeros(0, dtype=np.int64), np.zeros(0))
            if len(found):
                score[d] = np.interp(self.index.vote(found, cosine), *self.knots)
            ids.append(self.index.ids[found].tolist())
            cosines.append(np.round(cosine, 9).tolist())
        return np.clip(score, 0.0, 1.0), ids, cosines


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """id, held_out, score in [0, 1], evidence_ids, evidence_cosines, one row per row of docs.

    Texts without a word of the examples, empty and null ones get the share of toxic examples (of those without such words,
    if there are any).  A null id is never an example; an id labelled twice is toxic if any label says so; rows with equal
    ids are scored each by its own text; examples equally near are taken by id; without labels of both classes every score
    is the share of toxic examples; an empty table gives no rows; other columns are not read.
    """
    model = Model(docs, labels, id_col, text_col, label_col, max_examples)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the words of 2 * max_examples texts
    rows = docs.select(F.col(id_col).alias("_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = core.byte_list(batch.column(2))
            scores, ids, cosines = [np.zeros(0)], [], []
            for a, b in core.chunks(texts):
                s, i, c = model.score(texts[a:b])
                scores.append(s)
                ids += i
                cosines += c
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(scores)), pa.array(ids, type=pa.list_(pa.int64())), pa.array(cosines, type=pa.list_(pa.float64()))], ["_id", "held_out", "score", "evidence_ids", "evidence_cosines"])

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(scoring, f"_id {kind}, held_out boolean, score double, evidence_ids array<long>, evidence_cosines array<double>")
    return out.withColumnRenamed("_id", id_col)


def brute_force(texts: dict[int, str | None], toxic: dict[int, int], k: int = NEIGHBOURS) -> dict[int, list[tuple[int, float]]]:
    """The k nearest examples (id, cosine) of every text by comparing it with each (small inputs, examples all taken, no two of
    equal text): words by a regular expression, weights by the formula."""
    import math
    import re
    import zlib
    from collections import Counter

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    bag = {d: Counter(pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for d, t in texts.items()}
    examples = sorted(d for d in texts if d in toxic and zlib.crc32(str(d).encode()) % 4 != 2)
    n = [sum(toxic[d] == c for d in examples) for c in (0, 1)]
    held = [Counter(w for d in examples if toxic[d] == c for w in bag[d]) for c in (0, 1)]
    df = Counter(w for b in bag.values() for w in b)

    def weight(word: str) -> float:
        a, b = held[1][word], held[0][word]
        if a + b < LEAST_EXAMPLES:
            return 0.0
        ratio = float(log_likelihood(np.array([float(a)]), np.array([float(b)]), n[1], n[0])[0])
        return (math.log((len(texts) + 1) / (df[word] + 1)) + 1) * max(ratio, 0.0) ** RELEVANCE_POWER

    vector = {}
    for d, b in bag.items():
        v = {w: (1 + math.log(c)) * weight(w) for w, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vector[d] = {w: x / norm for w, x in v.items() if x} if norm else {}
    out = {}
    for d, v in vector.items():
        near = [(e, sum(x * vector[e][w] for w, x in v.items() if w in vector[e])) for e in examples]
        out[d] = sorted(((e, c) for e, c in near if c > 0), key=lambda x: (-x[1], x[0]))[:k]
    return out
