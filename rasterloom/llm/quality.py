"""Quality classifier by importance resampling (operator 5).

Texts are cut into words and runs of punctuation, a token that repeats the one before
it is written as a repeat mark, and the hashed unigrams and bigrams of tokens make two bag-of-n-grams models: the target model from documents labelled good and the
raw model from all documents.  A document's importance weight is the ratio of its
probabilities under both, taken for a stretch of a nominal length, so that long and
short documents compare: its log is the mean log ratio of the n-grams times that
length.  Sampling k documents without replacement in proportion to the weights is a
top-k of log weight plus standard Gumbel noise, drawn from a hash of the id.  By
default k is the number of documents whose log weight is no lower than a floor; which
documents near that line are drawn is left to the noise.

Both models leave out the document that is weighed, and ratios are drawn towards 1 by
a fixed evidence: a text of rare words weighs 1, and labelled documents are no
likelier than unlabelled ones to be drawn for their own words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

BUCKETS = 1 << 16
ORDERS = (1, 2)
#: Labelled documents that make the target model: those with the smallest hash of the id.
MAX_LABELLED = 50_000
#: n-grams of the raw model mixed into the target model's counts, per bucket.
#: Occurrences of an n-gram in other documents by which its ratio is drawn towards 1.
EVIDENCE = 32.0
#: n-grams of the stretch that a weight stands for, and n-grams without evidence added to every document.
STRETCH, SHORT = 64, 8
#: Production value of floor: a mean log ratio of -0.25 an n-gram.
FLOOR = -16.0

#: Stands for a token that repeats the one before it.
REPEAT = core.U64(0x5265706561740000)

#: 1: part of a word, 2: punctuation, 0: white space.
_CLASS = np.where(core.LETTER_WORDS, 1, np.where(core.SPACE_WORDS, 2, 0)).astype(np.uint8)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word and every run of punctuation of a chunk, in order; case counts, repeats are REPEAT."""
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    kind = _CLASS[buf]
    start = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))) if len(buf) else np.zeros(0, dtype=np.int64)
    end = np.append(start[1:], len(buf))
    some = kind[start] > 0
    start, lens = start[some], (end - start)[some]
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=core.U64)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    body = buf[kind > 0]
    at = np.cumsum(lens) - lens
    values = core._BYTE_VALUES[body] * core._position_values(int(lens.max()))[np.arange(len(body)) - np.repeat(at, lens)]
    value = core.mix64(np.add.reduceat(values, at) + lens.astype(core.U64) * core.U64(core._MULT))
    again = np.flatnonzero((value[1:] == value[:-1]) & (doc[1:] == doc[:-1])) + 1
    value[again] = REPEAT
    return doc, value


def ngrams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every hashed n-gram of a chunk."""
    doc, value = tokens(texts)
    docs, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for n in ORDERS:
        grams = core.rolling(value, n)
        ok = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, dtype=bool)
        docs.append(doc[: len(grams)][ok])
        found.append((core.mix64(grams[ok] + core.U64(n)) & core.U64(buckets - 1)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found)


def _models(rows: DataFrame, good: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in all rows and in those of the target."""

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = core.byte_list(batch.column(1))
            ids = batch.column(0)
            chosen = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), good) & ids.is_valid().to_numpy(zero_copy_only=False)
            for a, b in core.chunks(texts):
                doc, bucket = ngrams(texts[a:b], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[chosen[a:b][doc]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    total = rows.select("_id", "body").mapInArrow(counting, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    counted = total.toPandas()  # one row per bucket
    at = counted["bucket"].to_numpy(dtype=np.int64)
    raw[at], target[at] = counted["raw"], counted["target"]
    return raw, target


def _log_ratio(raw, target, share: float):
    """Log ratio of the target to the raw probability; what is hardly seen in other documents says nothing (0)."""
    return np.log((target + EVIDENCE * share) / (share * (raw + EVIDENCE)))


def kth_largest(df: DataFrame, column: str, k: int, few: int = 20_000) -> float | None:
    """The k-th largest value of a column, by counting in ever narrower ranges; no more than few values reach the driver."""
    if k <= 0:
        return None
    values = df.select(F.col(column).cast("double").alias("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if n == 0:
        return None
    k = min(k, n)
    above = 0
    inside = n
    for _ in range(64):
        if inside <= few or low == high:
            break
        width = (high - low) / 512
        if not width > 0 or low + width == low:
            break
        slot = F.least(F.lit(511), F.floor((F.col("v") - low) / width)).cast("int")
        counts = {r[0]: (r[1], r[2], r[3]) for r in values.filter(F.col("v").between(low, high)).groupBy(slot.alias("s")).agg(F.count("*"), F.min("v"), F.max("v")).collect()}
        for s in sorted(counts, reverse=True):
            c, least, most = counts[s]
            if above + c >= k:
                low, high, inside = least, most, c
                break
            above += c
    if low == high:
        return float(low)
    held = sorted((r[0] for r in values.filter(F.col("v").between(low, high)).collect()), reverse=True)
    return float(held[k - above - 1])


def _gumbel(key: Column) -> Column:
    """Standard Gumbel noise from a hash."""
    u = (F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality", k: int | None = None, temperature: float = 1.0, max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS, floor: float = 0.0) -> DataFrame:
    """The documents with their importance weights and whether they are in the sample of k.

    Returns the columns of docs with log_weight, n_grams, key (log weight + temperature * Gumbel noise) and kept.  k
    None: as many as have a log weight of floor at least.  Texts of any length are read whole.  Null and empty texts have log weight 0; documents with equal keys at
    the edge of the sample are all kept; a null id draws one fixed noise; rows with equal ids draw equal noise; an id
    labelled twice counts as good if any label says so; without labels or documents every log weight is 0.  Columns of
    docs that have one of the added names are replaced.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    good = labels.filter(F.col(good_col) == 1).select(F.col(id_col).cast("long").alias("i")).dropna().distinct().orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    ids = np.array([r[0] for r in good.collect()], dtype=np.int64)
    raw, target = _models(rows, ids, buckets)
    share = float(target.sum() / raw.sum()) if target.any() else 0.0
    names = [c for c in docs.columns if c not in ("log_weight", "n_grams", "key", "kept")]

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = core.byte_list(batch.column(batch.schema.get_field_index("_body")))
            own_id = batch.column(batch.schema.get_field_index("_id"))
            chosen = np.isin(own_id.fill_null(0).to_numpy(zero_copy_only=False), ids) & own_id.is_valid().to_numpy(zero_copy_only=False)
            weight, n = [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
            for a, b in core.chunks(texts):
                doc, bucket = ngrams(texts[a:b], buckets)
                n.append(np.bincount(doc, minlength=b - a))
                if not share:
                    weight.append(np.zeros(b - a))
                    continue
                seen, times = np.unique(doc * buckets + bucket, return_counts=True)  # a document's own n-grams are no evidence for it
                doc, bucket = seen // buckets, seen % buckets
                ratio = _log_ratio(raw[bucket] - times, target[bucket] - times * chosen[a:b][doc], share)
                weight.append(STRETCH * np.bincount(doc, weights=times * ratio, minlength=b - a) / (n[-1] + SHORT))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(np.concatenate(weight)), pa.array(np.concatenate(n).astype(np.int64))], [*names, "log_weight", "n_grams"])

    base = docs.select(*names, F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_body"))
    schema = base.drop("_body", "_id").schema.add("log_weight", "double").add("n_grams", "long")
    scored = base.mapInArrow(scoring, schema).withColumn("log_weight", F.round("log_weight", 9))
    keyed = scored.withColumn("key", F.round(F.col("log_weight") + temperature * _gumbel(F.coalesce(F.col(id_col).cast("long"), F.lit(-1))), 9))
    slim = core.checkpointed(keyed.select("key", "log_weight"))
    most = k if k is not None else slim.filter(F.col("log_weight") >= floor).count()
    cut = kth_largest(slim, "key", most)
    return keyed.withColumn("kept", F.lit(False) if cut is None else F.col("key") >= F.lit(cut))


def brute_force(texts: dict[int, str | None], good: set[int], buckets: int = BUCKETS) -> dict[int, float]:
    """Log weights: tokens by a regular expression, one n-gram at a time (small inputs)."""
    import re
    from collections import Counter

    pattern = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")
    grams = {}
    for d, t in texts.items():
        token = [core.hash_word(w) for w in pattern.findall((t or "").encode())]
        token = [int(REPEAT) if i and token[i - 1] == x else x for i, x in enumerate(token)]
        runs = [(core.rolling_one(token[i : i + n]) + n) & core.MASK64 for n in ORDERS for i in range(len(token) - n + 1)]
        grams[d] = [int(core.mix64(np.array([x], dtype=core.U64))[0]) % buckets for x in runs]
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if d in good:
            target.update(g)
    share = sum(target.values()) / max(1, sum(raw.values()))
    out = {}
    for d, g in grams.items():
        own = Counter(g)
        others = lambda x: (raw[x] - own[x], target[x] - (own[x] if d in good else 0))  # noqa: B023, E731
        out[d] = STRETCH * sum(math.log((t + EVIDENCE * share) / (share * (r + EVIDENCE))) for r, t in map(others, g)) / (len(g) + SHORT) if share else 0.0
    return out
