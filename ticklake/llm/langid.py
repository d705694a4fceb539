"""Language identification as inference in a mixture of languages.

Training counts hashed 4-byte n-grams of the lower-cased text per language,
over every labelled document of the training fold, and gives smoothed
log-likelihoods.  A document is cut into units of 32 n-grams; expectation-
maximisation estimates which share of its units each language wrote.  The
language set is chosen by penalised likelihood among the nested sets of the
languages with the largest shares: each further language must earn
``penalty * log(units + 1)``.  The prediction is the language with the
largest share in the chosen set, the score that share.

The model is ``buckets`` numbers per language, summed by Spark and sent to
the workers; its size depends on the number of languages, not of documents.
``lang``, ``source`` and ``doc_id`` are never inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake.llm.common import bounded_batches, doc_chunks, texts_of

BITS = 14
UNIT = 32
CHUNK = 1 << 19
MAX_LANGUAGES = 1000


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: CRC-32 of the id's text is a multiple of 5.  Null ids: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _padded(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(column, ""))
    edge = pa.scalar("  ", pa.large_string())
    return pc.binary_join_element_wise(edge, pc.cast(low, pa.large_string()), edge, pa.scalar("", pa.large_string()))


def _grams(data: np.ndarray) -> np.ndarray:
    """Bucket of the 4 bytes that start at each position."""
    x = data.astype(np.uint32)
    code = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return code >> np.uint32(32 - BITS)


class Model:
    """Log-likelihoods ``table`` (languages, buckets), language names and shares of the training documents."""

    def __init__(self, names: list[str], counts: np.ndarray, docs: np.ndarray, smooth: float = 0.5):
        self.names = names
        total = counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1] if len(names) else counts
        self.table = np.log((counts + smooth) / total).astype(np.float32) if len(names) else counts.astype(np.float32)
        self.prior = docs / max(docs.sum(), 1)


def fit(docs: DataFrame) -> Model:
    """Counts the training fold (labelled rows that are not held out; null texts say nothing)."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for b in batches:
            lang = b.column("lang").to_pylist()
            data, offsets = texts_of(_padded(b.column("text")))
            for i, j in doc_chunks(offsets, CHUNK):
                gram = _grams(data[offsets[i]:offsets[j]])
                at = offsets[i:j + 1] - offsets[i]
                for k in range(j - i):
                    name = lang[i + k]
                    if name not in counts:
                        counts[name] = np.zeros(1 << BITS, np.int64)
                    counts[name] += np.bincount(gram[at[k]:at[k + 1] - 3], minlength=1 << BITS)
                    number[name] = number.get(name, 0) + 1
        for name, c in counts.items():
            hit = np.flatnonzero(c)
            bucket = np.append(hit, -1)  # -1: documents
            yield pa.record_batch(
                [pa.array([name] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(np.append(c[hit], number[name]), pa.int64())],
                names=["lang", "bucket", "n"])

    found = bounded_batches(rows).select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = found.toArrow()  # at most (buckets + 1) rows a language
    lang = found.column("lang").to_pylist()
    names = sorted(set(lang))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages: more than {MAX_LANGUAGES}, the model would not fit a task")
    at = {n: i for i, n in enumerate(names)}
    row = np.array([at[n] for n in lang], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts, number = np.zeros((len(names), 1 << BITS)), np.zeros(len(names))
    doc = bucket < 0
    counts[row[~doc], bucket[~doc]] = n[~doc]
    number[row[doc]] = n[doc]
    return Model(names, counts, number)


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after ``rounds`` of EM and each document's log-likelihood (up to a constant per unit)."""
    units = np.diff(np.append(first, len(doc)))[:, None]
    for _ in range(rounds):
        w = like * share[doc]
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(w, first, axis=0) / units
    total = np.add.reduceat(np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300)), first)
    return share, total


def infer(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float = 1.0, rounds: int = 8) -> np.ndarray:
    """Shares (documents, languages) of the chosen language sets for padded texts."""
    k = len(model.names)
    out = []
    for i, j in doc_chunks(offsets, CHUNK):
        gram = _grams(data[offsets[i]:offsets[j]])
        at = offsets[i:j + 1] - offsets[i]
        n = np.diff(at) - 3  # n-grams of each document
        units = -(-n // UNIT)
        doc = np.repeat(np.arange(j - i), units)
        first = np.cumsum(units) - units
        begin = at[doc] + (np.arange(len(doc)) - first[doc]) * UNIT
        stop = np.minimum(begin + UNIT, at[doc] + n[doc])
        bound = np.stack([begin, stop], axis=1).ravel()
        bound[-1] = min(bound[-1], len(gram))
        ll = np.empty((len(doc), k))
        for lang in range(k):
            each = model.table[lang][gram]
            pad = np.append(each, np.float32(0))
            ll[:, lang] = np.add.reduceat(pad, bound)[::2]
        like = np.exp(ll - ll.max(axis=1, keepdims=True))
        base = np.tile((model.prior + 1e-3) / (model.prior + 1e-3).sum(), (j - i, 1))
        share, _ = _em(like, doc, first, base, rounds)
        order = np.argsort(-share, axis=1, kind="stable")
        best, score = None, None
        for m in range(1, k + 1):
            inside = np.zeros(share.shape, bool)
            np.put_along_axis(inside, order[:, :m], True, axis=1)
            start = np.where(inside, np.maximum(share, 1e-3), 0)
            got, total = _em(like, doc, first, start / start.sum(axis=1, keepdims=True), rounds if m > 1 else 0)
            total = total - penalty * m * np.log(units + 1.0)
            if best is None:
                best, score = got, total
            else:
                better = total > score
                best[better], score[better] = got[better], total[better]
        out.append(best)
    return np.concatenate(out) if out else np.zeros((0, k))


def predict(docs: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row (after the table's own columns if asked).

    ``und`` with score 0 for null texts and texts without a letter, and for
    all rows when nothing could be learned.
    """
    names = np.array([*model.names, "und"], dtype=object)

    def run(batches):
        for b in batches:
            text = b.column("text")
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pred, score = np.full(b.num_rows, len(model.names)), np.zeros(b.num_rows)
            hit = np.flatnonzero(letter)
            if len(hit) and model.names:
                share = infer(model, *texts_of(_padded(text.take(pa.array(hit)))))
                pred[hit] = share.argmax(axis=1)
                score[hit] = np.clip(share.max(axis=1), 0, 1)
            cols = list(b.columns) if keep_columns else [b.column("doc_id"), b.column("held_out")]
            yield pa.record_batch(
                [*cols, pa.array(names[pred].tolist(), pa.string()), pa.array(score, pa.float64())],
                names=[*(b.schema.names if keep_columns else ["doc_id", "held_out"]), "lang_pred", "score"])

    if keep_columns:
        src = docs.withColumn("text", docs["text"].cast("string")).withColumn("held_out", held_out(F.col("doc_id")))
    else:
        src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), held_out(docs["doc_id"]).alias("held_out"))
    kept = src.dtypes if keep_columns else [("doc_id", "bigint"), ("held_out", "boolean")]
    return bounded_batches(src).mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in kept) + ", lang_pred string, score double")
