"""Op 8: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftlake.llm.common import bounded_batches, chunks, released

#: Hash buckets of an n-gram for up to MANY languages; beyond, they become fewer, so that the matrix that is broadcast keeps its bound of 50 MB.
BUCKETS, MANY, FEWEST = 1 << 16, 64, 1 << 6
ORDERS = (1, 2, 3)
#: Where between letters at random (0) and the language itself (1) a text's n-grams must lie to be known.
KNOWN = 0.5
#: Characters whose scores are held at once, for each language.
AT_ONCE = 1 << 16
_WEIGHTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    return _fold[0]


def bucket_count(languages: int) -> int:
    """Buckets of each order: fewer for many languages."""
    return max(FEWEST, BUCKETS >> max(0, (max(languages, 1) - 1).bit_length() - MANY.bit_length() + 1))


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each order that start at each kept character, rows' ends among those, and whether a row has a letter.

    Case is folded, runs of other characters become one space, and every row is closed by a space.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    ends = np.r_[0, np.cumsum(lead)][offsets]
    if len(points) != ends[-1]:  # not valid UTF-8: decode row by row
        rows = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(offsets) - 1)]
        ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    letters = _folded()[points]
    space = letters == 32
    keep = np.ones(len(letters), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = ends[:-1][ends[:-1] < len(letters)]
    keep[starts] = ~space[starts]
    upto = np.r_[0, np.cumsum(keep)][ends]
    letters = letters[keep]
    rows = len(upto) - 1
    row = np.repeat(np.arange(rows), np.diff(upto))
    out = []
    total = np.zeros(len(letters), np.uint32)
    for k, _ in enumerate(ORDERS):
        nxt = np.full(len(letters), 32, np.uint32)
        nxt[: len(letters) - k] = letters[k:]
        if k:
            nxt[:-k] = np.where(row[k:] == row[:-k], nxt[:-k], 32)
        total = total + nxt * _WEIGHTS[k]
        h = total ^ np.uint32((k + 1) * 0x27D4EB2F & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(((h ^ (h >> np.uint32(13))) & np.uint32(buckets - 1)).astype(np.int64))
    has = np.add.reduceat(np.r_[letters != 32, False].astype(np.int64), np.minimum(upto[:-1], len(letters))) > 0 if rows else np.zeros(0, bool)
    return out, upto, has & (np.diff(upto) > 0)


def in_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(rows: DataFrame, per_language: int = 2000, smooth: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities; its last row holds the log priors.

    rows(key, text, lang): priors come from all rows with a language; n-gram counts from whole texts of
    about per_language rows of each language (all if it has fewer), drawn by a hash of key. That bound
    is the only one, and is a parameter.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.where("lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    buckets = bucket_count(len(langs))
    if not langs:
        return [], np.zeros((buckets * len(ORDERS) + 1, 0), np.float32)
    spark = rows.sparkSession
    rates = spark.createDataFrame([(x, min(1.0, per_language / sizes[x])) for x in langs], "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(rates), "lang").where(draw < F.col("rate")).select("lang", "text").repartition(16)

    def count(batches):
        total = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, data, offsets in chunks(batch.column(1)):
                grams, upto, _ = ngrams(data, offsets, buckets)
                own = names[row : row + len(upto) - 1]
                which = np.repeat([langs.index(x) for x in own], np.diff(upto))
                for code in set(own):
                    at = which == langs.index(code)
                    v = total.setdefault(code, np.zeros((len(ORDERS), buckets), np.int64))
                    for k, g in enumerate(grams):
                        v[k] += np.bincount(g[at], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "counts"])

    def add(batches):
        total = {}
        for batch in batches:
            for code, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[code] = total.get(code, 0) + np.frombuffer(v, np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "counts"])

    counts = np.zeros((buckets * len(ORDERS), len(langs)))
    schema = "lang string, counts binary"
    for code, v in drawn.mapInArrow(released(count), schema).repartition(4, "lang").mapInArrow(released(add), schema).collect():
        counts[:, langs.index(code)] += np.frombuffer(v, np.int64)
    logs = []
    for k in range(len(ORDERS)):
        part = counts[k * buckets : (k + 1) * buckets] + smooth
        logs.append(np.log(part / part.sum(0)))
    prior = np.log(np.array([sizes[x] for x in langs], float) / sum(sizes.values()))
    return langs, np.vstack([*logs, prior[None]]).astype(np.float32)


def expected(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each language the mean log probability of a pair and a triple of letters (summed) that are its own, and of such at random."""
    buckets = (len(matrix) - 1) // len(ORDERS)
    own, random = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1])
    for k in range(1, len(ORDERS)):
        part = matrix[k * buckets : (k + 1) * buckets].astype(np.float64)
        own += (np.exp(part) * part).sum(0)
        random += part.mean(0)
    return own, random


def predict(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", out: tuple[str, ...] = ("lang_pred", "score"), keep: bool = False) -> DataFrame:
    """rows with two columns added, lang_pred and score unless out names them; the text column is used up unless it is to be kept. With a third name in out also its fit.

    lang_pred is a learned language, `und` where the text is null or has no letter (or nothing was
    learned; score 0). Of languages that are equally probable it is the first in order. score is the posterior probability of the prediction, fit how its pairs and triples of letters lie on average
    between those at random (0) and the language's own (1). The whole text counts.
    """
    langs, matrix = model
    buckets, (own_mean, random_mean) = (len(matrix) - 1) // len(ORDERS), expected(matrix)
    fitting = len(out) > 2
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = rows.columns

    def score(batches):
        langs, matrix = shared.value
        for batch in batches:
            text_at = place if keep else batch.num_columns - 1
            preds, scores, fits = [], [], []
            for _, data, offsets in chunks(batch.column(text_at)):
                grams, upto, has = ngrams(data, offsets, buckets)
                n = len(upto) - 1
                if not langs:
                    preds += ["und"] * n
                    scores += [0.0] * n
                    fits += [0.0] * n
                    continue
                total, single = np.zeros((n, len(langs))), np.zeros((n, len(langs)))
                filled = np.flatnonzero(np.diff(upto) > 0)
                if len(filled):
                    for at in range(0, len(grams[0]), AT_ONCE):  # a long text is summed piece by piece
                        sums = np.zeros((min(AT_ONCE, len(grams[0]) - at), len(langs)), np.float32)
                        here = filled[(upto[:-1][filled] < at + len(sums)) & (upto[1:][filled] > at)]
                        begins = np.maximum(upto[:-1][here] - at, 0)
                        for k, g in enumerate(grams):
                            sums += np.take(matrix, g[at : at + AT_ONCE] + k * buckets, axis=0)
                            if fitting and k == 0:
                                single[here] += np.add.reduceat(sums, begins, axis=0, dtype=np.float64)
                        total[here] += np.add.reduceat(sums, begins, axis=0, dtype=np.float64)
                more = total - single
                total += matrix[-1]
                best = total.argmax(1)
                if fitting:
                    mean = more[np.arange(n), best] / np.maximum(np.diff(upto), 1)
                    fits += np.where(has, (mean - random_mean[best]) / np.maximum(own_mean[best] - random_mean[best], 1e-9), 0.0).tolist()
                top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                preds += [langs[b] if ok else "und" for b, ok in zip(best, has, strict=True)]
                scores += np.where(has, top, 0.0).tolist()
            rest = [batch.column(i) for i in range(batch.num_columns) if keep or i != text_at]
            made = [pa.array(preds, pa.string()), pa.array(scores, pa.float64())] + ([pa.array(fits, pa.float64())] if fitting else [])
            yield pa.RecordBatch.from_arrays([*rest, *made], [f"c{i}" for i in range(len(rest))] + ["lang_pred", "score", "fit"][: len(made)])

    place = names.index(text)
    kept = [c for c in names if keep or c != text]
    # plain names inside, so that columns of any name pass through
    inner = rows.select(*[F.col(f"`{c}`") for c in kept], *([] if keep else [F.col(f"`{text}`")]))
    schema = T.StructType([T.StructField(f"c{i}", inner.schema[i].dataType) for i in range(len(kept))] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())][: len(out)])
    return inner.mapInArrow(released(score), schema).toDF(*kept, *out)


def identify(docs: DataFrame, per_language: int = 2000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang, ...).

    Learns from rows with a language whose crc32(doc_id) mod 4 is not 2; a null doc_id is neither held
    out nor learned from. Repeated rows give repeated results; an empty table gives none.
    """
    rows = docs.select("doc_id", "text", "lang", in_held_out().alias("held_out"))
    model = train(rows.where("not held_out and doc_id is not null").select(F.col("doc_id").cast("string").alias("key"), "text", "lang"), per_language)
    return predict(rows.select("doc_id", "held_out", "text"), model)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; see identify for nulls, texts without letters and repeated rows."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an identifiable language go; the others stay as they are.

    A language is identified if its posterior is at least 0.5 and the text's pairs and triples of letters are on average nearer to the language's own than to random ones (KNOWN); so
    strings of letters that no language has go, however sure the posterior is. Null and empty texts and such without a letter have none and go; repeated rows stay or go together; an empty table stays empty.
    """
    rows = docs.select("doc_id", "text", "lang", in_held_out().alias("held_out"))
    model = train(rows.where("not held_out and doc_id is not null").select(F.col("doc_id").cast("string").alias("key"), "text", "lang"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # apart from the names that are used here
    judged = predict(plain, model, f"c{names.index('text')}", ("lang", "score", "fit"), keep=True)
    return judged.where(f"lang <> 'und' and score >= 0.5 and fit >= {KNOWN}").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
