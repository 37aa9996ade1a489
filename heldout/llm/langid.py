"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of (language, n-gram bucket) are summed per task and then over tasks, from all
labelled rows that are given. The matrix of log probabilities (languages x buckets)
is broadcast; a batch of texts is scored as a sparse matrix with one row per text:
the n-gram buckets of the whole batch lie in one array and are summed row by row.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .shared import slices

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
SMOOTH = 0.5                    # added to every count
UNKNOWN = "und"
CHUNK = 1 << 19
#: Clear texts: labelled texts that the centres and the variances of all languages together weigh as, spreads below a centre, share of the usual lead, variances of an n-gram's figures and, at least, of texts.
POOLED_TEXTS, POOLED_SPREADS, SPREADS, SHARE, GRAM_VARIANCE, LEAST_VARIANCE = 8, 100, 5, 0.4, 12.0, 0.04
MULTIPLY = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def pieces(texts: list[str]):
    """Blocks (first text, texts, code points, ends) of about CHUNK code points; a long text is a block of its own."""
    i = 0
    while i < len(texts):
        j, parts, n = i, [], 0
        while j < len(texts) and (j == i or n + len(texts[j]) < CHUNK):
            parts.append(f" {texts[j].lower()} ")
            n += len(parts[-1])
            j += 1
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield i, j, points, np.cumsum([len(p) for p in parts])
        i = j


def buckets(points: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place."""
    n = max(len(points) - size + 1, 0)
    h = np.full(n, 0x811C9DC5 + size, np.uint32)
    for k in range(size):
        h = (h ^ points[k:k + n]) * np.uint32(MULTIPLY[k])
        h ^= h >> np.uint32(15)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64)


def _count(batches):
    codes: dict[str, int] = {}
    counts = np.zeros((0, BUCKETS), np.int64)
    for batch in slices(batches):
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        kept = [i for i, t in enumerate(texts) if has_letter(t)]
        own = np.array([codes.setdefault(langs[i], len(codes)) for i in kept], np.int64)
        if len(codes) > len(counts):
            counts = np.vstack([counts, np.zeros((len(codes) - len(counts), BUCKETS), np.int64)])
        for i, j, points, ends in pieces([texts[i] for i in kept]):
            owner = np.repeat(own[i:j], np.diff(ends, prepend=0))
            for size in SIZES:
                h = buckets(points, size)
                inside = np.ones(len(h), bool)
                for back in range(1, size):                 # n-grams that would run into the next text
                    inside[(ends - back)[ends - back < len(h)]] = False
                counts += np.bincount((owner[:len(h)] * BUCKETS + h)[inside], minlength=counts.size).reshape(counts.shape)
    for lang, code in codes.items():
        used = np.flatnonzero(counts[code])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[code][used])], ["lang", "bucket", "n"])


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities [bucket, language] from rows (text, lang); null labels are left out.

    The driver receives at most languages x BUCKETS counts.
    """
    counts = rows.select("text", "lang").where("lang is not null").mapInArrow(_count, "lang string, bucket int, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(table["lang"].unique())
    matrix = np.full((BUCKETS, len(languages)), SMOOTH)
    for k, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        matrix[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return languages, np.log(matrix / matrix.sum(0)).astype(np.float32) if languages else matrix.astype(np.float32)


def score(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log likelihood of each text under each language."""
    out = np.zeros((len(texts), matrix.shape[1]))
    columns = [np.ascontiguousarray(matrix[:, k]) for k in range(matrix.shape[1])]
    for i, j, points, ends in pieces(texts):
        starts = np.concatenate(([0], ends[:-1]))
        for size in SIZES:
            h = buckets(points, size)
            edges = np.stack([starts, np.maximum(ends - size + 1, starts)], 1)
            some = edges[:, 1] > edges[:, 0]
            if not some.any():
                continue
            cuts = edges[some].ravel()
            cuts = cuts[:-1] if cuts[-1] >= len(h) else cuts
            for k, column in enumerate(columns):
                out[i:j, k][some] += np.add.reduceat(column[h], cuts, dtype=np.float64)[::2]
    return out


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, names: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = True) -> DataFrame:
    """Adds the language and its posterior (even priors) to ``docs``, which holds text; ``names`` must be free.

    A text that is null or has no letters is ``und`` with score 0, as is every text if
    nothing was learned. Ties go to the first language in order. Other columns pass
    through as they are. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast((languages, matrix))
    columns = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches):
        known_names, m = model.value
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            known = [i for i, t in enumerate(texts) if known_names and has_letter(t)]
            lang, value = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                s = score([texts[i] for i in known], m)
                best = s.argmax(1)
                value[known] = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                for r, i in enumerate(known):
                    lang[i] = known_names[best[r]]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(value)], [*(f.name for f in columns), *names])

    return docs.mapInArrow(run, StructType([*columns]).add(names[0], StringType()).add(names[1], DoubleType()))


def figures(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its mean log likelihood per n-gram, its lead over the next per n-gram, and the number of n-grams of each text."""
    s = score(texts, matrix)
    n = np.array([sum(max(len(t.lower()) + 3 - size, 0) for size in SIZES) for t in texts], np.int64)
    best, order = s.argmax(1), np.sort(s, 1)
    lead = order[:, -1] - order[:, -2] if s.shape[1] > 1 else np.full(len(texts), np.inf)
    return best, order[:, -1] / n, lead / n, n


def limits(rows: DataFrame, languages: list[str], matrix: np.ndarray) -> dict[int, tuple]:
    """What clear texts of a language look like: place of the language -> centre and variance of mean and lead.

    ``rows`` (text, lang) are labelled texts that were not learned from; those told right
    count. Centres and spreads are robust, so single wrong labels move nothing. The
    driver receives a row per language and power of two of length. A language's figures
    are drawn towards those of all languages, which weigh as POOLED_TEXTS texts (in
    variances, which few texts tell badly, POOLED_SPREADS), so every learned
    language has limits; only without any such text there are none.
    """
    model = rows.sparkSession.sparkContext.broadcast((languages, matrix))

    def run(batches):
        names, m = model.value
        for batch in slices(batches):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t) and langs[i] in names]
            if known:
                best, mean, lead, n = figures([texts[i] for i in known], m)
                right = np.array([names[b] == langs[i] for b, i in zip(best, known)])
                yield pa.RecordBatch.from_arrays([pa.array(best[right].astype(np.int32)), pa.array(mean[right]), pa.array(lead[right]), pa.array(n[right])], ["code", "mean", "lead", "n"])

    told = rows.select("text", "lang").where("lang is not null").mapInArrow(run, "code int, mean double, lead double, n long")
    told = told.groupBy("code", F.floor(F.log2("n")).alias("size")).agg(F.count(F.lit(1)).alias("texts"), F.avg("n").alias("n"), *[F.percentile_approx(c, [0.25, 0.5]).alias(c) for c in ("mean", "lead")])
    found = told.collect()
    fits: dict[int, list] = {}
    texts = {code: float(sum(r.texts for r in found if r.code == code)) for code in {r.code for r in found}}
    for code in texts:
        own = [r for r in found if r.code == code]
        weight, n = np.array([r.texts for r in own], float), np.array([r.n for r in own])
        for name in ("mean", "lead"):
            low, mid = np.array([r[name] for r in own], float).T
            # the centre is a median; longer texts, whose figures vary less, weigh more
            order = np.argsort(mid)
            share = np.cumsum((weight * np.sqrt(n))[order])
            centre = mid[order][np.searchsorted(share, 0.5 * share[-1])]
            spread = ((centre - np.minimum(low, mid)).clip(0) / 0.6745) ** 2
            fits.setdefault(code, []).append((float(centre), float(np.average(spread, weights=weight * n))))
    return shrunk(fits, texts, len(languages))


def shrunk(fits: dict[int, list], texts: dict[int, float], n_languages: int) -> dict[int, tuple]:
    """Limits of every language: its (centre, variance) of mean and lead, mixed with those of all languages by number of texts."""
    if not fits:
        return {}
    weight = np.array([texts[c] for c in fits])
    centres, spreads = (np.array([[f[k] for f in fits[c]] for c in fits]) for k in (0, 1))
    middle = np.average(centres, axis=0, weights=weight)
    spread = np.average(spreads + (centres - middle) ** 2, axis=0, weights=weight)
    out = {}
    for code in range(n_languages):
        n = texts.get(code, 0.0)
        w, x = n / (n + POOLED_TEXTS), n / (n + POOLED_SPREADS)
        own = fits.get(code, [(m, v) for m, v in zip(middle, spread)])
        out[code] = tuple((float(w * c + (1 - w) * m), float(max(x * v + (1 - x) * s + w * (1 - w) * (c - m) ** 2, LEAST_VARIANCE))) for (c, v), m, s in zip(own, middle, spread))
    return out


def clear(docs: DataFrame, languages: list[str], matrix: np.ndarray, bounds: dict[int, tuple]) -> DataFrame:
    """The rows of ``docs`` whose text has letters and is like those of its language, by n-gram and for its length.

    The mean log likelihood may lie SPREADS spreads under the centre of the language,
    and the lead over the next language must be SHARE of the usual one; short texts vary
    more and may have less. Without any bounds all texts with letters stay.
    """
    model = docs.sparkSession.sparkContext.broadcast((matrix, bounds))

    def run(batches):
        m, by_code = model.value
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            stays = np.zeros(len(texts), bool)
            if known:
                for i, code, mean, lead, n in zip(known, *figures([texts[i] for i in known], m)):
                    if code not in by_code:
                        stays[i] = True
                        continue
                    (mid, v), (usual, _) = by_code[code]
                    stays[i] = mean >= mid - SPREADS * np.sqrt(v + GRAM_VARIANCE / n) and lead >= min(SHARE * usual, usual - SPREADS * np.sqrt(GRAM_VARIANCE / n))
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    """crc32 of the id as text, modulo 3, is 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of all labelled rows that are not held out."""
    return train(docs.where(~held_out(F.col("doc_id"))))
