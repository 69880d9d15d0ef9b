"""Language by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of hashed runs of one to three letters
(words apart, in lower case). Each language has a few centroids, found by
spherical k-means over a bounded sample of its texts, so that a language with
several kinds of text is not averaged into one point. The nearest centroid by
cosine decides; a text farther from it than nearly all texts it was made of is
marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltrend.llm.common import map_rows, texts

BUCKETS = 1 << 14
#: Texts of each language that a fit may use.
SAMPLE = 800
#: Languages that a model may hold.
LANGUAGES = 1000
CENTROIDS, TURNS = 4, 8
#: Share of a centroid's own texts that lie beyond its radius, and some leeway.
BEYOND, LEEWAY = 0.005, 0.9
#: Code points counted at once.
STRIDE = 1 << 16
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def term_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the letter runs of a whole text; empty if it has no letter."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A gap of any length is one blank, so runs see where words begin and end.
    keep = letter | np.r_[False, letter[:-1]]
    line = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64)
    line = np.r_[np.uint64(32), line, np.uint64(32)]
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(line), STRIDE):
        part = line[start : start + STRIDE + 2]
        runs = part + np.uint64(1)
        for size in (1, 2, 3):
            if size > 1:
                runs = runs[: len(part) - size + 1] * np.uint64(0x110003) + part[size - 1 :] + np.uint64(size)
            own = runs[: min(STRIDE, len(runs))]
            hashed = (own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
            counts += np.bincount(hashed.astype(np.int64), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


@dataclass
class Centroids:
    languages: list[str]
    owners: np.ndarray  # language of each centroid
    matrix: np.ndarray  # bucket by centroid, columns of length 1, times idf
    radii: np.ndarray  # least cosine of each centroid
    idf: np.ndarray

    def nearest(self, text: bytes) -> tuple[str, float, bool]:
        used, counts = term_counts(text)
        if not len(used) or not self.languages:
            return UNKNOWN, 0.0, True
        weights = 1 + np.log(counts)
        length = float(np.sqrt(((weights * self.idf[used]) ** 2).sum()))
        cosines = weights.astype(np.float32) @ self.matrix[used] / length
        at = int(cosines.argmax())
        return self.languages[self.owners[at]], float(min(1.0, max(0.0, cosines[at]))), bool(cosines[at] < self.radii[at])


def _clustered(vectors: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and the centroid of each vector."""
    # Far apart to begin with: each next one is least like those before.
    picked = [0]
    near = vectors @ vectors[0]
    while len(picked) < min(number, len(vectors)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[picked[-1]])
    centres = vectors[picked]
    for _ in range(TURNS):
        own = (vectors @ centres.T).argmax(axis=1)
        for k in np.unique(own):
            total = vectors[own == k].sum(axis=0)
            centres[k] = total / max(1e-12, np.linalg.norm(total))
    own = (vectors @ centres.T).argmax(axis=1)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


def _counted(rows: Iterator[tuple]) -> Iterator[tuple]:
    for _, text, lang in rows:
        used, counts = term_counts(text)
        if len(used):
            yield lang, used.tolist(), counts.tolist()


def fit_language(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> Centroids:
    """Centroids of the languages in ``docs``, from about ``sample`` texts of each, chosen by a hash of id and text.

    Null languages, null texts and texts without a letter teach nothing. With
    nothing to learn from, an empty table included, every text is unknown. Rows
    that repeat teach each, or none of them does. More than ``LANGUAGES``
    languages raise.
    """
    known = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    totals = known.groupBy(F.col(lang_column).alias("lang")).agg(F.count("*").alias("n"))
    rows = known.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("binary").alias("text"), F.col(lang_column).alias("lang"))
    # One row per language; their shares go into the filter, so that the sample
    # is cut where the texts are read and none of them is moved.
    shares = {row["lang"]: 1_000_000 * sample / row["n"] for row in totals.limit(LANGUAGES + 1).collect()}
    if len(shares) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: is {lang_column} the right column?")
    share = F.create_map(*(F.lit(part) for item in shares.items() for part in item)) if shares else F.create_map(F.lit(""), F.lit(0.0))
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")]
    out = pa.schema([("lang", pa.string()), ("used", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    found = map_rows(rows.where(chosen).select("doc_id", "text", "lang"), _counted, "lang string, used array<int>, counts array<int>", out, 200)
    by_language: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = found.toArrow()
    for lang, used, counts in zip(held["lang"], held["used"], held["counts"]):
        by_language.setdefault(lang.as_py(), []).append((used.values.to_numpy(), counts.values.to_numpy()))
    del held
    languages = sorted(by_language)
    df, n = np.zeros(BUCKETS), sum(map(len, by_language.values()))
    for own in by_language.values():
        for used, _ in own:
            df[used] += 1
    idf = np.log((1 + n) / (1 + df)) + 1
    owners, centres, radii = [], [], []
    for k, lang in enumerate(languages):
        # The rows came in no certain order; their content gives one.
        own = sorted(by_language[lang], key=lambda row: (len(row[0]), row[0].tobytes(), row[1].tobytes()))
        vectors = np.zeros((len(own), BUCKETS), np.float32)
        for row, (used, counts) in zip(vectors, own):
            row[used] = (1 + np.log(counts)) * idf[used]
            row /= np.linalg.norm(row)
        found_, member = _clustered(vectors, CENTROIDS)
        for c, centre in enumerate(found_):
            near = vectors[member == c] @ centre
            owners.append(k)
            centres.append(centre * idf)
            radii.append(LEEWAY * float(np.quantile(near, BEYOND)))
    matrix = np.array(centres, np.float32).T if centres else np.zeros((BUCKETS, 0), np.float32)
    return Centroids(languages, np.array(owners, np.int64), np.ascontiguousarray(matrix), np.array(radii), idf)


def predict_language(docs: DataFrame, model: Centroids, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` for each row.

    A null text and one without a letter are ``und``, with score 0 and rejected.
    Every other text gets the nearest language; ``rejected`` tells that it lies
    beyond that centroid's radius. Further columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, *held.value.nearest(text)

    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    return map_rows(texts(docs, id_column, text_column), predict, "doc_id long, lang_pred string, score double, rejected boolean", out)
