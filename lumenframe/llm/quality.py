"""Quality classifier: regularised quadratic discriminant over document statistics.

Three classes (good, low, toxic) are fitted on a bounded sample of labelled
documents. Each document becomes a vector of transformed statistics (log
lengths, logits of smoothed character and line fractions, and log counts of
words that lean to a class). Class covariances are shrunk towards the pooled
covariance and a diagonal; a document's score in a class is its log density,
from the Mahalanobis distance by the class's cached Cholesky factor, plus the
log prior. A document is kept if ``good`` scores highest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common as C

CLASSES = ("good", "low", "toxic")
#: At most so many labelled documents, the least by hash of doc_id, are fitted on.
MAX_LABELLED = 20_000
#: The labelled documents of each of these parts are described with words that lean in the others, as new documents are with words of none of their own.
FOLDS = 4
#: Weight of the pooled covariance, and of the diagonal, in each class's covariance.
TO_POOLED, TO_DIAGONAL = 0.15, 0.05
#: A word leans to a class if it is in at least so many of its sampled documents, and so many times likelier there.
LEAN_DOCS, LEAN_RATIO = 5, 8.0
#: Usual parts of characters; a short text's parts are drawn to them with the weight of so many characters.
USUAL = {"lower": 0.76, "upper": 0.03, "digit": 0.005, "space": 0.16, "stop": 0.03, "bang": 0.002, "mark": 0.003, "high": 0.02}
USUAL_CHARS = 30
#: Standardised statistics beyond this are taken as this.
FARTHEST = 5.0

_KINDS = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "stop": b".,;:'-", "bang": b"!?", "mark": b"#$%&*@^~|_=+<>/\\{}[]()\"`", "high": range(128, 256)}
_LUT = {k: np.isin(np.arange(256), list(v)).astype(np.float32) for k, v in _KINDS.items()}
NAMES = ["chars", "words", "word_chars", "word_spread", "lines", *(f"{k}_part" for k in _KINDS), "same_lines", "lean_low", "lean_toxic", "lean_toxic_part"]


def statistics(texts: pa.Array, lean: dict[str, np.ndarray]) -> np.ndarray:
    """A row of transformed statistics (NAMES) for each text; nulls and texts without words get NaN.

    lean: sorted word hashes that lean to ``low`` and ``toxic``.
    """
    buf, off = C.text_buffer(pa.compute.utf8_lower(texts))
    raw, raw_off = C.text_buffer(texts)
    n = len(texts)
    starts, ends, hashes, doc = C.word_table(buf, off)
    size = np.diff(raw_off).astype(float)
    words = np.bincount(doc, minlength=n).astype(float)
    lens = (ends - starts).astype(float)
    # as if five words of four characters, give or take two, were added
    mean = (np.bincount(doc, lens, n) + 20) / (words + 5)
    spread = np.sqrt(np.maximum((np.bincount(doc, lens * lens, n) + 100) / (words + 5) - mean**2, 0))
    newline = np.flatnonzero(raw == 10)
    where = np.searchsorted(raw_off, newline, "right") - 1
    lines = np.bincount(where, minlength=n) + 1.0
    out = [np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), np.log(lines + 1) - np.log(words + 20)]
    counted = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(raw_off[:-1], raw_off[1:])]) if n else np.zeros((0, 256))
    for k in _KINDS:
        part = (counted @ _LUT[k] + USUAL_CHARS * USUAL[k]) / (size + USUAL_CHARS)
        out.append(np.log(part / (1 - np.minimum(part, 1 - 1e-9))))
    # lines that repeat in their document: equal hashes of whole lines
    begin = np.sort(np.concatenate([raw_off[:-1][size > 0], newline + 1]))
    begin = begin[begin < len(raw)]
    begin = np.unique(begin)
    same = np.zeros(n)
    if len(begin):
        place = np.arange(len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
        line = C.mixed(np.add.reduceat(C.BYTE_R[raw] * C.PLACE_R[place & 4095], begin))
        at = np.searchsorted(raw_off, begin, "right") - 1
        order = np.lexsort((line, at))
        again = np.zeros(len(begin), bool)
        again[1:] = (line[order][1:] == line[order][:-1]) & (at[order][1:] == at[order][:-1])
        same = np.bincount(at[order][again], minlength=n).astype(float)
    out.append(np.log((same + 0.1) / (lines + 5)))
    for k in ("low", "toxic"):
        known = lean.get(k, np.zeros(0, np.uint64))
        hit = np.zeros(len(hashes), bool)
        if len(known):
            i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[i] == hashes
        found = np.bincount(doc[hit], minlength=n).astype(float)
        out.append(np.log1p(found))
    out.append(np.log((found + 0.05) / (words + 50)))
    made = np.column_stack(out) if n else np.zeros((0, len(NAMES)))
    made[words == 0] = np.nan
    return made


def sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, class, fold): at most limit label rows without nulls, the least by hash of doc_id (ties by the labels), with their texts.

    Equal label rows count once, and so do documents that share a doc_id: the
    one whose text has the least hash stands for all.
    """
    own = labels.select(*(C.own(labels, c).alias(c) for c in ("doc_id", "quality", "toxic")))
    some = (
        own.where("doc_id is not null and quality is not null and toxic is not null")
        .select(F.col("doc_id").alias("labelled_id"), F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1).alias("class"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id", "class")
        .limit(limit)
    )
    docs = docs.select(C.own(docs, "doc_id").alias("doc_id"), C.own(docs, "text").alias("text"))
    # at most MAX_LABELLED rows of 12 bytes, whatever the input
    found = docs.join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id")).where("text is not null")
    one = found.groupBy("labelled_id", "class").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("text", "class", F.pmod(F.xxhash64("labelled_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))


_COUNTS = [f"n{k}_{f}" for k in range(len(CLASSES)) for f in range(FOLDS)]


def _word_rows(batches):
    for batch in batches:
        for part in C.blocks(batch, "text"):
            kind = part.column("class").to_numpy().astype(np.int64) * FOLDS + part.column("fold").to_numpy()
            buf, off = C.text_buffer(pa.compute.utf8_lower(part.column("text")))
            _, _, hashes, doc = C.word_table(buf, off)
            # each word of a document once
            order = np.lexsort((hashes, doc))
            h, d = hashes[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            word, inverse = np.unique(h[new], return_inverse=True)
            counts = [np.bincount(inverse, kind[d[new]] == k, len(word)).astype(np.int64) for k in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *map(pa.array, counts)], names=["h", *_COUNTS])


def leaning(rows: DataFrame, totals: dict[tuple[int, int], int]) -> list[dict[str, np.ndarray]]:
    """Hashes of the words that lean to low and to toxic documents of the sample, sorted: without each fold, and last in all of it. totals: documents by class and fold."""
    counts = rows.mapInArrow(_word_rows, "h long, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("h").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    flags = {}
    for left_out in (*range(FOLDS), FOLDS):
        folds = [f for f in range(FOLDS) if f != left_out]
        n = [sum((F.col(f"n{k}_{f}") for f in folds), F.lit(0)) for k in range(3)]
        size = [sum(totals.get((k, f), 0) for f in folds) for k in range(3)]
        for k in (1, 2):
            rest, others = sum(size) - size[k], sum((n[j] for j in range(3) if j != k), F.lit(0))
            likelier = n[k] / F.lit(max(size[k], 1)) > LEAN_RATIO * (others + 1) / F.lit(rest + 1)
            flags[f"f{left_out}_{k}"] = (n[k] >= LEAN_DOCS) & likelier
    made = counts.select("h", *(v.alias(c) for c, v in flags.items())).where(" or ".join(flags)).toArrow()  # words of the bounded sample
    words = np.array(made["h"].to_numpy()).view(np.uint64)
    take = lambda c: np.sort(words[made[c].to_numpy(zero_copy_only=False).astype(bool)])
    return [{"low": take(f"f{f}_1"), "toxic": take(f"f{f}_2")} for f in range(FOLDS + 1)]


def fitted(x: np.ndarray, y: np.ndarray) -> dict:
    """The discriminant of vectors x of classes y: centre and scale, and by class the mean, the inverse Cholesky factor, and the log prior less the log determinant's half."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = np.clip((x - centre) / scale, -FARTHEST, FARTHEST)
    means = {k: x[y == k].mean(0) for k in range(3) if (y == k).any()}
    pooled = sum((x[y == k] - m).T @ (x[y == k] - m) for k, m in means.items()) / len(x)
    model = {"centre": centre, "scale": scale, "classes": {}}
    for k, m in means.items():
        z = x[y == k] - m
        a = TO_POOLED + (1 - TO_POOLED) * min(1.0, x.shape[1] / len(z))  # small classes lean on the pool
        s = (1 - a) * (z.T @ z) / len(z) + a * pooled
        s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.maximum(np.diag(s), 0.05))
        low = np.linalg.cholesky(s + 1e-6 * np.eye(len(s)))
        model["classes"][CLASSES[k]] = (m, np.linalg.inv(low), -np.log(np.diag(low)).sum() + np.log(len(z) / len(x)))
    return model


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> dict | None:
    """Leaning words, means, inverse Cholesky factors, log determinants and priors; None without a labelled document with words."""
    with C.scope(docs.sparkSession):
        rows = C.kept(sample(docs, labels, limit), "labelled")
        totals = {(r["class"], r["fold"]): r["count"] for r in rows.groupBy("class", "fold").count().collect()}
        if not totals:
            return None
        lean = leaning(rows, totals)

        def vectors(batches):
            for batch in batches:
                for part in C.blocks(batch, "text"):
                    for f in range(FOLDS):
                        own = part.filter(pa.compute.equal(part.column("fold"), f))
                        x = statistics(own.column("text"), lean[f])
                        yield pa.RecordBatch.from_arrays([own.column("class"), pa.array(list(x), pa.list_(pa.float64()))], names=["class", "x"])

        got = rows.mapInArrow(vectors, "class int, x array<double>").toArrow()  # bounded by limit
    x, y = np.array(got["x"].to_pylist(), float).reshape(len(got), -1), got["class"].to_numpy()
    fine = np.isfinite(x).all(1) if len(x) else np.zeros(0, bool)
    order = np.lexsort((*x[fine].T, y[fine]))  # sums don't depend on the order of rows
    x, y = x[fine][order], y[fine][order]
    return {"lean": lean[-1], **fitted(x, y)} if len(x) else None


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density plus log prior of each row in each of CLASSES; -inf in a class that had no sample."""
    z = np.clip((x - model["centre"]) / model["scale"], -FARTHEST, FARTHEST)
    out = np.full((len(x), len(CLASSES)), -np.inf)
    for j, k in enumerate(CLASSES):
        if k in model["classes"]:
            mean, inverse, base = model["classes"][k]
            out[:, j] = base - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1)
    return out


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Adds to each row of docs lf_good, lf_low and lf_toxic (log densities with priors) and lf_class.

    Needs doc_id and text. A null text, or one without a word, gets null
    scores and the class 'unjudged'; so does every text if no labelled
    document has words. Repeated rows get equal results. Ties go to good,
    then low. Very long texts are taken whole. Empty docs give no rows. Other
    columns pass unchanged; where docs has a column of an added name, that
    column is replaced.
    """
    C.arrow_batches(docs.sparkSession)
    docs = docs.drop("lf_good", "lf_low", "lf_toxic", "lf_class")
    model = fit(docs, labels, limit)

    def run(batches):
        for batch in batches:
            for part in C.blocks(batch, "text"):
                n = part.num_rows
                judged, s = np.zeros(n, bool), np.zeros((n, len(CLASSES)))
                if model:
                    x = statistics(part.column("text"), model["lean"])
                    judged = np.isfinite(x).all(1)
                    s[judged] = scores(model, x[judged])
                which = np.where(judged, np.argmax(s, 1), 3)
                named = pa.array([*CLASSES, "unjudged"]).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.round(s[:, j], 6), mask=~judged) for j in range(3)), named], names=[*part.schema.names, "lf_good", "lf_low", "lf_toxic", "lf_class"])

    return C.mapped(docs, run, "lf_good double, lf_low double, lf_toxic double, lf_class string")


def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores and decision of every document."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = classify(docs, C.table(spark, sf_dir, "labels"))
    return made.select("doc_id", F.round("lf_good", 4).alias("good"), F.round("lf_low", 4).alias("low"), F.round("lf_toxic", 4).alias("toxic"), F.col("lf_class").alias("decision"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that aren't judged low or toxic; nulls, ties and the like are as in classify(): what can't be judged stays."""
    return classify(docs, C.table(spark, sf_dir, "labels")).where("lf_class in ('good', 'unjudged')").select(*(f"`{c}`" for c in docs.columns))
