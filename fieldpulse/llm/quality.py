"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.llm.rows import drop_ids, map_texts
from fieldpulse.runtime import as_table

FEATURES = 256
RIDGE = 1e-3
SEED = 7
BINS = 2_000
THRESHOLD = 0.3
PIECE_BYTES = 1 << 20

# Raw scores are close to the labels 0 and 1; the grid of the calibration leaves room on both sides.
_LOW, _HIGH = -0.5, 1.5

STATISTICS = (
    "log_bytes", "log_words", "word_mean", "word_spread", "log_word_max", "upper", "digits", "spaces", "lines",
    "stops", "marks", "symbols", "bars", "beyond_ascii", "distinct", "distinct_scaled", "top_word", "repeats",
    "short_words", "capitalised", "ended", "entropy",
)


def _statistics(data: bytes) -> list[float]:
    """Numbers that describe one text; all zero for a text without words and bytes."""
    import re
    from collections import Counter
    from math import log, log1p, sqrt
    from operator import eq

    import numpy as np

    raw = np.zeros(256, np.int64)
    n = total = squares = longest = repeats = short = capitalised = ended = 0
    seen: Counter = Counter()
    last, at, space = b"", 0, re.compile(rb"[\x20\x09-\x0d]")
    while at < len(data):
        found = space.search(data, at + PIECE_BYTES)
        stop = found.start() if found else len(data)
        piece = data[at:stop]
        at = stop
        raw += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        words = piece.split()
        if not words:
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        n += len(words)
        total += int(size.sum())
        squares += int((size * size).sum())
        longest = max(longest, int(size.max()))
        short += int((size <= 3).sum())
        repeats += sum(map(eq, words, words[1:])) + (words[0] == last)
        capitalised += sum(65 <= w[0] <= 90 for w in words)
        ended += sum(w[-1] in b".,;:" for w in words)
        last = words[-1]
        seen.update(words)
    size = max(1, int(raw.sum()))
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    share = raw[raw > 0] / size
    many = max(1, n)
    mean = total / many

    def part(chars: bytes) -> float:
        return float(raw[list(chars)].sum()) / size

    return [
        log1p(raw.sum()), log1p(n), mean, sqrt(max(0.0, squares / many - mean * mean)), log1p(longest),
        float(raw[65:91].sum()) / letters, float(raw[48:58].sum()) / size, part(b" \t"), float(raw[10]) / many,
        part(b".,;:'\"-"), part(b"!?"), part(b"#$%&*+/<=>@\\^_`~{}[]()"), part(b"|"), float(raw[128:].sum()) / size,
        len(seen) / many, log1p(len(seen)) / log1p(n) if n else 0.0, max(seen.values(), default=0) / many,
        repeats / many, short / many, capitalised / many, ended / many, -float((share * np.log(share)).sum()) / log(2),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)``: the statistics of every whole text. The text is the only input of ``x``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [_statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float32()))], ["id", "x"])

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    )
    return map_texts(rows, run, "id bigint, x array<float>")


@dataclass(frozen=True)
class Model:
    """Centre and scale of the statistics, the random features, ridge weights and calibration knots."""

    mean: list[float]
    spread: list[float]
    features: int
    weights: list[float] | None
    knots: list[float]
    levels: list[float]

    def phi(self, x):
        """Cosine features whose inner products approximate a Gaussian kernel; the last one is constant."""
        import numpy as np

        rng = np.random.default_rng(SEED)
        width = len(self.mean)
        # Kernel width: the expected distance of standardised statistics.
        frequencies = rng.standard_normal((width, self.features)) / np.sqrt(width)
        shift = rng.uniform(0, 2 * np.pi, self.features)
        z = np.clip((x - np.array(self.mean)) / np.array(self.spread), -6, 6)
        waves = np.cos(z @ frequencies + shift) * np.sqrt(2 / self.features)
        return np.hstack([waves, np.ones((len(waves), 1))])

    def raw(self, x):
        import numpy as np

        return self.phi(x) @ np.array(self.weights)

    def score(self, x):
        import numpy as np

        if self.weights is None:
            return np.full(len(x), self.levels[0])
        return np.interp(self.raw(x), self.knots, self.levels)


def _matrix(column, width: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _normal_equations(train: DataFrame, model: Model) -> list[list[float]]:
    """Rows of ``[A | b]`` of the normal equations, summed within partitions and then across."""
    width, size = len(model.mean), model.features + 1

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros((size, size + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            p = model.phi(_matrix(batch.column(0), width))
            total[:, :size] += p.T @ p
            total[:, size] += p.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"]
        )

    partial = train.select("x", F.col("y").cast("double").alias("y")).mapInArrow(run, "i int, row array<double>")
    summed = partial.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    return [r["row"] for r in summed.orderBy("i").select(vector_to_array("row").alias("row")).collect()]


def _pool(levels: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """Isotonic fit of ``(position, weight, sum of labels)`` in order of position: knots and levels."""
    blocks: list[list[float]] = []
    for at, weight, total in levels:
        blocks.append([at * weight, weight, total])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            upper = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], upper, strict=True)]
    return [b[0] / b[1] for b in blocks], [b[2] / b[1] for b in blocks]


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """Train on labelled rows whose id is not in fold 0: folds 1 to 3 fit the scores, fold 4 calibrates.

    All such rows are used, none is sampled. The driver receives sums of a fixed size only. Labels
    other than 0 and 1 are left out; without any label the model scores 0.5.
    """
    import numpy as np

    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        "y in (0, 1)"
    )
    train = as_table(
        known.filter(fold(F.col("id")) != 0).join(stats, "id").select("x", "y", fold(F.col("id")).alias("fold")),
        "quality-train",
    )
    width = len(STATISTICS)
    sums = train.agg(
        F.count("*").alias("n"), F.avg("y").alias("y"),
        *(f(F.col("x")[j]).alias(f"{name}{j}") for j in range(width) for name, f in (("m", F.avg), ("s", F.stddev_pop))),
    ).first()
    if not sums["n"]:
        return Model([0.0] * width, [1.0] * width, features, None, [0.0], [0.5])
    mean, spread = [sums[f"m{j}"] for j in range(width)], [sums[f"s{j}"] or 1.0 for j in range(width)]
    untrained = Model(mean, spread, features, None, [0.0], [sums["y"]])
    table = np.array(_normal_equations(train.filter("fold <> 4"), untrained))
    size = features + 1
    if not table[-1, -2]:
        return untrained
    penalty = ridge * table[-1, -2] * np.eye(size)
    penalty[-1, -1] = 0.0
    weights = np.linalg.solve(table[:, :size] + penalty, table[:, size]).tolist()
    scorer = Model(mean, spread, features, weights, [0.0, 1.0], [0.0, 1.0])

    def raw(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                at = np.clip(scorer.raw(_matrix(batch.column(0), width)), _LOW, _HIGH)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["at", "y"])

    step = (_HIGH - _LOW) / BINS
    binned = (
        train.filter("fold = 4").select("x", "y").mapInArrow(raw, "at double, y int")
        .groupBy(F.floor((F.col("at") - _LOW) / step).alias("bin"))
        .agg(F.avg("at").alias("at"), F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    )
    if not binned:
        return scorer
    knots, levels = _pool([(b["at"], float(b["n"]), float(b["y"])) for b in binned])
    return Model(mean, spread, features, weights, knots, levels)


def apply(stats: DataFrame, model: Model) -> DataFrame:
    """``(id, score)``: 0 to 1, higher where label 1 is likelier."""
    width = len(STATISTICS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch.column(1), width)).clip(0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return stats.select("id", "x").mapInArrow(run, "id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``(doc_id, held_out, score, predicted)``.

    Only the text decides the score. Null texts count as empty and get the score of an empty text;
    a null id is not held out and cannot be labelled. Repeated rows get a row each. An empty table
    gives no rows; other columns are ignored.
    """
    stats = as_table(statistics(docs, id_col, text_col), "quality-statistics")
    scored = apply(stats, fit(stats, labels, id_col, label_col))
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted 0; all columns stay. Rows that repeat an id share its worst verdict."""
    rejected = quality_scores(docs, labels, id_col, text_col).filter("predicted = 0").select(id_col)
    return drop_ids(docs, as_table(rejected, "quality-rejected"), id_col)
