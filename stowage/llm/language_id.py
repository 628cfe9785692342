"""Language of a text by a small convolutional network over bytes, trained in numpy.

Filters of several widths run over fixed-length windows of bytes; each filter keeps its largest response in a window, and a
softmax over these gives the languages. A text is scored in all its windows; the mean probability, weighted by bytes, decides.

Training reads a bounded sample of labelled rows: up to ``ROWS_PER_LANG`` of each label, chosen by a hash of the id, with
``WINDOWS_PER_ROW`` windows at seeded places, cut before they go to the driver. Prediction reads the text alone.

Defined cases: text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned; rows without
a label or an id are not learned from; ties go to the label that sorts first; repeated rows are predicted alike; an empty table gives
an empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.words import LOWER

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
ROWS_PER_LANG = 400
WINDOWS_PER_ROW = 3
EPOCHS = 6
# Updates that a small sample gets at least.
STEPS = 400
BATCH = 64
SEED = 11
# Windows scored at once.
SCORED = 512
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def held_out(id_column):
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def cut(text: str) -> np.ndarray:
    """All windows of a text, (n, LENGTH) lower-cased bytes, the last one filled with zeros."""
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    n = max(1, -(-len(data) // LENGTH))
    out = np.zeros((n, LENGTH), np.uint8)
    out.reshape(-1)[: len(data)] = data
    return out


class Network:
    """Tables of filter weights by byte, and the softmax on top."""

    def __init__(self, n_langs: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, n_langs)).astype(np.float32)
        self.bias = np.zeros(n_langs, np.float32)

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled responses, and where each filter was largest."""
        pooled, places = [], []
        for w, table in zip(WIDTHS, self.tables):
            n = LENGTH - w + 1
            total = table[0][windows[:, :n]]
            for j in range(1, w):
                total += table[j][windows[:, j : j + n]]
            at = total.argmax(1)
            places.append(at)
            pooled.append(np.take_along_axis(total, at[:, None], 1)[:, 0])
        return np.tanh(np.concatenate(pooled, 1)), places

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        scores = pooled @ self.out + self.bias
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on cross entropy; pooling sends each filter's gradient to its largest place alone."""
        rng = np.random.default_rng(seed)
        values = [*self.tables, self.out, self.bias]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        step = 0
        for _ in range(max(epochs, -(-STEPS * BATCH // len(windows)))):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), BATCH):
                chosen = order[start : start + BATCH]
                x, y = windows[chosen], labels[chosen]
                pooled, places = self.responses(x)
                error = self.probabilities(pooled)
                error[np.arange(len(y)), y] -= 1
                error /= len(y)
                back = (error @ self.out.T) * (1 - pooled**2)
                grads = []
                for k, (w, at) in enumerate(zip(WIDTHS, places)):
                    g = np.zeros_like(self.tables[k])
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(x, at + j, 1), np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [pooled.T @ error, error.sum(0)]
                step += 1
                for v, g, m, s in zip(values, grads, first, second):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def pair_tables(self) -> list[np.ndarray]:
        """Filter weights by pair of bytes, so that a place of width 2, 3 and 4 takes one, two and two look-ups."""
        two, three, four = self.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        return [pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3])]


def window_probabilities(network: Network, tables: list[np.ndarray], windows: np.ndarray) -> np.ndarray:
    """Probabilities of many windows by the pair tables."""
    out = []
    for start in range(0, len(windows), SCORED):
        x = windows[start : start + SCORED]
        pairs = x[:, :-1].astype(np.uint16) * np.uint16(256) + x[:, 1:]
        two = np.take(tables[0], pairs, 0).max(1)
        three = np.take(tables[1], pairs[:, :-1], 0)
        three += np.take(tables[2], x[:, 2:], 0)
        four = np.take(tables[3], pairs[:, :-2], 0)
        four += np.take(tables[4], pairs[:, 2:], 0)
        out.append(network.probabilities(np.tanh(np.concatenate([two, three.max(1), four.max(1)], 1))))
    return np.concatenate(out)


def sampled(text: str, draw: int) -> np.ndarray:
    """Windows of a text at places that its draw fixes, (WINDOWS_PER_ROW, LENGTH)."""
    rng = np.random.default_rng([SEED, draw % (1 << 64)])
    data = text.encode()
    out = np.zeros((WINDOWS_PER_ROW, LENGTH), np.uint8)
    for piece in out:
        # Mostly whole windows, some short ones, as texts can be short.
        size = int(rng.integers(20, LENGTH)) if rng.random() < 0.25 else LENGTH
        start = int(rng.integers(0, max(1, len(data) - size + 1)))
        taken = LOWER[np.frombuffer(data[start : start + size], np.uint8)]
        piece[: len(taken)] = taken
    return out


def cut_samples(batches):
    """The windows of the chosen rows, cut where the texts are: the driver gets WINDOWS_PER_ROW * LENGTH bytes a row."""
    for batch in batches:
        pieces = [sampled(t.as_py(), d.as_py()).tobytes() for t, d in zip(batch.column("text"), batch.column("draw"))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array(pieces, pa.binary())], ["lang", "draw", "windows"])


def learned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> tuple[list[str], Network]:
    """Labels and the network trained on a bounded sample of the labelled rows that are not held out."""
    labelled = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    keyed = labelled.select("lang", "id", "text", F.xxhash64("id", F.lit(SEED)).alias("draw"))
    # The texts stay out of the sort: the chosen ids are joined back.
    place = Window.partitionBy("lang").orderBy("draw", "id")
    chosen = keyed.select("lang", "id", "draw").withColumn("place", F.row_number().over(place)).where(F.col("place") <= rows_per_lang)
    held = keyed.join(F.broadcast(chosen.select("lang", "id").distinct()), ["lang", "id"])
    texts = held.groupBy("lang", "id", "draw").agg(F.min("text").alias("text")).select("lang", "draw", "text")
    rows = texts.mapInArrow(cut_samples, "lang string, draw bigint, windows binary").collect()
    rows.sort(key=lambda r: (r["draw"], r["lang"], r["windows"]))
    langs = sorted({r["lang"] for r in rows})
    number = {v: i for i, v in enumerate(langs)}
    network = Network(max(1, len(langs)))
    windows = [w for r in rows for w in np.frombuffer(r["windows"], np.uint8).reshape(WINDOWS_PER_ROW, LENGTH)]
    labels = [number[r["lang"]] for r in rows for _ in range(WINDOWS_PER_ROW)]
    if windows:
        network.train(np.array(windows), np.array(labels))
    return langs, network


def predicted(docs: DataFrame, langs: list[str], network: Network, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, network))

    def predict(batches):
        langs, network = shared.value
        tables = network.pair_tables()
        for batch in batches:
            texts = batch.column("text")
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows, windows, held = [], [], 0

            def settle():
                if not rows:
                    return
                every = np.concatenate(windows)
                weights = (every != 0).sum(1).astype(np.float64)
                shares = window_probabilities(network, tables, every) * weights[:, None]
                starts = np.cumsum([0, *[len(w) for w in windows]])[:-1]
                sums = np.add.reduceat(shares, starts) / np.add.reduceat(weights, starts)[:, None]
                for row, p in zip(rows, sums):
                    best[row], score[row] = langs[int(p.argmax())], min(1.0, float(p.max()))
                rows.clear()
                windows.clear()

            for i in range(len(texts)):
                value = texts[i].as_py()
                if not langs or value is None or not LETTER.search(value):
                    continue
                rows.append(i)
                windows.append(cut(value))
                held += len(windows[-1])
                if held >= SCORED:
                    settle()
                    held = 0
            settle()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    asked = docs.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text).alias("text"))
    return asked.mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_column)


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict all rows."""
    return predicted(docs, *learned(docs))
