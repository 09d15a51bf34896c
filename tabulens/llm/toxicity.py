"""Toxicity by compression distance: one zstandard dictionary for each class, compressed lengths of windows compared.

A dictionary holds the word beginnings that are typical of its class, as many as the labelled rows give reason for, then the
beginnings that both classes use, then a fixed tail. Each window of a text is compressed with either; a window that the toxic dictionary shortens by more bytes
is evidence. A logistic curve over these gains, fitted on the labelled rows, turns them into a score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tabulens.llm.common import BATCH_BYTES, blocks, bounded, fresh, releasing, text_or_empty

#: Labelled rows to learn from, at most: those with the least hash of their id.
SAMPLE = 20_000
#: Words in a window, letters of a word at most (longer ones are cut), and lengths of the word beginnings in a dictionary,
#: each with the blank before it; words of SHORT letters count as a whole.
WINDOW, WORD, BEGINNINGS, SHORT = 1, 64, range(5, 13), 3
#: Share of a typical beginning's texts that are of its class, and what its likelihood ratio may lack of the logarithm of
#: the number of beginnings. These, WINDOW and the features were compared by four-fold validation on rows that are not held
#: out; README tells how the last choice among two alike was made.
PURE, SLACK = 0.95, 3.0
#: Beginnings in a dictionary that both classes use.
COMMON = 600
THRESHOLD = 0.3
#: Beginnings that a worker counts before it sends what it has.
HELD = 100_000
#: Stands at the end of each dictionary and window, so that every window is compressed and none is stored.
TAIL = b"=-_~+^<>[]{}@#|&%$!?0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str) -> list[str]:
    out = []
    for w in text.lower().split():
        out += [w] if len(w) <= WORD else [w[i : i + WORD] for i in range(0, len(w), WORD)]
    return out


def windows(text: str) -> tuple[bytes, np.ndarray]:
    """The whole text's words, a space before each, and where runs of WINDOW words begin and the last one ends."""
    data = "".join(" " + w for w in words(text)).encode("utf-8", "surrogatepass")
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
    return data, np.append(spaces[::WINDOW], len(data))


def runs_of_four(data: bytes) -> np.ndarray:
    """The numbers of all runs of four bytes, the shortest that zstandard refers to."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    return x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)


def beginnings(text: str) -> set[str]:
    own = set(words(text))
    return {w[: k - 1] for w in own for k in BEGINNINGS if len(w) >= k - 1} | {w for w in own if len(w) == SHORT}


def outermost(units: list[str]) -> list[str]:
    """Those that are not the beginning of another one, in their order: a longer one holds the shorter ones."""
    inner = {u[:k] for u in units for k in range(1, len(u))}
    return [u for u in units if u not in inner]


def contents(toxic: list[str], ordinary: list[str], common: list[str]) -> tuple[bytes, bytes]:
    """The two dictionaries from beginnings, the strongest first; what is typical is cut nowhere, the shorter side is filled up."""
    own = [outermost(x) for x in (toxic, ordinary)]
    shared = [u for u in common if u not in {*toxic, *ordinary}]
    sides = ["".join(" " + u for u in reversed(x)).encode("utf-8", "surrogatepass") for x in own]
    width = max(map(len, sides))
    tail = "".join(" " + u for u in reversed(shared)).encode("utf-8", "surrogatepass") + TAIL
    return b"=" * (width - len(sides[0])) + sides[0] + tail, b"=" * (width - len(sides[1])) + sides[1] + tail


def family(text: str) -> int:
    """The least hash of a text's runs of three words, which near copies mostly share."""
    w = words(text)
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 2))), default=0)


def held_out(key: Column) -> Column:
    """Whether a row is never learnt from."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


class Scorer:
    """Compares windows by their compressed lengths.

    A window counts as evidence only if it holds a run of four bytes that the toxic dictionary has beyond what both share
    and the ordinary one has not; without one, the toxic dictionary has nothing of its own to refer to. Only such windows
    are compressed.
    """

    def __init__(self, model: Model):
        size = max(14, (len(model.toxic) + WINDOW * (WORD + 1) * 4 + len(TAIL)).bit_length())  # all of a dictionary is within reach
        params = zstandard.ZstdCompressionParameters(window_log=size + 1, hash_log=size, chain_log=size, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.weights = np.array(model.weights)
        self.with_ = []
        for content in (model.toxic, model.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.with_.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        width = len(model.toxic)
        own = next((i for i in range(width) if model.toxic[width - 1 - i] != model.ordinary[width - 1 - i]), width)
        toxic, ordinary = (np.unique(runs_of_four(x[: width - own] or TAIL)) for x in (model.toxic, model.ordinary))
        self.marks = np.setdiff1d(toxic, ordinary)
        self.known = np.zeros(1 << 16, bool)
        self.known[self._place(self.marks)] = True

    @staticmethod
    def _place(runs: np.ndarray) -> np.ndarray:
        return runs * np.uint32(0x9E3779B1) >> np.uint32(16)

    def evidence(self, text: str) -> list[bytes]:
        """The windows that can count, in order."""
        data, starts = windows(text)
        if len(data) < 4:
            return []
        runs = runs_of_four(data)
        at = np.flatnonzero(self.known[self._place(runs)])
        at = at[np.isin(runs[at], self.marks)]
        place = np.searchsorted(starts, at, "right") - 1
        place = np.unique(place[at + 4 <= starts[place + 1]])
        return [data[a:b] for a, b in zip(starts[place].tolist(), starts[place + 1].tolist(), strict=True)]

    def features(self, text: str) -> list[float]:
        """The largest gain of the toxic dictionary (to 8), the sum of the three largest, how many windows gain 2, 3 and 4 bytes,
        how many in a hundred words gain 3, and how many words there are."""
        toxic, ordinary = self.with_
        gains = sorted((len(ordinary(w + TAIL)) - len(toxic(w + TAIL)) for w in self.evidence(text)), reverse=True)
        counts = [sum(g >= k for g in gains) for k in (2, 3, 4)]
        n = max(1, len(text.split()))
        return [1.0, float(min(max(gains[0], 0), 8)) if gains else 0.0, float(sum(max(g, 0) for g in gains[:3])), *map(math.log1p, counts), math.log1p(100 * counts[1] / n), math.log(n)]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's steps on the ridge-penalised likelihood; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _surprise(own: str, total: str, share: float) -> Column:
    """Log-likelihood ratio of a beginning's share of its class against the class's share of texts; 0 if it is not above it."""
    k, n = F.col(own).cast("double"), F.col(total).cast("double")
    rest = n - k
    value = k * F.log(k / n / F.lit(share)) + F.when(rest > 0, rest * F.log(F.greatest(rest, F.lit(1.0)) / n / F.lit(1 - share))).otherwise(0.0)
    return F.when(k / n > F.lit(share), value).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Dictionaries and curve from labelled rows that are not held out; None without two classes.

    Rows without a label or an id are left out; of several labels of one id the largest holds; equal texts count once,
    and of near copies mostly one is counted.
    What reaches the driver is bounded by ``sample`` rows of a few numbers and by the sizes of the dictionaries.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # of many labels a share, a quarter more than the sample needs, is ordered: what partitions send is bounded by it
    share = min(1.0, (1.25 * sample + 1000) / max(1, labels.count()) / 0.75)
    known = known.filter(order < F.lit(int(share * (1 << 32)))).orderBy(order, "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text_")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy(F.sha2("text_", 256).alias("_text")).agg(F.max("toxic").alias("toxic"), F.min_by("text_", "doc_id").alias("text_")).select("toxic", "text_").cache()
    try:
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(sizes) < 2:
            return None
        share = sizes[1] / sum(sizes.values())

        def families(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [family(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["toxic", "text_", "family"])

        # near copies would make whatever they hold look typical, so one text of each family is counted
        alone = rows.mapInArrow(releasing(families), "toxic int, text_ string, family long").groupBy("family", "toxic").agg(F.min("text_").alias("text_")).select("toxic", "text_")

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: tuple[Counter[str], Counter[str]] = Counter(), Counter()

            def sent() -> pa.RecordBatch:
                own = [[*c] for c in counts]
                columns = {"unit": pa.array(own[0] + own[1], pa.string()), "toxic": pa.array([0] * len(own[0]) + [*counts[1].values()], pa.int64()), "ordinary": pa.array([*counts[0].values()] + [0] * len(own[1]), pa.int64())}
                for c in counts:
                    c.clear()
                return pa.RecordBatch.from_pydict(columns)

            for batch in batches:
                for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    counts[y].update(beginnings(text))
                    if len(counts[0]) + len(counts[1]) > HELD:
                        yield sent()
            yield sent()

        units = alone.mapInArrow(releasing(count), "unit string, toxic long, ordinary long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
        units = units.withColumn("both", F.col("toxic") + F.col("ordinary")).filter("both >= 3").cache()
        least = math.log(max(2, units.count())) - SLACK

        def typical(own: str, of: float) -> list[str]:
            """All beginnings that pass the test; there are fewer than the sample has words."""
            found = units.withColumn("value", _surprise(own, "both", of)).filter((F.col("value") >= least) & (F.col(own) >= F.col("both") * PURE))
            return [r["unit"] for r in found.orderBy(F.desc("value"), "unit").select("unit").collect()]

        toxic, ordinary = typical("toxic", share), typical("ordinary", 1 - share)
        common = [r["unit"] for r in units.orderBy(F.desc("both"), "unit").limit(COMMON).collect()]
        # toxic texts use ordinary words too, so few of these pass unless rows are many: the likeliest others make up as many bytes
        missing = sum(len(u) + 1 for u in outermost(toxic)) - sum(len(u) + 1 for u in outermost(ordinary))
        if missing > 0:
            known = {*ordinary, *common}
            likely = units.withColumn("value", _surprise("ordinary", "both", 1 - share)).filter("value > 0")
            for r in likely.orderBy(F.desc("value"), F.desc(F.length("unit")), "unit").limit(len(known) + 12 * missing).collect():
                u = r["unit"]
                if missing > 0 and u not in known and not any(x.startswith(u) for x in ordinary):
                    missing += sum(k + 1 for k in range(1, len(u)) if u[:k] in ordinary and u[:k] not in known) - len(u) - 1
                    ordinary = [*(x for x in ordinary if x in known or not u.startswith(x)), u]
        units.unpersist()
        plain = Model(*contents(toxic, ordinary, common), ())

        def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(plain)
            for batch in batches:
                found = [scorer.features(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "x"])

        data = rows.mapInArrow(releasing(measure), "toxic int, x array<double>").collect()
        w = fit_logistic(np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data], float))
        return Model(plain.toxic, plain.ordinary, tuple(w.tolist()))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with two columns more, a score (0 to 1) and whether it reaches THRESHOLD (1 or 0); whole texts, all columns kept.

    Null and empty texts have no window and get the curve's value for no evidence; repeated rows stay. Without a model
    every score is 0. ``names`` must be names that ``docs`` doesn't have.
    """
    bounded(docs.sparkSession)
    if model is None:
        return docs.withColumn(names[0], F.lit(0.0)).withColumn(names[1], F.lit(0))
    columns = docs.columns
    place = columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for rows in blocks(batches, BATCH_BYTES, text):
            x = np.array([scorer.features(t or "") for t in rows.column(place).to_pylist()])
            s = scorer.score(x)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*columns, *names])

    return docs.mapInArrow(releasing(run), StructType([*docs.schema.fields, StructField(names[0], DoubleType(), False), StructField(names[1], IntegerType(), False)]))


def document_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; other columns play no part."""
    model = train(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(own, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns unchanged, whatever their names."""
    names = fresh(docs, "score", "predicted")
    return score(docs, train(docs, labels), names=tuple(names)).filter(F.col(names[1]) == 0).select(*docs.columns)
