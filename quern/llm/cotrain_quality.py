"""Quality: co-training of a text-content view and a page-metadata view.

The text view sees what a text says and how it is written (shares of capitals,
digits and symbols, repetition of words and lines, word lengths, how much it
compresses). The metadata view sees only the record around it (source, language,
number of characters and lines, line lengths). Each view is a logistic model
over one-hot quantile bins. In every round each view labels the unlabelled
documents it is surest of, in the labelled ratio, and the other view is trained
on them with the true labels. At the end each view is calibrated by Platt
scaling on labelled rows left out of its training, and the document's log-odds
are the calibrated views' sum, weighted by a third logistic fit on those rows.

Bin edges are quantiles of all documents, and every round scores all unlabelled documents under both views: the
logits of each view are counted in fine bins, which gives the thresholds of its surest documents. Models are fitted on bounded
samples of labelled and pseudo-labelled rows: at most ``max_labelled`` labelled documents, and of the documents a view is surest of
``max_pseudo``, those with the smallest hashes. Features of all documents are computed once, whole texts whatever their
length, and kept in a written table while fitting.

Defined results: null and empty texts are scored by their features (all zero); null metadata
is a value of its own; repeated rows are rows of their own; labels that disagree on a doc_id, or
are null, are not used; without labels of both kinds every score is the share of good
ones (1 without any); other columns pass through :func:`keep_good` and are ignored by :func:`score`.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.scratch import materialize, release

WORD = re.compile(r"\S+")
HASHED = 64


def text_view(text: str | None) -> list[float]:
    """Shares and means of a whole text; no length, source or layout.

    Each is drawn towards a common value by an imagined page of 200 characters and 30 words, or a few
    capitals would make a text of three words look like shouting.
    """
    text = text or ""
    n = len(text)
    words = WORD.findall(text)
    m = len(words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    count = np.bincount(_KIND[np.minimum(code, 0x250)], minlength=5)
    lines = [x for x in text.split("\n") if x]
    distinct = set(words)
    raw = text.encode("utf-8", "surrogatepass")
    squeezed = sum(len(zlib.compress(raw[i : i + 65536], 1)) for i in range(0, len(raw), 65536))
    ends = sum(1 for w in words if w[-1] in ".!?")
    marked = sum(1 for w in words if not w[-1].isalnum())
    return [
        (count[1] + 3) / (n + 200),  # capitals
        (count[2] + 0.2) / (n + 200),  # digits
        (count[3] + 4) / (n + 200),  # symbols
        (count[0] + 160) / (n - count[4] + 167),  # small letters among what isn't space
        (len(distinct) + 28) / (m + 30) ** 0.9,  # variety, little dependent on length
        (n - count[4] + 160) / (m + 30),
        (len(set(lines)) + 3) / (len(lines) + 3),
        (squeezed + 100) / (len(raw) + 200),
        (ends + 3) / (m + 30),
        (marked + 5) / (m + 30),
        max(map(len, distinct), default=0) / (m + 30) ** 0.1,
        sum(map(eq, words, words[1:])) / (m + 30),  # words said twice in a row
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) / (m + 30),  # separators
    ]


CONTENT = 13


def _kinds() -> np.ndarray:
    """Class of each character below 0x250: 0 other letters, 1 capitals, 2 digits, 3 symbols, 4 space; above: letters."""
    out = np.zeros(0x251, dtype=np.int64)
    for i in range(0x250):
        c = chr(i)
        out[i] = 4 if c.isspace() else 2 if c.isdigit() else 1 if c.isupper() else 0 if c.isalpha() else 3
    return out


_KIND = _kinds()


def meta_view(text: str | None, lang, source) -> tuple[list[float], list[int]]:
    """Numbers and hashed categories of a document's record."""
    text = text or ""
    n, lines = len(text), text.count("\n") + 1
    numbers = [float(np.log1p(n)), float(np.log1p(lines)), n / lines]
    named = [zlib.crc32(f"{k}={v}".encode("utf-8", "surrogatepass")) % HASHED for k, v in (("lang", lang), ("source", source))]
    return numbers, named


class Binned:
    """A logistic model over one-hot quantile bins of numbers, and hashed categories."""

    def __init__(self, edges: list):
        self.edges = [np.unique(np.array(e, dtype=np.float64)) for e in edges]
        self.start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])]).astype(np.int64)
        self.weights = None

    def design(self, numbers: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Column numbers of the ones, by row."""
        cols = [self.start[i] + np.searchsorted(e, numbers[:, i], side="left") for i, e in enumerate(self.edges)]
        cols += [self.start[-1] + named[:, j] for j in range(named.shape[1])]
        return np.stack([*cols, np.full(len(numbers), self.start[-1] + HASHED)], axis=1)

    def fit(self, cols: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 25) -> None:
        size = int(self.start[-1]) + HASHED + 1
        beta = np.zeros(size)
        x = np.zeros((len(cols), size), dtype=np.float32)
        x[np.arange(len(cols))[:, None], cols] = 1.0
        for _ in range(steps):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
            slope = x.T @ (w * (y - p)) - ridge * beta
            curve = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(size)
            step = np.linalg.solve(curve, slope)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = beta

    def logit(self, cols: np.ndarray) -> np.ndarray:
        return self.weights[cols].sum(axis=1)


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridged logistic fit of y on the columns of x and a constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.1), 1e-6]
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * beta)
    return beta


class CoTrained:
    """Two fitted views, their calibrations and the weights that combine them."""

    constant: float | None = None

    def predict(self, content: np.ndarray, record: np.ndarray, named: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(content), self.constant)
        none = np.zeros((len(content), 0), dtype=np.int64)
        a = self.content.logit(self.content.design(content, none)) * self.cal_a[0] + self.cal_a[1]
        b = self.record.logit(self.record.design(record, named)) * self.cal_b[0] + self.cal_b[1]
        x = np.column_stack([a, b, np.ones(len(a))])
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.mix, -30, 30)))


#: Quantiles that bins end at.
CUTS = sorted({*(np.arange(1, 16) / 16).tolist(), 0.005, 0.015, 0.03, 0.97, 0.985, 0.995})
#: Logits are counted in bins of 1/64 between -32 and 32.
REACH, FINE = 32, 64
#: A view never labels documents whose odds are nearer to even than this logit.
CALM = 1.5


def train(known: pd.DataFrame, edges: tuple[list, list], surest, rounds: int = 4, sure: float = 0.05) -> CoTrained:
    """``known`` holds labelled rows (flag, content, record, named). Every fifth of each label calibrates and trains neither view.

    ``surest(views, turn share, share of good ones)`` gives for each view the rows it labels, with ``flag``.
    """
    model = CoTrained()
    label = known["flag"].to_numpy(dtype=np.int64)
    if not len(label) or len(set(label)) < 2:
        model.constant = float(label.mean()) if len(label) else 1.0
        return model
    left = np.zeros(len(label), dtype=bool)
    for c in (0, 1):
        left[np.flatnonzero(label == c)[4::5]] = True
    if len(set(label[left])) < 2:
        left[:] = True
        own = left
    else:
        own = ~left
    a, b = Binned(edges[0]), Binned(edges[1])
    views = (a, b)
    cols = designs(views, known)
    share = label[own].mean()
    given = [None, None]  # rows labelled for each view by the other one
    for turn in range(rounds + 1):
        for i, view in enumerate(views):
            x, y, w = cols[i][own], label[own].astype(np.float64), np.ones(int(own.sum()))
            if given[i] is not None and len(given[i]):
                x = np.concatenate([x, designs(views, given[i])[i]])
                y = np.concatenate([y, given[i]["flag"].to_numpy(dtype=np.float64)])
                w = np.concatenate([w, np.full(len(given[i]), 0.3)])
            view.fit(x, y, w)
        if turn < rounds:
            labelled = surest(views, sure * (turn + 1), share)
            given = [labelled[1], labelled[0]]
    model.content, model.record = a, b
    za, zb, y = a.logit(cols[0][left]), b.logit(cols[1][left]), label[left].astype(np.float64)
    model.cal_a, model.cal_b = _platt(za[:, None], y), _platt(zb[:, None], y)
    both = np.column_stack([za * model.cal_a[0] + model.cal_a[1], zb * model.cal_b[0] + model.cal_b[1]])
    model.mix = _platt(both, y)
    for i in (0, 1):  # a view never counts against itself
        if model.mix[i] < 0:
            alone = _platt(both[:, 1 - i : 2 - i], y)
            model.mix = np.insert(alone, i, 0.0)
    return model


def designs(views, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both views' column numbers of feature rows."""
    content, record, named = (np.stack(rows[c].to_numpy()) for c in ("content", "record", "named"))
    return views[0].design(content, np.zeros((len(rows), 0), dtype=np.int64)), views[1].design(record, named.astype(np.int64))


def _frames(batch: pd.DataFrame):
    content = np.array([text_view(t) for t in batch["text"]], dtype=np.float64).reshape(len(batch), -1)
    pairs = [meta_view(t, la, s) for t, la, s in zip(batch["text"], batch["lang"], batch["source"])]
    return content, np.array([p[0] for p in pairs]).reshape(len(batch), -1), np.array([p[1] for p in pairs], dtype=np.int64).reshape(len(batch), -1)


FEATURES = "doc_id long, tie long, content array<double>, record array<double>, named array<long>"


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, content, record, named)`` of every row; ``tie`` is a hash of the text."""

    def run(batches):
        for batch in batches:
            content, record, named = _frames(batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tie": batch["tie"], "content": list(content), "record": list(record), "named": list(named)})

    columns = [F.col(c).cast("string") for c in ("text", "lang", "source")]
    tie = F.xxhash64(*[F.coalesce(c, F.lit("")) for c in columns])
    return docs.select(F.col("doc_id").cast("long"), tie.alias("tie"), *columns).mapInPandas(run, FEATURES)


def _logits(batch: pd.DataFrame, views) -> list[np.ndarray]:
    return [view.logit(cols) for view, cols in zip(views, designs(views, batch))]


def _surest(pool: DataFrame, max_pseudo: int):
    """The function that :func:`train` asks for rows of ``pool`` to label."""
    total = pool.count()
    context = pool.sparkSession.sparkContext

    def find(views, share_of_pool: float, good: float):
        if not total:
            return None, None
        sent = context.broadcast(views)

        def count(batches):
            for batch in batches:
                for i, logit in enumerate(_logits(batch, sent.value) if len(batch) else ()):
                    at, n = np.unique(np.floor((np.clip(logit, -REACH, REACH - 1e-9) + REACH) * FINE).astype(np.int64), return_counts=True)
                    yield pd.DataFrame({"view": i, "bin": at, "n": n})

        # 2 * 2 * REACH * FINE rows at most
        held = pool.mapInPandas(count, "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).toPandas()
        many, limits = max(2, total * share_of_pool), []
        for i in (0, 1):
            mine = held[held["view"] == i].set_index("bin")["n"].sort_index()
            up, down = mine.cumsum(), mine[::-1].cumsum()
            low = up.index[up.searchsorted(min(many * (1 - good), total))]  # the bin that holds the last of the surest
            high = down.index[down.searchsorted(min(many * good, total))]
            limits.append((min((low + 1) / FINE - REACH, -CALM), max(high / FINE - REACH, CALM)))

        def choose(batches):
            for batch in batches:
                for i, logit in enumerate(_logits(batch, sent.value) if len(batch) else ()):
                    for flag, pick in ((0, logit < limits[i][0]), (1, logit >= limits[i][1])):
                        yield batch[pick].assign(view=i, flag=flag)

        found = pool.mapInPandas(choose, FEATURES + ", view int, flag int")
        hashed = materialize(found.withColumn("h", F.xxhash64("doc_id", "tie")), "quality-surest")
        out = []
        for i in (0, 1):
            parts = [
                hashed.where((F.col("view") == i) & (F.col("flag") == flag)).orderBy("h", "doc_id", "tie").limit(max(1, int(max_pseudo * part)))
                for flag, part in ((0, 1 - good), (1, good))
            ]
            out.append(parts[0].unionAll(parts[1]).toPandas().sort_values(["h", "doc_id", "tie"]))
        release(hashed)
        return tuple(out)

    return find


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, max_pseudo: int = 2000, **options) -> CoTrained:
    """Two co-trained views. Of labelled rows with one id the one with the smallest hash counts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    agreed = known.where("low = high").select("doc_id", F.col("low").cast("int").alias("flag"))
    marked = agreed.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_labelled).drop("h")
    every = materialize(features(docs), "quality-features")
    rows = every.join(F.broadcast(marked), "doc_id")  # max_labelled rows of two numbers
    held = F.struct("flag", "content", "record", "named")
    rows = rows.groupBy("doc_id").agg(F.min_by(held, F.col("tie")).alias("row")).select("doc_id", "row.*").toPandas().sort_values("doc_id")
    numbers = [*[F.col("content")[i] for i in range(CONTENT)], *[F.col("record")[i] for i in range(3)]]
    quantiles = every.agg(*[F.percentile_approx(x, CUTS, 10_000) for x in numbers]).first()
    edges = [list(q or [0.0]) for q in quantiles]
    # every round reads it twice, so it is joined and written once
    pool = materialize(every.join(known.select("doc_id"), "doc_id", "left_anti"), "quality-pool")
    release(every)
    model = train(rows, (edges[:CONTENT], edges[CONTENT:]), _surest(pool, max_pseudo), **options)
    release(pool)
    return model


def _scorer(sent):
    @F.pandas_udf("double")
    def good(text: pd.Series, lang: pd.Series, source: pd.Series) -> pd.Series:
        frame = pd.DataFrame({"text": text, "lang": lang, "source": source})
        return pd.Series(sent.value.predict(*_frames(frame)) if len(frame) else [], dtype="float64")

    return good(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """``(doc_id, score)``: the chance that a document is good."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", _scorer(sent).alias("score"))


def keep_good(docs: DataFrame, model: CoTrained, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``; columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.where(_scorer(sent) >= least)


def op6_cotrain_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).withColumn("keep", F.col("score") >= 0.5)
