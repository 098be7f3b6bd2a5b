"""Toxicity: a linear-chain conditional random field over tokens, with two states.

Training tokens get their labels from the documents' labels: a token of a toxic
document is marked if its word, or a prefix of it, is far likelier in toxic
documents than in clean ones; every token of a clean document is unmarked. The
field learns weights of token features (word, prefixes, suffix; hashed) and of
state changes by gradient ascent on the conditional likelihood, computed by
forward-backward. At scoring, forward-backward marginals give the chance that
each token is toxic; a document's score is a logistic function, fitted on the
training documents, of the marginals' sum, their maximum and their share of
tokens. Spans are runs of tokens with a marginal of at least one half.

A sequence is a line, and so spans end with it. All lines of a batch step together in numpy, longest
first; feature sums are kept by word in a cache of bounded size.

Training reads a bounded sample of labelled documents: at most ``max_docs`` of them (a third toxic, if there
are as many), those with the smallest hashes of their ids; of texts above ``max_chars`` characters it takes lines from all
over the text, by hash. Scoring reads all documents whole.
Without toxic or without clean training documents every score is the share of
toxic ones (0 without any).

Defined results: null and empty texts are scored like any other (no tokens); repeated rows are
rows of their own; rows with a null doc_id are scored and not held out; labels that disagree on
a doc_id, or are null, are not used; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")
DIM = 1 << 18
CACHE = 300_000
#: Longest part of a line that an excerpt takes or leaves as one, in characters.
CUT = 2000


def feature_names(word: str) -> list[str]:
    word = word.lower()
    return [f"w={word}", *[f"p={word[:n]}" for n in range(3, min(9, len(word)) + 1)], f"s={word[-3:]}"]


_W, _P, _S = (zlib.crc32(x) for x in (b"w=", b"p=", b"s="))


def feature_ids(word: str) -> list[int]:
    """crc32 of each name of :func:`feature_names`; a prefix's goes on from the shorter one's."""
    word, crc32 = word.lower(), zlib.crc32
    parts = [c.encode("utf-8", "surrogatepass") for c in word[:9]]
    ids = [crc32(word.encode("utf-8", "surrogatepass"), _W) % DIM]
    if len(parts) > 2:
        running = crc32(parts[0] + parts[1], _P)
        for part in parts[2:]:
            running = crc32(part, running)
            ids.append(running % DIM)
    ids.append(crc32(word[-3:].encode("utf-8", "surrogatepass"), _S) % DIM)
    return ids


class _Scores(dict):
    """Log-odds by word, made when first asked for; starts anew when full, and doesn't remember words of more than 64 characters."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.tolist(), bias

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        weights = self.weights
        found = self.bias + sum([weights[i] for i in feature_ids(word)])
        if len(word) <= 64:
            self[word] = found
        return found


def forward_backward(score: np.ndarray, lengths: np.ndarray, change: np.ndarray):
    """Marginals of state 1 for sequences laid end to end, and the pair counts expected.

    ``score`` is the log-odds of state 1 by token; ``lengths`` sort descending; ``change`` is the 2 x 2
    matrix of log weights. Returns ``(marginal, pairs[2, 2], log_partition)``.
    """
    n, first = len(lengths), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    marginal, pairs, total = np.zeros(len(score)), np.zeros((2, 2)), 0.0
    if not len(score):
        return marginal, pairs, total
    longest = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    weight = np.exp(change - change.max())
    shift = change.max()
    # odds are scaled by token: state 0 weighs exp(-s/2), state 1 exp(s/2), both over their larger one
    up = np.exp(np.minimum(score, 0.0))
    down = np.exp(np.minimum(-score, 0.0))
    ahead = np.empty((len(score), 2))
    a0 = a1 = None
    for at in range(longest):
        k = live[at]
        here = first[:k] + at
        if at == 0:
            b0, b1 = down[here], up[here]
        else:
            b0 = (a0[:k] * weight[0, 0] + a1[:k] * weight[1, 0]) * down[here]
            b1 = (a0[:k] * weight[0, 1] + a1[:k] * weight[1, 1]) * up[here]
        norm = b0 + b1
        a0, a1 = b0 / norm, b1 / norm
        ahead[here, 0], ahead[here, 1] = a0, a1
        total += float(np.log(norm).sum()) + (k * shift if at else 0.0)
    total += float(np.maximum(score, 0.0).sum())
    back0, back1 = np.ones(n), np.ones(n)
    for at in range(longest - 1, -1, -1):
        k = live[at]
        here = first[:k] + at
        m0, m1 = ahead[here, 0] * back0[:k], ahead[here, 1] * back1[:k]
        marginal[here] = m1 / (m0 + m1)
        if at:
            e0, e1 = down[here] * back0[:k], up[here] * back1[:k]
            p0, p1 = ahead[here - 1, 0], ahead[here - 1, 1]
            joint = np.stack([p0 * weight[0, 0] * e0, p0 * weight[0, 1] * e1, p1 * weight[1, 0] * e0, p1 * weight[1, 1] * e1])
            pairs += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
            n0, n1 = weight[0, 0] * e0 + weight[0, 1] * e1, weight[1, 0] * e0 + weight[1, 1] * e1
            norm = n0 + n1
            back0[:k], back1[:k] = n0 / norm, n1 / norm
    return marginal, pairs, total


class Field:
    """A trained field: hashed feature weights, state changes and the document score's weights."""

    def __init__(self, weights: np.ndarray, bias: float, change: np.ndarray, head: np.ndarray, constant: float | None = None):
        self.weights, self.bias, self.change, self.head, self.constant = weights, bias, change, head, constant
        self.scores = _Scores(weights, bias)

    def __reduce__(self):
        return Field, (self.weights, self.bias, self.change, self.head, self.constant)

    def marginals(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text: marginals by token, and start and end of each toxic span in turn."""
        score, lengths, owner, places = [], [], [], []
        asked = self.scores.__getitem__
        for i, text in enumerate(texts):
            base = 0
            for line in text.split("\n"):
                words = TOKEN.findall(line)
                if words:
                    score += map(asked, words)
                    lengths.append(len(words))
                    owner.append(i)
                    places.append((base, line))
                base += len(line) + 1
        lengths, owner, score = np.array(lengths, dtype=np.int64), np.array(owner, dtype=np.int64), np.array(score, dtype=np.float64)
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        at = np.concatenate([np.arange(first[i], first[i + 1]) for i in order]) if len(order) else np.zeros(0, dtype=np.int64)
        out = np.zeros(len(score))
        out[at] = forward_backward(score[at], lengths[order], self.change)[0]
        spans: list[list[int]] = [[] for _ in texts]
        for row in np.unique(np.searchsorted(first, np.flatnonzero(out >= 0.5), side="right") - 1).tolist():
            base, line = places[row]
            before = False
            for m, hit in zip(TOKEN.finditer(line), out[first[row] : first[row + 1]] >= 0.5):
                if hit and before:
                    spans[owner[row]][-1] = base + m.end()
                elif hit:
                    spans[owner[row]] += (base + m.start(), base + m.end())
                before = hit
        cuts = np.cumsum(np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64))[:-1]
        return np.split(out, cuts)[: len(texts)], [np.array(s, dtype=np.int32) for s in spans]

    def document_scores(self, by_text: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(by_text), self.constant)
        x = np.array([summary(m) for m in by_text]).reshape(-1, 4)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.head, -30, 30)))


def summary(marginal: np.ndarray) -> list[float]:
    total = float(marginal.sum())
    return [1.0, float(np.log1p(total)), float(marginal.max(initial=0.0)), total / (len(marginal) + 20.0) * 10]


def mark_tokens(texts: list[str], toxic: list[bool], odds: float = 12.0, least: int = 3) -> set[str]:
    """Features far likelier in toxic documents: smoothed odds of at least ``odds`` in ``least`` documents or more."""
    bad: dict[str, int] = {}
    good: dict[str, int] = {}
    for text, flag in zip(texts, toxic):
        seen = {f for w in set(TOKEN.findall(text.lower())) for f in feature_names(w) if f[0] != "s"}
        count = bad if flag else good
        for f in seen:
            count[f] = count.get(f, 0) + 1
    n, m = sum(toxic), len(toxic) - sum(toxic)
    return {f for f, c in bad.items() if c >= least and (c + 0.5) / (n + 1) >= odds * (good.get(f, 0) + 0.5) / (m + 1)}


def train(texts: list[str], toxic: list[bool], epochs: int = 12, ridge: float = 1e-4, odds: float = 12.0) -> Field:
    toxic = [bool(t) for t in toxic]
    share = sum(toxic) / len(toxic) if toxic else 0.0
    empty = Field(np.zeros(DIM), 0.0, np.zeros((2, 2)), np.zeros(4), share)
    if not any(toxic) or all(toxic):
        return empty
    marks = mark_tokens(texts, toxic, odds)
    words: dict[str, int] = {}
    ids, label, lengths = [], [], []
    for text, flag in zip(texts, toxic):
        for line in text.split("\n"):
            found = TOKEN.findall(line)
            if found:
                lengths.append(len(found))
                ids += [words.setdefault(w, len(words)) for w in found]
                label += [flag and any(f in marks for f in feature_names(w)) for w in found]
    lengths, ids, label = np.array(lengths), np.array(ids), np.array(label, dtype=np.float64)
    order = np.argsort(-lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.concatenate([np.arange(first[i], first[i] + lengths[i]) for i in order])
    ids, label, lengths = ids[at], label[at], lengths[order]
    feats = [feature_ids(w) for w in words]
    flat, owner = np.concatenate(feats), np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    start = np.cumsum(lengths)[:-1]
    inner = np.ones(len(ids), dtype=bool)
    inner[np.concatenate([[0], start])] = False
    here = np.flatnonzero(inner)
    seen = np.bincount((label[here - 1] * 2 + label[here]).astype(int), minlength=4).reshape(2, 2).astype(np.float64)
    weights, bias, change = np.zeros(DIM), float(np.log((label.sum() + 1) / (len(label) + 1))), np.zeros((2, 2))
    fast, fast_b, fast_c = np.full(DIM, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(epochs):  # AdaGrad on the whole sample
        word = bias + np.bincount(owner, weights=weights[flat], minlength=len(feats))
        marginal, pairs, _ = forward_backward(word[ids], lengths, change)
        miss = label - marginal
        by_word = np.bincount(ids, weights=miss, minlength=len(feats))
        slope = np.bincount(flat, weights=by_word[owner], minlength=DIM) - ridge * len(label) * weights / 100
        fast += slope**2
        weights += 0.6 * slope / np.sqrt(fast)
        fast_b += miss.sum() ** 2
        bias += 0.2 * miss.sum() / np.sqrt(fast_b)
        fast_c += (seen - pairs) ** 2
        change += 0.2 * (seen - pairs) / np.sqrt(fast_c)
    field = Field(weights, bias, change, np.zeros(4))
    by_text = [m for lo in range(0, len(texts), 256) for m in field.marginals(texts[lo : lo + 256])[0]]
    x, y = np.array([summary(m) for m in by_text]), np.array(toxic, dtype=np.float64)
    head = np.zeros(4)
    for _ in range(50):  # Newton steps of a ridged logistic fit
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ head, -30, 30)))
        slope = x.T @ (y - p) - 0.05 * head
        head += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4), slope)
    field.head = head
    return field


def excerpt(text: str | None, max_chars: int) -> str:
    """The text, or of a longer one the parts with the smallest hashes: lines, cut after ``CUT`` characters, in their order."""
    if text is None or len(text) <= max_chars:
        return text or ""
    parts, at = [], 0
    while at < len(text):
        end = text.find("\n", at, at + CUT)
        end = at + CUT if end < 0 else end + 1
        parts.append(text[at:end])
        at = end
    order = sorted(range(len(parts)), key=lambda i: (zlib.crc32(f"{i}:{parts[i]}".encode("utf-8", "surrogatepass")), i))
    some, left = [], max_chars
    for i in order:
        left -= len(parts[i])
        if left < 0:
            break
        some.append(i)
    return "".join(parts[i] if parts[i].endswith("\n") else parts[i] + "\n" for i in sorted(some))


def training_rows(docs: DataFrame, labels: DataFrame, flag: str, keep, of_one: int, of_zero: int, max_chars: int) -> DataFrame:
    """``(doc_id, flag, text)``: a bounded sample of labelled documents, by the smallest hashes of their ids.

    At most ``of_one`` and ``of_zero`` documents by label, of whatever length; a text of more than ``max_chars`` characters
    gives an :func:`excerpt` from all over it. Of rows with one id the one with the smallest hash of its text counts.
    """
    known = labels.where(F.col(flag).isNotNull() & F.col("doc_id").isNotNull()).where(keep)
    known = known.groupBy("doc_id").agg(F.min(flag).alias("low"), F.max(flag).alias("high")).where("low = high")
    known = known.select("doc_id", F.col("low").alias("flag"), F.xxhash64("doc_id").alias("h"))
    some = known.where("flag = 1").orderBy("h", "doc_id").limit(of_one)
    some = some.unionAll(known.where("flag = 0").orderBy("h", "doc_id").limit(of_zero))

    @F.pandas_udf("string")
    def part(texts: pd.Series) -> pd.Series:
        return pd.Series([excerpt(t, max_chars) for t in texts], dtype=object)

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", whole.alias("text")).join(F.broadcast(some.select("doc_id", "flag")), "doc_id")  # of_one + of_zero rows of two numbers
    rows = rows.select("doc_id", "flag", F.xxhash64("text").alias("tie"), part("text").alias("text"))
    return rows.groupBy("doc_id", "flag").agg(F.min_by("text", "tie").alias("text"))


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4500, max_chars: int = 30_000, keep=None, **options) -> Field:
    """A field trained on labelled rows for which ``keep`` (a condition on labels' doc_id) holds."""
    keep = F.lit(True) if keep is None else keep
    rows = training_rows(docs, labels, "toxic", keep, max_docs // 3, max_docs - max_docs // 3, max_chars).toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["flag"].tolist(), **options)


def score(docs: DataFrame, field: Field, chars: int = 2 << 20) -> DataFrame:
    """``(doc_id, score, toxic_tokens, offsets)``; ``offsets`` are start and end of the offending spans, in characters."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def answer(ids, texts, model):
        marginal, spans = model.marginals(texts)
        value = model.document_scores(marginal)
        return pd.DataFrame(
            {"doc_id": pd.array(ids, dtype="Int64"), "score": value, "toxic_tokens": [int((m >= 0.5).sum()) for m in marginal], "offsets": spans}
        )

    def run(batches):
        model = sent.value
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                text = text or ""
                if held and held + len(text) > chars:
                    yield answer(ids, texts, model)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(text)
                held += len(text)
            if ids:
                yield answer(ids, texts, model)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, score double, toxic_tokens int, offsets array<int>")


def op3_toxic_crf(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = fit(docs, labels, keep=fold(F.col("doc_id")) != 1)
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return score(docs, field).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "toxic_tokens", "offsets"
    )
