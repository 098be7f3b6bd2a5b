"""URL filters: all glob rules at once as a bit-parallel Shift-And automaton.

Rules are sequences of symbols, with ``?`` (any symbol) and ``*`` (any run).
Their positions are packed side by side into 64-bit words. One step on a symbol
shifts all words (bits carry from word to word), ands the symbol's mask and
keeps the bits that a ``*`` lets wait; every rule advances at once, and numpy
does the step for all URLs of a batch that still have symbols left.

Canonical form of a URL: a dot, the lower-cased host, a separator symbol that no
text holds, the path. So ``*.example.com`` + separator + ``/en/*`` fits the
host, all its subdomains, and only at the host's end.

Defined results: a null URL or one without ``://`` has empty host and path and fits
no host rule; with no rule the verdict is the filter's default; among fitting rules the
longest wins (ties: the first listed); repeated rows are rows of their own; null page_ids pass through; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.names import unused

#: Symbols are UTF-8 bytes, then the host's end.
END, SYMBOLS = 256, 257
ANY, RUN = -1, -2

#: (verdict, host, path) of the production filter.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def glob(text: str) -> list[int]:
    """Symbols of a glob: ``*`` is a run, ``?`` any symbol, the rest its UTF-8 bytes."""
    special = {"*": [RUN], "?": [ANY]}
    return [s for c in text for s in special.get(c, list(c.encode()))]


def host_rule(host: str, path: str) -> list[int]:
    """The glob of a host with its subdomains and of paths that start with ``path`` (globs allowed in both)."""
    return [RUN, ord("."), *glob(host.lower()), END, *glob(path), RUN]


class ShiftAnd:
    """All patterns, each matched against whole inputs."""

    def __init__(self, patterns: list[list[int]]):
        start, loops, masks, accept = [], [], [], []
        at = 0  # bit 0 of a pattern is its start state; bit i + 1 says that i symbols fit
        for pattern in patterns:
            start.append(at)
            if pattern[:1] == [RUN]:
                loops.append(at)
            for symbol in pattern:
                if symbol == RUN:
                    loops.append(at)
                    continue
                at += 1
                masks.append((at, symbol))
            accept.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.accept = np.array(accept, dtype=np.int64)
        self.start, self.loop = self._pack(start), self._pack(loops)
        self.mask = np.zeros((SYMBOLS, self.words), dtype=np.uint64)
        for bit, symbol in masks:
            rows = slice(None) if symbol == ANY else symbol
            self.mask[rows, bit >> 6] |= np.uint64(1 << (bit & 63))

    def _pack(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for bit in bits:
            out[bit >> 6] |= np.uint64(1 << (bit & 63))
        return out

    def match(self, inputs: list[np.ndarray]) -> np.ndarray:
        """bool[inputs, patterns]; inputs are int16 symbol arrays."""
        if not inputs:
            return np.zeros((0, len(self.accept)), dtype=bool)
        size = np.array([len(x) for x in inputs])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([inputs[i] for i in order]) if size.sum() else np.zeros(0, dtype=np.int16)
        size = size[order]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        state = np.tile(self.start, (len(inputs), 1))
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for at, n in enumerate(live):
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.mask[flat[first[:n] + at]]) | (now & self.loop)
        out = np.zeros((len(inputs), len(self.accept)), dtype=bool)
        out[order] = (state[:, self.accept >> 6] >> (self.accept & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, default: str = "allow", step: int = 4096) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` added; columns of ``pages`` with these names give way.

    ``step`` URLs are simulated together, which bounds a worker's memory.
    """
    names = [host + path for _, host, path in rules]
    size = np.array([len(n) for n in names], dtype=np.int64)
    engine = ShiftAnd([host_rule(host, path) for _, host, path in rules])
    result = "rule string, verdict string"

    @F.pandas_udf(result)
    def fitting(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = []
        for lo in range(0, len(hosts), step):
            inputs = []
            for host, path in zip(hosts.iloc[lo : lo + step], paths.iloc[lo : lo + step]):
                h, p = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
                symbols = np.empty(len(h) + len(p) + 2, dtype=np.int16)
                symbols[0], symbols[len(h) + 1] = ord("."), END
                symbols[1 : len(h) + 1] = np.frombuffer(h, dtype=np.uint8)
                symbols[len(h) + 2 :] = np.frombuffer(p, dtype=np.uint8)
                inputs.append(symbols)
            hit = engine.match(inputs)
            best = np.where(hit, size, -1).argmax(axis=1)
            found += [int(b) if any_ else -1 for b, any_ in zip(best, hit.any(axis=1))]
        return pd.DataFrame(
            {"rule": [names[b] if b >= 0 else None for b in found], "verdict": [rules[b][0] if b >= 0 else default for b in found]}
        )

    added = ("host", "path", "rule", "verdict")
    name, fit = unused(pages, "parts", "fit")
    parts = pages.withColumn(name, F.struct(host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")))
    found = parts.withColumn(fit, fitting(F.col(name)["host"], F.col(name)["path"]))
    others = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in added]
    return found.select(*others, F.col(name)["host"].alias("host"), F.col(name)["path"].alias("path"), F.col(fit)["rule"].alias("rule"), F.col(fit)["verdict"].alias("verdict"))


def op2_url_globs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = {
    "op2_url_globs": r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(COALESCE(url, ''), '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(COALESCE(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
}
