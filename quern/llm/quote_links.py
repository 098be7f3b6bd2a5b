"""Chat formatting: links quoted passages to the messages they come from.

A line's quote level is the number of ``>`` marks before it (blanks between them count for nothing). A passage
is a run of quoted lines of one level; it is normalised (lower case, words with single blanks, whatever
the line breaks) and hashed. Passages are joined to the units of earlier messages of their conversation: each own line,
each own paragraph (a run of own lines without a blank or quoted one between) and the whole own text. Passages of more
than ``WINDOW`` words without such a unit, parts of one or edited ones, are joined by the hashes of all their windows of
``WINDOW`` words; the message with most of them counts, if it has half of them at least. Of several messages that have a hash
the latest before the quote is meant.

A message replies to the turn that most lines of its outermost linked passages link to (ties: the latest turn); deeper levels
are counted as links as well. Messages are returned without quotes, with their place in reply order: a reply stands after
what it answers and before the next reply to the same turn, with all replies to it.

Hashes are joined by sorting quotes and units of one (conversation, hash) by turn and carrying the latest unit along, so
neither a passage that thousands of messages hold nor a conversation with a third of all messages makes pairs or a
hot task. Windows are made for conversations with quotes that lack a unit only. Threads and places are found by pointer
doubling (places along the Euler tour of the reply trees) over written tables.

Defined results: null texts are empty; blank lines are not linked and stay; a null conv_id or turn links to
nothing and is its own thread; repeated rows stay, and of messages with the same conv_id and
turn any may be the one meant (they share the turn); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.plans.scratch import materialize, release

WINDOW = 8


def parse(text: str | None) -> list[tuple[int, str]]:
    """``(level, line without marks)`` of every line."""
    out = []
    for line in (text or "").split("\n"):
        at, level = 0, 0
        for i, c in enumerate(line):
            if c == ">":
                level, at = level + 1, i + 1
            elif c not in " \t":
                break
        out.append((level, line[at:].removeprefix(" ") if level else line))
    return out


def words(text: str) -> list[str]:
    return text.lower().split()


def passages(text: str | None) -> list[tuple[int, int, list[str]]]:
    """``(level, lines, words)`` of every run of quoted lines of one level that holds words."""
    out, last = [], 0
    for level, line in parse(text):
        if level:
            if level != last:
                out.append([level, 0, []])
            out[-1][1] += 1 if line.strip() else 0
            out[-1][2] += words(line)
        last = level
    return [(level, lines, held) for level, lines, held in out if held]


def units(text: str | None) -> set[str]:
    """Normalised own lines, paragraphs and the whole own text."""
    lines = [(level, words(line)) for level, line in parse(text)]
    out, run, whole = set(), [], []
    for level, held in [*lines, (1, [])]:
        if level or not held:
            out.add(" ".join(run))
            run = []
        else:
            out.add(" ".join(held))
            run, whole = run + held, whole + held
    out.add(" ".join(whole))
    return out - {""}


def windows(held: list[str]) -> list[str]:
    return [" ".join(held[i : i + WINDOW]) for i in range(len(held) - WINDOW + 1)]


def own_text(text: str | None) -> str:
    """The message without quoted lines; blank lines at its ends go if quotes stood there."""
    lines = parse(text)
    if not any(level for level, _ in lines):
        return text or ""
    return "\n".join(line for level, line in lines if not level).strip("\n")


def own_words(text: str | None) -> list[str]:
    return [w for level, line in parse(text) if not level for w in words(line)]


def _digest(plain: str) -> bytes:
    return xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass"))


def _rows(messages: DataFrame, make, extra: str) -> DataFrame:
    """``(conv_id, turn, *extra)``: the tuples that ``make(text)`` gives for each message."""
    names = [c.strip().split(" ")[0] for c in extra.split(",")]

    def run(batches):
        for batch in batches:
            rows = []
            for conv, turn, text in zip(batch["conv_id"].astype("Int64"), batch["turn"].astype("Int64"), batch["text"]):
                rows += [(conv, turn, *found) for found in make(text)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["conv_id", "turn", *names]).astype({"conv_id": "Int64", "turn": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=["conv_id", "turn", *names]).astype({"conv_id": "Int64", "turn": "Int64"})

    return messages.mapInPandas(run, f"conv_id long, turn long, {extra}")


def _latest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``asked(conv_id, turn, hash, ...)`` with the latest earlier turn of ``held(conv_id, turn, hash)``, where there is one."""
    both = asked.withColumn("asks", F.lit(True)).unionByName(held.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("original_turn", F.max(F.when(~F.col("asks"), F.col("turn"))).over(earlier))
    return found.where("asks AND original_turn IS NOT NULL").drop("asks")


def quote_links(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, passage, level, lines, original_turn)``: each quoted passage (numbered by message) with an original."""
    messages = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string"))
    messages = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")

    def quoted(text):
        return [(i, level, lines, _digest(" ".join(held)), len(held) > WINDOW) for i, (level, lines, held) in enumerate(passages(text))]

    asked = materialize(_rows(messages, quoted, "passage int, level int, lines int, hash binary, wide boolean").distinct(), "chat-quotes")
    some = messages.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    held = _rows(some, lambda text: [(_digest(u),) for u in units(text)], "hash binary")
    held = held.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    whole = materialize(_latest(asked, held), "chat-whole")
    links = whole.select("conv_id", "turn", "passage", "level", "lines", "original_turn")

    rest = asked.where("wide").join(whole.select("conv_id", "turn", "passage"), ["conv_id", "turn", "passage"], "left_anti")
    rest = materialize(rest.select("conv_id", "turn", "passage").distinct(), "chat-rest")
    if not rest.limit(1).count():
        return links
    parts = lambda text: [
        (i, level, lines, len(windows(held)), _digest(w))
        for i, (level, lines, held) in enumerate(passages(text))
        if len(held) > WINDOW
        for w in windows(held)
    ]
    some = messages.join(rest.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi")
    pieces = _rows(some, parts, "passage int, level int, lines int, many int, hash binary").distinct()
    pieces = materialize(pieces.join(rest, ["conv_id", "turn", "passage"], "left_semi"), "chat-windows")
    some = messages.join(rest.select("conv_id").distinct(), "conv_id", "left_semi")
    held = _rows(some, lambda text: [(_digest(w),) for w in set(windows(own_words(text)))], "hash binary")
    held = held.join(pieces.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    votes = _latest(pieces, held).groupBy("conv_id", "turn", "passage", "level", "lines", "many", "original_turn").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv_id", "turn", "passage", "level", "lines", "many").agg(F.max(F.struct("n", "original_turn")).alias("best"))
    best = best.where(F.col("best.n") * 2 >= F.col("many"))
    return links.unionByName(best.select("conv_id", "turn", "passage", "level", "lines", F.col("best.original_turn").alias("original_turn")))


def _double(now: DataFrame, keys: list[str], to: list[str], total: str, max_rounds: int = 64) -> DataFrame:
    """Pointer doubling: ``total`` is added up along ``to`` (pointers to ``keys``) until no pointer is left to follow.

    ``conv_id`` is part of every key. A row whose pointer names no row keeps it.
    """
    now = materialize(now, "pointers")
    for _ in range(max_rounds):
        up = now.select("conv_id", *[F.col(k).alias(t) for k, t in zip(keys, to)], *[F.col(t).alias(f"next_{t}") for t in to], F.col(total).alias("more"))
        joined = now.join(up, ["conv_id", *to], "left")
        moved = F.col("more").isNotNull()
        new = joined.select(
            "conv_id", *keys,
            *[F.when(moved, F.col(f"next_{t}")).otherwise(F.col(t)).alias(t) for t in to],
            (F.col(total) + F.coalesce("more", F.lit(0))).alias(total), moved.alias("moved"),
        )
        new = materialize(new, "pointers")
        release(now)
        now = new.drop("moved")
        now._quern_path = new._quern_path
        if not new.where("moved").limit(1).count():
            return now
    raise RuntimeError(f"pointers did not settle in {max_rounds} rounds")


def threads(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent)`` -> ``(conv_id, turn, root, depth)``."""
    start = parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    return _double(start, ["turn"], ["root"], "depth")


def places(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, parent)`` -> ``(conv_id, turn, left)``: messages of the thread from this one on, in reply order."""
    nodes = parents.select("conv_id", "turn").unionAll(parents.select("conv_id", F.col("parent").alias("turn"))).distinct()
    after = Window.partitionBy("conv_id", "parent").orderBy("turn")
    kids = parents.select("conv_id", "turn", "parent", F.lead("turn").over(after).alias("sibling"))
    first = parents.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    enter = nodes.join(first, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.lit(0).alias("side"), F.coalesce("child", "turn").alias("to_turn"),
        F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_side"), F.lit(1).cast("long").alias("left"),
    )
    leave = nodes.join(kids, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.lit(1).alias("side"), F.coalesce("sibling", "parent").alias("to_turn"),
        F.when(F.col("sibling").isNull(), 1).otherwise(0).alias("to_side"), F.lit(0).cast("long").alias("left"),
    )
    return _double(enter.unionAll(leave), ["turn", "side"], ["to_turn", "to_side"], "left").where("side = 0").select("conv_id", "turn", "left")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """A row a message: ``conv_id, turn, role, text`` (without quotes), ``parent_turn, root_turn, depth, place, quoted_lines, linked_lines``.

    ``place`` counts from 0 within the thread; sorting by ``(conv_id, root_turn, place)`` is the reply order.
    """
    links = materialize(quote_links(messages), "chat-links")
    by = links.groupBy("conv_id", "turn", "level", "original_turn").agg(F.sum("lines").alias("lines"))
    nearest = by.groupBy("conv_id", "turn").agg(
        F.max(F.struct(-F.col("level"), F.col("lines"), "original_turn")).getField("original_turn").alias("parent"),
        F.sum("lines").alias("linked_lines"),
    )
    nearest = materialize(nearest, "chat-parents")
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("text").cast("string").alias("raw"))

    @F.pandas_udf("text string, quoted long")
    def plain(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"text": [own_text(t) for t in texts], "quoted": [sum(level > 0 for level, _ in parse(t)) for t in texts]})

    if nearest.limit(1).count():
        roots, left = threads(nearest), places(nearest)
        of_root = left.select("conv_id", F.col("turn").alias("root"), F.col("left").alias("all"))
        tree = left.join(roots, ["conv_id", "turn"], "left").withColumn("root", F.coalesce("root", "turn")).join(of_root, ["conv_id", "root"])
        tree = tree.join(nearest, ["conv_id", "turn"], "left").select(
            F.col("conv_id").alias("c"), F.col("turn").alias("t"), "parent", "linked_lines", "root", "depth", (F.col("all") - F.col("left")).alias("place")
        )
        rows = rows.join(tree, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    else:
        none = {c: F.lit(None).cast("long") for c in ("parent", "linked_lines", "root", "depth", "place")}
        rows = rows.withColumns(none)
    return rows.withColumn("p", plain("raw")).select(
        "conv_id",
        "turn",
        "role",
        F.col("p.text").alias("text"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("place", F.lit(0)).cast("long").alias("place"),
        F.col("p.quoted").alias("quoted_lines"),
        F.coalesce("linked_lines", F.lit(0)).cast("long").alias("linked_lines"),
    )


def op8_quote_links(spark, sf_dir):
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
