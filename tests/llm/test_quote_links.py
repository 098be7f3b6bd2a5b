import random
from collections import Counter

from pyspark.sql import functions as F

from quern.llm import quote_links as c

SCHEMA = "conv_id long, turn long, role string, text string, level string"


def test_parse():
    assert c.parse(">> a\n> >b\n>  c\nd > e\n>") == [(2, "a"), (2, "b"), (1, " c"), (0, "d > e"), (1, "")]
    assert c.own_text("> q\n\nmy answer\n\n> r\n") == "my answer" and c.own_text(None) == "" and c.own_text("\na\n") == "\na\n"


def test_threads_links_and_order(spark):
    rows = [
        (1, 0, "user", "First question here\nwith two lines"),
        (1, 1, "user", "Another topic"),
        (1, 2, "assistant", "> FIRST  question here\n> with two lines\nAn answer"),
        (1, 3, "assistant", ">Another topic\nElse"),
        (1, 4, "user", ">> first question here\n> An answer\nThanks"),
        (1, 5, "user", "> never said\n> my own line\nmy own line"),
        (2, 0, "user", "> First question here\nother conversation"),
        (3, 0, "user", "same"),
        (3, 1, "user", "same"),
        (3, 2, "user", "> same\nok"),
        (None, 1, "user", "> same"),
        (4, None, "user", "> same"),
        (5, 0, None, None),
        (5, 1, "user", ""),
        (5, 1, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = c.reply_ordered(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    tree = {k: (r.parent_turn, r.root_turn, r.depth, r.quoted_lines, r.linked_lines) for k, r in by.items()}
    assert tree[1, 2] == (0, 0, 1, 2, 2) and tree[1, 3] == (1, 1, 1, 1, 1)
    assert tree[1, 4] == (2, 0, 2, 2, 2) and by[1, 4].text == "Thanks"
    assert tree[1, 5] == (None, 5, 0, 2, 0) and tree[2, 0] == (None, 0, 0, 1, 0)
    assert tree[3, 2] == (1, 1, 1, 1, 1) and tree[None, 1][0] is None and tree[4, None][0] is None
    assert by[5, 0].text == "" and sum(r.conv_id == 5 for r in got) == 3
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.root_turn, r.place))]
    assert order == [0, 2, 4, 1, 3, 5]
    assert c.reply_ordered(df.where(F.lit(False))).count() == 0


def test_long_reply_chain(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 50)]
    got = c.reply_ordered(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    assert all(r.root_turn == 0 and r.depth == r.turn == r.place for r in got)


def plain(rows):
    """``{(conv, turn): (parent, root, depth, place, linked lines)}`` message by message."""
    texts = {(r[0], r[1]): r[3] for r in rows}
    parent, linked = {}, Counter()
    for (conv, turn), text in texts.items():
        found = Counter()
        for level, lines, held in c.passages(text):
            earlier = [t for k, t in texts if k == conv and t < turn]
            exact = [t for t in earlier if " ".join(held) in c.units(texts[conv, t])]
            if exact:
                origin = max(exact)
            else:
                votes = Counter()
                for w in set(c.windows(held)) if len(held) > c.WINDOW else ():
                    at = [t for t in earlier if w in c.windows(c.own_words(texts[conv, t]))]
                    votes.update(at and [max(at)])
                if not votes:
                    continue
                origin = max(votes, key=lambda t: (votes[t], t))
                if votes[origin] * 2 < len(c.windows(held)):
                    continue
            found[level, origin] += lines
            linked[conv, turn] += lines
        if found:
            parent[conv, turn] = max((-level, lines, t) for (level, t), lines in found.items())[2]
    kids = {}
    for (conv, turn), up in parent.items():
        kids.setdefault((conv, up), []).append(turn)
    out = {}

    def walk(conv, turn, root, depth, place):
        out[conv, turn] = (parent.get((conv, turn)), root, depth, place, linked[conv, turn])
        for kid in sorted(kids.get((conv, turn), [])):
            place = walk(conv, kid, root, depth + 1, place + 1)
        return place

    for conv, turn in texts:
        if (conv, turn) not in parent:
            walk(conv, turn, turn, 0, 0)
    return out


def test_generated_conversations_against_plain_version(spark):
    """Nested, re-wrapped, partly quoted and repeated passages, and a conversation that holds a third of all messages."""
    rnd, vocabulary = random.Random(11), [f"w{i}" for i in range(400)]
    rows = []
    for conv in range(9):
        said = []
        for turn in range(60 if conv == 0 else 15):
            lines = []
            if said and rnd.random() < 0.75:
                for _ in range(rnd.choice((1, 1, 2))):
                    back = rnd.choice(said)
                    quote = [line for level, line in c.parse(back) if not level] or [back]
                    words_ = " ".join(quote).split()
                    how = rnd.random()
                    if how < 0.3:  # wrapped anew
                        quote = [" ".join(words_[i : i + 5]) for i in range(0, len(words_), 5)]
                    elif how < 0.6 and len(words_) > 14:  # a part of it
                        start = rnd.randrange(3)
                        quote = [" ".join(words_[start : start + 12])]
                    elif how < 0.7:
                        quote = ["never said " + " ".join(rnd.choices(vocabulary, k=12))]
                    level = rnd.choice((1, 1, 1, 2, 3))
                    lines += [rnd.choice((">", "> ")) * level + line.upper() for line in quote]
            lines += [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 12))) for _ in range(rnd.randint(1, 3))]
            if rnd.random() < 0.3:
                lines.append("ok")
            said.append("\n".join(lines))
            rows.append((conv, turn, "u", said[-1]))
    got = c.reply_ordered(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()
    want = plain(rows)
    assert {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.place, r.linked_lines) for r in got} == want
    assert sum(w[0] is not None for w in want.values()) > 60 and max(w[2] for w in want.values()) > 3
