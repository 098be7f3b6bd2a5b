"""SentencePiece encoding as the shortest path through composed weighted transducers.

Four machines are compiled from a model file, all plain data:

* the normaliser: rewriting rules (the model's own map of characters, and spaces, which
  become the mark U+2581), an initial arc that emits a mark, and the removal of extra spaces;
* the pieces: a trie of states whose final states emit a piece and go back to the start;
* byte fallback: a character that is no piece emits its UTF-8 bytes, one arc a byte;
* the weights, a machine over pieces in the tropical semiring (weights add along a path, the
  least path wins). Unigram: one state, a piece weighs its negated score. BPE: scores order
  merges and can't be summed; the state is the last piece, and an arc weighs 0 if that piece and
  the next are stable (merging both pieces' characters by the model's order gives the two back) and
  infinity if not. Merges never cross the result's borders, so the BPE result has only stable
  pairs; and were another path stable throughout, the first merge across one of its borders would
  happen in that pair alone too. One path has weight 0 then, and it is the BPE encoding.

A normaliser that only renames characters is composed with the pieces when compiling, so that machine
reads raw text; any other is run over the text first. Composing with the input gives a lattice without
cycles, expanded lazily; :meth:`Transducer._search` relaxes its arcs place by place, the same for both
kinds of models. Stable paths to a place are its prefix's encoding, so each place has one state.

Whether a pair is stable follows from the two merge trees along the border: undo the later merge again and
again; the pair is unstable if two neighbours that existed together could have merged before either did
otherwise. Where ranks tie, or a piece outranks its own parts, the merges are carried out instead.

If no piece has the mark after another character and none holds a character that is no piece (checked
when compiling), texts fall apart into chunks, marks and what follows (a word's letters apart from signs after them, where no
piece holds both), that are encoded alone and remembered.
Memories are bounded in bytes and keep the entries of the last two generations; chunks of more than
``KEEP`` characters are not remembered. Longer ones are searched in blocks: where the paths to all open
places agree, what is settled is written out, so memory doesn't grow with a text without spaces.

Decoding runs the machines the other way.

Defined results: null and empty texts have no pieces; repeated rows are rows of their own; null
doc_ids pass through; a text that holds U+2581 itself decodes to a space there, as the model
file defines; other columns are ignored. Models with user-defined pieces, or unigram scores above 0, raise.
"""

from __future__ import annotations

import re
import struct
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")
#: Above any piece's number: a pair is left * SPAN + right; START stands for "no piece to the left".
SPAN = 1 << 24
START = SPAN - 1
CHUNK_BYTES, PAIR_BYTES, KEEP = 64 << 20, 24 << 20, 64
SEGMENT, BLOCK = 1 << 20, 1 << 15


def read_model(source: str | bytes) -> dict:
    """Pieces, scores, types and normaliser of a model file (or its bytes), as plain values."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    if isinstance(source, str):
        with open(source, "rb") as f:
            source = f.read()
    model.ParseFromString(source)
    return {
        "pieces": [p.piece for p in model.pieces],
        "scores": [p.score for p in model.pieces],
        "types": [p.type for p in model.pieces],
        "kind": model.trainer_spec.model_type,
        "unknown": model.trainer_spec.unk_surface,
        "rules": character_map(model.normalizer_spec.precompiled_charsmap),
        "prefix": model.normalizer_spec.add_dummy_prefix,
        "squeeze": model.normalizer_spec.remove_extra_whitespaces,
    }


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of keys, then the outputs, each ended by 0."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, outputs = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
    base = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)  # noqa: E731  offset to a state's arcs
    rules, todo = {}, [(base(units[0]), b"")]
    while todo:
        state, key = todo.pop()
        for byte in range(1, 256):
            at = state ^ byte
            if at >= len(units) or units[at] & (1 << 31 | 0xFF) != byte:
                continue
            following, longer = at ^ base(units[at]), key + bytes([byte])
            if units[at] >> 8 & 1:  # a key ends here; its value stands on the arc labelled 0
                start = units[following] & 0x7FFFFFFF
                rules[longer.decode()] = outputs[start : outputs.index(b"\0", start)].decode()
            todo.append((following, longer))
    return rules


class _Memory(dict):
    """Computed values by key, at most two generations of ``limit`` bytes; ``keep`` bounds a key's length."""

    def __init__(self, make, limit: int, keep: int | None = None):
        self.make, self.limit, self.keep = make, limit, keep
        self.held, self.old = 0, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if self.keep is not None and len(key) > self.keep:
            return found
        self.held += sys.getsizeof(key) + (sys.getsizeof(found) if self.keep else 0) + 110  # 110: the table's share
        if self.held > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = found
        return found


class Normaliser:
    """A transducer over characters: the longest rule that matches is taken, any other character is copied."""

    def __init__(self, rules: dict[str, str], prefix: bool, squeeze: bool):
        self.prefix, self.squeeze = prefix, squeeze
        self.arcs: dict = {}
        for key, out in ({" ": MARK} | {k: v.replace(" ", MARK) for k, v in rules.items()}).items():
            state = self.arcs
            for c in key:
                state = state.setdefault(c, {})
            state[""] = out
        #: Each rule renames one character: the machine has one state and can be composed beforehand.
        self.renames = not squeeze and all(set(to) == {""} and len(to[""]) == 1 for to in self.arcs.values())

    def run(self, text: str) -> str:
        out, i, n, arcs = [], 0, len(text), self.arcs
        while i < n:
            state, j, end, wrote = arcs, i, i + 1, text[i]
            while j < n and (state := state.get(text[j])) is not None:
                j += 1
                if "" in state:
                    end, wrote = j, state[""]
            out.append(wrote)
            i = end
        text = "".join(out)
        if self.squeeze:
            text = re.sub(f"{MARK}+", MARK, text).strip(MARK)
        return MARK + text if self.prefix and text else text


class Transducer:
    def __init__(self, model: dict):
        self.model = model
        types, scores, self.kind = model["types"], model["scores"], model["kind"]
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if USER in types:
            raise ValueError("user-defined pieces aren't supported")
        self.normaliser = Normaliser(model["rules"], model["prefix"], model["squeeze"])
        self.pieces, self.unknown = model["pieces"], types.index(UNKNOWN)
        self.id = {p: i for i, (p, t) in enumerate(zip(self.pieces, types)) if t in (NORMAL, UNUSED)}
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, types)) if t == BYTE}
        least = min(s for s, t in zip(scores, types) if t == NORMAL)
        self.penalty = 10.0 - least
        if self.kind == UNIGRAM and max(scores[i] for i in self.id.values()) > 0:
            raise ValueError("a piece weighs less than 0")
        # the pieces' trie: {character: state}, "" holds the piece a final state emits
        self.arcs: dict = {}
        for piece, i in self.id.items():
            state = self.arcs
            for c in piece:
                state = state.setdefault(c, {})
            state[""] = i
        self.longest = max(map(len, self.id))
        singles = {p for p in self.id if len(p) == 1}
        apart = all(MARK not in p.lstrip(MARK) and (len(p) == 1 or set(p) <= singles) for p in self.id)
        self.blank = {MARK}
        if self.normaliser.renames:
            names = {c: to[""] for c, to in self.normaliser.arcs.items()}
            self._compose(self.arcs, names)
            self.blank |= {c for c, y in names.items() if y == MARK}
        # an empty input has no path but the empty one; otherwise the first arc emits a mark
        self.initial = MARK if self.normaliser.renames and model["prefix"] else ""
        blank, lone = "".join(sorted(self.blank)), "" if "\n" in self.arcs else "\n"
        # letters that no piece holds before any of its signs: a border between both is never crossed
        signs = {c for c in singles if not c.isalnum()} - self.blank
        letters = {c for c in singles if c.isalnum()} - {a for p in self.id for a, b in zip(p, p[1:]) if b in signs}
        some, other = (re.escape("".join(sorted(x))) for x in (letters, signs))
        words = f"[{blank}]*[{some}]++(?=[{blank}{lone}{other}]|\\Z)|" if letters and signs else ""
        self.cut = re.compile(f"{words}[{blank}]*[^{blank}{lone}]+|[{blank}]+" + ("|\n" if lone else "")) if apart else None
        self.border = re.compile(f"[^{blank}][{blank}]")
        self.weight = _Memory(self._stability if self.kind == BPE else self._score, PAIR_BYTES)
        self.trees = _Memory(self._tree, PAIR_BYTES)
        self.chunks = _Memory(self._chunk, CHUNK_BYTES, KEEP)
        self.surface = [p.replace(MARK, " ").encode() if t in (NORMAL, UNUSED) else b"" for p, t in zip(self.pieces, types)]
        self.surface[self.unknown] = model["unknown"].encode()
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])

    def __reduce__(self):
        return Transducer, (self.model,)

    def _compose(self, state: dict, names: dict[str, str]) -> None:
        """Renaming arcs x:y before the trie's arcs y: each state that reads y then reads x as well."""
        for c, to in list(state.items()):
            if c:
                self._compose(to, names)
        arcs = {x: state[y] for x, y in names.items() if y in state}
        for x in names:
            state.pop(x, None)
        state.update(arcs)

    # the weights' machine

    def _score(self, key: int) -> float:
        piece = key % SPAN
        return self.penalty if piece == self.unknown else -self.model["scores"][piece]

    def _merges(self, text: str) -> list[tuple]:
        """BPE by the model's order: the best-scored pair first, the leftmost of equals; each part is (piece, left, right)."""
        parts, score, ids = [(c, None, None) for c in text], self.model["scores"], self.id
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = ids.get(parts[i][0] + parts[i + 1][0])
                if j is not None and (best is None or score[j] > best):
                    best, at = score[j], i
            if best is None:
                break
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], parts[at], parts[at + 1])]
        return parts

    def _tree(self, piece: int) -> tuple:
        """Both spines of a piece's merge tree, outermost last merge first: ``(text, time of its merge)``; or () if it can't be merged.

        A time is the negated score, -inf for a character; None marks a piece that outranks one of its parts.
        """
        parts = self._merges(self.pieces[piece])
        if len(parts) > 1:
            return ()
        sides = []
        for side in (2, 1):
            node, spine = parts[0], []
            while node is not None:
                time = -INFINITE if node[1] is None else -self.model["scores"][self.id[node[0]]]
                spine.append((node[0], time))
                node = node[side]
            sides.append(spine)

        def in_order(node):
            if node[1] is None:
                return -INFINITE
            time = -self.model["scores"][self.id[node[0]]]
            below = [in_order(node[1]), in_order(node[2])]
            return None if None in below or max(below) >= time else time

        return (*sides, in_order(parts[0]) is not None)

    def _stability(self, key: int) -> float:
        """0 if ``left`` and ``right`` stay two pieces next to each other, else infinity."""
        left, right = divmod(key, SPAN)
        if right == self.unknown:
            return 0.0
        after = self.trees[right]
        if left == START or not after:
            return 0.0 if after else INFINITE
        before = self.trees[left]
        if not before:
            return INFINITE
        if before[2] and after[2]:
            found = self._along(before[0], after[1])
            if found is not None:
                return found
        texts = self.pieces[left], self.pieces[right]
        return 0.0 if tuple(p[0] for p in self._merges("".join(texts))) == texts else INFINITE

    def _along(self, ends: list, starts: list) -> float | None:
        """The same from the two spines at the border; None where times tie or come out of order."""
        i = j = 0
        gone_left = gone_right = INFINITE
        ids, scores = self.id, self.model["scores"]
        while True:
            (a, born_a), (b, born_b) = ends[i], starts[j]
            both = ids.get(a + b)
            if both is not None:
                time, gone = -scores[both], min(gone_left, gone_right)
                if time <= max(born_a, born_b) or time == gone:
                    return None
                if time < gone:
                    return INFINITE
            if born_a == born_b:
                if born_a == -INFINITE:
                    return 0.0
                return None
            if born_a > born_b:
                gone_left, i = born_a, i + 1
            else:
                gone_right, j = born_b, j + 1

    # composition with an input, and its shortest path

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one chunk as 32-bit numbers."""
        out = array("i")
        (self._nearest if self.kind == BPE and len(chunk) <= KEEP else self._search)(chunk, out)
        return out.tobytes()

    def _nearest(self, chunk: str, out: array) -> None:
        """The same path as :meth:`_search` finds where weights are 0 or infinite: open arcs are queued by the place they
        lead to, the farthest is taken first, and its weight is looked up only then."""
        n, root, weight, unknown = len(chunk), self.arcs, self.weight, self.unknown
        back, via = [-1] * (n + 1), [START] * (n + 1)
        queue: list = [[] for _ in range(n + 1)]
        i = back[0] = 0
        while i < n:
            state, j = root, i
            while j < n:
                state = state.get(chunk[j])
                if state is None:
                    break
                j += 1
                if "" in state:
                    queue[j].append((i, state[""]))
            if chunk[i] not in root or "" not in root[chunk[i]]:  # a character that is no piece
                queue[i + 1].append((i, START))
            to = n
            while True:
                while not queue[to] or back[to] >= 0:
                    to -= 1
                before, piece = queue[to].pop()
                if not weight[via[before] * SPAN + (unknown if piece == START else piece)]:
                    break
            back[to], via[to] = before, piece
            i = to
        self._write(chunk, 0, n, 0, back, via, out)

    def _search(self, chunk: str, out: array) -> None:
        """Append the ids on the shortest path: arcs of the composed machine are relaxed in the order of places."""
        n, root, weight, bpe, unknown = len(chunk), self.arcs, self.weight, self.kind == BPE, self.unknown
        base = 0  # place that the lists start with
        far = [0.0] + [INFINITE] * min(n, BLOCK)
        back, via = [0] * len(far), [START] * len(far)
        reach = self.longest
        for i in range(n):
            at = i - base
            if at + reach >= len(far) <= n - base:  # an arc may lead beyond the lists
                base = self._settle(chunk, i, base, far, back, via, out)
                at = i - base
                grow = min(n - base, at + reach + BLOCK) + 1 - len(far)
                far += [INFINITE] * grow
                back += [0] * grow
                via += [START] * grow
            d = far[at]
            if d == INFINITE:
                continue
            last = via[at] * SPAN if bpe else 0
            state, j, single = root, i, False
            while j < n:
                state = state.get(chunk[j])
                if state is None:
                    break
                j += 1
                piece = state.get("")
                if piece is not None:
                    single = single or j == i + 1
                    w = d + weight[last + piece]
                    to = j - base
                    if w < far[to]:
                        far[to], back[to], via[to] = w, i, piece
            if not single:  # a character that is no piece
                w = d + weight[last + unknown]
                if w < far[at + 1]:
                    far[at + 1], back[at + 1], via[at + 1] = w, i, START
        self._write(chunk, base, n, base, back, via, out)

    def _settle(self, chunk, i, base, far, back, via, out) -> int:
        """Write out what the paths to all open places share, and drop it from the lists; the new base."""
        live = {base + at for at in range(i - base, len(far)) if far[at] < INFINITE}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(back[top - base])
        (shared,) = live
        if shared > base:
            self._write(chunk, base, shared, base, back, via, out)
            for held in (far, back, via):
                del held[: shared - base]
            least = far[0]
            far[:] = [w - least for w in far]
        return shared

    def _write(self, chunk, start, end, base, back, via, out) -> None:
        steps = []
        while end > start:
            steps.append((back[end - base], end, via[end - base]))
            end = steps[-1][0]
        for lo, hi, piece in reversed(steps):
            if piece != START:
                out.append(piece)
            elif self.byte:
                out.extend(self.byte[b] for b in chunk[lo:hi].encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.normaliser.renames:
            text = self.normaliser.run(text)
        elif text:
            text = self.initial + text
        if self.cut is None:
            return np.frombuffer(self._chunk(text), dtype=np.int32)
        found, at, n = [], 0, len(text)
        while at < n:
            end = self.border.search(text, at + SEGMENT) if n - at > SEGMENT else None
            stop = end.start() + 1 if end else n
            found.append(b"".join(map(self.chunks.__getitem__, self.cut.findall(text, at, stop))))
            at = stop
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def readable(self, text: str | None) -> str:
        """The normalised text with spaces for marks: what its ids must decode to."""
        if self.normaliser.renames:
            return (text or "").replace(MARK, " ")
        text = self.normaliser.run(text or "").replace(MARK, " ")
        return text[1:] if self.model["prefix"] and text[:1] == " " else text

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        parts = [b"".join(map(self.surface.__getitem__, ids[at : at + SEGMENT].tolist())) for at in range(0, len(ids), SEGMENT)]
        text = b"".join(parts).decode("utf-8", "replace")
        return text[1:] if self.model["prefix"] and text[:1] == " " else text


def encode(docs: DataFrame, model_path: str, check: bool = True, step: int = 64) -> DataFrame:
    """``(doc_id, n_pieces, ids, round_trip)``: ``round_trip`` says that the ids decode to the normalised text again.

    ``model_path`` is read on the driver; the pieces (about 1 MB) are sent to the workers.
    ``step`` documents are written out together. Without ``check``, ``round_trip`` is null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Transducer(read_model(model_path)))
    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches):
        engine = sent.value
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, step):
                part = texts.slice(lo, step).to_pylist()
                ids = [engine.encode(t) for t in part]
                size = np.array([len(x) for x in ids], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)))
                whole = [engine.decode(x) == engine.readable(t) if check else None for x, t in zip(ids, part)]
                yield pa.RecordBatch.from_arrays([docs_.slice(lo, step), pa.array(size), lists, pa.array(whole, pa.bool_())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def default_model() -> str:
    """The installed 32k BPE model's place; any other path may be given instead."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op10_piece_fst(spark, sf_dir):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
