import random
from array import array

import pytest
import sentencepiece
from docs import ROWS, empty, frame
from sentencepiece import sentencepiece_model_pb2 as pb

from quern.llm import piece_fst as p


@pytest.fixture(scope="module")
def engine():
    return p.Transducer(p.read_model(p.default_model()))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=p.default_model())


def test_equals_the_library(spark, sf_dir, engine, library):
    assert engine.cut and engine.normaliser.renames
    rnd = random.Random(4)
    texts = [t or "" for _, t, *_ in ROWS]
    texts += ["".join(rnd.choice("  ab\n.1é漢🙂▁\t<0x41>s") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    texts += ["hello   world", " ", "    x", "x    ", "<s></s><unk>", "\x00a", "internationalization tokenization"]
    texts += ["a" * 200_000, "Zz9+/" * 30_000, "漢字仮名" * 30_000, "".join(rnd.choice("abcdeé") for _ in range(100_000))]  # no spaces
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text in texts:
        ids = engine.encode(text)
        assert ids.tolist() == library.encode(text), text[:80]
        if p.MARK not in text:
            assert engine.decode(ids) == text == library.decode(ids.tolist())


def test_stability_of_pairs_equals_merging(engine):
    rnd, numbers = random.Random(7), list(engine.id.values())
    for _ in range(20_000):
        left, right = rnd.choice(numbers), rnd.choice(numbers)
        if engine.trees[left] and engine.trees[right]:
            texts = engine.pieces[left], engine.pieces[right]
            merged = tuple(part[0] for part in engine._merges("".join(texts)))
            assert (engine.weight[left * p.SPAN + right] == 0) == (merged == texts)


def test_both_searches_agree_and_settle_in_blocks(engine, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 32)
    rnd = random.Random(9)
    for _ in range(300):
        chunk = "▁" + "".join(rnd.choice("theranoui漢.,") for _ in range(rnd.randint(1, 300)))
        one, other = array("i"), array("i")
        engine._search(chunk, one)
        engine._nearest(chunk, other)
        assert one == other


def test_memories_are_bounded():
    memory = p._Memory(str.upper, 10_000, 16)
    for i in range(5_000):
        assert memory[f"k{i}"] == f"K{i}" and memory["k1"] == "K1"
    assert len(memory) + len(memory.old) < 150
    assert memory["x" * 17] == "X" * 17 and "x" * 17 not in memory


def character_rules():
    model = pb.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    return model.normalizer_spec.precompiled_charsmap


def test_normaliser_equals_the_library():
    blob, rnd = character_rules(), random.Random(2)
    rules = p.character_map(blob)
    for prefix, squeeze in ((True, True), (False, False), (True, False), (False, True)):
        model = pb.ModelProto()
        model.normalizer_spec.precompiled_charsmap = blob
        model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = prefix, squeeze
        library, own = sentencepiece.SentencePieceNormalizer(model_proto=model.SerializeToString()), p.Normaliser(rules, prefix, squeeze)
        for _ in range(500):
            text = "".join(rnd.choice("  ab\t\n１Ａﬁ½é́e①漢㌀ｶﾞ🙂​ Å　x") for _ in range(rnd.randint(0, 20)))
            assert own.run(text) == library.Normalize(text)


def by_hand(kind, squeeze, blob):
    """A model with given pieces and scores."""
    model = pb.ModelProto()
    for piece, score, type_ in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]:
        model.pieces.add(piece=piece, score=score, type=type_)
    for rank, piece in enumerate(["ab", "▁a", "ba", "abab", "▁ab", "▁b", "aba", "bab"]):
        model.pieces.add(piece=piece, score=-1.7 - 0.83 * rank if kind == p.UNIGRAM else -rank)
    for rank, piece in enumerate("▁ab"):
        model.pieces.add(piece=piece, score=-3.1 - 0.47 * rank if kind == p.UNIGRAM else -100 - rank)
    model.trainer_spec.model_type, model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id = kind, 0, 1, 2
    model.normalizer_spec.precompiled_charsmap, model.normalizer_spec.remove_extra_whitespaces = blob, squeeze
    return model.SerializeToString()


@pytest.mark.parametrize("kind", [p.UNIGRAM, p.BPE])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("mapped", [True, False])
def test_other_models_equal_the_library(kind, squeeze, mapped):
    blob = by_hand(kind, squeeze, character_rules() if mapped else b"")
    own, library = p.Transducer(p.read_model(blob)), sentencepiece.SentencePieceProcessor(model_proto=blob)
    rnd = random.Random(6)
    for _ in range(400):
        text = "".join(rnd.choice("aabb  ｂx") for _ in range(rnd.randint(0, 90)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(ids.tolist())


def test_user_pieces_raise():
    model = pb.ModelProto()
    model.ParseFromString(by_hand(p.UNIGRAM, False, b""))
    model.pieces.add(piece="[X]", score=0, type=4)
    with pytest.raises(ValueError):
        p.Transducer(p.read_model(model.SerializeToString()))


def test_rows(spark):
    got = p.encode(frame(spark), p.default_model()).collect()
    assert len(got) == len(ROWS) and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (2, 3)} == {0}
    assert p.encode(empty(spark), p.default_model()).count() == 0
