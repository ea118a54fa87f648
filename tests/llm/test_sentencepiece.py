import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import sentencepiece_codec as s

PIECES = ["a", "the", " ", "  ", "é", "😀", "▁", "\n", "\t", "ab", "ing", "x" * 40, "　", "梦", "\x00", "hello world"]


@pytest.fixture(scope="module")
def vocabulary():
    return s.load()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_round_trip(text):
    v = test_round_trip.v = getattr(test_round_trip, "v", None) or s.load()
    assert s.decode(s.Encoder(v).encode([text])[0], v.surfaces) == text


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=s.DEFAULT_MODEL)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=" abcdehinrstuy.,0123459éßñ梦の😀\n\t", max_size=60), st.text(max_size=30), st.lists(st.sampled_from(PIECES), max_size=14).map("".join)))
def test_ids_are_the_library_s(library, vocabulary, text):
    text = text.replace("▁", "")
    assert s.Encoder(vocabulary).encode([text])[0] == library.encode(text)


def test_ids_of_all_documents_are_the_library_s(library, vocabulary):
    import duckdb

    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    own = s.Encoder(vocabulary).encode(texts)
    assert len(texts) == 1000 and [i for i, t in enumerate(texts) if "▁" not in t and own[i] != library.encode(t)] == []


def test_runs_of_spaces(library, vocabulary):
    texts = [" " * k + w for k in range(70) for w in ("", "the", "7", "梦")]
    assert s.Encoder(vocabulary).encode(texts) == [library.encode(t) for t in texts]


def test_long_units(library, vocabulary):
    import random
    import time

    r = random.Random(4)
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "的一是不了人我在有他这中大来上国", "a", "ab", "=", "é梦x"):
        text = "".join(r.choice(alphabet) for _ in range(30_000))
        assert s.Encoder(vocabulary).encode([text])[0] == library.encode(text), alphabet
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.perf_counter()
    ids = s.Encoder(vocabulary).encode([text])[0]
    assert time.perf_counter() - began < 60 and s.decode(ids, vocabulary.surfaces) == text


def test_every_kind_of_code_point_comes_back(vocabulary):
    points = [*range(0x500), *range(0x2570, 0x2590), *range(0xD7F0, 0xD800), *range(0xE000, 0xE010), *range(0xFDC8, 0xFDF8), *range(0xFFF0, 0x10010), 0x1FFFE, 0x1F600, 0x10FFFF]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} " for c in points]
    v = vocabulary
    assert [s.decode(i, v.surfaces) for i in s.Encoder(v).encode(texts)] == texts


def test_unigram_scores_are_summed(vocabulary, tmp_path):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(s.DEFAULT_MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(m.SerializeToString())
    unigram = SentencePieceProcessor(model_proto=m.SerializeToString())
    words = ["hello", "the", "reading", "quite", "antidisestablishment", "zebra", "hend", "world", "thereon", "running", "ouvert", "straße"]
    assert s.Encoder(s.load(str(tmp_path / "m"))).encode(words) == [unigram.nbest_encode_as_ids(w, 2)[0] for w in words]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(open(s.DEFAULT_MODEL, "rb").read())
    m.trainer_spec.model_type = 3
    (tmp_path / "m").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        s.load(str(tmp_path / "m"))


def test_memory_of_units_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(s, "REMEMBERED", 3)
    e = s.Encoder(vocabulary)
    for i in range(9):
        e.encode([f"w{i}"])
    assert len(e.known) <= 4 and len(e.old) <= 6


def test_hard_rows(spark, hard_rows, no_rows):
    out = s.encode(hard_rows)
    assert out.count() == hard_rows.count() and out.filter("NOT exact").count() == 0 and out.filter("n_ids = 0").count() == hard_rows.filter("coalesce(text, '') = ''").count()
    back = s.decode_rows(out).groupBy("text").count().collect()
    assert {r["text"]: r["count"] for r in back} == {r["t"]: r["count"] for r in hard_rows.selectExpr("coalesce(text, '') AS t").groupBy("t").count().collect()}
    assert s.encode(no_rows).count() == 0 and s.decode_rows(out.limit(0)).count() == 0
