import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from pluvia.llm import bpe, token_blocks as tb, vocabularies
from pluvia.llm.vocabularies import LibraryEncoder, Memory
from tests.llm.helpers import frame, odd_rows, rows_of

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n x  \n\n\ty ", "Hello, World's  <|endoftext|> naïve ΣΑΣ 12 £ x",
    "don't 'S 日本語 İstanbul ﬀ <|startoftext|><|endoftext", "a" * 3000,
    "w　　\n next\x1cb !\x1c?", "a   b", "<|endoftext|> <|endoftext|>x <|endoftext|>",
    "​\x85　x Ᲊ ꟒", "½ ² ① é ̈́",
]


@pytest.fixture(scope="module")
def library():
    made = {}
    for path in (WORDS, BYTES):
        made[path] = Tokenizer.from_file(path)
        made[path].no_truncation()
        made[path].no_padding()
    return made


def ids_of(library, path, text):
    return library[path].encode(text, add_special_tokens=False).ids


def test_bpe_like_the_library(library):
    own = bpe.ForcedBoundaryBpe(WORDS)
    for text in ODD + [r[1] for r in odd_rows() if r[1]]:
        want = ids_of(library, WORDS, text)
        assert own.encode(text).tolist() == want
        decoded = library[WORDS].decode(want, skip_special_tokens=False)
        assert own.decode(np.array(want)) == decoded


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeT' \n\t1éΣ<|>.!　\U0001f600"), max_size=60))
def test_both_encoders_on_any_text(library, text):
    assert bpe.load(WORDS).encode(text).tolist() == ids_of(library, WORDS, text)
    got = np.frombuffer(tb.encoder(BYTES).encode(text), "<u4").tolist()
    assert got == ids_of(library, BYTES, text)


def test_cuts_are_where_no_token_reaches():
    own = bpe.ForcedBoundaryBpe(WORDS)
    tokens = set(own.library.get_vocab())
    letters = bpe.byte_letters()
    cut = 0
    for word in ["zzqxjkvv", "hello", "qwxzßé日", "&&&%%%"]:
        parts = own.fragments_of(word)
        assert bytes(c % 256 for p in parts for c in p) == word.encode()
        for left, right in zip(parts, parts[1:]):
            cut += 1
            pair = letters[left[-1]] + letters[right[0] % 256]
            if right[0] >= 256:
                pair += "</w>"
                assert not any(t.endswith(pair) for t in tokens)
            else:
                assert not any(pair in t.removesuffix("</w>")[: None] and not (
                    t.endswith(pair + "</w>") and t.count(pair) == 1
                ) for t in tokens)
    assert cut


def test_memory_forgets_what_is_not_asked_for():
    calls = []
    memory = Memory(lambda x: calls.append(x) or x, limit=2)
    for word in ["a", "b", "c"]:
        assert memory[word] == word
    memory.make_room()
    assert memory["a"] == "a" and calls == ["a", "b", "c"]
    for word in ["d", "e"]:
        memory[word]
    memory.make_room()
    assert memory["b"] == "b" and calls == ["a", "b", "c", "d", "e", "b"]


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.one_of(st.integers(0, 60000), st.integers(0, 2**32 - 1)), min_size=1, max_size=300)
)
def test_blocks_round_trip(values):
    ids = np.array(values, "<u4")
    assert (tb.decode_block(tb.encode_block(ids)) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(8000, dtype="<u4") % 500 + 70_000
    plain = len(tb.encode_block(ids))
    ids[::100] = 4_000_000_000
    assert len(tb.encode_block(ids)) < plain + 6 * 80 + 8
    assert (tb.decode_block(tb.encode_block(ids)) == ids).all()


def test_reader_finds_any_range(tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 40_000).astype("<u4")
    store = fs.LocalFileSystem()
    with store.open_output_stream(str(tmp_path / "f")) as out:
        writer = tb.Writer(out)
        for i in range(0, len(ids), 1000):
            writer.add(None if i == 3000 else i, ids[i : i + 1000].tobytes())
        size = writer.close()
    assert size == (tmp_path / "f").stat().st_size
    with store.open_input_file(str(tmp_path / "f")) as source:
        reader = tb.Reader(source)
        for a, b in [(0, 1), (8191, 8193), (5, 39_999), (8192, 16_384), (39_999, 40_000), (7, 7)]:
            assert (reader.ids(a, b) == ids[a:b]).all()
        assert reader.nulls.tolist() == [i == 3 for i in range(40)]


def test_files_of_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(tb, "CHUNK", 500)
    rows = odd_rows()
    docs = frame(spark, rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, text, *_ in order:
        ids = np.array([*ids_of(library, BYTES, text or ""), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = rows_of(tb.store_and_check(docs, BYTES, 2), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(want, key=repr)
    assert tb.store_and_check(frame(spark, []), BYTES, 2).count() == 0


def test_read_gives_the_ids(spark, library, tmp_path):
    rows = [(1, "one two", "a", "s"), (2, None, "a", "s")]
    files = tb.write(frame(spark, rows), str(tmp_path), BYTES, 2)
    got = {r.doc_id: r.ids for r in tb.read(files).collect()}
    assert got == {1: [*ids_of(library, BYTES, "one two"), 2], 2: [2]}


def test_digests_of_odd_rows(spark, library):
    rows, want = odd_rows(), []
    for i, text, *_ in rows:
        ids = ids_of(library, WORDS, text or "")
        decoded = library[WORDS].decode(ids, skip_special_tokens=False) if ids else ""
        raw = np.array(ids, "<u4").tobytes()
        want.append(
            (i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        )
    got = rows_of(
        bpe.digests(frame(spark, rows), WORDS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )
    assert got == sorted(want, key=repr)
    assert bpe.digests(frame(spark, []), WORDS).count() == 0


def test_round_trip_keeps_other_columns(spark, library):
    docs = frame(spark, odd_rows())
    got = bpe.round_trip(docs, WORDS)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["n_tokens", "ids", "decoded"]
    texts = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    for r in got.filter("doc_id is not null").collect():
        assert r.ids == ids_of(library, WORDS, texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_other_files_go_to_the_library_whole():
    encoder = LibraryEncoder(WORDS)
    assert not encoder.by_stretch
    want = encoder.library.encode("A b  C", add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode("A b  C"), "<u4").tolist() == want


def test_texts_learned_together(library):
    """Slices of texts, with stretches that were remembered, forgotten and new."""
    encoder = LibraryEncoder(BYTES)
    encoder.known.limit = 40
    texts = ODD + [r[1] for r in odd_rows() if r[1]] + ["a,b, c. d", ",", " ,", "x\n\n, y;", "word, word word."]
    for k in (1, 3, len(texts)):
        for a in range(0, len(texts), k):
            got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_all(texts[a : a + k])]
            assert got == [ids_of(library, BYTES, t) for t in texts[a : a + k]]
    assert encoder.encode_all([]) == []


def test_files_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tb, "CHUNK", 500)
    monkeypatch.setattr(tb, "CHUNKS_A_TASK", 2)
    docs = frame(spark, odd_rows())
    files = tb.write(docs, str(tmp_path / "ids"), BYTES, 2)
    n = files.agg({"ids": "sum"}).first()[0]
    read = tb.read(files)
    assert read.rdd.getNumPartitions() >= n / 1000 > 8
    assert read.count() == docs.count()


def test_a_piece_is_looked_up_once_for_many_texts(library):
    """Not once for each place where it stands."""
    asked = []

    class Counted(Memory):
        def get(self, piece, default=None):
            asked.append(piece)
            return super().get(piece, default)

    encoder = LibraryEncoder(BYTES)
    encoder.known = Counted(encoder._one)
    texts = ["the cat, the dog. été, the" * 50, "", "the cat, a    b", "dog, the cat."] * 20
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_all(texts)]
    assert got == [ids_of(library, BYTES, t) for t in texts]
    assert len(asked) < 20


@settings(max_examples=150, deadline=None)
@given(
    texts=st.lists(
        st.lists(
            st.sampled_from(
                ["a", "é", "Ж", "日", "1", "'s", ".", ",", "!", " ", "  ", "\n", "\xa0", "\x1c", "\u3000",
                 "the", "<|endoftext|>", "\U0001f600", "\u0301"]
            ),
            max_size=12,
        ).map("".join),
        max_size=8,
    ),
    step=st.sampled_from([1, 12, 1 << 22]),
)
def test_many_texts_at_once_on_any_text(library, texts, step):
    encoder = tb.encoder(BYTES)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vocabularies, "STEP", step)
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_all(texts)]
    assert got == [ids_of(library, BYTES, t) for t in texts]
    column = pa.array(["not of the slice ", *texts, None])[1:-1]
    assert [len(b) for b in encoder.encode_column(column)] == [4 * len(ids) for ids in got]
