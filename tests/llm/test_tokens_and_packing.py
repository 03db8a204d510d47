"""Token files and packing: exact round trips against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm import packing, queries, token_output
from textquarry.llm.tokens import Encoder, slices, tokenizer_path

ODD = ["", " ", "  ", "a  b", "a   b", "a \n b", " a", "a ", "a  ", "\n\n x", "a\n  b\tc", "don't  it's 'S IT'S", "x  y", "x 　 y", "á b́", "12 345  6", "<|endoftext|> a", "a\x1c b", "é ñ ß\r\n z", "ΑΣ Σ", "İstanbul ǅ ﬁ", "word... (x) \"y\" $$$ a!!", "naïve,étude;x", "ª º µ", "日本 語", "A" * 3000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def library(name, special_ids=False):
    """The library's own tokenizer, loaded anew, as the vocabularies' description uses it (or as it is loaded)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    if not special_ids:
        tok.encode_special_tokens = True
    return tok


@pytest.fixture(scope="module", params=[("word_bpe_49k.json", False, False), ("byte_bpe_50k.json", True, False), ("word_bpe_49k.json", False, True), ("byte_bpe_50k.json", True, True)])
def enc(request):
    name, keeps, special = request.param
    return Encoder(tokenizer_path(name), keeps, remember=50, special_ids=special), library(name, special)


def agree(enc, texts):
    ids, at = enc[0].encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in enc[1].encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="abAB é'.,!$ \n\t ́Σ1", max_size=25), min_size=1, max_size=6))
def test_encoder_equals_library(enc, texts):
    agree(enc, texts)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=6), st.sampled_from([" ", "#", ".", "İ", "ǰ", "ẞ", "ŉ", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'S"])), max_size=8).map("".join), min_size=1, max_size=4))
def test_encoder_equals_library_on_all_of_unicode(enc, texts):
    agree(enc, texts)


def test_encoder_on_odd_texts(enc):
    agree(enc, [*ODD, None, "İ# İ. Iİ! ŉ. ǰ, İİ", "a<|endoftext|>.b <|startoftext|>", "<|ENDOFTEXT|>. x"])
    assert list(slices(pa.array(["aa", None, "b" * 9, "c"]), 3)) == [(0, 2), (2, 3), (3, 4)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.lists(st.integers(0, (1 << 20) - 1), max_size=50), st.data())
def test_bits_round_trip(bits, values, data):
    ids = np.array(values, np.uint32) % (1 << bits)
    packed = token_output.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    first = data.draw(st.integers(0, len(ids)))
    assert token_output.unpack(packed, bits, len(ids) - first, first).tolist() == ids[first:].tolist()


def rows():
    rng = random.Random(3)
    out = [(k, " ".join(rng.choices(["alpha", "Beta,", "γάμμα", "x1", "--"], k=rng.randint(0, 900))), "en", "s", 0) for k in range(30)]
    return [*out, (7, "repeated id", "en", "s", 0), (None, "no id", None, None, None), (40, None, None, None, None), (41, "w " * 4000, "en", "s", 0), (41, "w " * 4000, "en", "s", 0), (42, "İSTANBUL'DA İ. İ# <|endoftext|> <|startoftext|>.", "en", "s", 0)]


def test_op1(spark, table):
    d = table("documents", rows(), DOCS)
    got = queries.op1_token_output(spark, d).collect()
    tok = library("word_bpe_49k.json")
    digest = lambda t: (len(ids := [*tok.encode(t or "", add_special_tokens=False).ids, 1]), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((r[0] is not None, r[0] or 0, *digest(r[1])) for r in rows())
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)


def test_random_access(spark, table, tmp_path):
    d = table("documents", rows(), DOCS)
    path = str(tmp_path / "tokens")
    token_output.write_tokens(spark.read.parquet(f"{d}/documents.parquet"), path, block_ids=500)
    got = {r["doc_id"]: r["ids"] for r in token_output.read_documents(spark, path, [3, 41, 999]).collect()}
    tok = library("word_bpe_49k.json")
    assert got == {3: [*tok.encode(rows()[3][1], add_special_tokens=False).ids, 1], 41: [*tok.encode("w " * 4000, add_special_tokens=False).ids, 1]}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_is_tightest(lengths):
    where, offset, fill = packing.best_fit(lengths, 16)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):  # the rule itself, by linear search
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(16 - n)
    assert sorted(16 - f for f in fill) == sorted(rooms)
    for w in range(len(fill)):
        held = sorted((offset[k], lengths[k]) for k in range(len(lengths)) if where[k] == w)
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and held[0][0] == 0 and sum(n for _, n in held) == fill[w] <= 16


def test_op8(spark, table):
    d = table("documents", rows(), DOCS)
    got = queries.op8_packing(spark, d).collect()
    tok = library("byte_bpe_50k.json")
    want = []
    for k, text, *_ in rows():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            want.append((str(k), at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at <= 1024


def test_empty_tables(spark, table):
    d = table("documents", [], DOCS)
    assert queries.op1_token_output(spark, d).collect() == [] and queries.op8_packing(spark, d).collect() == []


def test_packing_bounds_what_a_worker_holds(monkeypatch):
    """Many different words: neither the words remembered nor the pieces handed on at once grow with the input."""
    import types

    import pyarrow as pa
    from pyspark import TaskContext

    from textquarry.llm import packing, tokens

    run = {}
    chain = types.SimpleNamespace(select=lambda *c: types.SimpleNamespace(mapInArrow=lambda f, s: run.update(f=f)))
    named = types.SimpleNamespace(cast=lambda t: named, alias=lambda n: named)
    monkeypatch.setattr(packing, "F", types.SimpleNamespace(col=lambda c: named, lit=lambda v: named, coalesce=lambda *c: named))
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda c: types.SimpleNamespace(partitionId=lambda: 0)))
    lent, made = [], tokens.Encoder
    monkeypatch.setattr(tokens, "Encoder", lambda *a: lent.append(made(*a)) or lent[-1])
    tokens._encoder.cache_clear()
    packing.pack_documents(chain)
    texts = [" ".join(f"w{k}x{j}" for j in range(100)) for k in range(6_000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 1000)), pa.array(texts[a : a + 1000])], ["doc_id", "text"]) for a in range(0, 6_000, 1000)]
    most = rows = 0
    for out in run["f"](batches):
        most, rows = max(most, len(lent[0].young) + len(lent[0].old)), max(rows, out.num_rows)
    tokens._encoder.cache_clear()
    assert 100_000 < most <= 220_000 and 0 < rows <= 1_000


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_remembers_parts_of_joined_words_alone(name, keeps):
    """Words with marks behind them, or (in the vocabulary that keeps spaces) line ends inside, come from their parts' ids and take no place of their own."""
    plain = ["Alpha", "beta", "Éa", "naïve", "ouou"]
    texts = [f"{a}{m}\n{b}{n} x" if keeps else f"{a}{m} {b}{n} x" for a in plain for b in plain for m in ("", ".", ",&&&") for n in ("", "?", "%%%")]
    odd = ["a\n\nb c", "a\n b", "a \nb", "a\r\nb c", "1\n2 a", "a\n\nb.\nc d", "\na b", "a\n b\n", "ª\nº x", "a.\n'b c", "é\n.b", "İ\nb ǰ.\na", "\n".join(["a"] * 3000)]
    encoder = Encoder(tokenizer_path(name), keeps)
    agree((encoder, library(name)), texts)
    assert len(encoder.young) <= 3 * len(plain) + 7
    agree((encoder, library(name)), odd)


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_runs_no_python_for_each_known_word(name, keeps):
    """Thousands of joined words whose parts are remembered cost as few Python calls as a handful."""
    import sys

    plain = [a + b + c for a in "abcdefgh" for b in "éiouy" for c in "klmnpqrst"]
    texts = pa.array([f"x {a}{m}\n{b}{n} y" for k, a in enumerate(plain) for b in plain[k : k + 20] for m, n in ((".", ","), ("", "?"))])
    encoder = Encoder(tokenizer_path(name), keeps)
    encoder.encode(texts)
    calls = [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event == "call")))
    try:
        encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert len(texts) > 10_000 and calls[0] < 500
    agree((encoder, library(name)), texts[:500].to_pylist())


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_keeps_words_met_again(name, keeps):
    """New words that come once don't drive out those met in several slices; all that is kept stays within its bound."""
    import itertools
    import types

    letters = itertools.product("bcdfghjk", repeat=5)
    fresh = lambda: [" ".join("".join(x) for x in itertools.islice(letters, 150))]
    common = ["alpha beta gamma delta"]
    encoder, made = Encoder(tokenizer_path(name), keeps, remember=100), []
    model = encoder.model
    encoder.model = types.SimpleNamespace(tokenize=lambda word: made.append(word) or model.tokenize(word))
    for texts in (common, common, *(fresh() for _ in range(6))):
        agree((encoder, library(name)), texts)
        assert len(encoder.young) + len(encoder.old) <= 200
    made.clear()
    agree((encoder, library(name)), common)
    assert made == []


def test_encoder_on_words_that_hold_what_marks_a_cut():
    """A NUL in a word stays in it, beside marks and line ends too."""
    odd = ["a\0b", "a.\0", "a\0.\nb", "\0", "a \0 b.\nc", "a\0\nb", "a.\nb\0", "é\0\0.\n\0é", "ab.\ncd a\0b"]
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        agree((Encoder(tokenizer_path(name), keeps), library(name)), odd * 2)


def test_encoder_on_slices_of_a_batch(enc):
    """Each slice of an array gives the ids of its own texts, as the tasks cut their batches."""
    texts = pa.array([f"{w} Éa{k}.\nBeta, {w * 3}" for k in range(40) for w in ("Alpha", "ŉu", "x")])
    for a in range(0, len(texts), 17):
        ids, at = enc[0].encode(texts.slice(a, 17))
        assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in enc[1].encode_batch(texts.slice(a, 17).to_pylist(), add_special_tokens=False)]
