"""Tokens, mixing and visual forms against brute force and edge cases."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievemark.llm import byte_bpe, mixture, visual_form
from sievemark.llm.byte_bpe import Decoder, Encoder, path_of, vocabulary

tokenizers = pytest.importorskip("tokenizers")
PIECES = ["a", "b", "e", "the", "ing", " ", "  ", "\n", "\t", "'", "'re", "'ll", "1", "23", "é", "日", "=", "==", "-", "<|endoftext|>", "　", "🦴", "İ", "ß", "\r\n", "\x00"]


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(f"{byte_bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library(theirs):
    rng, own = random.Random(3), Encoder(vocabulary(path_of()))
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(200)))
        step = rng.randrange(1, 30)
        assert own.encode(text) == theirs(text)
        assert list(own.stream(text[i : i + step] for i in range(0, len(text), step))) == theirs(text)


@pytest.mark.parametrize("text", ["ab" * 40000, "=" * 20000, " " * 90000 + "x", "1234567890" * 9000, "ing" * 30000 + " the", "\n" * 70000, "日本" * 40000], ids=range(7))
def test_long_words_stream_in_little_memory(theirs, text):
    own = Encoder(vocabulary(path_of()))
    held = 0
    transducer = byte_bpe.WordTransducer(own.vocabulary)
    if not text.isspace():
        for k, _ in enumerate(transducer.feed(text.encode()[:30000])):
            held = max(held, len(transducer.data)) if k % 50 == 0 else held
        assert held < 2048
    assert own.encode(text) == theirs(text)


def test_words_are_cut_alike_by_both_patterns():
    rng, own = random.Random(12), Encoder(vocabulary(path_of()))
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0xD800), 32, 39, 115, 10, 0x1C, 0x85, 0x3000])) for _ in range(rng.randrange(40)))
        assert own.plain.findall(text) == own.words.findall(text)


def test_neighbours_by_definition():
    v, rng = vocabulary(path_of()), random.Random(13)
    v.pairs.clear()
    common = [t for t in range(3000)]
    true = 0
    for k in range(6000):
        a, b = (rng.choice(common), rng.choice(common)) if k % 2 else (rng.randrange(50256), rng.randrange(50256))
        if v.stands(a):
            want = v.merged(v.tokens[a] + v.tokens[b]) == [a, b]
            assert v.neighbours(a, b) == want
            true += want
    assert 300 < true < 5900


def test_looking_ahead_equals_the_transducer():
    v, rng = vocabulary(path_of()), random.Random(14)
    own = Encoder(v)
    for k in range(1500):
        data = bytes(rng.choice([rng.randrange(256), 97, 110, 101, 32]) for _ in range(rng.randrange(1, 60))) if k % 3 else ("".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30)))).encode()
        transducer = byte_bpe.WordTransducer(v)
        assert own.looked_ahead(data) == [*transducer.feed(data), *transducer.finish()] == v.merged(data)


def test_merge_by_definition():
    v = vocabulary(path_of())
    rng, own = random.Random(8), Encoder(v)
    for _ in range(300):
        word = "".join(rng.choice("etaoinsrh") for _ in range(rng.randrange(1, 30)))
        assert list(own.word(word)) == v.merged(word.encode())


def test_decoding_is_the_inverse_and_replaces_broken_bytes():
    v = vocabulary(path_of())
    rng, own, back = random.Random(4), Encoder(v), Decoder(v)
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(80)))
        assert "".join(back.feed(own.encode(text))) + back.finish() == text
        ids = [rng.choice([220, rng.randrange(50256), rng.randrange(256)]) for _ in range(9)]
        assert "".join(back.feed(ids)) + back.finish() == b"".join(v.tokens[i] for i in ids).decode("utf-8", "replace")


def test_token_tables(spark, theirs):
    rows = [(1, None, "x", 9), (2, "", "y", 9), (3, "The film.", "z", 9), (3, "The film.", "z", 9), (None, " ", None, 9), (5, "long " * 40000, "q", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, tokens int")
    got = byte_bpe.token_ids(docs).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got) == sorted((r[0] or 0, len(theirs(r[1] or ""))) for r in rows)
    assert [r.text for r in byte_bpe.decoded(byte_bpe.token_ids(docs)).where("doc_id = 3").collect()] == ["The film."] * 2
    assert byte_bpe.token_ids(docs.limit(0)).count() == 0
    assert byte_bpe.token_counts(docs).columns == ["doc_id", "ids", "tokens"]


def mixed(spark, ws, rows, goals, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens string")
    targets = spark.createDataFrame(goals, "source string, target_weight double, max_repeats int")
    chosen, report = mixture.mixture(docs, targets, ws, **options)
    return {r.doc_id: r for r in chosen.collect()}, {r.source: r for r in report.collect()}


def test_mixture_meets_budgets(spark, ws):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randrange(1, 60), rng.choice(["Big-One ", "big_one", "BIG_ONE", "small", "tiny"] if i % 50 == 0 else ["big_one", "small"]), "x") for i in range(800)]
    rows += [(900, None, "big_one", "x"), (901, "", "small", "x"), (902, "word", None, "x"), (903, "word", "other", "x")]
    chosen, report = mixed(spark, ws, rows, [("big_one", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.0, 1)], total=20000)
    size = {i: len(Encoder(vocabulary(path_of())).encode(t)) for i, t, _, _ in rows}
    assert not {900, 901, 902, 903} & set(chosen)
    for s in ("big_one", "small"):
        assert abs(report[s].taken - report[s].budget) <= 35 and not report[s].falls_short
        counts = Counter(chosen[i].repeats for i in chosen if chosen[i].source == s)
        assert max(counts) - min(counts) <= 1 and max(counts) <= (1 if s == "big_one" else 2)
    tiny = [i for i, _, s, _ in rows if s == "tiny"]
    assert report["tiny"].falls_short and all(chosen[i].repeats == 3 for i in tiny) and report["tiny"].taken == 3 * sum(size[i] for i in tiny)
    assert report["absent"].taken == 0 and sum(r.taken for r in report.values()) == sum(size[i] * c.repeats for i, c in chosen.items())


def test_mixture_of_nothing(spark, ws):
    chosen, report = mixed(spark, ws, [(1, None, None, None)], [("a", 1.0, 2)])
    assert chosen == {} and report["a"].taken == 0 and report["a"].actual_share == 0


def slow_form(tables, text):
    out = "".join(chr(x) for ch in text or "" for x in tables._replacement(ord(ch)))
    lines = out.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return unicodedata.normalize("NFC", "\n".join(re.sub(" +", " ", line).strip(" ") for line in lines))


def test_forms_against_one_by_one():
    rng, tables = random.Random(1), visual_form.Tables()
    pool = "aecşçéạ̧̣̀́̈̂ \n\r\tｶﾞﾊﾟ각각각ﬁⅡ​аеѕ̇İͅἈΐ😀½µ　‑"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(8000)] + [None, "", "x" * 300000, "á" * 50000]
    got = visual_form.visual_forms(pa.array(texts, pa.string()), tables).to_pylist()
    assert got == [slow_form(tables, t) for t in texts]
    part = pa.array(texts, pa.string()).slice(100, 50)
    assert visual_form.visual_forms(part, tables).to_pylist() == got[100:150]
    assert visual_form.visual_forms(pa.array([], pa.string()), tables).to_pylist() == []


def test_what_shows_the_same_and_what_does_not():
    tables = visual_form.Tables()
    form = lambda *t: visual_form.visual_forms(pa.array(list(t), pa.string()), tables).to_pylist()
    same = ["Type II film", "Type Ⅱ film", "Ｔｙｐｅ　II film", "T​yp­e II ﬁlm", "Туре II film", "Type II film "]
    assert len(set(form(*same))) == 1
    for a, b in (("é", "e"), ("A", "a"), ("й", "и"), ("1", "l"), ("½", "1/2"), ("a b", "a\nb"), ("a.", "a"), ("ı", "i"), ("ß", "ss")):
        assert len(set(form(a, b))) == 2
    assert form("soſt") == ["soſt"] and form("ϐ", "ϑ") == ["ϐ", "ϑ"]  # compatibility letters that are drawn otherwise
    assert len(set(form("μ", "µ"))) == 1 and len(set(form("ｶﾞ", "ガ"))) == 1 and len(set(form("a\r\nb", "a\nb"))) == 1


@pytest.mark.parametrize("odd, plain", visual_form.LOOK_ALIKE, ids=range(len(visual_form.LOOK_ALIKE)))
def test_every_listed_letter_folds(odd, plain):
    tables = visual_form.Tables()
    assert visual_form.visual_forms(pa.array([*odd, odd, f"x {odd}"]), tables).to_pylist() == [*plain, plain, f"x {plain}"]


def test_rules_for_styles_and_small_letters():
    tables = visual_form.Tables()
    styled = [chr(c) for c in range(0x1D400, 0x1D7FF) if unicodedata.decomposition(chr(c)).startswith("<font>")]
    got = visual_form.visual_forms(pa.array(styled), tables).to_pylist()
    plain = visual_form.visual_forms(pa.array([unicodedata.normalize("NFKC", c) if c not in "𝛓𝜍𝝇𝞁𝞻" else "ς" for c in styled]), tables).to_pylist()
    same = [a == b for a, b in zip(got, plain, strict=True)]
    assert sum(same) >= 0.95 * len(styled) and got[:26] == [chr(65 + i) for i in range(26)]
    assert visual_form.visual_forms(pa.array(["ᴄᴏꜱᴜᴠᴡᴢ", "﹣﹪", "𝐛𝑜𝟙"]), tables).to_pylist() == ["cosuvwz", "-%", "bo1"]


def test_slices_and_long_texts_give_the_same(monkeypatch):
    rng, tables = random.Random(6), visual_form.Tables()
    texts = ["".join(rng.choice("ab ́é\n 각ﬁ​") for _ in range(rng.randrange(60))) for _ in range(900)] + [None, "é " * 5000]
    whole = visual_form.visual_forms(pa.array(texts, pa.string()), tables).to_pylist()
    monkeypatch.setattr(visual_form, "SLICE", 700)
    assert visual_form.visual_forms(pa.array(texts, pa.string()), visual_form.Tables()).to_pylist() == whole == [slow_form(tables, t) for t in texts]


def test_pairs_that_look_the_same(spark, ws):
    rows = [(1, "film", 1), (2, "ﬁlm", 1), (3, "fіlm", 1), (4, "film", 1), (5, None, 1), (6, "​ ", 1), (7, " ", 1), (8, "other", 1), (None, "ﬁlm", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form int")
    got = {tuple(r) for r in visual_form.same_look_pairs(docs.select("doc_id", "text"), ws).collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    assert visual_form.same_look_pairs(docs.limit(0).select("doc_id", "text"), ws).count() == 0
    assert visual_form.with_visual_form(docs).columns == ["doc_id", "text", "form"]


def test_numbers_of_code_points():
    points, row = visual_form._points(pa.array(["aé", None, "😀", ""], pa.string()))
    assert points.tolist() == [97, 233, 0x1F600] and np.array_equal(row, [0, 0, 2])
