"""Codec, token counts, personal data and decontamination against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import decontaminate, personal_data, piece_codec, token_cache

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  a b", "a ", "▁x ▁", "the the the", "naïve ﬁ Ａ 🎉\n\ttab  two", "<s> </s> <unk>", "a<|endoftext|>b", "x" * 5000, "a\x00b"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_codec_equals_library(spark):
    rows = list(enumerate(TEXTS * 2))
    docs = spark.createDataFrame([(d, t, "old") for d, t in rows], "doc_id long, text string, n_tokens string")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for slab_bytes, held in ((1, 2), (40, 5), (1 << 20, 1000)):
        got = {r["doc_id"]: r for r in piece_codec.encode_decode(docs, MODEL, slab_bytes=slab_bytes, held=held).collect()}
        assert len(got) == len(rows)
        for d, t in rows:
            ids = model.encode(t or "")
            assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  ▁\n"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_chunks_are_exact(text):
    model = piece_codec._model(MODEL)
    slab = piece_codec.Slab([text, "other a b", None], 3)
    words = piece_codec.in_order(slab.order(), [piece_codec._unpacked(cell) for _, cell in slab.cells()])
    assert len(words) == len(set(words)) and [zlib.crc32(w.encode()) % 3 for w in words] == piece_codec._of_numbers(slab.order()).tolist()
    assert [words[p] for p in piece_codec._of_numbers(slab.places()[0])] == piece_codec.chunks(text)
    lists = piece_codec._id_lists(piece_codec._of_id_lists(piece_codec._segment(model, words)))
    entries = list(zip(lists, piece_codec._decoded(model, lists), strict=True))
    entries = [(",".join(map(str, entries[p][0])), entries[p][1]) for p in piece_codec._of_numbers(slab.places()[0])]
    ids = model.encode(text)
    assert ",".join(e[0] for e in entries) == ",".join(map(str, ids))
    assert "".join(e[1] for e in entries)[1:] == model.decode(ids)


def test_counts_and_cache(spark, tmp_path):
    own = Tokenizer.from_file(BPE)
    docs = spark.createDataFrame([(d, t, 5) for d, t in enumerate(TEXTS * 2)], "doc_id long, text string, n_bytes int")
    expected = sorted((d, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in enumerate(TEXTS * 2))
    path = str(tmp_path / "cache")
    for _ in range(3):
        assert sorted(map(tuple, token_cache.count_tokens(docs, BPE, path).collect())) == expected
    # Null and empty are one content; known contents were not appended again.
    assert spark.read.parquet(path).count() == len(TEXTS) - 1
    more = spark.createDataFrame([(1, "new"), (2, "the the the")], "doc_id long, text string")
    token_cache.count_tokens(more, BPE, path).collect()
    assert spark.read.parquet(path).count() == len(TEXTS)


def test_very_long_texts(spark, tmp_path):
    """Long runs of one kind, through every operator over texts."""
    n = 300_000
    texts = [" " * n, "a" * n, "!?" * (n // 2), "ab " * (n // 3), "\n" * n, "one " * (n // 4), "é" * (n // 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    own, model = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_cache.count_tokens(docs, BPE, str(tmp_path / "c")).collect()}
    pieces = {r["doc_id"]: r["ids_sha256"] for r in piece_codec.encode_decode(docs, MODEL).collect()}
    for d, t in enumerate(texts):
        assert counts[d] == len(own.encode(t, add_special_tokens=False).ids)
        assert pieces[d] == sha(",".join(map(str, model.encode(t))))
    spans = personal_data.find_personal_data(docs).select("spans").distinct().collect()
    assert [r[0] for r in spans] == [""]
    bench = spark.createDataFrame([(1, "a a a a a a b"), (2, "one one one one one one")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, bench).collect()] == [(5, 2)]


def test_text_operators_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert piece_codec.encode_decode(docs, MODEL).collect() == []
    assert token_cache.count_tokens(docs, BPE, str(tmp_path / "c")).collect() == []
    assert personal_data.find_personal_data(docs).collect() == []
    assert personal_data.redact(docs).collect() == []
    assert decontaminate.contaminated_pairs(docs, bench).collect() == []
    full = spark.createDataFrame([(1, "some words of a document here", 3)], docs.schema)
    assert decontaminate.contaminated_pairs(full, bench).collect() == []
    assert decontaminate.drop_contaminated(full, bench).count() == 1


BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            double = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
            good = (
                True,
                all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                14 <= len(digits) <= 19 and (sum(double) + sum(digits[-1::-2])) % 10 == 0,
                10 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from("0123456789..  -@+()aB_%é"), st.sampled_from(["4495114827612972", "1.2.3.4", "+1 (274) 555-9629", "a@b.c", "300.1.1.1"])), max_size=30).map("".join))
def test_base_spans(text):
    assert [tuple(s) for s in personal_data.detect(text)] == plain_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "covered"),
    [
        ("mail john [at] example [dot] com now", 0, "john [at] example [dot] com"),
        ("write to jane dot doe at example dot com", 0, "jane dot doe at example dot com"),
        ("ｊohn＠example．com!", 0, "ｊohn＠example．com"),
        ("call plus one two seven four five five five nine six two nine ok", 3, "plus one two seven four five five five nine six two nine"),
        ("card ４４９５１１４８２７６１２９７２.", 2, "４４９５１１４８２７６１２９７２"),
        ("host 192 dot 168 dot 10 dot 12 is up", 1, "192 dot 168 dot 10 dot 12"),
        ("ask " + "x" * 70 + " at example dot com", 0, "x" * 70 + " at example dot com"),
        ("ask a dot b dot c dot d dot e dot f at example dot com", 0, "a dot b dot c dot d dot e dot f at example dot com"),
        ("card 4495 1148 2761 29 seven two.", 2, "4495 1148 2761 29 seven two"),
        ("write to john at example.com today", 0, "john at example.com"),
        ("ip 10 dot 0 dot 0 dot 1 yes", 1, "10 dot 0 dot 0 dot 1"),
        ("ip 192 . 168 . 0 . 1 yes", 1, "192 . 168 . 0 . 1"),
        ("to john_at_example_dot_com now", 0, "john_at_example_dot_com"),
        ("to john_dot_doe_AT_mail_dot_example_dot_com now", 0, "john_dot_doe_AT_mail_dot_example_dot_com"),
        ("to john at-sign example.com now", 0, "john at-sign example.com"),
        ("to look at sign example dot com now", 0, "look at sign example dot com"),
        ("contact at example.com", 0, "contact at example.com"),
        ("write to john at Example.Com today", 0, "john at Example.Com"),
        ("plus one     two seven four\n\n\n\n\nfive five five nine six two nine", 3, "plus one     two seven four\n\n\n\n\nfive five five nine six two nine"),
    ],
)
def test_disguises_map_back(text, kind, covered):
    base, added = personal_data.find_spans(text)
    assert [(s.kind, text[s.start : s.end]) for s in added if not base] == [(kind, covered)]


@pytest.mark.parametrize(
    ("text", "kind", "plain", "whole"),
    [
        ("to аlice@example.com now", 0, "lice@example.com", "аlice@example.com"),
        ("to alice@mail.exаmple.com now", 0, "alice@mail.ex", "alice@mail.exаmple.com"),
        ("to al\u200bice@example.com now", 0, "ice@example.com", "al\u200bice@example.com"),
        ("at 192.168.1.1０ now", 1, "192.168.1.1", "192.168.1.1０"),
        ("call +1 202 555 017８ now", 3, "+1 202 555 017", "+1 202 555 017８"),
    ],
)
def test_half_disguised(spark, text, kind, plain, whole):
    base, added = personal_data.find_spans(text)
    assert [(s.kind, text[s.start : s.end]) for s in base] == [(kind, plain)]
    assert [(s.kind, text[s.start : s.end]) for s in added] == [(kind, whole)]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert personal_data.redact(docs).first()["text"] == text.replace(whole, f"[{personal_data.KINDS[kind].upper()}]")
    row = personal_data.find_personal_data(docs).first()
    assert (row["n_added"], row["base_sha256"]) == (1, sha(personal_data.written(base)))


SPELLED = "one,five.five,five(two)three,four,five,six,seven,eight"


@pytest.mark.parametrize("text", [f"plus {SPELLED}", f"+{SPELLED}", "+one.five.five.five.two.three.four.five.six.seven.eight", "plus one5 five5,two3,four5,ſix7,eight", "+ONE,FİVE,FIVE,FıVE,TWO,THREE,FOUR,FIVE,SIX,SEVEN,EIGHT"])
def test_spelled_without_spaces(spark, text):
    base, added = personal_data.find_spans(f"call {text} ok")
    assert base == []
    assert 3 in [s.kind for s in added]
    docs = spark.createDataFrame([(1, f"call {text} ok")], "doc_id long, text string")
    assert personal_data.redact(docs).first()["text"].split() == ["call", "[PHONE]", "ok"]


PIECES = ["one", "TWO", "ſix", "fİve", "sıx", "zéro", "fünf", "dot", "at", "plus ", "+", "7", "12", "x", "a1", "the", ",", ".", "-", "(", ")", " ", "\n", "\x1c", "_", "é", "[at]", "(dot)", "poİnt", "@", "。", "\u200b", "８"]


def plain_transducer(text, edits):
    """Each character of the edited text with the source characters it stands for, and whether an edit put it there."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at:
            out += [(text[k][0], text[k][1], text[k][2], text[k][3]) for k in range(at, start)]
            out += [(c, text[start][1], text[end - 1][2], True) for c in new]
            at = end
    return out + text[at:]


@settings(max_examples=600, deadline=None)
@given(st.data())
def test_added_spans_equal_a_plain_transducer(data):
    """Places mapped by bisection are those of a list of characters that carries them along."""
    text = data.draw(st.lists(st.sampled_from([*PIECES, "john", "example", " at ", " dot com", ".com", "_at_x_dot_", " . "]), max_size=40).map("".join))
    cells = [(c, k, k + 1, False) for k, c in enumerate(text)]
    cells = plain_transducer(cells, [(k, k + 1, personal_data._plain(c)) for k, c in enumerate(text) if personal_data._ODD.match(c) and personal_data._plain(c) != c])
    middle = "".join(c[0] for c in cells)
    words = [*personal_data._bracketed(middle), *personal_data._underscored(middle), *personal_data._bare(middle), *personal_data._spelled(middle)]
    cells = plain_transducer(cells, words)
    base = plain_spans(text)
    want = set()
    for start, kind, end in plain_spans("".join(c[0] for c in cells)):
        low, high = cells[start][1], cells[end - 1][2]
        if (any(c[3] for c in cells[start:end]) or high - low > end - start) and not any(k == kind and s <= low and high <= e for s, k, e in base):
            want.add((low, kind, high))
    found = personal_data.find_spans(text)
    assert [tuple(s) for s in found[0]] == base and set(map(tuple, found[1])) == want


def test_memory_of_a_long_disguised_text():
    text = "Elle a un peu de temps, six fois. " * 90_000 + "mail john [at] example [dot] com " + "1 2 3 " * 10_000
    tracemalloc.start()
    base, added = personal_data.find_spans(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [text[s.start : s.end] for s in added] == ["john [at] example [dot] com"] and base == []
    assert len(text) > 3_000_000 and peak < 40_000_000


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.lists(st.sampled_from([w + gap for w in [*PIECES[:8], "7"] for gap in (",", ".", " ", "-", ", ")]), min_size=7, max_size=40).map("".join))
def test_quick_test_passes_every_disguise(text):
    if not personal_data._disguised(text):
        assert "".join(personal_data.rewrite(text).out) == text


@pytest.mark.parametrize("text", ["we met at the dot com of one two three", "Elle est un peu at home. un deux", "four dots at noon", "at 5 [at] noon", "look at example.com now", "he sat at ease.Then left", "it is available at www.example.com"])
def test_plain_prose_has_no_spans(text):
    assert personal_data.find_spans(text) == ([], [])


def test_redaction_and_rows(spark):
    rows = [(1, "x a@b.co y", 10), (2, None, None), (3, "", 0), (3, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, personal_data.redact(docs).collect()), key=str) == sorted([(1, "x [EMAIL] y", 11), (2, None, None), (3, "", 0), (3, "clean", 5)], key=str)
    got = personal_data.find_personal_data(docs).where("doc_id = 1").first()
    assert (got["n_email"], got["spans"], got["base_sha256"]) == (1, "email:2:8", sha("email:2:8"))


def slow_tiles(a, b, least):
    """Greedy string tiling by trying all pairs of places."""
    marked_a, marked_b, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        marked_a |= set(range(i, i + n))
        marked_b |= set(range(j, j + n))
        covered += n


def test_tiles_cover_as_plain_tiling_does():
    rng = random.Random(3)
    for _ in range(150):
        item = [rng.randrange(1, 6) for _ in range(rng.randint(3, 25))]
        doc = [rng.randrange(1, 6) for _ in range(rng.randint(0, 20))] + item[len(item) // 2 :] + [9] + item[: len(item) // 2]
        found = decontaminate.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert all(doc[i : i + n] == item[j : j + n] for i, j, n in found)
        used = [p for _, j, n in found for p in range(j, j + n)]
        assert len(used) == len(set(used))
        assert len(used) == slow_tiles(doc, item, 3)


def slow_pairs(rows, items, coverage=0.6, least=5):
    """All pairs, by plain tiling of whole token lists."""
    cut = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    out = []
    for d, text in rows:
        for i, item in items:
            a, b = cut(text), cut(item)
            covered = slow_tiles(a, b, min(least, len(b))) if b else 0
            if b and covered >= coverage * len(b) and covered:
                out.append((d, i, len(b), covered))
    return sorted(out)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 20, 40, 65])]
    rows = []
    for d in range(60):
        parts = [rng.choice(items)[1].split() for _ in range(2)]
        words = [w for p in parts for w in (p[len(p) // 2 :] + [f"x{d}"] + p[: len(p) // 2] if rng.random() < 0.5 else p)]
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = "z"
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(60, None), (61, ""), rows[0]]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id int, text string, item_id int, covered string")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, doc_id int")
    got = decontaminate.contaminated_pairs(docs, bench)
    assert dict(got.dtypes)["item_id"] == "int"
    assert sorted((r["doc_id"], r["item_id"], r["item_tokens"], r["covered"]) for r in got.collect()) == slow_pairs(rows, items)


@pytest.mark.parametrize("n", [65, 500, 5000])
def test_long_items(spark, n):
    words = [f"w{k}" for k in range(n)]
    item = " ".join(words)
    rows = [(1, item), (2, " ".join(words[n // 2 :] + ["and"] + words[: n // 2])), (3, " ".join(words[: n // 2])), (4, "the " * n)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.contaminated_pairs(docs, bench).collect()
    assert sorted((r["doc_id"], r["covered"], r["tiles"]) for r in got) == [(1, n, 1), (2, n, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [3, 4]


def test_reordered_passages_are_caught(spark):
    words = [f"w{k}" for k in range(30)]
    item = " ".join(words)
    rows = [(1, "intro " + item.upper() + ", end"), (2, " ".join(words[15:] + ["and"] + words[:15])), (3, " ".join(words[:12])), (4, None), (5, "tiny QUESTION here"), (5, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "tiny question"), (9, None), (10, "...")], "item_id long, text string")
    for block in (1 << 20, 40):
        got = decontaminate.contaminated_pairs(docs, bench, block_bytes=block).collect()
        assert sorted((r["doc_id"], r["item_id"], r["tiles"]) for r in got) == [(1, 7, 1), (2, 7, 2), (5, 7, 1), (5, 8, 1)]
        assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench, block_bytes=block).collect()) == [3, 4]
