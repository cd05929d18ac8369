"""Encoding, leaks and sentences on small texts, with round trips and brute force."""

import datetime as dt
import os
import random

import pytest

from fellscape.llm.leaks import leaked_items
from fellscape.llm.sentences import Model, blocks, boundaries, gaps, sentences, split_text
from fellscape.llm.tokens import VOCABULARY, decode_corpus, encode_corpus

NOW = dt.datetime(2024, 1, 1)


def documents(spark, texts):
    rows = [(i, t, "en", NOW, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]] if rows else [], "doc_id BIGINT, text STRING, lang STRING, created_at TIMESTAMP, ids STRING")


TEXTS = [
    "The cell's fate: 12 neighbours, it'll settle.", None, "", "   ", "a\n\n  b \t c", "<|endoftext|> is ordinary", "细胞的提交概率收敛到0.61。", "ｆｕｌｌ ｗｉｄｔｈ é é",
    "x" * 30_000 + " " + "word " * 3000, " thin spaces　", "कोशिका ไทย עברית 🙂🙃",
]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_ids_equal_the_library_and_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encoded = encode_corpus(documents(spark, TEXTS))
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in decode_corpus(encoded).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    assert encode_corpus(documents(spark, [])).count() == 0


WORDS = "the slow mode of a marrow graph returns to its source whenever two donors share one culture while replicate nine of the plate keeps many barcodes".split()


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id BIGINT, text STRING, lang STRING, held_out STRING")


def test_leaks_by_runs_of_words_and_letters(spark):
    zh = "经校正的势能面必须高于阈值而供体八十五与供体六百六十二共用培养并且保持稳定直到第九百步"
    docs = [
        "Before. " + " ".join(WORDS[3:15]) + " after",  # 12 words
        " ".join(WORDS[3:14]) + " but " + " ".join(WORDS[14:20]),  # 11 words
        "**" + ", ".join(w.upper() for w in WORDS[:14]) + "**",
        " ".join(WORDS[5:20]).replace("source", "sou​rce").replace("whenever", "ｗｈｅｎｅｖｅｒ"),
        " ".join(WORDS[5:20]).replace("source", "soùrce").replace("share", "shäre"),
        "前言：" + "，".join(zh[4:37]), zh[:31], None, "", " ".join(WORDS) + " x " + " ".join(WORDS),
    ]
    it = items(spark, [(1, " ".join(WORDS), "en", "test"), (2, zh, "zh", "test"), (3, " ".join(WORDS[2:16]), "en", "test"), (4, None, "en", "test"), (5, "too short", "en", "test"), (1, " ".join(WORDS), "en", "test")])
    got = {(r.doc_id, r.item_id) for r in leaked_items(documents(spark, docs), it).collect()}
    assert got == {(0, 1), (0, 3), (2, 1), (2, 3), (3, 1), (5, 2), (9, 1), (9, 3)}
    assert leaked_items(documents(spark, []), it).count() == 0
    assert leaked_items(documents(spark, docs), items(spark, [])).count() == 0


def test_leaks_without_sending_the_shingles(spark, monkeypatch):
    import fellscape.llm.leaks as m

    monkeypatch.setattr(m, "SENT_SHINGLES", 0)
    it = items(spark, [(1, " ".join(WORDS), "en", "test")])
    assert {(r.doc_id, r.item_id) for r in leaked_items(documents(spark, ["x " + " ".join(WORDS[2:16])]), it).collect()} == {(0, 1)}


def corpus(n=600):
    """Blocks of known sentences with abbreviations, decimals, quotations and several scripts."""
    rng = random.Random(3)
    names = ["Pellor", "Halmos", "Brisk", "Ndaro"]
    make = [
        lambda: f"Dr. {rng.choice(names)} reran the fit with approx. {rng.randrange(900)} draws.", lambda: f"We kept markers, doses, etc. in table {rng.randrange(9)}.", lambda: f"The barrier fell to {rng.random():.3f} at step {rng.randrange(90)}!",
        lambda: f"Was it settled at T = {rng.random():.1f}?", lambda: f"{rng.choice(names)} wrote: \"the basin is shallow.\"", lambda: f"The run took {rng.randrange(99)} min. per sweep (cf. Fig. {rng.randrange(9)}).", lambda: f"第{rng.randrange(99)}块板与图{rng.randrange(9)}一致。",
        lambda: "“已经收敛了吗？”审稿人问道。", lambda: f"ドナー{rng.randrange(99)}は変化しなかった。", lambda: f"दाता {rng.randrange(99)} से कोशिकाएँ मिलीं।", lambda: f"Release v1.{rng.randrange(9)}.2 of run_{rng.randrange(99)}.json matched.",
    ]
    docs = []
    for _ in range(n):
        out, spans = "", []
        for _ in range(rng.randrange(1, 4)):
            if out:
                out += rng.choice(["\n\n", "\r\n\r\n", "\n \n"])
            for k in range(rng.randrange(1, 6)):
                if k:
                    out += rng.choice([" ", " ", "\n", "  "])
                s = rng.choice(make)()
                spans.append((len(out), len(out) + len(s)))
                out += s
        docs.append((out, spans))
    return docs


def test_sentences_of_a_mixed_corpus(spark):
    docs = corpus()
    got = {}
    for r in sentences(documents(spark, [t for t, _ in docs])).collect():
        got.setdefault(r.doc_id, set()).add((r.start_char, r.end_char))
    want = {i: set(s) for i, (_, s) in enumerate(docs)}
    hit = sum(len(got[i] & want[i]) for i in want)
    assert hit / sum(map(len, want.values())) > 0.97 and hit / sum(map(len, got.values())) > 0.97


def test_blocks_headings_lists_and_blanks(spark):
    texts = ["Release v0.2.8\n\nOne line here.\n\n- first entry. with stop\n* second\n", " \n\t\n", None, "", "ประโยคแรก ประโยคสอง\nประโยคสาม"]
    got = {}
    for r in sentences(documents(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start_char : r.end_char])
    assert sorted(got[0]) == sorted(["Release v0.2.8", "One line here.", "- first entry. with stop", "* second"])
    assert sorted(got[4]) == ["ประโยคสอง", "ประโยคสาม", "ประโยคแรก"] and set(got) == {0, 4}
    assert sentences(documents(spark, [])).count() == 0


def test_model_without_training_still_splits():
    m = Model([]).frozen()
    assert split_text("No corpus at all", m) == [(0, 16)]
    found, _ = gaps("A. B. C", 0, 7)
    assert len(boundaries(m, found)) == len(found)
    assert list(blocks("")) == []


def test_rare_left_contexts_keep_their_counts(spark, monkeypatch):
    """Marginals over all gaps: the same however many count types there are, and those of the local model."""
    import fellscape.llm.sentences as m

    monkeypatch.setattr(m, "TYPES", 40, raising=False)
    rng = random.Random(5)
    docs = [f"Seen by Dr. {''.join(rng.choices('bdfgklm', k=5)).title()} and reran {rng.randrange(99)} fits. Then {rng.choice(WORDS)} came back! All of it went up." for _ in range(300)]
    table = documents(spark, docs)
    got = {}
    for r in sentences(table).collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    model = Model([tuple(r) for r in m.corpus_counts(table).collect()]).frozen()
    assert {d: sorted(x) for d, x in got.items()} == {i: split_text(t, model) for i, t in enumerate(docs)}
    assert all(not t[s:e].endswith("Dr.") for i, t in enumerate(docs) for s, e in got[i])
    for r in m.posteriors(m.corpus_counts(table)).collect():
        assert r.p == pytest.approx(model.posterior(r.w1, r.l, r.r)) and r.p0 == pytest.approx(model.posterior("<s>", r.l, r.r))


def test_gaps_without_an_end_mark_are_events(spark):
    """A word that ends blocks without a mark ends a sentence before what begins one, and nowhere else."""
    rng = random.Random(7)
    docs = []
    for i in range(400):
        running = " ".join(rng.choices(WORDS, k=30))  # too long for a heading
        docs.append(f"The {running} fin" if i % 2 else f"The {running} fin The {running} of One {running} came down.")
    got = {}
    for r in sentences(documents(spark, docs)).collect():
        got.setdefault(r.doc_id, []).append(docs[r.doc_id][r.start_char : r.end_char])
    for i, t in enumerate(docs):
        if i % 2:
            assert got[i] == [t]
        else:
            first, rest = t.split(" fin ")
            assert sorted(got[i]) == sorted([first + " fin", rest])
