import time

import pytest

from fotarium.llm.sentences import Corpus, corpus_counts, enclosed, learn, sentences, split, word_before

EN = ["Dr. Solvang kept it.", "We saw Dr. Solvang today.", "It was late.", "The card is full, etc. before noon.", "See fig. 4 there.", "No. 5 is fig. 9 now.", "We stopped at 3 p.m. sharp.", "Is it sharp?", "Was it kept?", "Keep it!", "Frame 35 is soft.", "They left L1100058.DNG here.", "Why?", "Pell came by.", "Nobody knew."]
DE = ["Das war im 3. Satz der Probe.", "Am 9. Mai war es dunkel.", "Das gilt z. B. für Nr. 16 heute.", "Ist das scharf?", "Warum ist es dunkel?", "Behalten!", "Es war im 4. Satz gut.", "Am 1. Mai war es hell."]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join([x, *EN[(i * 3) % 9 :], x]), "en") for i, x in enumerate(EN * 12)] + [(1000 + i, " ".join([x, *DE, x]), "de-AT") for i, x in enumerate(DE * 12)]
    table = learn(corpus_counts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "text", "lang")).collect()
    held = {}
    for r in table:
        held.setdefault(r["lang"], {}).setdefault(r["kind"], {})[r["a"], r["b"]] = r["value"]
    return Corpus(held)


CASES = [
    ("en", ["Dr. Solvang came.", "It was late."]),
    ("en", ["See fig. 4 there.", "No. 5 is soft."]),
    ("en", ["We stopped at 3 p.m.", "Was it kept?", "Keep it!"]),
    ("en", ["“Is it sharp?” asked Pell.", "“Keep it!”", "Nobody knew."]),
    ("en", ["They wrote: “Too dark. Crop it.”", "It was late."]),
    ("en", ["Nobody (not even Dr. Solvang!) saw it.", "(It was late.)", "Keep it!"]),
    ("en", ["Hmm... maybe later.", "It goes on...", "The end."]),
    ("en", ["They left L1100058.DNG here.", "The file is L1100058.DNG.", "It was kept at 2.5 s."]),
    ("en", ["2. Keep it!", "Why?!", "It was late."]),
    ("de", ["Das war im 3. Satz der Probe.", "Am 9. Mai war es gut.", "Warum ist es dunkel?"]),
    ("de", ["„Ist das scharf?“, fragte sie.", "Behalten!"]),
    ("zh", ["她写道：“太暗。删掉。”", "再看一遍……", "（以后再排。）", "很好！"]),
    ("ja", ["34．5秒でした。", "編集者（「暗い！」が口癖だ）は捨てた。", "「暗い。捨てよう。」と書いた。"]),
    ("ru", ["«Это резко?» — спросил редактор.", "Оставить!"]),
    ("hi", ["इसे रखिए!", "यह साफ़ है।", "सीमा 8.0 ही रहेगी।"]),
    ("el", ["Είναι θολό το πέπλο;", "Κράτησέ το!"]),
    ("am", ["ፎቶው ግልጽ ነው።", "ብርሃኑ ጥሩ ነው።"]),
    ("hy", ["Շատ մութ է։", "Աչքերը փակ են։"]),
    ("th", ["ดวงตาคมชัดดี", "ภาพที่ 86 มีสะพาน", "ไฟล์ L1106716.DNG ยังไม่ได้ตรวจ"]),
    ("ar", ["هل هي حادة؟", "الحد هو 1.25 فقط."]),
]


@pytest.mark.parametrize(("lang", "parts"), CASES)
def test_rules(model, lang, parts):
    gap = "" if lang in ("zh", "ja") else " "
    text = "  " + gap.join(parts) + "\r\n \r\n" + parts[0] + "\n"
    got = [text[a:b] for a, b in split(text, model.model(lang, text))]
    assert got == [*parts, parts[0]]


def test_missing_blanks_and_headings(model):
    text = "Notes on it\n\nKeep it!It was late.The card is full.\nNobody\nknew."
    assert [text[a:b] for a, b in split(text, model.model("en", text))] == ["Notes on it", "Keep it!", "It was late.", "The card is full.", "Nobody\nknew."]


def test_every_character_lies_in_one_sentence(model):
    for text in ("", " \n\n ", "...", "?!)\"", "a" * 200_000, ". " * 5000, "(“" * 3000 + "x." * 3000, "\U0001f600. x", "A.B.C. d"):
        spans = split(text, model.model("en", text))
        assert all(x.isspace() for x in "".join(text[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(text)], strict=True)))
        assert all(text[a:b].strip() == text[a:b] and a < b for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_rows(spark):
    rows = [(1, "One. Two.", "en", 5), (1, "One. Two.", "en", 5), (2, None, None, None), (3, "", "xx", 1), (4, "  \n\n ", "en", 1), (None, "Yes!", "EN", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, sent_start int")
    got = sorted((r["doc_id"] or 0, r["sent_start"], r["sent_end"]) for r in sentences(df).collect())
    assert got == [(0, 0, 4), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert sentences(df.limit(0)).collect() == []


@pytest.mark.parametrize("times", [1, 8])
def test_starters_by_ratio_not_count(spark, times):
    texts = (["Vorland came by."] * 2 + ["We saw Vorland. They met Vorland near Vorland Hall."] * 20 + ["It was late.\n\nIt was kept."] * 12 + ["第92张很好。我们再看第8组。"] * 3) * times
    rows = [(i, t, "de" if i % 5 == 4 else "en") for i, t in enumerate(texts)]
    held = {}
    for r in learn(corpus_counts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "text", "lang")).collect():
        held.setdefault(r["lang"], {}).setdefault(r["kind"], {})[r["a"], r["b"]] = r["value"]
    starts = {lang: {a for a, _ in tables.get("start", {})} for lang, tables in held.items()}
    assert "U:it" in starts["en"] and not any("U:vorland" in words for words in starts.values())
    corpus = Corpus(held)
    text = "We saw K. Vorland there. It was late."
    assert [text[a:b] for a, b in split(text, corpus.model("en", text))] == ["We saw K. Vorland there.", "It was late."]


def test_words_before_stops_are_whole():
    name = "shoot_" * 40 + "final.DNG"
    assert word_before(f"They left {name}.", 10 + len(name), 0) == name
    assert word_before("暗い" * 5000 + "写真。", 10_002, 0) == ""
    long = "b" * 500_000
    assert word_before(f"x {long}.", 2 + len(long), 0) == long


def test_unmatched_marks_take_linear_time():
    began = time.perf_counter()
    assert enclosed("([" * 50_000 + "}" * 50_000, 0, 150_000) == []
    assert enclosed("(" * 50_000 + ")" * 50_000, 0, 100_000) == [(0, 99_999)]
    assert time.perf_counter() - began < 2
