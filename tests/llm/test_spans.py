from collections import defaultdict

from bazaar.llm import spans

PASSAGE = "The tall grey heron stood in the reeds. It did not move at all for nearly one hour. Then, slowly, it took a step."


def brute(rows):
    places = defaultdict(set)
    for i, (doc_id, text) in enumerate(rows):
        for first, last, digest in spans.spans(text):
            places[digest].add((doc_id is None, doc_id or 0, first, text, last))
    gone = defaultdict(set)
    for found in places.values():
        for _, doc_id, first, text, last in sorted(found, key=lambda p: p[:3])[1:]:
            gone[doc_id, text] |= set(range(first, last + 1))
    out = []
    for doc_id, text in rows:
        parts = spans.sentences(text or "")
        cut = gone[doc_id or 0, text]
        out.append((doc_id, text if not cut else text[:parts[0][0]] + "".join(text[a:b] for n, (a, b, _) in enumerate(parts) if n not in cut)))
    return out


def test_sentences_are_the_text():
    for text in (PASSAGE, "a\nb", "  x. y", "word " * 500, "no end", "A.B c", ""):
        parts = spans.sentences(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text[parts[0][0] if parts else 0:]
        assert all(len(w) <= spans.LONG for _, _, w in parts)


def test_documents_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = spans.without_repeats(documents).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(brute(rows))
    changed = {r.doc_id for r in got if r.removed_chars}
    assert changed == {r.doc_id for r in spans.repeats(documents).collect()}
    texts = dict(rows)
    assert all(len(texts[r.doc_id]) - len(r.text) == r.removed_chars == sum(map(len, r.removed)) for r in got)


def test_the_first_place_stays(spark):
    rows = [(7, f"Some words before it, and more. {PASSAGE} And after."), (3, f"Own text here. {PASSAGE}"), (9, "Clean text. It has two sentences of its own."),
            (None, PASSAGE), (8, f"{PASSAGE} {PASSAGE}"), (1, "It. A. The."), (2, "It. A. The."), (3, f"Own text here. {PASSAGE}")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, removed string")
    got = {(r.doc_id, r.text) for r in spans.without_repeats(df).select("doc_id", "text").collect()}
    assert got == {(7, "Some words before it, and more. And after."), (3, rows[1][1]), (9, rows[2][1]), (None, ""), (8, ""), (1, rows[5][1]), (2, rows[6][1])}
    assert spans.cleaned(df).columns == df.columns
    assert sorted(str(r.doc_id) for r in spans.cleaned(df).collect()) == ["1", "2", "3", "3", "7", "9"]


def test_a_passage_of_one_long_sentence_is_found(spark):
    long = " ".join(f"w{i}" for i in range(60)) + "."
    df = spark.createDataFrame([(1, long), (2, f"Before.\n{long}\nAfter.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in spans.repeats(df).collect()} == {2: "Before.\nAfter."}


def test_odd_rows(odd, nothing):
    rows = spans.without_repeats(odd).collect()
    assert len(rows) == 9 and {r.text for r in rows if r.doc_id in (1, 2, 3, 4)} == {"a b c", None, "", "  \n "}
    assert spans.without_repeats(nothing).collect() == []


def test_a_passage_in_the_middle_of_sentences_is_found_whatever_stands_around_it(spark):
    import random

    draw = random.Random(3)
    rows = []
    for i in range(0, 40, 2):
        passage = " ".join(f"p{draw.randrange(400)}" + "." * (n % 25 == 24) for n in range(51))
        for doc_id in (i, i + 1):
            before, after = (" ".join(f"{x}{doc_id}x{n}" for n in range(draw.randrange(1, 30))) for x in "ab")
            rows.append((doc_id, f"{before} {passage} {after}."))
    got = {r.doc_id: r.text for r in spans.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == set(range(1, 40, 2))
    for doc_id, text in got.items():
        left = [w for w in text.split() if w.startswith("p")]
        assert len(left) <= 4 * spans.WINDOW
        assert len(text.split()) - len(left) == len([w for w in dict(rows)[doc_id].split() if not w.startswith("p")])


def test_a_short_last_sentence_goes_with_its_passage(spark):
    passage = "One two three four five six seven eight nine ten. Cats and dogs sat on the old brown mat together. So it was."
    df = spark.createDataFrame([(1, f"{passage} The first goes on here with words of its own."), (2, f"{passage} Other end.")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in spans.repeats(df).collect()} == {2: "Other end."}
