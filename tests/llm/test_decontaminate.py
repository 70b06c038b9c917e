import re
from collections import defaultdict

import pytest

from bazaar.llm import decontaminate as D

ITEM = "At noon Alice bought 12 apples and 7 pears at the old market for 30 dollars. How much did Alice pay for every piece?"
ITEMS = [(1, ITEM), (2, "too short"), (3, None), (4, "the quick brown fox jumps"), (4, "one two three four five"), (None, "six seven eight nine ten eleven")]


def test_templates():
    words, plain = D.template("On Monday Bob ran 5.5 km in 1,000 steps; NASA saw it. Then he ate.")
    assert words == ["on", "<name>", "ran", "<num>", "<unit>", "in", "<num>", "steps", "nasa", "saw", "it", "then", "he", "ate"]
    assert plain[1] == "monday bob"


@pytest.mark.parametrize("text,words", [
    ("Maria has 12 figs. Maria eats 3. What does Maria have?", "<name> has <num> figs <name> eats <num> what does <name> have"),
    ("The cat saw The Hague. The end of the day.", "the cat saw <name> the end of the day"),  # the stands in small letters too
    ("He met Mary Ann Smith, Bob and Al.", "he met <name> <name> and <name>"),
    ("What Is The Capital Of France And Spain", "what is the capital of france and spain"),
    ("She has twelve or 12.5 kg.", "she has <num> or <num> <unit>"), ("", ""), ("... !", ""), ("Ärger", "ärger")])
def test_names_numbers_and_titles(text, words):
    assert D.template(text)[0] == words.split()


def test_first_words_of_sentences():
    text = "Maria has figs. Ann Lee buys pears."
    assert D.template(text, "all")[0] == "<name> has figs <name> buys pears".split()
    assert D.template(text, "none")[0] == "maria has figs ann <name> buys pears".split()


def test_other_names_and_number_words(spark):
    items = spark.createDataFrame([
        (1, "Maria has 12 apples. Maria buys 7 pears. Maria eats 3 plums. What does Maria have left?"),
        (2, "What Is The Capital Of France And Spain"),
        (3, "Mary Ann has five baskets of figs and gives two baskets to Tom before noon. How many baskets does Mary Ann keep?"),
        (4, "Der Hund von Herrn Meier jagt die Katze von Frau Schulz durch Garten, Hof und Keller in Bonn."),
        (5, "Paris lies on a river. How long is it from the sea?")], "item_id long, text string")
    documents = [
        (1, "So: Robert has 45 apples. Robert buys 3 pears. Robert eats 9 plums. What does Robert have left?"),
        (2, "I ask: What Is The Capital Of France And Spain, if any?"),
        (3, "Bob has twelve baskets of figs and gives nine baskets to Jim before noon. How many baskets does Bob keep?"),
        (4, "Ja. Der Hund von Herrn Meier jagt die Katze von Frau Schulz durch Garten, Hof und Keller in Bonn. Nein."),
        (5, "We saw Paris and Rome. Paris lies on a river. How long is it from the sea? Rome does too."),
        (6, "Robert has 45 boats. Susan sells 3 hats. Tom eats 9 plums. What does Ann want?"),
        (7, "Der Wolf von Doktor Krause sucht den Hasen von Oma Vogt unter Tisch, Bank und Bett in Köln.")]
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(documents, "doc_id long, text string"), items).collect()}
    assert got == {(i, i) for i in range(1, 6)}


def test_reparameterised_questions_are_caught(spark):
    documents = [
        (1, "Text. At noon Robert bought 45 apples and 3 pears at the old market for 99 dollars. How much did Robert pay for every piece? End."),
        (2, "At noon Robert bought 45 apples and 3 pears at the old market for 99 euros. How much did Susan pay for every piece?"),
        (3, None), (4, ""), (5, "and the quick brown fox jumps over"), (6, "At noon Bob bought 12 pans and 7 pots in the new shop."),
        (5, "and the quick brown fox jumps over"), (None, "say six seven eight nine ten eleven now")]
    df = spark.createDataFrame([(*d, "x") for d in documents], "doc_id long, text string, item string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, items).collect()}
    assert got == {(1, 1), (5, 4), (None, None)}
    kept = D.clean(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]


def test_verbatim_items_equal_brute_force(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    grams = defaultdict(set)
    for r in items.collect():
        words = re.findall(r"\w+", r.text.lower())
        for i in range(len(words) - 7):
            grams[tuple(words[i:i + 8])].add(r.item_id)
    wanted = set()
    for r in documents.collect():
        words = re.findall(r"\w+", r.text.lower())
        wanted |= {(r.doc_id, item) for i in range(len(words) - 7) for item in grams.get(tuple(words[i:i + 8]), ())}
    assert {(r.doc_id, r.item_id) for r in D.leaks(documents, items).collect()} == wanted and wanted


def test_empty_tables(spark, nothing, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.leaks(nothing, items).collect() == [] and D.leaks(odd, items.limit(0)).collect() == []
    assert D.clean(odd, items.limit(0)).count() == 9


def test_parts_of_items_and_inserted_words(spark):
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha") for b in ("lo", "mi", "nu", "pa", "re", "so", "ta", "vi", "wo")]
    long, short, two = " ".join(words), " ".join(f"s{w}" for w in words[:14]), [f"t{w}" for w in words[:30]]
    items = spark.createDataFrame([(1, long), (2, short), (3, " ".join(two))], "item_id long, text string")
    split = short.split()
    documents = [
        (1, "x y " + " ".join(words[20:33]) + " z"),  # a quarter of the item
        (2, "x y " + " ".join([*split[:7], "inserted", *split[7:]]) + " z"),
        (3, " ".join(["x", *two[4:10], "in", *two[10:16], "in", "out", *two[16:22], "z"])),  # 18 of 30 words at three shifts
        (4, "x y " + " ".join(words[20:32]) + " z"),  # 12 words only
        (5, " ".join(["x", *two[0:7], *(f"far{i}" for i in range(40)), *two[14:22]]))]  # 15 words, far apart
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(documents, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}
