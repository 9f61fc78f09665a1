from quillon.llm import decontam

FAR = "How far is New York City from Los Angeles?"
SUM = "What is 12 + 47 - 3 * 8 / 2 ?"
LONG_SUM = "Compute 3 + 4 + 5 + 6 + 7 + 8 + 9 + 10 + 11 + 12 for Smith."
JOHN = "John has 12 big apples in a box. John buys 5 more of them at a shop. John gives 3 away to a friend. How many are left in the box?"


def marked(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return [(r["contaminated"], r["item_id"]) for r in decontam.mark_contaminated(docs, items).orderBy("doc_id").collect()]


def test_short_items_and_items_of_numbers(spark):
    quote = "A page of notes about many other things. {} Nobody there knew what to say to that."
    docs = [quote.format(FAR), quote.format(SUM), quote.format(LONG_SUM), SUM, quote.format("What is 13 + 40 - 3 * 8 / 2 ?"), quote.format("How far is it to the sea?"), LONG_SUM.replace("+ 4", "+ 40").replace("+ 9", "+ 90")]
    assert marked(spark, [FAR, SUM, LONG_SUM], docs) == [(True, 1), (True, 2), (True, 3), (True, 2), (False, None), (False, None), (False, None)]


def test_very_short_items_match_equal_texts_only(spark):
    assert marked(spark, ["the end"], ["The end.", "It was the end of a day in the north."]) == [(True, 1), (False, None)]


def test_names_that_open_a_sentence(spark):
    anna = JOHN.replace("John", "Anna").replace("12", "31").replace("5", "8").replace("3 away", "4 away")
    inside = JOHN.replace("John has", "It is said that Anna has").replace("John", "Anna")
    other = "The man has a box of things in a house. Nobody gives them away to a friend at a shop. How many are left?"
    got = marked(spark, [JOHN], ["Before. " + anna, inside, JOHN, other])
    assert got == [(True, 1), (True, 1), (True, 1), (False, None)]


def test_template_windows_still_count_by_themselves(spark):
    """Windows low in words do not lessen the cover of an item whose numbers were changed."""
    item = "Sum of the red and the blue marbles in a jar: 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18."
    other = item.replace("3, 4, 5", "30, 41, 52").replace("17, 18", "70, 80").replace("10, 11", "26, 27")
    assert marked(spark, [item], [other]) == [(True, 1)]


def test_two_values_that_become_one_are_another_question(spark):
    item = "A shop sells 4 red pens and 9 blue pens in a box, and 4 boxes make 9 crates for the school."
    docs = [item, item.replace("4", "7").replace("9", "7"), item.replace("4", "31").replace("9", "7"), item.replace("9", "4")]
    assert marked(spark, [item], docs) == [(True, 1), (False, None), (True, 1), (False, None)]
