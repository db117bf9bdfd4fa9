from wayfare.llm import quality_neighbours as Q


def test_repeated_words_are_counted_in_texts_of_any_length():
    for n in (10, 1999, 2000, 50_000):
        assert Q.term_counts("a b " * (n // 2) + "c " * (n % 2))[Q.TERMS - 3] == n - 2 - n % 2
