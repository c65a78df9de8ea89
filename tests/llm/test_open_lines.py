from loomway.llm.sentences import sentences, words


def test_open_lines_keep_their_finished_sentences():
    assert sentences("The tram was late. It stopped. (bis)") == ["The tram was late.", "It stopped."]
    assert sentences("The tram was late! And then it") == ["The tram was late!"]
    assert sentences("The tram was late.東京") == ["The tram was late."]
    assert sentences("Title without an end") == sentences("(bis)") == sentences("NOTICE ? / 2022-07-02") == sentences("trip_leg: 954 (bis)") == []
    assert sentences("| The cell is late. | x") == []


def test_long_words_are_whole():
    a, b = "x" * 40 + "a", "x" * 40 + "b"
    assert words(f"{a} {b}") == [a, b]
