from elastrain.llm import quality


def test_shape_is_that_of_the_whole_word():
    assert quality.shape("a" * 70 + "B1" + "c" * 10**6 + "!") == "a~0a!"
    first, second = (quality.features("中" * 64 + end, quality.Tokens()).tolist() for end in ("中", "1x!"))
    word_only = quality.features("中" * 64 + "文", quality.Tokens()).tolist()
    assert len(set(first) & set(word_only)) == 1 and not set(first) & set(second)
