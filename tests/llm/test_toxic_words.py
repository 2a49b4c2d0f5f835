"""A toxic word weighs by itself, however ordinary the words around it."""

import numpy as np

from ravelin.llm import toxicity


def model(s):
    return toxicity.Toxicity(b" the sea and plain ", b" scum ", np.zeros(s.width + 1), s, b" scum loser ")


def test_one_word_in_a_long_text_is_counted():
    s = toxicity.BY_WORD
    plain = "orth ention thand whereing plasta vondly " * 60
    x = toxicity.features([plain, plain + "scum", "scum, " + plain], model(s).compressors(), s)
    words = x[:, -len(s.sizes) * len(s.nearer) :]
    assert words[0].sum() == 0 and words[1].sum() > 0 and (words[1] == words[2]).all()


def test_word_sizes_do_not_hang_on_what_was_seen():
    s, seen = toxicity.BY_WORD, {}
    texts, tools = ["The scum, the sea", "", "loser's scum", " . "], model(s).compressors()
    once = toxicity.features(texts, tools, s, seen)
    assert once.shape == (4, s.width) and len(seen) == 5
    assert (toxicity.features(texts, tools, s, seen) == once).all() and (toxicity.features(texts, tools, s) == once).all()
    assert (once[1] == 0).all() and (once[3] == 0).all()


def test_telling_words_frequent_last():
    s = toxicity.Settings(least_passages=3, least_ratio=2.0)
    toxic = [b" the idiot said ", b" an idiot came ", b" idiot and more ", b" the plain sea ", b" idiots are "]
    ordinary = [b" the plain sea ", b" the plain road ", b" the plain house "]
    good = toxicity.telling_runs(toxic, ordinary, s)
    words = toxicity.telling_words(toxicity.with_runs(toxic, good, s), good, s)
    assert words == b" idiots  idiot "
