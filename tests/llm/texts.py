"""Made-up texts for the brute-force tests."""

import random

VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "sta", "tre", "vo") for b in ("ra", "des", "lin", "mo", "qui", "sel", "ton", "zu")]


def prose(g: random.Random, n: int) -> list[str]:
    return [g.choice(VOCAB) for _ in range(n)]


def edited(g: random.Random, words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        k = g.randrange(len(out))
        out[k : k + 1] = g.choice(([], ["inserted", out[k]], ["changed"]))
    return out


EDGE = [None, "", "   \n\t", "!!! ???", "one", "One", "one two three four", "ééé ñandú", "a " * 3000, None, "", "one"]
