"""The suffix tree keeps what is rare in a large corpus, and scores as plain recursion does."""

import collections
import math

from gridlake.llm import suffix_lm


def code(context: bytes) -> int:
    return int.from_bytes(context, "big")


def plain(texts, divergence=suffix_lm.DIVERGENCE, depth=suffix_lm.DEPTH):
    """Score of a canonical text by the definition, over dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        x = b"\n" * depth + t
        for i in range(depth, len(x)):
            for k in range(depth + 1):
                counts[x[i - k : i]][x[i]] += 1

    def p(context, s):
        c = counts[context]
        if not context:
            return (c[s] + 1) / (c.total() + 256)
        return (c[s] + len(c) * p(context[1:], s)) / (c.total() + len(c))

    kept = {b""}
    for x, c in list(counts.items()):
        if x and 2 * sum(n * math.log(n / c.total() / p(x[1:], s)) for s, n in c.items()) > divergence * len(c):
            kept |= {x[a:b] for a in range(len(x)) for b in range(a + 1, len(x) + 1)}

    def score(t):
        x, total = b"\n" * depth + t, 0.0
        for i in range(depth, len(x)):
            k = next(k for k in range(depth, -1, -1) if x[i - k : i] in kept)
            total += math.log10(p(x[i - k : i], x[i]))
        return total

    return score


def test_rare_contexts_stay_in_a_large_corpus(spark):
    rows = [("the cat sat on the mat and looked at the dog " * 100,)] * 1000 + [("zqa1",), ("yqa2",)] * 5
    tree = suffix_lm.train(spark.createDataFrame(rows, "text string")).tree
    assert {code(b"zqa"), code(b"yqa")} <= set(tree.contexts[3].tolist())


def test_scores_by_definition(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "zqxjv kwpyb", ""]
    model = suffix_lm.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    score = plain([t.encode() + b"\n" for t in texts])
    asked = [*texts, "the log sat", "zqxjw \x7f"]
    got = {r.k: r.score for r in suffix_lm.score(spark.createDataFrame(list(enumerate(asked)), "k int, text string"), model).collect()}
    for i, t in enumerate(asked):
        assert abs(got[i] - score(t.encode() + b"\n")) < 1e-4
